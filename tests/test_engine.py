"""Verbs end to end."""

from pyspark.sql import functions as F

from loam import engine


def files(spark, *items):
    return spark.createDataFrame(list(items), "path string, content binary")


def test_ingest_ask_rebuild(spark):
    first = files(spark, ("/d/gate_manual.md", "水渠道常规维护周期为每季度一次。电话 13812345678。".encode()), ("/d/b.txt", "Gate PAF-2 check every 3 months.".encode()), ("/d/x.bin", b"?"))
    embed = lambda t: F.array(F.char_length(t).cast("double"), F.lit(1.0))
    chunks, outcome = engine.ingest(first, "public", embed=embed)
    assert outcome.filter("error IS NOT NULL").count() == 1 and chunks.count() == 2
    assert chunks.filter(F.contains("text", F.lit("[phone已脱敏]"))).count() == 1
    again, outcome = engine.ingest(files(spark, ("/e/copy.txt", "Gate PAF-2 check every 3 months.".encode()), ("/e/new.txt", "汛期前后需额外专项巡检。".encode())), "person:a", chunks, embed)
    assert outcome.count() == 1 and again.count() == 3
    out = engine.ask(again, "维护周期", spark.createDataFrame([([20.0, 1.0],)], "qv array<double>"))
    best = out["hits"].orderBy("ord").first()
    assert best.label == "gate manual" or best.kb == "person:a"
    assert out["context"].filter(F.contains("sentence", F.lit("维护周期"))).count() == 1


def test_graphs(spark):
    chunks = spark.createDataFrame([(0, "PAF 与 GIS 系统"), (1, "GIS PAF"), (2, "PAF")], "chunk_ord long, text string")
    g = engine.entity_graph(chunks)
    assert {r.term: r.df for r in g["nodes"].collect()} == {"PAF": 3, "GIS": 2}
    assert [(r.a, r.b, r.w) for r in g["edges"].collect()] == [("GIS", "PAF", 2)]
    w = engine.wiki_graph(spark.createDataFrame([("A", "见 [[B]]", ["s"]), ("B", "", ["s"])], "topic string, body string, sources array<string>"))
    assert w["edges"].count() == 1
