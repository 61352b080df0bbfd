"""Files in every format that the extractors read, made here, and stores, backups and streams."""

import csv
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from loam.operators import corpus as O
from loam.sources import files as S
from loam.sources import sinks as K

W = 'xmlns:w="http://w"'
P = 'xmlns:p="http://p" xmlns:a="http://a"'


def zipped(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def shape(text, kind=None):
    ph = f'<p:ph type="{kind}"/>' if kind else ""
    return f"<p:sp>{ph}<a:p><a:t>{text}</a:t></a:p></p:sp>"


FILES = {
    "a.docx": zipped(**{"word/document.xml": f"<w:document {W}><w:p><w:t>一</w:t></w:p><w:p/><w:p><w:t>二</w:t><w:tab/><w:t>三</w:t></w:p></w:document>"}),
    "b.pptx": zipped(**{
        "ppt/slides/slide10.xml": f"<p:sld {P}>{shape('短')}{shape('正文')}</p:sld>",
        "ppt/slides/slide2.xml": f"<p:sld {P}>{shape('标题', 'title')}{shape('内容')}</p:sld>",
        "ppt/slides/_rels/slide2.xml.rels": '<r><x Type="http://t/notesSlide" Target="../notesSlides/notesSlide1.xml"/><x Type="http://t/image" Target="../media/i.png"/></r>',
        "ppt/notesSlides/notesSlide1.xml": f"<p:notes {P}>{shape('备注', 'body')}</p:notes>",
    }),
    "c.xlsx": zipped(**{
        "xl/workbook.xml": '<w><sheet name="表一"/></w>',
        "xl/sharedStrings.xml": "<s><si><t>甲</t></si></s>",
        "xl/worksheets/sheet1.xml": '<s><row><c r="AA1"><v>3</v></c><c r="B1" t="s"><v>0</v></c></row><row><c r="A2"/></row></s>',
    }),
    "d.csv": "﻿x, y ,,\n1,,2\n".encode(),
    "e.html": "<p>a<br>b</p><script>x</script>".encode(),
    "f.json": json.dumps({"a": {"b": [1, {"c": "x"}]}, "n": None}).encode(),
    "g.epub": zipped(**{"META-INF/container.xml": '<c><rootfile full-path="o/p.opf"/></c>', "o/p.opf": '<p><item href="2.xhtml"/><item href="1.html"/></p>', "o/1.html": "<p>one</p>", "o/2.xhtml": "<p>two</p>"}),
    "h.txt": "中文".encode("gbk"),
    "i.zip": zipped(**{"x.md": "# t", "../y.txt": "z"}),
    "j.docx": b"broken",
    "k.exe": b"x",
}
TEXTS = {
    "a.docx": "一\n\n二\t三",
    "b.pptx": "【PPT第2页 标题】\n\n内容\n\n备注\n\n【PPT第10页 短】\n\n正文",
    "c.xlsx": "【工作表 表一】\n甲 | 3",
    "d.csv": "x | y\n1 | 2",
    "e.html": "a\nb",
    "f.json": "a.b[0]: 1\na.b[1].c: x\nn: None",
    "g.epub": "two\n\none",
    "h.txt": "中文",
    "i.zip": "## ../y.txt\nz\n\n## x.md\n# t",
    "j.docx": None,
    "k.exe": None,
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("files")
    for name, raw in FILES.items():
        (d / name).write_bytes(raw)
    (d / "~$a.docx").write_bytes(b"")
    return d


def test_extract(spark, folder):
    rows = S.extract(S.scan(spark, f"file://{folder}")).collect()
    assert {r.path.rsplit("/", 1)[-1]: r.text for r in rows} == TEXTS
    assert {r.path.rsplit("/", 1)[-1] for r in rows if r.error} == {"j.docx", "k.exe"}


def test_slides(spark, folder):
    rows = S.slides(S.scan(spark, f"file://{folder}", (".pptx",))).orderBy("idx").collect()
    assert [(r.idx, r.title, r.text, r.notes, r.images) for r in rows] == [(2, "标题", "内容", "备注", ["i.png"]), (10, "短", "正文", "", [])]


def test_trace_lines(spark, tmp_path):
    p = tmp_path / "t.jsonl"
    p.write_text('{"ts":"1","kind":"trace","id":"a","status":"done","secs":1.5}\nbroken\n{"ts":"2","kind":"span","id":"b"}\n')
    assert sorted(r.id for r in S.trace(spark, str(p)).collect()) == ["a", "b"]


def test_load_store(spark, tmp_path):
    (tmp_path / "kb1.json").write_text(json.dumps({"name": "n", "chunks": [{"text": "a"}, {"text": "b"}]}))
    chunks, sources = S.load_store(spark, str(tmp_path))
    assert sorted((r.kb, r.chunk_ord, r.text) for r in chunks.collect()) == [("kb1", 0, "a"), ("kb1", 1, "b")]
    assert sources.first().chunks == 2


def test_store_and_backup(spark, tmp_path):
    d = spark.createDataFrame([("x", 0, "a"), ("y", 0, "b")], "kb string, chunk_ord int, text string")
    path = f"{tmp_path}/store"
    K.write_store(d, path)
    K.write_store(spark.createDataFrame([("x", 0, "c")], d.schema), path)
    now = spark.read.parquet(path)
    assert sorted((r.kb, r.text) for r in now.collect()) == [("x", "c"), ("y", "b")]
    m = K.backup(d, f"{tmp_path}/backup")
    assert m["chunk_total"] == 2 and m["stores"] == {"x": 1, "y": 1}
    extra = spark.createDataFrame([("z", 0, "q"), ("x", 0, "other")], d.schema)
    assert sorted(r.text for r in K.restore(spark, f"{tmp_path}/backup", extra).collect()) == ["a", "b", "q"]
    assert K.restore(spark, f"{tmp_path}/backup", extra, merge=False).count() == 2


def test_stream_equals_batch(spark, tmp_path):
    from loam.streaming import trace as T

    src = "/root/testdata/sf0.001/events.parquet"
    spark.read.parquet(src).write.parquet(f"{tmp_path}/in")
    stream = T.event_stream(spark, f"{tmp_path}/in", spark.read.parquet(src).schema)
    got = T.run_once(T.windowed_stats(stream), "win", f"{tmp_path}/cp", "complete")
    want = T.windowed_stats(spark.read.parquet(src).withColumn("ts", F.col("ts").cast("timestamp")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_reindex_and_diff(spark):
    d = spark.createDataFrame([(0, "a", None), (1, "b", [1.0])], "chunk_ord int, text string, embedding array<double>")
    out = O.reindex(d, lambda t: F.array(F.char_length(t).cast("double")))
    assert sorted((r.chunk_ord, list(r.embedding)) for r in out.collect()) == [(0, [1.0]), (1, [1.0])]
    assert 0 < O.diff("a\nb", "a\nc")["ratio"] < 1


def test_office_round_trips():
    from loam.sources import office

    assert S.docx(office.write_docx([("h1", "标题 & <x>"), ("p", "一 **粗** 二")])) == "标题 & <x>\n一 粗 二"
    out = S.pptx(office.write_pptx([{"title": "甲", "bullets": ["一", "二"]}, {"title": "乙", "bullets": []}]))
    assert [(s["idx"], s["title"], s["text"]) for s in out] == [(1, "甲", "一\n二"), (2, "乙", "")]


def test_settings_and_routes():
    import pytest

    from loam.operators.match import Routes, deep_merge

    base = {"a": {"b": 1, "c": [1]}, "d": 2}
    assert deep_merge(base, {"a": {"c": [2], "e": 3}}) == {"a": {"b": 1, "c": [2], "e": 3}, "d": 2} and base["a"]["c"] == [1]
    r = Routes(chat=[lambda x: 1 / 0, lambda x: x + 1])
    assert r.call("chat", 1) == 2
    with pytest.raises(RuntimeError):
        r.call("embed", 1)


def test_oldest_backup_and_sources(spark, tmp_path):
    (tmp_path / "k1.json").write_text('{"name": "k1", "chunks": [{"text": "a", "source": "s"}]}')
    current = spark.createDataFrame([("k1", 0, "old", "s"), ("k2", 0, "b", "t")], "kb string, chunk_ord int, text string, source string")
    assert sorted((r.kb, r.text) for r in K.restore(spark, f"{tmp_path}/k1.json", current).collect()) == [("k1", "a"), ("k2", "b")]
    K.backup(current, f"{tmp_path}/backup")
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/backup/sources").collect())) == [("k1", "s", 1), ("k2", "t", 1)]


def test_csv_product(spark, tmp_path):
    rows = spark.createDataFrame([('a "b", c', None), ("d", "e")], "x string, y string").coalesce(1)
    K.write_csv(rows, f"{tmp_path}/csv", ["x", "y"])
    with open(next((tmp_path / "csv").glob("*.csv"))) as f:
        assert list(csv.reader(f)) == [["x", "y"], ['a "b", c', ""], ["d", "e"]]


def test_pages_of_odd_nesting():
    from loam.functions.markup import page_markdown

    deep = "<div>" * 5000 + "x" + "</div>" * 5000
    assert page_markdown(deep) == "x"
    assert page_markdown(None) == page_markdown("") == "" and page_markdown("</p>a<") == "a<"
    assert page_markdown("<h2></h2><p>a</p></div><p>b") == "a\nb"
    assert page_markdown("<main>" + "x" * 121 + "</main>y", (), ("main",)) == "x" * 121
