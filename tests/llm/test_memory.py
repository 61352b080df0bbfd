"""What stages of the pipeline leave in the Python workers, and how many texts they are sent at a time."""

import corpus_pipeline
from loam.llm import packing
from loam.llm.shared import BATCH_ROWS, short_batches

ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_workers_keep_no_words_after_packing(spark):
    docs = spark.range(0, 400, numPartitions=4).selectExpr("id AS doc_id", "concat('word', id, ' other', id * 7) AS text")
    packing.pack(docs).count()

    def held(batches):
        import pyarrow as pa

        from loam.llm.bpe import word_encoder

        for _ in batches:
            w = word_encoder()
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(w) + len(w.old)], pa.int64())})

    assert {r.n for r in spark.range(0, 8, numPartitions=4).mapInArrow(held, "n long").collect()} == {0}


def test_stages_send_few_texts_at_a_time(spark):
    docs = spark.createDataFrame([(1, "some plain words of a text", "en", "src1", 26)], "doc_id long, text string, lang string, source string, n_chars long")
    before = spark.conf.get(ROWS)
    try:
        for name, stage in corpus_pipeline.STAGES:
            if name != "line_dedup":  # sends nothing to Python
                spark.conf.set(ROWS, 10_000)
                stage(spark, docs, "").count()
                assert int(spark.conf.get(ROWS)) == BATCH_ROWS
        spark.conf.set(ROWS, 7)
        short_batches(spark)
        assert spark.conf.get(ROWS) == "7"
    finally:
        spark.conf.set(ROWS, before)
