"""Archives by members and the ends of logs."""

import io
import json
import random
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loam.sources import readers


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([b"", b"a", b"bb\r", b"ccc ccc", b"  ", "é".encode()]), max_size=12), st.integers(1, 9), st.booleans())
def test_backwards(lines, block, ended):
    raw = b"\n".join(lines) + b"\n" * ended
    want, at = [], 0
    for line in raw.split(b"\n"):
        if line.strip():
            want.append((at, line))
        at += len(line) + 1
    assert list(readers.backwards(io.BytesIO(raw), len(raw), block)) == want[::-1]


def test_one_archive_is_read_by_several_tasks(spark, tmp_path):
    rng, held = random.Random(1), {}
    for a in range(2):
        with zipfile.ZipFile(tmp_path / f"{a}.zip", "w") as z:
            z.writestr("folder/", b"")
            for i in range(30):
                held[f"{a}.zip", f"folder/{i}.txt"] = raw = rng.randbytes(1000 * (i % 4))
                z.writestr(f"folder/{i}.txt", raw)
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    (tmp_path / "_hidden.zip").write_bytes(b"x")
    readers.register(spark)
    rows = spark.read.format("zip_members").option("part_bytes", 8000).load(f"file://{tmp_path}")
    assert rows.rdd.getNumPartitions() > 8
    got = rows.withColumn("task", F.spark_partition_id()).collect()
    assert {(r.archive.rsplit("/", 1)[1], r.member): bytes(r.content) for r in got if r.error is None} == held
    assert len({r.task for r in got if r.archive.endswith("0.zip")}) > 3
    assert [(r.archive[-7:], r.member, r.content) for r in got if r.error] == [("bad.zip", None, None)]
    one = spark.read.format("zip_members").load(f"{tmp_path}/1.zip")
    assert one.count() == 30 and one.rdd.getNumPartitions() == 1
    empty = tmp_path / "empty"
    empty.mkdir()
    assert spark.read.format("zip_members").load(str(empty)).count() == 0
    with pytest.raises(Exception):
        spark.read.format("zip_members").load(f"{tmp_path}/none").count()


def test_newest_events_without_a_full_scan(spark, tmp_path):
    lines = [json.dumps({"kind": ["trace", "agent", None][i % 3], "id": i, "t": "x" * (i % 50)}) for i in range(20000)]
    lines[-2], lines[-5], lines[-9] = "broken {", "", "[1]"
    (tmp_path / "log.jsonl").write_text("\n".join(lines) + "\n")
    readers.register(spark)
    held = spark.read.format("jsonl_tail").load(f"file://{tmp_path}")
    want = [(i, x) for i, x in enumerate(lines) if x.startswith("{")][::-1]
    got = held.orderBy(F.col("offset").desc()).collect()
    assert [r.value for r in got] == [x for _, x in want[:50]]
    raw = (tmp_path / "log.jsonl").read_bytes()
    assert all(raw[r.offset :].startswith(r.value.encode()) for r in got)
    few = spark.read.format("jsonl_tail").option("limit", 7).option("kind", "agent").load(f"file://{tmp_path}")
    assert [json.loads(r.value)["id"] for r in few.orderBy(F.col("offset").desc()).collect()] == [i for i, x in want if i % 3 == 1][:7]
    pushed = spark.read.format("jsonl_tail").option("limit", 7).load(f"file://{tmp_path}").filter("kind = 'agent'")
    assert sorted(r.value for r in pushed.collect()) == sorted(r.value for r in few.collect())

    class Counted(io.BytesIO):
        seen = 0

        def read(self, n=-1):
            out = super().read(n)
            Counted.seen += len(out)
            return out

    for i, _ in enumerate(readers.backwards(Counted(raw), len(raw), 4096)):
        if i == 50:
            break
    assert 0 < Counted.seen < len(raw) / 50


def test_members_are_sent_a_few_at_a_time(tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for i in range(6):
            z.writestr(f"{i}.txt", bytes([i]) * readers.SENT_BYTES)
        for i in range(6, 2500):
            z.writestr(f"{i}.txt", b"x")
    reader = readers.ZipReader({"path": f"file://{tmp_path}"})
    sent = [b for p in reader.partitions() for b in reader.read(p)]
    assert max(b.nbytes for b in sent) < 2 * readers.SENT_BYTES and max(b.num_rows for b in sent) <= readers.SENT_ROWS
    assert sorted(int(m.split(".")[0]) for b in sent for m in b.column("member").to_pylist()) == list(range(2500))
