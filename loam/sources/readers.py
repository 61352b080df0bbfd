"""Data sources: zip archives by members, and the ends of JSON-lines logs.

    register(spark)
    spark.read.format("zip_members").load("/data/archives")
    spark.read.format("jsonl_tail").option("limit", 50).option("kind", "trace").load("/data/log")

An archive is planned from its central directory: members are dealt to partitions by their sizes, so that one large archive is
read by many tasks and each opens only its own members. A log is read backwards from its end, block by block, until there are
enough events: what lies before is never read.
"""

from __future__ import annotations

import json
import zipfile

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition

from loam.sources import remote

#: Bytes of members, as packed, that make a partition; bytes of a block of a log.
PART_BYTES, BLOCK_BYTES = 1 << 25, 1 << 16
#: Bytes of content, and members, that are sent to Spark at a time.
SENT_BYTES, SENT_ROWS = 1 << 21, 1000
LIMIT = 50
#: What opening a file that is no archive raises, one too short for its directory included.
BROKEN = (zipfile.BadZipFile, OSError, ValueError)


class Members(InputPartition):
    def __init__(self, archive: str, names: list[str]):
        self.archive, self.names = archive, names


class ZipMembers(DataSource):
    """archive, member, size, content, error of every member of the .zip files at a path (folders are none), or of those that the
    option archives names, a line each. part_bytes: see PART_BYTES. An archive or a member that can't be read is a row with its error and without content."""

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return "archive string, member string, size long, content binary, error string"

    def reader(self, schema) -> DataSourceReader:
        return ZipReader(self.options)


class ZipReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.part_bytes = options["path"], int(options.get("part_bytes", PART_BYTES))
        self.archives = options.get("archives", "").split()

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for uri in self.archives or [uri for uri, _ in remote.listed(self.path, ".zip")]:
            try:
                with remote.opened(uri) as f, zipfile.ZipFile(f) as z:
                    members = [(m.filename, m.compress_size) for m in z.infolist() if not m.is_dir()]
            except BROKEN:
                members = [("", 0)]  # its task says why
            names, size = [], 0
            for name, n in members:
                if names and size + n > self.part_bytes:
                    out.append(Members(uri, names))
                    names, size = [], 0
                names.append(name)
                size += n
            if names:
                out.append(Members(uri, names))
        return out or [Members("", [])]

    def read(self, partition):
        """Arrow batches of some SENT_BYTES of content: Spark itself would hold 10,000 members at a time."""
        import pyarrow as pa

        schema = pa.schema([("archive", pa.string()), ("member", pa.string()), ("size", pa.int64()), ("content", pa.binary()), ("error", pa.string())])
        held, size = [], 0
        for row in self.members(partition):
            held.append(row)
            size += row[2] or 0
            if size >= SENT_BYTES or len(held) >= SENT_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held), schema)], schema=schema)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held), schema)], schema=schema)

    def members(self, partition):
        if not partition.archive:
            return
        try:
            with remote.opened(partition.archive) as f, zipfile.ZipFile(f) as z:
                for name in partition.names:
                    try:
                        raw = z.read(name)
                        yield partition.archive, name, len(raw), raw, None
                    except Exception as e:  # noqa: BLE001  one member's failure is its own row
                        yield partition.archive, name, None, None, f"{type(e).__name__}: {e}"[:300]
        except BROKEN as e:
            yield partition.archive, None, None, None, f"{type(e).__name__}: {e}"[:300]


class LogEnd(InputPartition):
    def __init__(self, uri: str, size: int):
        self.uri, self.size = uri, size


class JsonlTail(DataSource):
    """file, offset, kind, value: the newest `limit` lines of each JSON-lines file at a path, newest first, that are JSON objects,
    of one `kind` if it is named; offset is where the line begins. A filter kind = '…' is pushed down
    and means the same as the option."""

    @classmethod
    def name(cls) -> str:
        return "jsonl_tail"

    def schema(self) -> str:
        return "file string, offset long, kind string, value string"

    def reader(self, schema) -> DataSourceReader:
        return TailReader(self.options)


class TailReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.limit, self.kind = options["path"], int(options.get("limit", LIMIT)), options.get("kind")
        self.block = int(options.get("block_bytes", BLOCK_BYTES))

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("kind",) and self.kind in (None, f.value):
                self.kind = f.value
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [LogEnd(uri, size) for uri, size in remote.listed(self.path, "")] or [LogEnd("", 0)]

    def read(self, partition):
        if not partition.uri or self.limit < 1:
            return
        found = 0
        with remote.opened(partition.uri) as f:
            for offset, line in backwards(f, partition.size, self.block):
                try:
                    record = json.loads(line)
                except ValueError:
                    continue
                kind = record.get("kind") if isinstance(record, dict) else None
                if isinstance(record, dict) and (self.kind is None or kind == self.kind):
                    yield partition.uri, offset, None if kind is None else str(kind), line.decode("utf-8", "replace")
                    found += 1
                    if found == self.limit:
                        return


def backwards(f, size: int, block: int):
    """(offset, line) of a file's non-blank lines from the last to the first; blocks are read as they are needed."""
    end, held = size, []  # the pieces of the line whose beginning isn't read yet, last first
    while end > 0:
        start = max(0, end - block)
        f.seek(start)
        pieces = f.read(end - start).split(b"\n")
        at = end
        for k in range(len(pieces) - 1, 0, -1):
            at -= len(pieces[k])
            line = b"".join([pieces[k], *reversed(held)])
            held = []
            if line.strip():
                yield at, line
            at -= 1
        held.append(pieces[0])
        end = start
    line = b"".join(reversed(held))
    if line.strip():
        yield 0, line


def register(spark: SparkSession) -> None:
    """Both sources, and the setting that lets filters reach readers, which sources with such filters need."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ZipMembers)
    spark.dataSource.register(JsonlTail)
