"""Byte-level BPE by distinct words.

Two encoders give the ids of the tokenizers library. WordEncoder serves tasks that need a text's ids on the spot: it
splits a text as the tokenizer's pre-tokenizer does and remembers the ids of words. encode_decode is the distinct-word
table:

1. Texts are split, a slice of documents at a time. A slice keeps its distinct words, in the order of their buckets, and in a
   side file, for each place in its texts, which of them stands there.
2. The slices' words meet by bucket of their hash: a bucket has all rows of a word, so each distinct word of the corpus is
   encoded once, and its ids go back to every slice that has it.
3. Each slice joins the ids to its places, and, to decode, the ids of its words to the pieces of the vocabulary.
"""

from __future__ import annotations

import hashlib
import json
import os
from array import array
from functools import lru_cache

import numpy as np
import public_tokenizers
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm.shared import mapped, put_bytes, scratch, table, texts, written

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
SPECIAL = "<|endoftext|>"
#: Characters that Python's regex and the tokenizers library's Unicode tables class alike (tests hold this). Texts with any
#: other character are split, or encoded whole, by the library.
STABLE = r"\x{0}-\x{52F}\x{2010}-\x{2027}\x{2030}-\x{205E}\x{20A0}-\x{20BF}\x{3001}-\x{3029}\x{3041}-\x{3096}\x{30A1}-\x{30FA}\x{4E00}-\x{9FCB}\x{AC00}-\x{D7A3}\x{FF01}-\x{FF5E}\x{1F300}-\x{1F64F}"
#: Words that a WordEncoder remembers in each of two generations, none longer than LONG characters: some 100 MB at most.
CACHE_WORDS, LONG = 1 << 18, 64
#: Characters of text after which a slice is closed, and distinct words that a bucket is meant to hold at most.
SLICE_CHARS, BUCKET_WORDS = 1 << 23, 1 << 18
#: The Latin part of STABLE, and its letters, numbers and white space as the tokenizers library has them: most texts have
#: nothing else, and plain character classes are quicker than Unicode properties.
LATIN = r"\x{0}-\x{2AF}\x{2010}-\x{2027}\x{2030}-\x{205E}\x{20A0}-\x{20BF}"
LETTERS, NUMBERS, SPACES = "A-Za-zªµºÀ-ÖØ-öø-\u02af", "0-9²³¹¼-¾", "\t\n\x0b\x0c\r \x85\xa0"


def _py_class(java: str) -> str:
    import re

    return re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", java)


def split_pattern(latin: bool = False) -> str:
    """The pre-tokenizer's pattern over a whole text; the special token is a word of its own and bounds its neighbours.
    The alternatives begin with different characters, so their order is free: frequent ones come first."""
    special = r"<\|endoftext\|>"
    letter, number, space = (LETTERS, NUMBERS, SPACES) if latin else (r"\p{L}", r"\p{N}", r"\s")
    other = rf"(?:(?!{special})[^{space}{letter}{number}])+"
    return rf" ?[{letter}]+| ?[{number}]+|{special}|'(?:[stmd]|ll|ve|re)| ?{other}|[{space}]+(?:(?![^{space}])|(?={special}))|[{space}]+"


@lru_cache(maxsize=4)
def tokenizer(path: str = BYTE_BPE):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


class WordEncoder(dict):
    """text -> ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str = BYTE_BPE):
        import re

        import regex

        super().__init__()
        self.tok, self.old = tokenizer(path), {}
        self.pieces = self.tok.model.tokenize
        self.added = {x["content"]: x["id"] for x in json.loads(self.tok.to_str())["added_tokens"]}
        self.bytes = byte_alphabet()
        self.letters = {b: c for c, b in self.bytes.items()}
        self.between = re.compile("|".join(f"({re.escape(x)})" for x in self.added) or "(?!)").split
        self.find, self.find_latin = regex.compile(split_pattern()).findall, re.compile(split_pattern(latin=True)).findall
        self.beyond_latin, self.odd = (re.compile(f"[^{_py_class(x)}]").search for x in (LATIN, STABLE))

    def __missing__(self, word: str) -> bytes:
        out = self.old.get(word)
        if out is None:
            out = array("I", self.word(word)).tobytes()
        if len(word) > LONG:
            return out
        if len(self) >= CACHE_WORDS:
            self.old = dict(self)
            self.clear()
        self[word] = out
        return out

    def forget(self) -> None:
        """Lets go of all words: workers outlive their tasks, and later stages need the room."""
        self.clear()
        self.old = {}

    def word(self, word: str) -> list[int]:
        """The ids of one word of the pre-tokenizer."""
        if word in self.added:
            return [self.added[word]]
        return [p.id for p in self.pieces(word.encode().decode("latin-1").translate(self.letters))]

    def split(self, text: str) -> list[str]:
        """The words of a text."""
        if text.isascii() or not self.beyond_latin(text):
            return self.find_latin(text)
        if not self.odd(text):
            return self.find(text)
        out = []
        for part in self.between(text):
            if part in self.added:
                out.append(part)
            else:
                out += [bytes(map(self.bytes.__getitem__, w)).decode() for w, _ in self.tok.pre_tokenizer.pre_tokenize_str(part)]
        return out

    def encode(self, text: str) -> bytes:
        if text.isascii() or not self.beyond_latin(text):
            return b"".join(map(self.__getitem__, self.find_latin(text)))
        if self.odd(text):
            return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.__getitem__, self.find(text)))


@lru_cache(maxsize=1)
def byte_alphabet() -> dict[str, int]:
    """Byte-level BPE's characters: printable bytes stand for themselves, the others follow from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


@lru_cache(maxsize=2)
def word_encoder(path: str = BYTE_BPE) -> WordEncoder:
    """One for each Python worker."""
    return WordEncoder(path)


class _Numbered(dict):
    def __missing__(self, key) -> int:
        self[key] = out = len(self)
        return out


def _hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode())


def squeezed(numbers) -> bytes:
    """Unsigned 32-bit integers, bytes of equal significance together, by zstandard."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(np.asarray(numbers, np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes())


def unsqueezed(raw: bytes):
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


def split_slices(docs: DataFrame, path: str = BYTE_BPE) -> DataFrame:
    """slice, doc_ids, sizes, file, n, words: for each slice its documents, how many words each has, the file of places (for
    the words of all documents, one after the other, the number of each), how many distinct words there are, and these, in
    ascending order of their hashes. A written table."""
    folder = scratch(docs.sparkSession, "places")

    def run(batches):
        import pyarrow as pa

        split, kind = word_encoder(path).split, None
        names, sizes, places, words, held = [], [], array("I"), _Numbered(), 0

        def close():
            mine = list(words)
            order = np.argsort(np.fromiter(map(_hash, mine), np.uint64, len(mine)), kind="stable")
            number = np.empty(len(mine), np.uint32)
            number[order] = np.arange(len(mine), dtype=np.uint32)
            file = put_bytes(f"{folder}/{os.getpid()}", [squeezed(number[np.frombuffer(places, np.uint32)])])
            blob = zstandard.ZstdCompressor(level=1).compress(json.dumps([mine[i] for i in order], ensure_ascii=False).encode())
            lists = lambda x, t: pa.array([x], pa.list_(t))
            return pa.RecordBatch.from_arrays([lists(names, kind), lists(sizes, pa.int32()), pa.array([file]), pa.array([len(mine)], pa.int64()), pa.array([blob], pa.binary())], ["doc_ids", "sizes", "file", "n", "words"])

        for batch in batches:
            kind = batch.column(0).type
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                own = split(text)
                names.append(name)
                sizes.append(len(own))
                places.extend(map(words.__getitem__, own))
                held += len(text)
                if held >= SLICE_CHARS:
                    yield close()
                    names, sizes, places, words, held = [], [], array("I"), _Numbered(), 0
        if names:
            yield close()

    kind = docs.schema["doc_id"].dataType.simpleString()
    made = texts(docs).mapInArrow(run, f"doc_ids array<{kind}>, sizes array<int>, file string, n long, words binary")
    return written(made.select(F.monotonically_increasing_id().alias("slice"), "*"), "slices")


def word_ids(slices: DataFrame, path: str = BYTE_BPE) -> DataFrame:
    """slice, bucket, words, sizes, ids: the distinct-word table, a row for each slice and bucket of words (as JSON, by
    zstandard) with how many ids each has, and these. A word has one bucket, and is encoded once for all slices;
    words of any length are. Slices without words have no rows."""
    spark = slices.sparkSession
    n = slices.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // BUCKET_WORDS))

    def cut(batches):
        import pyarrow as pa

        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for name, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = json.loads(zstandard.ZstdDecompressor().decompress(blob))
                bucket = [_hash(w) * buckets >> 64 for w in words]
                edges = [i for i in range(len(words)) if not i or bucket[i] != bucket[i - 1]] + [len(words)]
                held = [pack(json.dumps(words[a:b], ensure_ascii=False).encode()) for a, b in zip(edges, edges[1:])]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(held), pa.int64()), pa.array([bucket[a] for a in edges[:-1]], pa.int32()), pa.array(held, pa.binary())], ["slice", "bucket", "words"])

    def encode(batches):
        import pyarrow as pa

        class Table(dict):
            def __missing__(self, word):
                self[word] = out = array("I", encode_word(word))
                return out

        encode_word, last, known = word_encoder(path).word, None, Table()
        for batch in batches:
            sizes, ids = [], []
            for bucket, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if bucket != last:
                    last, known = bucket, Table()
                own = list(map(known.__getitem__, json.loads(zstandard.ZstdDecompressor().decompress(blob))))
                sizes.append(squeezed([len(x) for x in own]))
                ids.append(squeezed(np.frombuffer(b"".join(own), np.uint32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.binary()), pa.array(ids, pa.binary())], ["slice", "bucket", "words", "sizes", "ids"])

    rows = slices.select("slice", "words").mapInArrow(cut, "slice long, bucket int, words binary")
    dealt = rows.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(encode, "slice long, bucket int, words binary, sizes binary, ids binary")


def encode_decode(docs: DataFrame, path: str = BYTE_BPE) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row.

    Null text counts as empty (no ids, empty decoded text); repeated rows give repeated results; an empty table none; other
    columns are dropped.
    """
    split = split_slices(docs, path)
    ids = word_ids(split, path).select("slice", "bucket", "sizes", "ids")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(one, words):
        import pyarrow as pa

        # The slice's words by number: buckets ascend with the hashes, as the numbers do.
        words = words.sort_by("bucket")
        none = [np.zeros(0, np.uint32)]
        size = np.concatenate(none + list(map(unsqueezed, words.column("sizes").to_pylist()))).astype(np.int64)
        flat = np.concatenate(none + list(map(unsqueezed, words.column("ids").to_pylist())))
        ends = np.concatenate([[0], np.cumsum(size)]).tolist()
        shown, piece = list(map(str, flat.tolist())), _joined(flat, path)
        as_text = [",".join(shown[a:b]) for a, b in zip(ends[:-1], ends[1:])]
        as_bytes = [b"".join(piece[a:b]) for a, b in zip(ends[:-1], ends[1:])]
        doc_ids, counts, texts_, decoded = [], [], [], []
        for sizes, file, own in zip(one.column("sizes").to_pylist(), one.column("file").to_pylist(), one.column("doc_ids").to_pylist()):
            place, at = unsqueezed(bytes(mapped(file))), 0
            doc_ids += own
            for n in sizes:
                mine = place[at : at + n]
                at += n
                counts.append(int(size[mine].sum()))
                mine = mine.tolist()
                texts_.append(hashlib.sha256(",".join(filter(None, map(as_text.__getitem__, mine))).encode()).hexdigest())
                decoded.append(hashlib.sha256(b"".join(map(as_bytes.__getitem__, mine)).decode("utf-8", "replace").encode()).hexdigest())
        return pa.table([pa.array(doc_ids, one.column("doc_ids").type.value_type), pa.array(counts, pa.int64()), pa.array(texts_, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    left = split.select("slice", "doc_ids", "sizes", "file").groupBy("slice")
    return left.cogroup(ids.groupBy("slice")).applyInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _joined(ids, path: str) -> list[bytes]:
    """The pieces of ids, in order: a join of ids to the id-to-piece table, which is as small as the vocabulary."""
    import pyarrow as pa

    places = pa.table({"id": pa.array(ids.astype(np.int32)), "at": pa.array(np.arange(len(ids)))})
    return places.join(pieces(path), "id", join_type="left outer").sort_by("at").column("piece").to_pylist()


@lru_cache(maxsize=2)
def pieces(path: str = BYTE_BPE):
    """The id-to-piece table: id, piece (bytes)."""
    import pyarrow as pa

    whole = json.loads(tokenizer(path).to_str())
    byte = byte_alphabet()
    held = {i: bytes(byte[c] for c in s) if all(c in byte for c in s) else s.encode() for s, i in whole["model"]["vocab"].items()}
    held |= {x["id"]: x["content"].encode() for x in whole["added_tokens"]}
    return pa.table({"id": pa.array(list(held), pa.int32()), "piece": pa.array(list(held.values()), pa.binary())})


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"))
