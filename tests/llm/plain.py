"""Plain second versions of operators, one text at a time, for tests to hold results against."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import regex
import xxhash
import zstandard

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def spark_hash(seed, text):
    """xxhash64(seed, text) as Spark computes it: each value's hash seeds the next."""
    return signed(xxhash.xxh64_intdigest(text.encode(), xxhash.xxh64_intdigest(seed.to_bytes(4, "little"), 42)))


def dictionaries(rows):
    """rows: (text, lang). In each of 32 buckets by hash the 4 texts of least hash; 128 KB a language, of whole texts unless
    the first alone is longer and nothing else fits."""
    buckets = defaultdict(set)
    for text, lang in rows:
        if lang is not None and text is not None and regex.search(r"\p{L}", text):
            h = spark_hash(0, text)
            buckets[lang, h % 32].add((h, text))
    out = {}
    for lang in sorted({k for k, _ in buckets}):
        taken, size = [], 0
        drawn = sorted(x for (k, _), held in buckets.items() if k == lang for x in sorted(held)[:4])
        for _, text in drawn:
            if size + len(text.encode()) + 1 <= 131072:
                taken.append(text.lower().encode())
                size += len(text.encode()) + 1
        out[lang] = b"\n".join(taken or [drawn[0][1][:131072].lower().encode()])
    return out


def language(text, books):
    """(language, score, rejected)."""
    if not books or text is None or not regex.search(r"\p{L}", text):
        return "und", 0.0, True
    from loam.llm.langid import SEARCH

    params = zstandard.ZstdCompressionParameters(**SEARCH, write_content_size=False, write_checksum=False, write_dict_id=False)

    def size(raw, book):
        given = {"dict_data": zstandard.ZstdCompressionDict(book, dict_type=zstandard.DICT_TYPE_RAWCONTENT)} if book else {}
        if given:
            given["dict_data"].precompute_compress(compression_params=params)
        return sum(len(zstandard.ZstdCompressor(compression_params=params, **given).compress(raw[i : i + 4096])) for i in range(0, len(raw), 4096))

    raw = text.lower().encode()
    sizes = {lang: size(raw, book) for lang, book in books.items()}
    best = min(sizes.values())
    cost = {lang: float(n) for lang, n in sizes.items()}
    tied = [lang for lang in sizes if sizes[lang] == best]
    if len(tied) > 1:
        words = b" " + b" ".join(dict.fromkeys(raw.split())) + b" "
        cost = {}
        for lang in tied:
            book = b" " + b" ".join(books[lang].split()) + b" "
            grams = Counter(book[i : i + 3] for i in range(len(book) - 2))
            whole = math.log2(sum(grams.values()) + 1)
            cost[lang] = sum(whole - math.log2(grams[g] + 0.5) if g in grams else whole + 1 for g in (words[i : i + 3] for i in range(len(words) - 2)))
    order = sorted(cost, key=lambda lang: (cost[lang], lang))
    score = 1.0 if len(order) == 1 else 1 - cost[order[0]] / cost[order[1]]
    bad = score < 0.002
    if bad or best > 0.99 * size(raw, None):
        letters = regex.sub(r"[^\p{L}\p{M}]+", " ", text.lower()).encode()
        different = b" " + b" ".join(dict.fromkeys(letters.split())) + b" "
        bad = (bad or size(letters, books[order[0]]) > 0.99 * size(letters, None)) and len(different) >= 200
    return order[0], score, bad


def without_lines(texts, least=10):
    """Texts without the lines whose key is in `least` or more of them."""
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOW)
    df = Counter(k for t in texts for k in {key(x) for x in t.split("\n")} if k)
    return ["\n".join(x for x in t.split("\n") if df[key(x)] < least) for t in texts]


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def groups(texts):
    """For each text the number of its group's first text."""
    sets = list(map(shingle_set, texts))
    holders, comp = defaultdict(list), list(range(len(texts)))
    for i, s in enumerate(sets):
        shared = Counter(j for x in s for j in holders[x])
        for j, both in shared.items():
            if 100 * both >= 75 * (len(s) + len(sets[j]) - both) and comp[i] != comp[j]:
                a, b = sorted((comp[i], comp[j]))
                comp = [a if c == b else c for c in comp]
        for x in s:
            holders[x].append(i)
    return comp


def lanes(text):
    """(8 dense lanes, sparse lanes by number) of a text: the sum of its pieces' vectors."""
    dense, sparse = [0] * 8, Counter()
    for piece in re.split(r" (?<=[.!?] )|(?<=\n)", text):
        if not piece:
            continue
        for i in range(4):
            x = spark_hash(i + 1, piece) & (1 << 64) - 1
            dense[2 * i] += x & 0xFFFFFFFF
            dense[2 * i + 1] += x >> 32
        h = xxhash.xxh64_intdigest(piece.encode(), 42)
        low = h & 0xFFFFFFFF | 1 << 31
        level = (low & -low).bit_length() - 1
        sparse[level * 32 + (h >> 48 & 31)] += h >> 32 & 0xFFFF
    return [x % 2**32 for x in dense], {k: v % 256 for k, v in sparse.items() if v % 256}


def fingerprint(dense, sparse):
    return "".join(f"{x:08x}" for x in dense) + "." + "".join(f"{k * 256 + v:05x}" for k, v in sorted(sparse.items()))


def likeness(a, b):
    """Equal lanes among those in use, from the first level on of which both texts use few."""
    if a == b:
        return 1.0
    few = lambda s: next((j for j in range(31) if sum(k // 32 == j for k in s) <= 20), 31)
    least = max(few(a[1]), few(b[1])) * 32
    x, y = ({(k, v) for k, v in s.items() if k >= least} for s in (a[1], b[1]))
    return len(x & y) / max(len(x | y), 1)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
