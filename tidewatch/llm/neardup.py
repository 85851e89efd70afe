"""Problem 7: records that are the same text but for small edits.

T-occurrence search by DivideSkip, without loss for edits of words.  The features of a text of n words are its runs
of two words (characters, for Japanese), or its words where it is short.  A word taken out or put in its place
kills at most two runs, so texts that share ``SHARE`` of the words of the longer one share at least
T = features - 2 (1 - SHARE) n of the features, on either side.  All inverted lists are in one order, the short ones
first.  The T - 1 longest lists of a text are skipped: such texts still meet in one of the others, which are merged.
The order comes from a sample; it changes what the search costs, never what it finds.

Postings travel in blocks, one for each batch of texts and each part of the feature space, with the size and a
parity signature of each text's bag of words, whose differing bits are at most the words not shared.  Signatures are
repeated in every part that a text is posted in: they are as short as texts of that length allow, and where there are
many parts they are posted and merged in rounds, each written before the next one begins.  A list
is merged whole, however long, under size and signature; a list that the sample shows to be long is laid out in
cells, each pair of its blocks in one cell, so that no task gets it all.  What is left of the bags is then probed by
binary search, and a pair is kept where the common words reach T.

Exact copies are one class from the start; classes are paired and their members listed only at the end.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.mojibake import repair
from tidewatch.runtime import cut

#: Least share of the words of the longer text that both texts have, between "about five sixths" and "three quarters".
SHARE = 0.79
#: Texts of up to SHORT[1] words have their words as features, texts from SHORT[0] (at most SHARE of it) words runs of two.
SHORT = (19, 24)
#: Texts the order of features is taken from, at most, and the counters it is kept in.
SAMPLE, COUNTERS = 10_000, 1 << 18
#: Words of 64 bits of a signature, those of texts of up to so many words, and parts that a text is posted in at once, about.
SIGN, SHORTER, AT_ONCE = 8, ((80, 2), (140, 4)), 24
#: Lists of up to so many texts are merged many at a time; lists of more than CELL texts are laid out in cells.
MANY, CELL = 24, 20_000
#: Postings that one task merges, about.
TASK = 2_000_000
_WORD = re.compile("[぀-ヿ㐀-鿿]|[^\\W_぀-ヿ㐀-鿿]+(?:[.,]\\d+)?")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(title: str | None, summary: str | None) -> list[str]:
    return _WORD.findall(f"{repair(title) or ''} {repair(summary) or ''}".lower())


class Codes(dict):
    """Codes of the words between two blanks, remembered within bounds."""

    def __missing__(self, raw: str) -> tuple[int, ...]:
        out = tuple(zlib.crc32(w.encode()) for w in _WORD.findall(raw.lower()))
        if len(raw) <= 24:
            if len(self) > 300_000:
                self.clear()
            self[raw] = out
        return out

    def of(self, title: str | None, summary: str | None) -> bytes:
        text = f"{repair(title) or ''} {repair(summary) or ''}"
        return np.fromiter(chain.from_iterable(map(self.__getitem__, text.split())), np.uint32).tobytes()


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def _runs(codes: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``width`` words within one text, and the texts they belong to."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.full(n, width, np.uint64)
    for i in range(width):
        h = (h ^ codes[i : n + i]) * _MIX
        h ^= h >> np.uint64(29)
    inside = doc[:n] == doc[width - 1 :]
    return (h[inside] >> np.uint64(32)).astype(np.int64), doc[:n][inside]


def _features(bags: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sizes, codes of all words and their texts; then text and kind (2 text + kind) and hash of each feature, each once and sorted."""
    size = np.array([len(b) // 4 for b in bags], np.int64)
    flat = np.frombuffer(b"".join(bags), np.uint32).astype(np.uint64)
    doc = np.repeat(np.arange(len(bags)), size)
    h1, d1 = _runs(flat, doc, 1)
    h2, d2 = _runs(flat, doc, 2)
    keep1, keep2 = size[d1] <= SHORT[1], size[d2] >= SHORT[0]
    x = _distinct(np.concatenate([(d1[keep1] * 2) << 32 | h1[keep1], (d2[keep2] * 2 + 1) << 32 | h2[keep2]]))
    return size, flat, doc, x >> 32, x & 0xFFFFFFFF


def signatures(flat: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Parity of the words of each text that fall on each of the bits."""
    bits = 64 * SIGN
    at = doc * bits + ((flat * _MIX) >> np.uint64(40)).astype(np.int64) % bits
    return np.packbits((np.bincount(at, minlength=n * bits) & 1).astype(np.uint8).reshape(n, bits), axis=1).view(np.uint64).reshape(n, SIGN)


def widths(size: np.ndarray) -> np.ndarray:
    """Words of the signatures of texts of these sizes."""
    return np.select([size <= most for most, _ in SHORTER], [width for _, width in SHORTER], SIGN)


def _folded(s: np.ndarray, width: int) -> np.ndarray:
    """Signatures of ``width`` words: parities of the bits that fall on one another, which differ in no more places."""
    return np.bitwise_xor.reduce(s.reshape(len(s), s.shape[1] // width, width), 1)


def _pack_signs(sig: np.ndarray, size: np.ndarray) -> bytes:
    """Each signature folded to the words of its size, one size after the other."""
    width = widths(size)
    return b"".join(_folded(sig[width == w], w).tobytes() for w in sorted({w for _, w in SHORTER} | {SIGN}))


def _unpack_signs(b: bytes, size: np.ndarray) -> np.ndarray:
    """Signatures of SIGN words, the shorter ones filled up with zeros."""
    out, width, at = np.zeros((len(size), SIGN), np.uint64), widths(size), 0
    flat = np.frombuffer(b, np.uint64)
    for w in sorted({w for _, w in SHORTER} | {SIGN}):
        rows = np.flatnonzero(width == w)
        out[rows, :w] = flat[at : at + len(rows) * w].reshape(len(rows), w)
        at += len(rows) * w
    return out


def _pack(x: np.ndarray) -> bytes:
    """Bytes of whole numbers, lowest bytes first and together, so that they compress."""
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes(), codec="zstd", asbytes=True)


def _unpack(b: bytes, n: int, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    raw = pa.decompress(b, n * width, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).view(kind).reshape(n)


def blocks(ids: np.ndarray, bags: list[bytes], counts: np.ndarray, scale: float, parts: int, turn: range | None = None) -> Iterator[tuple]:
    """(part, postings, texts, columns ...) of a batch of texts: what each part of the feature space, or of a turn of them, gets of it."""
    size, flat, doc, dk, h = _features(bags)
    sig = signatures(flat, doc, len(bags))
    often = counts[h % COUNTERS]
    order = np.lexsort((h, often, dk))
    dk, h, often = dk[order], h[order], often[order]
    width = 1 + (dk & 1)
    posted = np.arange(len(dk)) - np.searchsorted(dk, dk) <= np.floor(width * (1 - SHARE) * size[dk >> 1] + 1e-9)
    d, h, often = dk[posted] >> 1, h[posted], often[posted]
    # a long list of s blocks: a text of block i goes to the cells (i, j) for all j; side 0 where both are one block
    s = np.maximum(1, np.ceil(often * scale / CELL).astype(np.int64))
    block = ((ids[d].astype(np.uint64) * _MIX) >> np.uint64(33)).astype(np.int64) % s
    again = np.repeat(np.arange(len(d)), s)
    j = np.arange(len(again)) - np.repeat(np.cumsum(s) - s, s)
    d, h, s, block = d[again], h[again], s[again], block[again]
    side = np.where(j == block, 0, np.where(block < j, 1, 2)).astype(np.uint8)
    cell = np.minimum(j, block) * s + np.maximum(j, block)
    mixed = ((h.astype(np.uint64) << np.uint64(20) ^ cell.astype(np.uint64)) * _MIX >> np.uint64(32)).astype(np.int64)
    f = np.where(s > 1, mixed, h)
    part = f * parts >> 32
    if turn is not None:
        now = (part >= turn.start) & (part < turn.stop)
        f, d, side, part = f[now], d[now], side[now], part[now]
    order = np.argsort(f, kind="stable")
    f, d, side, part = f[order], d[order], side[order], part[order]
    edge = np.searchsorted(part, np.arange(parts + 1))
    for p in np.flatnonzero(edge[1:] > edge[:-1]).tolist():
        a, b = edge[p], edge[p + 1]
        texts = _distinct(d[a:b])
        step = np.diff(f[a:b], prepend=0).astype(np.uint32)
        yield p, int(b - a), len(texts), _pack(step), _pack(np.searchsorted(texts, d[a:b]).astype(np.uint32)), _pack(side[a:b]), _pack(ids[texts]), _pack(size[texts].astype(np.uint32)), _pack_signs(sig[texts], size[texts])


_BLOCK = "part int, postings int, texts int, f binary, text binary, side binary, id binary, n binary, sig binary"


def merge(f: np.ndarray, at: np.ndarray, size: np.ndarray, sig: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (i, j) of one list whose texts may be alike; rows are in order of list and size, ``at`` has their texts."""
    # folded to 128 bits, parities still differ in no more bits than words
    fold = _folded(sig, 2)
    n, one, two, width = size[at], fold[at, 0], fold[at, 1], widths(size)

    def alike(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs whose signatures allow SHARE of common words; texts of rows j are no shorter."""
        most = n[i] + (1 - 2 * SHARE) * n[j] + 1e-6
        apart = np.bitwise_count(one[i] ^ one[j]) + np.bitwise_count(two[i] ^ two[j])
        ok = (apart <= most) & (n[i] + 1e-6 >= SHARE * n[j]) & ((side[i] == 0) | (side[i] != side[j]))
        i, j, most = i[ok], j[ok], most[ok]
        x, y = at[i], at[j]
        differ, short = sig[x] ^ sig[y], width[x]
        apart = np.bitwise_count(differ).sum(1, dtype=np.int64)
        for _, w in SHORTER:  # the signature of the longer text is folded to the width of the other
            mixed = np.flatnonzero((short == w) & (width[y] > w))
            apart[mixed] = np.bitwise_count(_folded(differ[mixed], w)).sum(1, dtype=np.int64)
        return i[apart <= most], j[apart <= most]

    if not len(f):
        return
    start = np.flatnonzero(np.concatenate([[True], f[1:] != f[:-1]]))
    end = np.append(start[1:], len(f)).astype(np.int64)
    length = end - start
    last = np.repeat(end, length)
    i = np.flatnonzero(np.repeat(length <= MANY, length))
    d = 1
    while len(i := i[i + d < last[i]]):
        yield alike(i, i + d)
        d += 1
    bound = np.minimum((2 - 2 * SHARE) * n + 1e-6, 255).astype(np.uint8)
    for a, b in zip(start[length > MANY].tolist(), end[length > MANY].tolist()):
        for x in range(a, b, 128):
            y = min(x + 128, b)
            # rows of one list up to the size that the longest of the block allows
            z = x + int(np.searchsorted(n[x:b], n[y - 1] / SHARE + 1e-6, "right"))
            apart = np.bitwise_count(one[x:y, None] ^ one[None, x:z]) + np.bitwise_count(two[x:y, None] ^ two[None, x:z])
            near = np.flatnonzero(apart <= bound[x:y, None])
            p, q = near // (z - x) + x, near % (z - x) + x
            later = p < q
            yield alike(p[later], q[later])


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates (a, b) of a part of the feature space, each once."""
    rows = [r for b in batches for r in b.to_pylist()]
    texts = np.array([r["texts"] for r in rows], np.int64)
    first = np.cumsum(texts) - texts
    col = lambda name, count, kind: [_unpack(r[name], r[count], kind) for r in rows]
    put = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    f = put([np.cumsum(x.astype(np.int64)) for x in col("f", "postings", np.uint32)], np.int64)
    at = put([x.astype(np.int64) + o for x, o in zip(col("text", "postings", np.uint32), first)], np.int64)
    side = put(col("side", "postings", np.uint8), np.uint8)
    ids, n = put(col("id", "texts", np.int64), np.int64), put(col("n", "texts", np.uint32), np.uint32).astype(np.int64)
    ends = np.cumsum(texts)
    sig = np.concatenate([np.zeros((0, SIGN), np.uint64), *(_unpack_signs(r["sig"], n[e - t : e]) for r, e, t in zip(rows, ends.tolist(), texts.tolist()))])
    del rows
    order = np.lexsort((n[at], f))
    f, at, side = f[order], at[order], side[order]
    held, new, fresh = np.zeros(0, np.int64), [], 0
    for i, j in merge(f, at, n, sig, side):
        x, y = at[i], at[j]
        new.append(np.minimum(x, y) << 32 | np.maximum(x, y))
        fresh += len(i)
        if fresh > 4_000_000:
            held, new, fresh = _distinct(np.concatenate([held, *new])), [], 0
    held = _distinct(np.concatenate([held, *new]))
    for k in range(0, len(held), 500_000):
        x, y = ids[held[k : k + 500_000] >> 32], ids[held[k : k + 500_000] & 0xFFFFFFFF]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])


def _numbered(bags: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(pair, code and number of it) of every word, in order."""
    size = [len(b) // 4 for b in bags]
    pair = np.repeat(np.arange(len(bags)), size)
    x = np.sort(pair << 32 | np.frombuffer(b"".join(bags), np.uint32))
    return x, np.arange(len(x)) - np.searchsorted(x, x)


def same_text(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Whether the bags of each pair have SHARE of the larger one in common: words of one are probed in the other."""
    most = np.maximum([len(x) // 4 for x in a], [len(x) // 4 for x in b])
    (x, i), (y, j) = _numbered(a), _numbered(b)
    if not len(y):
        return most == 0
    place = np.searchsorted(y, x) + i  # the i-th copy of a word meets the i-th of the other bag
    hit = place < len(y)
    hit[hit] = y[place[hit]] == x[hit]
    return np.bincount(x[hit] >> 32, minlength=len(a)) >= SHARE * most - 1e-9


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            keep = same_text(b.column(2).to_pylist(), b.column(3).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep))


def _id(df: DataFrame, key: str) -> Column:
    """The key as a whole number: itself, or its hash."""
    return F.col(key).cast("bigint") if df.schema[key].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint") else F.xxhash64(key)


def class_pairs(df: DataFrame, key: str, title: str, summary: str) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of class representatives whose texts are the same but for small edits, and members (rep, k).

    Members are listed for classes of more than one row, the representative (the least key) included.  Null titles
    count as empty; rows with a null key or a null, empty or blank summary take no part.  Repeated rows are members of one
    class.  Columns other than the named ones are ignored, whatever their names.
    """
    spark = df.sparkSession
    rows = df.filter((F.length(F.trim(summary)) > 0) & F.col(key).isNotNull()).select(_id(df, key).alias("k"), F.coalesce(F.col(title), F.lit("")).alias("t"), F.col(summary).alias("s"))
    hashes = rows.select("k", F.xxhash64("t", "s").alias("h"), F.hash("s", "t").alias("h2"), F.length("s").alias("len"))
    text = ["h", "h2", "len"]
    copied = hashes.groupBy(*text).agg(F.min("k").alias("rep"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    members = cut(hashes.join(copied, text).select("rep", "k").distinct())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        for b in batches:
            bags = [codes.of(t, s) for t, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bags, pa.binary())], ["k", "bag"])

    bags = cut(rows.join(members.filter("rep <> k").select("k"), "k", "left_anti").mapInArrow(encode, "k bigint, bag binary"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, texts, words, postings = np.zeros(COUNTERS, np.int64), 0, 0, 0
        for b in batches:
            size, _, _, dk, h = _features(b.column(1).to_pylist())
            total += np.bincount(h % COUNTERS, minlength=COUNTERS)
            texts, words, postings = texts + len(size), words + int(size.sum()), postings + len(h)
        yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.int32).tobytes()], pa.binary()), pa.array([texts]), pa.array([words]), pa.array([postings])], ["c", "texts", "words", "postings"])

    sample = bags.limit(SAMPLE).mapInArrow(count, "c binary, texts bigint, words bigint, postings bigint").collect()
    order = sum((np.frombuffer(r["c"], np.int32) for r in sample), np.zeros(COUNTERS, np.int32))
    texts = max(1, sum(r["texts"] for r in sample))
    scale = bags.count() / texts
    parts = max(spark.sparkContext.defaultParallelism, math.ceil(scale * sum(r["postings"] for r in sample) / 2 / TASK))
    posted = 2 * (1 - SHARE) * sum(r["words"] for r in sample) / texts
    rounds = math.ceil(parts * (1 - (1 - 1 / parts) ** posted) / AT_ONCE)

    def merged(turn: range) -> DataFrame:
        def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    out = list(zip(*blocks(b.column(0).to_numpy(), b.column(1).to_pylist(), order, scale, parts, turn)))
                    if out:
                        out[0] = [p - turn.start for p in out[0]]
                        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in out[:3]), *(pa.array(c, pa.binary()) for c in out[3:])], [c.split()[0] for c in _BLOCK.split(", ")])

        lists = bags.mapInArrow(post, _BLOCK).repartitionById(len(turn), F.col("part"))
        return cut(lists.mapInArrow(_join, "a bigint, b bigint").distinct())

    # written, so that the lists are gone when those of the next parts are made and the texts brought to the candidates
    edge = [parts * r // max(1, rounds) for r in range(max(1, rounds) + 1)]
    candidates = merged(range(edge[0], edge[1]))
    for a, b in zip(edge[1:], edge[2:]):
        candidates = candidates.unionAll(merged(range(a, b)))
    if rounds > 1:
        candidates = candidates.distinct()
    near = candidates.join(bags.toDF("a", "bag_a"), "a").join(bags.toDF("b", "bag_b"), "b").select("a", "b", "bag_a", "bag_b")
    return near.mapInArrow(_verify, "a bigint, b bigint"), members


def pairs(df: DataFrame, key: str, title: str, summary: str) -> DataFrame:
    """(key_a, key_b): all pairs of rows, smaller key first, copies of one text included."""
    near, members = class_pairs(df, key, title, summary)
    across = near.join(members.toDF("a", "ka"), "a", "left").join(members.toDF("b", "kb"), "b", "left").select(F.coalesce("ka", "a").alias("x"), F.coalesce("kb", "b").alias("y"))
    within = members.toDF("rep", "x").join(members.toDF("rep", "y"), "rep").filter("x < y").select("x", "y")
    both = across.unionAll(within).select(F.least("x", "y").alias(f"{key}_a"), F.greatest("x", "y").alias(f"{key}_b"))
    if df.schema[key].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint"):
        return both
    names = df.select(F.xxhash64(key).alias("id"), F.col(key).alias("name")).distinct()
    named = both.toDF("x", "y").join(names.toDF("x", "nx"), "x").join(names.toDF("y", "ny"), "y")
    return named.select(F.least("nx", "ny").alias(f"{key}_a"), F.greatest("nx", "ny").alias(f"{key}_b"))


def found(article: DataFrame) -> DataFrame:
    return pairs(article, "pos", "title", "summary").distinct()
