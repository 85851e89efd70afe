"""Pairs of short texts whose TF-IDF vectors are alike, without loss.

Texts of one vector are a class from the start; classes are paired, members listed only where they are asked for.
The terms of a text are in one order, the rarest first.  If two vectors reach the threshold t and i, j are the first
two terms that both have, then w_i² + (squared weights from j on) >= t² holds in either: so a text is posted under
the pairs of its terms that can be the first two in common, and under a single term of weight t.  Vectors travel
with the postings, so a candidate is scored where it is met, and counted under its own first two terms alone.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.operators.graph import forest
from tidewatch.runtime import cut

#: Lists of up to so many texts are paired many at a time; pairs that are scored at once; no second term in common.
MANY, CHUNK, NONE = 64, 200_000, 0xFFFFFFFF


def classes(df: DataFrame, key: str, body: Column, max_features: int, pattern: str = r"[\p{L}\p{N}_]{2,}") -> tuple[DataFrame, np.ndarray]:
    """(k, rep, n, v) of the texts that have a term, and the terms' idf, the rarest term first.

    ``rep`` is the least key of the texts with the vector ``v`` (term and frequency, in order), ``n`` numbers them.
    The most frequent terms, ``max_features`` at most, are collected.
    """
    docs = df.select(F.col(key).alias("k"), F.regexp_extract_all(F.lower(body), F.lit(pattern), F.lit(0)).alias("t"))
    freq = docs.select("t", F.posexplode("t").alias("at", "term")).groupBy("term").agg(F.count(F.lit(1)).alias("cf"), F.count_if(F.array_position("t", F.col("term")) == F.col("at") + 1).alias("df"))
    top = sorted(freq.orderBy(F.desc("cf"), "term").limit(max_features).collect(), key=lambda r: (r["df"], r["term"]))
    idf = np.log((1 + docs.count()) / (1 + np.array([r["df"] for r in top], float))) + 1
    ids = {r["term"]: i for i, r in enumerate(top)}

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for words in b.column(1).to_pylist():
                tf: dict[int, int] = {}
                for w in words or ():
                    if (i := ids.get(w)) is not None:
                        tf[i] = tf.get(i, 0) + 1
                out.append(array("I", chain.from_iterable(sorted(tf.items()))).tobytes() if tf else None)
            v = pa.array(out, pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), v], ["k", "v"]).filter(v.is_valid())

    kind = df.schema[key].dataType.simpleString()
    w = W.partitionBy("v").orderBy("k")
    rows = docs.mapInArrow(vectors, f"k {kind}, v binary").select("k", F.first("k").over(w).alias("rep"), F.row_number().over(w).alias("n"), "v")
    return cut(rows.withColumn("v", F.when(F.col("n") == 1, F.col("v")))), idf


def _flat(v: list[bytes], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each vector, and the terms and weights of all."""
    end = np.cumsum([len(x) // 8 for x in v], dtype=np.int64)
    flat = np.frombuffer(b"".join(v), np.uint32).reshape(-1, 2)
    start = np.concatenate([[0], end[:-1]]).astype(np.int64)
    w = (1 + np.log(flat[:, 1])) * idf[flat[:, 0]]
    norm = np.sqrt(np.add.reduceat(w * w, start)) if len(w) else w
    return start, end, flat[:, 0].astype(np.int64), w / np.repeat(norm, end - start)


def first_terms(terms: list[int], squares: list[float], least: float) -> Iterator[int]:
    """The pairs of terms, as one number each, that can be the first two that another vector has too."""
    tail = [0.0]
    for s in reversed(squares):
        tail.append(tail[-1] + s)
    tail.reverse()
    least -= 1e-9
    for i, s in enumerate(squares):
        if tail[i] < least:
            break
        if s >= least:
            yield terms[i] << 32 | NONE
        for j in range(i + 1, len(terms)):
            if s + tail[j] < least:
                break
            yield terms[i] << 32 | terms[j]


def meetings(key: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (i, j) of one key, each pair once; rows are in order of key."""
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(start, len(key)))
    last = np.repeat(start + size, size)
    i, d = np.flatnonzero(np.repeat(size <= MANY, size)), 1
    while len(i := i[i + d < last[i]]):
        for k in range(0, len(i), CHUNK):
            yield i[k : k + CHUNK], i[k : k + CHUNK] + d
        d += 1
    for a, n in zip(start[size > MANY].tolist(), size[size > MANY].tolist()):
        for x in range(a, a + n - 1):
            for y in range(x + 1, a + n, CHUNK):
                j = np.arange(y, min(y + CHUNK, a + n))
                yield np.full(len(j), x), j


def gathered(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same pairs, about CHUNK at a time."""
    held, n = [], 0
    for p in parts:
        held.append(p)
        n += len(p[0])
        if n >= CHUNK:
            yield tuple(map(np.concatenate, zip(*held)))
            held, n = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


def scored(key: np.ndarray, v: list[bytes], idf: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, cosine) of the rows of one key that reach ``least`` and have the key's terms first in common."""
    start, end, term, weight = _flat(v, idf)
    size = end - start

    def entries(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pair = np.repeat(np.arange(len(rows)), size[rows])
        at = np.arange(len(pair)) - np.repeat(np.cumsum(size[rows]) - size[rows], size[rows]) + start[rows][pair]
        return pair << 32 | term[at], weight[at]

    for i, j in gathered(meetings(key)):
        (x, wx), (y, wy) = entries(i), entries(j)
        place = np.minimum(np.searchsorted(y, x), len(y) - 1)
        hit = np.flatnonzero(y[place] == x)
        pair = x[hit] >> 32
        cosine = np.bincount(pair, wx[hit] * wy[place[hit]], len(i))
        one = np.searchsorted(pair, np.arange(len(i)))
        common = np.append(x[hit] & 0xFFFFFFFF, [NONE, NONE])
        second = np.where(np.append(pair, [-1, -1])[one + 1] == np.arange(len(i)), common[one + 1], NONE)
        ok = (cosine >= least) & ((common[one] << 32 | second) == key[i])
        yield i[ok], j[ok], cosine[ok]


def near(rows: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """(a, b, cosine): representatives of ``classes`` whose cosine reaches the threshold, the smaller first."""
    return _met(rows, idf, threshold, lambda found: found, "cosine double")


def links(rows: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """(a, b): pairs that join the same representatives as ``near``.

    Pairs grow with the square of a family of texts; so each task passes on a forest of those it finds, fewer than its texts.
    """
    if rows.schema["k"].dataType.simpleString() not in ("int", "bigint"):
        return near(rows, idf, threshold).select("a", "b")

    def joined(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b in forest((p.column(0).to_numpy(), p.column(1).to_numpy()) for p in found):
            for k in range(0, len(a), CHUNK):
                yield pa.RecordBatch.from_arrays([pa.array(a[k : k + CHUNK]), pa.array(b[k : k + CHUNK])], ["a", "b"])

    return _met(rows, idf, threshold, joined)


def _met(rows: DataFrame, idf: np.ndarray, threshold: float, then: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], *more: str) -> DataFrame:
    """What ``then`` makes, in each task, of the batches (a, b, cosine) that the task finds."""
    kind = rows.schema["k"].dataType.simpleString()

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            start, end, term, weight = _flat(b.column(1).to_pylist(), idf)
            terms, squares = term.tolist(), (weight * weight).tolist()
            keys, row = [], []
            for r, (x, y) in enumerate(zip(start.tolist(), end.tolist())):
                mine = list(first_terms(terms[x:y], squares[x:y], threshold * threshold))
                keys += mine
                row += [r] * len(mine)
            at = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), b.column(0).take(at), b.column(1).take(at)], ["key", "k", "v"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Lists come one after the other; the last of a batch waits for the next one."""
        held: list[pa.RecordBatch] = []
        for b in chain(batches, [None]):
            if b is not None:
                if not b.num_rows:
                    continue
                held.append(b)
                if b.column(0)[b.num_rows - 1] == held[0].column(0)[0]:
                    continue
            if not held:
                return
            table = pa.Table.from_batches(held).combine_chunks()
            key = table.column(0).to_numpy()
            whole = len(key) if b is None else int(np.searchsorted(key, key[-1]))
            held = table.slice(whole).to_batches()
            same = np.zeros(whole + 1, bool)
            same[1:-1] = key[1:whole] == key[: whole - 1] if whole else False
            met = np.flatnonzero(same[1:] | same[:-1])  # rows that aren't alone
            if not len(met):
                continue
            part = table.take(pa.array(met))
            k = part.column(1).to_numpy() if kind != "string" else np.array(part.column(1).to_pylist(), object)
            for i, j, cosine in scored(key[met], part.column(2).to_pylist(), idf, threshold):
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(k[i], k[j])), pa.array(np.maximum(k[i], k[j])), pa.array(cosine)], ["a", "b", "cosine"])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists = rows.filter("v is not null").select("k", "v").mapInArrow(post, f"key bigint, k {kind}, v binary")
    return lists.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(lambda batches: then(join(batches)), ", ".join([f"a {kind}", f"b {kind}", *more]))
