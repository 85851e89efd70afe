"""Problem 9: evaluation passages inside training text.

The test items form a BM25 inverted index whose posting lists are cut into blocks with the greatest weight
of each.  Every passage of every document is a query.  Weights are divided by the least score that a leak
of the item can have, so that one threshold, 1, serves all items.  Passages whose upper bounds stay below
it are skipped in bulk; the rest runs block-max WAND, and what it retrieves is verified by alignment.

The index holds the test items only.  It is built for blocks of ``ITEM_BLOCK`` items; one scan of the documents
takes ``SCAN_BLOCKS`` of them, so what is shipped has a fixed bound however many items there are.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN = 20
ONE_IN = 12
PASSAGE = 44
STRIDE = 22
BLOCK = 16
ITEM_BLOCK = 5000
SCAN_BLOCKS = 10
K1, B = 1.2, 0.75
_WORD = re.compile(r"[^\W_]+")


def tokens(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


class Index:
    """BM25 inverted index of test items with block maxima.  Its terms are runs of three words of an item."""

    def __init__(self, items: list[tuple[int, str | None]]):
        seen = [(i, tokens(t)) for i, t in items]
        seen = [(i, w) for i, w in seen if len(w) >= RUN]
        self.ids = [i for i, _ in seen]
        self.words = [w for _, w in seen]
        self.vocab = {t: k for k, t in enumerate(dict.fromkeys(t for w in self.words for t in w))}
        terms = [self.terms(np.array([self.vocab[t] for t in w], np.int64)).tolist() for w in self.words]
        df = Counter(t for w in terms for t in set(w))
        n, mean = len(seen), (sum(map(len, terms)) / len(seen)) if seen else 1.0
        idf = {t: math.log(1 + (n - d + 0.5) / (d + 0.5)) for t, d in df.items()}
        lists: dict[int, list[tuple[int, float]]] = defaultdict(list)
        for at, w in enumerate(terms):
            norm = K1 * (1 - B + B * len(w) / mean)
            weight = {t: idf[t] * c * (K1 + 1) / (c + norm) for t, c in Counter(w).items()}
            least = self._least(w, weight)
            for t, x in weight.items():
                lists[t].append((at, x / least))
        self.lists = dict(lists)
        self.blocks = {t: [max(x for _, x in p[k : k + BLOCK]) for k in range(0, len(p), BLOCK)] for t, p in lists.items()}
        self.keys = np.array(sorted(lists), np.int64)
        self.top = np.array([max(self.blocks[t]) for t in self.keys.tolist()])
        self.top_of = dict(zip(self.keys.tolist(), self.top.tolist()))

    def terms(self, ids: np.ndarray) -> np.ndarray:
        """Codes of the runs of three words; -1 where a word is in no item."""
        v = len(self.vocab) + 1
        a, b, c = ids[:-2], ids[1:-1], ids[2:]
        return np.where((a < 0) | (b < 0) | (c < 0), -1, (a * v + b) * v + c)

    @staticmethod
    def _least(terms: list[int], weight: dict[int, float]) -> float:
        """Least score of a run of the item that counts as a leak: one changed word spoils at most three terms."""
        width, spoilt, least = RUN - 2, 3 * (RUN // ONE_IN), math.inf
        for k in range(len(terms) - width + 1):
            run = sorted((weight[t] for t in set(terms[k : k + width])), reverse=True)
            least = min(least, sum(run[spoilt:]))
        return max(least, 1e-9)

    def search(self, terms: list[int]) -> list[int]:
        """Positions of the items whose score reaches 1, by block-max WAND."""
        cursors = [[self.lists[t][0][0], t, 0] for t in terms]
        out = []
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, None
            for k, (at, t, _) in enumerate(cursors):
                bound += self.top_of[t]
                if bound >= 1:
                    pivot = at
                    break
            if pivot is None:
                return out
            while k + 1 < len(cursors) and cursors[k + 1][0] == pivot:
                k += 1
            if cursors[0][0] == pivot:
                held, aim = cursors[: k + 1], pivot + 1
                if sum(self.blocks[t][p // BLOCK] for _, t, p in held) >= 1:
                    if sum(self.lists[t][p][1] for _, t, p in held) >= 1:
                        out.append(pivot)
                else:  # these blocks can't reach 1: on to the first item behind one of them, or that another list has
                    ends = [self.lists[t][min(len(self.lists[t]), (p // BLOCK + 1) * BLOCK) - 1][0] + 1 for _, t, p in held]
                    aim = max(aim, min([*ends, *(at for at, _, _ in cursors[k + 1 : k + 2])]))
            else:
                held, aim = [c for c in cursors[: k + 1] if c[0] < pivot], pivot
            for c in held:
                posting = self.lists[c[1]]
                p = bisect_left(posting, (aim,), c[2])
                c[0], c[2] = (posting[p][0], p) if p < len(posting) else (-1, -1)
            cursors = [c for c in cursors if c[0] >= 0]
        return out


def holds(text: list[str], item: list[str]) -> bool:
    """Whether ``text`` has at least RUN words in a row of ``item`` with at most one in ONE_IN changed or added."""
    n, m, gap = len(item), len(text), 3
    at = np.arange(m + 1)
    code = {w: k for k, w in enumerate(set(item))}
    a = np.array([code[w] for w in item])
    b = np.array([code.get(w, -1) for w in text])
    rows = [np.zeros(m + 1, np.int64)]
    for i in range(n):
        up = rows[-1]
        best = np.maximum(up - gap, 0)
        best[1:] = np.maximum(best[1:], up[:-1] + np.where(b == a[i], 1, -gap))
        rows.append(np.maximum.accumulate(best + gap * at) - gap * at)
    grid = np.array(rows)
    blocked = grid.copy()
    while True:
        i, j = divmod(int(blocked.argmax()), m + 1)
        if blocked[i, j] < RUN - RUN // ONE_IN - gap - 1:
            return False
        ops, ci, cj = [], i, j
        while ci and cj and grid[ci, cj] > 0:
            same = b[cj - 1] == a[ci - 1]
            if grid[ci, cj] == grid[ci - 1, cj - 1] + (1 if same else -gap):
                ops.append((1, 0 if same else 1))
                ci, cj = ci - 1, cj - 1
            elif grid[ci, cj] == grid[ci, cj - 1] - gap:
                ops.append((0, 1))
                cj -= 1
            else:
                ops.append((1, 1))
                ci -= 1
        for s in (s for s, (_, bad) in enumerate(ops) if not bad):  # a run begins and ends with a word of the item
            length = errors = 0
            for step, bad in ops[s:]:
                length, errors = length + step, errors + bad
                if not bad and length >= RUN and errors * ONE_IN <= length:
                    return True
        blocked[max(0, ci) : i + 1, max(0, cj) : j + 1] = 0


def _scan(index: Index, text: str | None) -> list[int]:
    """Items of the index that the text leaks."""
    words = tokens(text)
    if len(words) < RUN - RUN // ONE_IN or not len(index.keys):
        return []
    ids = np.fromiter(map(index.vocab.get, words, repeat(-1)), np.int64, len(words))
    terms = index.terms(ids)
    at = np.searchsorted(index.keys, terms)
    at[at == len(index.keys)] = 0
    bound = np.where(index.keys[at] == terms, index.top[at], 0.0)
    if bound.sum() < 1:
        return []
    total = np.concatenate([[0.0], np.cumsum(bound)])
    starts = np.arange(0, max(1, len(terms) - PASSAGE + STRIDE), STRIDE)
    ends = np.minimum(starts + PASSAGE, len(terms))
    hit: dict[int, list[int]] = {}
    for s in np.flatnonzero(total[ends] - total[starts] >= 1):
        own = set(terms[starts[s] : ends[s]][bound[starts[s] : ends[s]] > 0].tolist())
        for item in index.search(list(own)):
            hit.setdefault(item, []).append(int(starts[s]))
    out = []
    for item, at in hit.items():
        lo, hi = max(0, min(at) - PASSAGE), min(len(words), max(at) + 2 * PASSAGE)
        if holds(words[lo:hi], index.words[item]):
            out.append(index.ids[item])
    return out


def leaks(df: DataFrame, key: str, text: str, items: DataFrame, item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item_id): documents with the test items they leak, once each per row of ``df``.

    Null, empty and short texts leak nothing; items of fewer than RUN words cannot be leaked and are left
    out.  Repeated documents give repeated rows.  Columns other than the named ones are ignored.
    """
    kind, item_kind = df.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    docs = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    last, scans, blocks = None, [], []
    while True:  # blocks of test items, in the order of their keys
        more = items.filter(F.col(item_key).isNotNull())
        more = more if last is None else more.filter(F.col(item_key) > F.lit(last))
        rows = more.select(item_key, item_text).orderBy(item_key).limit(ITEM_BLOCK).collect()
        if rows:
            blocks.append(Index([tuple(r) for r in rows]))
            last = rows[-1][0]
        if blocks and (len(blocks) == SCAN_BLOCKS or len(rows) < ITEM_BLOCK):
            scans.append(_against(docs, blocks, kind, item_kind))
            blocks = []
        if len(rows) < ITEM_BLOCK:
            break
    if not scans:
        return docs.limit(0).select(F.col("k").alias(key), F.lit(None).cast(item_kind).alias("item_id"))
    return reduce(DataFrame.unionAll, scans).toDF(key, "item_id")


def _against(docs: DataFrame, blocks: list[Index], kind: str, item_kind: str) -> DataFrame:
    """One scan of the documents against some blocks of test items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, found = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                if t:
                    mine = [x for index in blocks for x in _scan(index, t)]
                    at += [i] * len(mine)
                    found += mine
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array([str(x) for x in found], pa.string())], ["k", "item"])

    return docs.mapInArrow(run, f"k {kind}, item string").select("k", F.col("item").cast(item_kind).alias("item"))


def found(documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    return leaks(documents, "doc_id", "text", eval_items).distinct()
