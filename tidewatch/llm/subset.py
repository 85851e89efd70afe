"""Problem 6: a subset of given size that covers the variety of the data.

Cluster-feature trees.  Each partition sums its records up as cluster features (count, linear sum, square sum), the
leaf entries of its tree, under a radius that grows when there are too many; the summaries of all partitions are
merged in two levels, first of groups of partitions, then of the groups, for each cell of category and score.  For a request, the features of its cells are agglomerated by Ward linkage down to as many
groups as records are wanted, and the record nearest each group's centre is chosen.  A crowded subject is one
feature with a large count, so it gets no more than its share of the variety.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DIM = 48
#: Features kept of a cell by a partition, and after merging; features of a request that enter Ward linkage.
LEAVES, MERGED, LINKED = 64, 256, 600
#: Groups of partitions that are merged first.
GROUPS = 64
SCORE_WEIGHT = 0.15
_WORD = re.compile(r"[^\W\d_]{3,}|[぀-鿿]{2}")
_VECTOR = [f"v{i}" for i in range(DIM + 1)]


def vectors(title: pd.Series, summary: pd.Series, score: pd.Series) -> np.ndarray:
    """Hashed words of title (twice) and summary, of unit length, and the score.  Null texts are empty."""
    code: dict[str, tuple[int, float]] = {}
    rows, dims, signs = [], [], []
    for i, (t, s) in enumerate(zip(title, summary)):
        for w in _WORD.findall(f"{t or ''} {t or ''} {s or ''}".lower()):
            c = code.get(w)
            if c is None:
                h = zlib.crc32(w.encode())
                c = code[w] = (h % DIM, 1.0 if h & 0x10000 else -1.0)
            rows.append(i)
            dims.append(c[0])
            signs.append(c[1])
    n = len(title)
    x = np.bincount(np.array(rows, np.int64) * DIM + np.array(dims, np.int64), np.array(signs), n * DIM).reshape(n, DIM) if rows else np.zeros((n, DIM))
    x = np.sign(x) * np.sqrt(np.abs(x))
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    return np.hstack([x, SCORE_WEIGHT * score.to_numpy(float)[:, None]])


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None], 0)


class Features:
    """Leaf entries of one cluster-feature tree: counts, linear sums, square sums."""

    def __init__(self, limit: int):
        self.limit, self.radius = limit, 0.05
        self.n, self.ls, self.ss = np.zeros(0), np.zeros((0, DIM + 1)), np.zeros(0)

    def add(self, n: np.ndarray, ls: np.ndarray, ss: np.ndarray) -> None:
        """Entries join the nearest leaf within the radius, or become leaves; too many leaves widen the radius."""
        for k in range(0, len(n), 512):
            self._add(n[k : k + 512], ls[k : k + 512], ss[k : k + 512])
            while len(self.n) > self.limit:
                self.radius *= 1.3
                old = self.n, self.ls, self.ss
                self.n, self.ls, self.ss = np.zeros(0), np.zeros((0, DIM + 1)), np.zeros(0)
                self._add(*old)

    def _add(self, n: np.ndarray, ls: np.ndarray, ss: np.ndarray) -> None:
        left = np.arange(len(n))
        while len(left):
            c = ls[left] / n[left, None]
            if len(self.n):
                d = _apart(c, self.ls / self.n[:, None])
                near = d.argmin(1)
                fits = d[np.arange(len(left)), near] <= self.radius
                take = left[fits]
                np.add.at(self.n, near[fits], n[take])
                np.add.at(self.ls, near[fits], ls[take])
                np.add.at(self.ss, near[fits], ss[take])
                left, c = left[~fits], c[~fits]
            if len(left):  # leaders among the rest: those that no earlier one of the rest is near
                own = _apart(c, c) <= self.radius
                lead = ~np.tril(own, -1).any(1)
                new = left[lead]
                self.n = np.concatenate([self.n, n[new]])
                self.ls = np.vstack([self.ls, ls[new]])
                self.ss = np.concatenate([self.ss, ss[new]])
                left = left[~lead]


def ward(n: np.ndarray, centre: np.ndarray, k: int) -> np.ndarray:
    """Centres of k groups: the two whose union adds least to the sum of squares are joined, again and again."""
    n, c = n.astype(float).copy(), centre.copy()
    cost = _apart(c, c) * (n[:, None] * n[None]) / (n[:, None] + n[None])
    np.fill_diagonal(cost, np.inf)
    alive = np.ones(len(n), bool)
    while alive.sum() > k:
        i, j = divmod(int(cost.argmin()), len(n))
        c[i] = (n[i] * c[i] + n[j] * c[j]) / (n[i] + n[j])
        n[i] += n[j]
        alive[j] = False
        cost[j, :] = cost[:, j] = np.inf
        row = ((c - c[i]) ** 2).sum(1) * n * n[i] / (n + n[i])
        row[~alive] = np.inf
        row[i] = np.inf
        cost[i, :] = cost[:, i] = row
    return c[alive]


def _cells(df: DataFrame, key: str, title: str, summary: str, score: str, category: str) -> DataFrame:
    cat = F.lower(F.trim(F.coalesce(F.col(category), F.lit(""))))
    return df.filter(F.col(score).isNotNull()).select(F.col(key).alias("k"), F.col(title).alias("t"), F.col(summary).alias("s"), F.col(score).cast("int").alias("score"), cat.alias("cat"))


def choose(df: DataFrame, requests: DataFrame, key: str = "pos", title: str = "title", summary: str = "summary", score: str = "score", category: str = "category") -> DataFrame:
    """(request_id, choice, key): for each request as many records as it wants, or all that qualify if fewer.

    A record qualifies with a score of at least ``min_score`` and, if the request names one, its category, case
    aside; records without a score never do.  Null titles and summaries count as empty texts.  Of records equally
    near a centre the one with the least key is chosen, and no record twice.  Requests are few: they are
    collected, as are at most MERGED features of each cell; beyond MERGED the features of a cell, and beyond LINKED (or
    twice the number wanted) those of a request, stand for wider groups.
    """
    wanted = [(r["request_id"], r["n_wanted"], r["min_score"], (r["category"] or "").strip().lower() or None) for r in requests.select("request_id", "n_wanted", "min_score", "category").filter("n_wanted > 0").collect()]
    kind = df.schema[key].dataType.simpleString()
    rows = _cells(df, key, title, summary, score, category)
    entry = "part int, cat string, score int, n double, ss double, " + ", ".join(f"{v} double" for v in _VECTOR)

    def table(cell: tuple, f: Features, part: int) -> pd.DataFrame:
        out = pd.DataFrame(f.ls, columns=_VECTOR)
        return out.assign(part=part, cat=cell[0], score=cell[1], n=f.n, ss=f.ss)[["part", "cat", "score", "n", "ss", *_VECTOR]]

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, Features] = {}
        for b in batches:
            if len(b):
                x = vectors(b["t"], b["s"], b["score"])
                for cell, at in b.groupby(["cat", "score"]).indices.items():
                    held.setdefault(cell, Features(LEAVES)).add(np.ones(len(at)), x[at], (x[at] ** 2).sum(1))
        for cell, f in held.items():
            yield table(cell, f, TaskContext.get().partitionId() % GROUPS)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        f = Features(MERGED)
        pdf = pdf.sort_values(["n", *_VECTOR], ascending=False)
        f.add(pdf["n"].to_numpy(), pdf[_VECTOR].to_numpy(), pdf["ss"].to_numpy())
        return table((pdf["cat"].iloc[0], pdf["score"].iloc[0]), f, 0)

    groups = rows.mapInPandas(summarise, entry).groupBy("cat", "score", "part").applyInPandas(merge, entry)
    entries = groups.groupBy("cat", "score").applyInPandas(merge, entry).toPandas()
    centres: list[tuple] = []
    for rid, k, least, cat in wanted:
        own = entries[(entries["score"] >= (least if least is not None else -(2**31))) & ((entries["cat"] == cat) | (cat is None))]
        if len(own):
            f = Features(max(LINKED, 2 * k))
            own = own.sort_values(["n", *_VECTOR], ascending=False)
            f.add(own["n"].to_numpy(), own[_VECTOR].to_numpy(), own["ss"].to_numpy())
            centres.append((rid, k, least, cat, ward(f.n, f.ls / f.n[:, None], k)))

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The k records of the partition nearest each centre: bounded by the request, whatever the partition."""
        best: dict[tuple, list] = {}
        for b in batches:
            x = vectors(b["t"], b["s"], b["score"]) if len(b) else None
            for rid, k, least, cat, c in centres if len(b) else ():
                ok = np.flatnonzero((b["score"].to_numpy() >= (least if least is not None else -(2**31))) & ((b["cat"] == cat).to_numpy() | (cat is None)))
                if not len(ok):
                    continue
                d, keys = np.round(_apart(x[ok], c), 9), b["k"].to_numpy()[ok]
                for j in range(len(c)):
                    top = np.argpartition(d[:, j], min(k, len(ok)) - 1)[:k]
                    best[rid, j] = sorted(best.get((rid, j), []) + list(zip(d[top, j].tolist(), keys[top].tolist())))[:k]
        yield pd.DataFrame([(r, j, d, k) for (r, j), v in best.items() for d, k in v], columns=["request_id", "choice", "d", "k"])

    near = rows.mapInPandas(nearest, f"request_id bigint, choice int, d double, k {kind}")
    # of all partitions' nearest records the k nearest of each centre: a request never has more than k * k rows
    w = Window.partitionBy("request_id", "choice").orderBy("d", "k")
    size = F.create_map(*(F.lit(x) for rid, k, *_ in centres for x in (rid, k))) if centres else F.create_map(F.lit(0), F.lit(0))
    near = near.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= F.try_element_at(size, F.col("request_id"))).drop("n")
    size = {rid: k for rid, k, *_ in centres}

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        """Closest pairs first, each centre and each record once; records left over make up the number if a centre stays bare."""
        rid, out, used, taken = pdf["request_id"].iloc[0], [], set(), set()
        pdf = pdf.sort_values(["d", "k", "choice"])
        for j, k in zip(pdf["choice"], pdf["k"]):
            if j not in taken and k not in used:
                taken.add(j)
                used.add(k)
                out.append((rid, j, k))
        more = max(pdf["choice"]) + 1
        for k in pdf["k"]:
            if len(out) < size[rid] and k not in used:
                used.add(k)
                out.append((rid, more, k))
                more += 1
        return pd.DataFrame(out, columns=["request_id", "choice", key])

    return near.groupBy("request_id").applyInPandas(assign, f"request_id bigint, choice int, {key} {kind}")


def choice(article: DataFrame, digest_request: DataFrame) -> DataFrame:
    return choose(article, digest_request)
