"""Many terms looked for in many texts at once."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Terms that one scan of the texts looks for; more of them take more scans.
BLOCK = 1_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Finder:
    """Terms as byte strings, by their first eight bytes (all of them, in shorter terms).

    A window of eight bytes is laid over every place of a batch of texts; a bitmap and a binary search leave the
    places where a term can begin, and only these are compared.  The work hardly depends on the number of terms.
    """

    def __init__(self, terms: list[bytes]) -> None:
        self.at: dict[bytes, list[int]] = defaultdict(list)
        for i, t in enumerate(terms):
            self.at[t].append(i)
        self.everywhere = self.at.pop(b"", [])
        lengths: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
        for t in self.at:
            lengths[min(len(t), 8)][int.from_bytes(t[:8], "little")].add(len(t))
        self.shift = np.uint64(64 - max(16, (16 * len(self.at)).bit_length()))
        self.heads = []
        for n, heads in lengths.items():
            values = np.array(sorted(heads), np.uint64)
            marks = np.zeros(1 << int(64 - self.shift), bool)
            marks[(values * _MIX) >> self.shift] = True
            self.heads.append((np.uint64((1 << 8 * n) - 1), values, marks, [sorted(heads[v]) for v in values.tolist()]))

    def find(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(row, term) of every term that a text holds, once each; null texts hold none."""
        raw = texts.cast(pa.binary()).fill_null(b"").to_pylist()
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        end = np.cumsum(size)
        flat = b"".join(raw) + bytes(8)
        windows = np.ndarray((int(size.sum()),), "<u8", flat, strides=(1,))
        rows, found = [], []
        for mask, values, marks, ends in self.heads:
            head = windows & mask
            place = np.flatnonzero(marks[(head * _MIX) >> self.shift])
            which = np.minimum(np.searchsorted(values, head[place]), len(values) - 1)
            same = values[which] == head[place]
            place, which = place[same], which[same]
            row = np.searchsorted(end, place, "right")
            for r, p, e, w in zip(row.tolist(), place.tolist(), end[row].tolist(), which.tolist()):
                for n in ends[w]:
                    if p + n <= e and (hit := self.at.get(flat[p : p + n])):
                        rows += [r] * len(hit)
                        found += hit
        if self.everywhere:
            there = np.flatnonzero(texts.is_valid().to_numpy(zero_copy_only=False))
            rows += np.repeat(there, len(self.everywhere)).tolist()
            found += self.everywhere * len(there)
        both = np.unique(np.array([rows, found], np.int64), axis=1) if rows else np.zeros((2, 0), np.int64)
        return both[0], both[1]


def holding(df: DataFrame, body: str, terms: list[tuple[str, str]]) -> DataFrame:
    """The rows of ``df`` without ``body``, with (i, term): one for each (what to look for, name) whose first the body holds.

    ``i`` is the place in the list, ``term`` the name.  The list is held by the driver and by each task.
    """
    rest = [c for c in df.columns if c != body]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*rest).schema), "i int, term string"])
    out = None
    for k in range(0, max(1, len(terms)), BLOCK):
        part = terms[k : k + BLOCK]

        def scan(batches: Iterator[pa.RecordBatch], part: list[tuple[str, str]] = part, k: int = k) -> Iterator[pa.RecordBatch]:
            finder, names = Finder([t.encode() for t, _ in part]), pa.array([n for _, n in part], pa.string())
            for b in batches:
                row, at = finder.find(b.column(len(rest)))
                kept = [b.column(c).take(pa.array(row)) for c in range(len(rest))]
                yield pa.RecordBatch.from_arrays([*kept, pa.array((at + k).astype(np.int32)), names.take(pa.array(at))], [*rest, "i", "term"])

        x = df.select(*rest, body).mapInArrow(scan, schema)
        out = x if out is None else out.unionAll(x)
    return out
