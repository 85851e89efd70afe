"""Problem 2: missing or wrong language labels, and texts in more than one language.

Rank-order profiles: each language has its most frequent character n-grams in order of frequency, taken
from sentences of known language.  A sentence goes to the language whose order is least out of place
with its own.  The confidence is the relative lead over the second language.  Names, materials and
processes (words with a capital or a digit) count as no language and are left out before counting.

Distances are computed for many sentences at once; sentences that are equal once names and figures are
out are computed once per worker.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.mojibake import repair

#: Spellings of the labels of each language, without region.
CODES = {"en": "en eng english", "fr": "fr fra fre french", "de": "de deu ger german", "es": "es spa spanish", "it": "it ita italian", "pt": "pt por portuguese", "ja": "ja jpn japanese"}
LABELS = {c: lang for lang, codes in CODES.items() for c in codes.split()}
PROFILE = 600
#: Rows of each known language that the profiles are fitted on, at most; a bound on what reaches the driver.
SAMPLE = 1000
MIN_LEAD = 0.08
MIN_GRAMS = 5
#: Entries of a worker's memory of sentences; full, it is emptied.
MEMORY = 200_000
_CJK = "぀-ヿ㐀-鿿"
_SPLIT = re.compile("(?<=[.!?…])[\"”»)]?\\s+|(?<=[。！？])")
_NAMED = re.compile(f"(?<![^\\s{_CJK}、。])[^\\s{_CJK}、。A-Z0-9À-ÖØ-Þ%]*[A-Z0-9À-ÖØ-Þ%][^\\s{_CJK}、。]*")
_LETTERS = re.compile(f"[^\\W\\d_]+")
_JA = re.compile(f"[{_CJK}]")


def masked(sentence: str) -> str:
    """The words of a sentence that can tell its language, in small letters, between single blanks."""
    rest = " ".join(_LETTERS.findall(_NAMED.sub(" ", sentence)))
    if len(rest) < 0.25 * len(sentence) and not _JA.search(sentence):
        rest = " ".join(w for w in _LETTERS.findall(sentence) if not re.search(r"[a-z]\w*[A-Z]", w)).lower()
    return f" {rest} "


def _grams(text: str) -> list[int]:
    c = [ord(x) for x in text]
    return [(a << 42) | (b << 21) | d for a, b, d in zip(c, c[1:], c[2:])] + [x for x in c if x > 127]


class Profiles:
    def __init__(self, samples: list[tuple[str, str]], size: int = PROFILE):
        counts: dict[str, Counter] = {}
        for lang, text in samples:
            counts.setdefault(lang, Counter()).update(_grams(masked(text)))
        self.langs = sorted(counts)
        ranks = {x: {g: k for k, (g, _) in enumerate(sorted(counts[x].items(), key=lambda i: (-i[1], i[0]))[:size])} for x in self.langs}
        self.keys = np.array(sorted({g for r in ranks.values() for g in r}), np.int64)
        self.rank = np.full((len(self.keys), len(self.langs)), size, np.int32)
        for j, x in enumerate(self.langs):
            for g, k in ranks[x].items():
                self.rank[np.searchsorted(self.keys, g), j] = k
        self.size = size

    def classify(self, texts: list[str]) -> list[tuple[str | None, float]]:
        """(language, lead) of each masked text; (None, 0.0) where too little is left to tell."""
        out: list[tuple[str | None, float]] = []
        for k in range(0, len(texts), 4000):
            out += self._block(texts[k : k + 4000])
        return out

    def _block(self, texts: list[str]) -> list[tuple[str | None, float]]:
        n = len(texts)
        chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
        sid = np.repeat(np.arange(n), [len(t) for t in texts])
        inside = sid[:-2] == sid[2:] if len(sid) > 2 else np.zeros(0, bool)
        code = ((chars[:-2] << 42) | (chars[1:-1] << 21) | chars[2:])[inside] if len(sid) > 2 else np.zeros(0, np.int64)
        high = chars > 127
        code, owner = np.concatenate([code, chars[high]]), np.concatenate([sid[:-2][inside] if len(sid) > 2 else sid[:0], sid[high]])
        at = np.searchsorted(self.keys, code)
        at[at == len(self.keys)] = 0
        known = self.keys[at] == code
        v = len(self.keys)
        pairs, times = np.unique(owner[known] * v + at[known], return_counts=True)
        own, gram, times = pairs // v, pairs % v, np.minimum(times, 15)
        tally = np.bincount(own * 16 + times, minlength=n * 16).reshape(n, 16)
        above = tally[:, ::-1].cumsum(1)[:, ::-1] - tally  # n-grams of the sentence that are more frequent
        place = above[own, times]
        apart = np.minimum(np.abs(self.rank[gram] - place[:, None]), self.size)
        dist = np.stack([np.bincount(own, apart[:, j], n) for j in range(len(self.langs))], 1)
        grams = np.bincount(own, minlength=n)
        order = np.argsort(dist, 1)
        first, second = dist[np.arange(n), order[:, 0]], dist[np.arange(n), order[:, 1]]
        lead = (second - first) / np.maximum(second, 1)
        return [(self.langs[j], float(x)) if g >= MIN_GRAMS else (None, 0.0) for j, x, g in zip(order[:, 0].tolist(), lead.tolist(), grams.tolist())]


def spans(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of the sentences of a text, in characters."""
    out, at = [], 0
    for m in _SPLIT.finditer(text or ""):
        out.append((at, m.start()))
        at = m.end()
    return [(a, b) for a, b in [*out, (at, len(text or ""))] if (text or "")[a:b].strip()]


def segments(df: DataFrame, key: str, fields: list[str], samples: DataFrame, keep: list[str] = ()) -> DataFrame:
    """(key, segments, *keep): the stretches of each row, as (field, start, end, lang, confidence).

    A stretch is the whole first field, or sentences of a further one that follow each other in one language; start
    and end count characters of the text as it was meant.  The confidence is the relative lead over the second
    language, of several sentences the mean.  A sentence whose lead is below MIN_LEAD keeps its low confidence.
    Sentences too short to tell, nulls and empty texts make no stretch; repeated rows are kept.
    """
    w = Window.partitionBy("lang").orderBy(F.xxhash64("text"), "text")
    known = samples.select("lang", "text").filter("lang is not null and text is not null").withColumn("n", F.row_number().over(w))
    profiles = Profiles([(r[0], r[1]) for r in known.filter(F.col("n") <= SAMPLE).orderBy("lang", "text").collect()])
    kind = df.schema[key].dataType.simpleString()
    extra = [f"x{i}" for i in range(len(keep))]
    cols = [F.col(key).alias("k"), *(F.col(c).alias(x) for c, x in zip(keep, extra)), *(F.col(f).cast("string").alias(f"f{i}") for i, f in enumerate(fields))]
    one = pa.struct([("field", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[str, tuple[str | None, float]] = {}
        first = 1 + len(keep)
        for b in batches:
            texts = [[repair(t) for t in b.column(first + i).to_pylist()] for i in range(len(fields))]
            cuts = [[([(0, len(t))] if i == 0 else spans(t)) if t and t.strip() else [] for t in column] for i, column in enumerate(texts)]
            masks = [[[masked(t[x:y]) for x, y in c] for t, c in zip(column, cut)] for column, cut in zip(texts, cuts)]
            if len(memory) > MEMORY:
                memory.clear()
            new = list({m for column in masks for row in column for m in row} - memory.keys())
            memory.update(zip(new, profiles.classify(new)))
            out = []
            for r in range(b.num_rows):
                row: list[dict] = []
                for f, cut, mask in zip(fields, cuts, masks):
                    leads: list[float] = []
                    for (x, y), m in zip(cut[r], mask[r]):
                        lang, lead = memory[m]
                        if not lang:
                            continue
                        if leads and row[-1]["lang"] == lang and (lead >= MIN_LEAD) == (row[-1]["confidence"] >= MIN_LEAD):
                            leads.append(lead)
                            row[-1] |= {"end": y, "confidence": sum(leads) / len(leads)}
                        else:
                            leads = [lead]
                            row.append({"field": f, "start": x, "end": y, "lang": lang, "confidence": lead})
                out.append(row)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(first)), pa.array(out, pa.list_(one))], ["k", *extra, "segments"])

    kinds = "".join(f", {x} {df.schema[c].dataType.simpleString()}" for c, x in zip(keep, extra))
    got = df.select(cols).mapInArrow(run, f"k {kind}{kinds}, segments array<struct<field: string, start: int, end: int, lang: string, confidence: double>>")
    return got.select(F.col("k").alias(key), *(F.col(x).alias(c) for c, x in zip(keep, extra)), "segments")


def detect(df: DataFrame, key: str, fields: list[str], label: str, samples: DataFrame) -> DataFrame:
    """One row per row of ``df``: key, label (normalised or null), segments, langs, mixed, doubtful.

    ``langs`` are the languages of the stretches that are sure (MIN_LEAD); where none is, the language of the
    surest one.  ``mixed``: more than one.  ``doubtful``: the label is missing or unknown or isn't among ``langs``,
    or isn't that of any stretch where none is sure; a row without stretches is never doubtful.
    """
    rows = segments(df, key, fields, samples, [label])
    said = F.regexp_extract(F.lower(F.trim(F.coalesce(F.col(label).cast("string"), F.lit("")))), "^([^-_ ]*)", 1)
    known = F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair))
    rows = rows.select(key, F.try_element_at(known, said).alias("label"), "segments")
    sure = F.array_distinct(F.transform(F.filter("segments", lambda s: s["confidence"] >= MIN_LEAD), lambda s: s["lang"]))
    best = F.array_max(F.transform("segments", lambda s: F.struct(s["confidence"].alias("c"), s["lang"].alias("l"))))["l"]
    guess = F.when(F.size("segments") > 0, F.array(best)).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("sure", sure).withColumn("langs", F.when(F.size("sure") > 0, F.col("sure")).otherwise(guess))
    among = F.when(F.size("sure") > 0, F.array_contains("sure", F.col("label"))).otherwise(F.exists("segments", lambda s: s["lang"] == F.col("label")))
    return rows.select(key, "label", "segments", "langs", (F.size("langs") > 1).alias("mixed"), ((F.size("langs") > 0) & ~F.coalesce(among, F.lit(False))).alias("doubtful"))


def found(article: DataFrame, lang_sample: DataFrame) -> DataFrame:
    rows = detect(article, "pos", ["title", "summary"], "lang", lang_sample).filter("mixed or doubtful")
    return rows.select("pos", F.explode("langs").alias("lang")).distinct()


def stretches(article: DataFrame, lang_sample: DataFrame) -> DataFrame:
    """(pos, field, start, end, lang, confidence): the stretches of the articles whose label is doubtful or that are mixed."""
    rows = detect(article, "pos", ["title", "summary"], "lang", lang_sample).filter("mixed or doubtful")
    return rows.select("pos", F.inline("segments")).withColumn("confidence", F.round("confidence", 4)).distinct()
