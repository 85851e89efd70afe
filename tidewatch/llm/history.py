"""Problem 1: new batches against everything accepted before.

A record is looked up in two indexes that only grow: canonical links, and a segment index over titles for
bounded edit distance.  A title is a string of words; it is cut into ``EDITS`` + 1 segments, stored by length,
position and content.  A title within ``EDITS`` word edits of a stored one keeps at least one of its segments
whole, so probing the few substrings that can line up with a segment finds every such pair; the edit distance of
the words verifies it.  Figures, and materials that carry a digit, are
part of the key, as titles that differ in them are other pieces.

``Store`` keeps the indexes as tables of one folder per batch.  ``Store.add`` takes a batch: it looks its records
up in what is stored, by key only, joins them to the pieces found, and appends the batch's own entries.  No batch
reads the records accepted before, and a batch that brings two pieces together adds that link alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.urls import canonical_url
from tidewatch.operators.graph import components
from tidewatch.runtime import cut, drop

EDITS = 3
#: What outlets put before and after a title.
PREFIX = r"^\s*(?:[\[(【][^\])】]{1,24}[\])】]\s*|(?i:re|fwd?|aw|wg|update|updated|news|breaking|exclusive|report|watch|video|just in|flash|eilmeldung|actualité|última hora|ultim'ora|atualização|速報)\s?[:：]\s*)+"
SUFFIX = r"(?:\s+[|–—-]\s+[^|–—]{1,40}|\s*[\[(【][^\])】\d]{1,24}[\])】]|\s*(?:…|\.\.\.)|[\s.!]+)+$"
_WORD = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}ー]|[\p{L}\p{N}&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}ー]]+(?:[.,:\-][\p{L}\p{N}&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}ー]]+)*|[%°]"
_SHAPE = r"\d|^[A-Z][a-z]?[A-Z]|^[a-z]{1,2}-[A-Z]|^[A-Z]{2,}"


def bare_title(title: Column) -> Column:
    """The title without what outlets add, white space collapsed."""
    flat = F.trim(F.regexp_replace(title, r"\s+", " "))
    stripped = F.regexp_replace(F.regexp_replace(flat, PREFIX, ""), SUFFIX, "")
    return F.when(stripped != "", stripped).otherwise(flat)


def title_words(title: Column) -> Column:
    return F.regexp_extract_all(title, F.lit(_WORD), F.lit(0))


def _key(words: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(words, lambda w: w.rlike(r"\d"))), " ")


def bound(n: Column) -> Column:
    """Word edits that a title of n words may have, fewer in short ones; of two titles, the shorter one's count."""
    return F.when(n >= 9, EDITS).when(n >= 4, 2).when(n >= 3, 1).otherwise(0)


def described(df: DataFrame, key: str, title: str, link: str | None = None) -> DataFrame:
    """(k, u, th, t, names): canonical link and bare title in small letters, with hashes of both; null where there is none."""
    u = F.xxhash64(canonical_url(F.col(link))) if link else F.lit(None).cast("bigint")
    has = canonical_url(F.col(link)).isNotNull() if link else F.lit(False)
    raw = F.col("raw")
    loud = F.size(F.filter(raw, lambda w: w.rlike(r"^\p{Lu}"))) > F.size(raw) * 0.6
    names = F.when(loud, F.array().cast("array<string>")).otherwise(F.transform(F.filter(raw, lambda w: w.rlike(_SHAPE)), F.lower))
    bare = df.select(F.col(key).alias("k"), F.when(has, u).alias("u"), title_words(F.when(F.length(F.trim(title)) > 0, bare_title(F.col(title)))).alias("raw"))
    rows = bare.select("k", "u", F.nullif(F.array_join(F.transform(raw, F.lower), " "), F.lit("")).alias("t"), names.alias("names"))
    return rows.select("k", "u", F.when(F.col("t").isNotNull(), F.xxhash64("t")).alias("th"), "t", "names")


def prepare(rows: DataFrame) -> DataFrame:
    """(rep, th, words, n, key, names): distinct titles of ``described`` rows, with the least key that bears each."""
    one = rows.filter("th is not null").groupBy("th").agg(F.min(F.struct("k", "t", "names")).alias("x"))
    words = F.split("x.t", " ")
    return one.select(F.col("x.k").alias("rep"), "th", words.alias("words"), F.size(words).alias("n"), _key(words).alias("key"), F.col("x.names").alias("names"))


def _segments(n: Column) -> Column:
    """(number, start, length) of the segments of a title of n words, one more than its edits."""
    parts = bound(n) + 1
    start = lambda i: F.floor(n * i / parts).cast("int")
    return F.transform(F.sequence(F.lit(0), parts - 1), lambda i: F.struct(i.alias("i"), start(i).alias("at"), (start(i + 1) - start(i)).alias("len")))


def _hash(length: str, at: Column) -> Column:
    return F.xxhash64("key", length, "s.i", F.array_join(F.slice("words", at + 1, F.col("s.len")), " "))


def index_entries(titles: DataFrame) -> DataFrame:
    """Rows of the segment index: (h, rep), h standing for figures, length, number and content of the segment."""
    seg = titles.select("rep", "n", "key", "words", F.explode(_segments(F.col("n"))).alias("s"))
    return seg.select(_hash("n", F.col("s.at")).alias("h"), "rep")


def probes(titles: DataFrame, within: bool = False) -> DataFrame:
    """(h, a): the substrings of each title that can line up with a segment of one a few words longer or shorter.

    Segment i has at most i edits before it and the others after it, which bounds the places it can have.
    ``within``: the index is that of these titles, so longer ones are enough: each pair is met from its shorter side.
    """
    p = titles.select("rep", "n", "key", "words", F.explode(F.sequence(F.lit(0 if within else -EDITS), F.lit(EDITS))).alias("d"))
    p = p.select("*", (F.col("n") + F.col("d")).alias("m")).filter("m > 0").withColumn("e", bound(F.col("m"))).filter(F.abs("d") <= bound(F.least("n", "m")))
    p = p.select("*", F.explode(_segments(F.col("m"))).alias("s"))
    low = F.greatest(F.lit(0), F.col("s.at") + F.greatest(-F.col("s.i"), -F.col("d") - (F.col("e") - F.col("s.i"))))
    high = F.least(F.col("n") - F.col("s.len"), F.col("s.at") + F.least(F.col("s.i"), -F.col("d") + (F.col("e") - F.col("s.i"))))
    p = p.filter(low <= high).select("*", F.explode(F.sequence(low, high)).alias("at"))
    return p.select(_hash("m", F.col("at")).alias("h"), F.col("rep").alias("a"))


def word_edits(a: list[str], b: list[str], most: int) -> int:
    """Words put in, taken out or replaced; most + 1 beyond ``most``."""
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
        row = now
        if min(row) > most:
            return most + 1
    return row[-1]


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = [word_edits(x, y, e) <= e for x, y, e in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)))]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def probe(titles: DataFrame, index: DataFrame, stored: DataFrame, within: bool = False) -> DataFrame:
    """(a, b): pairs of a title and one of the index within the bound of word edits that name the same things.

    ``stored`` holds the titles behind the index; ``within``: they are the titles themselves.
    """
    kind = titles.schema["rep"].dataType.simpleString()
    pairs = probes(titles, within).join(index.toDF("h", "b"), "h").filter("a <> b").select("a", "b").distinct()
    x = pairs.join(titles.select(F.col("rep").alias("a"), F.col("names").alias("na"), F.col("words").alias("wa")), "a")
    x = x.join(stored.select(F.col("rep").alias("b"), F.col("names").alias("nb"), F.col("words").alias("wb")), "b")
    x = x.filter((F.size(F.array_except("na", "wb")) == 0) & (F.size(F.array_except("nb", "wa")) == 0)).filter(_same_firm("wa", "wb") & _same_firm("wb", "wa"))
    return x.select("a", "b", "wa", "wb", bound(F.least(F.size("wa"), F.size("wb"))).alias("e")).mapInArrow(_verify, f"a {kind}, b {kind}")


def _same_firm(a: str, b: str) -> Column:
    """No long word of a, unless added, is missing from b without a like-spelt one: names of firms survive typing errors only."""
    odd = F.filter(F.array_except(a, b), lambda w: F.length(w) >= 7)
    return F.size(F.filter(odd, lambda w: ~F.exists(F.array_except(b, a), lambda v: F.levenshtein(w, v, 2) >= 0) & (F.size(F.array_except(b, a)) > 0))) == 0


class Store:
    """The indexes of what was accepted: titles, segments, links, and the links between records that make pieces."""

    def __init__(self) -> None:
        self.titles = self.segments = self.pages = None
        self.edges: list[DataFrame] = []

    def add(self, batch: DataFrame, key: str, title: str, link: str) -> DataFrame:
        """(a, b): links of the batch's records to earlier records and to each other; the batch is appended.

        Null, blank and hostless links and null or blank titles match nothing.  Equal titles and equal links are
        linked to the least key that bears them, without pairs.  Keys of a later batch may be lower or higher.
        """
        rows = cut(described(batch, key, title, link))
        mine = cut(prepare(rows))
        pages = cut(rows.filter("u is not null").groupBy("u").agg(F.min("k").alias("m")))
        out = [
            rows.select("k", "th").join(mine.select("th", "rep"), "th").filter("k <> rep").select(F.col("k").alias("a"), F.col("rep").alias("b")),
            rows.select("k", "u").join(pages, "u").filter("k <> m").select(F.col("k").alias("a"), F.col("m").alias("b")),
        ]
        new, new_pages = mine, pages
        if self.titles is not None:
            known = self.titles.select("th", F.col("rep").alias("old"))
            met = cut(mine.join(known, "th", "left"))
            out.append(met.filter("old is not null").select(F.col("rep").alias("a"), F.col("old").alias("b")))
            new = met.filter("old is null").select(*mine.columns)
            seen = cut(pages.join(self.pages.toDF("u", "old"), "u", "left"))
            out.append(seen.filter("old is not null").select(F.col("m").alias("a"), F.col("old").alias("b")))
            new_pages = seen.filter("old is null").select("u", "m")
            out.append(probe(new, self.segments, self.titles))
        segments = cut(index_entries(new))
        out.append(probe(new, segments, new, within=True))
        edges = out[0]
        for e in out[1:]:
            edges = edges.unionAll(e)
        edges = cut(edges.distinct())
        self.titles = new if self.titles is None else self.titles.unionAll(new)
        self.segments = segments if self.segments is None else self.segments.unionAll(segments)
        self.pages = new_pages if self.pages is None else self.pages.unionAll(new_pages)
        self.edges.append(edges)
        drop(rows)
        return edges

    def pieces(self) -> DataFrame:
        """(k, piece): the least key of the piece of each record that has a fellow."""
        edges = self.edges[0]
        for e in self.edges[1:]:
            edges = edges.unionAll(e)
        return components(edges).select(F.col("node").alias("k"), F.col("root").alias("piece"))


def pieces(df: DataFrame, key: str, title: str, link: str, arrivals: list[Column] | None = None) -> DataFrame:
    """(k, piece): the least key of each row's piece; ``arrivals`` tell which rows come together, in order."""
    store = Store()
    for part in arrivals or [F.lit(True)]:
        store.add(df.filter(part), key, title, link)
    return store.pieces()


def found(article: DataFrame) -> DataFrame:
    """The accepted history is indexed, then what is new arrives: it goes through the stored index, not through history."""
    new = F.col("batch_no") >= 1
    p = pieces(article, "pos", "title", "link", [~F.coalesce(new, F.lit(False)), F.coalesce(new, F.lit(False))]).filter("k <> piece")
    return p.join(article.filter(new).select("pos"), F.col("k") == F.col("pos")).select(F.col("piece").alias("pos_a"), F.col("k").alias("pos_b")).distinct()
