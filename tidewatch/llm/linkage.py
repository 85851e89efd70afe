"""Problem 4: records of two tables that name the same piece without a shared key.

Sorted neighbourhood: articles and listings are put in order by several composite keys, each order one sorted run
over all rows, and a listing is compared with the articles at most ``WINDOW`` rows away in some order.  The window
slides across partitions: their edges are compared in a second step.  Similarities of figures, materials, names,
wording, outlet and link are weighted into a confidence.  Listings are then assigned to articles so that the total
confidence is greatest, a listing to one article, an article to at most ``CAPACITY`` listings, by an auction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.history import bare_title, title_words
from tidewatch.llm.urls import canonical_url
from tidewatch.runtime import cut, drop

WINDOW = 20
ACCEPT = 0.5
#: Listings that an article may have, and what a bid is raised by at least.
CAPACITY, STEP = 2, 0.005
#: Words of 64 bits of a filter of learnt words; its size doesn't grow with the words.
FILTER = 1 << 14
_MATERIAL = r"^(?:[A-Z][a-z]?\d*){2,}x?$|^[a-z]{1,2}-[A-Z](?:[:\-]?[A-Z])*$|^[A-Z]{2,}(?:-phase)?$|^[A-Z][a-z]?\d+$"
#: Processes look like materials but may be left out of a reworded headline.
_PROCESS = r"(?i)^(?:.*-)?(?:ald|mld|cvd|pvd|pld|mbe|ibad|pecvd|lpcvd|mocvd|dcms|hipims|sputtering|e-?beam|hollow-cathode|films?)$"
_CAPITAL = r"^\p{Lu}\p{Ll}+$"


def _places(word: Column) -> list[tuple[Column, Column]]:
    """(word of the filter, bit) of the two bits of a word."""
    h = F.xxhash64(word)
    return [(F.pmod(F.shiftright(h, shift), F.lit(FILTER)).cast("int"), F.pmod(F.shiftright(h, shift + 14), F.lit(64)).cast("int")) for shift in (0, 28)]


def _filter(words: DataFrame) -> Column:
    """Bits of the learnt words as a literal array; at most FILTER numbers reach the driver, however many words there are."""
    spots = words.select(F.explode(F.array(*(F.struct(a.alias("at"), b.alias("bit")) for a, b in _places(F.col("w"))))).alias("x"))
    bits = spots.groupBy("x.at").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("x.bit"))).alias("m")).collect()
    out = [0] * FILTER
    for at, m in bits:
        out[at] = m
    return F.from_json(F.lit("[" + ",".join(map(str, out)) + "]"), "array<bigint>")


def _in(bits: Column, word: Column) -> Column:
    """Whether a word is one of the filter's (a few others are taken for one)."""
    one, two = (F.get(bits, at).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)) != 0 for at, bit in _places(word))
    return one & two


def learn_names(titles: DataFrame, title: str) -> tuple[Column, Column]:
    """Filters of the names and of the materials that titles hold, in small letters.

    A name is a word that titles write with a capital where it isn't the first word, unless it mostly follows
    another such word, as what a firm does follows what it's called.
    """
    w = F.col("all")
    pairs = F.arrays_zip(F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))).alias("w"), F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))).alias("before"))
    quiet = titles.filter(F.col(title) != F.upper(title)).select(title_words(F.col(title)).alias("all"))
    first, rest = F.substring("before", 1, 1), F.substring("before", 2, 99)
    inner = quiet.select(F.explode(pairs).alias("x")).select("x.w", "x.before").filter(F.col("w").isNotNull())
    each = inner.select("w", ((first != F.lower(first)) & (rest == F.lower(rest)) & (rest != "")).alias("follows")).groupBy("w", "follows").agg(F.count(F.lit(1)).alias("c"))
    up, down = F.col("w").rlike(_CAPITAL), F.col("w").rlike(r"^\p{Ll}+$")
    shaped = F.col("w").rlike(_MATERIAL) & ~F.col("w").rlike(_PROCESS)
    total = lambda ok: F.sum(F.when(ok, F.col("c")).otherwise(0))
    n = cut(each.groupBy(F.lower("w").alias("w")).agg(total(up).alias("up"), total(down).alias("down"), total(up & F.col("follows")).alias("after"), total(shaped).alias("n"), total(F.col("w") == F.lower("w")).alias("low")))
    names = n.filter((F.length("w") >= 6) & (F.col("up") >= 2) & (F.col("up") > 4 * F.col("down")) & (F.col("after") < 0.7 * F.col("up")))
    return _filter(names.select("w")), _filter(n.filter((F.col("n") >= 3) & (F.col("n") > F.col("low"))).select("w"))


def describe(df: DataFrame, key: str, title: str, names: Column, mats: Column, whole: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(k, words, figs, mats, names): what a headline names; null and blank headlines are left out.

    ``whole``: nothing is taken off the end of the headline.  ``keep``: columns that come along.
    """
    flat = F.trim(F.regexp_replace(F.col(title), r"\s+", " "))
    b = df.filter(F.length(F.trim(title)) > 0).select(F.col(key).alias("k"), title_words(flat if whole else bare_title(F.col(title))).alias("raw"), *keep)
    b = b.select("k", "raw", *keep, F.array_distinct(F.transform("raw", F.lower)).alias("low"))
    raw, low = F.col("raw"), F.col("low")
    none = F.array().cast("array<string>")
    loud = F.size(F.filter(raw, lambda w: w.rlike(r"^\p{Lu}"))) > 0.6 * F.size(raw)
    figs = F.array_distinct(F.filter(raw, lambda w: w.rlike(r"^\d+(?:[.,]\d+)*$")))
    shaped = F.transform(F.filter(raw, lambda w: w.rlike(_MATERIAL) & ~w.rlike(_PROCESS) & w.rlike(r"[a-z\d]")), F.lower)
    own = F.transform(F.filter(raw, lambda w, i: (i > 0) & w.rlike(r"^\p{Lu}\p{Ll}{5,}$") & ~F.get(raw, i - 1).rlike(_CAPITAL)), F.lower)
    return b.select("k", *keep, low.alias("words"), figs.alias("figs"), F.array_union(F.filter(low, lambda w: _in(mats, w)), F.when(loud, none).otherwise(shaped)).alias("mats"), F.array_union(F.filter(low, lambda w: (F.length(w) >= 6) & _in(names, w)), F.when(loud, none).otherwise(own)).alias("names"))


def _sorts() -> list[Column]:
    """The composite sort keys: figures, materials, firm (from its start or its end) and wording, each leading in some order."""
    join = lambda c: F.array_join(F.array_sort(F.col(c)), " ")
    longest = lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0)
    rest = F.substring(F.array_join(F.array_sort(F.array_except(F.filter("words", lambda w: F.length(w) > 4), "names"), longest), " "), 1, 20)
    figs, mats = join("figs"), join("mats")
    name = F.coalesce(F.get(F.array_sort("names"), F.lit(0)), F.lit(""))
    parts = [(figs, mats, name, rest), (figs, F.substring(name, 1, 3), rest), (name, mats, rest), (mats, F.reverse(F.substring(name, -5, 5)), rest), (rest, F.substring(name, 1, 3), figs)]
    return [F.concat_ws("\t", F.lit(str(i)), *p) for i, p in enumerate(parts)]


def _bits(words: Column) -> Column:
    """64-bit signature of a set of words."""
    return F.aggregate(words, F.lit(0).cast("bigint"), lambda acc, w: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.hash(w), F.lit(64)))))


def _signed(df: DataFrame, side: int) -> DataFrame:
    """Rows with what the sliding window needs: sort keys, signatures of the wording, of the ends of the names, of figures and of materials.

    A listing's figures must all be among the article's, its materials among the article's words.
    """
    ends = F.flatten(F.transform("names", lambda w: F.array(F.substring(w, 1, 3), F.concat(F.lit("~"), F.substring(w, -3, 3)))))
    words = _bits(F.col("words"))
    return df.select("*", F.array(*_sorts()).alias("keys"), F.lit(side).cast("tinyint").alias("side"), words.alias("sig"), _bits(ends).alias("who"), _bits(F.col("figs")).alias("fig"), (words if side == 0 else _bits(F.col("mats"))).alias("mat"))


_SIGNS = ("sig", "who", "fig", "mat")


def window_pairs(order: np.ndarray, side: np.ndarray, signs: dict[str, np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (article, listing) of sorted rows at most ``width`` apart, of one order, whose signatures allow a match."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    sig, who = signs["sig"], signs["who"]
    weight = np.bitwise_count(sig).astype(np.int64)
    for d in range(1, width + 1):
        i = np.flatnonzero((side[:-d] != side[d:]) & (order[:-d] == order[d:]))
        a, b = np.where(side[i] == 0, i, i + d), np.where(side[i] == 0, i + d, i)
        ok = ((signs["fig"][b] & ~signs["fig"][a]) == 0) & ((signs["mat"][b] & ~signs["mat"][a]) == 0)
        a, b = a[ok], b[ok]
        named = (who[a] == 0) | (who[b] == 0) | (who[a] & who[b] != 0)
        common = np.bitwise_count(sig[a] & sig[b]) * 3.0 >= np.minimum(weight[a], weight[b])
        left.append(a[named & common])
        right.append(b[named & common])
    return np.concatenate(left), np.concatenate(right)


def _columns(t: pa.Table) -> tuple:
    return *(t.column(c).to_numpy() for c in ("o", "side", "k")), {c: t.column(c).to_numpy().view(np.uint64) for c in _SIGNS}


def neighbours(both: DataFrame) -> DataFrame:
    """(ak, lk): listings and the articles at most WINDOW rows away in some order, if their signatures allow a match.

    All orders are one sorted run.  Each partition also hands on its first and last WINDOW rows, two for each
    partition and order at most, which one task compares across the edges.
    """
    keyed = both.select(F.posexplode("keys").alias("o", "s"), "side", "k", *_SIGNS)
    parts = int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    run = keyed.repartitionByRange(parts, "s", "side", "k").sortWithinPartitions("s", "side", "k").select(F.col("o").cast("tinyint").alias("o"), "side", "k", *_SIGNS)
    names = ["ak", "lk", "part", "row", "o", "side", "k", *_SIGNS]

    def slide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, tail, head = TaskContext.get().partitionId(), 0, None, 0
        for b in batches:
            t = pa.Table.from_batches([b])
            keep = max(0, WINDOW - seen)  # rows of the first edge
            if keep and len(t):
                yield _edge(t.slice(0, keep), part, seen)
            joined = pa.concat_tables([tail, t]) if tail is not None else t
            old = len(joined) - len(t)
            o, side, k, signs = _columns(joined)
            i, j = window_pairs(o, side, signs, WINDOW)
            fresh = np.maximum(i, j) >= old
            ids = np.unique(np.stack([k[i[fresh]], k[j[fresh]]], 1), axis=0) if fresh.any() else np.zeros((0, 2), np.int64)
            none = [pa.nulls(len(ids), x) for x in (pa.int32(), pa.int64(), pa.int8(), pa.int8(), *[pa.int64()] * 5)]
            yield pa.RecordBatch.from_arrays([pa.array(ids[:, 0]), pa.array(ids[:, 1]), *none], names)
            seen += len(t)
            tail = joined.slice(max(0, len(joined) - WINDOW))
        if tail is not None and seen > WINDOW:
            last = tail.slice(max(0, len(tail) - (seen - WINDOW)))
            yield _edge(last, part, seen - len(last))

    def _edge(t: pa.Table, part: int, row: int) -> pa.RecordBatch:
        n = len(t)
        own = [t.column(c).combine_chunks() for c in ("o", "side", "k", *_SIGNS)]
        return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(row, row + n)), *own], names)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches).sort_by([("part", "ascending"), ("row", "ascending")])
        o, side, k, signs = _columns(t)
        part, row = t.column("part").to_numpy().astype(np.int64), t.column("row").to_numpy()
        # places that leave a gap of WINDOW where a partition's middle is left out
        gap = np.concatenate([[0], np.where((part[1:] == part[:-1]) & (row[1:] != row[:-1] + 1), WINDOW, 0)]) if len(part) else np.zeros(0, np.int64)
        place = np.arange(len(part)) + np.cumsum(gap)
        i, j = window_pairs(o, side, signs, WINDOW)
        ok = (part[i] != part[j]) & (np.abs(place[i] - place[j]) <= WINDOW)
        yield pa.RecordBatch.from_arrays([pa.array(k[i[ok]]), pa.array(k[j[ok]])], ["ak", "lk"])

    out = cut(run.mapInArrow(slide, "ak bigint, lk bigint, part int, row bigint, o tinyint, side tinyint, k bigint, sig bigint, who bigint, fig bigint, mat bigint"))
    edges = out.filter("part is not null").select("part", "row", "o", "side", "k", *_SIGNS).coalesce(1)
    return out.filter("part is null").select("ak", "lk").unionAll(edges.mapInArrow(across, "ak bigint, lk bigint")).distinct()


def assign(edges: DataFrame, capacity: int = CAPACITY, step: float = STEP) -> DataFrame:
    """(lk, ak, confidence): listings and articles paired so that the total confidence is greatest (to ``step`` a listing).

    An auction: a listing without an article bids for the one that it gains most from at the present prices, as
    much as makes the next best as good; an article keeps its ``capacity`` highest bids, and its price is the least
    of them once all its places are taken.  A listing whose gain is used up stays alone.  Ties go to lower keys.
    """
    edges = cut(edges.select("lk", "ak", "confidence"))
    held = None
    while True:
        open_ = edges
        if held is not None:
            price = held.groupBy("ak").agg(F.when(F.count(F.lit(1)) >= capacity, F.min("bid")).otherwise(F.lit(0.0)).alias("price"))
            open_ = edges.join(held.select("lk"), "lk", "left_anti").join(price, "ak", "left")
        gain = F.round(F.col("confidence") - (F.coalesce("price", F.lit(0.0)) if held is not None else F.lit(0.0)), 9)
        wish = open_.select("lk", "ak", "confidence", gain.alias("gain"), (F.coalesce("price", F.lit(0.0)) if held is not None else F.lit(0.0)).alias("price")).filter("gain > 0")
        top = wish.groupBy("lk").agg(F.max_by(F.struct("ak", "confidence", "price", "gain"), F.struct("gain", -F.col("ak"))).alias("x"), F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("gain"), False).alias("gains"))
        bids = top.select("lk", "x.ak", "x.confidence", (F.col("x.price") + F.col("x.gain") - F.coalesce(F.get("gains", F.lit(1)), F.lit(0.0)) + step).alias("bid"))
        bids = cut(bids)
        if bids.isEmpty():
            return held if held is not None else bids.select("lk", "ak", "confidence")
        both = bids if held is None else held.unionByName(bids)
        kept = both.groupBy("ak").agg(F.slice(F.sort_array(F.collect_list(F.struct("bid", (-F.col("lk")).alias("o"), "lk", "confidence")), False), 1, capacity).alias("b"))
        after = cut(kept.select("ak", F.explode("b").alias("x")).select("x.lk", "ak", "x.confidence", "x.bid"))
        if held is not None:
            drop(held)
        held = after


def _share(a: str, b: str) -> Column:
    """Letters in words that both have, of the letters of the shorter side."""
    weight = lambda c: F.aggregate(c, F.lit(0), lambda acc, w: acc + F.length(w))
    common = weight(F.array_intersect(a, b))
    return common / F.greatest(F.least(weight(F.col(a)), weight(F.col(b))), F.lit(1))


def _spelt(a: Column, b: Column) -> Column:
    """All words of a are in b, perhaps with up to two typing errors."""
    return F.forall(F.array_except(a, b), lambda w: F.exists(b, lambda v: F.levenshtein(w, v, 2) >= 0))


def match(articles: DataFrame, listings: DataFrame, a_key: str, a_title: str, a_link: str, a_source: str, l_key: str, l_title: str, l_link: str, l_outlet: str) -> DataFrame:
    """(a_key, l_key, confidence): each listing with the article that it is assigned to, and that one's copies.

    Rows with a null or blank headline match nothing.  Copies of an article (same bare title) come out with
    the same confidence; of equally good titles the one with the least key is taken.  Extra columns of
    either table are ignored, whatever their names.
    """
    named = F.when(F.length(F.trim(a_title)) > 0, bare_title(F.col(a_title)))
    base = articles.select(F.col(a_key).alias("pos"), named.alias("title"), F.xxhash64(canonical_url(F.col(a_link))).alias("u"), canonical_url(F.col(a_link)).isNotNull().alias("has"), F.col(a_source).alias("source"), F.col(a_link).alias("link"))
    base = cut(base.select("pos", "title", F.when(F.col("title").isNotNull(), F.xxhash64(F.lower("title"))).alias("th"), F.when(F.col("has"), F.col("u")).alias("u"), "source", "link"))
    titles = base.filter("th is not null").groupBy("th").agg(F.min(F.struct("pos", "title", "source", "link")).alias("x")).select("th", F.col("x.pos").alias("k"), "x.title", "x.source", "x.link")
    titles = cut(titles)
    names, mats = learn_names(titles, "title")
    told = ("k", "words", "figs", "mats", "names")
    a = cut(_signed(describe(titles, "k", "title", names, mats, whole=True, keep=("source", "link")), 0))
    b = listings.select(F.col(l_key).alias("k"), F.col(l_title).alias("title"), F.col(l_outlet).alias("source"), F.col(l_link).alias("link")).dropDuplicates(["k"])
    b = cut(_signed(describe(b, "k", "title", names, mats, whole=True, keep=("source", "link")), 1))
    thin = ("keys", "side", "k", *_SIGNS)
    pairs = neighbours(a.select(*thin).unionAll(b.select(*thin)))
    x = pairs.join(a.select(*[F.col(c).alias(f"a_{c}") for c in (*told, "source", "link")]), F.col("ak") == F.col("a_k"))
    x = x.join(b.select(*[F.col(c).alias(f"b_{c}") for c in (*told, "source", "link")]), F.col("lk") == F.col("b_k"))
    figures = (F.size(F.array_except("b_figs", "a_figs")) == 0)
    materials = (F.size(F.array_except("b_mats", "a_words")) == 0)
    firm = _spelt(F.array_except("a_names", "b_words"), F.col("b_words"))
    outlet = F.when(F.col("b_source").isNull() | F.col("a_source").isNull(), 0.5).otherwise(F.contains(F.lower("a_source"), F.regexp_replace(F.lower("b_source"), r"^the ", "")).cast("double"))
    slug = F.contains(F.regexp_replace(F.lower("b_link"), r"[^a-z0-9]", ""), F.regexp_replace(F.regexp_extract(F.lower("a_link"), r"^[a-z]+://(?:www\.|doi\.)?([a-z0-9\-]+)", 1), r"[^a-z0-9]", ""))
    known = F.when(F.size("b_figs") > 0, 0.1).otherwise(0.0) + F.when(F.size(F.array_intersect("a_mats", "b_words")) > 0, 0.1).otherwise(0.0)
    score = 0.65 * _share("a_words", "b_words") + known + 0.1 * outlet + 0.05 * F.coalesce(slug, F.lit(False)).cast("double")
    good = x.filter(figures & materials & firm).select("ak", "lk", F.round(score, 6).alias("confidence")).filter(F.col("confidence") >= ACCEPT)
    good = cut(good)
    best = assign(good).select("lk", "ak", "confidence")
    # the piece's other spellings: equally named, hardly less alike
    named = a.select(F.col("k").alias("ak"), F.array_sort("figs").alias("f"), F.array_sort("mats").alias("m"))
    kin = good.join(best.select("lk", F.col("ak").alias("top"), F.col("confidence").alias("most")), "lk").filter(F.col("confidence") >= F.col("most") - 0.2)
    kin = kin.join(named, "ak").join(named.toDF("top", "tf", "tm"), "top").filter((F.col("f") == F.col("tf")) & (F.col("m") == F.col("tm"))).select("ak", "lk", "confidence")
    copies = base.select("pos", "th").join(titles.select("th", F.col("k").alias("ak")), "th").select("pos", "ak")
    direct = cut(kin.join(copies, "ak").select("pos", "lk", "confidence"))
    # and the records that lead to the same page under another title
    pages = base.select("pos", "u").filter("u is not null")
    same = direct.join(pages, "pos").select("u", "lk", "confidence").distinct().join(pages, "u").select("pos", "lk", "confidence")
    return direct.unionAll(same).groupBy(F.col("pos").alias(a_key), F.col("lk").alias(l_key)).agg(F.max("confidence").alias("confidence"))


def found(article: DataFrame, outlet_listing: DataFrame) -> DataFrame:
    return match(article, outlet_listing, "pos", "title", "link", "source", "listing_id", "headline", "url", "outlet").select("pos", "listing_id")
