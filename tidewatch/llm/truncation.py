"""Problem 10: texts that were cut before their end.

The words of the corpus are kept as a trie, laid out as a table of (prefix, longer words below it) so that it lives
on the cluster; only branches that some text's final token walks are built.  A text that bears no mark of a cut is
judged by its final token and its length:

- prefix: the token is an unknown proper prefix of known words;
- limit: the text is as long as a field limit, a length at which more texts end than chance allows, and its last
  line stops neither at the end of a sentence nor at a word on which lines end;
- open: the last line has ended sentences and goes on with one that stops at a word on which no line ends.

A last line without an end of sentence is no evidence by itself: headlines, lists, signatures and code are whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.runtime import cut as materialise

#: Marks that are left where a text was cut.
MARK = r"(?:…|\.\.\.|\[\s*(?:…|\.\.\.)\s*\]|\[\+?\s*\d+\s*(?:chars?|characters)\]|\(truncated\))\s*$"
SENTENCE_END = r"[.!?。！？．](?:[)\]”’\"»」』）]|\s)*$"
#: An ended sentence with another one begun behind it.
GOES_ON = r"[\p{L}\p{N}%)\]”»°]{3}[.!?][)\]”’\"»]*\s+[\p{Lu}\p{N}“«„¿¡].*[^\s]|[。！？．][)」』）]*\s*[^\s)」』）]"
KNOWN_AT = 2
SPIKE = 6.0
AROUND = 25
#: Share of a word's occurrences at the end of a line from which lines may end on it.
CLOSES = 0.02


def _word(token: Column) -> Column:
    return F.regexp_extract(token, r"^[\[(“\"«‘]*(.*?)[)\],.;:!?…”\"»’]*$", 1)


def vocabulary(docs: DataFrame) -> DataFrame:
    """(w, n, ends): words of all texts but the last token of each, and how often a line ends on each without a stop."""
    lines = docs.select(F.posexplode(F.split("t", "\n")).alias("i", "l"), F.size(F.split("t", "\n")).alias("of"))
    tokens = lines.select(F.split(F.rtrim(F.col("l")), " ").alias("a"), (F.col("i") < F.col("of") - 1).alias("inner"))
    each = tokens.select("inner", F.size("a").alias("s"), F.posexplode("a").alias("j", "c")).select("c", "inner", (F.col("j") == F.col("s") - 1).alias("last"))
    each = each.filter(F.col("inner") | ~F.col("last")).groupBy("c", "last").agg(F.count(F.lit(1)).alias("n"))
    bare = F.when(F.col("last") & ~F.col("c").rlike(SENTENCE_END), F.col("n")).otherwise(0)
    return each.groupBy(_word(F.col("c")).alias("w")).agg(F.sum("n").alias("n"), F.sum(bare).alias("ends")).filter("w <> ''")


def trie(words: DataFrame, finals: DataFrame) -> DataFrame:
    """(w, below): final tokens that are proper prefixes of words, with the occurrences of the longer words below them.

    Words meet final tokens by their first letters and are followed down to the depths of these only, so a long
    word makes no more rows than there are depths.
    """
    depth = finals.select(F.substring("w", 1, 3).alias("head"), F.length("w").alias("at")).distinct()
    heads = words.select("w", "n", F.explode(F.array_distinct(F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda i: F.substring("w", F.lit(1), i)))).alias("head"))
    nodes = heads.join(depth, "head").filter(F.col("at") < F.length("w")).select(F.substring("w", F.lit(1), F.col("at")).alias("w"), "n")
    return nodes.groupBy("w").agg(F.sum("n").alias("below")).join(finals.select("w").distinct(), "w", "left_semi")


def field_limits(docs: DataFrame) -> DataFrame:
    """(len): lengths at which far more texts end than at the lengths around them."""
    hist = docs.groupBy(F.length("t").alias("len")).agg(F.count(F.lit(1)).alias("n"))
    near = W.partitionBy(F.floor(F.col("len") / 4096)).orderBy("len").rangeBetween(-AROUND, AROUND)
    mean = (F.sum("n").over(near) - F.col("n")) / (2.0 * AROUND)
    return hist.withColumn("mean", mean).filter((F.col("n") >= 3) & (F.col("n") > 2 + SPIKE * F.col("mean"))).select("len")


def detect(df: DataFrame, key: str, text: str, source: str | None = None) -> DataFrame:
    """(key, source, cut, why): one row per text that is not null, empty or blank.

    ``why`` names the first evidence: 'mark', 'prefix', 'limit', 'open', or null for a whole text.
    A text of one token has no inner words but is judged like any other.  Repeated keys give repeated rows.
    """
    src = F.col(source) if source else F.lit(None).cast("string")
    docs = df.select(F.col(key).alias("k"), src.alias("s"), F.col(text).alias("t")).filter(F.col("t").rlike(r"[^\s\p{Z}]"))
    tail = docs.select("k", "s", F.length("t").alias("len"), F.substring("t", -1, 1).alias("sp"), F.substring_index(F.rtrim("t", F.lit(" \n\t\r")), "\n", -1).alias("line"))
    ended, w = F.col("line").rlike(SENTENCE_END), _word(F.substring_index("line", " ", -1))
    tail = materialise(tail.select("k", "s", "len", "sp", ended.alias("ended"), F.col("line").rlike(MARK).alias("mark"), F.col("line").rlike(GOES_ON).alias("on"), F.col("line").rlike(r"(?:^|\s)\d{1,3}\.$").alias("short"), F.when(~ended, F.when(F.length(w) <= 64, w)).alias("w"), w.rlike("://|^www\\.").alias("link")))
    words = materialise(vocabulary(docs))
    finals = tail.filter("w <> ''").select("w").distinct()
    known = finals.join(words, "w", "left").select("w", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("ends", F.lit(0)).alias("ends"))
    below = trie(words.filter((F.col("n") >= KNOWN_AT) & (F.length("w") > 1)), finals)
    state = known.join(below, "w", "left").select("w", ((F.col("n") < KNOWN_AT) & (F.coalesce("below", F.lit(0)) >= KNOWN_AT)).alias("stub"), ((F.col("ends") >= 1) & (F.col("ends") >= CLOSES * F.col("n"))).alias("closes"))
    limits = field_limits(docs).select("len", F.lit(True).alias("at_limit"))
    x = tail.join(state, "w", "left").join(limits, "len", "left")
    stub, closes, at_limit = (F.coalesce(c, F.lit(False)) for c in ("stub", "closes", "at_limit"))
    stops = F.col("ended") | closes | F.col("link")
    why = (
        F.when(F.col("mark"), "mark")
        .when(~F.col("ended") & stub, "prefix")
        .when(at_limit & (~stops | (F.col("sp") == " ") | (F.col("ended") & F.col("short"))), "limit")
        .when(~stops & F.col("on"), "open")
    )
    return x.select(F.col("k").alias(key), F.col("s").alias("source"), why.isNotNull().alias("cut"), why.alias("why"))


def found(documents: DataFrame) -> DataFrame:
    return detect(documents, "doc_id", "text").filter("cut").select("doc_id").distinct()


def rates(documents: DataFrame) -> DataFrame:
    """(source, n, n_cut, share): how often each source truncates; texts without a source form one group."""
    return (
        detect(documents, "doc_id", "text", "source")
        .groupBy("source")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("cut")).alias("n_cut"))
        .withColumn("share", F.round(F.col("n_cut") / F.col("n"), 6))
    )
