"""Deduplication by link, by title and by similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.functions.text import normalize_title, normalize_url, text
from tidewatch.operators import similar
from tidewatch.operators.graph import components


def by_link(df: DataFrame, link: str = "link", pos: str = "pos") -> DataFrame:
    """First row of each normalised link; rows without a link are dropped."""
    url = normalize_url(link)
    w = W.partitionBy("_u").orderBy(pos)
    return df.filter(F.length(F.trim(link)) > 0).withColumn("_u", url).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_u", "_n")


def by_title(df: DataFrame, title: str = "title", summary: str = "summary", pos: str = "pos") -> DataFrame:
    """Row with the longest summary of each normalised title (ties: the first), with its group's first place as slot.

    Rows without a title are all kept; their slot lies after all others (``untitled`` is true).
    """
    w = W.partitionBy("_t").orderBy(F.desc(F.length(text(summary))), pos)
    titled = df.withColumn("_t", normalize_title(title)).filter("_t <> ''")
    best = titled.withColumn("_n", F.row_number().over(w)).withColumn("slot", F.min(pos).over(W.partitionBy("_t"))).filter("_n = 1")
    rest = df.withColumn("_t", normalize_title(title)).filter("_t = ''").withColumn("slot", F.col(pos))
    return best.drop("_n").withColumn("untitled", F.lit(False)).unionByName(rest.withColumn("untitled", F.lit(True))).drop("_t")


def cosine_pairs(df: DataFrame, key: str, body: Column, threshold: float, max_features: int) -> DataFrame:
    """(a, b, cosine) of the texts whose TF-IDF vectors reach the threshold, the smaller key first."""
    rows, idf = similar.classes(df, key, body, max_features)
    x, y = rows.select(F.col("rep").alias("a"), F.col("k").alias("ka")), rows.select(F.col("rep").alias("b"), F.col("k").alias("kb"))
    across = similar.near(rows, idf, threshold).join(x, "a").join(y, "b").select("ka", "kb", "cosine")
    within = x.join(y, F.col("a") == F.col("b")).filter("ka < kb").select("ka", "kb", F.lit(1.0).alias("cosine"))
    return across.unionAll(within).select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"), "cosine")


def cosine_links(df: DataFrame, key: str, body: Column, threshold: float, max_features: int) -> DataFrame:
    """(a, b): links that join the same texts as ``cosine_pairs``; texts of one vector are linked to one of them."""
    rows, idf = similar.classes(df, key, body, max_features)
    return similar.links(rows, idf, threshold).unionAll(rows.filter("k <> rep").select("rep", "k"))


def semantic(df: DataFrame, links: DataFrame, pos: str = "pos") -> DataFrame:
    """Representative of each component of the linked rows; rows without a link are kept.

    The representative is a patent before others, then has the longest summary, is the latest, comes first.
    What rows are compared by is taken before the join, so summaries aren't shuffled for their length.
    """
    root = components(links).withColumnRenamed("node", pos)
    by = {"_p": F.coalesce(F.col("category") == "patent", F.lit(False)), "_l": F.length(text("summary")), "_c": text("collected_at")}
    w = W.partitionBy("_g").orderBy(*map(F.desc, by), pos)
    grouped = df.withColumns(by).join(root, pos, "left").withColumn("_g", F.coalesce("root", pos))
    return grouped.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_g", "root", *by)
