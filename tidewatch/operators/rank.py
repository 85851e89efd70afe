"""Text ranking: BM25, TF-IDF, maximal marginal relevance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.functions.text import text, tokens

K1, B, EPSILON = 1.5, 0.75, 0.25


def ranking_text(title: str = "title", summary: str = "summary") -> Column:
    return F.trim(F.concat(text(title), F.lit(". "), text(summary)))


def bm25(df: DataFrame, key: str, body: Column, query: list[str]) -> DataFrame:
    """(key, score): Okapi BM25 of each row that holds a query term; a term given twice counts twice.

    Terms in more than half of the rows get a quarter of the mean idf of the vocabulary instead of a negative
    one.  Only the query's terms travel; lengths are counted where the texts are.
    """
    spark = df.sparkSession
    docs = df.select(F.col(key).alias("k"), tokens(body).alias("t"))
    freq = docs.select(F.explode(F.array_distinct("t")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = docs.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("t")).alias("avgdl"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    mean = freq.crossJoin(F.broadcast(n)).agg(F.avg(idf).alias("mean_idf"))
    q = spark.createDataFrame([(t, query.count(t)) for t in dict.fromkeys(query)], "term string, qtf int")
    one = n.crossJoin(mean)
    terms = freq.join(F.broadcast(q), "term").crossJoin(F.broadcast(one))
    terms = terms.select("term", "qtf", "avgdl", F.when(idf < 0, EPSILON * F.col("mean_idf")).otherwise(idf).alias("idf"))
    hits = docs.select("k", F.size("t").alias("dl"), F.explode(F.filter("t", lambda w: w.isin(*dict.fromkeys(query)))).alias("term"))
    tf = hits.groupBy("k", "dl", "term").agg(F.count(F.lit(1)).alias("tf")).join(F.broadcast(terms), "term")
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return tf.groupBy(F.col("k").alias(key)).agg(F.sum(part).alias("score"))


def keep_top(df: DataFrame, scored: DataFrame, key: str, fraction: float, least: float) -> DataFrame:
    """Adds ``similarity`` (score over the greatest one) and keeps the top fraction and all at or above ``least``.

    The top fraction is a rank cut by a count, not a window over one partition: ties go to the lower key.
    """
    x = df.join(scored, key, "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    top = x.agg(F.max("score").alias("m"), F.count(F.lit(1)).alias("n")).first()
    best = top["m"] if top["m"] and top["m"] > 0 else 1.0
    x = x.withColumn("similarity", F.col("score") / best)
    take = max(1, int(top["n"] * fraction))
    bound = x.select("similarity", key).orderBy(F.desc("similarity"), key).offset(take - 1).limit(1).first()
    if bound is None:
        return x.drop("score")
    sim, k = bound
    first = (F.col("similarity") > sim) | ((F.col("similarity") == sim) & (F.col(key) <= k))
    return x.filter(first | (F.col("similarity") >= least)).drop("score")


def tfidf(df: DataFrame, key: str, body: Column, max_features: int, pattern: str = r"[\p{L}\p{N}_]{2,}", stop: list[str] = (), bigrams: bool = False, min_df: int = 1, max_df: float = 1.0) -> DataFrame:
    """(key, term, w, df): unit vectors of 1 + ln tf times ln((1 + N) / (1 + df)) + 1 over the most frequent terms."""
    words = F.filter(F.regexp_extract_all(F.lower(body), F.lit(pattern), F.lit(0)), lambda w: ~w.isin(*stop) if stop else F.lit(True))
    terms = F.col("t")
    if bigrams:
        terms = F.concat("t", F.zip_with(F.slice("t", F.lit(1), F.greatest(F.size("t") - 1, F.lit(0))), F.slice("t", F.lit(2), F.greatest(F.size("t") - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b)))
    docs = df.select(F.col(key).alias("k"), words.alias("t"))
    tf = docs.select("k", F.explode(terms).alias("term")).groupBy("k", "term").agg(F.count(F.lit(1)).alias("tf"))
    freq = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    freq = freq.crossJoin(F.broadcast(n)).filter((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("n")))
    freq = freq.orderBy(F.desc("cf"), "term").limit(max_features)
    w = (1 + F.log("tf")) * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)
    x = tf.join(freq, "term").select("k", "term", "df", w.alias("w"))
    norm = x.groupBy("k").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return x.join(norm, "k").select(F.col("k").alias(key), "term", (F.col("w") / F.col("norm")).alias("w"), "df")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def mmr(df: DataFrame, key: str, relevance: str, vector: str, lam: float, k: int) -> DataFrame:
    """(key, rank): greedy diversification of the first ``k`` rows by relevance (ties: lower key).

    Sequential by nature; the rows that enter are bounded by ``k``.
    """
    kind = df.schema[key].dataType.simpleString()

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["r", "k"], ascending=[False, True], ignore_index=True)
        x = np.array(pdf["v"].tolist(), float)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        sim, rel = x @ x.T, pdf["r"].to_numpy(float)
        left, out, near = list(range(len(pdf))), [], np.zeros(len(pdf))
        while left:
            best = max(left, key=lambda i: (round(lam * rel[i] - (1 - lam) * near[i], 12), -i))
            left.remove(best)
            near = np.maximum(near, sim[best]) if out else sim[best].copy()
            out.append(best)
        return pd.DataFrame({"k": pdf["k"].to_numpy()[out], "rank": range(1, len(out) + 1)})

    top = df.select(F.col(key).alias("k"), F.col(relevance).cast("double").alias("r"), F.col(vector).cast("array<double>").alias("v")).orderBy(F.desc("r"), "k").limit(k)
    return top.groupBy().applyInPandas(pick, f"k {kind}, rank int").withColumnRenamed("k", key)


def first_n(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """Top n rows with their number, through a bounded top-k."""
    return df.orderBy(*order).limit(n).withColumn("rn", F.row_number().over(W.orderBy(*order)))
