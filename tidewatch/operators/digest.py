"""Digest and recap: the small ordered results at the end of a run."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.config import DEFAULT, Config
from tidewatch.functions.text import ellipsis, source_family, stars


def recap(df: DataFrame, cfg: Config = DEFAULT) -> dict[str, int]:
    """Counts of a recap's headline."""
    x = df.filter(F.col("score") >= cfg.min_score)
    r = x.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("score") == 5).alias("fives"), F.count_if(F.col("score") == 4).alias("fours")).first()
    return r.asDict()


def cards(df: DataFrame, n: int, cfg: Config = DEFAULT) -> DataFrame:
    """The first n rows of a digest, best first, with what a card shows."""
    x = df.filter(F.col("score") >= cfg.min_score).orderBy(F.desc("score"), F.desc_nulls_last("collected_at"), "pos").limit(n)
    return x.select("pos", "score", stars("score").alias("stars"), "title", "link", ellipsis("summary").alias("summary"), source_family("source").alias("family"), F.slice(F.coalesce("tags", F.array().cast("array<string>")), 1, 6).alias("tags"))


def render(df: DataFrame, n: int = 100, cfg: Config = DEFAULT) -> str:
    """The digest as HTML; only its n cards reach the driver."""
    out, score = ["<html><body>"], None
    for i, r in enumerate(cards(df, n, cfg).orderBy(F.desc("score"), "pos").collect(), 1):
        if r["score"] != score:
            score = r["score"]
            out.append(f"<h2>{r['stars']}</h2>")
        tags = " ".join(f"<i>{html.escape(t)}</i>" for t in r["tags"])
        out.append(f"<p>{i}. <a href='{html.escape(r['link'] or '')}'>{html.escape(r['title'] or '')}</a> ({html.escape(r['family'])})<br>{html.escape(r['summary'])} {tags}</p>")
    return "\n".join([*out, "</body></html>"])


def replace_table(df: DataFrame, path: str, version: int) -> str:
    """Writes a new version of a state table beside the old one and returns its folder; readers never see half a write."""
    at = f"{path}/v={version}"
    df.write.mode("overwrite").parquet(at)
    return at
