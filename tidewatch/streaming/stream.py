"""Structured Streaming forms of the state operators: a run is a micro-batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewatch.functions.text import normalize_url
from tidewatch.runtime import exists

STATS = "query string, source string, hits_total bigint, hits_last_run bigint, runs_total bigint, consecutive_zeros bigint"
_STATE = "hits_total bigint, runs_total bigint, consecutive_zeros bigint"


def unseen(stream: DataFrame, link: str = "link", ts: str | None = None, delay: str = "30 days") -> DataFrame:
    """Rows whose normalised link hasn't been seen; with an event time, links are forgotten after ``delay``."""
    x = stream.withColumn("_u", normalize_url(link)).filter("_u <> ''")
    x = x.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["_u"]) if ts else x.dropDuplicates(["_u"])
    return x.drop("_u")


def _update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    total, runs, zeros = state.get if state.exists else (0, 0, 0)
    hits = 0
    for f in frames:
        hits += int(f["hits"].fillna(0).sum())
    total, runs, zeros = total + hits, runs + 1, 0 if hits else zeros + 1
    state.update((total, runs, zeros))
    yield pd.DataFrame([(key[0], key[1], total, hits, runs, zeros)], columns=[c.split()[0] for c in STATS.split(", ")])


def stats(stream: DataFrame) -> DataFrame:
    """Running statistics of each (query, source) over micro-batches of (query, source, hits)."""
    return stream.groupBy("query", "source").applyInPandasWithState(_update, STATS, _STATE, "update", GroupStateTimeout.NoTimeout)


def windowed(stream: DataFrame, ts: str, width: str, delay: str, *by: str) -> DataFrame:
    """Counts per tumbling window; rows later than the watermark are left out."""
    return stream.withWatermark(ts, delay).groupBy(F.window(ts, width), *by).agg(F.count(F.lit(1)).alias("n"))


def upsert_sink(stream: DataFrame, path: str, key: str, order: str, checkpoint: str) -> DataStreamWriter:
    """Keeps the last row of each key in a Parquet table whose versions alternate between two folders."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = f"{path}/{(number + 1) % 2}"
        both = spark.read.parquet(before).unionByName(batch, allowMissingColumns=True) if exists(spark, before) else batch
        both.groupBy(key).agg(F.max_by(F.struct(*both.columns), order).alias("r")).select("r.*").write.mode("overwrite").parquet(f"{path}/{number % 2}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)
