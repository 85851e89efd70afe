"""Scoring by a pluggable scorer, in batches of records."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.config import DEFAULT, Config
from tidewatch.functions.text import parse_llm, text

#: Takes a batch of prompts ("[id] source / title / summary") and returns the scorer's raw answer.
Scorer = Callable[[list[tuple[int, str]]], str]


def prompts(df: DataFrame) -> DataFrame:
    """(pos, prompt): what the scorer reads of a record; summaries are cut at 400 characters for the prompt only."""
    short = F.when(F.length(text("summary")) > 400, F.concat(F.substring(text("summary"), 1, 400), F.lit("…"))).when(F.trim(text("summary")) == "", "(no summary)").otherwise(text("summary"))
    return df.select("pos", F.format_string("[%d] %s / %s / %s", F.col("pos"), text("source"), text("title"), short).alias("prompt"))


def answers(df: DataFrame, scorer: Scorer, cfg: Config = DEFAULT, depth: int = 2) -> DataFrame:
    """(ids, raw): answers of the scorer for batches; a batch that fails is halved up to ``depth`` times, then given up."""

    def ask(batch: list[tuple[int, str]], left: int) -> Iterator[tuple[list[int], str]]:
        try:
            raw = scorer(batch)
            if raw and "retained" in raw:
                yield [i for i, _ in batch], raw
                return
        except Exception:  # noqa: BLE001 - a failed batch is split, then rejected
            pass
        if left and len(batch) > 1:
            yield from ask(batch[: len(batch) // 2], left - 1)
            yield from ask(batch[len(batch) // 2 :], left - 1)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = sorted(zip(f["pos"].tolist(), f["prompt"].tolist()))
            out = [x for k in range(0, len(rows), cfg.batch_size) for x in ask(rows[k : k + cfg.batch_size], depth)]
            yield pd.DataFrame(out, columns=["ids", "raw"])

    return prompts(df).mapInPandas(run, "ids array<bigint>, raw string")


def score(df: DataFrame, scorer: Scorer, cfg: Config = DEFAULT) -> DataFrame:
    """Rows that the scorer retained with at least ``min_score``, with score, confidence, justification and tags.

    Ids outside the batch that was asked for are ignored; of several entries for a row the best one counts.
    """
    a = answers(df, scorer, cfg).select("ids", F.explode(parse_llm("raw")["retained"]).alias("e"))
    kept = a.filter(F.array_contains("ids", F.col("e.id").cast("bigint")) & (F.col("e.score") >= cfg.min_score))
    best = kept.groupBy(F.col("e.id").cast("bigint").alias("pos")).agg(F.max_by("e", F.struct("e.score", "e.confidence")).alias("e"))
    plain = df.drop("score", "confidence", "justification", "tags")
    return plain.join(best, "pos").select(*plain.columns, "e.score", "e.confidence", "e.justification", "e.tags")


def rule_scorer(words: list[str]) -> Scorer:
    """A scorer without a model: one point, and one more for each word of interest, five at most."""

    def answer(batch: list[tuple[int, str]]) -> str:
        import json

        hits = [(i, min(5, 1 + sum(w in p.lower() for w in words))) for i, p in batch]
        return json.dumps({"tldr": f"{len(batch)} records", "retained": [{"id": i, "score": s, "confidence": 0.5 + s / 10, "tags": []} for i, s in hits]})

    return answer
