"""Queries of the training-data problems, and their SQL where SQL can express them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewatch.runtime import table


def _lazy(module: str, name: str, *tables: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        f = getattr(importlib.import_module(f"tidewatch.llm.{module}"), name)
        return f(*(table(spark, sf_dir, t) for t in tables))

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": _lazy("history", "found", "article"),
        "p2_found": _lazy("language", "found", "article", "lang_sample"),
        "p2_segments": _lazy("language", "stretches", "article", "lang_sample"),
        "p3_found": _lazy("mojibake", "found", "article"),
        "p9_found": _lazy("leakage", "found", "documents", "eval_items"),
        "p10_found": _lazy("truncation", "found", "documents"),
        "p10_rates": _lazy("truncation", "rates", "documents"),
        "p4_found": _lazy("linkage", "found", "article", "outlet_listing"),
        "p5_found": _lazy("actors", "found", "discovered_actors"),
        "p6_choice": _lazy("subset", "choice", "article", "digest_request"),
        "p7_found": _lazy("neardup", "found", "article"),
        "p8_ids": lambda s, d: importlib.import_module("tidewatch.llm.tokenize").encode(table(s, d, "documents"), "doc_id", "text"),
    }


def oracle_sql() -> dict[str, str]:
    return {}
