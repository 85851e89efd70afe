"""Row filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.text import text

#: Markers of a page that isn't the page asked for.
BLOCK_MARKERS = (
    "captcha",
    "are you a human",
    "verify you are not a bot",
    "rate limit exceeded",
    "too many requests",
    "unusual traffic from your computer",
    "automated queries",
    "access denied",
    "blocked by",
    "cloudflare ray id",
)


def recent(df: DataFrame, ts: str, as_of: Column, days: int) -> DataFrame:
    """Rows of at most ``days`` whole days before ``as_of``; rows without a readable time are kept."""
    age = F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(F.col(ts).cast("timestamp"))) / 86400)
    return df.filter(F.col(ts).isNull() | (age <= days))


def required(df: DataFrame, *fields: str) -> DataFrame:
    """Rows in which none of the fields is null or blank."""
    for f in fields:
        df = df.filter(F.length(F.trim(F.col(f))) > 0)
    return df


def haystack(*fields: str) -> Column:
    return F.lower(F.concat_ws(" ", *(text(f) for f in fields)))


def lexical(df: DataFrame, phrases: list[str], words: list[str], fields: tuple[str, ...] = ("title", "summary", "source")) -> DataFrame:
    """Rows that hold a phrase or one of the words; all rows if the vocabulary is empty; blank rows are kept."""
    if not phrases and not words:
        return df
    hay = haystack(*fields)
    hit = F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(hay, p)) if phrases else F.lit(False)
    if words:
        hit = hit | F.arrays_overlap(F.regexp_extract_all(hay, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), F.array(*map(F.lit, words)))
    return df.filter(hit | (F.trim(hay) == ""))


def blocked_page(html: str) -> Column:
    """Whether a page is a soft ban: any marker in its first 4000 characters."""
    head = F.lower(F.substring(text(html), 1, 4000))
    return F.exists(F.array(*map(F.lit, BLOCK_MARKERS)), lambda m: F.contains(head, m))


def not_in(df: DataFrame, key: Column, other: DataFrame, other_key: Column) -> DataFrame:
    """Left anti join on an expression of either side."""
    known = other.select(other_key.alias("_known")).distinct()
    return df.join(known, key == F.col("_known"), "left_anti")
