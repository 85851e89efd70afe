"""Problem 8: encoding of the corpus with a public byte-level BPE tokenizer.

The ranked merges run as Spark higher-order functions over the bytes of *distinct* words.  The rank
map is a literal of the plan: an array of buckets, each a small map, so that a look-up is one array
access and a scan of one or two entries (a single 50k map would be scanned from end to end).

A text is first cut at its spaces: in this tokenizer a space always opens a new word unless it follows
white space, so the ids of a text are those of its chunks, one after the other.  The few texts that hold
white space before a space are cut by the tokenizer's own pattern instead.  One pass counts the distinct
chunks and, within these, the distinct words; the ``literal_words`` most frequent of either kind (a fixed
bound, whatever the size of the corpus) are merged once and become a second literal, text -> ids.  The
second pass looks every chunk up, else its words, and folds the merges in place for a word beyond the
literal, so that nothing is shuffled but the counts.
"""

from __future__ import annotations

import base64
import json
import os
import zlib
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.runtime import cut

#: Folder of the vocabulary files; they are read from there and never copied.
TOKENIZER_DIR = os.environ.get("TIDEWATCH_TOKENIZERS", "/opt/tokenizers")

#: The pre-tokeniser's pattern of the public byte-level vocabularies, with white space
#: spelled out as Unicode's White_Space (Java's \s is ASCII only).
_WS = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}++| ?\p{N}++| ?[^" + _WS + r"\p{L}\p{N}]++|[" + _WS + r"]+(?![^" + _WS + r"])|[" + _WS + "]+"
)
#: Every character of White_Space, for the check of what precedes a space.
WHITE = [*map(chr, range(9, 14)), " ", "\x85", "\xa0", "\u1680", *map(chr, range(0x2000, 0x200B)), "\u2028", "\u2029", "\u202f", "\u205f", "\u3000"]
#: Buckets of a literal map, and the bound on the words that are put into one.
BUCKETS = 1 << 15
LITERAL_WORDS = 1 << 15


def load_ranks(name: str = "byte_bpe_50k", folder: str | None = None) -> dict[bytes, int]:
    with open(os.path.join(folder or TOKENIZER_DIR, f"{name}.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _bucketed_literal(entries: dict[str, object], value_type: str, buckets: int = BUCKETS) -> Column:
    """``entries`` (at most a fixed number) as a literal array<map<string, value_type>>, by crc32 of the key."""
    out: list[dict] = [{} for _ in range(buckets)]
    for k, v in entries.items():
        out[zlib.crc32(k.encode()) % buckets][k] = v
    text = json.dumps(out, ensure_ascii=False, separators=(",", ":"))
    return F.from_json(F.lit(text), f"array<map<string,{value_type}>>")


def _probe(literal: Column, key: Column, buckets: int = BUCKETS) -> Column:
    return F.try_element_at(F.get(literal, (F.crc32(key) % buckets).cast("int")), key)


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with ``value`` put into the plan once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def rank_literal(ranks: dict[bytes, int]) -> Column:
    """The whole vocabulary, keyed by the hexadecimal form of the bytes."""
    return _bucketed_literal({k.hex().upper(): v for k, v in ranks.items()}, "int")


def bpe_ids(word: Column, ranks: Column) -> Column:
    """Ids of one word of the pattern, by folding ranked merges over its bytes.

    The state is the array of pieces.  A step finds the adjacent pair of least rank (the leftmost of
    equals) and joins it; a state without a mergeable pair stays as it is.  At most n-1 steps are needed.
    """
    none = F.lit(2147483647)

    def step(parts: Column, _: Column) -> Column:
        found = F.transform(
            F.sequence(F.lit(0), F.size(parts) - 2),
            lambda i: F.coalesce(_probe(ranks, F.concat(F.get(parts, i), F.get(parts, i + 1))), none),
        )

        def join(r: Column) -> Column:
            at = F.array_position(r, F.array_min(r)).cast("int")
            return F.when(F.array_min(r) == none, parts).otherwise(
                F.concat(
                    F.slice(parts, F.lit(1), at - 1),
                    F.array(F.concat(F.get(parts, at - 1), F.get(parts, at))),
                    F.slice(parts, at + 2, F.size(parts)),
                )
            )

        return F.when(F.size(parts) < 2, parts).otherwise(_bind(found, join))

    def merge(hexed: Column) -> Column:
        pieces = F.transform(F.sequence(F.lit(1), F.length(hexed), F.lit(2)), lambda i: F.substring(hexed, i, F.lit(2)))
        merged = _bind(pieces, lambda p: F.aggregate(F.sequence(F.lit(2), F.greatest(F.size(p), F.lit(2))), p, step))
        return F.transform(merged, lambda q: _probe(ranks, q))

    return _bind(F.hex(F.encode(word, "UTF-8")), lambda h: F.when(_probe(ranks, h).isNull(), merge(h)).otherwise(F.array(_probe(ranks, h))))


def words_of(text: Column, pattern: str = WORD_PATTERN) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def chunks_of(text: Column) -> Column:
    """Pieces of the text, in order and without loss, that can be encoded one by one."""
    odd = reduce(or_, [F.contains(text, F.lit(c + " ")) for c in WHITE])
    return F.when(odd, words_of(text)).otherwise(F.transform(F.split(text, " "), lambda c, i: F.when(i == 0, c).otherwise(F.concat(F.lit(" "), c))))


def chunk_ids(chunk: Column, known: Column, ranks: Column) -> Column:
    """Ids of a chunk: looked up whole, else word by word, else by folding the merges of the word."""
    by_word = F.transform(words_of(chunk), lambda w: F.coalesce(_probe(known, w), bpe_ids(w, ranks)))
    return F.coalesce(_probe(known, chunk), F.flatten(by_word))


def _most(counted: DataFrame, key: str, limit: int) -> DataFrame:
    """The ``limit`` most frequent keys, ties by key, spread over the cluster again."""
    return counted.orderBy(F.desc("n"), key).limit(limit).repartition(max(8, counted.sparkSession.sparkContext.defaultParallelism), key)


def frequent_ids(docs: DataFrame, text: str, ranks: dict[bytes, int], literal_words: int) -> dict[str, list[int]]:
    """Ids of the most frequent words and chunks of the corpus; at most twice ``literal_words`` rows reach the driver."""
    chunks = docs.select(F.explode(chunks_of(F.col(text))).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    chunks = cut(chunks)
    words = chunks.select(F.explode(words_of(F.col("c"))).alias("w"), "n").groupBy("w").agg(F.sum("n").alias("n"))
    known = dict(_most(words, "w", literal_words).select("w", _bind(rank_literal(ranks), lambda r: bpe_ids(F.col("w"), r)).alias("ids")).collect())
    both = F.struct(_bucketed_literal(known, "array<int>").alias("known"), rank_literal(ranks).alias("ranks"))
    whole = _most(chunks, "c", literal_words).select("c", _bind(both, lambda b: chunk_ids(F.col("c"), b["known"], b["ranks"])).alias("ids"))
    return known | dict(whole.collect())


def encode(df: DataFrame, key: str, text: str, ranks: dict[bytes, int] | None = None, literal_words: int = LITERAL_WORDS) -> DataFrame:
    """(key, ids): the ids of each text.

    Null and empty texts give an empty list; blank texts are encoded like any other; strings that look
    like special tokens are ordinary text.  One row comes out for each row that comes in; other columns
    are ignored.
    """
    ranks = ranks or load_ranks()
    docs = df.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    known = _bucketed_literal(frequent_ids(docs, "t", ranks, literal_words), "array<int>")
    both = F.struct(known.alias("known"), rank_literal(ranks).alias("ranks"))
    ids = _bind(both, lambda b: F.flatten(F.transform(chunks_of(F.col("t")), lambda c: chunk_ids(c, b["known"], b["ranks"]))))
    return docs.select(F.col("k").alias(key), ids.alias("ids"))


def decode(df: DataFrame, key: str, ids: str, ranks: dict[bytes, int] | None = None) -> DataFrame:
    """(key, text): the binary pieces of the ids, put together and read as UTF-8.  Null ids give null, no ids ''."""
    by_id = {v: k for k, v in (ranks or load_ranks()).items()}
    pieces = F.split(F.lit(",".join(by_id.get(i, b"").hex() for i in range(max(by_id) + 1))), ",")
    hexed = F.array_join(F.transform(F.col(ids), lambda i: F.get(pieces, i)), "")
    return df.select(F.col(key), F.decode(F.unhex(hexed), "UTF-8").alias("text"))
