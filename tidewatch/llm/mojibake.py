"""Problem 3: text read with a wrong character encoding.

Round-trip repair.  Runs of characters that a legacy encoding could have made of other bytes are
re-encoded in it and strictly decoded as the intended encoding; a step is kept where the garbling cost of
the text drops, and steps are repeated for nested layers.  Values of plain ASCII are settled by one look.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Wrong encodings that text of these languages is commonly read with, UTF-8 being meant.
LEGACY = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "cp1250", "iso8859-15", "koi8_r", "cp866")
#: Single-byte pairs (read as, meant) that leave letters of another script inside words.
SINGLE = (("cp1251", "cp1252"), ("koi8_r", "cp1252"), ("cp866", "cp850"))

#: Bytes 0x80 to 0xBF as latin-1 and cp1252 show them.
_TAIL = "\x80-\xbfŒœŠšŸŽžƒˆ˜‚„†‡‰‹›‘’“”•–—€™"
#: Characters that no text has but by accident, and box drawing that touches a letter.
ODD = re.compile("[\x7f-\x9f�]|(?<=[^\\W\\d_])[─-▟]|[─-▟](?=[^\\W\\d_])")
#: Letters of two scripts in one word; a Cyrillic letter alone, with no Cyrillic word beside it; one before a sign.
MIXED = re.compile("[A-Za-zÀ-ɏ][Ѐ-ԯ]|[Ѐ-ԯ][A-Za-zÀ-ɏ]|(?<![Ѐ-ԯ])(?<![Ѐ-ԯ] )[Ѐ-ԯ](?![Ѐ-ԯ])(?! [Ѐ-ԯ])|[Ѐ-ԯ][†‡€‰¤¦§©®±µ¶·‚„ˆ]|вЂ[^\\s]")
#: A letter that opens a multi-byte sequence when UTF-8 is read as a single-byte encoding, and what may follow it.
PAIR = re.compile(f"[\xc2\xc3\xc5\xe2\xe3\xce\xcf¬√][\x80-\xbfŒœŠšŸŽžƒˆ˜–-›€™∞\xc4-\xff]|√[^\x00-\x7f]|‚Ä|(?:[\xd0\xd1\xd7\xd8\xd9][{_TAIL}]){{2}}|\xf0[{_TAIL}]{{3}}|[\xea-\xed][{_TAIL}]{{2}}")
SUSPECT = re.compile(f"[\x7f-\x9f�Ѐ-ԯ─-▟]|{PAIR.pattern}|[\xe4-\xe9][\x80-\xbfŒ-ƒˆ˜–-›€™]{{2}}")
#: What SUSPECT can begin with, and that its second character isn't ASCII: one set, which is searched fast.
_QUICK = re.compile("[\x7f-\x9f�Ѐ-ԯ─-▟\xc2\xc3\xc5\xe2-\xed\xce\xcf¬√‚\xd0\xd1\xd7\xd8\xd9\xf0](?:(?<=[\x7f-\x9f�Ѐ-ԯ─-▟])|[^\x00-\x7f])")
_PLAUSIBLE = re.compile("[ˆ˜\x20-\x7e\xa0-ɏΆ-ώЁ-џא-תء-ي‐-⁄⁴-ₜ₠-₿℀-⋿■-◿　-ヿ㐀-鿿가-힣＀-￯\U0001f300-\U0001faff]")


def _byte(ch: str, encoding: str) -> int | None:
    try:
        b = ch.encode(encoding)
        return b[0] if len(b) == 1 else None
    except UnicodeEncodeError:
        return ord(ch) if encoding.startswith("cp125") and 0x80 <= ord(ch) < 0xA0 else None


@lru_cache(None)
def _table(encoding: str) -> tuple[re.Pattern, dict[str, int]]:
    """Pattern of UTF-8 sequences as ``encoding`` shows them, and the byte of each of its upper characters."""
    back: dict[str, int] = {}
    for b in range(0x80, 0x100):
        try:
            back[bytes([b]).decode(encoding)] = b
        except UnicodeDecodeError:
            back[chr(b)] = b
    kind = lambda lo, hi: "[" + re.escape("".join(c for c, b in back.items() if lo <= b <= hi)) + "]"
    tail = kind(0x80, 0xBF)
    return re.compile(f"(?:{kind(0xC2, 0xDF)}{tail}|{kind(0xE0, 0xEF)}{tail}{{2}}|{kind(0xF0, 0xF4)}{tail}{{3}})+"), back


def cost(text: str) -> int:
    """Garbling cost, whatever the language: stray characters, words of two scripts, and sequences that a wrong reading of UTF-8 leaves."""
    return 4 * len(ODD.findall(text)) + 4 * len(MIXED.findall(text)) + 3 * len(PAIR.findall(text)) + sum(1 for _ in re.finditer("[a-z\xdf-\xf6][\xc0-\xd6∀-⋿]", text))


def _decode(text: str, encoding: str) -> str:
    pattern, back = _table(encoding)

    def one(m: re.Match) -> str:
        try:
            out = bytes(back[c] for c in m.group()).decode("utf-8")
        except UnicodeDecodeError:
            return m.group()
        return out if all(_PLAUSIBLE.match(c) or 0x80 <= ord(c) < 0xA0 for c in out) else m.group()

    return pattern.sub(one, text)


_BOTH = re.compile("(?=[^\\W\\d_]*[A-Za-zÀ-ɏ])(?=[^\\W\\d_]*[Ѐ-ԯ])[^\\W\\d_]+|(?<![Ѐ-ԯ])(?<![Ѐ-ԯ] )[Ѐ-ԯ](?![Ѐ-ԯ])(?! [Ѐ-ԯ])")
_FOREIGN = re.compile("[Ѐ-ԯ]")


def _single(text: str, read: str, meant: str) -> str:
    """Letters of another script taken back, in words that have letters of two scripts or are one such letter."""

    def one(m: re.Match) -> str:
        try:
            return m.group().encode(read).decode(meant)
        except UnicodeError:
            return m.group()

    return _BOTH.sub(lambda w: _FOREIGN.sub(one, w.group()), text)


def suspect(text: str) -> bool:
    m = _QUICK.search(text)
    return m is not None and SUSPECT.search(text, m.start()) is not None


def repair(text: str | None) -> str | None:
    """The text as it was meant, as far as it can be restored; text without signs of garbling is returned as it is."""
    if not text or text.isascii() or not suspect(text):
        return text
    while now := cost(text):  # a layer at a time, as long as the cost drops
        tries = [_decode(text, e) for e in LEGACY] + [_single(text, *p) for p in SINGLE if re.search("[Ѐ-ԯ]", text)]
        best = min(tries, key=cost)
        if cost(best) >= now:
            break
        text = best
    return text


def garbled(text: str | None) -> bool:
    """Whether the text holds, in whole or in part, characters of a wrong encoding, restorable or not."""
    if not text or text.isascii() or not suspect(text):
        return False
    if ODD.search(text) or MIXED.search(text):
        return True
    return repair(text) != text


def restore(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, garbled, restored): one row for each affected value of ``fields``.

    Null and empty values are never affected; repeated rows come out as often as they come in; columns
    other than the key and the fields are ignored, whatever their names.
    """
    cols = [F.col(key).alias("k"), *(F.col(f).cast("string").alias(f"f{i}") for i, f in enumerate(fields))]
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, rows = b.column(0), ([], [], [], [])
            for i, name in enumerate(fields):
                for at, v in enumerate(b.column(i + 1).to_pylist()):
                    if v and not v.isascii() and garbled(v):
                        for out, x in zip(rows, (at, name, v, repair(v))):
                            out.append(x)
            at = pa.array(rows[0], pa.int64())
            yield pa.RecordBatch.from_arrays([keys.take(at), *(pa.array(r, pa.string()) for r in rows[1:])], ["k", "field", "garbled", "restored"])

    out = df.select(cols).mapInArrow(run, f"k {kind}, field string, garbled string, restored string")
    return out.withColumnRenamed("k", key)


def found(article: DataFrame) -> DataFrame:
    return restore(article, "pos", ["title", "summary"]).select("pos", "field").distinct()
