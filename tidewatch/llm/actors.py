"""Problem 5: variant spellings of the names of firms, universities, institutes and persons.

Trie join.  Every name is brought to a few readings: its kind, its proper word and its other words, in each
order that the kind allows.  Distinct proper words are joined on what is left of them when up to as many letters
are taken out as they may have edits: words within the bound share such a rest, wherever the edits are.  Each word
has a shard with the readings of all its neighbours; there a trie of the words is built and a Levenshtein automaton
walked down it.  A transposition of neighbouring letters is one edit.  Pairs are then checked on their other words:
abbreviations, initials, nicknames, legal forms and order.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.graph import components
from tidewatch.runtime import cut

BOUND = 2
#: Legal forms; words of institutes and universities; words that say nothing.
LEGAL = set("aktiebolag aktiengesellschaft ab ag as asa bv co corp corporation company gmbh group holding inc incorporated kg kk kgaa limited llc llp lp ltd nv oy oyj plc pte pty sa sarl sas se spa srl".split())
UNIVERSITY = set("university univ universitat universite universidad universidade universita uni".split())
INSTITUTE = set("institute inst institut instituto istituto".split())
SMALL = set("of for the and de der des del di da do für fur et y e la le".split())
TITLES = set("dr prof professor mr mrs ms ing dipl phd herr frau".split())
#: What follows the name of a university.
UNIT = re.compile(r",\s*\b(?:dept|department|faculty|school|chair|lab|laboratory)\b\.?.*$", re.I)
#: Nicknames and what they stand for.
NICK = {}
for _line in """alex alexander sasha; ben benjamin; bill will william; bob rob robert; cathy kate katherine; chris christopher; dan daniel; dave david; dick richard rick;
ed eddie edward ted; ted theodore; liz beth elizabeth lisa; fran frank francis francisco paco; gabi gaby gabriela gabriella; gus gustav; harry henry; hetty henrietta etta; jack john; hans johannes; jim james; joe joseph; klaus nikolaus nick nicolaus;
len leo leonard; lucy lucie; maggie peggy meg margaret; max maximilian; mike michael; mischa mikhail; nick nicholas; pete peter; pip philippa pippa; sam samuel; steve stephen; sue susan; theo theodore; tom thomas; tony antonio anthony;
val valja valentin valentine; vicky victoria tori; zach zack zacharias; zenia yevgenia zhenya; isa bella isabella; olli otto ottokar; pino giuseppe beppe;
uschi ulla ursula; kathi kathe katharina; uli ulli rike ulrike; jackie jacqueline; betty elizabeth; ned edward; niko nikolaus; kit christopher; pancho francisco; lenny leonard; hattie henrietta""".replace("\n", " ").split(";"):
    _w = _line.split()
    for _a in _w:
        NICK.setdefault(_a, set()).update(_w)


def fold(text: str) -> str:
    """Small letters without accents; ä ö ü ø written out or not come out the same."""
    t = text.lower().replace("ß", "ss").replace("ø", "o").replace("æ", "ae").replace("œ", "oe").replace("ł", "l").replace("đ", "d")
    return "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))


def _tokens(name: str) -> list[str]:
    name = re.sub(r"\b(?:\w\.){1,4}\w?\.?\s*$", lambda m: x if (x := re.sub(r"[.\s]", "", m.group())).lower() in LEGAL else m.group(), name)
    t = re.sub(r"(?<=[a-zß-ÿ])(?=[A-ZÀ-Þ][a-zß-ÿ])", " ", re.sub(r"\b(\w)\.(\w)\.(\w\.?)?", r"\1\2\3 ", name) if re.search(r"\b[SBN]\.\w\.", name) else name)
    return [w for w in re.split(r"[^\w']+", fold(t)) if w]


def read(name: str, common: frozenset[str] = frozenset(), trades: frozenset[str] = frozenset()) -> tuple[str, list[tuple[str, tuple[str, ...]]]]:
    """Kind of actor, and readings of the name as (proper word, other words).

    ``common``: words of a large share of all names, which are never the proper word: given names, fields.
    ``trades``: words that tell what a firm does, as learnt from names with a legal form.
    A firm's legal form is kept as the last of the other words, with a leading '='.
    """
    cut = UNIT.sub("", name)
    w = [x for x in _tokens(cut) if x not in TITLES]
    at = next((i for i, x in enumerate(w) if x in UNIVERSITY), None)
    if at is not None:
        before, after = ([x for x in part if x not in SMALL | UNIVERSITY] for part in (w[:at], w[at + 1 :]))
        of = w[at + 1 : at + 2] and w[at + 1] in SMALL
        return "u", [(x, ()) for x in (after[:1] if after and (of or not before) else before[-1:])]
    acronym = re.search(r"(?<=\s)I[A-Z]{1,4}$|^I[A-Z]{1,4}(?=\s)", cut.strip())
    if any(x in INSTITUTE for x in w) or acronym and not cut.isupper() and len(w) == 2:
        p = [x for x in w if x not in INSTITUTE | SMALL]
        if acronym and not cut.isupper() and len(w) == 2:
            short = acronym.group().lower()
            return "i", [(x, tuple(f"+{c}" for c in short[1:])) for x in p if x != short]
        proper = [x for x in p if x not in common] or p
        return "i", [(x, tuple(y for y in p if y != x)) for x in proper]
    core = [x for x in w if x not in LEGAL] or w
    if not core:
        return "f", []
    form = tuple(f"={x}" for x in w if x in LEGAL and x not in ("group", "holding"))[-1:]
    firm = len(core) == 1 or len(core) < len(w) or any(x in trades or any(_abbr(x, t) for t in trades if len(x) > 3) for x in core)
    if firm and core:
        proper = [x for x in core if x not in trades and (x not in common or len(core) == 1) and not any(len(x) > 3 and t.startswith(x) for t in trades)] or core[:1]
        return "f", [(x, tuple(y for y in core if y != x) + form) for x in proper]
    first = re.match(r"\s*([^,]+),", name)
    raw = cut.split()
    if first and _tokens(first.group(1)):
        last = _tokens(first.group(1))[-1]
    elif len(core[-1]) <= 2 or (len(raw) > 1 and len(core[0]) > 2 and raw[0].isupper() and not raw[-1].isupper()):
        last = core[0]
    else:
        last = core[-1]
    proper = [last] if len(last) > 2 else []
    return "p", [(x, tuple(y for y in core if y != x)) for x in proper]


def _abbr(a: str, b: str) -> bool:
    """Whether one word is an abbreviation of the other, by its first letters."""
    return len(min(a, b, key=len)) >= 3 and (a.startswith(b) or b.startswith(a))


def edits(a: str, b: str, bound: int = BOUND) -> int:
    """Damerau-Levenshtein distance, or bound + 1 beyond the bound."""
    if abs(len(a) - len(b)) > bound:
        return bound + 1
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, now[-1] + 1, one[j - 1] + (x != y))
            if two and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            now.append(d)
        two, one = one, now
        if min(one) > bound:
            return bound + 1
    return one[-1]


def allowed(word: str) -> int:
    """Edits that a proper word of this length may have."""
    return 0 if len(word) < 4 else 1 if len(word) < 9 else 2


class Trie:
    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, word: str) -> None:
        node = self.root
        for c in word:
            node = node.setdefault(c, {})
        node[""] = word

    def near(self, word: str, bound: int) -> Iterator[str]:
        """Words within ``bound`` edits, by walking the automaton's rows down the trie."""
        first = list(range(len(word) + 1))
        stack = [(self.root, first, None, "")]
        while stack:
            node, row, above, last = stack.pop()
            for c, child in node.items():
                if c == "":
                    if row[-1] <= bound:
                        yield child
                    continue
                now = [row[0] + 1]
                for j, y in enumerate(word, 1):
                    d = min(row[j] + 1, now[-1] + 1, row[j - 1] + (c != y))
                    if above and j > 1 and c == word[j - 2] and last == y:
                        d = min(d, above[j - 2] + 1)
                    now.append(d)
                if min(now) <= bound:
                    stack.append((child, now, row, c))


def _same_word(a: str, b: str) -> bool:
    return a == b or _abbr(a, b) or (min(len(a), len(b)) > 3 and edits(a, b, 1) <= 1 + (min(len(a), len(b)) > 8) * 0)


def _given(a: tuple[str, ...], b: tuple[str, ...]) -> bool:
    """Whether the given names of two persons of like surname can be one person's: initials, nicknames, typing errors."""
    x, y = a[0], b[0]
    if len(x) <= 2 or len(y) <= 2:
        lead = {n[0] for n in NICK.get(x, {x})} | {x[0]}
        return y[0] in lead or x[0] in {n[0] for n in NICK.get(y, {y})}
    return x == y or y in NICK.get(x, ()) or edits(x, y, 1) <= 1 or bool(NICK.get(x, set()) & NICK.get(y, set()) & {n for n in NICK if len(n) > 4}) or (_abbr(x, y) and len(min(x, y, key=len)) >= 3)


def agree(kind: str, p: str, a: tuple[str, ...], q: str, b: tuple[str, ...]) -> bool:
    """Whether two readings whose proper words are alike name one actor."""
    if kind == "u":
        return True
    if kind == "i":
        if any(x[0] == "+" for x in a + b):
            lead = lambda c: [x[1] if x[0] == "+" else x[0] for x in c]
            return sorted(lead(a)) == sorted(lead(b))
        return bool(a) and bool(b) and all(any(_same_word(x, y) for y in b) for x in a) and all(any(_same_word(x, y) for y in a) for x in b)
    if kind == "f":
        x, y = _trade(a), _trade(b)
        if not x or not y:
            return not (set(a) - set(x)) or not (set(b) - set(y)) or set(a) - set(x) == set(b) - set(y)
        return all(any(_same_word(s, t) for t in y) for s in x) or all(any(_same_word(s, t) for t in x) for s in y)
    return bool(a) and bool(b) and _given(a, b)


def _trade(words: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(w for w in words if w[0] != "=")


def vague(kind: str, words: tuple[str, ...]) -> bool:
    """Whether a reading can fit several actors: a firm without its trade, a person by initials."""
    return not _trade(words) if kind == "f" else kind == "p" and (not words or len(words[0]) <= 2)


def learn(names: DataFrame, name: str, share: float = 0.002, least: int = 30, trade_share: float = 0.0005) -> tuple[frozenset[str], frozenset[str]]:
    """Common words and trades of the distinct names.

    Common words are in more than ``share`` of all names (and ``least`` of them).  A trade stands behind the first
    word in at least ``trade_share`` of all names, with a legal form among these, and is seldom a first word.  Of
    either there can be at most (words of a name) / share.
    """
    n = names.count()

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for x in b["n"]:
                w = _tokens(x)
                legal = any(y in LEGAL for y in w[1:]) and not any(y in UNIVERSITY | INSTITUTE for y in w)
                out += [(y, i == 0, legal and i > 0) for i, y in enumerate(dict.fromkeys(w))]
            yield pd.DataFrame(out, columns=["w", "first", "legal"])

    words = names.select(F.col(name).alias("n")).mapInPandas(split, "w string, first boolean, legal boolean")
    words = cut(words.groupBy("w").agg(F.count(F.lit(1)).alias("n"), F.count_if("first").alias("first"), F.count_if("legal").alias("legal")))
    common = words.filter(F.col("n") > max(least, share * n)).select("w").collect()
    trades = words.filter((F.col("legal") >= 1) & (F.col("n") - F.col("first") >= trade_share * n) & (F.col("first") < 0.2 * F.col("n")) & (F.length("w") > 3)).select("w").collect()
    return frozenset(r["w"] for r in common), frozenset(r["w"] for r in trades) - LEGAL - SMALL - UNIVERSITY - INSTITUTE


def _rests(word: str) -> set[str]:
    """The word with up to ``allowed`` letters taken out."""
    out = last = {word}
    for _ in range(allowed(word)):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out = out | last
    return out


def neighbours(kind: str, rows: list[tuple[int, str, tuple[str, ...]]], centre: str | None = None) -> set[tuple[int, int]]:
    """Links within one shard of (key, proper word, other words).

    A vague reading is linked to full ones only where all that it fits agree among themselves.  ``centre``: the
    word whose neighbours the shard holds; only its own readings are linked, as those of others aren't whole here.
    """
    trie, at = Trie(), defaultdict(lambda: defaultdict(list))
    for k, p, rest in rows:
        at[p][rest].append(k)
    for p in at:
        trie.add(p)
    out: set[tuple[int, int]] = set()
    fits: dict[tuple[str, tuple], list[tuple[str, tuple]]] = defaultdict(list)

    def link(a: list[int], b: list[int]) -> None:
        k = min(a + b)  # readings are linked to their least key, not all to all
        out.update((k, m) for m in a + b if m != k)

    for p in at if centre is None else [centre]:
        for q in trie.near(p, allowed(p)):
            if (q > p and centre is None) or allowed(q) < edits(p, q):
                continue
            for a, mine in at[p].items():
                for b, theirs in at[q].items():
                    if ((p, a) >= (q, b) or (centre is not None and p != q)) and agree(kind, p, a, q, b):
                        va, vb = vague(kind, a), vague(kind, b)
                        if va == vb:
                            link(mine, theirs)
                        elif va:
                            fits[p, a].append((q, b))
                        elif centre is None or q == centre:
                            fits[q, b].append((p, a))
    for (p, a), full in fits.items():
        if all(agree(kind, *full[0], *other) for other in full[1:]):
            for q, b in full:
                link(at[p][a], at[q][b])
    return out


def links(df: DataFrame, key: str, name: str) -> DataFrame:
    """(a, b): names of one actor, by least key of each distinct name.  Null and blank names link to nothing."""
    rows = df.filter(F.length(F.trim(name)) > 0).select(F.col(key).alias("k"), F.trim(F.regexp_replace(name, r"\s+", " ")).alias("n"))
    reps = rows.groupBy("n").agg(F.min("k").alias("k"))

    common, trades = learn(reps, "n")

    def shard(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for n, k in zip(b["n"], b["k"]):
                kind, readings = read(n, common, trades)
                for p, rest in readings:
                    out.append((kind + p, k, p, " ".join(rest)))
                if m := re.fullmatch(r"U\.\s+(\w+)", n):  # a person's initial, or a university
                    out.append(("u" + fold(m.group(1)), k, fold(m.group(1)), ""))
            yield pd.DataFrame(out, columns=["w", "k", "p", "rest"])

    def rests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(w[0] + x, w) for w in b["w"] for x in _rests(w[1:])], columns=["h", "w"])

    def near_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[[edits(x[1:], y[1:]) <= min(allowed(x[1:]), allowed(y[1:])) for x, y in zip(b["shard"], b["w"])]]

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Shards come one after the other; each is joined when the next one begins."""
        held, rows = None, []
        for b in batches:
            out: set[tuple[int, int]] = set()
            for s, k, p, rest in zip(b["shard"], b["k"], b["p"], b["rest"]):
                if s != held:
                    out |= neighbours(held[0], rows, held[1:]) if held else set()
                    held, rows = s, []
                rows.append((k, p, tuple(rest.split())))
            yield pd.DataFrame(sorted(out), columns=["a", "b"])
        if held:
            yield pd.DataFrame(sorted(neighbours(held[0], rows, held[1:])), columns=["a", "b"])

    kind = df.schema[key].dataType.simpleString()
    readings = cut(reps.mapInPandas(shard, f"w string, k {kind}, p string, rest string"))
    left = readings.select("w").distinct().mapInPandas(rests, "h string, w string").select(F.xxhash64("h").alias("h"), "w")
    met = left.toDF("h", "shard").join(left, "h").select("shard", "w").distinct()
    shards = met.mapInPandas(near_words, "shard string, w string").join(readings, "w").select("shard", "k", "p", "rest")
    near = shards.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "shard").sortWithinPartitions("shard", "k").mapInPandas(join, f"a {kind}, b {kind}").distinct()
    same = rows.join(reps.select("n", F.col("k").alias("rep")), "n").filter("k <> rep").select(F.col("rep").alias("a"), F.col("k").alias("b"))
    return near.unionAll(same)


def actors(df: DataFrame, key: str, name: str) -> DataFrame:
    """(key, actor): the least key among the rows of one actor, for rows that have a fellow."""
    return components(links(df, key, name)).select(F.col("node").alias(key), F.col("root").alias("actor"))


def found(discovered_actors: DataFrame) -> DataFrame:
    """All pairs of rows that name the same actor."""
    a = actors(discovered_actors, "actor_id", "name")
    x, y = a.select(F.col("actor_id").alias("actor_id_a"), "actor"), a.select(F.col("actor_id").alias("actor_id_b"), "actor")
    return x.join(y, "actor").filter("actor_id_a < actor_id_b").select("actor_id_a", "actor_id_b").distinct()
