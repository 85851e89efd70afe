"""Scalar text functions as column expressions.  Null texts count as empty unless a docstring says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track readers.
TRACKING_PARAMS = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "fbclid", "gclid", "mc_cid", "mc_eid", "ref", "ref_src", "igshid",
    "_ga", "yclid", "msclkid", "spm",
)
#: Words that tell a research organisation, and endings that tell a company.
LAB_WORDS = (
    "university", "université", "universidad", "universität", "universiteit", "universita",
    "institute", "institut", "instituto",
    "academy", "académie", "akademie", "academia",
    "college",
    "school of", "école", "escola",
    "laboratory", "laboratoire", "laboratorio",
    "national center", "national centre", "centre national", "centro nacional",
    "research center", "research centre", "centre de recherche",
    "polytechnic", "politecnico", "polytechnique",
    "fraunhofer", "helmholtz", "max planck", "leibniz", "cnrs", "inserm", "inria",
    "synchrotron", "observatory", "observatoire",
    "hochschule",
    " epfl ", " ethz ", " mit ", " caltech ", " kaist ",
)
COMPANY_WORDS = (
    " gmbh", " ag ", " inc", " inc.", " ltd", " ltd.", " corp", " corp.", " llc",
    " s.a.", " s.a", " b.v.", " bv", " co.", " k.k.", " pty", " s.r.l.", " s.p.a.",
    " sa ", " plc", " ab ", " oy",
    " technologies", " systems", " industries", " manufacturing",
    " coatings", " materials",
)


def text(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def normalize_url(url: str | Column) -> Column:
    """Small letters, no tracking or blank parameters, no fragment, no closing slashes; an empty path is '/'."""
    u = F.regexp_replace(F.trim(text(url)), "#.*$", "")
    base = F.regexp_extract(u, r"^([^?]*)", 1)
    host = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/]*)", 1)
    path = F.regexp_replace(F.substring(base, F.length(host) + 1, F.length(base)), "/+$", "")
    keep = lambda p: F.contains(p, F.lit("=")) & ~p.rlike("=$") & ~F.lower(F.substring_index(p, "=", 1)).isin(*TRACKING_PARAMS)
    query = F.array_join(F.filter(F.split(F.regexp_extract(u, r"\?(.*)$", 1), "&"), keep), "&")
    return F.lower(F.concat(host, F.when((path == "") & (host != ""), "/").otherwise(path), F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def normalize_title(title: str | Column) -> Column:
    """Without a closing outlet name, in small letters, word characters only, white space collapsed."""
    t = F.regexp_replace(F.trim(text(title)), r"\s+[-–—]\s+[^-–—]{1,60}$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def normalize_actor(name: str | Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(text(name))), r"\s+", " ")


def normalize_query(q: str | Column) -> Column:
    """Trimmed small letters without quotes at the ends."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(text(q))), '^"+|"+$', ""), "^'+|'+$", "")), r"\s+", " ")


def tokens(t: str | Column) -> Column:
    return F.regexp_extract_all(F.lower(text(t)), F.lit("[a-z0-9]+"), F.lit(0))


def strip_tags(t: str | Column) -> Column:
    return F.regexp_replace(text(t), "<[^>]+>", " ")


def domain(url: str | Column) -> Column:
    return F.coalesce(F.lower(F.get(F.split(text(url), "/"), F.lit(2))), F.lit("unknown"))


def cjk_share(t: str | Column) -> Column:
    """Share of characters that are CJK, kana or full-width; 0 for an empty text."""
    x = text(t)
    return F.when(F.length(x) == 0, 0.0).otherwise(F.length(F.regexp_replace(x, r"[^\x{3000}-\x{9fff}\x{ff00}-\x{ffef}]", "")) / F.length(x))


def article_id(link: str, title: str, summary: str) -> Column:
    trimmed = F.trim(text(link))
    body = F.substring(F.concat(text(title), text(summary)), 1, 500)
    return F.substring(F.md5(F.when(trimmed != "", trimmed).otherwise(body)), 1, 12)


def prompt_version(prompt: str | Column) -> Column:
    return F.substring(F.sha1(text(prompt)), 1, 8)


def epodoc(pub: str | Column) -> Column:
    """CC.NUMBER[.KIND] of a publication number; null where it isn't one."""
    p = F.trim(text(pub))
    pattern = r"^([A-Z]{2})([\d/\-]+?)([A-Z]\d?)?$"
    kind = F.regexp_extract(p, pattern, 3)
    out = F.concat(F.regexp_extract(p, pattern, 1), F.lit("."), F.regexp_replace(F.regexp_extract(p, pattern, 2), "[/\\-]", ""), F.when(kind != "", F.concat(F.lit("."), kind)).otherwise(""))
    return F.when(p.rlike(pattern), out)


def feedback_subject(subject: str | Column) -> Column:
    """struct(rating, id) of a feedback mail's subject; nulls where it isn't one."""
    pattern = r"(?i)\[FEEDBACK\]\s+rating=(up|down)\s+id=([a-f0-9]{12})"
    s = text(subject)
    part = lambda i: F.when(s.rlike(pattern), F.lower(F.regexp_extract(s, pattern, i)))
    return F.struct(part(1).alias("rating"), part(2).alias("id"))


def retry_seconds(message: str | Column) -> Column:
    """Seconds that an error message asks to wait, by the first of three spellings."""
    m = text(message)
    patterns = (r"(?i)retry in ([0-9.]+)\s*s", r"(?i)retry_delay\D*seconds:\s*([0-9]+)", r"(?i)retryDelay\"?:\s*\"?([0-9.]+)s")
    return F.coalesce(*(F.regexp_extract(m, p, 1).try_cast("double") for p in patterns))


def parse_llm(raw: str | Column) -> Column:
    """The scorer's answer as struct(tldr, retained), from bare or fenced JSON; retained is null where there is none."""
    schema = "tldr string, retained array<struct<id: int, score: int, confidence: string, justification: string, tags: array<string>>>"
    r = text(raw)
    direct, greedy = F.from_json(r, schema), F.from_json(F.regexp_extract(r, r"(?s)\{.*\}", 0), schema)
    best = F.when(direct["retained"].isNotNull(), direct).otherwise(greedy)
    conf = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c.try_cast("double"), F.lit(0.8))))
    items = F.transform(best["retained"], lambda e: F.struct(e["id"].alias("id"), e["score"].alias("score"), conf(e["confidence"]).alias("confidence"), text(e["justification"]).alias("justification"), F.coalesce(F.array_distinct(e["tags"]), F.array().cast("array<string>")).alias("tags")))
    return F.struct(text(best["tldr"]).alias("tldr"), items.alias("retained"))


#: What an executive summary is cut at, and how it may introduce itself.
SUMMARY_ENDS = r"(?s)(?:```|\{\s*\"(?:tldr|retained)\").*$"


def clean_summary(t: str | Column) -> Column:
    """Executive summary: cut at the first fence or at the scorer's JSON, without a line of introduction."""
    cut = F.trim(F.regexp_replace(text(t), SUMMARY_ENDS, ""))
    return F.trim(F.regexp_replace(cut, r"(?i)^(?:here is|here's|voici)[^:\n]{0,80}:\s*", ""))


def score_label(score: str | Column) -> Column:
    """Label of a score, empty where there is none."""
    s = F.col(score) if isinstance(score, str) else score
    return F.when(s == 5, "major").when(s == 4, "important").when(s == 3, "useful").when(s == 2, "marginal").when(s == 1, "off topic").otherwise("")


def duration(minutes: str | Column) -> Column:
    """'1 h 05' or '12 min' of a number of minutes."""
    m = F.round(F.col(minutes) if isinstance(minutes, str) else minutes).cast("bigint")
    return F.when(m >= 60, F.format_string("%d h %02d", F.floor(m / 60), m % 60)).otherwise(F.format_string("%d min", m))


def masked(secret: str | Column) -> Column:
    """First and last four characters of a secret of more than twelve, else stars alone."""
    x = text(secret)
    return F.when(F.length(x) > 12, F.concat(F.substring(x, 1, 4), F.lit("…"), F.substring(x, -4, 4))).when(x == "", "").otherwise("****")


def is_email(t: str | Column) -> Column:
    """Whether a text is one or more mail addresses, with commas between them."""
    return text(t).rlike(r"^\s*[^@\s,]+@[^@\s,]+\.[^@\s,]+(?:\s*,\s*[^@\s,]+@[^@\s,]+\.[^@\s,]+)*\s*$")


def classify_actor(name: str, sources: str) -> Column:
    """research_org or company, by words of the name, else by where it was seen."""
    n = F.concat(F.lit(" "), F.lower(text(name)), F.lit(" "))
    src = F.coalesce(F.col(sources), F.array().cast("array<string>"))
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(n, w))
    research = F.array_contains(src, "openalex") & ~F.array_contains(src, "patents")
    return F.when(has(LAB_WORDS), "research_org").when(has(COMPANY_WORDS), "company").when(research, "research_org").otherwise("company")


def ellipsis(t: str | Column, n: int = 220) -> Column:
    return F.when(F.length(text(t)) > n, F.concat(F.substring(text(t), 1, n), F.lit("…"))).otherwise(text(t))


def source_family(source: str | Column) -> Column:
    return F.get(F.split(text(source), " — "), F.lit(0))


def stars(score: str | Column) -> Column:
    s = F.col(score) if isinstance(score, str) else score
    return F.when(s.between(1, 5), F.concat(F.repeat(F.lit("★"), s), F.repeat(F.lit("☆"), 5 - s))).otherwise("")


def french_date(ts: Column) -> Column:
    days = F.array(*map(F.lit, "lundi mardi mercredi jeudi vendredi samedi dimanche".split()))
    months = F.array(*map(F.lit, "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split()))
    return F.concat_ws(" ", F.get(days, F.weekday(ts)), F.dayofmonth(ts).cast("string"), F.get(months, F.month(ts) - 1), F.year(ts).cast("string"))


def inverted_text(index: str | Column, n: int = 600) -> Column:
    """Text of a map word -> positions, cut at n characters."""
    m = F.map_entries(F.col(index) if isinstance(index, str) else index)
    placed = F.flatten(F.transform(m, lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.substring(F.array_join(F.transform(F.array_sort(placed), lambda x: x["w"]), " "), 1, n)


def mailto(address: str, subject: str | Column, body: str | Column) -> Column:
    enc = lambda c: F.replace(F.replace(F.url_encode(text(c)), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))
    return F.concat(F.lit(f"mailto:{address}?subject="), enc(subject), F.lit("&body="), enc(body))
