"""Query generation from target lists: templates per source, union, ordered distinct."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Templates of each source for keywords, solo keywords, organisations and topics; None leaves a list out.
TEMPLATES: dict[str, tuple[str | None, str | None, str | None, str | None]] = {
    "openalex": ('"%s"', '"%s"', '"%s"', '"%s"'),
    "crossref": ("%s", "%s", "%s", "%s"),
    "hal": ('"%s"', '"%s"', '"%s"', '"%s"'),
    "semantic_scholar": ("%s", "%s", "%s", "%s"),
    "arxiv": ('ti:"%1$s" OR abs:"%1$s"', 'ti:"%1$s" OR abs:"%1$s"', 'all:"%s"', 'ti:"%1$s" OR abs:"%1$s"'),
    "web": ('"%s" research academic', '"%s" research academic', '"%s" PVD CVD ALD coating publication', '"%s" thin film deposition innovation'),
    "patents": ('"%s"', '"%s"', 'assignee:"%s"', '"%s"'),
    "europepmc": ('"%s"', '"%s"', None, '"%s"'),
    "base": ('"%s"', '"%s"', '"%s"', '"%s"'),
    "openaire": ("%s", "%s", None, "%s"),
    "jstage": ("%s", "%s", None, "%s"),
}
#: What each source is asked besides the targets.
BASE: dict[str, tuple[str, ...]] = {
    "openalex": ('"physical vapor deposition"', '"chemical vapor deposition"', '"atomic layer deposition"', '"magnetron sputtering" OR HiPIMS', '"thin film coating" OR "hard coating" OR DLC', '"surface treatment" tribology'),
    "crossref": ("physical vapor deposition", "chemical vapor deposition", "atomic layer deposition", "magnetron sputtering", "HiPIMS", "thin film coating", "hard coating", "DLC coating"),
    "hal": ('"physical vapor deposition" OR "dépôt physique"', '"chemical vapor deposition" OR "dépôt chimique"', '"atomic layer deposition" OR "dépôt par couche atomique"', '"magnetron sputtering" OR "pulvérisation magnétron"', '"thin film coating" OR "couche mince"', '"hard coating" OR "revêtement dur"'),
    "semantic_scholar": ("physical vapor deposition", "chemical vapor deposition", "atomic layer deposition", "magnetron sputtering", "HiPIMS", "thin film coating", "hard coating"),
    "arxiv": tuple(f'ti:"{x}" OR abs:"{x}"' for x in ("atomic layer deposition", "physical vapor deposition", "chemical vapor deposition", "magnetron sputtering", "HiPIMS", "thin film coating", "hard coating")),
    "web": (
        '("PVD" OR "Physical Vapor Deposition" OR "magnetron sputtering" OR "HiPIMS") research publications',
        '("CVD" OR "Chemical Vapor Deposition" OR "ALD" OR "Atomic Layer Deposition") academic breakthroughs',
        '("thin film" OR "coating" OR "DLC" OR "hard coating") materials science innovation',
        '("surface treatment" OR "tribology" OR "wear resistance") industrial coating research',
    ),
    "patents": ('"physical vapor deposition"', '"chemical vapor deposition"', '"atomic layer deposition"', '"magnetron sputtering"', '"HiPIMS"', '"thin film coating"', '"hard coating"', '"diamond-like carbon"'),
    "europepmc": ('"physical vapor deposition"', '"chemical vapor deposition"', '"atomic layer deposition"', '"magnetron sputtering"', '"thin film coating"'),
    "base": ('"physical vapor deposition"', '"chemical vapor deposition"', '"atomic layer deposition"', '"magnetron sputtering"', '"thin film coating"'),
    "openaire": ("physical vapor deposition", "chemical vapor deposition", "atomic layer deposition", "magnetron sputtering", "thin film coating"),
    "jstage": ("physical vapor deposition", "chemical vapor deposition", "atomic layer deposition", "magnetron sputtering", "thin film coating"),
}
LISTS = ("keywords", "solo_keywords", "research_orgs", "cross_domain_topics")


def ordered_distinct(df: DataFrame, value: str, *order: str) -> DataFrame:
    """Distinct values in the order in which they first come: (value, place)."""
    return df.groupBy(value).agg(F.min(F.struct(*order)).alias("place"))


def build(targets: DataFrame, source: str, base: tuple[str, ...] | None = None) -> DataFrame:
    """(query, place): queries of one source, its base queries first; empty if both keyword lists are empty.

    ``targets`` has (list_name, pos, term).  Google News joins every company with every keyword; this cross
    product of two short lists is what the source needs.
    """
    t = targets.filter(F.length(F.trim("term")) > 0)
    parts = t.sparkSession.createDataFrame([(0, i, q) for i, q in enumerate(BASE.get(source, ()) if base is None else base)], "part int, pos int, query string")
    if source == "gnews":
        fix = F.replace(F.col("term"), F.lit("Chemical Layer Deposition"), F.lit("Chemical Vapor Deposition"))
        kw = t.filter("list_name = 'keywords'").select(F.col("pos").alias("kp"), fix.alias("kw"))
        co = t.filter("list_name = 'companies'").select(F.col("pos").alias("cp"), F.col("term").alias("co"))
        cross = co.join(F.broadcast(kw)).select(F.lit(1).alias("part"), (F.col("cp") * 100000 + F.col("kp")).alias("pos"), F.format_string('"%s" "%s"', "co", "kw").alias("query"))
        solo = t.filter("list_name = 'solo_keywords'").select(F.lit(2).alias("part"), "pos", F.format_string('"%s"', "term").alias("query"))
        parts = parts.unionByName(cross).unionByName(solo)
    else:
        for i, (name, template) in enumerate(zip(LISTS, TEMPLATES[source]), 1):
            if template:
                parts = parts.unionByName(t.filter(F.col("list_name") == name).select(F.lit(i).alias("part"), "pos", F.format_string(template, "term").alias("query")))
    out = ordered_distinct(parts, "query", "part", "pos")
    any_keyword = t.filter(F.col("list_name").isin("keywords", "solo_keywords")).select(F.lit(1).alias("_x")).limit(1)
    return out.join(F.broadcast(any_keyword), F.lit(True), "left_semi")


def request_counts(targets: DataFrame, per_source: int, batch_size: int = 30) -> DataFrame:
    """One row: requests of each source for a run, the articles and scoring batches to expect, and hours it takes."""
    n = {c: F.count_if(F.col("list_name") == c) for c in ("companies", *LISTS)}
    one = targets.filter(F.length(F.trim("term")) > 0).agg(*(v.alias(k) for k, v in n.items()))
    news = F.col("companies") * F.col("keywords") + F.col("solo_keywords")
    extra = F.col("keywords") + F.col("solo_keywords") + F.col("research_orgs") + F.col("cross_domain_topics")
    raw = F.lit(per_source * 5 + 100) + news * 5 + (F.col("research_orgs") + F.col("cross_domain_topics")) * 8
    hours = F.when(news == 0, 0.0).when(news < 50, news * 0.04).when(news < 150, news * 0.045).when(news < 300, news * 0.05 + 5.0).otherwise(news * 0.055 + 5.0)
    other = (1.0 + per_source * 0.02 + (per_source * 5 + 100) * 0.7 / 30 * 0.5 + 5.0) / 60.0
    sources = ("arxiv", "openalex", "crossref", "hal", "semantic_scholar", "web", "patents")
    return one.select(
        F.lit(5).cast("bigint").alias("rss"), *((extra + len(BASE[s])).alias(s) for s in sources), news.alias("gnews"), raw.alias("raw_articles"),
        F.greatest(F.lit(3), F.floor(raw * 0.7 / batch_size)).alias("batches"), F.round(hours, 6).alias("news_hours"), F.lit(round(other, 6)).alias("other_hours"),
    )
