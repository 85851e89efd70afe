"""Landed files of each source -> canonical articles.

A source is data: a row tag or JSON shape, and an expression for each canonical column.  Readers use explicit
schemas, keep what they can't read as nulls, and drop rows that lack what the source requires.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.functions.text import cjk_share, inverted_text, strip_tags, text
from tidewatch.runtime import exists

ARTICLE = "pos bigint, title string, link string, summary string, source string, category string, collected_at string, published_at timestamp, tags array<string>, patent_assignee string, patent_pub_num string, patent_cpc array<string>"
CUT = 600


def _clean(c: Column, n: int | None = CUT) -> Column:
    t = F.trim(F.regexp_replace(strip_tags(c), r"\s+", " "))
    return F.substring(t, 1, n) if n else t


def _first(json: str) -> Column:
    """First element of a field that is a scalar or a list, from its raw JSON."""
    raw = F.trim(F.col(json))
    return F.when(raw.startswith("["), F.get(F.from_json(raw, "array<string>"), F.lit(0))).otherwise(F.regexp_replace(raw, '^"|"$', ""))


@dataclass(frozen=True)
class Source:
    family: str
    category: str
    schema: str
    title: Column
    link: Column
    summary: Column
    venue: Column
    required: tuple[str, ...] = ("title", "link")
    extra: dict[str, Column] = field(default_factory=dict)
    keep: Column | None = None
    xml_row: str | None = None
    explode: str | None = None


def _c(name: str) -> Column:
    return F.col(name)


def catalogue() -> dict[str, Source]:
    """All file sources by name; a function, as columns need a session."""
    doi = lambda c: F.when(F.length(F.trim(c)) > 0, F.concat(F.lit("https://doi.org/"), c))
    pubs = ("title", "patent_pub_num")
    return {
        "rss": Source("RSS", "general", "title string, link string, description string, pubDate string", _c("title"), _c("link"), _clean(_c("description"), None), F.lit("feed"), (), xml_row="item"),
        "arxiv": Source("ArXiv", "science", "id string, title string, summary string, published string", _clean(_c("title"), None), _c("id"), _clean(_c("summary"), None), F.lit("arXiv"), ("link",), xml_row="entry"),
        "gnews": Source("Google News", "news", "title string, link string, source string, pubDate string", _c("title"), _c("link"), F.lit(""), text("source"), (), xml_row="item"),
        "openalex": Source("OpenAlex", "science", "id string, doi string, title string, open_access struct<oa_url: string>, abstract_inverted_index map<string, array<int>>, primary_location struct<source: struct<display_name: string>>", _c("title"), F.coalesce("open_access.oa_url", "doi", "id"), F.when(_c("abstract_inverted_index").isNotNull(), inverted_text("abstract_inverted_index")).otherwise(""), text("primary_location.source.display_name")),
        "crossref": Source("Crossref", "science", "`title` array<string>, URL string, DOI string, abstract string, `container-title` array<string>", F.get("title", F.lit(0)), F.coalesce("URL", doi(_c("DOI"))), _clean(_c("abstract")), text(F.get("container-title", F.lit(0)))),
        "hal": Source("HAL", "science", "title_s string, uri_s string, abstract_s string, journalTitle_s string, docType_s string", _first("title_s"), _c("uri_s"), _clean(_first("abstract_s")), F.coalesce("journalTitle_s", "docType_s", F.lit("HAL"))),
        "semantic_scholar": Source("Semantic Scholar", "science", "title string, url string, abstract string, venue string, publicationDate string", _c("title"), _c("url"), _clean(_c("abstract")), text("venue")),
        "europepmc": Source("EuropePMC", "science", "title string, doi string, pmcid string, pmid string, abstractText string, journalTitle string", _c("title"), F.coalesce(doi(_c("doi")), F.concat(F.lit("https://europepmc.org/article/PMC/"), "pmcid"), F.concat(F.lit("https://europepmc.org/article/MED/"), "pmid")), _clean(_c("abstractText")), F.substring(text("journalTitle"), 1, 80)),
        "base": Source("BASE", "science", "dctitle string, dclink string, dcdescription string, dcsource string", _first("dctitle"), _first("dclink"), _clean(_first("dcdescription")), F.substring(text(_first("dcsource")), 1, 60)),
        "openaire": Source("OpenAIRE", "science", "title string, pid string, instance string, description string, journal string", _first("title"), F.coalesce(doi(_first("pid")), _first("instance")), _clean(_first("description")), text(_first("journal"))),
        "jstage": Source("J-STAGE", "science", "title string, link string, summary string, journal string", _c("title"), _c("link"), _clean(_c("summary")), text("journal"), keep=~((text("summary") != "") & (cjk_share("summary") > 0.30)), xml_row="entry"),
        "tavily": Source("Tavily", "web", "title string, url string, content string", _c("title"), _c("url"), _clean(_c("content"), None), F.coalesce(F.get(F.split("url", "/"), F.lit(2)), F.lit("web")), ("link",)),
        "patents": Source("Google Patents", "patent", "publication_number string, title string, snippet string, assignee string, priority_date string, cpc string", _c("title"), F.concat(F.lit("https://patents.google.com/patent/"), "publication_number", F.lit("/en")), F.substring(F.concat_ws(" · ", F.nullif(_clean(_c("snippet")), F.lit("")), F.concat(F.lit("["), "assignee", F.lit("]")), F.concat(F.lit("["), "priority_date", F.lit("]"))), 1, CUT), text("assignee"), pubs, {"patent_assignee": _c("assignee"), "patent_pub_num": _c("publication_number"), "patent_cpc": F.slice(F.when(_c("cpc").startswith("["), F.from_json("cpc", "array<string>")).otherwise(F.array("cpc")), 1, 5)}),
    }


def canonical(raw: DataFrame, source: Source, collected_at: str) -> DataFrame:
    """Canonical articles of raw rows in their source's shape."""
    x = raw.filter(source.keep) if source.keep is not None else raw
    pub = next((F.try_to_timestamp(F.col(c)) for c in ("publicationDate", "published") if c in raw.columns), F.lit(None).cast("timestamp"))
    x = x.select(
        text(source.title).alias("title"), source.link.alias("link"), text(source.summary).alias("summary"), F.concat_ws(" — ", F.lit(source.family), F.nullif(source.venue, F.lit(""))).alias("source"),
        F.lit(source.category).alias("category"), F.lit(collected_at).alias("collected_at"), pub.alias("published_at"), *(v.alias(k) for k, v in source.extra.items()),
    )
    for f in source.required:
        x = x.filter(F.length(F.trim(F.col(f))) > 0)
    return x


def read(spark: SparkSession, name: str, path: str, collected_at: str) -> DataFrame:
    """Articles of landed files of a source: JSON lines, or XML for feeds; unreadable records are left out."""
    source = catalogue()[name]
    if source.xml_row:
        raw = spark.read.format("xml").option("rowTag", source.xml_row).schema(source.schema).load(path)
    else:
        raw = spark.read.schema(source.schema).option("mode", "PERMISSIVE").json(path)
    return canonical(raw, source, collected_at)


def union(parts: list[DataFrame]) -> DataFrame:
    """All sources' articles, one after the other, with ``pos``."""
    out = parts[0].withColumn("_s", F.lit(0))
    for i, p in enumerate(parts[1:], 1):
        out = out.unionByName(p.withColumn("_s", F.lit(i)), allowMissingColumns=True)
    return out.withColumn("pos", F.col("_s").cast("bigint") * (1 << 48) + F.monotonically_increasing_id()).drop("_s")


def cap_per_source(df: DataFrame, n: int, order: str) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(W.partitionBy("source").orderBy(F.desc(order), "pos"))).filter(F.col("_n") <= n).drop("_n")


def load_targets(spark: SparkSession, path: str) -> DataFrame:
    """(list_name, pos, term) of a JSON of lists, each term once at its first place; a missing or broken file gives no rows."""
    schema = "companies array<string>, keywords array<string>, solo_keywords array<string>, research_orgs array<string>, cross_domain_topics array<string>"
    try:
        raw = spark.read.schema(schema).option("multiLine", True).json(path)
        raw.limit(1).collect()
    except Exception:  # noqa: BLE001 - whatever is wrong with the file, targets are then empty
        raw = spark.createDataFrame([], schema)
    stacked = raw.select(F.explode(F.array(*(F.struct(F.lit(c).alias("list_name"), F.col(c).alias("terms")) for c in raw.columns))).alias("x"))
    terms = stacked.select("x.list_name", F.posexplode("x.terms").alias("pos", "term"))
    return terms.groupBy("list_name", "term").agg(F.min("pos").alias("pos")).select("list_name", "pos", "term")


def state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A state table, or an empty one of its schema where it doesn't exist yet."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)
