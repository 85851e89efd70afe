"""Counts, distributions and anomalies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.config import DEFAULT, Config
from tidewatch.functions.text import text
from tidewatch.operators.match import holding


def score_distribution(df: DataFrame, *by: str) -> DataFrame:
    """n, c1..c5, and the shares of 4-5 and of 5, over all rows."""
    c = [F.count_if(F.col("score") == k).alias(f"c{k}") for k in range(1, 6)]
    x = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *c)
    return x.withColumn("high_pct", (F.col("c4") + F.col("c5")) / F.col("n")).withColumn("five_pct", F.col("c5") / F.col("n"))


def drift(history: DataFrame, run: str, cfg: Config = DEFAULT) -> DataFrame:
    """Adds a warning where the mean of the last three runs says over- or under-scoring; none before the third run."""
    w = W.orderBy(run).rowsBetween(-2, 0)  # one row per run: a history is short
    five, high, n = F.avg("five_pct").over(w), F.avg("high_pct").over(w), F.count(F.lit(1)).over(w)
    warn = F.when(n < 3, None).when(five > cfg.drift_high, "over").when(high < cfg.drift_low, "under")
    return history.withColumn("warning", warn)


def mentions(df: DataFrame, terms: DataFrame, term: str, blob: Column, key: str = "pos") -> DataFrame:
    """(key, term): terms that a row's blob holds as a substring, once each; the list of terms is collected, blank blobs hold none."""
    rows = df.select(F.col(key), F.lower(blob).alias("_b"), F.coalesce(F.col("category") == "patent", F.lit(False)).alias("patent")).filter(F.trim("_b") != "")
    t = terms.filter(F.col(term).isNotNull()).select(F.col(term).alias("term"), F.lower(F.col(term)).alias("_t")).distinct().collect()
    return holding(rows, "_b", [(r["_t"], r["term"]) for r in t]).select(key, "term", "patent")


def mention_counts(df: DataFrame, terms: DataFrame, term: str, blob: Column) -> DataFrame:
    """(term, total, patents, others), zero-filled."""
    m = mentions(df, terms, term, blob).groupBy("term").agg(F.count(F.lit(1)).alias("total"), F.count_if("patent").alias("patents"))
    x = terms.select(F.col(term).alias("term")).distinct().join(m, "term", "left").na.fill(0, ["total", "patents"])
    return x.withColumn("others", F.col("total") - F.col("patents"))


def blob() -> Column:
    return F.concat_ws(" ", text("title"), text("summary"), text("source"), text("patent_assignee"))


def heatmap(history: DataFrame, name: str, run: str, total: str, cfg: Config = DEFAULT) -> DataFrame:
    """Adds avg of the runs before (zero-filled grid of name and run), ratio and anomaly 'up' or 'down'."""
    w = W.partitionBy(name).orderBy(run).rowsBetween(-cfg.heatmap_lookback, -1)
    avg = F.coalesce(F.avg(total).over(w), F.lit(0.0))
    cur = F.col(total)
    ratio = cur / F.greatest(F.col("avg"), F.lit(0.5))
    mark = F.when(cur < cfg.heatmap_min_mentions, None).when(ratio >= cfg.heatmap_ratio, "up").when((F.col("avg") >= 2) & (cur < 0.3 * F.col("avg")), "down")
    return history.withColumn("avg", avg).withColumn("ratio", ratio).withColumn("anomaly", mark)


def grid(df: DataFrame, run: Column, name: str, runs: DataFrame) -> DataFrame:
    """Counts of each (run, name), zero where a run has none; ``runs`` is the short list of runs."""
    names = df.select(name).distinct()
    counts = df.groupBy(run.alias("run"), name).agg(F.count(F.lit(1)).alias("total"))
    return names.crossJoin(runs).join(counts, ["run", name], "left").na.fill(0, ["total"])


def company_floor(df: DataFrame, companies: DataFrame) -> DataFrame:
    """Rows that name a listed company get a score of 4 at least, and the first listed one as a tag if they lack it; the list is collected."""
    rows = df.select("pos", F.lower(F.concat_ws(" ", text("title"), text("summary"))).alias("_b"))
    c = companies.filter("term is not null and pos is not null").select("pos", "term", F.lower("term").alias("_t")).collect()
    listed = [(r["_t"], r["term"]) for r in sorted(c, key=lambda r: r["pos"])]
    first = holding(rows, "_b", listed).groupBy("pos").agg(F.min_by("term", "i").alias("company"))
    x = df.join(first, "pos", "left")
    has = F.exists(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.lower(t) == F.lower("company"))
    tags = F.when(F.col("company").isNull() | has, F.col("tags")).otherwise(F.array_append(F.coalesce("tags", F.array().cast("array<string>")), F.col("company")))
    return x.withColumn("score", F.when(F.col("company").isNotNull(), F.greatest("score", F.lit(4))).otherwise(F.col("score"))).withColumn("tags", tags)


def judge_candidates(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Rows for a second opinion; of more than the cap, those of least confidence."""
    x = df.filter((F.col("score") >= cfg.judge_score) | (F.coalesce("confidence", F.lit(1.0)) < cfg.judge_confidence))
    return x.orderBy(F.coalesce("confidence", F.lit(1.0)), "pos").limit(cfg.judge_cap)


def consensus(df: DataFrame) -> DataFrame:
    """Joins two judges' (score, confidence) and (score_2, confidence_2): the greater score where a company is named, else their mean, half to even."""
    mean = F.bround((F.col("score") + F.col("score_2")) / 2).cast("int")
    both = F.when(F.col("company").isNotNull(), F.greatest("score", "score_2")).otherwise(mean)
    return df.withColumn("final", F.coalesce(both, F.col("score"))).withColumn("judge_2_rejected", F.col("score_2").isNull()).withColumn(
        "confidence_avg", F.round((F.col("confidence") + F.coalesce("confidence_2", F.lit(0.5))) / 2, 2)
    )


def personalize(df: DataFrame, boost: list[str], penalty: list[str], min_score: int | None, cfg: Config = DEFAULT) -> DataFrame:
    """Adds effective_score by the profile's words (three of a kind count at most) and applies its least score."""
    b = F.lower(F.concat_ws(" ", text("title"), text("summary"), F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " ")))
    hits = lambda words: F.least(F.lit(3), F.size(F.filter(F.array(*(F.lit(w.lower()) for w in words)).cast("array<string>"), lambda w: F.contains(b, w))))
    delta = cfg.profile_step * hits(boost) - cfg.profile_step * hits(penalty)
    x = df.withColumn("boost", F.round(delta, 2)).withColumn("effective_score", F.round(F.coalesce("score", F.lit(0)) + delta, 2))
    return x.filter(F.col("score") >= min_score) if min_score is not None else x


def profile_of(profiles: DataFrame, email: str) -> DataFrame:
    """The first profile (by pos) of an address, case aside."""
    return profiles.filter(F.lower(F.trim("email")) == email.strip().lower()).orderBy("pos").limit(1)


def personal_order(df: DataFrame) -> DataFrame:
    """A reader's order: best effective score first, then as it came."""
    return df.orderBy(F.desc("effective_score"), "pos")


def most_active(counts: DataFrame, n: int = 10) -> DataFrame:
    """The n most mentioned names: a report."""
    return counts.filter("total > 0").orderBy(F.desc("total"), "term").limit(n)


def examples(df: DataFrame, terms: DataFrame, n: int = 2) -> DataFrame:
    """(term, examples): the first n titles, cut at 120 characters, of rows that hold each term of a short list."""
    rows = df.select("pos", F.substring(text("title"), 1, 120).alias("title"), F.lower(F.concat_ws(" ", text("title"), text("summary"))).alias("_b"))
    hit = rows.join(terms.select("term"), F.contains("_b", F.col("term"))).select("term", "pos", "title")
    first = hit.withColumn("_n", F.row_number().over(W.partitionBy("term").orderBy("pos"))).filter(F.col("_n") <= n)
    titles = F.transform(F.array_sort(F.collect_list(F.struct("pos", "title"))), lambda e: e["title"])
    return terms.select("term").join(first.groupBy("term").agg(titles.alias("examples")), "term", "left").withColumn("examples", F.coalesce("examples", F.array().cast("array<string>")))


def query_report(stats: DataFrame) -> DataFrame:
    """(source, queries, productive, sterile, hits): how the queries of each source do; sterile ones have four zeros in a row."""
    return stats.groupBy("source").agg(F.count(F.lit(1)).alias("queries"), F.count_if(F.col("hits_total") > 0).alias("productive"), F.count_if(F.col("consecutive_zeros") >= 4).alias("sterile"), F.sum("hits_total").alias("hits"))


def top_queries(stats: DataFrame, n: int = 20) -> DataFrame:
    """(source, rank, query, hits_total): the n best queries of each source."""
    w = W.partitionBy("source").orderBy(F.desc_nulls_last("hits_total"), "query", "stat_id")
    return stats.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select("source", "rank", F.substring("query", 1, 80).alias("query"), "hits_total")


def report_lists(stats: DataFrame, n: int = 30) -> DataFrame:
    """(kind, stat_id): the n queries with most hits, and the n with most zeros in a row and at least four."""
    best = stats.filter("hits_total > 0").orderBy(F.desc("hits_total"), "stat_id").limit(n).select(F.lit("productive").alias("kind"), "stat_id")
    worst = stats.filter("consecutive_zeros >= 4").orderBy(F.desc("consecutive_zeros"), "stat_id").limit(n).select(F.lit("sterile").alias("kind"), "stat_id")
    return best.unionAll(worst)


def feedback_counts(feedback: DataFrame) -> DataFrame:
    return feedback.agg(F.count_if(F.lower("rating") == "up").alias("up"), F.count_if(F.lower("rating") == "down").alias("down"))


def digest_actors(actors: DataFrame, n: int = 15) -> DataFrame:
    """Actors for a digest: seen twice at least, most often seen first."""
    return actors.filter(F.col("count") >= 2).orderBy(F.desc("count"), "actor_id").limit(n).select("actor_id", "name", "count")


def dashboard_actors(actors: DataFrame) -> DataFrame:
    """(place, actor_id, name, count, appearances_runs): actors by sightings, then runs."""
    x = actors.select("actor_id", F.substring(text("name"), 1, 120).alias("name"), "count", "appearances_runs")
    return x.orderBy(F.desc_nulls_last("count"), F.desc_nulls_last("appearances_runs"), "actor_id")


def choose_models(models: DataFrame, special: list[str], weights: dict[str, int]) -> DataFrame:
    """Scoring models in order of preference: those that generate text and aren't of a special kind, by weight (100), then name."""
    x = models.filter(F.array_contains("methods", "generateContent")).select("name").distinct()
    x = x.filter(~F.exists(F.array(*map(F.lit, special)).cast("array<string>"), lambda s: F.contains(F.lower("name"), s)))
    w = F.coalesce(F.try_element_at(F.create_map(*(F.lit(v) for kv in weights.items() for v in kv)), F.col("name")), F.lit(100)) if weights else F.lit(100)
    return x.select("name", w.alias("weight")).orderBy("weight", "name")


def translation_candidates(df: DataFrame, n: int = 15, least: int = 4) -> DataFrame:
    """The first n rows to translate: well scored, with a summary."""
    return df.filter((F.col("score") >= least) & (F.trim(text("summary")) != "")).orderBy("pos").limit(n)


def with_translations(df: DataFrame, translated: DataFrame, lang: str) -> DataFrame:
    """Rows with the translation of their summary, where there is one that isn't blank."""
    t = translated.filter(F.trim(text("text")) != "").groupBy("pos").agg(F.min("text").alias("summary_translated"))
    return df.join(t, "pos", "left").withColumn("summary_lang", F.when(F.col("summary_translated").isNotNull(), lang))


def with_families(patents: DataFrame, cache: DataFrame, as_of: Column, days: int = 60) -> DataFrame:
    """Patents with citations and family size of cache entries younger than ``days``, and whether they must be looked up."""
    c = cache.groupBy("pub_num").agg(F.max_by(F.struct("citations_count", "family_size", "enriched_at"), "enriched_at").alias("c"))
    x = patents.join(c, patents["patent_pub_num"] == c["pub_num"], "left")
    fresh = F.col("c.enriched_at").cast("timestamp") > as_of - F.make_dt_interval(F.lit(days))
    return x.select(*patents.columns, F.when(fresh, F.col("c.citations_count")).alias("epo_citations_count"), F.when(fresh, F.col("c.family_size")).alias("epo_family_size"), (~F.coalesce(fresh, F.lit(False))).alias("look_up"))
