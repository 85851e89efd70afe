"""State kept between runs: merges, windows over runs, retention, tuning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.config import DEFAULT, Config
from tidewatch.functions.text import classify_actor, normalize_actor, normalize_query, prompt_version, text


def stats_by_run(runs: DataFrame) -> DataFrame:
    """(query, source, run, hits) -> running totals, trailing zeros and last run with hits, for each run of each key."""
    key = W.partitionBy("query", "source").orderBy("run").rowsBetween(W.unboundedPreceding, 0)
    island = F.sum(F.when(F.col("hits") > 0, 1).otherwise(0)).over(key)
    x = runs.withColumn("_i", island)
    zeros = F.sum(F.when(F.col("hits") == 0, 1).otherwise(0)).over(W.partitionBy("query", "source", "_i").orderBy("run").rowsBetween(W.unboundedPreceding, 0))
    return x.select(
        "query", "source", "run", F.col("hits").alias("hits_last_run"),
        F.sum("hits").over(key).alias("hits_total"), F.count(F.lit(1)).over(key).alias("runs_total"), zeros.alias("consecutive_zeros"),
        F.max(F.when(F.col("hits") > 0, F.col("run"))).over(key).alias("last_hit_run"), F.min("run").over(key).alias("first_seen"),
    )


def merge_stats(state: DataFrame, run: DataFrame, now: Column) -> DataFrame:
    """Merges one run's (query, source, hits) into the state; keys that the run lacks stay as they are.

    Of several rows of a key in a run the last counts, by ``seq`` where the run has one, else the one with most hits.
    """
    last = F.max_by("hits", "seq") if "seq" in run.columns else F.max("hits")
    one = run.select(F.substring(text("query"), 1, 200).alias("query"), "source", *[c for c in ("hits", "seq") if c in run.columns]).groupBy("query", "source").agg(last.alias("hits"))
    s = state.alias("s").join(one.alias("r"), ["query", "source"], "full_outer")
    ran, hit = F.col("hits").isNotNull(), F.coalesce(F.col("hits"), F.lit(0)) > 0
    old = lambda c: F.coalesce(F.col(f"s.{c}"), F.lit(0))
    return s.select(
        "query", "source",
        (old("hits_total") + F.coalesce("hits", F.lit(0))).alias("hits_total"), F.coalesce("hits", "s.hits_last_run").alias("hits_last_run"),
        (old("runs_total") + ran.cast("int")).alias("runs_total"), F.when(hit, 0).otherwise(old("consecutive_zeros") + ran.cast("int")).alias("consecutive_zeros"),
        F.when(hit, now).otherwise(F.col("s.last_hit_run")).alias("last_hit_run"), F.coalesce("s.first_seen", now).alias("first_seen"),
    )


def merge_actors(actors: DataFrame) -> DataFrame:
    """Rows of one normalised name as one actor: first spelling, sums, all sources, first and last sight."""
    n = normalize_actor("name")
    x = actors.withColumn("_n", n).filter(F.length("_n").between(3, 200))
    src = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.transform("sources", F.lower)))))
    return x.groupBy(F.col("_n").alias("actor")).agg(
        F.min_by("name", "actor_id").alias("name"), F.sum("count").alias("count"), F.array_join(src, ",").alias("sources"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.max("appearances_runs").alias("appearances_runs"),
    )


def upsert(state: DataFrame, new: DataFrame, key: Column, order: list[Column], cap: int, cap_order: list[Column]) -> DataFrame:
    """Union in which the last row of each key by ``order`` wins, cut to the first ``cap`` rows; blank keys are dropped."""
    both = state.unionByName(new, allowMissingColumns=True).withColumn("_k", key).filter("_k <> ''")
    last = both.withColumn("_n", F.row_number().over(W.partitionBy("_k").orderBy(*order))).filter("_n = 1").drop("_k", "_n")
    return last.orderBy(*cap_order).limit(cap)


def run_actors(seen: DataFrame, known: DataFrame) -> DataFrame:
    """(actor, name, count, sources, at): one run's sightings (pos, name, source, at) by normalised name, known ones left out.

    The first spelling counts; sources are in the order in which they first come.
    """
    x = seen.withColumn("actor", normalize_actor("name")).filter(F.length(F.trim("name")).between(3, 200))
    x = x.join(known.select(normalize_actor("term").alias("actor")).distinct(), "actor", "left_anti")
    by_source = x.groupBy("actor", "source").agg(F.min("pos").alias("p"), F.count(F.lit(1)).alias("c"), F.min_by("name", "pos").alias("name"), F.min("at").alias("a"), F.max("at").alias("z"))
    sources = F.transform(F.array_sort(F.collect_list(F.struct("p", "source"))), lambda e: e["source"])
    return by_source.groupBy("actor").agg(F.min_by("name", "p").alias("name"), F.sum("c").alias("count"), sources.alias("sources"), F.min("a").alias("first_seen"), F.max("z").alias("last_seen"))


def merge_actor_state(state: DataFrame, run: DataFrame) -> DataFrame:
    """State of actors after a run: counts added, one more run for those seen, sources united, the last sight moved on."""
    s = state.alias("s").join(run.alias("r"), "actor", "full_outer")
    none = F.array().cast("array<string>")
    return s.select(
        "actor", F.coalesce("s.name", "r.name").alias("name"), (F.coalesce("s.count", F.lit(0)) + F.coalesce("r.count", F.lit(0))).alias("count"),
        F.array_union(F.coalesce("s.sources", none), F.coalesce("r.sources", none)).alias("sources"), F.least("s.first_seen", "r.first_seen").alias("first_seen"),
        F.greatest("s.last_seen", "r.last_seen").alias("last_seen"), (F.coalesce("s.appearances_runs", F.lit(0)) + F.col("r.actor").isNotNull().cast("int")).alias("appearances_runs"),
    )


def append(state: DataFrame, new: DataFrame, keep: int, *latest: str) -> DataFrame:
    """History with new rows at its end, the last ``keep`` by ``latest`` kept."""
    return state.unionByName(new, allowMissingColumns=True).orderBy(*(F.desc_nulls_last(c) for c in latest)).limit(keep)


def upsert_feedback(state: DataFrame, new: DataFrame, keep: int) -> DataFrame:
    """Feedback after new entries: ratings other than up and down are ignored, the last entry of an article counts."""
    both = state.withColumn("_n", F.lit(0)).unionByName(new.withColumn("_n", F.lit(1)), allowMissingColumns=True).withColumn("rating", F.lower(F.trim("rating")))
    both = both.filter(F.col("rating").isin("up", "down") & (F.length("article_id") > 0))
    w = W.partitionBy("article_id").orderBy(F.desc("_n"), F.desc_nulls_last("date"), F.desc("feedback_id"))
    last = both.withColumn("_r", F.row_number().over(w)).filter("_r = 1")
    return last.orderBy(F.desc_nulls_last("date"), F.desc("feedback_id")).limit(keep).drop("_n", "_r")


def unread(mails: DataFrame, last_uid: int) -> tuple[DataFrame, int]:
    """Mails behind the offset, and the offset to commit after them."""
    new = mails.filter(F.col("uid") > last_uid)
    return new, new.agg(F.coalesce(F.max("uid"), F.lit(last_uid))).first()[0]


def register_prompts(registry: DataFrame, prompts: DataFrame) -> DataFrame:
    """Rows to append for (prompt, label, at) whose version the registry lacks: version, label, first_seen, size, preview."""
    x = prompts.select(prompt_version("prompt").alias("version"), "label", F.col("at").alias("first_seen"), F.length(text("prompt")).alias("prompt_size"), F.substring(text("prompt"), 1, 200).alias("preview"))
    one = x.groupBy("version").agg(*(F.min(c).alias(c) for c in ("label", "first_seen", "prompt_size", "preview")))
    return one.join(registry.select("version"), "version", "left_anti")


def archived_since(state: DataFrame, new: DataFrame, key: Column) -> DataFrame:
    """(n): number of keys that an upsert adds to the archive."""
    keys = lambda df: df.select(key.alias("k")).filter("k <> ''").distinct()
    return keys(new).join(keys(state), "k", "left_anti").agg(F.count(F.lit(1)).alias("n"))


def remember(df: DataFrame, seen: DataFrame, mode: str, link: Column) -> DataFrame:
    """Rows of a run by memory mode, with ``was_seen``: 'filter' drops seen ones, 'badge' marks them, 'reset' forgets."""
    if mode == "reset":
        return df.withColumn("was_seen", F.lit(False))
    known = seen.select(F.col("url").alias("_u")).distinct().withColumn("_hit", F.lit(True))
    x = df.withColumn("_u", link).join(known, "_u", "left").withColumn("was_seen", F.coalesce("_hit", F.lit(False))).drop("_u", "_hit")
    return x.filter(~F.col("was_seen")) if mode == "filter" else x


def run_tuning(actors: DataFrame, targets: DataFrame, stats: DataFrame, cfg: Config = DEFAULT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(targets, promoted, purged): promotion first, then purge among what is listed then; purged terms are returned for a rollback."""
    new = promote(actors, targets, cfg)
    last = targets.groupBy("list_name").agg(F.max("pos").alias("last"))
    listed = new.select(F.when(F.col("kind") == "company", "companies").otherwise("research_orgs").alias("list_name"), F.trim("name").alias("term"), F.row_number().over(W.partitionBy("kind").orderBy(F.desc("count"), "actor_id")).alias("n"))
    added = listed.join(last, "list_name", "left").select("list_name", (F.coalesce("last", F.lit(0)) + F.col("n")).cast("int").alias("pos"), "term")
    now = targets.select("list_name", F.col("pos").cast("int").alias("pos"), "term").unionByName(added)
    gone = purge(sterile_targets(now, stats, cfg), cfg)
    return now.join(gone.select("list_name", "term"), ["list_name", "term"], "left_anti").select("list_name", "pos", "term"), new, gone


def sorted_targets(targets: DataFrame) -> DataFrame:
    """Targets as they are saved: each term of a list once, in order without regard to case."""
    one = targets.filter(F.length(F.trim("term")) > 0).groupBy("list_name", "term").agg(F.min("pos").alias("p"))
    return one.select("list_name", "term", F.row_number().over(W.partitionBy("list_name").orderBy(F.lower("term"), "term")).alias("place"))


def tiers(stats: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Adds tier: 'hot' (top share of productive queries, one at least), 'cold' (too many zeros) or 'standard'."""
    productive = stats.filter("hits_total > 0")
    take = F.greatest(F.lit(1), F.floor(productive.select(F.count(F.lit(1))).scalar() * cfg.hot_percent / 100))
    # the bound of the hot share by counting from the top over totals, not over rows
    totals = productive.groupBy("hits_total").agg(F.count(F.lit(1)).alias("n"))
    above = totals.withColumn("before", F.coalesce(F.sum("n").over(W.orderBy(F.desc("hits_total")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    x = stats.join(above.select("hits_total", "before"), "hits_total", "left")
    within = F.row_number().over(W.partitionBy("hits_total").orderBy("stat_id"))
    hot = (F.col("hits_total") > 0) & (F.col("before") + within <= take)
    return x.withColumn("tier", F.when(hot, "hot").when(F.col("consecutive_zeros") >= cfg.cold_zeros, "cold").otherwise("standard")).drop("before")


def max_results(base: Column, tier: Column, cfg: Config = DEFAULT) -> Column:
    """Results to ask for: scaled by tier, half to even, between 5 and 200; a standard query keeps its base."""
    scaled = lambda f: F.greatest(F.lit(5), F.least(F.lit(200), F.bround(base * f))).cast("int")
    return F.when(tier == "hot", scaled(cfg.hot_factor)).when(tier == "cold", scaled(cfg.cold_factor)).otherwise(base.cast("int"))


def sterile_targets(targets: DataFrame, stats: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Targets tried long enough in some source without a hit in any."""
    t = targets.withColumn("_t", normalize_query("term")).filter("_t <> ''")
    s = stats.groupBy(normalize_query("query").alias("_t")).agg(
        F.max("hits_total").alias("most"), F.max((F.col("runs_total") >= cfg.purge_runs) & (F.col("consecutive_zeros") >= cfg.purge_zeros)).alias("tried")
    )
    return t.join(s, "_t").filter((F.col("most") <= 0) & F.col("tried")).select("list_name", "pos", "term")


def purge(sterile: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """At most ``purge_cap`` sterile targets, solo keywords first, then topics, then organisations."""
    rank = F.when(F.col("list_name") == "solo_keywords", 1).when(F.col("list_name") == "cross_domain_topics", 2).when(F.col("list_name") == "research_orgs", 3)
    return sterile.withColumn("_r", rank).filter("_r is not null").orderBy("_r", "pos").limit(cfg.purge_cap).drop("_r")


def promote(actors: DataFrame, targets: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Frequent, recurring actors that no target list holds yet, with their kind."""
    known = targets.filter(F.col("list_name").isin("companies", "research_orgs")).select(normalize_actor("term").alias("actor")).distinct()
    fit = actors.filter((F.col("count") >= cfg.promote_count) & (F.col("appearances_runs") >= cfg.promote_runs))
    best = fit.withColumn("actor", normalize_actor("name")).join(known, "actor", "left_anti")
    return best.orderBy(F.desc("count"), "actor_id").limit(cfg.promote_cap).select("actor_id", "name", "count", classify_actor("name", "sources").alias("kind"))
