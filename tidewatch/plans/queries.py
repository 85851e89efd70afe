"""Queries of the core operators over the test tables, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.functions import text as T
from tidewatch.operators import analytics as A
from tidewatch.operators import dedup, filters, rank, state
from tidewatch.operators.graph import components
from tidewatch.plans import sql as S
from tidewatch.runtime import table
from tidewatch.sources import querygen

QUERY_TERMS = ["coatings", "hardness", "films", "gain", "vacuum", "coatings"]
AS_OF = "2025-08-01 00:00:00"


def _category(df: DataFrame) -> DataFrame:
    return df.withColumn("category", F.lower(F.trim(T.text("category"))))


def url_normalize(s, d):
    return table(s, d, "article").filter("link is not null").select("pos", T.normalize_url("link").alias("url"), T.domain("link").alias("domain"))


def url_dedup(s, d):
    return dedup.by_link(table(s, d, "article")).select("pos")


def title_normalize(s, d):
    return table(s, d, "article").select("pos", T.normalize_title("title").alias("title"))


def title_dedup(s, d):
    return dedup.by_title(table(s, d, "article")).select("pos", "slot", "untitled")


def article_id(s, d):
    return table(s, d, "article").select("pos", T.article_id("link", "title", "summary").alias("article_id"))


def prompt_version(s, d):
    return table(s, d, "documents").select("doc_id", T.prompt_version("text").alias("version"))


def token_stats(s, d):
    t = table(s, d, "documents").select("doc_id", T.tokens("text").alias("t"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"))


def doc_freq(s, d):
    t = table(s, d, "documents").select(F.explode(F.array_distinct(T.tokens("text"))).alias("term"))
    return t.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def cjk(s, d):
    return table(s, d, "documents").select("doc_id", (T.cjk_share("text") > 0.30).alias("mostly_cjk"))


def strip_tags(s, d):
    return table(s, d, "documents").select("doc_id", F.md5(F.trim(F.regexp_replace(T.strip_tags("text"), "[ \n]+", " "))).alias("plain"))


def blocked(s, d):
    return table(s, d, "documents").select("doc_id", filters.blocked_page("text").alias("blocked"))


def epodoc(s, d):
    return table(s, d, "article").filter("patent_pub_num is not null").select("pos", T.epodoc("patent_pub_num").alias("epodoc"))


def feedback_subject(s, d):
    f = table(s, d, "feedback").filter("rating is not null and article_id is not null")
    p = T.feedback_subject(F.concat(F.lit("Re: [FEEDBACK]  rating="), "rating", F.lit(" id="), "article_id", F.lit(" thanks")))
    return f.select("feedback_id", p["rating"].alias("rating"), p["id"].alias("id"))


def llm_parse(s, d):
    j = F.concat(F.lit('Sure:\n```json\n{"tldr": "x", "retained": [{"id": '), F.col("pos").cast("string"), F.lit(', "score": '), F.coalesce("score", F.lit(0)).cast("string"), F.lit(', "confidence": "'), F.coalesce((F.col("confidence") * 2).cast("string"), F.lit("high")), F.lit('"}]}\n```'))
    a = table(s, d, "article").select("pos", F.explode(T.parse_llm(j)["retained"]).alias("r"))
    return a.select("pos", F.col("r.id").cast("bigint").alias("id"), F.col("r.score").alias("score"), F.round("r.confidence", 6).alias("confidence"))


def actor_classify(s, d):
    return table(s, d, "discovered_actors").select("actor_id", T.classify_actor("name", "sources").alias("kind"))


def presentation(s, d):
    a = table(s, d, "article").filter("published_at is not null")
    return a.select("pos", T.ellipsis("summary").alias("short"), T.stars("score").alias("stars"), T.french_date(F.col("published_at")).alias("jour"), F.weekofyear("published_at").alias("week"))


def prefilter(s, d):
    phrases, words = ["thin film", "solar modules", "wear resistance"], ["tin", "hardness", "membranes"]
    return filters.lexical(table(s, d, "article"), phrases, words).select("pos")


def recency(s, d):
    return filters.recent(table(s, d, "article"), "published_at", F.lit(AS_OF).cast("timestamp"), 90).select("pos")


def required(s, d):
    return filters.required(table(s, d, "article"), "title", "link").select("pos")


def source_counts(s, d):
    return table(s, d, "article").groupBy(T.source_family("source").alias("family")).agg(F.count(F.lit(1)).alias("n"))


def seen_flag(s, d):
    a = table(s, d, "article")
    seen = a.filter("batch_no = 0 and link is not null").select(T.normalize_url("link").alias("u")).distinct()
    new = a.filter("batch_no >= 1").withColumn("u", T.normalize_url("link"))
    return new.join(seen.withColumn("hit", F.lit(True)), "u", "left").select("pos", F.coalesce("hit", F.lit(False)).alias("seen"))


def seen_anti(s, d):
    a = table(s, d, "article")
    seen = a.filter("batch_no = 0 and link is not null")
    new = a.filter("batch_no >= 1")
    return filters.not_in(new, T.normalize_url("link"), seen, T.normalize_url("link")).select("pos")


def _firms(s, d):
    """All firms to count: the first words of the titles' firms in the queries' statistics."""
    q = table(s, d, "query_stats").select(F.regexp_extract(T.text("query"), '^"([^"]+)"', 1).alias("term")).filter("term <> ''")
    return q.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def mentions(s, d):
    return A.mention_counts(_category(table(s, d, "article")), _firms(s, d), "term", A.blob())


def company_floor(s, d):
    firms = _firms(s, d).select("term", F.row_number().over(W.orderBy("term")).alias("pos"))
    x = A.company_floor(table(s, d, "article").drop("tags").withColumn("tags", F.array().cast("array<string>")), firms)
    return x.select("pos", "score", "company")


def archive_upsert(s, d):
    a = table(s, d, "article").select("pos", "link", "batch_no", "collected_at", "score")
    key = F.regexp_replace(F.trim(T.text("link")), "/+$", "")
    out = state.upsert(a.filter("batch_no = 0"), a.filter("batch_no >= 1"), key, [F.desc("batch_no"), F.desc("pos")], 5000, [F.desc_nulls_last("collected_at"), F.col("pos")])
    return out.select("pos", "score")


def feedback_latest(s, d):
    w = W.partitionBy("article_id").orderBy(F.desc_nulls_last("date"), F.desc("feedback_id"))
    f = table(s, d, "feedback").filter("article_id is not null and lower(rating) in ('up', 'down')")
    return f.withColumn("n", F.row_number().over(w)).filter("n = 1").select("article_id", F.lower("rating").alias("rating"), "date")


def few_shot(s, d):
    f = feedback_latest(s, d)
    a = table(s, d, "article").filter("length(title) > 0 and length(summary) > 0").select(T.article_id("link", "title", "summary").alias("article_id"), "title", "pos")
    a = a.groupBy("article_id").agg(F.min_by("title", "pos").alias("title"))
    w = W.partitionBy("rating").orderBy(F.desc_nulls_last("date"), "article_id")
    return f.join(a, "article_id").withColumn("n", F.row_number().over(w)).filter("n <= 3").select("rating", "article_id", "title", "date")


def feedback_join(s, d):
    f = feedback_latest(s, d)
    a = table(s, d, "article").select("pos", T.article_id("link", "title", "summary").alias("article_id"))
    return a.join(f, "article_id", "left").select("pos", F.col("rating").alias("user_feedback"))


def _runs(s, d):
    e = table(s, d, "events").select(F.col("user_id").cast("string").alias("query"), F.col("event_type").alias("source"), F.to_date("ts").alias("run"))
    counts = e.groupBy("query", "source", "run").agg(F.count(F.lit(1)).alias("n"))
    runs = e.select("run").distinct()
    keys = e.select("query", "source").distinct()
    return keys.join(F.broadcast(runs)).join(counts, ["query", "source", "run"], "left").select("query", "source", "run", F.coalesce("n", F.lit(0)).alias("hits"))


def query_stats(s, d):
    return state.stats_by_run(_runs(s, d)).select("query", "source", "run", "hits_total", "runs_total", "consecutive_zeros", "last_hit_run")


def stats_merge(s, d):
    st = table(s, d, "query_stats").groupBy("query", "source").agg(*(F.max(c).alias(c) for c in ("hits_total", "hits_last_run", "runs_total", "consecutive_zeros", "last_hit_run", "first_seen")))
    run = st.filter("hits_total is not null").select("query", "source", F.pmod(F.length("query"), F.lit(3)).cast("bigint").alias("hits"))
    out = state.merge_stats(st, run, F.lit("2026-01-01T00:00:00Z"))
    return out.select("query", "source", "hits_total", "runs_total", "consecutive_zeros", "last_hit_run")


def tiers(s, d):
    q = state.tiers(table(s, d, "query_stats"))
    return q.select("stat_id", "tier", state.max_results(F.lit(25), F.col("tier")).alias("max_results"))


def sterile(s, d):
    q = table(s, d, "query_stats")
    targets = q.select(F.lit("solo_keywords").alias("list_name"), F.col("stat_id").alias("pos"), F.regexp_replace("query", '^"|"$', "").alias("term")).filter("term is not null")
    return state.sterile_targets(targets, q).select(F.col("pos").alias("stat_id"), "term")


def purge_cap(s, d):
    q = table(s, d, "query_stats")
    targets = q.select(F.lit("solo_keywords").alias("list_name"), F.col("stat_id").alias("pos"), F.regexp_replace("query", '^"|"$', "").alias("term")).filter("term is not null")
    return state.purge(state.sterile_targets(targets, q)).select(F.col("pos").alias("stat_id"), "term")


def actor_merge(s, d):
    return state.merge_actors(table(s, d, "discovered_actors")).select("actor", "name", "count", "first_seen", "last_seen", "appearances_runs")


def promote(s, d):
    return state.promote(table(s, d, "discovered_actors").filter("name is not null"), table(s, d, "target_terms"))


def score_distribution(s, d):
    x = A.score_distribution(_category(table(s, d, "article")), "category")
    return x.select("category", "n", "c1", "c2", "c3", "c4", "c5", F.round("high_pct", 6).alias("high_pct"), F.round("five_pct", 6).alias("five_pct"))


def drift(s, d):
    runs = A.score_distribution(table(s, d, "article"), "batch_no")
    return A.drift(runs, "batch_no").select("batch_no", "warning")


def heatmap(s, d):
    e = table(s, d, "events")
    runs = e.select(F.to_date("ts").alias("run")).distinct()
    g = A.grid(e, F.to_date("ts"), "user_id", runs)
    return A.heatmap(g, "user_id", "run", "total").select("run", "user_id", "total", F.round("avg", 6).alias("avg"), "anomaly")


def bm25(s, d):
    a = table(s, d, "article")
    return rank.bm25(a, "pos", rank.ranking_text(), QUERY_TERMS).select("pos", F.round("score", 5).alias("score"))


def prerank_keep(s, d):
    a = table(s, d, "article").select("pos", "title", "summary")
    scored = rank.bm25(a, "pos", rank.ranking_text(), QUERY_TERMS)
    return rank.keep_top(a, scored.withColumn("score", F.round("score", 6)), "pos", 0.80, 0.05).select("pos")


def tfidf_terms(s, d):
    v = rank.tfidf(table(s, d, "article").filter("title is not null"), "pos", T.text("title"), 2000, bigrams=False, min_df=3, max_df=0.6)
    return v.groupBy("term").agg(F.round(F.sum("w"), 4).alias("weight"), F.max("df").alias("df"))


def emerging(s, d):
    a = table(s, d, "article").filter("score >= 4 and title is not null")
    v = rank.tfidf(a, "pos", T.text("title"), 2000, pattern=r"\p{L}{3,}", bigrams=True, min_df=3, max_df=0.6)
    known = table(s, d, "target_terms").select(F.explode(F.split(F.lower("term"), r"\s+")).alias("term")).unionAll(table(s, d, "target_terms").select(F.lower("term"))).distinct()
    t = v.filter("length(term) >= 4").groupBy("term").agg(F.round(F.sum("w"), 3).alias("score"), F.max("df").alias("df"))
    return t.join(known, "term", "left_anti").orderBy(F.desc("score"), "term").limit(10)


def _titles(s, d):
    """Rows, key, text, threshold and features to compare titles by."""
    return table(s, d, "article").filter("length(title) > 20"), "pos", T.text("title"), 0.85, 8000


def dedup_pairs(s, d):
    return dedup.cosine_pairs(*_titles(s, d)).select("a", "b", F.round("cosine", 4).alias("cosine"))


def dedup_components(s, d):
    return components(dedup.cosine_links(*_titles(s, d))).select("node", "root")


def semantic_dedup(s, d):
    return dedup.semantic(table(s, d, "article"), dedup.cosine_links(*_titles(s, d))).select("pos")


def embedding_cosine(s, d):
    e = table(s, d, "embeddings")
    first = e.orderBy("vec_id").limit(1).select(F.col("embedding").alias("q"))
    return e.join(F.broadcast(first)).select("vec_id", F.round(rank.cosine(F.col("embedding"), F.col("q")), 4).alias("cosine"))


def mmr(s, d):
    return rank.mmr(table(s, d, "embeddings").withColumn("r", (F.col("label") % 5 + 1) / 5.0), "vec_id", "r", "embedding", 0.7, 60)


def judge_candidates(s, d):
    return A.judge_candidates(table(s, d, "article")).select("pos")


def multi_judge(s, d):
    a = table(s, d, "article").withColumn("score_2", F.when(F.col("pos") % 7 != 0, F.pmod("pos", F.lit(5)).cast("int") + 1)).withColumn("confidence_2", F.lit(0.7)).withColumn("company", F.col("patent_assignee"))
    return A.consensus(a.filter("score is not null")).select("pos", "final", "judge_2_rejected")


def personalize(s, d):
    x = A.personalize(table(s, d, "article"), ["solar", "hardness", "TiN", "fuel cells"], ["withdraws", "patent"], 2)
    return x.select("pos", "effective_score")


def recap(s, d):
    x = table(s, d, "article").filter("score >= 2")
    return x.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("score") == 5).alias("n5"), F.count_if(F.col("score") == 4).alias("n4"))


def digest_groups(s, d):
    x = table(s, d, "article").filter("score >= 4").orderBy(F.desc("score"), F.desc_nulls_last("collected_at"), "pos").limit(100)
    return x.withColumn("rn", F.row_number().over(W.orderBy(F.desc("score"), F.desc_nulls_last("collected_at"), "pos"))).select("rn", "pos", "score")


def dashboard_pivot(s, d):
    x = table(s, d, "article").filter("score is not null").groupBy(F.substring(T.text("collected_at"), 1, 10).alias("day")).pivot("score", [1, 2, 3, 4, 5]).count()
    return x.na.fill(0).select("day", *(F.col(str(k)).alias(f"s{k}") for k in range(1, 6)))


def dashboard_search(s, d):
    return table(s, d, "article").filter((F.col("score") >= 4) & F.col("title").rlike("(?i)solar")).select("pos", F.substring("title", 1, 120).alias("title"))


def ttl_cache(s, d):
    a = table(s, d, "article").filter("patent_pub_num is not null and published_at is not null")
    as_of = F.lit(AS_OF).cast("timestamp")
    fresh = F.col("published_at").cast("timestamp") > as_of - F.expr("INTERVAL 60 DAYS")
    return a.select("pos", fresh.alias("fresh"))


def patent_candidates(s, d):
    a = _category(table(s, d, "article")).filter("category = 'patent' and score >= 3 and length(patent_pub_num) > 0")
    return a.orderBy(F.desc("score"), "pos").limit(20).select("pos", "patent_pub_num")


def querygen_gnews(s, d):
    return querygen.build(table(s, d, "target_terms"), "gnews").select("query")


def querygen_all(s, d):
    t = table(s, d, "target_terms")
    parts = [querygen.build(t, n).select(F.lit(n).alias("source"), "query") for n in querygen.TEMPLATES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def request_counts(s, d):
    return querygen.request_counts(table(s, d, "target_terms"), 50)


def most_active(s, d):
    return A.most_active(mentions(s, d)).select("term", "total")


def query_report(s, d):
    return A.query_report(table(s, d, "query_stats"))


def top_queries(s, d):
    return A.top_queries(table(s, d, "query_stats"))


def report_lists(s, d):
    return A.report_lists(table(s, d, "query_stats"))


def feedback_counts(s, d):
    return A.feedback_counts(table(s, d, "feedback"))


def digest_actors(s, d):
    return A.digest_actors(table(s, d, "discovered_actors"))


def dashboard_actors(s, d):
    return A.dashboard_actors(table(s, d, "discovered_actors"))


def sorted_targets(s, d):
    return state.sorted_targets(table(s, d, "target_terms"))


def feedback_upsert(s, d):
    f = table(s, d, "feedback")
    return state.upsert_feedback(f.filter("feedback_id % 3 <> 0"), f.filter("feedback_id % 3 = 0"), 500).select("feedback_id", "article_id", "rating")


def prompt_registry(s, d):
    q = table(s, d, "documents").select(F.col("text").alias("prompt"), F.col("source").alias("label"), F.col("fetched_at").alias("at"), "doc_id")
    first = state.register_prompts(q.limit(0).select(F.lit("").alias("version")), q.filter("doc_id % 2 = 0"))
    return state.register_prompts(first, q.filter("doc_id % 2 = 1")).select("version", "first_seen", "prompt_size")


def archive_new(s, d):
    a = table(s, d, "article")
    return state.archived_since(a.filter("batch_no = 0"), a.filter("batch_no >= 1"), F.regexp_replace(F.trim(T.text("link")), "/+$", ""))


def memory_modes(s, d):
    a = table(s, d, "article").drop("was_seen")
    seen = a.filter("batch_no = 0 and link is not null").select(T.normalize_url("link").alias("url"))
    new = a.filter("batch_no >= 1")
    out = [state.remember(new, seen, m, T.normalize_url("link")).select(F.lit(m).alias("mode"), "pos", "was_seen") for m in ("filter", "badge", "reset")]
    return out[0].unionAll(out[1]).unionAll(out[2])


def actor_runs(s, d):
    """Two runs of sightings, the patents' assignees, merged into the actors' state."""
    a = table(s, d, "article").filter("patent_assignee is not null").select("pos", F.col("patent_assignee").alias("name"), T.source_family("source").alias("source"), F.col("collected_at").alias("at"), "batch_no")
    known = table(s, d, "target_terms").filter(F.col("list_name").isin("companies", "research_orgs"))
    one, two = (state.run_actors(a.filter(c), known) for c in ("batch_no = 0", "batch_no >= 1"))
    empty = one.limit(0).withColumn("appearances_runs", F.lit(0))
    out = state.merge_actor_state(state.merge_actor_state(empty, one), two)
    return out.select("actor", "count", "appearances_runs", F.array_join(F.array_sort("sources"), ",").alias("sources"))


def calibration(s, d):
    runs = A.score_distribution(table(s, d, "article"), "batch_no").select("batch_no", "n", "c5")
    return state.append(runs.filter("batch_no < 4"), runs.filter("batch_no >= 4"), 5, "batch_no")


def unread_mails(s, d):
    new, last = state.unread(table(s, d, "feedback").select(F.col("feedback_id").alias("uid"), "rating"), 10)
    return new.agg(F.count(F.lit(1)).alias("n")).withColumn("last_uid", F.lit(last))


def tuning(s, d):
    q = table(s, d, "query_stats")
    now, _, _ = state.run_tuning(table(s, d, "discovered_actors").filter("name is not null"), table(s, d, "target_terms"), q)
    return now.groupBy("list_name").agg(F.count(F.lit(1)).alias("n"))


def translation(s, d):
    c = A.translation_candidates(table(s, d, "article"))
    done = c.filter("pos % 2 = 0").select("pos", F.upper("summary").alias("text"))
    return A.with_translations(c, done, "fr").select("pos", "summary_translated", "summary_lang")


def patent_families(s, d):
    a = table(s, d, "article").filter("patent_pub_num is not null").select("pos", "patent_pub_num", "published_at")
    cache = a.filter("published_at is not null").groupBy(F.col("patent_pub_num").alias("pub_num")).agg(F.max("published_at").alias("enriched_at"), F.count(F.lit(1)).alias("family_size"), F.max("pos").alias("citations_count"))
    return A.with_families(a, cache, F.lit(AS_OF).cast("timestamp")).select("pos", "epo_citations_count", "epo_family_size", "look_up")


def term_examples(s, d):
    terms = s.createDataFrame([("hardness",), ("solar",), ("no such term",)], "term string")
    return A.examples(table(s, d, "article"), terms).select("term", F.array_join("examples", " / ").alias("examples"))


def recap_order(s, d):
    x = table(s, d, "article").filter("score >= 2").orderBy(F.desc("score"), F.desc_nulls_last("collected_at"), "pos").limit(50)
    return x.select("pos", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    names = [url_normalize, url_dedup, title_normalize, title_dedup, article_id, prompt_version, token_stats, doc_freq, cjk, strip_tags, blocked, epodoc, feedback_subject, llm_parse, actor_classify, presentation, prefilter, recency, required, source_counts, seen_flag, seen_anti, mentions, company_floor, archive_upsert, feedback_latest, few_shot, feedback_join, query_stats, stats_merge, tiers, sterile, purge_cap, actor_merge, promote, score_distribution, drift, heatmap, bm25, prerank_keep, tfidf_terms, emerging, dedup_pairs, dedup_components, semantic_dedup, embedding_cosine, mmr, judge_candidates, multi_judge, personalize, recap, digest_groups, dashboard_pivot, dashboard_search, ttl_cache, patent_candidates, querygen_gnews, querygen_all, request_counts, most_active, query_report, top_queries, report_lists, feedback_counts, digest_actors, dashboard_actors, sorted_targets, feedback_upsert, prompt_registry, archive_new, memory_modes, actor_runs, calibration, unread_mails, tuning, translation, patent_families, term_examples, recap_order]
    return {f"q_{f.__name__}": f for f in names}


def oracle_sql() -> dict[str, str]:
    return S.oracle_sql()
