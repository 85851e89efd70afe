"""Core operators on small literals, and all core queries against their SQL."""

import glob
import os
import random
import time
from collections import Counter, defaultdict
from itertools import combinations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import text as T
from tidewatch.operators import analytics, dedup, filters, graph, rank, similar, state
from tidewatch.operators.graph import components
from tidewatch.plans import queries as Q
from tidewatch.runtime import CLEANUP, cut
from tidewatch.sources import querygen, readers

DATA = "/root/testdata/sf0.001"


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'int' if isinstance(v, int) else 'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "url, want",
    [
        ("HTTPS://Www.A.example/X/?utm_source=a&b=1#f", "https://www.a.example/x?b=1"),
        ("https://a.example", "https://a.example/"),
        (" https://a.example/p///?ref=x&c= ", "https://a.example/p"),
        ("", ""),
        (None, ""),
    ],
)
def test_normalize_url(spark, url, want):
    assert one(spark, T.normalize_url("u"), u=url) == want


def test_scalars(spark):
    assert one(spark, T.normalize_title("t"), t="Étude: X–Y test - Le Fil") == "étude x y test"
    assert one(spark, T.epodoc("p"), p="EP3456789A1") == "EP.3456789.A1"
    assert one(spark, T.epodoc("p"), p="US10867856") == "US.10867856"
    assert one(spark, T.epodoc("p"), p="junk") is None
    assert one(spark, T.feedback_subject("s"), s="Re: [feedback] rating=UP id=0123456789ab")["rating"] == "up"
    assert one(spark, T.retry_seconds("m"), m="please retry in 12.5s") == 12.5
    assert one(spark, T.clean_summary("m"), m="Here is the summary: All well ```json {}```") == "All well"
    assert one(spark, T.normalize_query("q"), q=' "Atomic  Layer" ') == "atomic layer"
    assert one(spark, T.tokens("q"), q="Hello WORLD!") == ["hello", "world"]
    assert one(spark, T.prompt_version("q"), q=None) == "da39a3ee"


@pytest.mark.parametrize(
    "raw, want",
    [
        ('{"retained": [{"id": 1, "score": 5, "confidence": 2.5}]}', [(1, 5, 1.0)]),
        ('x ```json\n{"tldr": "t", "retained": [{"id": 2, "score": 3}]}\n```', [(2, 3, 0.8)]),
        ('{"retained": [{"id": 1, "score": 5, "confidence": "abc"}]}', [(1, 5, 0.8)]),
        ("no json", None),
        (None, None),
    ],
)
def test_parse_llm(spark, raw, want):
    got = one(spark, T.parse_llm("r"), r=raw)["retained"]
    assert (got and [(e["id"], e["score"], e["confidence"]) for e in got]) == want


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (7, 8), (8, 7), (5, 5), (None, 3), (3, 9)], "a long, b long")
    assert {tuple(r) for r in components(e).collect()} == {(1, 1), (2, 1), (3, 1), (9, 1), (7, 7), (8, 7)}
    assert components(e.limit(0)).count() == 0


def test_components_of_a_small_table_take_few_jobs(spark, monkeypatch):
    from tidewatch.operators import graph

    r = random.Random(5)
    edges = [(r.randrange(900), r.randrange(900)) for _ in range(500)] + [(2000 + i, 2001 + i) for i in range(0, 300)] + [(5000, 4000 + i) for i in range(50)]
    e = spark.createDataFrame(edges, "a long, b long")
    spark.sparkContext.setJobGroup("one task", "")
    local = {tuple(x) for x in components(e).collect()}
    spark.sparkContext.setJobGroup("rounds", "")
    monkeypatch.setattr(graph, "LOCAL", 0)
    assert local == {tuple(x) for x in components(e).collect()}
    jobs = {g: len(spark.sparkContext.statusTracker().getJobIdsForGroup(g)) for g in ("one task", "rounds")}
    assert jobs["one task"] <= 8 < jobs["rounds"]


def test_a_written_table_leaves_no_shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {disk.getAllFiles().apply(i).getName() for i in range(disk.getAllFiles().size())}
    before = files()
    rows = spark.range(10_000).repartition(4, "id")
    written = cut(rows)
    for _ in range(50):
        if not (left := {f for f in files() - before if f.endswith(".data")}):
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(CLEANUP) == "false" and written.count() == rows.count() == 10_000


def test_dedup_keeps_longest_and_untitled(spark):
    rows = [(1, "A b", "x", "l1"), (2, "a  B!", "longer", "l1/"), (3, None, "y", None), (4, "", None, " ")]
    df = spark.createDataFrame(rows, "pos long, title string, summary string, link string")
    assert {(r.pos, r.slot, r.untitled) for r in dedup.by_title(df).collect()} == {(2, 1, False), (3, 3, True), (4, 4, True)}
    assert [r.pos for r in dedup.by_link(df).collect()] == [1]


def test_filters(spark):
    df = spark.createDataFrame([(1, "Thin film of TiN", None, None), (2, "other", "x", "y"), (3, None, "", None)], "pos long, title string, summary string, source string")
    assert [r.pos for r in filters.lexical(df, ["thin film"], ["tin"]).collect()] == [1, 3]
    assert filters.lexical(df, [], []).count() == 3
    assert one(spark, filters.blocked_page("h"), h="<b>Access DENIED</b>") is True


def test_state(spark):
    st = spark.createDataFrame([("q", "s", 5, 1, 3, 2, "a", "b")], "query string, source string, hits_total long, hits_last_run long, runs_total long, consecutive_zeros long, last_hit_run string, first_seen string")
    run = spark.createDataFrame([("q", "s", 0), ("n", "s", 4)], "query string, source string, hits long")
    got = {r["query"]: (r.hits_total, r.runs_total, r.consecutive_zeros) for r in state.merge_stats(st, run, F.lit("now")).collect()}
    assert got == {"q": (5, 4, 3), "n": (4, 1, 0)}
    tier = spark.createDataFrame([(25, "cold"), (15, "hot"), (300, "standard"), (4, "cold")], "base int, tier string")
    assert [r.m for r in tier.select(state.max_results(F.col("base"), F.col("tier")).alias("m")).collect()] == [12, 22, 300, 5]


def test_heatmap_marks_a_rise_after_three_quiet_runs(spark):
    h = spark.createDataFrame([("X", 1, 0), ("X", 2, 0), ("X", 3, 0), ("X", 4, 3)], "name string, run int, total long")
    assert [r.anomaly for r in analytics.heatmap(h, "name", "run", "total").orderBy("run").collect()] == [None, None, None, "up"]


def test_personalize_and_judge(spark):
    df = spark.createDataFrame([(1, "Solar solar", None, ["x"], 3, 0.4), (2, "patent", "", None, 2, 0.9)], "pos long, title string, summary string, tags array<string>, score int, confidence double")
    got = {r.pos: r.effective_score for r in analytics.personalize(df, ["solar"], ["patent"], None).collect()}
    assert got == {1: 3.5, 2: 1.5}
    assert [r.pos for r in analytics.judge_candidates(df).collect()] == [1]


def test_mentions_of_many_terms_need_no_pass_for_each(spark):
    terms = ["ab", "Ab", "Zestor", "zestor films", "éz", "Straße", "x" * 9] + [f"firm{i} of a long list" for i in range(3000)]
    rows = [(1, "ZESTOR Films, abz", "patent"), (2, "firm2999 of a long list; firm12 of a long", None), (3, "  ", None), (4, None, None), (5, "pézy STRASSE straße zestor", "news"), (6, "xxxxxxxx", None), (7, "xxxxxxxxxx", None), (8, "a", None), (9, "b", None)]
    df = spark.createDataFrame(rows, "pos long, t string, category string")
    t = spark.createDataFrame([(x,) for x in terms] + [(None,)], "term string")
    got = analytics.mentions(df, t, "term", T.text("t"))
    assert "Nested" not in got._jdf.queryExecution().executedPlan().toString()
    low = [(x, x.lower()) for x in terms]
    want = {(k, x, c == "patent") for k, b, c in rows for x, y in low if b and b.strip() and y in b.lower()}
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    n = {r.term: (r.total, r.patents, r.others) for r in analytics.mention_counts(df, t.filter("term is not null"), "term", T.text("t")).collect()}
    assert len(n) == len(terms) and n["ab"] == (1, 1, 0) and n["Zestor"] == (2, 1, 1) and n["firm12 of a long list"] == (0, 0, 0)


def test_company_floor_takes_the_first_listed_of_many(spark):
    firms = spark.createDataFrame([("Zestor", 5), ("zest", 7), ("Bo", 9)] + [(f"firm{i} of a long list", 10 + i) for i in range(3000)] + [(None, 1)], "term string, pos int")
    df = spark.createDataFrame([(1, "a ZESTOR b", None, 2, None), (2, "bob", "firm2999 of a long list", 5, ["BO"]), (3, "none", "", 3, ["x"]), (4, "zest", None, None, [])], "pos long, title string, summary string, score int, tags array<string>")
    out = analytics.company_floor(df, firms)
    assert "Nested" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.pos: (r.score, r.company, r.tags) for r in out.collect()} == {1: (4, "Zestor", ["Zestor"]), 2: (5, "Bo", ["BO"]), 3: (3, None, ["x"]), 4: (4, "zest", ["zest"])}


def test_most_active_has_no_pass_for_each_term(spark):
    assert "NestedLoop" not in Q.queries()["q_most_active"](spark, DATA)._jdf.queryExecution().executedPlan().toString()


def test_cosine_pairs_against_all_pairs(spark):
    r = random.Random(3)
    texts = [" ".join(f"w{min(int(r.expovariate(0.15)), 40)}" for _ in range(r.randint(1, 7))) for _ in range(400)]
    texts += [" ".join(f"w{i % 3} z{i} z{i}".split()[: 2 + i % 2]) for i in range(60)] * 2 + ["alone alone", "alone", "", "w1", "w1 w1"]
    df = spark.createDataFrame(list(enumerate(texts)), "pos long, t string")
    got = {(x.a, x.b): x.cosine for x in dedup.cosine_pairs(df, "pos", T.text("t"), 0.85, 60).collect()}
    v = defaultdict(dict)
    for x in rank.tfidf(df, "pos", T.text("t"), 60).collect():
        v[x.pos][x.term] = x.w
    want = {(a, b): c for a in v for b in v if a < b and (c := sum(w * v[b].get(t, 0) for t, w in v[a].items())) >= 0.85 - 1e-12}
    assert len(want) > 500 and got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want)
    linked = components(dedup.cosine_links(df, "pos", T.text("t"), 0.85, 60)).collect()
    assert {tuple(x) for x in linked} == {tuple(x) for x in components(spark.createDataFrame(list(want), "a long, b long")).collect()}


def test_texts_of_one_vector_take_a_link_each(spark):
    df = spark.range(800).selectExpr("id pos", "'same title of a large class' t")
    assert dedup.cosine_links(df, "pos", T.text("t"), 0.85, 50).count() == 799
    assert {tuple(r) for r in components(dedup.cosine_links(df, "pos", T.text("t"), 0.85, 50)).collect()} == {(i, 0) for i in range(800)}


def test_semantic_keeps_the_best_of_a_class_and_all_unlinked(spark):
    rows = [(1, "same long title", "patent", "x", "a"), (2, "same long title", "news", "longer", "b"), (3, "Same long title!", "patent", "xy", "a"), (4, None, None, "", None), (5, "quite another thing", "news", "x", "a")]
    df = spark.createDataFrame(rows, "pos long, title string, category string, summary string, collected_at string")
    links = dedup.cosine_links(df, "pos", T.text("title"), 0.85, 50)
    assert {tuple(r) for r in links.collect()} == {(1, 2), (1, 3)}
    assert sorted(r.pos for r in dedup.semantic(df, links).collect()) == [3, 4, 5]


def test_semantic_takes_no_summary_through_its_join(spark):
    def nodes(p):
        return [p] + [x for i in range(p.children().size()) for x in nodes(p.children().apply(i))]

    df = spark.createDataFrame([(1, "news", "x", "a"), (2, "patent", "y", "b"), (3, None, None, None)], "pos long, category string, summary string, collected_at string")
    out = dedup.semantic(df, spark.createDataFrame([(1, 2)], "a long, b long"))
    assert out.columns == df.columns and sorted(r.pos for r in out.collect()) == [2, 3]
    joins = [n for n in nodes(out.select("pos")._jdf.queryExecution().optimizedPlan()) if n.nodeName() == "Join"]
    assert joins and all("summary#" not in n.output().mkString(" ") for n in joins)


def test_links_of_a_family_are_fewer_than_its_texts_in_each_task(spark):
    words = [f"word{i}" for i in range(10)]
    texts = [" ".join(words + list(twice)) for twice in combinations(words, 3)]
    df = spark.createDataFrame(list(enumerate(texts)), "pos long, t string")
    assert dedup.cosine_pairs(df, "pos", T.text("t"), 0.85, 50).count() == 120 * 119 // 2
    links = dedup.cosine_links(df, "pos", T.text("t"), 0.85, 50)
    assert links.count() <= 4 * 119
    assert {tuple(r) for r in components(links).collect()} == {(i, 0) for i in range(120)}


def test_forest_joins_what_its_edges_join(monkeypatch):
    monkeypatch.setattr(graph, "GATHER", 50)
    r = np.random.default_rng(5)
    parts = [tuple(r.integers(0, 400, (2, 20))) for _ in range(15)]
    (a, b), = graph.forest(iter(parts))
    whole = graph.least_labels(*map(np.concatenate, zip(*parts)))
    assert (a < b).all() and len(a) == len(whole[0]) - len(set(whole[1]))
    joined = dict(zip(*map(np.ndarray.tolist, graph.least_labels(a, b))))
    assert all(joined.get(n, n) == m for n, m in zip(*map(np.ndarray.tolist, whole)))
    assert list(graph.forest(iter([]))) == []


def test_unlike_texts_with_a_term_in_common_do_not_meet():
    # by one term each of them would meet all others: 500,000 candidates
    df, n = {0: 1000, **{i: 1 for i in range(1, 3001)}}, 1000
    idf = [1.0 if t == 0 else 7.0 for t in df]
    posted = Counter()
    for text in range(n):
        terms = [1 + 3 * text, 2 + 3 * text, 3 + 3 * text, 3001]
        w = [idf[1]] * 3 + [idf[0]]
        square = sum(x * x for x in w)
        posted.update(similar.first_terms(terms, [x * x / square for x in w], 0.85 * 0.85))
    assert max(posted.values()) == 1 and len(posted) <= 3 * n


def test_mmr_is_a_permutation(spark):
    df = spark.createDataFrame([(i, 0.5, [float(i % 3), 1.0]) for i in range(9)], "k long, r double, v array<double>")
    got = rank.mmr(df, "k", "r", "v", 0.7, 9).collect()
    assert sorted(r.k for r in got) == list(range(9)) and sorted(r["rank"] for r in got) == list(range(1, 10))


def test_querygen(spark):
    t = spark.createDataFrame([("companies", 0, "A"), ("keywords", 0, "k"), ("keywords", 1, "k"), ("solo_keywords", 0, "s")], "list_name string, pos int, term string")
    assert {r["query"] for r in querygen.build(t, "gnews").collect()} == {'"A" "k"', '"s"'}
    assert querygen.build(t.filter("list_name = 'companies'"), "openalex", ["b"]).count() == 0


def test_readers(spark, tmp_path):
    (tmp_path / "o.json").write_text('{"id":"https://o/1","title":"T","abstract_inverted_index":{"b":[1],"a":[0,2]},"open_access":{"oa_url":null}}\n{"title":null}\nbroken\n')
    got = readers.read(spark, "openalex", str(tmp_path / "o.json"), "2025-01-01T00:00:00Z").collect()
    assert [(r.title, r.link, r.summary) for r in got] == [("T", "https://o/1", "a b a")]
    (tmp_path / "f.xml").write_text("<rss><item><title>N</title><link>l</link><source>S</source></item></rss>")
    got = readers.read(spark, "gnews", str(tmp_path / "f.xml"), "now").collect()
    assert [(r.title, r.source, r.summary) for r in got] == [("N", "Google News — S", "")]
    (tmp_path / "h.json").write_text('{"title_s":["A","B"],"uri_s":"u","abstract_s":"<p>x</p>","docType_s":"ART"}\n{"title_s":"C","uri_s":"v"}\n')
    assert [r.title for r in readers.read(spark, "hal", str(tmp_path / "h.json"), "now").collect()] == ["A", "C"]
    assert readers.load_targets(spark, str(tmp_path / "none.json")).count() == 0


def test_streams(spark, tmp_path):
    from tidewatch.streaming import stream

    src = tmp_path / "in"
    for i, rows in enumerate([[("q", "s", 2, "http://a/1")], [("q", "s", 0, "http://a/1/")]]):
        spark.createDataFrame(rows, "query string, source string, hits long, link string").coalesce(1).write.mode("append").parquet(str(src))
        live = spark.readStream.schema("query string, source string, hits long, link string").parquet(str(src))
        for name, df, mode in (("seen", stream.unseen(live), "append"), ("stats", stream.stats(live), "update")):
            out = df.writeStream.format("parquet" if name == "seen" else "noop").option("checkpointLocation", str(tmp_path / f"c{name}")).outputMode(mode).trigger(availableNow=True)
            (out.start(str(tmp_path / "seen")) if name == "seen" else out.start()).awaitTermination()
        stream.upsert_sink(live, str(tmp_path / "up"), "query", "hits", str(tmp_path / "cu")).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "seen")).count() == 1
    assert spark.read.parquet(str(tmp_path / "up/1")).first()["hits"] == 2


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    def norm(v):
        return repr(round(float(v), 4) + 0.0) if isinstance(v, float) or type(v).__name__ == "Decimal" else str(v)

    df = Q.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    mine = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    r = duck.execute(Q.oracle_sql()[name])
    at = [x[0] for x in r.description]
    assert sorted(at) == cols
    assert mine == sorted(tuple(norm(x[at.index(c)]) for c in cols) for x in r.fetchall())
