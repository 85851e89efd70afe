"""Operators of the training-data problems against brute force, round trips and hand-made cases."""

import itertools
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("tidewatch.llm")

from tidewatch.llm import actors, history, language, leakage, linkage, mojibake, neardup, subset, tokenize, truncation  # noqa: E402
from tidewatch.llm.urls import canonical_url  # noqa: E402
from tidewatch.runtime import share_package  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def shared(spark):
    share_package(spark)


# 1 ---------------------------------------------------------------------------------------------------------

ARTICLE = "pos long, batch_no int, title string, link string, summary string, source string, th string, rep int"


def test_history(spark):
    rows = [
        (1, 0, "Firm reports 12 % gain with TiN films for fuel cells", "http://a.test/x?id=5&utm_source=z", None, None, "clash", 0),
        (2, 1, "RE: firm  reports 12 % gain with TiN films for fuel cells | Desk", None, None, None, None, None),
        (3, 1, "Firm reports 12 % gain with TiN films still for fuel cells", "", None, None, None, None),
        (4, 2, "Something else entirely", "https://WWW.A.test/x/?id=5#top", None, None, None, None),
        (5, 2, "Firm reports 13 % gain with TiN films for fuel cells", "http://a.test/x?id=6", None, None, None, None),
        (6, 2, "Firm reports 12 % gain with TaN films for fuel cells", None, None, None, None, None),
        (7, 3, None, None, None, None, None, None),
        (8, 3, "", "not a link", None, None, None, None),
    ]
    df = spark.createDataFrame(rows, ARTICLE)
    assert {tuple(r) for r in history.found(df).collect()} == {(1, 2), (1, 3), (1, 4)}
    assert history.found(df.limit(0)).count() == 0


def test_segment_index_finds_all_pairs_of_bounded_edit_distance(spark):
    rng = random.Random(1)
    words = "aa bb cc".split()
    titles = sorted({" ".join(rng.choice(words) for _ in range(rng.randint(3, 7))) for _ in range(60)})
    df = spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "k long, t string")
    p = history.prepare(history.described(df, "k", "t"))
    got = {tuple(sorted(r)) for r in history.probe(p, history.index_entries(p), p).collect()}

    def dist(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    allowed = lambda n: 3 if n >= 9 else 2 if n >= 4 else 1 if n >= 3 else 0
    want = {(i, j) for i, j in itertools.combinations(range(len(titles)), 2) if dist(titles[i].split(), titles[j].split()) <= allowed(min(len(titles[i].split()), len(titles[j].split())))}
    assert got == want and len(want) > 10


def test_batch_finds_longer_and_shorter_titles_of_the_index(spark):
    base = "alpha beta gamma delta epsilon zeta eta theta"
    batch = [f"new {base}", f"{base} now here", "beta gamma delta epsilon zeta eta theta", "gamma delta epsilon zeta eta theta", base.replace("delta", "other"), f"one two three {base}"]
    df = lambda texts, k: history.prepare(history.described(spark.createDataFrame([(k + i, t) for i, t in enumerate(texts)], "k long, t string"), "k", "t"))
    stored, new = df([base], 0), df(batch, 10)
    assert {tuple(r) for r in history.probe(new, history.index_entries(stored), stored).collect()} == {(i, 0) for i in range(10, 15)}


def test_batches_against_a_stored_index_equal_all_pairs(spark):
    rng = random.Random(8)
    bases = [[f"w{rng.randrange(60)}" for _ in range(rng.randint(6, 12))] for _ in range(12)]
    rows = []
    for i in range(120):
        t = list(rng.choice(bases))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(t))
            t[at : at + rng.randrange(2)] = [f"x{rng.randrange(9)}"] * rng.randrange(2)
        rows.append((i, rng.randrange(4), " ".join(t) if i % 17 else None, f"http://a.test/{rng.randrange(400)}" if i % 3 else None))
    df = spark.createDataFrame(rows, "pos long, batch_no int, title string, link string")
    whole = {tuple(r) for r in history.pieces(df, "pos", "title", "link").collect()}
    parts = {tuple(r) for r in history.pieces(df, "pos", "title", "link", [F.col("batch_no") == i for i in range(4)]).collect()}
    assert whole == parts and len(whole) > 30
    store = history.Store()
    store.add(df.filter("batch_no = 0"), "pos", "title", "link")
    before = store.titles.count()
    new = store.add(df.filter("batch_no = 1"), "pos", "title", "link")
    ids = {r[0] for r in rows if r[1] == 1}
    assert all(set(r) & ids for r in map(tuple, new.collect())) and store.titles.count() > before


@pytest.mark.parametrize("a, b, same", [("https://www.x.test/a/?b=1&utm_medium=q", "http://X.test/a?b=1#c", True), ("http://x.test/a?p=1", "http://x.test/a?p=2", False), ("http://x.test/A", "http://x.test/a", False)])
def test_canonical_url(spark, a, b, same):
    r = spark.createDataFrame([(a, b)], "a string, b string").select(canonical_url(F.col("a")), canonical_url(F.col("b"))).first()
    assert (r[0] == r[1]) is same


# 2 ---------------------------------------------------------------------------------------------------------


def test_language_held_out(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/lang_sample.parquet").select("lang", "text").orderBy("sample_id").collect()]
    fit, test = rows[::2], rows[1::2]
    got = language.Profiles(fit).classify([language.masked(t) for _, t in test])
    assert sum(g[0] == want for g, (want, _) in zip(got, test)) / len(test) > 0.98


def test_language_cases(spark):
    samples = spark.read.parquet(f"{DATA}/lang_sample.parquet")
    en, fr = ([r["text"] for r in samples.filter(F.col("lang") == x).orderBy("sample_id").limit(4).collect()] for x in ("en", "fr"))
    rows = [(1, en[0], en[1], "en-GB"), (2, en[0], f"{en[1]} {fr[0]} {fr[1]}", "eng"), (3, fr[0], fr[1], "de"), (4, None, "", None), (5, "x" * 5, None, "und"), (6, None, " ".join(en * 2000), None)]
    df = spark.createDataFrame(rows, "pos long, title string, summary string, lang string")
    assert {tuple(r) for r in language.found(df, samples).collect()} == {(2, "en"), (2, "fr"), (3, "fr"), (6, "en")}
    assert language.found(df.limit(0), samples).count() == 0
    seg = language.stretches(df, samples).filter("pos = 2").orderBy("field", "start").collect()
    text = rows[1][2]
    assert [(r.field, r.lang) for r in seg] == [("summary", "en"), ("summary", "fr"), ("title", "en")]
    assert text[seg[0].start : seg[0].end] == en[1] and text[seg[1].start : seg[1].end] == f"{fr[0]} {fr[1]}" and all(0 < r.confidence <= 1 for r in seg)


def test_every_language_keeps_its_samples(spark):
    samples = spark.read.parquet(f"{DATA}/lang_sample.parquet")
    many = samples.unionByName(samples.filter("lang = 'en'").crossJoin(spark.range(60)).select(samples.columns)).unionByName(samples)
    ja = samples.filter("lang = 'ja'").first()["text"]
    df = spark.createDataFrame([(1, ja, None, "en")], "pos long, title string, summary string, lang string")
    assert [tuple(r) for r in language.found(df, many).collect()] == [(1, "ja")]


# 3 ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("enc", ["cp1252", "latin-1", "mac_roman", "cp437", "cp1251"])
@pytest.mark.parametrize("text", ["Später heißt es 20 °C", "l’adhérence à 5 µm – déjà", "膜の密度は高い"])
def test_mojibake_round_trip(enc, text):
    try:
        bad = text.encode().decode(enc)
    except UnicodeDecodeError:
        bad = "".join(bytes([b]).decode(enc, "ignore") or chr(b) for b in text.encode())
    assert mojibake.garbled(bad) and mojibake.repair(bad) == text
    if enc == "cp1252":
        twice = "".join(bytes([b]).decode(enc, "ignore") or chr(b) for b in bad.encode())
        assert mojibake.repair(twice) == text


@pytest.mark.parametrize("text", [None, "", "plain", "SEÇÃO DE INOVAÇÃO à 5 °C", "É così – “bene” ±2 µm kΩ Å", "膜、密度", "Институт физики, Москва", "Пермь University", "мир и труд", "Гёте в Веймаре", "Ελλάδα και kΩ", "한국어 연구소", "שלום עולם", "مرحبا بالعالم", "done 😀 ok", "── total ──", "CAFÉ\xa0» été", "Łódź, Škoda, Győr"])
def test_sound_text_is_left_alone(text):
    assert not mojibake.garbled(text) and mojibake.repair(text) == text


@pytest.mark.parametrize("text", ["Привет, мир", "😀 done", "שלום עולם", "Ελλάδα", "한국어"])
def test_garbled_text_of_other_scripts_is_restored(text):
    bad = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in text.encode())
    assert mojibake.garbled(bad) and mojibake.repair(bad) == text


def test_any_number_of_layers():
    text = "déjà vu à 5 °C"
    for _ in range(6):
        text = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in text.encode())
    assert mojibake.repair(text) == "déjà vu à 5 °C"


def test_mojibake_rows(spark):
    df = spark.createDataFrame([(1, "Ã©tÃ©", None, "k"), (2, None, "a � b", None), (2, None, "a � b", None), (3, "", "fine", "")], "pos long, title string, summary string, k string")
    assert sorted(tuple(r) for r in mojibake.found(df).collect()) == [(1, "title"), (2, "summary")]
    assert mojibake.found(df.limit(0)).count() == 0


# 4 ---------------------------------------------------------------------------------------------------------


def test_linkage(spark):
    base = [("Alphacor", "TiN", 12), ("Betaluxor", "ZrN", 34), ("Gammatron", "WC", 56), ("Deltafilmo", "SiC", 78)]
    rows = [(i, f"Study of {m} for fuel cells by {f} finds a limit at {n} %", "http://desk.test/1", "Web — Desk News") for i, (f, m, n) in enumerate(base * 4)]
    a = spark.createDataFrame(rows, "pos long, title string, link string, source string").withColumn("words", F.lit(1))
    b = spark.createDataFrame(
        [(1, "Study of TiN for fuel cells by Alpahcor finds a limit at 12 %", None, None), (2, "Study of ZrN for fuel cells by Betaluxor finds a limit at 35 %", None, None), (3, "12 % is the ceiling for TiN in fuel cells, Alphacor study says", None, "Desk"), (4, None, None, None), (5, "", "", "")],
        "listing_id long, headline string, url string, outlet string",
    )
    got = linkage.match(a.filter("pos < 4").withColumn("link", F.lit(None).cast("string")), b, "pos", "title", "link", "source", "listing_id", "headline", "url", "outlet")
    assert {(r.pos, r.listing_id) for r in got.collect()} == {(0, 1), (0, 3)}
    assert linkage.found(a.limit(0), b).count() == 0 and linkage.found(a, b.limit(0)).count() == 0


def test_windows_slide_across_partitions(spark):
    rng = random.Random(9)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    rows = [(i % 3 == 0, i, f"{rng.randrange(10**6):06d}") for i in range(300)]
    both = spark.createDataFrame([(1 if b else 0, k, [s]) for b, k, s in rows], "side tinyint, k long, keys array<string>")
    both = both.select("*", *(F.lit(0).cast("bigint").alias(c) for c in ("sig", "who", "fig", "mat")))
    got = {tuple(r) for r in linkage.neighbours(both).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    order = sorted(rows, key=lambda r: (r[2], r[0], r[1]))
    want = {(x[1], y[1]) if y[0] else (y[1], x[1]) for i, x in enumerate(order) for y in order[i + 1 : i + 1 + linkage.WINDOW] if x[0] != y[0]}
    assert got == want


def test_assignment_has_the_greatest_total(spark):
    rng = random.Random(10)
    edges = [(lk, ak, rng.randint(10, 99) / 100) for lk in range(6) for ak in range(3) if rng.random() < 0.7]
    got = linkage.assign(spark.createDataFrame(edges, "lk long, ak long, confidence double"), 2, 0.001).collect()
    conf = {(lk, ak): c for lk, ak, c in edges}
    choices = [[None, *(ak for ak in range(3) if (lk, ak) in conf)] for lk in range(6)]
    best = max(sum(conf[lk, ak] for lk, ak in enumerate(c) if ak is not None) for c in itertools.product(*choices) if all(c.count(ak) <= 2 for ak in range(3)))
    assert abs(sum(r.confidence for r in got) - best) < 0.01
    assert len({r.lk for r in got}) == len(got) and max(Counter(r.ak for r in got).values()) <= 2


# 5 ---------------------------------------------------------------------------------------------------------


def test_trie_enumerates_all_neighbours():
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(2, 6))) for _ in range(150)})
    trie = actors.Trie()
    for w in words:
        trie.add(w)
    for w in words[::7]:
        assert sorted(trie.near(w, 2)) == [v for v in words if actors.edits(w, v, 2) <= 2]


def test_actors(spark):
    names = ["Welikocom Instruments KK", "welikocom-instruments", "Welikocom Instr.", "Welikocom Photonics AB", "University of Füprabesam", "Univ. Fueprabesam, Dept. of Physics", "Fuprabesam GmbH", "William H. Flusebage", "Flusebage, Will", "FLUSEBAGE William", "Wanda Flusebage", "Zarotek Institute for Surface Physics", "Zarotek ISP", "Zarotek Institute for Thin Films", None, "", "Welikocom Instruments KK"]
    df = spark.createDataFrame([(i, n, "x") for i, n in enumerate(names)], "actor_id long, name string, actor string")
    got = {tuple(r) for r in actors.found(df).collect()}
    groups = [(0, 1, 2, 16), (7, 8, 9), (11, 12)]
    assert {p for g in groups for p in itertools.combinations(g, 2)} <= got
    assert not {p for p in got if {3, 6, 10, 13} & set(p)}
    assert actors.found(df.limit(0)).count() == 0


def test_actors_join_meets_every_pair_within_the_bound(spark):
    words = ["Datugranoen", "Dtaugranon", "Kabel", "Kanel", "Morvit", "Movrit", "Xolberstein", "Yolbersteim"]
    df = spark.createDataFrame([(i, f"{w} Precision Tools SAS") for i, w in enumerate(words)], "actor_id long, name string")
    low = [w.lower() for w in words]
    want = {(i, j) for i, j in itertools.combinations(range(len(low)), 2) if actors.edits(low[i], low[j]) <= min(actors.allowed(low[i]), actors.allowed(low[j]))}
    assert want == {(0, 1), (2, 3), (4, 5), (6, 7)}
    assert {tuple(r) for r in actors.found(df).collect()} == want


# 6 ---------------------------------------------------------------------------------------------------------


def test_subset_covers_all_subjects(spark):
    subjects = ["alpha beta gamma delta", "omega sigma kappa lambda", "violin cello trumpet piano", "river lake ocean pond"]
    rows = [(i, subjects[0 if i < 400 else i % 4], None, 4, "Science") for i in range(460)] + [(900, None, None, None, None), (901, "lone", "", 1, None)]
    df = spark.createDataFrame(rows, "pos long, title string, summary string, score int, category string").withColumn("cat", F.lit(0))
    req = spark.createDataFrame([(1, 4, 3, "science"), (2, 3, 5, None), (3, 0, 1, None), (4, 1000, 1, None)], "request_id long, n_wanted int, min_score int, category string")
    got = subset.choose(df, req).collect()
    first = [r.pos for r in got if r.request_id == 1]
    assert len(set(first)) == 4 and {rows[p][1] for p in first} == set(subjects)
    assert {r.request_id for r in got} == {1, 4} and len({r.pos for r in got if r.request_id == 4}) == 461
    assert subset.choose(df.limit(0), req).count() == 0


def test_choice_is_more_varied_than_chance(spark):
    articles = spark.read.parquet(f"{DATA}/article.parquet").filter("score is not null")
    req = spark.createDataFrame([(1, 20, 1, None)], "request_id long, n_wanted int, min_score int, category string")
    rows = articles.select("pos", "title", "summary", "score").orderBy("pos").toPandas()
    x = subset.vectors(rows["title"], rows["summary"], rows["score"])
    spread = lambda at: float(subset._apart(x, x[at]).min(1).mean())
    own = spread([int(rows.index[rows["pos"] == r.pos][0]) for r in subset.choose(articles, req).collect()])
    rng = random.Random(7)
    chance = sorted(spread(rng.sample(range(len(rows)), 20)) for _ in range(50))
    assert own < chance[5]


# 7 ---------------------------------------------------------------------------------------------------------


def test_neardup_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([14, 30, 60, 90]))]
        texts.append(" ".join(base))
        for rate in (0.05, 0.1, 0.4):
            texts.append(" ".join(w if rng.random() > rate else rng.choice(vocabulary) for w in base))
    texts += [texts[0], texts[0], None, "", "  "]
    df = spark.createDataFrame([(i, None if i % 2 else "", t) for i, t in enumerate(texts)], "pos long, title string, summary string").withColumn("bag", F.lit(1))
    got = {tuple(r) for r in neardup.found(df).collect()}

    def alike(a, b):
        x, y = Counter(a.split()), Counter(b.split())
        return sum((x & y).values()) >= neardup.SHARE * max(sum(x.values()), sum(y.values()))

    real = [(i, t) for i, t in enumerate(texts) if t and t.strip()]
    want = {(i, j) for (i, a), (j, b) in itertools.combinations(real, 2) if alike(a, b)}
    assert got <= want and len(got) >= 0.97 * len(want)
    assert neardup.found(df.limit(0)).count() == 0


def test_neardup_lists_of_many_parts_are_short_and_come_in_rounds(spark, monkeypatch):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(900)]
    texts = []
    for n in [60, 78, 82, 100, 136, 144, 220] * 12:  # about the sizes where signatures grow
        base = [rng.choice(vocabulary) for _ in range(n)]
        texts += [" ".join(base), " ".join(base[: n - 6]), " ".join(base + [rng.choice(vocabulary) for _ in range(6)]), " ".join(w if rng.random() > 0.12 else "x" for w in base)]
    bags = [neardup.Codes().of("", t) for t in texts]
    got = list(neardup.blocks(np.arange(len(bags)), bags, np.zeros(neardup.COUNTERS, np.int64), 1.0, 50))
    size = np.array([len(b) // 4 for b in bags])
    assert sum(len(r[8]) for r in got) < 0.7 * 64 * sum(r[2] for r in got)  # bytes of signatures, over texts of each part
    s = neardup.signatures(*neardup._features(bags)[1:3], len(bags))
    back = neardup._unpack_signs(neardup._pack_signs(s, size), size)
    assert (neardup._folded(back, 2) == neardup._folded(s, 2)).all() and (back[size > 140] == s[size > 140]).all()
    tables = []
    monkeypatch.setattr(neardup, "cut", lambda df, f=neardup.cut: tables.append(1) or f(df))
    monkeypatch.setattr(neardup, "TASK", 1_000)
    monkeypatch.setattr(neardup, "AT_ONCE", 6)
    df = spark.createDataFrame([(i, "", t) for i, t in enumerate(texts)], "pos long, title string, summary string")
    found = [tuple(r) for r in neardup.found(df).collect()]
    counts = [Counter(t.split()) for t in texts]
    want = {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if sum((counts[i] & counts[j]).values()) >= neardup.SHARE * max(size[i], size[j])}
    assert len(tables) > 3 and len(want) > 300 and len(found) == len(set(found)) and want == set(found)


def test_large_family_of_variants_stays_linked(spark):
    rng = random.Random(4)
    base = [f"t{i}" for i in range(80)]
    texts = [" ".join(w if rng.random() > 0.04 else f"x{rng.randrange(1000)}" for w in base) for _ in range(120)]
    df = spark.createDataFrame([(i, "t", t) for i, t in enumerate(texts)], "pos long, title string, summary string")
    n = neardup.found(df).count()
    assert n >= 0.9 * 120 * 119 / 2, n


def test_families_of_hundreds_at_the_five_sixths_edge_are_whole(spark):
    rng = random.Random(5)
    texts = []
    for f in range(2):
        base = [f"t{f}.{i}" for i in range(80)]
        texts += [" ".join(w if rng.random() > 1 / 11 else f"x{rng.randrange(1000)}" for w in base) for _ in range(200)]
    for f in range(100):  # families of two, 13 of 80 words other
        base = [f"p{f}.{i}" for i in range(80)]
        other = set(rng.sample(range(80), 13))
        texts += [" ".join(base), " ".join(f"y{rng.randrange(1000)}" if i in other else w for i, w in enumerate(base))]
    df = spark.createDataFrame([(i, "t", t) for i, t in enumerate(texts)], "pos long, title string, summary string")
    got = {tuple(r) for r in neardup.found(df).collect()}
    bags = [Counter(neardup.words("t", t)) for t in texts]

    def alike(i, j):
        x, y = bags[i], bags[j]
        return sum((x & y).values()) >= neardup.SHARE * max(sum(x.values()), sum(y.values()))

    want = {(i, j) for part in (range(200), range(200, 400)) for i, j in itertools.combinations(part, 2) if alike(i, j)}
    want |= {(i, i + 1) for i in range(400, 600, 2) if alike(i, i + 1)}
    assert len(want) > 20_000 and want == got, (len(want), len(want - got), len(got - want))


# 8 ---------------------------------------------------------------------------------------------------------


@pytest.mark.skipif(not os.path.exists(tokenize.TOKENIZER_DIR), reason="no vocabulary files here")
def test_tokenize_matches_the_public_encoder_and_round_trips(spark):
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers as P

    texts = [None, "", " ", "a  b", "x\n  y", "  \n\n ", "don't I'll", "<|endoftext|>", "日本語 の文。", "a b 　c", "TiO2 12.50 µm — é😀", "word " * 3000, "tab\t x \r\n y  ", "\x1c\x1d a", "z" * 60]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, c string")
    ranks = tokenize.load_ranks()
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for bound in (tokenize.LITERAL_WORDS, 3):
        got = tokenize.encode(df, "doc_id", "text", ranks, literal_words=bound)
        assert {r.doc_id: r.ids for r in got.collect()} == {i: enc.encode_ordinary(t or "") for i, t in enumerate(texts)}
    back = tokenize.decode(got, "doc_id", "ids", ranks)
    assert {r.doc_id: r.text for r in back.collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert tokenize.encode(df.limit(0), "doc_id", "text", ranks).count() == 0


# 9 ---------------------------------------------------------------------------------------------------------


def test_leakage(spark):
    rng = random.Random(5)
    item = [f"item{i}" for i in range(50)]
    other = [f"other{i}" for i in range(50)]
    noise = lambda n: [f"n{rng.randrange(10**6)}" for _ in range(n)]
    changed = item[10:34]
    changed[7] = "changed"
    twice = item[10:32]
    twice[5], twice[12] = "x", "y"
    docs = [noise(300) + item[:22] + noise(300), [w.upper() + "," for w in changed], item[:19] + noise(40), twice + noise(9), noise(5), noise(50) + other + item, item[5:15] + noise(3) + item[15:25]]
    df = spark.createDataFrame([(i, " ".join(d), 0) for i, d in enumerate(docs)] + [(90, None, 0), (91, "", 0)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(other)), (3, None), (4, "too short")], "item_id long, text string")
    assert {tuple(r) for r in leakage.found(df, items).collect()} == {(0, 1), (1, 1), (5, 1), (5, 2)}
    named = items.select(F.concat(F.lit("item-"), F.col("item_id").cast("string")).alias("item_id"), "text")
    assert {tuple(r) for r in leakage.found(df, named).collect()} == {(0, "item-1"), (1, "item-1"), (5, "item-1"), (5, "item-2")}
    whole = leakage.ITEM_BLOCK
    leakage.ITEM_BLOCK = 1  # several blocks, one scan
    plan = leakage.found(df, items)
    assert {tuple(r) for r in plan.collect()} == {(0, 1), (1, 1), (5, 1), (5, 2)}
    assert plan._jdf.queryExecution().toString().count("PythonMapInArrow") + plan._jdf.queryExecution().toString().count("MapInArrow") > 0
    leakage.ITEM_BLOCK = whole
    assert leakage.found(df, items.limit(0)).count() == 0 and leakage.found(df.limit(0), items).count() == 0


def test_block_max_wand_returns_what_full_scoring_does():
    rng = random.Random(6)
    words = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(words) for _ in range(60))) for i in range(40)]
    index = leakage.Index(items)
    for i in range(0, 40, 3):
        terms = [t for t, p in index.lists.items() if rng.random() < 0.05 or any(at == i for at, _ in p) and rng.random() < 0.6]
        score = Counter()
        for t in terms:
            for at, x in index.lists[t]:
                score[at] += x
        assert sorted(index.search(terms)) == sorted(at for at, x in score.items() if x >= 1)


# 10 --------------------------------------------------------------------------------------------------------


def test_truncation(spark):
    whole = "The coating was measured again and the semiconductor stayed within bounds. "
    rows = [(i, whole * 3 + f"Run {i} ended.") for i in range(6)]
    rows += [(10, whole * 2 + "After the run the semic"), (11, whole + "and so on…"), (12, whole + "It was [+20 chars]"), (13, whole + "\nKeywords: coating, bounds"), (14, whole + "\n© 2024 Firm semicon"), (15, whole + "\nhttps://a.test/doc/12"), (16, None), (17, ""), (18, " \n "), (19, whole + "\n[3] Author, Journal, 4, 5 (2020)"), (20, whole * 2 + "Again the coating was"), (21, "短い文である。"), (22, "短い文である。次の文は")]
    sound = ["Headline without full stop about coatings", "- one\n- two\n- three", whole + "\nYours sincerely\nMaria Rossi", "Total = 12 kg", "def f(x):\n    return x + 1", whole + "Seen at https://a.test/x", "Dr. Rossi wins the prize"]
    rows += [(30 + i, t) for i, t in enumerate(sound)]
    rows += [(50 + i, (f"{'abcdefghij'[i]}{i} " * 40)[: 90 - i % 2] + " the coating was measured"[: 10 + i % 2]) for i in range(5)]  # a field limit of 100
    rows += [(60, " " * 80 + whole + "Again the")]
    df = spark.createDataFrame([(k, t, "s") for k, t in rows], "doc_id long, text string, source string").withColumn("line", F.lit(0))
    got = {r.doc_id: r.why for r in truncation.detect(df, "doc_id", "text").filter("cut").collect()}
    assert got == {10: "prefix", 11: "mark", 12: "mark", 14: "prefix", 20: "open", 22: "open", 60: "open"} | {k: got.get(k) for k in range(50, 55)}
    assert all(got[k] in ("limit", "prefix") for k in range(50, 55))
    r = truncation.rates(df).first()
    assert (r["n"], r["n_cut"]) == (len(rows) - 3, 12)
    assert truncation.found(df.limit(0)).count() == 0


def test_trie_counts_what_lies_below_a_final_token(spark):
    words = spark.createDataFrame([("semiconductor", 5), ("seminar", 2), ("se", 9), ("other", 4)], "w string, n long")
    finals = spark.createDataFrame([("se",), ("semi",), ("semic",), ("seminar",), ("x",), ("o",)], "w string")
    assert {tuple(r) for r in truncation.trie(words, finals).collect()} == {("se", 7), ("semi", 7), ("semic", 5), ("o", 4)}
