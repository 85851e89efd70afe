from tidewatch.operators import digest, scoring


def articles(spark):
    rows = [(1, "TiN films", None, "A — b", "l", "2025", ["x"]), (2, "none", "hard TiN <b>", None, None, None, None), (3, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "pos long, title string, summary string, source string, link string, collected_at string, tags array<string>")


def test_score_and_digest(spark):
    got = scoring.score(articles(spark), scoring.rule_scorer(["tin", "hard"]))
    assert {(r.pos, r.score) for r in got.collect()} == {(1, 2), (2, 3)}
    page = digest.render(got)
    assert "TiN films" in page and "&lt;b&gt;" in page and digest.recap(got) == {"total": 2, "fives": 0, "fours": 0}
    assert scoring.score(articles(spark).limit(0), scoring.rule_scorer([])).count() == 0


def test_failed_batches_are_split(spark):
    def fussy(batch):
        if len(batch) > 1:
            raise ValueError("too long")
        return scoring.rule_scorer(["tin"])(batch)

    one = articles(spark).coalesce(1)
    assert {r.pos for r in scoring.score(one, fussy).collect()} == {1, 2}
