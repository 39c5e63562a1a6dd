import math
import re
from collections import Counter

import pytest

from lodestone.llm import distinctive as D
from lodestone.llm import queries as Q

ROWS = [("a", "Head", "alpha alpha beta the the the"), ("a", "Head", "alpha alpha beta the the the"), ("b", None, "beta gamma the v2.1 x-y_z"), ("c", "", None), ("d", "The", "the delta Alpha"), ("e", None, "…!?")]


def brute(rows, prior):
    docs = [(i, Counter(re.findall(D.TERM, f"{h or ''}\n{t or ''}".lower()))) for i, h, t in dict.fromkeys(rows)]
    cf, df = Counter(), Counter(w for _, w in {(i, w) for i, c in docs for w in c})
    for _, c in docs:
        cf.update(c)
    total, out = sum(cf.values()), {}
    for i, c in docs:
        n = sum(c.values())
        for w, y in c.items():
            a, o = prior * cf[w] / total, cf[w] - y
            delta = math.log((y + a) / (n + prior - y - a)) - math.log((o + a) / (total - n + prior - o - a))
            out[i, w] = (y, cf[w], df[w], delta / math.sqrt(1 / (y + a) + 1 / (o + a)))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0, 0.0) for r in rows], "id string, heading string, text string, tf int, z double")


def test_against_brute_force(spark):
    want = brute(ROWS, 50.0)
    got = {(r["id"], r["term"]): r for r in D.term_scores(frame(spark, ROWS), prior=50.0).collect()}
    assert got.keys() == want.keys()
    for k, (tf, cf, df, z) in want.items():
        assert (got[k]["tf"], got[k]["cf"], got[k]["df"]) == (tf, cf, df) and got[k]["z"] == pytest.approx(z)
    # a term all over the collection says little about a record
    assert got["a", "alpha"]["z"] > got["a", "the"]["z"]


def test_filters_only_filter(spark):
    want = {k for k, v in brute(ROWS, 500.0).items() if v[0] >= 2 and v[2] <= 2}
    assert {(r["id"], r["term"]) for r in D.term_scores(frame(spark, ROWS), min_count=2, max_df=2).collect()} == want == {("a", "alpha")}


def test_frequent_terms_are_joined_apart(spark, monkeypatch):
    rows = [(f"r{i}", None, f"common term{i} term{i % 7}") for i in range(3000)]
    got = D.term_scores(frame(spark, rows))
    want = brute(rows, 500.0)
    sample = {(r["id"], r["term"]): r["df"] for r in got.collect()}
    assert sample == {k: v[2] for k, v in want.items()}  # "common" has df 3000, over the bound of 1000
    capped = {(r["id"], r["term"]) for r in D.term_scores(frame(spark, rows), max_df=2000).collect()}
    assert capped == {k for k, v in want.items() if v[2] <= 2000}


def test_ids_with_several_rows_count_once(spark):
    rows = [*ROWS, ("b", "other", "beta beta gamma gamma gamma"), ("b", "other", "beta beta gamma gamma gamma"), (None, None, "beta null"), (None, "x", "beta")]
    want = brute(rows, 50.0)
    got = D.term_scores(frame(spark, rows), prior=50.0).collect()
    assert {r["term"]: r["df"] for r in got if r["id"] == "b"}["beta"] == want["b", "beta"][2] == 3
    assert len([r for r in got if (r["id"], r["term"]) == ("b", "beta")]) == 2  # both rows are scored
    assert {(r["id"], r["term"], r["df"], r["cf"]) for r in got} == {(i, w, v[2], v[1]) for (i, w), v in want.items()}


def test_every_term_is_scored_before_the_choice(spark, tmp_path):
    rows = [*ROWS, ("f", None, "rare rare rare")]
    frame(spark, rows).write.parquet(str(tmp_path / "chunks.parquet"))
    found = Q.p2_found(spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == sorted(k for k, v in brute(rows, 500.0).items() if v[0] >= 3 and v[2] <= 5)
    choosing = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if ">= 3" in line]
    assert choosing and all("ln(" in line and "SQRT(" in line for line in choosing)
    # without a prior a term of one record alone has no score: an error, though its row isn't wanted
    with pytest.raises(Exception, match="(?i)without a score|division by zero"):
        D.term_scores(frame(spark, ROWS), prior=0.0, min_count=3).select("id", "term").collect()


def test_one_distinct_term(spark):
    rows = [("a", None, "foo foo foo"), ("b", "Foo", None)]
    assert [math.isnan(r["z"]) for r in D.term_scores(frame(spark, rows)).collect()] == [True, True]
    assert [(r["id"], r["term"]) for r in D.term_scores(frame(spark, rows), min_count=3, max_df=5).collect()] == [("a", "foo")]


def test_empty(spark):
    assert D.term_scores(frame(spark, ROWS).limit(0)).count() == 0
    monkey = [("c", None, None)]
    assert D.term_scores(frame(spark, monkey)).count() == 0
