import math

import numpy as np
import pytest

from lodestone.operators import bm25, dense, fusion, rerank
from lodestone.operators.filters import allowed_chunks
from lodestone.operators.index import as_documents, corpus_stats, document_frequency, postings
from lodestone.operators.search import Collection, Mode

TEXTS = ["the cat sat on the mat", "a cat and a dog play in the garden near the house", "dogs bark loudly", "cat cat cat"]


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [(f"d{i}#0", f"guides/d{i}.md" if i % 2 else f"faq/d{i}.md", "", "", t, i) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "id string, source string, title string, heading string, text string, doc_id bigint")
    return df.unionByName(df.limit(1))  # a repeated row


def ask(spark, *questions):
    return spark.createDataFrame(list(enumerate(questions)), "qid bigint, question string")


def by_hand(question, docs):
    toks = [dense.tokens(d) for d in docs]
    avg = sum(map(len, toks)) / len(toks)
    out = {}
    for t in set(dense.tokens(question)):
        df = sum(t in x for x in toks)
        w = math.log(1 + (len(docs) - df + 0.5) / (df + 0.5))
        for i, x in enumerate(toks):
            if tf := x.count(t):
                out[i] = out.get(i, 0) + w * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(x) / avg))
    return out


def test_bm25(spark, chunks):
    rows = bm25.search(as_documents(chunks), ask(spark, "cat", "dogs near cat", "", "of the"), 10).collect()
    got = {(r["qid"], int(r["id"][1])): r["score"] for r in rows}
    for q, text in enumerate(["cat", "dogs near cat"]):
        want = by_hand(text, TEXTS)
        assert {i for k, i in got if k == q} == set(want)
        for i, s in want.items():
            assert got[q, i] == pytest.approx(s)
    assert {i for k, i in got if k == 0} == {0, 1, 3}
    assert min(r["rank"] for r in rows if r["id"] == "d3#0" and r["qid"] == 0) == 1
    assert not [k for k, _ in got if k > 1]


def test_filters_leave_statistics_alone(spark, chunks):
    q = ask(spark, "cat")
    every = {r["id"]: r["score"] for r in bm25.search(as_documents(chunks), q, 10).collect()}
    allowed = allowed_chunks(chunks, sources=["guides/*"])
    some = {r["id"]: r["score"] for r in bm25.search(as_documents(chunks), q, 10, allowed).collect()}
    assert some == {i: s for i, s in every.items() if i in ("d1#0", "d3#0")}
    docs = spark.createDataFrame([(1, ["Ops "]), (3, None)], "doc_id bigint, tags array<string>")
    assert [r["id"] for r in allowed_chunks(chunks, docs, tags=["ops"]).collect()] == ["d1#0"]
    assert allowed_chunks(chunks) is None
    assert bm25.search(as_documents(chunks), q, 10, allowed_chunks(chunks, sources=["none/*"])).count() == 0


def test_more_terms_than_are_sent(spark, chunks, monkeypatch):
    q = ask(spark, "dogs near cat", "garden")
    key = lambda: sorted((r["qid"], r["id"], round(r["score"], 9), r["rank"]) for r in bm25.search(as_documents(chunks), q, 3).collect())
    sent = key()
    monkeypatch.setattr(bm25, "CELLS", 2)
    assert key() == sent
    monkeypatch.setattr(bm25, "PAIRS", 1)
    assert key() == sent


def test_more_pairs_than_are_sent(spark, chunks, monkeypatch):
    q = ask(spark, "cat dog", "dog cat", "cat", "dog", "garden house", "house")
    key = lambda: sorted((r["qid"], r["id"], round(r["score"], 9), r["rank"]) for r in bm25.search(as_documents(chunks), q, 3).collect())
    sent = key()
    monkeypatch.setattr(bm25, "PAIRS", 5)  # four terms, nine pairs
    assert key() == sent


def test_a_task_hands_on_k_rows_of_different_questions(spark, monkeypatch):
    docs = spark.createDataFrame([(f"d{i:04}", "a cat and a dog") for i in range(2000)], "id string, text string").coalesce(1)
    real, handed = bm25.top, []
    monkeypatch.setattr(bm25, "top", lambda scored, k: handed.append(scored.count()) or real(scored, k))
    rows = bm25.search(docs, ask(spark, "cat", "Cats?", "dog cat", "cats, dogs"), 3).collect()
    assert sum(handed) <= 2 * 3 * spark.sparkContext.defaultParallelism  # two different questions
    assert sorted((r["qid"], r["rank"], r["id"]) for r in rows) == [(q, n + 1, f"d000{n}") for q in range(4) for n in range(3)]


def test_blocks_and_pruning_lose_nothing(spark, monkeypatch):
    rng = np.random.default_rng(3)
    words = np.array(["cat", "dog", "house", "garden", "mat", "limit", "query", "index", "token", "worker"])
    share = np.array([0.4, 0.2, 0.1, 0.1, 0.05, 0.05, 0.04, 0.03, 0.02, 0.01])
    texts = [" ".join(rng.choice(words, rng.integers(1, 12), p=share)) for _ in range(300)]
    questions = [" ".join(rng.choice(words, rng.integers(1, 6), replace=False)) for _ in range(25)]
    docs = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "id string, text string").repartition(2)
    want = []
    for q, text in enumerate(questions):
        best = sorted((-round(s, 9), f"d{i}") for i, s in by_hand(text, texts).items())
        want += [(q, n + 1, i) for n, (_, i) in enumerate(best[:5])]
    got = lambda: sorted((r["qid"], r["rank"], r["id"]) for r in bm25.search(docs, ask(spark, *questions), 5).collect())
    assert got() == sorted(want)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        for name, value in (("FIRST", 8), ("BLOCK", 40), ("WHOLE", 1), ("KEPT", 12)):
            monkeypatch.setattr(bm25, name, value)
            assert got() == sorted(want), name
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_questions_with_their_own_k(spark, chunks, monkeypatch):
    q = spark.createDataFrame([(1, "cat", 1), (2, "cat", 2), (3, "cat", None), (4, "dog", 9)], "qid bigint, question string, k int")
    n = lambda: {r["qid"]: r["count"] for r in bm25.search(as_documents(chunks), q, 3, own="k").groupBy("qid").count().collect()}
    assert n() == {1: 1, 2: 2, 3: 3, 4: 2}
    for name in ("KEPT", "PAIRS"):
        monkeypatch.setattr(bm25, name, 1)
        assert n() == {1: 1, 2: 2, 3: 3, 4: 2}


def test_empty_collection(spark, chunks):
    empty = chunks.limit(0)
    assert bm25.search(as_documents(empty), ask(spark, "cat"), 5).count() == 0
    assert Collection(empty).search(ask(spark, "cat"), 5, "hybrid").count() == 0


def test_stored_postings_rank_alike(spark, chunks, monkeypatch):
    docs = as_documents(chunks)
    stored = Collection(chunks, tf=postings(docs), stats=corpus_stats(docs))
    q = ask(spark, "dogs near cat")
    key = lambda d: [(r["id"], round(r["score"], 9), r["rank"]) for r in d.orderBy("rank").collect()]
    want = key(Collection(chunks).lexical(q, 5))
    assert want and key(stored.lexical(q, 5)) == want
    for name in ("NAMED", "PAIRS"):
        monkeypatch.setattr(bm25, name, 1)
        assert key(stored.lexical(q, 5)) == want


def test_hashing_embedder():
    e = dense.HashingEmbedder(256)
    a, b, blank = e.embed(["How to authenticate?", "How to authenticate?", "  "])
    assert np.array_equal(a, b) and np.dot(a, a) == pytest.approx(1, abs=1e-5) and not blank.any()
    x, y = dense.HashingEmbedder().embed(["authentication", "authentcation"])
    assert float(x @ y) > 0.5
    with pytest.raises(ValueError):
        dense.embedder("word2vec")


def test_embedding_by_hand():
    import hashlib

    text, dim = "limits queries limit", 16
    weights = {}
    words = ["limit", "query", "limit"]
    for w in words:
        weights["w:" + w] = weights.get("w:" + w, 0) + 1.0
        p = f"<{w}>"
        for i in range(len(p) - 2):
            weights["c:" + p[i : i + 3]] = weights.get("c:" + p[i : i + 3], 0) + 0.3
    for a, b in zip(words, words[1:]):
        weights[f"b:{a} {b}"] = weights.get(f"b:{a} {b}", 0) + 0.7
    v = np.zeros(dim)
    for f, x in weights.items():
        h = int.from_bytes(hashlib.blake2b(f.encode(), digest_size=8).digest(), "little")
        v[h % dim] += (1 if h >> 63 else -1) * math.log1p(x)
    got = dense.HashingEmbedder(dim).embed(["", text, None, "the of"])
    assert np.allclose(got[1], v / np.linalg.norm(v), atol=1e-6) and not got[[0, 2, 3]].any()
    assert dense.HashingEmbedder(dim).embed([]).shape == (0, dim)


def test_dense_against_brute_force(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 16)).astype(np.float32)
    v[7] = v[3]  # a tie
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(300, [0.0] * 16), (301, None), (302, [float("nan")] * 16)]
    df = spark.createDataFrame(rows, "id bigint, vector array<float>")
    q = spark.createDataFrame([(i, rows[i][1]) for i in (0, 3, 150, 300)], "qid bigint, vector array<float>")
    got = {}
    for r in dense.search(df, q, 10).collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["id"]))
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1)[:, None]
    for i in (0, 3, 150):
        want = sorted(((-round(float(u[i] @ u[j]), 9), j) for j in range(300) if u[i] @ u[j] > 0))[:10]
        assert [j for _, j in sorted(got[i])] == [j for _, j in want]
    assert 300 not in got


def test_dense_queries_in_parts(spark, monkeypatch):
    v = [(i, [float(i == j) + 0.1 for j in range(4)]) for i in range(4)]
    df, q = spark.createDataFrame(v, "id bigint, vector array<float>"), spark.createDataFrame(v, "qid bigint, vector array<float>")
    whole = sorted(map(tuple, dense.search(df, q, 2).select("qid", "id", "rank").collect()))
    monkeypatch.setattr(dense, "QUERIES", 2)
    assert sorted(map(tuple, dense.search(df, q, 2).select("qid", "id", "rank").collect())) == whole


def test_repeated_vectors_leave_room_for_others(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0])] * 30 + [("b", [1.0, 0.1]), ("c", [1.0, 0.2])], "id string, vector array<float>").coalesce(1)
    got = dense.search(df, spark.createDataFrame([(1, [1.0, 0.0])], "qid int, vector array<float>"), 3)
    assert [r["id"] for r in got.orderBy("rank").collect()] == ["a", "b", "c"]


def test_distinct_rows(spark, monkeypatch):
    import random

    from lodestone import session

    rng = random.Random(1)
    rows = [(rng.choice([None, *"abcdefghij"]) if rng.random() < 0.5 else f"k{n}", rng.choice([None, "x", "y"])) for n in range(300)]
    df = spark.createDataFrame(rows, "id string, text string")
    for buckets in (1 << 20, 3):
        monkeypatch.setattr(session, "BUCKETS", buckets)
        got = [tuple(r) for r in session.distinct_rows(df, flag="again").collect()]
        assert sorted((r[:2] for r in got), key=repr) == sorted(set(rows), key=repr)
        assert all(again for i, _, again in got if [x for x, _ in rows].count(i) > 1)
    assert session.distinct_rows(df.limit(0)).count() == 0


def ranking(spark, ids):
    return spark.createDataFrame([(0, i, r) for r, i in enumerate(ids, 1)], "qid bigint, id bigint, rank int")


def test_rrf(spark):
    got = fusion.top(fusion.rrf({"a": ranking(spark, [1, 2, 3]), "b": ranking(spark, [2, 1, 4])}), 10).orderBy("rank").collect()
    assert got[0]["score"] == pytest.approx(1 / 61 + 1 / 62)
    assert [r["id"] for r in got] == [1, 2, 3, 4]
    assert got[3]["ranks"] == {"b": 3}


def test_min_span_and_proximity():
    assert rerank.min_span([[0, 9], [5]]) == 5
    assert rerank.min_span([[3]]) == 1
    assert rerank.min_span([[0, 4], [1], [2]]) == 3
    one = {"rate": 1.0, "limit": 1.0}
    near, far = ["rate", "limit", "x"], ["rate", "x", "x", "x", "limit"]
    assert rerank.proximity_score(one, near) == 1.0
    assert rerank.proximity_score(one, ["rate"]) < rerank.proximity_score(one, far) < 1.0
    assert rerank.proximity_score(one, ["x"]) == 0.0 == rerank.proximity_score({}, near)


def test_mmr_order():
    same = np.array([[1.0, 0], [1.0, 0], [0, 1.0]])
    assert rerank.mmr_order([1.0, 0.8, 0.5], same, 2) == [0, 2]
    assert rerank.mmr_order([0.2, 0.9, 0.5], np.zeros((3, 1)), 3, lam=1.0) == [1, 2, 0]


def test_modes_and_rerankers(spark, chunks):
    c, q = Collection(chunks), ask(spark, "cat and dog in the garden", " ")
    for mode in ("bm25", "dense", "hybrid"):
        for how in (None, "proximity", "mmr"):
            rows = c.search(q, 3, mode, how).collect()
            assert rows and {r["qid"] for r in rows} == {0} and sorted(r["rank"] for r in rows) == list(range(1, len(rows) + 1))
            assert all(r["ranks"] for r in rows)
    hits = c.hits(c.search(q, 2, "bm25")).orderBy("rank").collect()
    assert hits[0]["id"] == "d1#0" and hits[0]["text"] == TEXTS[1]
    for bad in ({"mode": "x"}, {"reranker": "x"}, {"k": 0}):
        with pytest.raises(ValueError):
            c.search(q, **bad)


def test_mode_specs():
    assert Mode.parse("hybrid+mmr") == Mode("hybrid", "mmr") and Mode.parse("bm25+multi", True) == Mode("bm25", None, True)
    for bad in ("x", "bm25+x", "bm25+mmr+proximity", "bm25+multi"):
        with pytest.raises(ValueError):
            Mode.parse(bad)


def test_multi_search(spark, chunks):
    c = Collection(chunks)
    w = spark.createDataFrame([(0, 1, "cat"), (0, 2, "garden"), (1, 1, "cat")], "qid bigint, n int, question string")
    rows = c.multi_search(w, 5, "bm25").collect()
    two = {r["id"]: r for r in rows if r["qid"] == 0}
    assert two["d1#0"]["ranks"] == {"q1": 3, "q2": 1} and two["d1#0"]["score"] == pytest.approx(1 / 63 + 1 / 61)
    plain = {r["id"]: r["score"] for r in c.search(ask(spark, "cat"), 5, "bm25").collect()}
    assert {r["id"]: r["score"] for r in rows if r["qid"] == 1} == plain


def test_document_frequency(spark, chunks):
    df = {r["term"]: r["df"] for r in document_frequency(postings(as_documents(chunks))).collect()}
    assert df["cat"] == 3 and df["dog"] == 2 and "the" not in df
