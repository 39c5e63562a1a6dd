import random

from lodestone.llm import leaks as L


def brute(docs, passages, n):
    out = {}
    for qid, field, p in passages:
        w = L.words(p or "")
        for d, t in docs:
            v = L.words(t or "")
            best = 0
            for i in range(len(w)):
                for j in range(len(v)):
                    m = 0
                    while i + m < len(w) and j + m < len(v) and w[i + m] == v[j + m]:
                        m += 1
                    best = max(best, m)
            if best >= n:
                out[d, qid, field] = max(best, out.get((d, qid, field), 0))
    return out


def case(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(12)]
    passages = [(q, f, " ".join(rng.choice(vocab) for _ in range(rng.randint(2, 18)))) for q in range(8) for f in ("question", "contains")] + [(99, "question", None)]
    docs = []
    for d in range(30):
        words = [rng.choice(vocab + ["other"]) for _ in range(rng.randint(0, 40))]
        if rng.random() < 0.6:
            p = rng.choice(passages[:-1])[2].split()
            a = rng.randrange(len(p))
            words[5:5] = p[a : a + rng.randint(1, 18)]
        docs.append((d, rng.choice([" ", ", ", "\n", " <b>", "-"]).join(words).title()))
    return docs + [(100, None), (101, "")], passages


def test_against_brute_force():
    for seed in range(12):
        docs, passages = case(seed)
        for n in (3, 6):
            got = {(d, q, f): m for d, q, f, m, _, _ in L.search(L.TestSet(passages, n), docs)}
            assert got == brute(docs, passages, n)


def test_repeated_text_is_quick():
    import time

    passage = " ".join(["alpha beta gamma"] * 400)
    docs = [(1, "x " + " ".join(["alpha beta gamma"] * 333)), (2, " ".join(["beta gamma alpha"] * 300) + " y")]
    began = time.perf_counter()
    got = {(d, q): m for d, q, _, m, _, _ in L.search(L.TestSet([(7, "question", passage), (8, "contains", passage + " alpha")], 12), docs)}
    assert got == {(1, 7): 999, (1, 8): 999, (2, 7): 900, (2, 8): 900} and time.perf_counter() - began < 1.0


def test_pairs_in_slices(monkeypatch):
    docs, passages = case(5)
    want = sorted(L.search(L.TestSet(passages, 4), docs))
    monkeypatch.setattr(L, "PAIRS", 3)
    assert want and sorted(L.search(L.TestSet(passages, 4), docs)) == want


def test_places():
    docs = [(1, "x x alpha beta gamma delta"), (2, "alpha beta")]
    assert L.search(L.TestSet([(7, "question", "no Alpha, beta; GAMMA delta!")], 3), docs) == [(1, 7, "question", 4, 2, 1)]


def test_words():
    assert L.words("A<b>b</b>&amp;c_d &eacute;t\x00é <!-- x y --> 3.5 < 4 > 2") == ["a", "b", "c", "d", "ét", "é", "3", "5", "4", "2"]


def test_no_match_across_documents_or_passages():
    test = L.TestSet([(1, "question", "a b c"), (2, "question", "d e f")], 4)
    assert L.search(test, [(1, "a b"), (2, "c d e f")]) == []
    test = L.TestSet([(1, "question", "a b c d")], 4)
    assert L.search(test, [(1, "a b"), (2, "c d")]) == []


def test_table(spark, monkeypatch):
    docs, passages = case(3)
    df = spark.createDataFrame([(*d, "x") for d in docs + docs[:3]], "doc_id bigint, text string, qid string")
    by = {}
    for q, f, p in passages:
        by.setdefault(q, {})[f] = p
    qs = spark.createDataFrame([(q, v.get("question"), v.get("contains"), "x") for q, v in by.items()] + [(None, "a", "b", "x")], "qid bigint, question string, contains string, text string")
    want = set(brute(docs, passages, 6))
    got = L.find_leaks(df, qs, 6)
    assert {(r["doc_id"], r["qid"], r["field"]) for r in got.collect()} == want
    assert {r["qid"]: r["documents"] for r in L.leaked_items(got).collect()} == {q: len({d for d, x, _ in want if x == q}) for q in {q for _, q, _ in want}}
    monkeypatch.setattr(L, "MAX_TEST_WORDS", 60)  # searched in parts
    assert {(r["doc_id"], r["qid"], r["field"]) for r in L.find_leaks(df, qs, 6).collect()} == want
    assert L.find_leaks(df.limit(0), qs, 6).count() == 0 and L.find_leaks(df, qs.limit(0), 6).count() == 0


def test_corpus_without_leaks(spark):
    docs, passages = case(3)
    df = spark.createDataFrame([(*d, "x") for d in docs + docs[:3]] + [(None, "no leak", "x"), (10**6, None, "x")], "doc_id bigint, text string, qid string")
    qs = spark.createDataFrame([(q, p, None) for q, f, p in passages], "qid bigint, question string, contains string")
    found = L.find_leaks(df, qs, 6)
    gone = {r["doc_id"] for r in found.collect()}
    want = sorted((r for r in map(tuple, df.collect()) if r[0] not in gone), key=repr)
    assert gone and want
    for bound in (200_000, 0):
        kept = L.without_leaks(df, found, bound)
        assert kept.columns == df.columns and sorted(map(tuple, kept.collect()), key=repr) == want
    assert L.without_leaks(df, found.limit(0)).count() == df.count()
