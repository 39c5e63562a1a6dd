import random
from collections import defaultdict

from lodestone.llm import ranking as R

HIT = "hit_id bigint, ask_id bigint, retriever string, id string, score double, ranks map<string,int>"


def frame(spark, rows):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], HIT).selectExpr("*", "1 AS rank", "2 AS place", "3 AS sign", "4 AS better")


def truth(lists):
    """Fused winners from full rankings {(ask, retriever): [ids best first]}."""
    s = defaultdict(lambda: defaultdict(float))
    for (ask, _), ids in lists.items():
        for n, i in enumerate(ids, 1):
            s[ask][i] += 1 / (60 + n)
    return {a: min(x, key=lambda i: (-round(x[i], 12), i)) for a, x in s.items()}


def test_against_brute_force(spark):
    rng = random.Random(4)
    lists, rows = {}, []
    scale = {"bm25": (1, 20), "distance": (-1, 1), "clicks": (1, 1e6), "judge": (1, 3)}
    for ask in range(40):
        ids = [f"c{i}" for i in range(rng.randint(3, 15))]
        for name, (sign, width) in scale.items():
            order = rng.sample(ids, rng.randint(2, len(ids)))
            lists[ask, name] = order
            score = sorted((rng.random() ** 3 * width for _ in order), reverse=sign > 0)
            for n, (i, s) in enumerate(zip(order, score), 1):
                lost = rng.random()
                row = (ask, rng.choice([name, name.upper()]), i, None if lost < 0.1 else float("nan") if lost < 0.2 else s, None if lost > 0.8 else {name: n, "hybrid": rng.randint(1, 9)})
                rows += [row] * rng.choice([1, 1, 2])
    rng.shuffle(rows)
    assert dict(map(tuple, R.winners(frame(spark, rows)).collect())) == truth(lists)
    first = {r["ask_id"]: r["id"] for r in R.fuse(frame(spark, rows)).collect() if r["place"] == 1}
    assert first == truth(lists)
    got = {(r["ask_id"], r["retriever"], r["id"]): r["place"] for r in R.retriever_ranks(frame(spark, rows)).collect()}
    assert got == {(a, n, i): k for (a, n), ids in lists.items() for k, i in enumerate(ids, 1)}


def test_edges(spark):
    rows = [(1, "x", "b", None, None), (1, "x", "a", None, None), (1, "X ", "c", 5.0, {}), (2, "x", "q", 1.0, None), (2, "y", "p", 1.0, None), (None, "x", "a", 1.0, None), (3, None, "a", 1.0, None), (4, "x", None, 1.0, None), (5, "x", "z", 1.0, {"x": None})]
    # the scored one first, the others by id; equal totals go to the smaller id
    got = {(r["ask_id"], r["id"]): r["place"] for r in R.fuse(frame(spark, rows)).collect()}
    assert got == {(1, "c"): 1, (1, "a"): 2, (1, "b"): 3, (2, "p"): 1, (2, "q"): 2, (5, "z"): 1}
    assert R.winners(frame(spark, rows[:0] or [(None, None, None, None, None)])).count() == 0
    assert R.winners(frame(spark, rows).limit(0)).count() == 0


def test_large_groups_in_parts(spark, monkeypatch):
    rng = random.Random(9)
    rows = []
    for ask in range(6):
        for name in ("x", "y"):
            for i in range(rng.choice([2, 9, 60])):
                score = rng.choice([None, float("nan"), float(rng.randint(0, 9)), rng.random() * 9])
                rows.append((ask, name, f"c{i}", score, rng.choice([None, {name: rng.randint(1, 70)}, {name: i + 1}])))
    places = lambda: sorted(map(tuple, R.retriever_ranks(frame(spark, rows)).collect()))
    fused = lambda: sorted((r["ask_id"], r["place"], r["id"], r["score"]) for r in R.fuse(frame(spark, rows)).collect())
    whole, ranking = places(), fused()
    for bound in (0, 20):
        monkeypatch.setattr(R, "GROUP", bound)
        assert places() == whole
        assert fused() == ranking
