import numpy as np
import pytest

from lodestone.llm import neighbours as N


def brute(rows, least):
    u = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) == 64 and i not in u:
            a = np.array(v, float)
            if np.isfinite(a).all() and a.any():
                u[i] = a / np.linalg.norm(a)
    ids = sorted(u, key=str.encode)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if u[a] @ u[b] >= least}, u


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(1500, 64))
    out = [(f"c{i}", (v * rng.uniform(0.1, 5)).tolist()) for i, v in enumerate(base)]
    for i in range(400):  # near copies, some right at the threshold
        v = base[i] / np.linalg.norm(base[i])
        w = rng.normal(size=64)
        w -= (w @ v) * v
        w /= np.linalg.norm(w)
        c = rng.uniform(0.88, 0.999)
        out.append((f"n{i}", (c * v + np.sqrt(1 - c * c) * w).tolist()))
    hot = base[7].tolist()  # a group of copies
    out += [(f"h{i}", hot) for i in range(60)]
    out += [("zero", [0.0] * 64), ("null", None), ("nan", [float("nan")] * 64), ("short", [1.0] * 48), ("inf", [float("inf")] * 64), (None, hot)]
    return out + out[:50]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "id string, vector array<float>, key int, cells string")


def test_pairs_against_brute_force(spark, rows):
    want, u = brute([(i, np.float32(v).tolist() if v else v) for i, v in rows], 0.9)
    got = [tuple(r) for r in N.similar_pairs(frame(spark, rows), 0.9).select("id_a", "id_b").collect()]
    assert len(got) == len(set(got)) and set(got) <= want  # nothing wrong, nothing twice
    assert len(got) >= 0.99 * len(want)
    assert all(a.encode() < b.encode() for a, b in got)


def test_exact_pairs(spark, rows, monkeypatch):
    want, _ = brute([(i, np.float32(v).tolist() if v else v) for i, v in rows], 0.9)
    for tile in (N.TILE, 150):
        monkeypatch.setattr(N, "TILE", tile)
        got = [tuple(r) for r in N.similar_pairs(frame(spark, rows), 0.9, exact=True).select("id_a", "id_b").collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_pivots_go_on_growing():
    assert [N.pivot_count(n) for n in (0, 100, 10**6, 10**8, 10**10)] == [8, 16, 2048, 16384, 262144]


def test_cells_cut_into_tiles(spark, rows, monkeypatch):
    whole = {tuple(r) for r in N.similar_pairs(frame(spark, rows), 0.9).select("id_a", "id_b").collect()}
    monkeypatch.setattr(N, "TILE", 40)
    cut = [tuple(r) for r in N.similar_pairs(frame(spark, rows), 0.9).select("id_a", "id_b").collect()]
    assert len(cut) == len(set(cut)) and set(cut) == whole


def test_error_bounds():
    rng = np.random.default_rng(5)
    u = rng.normal(size=(400, 64))
    u /= np.linalg.norm(u, axis=1)[:, None]
    i, j, cos = N.tile_pairs(N.quantise(u), None, 0.2)
    s = u @ u.T
    want = {(a, b) for a in range(400) for b in range(a + 1, 400) if s[a, b] >= 0.2 + N.EDGE}
    assert want <= set(zip(i.tolist(), j.tolist())) and np.abs(cos - s[i, j]).max() < N.EDGE


def test_nearest_against_brute_force(spark, rows):
    df = frame(spark, rows)
    queries = df.filter("id rlike '^[cn][0-9]*5$'")
    got = {}
    for r in N.nearest(df, queries, 5, rows_a_tile=500, queries_a_tile=60).collect():
        got.setdefault(r["id"], []).append((r["place"], r["neighbour"]))
    _, u = brute([(i, np.float32(v).tolist() if v else v) for i, v in rows], 2)
    asked = [i for i in u if i[0] in "cn" and i.endswith("5")]
    assert set(got) == set(asked)
    hits = 0
    for i in asked:
        want = sorted((-round(float(u[i] @ v), 9), k) for k, v in u.items() if k != i)[:5]
        hits += len({k for _, k in want} & {k for _, k in got[i]})
    assert hits >= 0.99 * 5 * len(asked)


def test_empty(spark, rows):
    df = frame(spark, rows)
    assert N.similar_pairs(df.limit(0)).count() == 0 and N.similar_pairs(df.filter("id in ('zero', 'nan')")).count() == 0
    assert N.nearest(df.limit(0), df.limit(0)).count() == 0 and N.nearest(df, df.limit(0)).count() == 0
    one = frame(spark, [("a", [1.0] * 64), ("b", [2.0] * 64)])
    assert [tuple(r)[:2] for r in N.similar_pairs(one).collect()] == [("a", "b")]
