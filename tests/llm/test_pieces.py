import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import pieces as P

MD = "# One\n\n" + "A sentence of the first part stands here. " * 12 + "\n\n## Two\n\n" + "\n".join(f"- item number {i} of a long list" for i in range(40)) + "\n\n```\n" + "\n".join(f"code line {i}\n" for i in range(30)) + "\n```\n\n# Three\n\nShort end."


def check(text, limit, overlap):
    spans = P.split(text, limit, overlap)
    covered = set()
    last = -1
    for k, (s, e) in enumerate(spans):
        assert 0 < e - s <= limit and not text[s].isspace() and not text[e - 1].isspace()
        covered.update(range(s, e))
        if k:
            assert last - s <= overlap and s > spans[k - 1][0] and e > last
        last = e
    assert all(c.isspace() or i in covered for i, c in enumerate(text))
    return spans


def test_natural_boundaries():
    spans = check(MD, 200, 40)
    parts = [MD[s:e] for s, e in spans]
    assert any(p.startswith("## Two") for p in parts) and parts[-1] == "# Three\n\nShort end."
    assert all(s == 0 or MD[s - 1].isspace() for s, _ in spans) and all(e == len(MD) or MD[e].isspace() for _, e in spans)
    assert [MD[s:e] for s, e in P.split(MD, 5000, 0)] == [MD]


def test_siblings_are_merged():
    text = "\n\n".join(f"Block {i} text." for i in range(30))
    assert len(P.split(text, 100, 0)) <= 7


@pytest.mark.parametrize("text", [None, "", " \n "])
def test_nothing(text):
    assert P.split(text) == []


def test_unbroken_runs():
    spans = check("x" * 5000, 800, 150)
    assert len(spans) >= 7
    check("字" * 5000 + "。" + "文" * 10, 800, 150)
    check(" " * 900 + "end", 800, 150)
    with pytest.raises(ValueError):
        P.split("x", 100, 100)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=list("ab .\n#-`|<>h1/é中。"), max_size=400), st.integers(5, 60), st.integers(0, 4))
def test_invariants(text, limit, overlap):
    check(text, limit, overlap)


def slow_overlap(before, text):
    return max((n for n in range(1, min(len(before), len(text)) + 1) if before.endswith(text[:n])), default=0)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab", max_size=30), st.text(alphabet="ab", max_size=30), st.integers(0, 5))
def test_overlap_length(before, text, more):
    n = slow_overlap(before, text)
    assert P.overlap_length(before, text, more) == (n if n > more else 0)


def test_stored_breaks(spark):
    body = "".join(chr(97 + i % 26) for i in range(400)) + "END"
    rows = [
        ("d0", 1, 0, "x" * 801), ("d1", 1, 1, "y" * 800),
        ("e0", 2, 0, "start " + body), ("e1", 2, 1, body[-151:] + " more"), ("e2", 2, 2, "more"), ("e1", 2, 1, body[-151:] + " more"),
        ("f0", 3, 255, "start " + body), ("f1", 3, 256, body[-160:] + "z"), ("f3", 3, 258, body[-160:] + "z"),
        ("g0", 4, 0, "start " + body), ("g1", 4, 1, body[-150:] + "z"), ("h", 5, 0, None), ("i", None, None, "x" * 900), ("j", None, 1, "x"), (None, 6, 0, "x" * 900),
    ]
    df = spark.createDataFrame(rows, "id string, doc_id bigint, position int, text string").selectExpr("*", "1 AS run", "2 AS before")
    got = {r["id"]: (r["pieces"] > 1, r["overlap"]) for r in P.stored_breaks(df).collect()}
    assert got == {"d0": (True, 0), "e1": (False, 151), "f1": (False, 160), "i": (True, 0)}
    assert P.stored_breaks(df.limit(0)).count() == 0


def test_several_texts_at_one_position(spark):
    body = "".join(chr(97 + i % 26) for i in range(400)) + "END"
    rows = [
        ("a0", 1, 0, "start " + body), ("a0x", 1, 0, "zz other text"), ("a1", 1, 1, body[-170:] + " more"), ("a1y", 1, 1, body[-120:] + " more"), ("a1z", 1, 1, "zz other text more"), ("a2", 1, 2, "END"),
        ("b0", 2, 255, "aa " + body), ("b0x", 2, 255, "zz " + body[::-1]), ("b1", 2, 256, body[-200:] + "q"), ("b1x", 2, 256, body[::-1][-300:]), ("c0", None, 0, "c"), ("c1", None, 0, "d"),
    ] + [(f"h{i}", 7, 0, f"{i} " + body[: 200 + i % 3]) for i in range(300)] + [(f"g{i}", 7, 1, body[i % 2 : 202] + f" {i}") for i in range(300)]
    df = spark.createDataFrame(rows + rows[:3], "id string, doc_id bigint, position int, text string")
    by_place = {}
    for _, d, p, t in rows:
        by_place.setdefault((d, p), set()).add(t)
    want = {}
    for i, d, p, t in rows:
        n = max((slow_overlap(before, t) for before in by_place.get((d, p - 1), ()) if d is not None), default=0)
        if n > 150:
            want[i] = n
    assert {"a1", "b1", "b1x", "g0", "g1"} <= want.keys() and "a1y" not in want
    assert {r["id"]: r["overlap"] for r in P.stored_breaks(df).collect()} == want


def test_table(spark):
    df = spark.createDataFrame([(1, MD), (2, None), (3, "")], "doc_id bigint, text string")
    got = P.pieces(df, limit=200, overlap=40).orderBy("position").collect()
    assert [r["position"] for r in got] == list(range(len(got))) and {r["doc_id"] for r in got} == {1}
    assert all(r["text"] == MD[r["start_pos"] : r["end_pos"]] for r in got)
