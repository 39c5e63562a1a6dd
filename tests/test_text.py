import random
import re

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators.dense import stem, tokens


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


def test_tokens(spark):
    get = lambda s: one(spark, T.tokens("t"), t=s)
    assert get("The Domes and a Mirror") == ["dome", "mirror"]
    assert len(set(get("focus refocused rotate rotated rotates"))) == 3
    assert get("galaxies nights") == ["galaxy", "night"]
    assert get("m31 ngc-224_b 0.5.2") == ["m31", "ngc-224_b", "0.5.2"]
    assert get("lens axis mass") == ["len", "axis", "mass"]
    assert get("") == []


def test_column_and_batch_tokens_agree(spark):
    rng = random.Random(1)
    ends = ["", "s", "es", "ies", "ed", "ing", "ss", "us", "is", "e", "y", "e.d", "-s", "1s", "é"]
    words = ["".join(rng.choice("abeinrst") for _ in range(rng.randint(1, 6))) + rng.choice(ends) for _ in range(3000)] + T.STOPWORDS
    texts = [" ".join(rng.sample(words, 20)).title() for _ in range(300)] + ["", "ß İ ſ"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", T.tokens("t").alias("x")).collect()
    assert {r["k"]: r["x"] for r in rows} == {k: tokens(t) for k, t in enumerate(texts)}


def test_sentences(spark):
    assert one(spark, T.split_sentences("t"), t="Dusk. Open it! Now? yes") == ["Dusk.", "Open it!", "Now? yes"]
    assert one(spark, T.split_sentences("t"), t="Set f 3.5 first. 'Go' then.") == ["Set f 3.5 first.", "'Go' then."]
    assert one(spark, T.split_sentences("t"), t="  ") == []


def test_fragments_and_citations(spark):
    assert one(spark, T.merge_fragments(F.col("s")), s=["Slide the roof to the west.", "Lock it.", "The second bolt holds the roof."]) == [
        "Slide the roof to the west. Lock it.", "The second bolt holds the roof.",
    ]
    assert one(spark, T.cited_numbers("t"), t="a [2] b [1][2] c [3]") == [2, 1, 3]
    assert one(spark, T.cited_sentences("t"), t="First. [1] Second one. [3]") == [1, 3]


def test_tables(spark):
    t = "| Star | Class |\n|---|---|\n| Vega | A0 \\| V |\n| Mira |  |"
    assert one(spark, T.is_table(F.col("t")), t=t) is True
    rows = one(spark, T.table_rows(F.col("t")), t=t)
    assert [r["sentence"] for r in rows] == ["Star: Vega; Class: A0 | V", "Star: Mira"]
    assert one(spark, T.is_code(F.col("t")), t="~~~ sh\nx\n~~~") is True


def test_heading_promotion_and_title(spark):
    assert one(spark, T.heading_promotion("t"), t="Night log\n\nClear until two, then haze.\n\nPlates\n\nSix plates, one spoilt:\n") == "# Night log\n\nClear until two, then haze.\n\n## Plates\n\nSix plates, one spoilt:"
    assert one(spark, T.heading_promotion("t"), t="Plates\n\n## Kept\n\nSix") == "Plates\n\n## Kept\n\nSix"
    assert one(spark, T.markdown_title("t", F.lit("stem")), t="x\n# Title here\n") == "Title here"
    assert one(spark, T.markdown_title("t", F.lit("stem")), t="no heading") == "stem"


def test_rewrites(spark):
    got = one(spark, T.clean_rewrites(F.col("q"), F.col("r")), q="How is the mirror cleaned?", r="1) mirror cleaning\n\n* how is the MIRROR cleaned?\n- wash the optics\n2. dust on optics\none too many")
    assert got == ["How is the mirror cleaned?", "mirror cleaning", "wash the optics", "dust on optics"]


def test_follow_ups(spark):
    for q in ("Can they be cleaned twice?", "So the roof opens at dusk?", "How about comets tonight?", "At noon?"):
        assert one(spark, T.is_follow_up("q"), q=q), q
    for q in ("Which filter suits bright comets near dawn?", "Who cleans the main mirror?", ""):
        assert not one(spark, T.is_follow_up("q"), q=q), q


def fold(history, question):
    """What ``condense`` should give, turn by turn."""
    said = ""
    for turn in [h for h in history if h.strip()][-10:] + [question]:
        words = re.findall(T.TOKEN, turn.lower())
        leans = words and (set(words) & set(T.REFERRING) or turn.strip().lower().startswith(tuple(T.OPENING)) or len(tokens(turn)) <= 2)
        have, new = set(tokens(turn)), []
        for w in re.findall(T.TOKEN, said, re.I) if leans else ():
            if w.lower() not in T.STOPWORDS + T.REFERRING and stem(w.lower()) not in have:
                have.add(stem(w.lower()))
                new.append(w)
        said = f"{turn.strip()} ({' '.join(new[:8])})" if said and new else turn
    return said


def test_condense(spark):
    rng = random.Random(6)
    turns = ["Who cleans the main mirror?", "Can they do it in rain?", "And with which Cloth?", "Which filter suits bright comets near dawn?", "How about NGC-224?", "Why?", " ", "Does the guide star drift when the dome turns westward at 15 degrees an hour?", "What if it does?"]
    rows = [([rng.choice(turns) for _ in range(rng.randint(0, 13))], rng.choice(turns[:6])) for _ in range(120)] + [(None, "Why?")]
    got = spark.createDataFrame(rows, "h array<string>, q string").select(T.condense("q", "h").alias("x")).collect()
    assert [r["x"] for r in got] == [fold(h or [], q) for h, q in rows]
    assert fold(["Who cleans the main mirror?"], "Can they do it in rain?") == "Can they do it in rain? (cleans main mirror)"


def test_globs(spark):
    import fnmatch
    import re

    for pattern, name in [("guides/*", "guides/a/b.md"), ("g?ides/[ab]*.md", "guides/b.md"), ("[!g]*", "guides"), ("a[", "a["), ("*.md", "x.mdx"), ("a.b", "axb"), ("A*", "ab"), ("x*", "x\ny")]:
        regex = T.glob_regex(pattern).replace(r"\z", r"\Z")
        assert bool(re.search(regex, name)) == fnmatch.fnmatchcase(name, pattern), (pattern, name)


def test_tags(spark):
    assert one(spark, T.normalize_tags("t"), t=[" Ops", "ops", "", "API "]) == ["api", "ops"]
