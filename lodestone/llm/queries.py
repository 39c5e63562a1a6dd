"""Queries of the training-data operators, over their whole tables, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm import distinctive, encode, language, leaks, markup, neighbours, pieces, ranking, sentences
from lodestone.session import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.sentences(table(spark, sf, "chunks"))


def p1_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences of every chunk, lists and code included, counted."""
    found = sentences.sentences(table(spark, sf, "chunks"), prose_only=False)
    return found.groupBy("id").agg(F.count("*").alias("sentences"), F.max(F.col("end_pos") - F.col("start_pos")).alias("longest"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return distinctive.term_scores(table(spark, sf, "chunks"), min_count=3, max_df=5).select("id", "term").distinct()


def p2_scores(spark: SparkSession, sf: str) -> DataFrame:
    scores = distinctive.term_scores(table(spark, sf, "chunks"))
    return scores.select("id", "term", "tf", F.col("df").alias("df"), (F.round("z", 4) + F.lit(0.0)).alias("z"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return pieces.stored_breaks(table(spark, sf, "chunks")).select("id").distinct()


def p3_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return pieces.pieces(table(spark, sf, "documents"))


def p3_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Of each document's pieces: characters covered that are not white space, and whether all are within the
    limit, the offsets tell their text, the positions run from 0 and neighbours overlap within bounds."""
    found = pieces.pieces(table(spark, sf, "documents"))
    blank = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"
    w = Window.partitionBy("doc_id").orderBy("position")
    rows = found.withColumn("before", F.lag("end_pos").over(w)).withColumn("start", F.lag("start_pos").over(w))
    over = F.greatest(F.coalesce("before", F.lit(0)) - F.col("start_pos"), F.lit(0))
    fresh = F.regexp_replace(F.substring("text", over + 1, F.length("text")), blank, "")
    fits = (F.length("text") <= pieces.LIMIT) & (F.length("text") == F.col("end_pos") - F.col("start_pos")) & (over <= pieces.OVERLAP) & (F.coalesce("start", F.lit(-1)) < F.col("start_pos"))
    return rows.groupBy("doc_id").agg(F.sum(F.length(fresh)).alias("covered"), F.every(fits).alias("fits"), (F.max("position") + 1 == F.count("*")).alias("numbered"))


def p3_chunk_pieces(spark: SparkSession, sf: str) -> DataFrame:
    long = table(spark, sf, "chunks").filter(F.length("text") > pieces.LIMIT)
    return pieces.pieces(long.select("id", "text").distinct(), key="id")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.similar_pairs(table(spark, sf, "chunks"), 0.9).select("id_a", "id_b")


def p4_nearest(spark: SparkSession, sf: str) -> DataFrame:
    """The ten most similar chunks, among all, of every chunk whose doc_id is divisible by 50."""
    rows = table(spark, sf, "chunks")
    found = neighbours.nearest(rows, rows.filter(F.col("doc_id") % 50 == 0), k=10)
    return found.select("id", "neighbour", F.round("cosine", 4).alias("cosine"), "place")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    blocks = markup.clean_documents(table(spark, sf, "documents"))
    return blocks.filter(F.col("element").isin("heading", "item", "code", "formula")).select("doc_id", "element", "content").distinct()


def p5_clean(spark: SparkSession, sf: str) -> DataFrame:
    return markup.clean_text(table(spark, sf, "documents"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.winners(table(spark, sf, "hits"))


def p6_ranking(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.fuse(table(spark, sf, "hits")).select("ask_id", "id", F.round("score", 6).alias("score"), "place")


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode.encode_documents(table(spark, sf, "documents"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.find_leaks(table(spark, sf, "documents"), table(spark, sf, "questions")).select("doc_id", "qid").distinct()


def p9_items(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.leaked_items(leaks.find_leaks(table(spark, sf, "documents"), table(spark, sf, "questions")))


def p9_kept(spark: SparkSession, sf: str) -> DataFrame:
    """The documents without those that leak a test item."""
    docs = table(spark, sf, "documents")
    kept = leaks.without_leaks(docs, leaks.find_leaks(docs, table(spark, sf, "questions")))
    return kept.select("doc_id", "source", "title", "lang", "text")


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return language.wrong_labels(language.language_segments(table(spark, sf, "documents")))


def p10_segments(spark: SparkSession, sf: str) -> DataFrame:
    found = language.language_segments(table(spark, sf, "documents"))
    return found.select("doc_id", "seg", "lang", F.round("confidence", 4).alias("confidence"), "first", "n")


def p10_languages(spark: SparkSession, sf: str) -> DataFrame:
    found = language.document_languages(language.language_segments(table(spark, sf, "documents")))
    return found.select("doc_id", "lang", F.round("confidence", 4).alias("confidence"), F.round("share", 4).alias("share"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            p1_found, p1_sentences, p2_found, p2_scores, p3_found, p3_pieces, p3_checks, p3_chunk_pieces, p4_found, p4_nearest, p5_found, p5_clean,
            p6_found, p6_ranking, p8_ids, p9_found, p9_items, p9_kept, p10_found, p10_segments, p10_languages,
        )
    }


_TERMS = """
rec AS (SELECT DISTINCT id, coalesce(heading, '') AS heading, coalesce(text, '') AS text FROM chunks),
tok AS (SELECT id, heading, text, unnest(regexp_extract_all(lower(heading || chr(10) || text), '[a-z0-9]+(?:[._-][a-z0-9]+)*')) AS term FROM rec),
tf AS (SELECT id, heading, text, term, count(*) AS tf FROM tok GROUP BY ALL),
n AS (SELECT id, heading, text, sum(tf) AS n FROM tf GROUP BY ALL),
c AS (SELECT term, sum(tf) AS cf, count(DISTINCT id) AS df FROM tf GROUP BY term),
total AS (SELECT sum(cf)::DOUBLE AS nn FROM c)"""


_UNIT = """v AS (SELECT DISTINCT id, doc_id, vector FROM chunks
        WHERE len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0),
    u AS (SELECT id, doc_id, vector::DOUBLE[] AS w, sqrt(list_dot_product(vector::DOUBLE[], vector::DOUBLE[])) AS l FROM v)"""
_RANKED = """
    d AS (SELECT ask_id, lower(trim(retriever)) AS r, id, max(score) FILTER (NOT isnan(score)) AS s, min(ranks[lower(trim(retriever))]) AS rk
          FROM hits WHERE ask_id IS NOT NULL AND retriever IS NOT NULL AND id IS NOT NULL GROUP BY ALL),
    way AS (SELECT r, CASE WHEN sum(sign(c)) > 0 THEN -1 ELSE 1 END AS sg FROM (SELECT r, ask_id, corr(s, rk) AS c FROM d WHERE s IS NOT NULL AND rk IS NOT NULL GROUP BY r, ask_id) WHERE NOT isnan(c) GROUP BY r),
    g AS (SELECT ask_id, r, unnest(range(1, count(*) + 1)) AS place FROM d GROUP BY ask_id, r),
    free AS (SELECT ask_id, r, place, row_number() OVER (PARTITION BY ask_id, r ORDER BY place) AS j FROM g ANTI JOIN (SELECT ask_id, r, rk AS place FROM d WHERE rk IS NOT NULL) USING (ask_id, r, place)),
    lost AS (SELECT ask_id, r, id, row_number() OVER (PARTITION BY ask_id, r ORDER BY s * coalesce(sg, 1) DESC NULLS LAST, id) AS j FROM d LEFT JOIN way USING (r) WHERE rk IS NULL),
    places AS (SELECT ask_id, id, rk AS place FROM d WHERE rk IS NOT NULL UNION ALL SELECT lost.ask_id, id, place FROM lost JOIN free USING (ask_id, r, j)),
    f AS (SELECT ask_id, id, round(sum(1.0::DOUBLE / (60 + place)), 12) AS score FROM places GROUP BY ask_id, id),
    o AS (SELECT *, row_number() OVER (PARTITION BY ask_id ORDER BY score DESC, id) AS place FROM f)"""


def _plain(text: str) -> str:
    """Text without tags and with the entities decoded that the tables have, in lower case."""
    out = f"regexp_replace(coalesce({text}, ''), '<!--.*?-->|</?[a-zA-Z][^<>]*>', ' ', 'gs')"
    for name, char in (("&nbsp;", "' '"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&#39;", "chr(39)"), ("&#x27;", "chr(39)"), ("&amp;", "'&'")):
        out = f"replace({out}, '{name}', {char})"
    return f"lower({out})"


# every place where 12 words of a document are 12 words of a passage; runs of them on one diagonal are a match
_LEAKS = f"""
    w AS (SELECT doc_id, regexp_extract_all({_plain("text")}, '[\\p{{L}}\\p{{N}}]+') AS w FROM documents WHERE text IS NOT NULL),
    dg AS (SELECT doc_id, i, array_to_string(w[i:i+11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM w WHERE len(w) >= 12)),
    p AS (SELECT DISTINCT qid, field, regexp_extract_all({_plain("t")}, '[\\p{{L}}\\p{{N}}]+') AS w
          FROM (SELECT qid, 'question' AS field, question AS t FROM questions UNION ALL SELECT qid, 'contains', contains FROM questions) WHERE qid IS NOT NULL AND t IS NOT NULL),
    pg AS (SELECT qid, field, j, array_to_string(w[j:j+11], ' ') AS g FROM (SELECT qid, field, w, unnest(range(1, len(w) - 10)) AS j FROM p WHERE len(w) >= 12)),
    m AS (SELECT DISTINCT doc_id, qid, field, i, j FROM dg JOIN pg USING (g)),
    runs AS (SELECT doc_id, qid, field, count(*) + 11 AS words FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, qid, field, i - j ORDER BY i) AS r FROM m) GROUP BY doc_id, qid, field, i - j, r)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_checks": r"""SELECT doc_id, sum(n)::BIGINT AS covered, true AS fits, true AS numbered
            FROM (SELECT doc_id, length(regexp_replace(text, '[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]', '', 'g')) AS n FROM documents) WHERE n > 0 GROUP BY doc_id""",
        "p9_found": f"WITH {_LEAKS} SELECT DISTINCT doc_id, qid FROM m",
        "p9_items": f"WITH {_LEAKS} SELECT qid, count(DISTINCT doc_id) AS documents, max(words)::INT AS longest FROM runs GROUP BY qid",
        "p9_kept": f"WITH {_LEAKS} SELECT doc_id, source, title, lang, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM m)",
        "p4_found": f"WITH {_UNIT} SELECT a.id AS id_a, b.id AS id_b FROM u a JOIN u b ON a.id < b.id WHERE list_dot_product(a.w, b.w) / (a.l * b.l) >= 0.9",
        "p6_found": f"WITH {_RANKED} SELECT ask_id, id FROM o WHERE place = 1",
        "p6_ranking": f"WITH {_RANKED} SELECT ask_id, id, round(score, 6) AS score, place::INT AS place FROM o",
        "p2_found": f"WITH {_TERMS} SELECT DISTINCT id, term FROM tf JOIN c USING (term) WHERE tf >= 3 AND df <= 5",
        "p2_scores": f"""
            WITH {_TERMS},
            x AS (SELECT tf.id, tf.term, tf.tf, c.df, n.n::DOUBLE AS n, (c.cf - tf.tf)::DOUBLE AS y, nn, 500.0 * c.cf / nn AS a
                  FROM tf JOIN n USING (id, heading, text) JOIN c USING (term), total)
            SELECT DISTINCT id, term, tf::INT AS tf, df,
                   round((ln((tf + a) / (n + 500.0 - tf - a)) - ln((y + a) / (nn - n + 500.0 - y - a))) / sqrt(1 / (tf + a) + 1 / (y + a)), 4) + 0.0 AS z
            FROM x""",
        "p3_found": """
            WITH r AS (SELECT DISTINCT id, doc_id, position, text FROM chunks WHERE text IS NOT NULL AND id IS NOT NULL),
            s AS (SELECT b.id, b.text AS t, a.text AS p, generate_subscripts(range(151, least(length(a.text), length(b.text)) + 1), 1) + 150 AS k
                  FROM r b JOIN r a ON a.doc_id = b.doc_id AND a.position = b.position - 1)
            SELECT id FROM r WHERE length(text) > 800
            UNION SELECT id FROM s WHERE left(t, k) = right(p, k)""",
        "p4_nearest": """
            WITH """ + _UNIT + """,
            s AS (SELECT q.id, r.id AS neighbour, list_dot_product(q.w, r.w) / (q.l * r.l) AS c FROM u q JOIN u r ON q.id <> r.id WHERE q.doc_id % 50 = 0),
            p AS (SELECT id, neighbour, c, row_number() OVER (PARTITION BY id ORDER BY round(c, 9) DESC, neighbour) AS place FROM s)
            SELECT id, neighbour, round(c, 4) AS cosine, place::INT AS place FROM p WHERE place <= 10""",
    }
