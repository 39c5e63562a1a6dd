"""Text functions as column expressions: everything here stays in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens, sentence ends, stop words, referring words and openers of follow-ups that results depend on.
TOKEN = r"[a-z0-9]+(?:[._-][a-z0-9]+)*"
SENTENCE_GAP = r"(?<=[.!?])\s+(?=[\"'(\[]?[A-Z0-9`])"
STOPWORDS = """
a about above after again against all am an and any are as at be because been before being below between both but by
can could did do does doing down during each few for from further had has have having he her here hers herself him
himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other
our ours ourselves out over own same she should so some such than that the their theirs them themselves then there
these they this those through to too under until up very was we were what when where which while who whom why will
with would you your yours yourself yourselves
happen happens happened please tell know want need
""".split()
REFERRING = "it its they them their theirs this that these those there one ones same".split()
OPENING = ["and ", "also ", "but ", "so ", "then ", "what about", "how about", "what if"]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def stem(token: Column) -> Column:
    """Light suffix stemmer for tokens in lower case."""
    n = F.length(token)
    cut = lambda k: F.substring(token, F.lit(1), n - k)
    base = (
        F.when(token.endswith("ies") & (n >= 6), F.concat(cut(3), F.lit("y")))
        .when(token.endswith("ing") & (n >= 6), cut(3))
        .when(token.endswith("ed") & (n >= 5), cut(2))
        .when(token.endswith("s") & ~F.right(token, F.lit(2)).isin("ss", "us", "is"), cut(1))
        .otherwise(token)
    )
    m = F.length(base)
    short = F.when((m > 4) & base.endswith("e"), F.substring(base, F.lit(1), m - 1)).otherwise(base)
    return F.when((n <= 3) | ~token.rlike("^[a-z]+$"), token).otherwise(short)


def raw_tokens(text: Column | str) -> Column:
    """Tokens in lower case, stop words and endings kept."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(TOKEN), F.lit(0))


def tokens(text: Column | str, keep_stopwords: bool = False) -> Column:
    """Stemmed tokens; stop words are dropped on their surface form."""
    found = raw_tokens(text)
    if not keep_stopwords:
        found = F.filter(found, lambda t: ~t.isin(STOPWORDS))
    return F.transform(found, stem)


def squeeze(text: Column | str) -> Column:
    """White space of any kind reduced to single blanks, trimmed."""
    return F.trim(F.regexp_replace(_col(text), r"(?U)\s+", " "))


def split_sentences(text: Column | str) -> Column:
    """Sentences by end marks before a capital, a digit or code; for English prose."""
    return F.filter(F.transform(F.split(squeeze(text), SENTENCE_GAP), F.trim), lambda s: s != "")


def merge_fragments(sentences: Column, least: int = 3) -> Column:
    """Sentences of fewer than ``least`` tokens are appended to the one before."""
    empty = F.array().cast("array<string>")

    def step(done: Column, s: Column) -> Column:
        k = F.size(done)
        glue = (k > 0) & (F.size(tokens(s)) < least)
        joined = F.concat(F.slice(done, F.lit(1), F.greatest(k - 1, F.lit(0))), F.array(F.concat_ws(" ", F.get(done, k - 1), s)))
        return F.when(glue, joined).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(sentences, empty, step)


def is_table(paragraph: Column) -> Column:
    lines = F.split(paragraph, "\n")
    return (F.size(lines) >= 2) & F.forall(lines, lambda x: F.ltrim(x).startswith("|"))


def is_code(paragraph: Column) -> Column:
    return paragraph.rlike(r"^\s*(```|~~~)")


def cells(row: Column) -> Column:
    """Cells of a pipe row; an escaped pipe is part of its cell."""
    inner = F.regexp_replace(F.trim(row), r"^\|+|\|+$", "")
    return F.transform(F.split(inner, r"(?<!\\)\|"), lambda c: F.replace(F.trim(c), F.lit("\\|"), F.lit("|")))


def table_rows(paragraph: Column) -> Column:
    """``array<struct<sentence, words, header>>``: rows of a pipe table read out, as "Plan: Team; Price: $25"."""
    lines = F.split(paragraph, "\n")
    ruled = (F.size(lines) >= 3) & F.regexp_replace(F.get(lines, F.lit(1)), r"[|:\- \t]", "").eqNullSafe(F.lit(""))
    head = F.when(ruled, cells(F.get(lines, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    body = F.when(ruled, F.slice(lines, F.lit(3), F.greatest(F.size(lines) - 2, F.lit(0)))).otherwise(lines)

    def read(line: Column) -> Column:
        row = cells(line)
        named = F.zip_with(head, F.slice(row, F.lit(1), F.size(head)), lambda h, c: F.when(c.isNull() | (c == ""), "").when(h == "", c).otherwise(F.concat(h, F.lit(": "), c)))
        words = F.array_join(row, " ")
        told = F.when(F.size(head) > 0, F.array_join(F.filter(named, lambda x: x != ""), "; ")).otherwise(words)
        return F.struct(told.alias("sentence"), words.alias("words"), F.array_join(head, " ").alias("header"))

    return F.transform(body, read)


def cited_numbers(answer: Column | str) -> Column:
    """Citation numbers, each once, in order of first appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(_col(answer), F.lit(r"\[(\d+)\]"), F.lit(1)), lambda n: n.cast("int")))


def cited_sentences(answer: Column | str) -> Column:
    """``array<int>``: the number each cited sentence of an answer carries, in order."""
    return F.transform(F.regexp_extract_all(_col(answer), F.lit(r"(.+?)\s\[(\d+)\](?:\s+|$)"), F.lit(2)), lambda n: n.cast("int"))


def clean_rewrites(question: Column, reply: Column, most: int = 4) -> Column:
    """The question and the lines of a rewriting reply, without bullets, blanks and copies; at most ``most``."""
    lines = F.transform(F.split(reply, "\n"), lambda x: F.trim(F.regexp_replace(F.trim(x), r"^(?:[-*•]\s*|\d+[.)]\s*)", "")))
    fresh = F.filter(lines, lambda x: (x != "") & (F.lower(x) != F.lower(F.trim(question))))
    return F.slice(F.concat(F.array(question), fresh), 1, most)


def normalize_tags(tags: Column | str) -> Column:
    """Trimmed, lower-cased, distinct and sorted; blank tags are dropped."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(_col(tags), lambda t: F.trim(t) != ""), lambda t: F.lower(F.trim(t)))))


def indexed_text(title: str = "title", heading: str = "heading", text: str = "text") -> Column:
    return F.concat_ws("\n", *[F.coalesce(F.col(c), F.lit("")) for c in (title, heading, text)])


def heading_promotion(text: Column | str) -> Column:
    """Short paragraphs of one line without end mark become headings, unless there are Markdown headings."""
    t = _col(text)
    parts = F.split(F.regexp_replace(t, r"(?U)^\s+|\s+$", ""), r"\n\s*\n")

    def promote(p: Column, i: Column) -> Column:
        p = F.regexp_replace(p, r"(?U)^\s+|\s+$", "")
        head = ~F.contains(p, F.lit("\n")) & F.length(p).between(1, 70) & ~p.rlike(r"[.,;:!?)]$")
        return F.when(head, F.concat(F.when(i == 0, "# ").otherwise("## "), p)).otherwise(p)

    return F.when(t.rlike(r"(?m)^#{1,6}\s"), t).otherwise(F.array_join(F.transform(parts, promote), "\n\n"))


def markdown_title(text: Column | str, fallback: Column) -> Column:
    """The first line that begins with ``# ``, else the fallback."""
    found = F.regexp_extract(_col(text), r"(?m)^# ([^\r\n]*)", 1)
    has = _col(text).rlike(r"(?m)^# ")
    return F.when(has, F.trim(found)).otherwise(fallback)


def is_follow_up(question: Column | str) -> Column:
    """Whether a question leans on earlier ones: a referring word, an opener, or at most two content words."""
    q = _col(question)
    words = F.regexp_extract_all(F.lower(q), F.lit(TOKEN), F.lit(0))
    opened = F.lit(False)
    for o in OPENING:
        opened = opened | F.lower(F.trim(q)).startswith(o)
    leans = F.arrays_overlap(words, F.array(*[F.lit(w) for w in REFERRING])) | opened | (F.size(tokens(q)) <= 2)
    return (F.size(words) > 0) & leans


def carry_over(question: Column, previous: Column, most: int = 8) -> Column:
    """A follow-up with the content words of the previous question that it lacks, in parentheses."""
    words = F.regexp_extract_all(previous, F.lit("(?i)" + TOKEN), F.lit(0))
    skip = STOPWORDS + REFERRING
    pairs = F.transform(F.filter(words, lambda w: ~F.lower(w).isin(skip)), lambda w: F.struct(w.alias("w"), stem(F.lower(w)).alias("s")))
    start = F.struct(tokens(question).alias("have"), F.array().cast("array<string>").alias("new"))

    def step(acc: Column, p: Column) -> Column:
        known = F.array_contains(acc["have"], p["s"])
        return F.struct(
            F.when(known, acc["have"]).otherwise(F.array_append(acc["have"], p["s"])).alias("have"),
            F.when(known, acc["new"]).otherwise(F.array_append(acc["new"], p["w"])).alias("new"),
        )

    new = F.slice(F.aggregate(pairs, start, step, lambda a: a["new"]), 1, most)
    longer = F.concat(F.trim(question), F.lit(" ("), F.array_join(new, " "), F.lit(")"))
    return F.when(is_follow_up(question) & (F.size(new) > 0), longer).otherwise(question)


def condense(question: Column | str, history: Column | str, turns: int = 10) -> Column:
    """A standalone question: the last ``turns`` earlier ones and it, folded by ``carry_over``."""
    q = _col(question)
    kept = F.filter(F.coalesce(_col(history), F.array().cast("array<string>")), lambda h: F.trim(h) != "")
    last = F.slice(kept, F.greatest(F.lit(1), F.size(kept) - turns + 1), turns)
    return F.aggregate(F.array_append(last, q), F.lit(""), lambda so_far, turn: F.when(so_far == "", turn).otherwise(carry_over(turn, so_far)))


def glob_regex(pattern: str) -> str:
    """A case-sensitive file-name pattern (``*`` crosses ``/``) as an anchored regular expression."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            end = pattern.find("]", i + (1 if pattern[i : i + 1] in ("!", "]") else 0) + (1 if pattern[i : i + 2] == "!]" else 0))
            if end < 0:
                out.append(r"\[")
            else:
                body = pattern[i:end]
                neg = body.startswith("!")
                body = re.sub(r"([\\\[\]&^])", r"\\\1", body[neg:])
                out.append(f"[{'^' if neg else ''}{body}]")
                i = end + 1
        else:
            out.append(re.escape(c))
    return "(?s)^(?:" + "".join(out) + r")\z"
