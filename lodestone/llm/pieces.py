"""Splitting oversized items at natural boundaries: structure-tree packing.

A text is a tree: sections by heading level, blocks, sentences of prose or lines of lists, tables and
code, words, characters. Nodes are half-open ranges that tile the text. Packing goes bottom-up: sibling
subtrees are merged from left to right as long as they fit, and only a node that is larger than the
limit is descended into. Each further piece of a section then begins up to ``overlap`` characters
earlier, at the first sentence, else word, that the overlap and the limit leave room for.

Every character that is not white space lies in a piece; pieces are at most ``limit`` long, begin and
end without white space, and are numbered by position. Null, empty and blank texts have no pieces;
unbroken runs are cut by characters; texts within the limit are one piece; repeated rows are split a
row each; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.sentences import segment
from lodestone.session import cut_lineage, spread

LIMIT, OVERLAP = 800, 150
_HEADING = re.compile(
    r"(?im)^(?:(?P<md>\#{1,6})[ \t]+\S|(?P<wiki>={1,6})[^=\n].*=[ \t]*$|\\(?P<tex>(?:sub){0,2})section\b|<h(?P<html>[1-6])\b|(?P<set>\S[^\n]*)\n(?P<bar>=+|-{2,})[ \t]*$)"
)
_FENCE = re.compile(r"(?ims)^(?P<f>`{3,}|~{3,}).*?(?:^(?P=f)[`~]*[ \t]*$|\Z)|<pre\b.*?(?:</pre>|\Z)|<syntaxhighlight\b.*?(?:</syntaxhighlight>|\Z)|\\begin\{(?P<e>lstlisting|verbatim)\}.*?(?:\\end\{(?P=e)\}|\Z)")
_BLANK = re.compile(r"\n[^\S\n]*\n\s*|(?i:(?<=>)\n(?=<(?:p|h[1-6]|ul|ol|pre|table|div)\b))")
_ROWS = re.compile(r"\s*(?:[-*+|#]|\d+[.)]\s|```|~~~|<(?:pre|ul|ol|table|li|syntax)|\{\||\\begin)")
_WORD = re.compile(r"\s+")
_TEX_LEVEL = {"": 1, "sub": 2, "subsub": 3}
HEADS = 6  # heading levels; then blocks, sentences or rows, lines, words, characters
BLOCKS, PARTS, LINES, WORDS = HEADS + 1, HEADS + 2, HEADS + 3, HEADS + 4


class Tree:
    """Cut points of a text by level, found only when a level is descended into."""

    def __init__(self, text: str):
        self.text = text
        self.fences = [(m.start(), m.end()) for m in _FENCE.finditer(text)] if "`" in text or "~" in text or "<" in text or "\\" in text else []
        self.fence_starts = [a for a, _ in self.fences]
        self.heads: list[list[int]] = [[] for _ in range(HEADS + 1)]
        for m in _HEADING.finditer(text):
            if not self.fenced(m.start()):
                level = len(m["md"] or m["wiki"] or "") or (_TEX_LEVEL[m["tex"].lower()] if m["tex"] is not None else 0) or int(m["html"] or 0) or (1 if m["bar"][0] == "=" else 2)
                self.heads[min(level, HEADS)].append(m.start())
        self.head_set = {i for level in self.heads for i in level}

    def fenced(self, i: int) -> bool:
        k = bisect_right(self.fence_starts, i) - 1
        return k >= 0 and self.fences[k][0] < i < self.fences[k][1]

    def cuts(self, a: int, b: int, level: int) -> list[int]:
        """Where the children of the node [a, b) begin, a excepted."""
        text = self.text
        if level <= HEADS:
            xs = self.heads[level]
            return xs[bisect_right(xs, a) : bisect_left(xs, b)]
        if level == BLOCKS:
            return [m.end() for m in _BLANK.finditer(text, a, b) if a < m.end() < b and not self.fenced(m.end() - 1)]
        if level == PARTS:
            if _ROWS.match(text, a, b) or self.fenced(a + 1):
                return [i + 1 for i in range(a, b - 1) if text[i] == "\n"]
            return [a + s for s, _ in segment(text[a:b])[1:]]
        if level == LINES:
            return [i + 1 for i in range(a, b - 1) if text[i] == "\n"]
        return [m.end() for m in _WORD.finditer(text, a, b) if a < m.end() < b]


def _size(text: str, a: int, b: int) -> int:
    while b > a and text[b - 1].isspace():
        b -= 1
    while a < b and text[a].isspace():
        a += 1
    return b - a


def pack(tree: Tree, a: int, b: int, level: int, limit: int, out: list[tuple[int, int, int]]) -> None:
    """Append the pieces of the node as (start, end, level at which the piece was begun)."""
    text = tree.text
    if b - a <= limit or _size(text, a, b) <= limit:
        out.append((a, b, level))
        return
    if level > WORDS:
        while a < b and text[a].isspace():
            a += 1
        for x in range(a, b, limit):
            out.append((x, min(b, x + limit), level))
        return
    cuts = tree.cuts(a, b, level)
    if not cuts:
        pack(tree, a, b, level + 1, limit, out)
        return
    start = a
    edges = [a, *cuts, b]
    for x, y in zip(edges, edges[1:]):
        if y - x > limit and _size(text, x, y) > limit:
            if start < x and not (start in tree.head_set and x - start <= limit // 4):
                out.append((start, x, level))
                start = x
            pack(tree, start, y, level + 1, limit, out)  # a heading stays with what it heads
            start = y
        elif start < x and _size(text, start, y) > limit:
            out.append((start, x, level))
            start = x
    if start < b:
        out.append((start, b, level))


def split(text: str | None, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Ranges of the pieces of a text."""
    if limit < 1 or overlap < 0 or overlap >= limit:
        raise ValueError("overlap must be at least 0 and smaller than the limit")
    if not text or text.isspace():
        return []
    if len(text) <= limit:
        a, b = 0, len(text)
        while text[b - 1].isspace():
            b -= 1
        while text[a].isspace():
            a += 1
        return [(a, b)]
    tree = Tree(text)
    raw: list[tuple[int, int, int]] = []
    pack(tree, 0, len(text), 1, limit, raw)
    out: list[tuple[int, int]] = []
    before = -1
    for a, b, level in raw:
        while b > a and text[b - 1].isspace():
            b -= 1
        while a < b and text[a].isspace():
            a += 1
        if a >= b:
            continue
        s = a
        if out and level > HEADS and overlap and a not in tree.head_set:
            low = max(a - overlap, b - limit, before + 1)
            if low < a and text[low:a].strip():
                s = _begin(text, low, a)
        out.append((s, b))
        before = a
    return out


def _begin(text: str, low: int, a: int) -> int:
    """The first sentence, else word, that begins in [low, a); a if none does."""
    for m in re.finditer(r"[.!?。！？।؟][\"”»』」)）]*\s*", text[max(0, low - 3) : a]):
        i = max(0, low - 3) + m.end()
        if low <= i < a and (text[i - 1].isspace() or text[i - 1] in "。！？।"):
            return i
    m = _WORD.search(text, max(0, low - 1), a)
    if m and m.end() < a:
        return m.end()
    return low if not any(c.isspace() for c in text[low:a]) and text[a - 1 : a] and not text[a - 1].isspace() else a


def pieces(rows: DataFrame, key: str = "doc_id", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``<key>, position, start_pos, end_pos, text``: the pieces of each text. No shuffle."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            row, position, start, end, part = [], [], [], [], []
            for i, t in enumerate(b[1].to_pylist()):
                for k, (s, e) in enumerate(split(t, limit, overlap)):
                    row.append(i)
                    position.append(k)
                    start.append(s)
                    end.append(e)
                    part.append(t[s:e])
            yield pa.RecordBatch.from_arrays(
                [b[0].take(pa.array(row, pa.int64())), pa.array(position, pa.int32()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(part, pa.string())],
                [key, "position", "start_pos", "end_pos", "text"],
            )

    return spread(rows.select(key, "text")).mapInArrow(run, f"{key} {kind}, position int, start_pos int, end_pos int, text string")


def overlap_length(before: str, text: str, more_than: int) -> int:
    """Length of the longest beginning of ``text``, longer than ``more_than``, that ends ``before``; else 0."""
    head = text[: more_than + 1]
    if len(head) <= more_than:
        return 0
    i = before.find(head, max(0, len(before) - len(text)))
    while i >= 0:
        n = len(before) - i
        if before.endswith(text[:n]):
            return n
        i = before.find(head, i + 1)
    return 0


def stored_breaks(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, run_length: int = 256) -> DataFrame:
    """``id, pieces, overlap``: stored pieces that break the limits: that the splitter cuts into more
    than one piece, or that begin with more than ``overlap`` characters ending the piece before.

    Neighbours meet in runs of ``run_length`` positions, the last piece of a run going to the next one
    as well, so that a document of any length spreads over tasks; texts are shuffled once. Where different
    texts stand at one position, each of them counts as preceding (``crowded_overlaps``).
    """
    rows = chunks.select("id", "doc_id", F.col("position").cast("int").alias("position"), "text").filter(F.col("text").isNotNull() & F.col("id").isNotNull())
    run = F.floor(F.col("position") / run_length)
    runs = F.when((F.col("position") + 1) % run_length == 0, F.array(run, run + 1)).otherwise(F.array(run))
    home = F.coalesce(F.col("doc_id"), F.xxhash64("id"))
    rows = rows.withColumn("home", home)
    placed = rows.filter(F.col("doc_id").isNotNull() & F.col("position").isNotNull())
    h = F.xxhash64("text")
    crowded = cut_lineage(placed.groupBy("home", "position").agg((F.min(h) != F.max(h)).alias("many")).filter("many").select("home", "position"))
    if not crowded.isEmpty():
        rest = stored_neighbours(rows, limit, overlap, run, runs)
        more = crowded_overlaps(placed, crowded, overlap)
        return rest.unionByName(more).groupBy("id").agg(F.max("pieces").alias("pieces"), F.max("overlap").alias("overlap"))
    return stored_neighbours(rows, limit, overlap, run, runs)


def crowded_overlaps(placed: DataFrame, crowded: DataFrame, overlap: int) -> DataFrame:
    """``id, pieces, overlap`` of pieces that follow a position with several texts and repeat an end of one.

    Beginnings and ends longer than ``overlap`` meet by length and hash, so that no two texts are paired:
    the work is the texts' length, and a hot position spreads over as many keys as there are lengths."""

    def edges(begins: bool):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
            for b in batches:
                ids, home, position, size, key = [], [], [], [], []
                for i, h, p, t in zip(*(c.to_pylist() for c in b.columns)):
                    for n in range(overlap + 1, len(t) + 1):
                        ids.append(i)
                        home.append(h)
                        position.append(p - begins)
                        size.append(n)
                        key.append(xxhash.xxh64_intdigest(t[:n] if begins else t[-n:]) - 2**63)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(home, pa.int64()), *(pa.array(c, pa.int32()) for c in (position, size)), pa.array(key, pa.int64())], ["id", "home", "position", "size", "key"])

        return run

    cols, shape = ["id", "home", "position", "text"], "id string, home bigint, position int, size int, key bigint"
    following = placed.join(crowded.withColumn("position", F.col("position") + 1), ["home", "position"], "left_semi").select(*cols).mapInArrow(edges(True), shape)
    preceding = placed.join(crowded, ["home", "position"], "left_semi").select(*cols).mapInArrow(edges(False), shape)
    on = ["home", "position", "size", "key"]
    return following.join(preceding.select(*on).distinct(), on, "left_semi").groupBy("id").agg(F.lit(1).alias("pieces"), F.max("size").alias("overlap"))


def stored_neighbours(rows: DataFrame, limit: int, overlap: int, run: Column, runs: Column) -> DataFrame:
    """As ``stored_breaks``, each piece against one text of the preceding position."""
    rows = rows.withColumn("own", run).withColumn("run", F.explode(runs))
    w = Window.partitionBy("home", "run").orderBy("position").rangeBetween(-1, -1)
    rows = rows.withColumn("before", F.when(F.col("doc_id").isNotNull() & F.col("position").isNotNull(), F.max("text").over(w)))
    rows = rows.filter(F.col("own").isNull() | (F.col("own") == F.col("run")))
    head = F.substring("text", 1, overlap + 1)
    suspect = (F.length("text") > limit) | ((F.length("text") > overlap) & F.coalesce(F.contains("before", head), F.lit(False)))

    def check(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            ids, count, common = [], [], []
            for i, t, before in zip(*(c.to_pylist() for c in b.columns)):
                k = len(split(t, limit, overlap))
                n = overlap_length(before, t, overlap) if before is not None else 0
                if k > 1 or n > overlap or len(t) > limit:
                    ids.append(i)
                    count.append(k)
                    common.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(count, pa.int32()), pa.array(common, pa.int32())], ["id", "pieces", "overlap"])

    return rows.filter(suspect).select("id", "text", "before").mapInArrow(check, "id string, pieces int, overlap int")
