"""Source and tag filters; both narrow candidates only, never the collection's statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import glob_regex, normalize_tags

MAX_PATTERNS = 20


def source_matches(patterns: Sequence[str], source: str = "source") -> Column:
    """Any of the case-sensitive file-name patterns; ``prefix*`` becomes a prefix test that reaches the scan."""
    if len(patterns) > MAX_PATTERNS:
        raise ValueError(f"at most {MAX_PATTERNS} patterns")
    out = F.lit(False)
    for p in patterns:
        plain = p[:-1]
        if p.endswith("*") and not any(c in plain for c in "*?["):
            out = out | F.col(source).startswith(plain)
        else:
            out = out | F.col(source).rlike(glob_regex(p))
    return out


def has_tags(tags: Sequence[str], column: str = "tags") -> Column:
    wanted = sorted({t.strip().lower() for t in tags if t.strip()})
    return F.arrays_overlap(normalize_tags(F.coalesce(F.col(column), F.array().cast("array<string>"))), F.array(*[F.lit(t) for t in wanted]).cast("array<string>"))


def allowed_chunks(chunks: DataFrame, documents: DataFrame | None = None, sources: Sequence[str] = (), tags: Sequence[str] = ()) -> DataFrame | None:
    """``id`` of the chunks that pass both filters; None if neither is asked for."""
    if not sources and not tags:
        return None
    rows = chunks.filter(F.col("id").isNotNull())
    if sources:
        rows = rows.filter(source_matches(sources))
    if tags:
        if documents is None:
            raise ValueError("a tag filter needs the documents")
        key = "doc_id" if "doc_id" in chunks.columns and "doc_id" in documents.columns else "source"
        rows = rows.join(documents.filter(has_tags(tags)).select(key).distinct(), key, "left_semi")
    return rows.select("id").distinct()
