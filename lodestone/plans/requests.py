"""Validation of ask requests: one at a time, and as columns over a table of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.operators.rerank import RERANKERS
from lodestone.operators.search import MODES

MAX_QUESTION, MAX_K, MAX_FILTERS, MAX_HISTORY = 2000, 20, 20, 10


def _texts(value: object) -> list[str] | None:
    items = [value] if isinstance(value, str) else value
    ok = isinstance(items, list) and len(items) <= MAX_FILTERS and all(isinstance(x, str) and x for x in items)
    return list(items) if ok else None  # type: ignore[call-overload]


def parse_ask(body: dict, default_k: int = 5) -> dict | str:
    """The checked parameters of a request, or what is wrong with it."""
    question, k = body.get("question"), body.get("k", default_k)
    mode, rerank = body.get("mode", "hybrid"), body.get("rerank", "none")
    sources, tags, history = _texts(body.get("source", [])), _texts(body.get("tag", [])), body.get("history", [])
    checks = [
        (isinstance(question, str) and question.strip() and len(question) <= MAX_QUESTION, f"'question' must be a text of 1 to {MAX_QUESTION} characters"),
        (type(k) is int and 1 <= k <= MAX_K, f"'k' must be a whole number from 1 to {MAX_K}"),
        (mode in MODES, f"'mode' must be one of {list(MODES)}"),
        (rerank in ("none", *RERANKERS), f"'rerank' must be one of {['none', *RERANKERS]}"),
        (sources is not None and tags is not None, f"'source' and 'tag' must be a text or a list of up to {MAX_FILTERS}"),
        (isinstance(history, list) and all(isinstance(h, str) and len(h) <= MAX_QUESTION for h in history), f"'history' must be a list of texts of up to {MAX_QUESTION} characters"),
    ]
    for ok, message in checks:
        if not ok:
            return message
    flags = {"llm": bool(body.get("llm", True)), "multi_query": bool(body.get("multi_query", False))}
    return {"question": question, "k": k, "mode": mode, "rerank": rerank, "sources": sources, "tags": tags, "history": history[-MAX_HISTORY:], **flags}


def problem() -> Column:
    """For a table of requests (question, k, mode, rerank, source, tag, history): the first field that is
    wrong, or null. Null fields take their defaults."""
    texts = lambda c: (F.size(F.coalesce(c, F.array().cast("array<string>"))) > MAX_FILTERS) | F.coalesce(F.exists(c, lambda x: x.isNull() | (x == "")), F.lit(False))
    return (
        F.when(F.col("question").isNull() | (F.trim("question") == "") | (F.length("question") > MAX_QUESTION), "question")
        .when(~F.coalesce(F.col("k"), F.lit(5)).between(1, MAX_K), "k")
        .when(~F.coalesce(F.col("mode"), F.lit("hybrid")).isin(*MODES), "mode")
        .when(~F.coalesce(F.col("rerank"), F.lit("none")).isin("none", *RERANKERS), "rerank")
        .when(texts("source"), "source")
        .when(texts("tag"), "tag")
        .when(F.coalesce(F.exists("history", lambda h: h.isNull() | (F.length(h) > MAX_QUESTION)), F.lit(False)), "history")
    )
