"""The engine's functions under SQL names: ``register(spark)``, then for instance

SELECT d.source, c.* FROM documents d, LATERAL lodestone_chunk(d.text, 800, 150) c
SELECT lodestone_tokens(text), lodestone_embed(text) FROM documents
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lodestone.operators import dense
from lodestone.sources.chunker import chunk, sentences
from lodestone.sources.html import html_to_markdown


class ChunkTable:
    """One text to its chunks."""

    def eval(self, text: str, max_chars: int, overlap: int) -> Iterator[tuple[int, str, str]]:
        for n, (heading, body) in enumerate(chunk(text, max_chars, overlap)):
            yield n, heading, body


def register(spark: SparkSession, embedder: str = "hash:1024") -> None:
    spark.udtf.register("lodestone_chunk", F.udtf(ChunkTable, returnType="position int, heading string, text string"))

    @F.pandas_udf("array<string>")
    def tokens(text: pd.Series) -> pd.Series:
        return text.map(lambda t: dense.tokens(t or ""))

    @F.pandas_udf("array<string>")
    def split(text: pd.Series) -> pd.Series:
        return text.map(lambda t: sentences(t or ""))

    @F.pandas_udf("array<float>")
    def embed(text: pd.Series) -> pd.Series:
        return pd.Series(list(dense.embedder(embedder).embed(text.tolist())))

    @F.pandas_udf("title string, markdown string")
    def html(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([html_to_markdown(t or "") for t in text], columns=["title", "markdown"])

    for name, f in (("tokens", tokens), ("sentences", split), ("embed", embed), ("html", html)):
        spark.udf.register(f"lodestone_{name}", f)
