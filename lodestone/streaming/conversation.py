"""Conversations as keyed state: every turn of a stream comes out as a standalone question.

The state holds what was asked; how a question takes over words from earlier ones is the same column
expression that tables of questions use (``functions.text.condense``), applied to what the state gives."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestone.functions.text import condense

TURNS = 10


def with_history(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, question, history`` of a stream (conv_id, turn, question): up to ten turns asked before.
    Blank turns are skipped; ``/reset`` empties the history."""
    kinds = dict(turns.dtypes)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        asked: list[str] = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values("turn")
        out = []
        for turn, question in zip(rows["turn"], rows["question"].fillna("")):
            if question.strip() == "/reset":
                asked = []
            elif question.strip():
                out.append((key[0], turn, question, asked))
                asked = [*asked, question][-TURNS:]
        state.update((asked,))
        yield pd.DataFrame(out, columns=["conv_id", "turn", "question", "history"])

    schema = f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, question string, history array<string>"
    return turns.groupBy("conv_id").applyInPandasWithState(step, schema, "asked array<string>", "append", GroupStateTimeout.NoTimeout)


def standalone_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, question, standalone`` of a stream (conv_id, turn, question)."""
    rows = with_history(turns)
    return rows.select("conv_id", "turn", "question", condense("question", "history", TURNS).alias("standalone"))
