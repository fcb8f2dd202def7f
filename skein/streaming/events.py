"""An extension: pairing a stream of turns as it comes.

Each conversation is a group whose open message and answers are kept as state; a pair goes out when the next user message
comes, or when the conversation has been silent for the timeout.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "conv_id long, turn long, task_input string, assistant_response string"
STATE = "turn long, task_input string, answers string"


def _pair(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    turn, task, answers = state.get if state.exists else (None, None, "")
    out = []

    def close() -> None:
        if task and answers:
            out.append((key[0], turn, task, answers))

    if state.hasTimedOut:
        close()
        state.remove()
    else:
        for row in pd.concat(batches).sort_values("turn").itertuples():
            if row.role == "user":
                close()
                turn, task, answers = int(row.turn), row.text or "", ""
            elif row.role == "assistant" and row.text and task:
                answers = f"{answers}\n{row.text}" if answers else row.text
        if turn is not None:
            state.update((turn, task, answers))
            state.setTimeoutDuration(600_000)
    yield pd.DataFrame(out, columns=["conv_id", "turn", "task_input", "assistant_response"])


def pair_stream(turns: DataFrame) -> DataFrame:
    """Pairs of a stream of conv_id, turn, role, text, all answers of a message joined by line feeds; unanswered ones go."""
    return turns.groupBy("conv_id").applyInPandasWithState(_pair, OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
