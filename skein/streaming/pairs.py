"""Pairing a stream of turns by event time, as W1 and W2 pair a table.

A conversation's turns wait until the watermark has passed them, so that they are taken in order however they come in; rows later
than the watermark are dropped by Spark. A message is given out when the next user turn is taken, or when the conversation has been
silent for a while in event time: a timer then gives out what is open and removes the conversation's state. What is given out is
screened as in a table, outside of the state.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from skein.functions.text import contains_secret, has_value, long_enough

OUT = "conv_id long, turn long, task_input string, assistant_response string"
STATE = "turn long, task string, answers string, newest long, turns array<long>, roles array<string>, texts array<string>, times array<long>"
PAIR = Row("conv_id", "turn", "task_input", "assistant_response")

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The state store that these streams need, for queries that are started inside; the session's own setting comes back."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


class Pairer(StatefulProcessor):
    """State of a conversation, as one value: the last user message taken with its answers so far, the time of the newest turn, and
    by columns the turns that the watermark has not passed. Each call of the state store is a round trip from Python, and most of
    the time goes into these, so a batch reads and writes a conversation once. It has one timer, which is set again when it has
    expired and newer turns have come.
    """

    def __init__(self, gap_ms: int, every: bool):
        self.gap_ms, self.every = gap_ms, every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = self.kept.get()
        turn, task, answers, newest, *columns = before or (None, None, None, -1, [], [], [], [])
        waiting = {at: rest for at, *rest in zip(*columns)}
        for r in rows:
            waiting[r.turn] = (r.role, r.text, r.ms)
            newest = max(newest, r.ms)
        if before is None:
            self.handle.registerTimer(newest + self.gap_ms)
        out, opened = self._take(key, (turn, task, answers), waiting, timerValues.getCurrentWatermarkInMs())
        columns = [list(c) for c in zip(*((at, *rest) for at, rest in waiting.items()))] or [[], [], [], []]
        self.kept.update((*opened, newest, *columns))
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        *opened, newest, turns, roles, texts, times = self.kept.get()
        if newest + self.gap_ms >= timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(newest + self.gap_ms)
            return iter([])
        out, (turn, task, answers) = self._take(key, opened, {at: rest for at, *rest in zip(turns, roles, texts, times)}, None)
        self.kept.clear()
        return iter(out if turn is None else [*out, PAIR(key[0], turn, task, answers)])

    def _take(self, key, opened, waiting: dict, upto: int | None) -> tuple[list[Row], tuple]:
        """Takes the waiting turns up to a time (all without one) in order, out of `waiting`: pairs that are over, the open one."""
        turn, task, answers = opened
        out = []
        for at in sorted(t for t, v in waiting.items() if upto is None or v[2] <= upto):
            role, text, _ = waiting.pop(at)
            if role == "user":
                if turn is not None:
                    out.append(PAIR(key[0], turn, task, answers))
                turn, task, answers = at, text, None
            elif role == "assistant" and text and turn is not None and (self.every or answers is None):
                answers = text if answers is None else f"{answers}\n{text}"
        return out, (turn, task, answers)

    def close(self) -> None:
        pass


def pair_events(turns: DataFrame, late: str = "10 minutes", gap_ms: int = 1_800_000, every: bool = True) -> DataFrame:
    """conv_id, turn, task_input, assistant_response of a stream of conv_id, turn, role, text, ts (append mode).

    every: all answers of a message, joined by line feeds, messages without one left out (W2); else the first answer, `` without
    one, and messages of 10 characters or more (W1). Messages and answers with a secret are left out. late: how far behind the
    newest row a row may come; gap_ms: the silence after which a conversation is over (turns after it begin a new one). A
    conversation is one key of state, taken in order by one task at a time; its state is the turns within `late` and one message.
    Queries are started inside state_store().
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text", "ts", F.unix_millis("ts").alias("ms")).withWatermark("ts", late)
    found = rows.groupBy("conv_id").transformWithState(Pairer(gap_ms, every), OUT, "Append", "EventTime")
    answer = F.coalesce("assistant_response", F.lit(""))
    whole = has_value(F.col("task_input"), F.col("assistant_response")) if every else long_enough(F.col("task_input"))
    screened = found.where(whole & ~contains_secret(F.col("task_input")) & ~contains_secret(answer))
    return screened.withColumn("assistant_response", answer)
