"""Turn pairing: user messages with the assistant's answers.

A running count of user turns numbers the segments of a conversation; each segment is one user message and what follows.
A conversation is cut into blocks of BLOCK turns that are counted side by side and moved up by the counts of the blocks
before, and a segment's answer is an aggregate, so that one endless conversation does not end up in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.functions.text import contains_secret, has_value, long_enough

BLOCK = 4096


def segments(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role") -> DataFrame:
    """turns with a column seg: the user turns up to and with each one; 0 before the first."""
    cut = turns.withColumn("_block", F.floor(F.col(turn) / BLOCK))
    user = (F.col(role) == "user").cast("long")
    counts = cut.groupBy(conv, "_block").agg(F.sum(F.coalesce(user, F.lit(0))).alias("_n"))
    before = counts.select(F.col(conv).alias("_c"), F.col("_block").alias("_b"), (F.sum("_n").over(W.partitionBy(conv).orderBy("_block")) - F.col("_n")).alias("_before"))
    own = F.sum(F.coalesce(user, F.lit(0))).over(W.partitionBy(conv, "_block").orderBy(turn))
    joined = cut.withColumn("_own", own).join(before, F.col(conv).eqNullSafe(F.col("_c")) & (F.col("_block") == F.col("_b")))
    return joined.withColumn("seg", F.col("_own") + F.col("_before")).drop("_block", "_c", "_b", "_own", "_before", "_n")


def _by_segment(turns: DataFrame, conv: str, turn: str, role: str, text: str, *aggs) -> DataFrame:
    parts = segments(turns, conv, turn, role).where(F.col("seg") > 0)
    asked = F.max(F.when(F.col(role) == "user", F.struct(turn, text))).alias("_q")  # one user turn a segment
    out = parts.groupBy(conv, "seg").agg(asked, *aggs)
    return out.select(conv, F.col(f"_q.{turn}").alias(turn), F.col(f"_q.{text}").alias("task_input"), *out.columns[3:])


def pair_first_response(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", screen: bool = True) -> DataFrame:
    """conv, turn, task_input, assistant_response: each user message of 10 characters or more with the first non-empty
    assistant message before the next user message, `` if there is none.

    screen: a message or answer that holds a secret takes the pair out. A short or secret message still ends the one before.
    """
    answer = (F.col(role) == "assistant") & has_value(F.col(text))
    got = _by_segment(turns, conv, turn, role, text, F.min(F.when(answer, F.struct(turn, text))).alias("_a"))
    out = got.select(conv, turn, "task_input", F.coalesce(F.col(f"_a.{text}"), F.lit("")).alias("assistant_response")).where(long_enough(F.col("task_input")))
    return out.where(~contains_secret(F.col("task_input")) & ~contains_secret(F.col("assistant_response"))) if screen else out


def pair_all_responses(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", screen: bool = True) -> DataFrame:
    """As pair_first_response, but with all non-empty assistant messages of the segment, joined by line feeds in order;
    unanswered and empty user messages are dropped, short ones are not."""
    answer = (F.col(role) == "assistant") & has_value(F.col(text))
    got = _by_segment(turns, conv, turn, role, text, F.sort_array(F.collect_list(F.when(answer, F.struct(turn, text)))).alias("_a"))
    out = got.select(conv, turn, "task_input", F.array_join(F.transform("_a", lambda x: x[text]), "\n").alias("assistant_response"))
    out = out.where(has_value(F.col("task_input"), F.col("assistant_response")))
    return out.where(~contains_secret(F.col("task_input")) & ~contains_secret(F.col("assistant_response"))) if screen else out
