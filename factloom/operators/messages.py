"""Session message logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_history(messages: DataFrame, session_id: str) -> DataFrame:
    return messages.filter(F.col("session_id") == session_id).orderBy("created_at", "seq")


def unread(messages: DataFrame, to_agent: str) -> DataFrame:
    waiting = (F.col("to_agent") == to_agent) & ~F.coalesce("read", F.lit(False))
    return messages.filter(waiting)


def list_sessions(messages: DataFrame) -> DataFrame:
    return messages.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n_messages"),
        F.min("created_at").alias("started_at"),
        F.max("created_at").alias("last_at"),
        F.count_if(~F.coalesce("read", F.lit(False))).alias("n_unread"),
    )


def transcripts(messages: DataFrame, me: str) -> DataFrame:
    """Every session as the agent `me` sees it; a last turn of the other side is left out.

    The last turn is one aggregate per session (combined before the shuffle), not a window over the
    whole session.
    """
    roles = messages.withColumn(
        "role", F.when(F.col("from_agent") == me, "assistant").otherwise("user")
    )
    last = roles.groupBy("session_id").agg(
        F.max("seq").alias("_last"), F.max_by("role", "seq").alias("_last_role")
    )
    open_end = last.filter(F.col("_last_role") == "user").select(
        "session_id", F.col("_last").alias("seq")
    )
    return roles.join(open_end, ["session_id", "seq"], "left_anti").select(
        "session_id", "seq", "role", "content"
    )
