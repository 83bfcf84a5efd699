"""Chat tables: J16 sessions, W5 history, W6 follow-up context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.operators.statements import carry_last

# Messages that ask about the previous answer.
FOLLOW_UPS = [
    "why", "why?", "why not", "why not?", "how?", "how come?", "can you explain?", "can you explain",
    "reason?", "why is that?", "why so?",
]
NOT_A_QUESTION = ["why", "why?", "why not", "why not?", "how?", "how come?", "can you explain?", "can you explain"]
HISTORY_LIMIT = 50


def sessions_for(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """Newest session per (owner, document); pairs without one get a row."""
    keys = ["user_id", "document_id"]
    newest = sessions.groupBy(*keys).agg(F.max_by("session_id", F.struct("created_at", "session_id")).alias("session_id"))
    pairs = messages.select(*keys).distinct()
    missing = pairs.join(newest, keys, "left_anti").withColumn(
        "session_id", F.concat_ws("_", F.lit("session"), F.col("user_id").cast("string"), F.col("document_id").cast("string"))
    )
    return newest.withColumn("created", F.lit(False)).unionByName(missing.withColumn("created", F.lit(True)))


def chat_history(messages: DataFrame, limit: int = HISTORY_LIMIT, order: str = "turn") -> DataFrame:
    """Oldest messages first, up to the limit (applied before the shuffle too)."""
    w = Window.partitionBy("user_id", "document_id").orderBy(order)
    return messages.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= limit)


def followup_context(messages: DataFrame, order: str = "turn", stretch: int = 1000) -> DataFrame:
    """For each user message, what was said before it.

    A conversation is cut into stretches of turns, so a very long one spreads
    over tasks; only one row per stretch is carried on.
    """
    text = F.trim(F.coalesce("content", F.lit("")))
    said = F.lower(text)
    is_user = F.col("role") == "user"
    rows = messages.withColumn("_stretch", F.floor(F.col(order) / stretch))
    values = {
        "last_answer": F.when(F.col("role") == "assistant", text),
        "last_question": F.when(is_user & ~said.isin(NOT_A_QUESTION), text),
    }
    out = carry_last(rows, values, ["user_id", "document_id"], [order], ["_stretch"])
    followup = is_user & (said.isin(FOLLOW_UPS) | said.startswith("why "))
    return out.filter(is_user).withColumn("is_followup", followup).drop("_stretch")
