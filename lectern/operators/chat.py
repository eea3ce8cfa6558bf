"""The log of messages: ``username, conversation_id, seq, type, content, ts``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEPT = 50
KEY = ["username", "conversation_id"]


def history(messages: DataFrame, username: str, conversation_id: str) -> DataFrame:
    return messages.where((F.col("username") == username) & (F.col("conversation_id") == conversation_id)).orderBy("seq")


def last_messages(messages: DataFrame, most: int = KEPT) -> DataFrame:
    """The last ``most`` messages of each conversation."""
    order = Window.partitionBy(*KEY).orderBy(F.desc("seq"))
    return messages.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= most).drop("_at")


def once(messages: DataFrame, origin: Column | None = None) -> DataFrame:
    """One row for each place in a conversation: of the least ``origin``, then the earliest, then by type and content."""
    order = Window.partitionBy(*KEY, "seq").orderBy(F.lit(0) if origin is None else origin, "ts", "type", "content")
    return messages.withColumn("_at", F.row_number().over(order)).where("_at = 1").drop("_at")


def append(messages: DataFrame, new: DataFrame, most: int = KEPT) -> DataFrame:
    """New messages after those of their conversation (``seq`` of new ones counts within the batch), with the present time if they
    have none; what is there already stays as it is, and each conversation keeps its last."""
    stamped = new.withColumn("ts", F.coalesce("ts", F.current_timestamp()))
    both = messages.withColumn("_new", F.lit(0)).unionByName(stamped.withColumn("_new", F.lit(1)))
    return last_messages(once(both, F.col("_new")).drop("_new"), most)


def without(messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """Messages of all but the conversations given by user and id."""
    return messages.join(conversations.select(*KEY).distinct(), KEY, "left_anti")


def user_conversations(messages: DataFrame, most: int = 10) -> DataFrame:
    """``(username, conversation_id, last_message, message_count, last_activity)`` of each user's latest conversations."""
    each = messages.groupBy(*KEY).agg(F.max_by("content", "seq").alias("last_message"), F.count(F.lit(1)).alias("message_count"), F.max_by("ts", "seq").alias("last_activity"))
    order = Window.partitionBy("username").orderBy(F.desc("last_activity"), "conversation_id")
    return each.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= most).drop("_at")


def recent_messages(messages: DataFrame, most: int = 10) -> DataFrame:
    """Each user's latest messages over all conversations."""
    order = Window.partitionBy("username").orderBy(F.desc("ts"), F.desc("seq"), "conversation_id")
    return messages.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= most).drop("_at")
