"""The last messages of each conversation, kept as the state of a stream.

A conversation's messages are a list in the state store, of ``most`` at most; the checkpoint is the table, read by
``kept_messages``. A batch reads and writes the state of the conversations that it has messages of. Batches may come in any order, late or again: of several messages for one place in a conversation
the one that is there stays, and within a batch that of ``chat.once``; so the state is that of ``chat.last_messages`` over all that came by.

With a ``delay``, messages that repeat within it are dropped before they reach the state, and so are those that come later than the watermark allows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import chat

STATE = "kept"
#: What keeps lists of a key.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MESSAGE = "seq long, type string, content string, ts timestamp"
COLUMNS = ["seq", "type", "content", "ts"]


def merged(held: list[tuple], new: list[tuple], most: int) -> list[tuple]:
    """Messages ``(seq, type, content, ts)`` by rising place, the last ``most``; nulls come first."""
    first = lambda v: (v is not None, v)
    by_place: dict = {}
    for m in sorted(new, key=lambda m: (first(m[3]), first(m[1]), first(m[2]))):
        by_place.setdefault(m[0], m)
    by_place |= {m[0]: m for m in held}
    return sorted(by_place.values(), key=lambda m: first(m[0]))[-most:]


class LastMessages(StatefulProcessor):
    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState(STATE, MESSAGE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(m) for m in self.kept.get()]
        new: list[tuple] = []
        for frame in rows:
            plain = frame[COLUMNS].astype(object).where(frame[COLUMNS].notna(), None)
            new += [(None if s is None else int(s), t, c, None if at is None else pd.Timestamp(at).to_pydatetime()) for s, t, c, at in plain.itertuples(index=False)]
            new = merged([], new, self.most)  # a batch may hold a great many of one conversation
        self.kept.put(merged(held, new, self.most))
        yield pd.DataFrame({"username": [key[0]], "conversation_id": [key[1]]})

    def close(self) -> None:
        pass


def keep_messages(messages: DataFrame, checkpoint: str, most: int = chat.KEPT, delay: str | None = None) -> StreamingQuery:
    """Streamed ``username, conversation_id, seq, type, content, ts`` (null times become the present); what is kept is in the checkpoint, and a stream that is
    started again with it goes on."""
    spark = messages.sparkSession
    rows = messages.select(*chat.KEY, F.col("seq").cast("long"), "type", "content", F.coalesce("ts", F.current_timestamp()).alias("ts"))
    if delay is not None:
        rows = rows.withWatermark("ts", delay).dropDuplicatesWithinWatermark([*chat.KEY, "seq"])
    mode = "append" if delay is not None else "update"
    touched = rows.groupBy(*chat.KEY).transformWithStateInPandas(LastMessages(most), "username string, conversation_id string", mode, "None")
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, PROVIDER)
    try:
        return touched.writeStream.format("noop").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(setting, before)


def kept_messages(spark: SparkSession, checkpoint: str) -> DataFrame:
    """All that is kept, as a table."""
    with_state = spark.read.format("statestore").option("stateVarName", STATE)
    # with a delay the messages' state is the second one of the plan's, counted from the end
    state = with_state.option("operatorId", 0).load(checkpoint)
    return state.select(*(F.col("key")[k].alias(k) for k in chat.KEY), *(F.col("list_element")[c].alias(c) for c in COLUMNS))
