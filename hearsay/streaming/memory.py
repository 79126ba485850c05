"""What a chat remembers of each user, as keyed state that expires: the streaming side of chat memory."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Hours that memory lasts, questions of the history, and topics of the trail.
HOURS, HISTORY, TRAIL = 24.0, 6, 5
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Memory(StatefulProcessor):
    """One user's keyword, last questions, trail of topics and the time of the last turn; a timer forgets them."""

    def __init__(self, hours: float, history: int, trail: int) -> None:
        self.seconds, self.most, self.topics = hours * 3600, history, trail

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("memory", "keyword string, history string, trail string, updated double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        turns = pd.concat(list(rows)).sort_values(["ts", "turn_id"])
        keyword, history, trail, updated = "", [], [], None
        if self.state.exists():
            keyword, past, topics, updated = self.state.get()
            history, trail = json.loads(past), json.loads(topics)
        out, stamp = [], None
        for at, turn, topic, word, question in turns[["ts", "turn_id", "topic", "keyword", "question"]].itertuples(index=False):
            now = at.timestamp()
            if updated is not None and now - updated > self.seconds:
                keyword, history, trail = "", [], []
            keyword = word or "" if topic == "switch" else "" if topic == "global" else keyword
            if question:
                history = [*history, question][-self.most :]
            if keyword:
                trail = [*(t for t in trail if t != keyword), keyword][-self.topics :]
            # a turn that comes late doesn't turn the clock back
            updated = now if updated is None else max(updated, now)
            out.append((key[0], turn, keyword, history[-1] if history else None, len(history), "|".join(trail)))
        for stamp in list(self.handle.listTimers()):
            self.handle.deleteTimer(stamp)
        self.state.update((keyword, json.dumps(history), json.dumps(trail), float(updated)))
        self.handle.registerTimer(int((updated + self.seconds) * 1000) + 1)
        yield pd.DataFrame(out, columns=["user_id", "turn_id", "keyword", "last_question", "n_history", "trail"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


def remembered(turns: DataFrame, late: str = "1 hour", *, hours: float = HOURS, history: int = HISTORY, trail: int = TRAIL) -> DataFrame:
    """(user_id, turn_id, keyword, last_question, n_history, trail): what is remembered of a user after each turn of a stream.

    turns: user_id, turn_id, ts, topic, keyword, question. A topic that switches sets the keyword, a
    global one empties it, any other leaves it. The last `history` questions and the last `trail`
    distinct keywords are kept, the latest mentioned last. What is older than `hours` at a user's
    next turn is forgotten; and once the watermark passes that age, a timer drops the state, so
    users who don't come back take no room. Turns of a batch are taken in order of time. Rows
    without a user or a time are left out, as nothing can be remembered of them.
    """
    own = turns.where("user_id is not null and ts is not null").select("user_id", "turn_id", F.col("ts").cast("timestamp").alias("ts"), "topic", "keyword", "question").withWatermark("ts", late)
    kinds = dict(own.dtypes)
    schema = f"user_id {kinds['user_id']}, turn_id {kinds['turn_id']}, keyword string, last_question string, n_history long, trail string"
    return own.groupBy("user_id").transformWithStateInPandas(_Memory(hours, history, trail), schema, "Append", "EventTime")


def run_to_table(stream: DataFrame, folder: str) -> DataFrame:
    """What a stream gives for all that is there now, written below folder and read again; a run that fails goes on from its checkpoint."""
    spark = stream.sparkSession
    path = f"{folder}/stream-{uuid.uuid4().hex}"
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    try:
        query = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(stream.schema).parquet(f"{path}/out")
