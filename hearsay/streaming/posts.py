"""Streams of posts and events: deduplication, windows, gaps and upserts by Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def write_id(item_type: Column, note_id: Column, comment_id: Column) -> Column:
    """The id that a written item goes by: a comment's own one, or else its post's, and the other way round for posts; null where both are null or empty."""
    note, comment = (F.nullif(x.cast("string"), F.lit("")) for x in (note_id, comment_id))
    return F.when(item_type == "comments", F.coalesce(comment, note)).otherwise(F.coalesce(note, comment))


def distinct_writes(stream: DataFrame, scope: Sequence[str], id_col: str, at: str = "ts", late: str = "1 day") -> DataFrame:
    """Each id once within the watermark for each combination of the scope (platform, crawl and item type); rows without an id, null or empty, all pass."""
    known = stream.where(F.coalesce(F.col(id_col).cast("string"), F.lit("")) != "")
    passing = stream.where(F.coalesce(F.col(id_col).cast("string"), F.lit("")) == "")
    return known.withWatermark(at, late).dropDuplicatesWithinWatermark([*scope, id_col]).union(passing)


def windowed_counts(stream: DataFrame, label: str, at: str = "ts", late: str = "1 hour", wide: str = "1 day", slide: str | None = None) -> DataFrame:
    """(start, label, n, total) of tumbling windows, or sliding ones; a window is final once the watermark passed it."""
    window = F.window(at, wide, slide) if slide else F.window(at, wide)
    return stream.withWatermark(at, late).groupBy(window.alias("w"), label).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), label, "n", "total")


def sessions(stream: DataFrame, key: str, at: str = "ts", late: str = "1 hour", gap: str = "30 minutes") -> DataFrame:
    """(start, end, key, n) of runs of rows of a key without a gap."""
    own = stream.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("s"), key).agg(F.count("*").alias("n"))
    return own.select(F.col("s.start").alias("start"), F.col("s.end").alias("end"), key, "n")


def cooled_down(stream: DataFrame, key: str = "user_id", seconds: float = 10.0) -> DataFrame:
    """(key, event_id, ts) of rows at least `seconds` after the last one of the key that was let through.

    The state of a key is one time; rows of a batch are taken in order of time.
    """

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        last = state.get[0] if state.exists else None
        keep = []
        for at in rows["ts"].map(lambda t: t.timestamp()):
            keep.append(last is None or at - last >= seconds)
            last = at if keep[-1] else last
        if last is not None:
            state.update((float(last),))
        yield rows.loc[keep, [key, "event_id", "ts"]]

    kind = stream.schema[key].dataType.simpleString()
    return stream.select(key, "event_id", F.col("ts").cast("timestamp").alias("ts")).groupBy(key).applyInPandasWithState(run, f"{key} {kind}, event_id long, ts timestamp", "last double", "append", GroupStateTimeout.NoTimeout)


def into_table(stream: DataFrame, merge: Callable[[DataFrame | None, DataFrame], DataFrame], folder: str, checkpoint: str):
    """Merge each batch into a Parquet table of versions: the newest version read, merged, and written as the next.

    A batch that runs again after a failure writes its own version again, so the table is the
    same. Returns the writer, ready to start.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        old = None if number == 0 else spark.read.parquet(f"{folder}/v{number - 1}")
        merge(old, df).write.mode("overwrite").parquet(f"{folder}/v{number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
