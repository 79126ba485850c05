"""Changes of stored tables as plans over the old rows and the new: Spark writes the result, nothing is updated in place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _sides(old: DataFrame, new: DataFrame, keys: Sequence[str]):
    o, n = old.alias("o"), new.alias("n")
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(f"o.{k}") == F.col(f"n.{k}"))
    return o, n, on


def classify(old: DataFrame, new: DataFrame, keys: Sequence[str], refreshed: Sequence[str]) -> DataFrame:
    """New rows with an action: insert, update (a refreshed column differs) or duplicate."""
    o, n, on = _sides(old, new, keys)
    changed = F.lit(False)
    for c in refreshed:
        changed = changed | ~F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}"))
    action = F.when(F.col(f"o.{keys[0]}").isNull(), "insert").when(changed, "update").otherwise("duplicate")
    return n.join(o, on, "left").select("n.*", action.alias("action"))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], refreshed: Sequence[str]) -> DataFrame:
    """Old rows with the refreshed columns of their new rows, and new rows that had none."""
    o, n, on = _sides(old, new, keys)
    known = F.col(f"o.{keys[0]}").isNotNull()
    cols = [F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) if c in refreshed or c in keys else F.when(known, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in old.columns]
    return o.join(n, on, "full").select(*cols)


def upsert_events(old: DataFrame, new: DataFrame) -> DataFrame:
    """Events (event_key, status, archived_by, curated, title, heat) after a run.

    A curated event stays as it is. A published or rejected one, or one that a person archived,
    keeps its status; one that the system archived is a draft again. New events are drafts.
    """
    o, n, on = _sides(old, new, ["event_key"])
    kept = F.coalesce(F.col("o.curated"), F.lit(False)) | F.col("n.event_key").isNull()
    revived = (F.col("o.status") == "archived") & (F.col("o.archived_by") == "system")
    status = F.when(kept, F.col("o.status")).when(revived, "draft").otherwise(F.coalesce("o.status", F.lit("draft")))
    pick = lambda c: F.when(kept, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c)
    return o.join(n, on, "full").select(F.coalesce("o.event_key", "n.event_key").alias("event_key"), status.alias("status"), F.when(kept | ~revived, F.col("o.archived_by")).alias("archived_by"), F.coalesce("o.curated", F.lit(False)).alias("curated"), pick("title"), pick("heat"))


def replace_links(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Links without those of keys that have new ones, and the new ones."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def archive_stale(events: DataFrame, active: DataFrame, whole_run: bool = True) -> DataFrame:
    """Drafts whose key a whole run no longer found become archived by the system; part runs change nothing."""
    if not whole_run:
        return events
    found = active.select("event_key").distinct().withColumn("_found", F.lit(True))
    stale = F.col("_found").isNull() & (F.col("status") == "draft") & ~F.coalesce("curated", F.lit(False))
    return events.join(found, "event_key", "left").select(*(F.when(stale, "archived").otherwise(F.col("status")).alias(c) if c == "status" else F.when(stale, "system").otherwise(F.col("archived_by")).alias(c) if c == "archived_by" else F.col(c) for c in events.columns))


def insert_absent(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old rows and those new ones whose key is not there, once each; running it again changes nothing."""
    return old.unionByName(new.dropDuplicates(list(keys)).join(old, list(keys), "left_anti"))


def write_back(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Old rows with those columns taken from their new rows."""
    own = new.select(key, *(F.col(c).alias(f"_{c}") for c in columns), F.lit(True).alias("_some"))
    return old.join(own, key, "left").select(*(F.when(F.col("_some"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in old.columns))
