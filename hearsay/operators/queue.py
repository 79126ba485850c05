"""Work queues and run logs as plans: leases, targets, stops and roll-ups."""

from __future__ import annotations

import bisect
import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearsay.operators.order import global_places


def leased(tasks: DataFrame, now: Column, worker: str, n: int = 1, minutes: int = 30) -> DataFrame:
    """Tasks (id, status, priority, lease_until, owner) after expired leases fell back to pending and the n first pending ones were claimed."""
    expired = (F.col("status") == "claimed") & (F.col("lease_until") < now)
    own = tasks.withColumn("status", F.when(expired, "pending").otherwise(F.col("status")))
    first = own.where("status = 'pending'").orderBy(F.desc("priority"), "id").limit(n).select("id", F.lit(True).alias("_claimed"))
    own = own.join(first, "id", "left")
    until = F.timestamp_seconds(F.unix_micros(now) / F.lit(1e6) + minutes * 60)
    return own.select("id", F.when(F.col("_claimed"), "claimed").otherwise(F.col("status")).alias("status"), "priority", F.when(F.col("_claimed"), until).when(F.col("status") == "claimed", F.col("lease_until")).alias("lease_until"), F.when(F.col("_claimed"), worker).when(F.col("status") == "claimed", F.col("owner")).alias("owner"))


def targets(tasks: DataFrame, *, claimed: bool = False, failed: bool = False, done: bool = False, platform: str | None = None) -> DataFrame:
    """Tasks that a reset touches."""
    statuses = [s for s, on in (("claimed", claimed), ("failed", failed), ("done", done)) if on]
    own = tasks.where(F.col("status").isin(*statuses)) if statuses else tasks.limit(0)
    return own.where(F.col("platform") == platform) if platform else own


def run_totals(steps: DataFrame, run: str = "run_id") -> DataFrame:
    """(run, seen, stored, stop_reason, status): sums of a run's steps (seq, seen, stored, reason), its first stop reason, and success, partial or failed."""
    status = F.when(F.sum("failed") == 0, "success").when(F.sum("stored") > 0, "partial").otherwise("failed")
    return steps.groupBy(run).agg(F.sum("seen").alias("seen"), F.sum("stored").alias("stored"), F.min_by("reason", F.when(F.col("reason").isNotNull(), F.col("seq"))).alias("stop_reason"), status.alias("status"))


def caught_up(page: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """One row: how many ids of a page are new, and whether none is."""
    new = page.select(key).distinct().join(stored.select(key), key, "left_anti")
    return new.agg(F.count("*").alias("fresh"), (F.count("*") == 0).alias("caught_up"))


def explored_places(n: int, quota: int, chance: float, seed: int) -> list[int]:
    """The places, from 1, that an exploring choice of `quota` out of n takes: each time the first that is left, or, with `chance`, any of the others alike."""
    if n <= quota:
        return list(range(1, n + 1))
    rng, taken = random.Random(seed), []
    for k in range(max(quota, 0)):
        place = rng.randrange(1, n - k) if n - k > 1 and rng.random() < chance else 0
        # the place-th of those that are left
        for t in taken:
            if t > place:
                break
            place += 1
        bisect.insort(taken, place)
    return [t + 1 for t in taken]


def explored(items: DataFrame, lead: Column, order: Sequence[Column], quota: int, chance: float, seed: int) -> DataFrame:
    """`quota` rows of items with their place in the order (whose first key is `lead`, ascending): mostly the first ones, and some from anywhere behind, so that none starves.

    Only places are drawn, on the driver, `quota` of them; rows are numbered by ranges, so neither
    all of them nor their order come together anywhere. Equal seeds choose alike.
    """
    places = explored_places(items.count(), quota, chance, seed)
    chosen = items.sparkSession.createDataFrame([(p,) for p in places], "place long")
    return global_places(items, lead, order).join(F.broadcast(chosen), "place").select(*items.columns, "place")
