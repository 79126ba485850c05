"""Exact order statistics of groups of any size: ranks, places and middle values without a window over a whole group.

A sketch of the values gives bounds that cut them into ranges; equal values of a group are counted
first, the counts of whole ranges run up over a few rows a group, and a window only ever sees the
distinct values of one range. The sketch decides how rows are dealt, never what comes out.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows for each range, and most ranges, which bounds the literal and the rows that run up in a group.
SHARE, MOST = 200_000, 4096
#: A key is hot above this share of all rows, so at most HOT keys are broadcast.
HOT = 1000


def number_of(df: DataFrame, value: str) -> Column:
    """A column as a double that keeps its order: numbers as they are, times in seconds."""
    kind = df.schema[value].dataType.typeName()
    return (F.col(value).cast("timestamp") if kind in ("timestamp_ntz", "date") else F.col(value)).cast("double")


def value_bounds(df: DataFrame, value: str, total: int | None = None, share: int | None = None, most: int = MOST) -> list[float]:
    """At most `most` ascending values that cut the column, as doubles, into ranges of about `share` rows; total is df's number of rows, if known."""
    ranges = min(most, 1 + (df.count() if total is None else total) // (share or SHARE))
    if ranges == 1:
        return []
    sketch = F.percentile_approx(number_of(df, value), [i / ranges for i in range(1, ranges)], 20 * ranges)
    return sorted(set(df.agg(sketch.alias("at")).first().at or ()))


def range_of(value: Column, bounds: Sequence[float]) -> Column:
    """How many of the ascending bounds are at most a double, by halving; 0 for null."""
    if not bounds:
        return F.lit(0)
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    table = F.array(*map(F.lit, bounds))
    at = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: at + F.when(value >= F.get(table, at + step - 1), step).otherwise(0))
    return F.coalesce(at, F.lit(0))


def running_counts(df: DataFrame, group: Sequence[str], value: str, bounds: Sequence[float] | None = None) -> DataFrame:
    """(group, value, n, below, whole) for each distinct value of a group: rows with it, rows with lesser ones (null is least), and rows of the group."""
    keys = list(group)
    bounds = value_bounds(df, value) if bounds is None else bounds
    cell = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    cell = cell.withColumn("_range", range_of(number_of(cell, value), bounds))
    if not bounds:
        whole = F.sum("n").over(Window.partitionBy(*keys))
        return cell.select(*keys, value, "n", (F.sum("n").over(Window.partitionBy(*keys).orderBy(F.col(value).asc_nulls_first())) - F.col("n")).alias("below"), whole.alias("whole"))
    per = cell.groupBy(*keys, "_range").agg(F.sum("n").alias("_in"))
    over = Window.partitionBy(*keys)
    per = per.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_range").alias("_at"), (F.sum("_in").over(over.orderBy("_range")) - F.col("_in")).alias("_before"), F.sum("_in").over(over).alias("whole"))
    same = F.col("_range") == F.col("_at")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    within = Window.partitionBy(*keys, "_range").orderBy(F.col(value).asc_nulls_first())
    return cell.join(per, same).select(*keys, value, "n", (F.col("_before") + F.sum("n").over(within) - F.col("n")).alias("below"), "whole")


def with_values(df: DataFrame, found: DataFrame, keys: Sequence[str], total: int, n: str = "n") -> DataFrame:
    """df with the other columns of found, which has one row for each combination of keys in df (nulls equal each other) and in n how many of df's total rows have it.

    The at most HOT combinations with over a share of 1 / HOT of all rows are broadcast, and their
    rows go on by a hash of the whole row; all others meet theirs by the keys. Up to SHARE rows, which
    one task holds, all do.
    """
    rest = [c for c in found.columns if c not in (*keys, n)]

    def side(rows: DataFrame, name: str, *more: Column) -> DataFrame:
        return rows.select(*more, *(F.col(k).alias(f"_{name}_{k}") for k in keys), F.struct(*rest).alias(f"_{name}"))

    def same(name: str) -> Column:
        out = F.lit(True)
        for k in keys:
            out = out & F.col(k).eqNullSafe(F.col(f"_{name}_{k}"))
        return out

    if total <= SHARE:
        return df.join(side(found, "cold"), same("cold"), "left").select(*df.columns, *(F.col("_cold")[c].alias(c) for c in rest))
    hot = F.broadcast(side(found.where(F.col(n) * HOT > total), "hot"))
    # always 0, but no literal: Spark would leave it out of the join's keys, and hot rows would go by theirs alone
    cold = side(found.where(F.col(n) * HOT <= total), "cold", F.when(F.col(n) < 0, 1).otherwise(0).alias("_own"))
    spread = df.join(hot, same("hot"), "left").withColumn("_salt", F.when(F.col("_hot").isNull(), 0).otherwise(1 + F.pmod(F.hash(*df.columns), F.lit(1 << 20))))
    met = spread.join(cold, same("cold") & (F.col("_salt") == F.col("_own")), "left").withColumn("_found", F.coalesce("_hot", "_cold"))
    return met.select(*df.columns, *(F.col("_found")[c].alias(c) for c in rest))


def looked_up(df: DataFrame, rows: DataFrame, key: str, out: str, keys_of: DataFrame | None = None) -> DataFrame:
    """df with a column `out`: the struct of rows' other columns whose key is that of df, null where there is none; rows has a key once.

    Keys that many rows of df have, null among them, are looked up by a broadcast (see with_values). keys_of:
    rows with the same keys as df that cost less to make, to count them by.
    """
    keys_of = df if keys_of is None else keys_of
    many = keys_of.groupBy(key).agg(F.count("*").alias("n"))
    held = rows.select(F.col(key).alias("_key"), F.struct(*(c for c in rows.columns if c != key)).alias(out))
    return with_values(df, many.join(held, F.col(key) == F.col("_key"), "left").select(key, "n", out), [key], keys_of.count())


def order_statistics(df: DataFrame, group: Sequence[str], value: str, places: dict[str, Callable[[Column], Column]], **more: Column) -> DataFrame:
    """(group, name, ...): for each name the value at a place of the group's sorted values, counted from 0; a place beyond them is null.

    places maps names to functions of the group's number of values. more are aggregates over
    (n, value, below, whole) of the distinct values. Null values are left out.
    """
    ranks = running_counts(df.where(F.col(value).isNotNull()).select(*group, value), group, value)

    def at(place: Callable[[Column], Column]) -> Column:
        k = place(F.col("whole"))
        return F.max(F.when((F.col("below") <= k) & (k < F.col("below") + F.col("n")), F.col(value)))

    return ranks.groupBy(*group).agg(*(at(p).alias(name) for name, p in places.items()), *(c.alias(name) for name, c in more.items()))


def low_middle(n: Column) -> Column:
    return F.floor((n - 1) / 2)


def high_middle(n: Column) -> Column:
    return F.floor(n / 2)


def global_places(df: DataFrame, lead: Column, order: Sequence[Column], out: str = "place") -> DataFrame:
    """df with each row's place, from 1, in an order whose rows have an ascending number `lead`; rows that the order doesn't tell apart get different places.

    Rows are counted by ranges of lead (null comes last), so no task sorts all of them.
    """
    own = df.withColumn("_lead", F.coalesce(lead.cast("double"), F.lit(float("inf"))))
    own = own.withColumn("_range", range_of(F.col("_lead"), value_bounds(own, "_lead")))
    per = own.groupBy("_range").agg(F.count("*").alias("_in"))
    # a row for each range: at most MOST
    per = F.broadcast(per.select(F.col("_range").alias("_at"), (F.sum("_in").over(Window.orderBy("_range")) - F.col("_in")).alias("_before")))
    within = F.row_number().over(Window.partitionBy("_range").orderBy("_lead", *order))
    return own.join(per, F.col("_range") == F.col("_at")).withColumn(out, F.col("_before") + within).drop("_lead", "_range", "_at", "_before")
