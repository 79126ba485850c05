"""Chains of posts in which each allowed one decides which comes next, without a user's posts in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearsay.operators.lineage import cut
from hearsay.operators.order import range_of, value_bounds


def let_through(rows: DataFrame, user: str = "user_id", at: str = "ts", order: str = "event_id", seconds: float = 10.0) -> DataFrame:
    """rows with `allowed`: whether at least `seconds` have passed since the user's last row that was allowed.

    A refused row does not move the clock, so each row depends on all before it: tries at 0, 6
    and 12 seconds allow the first and the third. Rows at one time go by `order`, which tells a
    user's rows apart. A row of unknown time is allowed and moves no clock.

    A row that comes `seconds` or more after the one before it is allowed whatever happened
    earlier. From any other, the chain is followed by doubling: every row points to the first one
    that it would allow; rows reached by the pointers of allowed ones are allowed, and pointers are
    joined with themselves, so a chain of n rows takes log2(n) rounds. Pointers are found within
    ranges of time, and a range without one takes it from the next range that has posts, so no
    window holds a user.
    """
    if seconds <= 0:
        return rows.withColumn("allowed", F.lit(True))
    step = int(seconds * 1_000_000)
    # in a struct, nulls equal each other
    post = cut(rows.where(F.col(at).isNotNull()).select(F.struct(F.col(user)).alias("u"), F.unix_micros(F.col(at).cast("timestamp")).alias("t"), F.col(order).alias("o")).distinct())
    bounds = value_bounds(post, "t")
    ranged = lambda df, c: df.withColumn("r", range_of(F.col(c).cast("double"), bounds))

    # the time of the row before, from within the range or else the last one of an earlier range
    post = ranged(post, "t")
    tails = post.groupBy("u", "r").agg(F.max("t").alias("tail"))
    tails = tails.select("u", "r", F.max("tail").over(Window.partitionBy("u").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"))
    own = post.withColumn("before", F.lag("t").over(Window.partitionBy("u", "r").orderBy("t", "o"))).join(tails, ["u", "r"])
    gap = F.col("t") - F.coalesce("before", "earlier")
    own = cut(own.select("u", "t", "o", F.coalesce(gap >= step, F.lit(True)).alias("sure")))

    # the first row at least `seconds` later
    target = F.struct("t", "o", "sure")
    none = F.lit(None).cast("struct<" + ",".join(f"{c}:{k}" for c, k in own.select("t", "o").dtypes) + ">")
    told = own.select("u", F.col("t").alias("at"), F.lit(1).alias("kind"), target.alias("target"), none.alias("asker"))
    asked = own.select("u", (F.col("t") + step).alias("at"), F.lit(0).alias("kind"), F.lit(None).cast(told.schema["target"].dataType).alias("target"), F.struct("t", "o").alias("asker"))
    both = ranged(told.union(asked), "at")
    heads = both.groupBy("u", "r").agg(F.min("target").alias("head"))
    heads = heads.select("u", "r", F.min("head").over(Window.partitionBy("u").orderBy(F.desc("r")).rowsBetween(Window.unboundedPreceding, -1)).alias("later"))
    backwards = Window.partitionBy("u", "r").orderBy(F.desc("at"), F.desc("kind"), F.desc("target")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("next", F.last("target", ignorenulls=True).over(backwards)).where("kind = 0").join(heads, ["u", "r"])
    step_to = found.select("u", F.col("asker.t").alias("t"), F.col("asker.o").alias("o"), F.coalesce("next", "later").alias("next"))
    # one that is allowed anyway begins a chain of its own
    pointer = cut(step_to.where("next is not null and not next.sure").select("u", "t", "o", F.col("next.t").alias("to_t"), F.col("next.o").alias("to_o")))

    marked = cut(own.where("sure").select("u", "t", "o"))
    while not pointer.isEmpty():
        reached = pointer.join(marked, ["u", "t", "o"]).select("u", F.col("to_t").alias("t"), F.col("to_o").alias("o"))
        marked = cut(marked.union(reached).distinct())
        on = pointer.select("u", F.col("t").alias("to_t"), F.col("o").alias("to_o"), F.col("to_t").alias("far_t"), F.col("to_o").alias("far_o"))
        pointer = cut(pointer.join(on, ["u", "to_t", "to_o"]).select("u", "t", "o", F.col("far_t").alias("to_t"), F.col("far_o").alias("to_o")))

    known = marked.select(F.col("u").alias("_u"), F.col("o").alias("_o"), F.lit(True).alias("_ok")).distinct()
    out = rows.join(known, (F.struct(F.col(user)) == F.col("_u")) & F.col(order).eqNullSafe(F.col("_o")), "left")
    return out.withColumn("allowed", F.coalesce("_ok", F.col(at).isNull())).drop("_u", "_o", "_ok")
