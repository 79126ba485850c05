"""Plans from stored schemas, and runs that log themselves."""

import pytest
from pyspark.sql import functions as F

from hearsay.plans import catalog as ct
from hearsay.plans import runs as rn


def tables(spark):
    return {"a": spark.createDataFrame([(1, "x"), (2, "x"), (3, None), (4, None)], "id long, name string"), "b": spark.createDataFrame([(7,), (7,), (8,), (8,), (9,)], "id int")}


def test_plan(spark):
    wanted = [ct.Wanted("a", "id", True), ct.Wanted("a", "name", True), ct.Wanted("b", "id", True), ct.Wanted("c", "id", True), ct.Wanted("a", "excluded", type="boolean"), ct.Wanted("a", "id", type="string"), ct.Wanted("b", "id", type="int")]
    got = [tuple(r) for r in ct.plan(spark, wanted, tables(spark)).collect()]
    assert got == [("a", "id", "create", 0, []), ("a", "name", "refuse_duplicates", 1, ["x"]), ("b", "id", "refuse_duplicates", 2, ["7", "8"]), ("c", "id", "skip_missing_table", 0, []), ("a", "excluded", "add_column", 0, []), ("a", "id", "change_type", 0, []), ("b", "id", "skip_exists", 0, [])]


def test_known_unique_columns_are_not_read(spark):
    class Rows:
        schema = spark.createDataFrame([], "id int").schema

    assert ct.plan(spark, [ct.Wanted("b", "id", True)], {"b": Rows()}, [("b", "id")]).first().action == "skip_exists"


def test_applied(spark):
    plans = ct.plan(spark, [ct.Wanted("a", "id", True), ct.Wanted("a", "name", True), ct.Wanted("a", "new"), ct.Wanted("c", "id")], tables(spark))
    done = []

    def apply(table, column, action):
        done.append((table, column, action))
        if column == "id":
            raise ValueError("too long")

    got = {(r.table, r.column): (r.status, r.error) for r in ct.applied(plans, apply).collect()}
    assert got == {("a", "id"): ("failed", "ValueError: too long"), ("a", "name"): ("refused", None), ("a", "new"): ("created", None), ("c", "id"): ("skipped", None)}
    assert sorted(done) == [("a", "id", "create"), ("a", "new", "add_column")]
    dry = ct.applied(plans, apply, dry_run=True)
    assert {r.status for r in dry.collect()} == {"would_create", "refused", "skipped"} and len(done) == 2 and ct.exit_code(dry) == 1
    assert ct.exit_code(dry.where("status <> 'refused'")) == 0


@pytest.mark.parametrize("bad, status", [(0, "success"), (3, "partial"), (10, "failed")])
def test_a_run_counts_what_it_writes(spark, tmp_path, bad, status):
    rows = spark.range(10).withColumn("fine", F.when(F.col("id") >= bad, True))
    row = rn.observed_write(rows, f"{tmp_path}/rows", f"{tmp_path}/log", "r1", ok=F.col("fine"), counts={"odd": F.sum(F.col("id") % 2)})
    assert (row.status, row.total, row.success, row.failed, row.detail) == (status, 10, 10 - bad, bad, '{"failed": %d, "odd": 5, "total": 10}' % bad)
    assert spark.read.parquet(f"{tmp_path}/rows").count() == 10 - bad
    rn.observed_write(rows, f"{tmp_path}/rows", f"{tmp_path}/log", "r2")
    assert {r.run_id: r.status for r in spark.read.parquet(f"{tmp_path}/log").collect()} == {"r1": status, "r2": "success"}


def test_a_run_that_breaks_off_is_logged(spark, tmp_path):
    broken = spark.range(10).select(F.raise_error(F.lit("token=abc gone")).alias("x"))
    with pytest.raises(Exception, match="gone"):
        rn.observed_write(broken, f"{tmp_path}/rows", f"{tmp_path}/log", "r1")
    row = spark.read.parquet(f"{tmp_path}/log").first()
    assert (row.status, row.total) == ("failed", 0) and "abc" not in row.error and "<redacted>" in row.error
    empty = rn.observed_write(spark.range(0), f"{tmp_path}/rows", f"{tmp_path}/log", "r2")
    assert (empty.status, empty.total) == ("success", 0)
