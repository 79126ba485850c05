"""What has to change for stored tables to be as wanted: a plan from their schemas, and a probe that refuses what the rows don't allow."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Duplicated values that a refusal names.
SAMPLES = 5


@dataclass(frozen=True)
class Wanted:
    """A column of a table, of a type (any, if empty), that is there, or whose values are unique."""

    table: str
    column: str
    unique: bool = False
    type: str = ""


def duplicates(rows: DataFrame, column: str, samples: int = SAMPLES) -> tuple[int, list[str]]:
    """How many values of a column more than one row has, and the least of them as text; nulls don't count, as they equal nothing."""
    twice = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n")).where("n > 1")
    least = [str(r.v) for r in twice.orderBy("v").limit(samples).collect()]
    return (twice.count() if least else 0), least


def plan(spark: SparkSession, wanted: Sequence[Wanted], tables: Mapping[str, DataFrame], unique: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """(table, column, action, n, samples): one row for each wanted thing, in any order.

    tables maps the names of stored tables to their rows, unique names columns known to be unique. Actions:
    skip_missing_table, skip_exists (nothing to do), add_column, change_type (n and samples empty),
    create (a unique column may be declared), and refuse_duplicates with the number of duplicated
    values and the least of them. Rows are only read for a column that is there and not known to
    be unique; that probe is an aggregate over the column alone.
    """
    rows = []
    for w in wanted:
        n, samples = 0, []
        if w.table not in tables:
            action = "skip_missing_table"
        else:
            types = {f.name: f.dataType.simpleString() for f in tables[w.table].schema}
            if w.column not in types:
                action = "add_column"
            elif w.type and types[w.column] != w.type:
                action = "change_type"
            elif not w.unique or (w.table, w.column) in unique:
                action = "skip_exists"
            else:
                n, samples = duplicates(tables[w.table], w.column)
                action = "refuse_duplicates" if n else "create"
        rows.append((w.table, w.column, action, n, samples))
    return spark.createDataFrame(rows, "table string, column string, action string, n long, samples array<string>")


def applied(plans: DataFrame, apply: Callable[[str, str, str], None], dry_run: bool = False) -> DataFrame:
    """(table, column, action, status, error) of a plan: created, would_create, skipped, refused or failed.

    apply gets the table, the column and the action of what is to be done; one that raises is
    noted and stops none of the others. A plan has a row for each wanted thing, so it comes to the driver.
    """
    out = []
    for r in plans.orderBy("table", "column").collect():
        error = None
        if r.action.startswith("skip"):
            status = "skipped"
        elif r.action == "refuse_duplicates":
            status = "refused"
        elif dry_run:
            status = "would_create"
        else:
            try:
                apply(r.table, r.column, r.action)
                status = "created"
            except Exception as e:  # noqa: BLE001  noted beside what failed
                status, error = "failed", f"{type(e).__name__}: {e}"
        out.append((r.table, r.column, r.action, status, error))
    return plans.sparkSession.createDataFrame(out, "table string, column string, action string, status string, error string")


def exit_code(outcomes: DataFrame) -> int:
    """1 if anything failed or was refused."""
    return int(not outcomes.where("status in ('failed', 'refused')").isEmpty())
