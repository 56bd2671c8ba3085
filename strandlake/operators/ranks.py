"""Numbers of rows in a global order, without sending all rows to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, by: str, out: str, rows_each: int = 100_000, most: int = 10_000) -> DataFrame:
    """Adds ``out``: the row's number, from 1, in the order of the number ``by``. Few rows are numbered at once; more are
    cut at quantiles of ``by`` (at most ``most`` of them), counted by range, and numbered inside their range."""
    n = df.count()
    if n <= rows_each:
        return df.withColumn(out, F.row_number().over(Window.orderBy(by)).cast("long"))
    cuts = min(most, -(-n // rows_each))
    found = df.agg(F.percentile_approx(by, [i / cuts for i in range(1, cuts)], 100 * cuts)).first()[0] or []
    bounds = F.array(*[F.lit(b) for b in sorted(set(found))])
    cut_up = df.withColumn("_range", F.size(F.filter(bounds, lambda b: b <= F.col(by))))
    counts = cut_up.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(counts.select("_range", before.alias("_start")))  # a row for each range
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(by))
    return cut_up.withColumn("_inside", inside).join(starts, "_range").withColumn(out, F.col("_start") + F.col("_inside")).drop("_range", "_inside", "_start")
