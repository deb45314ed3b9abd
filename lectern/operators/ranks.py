"""Places in one order over a whole table, without a task that holds all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Keys drawn to find the bounds, and ranges cut between them.
SAMPLE, RANGES = 4096, 64


def ranked(df: DataFrame, key: str, place: str) -> DataFrame:
    """``df`` with ``place``: 1 for the smallest ``key``, nulls first, equal keys in any order.

    Bounds cut the keys into ranges of about one size, rows are numbered within
    their range, and the counts of the ranges before are added.  The bounds are
    keys of the smallest hashes, so the driver holds ``SAMPLE`` keys at any size
    of the table.  Rows of one key are numbered by one task.  An empty table
    gives no rows; columns named like the helpers' are not touched.
    """
    drawn = df.select(F.col(key).alias("k")).where("k is not null").distinct().orderBy(F.xxhash64("k"), "k").limit(SAMPLE)
    keys = [r["k"] for r in drawn.orderBy("k").collect()]
    step = max(1, len(keys) // RANGES)
    bounds = [F.lit(k) for k in keys[step::step]]
    below = F.size(F.filter(F.array(*bounds), lambda b: b <= F.col(key))) if bounds else F.lit(0)
    inner = df.select(F.struct("*").alias("_r_row"), F.col(key).alias("_r_key"), below.alias("_r_range"))
    counts = inner.groupBy("_r_range").agg(F.count("*").alias("_r_n"))
    # As many rows as ranges.
    before = F.sum("_r_n").over(Window.orderBy("_r_range").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("_r_range", F.coalesce(before, F.lit(0)).alias("_r_before"))
    placed = inner.join(F.broadcast(counts), "_r_range")
    at = F.row_number().over(Window.partitionBy("_r_range").orderBy(F.col("_r_key").asc_nulls_first()))
    return placed.withColumn(place, (at + F.col("_r_before")).cast("long")).select("_r_row.*", place)
