"""Exact medians of groups of any size, by counts in bins.

A group's median is its value of one or two ranks.  Each round counts the values
between a rank's bounds in BINS bins, at most BINS counters a group and task, and
moves the bounds to the least and greatest value of the bin that holds the rank.
When they are equal the value is found; when a bin holds at most ROWS values
these are numbered in order.  So no task ever holds more than BINS counters or
ROWS values of a group, where the built-in median holds every distinct value.

Null and non-finite values are left out; a group without others has a null
median; null keys are a group; no rows give no groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import few, staged

BINS, ROWS = 1024, 10_000


def narrowed(values: DataFrame, open_: DataFrame, bins: int) -> DataFrame:
    """The ranks of ``open_`` with the bounds of the bin that holds them."""
    spans = open_.select("g", "lo", "hi").distinct()
    x, lo, hi = F.col("x"), F.col("lo"), F.col("hi")
    # A span beyond the range of doubles is halved first.
    share = F.when(hi / 2 - lo / 2 < 8e307, (x - lo) / (hi - lo)).otherwise((x / 2 - lo / 2) / (hi / 2 - lo / 2))
    inside = values.join(few(spans), "g").where(x.between(lo, hi)).withColumn("bin", F.least(F.floor(share * bins), F.lit(bins - 1)))
    counts = inside.groupBy("g", "lo", "hi", "bin").agg(F.count("*").alias("held"), F.min("x").alias("least"), F.max("x").alias("most"))
    order = Window.partitionBy("g", "lo", "hi").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("below", F.coalesce(F.sum("held").over(order), F.lit(0)))
    met = open_.drop("held").join(counts, ["g", "lo", "hi"])
    at = F.col("rank") - F.col("before")
    met = met.where((at >= F.col("below")) & (at < F.col("below") + F.col("held")))
    return met.select("g", "rank", (F.col("before") + F.col("below")).alias("before"), "held", F.col("least").alias("lo"), F.col("most").alias("hi"))


def medians(rows: DataFrame, groups: list[str], value: str, bins: int = BINS, most: int = ROWS) -> DataFrame:
    """The columns ``groups`` and ``value``: each group's median as a double, the mean of both middle values where there are two."""
    x = F.col(value).cast("double")
    finite = F.when(x.between(-1.7976931348623157e308, 1.7976931348623157e308), x)
    values = staged(rows.select(F.struct(*groups).alias("g"), finite.alias("x")), "values")
    whole = staged(values.groupBy("g").agg(F.count("x").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")), "groups")
    middle = F.array_distinct(F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)))
    ranks = whole.where("n > 0").select("g", F.explode(middle).alias("rank"), F.lit(0).cast("long").alias("before"), F.col("n").alias("held"), "lo", "hi")
    ranks = staged(ranks, "ranks")
    wide = (F.col("lo") < F.col("hi")) & (F.col("held") > most)
    while not ranks.where(wide).isEmpty():
        ranks = staged(ranks.where(~wide).unionByName(narrowed(values, ranks.where(wide), bins)), "ranks")
    found = ranks.where("lo = hi").select("g", F.col("lo").alias("v"))
    rest = ranks.where("lo < hi")
    held = values.join(few(rest.select("g", "lo", "hi").distinct()), "g").where(F.col("x").between(F.col("lo"), F.col("hi")))
    numbered = held.withColumn("at", F.row_number().over(Window.partitionBy("g", "lo", "hi").orderBy("x")) - 1)
    rest = rest.join(numbered, ["g", "lo", "hi"]).where(F.col("rank") - F.col("before") == F.col("at")).select("g", F.col("x").alias("v"))
    found = found.unionByName(rest).groupBy("g").agg((F.min("v") / 2 + F.max("v") / 2).alias("v"))
    return whole.select("g").join(found, "g", "left").select(*[F.col(f"g.{c}").alias(c) for c in groups], F.col("v").alias(value))
