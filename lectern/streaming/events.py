"""Order-dependent readings of event tables: runs, progress, last states, terminal events, model streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def changes(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Rows whose value differs from the one before of their key."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(order))
    number = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return rows.withColumns({"_b": before, "_n": number}).where((F.col("_n") == 1) | ~F.col("_b").eqNullSafe(F.col(value))).drop("_b", "_n")


def rising(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Rows whose value is not below any before of their key."""
    most = F.max(value).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_m", most).where(F.col("_m").isNull() | (F.col(value) >= F.col("_m"))).drop("_m")


def runs(rows: DataFrame, key: str, order: str, kind: str, value: str) -> DataFrame:
    """key, run (from 0), kind, text, n: neighbouring rows of one kind joined in order."""
    w = Window.partitionBy(key).orderBy(order)
    new = (~F.lag(kind).over(w).eqNullSafe(F.col(kind))) | (F.row_number().over(w) == 1)
    numbered = rows.withColumn("_new", new.cast("long")).withColumn("run", F.sum("_new").over(w) - 1)
    held = numbered.groupBy(key, "run", kind).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("string").alias("v")))).alias("p"), F.count("*").alias("n"))
    return held.select(key, "run", kind, F.array_join(F.transform("p", lambda x: x["v"]), "").alias("text"), "n")


def latest(rows: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """The state of each key after all its patches: each field's last value that is not null."""
    return rows.groupBy(key).agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in fields])


def settled(rows: DataFrame, key: str, order: str, kind: str, terminal: list[str], cancel: str | None = None) -> DataFrame:
    """key, kind and order of the event that ended each key: the first terminal one; a cancelling one of the same moment comes first."""
    rank = F.when(F.col(kind) == cancel, 0).otherwise(1) if cancel else F.lit(1)
    ended = rows.where(F.col(kind).isin(*terminal, *([cancel] if cancel else [])))
    first = ended.groupBy(key).agg(F.min(F.struct(F.col(order), rank.alias("rank"), F.col(kind))).alias("f"))
    return first.select(key, F.col(f"f.{order}").alias(order), F.col(f"f.{kind}").alias(kind))


def visible_deltas(events: DataFrame) -> DataFrame:
    """kind (output or reasoning), delta of (thread, seq, method, item, item_type, phase, delta): commentary and empty ones go."""
    started = events.where("method = 'item/started' and item_type = 'agentMessage'").groupBy("thread", "item").agg(F.max_by("phase", "seq").alias("started_phase"))
    deltas = events.where("method in ('item/agentMessage/delta', 'item/reasoning/summaryTextDelta') and coalesce(delta, '') <> ''")
    met = deltas.join(started, ["thread", "item"], "left")
    said = F.col("method") == "item/agentMessage/delta"
    met = met.where(~said | (F.coalesce("started_phase", F.lit("")) != "commentary"))
    return met.select("thread", "seq", F.when(said, "output").otherwise("reasoning").alias("kind"), "delta")


def final_text(events: DataFrame) -> DataFrame:
    """thread, text: the last completed message that is no commentary; null if it is empty or there is none."""
    done = (F.col("method") == "item/completed") & (F.col("item_type") == "agentMessage") & (F.coalesce("phase", F.lit("")) != "commentary") & F.col("text").isNotNull()
    return events.groupBy("thread").agg(F.max_by("text", F.when(done, F.col("seq"))).alias("text")).withColumn("text", F.nullif("text", F.lit("")))


def tagged(deltas: DataFrame, chunk: Column, total: Column) -> DataFrame:
    """Deltas with their part's position."""
    return deltas.withColumns({"current": chunk + 1, "total": total})


def unique_names(rows: DataFrame, key: str, base: str, order: str, taken: DataFrame | None = None) -> DataFrame:
    """Adds name: base, base-2, base-3, ... in order, without names already ``taken`` (name)."""
    w = Window.partitionBy(base).orderBy(order, key)
    numbered = rows.withColumn("_n", F.row_number().over(w))
    if taken is None:
        return numbered.withColumn("name", F.when(F.col("_n") == 1, F.col(base)).otherwise(F.concat(base, F.lit("-"), F.col("_n").cast("string")))).drop("_n")
    # Numbers already taken of each base, in order: the n-th row gets the n-th free number.
    bases = rows.select(base).distinct()
    plain = taken.select(F.col("name").alias(base), F.lit(1).alias("k"))
    suffix = taken.select(F.regexp_extract("name", r"(?s)^(.*)-([1-9]\d*)$", 1).alias(base), F.try_to_number(F.regexp_extract("name", r"(?s)^(.*)-([1-9]\d*)$", 2), F.lit("999999999")).cast("int").alias("k")).where("k >= 2")
    used = plain.unionByName(suffix).join(bases, base, "left_semi").distinct().groupBy(base).agg(F.array_sort(F.collect_list("k")).alias("used"))
    met = numbered.join(used, base, "left").withColumn("used", F.coalesce("used", F.array().cast("array<int>")))
    free = F.aggregate("used", F.col("_n"), lambda n, k: F.when(k <= n, n + 1).otherwise(n))
    return met.withColumn("_k", free).withColumn("name", F.when(F.col("_k") == 1, F.col(base)).otherwise(F.concat(base, F.lit("-"), F.col("_k").cast("string")))).drop("_n", "_k", "used")
