"""Benchmark decontamination by shingles that an item cannot do without.

A document is contaminated by an item if one of its windows of about the
item's size holds 80 % of the item's weighted five-word shingles.

1. Of an item's shingles, ordered by the number of items that hold them, as
   many as weigh more than 20 % are its keys.  A window that holds none of them
   cannot reach 80 %, so documents without a key of an item are not compared
   with it; no other is left out.
2. Windows begin at each of the item's shingles in such a document: any window
   can be moved to one without losing a shingle.  Their weights are exact: a
   shingle that the item holds w times counts unless its w-th occurrence back
   lies in the window too.  A window has the item's size and a margin for
   foreign words.

Built-in functions only.  The benchmark side is broadcast only after its rows
are counted; beyond the bound the joins shuffle.

Cases: null or empty texts and items have no windows.  Items of fewer than
five words are one shingle.  Repeated items are one.  Repeated rows of a
doc_id are one document; rows with a null doc_id are judged and kept or
dropped by their text alone.  Other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_side

WIDTH, PERCENT = 5, 80
#: A window is longer than the item by this share, and on either side by this share of that (two words at least).
SLACK, MARGIN = 0.05, 0.2


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(w: str, width: int = WIDTH) -> Column:
    """Hashes of the shingles of the words' column ``w``, in order; fewer words than ``width`` are one."""
    n = F.greatest(F.size(w) - width + 1, F.lit(1))
    made = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))
    return F.when(F.size(w) > 0, made).otherwise(F.array().cast("array<long>"))


def keys(bench: DataFrame, percent: int) -> DataFrame:
    """item_id, h: of each (item_id, s), shingles without which less than ``percent`` of its weight is left, rarest first."""
    each = bench.select("item_id", F.size("s").alias("total"), F.explode("s").alias("h")).groupBy("item_id", "total", "h").agg(F.count("*").alias("weight"))
    held = each.groupBy("h").agg(F.count("*").alias("items"))
    order = Window.partitionBy("item_id").orderBy("items", "h").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("weight").over(order), F.lit(0))
    # The first keys whose loss leaves too little.
    return each.join(held, "h").withColumn("before", before).where(100 * (F.col("total") - F.col("before")) >= percent * F.col("total")).select("item_id", "h")


def leaks(docs: DataFrame, items: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, item_id, similarity (of the best window): documents that hold an item."""
    bench = items.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), words(F.col("text")).alias("w")).where("size(w) > 0")
    bench = bench.groupBy("w").agg(F.min("item_id").alias("item_id")).withColumn("s", shingles("w", width)).withColumn("n", F.size("w"))
    bench = materialize(bench, "items")
    n_items = bench.count()
    known = materialize(keys(bench, percent), "item-keys")
    n_known = known.count()
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text")).alias("w")).where("size(w) > 0")
    texts = texts.withColumn("d", F.xxhash64("w"))
    at = texts.select("doc_id", "d", F.explode(shingles("w", width)).alias("h")).join(small_side(known, n_known), "h")
    at = materialize(at.select("doc_id", "d", "item_id").distinct(), "candidates")
    # Only documents with a candidate are split into words again.
    near = docs.join(at.select(F.col("doc_id").alias("_near")).distinct(), F.col("doc_id").cast("long").eqNullSafe(F.col("_near")), "left_semi")
    near = near.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text")).alias("w")).withColumn("d", F.xxhash64("w"))
    held = near.dropDuplicates(["doc_id", "d"]).select("doc_id", "d", F.posexplode(shingles("w", width)).alias("p", "h"))
    weights = materialize(bench.select("item_id", "n", F.size("s").alias("total"), F.explode("s").alias("h")).groupBy("item_id", "n", "total", "h").agg(F.count("*").cast("int").alias("weight")), "weights")
    n_weights = weights.count()
    held = materialize(held.join(small_side(weights.select("h").distinct(), n_weights), "h", "left_semi"), "held")
    pair = at.select(F.col("doc_id").alias("_c_id"), F.col("d").alias("_c_d"), "item_id")
    hits = held.join(pair, F.col("doc_id").eqNullSafe(F.col("_c_id")) & (F.col("d") == F.col("_c_d"))).select("doc_id", "d", "item_id", "p", "h").join(small_side(weights, n_weights), ["item_id", "h"])
    # back: where the occurrence lies from which on this one is one too many.
    group = ["doc_id", "d", "item_id", "n", "total"]
    hits = hits.groupBy(*group, "h", "weight").agg(F.sort_array(F.collect_list("p")).alias("all"))
    hits = hits.select(*group, F.explode(F.transform("all", lambda p, k: F.struct(p.alias("p"), F.when(k >= F.col("weight"), F.get("all", k - F.col("weight"))).otherwise(-1).alias("back")))).alias("hit"))
    hits = hits.groupBy(*group).agg(F.sort_array(F.collect_list("hit")).alias("hits")).where(100 * F.size("hits") >= percent * F.col("total"))
    size = F.ceil(F.col("n") * (1 + SLACK)).cast("int")
    hits = hits.withColumn("span", F.greatest(size + 2 * F.greatest(F.lit(2), F.ceil(size * MARGIN).cast("int")) - width + 1, F.lit(1)))
    weight = lambda x, k: F.size(F.filter(F.slice("hits", k + 1, F.col("span")), lambda y: (y["p"] < x["p"] + F.col("span")) & (y["back"] < x["p"])))
    found = hits.withColumn("common", F.array_max(F.transform("hits", weight))).where(100 * F.col("common") >= percent * F.col("total"))
    found = found.withColumn("similarity", F.col("common") / F.col("total"))
    return found.groupBy("doc_id", "d", "item_id").agg(F.max("similarity").alias("similarity"))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item."""
    gone = leaks(docs, items).select(F.col("doc_id").alias("_g_id"), F.col("d").alias("_g_d")).distinct()
    keyed = docs.withColumn("_d", F.xxhash64(words(F.col("text"))))
    return keyed.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col("_g_id")) & (F.col("_d") == F.col("_g_d")), "left_anti").drop("_d")
