"""Next-fit packing of ordered rows under several limits, without a pass row by row.

A chunk that begins at row s ends before the first row with which one of its
sums would pass a limit, or after s where s alone does.  So every row has a next
chunk's beginning, whether or not a chunk begins there, and the chunks of a
document are the beginnings met from its first row on:

1. Documents that fit one chunk are told by their sums and done.  Those of at
   most ROWS rows are one array each, folded in order.  For the others:
2. Sums before each row: within blocks of ORDINALS ordinals, then of blocks.
3. Rows fall into cells of a joint load.  One chunk's load is at most a cell's
   width, so that the row that breaks it lies in its cell or the next one.  In a
   cell, sums and the thresholds they must pass are sorted together, and a
   running minimum gives each threshold the first row beyond it.
4. Pointer doubling: with each round the distance of the jumps and the number of
   known beginnings double, so K chunks take log2(K) joins.

Rows of a document beyond ROWS are spread over blocks and cells; no task holds
such a document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import few, staged

#: Ordinals in a block of running sums; rows of a document that are folded as one array.
ORDINALS, ROWS = 1024, 4096


def numbered_sums(rows: DataFrame, names: list[str]) -> DataFrame:
    """Adds idx (from 0 in a document) and, for each name, before_<name>: the sum of the rows before."""
    block = F.floor(F.col("ordinal") / ORDINALS)
    keyed = rows.withColumn("block", F.coalesce(block, F.lit(-1)))
    order = Window.partitionBy("doc", "block").orderBy("ordinal", "part", "copy")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = keyed.withColumns({"idx": F.row_number().over(order).cast("long") - 1} | {f"before_{n}": F.sum(n).over(running) - F.col(n) for n in names})
    blocks = keyed.groupBy("doc", "block").agg(F.count("*").alias("_idx"), *[F.sum(n).alias(f"_{n}") for n in names])
    past = Window.partitionBy("doc").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("doc", "block", *[F.coalesce(F.sum(f"_{n}").over(past), F.lit(0)).alias(f"_{n}") for n in ("idx", *names)])
    both = inner.join(blocks, ["doc", "block"])
    return both.withColumns({"idx": F.col("idx") + F.col("_idx")} | {f"before_{n}": F.col(f"before_{n}") + F.col(f"_{n}") for n in names}).drop("block", "_idx", *[f"_{n}" for n in names])


def next_beginnings(rows: DataFrame, limits: dict[str, int]) -> DataFrame:
    """doc, idx, nxt: where a chunk that begins at idx is followed by the next; rows without one are left out."""
    events = []
    for name, limit in limits.items():
        before, after = F.col(f"before_{name}"), F.col(f"before_{name}") + F.col(name)
        kind = F.lit(name).alias("name")
        events += [F.struct("cell", kind, (before + limit).alias("value"), F.lit(0).alias("at"), "idx")]
        events += [F.struct(cell.alias("cell"), kind, after.alias("value"), F.lit(1).alias("at"), "idx") for cell in (F.col("cell"), F.col("cell") - 1)]
    each = rows.select("doc", F.explode(F.array(*events)).alias("e")).select("doc", "e.*")
    # Sums beyond a threshold come before it, equal ones after it.
    order = Window.partitionBy("doc", "cell", "name").orderBy(F.desc("value"), "at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    broken = each.withColumn("nxt", F.min(F.when(F.col("at") == 1, F.col("idx"))).over(order)).where("at = 0 and nxt is not null")
    found = broken.groupBy("doc", "idx").agg(F.greatest(F.min("nxt"), F.col("idx") + 1).alias("nxt"))
    last = rows.groupBy("doc").agg(F.max("idx").alias("last"))
    return found.join(last, "doc").where(F.col("nxt") <= F.col("last")).select("doc", "idx", "nxt")


def beginnings(jumps: DataFrame, docs: DataFrame) -> DataFrame:
    """doc, idx, chunk: the rows at which a document's chunks begin."""
    met, step = docs.select("doc", F.lit(0).cast("long").alias("idx"), F.lit(0).cast("long").alias("chunk")), 1
    while not jumps.isEmpty():
        more = met.join(jumps, ["doc", "idx"]).select("doc", F.col("nxt").alias("idx"), (F.col("chunk") + step).alias("chunk"))
        met = staged(met.unionByName(more), "beginnings")
        onward = jumps.select("doc", F.col("idx").alias("nxt"), F.col("nxt").alias("then"))
        jumps, step = staged(jumps.join(onward, ["doc", "nxt"]).select("doc", "idx", F.col("then").alias("nxt")), "jumps"), 2 * step
    return met


def next_fit(rows: DataFrame, limits: dict[str, int]) -> DataFrame:
    """``rows`` of (doc, ordinal, part, copy, and a size for each limit) with ``chunk``, from 0 in each document."""
    most = max(limits.values())
    scale = {n: -(-most // limit) for n, limit in limits.items()}
    width = sum(scale[n] * limit for n, limit in limits.items())
    # A row without any size counts as one, so that a cell is bounded; cells then are wider by their rows at most.
    load = F.greatest(F.lit(1).cast("long"), sum((F.col(n) * k for n, k in scale.items()), F.lit(0).cast("long")))
    summed = numbered_sums(rows.withColumn("load", load), [*limits, "load"])
    summed = staged(summed.withColumn("cell", F.floor(F.col("before_load") / width)), "sums")
    jumps = staged(next_beginnings(summed, limits), "jumps")
    met = beginnings(jumps, summed.select("doc").distinct())
    spans = met.join(jumps, ["doc", "idx"], "left").join(summed.select("doc", "idx", "cell"), ["doc", "idx"])
    spans = spans.select("doc", F.explode(F.array(F.col("cell"), F.col("cell") + 1)).alias("cell"), F.col("idx").alias("first"), "nxt", "chunk")
    inside = (F.col("idx") >= F.col("first")) & (F.col("nxt").isNull() | (F.col("idx") < F.col("nxt")))
    found = summed.join(spans, ["doc", "cell"]).where(inside)
    return found.select(*rows.columns, "chunk")


def folded(rows: DataFrame, limits: dict[str, int]) -> DataFrame:
    """As ``next_fit``, for documents whose rows fit an array."""
    fields = [c for c in rows.columns if c != "doc"]
    held = rows.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("rows"))
    none = F.struct(F.lit(0).cast("long").alias("at"), *[F.lit(0).cast("long").alias(n) for n in limits], F.array().cast("array<long>").alias("starts"))

    def step(state, x):
        over = state["at"] == 0
        for n, limit in limits.items():
            over = over | (state[n] + x[n] > limit)
        sums = [F.when(over, x[n]).otherwise(state[n] + x[n]).alias(n) for n in limits]
        return F.struct((state["at"] + 1).alias("at"), *sums, F.when(over, F.concat(state["starts"], F.array(state["at"]))).otherwise(state["starts"]).alias("starts"))

    starts = F.aggregate("rows", none, step, lambda s: s["starts"])
    each = held.withColumn("starts", starts).select("doc", "starts", F.posexplode("rows").alias("idx", "r"))
    return each.select("doc", *[F.col(f"r.{c}").alias(c) for c in fields], (F.size(F.filter("starts", lambda s: s <= F.col("idx"))) - 1).cast("long").alias("chunk"))


def packed(parts: DataFrame, limits: dict[str, int]) -> DataFrame:
    """``parts`` (doc_id, ordinal, part, a size for each limit, any others) with ``chunk``.

    Only keys and sizes are packed; other columns meet the result by key, and
    only in documents of several chunks.  Null ids are one document; null sizes
    are 0; repeated rows of a part are parts of their own.
    """
    keys = ["doc_id", "ordinal", "part"]
    given = parts.select(*keys, *[F.coalesce(F.col(n), F.lit(0)).cast("long").alias(n) for n in limits])
    sizes = staged(given, "sizes")
    if set(parts.columns) == set(given.columns):
        parts = sizes.select(*[F.col(c).cast(parts.schema[c].dataType) for c in parts.columns])
    over = sizes.groupBy("doc_id").agg(F.count("*").alias("rows"), *[F.sum(n).alias(n) for n in limits])
    over = over.where(" OR ".join(f"{n} > {limit}" for n, limit in limits.items()))
    long = staged(over.select(F.struct("doc_id").alias("doc"), "rows"), "long")
    docs, most = long.agg(F.count("*"), F.max("rows")).first()
    if not docs:
        return parts.withColumn("chunk", F.lit(0).cast("long"))
    bounded, doc = few(long.select("doc")), F.struct("doc_id")
    copy = F.row_number().over(Window.partitionBy("doc", "ordinal", "part").orderBy(*limits))
    copied = lambda rows, these: rows.withColumn("doc", doc).join(these, "doc", "left_semi").withColumn("copy", copy)
    chunk = folded(copied(sizes, few(long.where(F.col("rows") <= ROWS).select("doc"))).drop("doc_id"), limits)
    if most > ROWS:
        chunk = chunk.unionByName(next_fit(copied(sizes, few(long.where(F.col("rows") > ROWS).select("doc"))).drop("doc_id"), limits))
    chunk = chunk.select("doc", *[F.col(k).alias(f"_{k}") for k in ("ordinal", "part", "copy")], "chunk")
    chunk = chunk.withColumnRenamed("doc", "_doc")
    same = (F.col("doc") == F.col("_doc")) & F.col("ordinal").eqNullSafe(F.col("_ordinal")) & F.col("part").eqNullSafe(F.col("_part")) & (F.col("copy") == F.col("_copy"))
    rest = copied(parts, bounded).join(chunk, same).select(*parts.columns, "chunk")
    return parts.withColumn("doc", doc).join(bounded, "doc", "left_anti").select(*parts.columns, F.lit(0).cast("long").alias("chunk")).unionByName(rest)
