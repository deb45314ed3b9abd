"""Distinct boxes of a page by a grid, for pages with many of them.

In order, a box is kept unless it overlaps one kept before by at least a share
of their union.  Boxes that overlap so much share their middle: only boxes in
the same or a neighbouring cell of a grid of their own size class are compared,
and each pair once.  What is kept then follows from the pairs in rounds: a box
without an earlier overlapping one that may stay, stays; those it overlaps go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import staged
from .figures import SAME, overlap

#: Boxes that overlap by SAME differ in each side's length by less than this factor, roundings included; classes are powers of it.
STEP = 1.02 / SAME
KEY = ["doc_id", "page"]


def candidate_pairs(boxes: DataFrame) -> DataFrame:
    """doc_id, page, at, earlier: pairs of boxes (doc_id, page, at, box) with at least SAME of their union in common.

    Then the sides' ratios are within STEP, so their classes at most one apart,
    and the middles are closer than 1 - SAME of the longer side: less than a cell.
    """
    b = F.col("box")
    width, height = b["right"] - b["left"], b["bottom"] - b["top"]
    level = lambda side: F.floor(F.log(side) / F.log(F.lit(STEP))).cast("int")
    size = lambda n: F.pow(F.lit(STEP), n)
    cell = lambda low, high, n: F.floor((b[low] + b[high]) / 2 / size(n)).cast("long")
    near = lambda c, spread: F.array(*[c + k for k in spread])
    rows = boxes.withColumns({"w": level(width), "h": level(height)})
    mine = rows.select(*KEY, "at", "box", "w", "h", cell("left", "right", F.col("w")).alias("x"), cell("top", "bottom", F.col("h")).alias("y"))
    # The other's class is at most one away; its middle is put on that class's grid, and the cells around are looked at.
    theirs = rows.select(*KEY, F.col("at").alias("earlier"), F.col("box").alias("other"), F.explode(near(F.col("w"), (-1, 0, 1))).alias("w"), "h")
    theirs = theirs.select(*KEY, "earlier", "other", "w", F.explode(near(F.col("h"), (-1, 0, 1))).alias("h"))
    o = F.col("other")
    theirs = theirs.select(*KEY, "earlier", "other", "w", "h", F.floor((o["left"] + o["right"]) / 2 / size(F.col("w"))).cast("long").alias("x0"), F.floor((o["top"] + o["bottom"]) / 2 / size(F.col("h"))).cast("long").alias("y0"))
    theirs = theirs.select(*KEY, "earlier", "other", "w", "h", F.explode(near(F.col("x0"), (-1, 0, 1))).alias("x"), "y0")
    theirs = theirs.select(*KEY, "earlier", "other", "w", "h", "x", F.explode(near(F.col("y0"), (-1, 0, 1))).alias("y"))
    met = mine.join(theirs, [*KEY, "w", "h", "x", "y"]).where(F.col("earlier") < F.col("at"))
    return met.where(overlap(F.col("other"), F.col("box")) >= SAME).select(*KEY, "at", "earlier")


def distinct_boxes(boxes: DataFrame) -> DataFrame:
    """The rows of (doc_id, page, at, box) that are kept, in order of ``at`` (unique in a page).

    Equal boxes are one from the start, the first: the others always go.
    """
    rows = staged(boxes.groupBy(*KEY, "box").agg(F.min("at").alias("at")).select(*KEY, "at", "box"), "boxes")
    pairs = staged(candidate_pairs(rows), "pairs")
    gone = None
    while not pairs.isEmpty():
        # Free: without an earlier box that is still undecided or kept.
        free = pairs.select(*KEY, F.col("earlier").alias("at")).distinct().join(pairs.select(*KEY, "at"), [*KEY, "at"], "left_anti")
        free = staged(free, "free")
        lost = staged(pairs.join(free.withColumnRenamed("at", "earlier"), [*KEY, "earlier"], "left_semi").select(*KEY, "at").distinct(), "lost")
        gone = lost if gone is None else staged(gone.unionByName(lost), "gone")
        # Decided boxes, kept or gone, decide nothing any more.
        rest = pairs.join(lost, [*KEY, "at"], "left_anti").join(lost.withColumnRenamed("at", "earlier"), [*KEY, "earlier"], "left_anti")
        pairs = staged(rest.join(free.withColumnRenamed("at", "earlier"), [*KEY, "earlier"], "left_anti"), "pairs")
    return rows if gone is None else rows.join(gone, [*KEY, "at"], "left_anti")
