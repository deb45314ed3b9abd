"""Attachments of chunks as joins: the first section that holds each, and the asset that it is."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .prompts import normal_path


def inventory(sections: DataFrame, assets: DataFrame) -> DataFrame:
    """doc_id, chunk, place, path, label, asset_id of sections (doc_id, chunk, ordinal, label, attachments) and assets (doc_id, ordinal, id, path).

    Each path once in a chunk, numbered from 1 by where it first stands; label is
    that section's.  A path's asset is the first of its document whose path is
    the same without ``.`` and ``..``; null if there is none.  The joins' keys
    are a document's paths, so a document with many attachments is spread.
    Null paths and sections without attachments have no rows.
    """
    each = sections.select("doc_id", "chunk", "ordinal", "label", F.posexplode("attachments").alias("at", "path")).where("path is not null")
    first = each.groupBy("doc_id", "chunk", "path").agg(F.min(F.struct("ordinal", "at", "label")).alias("f"))
    place = F.row_number().over(Window.partitionBy("doc_id", "chunk").orderBy("f.ordinal", "f.at"))
    rows = first.select("doc_id", "chunk", place.alias("place"), "path", F.col("f.label").alias("label"), normal_path(F.col("path")).alias("_path"))
    known = assets.where("path is not null").groupBy(F.col("doc_id").alias("_doc"), normal_path(F.col("path")).alias("_known")).agg(F.min_by("id", "ordinal").alias("asset_id"))
    met = rows.join(known, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_path") == F.col("_known")), "left")
    return met.select("doc_id", "chunk", "place", "path", "label", "asset_id")


def reattached(sections: DataFrame, moved: DataFrame) -> DataFrame:
    """``sections`` (doc_id, ordinal, attachments, ...) with attachments re-pointed by (doc_id, path, new_path); others stay, in their places."""
    each = sections.select("doc_id", "ordinal", F.posexplode("attachments").alias("at", "path"))
    target = moved.groupBy(F.col("doc_id").alias("_doc"), F.col("path").alias("_path")).agg(F.min("new_path").alias("new_path"))
    met = each.join(target, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("path") == F.col("_path")), "left")
    held = met.groupBy(F.col("doc_id").alias("_doc"), F.col("ordinal").alias("_ordinal")).agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("new_path", "path").alias("p")))).alias("h"))
    both = sections.join(held, F.col("doc_id").eqNullSafe(F.col("_doc")) & F.col("ordinal").eqNullSafe(F.col("_ordinal")), "left")
    again = F.when(F.col("h").isNotNull(), F.transform("h", lambda x: x["p"])).otherwise(F.col("attachments"))
    return both.select(*[again.alias(c) if c == "attachments" else c for c in sections.columns])
