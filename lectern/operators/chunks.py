"""Splitting, packing and assembly of sections into chunks of bounded size.

Sizes are UTF-16 units.  Cases: sections without content have no parts but
those of their attachments; null arrays are empty; repeated rows of a section
are parts of their own; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ATTACHMENT_LIMIT, MARKUP_LIMIT, VISIBLE_LIMIT, excess_budget, let, renderable, utf16_length, visible_length
from .nextfit import packed


def cut_points(text: str, budget: int) -> list[str]:
    """Lossless parts of about ``budget`` UTF-16 units, cut at the last paragraph, closing tag or line end in the last two fifths.

    A hard cut that would part a surrogate pair is made before it.
    """
    wide = not text.isascii() and max(text) > "\uffff"
    if wide:
        raw = text.encode("utf-16-le", "surrogatepass")
        text = "".join(chr(raw[k] | raw[k + 1] << 8) for k in range(0, len(raw), 2))
    parts, at = [], 0
    while at < len(text):
        end = hard = min(len(text), at + budget)
        if hard < len(text):
            least = at + budget * 3 // 5
            # A mark may begin at the hard end itself.
            best = max(text.rfind(mark, least, hard + len(mark)) for mark in ("\n\n", "</", "\n"))
            if best >= least:
                if text.startswith("\n\n", best):
                    end = best + 2
                elif text.startswith("</", best):
                    close = text.find(">", best + 2, hard)
                    end = close + 1 if close >= 0 else best
                else:
                    end = best + 1
            if end < len(text) and "\ud800" <= text[end - 1] <= "\udbff" and "\udc00" <= text[end] <= "\udfff":
                end -= 1
        parts.append(text[at:end])
        at = end
    if wide:
        return [p.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "surrogatepass") for p in parts]
    return parts


def with_pieces(sections: DataFrame) -> DataFrame:
    """Adds p, the parts of ``content``; only the text of sections over their budget goes through Python, one by one, and only the places of its cuts come back."""

    @F.arrow_udf("array<int>")
    def ends(texts: pa.Array, budgets: pa.Array) -> pa.Array:
        def found(text: pa.Scalar, budget: pa.Scalar) -> list[int] | None:
            b = budget.as_py()
            return b and list(accumulate(len(p.encode("utf-8", "surrogatepass")) for p in cut_points(text.as_py(), b)))

        return pa.array(map(found, texts, budgets), pa.list_(pa.int32()))

    content, places, budget = F.col("content"), F.col("_places"), F.col("_budget")
    # Generators keep the function apart from what goes before and after: it cannot run inside of an aggregate or a lambda, and would be run again for each use.
    rows = sections.select(*sections.columns, F.explode_outer(F.array(excess_budget(content))).alias("_budget"))
    rows = rows.withColumn("_ends", ends(F.when(budget.isNotNull(), content), budget))
    rows = rows.select(*sections.columns, F.explode_outer(F.array("_ends")).alias("_places"))
    # Cut by bytes, for which nothing before the place is read.
    part = lambda raw: F.transform(places, lambda e, k: let(F.coalesce(F.get(places, k - 1), F.lit(0)), lambda at: F.substring(raw, at + 1, e - at)).cast("string"))
    return rows.withColumn("p", F.when(places.isNull(), F.array(content)).otherwise(let(content.cast("binary"), part))).drop("_places")


def split_sections(sections: DataFrame) -> DataFrame:
    """(doc_id, ordinal, content) to (doc_id, ordinal, part, parts, content): sections over their budget are split, parts without content dropped."""
    rows = with_pieces(sections.where(F.col("content").isNotNull()).select("doc_id", "ordinal", "content"))
    # The outer form: for the other the optimizer adds a filter that computes the parts again.
    rows = rows.select("doc_id", "ordinal", F.size("p").alias("parts"), F.posexplode_outer("p").alias("at", "content"))
    return rows.select("doc_id", "ordinal", (F.col("at") + 1).alias("part"), "parts", "content").where(renderable(F.col("content")))


def groups(values: Column, size: int) -> Column:
    """An array cut into runs of ``size``."""
    starts = F.sequence(F.lit(0), F.size(values) - 1, F.lit(size))
    return F.when(F.size(values) > 0, F.transform(starts, lambda i: F.slice(values, i + 1, F.lit(size)))).otherwise(F.array().cast("array<array<string>>"))


def known_assets(sections: DataFrame, assets: DataFrame) -> DataFrame:
    """doc_id, ordinal, known: a section's assets (id, path) in its order; ids that no asset has are dropped."""
    named = sections.select("doc_id", "ordinal", F.posexplode("asset_ids").alias("at", "id"))
    met = named.join(assets.select("doc_id", "id", "path"), ["doc_id", "id"])
    rows = F.array_sort(F.collect_list(F.struct("at", "id", "path")))
    return met.groupBy("doc_id", "ordinal").agg(F.transform(rows, lambda x: F.struct(x["id"].alias("id"), x["path"].alias("path"))).alias("known"))


def normalise_sections(sections: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    """Parts of (doc_id, ordinal, id, label, content, attachments, asset_ids), with part, parts, and the assets of their attachments.

    Part i has the i-th piece of text and the i-th group of attachments; parts
    without either go, and the others keep their numbers.
    """
    rows = sections.withColumns({"content": F.coalesce("content", F.lit("")), "attachments": F.array_distinct(F.coalesce("attachments", F.array().cast("array<string>"))), "asset_ids": F.coalesce("asset_ids", F.array().cast("array<string>"))})
    if assets is None:
        rows = rows.withColumn("known", F.transform(F.array().cast("array<string>"), lambda x: F.struct(x.alias("id"), x.alias("path"))))
    else:
        rows = rows.join(known_assets(rows, assets), ["doc_id", "ordinal"], "left")
    rows = with_pieces(rows).withColumn("g", groups(F.col("attachments"), ATTACHMENT_LIMIT))
    rows = rows.withColumn("parts", F.greatest(F.lit(1), F.size("p"), F.size("g")))
    rows = rows.select("doc_id", "ordinal", "id", "label", "p", "g", "known", "parts", F.explode_outer(F.sequence(F.lit(1), F.col("parts"))).alias("part"))
    own, many = F.col("part") - 1, F.col("parts") > 1
    rows = rows.select(
        "doc_id",
        "ordinal",
        "part",
        "parts",
        F.when(many, F.concat("id", F.lit("-part-"), F.col("part").cast("string"))).otherwise(F.col("id")).alias("id"),
        F.when(many, F.format_string("%s (part %d of %d)", "label", "part", "parts")).otherwise(F.col("label")).alias("label"),
        F.coalesce(F.get("p", own), F.lit("")).alias("content"),
        F.coalesce(F.get("g", own), F.array().cast("array<string>")).alias("attachments"),
        "known",
    )
    rows = rows.withColumn("asset_ids", F.coalesce(F.transform(F.filter("known", lambda x: F.array_contains("attachments", x["path"])), lambda x: x["id"]), F.array().cast("array<string>"))).drop("known")
    return rows.where((F.size("attachments") > 0) | renderable(F.col("content")))


def sized(parts: DataFrame) -> DataFrame:
    attachments = F.size("attachments") if "attachments" in parts.columns else F.lit(0)
    sizes = F.struct(utf16_length(F.col("content")).alias("markup"), visible_length(F.col("content")).alias("visible"), attachments.alias("attachments"))
    # The generator keeps a later filter on a size from computing it again.
    return parts.select("doc_id", "ordinal", "part", F.explode_outer(F.array(sizes)).alias("s")).select("doc_id", "ordinal", "part", "s.*")


def pack_sections(parts: DataFrame, markup: str = "markup", visible: str = "visible", attachments: str = "attachments") -> DataFrame:
    """Adds chunk (from 0) to rows with doc_id, ordinal, part and three sizes: next fit under three limits, in order of a document.

    A part over a limit is a chunk of its own.  See ``nextfit``: no row passes
    through Python, and a long document is spread over tasks.
    """
    return packed(parts, {markup: MARKUP_LIMIT, visible: VISIBLE_LIMIT, attachments: ATTACHMENT_LIMIT})


def assemble_chunks(parts: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    """doc_id, chunk, total, sections (id, label, content, attachments, asset_ids), attachments, assets (id, mime, filename, path, alt, source_url).

    parts: rows of ``normalise_sections``.  A chunk's assets are those that its
    sections name, in the document's order.
    """
    sizes = {"_m": utf16_length(F.col("content")), "_v": visible_length(F.col("content")), "_a": F.size("attachments")}
    packed = pack_sections(parts.withColumns(sizes), "_m", "_v", "_a")
    section = F.struct("ordinal", "part", "id", "label", "content", "attachments", "asset_ids")
    # One exchange by document serves both the grouping and the count.
    rows = packed.repartition("doc_id").groupBy("doc_id", "chunk").agg(F.array_sort(F.collect_list(section)).alias("s"))
    rows = rows.withColumn("total", F.count("*").over(Window.partitionBy("doc_id")))
    rows = rows.withColumn("sections", F.transform("s", lambda x: F.struct(*[x[c].alias(c) for c in ("id", "label", "content", "attachments", "asset_ids")])))
    rows = rows.withColumn("attachments", F.array_distinct(F.flatten("sections.attachments"))).drop("s")
    if assets is None:
        return rows
    fields = ["id", "mime", "filename", "path", "alt", "source_url"]
    named = rows.select("doc_id", "chunk", F.explode(F.array_distinct(F.flatten("sections.asset_ids"))).alias("id"))
    met = named.join(assets.select("doc_id", F.col("ordinal").alias("at"), *fields), ["doc_id", "id"]).groupBy("doc_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("at", *fields))).alias("a"))
    met = met.select("doc_id", "chunk", F.transform("a", lambda x: F.struct(*[x[c].alias(c) for c in fields])).alias("assets"))
    return rows.join(met, ["doc_id", "chunk"], "left")
