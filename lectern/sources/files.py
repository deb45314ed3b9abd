"""Sources of pages, images and PDFs as tables of files, and their sections.

Files come from Spark's ``binaryFile`` reader, so that any store it reads will
do; a file that cannot be used is a row with its error.
"""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.prompts import normal_path


def source_kinds(sources: DataFrame) -> DataFrame:
    """Adds kind to (sources: array of strings, is_directory): the first that fits of gallery, stdin, webpage, directory; null: look into the file."""
    one = F.get("sources", F.lit(0))
    kind = (
        F.when(F.size("sources") > 1, "image-gallery")
        .when(one == "-", "stdin")
        .when(T.public_url(one), "webpage")
        .when(F.coalesce("is_directory", F.lit(False)), "image-directory")
    )
    error = F.when(F.coalesce(F.size("sources"), F.lit(0)) <= 0, "no source was given")
    return sources.withColumns({"kind": F.when(error.isNull(), kind), "error": error})


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, name, extension, length, content, kind, mime, error of the files at ``path`` (a file, folder or pattern); Spark's reader gives no row for an empty file."""
    return inspected(spark.read.format("binaryFile").load(path))


def inspected(rows: DataFrame) -> DataFrame:
    """As ``files``, of rows with path and content."""
    extension = T.file_extension(F.col("path"))
    kind = T.source_kind(F.col("content"), extension)
    return rows.select(
        "path",
        T.file_name(F.col("path")).alias("name"),
        extension.alias("extension"),
        F.octet_length("content").cast("long").alias("length"),
        "content",
        F.when(F.octet_length("content") > 0, kind).alias("kind"),
        F.when(kind == "image", T.image_type(F.col("content"))).alias("mime"),
        T.kind_error(F.col("content"), extension).alias("error"),
    )


def html_pages(found: DataFrame) -> DataFrame:
    """page_id, url, html of the HTML files: the url is the file's own."""
    url = F.regexp_replace("path", "^file:/+", "file:///")
    return found.where("kind = 'html'").select(F.xxhash64("path").alias("page_id"), url.alias("url"), F.decode("content", "UTF-8").alias("html"))


def supported_images(found: DataFrame) -> DataFrame:
    """The files of a folder that a gallery takes: by extension, in natural order of their names."""
    return found.where(F.col("extension").isin(*T.IMAGE_EXTENSIONS))


def dimensions(content: bytes | None) -> tuple[int, int] | None:
    """(width, height) from the header of a PNG, JPEG, GIF or WEBP; null if it is broken."""
    b = content or b""
    try:
        if b[:8] == b"\x89PNG\r\n\x1a\n":
            return struct.unpack(">II", b[16:24])
        if b[:3] == b"GIF":
            return struct.unpack("<HH", b[6:10])
        if b[:4] == b"RIFF" and b[8:12] == b"WEBP":
            if b[12:16] == b"VP8X":
                return int.from_bytes(b[24:27], "little") + 1, int.from_bytes(b[27:30], "little") + 1
            if b[12:16] == b"VP8L":
                n = int.from_bytes(b[21:25], "little")
                return (n & 0x3FFF) + 1, (n >> 14 & 0x3FFF) + 1
            if b[12:16] == b"VP8 ":
                w, h = struct.unpack("<HH", b[26:30])
                return w & 0x3FFF, h & 0x3FFF
        if b[:2] == b"\xff\xd8":
            at = 2
            while at + 9 <= len(b):
                if b[at] != 0xFF:
                    return None
                kind = b[at + 1]
                if kind == 0xFF or 0xD0 <= kind <= 0xD8 or kind == 1:
                    at += 1 if kind == 0xFF else 2
                    continue
                if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                    h, w = struct.unpack(">HH", b[at + 5 : at + 9])
                    return w, h
                at += 2 + struct.unpack(">H", b[at + 2 : at + 4])[0]
    except struct.error:
        pass
    return None


def image_rows(found: DataFrame) -> DataFrame:
    """The image files with width and height; what is no image, or cannot be read, has an error."""
    @F.pandas_udf("struct<width: int, height: int>")
    def size(contents: pd.Series) -> pd.DataFrame:
        made = [dimensions(c) or (None, None) for c in contents]
        return pd.DataFrame(made, columns=["width", "height"]).astype("Int32")

    rows = found.withColumn("_s", size(F.when(F.col("kind") == "image", F.col("content"))))
    error = F.coalesce("error", F.when(F.col("kind") != "image", F.concat(F.lit("gallery entries must be images: "), "name")), F.when(F.col("_s.width").isNull(), F.concat(F.lit("could not decode image "), "name")))
    return rows.select("*", F.col("_s.width").alias("width"), F.col("_s.height").alias("height")).withColumn("error", error).drop("_s")


def gallery(images: DataFrame, doc: str, order: list, forced: bool = False) -> DataFrame:
    """doc, ordinal, id, label, content, attachments, kind, image_count, filename, mime, width, height: one section for each image of a doc."""
    w = Window.partitionBy(doc)
    rows = images.withColumns({"position": F.row_number().over(w.orderBy(*order)), "image_count": F.count("*").over(w)})
    shown = T.without_controls(F.col("name"))
    quoted = F.regexp_extract(F.to_json(F.struct(F.col("name").alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)
    many = F.lit(forced) | (F.col("image_count") > 1)
    attachment = F.concat(T.ordinal_id("image", F.col("position"), 4), T.extension_of(F.col("mime")))
    return rows.select(
        doc,
        (F.col("position") - 1).cast("long").alias("ordinal"),
        T.ordinal_id("image", F.col("position"), 4).alias("id"),
        F.format_string("Image %d of %d: %s", "position", "image_count", shown).alias("label"),
        F.format_string("Photographed page %d of %d. File name: %s. It has no text layer.", "position", "image_count", quoted).alias("content"),
        F.array(attachment).alias("attachments"),
        F.when(many, "image-gallery").otherwise("image").alias("kind"),
        F.col("image_count").cast("long").alias("image_count"),
        F.col("name").alias("filename"),
        F.when(many, "image/*").otherwise(F.col("mime")).alias("mime"),
        "width",
        "height",
    )


def stdin_page(spark: SparkSession, html: str) -> DataFrame:
    """One page without url, of a text read by the driver; blank is an error."""
    if not html.strip():
        raise ValueError("HTML input is empty")
    return spark.createDataFrame([(0, None, html)], "page_id long, url string, html string")


def pdf_files(found: DataFrame, title: Column | None = None) -> DataFrame:
    """path, name, content, title, error of files taken as PDFs."""
    return found.select("path", "name", "content", (title if title is not None else F.lit(None).cast("string")).alias("title"), T.pdf_error(F.col("content")).alias("error"))


def confined(path: Column, root: str) -> Column:
    """The normal form of a path if it lies below ``root``, else null."""
    base = root.rstrip("/")
    whole = normal_path(F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(base + "/"), path)))
    return F.when(whole.startswith(base + "/"), whole)


def write_editions(editions: DataFrame, path: str) -> None:
    """The content of each edition as one text file in a folder of its doc_id, by Spark's committer: a lost task leaves nothing half written.  An edition ends with one line end, which the writer adds."""
    rows = editions.where(F.col("content").isNotNull()).select("doc_id", F.regexp_replace("content", "\n\\z", "").alias("value"))
    rows.write.mode("overwrite").partitionBy("doc_id").option("lineSep", "\n").text(path)
