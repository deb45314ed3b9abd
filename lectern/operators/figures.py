"""Page text, figure boxes and sections of PDF pages, from what a PDF reader gives.

No PDF library is needed or used: a reader supplies, for each page, the text
items, the coordinates of drawn images and the rendering's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clamped, image_marker, let, ordinal_id, trimmed

# A figure's most area or sides, least pixels, most aspect, and the overlap of copies.
LARGE, LEAST_WIDTH, LEAST_HEIGHT, ASPECT, SAME, PAD = 0.8, 96, 64, 14, 0.9, 2
BOX = "array<struct<left:double,top:double,right:double,bottom:double>>"


def page_text(items: Column) -> Column:
    """Text of an array of (str, eol): a line end or a space after each, runs of blanks collapsed."""
    joined = F.array_join(F.transform(F.filter(items, lambda x: x["str"].isNotNull()), lambda x: F.concat(x["str"], F.when(F.coalesce(x["eol"], F.lit(False)), "\n").otherwise(" "))), "")
    return trimmed(F.regexp_replace(F.regexp_replace(joined, "[ \t]+\n", "\n"), "[ \t]{2,}", " "))


def boxes(coordinates: Column) -> Column:
    """Bounding boxes of parallelograms, given by three corners in six numbers each; what is not finite or empty goes."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))

    def box(c):
        n = [F.get(c, F.lit(k)) for k in range(6)]
        x = [n[0], n[2], n[4], n[2] + n[4] - n[0]]
        y = [n[1], n[3], n[5], n[3] + n[5] - n[1]]
        edges = [clamped(f(*v), 0.0, 1.0).alias(k) for k, f, v in (("left", F.least, x), ("top", F.least, y), ("right", F.greatest, x), ("bottom", F.greatest, y))]
        return F.when(F.forall(c, finite), F.struct(*edges))

    def made(numbers):
        many = F.floor(F.size(numbers) / 6).cast("int")
        sixes = F.transform(F.sequence(F.lit(0), many - 1), lambda i: F.slice(numbers, i * 6 + 1, F.lit(6)))
        return F.when(many > 0, F.transform(sixes, box)).otherwise(F.array().cast(BOX))

    # The numbers are computed once, as a variable: spelt out in each place that uses one, they were computed some hundred times a box.
    found = F.coalesce(let(coordinates, made), F.array().cast(BOX))
    return F.filter(found, lambda b: b.isNotNull() & (b["right"] > b["left"]) & (b["bottom"] > b["top"]))


def area(b: Column) -> Column:
    return (b["right"] - b["left"]) * (b["bottom"] - b["top"])


def overlap(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes."""
    side = lambda low, high: F.greatest(F.lit(0.0), F.least(a[high], b[high]) - F.greatest(a[low], b[low]))
    both = side("left", "right") * side("top", "bottom")
    union = area(a) + area(b) - both
    return both / F.when(union == 0, 1.0).otherwise(union)


def distinct_figures(found: Column, width: Column, height: Column) -> Column:
    """The boxes that may be figures of a page rendered at ``width`` by ``height``: neither the page itself, nor small, narrow, or a copy of one kept before."""

    def step(kept, b):
        w, h = b["right"] - b["left"], b["bottom"] - b["top"]
        ok = (area(b) < LARGE) & ~((w >= LARGE) & (h >= LARGE)) & (w * width >= LEAST_WIDTH) & (h * height >= LEAST_HEIGHT)
        ok = ok & (F.greatest(w / h, h / w) <= ASPECT) & ~F.exists(kept, lambda a: overlap(a, b) >= SAME)
        return F.when(ok, F.array_append(kept, b)).otherwise(kept)

    return F.aggregate(found, F.array().cast(BOX), step)


def crops(figures: Column, width: Column, height: Column) -> Column:
    """Pixel boxes (left, top, right, bottom) with two pixels around, within the page; empty ones are null."""

    def crop(b):
        low = lambda edge, size: F.greatest(F.lit(0), F.floor(b[edge] * size) - PAD).cast("int")
        high = lambda edge, size: F.least(size, F.ceil(b[edge] * size) + PAD).cast("int")
        left, top, right, bottom = low("left", width), low("top", height), high("right", width), high("bottom", height)
        return F.when((right > left) & (bottom > top), F.struct(left.alias("left"), top.alias("top"), right.alias("right"), bottom.alias("bottom")))

    return F.transform(figures, crop)


def page_section(number: Column, pages: Column, text: Column, ids: Column, figures: Column) -> Column:
    """A page's content: its text, or that it has none, and its figures (ids and boxes, side by side)."""
    per = lambda x: F.concat(F.floor(x * 100 + 0.5).cast("long").cast("string"), F.lit("%"))

    def line(z):
        b = z["figures"]
        front, back = image_marker("|").split("|")
        where = F.concat(F.lit(", horizontal "), per(b["left"]), F.lit("-"), per(b["right"]), F.lit(", vertical "), per(b["top"]), F.lit("-"), per(b["bottom"]), F.lit(")"))
        return F.concat(F.lit("- " + front), z["ids"], F.lit(back + " (page "), number.cast("string"), where)

    listed = F.array_join(F.transform(F.arrays_zip(ids.alias("ids"), figures.alias("figures")), line), "\n")
    body = F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.lit("Text layer of the page:\n"), text)).otherwise("The page has no text layer that can be used; read the attached image of the page.")
    return F.concat(
        F.format_string("PDF page %d of %d", number, pages),
        F.lit("\n\n"),
        body,
        F.when(F.size(ids) > 0, F.concat(F.lit("\n\nFigures of this page that may be used:\n"), listed)).otherwise(""),
    )


def pdf_sections(pages: DataFrame, include_images: bool = True) -> DataFrame:
    """doc_id, ordinal, id, label, content, attachments, asset_ids, crops of (doc_id, page, items, coordinates, width, height).

    Pages count from 1; figures are numbered through the document.  A figure
    whose crop is empty has neither an id nor a box.
    """
    w = Window.partitionBy("doc_id")
    found = distinct_figures(boxes(F.col("coordinates")), F.col("width"), F.col("height")) if include_images else F.array().cast(BOX)
    rows = pages.withColumn("figures", found)
    cut = crops(F.col("figures"), F.col("width"), F.col("height"))
    rows = rows.withColumn("both", F.filter(F.arrays_zip(F.col("figures").alias("box"), cut.alias("crop")), lambda z: z["crop"].isNotNull()))
    rows = rows.withColumns({"figures": F.col("both.box"), "crops": F.col("both.crop"), "pages": F.count("*").over(w)})
    before = F.coalesce(F.sum(F.size("figures")).over(w.orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("before", before)
    rows = rows.withColumn("asset_ids", F.transform("figures", lambda b, k: ordinal_id("pdf-image", F.col("before") + k + 1)))
    content = page_section(F.col("page"), F.col("pages"), page_text(F.col("items")), F.col("asset_ids"), F.col("figures"))
    label = F.concat(F.lit("PDF page "), F.col("page").cast("string"))
    image = F.format_string("page-%04d.png", F.col("page"))
    return rows.select("doc_id", (F.col("page") - 1).cast("long").alias("ordinal"), ordinal_id("pdf-page", F.col("page"), 4).alias("id"), label.alias("label"), content.alias("content"), F.array(image).alias("attachments"), "asset_ids", "crops")
