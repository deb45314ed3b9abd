"""Exact duplicates by recipes of content-defined chunks.

A text is cut into lines; lines of over LINE bytes also after sentence marks and
at the latest after SEGMENT characters.  A chunk ends at a line or piece whose
rolling hash, over its own hash and the one before, is divisible by DIVISOR, so
that an insertion moves no boundary beyond its neighbours.  A text's recipe is
the ordered list of its chunks' identifiers.

1. One pass over the texts makes recipes of chunk hashes.  A recipe whose
   fingerprint no other row has belongs to a text without copies: that text is
   not looked at again.
2. Only the chunks of the others are shuffled, each distinct one once for every
   task that met it, and compared by their bytes.  A hash with one text is that
   chunk's verified identifier; the chunks of a hash with several texts are
   numbered, and the documents that hold them carry these numbers as well.
3. Rows with equal verified recipes are equal texts; from here on only recipes
   move, some hundredths of the texts.

Built-in functions only.  Fingerprints that occur again are broadcast only
after their rows are counted; beyond the bound that join shuffles.

Cases: a null text counts as empty, and all empty texts are equal.  Only A-Z
are lower-cased.  Null doc_ids are smaller than any; of rows that repeat both
the largest doc_id and its text one stays.  An empty table gives no rows.
Other columns are ignored by ``equal_texts`` and kept by ``drop_copies``,
whatever their names.  Texts are read whole, however long.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_side

#: A line of more bytes is cut further, into pieces of so many characters at most; a chunk has DIVISOR lines or pieces on average.
LINE, SEGMENT, DIVISOR = 1024, 256, 8
#: Where a long line is cut: after a mark, or so many characters after the last cut.
PIECE_ENDS = f"(?s)(?:(?<=[.!?\u3002\uff01\uff1f])|(?<=\\G.{{{SEGMENT}}}))(?!\\z)"
CAPITALS = "".join(map(chr, range(65, 91)))


def folded(text: Column) -> Column:
    """A-Z lower-cased and nothing else."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, CAPITALS, CAPITALS.lower()))


def let(value: Column, use) -> Column:
    """use(value), with ``value`` computed once: as the variable of a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def segments(text: Column) -> Column:
    """Lines with their ends, long ones in pieces; joined they are the text."""
    short = lambda x: F.when(F.octet_length(x) <= LINE, F.array(x)).otherwise(F.split(x, PIECE_ENDS, -1))
    ended = lambda s: F.transform(s, lambda x, i: F.when(i < F.size(s) - 1, F.concat(x, F.lit("\n"))).otherwise(x))
    return F.flatten(F.transform(let(F.split(text, "\n", -1), ended), short))


def cut(text: Column, chunk_hash) -> Column:
    """struct(segments, ends, recipe): a text's segments, the last one of each chunk, and the chunks' hashes."""
    rolled = lambda v, i: F.get(v, i).bitwiseXOR(F.shiftleft(F.coalesce(F.get(v, i - 1), F.lit(0).cast("long")), 1))
    ends = lambda v: F.filter(F.sequence(F.lit(0), F.size(v) - 1), lambda i: (F.pmod(rolled(v, i), F.lit(DIVISOR)) == 0) | (i == F.size(v) - 1))
    recipe = lambda v, e: F.transform(e, lambda x, k: chunk_hash(piece(v, e, x, k)))
    by_ends = lambda s, v: let(ends(v), lambda e: F.struct(s.alias("segments"), e.alias("ends"), recipe(v, e).alias("recipe")))
    return let(segments(text), lambda s: let(F.transform(s, lambda x: F.xxhash64(x)), lambda v: by_ends(s, v)))


def piece(values: Column, ends: Column, end: Column, k: Column) -> Column:
    """The values of chunk k."""
    start = F.coalesce(F.get(ends, k - 1) + 1, F.lit(0))
    return F.slice(values, start + 1, end - start + 1)


def chunks_of(made: Column) -> Column:
    """Array of (pos, h, chunk)."""
    s, e, r = made["segments"], made["ends"], made["recipe"]
    return F.transform(e, lambda x, k: F.struct(k.alias("pos"), F.get(r, k).alias("h"), F.array_join(piece(s, e, x, k), "").alias("chunk")))


def numbered(again: DataFrame, candidates: DataFrame, collided: DataFrame) -> DataFrame:
    """``candidates`` with the numbers of chunks whose hash has several texts in ``ranks``."""
    n = collided.count()
    fps = candidates.select("fp", F.explode(F.array_distinct("recipe")).alias("h")).join(small_side(collided, n, 16), "h", "left_semi").select("fp").distinct()
    fps = materialize(fps, "collided-recipes")
    few = small_side(fps, fps.count(), 16)
    rows = again.join(few, "fp", "left_semi").withColumn("row", F.monotonically_increasing_id())
    rows = materialize(rows.select("row", "doc_id", "fp", F.col("made.recipe").alias("recipe"), "sha", chunks_of(F.col("made")).alias("chunks")), "collided-rows")
    each = rows.select("row", F.explode("chunks").alias("c")).select("row", "c.*").join(small_side(collided, n, 16), "h", "left_semi")
    ids = each.select("h", "chunk").distinct().withColumn("k", F.row_number().over(Window.partitionBy("h").orderBy("chunk")))
    ranks = each.join(ids.hint("merge"), ["h", "chunk"]).groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "k"))), lambda x: x["k"]).alias("ranks"))
    mended = rows.join(ranks, "row").select("doc_id", "fp", "recipe", "sha", "ranks")
    return candidates.join(few, "fp", "left_anti").unionByName(mended)


def equal_texts(docs: DataFrame, chunk_hash=F.xxhash64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of each row of (doc_id, text).

    chunk_hash: of an array of segment hashes; equal texts are found whatever it is.
    """
    def made(rows: DataFrame) -> DataFrame:
        found = rows.withColumn("made", cut(F.col("t"), chunk_hash))
        # The generator keeps the definition from being copied into each use below.
        return found.withColumn("made", F.explode_outer(F.array("made"))).withColumn("fp", F.xxhash64("made.recipe"))

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode_outer(F.array(folded(F.col("text")))).alias("t"))
    texts = texts.withColumns({"at": F.xxhash64("t"), "sha": F.sha2("t", 256)})
    slim = materialize(made(texts).select("doc_id", "at", "fp", F.col("made.recipe").alias("recipe"), "sha"), "recipes")
    again = materialize(slim.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp"), "again")
    few = small_side(again, again.count(), 16)
    # Their texts are found again by a hash of the whole, which costs less than the recipe; others that share it do no harm.
    ats = materialize(slim.join(few, "fp", "left_semi").select("at").distinct(), "again-texts")
    slim = slim.drop("at")
    met = made(texts.join(small_side(ats, ats.count(), 16), "at", "left_semi"))
    distinct = met.select(F.explode(chunks_of(F.col("made"))).alias("c")).select("c.h", "c.chunk").distinct()
    collided = materialize(distinct.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "collided")
    candidates = slim.join(few, "fp", "left_semi").withColumn("ranks", F.array().cast("array<int>"))
    if not collided.isEmpty():
        candidates = numbered(met, candidates, collided)
    key = ["fp", "recipe", "ranks", "sha"]
    # Written, so that both sides of the join are dealt out for it alone: Spark can then split a very large class.
    rows = materialize(candidates.groupBy(*key, "doc_id").agg(F.count("*").alias("n")), "rows")
    classes = materialize(rows.groupBy(*key).agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size")), "classes")
    met = rows.join(classes.hint("merge"), key).select("doc_id", "keep_id", "group_size", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy"), "sha")
    met = met.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), F.col("sha").alias("text_sha256"))
    alone = slim.join(few, "fp", "left_anti")
    return alone.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256")).unionByName(met)


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: of equal texts, the one with the largest doc_id.

    A row is found again by its doc_id and its text's SHA-256.
    """
    found = materialize(equal_texts(docs).select("doc_id", "text_sha256", "kept"), "verdicts")
    each = found.groupBy("doc_id", "text_sha256").agg(F.bool_or("kept").alias("kept"), F.count("*").alias("n"))
    sha, other_id, other = (f"_{x}_{uuid.uuid4().hex}" for x in ("sha", "id", "other"))
    each = each.select(F.col("doc_id").alias(other_id), F.col("text_sha256").alias(other), "kept", "n")
    gone = materialize(each.where("not kept").select(other_id, other), "gone")
    repeats = materialize(each.where("kept and n > 1").select(other_id, other), "repeats")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(other_id)) & (F.col(sha) == F.col(other))
    rows = docs.withColumn(sha, F.sha2(folded(F.col("text")), 256)).join(small_side(gone, gone.count(), 96), same, "left_anti")
    few = small_side(repeats, repeats.count(), 96)
    one = rows.join(few, same, "left_semi").dropDuplicates(["doc_id", sha])
    return rows.join(few, same, "left_anti").unionByName(one).drop(sha)
