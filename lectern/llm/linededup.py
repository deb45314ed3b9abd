"""Removal of repeated multi-line chunks with content-defined boundaries.

A rolling hash over the hashes of neighbouring lines decides where a chunk
ends, so that an inserted or missing line shifts no boundary beyond its
neighbours.  Chunks of two lines or more that occur again anywhere are removed
but for their first occurrence (smallest doc_id, then position).  Hashes only
find candidates; chunks are equal if their bytes are.

That form is bound by its SQL: a chunk of one line, and one that also holds
foreign lines, always stays.  Extended, what the chunks find grows beyond their
boundaries: the lines of repeated chunks go, and of all others two neighbouring
ones that occur together earlier, so that every passage of two lines or more
that occurred before goes whole and without its neighbours.  A line's first
occurrence always stays.

Built-in functions only.  Hashes of chunks are shuffled; each document's text
once to cut out the chunks whose hash occurs again, and once when removals are
handed back.

Cases: a null text stays null; an empty one has one empty line.  Chunks that
hold nothing but white space are never removed.  Rows that repeat a doc_id and
its text are one document (all stay, with the same removals).  Rows with a
null doc_id come last in order.  An empty table gives no rows.  Other columns
are kept, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: A chunk ends at a line with a rolling hash divisible by this.
DIVISOR = 3
#: Lines of a multi-line chunk.
LEAST = 2


def line_value(line: Column) -> Column:
    """28 bits of a line's hash."""
    return F.conv(F.substring(F.md5(line), 1, 7), 16, 10).cast("long")


def chunked(docs: DataFrame, divisor: int, *other: str) -> DataFrame:
    """doc_id, at (hash of the text), chunks: array of (text, lines), and the other columns named."""
    ends, start = boundaries(docs, divisor, *other)
    made = F.transform("ends", lambda e, k: F.struct(F.array_join(F.slice("lines", start(k) + 1, e - start(k) + 1), "\n").alias("text"), (e - start(k) + 1).alias("lines")))
    return ends.select("doc_id", "at", *other, made.alias("chunks"))


def boundaries(docs: DataFrame, divisor: int, *other: str):
    """doc_id, at, lines, ends (the last line of each chunk) and the other columns named; a chunk's first line by its number."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("at"), *other, F.split("text", "\n", -1).alias("lines"))
    values = lines.withColumn("v", F.transform("lines", line_value))
    roll = lambda i: F.get("v", i) + 31 * F.coalesce(F.get("v", i - 1), F.lit(0))
    last = F.size("lines") - 1
    ends = values.withColumn("ends", F.filter(F.sequence(F.lit(0), last), lambda i: (roll(i) % divisor == 0) | (i == last)))
    return ends, lambda k: F.coalesce(F.get("ends", k - 1) + 1, F.lit(0))


def marked(hashes: DataFrame, overlapping: bool = False) -> tuple[DataFrame, DataFrame]:
    """(_m_id, _m_at, marks), and what it reads: of (doc_id, at, pos, h), a document's positions whose hash occurs again, with the hash and whether it is the first.

    overlapping: places are pairs of lines; one that follows its first on the
    next line is left out.
    """
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "at", "pos")
    # Written, so that both sides of the join are dealt out for it alone: Spark can then split a very common hash.
    again = materialize(hashes.groupBy("h").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("h", "first"), "again")
    met = hashes.join(again.hint("merge"), "h")
    if overlapping:
        met = met.where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("at") == F.col("first.at")) & (F.col("pos") == F.col("first.pos") + 1)))
    marks = met.select("doc_id", "at", F.struct("pos", "h", (place == F.col("first")).alias("leads")).alias("mark"))
    return marks.groupBy("doc_id", "at").agg(F.collect_set("mark").alias("marks")).select(F.col("doc_id").alias("_m_id"), F.col("at").alias("_m_at"), "marks"), again


def verified(candidates: DataFrame) -> DataFrame:
    """doc_id, at, gone: of (doc_id, at, pos, h, leads, chunk), the positions whose text occurred before."""
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "at", "pos")
    leads = candidates.where("leads").dropDuplicates(["h"]).select("h", F.col("chunk").alias("lead"))
    leads = materialize(leads, "leads")
    met = candidates.where("not leads").join(leads.hint("merge"), "h")
    met = materialize(met.select("doc_id", "at", "pos", "h", F.when(F.col("chunk") != F.col("lead"), F.col("chunk")).alias("chunk")), "met")
    discard(leads, candidates)
    rest = met.where("chunk is not null")
    first = rest.groupBy("h", "chunk").agg(F.min(place).alias("first"))
    rest = rest.join(first, ["h", "chunk"]).where(place != F.col("first"))
    met = met.where("chunk is null").select("doc_id", "at", "pos").union(rest.select("doc_id", "at", "pos"))
    return met.groupBy("doc_id", "at").agg(F.collect_set("pos").alias("gone"))


def repeated_chunks(docs: DataFrame, divisor: int = DIVISOR, least: int = LEAST) -> DataFrame:
    """doc_id, at, gone: positions of a document's chunks that occurred before.

    Hashes of all chunks are shuffled; texts only of chunks whose hash occurs
    again.  A text is compared with that of its hash's first place; those that
    differ from it (another text of the same hash) are grouped by their bytes.
    """
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # The outer form: the other lets the optimizer copy the chunks' definition into a filter below, once for each line.
    split = chunked(texts, divisor).select("doc_id", "at", F.posexplode_outer("chunks").alias("pos", "chunk"))
    split = split.where(F.col("chunk.lines") >= least).where(F.col("chunk.text").rlike(r"\S"))
    hashes = materialize(split.select("doc_id", "at", "pos", F.xxhash64("chunk.text").alias("h")), "hashes")
    marks, again = marked(hashes)
    held = texts.withColumn("at", F.xxhash64("text")).join(marks.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_m_id")) & (F.col("at") == F.col("_m_at"))).select("doc_id", "text", "marks")
    held = chunked(held, divisor, "marks").select("doc_id", "at", "marks", F.explode_outer(F.array("chunks")).alias("chunks"))
    candidates = held.select("doc_id", "at", "chunks", F.explode("marks").alias("m")).select("doc_id", "at", "m.*", F.get("chunks", F.col("m.pos")).getField("text").alias("chunk"))
    candidates = materialize(candidates, "chunks")
    discard(hashes, again)
    return verified(candidates)


def line_pairs(docs: DataFrame, divisor: int = DIVISOR) -> DataFrame:
    """doc_id, at, pos, h, repeated: pairs of neighbouring lines that are not both blank; repeated: within a chunk that occurred before.

    The first place of a pair is never within a repeated chunk, for the chunk's
    own first place holds the pair too: such pairs need no comparison.
    """
    ends, start = boundaries(docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text"), divisor)
    line = lambda i: F.get("lines", i)
    full = lambda x: x.rlike(r"\S")
    # A chunk's pairs, the last one with the next chunk's first line: that one has no chunk.
    pair = lambda i, e, k: F.struct(i.alias("pos"), F.xxhash64(line(i), line(i + 1)).alias("h"), F.when(i < e, k).alias("chunk"))
    at = lambda e, k: F.filter(F.sequence(start(k), e), lambda i: (i < F.size("lines") - 1) & (full(line(i)) | full(line(i + 1))))
    pairs = F.flatten(F.transform("ends", lambda e, k: F.transform(at(e, k), lambda i: pair(i, e, k))))
    pairs = ends.select("doc_id", "at", F.explode_outer(pairs).alias("pair")).where("pair is not null").select("doc_id", "at", "pair.*")
    gone = repeated_chunks(docs, divisor).select(F.col("doc_id").alias("_c_id"), F.col("at").alias("_c_at"), "gone")
    met = pairs.join(gone.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_c_id")) & (F.col("at") == F.col("_c_at")), "left")
    return met.select("doc_id", "at", "pos", "h", F.coalesce(F.array_contains("gone", F.col("chunk")), F.lit(False)).alias("repeated"))


def repeated_pairs(docs: DataFrame, divisor: int = DIVISOR) -> DataFrame:
    """doc_id, at, gone: positions of lines that, with the next, occurred before.

    Those within repeated chunks, and of the others those whose pair occurred
    before.  A pair that overlaps its first occurrence (``a`` twice in ``a a
    a``) is no repeat.  Texts are shuffled only of what occurs again by its hash.
    """
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("at", F.xxhash64("text"))
    line = lambda i: F.get("lines", i)
    pairs = materialize(line_pairs(docs, divisor), "pairs")
    hashes = pairs.where("not repeated").select("doc_id", "at", "pos", "h")
    marks, again = marked(hashes, overlapping=True)
    held = texts.join(marks.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_m_id")) & (F.col("at") == F.col("_m_at")))
    held = held.select("doc_id", "at", "marks", F.split("text", "\n", -1).alias("lines"))
    cut = F.transform("marks", lambda m: F.struct(m["pos"].alias("pos"), m["h"].alias("h"), m["leads"].alias("leads"), F.concat(line(m["pos"]), F.lit("\n"), line(m["pos"] + 1)).alias("chunk")))
    candidates = materialize(held.select("doc_id", "at", F.explode(cut).alias("m")).select("doc_id", "at", "m.*"), "chunks")
    discard(again)
    found = verified(candidates).select("doc_id", "at", F.explode("gone").alias("pos")).union(pairs.where("repeated").select("doc_id", "at", "pos"))
    return found.groupBy("doc_id", "at").agg(F.collect_set("pos").alias("gone"))


def handed_back(docs: DataFrame, gone: DataFrame, kept_lines) -> DataFrame:
    """``docs`` with the text of the kept lines where (doc_id, at) is in ``gone``, lines_in and lines_out.

    kept_lines(lines, gone): the lines that stay.  The columns made on the way
    have names that no input has.
    """
    columns = [c for c in docs.columns if c not in ("lines_in", "lines_out")]
    at, other_id, other_at, hit, lines, kept = (f"_{x}_{uuid.uuid4().hex}" for x in ("at", "id", "at2", "gone", "lines", "kept"))
    gone = gone.select(F.col("doc_id").alias(other_id), F.col("at").alias(other_at), F.sort_array("gone").alias(hit))
    keyed = docs.withColumn(at, F.xxhash64("text"))
    met = keyed.join(gone.hint("merge"), F.col("doc_id").cast("long").eqNullSafe(F.col(other_id)) & (F.col(at) == F.col(other_at)), "left")
    # Rebuilt only where something goes: without positions the lines are null, and so is all that follows from them.
    work = met.withColumn(lines, F.when(F.col(hit).isNotNull(), F.split("text", "\n", -1)))
    # A generator: a later filter on the text must not be pushed below it and copy the definitions into each line's lambda.
    work = work.withColumn(kept, F.explode_outer(F.array(kept_lines(lines, hit))))
    count = F.when(F.col("text").isNotNull(), F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1)
    changed = F.col(hit).isNotNull()
    return work.select(
        *[F.when(changed, F.array_join(kept, "\n")).otherwise(F.col(c)).alias(c) if c == "text" else F.col(f"`{c}`") for c in columns],
        count.alias("lines_in"),
        F.when(changed, F.size(kept)).otherwise(count).alias("lines_out"),
    )


def drop_repeated_lines(docs: DataFrame, divisor: int = DIVISOR, least: int = LEAST, extended: bool = False) -> DataFrame:
    """``docs`` with repeated chunks removed from ``text``; adds lines_in and lines_out (an input's own columns of these names are replaced).

    extended: repeats go beyond the chunks' boundaries, see ``drop_repeated_passages``; ``least`` is LEAST then.
    """
    if extended:
        return drop_repeated_passages(docs, divisor)

    def kept(lines: str, gone: str) -> Column:
        """The chunks' lines but for those at the positions in ``gone``."""
        values = F.transform(lines, line_value)
        last = F.size(lines) - 1
        roll = lambda v, i: F.get(v, i) + 31 * F.coalesce(F.get(v, i - 1), F.lit(0))
        # Each definition is computed once: as the only element of an array.
        ends = lambda v: F.filter(F.sequence(F.lit(0), last), lambda i: (roll(v, i) % divisor == 0) | (i == last))
        start = lambda e, k: F.coalesce(F.get(e, k - 1) + 1, F.lit(0))
        pick = lambda e: F.transform(e, lambda x, k: F.when(F.array_contains(gone, k), F.array().cast("array<string>")).otherwise(F.slice(lines, start(e, k) + 1, x - start(e, k) + 1)))
        return F.flatten(F.flatten(F.transform(F.transform(F.array(values), ends), pick)))

    return handed_back(docs, repeated_chunks(docs, divisor, least), kept)


def drop_repeated_passages(docs: DataFrame, divisor: int = DIVISOR) -> DataFrame:
    """As ``drop_repeated_lines``, and on beyond the chunks by pairs of neighbouring lines: passages that occurred before go whole."""

    def kept(lines: str, gone: str) -> Column:
        """What lies between two pairs that go."""
        start = lambda k: F.coalesce(F.get(gone, k - 1) + 2, F.lit(0))
        return F.flatten(F.transform(F.concat(gone, F.array(F.size(lines))), lambda e, k: F.slice(lines, start(k) + 1, F.greatest(e - start(k), F.lit(0)))))

    return handed_back(docs, repeated_pairs(docs, divisor), kept)
