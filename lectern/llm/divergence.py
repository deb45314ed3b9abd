"""Audit of how the sources of a language differ in their words.

Every group, a (lang, source) or a whole lang, gives each of the language's kept
terms (those in at least DOCUMENTS of its documents) a smoothed integer share

    p = 1 + floor(10^9 * (count + 1) / (N + V)),

and two shares differ by f(p, q) = floor((p - q)^2 / q).  A pair's value is the
sum of f over all V kept terms, most of which neither source has:

1. The index: for each kept term its postings (source, count).
2. Every ordered pair starts at V * f of the shares that a count of zero gets.
3. Postings emit corrections only.  With z for a zero count's share, a term's
   true f(p, q) is  f(z, z) + [f(p, z) - f(z, z)] + [f(z, q) - f(z, z)]
   + [f(p, q) - f(p, z) - f(z, q) + f(z, z)],  where a bracket is zero unless
   the source, the other source, or both hold the term.  The first two depend on
   a source's count alone, so they are taken once for each count that occurs, with
   the number of terms that have it; the third comes from the terms both hold.
4. A source's own most divergent terms are ranked by a window, of which each
   task keeps the first TERMS before the rows are shuffled.

Counting runs over byte strings in the tasks, which combine their documents'
words in tables of at most HELD entries; all else is Spark's joins and sums.
No list of sources or terms is collected; a pair's value is summed in 64 bits,
which holds for fewer than 10^9 kept terms a language.

Cases: null text, lang and source are ''.  Groups without terms take part; with
no kept term a language's pairs have value 0 and there are no term rows.  A row
is a document, so repeated rows count again.  Ties of a value go to the item
whose UTF-8 bytes sort first.  An empty table gives no rows.  Other columns are
ignored, whatever their names.  Texts are counted whole, however long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, give_back, materialize

#: Documents that a kept term is in; rows of a source's list of terms.
DOCUMENTS, TERMS = 3, 200
#: Entries of a task's table of counts before it is handed on.
HELD = 400_000


def letters_only() -> bytes:
    """A translation of bytes: A-Z to a-z, other ASCII than letters to a space."""
    return bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), df (documents); a row with an empty term for every group."""
    bounded_batches(docs.sparkSession)
    table, most = letters_only(), HELD

    def run(batches):
        from collections import Counter, defaultdict

        import pyarrow as pa

        n, df, size = defaultdict(Counter), defaultdict(Counter), 0

        def rows():
            for (lang, source), c in n.items():
                d = df[lang, source]
                words = list(c)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(words), pa.string()),
                        pa.array([source] * len(words), pa.string()),
                        pa.array(words, pa.binary()),
                        pa.array(list(c.values()), pa.int64()),
                        pa.array([d[w] for w in words], pa.int64()),
                    ],
                    ["lang", "source", "term", "n", "df"],
                )
            n.clear()
            df.clear()

        for batch in batches:
            for lang, source, text in zip(*(batch.column(k) for k in range(3))):
                group = lang.as_py(), source.as_py()
                words = Counter(text.as_py().translate(table).split())
                held = n[group]
                size -= len(held)
                held.update(words)
                df[group].update(words.keys())
                held[b""] = 0
                size += len(held)
                if size > most:
                    yield from rows()
                    size = 0
        yield from rows()
        give_back()

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    found = docs.select(text("lang").alias("lang"), text("source").alias("source"), text("text").cast("binary").alias("text"))
    found = found.mapInArrow(run, "lang string, source string, term binary, n long, df long")
    return found.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def share(count: str, total: str, terms: str) -> Column:
    """The share of a count: in decimals, since 10^9 times a count may pass 64 bits."""
    return F.expr(f"1 + (CAST(1000000000 AS DECIMAL(10, 0)) * ({count} + 1)) div ({total} + {terms})")


def difference(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q})) div {q}"


def audit(docs: DataFrame, least: int = DOCUMENTS, top: int = TERMS) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank."""
    found = materialize(counts(docs), "term-counts")
    groups = found.where("term = ''").select("lang", "source")
    kept = found.where("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("df").alias("df")).where(F.col("df") >= least).select("lang", "term", "lang_n")
    kept = materialize(kept, "kept-terms")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    index = found.where("term <> ''").select("lang", "term", "source", "n").join(kept.hint("merge"), ["lang", "term"])
    index = materialize(index, "postings")
    totals = index.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = groups.join(langs, "lang", "left").join(totals, ["lang", "source"], "left")
    groups = groups.select("lang", "source", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("total", F.lit(0)).alias("total"), "lang_total")
    groups = materialize(groups.withColumn("zero", F.when(F.col("v") > 0, share("0", "total", "v"))), "groups")
    known = groups.where("v > 0")
    shares = index.join(known.select("lang", "source", "v", "total", "zero", "lang_total"), ["lang", "source"]).withColumn("p", share("n", "total", "v"))
    shares = materialize(shares.select("lang", "term", "source", "n", "p", "zero", share("lang_n", "lang_total", "v").alias("q")), "shares")

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    terms = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(difference("p", "q")).alias("value"))
    terms = terms.withColumn("rank", rank).where(F.col("rank") <= top)

    # One source's counts against every other's zero share, in both directions.
    other = groups.select("lang", F.col("source").alias("item"), "v", F.col("zero").alias("q0"))
    pairs = groups.select("lang", "source", F.col("zero").alias("p0")).join(other, "lang").where("source <> item")
    start = pairs.select("lang", "source", "item", F.expr(f"CASE WHEN v > 0 THEN v * ({difference('p0', 'q0')}) ELSE 0 END").alias("value"))
    by_count = materialize(shares.groupBy("lang", "source", "p", "zero").agg(F.count("*").alias("terms")), "by-count")
    rest = known.select("lang", F.col("source").alias("item"), F.col("zero").alias("z"))
    one = by_count.join(rest, "lang").where("source <> item")
    ours = one.select("lang", "source", "item", F.expr(f"terms * ({difference('p', 'z')} - {difference('zero', 'z')})").alias("value"))
    theirs = one.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.expr(f"terms * ({difference('z', 'p')} - {difference('z', 'zero')})").alias("value"))
    mine = shares.select("lang", "term", "source", "p", F.col("zero").alias("p0"))
    yours = shares.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("zero").alias("q0"))
    both = mine.join(yours.hint("merge"), ["lang", "term"]).where("source <> item")
    both = both.select("lang", "source", "item", F.expr(f"{difference('p', 'q')} - {difference('p', 'q0')} - {difference('p0', 'q')} + {difference('p0', 'q0')}").alias("value"))
    sums = start
    for more in (ours, theirs, both):
        sums = sums.unionByName(more.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")))
    sums = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    sums = sums.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", rank)
    return sums.unionByName(terms).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))
