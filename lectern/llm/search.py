"""Ranked lexical search: WAND over shards of documents, shards' heaps merged.

1. One pass over the texts counts each document's words and writes, for the
   queries' terms only, a row of (term, occurrences) lists; from these rows come
   the corpus' statistics N, L and each term's number of documents.
2. A task makes inverted indexes of SHARD_ROWS documents at a time (or of
   SHARD_POSTINGS occurrences): postings by ascending doc_id with their exact
   impact, and each term's largest.
3. WAND searches a shard for each query.  Its lists are kept in order of their
   next document; the first prefix whose largest impacts together pass the
   threshold ends at the pivot.  No document before the pivot's can enter the
   heap, so the lists jump there without looking at what lies between.  The
   threshold begins at the exact score of the k-th best of some documents from
   the lists of greatest impact, and rises with the heap.
4. Heaps of all shards meet in two windows, first by range of documents.

Queries are taken in blocks of at most BLOCK_TERMS terms, each with a pass of
its own over the documents, so that what a task holds is bounded; a single
query of more terms is a block alone.

Cases: null or empty texts have no terms and are never found.  Rows that repeat
a doc_id are documents of their own; equal scores go by ascending doc_id, null
last.  Rows of one item_id are one query.  Queries without terms, or whose terms
no document holds, have no rows.  Empty tables give no rows.  Other columns are
ignored, whatever their names.  Texts are read whole, however long.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, give_back, materialize

K = 50
SHARD_ROWS, SHARD_POSTINGS = 1 << 17, 1 << 22
BLOCK_TERMS = 200_000
#: Documents scored to begin with, and ranges of documents in the first merge.
PRIME, RANGES = 1024, 64


def letters_and_digits() -> bytes:
    """A translation of bytes: A-Z to a-z, other ASCII than letters and digits to a space."""
    return bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))


def queries_in_blocks(items: DataFrame, most: int):
    """Yield lists of (item_id, terms): one task at a time comes to the driver, one block is held."""
    table = letters_and_digits()

    def terms(batches):
        import pyarrow as pa

        for batch in batches:
            found = [sorted(set(t.translate(table).split())) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.binary()))], ["item_id", "terms"])

    rows = items.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").cast("binary").alias("text"))
    rows = rows.mapInArrow(terms, "item_id long, terms array<binary>").groupBy("item_id").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms"))
    block, held = [], 0
    for r in rows.where("size(terms) > 0").toLocalIterator():
        if block and held + len(r.terms) > most:
            yield block
            block, held = [], 0
        block.append((r.item_id, [bytes(t) for t in r.terms]))
        held += len(r.terms)
    if block:
        yield block


def occurrences(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (words), terms, tfs: of the vocabulary's terms, in order of their numbers."""
    table = letters_and_digits()

    def run(batches):
        from collections import Counter

        import pyarrow as pa

        known = vocabulary.keys()
        for batch in batches:
            sizes, ends, terms, tfs = [], [0], [], []
            for text in batch.column(1):
                words = text.as_py().translate(table).split()
                sizes.append(len(words))
                count = Counter(words)
                held = sorted((vocabulary[w], count[w]) for w in known & count.keys())
                terms.extend(t for t, _ in held)
                tfs.extend(c for _, c in held)
                ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, kind)) for v, kind in ((terms, pa.int32()), (tfs, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])
        give_back()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<long>")


class Shard:
    """Postings of some documents by term: documents (numbers in order of doc_id), impacts, and the largest impact."""

    def __init__(self, sizes, ends, terms, tfs, weights, n_documents: int, n_words: int):
        # m: 50 and 50 times the document's length by the mean length.
        if 50 * int(sizes.max(initial=0)) * n_documents < 1 << 62:
            m = 50 + 50 * sizes * n_documents // max(n_words, 1)
        else:
            m = np.array([50 + 50 * int(s) * n_documents // n_words for s in sizes], dtype=np.int64)
        doc = np.repeat(np.arange(len(sizes)), np.diff(ends))
        impact = weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 20 * m[doc]))
        order = np.argsort(terms, kind="stable")
        doc, impact, terms = doc[order], impact[order], terms[order]
        starts = np.flatnonzero(np.diff(terms, prepend=-1))
        most = np.maximum.reduceat(impact, starts) if len(starts) else impact
        self.lists = {int(terms[a]): (doc[a:b], impact[a:b], int(x)) for a, b, x in zip(starts, [*starts[1:], len(terms)], most) if x > 0}

    def primed(self, lists, k: int) -> int:
        """A score that at least k documents surpass: of those in the lists of greatest impact, scored exactly."""
        picked, held = [], 0
        for doc, _, _ in sorted(lists, key=lambda x: -x[2]):
            picked.append(doc[: PRIME - held])
            held += len(picked[-1])
            if held >= PRIME:
                break
        some = np.unique(np.concatenate(picked))
        if len(some) < k:
            return 0
        score = np.zeros(len(some), dtype=np.int64)
        for doc, impact, _ in lists:
            at = np.minimum(np.searchsorted(doc, some), len(doc) - 1)
            score += np.where(doc[at] == some, impact[at], 0)
        return max(0, int(np.partition(score, len(score) - k)[len(score) - k]) - 1)

    def search(self, terms, k: int) -> list[tuple[int, int]]:
        """(score, document) of the k best, equal scores by document."""
        from bisect import bisect_left
        from heapq import heappush, heapreplace
        from operator import itemgetter

        lists = [self.lists[t] for t in terms if t in self.lists]
        if not lists:
            return []
        limit, heap, next_document = self.primed(lists, k), [], itemgetter(0)
        # next document, place in the list, documents, impacts, largest impact, length
        cursors = [[int(d[0]), 0, memoryview(d), memoryview(i), most, len(d)] for d, i, most in lists]
        cursors.sort(key=next_document)
        while True:
            bound, pivot = 0, -1
            for c in cursors:
                bound += c[4]
                if bound > limit:
                    pivot = c[0]
                    break
            if pivot < 0:
                break
            done = False
            if cursors[0][0] == pivot:
                score = 0
                for c in cursors:
                    if c[0] != pivot:
                        break
                    at = c[1]
                    score += c[3][at]
                    c[1] = at = at + 1
                    if at < c[5]:
                        c[0] = c[2][at]
                    else:
                        c[0], done = -1, True
                if score > limit:
                    if len(heap) < k:
                        heappush(heap, (score, -pivot))
                    else:
                        heapreplace(heap, (score, -pivot))
                    if len(heap) == k:
                        limit = max(limit, heap[0][0])
            else:
                for c in cursors:
                    if c[0] >= pivot:
                        break
                    c[1] = at = bisect_left(c[2], pivot, c[1] + 1)
                    if at < c[5]:
                        c[0] = c[2][at]
                    else:
                        c[0], done = -1, True
            if done:
                cursors = [c for c in cursors if c[0] >= 0]
            cursors.sort(key=next_document)
        return sorted(((s, -d) for s, d in heap), key=lambda x: (-x[0], x[1]))


def found_in_shards(postings: DataFrame, queries, weights, n_documents: int, n_words: int, k: int) -> DataFrame:
    """item_id, doc_id, score: the k best of each shard."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        held, rows, size = [], 0, 0

        def answer():
            ids = pa.concat_arrays([b.column(0) for b in held])
            order = pc.array_sort_indices(ids, null_placement="at_end").to_numpy()
            sizes = np.concatenate([b.column(1).to_numpy() for b in held])
            counts = np.concatenate([pc.list_value_length(b.column(2)).to_numpy() for b in held]).astype(np.int64)
            begins = np.cumsum(counts) - counts
            ends = np.concatenate([[0], np.cumsum(counts[order])])
            pick = np.arange(ends[-1]) - np.repeat(ends[:-1] - begins[order], counts[order])
            terms, tfs = (np.concatenate([b.column(c).flatten().to_numpy() for b in held])[pick].astype(np.int64) for c in (2, 3))
            shard = Shard(sizes[order], ends, terms, tfs, weights, n_documents, n_words)
            ids = ids.take(pa.array(order))
            items, at, scores = [], [], []
            for item, asked in queries:
                for score, doc in shard.search(asked, k):
                    items.append(item)
                    at.append(doc)
                    scores.append(score)
            return pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), ids.take(pa.array(at, pa.int64())), pa.array(scores, pa.int64())], ["item_id", "doc_id", "score"])

        for batch in batches:
            if held and (rows + len(batch) > SHARD_ROWS or size > SHARD_POSTINGS):
                yield answer()
                held, rows, size = [], 0, 0
            held.append(batch)
            rows += len(batch)
            size += len(batch.column(2).flatten())
        if held:
            yield answer()
        give_back()

    return postings.mapInArrow(run, "item_id long, doc_id long, score long")


def rank(docs: DataFrame, items: DataFrame, k: int = K, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: for each item of (item_id, text) its k best documents of (doc_id, text)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    best = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    for block in queries_in_blocks(items, block_terms):
        vocabulary = {t: n for n, t in enumerate(sorted({t for _, terms in block for t in terms}))}
        postings = materialize(occurrences(docs, vocabulary), "occurrences")
        n_documents, n_words = postings.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        weights = np.zeros(len(vocabulary), dtype=np.int64)
        for r in postings.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).toLocalIterator():
            weights[r.t] = math.floor(1000 * math.log((2 * n_documents + 2) / (2 * r.df + 1)))
        asked = [(item, [vocabulary[t] for t in terms]) for item, terms in block]
        found = found_in_shards(postings.where("n > 0"), asked, weights, n_documents, n_words, k)
        found = found.withColumn("range", F.pmod(F.xxhash64("doc_id"), F.lit(RANGES)))
        found = found.withColumn("place", F.row_number().over(Window.partitionBy("item_id", "range").orderBy(*order))).where(F.col("place") <= k)
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order)).cast("int")).where(F.col("rank") <= k)
        best = best.unionByName(found.select("item_id", "rank", "doc_id", "score"))
    return best
