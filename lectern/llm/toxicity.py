"""A toxicity classifier regularised by counterfactuals.

Logistic regression over the presence of words.  In every labelled sentence
that holds a group term, the term is swapped for each other term of its group,
and the squared change of the document's logit is penalised: a neutral mention
of one group then scores like that of any other.  A swap changes a document's
features only as far as the terms do not stand in its other sentences too.

Group terms are the fixed IDENTITY groups and, since those are English only,
groups mined from the labelled rows: words of middling document frequency that
occur under both labels at about the base rate, in groups of like neighbours
(cosine of the counts of the words before and after) and like frequency.

The model is fitted on at most about SAMPLE_ROWS labelled documents, chosen by
hash of their id, up to half of either label, and weighted back to all: rows
that are not chosen are never read beyond their label.  Words and groups are
chosen by counts that executors make over these documents; the driver gets
FEATURES words, TERMS group terms, and lists of feature numbers.

Cases: a null or empty text has no words and gets the intercept's score.
Without labelled rows, or with labels of one kind, every score is near that
kind (0 without any).  Labels that are null, or not 0 or 1, are not used; a
document labelled both ways counts for both.  Repeated rows are scored each;
long texts are read whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, discard, materialize
from .wordhash import ascii_lower, symbol_delimiters, word_batches

SAMPLE_ROWS, FEATURES, TERMS = 20_000, 512, 96
#: Weight of the counterfactual penalty.
FAIRNESS = 10.0
#: Mined terms: share of documents that hold one (least, most), and buckets of neighbouring words.
SHARE, BUCKETS = (0.002, 0.1), 128
#: Mined groups: least cosine of neighbours, most ratio of frequencies, most terms.
ALIKE, RATIO, GROUP = 0.6, 2.0, 6
#: Identity terms by group (fixed values).
IDENTITY = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("women", "men"),
    ("woman", "man"),
    ("immigrant", "refugee", "foreigner", "native"),
    ("old", "young", "disabled", "blind", "deaf"),
)


class Model(NamedTuple):
    """keys: sorted word hashes; weights; intercept; groups: lists of word hashes; swaps: swapped sentences that entered the penalty."""

    keys: np.ndarray
    weights: np.ndarray
    intercept: float
    groups: list[list[int]] = []
    swaps: int = 0


def word_hash(words: list[str]) -> np.ndarray:
    lower, delimiter = ascii_lower(), symbol_delimiters()
    return np.concatenate([h for _, _, h, _ in word_batches(words, lower, delimiter)]) if words else np.zeros(0, np.uint64)


def located(h: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of ``h`` that hold one of the sorted ``keys``, and its number."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    on = np.flatnonzero(keys[at] == h)
    return on, at[on]


def presence(texts, keys: np.ndarray):
    """(first, last, bounds, features): for each block of texts the distinct numbers, in sorted ``keys``, of each text's words."""
    lower, delimiter = ascii_lower(), symbol_delimiters()
    for first, last, h, bounds in word_batches(texts, lower, delimiter):
        on, at = located(h, keys)
        owner = np.searchsorted(bounds, on, side="right") - 1
        owner, found = np.divmod(np.unique(owner * (len(keys) + 1) + at), len(keys) + 1)
        yield first, last, np.searchsorted(owner, np.arange(last - first + 1)), found


def word_counts(sample: DataFrame) -> DataFrame:
    """word (hash), df, toxic: weights of the documents of (text, toxic, weight) that hold a word, of all and of the toxic ones."""

    def count(batches):
        import pyarrow as pa

        lower, delimiter = ascii_lower(), symbol_delimiters()
        for batch in batches:
            texts, toxic, weight = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for first, last, h, bounds in word_batches(texts, lower, delimiter):
                owner = np.repeat(np.arange(first, last), np.diff(bounds))
                order = np.lexsort((owner, h))
                h, owner = h[order], owner[order]
                new = np.ones(len(h), dtype=bool)
                new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
                h, owner = h[new], owner[new]
                if not len(h):
                    continue
                edges = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                sums = [np.add.reduceat(x, edges) for x in (np.ones(len(h), np.int64), weight[owner], weight[owner] * toxic[owner])]
                yield pa.RecordBatch.from_arrays([pa.array(h[edges].view(np.int64)), *map(pa.array, sums)], ["word", "n", "df", "toxic"])

    made = sample.select("text", "toxic", "weight").mapInArrow(count, "word long, n long, df double, toxic double")
    return made.groupBy("word").agg(F.sum("n").alias("n"), F.sum("df").alias("df"), F.sum("toxic").alias("toxic"))


def neighbours(sample: DataFrame, keys: np.ndarray) -> np.ndarray:
    """Counts of the words before and after each of ``keys``, in 2 * BUCKETS hash buckets."""

    def count(batches):
        import pyarrow as pa

        lower, delimiter = ascii_lower(), symbol_delimiters()
        total = np.zeros(len(keys) * 2 * BUCKETS, dtype=np.int64)
        for batch in batches:
            for _, _, h, bounds in word_batches(batch.column(0).to_pylist(), lower, delimiter):
                on, at = located(h, keys)
                owner = np.searchsorted(bounds, on, side="right") - 1
                for side, step in ((0, -1), (1, 1)):
                    ok = (on + step >= bounds[owner]) & (on + step < bounds[owner + 1])
                    code = (at[ok] * 2 + side) * BUCKETS + (h[on[ok] + step] % np.uint64(BUCKETS)).astype(np.int64)
                    total += np.bincount(code, minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["code", "n"])

    out = np.zeros(len(keys) * 2 * BUCKETS)
    for r in sample.select("text").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():  # at most TERMS * 2 * BUCKETS
        out[r["code"]] = r["n"]
    return out.reshape(len(keys), 2 * BUCKETS)


def mined_groups(words: DataFrame, sample: DataFrame, total: float, rate: float, terms: int) -> list[list[int]]:
    """Groups of word hashes: neutral words of like company and frequency."""
    chi = F.pow(F.col("toxic") - F.col("df") * rate, F.lit(2.0)) / (F.col("df") * rate * (1 - rate))
    neutral = words.where((F.col("n") >= 5) & F.col("df").between(SHARE[0] * total, SHARE[1] * total) & (F.col("toxic") > 0) & (F.col("toxic") < F.col("df")))
    rows = neutral.where(chi < 1).orderBy(F.desc("df"), "word").limit(terms).collect()
    if len(rows) < 2:
        return []
    rows = sorted(rows, key=lambda r: np.int64(r["word"]).view(np.uint64))
    keys, df = np.array([r["word"] for r in rows], dtype=np.int64).view(np.uint64), np.array([r["df"] for r in rows])
    near = neighbours(sample, keys)
    near /= np.maximum(np.linalg.norm(near, axis=1, keepdims=True), 1e-9)
    alike = near @ near.T
    groups, free = [], np.ones(len(keys), dtype=bool)
    for k in np.lexsort((keys, -df)):
        if not free[k]:
            continue
        may = free & (alike[k] >= ALIKE) & (np.maximum(df, df[k]) <= RATIO * np.minimum(df, df[k]))
        may[k] = False
        chosen = [k, *sorted(np.flatnonzero(may), key=lambda j: (-alike[k, j], j))[: GROUP - 1]]
        if len(chosen) > 1:
            free[chosen] = False
            groups.append([int(keys[j]) for j in chosen])
    return groups


def swaps(texts, terms: np.ndarray, group_of: np.ndarray):
    """(lost, gained): for every swap in a sentence the number, in sorted ``terms``, that the document loses and gains; -1 where it keeps or has it anyway."""
    lower, delimiter = ascii_lower(), symbol_delimiters()
    ends = np.zeros(256, dtype=bool)
    ends[[ord(c) for c in ".!?\n"]] = True
    size = len(terms)
    for first, last, h, bounds, sentence in word_batches(texts, lower, delimiter, ends=ends):
        on, a = located(h, terms)
        if not len(on):
            continue
        owner, sentence = np.searchsorted(bounds, on, side="right") - 1, sentence[on]
        # A sentence may go on into the next text: it is named by both.
        place = sentence * (last - first) + owner
        held = np.unique(place * size + a)
        place, a = np.divmod(held, size)
        owner = place % (last - first)
        own, times = np.unique(owner * size + a, return_counts=True)
        member = lambda table, x: table[np.minimum(np.searchsorted(table, x), len(table) - 1)] == x
        stays = times[np.searchsorted(own, owner * size + a)] > 1
        for step in range(1, size):
            b = (a + step) % size
            may = (group_of[a] == group_of[b]) & ~member(held, place * size + b)
            if may.any():
                has = member(own, owner[may] * size + b[may])
                yield np.where(stays[may], -1, a[may]), np.where(has, -1, b[may])


def penalty(sample: DataFrame, groups: list[list[int]]) -> tuple[np.ndarray, np.ndarray, int]:
    """(terms, matrix, swaps): sum over all swaps of the outer product of the document's change."""
    terms = np.unique(np.array([t for g in groups for t in g], dtype=np.uint64))
    group_of = np.zeros(len(terms), dtype=np.int64)
    for k, g in enumerate(groups):
        group_of[np.searchsorted(terms, np.array(g, dtype=np.uint64))] = k
    size = len(terms) + 1

    def count(batches):
        import pyarrow as pa

        total = np.zeros(size * size, dtype=np.int64)
        for batch in batches:
            for lost, gained in swaps(batch.column(0).to_pylist(), terms, group_of):
                total += np.bincount((lost + 1) * size + gained + 1, minlength=size * size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["code", "n"])

    matrix, made = np.zeros((len(terms), len(terms))), 0
    for code, n in sample.select("text").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect() if len(terms) else []:  # at most size * size
        a, b = code // size - 1, code % size - 1
        made += n
        for x, y in ((a, 1.0), (b, -1.0)):
            for z, w in ((a, 1.0), (b, -1.0)):
                if x >= 0 and z >= 0:
                    matrix[x, z] += n * y * w
    return terms, matrix, made


def fit(docs: DataFrame, labels: DataFrame | None = None, sample_rows: int = SAMPLE_ROWS, features: int = FEATURES, fairness: float = FAIRNESS, ridge: float = 1.0, steps: int = 400, terms: int = TERMS) -> Model:
    """The model of (doc_id, text) and the labels (doc_id, toxic); without labels, docs hold toxic themselves."""
    spark = docs.sparkSession
    bounded_batches(spark)
    labels = (docs if labels is None else labels).where("doc_id is not null and toxic in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).distinct()
    n = {r["toxic"]: r["n"] for r in labels.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    none = np.zeros(0, np.uint64), np.zeros(0)
    if len(n) < 2:
        return Model(*none, 20.0 if n.get(1) else -20.0)
    # Up to half of the sample from either label; what one leaves free goes to the other.
    half = sample_rows / 2
    take = {k: min(n[k], max(half, sample_rows - n[1 - k])) for k in n}
    share = {k: int(take[k] / n[k] * (1 << 20)) + 1 for k in n}
    chosen = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0]))
    weight = F.when(F.col("toxic") == 1, n[1] / take[1]).otherwise(n[0] / take[0])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Bounded by sample_rows, so texts need no shuffle.
    sample = materialize(texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic", weight.cast("double").alias("weight")), "toxicity")
    total, toxic = sample.agg(F.sum("weight"), F.sum(F.col("weight") * F.col("toxic"))).first()
    if not toxic or toxic == total:
        discard(sample)
        return Model(*none, 20.0 if toxic else -20.0)
    rate = toxic / total
    words = materialize(word_counts(sample).where("n >= 3"), "toxicity-words")
    chi = F.pow(F.col("toxic") - F.col("df") * rate, F.lit(2.0)) / (F.col("df") * rate * (1 - rate))
    top = words.select("word", F.round(chi, 6).alias("chi")).orderBy(F.desc("chi"), "word").limit(features).collect()
    groups = [[int(x) for x in word_hash(list(g))] for g in IDENTITY]
    given = {x for g in groups for x in g}
    groups += [kept for g in mined_groups(words, sample, total, rate, terms) if len(kept := [x for x in g if x not in given]) > 1]
    known, pull, made = penalty(sample, groups)
    keys = np.unique(np.concatenate([np.array([r["word"] for r in top], dtype=np.int64).view(np.uint64), known]))

    def featurise(batches):
        import pyarrow as pa

        for batch in batches:
            for first, last, bounds, found in presence(batch.column(1).to_pylist(), keys):
                rows = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(found.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), rows, batch.column(2).slice(first, last - first), batch.column(3).slice(first, last - first)], ["doc_id", "found", "toxic", "weight"])

    rows = sample.select("doc_id", "text", "toxic", "weight").mapInArrow(featurise, "doc_id long, found array<int>, toxic int, weight double").toPandas()  # at most about sample_rows
    discard(sample, words)
    # In one order, so that sums are the same in every run.
    rows = rows.assign(size=rows["found"].map(len), code=rows["found"].map(lambda f: hash(tuple(f)))).sort_values(["doc_id", "toxic", "size", "code"], kind="stable")
    x = np.zeros((len(rows), len(keys)))
    for k, f in enumerate(rows["found"]):
        x[k, np.asarray(f, dtype=np.int64)] = 1
    y, c = rows["toxic"].to_numpy(dtype=np.float64), rows["weight"].to_numpy()
    c = c / c.sum()
    at = np.searchsorted(keys, known)
    # The mean change of a swap, at fairness times the weight of the mean loss.
    matrix = pull / max(made, 1) * fairness
    w, b = np.zeros(len(keys)), np.log(rate / (1 - rate))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -40, 40)))
        off = c * (p - y)
        g = off @ x + ridge * w / len(y)
        g[at] += 2 * (matrix @ w[at])
        gb = float(off.sum())
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        fix, fix2 = 1 - 0.9**t, 1 - 0.99**t
        w = w - 0.05 * (m / fix) / (np.sqrt(v / fix2) + 1e-6)
        b = b - 0.05 * (mb / fix) / (np.sqrt(vb / fix2) + 1e-6)
    return Model(keys, w, float(b), groups, int(made))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted."""
    keys, weights, intercept = model[:3]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(1).to_pylist()
            for first, last, bounds, found in presence(texts, keys):
                total = np.concatenate([[0.0], np.cumsum(weights[found] if len(found) else [])])
                logit = intercept + total[bounds[1:]] - total[bounds[:-1]]
                p = 1 / (1 + np.exp(-np.clip(logit, -40, 40)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")
