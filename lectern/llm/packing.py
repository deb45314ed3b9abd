"""Packing by cutting-stock column generation.

A document's ids (and one end id) are cut at every ``capacity`` ids; only the
last piece is shorter.  The lengths of those last pieces form a histogram of a
few hundred sizes.  A linear program over cutting patterns of that histogram
is solved by column generation: a knapsack dynamic program prices new
patterns against the program's dual values.  The solution is rounded down, the
few pieces left are packed best fit first, and the patterns' slots are handed
to the pieces by their rank within their size.

What reaches the driver is the histogram (at most 2,048 rows, whatever the
input); pieces are ranked by partition counts, never in one task.

Cases: a null or empty text is one piece that holds the end id alone.  Ties
and repeated rows are packed like any other row.  An empty table gives no
rows.  Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .tokens import VOCABULARY, encoder

CAPACITY = 2048
END_ID = 1


def size_class(length: int) -> int:
    """Lengths are rounded up by less than 1/32: exactly below 64, to 2 below 128, to 4 below 256, to 8 above."""
    step = 1 if length < 64 else 2 if length < 128 else 4 if length < 256 else 8
    return -(-length // step) * step


def price(sizes: np.ndarray, value: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack for every room up to ``capacity``: the best value, and the index of the size taken last (-1: none, one less room)."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    upto = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for room in range(int(sizes[0]), capacity + 1):
        n = upto[room]
        gain = best[room - sizes[:n]] + value[:n]
        k = int(gain.argmax())
        if gain[k] > best[room - 1]:
            best[room], took[room] = gain[k], k
        else:
            best[room] = best[room - 1]
    return best, took


def filled(sizes: np.ndarray, took: np.ndarray, room: int) -> np.ndarray:
    """The counts of the best multiset for ``room``, read back from ``price``."""
    counts = np.zeros(len(sizes))
    while room > 0:
        if took[room] < 0:
            room -= 1
        else:
            counts[took[room]] += 1
            room -= int(sizes[took[room]])
    return counts


def inverted(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan with row pivots, element by element: LAPACK's threads may wait for ever in a process that was forked."""
    n = len(matrix)
    both = np.hstack([matrix.astype(float), np.eye(n)])
    for k in range(n):
        pivot = k + int(np.abs(both[k:, k]).argmax())
        if pivot != k:
            both[[k, pivot]] = both[[pivot, k]]
        both[k] /= both[k, k]
        factor = both[:, k].copy()
        factor[k] = 0
        on = np.flatnonzero(factor)
        both[on] -= factor[on, None] * both[k]
    return both[:, n:]


def solve(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 1e-3, rounds: int = 40, pivots: int = 1500):
    """Basic patterns (as columns) and how often each is used, fractional: the cutting-stock linear program.

    The knapsack prices patterns at dual values smoothed towards the best ones
    so far (at first the sizes' shares of the capacity), and gives the best
    pattern around each size at once; the program pivots among those found.
    Ends when the dual bound proves the value to be within ``gap`` of the
    optimum, or after ``rounds`` rounds.
    """
    m = len(sizes)
    columns = np.diag(capacity // sizes).astype(float)
    inverse = np.diag(1.0 / np.diag(columns))
    use = inverse @ demand
    held = columns.copy(), use.copy()
    center = sizes / capacity
    bound = center @ demand
    # Patterns to begin with: a proportional part of the histogram, packed best fit.
    part = np.ceil(demand * min(1.0, 6000 / demand.sum())).astype(int)
    place = {int(s): i for i, s in enumerate(sizes)}
    found = np.zeros((m, 0))
    started = {tuple(b) for b in best_fit([int(s) for s, n in zip(sizes, part) for _ in range(n)], capacity)}
    begun = np.zeros((m, len(started)))
    for j, b in enumerate(sorted(started)):
        for size in b:
            begun[place[size], j] += 1
    for turn in range(rounds):
        dual = inverse.sum(axis=0)
        fresh, smooth = [], 0.7
        while not fresh and smooth > 0.01:
            at = smooth * center + (1 - smooth) * dual
            best, took = price(sizes, np.maximum(at, 0), capacity)
            if (at @ demand) / best[capacity] > bound:
                center, bound = np.maximum(at, 0) / best[capacity], (at @ demand) / best[capacity]
            for k in range(m):
                counts = filled(sizes, took, capacity - int(sizes[k]))
                counts[k] += 1
                if dual @ counts > 1 + 1e-7:
                    fresh.append(counts)
            smooth = smooth - 0.35 if smooth > 0.36 else 0 if smooth == 0 else 0.02 if smooth > 0.02 else 0
        if not fresh:
            break
        found = np.column_stack([found, *fresh] if turn else [begun, *fresh])
        for _ in range(pivots):  # the bound keeps degenerate steps from going on
            dual = inverse.sum(axis=0)
            gain = dual @ found
            k = int(gain.argmax())
            if gain[k] <= 1 + 1e-7:
                break
            entering = inverse @ found[:, k]
            able = entering > 1e-7
            ratio = np.where(able, use / np.where(able, entering, 1), np.inf)
            if not able.any():
                break
            # Of equal ratios the largest pivot: small ones make the basis singular.
            out = int(np.where(ratio <= ratio.min() * (1 + 1e-9) + 1e-12, entering, -np.inf).argmax())
            step = ratio[out]
            use = np.maximum(use - step * entering, 0)
            use[out] = step
            columns[:, out] = found[:, k]
            row = inverse[out] / entering[out]
            inverse -= np.outer(entering, row)
            inverse[out] = row
        with np.errstate(all="ignore"):
            inverse = inverted(columns)
            use = np.maximum(inverse @ demand, 0)
            sound = np.abs(columns @ use - demand).max() <= 1e-6 * demand.max()
        if not sound:  # a basis that rounding has made singular: the last sound one stands
            columns, use = held
            break
        held = columns.copy(), use.copy()
        if use.sum() <= bound * (1 + gap):
            break
        if found.shape[1] > 4000:
            found = found[:, np.argsort(-(inverse.sum(axis=0) @ found), kind="stable")[:2000]]
    return columns.round().astype(np.int64), use


def best_fit(items: list[int], capacity: int) -> list[list[int]]:
    """Whole pieces by falling size, each into the fullest bin with room."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins: list[list[int]] = []
    for size in sorted(items, reverse=True):
        room = next((r for r in range(size, capacity + 1) if by_room[r]), None)
        if room is None:
            bins.append([size])
            by_room[capacity - size].append(len(bins) - 1)
        else:
            k = by_room[room].pop()
            bins[k].append(size)
            by_room[room - size].append(k)
    return bins


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Integer patterns ({size: count}, uses) that hold every piece of the histogram exactly once."""
    sizes = np.array(sorted(s for s, n in histogram.items() if n), dtype=np.int64)
    if not len(sizes):
        return []
    left = np.array([histogram[int(s)] for s in sizes], dtype=np.int64)
    columns, use = solve(sizes, left.astype(float), capacity)
    made: list[tuple[dict[int, int], int]] = []
    for k in np.argsort(-use, kind="stable"):
        column = columns[:, k]
        on = column > 0
        times = int(min(np.floor(use[k] + 1e-9), (left[on] // column[on]).min())) if on.any() else 0
        if times > 0:
            left = left - times * column
            made.append(({int(sizes[i]): int(column[i]) for i in np.flatnonzero(on)}, times))
    rest: dict[tuple[int, ...], int] = {}
    for b in best_fit([int(s) for s, n in zip(sizes, left) for _ in range(int(n))], capacity):
        rest[tuple(b)] = rest.get(tuple(b), 0) + 1
    for b, times in rest.items():
        made.append(({s: b.count(s) for s in b}, times))
    return made


def slots(patterns: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(size, lo, hi, sequence, per, slot): pieces of a size ranked lo..hi-1 go to sequences from ``sequence`` on, ``per`` in each from ``slot`` on."""
    rows, taken, sequence = [], {}, 0
    for pattern, times in patterns:
        slot = 0
        for size in sorted(pattern, reverse=True):
            lo = taken.get(size, 0)
            taken[size] = lo + pattern[size] * times
            rows.append((size, lo, taken[size], sequence, pattern[size], slot))
            slot += pattern[size]
        sequence += times
    return rows


def cut(docs: DataFrame, capacity: int, end_id: int, vocabulary: str, with_ids: bool) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, its size class, and its rank in its partition's class."""

    def pieces(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encode, part, seen = encoder(vocabulary), TaskContext.get().partitionId(), {}
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "size", "part", "place", "ids"][: 8 + with_ids]
        kinds = [pa.int64()] * 5 + [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int32())]
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1)
            out: list[list] = [[] for _ in names]

            def full():
                made = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds)], names)
                for v in out:
                    v.clear()
                return made

            held = 0
            for doc_id, text in zip(doc_ids, texts):
                ids = np.array([*encode(text.as_py()), end_id], dtype="<u4")
                held += len(ids) * with_ids
                for start in range(0, len(ids), capacity):
                    piece = ids[start : start + capacity]
                    size = min(size_class(len(piece)), capacity)
                    place = seen[size] = seen.get(size, -1) + 1
                    row = (doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), size, part, place)
                    for v, x in zip(out, row):
                        v.append(x)
                    if with_ids:
                        out[8].append(piece.astype(np.int32))
                if len(out[0]) >= 20_000 or held >= 2_000_000:
                    held = 0
                    yield full()
            yield full()

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, size int, part int, place long" + ", ids array<int>" * with_ids
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(pieces, schema)


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """Pack (doc_id, text) into sequences of at most ``capacity`` ids.

    One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset; with ``with_ids`` also the piece's ids.
    """
    spark = docs.sparkSession
    pieces = materialize(cut(docs, capacity, end_id, vocabulary, with_ids), "pieces")
    counts = pieces.groupBy("size", "part").agg(F.count("*").alias("n"))
    histogram = {r["size"]: r["n"] for r in counts.groupBy("size").agg(F.sum("n").alias("n")).collect()}
    ranges = spark.createDataFrame(slots(plan(histogram, capacity)), "size int, lo long, hi long, first long, per long, slot long")
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = pieces.join(before.select("size", "part", F.coalesce("before", F.lit(0)).alias("before")), ["size", "part"]).withColumn("rank", F.col("place") + F.col("before"))
    r = F.broadcast(ranges).alias("r")  # bounded by the number of size classes, not by the input
    placed = ranked.alias("p").join(r, (F.col("p.size") == F.col("r.size")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    placed = placed.select(
        *[c for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")],
        (F.col("first") + F.floor((F.col("rank") - F.col("lo")) / F.col("per"))).cast("long").alias("sequence_id"),
        (F.col("slot") + (F.col("rank") - F.col("lo")) % F.col("per")).alias("slot"),
        *["ids"] * with_ids,
    )
    earlier = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0)).cast("long")).drop("slot")
