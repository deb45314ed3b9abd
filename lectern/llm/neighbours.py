"""Approximate nearest neighbours by a forest of random-projection trees.

Trees are grown on the driver over a sample of at most about SAMPLE vectors
chosen by hash: a node is cut by the hyperplane between two of its vectors, at
the median, until it holds LEAF of them.  Executors then put every distinct
vector into its leaf of each tree.  A query searches all trees through one
queue ordered by the smallest margin on the way to a node, and takes the first
PROBES leaves; the vectors there are ranked by their exact distance.  What the
forest finds only bounds the k-th distance: every vector is then measured
against the bounds of all queries (a matrix product for each block of either),
and those within them are ranked.  The answers are exact.

Equal vectors are one class: it is indexed and searched once.  Only its
``k + 1`` smallest ids can be among the nearest (ties go to smaller ids), so
no others are kept; the class is never gathered.

Cases: vectors that are null, zero, or hold a null or non-finite component
take no part, nor do those of another dimension than the commonest.  Fewer
candidates than k: all that exist.  An empty table gives no rows.  Rows that
repeat a vec_id are one candidate if their vectors are equal.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_side

SAMPLE, TREES, LEAF, PROBES = 65_536, 8, 64, 60
#: Queries of one pass over the vectors, and rows of a matrix product.
PASS, TILE = 50_000, 256


def grow(vectors: np.ndarray, leaf: int, rng) -> dict:
    """Arrays normal, offset, left, right: children >= 0 are nodes, < 0 leaves (-1 - number)."""
    normal, offset, children, leaves = [], [], [], 0

    def node(rows):
        nonlocal leaves
        if len(rows) > leaf:
            for _ in range(5):
                a, b = vectors[rng.choice(rows, 2, replace=False)]
                n = a - b
                if (size := np.linalg.norm(n)) == 0:
                    continue
                n /= size
                along = vectors[rows] @ n
                cut = float(np.median(along))
                low = along < cut
                if 0 < low.sum() < len(rows):
                    at = len(normal)
                    normal.append(n)
                    offset.append(cut)
                    children.append([0, 0])
                    children[at] = [node(rows[low]), node(rows[~low])]
                    return at
        leaves += 1
        return -leaves

    root = node(np.arange(len(vectors)))
    dim = vectors.shape[1]
    return {"normal": np.array(normal).reshape(-1, dim), "offset": np.array(offset), "children": np.array(children, dtype=np.int64).reshape(-1, 2), "root": root, "leaves": leaves}


def leaf_of(tree: dict, vectors: np.ndarray) -> np.ndarray:
    at = np.full(len(vectors), tree["root"], dtype=np.int64)
    while (on := np.flatnonzero(at >= 0)).size:
        k = at[on]
        side = np.einsum("ij,ij->i", vectors[on], tree["normal"][k]) >= tree["offset"][k]
        at[on] = tree["children"][k, side.astype(np.int64)]
    return -1 - at


def probe(forest: list[dict], vector: np.ndarray, probes: int) -> list[tuple[int, int]]:
    """(tree, leaf): the first ``probes`` leaves by one queue over all trees."""
    margins = [t["normal"] @ vector - t["offset"] for t in forest]
    queue = [(-np.inf, k, t["root"]) for k, t in enumerate(forest)]
    heapq.heapify(queue)
    found = []
    while queue and len(found) < probes:
        far, k, at = heapq.heappop(queue)
        while at >= 0:
            margin = margins[k][at]
            near = int(margin >= 0)
            left = forest[k]["children"][at]
            heapq.heappush(queue, (max(far, abs(margin)), k, int(left[1 - near])))
            at = int(left[near])
        found.append((k, -1 - at))
    return found


def within(distinct: DataFrame, bounds: DataFrame, dim: int, k: int) -> DataFrame:
    """q, node, score: of each (q, embedding, bound), all of ``distinct`` within the bound, or the k + 1 nearest of each batch where that is fewer."""
    asked = bounds.toPandas().sort_values("q")  # one pass's queries
    shared = distinct.sparkSession.sparkContext.broadcast((asked["q"].to_numpy(), np.array(asked["embedding"].tolist(), dtype=np.float64).reshape(len(asked), dim), asked["bound"].to_numpy()))

    def scan(batches):
        import pyarrow as pa

        ids, queries, bound = shared.value
        with np.errstate(over="ignore", invalid="ignore"):
            q_norm = (queries**2).sum(axis=1)
            for batch in batches:
                if not batch.num_rows:
                    continue
                node = batch.column(0).to_numpy()
                x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
                x_norm = (x**2).sum(axis=1)
                for lo in range(0, len(ids), TILE):
                    hi = min(lo + TILE, len(ids))
                    both = q_norm[lo:hi, None] + x_norm
                    # More than rounding can take away; what is not a number is measured.
                    far = both - 2 * (queries[lo:hi] @ x.T) > (bound[lo:hi, None] ** 2) * (1 + 1e-9) + both * 1e-9
                    out = [[], [], []]
                    for q in np.flatnonzero(~far.all(axis=1)):
                        at = np.flatnonzero(~far[q])
                        d = np.sqrt(((x[at] - queries[lo + q]) ** 2).sum(axis=1))
                        near = np.lexsort((node[at], d))[: k + 1]
                        out[0].append(np.full(len(near), ids[lo + q]))
                        out[1].append(node[at][near])
                        out[2].append(d[near])
                    if out[0]:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in out], ["q", "node", "score"])

    return distinct.select("node", "embedding").mapInArrow(scan, "q long, node long, score double")


def nearest(vectors: DataFrame, is_query, k: int = 10, sample: int = SAMPLE, trees: int = TREES, leaf: int = LEAF, probes: int = PROBES, seed: int = 7) -> DataFrame:
    """query_id, rank, vec_id, score: each query row's k nearest of the other rows of (vec_id, embedding)."""
    spark = vectors.sparkSession
    e = F.col("embedding").cast("array<double>")
    usable = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = vectors.where(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding"), is_query.alias("asks")).where(usable)
    # Signed zeros are equal.
    rows = rows.withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0)))
    rows = materialize(rows.withColumn("c", F.struct(F.xxhash64("embedding").alias("a"), F.hash("embedding").alias("b"))).select("vec_id", "embedding", "asks", "c.a", "c.b"), "vectors")
    dims = rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if dims is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("embedding") == dims["d"])
    distinct = materialize(rows.groupBy("a", "b", "embedding").agg(F.min("vec_id").alias("node"), F.max("asks").alias("asks")), "distinct")
    # The class's smallest ids: the limit on rank is applied before the shuffle.
    few = rows.select("a", "b", "vec_id").withColumn("r", F.dense_rank().over(Window.partitionBy("a", "b").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    few = materialize(few.dropDuplicates(["a", "b", "vec_id"]).select("a", "b", "vec_id"), "members")
    n = distinct.count()
    share = min(1.0, sample / n)
    part = distinct.where(F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1)).select("node", "embedding").toPandas().sort_values("node")
    at = np.array(part["embedding"].tolist(), dtype=np.float64).reshape(len(part), dims["d"])
    rng = np.random.default_rng(seed)
    forest = spark.sparkContext.broadcast([grow(at, leaf, rng) for _ in range(trees)])  # bounded by the sample

    def place(batches):
        import pyarrow as pa

        grown = forest.value
        for batch in batches:
            emb = batch.column(1)
            if not batch.num_rows:
                continue
            x = emb.flatten().to_numpy().reshape(batch.num_rows, -1)
            for t, tree in enumerate(grown):
                keys = leaf_of(tree, x) * len(grown) + t
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([0] * len(keys), pa.int8()), batch.column(0), emb], ["leaf", "kind", "node", "embedding"])
            on = np.flatnonzero(batch.column(2).to_numpy(zero_copy_only=False))
            for at in range(0, len(on), 64):
                which, keys = [], []
                for i in on[at : at + 64]:
                    got = probe(grown, x[i], probes)
                    which += [i] * len(got)
                    keys += [leaf * len(grown) + t for t, leaf in got]
                which = pa.array(which)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([1] * len(keys), pa.int8()), batch.column(0).take(which), emb.take(which)], ["leaf", "kind", "node", "embedding"])

    def rank(batches):
        """Rows come sorted by leaf, vectors before queries; at most one leaf is held."""
        import pyarrow as pa

        now, ids, held = None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            leaf, kind, node = (batch.column(j).to_numpy() for j in range(3))
            x = batch.column(3).flatten().to_numpy().reshape(batch.num_rows, -1)
            edges = np.flatnonzero(np.concatenate([[True], (leaf[1:] != leaf[:-1]) | (kind[1:] != kind[:-1])]))
            for lo, hi in zip(edges, [*edges[1:], len(leaf)]):
                if leaf[lo] != now:
                    now, ids, held = leaf[lo], [], []
                if kind[lo] == 0:
                    ids.append(node[lo:hi].copy())
                    held.append(x[lo:hi].copy())
                    continue
                if not ids:
                    continue
                if len(ids) > 1:
                    ids, held = [np.concatenate(ids)], [np.concatenate(held)]
                out = [[], [], []]
                for q in range(lo, hi):
                    d = np.sqrt(((held[0] - x[q]) ** 2).sum(axis=1))
                    near = np.lexsort((ids[0], d))[: k + 1]
                    out[0].append(np.full(len(near), node[q]))
                    out[1].append(ids[0][near])
                    out[2].append(d[near])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in out], ["q", "node", "score"])

    placed = distinct.select("node", "embedding", "asks").mapInArrow(place, "leaf long, kind byte, node long, embedding array<double>")
    found = placed.repartition("leaf").sortWithinPartitions("leaf", "kind").mapInArrow(rank, "q long, node long, score double")
    found = found.groupBy("q", "node").agg(F.min("score").alias("score"))
    by_class = Window.partitionBy("q").orderBy("score", "node")
    found = found.withColumn("r", F.row_number().over(by_class)).where(F.col("r") <= k + 1)
    # Fewer than k + 1 found: no bound.
    bounds = found.groupBy("q").agg(F.when(F.count("*") > k, F.max("score")).otherwise(float("inf")).alias("bound"))
    bounds = distinct.where("asks").select(F.col("node").alias("q"), "embedding").join(bounds, "q", "left").select("q", "embedding", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
    bounds = materialize(bounds, "bounds")
    passes = -(-bounds.count() // PASS)
    found = None
    for number in range(passes):
        part = bounds if passes == 1 else bounds.where(F.pmod(F.xxhash64("q"), F.lit(passes)) == number)
        part = within(distinct, part, dims["d"], k)
        found = part if found is None else found.union(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = materialize(found.withColumn("r", F.row_number().over(by_class)).where(F.col("r") <= k + 1).select("q", "node", "score"), "near")
    key = distinct.select("a", "b", "node")
    answers = found.join(key, "node").join(few, ["a", "b"]).select("q", "vec_id", "score")
    # A query's answers hold k + 1 at least where they exist, for one may be the query itself.
    answers = answers.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("score", "vec_id"))).where(F.col("r") <= k + 1).drop("r")
    asking = rows.where("asks").select("a", "b", F.col("vec_id").alias("query_id")).distinct().join(key, ["a", "b"]).select("query_id", F.col("node").alias("q"))
    out = asking.join(answers, "q").where("query_id <> vec_id")
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return out.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
