"""Near-duplicates by MinHash with tensored banding.

A plain banding scheme with L tables of k minimum hashes computes L*k of them.
Tensoring (Andoni and Indyk, 2006; Christiani, 2019) draws two small
collections of m sub-keys, each of k/2 minimum hashes, and forms a table's key
from one sub-key of either collection: m*m tables from m*k minimum hashes.
With m = 8 and k = 4 (32 minimum hashes, 64 tables) a pair of similarity 0.8
shares a table with probability (1 - (1 - 0.64)^8)^2 = 0.9994.

1. One pass makes each text's shingle set, its size, a 128-bit digest of it and
   its sub-keys.  Equal sets form a class and go on as one representative.
2. Sub-keys that no other class has are dropped before any table key is made.
3. Buckets of few classes compare all their pairs; in a larger one every member
   is compared with the most central class.  Links are confirmed on full sets,
   and form connected components.
4. Larger buckets that still hold more than one component are finished exactly:
   their members are joined on shingles that a link cannot do without (prefix
   filter: of a set's shingles, rarest first, one of the first tenth or fifth
   must be common), pairs of one component left out, and confirmed likewise.
   So no pair that shares a bucket is lost, whatever the bucket's size.

No group is ever collected: the central class is an aggregate, pairs are
bounded by it, by the small buckets, or by the prefix filter with its bounds on
sizes and positions, and joins on keys can be split.

Cases: a null text, or one without words, has an empty set and is linked with
nothing.  Fewer words than the shingle's are one shingle.  Rows that repeat a
doc_id are one document to the components (each row is returned); if their
texts differ, it is linked by any of them.  An empty table gives no rows.  Rows
with a null doc_id are returned with null component_id.  Other columns of the
input are ignored, whatever their names.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, small_side
from .components import connected_components
from .wordhash import ascii_lower, mix, whitespace_delimiters, word_batches

#: Sub-keys in either collection, and minimum hashes in a sub-key.
COLLECTION, PER_KEY = 8, 2
#: Buckets of so many classes compare all their pairs.
SMALL = 8


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, width: int):
    """Distinct shingle hashes of each text, sorted: (hashes, bounds).  Fewer words than ``width`` are one shingle."""
    n = np.diff(bounds)
    count = np.where(n > 0, np.maximum(n - width + 1, 1), 0)
    begins = np.zeros(len(n) + 1, dtype=np.int64)
    np.cumsum(count, out=begins[1:])
    owner = np.repeat(np.arange(len(n)), count)
    at = bounds[:-1][owner] + np.arange(begins[-1]) - begins[:-1][owner]
    padded = np.concatenate([words, np.zeros(width, dtype=np.uint64)])
    out = np.zeros(len(at), dtype=np.uint64)
    last = bounds[1:][owner]
    for k in range(width):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + np.where(at + k < last, padded[at + k], np.uint64(k + 1)))
    order = np.lexsort((out, owner))
    out, owner = out[order], owner[order]
    keep = np.ones(len(out), dtype=bool)
    keep[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    out, owner = out[keep], owner[keep]
    return out, np.searchsorted(owner, np.arange(len(n) + 1))


def sub_keys(sets: np.ndarray, bounds: np.ndarray, collection: int, per_key: int, seed: int) -> np.ndarray:
    """The 2*collection sub-keys of each non-empty set (rows) of consecutive, non-empty ranges."""
    rng = np.random.default_rng(seed)
    starts = bounds[:-1]
    out = np.empty((len(starts), 2 * collection), dtype=np.uint64)
    for k in range(2 * collection):
        key = np.full(len(starts), k, dtype=np.uint64)
        for _ in range(per_key):
            a, b = rng.integers(1, 1 << 63, 2, dtype=np.uint64)
            h = sets * (a | np.uint64(1)) + b
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xD6E8FEB86659FD93)
            key = mix(key ^ np.minimum.reduceat(h, starts))
        out[:, k] = key
    return out


def profiles(docs: DataFrame, width: int, seed: int) -> DataFrame:
    """doc_id, n_shingles, d1, d2 (digest of the set), keys (sub-keys; empty for an empty set)."""

    def run(batches):
        import pyarrow as pa

        lower, delimiter = ascii_lower(), whitespace_delimiters()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for first, last, words, bounds in word_batches(texts, lower, delimiter):
                sets, ends = shingle_hashes(words, bounds, width)
                n = np.diff(ends)
                some = np.flatnonzero(n)
                keys = np.zeros((last - first, 2 * COLLECTION), dtype=np.int64)
                d = np.zeros((2, last - first), dtype=np.int64)
                if len(some):
                    span = np.append(ends[:-1][some], ends[-1])
                    keys[some] = sub_keys(sets, span, COLLECTION, PER_KEY, seed).view(np.int64)
                    d[0, some] = np.add.reduceat(mix(sets ^ np.uint64(0xA5A5A5A5A5A5A5A5)), span[:-1]).view(np.int64)
                    d[1, some] = np.add.reduceat(mix(sets * np.uint64(0xC2B2AE3D27D4EB4F)), span[:-1]).view(np.int64)
                offsets = np.zeros(last - first + 1, dtype=np.int32)
                np.cumsum((n > 0) * (2 * COLLECTION), out=offsets[1:])
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, last - first), pa.array(n, pa.int64()), pa.array(d[0]), pa.array(d[1]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[some].ravel()))],
                    ["doc_id", "n_shingles", "d1", "d2", "keys"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, keys array<long>")


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """node, shingles: the sorted distinct shingle hashes of each text, 8 bytes each."""

    def run(batches):
        import pyarrow as pa

        lower, delimiter = ascii_lower(), whitespace_delimiters()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for first, last, words, bounds in word_batches(texts, lower, delimiter):
                sets, ends = shingle_hashes(words, bounds, width)
                raw = [sets[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays([ids.slice(first, last - first), pa.array(raw, pa.binary())], ["node", "shingles"])

    made = docs.select("node", "text").mapInArrow(run, "node long, shingles binary")
    return made.groupBy("node").agg(F.collect_set("shingles").alias("shingles")).select("node", F.explode("shingles").alias("shingles"))


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those (u, v) whose full sets have 100 * intersection >= percent * union."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            a, b = batch.column(2), batch.column(3)
            keep = np.zeros(batch.num_rows, dtype=bool)
            for k in range(batch.num_rows):
                x, y = np.frombuffer(a[k].as_buffer(), np.uint64), np.frombuffer(b[k].as_buffer(), np.uint64)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    continue
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep[k] = 100 * common >= percent * (len(x) + len(y) - common)
            yield batch.select(["u", "v"]).filter(pa.array(keep))

    left = sets.select(F.col("node").alias("u"), F.col("shingles").alias("a"))
    right = sets.select(F.col("node").alias("v"), F.col("shingles").alias("b"))
    joined = pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b")
    return joined.mapInArrow(run, "u long, v long")


def buckets(members: DataFrame) -> DataFrame:
    """key, size, pivot, pn: buckets of (key, node, n, weight) with more than one member, and the node and size of the most central."""
    central = F.max(F.struct("weight", F.negative("node").alias("low"), "n"))
    stats = members.groupBy("key").agg(F.count("*").alias("size"), central.alias("central")).where("size > 1")
    return stats.select("key", "size", F.negative("central.low").alias("pivot"), F.col("central.n").alias("pn"))


def candidate_pairs(members: DataFrame, stats: DataFrame, percent: int) -> DataFrame:
    """(u, v): each member of (key, node, n, weight) with its bucket's pivot, and all pairs of small buckets."""
    met = members.join(stats, "key")
    fits = (100 * F.least("n", "pn") >= percent * F.greatest("n", "pn")) & (F.col("node") != F.col("pivot"))
    pairs = met.where(fits).select(F.least("node", "pivot").alias("u"), F.greatest("node", "pivot").alias("v"))
    few = met.where(f"size between 3 and {SMALL}").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("node", "n"))).alias("m"))
    few = few.select(F.posexplode("m").alias("i", "x"), "m").select("x", F.explode(F.slice("m", F.col("i") + 2, SMALL)).alias("y"))
    few = few.where((100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")) & (F.col("x.node") != F.col("y.node")))
    return pairs.union(few.select(F.col("x.node").alias("u"), F.col("y.node").alias("v"))).distinct()


def table_keys(kept: DataFrame) -> DataFrame:
    """(key, node, n, weight): the tensored table keys of (node, n, weight, subs)."""
    made = kept.select("node", "n", "weight", "subs", F.explode(F.filter("subs", lambda s: s["k"] < COLLECTION)).alias("s"))
    made = made.select("node", "n", "weight", "s", F.explode(F.filter("subs", lambda s: s["k"] >= COLLECTION)).alias("t"))
    return made.select(F.xxhash64("s.key", "t.key").alias("key"), "node", "n", "weight")


def shingle_rows(sets: DataFrame) -> DataFrame:
    """(node, n, component, h) of (node, shingles, component)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                h = np.frombuffer(batch.column(1)[k].as_buffer(), np.int64)
                for at in range(0, len(h), 65_536):
                    part = h[at : at + 65_536]
                    same = lambda x, kind=pa.int64(), m=len(part): pa.array(np.full(m, x), kind)
                    yield pa.RecordBatch.from_arrays([same(batch.column(0)[k].as_py()), same(len(h)), same(batch.column(2)[k].as_py()), pa.array(part)], ["node", "n", "component", "h"])

    return sets.select("node", "shingles", "component").mapInArrow(run, "node long, n long, component long, h long")


def rest_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """(u, v): all pairs of different components of (node, shingles, component) that may reach ``percent``, and few others.

    Let x be the smaller of two linked sets and y the larger, both in one order
    of shingles.  They have at least percent / (100 + percent) * (|x| + |y|)
    shingles in common, so the first common one is among the first
    |x| - 2 * percent / (100 + percent) * |x| of x and |y| - percent / 100 * |y|
    of y, and behind it either has as many left as they have in common.
    """
    each = shingle_rows(sets)
    common = each.groupBy("h").agg(F.count("*").alias("df"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("df > 1")
    # What no other set has comes first in the order and need not be listed; what one component alone has keeps its place but links nothing.
    listed = each.join(common.select("h", "df", (F.col("lo") != F.col("hi")).alias("useful")), "h")
    order = F.sort_array(F.collect_list(F.struct("df", "h", "useful")))
    listed = listed.groupBy("node", "n", "component").agg(order.alias("s")).withColumn("alone", F.col("n") - F.size("s"))
    # A set's size class: linked sets are in one, or in neighbours.
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent)) + 1e-9)
    first = F.floor(F.col("n") * (100 - percent) / 100.0 + 1e-9) + 1
    cut = F.slice("s", F.lit(1), F.greatest((first - F.col("alone")).cast("int"), F.lit(0)))
    listed = listed.select("node", "n", "component", "alone", band.alias("band"), F.posexplode(cut).alias("at", "s")).where("s.useful")
    listed = listed.select("node", "n", "component", "band", (F.col("alone") + F.col("at")).alias("at"), F.col("s.h").alias("h"))
    listed = materialize(listed, "prefixes")
    small = listed.where((100 + percent) * F.col("at") <= (100 - percent) * F.col("n")).select(F.col("node").alias("x"), F.col("n").alias("nx"), F.col("component").alias("cx"), F.col("at").alias("ax"), "h", "band")
    large = listed.select(F.col("node").alias("y"), F.col("n").alias("ny"), F.col("component").alias("cy"), F.col("at").alias("ay"), "h", F.explode(F.array("band", F.col("band") - 1)).alias("band"))
    left = F.least(F.col("nx") - F.col("ax"), F.col("ny") - F.col("ay"))
    may = ((F.col("nx") < F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("x") < F.col("y")))) & (F.col("cx") != F.col("cy"))
    may = may & (100 * F.col("nx") >= percent * F.col("ny")) & ((100 + percent) * left >= percent * (F.col("nx") + F.col("ny")))
    met = small.alias("l").join(large.alias("r"), (F.col("l.h") == F.col("r.h")) & (F.col("l.band") == F.col("r.band")) & may)
    pairs = materialize(met.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct(), "rest-pairs")
    discard(listed)
    return pairs


def link_documents(docs: DataFrame, width: int = 4, percent: int = 80, seed: int = 20240) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: documents linked with 100 * intersection >= percent * union of their shingle sets."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = materialize(profiles(docs, width, seed), "profiles")
    real = rows.where("n_shingles > 0 and doc_id is not null")
    classes = materialize(
        real.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"), F.first("keys").alias("keys")), "classes"
    )
    subs = classes.select("node", F.posexplode("keys").alias("k", "key"))
    common = subs.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    kept = subs.join(common, "key").groupBy("node").agg(F.sum("df").alias("near"), F.collect_list(F.struct("k", "key")).alias("subs"))
    kept = kept.join(classes.select("node", "copies", F.col("n_shingles").alias("n")), "node")
    kept = materialize(kept.select("node", "n", "subs", (F.col("near") + F.lit(16) * F.col("copies")).alias("weight")), "subkeys")

    members = table_keys(kept)
    stats = materialize(buckets(members), "buckets")
    pairs = materialize(candidate_pairs(members, stats, percent), "pairs")
    nodes = materialize(pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct(), "nodes")
    held = docs.withColumnRenamed("doc_id", "node").join(small_side(nodes, nodes.count(), 16), "node", "left_semi")
    sets = materialize(shingle_sets(held, width), "sets")
    links = materialize(confirm(pairs, sets, percent), "links")
    discard(pairs, nodes)
    component = connected_components(links)
    # Members of larger buckets that hold more than one component.
    large = members.join(stats.where(f"size > {SMALL}").select("key"), "key").join(component, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    mixed = large.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    rest = materialize(large.join(mixed, "key", "left_semi").select("node", "component").distinct(), "rest")
    if not rest.isEmpty():
        more = rest_pairs(sets.join(rest, "node"), percent)
        found = materialize(confirm(more, sets, percent), "links")
        discard(more)
        if not found.isEmpty():
            joined = component
            component = connected_components(links.union(found))
            discard(joined)
        discard(found)
    discard(kept, stats, sets, links, rest)
    by_class = classes.select("d1", "d2", "n_shingles", "node").join(component, "node", "left").select("d1", "d2", "n_shingles", F.coalesce("component", "node").alias("component_id"))
    out = rows.select("doc_id", "n_shingles", "d1", "d2").join(by_class, ["d1", "d2", "n_shingles"], "left")
    # A null doc_id is in no class; an empty set is its own.
    out = out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose document is the smallest doc_id of its component, with all their columns.

    Shingles have five words, the usual width of near-duplicate stages (op1's
    contract has four).  Of rows that repeat a doc_id one is kept.  A document
    without words is kept; of rows with a null doc_id one of each text.
    """
    # Rows that are kept must be known by id alone: ids to be dropped are anti-joined.
    found = link_documents(docs, width, percent).groupBy("doc_id").agg(F.bool_and("kept").alias("kept"), F.count("*").alias("n"))
    key = f"_marked_{uuid.uuid4().hex}"
    marked = materialize(found.where("not kept or n > 1 or doc_id is null").select(F.col("doc_id").alias(key), F.coalesce("kept", F.lit(True)).alias("kept")), "marked")
    n = marked.count()
    known = docs["doc_id"].cast("long").eqNullSafe(F.col(key))
    rest = docs.join(small_side(marked.select(key), n, 16), known, "left_anti")
    repeated = marked.where("kept").select(key)
    if repeated.isEmpty():
        return rest
    # Ids on several rows, or null: only these rows are shuffled.
    again = docs.join(small_side(repeated, n, 16), known, "left_semi")
    return rest.unionByName(again.where("doc_id is not null").dropDuplicates(["doc_id"])).unionByName(again.where("doc_id is null").dropDuplicates(["text"]))
