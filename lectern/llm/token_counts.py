"""Token counts of flat, unindexed token files by a separator scan.

A token file is a run of little-endian unsigned 16-bit ids; each document ends
with the end-of-document id, and nothing tells where documents begin.  Files
are scanned in blocks of a fixed number of ids: one vectorised comparison
finds a block's separators, and a prefix scan over the blocks' summaries gives
each block the number of documents that ended before it and the ids of the
document that runs into it.  A block is read by offset, so no file is ever
held whole, and only one summary row per block is shuffled.

Cases: a null or empty text is a document of 0 ids.  A file that does not end
with the separator has a last, unended document, which is counted and marked.
An empty file has no documents.  Special-token strings in texts are encoded as
ordinary text, so they never look like separators.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, qualified, scratch
from .tokens import VOCABULARY, encoder

END_ID = 50256
#: Ids in a block (8 MB).
BLOCK_IDS = 1 << 22
#: Ids in a file, about; a document is never split over files.
FILE_IDS = 1 << 27


def write_token_files(docs: DataFrame, folder: str, end_id: int = END_ID, vocabulary: str = VOCABULARY, file_ids: int = FILE_IDS) -> DataFrame:
    """Write (doc_id, text) as token files into ``folder``, each task its own; returns path, ordinal and doc_id of each document.

    File names are unique to a task's attempt, and the returned table is
    written before use: a repeated task leaves files that no row names.
    """

    folder = qualified(docs.sparkSession, folder)

    def write(batches):
        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        encode, task = encoder(vocabulary, True), TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        sink, name, ordinal, held = None, "", 0, 0
        for batch in batches:
            paths, ordinals = [], []
            for text in batch.column(1):
                ids = encode(text.as_py())
                if sink is None or held + len(ids) > file_ids and held:
                    if sink is not None:
                        sink.close()
                    name = f"tokens-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.bin"
                    sink, ordinal, held = store.open_output_stream(f"{root}/{name}"), 0, 0
                sink.write(np.array([*ids, end_id], dtype="<u2").tobytes())
                paths.append(f"{folder}/{name}")
                ordinals.append(ordinal)
                ordinal, held = ordinal + 1, held + len(ids) + 1
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(ordinals, pa.int64()), batch.column(0)], ["path", "ordinal", "doc_id"])
        if sink is not None:
            sink.close()

    return materialize(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(write, "path string, ordinal long, doc_id long"), "manifest")


def count_tokens(spark: SparkSession, paths: DataFrame, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> DataFrame:
    """path, ordinal, n_tokens, ended: one row per document of the token files named by ``paths`` (a table of distinct paths)."""

    def blocks(batches):
        import pyarrow as pa
        from pyarrow import fs

        for batch in batches:
            paths, blocks, sizes = [], [], []
            for path in batch.column(0).to_pylist():
                store, name = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
                n = store.get_file_info(name).size // 2
                for k in range(-(-n // block_ids)):
                    paths.append(path)
                    blocks.append(k)
                    sizes.append(min(block_ids, n - k * block_ids))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(blocks, pa.int64()), pa.array(sizes, pa.int64())], ["path", "block", "n"])

    def scan(batches):
        import pyarrow as pa
        from pyarrow import fs

        for batch in batches:
            for path, block, n in zip(*(c.to_pylist() for c in batch.columns)):
                store, name = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
                with store.open_input_file(name) as f:
                    f.seek(2 * block * block_ids)
                    ids = np.frombuffer(f.read(2 * n), dtype="<u2")
                at = np.flatnonzero(ids == end_id).astype(np.int64)
                lengths = np.diff(at, prepend=-1) - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path]), pa.array([block], pa.int64()), pa.array([len(at)], pa.int64()), pa.array([int(n - 1 - at[-1]) if len(at) else n], pa.int64()), pa.array([lengths], pa.list_(pa.int64()))],
                    ["path", "block", "ends", "tail", "lengths"],
                )

    listed = paths.select("path").distinct().mapInArrow(blocks, "path string, block long, n long")
    listed = listed.repartition("path", "block")
    found = listed.mapInArrow(scan, "path string, block long, ends long, tail long, lengths array<long>")
    found = materialize(found, "blocks")
    order = Window.partitionBy("path").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    summary = found.select("path", "block", "ends", "tail")
    # The open document at a block's start: the tail after the last block with a separator, and all blocks since.
    summary = (
        summary.withColumn("base", F.coalesce(F.sum("ends").over(before), F.lit(0)))
        .withColumn("run", F.sum(F.when(F.col("ends") > 0, 1).otherwise(0)).over(order))
        .withColumn("open", F.sum("tail").over(Window.partitionBy("path", "run").orderBy("block")))
        .withColumn("carry", F.coalesce(F.lag("open").over(order), F.lit(0)))
        .withColumn("last", F.lead("block").over(order).isNull())
    )
    whole = found.select("path", "block", "lengths").join(summary, ["path", "block"])
    ended = whole.select("path", "base", "carry", F.posexplode("lengths").alias("k", "n")).select(
        "path", (F.col("base") + F.col("k")).alias("ordinal"), (F.col("n") + F.when(F.col("k") == 0, F.col("carry")).otherwise(0)).alias("n_tokens"), F.lit(True).alias("ended")
    )
    unended = summary.where("last and open > 0").select("path", (F.col("base") + F.col("ends")).alias("ordinal"), F.col("open").alias("n_tokens"), F.lit(False).alias("ended"))
    return ended.unionByName(unended)


def count_documents(docs: DataFrame, vocabulary: str = VOCABULARY, block_ids: int = BLOCK_IDS) -> DataFrame:
    """doc_id, n_tokens: documents written to token files and counted there."""
    spark = docs.sparkSession
    manifest = write_token_files(docs, scratch(spark, "tokens"), vocabulary=vocabulary)
    counted = count_tokens(spark, manifest.select("path"), block_ids=block_ids)
    return manifest.join(counted, ["path", "ordinal"]).select("doc_id", "n_tokens", "ordinal", "ended")
