"""The extraction step: a pluggable extractor over chunks, retries, and the ordered edition.

An extractor is called on executors as ``extractor(chunk, options) -> str``;
chunk is a dict with prompt and the chunk's columns.  The default one gives
the chunk's visible text, so that every query has a defined answer.
"""

from __future__ import annotations

import html as entities
import re
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as TookTooLong

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalised_output, trimmed

ATTEMPTS, CONCURRENCY, TIMEOUT = 2, 2, 240.0
#: What another attempt cannot mend (fixed value).
LASTING = re.compile(r"(?i)cancelled|not authenticated|authentication required|unauthorized|is unavailable")

Extractor = Callable[[dict, dict], str]


def retryable(message: str) -> bool:
    return not LASTING.search(message)


def retryable_column(message: Column) -> Column:
    return ~F.coalesce(message.rlike(LASTING.pattern), F.lit(False))


def visible_text(chunk: dict, options: dict) -> str:
    """The chunk's text without tags, a paragraph for each section."""
    texts = [re.sub(r"[ \t\r\n\f\v]+", " ", entities.unescape(re.sub(r"<[^>]*>", " ", s["content"]))).strip() for s in chunk["sections"] or []]
    return "\n\n".join(t for t in texts if t)


def attempts(extractor: Extractor, chunk: dict, options: dict, pool: ThreadPoolExecutor, timeout: float) -> tuple[str | None, str | None, int]:
    """(text, error, attempts made)."""
    error = None
    for n in range(1, ATTEMPTS + 1):
        try:
            return pool.submit(extractor, chunk, options).result(timeout), None, n
        except TookTooLong:
            error = f"no answer within {timeout:g} s"
        except Exception as e:
            error = str(e) or type(e).__name__
        if not retryable(error):
            return None, error, n
    return None, error, ATTEMPTS


def extract_chunks(chunks: DataFrame, extractor: Extractor = visible_text, options: dict | None = None, concurrency: int = CONCURRENCY, timeout: float = TIMEOUT) -> DataFrame:
    """doc_id, chunk, total, output, error, attempts, millis of (doc_id, chunk, total, ...): every chunk up to two attempts.

    In a task one or two chunks are in flight, in order; a chunk's failure is
    its row's error, and ``editions`` drops its document.
    """
    given, width = dict(options or {}), max(1, min(2, concurrency))

    def run(batches):
        import pyarrow as pa

        # An extractor that never answers keeps its thread, not its place.
        callers, calls = ThreadPoolExecutor(width), ThreadPoolExecutor(64)

        def one(row):
            began = time.monotonic()
            text, error, n = attempts(extractor, row, given, calls, timeout)
            return {"doc_id": row["doc_id"], "chunk": row["chunk"], "total": row["total"], "output": text, "error": error, "attempts": n, "millis": round(1000 * (time.monotonic() - began))}

        try:
            for batch in batches:
                rows = list(callers.map(one, batch.to_pylist()))
                yield pa.RecordBatch.from_pylist(rows, schema=kind)
        finally:
            callers.shutdown(wait=False)
            calls.shutdown(wait=False)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    made = f"doc_id {chunks.schema['doc_id'].dataType.simpleString()}, chunk long, total long, output string, error string, attempts int, millis long"
    kind = to_arrow_schema(StructType.fromDDL(made))
    found = chunks.mapInArrow(run, made)
    return found.withColumn("output", F.when(F.col("output").isNotNull(), normalised_output(F.col("output"))))


def editions(outputs: DataFrame) -> DataFrame:
    """doc_id, content, chunks, error: the outputs of a document in order, trimmed, a blank line between them.

    A document with a failed chunk has no content and its first chunk's error.
    """
    part = F.struct("chunk", trimmed(F.col("output")).alias("t"))
    made = outputs.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(part)).alias("p"),
        F.count("*").alias("chunks"),
        F.min(F.when(F.col("error").isNotNull(), F.struct("chunk", "error"))).getField("error").alias("error"),
    )
    content = F.concat(F.array_join(F.transform("p", lambda x: x["t"]), "\n\n"), F.lit("\n"))
    return made.select("doc_id", F.when(F.col("error").isNull(), content).alias("content"), "chunks", "error")
