"""Uploads in pieces: frames, requests, ordered reassembly, as batch and as stream.

Requests of one upload are handled strictly in order.  ``advance`` is the whole
protocol; the batch form runs it over sorted rows, the stream form over state
that Spark keeps.  Neither holds what was uploaded: accepted pieces are rows of
their own, and ``payloads`` joins those of a committed upload.
"""

from __future__ import annotations

import base64
import binascii
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the protocol.
FRAME_LIMIT, RESPONSE_LIMIT, PAGE_LIMIT, PDF_LIMIT = 8 * 1024 * 1024, 1_000_000, 256_000_000, 192 * 1024 * 1024
READ_LIMIT, SLICE_UNITS, SLICE_BYTES = 120_000, 750_000, 512_000
TYPES = ("ping", "extract-begin", "extract-pdf-begin", "extract-chunk", "extract-pdf-chunk", "extract-commit", "read-output", "open-folder", "open-output", "open-output-folder")

REQUEST = "id string, type string, totalBytes long, index long, data string, url string, title string, path string, offset long, length long, options struct<format: string, fast: boolean, includeImages: boolean, model: string, customInstructions: string>"
STATE = "kind string, expected long, received long, next_index long, session long"
OUTCOME = "id string, seq long, type string, session long, accepted boolean, index long, bytes long, message string, error string"


def decode_frames(chunks: DataFrame) -> DataFrame:
    """connection, n, body, error of (connection, seq, data): frames of a little-endian length and JSON.

    A frame may begin and end in any piece.  A length over 8 MiB ends its
    connection with an error row; what is left unended gives nothing.
    """

    def run(batches):
        import pyarrow as pa

        now, held, n, dead = None, bytearray(), 0, False
        for batch in batches:
            rows = []
            for connection, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if connection != now:
                    now, held, n, dead = connection, bytearray(), 0, False
                if dead:
                    continue
                held += data or b""
                at = 0
                while len(held) - at >= 4:
                    size = int.from_bytes(held[at : at + 4], "little")
                    if size > FRAME_LIMIT:
                        rows.append({"connection": connection, "n": n, "body": None, "error": "request is too large"})
                        dead = True
                        break
                    if len(held) - at < size + 4:
                        break
                    rows.append({"connection": connection, "n": n, "body": held[at + 4 : at + 4 + size].decode("utf-8", "replace"), "error": None})
                    n, at = n + 1, at + 4 + size
                del held[:at]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("connection", pa.string()), ("n", pa.int64()), ("body", pa.string()), ("error", pa.string())]))

    rows = chunks.select(F.col("connection").cast("string"), F.col("seq").cast("long"), F.col("data").cast("binary"))
    return rows.repartition("connection").sortWithinPartitions("connection", "seq").mapInArrow(run, "connection string, n long, body string, error string")


def encode_frame(body: Column) -> Column:
    """The frame of a response, or null if it is over 1 MB."""
    size = F.octet_length(body)
    little = F.concat(*[F.substring(F.lpad(F.hex(size), 8, "0"), 7 - 2 * k, 2) for k in range(4)])
    return F.when(size <= RESPONSE_LIMIT, F.concat(F.unhex(little), F.encode(body, "UTF-8")))


def requests(bodies: DataFrame, body: str = "body") -> DataFrame:
    """The rows with their request ``r`` and ``error``: JSON with a known type, sizes in bounds and options by default."""
    r = F.from_json(body, REQUEST)
    rows = bodies.withColumn("r", r)
    options = F.struct(
        F.coalesce("r.options.format", F.lit("md")).alias("format"),
        F.coalesce("r.options.fast", F.lit(False)).alias("fast"),
        F.coalesce("r.options.includeImages", F.lit(True)).alias("includeImages"),
        F.coalesce(F.trim("r.options.model"), F.lit("default")).alias("model"),
        F.coalesce(F.trim("r.options.customInstructions"), F.lit("")).alias("customInstructions"),
    )
    kind, total = F.col("r.type"), F.col("r.totalBytes")
    begins, piece = kind.isin("extract-begin", "extract-pdf-begin"), kind.isin("extract-chunk", "extract-pdf-chunk")
    said = F.col("r.data")
    error = (
        F.when(F.col("r").isNull() | F.col("r.id").isNull() | (F.length("r.id") > 100), "no request id")
        .when(~F.coalesce(kind.isin(*TYPES), F.lit(False)), "unknown request type")
        .when(begins & ~F.coalesce(total.between(1, F.when(kind == "extract-begin", PAGE_LIMIT).otherwise(PDF_LIMIT)), F.lit(False)), "size out of bounds")
        .when((kind == "extract-pdf-begin") & ~F.coalesce(F.lower("r.url").rlike("^(https?|file):"), F.lit(False)), "no source url")
        .when(begins & ~options["format"].isin("txt", "md", "pdf"), "unknown format")
        .when(begins & (F.length(options["customInstructions"]) > 4000), "instructions are too long")
        .when(piece & ~F.coalesce(F.col("r.index").between(0, 1000), F.lit(False)), "index out of bounds")
        .when((kind == "extract-chunk") & ~F.coalesce(F.length(said) <= 1_000_000, F.lit(False)), "piece is too long")
        .when((kind == "extract-pdf-chunk") & ~F.coalesce((F.length(said) <= 900_000) & (F.length(said) % 4 == 0) & said.rlike("^[A-Za-z0-9+/]*={0,2}\\z"), F.lit(False)), "piece is no canonical base64")
        .when((kind == "read-output") & ~F.coalesce(F.coalesce("r.length", F.lit(READ_LIMIT)).between(1, READ_LIMIT) & (F.coalesce("r.offset", F.lit(0)) >= 0), F.lit(False)), "range out of bounds")
    )
    return rows.withColumn("r", F.col("r").withField("options", F.when(begins, options))).withColumn("error", error)


def advance(state: tuple | None, request: dict) -> tuple[tuple | None, dict]:
    """(state, outcome) after one request of an upload.  state: (kind, expected, received, next index, session).

    A second begin replaces the first.  Pieces must come in order and fit the
    declared size; a bad one changes nothing.  A commit ends the upload, whether
    it is whole or not.
    """
    kind, session = request["type"], state[4] if state else -1
    out = {"accepted": False, "session": session, "index": request.get("index"), "bytes": 0, "message": None, "error": None}
    if kind in ("extract-begin", "extract-pdf-begin"):
        pdf, session = kind == "extract-pdf-begin", request["seq"]
        out |= {"accepted": True, "session": session, "message": "Receiving selected PDF" if pdf else "Receiving captured page"}
        return ("pdf" if pdf else "page", request["totalBytes"], 0, 0, session), out
    if kind not in ("extract-chunk", "extract-pdf-chunk", "extract-commit"):
        return state, out | {"accepted": True}
    if state is None:
        return None, out | {"error": "upload was not begun"}
    what, expected, received, following, session = state
    if kind == "extract-commit":
        whole = received == expected
        return None, out | {"accepted": whole, "bytes": received, "error": None if whole else f"upload is incomplete ({received} of {expected} bytes)"}
    if (kind == "extract-pdf-chunk") != (what == "pdf"):
        return state, out | {"error": "page data was sent to a PDF upload" if what == "pdf" else "PDF data was sent to a page upload"}
    if request["index"] != following:
        return state, out | {"error": f"piece {request['index']} arrived out of order"}
    data = request["data"] or ""
    if what == "pdf":
        try:
            content = base64.b64decode(data, validate=True)
        except (binascii.Error, ValueError):
            content = b""
        if base64.b64encode(content).decode() != data:
            return state, out | {"error": "piece is no canonical base64"}
        size = len(content)
    else:
        size = len(data.encode("utf-8", "surrogatepass"))
    if received + size > expected:
        return state, out | {"error": "upload exceeded its declared size"}
    return (what, expected, received + size, following + 1, session), out | {"accepted": True, "bytes": size}


def outcomes(found: DataFrame) -> DataFrame:
    """The outcome of each request of (id, seq, type, totalBytes, index, data), in order of its upload's seq."""
    columns = ("id", "seq", "type", "totalBytes", "index", "data")

    def run(batches):
        import pyarrow as pa

        now, state, first = None, None, True
        for batch in batches:
            rows = []
            for request in batch.to_pylist():
                if first or request["id"] != now:
                    now, state, first = request["id"], None, False
                state, out = advance(state, request)
                rows.append({"id": now, "seq": request["seq"], "type": request["type"]} | out)
            yield pa.RecordBatch.from_pylist(rows, schema=kind)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = to_arrow_schema(StructType.fromDDL(OUTCOME))
    rows = found.select("id", F.col("seq").cast("long").alias("seq"), "type", F.col("totalBytes").cast("long").alias("totalBytes"), F.col("index").cast("long").alias("index"), "data").select(*columns)
    return rows.repartition("id").sortWithinPartitions("id", "seq").mapInArrow(run, OUTCOME)


def outcome_stream(found: DataFrame, timeout_ms: int = 3_600_000) -> DataFrame:
    """As ``outcomes`` over a stream: the uploads' states are kept by Spark, and go after an hour without requests.

    Requests of one upload must arrive in order of seq across triggers; within
    one they are sorted.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, frames, held):
        import pandas as pd

        if held.hasTimedOut:
            held.remove()
            return
        rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
        state = tuple(held.get) if held.exists else None
        made = []
        for request in rows.to_dict("records"):
            request = {k: None if not isinstance(v, str) and pd.isna(v) else v for k, v in request.items()}
            request = {k: int(v) if k in ("seq", "totalBytes", "index") and v is not None else v for k, v in request.items()}
            state, out = advance(state, request)
            made.append({"id": key[0], "seq": request["seq"], "type": request["type"]} | out)
        if state is None:
            if held.exists:
                held.remove()
        else:
            held.update(state)
            held.setTimeoutDuration(timeout_ms)
        frame = pd.DataFrame(made, columns=["id", "seq", "type", "session", "accepted", "index", "bytes", "message", "error"])
        yield frame.astype({"index": "Int64"})

    rows = found.select("id", F.col("seq").cast("long").alias("seq"), "type", F.col("totalBytes").cast("long").alias("totalBytes"), F.col("index").cast("long").alias("index"), "data")
    return rows.groupBy("id").applyInPandasWithState(step, OUTCOME, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def payloads(found: DataFrame, made: DataFrame) -> DataFrame:
    """id, session, content of the uploads that were committed whole: their accepted pieces in order."""
    done = made.where("type = 'extract-commit' and accepted").select("id", "session")
    pieces = made.where("accepted and type in ('extract-chunk', 'extract-pdf-chunk')").join(done, ["id", "session"]).select("id", "seq", "session", "index", "type")
    data = pieces.join(found.select("id", "seq", "data"), ["id", "seq"])
    content = F.when(F.col("type") == "extract-pdf-chunk", F.unbase64("data")).otherwise(F.encode("data", "UTF-8"))
    held = data.groupBy("id", "session").agg(F.array_sort(F.collect_list(F.struct("index", content.alias("c")))).alias("p"))
    joined = held.select("id", "session", F.aggregate("p", F.lit(b"").cast("binary"), lambda s, x: F.concat(s, x["c"])).alias("content"))
    empty = done.join(held.select("id", "session"), ["id", "session"], "left_anti").select("id", "session", F.lit(b"").cast("binary").alias("content"))
    return joined.unionByName(empty)


def read_range(content: Column, offset: Column, length: Column) -> Column:
    """struct(data, offset, next_offset, done): bytes from ``offset``, up to three more so that no UTF-8 character is parted."""
    size = F.octet_length(content)
    start = F.least(offset, size).cast("int")
    within = F.least(F.octet_length(F.substring(content, start + 1, length + 3)), size - start)
    usable = F.least(length, within).cast("int")
    goes_on = lambda k: (F.lit(k) + length < within) & F.hex(F.substring(content, (start + length + k + 1).cast("int"), F.lit(1))).between("80", "BF")
    more = F.when(goes_on(0), F.when(goes_on(1), F.when(goes_on(2), 3).otherwise(2)).otherwise(1)).otherwise(0)
    usable = usable + more
    data = F.decode(F.substring(content, start + 1, usable), "UTF-8")
    return F.struct(data.alias("data"), start.alias("offset"), (start + usable).alias("next_offset"), (start + usable >= size).alias("done"))


def read_pages(content: Column, length: int = READ_LIMIT) -> Column:
    """All ranges of a content, as a reader gets them one after the other."""
    starts = F.sequence(F.lit(0), F.greatest(F.octet_length(content) - 1, F.lit(0)), F.lit(length))
    zero = F.array(read_range(content, F.lit(0), F.lit(length)))
    step = lambda s, _: F.when(F.element_at(s, -1)["done"], s).otherwise(F.concat(s, F.array(read_range(content, F.element_at(s, -1)["next_offset"], F.lit(length)))))
    return F.aggregate(F.slice(starts, 2, F.size(starts)), zero, step)


def text_slices(text: str, units: int = SLICE_UNITS) -> list[str]:
    """Pieces of at most so many UTF-16 units that part no surrogate pair."""
    if text.isascii() or max(text, default="") <= "\uffff":
        return [text[k : k + units] for k in range(0, len(text), units)]
    out, held, size = [], [], 0
    for c in text:
        n = 1 + (c > "\uffff")
        if size + n > units:
            out.append("".join(held))
            held, size = [], 0
        held.append(c)
        size += n
    return [*out, "".join(held)]


def upload_requests(pages: DataFrame, units: int = SLICE_UNITS) -> DataFrame:
    """id, seq, type, totalBytes, index, data of (id, payload): a begin, the pieces and a commit for each text."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts = text_slices(text or "", units)
                rows.append((key, 0, "extract-begin", len((text or "").encode("utf-8", "surrogatepass")), None, None))
                rows += [(key, k + 1, "extract-chunk", None, k, p) for k, p in enumerate(parts)]
                rows.append((key, len(parts) + 1, "extract-commit", None, None, None))
            columns = list(zip(*rows)) if rows else [[]] * 6
            types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["id", "seq", "type", "totalBytes", "index", "data"])

    return pages.select(F.col("id").cast("string"), F.col("payload").cast("string")).mapInArrow(run, "id string, seq long, type string, totalBytes long, index long, data string")


def binary_slices(content: Column, size: int = SLICE_BYTES) -> Column:
    """Base64 of a content's pieces."""
    starts = F.sequence(F.lit(0), F.octet_length(content) - 1, F.lit(size))
    made = F.transform(starts, lambda i: F.regexp_replace(F.base64(F.substring(content, i + 1, F.lit(size))), "[\r\n]", ""))
    return F.when(F.octet_length(content) > 0, made).otherwise(F.array().cast("array<string>"))


def parsed(body: str) -> dict | None:
    """A JSON object, or null."""
    try:
        made = json.loads(body)
    except ValueError:
        return None
    return made if isinstance(made, dict) else None
