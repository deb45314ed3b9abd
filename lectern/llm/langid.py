"""Language identification of mixed-language texts.

Letters' script ranges narrow a word's candidate languages to those written in
that script; a word's score for a language is the sum of the log-likelihoods
of its letter n-grams; Viterbi with a penalty for each switch labels spans.
The document's language is the one whose spans hold the most letters.

Viterbi runs on fixed blocks of words, all blocks at once: each block's
max-plus transfer matrix first, then the blocks' ends, then each block's path.

The n-gram counts are learned from a sample of about ``sample_rows`` labelled
rows, chosen by hash (SAMPLE_ROWS): it is aggregated by the executors, and a
table of languages times BUCKETS reaches the driver.

Cases: a null text, or one without letters, is ``und`` with score 0 and no
spans.  Without labelled rows every document is ``und``.  A word in a script
that no learned language is written in may be of any.  Ties go to the
language that sorts first.  Repeated rows are labelled each; other columns are
ignored, whatever their names.  A text is labelled whole, however long.  Of
more than LANGUAGES values of lang the commonest are learned.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, give_back
from .tokens import _held
from .wordhash import mix

SAMPLE_ROWS = 20_000
#: Languages that a model learns: the commonest, where a table has more values of lang.
LANGUAGES = 512
BUCKETS = 1 << 15
#: Cost of a switch, and the most by which a word may speak for a language, in nats.
SWITCH, MOST = 8.0, 5.0
#: Words in a block; code points taken at once.
BLOCK, AT_ONCE = 64, 1 << 18
#: First and last code point of scripts (fixed values: Unicode blocks).
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x77F)],
    "devanagari": [(0x900, 0x97F)],
    "thai": [(0xE00, 0xE7F)],
    "kana": [(0x3040, 0x30FF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "han": [(0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)],
}
OTHER = len(SCRIPTS) + 1


def letter_tables():
    """(script number of each code point: 0 no letter; its lower case)."""

    def make():
        import unicodedata

        script, lower = np.zeros(0x110000, dtype=np.uint8), np.arange(0x110000, dtype=np.uint32)
        for cp in range(0x110000):
            ch = chr(cp)
            if unicodedata.category(ch)[0] == "L":
                script[cp] = OTHER
                if len(low := ch.lower()) == 1:
                    lower[cp] = ord(low)
        for k, ranges in enumerate(SCRIPTS.values(), 1):
            for a, b in ranges:
                script[a : b + 1][script[a : b + 1] > 0] = k
        return script, lower

    return _held("letters", make)


def words_of(texts: list[str | None]):
    """Words (runs of letters) of a block of texts: hashed n-grams, each n-gram's word, the words' script, letters, text and first code point in the block."""
    script_of, lower_of = letter_tables()
    parts = [(t or "").encode("utf-32-le", "surrogatepass") + b"\n\0\0\0" for t in texts]
    cp = np.frombuffer(b"".join(parts), dtype=np.uint32)
    begins = np.cumsum([0, *(len(p) // 4 for p in parts)])
    script = script_of[cp]
    c = lower_of[cp].astype(np.uint64)
    inside = np.zeros(len(cp) + 2, dtype=bool)
    inside[1:-1] = script > 0
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    n = len(start)
    # Positions of a word and the delimiter after it; n-grams end there.
    at = np.flatnonzero(inside[1:-1] | inside[:-2])
    c = np.where(inside[1:-1], c, np.uint64(0))
    word = np.repeat(np.arange(n), end - start + 1)
    c0 = c[at]
    c1 = np.where(at > 0, c[at - 1], np.uint64(0))
    c2 = np.where((at > 1) & (at - 1 >= start[word]), c[at - 2], np.uint64(0)) if n else c1
    grams = [mix(c1 * np.uint64(0x200001) + c0 + np.uint64(1 << 60)), mix((c2 * np.uint64(0x200001) + c1) * np.uint64(0x200003) + c0)]
    grams = [(g >> np.uint64(49)).astype(np.int64) for g in grams]
    return grams, word, script[start], end - start, np.searchsorted(begins, start, side="right") - 1, start - begins[np.searchsorted(begins, start, side="right") - 1]


def blocks_of(texts: list[str | None]):
    """(first, last) ranges of texts of about AT_ONCE characters; a longer text is a range of its own."""
    first, held = 0, 0
    for k, t in enumerate(texts):
        if k > first and held + len(t or "") > AT_ONCE:
            yield first, k
            first, held = k, 0
        held += len(t or "")
    if first < len(texts):
        yield first, len(texts)


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, languages: int = LANGUAGES):
    """(languages, BUCKETS x languages log-likelihoods, scripts x languages candidates) from (text, lang)."""
    bounded_batches(labelled.sparkSession)
    labelled = labelled.where("text is not null and lang is not null")
    labelled = labelled.withColumn("lang", F.col("lang").cast("string"))
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n"))
    total, values = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    if values > languages:
        known = [r["lang"] for r in counts.orderBy(F.desc("n"), "lang").limit(languages).collect()]
        labelled = labelled.where(F.col("lang").isin(known))
    share = min(1.0, sample_rows / max(total, 1))
    sample = labelled.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1))

    def count(batches):
        import pyarrow as pa

        grams, scripts = {}, {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in blocks_of(texts):
                found, word, script, letters, owner, _ = words_of(texts[a:b])
                code = {x: k for k, x in enumerate(sorted(set(langs[a:b])))}
                of = np.array([code[x] for x in langs[a:b]])
                for lang, k in code.items():
                    on = of[owner] == k
                    g = grams.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
                    for f in found:
                        g += np.bincount(f[on[word]], minlength=BUCKETS)
                    scripts[lang] = scripts.get(lang, 0) + np.bincount(script[on], letters[on], minlength=OTHER + 1)
        for lang, g in grams.items():
            keys = np.flatnonzero(g)
            far = np.flatnonzero(scripts[lang])
            ids = np.concatenate([keys, BUCKETS + far])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(ids), pa.string()), pa.array(ids, pa.int64()), pa.array(np.concatenate([g[keys], scripts[lang][far].astype(np.int64)]))], ["lang", "k", "n"])

    rows = sample.select(F.col("text").cast("string"), F.col("lang").cast("string")).mapInArrow(count, "lang string, k long, n long").groupBy("lang", "k").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(rows["lang"].unique())
    counts = np.zeros((BUCKETS + OTHER + 1, len(langs)))
    if len(langs):
        counts[rows["k"], np.searchsorted(langs, rows["lang"])] = rows["n"]
    grams, scripts = counts[:BUCKETS] + 0.5, counts[BUCKETS:]
    likely = np.log(grams / grams.sum(axis=0)) if len(langs) else grams
    candidates = scripts >= 0.01 * np.maximum(scripts.sum(axis=0), 1)
    return langs, likely.astype(np.float32), candidates


def viterbi(scores: np.ndarray, bounds: np.ndarray, switch: float) -> np.ndarray:
    """The best state of each word; text d has the words bounds[d]:bounds[d+1]."""
    n, k = np.diff(bounds), scores.shape[1]
    per = -(-n // BLOCK)
    first = np.concatenate([[0], np.cumsum(per)])
    total = int(first[-1])
    owner = np.repeat(np.arange(len(n)), n)
    within = np.arange(len(owner)) - bounds[:-1][owner]
    row, col = first[:-1][owner] + within // BLOCK, within % BLOCK
    padded = np.zeros((total, BLOCK, k), dtype=np.float32)  # what is padded stays in its state at no cost
    padded[row, col] = scores
    step = np.where(np.eye(k, dtype=bool), 0.0, -switch).astype(np.float32)
    # transfer[b, i, j]: the best of block b when the word before is in state i and its last word in j.
    transfer = np.broadcast_to(np.where(np.eye(k, dtype=bool), 0, -np.inf), (total, k, k)).astype(np.float32)
    for t in range(BLOCK):
        transfer = np.maximum(transfer, transfer.max(axis=2, keepdims=True) - np.float32(switch)) + padded[:, t, None, :]
    entry, best = np.zeros(total, dtype=np.int64), np.zeros((len(n), k), dtype=np.float32)
    came = np.zeros((total, k), dtype=np.int64)
    for b in range(int(per.max(initial=0))):
        on = np.flatnonzero(per > b)
        reach = best[on][:, :, None] + transfer[first[on] + b]
        came[first[on] + b] = reach.argmax(axis=1)
        best[on] = reach.max(axis=1)
    leave = np.zeros(total, dtype=np.int64)
    state = best.argmax(axis=1)
    for b in range(int(per.max(initial=0)) - 1, -1, -1):
        on = np.flatnonzero(per > b)
        at = first[on] + b
        leave[at] = state[on]
        state[on] = entry[at] = came[at, state[on]]
    rows = np.arange(total)
    value = np.full((total, k), -np.inf, dtype=np.float32)
    value[rows, entry] = 0
    back = np.zeros((BLOCK, total, k), dtype=np.int32)
    for t in range(BLOCK):
        reach = value[:, :, None] + step
        back[t] = reach.argmax(axis=1)
        value = reach.max(axis=1) + padded[:, t]
    path = np.zeros((total, BLOCK), dtype=np.int32)
    now = leave.copy()
    for t in range(BLOCK - 1, -1, -1):
        path[:, t] = now
        now = back[t][rows, now].astype(np.int64)
    return path[row, col].astype(np.int64)


def identify(docs: DataFrame, model, with_spans: bool = False, switch: float = SWITCH, with_text_hash: bool = False) -> DataFrame:
    """doc_id, lang_pred, score (the predicted language's share of letters); with_spans: spans (start, end in code points, lang); with_text_hash: text_hash, to tell texts of one doc_id apart."""
    langs, likely, candidates = model

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in blocks_of(texts):
                m = b - a
                share, pick, spans = np.zeros(m), np.full(m, -1), [[] for _ in range(m)]
                grams, word, script, letters, owner, start = words_of(texts[a:b])
                if len(script) and len(langs):
                    edges = np.flatnonzero(np.diff(word, prepend=-1))
                    scores = np.add.reduceat(likely[grams[0]] + likely[grams[1]], edges, axis=0)
                    may = candidates[script]
                    may |= ~may.any(axis=1, keepdims=True)
                    scores = np.where(may, scores, -np.inf)
                    scores = np.maximum(scores - scores.max(axis=1, keepdims=True), -MOST) * np.where(may, 1.0, 4.0)
                    bounds = np.searchsorted(owner, np.arange(m + 1))
                    path = viterbi(scores.astype(np.float32), bounds, switch)
                    held = np.bincount(owner * len(langs) + path, letters, minlength=m * len(langs)).reshape(m, len(langs))
                    some = held.sum(axis=1) > 0
                    pick[some] = held[some].argmax(axis=1)
                    share[some] = held[some].max(axis=1) / held[some].sum(axis=1)
                    if with_spans:
                        new = np.flatnonzero((np.diff(path, prepend=-1) != 0) | (np.diff(owner, prepend=-1) != 0))
                        for i, j in zip(new, [*new[1:], len(path)]):
                            spans[owner[i]].append({"start": int(start[i]), "end": int(start[j - 1] + letters[j - 1]), "lang": langs[path[i]]})
                out = [batch.column(0).slice(a, m), pa.array([langs[k] if k >= 0 else "und" for k in pick], pa.string()), pa.array(share)]
                if with_spans:
                    out.append(pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))))
                if with_text_hash:
                    out.append(batch.column(2).slice(a, m))
                yield pa.RecordBatch.from_arrays(out, names)
        give_back()

    kind = "doc_id long, lang_pred string, score double" + ", spans array<struct<start: long, end: long, lang: string>>" * with_spans + ", text_hash long" * with_text_hash
    names = ["doc_id", "lang_pred", "score"] + ["spans"] * with_spans + ["text_hash"] * with_text_hash
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *[F.xxhash64(text).alias("text_hash")] * with_text_hash)
    return rows.mapInArrow(run, kind)


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))
