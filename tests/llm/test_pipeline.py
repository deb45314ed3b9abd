"""The pipeline's stages on a small table: what goes, what stays, and that nothing else does."""

import random

import corpus_pipeline


def test_pipeline(spark, tmp_path):
    rng = random.Random(21)
    words = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ne") for b in ("ra", "si", "tu", "ve") for c in ("n", "s", "t", "l")]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item, passage = text(30), [text(15) for _ in range(5)]
    rows = [(k, text(120)) for k in range(30)]
    # An unclear text under the doc_id of a clear one, and rows without a doc_id.
    rows += [(100, "12345 !!! 678"), (101, None), (102, ""), (5, "99 !!!"), (None, None), (None, "7 7")]
    rows += [(110 + k, "\n".join([text(20), *passage, text(20)])) for k in range(3)]
    rows += [(200, rows[3][1]), (201, rows[4][1] + " end"), (210, text(40) + " " + item.upper() + " " + text(40))]
    docs = spark.createDataFrame([(k, t, "xx", "s", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    ids, kept, docs = {}, {}, spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert made.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        made.write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        rest = docs.collect()
        ids[name], kept[name] = {r["doc_id"] for r in rest}, rest
    clean = set(range(30))
    assert ids["language ID"] == clean | {110, 111, 112, 200, 201, 210}
    lines = {r["doc_id"]: r["text"].split("\n") for r in kept["line dedup"]}
    assert len(lines[110]) == 7 and len(lines[111]) == len(lines[112]) == 2 and not set(passage) & set(lines[111] + lines[112])
    assert all(r["n_chars"] == len(r["text"]) for r in kept["line dedup"])
    assert ids["MinHash near-dedup"] == clean | {110, 111, 112, 210}
    assert ids["benchmark decontamination"] == clean | {110, 111, 112}
    assert ids["packing"] == clean | {110, 111, 112}
    places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in kept["packing"])
    ends = {}
    for sequence, offset, length in places:
        assert offset == ends.get(sequence, 0)
        ends[sequence] = offset + length
    assert max(ends.values()) <= 2048 and sum(r["length"] for r in kept["packing"]) == sum({r["doc_id"]: r["doc_tokens"] for r in kept["packing"]}.values())
