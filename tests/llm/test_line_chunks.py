"""The pipeline's line stage finds repeats by content-defined chunks and extends them."""

import random

from lectern.llm import linededup


def test_pairs_of_repeated_chunks_need_no_comparison(spark):
    rng = random.Random(3)
    passage = [f"line {k} {rng.random()}" for k in range(300)]
    texts = ["\n".join(passage), "\n".join(["own a", *passage, "own b"]), "\n".join(["x", "", " ", "x"] * 3), None]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pairs = {(r["doc_id"], r["pos"]): r["repeated"] for r in linededup.line_pairs(d).collect()}
    assert {p for k, p in pairs if k < 2} == set(range(301)) and not any(v for (k, _), v in pairs.items() if k == 0)
    assert 100 < sum(v for (k, _), v in pairs.items() if k == 1) < 301
    # The first pairs of the passage and those across chunks are found by their own comparison.
    found = {r["doc_id"]: set(r["gone"]) for r in linededup.repeated_pairs(d).collect()}
    assert found[1] == set(range(1, 300)) and 0 not in found
