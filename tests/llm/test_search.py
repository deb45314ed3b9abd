"""Ranked search against a score of every document for every item."""

import math
import random
import re
from collections import Counter

import pytest

from lectern.llm import search


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k):
    tables = [(d, Counter(words(t))) for d, t in docs]
    n, length = sum(bool(c) for _, c in tables), sum(sum(c.values()) for _, c in tables)
    df, asked, found = Counter(t for _, c in tables for t in c), {}, []
    for i, t in items:
        asked.setdefault(i, set()).update(words(t))
    for i, terms in asked.items():
        scored = []
        for d, c in tables:
            m = 50 + 50 * sum(c.values()) * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if score > 0:
                scored.append((-score, d is None, d or 0))
        found += [(i, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scored)[:k])]
    return sorted(found, key=str)


@pytest.mark.parametrize("shard, prime", [(1 << 17, 1024), (40, 8), (7, 1)])
def test_equal_to_scores_of_all_documents(spark, monkeypatch, shard, prime):
    """Null and repeated ids, copies (ties), empty and very long texts, other scripts, frequent and unknown terms."""
    monkeypatch.setattr(search, "SHARD_ROWS", shard)
    monkeypatch.setattr(search, "PRIME", prime)
    rng = random.Random(13)
    pool = [f"w{int(rng.expovariate(0.05))}" for _ in range(400)] + ["the"] * 60 + ["Été", "漢字", "a_b", "7"]
    docs = [(k, " ".join(rng.choices(pool, k=rng.randrange(1, 80)))) for k in range(250)]
    docs += [(rng.randrange(300), docs[3][1]) for _ in range(70)] + [(None, docs[5][1]), (None, None), (900, None), (901, " .,"), (902, "the w1 " * 50_000), (3, docs[3][1])]
    items = [(k, " ".join(rng.choices(pool, k=rng.randrange(1, 30)))) for k in range(12)] + [(50, docs[3][1].upper()), (51, None), (52, ""), (53, "unknownword"), (54, "the"), (0, "w3 w4"), (None, "w5 THE")]
    d = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, n int, score int").repartition(3)
    i = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, rank int")
    assert sorted((tuple(r) for r in search.rank(d, i, 50, 40 if shard < 50 else search.BLOCK_TERMS).collect()), key=str) == plain(docs, items, 50)


def test_tables_without_rows(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    i = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert [tuple(r) for r in search.rank(d, i).collect()] == plain([(1, "a b")], [(1, "a")], 50)
    assert search.rank(d.limit(0), i).count() == search.rank(d, i.limit(0)).count() == 0
