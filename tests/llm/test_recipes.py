"""Exact duplicates by chunk recipes against a plain grouping of whole texts."""

import hashlib
import random

from pyspark.sql import functions as F

from lectern.llm import recipes


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain(rows):
    groups, found = {}, []
    for doc, text in rows:
        groups.setdefault(low(text), []).append(doc)
    for text, ids in groups.items():
        keep, left = max((d for d in ids if d is not None), default=None), True
        for d in ids:
            found.append((d, keep, len(ids), d == keep and left, hashlib.sha256(text.encode()).hexdigest()))
            left = left and d != keep
    return sorted(found, key=str)


def rows_of(rng):
    odd = ["", None, "A", "a", "É", "é", "\n", "\n\n", "x" * 3000, "x" * 3000 + "y", "ab. " * 500, "AB. " * 500, "a\nb\r\nc", "a\nb\nc", "İi", "漢字。かな。", "no mark " * 300, "😀" * 700, "😀" * 701, "line\n" * 400]
    odd += ["".join(rng.choice("abcdefgh .\n") for _ in range(rng.randrange(1, 3000))) for _ in range(20)]
    return [(rng.randrange(60) if rng.random() < 0.9 else None, rng.choice(odd)) for _ in range(300)]


def test_equal_to_grouping_by_whole_texts(spark):
    """Null ids and texts, repeated rows, long texts; and with a hash that almost every chunk shares."""
    rows = rows_of(random.Random(11))
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, fp int, sha string").repartition(5)
    want = plain(rows)
    for chunk_hash in (F.xxhash64, lambda c: F.pmod(F.xxhash64(c), F.lit(3))):
        assert sorted((tuple(r) for r in recipes.equal_texts(docs, chunk_hash).collect()), key=str) == want
    assert recipes.equal_texts(docs.limit(0)).count() == recipes.drop_copies(docs.limit(0)).count() == 0


def test_rows_that_stay(spark):
    """Columns named as those made on the way are kept; of repeated rows one stays."""
    docs = spark.createDataFrame([(1, "A b", "p"), (2, "a B", "q"), (2, "a b", "r"), (3, "c", "s"), (None, None, "t"), (None, "", "u")], "doc_id long, text string, kept string")
    got = sorted(((r.doc_id, low(r.text), r.kept) for r in recipes.drop_copies(docs).collect()), key=str)
    assert [r[:2] for r in got] == [(2, "a b"), (3, "c"), (None, "")]
    assert got[0][2] in "qr" and got[1][2] == "s" and got[2][2] in "tu"


def test_chunks_are_lossless_and_shift_resistant(spark):
    rng = random.Random(5)
    lines = [" ".join(rng.choice("abcdefghij") * rng.randrange(1, 9) for _ in range(12)) for _ in range(400)]
    texts = ["\n".join(lines), "\n".join(["one line more", *lines]), " ".join(lines), "", *(low(t) for _, t in rows_of(rng))]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    made = docs.select("k", "text", recipes.cut(F.col("text"), F.xxhash64).alias("m")).select("k", "text", recipes.chunks_of(F.col("m")).alias("c"), "m.recipe")
    got = {r.k: r for r in made.collect()}
    assert all("".join(c.chunk for c in r.c) == r.text for r in got.values())
    assert len(got[0].recipe) > 20 and len(set(got[0].recipe) - set(got[1].recipe)) <= 2
    assert max(len(c.chunk) for c in got[2].c) < len(got[2].text) // 4
