"""Distinct boxes by the grid against the fold in order."""

import random

from pyspark.sql import functions as F

from lectern.operators import overlaps
from lectern.operators.figures import SAME


def share(a, b):
    side = lambda lo, hi: max(0.0, min(a[hi], b[hi]) - max(a[lo], b[lo]))
    both = side(0, 2) * side(1, 3)
    area = lambda z: (z[2] - z[0]) * (z[3] - z[1])
    return both / (area(a) + area(b) - both)


def test_equal_to_the_fold(spark):
    """Copies, nested and shifted boxes, chains in which each overlaps the next, tiny and page-wide ones."""
    rng = random.Random(4)
    rows = []
    for page in range(4):
        made = []
        for _ in range(120):
            if made and rng.random() < 0.7:
                l, t, r, b = rng.choice(made)
                d = lambda x: x * rng.choice([0, 0.01, 0.04, -0.03, 0.05, 0.2])
                l, t, r, b = l + d(r - l), t + d(b - t), r + d(r - l), b + d(b - t)
            else:
                l, t, w, h = rng.random(), rng.random(), rng.choice([1e-6, 0.05, 0.3, 1.0]), rng.choice([1e-6, 0.1, 0.9])
                r, b = l + w, t + h
            if r > l and b > t:
                made.append((l, t, r, b))
        step = 0.04
        made += [(k * step, 0.0, 1 + k * step, 1.0) for k in range(30)]
        rows += [(1, page, k, x) for k, x in enumerate(made)]
    df = spark.createDataFrame(rows, "doc_id long, page int, at int, box struct<left: double, top: double, right: double, bottom: double>")
    want = set()
    for page in range(4):
        kept = []
        for _, p, k, x in rows:
            if p == page and not any(share(y, x) >= SAME for _, y in kept):
                kept.append((k, x))
        want |= {(page, k) for k, _ in kept}
    got = {(r.page, r.at) for r in overlaps.distinct_boxes(df).collect()}
    assert got == want and 50 < len(got) < len(rows)
    assert overlaps.distinct_boxes(df.limit(0)).count() == 0
    assert overlaps.distinct_boxes(df.where(F.col("at") == 0)).count() == 4
