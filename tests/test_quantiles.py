"""Medians by bins against a sort."""

import math
import random
from statistics import median

from lectern.operators.quantiles import medians


def test_equal_to_sorting(spark):
    """Null keys, null and non-finite values, one or all equal values, values over the whole range of doubles."""
    rng = random.Random(2)
    make = {
        "even": lambda k: k % 10, "wide": lambda k: rng.choice([-1, 1]) * 10.0 ** rng.randrange(-20, 20), "skew": lambda k: 1e20 if k == 0 else rng.random() * 1e-20, "equal": lambda k: 7.5,
        "edges": lambda k: rng.choice([-1.7976931348623157e308, 1.7976931348623157e308, 0.0, 5e-324]), None: lambda k: rng.gauss(0, 1), "null": lambda k: None, "odd": lambda k: rng.choice([math.nan, math.inf, -math.inf, 3.0]),
    }
    rows = [(g, 1 if g == "even" else None, make[g](k)) for g in make for k in range(501 if g == "even" else 400)] + [("one", 2, 4.0)]
    df = spark.createDataFrame([(a, b, None if x is None else float(x)) for a, b, x in rows], "a string, b int, x double").repartition(3)
    want = {}
    for a, b, x in rows:
        want.setdefault((a, b), []).extend([x] if x is not None and math.isfinite(x) else [])
    for bins, most in ((1 << 16, 20),):
        got = {(r.a, r.b): r.x for r in medians(df, ["a", "b"], "x", bins, most).collect()}
        assert got.keys() == want.keys()
        for key, xs in want.items():
            xs.sort()
            mid = xs[(len(xs) - 1) // 2] / 2 + xs[len(xs) // 2] / 2 if xs else None
            assert got[key] == mid, (key, bins)
    assert got["even", 1] == median(k % 10 for k in range(501))
    assert medians(df.limit(0), ["a"], "x").count() == 0
