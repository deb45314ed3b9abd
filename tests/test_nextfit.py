"""Next-fit packing against a plain pass, all three limits binding, by arrays and by cells and jumps."""

import random

import pytest

from lectern.operators import nextfit

LIMITS = {"m": 120, "v": 30, "a": 20}


def plain(rows):
    found, documents = [], {}
    for r in rows:
        documents.setdefault(r[0], []).append(r)
    for each in documents.values():
        chunk, sums = 0, None
        for r in sorted(each, key=lambda r: (r[1], r[2], r[3:])):
            size = [x or 0 for x in r[3:6]]
            if sums and any(x + y > most for x, y, most in zip(sums, size, LIMITS.values())):
                chunk, sums = chunk + 1, None
            sums = [x + y for x, y in zip(sums or [0, 0, 0], size)]
            found.append((*r, chunk))
    return sorted(found, key=str)


def rows_of(rng):
    rows = []
    for doc in [None, *range(20)]:
        kind = rng.randrange(4)
        for ordinal in range(rng.choice([1, 3, 60, 2500 if doc == 7 else 30])):
            sizes = [(rng.randrange(50), rng.randrange(9), 0), (0, 0, rng.choice([0, 1, 7])), (rng.choice([0, 1, 200]), rng.choice([0, 31]), rng.choice([0, 21])), (rng.choice([None, 5]), rng.randrange(3), rng.randrange(3))][kind]
            rows.append((doc, ordinal, rng.randrange(2), *sizes))
    return rows + [r for r in rows if rng.random() < 0.05 and None not in r]


@pytest.mark.parametrize("held", [4096, 10])
def test_equal_to_a_pass(spark, monkeypatch, held):
    """Null ids and sizes, rows over a limit, rows without size, repeated rows; columns without a part in it are kept."""
    monkeypatch.setattr(nextfit, "ROWS", held)
    monkeypatch.setattr(nextfit, "ORDINALS", 16)
    rows = rows_of(random.Random(held))
    parts = spark.createDataFrame(rows, "doc_id long, ordinal long, part int, m long, v long, a long").repartition(5)
    got = sorted(((r[0], r[1], r[2], r[3] or 0, r[4] or 0, r[5] or 0, r[6]) for r in nextfit.packed(parts, LIMITS).collect()), key=str)
    want = sorted(((r[0], r[1], r[2], r[3] or 0, r[4] or 0, r[5] or 0, r[6]) for r in plain(rows)), key=str)
    assert [x for x in zip(got, want) if x[0] != x[1]][:3] == [] and len(got) == len(want)
    assert max(r[-1] for r in got) > 50
    named = parts.selectExpr("*", "concat('x', ordinal) AS cell", "1 AS idx")
    made = nextfit.packed(named, LIMITS)
    assert made.columns == [*named.columns, "chunk"] and made.where("cell <> concat('x', ordinal)").count() == 0
    assert sorted(r.chunk for r in made.collect()) == sorted(r[-1] for r in want)
    assert nextfit.packed(parts.limit(0), LIMITS).count() == 0


def test_no_python_in_the_plan(spark):
    parts = spark.range(100).selectExpr("id % 3 AS doc_id", "id AS ordinal", "1 AS part", "50 AS m", "1 AS v", "0 AS a")
    plan = nextfit.packed(parts, LIMITS)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
