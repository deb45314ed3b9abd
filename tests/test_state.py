"""Streams with state against plain readings of all rows; restarts and repeated batches."""

import random

from pyspark.sql import functions as F

from lectern.operators import report
from lectern.streaming.state import Versions, kept_current, states

SCHEMA = "key long, at long, kind string, field string, value double"
TABLE = "key long, fields map<string, double>, ended_at long, ended string"


def plain(rows):
    fields, ends = {}, {}
    for key, at, kind, field, value in rows:
        fields.setdefault(key, {})
        if field is not None and value is not None:
            fields[key][field] = max(fields[key].get(field, (-1, 0)), (at, value))
        if kind in ("done", "failed", "cancel"):
            ends[key] = min(ends.get(key, (10**9, 2, "")), (at, kind != "cancel", kind))
    return sorted((k, sorted((n, v) for n, (_, v) in f.items()), *((ends[k][0], ends[k][2]) if k in ends else (None, None))) for k, f in fields.items())


def test_stream_and_restart(spark, tmp_path):
    """Rows out of order, null fields, ties with a cancel; the second start goes on from the checkpoint."""
    rng = random.Random(8)
    rows = [(rng.randrange(9), k, rng.choice(["note", "note", "done", "failed", None]), rng.choice(["a", "b", None]), rng.choice([None, float(k)])) for k in range(200)]
    rows += [(20, 5, "done", None, None), (20, 5, "cancel", None, None)]
    rng.shuffle(rows)
    table = Versions(spark, str(tmp_path / "table"), TABLE)
    for part in (rows[:90], rows[90:]):
        spark.createDataFrame(part, SCHEMA).coalesce(2).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        kept_current(states(stream, ["done", "failed"], "cancel"), table, str(tmp_path / "checkpoint"))
    got = sorted((r.key, sorted(r.fields.items()), r.ended_at, r.ended) for r in table.read().collect())
    assert got == plain(rows)
    assert len(table.committed()) == 2


def test_repeated_batches(spark, tmp_path):
    """A batch that is applied again, also after later ones were lost, changes nothing; attempts count the batches of a run."""
    done = lambda rows: spark.createDataFrame(rows, "run_id string, status string, attempts int")
    table = Versions(spark, str(tmp_path / "t"), "run_id string, attempts int, status string")
    batches = [[("a", "failure", 0), ("b", "success", 0)], [("a", "success", 0), ("c", "failure", 0)], [("c", "success", 0)]]
    for n in (0, 0, 1, 1, 2, 1, 2):
        table.apply(done(batches[n]), n, report.merged_state)
    assert sorted(map(tuple, table.read().collect())) == [("a", 2, "success"), ("b", 1, "success"), ("c", 2, "success")]
    assert table.read().columns == ["run_id", "attempts", "status"] and table.committed() == [1, 2]
    # A version without its commit is not there, and is written anew.
    spark.createDataFrame([("x", 9, "?")], "run_id string, attempts int, status string").write.parquet(str(tmp_path / "t" / "v3"))
    (tmp_path / "t" / "v3" / "_SUCCESS").unlink()
    assert table.read().where(F.col("run_id") == "x").count() == 0
    table.apply(done([("b", "failure", 0)]), 3, report.merged_state)
    assert table.read().where("run_id = 'b'").first().attempts == 2
