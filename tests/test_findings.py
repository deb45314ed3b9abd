"""Faults that a reviewer found, each on a small table."""

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

import __spark_entry__
from lectern.operators import chunks, figures, html


def against_sql(spark, name, table, rows, kind, folder):
    """The query's rows over one table of these rows, and its SQL's."""
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
    made = [tuple(r) for r in __spark_entry__.queries()[name](spark, str(folder)).collect()]
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    return sorted(made, key=repr), sorted(con.execute(__spark_entry__.oracle_sql()[name]).fetchall(), key=repr)


def test_titles_with_cut_references(spark, tmp_path):
    titles = ["a &amp; b", "cut &amp;&amp", "cut &lt", "&quot;q&quot; &quot", "&amp;lt; &#39;x&#39;&nbsp;y", "R&D; &ampere;", "", "plain"]
    rows = [(k, "http://h/", f'<!DOCTYPE html><html lang="en"><head><title>{t}</title></head><body><p>x &amp y</p></body></html>') for k, t in enumerate(titles)]
    made, sql = against_sql(spark, "dom_20_title", "pages", [*rows, (99, "http://h/", None)], "page_id long, url string, html string", tmp_path)
    assert made == sql


def test_bundles_go_out_in_small_batches():
    """However many pages a batch holds, the results of a few are held at once."""
    schema = to_arrow_schema(StructType.fromDDL(f"page_id long, {html.BUNDLE}"))
    pages = [{"page_id": k, "url": "http://h/", "html": f"<p>{k}</p>" + "<p>x</p>" * (40_000 if k % 500 == 9 else 1)} for k in range(1200)]
    read = []
    for made in html.bundle_batches(iter([pa.RecordBatch.from_pylist(pages)]), schema):
        assert 0 < made.num_rows <= html.BATCH_ROWS and made.nbytes < 20 * html.BATCH_BYTES
        read += made.select(["page_id", "sections"]).to_pylist()
    assert [r["page_id"] for r in read] == list(range(1200))
    assert [r["sections"][0]["content"] for r in read] == [f"<p>{k}</p>" for k in range(1200)] and len(read[9]["sections"]) == 40_001


def test_texts_are_cut_once_and_by_places(spark):
    """One Python function in the plan, which gives back places and no texts; characters of one to four bytes."""
    texts = ["", "short", "a" * 40_000, "ä\n\n" * 20_000 + "end", "€</b>" * 40_000, "x\U0001f600" * 21_001, " \n" * 30_000 + "end"]
    d = spark.createDataFrame([(k, 1, t) for k, t in enumerate([*texts, None])], "doc_id long, ordinal long, content string")
    made = chunks.split_sections(d)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EvalPython [") == 1
    parts = {}
    for r in sorted(made.collect()):
        parts.setdefault(r["doc_id"], []).append(r["content"])
    assert parts[1] == ["short"] and 0 not in parts and 7 not in parts
    for k in (2, 3, 4, 5):
        assert "".join(parts[k]) == texts[k] and len(parts[k]) > 1
    assert parts[6][-1].endswith("end")
    rows = d.select("doc_id", "ordinal", F.lit("s").alias("id"), F.lit("S").alias("label"), "content", F.array().cast("array<string>").alias("attachments"), F.array().cast("array<string>").alias("asset_ids"))
    whole = chunks.normalise_sections(rows)
    assert whole._jdf.queryExecution().executedPlan().toString().count("EvalPython [") == 1
    assert sorted((r["doc_id"], r["part"], r["content"]) for r in whole.collect()) == sorted((r["doc_id"], r["part"], r["content"]) for r in made.collect())


def test_box_coordinates_are_computed_once(spark):
    """A plan in which a column stands a few times, not once for each use of a coordinate and again in a filter."""
    made = __spark_entry__.queries()["pdf_03_boxes"](spark, "/root/testdata/sf0.001")
    assert made._jdf.queryExecution().optimizedPlan().toString().count("l_partkey") < 20
    odd = [[0.1, 0.2, 0.5, 0.2, 0.1, 0.6], [0.1, 0.2, float("nan"), 0.2, 0.1, 0.6, 0.9, 0.9, -1.0, 0.9, 0.9, 2.0], [0.1, None, 0.5, 0.2, 0.1, 0.6], [0.3, 0.3, 0.3, 0.3, 0.3, 0.9], [0.1] * 5, [], None, [float("inf")] * 6]
    d = spark.createDataFrame(list(enumerate(odd)), "k long, c array<double>").select("k", figures.boxes(F.col("c")).alias("b"))
    got = {r["k"]: [tuple(b) for b in r["b"]] for r in d.collect()}
    assert got == {0: [(0.1, 0.2, 0.5, 0.6000000000000001)], 1: [(0.0, 0.9, 0.9, 1.0)], **{k: [] for k in range(2, 8)}}
