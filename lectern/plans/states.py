"""Queries of streams with state, resumed runs, and of rows in which every branch of an operator occurs, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import html, inventories, overlaps, report
from ..staging import fresh_path, staged
from ..streaming import state
from .registry import ORACLE_SQL, QUERIES, query


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of four files: each user's last click and view, and the event that ended it."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    field = F.when(F.col("event_type").isin("click", "view"), F.col("event_type"))
    rows = events.select(F.col("user_id").alias("key"), F.col("event_id").alias("at"), F.col("event_type").alias("kind"), field.alias("field"), "value")
    path = fresh_path(spark, "events")
    rows.repartition(4, "at").write.parquet(path)
    table = state.Versions(spark, fresh_path(spark, "states"), "key long, fields map<string, double>, ended_at long, ended string")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(path)
    state.kept_current(state.states(stream, ["purchase"], cancel="error"), table, fresh_path(spark, "stream"))
    return table.read().select(F.col("key").alias("user_id"), F.try_element_at("fields", F.lit("click")).alias("click"), F.try_element_at("fields", F.lit("view")).alias("view"), "ended_at", "ended")


def _resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as runs that three batches of events complete; the second batch is applied twice, as after a failure."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    table = state.Versions(spark, fresh_path(spark, "runs"), "run_id long, attempts int, status string")
    for n in (0, 1, 1, 2):
        done = events.where((F.col("event_id") % 3 == n) & (F.col("user_id") % (n + 2) == 0)).groupBy(F.col("user_id").alias("run_id")).agg(F.max_by("event_type", "event_id").alias("status"))
        table.apply(done.withColumn("attempts", F.lit(0)), n, report.merged_state)
    return table.read()


QUERIES |= {"str_11_stream": _stream, "evl_04_resume": _resumed}
ORACLE_SQL |= {
    "str_11_stream": "SELECT user_id, arg_max(value, event_id) FILTER (event_type = 'click') AS click, arg_max(value, event_id) FILTER (event_type = 'view') AS view, min(event_id) FILTER (event_type IN ('purchase', 'error')) AS ended_at, arg_min(event_type, event_id) FILTER (event_type IN ('purchase', 'error')) AS ended FROM events GROUP BY user_id",
    "evl_04_resume": "SELECT user_id AS run_id, count(DISTINCT event_id % 3)::INT AS attempts, arg_max(event_type, (event_id % 3) * 1000000000000 + event_id) AS status FROM events WHERE user_id % (event_id % 3 + 2) = 0 GROUP BY user_id",
}


@query("dom_19_planted", "documents", "SELECT doc_id, CASE WHEN doc_id % 7 = doc_id % 3 THEN ['image-00' || doc_id % 3] ELSE ['image-00' || doc_id % 7, 'image-00' || doc_id % 3] END AS markers, regexp_extract(text, '\\S+') AS word FROM documents WHERE text IS NOT NULL")
def _(d: DataFrame) -> DataFrame:
    """Whole texts with two markers, one of them twice, and two that are none."""
    one, two = (F.concat(F.lit("[[LECTERN_IMAGE:image-"), F.lpad((F.col("doc_id") % k).cast("string"), 3, "0"), F.lit("]]")) for k in (7, 3))
    planted = F.concat(one, F.col("text"), two, F.lit("[[LECTERN_IMAGE:image-12]] [[LECTERN_IMAGE:x]]"), one)
    return d.where("text is not null").select("doc_id", html.markers(planted).alias("markers"), F.regexp_extract("text", r"\S+", 0).alias("word"))


@query("agg_13_repeats", "documents", "SELECT source, min(doc_id) AS doc_id, arg_min(md5(coalesce(text, '')), doc_id) AS digest FROM documents GROUP BY source")
def _(d: DataFrame) -> DataFrame:
    """The first document of each source, of many."""
    return report.latest_first(d, "source", "doc_id").select("source", "doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("digest"))


def _complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acceptance of two benchmarks of ended and scored runs, one document of three formats each: one that fails and one that passes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce(F.char_length("text"), F.lit(0)).alias("n"))
    runs = docs.select("doc_id", "n", F.explode(F.array(*map(F.lit, report.FORMATS))).alias("format"))
    made = []
    for name, low in (("strict", 60), ("fair", 86)):
        score = (F.lit(low) + F.col("n") % (100 - low)).cast("double")
        rows = runs.select("format", F.lit("success").alias("status"), (F.col("n") % 100_000).cast("double").alias("total_ms"), (F.col("n") % 9000).cast("double").alias("capture_ms"), F.lit(10.0).alias("model_ms"), F.lit(5000.0).alias("render_ms"), score.alias("score"), F.lit(False).alias("txt_violation"), ((F.col("n") % 50 == 7) & F.lit(low < 70)).alias("pdf_defect"))
        made.append(report.acceptance(staged(rows, "runs")).withColumn("benchmark", F.lit(name)))
    return made[0].unionByName(made[1])


QUERIES["agg_09_complete"] = _complete
_RUNS = "SELECT b.benchmark, format, n % 100000 AS total_ms, n % 9000 AS capture_ms, low + n % (100 - low) AS score, format = 'pdf' AND n % 50 = 7 AND low < 70 AS defect FROM (SELECT coalesce(length(text), 0) AS n FROM documents), (VALUES ('txt', 120000), ('md', 120000), ('pdf', 180000)) f(format, most), (VALUES ('strict', 60), ('fair', 86)) b(benchmark, low)"
ORACLE_SQL["agg_09_complete"] = f"""SELECT benchmark, CASE WHEN score_medians_pass AND least_score_pass AND runtime_pass AND capture_render_pass AND pdf_defects = 0 THEN 'pass' ELSE 'fail' END AS status, true AS all_succeeded, score_medians_pass, least_score_pass, runtime_pass, capture_render_pass, true AS model_pass, 0::BIGINT AS txt_violations, pdf_defects
FROM (SELECT benchmark, bool_and(ms >= 85) AS score_medians_pass, bool_and(least >= 70) AS least_score_pass, bool_and(mt <= CASE format WHEN 'pdf' THEN 180000 ELSE 120000 END) AS runtime_pass, bool_and(mc + 5000 <= 15000) AS capture_render_pass, sum(defects)::BIGINT AS pdf_defects
 FROM (SELECT benchmark, format, median(score) AS ms, min(score) AS least, median(total_ms) AS mt, max(capture_ms) AS mc, count(*) FILTER (defect) AS defects FROM ({_RUNS}) GROUP BY ALL) GROUP BY benchmark)"""

@query("strf_07_whole", "documents", "SELECT doc_id, CASE WHEN t <> '' AND length(t) <= 200 AND NOT starts_with(t, '-') AND NOT regexp_matches(t, '\\s|[\\x00-\\x1F\\x7F]') THEN t END AS slug FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text WHEN doc_id % 5 = 1 THEN '-' || source ELSE ' ' || source || '/' || md5(text) || '  ' END AS x, trim(x) AS t FROM documents WHERE text IS NOT NULL)")
def _(d: DataFrame) -> DataFrame:
    """Whole texts, names that begin with a hyphen, and names with blanks around."""
    given = F.when(F.col("doc_id") % 5 == 0, F.col("text")).when(F.col("doc_id") % 5 == 1, F.concat(F.lit("-"), "source")).otherwise(F.concat(F.lit(" "), "source", F.lit("/"), F.md5("text"), F.lit("  ")))
    return d.where("text is not null").select("doc_id", T.model_slug(given).alias("slug"))


@query("url_03_credentials", "pages", f"""SELECT page_id, scheme || '://' || rest || '?k=' || page_id || '#s@' || page_id AS safe_url, scheme || '://' || rest AS asset_url
 FROM (SELECT page_id, split_part(url, '://', 1) AS scheme, regexp_extract(split_part(url, '://', 2), '^[^?#]*') AS rest FROM pages WHERE regexp_matches(url, '^https?://[^/?#@]+'))""")
def _(d: DataFrame) -> DataFrame:
    """Urls with a user and a password that itself holds an @, tracking parameters, and a fragment."""
    rest = F.regexp_extract("url", "^https?://([^?#]*)", 1)
    k = F.col("page_id").cast("string")
    given = F.concat(F.substring_index("url", "://", 1), F.lit("://u"), k, F.lit(":p@ss@"), rest, F.lit("?utm_source=a&fbclid=b&k="), k, F.lit("&gclid=c#s@"), k)
    return d.where(F.col("url").rlike("^https?://[^/?#@]+")).select("page_id", T.safe_url(given).alias("safe_url"), T.asset_url(given).alias("asset_url"))


_IOU = "greatest(0::DOUBLE, least(y.r, x.r) - greatest(y.l, x.l)) * greatest(0::DOUBLE, least(y.b, x.b) - greatest(y.t, x.t))"


@query(
    "pdf_05_grid",
    "orders",
    f"""WITH RECURSIVE o AS (SELECT o_orderkey AS n, o_custkey % 40 AS page, (n % 7) * 0.1::DOUBLE + (n % 3) * 0.004::DOUBLE AS l, (n % 5) * 0.15::DOUBLE + (n % 2) * 0.003::DOUBLE AS t, 0.15::DOUBLE + (n % 4) * 0.06::DOUBLE AS w, 0.1::DOUBLE + (n % 3) * 0.05::DOUBLE AS h FROM orders),
b AS (SELECT page, row_number() OVER (PARTITION BY page ORDER BY n) AS k, {{'n': n, 'l': l, 't': t, 'r': l + w, 'b': t + h}} AS x FROM o),
f AS (SELECT page, k, [x] AS kept FROM b WHERE k = 1
 UNION ALL SELECT f.page, b.k, CASE WHEN len(list_filter(f.kept, lambda y: ({_IOU.replace('x.', 'b.x.')}) / ((y.r - y.l) * (y.b - y.t) + (b.x.r - b.x.l) * (b.x.b - b.x.t) - ({_IOU.replace('x.', 'b.x.')})) >= 0.9)) > 0 THEN f.kept ELSE list_append(f.kept, b.x) END FROM f JOIN b ON b.page = f.page AND b.k = f.k + 1)
SELECT page, unnest(kept).n AS box_id FROM (SELECT page, arg_max(kept, k) AS kept FROM f GROUP BY page)""",
)
def _(d: DataFrame) -> DataFrame:
    """Orders as boxes of forty pages, many of them copies or nearly so."""
    n = F.col("o_orderkey")
    left, top = (n % 7) * 0.1 + (n % 3) * 0.004, (n % 5) * 0.15 + (n % 2) * 0.003
    w, h = F.lit(0.15) + (n % 4) * 0.06, F.lit(0.1) + (n % 3) * 0.05
    box = F.struct(left.alias("left"), top.alias("top"), (left + w).alias("right"), (top + h).alias("bottom"))
    rows = d.select(F.lit(0).alias("doc_id"), (F.col("o_custkey") % 40).alias("page"), n.alias("at"), box.alias("box"))
    return overlaps.distinct_boxes(rows).select("page", F.col("at").alias("box_id"))


_ATTACHED = "SELECT conv_id, turn, role, unnest(['t' || turn % 4 || '.png', 'u/../v' || turn % 3 || '.png']) AS path, unnest([0, 1]) AS i FROM conversations WHERE role IS NOT NULL"


def _attached(d: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as documents, turns as sections with two attachments each that others hold too; every second turn is an asset."""
    turn = lambda k: (F.col("turn") % k).cast("string")
    paths = F.array(F.concat(F.lit("t"), turn(4), F.lit(".png")), F.concat(F.lit("u/../v"), turn(3), F.lit(".png")))
    sections = d.where("role is not null").select(F.col("conv_id").alias("doc_id"), F.lit(0).alias("chunk"), F.col("turn").alias("ordinal"), F.col("role").alias("label"), paths.alias("attachments"))
    path = F.when(F.col("turn") % 4 == 0, F.concat(F.lit("./t"), turn(4), F.lit(".png"))).otherwise(F.concat(F.lit("v"), turn(3), F.lit(".png")))
    assets = d.where("turn % 2 = 0").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ordinal"), F.concat(F.lit("a"), F.col("turn").cast("string")).alias("id"), path.alias("path"))
    return sections, assets


@query(
    "join_06_inventory",
    "conversations",
    f"""WITH p AS (SELECT conv_id, path, min(turn * 2 + i) AS k, arg_min(role, turn * 2 + i) AS label FROM ({_ATTACHED}) GROUP BY ALL),
a AS (SELECT conv_id, CASE WHEN turn % 4 = 0 THEN 't0.png' ELSE 'v' || turn % 3 || '.png' END AS path, 'a' || min(turn) AS asset_id FROM conversations WHERE turn % 2 = 0 GROUP BY ALL)
SELECT p.conv_id AS doc_id, row_number() OVER (PARTITION BY p.conv_id ORDER BY k)::INT AS place, p.path, label, asset_id FROM p LEFT JOIN a ON a.conv_id = p.conv_id AND a.path = replace(p.path, 'u/../', '')""",
)
def _(d: DataFrame) -> DataFrame:
    return inventories.inventory(*_attached(d)).select("doc_id", "place", "path", "label", "asset_id")


@query("join_03_reattached", "conversations", f"SELECT conv_id AS doc_id, turn AS ordinal, string_agg(CASE WHEN path = 't1.png' THEN 'page-' || conv_id % 5 || '.png' ELSE path END, ',' ORDER BY i) AS attachments FROM ({_ATTACHED}) GROUP BY ALL")
def _(d: DataFrame) -> DataFrame:
    sections, _ = _attached(d)
    moved = d.select(F.col("conv_id").alias("doc_id"), F.lit("t1.png").alias("path"), F.concat(F.lit("page-"), (F.col("conv_id") % 5).cast("string"), F.lit(".png")).alias("new_path"))
    return inventories.reattached(sections, moved).select("doc_id", "ordinal", F.array_join("attachments", ",").alias("attachments"))


@query("map_01_records", "events", "SELECT user_id, arg_max(event_type, event_id) FILTER (event_id % 2 = 0) AS even, arg_max(event_type, event_id) FILTER (event_id % 2 = 1) AS odd, count(DISTINCT event_id % 2)::INT AS keys FROM events GROUP BY user_id")
def _(d: DataFrame) -> DataFrame:
    """Records merged in order, the later value of a key wins."""
    record = d.select("user_id", "event_id", F.when(F.col("event_id") % 2 == 0, "even").otherwise("odd").alias("k"), "event_type")
    last = record.groupBy("user_id", "k").agg(F.max_by("event_type", "event_id").alias("v"))
    merged = last.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m"))
    return merged.select("user_id", F.try_element_at("m", F.lit("even")).alias("even"), F.try_element_at("m", F.lit("odd")).alias("odd"), F.size("m").alias("keys"))


#: What stands for an event's properties: a fifth each not JSON, without k, with k as text, with k out of bounds, and as given.
_PROPS = "CASE event_id % 5 WHEN 0 THEN substr(props, 1, length(props) - 1) WHEN 1 THEN '{}' WHEN 2 THEN '{\"k\": \"x\"}' WHEN 3 THEN '{\"k\": ' || event_id || '0}' ELSE props END"


@query(
    "val_01_properties",
    "events",
    "SELECT event_id, CASE WHEN event_id % 5 IN (0, 2) OR (event_id % 5 = 3 AND event_id * 10 > 1000) THEN NULL WHEN event_id % 5 = 1 THEN 0 WHEN event_id % 5 = 3 THEN event_id * 10 ELSE json_extract(props, '$.k')::BIGINT END AS k, CASE WHEN event_id % 5 = 0 THEN 'not JSON' WHEN event_id % 5 = 2 THEN 'k is no number' WHEN event_id % 5 = 3 AND event_id * 10 > 1000 THEN 'k is out of bounds' END AS error FROM events",
)
def _(d: DataFrame) -> DataFrame:
    """Properties as variants: k from 0 to 1000, 0 by default, and why a row is refused."""
    parsed = d.select("event_id", F.try_parse_json(F.expr(_PROPS)).alias("v"))
    given = F.expr("try_variant_get(v, '$.k', 'string')")
    k = F.expr("try_variant_get(v, '$.k', 'bigint')")
    error = F.when(F.col("v").isNull(), "not JSON").when(given.isNotNull() & k.isNull(), "k is no number").when(~F.coalesce(k, F.lit(0)).between(0, 1000), "k is out of bounds")
    return parsed.select("event_id", F.when(error.isNull(), F.coalesce(k, F.lit(0).cast("long"))).alias("k"), error.alias("error"))
