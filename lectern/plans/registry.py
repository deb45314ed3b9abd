"""Queries of the reference's operators and their SQL, keyed by operator id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunks, html, ranks
from ..operators.quantiles import medians

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
_SPACE = "[\\t\\n\\x0B\\f\\r \\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def _compact(x: str) -> str:
    return _trim(f"regexp_replace(coalesce({x}, ''), '{_SPACE}+', ' ', 'g')")


def _utf16(x: str) -> str:
    return f"(length({x}) + length(regexp_replace({x}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))::INT"


def _visible(x: str) -> str:
    return _utf16(_compact(f"regexp_replace({x}, '<[^>]*>', ' ', 'g')"))


def query(name: str, table: str, sql: str | None = None):
    """Register f(table's rows) as a query."""

    def wrap(f):
        QUERIES[name] = lambda spark, sf_dir: f(spark.read.parquet(f"{sf_dir}/{table}.parquet"))
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return wrap


@query("src_02_sniff", "pages", "SELECT page_id, CASE WHEN regexp_matches(lower(ltrim(html)), '^(<!doctype html|<html|<head|<body)') THEN 'html' END AS kind FROM pages")
def _(d: DataFrame) -> DataFrame:
    return d.select("page_id", T.source_kind(F.encode("html", "UTF-8"), F.lit("")).alias("kind"))


@query("src_05_public_url", "pages", f"SELECT page_id, coalesce(regexp_matches(lower({_trim('url')}), '^https?://[^/?#]+'), false) AS is_public FROM pages")
def _(d):
    return d.select("page_id", T.public_url(F.col("url")).alias("is_public"))


@query("url_01_safe_url", "pages", f"""SELECT page_id, CASE WHEN regexp_matches(lower(b), '^https?://|^(file|mailto):') THEN
 substr(regexp_extract(b, '^([^?#]*)', 1) || CASE WHEN q <> '' THEN '?' || q ELSE '' END || regexp_extract(b, '(#.*)$', 1), 1, 4096) END AS safe_url
FROM (SELECT page_id, b, array_to_string(list_filter(string_split(regexp_extract(b, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(split_part(p, '=', 1), '(?i)^(utm_.+|fbclid|gclid|dclid|mc_cid|mc_eid)$')), '&') AS q
 FROM (SELECT page_id, regexp_replace({_trim('url')}, '^([A-Za-z]+://)[^/?#]*@', '\\1') AS b FROM pages))""")
def _(d):
    return d.select("page_id", T.safe_url(F.col("url")).alias("safe_url"))


@query("url_02_asset_url", "pages", f"SELECT page_id, CASE WHEN regexp_matches(lower({_trim('url')}), '^https?://[^/?#]+') THEN regexp_replace(regexp_replace({_trim('url')}, '[?#].*$', ''), '^([A-Za-z]+://)[^/]*@', '\\1') END AS asset_url FROM pages")
def _(d):
    return d.select("page_id", T.asset_url(F.col("url")).alias("asset_url"))


@query("strf_01_compact", "documents", f"SELECT doc_id, md5({_compact('text')}) AS digest FROM documents")
def _(d):
    return d.select("doc_id", F.md5(T.compact(F.col("text"))).alias("digest"))


@query("strf_02_normalise", "conversations", f"SELECT conv_id, turn, {_trim("replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))")} || chr(10) AS output FROM conversations")
def _(d):
    return d.select("conv_id", "turn", T.normalised_output(F.col("text")).alias("output"))


@query("strf_05_escape", "pages", "SELECT page_id, md5(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')) AS digest FROM pages")
def _(d):
    return d.select("page_id", F.md5(T.html_escaped(F.col("html"))).alias("digest"))


@query("strf_06_cell", "benchmark", "SELECT item_id, CASE WHEN coalesce(text, '') = '' THEN '—' ELSE replace(replace(text, '|', '\\|'), chr(10), ' ') END AS cell FROM benchmark")
def _(d):
    return d.select("item_id", T.table_cell(F.col("text")).alias("cell"))


@query("flt_01_renderable", "pages", f"SELECT page_id FROM pages WHERE {_trim("regexp_replace(html, '<[^>]*>', '', 'g')")} <> '' OR regexp_matches(html, '(?i)<(hr|img|lectern-image)\\b')")
def _(d):
    return d.where(T.renderable(F.col("html"))).select("page_id")


@query("chk_01_visible", "pages", f"SELECT page_id, {_visible('html')} AS visible FROM pages")
def _(d):
    return d.select("page_id", T.visible_length(F.col("html")).alias("visible"))


@query("chk_02_budget", "pages", f"SELECT page_id, least(120000, greatest(4000, floor(30000 / greatest({_visible('html')} / greatest(1, {_utf16('html')}), 0.01))))::INT AS budget FROM pages")
def _(d):
    return d.select("page_id", T.raw_budget(F.col("html")).alias("budget"))


def _last(window: str, mark: str, size: int) -> str:
    """Where ``mark`` begins last in a window of t that begins at lo; -1 if nowhere."""
    return f"CASE WHEN strpos({window}, {mark}) = 0 THEN -1 ELSE lo + length({window}) - strpos(reverse({window}), reverse({mark})) + 1 - {size} END"


def _split(sections: str) -> str:
    """CTEs that cut sections (doc_id, ordinal, content), part by part; kept: the parts with something to render."""
    line, inside = "chr(10)", "substr(t, best + 3, hard - best - 2)"
    return f"""WITH RECURSIVE sec AS ({sections}),
b AS (SELECT doc_id, ordinal, content AS t, length(content) AS n, least(120000, greatest(4000, floor(30000 / greatest({_visible('content')} / greatest(1, {_utf16('content')}), 0.01))))::BIGINT AS b FROM sec WHERE content IS NOT NULL),
r AS (SELECT doc_id, ordinal, t, n, b, 0::BIGINT AS part, 0::BIGINT AS pos, 0::BIGINT AS e FROM b
 UNION ALL SELECT doc_id, ordinal, t, n, b, part + 1, pos, CASE WHEN hard = n THEN n WHEN best < 0 THEN hard WHEN substr(t, best + 1, 2) = {line} || {line} THEN best + 2
   WHEN substr(t, best + 1, 2) = '</' THEN CASE WHEN strpos({inside}, '>') > 0 THEN best + 2 + strpos({inside}, '>') ELSE best END ELSE best + 1 END::BIGINT
  FROM (SELECT *, greatest({_last('w', f'{line} || {line}', 2)}, {_last('w', "'</'", 2)}, {_last('w1', line, 1)}) AS best
   FROM (SELECT *, substr(t, lo + 1, hard - lo + 2) AS w, substr(t, lo + 1, hard - lo + 1) AS w1
    FROM (SELECT doc_id, ordinal, t, n, b, part, e AS pos, least(n, e + b) AS hard, e + b * 3 // 5 AS lo FROM r WHERE e < n)))),
kept AS (SELECT doc_id, ordinal, part::INT AS part, parts::INT AS parts, content FROM (SELECT doc_id, ordinal, part, count(*) OVER (PARTITION BY doc_id, ordinal) AS parts, substr(t, pos + 1, e - pos) AS content FROM r WHERE part > 0)
 WHERE {_trim("regexp_replace(content, '<[^>]*>', '', 'g')")} <> '' OR regexp_matches(content, '(?i)<(hr|img|lectern-image)\\b'))"""


@query("chk_03_split", "documents", f"{_split('SELECT doc_id, 1 AS ordinal, text AS content FROM documents')} SELECT doc_id, part, parts, md5(content) AS digest FROM kept")
def _(d):
    return chunks.split_sections(d.select("doc_id", F.lit(1).cast("long").alias("ordinal"), F.col("text").alias("content"))).select("doc_id", "part", "parts", F.md5("content").alias("digest"))


#: Texts of twenty documents in one, with paragraphs, tags, line ends and none of them between.
_JOINED = "SELECT doc_id // 20 AS doc_id, 1 AS ordinal, string_agg(CASE doc_id % 4 WHEN 0 THEN text || chr(10) || chr(10) WHEN 1 THEN '<p class=\"x\">' || text || '</p>' WHEN 2 THEN replace(text, chr(10), ' ') || ' </b ' ELSE text END, '' ORDER BY doc_id) AS content FROM documents WHERE text IS NOT NULL GROUP BY ALL"


@query("chk_03_boundaries", "documents", f"{_split(_JOINED)} SELECT doc_id, part, parts, length(content)::INT AS size, md5(content) AS digest FROM kept")
def _(d):
    kind, text = F.col("doc_id") % 4, F.col("text")
    marked = F.when(kind == 0, F.concat(text, F.lit("\n\n"))).when(kind == 1, F.concat(F.lit('<p class="x">'), text, F.lit("</p>"))).when(kind == 2, F.concat(F.replace(text, F.lit("\n"), F.lit(" ")), F.lit(" </b "))).otherwise(text)
    rows = d.where("text is not null").select(F.floor(F.col("doc_id") / 20).alias("k"), "doc_id", marked.alias("text"))
    joined = rows.groupBy(F.col("k").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rows.doc_id, "text"))), lambda x: x["text"]), "").alias("content"))
    made = chunks.split_sections(joined.select("doc_id", F.lit(1).cast("long").alias("ordinal"), "content"))
    return made.select("doc_id", "part", "parts", F.char_length("content").alias("size"), F.md5("content").alias("digest"))


_SECTIONS = "SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS ordinal, unnest(string_split(text, chr(10))) AS content FROM documents WHERE text IS NOT NULL"


def _sections(d: DataFrame) -> DataFrame:
    """A document's lines as sections, numbered from 1."""
    lines = d.where("text is not null").select("doc_id", F.posexplode_outer(F.split("text", "\n", -1)).alias("i", "content"))
    return lines.select("doc_id", (F.col("i") + 1).cast("long").alias("ordinal"), F.lit(1).alias("part"), "content")


@query("chk_05_pack", "documents", f"""WITH RECURSIVE s AS ({_SECTIONS}),
p AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal) AS k, ordinal::BIGINT AS ordinal, {_utf16('content')}::BIGINT AS m, {_visible('content')}::BIGINT AS v FROM s WHERE {_trim("regexp_replace(content, '<[^>]*>', '', 'g')")} <> ''),
r AS (SELECT doc_id, k, ordinal, m, v, m AS tm, v AS tv, 0::BIGINT AS chunk FROM p WHERE k = 1
 UNION ALL SELECT p.doc_id, p.k, p.ordinal, p.m, p.v,
  CASE WHEN r.tm + p.m > 120000 OR r.tv + p.v > 30000 THEN p.m ELSE r.tm + p.m END, CASE WHEN r.tm + p.m > 120000 OR r.tv + p.v > 30000 THEN p.v ELSE r.tv + p.v END,
  r.chunk + (r.tm + p.m > 120000 OR r.tv + p.v > 30000)::BIGINT FROM r JOIN p ON p.doc_id = r.doc_id AND p.k = r.k + 1)
SELECT doc_id, ordinal, m AS markup, v AS visible, chunk FROM r""")
def _(d):
    return chunks.pack_sections(chunks.sized(_sections(d)).where("visible > 0")).select("doc_id", "ordinal", "markup", "visible", "chunk")


@query("chk_07_chunks", "documents", f"""{_split(_SECTIONS)},
p AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal, part) AS k, ordinal::BIGINT AS ordinal, part, {_utf16('content')} AS m, {_visible('content')} AS v FROM kept),
q AS (SELECT doc_id, k, ordinal, part, m, v, m::BIGINT AS tm, v::BIGINT AS tv, 0::BIGINT AS chunk FROM p WHERE k = 1
 UNION ALL SELECT p.doc_id, p.k, p.ordinal, p.part, p.m, p.v,
  CASE WHEN q.tm + p.m > 120000 OR q.tv + p.v > 30000 THEN p.m ELSE q.tm + p.m END, CASE WHEN q.tm + p.m > 120000 OR q.tv + p.v > 30000 THEN p.v ELSE q.tv + p.v END,
  q.chunk + (q.tm + p.m > 120000 OR q.tv + p.v > 30000)::BIGINT FROM q JOIN p ON p.doc_id = q.doc_id AND p.k = q.k + 1)
SELECT doc_id, ordinal, part, m AS markup, v AS visible, chunk FROM q""")
def _(d):
    return chunks.pack_sections(chunks.sized(chunks.split_sections(_sections(d)))).select("doc_id", "ordinal", "part", "markup", "visible", "chunk")


@query("dom_16_sections", "pages")
def _(d):
    return html.pages_to_bundles(d).select("page_id", F.posexplode("sections").alias("ordinal", "s")).select("page_id", "ordinal", "s.*")


@query("dom_20_metadata", "pages")
def _(d):
    return html.pages_to_bundles(d).select("page_id", "title", F.to_json("metadata").alias("metadata"))


@query("dom_19_markers", "documents", "SELECT doc_id, list_distinct(regexp_extract_all(text, '\\[\\[LECTERN_IMAGE:(image-\\d{3,})\\]\\]', 1)) AS markers FROM documents WHERE text IS NOT NULL")
def _(d):
    return d.where("text is not null").select("doc_id", html.markers(F.col("text")).alias("markers"))


@query("agg_01_bytes", "documents", "SELECT source, sum(octet_length(encode(text)))::BIGINT AS source_bytes, count(*) AS sections FROM documents GROUP BY source")
def _(d):
    return d.groupBy("source").agg(F.sum(F.octet_length("text")).alias("source_bytes"), F.count("*").alias("sections"))


@query("agg_03_median", "lineitem", "SELECT l_returnflag, median(l_quantity)::DOUBLE AS median_quantity FROM lineitem GROUP BY l_returnflag")
def _(d):
    return medians(d.withColumn("median_quantity", F.col("l_quantity")), ["l_returnflag"], "median_quantity")


@query("agg_03_prices", "lineitem", "SELECT l_returnflag, l_linestatus, median(l_extendedprice::DOUBLE) AS median_price FROM lineitem GROUP BY ALL")
def _(d):
    return medians(d.withColumn("median_price", F.col("l_extendedprice")), ["l_returnflag", "l_linestatus"], "median_price")


@query("agg_03_totals", "orders", "SELECT o_orderpriority, median(o_totalprice::DOUBLE) AS median_total FROM orders GROUP BY ALL")
def _(d):
    return medians(d.withColumn("median_total", F.col("o_totalprice")), ["o_orderpriority"], "median_total")


@query("agg_05_counts", "labels", "SELECT quality, count(*) AS planned, count(*) FILTER (toxic = 1) AS failed, count(*) FILTER (toxic = 0) AS success, coalesce(bool_and(coalesce(toxic = 0, false)), true) AS all_pass FROM labels GROUP BY quality")
def _(d):
    return d.groupBy("quality").agg(F.count("*").alias("planned"), F.count_if(F.col("toxic") == 1).alias("failed"), F.count_if(F.col("toxic") == 0).alias("success"), F.coalesce(F.bool_and(F.coalesce(F.col("toxic") == 0, F.lit(False))), F.lit(True)).alias("all_pass"))


@query("agg_10_concat", "conversations", f"SELECT conv_id, md5(array_to_string(list({_trim('text')} ORDER BY turn), chr(10) || chr(10)) || chr(10)) AS edition, count(*) AS chunks FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def _(d):
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", T.trimmed(F.col("text")).alias("t")))), lambda x: x["t"])
    return d.where("text is not null").groupBy("conv_id").agg(F.md5(F.concat(F.array_join(parts, "\n\n"), F.lit("\n"))).alias("edition"), F.count("*").alias("chunks"))


@query("agg_12_digest_distinct", "documents", "SELECT min(doc_id) AS doc_id, sha256(text) AS digest FROM documents WHERE text IS NOT NULL GROUP BY text")
def _(d):
    return d.where("text is not null").groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("doc_id"))


@query("win_01_ordinals", "conversations", "SELECT conv_id, turn, format('image-{:03d}', row_number() OVER (PARTITION BY conv_id ORDER BY turn)) AS id FROM conversations WHERE role = 'user'")
def _(d):
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return d.where("role = 'user'").select("conv_id", "turn", F.format_string("image-%03d", n).alias("id"))


@query("win_04_totals", "conversations", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS chunk_index, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations")
def _(d):
    w = Window.partitionBy("conv_id")
    return d.select("conv_id", "turn", (F.row_number().over(w.orderBy("turn")) - 1).cast("long").alias("chunk_index"), F.count("*").over(w).alias("total"))


@query("win_05_changes", "conversations", "SELECT conv_id, turn, role FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) WHERE before IS DISTINCT FROM role")
def _(d):
    before = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    return d.withColumn("before", before).where(~F.col("before").eqNullSafe(F.col("role"))).select("conv_id", "turn", "role")


@query("ord_01_natural", "supplier", "SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS place FROM supplier")
def _(d):
    # One global order: the key sorts like the number in the name.
    keyed = d.select("s_suppkey", T.natural_key(F.concat(F.lit("img"), F.col("s_suppkey").cast("string"), F.lit(".png"))).alias("key"))
    return ranks.ranked(keyed, "key", "place").drop("key")


@query("ord_06_tail", "documents", "SELECT doc_id, right(text, 2000) AS tail FROM documents")
def _(d):
    return d.select("doc_id", F.right("text", F.lit(2000)).alias("tail"))


@query("join_11_plan", "benchmark", "SELECT item_id, format FROM benchmark, (VALUES ('txt'), ('md'), ('pdf')) f(format)")
def _(d):
    return d.select("item_id", F.explode(F.array(*map(F.lit, ("txt", "md", "pdf")))).alias("format"))


def _resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source").join(done, "doc_id", "left_anti")


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "n_chars")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = docs.join(labels, "doc_id", "left")
    counts = rows.groupBy("lang").agg(F.count("*").alias("planned"), F.count_if(F.col("quality") == 1).alias("success"), F.count_if(F.col("quality").isNull()).alias("not_run"))
    sizes = medians(rows.select("lang", F.when(F.col("quality") == 1, F.col("n_chars")).alias("median_size")), ["lang"], "median_size")
    return counts.alias("c").join(sizes.alias("s"), F.col("c.lang").eqNullSafe(F.col("s.lang"))).select("c.lang", "planned", "success", "median_size", "not_run")


QUERIES |= {"join_14_resume": _resume, "evl_03_report": _report}
ORACLE_SQL |= {
    "join_14_resume": "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)",
    "evl_03_report": "SELECT lang, count(*) AS planned, count(*) FILTER (quality = 1) AS success, median(CASE WHEN quality = 1 THEN n_chars END)::DOUBLE AS median_size, count(*) FILTER (quality IS NULL) AS not_run FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang",
}


@query("hash_01_sha256", "pages", "SELECT page_id, sha256(html) AS digest FROM pages")
def _(d):
    return d.select("page_id", F.sha2("html", 256).alias("digest"))
