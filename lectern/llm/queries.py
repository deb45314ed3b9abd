"""The queries of this subpackage's operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, divergence, langid, linededup, neardup, neighbours, packing, recipes, search, token_counts, toxicity, urlfilter
from .common import table


def op1_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.link_documents(table(spark, sf_dir, "documents"), width=4, percent=80)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"), 4, 2)))
    found = langid.identify(docs, model)
    return found.withColumn("held_out", langid.held_out(F.col("doc_id"), 4, 2))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("lines_in").cast("long").alias("lines_in"), F.col("lines_out").cast("long").alias("lines_out"), F.md5("text").alias("text_md5"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.held_out(F.col("doc_id"), 5, 0)
    labels = table(spark, sf_dir, "labels").where(~out).select("doc_id", "toxic")
    model = toxicity.fit(docs, labels)
    return toxicity.score(docs, model).withColumn("held_out", out)


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "similarity")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repair(table(spark, sf_dir, "conversations"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_documents(table(spark, sf_dir, "documents")).select("doc_id", "n_tokens")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipes.equal_texts(table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_minhash_neardup, op2_language_id, op3_line_dedup, op4_toxicity, op5_neighbours, op6_decontaminate, op7_packing, op8_url_filter, op9_chat_format, op10_token_counts, op11_exact_dedup, op12_source_divergence, op13_lexical_search)}

#: Chunks are compared as texts here; the engine compares hashes first.
ORACLE_SQL = {
    "op3_line_dedup": """
WITH docs AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
ln AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM docs),
v AS (SELECT doc_id, line, i, ('0x' || substr(md5(line), 1, 7))::BIGINT AS v FROM ln),
r AS (SELECT doc_id, line, i, v + 31 * coalesce(lag(v) OVER (PARTITION BY doc_id ORDER BY i), 0) AS r FROM v),
c AS (SELECT doc_id, line, i, coalesce(sum((r % 3 = 0)::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM r),
ch AS (SELECT doc_id, pos, string_agg(line, chr(10) ORDER BY i) AS chunk, count(*) AS n FROM c GROUP BY doc_id, pos),
k AS (SELECT doc_id, pos, chunk, n, n >= 2 AND regexp_matches(chunk, '[^ \\t\\n\\x0B\\f\\r]') AND row_number() OVER (PARTITION BY chunk, n >= 2 ORDER BY doc_id, pos) > 1 AS gone FROM ch)
SELECT doc_id, sum(n)::BIGINT AS lines_in, coalesce(sum(n) FILTER (WHERE NOT gone), 0)::BIGINT AS lines_out,
       md5(coalesce(string_agg(chunk, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS text_md5
FROM k GROUP BY doc_id
UNION ALL SELECT doc_id, NULL, NULL, NULL FROM documents WHERE text IS NULL""",
    "op11_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
WINDOW w AS (PARTITION BY t)""",
    "op12_source_divergence": """
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
occ AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
kept AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM d) GROUP BY ALL HAVING count(*) >= 3),
v AS (SELECT g.lang, count(k.term) AS v FROM (SELECT DISTINCT lang FROM d) g LEFT JOIN kept k USING (lang) GROUP BY ALL),
grp AS (SELECT DISTINCT lang, source FROM d),
cell AS (SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS n FROM grp g JOIN kept k USING (lang) LEFT JOIN occ o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source) + v) AS p FROM cell JOIN v USING (lang)),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang) + v) AS q FROM (SELECT lang, term, sum(n) AS n FROM cell GROUP BY ALL) JOIN v USING (lang)),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 200""",
    "op13_lexical_search": """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
s AS (SELECT count(*) FILTER (len(w) > 0) AS docs, sum(len(w))::BIGINT AS words FROM d),
o AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY ALL),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
t AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM o, s GROUP BY term),
r AS (SELECT item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // words))))::BIGINT AS score FROM i JOIN t USING (term) JOIN o USING (term), s GROUP BY ALL),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM r WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 50""",
}
