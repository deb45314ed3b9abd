"""From raw documents to packed sequences, by five operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import decontaminate, langid, linededup, neardup, packing
from lectern.llm.common import materialize, table

#: A document is rejected if no language has this share of its letters.
CLEAR = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or of no clear language, go."""
    model = langid.fit(docs)
    found = langid.identify(docs, model, with_text_hash=True).where((F.col("lang_pred") == "und") | (F.col("score") < CLEAR))
    found = found.select(F.col("doc_id").alias("_r_id"), F.col("text_hash").alias("_r_hash")).distinct()
    # By id and text: a doc_id may stand for several texts, or be null.
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_r_id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("_r_hash"))
    return docs.join(found, same, "left_anti").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages of lines go; n_chars follows; documents left without text go."""
    found = linededup.drop_repeated_lines(docs, extended=True)
    changed = F.col("lines_in") != F.col("lines_out")
    found = found.where(~F.coalesce(changed, F.lit(False)) | F.col("text").rlike(r"\S"))
    return found.withColumn("n_chars", F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.drop_near_duplicates(docs).select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("language ID", language), ("line dedup", lines), ("MinHash near-dedup", near_duplicates), ("benchmark decontamination", benchmark), ("packing", pack)]

#: Language ID and near-dedup are not SQL; stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
