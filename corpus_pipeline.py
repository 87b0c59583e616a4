"""A training-corpus pipeline of five operators over the documents table.

Each stage works on all rows its predecessor kept. Rows without doc_id are told
apart by a surrogate id from their text; every other row by its doc_id.

Null or empty texts have no letter and go in the first stage, as do texts of
digits or marks only; a null lang is filled, a null source stays, n_chars is
counted anew where it is missing. Very long texts are read whole by every stage. Of rows with equal id and
text the third stage keeps one; of similar documents that of smallest id, so ties don't arise. Columns beside those of
documents are dropped by the first stage, whatever their names; an empty table
passes all stages as an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import common, decontaminate, language_id, line_dedup, ngram_join, packing

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents below this mean probability of their best language go, as do those without letters.
LEAST_SCORE = 0.4


def _key() -> Column:
    """doc_id, or a negative number from the text where it is null."""
    return F.coalesce(F.col("doc_id"), -F.abs(F.shiftrightunsigned(F.xxhash64("text"), 2)) - 1)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; a missing lang is filled with it."""
    if "n_chars" not in docs.columns:
        docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    docs = docs.select(*COLUMNS)
    found = language_id.identify(docs, language_id.fit(docs), keep=COLUMNS[1:])
    sure = found.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return sure.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that a document of smaller id holds; n_chars follows the text."""
    kept = line_dedup.dedup_lines(docs.select(*COLUMNS))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the one of smallest id; of equal rows one."""
    rows = docs.select(*COLUMNS).withColumn("_key", _key())
    groups = ngram_join.jaccard_components(rows, "_key")
    keep = groups.filter(F.col("_key") == F.col("component_id")).select("_key").distinct()
    stay = rows.join(keep, "_key", "left_semi").withColumn("_hash", F.xxhash64("text"))
    return stay.dropDuplicates(["_key", "_hash"]).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark's windows don't cover by a twentieth or more of their words."""
    rows = docs.select(*COLUMNS).withColumn("_key", _key())
    found = decontaminate.decontaminate(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "_key")
    # written first: of known size, so that few keys are broadcast and no text moves
    gone = common.saved(found.filter("contaminated").select("_key").distinct(), "contaminated")
    return rows.join(gone, "_key", "left_anti").select(*COLUMNS)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The batches by token counts: a row for each document with its bucket, batch and slot; null in them for a text of no tokens."""
    return packing.pack_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language", identify_language),
    ("lines", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_batches),
]

#: A trained network and a dynamic program decide here: no SQL gives run()'s rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
