"""A training corpus from raw documents: language, repeated lines, near-duplicates, benchmark passages, source mix.

Every stage takes (spark, docs, sf_dir) and works on all documents that its predecessor kept; its result is written as
Parquet and read again as the next stage's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from millspark.llm import decontaminate, language, lines, mixing, neardup
from millspark.llm.common import NULL_ID, crc_remainder, picked, sized
from millspark.session import configure, staged

COLUMNS = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}
BROADCAST_IDS = 1_000_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null texts, texts without a letter) go; a missing ``lang`` is filled in."""
    docs = picked(docs, **COLUMNS)
    model = language.fit(docs.filter(crc_remainder(F.col("doc_id"), 3) != 1))
    found = language.identify(docs, model, carry=tuple(COLUMNS)).filter("lang_pred <> 'und'")
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a smaller document holds go from the texts; all documents stay."""
    kept = lines.remove_repeated_lines(picked(docs, **COLUMNS), carry=("lang", "source"))
    return kept.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each near-duplicate class stays."""
    docs = picked(docs, **COLUMNS)
    gone = staged(neardup.near_duplicates(docs).filter("doc_id <> class_id").select("doc_id").distinct())
    return docs.join(sized(gone, BROADCAST_IDS), "doc_id", "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages make up a twentieth or more go."""
    docs = picked(docs, **COLUMNS)
    judged = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = staged(judged.filter("contaminated").select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("_id"), "_text").distinct())
    keyed = docs.withColumns({"_id": F.coalesce("doc_id", F.lit(NULL_ID)), "_text": F.xxhash64("text")})
    return keyed.join(sized(gone, BROADCAST_IDS), ["_id", "_text"], "left_anti").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per copy that the mix takes: the document's columns and ``copy`` from 1."""
    mixed = mixing.mix_sources(picked(docs, **COLUMNS), carry=("text", "lang", "source", "n_chars")).filter("copies > 0")
    return mixed.select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))


STAGES = [
    ("language", identify_language),
    ("lines", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
]

# Language classifiers and signatures have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written and read again."""
    docs = configure(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
