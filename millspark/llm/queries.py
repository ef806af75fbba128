"""One registered query per corpus operator over its whole table, and the DuckDB statement where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from millspark.llm import alignment, contentsort, decontaminate, infill, language, lines, mixing, neardup, pii, substring, topk, toxicity, warc
from millspark.session import configure


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored_held_out(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return pii.digest(pii.find_spans(docs, pii.fit(docs)))


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identified_held_out(_table(spark, sf_dir, "documents"))


def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(substring.remove_repeated_passages(_table(spark, sf_dir, "documents")))


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digest(lines.remove_repeated_lines(_table(spark, sf_dir, "documents")))


def source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


def minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digest(infill.fill_in_middle(_table(spark, sf_dir, "documents")))


def tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = alignment.align(_table(spark, sf_dir, "documents"))
    return alignment.digest(aligned, alignment.link_statistics(aligned, alignment.pair_counts(aligned)))


def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contentsort.content_groups(_table(spark, sf_dir, "documents"), keep="largest")


QUERIES = {
    "op1_toxicity": toxicity_scores,
    "op2_personal_data": personal_data,
    "op3_warc": warc_round_trip,
    "op4_substring_dedup": substring_dedup,
    "op5_language_id": language_id,
    "op6_benchmark_decontamination": decontamination,
    "op7_line_dedup": line_dedup,
    "op8_source_mixing": source_mixing,
    "op9_exact_top_k": exact_top_k,
    "op10_minhash_near_dedup": minhash_near_dedup,
    "op11_fill_in_middle": fill_in_middle,
    "op12_tokenizer_alignment": tokenizer_alignment,
    "op13_exact_dedup": exact_dedup,
}

ORACLES = {
    "op3_warc": warc.ORACLE,
    "op6_benchmark_decontamination": decontaminate.ORACLE,
    "op7_line_dedup": lines.ORACLE,
    "op8_source_mixing": mixing.ORACLE,
    "op9_exact_top_k": topk.ORACLE,
    "op11_fill_in_middle": infill.ORACLE,
    "op13_exact_dedup": contentsort.ORACLE,
}
