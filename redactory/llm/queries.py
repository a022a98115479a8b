"""The queries of these operators: each applies one to its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactory.llm._common import crc_mod, table


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from redactory.llm.ngram_join import ngram_join

    return ngram_join(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from redactory.llm.substring_dedup import substring_dedup

    return substring_dedup(table(spark, sf_dir, "documents"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from redactory.llm.token_files import read_files, write_files

    return read_files(write_files(table(spark, sf_dir, "documents")))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from redactory.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from redactory.llm.warc import archive_pages

    return archive_pages(table(spark, sf_dir, "pages")).drop("uri")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from redactory.llm.toxicity import fit, score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = fit(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 4) != 2)
    return score(docs, weights).select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from redactory.llm.media import read, store

    return read(store(table(spark, sf_dir, "documents")))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from redactory.llm.lm_score import crc_fold, score

    return score(table(spark, sf_dir, "documents"), crc_fold(5, 1))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from redactory.llm.line_dedup import line_dedup

    return line_dedup(table(spark, sf_dir, "documents"))


def line_dedup_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line dedup as the pipeline's stage has it: one or two lines of over 50 words are a repeat as well."""
    from redactory.llm.line_dedup import line_dedup

    return line_dedup(table(spark, sf_dir, "documents"), words=50)


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from redactory.llm.decontaminate import contained

    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from redactory.llm.ranked import ranked_search

    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from redactory.llm.licences import licence_scan

    return licence_scan(table(spark, sf_dir, "documents")).drop("spans")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from redactory.llm.runs import periodic_runs, replayed

    return periodic_runs(table(spark, sf_dir, "documents"), reread=replayed).drop("runs")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    made = [op1_line_dedup, op2_warc_revisits, op3_substring_dedup, op4_token_files, op5_toxicity, op6_benchmark_decontamination, op7_media_columns, op8_lm_scoring, op9_best_fit_packing, op10_ngram_jaccard_join, op11_ranked_search, op12_licence_scan, op13_periodic_runs, line_dedup_words, pipeline]
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    """The queries that SQL expresses and answers on whole tables in reasonable time."""
    from redactory.llm import decontaminate, line_dedup, sql

    return {"op1_line_dedup": line_dedup.oracle_sql(), "line_dedup_words": line_dedup.oracle_sql(words=50), "op6_benchmark_decontamination": decontaminate.oracle_sql()} | sql.ORACLES
