"""The calls of a redaction service as functions: formats and packs, files in and out, verification, history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactory.functions.vocabulary import PACKS
from redactory.operators import audit
from redactory.operators.detect import ORDER, Config
from redactory.operators.replace import STRATEGIES
from redactory.plans import engine
from redactory.sources import readers, writers

HISTORY = "doc_id string, n_segments long, n_matches long, n_approved long, status string, created_at timestamp"


def health() -> dict:
    return {"status": "healthy", "formats": readers.supported_extensions(), "categories": list(ORDER), "strategies": list(STRATEGIES)}


def packs() -> dict[str, list[str]]:
    """Names of the packs of protected phrases, and their phrases."""
    return {k: v.split(";") for k, v in PACKS.items()}


def scan_files(spark: SparkSession, path: str, config: Config = Config(), profile: str = "engine") -> DataFrame:
    """Segments of all files under a path with their matches and replacements."""
    return engine.replaced(engine.detected(readers.read_documents(spark, path), config, profile), config)


def detections(rows: DataFrame, entity_type: str | None = None) -> DataFrame:
    """A row for each match, with its id."""
    out = audit.match_id(audit.explode_matches(rows))
    return out if entity_type is None else out.where(F.col("entity_type") == entity_type)


def redact_files(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """(path, content): the files with the approved matches of rows replaced."""
    return writers.redacted_files(readers.files(spark, path), rows)


def verify(rows: DataFrame, redacted: DataFrame) -> DataFrame:
    """The integrity report of redacted files (path, content) against the scanned rows: what is read back must be as expected."""
    back = readers.segments(redacted)
    kept = rows.select("doc_id", "segment_id", "text", engine.approved(F.col("matches")).alias("matches"))
    return audit.integrity_report(audit.integrity_rows(kept, back))


def download(redacted: DataFrame, report: DataFrame) -> DataFrame:
    """The redacted files; raises if any failed its integrity check."""
    audit.download_gate(report)
    return redacted


def log_history(rows: DataFrame, report: DataFrame, path: str) -> None:
    """Append a row for each document to the history table."""
    n = F.size("matches")
    sums = rows.groupBy("doc_id").agg(F.count("*").alias("n_segments"), F.sum(n).cast("long").alias("n_matches"), F.sum(F.size(engine.approved(F.col("matches")))).cast("long").alias("n_approved"))
    out = sums.join(report.select("doc_id", "status"), "doc_id", "left").withColumn("created_at", F.current_timestamp())
    out.write.mode("append").parquet(path)


def history(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """The history, newest first; limit: only so many."""
    out = spark.read.schema(HISTORY).parquet(path).orderBy(F.desc("created_at"), "doc_id")
    return out if limit is None else out.limit(limit)
