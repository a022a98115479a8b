"""A training corpus from raw documents: toxic ones go, repeated lines go, one of each group of near copies stays, what
contains benchmark items goes, and the rest is packed into sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return the columns of
documents. `run` writes each stage's rows and reads them again. ORACLE_SQL is None: a learned model can't be expressed in SQL.

Null and empty texts are kept by every filtering stage and become sequences of the end id alone. Rows without an id are kept
by the filtering stages and left out of the packing. Of repeated rows with one id all go or all stay. Extra columns go along
until packing. An empty table gives an empty table at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactory.llm import decontaminate, line_dedup, ngram_join, packing, toxicity
from redactory.llm._common import crc_mod, sized, stored, table

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that score below 0.3, by a model of the labelled ones."""
    weights = toxicity.fit(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 4) != 2)
    return toxicity.clean(docs, weights)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later repeats of three lines, or of fewer with over 50 words; a document of which no line is left goes."""
    lines, gone = "_n_lines", "_n_removed"
    while {lines, gone} & {c.lower() for c in docs.columns}:
        lines, gone = f"_{lines}", f"_{gone}"
    out = line_dedup.deduplicated(docs, words=50, counts=(lines, gone)).where((F.col(gone) == 0) | (F.col(gone) < F.col(lines)))
    return out.withColumn("n_chars", F.when(F.col(gone) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.join(sized(stored(ids.select("doc_id").distinct(), "pipeline-ids")), "doc_id", "left_anti").select(docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each component of near copies."""
    return without(docs, ngram_join.ngram_join(docs).where("doc_id != component_id"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that contain no benchmark item."""
    return without(docs, decontaminate.contained(docs, table(spark, sf_dir, "benchmark")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", keep_one_of_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
