"""Tables in the folder that the cluster shares: what several jobs read is computed once, and a lost executor costs no more than its tasks."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: While a table is written: Python gets batches of a few MB, however long the rows are, and nothing reads its shuffle files again once it is there.
WRITING = {"spark.sql.execution.arrow.maxBytesPerBatch": "8m", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: For rows of a MB each: Parquet looks at the size of pages and row groups after 100 rows otherwise, and what writes or reads a row group holds it.
LONG_ROWS = {"parquet.block.size": "8388608", "parquet.page.size.row.check.min": "1", "parquet.block.row.count.limit": "8"}

_written: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; one of our own only where the session names none and all is one process."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = os.path.join(tempfile.gettempdir(), "checkpoints", spark.sparkContext.applicationId)
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def kept(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df, written to the shared folder and read back; deleted when Python exits. options: of the writer, as LONG_ROWS."""
    spark, path = df.sparkSession, f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in WRITING}
    for k, v in WRITING.items():
        spark.conf.set(k, v)
    try:
        df.write.options(**options).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    _written.append((df.sparkSession, path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df, dealt by its keys over all cores several times: a small file of many rows is one task otherwise, however long each row takes."""
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def apart(df: DataFrame) -> DataFrame:
    """df, as a side of a join that is always shuffled: Spark goes by compressed bytes, and ten megabytes of texts much alike are a hundred at the driver."""
    return df.hint("merge")


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the gateway may already be gone at exit
            return
