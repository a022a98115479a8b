"""What the findings of round 4 name: rows as the SQL has them on odd texts, and memory."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from redactory.operators import audit, substrings
from redactory.plans import corpus
from redactory.plans import queries as plans
from redactory.sources import shared

ODD = ["", "\n", "a\n", "a\n\n", "\n" * 15, "\n" * 16, "\n" * 40 + "b", None, "x\r\ny\rz\x0b1\x0c2\x1c3\x1e4\x855\u20286\u20297\n8", "\r", " \n ", "\U0001f600\né\n", "k\n" * 33, "w" * 120 + "\n" + "w" * 99, "one"]


@pytest.mark.parametrize("name", ["src_txt_lines", "src_stats", "sink_txt", "sink_txt_parts", "limit_sample"])
def test_lines_are_those_of_the_sql(spark, tmp_path, name):
    """Empty texts have a line, so has the end behind a last line feed, and nothing but line feeds ends one."""
    spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    here = (plans.queries()[name])(spark, str(tmp_path))
    there = db.sql(f"select {', '.join(f'\"{c}\"' for c in here.columns)} from ({plans.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, here.collect()))) == sorted(map(repr, there))


def test_spot_check_sends_no_table_to_the_driver(spark):
    """Originals, values and windows meet by shuffles alone, also where their compressed bytes would let Spark broadcast them."""
    rows = spark.range(400).select(F.lit("d").alias("doc_id"), F.col("id").alias("seg_ord"), F.concat(F.lit("Plot "), F.col("id"), F.lit(", Harbour Row.")).alias("text"))
    out = audit.spot_check(rows.drop("seg_ord"), rows.where("seg_ord % 2 = 0"))
    assert out.count() == 200
    plan = out._jdf.queryExecution().executedPlan()
    out.collect()
    assert "SortMergeJoin" in plan.toString() and "Broadcast" not in plan.toString()


def test_pieces_have_the_same_key_wherever_they_lie():
    """Also next to characters of two UTF-16 units, and not in another document or of another size."""
    texts, doc = ["ab\U0001f600cdé", "xab\U0001f600cdéy", "", "a", "ab\U0001f600cdé"], np.array([1, 1, 1, 1, 2])
    found = {}
    for size, row, place, key in substrings._pieces_of(texts, doc, 4):
        for r, p, k in zip(row, place, key):
            found.setdefault(int(k), set()).add((int(doc[r]), texts[r][p - 1 : p - 1 + size]))
    pieces = {(int(d), t[i : i + n]) for d, t in zip(doc, texts) for n in (1, 2, 4) for i in range(len(t) - n + 1)}
    assert all(len(x) == 1 for x in found.values()) and {y for x in found.values() for y in x} == pieces


def test_long_rows_are_few_in_a_batch(spark):
    """Python gets some of a task's long rows at a time while a table is kept."""
    rows = spark.range(40).coalesce(1).select(F.repeat(F.lit("x"), 1 << 20).alias("text"))
    sizes = shared.kept(rows.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long"), "sizes")
    assert sizes.agg(F.sum("n"), F.max("n") < 16).first() == (40, True)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") != "8m"


def test_few_workbooks_are_in_a_row_group(spark, tmp_path, monkeypatch):
    """However many one task makes."""
    monkeypatch.setattr(corpus, "WORKBOOK", 1000)
    spark.createDataFrame([(k, f"line {k} " * 200) for k in range(40)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    groups = [f.row_group(k).num_rows for x in corpus._workbooks(spark, str(tmp_path)).inputFiles() for f in [pq.ParquetFile(x.removeprefix("file://")).metadata] for k in range(f.num_row_groups)]
    assert sum(groups) == 40 and max(groups) <= 8
