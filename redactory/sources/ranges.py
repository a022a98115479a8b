"""Large text and CSV files, read in byte ranges by many tasks, with the line and row numbers of the whole file.

Spark's text reader cuts a file into ranges and gives each line to one of them. A task numbers the lines of its range, and says
what the range does to what follows it: how many lines it adds, and for CSV, from which of two states (outside quotes, or
within) it leads to which, with how many rows. Prefix sums over the ranges of a file, a row for each range, give every range its
first number and its state. The lines with their numbers within ranges are written to the shared folder before, as ranges may be
cut otherwise in another run.

Texts are decoded as UTF-8 with replacement characters; a mark of byte order stays where it is. Empty files have no lines."""

from __future__ import annotations

import csv
import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from redactory.sources import readers
from redactory.sources.shared import kept

#: Files above this are read in ranges by `read_documents`.
LARGE = 64 << 20
#: Line ends but those of the reader, which the text keeps.
LINE_END = readers.LINE_END


def _raw(spark: SparkSession, path: str, kind: str, above: int) -> DataFrame:
    """(path, block, size, value, bytes): lines between line feeds, in order within a block; a block is a range of a file."""
    rows = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"))
    rows = rows.where((readers.adapter_column(F.col("path")) == kind) & (F.col("size") > above))
    return rows.select(F.regexp_replace("path", "^file:/+", "file:/").alias("path"), "block", "size", F.make_valid_utf8("value").alias("value"), F.octet_length("value").cast("long").alias("bytes"))


def _edges(batch: pa.RecordBatch) -> np.ndarray:
    """Starts of the stretches of a batch that lie in one block, and its end."""
    path, block = batch.column("path").dictionary_encode().indices.to_numpy(zero_copy_only=False), np.asarray(batch.column("block"))
    new = np.flatnonzero((np.diff(path) != 0) | (np.diff(block) != 0)) + 1
    return np.concatenate(([0], new, [batch.num_rows])).astype(np.int64)


def _stretches(batches):
    """(batch, start, end, whether the block starts here)."""
    last = None
    for batch in batches:
        edges = _edges(batch) if batch.num_rows else [0]
        for a, b in zip(edges[:-1], edges[1:]):
            here = batch.column("path")[a].as_py(), batch.column("block")[a].as_py()
            yield batch.slice(a, b - a), here != last
            last = here


def _line_numbers(batches):
    at = 0
    for rows, new in _stretches(batches):
        n = np.asarray(rows.column("n"), np.int64)
        first = np.cumsum(n) - n + (0 if new else at)
        at = int(first[-1] + n[-1])
        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(first)], names=[*rows.schema.names, "at"])


def _parts(text: Column) -> Column:
    return F.filter(F.split(text, LINE_END, -1), lambda x: x != "")


def read_lines(spark: SparkSession, path: str, above: int = -1) -> DataFrame:
    """Segments of the text files under a path that have more than `above` bytes: lines with their ends, as Python's splitlines cuts them."""
    rows = _raw(spark, path, "txt", above).withColumn("n", F.size(_parts(F.concat("value", F.lit("\n")))).cast("long"))
    rows = kept(rows.mapInArrow(_line_numbers, "path string, block long, size long, value string, bytes long, n long, at long"), "lines")
    blocks = rows.groupBy("path", "block").agg(F.sum("n").alias("n"), F.sum(F.col("bytes") + 1).alias("bytes"), F.max("size").alias("size"))
    by_file = blocks.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("block", "n", "bytes"))).alias("b"), F.max("size").alias("size"))  # a row a range
    before = F.transform("b", lambda x, i: F.struct(x["block"].alias("block"), x["n"].alias("lines"), F.aggregate(F.slice("b", F.lit(1), i), F.lit(0).cast("long"), lambda a, y: a + y["n"]).alias("first"), (i == F.size("b") - 1).alias("last"), (i == 0).alias("opens")))
    rest = F.col("size") - F.aggregate("b", F.lit(0).cast("long"), lambda a, y: a + y["bytes"])  # -1: no line feed at the end; the reader drops a mark of 3 bytes
    told = by_file.select("path", F.pmod(rest, F.lit(3)).alias("rest"), (rest > 1).alias("mark"), F.inline(before)).withColumn("ended", F.col("rest") == 0)
    rows = rows.join(told.select("path", "block", "lines", "first", "last", "opens", "mark", "ended"), ["path", "block"])
    open_end = F.col("last") & ~F.col("ended") & (F.col("at") + F.col("n") == F.col("lines"))
    text = F.concat(F.when(F.col("mark") & F.col("opens") & (F.col("at") == 0), "﻿").otherwise(""), "value", F.when(open_end, "").otherwise("\n"))
    out = rows.select("path", (F.col("first") + F.col("at")).alias("line"), F.posexplode(_parts(text)).alias("k", "text")).withColumn("seg_ord", F.col("line") + F.col("k"))
    return out.select(F.col("path").alias("doc_id"), F.concat(F.lit("line_"), F.col("seg_ord").cast("string")).alias("segment_id"), "seg_ord", "text", F.create_map(F.lit("line_number"), (F.col("seg_ord") + 1).cast("string")).alias("meta"))


# ---------------------------------------------------------------- CSV


def after(line: str, mark: str, quoted: bool) -> tuple[bool, int]:
    """Whether a line that starts within quotes, or not, ends within them, and how many rows end in it (a carriage return outside quotes ends one)."""
    if '"' not in line and "\r" not in line[:-1]:
        return quoted, int(not quoted)
    rows, at, opens = 0, 0, not quoted
    end = len(line) - line.endswith("\r")
    while at < end or quoted:
        if quoted:
            at = line.find('"', at)
            if at < 0:
                return True, rows
            doubled = line[at + 1 : at + 2] == '"'
            quoted, opens, at = doubled, False, at + 1 + doubled
        elif opens and line[at] == '"':
            quoted, at = True, at + 1
        else:
            stops = [x for x in (line.find(mark, at), line.find("\r", at, end)) if x >= 0]
            if not stops:
                break
            at = min(stops)
            rows += line[at] == "\r"
            opens, at = True, at + 1
    return False, rows + 1


def _states(batches):
    """For both states at the start of a block, each line's state (s), the rows (c) and the texts of whole rows (g) that began before it."""
    now = [[0, 0, 0], [1, 0, 0]]
    for rows, new in _stretches(batches):
        if new:
            now, at = [[0, 0, 0], [1, 0, 0]], 0
        mark, out = "\t" if rows.column("path")[0].as_py().endswith(".tsv") else ",", []
        for line in rows.column("value").to_pylist():
            told = [0, 0]
            ways = [after(line, mark, False), after(line, mark, True)]
            for h, x in enumerate(now):
                s = x[0]
                told += x
                x[0], n = ways[s]
                x[1], x[2] = x[1] + n, x[2] + (not s)
            out.append((at, *told[2:], int(now[0][0]), now[0][1], now[0][2], int(now[1][0]), now[1][1], now[1][2]))
            at += 1
        yield pa.RecordBatch.from_arrays([rows.column("path"), rows.column("block"), rows.column("value"), *(pa.array([int(r[k]) for r in out], pa.int64()) for k in range(13))], names=_STATE)


_STATE = ["path", "block", "value", "at", *(f"{x}{h}" for h in (0, 1) for x in "scg"), *(f"{x}{h}" for h in (0, 1) for x in "tdh")]


def read_cells(spark: SparkSession, path: str, above: int = -1) -> DataFrame:
    """Segments of the CSV and TSV files under a path that have more than `above` bytes: cells that aren't blank, by Python's rules of quotes.

    A row that goes over several lines is put together from them; rows of one line, nearly all, are parsed where they are. seg_ord
    tells the order only: row * 2**20 + column. What follows a quote that is never closed is one cell, as in csv, but
    for a line feed at the end of the file."""
    schema = "path string, block long, value string, " + ", ".join(f"{x} long" for x in _STATE[3:])
    rows = kept(_raw(spark, path, "csv", above).select("path", "block", "value").mapInArrow(_states, schema), "csv-lines")
    ends = rows.groupBy("path", "block").agg(F.max_by(F.struct("t0", "d0", "h0", "t1", "d1", "h1"), "at").alias("e"))
    by_file = ends.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("block", "e"))).alias("b"))  # a row a range
    zero = F.lit(0).cast("long")
    begin = F.struct(zero.alias("s"), zero.alias("c"), zero.alias("g"), F.array().cast("array<struct<block:bigint,s:bigint,c:bigint,g:bigint>>").alias("out"))
    way = lambda a, e, x: F.when(a["s"] == 0, e[f"{x}0"]).otherwise(e[f"{x}1"])
    step = lambda a, x: F.struct(way(a, x["e"], "t").alias("s"), (a["c"] + way(a, x["e"], "d")).alias("c"), (a["g"] + way(a, x["e"], "h")).alias("g"), F.concat(a["out"], F.array(F.struct(x["block"].alias("block"), a["s"].alias("s"), a["c"].alias("c"), a["g"].alias("g")))).alias("out"))
    told = by_file.select("path", F.inline(F.aggregate("b", begin, step, lambda a: a["out"])))
    own = lambda x: F.when(F.col("s") == 0, F.col(f"{x}0")).otherwise(F.col(f"{x}1"))
    rows = rows.join(told, ["path", "block"]).select("path", "block", "at", "value", own("s").alias("within"), own("t").alias("leaves"), (F.col("c") + own("c")).alias("row"), (F.col("g") + own("g")).alias("text_no"))
    single = rows.where("within = 0 and leaves = 0").select("path", "row", F.col("value").alias("text"))
    some = rows.where("within = 1 or leaves = 1").withColumn("text_no", F.col("text_no") + (1 - F.col("within")))  # a text's first line is outside quotes
    put = some.groupBy("path", "text_no").agg(F.min("row").alias("row"), F.array_sort(F.collect_list(F.struct("block", "at", "value"))).alias("v"))
    return single.unionByName(put.select("path", "row", F.array_join(F.transform("v", lambda x: x["value"]), "\n").alias("text"))).mapInArrow(_cells, "doc_id string, segment_id string, seg_ord long, text string, meta map<string,string>")


def _cells(batches):
    for batch in batches:
        out = []
        for path, first, text in zip(*(c.to_pylist() for c in batch.columns)):
            mark = "\t" if path.endswith(".tsv") else ","
            for r, row in enumerate(csv.reader(io.StringIO(text, newline=""), delimiter=mark), first):
                out += [(path, f"csv_r{r}_c{c}", (r << 20) + c, x, [("row", str(r)), ("col", str(c)), ("delimiter", mark)]) for c, x in enumerate(row) if x.strip()]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.map_(pa.string(), pa.string())]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["doc_id", "segment_id", "seg_ord", "text", "meta"])
