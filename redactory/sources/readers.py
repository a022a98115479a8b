"""Files as rows of segments (doc_id, segment_id, seg_ord, text, meta)."""

from __future__ import annotations

import csv
import io
from itertools import batched

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactory.sources import office, pdf, sheets

SEGMENT = "doc_id string, segment_id string, seg_ord int, text string, meta map<string,string>"
ADAPTERS = {"docx": "docx docm", "txt": "txt log text md", "xlsx": "xlsx xlsm xltx", "csv": "csv tsv", "pdf": "pdf"}
EXTRACTORS: dict = {}
SEGMENTS_AT_ONCE = 2_000
#: Where a line of Python's splitlines ends.
LINE_END = r"(?<=[\n\x0B\x0C\x1C-\x1E\x85  ])|(?<=\r)(?!\n)"


def supported_extensions() -> list[str]:
    return sorted(e for x in ADAPTERS.values() for e in x.split())


def register_adapter(kind: str, extensions: str, extract) -> None:
    """extract(name, content) yields (segment_id, text, meta)."""
    ADAPTERS[kind] = extensions
    EXTRACTORS[kind] = extract


def adapter_of(name: str, adapters: dict | None = None) -> str:
    ending = name.rpartition(".")[2].lower()
    for kind, endings in (adapters or ADAPTERS).items():
        if "." in name and ending in endings.split():
            return kind
    raise ValueError(f"unsupported file type: {name}")


def adapter_column(path):
    """The adapter of a path, null if there is none."""
    ending = F.lower(F.regexp_extract(path, r"\.([^.]*)$", 1))
    out = F.lit(None).cast("string")
    for kind, endings in ADAPTERS.items():
        out = F.when(ending.isin(endings.split()), kind).otherwise(out)
    return out


def line_segments(docs: DataFrame, doc: str = "doc_id", text: str = "text", feeds: bool = False) -> DataFrame:
    """Lines with their ends, as Python's splitlines cuts them; blank lines are kept, a null text has none.

    feeds: as SQL's split at line feeds has them instead: nothing else ends a line, and what follows the last one is a line even if it is empty, so an empty text has one."""
    parts = F.split(F.col(text), r"(?<=\n)", -1) if feeds else F.filter(F.split(F.col(text), LINE_END, -1), lambda x: x != "")
    rows = docs.where(F.col(text).isNotNull()).select(F.col(doc).alias("doc_id"), F.posexplode(parts).alias("seg_ord", "text"))
    return rows.select("doc_id", F.concat(F.lit("line_"), F.col("seg_ord").cast("string")).alias("segment_id"), "seg_ord", "text", F.create_map(F.lit("line_number"), (F.col("seg_ord") + 1).cast("string")).alias("meta"))


def block_segments(docs: DataFrame, doc: str = "doc_id", text: str = "text", page: int = 0) -> DataFrame:
    """Blocks of a page's text between blank lines; blank blocks are counted but not kept."""
    rows = docs.select(F.col(doc).alias("doc_id"), F.posexplode(F.split(F.col(text), "\n\n", -1)).alias("seg_ord", "text")).where(F.col("text").rlike(r"(?U)\S"))
    return rows.select("doc_id", F.format_string(f"pdf_page_{page}_block_%d", "seg_ord").alias("segment_id"), "seg_ord", "text", F.create_map(F.lit("page"), F.lit(str(page + 1))).alias("meta"))


def cell_segments(table: DataFrame, doc: str, row: str) -> DataFrame:
    """Cells of a wide table as CSV segments; blank cells are skipped."""
    columns = [c for c in table.columns if c not in (doc, row)]
    cells = F.posexplode(F.array(*[F.col(c).cast("string") for c in columns])).alias("c", "text")
    rows = table.select(F.col(doc).alias("doc_id"), F.col(row).cast("int").alias("r"), cells).where(F.col("text").rlike(r"(?U)\S"))
    return rows.select("doc_id", F.format_string("csv_r%d_c%d", "r", "c").alias("segment_id"), (F.col("r") * len(columns) + F.col("c")).alias("seg_ord"), "text", F.create_map(F.lit("row"), F.col("r").cast("string"), F.lit("col"), F.col("c").cast("string")).alias("meta"))


def _txt(name: str, content: bytes):
    for i, line in enumerate(content.decode("utf-8", "replace").splitlines(keepends=True)):
        yield f"line_{i}", line, {"line_number": str(i + 1)}


def _csv(name: str, content: bytes):
    mark = "\t" if name.endswith(".tsv") else ","
    for r, row in enumerate(csv.reader(io.StringIO(content.decode("utf-8", "replace"), newline=""), delimiter=mark)):
        for c, cell in enumerate(row):
            if cell.strip():
                yield f"csv_r{r}_c{c}", cell, {"row": str(r), "col": str(c), "delimiter": mark}


def _xlsx(name: str, content: bytes):
    yield from sheets.segments(content)


def _docx(name: str, content: bytes):
    yield from office.docx_segments(content)


def page_blocks(pages):
    """Segments of pages' texts: the blocks between blank lines, those that aren't blank."""
    for k, text in enumerate(pages):
        for i, block in enumerate((text or "").split("\n\n")):
            if block.strip():
                yield f"pdf_page_{k}_block_{i}", block, {"page": str(k + 1), "block": str(i)}


def _pdf(name: str, content: bytes):
    yield from page_blocks(pdf.pages(content))


EXTRACTORS |= {"txt": _txt, "csv": _csv, "xlsx": _xlsx, "docx": _docx, "pdf": _pdf}


def segments_of(name: str, content: bytes, adapters: dict | None = None, extractors: dict | None = None):
    return (extractors or EXTRACTORS)[adapter_of(name, adapters)](name, content)


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the supported files under a path."""
    return spark.read.format("binaryFile").load(path).select("path", "content").where(adapter_column(F.col("path")).isNotNull())


def segments(contents: DataFrame) -> DataFrame:
    """Segments of files (path, content), parsed where they are; with the adapters that are registered now. A file's segments leave
    its task as they are found, some at a time."""
    adapters, extractors = dict(ADAPTERS), dict(EXTRACTORS)

    def run(batches):
        for pdf in batches:
            rows = ((p, s, i, t, m) for p, c in zip(pdf["path"], pdf["content"]) for i, (s, t, m) in enumerate(segments_of(p, c, adapters, extractors)))
            for some in batched(rows, SEGMENTS_AT_ONCE):
                yield pd.DataFrame(some, columns=["doc_id", "segment_id", "seg_ord", "text", "meta"])

    return contents.select("path", "content").mapInPandas(run, SEGMENT)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Segments of all files under a path, by their endings; large text and CSV files are read in ranges (see `ranges`)."""
    from redactory.sources import ranges

    large = F.col("length") > ranges.LARGE
    listed = spark.read.format("binaryFile").load(path).select("path", "length", adapter_column(F.col("path")).alias("kind"))
    kinds = {r[0] for r in listed.where(large & F.col("kind").isin("txt", "csv")).select("kind").distinct().collect()}
    split = F.col("length").isNotNull() & large & adapter_column(F.col("path")).isin(list(kinds)) if kinds else F.lit(False)
    small = spark.read.format("binaryFile").load(path).where(adapter_column(F.col("path")).isNotNull() & ~split).select("path", "content")
    out = segments(small)
    for kind, read in (("txt", ranges.read_lines), ("csv", ranges.read_cells)):
        if kind in kinds and EXTRACTORS.get(kind) in (_txt, _csv):
            out = out.unionByName(read(spark, path, ranges.LARGE))
    return out


def _of_docx(content_rows: DataFrame, make, columns: str, schema: str) -> DataFrame:
    def run(batches):
        for pdf in batches:
            rows = [(p, *r) for p, c in zip(pdf["path"], pdf["content"]) if adapter_of(p) == "docx" for r in make(c)]
            yield pd.DataFrame(rows, columns=["doc_id", *columns.split()])

    return content_rows.select("path", "content").where(adapter_column(F.col("path")) == "docx").mapInPandas(run, schema)


def docx_runs(content_rows: DataFrame) -> DataFrame:
    """(doc_id, segment_id, run, start, end, text) of the runs of DOCX files (path, content), those in links as well."""
    return _of_docx(content_rows, office.docx_runs, "segment_id run start end text", "doc_id string, segment_id string, run int, start int, end int, text string")


def docx_stats(content_rows: DataFrame) -> DataFrame:
    """(doc_id, paragraphs, tables, sections, unique_headers, unique_footers) of DOCX files (path, content)."""
    names = "paragraphs tables sections unique_headers unique_footers"
    return _of_docx(content_rows, lambda c: [tuple(office.docx_stats(c)[k] for k in names.split())], names, "doc_id string, " + ", ".join(f"{k} long" for k in names.split()))


def document_stats(segments: DataFrame) -> DataFrame:
    """Segments, characters and blank segments of each document, of any kind of file."""
    return segments.groupBy("doc_id").agg(F.count("*").alias("segments"), F.sum(F.length("text")).alias("characters"), F.count_if(F.expr("length(trim(text)) = 0")).alias("blank_segments"))


def read_gold(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Annotations and negative phrases of one JSON file."""
    raw = spark.read.json(path, multiLine=True)
    return raw.select(F.inline("annotations")), raw.select(F.inline("negative_candidates"))
