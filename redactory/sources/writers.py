"""Redacted segments back into documents."""

from __future__ import annotations

import csv
import io

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redactory.functions.text import splice, strip
from redactory.operators.substrings import holding
from redactory.sources import office, pdf, readers, sheets
from redactory.sources.shared import kept

#: Redacted files leave their task when so many bytes or files are done.
BYTES_AT_ONCE = 1 << 22
FILES_AT_ONCE = 1_000
#: Spans of at most so many bytes are sent to all tasks.
FEW_SPANS_BYTES = 32 << 20


def text_documents(segments: DataFrame) -> DataFrame:
    """(doc_id, text): the segments joined in order."""
    rows = F.array_sort(F.collect_list(F.struct("seg_ord", "text")))
    return segments.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda x: x["text"]), "").alias("text"))


def text_parts(segments: DataFrame, segments_a_part: int = 4096) -> DataFrame:
    """(doc_id, part, offset, n_bytes, text): documents in parts of consecutive segments, with the byte at which each starts; joined in order they are the text.

    For documents of any length: a part is a row, and a row for each part is what the offsets are summed up from. The parts
    are written to the shared folder, ranges of documents and parts to a file."""
    rows = F.array_sort(F.collect_list(F.struct("seg_ord", "text")))
    part = (F.col("seg_ord").cast("long") / segments_a_part).cast("long")
    parts = segments.groupBy("doc_id", part.alias("part")).agg(F.array_join(F.transform(rows, lambda x: x["text"]), "").alias("text"))
    parts = kept(parts.withColumn("n_bytes", F.octet_length("text").cast("long")).repartitionByRange("doc_id", "part").sortWithinPartitions("doc_id", "part"), "text-parts")
    before = Window.partitionBy("doc_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.select("doc_id", "part", F.coalesce(F.sum("n_bytes").over(before), F.lit(0)).alias("offset"))
    return parts.join(sums, ["doc_id", "part"]).select("doc_id", "part", "offset", "n_bytes", "text")


def redacted_csv(content: bytes, changes: dict[str, str], delimiter: str = ",") -> bytes:
    """The table with cells csv_r{row}_c{col} changed; quoted where needed, lines ended by CRLF."""
    out = io.StringIO(newline="")
    rows = list(csv.reader(io.StringIO(content.decode("utf-8", "replace"), newline=""), delimiter=delimiter))
    for r, row in enumerate(rows):
        for c in range(len(row)):
            row[c] = changes.get(f"csv_r{r}_c{c}", row[c])
    csv.writer(out, delimiter=delimiter).writerows(rows)
    return out.getvalue().encode()


def redacted_pdf(content: bytes, changes: dict[str, str], texts: list[str] | None = None) -> bytes:
    """A plain file of the pages' texts with blocks pdf_page_{page}_block_{block} changed: nothing else of the old file is in it."""
    pages = [[changes.get(f"pdf_page_{k}_block_{i}", block) for i, block in enumerate(text.split("\n\n"))] for k, text in enumerate(pdf.pages(content) if texts is None else texts)]
    return pdf.made(["\n\n".join(blocks) for blocks in pages])


def run_offsets(runs: Column) -> Column:
    """Runs (text) with the character at which each starts."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<idx:int,start:int,end:int,text:string>>").alias("out"))
    return F.aggregate(runs, start, lambda a, r: F.struct((a["at"] + F.length(r)).alias("at"), F.concat(a["out"], F.array(F.struct(F.size(a["out"]).alias("idx"), a["at"].alias("start"), (a["at"] + F.length(r)).alias("end"), r.alias("text")))).alias("out")), lambda a: a["out"])


def char_run_map(runs: Column) -> Column:
    """For each character its run and its offset there."""
    return F.flatten(F.transform(runs, lambda r, i: F.when(F.length(r) > 0, F.transform(F.sequence(F.lit(0), F.length(r) - 1), lambda k: F.struct(i.alias("run"), k.alias("offset")))).otherwise(F.array().cast("array<struct<run:int,offset:int>>"))))


def splice_runs(runs: Column, matches: Column) -> Column:
    """Runs with disjoint spans replaced: the replacement goes into the run where a span starts, the rest of the span goes."""

    def one(r):
        inside = F.filter(matches, lambda m: (m["start"] < r["end"]) & (m["end"] > r["start"]))
        local = F.transform(inside, lambda m: F.struct(F.greatest(m["start"] - r["start"], F.lit(0)).alias("start"), (F.least(m["end"], r["end"]) - r["start"]).alias("end"), F.when(m["start"] >= r["start"], m["replacement"]).otherwise("").alias("replacement")))
        return splice(r["text"], local)

    return F.transform(run_offsets(runs), one)


def patch_links(links: DataFrame, matches: DataFrame) -> DataFrame:
    """links (doc_id, target) with mailto targets of found emails replaced; a query behind the address goes."""
    emails = matches.where("entity_type = 'EMAIL'").select("doc_id", F.lower("text").alias("address"), "replacement").dropDuplicates(["doc_id", "address"])
    rows = links.withColumn("address", F.lower(F.regexp_extract("target", r"(?i)^mailto:([^?]*)", 1)))
    return rows.join(emails, ["doc_id", "address"], "left").select("doc_id", F.when(F.col("replacement").isNotNull(), F.concat(F.lit("mailto:"), "replacement")).otherwise(F.col("target")).alias("target"))


def patch_any_links(links: DataFrame, matches: DataFrame) -> DataFrame:
    """links (doc_id, target, ...) whose targets hold an address that was found in their document, anywhere and in any case, with it replaced.

    Such targets come out in lower case. Of several addresses that a target holds the one counts that is first seen last; of
    several replacements of an address the last. Targets and addresses meet by `substrings.holding`. matches: doc_id, seg_ord,
    start, entity_type, text, replacement."""
    order = F.struct("seg_ord", "start")
    found = matches.where("entity_type = 'EMAIL' and replacement <> ''").select("doc_id", F.lower(strip(F.col("text"))).alias("value"), "replacement", order.alias("at"))
    emails = kept(found.groupBy("doc_id", "value").agg(F.min("at").alias("at"), F.max_by("replacement", "at").alias("replacement")), "addresses")
    targets = kept(links.where("target is not null").select("doc_id", F.lower("target").alias("text")).distinct(), "targets")
    pairs = holding(targets.select("text").distinct(), emails.select("value").distinct(), "pairs")
    new = targets.join(pairs, "text").join(emails, ["doc_id", "value"]).groupBy("doc_id", "text").agg(F.max_by(F.struct("value", "replacement"), "at").alias("_new")).withColumnRenamed("text", "_text")
    rows = links.withColumn("_text", F.lower("target")).join(new, ["doc_id", "_text"], "left")
    target = F.when(F.col("_new").isNull(), F.col("target")).otherwise(F.replace(F.col("_text"), F.col("_new.value"), F.col("_new.replacement")))
    return rows.select(*[target.alias("target") if c == "target" else F.col(c) for c in links.columns])


def _new_content(name: str, content: bytes, spans: dict, emails: dict, adapters: dict) -> bytes:
    kind = readers.adapter_of(name, adapters)
    if kind == "docx":
        return office.redacted_docx(content, spans, emails)
    if kind == "xlsx":
        return sheets.redacted(content, spans)
    if kind == "pdf" and readers.EXTRACTORS["pdf"] is readers._pdf:  # parsed once, for its segments and its new pages
        pages = pdf.pages(content)
        return redacted_pdf(content, {s: office.spliced_runs([t], spans[s])[0] for s, t, _ in readers.page_blocks(pages) if spans.get(s)}, pages)
    made = {s: (office.spliced_runs([t], spans[s])[0] if spans.get(s) else t) for s, t, _ in readers.segments_of(name, content, adapters)}
    if kind == "csv":
        return redacted_csv(content, made, "\t" if name.endswith(".tsv") else ",")
    if kind == "pdf":
        return redacted_pdf(content, made)
    return "".join(made.values()).encode()


def redacted_files(contents: DataFrame, rows: DataFrame) -> DataFrame:
    """(path, content) of files with the approved matches replaced, in their own format (of a PDF a plain one with its text).

    contents: path, content. rows: doc_id (the path), segment_id, matches with replacements. A file's matches meet in one task,
    where its bytes are: the spans, which are counted first, go to all tasks if they are few, else the files meet them in a shuffle."""
    adapters = dict(readers.ADAPTERS)
    approved = F.filter("matches", lambda m: m["approved"])
    spans = F.transform(approved, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.coalesce(m["replacement"], F.lit("")).alias("new"), (m["entity_type"] == "EMAIL").alias("email"), m["text"].alias("text")))
    by_file = rows.select(F.col("doc_id").alias("path"), F.struct("segment_id", spans.alias("spans")).alias("s")).where(F.size("s.spans") > 0).groupBy("path").agg(F.collect_list("s").alias("segments"))
    by_file = kept(by_file, "spans-by-file")
    size = F.aggregate("segments", F.lit(64).cast("long"), lambda a, s: F.aggregate(s["spans"], a + 64, lambda b, m: b + 64 + 4 * (F.length(m["new"]) + F.length(m["text"]))))
    if (by_file.agg(F.sum(size)).first()[0] or 0) <= FEW_SPANS_BYTES:
        by_file = F.broadcast(by_file)

    def run(batches):
        out, size = [], 0
        for pdf in batches:
            for path, content, segments in zip(pdf["path"], pdf["content"], pdf["segments"]):
                found = [] if segments is None else list(segments)
                by = {s["segment_id"]: [(m["start"], m["end"], m["new"]) for m in s["spans"]] for s in found}
                emails = {m["text"].strip(): m["new"] for s in found for m in s["spans"] if m["email"] and m["new"]}
                out.append((path, _new_content(path, content, by, emails, adapters)))
                size += len(out[-1][1])
                if size > BYTES_AT_ONCE or len(out) == FILES_AT_ONCE:
                    yield pd.DataFrame(out, columns=["path", "content"])
                    out, size = [], 0
        yield pd.DataFrame(out, columns=["path", "content"])

    return contents.select("path", "content").join(by_file, "path", "left").mapInPandas(run, "path string, content binary")


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def markdown_report(by_type: list[dict], micro: dict, negatives: dict, integrity: dict, stats: dict | None = None, macro: dict | None = None, residual: int | None = None) -> str:
    """A report of rows that are bounded by the number of types: summary, document and integrity, types, overall, phrases to leave
    alone, residual findings, invariants."""
    cell = lambda x: "N/A" if x is None else str(x)
    items = lambda d: [f"- {k}: {cell(v)}" for k, v in (d or {}).items()]
    names = ("gold", "predicted", "tp", "fp", "fn", "precision", "recall", "f1", "accuracy")
    rows = [f"| {r['entity_type']} | " + " | ".join(cell(r[k]) for k in names) + " |" for r in by_type]
    sections = {
        "Summary": [f"- integrity: {cell(integrity.get('status'))}", f"- F1, micro: {cell(micro.get('f1'))}"],
        "Document and integrity": items(stats) + items(integrity),
        "By type": ["| type | " + " | ".join(names) + " |", "| --- " * (len(names) + 1) + "|", *rows],
        "Overall": items(micro) + items({f"macro {k}": v for k, v in (macro or {}).items()}),
        "Phrases to leave alone": items(negatives),
        "Residual findings": [f"- findings that are no known replacement: {cell(residual)}"],
        "Invariants": ["- text outside approved spans is unchanged", "- a failed integrity check holds back the document"],
    }
    return "\n".join(["# Evaluation", ""] + [x for title, body in sections.items() for x in (f"## {title}", "", *body, "")])
