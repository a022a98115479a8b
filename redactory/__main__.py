"""python -m redactory --input FILE --output FILE: redacts a file, or the files of a folder into a folder."""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.sql import SparkSession

from redactory.operators import audit
from redactory.operators.detect import Config
from redactory.operators.replace import STRATEGIES
from redactory.plans import library
from redactory.sources.shared import kept


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="redactory", description=__doc__)
    p.add_argument("--input", "-i", required=True, help="a file, or a folder of files")
    p.add_argument("--output", "-o", required=True, help="where the redacted file goes, or the folder for them")
    p.add_argument("--strategy", default="SYNTHETIC", choices=STRATEGIES)
    p.add_argument("--profile", default="cli", choices=["cli", "engine"])
    p.add_argument("--log", help="where the log of replacements goes, as JSON lines")
    p.add_argument("--log-level", default="INFO", choices=["DEBUG", "INFO", "WARNING", "ERROR"])
    a = p.parse_args(args)
    logging.basicConfig(level=a.log_level)
    spark = SparkSession.builder.getOrCreate()
    rows = kept(library.scan_files(spark, a.input, Config(strategy=a.strategy), a.profile), "scanned")  # read for the files, their check and the log
    done = library.redact_files(spark, a.input, rows)
    reports = library.verify(rows, done).collect()  # one row a file
    failed = [r["doc_id"] for r in reports if r["status"] != "PASS"]
    for path in failed:
        logging.error("%s failed its integrity check and is not written", path)
    folder = Path(a.input).is_dir()
    for r in done.toLocalIterator():  # a file at a time
        if r["path"] not in failed:
            to = Path(a.output) / Path(r["path"]).name if folder else Path(a.output)
            to.parent.mkdir(parents=True, exist_ok=True)
            to.write_bytes(r["content"])
    if a.log:
        log = audit.audit_log(audit.explode_matches(rows).where("approved"))
        Path(a.log).write_text("".join(json.dumps(r.asDict()) + "\n" for r in log.toLocalIterator()))
    return int(bool(failed))


if __name__ == "__main__":
    raise SystemExit(main())
