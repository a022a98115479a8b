"""What the findings of round 3 name: right rows on odd texts, and work that is dealt over tasks."""

import difflib
import io
import random
import time
import zipfile

import duckdb
from pyspark.sql import functions as F

from redactory.operators import audit, substrings
from redactory.plans import corpus
from redactory.plans import queries as plans
from redactory.sources import pdf, readers, sheets, writers


def _documents(spark, folder, texts):
    path = f"{folder}/documents.parquet"
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(path)
    return f"{folder}"


def _sql(folder, name, sql):
    db = duckdb.connect()
    db.sql(f"create view {name} as select * from '{folder}/{name}.parquet/*.parquet'")
    return sorted(db.sql(sql).fetchall())


def test_first_seen_of_letters_that_change_their_number(spark, tmp_path):
    sf = _documents(spark, tmp_path, ["groß a", "GROß b", "groß c", "groß d", "fußß e", "ßß f", "ǆ j", "Straße k", "ẞ l", "groß", "", " x", "ab ß"] * 3)
    assert sorted(map(tuple, corpus.repl_first_seen(spark, sf).collect())) == _sql(sf, "documents", corpus.SQL["repl_first_seen"])


def test_spot_check_over_borders_of_windows(spark, monkeypatch):
    monkeypatch.setattr(substrings, "WINDOW", 8)
    monkeypatch.setattr(substrings, "SEGMENTS", 3)
    r = random.Random(1)
    word = lambda a, b: "".join(r.choice("abÅé") for _ in range(r.randint(a, b)))
    segments = [(d, k, word(0, 9)) for d in (1, 2, 3) for k in range(0, 60, d)]
    texts = {d: "".join(t for x, _, t in segments if x == d) for d in (1, 2, 3)}
    values = sorted({(d, word(0, 7)) for d in (1, 2, 3, 4) for _ in range(60)} | {(d, texts[e][a : a + n].upper()) for d in (1, 2) for e in (1, 2, 3) for a, n in ((0, 1), (5, 20), (11, 33), (7, 16))} | {(3, texts[3])})
    expected = sorted((d, v) for d, v in values if v.lower() in texts.get(d, "").lower() and d in texts)
    originals, schema = spark.createDataFrame(values, "doc_id int, text string"), "doc_id int, seg_ord int, text string"
    assert sorted(map(tuple, audit.spot_check(originals, spark.createDataFrame(segments, schema)).collect())) == expected
    assert sorted(map(tuple, audit.spot_check(originals, spark.createDataFrame(list(texts.items()), "doc_id int, text string")).collect())) == expected


def test_spot_check_of_many_values_in_one_document(spark):
    n = 30_000
    rows = spark.range(n).select(F.lit("d").alias("doc_id"), F.col("id").alias("seg_ord"), F.concat(F.lit("Plot "), F.col("id") % 90, F.lit(", Harbour Row, Sector 7, "), 100_000 + F.col("id"), F.lit(", India.")).alias("text"))
    originals = rows.withColumn("text", F.when(F.col("seg_ord") % 2 == 0, F.col("text")).otherwise(F.concat(F.lit("x"), "text"))).drop("seg_ord")
    began = time.time()
    assert audit.spot_check(originals, rows).count() == n // 2
    assert time.time() - began < 60


def test_carrier_is_dealt_and_scanned_once(spark, tmp_path):
    """One file of one row group is many tasks; what a query reads twice is found once."""
    spark.range(500).selectExpr("id AS c_custkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    rows = plans.carrier(spark, str(tmp_path))
    assert rows.count() == 500 and rows.rdd.getNumPartitions() >= 16
    for df in (*plans._gold(spark, str(tmp_path)), plans._reviewed(spark, str(tmp_path)), plans._verified(spark, str(tmp_path))):
        assert not any("customer.parquet" in f for f in df.inputFiles())


def test_a_pdf_is_parsed_once_to_be_redacted(monkeypatch):
    content, read = pdf.made(["one ada@x.org\n\ntwo", "Größe \U0001f600"]), pdf.pages
    parsed = []
    monkeypatch.setattr(pdf, "pages", lambda c: parsed.append(1) or read(c))
    out = writers._new_content("a.pdf", content, {"pdf_page_0_block_0": [(4, 13, "[X]")]}, {}, dict(readers.ADAPTERS))
    assert read(out) == ["one [X]\n\ntwo", "Größe \U0001f600"] and len(parsed) == 1


def test_residuals_are_never_sent_to_the_driver(spark):
    """Joins of texts and values are shuffled, also where their compressed bytes would let Spark broadcast them (in the final plan)."""
    findings = spark.createDataFrame([(k, f"Value {k} of many") for k in range(300)] + [(1000, "x known 7 x"), (1001, "nown 8")], "k long, text string")
    out = audit.residual(findings, spark.range(20).select(F.concat(F.lit("known "), "id").alias("replacement")))
    assert out.count() == 300
    plan = out._jdf.queryExecution().executedPlan()
    out.collect()
    assert "SortMergeJoin [_residual_text" in plan.toString() and "BroadcastHashJoin [_residual_text" not in plan.toString()


def test_residual_scan_finds_its_matches_once(spark, tmp_path):
    """Everything the query reads at the end was written to the shared folder before: the lines are not scanned again."""
    spark.range(90).selectExpr("id AS c_custkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    assert all(str(tmp_path) not in f for f in plans._residual(spark, str(tmp_path)).inputFiles())


def test_diff_of_texts_that_begin_alike(monkeypatch):
    """As difflib has it, also where it leaves frequent characters out, and without its matcher."""
    r = random.Random(3)
    pairs = [("", ""), ("a", ""), ("aa", "aaa")]
    for _ in range(600):
        text = "".join(r.choice("ab \n" if r.random() < 0.5 else "abcdefghijklmnop \n") for _ in range(r.choice((5, 60, 199, 200, 400))))
        pairs.append((text, text + "".join(r.choice("ab!") for _ in range(r.randint(0, 30)))))
    pairs += [(b, a) for a, b in pairs]
    expected = [list(difflib.ndiff(a, b)) for a, b in pairs]
    monkeypatch.setattr(difflib, "ndiff", None)
    for (a, b), diff in zip(pairs, expected):
        assert audit.diff_of(a, b) == diff and audit.diff_of(a, b, 100) == diff[:100]


def test_shared_texts_are_read_as_bytes_come_in(monkeypatch):
    """No tree is made of the shared table; phonetic readings and what stands beside a text are left out, at any borders of pieces."""
    rich = '<?xml version="1.0"?><x:sst xmlns:x="u"><x:si><x:t>a&amp;\n</x:t><x:rPh><x:t>no</x:t></x:rPh></x:si> y <x:si><x:r><x:t>b</x:t></x:r><x:r>z<x:t>ßc</x:t></x:r></x:si><x:si/><x:si><x:t/></x:si></x:sst>'
    monkeypatch.setattr(sheets.ET, "iterparse", None)
    for piece in (1, 7, 1 << 16):
        monkeypatch.setattr(sheets, "PIECE", piece)
        for code in ("utf-8", "utf-16"):
            book = io.BytesIO()
            with zipfile.ZipFile(book, "w") as z:
                z.writestr("xl/sharedStrings.xml", rich.encode(code))
            with zipfile.ZipFile(book) as z:
                assert list(sheets._shared(z)) == ["a&\n", "bßc", "", ""]
