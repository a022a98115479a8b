"""Spans, resolution, replacements and reports on lines with known findings."""

import csv
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from redactory.functions import text as T
from redactory.functions.vocabulary import protected_pattern
from redactory.operators import audit, replace
from redactory.operators.detect import Config, Custom
from redactory.plans import engine
from redactory.sources import readers, writers

LINES = {
    "Call me: +91 98765 43210 or fax 555-890-1234": [("PHONE", "+91 98765 43210"), ("PHONE", "555-890-1234")],
    "SSN: 987-65-4321": [("SSN", "987-65-4321")],
    "Code 123-45-6789": [],
    "256.100.1.1 and version 1.2.3.4": [],
    "Dated December 10, 2025": [],
    "Dr. Gregory House sells": [("PERSON", "Dr. Gregory House")],
    "Contact Person: Eleanor Vance.": [("PERSON", "Eleanor Vance")],
    "Vendor: Amber Freight Limited": [("COMPANY", "Amber Freight Limited")],
    "Date of Birth: 14/07/1982": [("DOB", "14/07/1982")],
    "Billing Address: Plot 5, Harbour Row, Sector 7, 100123, India.": [("ADDRESS", "Plot 5, Harbour Row, Sector 7, 100123, India")],
    "a@b.co x@a.jsmith.com pat@x.com": [("EMAIL", "a@b.co")],
    "\U0001f600 ä bob.smith@x.org": [("EMAIL", "bob.smith@x.org")],
    "card 4111 1111 1111 1111": [("CREDIT_CARD", "4111 1111 1111 1111")],
    "ABCPX1234K user9@upi": [("PAN", "ABCPX1234K"), ("UPI_ID", "user9@upi")],
    "GB29NWBK60161331926819": [("IBAN", "GB29NWBK60161331926819")],
    "Companies Act, Offer Price and Net Asset Value": [],
    "  ": [],
    "": [],
}


@pytest.fixture(scope="module")
def rows(spark):
    data = [("d", f"s{i}", i, t) for i, t in enumerate(LINES)] + [("d", "null", 99, None)]
    segments = spark.createDataFrame(data, "doc_id string, segment_id string, seg_ord int, text string")
    return engine.replaced(engine.detected(segments)).collect()


def test_findings(rows):
    for r in rows:
        if r["text"] is not None:
            assert [(m["entity_type"], m["text"]) for m in r["matches"]] == LINES[r["text"]], r["text"]
            for m in r["matches"]:
                assert r["text"][m["start"] : m["end"]] == m["text"]
        else:
            assert r["matches"] == []


def test_prefilters_hold_for_all_that_patterns_match(spark):
    from redactory.functions import vocabulary as V
    from redactory.operators.detect import DIGIT, FIRM

    forms = "Private Limited;Pvt Ltd;PvtLtd;Pvt.Ltd;Pvt. Ltd.;PVTLTD;Limited;Ltd;Ltd.;LLP;Inc;Inc.;Corporation;Corp;Corp.;LLC;GmbH;SA;S.A;S.A.;A.G.;AG;Holding;Holdings;Holding\u017f".split(";")
    cases = [(V.COMPANY, FIRM, f"Acme Widgets {x}{end}") for x in forms for end in (" was paid", "", "x.", ".x")]
    cases += [(V.EMAIL, "@", "a bob@x.org"), (V.PHONE, DIGIT, "call 555-890-1234"), (V.SSN, DIGIT, "987-65-4321"), (V.IPV4, DIGIT, "at 1.2.3.4")]
    cases += [(V.UPI, "@", "user9@upi"), (V.CARD, r"(?:\p{Nd}[ \-]*){13}", "card 4111 1111 1111 1111"), (V.ADDRESS, DIGIT, "5 Harbour Row West Street, Block 7, 100123")]
    found = 0
    for pattern, needs, text in cases:
        line = spark.range(1).select(F.lit(text).alias("text"))
        full, some = line.select(T.spans_of(F.col("text"), pattern), T.spans_of(F.col("text"), pattern, needs=needs)).first()
        assert full == some, text
        found += bool(full)
    assert found > 60


def test_company_without_a_gap(spark):
    segments = spark.createDataFrame([("d", "s", 0, "Acme Widgets PvtLtd was paid")], "doc_id string, segment_id string, seg_ord int, text string")
    assert [(m["entity_type"], m["text"]) for m in engine.detected(segments).first()["matches"]] == [("COMPANY", "Acme Widgets PvtLtd")]


def test_spans_are_disjoint_and_replaced(spark, rows):
    for r in rows:
        ends = [(m["start"], m["end"]) for m in r["matches"]]
        assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))
        assert all(m["replacement"] for m in r["matches"])


def test_strategies_and_custom(spark):
    segments = spark.createDataFrame([("d", "a", 0, "EMP-12 and EMP-13")], "doc_id string, segment_id string, seg_ord int, text string")
    config = Config(categories=(), custom=(Custom("EMPLOYEE", r"EMP-\d+"),), strategy="TOKEN")
    assert engine.redact(segments, config).first()["redacted"] == "<EMPLOYEE_001> and <EMPLOYEE_002>"
    config = Config(categories=(), custom=config.custom, strategy="CATEGORY_LABEL")
    assert engine.redact(segments, config).first()["redacted"] == "[REDACTED EMPLOYEE] and [REDACTED EMPLOYEE]"


def test_helpers(spark):
    assert T.luhn_generate("4", 16)[0] == "4" and len(T.luhn_generate("4", 16)) == 16
    made = T.luhn_generate("4", 16)
    one = spark.range(1)
    assert one.select(T.luhn(F.lit(made))).first()[0] and not one.select(T.luhn(F.lit(made[:-1] + str((int(made[-1]) + 1) % 10)))).first()[0]
    assert one.select(replace.mask(F.lit("EMAIL"), F.lit("john@x.org"))).first()[0] == "j***@x.org"
    assert one.select(replace.mask(F.lit("PERSON"), F.lit("A Bcd"))).first()[0] == "* B**"
    assert protected_pattern((), ()) == "(?!)"
    runs = F.array(F.lit("Dear "), F.lit("Jo"), F.lit("hn!"))
    spans = F.array(F.struct(F.lit(5).alias("start"), F.lit(9).alias("end"), F.lit("X").alias("replacement")))
    assert one.select(writers.splice_runs(runs, spans)).first()[0] == ["Dear ", "X", "!"]
    assert one.select(F.size(writers.char_run_map(runs))).first()[0] == 10


def test_lines_and_files(spark, tmp_path):
    text = "a\nb\r\nc\rd\n\n"
    got = readers.line_segments(spark.createDataFrame([("d", text), ("n", None)], "doc_id string, text string")).orderBy("seg_ord").collect()
    assert [r["text"] for r in got] == text.splitlines(keepends=True)
    (tmp_path / "x.csv").write_bytes(b'a,"b, c"\r\n ,d@e.co\r\n')
    cells = {r["segment_id"]: r["text"] for r in readers.read_documents(spark, str(tmp_path)).collect()}
    assert cells == {"csv_r0_c0": "a", "csv_r0_c1": "b, c", "csv_r1_c1": "d@e.co"}
    out = writers.redacted_csv(b"a,b\n", {"csv_r0_c1": "x,y"})
    assert list(csv.reader(io.StringIO(out.decode()))) == [["a", "x,y"]]
    with pytest.raises(ValueError):
        readers.adapter_of("x.bin")


def test_docx():
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>Dear </w:t></w:r><w:r><w:t>Jo</w:t></w:r></w:p></w:body></w:document>')
    assert [(s, t) for s, t, _ in readers.segments_of("a.docx", data.getvalue())] == [("para_0", "Dear Jo")]


def test_integrity_and_metrics(spark):
    kind = "array<struct<start:int,end:int,replacement:string>>"
    original = spark.createDataFrame([("d", "a", "Hi Bob", [(3, 6, "X")]), ("d", "b", "same", [])], f"doc_id string, segment_id string, text string, matches {kind}")
    good = spark.createDataFrame([("d", "a", "Hi X"), ("d", "b", "same")], "doc_id string, segment_id string, text string")
    bad = spark.createDataFrame([("d", "a", "Hi X"), ("d", "b", "sane")], "doc_id string, segment_id string, text string")
    assert audit.integrity_report(audit.integrity_rows(original, good)).first()["status"] == "PASS"
    report = audit.integrity_report(audit.integrity_rows(original, bad)).first()
    assert report["status"] == "FAIL" and report["unauthorized_changed_characters"] == 2
    gold = spark.createDataFrame([("EMAIL", "a@b.co"), ("PERSON", "Al Bo")], "entity_type string, text string")
    found = spark.createDataFrame([("EMAIL", "A@b.co "), ("PHONE", "1")], "entity_type string, text string")
    by = {r["entity_type"]: r for r in audit.metrics_by_type(gold, found).collect()}
    assert by["EMAIL"]["precision"] == 1.0 and by["PERSON"]["recall"] == 0.0
    assert by["PHONE"]["precision"] == 0.0 and by["PHONE"]["recall"] is None and by["SSN"]["precision"] is None


def test_entry_without_llm():
    import __spark_entry__ as e

    assert e.queries() and set(e.oracle_sql()) <= set(e.queries())
