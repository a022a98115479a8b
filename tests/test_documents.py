"""Files in and out, plug-ins, custom patterns, streaming, reports: small cases with known results."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from redactory.functions import text as T
from redactory.functions import vocabulary as V
from redactory.operators import audit, detect
from redactory.operators.detect import Config, Custom
from redactory.plans import engine, library
from redactory.sources import office, readers, sample, sheets, writers
from redactory.streaming import redaction

SEGMENT = "doc_id string, segment_id string, seg_ord int, text string"
_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def lines(spark, *texts):
    return spark.createDataFrame([("d", f"s{i}", i, t) for i, t in enumerate(texts)], SEGMENT)


def found(spark, text, config=Config()):
    return [(m["entity_type"], m["text"]) for m in engine.detected(lines(spark, text), config).first()["matches"]]


def test_runs_keep_their_place():
    assert office.spliced_runs(["Dear ", "Jo", "hn Doe", "!"], [(5, 9, "X"), (10, 13, "Y")]) == ["Dear ", "X", " Y", "!"]
    assert office.spliced_runs(["abc"], [(0, 3, ""), (7, 9, "no")]) == [""]
    assert office.spliced_runs(["", "ab", ""], [(1, 2, "zz")]) == ["", "azz", ""]


def test_docx_round_trip():
    link = '<w:hyperlink r:id="m1"><w:r><w:t>bob@x.org</w:t></w:r></w:hyperlink>'
    tabs = "<w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t><w:br/></w:r>" + link + "</w:p>"
    merged = '<w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/><w:vMerge w:val="restart"/></w:tcPr><w:p><w:r><w:t>top</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>right</w:t></w:r></w:p></w:tc></w:tr>'
    merged += '<w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/><w:vMerge/></w:tcPr><w:p><w:r><w:t>hidden</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl>'
    data = sample.docx([["To ", "bob@", "x.org", " now"]], sections=2, headers=1, body=tabs + merged, links={"m1": "mailto:bob@x.org?subject=a"})
    texts = {s: t for s, t, _ in office.docx_segments(data)}
    assert texts == {"para_0": "To bob@x.org now", "para_1": "a\tb\nbob@x.org", "table_0_r_0_c_0_p_0": "top", "table_0_r_0_c_2_p_0": "right", "table_0_r_1_c_2_p_0": "", "sec_0_header_p_0": "head 0"}
    assert [r[1:] for r in office.docx_runs(data) if r[0] == "para_0"] == [(0, 0, 3, "To "), (1, 3, 7, "bob@"), (2, 7, 12, "x.org"), (3, 12, 16, " now")]
    assert office.docx_stats(data) == {"paragraphs": 2, "tables": 1, "sections": 2, "unique_headers": 3, "unique_footers": 3}
    out = office.redacted_docx(data, {"para_0": [(3, 12, "Z")], "para_1": [(4, 13, "Z")], "sec_0_header_p_0": [(0, 4, "H")]}, {"bob@x.org": "z@e.com"})
    new = {s: t for s, t, _ in office.docx_segments(out)}
    assert new == texts | {"para_0": "To Z now", "para_1": "a\tb\nZ", "sec_0_header_p_0": "H 0"}
    with zipfile.ZipFile(io.BytesIO(out)) as z:
        assert b'Target="mailto:z@e.com"' in z.read("word/_rels/document.xml.rels")
        assert z.read("word/document.xml").count(b"<w:b") >= 4  # formatting stays
    assert office.redacted_docx(data, {}) and {s: t for s, t, _ in office.docx_segments(office.redacted_docx(data, {}))} == texts


def test_prefixes_named_in_values_stay():
    part = office.Part(f'<w:document xmlns:w="{_W}" xmlns:w14="urn:a" xmlns:mc="urn:b" mc:Ignorable="w14"><w:body/></w:document>'.encode())
    out = part.bytes()
    assert b'xmlns:w14="urn:a"' in out and b'mc:Ignorable="w14"' in out and office.Part(out).root.tag == f"{{{_W}}}document"


def test_xlsx_and_csv_and_pdf_text():
    data = sample.xlsx([["one", "a@b.co and c"], ["one", ""]])
    out = sheets.redacted(data, {"sheet_0_r1_c2": [(0, 6, "X")]})
    assert [(s, t) for s, t, _ in sheets.segments(out)] == [("sheet_0_r1_c1", "one"), ("sheet_0_r1_c2", "X and c"), ("sheet_0_r2_c1", "one")]
    assert writers.redacted_csv(b"a\tb\n", {"csv_r0_c1": "x\ty"}, "\t") == b'a\t"x\ty"\r\n'
    assert list(readers.page_blocks(["a\n\n \n\nb", None])) == [("pdf_page_0_block_0", "a", {"page": "1", "block": "0"}), ("pdf_page_0_block_2", "b", {"page": "1", "block": "2"})]


def test_service_calls(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_bytes("Mail bob.smith@x.org\r\nnothing here\n".encode())
    (tmp_path / "in/b.csv").write_bytes(b"x,carla@y.org\n")
    (tmp_path / "in/c.docx").write_bytes(sample.docx([["Host 10.1", ".2.3"]]))
    rows = library.scan_files(spark, str(tmp_path / "in"), Config(strategy="CATEGORY_LABEL"))
    assert {r["entity_type"] for r in library.detections(rows).collect()} == {"EMAIL", "IP_ADDRESS"} and library.detections(rows, "EMAIL").count() == 2
    done = library.redact_files(spark, str(tmp_path / "in"), rows)
    content = {r["path"].rpartition("/")[2]: r["content"] for r in done.collect()}
    assert content["a.txt"] == b"Mail [REDACTED EMAIL]\r\nnothing here\n" and content["b.csv"] == b"x,[REDACTED EMAIL]\r\n"
    assert office.docx_segments(content["c.docx"])[0][1] == "Host [REDACTED IP_ADDRESS]"
    report = library.verify(rows, done)
    assert {r["status"] for r in report.collect()} == {"PASS"} and library.download(done, report) is done
    bad = done.withColumn("content", F.when(F.col("path").endswith("a.txt"), F.lit(b"Mail\r\nnothing here\n")).otherwise(F.col("content")))
    with pytest.raises(PermissionError):
        library.download(bad, library.verify(rows, bad))
    for _ in range(2):
        library.log_history(rows, report, str(tmp_path / "history"))
    assert library.history(spark, str(tmp_path / "history"), 4).count() == 4 and {r["n_matches"] for r in library.history(spark, str(tmp_path / "history")).collect()} == {1}
    assert library.health()["status"] == "healthy" and "Companies Act" in library.packs()["legal"]


def test_command_line(spark, tmp_path):
    from redactory.__main__ import main

    (tmp_path / "a.txt").write_text("SSN: 987-65-4321\n")
    assert main(["-i", str(tmp_path / "a.txt"), "-o", str(tmp_path / "out.txt"), "--strategy", "CATEGORY_LABEL", "--log", str(tmp_path / "log"), "--log-level", "ERROR"]) == 0
    assert (tmp_path / "out.txt").read_text() == "SSN: [REDACTED SSN]\n"
    assert [json.loads(x)["entity_type"] for x in (tmp_path / "log").read_text().splitlines()] == ["SSN"]


def test_adapter_of_the_users(spark, tmp_path):
    (tmp_path / "x.bar").write_bytes(b"one|a@b.co")
    readers.register_adapter("bar", "bar", lambda name, content: ((f"b{i}", t, {}) for i, t in enumerate(content.decode().split("|"))))
    try:
        assert {r["segment_id"]: r["text"] for r in readers.read_documents(spark, str(tmp_path)).collect()} == {"b0": "one", "b1": "a@b.co"}
    finally:
        del readers.ADAPTERS["bar"], readers.EXTRACTORS["bar"]


def test_detector_and_recogniser_of_the_users(spark):
    def badge(text, held, pat):
        return detect.scored(T.spans_of(text, r"B-\d+", needs=detect.DIGIT), text, "BADGE", 0.9, "badge")

    detect.register_detector("BADGE", badge)
    try:
        assert found(spark, "badge B-12", Config(categories=("BADGE",))) == [("BADGE", "B-12")]
        assert found(spark, "badge B-12") == []
    finally:
        detect.ORDER.remove("BADGE"), detect.DETECTORS.pop("BADGE")
    names = lambda text: [(text.index("Ada Quill"), text.index("Ada Quill") + 9)] if "Ada Quill" in text else []
    rows = engine.detected(lines(spark, "then Ada Quill left", "Dr. Ada Quill left"), Config(categories=("PERSON",), person_ner=names)).orderBy("seg_ord").collect()
    assert [[(m["text"], m["source"], m["tier"], m["approved"]) for m in r["matches"]] for r in rows] == [[("Ada Quill", "ner_candidate", "MEDIUM", False)], [("Dr. Ada Quill", "salutation_prefix", "HIGH", True)]]


@pytest.mark.parametrize("pattern, expected", [(r"\d*", [(0, 0), (1, 1), (2, 4), (4, 4), (5, 5), (6, 6)]), (r"(?P<n>\d)\d", [(2, 4)]), (r"(?<=b)\d+", [(2, 4)]), ("(", []), (r"[[:digit:]]+", [(2, 4)])])
def test_custom_patterns(spark, pattern, expected):
    rows = detect.scan(lines(spark, "ab12cd"), Config(categories=(), packs=(), custom=(Custom("X", pattern),))).first()["matches"]
    assert [(m["start"], m["end"]) for m in rows] == expected


PROTECTED = ["Companies Act", "Offer Price", "High Court", "Net Asset Value", "P/E Ratio", "Companies Act, 2013"]


@pytest.mark.parametrize("phrase", PROTECTED)
def test_protected_phrases_are_left_alone(spark, phrase):
    assert found(spark, f"Vendor: {phrase} Limited and Name: {phrase}") == []


def test_shared_beginnings_change_no_match(spark):
    import regex

    for words in (V.ROLE_LABELS, V.ADDRESS_LABELS):
        plain = "|".join(w.replace(" ", r"\s+") for w in words.split(";"))
        for w in [x.replace(r"\d+", "12") for x in words.split(";")] + ["Manager", "unit 7 at", "plantation", "authority"]:
            text = f"x {w.upper()} : y"
            assert [m.span() for m in regex.finditer(plain, text, regex.I)] == [m.span() for m in regex.finditer(V.labels(words), text, regex.I)]


NEGATIVE = ["Sector price and the Offer Price", "Chapter 5 of the Act", "Section 12, Rule 7", "Order 1234567 of 2020", "Dated 14/07/1982", "image@2x.png", "v. 10.0.0.1", "4111 1111 1111 1112 x", "ABCXX1234K"]


@pytest.mark.parametrize("text", NEGATIVE)
def test_near_misses(spark, text):
    kinds = {k for k, _ in found(spark, text)}
    assert not kinds & {"EMAIL", "IP_ADDRESS", "CREDIT_CARD", "PAN", "DOB", "ADDRESS", "COMPANY", "PERSON", "SSN"}


def test_residual_goes_across_types(spark):
    rows = [("PERSON", "Jadeport Thorn"), ("PERSON", "Real Name"), ("COMPANY", "The Jadeport Thorn LLP office"), ("X", "LLP"), ("X", "Zed"), ("PERSON", " jadeport THORN llp ")]
    findings = spark.createDataFrame(rows, "entity_type string, text string")
    known = spark.createDataFrame([("COMPANY", "Jadeport Thorn LLP"), ("X", "Zedd")], "entity_type string, replacement string")
    assert {r["text"] for r in audit.residual(findings, known).collect()} == {"Real Name", "Zed"}


def test_metrics_flags(spark):
    found_ = spark.createDataFrame([("EMAIL", "a@b.co")], "entity_type string, text string")
    for flag, value in (("verified", False), ("exclude_from_metrics", True)):
        gold = spark.createDataFrame([("EMAIL", "a@b.co", None), ("EMAIL", "x@b.co", value)], f"entity_type string, text string, {flag} boolean")
        assert {r["gold"] for r in audit.metrics_by_type(gold, found_).where("entity_type = 'EMAIL'").collect()} == {1}


def test_report_has_all_sections():
    out = writers.markdown_report([{"entity_type": "EMAIL"} | dict.fromkeys("gold predicted tp fp fn precision recall f1 accuracy".split())], {"f1": 0.5}, {"total": 1}, {"status": "PASS"}, {"tables": 2}, {"f1": 0.4}, 3)
    assert out.count("\n## ") == 7 and "- tables: 2" in out and "| EMAIL | N/A" in out


def test_stream_equals_table(spark, tmp_path):
    rows = lines(spark, "Mail bob.smith@x.org", "plain", None)
    rows.write.parquet(f"{tmp_path}/in/1")
    schema = "doc_id string, segment_id string, seg_ord int, text string"
    config = Config(strategy="CATEGORY_LABEL")
    redaction.run(spark, f"{tmp_path}/in/*", schema, f"{tmp_path}/out", f"{tmp_path}/checkpoint", config).awaitTermination()
    rows.limit(1).write.parquet(f"{tmp_path}/in/2")
    redaction.run(spark, f"{tmp_path}/in/*", schema, f"{tmp_path}/out", f"{tmp_path}/checkpoint", config).awaitTermination()
    got = sorted(str(r["redacted"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == sorted(str(r["redacted"]) for r in engine.redact(rows.union(rows.limit(1)), config).collect())
    with pytest.raises(ValueError):
        redaction.redact_stream(rows, Config(strategy="TOKEN"))
