import io
import tracemalloc
import zipfile

import pytest

from redactory.sources import readers, sample, sheets, writers

S = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def workbook(sheet, shared=""):
    """A package with the sheet's XML as given."""
    with zipfile.ZipFile(io.BytesIO(sample.xlsx([["x"]]))) as z:
        parts = {n: z.read(n) for n in z.namelist()}
    parts["xl/worksheets/one.xml"] = sheet if isinstance(sheet, bytes) else sheet.encode()
    parts["xl/sharedStrings.xml"] = f'<sst xmlns="{S}">{shared}</sst>'.encode()
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


def texts(content):
    return {s: t for s, t, _ in sheets.segments(content)}


SHEET = f"""<?xml version="1.0" encoding="UTF-8"?>
<x:worksheet xmlns:x="{S}" xmlns:q="urn:q"><q:own a="1 > 0"/><x:sheetData><x:row r="2"><x:c r="B2" s="7" t="s"><x:v>1</x:v></x:c><x:c t="inlineStr"><x:is><x:r><x:t>a&amp;b </x:t></x:r><x:r><x:t>é</x:t></x:r><x:rPh sb="0" eb="1"><x:t>read</x:t></x:rPh></x:is></x:c>
<x:c r="AA2"><x:f>SUM(A1:A2)</x:f><x:v>3</x:v></x:c><x:c r="AB2"/><x:c r="AC2" t="s"><x:v>99</x:v></x:c></x:row><x:row><x:c><x:v>4.5</x:v></x:c><x:c t="str"><x:f/><x:v> </x:v></x:c></x:row></x:sheetData><!-- end --></x:worksheet>"""
SHARED = "<si><t>zero</t></si><si><r><t>mail </t></r><r><t>me@x.org</t></r><rPh sb='0' eb='1'><t>read</t></rPh></si>"


@pytest.mark.parametrize("piece", [1, 7, 64, 1 << 16])
@pytest.mark.parametrize("encode", [lambda t: t.encode(), lambda t: t.encode("utf-8-sig"), lambda t: t.replace("UTF-8", "UTF-16").encode("utf-16")])
def test_cells_and_changed_cells_at_any_cut(monkeypatch, piece, encode):
    monkeypatch.setattr(sheets, "PIECE", piece)
    data = workbook(encode(SHEET), SHARED)
    assert texts(data) == {"sheet_0_r2_c2": "mail me@x.org", "sheet_0_r2_c3": "a&b é", "sheet_0_r2_c27": "=SUM(A1:A2)", "sheet_0_r3_c1": "4.5"}
    assert [m["coordinate"] for _, _, m in sheets.segments(data)] == ["B2", "C2", "AA2", "A3"]
    spans = {"sheet_0_r2_c2": [(5, 13, "<\r&")], "sheet_0_r2_c3": [(0, 1, "")], "sheet_0_r3_c1": [(0, 3, "n")], "sheet_0_r9_c9": [(0, 1, "no")], "para_0": [(0, 1, "no")]}
    out = sheets.redacted(data, spans)
    assert texts(out) == {"sheet_0_r2_c2": "mail <\r&", "sheet_0_r2_c3": "&b é", "sheet_0_r2_c27": "=SUM(A1:A2)", "sheet_0_r3_c1": "n"}
    with zipfile.ZipFile(io.BytesIO(out)) as z, zipfile.ZipFile(io.BytesIO(data)) as old:
        sheet = z.read("xl/worksheets/one.xml")
        assert b'<x:c r="B2" s="7" t="inlineStr"><x:is>' in sheet and b'<q:own a="1 > 0"/>' in sheet and sheet.endswith(b"<!-- end --></x:worksheet>")
        assert all(z.read(n) == old.read(n) for n in z.namelist() if n != "xl/worksheets/one.xml")
    assert zipfile.ZipFile(io.BytesIO(sheets.redacted(data, {}))).read("xl/worksheets/one.xml") == encode(SHEET)


def test_shared_texts_by_blocks(monkeypatch):
    monkeypatch.setattr(sheets, "BLOCK_TEXTS", 3)
    monkeypatch.setattr(sheets, "OPEN_BLOCKS", 2)
    for n in (0, 1, 3, 7, 30):
        want = [("", "a\nb", "é\U0001f600", "1 2\n")[k % 4] + str(k) * (k % 5) for k in range(n)]
        got = sheets.SharedTexts(iter(want))
        assert [got[k] for k in [*range(n), *reversed(range(n))]] == want + want[::-1]
        assert got[n] is None and got[n + 3] is None


def test_broken_sheets_raise_and_empty_ones_have_no_cells():
    assert texts(workbook(f'<worksheet xmlns="{S}"><sheetData/></worksheet>')) == {}
    for bad in ("<worksheet><sheetData>", ""):
        with pytest.raises(Exception, match="no element found|unclosed"):
            texts(workbook(bad))


def test_large_sheets_take_bounded_memory():
    def peak(rows):
        cells = "".join(f'<row r="{r}"><c r="A{r}" t="s"><v>{r % 50_000}</v></c><c r="B{r}"><v>{r}</v></c></row>' for r in range(1, rows + 1))
        data = workbook(f'<worksheet xmlns="{S}"><sheetData>{cells}</sheetData></worksheet>', "".join(f"<si><t>text {k}</t></si>" for k in range(50_000)))
        del cells
        tracemalloc.start()
        n = sum(1 for _ in sheets.segments(data))
        top = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert n == 2 * rows
        return top

    small, large = peak(20_000), peak(200_000)
    assert large < small + (2 << 20), (small, large)


def test_segments_leave_their_task_in_parts(spark, monkeypatch):
    monkeypatch.setattr(readers, "SEGMENTS_AT_ONCE", 3)
    data = sample.xlsx([[f"a{r}", f"b{r}"] for r in range(10)])
    rows = readers.segments(spark.createDataFrame([("b.xlsx", data), ("a.txt", b"one\ntwo")], "path string, content binary")).orderBy("doc_id", "seg_ord").collect()
    assert [(r.doc_id, r.seg_ord, r.text) for r in rows] == [("a.txt", 0, "one\n"), ("a.txt", 1, "two")] + [("b.xlsx", 2 * r + c, f"{'ab'[c]}{r}") for r in range(10) for c in range(2)]


def test_redacted_files_alike_if_spans_are_few_or_many(spark, monkeypatch):
    from redactory.operators.detect import Config
    from redactory.plans import engine

    files = [(f"f{k}.xlsx", sample.xlsx([["plain", f"ask a{k}@x.org or b{k}@x.org"][: 1 + k % 2]])) for k in range(5)]
    contents, config = spark.createDataFrame(files, "path string, content binary"), Config(categories=("EMAIL",), strategy="CATEGORY_LABEL")
    rows = engine.replaced(engine.detected(readers.segments(contents), config), config)
    for limit in (writers.FEW_SPANS_BYTES, -1):
        monkeypatch.setattr(writers, "FEW_SPANS_BYTES", limit)
        monkeypatch.setattr(writers, "FILES_AT_ONCE", 2)
        out = {r.path: sorted(texts(bytes(r.content)).values()) for r in writers.redacted_files(contents, rows).collect()}
        assert out == {f"f{k}.xlsx": ["ask [REDACTED EMAIL] or [REDACTED EMAIL]"] * (k % 2) + ["plain"] for k in range(5)}
    assert writers.redacted_files(contents.limit(0), rows.limit(0)).count() == 0
