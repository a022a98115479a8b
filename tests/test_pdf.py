"""PDF files: made and read back, and made by hand in other shapes."""

import base64
import zlib

import pytest

from redactory.sources import pdf, readers, writers


def file_of(content: bytes, head: bytes = b"", more: bytes = b"", font: bytes = b"<< /Type /Font /Subtype /Type1 /Encoding /WinAnsiEncoding >>") -> bytes:
    return b"%%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj 2 0 obj << /Type /Pages /Kids [3 0 R] /Resources << /Font << /F 5 0 R >> /XObject << /X 6 0 R >> >> >> endobj 3 0 obj << /Type /Page /Contents 4 0 R >> endobj 4 0 obj << /Length %d %s >>\nstream\n%s\nendstream endobj 5 0 obj %s endobj %s" % (len(content), head, content, font, more)


@pytest.mark.parametrize("texts", [["one line"], ["a\nb\n\nc\nd", "", "second page"], ["é € \U0001f600 \t( ) \\ < >"], ["x\n\ny\n\nz"] * 3, []])
def test_round_trip(texts):
    assert pdf.pages(pdf.made(texts)) == texts


def test_other_shapes():
    show = rb"BT /F 12 Tf 10 700 Td (Caf\351 \(a\\b\)\012) Tj 0 -14 Td [(wo) -20 (rld) -300 (again)] TJ 0 -40 Td <41 42 4> Tj 14 TL T* (x) Tj (y) ' ET"
    text = "Café (a\\b)\n\nworld again\n\nAB@\nx\ny"
    assert pdf.pages(file_of(show)) == [text]
    assert pdf.pages(file_of(zlib.compress(show), b"/Filter /FlateDecode")) == [text]
    assert pdf.pages(file_of(base64.a85encode(zlib.compress(show)) + b"~>", b"/Filter [/ASCII85Decode /FlateDecode]")) == [text]
    assert pdf.pages(file_of(show.hex().encode() + b">", b"/Filter /ASCIIHexDecode")) == [text]
    rows = [show[i : i + 16].ljust(16) for i in range(0, len(show), 16)]
    up = b"".join(b"\x02" + bytes((a - b) & 255 for a, b in zip(r, q)) for r, q in zip(rows, [bytes(16), *rows]))
    assert pdf.pages(file_of(zlib.compress(up), b"/Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 16 >>")) == [text]
    names = b"<< /Type /Font /Subtype /Type1 /Encoding << /Differences [1 /H /eacute /uni00E9 65 /fi /at] >> >>"
    assert pdf.pages(file_of(b"BT /F 9 Tf <010341420a> Tj ET", font=names)) == ["Héfi@\n"]
    form = b"6 0 obj << /Type /XObject /Subtype /Form /Length 30 >>\nstream\nBT /F 9 Tf 1 2 Td (in form) Tj ET\nendstream endobj"
    assert pdf.pages(file_of(b"q /X Do Q", more=form)) == ["in form"]
    mapped = b"6 0 obj << /Length 9 >>\nstream\n1 beginbfchar <01> <00480069> endbfchar 1 beginbfrange <02> <03> [<0041> <0042>] <04> <06> <0061> endbfrange\nendstream endobj"
    assert pdf.pages(file_of(b"BT /F 9 Tf <010203040506> Tj ET", more=mapped, font=b"<< /Type /Font /Subtype /Type1 /ToUnicode 6 0 R >>")) == ["HiABabc"]


def test_packed_objects_updates_and_what_is_refused():
    inner = b"1 0 2 36 << /Type /Catalog /Pages 2 0 R >>    << /Type /Pages /Kids [3 0 R] >>"
    packed = zlib.compress(inner)
    data = b"%%PDF-1.5\n9 0 obj << /Type /ObjStm /N 2 /First 9 /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream endobj\n3 0 obj << /Type /Page /Contents [4 0 R 7 0 R] >> endobj 4 0 obj << /Length 8 0 R >>\nstream\nBT (old) Tj ET\nendstream endobj 7 0 obj << /Length 0 >>\nstream\nBT 0 -5 Td (tail) Tj ET\nendstream endobj 8 0 obj 14 endobj" % (len(packed), packed)
    assert pdf.pages(data) == ["old\n\ntail"]
    assert pdf.pages(data + b" 4 0 obj << /Length 14 >>\nstream\nBT (new) Tj ET\nendstream endobj") == ["new\n\ntail"]
    with pytest.raises(ValueError):
        pdf.pages(file_of(b"") + b" trailer << /Encrypt 9 0 R >>")
    with pytest.raises(ValueError):
        pdf.pages(b"hello")
    assert pdf.pages(b"%PDF-1.4 nothing") == []


def test_redacted_files(spark):
    content = bytearray(pdf.made(["Mail bob.smith@x.org now\nsecond line\n\nblock", "page two"]))
    files = spark.createDataFrame([("a.pdf", content)], "path string, content binary")
    rows = readers.segments(files).collect()
    assert [(r.segment_id, r.text, r.meta) for r in rows] == [("pdf_page_0_block_0", "Mail bob.smith@x.org now\nsecond line", {"page": "1", "block": "0"}), ("pdf_page_0_block_1", "block", {"page": "1", "block": "1"}), ("pdf_page_1_block_0", "page two", {"page": "2", "block": "0"})]
    spans = spark.createDataFrame([("a.pdf", "pdf_page_0_block_0", [(5, 20, "EMAIL", "bob.smith@x.org", "[E]", True)])], "doc_id string, segment_id string, matches array<struct<start:int,end:int,entity_type:string,text:string,replacement:string,approved:boolean>>")
    out = writers.redacted_files(files, spans)
    assert [(r.segment_id, r.text) for r in readers.segments(out).collect()] == [("pdf_page_0_block_0", "Mail [E] now\nsecond line"), ("pdf_page_0_block_1", "block"), ("pdf_page_1_block_0", "page two")]
