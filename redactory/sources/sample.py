"""Small DOCX and XLSX packages from plain values, for queries and tests."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_S = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_P = "http://schemas.openxmlformats.org/package/2006/relationships"


def _zip(files: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(zipfile.ZipInfo(name), text)
    return out.getvalue()


def paragraph(runs: list[str], more: str = "") -> str:
    return "<w:p>" + "".join(f'<w:r><w:rPr><w:b/></w:rPr><w:t xml:space="preserve">{escape(r)}</w:t></w:r>' for r in runs) + more + "</w:p>"


def docx(paragraphs: list[list[str]], tables: int = 0, sections: int = 1, headers: int = 0, body: str = "", links: dict[str, str] | None = None) -> bytes:
    """paragraphs: texts of runs; headers: of the first section, default kind; body: more content; links: targets by relationship id."""
    rels = [(f"h{k}", f"{_R}/header", f"header{k}.xml", "") for k in range(headers)] + [(k, f"{_R}/hyperlink", v, ' TargetMode="External"') for k, v in (links or {}).items()]
    table = "<w:tbl><w:tr><w:tc>" + paragraph(["cell"]) + "</w:tc></w:tr></w:tbl>"
    refs = "".join(f'<w:headerReference w:type="default" r:id="h{k}"/>' for k in range(headers))
    sects = "".join(f"<w:sectPr>{refs if not k else ''}</w:sectPr>" for k in range(sections))
    content = "".join(map(paragraph, paragraphs)) + body + table * tables + sects
    files = {"word/document.xml": f'<w:document xmlns:w="{_W}" xmlns:r="{_R}"><w:body>{content}</w:body></w:document>'}
    files["word/_rels/document.xml.rels"] = f'<Relationships xmlns="{_P}">' + "".join(f'<Relationship Id="{i}" Type="{t}" Target="{escape(x)}"{m}/>' for i, t, x, m in rels) + "</Relationships>"
    for k in range(headers):
        files[f"word/header{k}.xml"] = f'<w:hdr xmlns:w="{_W}">{paragraph([f"head {k}"])}</w:hdr>'
    return _zip(files)


def xlsx(rows: list[list[str]]) -> bytes:
    """One sheet of shared texts; empty cells are left out."""
    shared = {x: k for k, x in enumerate(sorted({x for r in rows for x in r if x}))}
    cell = lambda r, c, x: f'<c r="{chr(65 + c)}{r + 1}" t="s"><v>{shared[x]}</v></c>'
    sheet = "".join(f'<row r="{r + 1}">' + "".join(cell(r, c, x) for c, x in enumerate(row) if x) + "</row>" for r, row in enumerate(rows))
    return _zip({
        "xl/workbook.xml": f'<workbook xmlns="{_S}" xmlns:r="{_R}"><sheets><sheet name="one" sheetId="1" r:id="s1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_P}"><Relationship Id="s1" Type="{_R}/worksheet" Target="worksheets/one.xml"/></Relationships>',
        "xl/sharedStrings.xml": f'<sst xmlns="{_S}">' + "".join(f"<si><t>{escape(x, {chr(13): '&#13;'})}</t></si>" for x in shared) + "</sst>",
        "xl/worksheets/one.xml": f'<worksheet xmlns="{_S}"><sheetData>{sheet}</sheetData></worksheet>',
    })
