"""DOCX packages: paragraphs with their runs, document statistics, and packages with redacted text.

Works on the bytes of one file at a time, on whatever worker holds them. Segment ids name places in the file, so a package is
redacted by reading it once more and replacing spans at those places; all other parts are copied byte for byte."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_SPACE = "{http://www.w3.org/XML/1998/namespace}space"
_HYPERLINK = "/relationships/hyperlink"
_KINDS = {"default": "", "first": "first_page_", "even": "even_page_"}
_BREAKS = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n", f"{_W}noBreakHyphen": "-"}

Span = tuple[int, int, str]


class Part:
    """An XML part: its tree, and the namespaces it declares."""

    def __init__(self, data: bytes):
        self.spaces = dict(x for _, x in ET.iterparse(io.BytesIO(data), events=["start-ns"]))
        self.root = ET.fromstring(data)

    def bytes(self) -> bytes:
        """With the declared prefixes, also those that only attribute values name."""
        for prefix, uri in self.spaces.items():
            if not re.fullmatch(r"ns\d+", prefix):
                ET.register_namespace(prefix, uri)
        out = ET.tostring(self.root, encoding="UTF-8", xml_declaration=True).decode()
        at = out.index("<", out.index("?>"))
        end = out.index(">", at) - (out[out.index(">", at) - 1] == "/")
        more = "".join(f' xmlns:{p}="{u}"' for p, u in self.spaces.items() if p and f"xmlns:{p}=" not in out[at:end])
        return (out[:end] + more + out[end:]).encode()


def _targets(z: zipfile.ZipFile, owner: str) -> dict[str, str]:
    folder, _, name = owner.rpartition("/")
    path = f"{folder}/_rels/{name}.rels"
    if path not in z.namelist():
        return {}
    rels = ET.fromstring(z.read(path))
    return {x.get("Id"): x.get("Target").lstrip("/") if x.get("Target").startswith("/") else f"{folder}/{x.get('Target')}" for x in rels if x.get("TargetMode") != "External"}


# ---------------------------------------------------------------- runs


class Text:
    """A piece of text that one element holds: a run, or the text of a run within a link."""

    def __init__(self, element):
        self.element = element

    @property
    def text(self) -> str:
        if self.element.tag == f"{_W}t":
            return self.element.text or ""
        return "".join(t.text or "" if t.tag == f"{_W}t" else _BREAKS.get(t.tag, "") for t in self.element)

    @text.setter
    def text(self, value: str) -> None:
        if self.element.tag == f"{_W}t":
            self.element.text = value
            self.element.set(_SPACE, "preserve")
            return
        for t in [t for t in self.element if t.tag == f"{_W}t" or t.tag in _BREAKS]:
            self.element.remove(t)
        for piece in re.split("([\t\n])", value):
            if piece in ("\t", "\n"):
                ET.SubElement(self.element, f"{_W}tab" if piece == "\t" else f"{_W}br")
            elif piece:
                t = ET.SubElement(self.element, f"{_W}t")
                t.text = piece
                t.set(_SPACE, "preserve")


def runs_of(p) -> list[Text]:
    """In order; those inside links as well."""
    out = []
    for child in p:
        if child.tag == f"{_W}r":
            out.append(Text(child))
        elif child.tag == f"{_W}hyperlink":
            out += [Text(t) for r in child if r.tag == f"{_W}r" for t in r if t.tag == f"{_W}t"]
    return out


def spliced_runs(texts: list[str], spans: list[Span]) -> list[str]:
    """Texts of runs with disjoint spans of the whole replaced: a replacement goes into the run where its span starts."""
    out, at = list(texts), [0]
    for t in texts:
        at.append(at[-1] + len(t))
    for start, end, new in sorted(spans, reverse=True):
        if not 0 <= start < end <= at[-1]:
            continue
        for k in range(len(texts)):
            lo, hi = max(start, at[k]), min(end, at[k + 1])
            if lo < hi:
                out[k] = out[k][: lo - at[k]] + (new if lo == start else "") + out[k][hi - at[k] :]
    return out


# ---------------------------------------------------------------- docx


def _sections(z: zipfile.ZipFile, body) -> Iterator[tuple[str, str, int]]:
    """(kind, part, section) of each distinct header, then of each footer."""
    targets = _targets(z, "word/document.xml")
    for kind in ("header", "footer"):
        seen = set()
        for s, sect in enumerate(body.iter(f"{_W}sectPr")):
            refs = {_KINDS.get(x.get(f"{_W}type", "default"), ""): targets.get(x.get(f"{_R}id")) for x in sect if x.tag == f"{_W}{kind}Reference"}
            for prefix in _KINDS.values():
                part = refs.get(prefix)
                if part and part not in seen:
                    seen.add(part)
                    yield prefix + kind, part, s


def _places(z: zipfile.ZipFile, parts: dict[str, Part]) -> Iterator[tuple[str, object, str, dict]]:
    """(segment_id, paragraph, part, meta): body, then table cells (a merged cell once), then headers, then footers."""

    def part(name: str) -> Part:
        if name not in parts:
            parts[name] = Part(z.read(name))
        return parts[name]

    name = "word/document.xml"
    body = part(name).root.find(f"{_W}body")
    for i, p in enumerate(body.findall(f"{_W}p")):
        yield f"para_{i}", p, name, {"type": "paragraph", "index": str(i)}
    for t, tbl in enumerate(body.findall(f"{_W}tbl")):
        for r, row in enumerate(tbl.findall(f"{_W}tr")):
            c = 0
            for cell in row.findall(f"{_W}tc"):
                merge, wide = cell.find(f"{_W}tcPr/{_W}vMerge"), cell.find(f"{_W}tcPr/{_W}gridSpan")
                if merge is None or merge.get(f"{_W}val") == "restart":
                    for k, p in enumerate(cell.findall(f"{_W}p")):
                        yield f"table_{t}_r_{r}_c_{c}_p_{k}", p, name, {"type": "table", "table": str(t)}
                c += int(wide.get(f"{_W}val")) if wide is not None else 1
    for kind, where, s in _sections(z, body):
        for k, p in enumerate(part(where).root.findall(f"{_W}p")):
            yield f"sec_{s}_{kind}_p_{k}", p, where, {"type": kind.rpartition("_")[2], "section": str(s)}


def docx_segments(content: bytes) -> list[tuple[str, str, dict]]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return [(s, "".join(r.text for r in runs_of(p)), m) for s, p, _, m in _places(z, {})]


def docx_runs(content: bytes) -> list[tuple[str, int, int, int, str]]:
    """(segment_id, run, start, end, text) of every run."""
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for s, p, _, _ in _places(z, {}):
            at = 0
            for k, r in enumerate(runs_of(p)):
                out.append((s, k, at, at + len(r.text), r.text))
                at += len(r.text)
    return out


def docx_stats(content: bytes) -> dict[str, int]:
    """Paragraphs, tables and sections, and the distinct headers and footers that sections refer to; of each kind the first section
    has one, of its own or an empty one."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        sections = list(body.iter(f"{_W}sectPr"))
        out = {"paragraphs": len(body.findall(f"{_W}p")), "tables": len(body.findall(f"{_W}tbl")), "sections": len(sections)}
        targets = _targets(z, "word/document.xml")
        for kind in ("header", "footer"):
            refs = [{(x.get(f"{_W}type", "default"), targets.get(x.get(f"{_R}id"))) for x in s if x.tag == f"{_W}{kind}Reference"} for s in sections]
            lacking = set(_KINDS) - {t for t, _ in refs[0]} if refs else set()
            out[f"unique_{kind}s"] = len({part for x in refs for _, part in x}) + len(lacking)
        return out


def _links(data: bytes, emails: dict[str, str]) -> bytes:
    """Relationships with the targets of found addresses replaced; a query behind the address goes."""
    part = Part(data)
    for x in part.root:
        target = x.get("Target", "")
        if x.get("Type", "").endswith(_HYPERLINK) and target.startswith("mailto:"):
            new = emails.get(target.removeprefix("mailto:").split("?")[0].strip())
            if new:
                x.set("Target", f"mailto:{new}")
    return part.bytes()


def _repacked(content: bytes, new: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as w:
        for item in z.infolist():
            w.writestr(item, new.get(item.filename) or z.read(item.filename))
    return out.getvalue()


def redacted_docx(content: bytes, spans: dict[str, list[Span]], emails: dict[str, str] | None = None) -> bytes:
    """spans: (start, end, replacement) by segment; emails: addresses whose links change as well. Runs keep their formatting."""
    new = {}
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        parts: dict[str, Part] = {}
        touched = set()
        for s, p, where, _ in _places(z, parts):
            if spans.get(s):
                runs = runs_of(p)
                for r, old, text in zip(runs, (texts := [r.text for r in runs]), spliced_runs(texts, spans[s])):
                    if text != old:
                        r.text = text
                        touched.add(where)
        new = {name: parts[name].bytes() for name in touched}
        rels = "word/_rels/document.xml.rels"
        if emails and rels in z.namelist():
            new[rels] = _links(z.read(rels), emails)
    return _repacked(content, new)
