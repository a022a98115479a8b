"""XLSX packages in one pass over their bytes: cells with text, and packages with redacted text.

A sheet is parsed as it is unpacked and what holds is a piece of it, so its size does not matter. Shared texts are kept packed, in
blocks, and the blocks asked for last unpacked. A redacted sheet is the old one byte for byte but for the changed cells.

Cells that name no place follow the one before them; a number that no shared text has is no text. Phonetic readings are no text."""

from __future__ import annotations

import io
import re
import shutil
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from xml.etree import ElementTree as ET
from xml.parsers import expat
from xml.sax.saxutils import escape

from redactory.sources.office import Span, _targets, spliced_runs

PIECE = 1 << 16
BLOCK_TEXTS = 1_000
OPEN_BLOCKS = 16

_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_TYPE = re.compile(rb"""\st\s*=\s*("[^"]*"|'[^']*')""")
_OPENING = re.compile(rb"""<((?:[\w.-]+:)?)c((?:[^>"']|"[^"]*"|'[^']*')*)>""")


_place = re.compile("([A-Z]+)([0-9]+)").fullmatch


@lru_cache(1 << 10)
def column_number(ref: str) -> int:
    n = 0
    for c in ref:
        n = n * 26 + ord(c) - 64
    return n


def column_letters(n: int) -> str:
    out = ""
    while n:
        n, k = divmod(n - 1, 26)
        out = chr(65 + k) + out
    return out


@lru_cache(1 << 10)
def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


class SharedTexts:
    """Texts by number; all are packed but those of the blocks that were asked for last."""

    def __init__(self, texts: Iterable[str]):
        self.blocks: list[bytes] = []
        block: list[str] = []
        for t in texts:
            block.append(t)
            if len(block) == BLOCK_TEXTS:
                self._close(block)
                block = []
        self._close(block)
        self._opened = lru_cache(OPEN_BLOCKS)(self._open)

    def _close(self, block: list[str]) -> None:
        if block:  # lengths are of code points; a surrogate alone stays what it is
            lengths = " ".join(str(len(t)) for t in block)
            self.blocks.append(zlib.compress(f"{lengths}\n{''.join(block)}".encode("utf-8", "surrogatepass"), 1))

    def _open(self, k: int) -> list[str]:
        lengths, _, text = zlib.decompress(self.blocks[k]).decode("utf-8", "surrogatepass").partition("\n")
        out, at = [], 0
        for n in map(int, lengths.split()):
            out.append(text[at : at + n])
            at += n
        return out

    def __getitem__(self, number: int) -> str | None:
        if not 0 <= number // BLOCK_TEXTS < len(self.blocks):
            return None
        block = self._opened(number // BLOCK_TEXTS)
        return block[number % BLOCK_TEXTS] if number % BLOCK_TEXTS < len(block) else None


class _SharedTable:
    """Texts of the shared table, as its bytes come in."""

    def __init__(self):
        self.parser = p = expat.ParserCreate(None, "}")
        p.buffer_text = True
        p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = self._start, self._end, self._data
        self.depth = self.aside = 0
        self.within = False
        self.text: list[str] = []
        self.closed: list[str] = []

    def _start(self, tag: str, attributes: dict[str, str]) -> None:
        name = _local(tag)
        self.depth += 1
        self.aside += name == "rPh"
        self.within = name == "t" and not self.aside

    def _data(self, text: str) -> None:
        if self.within:
            self.text.append(text)

    def _end(self, tag: str) -> None:
        name = _local(tag)
        self.depth -= 1
        self.aside -= name == "rPh"
        self.within = False
        if name == "si" and self.depth == 1:
            self.closed.append("".join(self.text))
            self.text = []

    def feed(self, data: bytes, last: bool) -> list[str]:
        """Texts that ended."""
        self.closed = []
        self.parser.Parse(data, last)
        return self.closed


def _shared(z: zipfile.ZipFile) -> Iterator[str]:
    """The texts of the shared table, one after the other."""
    if "xl/sharedStrings.xml" not in z.namelist():
        return
    with z.open("xl/sharedStrings.xml") as f:
        table = _SharedTable()
        while data := f.read(PIECE):
            yield from table.feed(data, False)
        yield from table.feed(b"", True)


class _Cell:
    __slots__ = ("at", "attributes", "row", "column", "has_formula", "parts")

    def __init__(self, at: int, attributes: dict[str, str], row: int, column: int):
        self.at, self.attributes, self.row, self.column = at, attributes, row, column
        self.has_formula = False
        self.parts: dict[str, list[str]] = {}

    def text(self, shared: SharedTexts) -> str | None:
        parts, kind = self.parts, self.attributes.get("t")
        if formula := "".join(parts.get("f", ())):
            return "=" + formula
        if kind == "inlineStr":
            return "".join(parts.get("t", ()))
        value = "".join(parts.get("v", ()))
        if kind == "s":
            return shared[int(value)] if value.strip().isdecimal() else None
        return value


class _Sheet:
    """Cells of a sheet, as its bytes come in (UTF-8)."""

    def __init__(self):
        self.parser = p = expat.ParserCreate("UTF-8", "}")
        p.buffer_text = True
        p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = self._start, self._end, self._data
        self.row = self.column = 0
        self.cell: _Cell | None = None
        self.into: list[str] | None = None
        self.aside = 0
        self.closed: list[tuple[_Cell, int]] = []

    def _start(self, tag: str, attributes: dict[str, str]) -> None:
        name = _local(tag)
        if self.cell is not None:
            self.aside += name == "rPh"
            self.cell.has_formula |= name == "f"
            self.into = self.cell.parts.setdefault(name, []) if name in ("v", "t", "f") and not self.aside else None
        elif name == "row":
            self.row = int(attributes["r"]) if "r" in attributes else self.row + 1
            self.column = 0
        elif name == "c":
            place = _place(attributes.get("r", ""))
            self.column = column_number(place[1]) if place else self.column + 1
            self.row = int(place[2]) if place else self.row
            self.cell = _Cell(self.parser.CurrentByteIndex, attributes, self.row, self.column)

    def _data(self, text: str) -> None:
        if self.into is not None:
            self.into.append(text)

    def _end(self, tag: str) -> None:
        name = _local(tag)
        self.into = None
        if self.cell is not None:
            self.aside -= name == "rPh"
            if name == "c":
                self.closed.append((self.cell, self.parser.CurrentByteIndex))
                self.cell = None

    def feed(self, data: bytes, last: bool) -> list[tuple[_Cell, int]]:
        """Cells that ended, each with the place of its closing tag."""
        self.closed = []
        self.parser.Parse(data, last)
        return self.closed


def _pieces(f) -> Iterator[bytes]:
    """What a part holds as UTF-8; a part may be UTF-16."""
    first = f.read(max(PIECE, 2))
    if first[:2] in (b"\xff\xfe", b"\xfe\xff"):
        rest = io.TextIOWrapper(io.BufferedReader(_Chain(first, f)), "utf-16", newline="")
        head = re.sub(r"""^(<\?xml[^>]*encoding\s*=\s*["'])[^"']*""", r"\1UTF-8", rest.read(PIECE))
        while head:
            yield head.encode()
            head = rest.read(PIECE)
        return
    while first:
        yield first
        first = f.read(PIECE)


class _Chain(io.RawIOBase):
    """Bytes, then the rest of a file."""

    def __init__(self, first: bytes, f):
        self.first, self.f = first, f

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        data = self.first[: len(into)] if self.first else self.f.read(len(into))
        self.first = self.first[len(data) :] if self.first else b""
        into[: len(data)] = data
        return len(data)


def _sheets(z: zipfile.ZipFile) -> Iterator[tuple[int, str, str]]:
    """(number, name, part) of the sheets, in the workbook's order; those without a part are left out but counted."""
    targets, names = _targets(z, "xl/workbook.xml"), set(z.namelist())
    sheets = (x for x in ET.fromstring(z.read("xl/workbook.xml")).iter() if _local(x.tag) == "sheet")
    for k, x in enumerate(sheets):
        part = targets.get(x.get(f"{_R}id"))
        if part in names:
            yield k, x.get("name"), part


def segments(content: bytes) -> Iterator[tuple[str, str, dict]]:
    """(segment_id, text, meta) of every cell whose text is not blank."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = SharedTexts(_shared(z))
        for k, name, part in _sheets(z):
            sheet = _Sheet()
            with z.open(part) as f:
                for data in _pieces(f):
                    for cell, _ in sheet.feed(data, False):
                        text = cell.text(shared)
                        if text and text.strip():
                            place = cell.attributes.get("r") or f"{column_letters(cell.column)}{cell.row}"
                            yield f"sheet_{k}_r{cell.row}_c{cell.column}", text, {"sheet": name, "coordinate": place, "is_formula": str(cell.has_formula).lower()}
                sheet.feed(b"", True)


def _changed(raw: bytes, text: str) -> bytes:
    """A cell with a text of its own; its place and style stay."""
    prefix, attributes = _OPENING.match(raw).groups()
    p = prefix.decode()
    return b"<%sc%s" % (prefix, _TYPE.sub(b"", attributes)) + f' t="inlineStr"><{p}is><{p}t xml:space="preserve">{escape(text, {chr(13): "&#13;"})}</{p}t></{p}is></{p}c>'.encode()


def _rewritten(f, k: int, spans: dict[str, list[Span]], shared: SharedTexts) -> Iterator[bytes]:
    """The bytes of a sheet with the cells that have spans changed."""
    sheet, held, base = _Sheet(), b"", 0  # held: what is not given out yet, from byte base on
    for data in _pieces(f):
        held += data
        out, at = [], 0
        for cell, closing in sheet.feed(data, False):
            found = spans.get(f"sheet_{k}_r{cell.row}_c{cell.column}")
            text = cell.text(shared) if found else None
            if text and text.strip():
                start, end = cell.at - base, held.index(b">", closing - base) + 1
                out += [held[at:start], _changed(held[start:end], spliced_runs([text], found)[0])]
                at = end
        upto = max(at, sheet.cell.at - base if sheet.cell else sheet.parser.CurrentByteIndex - base)
        out.append(held[at:upto])
        yield b"".join(out)
        held, base = held[upto:], base + upto
    sheet.feed(b"", True)
    yield held


def redacted(content: bytes, spans: dict[str, list[Span]]) -> bytes:
    """A changed cell becomes a text of its own; shared texts of other cells stay, and all else byte for byte."""
    changed = {int(s.split("_")[1]) for s, found in spans.items() if found and re.fullmatch(r"sheet_\d+_r\d+_c\d+", s)}
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as w:
        shared = SharedTexts(_shared(z) if changed else ())
        number = {part: k for k, _, part in _sheets(z)}
        for item in z.infolist():
            k = number.get(item.filename)
            info = zipfile.ZipInfo(item.filename, item.date_time)
            info.compress_type, info.external_attr, info.comment = item.compress_type, item.external_attr, item.comment
            with z.open(item) as f, w.open(info, "w", force_zip64=item.file_size > 1 << 30) as to:
                if k in changed:
                    to.writelines(_rewritten(f, k, spans, shared))
                else:
                    shutil.copyfileobj(f, to, PIECE)
    return out.getvalue()
