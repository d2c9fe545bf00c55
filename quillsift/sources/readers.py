"""Readers from a file's bytes to blocks of text. A reader takes all bytes of a file and yields texts; plain text is read in ranges. Errors are the caller's business."""

from __future__ import annotations

import io
import re
import zipfile
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from typing import BinaryIO
from xml.etree import ElementTree

from ..operators.selection import BLANK_CELLS, BLANK_ROWS
from . import pdf, xls
from .encoding import CUTTABLE, SAMPLE, decode, detect_encoding

Reader = Callable[[bytes], Iterator[str]]

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Characters of a block: as many chunks of 650 as the default of the scan.
BLOCK = 100_000 * 650
#: Characters of a piece, where a scan may take pieces for blocks.
PIECE = 1 << 20
#: Bytes that are decoded at once.
_STEP = 8 << 20


def pack(lines: Iterable[str], size: int = BLOCK) -> Iterator[str]:
    """The words of the lines in blocks, one blank apart.

    After a line that fills the buffer (each word counts its blank), one block leaves, up to the word that reaches `size`; what is left at the end is the last block,
    whatever its size, and may be empty. The buffer holds texts of many lines, not words, of which each would take ten times its characters.
    """
    held: deque[str] = deque()
    new: list[str] = []
    at = chars = fresh = 0  # what has left of the first string, what is held, and what of it is new
    for line in lines:
        if words := " ".join(line.split()):
            new.append(words)
            fresh += len(words) + 1
            chars += len(words) + 1
        if new and (fresh >= PIECE or chars >= size):
            held.append(" ".join(new))
            new, fresh = [], 0
        if chars >= size:
            out, taken = [], 0
            while taken < size:
                cut = held[0].find(" ", at + size - taken - 1)
                out.append(held[0][at:] if cut < 0 else held[0][at:cut])
                taken += len(out[-1]) + 1
                at = cut + 1
                if cut < 0:
                    held.popleft()
            chars -= taken
            yield " ".join(out)
    yield " ".join([*([held.popleft()[at:]] if held else []), *held, *new])


#: A blank that no card number and no address can hold, nor two numbers share: it doesn't stand between two digits or after a backslash.
_APART = re.compile(r"(?<![0-9\\]) |(?<=[0-9]) (?![0-9])")


def cut(lines: Iterable[str], size: int = PIECE, most: int = BLOCK) -> Iterator[str]:
    """The words of the lines in pieces that together have the same card numbers and addresses as the whole: a piece of `size` characters ends at the next blank that parts them.

    Where there is none (words that are numbers throughout), a piece grows to `most` and ends as a block does.
    """
    held: list[str] = []
    chars, full = 0, size
    for line in lines:
        if not (words := " ".join(line.split())):
            continue
        held.append(words)
        chars += len(words) + 1
        if chars <= full:
            continue
        text, at = " ".join(held), 0
        while len(text) - at > size:
            apart = _APART.search(text, at + size - 1)
            end = apart.start() if apart else -1
            if len(text) - at > most and not 0 <= end - at < most:
                end = text.find(" ", at + most - 1)
            if end < 0:
                break
            yield text[at:end]
            at = end + 1
        held, chars = [text[at:]], len(text) - at + 1
        full = max(size, 2 * chars) if chars > size else size  # what has no such blank isn't searched again at each line
    yield " ".join(held)


def lines_between(f: BinaryIO, start: int, stop: int) -> Iterator[bytes]:
    """The lines that begin in [start, stop), by line feeds, in pieces of about _STEP bytes; a longer line is cut at blanks. A file's ranges give each line once."""
    at = start
    if start:
        f.seek(start - 1)
        while (part := f.readline(_STEP)) and not part.endswith(b"\n"):
            at += len(part)
        at += len(part) - 1
    f.seek(at)
    while at < stop and (part := f.read(min(_STEP, stop - at))):
        at += len(part)
        while not part.endswith(b"\n") and (more := f.readline(_STEP)):
            at += len(more)
            if len(part) >= _STEP and (cut := part.rfind(b" ") + 1):
                yield part[:cut]
                part = part[cut:]
            part += more
        yield part


def read_plaintext(f: BinaryIO, start: int = 0, stop: int | None = None, size: int = BLOCK, pieces: bool = False) -> Iterator[str]:
    """Blocks of a range of a text file, or pieces of them; nothing if its encoding isn't known. Where line feeds are no bytes of their own, the first range is the whole file."""
    f.seek(0)
    into = cut if pieces else lambda lines: pack(lines, size)
    name = detect_encoding(f.read(SAMPLE))
    if name is None:
        return
    end = f.seek(0, io.SEEK_END)
    if name not in CUTTABLE:
        if start:
            return
        f.seek(0)
        text = io.TextIOWrapper(f, encoding=name, errors="replace", newline="")
        yield from _filled(into(text))
        text.detach()
        return
    parts = (decode(part, name) or "" for part in lines_between(f, start, end if stop is None else stop))
    yield from _filled(into(line for part in parts for line in part.removeprefix("\ufeff").split("\n")))


def _filled(blocks: Iterator[str]) -> Iterator[str]:
    return (b for b in blocks if b)


def _paragraphs(part: bytes) -> Iterator[str]:
    for p in ElementTree.fromstring(part).iter(f"{_W}p"):
        yield "".join(t.text or "" if t.tag == f"{_W}t" else " " for t in p.iter() if t.tag in (f"{_W}t", f"{_W}tab", f"{_W}br"))


def read_docx(raw: bytes) -> Iterator[str]:
    """Headers, body, footers, foot- and endnotes, comments, then the core properties, as one block."""
    lines: list[str] = []
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = sorted(z.namelist())
        for start in ("word/header", "word/document.xml", "word/footer", "word/footnotes", "word/endnotes", "word/comments.xml"):
            for name in names:
                if name.startswith(start) and name.endswith(".xml"):
                    lines += _paragraphs(z.read(name))
        if "docProps/core.xml" in names:
            lines.append(str({e.tag.rpartition("}")[2]: e.text for e in ElementTree.fromstring(z.read("docProps/core.xml")) if e.text}))
    yield "\n".join(lines)


def sheet_text(rows: Iterator[list[str]]) -> str:
    """Cells of a sheet in row order, under the limits on blank cells and rows."""
    lines, idle = [], 0
    for row in rows:
        blanks, kept = 0, []
        for cell in row:
            if cell == "":
                blanks += 1
                if blanks > BLANK_CELLS:
                    break
            else:
                kept.append(cell)
        lines.append(" ".join(kept))
        idle = 0 if kept else idle + 1
        if idle > BLANK_ROWS:
            break
    return "\n".join(filter(None, lines))


def _column(reference: str) -> int:
    n = 0
    for c in reference:
        if c.isalpha():
            n = n * 26 + ord(c.upper()) - 64
    return n


def read_xlsx(raw: bytes) -> Iterator[str]:
    """A block for each sheet that has text, in the workbook's order; formulas give their stored values."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            for item in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_S}si"):
                shared.append("".join(t.text or "" for t in item.iter(f"{_S}t")))
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}

        def rows(part: bytes) -> Iterator[list[str]]:
            at = 0
            for row in ElementTree.fromstring(part).iter(f"{_S}row"):
                number = int(row.get("r") or at + 1)
                for _ in range(min(number - at - 1, BLANK_ROWS + 1)):
                    yield []
                at, cells = number, []
                for cell in row.iter(f"{_S}c"):
                    cells += [""] * (_column(cell.get("r") or "") - len(cells) - 1)
                    value = cell.findtext(f"{_S}v") or ""
                    if cell.get("t") == "s" and value:
                        value = shared[int(value)]
                    elif cell.get("t") == "inlineStr":
                        value = "".join(t.text or "" for t in cell.iter(f"{_S}t"))
                    elif cell.get("t") == "b":
                        value = {"1": "True", "0": "False"}.get(value, value)
                    cells.append(value)
                yield cells

        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet"):
            target = targets[sheet.get(f"{_R}id")].lstrip("/")
            part = target if target.startswith("xl/") else f"xl/{target}"
            if part in names and (text := sheet_text(rows(z.read(part)))):
                yield text


def read_xls(raw: bytes) -> Iterator[str]:
    """A block for each sheet that has text; whole numbers without their decimal point, dates as their serial numbers."""
    said = lambda v: str(v)[:-2] if isinstance(v, float) and str(v).endswith(".0") else str(v)
    for _, cells in xls.sheets(raw):
        rows = ([said(cells[r].get(c, "")) for c in range(max(cells[r]) + 1)] if cells.get(r) else [] for r in range(max(cells, default=-1) + 1))
        if text := sheet_text(rows):
            yield text


def read_pdf(raw: bytes) -> Iterator[str]:
    """A block for each page that has text, then the metadata's values."""
    book = pdf.Document(raw)
    for page in book.pages():
        if text := pdf.page_text(book, page):
            yield text
    if text := "\n".join(book.info()):
        yield text


READERS: dict[str, Reader] = {"docx": read_docx, "pdf": read_pdf, "plaintext": lambda raw: read_plaintext(io.BytesIO(raw)), "xls": read_xls, "xlsx": read_xlsx}


def register(name: str, reader: Reader) -> None:
    """Adds a reader or replaces one; selection.register() says which files it takes. Workers know it if it is registered in a module that they import."""
    READERS[name] = reader


def unregister(name: str) -> None:
    READERS.pop(name, None)


def read(name: str, f: BinaryIO, start: int = 0, stop: int | None = None, pieces: bool = False) -> Iterator[str]:
    """The blocks of a file by the reader of this name; only plain text knows ranges and pieces."""
    return read_plaintext(f, start, stop, pieces=pieces) if name == "plaintext" else READERS[name](f.read())
