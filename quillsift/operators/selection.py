"""Which files are read, and by which reader."""

from __future__ import annotations

import json
import re
import zipfile
from typing import BinaryIO

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.encoding import decode, detect_encoding

# The extensions and media types of each reader, in order of precedence.
HANDLERS: dict[str, dict[str, tuple[str, ...]]] = {
    "docx": {"ext": (".docx",), "mime": ("application/vnd.openxmlformats-officedocument.wordprocessingml.document",)},
    "pdf": {"ext": (".pdf",), "mime": ("application/pdf",)},
    "plaintext": {
        "ext": tuple(
            ".aplt .applescript .armx .asp .asax .asmx .aspx .bat .c .cc .cfm .clj .cljs .clojure .cob .cpp .csh .csv .erl .h .hrl .htm .ht4 .html .html5 "
            ".go .gvy .j .json .js .jsp .log .perl .php .pl .ps1 .py .rb .scpt .sdef .ser .sh .toml .txt .vb .xml .yaml .zsh".split()
        ),
        "mime": ("application/json", "application/toml", "application/xml", "text/html", "text/plain"),
    },
    "xls": {"ext": (".xls",), "mime": ("application/vnd.ms-excel", "application/excel")},
    "xlsx": {
        "ext": (".xlsx", ".xlsm", ".xlst", ".xltm"),
        "mime": ("application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "application/vnd.ms-excel.sheet.macroEnabled", "application/vnd.ms-excel.template"),
    },
}
BLANK_CELLS, BLANK_ROWS = 500, 250
# How files of a type begin, and the folders inside Office archives.
MAGIC = (
    (b"%PDF-", "application/pdf"), (bytes.fromhex("D0CF11E0A1B11AE1"), "application/vnd.ms-excel"), (b"{\\rtf", "text/rtf"),
    (b"<?xml", "application/xml"), (b"<!doctype html", "text/html"), (b"<html", "text/html"), (b"<!doctype", "application/xml"),
)
ARCHIVE = b"PK\x03\x04"
PARTS = (
    ("word/", "application/vnd.openxmlformats-officedocument.wordprocessingml.document"),
    ("xl/", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"),
)
#: So much of the start of a file tells its type.
HEAD = 1 << 16


def supported(kind: str) -> list[str]:
    """All extensions ('ext') or media types ('mime') that a reader takes."""
    return [x for h in HANDLERS.values() for x in h[kind]]


def handler(ext: Column, mime: Column) -> Column:
    """The first reader that takes the extension or the media type; null if none does."""
    out = F.lit(None).cast("string")
    for name in reversed(HANDLERS):
        known = ext.isin(*HANDLERS[name]["ext"]) | F.coalesce(mime.isin(*HANDLERS[name]["mime"]), F.lit(False))
        out = F.when(known, name).otherwise(out)
    return out


def file_matches(ext: Column, mime: Column, exts: list[str] | None = None, mimes: list[str] | None = None, ignore_case: bool = False) -> Column:
    """Extension in `exts` (case counts unless `ignore_case`) or media type in `mimes`; None: all that are supported."""
    exts, mimes = supported("ext") if exts is None else exts, supported("mime") if mimes is None else mimes
    own = F.lower(ext) if ignore_case else ext
    return F.coalesce(own.isin(*exts), F.lit(False)) | F.coalesce(mime.isin(*mimes), F.lit(False))


def file_checks(length: Column) -> Column:
    """Only files with content are read."""
    return F.coalesce(length > 0, F.lit(False))


def excluded(directory: Column, patterns: list[str], starts: list[str] = ()) -> Column:
    """A directory whose lower-case path begins with a pattern; a start directory never is. Prefixes, not globs."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | F.lower(directory).startswith(p.lower())
    return hit & ~F.coalesce(directory.isin(*starts), F.lit(False)) if starts else hit


def register(name: str, exts: tuple[str, ...] = (), mimes: tuple[str, ...] = ()) -> None:
    """Says which files a further reader takes; the readers before it come first."""
    HANDLERS[name] = {"ext": tuple(exts), "mime": tuple(mimes)}


def unregister(name: str) -> None:
    HANDLERS.pop(name, None)


def media_type_of(f: BinaryIO) -> str | None:
    """Media type of an open file: by its first bytes, for archives by the names in their directory, for other text by how it begins; null if nothing is known."""
    f.seek(0)
    head = f.read(HEAD)
    low = head[:64].removeprefix(b"\xef\xbb\xbf").lstrip().lower()
    if head.startswith(ARCHIVE):
        try:
            with zipfile.ZipFile(f) as z:
                names = z.namelist()
        except (zipfile.BadZipFile, OSError, ValueError):
            return None
        return next((mime for inside, mime in PARTS if any(n.startswith(inside) for n in names)), "application/zip")
    for start, mime in MAGIC:
        if (low if start.startswith(b"<") else head).startswith(start):
            return mime
    name = detect_encoding(head)
    if name is None:
        return None
    text = (decode(head, name) or "").strip("\ufeff \t\r\n")
    if _MARKUP.match(text):
        return "application/xml"
    if _OBJECT.match(text) and (len(head) == HEAD or _is_json(text)):
        return "application/json"
    return "text/plain" if text else None


#: How markup and JSON begin.
_MARKUP, _OBJECT = re.compile(r"<(?:!--|[A-Za-z_][\w.:-]*[\s/>])"), re.compile(r"\{\s*(?:\"|\})|\[\s*(?:[\[{\"\]0-9-]|true|false|null)")


def _is_json(text: str) -> bool:
    try:
        json.loads(text)
    except ValueError:
        return False
    return True
