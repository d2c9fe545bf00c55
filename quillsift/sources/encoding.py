"""Encoding of raw bytes: by mark, then ASCII, strict UTF-8, and by script among the common sets of one and of several bytes."""

from __future__ import annotations

import codecs
import re
import unicodedata

# Marks at the start of a file and the encodings they stand for.
MARKS = (
    (codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"),
    (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"),
)
#: Encodings whose line feed is a byte of its own everywhere, so that a file may be cut at line feeds.
CUTTABLE = frozenset("ascii utf-8 utf-8-sig cp1252 iso-8859-1 cp1251 koi8-r cp866 shift_jis euc-jp euc-kr gb18030 big5".split())
#: Bytes that text doesn't have.
_CONTROLS = frozenset(range(32)) - {9, 10, 11, 12, 13, 27}
#: So much of the start of a file tells its encoding.
SAMPLE = 1 << 18
#: Fewer bytes over 127 tell no script.
ENOUGH = 16
_WORD = re.compile(rb"[A-Za-z\x80-\xff]+")


def _script(text: str, wanted: str) -> float:
    """Share of the characters beyond ASCII whose names begin with one of the `wanted`, of those that aren't punctuation."""
    found = [c for c in text if c > "\x7f" and unicodedata.category(c)[0] in "LSNC"]
    return sum(unicodedata.name(c, "").startswith(tuple(wanted.split("|"))) for c in found) / len(found) if found else 0.0


def _by_script(raw: bytes) -> str:
    """The encoding of text that isn't UTF-8. Accented letters stand between plain ones; other scripts make whole words of bytes over 127."""
    words = _WORD.findall(raw)
    high = sum(sum(b > 127 for b in w) for w in words)
    if high >= ENOUGH and 2 * high > sum(map(len, words)):
        # several bytes a character: every pair must be valid, and the characters of the language's own script
        for name, wanted, share in (("shift_jis", "HIRAGANA|KATAKANA", 0.3), ("euc-jp", "HIRAGANA|KATAKANA", 0.3), ("euc-kr", "HANGUL SYLLABLE", 0.9)):
            text = _strict(raw, name)
            if text is not None and _script(text, wanted) >= share and _script(text, f"CJK|{wanted}") > 0.9:
                return name
        # one byte a character: Cyrillic words are small letters, or one capital and small letters
        best = max(((_cyrillic(raw.decode(name, "replace")), -k, name) for k, name in enumerate(("cp1251", "koi8-r", "cp866"))))
        if best[0] > 0.9:
            return best[2]
        # the commoner half of the characters comes first in either set, by its leading byte
        leads = [(name, (lo, hi), _strict(raw, name)) for name, lo, hi in (("gb18030", 0xB0, 0xD7), ("big5", 0xA4, 0xC6))]
        told = [(_common(raw, *span), name) for name, span, text in leads if text is not None and _script(text, "CJK") > 0.9]
        if told:
            return max(told)[1]
    return "cp1252" if _strict(raw, "cp1252") is not None else "iso-8859-1"


def _strict(raw: bytes, name: str) -> str | None:
    """The text, if all of it is valid; a sample may end inside a character."""
    try:
        return codecs.getincrementaldecoder(name)("strict").decode(raw, final=len(raw) < SAMPLE)
    except UnicodeDecodeError:
        return None


def _cyrillic(text: str) -> float:
    """Share of the letters beyond ASCII in words of Cyrillic letters that are small but for the first, or all capitals."""
    words = [w for w in re.findall(r"[^\W\d_]+", text) if not w.isascii()]
    good = [w for w in words if all("Ѐ" <= c <= "џ" for c in w) and (w[1:].islower() or len(w) == 1 or (w.isupper() and len(w) < 12))]
    lower = sum(c.islower() for w in good for c in w)
    beyond = sum(c > "\x7f" and not c.isspace() for c in text)
    return sum(map(len, good)) / max(1, beyond, sum(map(len, words))) if 2 * lower > sum(map(len, good)) else 0.0


def _common(raw: bytes, low: int, high: int) -> float:
    leads, k = [], 0
    while k < len(raw):
        if raw[k] > 127:
            leads.append(low <= raw[k] <= high)
            k += 1
        k += 1
    return sum(leads) / max(1, len(leads))


def detect_encoding(raw: bytes) -> str | None:
    """The encoding of the bytes; None if they don't look like text. Empty input has none. Longer input than SAMPLE is told by its start."""
    for mark, name in MARKS:
        if raw.startswith(mark):
            return name
    raw = raw[:SAMPLE]
    if not raw or any(b in _CONTROLS for b in set(raw)):
        return None
    if raw.isascii():
        return "ascii"
    return "utf-8" if _strict(raw, "utf-8") is not None else _by_script(raw)


def decode(raw: bytes, name: str | None = None) -> str | None:
    """The text, with what can't be decoded replaced; None for an unknown encoding. What began as ASCII may go on as UTF-8 or in a set of one byte."""
    name = name or detect_encoding(raw)
    if name in ("ascii", "utf-8") and not raw.isascii():
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:
            name = _by_script(raw[:SAMPLE]) if name == "ascii" else name
    return None if name is None else raw.decode(name, errors="replace")
