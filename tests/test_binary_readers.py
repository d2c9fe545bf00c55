"""PDF and old Excel files made here, part by part."""

import struct
import zlib

import pytest

from quillsift.sources import pdf
from quillsift.sources.readers import read_pdf, read_xls


def make_pdf(objects, trailer="/Root 1 0 R /Info 9 0 R"):
    out = b"%PDF-1.5\n"
    for number, body in objects.items():
        out += f"{number} 0 obj\n".encode() + (body if isinstance(body, bytes) else body.encode()) + b"\nendobj\n"
    return out + f"trailer\n<< {trailer} >>\n%%EOF".encode()


def stream(data, more="", flate=True):
    data = zlib.compress(data) if flate else data
    return f"<< /Length {len(data)} {'/Filter /FlateDecode' if flate else ''} {more} >>\nstream\n".encode() + data + b"\nendstream"


CMAP = b"/CIDInit begincmap 1 beginbfchar <0001> <0040> endbfchar 2 beginbfrange <0010> <0012> <0061> <0020> <0021> [<006F> <0072>] endbfrange endcmap"
OBJECTS = {
    1: "<< /Type /Catalog /Pages 2 0 R >>",
    2: "<< /Type /Pages /Kids [3 0 R 5 0 R 7 0 R] /Count 3 /Resources << /Font << /F1 << /Type /Font >> /F2 << /ToUnicode 8 0 R >> >> >> >>",
    3: "<< /Type /Page /Parent 2 0 R /Contents [4 0 R] >>",
    4: stream(rb"BT /F1 12 Tf 10 700 Td (Card \(visa\) 4684) Tj 0 -14 Td [(39929) -20 (3674835) -400 (end)] TJ T* (caf\351 \101) Tj ET"),
    5: "<< /Type /Page /Parent 2 0 R /Contents 6 0 R >>",
    6: stream(b"BT /F2 9 Tf 1 0 0 1 5 600 Tm <00100001001100120020> Tj 1 0 0 1 5 580 Tm <0021> Tj ET BI /W 1 ID \x00(no) EI", flate=False),
    7: "<< /Type /Page /Parent 2 0 R >>",
    8: stream(CMAP),
    9: "<< /Title (A title) /Author <FEFF00E9> >>",
}


def test_pdf_pages_and_metadata():
    assert list(read_pdf(make_pdf(OBJECTS))) == ["Card (visa) 4684\n399293674835 end\ncafé A", "a@bco\nr", "A title\né"]


def test_pdf_forms_are_read_in_place():
    form = "/Type /XObject /Subtype /Form"
    objects = OBJECTS | {
        7: "<< /Type /Page /Parent 2 0 R /Contents 10 0 R /Resources << /XObject << /Fm1 11 0 R /Im1 13 0 R >> >> >>",
        10: stream(b"BT (before) Tj ET q /Fm1 Do Q /Im1 Do /Missing Do BT (after) Tj ET"),
        11: stream(b"BT (card 4700123456789010) Tj ET /Fm2 Do", form + " /Resources << /XObject << /Fm1 11 0 R /Fm2 12 0 R >> >>"),
        12: stream(b"BT /F2 9 Tf <00100011> Tj ET /Fm1 Do", form + " /Resources << /Font << /F2 << /ToUnicode 8 0 R >> >> /XObject << /Fm1 11 0 R >> >>"),
        13: stream(b"(no) Tj", "/Type /XObject /Subtype /Image"),
    }
    assert list(read_pdf(make_pdf(objects)))[2] == "before\ncard 4700123456789010\nab\nafter"


def test_pdf_object_streams_and_missing_parts():
    inner = {1: OBJECTS[1], 2: OBJECTS[2].replace("5 0 R 7 0 R", "3 0 R"), 3: OBJECTS[3]}
    body, heads = b"", []
    for n, text in inner.items():
        heads.append(f"{n} {len(body)}")
        body += text.encode() + b" "
    first = " ".join(heads).encode() + b" "
    packed = {20: stream(first + body, f"/Type /ObjStm /N {len(inner)} /First {len(first)}"), 4: OBJECTS[4]}
    assert list(read_pdf(make_pdf(packed, "/Root 1 0 R"))) == ["Card (visa) 4684\n399293674835 end\ncafé A"]
    assert list(read_pdf(make_pdf({1: "<< /Type /Catalog >>"}, "/Root 1 0 R"))) == []
    with pytest.raises(ValueError):
        list(read_pdf(b"plain"))
    with pytest.raises(ValueError):
        list(read_pdf(make_pdf(OBJECTS, "/Root 1 0 R /Encrypt 5 0 R")))
    circle = make_pdf({1: "<< /Type /Catalog /Pages 2 0 R >>", 2: "<< /Kids [2 0 R] >>"}, "/Root 1 0 R")
    assert list(read_pdf(circle)) == []


def test_pdf_values():
    read = lambda raw: pdf.Lexer(raw).value()
    assert read(b"<< /A [1 2 0 R -.5 (x(y)z\\\n) <41 4>] /B#20C true /D << /E null >> >>") == {"A": [1, 2, -0.5, b"x(y)z", b"A@"], "B C": True, "D": {"E": None}}
    assert isinstance(read(b"7 0 R"), pdf.Ref) and read(b"7 0 x") == 7 and read(b"") is None
    assert isinstance(read(b"[" * 5000 + b"]" * 5000), list)


def record(kind, data=b""):
    return struct.pack("<HH", kind, len(data)) + data


def text16(s, wide=False):
    return struct.pack("<HB", len(s), wide) + s.encode("utf-16-le" if wide else "latin-1")


def make_xls(cells, strings, parts=None, small=False):
    """A workbook of the sheets' records, in a compound file of 512-byte sectors."""
    sst = record(0xFC, struct.pack("<II", len(strings), len(strings)) + b"".join(strings)) if parts is None else parts
    bof = record(0x809, struct.pack("<HH", 0x600, 5) + b"\0" * 12)
    names = [f"S{k}".encode() for k in range(len(cells))]
    size = len(bof) + sum(len(record(0x85, b"\0" * 8 + n)) for n in names) + len(sst) + 4
    bounds, body = b"", b""
    for name, records in zip(names, cells):
        bounds += record(0x85, struct.pack("<IBBBB", size + len(body), 0, 0, len(name), 0) + name)
        body += bof + b"".join(records) + record(0x0A)
    book = bof + bounds + sst + record(0x0A) + body
    if not small:
        book = book.ljust(4096, b"\0")
    entry = lambda name, kind, at, n: (name.encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HBB", 2 * len(name) + 2, kind, 1) + b"\xff" * 12 + b"\0" * 36 + struct.pack("<IIi", at, n, 0)).ljust(128, b"\0")
    data = [book[k : k + 512].ljust(512, b"\0") for k in range(0, len(book), 512)]
    chain = [*range(3, 2 + len(data)), 0xFFFFFFFE]
    fat = [0xFFFFFFFD, 0xFFFFFFFE, *chain]
    mini_start, mini = 0xFFFFFFFE, []
    if small:
        mini_start = len(fat)
        fat.append(0xFFFFFFFE)
        n = -(-len(book) // 64)
        mini = [struct.pack("<I", k + 1 if k + 1 < n else 0xFFFFFFFE) for k in range(n)]
    root = entry("Root Entry", 5, 2 if small else 0xFFFFFFFE, len(book) if small else 0)
    listing = root + entry("Workbook", 2, 0 if small else 2, len(book))
    table = b"".join(struct.pack("<I", x) for x in fat).ljust(512, b"\xff")
    head = bytes.fromhex("D0CF11E0A1B11AE1") + b"\0" * 16 + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + b"\0" * 10
    head += struct.pack("<IIIIIIII", 1, 1, 0, 4096, mini_start, len(mini) and 1, 0xFFFFFFFE, 0) + struct.pack("<109I", 0, *[0xFFFFFFFF] * 108)
    return head + table + listing.ljust(512, b"\0") + b"".join(data) + (b"".join(mini).ljust(512, b"\xff") if small else b"")


def cell(kind, row, col, data):
    return record(kind, struct.pack("<HHH", row, col, 0) + data)


SHEET = [
    cell(0xFD, 0, 0, struct.pack("<I", 0)), cell(0x203, 0, 2, struct.pack("<d", 4700123456789010.0)), cell(0x27E, 1, 0, struct.pack("<I", 42 << 2 | 2)), cell(0x27E, 1, 1, struct.pack("<I", 150 << 2 | 3)),
    record(0xBD, struct.pack("<HHHIHIH", 2, 1, 0, 7 << 2 | 2, 0, 8 << 2 | 2, 2)), cell(0x06, 3, 0, b"\0" + b"\0" * 5 + b"\xff\xff" + b"\0" * 6), record(0x207, text16("made@by.org")),
    cell(0x06, 3, 1, struct.pack("<d", 2.5) + b"\0" * 6), cell(0x205, 3, 2, b"\1\0"), cell(0x204, 5, 0, text16("old")), cell(0xFD, 5, 1, struct.pack("<I", 1)),
]
WANT = "a@b.co 4700123456789010\n42 1.5\n7 8\nmade@by.org 2.5 1\nold é😀"


@pytest.mark.parametrize("small", [False, True])
def test_xls(small):
    raw = make_xls([SHEET, [], [cell(0xFD, 0, 0, struct.pack("<I", 0))]], [text16("a@b.co"), struct.pack("<HB", 3, 1) + "é😀".encode("utf-16-le")], small=small)
    assert list(read_xls(raw)) == [WANT, "a@b.co"]


def test_xls_strings_over_records():
    """A string that goes on in another record, in another width, and one with runs of formats."""
    rich = struct.pack("<HBH", 4, 8, 2) + b"rich" + b"\0" * 8
    first = struct.pack("<II", 3, 3) + rich + struct.pack("<HB", 6, 0) + b"abc"
    parts = record(0xFC, first) + record(0x3C, b"\1" + "déf".encode("utf-16-le") + text16("last"))
    raw = make_xls([[cell(0xFD, k, 0, struct.pack("<I", k)) for k in range(3)]], [], parts)
    assert list(read_xls(raw)) == ["rich\nabcdéf\nlast"]


def test_xls_that_is_none():
    with pytest.raises(ValueError):
        list(read_xls(b"text"))
    with pytest.raises(Exception):  # noqa: B017
        list(read_xls(bytes.fromhex("D0CF11E0A1B11AE1") + b"junk"))
