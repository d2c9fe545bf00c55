"""Old Excel workbooks (BIFF8 in a compound file), as far as their cells' values go."""

from __future__ import annotations

import struct
from collections.abc import Iterator

_FREE = 0xFFFFFFFA  # sector numbers from here on mean the end of a chain


class Compound:
    """The streams of a compound file."""

    def __init__(self, raw: bytes) -> None:
        if not raw.startswith(bytes.fromhex("D0CF11E0A1B11AE1")):
            raise ValueError("not a compound file")
        self.raw, (self.shift, self.mini_shift) = raw, struct.unpack_from("<HH", raw, 30)
        start_dir, self.cutoff, start_mini = struct.unpack_from("<I4xI", raw, 48) + struct.unpack_from("<I", raw, 60)
        sectors = [s for s in struct.unpack_from("<109I", raw, 76) if s < _FREE]
        at, per = struct.unpack_from("<I", raw, 68)[0], (1 << self.shift) // 4
        while at < _FREE and len(sectors) < len(raw):
            more = struct.unpack_from(f"<{per}I", raw, self._offset(at))
            sectors += [s for s in more[:-1] if s < _FREE]
            at = more[-1]
        self.fat = [x for s in sectors for x in struct.unpack_from(f"<{per}I", raw, self._offset(s))]
        listing = self._chain(start_dir)
        self.entries = {}
        for k in range(0, len(listing) - 127, 128):
            n, kind = struct.unpack_from("<HB", listing, k + 64)
            name = listing[k : k + max(0, n - 2)].decode("utf-16-le", "replace")
            if kind:
                self.entries.setdefault(name, struct.unpack_from("<II", listing, k + 116))
                if kind == 5:
                    self.root = struct.unpack_from("<II", listing, k + 116)
        table = self._chain(start_mini) if start_mini < _FREE else b""
        self.mini_fat = struct.unpack(f"<{len(table) // 4}I", table[: len(table) // 4 * 4])

    def _offset(self, sector: int) -> int:
        return (sector + 1) << self.shift

    def _chain(self, at: int) -> bytes:
        out = []
        while at < len(self.fat) and len(out) <= len(self.fat):
            out.append(self.raw[self._offset(at) : self._offset(at + 1)])
            at = self.fat[at]
        return b"".join(out)

    def stream(self, name: str) -> bytes:
        at, size = self.entries[name]
        if size >= self.cutoff:
            return self._chain(at)[:size]
        whole, out = self._chain(self.root[0]), []
        while at < len(self.mini_fat) and len(out) <= len(self.mini_fat):
            out.append(whole[at << self.mini_shift : (at + 1) << self.mini_shift])
            at = self.mini_fat[at]
        return b"".join(out)[:size]


class _Strings:
    """Reads over a record and its continuations; characters that go on in the next one have their width told anew."""

    def __init__(self, parts: list[bytes]) -> None:
        self.parts, self.part, self.at = parts, 0, 0

    def take(self, n: int) -> bytes:
        out = b""
        while len(out) < n and self.part < len(self.parts):
            piece = self.parts[self.part][self.at : self.at + n - len(out)]
            out, self.at = out + piece, self.at + len(piece)
            if self.at >= len(self.parts[self.part]) and len(out) < n:
                self.part, self.at = self.part + 1, 0
        return out

    def text(self) -> str:
        n, flags = struct.unpack("<HB", self.take(3))
        runs = struct.unpack("<H", self.take(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", self.take(4))[0] if flags & 4 else 0
        out, wide = [], flags & 1
        while n:
            if self.at >= len(self.parts[self.part]):
                self.part, self.at = self.part + 1, 1
                wide = self.parts[self.part][0] & 1
            room = (len(self.parts[self.part]) - self.at) // (1 + wide)
            count = min(n, room)
            out.append(self.take(count * (1 + wide)).decode("utf-16-le" if wide else "latin-1", "replace"))
            n -= count
            if not room:
                break
        self.take(4 * runs + extra)
        return "".join(out)


def _records(book: bytes, at: int) -> Iterator[tuple[int, list[bytes]]]:
    """(kind, data with continuations) up to the end of the substream."""
    while at + 4 <= len(book):
        kind, n = struct.unpack_from("<HH", book, at)
        parts, at = [book[at + 4 : at + 4 + n]], at + 4 + n
        while book[at : at + 2] == b"\x3c\x00":
            n = struct.unpack_from("<H", book, at + 2)[0]
            parts.append(book[at + 4 : at + 4 + n])
            at += 4 + n
        yield kind, parts
        if kind == 0x0A:
            return


def _rk(value: int) -> float:
    number = float(struct.unpack("<i", struct.pack("<I", value))[0] >> 2) if value & 2 else struct.unpack("<d", struct.pack("<Q", (value & 0xFFFFFFFC) << 32))[0]
    return number / 100 if value & 1 else number


def sheets(raw: bytes) -> Iterator[tuple[str, dict[int, dict[int, object]]]]:
    """(name, cells by row and column) of each worksheet, in order. Values are texts, floats, and ints for truth values and errors."""
    files = Compound(raw)
    book = files.stream("Workbook" if "Workbook" in files.entries else "Book")
    shared: list[str] = []
    bounds: list[tuple[str, int]] = []
    for kind, parts in _records(book, 0):
        if kind == 0x2F:
            raise ValueError("the workbook is encrypted")
        if kind == 0x85:
            offset, _, what, n, wide = struct.unpack_from("<IBBBB", parts[0])
            if what == 0:
                bounds.append((parts[0][8 : 8 + n * (1 + (wide & 1))].decode("utf-16-le" if wide & 1 else "latin-1", "replace"), offset))
        elif kind == 0xFC:
            reader = _Strings([parts[0][8:], *parts[1:]])
            shared = [reader.text() for _ in range(struct.unpack_from("<I", parts[0], 4)[0])]
    for name, offset in bounds:
        cells: dict[int, dict[int, object]] = {}
        waiting: tuple[int, int] | None = None
        for kind, parts in _records(book, offset):
            data = parts[0]
            if kind in (0xFD, 0x203, 0x27E, 0x204, 0x06, 0x205, 0xBD):
                row, col = struct.unpack_from("<HH", data)
                put = cells.setdefault(row, {}).__setitem__
                if kind == 0xFD:
                    put(col, shared[struct.unpack_from("<I", data, 6)[0]])
                elif kind == 0x203:
                    put(col, struct.unpack_from("<d", data, 6)[0])
                elif kind == 0x27E:
                    put(col, _rk(struct.unpack_from("<I", data, 6)[0]))
                elif kind == 0x204:
                    put(col, _Strings([data[6:], *parts[1:]]).text())
                elif kind == 0x205:
                    put(col, data[6])
                elif kind == 0xBD:
                    for k in range((len(data) - 6) // 6):
                        put(col + k, _rk(struct.unpack_from("<I", data, 6 + 6 * k)[0]))
                elif data[12:14] != b"\xff\xff":
                    put(col, struct.unpack_from("<d", data, 6)[0])
                elif data[6] == 0:
                    waiting = (row, col)
                elif data[6] in (1, 2):
                    put(col, data[8])
            elif kind == 0x207 and waiting:
                cells[waiting[0]][waiting[1]] = _Strings(parts).text()
                waiting = None
        yield name, cells
