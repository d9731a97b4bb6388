"""Compound binary files (CFB) and the text of legacy word-processor documents in them."""

from __future__ import annotations

import re
import struct

from quillgrid.session import ParseError

_END = 0xFFFFFFFA


class Compound:
    """Streams of a compound file by path-less name."""

    def __init__(self, data: bytes):
        if len(data) < 512 or data[:8] != b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1":
            raise ParseError("no compound file")
        self.data = data
        self.size, self.mini_size = 1 << struct.unpack_from("<H", data, 30)[0], 1 << struct.unpack_from("<H", data, 32)[0]
        n_fat, first_dir, _, self.cutoff, first_mini, _, next_difat, n_difat = struct.unpack_from("<IIIIIIII", data, 44)
        sectors = [s for s in struct.unpack_from("<109I", data, 76) if s < _END]
        while next_difat < _END and n_difat > 0:
            block = struct.unpack_from(f"<{self.size // 4}I", data, (next_difat + 1) * self.size)
            sectors += [s for s in block[:-1] if s < _END]
            next_difat, n_difat = block[-1], n_difat - 1
        self.fat: list[int] = []
        for s in sectors[:n_fat]:
            self.fat += struct.unpack_from(f"<{self.size // 4}I", data, (s + 1) * self.size)
        self.entries: dict[str, tuple[int, int]] = {}
        folder = self._chain(first_dir)
        root = (0, 0)
        for at in range(0, len(folder) - 127, 128):
            length, kind = struct.unpack_from("<HB", folder, at + 64)
            if kind in (2, 5) and 2 <= length <= 64:
                name = folder[at : at + length - 2].decode("utf-16-le", "replace")
                start, size = struct.unpack_from("<I", folder, at + 116)[0], struct.unpack_from("<I", folder, at + 120)[0]
                if kind == 5:
                    root = (start, size)
                else:
                    self.entries[name] = (start, size)
        self.mini = self._chain(root[0])[: root[1]] if root[1] else b""
        raw = self._chain(first_mini) if first_mini < _END else b""
        self.mini_fat = list(struct.unpack(f"<{len(raw) // 4}I", raw[: len(raw) // 4 * 4]))

    def _chain(self, sector: int) -> bytes:
        out, seen = [], 0
        while sector < _END and seen <= len(self.fat):
            out.append(self.data[(sector + 1) * self.size : (sector + 2) * self.size])
            if sector >= len(self.fat):
                break
            sector, seen = self.fat[sector], seen + 1
        return b"".join(out)

    def stream(self, name: str) -> bytes:
        if name not in self.entries:
            raise ParseError(f"no stream {name}")
        start, size = self.entries[name]
        if size >= self.cutoff:
            return self._chain(start)[:size]
        out, seen = [], 0
        while start < _END and seen <= len(self.mini_fat):
            out.append(self.mini[start * self.mini_size : (start + 1) * self.mini_size])
            if start >= len(self.mini_fat):
                break
            start, seen = self.mini_fat[start], seen + 1
        return b"".join(out)[:size]


def clean_text(text: str) -> str:
    """Text without field codes and control characters; cell and page marks become breaks, blank runs one."""
    text = re.sub("\x13[^\x14\x15]*\x14?", "", text).replace("\x15", "")
    text = text.replace("\x07", "\t").replace("\r", "\n\n").replace("\x0b", "\n").replace("\x0c", "\n\n").replace("\xa0", " ")
    text = re.sub("[\x00-\x08\x0e-\x1f]", "", text)
    return re.sub("\n{3,}", "\n\n", text).strip()


def doc_text(data: bytes) -> str:
    """Text of a legacy document by its piece table."""
    file = Compound(data)
    main = file.stream("WordDocument")
    flags = struct.unpack_from("<H", main, 10)[0]
    table = file.stream("1Table" if flags & 0x0200 else "0Table")
    at, size = struct.unpack_from("<II", main, 0x01A2)
    clx, k = table[at : at + size], 0
    while k < len(clx) and clx[k] == 1:
        k += 3 + struct.unpack_from("<H", clx, k + 1)[0]
    if k >= len(clx) or clx[k] != 2:
        raise ParseError("no piece table")
    length = struct.unpack_from("<I", clx, k + 1)[0]
    plc = clx[k + 5 : k + 5 + length]
    n = (len(plc) - 4) // 12
    ends = struct.unpack_from(f"<{n + 1}I", plc, 0)
    out = []
    for i in range(n):
        where = struct.unpack_from("<I", plc, 4 * (n + 1) + 8 * i + 2)[0]
        count = ends[i + 1] - ends[i]
        if where & 0x40000000:
            start = (where & 0x3FFFFFFF) // 2
            out.append(main[start : start + count].decode("cp1252", "replace"))
        else:
            out.append(main[where : where + 2 * count].decode("utf-16-le", "replace"))
    return clean_text("".join(out))
