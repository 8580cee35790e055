"""ZIP archives whose members are stored as they are: writing in one pass, reading by ranges.

The reader parses the end record, its ZIP64 locator and end record where a field is full, and the
central directory; a member's bytes are then found through its local header and read by offset and
length. Nothing is extracted. Files are opened by URI through Arrow's file systems, so an archive may
lie on any store that Arrow reads.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

from pyarrow import fs

FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
#: Signatures of the ZIP records.
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


class StoredZipWriter:
    """Writes stored members one after another; a member's bytes may come in pieces, its size is not known before.

    Sizes and checksums follow each member in a data descriptor. ``zip64`` forces the long forms, which
    are otherwise used where a number needs them.
    """

    def __init__(self, sink, zip64: bool = False):
        self.sink, self.at, self.zip64, self.members, self.now = sink, 0, zip64, [], None

    def _put(self, b: bytes) -> None:
        self.sink.write(b)
        self.at += len(b)

    def start(self, name: str) -> None:
        self.finish()
        raw = name.encode()
        self.now = [raw, self.at, 0, 0]
        # The descriptor has eight-byte sizes: the local header says so with an empty ZIP64 field.
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self._put(struct.pack("<4s5H3I2H", LOCAL, 45, 0x0808, 0, 0, 33, 0, FULL32, FULL32, len(raw), len(extra)) + raw + extra)

    def write(self, b: bytes) -> int:
        """Append to the open member; returns the offset within it."""
        at = self.now[2]
        self.now[3] = zlib.crc32(b, self.now[3])
        self.now[2] += len(b)
        self._put(b)
        return at

    def finish(self) -> None:
        if self.now:
            raw, offset, size, crc = self.now
            self._put(struct.pack("<4sIQQ", b"PK\x07\x08", crc, size, size))
            self.members.append((raw, offset, size, crc))
            self.now = None

    def close(self) -> None:
        self.finish()
        start = self.at
        for raw, offset, size, crc in self.members:
            long = self.zip64 or size >= FULL32 or offset >= FULL32
            extra = struct.pack("<HHQQQ", 1, 24, size, size, offset) if long else b""
            s, o = (FULL32, FULL32) if long else (size, offset)
            self._put(struct.pack("<4s6H3I5H2I", CENTRAL, 45, 45, 0x0808, 0, 0, 33, crc, s, s, len(raw), len(extra), 0, 0, 0, 0, o) + raw + extra)
        size, n = self.at - start, len(self.members)
        if self.zip64 or size >= FULL32 or start >= FULL32 or n >= FULL16:
            end = self.at
            self._put(struct.pack("<4sQ2H2I4Q", END64, 44, 45, 45, 0, 0, n, n, size, start))
            self._put(struct.pack("<4sIQI", LOCATOR64, 0, end, 1))
            n, size, start = FULL16, FULL32, FULL32
        self._put(struct.pack("<4s4H2IH", END, 0, 0, n, n, size, start, 0))


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    header: int


class StoredZipReader:
    """Directory of an archive and range reads of its stored members. ``source`` has seek, read, size."""

    def __init__(self, source):
        self.source = source
        self.members = {m.name: m for m in self._directory()}
        self._starts: dict[str, int] = {}

    def _at(self, offset: int, n: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(n)

    def _directory(self) -> list[Member]:
        length = self.source.size()
        tail_at = max(0, length - 22 - FULL16)
        tail = self._at(tail_at, length - tail_at)
        i = tail.rfind(END)
        while i >= 0 and (i + 22 > len(tail) or i + 22 + struct.unpack_from("<H", tail, i + 20)[0] != len(tail)):
            i = tail.rfind(END, 0, i)
        if i < 0:
            raise ValueError("no end record: not a ZIP archive")
        n, size, start = struct.unpack_from("<H2I", tail, i + 10)
        if FULL16 == n or FULL32 in (size, start):
            sig, _, end64, _ = struct.unpack("<4sIQI", self._at(tail_at + i - 20, 20))
            if sig == LOCATOR64:
                record = self._at(end64, 56)
                if record[:4] != END64:
                    raise ValueError("the ZIP64 end record is not where its locator says")
                n, size, start = struct.unpack_from("<3Q", record, 32)
        raw, found, at = self._at(start, size), [], 0
        for _ in range(n):
            sig, method, _, csize, usize, ln, lx, lc, header = struct.unpack_from("<4s6xH4xI2I3H8xI", raw, at)
            if sig != CENTRAL:
                raise ValueError("the central directory is cut short")
            name = raw[at + 46 : at + 46 + ln].decode("utf-8", "replace")
            extra = raw[at + 46 + ln : at + 46 + ln + lx]
            usize, csize, header = self._long(extra, usize, csize, header)
            found.append(Member(name, method, csize, header))
            at += 46 + ln + lx + lc
        return found

    @staticmethod
    def _long(extra: bytes, usize: int, csize: int, header: int) -> tuple[int, int, int]:
        i = 0
        while i + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, i)
            if kind == 1:
                values = list(struct.unpack_from(f"<{n // 8}Q", extra, i + 4))
                usize = values.pop(0) if usize == FULL32 else usize
                csize = values.pop(0) if csize == FULL32 else csize
                header = values.pop(0) if header == FULL32 else header
            i += 4 + n
        return usize, csize, header

    def read(self, name: str, offset: int = 0, n: int | None = None) -> bytes:
        """``n`` bytes of a stored member from ``offset``; all of it by default."""
        m = self.members[name]
        if m.method:
            raise ValueError(f"{name} is compressed; only stored members can be read by ranges")
        if name not in self._starts:
            sig, ln, lx = struct.unpack("<4s22x2H", self._at(m.header, 30))
            if sig != LOCAL:
                raise ValueError(f"{name} has no local header")
            self._starts[name] = m.header + 30 + ln + lx
        n = m.size - offset if n is None else min(n, m.size - offset)
        return self._at(self._starts[name] + offset, max(0, n))
