"""A ZIP directory reader over ranges: end record, ZIP64 records, central directory.

``read(offset, length)`` is all that it needs of a file, so an archive is never
fetched whole and never extracted. Only members stored without compression can
be read by range.
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from dataclasses import dataclass

Read = Callable[[int, int], bytes]
END, END64, LOCATOR64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF


class BadArchive(ValueError):
    pass


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    packed: int
    size: int
    header: int

    @property
    def stored(self) -> bool:
        return self.method == 0 and self.packed == self.size


def _directory_place(read: Read, size: int) -> tuple[int, int, int]:
    """Entries, bytes and offset of the central directory."""
    tail_at = max(0, size - 22 - FULL16)
    tail = read(tail_at, size - tail_at)
    at = len(tail)
    while True:
        at = tail.rfind(END, 0, at)
        if at < 0:
            raise BadArchive("no end of central directory")
        if at + 22 <= len(tail) and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail):
            break
    entries, length, offset = struct.unpack_from("<HII", tail, at + 10)
    if FULL16 in (entries,) or FULL32 in (length, offset):
        place = tail_at + at - 20
        locator = read(place, 20) if place >= 0 else b""
        if locator[:4] != LOCATOR64:
            raise BadArchive("no ZIP64 locator")
        record = read(struct.unpack_from("<Q", locator, 8)[0], 56)
        if record[:4] != END64:
            raise BadArchive("no ZIP64 end of central directory")
        entries, length, offset = struct.unpack_from("<QQQ", record, 32)
    return entries, length, offset


def members(read: Read, size: int) -> dict[str, Member]:
    """The members of an archive of ``size`` bytes, by name."""
    entries, length, offset = _directory_place(read, size)
    data, at, found = read(offset, length), 0, {}
    for _ in range(entries):
        if data[at : at + 4] != ENTRY:
            raise BadArchive("no entry of the central directory")
        flags, method, packed, full, n_name, n_extra, n_comment, header = struct.unpack_from("<8xHH8xIIHHH8xI", data, at)
        name = data[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra = data[at + 46 + n_name : at + 46 + n_name + n_extra]
        if FULL32 in (packed, full, header):
            full, packed, header = _wide(extra, full, packed, header)
        found[name] = Member(name, method, packed, full, header)
        at += 46 + n_name + n_extra + n_comment
    return found


def _wide(extra: bytes, *values: int) -> list[int]:
    """Values that are full are in the ZIP64 extra field, in this order."""
    at = 0
    while at + 4 <= len(extra):
        kind, length = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            out, place = [], at + 4
            for v in values:
                if v == FULL32:
                    (v,) = struct.unpack_from("<Q", extra, place)
                    place += 8
                out.append(v)
            return out
        at += 4 + length
    raise BadArchive("no ZIP64 sizes")


def data_offset(read: Read, member: Member) -> int:
    """Where the member's bytes start."""
    head = read(member.header, 30)
    if head[:4] != LOCAL:
        raise BadArchive("no local header")
    return member.header + 30 + sum(struct.unpack_from("<HH", head, 26))
