"""Chunks of a byte stream, plain or gzip, that is read once, forward.

A gzip stream that this library writes is a chain of members, each of which says
in its header how long it is and which value it begins with. Any gzip reader
takes the chain as one stream; here the members are read by as many tasks.
"""

from __future__ import annotations

import gzip
import io
import os
import struct
import zlib
from collections.abc import Iterator

#: Bytes in memory at once.
CHUNK = 64 << 20


def open_stream(path: str):
    """A plain or gzip file as a stream of its plain bytes."""
    with open(path, "rb") as f:
        packed = f.read(2) == b"\x1f\x8b"
    return gzip.open(path, "rb") if packed else open(path, "rb")


def open_bytes(content: bytes):
    """The same for a file that is in memory."""
    stream = io.BytesIO(content)
    return gzip.GzipFile(fileobj=stream) if content[:2] == b"\x1f\x8b" else stream


def is_seekable(path: str) -> bool:
    with open(path, "rb") as f:
        return f.read(2) != b"\x1f\x8b"


def skip(stream, n: int) -> None:
    """Go on by n bytes: read and discard where the stream can't seek."""
    if not isinstance(stream, gzip.GzipFile) and stream.seekable():
        stream.seek(n, 1)
        return
    while n:
        got = len(stream.read(min(n, CHUNK)))
        if not got:
            raise EOFError("the stream ends before the data")
        n -= got


def chunks(stream, n: int, size: int, item: int = 1) -> Iterator[bytes]:
    """n bytes in chunks of up to ``size``, cut at whole items; fails on a short stream."""
    size = max(item, min(size, CHUNK) // item * item)
    while n:
        want = min(n, size)
        got = stream.read(want)
        if len(got) < want:
            raise EOFError("the stream ends before the data")
        yield got
        n -= want


_HEAD = struct.Struct("<4sIBBH2sHqq")  # magic and flags, time, level, system, length of extra, name and length of the field, bytes of the member, first value
_MAGIC, _NAME = b"\x1f\x8b\x08\x04", b"GL"


def member(raw: bytes, first: int, level: int = 6) -> bytes:
    """A gzip member of some plain bytes that begin with value ``first``; -n: n bytes that come before the values."""
    pack = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = pack.compress(raw) + pack.flush()
    head = _HEAD.pack(_MAGIC, 0, 0, 255, 20, _NAME, 16, _HEAD.size + len(body) + 8, first)
    return head + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


def members(path: str) -> list[tuple[int, int]] | None:
    """(first value, byte) of each member, from the headers alone; None where any member does not tell."""
    out, at, end = [], 0, os.path.getsize(path)
    with open(path, "rb") as f:
        while at < end:
            f.seek(at)
            head = f.read(_HEAD.size)
            if len(head) < _HEAD.size:
                return None
            magic, _, _, _, extra, name, length, size, first = _HEAD.unpack(head)
            if (magic, extra, name, length) != (_MAGIC, 20, _NAME, 16) or size < _HEAD.size:
                return None
            out.append((first, at))
            at += size
    return out if at == end else None


class MemberStream(io.RawIOBase):
    """The plain bytes of the one member that begins at some byte of a file."""

    def __init__(self, path: str, at: int):
        self.file = open(path, "rb")  # noqa: SIM115
        self.file.seek(at)
        self.unpack = zlib.decompressobj(31)

    def read(self, n: int = -1) -> bytes:
        out = []
        while n and not self.unpack.eof:
            got = self.unpack.unconsumed_tail or self.file.read(1 << 20)
            if not got:
                raise EOFError("the stream ends before the data")
            made = self.unpack.decompress(got, max(0, n))
            out.append(made)
            n -= len(made)
        return b"".join(out)

    def seekable(self) -> bool:
        return False

    def close(self) -> None:
        self.file.close()
        super().close()
