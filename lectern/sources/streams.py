"""Decoding of PDF streams, and rasters of embedded images as PNG files, with the standard library."""

from __future__ import annotations

import re
import struct
import zlib

#: Bytes that one stream may grow to; a file that needs more is an error of its own.
MOST = 512 << 20


class TooLarge(ValueError):
    """A stream that inflates beyond the bound."""


def inflate(body: bytes, most: int = MOST) -> bytes:
    """Inflated bytes; what follows damage is left out, and a stream that grows beyond the bound is refused."""
    d, out, size = zlib.decompressobj(), [], 0
    while body:
        try:
            got = d.decompress(body, 1 << 24)
        except zlib.error:
            if not out:
                raise
            break
        out.append(got)
        size += len(got)
        if size > most:
            raise TooLarge(f"a stream of more than {most} bytes")
        body = d.unconsumed_tail
        if d.eof or not got and not body:
            break
    return b"".join(out)


def lzw(body: bytes, early: int = 1, most: int = MOST) -> bytes:
    out, size = [], 0
    table: list[bytes] = []
    width, bits, held, last = 9, 0, 0, None
    for byte in body:
        held, bits = held << 8 | byte, bits + 8
        while bits >= width:
            code = held >> bits - width & (1 << width) - 1
            bits -= width
            held &= (1 << bits) - 1
            if code == 257:
                return b"".join(out)
            if code == 256:
                table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, None
                continue
            if not table:
                table = [bytes([i]) for i in range(256)] + [b"", b""]
            if code < len(table):
                entry = table[code]
            elif last is not None:
                entry = last + last[:1]
            else:
                return b"".join(out)
            out.append(entry)
            size += len(entry)
            if size > most:
                raise TooLarge(f"a stream of more than {most} bytes")
            if last is not None and len(table) < 4096:
                table.append(last + entry[:1])
            last = entry
            width = min(12, max(9, (len(table) + early).bit_length()))
    return b"".join(out)


def ascii85(body: bytes) -> bytes:
    body = re.sub(rb"\s+", b"", body).partition(b"~>")[0]
    out, group = bytearray(), []
    for c in body:
        if c == 0x7A and not group:
            out += b"\0\0\0\0"
        elif 0x21 <= c <= 0x75:
            group.append(c - 0x21)
            if len(group) == 5:
                n = 0
                for x in group:
                    n = n * 85 + x
                out += (n & 0xFFFFFFFF).to_bytes(4)
                group = []
    if len(group) > 1:
        n = 0
        for x in group + [84] * (5 - len(group)):
            n = n * 85 + x
        out += (n & 0xFFFFFFFF).to_bytes(4)[: len(group) - 1]
    return bytes(out)


def ascii_hex(body: bytes) -> bytes:
    digits = re.sub(rb"[^0-9A-Fa-f]", b"", body.partition(b">")[0])
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


def run_length(body: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(body) and body[i] != 128:
        n = body[i]
        if n < 128:
            out += body[i + 1 : i + 2 + n]
            i += 2 + n
        else:
            out += body[i + 1 : i + 2] * (257 - n)
            i += 2
    return bytes(out)


def unpredict(body: bytes, predictor: int, colors: int, bits: int, columns: int) -> bytes:
    """Rows as they were before a predictor was applied."""
    if predictor < 2:
        return body
    row, step = -(-columns * colors * bits // 8), max(1, colors * bits // 8)
    out = bytearray()
    if predictor == 2:
        for at in range(0, len(body), row):
            line = bytearray(body[at : at + row])
            if bits == 8:
                for i in range(step, len(line)):
                    line[i] = line[i] + line[i - step] & 255
            out += line
        return bytes(out)
    before = bytearray(row)
    for at in range(0, len(body), row + 1):
        kind, line = body[at], bytearray(body[at + 1 : at + 1 + row].ljust(row, b"\0"))
        if kind == 1:
            for i in range(step, row):
                line[i] = line[i] + line[i - step] & 255
        elif kind == 2:
            line = bytearray(a + b & 255 for a, b in zip(line, before))
        elif kind == 3:
            for i in range(row):
                line[i] = line[i] + ((line[i - step] if i >= step else 0) + before[i] >> 1) & 255
        elif kind == 4:
            for i in range(row):
                a, b, c = line[i - step] if i >= step else 0, before[i], before[i - step] if i >= step else 0
                guess = a + b - c
                pa, pb, pc = abs(guess - a), abs(guess - b), abs(guess - c)
                line[i] = line[i] + (a if pa <= pb and pa <= pc else b if pb <= pc else c) & 255
        out += line
        before = line
    return bytes(out)


def png(width: int, height: int, bits: int, kind: int, data: bytes, palette: bytes = b"") -> bytes:
    """A PNG file of packed rows; kind: 0 gray, 2 RGB, 3 palette."""
    row = -(-width * bits * (3 if kind == 2 else 1) // 8)
    data = data[: row * height].ljust(row * height, b"\0")
    rows = b"".join(b"\0" + data[i : i + row] for i in range(0, len(data), row))
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    out = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, bits, kind, 0, 0, 0))
    return out + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def raster_png(width: int, height: int, bits: int, colors: int, data: bytes, palette: bytes | None = None, invert: bool = False) -> bytes | None:
    """A PNG file of a decoded image with 1 (gray or palette), 3 or 4 (CMYK) colours; None if it can't be made."""
    if width <= 0 or height <= 0 or bits not in (1, 2, 4, 8, 16) or width * height > MOST:
        return None
    if bits == 16:
        data, bits = data[::2], 8
    if invert:
        data = bytes(255 - x for x in data)
    if palette is not None:
        return png(width, height, bits, 3, data, palette[:768]) if bits <= 8 and colors == 1 else None
    if colors == 1:
        return png(width, height, bits, 0, data)
    if bits != 8:
        return None
    if colors == 4:
        rgb = bytearray(3 * (len(data) // 4))
        black = bytes(255 - x for x in data[3::4])
        for k in range(3):
            rgb[k::3] = bytes((255 - x) * y // 255 for x, y in zip(data[k::4], black))
        data, colors = bytes(rgb), 3
    return png(width, height, bits, 2, data) if colors == 3 else None
