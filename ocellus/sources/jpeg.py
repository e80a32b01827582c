"""JPEG pictures (baseline, extended and progressive Huffman, 8 bits a sample) to rows of pixels.

The entropy-coded part is read symbol by symbol into one flat array of coefficients a component; everything after that,
dequantisation, inverse transform, chroma interpolation and colour, is numpy over all blocks at once.
"""

from __future__ import annotations

from array import array
from dataclasses import dataclass, field

import numpy as np

MOST_PIXELS = 1 << 27
#: Place in the block (row * 8 + column) of each coefficient of a scan: anti-diagonals, every other one upwards.
ORDER = [y * 8 + x for d in range(15) for y, x in ((d - k, k) if d % 2 == 0 else (k, d - k) for k in range(d + 1)) if y < 8 and x < 8]
#: Basis of the transform: value at sample x of frequency u.
BASIS = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(1 / 8) if u == 0 else 0.5) for x in range(8)] for u in range(8)])


@dataclass
class Component:
    ident: int
    h: int
    v: int
    table: int
    wide: int = 0  # samples and blocks of the component itself, and blocks a line with those that fill up the last unit
    high: int = 0
    across: int = 0
    down: int = 0
    stride: int = 0
    blocks: array = field(default_factory=lambda: array("i"))
    last: int = 0


def _huffman(body: bytes) -> dict[int, list[int]]:
    """Tables of a DHT segment by class * 16 + number: for every 16 bits length * 256 + symbol, 0 where there is no code."""
    out, at = {}, 0
    while at < len(body):
        counts = body[at + 1 : at + 17]
        symbols, code, table = body[at + 17 : at + 17 + sum(counts)], 0, [0] * 65_536
        given = iter(symbols)
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                low, high = code << (16 - length), (code + 1) << (16 - length)
                if high > 65_536:
                    raise ValueError("damaged Huffman table")
                table[low:high] = [length << 8 | next(given, 0)] * (high - low)
                code += 1
            code <<= 1
        out[body[at]] = table
        at += 17 + sum(counts)
    return out


class Bits:
    """Bits of one interval of entropy-coded data, without its stuffing."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data + b"\0\0\0\0\0\0", 0, 8 * len(data)

    def symbol(self, table: list[int]) -> int:
        at = self.at
        if at >= self.end:
            raise ValueError("the picture ends early")
        got = table[int.from_bytes(self.data[at >> 3 : (at >> 3) + 3]) >> 8 - (at & 7) & 0xFFFF]
        if not got:
            raise ValueError("damaged code")
        self.at = at + (got >> 8)
        return got & 255

    def take(self, n: int) -> int:
        at = self.at
        self.at = at + n
        return int.from_bytes(self.data[at >> 3 : (at >> 3) + 4]) >> 32 - (at & 7) - n & (1 << n) - 1

    def signed(self, n: int) -> int:
        if n == 0:
            return 0
        value = self.take(n)
        return value if value >> n - 1 else value - (1 << n) + 1


def _sequential(bits: Bits, c: Component, at: int, dc: list[int], ac: list[int]) -> None:
    c.last += bits.signed(bits.symbol(dc))
    c.blocks[at] = c.last
    k = 1
    while k < 64:
        symbol = bits.symbol(ac)
        run, size = symbol >> 4, symbol & 15
        if size == 0:
            if run < 15:
                return
            k += 16
            continue
        k += run
        if k > 63:
            raise ValueError("damaged block")
        c.blocks[at + ORDER[k]] = bits.signed(size)
        k += 1


def _first(bits: Bits, c: Component, at: int, ac: list[int], band: range, low: int, skip: int) -> int:
    """First pass over a band of a block; returns for how many more blocks the band is empty."""
    if skip:
        return skip - 1
    k = band.start
    while k < band.stop:
        symbol = bits.symbol(ac)
        run, size = symbol >> 4, symbol & 15
        if size == 0:
            if run < 15:
                return (1 << run) + bits.take(run) - 1
            k += 16
            continue
        k += run
        if k > 63:
            raise ValueError("damaged block")
        c.blocks[at + ORDER[k]] = bits.signed(size) * (1 << low)
        k += 1
    return 0


def _refined(bits: Bits, c: Component, at: int, ac: list[int], band: range, low: int, skip: int) -> int:
    """A further bit of a band: known coefficients get a bit each as they are passed, new ones come by run."""
    blocks, bit, k = c.blocks, 1 << low, band.start

    def correct(place: int) -> None:
        old = blocks[place]
        if bits.take(1) and not abs(old) & bit:
            blocks[place] = old + bit if old > 0 else old - bit

    if skip == 0:
        while k < band.stop:
            symbol = bits.symbol(ac)
            run, size = symbol >> 4, symbol & 15
            new = 0
            if size:
                new = bit if bits.take(1) else -bit
            elif run < 15:
                skip = (1 << run) + bits.take(run)
                break
            while k < band.stop:
                place = at + ORDER[k]
                k += 1
                if blocks[place]:
                    correct(place)
                elif run == 0:
                    if new:
                        blocks[place] = new
                    break
                else:
                    run -= 1
    if skip:
        for j in range(k, band.stop):
            if blocks[at + ORDER[j]]:
                correct(at + ORDER[j])
        skip -= 1
    return skip


def _scan(parts: list[bytes], chosen: list[tuple[Component, int, int]], tables: dict[int, list[int]], progressive: bool, band: range, high: int, low: int, interval: int, units: tuple[int, int]) -> None:
    """Decode one scan; `parts` are its restart intervals."""
    alone = len(chosen) == 1
    c = chosen[0][0]
    across, down = (c.across, c.down) if alone else units
    each = interval or across * down
    if len(parts) < -(-across * down // each):
        raise ValueError("the picture ends early")
    for number in range(-(-across * down // each)):
        bits, skip = Bits(parts[number]), 0
        for c, _, _ in chosen:
            c.last = 0
        for unit in range(number * each, min(across * down, (number + 1) * each)):
            y, x = divmod(unit, across)
            for c, dc, ac in chosen:
                for i in range(1 if alone else c.v):
                    for j in range(1 if alone else c.h):
                        at = 64 * ((y if alone else y * c.v + i) * c.stride + (x if alone else x * c.h + j))
                        if not progressive:
                            _sequential(bits, c, at, tables[dc], tables[16 + ac])
                        elif band.start == 0:
                            if high:
                                c.blocks[at] |= bits.take(1) << low
                            else:
                                c.last += bits.signed(bits.symbol(tables[dc]))
                                c.blocks[at] = c.last * (1 << low)
                        else:
                            skip = (_refined if high else _first)(bits, c, at, tables[16 + ac], band, low, skip)


def _wider(x: np.ndarray, first: int, second: int, shift: int) -> np.ndarray:
    """Twice as many columns: three quarters of the nearer sample and one of the next, `first` and `second` being what the
    even and odd columns are rounded with."""
    before, after = np.c_[x[:, :1], x[:, :-1]], np.c_[x[:, 1:], x[:, -1:]]
    return np.stack([3 * x + before + first >> shift, 3 * x + after + second >> shift], axis=2).reshape(x.shape[0], -1)


def _full(x: np.ndarray, fx: int, fy: int) -> np.ndarray:
    """Samples of a component brought to the picture's grid: between samples by halves, else repeated."""
    x = x.astype(np.int32)
    if (fx, fy) == (2, 2) and x.shape[1] > 2:
        up, down = np.r_[x[:1], x[:-1]], np.r_[x[1:], x[-1:]]
        sums = np.stack([3 * x + up, 3 * x + down], axis=1).reshape(-1, x.shape[1])
        return _wider(sums, 8, 7, 4)
    if (fx, fy) == (2, 1) and x.shape[1] > 2:
        return _wider(x, 1, 2, 2)
    if (fx, fy) == (1, 2):
        return _wider(x.T, 1, 2, 2).T
    return np.repeat(np.repeat(x, fy, axis=0), fx, axis=1)


def _samples(c: Component, quant: np.ndarray) -> np.ndarray:
    blocks = np.frombuffer(c.blocks, np.int32).reshape(-1, c.stride, 8, 8) * quant
    lines = np.einsum("abuv,ux,vy->axby", blocks.astype(np.float64), BASIS, BASIS, optimize=True)
    return np.clip(np.rint(lines.reshape(lines.shape[0] * 8, -1) + 128), 0, 255).astype(np.uint8)[: c.high, : c.wide]


def _coloured(planes: list[np.ndarray], transform: bool, inverted: bool) -> np.ndarray:
    if len(planes) == 1:
        return planes[0][:, :, None].astype(np.uint8)
    if transform:
        y, cb, cr = (p.astype(np.float64) - off for p, off in zip(planes[:3], (0, 128, 128), strict=True))
        planes[:3] = [np.clip(np.rint(v), 0, 255) for v in (y + 1.402 * cr, y - 0.344136286 * cb - 0.714136286 * cr, y + 1.772 * cb)]
    out = np.stack(planes, axis=2)
    if len(planes) == 4:  # cyan, magenta, yellow and black, stored from 255 down by the programs that mark it
        ink = out.astype(np.int32) if inverted else 255 - out.astype(np.int32)
        out = ink[:, :, :3] * ink[:, :, 3:] // 255
    return out.astype(np.uint8)


def decode_jpeg(data: bytes) -> tuple[np.ndarray, bytes]:
    """Rows (height, width, 1 or 3) as stored, and the EXIF block (empty if none)."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at, quant, tables, parts, exif = 2, {}, {}, [], b""
    interval, adobe, progressive, seen = 0, None, False, False
    units = most = (0, 0)
    width = height = 0
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("a marker is missing")
        kind = data[at + 1]
        if kind == 0xFF or 0xD0 <= kind <= 0xD7:
            at += 1 if kind == 0xFF else 2
            continue
        if kind == 0xD9:
            break
        size = int.from_bytes(data[at + 2 : at + 4])
        body = data[at + 4 : at + 2 + size]
        if size < 2 or len(body) != size - 2:
            raise ValueError("the picture ends early")
        at += 2 + size
        if kind == 0xDB:
            while body:
                n = 128 if body[0] >> 4 else 64
                values = np.frombuffer(body[1 : 1 + n], ">u2" if n == 128 else np.uint8).astype(np.int32)
                if values.size != 64:
                    raise ValueError("damaged quantisation table")
                quant[body[0] & 15] = np.zeros(64, np.int32)
                quant[body[0] & 15][ORDER] = values
                body = body[1 + n :]
        elif kind == 0xC4:
            tables |= _huffman(body)
        elif kind == 0xDD:
            interval = int.from_bytes(body[:2])
        elif kind == 0xE1 and body[:6] == b"Exif\0\0":
            exif = exif or body[6:]
        elif kind == 0xEE and body[:5] == b"Adobe" and len(body) >= 12:
            adobe = body[11]
        elif kind in (0xC0, 0xC1, 0xC2):
            if parts:
                raise ValueError("more than one frame")
            height, width, n = int.from_bytes(body[1:3]), int.from_bytes(body[3:5]), body[5]
            if body[0] != 8 or n not in (1, 3, 4) or not 0 < width * height <= MOST_PIXELS or len(body) < 6 + 3 * n:
                raise ValueError("unsupported JPEG form")
            progressive = kind == 0xC2
            parts = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            if any(not 1 <= x <= 4 for c in parts for x in (c.h, c.v)):
                raise ValueError("unsupported JPEG form")
            most = max(c.h for c in parts), max(c.v for c in parts)
            units = -(-width // (8 * most[0])), -(-height // (8 * most[1]))
            for c in parts:
                c.wide, c.high = -(-width * c.h // most[0]), -(-height * c.v // most[1])
                c.across, c.down, c.stride = -(-c.wide // 8), -(-c.high // 8), units[0] * c.h
                c.blocks = array("i", bytes(4 * 64 * c.stride * units[1] * c.v))
        elif 0xC3 <= kind <= 0xCF and kind != 0xC8:
            raise ValueError("unsupported JPEG form")
        elif kind == 0xDA:
            n = body[0]
            by = {c.ident: c for c in parts}
            chosen = [(by[body[1 + 2 * i]], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(n) if body[1 + 2 * i] in by]
            if len(chosen) != n or not n:
                raise ValueError("a scan names an unknown component")
            start, stop, step = body[1 + 2 * n : 4 + 2 * n]
            coded, at = _intervals(data, at)
            try:
                _scan(coded, chosen, tables, progressive, range(start, stop + 1), step >> 4, step & 15, interval, units)
            except (KeyError, IndexError) as e:
                raise ValueError("damaged scan") from e
            seen = True
    if not seen or any(c.table not in quant for c in parts):
        raise ValueError("the picture ends early")
    planes = [_full(_samples(c, quant[c.table].reshape(8, 8)), most[0] // c.h, most[1] // c.v)[:height, :width] for c in parts]
    if any(p.shape != (height, width) for p in planes):
        raise ValueError("unsupported JPEG form")
    letters = bytes(c.ident for c in parts) == b"RGB"
    transform = len(parts) > 1 and (adobe != 0 if adobe is not None else len(parts) == 3 and not letters)
    return _coloured(planes, transform, adobe is not None), exif


def _intervals(data: bytes, at: int) -> tuple[list[bytes], int]:
    """The restart intervals of the entropy-coded data that begins at `at`, unstuffed, and where the next marker is."""
    out, start = [], at
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            raise ValueError("the picture ends early")
        kind = data[at + 1]
        if kind == 0:
            at += 2
        elif kind == 0xFF:
            at += 1
        else:
            out.append(data[start:at].replace(b"\xff\0", b"\xff"))
            if not 0xD0 <= kind <= 0xD7:
                return out, at
            at += 2
            start = at
