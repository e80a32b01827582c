"""A JPEG writer for tests: quantised coefficients in, baseline or progressive bytes out."""

import math

import numpy as np

ZIGZAG = sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8))
BASIS = np.array([[math.cos((2 * x + 1) * u * math.pi / 16) * (math.sqrt(0.125) if u == 0 else 0.5) for x in range(8)] for u in range(8)])


class Bits:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> i & 1 for i in range(n - 1, -1, -1)]

    def symbol(self, s):  # one bit for symbol 0, nine for the others
        self.put(0, 1) if s == 0 else self.put(0x100 + s - 1, 9)

    def number(self, v):
        n = abs(v).bit_length()
        self.put(v if v > 0 else v + (1 << n) - 1, n)

    def done(self):
        self.bits += [1] * (-len(self.bits) % 8)
        return bytes(int("".join(map(str, self.bits[i : i + 8])), 2) for i in range(0, len(self.bits), 8)).replace(b"\xff", b"\xff\0")


def segment(kind, body):
    return bytes([0xFF, kind]) + (len(body) + 2).to_bytes(2) + body


def sequential(w, block, last):
    diff = int(block[0]) - last
    w.symbol(abs(diff).bit_length())
    w.number(diff)
    run = 0
    end = max((k for k in range(1, 64) if block[ZIGZAG[k]]), default=0)
    for k in range(1, end + 1):
        v = int(block[ZIGZAG[k]])
        if v == 0:
            run += 1
            continue
        while run > 15:
            w.symbol(0xF0)
            run -= 16
        w.symbol(run << 4 | abs(v).bit_length())
        w.number(v)
        run = 0
    if end < 63:
        w.symbol(0)
    return int(block[0])


class Bands:
    """AC scans of a progressive picture, with runs of empty bands across blocks."""

    def __init__(self, w):
        self.w, self.run, self.held = w, 0, []

    def flush(self):
        if self.run:
            n = self.run.bit_length() - 1
            self.w.symbol(n << 4)
            self.w.put(self.run - (1 << n), n)
            self.w.bits += self.held
        self.run, self.held = 0, []

    def first(self, block, lo, hi, low):
        run = 0
        for k in range(lo, hi + 1):
            v = int(block[ZIGZAG[k]])
            v = (abs(v) >> low) * (1 if v > 0 else -1)
            if v == 0:
                run += 1
                continue
            self.flush()
            while run > 15:
                self.w.symbol(0xF0)
                run -= 16
            self.w.symbol(run << 4 | abs(v).bit_length())
            self.w.number(v)
            run = 0
        self.run += run > 0

    def refine(self, block, lo, hi, low):
        level = {k: abs(int(block[ZIGZAG[k]])) >> low for k in range(lo, hi + 1)}
        end = max((k for k, t in level.items() if t == 1), default=0)
        run, bits = 0, []
        for k, t in level.items():
            if t == 0:
                run += 1
                continue
            while run > 15 and k <= end:
                self.flush()
                self.w.symbol(0xF0)
                self.w.bits += bits
                run, bits = run - 16, []
            if t > 1:
                bits.append(t & 1)
                continue
            self.flush()
            self.w.symbol(run << 4 | 1)
            self.w.put(int(block[ZIGZAG[k]] > 0), 1)
            self.w.bits += bits
            run, bits = 0, []
        if run or bits:
            self.run += 1
            self.held += bits


def write(planes, sampling, width, height, quant, progressive=False, restart=0, extra=b"", idents=(1, 2, 3, 4)):
    """planes: per component blocks (rows, columns, 64) that fill whole units."""
    most = max(h for h, _ in sampling), max(v for _, v in sampling)
    units = -(-width // (8 * most[0])), -(-height // (8 * most[1]))
    n = len(planes)
    out = b"\xff\xd8" + extra + segment(0xDB, b"\0" + bytes(int(quant[i]) for i in ZIGZAG))
    out += segment(0xC2 if progressive else 0xC0, b"\x08" + height.to_bytes(2) + width.to_bytes(2) + bytes([n]) + b"".join(bytes([i, h << 4 | v, 0]) for i, (h, v) in zip(idents, sampling, strict=False)))
    counts = bytes([1] + [0] * 7 + [254] + [0] * 7)
    out += b"".join(segment(0xC4, bytes([kind]) + counts + bytes(range(255))) for kind in (0, 16))
    if restart:
        out += segment(0xDD, restart.to_bytes(2))

    def scan(which, lo, hi, high, low, code):
        body = segment(0xDA, bytes([len(which)]) + b"".join(bytes([idents[i], 0]) for i in which) + bytes([lo, hi, high << 4 | low]))
        if len(which) > 1:
            places = [[(i, y * sampling[i][1] + b, x * sampling[i][0] + a) for i in which for b in range(sampling[i][1]) for a in range(sampling[i][0])] for y in range(units[1]) for x in range(units[0])]
        else:
            (i,) = which
            across, down = (-(-(-(-size * s // m)) // 8) for size, s, m in ((width, sampling[i][0], most[0]), (height, sampling[i][1], most[1])))
            places = [[(i, y, x)] for y in range(down) for x in range(across)]
        each, parts = restart or len(places), []
        for at in range(0, len(places), each):
            parts.append(code([b for unit in places[at : at + each] for b in unit]))
        return body + b"".join(p + (bytes([0xFF, 0xD0 + k % 8]) if k + 1 < len(parts) else b"") for k, p in enumerate(parts))

    def whole(blocks):
        w, last = Bits(), [0] * n
        for i, y, x in blocks:
            last[i] = sequential(w, planes[i][y, x], last[i])
        return w.done()

    def dc(low):
        def code(blocks):
            w, last = Bits(), [0] * n
            for i, y, x in blocks:
                v = int(planes[i][y, x][0]) >> low
                w.symbol(abs(v - last[i]).bit_length())
                w.number(v - last[i])
                last[i] = v
            return w.done()

        return code

    def dc_bit(blocks):
        w = Bits()
        for i, y, x in blocks:
            w.put(int(planes[i][y, x][0]) & 1, 1)
        return w.done()

    def ac(lo, hi, low, refine):
        def code(blocks):
            w = Bits()
            b = Bands(w)
            for i, y, x in blocks:
                (b.refine if refine else b.first)(planes[i][y, x], lo, hi, low)
            b.flush()
            return w.done()

        return code

    every = list(range(n))
    if not progressive:
        out += scan(every, 0, 63, 0, 0, whole)
    else:
        out += scan(every, 0, 0, 0, 1, dc(1))
        for i in every:
            out += scan([i], 1, 5, 0, 2, ac(1, 5, 2, False)) + scan([i], 6, 63, 0, 2, ac(6, 63, 2, False))
        for high in (2, 1):
            for i in every:
                out += scan([i], 1, 63, high, high - 1, ac(1, 63, high - 1, True))
        out += scan(every, 0, 0, 1, 0, dc_bit)
    return out + b"\xff\xd9"


def samples(blocks, quant):
    """Sample planes of quantised blocks, before rounding."""
    full = blocks.reshape(*blocks.shape[:2], 8, 8) * quant.reshape(8, 8)
    return 128 + np.einsum("abuv,ux,vy->axby", full.astype(float), BASIS, BASIS).reshape(blocks.shape[0] * 8, -1)


def blocks_of(plane, quant):
    """Quantised blocks of a plane whose sides are multiples of 8."""
    h, w = plane.shape
    cut = plane.reshape(h // 8, 8, w // 8, 8) - 128.0
    return np.rint(np.einsum("axby,ux,vy->abuv", cut, BASIS, BASIS) / quant.reshape(8, 8)).astype(int).reshape(h // 8, w // 8, 64)
