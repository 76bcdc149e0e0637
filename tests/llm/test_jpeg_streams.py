"""The general bit reader on streams of another encoder: several components, subsampling, restarts, AC terms of all kinds."""

import random
import struct

import pytest

from ferrule.llm import jpeg


class Writer:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> i & 1 for i in range(n - 1, -1, -1)]

    def done(self):
        out = bytearray()
        bits = self.bits + [1] * (-len(self.bits) % 8)
        for i in range(0, len(bits), 8):
            out.append(int("".join(map(str, bits[i : i + 8])), 2))
            if out[-1] == 0xFF:
                out.append(0)
        return bytes(out)


#: All symbols have codes of 8 bits (DC: of 4), the all-ones code of each length left out, as the format asks.
DC = {s: (s, 4) for s in range(12)}
AC_SYMBOLS = [0x00, 0xF0, *(run << 4 | size for run in range(0, 16, 3) for size in range(1, 11))]
AC = {s: (i, 8) for i, s in enumerate(AC_SYMBOLS)}


def table(kind, codes, length):
    counts = bytes(len(codes) if n == length else 0 for n in range(1, 17))
    return bytes([kind]) + counts + bytes(codes)


def value_bits(v):
    n = abs(v).bit_length()
    return n, v if v >= 0 else v + (1 << n) - 1


def encoded(r, width, height, factors, restart):
    """A stream with random coefficients, and its luminance DC terms."""
    most_h, most_v = max(h for h, _ in factors), max(v for _, v in factors)
    if len(factors) == 1:
        most_h = most_v = 1
        across, down = -(-width // 8), -(-height // 8)
        factors_of = [(1, 1)]
    else:
        across, down = -(-width // (8 * most_h)), -(-height // (8 * most_v))
        factors_of = factors
    dc = {}
    parts, w, last = [], Writer(), [0] * len(factors)
    for unit in range(across * down):
        if restart and unit and unit % restart == 0:
            parts.append(w.done())
            w, last = Writer(), [0] * len(factors)
        row, col = divmod(unit, across)
        for c, (h, v) in enumerate(factors_of):
            for k in range(h * v):
                now = r.randint(-500, 500)
                if c == 0:
                    dc[row * v + k // h, col * h + k % h] = now
                n, bits = value_bits(now - last[c])
                last[c] = now
                w.put(*DC[n])
                w.put(bits, n)
                at = 1
                while at < 64 and r.random() < 0.7:
                    symbol = r.choice(AC_SYMBOLS[1:])
                    if at + (symbol >> 4) > 63:
                        break
                    w.put(*AC[symbol])
                    size = symbol & 15
                    w.put(r.getrandbits(size) if size else 0, size)
                    at += (symbol >> 4) + 1
                if at < 64:
                    w.put(*AC[0])
    parts.append(w.done())
    body = parts[0] + b"".join(bytes([0xFF, 0xD0 + i % 8]) + p for i, p in enumerate(parts[1:]))
    comps = b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(factors))
    out = b"\xff\xd8" + jpeg.segment(0xE0, b"JFIF\0extra") + jpeg.segment(0xDB, b"\0" + bytes([3]) + bytes([5]) * 63)
    out += jpeg.segment(0xC0, struct.pack(">BHHB", 8, height, width, len(factors)) + comps)
    out += jpeg.segment(0xC4, table(0x00, list(DC), 4) + table(0x10, AC_SYMBOLS, 8))
    if restart:
        out += jpeg.segment(0xDD, struct.pack(">H", restart))
    out += jpeg.segment(0xDA, bytes([len(factors)]) + b"".join(bytes([i + 1, 0]) for i in range(len(factors))) + bytes([0, 63, 0])) + body + b"\xff\xd9"
    return out, dc


@pytest.mark.parametrize("restart", [0, 1, 3])
@pytest.mark.parametrize("factors", [[(1, 1)], [(1, 1), (1, 1), (1, 1)], [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)]])
@pytest.mark.parametrize("size", [(8, 8), (33, 17), (70, 50)])
def test_streams_of_another_encoder(factors, restart, size):
    r = random.Random(f"{factors} {restart} {size}")
    data, dc = encoded(r, *size, factors, restart)
    ((width, height, plane),) = jpeg.decode(data)
    assert (width, height) == size and plane.shape == (-(-size[1] // 8), -(-size[0] // 8))
    for (i, j), v in dc.items():
        if i < plane.shape[0] and j < plane.shape[1]:
            assert plane[i, j] == min(255, max(0, (v * 3 + 4) // 8 + 128))
