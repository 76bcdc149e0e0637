"""Baseline JPEG as a media column: parse markers, Huffman-decode scans, rebuild the DC-only luminance thumbnail in numpy.

The writer stores bytes without loss: each is the mean of one 8 x 8 block, so the thumbnail (one sample a block) is the
payload. Its Huffman tables give every block 16 bits and no byte FF. The reader takes any baseline or extended sequential
Huffman stream of 8-bit samples; scans whose blocks all have 16 bits are decoded whole in numpy, others block by block.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm._shared import map_batches, shipped

shipped(__name__)

#: Blocks in a row of the writer's images, and the most rows that the header's 16 bits allow.
ACROSS, MOST_ROWS = 64, 8191
#: DC code lengths by category 0 to 8: length + extra bits = 10. The only AC code, end of block, has 6 bits.
DC_LENGTHS, EOB_LENGTH = {s: 10 - s for s in range(9)}, 6


def huffman(counts: bytes, symbols: bytes) -> dict[int, tuple[int, int]]:
    """symbol: (code, length), canonical."""
    out, code, at = {}, 0, 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            out[symbols[at]] = code, length
            code, at = code + 1, at + 1
        code <<= 1
    return out


def tables() -> tuple[bytes, bytes, bytes, bytes]:
    by_length = sorted(DC_LENGTHS, key=DC_LENGTHS.get)
    dc = bytes(sum(n == k for n in DC_LENGTHS.values()) for k in range(1, 17))
    return dc, bytes(by_length), bytes(int(k == EOB_LENGTH) for k in range(1, 17)), b"\0"


def diff_words() -> np.ndarray:
    """For a difference + 255: the 16 bits of a block."""
    dc_counts, dc_symbols, ac_counts, ac_symbols = tables()
    dc, (eob, eob_length), out = huffman(dc_counts, dc_symbols), huffman(ac_counts, ac_symbols)[0], []
    for d in range(-255, 256):
        s = abs(d).bit_length()
        code, length = dc[s]
        out.append((((code << s | (d if d >= 0 else d + (1 << s) - 1)) << eob_length) | eob) << (16 - length - s - eob_length))
    return np.array(out, dtype=">u2")


WORDS = diff_words()


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def encode(payload: bytes) -> bytes:
    """Payload, whose length is a positive multiple of ACROSS, as one JPEG image, or more of them if it is too high for one."""
    dc_counts, dc_symbols, ac_counts, ac_symbols = tables()
    out = []
    for at in range(0, len(payload), ACROSS * MOST_ROWS):
        part = np.frombuffer(payload, np.uint8, min(ACROSS * MOST_ROWS, len(payload) - at), at).astype(np.int16)
        part = np.diff(part, prepend=np.int16(128))
        out += [
            b"\xff\xd8",
            segment(0xDB, b"\0" + bytes([8]) * 64),
            segment(0xC0, struct.pack(">BHHBBBB", 8, len(part) // ACROSS * 8, ACROSS * 8, 1, 1, 0x11, 0)),
            segment(0xC4, b"\x00" + dc_counts + dc_symbols + b"\x10" + ac_counts + ac_symbols),
            segment(0xDA, bytes([1, 1, 0, 0, 63, 0])),
            WORDS[part + 255].tobytes(),
            b"\xff\xd9",
        ]
    return b"".join(out)


def lookup(table: dict[int, tuple[int, int]]) -> list[tuple[int, int]]:
    """By the next 16 bits: (symbol, length); length 0 where no code fits."""
    out = [(0, 0)] * 65536
    for symbol, (code, length) in table.items():
        first = code << (16 - length)
        out[first : first + (1 << (16 - length))] = [(symbol, length)] * (1 << (16 - length))
    return out


def whole_blocks(dc: dict[int, tuple[int, int]], ac: dict[int, tuple[int, int]]) -> np.ndarray | None:
    """For each 16 bits, the difference of a block that takes just these bits: DC and end of block. Else 32767."""
    if 0 not in ac:
        return None
    eob, eob_length = ac[0]
    out = np.full(65536, 32767, np.int16)
    for s, (code, length) in dc.items():
        if length + s + eob_length == 16:
            for bits in range(1 << s):
                d = bits if s == 0 or bits >> (s - 1) else bits - (1 << s) + 1
                out[(code << s | bits) << eob_length | eob] = d
    return out


class Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.size = data + b"\0" * 8, 0, 8 * len(data)

    def peek(self) -> int:
        byte, bit = divmod(self.at, 8)
        return int.from_bytes(self.data[byte : byte + 3], "big") >> (8 - bit) & 0xFFFF

    def take(self, n: int) -> int:
        if not n:
            return 0
        byte, bit = divmod(self.at, 8)
        self.at += n
        if self.at > self.size:
            raise ValueError("the scan ends early")
        return int.from_bytes(self.data[byte : byte + 4], "big") >> (32 - bit - n) & ((1 << n) - 1)

    def symbol(self, table: list[tuple[int, int]]) -> int:
        s, n = table[self.peek()]
        if not n:
            raise ValueError("no such Huffman code")
        self.at += n
        return s


def unstuffed(data: bytes, at: int) -> tuple[list[bytes], int]:
    """The entropy-coded intervals from at on, without stuffed bytes, and where the next marker stands."""
    parts, begin = [], at
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            raise ValueError("no marker after the scan")
        if data[at + 1] == 0:
            at += 2
        elif 0xD0 <= data[at + 1] <= 0xD7:
            parts.append(data[begin:at].replace(b"\xff\0", b"\xff"))
            begin = at = at + 2
        else:
            return [*parts, data[begin:at].replace(b"\xff\0", b"\xff")], at


def decode_one(data: bytes, at: int) -> tuple[int, int, np.ndarray, int]:
    """The image that starts at a byte: its width and height, its DC-only luminance thumbnail, where it ends."""
    quant, huff, frame, restart = {}, {}, None, 0
    if data[at : at + 2] != b"\xff\xd8":
        raise ValueError("no start of image")
    at, plane = at + 2, None
    while True:
        while data[at : at + 2] == b"\xff\xff":
            at += 1
        if at + 4 > len(data) and data[at : at + 2] != b"\xff\xd9" or data[at] != 0xFF:
            raise ValueError("no marker where one is due")
        marker = data[at + 1]
        if marker == 0xD9:
            break
        size = struct.unpack_from(">H", data, at + 2)[0]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                q = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1)
                quant[body[0] & 15] = int(q[0])
                body = body[65 + 64 * bool(wide) :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                huff[body[0]] = huffman(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker in (0xC0, 0xC1):
            depth, height, width, n = struct.unpack_from(">BHHB", body)
            if depth != 8:
                raise ValueError("samples have 8 bits in baseline")
            frame = height, width, [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif 0xC2 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError("only sequential Huffman streams")
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            parts, at = unstuffed(data, at)
            if frame and frame[2][0][0] in body[1 : 1 + 2 * body[0] : 2]:
                plane = scan(parts, body, frame, quant, huff, restart)
    if plane is None or frame is None:
        raise ValueError("no luminance scan")
    return frame[1], frame[0], plane, at + 2


def scan(parts: list[bytes], body: bytes, frame: tuple, quant: dict, huff: dict, restart: int) -> np.ndarray:
    """The thumbnail of a scan's first component."""
    height, width, components = frame
    chosen = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
    comps = [c for c in components if c[0] in chosen]
    most_h, most_v = max(c[1] for c in components), max(c[2] for c in components)
    first = components[0]
    across, down = -(-width * first[1] // (8 * most_h)), -(-height * first[2] // (8 * most_v))
    if len(comps) == 1:
        units, high, (h, v) = across, down, (1, 1)
    else:
        units, high, (h, v) = -(-width // (8 * most_h)), -(-height // (8 * most_v)), first[1:3]
    dc = np.zeros((high * v, units * h), np.int64)
    one = whole_blocks(huff[chosen[first[0]] >> 4], huff[0x10 | chosen[first[0]] & 15]) if len(comps) == 1 and len(parts) == 1 and not restart else None
    if one is not None and len(parts[0]) == 2 * units * high and (found := one[np.frombuffer(parts[0], ">u2")]).max() < 32767:
        dc[:] = np.cumsum(found, dtype=np.int64).reshape(high, units)
    else:
        tabs = {c[0]: (lookup(huff[chosen[c[0]] >> 4]), lookup(huff[0x10 | chosen[c[0]] & 15])) for c in comps}
        bits, last, source = Bits(parts[0]), dict.fromkeys(chosen, 0), iter(parts[1:])
        for unit in range(units * high):
            if restart and unit and unit % restart == 0:
                bits, last = Bits(next(source)), dict.fromkeys(chosen, 0)
            row, col = divmod(unit, units)
            for c in comps:
                for k in range(c[1] * c[2] if len(comps) > 1 else 1):
                    s = bits.symbol(tabs[c[0]][0])
                    d = bits.take(s)
                    last[c[0]] += d if s == 0 or d >> (s - 1) else d - (1 << s) + 1
                    at = 1
                    while at < 64:
                        rs = bits.symbol(tabs[c[0]][1])
                        if rs & 15 == 0 and rs != 0xF0:
                            break
                        bits.take(rs & 15)
                        at += (rs >> 4) + 1
                    if c is first:
                        dc[row * v + k // h, col * h + k % h] = last[c[0]]
    return np.clip((dc[:down, :across] * quant[first[3]] + 4) // 8 + 128, 0, 255).astype(np.uint8)


def decode(media: bytes) -> list[tuple[int, int, np.ndarray]]:
    """(width, height, thumbnail) of each image in a row of images."""
    out, at = [], 0
    while at < len(media):
        width, height, plane, at = decode_one(media, at)
        out.append((width, height, plane))
    return out


def average_hash(plane: np.ndarray) -> str:
    """64 bits: which of 8 x 8 cells are brighter than the mean; cells by integer sums, so machines agree."""
    rows, cols = (np.arange(9) * n // 8 for n in plane.shape)
    total = np.zeros((plane.shape[0] + 1, plane.shape[1] + 1), np.int64)
    total[1:, 1:] = plane.astype(np.int64).cumsum(0).cumsum(1)
    sums = np.diff(np.diff(total[np.ix_(rows, cols)], axis=0), axis=1)
    areas = np.outer(np.diff(rows), np.diff(cols))
    bits = (sums * plane.size > total[-1, -1] * areas).ravel()
    return np.packbits(bits).tobytes().hex()


def encode_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes and media (binary) of each text: its UTF-8, zero bytes up to a positive multiple of 64, as JPEG.

    A null text counts as empty and gives 64 zero bytes. Null ids stay; equal texts give equal media; an empty table an
    empty one. Other columns are not read.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                raw = [x or b"" for x in part.column(1).cast(pa.binary()).to_pylist()]
                media = [encode(x + b"\0" * (max(1, -(-len(x) // ACROSS)) * ACROSS - len(x))) for x in raw]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())], names=["id", "n_bytes", "media"])

    kind = dict(df.dtypes)[id_col]
    return map_batches(df, [id_col, text_col], f"id {kind}, n_bytes long, media binary", run).withColumnRenamed("id", id_col)


def media_features(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Read JPEG bytes back: width, height, the thumbnail's bytes digested, and hashes of thumbnail and medium.

    A null medium, or one that cannot be decoded, has nulls and the fault in the error column; it never ends the job.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = []
            for at in range(batch.num_rows):
                media = batch.column(1)[at].as_py() or b""
                try:
                    images = decode(media)
                    if not images:
                        raise ValueError("no image")
                    payload = b"".join(p.tobytes() for _, _, p in images)
                    height, width = sum(h for _, h, _ in images), max(w for w, _, _ in images)
                    hashes = [average_hash(p) for _, _, p in images]
                    feature = f"{width}x{height};frames={len(images)};ahash={hashes[0] if len(hashes) == 1 else hashlib.sha256(''.join(hashes).encode()).hexdigest()[:16]}"
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), width, height, feature, None))
                except (ValueError, KeyError, IndexError, struct.error, StopIteration) as e:
                    rows.append((None, None, None, len(media), hashlib.sha256(media).hexdigest(), None, None, None, str(e) or type(e).__name__))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 9, kinds))], names=["id", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "width", "height", "feature", "error"])

    kind = dict(df.dtypes)[id_col]
    return map_batches(df, [id_col, media_col], f"id {kind}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, width int, height int, feature string, error string", run).withColumnRenamed("id", id_col)


def media_columns(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode_media, then media_features of the stored bytes, with n_bytes carried over beside the id."""
    stored = encode_media(df, id_col, text_col).select(F.struct(id_col, "n_bytes").alias("key"), "media")
    return media_features(stored, "key").select(F.col(f"key.{id_col}").alias(id_col), F.col("key.n_bytes").alias("n_bytes"), "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "error")
