"""Byte-level BPE by rank files: a tree of joins whose boundary windows are encoded anew until they are stable.

Why a join is right: a sequence of tokens is the encoding of its bytes exactly when each neighbouring pair is (the pair's
bytes encode to that pair). Inside the halves all pairs are good already, so a window around the joint is encoded anew, and
grown, until both of its outer pairs are good.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from ferrule.llm._shared import map_batches, shipped, worker_cache

shipped(__name__)

#: White space as Unicode's White_Space property has it.
WS = "\t-\r \x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: A piece of at most so many bytes is merged directly, without halving.
LEAF = 48
#: Chunks in each of the two generations that a worker keeps, and the longest of them. A full young generation becomes the old
#: one, so what is used often stays.
CACHE_SIZE, CACHE_CHARS = 400_000, 64
#: After letters these, in any number, are one match of the pattern. (An apostrophe is not here: 's and the like are matches of their own.)
PUNCTUATION = '.,;:!?)$"-'
#: Ids spelled at a time.
SPELL_STEP = 1 << 15
#: Ranks fit in so many bits; a pair without a merge has a rank above all.
RANK_BITS = 24
NO_RANK = 1 << RANK_BITS


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Spelling:
    """What each id stands for, as one array of bytes, so that whole arrays of ids are spelled at once."""

    def __init__(self, words: list[bytes]):
        self.sizes = np.array([len(w) for w in words], np.int64)
        self.starts, self.bytes = np.cumsum(self.sizes) - self.sizes, np.frombuffer(b"".join(words), np.uint8)

    def of(self, ids: np.ndarray) -> bytes:
        parts = []
        for at in range(0, len(ids), SPELL_STEP):
            own = ids[at : at + SPELL_STEP]
            sizes = self.sizes[own]
            ends = np.cumsum(sizes)
            parts.append(self.bytes[np.repeat(self.starts[own] - ends + sizes, sizes) + np.arange(ends[-1])].tobytes())
        return b"".join(parts)


class Bpe:
    """Encoder and decoder of one rank file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.tokens, self.pieces = ranks, {i: t for t, i in ranks.items()}, regex.compile(pattern).findall
        self.single = [ranks[bytes([c])] for c in range(256)]
        #: Each two ranks (first << RANK_BITS | second) whose bytes together are a token: its rank.
        self.pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left << RANK_BITS | right] = rank
        #: The same for two bytes (first << 8 | second).
        self.first = [ranks.get(bytes([x, y]), NO_RANK) for x in range(256) for y in range(256)]
        size = max(ranks.values()) + 1
        every = [self.tokens.get(i, b"") for i in range(size)]
        self.raw, self.named = Spelling(every), Spelling([f"{i} ".encode() for i in range(size)])

    def merge(self, piece: bytes) -> list[int]:
        """Directly: the adjacent pair of lowest rank, leftmost first, until none is a token. Only a merge's two neighbours are looked up anew."""
        single, first, rank_of = self.single, self.first, self.pairs.get
        ids = [single[c] for c in piece]
        found = [first[x << 8 | y] for x, y in zip(piece, piece[1:])]
        while found and (best := min(found)) != NO_RANK:
            at = found.index(best)
            ids[at] = best
            del ids[at + 1], found[at]
            if at:
                found[at - 1] = rank_of(ids[at - 1] << RANK_BITS | best, NO_RANK)
            if at < len(found):
                found[at] = rank_of(best << RANK_BITS | ids[at + 1], NO_RANK)
        return ids

    def bytes_of(self, ids: list[int]) -> bytes:
        return b"".join([self.tokens[i] for i in ids])

    def stable(self, x: int, y: int) -> bool:
        return self.merge(self.tokens[x] + self.tokens[y]) == [x, y]

    def join(self, a: list[int], b: list[int]) -> list[int]:
        """The monoid's operation: the encoding of a's bytes and then b's."""
        if not a or not b:
            return a or b
        left, right = 1, 1
        while True:
            left, right = min(left, len(a)), min(right, len(b))
            mid = self.merge(self.bytes_of(a[len(a) - left :]) + self.bytes_of(b[:right]))
            grow_left = left < len(a) and not self.stable(a[-left - 1], mid[0])
            grow_right = right < len(b) and not self.stable(mid[-1], b[right])
            if not grow_left and not grow_right:
                return a[: len(a) - left] + mid + b[right:]
            left, right = left * (1 + grow_left), right * (1 + grow_right)

    def reduce(self, piece: bytes) -> list[int]:
        if len(piece) <= LEAF:
            return self.merge(piece)
        half = len(piece) // 2
        return self.join(self.reduce(piece[:half]), self.reduce(piece[half:]))

    def encode_piece(self, piece: bytes) -> list[int]:
        """One match of the pattern; a piece that is itself a token stays whole."""
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self.reduce(piece)

    def encode(self, text: str) -> list[int]:
        return [i for p in self.pieces(text) for i in self.encode_piece(p.encode())]

    def decode(self, ids) -> bytes:
        """Concatenation up a tree of halves, whose leaves are spelled at once."""
        if len(ids) <= SPELL_STEP:
            return self.raw.of(np.asarray(ids, np.int64))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def chunker(pattern: str):
    """A cheap first split whose cuts are all cuts of the pattern: a word with the space before it, or a run of white space.

    True for the pattern of public_tokenizers: only its white-space alternatives look ahead, and each other alternative takes
    one space at most, in front. For other patterns the whole text is one chunk.
    """
    from public_tokenizers import PATTERN

    return re.compile(f" ?[^{WS}]+|[{WS}]+(?![^{WS}])|[{WS}]+").findall if pattern == PATTERN else lambda text: [text] if text else []


class Chunks:
    """A worker's encoder of one rank file, and the chunks it met of late with their ids (packed)."""

    def __init__(self, path: str, pattern: str):
        from public_tokenizers import PATTERN

        self.bpe, self.split, self.young, self.old = Bpe(load_ranks(path), pattern), chunker(pattern), {}, {}
        self.plain = pattern == PATTERN

    def encoded(self, chunk: str) -> bytes:
        """A new chunk. Its letters, without what ends it, are often known already."""
        if self.plain and chunk.isascii():
            word = chunk.rstrip(PUNCTUATION)
            if word and word.removeprefix(" ").isalpha():  # one match of the pattern, and another for the rest
                if word == chunk:
                    return packed(self.bpe.encode_piece(chunk.encode()))
                return (self.young.get(word) or self.old.get(word) or self.encoded(word)) + packed(self.bpe.encode_piece(chunk[len(word) :].encode()))
        return packed(self.bpe.encode(chunk))

    def missing(self, chunk: str) -> bytes:
        found = self.old.get(chunk) or self.encoded(chunk)
        if len(chunk) <= CACHE_CHARS:
            if len(self.young) >= CACHE_SIZE:
                self.young, self.old = {}, self.young
            self.young[chunk] = found
        return found

    def of(self, text: str) -> np.ndarray:
        """The ids of a text."""
        known, missing = self.young.get, self.missing
        return np.frombuffer(b"".join([known(c) or missing(c) for c in self.split(text)]), np.uint32).astype(np.int64)

    def listed(self, ids: np.ndarray) -> bytes:
        """Decimal ids, one space between."""
        return self.bpe.named.of(ids)[:-1]


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"={len(ids)}I", *ids)


def encoder(path: str, pattern: str) -> Chunks:
    kept = worker_cache()
    if (key := ("bpe", path, pattern)) not in kept:
        kept[key] = Chunks(path, pattern)
    return kept[key]


def encode_documents(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text and decode it again: id, n_tokens, token_ids (one space between), decoded (binary).

    A null text counts as empty: no ids, no bytes. A null id stays null; repeated rows give repeated rows; an empty table
    gives an empty one. Other columns are not read, so their names cannot clash.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = encoder(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [own.of(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(f) for f in found], pa.int64()), pa.array([own.listed(f).decode() for f in found], pa.string()), pa.array([own.bpe.decode(f) for f in found], pa.binary())],
                    names=["id", "n_tokens", "token_ids", "decoded"],
                )

    kind = dict(df.dtypes)[id_col]
    return map_batches(df, [id_col, text_col], f"id {kind}, n_tokens long, token_ids string, decoded binary", run).withColumnRenamed("id", id_col)


def digest_documents(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As encode_documents, with SHA-256 digests in place of the ids and the bytes, made where those are made."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def sha(x: bytes) -> str:
            return hashlib.sha256(x).hexdigest()

        own = encoder(path, pattern)
        for batch in batches:
            counts, ids, decoded = [], [], []
            for at in range(batch.num_rows):
                found = own.of(batch.column(1)[at].as_py() or "")
                counts.append(len(found))
                ids.append(sha(own.listed(found)))
                decoded.append(sha(own.bpe.decode(found)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = dict(df.dtypes)[id_col]
    return map_batches(df, [id_col, text_col], f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", run).withColumnRenamed("id", id_col)
