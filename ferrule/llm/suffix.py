"""Repeated byte strings across documents, and the linear suffix grouping that orders suffixes.

`suffix_array` is the linear construction: suffixes in groups by Lyndon prefix, groups in descending order, previous-smaller
pointers, then the groups' order emitted without recursion. Over a whole corpus it would be one task and some microseconds a
byte, so it orders what can repeat, a bounded group at a time (README has the figures):

1.  Every window of SPAN bytes picks its least-hashed GRAM as anchor. Equal windows pick equal anchors at equal places, so
    only windows of anchors that occur again can repeat. A run of windows with one anchor is one row.
2.  Equal runs (anchor, extent, content hashed) are counted: those met twice are repeated as a whole.
3.  Where an anchor's runs differ, the suffixes of its contents (one of each) are ordered by `suffix_array`: neighbours that
    share SPAN bytes are repeated.
Hot anchors never meet in one task: counts are pre-aggregated, joins are with written tables, whose skew Spark splits, and
anchors with more than GROUP contents are compared by counting their windows one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm._shared import map_batches, mixed, shipped, worker_cache, written

shipped(__name__)

SPAN, GRAM = 200, 64
#: Bytes hashed at a time; contents of an anchor that meet in one task; bits of the sketch of repeated anchors (16 MB).
STEP, GROUP, SKETCH_BITS = 1 << 17, 1024, 27
#: Bytes of an anchor's contents that are ordered together at most: GROUP of the longest runs.
GROUP_BYTES = 1 << 19
#: Runs whose windows are hashed together, but for an anchor that has more.
BLOCK_ROWS = 2048
SEED_2 = 0x5DEECE66D


def suffix_array(text: bytes) -> list[int]:
    """The order of text's suffixes by linear grouping (two phases), an empty end being least.

    Phase 1 goes through the groups in descending order. Members of a group share a Lyndon prefix of the group's length;
    each member's previous-smaller position is found through the pointers of those before it (members in order of place), and
    these positions, by how many factors follow them, leave their groups for new ones that stand next after. Phase 2 emits
    suffixes in order: each suffix's previous-smaller position is the next of its group. Groups of one, which most are, need
    no counting.
    """
    n = len(text) + 1
    if n == 1:
        return []
    first = np.zeros(n, np.int16)
    first[:-1] = np.frombuffer(text, np.uint8)
    first[:-1] += 1
    by = np.argsort(first, kind="stable")
    sorted_ = first[by]
    heads = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    sizes = np.diff(np.append(heads, n))
    place, groups, size_of = np.empty(n, np.int64), np.empty(n, np.int64), np.zeros(n, np.int64)
    place[by] = np.arange(n)
    groups[by] = np.repeat(heads, sizes)
    size_of[heads] = sizes
    order, at, group, size = by.tolist(), place.tolist(), groups.tolist(), size_of.tolist()
    prev = [-2] * n
    end = n
    while end > 0:
        start = group[order[end - 1]]
        if end - start == 1:
            end = start
            i = order[start]
            j = i - 1
            while j >= 0 and group[j] >= start:
                j = prev[j]
            prev[i] = j
            if j >= 0:
                g = group[j]
                rest = size[g] - 1
                if rest:
                    rear, spot = g + rest, at[j]
                    if spot != rear:
                        other = order[rear]
                        order[spot], at[other] = other, spot
                        order[rear], at[j] = j, rear
                    size[g], size[rear], group[j] = rest, 1, rear
            continue
        members = sorted(order[start:end])
        end = start
        found = []
        for i in members:
            j = i - 1
            while j >= 0 and group[j] >= start:
                j = prev[j]
            prev[i] = j
            if j >= 0:
                found.append(j)
        if not found:
            continue
        # found holds each previous smaller position as often as factors follow it
        if len(set(found)) == len(found):
            batches = (found,)
        else:
            count: dict[int, int] = {}
            for p in found:
                count[p] = count.get(p, 0) + 1
            most: dict[int, list[int]] = {}
            for p, c in count.items():
                most.setdefault(c, []).append(p)
            batches = [most[c] for c in sorted(most, reverse=True)]
        for batch in batches:
            touched: dict[int, list[int]] = {}
            for p in batch:
                g = group[p]
                if g in touched:
                    touched[g].append(p)
                else:
                    touched[g] = [p]
            for g, ps in touched.items():
                rear = g + size[g]
                for p in ps:
                    rear -= 1
                    spot = at[p]
                    if spot != rear:
                        other = order[rear]
                        order[spot], at[other] = other, spot
                        order[rear], at[p] = p, rear
                k = len(ps)
                size[g] -= k
                if size[g]:
                    size[rear] = k
                    for p in ps:
                        group[p] = rear
                else:
                    size[g] = k
    out = [0] * n
    out[0] = n - 1
    free = list(range(n))  # each group's next place, kept at its start
    for i in range(n):
        j = out[i] - 1
        while j >= 0:
            g = group[j]
            if g < 0:
                break
            out[free[g]] = j
            free[g] += 1
            group[j] = -1
            j = prev[j]
    return out[1:]


def repeats(text: bytes, span: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by strings of span bytes that start anywhere else too: by the suffix array and its LCPs."""
    order, n = suffix_array(text), len(text)
    rank = [0] * n
    for i, p in enumerate(order):
        rank[p] = i
    lcp, k, marked = [0] * n, 0, bytearray(n)
    for p in range(n):
        if rank[p]:
            q = order[rank[p] - 1]
            while p + k < n and q + k < n and text[p + k] == text[q + k]:
                k += 1
            lcp[rank[p]] = k
            k = max(0, k - 1)
        else:
            k = 0
    for i in range(1, n):
        if lcp[i] >= span:
            for p in (order[i], order[i - 1]):
                marked[p] = 1
    return merged(np.flatnonzero(np.frombuffer(marked, np.uint8)), np.full(sum(marked), span))


def merged(starts: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs [begin, end) that so many spans cover together; spans that touch are one run."""
    if not len(starts):
        return []
    by = np.argsort(starts, kind="stable")
    starts, ends = starts[by], np.maximum.accumulate((starts + sizes)[by])
    new = np.concatenate([[True], starts[1:] > ends[:-1]])
    first = np.flatnonzero(new)
    return list(zip(starts[first].tolist(), ends[np.append(first[1:], len(starts)) - 1].tolist()))


def constants(step: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random odd number for each byte, and the powers of the base and of its inverse, modulo 2^64."""
    kept = worker_cache()
    if (key := ("suffix", step, span)) not in kept:
        base, n = 0x9E3779B97F4A7C15, step + 2 * span + 2
        powers = [np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)])) for b in (base, pow(base, -1, 2**64))]
        kept[key] = np.array([int.from_bytes(hashlib.sha256(bytes([c])).digest()[:8], "big") | 1 for c in range(256)], np.uint64), *powers
    return kept[key]


def slide(x: np.ndarray, w: int, most: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs [begin, end) of windows of w values that have the same leftmost least value, and where that is."""
    low, size = x, 1
    while size * 2 <= w:
        low, size = np.minimum(low[:-size], low[size:]), size * 2
    n = len(x) - w + 1
    low = np.minimum(low[:n], low[w - size : w - size + n])
    begin = np.concatenate([[0], np.flatnonzero(low[1:] != low[:-1]) + 1])
    end = np.append(begin[1:], n)
    at = begin + w - 1
    up = np.flatnonzero(np.concatenate([[True], low[begin[1:]] > low[begin[1:] - 1]]))
    reach = np.arange(w)
    find = lambda b: np.concatenate([b[i : i + 4096] + x[b[i : i + 4096, None] + reach].argmin(1) for i in range(0, len(b), 4096)]) if len(b) else b
    at[up] = find(begin[up])
    parts, late = [], (begin, end, at)
    for _ in range(most):  # equal values: the least one left the window, another of its value stays
        b, e, a = late
        over = e > a + 1
        parts.append((b, np.minimum(e, a + 1), a))
        if not over.any():
            break
        b, e = a[over] + 1, e[over]
        late = b, e, find(b)
    else:  # text of a short period: level by level, with places
        low, place, size = x, np.zeros(len(x), np.int64), 1
        while size < w:
            move = min(size, w - size)
            take = low[: len(low) - move] <= low[move:]
            place = np.where(take, place[: len(low) - move], place[move:] + move)
            low, size = np.minimum(low[: len(low) - move], low[move:]), size + move
        at = np.arange(n) + place
        begin = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
        return begin, np.append(begin[1:], n), at[begin]
    begin, end, at = (np.concatenate(c) for c in zip(*parts))
    return begin, end, at


def scanned(texts: list[bytes], span: int = SPAN, gram: int = GRAM, step: int = STEP) -> Iterator[tuple[np.ndarray, ...]]:
    """For stretches of texts: which text, anchor hash, run hash, anchor's byte, how far before it the first and the last window start."""
    byte, power, inverse = constants(step, span)
    w, held, room = span - gram + 1, [], 0

    def flush():
        lo, which, off, n = [], [], [], 0
        for d, o, t in held:
            lo.append(n)
            which.append(d)
            off.append(o)
            n += len(t)
        buf = np.frombuffer(b"".join(t for *_, t in held), np.uint8)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(byte[buf] * power[:n], out=total[1:])
        grams = (total[gram:] - total[:-gram]) * inverse[: n - gram + 1]
        begin, end, at = slide(((grams * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32), w)
        lo, which, off = np.array(lo), np.array(which), np.array(off)
        hi = np.append(lo[1:], n) - span + 1
        k = np.searchsorted(lo, end - 1, "right") - 1
        begin, end = np.maximum(begin, lo[k]), np.minimum(end, hi[k])
        ok = begin < end
        begin, end, at, k = begin[ok], end[ok], at[ok], k[ok]
        before, after = at - begin, at - end + 1
        run = (total[end - 1 + span] - total[begin]) * inverse[begin]
        extent = (before * 1024 + after).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return which[k], mixed(grams[at]).view(np.int64), mixed(run ^ mixed(extent)).view(np.int64), at - lo[k] + off[k], before, after

    for d, t in enumerate(texts):
        for o in range(0, max(0, len(t) - span + 1), step):
            part = t[o : o + step + span - 1]
            if held and room + len(part) > step:
                yield flush()
                held, room = [], 0
            held.append((d, o, part))
            room += len(part)
    if held:
        yield flush()


def keys_of(text: bytes) -> tuple[int, int]:
    """80 bits that name a text: XXH64 with two seeds."""
    import xxhash

    a = xxhash.xxh64_intdigest(text, 42)
    return a - (a >> 63 << 64), xxhash.xxh64_intdigest(text, SEED_2) & 0xFFFF


def anchor_counts(df: DataFrame, text_col: str, span: int, gram: int) -> DataFrame:
    """Anchors that occur more than once."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = [s[1] for s in scanned([x or b"" for x in batch.column(0).cast(pa.binary()).to_pylist()], span, gram)]
            h, n = np.unique(np.concatenate(found) if found else np.empty(0, np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], names=["h", "n"])

    return map_batches(df, [text_col], "h long, n long", run).groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")


def sketch(anchors: DataFrame, bits: int = SKETCH_BITS) -> bytes:
    """A bitmap of 2^bits bits with those of the anchors set: of fixed size, and none of them is missed."""
    b = anchors.select(F.col("h").bitwiseAND(F.lit((1 << bits) - 1)).alias("b"))
    words = b.groupBy(F.shiftright("b", 6).cast("int").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(b & 63 as int)))").alias("v")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words.column(0).to_numpy()] = words.column(1).to_numpy()
    return out.tobytes()


def runs(df: DataFrame, text_col: str, anchors: DataFrame, span: int, gram: int, bits: int = SKETCH_BITS) -> DataFrame:
    """t1, p, h, v of each run whose anchor occurs again; p packs the name's rest, the anchor's byte, how far before it the first and last window start."""
    passed = df.sparkSession.sparkContext.broadcast(sketch(anchors, bits))  # 2^bits bits at any input

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        words = np.frombuffer(passed.value, np.uint64)
        for batch in batches:
            texts = [x or b"" for x in batch.column(0).cast(pa.binary()).to_pylist()]
            names = [keys_of(t) for t in texts]
            t1, t2 = np.array([k[0] for k in names], np.int64), np.array([k[1] for k in names], np.int64)
            for d, h, v, at, before, after in scanned(texts, span, gram):
                low = h & ((1 << bits) - 1)
                ok = (words[low >> 6] >> (low & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
                d, h, v, at, before, after = (x[ok] for x in (d, h, v, at, before, after))
                p = t2[d] << 47 | at << 16 | before << 8 | after
                yield pa.RecordBatch.from_arrays([pa.array(t1[d]), pa.array(p), pa.array(h), pa.array(v)], names=["t1", "p", "h", "v"])

    return map_batches(df, [text_col], "t1 long, p long, h long, v long", run).join(anchors, "h").select("t1", "p", "h", "v")


def packed(df: DataFrame, text_col: str) -> DataFrame:
    """df with t1, t2 and the text as compressed bytes (_z), in place of the text."""
    others = [c for c in df.columns if c != text_col]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()
            names = [keys_of(t or b"") for t in texts]
            z = [None if t is None else squeeze.compress(t) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([k[0] for k in names], pa.int64()), pa.array([k[1] for k in names], pa.int64()), pa.array(z, pa.binary())], names=[f"c{i}" for i in range(len(others))] + ["_t1", "_t2", "_z"])

    kinds = dict(df.dtypes)
    renamed = df.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)), F.col(f"`{text_col}`").alias("_text"))
    schema = ", ".join([*(f"c{i} {kinds[c]}" for i, c in enumerate(others)), "_t1 long, _t2 long, _z binary"])
    return renamed.mapInArrow(run, schema)


def spans(df: DataFrame, text_col: str = "text", span: int = SPAN, gram: int = GRAM, most: int = GROUP) -> DataFrame:
    """For each text with any: its name (t1, t2) and the spans (start * 1024 + size, unordered) its repeated windows cover."""
    if not 0 < span - gram <= 255:
        raise ValueError("a span is 1 to 255 bytes longer than a gram")
    anchors = written(anchor_counts(df, text_col, span, gram), "repeat-anchors")
    all_runs = written(runs(df, text_col, anchors, span, gram), "repeat-runs")
    contents = written(all_runs.groupBy("h", "v").agg(F.count("*").alias("n"), F.min(F.struct("t1", "p")).alias("one")).select("h", "v", "n", "one.t1", "one.p"), "repeat-contents")
    several = written(contents.groupBy("h").agg(F.count("*").alias("m")).where("m > 1"), "repeat-several")
    single = written(contents.where("n = 1").select("h", "v"), "repeat-single")
    # (An anchor outside `several` has one content, met twice at least.)
    begin = F.shiftright("p", 16).bitwiseAND(0x7FFFFFFF) - F.shiftright("p", 8).bitwiseAND(255)
    extent = F.shiftright("p", 8).bitwiseAND(255) - F.col("p").bitwiseAND(255) + span
    whole = all_runs.join(single, ["h", "v"], "left_anti").select("t1", F.shiftright("p", 47).alias("t2"), (begin * 1024 + extent).alias("s"))
    asked = contents.join(several, "h").select("h", "m", "n", "t1", F.shiftright("p", 47).alias("t2"), "p")
    asked = written(asked.groupBy("t1", "t2").agg(F.collect_list(F.struct("h", "m", "n", "p")).alias("asked")), "repeat-asked")
    texts = packed(df.select(text_col), text_col).groupBy("_t1", "_t2").agg(F.first("_z").alias("z"))
    places = written(contexts(texts.join(asked, (F.col("_t1") == F.col("t1")) & (F.col("_t2") == F.col("t2"))), span), "repeat-places")
    few = compared(places.where(F.col("m") <= most), span)
    rows = written(windows(places.where(F.col("m") > most), span), "repeat-windows")
    again = written(rows.groupBy("w").agg(F.count("*").alias("c")).where("c > 1").select("w"), "repeat-again")
    many = rows.where("n = 1").join(again, "w").select("t1", "t2", F.col("s"))
    return whole.unionByName(few).unionByName(many).groupBy("t1", "t2").agg(F.collect_set("s").alias("spans"))


def contexts(joined: DataFrame, span: int) -> DataFrame:
    """h, m, n, t1, p and the bytes of each run asked for."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        open_ = zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(batch.num_rows):
                t1, text, asked = batch.column(0)[i].as_py(), open_.decompress(batch.column(1)[i].as_py()), batch.column(2)[i].as_py()
                got = []
                for x in asked:
                    at, before, after = x["p"] >> 16 & 0x7FFFFFFF, x["p"] >> 8 & 255, x["p"] & 255
                    got.append(text[at - before : at - after + span])
                yield pa.RecordBatch.from_arrays([pa.array([x["h"] for x in asked], pa.int64()), pa.array([x["m"] for x in asked], pa.int64()), pa.array([x["n"] for x in asked], pa.int64()), pa.array([t1] * len(asked), pa.int64()), pa.array([x["p"] for x in asked], pa.int64()), pa.array(got, pa.binary())], names=["h", "m", "n", "t1", "p", "run"])

    return map_batches(joined, ["t1", "z", "asked"], "h long, m long, n long, t1 long, p long, run binary", run)


def window_keys(h: np.ndarray, p: np.ndarray, content: list[bytes], span: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each window of each run: which run, its start in the document, and its hash with anchor and offset. In parts of STEP bytes."""
    byte, power, inverse = constants(STEP, span)
    ends = np.cumsum([len(c) for c in content])
    at = 0
    while at < len(content):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STEP, "right")))
        buf = np.frombuffer(b"".join(content[at:end]), np.uint8)
        own = np.array([len(c) for c in content[at:end]])
        total = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(byte[buf] * power[: len(buf)], out=total[1:])
        counts = own - span + 1
        k = np.repeat(np.arange(end - at), counts)
        o = np.arange(len(k)) - np.repeat(np.cumsum(counts) - counts, counts)
        b = (np.cumsum(own) - own)[k] + o
        before = p[at:end][k] >> 8 & 255
        offset = (o - before + 1024).astype(np.uint64)
        what = mixed((total[b + span] - total[b]) * inverse[b] ^ mixed(h[at:end][k].view(np.uint64) + offset * np.uint64(0x9E3779B97F4A7C15)))
        yield k + at, (p[at:end][k] >> 16 & 0x7FFFFFFF) - before + o, what
        at = end


def shared_windows(contents: list[bytes], span: int) -> np.ndarray:
    """For the contents joined by byte 0xFF, which no UTF-8 has: where strings of span bytes start that start elsewhere too.

    In the order of suffixes those with the same first span bytes are neighbours. A window never holds a joint: it counts only
    if span bytes of its content follow.
    """
    text = b"\xff".join(contents)
    sizes = np.array([len(c) for c in contents])
    ends = np.cumsum(sizes + 1) - 1
    whole = np.ones(len(text), bool)
    for e in ends:
        whole[max(0, e - span + 1) : e + 1] = False
    byte, power, inverse = constants(max(GROUP_BYTES, 1 << len(text).bit_length()), span)
    buf = np.frombuffer(text, np.uint8)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(byte[buf] * power[: len(buf)], out=total[1:])
    order = np.array(suffix_array(text), np.int64)
    order = order[whole[order]]
    hashes = (total[order + span] - total[order]) * inverse[order]
    same = hashes[1:] == hashes[:-1]
    return np.sort(order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]) if len(order) else order


def compared(places: DataFrame, span: int) -> DataFrame:
    """Spans of runs met once whose windows other contents of their anchor have."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def group(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            contents, n, p = rows.column("run").to_pylist(), rows.column("n").to_numpy(), rows.column("p").to_numpy()
            starts = np.cumsum([0, *(len(c) + 1 for c in contents)])[:-1]
            at = shared_windows(contents, span)
            who = np.searchsorted(starts, at, "right") - 1
            once = n[who] == 1
            at, who = at[once], who[once]
            first = np.flatnonzero(np.concatenate([[True], (who[1:] != who[:-1]) | (at[1:] != at[:-1] + 1)])) if len(at) else np.empty(0, np.int64)
            last = np.append(first[1:], len(at)) - 1 if len(first) else first
            own = who[first]
            begin = (p[own] >> 16 & 0x7FFFFFFF) - (p[own] >> 8 & 255) + at[first] - starts[own]
            return rows.column("t1").to_numpy()[own], p[own] >> 47, begin * 1024 + at[last] - at[first] + span

        def block(t: pa.Table) -> pa.RecordBatch:
            h = t.column("h").to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1], [True]]))
            found = [group(t.slice(a, b - a)) for a, b in zip(cuts, cuts[1:])]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*found)], names=["t1", "t2", "s"])

        held = None
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                now = pa.Table.from_batches([batch.slice(start, BLOCK_ROWS)])
                held = now if held is None else pa.concat_tables([held, now])
                if held.num_rows < BLOCK_ROWS:
                    continue
                h = held.column("h").to_numpy()
                cut = int(np.searchsorted(h, h[-1]))  # rows come sorted by anchor; the last may go on
                for at, end in rows_cut(h[:cut], BLOCK_ROWS):
                    yield block(held.slice(at, end - at))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            for at, end in rows_cut(held.column("h").to_numpy(), BLOCK_ROWS):
                yield block(held.slice(at, end - at))

    return map_batches(places.repartition("h").sortWithinPartitions("h"), ["h", "n", "t1", "p", "run"], "t1 long, t2 long, s long", run)


def rows_cut(h: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Stretches of at least so many rows that cut no anchor's rows apart."""
    out, at = [], 0
    while at < len(h):
        end = len(h) if at + most >= len(h) else int(np.searchsorted(h, h[at + most], "right"))
        out.append((at, end))
        at = end
    return out


def windows(places: DataFrame, span: int) -> DataFrame:
    """Each window of the runs: hashed with anchor and offset (w), n, and its span."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(start, BLOCK_ROWS)
                h, n, t1, p = (part.column(i).to_numpy() for i in range(4))
                for who, where, what in window_keys(h, p, part.column(4).to_pylist(), span):
                    yield pa.RecordBatch.from_arrays([pa.array(what.view(np.int64)), pa.array(n[who]), pa.array(t1[who]), pa.array(p[who] >> 47), pa.array(where * 1024 + span)], names=["w", "n", "t1", "t2", "s"])

    return map_batches(places, ["h", "n", "t1", "p", "run"], "w long, n long, t1 long, t2 long, s long", run)


def with_spans(df: DataFrame, text_col: str, span: int, gram: int) -> DataFrame:
    found = written(spans(df, text_col, span, gram), "repeat-spans")
    return packed(df, text_col).join(found, (F.col("_t1") == F.col("t1")) & (F.col("_t2") == F.col("t2")), "left").drop("t1", "t2", "_t1", "_t2")


def kept(text: bytes, found: list[int] | None) -> tuple[list[tuple[int, int]], bytes]:
    s = np.array(found or [], np.int64)
    cuts = merged(s >> 10, s & 1023)
    edges = [0, *(x for c in cuts for x in c), len(text)]
    return cuts, b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))


def repeat_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256, after removal of each byte that a repeated span covers.

    Null texts count as empty: nothing to remove. Texts shorter than span never repeat. Repeated rows are documents of their
    own, so they repeat each other. Null ids stay; an empty table gives an empty one; other columns are not read.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        open_ = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                z = batch.column(1)[i].as_py()
                text = open_.decompress(z) if z else b""
                cuts, rest = kept(text, batch.column(2)[i].as_py())
                rows.append((len(text), len(text) - len(rest), len(cuts), hashlib.sha256(rest).hexdigest()))
            cols = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = dict(df.dtypes)[id_col]
    joined = with_spans(df.select(id_col, text_col), text_col, span, gram)
    return joined.select("c0", "_z", "spans").mapInArrow(run, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("id", id_col)


def without_repeats(df: DataFrame, text_col: str = "text", span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """df with the repeated bytes out of its texts, all its columns kept; a character cut apart goes as a whole."""
    others = [c for c in df.columns if c != text_col]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        open_ = zstandard.ZstdDecompressor()
        for batch in batches:
            texts = []
            for i in range(batch.num_rows):
                z = batch.column(batch.num_columns - 2)[i].as_py()
                texts.append(None if z is None else kept(open_.decompress(z), batch.column(batch.num_columns - 1)[i].as_py())[1].decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(texts, pa.string())], names=[f"c{i}" for i in range(len(others))] + ["text"])

    kinds = dict(df.dtypes)
    joined = with_spans(df, text_col, span, gram).select(*(f"c{i}" for i in range(len(others))), "_z", "spans")
    out = joined.mapInArrow(run, ", ".join([*(f"c{i} {kinds[c]}" for i, c in enumerate(others)), "text string"]))
    return out.select(*(F.col("text").alias(text_col) if c == text_col else F.col(f"c{others.index(c)}").alias(c) for c in df.columns))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
b AS (SELECT r, unnest(range(0, length(x) // 2 - 199)) AS p, x FROM d WHERE length(x) >= 400),
w AS (SELECT r, p, md5(substr(x, 2 * p + 1, 400)) AS k FROM b),
dup AS (SELECT r, p FROM w QUALIFY count(*) OVER (PARTITION BY k) > 1),
i AS (SELECT r, p, CASE WHEN p <= lag(p) OVER (PARTITION BY r ORDER BY p) + 200 THEN 0 ELSE 1 END AS new FROM dup),
g AS (SELECT r, p, sum(new) OVER (PARTITION BY r ORDER BY p) AS g FROM i),
s AS (SELECT r, g, min(p) AS b, max(p) + 200 AS e FROM g GROUP BY r, g),
gap AS (SELECT r, g, b, e, lag(e, 1, 0::BIGINT) OVER (PARTITION BY r ORDER BY g) AS a FROM s),
k AS (SELECT gap.r, string_agg(substr(x, 2 * a + 1, 2 * (b - a)), '' ORDER BY g) AS h, max(e) AS e, count(*) AS n, sum(e - b) AS gone FROM gap JOIN d USING (r) GROUP BY gap.r)
SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN n IS NULL THEN x ELSE h || substr(x, 2 * e + 1) END)) AS kept_sha256 FROM d LEFT JOIN k USING (r)
"""
