"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verified Hamming links, components.

Equal fingerprints are one node, so copies never meet in pairs. k differing bits leave all but k of b blocks equal: each
fingerprint goes to the C(b, b-k) keys made of b-k of its blocks. A key's fingerprints come in chunks of bounded size; each
pair of chunks is one unit of work that yields no pairs but a spanning forest of its verified links. Components come from
rounds of large-star and small-star steps over these forests, each round a table in the shared folder.

Blocks give all links of a few bits, but texts that share four fifths of their shingles differ in some ten bits of 64, for
which no split into blocks is selective. So where a similarity is asked for, each text also has a sketch of minima of its
shingles' hashes. Bands of the sketch are blocks of a second kind. Whole sketches only pick candidates; the sets of shingle
hashes verify, in the same bounded units of work.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.llm._shared import map_batches, mixed, shipped, written

shipped(__name__)

#: Fingerprints in a chunk of a key.
CHUNK = 1024
#: Words hashed at a time.
STEP = 65536
BITS = 64


LOWER = {c: c + 32 for c in range(65, 91)}
#: A sketch's bands and the minima in each: at similarity 0.8 a pair shares a band with probability 0.998.
BANDS, ROWS = 21, 6
#: What a candidate's estimate may fall short of the similarity asked for; its standard deviation there is 0.036, and of pairs
#: at 0.8 a part of 0.00006 falls lower. Candidates are then verified exactly.
MARGIN = 0.15
#: Shingles in a chunk of a key, where texts are long.
SHINGLES = 1 << 19
#: Bands of the first step; the rest only look at keys that these have not made one component.
FIRST_BANDS = 3
#: Shingles whose minima are taken at a time.
SKETCH_STEP = 256
FACTOR, MASK = (np.array([int.from_bytes(hashlib.sha256(f"{name} {i}".encode()).digest()[:4], "big") | 1 for i in range(BANDS * ROWS)], np.uint32) for name in ("factor", "mask"))


def hashed(text: str | None, shingle: int, seed: int = 42) -> Iterator[np.ndarray]:
    """The XXH64 of a text's shingles, repeats included, a bounded number at a time. Fewer words than a shingle's are one."""
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    n = max(1, len(words) - shingle + 1) if words else 0
    for at in range(0, n, STEP):
        own = words[at : min(n, at + STEP) + shingle - 1]
        joined = [" ".join(words)] if len(words) <= shingle else map(" ".join, zip(*(own[k:] for k in range(shingle))))
        yield np.array([xxhash.xxh64_intdigest(s, seed) for s in joined], dtype=np.uint64)


class Marks:
    """What one pass over a text's hashes gathers: the fingerprint's bits and, if asked for, the sketch's minima."""

    def __init__(self, text: str | None, shingle: int, sketch: bool, seed: int = 42):
        self.n, self.ones, self.least = 0, np.zeros(BITS, np.int64), np.full(BANDS * ROWS, 2**32 - 1, np.uint32)
        for h in hashed(text, shingle, seed):
            self.n += len(h)
            self.ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
            if sketch:
                low = np.unique(h.astype(np.uint32))
                for at in range(0, len(low), SKETCH_STEP):
                    np.minimum(self.least, ((low[at : at + SKETCH_STEP, None] ^ MASK) * FACTOR).min(0), out=self.least)

    def fingerprint(self) -> int:
        """A bit is 1 if set in over half the hashes. No words: 0."""
        return int.from_bytes(np.packbits(2 * self.ones > self.n).tobytes(), "big")

    def bands(self) -> np.ndarray:
        """A key for each band; none for a text without words."""
        key = np.arange(BANDS if self.n else 0, dtype=np.uint64)
        for x in self.least.reshape(BANDS, ROWS).T.astype(np.uint64):
            key = mixed((key ^ x[: len(key)]) * np.uint64(0x9E3779B97F4A7C15))
        return key.view(np.int64)


def fingerprint(text: str | None, shingle: int, seed: int = 42) -> int:
    return Marks(text, shingle, False, seed).fingerprint()


def text_key(text: Column) -> dict[str, Column]:
    """Two hashes that tell texts apart; a null text is one of its own."""
    return {"t1": F.xxhash64(text), "t2": F.xxhash64(F.lit("t2"), text, text.isNull())}


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, sketch: bool = False) -> DataFrame:
    """id and fp (the fingerprint as a signed long) of each row; if asked for, t1 and t2 (the text's key), n (its shingles,
    repeats included), sk and ks (the sketch and its bands' keys).

    A null text has no words, so fingerprint 0 and no keys.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            marks = [Marks(batch.column(1)[i].as_py(), shingle, sketch) for i in range(batch.num_rows)]
            columns = {"id": batch.column(0), "fp": pa.array(np.array([m.fingerprint() for m in marks], np.uint64).view(np.int64))}
            if sketch:
                columns |= {"t1": batch.column(2), "t2": batch.column(3), "n": pa.array([m.n for m in marks], pa.int64())}
                columns |= {"sk": pa.array([m.least.astype(np.uint8).tobytes() for m in marks], pa.binary()), "ks": pa.array([m.bands() for m in marks], pa.list_(pa.int64()))}
            yield pa.RecordBatch.from_pydict(columns)

    kind = dict(df.dtypes)[id_col]
    own = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if sketch:
        own = own.select("id", "text", *(v.alias(k) for k, v in text_key(F.col("text")).items()))
    return map_batches(own, own.columns, f"id {kind}, fp long" + ", t1 long, t2 long, n long, sk binary, ks array<long>" * sketch, run)


def shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """t1, t2 and set (the sorted distinct hashes of the shingles, as bytes) of texts (t1, t2, text)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            sets = []
            for i in range(batch.num_rows):
                parts = [np.unique(h) for h in hashed(batch.column(2)[i].as_py(), shingle)]
                sets.append(np.unique(np.concatenate(parts)).tobytes() if parts else b"")
            yield pa.RecordBatch.from_pydict({"t1": batch.column(0), "t2": batch.column(1), "set": pa.array(sets, pa.binary())})

    return map_batches(texts, ["t1", "t2", "text"], "t1 long, t2 long, set binary", run)


def blocks(n: int) -> list[tuple[int, int]]:
    """(shift, width) of n blocks of near equal width."""
    edges = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def block_count(nodes: int, bits: int) -> int:
    """The fewest blocks for which random fingerprints meet less than once a key; links are whole with any number."""
    n = bits + 2
    while n < 3 * bits and nodes > 2 ** (BITS * (n - bits) // n):
        n += 1
    return n


def keys(fp: Column, n: int, bits: int) -> Column:
    """An array of the keys of a fingerprint: which blocks, and what they hold."""
    own = blocks(n)
    parts = []
    for k, chosen in enumerate(combinations(range(n), n - bits)):
        mask = sum(((1 << own[i][1]) - 1) << own[i][0] for i in chosen)
        parts.append(F.struct(F.lit(k).alias("k"), fp.bitwiseAND(F.lit(mask - (1 << BITS) if mask >> (BITS - 1) else mask)).alias("v")))
    return F.array(*parts)


def forest(a: np.ndarray, b: np.ndarray | None, bits: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links within a, or within a and b together, found breadth first."""
    nodes = a if b is None else np.concatenate([a, b])
    nodes = np.unique(nodes)
    left, out = nodes.view(np.uint64), []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(left ^ at) <= bits
            if near.any():
                found = left[near]
                queue.extend(found)
                root = at.astype(np.int64) if hasattr(at, "astype") else np.int64(at)
                out += [(int(root), int(x)) for x in found.view(np.int64)]
                left = left[~near]
    return out


def links(nodes: DataFrame, bits: int, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) at up to so many bits: they connect just what all links do.

    Keys with more than chunk fingerprints are dealt out: fingerprint x is in chunk hash(x) mod n, and each pair of chunks
    has a unit of its own, so no task holds more than two chunks of a key at once.
    """
    n = block_count(nodes.count(), bits)
    keyed = written(nodes.select("fp", F.explode(keys(F.col("fp"), n, bits)).alias("key")).select("fp", "key.k", "key.v"), "simhash-keys")
    counts = keyed.groupBy("k", "v").count().where("count > 1")
    hot = written(counts.where(F.col("count") > chunk).select("k", "v", F.ceil(F.col("count") / chunk).cast("int").alias("n")), "simhash-hot")
    dealt = keyed.join(hot, ["k", "v"], "left").withColumn("own", F.pmod(F.xxhash64("fp"), F.coalesce("n", F.lit(1))).cast("int"))
    other = F.explode(F.when(F.col("n").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("n") - 1)))
    dealt = dealt.withColumn("other", other).select("k", "v", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    units = dealt.groupBy("k", "v", "i", "j").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            flat, offsets = batch.column(0).flatten().to_numpy(zero_copy_only=False), batch.column(0).offsets.to_numpy()
            offsets = offsets - offsets[0]
            edges = set()
            for a, b in zip(offsets, offsets[1:]):
                if b - a == 2:
                    x, y = flat[a], flat[a + 1]
                    if int(np.bitwise_count(np.uint64(int(x ^ y) & (2**64 - 1)))) <= bits:
                        edges.add((int(x), int(y)))
                else:
                    edges.update(forest(flat[a:b], None, bits))
            yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], names=["a", "b"])

    return map_batches(units, ["fps"], "a long, b long", run)


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """node, root (the least node reachable) for each end of an edge, by large-star and small-star rounds.

    Only counts come to the driver. Each round is written to the shared folder, so a lost executor costs a round at most.
    """
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "star-edges")
    before = None
    for _ in range(most_rounds):
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = written(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "star-low")
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        stars = written(large.where("a <> b").distinct(), "star-large")
        low = written(stars.groupBy("a").agg(F.min("b").alias("m")), "star-low")
        small = stars.join(low, "a").select("b", "m").unionByName(low.select(F.col("a").alias("b"), "m"))
        now = written(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "star-edges")
        state = now.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return now.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node").unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sets of hashes (sorted, distinct) share that part of their union."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1e-9:
        return False
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return shared >= similarity * (len(both) - shared) - 1e-9


def set_forest(roots: list[int], sketches: list[bytes], sets: list[bytes], need: int, similarity: float) -> set[tuple[int, int]]:
    """Edges between roots that connect just what all pairs of texts at this similarity do.

    Members of one root are connected already, so only candidates of different roots are verified.
    """
    table, roots = np.frombuffer(b"".join(sketches), np.uint8).reshape(len(roots), -1), np.array(roots, np.int64)
    own = [np.frombuffer(x, np.uint64) for x in sets]
    left, out, queue = np.arange(1, len(roots)), set(), [0]
    while len(left):
        if not queue:
            queue, left = [left[0]], left[1:]
        at = queue.pop()
        near = roots[left] == roots[at]
        for k in np.flatnonzero(~near & ((table[left] == table[at]).sum(1) >= need)):
            if near[k] or not alike(own[at], own[left[k]], similarity):
                continue
            out.add((int(roots[at]), int(roots[left[k]])))
            near |= roots[left] == roots[left[k]]
        queue.extend(left[near])
        left = left[~near]
    return out


def candidates(dealt: DataFrame, need: int) -> DataFrame:
    """k, v, i, j, t1, t2, root, sk of the members of each unit of dealt with a partner of another root whose sketch agrees."""
    grouped = dealt.groupBy("k", "v", "i", "j").agg(F.collect_set(F.struct("t1", "t2", "root", "sk")).alias("of"))
    grouped = grouped.where((F.size("of") > 1) & (F.array_min("of.root") < F.array_max("of.root")))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            at, rows = [], []
            for r in range(batch.num_rows):
                of = batch.column(4)[r].as_py()
                table, roots = np.frombuffer(b"".join(x["sk"] for x in of), np.uint8).reshape(len(of), -1), np.array([x["root"] for x in of], np.int64)
                marked = np.zeros(len(of), bool)
                for m in range(len(of) - 1):
                    near = ((table[m + 1 :] == table[m]).sum(1) >= need) & (roots[m + 1 :] != roots[m])
                    marked[m] |= near.any()
                    marked[m + 1 :] |= near
                found = np.flatnonzero(marked)
                at += [r] * len(found)
                rows += [of[m] for m in found]
            keys = [batch.column(c).take(pa.array(at, pa.int64())) for c in range(4)]
            fields = [pa.array([x[c] for x in rows], pa.binary() if c == "sk" else pa.int64()) for c in ("t1", "t2", "root", "sk")]
            yield pa.RecordBatch.from_arrays(keys + fields, names=["k", "v", "i", "j", "t1", "t2", "root", "sk"])

    return map_batches(grouped, ["k", "v", "i", "j", "of"], "k int, v long, i int, j int, t1 long, t2 long, root long, sk binary", run)


def set_links(dealt: DataFrame, sets: DataFrame, need: int, similarity: float) -> DataFrame:
    """Links (a, b) between roots found inside each unit (k, v, i, j) of dealt (t1, t2, root, sk), verified by sets."""
    found = written(candidates(dealt, need), "sketch-candidates")
    grouped = found.join(sets, ["t1", "t2"]).groupBy("k", "v", "i", "j").agg(F.collect_set(F.struct("root", "sk", "set")).alias("of"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            edges = set()
            for i in range(batch.num_rows):
                of = batch.column(0)[i].as_py()
                edges |= set_forest([x["root"] for x in of], [x["sk"] for x in of], [x["set"] for x in of], need, similarity)
            yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], names=["a", "b"])

    return map_batches(grouped, ["of"], "a long, b long", run)


def sketch_roots(marked: DataFrame, texts: DataFrame, roots: DataFrame, similarity: float, shingle: int, chunk: int = CHUNK) -> DataFrame:
    """node, root after joining components with texts (t1, t2, text) that share this part of their distinct shingles.

    A key looks only at members of several components. Those over chunk members are first dealt into chunks, each a unit;
    what then still has several components has its largest one's chunks, which hold no news among themselves, meet only the
    chunks of all others. So copies in any number cost rows in proportion, and no link is lost. Chunks hold fewer members
    where texts are long.
    """
    s = similarity - MARGIN
    need = math.ceil((s + (1 - s) / 256) * BANDS * ROWS)
    sketches = marked.where(F.size("ks") > 0).groupBy("t1", "t2").agg(F.first(F.struct("fp", "sk", "ks", "n")).alias("x"))
    sketches = written(sketches.select("t1", "t2", "x.*"), "sketches")

    def keyed(first: int, end: int) -> DataFrame:
        own = sketches.join(roots, sketches.fp == roots.node, "left").select("t1", "t2", "n", F.coalesce("root", "fp").alias("root"), F.slice("ks", first + 1, end - first).alias("ks"))
        return own.select("t1", "t2", F.col("n").alias("size"), "root", F.posexplode("ks").alias("k", "v")).withColumn("k", F.col("k") + first)

    def joined(found: DataFrame, keys: DataFrame) -> DataFrame:
        live = written(found.join(keys, ["k", "v"]), "sketch-live")
        return live.join(sketches.select("t1", "t2", "sk"), ["t1", "t2"])

    def grown(new: DataFrame) -> DataFrame:
        return written(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(written(new, "sketch-links"))), "sketch-roots")

    def chunks(n: str, size: str) -> Column:
        return F.greatest(F.ceil(F.col(n) / chunk), F.ceil(F.col(size) / SHINGLES)).cast("int")

    several = [F.count("*").alias("n"), F.sum("size").alias("size"), F.min("root").alias("low"), F.max("root").alias("high")]
    live = keyed(0, BANDS)
    live = live.join(live.groupBy("k", "v").agg(*several).where("low < high").select("k", "v"), ["k", "v"], "left_semi").select("t1", "t2").distinct()
    sets = written(shingle_sets(texts.groupBy("t1", "t2").agg(F.first("text").alias("text")).join(live, ["t1", "t2"], "left_semi"), shingle), "sketch-sets")
    for first, end in ((0, FIRST_BANDS), (FIRST_BANDS, BANDS)):
        keys = written(keyed(first, end).groupBy("k", "v").agg(*several).where("low < high").select("k", "v", chunks("n", "size").alias("n")), "sketch-keys")
        i = F.pmod(F.xxhash64("t1", "k"), F.col("n")).cast("int")
        roots = grown(set_links(joined(keyed(first, end), keys).withColumns({"i": i, "j": i}), sets, need, similarity))
    found = keyed(0, BANDS)
    hot = written(found.groupBy("k", "v").agg(*several).where((F.col("low") < F.col("high")) & (chunks("n", "size") > 1)).select("k", "v"), "sketch-hot")
    if hot.isEmpty():
        return roots
    sizes = written(found.join(hot, ["k", "v"]).groupBy("k", "v", "root").agg(F.count("*").alias("n"), F.sum("size").alias("size")), "sketch-sizes")
    parts = sizes.groupBy("k", "v").agg(F.max_by(F.struct("root", "size"), F.struct("n", "root")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("n"), F.sum("size").alias("size"))
    parts = parts.select("k", "v", "main.root", "most", F.col("main.size").alias("main_size"), (F.col("n") - F.col("most")).alias("rest"), (F.col("size") - F.col("main.size")).alias("rest_size"))
    parts = written(parts.select("k", "v", F.col("root").alias("main"), chunks("most", "main_size").alias("p"), chunks("rest", "rest_size").alias("m")), "sketch-parts")
    other = F.col("root") != F.col("main")
    place = F.xxhash64("t1", "k")
    own = F.when(other, F.pmod(place, F.col("m"))).otherwise(F.col("m") + F.pmod(place, F.col("p"))).cast("int")
    dealt = joined(found, parts).withColumn("own", own).withColumn("x", F.explode(F.sequence(F.lit(0), F.when(other, F.col("m") + F.col("p") - 1).otherwise(F.col("m") - 1))))
    return grown(set_links(dealt.withColumns({"i": F.least("own", "x"), "j": F.greatest("own", "x")}), sets, need, similarity))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, bits: int = 3, similarity: float | None = None, chunk: int = CHUNK, keyed: bool = False) -> DataFrame:
    """id, fp, component_id (the least id reachable over links, its own included) for each row.

    Links are fingerprints of up to so many differing bits and, if a similarity is given, texts that share that part of
    their distinct shingles. Sketches find these pairs (at 0.8 with probability 0.998), their sets of hashes verify them.

    With a similarity, keyed adds t1 and t2 (the text's key) and root, which tells components apart even without an id.

    Null texts and texts without words have fingerprint 0 and link like any other. A null id never becomes a component_id
    unless no row of the component has another. Repeated rows are one node and come back repeated; an empty table gives an
    empty one. Other columns are not read, so their names cannot clash.
    """
    marked = written(fingerprints(df, id_col, text_col, shingle, similarity is not None), "simhash")
    nodes = written(marked.groupBy("fp").agg(F.min("id").alias("least")), "simhash-nodes")
    roots = written(components(links(nodes.select("fp"), bits, chunk)), "simhash-roots")
    if similarity is not None:
        texts = df.select(F.col(text_col).alias("text")).select("text", *(v.alias(k) for k, v in text_key(F.col("text")).items()))
        roots = sketch_roots(marked, texts, roots, similarity, shingle, chunk)
    joined = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(joined.join(least, "root").select(F.col("fp").alias("node"), "component_id", "root"), "simhash-named")
    return marked.join(named, marked.fp == named.node, "left").select(F.col("id").alias(id_col), "fp", "component_id", *(["t1", "t2", "root"] if keyed else []))
