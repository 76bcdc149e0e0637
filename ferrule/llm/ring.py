"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has a fixed number of cells; a virtual node stands at a cell's end. A row's cell comes from a hash of its id; its
first shard is that of the next virtual node clockwise. A shard takes no more than its capacity, the rows' number divided
evenly, and rows that find it full go on clockwise to the next virtual node whose shard has room. As capacities add up to the
rows, counts end at most one apart. Only rows per cell (CELLS numbers at most) come to the driver, which walks the ring over
these numbers; each row then needs just its rank in its cell. Cells are ranked in parts of bounded size, whose offsets are
prefix sums, and rows alike in all are one row with a count, so no cell or repeated row meets in one task.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrule.llm._shared import repeated, written

CELL_BITS = 13
CELLS = 1 << CELL_BITS
VIRTUAL = 64
#: Rows aimed at in a part of a cell.
PART_ROWS = 50_000


def nodes(shards: int, virtual: int = VIRTUAL) -> list[int]:
    """The shard at each cell's end, or -1; a virtual node whose cell is taken goes to the next free one."""
    if shards * virtual > CELLS:
        raise ValueError("more virtual nodes than cells")
    out = [-1] * CELLS
    for shard in range(shards):
        for k in range(virtual):
            at = int.from_bytes(hashlib.sha256(f"{shard}/{k}".encode()).digest()[:8], "big") % CELLS
            while out[at] >= 0:
                at = (at + 1) % CELLS
            out[at] = shard
    return out


def walk(counts: dict[int, int], shards: int, virtual: int = VIRTUAL) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, end rank, shard, first slot) for all rows, from the rows of each cell.

    In each round the waiting runs of rows, in ring order, fill the shard they stand at; what is left of a run goes on
    clockwise to a shard that still has room.
    """
    ring, total = nodes(shards, virtual), sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used, out = [0] * shards, []
    waiting = [(c, c, 0, n) for c, n in sorted(counts.items()) if n]
    while waiting:
        on = []
        for at, cell, begin, n in waiting:
            while ring[at] < 0 or not room[ring[at]]:
                at = (at + 1) % CELLS
            s = ring[at]
            take = min(room[s], n)
            out.append((cell, begin, begin + take, s, used[s]))
            room[s], used[s] = room[s] - take, used[s] + take
            if n > take:
                on.append((at, cell, begin + take, n - take))
        waiting = on
    return out


def assign(df: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", virtual: int = VIRTUAL) -> DataFrame:
    """Per row: id, size (UTF-8 bytes + 8), text_crc32, law ('rows'), shard, slot, grown_shard (null: its law is not by key).

    A null text has no bytes and CRC 0. Null and repeated ids hash with the text's CRC and size, so they spread unless the
    rows are the same in all; such rows share a place and are told apart by number. An empty table gives an empty one. Only
    two columns are read, so others' names cannot clash.
    """
    raw = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    light = df.select(F.col(id_col).alias("id"), (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("crc"))
    rows = written(light.groupBy("id", "size", "crc").agg(F.count("*").alias("n")).withColumn("place", F.xxhash64("id", "crc", "size")), "ring")
    extra = max(0, (rows.count() // (CELLS * PART_ROWS)).bit_length())
    own = rows.withColumn("part", F.shiftrightunsigned("place", 64 - CELL_BITS - extra)).withColumn("cell", F.shiftright("part", extra).cast("int"))
    parts = written(own.groupBy("cell", "part").agg(F.sum("n").alias("n")), "ring-parts")
    counts = {r.cell: r.n for r in parts.groupBy("cell").agg(F.sum("n").alias("n")).collect()}  # CELLS rows at most
    runs = json.dumps(walk(counts, shards, virtual))
    table = df.sparkSession.range(1).select(F.explode(F.from_json(F.lit(runs), "array<array<long>>")).alias("r"))
    table = table.select(*(F.col("r")[i].cast("int" if i in (0, 3) else "long").alias(c) for i, c in enumerate(("at", "begin", "end", "shard", "first"))))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.withColumn("offset", before(Window.partitionBy("cell").orderBy("part"))).select("part", "offset")
    ranked = own.withColumn("inside", before(Window.partitionBy("part").orderBy("place", "id", "crc", "size"))).join(offsets, "part")
    ranked = ranked.withColumn("low", F.col("offset") + F.col("inside")).withColumn("high", F.col("low") + F.col("n"))
    met = (F.col("cell") == F.col("at")) & (F.col("low") < F.col("end")) & (F.col("high") > F.col("begin"))
    joined = ranked.join(F.broadcast(table), met)  # bounded: a run for each cell and cut
    pieces = joined.select("id", "size", "crc", "shard", (F.col("first") + F.greatest("low", "begin") - F.col("begin")).alias("slot"), (F.least("high", "end") - F.greatest("low", "begin")).alias("n"))
    out = repeated(written(pieces, "ring-pieces"), "n", "k")
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").cast("long").alias("text_crc32"), F.lit("rows").alias("law"), "shard", (F.col("slot") + F.col("k")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
