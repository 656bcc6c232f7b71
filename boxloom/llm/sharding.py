"""Sharding (operator 5): histogram sort into shards of near equal bytes.

Rows are ordered by a 64-bit hash of their text, then by one of their id, then by one of their own. Probes cut that key space evenly; exact
bytes below each probe are counted over all partitions at once, and the probes move into the intervals that hold a
wanted boundary until each boundary meets the tolerance. Only then are rows exchanged, once. Equal texts share a
key, so a group of them is cut only where it is itself larger than the tolerance; there the second key decides, and
the third among rows that also share an id, or have none.
Native expressions throughout.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxloom.llm.common import staged, table

SHARDS = 24
#: A boundary may lie so far from its place, as a share of a shard; probes of an interval; rows of a slot window.
TOLERANCE, BITS, LANES = 0.005, 8, 1024
_SPAN = 1 << 64
_BIAS = 1 << 63


KEYS = ("h", "g", "r")


class Boundary:
    """The search for one splitter: keys in [low, high) of the column KEYS[len(prefix)], `below` bytes under low."""

    def __init__(self, goal: float):
        self.goal, self.prefix = goal, ()
        self.low, self.shift, self.below, self.done = 0, 64, 0, False
        self.cut: tuple[int, ...] = ()  # rows whose first keys are under it are below

    @property
    def spot(self) -> tuple:
        return self.prefix, self.low, self.shift


class Bin(NamedTuple):
    """What lies in one bin of an interval: bytes, rows, the least and the largest key."""

    size: int
    rows: int
    least: int
    most: int


def _settle(b: Boundary, bins: dict[int, Bin], tolerance: float) -> None:
    """Takes the exact contents by bin of the boundary's interval and narrows it to the bin that holds the goal.

    A bin of one row can't be cut; in one of a single key the next key decides at once.
    """
    step = 1 << (b.shift - BITS)
    upto = b.below
    at = 0
    for at in range(1 << BITS):
        size = bins[at].size if at in bins else 0
        if upto + size >= b.goal or at == (1 << BITS) - 1:
            break
        upto += size
    low, held = b.low + at * step, bins.get(at)
    size = held.size if held else 0
    near = (b.goal - upto, low) if b.goal - upto <= upto + size - b.goal else (upto + size - b.goal, low + step)
    last = len(b.prefix) + 1 == len(KEYS)
    single = held is None or held.least == held.most
    if near[0] <= tolerance or held is None or held.rows == 1 or (single and last):
        b.done, b.cut = True, (*b.prefix, near[1])
    elif single:
        b.prefix, b.low, b.shift, b.below = (*b.prefix, held.least), 0, 64, upto
    else:
        b.low, b.shift, b.below = low, b.shift - BITS, upto


def splitters(keys: DataFrame, shards: int, total: int) -> list[tuple[int, ...]]:
    """The boundaries between shards. keys: (h, g, r, size). Counts of at most shards * 2**BITS bins come to the driver a round."""
    found = [Boundary(total * i / shards) for i in range(1, shards)]
    while open_ := [b for b in found if not b.done]:
        counted: dict[tuple, dict[int, Bin]] = {b.spot: {} for b in open_}
        which = F.lit(None).cast("int")
        bins, key = F.lit(None).cast("long"), F.lit(None).cast("long")
        names = list(counted)
        for i, (prefix, low, shift) in enumerate(names):
            column = F.col(KEYS[len(prefix)])
            signed = low - _BIAS
            mine = F.lit(True)
            if shift < 64:
                mine = (column >= F.lit(signed)) & (column <= F.lit(signed + (1 << shift) - 1))
            for name, x in zip(KEYS, prefix, strict=False):
                mine = mine & (F.col(name) == F.lit(x - _BIAS))
            bits = F.shiftrightunsigned(column.bitwiseXOR(F.lit(-_BIAS)), shift - BITS).bitwiseAND(F.lit((1 << BITS) - 1))
            which = F.when(mine, F.lit(i)).otherwise(which)
            bins, key = F.when(mine, bits.cast("long")).otherwise(bins), F.when(mine, column).otherwise(key)
        inside = keys.select(which.alias("i"), bins.alias("bin"), key.alias("key"), "size").where("i is not null")
        rows = inside.groupBy("i", "bin").agg(F.sum("size").alias("size"), F.count("*").alias("rows"), F.min("key").alias("least"), F.max("key").alias("most")).collect()
        for r in rows:
            counted[names[r["i"]]][int(r["bin"])] = Bin(int(r["size"]), int(r["rows"]), r["least"] + _BIAS, r["most"] + _BIAS)
        for b in open_:
            _settle(b, counted[b.spot], TOLERANCE * total / shards)
    return sorted(b.cut for b in found)


def _at_least(cut: tuple[int, ...], names: tuple[str, ...]) -> Column:
    """Whether a row's keys are not under the cut, in order."""
    key, x = F.col(names[0]), cut[0]
    if x >= _SPAN:
        return F.lit(False)  # nothing lies above
    at = F.lit(x - _BIAS)
    if len(cut) == 1:
        return key >= at
    return (key > at) | ((key == at) & _at_least(cut[1:], names[1:]))


def histogram_shards(keys: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Adds shard (0 to shards - 1) and slot (from 0, without gaps) to rows with h, g, r (long hashes) and size (long >= 1).

    Shards are ranges of (h, g, r). Slots follow lanes of g and r within a shard. Only rows with all three keys equal
    can't be told apart and share a shard. Fewer rows than shards leave shards empty; so does an empty table.
    """
    total = keys.agg(F.sum("size").alias("s")).first()["s"] or 0
    cuts = splitters(keys, shards, int(total)) if total else []
    shard = F.lit(0)
    for cut in cuts:
        shard = shard + _at_least(cut, KEYS).cast("int")
    rows = keys.withColumn("shard", shard).withColumn("lane", F.pmod(F.xxhash64("g", "r"), F.lit(LANES)).cast("int"))
    sizes = rows.groupBy("shard", "lane").agg(F.count("*").alias("c"))  # shards * LANES rows at most
    before = F.sum("c").over(Window.partitionBy("shard").orderBy("lane")) - F.col("c")
    sizes = sizes.select("shard", "lane", before.alias("before"))
    rank = F.row_number().over(Window.partitionBy("shard", "lane").orderBy(*KEYS))
    rows = rows.withColumn("rank", rank.cast("long")).join(F.broadcast(sizes), ["shard", "lane"])
    return rows.withColumn("slot", F.col("before") + F.col("rank") - 1).drop("lane", "rank", "before")


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size: bytes of the text in UTF-8 (null: none) plus 8, so every row weighs something. A null text is not equal to
    an empty one; the crc32 of both is 0. Null and repeated ids are allowed: rows that repeat id and text are told
    apart by their place in the input, so that such a group, too, is cut where a boundary falls; which of its rows
    go to which side then depends on the input's files. A very long text is one row of its size, and a shard may
    exceed the others by as much. Ties have no meaning here. Other columns are not read.
    """
    text = F.col("text").cast("string")
    raw = F.coalesce(text.cast("binary"), F.lit(b""))
    size = (F.octet_length(raw) + 8).cast("long")
    g = F.xxhash64(F.col("doc_id").cast("long"), F.lit(9))
    r = F.xxhash64(F.monotonically_increasing_id(), F.lit(10))  # written once, so it stays
    keys = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), F.crc32(raw).alias("text_crc32"), F.xxhash64(text).alias("h"), g.alias("g"), r.alias("r")), "keys")
    out = histogram_shards(keys, shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op5_histogram_shards(spark, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
