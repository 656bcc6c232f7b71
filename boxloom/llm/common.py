"""Shared pieces of the training-data operators: the shared work folder and vectorised word hashing."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_root: list[str] = []


def work_root(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one of our own where it is unset and all runs on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _own_root:
            _own_root.append(tempfile.mkdtemp(prefix="boxloom-"))
            atexit.register(shutil.rmtree, _own_root[0], ignore_errors=True)
            spark.sparkContext.setCheckpointDir(_own_root[0])
        root = _own_root[0]
    return root.rstrip("/")


#: Bounds of what one Arrow batch of long texts takes outside the heap.
_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def small_batches(df: DataFrame) -> DataFrame:
    """Lowers the bounds of Arrow batches of df's session to _BATCH where they are above; returns df.

    Results are evaluated after an operator returns, so the settings stay; they change no result.
    """
    conf = df.sparkSession.conf
    for key, most in _BATCH.items():
        now = conf.get(key, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= int(most):
            conf.set(key, most)
    return df


_used: list[str] = []


def work_path(spark: SparkSession, label: str) -> str:
    _used.append(f"{work_root(spark)}/boxloom/{label}-{uuid.uuid4().hex}")
    return _used[-1]


def release(spark: SparkSession) -> None:
    """Deletes the work tables that this process has written so far: call it when all results that read them are written."""
    jvm = spark._jvm
    while _used:
        path = jvm.org.apache.hadoop.fs.Path(_used.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Writes df as a table in the shared folder and reads it again: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = work_path(spark, label)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def same(a: Column, b: Column) -> Column:
    """Null-safe equality; Spark still plans a hash or merge join for it."""
    return a.eqNullSafe(b)


def text_hash() -> Column:
    """A hash of the text (64 bits), which tells rows that share a doc_id, or have none, apart."""
    return F.xxhash64(F.col("text").cast("string")).alias("text_hash")


#: Bits of a sieve: its size does not grow with the data (SIEVE_BITS / 64 rows of two longs at most).
SIEVE_BITS = 1 << 26


def sieve(df: DataFrame, ids: DataFrame, column: str, inside: bool = True) -> DataFrame:
    """Rows of df whose long `column` may be among ids (inside), or those where it surely is not.

    A bitmap of hashes, joined by broadcast since its size is fixed; for use ahead of an exact join, which then moves
    fewer rows. With many millions of ids nearly all rows may be inside; no result depends on that.
    """
    spot = lambda c: F.pmod(F.xxhash64(c.cast("long"), F.lit(1)), F.lit(SIEVE_BITS))
    found = ids.select(spot(F.col(ids.columns[0])).alias("spot"))
    bit = F.bit_or(F.expr("shiftleft(1L, cast(spot & 63 as int))"))
    words = found.groupBy(F.shiftright("spot", 6).alias("_word")).agg(bit.alias("_bits"))
    out = df.withColumn("_spot", spot(F.col(column)))
    out = out.join(F.broadcast(words), F.shiftright("_spot", 6) == F.col("_word"), "left")
    hit = F.coalesce(F.expr("shiftright(_bits, cast(_spot & 63 as int)) & 1"), F.lit(0)) == 1
    return out.where(hit if inside else ~hit).select(*df.columns)


#: ASCII white space, the separators of `[^\x20\x09-\x0D]+`.
WORD = r"[^\x20\x09-\x0D]+"
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PIECE = 1 << 20
_U = np.uint64
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the constants are those of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", _INV)):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            _powers[name] = np.multiply.accumulate(step)
    return _powers["up"][:n], _powers["down"][:n]


def _hash_piece(raw: bytes) -> np.ndarray:
    a = np.frombuffer(raw, np.uint8)
    edge = np.diff(np.concatenate(([0], (~_SPACE[a]).view(np.int8), [0])))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _power(len(a) + 1)
    total = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_BYTE[a] * up[: len(a)], out=total[1:])
    return mix((total[end] - total[start]) * down[start])


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word of UTF-8 bytes, in order; long texts go through in pieces cut at white space."""
    if len(raw) <= _PIECE:
        return _hash_piece(raw)
    parts, at = [], 0
    while at < len(raw):
        end = min(at + _PIECE, len(raw))
        while end < len(raw) and not _SPACE[raw[end]]:
            end += 1
        parts.append(_hash_piece(raw[at:end]))
        at = end
    return np.concatenate(parts)


def windows(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each n-word window."""
    count = len(words) - n + 1
    out = mix(words[:count])
    for i in range(1, n):
        out = mix(out * _U(0x9E3779B97F4A7C15) + words[i : i + count])
    return out


def window3(words: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each three-word window."""
    return windows(words, 3)
