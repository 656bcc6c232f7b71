"""Exact top-k inner products (operator 3): norm-sorted search with rotated partial sums.

Vectors are scored in whole numbers. Rows lie in blocks by descending length, queries in parts by length. Each part
meets the longest block first, which gives a query its floor: its k-th best score so far. A part and a block whose
longest vectors can't reach the part's floors are left out before any row is copied. In the others a batch of rows is
passed over once |query| * |longest row| is below the floor; else the first components in the basis of the data's
principal axes are summed, and only rows whose partial sum plus the Cauchy-Schwarz bound of the residuals reaches the
floor get their exact score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxloom.llm.common import small_batches, staged, table

K, SCALE, EVERY = 10, 1024, 100
#: Rows of a block, queries of a block, rows of a batch, share of axes in the partial sum.
BLOCK, QUERIES, BATCH, HEAD = 8192, 4096, 512, 0.25
#: Ratio between the steps of length by which parts and blocks are matched.
STEP = 1.01
_LIMIT = 1 << 62


def _whole(column: pa.ListArray, scale: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """floor(scale * x) of all components as binary rows, their number, lengths, and which rows take part."""
    flat = pc.fill_null(column.values, np.nan).to_numpy(zero_copy_only=False).astype(np.float64)
    at = column.offsets.to_numpy().astype(np.int64)
    with np.errstate(all="ignore"):
        flat = np.floor(flat * float(scale))
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))
    good = (bad[at[1:]] == bad[at[:-1]]) & column.is_valid().to_numpy(zero_copy_only=False)
    flat = np.where(np.isfinite(flat), flat, 0.0)
    with np.errstate(all="ignore"):
        square = np.array([flat[i:j] @ flat[i:j] for i, j in zip(at[:-1], at[1:], strict=True)])
    rows = pa.Array.from_buffers(pa.binary(), len(column), [None, pa.py_buffer((8 * at).astype(np.int32)), pa.py_buffer(flat)])
    return rows, np.diff(at), np.sqrt(square), good


def whole_vectors(df: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, dim, v (binary: float64 whole numbers), norm; without vectors that are null or hold a component that is null or not finite."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, dim, norm, good = _whole(b.column(1), scale)
            out = pa.RecordBatch.from_arrays([b.column(0), pa.array(dim, pa.int32()), rows, pa.array(norm, pa.float64())], names=["vec_id", "dim", "v", "norm"])
            yield out.filter(pa.array(good, pa.bool_()))

    return small_batches(df).mapInArrow(run, "vec_id long, dim int, v binary, norm double")


def _matrix(column, dim: int) -> np.ndarray:
    column = list(column)
    if all(len(x) == 8 * dim for x in column):
        return np.frombuffer(b"".join(column), np.float64).reshape(-1, dim)
    out = np.zeros((len(column), dim))
    for i, x in enumerate(column):
        out[i, : len(x) // 8] = np.frombuffer(x, np.float64)
    return out


def principal_axes(vectors: DataFrame, dim: int) -> np.ndarray:
    """The right singular vectors of all rows, by falling singular value: partial Gram matrices, summed."""

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for b in batches:
            m = _matrix(b.column(0).to_pylist(), dim)
            with np.errstate(all="ignore"):
                m = m / max(np.abs(m).max(initial=0), 1)
                total += m.T @ m
        at = np.arange(dim * dim)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total.reshape(-1))], names=["at", "x"])

    sums = vectors.select("v").mapInArrow(gram, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).toPandas()  # dim * dim rows
    g = np.zeros(dim * dim)
    g[sums["at"]] = sums["x"]
    return np.linalg.eigh(g.reshape(dim, dim))[1][:, ::-1]


def exact_scores(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Whole inner products; in float64 or int64 where these hold every partial sum, else in whole numbers of any size, held to 64 bits."""
    most = np.abs(q).max(initial=0) * np.abs(rows).max(initial=0) * max(q.shape[-1], 1)
    if most < 1 << 53:
        return (rows @ q).astype(np.int64)
    if most < _LIMIT:
        return rows.astype(np.int64) @ q.astype(np.int64)
    big = [sum(int(a) * int(b) for a, b in zip(r, q, strict=True)) for r in rows]
    return np.array([max(-(1 << 63), min((1 << 63) - 1, x)) for x in big], np.int64)


def search_block(queries: pd.DataFrame, rows: pd.DataFrame, axes: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Up to k best (query, row, score) of each query in a block of rows, none below the query's floor."""
    dim, head = len(axes), max(1, int(len(axes) * HEAD))
    rows = rows.sort_values("norm", ascending=False, kind="stable", ignore_index=True)
    a, b = _matrix(queries["v"], dim), _matrix(rows["v"], dim)
    ra, rb = a @ axes, b @ axes
    na, nb, ids, own = queries["norm"].to_numpy(), rows["norm"].to_numpy(), rows["vec_id"].to_numpy(), queries["vec_id"].to_numpy()
    ta, tb = np.sqrt((ra[:, head:] ** 2).sum(axis=1)), np.sqrt((rb[:, head:] ** 2).sum(axis=1))
    floor = queries["floor"].to_numpy(np.float64, na_value=-np.inf).copy()
    best: list[list[tuple[int, int]]] = [[] for _ in own]  # (-score, row id)
    for at in range(0, len(rows), BATCH):
        part = slice(at, at + BATCH)
        slack = 1e-9 * (na * nb[at] + 1)  # of sums in floating point
        live = np.flatnonzero(na * nb[at] + slack >= floor)
        if not len(live):
            break  # rows only get shorter
        bound = ra[live, :head] @ rb[part, :head].T + np.outer(ta[live], tb[part]) + slack[live, None]
        for j, hit in zip(live, bound >= floor[live, None], strict=True):
            spots = np.flatnonzero(hit) + at
            spots = spots[ids[spots] != own[j]]
            if not len(spots):
                continue
            score = exact_scores(a[j], b[spots])
            keep = score >= floor[j]
            best[j].extend(zip((-score[keep]).tolist(), ids[spots[keep]].tolist(), strict=True))
            if len(best[j]) > k:
                best[j].sort()
                del best[j][k:]
            if len(best[j]) == k:
                floor[j] = max(floor[j], -max(best[j])[0])
    return [(int(own[j]), i, -s) for j, found in enumerate(best) for s, i in found]


def top_k(df: DataFrame, k: int = K, scale: int = SCALE, every: int = EVERY) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's k largest inner products among all other rows.

    Queries: rows whose vec_id is divisible by `every`; of rows that share such an id, the smallest vector asks. A
    row of the query's id is never its result; other repeated rows are results of their own. Ties go to the smaller
    vec_id. Vectors of different dimension are filled up with zeros. Rows with a null vec_id take no part. Scores
    beyond 64 bits are held to them.
    """
    vectors = staged(whole_vectors(df.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).where("vec_id is not null"), scale), "vectors")
    facts = vectors.agg(F.max("dim").alias("dim"), F.count("*").alias("n"), F.sum((F.col("vec_id") % every == 0).cast("int")).alias("q")).first()
    spark = df.sparkSession
    if not facts["q"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim = max(facts["dim"], 1)
    axes = principal_axes(vectors, dim)
    blocks, parts = -(-facts["n"] // BLOCK), -(-facts["q"] // QUERIES)
    rows = _by_length(vectors, blocks, "block")
    asks = vectors.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("v", "norm")).alias("x"))
    asks = _by_length(asks.select("vec_id", "x.v", "x.norm"), parts, "part")
    longest = rows.agg(F.min("block").alias("b")).first()["b"]
    places = asks.select("part").distinct().withColumn("block", F.lit(longest))
    found = staged(_search(asks.withColumn("floor", F.lit(None).cast("double")), rows.where(F.col("block") == longest), places, axes, k), "first")
    floors = found.groupBy("query_id").agg(F.count("*").alias("c"), F.min("score").alias("m")).where(F.col("c") >= k)
    asks = asks.join(floors.select(F.col("query_id").alias("vec_id"), F.col("m").cast("double").alias("floor")), "vec_id", "left")
    rest = rows.where(F.col("block") != longest)
    found = found.union(_search(asks, rest, reachable(asks, rest), axes, k))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _by_length(df: DataFrame, n: int, name: str) -> DataFrame:
    """Vectors with the number, from 0 to n - 1 at most, of a range of them by falling length; written once, so it stays."""
    ranged = df.repartitionByRange(n, F.desc("norm"), "vec_id").withColumn(name, F.spark_partition_id())
    ranged = staged(ranged.select(name, "vec_id", "v", "norm"), f"{name}s")
    most = (ranged.agg(F.max(name).alias("m")).first()["m"] or 0) + 1  # a session may deal out more ranges than asked for
    return ranged if most <= n else ranged.withColumn(name, F.floor(F.col(name) * n / most).cast("int"))


def reachable(asks: DataFrame, rows: DataFrame) -> DataFrame:
    """(part, block): pairs in which the longest row may reach the floor of some query.

    A query needs rows of length floor / |query| at least, less the slack of sums in floating point. Lengths are rounded
    to steps of STEP, blocks up and needs down; a part asks for the steps from its least need to the longest row, and an
    equal step joins it with blocks.
    """
    step = lambda x: F.when(x > 1, F.log(x) / float(np.log(STEP))).otherwise(0.0)
    need = F.floor(step(F.col("floor") / F.greatest("norm", F.lit(1.0)) * (1 - 1e-6) - 1)).cast("long")
    block = rows.groupBy("block").agg(F.ceil(step(F.max("norm"))).cast("long").alias("has"))
    block = staged(block, "lengths")
    top = block.agg(F.max("has").alias("t")).first()["t"] or 0
    part = asks.groupBy("part").agg(F.min(need).alias("need")).where(F.col("need") <= top)
    part = part.select("part", F.explode(F.sequence("need", F.lit(top).cast("long"))).alias("has"))
    return part.join(block, "has").select("part", "block")


def _search(asks: DataFrame, rows: DataFrame, places: DataFrame, axes: np.ndarray, k: int) -> DataFrame:
    """Parts of queries against blocks of rows, as places say, in one task each."""
    places = staged(places, "places")
    left = rows.join(places, "block").select("part", "block", "vec_id", "v", "norm")
    right = asks.select("part", "vec_id", "v", "norm", "floor").join(places, "part")
    right = right.select(*[F.col(c).alias(c) for c in ("part", "block", "vec_id", "v", "norm", "floor")])  # columns of its own

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = search_block(a, b, axes, k) if len(a) and len(b) else []
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    key = ["part", "block"]
    return right.groupBy(*key).cogroup(left.groupBy(*key)).applyInPandas(run, "query_id long, vec_id long, score long")


def op3_exact_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


SQL = """
WITH v AS (SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS w FROM embeddings
           WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([q.w[i] * c.w[i] FOR i IN range(1, len(q.w) + 1)]) AS BIGINT) AS score
      FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
