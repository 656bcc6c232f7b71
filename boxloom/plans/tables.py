"""Detection tables made from the driver's `embeddings`, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_SPARK = """vec_id AS box_id, vec_id div 40 AS shot_id, (vec_id % 40) div 4 AS frame, vec_id % 4 AS slot,
lpad(CAST((vec_id div 40) * 10 + (vec_id % 40) div 4 AS STRING), 6, '0') AS keyframe_id,
concat('t', lpad(CAST(vec_id AS STRING), 6, '0')) AS thumbnail_id,
10 + 72 * (CASE WHEN vec_id % 4 = 3 AND (vec_id div 40) % 2 = 1 THEN 2 ELSE vec_id % 4 END) + 2 * ((vec_id % 40) div 4) + (vec_id * 7) % 5 AS x,
20 + 10 * (CASE WHEN vec_id % 4 = 3 AND (vec_id div 40) % 2 = 1 THEN 2 ELSE vec_id % 4 END) + (vec_id * 13) % 7 AS y,
40 + (vec_id * 11) % 25 AS w, 50 + (vec_id * 17) % 30 AS h, (30 + (vec_id * 29) % 69) / CAST(100 AS DOUBLE) AS confidence,
CAST(label AS BIGINT) AS character, vec_id % 12 - 2 AS cluster, CAST(embedding AS ARRAY<DOUBLE>) AS features"""
#: A common table expression to put before a query.
SQL = "WITH RECURSIVE boxes AS MATERIALIZED (SELECT " + _SPARK.replace(" div ", " // ").replace("AS STRING", "AS VARCHAR").replace("ARRAY<DOUBLE>", "DOUBLE[]") + " FROM embeddings)"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").selectExpr(*_columns())


def _columns() -> list[str]:
    out, depth, start = [], 0, 0
    for i, ch in enumerate(_SPARK):
        depth += (ch in "(<") - (ch in ")>")
        if ch == "," and not depth:
            out.append(_SPARK[start:i])
            start = i + 1
    return [*out, _SPARK[start:]]
