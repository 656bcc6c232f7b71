"""Array functions against brute force."""

import random

from pyspark.sql import functions as F

from boxloom.functions import sequences
from boxloom.operators import detections


def brute(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b):
            row.append(min(last[j] + (x != y), last[j + 1] + 1, row[j] + 1))
        last = row
    return last[-1]


def test_edit_distance(spark):
    rng = random.Random(3)
    pick = lambda: [rng.choice([1, 2, 3, None]) for _ in range(rng.randrange(7))]
    rows = [(i, pick(), pick()) for i in range(60)] + [(90, [], []), (91, None, [1]), (92, [1], None)]
    df = spark.createDataFrame(rows, "i int, a array<int>, b array<int>")
    got = {r.i: r.d for r in df.select("i", sequences.edit_distance(F.col("a"), F.col("b")).alias("d")).collect()}
    assert got == {i: None if a is None or b is None else brute(a, b) for i, a, b in rows}


def test_arg_max_and_look_up(spark):
    df = spark.createDataFrame([(1, [0.5, 2.0, 2.0]), (2, []), (3, None)], "k int, v array<double>")
    got = df.select("k", sequences.arg_max(F.col("v")).alias("at"), sequences.look_up({1: "a"}, F.col("k"), "z").alias("name")).orderBy("k").collect()
    assert [tuple(r) for r in got] == [(1, 1, "a"), (2, None, "z"), (3, None, "z")]


def test_sample_is_stable(spark):
    df = spark.range(200)
    first = sorted(r.id for r in detections.sample_rows(df, "id", 20, 7).collect())
    again = sorted(r.id for r in detections.sample_rows(df.orderBy(F.desc("id")), "id", 20, 7).collect())
    assert first == again and len(set(first)) == 20
