"""Mixing sources to target weights (operator 7): subset-sum budget fitting.

Each source's target is met by whole copies of all its documents and a subset for the rest of the budget. The
subset is planned on the source's histogram of exact lengths: every length gives its proportional share, and a
bounded-knapsack dynamic programme fits what is left. Documents are then chosen by length count in seeded order.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxloom.llm.common import WORD, same, staged, table, text_hash

#: Weights by the sources' order, repeating; words to take in all as a share of the words there; copies at most.
WEIGHTS, SHARE, COPIES = (5, 2, 1), Fraction(3, 2), 2
SEED = 17
#: Words that the dynamic programme is left to fit, beside one longest document: its table's size. Proportional shares, and
#: one more of the lengths that they round down most, come this near a budget, so with any REST the words taken differ from
#: it by half a longest document at most where that many documents are left. Documents of a rank window.
REST, WINDOW = 1 << 16, 1000


def targets(sizes: list[int], weights: list[int], share: Fraction = SHARE, copies: int = COPIES) -> list[float]:
    """Water filling: shares by weight, no source above `copies` times its size, the excess shared again.

    Sources fill up in order of their size by weight, so one pass in that order finds those that are full.
    """
    rest, by, out = share * sum(sizes), sum(weights), [0.0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: Fraction(sizes[i], weights[i])):
        part = min(rest * weights[i] / by, Fraction(copies * sizes[i]))
        out[i], rest, by = float(part), rest - part, by - weights[i]
    return out


def knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length to take so that the sum is as near the budget as a 0/1 programme over them comes.

    Lengths are tried from the longest; counts are split into powers of two. Ends at the first exact sum.
    """
    take = np.zeros(len(lengths), np.int64)
    if budget <= 0:
        return take
    top = int(budget + min(lengths.max(initial=0), budget))  # a sum just above may be nearer
    reached = np.zeros(top + 1, bool)
    reached[0] = True
    via = np.full(top + 1, -1, np.int32)
    items: list[tuple[int, int]] = []
    for i in np.argsort(-lengths, kind="stable"):
        length, left, lot = int(lengths[i]), int(min(counts[i], top // lengths[i])), 1
        while left > 0 and not reached[budget]:
            lot = min(lot, left)
            weight = lot * length
            new = np.zeros(top + 1, bool)
            new[weight:] = reached[: top + 1 - weight]
            new &= ~reached
            via[new] = len(items)
            reached |= new
            items.append((int(i), lot))
            left, lot = left - lot, lot * 2
        if reached[budget]:
            break
    sums = np.flatnonzero(reached)
    at = int(sums[np.argmin(np.abs(sums - budget))])
    while at:
        i, lot = items[via[at]]
        take[i] += lot
        at -= lot * int(lengths[i])
    return take


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Documents to take of each length for a budget of at most the sum of all."""
    total = int((lengths * counts).sum())
    if total <= 0 or budget <= 0:
        return np.zeros(len(lengths), np.int64)
    exact = [Fraction(int(c) * budget, total) for c in counts]
    take = np.array([int(x) for x in exact], np.int64)
    rest = budget - int((take * lengths).sum())
    if rest > REST:  # one more of the lengths with the largest remainders
        order = np.argsort([-float(x - int(x)) for x in exact], kind="stable")
        order = order[take[order] < counts[order]]
        upto = np.cumsum(lengths[order])
        more = order[: int(np.searchsorted(upto, rest - REST // 2, side="right"))]
        take[more] += 1
        rest = budget - int((take * lengths).sum())
    return take + knapsack(lengths, counts - take, rest)


def _plan(group: pd.DataFrame) -> pd.DataFrame:
    """group: a source's histogram (size, n) with its budget; adds extra, the documents of a size to take once more."""
    group = group.sort_values("size", ignore_index=True)
    group["extra"] = fit(group["size"].to_numpy(np.int64), group["n"].to_numpy(np.int64), int(group["budget"].iloc[0]))
    return group[["source", "size", "n", "extra"]]


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, copies, taken, text_hash.

    size is the number of words (null text: 0); a document without words is taken 0 words. A null source is a
    source, the last. Repeated rows count as documents of their own; the seeded order is by doc_id, so among
    equal rows any may be chosen. An empty table gives an empty result. Other columns are not read.
    """
    words = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    base = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words.alias("size"), text_hash()), "sizes")
    hist = staged(base.groupBy("source", "size").agg(F.count("*").alias("n")), "lengths")
    spark = base.sparkSession
    # one row per source comes to the driver, and nothing else
    found = sorted(((r["source"], r["s"]) for r in hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("s")).collect()), key=lambda r: (r[0] is None, (r[0] or "").encode()))
    sizes = [s for _, s in found]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))]) if sizes else []
    rows = [(name, s, t, *(divmod(round(t), s) if s else (0, 0))) for (name, s), t in zip(found, goal, strict=True)]
    goals = spark.createDataFrame(rows, "_source string, source_size long, target double, whole long, budget long")
    with_goal = hist.join(goals, same(hist["source"], goals["_source"]))
    plan = with_goal.where("size > 0").select("source", "size", "n", "budget").groupBy("source").applyInPandas(_plan, "source string, size long, n long, extra long")
    plan = staged(plan, "plan").select(F.col("source").alias("_s"), F.col("size").alias("_z"), "n", "extra")
    out = base.join(plan, same(base["source"], plan["_s"]) & (base["size"] == plan["_z"]), "left").drop("_s", "_z")
    # seeded rank within (source, size), in windows of about WINDOW rows
    out = out.withColumn("extra", F.coalesce("extra", F.lit(0))).withColumn("n", F.coalesce("n", F.lit(0)))
    some = out.where("extra > 0 and extra < n").withColumn("draw", F.xxhash64(F.lit(seed), "doc_id"))
    some = some.withColumn("sub", F.pmod(F.col("draw"), F.ceil(F.col("n") / WINDOW)).cast("long"))
    subs = some.where(F.col("n") > WINDOW).groupBy("source", "size", "sub").agg(F.count("*").alias("c"))
    before = F.sum("c").over(Window.partitionBy("source", "size").orderBy("sub")) - F.col("c")
    subs = subs.select(F.col("source").alias("_s"), F.col("size").alias("_z"), F.col("sub").alias("_b"), before.alias("before"))
    rank = F.row_number().over(Window.partitionBy("source", "size", "sub").orderBy("draw", "doc_id"))
    some = some.withColumn("rank", rank)
    some = some.join(subs, same(some["source"], subs["_s"]) & (some["size"] == subs["_z"]) & (some["sub"] == subs["_b"]), "left")
    some = some.select("doc_id", "source", "size", "text_hash", (F.col("rank") + F.coalesce("before", F.lit(0)) <= F.col("extra")).cast("long").alias("once"))
    rest = out.where("extra = 0 or extra >= n").select("doc_id", "source", "size", "text_hash", (F.col("extra") > 0).cast("long").alias("once"))
    out = some.unionByName(rest)
    out = out.join(goals, same(out["source"], goals["_source"]))
    copies = F.col("whole") + F.col("once")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "text_hash")


def op7_source_mix(spark, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
