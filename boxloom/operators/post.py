"""After clustering: centers, significance, outliers, merges, exemplars."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxloom.functions.vectors import dot, unit_sums
from boxloom.operators.pairs import connected

# Scale of the significance score, least score and size of a cluster, share of boxes to keep, bounds of the merge cut.
SIGMA, LEAST_SCORE, LEAST_SIZE, KEEP, MERGE_LOW, MERGE_HIGH, MERGE_QUANTILE = 1.5, 0.725, 3, 0.975, 0.63, 0.69, 0.975


def _per_cluster(rows: DataFrame, cluster: str, center, share: bool) -> DataFrame:
    """(cluster, box_id, confidence, gap): distances to center(vectors) of the cluster, as a share of its largest or as they are.

    A cluster is one group: its boxes come from one video, which has some 4000.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        x = np.array(g["features"].tolist(), float)
        gap = np.sqrt(((x - center(x)) ** 2).sum(axis=1))
        if share:
            gap = gap / gap.max() if gap.max() > 0 else gap
        return pd.DataFrame({"cluster": g["cluster"], "box_id": g["box_id"], "confidence": g["confidence"], "gap": gap})

    kind = dict(rows.dtypes)[cluster]
    narrow = rows.select(F.col(cluster).alias("cluster"), "box_id", F.col("confidence").cast("double").alias("confidence"), "features")
    return narrow.groupBy("cluster").applyInPandas(run, f"cluster {kind}, box_id long, confidence double, gap double")


def significance(rows: DataFrame, cluster: str = "cluster") -> DataFrame:
    """cluster, box_id, distance (to the median, as a share of the cluster's largest), score."""
    out = _per_cluster(rows, cluster, lambda x: np.median(x, axis=0), True).withColumnRenamed("gap", "distance")
    return out.select("cluster", "box_id", "distance", F.sqrt(F.col("confidence") * F.exp(-F.pow(F.col("distance") / SIGMA, 2))).alias("score"))


def exemplars(scored: DataFrame) -> DataFrame:
    """Per cluster: size, median score, and the box nearest to the median (ties: smaller id)."""
    return scored.groupBy("cluster").agg(F.count("*").alias("size"), F.percentile("score", F.lit(0.5)).alias("score"), F.min(F.struct(F.round("distance", 9).alias("d"), "box_id"))["box_id"].alias("best_box"))


def drop_weak(labels: DataFrame, stats: DataFrame) -> DataFrame:
    """Boxes of clusters below LEAST_SCORE or LEAST_SIZE, and noise, get negative labels of their own."""
    out = labels.join(stats.select("cluster", "size", "score"), "cluster", "left")
    weak = (F.col("cluster") < 0) | (F.col("size") < LEAST_SIZE) | (F.col("score") < LEAST_SCORE)
    return out.select("box_id", F.when(F.coalesce(weak, F.lit(True)), -1 - F.col("box_id")).otherwise(F.col("cluster")).alias("cluster"))


def keep_share(labels: DataFrame, share: float = KEEP) -> DataFrame:
    """cluster, size, cumulative share by falling size, kept: up to `share`, or all of five clusters or fewer."""
    sizes = labels.where("cluster >= 0").groupBy("cluster").agg(F.count("*").alias("size"))
    w = Window.partitionBy(F.lit(1))
    upto = F.sum("size").over(w.orderBy(F.desc("size"), "cluster").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("size").over(w)
    return sizes.select("cluster", "size", upto.alias("share"), F.count("*").over(w).alias("_n")).withColumn("kept", (F.col("share") <= share) | (F.col("_n") <= 5)).drop("_n")


def cluster_similarity(rows: DataFrame, cluster: str = "cluster") -> DataFrame:
    """a, b (a < b), similarity: the mean cosine of their boxes, which is the dot product of mean unit vectors."""
    mean = unit_sums(rows.where(F.col(cluster) >= 0), cluster).select("c", F.transform("s", lambda x: x / F.col("n")).alias("u"))
    # a vector a cluster: all of them as one row
    every = mean.agg(F.collect_list(F.struct(F.col("c").alias("b"), F.col("u").alias("ub"))).alias("every"))
    both = mean.join(F.broadcast(every)).select(F.col("c").alias("a"), F.col("u").alias("ua"), F.explode("every").alias("o"))
    return both.where(F.col("a") < F.col("o.b")).select("a", "o.b", dot(F.col("ua"), F.col("o.ub")).alias("similarity"))


def merge_pairs(similarity: DataFrame, clusters: int) -> DataFrame:
    """The clusters // 2 most similar pairs that reach the cut: the 0.975 quantile of the full matrix, held to its bounds."""
    if clusters <= 1:
        raise ValueError("one cluster or none: nothing to merge")
    values = similarity.select(F.col("similarity").alias("s")).union(similarity.select("similarity"))
    spark = similarity.sparkSession
    values = values.union(spark.range(clusters).select(F.lit(0.0).alias("s")))
    cut = values.agg(F.greatest(F.lit(MERGE_LOW), F.least(F.lit(MERGE_HIGH), F.percentile("s", F.lit(MERGE_QUANTILE)))).alias("cut"))
    top = similarity.orderBy(F.desc(F.round("similarity", 9)), "a", "b").limit(clusters // 2)
    return top.join(F.broadcast(cut)).where("similarity >= cut").drop("cut")


def merge(labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """Labels after uniting merged clusters under the smallest."""
    to = connected(pairs, "a", "b")
    return labels.join(to, labels["cluster"] == to["id"], "left").select("box_id", F.coalesce("component", "cluster").alias("cluster"))


def drop_outliers(rows: DataFrame) -> DataFrame:
    """Per cluster, boxes whose score lies below max(q25 - iqr, 0) leave until none does; small rests dissolve.

    Boxes that leave get their own negative label. A cluster is one group: its boxes come from one video.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("box_id", ignore_index=True)
        x, conf, inside = np.array(g["features"].tolist(), float), g["confidence"].to_numpy(), np.ones(len(g), bool)
        while inside.sum() >= LEAST_SIZE:
            gap = np.linalg.norm(x[inside] - np.median(x[inside], axis=0), axis=1)
            score = np.sqrt(conf[inside] * np.exp(-((gap / gap.max() if gap.max() > 0 else gap) / SIGMA) ** 2))
            low, high = np.percentile(score, [25, 75])
            out = score < max(low - (high - low), 0)
            if not out.any():
                break
            inside[np.flatnonzero(inside)[out]] = False
        if inside.sum() < LEAST_SIZE:
            inside[:] = False
        return pd.DataFrame({"box_id": g["box_id"], "cluster": np.where(inside, g["cluster"], -1 - g["box_id"])})

    return rows.where("cluster >= 0").select("cluster", "box_id", "confidence", "features").groupBy("cluster").applyInPandas(run, "box_id long, cluster long")


def post_process(rows: DataFrame) -> DataFrame:
    """(box_id, cluster) after weak clusters went, outliers, small rests, again weak clusters, and similar clusters united.

    rows: box_id, cluster, confidence, features.
    """
    facts = rows.select("box_id", "confidence", "features")
    of = lambda lab: facts.join(lab, "box_id").where("cluster >= 0")
    strong = lambda lab: drop_weak(lab, exemplars(significance(of(lab)))).checkpoint()
    label = strong(rows.select("box_id", "cluster"))
    outlying = drop_outliers(of(label))
    label = outlying.unionByName(label.where("cluster < 0")).checkpoint()
    kept = keep_share(label).where("kept").select("cluster")
    label = label.join(kept.withColumn("k", F.lit(True)), "cluster", "left").select("box_id", F.when(F.col("k"), F.col("cluster")).otherwise(-1 - F.col("box_id")).alias("cluster")).checkpoint()
    label = strong(label)
    n = label.where("cluster >= 0").select("cluster").distinct().count()
    if n > 1:
        label = merge(label, merge_pairs(cluster_similarity(of(label)), n)).checkpoint()
    return label


def post_process_report(rows: DataFrame) -> DataFrame:
    """post_process, and for each box of a cluster its score and its cluster's size, median score and best box; null for others."""
    label = post_process(rows)
    scored = significance(rows.select("box_id", "confidence", "features").join(label, "box_id").where("cluster >= 0"))
    stats = exemplars(scored).select("cluster", "size", F.col("score").alias("cluster_score"), "best_box")
    return label.join(scored.select("box_id", "score"), "box_id", "left").join(stats, "cluster", "left").select("box_id", "cluster", "score", "size", "cluster_score", "best_box")


def nearest_to_mean(rows: DataFrame, cluster: str = "cluster") -> DataFrame:
    """(cluster, box_id, gap): the box nearest to the mean of its cluster, ties to the smaller id."""
    gap = _per_cluster(rows, cluster, lambda x: x.mean(axis=0), False)
    return gap.groupBy("cluster").agg(F.min(F.struct(F.round("gap", 9).alias("gap"), "box_id")).alias("m")).select("cluster", "m.box_id", "m.gap")


def best_thumbnails(scored: DataFrame, least: int = 5) -> DataFrame:
    """(cluster, best_box) of clusters that are no noise and have `least` boxes or more: the box nearest to the median."""
    return exemplars(scored.where("cluster >= 0")).where(F.col("size") >= least).select("cluster", "best_box")


def rooted_scores(rows: DataFrame, cluster: str = "cluster") -> DataFrame:
    """(cluster, box_id, score): the other form of the score, by the plain distance to the cluster's mean, with a second root."""
    gap = _per_cluster(rows, cluster, lambda x: x.mean(axis=0), False)
    return gap.select("cluster", "box_id", F.sqrt(F.sqrt(F.col("confidence") * F.exp(-F.pow(F.col("gap") / SIGMA, 2)))).alias("score"))
