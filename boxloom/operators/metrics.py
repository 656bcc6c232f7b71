"""Metrics of clustering, detection and classification."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxloom.functions.vectors import dot, unit, unit_sums


def contingency(rows: DataFrame, truth: str = "truth", cluster: str = "cluster") -> DataFrame:
    return rows.groupBy(F.col(truth).alias("truth"), F.col(cluster).alias("cluster")).agg(F.count("*").alias("n"))


def clustering_scores(table: DataFrame) -> DataFrame:
    """One row of scores from a contingency table (truth, cluster, n). Zero denominators give 1 where all agree by definition."""
    c, y, one = Window.partitionBy("cluster"), Window.partitionBy("truth"), Window.partitionBy(F.lit(1))
    t = table.select("truth", "cluster", F.col("n").cast("double").alias("n"))
    by_c = t.groupBy("cluster").agg(F.sum("n").alias("n"), F.max("n").alias("m"), F.sum(F.col("n") * F.col("n")).alias("q"))
    by_y = t.groupBy("truth").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("q"))
    pairs = lambda x: x * (x - 1) / 2
    a = by_c.agg(F.sum("n").alias("n"), F.sum("m").alias("best"), F.avg(F.col("m") / (F.col("n") + 1e-5)).alias("accuracy"), F.sum(F.col("q") / F.col("n")).alias("acp"), F.sum(pairs(F.col("n"))).alias("pair_c"), F.sum(F.col("n") * F.log("n")).alias("lc"), F.count("*").alias("k"))
    b = by_y.agg(F.sum(F.col("q") / F.col("n")).alias("aep"), F.sum(pairs(F.col("n"))).alias("pair_y"), F.sum(F.col("n") * F.log("n")).alias("ly"), F.count("*").alias("classes"))
    d = t.agg(F.sum(pairs(F.col("n"))).alias("pair_b"), F.sum(F.col("n") * F.log("n")).alias("lb"))
    s = a.join(F.broadcast(b)).join(F.broadcast(d))  # one row each
    n = F.col("n")
    h_c, h_y, mi = F.log(n) - F.col("lc") / n, F.log(n) - F.col("ly") / n, F.log(n) + (F.col("lb") - F.col("lc") - F.col("ly")) / n
    s = s.withColumn("homogeneity", F.when(h_y < 1e-12, 1.0).otherwise(mi / h_y)).withColumn("completeness", F.when(h_c < 1e-12, 1.0).otherwise(mi / h_c))
    both = F.col("homogeneity") + F.col("completeness")
    expected = F.col("pair_c") * F.col("pair_y") / pairs(n)
    top = (F.col("pair_c") + F.col("pair_y")) / 2
    acp, aep = F.col("acp") / n, F.col("aep") / n
    s = s.select(
        (F.col("best") / n).alias("purity"),
        "accuracy",
        F.sqrt(acp * aep).alias("itzi_k"),
        (2 * acp * aep / (acp + aep)).alias("f_score"),
        "homogeneity",
        "completeness",
        F.when(both < 1e-12, 0.0).otherwise(2 * F.col("homogeneity") * F.col("completeness") / both).alias("v_measure"),
        F.when(F.abs(top - expected) < 1e-12, 1.0).otherwise((F.col("pair_b") - expected) / (top - expected)).alias("adjusted_rand"),
        F.when(h_c + h_y < 1e-12, 1.0).otherwise(2 * mi / (h_c + h_y)).alias("nmi"),
        (F.col("k") - F.col("classes")).alias("k_error"),
        "k",
    )
    # a single cluster can't be scored: all its scores are 1
    return s.select(*[c if c == "k_error" else F.when(F.col("k") == 1, 1.0).otherwise(F.col(c)).alias(c) for c in s.columns if c != "k"])


def evaluation_row(rows: DataFrame, name: str, truth: str = "truth", cluster: str = "cluster") -> DataFrame:
    """One row for one file: its name, clusters, noise (boxes of a negative cluster) and its share in percent, all scores, and silhouette.

    Scores and silhouette are of all boxes, noise as one cluster a label.
    """
    noise = F.sum((F.col(cluster) < 0).cast("long"))
    k = F.count_distinct(F.when(F.col(cluster) >= 0, F.col(cluster)))
    counts = rows.agg(k.alias("k"), noise.alias("noise_count"), (100.0 * noise / F.count("*")).alias("p_noise"))
    scores = clustering_scores(contingency(rows, truth, cluster))
    return counts.join(F.broadcast(scores)).join(F.broadcast(silhouette(rows, cluster))).select(F.lit(name).alias("video_name"), "*")  # one row each


def adjusted_mutual_info(table: DataFrame) -> float:
    """Mutual information adjusted for chance, arithmetic mean of entropies; from the table's margins (classes x clusters) on the driver."""
    t = table.toPandas().pivot_table(index="truth", columns="cluster", values="n", aggfunc="sum", fill_value=0).to_numpy(float)
    a, b, n = t.sum(axis=1), t.sum(axis=0), t.sum()
    entropy = lambda x: -sum(v / n * math.log(v / n) for v in x if v)
    mi = sum(t[i, j] / n * math.log(n * t[i, j] / (a[i] * b[j])) for i in range(len(a)) for j in range(len(b)) if t[i, j])
    # logarithms of factorials by running sums; the terms of a pair of margins are summed as one array
    fact = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, int(n) + 1)))))
    expected = 0.0
    for x in a.astype(int):
        for y in b.astype(int):
            k = np.arange(max(1, x + y - int(n)), min(x, y) + 1)
            base = fact[x] + fact[y] + fact[int(n) - x] + fact[int(n) - y] - fact[int(n)]
            p = np.exp(base - fact[k] - fact[x - k] - fact[y - k] - fact[int(n) - x - y + k])
            expected += float((k / n * np.log(n * k / (float(x) * y)) * p).sum())
    span = (entropy(a) + entropy(b)) / 2 - expected
    return 1.0 if abs(span) < 1e-15 else float((mi - expected) / span)


def silhouette(rows: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Mean cosine silhouette in one pass: the mean cosine to a cluster is the cosine part of its mean unit vector."""
    sums = unit_sums(rows, cluster)
    every = sums.agg(F.collect_list(F.struct("c", "n", "s")).alias("every"))  # a vector a cluster, all as one row
    each = rows.select("box_id", F.col(cluster).alias("own"), unit(F.col("features").cast("array<double>")).alias("u")).join(F.broadcast(every))
    each = each.select("box_id", "own", "u", F.explode("every").alias("o")).select("box_id", "own", "o.c", "o.n", dot(F.col("u"), F.col("o.s")).alias("dot"))
    own = F.when(F.col("own") == F.col("c"), F.when(F.col("n") > 1, 1 - (F.col("dot") - 1) / (F.col("n") - 1)))
    far = F.when(F.col("own") != F.col("c"), 1 - F.col("dot") / F.col("n"))
    each = each.groupBy("box_id").agg(F.min(own).alias("a"), F.min(far).alias("b"))
    s = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return each.agg(F.avg(s).alias("silhouette"))


def confusion(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """truth, predicted, n, and n as a share of the truth's rows."""
    n = rows.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("truth")))


def accuracy(matrix: DataFrame) -> DataFrame:
    """One row: the share of a confusion matrix on its diagonal."""
    hit = F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0))
    return matrix.agg((hit / F.sum("n")).alias("accuracy"))


def detection_grid(candidates: DataFrame, truth: DataFrame, found: DataFrame, frame: str, ious: list[float], confidences: list[float]) -> DataFrame:
    """(min_iou, min_confidence, precision, recall) for each pair of thresholds; matching is greedy within a frame.

    candidates: (frame, a, b, iou, confidence of b); truth, found: one row per box, found with its confidence.
    """
    grid = lambda c, values: F.explode(F.array(*[F.lit(float(v)) for v in values])).alias(c)
    least = candidates.select("*", grid("min_iou", ious)).select("*", grid("min_confidence", confidences))
    least = least.where((F.col("iou") >= F.col("min_iou")) & (F.col("confidence") >= F.col("min_confidence")))
    place = F.concat_ws("|", frame, F.col("min_iou").cast("string"), F.col("min_confidence").cast("string"))
    hit = match_boxes(least.withColumn("_place", place), "_place").select(F.split("_place", r"\|").alias("_p"))
    hit = hit.groupBy(F.element_at("_p", -2).cast("double").alias("min_iou"), F.element_at("_p", -1).cast("double").alias("min_confidence")).agg(F.count("*").alias("hit"))
    said = found.select("confidence", grid("min_confidence", confidences)).where(F.col("confidence") >= F.col("min_confidence")).groupBy("min_confidence").agg(F.count("*").alias("said"))
    all_ = truth.agg(F.count("*").alias("there")).select("there", grid("min_iou", ious)).select("*", grid("min_confidence", confidences))  # a row a pair of thresholds
    out = all_.join(hit, ["min_iou", "min_confidence"], "left").join(said, "min_confidence", "left")
    ratio = lambda b: F.coalesce(F.try_divide(F.coalesce("hit", F.lit(0)).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return out.select("min_iou", "min_confidence", ratio("said").alias("precision"), ratio("there").alias("recall"))


def running_mean(rows: DataFrame, key: str, order: str, value: str, weight: str) -> DataFrame:
    """rows with running_mean: the weighted mean of a key's values up to each row."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running_mean", F.sum(F.col(value) * F.col(weight)).over(w) / F.sum(weight).over(w))


def classification_report(matrix: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of each class of a confusion matrix; 0 where undefined."""
    hit = F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)).alias("tp")
    t = matrix.groupBy(F.col("truth").alias("class")).agg(F.sum("n").alias("support"), hit)
    p = matrix.groupBy(F.col("predicted").alias("class")).agg(F.sum("n").alias("claimed"))
    out = t.join(p, "class", "full").select("class", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("support", "tp", "claimed")])
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    out = out.withColumn("precision", ratio(F.col("tp"), F.col("claimed"))).withColumn("recall", ratio(F.col("tp"), F.col("support")))
    return out.select("class", "precision", "recall", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"), "support")


def precision_recall_curve(rows: DataFrame, score: str, positive: str, key: str) -> DataFrame:
    """Per key and distinct score, falling: precision and recall of all rows from it up."""
    at = rows.groupBy(key, F.col(score).alias("score")).agg(F.sum(F.col(positive).cast("int")).alias("tp"), F.count("*").alias("n"))
    w = Window.partitionBy(key).orderBy(F.desc("score"))
    cum = at.withColumn("tps", F.sum("tp").over(w)).withColumn("ns", F.sum("n").over(w)).withColumn("all", F.sum("tp").over(Window.partitionBy(key)))
    return cum.select(key, "score", (F.col("tps") / F.col("ns")).alias("precision"), F.coalesce(F.try_divide("tps", "all"), F.lit(0.0)).alias("recall"))


def average_precision(curve: DataFrame, key: str) -> DataFrame:
    step = F.col("recall") - F.lag("recall", 1, 0.0).over(Window.partitionBy(key).orderBy(F.desc("score")))
    return curve.withColumn("step", step).groupBy(key).agg(F.sum(F.col("step") * F.col("precision")).alias("average_precision"))


def greedy_match(found: pd.DataFrame) -> pd.DataFrame:
    """Repeatedly the largest IoU of a group's (a, b, iou) rows; both boxes are then taken. Ties: smaller a, then b."""
    taken_a, taken_b, out = set(), set(), []
    for row in found.sort_values(["iou", "a", "b"], ascending=[False, True, True]).itertuples(index=False):
        if row.a not in taken_a and row.b not in taken_b:
            taken_a.add(row.a)
            taken_b.add(row.b)
            out.append(row)
    return pd.DataFrame(out, columns=found.columns)


def match_boxes(candidates: DataFrame, key: str) -> DataFrame:
    """Greedy matching of (key, a, b, iou) within each key (a frame or page)."""
    return candidates.select(key, "a", "b", "iou").groupBy(key).applyInPandas(greedy_match, f"{key} string, a long, b long, iou double")


def class_balance_weights(rows: DataFrame, label: str) -> DataFrame:
    """Weights that fall with a class's share; the last but one class (the background) gets 0.99 before they are scaled to 1."""
    share = rows.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    all_ = Window.partitionBy(F.lit(1))
    share = share.withColumn("p", F.col("n") / F.sum("n").over(all_)).withColumn("t", F.lit(1.0) / F.count("*").over(all_))
    share = share.withColumn("place", F.row_number().over(all_.orderBy(F.desc("label"))))
    w = F.when(F.col("place") == 2, 0.99).otherwise(F.greatest("t", F.exp(-F.pow("p", 2) / (2 * F.pow("t", 2)))))
    return share.withColumn("w", w).select("label", (F.col("w") / F.sum("w").over(all_)).alias("weight"))


def precision_recall_at_iou(candidates: DataFrame, truth: DataFrame, found: DataFrame, frame: str, skip: int = 5) -> DataFrame:
    """One row: precision and recall over the truth's frames in order, without the first and last `skip`.

    candidates: (frame, a, b, iou) with the least IoU and over; truth, found: one row per box. Frames without truth
    do not count; a frame without detections adds its boxes to the missed ones.
    """
    n = truth.groupBy(frame).agg(F.count("*").alias("t"))
    n = n.withColumn("_i", F.row_number().over(Window.orderBy(frame))).withColumn("_n", F.count("*").over(Window.partitionBy(F.lit(1))))  # one row a frame
    n = n.where((F.col("_i") > skip) & (F.col("_i") <= F.col("_n") - skip)).select(frame, "t")
    hits = match_boxes(candidates, frame).groupBy(frame).agg(F.count("*").alias("hit"))
    said = found.groupBy(frame).agg(F.count("*").alias("p"))
    s = n.join(hits, frame, "left").join(said, frame, "left").agg(F.sum("t").alias("t"), F.coalesce(F.sum("hit"), F.lit(0)).alias("hit"), F.coalesce(F.sum("p"), F.lit(0)).alias("p"))
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return s.select(ratio("hit", "p").alias("precision"), ratio("hit", "t").alias("recall"))


def consume_truth(candidates: DataFrame, key: str) -> DataFrame:
    """Detections b in order, each takes the free truth box a with the largest IoU of its key (a page); a is used once."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        taken, out = set(), []
        for b, rows in g.sort_values(["b", "iou", "a"], ascending=[True, False, True]).groupby("b", sort=True):
            free = rows[~rows["a"].isin(taken)]
            if len(free):
                a = int(free["a"].iloc[0])
                taken.add(a)
                out.append((g[key].iloc[0], a, int(b), float(free["iou"].iloc[0])))
        return pd.DataFrame(out, columns=[key, "a", "b", "iou"])

    return candidates.select(key, "a", "b", "iou").groupBy(key).applyInPandas(run, f"{key} string, a long, b long, iou double")
