"""Further registered queries: matching and its scores, joins with a condition, centers, grids, texts. Adds to plans.queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.functions import geometry, text
from boxloom.operators import clustering, detections, metrics, post, tracking
from boxloom.plans.queries import _COS, _COST, _IOU, _PAIR, _TABLE, FPS, QUERIES, _checkpoints, _clustered, _confusion, _iou_pairs, _r, _shifted, query
from boxloom.plans.tables import boxes
from boxloom.sources import readers

# greedy matching: candidates by falling IoU, each taken if both boxes are free
_GREEDY = """, {o}o AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY iou DESC, a, b) AS i FROM {of}),
{o}r AS (SELECT {key}, i, a, b, iou, true AS hit, [a] AS ta, [b] AS tb FROM {o}o WHERE i = 1 UNION ALL
SELECT {key}, i, a, b, iou, ok, CASE WHEN ok THEN list_append(ta, a) ELSE ta END, CASE WHEN ok THEN list_append(tb, b) ELSE tb END FROM (
SELECT o.*, r.ta, r.tb, NOT list_contains(r.ta, o.a) AND NOT list_contains(r.tb, o.b) AS ok FROM {o}r r JOIN {o}o o USING ({key}) WHERE o.i = r.i + 1)),
{o}m AS (SELECT * FROM {o}r WHERE hit)"""
# truth boxes against boxes moved a little, some left out
_SHIFTED = f""", p AS (SELECT a.keyframe_id, a.box_id AS a, b.box_id AS b, a.x AS ax, a.y AS ay, a.w AS aw, a.h AS ah, b.x + b.box_id % 9 AS bx, b.y AS bby, b.w AS bw, b.h AS bh, b.confidence
FROM boxes a JOIN boxes b USING (keyframe_id) WHERE b.box_id % 7 <> 0), c AS MATERIALIZED (SELECT keyframe_id, a, b, round({_IOU}, 9) AS iou, confidence FROM p WHERE round({_IOU}, 9) >= 0.3),
c5 AS MATERIALIZED (SELECT keyframe_id, a, b, iou FROM c WHERE iou >= 0.5)"""


@query(_PAIR.format(on="a.keyframe_id = b.keyframe_id AND a.box_id < b.box_id") + f", c AS MATERIALIZED (SELECT keyframe_id, a_box_id AS a, b_box_id AS b, round({_IOU}, 9) AS iou FROM p WHERE round({_IOU}, 9) >= 0.1)" + _GREEDY.format(o="g", of="c", key="keyframe_id") + " SELECT keyframe_id, a, b, iou FROM gm")
def greedy_iou_matches(spark, d):
    found = _iou_pairs(spark, d).where("iou >= 0.1").select(F.col("keyframe_id"), F.col("a_box_id").alias("a"), F.col("b_box_id").alias("b"), "iou")
    return metrics.match_boxes(found, "keyframe_id")


@query(_SHIFTED + _GREEDY.format(o="g", of="c5", key="keyframe_id") + """, n AS (SELECT keyframe_id, count(*) AS t, row_number() OVER (ORDER BY keyframe_id) AS i, count(*) OVER () AS n FROM boxes GROUP BY keyframe_id),
h AS (SELECT keyframe_id, count(*) AS hit FROM gm GROUP BY keyframe_id), q AS (SELECT keyframe_id, count(*) AS p FROM boxes WHERE box_id % 7 <> 0 GROUP BY keyframe_id)
SELECT round(sum(hit) / sum(p)::DOUBLE, 9) AS precision, round(sum(hit) / sum(t)::DOUBLE, 9) AS recall FROM n LEFT JOIN h USING (keyframe_id) LEFT JOIN q USING (keyframe_id) WHERE i > 5 AND i <= n - 5""")
def detection_precision_recall(spark, d):
    t, p, c = _shifted(spark, d)
    return metrics.precision_recall_at_iou(c, t, p, "keyframe_id").select(F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@query(_SHIFTED + """, e AS (SELECT keyframe_id, b, list(struct_pack(a := a, iou := iou) ORDER BY iou DESC, a) AS l FROM c5 GROUP BY keyframe_id, b), o AS (SELECT *, row_number() OVER (PARTITION BY keyframe_id ORDER BY b) AS i FROM e),
r AS (SELECT keyframe_id, i, b, l[1] AS pick, [l[1].a] AS taken FROM o WHERE i = 1 UNION ALL
SELECT keyframe_id, i, b, pick, CASE WHEN pick IS NULL THEN taken ELSE list_append(taken, pick.a) END FROM (
SELECT o.keyframe_id, o.i, o.b, list_filter(o.l, lambda x: NOT list_contains(r.taken, x.a))[1] AS pick, r.taken FROM r JOIN o ON o.keyframe_id = r.keyframe_id AND o.i = r.i + 1))
SELECT keyframe_id, pick.a AS a, b, pick.iou AS iou FROM r WHERE pick IS NOT NULL""")
def truth_consumption(spark, d):
    return metrics.consume_truth(_shifted(spark, d)[2], "keyframe_id")


_GRID = ([0.3, 0.5, 0.7], [0.3, 0.45, 0.6])


@query(_SHIFTED + f", g AS (SELECT i::DOUBLE AS mi, c::DOUBLE AS mc FROM (SELECT unnest({_GRID[0]}) AS i) CROSS JOIN (SELECT unnest({_GRID[1]}) AS c)), k AS MATERIALIZED (SELECT keyframe_id || '|' || mi || '|' || mc AS place, mi, mc, a, b, iou FROM c JOIN g ON iou >= mi AND confidence >= mc)" + _GREEDY.format(o="g", of="k", key="place").replace("SELECT place, i, a, b, iou, true", "SELECT place, i, a, b, iou, true") + """,
h AS (SELECT mi, mc, count(*) AS hit FROM (SELECT gm.place, k.mi, k.mc FROM gm JOIN k ON k.place = gm.place AND k.a = gm.a AND k.b = gm.b) GROUP BY ALL), s AS (SELECT mc, count(*) AS said FROM boxes JOIN (SELECT DISTINCT mc FROM g) ON confidence >= mc WHERE box_id % 7 <> 0 GROUP BY mc)
SELECT mi AS min_iou, mc AS min_confidence, round(coalesce(hit, 0) / said::DOUBLE, 9) AS precision, round(coalesce(hit, 0) / (SELECT count(*) FROM boxes)::DOUBLE, 9) AS recall FROM g LEFT JOIN h USING (mi, mc) LEFT JOIN s USING (mc)""")
def detection_grid(spark, d):
    t = boxes(spark, d)
    p = t.where("box_id % 7 <> 0").withColumn("x", F.col("x") + F.col("box_id") % 9)
    side = lambda df, n, *more: df.select("keyframe_id", F.col("box_id").alias(n), *more, *[F.col(c).alias(n + c) for c in ("x", "y", "w", "h")])
    both = side(t, "a").join(side(p, "b", "confidence"), "keyframe_id")
    rect = lambda n: [F.col(n + c) for c in ("x", "y", "w", "h")]
    c = both.select("keyframe_id", "a", "b", F.round(geometry.iou(*rect("a"), *rect("b")), 9).alias("iou"), "confidence")
    return metrics.detection_grid(c, t, p, "keyframe_id", *_GRID).select("min_iou", "min_confidence", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@query(_TABLE + """, x AS (SELECT y.n AS a, c.n AS b, h.n AS n FROM b_y y CROSS JOIN bc c CROSS JOIN h),
k AS (SELECT a, b, n, unnest(range(greatest(1, a + b - n)::BIGINT, least(a, b)::BIGINT + 1)) AS k FROM x),
z AS (SELECT sum(k / n * ln(n * k / (a * b)) * exp(lgamma(a + 1) + lgamma(b + 1) + lgamma(n - a + 1) + lgamma(n - b + 1) - lgamma(n + 1) - lgamma(k + 1) - lgamma(a - k + 1) - lgamma(b - k + 1) - lgamma(n - a - b + k + 1))) AS emi FROM k)
SELECT round((mi - emi) / ((hc + hy) / 2 - emi), 6) AS ami FROM h CROSS JOIN z""")
def adjusted_mutual_info(spark, d):
    ami = metrics.adjusted_mutual_info(metrics.contingency(boxes(spark, d), "character"))
    return spark.createDataFrame([(round(ami, 6),)], "ami double")


@query(", t AS (SELECT 1 AS y, 1 AS c) SELECT 1.0::DOUBLE AS purity, 1.0::DOUBLE AS nmi, 1.0::DOUBLE AS adjusted_rand, 1 - (SELECT count(DISTINCT character) FROM boxes) AS k_error FROM t")
def one_cluster_scores(spark, d):
    """All boxes in one cluster: the row of ones."""
    s = metrics.clustering_scores(metrics.contingency(boxes(spark, d).withColumn("cluster", F.lit(0)), "character"))
    return s.select("purity", "nmi", "adjusted_rand", "k_error")


_SILHOUETTE = f""", sp AS (SELECT a.box_id, a.cluster AS c, b.cluster AS o, a.features AS af, b.features AS bf FROM boxes a JOIN boxes b ON a.box_id <> b.box_id),
sm AS (SELECT box_id, c, o, avg(1 - {_COS}) AS m FROM sp GROUP BY ALL), se AS (SELECT box_id, max(CASE WHEN c = o THEN m END) AS a, min(CASE WHEN c <> o THEN m END) AS b FROM sm GROUP BY box_id),
si AS (SELECT round(avg(coalesce((b - a) / greatest(a, b), 0)), 6) AS silhouette FROM se)"""


@query(_TABLE + _SILHOUETTE + """, ct AS (SELECT count(DISTINCT CASE WHEN cluster >= 0 THEN cluster END) AS k, CAST(sum((cluster < 0)::INT) AS BIGINT) AS noise_count, round(100.0 * sum((cluster < 0)::INT) / count(*), 6) AS p_noise FROM boxes)
SELECT 'file' AS video_name, k, noise_count, p_noise, round((SELECT sum(m) FROM bc) / n, 6) AS purity, round(mi / hy, 6) AS homogeneity, round(mi / hc, 6) AS completeness, round(2 * mi / (hc + hy), 6) AS nmi, (SELECT count(*) FROM bc) - (SELECT count(*) FROM b_y) AS k_error, silhouette FROM h CROSS JOIN ct CROSS JOIN si""")
def evaluation_row(spark, d):
    row = metrics.evaluation_row(boxes(spark, d), "file", "character")
    return row.select("video_name", "k", "noise_count", *_r("p_noise", "purity", "homogeneity", "completeness", "nmi"), "k_error", *_r("silhouette"))


@query(", g AS (SELECT unnest([0.3, 0.5, 0.7]) AS t), i AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS iteration FROM g) SELECT iteration, t::DOUBLE AS t, (SELECT count(*) FROM boxes WHERE confidence >= t) AS boxes FROM i")
def grid_results(spark, d):
    b = boxes(spark, d)
    return detections.run_grid(detections.parameter_grid(spark, {"t": [0.5, 0.3, 0.7]}), lambda p: {"boxes": b.where(F.col("confidence") >= p["t"]).count()})


@query(" SELECT box_id, CASE WHEN box_id % 4 <> 0 THEN w END AS width, CASE WHEN box_id % 4 <> 0 THEN h END AS height FROM boxes")
def parsed_sizes(spark, d):
    size = text.size_to_ints(F.when(F.col("box_id") % 4 != 0, F.concat("w", F.lit(","), "h")).otherwise(F.lit("N/A")))
    return boxes(spark, d).select("box_id", size["width"].cast("long").alias("width"), size["height"].cast("long").alias("height"))


@query(", q AS (SELECT character AS truth, box_id % 10 AS predicted, count(*) AS n FROM boxes GROUP BY ALL) SELECT round(sum(CASE WHEN truth = predicted THEN n ELSE 0 END) / sum(n)::DOUBLE, 9) AS accuracy FROM q")
def confusion_accuracy(spark, d):
    return metrics.accuracy(_confusion(spark, d)).select(F.round("accuracy", 9).alias("accuracy"))


# frames of which every fifth, with its boxes, is missing: edges go by the rank of the frames that are there
_GAPPED = ", g AS (SELECT *, dense_rank() OVER (PARTITION BY shot_id ORDER BY frame) - 1 AS at FROM boxes WHERE frame % 5 <> 3)"
_STEP = int(-(-FPS // 2))


def _gapped(spark, d) -> DataFrame:
    return boxes(spark, d).where("frame % 5 <> 3")


@query(_GAPPED + _PAIR.format(on="a.shot_id = b.shot_id AND a.at + 1 = b.at").replace("FROM boxes a JOIN boxes b", "FROM g a JOIN g b") + f" SELECT shot_id, a_box_id, b_box_id, round({_COST}, 6) AS cost FROM p")
def match_edges_over_gaps(spark, d):
    return tracking.match_edges(_gapped(spark, d), FPS).withColumn("cost", F.round("cost", 6))


@query(_GAPPED + _PAIR.format(on=f"a.shot_id = b.shot_id AND b.at - a.at >= {_STEP} AND (b.at - a.at) % {_STEP} = 0 AND (b.at - a.at) // {_STEP} <= 5").replace("FROM boxes a JOIN boxes b", "FROM g a JOIN g b") + f", c AS (SELECT *, {_COST} AS cost FROM p) SELECT shot_id, a_box_id, b_box_id, round(cost, 6) AS cost FROM c WHERE cost <= 0")
def skip_edges_over_gaps(spark, d):
    return tracking.skip_edges(_gapped(spark, d), FPS).withColumn("cost", F.round("cost", 6))


@query(_GAPPED + " SELECT shot_id, least(6, max(n)) AS most FROM (SELECT shot_id, frame, count(*) AS n FROM g GROUP BY ALL) GROUP BY shot_id")
def track_limits(spark, d):
    edges = tracking.network(_gapped(spark, d), FPS)
    return edges.where("kind = 'enter'").groupBy("shot_id").agg(F.max("most").alias("most"))


@query(""", t AS (SELECT shot_id, slot AS track_id, box_id, frame FROM boxes UNION ALL SELECT shot_id, slot + 10, box_id, frame FROM boxes WHERE box_id % 97 = 0
UNION ALL SELECT shot_id, 20, box_id, frame FROM boxes WHERE box_id % 119 IN (0, 1)),
o AS (SELECT shot_id, max(n) = 1 AS disjoint FROM (SELECT shot_id, box_id, count(*) AS n FROM t GROUP BY ALL) GROUP BY shot_id),
f AS (SELECT shot_id, max(n) = 1 AS one_per_frame FROM (SELECT shot_id, track_id, frame, count(*) AS n FROM t GROUP BY ALL) GROUP BY shot_id) SELECT * FROM o JOIN f USING (shot_id)""")
def planted_feasibility(spark, d):
    b = boxes(spark, d)
    t = b.select("shot_id", F.col("slot").alias("track_id"), "box_id")
    t = t.union(b.where("box_id % 97 = 0").select("shot_id", F.col("slot") + 10, "box_id")).union(b.where("box_id % 119 in (0, 1)").select("shot_id", F.lit(20).cast("long"), "box_id"))
    return detections.feasible(t, b)


@query(" SELECT f.keyframe_id, l.character, f.n FROM (SELECT keyframe_id, character, count(*) AS n FROM boxes GROUP BY ALL) f JOIN (SELECT DISTINCT character FROM boxes WHERE slot = 1) l USING (character)")
def merged_categories(spark, d):
    b = boxes(spark, d)
    return detections.merge_categories(b.where("slot = 1").select("character").distinct(), b.groupBy("keyframe_id", "character").agg(F.count("*").alias("n")), "character").select("keyframe_id", "character", "n")


@query(" SELECT box_id, thumbnail_id, features[1] AS first FROM boxes")
def required_features(spark, d):
    b = boxes(spark, d)
    return detections.required_join(b.select("box_id", "thumbnail_id"), b.select("thumbnail_id", F.element_at("features", 1).alias("first")), "thumbnail_id").select("box_id", "thumbnail_id", "first")


@query(", s AS (SELECT *, count(*) OVER (PARTITION BY shot_id, character) AS n FROM boxes), a AS (SELECT DISTINCT shot_id, character FROM boxes WHERE slot = 2) SELECT shot_id, character, box_id, row_number() OVER (PARTITION BY shot_id ORDER BY box_id) AS new_id FROM s JOIN a USING (shot_id, character) WHERE n = 1")
def anchor_boxes(spark, d):
    b = boxes(spark, d)
    anchors = b.where("slot = 2").select("shot_id", "character").distinct()
    return detections.anchor_boxes(anchors, b, ["shot_id", "character"], "box_id").select("shot_id", "character", "box_id", "new_id")


_MEAN = ", x AS (SELECT cluster, box_id, confidence, unnest(range(len(features))) AS d, unnest(features) AS x FROM boxes WHERE cluster >= 0), m AS (SELECT cluster, d, avg(x) AS m FROM x GROUP BY cluster, d), g AS (SELECT cluster, box_id, confidence, sqrt(sum(pow(x - m, 2))) AS gap FROM x JOIN m USING (cluster, d) GROUP BY ALL)"


def _kept(spark, d) -> DataFrame:
    return boxes(spark, d).where("cluster >= 0")


@query(_MEAN + ", r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(gap, 9), box_id) AS r FROM g) SELECT cluster, box_id, round(gap, 6) AS gap FROM r WHERE r = 1")
def nearest_to_mean(spark, d):
    return post.nearest_to_mean(_kept(spark, d)).withColumn("gap", F.round("gap", 6))


@query(_MEAN + " SELECT cluster, box_id, round(sqrt(sqrt(confidence * exp(-pow(gap / 1.5, 2)))), 6) AS score FROM g")
def rooted_scores(spark, d):
    return post.rooted_scores(_kept(spark, d)).withColumn("score", F.round("score", 6))


# clusters of a shot, so that some have fewer than five boxes
_BEST = """, k AS (SELECT *, shot_id * 100 + character % 8 AS c FROM boxes), x AS (SELECT c, box_id, unnest(range(len(features))) AS d, unnest(features) AS x FROM k), m AS (SELECT c, d, quantile_cont(x, 0.5) AS m FROM x GROUP BY c, d),
g AS (SELECT c, box_id, sqrt(sum(pow(x - m, 2))) AS gap FROM x JOIN m USING (c, d) GROUP BY ALL), s AS (SELECT c, box_id, gap / max(gap) OVER (PARTITION BY c) AS distance, count(*) OVER (PARTITION BY c) AS n FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY round(distance, 9), box_id) AS r FROM s) SELECT c AS cluster, box_id AS best_box FROM r WHERE r = 1 AND n >= 5"""


@query(_BEST)
def best_thumbnails(spark, d):
    rows = boxes(spark, d).withColumn("cluster", F.expr("shot_id * 100 + character % 8"))
    return post.best_thumbnails(post.significance(rows))


@query(", f AS (SELECT shot_id, frame, avg(confidence) AS c, count(*) AS n FROM boxes GROUP BY ALL) SELECT shot_id, frame, round(sum(c * n) OVER w / sum(n) OVER w, 9) AS running_mean FROM f WINDOW w AS (PARTITION BY shot_id ORDER BY frame ROWS UNBOUNDED PRECEDING)")
def running_mean(spark, d):
    f = boxes(spark, d).groupBy("shot_id", "frame").agg(F.avg("confidence").alias("c"), F.count("*").alias("n"))
    return metrics.running_mean(f, "shot_id", "frame", "c", "n").select("shot_id", "frame", F.round("running_mean", 9).alias("running_mean"))


@query(" SELECT box_id, slot, NULL::DOUBLE AS confidence FROM boxes WHERE slot = 0 UNION ALL SELECT box_id, slot, confidence FROM boxes WHERE slot = 1")
def appended_rows(spark, d):
    b = boxes(spark, d)
    return detections.appended([b.where("slot = 0").select("box_id", "slot"), b.where("slot = 1").select("box_id", "slot", "confidence")])


@query(" SELECT shot_id, string_agg(CAST(box_id AS VARCHAR), ',' ORDER BY frame, box_id) AS ids FROM boxes WHERE slot < 2 GROUP BY shot_id")
def packed_by_shot(spark, d):
    b = boxes(spark, d).select("shot_id", "frame", "box_id", "slot")
    packed = detections.by_shot([b.where("slot = 0"), b.where("slot = 1")])
    return packed.select("shot_id", F.array_join(F.transform("boxes", lambda x: x["box_id"].cast("string")), ",").alias("ids"))


@query(" SELECT row_number() OVER (ORDER BY shot_id DESC, frame, confidence DESC, box_id) AS place, box_id FROM boxes ORDER BY place LIMIT 200")
def ordered_boxes(spark, d):
    """The first rows of a total order of shots, frames and boxes."""
    first = boxes(spark, d).orderBy(F.desc("shot_id"), "frame", F.desc("confidence"), "box_id").limit(200)
    from pyspark.sql import Window

    place = F.row_number().over(Window.orderBy(F.desc("shot_id"), "frame", F.desc("confidence"), "box_id"))
    return first.select(place.cast("long").alias("place"), "box_id")


@query(", t AS (SELECT box_id, 'c' || (character % 5) || '_' || slot AS tag, confidence FROM boxes) SELECT box_id // 3 AS image, split_part(tag, '_', 1) AS class, max(confidence) AS probability FROM t GROUP BY ALL")
def class_wise_max(spark, d):
    rows = boxes(spark, d).select(F.expr("box_id div 3").alias("image"), F.expr("concat('c', character % 5, '_', slot)").alias("tag"), "confidence")
    return detections.class_wise_max(rows, ["image"], "tag", "confidence")


@query("WITH v AS (SELECT vec_id, vec_id * 37 + 5 AS s FROM embeddings) SELECT vec_id, (s // 3600) || ':' || lpad(CAST(s // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') || '.250' AS clock FROM v")
def clock_texts(spark, d):
    v = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id")
    return v.select("vec_id", text.seconds_to_clock(F.expr("vec_id * 37 + 5 + 0.25D")).alias("clock"))


@query("WITH v AS (SELECT vec_id FROM embeddings) SELECT vec_id, base64(encode('box ' || vec_id)) AS code, 'box ' || vec_id AS back FROM v")
def base64_texts(spark, d):
    v = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.concat(F.lit("box "), "vec_id").alias("t"))
    return v.select("vec_id", F.regexp_replace(F.base64(F.col("t").cast("binary")), r"\s", "").alias("code"), F.unbase64(F.base64(F.col("t").cast("binary"))).cast("string").alias("back"))


@query(" SELECT box_id, CAST(lower(t) IN ('yes', 'true', 't', '1') AS BOOLEAN) AS flag FROM (SELECT box_id, ['yes', 'No', 'TRUE', 't', '0', '1'][box_id % 6 + 1] AS t FROM boxes)")
def parsed_flags(spark, d):
    t = F.element_at(F.array(*[F.lit(x) for x in ("yes", "No", "TRUE", "t", "0", "1")]), (F.col("box_id") % 6 + 1).cast("int"))
    return boxes(spark, d).select("box_id", text.to_bool(t).alias("flag"))


@query(", s AS (SELECT shot_id, min(box_id) AS lo, min(box_id) + shot_id % 4 AS hi FROM boxes GROUP BY shot_id) SELECT shot_id, unnest(range(1, hi - lo + 1)) AS number FROM s WHERE hi > lo")
def frame_numbers(spark, d):
    s = boxes(spark, d).groupBy("shot_id").agg(F.min("box_id").alias("lo")).withColumn("hi", F.expr("lo + shot_id % 4"))
    return detections.frame_numbers(s, "lo", "hi").select("shot_id", "number")


@query(" SELECT keyframe_id, CAST(keyframe_id AS BIGINT) AS n FROM (SELECT DISTINCT keyframe_id FROM boxes) WHERE CAST(keyframe_id AS BIGINT) >= 7 AND 100 - CAST(keyframe_id AS BIGINT) >= 7")
def pages_without_edges(spark, d):
    pages = boxes(spark, d).select("keyframe_id", F.col("keyframe_id").cast("long").alias("n")).distinct()
    return detections.exclude_edges(pages, 100, 7, "n")


@query(f", p AS (SELECT a.box_id, a.features AS af, b.features AS bf FROM boxes a JOIN boxes b ON b.box_id = a.box_id + 1) SELECT box_id, round(greatest(0, least(1, 1 - list_sum([af[i] * bf[i] FOR i IN range(1, len(af) + 1)]) / (sqrt(list_sum([x * x FOR x IN af])) * sqrt(list_sum([x * x FOR x IN bf]))))), 6) AS distance FROM p")
def clipped_cosine_distance(spark, d):
    from boxloom.functions.vectors import cosine_distance

    b = boxes(spark, d)
    following = b.select((F.col("box_id") - 1).alias("box_id"), F.col("features").alias("g"))
    return b.join(following, "box_id").select("box_id", F.round(cosine_distance(F.col("features"), F.col("g")), 6).alias("distance"))


# the ten numbers of a clustering run, here from what the boxes of a video have
_TEN = ["w", "h", "x", "y", "confidence", "slot", "frame", "character", "cluster", "box_id"]


@query(", v AS (SELECT *, shot_id // 5 AS video FROM boxes), u AS (" + " UNION ALL ".join(f"SELECT video, '{c}' AS metric, CAST({c} AS DOUBLE) AS v FROM v" for c in _TEN) + ") SELECT video, metric, min(v) AS least, max(v) AS most, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(stddev_samp(v), 6) AS std, count(v) AS n FROM u GROUP BY ALL")
def batch_stats_of_metrics(spark, d):
    v = boxes(spark, d).withColumn("video", F.expr("shot_id div 5"))
    u = v.select("video", F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in _TEN])).alias("m")).select("video", "m.metric", "m.v")
    aggs = [F.min("v").alias("least"), F.max("v").alias("most"), *[F.round(f("v"), 6).alias(n) for f, n in ((F.avg, "mean"), (F.median, "median"), (F.stddev_samp, "std"))], F.count("v").alias("n")]
    return u.groupBy("video", "metric").agg(*aggs)


@query(", l AS (SELECT shot_id, max(box_id) AS top FROM boxes GROUP BY shot_id), dup AS (SELECT shot_id, box_id + 500000 AS box_id, box_id AS keeper, cluster AS label FROM boxes WHERE box_id % 6 = 1) SELECT shot_id, top + row_number() OVER (PARTITION BY shot_id ORDER BY box_id) AS box_id, label FROM dup JOIN l USING (shot_id) WHERE label >= 0")
def reattached_duplicates(spark, d):
    from boxloom.operators import pairs

    b = boxes(spark, d)
    again = b.where("box_id % 6 = 1").select("shot_id", (F.col("box_id") + 500_000).alias("box_id"), F.col("box_id").alias("keeper"))
    return pairs.reattach_duplicates(b.select("shot_id", "box_id", F.col("cluster").alias("label")), again, "shot_id")


@query(" SELECT folder, CASE WHEN n > 0 THEN n ELSE -1 END AS n FROM (SELECT 'c' || c AS folder, count(box_id) AS n FROM range(-3, 12) r(c) LEFT JOIN boxes ON cluster = c GROUP BY ALL)")
def file_counts(spark, d):
    files = boxes(spark, d).select(F.concat(F.lit("c"), "cluster").alias("folder"))
    return readers.file_counts(files, spark.range(-3, 12).select(F.concat(F.lit("c"), "id").alias("folder")))


@query(" SELECT 'k' || box_id AS key, CAST(x AS VARCHAR) AS value FROM boxes WHERE box_id % 3 = 0")
def device_report(spark, d):
    line = F.expr("case box_id % 3 when 0 then concat(' k', box_id, ' : ', x) when 1 then 'no colon' else 'a: b: c' end")
    return readers.parse_report(boxes(spark, d).select(line.alias("value")))


@query()
def post_processed_report(spark, d):
    _checkpoints(spark)
    report = post.post_process_report(boxes(spark, d))
    return report.select("box_id", "cluster", *_r("score"), "size", F.round("cluster_score", 6).alias("cluster_score"), "best_box")


QUERIES["cluster_dbscan_tubes"] = lambda spark, d: clustering.cluster(boxes(spark, d).withColumn("video", F.expr("shot_id div 5")).withColumn("tube", F.expr("shot_id * 4 + slot")), "dbscan", 8, tube="tube")
QUERIES["cluster_k_means_l2"] = _clustered("k_means_bare", normalizer="l2")
