"""Operators over detection rows: frame order, noise filters, suppression, mapping, ids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Thresholds of the noise filter.
LEAST_CONFIDENCE, KEEP_BEST, PERCENTILE = 0.3, 4000, 7.0
LEAST_EDGE, MOST_EDGE, LEAST_SHARE, MOST_SHARE = 50, 900, 0.02, 1.0


def frame_index(boxes: DataFrame, video: str = "shot_id") -> DataFrame:
    """keyframe_index: dense rank of the keyframe within a video; id_in_frame: place of the box within its frame."""
    frames = Window.partitionBy(video).orderBy("keyframe_id")
    inside = Window.partitionBy(video, "keyframe_id").orderBy("box_id")
    return boxes.withColumn("keyframe_index", (F.dense_rank().over(frames) - 1).cast("long")).withColumn("id_in_frame", (F.row_number().over(inside) - 1).cast("long"))


def confidence_cut(boxes: DataFrame, video: str, best: int = KEEP_BEST, percentile: float = PERCENTILE) -> DataFrame:
    """Per video: the largest of the fixed floor, the confidence of the best-th box and the percentile."""
    rank = F.row_number().over(Window.partitionBy(video).orderBy(F.desc("confidence"), "box_id"))
    ranked = boxes.select(video, "confidence", rank.alias("rank"))
    nth = F.max(F.when(F.col("rank") == best, F.col("confidence")))
    return ranked.groupBy(video).agg(F.greatest(F.lit(LEAST_CONFIDENCE), F.coalesce(nth, F.lit(0.0)), F.percentile("confidence", F.lit(percentile / 100))).alias("cut"))


def noise_filter(boxes: DataFrame, video: str = "shot_id", frame_side: int = 180) -> DataFrame:
    """Adds valid: confidence at the cut or above, both edges within bounds in pixels and as a share of the frame's short side."""
    edges = lambda c: F.col(c).between(LEAST_EDGE, MOST_EDGE) & (F.col(c) / F.lit(float(frame_side))).between(LEAST_SHARE, MOST_SHARE)
    out = boxes.join(confidence_cut(boxes, video), video)
    return out.withColumn("valid", (F.col("confidence") >= F.col("cut")) & edges("w") & edges("h")).drop("cut")


def noise_labels(boxes: DataFrame, labels: DataFrame, video: str = "shot_id") -> DataFrame:
    """Labels of valid boxes, and labels below the smallest (and below 0), each its own, for the others."""
    least = labels.groupBy(video).agg(F.least(F.min("label"), F.lit(0)).alias("least"))
    noise = boxes.join(labels.select("box_id"), "box_id", "left_anti").join(least, video, "left")
    place = F.row_number().over(Window.partitionBy(video).orderBy("box_id"))
    noise = noise.select(video, "box_id", (F.coalesce("least", F.lit(0)) - place).cast("long").alias("label"), F.lit(True).alias("is_best"))
    return labels.select(video, "box_id", F.col("label").cast("long"), F.lit(False).alias("is_best")).unionByName(noise)


def non_max_suppression(boxes: DataFrame, keys: list[str], exempt: Column, threshold: float = 0.5) -> DataFrame:
    """The most confident box of each key from the threshold up (ties: smaller id), and all boxes that are exempt."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("confidence"), "box_id"))
    return boxes.where(F.col("confidence") >= threshold).withColumn("_rank", rank).where((F.col("_rank") == 1) | exempt).drop("_rank")


def exclude_edges(pages: DataFrame, total: int, border: int, index: str) -> DataFrame:
    """Leaves out the first and last `border` pages."""
    return pages.where((F.col(index) >= border) & (F.lit(total) - F.col(index) >= border))


def map_groups(boxes: DataFrame, groups: DataFrame) -> DataFrame:
    """Detections with their group by thumbnail; of repeated groups of a thumbnail the last id counts."""
    last = groups.groupBy("thumbnail_id").agg(F.max_by(F.struct("bbox_group", "is_best"), "group_id").alias("g"))
    return boxes.join(last, "thumbnail_id").select(boxes["*"], "g.bbox_group", "g.is_best")


def id_mismatch(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has, and the side."""
    one = lambda x, y, side: x.select(key).distinct().join(y, key, "left_anti").select(key, F.lit(side).alias("side"))
    return one(a, b, "left").unionByName(one(b, a, "right"))


def codes_by_appearance(df: DataFrame, value: str, order: str, keys: list[str]) -> DataFrame:
    """A code from 0 for each distinct value within keys, by first appearance."""
    first = df.groupBy(*keys, value).agg(F.min(order).alias("first"))
    return first.withColumn("code", (F.row_number().over(Window.partitionBy(*keys).orderBy("first", value)) - 1).cast("long"))


def sequential_ids(tracked: DataFrame) -> DataFrame:
    """Video-level frame numbers, and per frame box numbers, of tracked boxes. Frames without tracked boxes keep their number."""
    frames = F.dense_rank().over(Window.partitionBy("video").orderBy("shot_id", "keyframe_id")) - 1
    out = tracked.withColumn("frame_number", frames.cast("long")).where("track_id >= 0")
    return out.withColumn("box_number", (F.row_number().over(Window.partitionBy("video", "frame_number").orderBy("box_id")) - 1).cast("long"))


def interval_join(points: DataFrame, intervals: DataFrame, point: str, start: str, end: str, keys: list[str]) -> DataFrame:
    """Points with the intervals of the same keys that hold them, both ends included."""
    return points.join(intervals, keys).where(F.col(point).between(F.col(start), F.col(end)))


def overlap_pruning(boxes: DataFrame, keys: list[str], most: float = 0.4) -> DataFrame:
    """Within keys (a frame), boxes by falling area; one stays if its IoU with every box kept before is at most `most`."""
    from boxloom.functions.geometry import iou

    item = F.struct((-(F.col("w") * F.col("h"))).alias("minus_area"), "box_id", "x", "y", "w", "h")
    sorted_ = F.array_sort(F.collect_list(item))
    side = lambda b: [b[c] for c in ("x", "y", "w", "h")]
    rows = boxes.groupBy(*keys).agg(sorted_.alias("all"))
    kept = F.aggregate("all", F.slice("all", 1, 0), lambda acc, b: F.when(F.forall(acc, lambda k: F.coalesce(iou(*side(k), *side(b)), F.lit(0.0)) <= most), F.concat(acc, F.array(b))).otherwise(acc))
    return rows.select(*keys, F.explode(kept).alias("b")).select(*keys, "b.box_id")


def max_jump(tracks: DataFrame, keys: list[str]) -> DataFrame:
    """Per track, the largest jump: center distance / sqrt(area) / frame gap against the last record holder, in frame order."""
    cx, cy = F.col("x") + F.col("w") / 2.0, F.col("y") + F.col("h") / 2.0
    item = F.struct(F.col("frame").cast("double").alias("f"), cx.cast("double").alias("cx"), cy.cast("double").alias("cy"), F.sqrt((F.col("w") * F.col("h")).cast("double")).alias("side"))
    rows = tracks.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("all"))
    state = lambda b, r: F.struct(b["f"].alias("f"), b["cx"].alias("cx"), b["cy"].alias("cy"), r.alias("ratio"))

    def step(s, b):
        jump = F.sqrt(F.pow(b["cx"] - s["cx"], 2) + F.pow(b["cy"] - s["cy"], 2))
        ratio = F.coalesce(F.try_divide(jump, b["side"] * (b["f"] - s["f"])), F.lit(0.0))
        return F.when(ratio > s["ratio"], state(b, ratio)).otherwise(s)

    first = F.element_at("all", 1)
    return rows.select(*keys, F.aggregate("all", state(first, F.lit(0.0)), step)["ratio"].alias("max_jump"))


def grid_layout(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Cells of a square grid: side ceil(sqrt(n)), columns first."""
    n = F.count("*").over(Window.partitionBy(*keys))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    side = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    return rows.withColumn("side", side).withColumn("cell_col", (place % side).cast("long")).withColumn("cell_row", F.floor(place / side).cast("long"))


def long_shots(boxes: DataFrame, fps: float) -> DataFrame:
    """Shots whose last frame is fps frames or more after the first."""
    return boxes.groupBy("shot_id").agg(F.min("frame").alias("first"), F.max("frame").alias("last")).where(F.col("last") - F.col("first") >= fps)


def without_fades(boxes: DataFrame, shots: DataFrame, fade: int) -> DataFrame:
    """Boxes of the given shots that are not within `fade` frames of either end."""
    rows = boxes.join(shots, "shot_id")
    return rows.where((F.col("frame") >= F.col("first") + fade) & (F.col("frame") <= F.col("last") - fade)).drop("first", "last")


def batches(rows: DataFrame, keys: list[str], order: str, size: int = 40) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    return rows.withColumn("batch", F.floor(place / size).cast("long"))


def appearances(keyframes: DataFrame, boxes: DataFrame, frame: str) -> DataFrame:
    """Keyframes with the sorted ids of their boxes, empty for frames without."""
    rows = keyframes.join(boxes.select(frame, "box_id"), frame, "left")
    return rows.groupBy(*keyframes.columns).agg(F.array_sort(F.collect_list("box_id")).alias("boxes"))


def feasible(tracks: DataFrame, boxes: DataFrame) -> DataFrame:
    """Per shot: whether no box is in two tracks, and no track has two boxes of one frame."""
    one = tracks.groupBy("shot_id", "box_id").agg(F.count("*").alias("n")).groupBy("shot_id").agg((F.max("n") == 1).alias("disjoint"))
    per = tracks.join(boxes.select("box_id", "frame"), "box_id").groupBy("shot_id", "track_id", "frame").agg(F.count("*").alias("n"))
    return one.join(per.groupBy("shot_id").agg((F.max("n") == 1).alias("one_per_frame")), "shot_id")


def largest_boxes(boxes: DataFrame, most: int = 300) -> DataFrame:
    """The `most` boxes of the largest area, ties by box_id."""
    return boxes.withColumn("area", F.col("w") * F.col("h")).orderBy(F.desc("area"), "box_id").limit(most)


def sample_rows(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement: those with the smallest digests of seed and key. Reruns agree."""
    draw = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(key).cast("string")))
    return rows.withColumn("_draw", draw).orderBy("_draw", key).limit(n).drop("_draw")


def box_tracks(tracks: DataFrame, keys: list[str], boxes: str) -> DataFrame:
    """Rows (keys, tracks: array of arrays of box ids) to one row a box with its track's position in the list."""
    lists = tracks.select(*keys, F.posexplode(boxes).alias("track_id", "_boxes"))
    return lists.select(*keys, "track_id", F.explode("_boxes").alias("box_id"))


def capacity_edges(capacities: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, tail, head, capacity, weight) with a capacity, numbered from 0 by tail and head; weight is 1 where null."""
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("tail", "head")) - 1
    return capacities.where("capacity > 0").select(*keys, number.alias("edge_id"), "tail", "head", "capacity", F.coalesce("weight", F.lit(1.0)).alias("weight"))


def image_clusters(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """Image paths .../SERIES_.../CLUSTER/THUMBNAIL.ext met with boxes by thumbnail_id: thumbnail_id, series, cluster, box columns."""
    parts = F.split("path", "/")
    named = images.select(
        F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "").alias("thumbnail_id"),
        F.substring_index(F.try_element_at(parts, F.lit(-3)), "_", 1).alias("series"),
        F.try_element_at(parts, F.lit(-2)).alias("folder"),
    )
    return named.join(boxes, "thumbnail_id")


def parameter_grid(spark, values: dict[str, list]) -> DataFrame:
    """One row for each combination of the listed values, which are short lists of a configuration."""
    row = spark.range(1).select()
    for name, found in values.items():
        row = row.select("*", F.explode(F.array(*[F.lit(v) for v in found])).alias(name))
    return row


def run_grid(grid: DataFrame, train: Callable[[dict], dict]) -> DataFrame:
    """The rows of a grid (a short list of configurations) with what train(parameters) returns for each, in order of iteration."""
    rows = [(i, r.asDict()) for i, r in enumerate(grid.orderBy(*grid.columns).collect())]
    return grid.sparkSession.createDataFrame([{"iteration": i} | parameters | train(parameters) for i, parameters in rows])


def merge_categories(labels: DataFrame, features: DataFrame, key: str = "category") -> DataFrame:
    """Labels and features of the categories that both have."""
    return labels.join(features, key)


def required_join(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """rows with the columns of facts; a key that facts has not is an error."""
    out = rows.join(facts.withColumn("_there", F.lit(True)), key, "left")
    missing = F.raise_error(F.concat(F.lit(f"no {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return out.withColumn(key, F.when(F.col("_there"), F.col(key)).otherwise(missing.cast(dict(rows.dtypes)[key]))).drop("_there")


def anchor_boxes(anchors: DataFrame, boxes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The box of each anchor whose keys exactly one box has, without features, numbered from 1 within the first key."""
    once = F.count("*").over(Window.partitionBy(*keys))
    single = boxes.withColumn("_n", once).where("_n = 1").drop("_n", "features")
    number = F.row_number().over(Window.partitionBy(keys[0]).orderBy(order))
    return anchors.join(single, keys).withColumn("new_id", number.cast("long"))


def class_wise_max(rows: DataFrame, keys: list[str], tag: str, probability: str) -> DataFrame:
    """(keys, class, probability): the largest probability of the tags of a class, which stands before a tag's first underscore."""
    from boxloom.functions.text import tag_prefix

    return rows.groupBy(*keys, tag_prefix(F.col(tag)).alias("class")).agg(F.max(probability).alias("probability"))


def appended(parts: list[DataFrame]) -> DataFrame:
    """All rows of all parts; columns that a part has not are null."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def by_shot(parts: list[DataFrame]) -> DataFrame:
    """(shot_id, boxes): the rows of all parts packed by shot, in order of frame and box."""
    rows = appended(parts)
    item = F.struct("frame", "box_id", *[c for c in rows.columns if c not in ("shot_id", "frame", "box_id")])
    return rows.groupBy("shot_id").agg(F.array_sort(F.collect_list(item)).alias("boxes"))


def frame_numbers(ranges: DataFrame, start: str, end: str) -> DataFrame:
    """ranges with a row for each of the frames that are taken from it, numbered from 1."""
    length = F.col(end) - F.col(start)
    return ranges.where(length >= 1).withColumn("number", F.explode(F.sequence(F.lit(1).cast("long"), length.cast("long"))))
