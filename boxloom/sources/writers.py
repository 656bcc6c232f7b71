"""Writers of detection data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.functions.text import to_camel


def _documents(rows: DataFrame, path: str) -> None:
    """A JSON file for each row, which is what the readers take a file for."""
    rows.write.option("maxRecordsPerFile", 1).json(path)


def camel(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({c: to_camel(c) for c in df.columns})


def write_detections(boxes: DataFrame, path: str) -> None:
    """A JSON row per video with its boxes nested, camel-cased keys in order; frame_width and frame_height stand beside them."""
    size = [c for c in ("frame_width", "frame_height") if c in boxes.columns]
    nested = [F.col(c).alias(to_camel(c)) for c in sorted(boxes.columns, key=to_camel) if c not in ("video", *size)]
    rows = boxes.select("video", *size, F.struct(*nested).alias("b"))
    named = {"frame_width": "keyFrameWidth", "frame_height": "keyFrameHeight"}
    sizes = [F.max(c).alias(named[c]) for c in size]
    _documents(rows.groupBy("video").agg(F.array_sort(F.collect_list("b")).alias("characterBoundingBoxes"), *sizes), path)


def write_without_features(boxes: DataFrame, path: str) -> None:
    """The same with empty features: a copy for transfer."""
    write_detections(boxes.withColumn("features", F.array().cast("array<double>")), path)


def write_mapping(mapping: DataFrame, path: str) -> None:
    """A JSON row per video: boxes, all mapped detections of it."""
    row = F.struct(*[c for c in mapping.columns if c != "video"])
    _documents(mapping.groupBy("video").agg(F.array_sort(F.collect_list(row)).alias("boxes")), path)


def write_groups(groups: DataFrame, path: str, negatives: DataFrame | None = None) -> None:
    """groups: video, id, thumbnail_id, bbox_name, cluster_id, is_best; negatives: video, keyframe_id, x, y, w, h."""
    row = F.struct(F.col("id").alias("Id"), F.col("thumbnail_id").alias("ThumbnailId"), F.col("bbox_name").alias("BboxName"), F.col("cluster_id").alias("ClusterId"), F.col("is_best").alias("IsBest"))
    n = F.count_distinct(F.when(F.col("cluster_id") >= 0, F.col("cluster_id"))).alias("NumClusters")
    out = groups.groupBy("video").agg(n, F.array_sort(F.collect_list(row)).alias("BoundingBoxesGroups"))
    if negatives is not None:
        box = F.struct(F.col("x").alias("X"), F.col("y").alias("Y"), F.col("w").alias("Width"), F.col("h").alias("Height"))
        item = F.struct(F.col("keyframe_id").alias("KeyframeId"), box.alias("BoundingBox"))
        out = out.join(negatives.groupBy("video").agg(F.array_sort(F.collect_list(item)).alias("BackgroundNegativeExamples")), "video", "left")
    _documents(out, path)


def write_delimited(df: DataFrame, path: str, sep: str = "\t", append: bool = False) -> None:
    df.write.mode("append" if append else "errorifexists").option("header", True).option("sep", sep).csv(path)


def write_sort(tracks: DataFrame, path: str) -> None:
    """frame, track, rectangle, then flag 0 and three -1."""
    rest = [F.lit(x).alias(n) for x, n in ((0, "flag"), (-1, "f1"), (-1, "f2"), (-1, "f3"))]
    tracks.select("frame_id", "track_id", "x", "y", "w", "h", *rest).write.csv(path)


def write_sort_ini(videos: DataFrame, path: str) -> None:
    """A section per video (name, frame_rate, frames, width, height) in the form of an ini file."""
    pairs = (("name", "name"), ("imDir", "img1"), ("frameRate", "frame_rate"), ("seqLength", "frames"), ("imWidth", "width"), ("imHeight", "height"), ("imExt", ".jpg"))
    lines = [F.concat(F.lit(f"{k}="), F.col(v).cast("string") if v in videos.columns else F.lit(v)) for k, v in pairs]
    videos.select("name", F.concat_ws("\n", F.lit("[Sequence]"), *lines).alias("value")).write.partitionBy("name").text(path)


def write_triplet_images(triplets: DataFrame, path: str) -> None:
    """anchor, positive, negative: the bytes of three images, in base 64, tab-separated."""
    triplets.select(*[F.regexp_replace(F.base64(c), r"\s", "").alias(c) for c in ("anchor", "positive", "negative")]).write.option("sep", "\t").csv(path)


def write_triplets(triplets: DataFrame, path: str) -> None:
    """shotId (shot_007), anchor, positive, negative as texts."""
    rows = triplets.select(F.format_string("shot_%03d", "shot_id").alias("shotId"), *[F.col(c).cast("string").alias(c) for c in ("anchor", "positive", "negative")])
    _documents(rows, path)


def write_vectors(rows: DataFrame, path: str, metadata: list[str], order: str = "box_id") -> None:
    """Projector files: vectors as tab-separated text and their metadata, line by line of the same row.

    Both are written in one pass, so that the lines of vectors/part-N and metadata/part-N of one partition agree.
    """
    vector = F.concat_ws("\t", F.transform("features", lambda x: x.cast("string")))
    facts = F.concat_ws("\t", *[F.col(c).cast("string") for c in metadata])
    both = rows.select(order, vector.alias("vectors"), facts.alias("metadata")).orderBy(order)
    both = both.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in ("vectors", "metadata")])).alias("x"))
    both.select("x.kind", "x.value").write.partitionBy("kind").text(path)


def write_by_shot(tracks: DataFrame, path: str) -> None:
    tracks.write.partitionBy("shot_id").parquet(path)


def pending(inputs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Inputs whose output is not there yet."""
    return inputs.join(done.select(key), key, "left_anti")
