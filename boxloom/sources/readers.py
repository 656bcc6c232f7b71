"""Readers of detection data; all schemas are explicit."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boxloom.functions.text import clock_to_seconds, file_stem

_RECT = "x int, y int, width int, height int"
DETECTIONS = f"""keyFrameWidth int, keyFrameHeight int, nativeKeyframeWidth int, nativeKeyframeHeight int,
characterBoundingBoxes array<struct<id: bigint, file: string, keyFrameIndex: int, keyframeThumbnailId: string, {_RECT.replace(' int', ': int')},
rect: struct<{_RECT.replace(' int', ': int')}>, confidence: double, features: array<double>, thumbnailId: string, character: string, ioU: double,
{", ".join(f"{n}Tsv: double, {n}_tsv: double" for n in ("x", "y", "width", "height"))}>>"""
LEGACY = "KeyFrameWidth int, KeyFrameHeight int, KeyFrames array<map<string, string>>"
GROUPS = """NumClusters int, BoundingBoxesGroups array<struct<Id: bigint, ThumbnailId: string, BboxName: bigint, ClusterId: int, IsBest: boolean>>,
BackgroundNegativeExamples array<struct<KeyframeId: string, BoundingBox: struct<X: int, Y: int, Width: int, Height: int>>>"""
SORT = "frame_id int, detection_id int, x double, y double, w double, h double, flag double, f1 double, f2 double, f3 double"
SHOT = r"^Shot #"


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    """One row per box of the JSON files at path; the frame size defaults to 320 x 180. NaN and null features are 0.

    The fields of a label (character, IoU, truth rectangle) are null where there is none; place is the box's order in
    its file by frame and id.
    """
    raw = spark.read.schema(DETECTIONS).option("allowNonNumericNumbers", True).json(path, multiLine=True)
    size = lambda a, b, c: F.coalesce(a, b, F.lit(c))
    rows = raw.select(F.input_file_name().alias("video"), size("keyFrameWidth", "nativeKeyframeWidth", 320).alias("frame_width"), size("keyFrameHeight", "nativeKeyframeHeight", 180).alias("frame_height"), F.explode("characterBoundingBoxes").alias("b"))
    b = lambda c: F.col(f"b.{c}")
    rect = [F.coalesce(b(c), b(f"rect.{c}")).alias(n) for c, n in (("x", "x"), ("y", "y"), ("width", "w"), ("height", "h"))]
    truth = [F.coalesce(b(f"{c}Tsv"), b(f"{c}_tsv")).alias(f"truth_{n}") for c, n in (("x", "x"), ("y", "y"), ("width", "w"), ("height", "h"))]
    place = F.row_number().over(Window.partitionBy("video").orderBy(b("keyframeThumbnailId"), b("id")))
    features = F.transform(b("features"), lambda x: F.nanvl(F.coalesce(x, F.lit(0.0)), F.lit(0.0)))
    return rows.select("video", "frame_width", "frame_height", b("id").alias("box_id"), b("keyframeThumbnailId").alias("keyframe_id"), *rect, b("confidence").alias("confidence"), features.alias("features"), b("thumbnailId").alias("thumbnail_id"), b("character").alias("character"), b("ioU").alias("truth_iou"), *truth, b("character").isNotNull().alias("is_labeled"), b("file").alias("file"), place.alias("place"))


def read_legacy(spark: SparkSession, path: str) -> DataFrame:
    """One row per file of the older form: video, frame_width, frame_height, keyframes (their fields as texts)."""
    raw = spark.read.schema(LEGACY).json(path, multiLine=True)
    return raw.select(F.input_file_name().alias("video"), F.col("KeyFrameWidth").alias("frame_width"), F.col("KeyFrameHeight").alias("frame_height"), F.col("KeyFrames").alias("keyframes"))


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """video (the file), group_id and bbox_group from 0, by thumbnail; of repeated thumbnails of a file the last row counts."""
    raw = spark.read.schema(GROUPS).json(path, multiLine=True).select(F.input_file_name().alias("video"), "BoundingBoxesGroups")
    raw = raw.select("video", F.posexplode("BoundingBoxesGroups").alias("at", "g"))
    last = F.row_number().over(Window.partitionBy("video", "g.ThumbnailId").orderBy(F.desc("at")))
    rows = raw.withColumn("last", last).where("last = 1")
    return rows.select("video", (F.col("g.Id") - 1).alias("group_id"), F.col("g.ThumbnailId").alias("thumbnail_id"), (F.col("g.BboxName") - 1).alias("bbox_group"), F.col("g.ClusterId").alias("cluster_id"), F.col("g.IsBest").alias("is_best"))


def read_negatives(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(GROUPS).json(path, multiLine=True).select(F.explode("BackgroundNegativeExamples").alias("n"))
    return raw.select(F.col("n.KeyframeId").alias("keyframe_id"), *[F.col(f"n.BoundingBox.{c}").alias(a) for c, a in (("X", "x"), ("Y", "y"), ("Width", "w"), ("Height", "h"))])


def parse_shots(lines: DataFrame, column: str = "value") -> DataFrame:
    """Shots of a log: shot_id, start_sec, end_sec, frame_start, frame_end. Other lines are left out."""
    f = F.split(F.col(column), ",")
    last = lambda i: F.element_at(F.split(F.trim(f[i]), " +"), -1).cast("double")
    frames = lambda n: F.regexp_extract(f[4], r"(\d+)\s*~\s*(\d+)", n).cast("long")
    rows = lines.where(F.col(column).rlike(SHOT))
    return rows.select(F.regexp_extract(f[0], r"#\s*(\d+)", 1).cast("long").alias("shot_id"), last(2).alias("start_sec"), last(3).alias("end_sec"), frames(1).alias("frame_start"), frames(2).alias("frame_end"))


def read_shots(spark: SparkSession, path: str) -> DataFrame:
    return parse_shots(spark.read.text(path))


def parse_keyframes(names: DataFrame, column: str) -> DataFrame:
    """id and frame_number from the last two parts of an image name; names of fewer than four parts are an error."""
    parts = F.split(file_stem(F.col(column)), "_")
    bad = F.raise_error(F.concat(F.lit("not a keyframe: "), F.col(column)))
    take = lambda i: F.when(F.size(parts) >= 4, F.element_at(parts, i).cast("long")).otherwise(bad.cast("long"))
    return names.select(take(-2).alias("id"), take(-1).alias("frame_number"), F.col(column).alias("file"))


_BOOK = "_title string, characters struct<character: array<struct<_id: string, _name: string>>>, pages struct<page: array<struct<_index: int, _width: int, _height: int, body: array<struct<_id: string, _xmin: int, _ymin: int, _xmax: int, _ymax: int, _character: string>>>>>"


def _books(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_BOOK).option("rowTag", "book").xml(path).withColumn("book", F.coalesce("_title", F.input_file_name()))


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """Bodies of ground-truth XML: book (its title, or file), page, body_id, rectangle, character; the first of a page's repeated body ids counts."""
    raw = _books(spark, path).select("book", F.explode("pages.page").alias("p")).select("book", "p._index", "p._width", "p._height", F.posexplode("p.body").alias("at", "b"))
    first = F.row_number().over(Window.partitionBy("book", "_index", "b._id").orderBy("at"))
    rows = raw.withColumn("first", first).where("first = 1")
    return rows.select("book", F.col("_index").alias("page"), F.col("b._id").alias("body_id"), F.col("b._xmin").alias("x"), F.col("b._ymin").alias("y"), (F.col("b._xmax") - F.col("b._xmin")).alias("w"), (F.col("b._ymax") - F.col("b._ymin")).alias("h"), F.col("b._character").alias("character"), F.col("_width").alias("page_width"), F.col("_height").alias("page_height"))


def read_characters(spark: SparkSession, path: str) -> DataFrame:
    """book, character, name of the characters that ground-truth XML lists."""
    rows = _books(spark, path).select("book", F.explode("characters.character").alias("c"))
    return rows.select("book", F.col("c._id").alias("character"), F.col("c._name").alias("name"))


def read_sort(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SORT).csv(path)


def read_insights(spark: SparkSession, path: str) -> DataFrame:
    """Time ranges of shots in insight JSON, in seconds."""
    schema = "videos array<struct<insights: struct<shots: array<struct<id: int, instances: array<struct<start: string, `end`: string>>>>>>>"
    raw = spark.read.schema(schema).json(path, multiLine=True).select(F.explode(F.col("videos")[0]["insights"]["shots"]).alias("s"))
    rows = raw.select(F.col("s.id").alias("shot_id"), F.explode("s.instances").alias("i"))
    return rows.select("shot_id", clock_to_seconds(F.col("i.start")).alias("start"), clock_to_seconds(F.col("i.end")).alias("end"))


def read_triplets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("shotId string, anchor string, positive string, negative string").json(path, multiLine=True)


def read_triplet_images(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("anchor string, positive string, negative string").option("sep", "\t").csv(path)
    return rows.select(*[F.unbase64(c).alias(c) for c in rows.columns])


def read_label_map(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.rtrim("value").alias("label"))


def read_tables(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """A folder of delimited files with a header each; lines that don't fit the schema are left out."""
    return spark.read.schema(schema).option("header", True).option("sep", sep).option("mode", "DROPMALFORMED").option("ignoreCorruptFiles", True).csv(path)


PREDICTIONS = "Id string, MappedLabel string, OriginalLabel string, Prediction string, OriginalPrediction string, Probability double, RawResult string"


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Classifier results with the thumbnail_id, the stem of the file that Id names, and the tag and probability of each raw result."""
    rows = read_tables(spark, path, PREDICTIONS, "\t").withColumn("thumbnail_id", file_stem(F.col("Id")))
    parts = F.filter(F.split(F.regexp_replace("RawResult", r"^\[|\]$", ""), ","), lambda x: F.trim(x) != "")
    tag = lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("tag"), F.substring_index(x, ":", -1).try_cast("double").alias("probability"))
    return rows.withColumn("tags", F.transform(parts, tag))


def read_images(spark: SparkSession, path: str, pattern: str = "*.{jpg,jpeg,png,bmp}") -> DataFrame:
    """Images of a folder and those below it: path, thumbnail_id, content, in order of their paths."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return rows.select("path", file_stem(F.col("path")).alias("thumbnail_id"), "content").orderBy("path")


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, folder, name and size of the files under a folder; their contents are not read."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return rows.select("path", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder"), F.regexp_extract("path", "([^/]*)$", 1).alias("name"), F.col("length").alias("size"))


def file_counts(files: DataFrame, folders: DataFrame) -> DataFrame:
    """folders (folder) with n, their files; -1 for those that files (folder) has not."""
    n = files.groupBy("folder").agg(F.count("*").alias("n"))
    return folders.join(n, "folder", "left").select("folder", F.coalesce("n", F.lit(-1)).cast("long").alias("n"))


@dataclass(frozen=True)
class Configuration:
    """The settings of a JSON configuration, read once."""

    values: tuple[tuple[str, str], ...]

    def __getitem__(self, name: str) -> str:
        return dict(self.values)[name]


@lru_cache(maxsize=16)
def read_configuration(spark: SparkSession, path: str) -> Configuration:
    """One shared copy of the settings of a JSON file with one object of texts, numbers and truth values."""
    row = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, string>").alias("m")).first()
    return Configuration(tuple(sorted(row["m"].items())))


def parse_report(lines: DataFrame, column: str = "value") -> DataFrame:
    """(key, value) of the lines of a device report that have exactly one colon."""
    parts = F.split(F.col(column), ":")
    return lines.where(F.size(parts) == 2).select(F.trim(parts[0]).alias("key"), F.trim(parts[1]).alias("value"))
