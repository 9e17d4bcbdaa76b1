"""JSON documents and text labels as typed tables.

Every reader declares its schema, so nothing is inferred, and takes a path or
glob that may name millions of files.  The video id comes from the folder name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as T
from ..functions.geometry import clamp
from ..operators.frames import restore_frames

REFINED = "_refined"


def _folder() -> Column:
    """Name of the folder that holds the file."""
    return F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)


def _stem() -> Column:
    return F.regexp_extract("_metadata.file_name", r"^(.*)\.[^.]*$", 1)


def _documents(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def video_id(folder: Column) -> Column:
    return F.replace(folder, F.lit(REFINED), F.lit(""))


def analysis_pass(folder: Column) -> Column:
    return F.when(folder.contains(REFINED), "refined").otherwise("first")


def read_analysis(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(frames, videos) of analysis documents ``.../<video>/analysis.json``."""
    docs = _documents(spark, path, T.ANALYSIS_DOC).select(
        video_id(_folder()).alias("video_id"), analysis_pass(_folder()).alias("pass"), "*"
    )
    frames = restore_frames(docs.select("video_id", "pass", F.inline("frames")))
    info = F.col("video_info")
    videos = docs.select(
        "video_id", "pass", F.coalesce(info.fps, F.lit(T.DEFAULT_FPS)).alias("fps"), info.duration_s.alias("duration_s"),
        info.total_frames.alias("total_frames"), F.coalesce(info.width, F.lit(T.DEFAULT_WIDTH)).alias("width"),
        F.coalesce(info.height, F.lit(T.DEFAULT_HEIGHT)).alias("height"), info.codec.alias("codec"), "config",
        F.coalesce("analysis_version", F.lit(0)).alias("analysis_version"),
        F.coalesce("derived_version", F.lit(0)).alias("derived_version"),
    )
    return frames, videos


def _number(c: Column) -> Column:
    return c.try_cast("double")


def clean_polygon(raw: Column) -> Column:
    """Points with two numbers, clamped to 0-1; malformed ones are dropped."""
    points = F.filter(
        F.coalesce(raw, F.expr("cast(array() as array<array<string>>)")),
        lambda p: (F.size(p) >= 2) & _number(F.get(p, F.lit(0))).isNotNull() & _number(F.get(p, F.lit(1))).isNotNull(),
    )
    return F.transform(
        points,
        lambda p: F.struct(clamp(_number(p[0]), 0.0, 1.0).alias("x"), clamp(_number(p[1]), 0.0, 1.0).alias("y")),
    )


def clean_keyframe(k: Column) -> Column:
    o, d = k["axis"]["origin"], k["axis"]["direction"]
    a, b, known = k["scale"]["point_a"], k["scale"]["point_b"], _number(k["scale"]["known_distance_m"])

    def at(arr, i):
        return _number(F.get(arr, F.lit(i)))

    axis = F.when(
        (F.size(o) >= 2) & (F.size(d) >= 2),
        F.struct(at(o, 0).alias("ox"), at(o, 1).alias("oy"), at(d, 0).alias("dx"), at(d, 1).alias("dy")),
    )
    scale = F.when(
        known.isNotNull() & (F.size(a) >= 2) & (F.size(b) >= 2),
        F.struct(known.alias("known_distance_m"), at(a, 0).alias("ax"), at(a, 1).alias("ay"), at(b, 0).alias("bx"), at(b, 1).alias("by")),
    )
    return F.struct(
        F.coalesce(k["frame_idx"], F.lit(0)).alias("frame_idx"),
        *[clean_polygon(k[c]).alias(c) for c in ("track_polygon", "corridor_polygon", "landing_zone")],
        axis.alias("axis"), scale.alias("scale"), k["source"].alias("source"), k["venue_confidence"].alias("venue_confidence"),
    )


def read_calibration(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Normalised calibration: ``calibrations``, ``keyframes``, ``seeds``, ``mask_frames``."""
    docs = _documents(spark, path, T.CALIBRATION_DOC).select(video_id(_folder()).alias("video_id"), "*")
    has_seeds = F.coalesce(F.size("seeds"), F.lit(0)) > 0
    mode = F.coalesce(
        F.col("mode"),
        F.when(F.coalesce("schema_version", F.lit(1)) >= 2, F.when(has_seeds, "seed_auto").otherwise("manual")),
    )
    seed = lambda s: F.struct(
        F.coalesce(s["frame_idx"], F.lit(0)).alias("frame_idx"), clean_polygon(s["seed_points"]).alias("seed_points"),
        s["labels"].alias("labels"), clean_polygon(s["track_polygon"]).alias("track_polygon"),
        clean_polygon(s["landing_zone"]).alias("landing_zone"),
    )
    return {
        "calibrations": docs.select(
            "video_id", mode.alias("mode"), F.size(F.coalesce(F.map_keys("mask_frames"), F.array())).alias("n_mask_frames")
        ),
        "keyframes": docs.select("video_id", F.inline(F.transform("keyframes", clean_keyframe))),
        "seeds": docs.select("video_id", F.inline(F.transform("seeds", seed))),
        "mask_frames": docs.select("video_id", F.explode("mask_frames").alias("k", "m")).select(
            "video_id", F.col("k").cast("int").alias("frame_idx"), "m.*"
        ),
    }


def read_sections(spark: SparkSession, path: str, videos: DataFrame | None = None) -> dict[str, DataFrame]:
    """``sections``, ``contacts``, ``markers``, ``phases``; all seven phases per video.

    Videos without a document get the empty default.
    """
    docs = _documents(spark, path, T.SECTIONS_DOC).select(video_id(_folder()).alias("video_id"), "*")
    if videos is not None:
        docs = videos.select("video_id").distinct().join(docs, "video_id", "left")
    names = F.array(*[F.lit(p) for p in T.PHASES])
    bounds = F.transform(
        names,
        lambda p: F.struct(
            p.alias("phase"), F.col("phases")[p]["start_frame"].alias("start_frame"), F.col("phases")[p]["end_frame"].alias("end_frame")
        ),
    )
    return {
        "sections": docs.select(
            "video_id", F.coalesce("derived_version", F.lit(0)).alias("derived_version"), "athlete_id",
            F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "notes",
        ),
        "contacts": docs.select("video_id", F.inline("contacts")),
        "markers": docs.select("video_id", F.inline("phase_markers")),
        "phases": docs.select("video_id", F.inline(bounds)),
    }


def read_sessions(spark: SparkSession, path: str, athlete: str | None = None, exclude_video: str | None = None) -> DataFrame:
    """Session snapshots ``<athlete>/sessions/<video>.json`` or a table by athlete_id."""
    docs = _documents(spark, path, T.SESSION_DOC)
    rows = docs.select("*", _stem().alias("video_id"))
    if athlete is not None:
        rows = rows.filter(F.col("athlete_id") == athlete)
    return rows if exclude_video is None else rows.filter(F.col("video_id") != exclude_video)


def read_gt(spark: SparkSession, path: str) -> DataFrame:
    return _documents(spark, path, T.GT_DOC).select(F.inline("samples"))


def _entries(docs: DataFrame, *keep: str) -> DataFrame:
    def rows(col, kind):
        return docs.select(*keep, F.lit(kind).alias("kind"), F.explode(col).alias("key", "_e")).select(
            *keep, "kind", "key", "_e.*"
        )

    return rows("phases", "phase").unionByName(rows("pose_tags", "tag"))


def read_prototypes(spark: SparkSession, path: str) -> DataFrame:
    return _entries(_documents(spark, path, T.PROTOTYPES_DOC))


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """Athlete templates ``<athlete>/pose_templates.json``."""
    docs = _documents(spark, path, T.TEMPLATES_DOC).withColumn("athlete_id", F.coalesce("athlete_id", _folder()))
    return _entries(docs, "athlete_id")


def read_video_meta(spark: SparkSession, path: str) -> DataFrame:
    """Sidecars ``<video>.meta.json``."""
    name = F.regexp_replace("_metadata.file_name", r"\.meta\.json$", "")
    return _documents(spark, path, T.META_DOC).select(name.alias("video_id"), "*")


def read_detections(spark: SparkSession, path: str, min_area: float = 4000.0) -> DataFrame:
    """Person detections from parquet, without boxes below the minimum area."""
    rows = spark.read.schema(T.DETECTIONS).parquet(path)
    return rows.filter((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")) >= min_area)


def parse_labels(lines: DataFrame) -> DataFrame:
    """Label lines ``class x y x y ...`` (column ``value``) as class and polygon."""
    parts = F.transform(F.split(F.trim("value"), r"\s+"), lambda p: p.try_cast("double"))
    keep = [c for c in lines.columns if c != "value"]
    split = lines.filter(F.length(F.trim("value")) > 0).select(*keep, parts.alias("_p"))
    n = F.floor((F.size("_p") - 1) / 2).cast("int")
    points = F.when(
        n >= 3,
        F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.get("_p", 2 * i - 1).alias("x"), F.get("_p", 2 * i).alias("y"))),
    )
    return split.select(*keep, F.get("_p", F.lit(0)).cast("int").alias("class"), points.alias("points"))


def read_polygon_labels(spark: SparkSession, path: str) -> DataFrame:
    """Label files ``labels/<split>/<video>_<frame>.txt`` as polygon rows."""
    lines = spark.read.text(path).select(
        _folder().alias("split"),
        F.regexp_extract("_metadata.file_name", r"^(.*)_(\d+)\.txt$", 1).alias("video_id"),
        F.regexp_extract("_metadata.file_name", r"^(.*)_(\d+)\.txt$", 2).cast("int").alias("frame_idx"),
        "value",
    )
    return parse_labels(lines)
