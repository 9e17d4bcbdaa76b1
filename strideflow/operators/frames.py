"""Per-frame enrichment and per-video summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pose
from ..functions.geometry import has_box, rect_area
from ..schemas import ANGLES, DEFAULT_FPS
from .sequence import positions, scan


def analyse_frames(df: DataFrame) -> DataFrame:
    """Keypoint counts, camera angle, quality and the usable flag for each frame."""
    return pose.frame_quality(pose.camera_angle(pose.frame_geometry(df)))


def restore_frames(raw: DataFrame) -> DataFrame:
    """Typed frames from stored records: defaults, known angles, recomputed gaps.

    The angle and the quality are computed again only where the stored angle is
    unknown, a person was detected and keypoints are present.
    """
    c = F.col
    filled = raw.withColumns(
        {
            "frame_idx": F.coalesce(c("frame_idx"), F.lit(0)),
            "timestamp_s": F.coalesce(c("timestamp_s"), F.lit(0.0)),
            "person_detected": F.coalesce(c("person_detected"), F.lit(False)),
            "has_mask": F.coalesce(c("has_mask"), F.lit(False)),
            "mask_area_px": F.coalesce(c("mask_area_px"), F.lit(0)),
            "quality_score": F.coalesce(c("quality_score"), F.lit(0.0)),
            "usable_for_analysis": F.coalesce(c("usable_for_analysis"), F.lit(False)),
            "manually_corrected": F.coalesce(c("manually_corrected"), F.lit(False)),
            "correction_source": F.coalesce(c("correction_source"), F.lit("auto")),
            "tracking_source": F.coalesce(c("tracking_source"), F.lit("bytetrack")),
            **{
                k: F.coalesce(c(k), F.lit(0.0))
                for k in (
                    "shoulder_ratio", "angle_confidence", "torso_height_px",
                    "shoulder_width_px", "body_height_px",
                )
            },
            "camera_angle": F.when(c("camera_angle").isin(*ANGLES), c("camera_angle")).otherwise(
                "UNKNOWN"
            ),
            "person_bbox": F.when(has_box(c("person_bbox")), F.slice("person_bbox", 1, 4)),
            "keypoints": F.filter(
                F.transform(
                    F.coalesce(c("keypoints"), F.array()),
                    lambda k: F.struct(
                        k["name"].alias("name"),
                        F.coalesce(k["x"], F.lit(0.0)).alias("x"),
                        F.coalesce(k["y"], F.lit(0.0)).alias("y"),
                        F.coalesce(k["conf"], F.lit(0.0)).alias("conf"),
                    ),
                ),
                lambda k: F.coalesce(F.length(k["name"]), F.lit(0)) > 0,
            ),
        }
    )
    filled = filled.withColumn("bbox_area", rect_area(c("person_bbox"))).withColumn(
        "keypoints_valid",
        F.coalesce(
            c("keypoints_valid"),
            F.size(F.filter("keypoints", lambda k: k["conf"] >= pose.CONF_ANGLE)),
        ),
    )
    derived = (
        "camera_angle", "shoulder_ratio", "angle_confidence", "torso_height_px",
        "shoulder_width_px", "quality_score", "usable_for_analysis",
    )
    stored = filled.withColumn("_stored", F.struct(*derived))
    again = pose.frame_quality(pose.camera_angle(stored))
    redo = (
        (c("_stored.camera_angle") == "UNKNOWN") & c("person_detected") & (F.size("keypoints") > 0)
    )
    return again.withColumns(
        {k: F.when(redo, c(k)).otherwise(c(f"_stored.{k}")) for k in derived}
    ).drop("_stored")


def sample_frames(
    df: DataFrame, stride: int = 1, start_sec: float = 0.0, end_sec: float | None = None,
    max_frames: int | None = None, fps: str | Column | float = DEFAULT_FPS,
) -> DataFrame:
    """Every ``stride``-th frame of a time window, at most ``max_frames`` per video."""
    rate = F.lit(fps) if isinstance(fps, (int, float)) else (F.col(fps) if isinstance(fps, str) else fps)
    first = F.floor(F.lit(start_sec) * rate)
    kept = df.filter((F.col("frame_idx") >= first) & ((F.col("frame_idx") - first) % stride == 0))
    if end_sec is not None:
        kept = kept.filter(F.col("frame_idx") < F.floor(F.lit(end_sec) * rate))
    if max_frames is None:
        return kept
    placed = positions(kept, ["video_id"], ["frame_idx"], pos="_pos", count="_n")
    return placed.filter(F.col("_pos") <= max_frames).drop("_pos", "_n")


def _pct(part: Column, whole: Column) -> Column:
    return F.round(part / F.greatest(whole, F.lit(1)) * 100, 1)


def sorted_distribution(counts: DataFrame, name: str, value: str, keys=("video_id",)) -> DataFrame:
    """A distribution as text for display: ``name=value`` sorted by name (a few entries a key)."""
    entry = F.struct(F.col(name).alias("n"), F.concat_ws("=", name, F.col(value).cast("string")).alias("e"))
    listed = counts.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("_l"))
    return listed.select(*keys, F.array_join(F.transform("_l", lambda e: e["e"]), ",").alias("entries"))


def top_rows(rows: DataFrame, k: int, order: list[Column], keys=("video_id",), rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each key in a total order; Spark cuts each task's rows to ``k`` before the shuffle."""
    line = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(line)).filter(F.col(rank) <= k)


def angle_distribution(frames: DataFrame, keys=("video_id",)) -> DataFrame:
    """Share of each camera angle among the frames with a person, in percent."""
    counted = frames.filter("person_detected").groupBy(*keys, "camera_angle").agg(
        F.count(F.lit(1)).alias("n")
    )
    per_key = counted.groupBy(*keys).agg(
        F.sum("n").alias("total"),
        F.collect_list(F.struct("camera_angle", "n")).alias("angles"),  # five at most
    )
    return per_key.select(
        *keys,
        F.map_from_entries(
            F.transform(
                F.array_sort("angles"),
                lambda a: F.struct(
                    a["camera_angle"].alias("key"), F.round(a["n"] / F.col("total") * 100, 1).alias("value")
                ),
            )
        ).alias("distribution"),
        F.array_max(
            F.transform("angles", lambda a: F.struct(a["n"].alias("n"), a["camera_angle"].alias("a")))
        )["a"].alias("dominant_angle"),
    )


def video_summary(frames: DataFrame, keys=("video_id",)) -> DataFrame:
    """One row per video; ``error`` is set when nobody was detected.

    Everything is a plain aggregate with a map-side part, so one very long video
    costs no more than many short ones.
    """
    seen = F.col("person_detected")
    q = F.when(seen, F.col("quality_score"))
    ratio = F.when(seen & (F.col("shoulder_ratio") > 0), F.col("shoulder_ratio"))

    def count_angle(name):
        return F.count(F.when(seen & (F.col("camera_angle") == name), 1))

    agg = frames.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_frames_analyzed"),
        F.count(F.when(seen, 1)).alias("frames_with_person"),
        F.count(F.when(seen & F.col("usable_for_analysis"), 1)).alias("frames_usable"),
        F.avg(q).alias("_qm"), F.min(q).alias("_qlo"), F.max(q).alias("_qhi"),
        F.avg(ratio).alias("_rm"), F.min(ratio).alias("_rlo"), F.max(ratio).alias("_rhi"),
        F.stddev_pop(ratio).alias("_rsd"),
        F.avg(F.when(seen, F.col("keypoints_valid"))).alias("_kp"),
        F.count_distinct(F.when(seen, F.col("track_id"))).alias("track_id_count"),
        *[count_angle(a).alias(f"_n_{a}") for a in ANGLES],
    )
    n, total = F.col("frames_with_person"), F.col("total_frames_analyzed")
    best = F.array_max(F.array(*[F.struct(F.col(f"_n_{a}").alias("n"), F.lit(a).alias("a")) for a in ANGLES]))

    def or_zero(col):
        return F.when(n > 0, F.coalesce(F.round(col, 3), F.lit(0.0)))

    return agg.select(
        *keys,
        "total_frames_analyzed",
        "frames_with_person",
        _pct(n, total).alias("detection_rate_pct"),
        "frames_usable",
        _pct(F.col("frames_usable"), total).alias("usable_rate_pct"),
        "track_id_count",
        *[
            F.when(n > 0, F.round(F.col(f"_n_{a}") / n * 100, 1)).alias(f"{a.lower()}_pct")
            for a in ANGLES
        ],
        F.when(n > 0, best["a"]).alias("dominant_angle"),
        F.round("_qm", 3).alias("quality_mean"),
        F.round("_qlo", 3).alias("quality_min"),
        F.round("_qhi", 3).alias("quality_max"),
        or_zero(F.col("_rm")).alias("ratio_mean"),
        or_zero(F.col("_rlo")).alias("ratio_min"),
        or_zero(F.col("_rhi")).alias("ratio_max"),
        or_zero(F.col("_rsd")).alias("ratio_std"),
        F.round("_kp", 2).alias("keypoints_valid_avg"),
        F.when(n == 0, F.lit("No person detected in any frame")).alias("error"),
    )


def track_ids(frames: DataFrame, keys=("video_id",)) -> DataFrame:
    """The distinct track ids of a video as rows (they need no per-video list)."""
    return (
        frames.filter(F.col("person_detected") & F.col("track_id").isNotNull())
        .select(*keys, "track_id")
        .distinct()
    )


def usable_ratio(frames: DataFrame, keys=("video_id",)) -> DataFrame:
    """Share of all frames that show the person at a usable angle."""
    ok = pose.usable() & F.coalesce(F.col("person_detected"), F.lit(False))
    return frames.groupBy(*keys).agg(
        (F.count(F.when(ok, 1)) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("usable_ratio"),
        F.max("frame_idx").alias("last_frame_idx"),
    )


def timeline(frames: DataFrame, keys=("video_id",)) -> DataFrame:
    """The per-frame series of the timeline chart; a band ends at the next frame."""
    marked = scan(frames, list(keys), ["frame_idx"], after={"next_timestamp_s": F.col("timestamp_s")})
    return marked.select(
        *keys, "frame_idx", "timestamp_s",
        F.coalesce("next_timestamp_s", F.col("timestamp_s")).alias("next_timestamp_s"),
        "camera_angle", "shoulder_ratio", "quality_score", "usable_for_analysis", "keypoints_valid",
    )


def gap_fill_stats(frames: DataFrame, keys=("video_id",)) -> DataFrame:
    """Counts of the gap fill: anchors, fills per side, re-scored and box-only frames."""
    def n(cond):
        return F.count(F.when(cond, 1))

    action = F.col("fill_action")
    return frames.groupBy(*keys).agg(
        n(F.col("is_anchor")).alias("mid_anchors"),
        n(action == "filled_early").alias("filled_early"),
        n(action == "filled_late").alias("filled_late"),
        n(action == "rescored_early").alias("rescored_early"),
        n(F.col("person_detected") & (F.col("tracking_source") == "refined_v2_bbox_only")).alias("bbox_only"),
    )


def display_frames(frames: DataFrame) -> DataFrame:
    """Quality as 0-100 for display and the time in milliseconds."""
    q = F.col("quality_score")
    scored = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), q)) * 100)
    return frames.select(
        "video_id",
        "frame_idx",
        F.when(q.isNotNull() & ~F.isnan(q), scored)
        .when(F.col("usable_for_analysis") == F.lit(False), 55.0)
        .otherwise(85.0)
        .alias("quality"),
        (F.col("usable_for_analysis") == F.lit(False)).alias("skip"),
        F.round(F.coalesce(F.col("timestamp_s"), F.col("frame_idx") / DEFAULT_FPS) * 1000).alias("time_ms"),
    )
