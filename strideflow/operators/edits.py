"""Manual changes as joins and merges: markers, corrections, overrides, versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import PHASES

OVERRIDE_KEYS = (
    "hops_corridor_m", "hop_lengths_m", "total_length_m", "known_distance_m", "point_a", "point_b", "m_per_px", "notes",
)
TRACK_FIELDS = ("track_overlap", "athlete_state", "position_s", "predicted_bbox")
CLICK_PAD = 200


# ------------------------------------------------------------ markers

def add_markers(markers: DataFrame, new: DataFrame) -> DataFrame:
    """Add one marker per video (several: the last ``seq`` of a frame or phase wins).

    Existing markers on the same frame or of the same phase are dropped.
    """
    known = F.col("phase").isin(*PHASES)
    message = F.concat(F.lit("invalid phase "), F.coalesce("phase", F.lit("null")), F.lit("; use one of "), F.lit(", ".join(PHASES)))
    checked = new.withColumn("phase", F.when(known, F.col("phase")).otherwise(F.raise_error(message).cast("string")))
    if "seq" in checked.columns:
        later = checked.select("video_id", F.col("seq").alias("_s"), F.col("frame_idx").alias("_f"), F.col("phase").alias("_p"))
        clash = (F.col("_s") > F.col("seq")) & ((F.col("_f") == F.col("frame_idx")) | (F.col("_p") == F.col("phase")))
        # A later edit removes this marker; edits per video are a handful.
        checked = checked.join(later.withColumnRenamed("video_id", "_v"), (F.col("_v") == F.col("video_id")) & clash, "left_anti").drop("seq")
        touched = new
    else:
        touched = checked
    kept = markers.join(touched.select("video_id", "frame_idx"), ["video_id", "frame_idx"], "left_anti")
    kept = kept.join(touched.select("video_id", "phase"), ["video_id", "phase"], "left_anti")
    return kept.unionByName(checked, allowMissingColumns=True)


def remove_markers(markers: DataFrame, removed: DataFrame) -> DataFrame:
    return markers.join(removed.select("video_id", "frame_idx"), ["video_id", "frame_idx"], "left_anti")


def move_markers(markers: DataFrame, moves: DataFrame, frames: DataFrame | None = None) -> DataFrame:
    """Move a marker per video (from_idx to to_idx); an occupied target swaps.

    Both become manual and take the time of their new frame when it exists.
    """
    j = markers.join(moves.select("video_id", "from_idx", "to_idx"), "video_id", "left")
    to = (
        F.when(F.col("frame_idx") == F.col("from_idx"), F.col("to_idx"))
        .when(F.col("frame_idx") == F.col("to_idx"), F.col("from_idx"))
        .otherwise(F.col("frame_idx"))
    )
    moved = j.withColumns({"_moved": to != F.col("frame_idx"), "frame_idx": to}).drop("from_idx", "to_idx")
    moved = moved.withColumn("source", F.when(F.col("_moved"), "manual").otherwise(F.col("source")))
    if frames is not None:
        at = frames.select("video_id", "frame_idx", F.round("timestamp_s", 3).alias("_t"))
        moved = moved.join(at, ["video_id", "frame_idx"], "left").withColumn(
            "timestamp_s", F.when(F.col("_moved"), F.coalesce("_t", "timestamp_s")).otherwise(F.col("timestamp_s"))
        ).drop("_t")
    return moved.drop("_moved").select(*markers.columns)


# ------------------------------------------------------------ corrections

def apply_corrections(frames: DataFrame, corrected: DataFrame) -> DataFrame:
    """Corrected frames replace the stored fields; four track fields survive a null.

    Columns that ``corrected`` does not carry stay untouched.
    """
    fields = [c for c in corrected.columns if c not in ("video_id", "frame_idx") and c in frames.columns]
    new = corrected.select("video_id", "frame_idx", F.struct(*fields).alias("_new"))
    j = frames.join(new, ["video_id", "frame_idx"], "left")
    hit = F.col("_new").isNotNull()

    def merged(c):
        value = F.coalesce(F.col(f"_new.{c}"), F.col(c)) if c in TRACK_FIELDS else F.col(f"_new.{c}")
        return F.when(hit, value).otherwise(F.col(c))

    return j.withColumns({c: merged(c) for c in fields}).select(*frames.columns)


def correction_range(corrections: DataFrame, frames: DataFrame) -> DataFrame:
    """Frames a correction touches: radius on both sides, forward end limited.

    ``end_frame`` limits the forward side, ``total_frames`` the video; a mask
    edit without a forward tracker touches only its own frame.
    """
    r = F.when(
        (F.col("correction_type") == "mask_correction") & F.col("sot_backend").isNull(), 0
    ).otherwise(F.col("propagation_radius"))
    c = corrections.withColumn("_r", r)
    low = F.greatest(F.lit(0), F.col("frame_idx") - F.col("_r"))
    high = F.least(F.col("frame_idx") + F.col("_r"), F.coalesce("end_frame", F.col("frame_idx") + F.col("_r")), F.col("total_frames") - 1)
    reach = c.filter(low <= high).select(
        "video_id", F.col("frame_idx").alias("correction_idx"), F.explode(F.sequence(low, F.greatest(low, high))).alias("frame_idx")
    )
    return reach.join(frames.select("video_id", "frame_idx"), ["video_id", "frame_idx"], "left_semi")


def bbox_from_correction(df: DataFrame, width: int = 1280, height: int = 720) -> DataFrame:
    """Box of a correction: drawn box clamped, 200 px around a click, bounds of a mask.

    ``df``: correction_type, x1..y2, x, y and cells (ARRAY<STRUCT<x, y>> or null).
    """
    def whole(c):
        return c.cast("int").cast("double")

    full = F.array(F.lit(0.0), F.lit(0.0), F.lit(float(width)), F.lit(float(height)))
    drawn = F.array(
        F.greatest(F.lit(0.0), whole(F.col("x1"))), F.greatest(F.lit(0.0), whole(F.col("y1"))),
        F.least(F.lit(float(width)), whole(F.col("x2"))), F.least(F.lit(float(height)), whole(F.col("y2"))),
    )
    cx, cy = whole(F.col("x")), whole(F.col("y"))
    click = F.array(
        F.greatest(F.lit(0.0), cx - CLICK_PAD), F.greatest(F.lit(0.0), cy - CLICK_PAD),
        F.least(F.lit(float(width)), cx + CLICK_PAD), F.least(F.lit(float(height)), cy + CLICK_PAD),
    )
    xs, ys = F.transform("cells", lambda c: c.x), F.transform("cells", lambda c: c.y)
    painted = F.when(F.size("cells") > 0, F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)))
    kind = F.col("correction_type")
    return df.withColumn(
        "bbox",
        F.when(kind == "bbox_correction", drawn).when(kind == "click_selection", click)
        .when(kind == "mask_correction", F.coalesce(painted, full)).otherwise(full),
    )


# ------------------------------------------------------------ overrides and merges

def merge_overrides(stored: Column, update: Column, clear: Column) -> Column:
    """MAP merge: known keys with a value win, then the cleared keys are dropped.

    A set corridor also becomes the older total length if that is present.
    """
    allowed = F.array(*[F.lit(k) for k in OVERRIDE_KEYS])
    fresh = F.map_filter(update, lambda k, v: F.array_contains(allowed, k) & v.isNotNull())
    base = F.coalesce(stored, F.expr("cast(map() as map<string,string>)"))
    merged = F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(fresh, k)), fresh)
    dropped = F.coalesce(clear, F.array().cast("array<string>"))
    left = F.map_filter(merged, lambda k, _: ~F.array_contains(dropped, k))
    corridor = left["hops_corridor_m"]
    synced = F.transform_values(left, lambda k, v: F.when((k == "total_length_m") & corridor.isNotNull(), corridor).otherwise(v))
    return synced


def apply_overrides(metrics: DataFrame, edits: DataFrame) -> DataFrame:
    """Stored overrides of each video merged with its edit (update, clear)."""
    j = metrics.join(edits.select("video_id", "update", "clear"), "video_id", "left")
    update = F.coalesce("update", F.expr("cast(map() as map<string,string>)"))
    return j.withColumn("overrides", merge_overrides(F.col("overrides"), update, F.col("clear"))).select(*metrics.columns)


def stamp_scale(keyframes: DataFrame, scales: DataFrame) -> DataFrame:
    """Put a known distance on the first keyframe of each video; create one if none.

    ``scales``: video_id, scale.
    """
    first = keyframes.groupBy("video_id").agg(F.min("frame_idx").alias("frame_idx"))
    at = scales.join(first, "video_id", "left").withColumn("frame_idx", F.coalesce("frame_idx", F.lit(0)))
    j = keyframes.join(at.withColumnRenamed("scale", "_s"), ["video_id", "frame_idx"], "full_outer")
    return j.withColumn("scale", F.coalesce("_s", "scale")).select(*keyframes.columns)


def venue_corridor(venues: DataFrame, changed: DataFrame) -> DataFrame:
    """Venue table with the corridor lengths set by edits (venue_id, hops_corridor_m)."""
    new = changed.groupBy("venue_id").agg(F.max("hops_corridor_m").alias("_m"))
    return venues.join(new, "venue_id", "full_outer").withColumn("scale_m", F.coalesce("_m", "scale_m")).drop("_m")


def merge_selections(calibrated: DataFrame, samples: DataFrame) -> DataFrame:
    """Per frame, fields given by a user sample override the calibration's."""
    fields = [c for c in calibrated.columns if c not in ("video_id", "frame_idx")]
    s = samples.select("video_id", "frame_idx", *[F.col(c).alias(f"_s_{c}") for c in fields])
    j = calibrated.join(s, ["video_id", "frame_idx"], "full_outer")
    return j.select("video_id", "frame_idx", *[F.coalesce(f"_s_{c}", c).alias(c) for c in fields])


def append_distinct(listed: Column, added: Column) -> Column:
    """Contributor list with new names at the end, each once."""
    return F.array_union(F.coalesce(listed, F.array().cast("array<string>")), added)


def upsert_sessions(sessions: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Replace the (athlete, video) snapshots."""
    key = ["athlete_id", "video_id"]
    return sessions.join(snapshot.select(*key), key, "left_anti").unionByName(snapshot, allowMissingColumns=True)


def bump_derived(videos: DataFrame, changed: DataFrame) -> DataFrame:
    """Add one to derived_version of every changed video."""
    hit = changed.select("video_id").distinct().withColumn("_hit", F.lit(1))
    return videos.join(hit, "video_id", "left").withColumn(
        "derived_version", F.coalesce("derived_version", F.lit(0)) + F.coalesce("_hit", F.lit(0))
    ).drop("_hit")


def ensure_stubs(existing: DataFrame, videos: DataFrame, **defaults) -> DataFrame:
    """``existing`` plus a row of defaults for every video that has none."""
    missing = videos.select("video_id").distinct().join(existing.select("video_id"), "video_id", "left_anti")
    return existing.unionByName(missing.withColumns({k: F.lit(v) for k, v in defaults.items()}), allowMissingColumns=True)

