"""Video catalogue, athlete library, search and the side panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S

UNASSIGNED = "Sin asignar"


def _text(c: Column) -> Column:
    trimmed = F.trim(c)
    return F.when(F.length(trimmed) > 0, trimmed)


def resolve_athlete(
    videos: DataFrame, meta: DataFrame, sections: DataFrame, metrics: DataFrame
) -> DataFrame:
    """Athlete of each video: the sidecar's; sections' then metrics' without a sidecar.

    ``videos`` carries has_analysis; the fallback needs an analysis.
    """
    m = meta.select("video_id", F.lit(True).alias("_meta"), _text(F.col("athlete_id")).alias("_ma"),
                    _text(F.col("note")).alias("note"), _text(F.col("date")).alias("date"))
    s = sections.select("video_id", _text(F.col("athlete_id")).alias("_sa"))
    t = metrics.select("video_id", _text(F.col("athlete_id")).alias("_ta"))
    j = videos.join(m, "video_id", "left").join(s, "video_id", "left").join(t, "video_id", "left")
    fallback = F.when(F.col("_meta").isNull() & F.col("has_analysis"), F.coalesce("_sa", "_ta"))
    return j.withColumn("athlete_id", F.coalesce("_ma", fallback)).drop("_meta", "_ma", "_sa", "_ta")


def catalog(
    videos: DataFrame, passes: DataFrame, meta: DataFrame, sections: DataFrame, metrics: DataFrame
) -> DataFrame:
    """Video listing, analysed first, then by name without case.

    ``videos``: video_id, name, duration_s; ``passes``: video_id, pass.
    """
    have = passes.groupBy("video_id").agg(
        F.max((F.col("pass") == "first").cast("int")).alias("_a"), F.max((F.col("pass") == "refined").cast("int")).alias("_r")
    )
    listed = videos.join(have, "video_id", "left").select(
        *videos.columns,
        (F.coalesce("_a", F.lit(0)) > 0).alias("has_analysis"), (F.coalesce("_r", F.lit(0)) > 0).alias("has_refined"),
    )
    return resolve_athlete(listed, meta, sections, metrics).orderBy(
        F.col("has_analysis").desc(), F.lower("name"), "video_id"
    )


def library(sessions: DataFrame) -> DataFrame:
    """One row per athlete: session count, best success percentage, newest title.

    Sessions stay rows (see :func:`library_sessions`); they are not packed into
    the athlete's row, which may stand for a large share of all sessions.
    """
    name = F.coalesce(_text(F.col("athlete_id")), F.lit(UNASSIGNED))
    grouped = sessions.groupBy(name.alias("athlete")).agg(
        F.count(F.lit(1)).alias("n_sessions"), F.max("success_pct").alias("best_pct"), F.max("title").alias("last_title")
    )
    return grouped.orderBy((F.col("athlete") == UNASSIGNED).cast("int"), "athlete")


def library_sessions(sessions: DataFrame) -> DataFrame:
    """Sessions ordered by athlete (unassigned last), newest title first."""
    name = F.coalesce(_text(F.col("athlete_id")), F.lit(UNASSIGNED))
    return sessions.withColumn("athlete", name).orderBy(
        (F.col("athlete") == UNASSIGNED).cast("int"), "athlete", F.col("title").desc()
    )


def search_library(sessions: DataFrame, q: str = "", athlete: str | None = None) -> DataFrame:
    """Sessions whose athlete, title, note, date or video name contains the text."""
    found = sessions if athlete is None else sessions.filter(F.col("athlete_id") == athlete)
    text = q.strip().lower()
    if not text:
        return found

    def has(c, fold=True):
        col = F.coalesce(F.col(c).cast("string"), F.lit(""))
        return (F.lower(col) if fold else col).contains(text)

    name = F.lower(F.coalesce(_text(F.col("athlete_id")), F.lit(UNASSIGNED)))
    return found.filter(name.contains(text) | has("title") | has("note") | has("date", fold=False) | has("video_id"))


def panel_totals(segments: DataFrame, no_speed: float | None = 0.0) -> DataFrame:
    """Total hop time in ms and mean hop speed of each video; ``no_speed`` where no hop has one."""
    hops = segments.filter(F.col("id").startswith("hop_"))
    return hops.groupBy("video_id").agg(
        F.round(F.sum(F.coalesce("dt_s", F.lit(0.0))) * 1000).alias("total_time_ms"),
        F.coalesce(F.round(F.avg("speed_m_s"), 1), F.lit(no_speed).cast("double")).alias("avg_speed"),
    )


def panel_rows(segments: DataFrame, general: DataFrame, hops: DataFrame) -> DataFrame:
    """One row per hop of the side panel: time, speed, delta and pose quality.

    ``general``: video_id, segment, speed_delta_ms, indicator; ``hops``:
    video_id, phase, score, frame_idx.  Without scored hops the segments fill in.
    """
    seg = segments.filter(F.col("id").startswith("hop_")).groupBy("video_id", F.col("id").alias("phase")).agg(
        F.min(F.struct("from_frame", "dt_s", "speed_m_s")).alias("s")
    )
    scored = hops.select("video_id", "phase", "score", "frame_idx")
    some = scored.select("video_id").distinct().withColumn("_scored", F.lit(True))
    j = scored.withColumn("_hop", F.lit(True)).join(seg, ["video_id", "phase"], "full_outer").join(some, "video_id", "left")
    j = j.filter(F.col("_hop").isNotNull() | F.col("_scored").isNull())
    vs = general.select("video_id", F.col("segment").alias("phase"), "speed_delta_ms", "indicator")
    j = j.join(vs, ["video_id", "phase"], "left")
    score = F.when(F.col("_hop").isNotNull(), F.coalesce("score", F.lit(0.0))).otherwise(0.7)
    return j.select(
        "video_id", "phase", F.upper(F.regexp_replace("phase", "hop_", "H")).alias("label"),
        F.coalesce("frame_idx", "s.from_frame").alias("frame_idx"),
        F.round(F.coalesce("s.dt_s", F.lit(0.0)) * 1000).alias("time_ms"),
        F.round(F.coalesce("s.speed_m_s", F.lit(0.0)), 1).alias("speed"),
        S.delta_vs_row(F.col("speed_delta_ms"), F.col("indicator")).alias("delta"),
        score.alias("pose_quality"), S.label_pose(score).alias("pose_label"),
    )


def dataset_info(labels: DataFrame, keys=("venue_id",)) -> DataFrame:
    """Frames and videos of a venue's data set and whether it can be trained on."""
    frames = labels.select(*keys, "video_id", "frame_idx").distinct()
    agg = frames.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_frames"), F.count_distinct("video_id").alias("video_count")
    )
    n = F.col("total_frames")
    return agg.withColumns({"ready_to_train": (n >= 10) & (F.col("video_count") >= 1), "can_train": n >= 5})


def dataset_manifest(labels: DataFrame, keys=("venue_id",)) -> DataFrame:
    return labels.select(*keys, "video_id", "frame_idx").distinct().groupBy(*keys, "video_id").agg(
        F.count(F.lit(1)).alias("frames_exported")
    )
