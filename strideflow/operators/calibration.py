"""Calibration seeds: polygons from labelled points, spread over frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import corners_by_label
from .joins import bracket_interpolate, nearest_seed_wins

# Label names.
CORNERS = ("corner_tl", "corner_tr", "corner_br", "corner_bl")
ARENA = ("arena_tl", "arena_tr", "arena_br", "arena_bl", "arena")


def polygon_from_seed(points: str = "seed_points", labels: str = "labels", polygon: str = "track_polygon") -> Column:
    """The drawn polygon, else the four labelled corners, else the first four points."""
    pts = F.col(points)
    corners = corners_by_label(pts, F.coalesce(F.col(labels), F.array().cast("array<string>")), CORNERS)
    return (
        F.when(F.coalesce(F.size(polygon), F.lit(0)) >= 3, F.col(polygon))
        .when(F.size(pts) >= 4, F.coalesce(corners, F.slice(pts, 1, 4)))
        .otherwise(pts)
    )


def landing_from_seed(points: str = "seed_points", labels: str = "labels", zone: str = "landing_zone") -> Column:
    """The drawn zone, else at least three points with a pit label, else empty."""
    pairs = F.arrays_zip(F.col(points).alias("p"), F.coalesce(F.col(labels), F.array().cast("array<string>")).alias("l"))
    pit = F.transform(
        F.filter(pairs, lambda e: e["l"].isin(*ARENA) & e["p"].isNotNull()), lambda e: e["p"]
    )
    nothing = F.slice(F.col(points), 1, 0)
    return F.when(F.coalesce(F.size(zone), F.lit(0)) >= 3, F.col(zone)).otherwise(
        F.when(F.size(pit) >= 3, pit).otherwise(nothing)
    )


def spread_seeds(chains: DataFrame, targets: DataFrame) -> DataFrame:
    """One calibration per target frame from the propagated chains of all seeds.

    Where chains overlap the closest seed wins; frames no chain reached are
    blended between their neighbours.
    """
    anchors = nearest_seed_wins(chains.filter(F.coalesce(F.size("track_polygon"), F.lit(0)) > 0))
    filled = bracket_interpolate(
        targets.select("video_id", "frame_idx").distinct(),
        anchors.select("video_id", "frame_idx", "track_polygon", "landing_zone"),
    )
    return filled.filter(F.size("track_polygon") > 0).select(
        "video_id", "frame_idx", "track_polygon", "landing_zone"
    )


def has_seeds(points: str = "seed_points", polygon: str = "track_polygon") -> Column:
    return (F.coalesce(F.size(points), F.lit(0)) >= 4) | (F.coalesce(F.size(polygon), F.lit(0)) >= 3)
