"""Event, nearest, as-of, interval and point-in-box joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.pose import bind
from ..schemas import DEFAULT_CORRIDOR_M, PHASES
from .sequence import scan

GRID_W, GRID_H = 160, 90
PATCH_RADIUS = 14


def frames_at(events: DataFrame, frames: DataFrame, prefix: str = "frame") -> DataFrame:
    """Left equi-join of events with the frame they name, packed as one struct."""
    payload = [c for c in frames.columns if c not in ("video_id", "frame_idx")]
    packed = frames.select("video_id", "frame_idx", F.struct(*payload).alias(prefix))
    return events.join(packed, ["video_id", "frame_idx"], "left")


def nearest_frame(
    events: DataFrame, frames: DataFrame, tol: int, keys: Sequence[str] = ("video_id",),
    target: str = "frame_idx", out: str = "nearest_idx",
) -> DataFrame:
    """Closest existing frame within ``tol``; the earlier one on ties; null if none.

    An event has at most ``2 tol + 1`` candidate frames, so they are written out
    and looked up by an equi-join on the full frame key: no sort of the frames,
    no skew, and the few events are the side that moves.
    """
    keys = list(keys)
    wanted = events.select(*keys, target).distinct()
    tries = wanted.select(
        "*", F.explode(F.sequence(F.col(target) - tol, F.col(target) + tol)).alias("_try")
    )
    have = frames.select(*keys, F.col("frame_idx").alias("_try")).distinct()
    best = (
        tries.join(have, [*keys, "_try"])
        .groupBy(*keys, target)
        .agg(F.min(F.struct(F.abs(F.col("_try") - F.col(target)).alias("d"), F.col("_try").alias("f"))).alias("_b"))
        .select(*keys, target, F.col("_b.f").alias(out))
    )
    return events.join(best, [*keys, target], "left")


def asof_both(
    rows: DataFrame, marks: DataFrame, payload: Column, keys: Sequence[str] = ("video_id",),
    at: str = "frame_idx",
) -> DataFrame:
    """Add ``_lo`` (last mark at or before) and ``_hi`` (first mark after) per row."""
    keys = list(keys)
    left = rows.withColumns({"_kind": F.lit(1), "_mark": F.lit(None)})
    right = marks.select(*keys, at, F.lit(0).alias("_kind"), payload.alias("_mark"))
    left = left.drop("_mark")
    both = left.unionByName(right, allowMissingColumns=True)
    # Several rows may share a frame (detections); marks come first on a tie.
    tie = [c for c in ("det_id",) if c in rows.columns]
    seen = scan(
        both, keys, [at, "_kind", *tie], through={"_lo": F.col("_mark")}, after={"_hi": F.col("_mark")}
    )
    return seen.filter(F.col("_kind") == 1).drop("_kind", "_mark")


def nearest_mark(rows: DataFrame, marks: DataFrame, keys=("video_id",), at: str = "frame_idx",
                 out: str = "nearest_idx") -> DataFrame:
    """Closest mark at any distance; the earlier one on ties."""
    seen = asof_both(rows, marks.select(*keys, at).distinct(), F.col(at), keys, at)
    lo, hi, here = F.col("_lo"), F.col("_hi"), F.col(at)
    pick = F.when(lo.isNull(), hi).when(hi.isNull() | (here - lo <= hi - here), lo).otherwise(hi)
    return seen.withColumn(out, pick).drop("_lo", "_hi")


_GEOMETRY = ("track_polygon", "corridor_polygon", "landing_zone", "axis", "scale")


def bracket_interpolate(frames: DataFrame, keyframes: DataFrame, at: str = "frame_idx") -> DataFrame:
    """Calibration at each frame: exact, blended between neighbours, or the end one.

    ``scale`` and ``kf_idx`` are set only where a stored keyframe is used as it is.
    """
    have = [c for c in _GEOMETRY if c in keyframes.columns]
    mark = F.struct(F.col("frame_idx").alias("f"), *have)
    marks = keyframes.select("video_id", F.col("frame_idx").alias(at), mark.alias("_payload"))
    seen = asof_both(frames, marks, F.col("_payload"), at=at)
    lo, hi = F.col("_lo"), F.col("_hi")
    whole = F.when(lo.isNull(), hi).when(hi.isNull() | (lo["f"] == F.col(at)), lo)
    t = (F.col(at) - lo["f"]) / F.greatest(hi["f"] - lo["f"], F.lit(1))
    seen = seen.withColumns({"_one": whole, "_t": t})
    one, t = F.col("_one"), F.col("_t")
    out = {"kf_idx": one["f"]}
    for c in have:
        if c == "scale":
            out[c] = one[c]
        elif c == "axis":
            blended = F.when(
                lo["axis"].isNotNull() & hi["axis"].isNotNull(), G.axis_lerp(lo["axis"], hi["axis"], t)
            ).otherwise(lo["axis"])
            out[c] = F.when(one.isNotNull(), one[c]).when(lo.isNotNull(), blended)
        else:
            out[c] = F.when(one.isNotNull(), one[c]).when(lo.isNotNull(), G.polygon_lerp(lo[c], hi[c], t))
    return seen.withColumns(out).drop("_lo", "_hi", "_one", "_t")


def scale_at(frames: DataFrame, keyframes: DataFrame, at: str = "frame_idx") -> DataFrame:
    """The stored scale at exact, end or single keyframes; null in between."""
    return bracket_interpolate(
        frames, keyframes.select("video_id", "frame_idx", "scale"), at
    )


def phase_at(frames: DataFrame, phases: DataFrame, out: str = "phase") -> DataFrame:
    """First phase, in phase order, whose interval holds the frame.

    The seven intervals of a video become one row, so frames meet them in an
    equi-join and are not multiplied.
    """
    bounds = phases.filter(
        F.col("start_frame").isNotNull() & F.col("end_frame").isNotNull() & F.col("phase").isin(*PHASES)
    ).groupBy("video_id").agg(
        *[
            F.max(F.when(F.col("phase") == p, F.struct("start_frame", "end_frame"))).alias(f"_{p}")
            for p in PHASES
        ]
    )
    joined = frames.join(bounds, "video_id", "left")
    pick = F.coalesce(
        *[
            F.when(F.col("frame_idx").between(F.col(f"_{p}.start_frame"), F.col(f"_{p}.end_frame")), F.lit(p))
            for p in PHASES
        ]
    )
    return joined.withColumn(out, pick).drop(*[f"_{p}" for p in PHASES])


# ------------------------------------------------------------ masks

def _shares(rows: DataFrame, spans: DataFrame, mask_idx: str, boxes: dict[str, tuple], layers, width, height) -> DataFrame:
    """Add ``{layer}_{name}``: share of each integer pixel box (x0, y0, x1, y1) that a mask layer covers, 0 if there is none.

    A cell counts with the pixels it shares with the box, which is what a mask enlarged to the full image would
    give; a run of cells has the sum of them.  The runs of a mask are one row of at most a few hundred, so a mask
    that many frames use meets each of them once and nothing is counted together afterwards.
    """
    def first_pixel(cell: Column, size: Column, n: int) -> Column:
        return F.ceil(cell * size / F.lit(n))

    masks = spans.filter(F.col("layer").isin(*layers)).groupBy("video_id", F.col("frame_idx").alias("_mask")).agg(
        *[F.collect_list(F.when(F.col("layer") == n, F.struct("gy", "gx0", "gx1"))).alias(f"_{n}") for n in layers]
    )
    joined = bind(rows, {"_mask": F.col(mask_idx), **{f"_{name}": F.array(*[c.cast("long") for c in box]) for name, box in boxes.items()}})
    joined = joined.join(masks, ["video_id", "_mask"], "left")

    def covered(layer: str, name: str) -> Column:
        x0, y0, x1, y1 = (F.get(f"_{name}", F.lit(i)) for i in range(4))

        def pixels(s: Column) -> Column:
            across = F.least(first_pixel(s.gx1, width, GRID_W), x1) - F.greatest(first_pixel(s.gx0, width, GRID_W), x0)
            down = F.least(first_pixel(s.gy + 1, height, GRID_H), y1) - F.greatest(first_pixel(s.gy, height, GRID_H), y0)
            return F.greatest(F.lit(0), across) * F.greatest(F.lit(0), down)

        share = F.aggregate(f"_{layer}", F.lit(0).cast("long"), lambda n, s: n + pixels(s)) / ((x1 - x0) * (y1 - y0))
        return F.when((x1 > x0) & (y1 > y0), F.coalesce(share, F.lit(0.0))).otherwise(0.0)

    return joined.select(*rows.columns, *[covered(n, name).alias(f"{n}_{name}") for name in boxes for n in layers])


def _lower_half(box: str, w: Column, h: Column) -> tuple:
    b = F.col(box)
    top = b[1] + (b[3] - b[1]) * 0.5
    corners = (F.greatest(F.lit(0), b[0].cast("int")), F.greatest(F.lit(0), top.cast("int")), F.least(w, b[2].cast("int")), F.least(h, b[3].cast("int")))
    return tuple(F.when(G.has_box(b), c) for c in corners)


def _patch(x: str, y: str, radius: int, w: Column, h: Column) -> tuple:
    px, py = F.rint(F.col(x)).cast("int"), F.rint(F.col(y)).cast("int")
    return F.greatest(F.lit(0), px - radius), F.greatest(F.lit(0), py - radius), F.least(w, px + radius + 1), F.least(h, py + radius + 1)


def _size(rows: DataFrame, width, height) -> tuple[Column, Column]:
    """Size of the video's frames: given, or by row where the rows carry it."""
    return tuple(F.coalesce(F.col(c), F.lit(d)) if c in rows.columns else F.lit(d) for c, d in (("width", width), ("height", height)))


def mask_overlap(
    boxes: DataFrame, spans: DataFrame, box: str = "person_bbox", mask_idx: str = "frame_idx",
    layers: Sequence[str] = ("track", "sand"), suffix: str = "ov", width=1280, height=720,
) -> DataFrame:
    """Share of the lower half of each box covered by each mask layer (0 if none)."""
    w, h = _size(boxes, width, height)
    return _shares(boxes, spans, mask_idx, {suffix: _lower_half(box, w, h)}, list(layers), w, h)


def patch_fraction(
    points: DataFrame, spans: DataFrame, x: str = "foot_x", y: str = "foot_y", mask_idx: str = "frame_idx",
    radius: int = PATCH_RADIUS, layers: Sequence[str] = ("track", "sand"), width=1280, height=720,
) -> DataFrame:
    """Share of a square patch around a point covered by each mask layer."""
    w, h = _size(points, width, height)
    return _shares(points, spans, mask_idx, {"frac": _patch(x, y, radius, w, h)}, list(layers), w, h)


def surface(track_frac: Column, sand_frac: Column, track_ov: Column, sand_ov: Column) -> Column:
    """Ground under the foot: the patch decides first, then the lower half box."""
    return (
        F.when((sand_frac >= 0.12) & (sand_frac >= track_frac), "sand")
        .when(track_frac >= 0.12, "track")
        .when((sand_ov > 0.08) & (sand_ov >= track_ov), "sand")
        .when(track_ov > 0.05, "track")
        .otherwise("unknown")
    )


def classify_surface(points: DataFrame, spans: DataFrame, mask_idx="frame_idx", width=1280, height=720) -> DataFrame:
    """Add ``surface`` and the shares it comes from to rows with foot_x, foot_y and person_bbox."""
    w, h = _size(points, width, height)
    shared = _shares(
        points, spans, mask_idx, {"frac": _patch("foot_x", "foot_y", PATCH_RADIUS, w, h), "ov": _lower_half("person_bbox", w, h)}, ["track", "sand"], w, h
    )
    pick = surface(*[F.col(c) for c in ("track_frac", "sand_frac", "track_ov", "sand_ov")])
    return shared.withColumn("surface", F.when(F.col("foot_x").isNotNull(), pick))


# ------------------------------------------------------------ exclusion and choice

def exclude_self(history: DataFrame, current: DataFrame, key: str = "video_id") -> DataFrame:
    """History rows that do not belong to a current video."""
    return history.join(current.select(key).distinct(), key, "left_anti")


def others_or_all(pool: DataFrame, exclude: Column, group: Sequence[str]) -> DataFrame:
    """Per group the rows where ``exclude`` is false; all rows when none is left.

    Two counts per group decide, so the pool itself is never gathered.
    """
    left = pool.groupBy(*group).agg(F.count(F.when(~exclude, 1)).alias("_others"))
    return (
        pool.withColumn("_ex", exclude)
        .join(left, list(group))
        .filter((F.col("_others") == 0) | ~F.col("_ex"))
        .drop("_others", "_ex")
    )


def new_markers_only(auto: DataFrame, existing: DataFrame) -> DataFrame:
    """Existing markers plus the automatic ones on frames not marked yet."""
    fresh = auto.join(existing.select("video_id", "frame_idx"), ["video_id", "frame_idx"], "left_anti")
    return existing.unionByName(fresh, allowMissingColumns=True)


def resolve_corridor(videos: DataFrame, venues: DataFrame, shared_m: float | None = None) -> DataFrame:
    """Corridor length: override, older override, venue, shared, profile, default.

    ``videos``: video_id, venue_id, hops_corridor_m, total_length_m (overrides);
    ``venues``: venue_id, scale_m, profile_m.  Only positive numbers count, and
    the older override is read only when the newer one is absent.
    """
    def positive(c):
        return F.when(c > 0, c)

    own = F.when(F.col("hops_corridor_m").isNotNull(), F.col("hops_corridor_m")).otherwise(
        F.col("total_length_m")
    )
    joined = videos.join(
        venues.select("venue_id", F.col("scale_m").alias("_scale"), F.col("profile_m").alias("_profile")),
        "venue_id", "left",
    )
    return joined.withColumn(
        "corridor_m",
        F.coalesce(
            positive(own), positive(F.col("_scale")), positive(F.lit(shared_m).cast("double")),
            positive(F.col("_profile")), F.lit(DEFAULT_CORRIDOR_M),
        ),
    ).drop("_scale", "_profile")


def click_select(clicks: DataFrame, detections: DataFrame) -> DataFrame:
    """Detection whose centre is nearest to the click on its frame."""
    d = detections.select(
        "video_id", "frame_idx", "det_id", "track_id", "x1", "y1", "x2", "y2",
    ).join(clicks.select("video_id", "frame_idx", F.col("x").alias("_x"), F.col("y").alias("_y")),
           ["video_id", "frame_idx"])
    dist = F.hypot((F.col("x1") + F.col("x2")) / 2 - F.col("_x"), (F.col("y1") + F.col("y2")) / 2 - F.col("_y"))
    best = d.groupBy("video_id", "frame_idx").agg(
        F.min(F.struct(dist.alias("dist"), "det_id", "track_id", "x1", "y1", "x2", "y2")).alias("b")
    )
    return best.select("video_id", "frame_idx", "b.*")


def prefer_refined(videos: DataFrame, passes: DataFrame) -> DataFrame:
    """The refined pass of a video when there is one, else the first pass."""
    refined = passes.filter(F.col("pass") == "refined").select("video_id").distinct()
    marked = videos.join(refined.withColumn("_r", F.lit(True)), "video_id", "left")
    return marked.withColumn("pass", F.when(F.col("_r"), F.lit("refined")).otherwise("first")).drop("_r")


def nearest_seed_wins(chains: DataFrame) -> DataFrame:
    """Of several propagated calibrations of a frame, the one from the closest seed.

    ``chains``: video_id, frame_idx, seed_idx, seed_order and the geometry.
    """
    rest = [c for c in chains.columns if c not in ("video_id", "frame_idx", "seed_order")]
    rank = F.struct(F.abs(F.col("frame_idx") - F.col("seed_idx")), "seed_order")
    best = chains.groupBy("video_id", "frame_idx").agg(F.min_by(F.struct(*rest), rank).alias("b"))
    return best.select("video_id", "frame_idx", "b.*")
