"""Distances, speeds, scale and pose quality of the contacts of a jump.

A video has at most five contacts, so they are folded into one array per video
right after the frame lookup; segments, slots, scale and totals are then plain
column expressions on that row and need no further shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import pose as P
from ..functions import scores as S
from ..functions import vectors as V
from ..schemas import DEFAULT_CORRIDOR_M, DEFAULT_FPS, DEFAULT_HEIGHT, DEFAULT_WIDTH
from .joins import bracket_interpolate
from .prototypes import phase_entry, with_sheet

SLOTS = 5
FLIGHT_SAMPLES = 12


# ------------------------------------------------------------ contacts

def first_axis(keyframes: DataFrame, width=DEFAULT_WIDTH, height=DEFAULT_HEIGHT) -> DataFrame:
    """Fallback axis per video: the longest edge of the first usable polygon."""
    poly = F.when(F.size("track_polygon") >= 2, F.col("track_polygon"))
    if "corridor_polygon" in keyframes.columns:
        poly = F.coalesce(poly, F.when(F.size("corridor_polygon") >= 2, F.col("corridor_polygon")))
    picked = keyframes.withColumn("_p", poly).filter(F.col("_p").isNotNull())
    first = picked.groupBy("video_id").agg(F.min_by("_p", "frame_idx").alias("_p"))
    return first.select(
        "video_id", G.longest_edge_axis(F.col("_p"), F.lit(width), F.lit(height)).alias("fallback_axis")
    )


def enrich_contacts(
    contacts: DataFrame, frames: DataFrame, keyframes: DataFrame | None = None,
    width=DEFAULT_WIDTH, height=DEFAULT_HEIGHT, poses: bool = False,
) -> DataFrame:
    """Contacts with foot, box centre, pose, axis and position along the track.

    Position: stored on the contact, stored on the frame, box on the axis, foot
    on the axis.  ``frames`` carries keypoints, person_bbox, position_s.  With ``poses`` the pose is
    worked out here, for the few frames with a contact, unless the frames have it.
    """
    src = frames.select(
        "video_id", "frame_idx", F.col("timestamp_s").alias("_ts"), F.col("position_s").alias("_pos"),
        "person_bbox", "keypoints", *(["pose"] if "pose" in frames.columns else []),
    )
    joined = contacts.join(src, ["video_id", "frame_idx"], "left")
    if poses and "pose" not in frames.columns:
        joined = P.pose_features(joined).withColumn("pose", F.when(F.col("keypoints").isNotNull(), F.col("pose")))
    if keyframes is not None:
        marks = keyframes.select("video_id", "frame_idx", "axis")
        joined = bracket_interpolate(joined, marks).drop("kf_idx")
        joined = joined.join(first_axis(keyframes, width, height), "video_id", "left").withColumn(
            "axis", F.coalesce("axis", "fallback_axis")
        ).drop("fallback_axis")
    else:
        joined = joined.withColumn("axis", F.lit(None).cast("struct<ox:double,oy:double,dx:double,dy:double>"))
    joined = P.bind(joined, {"foot": P.foot_point(), "center": G.box_center(F.col("person_bbox"))})
    w, h = F.lit(width), F.lit(height)
    return joined.withColumns(
        {
            "timestamp_s": F.coalesce("timestamp_s", "_ts", F.lit(0.0)),
            "phase": F.coalesce("phase", F.when(F.col("type") == "landing", "landing").otherwise("hop")),
            "position_s": F.coalesce(
                "position_s", "_pos",
                G.project_box(F.col("person_bbox"), F.col("axis"), w, h),
                G.project_point(F.col("foot"), F.col("axis"), w, h),
            ),
        }
    ).drop("_ts", "_pos", "keypoints", "person_bbox")


def pair_length(a: Column, b: Column, axis: Column, width=DEFAULT_WIDTH, height=DEFAULT_HEIGHT) -> Column:
    """STRUCT<px, method>: the first way to measure that has all it needs."""
    w, h = F.lit(width), F.lit(height)

    def way(px, method):
        return F.when(px.isNotNull(), F.struct(px.alias("px"), F.lit(method).alias("method")))

    dx, dy = F.abs(b["foot"]["x"] - a["foot"]["x"]), F.abs(b["foot"]["y"] - a["foot"]["y"])
    return F.coalesce(
        way(F.abs(b["position_s"] - a["position_s"]), "position_s"),
        way(
            F.abs(G.project_point(b["foot"], axis, w, h) - G.project_point(a["foot"], axis, w, h)), "foot_axis"
        ),
        way(F.when(dx >= dy * 0.5, dx).otherwise(F.hypot(dx, dy)), "foot_dx"),
        way(
            F.hypot(b["center"]["x"] - a["center"]["x"], b["center"]["y"] - a["center"]["y"]), "bbox_center"
        ),
        F.struct(F.lit(None).cast("double").alias("px"), F.lit("none").alias("method")),
    )


def contact_arrays(enriched: DataFrame) -> DataFrame:
    """One row per video: ``contacts`` in time order."""
    fields = ["timestamp_s", "frame_idx", "index", "phase", "type", "position_s", "axis", "foot", "center"]
    fields += [c for c in ("pose",) if c in enriched.columns]
    return enriched.groupBy("video_id").agg(
        F.array_sort(
            F.collect_list(F.struct(*fields)),
            lambda a, b: F.when(
                (a.timestamp_s < b.timestamp_s)
                | ((a.timestamp_s == b.timestamp_s) & (a.frame_idx < b.frame_idx)),
                -1,
            ).otherwise(1),
        ).alias("contacts")
    )


def segments(videos: DataFrame) -> DataFrame:
    """Add ``segments``, ``hop_px`` (five slots), ``hop_methods``, ``intervals_s``.

    Segment ids are hop_1 .. hop_4; with two to four contacts the last one is
    ``final``.  Slot five repeats the last pair.
    """
    c = F.col("contacts")
    n = F.size(c)

    def pair(i):  # 1-based number of the pair
        a, b = F.get(c, i - 1), F.get(c, i)
        size = pair_length(a, b, F.coalesce(b["axis"], a["axis"]))
        dt = b["timestamp_s"] - a["timestamp_s"]
        name = F.when((i >= 5) | ((i == n - 1) & (i < 4)), F.lit("final")).otherwise(
            F.concat(F.lit("hop_"), i.cast("string"))
        )
        return F.struct(
            name.alias("id"), i.alias("pair"), a["frame_idx"].alias("from_frame"), b["frame_idx"].alias("to_frame"),
            F.round(dt, 4).alias("interval_s"), F.round(F.greatest(F.lit(0.0), dt), 4).alias("dt_s"),
            F.round(size["px"], 2).alias("length_px"), size["method"].alias("length_method"),
        )

    made = P.bind(
        videos,
        {"segments": F.when(n >= 2, F.transform(F.sequence(F.lit(1), n - 1), pair)).otherwise(F.array())},
    )
    s = F.col("segments")
    last = F.when(F.size(s) > 0, F.try_element_at(s, F.lit(-1)))

    def slots(field):
        return F.array(*[F.get(s, F.lit(i))[field] for i in range(4)], last[field])

    return P.bind(
        made,
        {
            "intervals_s": F.transform(s, lambda x: x["interval_s"]),
            "hop_px": slots("length_px"),
            "hop_methods": slots("length_method"),
        },
    )


def slot_five_rule(videos: DataFrame) -> DataFrame:
    """With five contacts slot five is slot four."""
    full = (F.size("contacts") >= 5) & F.col("hop_px")[3].isNotNull()
    px = F.col("hop_px")
    return videos.withColumn(
        "hop_px",
        F.when(full, F.array(px[0], px[1], px[2], px[3], px[3])).otherwise(px),
    )


def add_approach(videos: DataFrame, phases: DataFrame, frames: DataFrame,
                 width=DEFAULT_WIDTH, height=DEFAULT_HEIGHT) -> DataFrame:
    """Put the approach in front: from its first frame to the first contact."""
    start = phases.filter((F.col("phase") == "approach") & F.col("start_frame").isNotNull()).select(
        "video_id", F.col("start_frame").alias("frame_idx")
    )
    at = start.join(
        frames.select("video_id", "frame_idx", "timestamp_s", "position_s", "person_bbox", "keypoints"),
        ["video_id", "frame_idx"],
    )
    at = at.select(
        "video_id", "frame_idx", "timestamp_s", "position_s", "person_bbox", P.foot_point().alias("foot"),
        G.box_center(F.col("person_bbox")).alias("center"),
    ).select("video_id", F.struct("frame_idx", "timestamp_s", "position_s", "person_bbox", "foot", "center").alias("_a"))
    joined = videos.join(at, "video_id", "left")
    first, a = F.get("contacts", F.lit(0)), F.col("_a")
    placed = F.struct(
        F.coalesce(
            a["position_s"], G.project_box(a["person_bbox"], first["axis"], F.lit(width), F.lit(height))
        ).alias("position_s"),
        a["foot"].alias("foot"), a["center"].alias("center"),
    )
    size = pair_length(placed, first, first["axis"], width, height)
    dt = first["timestamp_s"] - a["timestamp_s"]
    lead = F.struct(
        F.lit("approach").alias("id"), F.lit(0).alias("pair"), a["frame_idx"].alias("from_frame"),
        first["frame_idx"].alias("to_frame"), F.round(dt, 4).alias("interval_s"),
        F.round(F.greatest(F.lit(0.0), dt), 4).alias("dt_s"), F.round(size["px"], 2).alias("length_px"),
        size["method"].alias("length_method"),
    )
    return joined.withColumn(
        "segments",
        F.when(a.isNotNull() & first.isNotNull(), F.concat(F.array(lead), "segments")).otherwise(F.col("segments")),
    ).drop("_a")


# ------------------------------------------------------------ scale

def scale_px(scale: Column, width=DEFAULT_WIDTH, height=DEFAULT_HEIGHT, in_units: Column | None = None) -> Column:
    """Pixel distance between the two points of a STRUCT<known_distance_m, ax, ay, bx, by>."""
    dx, dy = scale["bx"] - scale["ax"], scale["by"] - scale["ay"]
    full = F.hypot(dx * width, dy * height)
    return full if in_units is None else F.when(in_units, full).otherwise(F.hypot(dx, dy))


def resolve_scale(videos: DataFrame, width=DEFAULT_WIDTH, height=DEFAULT_HEIGHT) -> DataFrame:
    """Add ``m_per_px`` and ``scale_source`` from the first tier that applies.

    Columns read: hop_px, corridor_m, ov_hop_m (ARRAY), ov_m_per_px, ov_scale
    and kf_scale (STRUCT<known_distance_m, ax, ay, bx, by>).
    """
    total = V.total(F.filter(F.slice("hop_px", 1, 4), lambda p: p.isNotNull()))
    pairs = F.zip_with(
        F.col("ov_hop_m"), F.col("hop_px"),
        lambda m, p: F.when((p > 1e-3) & (m > 0), m / p),
    )
    ratios = V.average(pairs)
    ov, kf = F.col("ov_scale"), F.col("kf_scale")
    unit = F.greatest(*[F.abs(ov[k]) for k in ("ax", "ay", "bx", "by")]) <= 1.5
    ov_px, kf_px = scale_px(ov, width, height, unit), scale_px(kf, width, height)
    all_ov = ov["ax"].isNotNull() & ov["ay"].isNotNull() & ov["bx"].isNotNull() & ov["by"].isNotNull()
    tiers = [
        (F.when((F.col("corridor_m") > 0) & (total > 1e-3), F.col("corridor_m") / total), "hops_corridor"),
        (ratios, "override_hop_lengths"),
        (F.col("ov_m_per_px"), "override_m_per_px"),
        (F.when(all_ov & (ov_px > 1e-3), ov["known_distance_m"] / ov_px), "override_known_distance"),
        (F.when(kf_px > 1e-3, kf["known_distance_m"] / kf_px), "calibration_scale"),
    ]
    best = F.coalesce(
        *[F.when(v.isNotNull(), F.struct(v.alias("v"), F.lit(n).alias("n"))) for v, n in tiers],
        F.struct(F.lit(None).cast("double").alias("v"), F.lit("none").alias("n")),
    )
    bound = P.bind(videos, {"_scale": best})
    return bound.withColumns({"m_per_px": F.col("_scale.v"), "scale_source": F.col("_scale.n")}).drop("_scale")


def measured(videos: DataFrame) -> DataFrame:
    """Metres, speeds and totals once ``m_per_px`` is known."""
    m = F.col("m_per_px")

    def seg(s):
        length_m = F.round(s["length_px"] * m, 4)
        return F.struct(
            *[s[k].alias(k) for k in ("id", "pair", "from_frame", "to_frame", "dt_s", "length_px", "length_method")],
            length_m.alias("length_m"),
            F.round(G.safe_div(s["length_px"], s["dt_s"]), 2).alias("speed_px_s"),
            F.round(G.safe_div(length_m, s["dt_s"]), 3).alias("speed_m_s"),
        )

    slots = F.transform(
        "hop_px",
        lambda p, i: F.coalesce(F.round(F.get("ov_hop_m", i), 4), F.round(p * m, 4)),
    )
    out = P.bind(videos, {"segments_m": F.transform("segments", seg), "hop_m": slots})
    out = out.drop("segments").withColumnRenamed("segments_m", "segments")
    return hop_totals(out)


def hop_totals(videos: DataFrame) -> DataFrame:
    """Sum over the four hops in pixels and metres."""
    px4 = F.filter(F.slice("hop_px", 1, 4), lambda p: p.isNotNull())
    m4 = F.slice("hop_m", 1, 4)
    total_px = F.when(F.size(px4) > 0, F.round(V.total(px4), 2))
    known = F.size(F.filter(m4, lambda x: x.isNotNull())) == 4
    out = videos.withColumn("total_hops_px", total_px)
    return out.withColumn(
        "total_hops_m",
        F.when(F.col("total_hops_px").isNotNull() & (F.size("contacts") >= 5), F.round("corridor_m", 4))
        .when(F.col("m_per_px").isNotNull() & F.col("total_hops_px").isNotNull(),
              F.round(F.col("total_hops_px") * F.col("m_per_px"), 4))
        .when(known, F.round(V.total(m4), 4)),
    )


def phase_durations(phases: DataFrame, frames: DataFrame, fps: str | None = None) -> DataFrame:
    """Seconds between the two ends of a phase; frame distance over fps as a fallback."""
    at = frames.select("video_id", F.col("frame_idx").alias("_f"), F.coalesce("timestamp_s", F.lit(0.0)).alias("_t"))
    rate = F.lit(DEFAULT_FPS) if fps is None else F.coalesce(F.col(fps), F.lit(DEFAULT_FPS))
    start = at.withColumnsRenamed({"_f": "start_frame", "_t": "_t0"})
    end = at.withColumnsRenamed({"_f": "end_frame", "_t": "_t1"})
    joined = phases.join(start, ["video_id", "start_frame"], "left").join(end, ["video_id", "end_frame"], "left")
    return joined.select(
        "video_id", "phase",
        F.round(
            F.coalesce(F.col("_t1") - F.col("_t0"), (F.col("end_frame") - F.col("start_frame")) / rate), 4
        ).alias("duration_s"),
    )


def compute_metrics(
    contacts: DataFrame, frames: DataFrame, videos: DataFrame, keyframes: DataFrame | None = None,
    phases: DataFrame | None = None,
) -> DataFrame:
    """One metrics row per video with contacts.

    ``videos`` carries corridor_m and the overrides read by :func:`resolve_scale`.
    """
    rows = contact_arrays(enrich_contacts(contacts, frames, keyframes, poses=True))
    rows = slot_five_rule(segments(rows))
    if phases is not None:
        rows = add_approach(rows, phases, frames)
    joined = rows.join(videos, "video_id", "left")
    joined = joined.withColumn("corridor_m", F.coalesce("corridor_m", F.lit(DEFAULT_CORRIDOR_M)))
    if keyframes is not None and "scale" in keyframes.columns and "kf_scale" not in joined.columns:
        probe = joined.select("video_id", F.get("contacts", F.lit(0))["frame_idx"].alias("frame_idx"))
        found = bracket_interpolate(probe, keyframes.select("video_id", "frame_idx", "scale"))
        joined = joined.join(found.select("video_id", F.col("scale").alias("kf_scale")), "video_id", "left")
    out = measured(resolve_scale(joined))
    trusted = ("hops_corridor", "override_hop_lengths", "override_m_per_px", "override_known_distance")
    return out.withColumns(
        {
            "contact_count": F.size("contacts"),
            "has_axis": F.exists("contacts", lambda c: c["axis"].isNotNull()),
            "meters_estimated": F.col("m_per_px").isNull() | ~F.col("scale_source").isin(*trusted),
        }
    )


def session_snapshot(metrics: DataFrame) -> DataFrame:
    """History rows for the sessions table: videos with an athlete and contacts."""
    hops = F.filter("segments", lambda s: s["id"] != "approach")
    return metrics.filter(F.col("athlete_id").isNotNull() & (F.size("contacts") > 0)).select(
        "athlete_id", "video_id",
        F.transform("contacts", lambda c: F.round(c["timestamp_s"], 4)).alias("timestamps_s"),
        "intervals_s", F.col("hop_px").alias("lengths_px"), F.col("hop_m").alias("lengths_m"),
        "total_hops_px", "total_hops_m",
        F.transform(hops, lambda s: s["speed_px_s"]).alias("speeds_px_s"),
        F.transform(hops, lambda s: s["speed_m_s"]).alias("speeds_m_s"),
        F.transform(
            "contacts",
            lambda c: F.when(c["pose"]["valid"], F.transform(c["pose"]["vector"], lambda v: F.round(v, 4))),
        ).alias("pose_vectors"),
        F.transform("contacts", lambda c: c["phase"]).alias("contact_phases"),
    )


# ------------------------------------------------------------ pose quality

def pose_score(vec: Column, phase: Column | str | None, tag: str) -> Column:
    """Mean of the tag score (if positive) and the similarity to the centroid."""
    t = F.col("_tags")[tag]
    tag_score = V.prototype_similarity(vec, t["centroid"], t["weights"])
    centroid = phase_entry(tag)["centroid"]
    if phase is not None:
        centroid = F.coalesce(phase_entry(phase)["centroid"], centroid)
    parts = F.array(F.when(tag_score > 0, tag_score), V.similarity01(vec, centroid))
    return F.when(vec.isNotNull(), F.round(V.average(parts), 3))


def flight_samples(first: Column, last: Column) -> Column:
    """At most 12 stepped frames between two contacts, plus middle and near-landing."""
    span = last - first
    step = F.greatest(F.lit(1), F.floor(span / FLIGHT_SAMPLES)).cast("int")
    stepped = F.when(
        first + step < last, F.slice(F.sequence(first + step, last - 1, step), 1, FLIGHT_SAMPLES)
    ).otherwise(F.array().cast("array<int>"))
    middle = (first + F.floor(span / 2)).cast("int")
    near = F.greatest(first + 1, last - F.greatest(F.lit(1), F.floor(step / 2))).cast("int")
    extra = F.filter(F.array(middle, near), lambda f: (f > first) & (f < last))
    return F.when(last > first, F.array_sort(F.array_union(stepped, extra))).otherwise(
        F.array().cast("array<int>")
    )


def pose_quality(videos: DataFrame, posed_frames: DataFrame, prototypes: DataFrame) -> DataFrame:
    """Scores of up to four hop contacts, of the final flight, and their mean.

    ``videos``: rows of :func:`contact_arrays` with poses; ``posed_frames``:
    video_id, frame_idx, pose.
    """
    c = F.col("contacts")
    n = F.size(c)
    hop_like = F.filter(c, lambda k: k["phase"].startswith("hop") | F.coalesce(k["type"] == "hop", F.lit(False)))
    hops = F.slice(F.when((F.size(hop_like) < 4) & (n >= 4), F.slice(c, 1, 4)).otherwise(hop_like), 1, 4)
    landing = F.coalesce(
        F.get(F.filter(c, lambda k: (k["phase"] == "landing") | F.coalesce(k["type"] == "landing", F.lit(False))), F.lit(0)),
        F.when(n >= 5, F.get(c, F.lit(4))),
    )
    rows = P.bind(videos, {"_hops": hops, "_landing": landing})
    rows = with_sheet(rows, prototypes)

    def vector(k):
        return F.when(k["pose"]["valid"], F.transform(k["pose"]["vector"], lambda v: F.round(v, 4)))

    def hop(k, i):
        named = k["phase"].startswith("hop") & (k["phase"] != "hop")
        phase = F.when(named, k["phase"]).otherwise(F.concat(F.lit("hop_"), (i + 1).cast("string")))
        score = pose_score(vector(k), phase, "hop_contact")
        return F.struct(
            phase.alias("phase"), score.alias("score"), S.label_pose(score).alias("label"), k["frame_idx"].alias("frame_idx")
        )

    takeoff = F.coalesce(F.get("_hops", F.lit(3)), F.when(n >= 4, F.get(c, F.lit(3))))
    scored = rows.select(
        "video_id",
        F.transform("_hops", hop).alias("hops"),
        takeoff["frame_idx"].alias("from_frame"),
        F.when(takeoff.isNotNull(), F.col("_landing.frame_idx")).alias("to_frame"),
    ).withColumn("from_frame", F.when(F.col("to_frame").isNotNull(), F.col("from_frame")))
    wanted = scored.select(
        "video_id", F.explode(flight_samples(F.col("from_frame"), F.col("to_frame"))).alias("frame_idx")
    )
    seen = wanted.join(posed_frames.select("video_id", "frame_idx", "pose"), ["video_id", "frame_idx"]).filter("pose.valid")
    seen = with_sheet(seen, prototypes)
    base = pose_score(P.pose_vector(), None, "hop_flight")
    bio = F.col("pose.flight_score")
    sample = F.round(F.coalesce(0.7 * base + 0.3 * bio, bio), 3)
    flight = seen.select("video_id", "frame_idx", sample.alias("score")).groupBy("video_id").agg(
        F.avg("score").alias("_flight"), F.array_sort(F.collect_list(F.struct("frame_idx", "score"))).alias("samples")
    )
    out = scored.join(flight, "video_id", "left")
    hop_scores = F.transform("hops", lambda h: h["score"])
    flight_score = F.round("_flight", 3)
    return out.select(
        "video_id", "hops", "from_frame", "to_frame", "samples",
        flight_score.alias("flight_score"), S.label_pose(F.col("_flight")).alias("flight_label"),
        F.round(V.average(F.concat(hop_scores, F.array(flight_score))), 3).alias("overall"),
    )
