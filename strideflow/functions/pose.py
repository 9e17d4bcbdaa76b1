"""Keypoint lookups and everything derived from one frame's keypoints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import FEATURES, KEYPOINTS, USABLE_ANGLES
from .geometry import box_foot, clamp, rect_area

# Confidence floors and the angle table.
CONF_FEATURE = 0.35
CONF_FOOT = 0.40
CONF_ANGLE = 0.45
ANGLE_LIMITS = (("FRONTAL", 0.80), ("SEMI_FRONT", 0.50), ("LATERAL", 0.20), ("SEMI_BACK", 0.05))
ANGLE_WEIGHTS = (("LATERAL", 1.0), ("SEMI_BACK", 0.7), ("SEMI_FRONT", 0.3), ("FRONTAL", 0.1))
QUALITY_USABLE = 0.55
QUALITY_FLOOR = 0.15


def keypoint(name: str, conf_min: float | None = None, kps: str = "keypoints") -> Column:
    """The named keypoint, or null when it is absent or below ``conf_min``.

    Writers store the names in a fixed order, so the expected slot is tried
    first (a plain array access that stays in generated code); other layouts
    fall back to a search, where the last entry of a name wins.
    """
    slot = f"get({kps}, {KEYPOINTS.index(name)})"
    point = (
        f"CASE WHEN {slot}.name = '{name}' THEN {slot} "
        f"ELSE try_element_at(filter({kps}, k -> k.name = '{name}'), -1) END"
    )
    if conf_min is None:
        return F.expr(point)
    return F.expr(f"CASE WHEN coalesce(({point}).conf, 0D) >= {conf_min}D THEN {point} END")


def bind(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are computed once per row, whatever refers to them later.

    A one-row ``inline`` is a border the optimizer does not move predicates or
    projections across, so a filter on a derived value does not copy the whole
    expression tree behind it into the plan again and again.
    """
    packed = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.inline(F.array(packed)))


def _seen(name: str, conf: float, kps) -> Column:
    return keypoint(name, conf, kps)


# ------------------------------------------------------------ camera angle

def camera_angle(df: DataFrame, kps: str = "keypoints") -> DataFrame:
    """Add camera_angle, shoulder_ratio, angle_confidence and the two lengths."""
    joints = ("l_shoulder", "r_shoulder", "l_hip", "r_hip")
    src = bind(df, {f"_{n}": _seen(n, CONF_ANGLE, kps) for n in joints})
    ls, rs, lh, rh = (F.col(f"_{n}") for n in ("l_shoulder", "r_shoulder", "l_hip", "r_hip"))
    shoulders = ls.isNotNull() & rs.isNotNull()
    hips = lh.isNotNull() & rh.isNotNull()
    hip_y = F.when(hips, (lh.y + rh.y) / 2).otherwise(F.coalesce(lh.y, rh.y))
    measured = src.select(
        "*",
        F.when(shoulders, F.hypot(ls.x - rs.x, ls.y - rs.y)).otherwise(0.0).alias("_width"),
        F.when(shoulders, F.coalesce(F.abs((ls.y + rs.y) / 2 - hip_y), F.lit(0.0)))
        .otherwise(0.0)
        .alias("_torso"),
        F.when(hips, (ls.conf + rs.conf + lh.conf + rh.conf) / 4)
        .otherwise((ls.conf + rs.conf) / 2)
        .alias("_conf"),
    )
    known = F.col("_torso") >= 10
    ratio = F.col("_width") / F.col("_torso")
    angle = F.when(~known, F.lit("UNKNOWN"))
    for label, limit in ANGLE_LIMITS:
        angle = angle.when(ratio > limit, F.lit(label))
    return measured.withColumns(
        {
            "camera_angle": angle.otherwise("UNKNOWN"),
            "shoulder_ratio": F.when(known, ratio).otherwise(0.0),
            "angle_confidence": F.when(known, F.col("_conf")).otherwise(0.0),
            "torso_height_px": F.col("_torso"),
            "shoulder_width_px": F.col("_width"),
        }
    ).drop("_l_shoulder", "_r_shoulder", "_l_hip", "_r_hip", "_width", "_torso", "_conf")


def frame_quality(df: DataFrame) -> DataFrame:
    """Add quality_score and usable_for_analysis (the flag uses the rounded score)."""
    weight = F.lit(0.0)
    for label, value in ANGLE_WEIGHTS:
        weight = F.when(F.col("camera_angle") == label, F.lit(value)).otherwise(weight)
    mask = F.when(
        F.col("has_mask"),
        0.5 + 0.5 * F.least(F.lit(1.0), F.col("mask_area_px") / 30000.0),
    ).otherwise(0.4)
    score = F.round(
        0.40 * F.col("keypoints_valid") / 11.0
        + 0.30 * weight
        + 0.20 * F.col("angle_confidence")
        + 0.10 * mask,
        3,
    )
    return df.withColumn(
        "quality_score", F.when(F.col("person_detected"), score).otherwise(0.0)
    ).withColumn(
        "usable_for_analysis",
        F.col("person_detected")
        & (F.col("quality_score") >= QUALITY_USABLE)
        & F.col("camera_angle").isin(*USABLE_ANGLES),
    )


def frame_geometry(df: DataFrame, kps: str = "keypoints", box: str = "person_bbox") -> DataFrame:
    """Add keypoints_valid, bbox_area and body_height_px."""
    ankles = F.greatest(
        _seen("l_ankle", CONF_ANGLE, kps)["y"], _seen("r_ankle", CONF_ANGLE, kps)["y"]
    )
    nose = _seen("nose", CONF_ANGLE, kps)["y"]
    return df.withColumns(
        {
            "keypoints_valid": F.coalesce(
                F.size(F.filter(F.col(kps), lambda k: k["conf"] >= CONF_ANGLE)), F.lit(0)
            ),
            "bbox_area": rect_area(F.col(box)),
            "body_height_px": F.coalesce(ankles - nose, F.lit(0.0)),
        }
    )


# ------------------------------------------------------------ feet

def foot_y(kps: str = "keypoints") -> Column:
    return F.greatest(
        _seen("l_ankle", CONF_FOOT, kps)["y"], _seen("r_ankle", CONF_FOOT, kps)["y"]
    )


def foot_point(kps: str = "keypoints", box: str = "person_bbox") -> Column:
    """Mean of the visible ankles, else the bottom-centre of the box."""
    left, right = _seen("l_ankle", CONF_FOOT, kps), _seen("r_ankle", CONF_FOOT, kps)

    def pair(a, b):
        return F.struct(((a.x + b.x) / 2).alias("x"), ((a.y + b.y) / 2).alias("y"))

    return F.coalesce(
        F.when(left.isNotNull() & right.isNotNull(), pair(left, right)),
        F.when(left.isNotNull(), pair(left, left)),
        F.when(right.isNotNull(), pair(right, right)),
        box_foot(F.col(box)),
    )


# ------------------------------------------------------------ pose features

def _angle_at(a: Column, b: Column, c: Column) -> Column:
    """Angle a-b-c in degrees; 0 when a side has no length."""
    ux, uy, vx, vy = a.x - b.x, a.y - b.y, c.x - b.x, c.y - b.y
    size = F.hypot(ux, uy) * F.hypot(vx, vy)
    cos = clamp((ux * vx + uy * vy) / size, -1.0, 1.0)
    return F.when(size < 1e-6, F.lit(0.0)).otherwise(F.degrees(F.acos(cos)))


def _sum(values) -> Column:
    return reduce(lambda a, b: a + b, values)


def pose_features(df: DataFrame, kps: str = "keypoints", out: str = "pose") -> DataFrame:
    """Add ``pose``: STRUCT<valid, quality, 14 named features, vector>.

    The named features are rounded and keep degrees; ``vector`` is unrounded
    and scales angles into 0-1.  All steps are plain column arithmetic split
    over a few projections, so each intermediate is evaluated once per row.
    """
    parts = ("l_hip", "r_hip", "l_knee", "r_knee", "l_ankle", "r_ankle", "l_shoulder", "r_shoulder")
    confident = F.filter(
        F.col(kps),
        lambda k: (k["conf"] >= CONF_FEATURE) & (F.coalesce(F.length(k["name"]), F.lit(0)) > 0),
    )
    base = list(df.columns)
    names = F.array_distinct(F.transform(confident, lambda k: k["name"]))
    step = bind(
        df,
        {f"_{n}": _seen(n, CONF_FEATURE, kps) for n in parts}
        | {"_n": F.coalesce(F.size(names), F.lit(0))},
    )
    p = {n: F.col(f"_{n}") for n in parts}
    step = step.select(
        "*",
        ((p["l_hip"].x + p["r_hip"].x) * 0.5).alias("_hx"),
        ((p["l_hip"].y + p["r_hip"].y) * 0.5).alias("_hy"),
    )
    hx, hy = F.col("_hx"), F.col("_hy")
    step = step.select(
        "*",
        F.greatest(
            *[F.hypot(p[n].x - hx, p[n].y - hy) for n in ("l_shoulder", "r_shoulder", "l_ankle", "r_ankle")]
        ).alias("_scale"),
    )
    step = step.select("*", ((F.col("_n") >= 6) & (F.col("_scale") >= 8)).alias("_ok"))
    scale = F.when(F.col("_ok"), F.col("_scale"))

    def centred(point):
        return F.struct(((point.x - hx) / scale).alias("x"), ((point.y - hy) / scale).alias("y"))

    la, ra, ls, rs = p["l_ankle"], p["r_ankle"], p["l_shoulder"], p["r_shoulder"]
    both_ankles = la.isNotNull() & ra.isNotNull()
    both_shoulders = ls.isNotNull() & rs.isNotNull()
    lean_x = F.when(both_shoulders, (ls.x + rs.x) * 0.5 - hx).otherwise(0.0)
    lean_y = F.when(both_shoulders, (ls.y + rs.y) * 0.5 - hy).otherwise(0.0)

    def knee(side):
        hip, kn, an = p[f"{side}_hip"], p[f"{side}_knee"], p[f"{side}_ankle"]
        return F.when(
            kn.isNotNull() & an.isNotNull(), _angle_at(centred(hip), centred(kn), centred(an))
        ).otherwise(150.0)

    left_h, right_h = (la.y - hy) / scale, (ra.y - hy) / scale
    step = step.select(
        "*",
        knee("l").alias("_lk"),
        knee("r").alias("_rk"),
        F.degrees(F.atan2(lean_x, F.greatest(F.abs(lean_y), F.lit(1e-3)))).alias("_lean"),
        F.when(both_ankles, F.least(F.lit(1.5), F.hypot(la.x - ra.x, la.y - ra.y) / scale))
        .otherwise(0.0)
        .alias("_sep"),
        F.when(both_ankles, F.abs(la.x - ra.x) / scale).otherwise(0.0).alias("_foot"),
        F.when(both_ankles, (left_h + right_h) / 2)
        .otherwise(F.coalesce(left_h, right_h, F.lit(0.0)))
        .alias("_height"),
    )
    lk, rk, height, sep, foot = (F.col(c) for c in ("_lk", "_rk", "_height", "_sep", "_foot"))
    bend = F.when(lk > 0, F.abs(180 - lk)).otherwise(0.0) + F.when(rk > 0, F.abs(180 - rk)).otherwise(0.0)
    used = F.greatest((lk > 0).cast("int") + (rk > 0).cast("int"), F.lit(1))
    up, down = F.greatest(F.lit(0.0), height), F.greatest(F.lit(0.0), -height)
    step = step.select(
        "*",
        (F.abs(lk - rk) / 180.0).alias("_asym"),
        (bend / used / 90.0).alias("_bend"),
        up.alias("_up"),
    )
    asym, bend, up = F.col("_asym"), F.col("_bend"), F.col("_up")
    one = F.lit(1.0)
    step = step.select(
        "*",
        F.least(one, asym * 0.45 + down * 0.35 + foot * 0.2).alias("_flight"),
        F.least(one, bend * 0.6 + F.greatest(F.lit(0.0), F.col("_lean")) / 45.0 * 0.4).alias("_arch"),
        F.least(one, foot * 0.5 + (1.0 - F.least(lk, rk) / 180.0) * 0.35 + up * 0.15).alias("_hop"),
        F.least(one, (1.0 - asym) * 0.4 + (1.0 - F.abs(sep - 0.35)) * 0.35 + up * 0.25).alias("_run"),
        F.least(one, F.greatest(F.lit(0.0), 1.0 - sep * 1.8) * (0.5 + bend * 0.5)).alias("_feet"),
    )
    step = step.select(
        "*",
        F.least(one, (1.0 - bend) * 0.4 + up * 0.35 + (1.0 - F.col("_flight")) * 0.25).alias("_land"),
    )
    raw = {
        "l_knee_angle": (lk, 2), "r_knee_angle": (rk, 2), "torso_lean": (F.col("_lean"), 2),
        "ankle_sep_norm": (sep, 3), "foot_asymmetry": (foot, 3), "leg_extension_asym": (asym, 3),
        "avg_foot_height": (height, 3), "arch_score": (F.col("_arch"), 3),
        "hop_contact_score": (F.col("_hop"), 3), "flight_score": (F.col("_flight"), 3),
        "running_score": (F.col("_run"), 3), "landing_score": (F.col("_land"), 3),
        "feet_together_score": (F.col("_feet"), 3), "body_extension": (bend, 3),
    }
    scaled = {
        "l_knee_angle": lk / 180.0, "r_knee_angle": rk / 180.0,
        "torso_lean": (F.col("_lean") + 90) / 180.0, "avg_foot_height": (height + 1) / 2.0,
    }
    ok = F.coalesce(F.col("_ok"), F.lit(False))
    pose = F.struct(
        ok.alias("valid"),
        F.when(ok, F.round(F.least(one, F.col("_n") / 9.0), 3)).otherwise(0.0).alias("quality"),
        *[F.when(ok, F.round(c, d)).otherwise(0.0).alias(n) for n, (c, d) in raw.items()],
        F.when(ok, F.array(*[scaled.get(n, raw[n][0]) for n in FEATURES])).alias("vector"),
    )
    return bind(step, {out: pose}).select(*base, out)


def pose_vector(pose: str = "pose") -> Column:
    """The 14 values rounded to 4 digits; null for an invalid pose."""
    return F.when(
        F.col(pose)["valid"], F.transform(F.col(pose)["vector"], lambda v: F.round(v, 4))
    )


# ------------------------------------------------------------ frame scores

def usable(df_flag: str = "usable_for_analysis", angle: str = "camera_angle") -> Column:
    return F.coalesce(F.col(df_flag), F.lit(False)) | F.coalesce(
        F.col(angle).isin(*USABLE_ANGLES), F.lit(False)
    )


def ground_truth_quality(pose: str = "pose") -> Column:
    """How good a frame is as a ground-truth sample; 0 without a person."""
    angle = F.col("camera_angle")

    def bonus(condition, value):
        return F.when(F.coalesce(condition, F.lit(False)), value).otherwise(0.0)

    score = (
        0.4
        + bonus(angle.isin(*USABLE_ANGLES), 0.35)
        + bonus(F.col("usable_for_analysis"), 0.15)
        + bonus(angle == "LATERAL", 0.1)
        + F.when(F.col(pose)["valid"], 0.2 * F.col(pose)["quality"]).otherwise(0.0)
    )
    return F.when(F.coalesce(F.col("person_detected"), F.lit(False)), score).otherwise(0.0)


def half_up(x: Column, digits: int = 3) -> Column:
    """Rounded half up on the stored binary value: the same arithmetic wherever it runs."""
    return F.floor(x * float(10**digits) + 0.5) / float(10**digits)


def mask_term(mask_area: Column) -> Column:
    return F.least(F.lit(1.0), mask_area / 30000.0)


def tracker_quality(n_valid: Column, conf: Column, mask_area: Column, sim: Column) -> Column:
    """Score of a tracked detection with pose (17 keypoints of the pose model)."""
    return half_up(0.45 * n_valid / 17.0 + 0.30 * conf + 0.15 * mask_term(mask_area) + 0.10 * sim)


def box_only_quality(conf: Column, mask_area: Column, sim: Column) -> Column:
    """Score when the identity is known but the pose is missing: 0.20 to 0.48."""
    return half_up(clamp(0.18 + 0.22 * conf + 0.12 * mask_term(mask_area) + 0.12 * sim, 0.20, 0.48))


def quality_with_floor(quality: Column, detected: Column, box: Column, box_only: Column) -> Column:
    return F.when(
        detected & box.isNotNull() & (quality < QUALITY_FLOOR),
        F.greatest(F.lit(QUALITY_FLOOR), box_only),
    ).otherwise(quality)


def standard_keypoints(kps: str = "keypoints") -> Column:
    """The 11 names in stored order; a missing one becomes zeros; 2 / 4 decimals."""
    slots = []
    for name in KEYPOINTS:
        k = keypoint(name, None, kps)
        slots.append(
            F.struct(
                F.lit(name).alias("name"),
                F.coalesce(F.round(k["x"], 2), F.lit(0.0)).alias("x"),
                F.coalesce(F.round(k["y"], 2), F.lit(0.0)).alias("y"),
                F.coalesce(F.round(k["conf"], 4), F.lit(0.0)).alias("conf"),
            )
        )
    return F.array(*slots)


def corrected_quality(mask_area: Column) -> Column:
    """Score of a manually corrected frame whose pose could not be found: 0.2 to 0.45."""
    return half_up(clamp(0.2 + mask_area / 60000.0, 0.2, 0.45))


def sot_quality(n_valid: Column, mask_area: Column) -> Column:
    """Score of a frame tracked forward from a correction."""
    return half_up(0.45 * n_valid / 17.0 + 0.55 * mask_term(mask_area))
