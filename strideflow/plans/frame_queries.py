"""Registered queries: frame functions (F), summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import pose as P
from ..operators import frames as FR
from ..schemas import FEATURES
from . import carriers as C
from .carriers import rnd, sql, view
from .registry import query

# ------------------------------------------------------------ SQL views

view(
    "angle_v",
    """
SELECT *, CASE WHEN torso_height_px < 10 THEN 'UNKNOWN' WHEN ratio > 0.80 THEN 'FRONTAL'
    WHEN ratio > 0.50 THEN 'SEMI_FRONT' WHEN ratio > 0.20 THEN 'LATERAL'
    WHEN ratio > 0.05 THEN 'SEMI_BACK' ELSE 'UNKNOWN' END AS camera_angle,
  CASE WHEN torso_height_px < 10 THEN 0 ELSE ratio END AS shoulder_ratio,
  CASE WHEN torso_height_px < 10 THEN 0 ELSE mean_conf END AS angle_confidence
FROM (SELECT *, shoulder_width_px / torso_height_px AS ratio FROM (
  SELECT *,
    CASE WHEN sh THEN sqrt((l_shoulder_x - r_shoulder_x)**2 + (l_shoulder_y - r_shoulder_y)**2) ELSE 0 END AS shoulder_width_px,
    CASE WHEN NOT sh THEN 0
      WHEN lh AND rh THEN abs((l_shoulder_y + r_shoulder_y) / 2 - (l_hip_y + r_hip_y) / 2)
      WHEN lh THEN abs((l_shoulder_y + r_shoulder_y) / 2 - l_hip_y)
      WHEN rh THEN abs((l_shoulder_y + r_shoulder_y) / 2 - r_hip_y) ELSE 0 END AS torso_height_px,
    CASE WHEN lh AND rh THEN (l_shoulder_c + r_shoulder_c + l_hip_c + r_hip_c) / 4
      ELSE (l_shoulder_c + r_shoulder_c) / 2 END AS mean_conf
  FROM (SELECT *, l_shoulder_c >= 0.45 AND r_shoulder_c >= 0.45 AS sh,
    l_hip_c >= 0.45 AS lh, r_hip_c >= 0.45 AS rh FROM frames_v)))
""",
    "frames_v",
)
_COUNT = " + ".join(f"CAST({n}_c >= 0.45 AS INTEGER)" for n in C.KEYPOINTS)
view(
    "quality_v",
    f"""
SELECT *, person_detected AND quality_score >= 0.55 AND camera_angle IN ('LATERAL', 'SEMI_BACK')
  AS usable_for_analysis
FROM (SELECT *, CASE WHEN person_detected THEN round(0.40::DOUBLE * keypoints_valid / 11.0::DOUBLE
    + 0.30::DOUBLE * CASE camera_angle WHEN 'LATERAL' THEN 1.0::DOUBLE WHEN 'SEMI_BACK' THEN 0.7::DOUBLE
        WHEN 'SEMI_FRONT' THEN 0.3::DOUBLE WHEN 'FRONTAL' THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END
    + 0.20::DOUBLE * angle_confidence
    + 0.10::DOUBLE * CASE WHEN has_mask THEN 0.5::DOUBLE + 0.5::DOUBLE * least(1.0::DOUBLE, mask_area_px / 30000.0::DOUBLE)
        ELSE 0.4::DOUBLE END, 3) ELSE 0 END AS quality_score
  FROM (SELECT *, {_COUNT} AS keypoints_valid,
    coalesce(greatest(CASE WHEN l_ankle_c >= 0.45 THEN l_ankle_y END, CASE WHEN r_ankle_c >= 0.45 THEN r_ankle_y END)
      - CASE WHEN nose_c >= 0.45 THEN nose_y END, 0) AS body_height_px FROM angle_v))
""",
    "angle_v",
)
_PARTS = ("l_hip", "r_hip", "l_knee", "r_knee", "l_ankle", "r_ankle", "l_shoulder", "r_shoulder")


def _knee_sql(side: str) -> str:
    ux, uy = f"({side}_hip_px - {side}_knee_px)", f"({side}_hip_py - {side}_knee_py)"
    vx, vy = f"({side}_ankle_px - {side}_knee_px)", f"({side}_ankle_py - {side}_knee_py)"
    mag = f"(sqrt({ux}**2 + {uy}**2) * sqrt({vx}**2 + {vy}**2) / (scale * scale))"
    dot = f"(({ux} * {vx} + {uy} * {vy}) / (scale * scale))"
    return (
        f"CASE WHEN {side}_knee_px IS NULL OR {side}_ankle_px IS NULL THEN 150.0 "
        f"WHEN {mag} < 1e-6 THEN 0.0 ELSE degrees(acos(greatest(-1.0, least(1.0, {dot} / {mag})))) END"
    )


view(
    "pose_points_v",
    "SELECT *, "
    + ", ".join(
        f"CASE WHEN {n}_c >= 0.35 THEN {n}_x END AS {n}_px, CASE WHEN {n}_c >= 0.35 THEN {n}_y END AS {n}_py"
        for n in _PARTS
    )
    + ", "
    + " + ".join(f"CAST({n}_c >= 0.35 AS INTEGER)" for n in C.KEYPOINTS)
    + " AS n_pts FROM quality_v",
    "quality_v",
)
_DIST = ", ".join(
    f"sqrt(({n}_px - hx)**2 + ({n}_py - hy)**2)" for n in ("l_shoulder", "r_shoulder", "l_ankle", "r_ankle")
)
view(
    "pose_scale_v",
    f"""
SELECT *, greatest({_DIST}) AS raw_scale FROM (
  SELECT *, (l_hip_px + r_hip_px) / 2 AS hx, (l_hip_py + r_hip_py) / 2 AS hy FROM pose_points_v)
""",
    "pose_points_v",
)
view(
    "pose_raw_v",
    f"""
SELECT *, {_knee_sql('l')} AS lk, {_knee_sql('r')} AS rk,
  degrees(atan2(CASE WHEN l_shoulder_px IS NOT NULL AND r_shoulder_px IS NOT NULL
      THEN (l_shoulder_px + r_shoulder_px) / 2 - hx ELSE 0 END,
    greatest(1e-3, abs(CASE WHEN l_shoulder_px IS NOT NULL AND r_shoulder_px IS NOT NULL
      THEN (l_shoulder_py + r_shoulder_py) / 2 - hy ELSE 0 END)))) AS lean,
  CASE WHEN l_ankle_px IS NOT NULL AND r_ankle_px IS NOT NULL
    THEN least(1.5, sqrt((l_ankle_px - r_ankle_px)**2 + (l_ankle_py - r_ankle_py)**2) / scale) ELSE 0 END AS sep,
  CASE WHEN l_ankle_px IS NOT NULL AND r_ankle_px IS NOT NULL
    THEN abs(l_ankle_px - r_ankle_px) / scale ELSE 0 END AS foot,
  CASE WHEN l_ankle_py IS NOT NULL AND r_ankle_py IS NOT NULL
    THEN ((l_ankle_py - hy) / scale + (r_ankle_py - hy) / scale) / 2
    ELSE coalesce((l_ankle_py - hy) / scale, (r_ankle_py - hy) / scale, 0) END AS height
FROM (SELECT *, CASE WHEN valid THEN raw_scale END AS scale FROM (
  SELECT *, coalesce(n_pts >= 6 AND raw_scale >= 8, false) AS valid FROM pose_scale_v))
""",
    "pose_scale_v",
)
view(
    "pose_v",
    """
SELECT *, least(1.0, (1 - bend) * 0.4 + up * 0.35 + (1 - flight_score) * 0.25) AS landing_score,
  CASE WHEN valid THEN round(least(1.0, n_pts / 9.0::DOUBLE), 3) ELSE 0 END AS pose_quality FROM (
SELECT *, least(1.0, asym * 0.45 + greatest(0, -height) * 0.35 + foot * 0.2) AS flight_score,
  least(1.0, bend * 0.6 + greatest(0, lean) / 45 * 0.4) AS arch_score,
  least(1.0, foot * 0.5 + (1 - least(lk, rk) / 180) * 0.35 + up * 0.15) AS hop_contact_score,
  least(1.0, (1 - asym) * 0.4 + (1 - abs(sep - 0.35)) * 0.35 + up * 0.25) AS running_score,
  least(1.0, greatest(0, 1 - sep * 1.8) * (0.5 + bend * 0.5)) AS feet_together_score
FROM (SELECT *, abs(lk - rk) / 180 AS asym, greatest(0, height) AS up,
  ((CASE WHEN lk > 0 THEN abs(180 - lk) ELSE 0 END) + (CASE WHEN rk > 0 THEN abs(180 - rk) ELSE 0 END))
    / greatest(CAST(lk > 0 AS INTEGER) + CAST(rk > 0 AS INTEGER), 1) / 90 AS bend FROM pose_raw_v))
""",
    "pose_raw_v",
)
#: SQL column of each feature and the digits it is rounded to.
FEATURE_SQL = {
    "l_knee_angle": ("lk", 2), "r_knee_angle": ("rk", 2), "torso_lean": ("lean", 2),
    "ankle_sep_norm": ("sep", 3), "foot_asymmetry": ("foot", 3), "leg_extension_asym": ("asym", 3),
    "avg_foot_height": ("height", 3), "arch_score": ("arch_score", 3),
    "hop_contact_score": ("hop_contact_score", 3), "flight_score": ("flight_score", 3),
    "running_score": ("running_score", 3), "landing_score": ("landing_score", 3),
    "feet_together_score": ("feet_together_score", 3), "body_extension": ("bend", 3),
}
_SCALED = {
    "l_knee_angle": "lk / 180", "r_knee_angle": "rk / 180", "torso_lean": "(lean + 90) / 180",
    "avg_foot_height": "(height + 1) / 2",
}
VECTOR_SQL = "[" + ", ".join(_SCALED.get(n, FEATURE_SQL[n][0]) for n in FEATURES) + "]"
view("pose_vec_v", f"SELECT *, CASE WHEN valid THEN {VECTOR_SQL} END AS vector FROM pose_v", "pose_v")
view(
    "foot_v",
    """
SELECT *, greatest(CASE WHEN l_ankle_c >= 0.4 THEN l_ankle_y END, CASE WHEN r_ankle_c >= 0.4 THEN r_ankle_y END) AS foot_y,
  CASE WHEN l_ankle_c >= 0.4 AND r_ankle_c >= 0.4 THEN (l_ankle_x + r_ankle_x) / 2
    WHEN l_ankle_c >= 0.4 THEN l_ankle_x WHEN r_ankle_c >= 0.4 THEN r_ankle_x ELSE (bx1 + bx2) / 2 END AS foot_px,
  CASE WHEN l_ankle_c >= 0.4 AND r_ankle_c >= 0.4 THEN (l_ankle_y + r_ankle_y) / 2
    WHEN l_ankle_c >= 0.4 THEN l_ankle_y WHEN r_ankle_c >= 0.4 THEN r_ankle_y ELSE by2 END AS foot_py
FROM pose_vec_v
""",
    "pose_vec_v",
)


def analysed(spark, sf):
    return FR.analyse_frames(C.frames(spark, sf))


def posed(spark, sf):
    return P.pose_features(analysed(spark, sf))


# ------------------------------------------------------------ F1 - F10

@query(
    "f1_camera_angle",
    sql(
        """SELECT video_id, frame_idx, camera_angle, round(shoulder_ratio, 6) AS shoulder_ratio,
  round(angle_confidence, 6) AS angle_confidence, round(torso_height_px, 6) AS torso_height_px,
  round(shoulder_width_px, 6) AS shoulder_width_px FROM angle_v""",
        "angle_v",
    ),
)
def f1(spark, sf):
    return P.camera_angle(C.frames(spark, sf)).select(
        "video_id", "frame_idx", "camera_angle",
        *[rnd(F.col(c)).alias(c) for c in ("shoulder_ratio", "angle_confidence", "torso_height_px", "shoulder_width_px")],
    )


@query(
    "f2_quality",
    sql("SELECT video_id, frame_idx, quality_score, usable_for_analysis FROM quality_v", "quality_v"),
)
def f2(spark, sf):
    return analysed(spark, sf).select("video_id", "frame_idx", "quality_score", "usable_for_analysis")


@query(
    "f3_frame_geometry",
    sql(
        """SELECT video_id, frame_idx, keypoints_valid, round(coalesce(greatest(0, bx2 - bx1) * greatest(0, by2 - by1), NULL), 6) AS bbox_area,
  round(body_height_px, 6) AS body_height_px FROM quality_v WHERE person_detected""",
        "quality_v",
    ),
)
def f3(spark, sf):
    return P.frame_geometry(C.frames(spark, sf).filter("person_detected")).select(
        "video_id", "frame_idx", "keypoints_valid", rnd(F.col("bbox_area")).alias("bbox_area"),
        rnd(F.col("body_height_px")).alias("body_height_px"),
    )


@query(
    "f4_keypoint",
    sql(
        """SELECT video_id, frame_idx, round(CASE WHEN l_knee_c >= 0.4 THEN l_knee_x END, 6) AS knee_x,
  round(CASE WHEN l_knee_c >= 0.4 THEN l_knee_y END, 6) AS knee_y, round(nose_c, 6) AS nose_conf FROM frames_v""",
        "frames_v",
    ),
)
def f4(spark, sf):
    knee = P.keypoint("l_knee", P.CONF_FOOT)
    return C.frames(spark, sf).select(
        "video_id", "frame_idx", rnd(knee["x"]).alias("knee_x"), rnd(knee["y"]).alias("knee_y"),
        rnd(P.keypoint("nose")["conf"]).alias("nose_conf"),
    )


@query(
    "f5_pose_features",
    sql(
        "SELECT video_id, frame_idx, valid, pose_quality, "
        + ", ".join(
            f"CASE WHEN valid THEN round({s}, {d}) ELSE 0 END AS {n}" for n, (s, d) in FEATURE_SQL.items()
        )
        + " FROM pose_v",
        "pose_v",
    ),
)
def f5(spark, sf):
    return posed(spark, sf).select(
        "video_id", "frame_idx", F.col("pose.valid").alias("valid"), F.col("pose.quality").alias("pose_quality"),
        *[(F.col(f"pose.{n}") + 0.0).alias(n) for n in FEATURES],
    )


@query(
    "f6_pose_vector",
    sql(
        """SELECT video_id, frame_idx, unnest(range(14)) AS dim,
  round(unnest(vector), 4) + 0.0::DOUBLE AS value FROM pose_vec_v WHERE valid""",
        "pose_vec_v",
    ),
)
def f6(spark, sf):
    return posed(spark, sf).filter("pose.valid").select(
        "video_id", "frame_idx", F.posexplode(P.pose_vector()).alias("dim", "value")
    ).withColumn("value", F.col("value") + 0.0)


@query(
    "f7_foot_point",
    sql("SELECT video_id, frame_idx, round(foot_px, 6) AS x, round(foot_py, 6) AS y FROM foot_v", "foot_v"),
)
def f7(spark, sf):
    p = P.foot_point()
    return C.frames(spark, sf).select("video_id", "frame_idx", rnd(p.x).alias("x"), rnd(p.y).alias("y"))


@query("f8_foot_y", sql("SELECT video_id, frame_idx, round(foot_y, 6) AS foot_y FROM foot_v", "foot_v"))
def f8(spark, sf):
    return C.frames(spark, sf).select("video_id", "frame_idx", rnd(P.foot_y()).alias("foot_y"))


@query(
    "f9_boxes",
    sql(
        """SELECT video_id, frame_idx, det_id, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy,
  round(greatest(0, x2 - x1) * greatest(0, y2 - y1), 6) AS area, y1 + (y2 - y1) * 0.5 AS half_top FROM detections_v""",
        "detections_v",
    ),
)
def f9(spark, sf):
    box = F.array("x1", "y1", "x2", "y2")
    c = G.box_center(box)
    return C.detections(spark, sf).select(
        "video_id", "frame_idx", "det_id", c.x.alias("cx"), c.y.alias("cy"),
        rnd(G.rect_area(box)).alias("area"), G.box_bottom_half(box)[1].alias("half_top"),
    )


@query(
    "f10_project_on_axis",
    sql(
        """SELECT video_id, frame_idx, round(CASE WHEN n > 1e-6 THEN
    ((bx1 + bx2) * 0.5 - nose_x) * (dir_x / n) + (by2 - nose_y) * (dir_y / n) END, 4) AS box_s,
  round(CASE WHEN n > 1e-9 THEN (l_knee_x - nose_x) * (dir_x / n) + (l_knee_y - nose_y) * (dir_y / n) END, 4) AS point_s
FROM (SELECT *, sqrt(dir_x * dir_x + dir_y * dir_y) AS n FROM frames_v)""",
        "frames_v",
    ),
)
def f10(spark, sf):
    nose = P.keypoint("nose")
    df = C.frames(spark, sf).withColumn(
        "axis",
        F.struct((nose["x"] / 1280).alias("ox"), (nose["y"] / 720).alias("oy"),
                 F.col("dir_x").alias("dx"), F.col("dir_y").alias("dy")),
    )
    return df.select(
        "video_id", "frame_idx",
        rnd(G.project_box(F.col("person_bbox"), F.col("axis"), 1280, 720), 4).alias("box_s"),
        rnd(G.project_point(P.keypoint("l_knee"), F.col("axis"), 1280, 720), 4).alias("point_s"),
    )


# ------------------------------------------------------------ F17 - F24, F37

@query(
    "f17_bbox_iou_lerp",
    sql(
        """SELECT video_id, frame_idx, round(CASE WHEN inter > 0 THEN inter / (area_a + area_b - inter) ELSE 0 END, 6) AS iou,
  round(x1 + (nx1 - x1) * 0.25, 6) AS mid_x1, round(y2 + (ny2 - y2) * 0.25, 6) AS mid_y2
FROM (SELECT a.video_id, a.frame_idx, a.x1, a.y2, b.x1 AS nx1, b.y2 AS ny2,
  greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS inter,
  (a.x2 - a.x1) * (a.y2 - a.y1) AS area_a, (b.x2 - b.x1) * (b.y2 - b.y1) AS area_b
  FROM detections_v a JOIN detections_v b ON a.video_id = b.video_id AND a.frame_idx = b.frame_idx
    AND a.det_id = 1 AND b.det_id = 2)""",
        "detections_v",
    ),
)
def f17(spark, sf):
    # Both boxes sit in one group, so a conditional aggregate replaces a self-join.
    box = F.struct("x1", "y1", "x2", "y2")
    both = C.detections(spark, sf).groupBy("video_id", "frame_idx").agg(
        F.max(F.when(F.col("det_id") == 1, box)).alias("a"), F.max(F.when(F.col("det_id") == 2, box)).alias("b")
    ).filter("a is not null and b is not null")
    a, b = (F.array(*[F.col(f"{s}.{k}") for k in ("x1", "y1", "x2", "y2")]) for s in "ab")
    mid = G.box_lerp(a, b, F.lit(0.25))
    return both.select(
        "video_id", "frame_idx", rnd(G.box_iou(a, b)).alias("iou"),
        rnd(mid[0]).alias("mid_x1"), rnd(mid[3]).alias("mid_y2"),
    )


@query(
    "f18_tracker_quality",
    sql(
        """SELECT video_id, frame_idx, det_id,
  floor((0.45::DOUBLE * (track_id + 9) / 17 + 0.30::DOUBLE * conf + 0.15::DOUBLE * least(1.0::DOUBLE, mask_area_px / 30000.0::DOUBLE)
    + 0.10::DOUBLE * appearance_sim) * 1000.0::DOUBLE + 0.5::DOUBLE) / 1000.0::DOUBLE AS tracked,
  floor(greatest(0.20::DOUBLE, least(0.48::DOUBLE, 0.18::DOUBLE + 0.22::DOUBLE * conf
    + 0.12::DOUBLE * least(1.0::DOUBLE, mask_area_px / 30000.0::DOUBLE) + 0.12::DOUBLE * appearance_sim)) * 1000.0::DOUBLE + 0.5::DOUBLE) / 1000.0::DOUBLE AS box_only,
  floor(greatest(0.2::DOUBLE, least(0.45::DOUBLE, 0.2::DOUBLE + mask_area_px / 60000.0::DOUBLE)) * 1000.0::DOUBLE + 0.5::DOUBLE) / 1000.0::DOUBLE AS corrected
FROM detections_v""",
        "detections_v",
    ),
)
def f18(spark, sf):
    area = F.col("mask_area_px")
    return C.detections(spark, sf).select(
        "video_id", "frame_idx", "det_id",
        P.tracker_quality(F.col("track_id") + 9, F.col("conf"), area, F.col("appearance_sim")).alias("tracked"),
        P.box_only_quality(F.col("conf"), area, F.col("appearance_sim")).alias("box_only"),
        P.corrected_quality(area).alias("corrected"),
    )


@query(
    "f19_quality_floor",
    sql(
        """SELECT video_id, frame_idx, CASE WHEN person_detected AND quality_score < 0.15 + 0.4
    THEN greatest(0.15::DOUBLE, 0.3::DOUBLE) ELSE quality_score END AS probe,
  CASE WHEN person_detected AND quality_score - 0.3::DOUBLE < 0.15 THEN
    greatest(0.15::DOUBLE, round(greatest(0.20::DOUBLE, least(0.48::DOUBLE, 0.18::DOUBLE + 0.22::DOUBLE * 0.5::DOUBLE
      + 0.12::DOUBLE * least(1.0::DOUBLE, mask_area_px / 30000.0::DOUBLE) + 0.12::DOUBLE * appearance_sim)), 3))
    ELSE round(quality_score - 0.3::DOUBLE, 6) END AS floored FROM quality_v""",
        "quality_v",
    ),
)
def f19(spark, sf):
    df = analysed(spark, sf)
    only = P.box_only_quality(F.lit(0.5), F.col("mask_area_px"), F.col("appearance_sim"))
    q = F.col("quality_score")
    return df.select(
        "video_id", "frame_idx",
        F.when(F.col("person_detected") & (q < 0.15 + 0.4), F.lit(0.3)).otherwise(q).alias("probe"),
        F.round(P.quality_with_floor(q - 0.3, F.col("person_detected"), F.col("person_bbox"), only), 6).alias("floored"),
    )


@query(
    "f20_usable",
    sql(
        """SELECT video_id, frame_idx, usable_for_analysis OR camera_angle IN ('LATERAL', 'SEMI_BACK') AS usable
FROM quality_v""",
        "quality_v",
    ),
)
def f20(spark, sf):
    return analysed(spark, sf).select("video_id", "frame_idx", P.usable().alias("usable"))


@query(
    "f21_gt_frame_quality",
    sql(
        """SELECT video_id, frame_idx, round(CASE WHEN NOT person_detected THEN 0 ELSE 0.4::DOUBLE
  + CASE WHEN camera_angle IN ('LATERAL', 'SEMI_BACK') THEN 0.35::DOUBLE ELSE 0 END
  + CASE WHEN usable_for_analysis THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN camera_angle = 'LATERAL' THEN 0.1::DOUBLE ELSE 0 END
  + CASE WHEN valid THEN 0.2::DOUBLE * pose_quality ELSE 0 END END, 6) AS score FROM pose_v""",
        "pose_v",
    ),
)
def f21(spark, sf):
    return posed(spark, sf).select("video_id", "frame_idx", rnd(P.ground_truth_quality()).alias("score"))


@query(
    "f37_serialise_keypoints",
    sql(
        "SELECT video_id, frame_idx, k.name AS name, round(k.x, 2) AS x, round(k.y, 2) AS y, round(k.c, 4) AS conf FROM ("
        "SELECT video_id, frame_idx, unnest(["
        + ", ".join(f"{{'name': '{n}', 'x': {n}_x, 'y': {n}_y, 'c': {n}_c}}" for n in C.KEYPOINTS)
        + "]) AS k FROM frames_v)",
        "frames_v",
    ),
)
def f37(spark, sf):
    return C.frames(spark, sf).select("video_id", "frame_idx", F.inline(P.standard_keypoints()))


@query(
    "f39_display_quality",
    sql(
        """SELECT video_id, frame_idx, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, quality_score)) * 100) AS quality,
  NOT usable_for_analysis AS skip, round(timestamp_s * 1000) AS time_ms FROM quality_v""",
        "quality_v",
    ),
)
def f39(spark, sf):
    return FR.display_frames(analysed(spark, sf))


# ------------------------------------------------------------ summaries

@query(
    "a1_video_summary",
    sql(
        """SELECT video_id, total AS total_frames_analyzed, n AS frames_with_person,
  round(n / greatest(total, 1) * 100, 1) AS detection_rate_pct, usable AS frames_usable,
  round(usable / greatest(total, 1) * 100, 1) AS usable_rate_pct, track_id_count,
  CASE WHEN n > 0 THEN round(c1 / n * 100, 1) END AS frontal_pct, CASE WHEN n > 0 THEN round(c2 / n * 100, 1) END AS semi_front_pct,
  CASE WHEN n > 0 THEN round(c3 / n * 100, 1) END AS lateral_pct, CASE WHEN n > 0 THEN round(c4 / n * 100, 1) END AS semi_back_pct,
  CASE WHEN n > 0 THEN round(c5 / n * 100, 1) END AS unknown_pct,
  CASE WHEN n > 0 THEN list_max([{'n': c1, 'a': 'FRONTAL'}, {'n': c2, 'a': 'SEMI_FRONT'}, {'n': c3, 'a': 'LATERAL'},
    {'n': c4, 'a': 'SEMI_BACK'}, {'n': c5, 'a': 'UNKNOWN'}]).a END AS dominant_angle,
  round(qm, 3) AS quality_mean, round(qlo, 3) AS quality_min, round(qhi, 3) AS quality_max,
  CASE WHEN n > 0 THEN coalesce(round(rm, 3), 0) END AS ratio_mean, CASE WHEN n > 0 THEN coalesce(round(rlo, 3), 0) END AS ratio_min,
  CASE WHEN n > 0 THEN coalesce(round(rhi, 3), 0) END AS ratio_max, CASE WHEN n > 0 THEN coalesce(round(rsd, 3), 0) END AS ratio_std,
  round(kp, 2) AS keypoints_valid_avg, CASE WHEN n = 0 THEN 'No person detected in any frame' END AS error
FROM (SELECT video_id, count(*) AS total, count(*) FILTER (person_detected) AS n,
  count(*) FILTER (person_detected AND usable_for_analysis) AS usable,
  count(DISTINCT track_id) FILTER (person_detected) AS track_id_count,
  count(*) FILTER (person_detected AND camera_angle = 'FRONTAL') AS c1, count(*) FILTER (person_detected AND camera_angle = 'SEMI_FRONT') AS c2,
  count(*) FILTER (person_detected AND camera_angle = 'LATERAL') AS c3, count(*) FILTER (person_detected AND camera_angle = 'SEMI_BACK') AS c4,
  count(*) FILTER (person_detected AND camera_angle = 'UNKNOWN') AS c5,
  avg(quality_score) FILTER (person_detected) AS qm, min(quality_score) FILTER (person_detected) AS qlo,
  max(quality_score) FILTER (person_detected) AS qhi, avg(shoulder_ratio) FILTER (person_detected AND shoulder_ratio > 0) AS rm,
  min(shoulder_ratio) FILTER (person_detected AND shoulder_ratio > 0) AS rlo,
  max(shoulder_ratio) FILTER (person_detected AND shoulder_ratio > 0) AS rhi,
  stddev_pop(shoulder_ratio) FILTER (person_detected AND shoulder_ratio > 0) AS rsd,
  avg(keypoints_valid) FILTER (person_detected) AS kp FROM quality_v GROUP BY video_id)""",
        "quality_v",
    ),
)
def a1(spark, sf):
    return FR.video_summary(analysed(spark, sf))


@query(
    "a1_track_ids",
    sql("SELECT DISTINCT video_id, track_id FROM frames_v WHERE person_detected", "frames_v"),
)
def a1_ids(spark, sf):
    return FR.track_ids(C.frames(spark, sf))


@query(
    "a2_angle_distribution",
    sql(
        """SELECT video_id, camera_angle, round(n / sum(n) OVER (PARTITION BY video_id) * 100, 1) AS pct,
  first_value(camera_angle) OVER (PARTITION BY video_id ORDER BY n DESC, camera_angle DESC) AS dominant_angle
FROM (SELECT video_id, camera_angle, count(*) AS n FROM quality_v WHERE person_detected GROUP BY ALL)""",
        "quality_v",
    ),
)
def a2(spark, sf):
    return FR.angle_distribution(analysed(spark, sf)).select(
        "video_id", "dominant_angle", F.explode("distribution").alias("camera_angle", "pct")
    )


@query(
    "a15_usable_ratio",
    sql(
        """SELECT video_id, round(count(*) FILTER (person_detected AND (usable_for_analysis OR camera_angle IN ('LATERAL', 'SEMI_BACK')))
  / greatest(count(*), 1), 6) AS usable_ratio, max(frame_idx) AS last_frame_idx FROM quality_v GROUP BY video_id""",
        "quality_v",
    ),
)
def a15(spark, sf):
    return FR.usable_ratio(analysed(spark, sf)).withColumn("usable_ratio", rnd(F.col("usable_ratio")))


@query(
    "e28_timeline",
    sql(
        """SELECT video_id, frame_idx, round(timestamp_s, 6) AS timestamp_s,
  round(coalesce(lead(timestamp_s) OVER (PARTITION BY video_id ORDER BY frame_idx), timestamp_s), 6) AS next_timestamp_s,
  camera_angle, round(shoulder_ratio, 6) AS shoulder_ratio, quality_score, usable_for_analysis, keypoints_valid FROM quality_v""",
        "quality_v",
    ),
)
def e28(spark, sf):
    return FR.timeline(analysed(spark, sf)).withColumns(
        {c: rnd(F.col(c)) for c in ("timestamp_s", "next_timestamp_s", "shoulder_ratio")}
    )


@query(
    "s10_sample_frames",
    sql(
        """SELECT video_id, frame_idx FROM (SELECT video_id, frame_idx, row_number() OVER (PARTITION BY video_id ORDER BY frame_idx) AS rn
  FROM frames_v WHERE frame_idx >= 9 AND (frame_idx - 9) % 6 = 0 AND frame_idx < 120) WHERE rn <= 12""",
        "frames_v",
    ),
)
def s10(spark, sf):
    return FR.sample_frames(C.frames(spark, sf), stride=6, start_sec=0.3, end_sec=4.0, max_frames=12).select(
        "video_id", "frame_idx"
    )


@query(
    "o3_limit_per_video",
    sql(
        """SELECT video_id, frame_idx, det_id FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame_idx, det_id) AS rn
  FROM detections_v) WHERE rn <= 25""",
        "detections_v",
    ),
)
def o3(spark, sf):
    # row_number() <= n lets Spark keep only n rows per key before the shuffle.
    from pyspark.sql import Window

    w = Window.partitionBy("video_id").orderBy("frame_idx", "det_id")
    return (
        C.detections(spark, sf).select("video_id", "frame_idx", "det_id")
        .withColumn("rn", F.row_number().over(w)).filter("rn <= 25").drop("rn")
    )
