"""Edge rows of the frame functions."""

import math

from pyspark.sql import functions as F

from strideflow.functions import geometry as G
from strideflow.functions import pose as P
from strideflow.functions import scores as S
from strideflow.functions import vectors as V
from strideflow.operators import frames as FR
from strideflow.schemas import KEYPOINTS

BASE = {
    "nose": (100, 20), "l_shoulder": (95, 50), "r_shoulder": (105, 50), "l_elbow": (90, 70), "r_elbow": (110, 70),
    "l_hip": (97, 100), "r_hip": (103, 100), "l_knee": (96, 140), "r_knee": (104, 140), "l_ankle": (95, 180), "r_ankle": (125, 178),
}


def frame(spark, change=None, conf=0.9, order=KEYPOINTS, **extra):
    pts = {**BASE, **(change or {})}
    kps = [(n, float(pts[n][0]), float(pts[n][1]), float(pts[n][2] if len(pts[n]) > 2 else conf)) for n in order if pts[n] is not None]
    row = {"video_id": "v", "frame_idx": 3, "person_detected": True, "has_mask": False, "mask_area_px": 0, **extra}
    schema = (
        "video_id string, frame_idx int, person_detected boolean, has_mask boolean, mask_area_px int, "
        "keypoints array<struct<name:string,x:double,y:double,conf:double>>, person_bbox array<double>"
    )
    values = [row["video_id"], row["frame_idx"], row["person_detected"], row["has_mask"], row["mask_area_px"], kps, row.get("box", [80.0, 10.0, 130.0, 190.0])]
    return spark.createDataFrame([values], schema)


def angle(df):
    return P.camera_angle(df).first()


def test_camera_angle_limits(spark):
    def wide(x):  # shoulder width x over a torso of 50
        return frame(spark, {"l_shoulder": (100 - x / 2, 50), "r_shoulder": (100 + x / 2, 50)})

    seen = [angle(wide(x)).camera_angle for x in (50, 40, 30, 25, 20, 10, 5, 2.5, 1)]
    assert seen == ["FRONTAL", "SEMI_FRONT", "SEMI_FRONT", "LATERAL", "LATERAL", "SEMI_BACK", "SEMI_BACK", "UNKNOWN", "UNKNOWN"]


def test_camera_angle_fallbacks(spark):
    one_hip = angle(frame(spark, {"l_hip": (97, 100, 0.44)}))
    assert one_hip.camera_angle == "SEMI_BACK" and one_hip.torso_height_px == 50
    weak = angle(frame(spark, {"l_shoulder": (95, 50, 0.449)}))
    assert weak.camera_angle == "UNKNOWN" and weak.angle_confidence == 0
    flat = angle(frame(spark, {"l_hip": (97, 59.9), "r_hip": (103, 59.9)}))
    assert flat.camera_angle == "UNKNOWN" and flat.shoulder_ratio == 0 and abs(flat.torso_height_px - 9.9) < 1e-9


def test_keypoint_order_does_not_matter(spark):
    a = P.pose_features(frame(spark)).first().pose
    b = P.pose_features(frame(spark, order=tuple(reversed(KEYPOINTS)))).first().pose
    assert a == b and a.valid and a.quality == 1.0


def test_pose_features_invalid(spark):
    few = P.pose_features(frame(spark, order=("l_hip", "r_hip", "l_ankle", "r_ankle", "nose"))).first().pose
    no_hip = P.pose_features(frame(spark, {"l_hip": (97, 100, 0.34)})).first().pose
    tiny = {n: (100 + (x - 100) / 20, 100 + (y - 100) / 20) for n, (x, y) in BASE.items()}
    small = P.pose_features(frame(spark, tiny)).first().pose
    for p in (few, no_hip, small):
        assert not p.valid and p.vector is None and p.quality == 0


def test_missing_knee_counts_as_150(spark):
    p = P.pose_features(frame(spark, {"l_knee": (0, 0, 0.1)})).first().pose
    assert p.l_knee_angle == 150.0 and abs(p.vector[0] - 150 / 180) < 1e-12


def test_quality_and_no_person(spark):
    r = FR.analyse_frames(frame(spark)).first()
    want = round(0.4 + 0.3 * 0.7 + 0.2 * 0.9 + 0.1 * 0.4, 3)
    assert r.quality_score == want and r.usable_for_analysis and r.keypoints_valid == 11
    nobody = FR.analyse_frames(frame(spark, person_detected=False)).first()
    assert nobody.quality_score == 0 and not nobody.usable_for_analysis


def test_summary_of_empty_video(spark):
    df = FR.analyse_frames(frame(spark, person_detected=False)).withColumn("track_id", F.lit(1))
    r = FR.video_summary(df).first()
    assert r.error and r.frames_with_person == 0 and r.dominant_angle is None


def test_foot_point(spark):
    point = P.foot_point()
    one = frame(spark, {"l_ankle": (95, 180, 0.39)}).select(point.alias("p")).first().p
    none = frame(spark, {"l_ankle": (95, 180, 0.1), "r_ankle": (1, 1, 0.1)}).select(point.alias("p"), P.foot_y().alias("y")).first()
    assert (one.x, one.y) == (125, 178)
    assert (none.p.x, none.p.y) == (105, 190) and none.y is None


def values(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def arr(*v):
    return F.array(*[F.lit(x) for x in v])


def test_similarity_folds_negatives(spark):
    r = values(
        spark, neg=V.similarity01(arr(1.0, 0.0), arr(-0.1, math.sqrt(0.99))), pos=V.similarity01(arr(1.0, 0.0), arr(0.1, math.sqrt(0.99))),
        size=V.cosine(arr(1.0), arr(1.0, 2.0)), zero=V.cosine(arr(0.0, 0.0), arr(1.0, 2.0)), none=V.vec_distance(F.array().cast("array<double>"), arr(1.0)),
    )
    assert abs(r.neg - 0.45) < 1e-9 and abs(r.pos - 0.10) < 1e-9 and r.size is None and r.zero is None and r.none == 1e9


def test_labels_and_indicator(spark):
    r = values(
        spark, a=S.label_pose(F.lit(0.75)), b=S.label_pose(F.lit(0.55)), c=S.label_pose(F.lit(0.1)), d=S.label_pose(F.lit(None).cast("double")),
        near=S.indicator(F.lit(1.07), F.lit(1.0)), up=S.indicator(F.lit(1.2), F.lit(1.0)), zero=S.indicator(F.lit(0.0), F.lit(0.0)),
        t=S.duration_label(F.lit(65.4)), u=S.duration_label(F.lit(None).cast("double")), s=S.slug(F.lit("Ana María Peña")),
    )
    assert (r.a, r.b, r.c, r.d) == ("buena", "regular", "débil", None)
    assert (r.near, r.up, r.zero) == ("~", "+", "~")
    assert (r.t, r.u, r.s) == ("1:05", "—", "ana-maria-pena")


def test_polygons(spark):
    square = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (2, 0), (2, 1), (0, 1))])
    r = values(
        spark, area=G.polygon_area(square), aspect=G.polygon_aspect(square), axis=G.longest_edge_axis(square, 1.0, 1.0),
        inside=G.contains_point(G.polygon_edges(square), F.lit(1.0), F.lit(0.5)), out=G.contains_point(G.polygon_edges(square), F.lit(3.0), F.lit(0.5)),
        share=G.box_polygon_share(arr(1.0, 0.0, 3.0, 1.0), G.polygon_edges(square)), line=G.polygon_area(F.slice(square, 1, 2)),
    )
    assert r.area == 2 and r.aspect == 2 and (r.axis.dx, r.axis.dy) == (2, 0) and r.inside and not r.out
    assert r.share == 0.5 and r.line == 0
