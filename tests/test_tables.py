"""Documents, writers, edits and history on small hand-made rows."""

import json

import pytest
from pyspark.sql import functions as F

from strideflow.operators import contacts as K
from strideflow.operators import edits as ED
from strideflow.operators import history as H
from strideflow.operators import joins as J
from strideflow.operators import metrics as MT
from strideflow.sources import readers as RD
from strideflow.sources import writers as WR


def put(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(data, indent=1), encoding="utf-8")


def test_read_analysis_defaults_and_passes(spark, tmp_path):
    kps = [{"name": "l_shoulder", "x": 90, "y": 50, "conf": 0.9}, {"name": "r_shoulder", "x": 110, "y": 50, "conf": 0.9},
           {"name": "l_hip", "x": 97, "y": 100, "conf": 0.9}, {"name": "r_hip", "x": 103, "y": 100, "conf": 0.9}]
    put(tmp_path / "V1" / "analysis.json", {"frames": [{"frame_idx": 3, "person_detected": True, "keypoints": kps, "camera_angle": "odd"}, {"frame_idx": 6}]})
    put(tmp_path / "V1_refined" / "analysis.json", {"analysis_version": 4, "video_info": {"fps": 25, "width": 848}, "frames": []})
    frames, videos = RD.read_analysis(spark, str(tmp_path / "*" / "analysis.json"))
    rows = {r.frame_idx: r for r in frames.collect()}
    assert rows[3].video_id == "V1" and rows[3]["pass"] == "first" and rows[3].camera_angle == "LATERAL" and rows[3].quality_score > 0
    assert rows[6].timestamp_s == 0 and rows[6].tracking_source == "bytetrack" and rows[6].camera_angle == "UNKNOWN"
    v = {r["pass"]: r for r in videos.collect()}
    assert v["first"].fps == 30 and v["first"].width == 1280 and v["refined"].fps == 25 and v["refined"].video_id == "V1"


def test_read_calibration_normalises(spark, tmp_path):
    put(tmp_path / "V" / "calibration.json", {
        "mode": "color_masks",
        "keyframes": [{"frame_idx": 9, "track_polygon": [[1.2, -0.1], ["bad", 0.5], [0.5]], "axis": {"origin": [0.1, 0.2], "direction": [1, 0]},
                       "scale": {"known_distance_m": 5, "point_a": [0, 0]}}],
        "seeds": [{"frame_idx": 2, "seed_points": [[0.1, 0.1]], "labels": ["corner_tl"]}],
        "mask_frames": {"12": {"track": "t.png", "confidence": 0.9, "track_area_norm": 0.1}},
    })
    c = RD.read_calibration(spark, str(tmp_path / "*" / "calibration.json"))
    k = c["keyframes"].first()
    assert [(p.x, p.y) for p in k.track_polygon] == [(1.0, 0.0)] and k.axis.dx == 1 and k.scale is None
    assert c["mask_frames"].first().frame_idx == 12 and c["seeds"].first().labels == ["corner_tl"]
    assert c["calibrations"].first().n_mask_frames == 1


def test_read_sections_gt_prototypes_sessions(spark, tmp_path):
    put(tmp_path / "V" / "sections.json", {"athlete_id": "x", "contacts": [{"index": 1, "frame_idx": 7, "type": "hop"}], "phases": {"hop_1": {"start_frame": 7, "end_frame": 9}}})
    videos = spark.createDataFrame([("V",), ("W",)], "video_id string")
    s = RD.read_sections(spark, str(tmp_path / "*" / "sections.json"), videos)
    assert s["phases"].count() == 14 and s["contacts"].count() == 1 and s["sections"].filter("video_id = 'W'").first().confidence == 0
    put(tmp_path / "gt.json", {"samples": [{"video_id": "V", "frame_idx": 1, "phase": "hop_1", "feature_vector": [0.1]}]})
    assert RD.read_gt(spark, str(tmp_path / "gt.json")).first().phase == "hop_1"
    put(tmp_path / "p.json", {"phases": {"hop_1": {"centroid": [1.0]}}, "pose_tags": {"landing": {"centroid": [2.0], "weights": [1.0]}}})
    p = {(r.kind, r.key): r.centroid for r in RD.read_prototypes(spark, str(tmp_path / "p.json")).collect()}
    assert p == {("phase", "hop_1"): [1.0], ("tag", "landing"): [2.0]}
    put(tmp_path / "a" / "VOD.json", {"athlete_id": "a", "intervals_s": [0.5, None]})
    put(tmp_path / "a" / "OTHER.json", {"athlete_id": "a"})
    assert RD.read_sessions(spark, str(tmp_path / "a" / "*.json"), "a", "OTHER").first().video_id == "VOD"


def test_labels_round_trip_and_append(spark, tmp_path):
    def keyframes(video, n):
        rows = [(video, f, [(0.1, 0.2), (0.3, 0.2), (0.3, 0.4)], [], "manual", None) for f in range(n)]
        poly = "array<struct<x:double,y:double>>"
        return spark.createDataFrame(rows, f"video_id string, frame_idx int, track_polygon {poly}, landing_zone {poly}, source string, venue_confidence double")

    out = str(tmp_path / "labels")
    WR.export_labels(keyframes("A", 3), out)
    WR.export_labels(keyframes("B", 2), out)
    assert spark.read.parquet(out).groupBy("video_id").count().count() == 2
    WR.export_labels(keyframes("A", 6), out)  # replaces only this video
    got = {r.video_id: r["count"] for r in spark.read.parquet(out).groupBy("video_id").count().collect()}
    assert got == {"A": 6, "B": 2}
    line = spark.read.parquet(out).first().line
    assert line == "0 0.100000 0.200000 0.300000 0.200000 0.300000 0.400000"
    folder = tmp_path / "labels_txt" / "val"
    folder.mkdir(parents=True)
    (folder / "VOD_7_000012.txt").write_text(line + "\n")
    r = RD.read_polygon_labels(spark, str(folder / "*.txt")).first()
    assert (r.split, r.video_id, r.frame_idx, r["class"], len(r.points)) == ("val", "VOD_7", 12, 0, 3)
    one = WR.split_train_val(keyframes("C", 1)).first()
    assert one.split == "train"


def test_write_analysis_replaces_only_its_videos(spark, tmp_path):
    frames = spark.createDataFrame([("A", "first", 1), ("B", "first", 1)], "video_id string, pass string, frame_idx int")
    videos = spark.createDataFrame([("A", "first"), ("B", "first")], "video_id string, pass string")
    WR.write_analysis(frames, videos, str(tmp_path))
    stored = spark.read.parquet(str(tmp_path / "videos"))
    WR.write_analysis(frames.filter("video_id = 'A'").withColumn("frame_idx", F.lit(5)), videos.filter("video_id = 'A'"), str(tmp_path), stored.select("video_id", "pass", "analysis_version"))
    got = {r.video_id: r.frame_idx for r in spark.read.parquet(str(tmp_path / "frames")).collect()}
    assert got == {"A": 5, "B": 1}
    assert {r.video_id: r.analysis_version for r in spark.read.parquet(str(tmp_path / "videos")).collect()} == {"A": 2, "B": 1}
    WR.append_corrections_log(videos, str(tmp_path / "log"))
    WR.append_corrections_log(videos, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4


def test_write_analysis_shares_folders(spark, tmp_path):
    """Many videos lie in a bounded number of folders; writing one leaves the others of its folder as they are."""
    frames = spark.range(600).selectExpr("cast(id as string) as video_id", "'first' as pass", "1 as frame_idx")
    WR.write_analysis(frames, frames.select("video_id", "pass"), str(tmp_path))
    again = frames.filter("video_id = '7'").withColumn("frame_idx", F.lit(5))
    WR.write_analysis(again, again.select("video_id", "pass"), str(tmp_path))
    got = {r.video_id: r.frame_idx for r in spark.read.parquet(str(tmp_path / "frames")).collect()}
    assert got == {str(i): 5 if i == 7 else 1 for i in range(600)}
    for table in ("frames", "videos"):
        assert len([f for f in (tmp_path / table).iterdir() if f.is_dir()]) <= 256


MARK = "video_id string, frame_idx int, phase string, timestamp_s double, source string, confidence double"


def test_markers(spark):
    m = spark.createDataFrame([("v", 10, "hop_1", 0.3, "auto", 0.5), ("v", 20, "hop_2", 0.6, "auto", 0.5)], MARK)
    new = spark.createDataFrame([("v", 20, "hop_1", 0.6, "manual", 1.0)], MARK)
    assert [(r.frame_idx, r.phase) for r in ED.add_markers(m, new).collect()] == [(20, "hop_1")]
    with pytest.raises(Exception, match="invalid phase"):
        ED.add_markers(m, new.withColumn("phase", F.lit("jump"))).collect()
    swap = spark.createDataFrame([("v", 10, 20)], "video_id string, from_idx int, to_idx int")
    got = {r.phase: (r.frame_idx, r.source) for r in ED.move_markers(m, swap).collect()}
    assert got == {"hop_1": (20, "manual"), "hop_2": (10, "manual")}


def test_phase_rules(spark):
    m = spark.createDataFrame([("v", 50, "approach", 0.0, "manual", 1.0), ("w", 30, "hop_1", 0.0, "manual", 1.0), ("w", 80, "final_jump", 0.0, "manual", 1.0)], MARK)
    last = spark.createDataFrame([("v", 100), ("w", 100)], "video_id string, last_frame_idx int")
    got = {(r.video_id, r.phase): (r.start_frame, r.end_frame) for r in K.phases_from_markers(m, last).collect()}
    assert got[("v", "approach")] == (0, 50) and got[("v", "hop_1")] == (None, None)
    assert got[("w", "approach")] == (0, 29) and got[("w", "hop_1")] == (30, 79) and got[("w", "final_jump")] == (80, 100)
    frames = spark.createDataFrame([("w", f) for f in (29, 30, 80, 200)], "video_id string, frame_idx int")
    phases = K.phases_from_markers(m, last)
    assert {r.frame_idx: r.phase for r in J.phase_at(frames, phases).collect()} == {29: "approach", 30: "hop_1", 80: "final_jump", 200: None}


def test_interpolation_ends_and_mismatch(spark):
    poly = "array<struct<x:double,y:double>>"
    k = spark.createDataFrame([("v", 10, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)], (0.0, 0.0, 1.0, 0.0)), ("v", 20, [(0.5, 0.5)], None)],
                              f"video_id string, frame_idx int, track_polygon {poly}, axis struct<ox:double,oy:double,dx:double,dy:double>")
    f = spark.createDataFrame([("v", x) for x in (0, 10, 15, 30)] + [("none", 1)], "video_id string, frame_idx int")
    got = {(r.video_id, r.frame_idx): r for r in J.bracket_interpolate(f, k).collect()}
    assert len(got[("v", 0)].track_polygon) == 3 and got[("v", 0)].kf_idx == 10
    assert len(got[("v", 15)].track_polygon) == 3 and got[("v", 15)].axis.dx == 1 and got[("v", 15)].kf_idx is None
    assert len(got[("v", 30)].track_polygon) == 1 and got[("none", 1)].track_polygon is None


def test_lengths_sum_to_corridor(spark):
    rows = [("v", i, float(i) * 0.3, i * 10, f"hop_{i + 1}" if i < 4 else "landing", float(s)) for i, s in enumerate((0, 110, 300, 420, 700))]
    c = spark.createDataFrame(rows, "video_id string, i int, timestamp_s double, frame_idx int, phase string, position_s double")
    point = "struct<x:double,y:double>"
    arrays = c.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct(
        "timestamp_s", "frame_idx", F.col("i").alias("index"), "phase", F.lit("hop").alias("type"), "position_s",
        F.lit(None).cast("struct<ox:double,oy:double,dx:double,dy:double>").alias("axis"), F.lit(None).cast(point).alias("foot"), F.lit(None).cast(point).alias("center")))).alias("contacts"))
    v = MT.slot_five_rule(MT.segments(arrays)).withColumns({
        "corridor_m": F.lit(10.0), "ov_hop_m": F.lit(None).cast("array<double>"), "ov_m_per_px": F.lit(None).cast("double"),
        "ov_scale": F.lit(None).cast("struct<known_distance_m:double,ax:double,ay:double,bx:double,by:double>"),
        "kf_scale": F.lit(None).cast("struct<known_distance_m:double,ax:double,ay:double,bx:double,by:double>")})
    r = MT.measured(MT.resolve_scale(v)).first()
    assert abs(sum(r.hop_m[:4]) - 10.0) < 1e-3 and r.total_hops_m == 10.0 and r.hop_px[4] == r.hop_px[3] and r.scale_source == "hops_corridor"
    assert [s.id for s in r.segments] == ["hop_1", "hop_2", "hop_3", "hop_4"]


def test_history_leaves_own_video_out(spark):
    rows = [("a", "v1", [0.5, None, 0.4, 0.6], [1.0] * 5, [2.0] * 4), ("a", "v2", [0.7, -1.0, 0.4], [2.0] * 5, [3.0] * 4)]
    s = spark.createDataFrame(rows, "athlete_id string, video_id string, intervals_s array<double>, lengths_m array<double>, speeds_m_s array<double>")
    b = {(r.video_id, r.segment): r for r in H.general_baseline(s, videos=s.select("video_id")).collect()}
    assert b[("v1", "hop_1")].dt_mean_s == 0.7 and b[("v1", "hop_2")].dt_mean_s is None and b[("v1", "hop_1")].limited
    gaps = spark.createDataFrame([("g", "hop_2", 0.9)], "video_id string, segment string, dt_s double")
    g = {r.segment: r for r in H.general_baseline(s, gaps).collect()}
    assert g["hop_2"].dt_mean_s == 0.9 and g["hop_1"].dt_mean_s == 0.6
    t = {(r.video_id, r.interval_index): r for r in H.timing_consistency(s, s).collect()}
    assert t[("v1", 0)].z == 0.0 and t[("v1", 0)].deviation == round(0.2 / 0.7, 3) and t[("v2", 2)].deviation == 0.0


def test_overrides(spark):
    m = "map<string,string>"
    df = spark.createDataFrame([({"total_length_m": "9", "notes": "x"}, {"hops_corridor_m": "12", "bad": "1", "m_per_px": None}, ["notes"])], f"o {m}, u {m}, c array<string>")
    assert df.select(ED.merge_overrides(F.col("o"), F.col("u"), F.col("c")).alias("r")).first().r == {"total_length_m": "12", "hops_corridor_m": "12"}


def test_negative_penalty_makes_its_histograms_once(spark):
    from strideflow.plans import registry

    registry.load()
    out = registry.QUERIES["a22_negative_penalty"](spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan  # the stored distances are read, not lineitem again for each side
    assert out.count() > 0
