"""Reference poses next to every asked pose compared with every sample."""

import random

import pytest

from strideflow.operators import groundtruth as GT


def plain(current, gt):
    out = {}
    for video, phase, vec in current:
        best = None
        for v, f, p, tag, w, angle, q in gt:
            for tier, pool in ((0, phase == p), (1, tag == "hop_contact")):
                if not pool:
                    continue
                d = sum((x - y) ** 2 for x, y in zip(vec, w)) ** 0.5 if vec is not None and w is not None else 0.0
                rank = (tier, int(v == video), -int(angle == "LATERAL"), -q, d, v, f)
                best = rank if best is None or rank < best else best
        if best is not None:
            out[video, phase] = (*best[5:], round(best[4], 9))
    return out


@pytest.mark.parametrize("videos", [1, 2, 9])
def test_blocks_find_the_closest_sample(spark, monkeypatch, videos):
    monkeypatch.setattr(GT, "POSE_BLOCK", 4)
    monkeypatch.setattr(GT, "SIDE", 2)
    rng = random.Random(videos)
    vec = lambda: None if rng.random() < 0.1 else [rng.randint(0, 2) / 2 for _ in range(14)]
    gt = [
        (f"v{rng.randrange(videos)}", i, rng.choice(["hop_1", "hop_2"]), rng.choice(["hop_contact", None]), vec(), rng.choice(["LATERAL", "FRONT"]), rng.choice([0.5, 1.0]))
        for i in range(60)
    ]
    current = [(f"v{v}", p, vec()) for v in range(videos + 1) for p in ("hop_1", "hop_2", "hop_3")]
    made = GT.reference_pose(
        spark.createDataFrame(current, "video_id string, phase string, vec array<double>"),
        spark.createDataFrame(gt, "video_id string, frame_idx int, phase string, pose_tag string, feature_vector array<double>, camera_angle string, quality_score double"),
    )
    assert {(r.video_id, r.phase): (r.ref_video, r.ref_frame, round(r.distance, 9)) for r in made.collect()} == plain(current, gt)


def test_no_pair_leaves_its_task(spark):
    """A pose meets the samples as blocks: rows of pairs would be sorted and spilled."""
    poses = spark.createDataFrame([("a", 1, "hop_1", "hop_contact", [0.5] * 14, "LATERAL", 1.0), ("b", 2, "hop_1", "hop_contact", [0.1] * 14, "LATERAL", 1.0)],
                                  "video_id string, frame_idx int, phase string, pose_tag string, feature_vector array<double>, camera_angle string, quality_score double")
    now = poses.selectExpr("video_id", "phase", "feature_vector as vec")
    assert "MapInArrow" in GT.reference_pose(now, poses)._jdf.queryExecution().executedPlan().toString()
