"""Sequential choices against a plain walk over the frames."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strideflow.operators import candidates as CD
from strideflow.schemas import STATES


def detections(seed=3, videos=4, frames=40, most=4):
    rng = np.random.default_rng(seed)
    rows = []
    for v in range(videos):
        for f in range(frames):
            for d in range(int(rng.integers(0, most))):
                x, y = rng.uniform(0, 900), rng.uniform(0, 400)
                rows.append((str(v), f, d, int(rng.integers(0, 3)), x, y, x + rng.uniform(40, 200), y + rng.uniform(60, 250),
                             float(rng.uniform(0.3, 1)), int(rng.integers(0, 20000)), float(rng.uniform(0, 0.7)), float(rng.uniform(0, 0.6)), float(rng.uniform(0, 0.6))))
    cols = "video_id frame_idx det_id track_id x1 y1 x2 y2 conf mask_area_px appearance_sim track_ov sand_ov".split()
    return pd.DataFrame(rows, columns=cols)


SCHEMA = ("video_id string, frame_idx int, det_id int, track_id int, x1 double, y1 double, x2 double, y2 double, conf double, "
          "mask_area_px int, appearance_sim double, track_ov double, sand_ov double")


def overlap(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    return w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h)


def plain_choice(options, expected, z):
    """The gap rule word for word: (option, overlap) or None."""
    kept = []
    for o in options:
        box = [o["x1"], o["y1"], o["x2"], o["y2"]]
        sim, track, sand = o["sim"], o["track"], o["sand"]
        iou = overlap(box, expected) if expected else 0.0
        score = sim + 0.3 * track + (0.45 if z == "landing" else 0.2) * sand + 0.5 * iou + (0.1 * sand if z == "landing" else 0)
        far = False
        if expected:
            d = np.hypot(box[0] + box[2] - expected[0] - expected[2], box[1] + box[3] - expected[1] - expected[3]) / 2 / np.hypot(1280, 720)
            score += 0.18 * max(0, 1 - 4 * d) - (0.2 if iou < 0.05 and d > 0.12 else 0)
            far = iou < 0.08 and track < 0.15 and d > 0.08 and sim < 0.22
        floor = 0.04 if iou >= 0.22 or sand >= 0.25 or track >= 0.28 else 0.08
        fair = sim >= 0.04 and (iou >= 0.12 or track >= 0.18 or sand >= 0.25)
        if (sim >= floor or iou >= 0.2 or track >= 0.28 or fair) and not far:
            kept.append((score, iou, o))
    if not kept:
        return None
    top = max(kept, key=lambda k: k[0])
    sure = [k for k in kept if expected and k[1] >= 0.2]
    if sure and top[1] < 0.08:
        close = max(sure, key=lambda k: k[1])
        top = close if close[0] >= top[0] - 0.12 else top
    return top[2], top[1]


def zone(p):
    return "landing" if p >= 0.9 else ("mid" if p >= 0.3 else "early")


def test_athlete_state_against_plain_rules(spark):
    rng = np.random.default_rng(5)
    rows = [("a", i, [0.0, 0.0, 1.0, 1.0] if rng.random() > 0.4 else None, float(rng.choice([0.0, 0.1, 0.2, 0.6])), float(rng.choice([0, 0, 0, 0, 0, 0.3]))) for i in range(500)]
    df = spark.createDataFrame(rows, "video_id string, frame_idx int, person_bbox array<double>, track_overlap double, landing_overlap double")
    got = {r.frame_idx: r.athlete_state for r in CD.athlete_state(df, chunk=16).collect()}
    state, low = "LOST", 0
    for _, i, box, track, land in rows:
        if box is None:
            low += 1
            state = state if state in ("AIR", "FINAL_FLIGHT") and low < 10 else "LOST"
        elif land >= 0.25:
            state, low = "FINAL_FLIGHT", 0
        elif track >= 0.5:
            state, low = "GROUND", 0
        elif track >= 0.15:
            state, low = ("AIR" if state in ("AIR", "FINAL_FLIGHT") else "GROUND"), 0
        else:
            low += 1
            if state == "LOST":
                state = "LOST" if low >= 10 else "OFF_TRACK_NEAR"
            elif state != "FINAL_FLIGHT":
                state = "AIR" if low <= 10 else "OFF_TRACK_NEAR"
        assert got[i] == state, i
    assert set(got.values()) <= set(STATES)


@pytest.mark.parametrize("seed, count, most", [(3, 40, 4), (4, 160, 3), (5, 160, 2)])
def test_refine_v2_against_a_walk(spark, seed, count, most):
    pdf = detections(seed=seed, frames=count, most=most)
    df = spark.createDataFrame(pdf, SCHEMA)
    frames = spark.createDataFrame([(str(v), f) for v in range(4) for f in range(count)], "video_id string, frame_idx int")
    got = {(r.video_id, r.frame_idx): r.det_id for r in CD.refine_v2_select(frames, df).collect()}
    want = {}
    for v in map(str, range(4)):
        history = []
        for f in range(count):
            z = zone(f / (count - 1))
            land = z == "landing"
            options = []
            for r in pdf[(pdf.video_id == v) & (pdf.frame_idx == f)].sort_values("det_id").itertuples():
                if (r.x2 - r.x1) * (r.y2 - r.y1) < 4000 or r.appearance_sim < (0.15 if land else 0.20):
                    continue
                s = r.appearance_sim + 0.3 * r.track_ov + (0.45 if land else 0.2) * r.sand_ov + (0.1 * r.sand_ov if land else 0)
                options.append((s, [r.x1, r.y1, r.x2, r.y2], r.det_id))
            if not options:
                continue
            scores = [o[0] for o in options]
            if history:
                top = sorted(scores, reverse=True)
                gap = top[0] - top[1] if len(top) > 1 else 1.0
                w = 0.28 if land else (0.24 if gap <= 0.08 else 0.12)
                refs = history[-4:] if land else history[-1:]
                scores = [s + w * max(overlap(o[1], b) for b in refs) for s, o in zip(scores, options)]
            best = options[int(np.argmax(scores))]
            history.append(best[1])
            want[(v, f)] = best[2]
    assert got == want


@pytest.mark.parametrize("seed, count, most", [(9, 40, 4), (10, 160, 3), (11, 160, 2)])
def test_gap_fill_against_a_walk(spark, seed, count, most):
    pdf = detections(seed=seed, frames=count, most=most)
    rng = np.random.default_rng(1)
    frames = []
    for v in range(4):
        for f in range(count):
            seen = bool(rng.random() > 0.5)
            x, y = rng.uniform(0, 900), rng.uniform(0, 400)
            frames.append((str(v), f, seen, [x, y, x + 100, y + 150] if seen else None, float(rng.uniform(0.1, 0.9)), float(rng.uniform(0, 0.5))))
    df = spark.createDataFrame(frames, "video_id string, frame_idx int, person_detected boolean, person_bbox array<double>, quality_score double, appearance_sim double")
    got = {(r.video_id, r.frame_idx): (r.det_id, r.fill_action) for r in CD.gap_fill(df, spark.createDataFrame(pdf, SCHEMA)).collect()}
    want = {}
    for v in map(str, range(4)):
        rows = [list(r) for r in frames if r[0] == v]
        mid = [i for i in range(count) if zone(i / (count - 1)) == "mid" and rows[i][2]]

        def expect(i, backward):
            if backward and i + 1 < count and rows[i + 1][2]:
                return rows[i + 1][3]
            left = next((j for j in range(i - 1, -1, -1) if rows[j][2]), None)
            right = next((j for j in range(i + 1, count) if rows[j][2]), None)
            if left is None or right is None:
                j = right if left is None else left
                return None if j is None else rows[j][3]
            t = (i - left) / (right - left)
            return [a + (b - a) * t for a, b in zip(rows[left][3], rows[right][3])]

        walk = [(i, True) for i in range(mid[0] - 1, -1, -1)] + [(i, False) for i in range(mid[-1] + 1, count)]
        for i, backward in walk:
            z = zone(i / (count - 1))
            was = rows[i][2]
            if was and not (z == "early" and rows[i][4] < 0.35):
                continue
            expected = expect(i, backward)
            opts = [
                {"det_id": r.det_id, "x1": r.x1, "y1": r.y1, "x2": r.x2, "y2": r.y2, "sim": r.appearance_sim, "track": r.track_ov, "sand": r.sand_ov}
                for r in pdf[(pdf.video_id == v) & (pdf.frame_idx == i)].sort_values("det_id").itertuples() if (r.x2 - r.x1) * (r.y2 - r.y1) >= 600
            ]
            picked = plain_choice(opts, expected, z)
            if picked is None:
                continue
            c, iou = picked
            if was and z == "early" and c["sim"] + 0.05 < rows[i][5] and iou < 0.22:
                continue
            rows[i][2:4] = [True, [c["x1"], c["y1"], c["x2"], c["y2"]]]
            want[(v, i)] = (c["det_id"], "filled_late" if not backward else ("rescored_early" if was else "filled_early"))
    assert got == want


def test_fold_and_columns_choose_alike(spark):
    pdf = detections(seed=21)
    df = spark.createDataFrame(pdf, SCHEMA)
    exp = df.groupBy("video_id", "frame_idx").agg(F.min_by(CD.box_of(), "det_id").alias("expected")).withColumn("zone", F.lit("mid"))
    got = {(r.video_id, r.frame_idx): r.det_id for r in CD.choose_candidate(df, exp).collect()}
    want = {}
    for key, g in pdf.sort_values("det_id").groupby(["video_id", "frame_idx"]):
        first = g.iloc[0]
        opts = [
            {"det_id": r.det_id, "x1": r.x1, "y1": r.y1, "x2": r.x2, "y2": r.y2, "sim": r.appearance_sim, "track": r.track_ov, "sand": r.sand_ov}
            for r in g.itertuples() if (r.x2 - r.x1) * (r.y2 - r.y1) >= 600
        ]
        picked = plain_choice(opts, [first.x1, first.y1, first.x2, first.y2], "mid")
        if picked:
            want[key] = picked[0]["det_id"]
    assert got == want


def test_gap_fill_shuffles_detections_twice(spark):
    """Once to number them, where all that needs them by frame finds them, and once to the walks."""
    from test_history import shuffled

    from strideflow.plans import carriers as C
    from strideflow.plans.candidate_queries import primary

    SF = "/root/testdata/sf0.001"
    moved = shuffled(CD.gap_fill(primary(spark, SF), C.detections(spark, SF)))
    assert len({x for x in moved if "p:double" in x or "conf:double" in x}) == 2


@pytest.mark.parametrize("masks", [True, False])
def test_lone_candidates_of_frames_that_repeat_columns(spark, masks):
    """Runs cut at lone candidates on both sides of the middle, with detections without a number and frames without a video."""
    lone = [("v", f, 1, 0, 10.0 * f, 50.0, 10.0 * f + 60, 200.0, 0.9, 9000, 0.5, 0.5, 0.1) for f in range(40) if f % 5]
    extra = [("v", f, 2, 0, 10.0 * f + 300, 50.0, 10.0 * f + 360, 200.0, 0.9, 9000, 0.5, 0.5, 0.1) for f in range(40) if f % 3 == 0]
    frames = [("v", f, f in (18, 20), [10.0 * f, 50.0, 10.0 * f + 60, 200.0] if f in (18, 20) else None, 0.5, 0.5) for f in range(40)] + [(None, 3, False, None, 0.5, 0.5)]
    df = spark.createDataFrame(frames, "video_id string, frame_idx int, person_detected boolean, person_bbox array<double>, quality_score double, appearance_sim double")
    got = {r.frame_idx: (r.video_id, r.det_id, r.fill_action) for r in CD.gap_fill(df, spark.createDataFrame(lone + extra, SCHEMA), masks).collect()}
    want = {}
    for f in [f for f in range(40) if f < 18 or f > 20]:
        here = [d for d in lone + extra if d[1] == f]
        if here:  # the athlete moves ten pixels a frame, the other one is far from it
            want[f] = ("v", min(d[2] for d in here), "filled_early" if f < 18 else "filled_late")
    assert got == want
