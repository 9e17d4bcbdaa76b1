"""Choices by learned looks against a plain walk that keeps its references in lists."""

import random
import statistics
from math import sqrt

import pytest
from pyspark.sql import functions as F

from strideflow.operators import appearance as AP
from strideflow.operators import candidates as CD
from strideflow.plans import candidate_queries as Q
from strideflow.plans import registry

SF = "/root/testdata/sf0.001"
WEIGHTS = {1: [1.0], 3: [0.10, 0.60, 0.30]}


def distance(a, b):
    """Sum over the zones of the weighted Bhattacharyya distance; half where a zone is empty."""
    total = 0.0
    for w, x, y in zip(WEIGHTS[len(a)], a, b):
        if sum(x) == 0 or sum(y) == 0:
            total += w * 0.5
        else:
            shared = sum(sqrt(p * q) for p, q in zip(x, y)) / sqrt(sum(x) * sum(y))
            total += w * sqrt(max(0.0, 1 - shared))
    return total


def unit(v):
    return min(1.0, max(0.0, v))


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    return w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h)


def similarity(mode, positives, negatives, look):
    if not positives:
        return 0.5
    if mode == "first":
        zones = [[statistics.fmean(r[0][i] for r in positives) for i in range(len(look[0]))]]
        return unit(1 - distance(zones, look))
    sim = unit(1 - statistics.median(distance(r, look) for r in positives))
    if negatives:
        sim *= min(1.0, max(0.4, 1 - 0.6 * unit(1 - min(distance(r, look) for r in negatives))))
    return sim


def walk(rows, mode, seeds=(), by_hand=frozenset(), lock=None, masks=True):
    """``rows``: candidates as dictionaries; one result per frame with a choice."""
    out, videos = {}, {}
    for r in rows:
        if (r["x2"] - r["x1"]) * (r["y2"] - r["y1"]) >= 4000:
            videos.setdefault(r["video_id"], {}).setdefault(r["frame_idx"], []).append(r)
    keep = 10 if mode == "first" else 20
    for video, frames in videos.items():
        positives = [s["histogram"] for s in seeds if s["video_id"] == video and s["positive"]]
        negatives = [s["histogram"] for s in seeds if s["video_id"] == video and not s["positive"]]
        boxes = []
        for n, frame in enumerate(sorted(frames)):
            options = sorted(frames[frame], key=lambda r: r["det_id"])
            place = 0.5 if len(frames) == 1 else n / (len(frames) - 1)
            zone = "landing" if place >= 0.9 else "mid" if place >= 0.3 else "early"
            sims = [similarity(mode, positives[-keep:], negatives[-15:], o["histogram"]) for o in options]
            late = mode == "v2" and zone == "landing"
            sand = 0.45 if late else 0.20
            scores = [s + (0.3 * o["track_ov"] + sand * o["sand_ov"] + (0.1 * o["sand_ov"] if late else 0)) * masks for s, o in zip(sims, options)]
            pick = None
            if mode == "first":
                track = [o["track_score"] for o in options]
                held = [i for i, o in enumerate(options) if o["track_id"] == (lock or {}).get(video)]
                looks = [s + 0.15 * (t or 0.0) for s, t in zip(sims, track)]
                if held:
                    pick = held[0]
                elif min(len(positives), keep) >= 2 and max(looks) >= 0.45:
                    pick = looks.index(max(looks))
                else:
                    area = [(o["x2"] - o["x1"]) * (o["y2"] - o["y1"]) for o in options]
                    known = [(-1e9 if t is None else t + a * 1e-6) for t, a in zip(track, area)] if any(t is not None for t in track) else area
                    pick = known.index(max(known))
            else:
                floor = (0.15 if masks else 0.18) if late else 0.20 if masks else 0.25
                able = [i for i, s in enumerate(sims) if s >= floor]
                if able:
                    final = dict.fromkeys(able, 0.0)
                    order = sorted((scores[i] for i in able), reverse=True)
                    close = len(order) > 1 and order[0] - order[1] <= 0.08
                    lean = 0.28 if late else 0.24 if close else 0.12
                    seen = (boxes[-4:] if late else boxes[-1:]) if mode == "v2" else []
                    for i in able:
                        o = options[i]
                        final[i] = scores[i] + lean * max((iou((o["x1"], o["y1"], o["x2"], o["y2"]), b) for b in seen), default=0.0)
                    pick = max(able, key=lambda i: (final[i], -i))
            manual = [i for i, o in enumerate(options) if (video, frame, o["det_id"]) in by_hand]
            pick = manual[0] if manual else pick
            if pick is None:
                continue
            o = options[pick]
            state = (min(len(positives), keep), min(len(negatives), 15))
            boxes.append((o["x1"], o["y1"], o["x2"], o["y2"]))
            learned = False
            if manual:
                positives += [o["histogram"]] * 3
                learned = True
            elif mode != "v2" or zone == "mid":
                conf, least = {"first": (0.60, None), "refined": (0.65, 0.50), "v2": (0.70, 0.55)}[mode]
                learned = o["conf"] >= conf and o["mask_area_px"] > 8000 and (least is None or sims[pick] >= least)
                if mode == "v2" and masks:
                    learned = learned and max(o["track_ov"], o["sand_ov"]) >= 0.25
                if learned:
                    positives.append(o["histogram"])
                if least is not None and sims[pick] > least:
                    negatives += [p["histogram"] for i, p in enumerate(options) if i != pick]
            positives, negatives = positives[-keep:], negatives[-15:]
            out[video, frame] = (o["det_id"], sims[pick], *state, state[0] >= 2, learned)
    return out


def compared(got, want):
    got = {(r["video_id"], r["frame_idx"]): (r["det_id"], r["similarity"], r["n_positives"], r["n_negatives"], r["ready"], r["learned"]) for r in got.collect()}
    assert got.keys() == want.keys()
    for key, w in want.items():
        g = got[key]
        assert (g[0], *g[2:]) == (w[0], *w[2:]) and g[1] == pytest.approx(w[1], abs=1e-7), key  # equal looks: sqrt(1 - 1 + rounding)
    return got


def listed(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def test_first_pass(spark):
    d = Q.looks(spark, SF).withColumn("histogram", F.slice("histogram", 2, 1)).withColumn("track_score", F.col("track_ov"))
    lock = {r["video_id"]: r["athlete_track_id"] for r in CD.motion_lock(d).collect()}
    got = compared(Q.e29_first(spark, SF), walk(listed(d), "first", lock=lock))
    assert any(g[2] > 5 for g in got.values()) and all(g[3] == 0 for g in got.values())


def test_refined_pass(spark):
    d = Q.looks(spark, SF)
    rows = listed(d)
    by_hand = {(r["video_id"], r["frame_idx"], r["det_id"]) for r in rows if r["conf"] > 0.99 and r["det_id"] == 1}
    got = compared(Q.e29_refined(spark, SF), walk(rows, "refined", listed(Q.seeds(spark, SF)), by_hand))
    assert by_hand and any(g[5] for g in got.values())


def test_second_pass(spark):
    got = compared(Q.e29_v2(spark, SF), walk(listed(Q.looks(spark, SF)), "v2", listed(Q.seeds(spark, SF))))
    assert any(g[5] for g in got.values()) and any(not g[5] for g in got.values())


@pytest.mark.parametrize("mode", ["refined", "v2"])
def test_without_masks_and_seeds(spark, mode):
    d = Q.looks(spark, SF)
    compared(AP.learned_choice(d, mode, masks=False), walk(listed(d), mode, masks=False))


def test_feedback_changes_later_choices(spark):
    """The seed alone would take the red one of the last frame; three orange ones learned before it turn the choice."""
    kind = "video_id string, frame_idx int, det_id int, track_id int, x1 double, y1 double, x2 double, y2 double, conf double, mask_area_px int, track_ov double, sand_ov double, histogram array<array<double>>"
    red, orange, blue = [[9.0, 1.0, 0.0]], [[5.0, 5.0, 0.0]], [[0.0, 4.0, 6.0]]
    look = lambda zone: zone * 3
    rows = [("v", f, d, d, 0.0, 0.0, 100.0, 100.0, 0.9, 9000, 0.0, 0.0, look(h)) for f, (a, b) in enumerate([(red, blue), (orange, blue), (blue, orange), (orange, blue), (orange, red)]) for d, h in enumerate((a, b))]
    seed = spark.createDataFrame([("v", 1, True, look(red))], "video_id string, seed_order int, positive boolean, histogram array<array<double>>")
    got = AP.learned_choice(spark.createDataFrame(rows, kind), "refined", seed).orderBy("frame_idx").collect()
    assert [r["det_id"] for r in got] == [0, 0, 1, 0, 0] and [r["n_positives"] for r in got] == [1, 2, 3, 4, 5] and [r["ready"] for r in got] == [False, True, True, True, True]
    assert [r["n_negatives"] for r in got] == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("mode, most", [("first", (10, 0)), ("refined", (20, 15)), ("v2", (20, 15))])
def test_full_sets_drop_the_oldest(spark, mode, most):
    draw = random.Random(4)
    kind = (
        "video_id string, frame_idx int, det_id int, track_id int, x1 double, y1 double, x2 double, y2 double, conf double, mask_area_px int, "
        "track_ov double, sand_ov double, track_score double, histogram array<array<double>>"
    )
    rows = []
    for video in ("a", "b"):
        for f in range(90):
            for d in range(draw.randint(1, 3)):
                x, y = draw.uniform(0, 900), draw.uniform(0, 400)
                shape = [[8, 1, 0, 0], [0, 1, 8, 2], [0, 0, 3, 8]][d]
                zones = [[v + draw.uniform(0, 0.6 + f / 90) for v in shape] for _ in range(1 if mode == "first" else 3)]
                rows.append((video, f, d, d, x, y, x + draw.uniform(60, 200), y + draw.uniform(70, 250), draw.uniform(0.5, 1), draw.randint(5000, 30000), draw.random(), draw.random() / 2, draw.random(), zones))
    seeds = [("a", 1, True, [[8.0, 1.0, 0.0, 0.0]] * (1 if mode == "first" else 3)), ("b", 1, True, [[8.0, 1.0, 0.0, 0.0]] * (1 if mode == "first" else 3))]
    seed = spark.createDataFrame(seeds, "video_id string, seed_order int, positive boolean, histogram array<array<double>>")
    d = spark.createDataFrame(rows, kind).repartition(5)
    got = compared(AP.learned_choice(d, mode, seed), walk(listed(d), mode, listed(seed)))
    assert max((g[2], g[3]) for g in got.values()) == most


def test_nothing(spark):
    empty = Q.looks(spark, SF).limit(0)
    assert AP.learned_choice(empty, "refined").collect() == [] and AP.negative_set(empty, empty.withColumn("zone", F.lit("mid"))).collect() == []


@pytest.mark.parametrize("name", ["e29_learned_first", "e29_learned_refined", "e29_learned_v2"])
def test_videos_side_by_side(spark, name):
    """Where a batch ends changes nothing, and the histograms are shuffled once."""
    make, size = registry.QUERIES[name], "spark.sql.execution.arrow.maxRecordsPerBatch"
    whole, before = {tuple(r) for r in make(spark, SF).collect()}, spark.conf.get(size)
    try:
        spark.conf.set(size, "7")
        cut = {tuple(r) for r in make(spark, SF).collect()}
    finally:
        spark.conf.set(size, before)
    rounded = [{tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows} for rows in (whole, cut)]
    assert whole and rounded[0] == rounded[1]
    plan = make(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" not in plan and plan.count("RepartitionByExpression") == 1
