"""History similarity against all pairs, one by one."""

import numpy as np
import pytest

from strideflow.operators import history as H


def plain(cur, past):
    out = {}
    for athlete, video, contact, vec in cur:
        sims = []
        for a, v, c, w in past:
            if (a, c) != (athlete, contact) or v == video or not vec or not w or len(vec) != len(w):
                continue
            n, m = np.linalg.norm(vec), np.linalg.norm(w)
            if n < 1e-9 or m < 1e-9:
                continue
            cos = float(np.dot(vec, w) / (n * m))
            sims.append(min(1.0, cos if cos >= 0 else (cos + 1) / 2))
        if sims:
            out[athlete, video, contact] = np.mean(sims)
    return out


@pytest.mark.parametrize("block, small", [(1024, 1 << 14), (16, 1 << 14), (16, 4)])
def test_all_pairs(spark, monkeypatch, block, small):
    monkeypatch.setattr(H, "POSE_BLOCK", block)
    monkeypatch.setattr(H, "SMALL_PAIRS", small)
    rng = np.random.default_rng(block)
    rows = []
    for athlete, n in (("a", 150), ("b", 5), ("c", 1)):
        for video in range(n):
            for contact in range(2):
                size = 14 if rng.random() > 0.15 else 5
                vec = rng.normal(size=size) + (1.0 if rng.random() > 0.5 else 0.0)
                vec = np.abs(vec) if rng.random() > 0.4 else vec
                rows.append((athlete, f"{athlete}{video}", contact, vec.tolist()))
    rows += [("a", "z0", 0, [0.0] * 14), ("a", "z1", 0, None), ("a", "z2", 0, []), ("b", "b0", 1, [-1.0] * 14)]
    kind = "athlete_id string, video_id string, contact_index int, vec array<double>"
    df = spark.createDataFrame(rows, kind).repartition(4)
    some = [r for r in rows if r[1] in ("a3", "a7", "b0", "z0") or r[0] == "c"] + [("a", "new", 1, rng.normal(size=14).tolist())]
    for current, want in ((df, rows), (spark.createDataFrame(some, kind), some)):
        got = {(r["athlete_id"], r["video_id"], r["contact_index"]): r["vs_history"] for r in H.history_similarity(current, df).collect() if r["vs_history"] is not None}
        # two poses of one contact in one take are one row of the result
        expected = plain([r for r in want if (r[1], r[2]) != ("b0", 1)], rows)
        assert {k for k in got if k[1:] != ("b0", 1)} == set(expected)
        assert all(got[k] == pytest.approx(v, abs=1e-9) for k, v in expected.items())


def test_history_never_goes_through_the_driver(spark):
    """Sizes are guessed far too small behind arrays, so no join may rest on a guess."""
    from strideflow.plans import registry

    registry.load()
    from strideflow.plans import carriers as C
    from strideflow.plans.metric_queries import history_templates

    SF = "/root/testdata/sf0.001"
    s = C.sessions(spark, SF)
    poses, templates = H.contact_poses(s), history_templates(spark, SF)
    for made in (H.pose_consistency(poses, poses, templates), H.timing_consistency(s, s), H.consistency(s, s, templates)):
        assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()


def test_comparison_with_the_baseline_meets_by_video_only(spark):
    from strideflow.operators import history as H

    nums = "array<double>"
    kinds = f"video_id string, athlete_id string, intervals_s {nums}, speeds_m_s {nums}, lengths_m {nums}"
    s = spark.createDataFrame([(str(i), "a", [0.5, None, 0.4 + i / 10, 0.3], [5.0, 6.0, None, 7.0], [2.0] * 4) for i in range(4)], kinds)
    segs = spark.createDataFrame(
        [("0", "hop_1", 0.5, 5.0, 2.0), ("0", "final", 0.3, None, 2.0), ("0", "hop_4", 0.6, 7.0, 2.0), ("1", "final", None, 7.7, None), ("2", "run_up", 1.0, 1.0, 1.0), ("9", "hop_1", 1.0, 1.0, 1.0)],
        "video_id string, id string, dt_s double, speed_m_s double, length_m double",
    )
    out = H.vs_general(segs, H.general_baseline(s, videos=s.select("video_id")))
    got = {(r.video_id, r.segment): (r.dt_s, r.speed_m_s, r.closeness, r.limited) for r in out.collect()}
    assert len(got) == 12 and {v for v, _ in got} == {"0", "1", "2"}  # video 3 has no segments, 9 no baseline
    assert got["0", "hop_1"] == (0.5, 5.0, 1.0, False) and got["0", "hop_4"] == (0.6, 7.0, 0.0, False)
    assert got["1", "hop_4"][:2] == (None, 7.7)
    assert got["2", "hop_1"][:2] == (None, None) and got["0", "hop_3"][:2] == (None, None)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") <= 4, plan  # own sums, totals, segments; no segment-wise or empty ground-truth join
    assert H.vs_general_overall(out).count() == 3


def shuffled(df):
    """Schemas of what the plan shuffles."""
    def walk(node):
        if "ShuffleExchange" in node.nodeName() or node.nodeName() == "Exchange":
            yield node.schema().simpleString()
        for i in range(node.children().size()):
            yield from walk(node.children().apply(i))

    plan = df._jdf.queryExecution().executedPlan()
    return [*walk(plan.initialPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan)]


def test_poses_and_intervals_are_shuffled_once(spark):
    """Neither checkpoints nor further shuffles: they took many times the tables' size on disk."""
    from strideflow.plans import registry

    registry.load()
    from strideflow.plans import carriers as C
    from strideflow.plans.metric_queries import history_templates

    SF = "/root/testdata/sf0.001"
    s = C.sessions(spark, SF)
    poses, templates = H.contact_poses(s), history_templates(spark, SF)
    for made in (H.pose_consistency(poses, poses, templates), H.timing_consistency(s, s)):
        assert sum("video_id" in x and "array<" in x for x in shuffled(made)) == 1
        assert sum("video_id" in x for x in shuffled(made)) == 1
    both = shuffled(H.consistency(s, s, templates))
    assert sum("video_id" in x and "array<" in x for x in both) == 2


@pytest.mark.parametrize("block, small, same", [(4096, 1 << 14, True), (4096, 4, True), (16, 1 << 14, True), (16, 4, False), (4096, 1 << 14, False)])
def test_pose_consistency_with_repeats_and_nulls(spark, monkeypatch, block, small, same):
    monkeypatch.setattr(H, "POSE_BLOCK", block)
    monkeypatch.setattr(H, "SMALL_PAIRS", small)
    monkeypatch.setattr(H, "PAIRS", 64)
    rng = np.random.default_rng(small)
    rows = []
    for athlete, n in (("a", 40), ("b", 6), (None, 30)):
        for video in range(n):
            for contact in (0, 1):
                vec = rng.normal(size=14 if rng.random() > 0.2 else 5) + 0.7
                rows.append((athlete, f"{athlete}{video}", contact, "hop_1" if contact == 0 else None, vec.tolist()))
    rows += [rows[0], rows[3], ("a", "a1", 0, "hop_1", None), ("a", "z", None, "hop_1", [1.0] * 14), ("b", "z", 0, "hop_1", [0.0] * 14), ("a", None, 0, "hop_1", [1.0] * 14), ("c", "z", 0, "hop_1", [1.0] * 14)]
    kind = "athlete_id string, video_id string, contact_index int, phase string, vec array<double>"
    history = spark.createDataFrame(rows, kind).repartition(3)
    asked = rows if same else [*rows[:7], *rows[-9:]]
    templates = [("a", "phase", "hop_1", rng.normal(size=14).tolist()), ("a", "phase", "hop_1", rng.normal(size=14).tolist()), ("a", "tag", "hop_contact", rng.normal(size=14).tolist()),
                 ("a", "tag", "other", [1.0] * 14), ("b", "tag", "hop_contact", rng.normal(size=5).tolist()), (None, "tag", "hop_contact", [1.0] * 14)]
    current = history if same else spark.createDataFrame(asked, kind)
    out = H.pose_consistency(current, history, spark.createDataFrame(templates, "athlete_id string, kind string, key string, centroid array<double>"))

    def fold(u, w):
        if not u or not w or len(u) != len(w) or min(np.linalg.norm(u), np.linalg.norm(w)) < 1e-9:
            return None
        cos = float(np.dot(u, w) / (np.linalg.norm(u) * np.linalg.norm(w)))
        return min(1.0, cos if cos >= 0 else (cos + 1) / 2)

    want = []
    for athlete, video, contact, phase, vec in asked:
        takes = [r[4] for r in asked if r[:3] == (athlete, video, contact)]
        others = [r[4] for r in rows if r[0] == athlete and r[2] == contact and r[1] != video]
        sims = [x for t in takes for o in others if (x := fold(t, o)) is not None]
        past = float(np.mean(sims)) if sims and None not in (athlete, video, contact) else None
        mine = [c for a, k, key, c in templates if athlete and a == athlete and k == "phase" and key == phase] or [None]
        tags = [c for a, k, key, c in templates if athlete and a == athlete and k == "tag" and key == "hop_contact"] or [None]
        for own in (fold(vec, p or t) for p in mine for t in tags):
            known = [x for x in (own, past) if x is not None]
            want.append((athlete, video, contact, phase, own, past, float(np.mean(known)) if known else None))
    plain = lambda x, n: "-" if x is None else f"{round(x, n) + 0.0:.{n}f}"
    got = sorted((str(r.athlete_id), str(r.video_id), str(r.contact_index), str(r.phase), plain(r.vs_template, 3), plain(r.vs_history, 3), plain(r.score, 7)) for r in out.collect())
    assert got == sorted((*map(str, r[:4]), plain(r[4], 3), plain(r[5], 3), plain(r[6], 7)) for r in want)
