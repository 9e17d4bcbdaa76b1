"""Chunked sequence operators against plain windows and brute force."""

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strideflow.operators import prominence
from strideflow.operators import sequence as q


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    data = []
    for video, n in enumerate((200, 37, 6)):
        for f in np.sort(rng.choice(400, size=n, replace=False)):
            value = float(np.round(rng.normal(), 1)) if rng.random() > 0.15 else None
            data.append((str(video), int(f), value, int(rng.integers(0, 5))))
    return spark.createDataFrame(data, "video_id string, frame_idx int, v double, sym int").cache()


@pytest.fixture(scope="module")
def series(rows):
    pdf = rows.filter("v is not null").toPandas()
    return {v: g.sort_values("frame_idx").reset_index(drop=True) for v, g in pdf.groupby("video_id")}


def test_scan_equals_plain_windows(rows):
    w = W.partitionBy("video_id").orderBy("frame_idx")
    whole = W.partitionBy("video_id")
    got = q.scan(
        rows, ["video_id"], ["frame_idx"], before={"b": F.col("v")}, through={"t": F.col("v")}, after={"a": F.col("v")},
        running={"r": F.col("sym")}, totals={"n": ("sum", F.lit(1)), "m": ("max", F.col("v"))}, chunk=7,
    )
    want = rows.select(
        "*", F.last("v", True).over(w.rowsBetween(W.unboundedPreceding, -1)).alias("b"),
        F.last("v", True).over(w.rowsBetween(W.unboundedPreceding, 0)).alias("t"),
        F.first("v", True).over(w.rowsBetween(1, W.unboundedFollowing)).alias("a"),
        F.sum("sym").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("r"),
        F.count(F.lit(1)).over(whole).alias("n"), F.max("v").over(whole).alias("m"),
    )
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def _greedy(frames, scores, gap):
    kept = []
    for _, f in sorted(zip(-np.asarray(scores, float), frames)):
        if all(abs(f - k) >= gap for k in kept):
            kept.append(f)
    return sorted(kept)


@pytest.mark.parametrize("gap, chunk", [(3, 6), (8, 16), (8, 4096), (1, 4)])
def test_min_gap_filter(rows, series, gap, chunk):
    got = q.min_gap_filter(rows.filter("v is not null"), "v", gap, chunk=chunk).toPandas()
    assert list(got.columns) == rows.columns and got.v.notna().all()
    for video, g in series.items():
        assert sorted(got[got.video_id == video].frame_idx) == _greedy(g.frame_idx, g.v, gap)


@pytest.mark.parametrize("gap", [3, 8])
def test_min_gap_filter_chains(spark, gap):
    """Runs in which each row waits for the next one, over many chunks, with holes and ties."""
    rng = np.random.default_rng(gap)
    frames = np.flatnonzero(rng.random(3000) > 0.03)
    shapes = {"up": frames * 1.0, "down": -frames * 1.0, "ties": np.zeros(len(frames)), "waves": np.abs(frames % 400 - 200.0), "noise": rng.integers(0, 30, len(frames)) * 1.0 + frames / 50}
    data = [(k, int(f), float(s)) for k, scores in shapes.items() for f, s in zip(frames, scores)]
    df = spark.createDataFrame(data, "video_id string, frame_idx int, s double").repartition(6)
    got = q.min_gap_filter(df, "s", gap, chunk=50).toPandas()
    for k, scores in shapes.items():
        assert sorted(got[got.video_id == k].frame_idx) == _greedy(frames, scores, gap)


def test_min_gap_filter_of_one_long_series(spark):
    df = spark.range(16_000).selectExpr("'a' AS video_id", "cast(id AS int) AS frame_idx", "cast(id AS double) AS s")
    got = sorted(r["frame_idx"] for r in q.min_gap_filter(df, "s", 8, chunk=1024).collect())
    assert got == list(range(15_999 % 8, 16_000, 8))


def test_min_gap_filter_null_scores_and_nothing(spark):
    df = spark.createDataFrame([("a", 5, None), ("a", 6, 1.0), ("a", 20, None), ("b", 0, 2.0)], "video_id string, frame_idx int, s double")
    assert sorted((r["video_id"], r["frame_idx"]) for r in q.min_gap_filter(df, "s", 3).collect()) == [("a", 6), ("a", 20), ("b", 0)]
    assert q.min_gap_filter(df.limit(0), "s", 3).collect() == []


def _smooth(x, window, degree):
    m, n = q.fit_matrix(window, degree), len(x)
    starts = [max(0, min(j - window // 2, n - window)) for j in range(n)]
    return np.array([m[j - s] @ x[s : s + window] for j, s in enumerate(starts)])


def test_fit_matrix_keeps_polynomials():
    x = np.arange(11.0)
    assert np.allclose(q.fit_matrix(11, 2) @ (3 * x**2 - x + 1), 3 * x**2 - x + 1)


def test_contact_signal(rows, series):
    got = q.contact_signal(rows, "v", chunk=32).toPandas()
    for video, g in series.items():
        x = g.v.to_numpy()
        odd = lambda k: min(len(x), k) - (1 - min(len(x), k) % 2)
        want = _smooth(x, odd(11), 2) - _smooth(x, odd(21), 3) if len(x) >= 5 else x
        mine = got[got.video_id == video].sort_values("frame_idx").signal.to_numpy()
        assert np.allclose(mine, want)


def test_contact_signal_short_series(spark):
    df = spark.createDataFrame([("a", i, float(i * i)) for i in range(4)], "video_id string, frame_idx int, foot_y double")
    assert [r.signal for r in q.contact_signal(df).orderBy("frame_idx").collect()] == [0.0, 1.0, 4.0, 9.0]


def _peaks(x):
    out, i, n = {}, 1, len(x)
    while i < n - 1:
        j = i
        if x[i - 1] < x[i]:
            while j < n - 1 and x[j + 1] == x[i]:
                j += 1
            if j < n - 1 and x[j + 1] < x[i]:
                p = (i + j) // 2
                bases = []
                for step in (-1, 1):
                    k, low = p, x[p]
                    while 0 <= k < n and x[k] <= x[p]:
                        low = min(low, x[k])
                        k += step
                    bases.append(low)
                out[p] = x[p] - max(bases)
        i = j + 1
    return out


@pytest.mark.parametrize("chunk, fan", [(3, 8), (5, 256), (4096, 256)])
def test_peaks(rows, series, chunk, fan):
    got = q.peaks(rows, "v", chunk=chunk, fan=fan).toPandas()
    for video, g in series.items():
        want = {int(g.frame_idx[k]): round(v, 6) for k, v in _peaks(g.v.to_numpy()).items()}
        mine = {int(r.frame_idx): round(r.prominence, 6) for r in got[got.video_id == video].itertuples()}
        assert mine == want


def test_peaks_of_levels_over_chunks(spark):
    series = {"flat": [1.0] * 40, "top": [0.0] * 7 + [2.0] * 30 + [1.0] * 5, "start": [3.0] * 20 + [1.0, 2.0, 1.0], "steps": [float(i // 9) for i in range(60)] + [0.0], "one": [1.0]}
    data = [(k, i, v) for k, x in series.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(data, "video_id string, frame_idx int, v double")
    got = {(r["video_id"], r["frame_idx"]): r["prominence"] for r in q.peaks(df, "v", chunk=4, fan=4).collect()}
    assert got == {(k, p): h for k, x in series.items() for p, h in _peaks(x).items()} and len(got) == 3


@pytest.mark.parametrize("kind", ["rising", "falling", "deep"])
def test_peaks_of_one_long_series(spark, kind):
    """All peaks look beyond their chunk; the far side is one chunk for many of them."""
    n = 120_000
    i = np.arange(n, dtype=float)
    v = {"rising": i + 3 * (i % 2), "falling": n - i + 3 * (i % 2), "deep": np.where(i % 2 == 0, -i, n - i)}[kind]
    v[-2] = 3 * n  # higher than all before it
    df = spark.range(n).selectExpr("'a' AS video_id", "cast(id AS int) AS frame_idx").withColumn(
        "v", F.when(F.col("frame_idx") == n - 2, 3.0 * n).otherwise(
            {"rising": F.col("frame_idx") + 3 * (F.col("frame_idx") % 2), "falling": n - F.col("frame_idx") + 3 * (F.col("frame_idx") % 2),
             "deep": F.when(F.col("frame_idx") % 2 == 0, -F.col("frame_idx")).otherwise(n - F.col("frame_idx"))}[kind].cast("double"))
    )
    got = {r["frame_idx"]: r["prominence"] for r in q.peaks(df, "v", chunk=512, fan=8).collect()}
    (left, _), (right, _) = prominence._walk(v), prominence._walk(v[::-1])
    at = 1 + np.flatnonzero((v[1:-1] > v[:-2]) & (v[1:-1] > v[2:]))
    assert got == dict(zip(at.tolist(), (v - np.maximum(left, right[::-1]))[at].tolist()))


@pytest.mark.parametrize("chunk", [4, 2048])
def test_state_machine(rows, chunk):
    table = np.random.default_rng(2).integers(0, 6, size=(5, 6))
    got = q.run_state_machine(rows, table, "sym", start=2, chunk=chunk).toPandas()
    for _, g in got.groupby("video_id"):
        state = 2
        for r in g.sort_values("frame_idx").itertuples():
            state = table[r.sym, state]
            assert state == r.state


def test_result_does_not_depend_on_partitions(spark, rows):
    first = q.peaks(rows.repartition(7), "v", chunk=16).collect()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        second = q.peaks(rows.orderBy(F.col("frame_idx").desc()), "v", chunk=16).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(first) == sorted(second)


def test_scan_over_rows_that_are_laid_out(spark):
    from pyspark.sql import functions as F
    from test_history import shuffled

    from strideflow.operators.sequence import lay_out, positions, scan

    rows = [(v, (i * 7) % 101, i % 4 or None, [float(i)]) for v in ("a", "b", None) for i in range(101 if v == "a" else 9)]
    df = spark.createDataFrame(rows, "k string, t int, x int, load array<double>")

    def both(df):
        df = positions(df, ["k"], ["t"], pos="p", count="n", chunk=16)
        return scan(df, ["k"], ["t"], before={"b": F.col("x") + F.col("p")}, after={"a": F.col("p")}, running={"s": F.coalesce("x", F.lit(0))}, totals={"m": ("max", F.col("p"))}, chunk=16)

    laid = both(lay_out(df, ["k"], ["t"], chunk=16))
    assert sorted(map(str, laid.drop("_chunk").collect())) == sorted(map(str, both(df).collect()))
    assert sum("load" in x for x in shuffled(laid)) == 1 and sum("load" in x for x in shuffled(both(df))) > 1
