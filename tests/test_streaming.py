"""Upkeep of streaming results: state that ends, folders that are folded together."""

import datetime as dt
import os

import pytest

from strideflow.operators import venue as VN
from strideflow.streaming import jobs as JB


def pixels(spark, batch, n=60):
    rows = [(str(batch % 2), "track", float((i * 7 + batch) % 180), float(i % 256), float((i * 3) % 256)) for i in range(n)]
    return spark.createDataFrame(rows, "venue_id string, layer string, h double, s double, v double")


def test_folders_stay_flat_and_sums_exact(spark, tmp_path):
    path = str(tmp_path / "sums")
    write = JB.upsert_color_model(path, fold_after=5)
    every = None
    for batch in range(23):
        p = pixels(spark, batch)
        every = p if every is None else every.unionByName(p)
        write(p, batch)
        if batch in (3, 7, 9):  # a batch that comes again: before, after and right at a fold
            write(p, batch)
        assert sum(n.startswith(("batch=", "folded-")) for n in os.listdir(path)) <= 6
    got = {(r["venue_id"], r["layer"]): (r["sample_count"], r["mean"], r["std"]) for r in JB.read_color_model(spark, path).collect()}
    want = {(r["venue_id"], r["layer"]): (r["sample_count"], r["mean"], r["std"]) for r in VN.stats_from_moments(VN.color_moments(every)).collect()}
    assert got.keys() == want.keys()
    for k, (n, mean, std) in want.items():
        assert got[k][0] == n and got[k][1] == pytest.approx(mean) and got[k][2] == pytest.approx(std)


def test_a_fold_that_died_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "sums")
    write = JB.upsert_color_model(path, fold_after=100)
    for batch in range(4):
        write(pixels(spark, batch), batch)
    before = sorted(map(tuple, JB.read_color_model(spark, path).select("venue_id", "sample_count").collect()))
    pixels(spark, 9).write.parquet(f"{path}/folded-3")  # written, but nothing points to it
    assert sorted(map(tuple, JB.read_color_model(spark, path).select("venue_id", "sample_count").collect())) == before


def test_job_state_ends(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    kinds = "job_id string, event_time timestamp, status string, stage string, percent double, current_frame int, total_frames int, message string"

    def event(job, hours, percent, stage="run"):
        return (job, start + dt.timedelta(hours=hours), "running", stage, percent, 1, None, None)

    batches = [
        [event("a", 0, 10.0), event("a", 1, 30.0), event("b", 1, 5.0), event("a", 0.5, 20.0)],
        [event("b", 2, 50.0), event("b", 1.9, 49.0), event("c", 60, 1.0)],
        [event("c", 61, 2.0)],
        [event("d", 200, 1.0)],
        [event("d", 201, 2.0)],
    ]
    source, seen, sizes = tmp_path / "in", {}, []
    source.mkdir()
    stream = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(str(source))

    def upsert(batch, _):
        for r in batch.collect():
            seen[r["job_id"]] = (r["event_time"], r["percent"], r["message"])

    for rows in batches:
        spark.createDataFrame(rows, kinds).coalesce(1).write.mode("append").parquet(str(source))
        job = (
            JB.streaming_job_state(stream, keep="24 hours", delay="1 hour").writeStream.outputMode("update")
            .option("checkpointLocation", str(tmp_path / "state")).foreachBatch(upsert).trigger(availableNow=True).start()
        )
        job.awaitTermination()
        sizes.append(job.lastProgress["stateOperators"][0]["numRowsTotal"] if job.lastProgress else None)
    assert {k: v[1] for k, v in seen.items()} == {"a": 30.0, "b": 50.0, "c": 2.0, "d": 2.0}
    assert seen["a"][0] == start + dt.timedelta(hours=1) and seen["a"][2] is None
    assert sizes[-1] == 1  # of four jobs only the one still kept


def test_motion_lock_of_many_videos_shares_a_few_states(spark, tmp_path):
    import random

    from pyspark.sql import functions as F
    from strideflow.operators.candidates import motion_lock

    deal, start, kinds = random.Random(5), dt.datetime(2024, 1, 1), "video_id string, frame_idx int, det_id int, track_id int, x1 double, y1 double, x2 double, y2 double, event_time timestamp"
    rows = []
    for video in range(40):
        for frame in range(deal.choice([5, 12, 13, 40])):  # some videos have too few frames for a lock
            for det in range(3):
                x = float(deal.randrange(0, 60, 10))  # whole steps, so that tracks often move equally far
                wide = deal.choice([10.0, 100.0, 100.0])
                rows.append((f"v{video}", frame, det, deal.choice([0, 1, 2]), x, 0.0, x + wide, 100.0, start + dt.timedelta(seconds=frame / 30)))
    want = sorted(map(tuple, motion_lock(spark.createDataFrame(rows, kinds)).select("video_id", "athlete_track_id", "motion_px").collect()))
    deal.shuffle(rows)
    end = (None, 0, 0, 0, 0.0, 0.0, 1000.0, 1000.0, start + dt.timedelta(days=30))
    folder, third = str(tmp_path / "in"), len(rows) // 3
    for part in (rows[:third], rows[third : 2 * third], rows[2 * third :], [end]):
        spark.createDataFrame(part, kinds).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(folder)
    job = (
        JB.streaming_motion_lock(stream).writeStream.option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True).start(str(tmp_path / "out"), format="parquet")
    )
    job.awaitTermination()
    sizes = [s["numRowsTotal"] for p in job.recentProgress for s in p["stateOperators"]]
    got = spark.read.parquet(str(tmp_path / "out")).select("video_id", "athlete_track_id", "motion_px")
    assert sorted(map(tuple, got.collect())) == want and 5 < len(want) < 40
    buckets = spark.createDataFrame(rows, kinds).select(F.pmod(F.xxhash64("video_id"), F.lit(JB.LOCK_BUCKETS)).alias("b")).distinct().count()
    assert max(sizes) <= buckets + 1


def test_boxes_held_are_those_of_the_first_frames():
    import numpy as np
    import pandas as pd

    deal = np.random.default_rng(3)
    for _ in range(60):
        n, videos = 150, ["a", "b", "c"]
        frames = deal.integers(0, 40, n)
        at = frames * 10 + deal.integers(0, 120, n)  # frames do not come in the order of their time
        rows = pd.DataFrame({"video_id": deal.choice(videos, n), "at": at, "frame_idx": frames, "det_id": np.arange(n), "track_id": deal.integers(0, 3, n), "cx": deal.integers(0, 50, n) * 1.0})
        held, whole, given = JB._Videos(None), {}, {}
        for lo, mark in ((0, 0), (50, 60), (100, 150), (150, 300), (150, 1000)):
            late = rows[max(lo - 50, 0) : lo]
            late = late[late["at"] >= mark - 90]
            held = JB._Videos(held.kept())
            held.add(late)
            held.merge()
            for v, track, _px in held.lock(mark).itertuples(index=False):
                assert v not in given
                given[v] = int(track)
            for v in videos:  # all rows kept
                whole[v] = pd.concat([whole.get(v, rows[:0]), late[late["video_id"] == v]])
                passed = whole[v][whole[v]["at"] < mark]
                if passed["frame_idx"].nunique() >= 12 and ("done", v) not in whole:
                    whole[("done", v)] = True
                    first = np.unique(passed["frame_idx"])[:12]
                    early = passed[passed["frame_idx"].isin(first)].sort_values(["frame_idx", "det_id"], ignore_index=True).assign(owner=0)
                    want = JB._locked([v], early)
                    assert [given.get(v)] == (want["athlete_track_id"].tolist() or [None])
    steady = pd.DataFrame({"video_id": "a", "at": np.arange(500) * 33, "frame_idx": np.arange(500), "det_id": 1, "track_id": 0, "cx": 1.0})
    held = JB._Videos(None)
    held.add(steady.sample(frac=1, random_state=1))
    held.merge()
    assert held.rows["frame_idx"].tolist() == list(range(12))
