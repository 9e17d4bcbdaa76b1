"""Streaming jobs over observations in arrival order.

State is kept per video (of the motion lock per bucket of videos): what waits for the watermark
(bounded by its delay) and a code, the boxes of the first frames, or a row of sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.geometry import has_box
from ..operators import venue as VN
from ..operators.candidates import LOCK_FRAMES, LOST_AFTER, large_enough, overlap_symbol, state_table
from ..schemas import STATES


class _Held:
    """Rows of one key that wait for the watermark; at most as many as arrive within its delay."""

    def __init__(self, state: GroupState, columns: list[str], empty: tuple):
        self.columns, self.rest = columns, empty
        kept = state.get if state.exists else ([], *([] for _ in columns), *empty)
        self.times, self.rows = list(kept[0]), pd.DataFrame(dict(zip(columns, kept[1:])))
        self.rest = tuple(kept[1 + len(columns) :])

    def add(self, batches: Iterator[pd.DataFrame]) -> None:
        for got in batches:
            self.times += [int(t.timestamp() * 1000) for t in got["event_time"]]
            self.rows = pd.concat([self.rows, got[self.columns]], ignore_index=True) if len(self.rows) else got[self.columns].reset_index(drop=True)

    def passed(self, watermark: int) -> pd.DataFrame:
        """Takes out the rows that the watermark has passed: nothing before them can arrive any more."""
        times = np.array(self.times, np.int64)
        done = times < watermark
        out, self.rows, self.times = self.rows[done], self.rows[~done].reset_index(drop=True), times[~done].tolist()
        return out

    def keep(self, state: GroupState, rest: tuple, idle_ms: int) -> None:
        """Stores what waits and wakes up when its first row is due; a key with nothing to do is kept for ``idle_ms``."""
        state.update((self.times, *(self.rows[c].tolist() if len(self.rows) else [] for c in self.columns), *rest))
        watermark = state.getCurrentWatermarkMs()
        state.setTimeoutTimestamp(max(min(self.times), watermark + 1) if self.times else watermark + idle_ms)


def streaming_athlete_state(frames: DataFrame, delay: str = "10 minutes", idle: str = "1 day") -> DataFrame:
    """athlete_state per frame, as :func:`athlete_state` gives it for the whole table.

    ``frames``: video_id, frame_idx, event_time, person_bbox, track_overlap, landing_overlap.  Frames wait
    in the state until the watermark (``delay`` behind the latest event) has passed them and are then
    handled in order, so neither file order nor batch size matters and no frame within the delay is lost.
    Of frames that arrive twice within the delay one counts.  A video's state is kept for ``idle`` of
    event time after its last frame.
    """
    symbol = overlap_symbol(has_box(F.col("person_bbox")), F.col("track_overlap"), F.col("landing_overlap"))
    rows = frames.withWatermark("event_time", delay).select("video_id", "frame_idx", "event_time", symbol.alias("symbol"))
    table, width = state_table(), LOST_AFTER + 2
    start, names, idle_ms = STATES.index("LOST") * width, list(STATES), int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState):
        if pd.isna(key[0]):  # rows of no video only move the watermark
            return
        held = _Held(state, ["frame_idx", "symbol"], (start,))
        (code,) = held.rest
        if not state.hasTimedOut:
            held.add(batches)
        elif not held.times:
            state.remove()
            return
        due = held.passed(state.getCurrentWatermarkMs()).drop_duplicates("frame_idx").sort_values("frame_idx")
        out = []
        for frame, sym in zip(due["frame_idx"], due["symbol"]):
            code = int(table[int(sym), code])
            out.append((key[0], int(frame), names[code // width]))
        held.keep(state, (code,), idle_ms)
        yield pd.DataFrame(out, columns=["video_id", "frame_idx", "athlete_state"])

    return rows.groupBy("video_id").applyInPandasWithState(
        step, "video_id string, frame_idx int, athlete_state string", "times array<long>, frames array<int>, symbols array<int>, code int", "append",
        GroupStateTimeout.EventTimeTimeout,
    )


#: Groups that the videos of :func:`streaming_motion_lock` are dealt to; fixed for the life of a checkpoint.
LOCK_BUCKETS = 1024
_LOCK_ROW = {"owner": "int", "at": "bigint", "frame_idx": "int", "det_id": "int", "track_id": "int", "cx": "double"}
_NONE = -(2**31)  # stands for null, which sorts first


def streaming_motion_lock(
    detections: DataFrame, delay: str = "10 minutes", idle: str = "1 day", buckets: int = LOCK_BUCKETS
) -> DataFrame:
    """The athlete's track id, once per video: :func:`motion_lock` on a stream.

    Boxes of at least the minimum area wait until the watermark has passed them; when twelve frames of a
    video have been passed, its lock is final and given out.  A video is remembered for ``idle`` of event
    time after its last detection, so it is locked once.

    Videos are dealt to ``buckets`` groups by a hash; the videos of a group share a state and are handled
    side by side, so a micro-batch costs a Python call a group and not a video.  Of a video only the boxes
    that can still be among its first twelve frames are held.
    """
    cx = ((F.col("x1") + F.col("x2")) / 2).alias("cx")
    rows = large_enough(detections.withWatermark("event_time", delay))
    rows = rows.select(
        F.pmod(F.xxhash64("video_id"), F.lit(buckets)).cast("int").alias("bucket"), "video_id", "event_time",
        F.unix_millis("event_time").alias("at"), *[F.coalesce(c, F.lit(_NONE)).cast("int").alias(c) for c in ("frame_idx", "det_id", "track_id")], cx,
    )
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState):
        videos = _Videos(state.get if state.exists else None)
        if not state.hasTimedOut:
            for got in batches:
                videos.add(got)
            videos.merge()
        watermark = state.getCurrentWatermarkMs()
        found = videos.lock(watermark)
        if len(found):
            yield found
        videos.forget(watermark - idle_ms)
        if not len(videos.names):
            if state.exists:
                state.remove()
            return
        state.update(videos.kept())
        state.setTimeoutTimestamp(max(videos.due(watermark, idle_ms), watermark + 1))

    waiting = ", ".join(f"{c} array<{k}>" for c, k in _LOCK_ROW.items())
    return rows.groupBy("bucket").applyInPandasWithState(
        step, "video_id string, athlete_track_id int, motion_px double", f"names array<string>, last array<bigint>, done array<boolean>, {waiting}",
        "append", GroupStateTimeout.EventTimeTimeout,
    )


class _Videos:
    """The videos of a bucket: name, time of the last detection, whether locked; and the boxes that wait, sorted."""

    def __init__(self, kept: tuple | None):
        names, last, done, *rows = kept or ([], [], [], *([] for _ in _LOCK_ROW))
        self.names, self.places = list(names), {v: i for i, v in enumerate(names)}
        self.last, self.done = np.array(last, np.int64), np.array(done, bool)
        kinds = {"int": np.int32, "bigint": np.int64, "double": np.float64}
        self.rows = {c: np.array(r, kinds[k]) for (c, k), r in zip(_LOCK_ROW.items(), rows)}
        self.fresh, self.pending = [], 0

    def add(self, got: pd.DataFrame) -> None:
        """Takes in boxes; those of no video only move the watermark."""
        got = got[got["video_id"].notna()]
        codes, seen = pd.factorize(got["video_id"])
        for v in seen:
            if v not in self.places:
                self.places[v] = len(self.names)
                self.names.append(v)
        new = len(self.names) - len(self.last)
        self.last = np.append(self.last, np.full(new, np.iinfo(np.int64).min))
        self.done = np.append(self.done, np.zeros(new, bool))
        owner = np.array([self.places[v] for v in seen], np.int32)[codes]
        at = got["at"].to_numpy(np.int64)
        np.maximum.at(self.last, owner, at)
        taken = ~self.done[owner]
        more = {"owner": owner[taken], **{c: got[c].to_numpy()[taken] for c in _LOCK_ROW if c != "owner"}}
        self.fresh.append(more)
        self.pending += len(more["owner"])
        if self.pending > len(self.rows["owner"]):  # sorted again when as many are new as wait, so a row is moved a few times only
            self.merge()

    def merge(self) -> None:
        self.rows = {c: np.concatenate([r, *(m[c].astype(r.dtype) for m in self.fresh)]) for c, r in self.rows.items()}
        self.fresh, self.pending = [], 0
        order = np.lexsort((self.rows["det_id"], self.rows["frame_idx"], self.rows["owner"]))
        self._take(order)
        self._prune()

    def _take(self, rows: np.ndarray) -> None:
        self.rows = {c: r[rows] for c, r in self.rows.items()}

    def _prune(self) -> None:
        """Drops boxes behind twelve earlier frames that the watermark passes no later: they are never among the first."""
        owner, at = self.rows["owner"], self.rows["at"]
        starts, rank = _frame_ranks(owner, self.rows["frame_idx"])
        if not len(starts) or rank.max() < LOCK_FRAMES:
            return
        first = rank[starts] < LOCK_FRAMES
        passed = np.full(len(self.names), np.iinfo(np.int64).min)
        np.maximum.at(passed, owner[starts][first], np.minimum.reduceat(at, starts)[first])
        self._take((rank < LOCK_FRAMES) | (at < passed[owner]))

    def lock(self, watermark: int) -> pd.DataFrame:
        """Locks the videos of which the watermark has passed twelve frames; their boxes are given up."""
        done = self.rows["at"] < watermark
        early = {c: r[done] for c, r in self.rows.items()}
        starts, rank = _frame_ranks(early["owner"], early["frame_idx"])
        ready = np.zeros(len(self.names), bool)
        ready[early["owner"][rank == LOCK_FRAMES - 1]] = True
        out = pd.DataFrame({c: r[ready[early["owner"]] & (rank < LOCK_FRAMES)] for c, r in early.items()})
        self.done |= ready
        self._take(~ready[self.rows["owner"]])
        return _locked(self.names, out)

    def forget(self, before: int) -> None:
        """Lets go of videos without detections since ``before``."""
        live = self.last >= before
        live[self.rows["owner"][self.rows["at"] >= before]] = True
        if live.all():
            return
        self._take(live[self.rows["owner"]])
        self.rows["owner"] = (np.cumsum(live) - 1).astype(np.int32)[self.rows["owner"]]
        self.names = [v for v, kept in zip(self.names, live) if kept]
        self.last, self.done = self.last[live], self.done[live]

    def due(self, watermark: int, idle_ms: int) -> int:
        """When there is something to do: the first box that waits is passed, or a video is forgotten."""
        waits = self.rows["at"][self.rows["at"] >= watermark]
        return min([int(self.last.min()) + idle_ms, *([int(waits.min())] if len(waits) else [])]) + 1

    def kept(self) -> tuple:
        return (self.names, self.last.tolist(), self.done.tolist(), *(r.tolist() for r in self.rows.values()))


def _frame_ranks(owner: np.ndarray, frame: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted rows the first row of each frame, and each row's frame counted within its owner from 0."""
    if not len(owner):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    fresh = np.append(True, owner[1:] != owner[:-1])
    turn = fresh | np.append(True, frame[1:] != frame[:-1])
    number = np.cumsum(turn) - 1
    return np.flatnonzero(turn), number - np.maximum.accumulate(np.where(fresh, number, 0))


def _locked(names: list[str], rows: pd.DataFrame) -> pd.DataFrame:
    """The track with the most motion of each video; of equal ones that which moved first.  ``rows`` are sorted."""
    track = [rows["owner"], rows["track_id"]]
    moved = rows.groupby(["owner", "track_id"])["cx"].diff().abs()
    places = pd.Series(np.arange(len(rows)), rows.index).where(moved.notna())
    sums = pd.DataFrame({"motion_px": moved.groupby(track).sum(min_count=1), "first": places.groupby(track).min()}).dropna().reset_index()
    best = sums.sort_values(["owner", "motion_px", "first"], ascending=[True, False, True]).drop_duplicates("owner")
    best = best[best["track_id"] != _NONE]
    return pd.DataFrame({
        "video_id": pd.Series([names[i] for i in best["owner"]], dtype=object), "athlete_track_id": best["track_id"].to_numpy(np.int32),
        "motion_px": best["motion_px"].to_numpy(np.float64),
    })


def streaming_video_summary(frames: DataFrame, window: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Summary per video and event-time window (no distinct track ids); final once the watermark has passed the window (append mode)."""
    seen = F.col("person_detected")
    q = F.when(seen, F.col("quality_score"))
    return (
        frames.withWatermark("event_time", delay)
        .groupBy("video_id", F.window("event_time", window).alias("window"))
        .agg(
            F.count(F.lit(1)).alias("total_frames_analyzed"), F.count(F.when(seen, 1)).alias("frames_with_person"),
            F.count(F.when(seen & F.col("usable_for_analysis"), 1)).alias("frames_usable"),
            F.round(F.avg(q), 3).alias("quality_mean"), F.min(q).alias("quality_min"), F.max(q).alias("quality_max"),
        )
    )


JOB_FIELDS = ("status", "stage", "percent", "current_frame", "total_frames", "message")


def streaming_job_state(events: DataFrame, keep: str = "7 days", delay: str = "10 minutes") -> DataFrame:
    """Latest progress of each job (use in update mode; a job's row is upserted by job_id).

    A job's state is kept until the watermark has passed its last event by ``keep``; then it ends, so the state
    holds the jobs of that time and not all there ever were.  An event that comes even later starts anew.
    """
    kept_ms = int(pd.Timedelta(keep).total_seconds() * 1000)
    kinds = {f.name: f.dataType.simpleString() for f in events.select(*JOB_FIELDS).schema.fields}
    timed = events.withColumn("event_time", F.col("event_time").cast("timestamp"))
    rows = timed.withWatermark("event_time", delay).select("job_id", "event_time", *JOB_FIELDS)

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get if state.exists else None
        news = False
        for batch in batches:
            times = batch["event_time"].astype("datetime64[us]").astype("int64").to_numpy()
            for at in np.argsort(times, kind="stable")[-1:]:
                if last is None or times[at] >= last[0]:
                    last, news = (int(times[at]), *(_plain(batch[f].iloc[at]) for f in JOB_FIELDS)), True
        if last is None:
            return
        state.update(last)
        state.setTimeoutTimestamp(max(last[0] // 1000 + kept_ms, state.getCurrentWatermarkMs() + 1))
        if news:
            yield pd.DataFrame([(key[0], pd.Timestamp(last[0], unit="us"), *last[1:])], columns=["job_id", "event_time", *JOB_FIELDS])

    fields = ", ".join(f"{n} {k}" for n, k in kinds.items())
    return rows.groupBy("job_id").applyInPandasWithState(
        step, f"job_id string, event_time timestamp, {fields}", f"at long, {fields}", "update", GroupStateTimeout.EventTimeTimeout
    )


def _plain(value):
    """A value that a state row takes: Python's own kinds, None for nothing."""
    if value is None or (isinstance(value, float) and np.isnan(value)):
        return None
    return value.item() if isinstance(value, np.generic) else value


def streaming_color_moments(pixels: DataFrame) -> DataFrame:
    """Colour sums per venue and layer (use in update or complete mode)."""
    return VN.color_moments(pixels)


#: Batches after which the stored sums are folded into one table.
FOLD_AFTER = 50


def upsert_color_model(path: str, fold_after: int = FOLD_AFTER):
    """``foreachBatch`` function: add a batch's sums to the stored ones.

    Each batch writes its own folder of sums, named by the batch id, so a repeated batch replaces itself and the
    totals stay exact.  After ``fold_after`` batches the folders are folded into one table; the file that names it
    is renamed into place, which readers see at once or not at all, and only then are the folded folders removed.
    So the number of folders stays flat, and a fold that dies half-way leaves everything as it was.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        upto, folded = _pointer(spark, path)
        if batch_id <= upto:  # a repeated batch that was folded already
            return
        VN.color_moments(batch).coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        loose = _loose(spark, path, upto)
        if len(loose) < fold_after:
            return
        table = f"{path}/folded-{batch_id}"
        _moments(spark, path).coalesce(1).write.mode("overwrite").parquet(table)
        _point(spark, path, batch_id, table)
        for old in [*(f"{path}/batch={b}" for b in loose), *([folded] if folded else [])]:
            _files(spark, old)[0].delete(_files(spark, old)[1], True)

    return write


def _files(spark, path: str):
    """Hadoop's file system of a path, and the path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _pointer(spark, path: str) -> tuple[int, str | None]:
    """The last folded batch and the table of what is folded."""
    system, at = _files(spark, f"{path}/folded")
    if not system.exists(at):
        return -1, None
    number, table = spark.read.text(f"{path}/folded").first()[0].split(" ", 1)
    return int(number), table


def _point(spark, path: str, batch_id: int, table: str) -> None:
    system, target = _files(spark, f"{path}/folded")
    fresh = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/folded.{batch_id}")
    out = system.create(fresh, True)
    out.write(bytearray(f"{batch_id} {table}\n".encode()))
    out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    overwrite = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fresh, target, overwrite)


def _loose(spark, path: str, upto: int) -> list[int]:
    """Batches that are not folded yet."""
    system, at = _files(spark, path)
    if not system.exists(at):
        return []
    names = [s.getPath().getName() for s in system.listStatus(at)]
    return sorted(n for n in (int(x.split("=")[1]) for x in names if x.startswith("batch=")) if n > upto)


def _moments(spark, path: str) -> DataFrame:
    upto, folded = _pointer(spark, path)
    tables = [*([folded] if folded else []), *(f"{path}/batch={b}" for b in _loose(spark, path, upto))]
    return VN.merge_moments(spark.read.parquet(*tables))


def read_color_model(spark, path: str) -> DataFrame:
    """Mean and deviation per venue and layer from all stored sums."""
    return VN.stats_from_moments(_moments(spark, path))
