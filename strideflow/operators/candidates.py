"""Choosing the athlete among the detected persons of each frame."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as G
from ..functions import scores as S
from ..schemas import STATES, USABLE_ANGLES
from .chunks import arrow_schema, framed, lines_of, padded, side_by_side
from .sequence import lay_out, positions, progress, run_state_machine, scan, share

# Limits of the trackers.
LOCK_FRAMES = 12
MIN_AREA, MIN_AREA_GAP = 4000.0, 600.0
HIGH, LOW, LANDING = 0.5, 0.15, 0.25
LOST_AFTER = 10
WIDTH, HEIGHT = 1280.0, 720.0  # of a video whose size is not known
# Gap filling.
IOU_WEIGHT, NEAR_WEIGHT, LOST_COST, TIE = 0.50, 0.18, 0.20, 0.12
SURE_IOU, FAIR_IOU, FAR_IOU, LOST_IOU = 0.20, 0.12, 0.08, 0.05
FAR_DIST, LOST_DIST = 0.08, 0.12


def box_of(prefix: str = "") -> Column:
    return F.array(*[F.col(f"{prefix}{k}") for k in ("x1", "y1", "x2", "y2")])


def large_enough(detections: DataFrame, min_area: float = MIN_AREA) -> DataFrame:
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    return detections.filter(area >= min_area)


# ------------------------------------------------------------ motion lock

def displacement(detections: DataFrame, frames: int = LOCK_FRAMES) -> DataFrame:
    """Total horizontal motion of each track over the first frames with detections.

    The rank filter keeps twelve frames per video before anything is shuffled.
    """
    d = large_enough(detections).select(
        "video_id", "frame_idx", "det_id", "track_id", ((F.col("x1") + F.col("x2")) / 2).alias("cx")
    )
    first = Window.partitionBy("video_id").orderBy("frame_idx")
    early = d.withColumn("_r", F.dense_rank().over(first)).filter(F.col("_r") <= frames)
    track = Window.partitionBy("video_id", "track_id").orderBy("frame_idx", "det_id")
    moved = early.withColumn("_d", F.abs(F.col("cx") - F.lag("cx").over(track)))
    return moved.groupBy("video_id", "track_id").agg(
        F.coalesce(F.sum("_d"), F.lit(0.0)).alias("motion_px"), F.count("_d").alias("_moves"),
        F.max("_r").alias("_last"), F.min(F.when(F.col("_d").isNotNull(), F.struct("frame_idx", "det_id"))).alias("_first"),
    )


def motion_lock(detections: DataFrame, frames: int = LOCK_FRAMES) -> DataFrame:
    """The athlete's track: most motion in the first twelve frames; none before that."""
    moves = displacement(detections, frames)
    best = moves.groupBy("video_id").agg(
        F.max(F.col("_last")).alias("_n"),
        F.min_by("track_id", F.when(F.col("_moves") > 0, F.struct((-F.col("motion_px")).alias("m"), "_first"))).alias("athlete_track_id"),
        F.max(F.when(F.col("_moves") > 0, F.col("motion_px"))).alias("motion_px"),
    )
    return best.filter((F.col("_n") >= frames) & F.col("athlete_track_id").isNotNull()).drop("_n")


# ------------------------------------------------------------ choices per frame

def _pack() -> Column:
    return F.struct(
        "det_id", "track_id", "x1", "y1", "x2", "y2", "conf", "mask_area_px", "appearance_sim", "track_ov", "sand_ov"
    )


def choose_first_pass(detections: DataFrame, lock: DataFrame, appearance_ready: Column | None = None) -> DataFrame:
    """Locked track, else appearance + 0.15 track score >= 0.45, else track score,
    else the largest box.  ``detections`` may carry ``track_score``."""
    ready = F.lit(True) if appearance_ready is None else appearance_ready
    d = large_enough(detections)
    if "track_score" not in d.columns:
        d = d.withColumn("track_score", F.lit(None).cast("double"))
    d = d.join(lock.select("video_id", "athlete_track_id"), "video_id", "left")
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    look = F.col("appearance_sim") + 0.15 * F.coalesce("track_score", F.lit(0.0))
    first = -F.col("det_id")

    def best(key, condition=None):
        rank = F.struct(key.alias("k"), first.alias("d"))
        return F.max_by(_pack(), rank if condition is None else F.when(condition, rank))

    exact = F.col("track_id") == F.col("athlete_track_id")
    agg = d.groupBy("video_id", "frame_idx").agg(
        best(F.lit(0), exact).alias("_exact"),
        best(look, ready & (look >= 0.45)).alias("_look"),
        best(F.col("track_score") + area * 1e-6, F.col("track_score").isNotNull()).alias("_track"),
        best(area).alias("_area"),
    )
    tiers = [("_exact", "track"), ("_look", "appearance"), ("_track", "track_score"), ("_area", "area")]
    picked = F.coalesce(
        *[F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("b"), F.lit(n).alias("rule"))) for c, n in tiers]
    )
    return agg.select("video_id", "frame_idx", picked.alias("p")).select("video_id", "frame_idx", "p.rule", "p.b.*")


def choose_refined(detections: DataFrame, masks: bool = True) -> DataFrame:
    """Best blended score among the detections that look enough like the athlete."""
    d = large_enough(detections).filter(F.col("appearance_sim") >= (0.20 if masks else 0.25))
    sim = F.col("appearance_sim")
    score = S.blend_mask_score(sim, F.col("track_ov"), F.col("sand_ov")) if masks else sim
    best = d.groupBy("video_id", "frame_idx").agg(
        F.max_by(_pack(), F.struct(score, -F.col("det_id"))).alias("b"), F.max(score).alias("score")
    )
    return best.select("video_id", "frame_idx", "score", "b.*")


def diagonal(rows: DataFrame) -> Column:
    """Diagonal of the video's frames: ``width`` and ``height`` where the rows carry them."""
    width, height = (F.coalesce(F.col(c), F.lit(d)) if c in rows.columns else F.lit(d) for c, d in (("width", WIDTH), ("height", HEIGHT)))
    return F.hypot(width, height)


def gap_terms(masks: bool = True) -> dict[str, Column]:
    """What a gap candidate brings along before its place is compared with the expected one.

    ``_base``: score without place; ``_need``: overlap with the expected box that it needs to be accepted
    (none where its look or its masks suffice); ``_weak``: not to be taken far from the expected box.
    """
    sim = F.col("appearance_sim")
    track, sand = (F.col("track_ov"), F.col("sand_ov")) if masks else (F.lit(0.0), F.lit(0.0))
    landing = F.col("zone") == "landing"
    base = S.blend_mask_score(sim, track, sand, F.when(landing, 0.45).otherwise(0.20)) + F.when(landing & (sand > 0), 0.10 * sand).otherwise(0.0)
    enough = (sim >= 0.08) | (track >= 0.28) | ((sim >= 0.04) & ((track >= 0.18) | (sand >= LANDING)))
    need = F.when(enough, 0.0).when(sim >= 0.04, FAIR_IOU).otherwise(SURE_IOU)
    return {"_base": base, "_need": need, "_weak": (track < LOW) & (sim < 0.22)}


def choose_candidate(detections: DataFrame, expected: DataFrame, masks: bool = True) -> DataFrame:
    """Gap-fill choice: appearance and overlaps plus closeness to the expected box.

    ``expected``: video_id, frame_idx, zone, expected (ARRAY or null).
    """
    d = large_enough(detections, MIN_AREA_GAP).join(expected, ["video_id", "frame_idx"])
    e, box = F.col("expected"), box_of()
    dist = F.hypot((box[0] + box[2]) / 2 - (e[0] + e[2]) / 2, (box[1] + box[3]) / 2 - (e[1] + e[3]) / 2) / diagonal(d)
    d = d.withColumns({**gap_terms(masks), "_iou": G.box_iou(box, e), "_dist": F.coalesce(dist, F.lit(0.0))})
    iou, dist, known = F.col("_iou"), F.col("_dist"), e.isNotNull()
    lost = F.when((iou < LOST_IOU) & (dist > LOST_DIST), LOST_COST).otherwise(0.0)
    pull = F.when(known, NEAR_WEIGHT * F.greatest(F.lit(0.0), 1.0 - dist * 4.0) - lost).otherwise(0.0)
    far = known & F.col("_weak") & (iou < FAR_IOU) & (dist > FAR_DIST)
    ok = d.withColumn("_score", F.col("_base") + IOU_WEIGHT * iou + pull).filter((iou >= F.col("_need")) & ~far)
    item = F.struct(_pack().alias("b"), F.col("_score").alias("score"), F.col("_iou").alias("iou"))
    agg = ok.groupBy("video_id", "frame_idx").agg(
        F.max_by(item, F.struct("_score", -F.col("det_id"))).alias("_top"),
        F.max_by(item, F.when(known & (iou >= SURE_IOU), F.struct("_iou", "_score", -F.col("det_id")))).alias("_near"),
    )
    swap = F.col("_near").isNotNull() & (F.col("_top.iou") < FAR_IOU) & (F.col("_near.score") >= F.col("_top.score") - TIE)
    return agg.select("video_id", "frame_idx", F.when(swap, F.col("_near")).otherwise(F.col("_top")).alias("p")).select(
        "video_id", "frame_idx", "p.score", "p.iou", "p.b.*"
    )


# ------------------------------------------------------------ prediction and state

def predict_box(frames: DataFrame) -> DataFrame:
    """Add ``predicted``: the box expected from the two boxes seen before the frame.

    The foot point moves on at constant speed; the size is that of the older box.
    """
    box = F.col("person_bbox")
    seen = F.when(
        G.has_box(box),
        F.struct(F.col("frame_idx").alias("f"), ((box[0] + box[2]) * 0.5).alias("x"), box[3].alias("y"),
                 (box[2] - box[0]).alias("w"), (box[3] - box[1]).alias("h")),
    )
    keys = ["video_id"]
    linked = scan(frames.withColumn("_seen", seen), keys, ["frame_idx"], before={"_p": F.col("_seen")})
    chained = linked.withColumn("_pair", F.when(F.col("_seen").isNotNull(), F.struct(F.col("_seen").alias("b"), F.col("_p").alias("a"))))
    out = scan(chained, keys, ["frame_idx"], before={"_last": F.col("_pair")})
    a, b = F.col("_last.a"), F.col("_last.b")
    dt = b["f"] - a["f"]
    ahead = (F.col("frame_idx") - b["f"]) / dt
    guess = G.box_grown(b["x"] + (b["x"] - a["x"]) * ahead, b["y"] + (b["y"] - a["y"]) * ahead, a["w"], a["h"])
    return out.withColumn("predicted", F.when(dt > 0, guess)).drop("_seen", "_p", "_pair", "_last")


def state_table() -> np.ndarray:
    """Next code for (symbol, code); code = state * (LOST_AFTER + 2) + counter.

    Symbols: no box, landing zone, high, middle, low overlap.  The counter only
    ever matters up to one past its limit, so it stops there.
    """
    ground, air, off, flight, lost = range(len(STATES))
    width = LOST_AFTER + 2
    table = np.zeros((5, len(STATES) * width), dtype=int)
    for state in range(len(STATES)):
        for count in range(width):
            more = min(count + 1, LOST_AFTER + 1)
            airborne = state in (air, flight)
            absent = lost if more >= LOST_AFTER or not airborne else state
            if state == flight:
                low = flight
            elif state == lost:
                low = lost if more >= LOST_AFTER else off
            else:
                low = air if more <= LOST_AFTER else off
            after = [(absent, more), (flight, 0), (ground, 0), (air if airborne else ground, 0), (low, more)]
            for symbol, (nxt, n) in enumerate(after):
                table[symbol, state * width + count] = nxt * width + n
    return table


def overlap_symbol(has_box: Column, track: Column, landing: Column) -> Column:
    return (
        F.when(~has_box, 0).when(landing >= LANDING, 1).when(track >= HIGH, 2).when(track >= LOW, 3).otherwise(4)
    )


def athlete_state(frames: DataFrame, chunk: int = 2048) -> DataFrame:
    """Add ``athlete_state`` from box presence, track_overlap and landing_overlap."""
    symbol = overlap_symbol(G.has_box(F.col("person_bbox")), F.col("track_overlap"), F.col("landing_overlap"))
    width = LOST_AFTER + 2
    coded = run_state_machine(
        frames.withColumn("_symbol", symbol), state_table(), "_symbol",
        start=STATES.index("LOST") * width, out="_code", chunk=chunk,
    )
    names = F.array(*[F.lit(s) for s in STATES])
    return coded.withColumn(
        "athlete_state", F.get(names, F.floor(F.col("_code") / width).cast("int"))
    ).drop("_symbol", "_code")


def candidate_score(detections: DataFrame, state: DataFrame, height: float = HEIGHT) -> DataFrame:
    """Add ``track_score``: how much a detection behaves like the athlete.

    ``state``: video_id, frame_idx, prev_state (state after the frame before)
    and predicted (box or null), and the frame's ``height`` where it is known.
    ``detections`` carries motion_px.
    """
    tall = F.coalesce(F.col("height"), F.lit(height)) if "height" in state.columns else F.lit(height)
    known = state.select("video_id", "frame_idx", "prev_state", "predicted", F.greatest(tall * 0.15, F.lit(1.0)).alias("_near"))
    d = detections.join(known, ["video_id", "frame_idx"], "left")
    track, sand, sim, motion = (F.col(c) for c in ("track_ov", "sand_ov", "appearance_sim", "motion_px"))
    p, box = F.col("predicted"), box_of()
    dist = F.hypot((p[0] + p[2]) / 2 - (box[0] + box[2]) / 2, (p[1] + p[3]) / 2 - (box[1] + box[3]) / 2)
    near = F.when(p.isNotNull(), F.greatest(F.lit(0.0), 1.5 - dist / F.col("_near"))).otherwise(0.0)
    flying = sim * 1.2 + near
    walking = track * 0.8 + sim * 0.5 + F.when(motion > 3, F.least(motion / 200.0, F.lit(0.5))).otherwise(0.0)
    score = (
        F.when((track > HIGH) & (motion > 5), 2.0 + track).otherwise(0.0)
        + F.when(sand >= LANDING, 1.5 + sand).otherwise(0.0)
        + F.when(F.coalesce(F.col("prev_state").isin("AIR", "FINAL_FLIGHT"), F.lit(False)), flying).otherwise(walking)
    )
    return d.withColumn("track_score", score).drop("prev_state", "predicted", "_near")


def previous_state(frames: DataFrame) -> DataFrame:
    """State after the frame before, for :func:`candidate_score` (LOST at the start)."""
    out = scan(frames, ["video_id"], ["frame_idx"], before={"prev_state": F.col("athlete_state")})
    return out.withColumn("prev_state", F.coalesce("prev_state", F.lit("LOST")))


def expected_box(frames: DataFrame, backward: bool = False) -> DataFrame:
    """Add ``expected``: blended from the nearest known boxes on both sides.

    The backward variant takes the next frame's box when it is known.
    """
    known = F.coalesce(F.col("person_detected"), F.lit(False)) & G.has_box(F.col("person_bbox"))
    placed = positions(frames, ["video_id"], ["frame_idx"], pos="_pos", count="_n")
    mark = F.when(known, F.struct(F.col("_pos").alias("p"), F.col("person_bbox").alias("b")))
    both = scan(placed, ["video_id"], ["frame_idx"], before={"_l": mark}, after={"_r": mark})
    l, r = F.col("_l"), F.col("_r")
    t = (F.col("_pos") - l["p"]) / (r["p"] - l["p"])
    blend = F.when(l.isNull(), r["b"]).when(r.isNull(), l["b"]).otherwise(G.box_lerp(l["b"], r["b"], t))
    if backward:
        blend = F.when(r["p"] == F.col("_pos") + 1, r["b"]).otherwise(blend)
    return both.withColumn("expected", blend).drop("_pos", "_n", "_l", "_r")


# ------------------------------------------------------------ seeds and references

def select_seeds(
    frames: DataFrame, n: int = 15, interval: tuple[int, int] | None = None, v2: bool = False
) -> DataFrame:
    """Up to ``n`` seed frames per video with their rank.

    Good frames first (quality >= 0.65 at a usable angle), inside the interval
    before outside; a video without candidates falls back to any detection.
    With ``v2`` corrected frames lead and the middle of the video is preferred.
    """
    f = frames.filter(F.coalesce("person_detected", F.lit(False)))
    good = (F.col("quality_score") >= 0.65) & F.col("camera_angle").isin(*USABLE_ANGLES)
    good = F.coalesce(good, F.lit(False))
    if interval is not None and interval[1] > interval[0]:
        inside = F.col("frame_idx").between(*interval)
        tier = F.when(good & inside, 0).when(inside, 1).when(good, 2)
    else:
        tier = F.when(good, 0)
    manual = F.coalesce("manually_corrected", F.lit(False))
    if v2:
        span = frames.groupBy("video_id").agg(F.min("frame_idx").alias("_a"), F.max("frame_idx").alias("_b"))
        f = f.join(span, "video_id")
        width = F.greatest(F.col("_b") - F.col("_a"), F.lit(1))
        mid = F.col("frame_idx").between(
            F.col("_a") + F.floor(width * 0.30), F.col("_a") + F.floor(width * 0.90)
        )
        tier = F.when(manual, -1).otherwise(tier)
        order = [F.when(manual, F.col("frame_idx")).otherwise(0), (~manual).cast("int"), (~mid).cast("int")]
    else:
        order = []
    f = f.withColumn("_tier", tier)
    order = [F.col("_tier").asc_nulls_last(), *order, F.col("quality_score").desc(), F.col("frame_idx")]
    w = Window.partitionBy("video_id").orderBy(*order)
    top = f.withColumn("seed_rank", F.row_number().over(w)).filter(F.col("seed_rank") <= n)
    # The fallback counts only where not a single frame got a tier.
    some = f.groupBy("video_id").agg(F.count("_tier").alias("_some"))
    return top.join(some, "video_id").filter((F.col("_some") == 0) | F.col("_tier").isNotNull()).drop(
        "_tier", "_some", "_a", "_b"
    )


def reference_set(chosen: DataFrame, mode: str = "refined") -> DataFrame:
    """The references the appearance model holds at the end: gates, then the newest.

    ``first``: 10 with conf >= 0.60, mask > 8000; ``refined``: 20 with conf >=
    0.65, mask > 8000, sim >= 0.50; ``v2``: mid zone, conf >= 0.70, sim >= 0.55,
    overlap >= 0.25.  A corrected frame is entered three times.
    """
    big = F.col("mask_area_px") > 8000
    gates = {
        "first": (F.col("conf") >= 0.60) & big,
        "refined": (F.col("conf") >= 0.65) & big & (F.col("appearance_sim") >= 0.50),
    }
    if mode == "v2":
        gate = (
            (F.col("zone") == "mid") & (F.col("conf") >= 0.70) & big & (F.col("appearance_sim") >= 0.55)
            & ((F.col("track_ov") >= 0.25) | (F.col("sand_ov") >= 0.25))
        )
    else:
        gate = gates[mode]
    manual = F.coalesce("manually_corrected", F.lit(False)) if "manually_corrected" in chosen.columns else F.lit(False)
    copies = chosen.filter(gate | manual).withColumn(
        "copy", F.explode(F.when(manual, F.array(F.lit(1), F.lit(2), F.lit(3))).otherwise(F.array(F.lit(1))))
    )
    limit = 10 if mode == "first" else 20
    w = Window.partitionBy("video_id").orderBy(F.col("frame_idx").desc(), F.col("copy").desc())
    return copies.withColumn("ref_age", F.row_number().over(w)).filter(F.col("ref_age") <= limit)


# ------------------------------------------------------------ sequential choices

def _overlaps(boxes: np.ndarray, other: np.ndarray) -> np.ndarray:
    """IoU of boxes, the last axis of both."""
    low, high = np.maximum(boxes[..., :2], other[..., :2]), np.minimum(boxes[..., 2:], other[..., 2:])
    shared = np.prod(np.maximum(high - low, 0.0), axis=-1)
    areas = np.prod(np.maximum(boxes[..., 2:] - boxes[..., :2], 0.0), axis=-1) + np.prod(np.maximum(other[..., 2:] - other[..., :2], 0.0), axis=-1) - shared
    return np.where(shared > 0, shared / np.where(areas > 0, areas, 1.0), 0.0)


def _numbers(rows: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    """Columns as arrays; nothing is NaN, or False."""
    out = []
    for name in names:
        column = rows.column(rows.schema.get_field_index(name))
        if column.null_count:
            column = column.fill_null(False) if pa.types.is_boolean(column.type) else column.cast(pa.float64())
        out.append(column.to_numpy(zero_copy_only=False))
    return out


def _box_table(rows: pa.RecordBatch) -> np.ndarray:
    return np.stack(_numbers(rows, "x1", "y1", "x2", "y2"), axis=1).astype(float)


def _boxes(rows: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Boxes of a list column, and where there is one."""
    column = rows.column(rows.schema.get_field_index(name))
    offsets = column.offsets.to_numpy()
    known = (np.diff(offsets) == 4) & ~column.is_null().to_numpy(zero_copy_only=False)
    table = np.full((rows.num_rows, 4), np.nan)
    if known.any():
        values = column.values.to_numpy(zero_copy_only=False)
        table[known] = values[offsets[:-1][known][:, None] + np.arange(4)]
    return table, known


def _codes(rows: pa.RecordBatch, keys: int) -> list[np.ndarray]:
    """The first columns as numbers that are equal where the values are."""
    return [rows.column(i).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False) for i in range(keys)]


def _key(rows: pa.RecordBatch, at: int, keys: int) -> tuple:
    return tuple(rows.column(i)[at].as_py() for i in range(keys))


def _batch(rows: pa.RecordBatch, taken: np.ndarray, columns: list, schema: pa.Schema) -> pa.RecordBatch:
    """The first column of ``rows`` at ``taken``, then the others."""
    names = rows.column(0).take(pa.array(taken)).cast(schema[0].type)
    return pa.RecordBatch.from_arrays([names, *(pa.array(c, k.type) for c, k in zip(columns, list(schema)[1:]))], schema=schema)


#: How many chosen boxes a frame of the landing zone looks back on; elsewhere it is the last one.
HISTORY = 4


def refine_v2_select(frames: DataFrame, detections: DataFrame, masks: bool = True) -> DataFrame:
    """Choice per frame that leans on the boxes chosen before.

    Early and middle frames look at the last chosen box, landing frames at the last four.  A frame with a single
    eligible detection is chosen whatever came before.  So the sequence is cut where all that a frame and the ones
    behind it look back on are such frames: one, or four where a landing frame is near.  A run begins with these
    frames as they are and is walked over sorted rows with four boxes in hand.
    """
    zoned = progress(frames.select("video_id", "frame_idx").distinct()).select(
        "video_id", "frame_idx", S.zone(F.col("progress")).alias("zone")
    )
    d = large_enough(detections).join(zoned, ["video_id", "frame_idx"])
    landing = F.col("zone") == "landing"
    sim, sand = F.col("appearance_sim"), F.col("sand_ov")
    if masks:
        floor = F.when(landing, 0.15).otherwise(0.20)
        score = S.blend_mask_score(sim, F.col("track_ov"), sand, F.when(landing, 0.45).otherwise(0.20)) + F.when(
            landing & (sand > 0), 0.10 * sand
        ).otherwise(0.0)
    else:
        floor, score = F.when(landing, 0.18).otherwise(0.25), sim
    d = d.withColumn("score", score).filter(sim >= floor)
    best_two = F.slice(F.sort_array(F.collect_list("score"), False), 1, 2)
    per = d.groupBy("video_id", "frame_idx").agg(
        F.first("zone").alias("zone"), F.count(F.lit(1)).alias("_n"), F.min(box_of()).alias("_only"), best_two.alias("_two")
    )
    placed = positions(per, ["video_id"], ["frame_idx"], pos="_pos", count="_rows")
    seen = scan(
        placed, ["video_id"], ["frame_idx"], before={"_busy": F.when(F.col("_n") > 1, F.col("_pos"))},
        totals={"_landing": ("min", F.when(F.col("zone") == "landing", F.col("_pos")))},
    )
    reach = F.when(F.col("_pos") + HISTORY - 1 >= F.col("_landing"), HISTORY).otherwise(1)
    cut = F.col("_busy").isNull() | (F.col("_pos") - reach > F.col("_busy"))
    start = F.when(F.col("_cut"), F.struct(F.col("_pos").alias("pos"), F.col("frame_idx").alias("frame"), F.col("_busy").alias("busy")))
    linked = scan(
        seen.withColumn("_cut", cut), ["video_id"], ["frame_idx"], through={"run": F.when(F.col("_cut"), F.col("frame_idx"))}, after={"_next": start},
    )
    # how far back a frame looks and how much that counts does not depend on the boxes chosen
    close = (F.col("_n") > 1) & (F.col("_two")[0] - F.col("_two")[1] <= 0.08)
    lean = F.when(F.col("zone") == "landing", 0.28).when(close, 0.24).otherwise(0.12)
    context = linked.select(
        "video_id", "frame_idx", "run", lean.alias("lean"), F.when(F.col("zone") == "landing", HISTORY).otherwise(1).alias("reach"),
    )
    rows = d.join(context, ["video_id", "frame_idx"]).select(
        "video_id", "run", F.col("frame_idx").alias("seq"), "det_id", "score", "x1", "y1", "x2", "y2", "lean", "reach", "appearance_sim", F.lit(False).alias("given"),
    )
    # the frames in front of a run that are chosen already
    ahead = F.col("_next.pos") - F.col("_pos")
    known = linked.filter((F.col("_n") == 1) & (ahead <= HISTORY) & (F.col("_next.busy").isNull() | (F.col("_next.busy") < F.col("_pos"))))
    given = known.select(
        "video_id", F.col("_next.frame").alias("run"), F.col("frame_idx").alias("seq"), *[F.col("_only")[i].alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))], F.lit(True).alias("given")
    )
    rows = rows.unionByName(given, allowMissingColumns=True)
    schema = T.StructType([
        rows.schema["video_id"], T.StructField("frame_idx", T.IntegerType()), T.StructField("det_id", T.IntegerType()),
        T.StructField("appearance_sim", T.DoubleType()), T.StructField("final_score", T.DoubleType()),
    ])
    kinds = arrow_schema(schema)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, None  # the run at the end of the batch before, its boxes and their number
        for part, edges in framed(batches, 3):
            seq, det, score, lean_, reach_, sims, is_given = _numbers(part, "seq", "det_id", "score", "lean", "reach", "appearance_sim", "given")
            boxes, edges, out = _box_table(part), np.asarray(edges), []
            line = lines_of(_codes(part, 2), edges)
            recent, seen = np.zeros((line[-1] + 1, HISTORY, 4)), np.zeros(line[-1] + 1, int)
            if last == _key(part, 0, 2):
                recent[0], seen[0] = kept
            for runs_, start, many in side_by_side(edges, line):
                at, real = padded(start, many)
                final = np.where(real, score[at], -np.inf)
                closest = np.zeros(at.shape)
                for back in range(1, HISTORY + 1):
                    known = np.minimum(seen[runs_], reach_[start]) >= back
                    if known.any():
                        other = recent[runs_, (seen[runs_] - back) % HISTORY][:, None]
                        closest = np.maximum(closest, np.where(known[:, None], _overlaps(boxes[at], other), 0.0))
                final = np.where((seen[runs_] > 0)[:, None] & real, final + lean_[start][:, None] * closest, final)
                pick = np.where(is_given[start], 0, final.argmax(axis=1))  # the first of equal ones: rows come by det_id
                taken, new = start + pick, ~is_given[start].astype(bool)
                recent[runs_, seen[runs_] % HISTORY] = boxes[taken]
                seen[runs_] += 1
                out.append((taken[new], final[np.arange(len(pick)), pick][new]))
            last, kept = _key(part, part.num_rows - 1, 2), (recent[-1], seen[-1])
            taken, best = (np.concatenate(c) for c in zip(*out))
            if len(taken):
                yield _batch(part, taken, [seq[taken].astype(int), det[taken].astype(int), sims[taken], best], kinds)

    keys = ["video_id", "run"]
    return rows.repartition(*keys).sortWithinPartitions(*keys, "seq", "det_id").mapInArrow(choose, schema)


def gap_fill(frames: DataFrame, detections: DataFrame, masks: bool = True) -> DataFrame:
    """Fill frames without the athlete outwards from the middle of the video.

    ``frames``: person_detected, person_bbox, quality_score, appearance_sim of
    the primary pass.  Early frames are walked backwards (weak ones are tried
    again), late ones forwards; each filled box becomes the expectation for the
    next.  Frames that stay as they are bound the runs, and so do frames that
    are filled the same way whatever the walk has reached before; every run is
    folded on its own.  Returns one row per changed frame with ``fill_action``.
    """
    d = large_enough(detections, MIN_AREA_GAP).select(
        "video_id", "frame_idx", "det_id", "x1", "y1", "x2", "y2", "conf", "mask_area_px", F.col("appearance_sim").alias("sim"), "appearance_sim", "track_ov", "sand_ov"
    )
    was, order = F.coalesce(F.col("person_detected"), F.lit(False)), (["video_id"], ["frame_idx"])
    # the candidate of a frame without a person that has a single one; with its number, it comes from the shuffle that numbers all
    option = F.when(F.col("det_id").isNotNull(), F.struct("det_id", box_of().alias("box"), "appearance_sim", "track_ov", "sand_ov"))
    lone = d.groupBy("video_id", "frame_idx").agg(F.count("det_id").alias("_options"), F.first(option, True).alias("_lone")).filter("_options = 1")
    base = frames.join(lone.drop("_options"), ["video_id", "frame_idx"], "left").withColumn("_lone", F.when(~was, F.col("_lone")))
    base = positions(lay_out(base, *order), *order, pos="pos", count="_n")
    base = base.withColumn("zone", S.zone(share(F.col("pos"), F.col("_n"))))
    known = was & G.has_box(F.col("person_bbox"))
    anchor = F.when(known & (F.col("zone") == "mid"), F.col("frame_idx"))
    mark = F.when(known, F.struct(F.col("pos").alias("p"), F.col("person_bbox").alias("b")))
    base = scan(base, *order, before={"_l": mark}, after={"_r": mark}, totals={"_first": ("min", anchor), "_last": ("max", anchor)})
    early, late = F.col("frame_idx") < F.col("_first"), F.col("frame_idx") > F.col("_last")
    weak = (F.col("zone") == "early") & (F.col("quality_score") < 0.35)
    needs = (early | late) & (~was | weak)
    base = base.select(
        "video_id", "frame_idx", "_chunk", "pos", "zone", F.when(early, "early").otherwise("late").alias("side"), F.coalesce(needs, F.lit(False)).alias("_needs"),
        was.alias("was"), F.coalesce("appearance_sim", F.lit(0.0)).alias("old_sim"), F.col("person_bbox").alias("old_box"),
        F.col("_l.p").alias("lp"), F.col("_l.b").alias("lb"), F.col("_r.p").alias("rp"), F.col("_r.b").alias("rb"), diagonal(frames).alias("diagonal"), "_lone.box", "_lone.appearance_sim", "_lone.track_ov", "_lone.sand_ov",
    ).withColumns(gap_terms(masks))
    # such a frame is filled whatever came before where its candidate needs no overlap: the walk starts anew behind it
    sure = F.col("_needs") & F.col("box").isNotNull() & (F.col("_need") == 0) & ~F.col("_weak")
    mark, stays = F.when(F.coalesce(sure, F.lit(False)), F.struct("pos", "box")), ~F.col("_needs")
    base = scan(
        base, *order, before={"_back": mark}, after={"_ahead": mark, "_until": F.when(stays, F.col("pos"))},
        through={"_stop": F.when(stays, F.struct("frame_idx", "pos"))},
    )
    # walked outwards: ``near`` is the known frame on the side the walk comes from, ``beyond`` the other one
    early = F.col("side") == "early"

    def outwards(first, second):
        return F.when(early, first).otherwise(second)

    last = F.when(F.col("_stop").isNull() | (F.col("_back.pos") > F.col("_stop.pos")), F.col("_back"))
    coming = F.when(F.col("_until").isNull() | (F.col("_ahead.pos") < F.col("_until")), F.col("_ahead"))
    todo = base.filter("_needs").withColumn("_from", outwards(coming, last))
    line = ["video_id", "side", "run"]
    todo = todo.select(
        "video_id", "side", F.coalesce("_stop.frame_idx", F.lit(-1)).alias("run"),
        F.coalesce(outwards(-F.col("_from.pos"), F.col("_from.pos")), F.lit(-(1 << 40)).cast("long")).alias("part"),
        outwards(-F.col("pos"), F.col("pos")).alias("seq"), "frame_idx", "pos", "zone", "was", "old_sim", "old_box", "diagonal",
        F.coalesce("_from.pos", outwards(F.col("rp"), F.col("lp"))).alias("near_p"), F.coalesce("_from.box", outwards(F.col("rb"), F.col("lb"))).alias("near_b"),
        outwards(F.col("lp"), F.col("rp")).alias("beyond_p"), outwards(F.col("lb"), F.col("rb")).alias("beyond_b"),
    )
    rows = todo.join(d, ["video_id", "frame_idx"], "left").withColumns(gap_terms(masks)).withColumn("_tie", F.coalesce("det_id", F.lit(-1)))
    rows = rows.select(*line, "part", "seq", *[c for c in rows.columns if c not in (*line, "part", "seq", "appearance_sim", "track_ov", "sand_ov")])
    schema = T.StructType([rows.schema["video_id"], *(T.StructField(n, k) for n, k in (
        ("frame_idx", T.IntegerType()), ("det_id", T.IntegerType()), *((c, T.DoubleType()) for c in ("x1", "y1", "x2", "y2", "conf")),
        ("mask_area_px", T.IntegerType()), ("appearance_sim", T.DoubleType()), ("fill_action", T.StringType()),
    ))])
    kinds = arrow_schema(schema)

    names = ("frame_idx", "pos", "was", "old_sim", "near_p", "beyond_p", "diagonal", "det_id", "conf", "mask_area_px", "sim", "_base", "_need", "_weak")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, None  # the part at the end of the batch before, what its walk has reached
        for part, edges in framed(batches, 5):
            col, boxes, edges, out = dict(zip(names, _numbers(part, *names))), _box_table(part), np.asarray(edges), []
            col["was"], col["_weak"] = (np.nan_to_num(col[n].astype(float)).astype(bool) for n in ("was", "_weak"))
            side, zone = (np.array(part.column(part.schema.get_field_index(n)).to_pylist(), object) for n in ("side", "zone"))
            late, early_zone = side == "late", zone == "early"
            given = {n: _boxes(part, n) for n in ("old_box", "near_b", "beyond_b")}
            line = lines_of(_codes(part, 4), edges)
            reached, where, place = np.zeros(line[-1] + 1, bool), np.zeros(line[-1] + 1), np.zeros((line[-1] + 1, 4))
            if last == _key(part, 0, 4):
                reached[0], where[0], place[0] = kept
            for walks, start, many in side_by_side(edges, line):
                at, real = padded(start, many)
                pos, on = col["pos"][start].astype(float), reached[walks]
                # what the walk has reached lies between this frame and any known one on that side
                near = (np.where(on, where[walks], col["near_p"][start]), np.where(on[:, None], place[walks], given["near_b"][0][start]), on | given["near_b"][1][start])
                beyond = (col["beyond_p"][start], given["beyond_b"][0][start], given["beyond_b"][1][start])
                expected, known = _between(near, beyond, pos, late[start])
                top, iou = _best_place({n: v[at] for n, v in col.items()}, boxes[at], real, expected, known)
                taken = start + np.maximum(top, 0)
                worse = col["was"][start] & early_zone[start] & (col["sim"][taken] + 0.05 < col["old_sim"][start]) & (iou < 0.22)
                found = (top >= 0) & ~worse
                stays = ~found & col["was"][start] & given["old_box"][1][start]
                moved = found | stays
                reached[walks[moved]], where[walks[moved]] = True, pos[moved]
                place[walks[moved]] = np.where(found[:, None], boxes[taken], given["old_box"][0][start])[moved]
                out.append(taken[found])
            last, kept = _key(part, part.num_rows - 1, 4), (reached[-1], where[-1], place[-1].copy())
            taken = np.concatenate(out)
            if len(taken):
                action = np.where(late, "filled_late", np.where(col["was"], "rescored_early", "filled_early"))[taken]
                whole = [col[n][taken].astype(int) for n in ("frame_idx", "det_id", "mask_area_px")]
                yield _batch(part, taken, [whole[0], whole[1], *boxes[taken].T, col["conf"][taken], whole[2], col["sim"][taken], action.tolist()], kinds)

    keys = ["video_id", "side", "run", "part"]
    return rows.repartition(*keys).sortWithinPartitions(*keys, "seq", "_tie").mapInArrow(fill, schema)


def _between(near: tuple, beyond: tuple, pos: np.ndarray, late: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The box to expect, and whether there is one: that of the next frame on an early walk, else blended by position.

    ``near`` and ``beyond``: positions, boxes and whether they are known, a row for each walk.
    """
    next_one = near[2] & ~late & (near[0] == pos + 1)
    with np.errstate(invalid="ignore", divide="ignore"):
        blend = near[1] + (beyond[1] - near[1]) * ((pos - near[0]) / (beyond[0] - near[0]))[:, None]
    alone = np.where(near[2][:, None], near[1], beyond[1])
    return np.where((~next_one & near[2] & beyond[2])[:, None], blend, alone), near[2] | beyond[2]


def _best_place(options: dict[str, np.ndarray], boxes: np.ndarray, real: np.ndarray, expected: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each frame's best candidate (-1: none) and its overlap with the expected box; frames by row.

    The columns of :func:`gap_terms` settle all but the place: only overlap and distance are added here.
    """
    line, known = np.arange(len(boxes)), known[:, None]
    allowed = real & ~np.isnan(options["det_id"].astype(float))
    with np.errstate(invalid="ignore", divide="ignore"):
        iou = np.where(known, _overlaps(boxes, expected[:, None]), 0.0)
        apart = (boxes[..., :2] + boxes[..., 2:] - expected[:, None, :2] - expected[:, None, 2:]) / 2
        dist = np.hypot(apart[..., 0], apart[..., 1]) / options["diagonal"][:, :1].astype(float)
        pull = np.where(known, NEAR_WEIGHT * np.maximum(0.0, 1.0 - dist * 4.0) - LOST_COST * ((iou < LOST_IOU) & (dist > LOST_DIST)), 0.0)
        allowed &= ~(known & options["_weak"] & (iou < FAR_IOU) & (dist > FAR_DIST))
        allowed &= iou >= np.nan_to_num(options["_need"].astype(float))
        score = np.where(allowed, options["_base"].astype(float) + IOU_WEIGHT * iou + pull, -np.inf)
    top = score.argmax(axis=1)
    # a candidate that overlaps well wins a near tie
    sure = allowed & (iou >= SURE_IOU) & known & (iou[line, top] < FAR_IOU)[:, None]
    most = np.where(sure, iou, -np.inf).max(axis=1)[:, None]
    close = np.where(sure & (iou == most), score, -np.inf).argmax(axis=1)
    swap = sure.any(axis=1) & (score[line, close] >= score[line, top] - TIE)
    top = np.where(swap, close, top)
    any_ = allowed.any(axis=1)
    return np.where(any_, top, -1), np.where(any_, iou[line, top], 0.0)
