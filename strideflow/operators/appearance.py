"""Choosing the athlete by looks that are learned on the way: every choice feeds the references of the next frames."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from .candidates import large_enough
from .chunks import framed, padded, side_by_side
from .venue import ZONE_WEIGHTS

# Limits of the reference sets.
READY_AT, MANUAL_COPIES = 2, 3
NEGATIVE_SLOPE, NEGATIVE_FLOOR = 0.60, 0.40
EMPTY_ZONE, NO_REFERENCE = 0.5, 0.5
LOOK, LOOK_TRACK = 0.45, 0.15
CLOSE_GAP, LEAN, LEAN_LANDING, LANDING_REACH, LANDING_SAND = 0.08, 0.12, 0.28, 4, 0.10


@dataclass(frozen=True)
class Rule:
    """How a pass keeps and uses references: ``keep`` positives, ``negatives`` others, the gates of a new positive."""

    keep: int
    negatives: int
    conf: float
    similarity: float | None = None
    overlap: float | None = None
    middle_only: bool = False
    mean: bool = False
    area: int = 8000


# Gates of the three passes.
RULES = {
    "first": Rule(10, 0, 0.60, mean=True),
    "refined": Rule(20, 15, 0.65, 0.50),
    "v2": Rule(20, 15, 0.70, 0.55, 0.25, middle_only=True),
}


# ------------------------------------------------------------ sets by rank

def learns_from(mode: str, zone: Column | None = None) -> tuple[Column, Column]:
    """Whether a chosen detection becomes a positive, and whether the frame's others become negatives."""
    rule = RULES[mode]
    sim = F.col("appearance_sim")
    fits = (F.col("conf") >= rule.conf) & (F.col("mask_area_px") > rule.area)
    others = F.lit(rule.negatives > 0)
    if rule.similarity is not None:
        fits, others = fits & (sim >= rule.similarity), others & (sim > rule.similarity)
    if rule.overlap is not None:
        fits = fits & (F.greatest("track_ov", "sand_ov") >= rule.overlap)
    if rule.middle_only:
        fits, others = fits & (zone == "mid"), others & (zone == "mid")
    return F.coalesce(fits, F.lit(False)), F.coalesce(others, F.lit(False))


def negative_set(detections: DataFrame, chosen: DataFrame, mode: str = "refined") -> DataFrame:
    """The other persons that a pass remembers at its end: the newest candidates that were not chosen.

    ``chosen``: one row per frame with det_id and appearance_sim (for ``v2`` with zone).  ``neg_age`` counts
    from the newest; the rank filter keeps fifteen a video before anything is gathered.
    """
    _, others = learns_from(mode, F.col("zone"))
    taken = chosen.filter(others).select("video_id", "frame_idx", F.col("det_id").alias("_taken"))
    rest = large_enough(detections).join(taken, ["video_id", "frame_idx"]).filter(F.col("det_id") != F.col("_taken")).drop("_taken")
    newest = Window.partitionBy("video_id").orderBy(F.col("frame_idx").desc(), F.col("det_id").desc())
    return rest.withColumn("neg_age", F.row_number().over(newest)).filter(F.col("neg_age") <= RULES[mode].negatives)


def readiness(references: DataFrame, videos: DataFrame) -> DataFrame:
    """Per video how many references it has and whether its looks can be used."""
    counted = references.groupBy("video_id").agg(F.count(F.lit(1)).alias("n_references"))
    joined = videos.select("video_id").distinct().join(counted, "video_id", "left")
    n = F.coalesce("n_references", F.lit(0))
    return joined.select("video_id", n.alias("n_references"), (n >= READY_AT).alias("ready"))


# ------------------------------------------------------------ learning on the way

def unit_histograms(histograms: np.ndarray) -> np.ndarray:
    """Square roots of each zone's shares; zones without pixels stay zero.  Their products are Bhattacharyya coefficients."""
    mass = histograms.sum(axis=-1, keepdims=True)
    return np.sqrt(np.divide(histograms, mass, out=np.zeros_like(histograms), where=mass > 0))


class Banks:
    """References of many videos side by side: rings of histograms by video, the oldest of which goes first.

    A reference mean adds histograms as they are, in their order; single distances need their unit form only.
    """

    def __init__(self, rule: Rule, weights: np.ndarray, videos: int, size: int):
        self.rule, self.weights = rule, weights
        zones = len(weights)
        self.positives, self.others = (np.zeros((videos, zones, n, size // zones)) for n in (rule.keep, max(1, rule.negatives)))
        self.n_positives, self.n_others = np.zeros(videos, int), np.zeros(videos, int)  # all ever entered
        self.boxes, self.n_boxes = np.zeros((videos, LANDING_REACH, 4)), np.zeros(videos, int)

    def take(self, video: int, other: Banks, place: int) -> None:
        """The state of ``other``'s video at ``place``."""
        for name in ("positives", "others", "n_positives", "n_others", "boxes", "n_boxes"):
            getattr(self, name)[video] = getattr(other, name)[place]

    def enter(self, videos: np.ndarray, looks: np.ndarray) -> None:
        """One more positive of each of these videos."""
        self.positives[videos, :, self.n_positives[videos] % self.rule.keep] = looks
        self.n_positives[videos] += 1

    def enter_others(self, videos: np.ndarray, looks: np.ndarray, which: np.ndarray) -> None:
        """The other persons of a frame: rows of ``looks`` (videos x candidates) where ``which`` holds, in their order."""
        rank = np.cumsum(which, axis=1) - 1
        many = which.sum(axis=1)
        last = which & (rank >= (many - self.rule.negatives)[:, None])  # of more than fit the newest stay
        row, at = np.nonzero(last)
        slots = (self.n_others[videos][row] + rank[row, at]) % max(1, self.rule.negatives)
        self.others[videos[row], :, slots] = looks[row, at]
        self.n_others[videos] += many

    def choose_box(self, videos: np.ndarray, boxes: np.ndarray) -> None:
        self.boxes[videos, self.n_boxes[videos] % LANDING_REACH] = boxes
        self.n_boxes[videos] += 1

    def counts(self, videos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """References held now."""
        return np.minimum(self.n_positives[videos], self.rule.keep), np.minimum(self.n_others[videos], self.rule.negatives)

    def _distances(self, looks: np.ndarray, references: np.ndarray) -> np.ndarray:
        """Weighted distance of each candidate to each reference of its video, all as unit histograms by zone."""
        shared = looks.swapaxes(1, 2) @ references.swapaxes(2, 3)
        apart = np.sqrt(np.maximum(0.0, 1.0 - shared))
        empty_look, empty = ~looks.any(axis=3).swapaxes(1, 2), ~references.any(axis=3)
        if empty_look.any() or empty.any():
            apart[empty_look[..., None] | empty[:, :, None, :]] = EMPTY_ZONE
        return sum(apart[:, z] * w for z, w in enumerate(self.weights))

    def _held(self, looks: np.ndarray, rings: np.ndarray, videos: np.ndarray, held: np.ndarray) -> np.ndarray:
        """Distances to the references held; infinite where a video has fewer than another."""
        far = self._distances(looks, rings[videos, :, : int(held.max())])
        return np.where((np.arange(far.shape[2]) < held[:, None])[:, None, :], far, np.inf)

    def similarity(self, videos: np.ndarray, looks: np.ndarray) -> np.ndarray:
        """Of the unit histograms of each video's candidates (videos x candidates x zones x bins)."""
        held, negative = self.counts(videos)
        if self.rule.mean:
            total, start = np.zeros((len(videos), *self.positives[0, :, 0].shape)), self.n_positives[videos] - held
            for i in range(int(held.max())):
                more = self.positives[videos, :, (start + i) % self.rule.keep]
                total += np.where((i < held)[:, None, None], more, 0.0)
            mean = unit_histograms(total / np.maximum(held, 1)[:, None, None])
            like = np.clip(1.0 - self._distances(looks, mean[:, :, None])[:, :, 0], 0.0, 1.0)
        else:
            far = np.sort(self._held(looks, self.positives, videos, np.maximum(held, 1)), axis=2)
            row = np.arange(len(videos))
            middle = (far[row, :, np.maximum(0, held - 1) // 2] + far[row, :, np.minimum(held // 2, far.shape[2] - 1)]) / 2.0
            like = np.clip(1.0 - middle, 0.0, 1.0)
            if self.rule.negatives and negative.any():
                far = self._held(looks, self.others, videos, negative).min(axis=2)
                near = np.clip(1.0 - far, 0.0, 1.0)
                like = np.where((negative > 0)[:, None], like * np.clip(1.0 - NEGATIVE_SLOPE * near, NEGATIVE_FLOOR, 1.0), like)
        return np.where((held > 0)[:, None], like, NO_REFERENCE)


_OUT = (
    "video_id string, frame_idx int, det_id int, similarity double, score double, n_positives int, n_negatives int, ready boolean, learned boolean"
)


def learned_choice(
    detections: DataFrame, mode: str = "refined", seeds: DataFrame | None = None, corrected: DataFrame | None = None,
    lock: DataFrame | None = None, masks: bool = True, zone_weights: tuple[float, ...] | None = None,
) -> DataFrame:
    """The chosen detection of every frame when each choice changes the similarities of the frames behind it.

    ``detections``: as in the other choices, with ``histogram`` (ARRAY<ARRAY<DOUBLE>>: bins by zone, equal sizes)
    instead of appearance_sim.  ``first``: the locked track, else looks, track score or size, compared with the
    mean of the last 10 references.  ``refined``: looks and masks, median of 20 references, weakened by the
    closest of 15 other persons.  ``v2``: learns in the middle only and leans on the boxes chosen before.
    ``seeds``: video_id, seed_order, positive, histogram, entered before the first frame.  ``corrected``:
    video_id, frame_idx, det_id chosen by hand, entered three times.  ``lock``: video_id, athlete_track_id.

    One row per frame with a choice: ``similarity``, ``score``, the references before it (``n_positives``,
    ``n_negatives``, ``ready`` from two on) and whether it was ``learned``.  The order of a video cannot be
    split, as every frame depends on the ones before; a task streams it in sorted order and holds at most 35
    histograms of it.  The videos of an Arrow batch are walked side by side, a frame of each at a time.
    Gates that need no history are columns of the rows.
    """
    rule = RULES[mode]
    weights = np.array(zone_weights or (tuple(ZONE_WEIGHTS.values()) if not rule.mean else (1.0,)))
    d = large_enough(detections)
    score = F.col("track_score") if "track_score" in d.columns else F.lit(None)
    rows = d.select(
        F.col("video_id").cast("string").alias("video_id"), F.col("frame_idx").cast("int").alias("frame_idx"), F.col("det_id").cast("int").alias("det_id"),
        F.lit("seen").alias("kind"), "track_id", "conf", "mask_area_px", "track_ov", "sand_ov", score.cast("double").alias("track_score"),
        "x1", "y1", "x2", "y2", F.flatten("histogram").alias("histogram"),
    )
    if seeds is not None:
        entered = seeds.select(
            F.col("video_id").cast("string").alias("video_id"), F.lit(-1).alias("frame_idx"), F.col("seed_order").cast("int").alias("det_id"),
            F.when(F.col("positive"), "positive").otherwise("other").alias("kind"), F.flatten("histogram").alias("histogram"),
        )
        rows = rows.unionByName(entered, allowMissingColumns=True)
    if corrected is not None:
        marks = corrected.select(*[F.col(c).cast(rows.schema[c].dataType).alias(c) for c in ("video_id", "frame_idx", "det_id")], F.lit("hand").alias("kind"))
        rows = rows.unionByName(marks, allowMissingColumns=True)
    # one shuffle: the windows below and the walk all follow a video's frames in their order
    rows = rows.repartition("video_id")
    whole, hand = Window.partitionBy("video_id"), F.lit(False)
    if corrected is not None:
        hand = F.max(F.col("kind") == "hand").over(Window.partitionBy("video_id", "frame_idx", "det_id")) & (F.col("kind") == "seen")
        rows = rows.withColumn("manual", hand).filter(F.col("kind") != "hand")
        hand = F.col("manual")
    rows = rows.withColumn("_turn", F.dense_rank().over(whole.orderBy("frame_idx")))
    first = (F.min("frame_idx").over(whole) < 0).cast("int")  # the seeds' place
    rows = rows.withColumns({"_last": F.max("_turn").over(whole) - first, "_pos": F.col("_turn") - first})
    zone = S.zone(F.when(F.col("_last") <= 1, 0.5).otherwise((F.col("_pos") - 1) / (F.col("_last") - 1)))
    rows = rows.withColumn("zone", zone)
    landing = (F.col("zone") == "landing") & F.lit(mode == "v2")
    bias = S.blend_mask_score(F.lit(0.0), F.col("track_ov"), F.col("sand_ov"), F.when(landing, 0.45).otherwise(0.20)) + F.when(landing & (F.col("sand_ov") > 0), LANDING_SAND * F.col("sand_ov")).otherwise(0.0)
    if mode == "v2":
        floor = F.when(landing, 0.15 if masks else 0.18).otherwise(0.20 if masks else 0.25)
    else:
        floor = F.lit(0.20 if masks else 0.25)
    if mode == "first":
        bias = F.col("track_score")
    elif not masks:
        bias = F.lit(0.0)
    gate = (F.col("conf") >= rule.conf) & (F.col("mask_area_px") > rule.area)
    if rule.overlap is not None and masks:
        gate = gate & (F.greatest("track_ov", "sand_ov") >= rule.overlap)
    if lock is not None:
        held = lock.select(F.col("video_id").cast("string").alias("video_id"), "athlete_track_id")
        rows = rows.join(held, "video_id", "left")
        locked = F.coalesce(F.col("track_id") == F.col("athlete_track_id"), F.lit(False))
    else:
        locked = F.lit(False)
    rows = rows.select(
        "video_id", "frame_idx", "det_id", "kind", bias.alias("bias"), floor.alias("floor"), F.coalesce(gate, F.lit(False)).alias("gate"),
        (F.col("zone") == "mid").alias("middle"), (F.col("zone") == "landing").alias("landing"), locked.alias("locked"), hand.alias("manual"),
        "x1", "y1", "x2", "y2", "histogram",
    )
    chooser = {"first": _first_choice, "refined": _look_choice, "v2": _look_choice}[mode]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_()]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, None  # the video at the end of the batch before, its references
        for part, edges in framed(batches, 2):
            rows = _Table(part, weights, rule.mean, 0 if kept is None else kept.positives[0, :, 0].size)
            names, video = rows.videos(edges)
            banks = Banks(rule, weights, len(names), rows.raw[0].size if len(edges) > 1 else 0)
            if kept is not None and names[0] == last:
                banks.take(0, kept, len(kept.n_boxes) - 1)
            out = [_step(rows, banks, chooser, mode, *step) for step in side_by_side(np.asarray(edges), video)]
            last, kept = names[-1], banks
            out = [o for o in out if o is not None]
            if out:
                number, *columns = (np.concatenate(c) for c in zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.string()).take(pa.array(number)), *(pa.array(c, k) for c, k in zip(columns, kinds[1:]))],
                    [f.split()[0] for f in _OUT.split(", ")],
                )

    return rows.sortWithinPartitions("video_id", "frame_idx", "det_id").mapInArrow(walk, _OUT)


class _Table:
    """Columns of sorted candidates, with histograms by zone as they are and in unit form."""

    def __init__(self, part: pa.RecordBatch, weights: np.ndarray, mean: bool, size: int):
        def numbers(name, empty=np.nan):
            return part.column(part.schema.get_field_index(name)).fill_null(empty).to_numpy(zero_copy_only=False)

        self.names = part.column(0).dictionary_encode(null_encoding="encode")
        self.frame, self.det, self.bias, self.floor = numbers("frame_idx", 0), numbers("det_id", 0), numbers("bias"), numbers("floor")
        self.gate, self.middle, self.landing, self.locked, self.manual = (numbers(n, False) for n in ("gate", "middle", "landing", "locked", "manual"))
        self.positive = np.array(part.column(part.schema.get_field_index("kind")).to_pylist(), object) == "positive"
        self.boxes = np.stack([numbers(n) for n in ("x1", "y1", "x2", "y2")], axis=1)
        looks = part.column(part.schema.get_field_index("histogram"))
        lengths = np.diff(looks.offsets.to_numpy())
        size = max(size, int(lengths.max(initial=0)))
        table = np.zeros((part.num_rows, size))
        whole = np.flatnonzero(lengths == size)
        if size and len(whole):
            values, starts = looks.values.fill_null(0.0).to_numpy(zero_copy_only=False), looks.offsets.to_numpy()[whole]
            table[whole] = values[starts[:, None] + np.arange(size)]
        self.raw = table.reshape(part.num_rows, len(weights), size // len(weights))
        self.unit = unit_histograms(self.raw)
        self.entered = self.raw if mean else self.unit

    def videos(self, edges: list[int]) -> tuple[list, np.ndarray]:
        """Names of the videos in their order and each frame's number among them."""
        codes = self.names.indices.to_numpy(zero_copy_only=False)[np.asarray(edges[:-1])]
        names = self.names.dictionary.to_pylist()
        new = np.r_[True, np.diff(codes) != 0]
        return [names[c] for c in codes[new]], np.cumsum(new) - 1


def _step(rows: _Table, banks: Banks, chooser, mode: str, videos: np.ndarray, start: np.ndarray, many: np.ndarray) -> tuple | None:
    """One frame of each of these videos: compare, choose and learn."""
    seeds = rows.frame[start] < 0
    if seeds.any():
        _enter_seeds(rows, banks, videos[seeds], start[seeds], many[seeds])
        if seeds.all():
            return None
        videos, start, many = (x[~seeds] for x in (videos, start, many))
    at, real = padded(start, many)
    sims = banks.similarity(videos, rows.unit[at])
    choice, score = chooser(rows, banks, videos, at, real, sims, mode == "v2")
    by_hand = rows.manual[at] & real
    forced, line = by_hand.any(axis=1), np.arange(len(videos))
    choice = np.where(forced, by_hand.argmax(axis=1), choice)
    score = np.where(forced, sims[line, np.maximum(choice, 0)], score)
    found = choice >= 0
    if not found.any():
        return None
    videos, at, real, sims, choice, score, forced = (x[found] for x in (videos, at, real, sims, choice, score, forced))
    line = np.arange(len(videos))
    taken, sim = at[line, choice], sims[line, choice]
    held, negative = banks.counts(videos)
    learned = _learn(banks, rows, videos, at, real, choice, taken, sim, forced)
    banks.choose_box(videos, rows.boxes[taken])
    return videos, rows.frame[taken], rows.det[taken], sim, score, held, negative, held >= READY_AT, learned


def _enter_seeds(rows: _Table, banks: Banks, videos: np.ndarray, start: np.ndarray, many: np.ndarray) -> None:
    for i in range(int(many.max())):
        here = i < many
        place, who = start[here] + i, videos[here]
        good = rows.positive[place]
        banks.enter(who[good], rows.entered[place[good]])
        if banks.rule.negatives:
            banks.enter_others(who[~good], rows.entered[place[~good]][:, None], np.ones((int((~good).sum()), 1), bool))


def _look_choice(rows: _Table, banks: Banks, videos, at, real, sims, lean_on: bool) -> tuple[np.ndarray, np.ndarray]:
    """Best of similarity and mask bias among those that look enough like the athlete; -1 if none does."""
    able = real & (sims >= rows.floor[at])
    score = np.where(able, sims + rows.bias[at], -np.inf)
    if lean_on:
        n = able.sum(axis=1)
        top = np.sort(score, axis=1)[:, ::-1]
        with np.errstate(invalid="ignore"):
            apart = (n < 2) | (top[:, 0] - top[:, min(1, top.shape[1] - 1)] > CLOSE_GAP)
        landing = rows.landing[at[:, 0]]
        lean = np.where(landing, LEAN_LANDING, np.where(apart, LEAN, 2 * LEAN))
        seen, boxes = banks.n_boxes[videos], rows.boxes[at]
        closest = np.zeros(score.shape)
        for back in range(1, LANDING_REACH + 1):
            known = (seen >= back) & (landing | (back == 1))
            if known.any():
                other = banks.boxes[videos, (seen - back) % LANDING_REACH]
                closest = np.maximum(closest, np.where(known[:, None], _overlap(boxes, other[:, None]), 0.0))
        score = np.where((seen > 0)[:, None], score + lean[:, None] * closest, score)
    choice = score.argmax(axis=1)
    return np.where(able.any(axis=1), choice, -1), score[np.arange(len(choice)), choice]


def _first_choice(rows: _Table, banks: Banks, videos, at, real, sims, lean_on: bool) -> tuple[np.ndarray, np.ndarray]:
    """Locked track, else looks once there are references, else track score, else size."""
    line, bias = np.arange(len(videos)), rows.bias[at]
    look = np.where(real, sims + LOOK_TRACK * np.nan_to_num(bias), -np.inf)
    side = rows.boxes[at]
    size = np.prod(side[..., 2:] - side[..., :2], axis=2)
    unscored = np.isnan(bias)
    scored = (~unscored & real).any(axis=1)[:, None]
    large = np.where(real, np.where(scored, np.where(unscored, -np.inf, bias + size * 1e-6), size), -np.inf)
    locked = rows.locked[at] & real
    by_lock, by_look = locked.any(axis=1), (banks.counts(videos)[0] >= READY_AT) & (look.max(axis=1) >= LOOK)
    choice = np.where(by_lock, locked.argmax(axis=1), np.where(by_look, look.argmax(axis=1), large.argmax(axis=1)))
    return choice, np.where(by_lock, sims[line, choice], np.where(by_look, look[line, choice], large[line, choice]))


def _learn(banks: Banks, rows: _Table, videos, at, real, choice, taken, sim, forced) -> np.ndarray:
    """Enter the chosen ones and, where the pass keeps them, the others of the frames."""
    rule, line = banks.rule, np.arange(len(videos))
    by_hand = forced & rows.manual[taken]
    free = ~by_hand & (rows.middle[taken] | (not rule.middle_only))
    learned = free & rows.gate[taken]
    if rule.similarity is not None:
        learned &= sim >= rule.similarity
    for copy in range(MANUAL_COPIES):
        enters = by_hand | learned if copy == 0 else by_hand
        banks.enter(videos[enters], rows.entered[taken[enters]])
    if rule.similarity is not None:
        sure = free & (sim > rule.similarity)
        rest = real & (np.arange(at.shape[1]) != choice[line][:, None])
        banks.enter_others(videos[sure], rows.entered[at[sure]], rest[sure])
    return by_hand | learned


def _overlap(boxes: np.ndarray, other: np.ndarray) -> np.ndarray:
    """IoU of boxes, the last axis of both."""
    low, high = np.maximum(boxes[..., :2], other[..., :2]), np.minimum(boxes[..., 2:], other[..., 2:])
    shared = np.prod(np.maximum(high - low, 0.0), axis=-1)
    whole = np.prod(boxes[..., 2:] - boxes[..., :2], axis=-1) + np.prod(other[..., 2:] - other[..., :2], axis=-1) - shared
    return np.divide(shared, whole, out=np.zeros(shared.shape), where=whole > 0)
