"""Comparison of a take with the athlete's history and with everybody's.

A take is compared with all *other* takes.  Instead of joining every take with
every other one, totals are aggregated once and each take's own share is taken
off again, so the work is linear in the number of sessions per athlete.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as G
from ..functions import scores as S
from ..functions import vectors as V
from ..functions.pose import bind
from ..schemas import CONTACT_PHASES, DEFAULT_FPS

SEGMENTS = ("hop_1", "hop_2", "hop_3", "hop_4")
MIN_SESSIONS = 2
N_FEATURES = 14


def _meet(left: DataFrame, right: DataFrame, keys, how: str = "inner") -> DataFrame:
    """A join by shuffles, whatever Spark takes the sizes for.

    Poses and intervals come out of arrays of a compressed table, so they are many times what Spark expects
    of them, and as a broadcast would go through the driver.
    """
    return left.join(right.hint("merge"), keys, how)


# ------------------------------------------------------------ general baseline

def gt_intervals(gt: DataFrame, frames: DataFrame | None = None, fps: float = DEFAULT_FPS) -> DataFrame:
    """Positive contact intervals of the videos whose ground truth has all five phases."""
    used = gt.filter(F.col("phase").isin(*CONTACT_PHASES) & F.col("frame_idx").isNotNull())
    marked = used.groupBy("video_id").agg(
        *[
            F.max_by("frame_idx", F.when(F.col("phase") == p, F.col("frame_idx"))).alias(f"_{p}")
            for p in CONTACT_PHASES
        ]
    )
    complete = marked
    for p in CONTACT_PHASES:
        complete = complete.filter(F.col(f"_{p}").isNotNull())
    stops = F.array(
        *[F.struct(F.lit(i).alias("i"), F.col(f"_{p}").alias("frame_idx")) for i, p in enumerate(CONTACT_PHASES)]
    )
    rows = complete.select("video_id", F.inline(stops))
    if frames is not None:
        rows = rows.join(
            frames.select("video_id", "frame_idx", F.col("timestamp_s").alias("_t")), ["video_id", "frame_idx"], "left"
        )
    else:
        rows = rows.withColumn("_t", F.lit(None).cast("double"))
    timed = rows.withColumn("_t", F.coalesce("_t", F.col("frame_idx") / F.lit(fps)))
    per_video = timed.groupBy("video_id").agg(
        *[F.max(F.when(F.col("i") == i, F.col("_t"))).alias(f"_t{i}") for i in range(5)]
    )
    gaps = F.array(
        *[
            F.struct(F.lit(s).alias("segment"), (F.col(f"_t{i + 1}") - F.col(f"_t{i}")).alias("dt_s"))
            for i, s in enumerate(SEGMENTS)
        ]
    )
    return per_video.select("video_id", F.inline(gaps)).filter(F.col("dt_s") > 0)


def _usable(v: Column) -> Column:
    return F.when((v > 0) & ~F.isnan(v) & (v < float("inf")), v)


def _session_sums(sessions: DataFrame, keys) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("sessions")]
    for i, s in enumerate(SEGMENTS):
        for short, col in (("dt", "intervals_s"), ("sp", "speeds_m_s"), ("len", "lengths_m")):
            v = _usable(F.get(col, F.lit(i)))
            aggs += [F.coalesce(F.sum(v), F.lit(0.0)).alias(f"{short}_sum_{s}"), F.count(v).alias(f"{short}_n_{s}")]
    return sessions.groupBy(*keys).agg(*aggs)


def _gt_sums(gaps: DataFrame, keys) -> DataFrame:
    aggs = []
    for s in SEGMENTS:
        v = F.when(F.col("segment") == s, F.col("dt_s"))
        aggs += [F.coalesce(F.sum(v), F.lit(0.0)).alias(f"gt_sum_{s}"), F.count(v).alias(f"gt_n_{s}")]
    return gaps.groupBy(*keys).agg(*aggs)


def _no_gt() -> list[Column]:
    """What :func:`_gt_sums` gives without any ground truth."""
    return [c for s in SEGMENTS for c in (F.lit(0.0).alias(f"gt_sum_{s}"), F.lit(0).cast("long").alias(f"gt_n_{s}"))]


def general_baseline(
    sessions: DataFrame, gaps: DataFrame | None = None, videos: DataFrame | None = None
) -> DataFrame:
    """Mean interval, speed and length per hop segment over all other sessions.

    With ``videos`` one set of rows per video is returned, leaving that video
    out; without it a single set.  Ground-truth intervals are added to a segment
    with fewer than two session samples.  ``limited`` marks thin baselines.
    """
    totals = _session_sums(sessions, [])  # one row
    totals = totals.select("*", *_no_gt()) if gaps is None else totals.crossJoin(_gt_sums(gaps, []))  # one row each
    fields = totals.columns
    if videos is None:
        left = totals
        keys: list[str] = []
    else:
        keys = ["video_id"]
        own = _session_sums(sessions, keys)
        own = own.select("*", *_no_gt()) if gaps is None else own.join(_gt_sums(gaps, keys), "video_id", "full_outer")
        own = own.select("video_id", *[F.coalesce(c, F.lit(0)).alias(f"_own_{c}") for c in fields])
        left = (
            videos.select("video_id").distinct().join(own, "video_id", "left")
            .crossJoin(F.broadcast(totals))
            .select("video_id", *[(F.col(c) - F.coalesce(f"_own_{c}", F.lit(0))).alias(c) for c in fields])
        )

    def mean(total, n, digits):
        return F.when(n > 0, F.round(total / n, digits))

    rows, samples = [], []
    for s in SEGMENTS:
        thin = F.col(f"dt_n_{s}") < MIN_SESSIONS
        n = F.col(f"dt_n_{s}") + F.when(thin, F.col(f"gt_n_{s}")).otherwise(0)
        samples.append(n)
        total = F.when(F.col(f"dt_n_{s}") > 0, F.col(f"dt_sum_{s}")).otherwise(0.0) + F.when(
            thin, F.col(f"gt_sum_{s}")
        ).otherwise(0.0)
        rows.append(
            F.struct(
                F.lit(s).alias("segment"), n.cast("long").alias("samples"),
                mean(total, n, 4).alias("dt_mean_s"),
                mean(F.col(f"sp_sum_{s}"), F.col(f"sp_n_{s}"), 3).alias("speed_mean_m_s"),
                mean(F.col(f"len_sum_{s}"), F.col(f"len_n_{s}"), 4).alias("length_mean_m"),
            )
        )
    out = left.select(*keys, F.col("sessions"), (F.greatest(*samples) < MIN_SESSIONS).alias("limited"), F.array(*rows).alias("_r"))
    return out.select(*keys, F.col("sessions").alias("sessions_used"), "limited", F.inline("_r"))


def vs_general(segments: DataFrame, baseline: DataFrame) -> DataFrame:
    """Per video and hop segment: deltas, indicator and closeness to the baseline.

    ``segments``: video_id, id, dt_s, speed_m_s, length_m.  A ``final`` segment
    stands in for hop_4 when there is none.
    """
    slot = F.when(F.col("id") == "final", F.lit("hop_4")).otherwise(F.col("id"))
    item, last = F.struct("dt_s", "speed_m_s", "length_m"), (F.col("id") == "final").cast("int")
    # One row a video, so everything meets by video and a baseline that is laid out by video stays where it is.
    own = segments.groupBy("video_id").agg(*[F.min_by(item, F.when(slot == s, last)).alias(f"_{s}") for s in SEGMENTS])
    j = baseline.join(own, "video_id") if "video_id" in baseline.columns else own.crossJoin(F.broadcast(baseline))  # four rows
    mine = F.lit(None)
    for s in SEGMENTS:
        mine = F.when(F.col("segment") == s, F.col(f"_{s}")).otherwise(mine)
    j = j.withColumn("s", mine)
    dt, sp, ln = F.col("s.dt_s"), F.col("s.speed_m_s"), F.col("s.length_m")
    mdt, msp, mln = F.col("dt_mean_s"), F.col("speed_mean_m_s"), F.col("length_mean_m")
    sign = F.coalesce(S.indicator(dt, mdt), S.indicator(sp, msp), S.indicator(ln, mln))

    def close(cur, mean):
        return F.when(
            F.abs(mean) > 1e-9, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - F.abs(cur - mean) / F.abs(mean)))
        )

    return j.select(
        "video_id", "segment",
        F.round(dt, 4).alias("dt_s"), mdt.alias("dt_mean_s"), F.round(dt - mdt, 4).alias("dt_delta_s"),
        F.round(sp, 3).alias("speed_m_s"), msp.alias("speed_mean_m_s"), F.round(sp - msp, 3).alias("speed_delta_ms"),
        F.round(ln, 4).alias("length_m"), mln.alias("length_mean_m"), F.round(ln - mln, 4).alias("length_delta_m"),
        sign.alias("indicator"), F.coalesce(close(dt, mdt), close(sp, msp)).alias("closeness"),
        "limited", "sessions_used",
    )


def vs_general_overall(rows: DataFrame) -> DataFrame:
    return rows.groupBy("video_id").agg(F.round(F.avg("closeness"), 3).alias("overall"))


# ------------------------------------------------------------ consistency

#: Poses of one contact that are compared where they lie; an athlete with more of them has blocks of this size that meet in pairs.
POSE_BLOCK = 4096
#: Groups with no more pairs than this are worked on together.
SMALL_PAIRS = 1 << 14
#: Pairs that are held at once.
PAIRS = 1 << 17


def _both(current: DataFrame, history: DataFrame, *columns: str) -> DataFrame:
    """Rows of both sides: ``_asks`` are to be compared, ``_held`` are compared with; once if both are the same."""
    def side(df, asks, held):
        kept = [c if c in df.columns else F.lit(None).cast(current.schema[c].dataType).alias(c) for c in columns]
        return df.select(*kept, F.lit(asks).alias("_asks"), F.lit(held).alias("_held"))

    return side(current, True, True) if current is history else side(current, True, False).unionByName(side(history, False, True))


def history_similarity(current: DataFrame, history: DataFrame) -> DataFrame:
    """Mean similarity of each contact pose to the same contact of other sessions.

    ``current``: athlete_id, video_id, contact_index, vec; ``history``: the same.  A score is the cosine, and for a
    negative one half of what it lacks to one is added.  Poses of different length are not compared.
    """
    key = ["athlete_id", "contact_index", "video_id"]
    rows = _against_history(_both(current, history, *key, "vec"), _crowded(current, history))
    return rows.filter(F.col("athlete_id").isNotNull() & F.col("contact_index").isNotNull()).groupBy(*key).agg(F.max("vs_history").alias("vs_history"))


def _crowded(current: DataFrame, history: DataFrame) -> DataFrame | None:
    """Athletes with over :data:`POSE_BLOCK` poses of a contact, and the blocks these are dealt to; None without any."""
    counts = _both(current, history, "athlete_id", "contact_index").groupBy("athlete_id", "contact_index").agg(F.count(F.lit(1)).alias("_n"))
    most = counts.filter("athlete_id IS NOT NULL AND contact_index IS NOT NULL").groupBy("athlete_id").agg(F.max("_n").alias("_n"))
    found = most.filter(F.col("_n") > POSE_BLOCK).select("athlete_id", F.ceil(F.col("_n") / POSE_BLOCK).cast("long").alias("_slots"))
    return None if found.isEmpty() else found


def _against_history(rows: DataFrame, crowded: DataFrame | None, *beside: str) -> DataFrame:
    """The rows that ask, with ``vs_history`` and the columns ``beside``.

    The poses of an athlete's contact are gathered once and compared where they lie, so they are shuffled once, and
    not at all where they are laid out by athlete already.  Only the poses of ``crowded`` athletes are dealt to
    blocks by take, and all pairs of blocks meet.
    """
    key = ["athlete_id", "contact_index"]
    usual = F.size("vec") == N_FEATURES
    size = F.when(usual, F.sqrt(V.dot_fixed(F.col("vec"), F.col("vec"), N_FEATURES))).otherwise(V.norm(F.col("vec")))
    lost = F.col("athlete_id").isNull() | F.col("contact_index").isNull()
    directed = (F.size("vec") > 0) & (size >= 1e-9) & ~lost
    poses = rows.select(*key, F.struct("video_id", "_asks", "_held", F.when(directed, F.col("vec")).alias("vec"), *beside).alias("_pose"))
    few, many = poses, None
    if crowded is not None:
        dealt = _meet(poses, crowded, "athlete_id", "left")
        few, many = dealt.filter(F.col("_slots").isNull()), dealt.filter(F.col("_slots").isNotNull())
    kinds = [T.StructField(c, rows.schema[c].dataType) for c in (*key, "video_id", *beside)]
    schema = T.StructType([*kinds, T.StructField("vs_history", T.DoubleType())])

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                mine = _Poses.of(batch.column(2))
                codes = _codes(mine.ids)
                sim, count = mine.against(mine, codes, codes)
                # poses of one contact in one take share a result
                _, take = np.unique(mine.row * (len(codes) + 1) + codes, return_inverse=True)
                sim, count = np.bincount(take, sim)[take], np.bincount(take, count)[take]
                out = np.flatnonzero(mine.asks)
                with np.errstate(invalid="ignore", divide="ignore"):
                    mean = pa.array((sim / count)[out], mask=count[out] == 0)
                places, group = pa.array(out), pa.array(mine.row[out])
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(group) for i in range(2)), *(mine.items.field(c).take(places) for c in ("video_id", *beside)), mean], schema.names)

    # a pose without an athlete or contact is not compared, so its group only has to be small
    loose = F.when(lost, F.xxhash64("_pose.video_id")).otherwise(F.lit(0).cast("long"))
    done = few.groupBy(*key, loose.alias("_loose")).agg(F.collect_list("_pose").alias("_poses")).select(*key, "_poses").mapInArrow(alone, schema)
    if many is not None:
        done = done.unionByName(_crowded_pairs(many.filter(~lost), [*key, "video_id", *beside]))
        # those of a crowded athlete that have no contact
        odd = many.filter(lost & F.col("_pose._asks")).select(*key, "_pose.video_id", *[f"_pose.{c}" for c in beside], F.lit(None).cast("double").alias("vs_history"))
        done = done.unionByName(odd)
    return done


def _crowded_pairs(poses: DataFrame, columns: list[str]) -> DataFrame:
    """What :func:`_against_history` returns for contacts of several blocks."""
    key = ["athlete_id", "contact_index"]
    slot = F.pmod(F.xxhash64("_pose.video_id"), F.col("_slots"))
    blocks = poses.groupBy(*key, slot.alias("_slot")).agg(F.first("_slots").alias("_slots"), F.collect_list("_pose").alias("_poses"))
    vector = F.transform("_poses", lambda p: F.struct(p["video_id"].alias("video_id"), p["_asks"].alias("_asks"), p["_held"].alias("_held"), p["vec"].alias("vec")))
    bare = blocks.select(*key, "_slot", "_slots", vector.alias("_poses"))
    left = bare.select(*key, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_slots") - 1)).alias("_to"), F.col("_poses").alias("_a"))
    right = bare.select(*key, F.col("_slot").alias("_to"), F.col("_poses").alias("_b"))
    met = _meet(left, right, [*key, "_to"]).select(*key, "_a", "_b")
    fields = [*(poses.schema[c] for c in key), poses.schema["_pose"].dataType["video_id"]]
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in fields), T.StructField("_sim", T.DoubleType()), T.StructField("_cnt", T.LongType())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                mine, its = _Poses.of(batch.column(2)), _Poses.of(batch.column(3))
                codes = _codes(pa.concat_arrays([mine.ids, its.ids]))
                sim, count = mine.against(its, codes[: len(mine.row)], codes[len(mine.row) :])
                out = np.flatnonzero(mine.asks & (mine.sizes > 0))
                group = pa.array(mine.row[out])
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(group) for i in range(2)), mine.ids.take(pa.array(out)), pa.array(sim[out]), pa.array(count[out])], schema.names)

    sums = met.mapInArrow(compare, schema).groupBy(*key, "video_id").agg(F.sum("_sim").alias("_sim"), F.sum("_cnt").alias("_cnt"))
    means = sums.select(*key, "video_id", F.when(F.col("_cnt") > 0, F.col("_sim") / F.col("_cnt")).alias("vs_history"))
    asking = poses.filter("_pose._asks").select(*key, *[f"_pose.{c}" for c in columns if c not in key])
    return _meet(asking, means, [*key, "video_id"], "left").select(*columns, "vs_history")


def _codes(ids: pa.Array) -> np.ndarray:
    """Equal numbers for equal values; -1 for null."""
    return ids.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def _folded(cos: np.ndarray) -> np.ndarray:
    return np.where(cos < 0, (cos + 1.0) * 0.5, cos)


@dataclass
class _Poses:
    """Poses of lists side by side; ``row`` is the list of each, ``sizes`` the length of its vector (0: none)."""

    items: pa.StructArray
    row: np.ndarray
    sizes: np.ndarray
    starts: np.ndarray
    values: np.ndarray
    asks: np.ndarray
    held: np.ndarray

    @classmethod
    def of(cls, lists: pa.ListArray) -> _Poses:
        items = lists.flatten()
        vecs = items.field("vec")
        sizes = vecs.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        flags = (items.field(c).to_numpy(zero_copy_only=False) for c in ("_asks", "_held"))
        return cls(items, row, sizes, np.cumsum(sizes) - sizes, vecs.flatten().to_numpy(zero_copy_only=False), *flags)

    @property
    def ids(self) -> pa.Array:
        return self.items.field("video_id")

    def units(self, places: np.ndarray, width: int) -> np.ndarray:
        table = self.values[self.starts[places][:, None] + np.arange(width)]
        return table / np.sqrt(np.einsum("ij,ij->i", table, table))[:, None]

    def against(self, its: _Poses, codes: np.ndarray, its_codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum of each asking pose's similarities to the held ones of other takes in the same row of ``its``, and their number."""
        sim, count = np.zeros(len(self.row)), np.zeros(len(self.row), np.int64)
        rows = 1 + max(self.row.max(initial=-1), its.row.max(initial=-1))
        for width in np.unique(self.sizes[self.asks & (self.sizes > 0)]).tolist():
            mine, others = np.flatnonzero(self.asks & (self.sizes == width)), np.flatnonzero(its.held & (its.sizes == width))
            a, b, ca, cb = self.units(mine, width), its.units(others, width), codes[mine], its_codes[others]
            na, nb = np.bincount(self.row[mine], minlength=rows), np.bincount(its.row[others], minlength=rows)
            at_a, at_b, pairs = np.cumsum(na) - na, np.cumsum(nb) - nb, na * nb
            for r in np.flatnonzero(pairs > SMALL_PAIRS).tolist():
                x, y = slice(at_a[r], at_a[r] + na[r]), slice(at_b[r], at_b[r] + nb[r])
                sim[mine[x]], count[mine[x]] = _crossed(a[x], ca[x], b[y], cb[y])
            small = np.flatnonzero((pairs > 0) & (pairs <= SMALL_PAIRS))
            ends = np.cumsum(pairs[small])
            for some in np.split(small, np.searchsorted(ends, np.arange(PAIRS, ends[-1] if len(ends) else 0, PAIRS))):
                # all pairs of the small groups side by side
                many = na[some]
                owner = np.repeat(some, many)
                x = np.repeat(at_a[some] - (np.cumsum(many) - many), many) + np.arange(len(owner))
                n = nb[owner]
                left = np.repeat(np.arange(len(owner)), n)
                y = np.repeat(at_b[owner] - (np.cumsum(n) - n), n) + np.arange(len(left))
                mark = ca[x][left]
                other = (mark != cb[y]) | (mark < 0)
                score = _folded(np.einsum("ij,ij->i", a[x[left]], b[y]))
                if width != N_FEATURES:
                    score = np.minimum(score, 1.0)
                sim[mine[x]] = np.bincount(left, np.where(other, score, 0.0), len(x))
                count[mine[x]] = np.bincount(left, other, len(x)).astype(np.int64)
        return sim, count


def _crossed(a: np.ndarray, ca: np.ndarray, b: np.ndarray, cb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Similarities of each pose of ``a`` to those of ``b`` with another code, summed, and their number.

    Cosines add up to a dot product with the sum of all unit vectors less those of the own take.  What folding adds
    to negative ones needs pairs, but only where one pose has a negative feature.
    """
    _, both = np.unique(np.concatenate([ca, cb]), return_inverse=True)
    own_a, own_b = both[: len(ca)], both[len(ca) :]
    known = ca >= 0
    step = max(1, PAIRS // max(1, len(b)))
    if a.shape[1] != N_FEATURES:
        sim, count = np.zeros(len(a)), np.zeros(len(a), np.int64)
        for i in range(0, len(a), step):
            part = slice(i, i + step)
            other = (own_a[part, None] != own_b) | ~known[part, None]
            sim[part] = np.where(other, np.minimum(_folded(a[part] @ b.T), 1.0), 0.0).sum(axis=1)
            count[part] = other.sum(axis=1)
        return sim, count
    own = np.zeros((both.max() + 1, b.shape[1]))
    np.add.at(own, own_b, b)
    own, many = np.where(known[:, None], own[own_a], 0.0), np.where(known, np.bincount(own_b, minlength=len(own))[own_a], 0)
    sim, count = np.einsum("ij,ij->i", a, b.sum(axis=0) - own), len(b) - many
    plain_a, plain_b = (a >= 0).all(axis=1), (b >= 0).all(axis=1)
    for mine, its in ((np.flatnonzero(~plain_a), np.arange(len(b))), (np.flatnonzero(plain_a), np.flatnonzero(~plain_b))):
        for i in range(0, len(mine) if len(its) else 0, step):
            part = mine[i : i + step]
            cos = a[part] @ b[its].T
            other = (own_a[part, None] != own_b[its]) | ~known[part, None]
            sim[part] += np.where(other & (cos < 0), (1.0 - cos) * 0.5, 0.0).sum(axis=1)
    return sim, count


def contact_poses(sessions: DataFrame) -> DataFrame:
    """Sessions as one row per contact: contact_index, phase and vec."""
    pairs = F.arrays_zip(F.col("pose_vectors").alias("vec"), F.col("contact_phases").alias("phase"))
    return sessions.select(
        "athlete_id", "video_id", F.posexplode(pairs).alias("contact_index", "_p")
    ).select("athlete_id", "video_id", "contact_index", F.col("_p.phase").alias("phase"), F.col("_p.vec").alias("vec"))


def _cosine(a: Column, b: Column) -> Column:
    """:func:`vectors.cosine`, in generated code for vectors of the usual length."""
    usual = (F.size(a) == N_FEATURES) & (F.size(b) == N_FEATURES)
    na, nb = (F.sqrt(V.dot_fixed(v, v, N_FEATURES)) for v in (a, b))
    fixed = F.when((na >= 1e-9) & (nb >= 1e-9), V.dot_fixed(a, b, N_FEATURES) / (na * nb))
    return F.when(usual, fixed).otherwise(V.cosine(a, b))


def pose_consistency(current: DataFrame, history: DataFrame, templates: DataFrame) -> DataFrame:
    """Per contact: similarity to the athlete's template and to the history.

    Templates are gathered to a row per athlete, so a pose meets them and the athlete's other poses in one place.
    """
    wanted = templates.filter(
        (F.col("kind") == "phase") | ((F.col("kind") == "tag") & (F.col("key") == "hop_contact"))
    )
    mark = F.struct(F.col("key").alias("phase"), "centroid")
    marks = wanted.groupBy("athlete_id").agg(
        *[F.collect_list(F.when(F.col("kind") == k, mark)).alias(f"_{k}") for k in ("phase", "tag")]
    )
    rows = _meet(_both(current, history, "athlete_id", "contact_index", "video_id", "vec", "phase"), marks, "athlete_id", "left")
    none = F.array(F.lit(None).cast("array<double>"))

    def centroids(found):
        return F.when(F.size(found) > 0, F.transform(found, lambda t: t["centroid"])).otherwise(none)

    by_phase, by_tag = centroids(F.filter("_phase", lambda t: t["phase"] == F.col("phase"))), centroids(F.col("_tag"))
    # a row for each template, as a join has it; what is compared with it comes once
    compared = F.flatten(F.transform(by_phase, lambda p: F.transform(by_tag, lambda t: F.coalesce(p, t))))
    rows = rows.select("athlete_id", "contact_index", "video_id", "vec", "phase", "_asks", "_held", F.posexplode(compared).alias("_copy", "_to"))
    rows = rows.filter(F.col("_asks") | (F.col("_copy") == 0)).withColumn("_held", F.col("_held") & (F.col("_copy") == 0))
    rows = bind(rows, {"_cos": F.when(F.col("_asks"), _cosine(F.col("vec"), F.col("_to")))})
    rows = rows.withColumn("_own", F.when(F.col("_cos").isNotNull(), V.to_unit_range(F.col("_cos"))))
    rows = _against_history(rows, _crowded(current, history), "phase", "_own").withColumn("vs_history", F.when(F.col("video_id").isNotNull(), F.col("vs_history")))
    return rows.select(
        "athlete_id", "video_id", "contact_index", "phase",
        F.round("_own", 3).alias("vs_template"), F.round("vs_history", 3).alias("vs_history"),
        V.average(F.array("_own", "vs_history")).alias("score"),
    )


def timing_consistency(current: DataFrame, history: DataFrame) -> DataFrame:
    """Per interval: relative deviation from, and z-score in, the other sessions.

    Sums are exact decimals, so taking the own share off loses nothing.  Sessions meet the sums of their athlete
    whole, and the own share is summed up where they lie.
    """
    d = F.col("dt").cast("decimal(18,12)")
    square = (d * d).cast("decimal(38,24)")
    valid = F.col("dt").isNotNull() & ~F.isnan("dt")
    key = ["athlete_id", "interval_index"]
    past = history.select("athlete_id", F.posexplode("intervals_s").alias("interval_index", "dt")).filter(valid)
    sums = past.groupBy(*key).agg(F.sum(d).alias("s"), F.sum(square).alias("q"), F.count(F.lit(1)).alias("n"))
    every = sums.groupBy("athlete_id").agg(F.collect_list(F.struct("interval_index", "s", "q", "n")).alias("_every"))
    rows = _meet(_both(current, history, "athlete_id", "video_id", "intervals_s"), every, "athlete_id", "left")
    rows = rows.select("athlete_id", "video_id", "_asks", "_held", "_every", F.posexplode("intervals_s").alias("interval_index", "dt"))
    at = F.get(F.filter("_every", lambda e: e["interval_index"] == F.col("interval_index")), F.lit(0))
    take, held = Window.partitionBy(*key, "video_id"), F.col("_held") & valid & F.col("video_id").isNotNull()
    rows = rows.withColumn("_all", at).drop("_every").withColumns({
        "_own_s": F.sum(F.when(held, d)).over(take), "_own_q": F.sum(F.when(held, square)).over(take), "_own_n": F.count(F.when(held, 1)).over(take),
    }).filter("_asks")
    zero = F.lit(0)
    n = (F.col("_all.n") - F.col("_own_n")).cast("double")
    s = (F.col("_all.s") - F.coalesce(F.col("_own_s"), zero.cast("decimal(28,12)"))).cast("double")
    q = (F.col("_all.q") - F.coalesce(F.col("_own_q"), zero.cast("decimal(38,24)"))).cast("double")
    rows = rows.withColumns({"_n": n, "_s": s, "_q": q}).withColumn("_mean", F.when(F.col("_n") > 0, F.col("_s") / F.col("_n")))
    mean = F.col("_mean")
    std = F.sqrt(F.greatest(F.lit(0.0), F.col("_q") / F.col("_n") - mean * mean))
    return rows.select(
        "athlete_id", "video_id", "interval_index",
        F.round(F.when(F.abs(mean) > 1e-6, F.abs(F.col("dt") - mean) / mean), 3).alias("deviation"),
        F.round(
            F.when(F.col("dt").isNotNull() & mean.isNotNull(),
                   F.when(std > 1e-6, (F.col("dt") - mean) / std).otherwise(0.0)), 3
        ).alias("z"),
    )


def consistency(
    current: DataFrame, history: DataFrame, templates: DataFrame, digits: int = 3
) -> DataFrame:
    """Pose score, timing score and overall consistency per video with an athlete."""
    known = current.filter(F.col("athlete_id").isNotNull())
    history = known if current is history else history  # nobody is compared with sessions without an athlete
    key = ["athlete_id", "video_id"]
    poses = contact_poses(known)
    pose = pose_consistency(poses, poses if history is known else contact_poses(history), templates).groupBy(*key).agg(
        F.avg("score").alias("_pose")
    )
    timing = timing_consistency(known, history).groupBy(*key).agg(
        G.clamp(1.0 - F.avg("deviation"), 0.0, 1.0).alias("_timing")
    )
    n = history.groupBy("athlete_id").agg(F.count_distinct("video_id").alias("_sessions"))
    out = known.select(*key).distinct()
    if history is known:
        out = out.withColumn("_self", F.when(F.col("video_id").isNotNull(), 1))
    else:
        out = _meet(out, history.select(*key).distinct().withColumn("_self", F.lit(1)), key, "left")
    for side, on in ((pose, key), (timing, key), (n, ["athlete_id"])):
        out = _meet(out, side, on, "left")
    return out.select(
        *key,
        F.round("_pose", digits).alias("pose_score"),
        F.round("_timing", digits).alias("timing_score"),
        F.round(V.average(F.array("_pose", "_timing")), digits).alias("overall"),
        (F.coalesce("_sessions", F.lit(0)) - F.coalesce("_self", F.lit(0))).alias("sessions_compared"),
    )
