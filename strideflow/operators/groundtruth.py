"""Ground-truth samples: upkeep, seeding and choice of reference poses."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import pose as P
from ..functions import vectors as V
from ..functions.vectors import EMPTY_DISTANCE
from ..schemas import CONTACT_PHASES, USABLE_ANGLES
from ..session import cut_lineage
from .joins import nearest_frame
from .prototypes import QUALITY_MIN

OVERLAY_ANGLES = (*USABLE_ANGLES, "SEMI_FRONT")
SNAP = 6


def upsert_gt(gt: DataFrame, samples: DataFrame, unique_phase_per_video: bool = False) -> DataFrame:
    """Insert or replace samples by (video, frame, phase).

    With ``unique_phase_per_video`` a new sample also replaces every other one
    of its (video, phase).  Of several new samples the highest ``seq`` counts.
    """
    if "seq" not in samples.columns:
        samples = samples.withColumn("seq", F.lit(0))
    key = ["video_id", "phase"] if unique_phase_per_video else ["video_id", "frame_idx", "phase"]
    rest = [c for c in samples.columns if c not in key and c != "seq"]
    newest = samples.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct("seq", *(["frame_idx"] if "frame_idx" in rest else []))).alias("s"))
    newest = newest.select(*key, "s.*")
    kept = gt.join(newest.select(*key), key, "left_anti")
    return kept.unionByName(newest, allowMissingColumns=True)


def gt_samples(frames: DataFrame, markers: DataFrame, source: str = "manual_mark") -> DataFrame:
    """Confirmed contact markers as samples, where the frame shows a usable pose."""
    m = markers.filter(F.col("phase").isin(*CONTACT_PHASES))
    j = m.join(
        frames.filter("person_detected").select("video_id", "frame_idx", "pose", "camera_angle"), ["video_id", "frame_idx"]
    ).filter(F.col("pose.valid") & (F.col("pose.quality") >= QUALITY_MIN))
    landing = F.col("phase") == "landing"
    tag = F.coalesce("pose_tag", F.when(landing, "landing").otherwise("hop_contact"))
    athlete = F.col("athlete_id") if "athlete_id" in m.columns else F.lit(None).cast("string")
    return j.select(
        athlete.alias("athlete_id"), "video_id", "frame_idx", "phase",
        F.when(landing & (tag == "hop_contact"), "landing").otherwise(tag).alias("pose_tag"),
        F.when(landing, "sand").otherwise("track").alias("surface"),
        P.pose_vector().alias("feature_vector"), F.round("pose.quality", 3).alias("quality_score"),
        "camera_angle", F.lit(source).alias("source"),
    )


def append_gt(gt: DataFrame, frames: DataFrame, markers: DataFrame, source: str = "manual_mark") -> DataFrame:
    return upsert_gt(gt, gt_samples(frames, markers, source), unique_phase_per_video=True)


def prefer_pass(frames: DataFrame, seeds: DataFrame) -> DataFrame:
    """The analysis pass of a video with the best frames at its seeds.

    Mean quality of the snapped seed frames, plus 0.05 for the refined pass.
    """
    passes = frames.select("video_id", "pass").distinct()
    wanted = seeds.join(passes, "video_id").select("video_id", "pass", F.col("frame_idx").alias("target"))
    snapped = nearest_frame(wanted, frames, SNAP, keys=("video_id", "pass"), target="target", out="frame_idx")
    scored = snapped.join(
        frames.select("video_id", "pass", "frame_idx", P.ground_truth_quality().alias("_q")), ["video_id", "pass", "frame_idx"], "left"
    ).groupBy("video_id", "pass").agg(F.array_sort(F.collect_list(F.when(F.col("_q").isNotNull(), F.struct("target", "_q")))).alias("_s"))
    # a few seeds a video, added in their order: passes may be equal but for the last bit, and reruns must agree
    scored = scored.withColumn("_m", F.when(F.size("_s") > 0, V.total(F.col("_s._q")) / F.size("_s")))
    score = F.when(F.col("_m").isNull(), 0.01).otherwise(F.col("_m") + F.when(F.col("pass") == "refined", 0.05).otherwise(0.0))
    best = scored.groupBy("video_id").agg(F.max(F.struct(score.alias("score"), "pass")).alias("b"))
    return best.select("video_id", F.col("b.pass").alias("pass"), F.col("b.score").alias("score"))


def seed_gt(seeds: DataFrame, frames: DataFrame, markers: DataFrame | None = None) -> DataFrame:
    """Samples for a seed list: the marker's frame first, else the seed's own.

    A target is snapped to a frame at most six away; an empty frame is replaced
    by the closest one within three that shows the person (earlier side first).
    """
    base = seeds.select("video_id", "phase", F.col("frame_idx").alias("seed_idx"), "surface", F.lit(1).alias("try"), F.col("frame_idx").alias("target"))
    if markers is not None:
        firm = markers.filter(
            F.col("phase").isin(*CONTACT_PHASES)
            & (F.col("source").isin("manual", "propagated") | (F.coalesce("confidence", F.lit(0.0)) >= 0.9))
        ).groupBy("video_id", "phase").agg(F.max("frame_idx").alias("_m"))
        over = base.join(firm, ["video_id", "phase"]).withColumn("target", F.col("_m")).withColumn("try", F.lit(0)).drop("_m")
        base = over.unionByName(base)
    snapped = nearest_frame(base, frames, SNAP, target="target", out="_snap").filter(F.col("_snap").isNotNull())
    steps = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(o).alias("o")) for r, o in enumerate((0, -1, 1, -2, 2, -3, 3))])
    # The snapped frame itself first; the others are steps around the target.
    near = snapped.select("*", F.inline(steps)).withColumn(
        "frame_idx", F.when(F.col("r") == 0, F.col("_snap")).otherwise(F.col("target") + F.col("o"))
    )
    seen = near.join(
        frames.filter("person_detected").select("video_id", "frame_idx", "pose", "camera_angle"), ["video_id", "frame_idx"]
    )
    item = F.struct("frame_idx", "pose", "camera_angle")
    first = seen.groupBy("video_id", "phase", "seed_idx", "surface", "try").agg(F.min_by(item, "r").alias("f"))
    usable = first.filter("f.pose.valid").groupBy("video_id", "phase", "seed_idx", "surface").agg(F.min_by("f", "try").alias("f"))
    vec = F.transform(F.col("f.pose.vector"), lambda v: F.round(v, 4))
    return usable.select(
        "video_id", F.col("f.frame_idx").alias("frame_idx"), "phase",
        F.when(F.col("phase") == "landing", "landing").otherwise("hop_contact").alias("pose_tag"),
        F.coalesce("surface", F.lit("unknown")).alias("surface"), vec.alias("feature_vector"),
        F.round("f.pose.quality", 3).alias("quality_score"), F.col("f.camera_angle").alias("camera_angle"),
        F.lit("seed_gt").alias("source"),
    )


#: Poses of a block; a block of asked poses meets one of samples at once.
POSE_BLOCK = 2048
#: Asked poses of a block that are compared side by side.
SIDE = 256


def reference_pose(current: DataFrame, gt: DataFrame) -> DataFrame:
    """Reference sample for each (video, phase) with the current vector ``vec``.

    Preference: same phase before same tag, other videos before the own one,
    usable angles, higher quality, then the closest vector.  A final flight uses
    landing samples, then hop_4.  All but the distance is settled without pairs:
    a pool's best class for all videos but the first holder of it, and for that
    one.  Only samples of the class that counts are compared, block by block.
    """
    final = F.col("phase") == "final_flight"
    first = F.when(final, "phase:landing").otherwise(F.concat(F.lit("phase:"), F.col("phase")))
    other = F.when(final, "phase:hop_4").otherwise("tag:hop_contact")
    samples = cut_lineage(gt.select("video_id", "frame_idx", "phase", "pose_tag", "feature_vector", "camera_angle", "quality_score"))
    pools = samples.select(
        "video_id", "frame_idx", "feature_vector",
        F.explode(F.array(F.concat(F.lit("phase:"), F.col("phase")), F.concat(F.lit("tag:"), F.coalesce("pose_tag", F.lit(""))))).alias("pool"),
        F.struct(F.col("camera_angle").isin(*OVERLAY_ANGLES).cast("int").alias("_ok"), F.coalesce("quality_score", F.lit(0.0)).alias("_q")).alias("_c"),
    )
    # Only the best (angle, quality) class of a pool can win; the own video may
    # hold it alone, so the best class outside each video is kept as well.
    per_video = pools.groupBy("pool", "video_id").agg(F.max("_c").alias("_best"))
    tops = per_video.groupBy("pool").agg(
        F.max("_best").alias("_b1"), F.max_by("video_id", F.struct("_best", "video_id")).alias("_v1")
    )
    second = per_video.join(tops, "pool").filter(F.col("video_id") != F.col("_v1")).groupBy("pool").agg(F.max("_best").alias("_b2"))
    tops = cut_lineage(tops.join(second, "pool", "left"))  # a row per phase and tag
    refs = pools.join(tops, "pool").filter((F.col("_c") == F.col("_b1")) | (F.col("_c") == F.col("_b2"))).select(
        "pool", "_c", F.col("video_id").alias("ref_video"), F.col("frame_idx").alias("ref_frame"), F.col("feature_vector").alias("vec")
    )
    # The second pool counts only where the first is empty.
    top = F.struct("pool", "_b1", "_b2", "_v1")
    asked = current.select("video_id", "phase", "vec", first.alias("_p0"), other.alias("_p1"))
    for i in (0, 1):
        asked = asked.join(tops.select(F.col("pool").alias(f"_p{i}"), top.alias(f"_t{i}")), f"_p{i}", "left")
    asked = asked.withColumn("_t", F.coalesce("_t0", "_t1")).filter("_t is not null")
    mine = F.coalesce(F.col("_t._v1") == F.col("video_id"), F.lit(False))
    asked = asked.select(
        "video_id", "phase", "vec", F.col("_t.pool").alias("pool"), (mine & F.col("_t._b2").isNull()).alias("_alone"),
        F.when(mine, F.coalesce("_t._b2", "_t._b1")).otherwise(F.col("_t._b1")).alias("_c"),
    )
    best = _closest(asked, refs).groupBy("video_id", "phase").agg(F.min(F.struct("distance", "ref_video", "ref_frame")).alias("b"))
    return best.select("video_id", "phase", "b.ref_video", "b.ref_frame", "b.distance")


def _closest(asked: DataFrame, refs: DataFrame) -> DataFrame:
    """For each asked pose the closest sample of every block of its pool and class, other videos only unless ``_alone``."""
    key = ["pool", "_c"]

    def blocks(rows: DataFrame, prefix: str, names: list[str], apart: list[str]) -> DataFrame:
        wide = F.when(F.col("vec").isNull(), -1).otherwise(F.size("vec")).alias(f"{prefix}_m")
        sized = rows.select(*key, *apart, *names, wide, F.coalesce("vec", F.array().cast("array<double>")).alias("vec"))
        slots = rows.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / POSE_BLOCK).alias("_slots"))
        placed = sized.join(slots, key).withColumn(f"{prefix}_slot", F.pmod(F.xxhash64(*names), F.col("_slots"))).drop("_slots")
        # in order, so that the first of equally close samples is the one that counts
        listed = placed.groupBy(*key, f"{prefix}_slot", f"{prefix}_m", *apart).agg(F.array_sort(F.collect_list(F.struct(*names, "vec"))).alias("_r"))
        return listed.select(
            *key, f"{prefix}_slot", f"{prefix}_m", *apart, *[F.col(f"_r.{n}").alias(n) for n in names], F.flatten(F.col("_r.vec")).alias(f"{prefix}_u")
        )

    left, right = blocks(asked, "_a", ["video_id", "phase"], ["_alone"]), blocks(refs, "_b", ["ref_video", "ref_frame"], [])
    many = refs.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / POSE_BLOCK).alias("_n"))
    left = left.join(many, key).withColumn("_b_slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    met = left.join(right.hint("merge"), [*key, "_b_slot"]).select("video_id", "phase", "_a_m", "_a_u", "_alone", "ref_video", "ref_frame", "_b_m", "_b_u")
    schema = T.StructType([
        *[T.StructField(n, df.schema[n].dataType) for df, n in ((asked, "video_id"), (asked, "phase"), (refs, "ref_video"), (refs, "ref_frame"))],
        T.StructField("distance", T.DoubleType()),
    ])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                ids, phases, videos, frames = (row.column(i).flatten() for i in (0, 1, 5, 6))
                wide = [row.column(i)[0].as_py() for i in (2, 7)]
                a, b = (row.column(i).flatten().to_numpy(zero_copy_only=False).reshape(size, max(w, 0)) for i, size, w in ((3, len(ids), wide[0]), (8, len(videos), wide[1])))
                codes = pa.concat_arrays([ids, videos]).dictionary_encode().indices.to_numpy(zero_copy_only=False)
                alone = row.column(4)[0].as_py()
                for low in range(0, len(ids), SIDE):
                    part = a[low : low + SIDE]
                    dist = np.full((len(part), len(b)), 0.0 if min(wide) else EMPTY_DISTANCE)
                    for k in range(min(wide)):
                        step = part[:, k, None] - b[None, :, k]
                        dist += step * step
                    if min(wide) > 0:
                        np.sqrt(dist, out=dist)
                    own = (codes[low : low + len(part), None] == codes[None, len(ids) :]) & (not alone)
                    pick = np.where(own, np.inf, np.fmin(dist, np.finfo(float).max)).argmin(axis=1)
                    kept = np.flatnonzero(~own.all(axis=1))
                    of, to = pa.array(kept + low), pa.array(pick[kept])
                    yield pa.RecordBatch.from_arrays([ids.take(of), phases.take(of), videos.take(to), frames.take(to), pa.array(dist[kept, pick[kept]])], schema.names)

    return met.mapInArrow(compare, schema)


def mid_flight_reference(gt: DataFrame, frames: DataFrame) -> DataFrame:
    """Per video the frame in the middle of its final flight, with a usable pose.

    One row per video that has hop_4 and landing more than two frames apart;
    callers take the first video that is not their own.
    """
    ends = gt.groupBy("video_id").agg(
        *[F.max(F.when(F.col("phase") == p, F.col("frame_idx"))).alias(a) for p, a in (("hop_4", "_a"), ("landing", "_b"))]
    ).filter(F.col("_b") > F.col("_a") + 2)
    mid = ends.select("video_id", (F.col("_a") + F.floor((F.col("_b") - F.col("_a")) / 2)).cast("int").alias("target"))
    near = nearest_frame(mid, frames, 8, target="target", out="frame_idx").filter(F.col("frame_idx").isNotNull())
    j = near.join(frames.select("video_id", "frame_idx", "keypoints"), ["video_id", "frame_idx"])
    hips = P.keypoint("l_hip", P.CONF_FEATURE).isNotNull() & P.keypoint("r_hip", P.CONF_FEATURE).isNotNull()
    ankle = P.keypoint("l_ankle", P.CONF_FEATURE).isNotNull() | P.keypoint("r_ankle", P.CONF_FEATURE).isNotNull()
    return j.filter(hips & ankle).select("video_id", "frame_idx", "keypoints")


def mid_flight_choice(videos: DataFrame, references: DataFrame) -> DataFrame:
    """Each video with the first reference of another video (``ref_video``, ``ref_frame``, ``ref_keypoints``).

    Only the first two references can be chosen, so two rows are all that meets the videos.
    """
    first = references.orderBy("video_id").limit(2).select(
        F.col("video_id").alias("ref_video"), F.col("frame_idx").alias("ref_frame"), F.col("keypoints").alias("ref_keypoints")
    )
    met = videos.select("video_id").join(F.broadcast(first), F.col("video_id") != F.col("ref_video"))
    best = met.groupBy("video_id").agg(F.min_by(F.struct("ref_video", "ref_frame", "ref_keypoints"), "ref_video").alias("b"))
    return best.select("video_id", "b.*")


def _hips(kps: str):
    l, r = P.keypoint("l_hip", P.CONF_FEATURE, kps), P.keypoint("r_hip", P.CONF_FEATURE, kps)
    return (l.x + r.x) * 0.5, (l.y + r.y) * 0.5


def align_pose(df: DataFrame, ref: str = "ref_keypoints", cur: str = "keypoints", out: str = "aligned") -> DataFrame:
    """Reference keypoints moved and scaled onto the current hips; empty if too small."""
    joints = ("l_ankle", "r_ankle", "l_knee", "r_knee", "l_shoulder", "r_shoulder")

    def measured(kps, p):
        hx, hy = _hips(kps)
        return {f"_{p}x": hx, f"_{p}y": hy}

    step = P.bind(df, {**measured(cur, "c"), **measured(ref, "r")})

    def size(kps, p):
        pts = [P.keypoint(n, P.CONF_FEATURE, kps) for n in joints]
        return F.greatest(*[F.hypot(k.x - F.col(f"_{p}x"), k.y - F.col(f"_{p}y")) for k in pts])

    step = P.bind(step, {"_cs": size(cur, "c"), "_rs": size(ref, "r")})
    ratio = F.col("_cs") / F.col("_rs")
    moved = F.transform(
        F.filter(F.col(ref), lambda k: k["conf"] >= P.CONF_FEATURE),
        lambda k: F.struct(
            k["name"].alias("name"), (F.col("_cx") + (k["x"] - F.col("_rx")) * ratio).alias("x"),
            (F.col("_cy") + (k["y"] - F.col("_ry")) * ratio).alias("y"),
        ),
    )
    ok = (F.col("_cs") >= 8) & (F.col("_rs") >= 8)
    return step.withColumn(out, F.when(ok, moved).otherwise(F.slice(moved, 1, 0))).drop(
        "_cx", "_cy", "_rx", "_ry", "_cs", "_rs"
    )


def phase_frame(quality: DataFrame, contacts: DataFrame) -> DataFrame:
    """Frame shown for each hop and for the final flight of a video.

    ``quality``: rows of the pose-quality operator.  A hop uses its scored frame,
    else its contact; the flight the sample closest to the middle, else the middle.
    """
    hops = quality.select("video_id", F.inline(F.transform("hops", lambda h: F.struct(h["phase"].alias("phase"), h["frame_idx"].alias("_s")))))
    own = contacts.filter(F.col("phase").startswith("hop_")).select("video_id", "phase", F.col("frame_idx").alias("_c"))
    by_hop = hops.join(own, ["video_id", "phase"], "full_outer").select(
        "video_id", "phase", F.coalesce("_s", "_c").alias("frame_idx")
    )
    ends = contacts.groupBy("video_id").agg(
        F.min(F.when(F.col("phase") == "hop_4", F.col("frame_idx"))).alias("_a"),
        F.min(F.when(F.col("phase") == "landing", F.col("frame_idx"))).alias("_b"),
    )
    j = ends.join(quality.select("video_id", "from_frame", "to_frame", "samples"), "video_id", "left")
    a, b = F.coalesce("from_frame", "_a"), F.coalesce("to_frame", "_b")
    mid = (a + F.floor((b - a) / 2)).cast("int")
    near = F.array_min(F.transform("samples", lambda s: F.struct(F.abs(s["frame_idx"] - mid).alias("d"), s["frame_idx"].alias("f"))))
    flight = j.select("video_id", F.lit("final_flight").alias("phase"), F.coalesce(near["f"], mid).alias("frame_idx"))
    return by_hop.unionByName(flight).filter(F.col("frame_idx").isNotNull())

