"""Registered queries: athlete choice (J14 - J16), tracking windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import appearance as AP
from ..operators import candidates as CD
from ..operators import frames as FR
from ..operators.sequence import progress
from ..functions import scores as S
from . import carriers as C
from .carriers import rnd, sql, view
from .frame_queries import analysed
from .registry import query

_AREA = "(x2 - x1) * (y2 - y1)"
view(
    "motion_v",
    f"""SELECT video_id, track_id, coalesce(sum(d), 0) AS motion_px, count(d) AS moves, max(r) AS last_r, min({{'f': frame_idx, 'd': det_id}}) FILTER (d IS NOT NULL) AS first FROM (
  SELECT *, abs(cx - lag(cx) OVER (PARTITION BY video_id, track_id ORDER BY frame_idx, det_id)) AS d FROM (
    SELECT video_id, frame_idx, det_id, track_id, (x1 + x2) / 2 AS cx, dense_rank() OVER (PARTITION BY video_id ORDER BY frame_idx) AS r FROM detections_v WHERE {_AREA} >= 4000) WHERE r <= 12) GROUP BY 1, 2""",
    "detections_v",
)
view(
    "lock_v",
    """SELECT video_id, min({'m': -motion_px, 'f': first, 't': track_id}) FILTER (moves > 0).t AS athlete_track_id, max(motion_px) FILTER (moves > 0) AS motion_px FROM motion_v GROUP BY 1 HAVING max(last_r) >= 12""".replace(
        "min({'m': -motion_px, 'f': first, 't': track_id}) FILTER (moves > 0).t", "(min({'m': -motion_px, 'f': first, 't': track_id}) FILTER (moves > 0)).t"
    ),
    "motion_v",
)


@query("a23_displacement", sql("SELECT video_id, track_id, round(motion_px, 4) AS motion_px FROM motion_v", "motion_v"))
def a23(spark, sf):
    return CD.displacement(C.detections(spark, sf)).select("video_id", "track_id", rnd(F.col("motion_px"), 4).alias("motion_px"))


@query("e16_motion_lock", sql("SELECT video_id, athlete_track_id, round(motion_px, 4) AS motion_px FROM lock_v", "lock_v"))
def e16(spark, sf):
    return CD.motion_lock(C.detections(spark, sf)).withColumn("motion_px", rnd(F.col("motion_px"), 4))


@query(
    "j16_choose_first_pass",
    sql(
        f"""SELECT video_id, frame_idx, CASE WHEN e IS NOT NULL THEN 'track' WHEN l IS NOT NULL THEN 'appearance' ELSE 'area' END AS rule, coalesce(e.d, l.d, a.d) AS det_id FROM (
  SELECT v.video_id, frame_idx, min({{'d': det_id}}) FILTER (track_id = athlete_track_id) AS e,
    min({{'k': -appearance_sim, 'd': det_id}}) FILTER (appearance_sim >= 0.45) AS l, min({{'k': -({_AREA}), 'd': det_id}}) AS a
  FROM detections_v v LEFT JOIN lock_v k ON k.video_id = v.video_id WHERE {_AREA} >= 4000 GROUP BY 1, 2)""",
        "detections_v", "lock_v",
    ),
)
def j16(spark, sf):
    d = C.detections(spark, sf)
    return CD.choose_first_pass(d, CD.motion_lock(d)).select("video_id", "frame_idx", "rule", "det_id")


_BLEND = "appearance_sim + 0.30 * track_ov + 0.20 * sand_ov"


@query(
    "j15_choose_refined",
    sql(
        f"""SELECT video_id, frame_idx, b.d AS det_id, round(-b.k, 6) AS score FROM (SELECT video_id, frame_idx, min({{'k': -({_BLEND}), 'd': det_id}}) AS b
FROM detections_v WHERE {_AREA} >= 4000 AND appearance_sim >= 0.20 GROUP BY 1, 2)""",
        "detections_v",
    ),
)
def j15(spark, sf):
    return CD.choose_refined(C.detections(spark, sf)).select("video_id", "frame_idx", "det_id", rnd(F.col("score")).alias("score"))


def expectations(spark, sf):
    """The box of the first detection of the frame as expectation; none on some frames."""
    d = C.detections(spark, sf)
    first = d.groupBy("video_id", "frame_idx").agg(F.min_by(CD.box_of(), "det_id").alias("expected"))
    k = F.col("frame_idx") / 3
    return first.select(
        "video_id", "frame_idx", F.when(k % 7 != 3, F.col("expected")).alias("expected"),
        F.when(k >= 45, "landing").when(k >= 15, "mid").otherwise("early").alias("zone"),
    )


view(
    "gap_scores_v",
    f"""SELECT *, (sim >= CASE WHEN iou >= 0.22 OR sand >= 0.25 OR track >= 0.28 THEN 0.04 ELSE 0.08 END OR iou >= 0.20 OR track >= 0.28
    OR (sim >= 0.04 AND (iou >= 0.12 OR track >= 0.18 OR sand >= 0.25))) AND NOT (known AND iou < 0.08 AND track < 0.15 AND dist > 0.08 AND sim < 0.22) AS ok,
  sim + 0.30 * track + CASE WHEN zone = 'landing' THEN 0.45 ELSE 0.20 END * sand + 0.50 * iou + CASE WHEN zone = 'landing' AND sand > 0 THEN 0.10 * sand ELSE 0 END
    + CASE WHEN known THEN 0.18 * greatest(0, 1 - dist * 4) ELSE 0 END - CASE WHEN known AND iou < 0.05 AND dist > 0.12 THEN 0.20 ELSE 0 END AS score FROM (
  SELECT *, CASE WHEN known AND inter > 0 THEN inter / (area + earea - inter) ELSE 0 END AS iou,
    CASE WHEN known THEN sqrt(((x1 + x2) / 2 - (ex1 + ex2) / 2)**2 + ((y1 + y2) / 2 - (ey1 + ey2) / 2)**2) / sqrt(1280**2 + 720**2) ELSE 0 END AS dist FROM (
    SELECT d.video_id, d.frame_idx, d.det_id, d.x1, d.y1, d.x2, d.y2, d.appearance_sim AS sim, d.track_ov AS track, d.sand_ov AS sand,
      (d.frame_idx // 3) % 7 <> 3 AS known, CASE WHEN d.frame_idx // 3 >= 45 THEN 'landing' WHEN d.frame_idx // 3 >= 15 THEN 'mid' ELSE 'early' END AS zone,
      e.x1 AS ex1, e.y1 AS ey1, e.x2 AS ex2, e.y2 AS ey2, (d.x2 - d.x1) * (d.y2 - d.y1) AS area, (e.x2 - e.x1) * (e.y2 - e.y1) AS earea,
      greatest(0, least(d.x2, e.x2) - greatest(d.x1, e.x1)) * greatest(0, least(d.y2, e.y2) - greatest(d.y1, e.y1)) AS inter
    FROM detections_v d JOIN (SELECT *, row_number() OVER (PARTITION BY video_id, frame_idx ORDER BY det_id) AS rn FROM detections_v) e
      ON e.video_id = d.video_id AND e.frame_idx = d.frame_idx AND e.rn = 1 WHERE (d.x2 - d.x1) * (d.y2 - d.y1) >= 600))""",
    "detections_v",
)


@query(
    "j14_choose_candidate",
    sql(
        """SELECT video_id, frame_idx, CASE WHEN near IS NOT NULL AND -top.i > -0.08 AND -near.s >= -top.s - 0.12 THEN near.d ELSE top.d END AS det_id FROM (
  SELECT video_id, frame_idx, min({'s': -score, 'd': det_id, 'i': iou}) AS top, min({'i': -iou, 's': -score, 'd': det_id}) FILTER (known AND iou >= 0.20) AS near
  FROM gap_scores_v WHERE ok GROUP BY 1, 2)""",
        "gap_scores_v",
    ),
)
def j14(spark, sf):
    return CD.choose_candidate(C.detections(spark, sf), expectations(spark, sf)).select("video_id", "frame_idx", "det_id")


@query(
    "e17_predict_box",
    sql(
        """SELECT f.video_id, f.frame_idx, round(b.x + (b.x - a.x) * (f.frame_idx - b.frame_idx) / (b.frame_idx - a.frame_idx) - a.w / 2, 4) AS px1,
  round(b.by2 + (b.by2 - a.by2) * (f.frame_idx - b.frame_idx) / (b.frame_idx - a.frame_idx), 4) AS py2 FROM (
  SELECT video_id, frame_idx, (SELECT max(frame_idx) FROM frames_v g WHERE g.video_id = f.video_id AND g.frame_idx < f.frame_idx AND g.person_detected) AS f1 FROM frames_v f) f
LEFT JOIN (SELECT *, (bx1 + bx2) / 2 AS x, bx2 - bx1 AS w, lag(frame_idx) OVER (PARTITION BY video_id ORDER BY frame_idx) AS f0 FROM frames_v WHERE person_detected) b ON b.video_id = f.video_id AND b.frame_idx = f.f1
LEFT JOIN (SELECT *, (bx1 + bx2) / 2 AS x, bx2 - bx1 AS w FROM frames_v WHERE person_detected) a ON a.video_id = f.video_id AND a.frame_idx = b.f0""",
        "frames_v",
    ),
)
def e17(spark, sf):
    f = C.frames(spark, sf).select("video_id", "frame_idx", "person_bbox")
    return CD.predict_box(f).select(
        "video_id", "frame_idx", rnd(F.col("predicted")[0], 4).alias("px1"), rnd(F.col("predicted")[3], 4).alias("py2")
    )


_NEXT = """CASE WHEN NOT f.person_detected THEN CASE WHEN r.c + 1 >= 10 OR r.s NOT IN ('AIR', 'FINAL_FLIGHT') THEN 'LOST' ELSE r.s END
  WHEN f.landing_overlap >= 0.25 THEN 'FINAL_FLIGHT' WHEN f.track_overlap >= 0.5 THEN 'GROUND'
  WHEN f.track_overlap >= 0.15 THEN CASE WHEN r.s IN ('AIR', 'FINAL_FLIGHT') THEN 'AIR' ELSE 'GROUND' END
  WHEN r.s = 'FINAL_FLIGHT' THEN 'FINAL_FLIGHT' WHEN r.s = 'LOST' THEN CASE WHEN r.c + 1 >= 10 THEN 'LOST' ELSE 'OFF_TRACK_NEAR' END
  WHEN r.c + 1 <= 10 THEN 'AIR' ELSE 'OFF_TRACK_NEAR' END"""
STATE_SQL = f"""WITH RECURSIVE n AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame_idx) AS i FROM frames_v),
  r AS (SELECT DISTINCT video_id, -1 AS frame_idx, 0::BIGINT AS i, 'LOST' AS s, 0 AS c FROM frames_v
    UNION ALL SELECT f.video_id, f.frame_idx, f.i, {_NEXT}, CASE WHEN f.person_detected AND (f.landing_overlap >= 0.25 OR f.track_overlap >= 0.15) THEN 0 ELSE r.c + 1 END
    FROM r JOIN n f ON f.video_id = r.video_id AND f.i = r.i + 1)
SELECT video_id, frame_idx, s AS athlete_state FROM r WHERE i > 0"""


def state_frames(spark, sf):
    return C.frames(spark, sf).select("video_id", "frame_idx", "person_bbox", "track_overlap", "landing_overlap")


@query("e18_athlete_state", sql(STATE_SQL, "frames_v"))
def e18(spark, sf):
    return CD.athlete_state(state_frames(spark, sf)).select("video_id", "frame_idx", "athlete_state")


@query(
    "e19_candidate_score",
    sql(
        f"""SELECT d.video_id, d.frame_idx, d.det_id, round(
  CASE WHEN track_ov > 0.5 AND coalesce(m.motion, 0) > 5 THEN 2.0 + track_ov ELSE 0 END + CASE WHEN sand_ov >= 0.25 THEN 1.5 + sand_ov ELSE 0 END
  + CASE WHEN coalesce(s.prev IN ('AIR', 'FINAL_FLIGHT'), false)
      THEN appearance_sim * 1.2 + coalesce(greatest(0, 1.5 - sqrt(power(p.x - (d.x1 + d.x2) / 2, 2) + power(p.y - (d.y1 + d.y2) / 2, 2)) / 108.0), 0)
      ELSE track_ov * 0.8 + appearance_sim * 0.5 + CASE WHEN coalesce(m.motion, 0) > 3 THEN least(m.motion / 200.0, 0.5) ELSE 0 END END, 6) AS track_score
FROM detections_v d
LEFT JOIN (SELECT video_id, frame_idx, coalesce(lag(athlete_state) OVER (PARTITION BY video_id ORDER BY frame_idx), 'LOST') AS prev FROM ({STATE_SQL})) s
  ON s.video_id = d.video_id AND s.frame_idx = d.frame_idx
LEFT JOIN (SELECT f.video_id, f.frame_idx, b.x + (b.x - a.x) * (f.frame_idx - b.frame_idx) / (b.frame_idx - a.frame_idx) AS x,
    b.by2 + (b.by2 - a.by2) * (f.frame_idx - b.frame_idx) / (b.frame_idx - a.frame_idx) - (a.by2 - a.by1) / 2 AS y FROM (
    SELECT video_id, frame_idx, (SELECT max(frame_idx) FROM frames_v g WHERE g.video_id = f.video_id AND g.frame_idx < f.frame_idx AND g.person_detected) AS f1 FROM frames_v f) f
  JOIN (SELECT *, (bx1 + bx2) / 2 AS x, lag(frame_idx) OVER (PARTITION BY video_id ORDER BY frame_idx) AS f0 FROM frames_v WHERE person_detected) b ON b.video_id = f.video_id AND b.frame_idx = f.f1
  JOIN (SELECT *, (bx1 + bx2) / 2 AS x FROM frames_v WHERE person_detected) a ON a.video_id = f.video_id AND a.frame_idx = b.f0) p
  ON p.video_id = d.video_id AND p.frame_idx = d.frame_idx
LEFT JOIN (SELECT video_id, track_id, sum(v) AS motion FROM (
    SELECT video_id, track_id, abs(cx - lag(cx) OVER (PARTITION BY video_id, track_id ORDER BY frame_idx, det_id)) AS v FROM (
      SELECT video_id, frame_idx, det_id, track_id, (x1 + x2) / 2 AS cx, dense_rank() OVER (PARTITION BY video_id ORDER BY frame_idx) AS r
      FROM detections_v WHERE (x2 - x1) * (y2 - y1) >= 4000) WHERE r <= 12) GROUP BY 1, 2) m
  ON m.video_id = d.video_id AND m.track_id = d.track_id""",
        "detections_v", "frames_v",
    ),
)
def e19(spark, sf):
    f = CD.previous_state(CD.athlete_state(state_frames(spark, sf)))
    guess = CD.predict_box(f)
    d = C.detections(spark, sf)
    motion = CD.displacement(d).select("video_id", "track_id", "motion_px")
    d = d.join(motion, ["video_id", "track_id"], "left").fillna({"motion_px": 0.0})
    return CD.candidate_score(d, guess).select("video_id", "frame_idx", "det_id", rnd(F.col("track_score")).alias("track_score"))


@query(
    "e22_expected_box",
    sql(
        """SELECT video_id, frame_idx, round(CASE WHEN lp IS NULL THEN rb WHEN rp IS NULL THEN lb ELSE lb + (rb - lb) * (i - lp) / (rp - lp) END, 4) AS ex1 FROM (
  SELECT n.*, (SELECT bx1 FROM n0 m WHERE m.video_id = n.video_id AND m.i = n.lp) AS lb, (SELECT bx1 FROM n0 m WHERE m.video_id = n.video_id AND m.i = n.rp) AS rb FROM (
    SELECT video_id, frame_idx, i, max(CASE WHEN person_detected THEN i END) OVER (PARTITION BY video_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lp,
      min(CASE WHEN person_detected THEN i END) OVER (PARTITION BY video_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS rp FROM n0) n)""".replace("n0", "numbered_v"),
        "numbered_v",
    )
    if view(
        "numbered_v", "SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame_idx) AS i FROM frames_v", "frames_v"
    )
    else None,
)
def e22(spark, sf):
    f = C.frames(spark, sf).select("video_id", "frame_idx", "person_detected", "person_bbox")
    return CD.expected_box(f).select("video_id", "frame_idx", rnd(F.col("expected")[0], 4).alias("ex1"))


@query(
    "e24_select_seeds",
    sql(
        """SELECT video_id, frame_idx, seed_rank FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY t NULLS LAST, quality_score DESC, frame_idx) AS seed_rank, count(t) OVER (PARTITION BY video_id) AS n FROM (
  SELECT *, CASE WHEN g AND frame_idx BETWEEN 30 AND 90 THEN 0 WHEN frame_idx BETWEEN 30 AND 90 THEN 1 WHEN g THEN 2 END AS t FROM (
    SELECT *, quality_score >= 0.65 AND camera_angle IN ('LATERAL', 'SEMI_BACK') AS g FROM quality_v WHERE person_detected))) WHERE seed_rank <= 15 AND (n = 0 OR t IS NOT NULL)""",
        "quality_v",
    ),
)
def e24(spark, sf):
    return CD.select_seeds(analysed(spark, sf), 15, (30, 90)).select("video_id", "frame_idx", "seed_rank")


@query(
    "e24_select_seeds_v2",
    sql(
        """SELECT video_id, frame_idx, seed_rank FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY t NULLS LAST, CASE WHEN manually_corrected THEN frame_idx ELSE 0 END, NOT manually_corrected, NOT mid, quality_score DESC, frame_idx) AS seed_rank, count(t) OVER (PARTITION BY video_id) AS n FROM (
  SELECT *, CASE WHEN manually_corrected THEN -1 WHEN quality_score >= 0.65 AND camera_angle IN ('LATERAL', 'SEMI_BACK') THEN 0 END AS t,
    frame_idx BETWEEN a + floor((b - a) * 0.30) AND a + floor((b - a) * 0.90) AS mid FROM (
    SELECT *, min(frame_idx) OVER (PARTITION BY video_id) AS a, max(frame_idx) OVER (PARTITION BY video_id) AS b FROM quality_v) WHERE person_detected)) WHERE seed_rank <= 15 AND (n = 0 OR t IS NOT NULL)""",
        "quality_v",
    ),
)
def e24_v2(spark, sf):
    return CD.select_seeds(analysed(spark, sf), 15, v2=True).select("video_id", "frame_idx", "seed_rank")


@query(
    "e29_reference_set",
    sql(
        f"""SELECT video_id, frame_idx, ref_age FROM (SELECT video_id, frame_idx, row_number() OVER (PARTITION BY video_id ORDER BY frame_idx DESC) AS ref_age FROM (
  SELECT video_id, frame_idx, (min({{'k': -({_BLEND}), 'd': det_id, 'c': conf, 'm': mask_area_px, 's': appearance_sim}})) AS b FROM detections_v
  WHERE {_AREA} >= 4000 AND appearance_sim >= 0.20 GROUP BY 1, 2) WHERE b.c >= 0.65 AND b.m > 8000 AND b.s >= 0.50) WHERE ref_age <= 20""",
        "detections_v",
    ),
)
def e29(spark, sf):
    return CD.reference_set(CD.choose_refined(C.detections(spark, sf))).select("video_id", "frame_idx", "ref_age")


@query(
    "e29_negative_set",
    sql(
        f"""SELECT video_id, frame_idx, det_id, neg_age FROM (SELECT d.video_id, d.frame_idx, d.det_id, row_number() OVER (PARTITION BY d.video_id ORDER BY d.frame_idx DESC, d.det_id DESC) AS neg_age
  FROM detections_v d JOIN (SELECT video_id, frame_idx, min({{'k': -({_BLEND}), 'd': det_id, 's': appearance_sim}}) AS b FROM detections_v
    WHERE {_AREA} >= 4000 AND appearance_sim >= 0.20 GROUP BY 1, 2) c ON c.video_id = d.video_id AND c.frame_idx = d.frame_idx AND c.b.s > 0.50 AND c.b.d <> d.det_id
  WHERE {_AREA} >= 4000) WHERE neg_age <= 15""",
        "detections_v",
    ),
)
def e29_negatives(spark, sf):
    d = C.detections(spark, sf)
    chosen = CD.choose_refined(d).withColumn("zone", F.lit("mid"))
    return AP.negative_set(d, chosen).select("video_id", "frame_idx", "det_id", "neg_age")


@query(
    "e29_readiness",
    sql(
        f"""SELECT v.video_id, least(count(b), 20)::BIGINT AS n_references, count(b) >= 2 AS ready FROM (SELECT DISTINCT video_id FROM detections_v) v LEFT JOIN (
  SELECT video_id, frame_idx, min({{'k': -({_BLEND}), 'd': det_id, 'c': conf, 'm': mask_area_px, 's': appearance_sim}}) AS b FROM detections_v
  WHERE {_AREA} >= 4000 AND appearance_sim >= 0.20 GROUP BY 1, 2) c ON c.video_id = v.video_id AND b.c >= 0.65 AND b.m > 8000 AND b.s >= 0.50 GROUP BY 1""",
        "detections_v",
    ),
)
def e29_readiness(spark, sf):
    d = C.detections(spark, sf)
    return AP.readiness(CD.reference_set(CD.choose_refined(d)), d)


def looks(spark, sf, d=None):
    """Detections with colour histograms of three zones: a pattern of the track, changed a little by each detection."""
    zones = [
        [F.pow(((F.col("track_id") * 31 + z * 17 + b * 7) % 11) / 10.0, 3) + 0.05 * F.col("appearance_sim") * ((b + z) % 2) for b in range(6)] for z in range(3)
    ]
    lower = F.when(F.col("track_id") == 4, F.array(*[F.lit(0.0)] * 6)).otherwise(F.array(*zones[2]))  # a zone without pixels
    return (d or C.detections(spark, sf)).withColumn("histogram", F.array(F.array(*zones[0]), F.array(*zones[1]), lower))


def seeds(spark, sf):
    """Histograms entered before the first frame: the largest detections of each video, and one other person."""
    largest = Window.partitionBy("video_id").orderBy(F.col("mask_area_px").desc(), "frame_idx", "det_id")
    ranked = C.detections(spark, sf).withColumn("seed_order", F.row_number().over(largest)).filter(F.col("seed_order") <= 4)
    return looks(spark, sf, ranked).select("video_id", "seed_order", (F.col("seed_order") < 4).alias("positive"), "histogram")


@query("e29_learned_first")
def e29_first(spark, sf):
    d = looks(spark, sf).withColumn("histogram", F.slice("histogram", 2, 1)).withColumn("track_score", F.col("track_ov"))
    return AP.learned_choice(d, "first", lock=CD.motion_lock(d))


@query("e29_learned_refined")
def e29_refined(spark, sf):
    d = looks(spark, sf)
    by_hand = d.filter((F.col("conf") > 0.99) & (F.col("det_id") == 1))
    return AP.learned_choice(d, "refined", seeds(spark, sf), by_hand)


@query("e29_learned_v2")
def e29_v2(spark, sf):
    return AP.learned_choice(looks(spark, sf), "v2", seeds(spark, sf))


@query("e21_refine_v2_select")
def e21(spark, sf):
    d = C.detections(spark, sf)
    return CD.refine_v2_select(d.select("video_id", "frame_idx").distinct(), d)


def primary(spark, sf):
    """Primary pass for the gap fill: the refined choice, missing on some frames."""
    d = C.detections(spark, sf)
    all_frames = d.select("video_id", "frame_idx").distinct()
    best = CD.choose_refined(d).filter(F.col("score") >= 0.9)
    j = all_frames.join(best, ["video_id", "frame_idx"], "left")
    return j.select(
        "video_id", "frame_idx", F.col("det_id").isNotNull().alias("person_detected"),
        F.when(F.col("det_id").isNotNull(), CD.box_of()).alias("person_bbox"),
        (F.coalesce("conf", F.lit(0.0)) * 0.6).alias("quality_score"), "appearance_sim",
    )


@query("e23_gap_fill")
def e23(spark, sf):
    return CD.gap_fill(primary(spark, sf), C.detections(spark, sf))


@query("a16_gap_fill_stats")
def a16(spark, sf):
    base = primary(spark, sf)
    fills = CD.gap_fill(base, C.detections(spark, sf)).select("video_id", "frame_idx", "fill_action")
    j = progress(base.join(fills, ["video_id", "frame_idx"], "left"))  # one fill a frame at most
    return FR.gap_fill_stats(
        j.withColumns(
            {
                "is_anchor": F.col("person_detected") & (S.zone(F.col("progress")) == "mid"),
                "person_detected": F.col("person_detected") | F.col("fill_action").isNotNull(),
                "tracking_source": F.when(F.col("fill_action").isNotNull(), "refined_v2_bbox_only").otherwise("refined_v2"),
            }
        )
    )
