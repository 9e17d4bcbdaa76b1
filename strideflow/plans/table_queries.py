"""Registered queries: ground truth (K5 - K7, J18 - J20, J23), edits (M, U, K2 - K4), label export (K9, K10,
E25, S7), venue colours (A10, A11, A21, A22, A24, F32, F33, F45), catalogue (S8, S9, A12, A13, A18, L1, O1, O4)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..operators import edits as ED
from ..operators import frames as FR
from ..operators import groundtruth as GT
from ..operators import library as LB
from ..operators import masks as M
from ..operators import metrics as MT
from ..operators import venue as VN
from ..schemas import KEYPOINTS
from ..session import cut_lineage
from ..sources import readers as RD
from ..sources import writers as WR
from . import carriers as C
from .carriers import rnd, sql, view
from .frame_queries import analysed, posed
from .registry import query
from .vector_queries import proto_source, prototypes

# ------------------------------------------------------------ ground truth


def new_samples(spark, sf):
    """Replacement samples: each known one moved to the next frame or kept."""
    gt = proto_source(spark, sf).filter(F.col("quality_score") >= 1.0)
    return gt.withColumn("source", F.lit("manual_mark"))


@query(
    "k5_upsert_gt",
    sql(
        """SELECT video_id, frame_idx, phase, CASE WHEN quality_score >= 1.0 THEN 'manual_mark' ELSE 'seed' END AS source FROM gt_v""", "gt_v"
    ),
)
def k5(spark, sf):
    return GT.upsert_gt(proto_source(spark, sf), new_samples(spark, sf)).select("video_id", "frame_idx", "phase", "source")


@query(
    "k5_upsert_gt_unique",
    sql(
        """SELECT video_id, frame_idx, phase, 'seed' AS source FROM gt_v g WHERE NOT EXISTS (SELECT 1 FROM gt_v n WHERE n.quality_score >= 1.0 AND n.video_id = g.video_id AND n.phase = g.phase)
UNION ALL SELECT video_id, max(frame_idx), phase, 'manual_mark' FROM gt_v WHERE quality_score >= 1.0 GROUP BY video_id, phase""",
        "gt_v",
    ),
)
def k5_unique(spark, sf):
    return GT.upsert_gt(proto_source(spark, sf), new_samples(spark, sf), True).select("video_id", "frame_idx", "phase", "source")


def gt_markers(spark, sf):
    k = F.floor(F.col("frame_idx") / 3)
    names = F.array(*[F.lit(p) for p in ("hop_1", "final_jump", "landing", "hop_4")])
    return C.frames(spark, sf).select(
        "video_id", "frame_idx", F.get(names, (k % 4).cast("int")).alias("phase"),
        F.when(k % 3 == 0, "hop_contact").alias("pose_tag"), F.lit("manual").alias("source"), F.lit(1.0).alias("confidence"),
    )


_SAMPLES_SQL = """SELECT video_id, frame_idx, phase, CASE WHEN phase = 'landing' THEN 'landing' ELSE 'hop_contact' END AS pose_tag, CASE WHEN phase = 'landing' THEN 'sand' ELSE 'track' END AS surface, pose_quality AS quality_score
FROM (SELECT *, ['hop_1', 'final_jump', 'landing', 'hop_4'][(frame_idx // 3) % 4 + 1] AS phase FROM pose_vec_v) WHERE phase <> 'final_jump' AND person_detected AND valid AND pose_quality >= 0.35"""


@query("k6_gt_samples", sql(_SAMPLES_SQL, "pose_vec_v"))
def k6_samples(spark, sf):
    return GT.gt_samples(posed(spark, sf), gt_markers(spark, sf)).select(
        "video_id", "frame_idx", "phase", "pose_tag", "surface", "quality_score"
    )


@query(
    "k6_append_gt",
    sql(
        f"""WITH s AS ({_SAMPLES_SQL}), n AS (SELECT video_id, phase, max(frame_idx) AS frame_idx FROM s GROUP BY 1, 2)
SELECT s.* FROM s JOIN n ON n.video_id = s.video_id AND n.phase = s.phase AND n.frame_idx = s.frame_idx
UNION ALL SELECT v.video_id, -5, p.phase, 'old', 'track', 0.5::DOUBLE FROM (SELECT DISTINCT video_id FROM pose_vec_v) v, (SELECT unnest(['hop_1', 'hop_2', 'landing']) AS phase) p
WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.video_id = v.video_id AND n.phase = p.phase)""",
        "pose_vec_v",
    ),
)
def k6(spark, sf):
    f = posed(spark, sf)
    old = f.select("video_id").distinct().select(
        "video_id", F.lit(-5).alias("frame_idx"), F.explode(F.array(F.lit("hop_1"), F.lit("hop_2"), F.lit("landing"))).alias("phase"),
        F.lit("old").alias("pose_tag"), F.lit("track").alias("surface"), F.lit(0.5).alias("quality_score"),
    )
    return GT.append_gt(old, f, gt_markers(spark, sf)).select("video_id", "frame_idx", "phase", "pose_tag", "surface", "quality_score")


def gt_seeds(spark, sf):
    f = C.frames(spark, sf).filter(F.col("frame_idx").isin(31, 60, 87, 111, 138))
    return f.select(
        "video_id", F.when(F.col("frame_idx") == 138, "landing").otherwise(F.concat(F.lit("hop_"), F.floor(F.col("frame_idx") / 29 - 1).cast("int").cast("string"))).alias("phase"),
        (F.col("frame_idx") + 1).alias("frame_idx"), F.lit("track").alias("surface"),
    )


@query("k7_seed_gt")
def k7(spark, sf):
    return GT.seed_gt(gt_seeds(spark, sf), posed(spark, sf), gt_markers(spark, sf).filter("frame_idx = 84"))


@query(
    "m6_stamp_scale",
    sql(
        """SELECT video_id, frame_idx, CASE WHEN CAST(video_id AS INTEGER) % 2 = 0 AND frame_idx = min(frame_idx) OVER (PARTITION BY video_id) THEN 7.5 ELSE known_distance_m END::DOUBLE AS known_distance_m FROM keyframes_v
UNION ALL SELECT 'no keyframes', 0, 7.5""",
        "keyframes_v",
    ),
)
def m6_scale(spark, sf):
    k = C.keyframes(spark, sf)
    some = k.filter(F.col("video_id").cast("int") % 2 == 0).select("video_id").distinct()
    known = F.struct(F.lit(7.5).alias("known_distance_m"), *[F.lit(0.5).alias(c) for c in ("ax", "ay", "bx", "by")])
    scales = some.union(spark.createDataFrame([("no keyframes",)], "video_id string")).withColumn("scale", known)
    return ED.stamp_scale(k, scales).select("video_id", "frame_idx", F.col("scale.known_distance_m").alias("known_distance_m"))


@query(
    "m6_venue_corridor",
    "SELECT CAST(n_nationkey AS VARCHAR) AS venue_id, coalesce((SELECT max(s_acctbal) FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 0), 10.0) AS scale_m FROM nation",
)
def m6_corridor(spark, sf):
    venues = C.table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("venue_id"), F.lit(10.0).alias("scale_m"))
    changed = C.table(spark, sf, "supplier").filter("s_acctbal > 0").select(F.col("s_nationkey").cast("string").alias("venue_id"), F.col("s_acctbal").alias("hops_corridor_m"))
    return ED.venue_corridor(venues, changed).select("venue_id", "scale_m")


@query(
    "j18_reference_pose",
    sql(
        """SELECT video_id, phase, b.v AS ref_video, b.f AS ref_frame, round(b.d, 6) AS distance FROM (
  SELECT a.video_id, a.phase, min({'t': c.tier, 'o': CASE WHEN c.video_id = a.video_id THEN 1 ELSE 0 END, 'a': -ok, 'q': -q, 'd': sqrt(list_sum(list_transform(range(1, 15), lambda i: (a.vec[i] - c.vec[i])**2))), 'v': c.video_id, 'f': c.frame_idx}) AS b
  FROM (SELECT video_id, phase, arg_min(feature_vector, frame_idx) AS vec FROM gt_v GROUP BY 1, 2) a
  JOIN (SELECT 0 AS tier, phase AS pool, * FROM gt_rank_v UNION ALL SELECT 1, 'any', * FROM gt_rank_v WHERE pose_tag = 'hop_contact') c ON c.pool = a.phase OR c.tier = 1 GROUP BY 1, 2)""",
        "gt_v", "gt_rank_v",
    )
    if view(
        "gt_rank_v",
        "SELECT video_id, frame_idx, phase, pose_tag, feature_vector AS vec, CASE WHEN camera_angle IN ('LATERAL', 'SEMI_BACK', 'SEMI_FRONT') THEN 1 ELSE 0 END AS ok, coalesce(quality_score, 0) AS q FROM gt_v",
        "gt_v",
    )
    else None,
)
def j18(spark, sf):
    gt = proto_source(spark, sf)
    now = gt.select("video_id", "phase", "frame_idx", F.col("feature_vector").alias("vec"))
    now = now.groupBy("video_id", "phase").agg(F.min_by("vec", "frame_idx").alias("vec"))
    return GT.reference_pose(now, gt).withColumn("distance", rnd(F.col("distance")))


view(
    "mid_flight_v",
    """SELECT video_id, frame_idx FROM (SELECT e.video_id, min({'d': abs(f.frame_idx - e.t), 'f': f.frame_idx}).f AS frame_idx FROM (
    SELECT video_id, max(frame_idx) FILTER (phase = 'hop_4') + (max(frame_idx) FILTER (phase = 'landing') - max(frame_idx) FILTER (phase = 'hop_4')) // 2 AS t FROM gt_v GROUP BY 1
    HAVING max(frame_idx) FILTER (phase = 'landing') > max(frame_idx) FILTER (phase = 'hop_4') + 2) e
  JOIN frames_v f ON f.video_id = e.video_id AND abs(f.frame_idx - e.t) <= 8 GROUP BY 1) n
WHERE EXISTS (SELECT 1 FROM frames_v f WHERE f.video_id = n.video_id AND f.frame_idx = n.frame_idx AND l_hip_c >= 0.35 AND r_hip_c >= 0.35 AND (l_ankle_c >= 0.35 OR r_ankle_c >= 0.35))""".replace("min({'d': abs(f.frame_idx - e.t), 'f': f.frame_idx}).f", "(min({'d': abs(f.frame_idx - e.t), 'f': f.frame_idx})).f"),
    "gt_v", "frames_v",
)


@query("j19_mid_flight_reference", sql("SELECT * FROM mid_flight_v", "mid_flight_v"))
def j19(spark, sf):
    return GT.mid_flight_reference(proto_source(spark, sf), C.frames(spark, sf)).select("video_id", "frame_idx")


@query(
    "j19_mid_flight_choice",
    sql(
        """SELECT v.video_id, r.video_id AS ref_video, r.frame_idx AS ref_frame FROM (SELECT DISTINCT video_id FROM frames_v) v JOIN mid_flight_v r
  ON r.video_id = (SELECT min(x.video_id) FROM mid_flight_v x WHERE x.video_id <> v.video_id)""",
        "mid_flight_v", "frames_v",
    ),
)
def j19_choice(spark, sf):
    refs = GT.mid_flight_reference(proto_source(spark, sf), C.frames(spark, sf))
    return GT.mid_flight_choice(C.frames(spark, sf).select("video_id").distinct(), refs).select("video_id", "ref_video", "ref_frame")


@query(
    "j20_prefer_pass",
    sql(
        """SELECT video_id, b.p AS pass, round(b.s, 6) AS score FROM (SELECT video_id, max({'s': CASE WHEN m IS NULL THEN 0.01 ELSE m + CASE WHEN pass = 'refined' THEN 0.05 ELSE 0 END END, 'p': pass}) AS b FROM (
  SELECT video_id, pass, avg((n).q) AS m FROM (SELECT s.video_id, f.pass, s.t, min({'d': abs(f.frame_idx - s.t), 'f': f.frame_idx, 'q': f.q}) AS n
    FROM (SELECT video_id, frame_idx + 1 AS t FROM frames_v WHERE frame_idx IN (31, 60, 87, 111, 138)) s
    JOIN (SELECT video_id, frame_idx, q, unnest(CASE WHEN frame_idx % 2 = 0 THEN ['first', 'refined'] ELSE ['first'] END) AS pass FROM (SELECT video_id, frame_idx, CASE WHEN NOT person_detected THEN 0 ELSE 0.4::DOUBLE
        + CASE WHEN camera_angle IN ('LATERAL', 'SEMI_BACK') THEN 0.35::DOUBLE ELSE 0 END + CASE WHEN usable_for_analysis THEN 0.15::DOUBLE ELSE 0 END
        + CASE WHEN camera_angle = 'LATERAL' THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN valid THEN 0.2::DOUBLE * pose_quality ELSE 0 END END AS q FROM pose_v)) f
      ON f.video_id = s.video_id AND abs(f.frame_idx - s.t) <= 6 GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY 1)""",
        "pose_v", "frames_v",
    ),
)
def j20(spark, sf):
    f = posed(spark, sf).withColumn("pass", F.lit("first"))
    both = f.unionByName(f.filter(F.col("frame_idx") % 2 == 0).withColumn("pass", F.lit("refined")))
    return GT.prefer_pass(both, gt_seeds(spark, sf)).withColumn("score", rnd(F.col("score")))


@query(
    "j23_phase_frame",
    sql(
        """SELECT video_id, phase, frame_idx FROM hop_scores_v
UNION ALL SELECT c.video_id, 'final_flight', coalesce((min({'d': abs(f.frame_idx - 124), 'f': f.frame_idx})).f, 124) FROM (SELECT DISTINCT video_id FROM contacts_v WHERE CAST(video_id AS INTEGER) % 4 <> 3) c
  LEFT JOIN flight_scores_v f ON f.video_id = c.video_id GROUP BY 1""",
        "hop_scores_v", "flight_scores_v", "contacts_v",
    ),
)
def j23(spark, sf):
    from .metric_queries import contacts, metric_frames

    rows = MT.contact_arrays(MT.enrich_contacts(contacts(spark, sf), metric_frames(spark, sf), poses=True))
    return GT.phase_frame(MT.pose_quality(rows, posed(spark, sf), prototypes(spark, sf)), contacts(spark, sf))


def _aligned_sql() -> str:
    """The reference's sure keypoints, moved and scaled onto the current hips."""
    def far(p):
        joints = ("l_ankle", "r_ankle", "l_knee", "r_knee", "l_shoulder", "r_shoulder")
        return f"greatest({', '.join(f'CASE WHEN {p}.{j}_c >= 0.35 THEN sqrt(({p}.{j}_x - {p}.hx)**2 + ({p}.{j}_y - {p}.hy)**2) END' for j in joints)})"

    hips = "SELECT *, CASE WHEN l_hip_c >= 0.35 AND r_hip_c >= 0.35 THEN (l_hip_x + r_hip_x) * 0.5 END AS hx, CASE WHEN l_hip_c >= 0.35 AND r_hip_c >= 0.35 THEN (l_hip_y + r_hip_y) * 0.5 END AS hy FROM frames_v"
    parts = " UNION ALL ".join(
        f"SELECT video_id, frame_idx, '{n}' AS name, chx + ({n}_x - hx) * cs / rs AS x, chy + ({n}_y - hy) * cs / rs AS y FROM m WHERE {n}_c >= 0.35" for n in KEYPOINTS
    )
    return (
        f"WITH h AS ({hips}), m AS (SELECT c.video_id, c.frame_idx, c.hx AS chx, c.hy AS chy, {far('c')} AS cs, {far('r')} AS rs, r.* EXCLUDE (video_id, frame_idx) "
        f"FROM h c JOIN h r ON r.video_id = c.video_id AND r.frame_idx = 60) SELECT video_id, frame_idx, name, round(x, 4) AS x, round(y, 4) AS y FROM ({parts}) "
        "WHERE (video_id, frame_idx) IN (SELECT (video_id, frame_idx) FROM m WHERE cs >= 8 AND rs >= 8)"
    )


@query("f34_align_pose", sql(_aligned_sql(), "frames_v"))
def f34(spark, sf):
    f = C.frames(spark, sf).select("video_id", "frame_idx", "keypoints")
    ref = f.filter("frame_idx = 60").select("video_id", F.col("keypoints").alias("ref_keypoints"))
    out = GT.align_pose(f.join(ref, "video_id"))
    return out.select("video_id", "frame_idx", F.inline("aligned")).withColumns({"x": rnd(F.col("x"), 4), "y": rnd(F.col("y"), 4)})


# ------------------------------------------------------------ edits

@query(
    "m1_add_marker",
    sql(
        """SELECT video_id, frame_idx, phase FROM (SELECT video_id, frame_idx, ['hop_1', 'final_jump', 'landing', 'hop_4'][(frame_idx // 3) % 4 + 1] AS phase FROM frames_v) WHERE frame_idx <> 12 AND phase <> 'landing'
UNION ALL SELECT DISTINCT video_id, 12, 'landing' FROM frames_v""",
        "frames_v",
    ),
)
def m1(spark, sf):
    new = C.frames(spark, sf).filter("frame_idx = 12").select(
        "video_id", "frame_idx", F.lit("landing").alias("phase"), F.lit("manual").alias("source"), F.lit(1.0).alias("confidence")
    )
    return ED.add_markers(gt_markers(spark, sf), new).select("video_id", "frame_idx", "phase")


@query(
    "m2_move_marker",
    sql(
        """SELECT video_id, CASE frame_idx WHEN 30 THEN 33 WHEN 33 THEN 30 ELSE frame_idx END AS frame_idx, ['hop_1', 'final_jump', 'landing', 'hop_4'][(frame_idx // 3) % 4 + 1] AS phase,
  CASE WHEN frame_idx IN (30, 33) THEN 'manual' ELSE 'auto' END AS source FROM frames_v WHERE frame_idx <> 60""",
        "frames_v",
    ),
)
def m2(spark, sf):
    m = gt_markers(spark, sf).withColumn("source", F.lit("auto"))
    v = m.select("video_id").distinct()
    m = ED.remove_markers(m, v.withColumn("frame_idx", F.lit(60)))
    moved = ED.move_markers(m, v.withColumns({"from_idx": F.lit(30), "to_idx": F.lit(33)}))
    return moved.select("video_id", "frame_idx", "phase", "source")


@query(
    "m4_apply_correction",
    sql(
        """SELECT video_id, frame_idx, round(CASE WHEN c AND track_id % 2 = 0 THEN 0.5::DOUBLE ELSE track_overlap END, 6) AS track_overlap, CASE WHEN c AND track_id % 2 = 0 THEN NULL WHEN c THEN track_id ELSE track_id END AS track_id
FROM (SELECT *, frame_idx BETWEEN 30 AND 60 AS c FROM frames_v)""",
        "frames_v",
    ),
)
def m4(spark, sf):
    f = C.frames(spark, sf).select("video_id", "frame_idx", "track_overlap", "track_id")
    even = F.col("track_id") % 2 == 0
    fix = f.filter("frame_idx between 30 and 60").select(
        "video_id", "frame_idx", F.when(even, 0.5).alias("track_overlap"), F.when(~even, F.col("track_id")).alias("track_id")
    )
    return ED.apply_corrections(f, fix).withColumn("track_overlap", rnd(F.col("track_overlap")))


@query(
    "m5_correction_range",
    sql(
        """SELECT t.video_id, t.target_idx AS correction_idx, f.frame_idx FROM targets_v t JOIN frames_v f ON f.video_id = t.video_id
WHERE f.frame_idx BETWEEN greatest(0, t.target_idx - r) AND least(t.target_idx + r, 139) AND t.target_idx <= 139 + r AND (t.frame_idx % 2 = 0 OR f.frame_idx = t.target_idx)""".replace(" r)", " 7)").replace("+ r,", "+ 7,").replace("139 + r", "139"),
        "targets_v", "frames_v",
    ),
)
def m5(spark, sf):
    from .join_queries import contact_events

    mask = F.col("frame_idx") % 2 == 1
    c = contact_events(spark, sf).select(
        "video_id", F.when(mask, "mask_correction").otherwise("bbox_correction").alias("correction_type"),
        F.col("target_idx").alias("frame_idx"), F.lit(7).alias("propagation_radius"), F.lit(None).cast("string").alias("sot_backend"),
        F.lit(None).cast("int").alias("end_frame"), F.lit(140).alias("total_frames"),
    ).filter("frame_idx <= 139")
    return ED.correction_range(c, C.frames(spark, sf))


@query(
    "m6_apply_overrides",
    """SELECT CAST(o_orderkey AS VARCHAR) AS video_id, CAST(CASE WHEN edited THEN o_orderkey % 20 ELSE o_orderkey END AS VARCHAR) AS total_length_m,
  CASE WHEN edited THEN CAST(o_orderkey % 20 AS VARCHAR) END AS hops_corridor_m, CASE WHEN NOT edited THEN o_orderstatus END AS notes, CAST(NULL AS VARCHAR) AS other
FROM (SELECT *, o_orderstatus = 'P' AS edited FROM orders)""",
)
def m6(spark, sf):
    o = C.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    old = o.select(k.cast("string").alias("video_id"), F.create_map(F.lit("total_length_m"), k.cast("string"), F.lit("notes"), F.col("o_orderstatus")).alias("overrides"))
    edit = o.filter("o_orderstatus = 'P'").select(
        k.cast("string").alias("video_id"), F.create_map(F.lit("hops_corridor_m"), (k % 20).cast("string"), F.lit("other"), F.lit("x")).alias("update"),
        F.array(F.lit("notes")).alias("clear"),
    )
    out = ED.apply_overrides(old, edit)
    return out.select("video_id", *[F.col("overrides")[c].alias(c) for c in ("total_length_m", "hops_corridor_m", "notes", "other")])


@query(
    "f36_bbox_from_correction",
    sql(
        """SELECT video_id, frame_idx, det_id, CASE WHEN det_id % 3 = 0 THEN greatest(0, trunc(x1 - 100)) WHEN det_id % 3 = 1 THEN greatest(0, trunc(x1) - 200) ELSE x1 END AS x1,
  CASE WHEN det_id % 3 = 0 THEN least(720, trunc(y2 + 300)) WHEN det_id % 3 = 1 THEN least(720, trunc(y1) + 200) ELSE y2 END AS y2 FROM detections_v""",
        "detections_v",
    ),
)
def f36(spark, sf):
    d = C.detections(spark, sf)
    k = F.col("det_id") % 3
    corners = F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))
    c = d.select(
        "video_id", "frame_idx", "det_id", F.when(k == 0, "bbox_correction").when(k == 1, "click_selection").otherwise("mask_correction").alias("correction_type"),
        F.col("x1").alias("x"), F.col("y1").alias("y"), (F.col("x1") - 100).alias("x1"), F.col("y1").alias("y1"), F.col("x2").alias("x2"),
        (F.col("y2") + 300).alias("y2"), corners.alias("cells"),
    )
    return ED.bbox_from_correction(c).select("video_id", "frame_idx", "det_id", F.col("bbox")[0].alias("x1"), F.col("bbox")[3].alias("y2"))


@query(
    "k2_bump_derived",
    """SELECT c_custkey, c_nationkey + CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') THEN 1 ELSE 0 END AS derived_version FROM customer""",
)
def k2(spark, sf):
    v = C.table(spark, sf, "customer").select(F.col("c_custkey").alias("video_id"), F.col("c_nationkey").alias("derived_version"))
    changed = C.table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("video_id"))
    return ED.bump_derived(v, changed).withColumnRenamed("video_id", "c_custkey")


@query(
    "k3_ensure_stubs",
    """SELECT c_custkey, coalesce(any_value(v), 0) AS derived_version FROM customer LEFT JOIN (SELECT o_custkey, 7 AS v FROM orders WHERE o_orderstatus = 'P') ON o_custkey = c_custkey GROUP BY 1""",
)
def k3(spark, sf):
    have = C.table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("video_id")).distinct()
    v = C.table(spark, sf, "customer").select(F.col("c_custkey").alias("video_id"))
    return ED.ensure_stubs(have.withColumn("derived_version", F.lit(7)), v, derived_version=0).withColumnRenamed("video_id", "c_custkey")


@query(
    "k4_upsert_session",
    """SELECT CAST(o_custkey AS VARCHAR) AS athlete_id, CAST(o_orderkey AS VARCHAR) AS video_id, CASE WHEN o_orderstatus = 'P' THEN 'new' ELSE 'old' END AS tag FROM orders""",
)
def k4(spark, sf):
    o = C.table(spark, sf, "orders")
    rows = o.select(F.col("o_custkey").cast("string").alias("athlete_id"), F.col("o_orderkey").cast("string").alias("video_id"), "o_orderstatus")
    new = rows.filter("o_orderstatus = 'P'").drop("o_orderstatus").withColumn("tag", F.lit("new"))
    return ED.upsert_sessions(rows.drop("o_orderstatus").withColumn("tag", F.lit("old")), new)


@query(
    "u2_merge_keyframes",
    sql(
        """SELECT video_id, frame_idx, CASE WHEN frame_idx % 60 = 0 THEN 'old_manual' WHEN frame_idx % 15 = 0 THEN 'new' ELSE 'old_auto' END AS note FROM frames_v WHERE frame_idx % 30 = 0 OR frame_idx % 15 = 0""",
        "frames_v",
    ),
)
def u2(spark, sf):
    k = C.keyframes(spark, sf).withColumns(
        {
            "source": F.when(F.col("frame_idx") % 60 == 0, "manual").otherwise("venue_auto"), "venue_confidence": F.lit(None).cast("double"),
            "note": F.when(F.col("frame_idx") % 60 == 0, "old_manual").otherwise("old_auto"),
        }
    )
    new = C.frames(spark, sf).filter(F.col("frame_idx") % 15 == 0).select(
        "video_id", "frame_idx", F.lit("venue_auto").alias("source"), F.lit("new").alias("note")
    )
    return M.merge_keyframes(k, new).select("video_id", "frame_idx", "note")


@query(
    "u3_merge_selections",
    sql(
        """SELECT video_id, frame_idx, CASE WHEN frame_idx % 6 = 0 AND track_id % 2 = 0 THEN 1 WHEN frame_idx % 9 = 0 THEN 0 END AS track, CASE WHEN frame_idx % 6 = 0 THEN 1 ELSE 0 END AS sand
FROM frames_v WHERE frame_idx % 6 = 0 OR frame_idx % 9 = 0""",
        "frames_v",
    ),
)
def u3(spark, sf):
    f = C.frames(spark, sf)
    cal = f.filter("frame_idx % 9 = 0").select("video_id", "frame_idx", F.lit(0).alias("track"), F.lit(0).alias("sand"))
    user = f.filter("frame_idx % 6 = 0").select("video_id", "frame_idx", F.when(F.col("track_id") % 2 == 0, 1).alias("track"), F.lit(1).alias("sand"))
    return ED.merge_selections(cal, user)


@query("e30_auto_keyframes")
def e30(spark, sf):
    k = C.keyframes(spark, sf).withColumns({"source": F.when(F.col("frame_idx") % 60 == 0, "manual").otherwise("venue_auto"), "venue_confidence": F.lit(None).cast("double")})
    f = C.frames(spark, sf).select("video_id", "frame_idx")
    shifted = k.withColumn("frame_idx", F.col("frame_idx") + 3).withColumn("venue_confidence", F.lit(0.9))
    found = f.join(k.filter("frame_idx = 0").select("video_id", "track_polygon", "landing_zone"), "video_id").withColumn("venue_confidence", F.lit(0.6))
    return M.auto_keyframes(f, k, shifted, found).select("video_id", "frame_idx", "source", "venue_confidence")


# ------------------------------------------------------------ label export

def export_keyframes(spark, sf):
    return C.keyframes(spark, sf).withColumns({"source": F.lit("manual"), "venue_confidence": F.lit(None).cast("double")})


def _line_sql(kind, tag):
    return f"'{kind} ' || " + " || ' ' || ".join(f"printf('%.6f', {tag}{j}{c})" for j in range(4) for c in "xy")


def _split_sql(ratio: float, seed: int) -> str:
    """Split of every keyframe: ranked by a hash inside its video."""
    return f"""SELECT *, CASE WHEN rank <= CASE WHEN n > 1 THEN greatest(1, floor(n * {ratio})) ELSE 0 END THEN 'val' ELSE 'train' END AS split FROM (
  SELECT *, count(*) OVER (PARTITION BY video_id) AS n, row_number() OVER (PARTITION BY video_id
    ORDER BY CAST('0x' || substr(md5('{seed}:' || video_id || ':' || frame_idx), 1, 15) AS BIGINT), frame_idx) AS rank FROM keyframes_v)"""


@query(
    "k9_export_labels",
    sql(
        f"SELECT split, video_id, frame_idx, 0 AS class, {_line_sql(0, 't')} AS line FROM ({_split_sql(0.2, 42)}) UNION ALL SELECT split, video_id, frame_idx, 1, {_line_sql(1, 's')} FROM ({_split_sql(0.2, 42)})",
        "keyframes_v",
    ),
)
def k9(spark, sf):
    return WR.label_rows(export_keyframes(spark, sf))


@query(
    "k10_rebuild_labels",
    sql(
        f"SELECT video_id, frame_idx, {_line_sql(0, 't')} AS line FROM keyframes_v WHERE CAST(video_id AS INTEGER) % 3 > 0", "keyframes_v"
    ),
)
def k10(spark, sf):
    manifest = C.frames(spark, sf).select("video_id").distinct().filter(F.col("video_id").cast("int") % 3 > 0)
    return WR.rebuild_rows(manifest, export_keyframes(spark, sf)).filter("class = 0").select("video_id", "frame_idx", "line")


@query("e25_split_train_val", sql(f"SELECT video_id, frame_idx, split FROM ({_split_sql(0.3, 7)})", "keyframes_v"))
def e25(spark, sf):
    return WR.split_train_val(C.keyframes(spark, sf).select("video_id", "frame_idx"), 0.3, 7)


@query(
    "s7_polygon_labels",
    sql("SELECT video_id, frame_idx, 0 AS class, round(t0x, 6) AS x0, round(t3y, 6) AS y3, 4 AS n FROM keyframes_v", "keyframes_v"),
)
def s7(spark, sf):
    lines = WR.label_rows(export_keyframes(spark, sf)).filter("class = 0").select("video_id", "frame_idx", F.col("line").alias("value"))
    p = RD.parse_labels(lines)
    return p.select("video_id", "frame_idx", "class", rnd(F.col("points")[0]["x"]).alias("x0"), rnd(F.col("points")[3]["y"]).alias("y3"), F.size("points").alias("n"))


@query(
    "a12_dataset_info",
    sql("SELECT CAST(video_id AS INTEGER) % 2 AS venue_id, count(*) AS total_frames, count(DISTINCT video_id) AS video_count, count(*) >= 10 AS ready_to_train, count(*) >= 5 AS can_train FROM keyframes_v GROUP BY 1", "keyframes_v"),
)
def a12(spark, sf):
    k = C.keyframes(spark, sf).withColumn("venue_id", F.col("video_id").cast("int") % 2)
    return LB.dataset_info(k)


# ------------------------------------------------------------ venue colours

_STATS = ", ".join(f"avg({c}) AS {c}m, stddev_pop({c}) AS {c}s" for c in "hsv")
view("color_v", f"SELECT venue_id, layer, count(*) AS n, {_STATS} FROM pixels_v GROUP BY 1, 2", "pixels_v")


def color_stats(spark, sf):
    return VN.stats_from_moments(VN.color_moments(C.pixels(spark, sf)))


@query(
    "a10_color_stats",
    sql("SELECT venue_id, layer, n AS sample_count, round(hm, 4) AS h_mean, round(hs, 4) AS h_std, round(vm, 4) AS v_mean, round(vs, 4) AS v_std FROM color_v WHERE n >= 50", "color_v"),
)
def a10(spark, sf):
    return color_stats(spark, sf).select(
        "venue_id", "layer", "sample_count", rnd(F.col("mean")[0], 4).alias("h_mean"), rnd(F.col("std")[0], 4).alias("h_std"),
        rnd(F.col("mean")[2], 4).alias("v_mean"), rnd(F.col("std")[2], 4).alias("v_std"),
    )


@query(
    "a10_merge_color_stats",
    sql("SELECT venue_id, layer, n AS sample_count, round(hm, 4) AS h_mean, round(ss, 4) AS s_std FROM color_v", "color_v"),
)
def a10_merge(spark, sf):
    p = C.pixels(spark, sf)
    old = VN.stats_from_moments(VN.color_moments(p.filter("s < 100")))
    return VN.merge_color_stats(old, p.filter("s >= 100")).select(
        "venue_id", "layer", "sample_count", rnd(F.col("mean")[0], 4).alias("h_mean"), rnd(F.col("std")[1], 4).alias("s_std")
    )


_LOW = "greatest(greatest(0, CAST(round(hm - 1.5 * hs) AS INTEGER)), CASE WHEN layer = 'track' THEN 35 ELSE 10 END)"


@query(
    "f32_hsv_range",
    sql(
        f"""SELECT venue_id, layer, {_LOW} AS h_low, least(255, CAST(round(sm + 1.5 * ss) AS INTEGER)) AS s_high,
  CASE WHEN layer = 'track' THEN greatest(greatest(0, CAST(round(vm - 1.5 * vs) AS INTEGER)), 80) ELSE greatest(0, CAST(round(vm - 1.5 * vs) AS INTEGER)) END AS v_low FROM color_v""",
        "color_v",
    ),
)
def f32(spark, sf):
    r = S.hsv_range(F.col("mean"), F.col("std"), F.col("layer"))
    return color_stats(spark, sf).withColumn("r", r).select(
        "venue_id", "layer", F.col("r.low")[0].alias("h_low"), F.col("r.high")[1].alias("s_high"), F.col("r.low")[2].alias("v_low")
    )


@query(
    "f45_color_match",
    sql(
        """SELECT p.venue_id, p.layer, count(*) AS n, count(*) FILTER (h BETWEEN greatest(35, hm - 2 * hs) AND least(100, hm + 2 * hs)
  AND s BETWEEN greatest(10, sm - 2 * ss) AND least(255, sm + 2 * ss) AND v >= greatest(80, vm - 2 * vs)) AS matched
FROM pixels_v p JOIN color_v c ON c.venue_id = p.venue_id AND c.layer = 'track' GROUP BY 1, 2""",
        "pixels_v", "color_v",
    ),
)
def f45(spark, sf):
    m = VN.match_pixels(C.pixels(spark, sf), color_stats(spark, sf), "track")
    return m.groupBy("venue_id", "layer").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("matches"), 1)).alias("matched"))


def venue_pixels(spark, sf):
    """Pixels with ten videos as the frame unit, so that frames hold enough of them."""
    ten = F.floor(F.col("video_id").cast("int") / 10).cast("string")
    return C.pixels(spark, sf).withColumns({"frame_idx": F.lit(0), "video_id": ten})


def venue_shapes(spark, sf):
    k = C.keyframes(spark, sf)
    from ..functions import geometry as G

    p = F.col("track_polygon")
    m = G.polygon_mean(p)
    return k.select(
        (F.col("video_id").cast("int") % 3).cast("string").alias("venue_id"), G.polygon_area(p).alias("area"), (m.x * 4).alias("aspect"),
        m.x.alias("cx"), m.y.alias("cy"), F.lit(None).cast("double").alias("lane_angle"),
    )


@query(
    "a11_learn_venue",
    sql(
        """SELECT p.venue_id, t AS frames_used, s AS sand_frames_used, videos, round(hm, 4) AS track_h, round(cx, 6) AS cx, round(area, 6) AS area FROM (
  SELECT venue_id, count(*) FILTER (layer = 'track' AND n >= 50) AS t, count(*) FILTER (layer = 'sand' AND n >= 30) AS s,
    count(DISTINCT video_id) FILTER ((layer = 'track' AND n >= 50) OR (layer = 'sand' AND n >= 30)) AS videos, sum(hsum) FILTER (layer = 'track' AND n >= 50) / sum(n) FILTER (layer = 'track' AND n >= 50) AS hm
  FROM (SELECT venue_id, CAST(video_id AS INTEGER) // 10 AS video_id, layer, count(*) AS n, sum(h) AS hsum FROM pixels_v GROUP BY 1, 2, 3) GROUP BY 1) p
LEFT JOIN (SELECT CAST(CAST(video_id AS INTEGER) % 3 AS VARCHAR) AS venue_id, median((t0x + t1x + t2x + t3x) / 4) AS cx,
  median(abs(t0x*t1y - t1x*t0y + t1x*t2y - t2x*t1y + t2x*t3y - t3x*t2y + t3x*t0y - t0x*t3y) / 2) AS area FROM keyframes_v GROUP BY 1) k ON k.venue_id = p.venue_id WHERE hm IS NOT NULL""",
        "pixels_v", "keyframes_v",
    ),
)
def a11(spark, sf):
    out = VN.learn_venue(venue_pixels(spark, sf), venue_shapes(spark, sf))
    return out.select(
        "venue_id", "frames_used", "sand_frames_used", F.col("n_videos").alias("videos"),
        rnd(F.col("track.mean")[0], 4).alias("track_h"), rnd(F.col("cx")).alias("cx"), rnd(F.col("area")).alias("area"),
    )


@query(
    "a11_contributors",
    sql(
        """SELECT DISTINCT venue_id, video_id FROM (SELECT venue_id, CAST(CAST(video_id AS INTEGER) // 10 AS VARCHAR) AS video_id, layer, count(*) AS n FROM pixels_v GROUP BY 1, 2, 3)
WHERE (layer = 'track' AND n >= 50) OR (layer = 'sand' AND n >= 30)""",
        "pixels_v",
    ),
)
def a11_contributors(spark, sf):
    return VN.contributors(venue_pixels(spark, sf))


@query(
    "a11_medians",
    sql("SELECT label, round(median(embedding[1]), 6) AS x, round(median(CASE WHEN embedding[2] > 0 THEN round(embedding[2], 1) END), 6) AS y FROM embeddings GROUP BY 1"),
)
def a11_medians(spark, sf):
    e = C.table(spark, sf, "embeddings")
    y = F.round(F.col("embedding")[1].cast("double"), 1)
    rows = e.select("label", F.col("embedding")[0].cast("double").alias("x"), F.when(F.col("embedding")[1] > 0, y).alias("y"))
    return VN.medians(rows, ["label"], ("x", "y")).select("label", rnd(F.col("x")).alias("x"), rnd(F.col("y")).alias("y"))


def hist_samples(spark, sf):
    return C.pixels(spark, sf).withColumns(
        {"sample_id": F.col("video_id"), "zone": F.when(F.col("layer") == "track", 0).when(F.col("layer") == "sand", 1).otherwise(2)}
    )


view(
    "hist_v",
    """SELECT video_id AS sample_id, zone, bin, c / max(c) OVER (PARTITION BY video_id, zone) AS weight FROM (SELECT *, sum(c) OVER (PARTITION BY video_id, zone) AS total FROM (
  SELECT video_id, zone, bin, count(*) AS c FROM (SELECT video_id, CASE layer WHEN 'track' THEN 0 WHEN 'sand' THEN 1 ELSE 2 END AS zone,
    CAST((floor(h * 8 / 180) * 8 + floor(s * 8 / 256)) * 8 + floor(v * 8 / 256) AS INTEGER) AS bin FROM pixels_v) GROUP BY 1, 2, 3)) WHERE total >= 20""",
    "pixels_v",
)


@query("a21_histogram", sql("SELECT sample_id, zone, bin, round(weight, 6) AS weight FROM hist_v", "hist_v"))
def a21(spark, sf):
    return VN.histogram(hist_samples(spark, sf), (8, 8, 8)).withColumn("weight", rnd(F.col("weight")))


def near_pairs(spark, sf):
    """Each sample next to the two that follow it."""
    s = C.pixels(spark, sf).select("video_id").distinct()
    return s.select(F.col("video_id").alias("cand_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("k")).select(
        "cand_id", (F.col("cand_id").cast("int") + F.col("k")).cast("string").alias("ref_id")
    ).join(s.withColumnRenamed("video_id", "ref_id"), "ref_id", "left_semi")


@query(
    "a22_histogram_similarity",
    sql(
        """SELECT cand_id, round(greatest(0, least(1, 1 - median(distance))), 5) AS similarity FROM (SELECT cand_id, ref_id, sum(w * CASE WHEN a IS NULL OR b IS NULL THEN 0.5 ELSE sqrt(greatest(0, 1 - coalesce(bc, 0) / sqrt(a * b))) END) AS distance FROM (
  SELECT p.cand_id, p.ref_id, z.w, (SELECT sum(weight) FROM hist_v h WHERE h.sample_id = p.cand_id AND h.zone = z.z) AS a, (SELECT sum(weight) FROM hist_v h WHERE h.sample_id = p.ref_id AND h.zone = z.z) AS b,
    (SELECT sum(sqrt(g.weight * h.weight)) FROM hist_v g JOIN hist_v h ON h.zone = g.zone AND h.bin = g.bin WHERE g.sample_id = p.cand_id AND h.sample_id = p.ref_id AND g.zone = z.z) AS bc
  FROM (SELECT a.video_id AS cand_id, b.video_id AS ref_id FROM (SELECT DISTINCT video_id FROM pixels_v) a JOIN (SELECT DISTINCT video_id FROM pixels_v) b
      ON CAST(b.video_id AS INTEGER) - CAST(a.video_id AS INTEGER) IN (1, 2)) p, (VALUES (0, 0.10::DOUBLE), (1, 0.60::DOUBLE), (2, 0.30::DOUBLE)) z(z, w)) GROUP BY 1, 2) GROUP BY 1""",
        "hist_v", "pixels_v",
    ),
)
def a22(spark, sf):
    h = VN.histogram(hist_samples(spark, sf), (8, 8, 8))
    d = VN.zone_distance(h, h, near_pairs(spark, sf))
    return VN.appearance_similarity(d).withColumn("similarity", rnd(F.col("similarity"), 5))


view(
    "zone_dist_v",
    """SELECT cand_id, ref_id, sum(w * CASE WHEN a IS NULL OR b IS NULL THEN 0.5 ELSE sqrt(greatest(0, 1 - coalesce(bc, 0) / sqrt(a * b))) END) AS distance FROM (
  SELECT p.cand_id, p.ref_id, z.w, a.m AS a, b.m AS b, s.bc FROM (SELECT a.video_id AS cand_id, b.video_id AS ref_id FROM (SELECT DISTINCT video_id FROM pixels_v) a JOIN (SELECT DISTINCT video_id FROM pixels_v) b
      ON CAST(b.video_id AS INTEGER) - CAST(a.video_id AS INTEGER) IN (1, 2, 5, 6)) p CROSS JOIN (VALUES (0, 0.10::DOUBLE), (1, 0.60::DOUBLE), (2, 0.30::DOUBLE)) z(z, w)
  LEFT JOIN (SELECT sample_id, zone, sum(weight) AS m FROM hist_v GROUP BY 1, 2) a ON a.sample_id = p.cand_id AND a.zone = z.z
  LEFT JOIN (SELECT sample_id, zone, sum(weight) AS m FROM hist_v GROUP BY 1, 2) b ON b.sample_id = p.ref_id AND b.zone = z.z
  LEFT JOIN (SELECT g.sample_id AS g, h.sample_id AS h, g.zone, sum(sqrt(g.weight * h.weight)) AS bc FROM hist_v g JOIN hist_v h ON h.zone = g.zone AND h.bin = g.bin AND CAST(h.sample_id AS INTEGER) - CAST(g.sample_id AS INTEGER) BETWEEN 1 AND 6 GROUP BY 1, 2, 3) s
    ON s.g = p.cand_id AND s.h = p.ref_id AND s.zone = z.z) GROUP BY 1, 2""",
    "hist_v", "pixels_v",
)


def pairs_apart(spark, sf, *apart):
    """Each sample with those that follow it at the given distances."""
    s = C.pixels(spark, sf).select("video_id").distinct()
    step = F.explode(F.array(*[F.lit(d) for d in apart]))
    placed = s.select(F.col("video_id").alias("cand_id"), step.alias("_d")).withColumn("ref_id", (F.col("cand_id").cast("int") + F.col("_d")).cast("string"))
    return placed.join(s.select(F.col("video_id").alias("ref_id")), "ref_id", "left_semi").select("cand_id", "ref_id")


@query(
    "a22_negative_penalty",
    sql(
        """SELECT p.cand_id, round(greatest(0, least(1, 1 - p.m)) * greatest(0.4, least(1, 1 - 0.6 * CASE WHEN n.m IS NULL THEN 0 ELSE greatest(0, least(1, 1 - n.m)) END)), 5) AS similarity FROM
  (SELECT cand_id, median(distance) AS m FROM zone_dist_v WHERE CAST(ref_id AS INTEGER) - CAST(cand_id AS INTEGER) <= 2 GROUP BY 1) p
  LEFT JOIN (SELECT cand_id, min(distance) AS m FROM zone_dist_v WHERE CAST(ref_id AS INTEGER) - CAST(cand_id AS INTEGER) >= 5 GROUP BY 1) n ON n.cand_id = p.cand_id""",
        "zone_dist_v",
    ),
)
def a22_penalty(spark, sf):
    h = cut_lineage(VN.histogram(hist_samples(spark, sf), (8, 8, 8)))  # met as candidates and as references
    apart = F.col("ref_id").cast("int") - F.col("cand_id").cast("int")
    d = cut_lineage(VN.zone_distance(h, h, pairs_apart(spark, sf, 1, 2, 5, 6)))
    near, far = d.filter(apart <= 2), d.filter(apart >= 5)
    return VN.appearance_similarity(near, far).withColumn("similarity", rnd(F.col("similarity"), 5))


@query(
    "a22_mean_reference",
    sql(
        """SELECT video_id, zone, bin, round(sum(weight) / any_value(n), 6) AS weight FROM (SELECT *, count(DISTINCT ref_age) OVER (PARTITION BY video_id) AS n FROM (
  SELECT CAST(sample_id AS INTEGER) // 20 AS video_id, dense_rank() OVER (PARTITION BY CAST(sample_id AS INTEGER) // 20 ORDER BY CAST(sample_id AS INTEGER) DESC) AS ref_age, zone, bin, weight FROM hist_v) WHERE ref_age <= 10) GROUP BY 1, 2, 3""",
        "hist_v",
    ),
)
def a22_mean(spark, sf):
    h = VN.histogram(hist_samples(spark, sf), (8, 8, 8))
    number = F.col("sample_id").cast("int")
    age = F.dense_rank().over(Window.partitionBy("video_id").orderBy(number.desc()))
    refs = h.withColumn("video_id", F.floor(number / 20).cast("int")).withColumn("ref_age", age)
    return VN.mean_reference(refs).withColumn("weight", rnd(F.col("weight")))


def regions(spark, sf):
    d = C.detections(spark, sf)
    return d.select(
        (F.col("track_id") * 0).cast("string").alias("venue_id"), "video_id", "frame_idx", F.col("det_id").alias("region_id"),
        F.when(F.col("det_id") % 2 == 0, "sand").otherwise("track").alias("layer"), (F.sqrt("mask_area_px") / 700).alias("area"),
        (1 + F.col("appearance_sim") * 7).alias("aspect"), (F.col("x1") / 1000).alias("cx"), (F.col("y1") / 400).alias("cy"),
    )


view(
    "regions_v",
    """SELECT *, CASE WHEN cx >= 0.15 AND CASE WHEN layer = 'track' THEN abs(cy - 0.6) <= 0.18 ELSE cy >= 0.55 END THEN
  CASE WHEN area > least(CASE WHEN layer = 'sand' THEN 0.20 ELSE 0.25 END, 0.3) OR area < 0.024 THEN -1 ELSE raw END END AS score FROM (
  SELECT *, 0.45 * exp(-0.5 * ((area - 0.12) / 0.04)**2) + 0.30 * exp(-0.5 * ((aspect - 4) / 2)**2) + 0.25 * exp(-0.5 * ((cy - 0.6) / 0.15)**2) AS raw FROM (
  SELECT video_id, frame_idx, det_id AS region_id, CASE WHEN det_id % 2 = 0 THEN 'sand' ELSE 'track' END AS layer, sqrt(mask_area_px) / 700 AS area, 1 + appearance_sim * 7 AS aspect, x1 / 1000 AS cx, y1 / 400 AS cy FROM detections_v))""",
    "detections_v",
)


@query(
    "f33_shape_score",
    sql(
        """SELECT video_id, frame_idx, region_id, round(CASE WHEN area > least(CASE WHEN layer = 'sand' THEN 0.20 ELSE 0.25 END, 0.3) OR area < 0.024 THEN -1 ELSE raw END, 6) AS score FROM regions_v""",
        "regions_v",
    ),
)
def f33(spark, sf):
    e = F.struct(F.lit(0.12).alias("area"), F.lit(4.0).alias("aspect"), F.lit(0.5).alias("cx"), F.lit(0.6).alias("cy"))
    return regions(spark, sf).select(
        "video_id", "frame_idx", "region_id",
        rnd(S.shape_score(F.col("area"), F.col("aspect"), F.col("cy"), e, F.col("layer"))).alias("score"),
    )


@query(
    "a24_pick_region",
    sql(
        """SELECT video_id, frame_idx, coalesce(t.r, tb.r) AS track_region, coalesce(s.r, sb.r) AS sand_region, round(CASE WHEN s IS NOT NULL THEN least(1, base * 0.7 - s.k * 0.3) WHEN sb IS NOT NULL THEN least(1, base * 0.85 + 0.1) ELSE base END, 6) AS confidence FROM (
  SELECT *, least(1, CASE WHEN t IS NOT NULL THEN -t.k ELSE 0.55 END * 0.6 + 0.4 * exp(-0.5 * ((CASE WHEN t IS NOT NULL THEN t.a ELSE tb.a END - 0.12) / 0.04)**2)) AS base FROM (
    SELECT video_id, frame_idx, min({'k': -score, 'r': region_id, 'a': area}) FILTER (layer = 'track' AND score > 0) AS t, min({'k': -score, 'r': region_id, 'a': area}) FILTER (layer = 'sand' AND score > 0) AS s,
      min({'k': -area, 'r': region_id, 'a': area}) FILTER (layer = 'track' AND area BETWEEN 0.005 AND 0.25) AS tb, min({'k': -area, 'r': region_id, 'a': area}) FILTER (layer = 'sand' AND area BETWEEN 0.003 AND 0.20) AS sb FROM regions_v GROUP BY 1, 2)
  WHERE t IS NOT NULL OR tb IS NOT NULL)""",
        "regions_v",
    ),
)
def a24(spark, sf):
    prof = spark.createDataFrame([("0", 0.12, 4.0, 0.5, 0.6)], "venue_id string, area double, aspect double, cx double, cy double")
    return VN.pick_regions(regions(spark, sf), prof).drop("venue_id").withColumn("confidence", rnd(F.col("confidence")))


# ------------------------------------------------------------ catalogue

def catalog_parts(spark, sf):
    c = C.table(spark, sf, "customer")
    o = C.table(spark, sf, "orders")
    videos = c.select(F.col("c_custkey").alias("video_id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("duration_s"))
    # every order is a pass of its customer's video; what kind it is says its priority
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "first").when(F.col("o_orderpriority") == "2-HIGH", "refined").otherwise("preview")
    passes = o.select(F.col("o_custkey").alias("video_id"), kind.alias("pass"))
    named = F.when(F.col("c_mktsegment") != "MACHINERY", F.concat(F.lit(" "), "c_mktsegment")).otherwise("  ")
    meta = c.filter("c_acctbal < 1500").select(F.col("c_custkey").alias("video_id"), named.alias("athlete_id"), F.lit("n").alias("note"), F.lit(None).cast("string").alias("date"))
    sections = c.filter("c_nationkey < 9").select(F.col("c_custkey").alias("video_id"), F.lit("from_sections").alias("athlete_id"))
    metrics = c.select(F.col("c_custkey").alias("video_id"), F.lit("from_metrics").alias("athlete_id"))
    return videos, passes, meta, sections, metrics


view(
    "catalog_v",
    """SELECT video_id, name, has_analysis, has_refined, CASE WHEN balance < 1500 THEN CASE WHEN seg <> 'MACHINERY' THEN seg END
  WHEN has_analysis THEN CASE WHEN nation < 9 THEN 'from_sections' ELSE 'from_metrics' END END AS athlete_id FROM (
  SELECT c_custkey AS video_id, c_name AS name, c_mktsegment AS seg, c_acctbal AS balance, c_nationkey AS nation, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') AS has_analysis,
    EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '2-HIGH') AS has_refined FROM customer)""",
)


@query("s8_catalog", sql("SELECT video_id, name, has_analysis, has_refined, athlete_id FROM catalog_v", "catalog_v"))
def s8(spark, sf):
    return LB.catalog(*catalog_parts(spark, sf)).select("video_id", "name", "has_analysis", "has_refined", "athlete_id")


@query("s9_resolve_athlete", sql("SELECT video_id, athlete_id FROM catalog_v", "catalog_v"))
def s9(spark, sf):
    v, p, meta, sec, met = catalog_parts(spark, sf)
    v = v.join(p.filter("pass = 'first'").select("video_id").distinct().withColumn("has_analysis", F.lit(True)), "video_id", "left").fillna({"has_analysis": False})
    return LB.resolve_athlete(v, meta, sec, met).select("video_id", "athlete_id")


def library_rows(spark, sf):
    return LB.catalog(*catalog_parts(spark, sf)).select(
        "video_id", "athlete_id", F.col("name").alias("title"), F.lit("Nota").alias("note"), F.lit("2024-01-01").alias("date"),
        F.when(F.col("has_analysis"), (F.col("video_id") % 101).cast("int")).alias("success_pct"),
    )


@query(
    "a13_library",
    sql(
        "SELECT coalesce(athlete_id, 'Sin asignar') AS athlete, count(*) AS n_sessions, max(CASE WHEN has_analysis THEN video_id % 101 END) AS best_pct, max(name) AS last_title FROM catalog_v GROUP BY 1",
        "catalog_v",
    ),
)
def a13(spark, sf):
    return LB.library(library_rows(spark, sf))


@query(
    "l1_search_library",
    sql("SELECT video_id FROM catalog_v WHERE contains(lower(coalesce(athlete_id, 'Sin asignar')), 'build') OR contains(lower(name), 'build') OR contains(CAST(video_id AS VARCHAR), 'build') OR contains(lower('Nota'), 'build')", "catalog_v"),
)
def l1(spark, sf):
    return LB.search_library(library_rows(spark, sf), " BUILD ").select("video_id")


@query("o1_sorted_sessions", sql("SELECT coalesce(athlete_id, 'Sin asignar') AS athlete, name AS title FROM catalog_v", "catalog_v"))
def o1(spark, sf):
    return LB.library_sessions(library_rows(spark, sf)).select("athlete", "title")


@query(
    "o4_sorted_distribution",
    sql("SELECT video_id, string_agg(camera_angle || '=' || CAST(n AS VARCHAR), ',' ORDER BY camera_angle) AS entries FROM (SELECT video_id, camera_angle, count(*) AS n FROM quality_v GROUP BY 1, 2) GROUP BY 1", "quality_v"),
)
def o4(spark, sf):
    n = analysed(spark, sf).groupBy("video_id", "camera_angle").agg(F.count(F.lit(1)).alias("n"))
    return FR.sorted_distribution(n, "camera_angle", "n")


@query(
    "o2_top_rows",
    sql(
        """SELECT video_id, frame_idx, det_id, rank FROM (SELECT video_id, frame_idx, det_id, CAST(row_number() OVER (PARTITION BY video_id ORDER BY conf DESC, mask_area_px DESC, frame_idx, det_id) AS INTEGER) AS rank FROM detections_v) WHERE rank <= 12""",
        "detections_v",
    ),
)
def o2(spark, sf):
    order = [F.col("conf").desc(), F.col("mask_area_px").desc(), F.col("frame_idx"), F.col("det_id")]
    return FR.top_rows(C.detections(spark, sf), 12, order).select("video_id", "frame_idx", "det_id", "rank")


@query(
    "a18_panel",
    sql(
        """SELECT h.video_id, h.phase, 'H' || substr(h.phase, 5) AS label, h.frame_idx, round(coalesce(s.dt_s, 0) * 1000) AS time_ms, round(coalesce(s.speed, 0), 1) AS speed, CASE WHEN s.dt_s IS NULL THEN 0.0 ELSE 0.3 END::DOUBLE AS delta,
  coalesce(h.score, 0) AS pose_quality, CASE WHEN coalesce(h.score, 0) >= 0.75 THEN 'buena' WHEN coalesce(h.score, 0) >= 0.55 THEN 'regular' ELSE 'débil' END AS pose_label
FROM hop_scores_v h LEFT JOIN (SELECT s.video_id, s.id, dt_s, round(round(length_px * m_per_px, 4) / dt_s, 3) AS speed FROM segments_v s JOIN metrics_v m ON m.video_id = s.video_id) s ON s.video_id = h.video_id AND s.id = h.phase""",
        "hop_scores_v", "segments_v", "metrics_v",
    ),
)
def a18(spark, sf):
    from .metric_queries import contacts, full_metrics, metric_frames

    segs = full_metrics(spark, sf).select("video_id", F.inline("segments"))
    rows = MT.contact_arrays(MT.enrich_contacts(contacts(spark, sf), metric_frames(spark, sf), poses=True))
    hops = MT.pose_quality(rows, posed(spark, sf), prototypes(spark, sf)).select("video_id", F.inline("hops"))
    none = segs.select("video_id", F.col("id").alias("segment"), F.lit(None).cast("double").alias("speed_delta_ms"), F.lit("+").alias("indicator"))
    return LB.panel_rows(segs, none, hops.select("video_id", "phase", "score", "frame_idx"))


@query(
    "a18_panel_totals",
    sql(
        """SELECT s.video_id, round(sum(dt_s) * 1000) AS total_time_ms, round(avg(round(round(length_px * m_per_px, 4) / dt_s, 3)), 1) AS avg_speed FROM segments_v s JOIN metrics_v m ON m.video_id = s.video_id WHERE id LIKE 'hop_%' GROUP BY 1""",
        "segments_v", "metrics_v",
    ),
)
def a18_totals(spark, sf):
    from .metric_queries import full_metrics

    return LB.panel_totals(full_metrics(spark, sf).select("video_id", F.inline("segments")), no_speed=None)


@query("s2_restore_frames", sql("SELECT video_id, frame_idx, camera_angle, quality_score FROM quality_v WHERE person_detected", "quality_v"))
def s2(spark, sf):
    from ..operators.frames import restore_frames
    from ..schemas import FRAME_DOC

    f = C.frames(spark, sf).filter("person_detected").withColumn("camera_angle", F.lit("sideways"))
    names = {x.name for x in FRAME_DOC.fields}
    have = f.select("video_id", *[c for c in f.columns if c in names])
    gone = {x.name: F.lit(None).cast(x.dataType) for x in FRAME_DOC.fields if x.name not in have.columns}
    return restore_frames(have.withColumns(gone)).select("video_id", "frame_idx", "camera_angle", "quality_score")


@query("u4_append_distinct", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'F,O' WHEN o_orderstatus = 'O' THEN 'F,O' ELSE 'F,O,P' END AS videos FROM orders")
def u4(spark, sf):
    o = C.table(spark, sf, "orders")
    listed = ED.append_distinct(F.array(F.lit("F"), F.lit("O")), F.array("o_orderstatus"))
    return o.select("o_orderkey", F.array_join(listed, ",").alias("videos"))
