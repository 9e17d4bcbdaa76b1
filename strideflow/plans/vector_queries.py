"""Registered queries: similarity (F25-F28), prototypes (A3, A4, J6), scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pose as P
from ..functions import scores as S
from ..functions import vectors as V
from ..operators import prototypes as PR
from ..schemas import PHASES
from . import carriers as C
from .carriers import rnd, sql, view
from .frame_queries import posed
from .registry import query


# A prototype set derived from the data: the mean pose per quality class.
def proto_source(spark, sf):
    """Ground-truth samples: every third valid pose, tagged by its frame number."""
    f = posed(spark, sf).filter("pose.valid")
    k = F.floor(F.col("frame_idx") / 3)
    return f.select(
        F.lit("a").alias("athlete_id"), "video_id", "frame_idx",
        F.element_at(F.array(*[F.lit(p) for p in ("hop_1", "hop_2", "hop_3", "hop_4", "landing")]),
                     (k % 5 + 1).cast("int")).alias("phase"),
        F.when(k % 5 == 4, "landing").when(k % 7 == 3, "feet_together").when(k % 11 != 5, "hop_contact").alias("pose_tag"),
        P.pose_vector().alias("feature_vector"), F.col("pose.quality").alias("quality_score"),
        "camera_angle",
        F.lit("seed").alias("source"),
    )


view(
    "gt_v",
    """SELECT 'a' AS athlete_id, video_id, frame_idx,
  ['hop_1', 'hop_2', 'hop_3', 'hop_4', 'landing'][(frame_idx // 3) % 5 + 1] AS phase,
  CASE WHEN (frame_idx // 3) % 5 = 4 THEN 'landing' WHEN (frame_idx // 3) % 7 = 3 THEN 'feet_together'
    WHEN (frame_idx // 3) % 11 <> 5 THEN 'hop_contact' END AS pose_tag,
  list_transform(vector, lambda v: round(v, 4)) AS feature_vector, pose_quality AS quality_score, camera_angle
FROM pose_vec_v WHERE valid""",
    "pose_vec_v",
)


def prototypes(spark, sf):
    """Seven phases and three tags averaged from the ground-truth carrier."""
    gt = proto_source(spark, sf)
    empty = spark.createDataFrame(
        [], "kind string, key string, centroid array<double>, weights array<double>, sample_count int"
    )
    k = F.floor(F.col("frame_idx") / 3)
    extra = gt.filter(k % 3 == 0).groupBy(
        F.element_at(F.array(F.lit("approach"), F.lit("final_jump"), F.lit("landing")),
                     (F.floor(k / 3) % 3 + 1).cast("int")).alias("key")
    ).agg(PR.vector_means("feature_vector").alias("centroid"), F.count(F.lit(1)).cast("int").alias("sample_count"))
    phases = extra.select(
        F.lit("phase").alias("kind"), "key", "centroid",
        F.array(*[F.lit(1.0 + 0.1 * i) for i in range(14)]).alias("weights"), "sample_count",
    )
    return PR.rebuild_prototypes(gt, empty.unionByName(phases))


_MEANS = "[" + ", ".join(f"round(avg(feature_vector[{i + 1}]), 4)" for i in range(14)) + "]"
_TAG = """CASE WHEN pose_tag IN ('hop_contact', 'landing', 'feet_together') THEN pose_tag
  WHEN pose_tag IS NULL AND phase = 'landing' THEN 'landing' WHEN pose_tag IS NULL THEN 'hop_contact'
  WHEN phase <> 'landing' THEN 'hop_contact' END"""
view(
    "tag_means_v",
    f"""SELECT * FROM (SELECT {_TAG} AS tag, {_MEANS} AS centroid, count(*) AS n FROM gt_v
WHERE quality_score >= 0.35 GROUP BY 1) WHERE n >= 2 OR tag = 'hop_contact'""",
    "gt_v",
)
view(
    "prototypes_v",
    f"""SELECT 'tag' AS kind, tag AS key, centroid, [1.0::DOUBLE for x in range(14)] AS weights, n AS sample_count FROM tag_means_v
UNION ALL SELECT 'phase', h.h, centroid, [1.0::DOUBLE for x in range(14)], n FROM tag_means_v,
  (SELECT unnest(['hop_1', 'hop_2', 'hop_3', 'hop_4']) AS h) h WHERE tag = 'hop_contact'
UNION ALL SELECT 'phase', ['approach', 'final_jump', 'landing'][(frame_idx // 3 // 3) % 3 + 1] AS key, {_MEANS},
  [1.0::DOUBLE + 0.1::DOUBLE * x for x in range(14)], count(*)
  FROM gt_v WHERE (frame_idx // 3) % 3 = 0 GROUP BY 2""",
    "gt_v", "tag_means_v",
)


def wdist(vec: str, centroid: str, weights: str) -> str:
    return (
        f"sqrt(list_sum([(({vec})[i] - ({centroid})[i])**2 * ({weights})[i] "
        f"for i in range(1, 15)]))"
    )


@query(
    "a3_rebuild_prototypes",
    sql(
        "SELECT kind, key, unnest(range(14)) AS dim, round(unnest(centroid), 4) + 0.0::DOUBLE AS value, sample_count FROM prototypes_v",
        "prototypes_v",
    ),
)
def a3(spark, sf):
    p = prototypes(spark, sf)
    return p.select(
        "kind", "key", F.posexplode("centroid").alias("dim", "value"), "sample_count"
    ).withColumn("value", F.col("value") + 0.0)


@query(
    "f25_score_pose_tag",
    sql(
        f"""SELECT video_id, frame_idx, key AS tag,
  round(least(1.0, exp(-3.5 * {wdist('vector', 'centroid', 'weights')})), 6) AS score,
  round({wdist('vector', 'centroid', 'weights')}, 6) AS distance
FROM pose_vec_v, prototypes_v WHERE kind = 'tag' AND valid""",
        "pose_vec_v", "prototypes_v",
    ),
)
def f25(spark, sf):
    src = PR.with_sheet(posed(spark, sf).filter("pose.valid"), prototypes(spark, sf))
    vec = F.col("pose.vector")
    rows = [
        F.struct(
            F.lit(t).alias("tag"), rnd(PR.tag_score(vec, t)).alias("score"),
            rnd(V.weighted_distance(vec, F.col("_tags")[t]["centroid"], F.col("_tags")[t]["weights"])).alias("distance"),
        )
        for t in PR.TAGS
    ]
    return src.select("video_id", "frame_idx", F.inline(F.array(*rows)))


view(
    "tag_pairs_v",
    "SELECT v.vec_id, v.vector AS a, t.centroid AS b FROM vectors_v v JOIN (SELECT tag, ["
    + ", ".join(f"avg(vector[{i}])" for i in range(1, 15))
    + "] AS centroid FROM vectors_v GROUP BY tag) t ON v.tag = t.tag",
    "vectors_v",
)


def tag_pairs(spark, sf):
    """Every vector next to the mean of its tag."""
    v = C.vectors(spark, sf)
    means = v.groupBy("tag").agg(
        F.array(*[F.avg(F.get("vector", F.lit(i))) for i in range(14)]).alias("b")
    )
    return v.join(means, "tag").select("vec_id", F.col("vector").alias("a"), "b")


@query(
    "f26_cosine_similarity",
    sql(
        """SELECT vec_id, round(c, 6) AS cosine,
  round(greatest(0, least(1, CASE WHEN c < 0 THEN (c + 1) * 0.5 ELSE c END)), 6) AS similarity
FROM (SELECT vec_id, list_cosine_similarity(a, b) AS c FROM tag_pairs_v)""",
        "tag_pairs_v",
    ),
)
def f26(spark, sf):
    a, b = F.col("a"), F.col("b")
    return tag_pairs(spark, sf).select(
        "vec_id", rnd(V.cosine(a, b)).alias("cosine"), rnd(V.similarity01(a, b)).alias("similarity")
    )


@query(
    "f27_vec_distance",
    sql(
        "SELECT vec_id, round(list_distance(a[1:10], b[1:10]), 6) AS distance FROM tag_pairs_v",
        "tag_pairs_v",
    ),
)
def f27(spark, sf):
    return tag_pairs(spark, sf).select(
        "vec_id", rnd(V.vec_distance(F.slice("a", 1, 10), F.col("b"))).alias("distance")
    )


# Templates per "athlete": the videos of the carrier take turns.
def templates(spark, sf):
    gt = proto_source(spark, sf)
    return PR.ema_templates(markers(gt))


def markers(gt):
    return gt.select(
        F.concat(F.lit("ath_"), (F.col("video_id").cast("int") % 3).cast("string")).alias("athlete_id"),
        "phase",
        F.when(F.col("frame_idx") % 2 == 0, F.col("pose_tag")).alias("pose_tag"),
        (F.col("video_id").cast("long") * 1000 + F.col("frame_idx")).alias("confirm_seq"),
        F.col("feature_vector").alias("vector"),
    )


view(
    "ema_v",
    "SELECT athlete_id, kind, key, max(n) AS sample_count, ["
    + ", ".join(
        f"round(sum(CASE WHEN rn = 1 THEN pow(0.75::DOUBLE, n - rn) ELSE 0.25::DOUBLE * pow(0.75::DOUBLE, n - rn) END * vector[{i}]), 4)"
        for i in range(1, 15)
    )
    + """] AS centroid FROM (SELECT *, row_number() OVER (PARTITION BY athlete_id, kind, key ORDER BY confirm_seq) AS rn,
  count(*) OVER (PARTITION BY athlete_id, kind, key) AS n FROM (
  SELECT 'ath_' || CAST(CAST(video_id AS INTEGER) % 3 AS VARCHAR) AS athlete_id,
    CASE WHEN frame_idx % 2 = 0 AND pose_tag IS NOT NULL THEN 'tag' ELSE 'phase' END AS kind,
    CASE WHEN frame_idx % 2 = 0 AND pose_tag IS NOT NULL THEN pose_tag ELSE phase END AS key,
    CAST(video_id AS BIGINT) * 1000 + frame_idx AS confirm_seq, feature_vector AS vector FROM gt_v)) GROUP BY 1, 2, 3""",
    "gt_v",
)


@query(
    "a4_ema_templates",
    sql(
        "SELECT athlete_id, kind, key, sample_count, unnest(range(14)) AS dim, unnest(centroid) + 0.0::DOUBLE AS value FROM ema_v",
        "ema_v",
    ),
)
def a4(spark, sf):
    return templates(spark, sf).select(
        "athlete_id", "kind", "key", "sample_count", F.posexplode("centroid").alias("dim", "value")
    ).withColumn("value", F.col("value") + 0.0)


_PHASE_RANK = "CASE p.key " + " ".join(f"WHEN '{p}' THEN {i}" for i, p in enumerate(PHASES)) + " END"
view(
    "phase_scores_v",
    f"""SELECT f.video_id, f.frame_idx, p.key AS phase, {_PHASE_RANK} AS rank,
  round(least(1.0, CASE WHEN t.centroid IS NOT NULL THEN
      0.65 * exp(-3.5 * {wdist('f.vector', 'p.centroid', 'p.weights')}) + 0.35 * exp(-3.5 * {wdist('f.vector', 't.centroid', '[1 for x in range(14)]')})
    ELSE exp(-3.5 * {wdist('f.vector', 'p.centroid', 'p.weights')}) END * f.pose_quality), 4) AS score
FROM pose_vec_v f JOIN prototypes_v p ON p.kind = 'phase'
LEFT JOIN ema_v t ON t.kind = 'phase' AND t.key = p.key
  AND t.athlete_id = 'ath_' || CAST(CAST(f.video_id AS INTEGER) % 3 AS VARCHAR) WHERE f.valid""",
    "pose_vec_v", "prototypes_v", "ema_v",
)


def with_athlete(df):
    return df.withColumn(
        "athlete_id", F.concat(F.lit("ath_"), (F.col("video_id").cast("int") % 3).cast("string"))
    )


@query(
    "f28_score_phase",
    sql("SELECT video_id, frame_idx, phase, score FROM phase_scores_v", "phase_scores_v"),
)
def f28(spark, sf):
    out = PR.classify_frames(with_athlete(posed(spark, sf)), prototypes(spark, sf), templates(spark, sf))
    return out.select("video_id", "frame_idx", F.explode("scores").alias("phase", "score"))


@query(
    "j6_classify_frames",
    sql(
        """SELECT video_id, frame_idx, phase AS predicted_phase, score AS confidence FROM (
  SELECT *, row_number() OVER (PARTITION BY video_id, frame_idx ORDER BY score DESC, rank) AS rn FROM phase_scores_v) WHERE rn = 1""",
        "phase_scores_v",
    ),
)
def j6(spark, sf):
    out = PR.classify_frames(with_athlete(posed(spark, sf)), prototypes(spark, sf), templates(spark, sf))
    return out.select("video_id", "frame_idx", "predicted_phase", "confidence")


@query(
    "f35_pose_from_prototype",
    sql(
        """SELECT pose_tag, name, round(x, 6) AS x, round(y, 6) AS y FROM (
  SELECT tag AS pose_tag, unnest([{'name': 'l_hip', 'x': -0.14::DOUBLE, 'y': 0::DOUBLE},
    {'name': 'l_knee', 'x': -0.14 + 0.42 * sin(lb * 0.35), 'y': 0.42 * cos(lb * 0.15)},
    {'name': 'l_ankle', 'x': -(sep * 0.5 + asym * 0.15), 'y': 0.42 * cos(lb * 0.15) + 0.45 * 0.95},
    {'name': 'r_hip', 'x': 0.14::DOUBLE, 'y': 0::DOUBLE},
    {'name': 'r_knee', 'x': 0.14 - 0.42 * sin(rb * 0.35), 'y': 0.42 * cos(rb * 0.15)},
    {'name': 'r_ankle', 'x': sep * 0.5 + asym * 0.15, 'y': 0.42 * cos(rb * 0.15) + 0.45 * 0.95}], recursive := true)
  FROM (SELECT tag, radians(180 - greatest(60, least(175, 90 + centroid[1] * 90))) AS lb,
    radians(180 - greatest(60, least(175, 90 + centroid[2] * 90))) AS rb,
    greatest(0.1, least(1.0, CASE WHEN centroid[4] > 0.05 THEN centroid[4] ELSE 0.35 END)) AS sep,
    greatest(0, least(0.8, CASE WHEN centroid[5] < 2 THEN centroid[5] ELSE 0.25 END)) AS asym FROM tag_means_v))""",
        "tag_means_v",
    ),
)
def f35(spark, sf):
    return PR.pose_from_prototype(prototypes(spark, sf), PR.TAGS).select(
        "pose_tag", F.inline("keypoints")
    ).withColumns({"x": rnd(F.col("x")), "y": rnd(F.col("y"))})


# ------------------------------------------------------------ labels and scores

@query(
    "f22_label_pose",
    sql(
        """SELECT video_id, frame_idx, CASE WHEN quality_score >= 0.75 THEN 'buena' WHEN quality_score >= 0.55 THEN 'regular'
  WHEN quality_score IS NOT NULL THEN 'débil' END AS label FROM quality_v""",
        "quality_v",
    ),
)
def f22(spark, sf):
    from .frame_queries import analysed

    return analysed(spark, sf).select("video_id", "frame_idx", S.label_pose(F.col("quality_score")).alias("label"))


@query(
    "f23_indicator",
    """SELECT l_orderkey, l_linenumber, q, mean, CASE WHEN abs(mean) < 1e-9 THEN
    CASE WHEN abs(q) < 1e-9 THEN '~' WHEN q > 0 THEN '+' ELSE '−' END
  WHEN abs((q - mean) / abs(mean)) <= 0.08 THEN '~' WHEN q > mean THEN '+' ELSE '−' END AS indicator
FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) - 20 AS q, max(l_suppkey) % 60 - 20.0::DOUBLE AS mean FROM lineitem GROUP BY ALL)""",
)
def f23(spark, sf):
    li = C.table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        (F.max("l_quantity") - 20).alias("q"), (F.max("l_suppkey") % 60 - 20.0).alias("mean")
    )
    return li.withColumn("indicator", S.indicator(F.col("q"), F.col("mean")))


@query(
    "f24_safe_div",
    """SELECT l_orderkey, l_linenumber, round(CASE WHEN abs(d) >= 1e-12 THEN q / d END, 6) AS ratio
FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS q, max(l_discount) AS d FROM lineitem GROUP BY ALL)""",
)
def f24(spark, sf):
    from ..functions.geometry import safe_div

    li = C.table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.max("l_quantity").alias("q"), F.max("l_discount").alias("d")
    )
    return li.select("l_orderkey", "l_linenumber", rnd(safe_div(F.col("q"), F.col("d"))).alias("ratio"))


@query(
    "f29_fused_score",
    sql(
        """SELECT video_id, frame_idx, round(0.40::DOUBLE * p + 0.45::DOUBLE * h + 0.15::DOUBLE * CASE surface WHEN 'track' THEN 1.0 WHEN 'unknown' THEN 0.55 ELSE 0.15 END, 6) AS hop_score,
  round(0.40::DOUBLE * p + 0.45::DOUBLE * l + 0.15::DOUBLE * CASE surface WHEN 'sand' THEN 1.0 WHEN 'unknown' THEN 0.35 ELSE 0.1 END, 6) AS landing_score
FROM (SELECT *, least(1, value / 500) AS p, (frame_idx % 17) / 17.0::DOUBLE AS h, (frame_idx % 13) / 13.0::DOUBLE AS l FROM signals_v)""",
        "signals_v",
    ),
)
def f29(spark, sf):
    s = C.signals(spark, sf)
    p = F.least(F.lit(1.0), F.col("value") / 500)
    h, lnd = (F.col("frame_idx") % 17) / 17.0, (F.col("frame_idx") % 13) / 13.0
    return s.select(
        "video_id", "frame_idx", rnd(S.fused_score(p, h, lnd, F.col("surface"))).alias("hop_score"),
        rnd(S.fused_score(p, h, lnd, F.col("surface"), prefer_landing=True)).alias("landing_score"),
    )


@query(
    "f30_blend_mask_score",
    sql(
        """SELECT video_id, frame_idx, det_id, round(appearance_sim + 0.30::DOUBLE * track_ov + 0.20::DOUBLE * sand_ov, 6) AS score,
  round(appearance_sim + 0.30::DOUBLE * track_ov + 0.45::DOUBLE * sand_ov, 6) AS landing_score FROM detections_v""",
        "detections_v",
    ),
)
def f30(spark, sf):
    a = [F.col(c) for c in ("appearance_sim", "track_ov", "sand_ov")]
    return C.detections(spark, sf).select(
        "video_id", "frame_idx", "det_id", rnd(S.blend_mask_score(*a)).alias("score"),
        rnd(S.blend_mask_score(*a, 0.45)).alias("landing_score"),
    )


@query(
    "f31_zone",
    sql(
        """SELECT video_id, frame_idx, CASE WHEN p >= 0.90 THEN 'landing' WHEN p >= 0.30 THEN 'mid' ELSE 'early' END AS zone
FROM (SELECT video_id, frame_idx, CASE WHEN count(*) OVER w = 1 THEN 0.5 ELSE percent_rank() OVER (PARTITION BY video_id ORDER BY frame_idx) END AS p
  FROM signals_v WINDOW w AS (PARTITION BY video_id))""",
        "signals_v",
    ),
)
def f31(spark, sf):
    from ..operators.sequence import progress

    return progress(C.signals(spark, sf).select("video_id", "frame_idx")).select(
        "video_id", "frame_idx", S.zone(F.col("progress")).alias("zone")
    )


@query(
    "f38_clean_athlete_id",
    """SELECT c_custkey, trim(regexp_replace(trim(c_name || ' #' || c_mktsegment || ' ñ!'), '[^\\p{L}\\p{N}_\\s\\-]', '', 'g')) AS athlete,
  regexp_replace(lower(translate(c_mktsegment || ' Peña', 'ñ', 'n')), '\\s+', '-', 'g') AS slug FROM customer""",
)
def f38(spark, sf):
    c = C.table(spark, sf, "customer")
    return c.select(
        "c_custkey",
        S.clean_athlete_id(F.concat_ws("", F.col("c_name"), F.lit(" #"), F.col("c_mktsegment"), F.lit(" ñ!"))).alias("athlete"),
        S.slug(F.concat(F.col("c_mktsegment"), F.lit(" Peña"))).alias("slug"),
    )


@query(
    "f40_success_pct",
    sql(
        """SELECT video_id, CAST(round(coalesce(c, p, h) * 100) AS INTEGER) AS success_pct FROM (SELECT video_id,
  CASE WHEN CAST(video_id AS BIGINT) % 3 = 0 THEN intervals_s[1] END AS c, CASE WHEN CAST(video_id AS BIGINT) % 3 = 1 THEN intervals_s[2] END AS p,
  list_sum([coalesce(x, 0) for x in intervals_s]) / 4 AS h FROM sessions_v)""",
        "sessions_v",
    ),
)
def f40(spark, sf):
    s = C.sessions(spark, sf)
    k = F.col("video_id").cast("long") % 3
    return s.select(
        "video_id",
        S.success_pct(F.when(k == 0, F.col("intervals_s")[0]), F.when(k == 1, F.col("intervals_s")[1]), F.col("intervals_s")).alias("success_pct"),
    )


@query(
    "f41_analysis_state",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'none' WHEN o_orderkey % 7 >= 4 AND o_custkey % 5 > 0 THEN 'full' ELSE 'partial' END AS state FROM orders""",
)
def f41(spark, sf):
    o = C.table(spark, sf, "orders")
    return o.select(
        "o_orderkey",
        S.analysis_state(F.col("o_orderstatus") != "P", F.col("o_orderkey") % 7, F.col("o_custkey") % 5).alias("state"),
    )


@query(
    "f42_duration_label",
    """SELECT o_orderkey, CAST(s // 60 AS VARCHAR) || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS label
FROM (SELECT o_orderkey, CAST(greatest(0, round(o_totalprice / 100)) AS BIGINT) AS s FROM orders)""",
)
def f42(spark, sf):
    return C.table(spark, sf, "orders").select("o_orderkey", S.duration_label(F.col("o_totalprice") / 100).alias("label"))


@query(
    "f43_contact_confidence",
    sql(
        """SELECT video_id, frame_idx, round(CASE WHEN surface <> 'unknown' THEN least(1, b + 0.1) ELSE b END, 6) AS confidence FROM (
  SELECT *, least(1, 0.25 + 0.55 * (value / 500) + 0.2 * ((frame_idx % 17) / 17.0::DOUBLE)) AS b FROM signals_v)""",
        "signals_v",
    ),
)
def f43(spark, sf):
    return C.signals(spark, sf).select(
        "video_id", "frame_idx",
        rnd(S.contact_confidence(F.col("value") / 500, (F.col("frame_idx") % 17) / 17.0, F.col("surface"))).alias("confidence"),
    )


@query(
    "f44_delta_vs_row",
    """SELECT o_orderkey, CASE WHEN d IS NOT NULL THEN d WHEN s = '+' THEN 0.3::DOUBLE WHEN s = '−' THEN -0.3::DOUBLE ELSE 0 END AS delta FROM (
  SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN round(o_totalprice / 1000, 3) END AS d,
    CASE o_orderstatus WHEN 'F' THEN '+' WHEN 'O' THEN '−' ELSE '~' END AS s FROM orders)""",
)
def f44(spark, sf):
    o = C.table(spark, sf, "orders")
    sign = F.when(F.col("o_orderstatus") == "F", "+").when(F.col("o_orderstatus") == "O", "−").otherwise("~")
    d = F.when(F.col("o_orderkey") % 3 == 0, F.round(F.col("o_totalprice") / 1000, 3))
    return o.select("o_orderkey", S.delta_vs_row(d, sign).alias("delta"))
