"""Registered queries: segments, scale and pose quality
and the comparison with history (A5 - A8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import history as H
from ..operators import metrics as MT
from ..operators import prototypes as PR
from . import carriers as C
from .carriers import rnd, sql, view
from .frame_queries import posed
from .registry import query
from .vector_queries import proto_source, prototypes, wdist

def vid():
    return F.col("video_id").cast("int")


# ------------------------------------------------------------ carriers

def contacts(spark, sf):
    """Up to five contacts per video on fixed frames."""
    f = C.frames(spark, sf).filter(F.col("frame_idx").isin(30, 57, 84, 111, 138)).filter(
        ~((vid() % 4 == 3) & (F.col("frame_idx") > 100))
    )
    i = ((F.col("frame_idx") - 30) / 27 + 1).cast("int")
    phase = F.when(i == 5, "landing").otherwise(F.concat(F.lit("hop_"), i.cast("string")))
    return f.select(
        "video_id", "frame_idx", i.alias("index"), "timestamp_s", phase.alias("phase"),
        F.when(i == 5, "landing").otherwise("hop").alias("type"), F.lit(None).cast("double").alias("position_s"),
    )


def metric_frames(spark, sf):
    """Frames without their poses: the metrics work those out where there is a contact."""
    return C.frames(spark, sf).withColumn("position_s", F.when(vid() % 3 == 1, F.col("position_s")))


def metric_keyframes(spark, sf):
    return C.keyframes(spark, sf).filter(vid() % 3 != 2)


def metric_videos(spark, sf):
    none = F.lit(None)
    scale = "struct<known_distance_m:double,ax:double,ay:double,bx:double,by:double>"
    return C.frames(spark, sf).select("video_id").distinct().select(
        "video_id", F.concat(F.lit("ath_"), (vid() % 3).cast("string")).alias("athlete_id"),
        F.when(vid() % 2 == 0, 8.0 + vid() % 5).alias("corridor_m"),
        none.cast("array<double>").alias("ov_hop_m"), none.cast("double").alias("ov_m_per_px"),
        none.cast(scale).alias("ov_scale"),
    )


view(
    "contacts_v",
    """SELECT f.*, CAST((f.frame_idx - 30) / 27 + 1 AS INTEGER) AS idx,
  CASE CAST(f.video_id AS INTEGER) % 3 WHEN 1 THEN f.position_s WHEN 0 THEN coalesce(
    (bx1 + bx2) / 2 * (dx / n) + by2 * (dy / n) - (ox * 1280 * (dx / n) + oy * 720 * (dy / n)),
    foot_px * (dx / n) + foot_py * (dy / n) - (ox * 1280 * (dx / n) + oy * 720 * (dy / n))) END AS pos
FROM (SELECT f.*, i.ox, i.oy, i.dx, i.dy, sqrt(i.dx**2 + i.dy**2) AS n FROM foot_v f
  JOIN interp_v i ON i.video_id = f.video_id AND i.frame_idx = f.frame_idx) f
WHERE f.frame_idx IN (30, 57, 84, 111, 138) AND NOT (CAST(f.video_id AS INTEGER) % 4 = 3 AND f.frame_idx > 100)""",
    "foot_v", "interp_v",
)
view(
    "segments_v",
    """SELECT *, CASE WHEN k = cnt - 1 AND k < 4 THEN 'final' ELSE 'hop_' || CAST(k AS VARCHAR) END AS id, round(t1 - t0, 4) AS dt_s, round(raw.px, 2) AS length_px, raw.method AS length_method
FROM (SELECT video_id, idx AS k, cnt, frame_idx AS from_frame, f1 AS to_frame, timestamp_s AS t0, t1,
  CASE WHEN pos IS NOT NULL AND p1 IS NOT NULL THEN {'px': abs(p1 - pos), 'method': 'position_s'}
    WHEN foot_px IS NOT NULL AND x1 IS NOT NULL THEN {'px': CASE WHEN abs(x1 - foot_px) >= abs(y1 - foot_py) * 0.5 THEN abs(x1 - foot_px)
      ELSE sqrt((x1 - foot_px)**2 + (y1 - foot_py)**2) END, 'method': 'foot_dx'} ELSE {'px': NULL, 'method': 'none'} END AS raw
FROM (SELECT *, count(*) OVER (PARTITION BY video_id) AS cnt, lead(frame_idx) OVER w AS f1, lead(timestamp_s) OVER w AS t1, lead(pos) OVER w AS p1,
  lead(foot_px) OVER w AS x1, lead(foot_py) OVER w AS y1 FROM contacts_v WINDOW w AS (PARTITION BY video_id ORDER BY frame_idx)))
WHERE to_frame IS NOT NULL""",
    "contacts_v",
)
view(
    "metrics_v",
    """SELECT s.*, CASE WHEN total_hops_px > 1e-3 THEN corridor_m / total_px END AS m_per_px FROM (
  SELECT video_id, any_value(cnt) AS contact_count, sum(length_px) FILTER (k <= 4) AS total_px,
    round(sum(length_px) FILTER (k <= 4), 2) AS total_hops_px,
    CASE WHEN CAST(video_id AS INTEGER) % 2 = 0 THEN 8.0 + CAST(video_id AS INTEGER) % 5 ELSE 10.0 END::DOUBLE AS corridor_m
  FROM segments_v GROUP BY video_id) s""",
    "segments_v",
)


def full_metrics(spark, sf):
    return MT.compute_metrics(
        contacts(spark, sf), metric_frames(spark, sf), metric_videos(spark, sf), metric_keyframes(spark, sf)
    )


@query(
    "e12_segments",
    sql(
        """SELECT s.video_id, id, from_frame, to_frame, dt_s, length_px, length_method, round(length_px * m_per_px, 4) AS length_m,
  round(length_px / dt_s, 2) AS speed_px_s, round(round(length_px * m_per_px, 4) / dt_s, 3) AS speed_m_s
FROM segments_v s JOIN metrics_v m ON m.video_id = s.video_id""",
        "segments_v", "metrics_v",
    ),
)
def e12(spark, sf):
    return full_metrics(spark, sf).select("video_id", F.inline("segments")).drop("pair")


view(
    "approach_v",
    """SELECT video_id, 'approach' AS id, from_frame, to_frame, round(t1 - t0, 4) AS dt_s, round(raw.px, 2) AS length_px, raw.method AS length_method FROM (
  SELECT video_id, from_frame, to_frame, t0, t1, CASE WHEN pos0 IS NOT NULL AND pos IS NOT NULL THEN {'px': abs(pos - pos0), 'method': 'position_s'}
    WHEN v % 3 = 0 AND n > 0 AND fx0 IS NOT NULL AND foot_px IS NOT NULL THEN {'px': abs((foot_px - fx0) * dx / n + (foot_py - fy0) * dy / n), 'method': 'foot_axis'}
    WHEN fx0 IS NOT NULL AND foot_px IS NOT NULL THEN {'px': CASE WHEN abs(foot_px - fx0) >= abs(foot_py - fy0) * 0.5 THEN abs(foot_px - fx0) ELSE sqrt((foot_px - fx0)**2 + (foot_py - fy0)**2) END, 'method': 'foot_dx'}
    WHEN cx0 IS NOT NULL AND bx1 IS NOT NULL THEN {'px': sqrt(((bx1 + bx2) / 2 - cx0)**2 + ((by1 + by2) / 2 - cy0)**2), 'method': 'bbox_center'} ELSE {'px': NULL, 'method': 'none'} END AS raw
  FROM (SELECT c.*, CAST(c.video_id AS INTEGER) AS v, a.frame_idx AS from_frame, c.frame_idx AS to_frame, a.timestamp_s AS t0, c.timestamp_s AS t1, a.foot_px AS fx0, a.foot_py AS fy0, (a.bx1 + a.bx2) / 2 AS cx0, (a.by1 + a.by2) / 2 AS cy0,
      CASE CAST(c.video_id AS INTEGER) % 3 WHEN 1 THEN a.position_s WHEN 0 THEN (a.bx1 + a.bx2) / 2 * (dx / n) + a.by2 * (dy / n) - (ox * 1280 * (dx / n) + oy * 720 * (dy / n)) END AS pos0
    FROM contacts_v c JOIN foot_v a ON a.video_id = c.video_id AND a.frame_idx = 3 WHERE c.idx = 1 AND CAST(c.video_id AS INTEGER) % 2 = 0))""",
    "contacts_v", "foot_v",
)


@query(
    "e12_approach",
    sql(
        """SELECT video_id, id, from_frame, to_frame, dt_s, length_px, length_method FROM approach_v
UNION ALL SELECT video_id, id, from_frame, to_frame, dt_s, length_px, length_method FROM segments_v""",
        "approach_v", "segments_v",
    ),
)
def e12_approach(spark, sf):
    some = C.frames(spark, sf).select("video_id").distinct().filter(vid() % 2 == 0)
    phases = some.select("video_id", F.lit("approach").alias("phase"), F.lit(3).alias("start_frame"), F.lit(29).alias("end_frame"))
    full = MT.compute_metrics(contacts(spark, sf), metric_frames(spark, sf), metric_videos(spark, sf), metric_keyframes(spark, sf), phases)
    return full.select("video_id", F.inline("segments")).select("video_id", "id", "from_frame", "to_frame", "dt_s", "length_px", "length_method")


@query(
    "e13_hop_slots",
    sql(
        """SELECT video_id, slot, CASE WHEN slot < 5 THEN px[slot] WHEN cnt >= 5 AND px[4] IS NOT NULL THEN px[4] ELSE last_px END AS px FROM (
  SELECT video_id, [max(length_px) FILTER (k = 1), max(length_px) FILTER (k = 2), max(length_px) FILTER (k = 3), max(length_px) FILTER (k = 4)] AS px,
    arg_max(length_px, k) FILTER (length_px IS NOT NULL AND k = cnt - 1) AS last_px, any_value(cnt) AS cnt FROM segments_v GROUP BY video_id), range(1, 6) r(slot)""",
        "segments_v",
    ),
)
def e13(spark, sf):
    rows = MT.contact_arrays(
        MT.enrich_contacts(contacts(spark, sf), metric_frames(spark, sf), metric_keyframes(spark, sf))
    )
    out = MT.slot_five_rule(MT.segments(rows))
    return out.select("video_id", F.posexplode("hop_px").alias("slot", "px")).withColumn("slot", F.col("slot") + 1)


@query(
    "a19_hop_totals",
    sql(
        """SELECT video_id, total_hops_px, CASE WHEN contact_count >= 5 THEN round(corridor_m, 4) ELSE round(total_hops_px * m_per_px, 4) END AS total_hops_m FROM metrics_v""",
        "metrics_v",
    ),
)
def a19(spark, sf):
    return full_metrics(spark, sf).select("video_id", "total_hops_px", "total_hops_m")


@query(
    "m7_compute_metrics",
    sql(
        """SELECT video_id, contact_count, round(m_per_px, 8) AS m_per_px, CASE WHEN m_per_px IS NULL THEN 'none' ELSE 'hops_corridor' END AS scale_source,
  m_per_px IS NULL AS meters_estimated, CAST(video_id AS INTEGER) % 3 <> 2 AS has_axis FROM metrics_v""",
        "metrics_v",
    ),
)
def m7(spark, sf):
    return full_metrics(spark, sf).select(
        "video_id", "contact_count", rnd(F.col("m_per_px"), 8).alias("m_per_px"), "scale_source", "meters_estimated", "has_axis"
    )


@query(
    "m7_session_snapshot",
    sql(
        """SELECT 'ath_' || CAST(CAST(s.video_id AS INTEGER) % 3 AS VARCHAR) AS athlete_id, s.video_id, k AS slot, dt_s AS interval_s,
  round(round(length_px * m_per_px, 4) / dt_s, 3) AS speed_m_s FROM segments_v s JOIN metrics_v m ON m.video_id = s.video_id""",
        "segments_v", "metrics_v",
    ),
)
def m7_snapshot(spark, sf):
    snap = MT.session_snapshot(full_metrics(spark, sf))
    pairs = F.arrays_zip(F.col("intervals_s").alias("i"), F.col("speeds_m_s").alias("s"))
    return snap.select("athlete_id", "video_id", F.posexplode(pairs).alias("slot", "p")).select(
        "athlete_id", "video_id", (F.col("slot") + 1).alias("slot"), F.col("p.i").alias("interval_s"), F.col("p.s").alias("speed_m_s")
    )


@query(
    "j22_foot_lengths",
    sql("SELECT video_id, from_frame, to_frame, length_px, length_method FROM segments_v", "segments_v"),
)
def j22(spark, sf):
    rows = MT.contact_arrays(
        MT.enrich_contacts(contacts(spark, sf), metric_frames(spark, sf), metric_keyframes(spark, sf))
    )
    return MT.segments(rows).select("video_id", F.inline("segments")).select(
        "video_id", "from_frame", "to_frame", "length_px", "length_method"
    )


@query(
    "j13_resolve_scale",
    sql(
        """SELECT video_id, scale_source, round(v, 6) AS m_per_px FROM (SELECT video_id,
  CASE WHEN c THEN 'hops_corridor' WHEN r IS NOT NULL THEN 'override_hop_lengths' WHEN k % 5 = 2 THEN 'override_m_per_px'
    WHEN k % 5 = 3 THEN 'override_known_distance' WHEN k % 7 > 2 THEN 'calibration_scale' ELSE 'none' END AS scale_source,
  CASE WHEN c THEN 10.0 / total WHEN r IS NOT NULL THEN r WHEN k % 5 = 2 THEN 0.01 WHEN k % 5 = 3 THEN 4.0 / sqrt(300**2 + 100**2)
    WHEN k % 7 > 2 THEN 5.0 / sqrt((0.5 * 1280)**2 + (0.25 * 720)**2) END AS v
FROM (SELECT video_id, CAST(video_id AS BIGINT) AS k, list_sum(lengths_m[1:4]) * 10 AS total,
  CAST(video_id AS BIGINT) % 5 = 0 AND coalesce(list_sum(lengths_m[1:4]) * 10, 0) > 1e-3 AS c,
  CASE WHEN CAST(video_id AS BIGINT) % 5 = 1 THEN list_avg([CASE WHEN l * 10 > 1e-3 AND i > 0 THEN i / (l * 10) END for l, i in [1]]) END AS r0,
  CASE WHEN CAST(video_id AS BIGINT) % 5 = 1 THEN list_avg(list_transform(range(1, 5), lambda j: CASE WHEN lengths_m[j] * 10 > 1e-3 AND intervals_s[j] > 0 THEN intervals_s[j] / (lengths_m[j] * 10) END)) END AS r
FROM sessions_v))""".replace(
            "CASE WHEN CAST(video_id AS BIGINT) % 5 = 1 THEN list_avg([CASE WHEN l * 10 > 1e-3 AND i > 0 THEN i / (l * 10) END for l, i in [1]]) END AS r0,\n", ""
        ),
        "sessions_v",
    ),
)
def j13(spark, sf):
    k = F.col("video_id").cast("long")

    def line(known, bx, by):
        return F.struct(F.lit(known).alias("known_distance_m"), F.lit(0.0).alias("ax"), F.lit(0.0).alias("ay"),
                        F.lit(bx).alias("bx"), F.lit(by).alias("by"))

    rows = C.sessions(spark, sf).select(
        "video_id", F.transform("lengths_m", lambda v: v * 10).alias("hop_px"),
        F.when(k % 5 == 0, 10.0).alias("corridor_m"), F.when(k % 5 == 1, F.col("intervals_s")).alias("ov_hop_m"),
        F.when(k % 5 == 2, 0.01).alias("ov_m_per_px"), F.when(k % 5 == 3, line(4.0, 300.0, 100.0)).alias("ov_scale"),
        F.when(k % 7 > 2, line(5.0, 0.5, 0.25)).alias("kf_scale"),
    )
    return MT.resolve_scale(rows).select("video_id", "scale_source", rnd(F.col("m_per_px")).alias("m_per_px"))


@query(
    "a20_phase_durations",
    sql(
        """SELECT p.video_id, p.phase, round(coalesce(b.timestamp_s - a.timestamp_s, (p.e - p.s) / 30.0::DOUBLE), 4) AS duration_s FROM (
  SELECT video_id, 'hop_4' AS phase, 30 AS s, CAST(max(track_id) % 40 + 60 AS INTEGER) AS e FROM frames_v GROUP BY 1
  UNION ALL SELECT DISTINCT video_id, 'final_jump', 50, 110 FROM frames_v
  UNION ALL SELECT video_id, 'landing', 111, CASE WHEN max(track_id) % 2 = 0 THEN 140 END FROM frames_v GROUP BY 1) p
LEFT JOIN frames_v a ON a.video_id = p.video_id AND a.frame_idx = p.s LEFT JOIN frames_v b ON b.video_id = p.video_id AND b.frame_idx = p.e""",
        "frames_v",
    ),
)
def a20(spark, sf):
    from .join_queries import phase_bounds

    return MT.phase_durations(phase_bounds(spark, sf), C.frames(spark, sf))


@query(
    "e20_flight_samples",
    sql(
        """SELECT o_orderkey, unnest(list_sort(list_distinct(list_concat(
    list_transform(range(1, 13), lambda i: CASE WHEN a + i * step < b THEN a + i * step END),
    [CASE WHEN a + (b - a) // 2 > a AND a + (b - a) // 2 < b THEN a + (b - a) // 2 END, CASE WHEN near > a AND near < b THEN near END])))) AS frame_idx
FROM (SELECT *, greatest(a + 1, b - greatest(1, step // 2)) AS near FROM (SELECT *, greatest(1, (b - a) // 12) AS step FROM (
  SELECT o_orderkey, o_orderkey % 50 AS a, o_orderkey % 50 + o_custkey % 45 AS b FROM orders))) WHERE b > a""",
    ),
)
def e20(spark, sf):
    o = C.table(spark, sf, "orders")
    a = (F.col("o_orderkey") % 50).cast("int")
    b = (a + F.col("o_custkey") % 45).cast("int")
    return o.select("o_orderkey", F.explode(MT.flight_samples(a, b)).alias("frame_idx"))


_ONES = "[1 for x in range(14)]"
_R4 = "list_transform(vector, lambda v: round(v, 4))"
view(
    "hop_scores_v",
    f"""SELECT c.video_id, c.frame_idx, 'hop_' || CAST(c.idx AS VARCHAR) AS phase, CASE WHEN c.valid THEN round(list_avg([
    CASE WHEN least(1, exp(-3.5 * {wdist('c.r', 't.centroid', _ONES)})) > 0 THEN least(1, exp(-3.5 * {wdist('c.r', 't.centroid', _ONES)})) END,
    CASE WHEN list_cosine_similarity(c.r, p.centroid) < 0 THEN (list_cosine_similarity(c.r, p.centroid) + 1) / 2 ELSE list_cosine_similarity(c.r, p.centroid) END]), 3) END AS score
FROM (SELECT *, {_R4} AS r FROM contacts_v WHERE idx <= 4) c
JOIN prototypes_v t ON t.kind = 'tag' AND t.key = 'hop_contact' JOIN prototypes_v p ON p.kind = 'phase' AND p.key = 'hop_' || CAST(c.idx AS VARCHAR)""",
    "contacts_v", "prototypes_v",
)
# Every contact of a take, and the flight frames between the fourth and the fifth.
view(
    "flight_scores_v",
    """SELECT f.video_id, f.frame_idx, round(f.flight_score, 3) AS score FROM pose_vec_v f WHERE f.valid
  AND CAST(f.video_id AS INTEGER) % 4 <> 3 AND f.frame_idx IN (113, 115, 117, 119, 121, 123, 125, 127, 129, 131, 133, 135, 124, 137)""",
    "pose_vec_v",
)


@query(
    "a9_pose_quality",
    sql(
        """SELECT video_id, from_frame, to_frame, hop_mean, flight_score, flight_label, round(CASE WHEN flight_score IS NULL THEN hop_sum / hop_n
    ELSE (coalesce(hop_sum, 0) + flight_score) / (hop_n + 1) END, 3) AS overall FROM (
  SELECT h.video_id, CASE WHEN CAST(h.video_id AS INTEGER) % 4 <> 3 THEN 111 END AS from_frame, CASE WHEN CAST(h.video_id AS INTEGER) % 4 <> 3 THEN 138 END AS to_frame,
    round(avg(h.score), 6) AS hop_mean, sum(h.score) AS hop_sum, count(h.score) AS hop_n,
    (SELECT round(avg(score), 3) FROM flight_scores_v f WHERE f.video_id = h.video_id) AS flight_score,
    (SELECT CASE WHEN avg(score) >= 0.75 THEN 'buena' WHEN avg(score) >= 0.55 THEN 'regular' WHEN avg(score) IS NOT NULL THEN 'débil' END FROM flight_scores_v f WHERE f.video_id = h.video_id) AS flight_label
  FROM hop_scores_v h GROUP BY h.video_id)""",
        "hop_scores_v", "flight_scores_v",
    ),
)
def a9(spark, sf):
    rows = MT.contact_arrays(MT.enrich_contacts(contacts(spark, sf), metric_frames(spark, sf), poses=True))
    out = MT.pose_quality(rows, posed(spark, sf), prototypes(spark, sf))
    return out.select(
        "video_id", "from_frame", "to_frame",
        rnd(V.average(F.transform("hops", lambda h: h["score"]))).alias("hop_mean"), "flight_score", "flight_label", "overall",
    )


# ------------------------------------------------------------ history

view(
    "gt_gaps_v",
    """SELECT video_id, unnest(['hop_1', 'hop_2', 'hop_3', 'hop_4']) AS segment, unnest([t1 - t0, t2 - t1, t3 - t2, t4 - t3]) AS dt_s FROM (
  SELECT video_id, max(frame_idx) FILTER (phase = 'hop_1') / 30.0::DOUBLE AS t0, max(frame_idx) FILTER (phase = 'hop_2') / 30.0::DOUBLE AS t1,
    max(frame_idx) FILTER (phase = 'hop_3') / 30.0::DOUBLE AS t2, max(frame_idx) FILTER (phase = 'hop_4') / 30.0::DOUBLE AS t3,
    max(frame_idx) FILTER (phase = 'landing') / 30.0::DOUBLE AS t4, count(DISTINCT phase) AS n FROM gt_v GROUP BY 1) WHERE n = 5""",
    "gt_v",
)


@query(
    "a6_gt_intervals",
    sql("SELECT video_id, segment, round(dt_s, 6) AS dt_s FROM gt_gaps_v WHERE dt_s > 0", "gt_gaps_v"),
)
def a6(spark, sf):
    return H.gt_intervals(proto_source(spark, sf)).withColumn("dt_s", rnd(F.col("dt_s")))


view(
    "session_slots_v",
    """SELECT athlete_id, video_id, 'hop_' || CAST(i AS VARCHAR) AS segment, CASE WHEN intervals_s[i] > 0 THEN intervals_s[i] END AS dt,
  CASE WHEN speeds_m_s[i] > 0 THEN speeds_m_s[i] END AS sp, CASE WHEN lengths_m[i] > 0 THEN lengths_m[i] END AS ln FROM sessions_v, range(1, 5) r(i)""",
    "sessions_v",
)
view(
    "baseline_v",
    """SELECT video_id, segment, sessions_used, samples, round(sdt / samples, 4) AS dt_mean_s, round(ssp / nsp, 3) AS speed_mean_m_s, round(sln / nln, 4) AS length_mean_m
FROM (SELECT video_id, segment, count(*) OVER w - 1 AS sessions_used, count(dt) OVER w - CASE WHEN dt IS NULL THEN 0 ELSE 1 END AS samples,
  sum(dt) OVER w - coalesce(dt, 0) AS sdt, sum(sp) OVER w - coalesce(sp, 0) AS ssp, count(sp) OVER w - CASE WHEN sp IS NULL THEN 0 ELSE 1 END AS nsp,
  sum(ln) OVER w - coalesce(ln, 0) AS sln, count(ln) OVER w - CASE WHEN ln IS NULL THEN 0 ELSE 1 END AS nln
  FROM session_slots_v WINDOW w AS (PARTITION BY segment))""",
    "session_slots_v",
)


@query(
    "a5_general_baseline",
    sql(
        """SELECT video_id, segment, sessions_used, samples, round(dt_mean_s, 4) AS dt_mean_s, speed_mean_m_s, length_mean_m, false AS limited FROM baseline_v""",
        "baseline_v",
    ),
)
def a5(spark, sf):
    s = C.sessions(spark, sf)
    return H.general_baseline(s, videos=s.select("video_id"))


view(
    "general_v",
    """SELECT b.video_id, b.segment, round(o.dt, 4) AS dt_s, dt_mean_s, round(o.dt - dt_mean_s, 4) AS dt_delta_s, round(o.sp, 3) AS speed_m_s, speed_mean_m_s,
  round(o.sp - speed_mean_m_s, 3) AS speed_delta_ms, round(o.ln, 4) AS length_m, length_mean_m, round(o.ln - length_mean_m, 4) AS length_delta_m,
  coalesce(CASE WHEN o.dt IS NULL THEN NULL WHEN abs((o.dt - dt_mean_s) / dt_mean_s) <= 0.08 THEN '~' WHEN o.dt > dt_mean_s THEN '+' ELSE '−' END,
    CASE WHEN o.sp IS NULL THEN NULL WHEN abs((o.sp - speed_mean_m_s) / speed_mean_m_s) <= 0.08 THEN '~' WHEN o.sp > speed_mean_m_s THEN '+' ELSE '−' END,
    CASE WHEN o.ln IS NULL THEN NULL WHEN abs((o.ln - length_mean_m) / length_mean_m) <= 0.08 THEN '~' WHEN o.ln > length_mean_m THEN '+' ELSE '−' END) AS indicator,
  coalesce(greatest(0, least(1, 1 - abs(o.dt - dt_mean_s) / dt_mean_s)), greatest(0, least(1, 1 - abs(o.sp - speed_mean_m_s) / speed_mean_m_s))) AS closeness
FROM baseline_v b JOIN (SELECT video_id, 'hop_' || CAST(i AS VARCHAR) AS segment, intervals_s[i] AS dt, speeds_m_s[i] AS sp, lengths_m[i] AS ln FROM sessions_v, range(1, 5) r(i)) o
  ON o.video_id = b.video_id AND o.segment = b.segment""",
    "baseline_v", "sessions_v",
)


def compared(spark, sf):
    s = C.sessions(spark, sf)
    rows = F.arrays_zip(F.col("intervals_s").alias("dt"), F.col("speeds_m_s").alias("sp"), F.slice("lengths_m", 1, 4).alias("ln"))
    segs = s.select("video_id", F.posexplode(rows).alias("i", "r")).select(
        "video_id", F.when(F.col("i") == 3, "final").otherwise(F.concat(F.lit("hop_"), (F.col("i") + 1).cast("string"))).alias("id"),
        F.col("r.dt").alias("dt_s"), F.col("r.sp").alias("speed_m_s"), F.col("r.ln").alias("length_m"),
    )
    return H.vs_general(segs, H.general_baseline(s, videos=s.select("video_id")))


@query(
    "a8_vs_general",
    sql("SELECT * EXCLUDE (closeness), round(closeness, 4) AS closeness FROM general_v", "general_v"),
)
def a8(spark, sf):
    return compared(spark, sf).drop("limited", "sessions_used").withColumn("closeness", rnd(F.col("closeness"), 4))


@query(
    "a8_vs_general_overall",
    sql("SELECT video_id, round(avg(closeness), 3) AS overall FROM general_v GROUP BY 1", "general_v"),
)
def a8_overall(spark, sf):
    return H.vs_general_overall(compared(spark, sf))


def history_templates(spark, sf):
    s = C.sessions(spark, sf)
    first = s.select("athlete_id", F.lit("phase").alias("kind"), F.lit("hop_1").alias("key"), F.col("pose_vectors")[0].alias("v"))
    tag = s.select("athlete_id", F.lit("tag").alias("kind"), F.lit("hop_contact").alias("key"), F.col("pose_vectors")[1].alias("v"))
    rows = first.filter(F.col("athlete_id").cast("long") % 3 > 0).unionByName(tag.filter(F.col("athlete_id").cast("long") % 3 < 2))
    return rows.filter("v is not null").groupBy("athlete_id", "kind", "key").agg(PR.vector_means("v").alias("centroid"))


_MEAN14 = "[" + ", ".join(f"round(avg(v[{i}]), 4)" for i in range(1, 15)) + "]"
_FOLD = "CASE WHEN {0} < 0 THEN ({0} + 1) / 2 ELSE {0} END"
view(
    "history_poses_v",
    """SELECT athlete_id, video_id, unnest(range(5)) AS i, unnest(pose_vectors) AS vec, unnest(['hop_1', 'hop_2', 'hop_3', 'hop_4', 'landing']) AS phase FROM sessions_v""",
    "sessions_v",
)
view(
    "templates_h_v",
    f"""SELECT athlete_id, 'phase' AS kind, {_MEAN14} AS centroid FROM (SELECT athlete_id, pose_vectors[1] AS v FROM sessions_v WHERE CAST(athlete_id AS BIGINT) % 3 > 0) WHERE v IS NOT NULL GROUP BY 1
UNION ALL SELECT athlete_id, 'tag', {_MEAN14} FROM (SELECT athlete_id, pose_vectors[2] AS v FROM sessions_v WHERE CAST(athlete_id AS BIGINT) % 3 < 2) WHERE v IS NOT NULL GROUP BY 1""",
    "sessions_v",
)
view(
    "pose_consistency_v",
    f"""SELECT athlete_id, video_id, contact_index, phase, own, past, list_avg([own, past]) AS score FROM (
  SELECT c.athlete_id, c.video_id, c.i AS contact_index, c.phase, {_FOLD.format("list_cosine_similarity(c.vec, coalesce(p.centroid, t.centroid))")} AS own,
    (SELECT avg({_FOLD.format("list_cosine_similarity(c.vec, h.vec)")}) FROM history_poses_v h WHERE h.athlete_id = c.athlete_id AND h.i = c.i AND h.video_id <> c.video_id AND h.vec IS NOT NULL) AS past
  FROM history_poses_v c LEFT JOIN templates_h_v p ON p.athlete_id = c.athlete_id AND p.kind = 'phase' AND c.phase = 'hop_1'
  LEFT JOIN templates_h_v t ON t.athlete_id = c.athlete_id AND t.kind = 'tag')""",
    "history_poses_v", "templates_h_v",
)
view(
    "timing_v",
    """SELECT athlete_id, video_id, interval_index, round(CASE WHEN abs(mean) > 1e-6 THEN abs(dt - mean) / mean END, 3) AS deviation,
  round(CASE WHEN dt IS NOT NULL AND mean IS NOT NULL THEN CASE WHEN sd > 1e-6 THEN (dt - mean) / sd ELSE 0 END END, 3) AS z FROM (
  SELECT c.athlete_id, c.video_id, c.i - 1 AS interval_index, any_value(c.dt) AS dt, avg(h.dt) AS mean, stddev_pop(h.dt) AS sd
  FROM (SELECT athlete_id, video_id, i, intervals_s[i] AS dt FROM sessions_v, range(1, 5) r(i)) c
  LEFT JOIN (SELECT athlete_id, video_id, i, intervals_s[i] AS dt FROM sessions_v, range(1, 5) r(i)) h ON h.athlete_id = c.athlete_id AND h.i = c.i AND h.video_id <> c.video_id
  GROUP BY 1, 2, 3)""",
    "sessions_v",
)


@query(
    "a7_pose_consistency",
    sql(
        "SELECT athlete_id, video_id, contact_index, phase, round(own, 3) AS vs_template, round(past, 3) AS vs_history, round(score, 5) AS score FROM pose_consistency_v",
        "pose_consistency_v",
    ),
)
def a7_pose(spark, sf):
    poses = H.contact_poses(C.sessions(spark, sf))
    return H.pose_consistency(poses, poses, history_templates(spark, sf)).withColumn("score", rnd(F.col("score"), 5))


@query("a7_timing_consistency", sql("SELECT * FROM timing_v", "timing_v"))
def a7_timing(spark, sf):
    s = C.sessions(spark, sf)
    return H.timing_consistency(s, s)


@query(
    "a7_consistency",
    sql(
        """SELECT athlete_id, video_id, round(p, 6) AS pose_score, round(t, 6) AS timing_score, round(list_avg([p, t]), 6) AS overall, n - 1 AS sessions_compared FROM (
  SELECT s.athlete_id, s.video_id, count(*) OVER (PARTITION BY s.athlete_id) AS n,
    (SELECT avg(score) FROM pose_consistency_v p WHERE p.video_id = s.video_id) AS p,
    (SELECT greatest(0, least(1, 1 - avg(deviation))) FROM timing_v t WHERE t.video_id = s.video_id) AS t FROM sessions_v s)""",
        "pose_consistency_v", "timing_v", "sessions_v",
    ),
)
def a7(spark, sf):
    s = C.sessions(spark, sf)
    return H.consistency(s, s, history_templates(spark, sf), digits=6)
