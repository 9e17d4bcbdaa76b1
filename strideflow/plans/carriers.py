"""Views that let the video operators run on the provided tables.

Each view exists twice: as a DataFrame and as the equivalent SQL text.  Keys are
integer parts of the tables' own ids, so no view needs a shuffle (duplicates in
``lineitem`` are merged by an ordinary hash aggregate) and every video keeps a
bounded number of frames however large the table grows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.pose import bind
from ..schemas import KEYPOINTS

FRAMES_PER_VIDEO = 50
STRIDE = 3
N_DIMS = 14


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rnd(col: Column, digits: int = 6) -> Column:
    """Rounded output value (adding zero turns -0.0 into 0.0)."""
    return F.round(col, digits) + F.lit(0.0)


# ------------------------------------------------------------------ frames

def frames(spark: SparkSession, sf: str, read=None) -> DataFrame:
    src = (read or table)(spark, sf, "embeddings").select("vec_id", "embedding")

    def e(k: int) -> str:
        return f"cast(get(embedding, {k - 1}) as double)"

    kps = []
    for i, name in enumerate(KEYPOINTS):
        lift = " - 90D" if i in (1, 2) else ""
        kps.append(
            f"named_struct('name', '{name}', 'x', 640D + 300D * {e(3 * i + 1)}, "
            f"'y', 360D + 600D * {e(3 * i + 2)}{lift}, 'conf', least(1D, 0.3D + 5D * abs({e(3 * i + 3)})))"
        )
    idx = f"cast({STRIDE} * (vec_id % {FRAMES_PER_VIDEO}) as int)"
    base = bind(src, {"keypoints": F.expr(f"array({', '.join(kps)})")}).selectExpr(
        f"cast(floor(vec_id / {FRAMES_PER_VIDEO}) as string) as video_id",
        f"{idx} as frame_idx",
        f"{idx} / 30D as timestamp_s",
        f"{e(35)} > -0.2D as person_detected",
        "keypoints",
        f"{e(36)} > 0D as has_mask",
        f"cast(floor(abs({e(37)}) * 200000D) as int) as mask_area_px",
        f"round(least(1D, abs({e(38)}) * 5D), 4) as track_overlap",
        f"round(least(1D, abs({e(39)}) * 2D), 4) as landing_overlap",
        f"cast(floor(abs({e(40)}) * 50D) as int) as track_id",
        f"round(200D * {e(41)} + 3 * {idx}, 3) as position_s",
        f"least(1D, abs({e(42)}) * 6D) as appearance_sim",
        f"{e(43)} > 0.25D as manually_corrected",
        f"{e(50)} as dir_x",
        f"0.2D * {e(51)} as dir_y",
    )
    xs = ", ".join(f"keypoints[{i}].x" for i in range(11))
    ys = ", ".join(f"keypoints[{i}].y" for i in range(11))
    box = f"array(least({xs}), least({ys}), greatest({xs}), greatest({ys}))"
    return base.withColumn("person_bbox", F.expr(f"CASE WHEN person_detected THEN {box} END"))


def _e(k: int) -> str:
    return f"CAST(embedding[{k}] AS DOUBLE)"


def _frames_sql() -> str:
    cols = [
        f"CAST(vec_id // {FRAMES_PER_VIDEO} AS VARCHAR) AS video_id",
        f"CAST({STRIDE} * (vec_id % {FRAMES_PER_VIDEO}) AS INTEGER) AS frame_idx",
        f"({STRIDE} * (vec_id % {FRAMES_PER_VIDEO})) / 30.0::DOUBLE AS timestamp_s",
        f"{_e(35)} > -0.2 AS person_detected",
    ]
    for i, name in enumerate(KEYPOINTS):
        lift = " - 90" if i in (1, 2) else ""
        cols += [
            f"640 + 300 * {_e(3 * i + 1)} AS {name}_x",
            f"360 + 600 * {_e(3 * i + 2)}{lift} AS {name}_y",
            f"least(1.0::DOUBLE, 0.3::DOUBLE + 5 * abs({_e(3 * i + 3)})) AS {name}_c",
        ]
    cols += [
        f"{_e(36)} > 0 AS has_mask",
        f"CAST(floor(abs({_e(37)}) * 200000) AS INTEGER) AS mask_area_px",
        f"round(least(1.0::DOUBLE, abs({_e(38)}) * 5), 4) AS track_overlap",
        f"round(least(1.0::DOUBLE, abs({_e(39)}) * 2), 4) AS landing_overlap",
        f"CAST(floor(abs({_e(40)}) * 50) AS INTEGER) AS track_id",
        f"round(200 * {_e(41)} + 3 * ({STRIDE} * (vec_id % {FRAMES_PER_VIDEO})), 3) AS position_s",
        f"least(1.0::DOUBLE, abs({_e(42)}) * 6) AS appearance_sim",
        f"{_e(43)} > 0.25 AS manually_corrected",
        f"{_e(50)} AS dir_x",
        f"0.2::DOUBLE * {_e(51)} AS dir_y",
    ]
    xs = ", ".join(f"{n}_x" for n in KEYPOINTS)
    ys = ", ".join(f"{n}_y" for n in KEYPOINTS)
    return (
        f"SELECT *, CASE WHEN person_detected THEN least({xs}) END AS bx1, "
        f"CASE WHEN person_detected THEN least({ys}) END AS by1, "
        f"CASE WHEN person_detected THEN greatest({xs}) END AS bx2, "
        f"CASE WHEN person_detected THEN greatest({ys}) END AS by2 "
        f"FROM (SELECT {', '.join(cols)} FROM embeddings)"
    )


# ------------------------------------------------------------------ keyframes

_CORNERS = ("l_shoulder", "r_shoulder", "r_hip", "l_hip")
_SAND = ("l_knee", "r_knee", "r_ankle", "l_ankle")


def keyframes(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf).filter(F.col("frame_idx") % (10 * STRIDE) == 0)

    def poly(names):
        return F.array(
            *[
                F.struct(
                    (F.get("keypoints", F.lit(KEYPOINTS.index(n)))["x"] / 1280).alias("x"),
                    (F.get("keypoints", F.lit(KEYPOINTS.index(n)))["y"] / 720).alias("y"),
                )
                for n in names
            ]
        )

    nose = F.get("keypoints", F.lit(0))
    return f.select(
        "video_id",
        "frame_idx",
        poly(_CORNERS).alias("track_polygon"),
        poly(_SAND).alias("landing_zone"),
        F.struct(
            (nose["x"] / 1280).alias("ox"), (nose["y"] / 720).alias("oy"),
            F.col("dir_x").alias("dx"), F.col("dir_y").alias("dy"),
        ).alias("axis"),
        F.struct(
            (5 + F.col("track_id")).cast("double").alias("known_distance_m"),
            (nose["x"] / 1280).alias("ax"), (nose["y"] / 720).alias("ay"),
            F.lit(0.1).alias("bx"), F.lit(0.9).alias("by"),
        ).alias("scale"),
    )


def _keyframes_sql() -> str:
    cols = ["video_id", "frame_idx"]
    for tag, names in (("t", _CORNERS), ("s", _SAND)):
        for j, n in enumerate(names):
            cols += [f"{n}_x / 1280 AS {tag}{j}x", f"{n}_y / 720 AS {tag}{j}y"]
    cols += [
        "nose_x / 1280 AS ox", "nose_y / 720 AS oy", "dir_x AS dx", "dir_y AS dy",
        "CAST(5 + track_id AS DOUBLE) AS known_distance_m",
    ]
    return f"SELECT {', '.join(cols)} FROM frames_v WHERE frame_idx % {10 * STRIDE} = 0"


# ------------------------------------------------------------------ detections

def detections(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("p"), F.col("l_discount").alias("d"), F.col("l_tax").alias("t"),
        F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("k"), F.col("l_linenumber").alias("n"),
    )
    key = F.col("l_orderkey")
    # numbered by the frame, which stands for the key, so that rows lie where they meet their frame
    framed = li.withColumns({
        "video_id": F.floor(key / FRAMES_PER_VIDEO).cast("string"), "frame_idx": (STRIDE * (key % FRAMES_PER_VIDEO)).cast("int"),
    })
    merged = framed.withColumn("det", F.row_number().over(Window.partitionBy("video_id", "frame_idx").orderBy("n", "q", "p", "d", "t", "s", "k")))
    x1, y1 = (F.col("q") - 1) * 20, F.col("p") % 300
    return merged.select(
        "video_id",
        "frame_idx",
        F.col("det").cast("int").alias("det_id"),
        (F.col("s") % 5).cast("int").alias("track_id"),
        x1.alias("x1"), y1.alias("y1"),
        (x1 + 40 + 1000 * F.col("d")).alias("x2"), (y1 + 60 + 2000 * F.col("t")).alias("y2"),
        (0.3 + 7 * F.col("d")).alias("conf"),
        (F.floor("p") % 20000).cast("int").alias("mask_area_px"),
        ((F.col("k") * 37 % 1000) / 1000.0).alias("appearance_sim"),
        ((F.col("s") * 17 % 100) / 100.0).alias("track_ov"),
        ((F.col("k") * 13 % 100) / 100.0).alias("sand_ov"),
    )


_DETECTIONS_SQL = f"""
SELECT CAST(l_orderkey // {FRAMES_PER_VIDEO} AS VARCHAR) AS video_id,
  CAST({STRIDE} * (l_orderkey % {FRAMES_PER_VIDEO}) AS INTEGER) AS frame_idx,
  CAST(det AS INTEGER) AS det_id, CAST(s % 5 AS INTEGER) AS track_id,
  (q - 1) * 20 AS x1, p % 300 AS y1, (q - 1) * 20 + 40 + 1000 * d AS x2,
  p % 300 + 60 + 2000 * t AS y2, 0.3::DOUBLE + 7 * d AS conf,
  CAST(CAST(floor(p) AS BIGINT) % 20000 AS INTEGER) AS mask_area_px,
  (k * 37 % 1000) / 1000.0::DOUBLE AS appearance_sim,
  (s * 17 % 100) / 100.0::DOUBLE AS track_ov, (k * 13 % 100) / 100.0::DOUBLE AS sand_ov
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY n, q, p, d, t, s, k) AS det FROM (
  SELECT l_orderkey, l_linenumber n, l_quantity q, l_extendedprice p, l_discount d, l_tax t, l_suppkey s, l_partkey k FROM lineitem))
"""

# ------------------------------------------------------------------ signals

EVENTS_PER_VIDEO = 100
SURFACES = {"view": "track", "click": "track", "purchase": "sand"}


def signals(spark: SparkSession, sf: str, read=None) -> DataFrame:
    """One foot signal per frame: ``events`` in blocks of a hundred ids."""
    ev = (read or table)(spark, sf, "events")
    surface = F.lit("unknown")
    for kind, name in SURFACES.items():
        surface = F.when(F.col("event_type") == kind, F.lit(name)).otherwise(surface)
    return ev.select(
        F.floor(F.col("event_id") / EVENTS_PER_VIDEO).cast("string").alias("video_id"),
        (F.col("event_id") % EVENTS_PER_VIDEO).cast("int").alias("frame_idx"),
        ((F.col("event_id") % EVENTS_PER_VIDEO) / 30.0).alias("timestamp_s"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("foot_y"),
        F.col("value"),
        surface.alias("surface"),
        "user_id",
        "ts",
    )


_SIGNALS_SQL = f"""
SELECT CAST(event_id // {EVENTS_PER_VIDEO} AS VARCHAR) AS video_id,
  CAST(event_id % {EVENTS_PER_VIDEO} AS INTEGER) AS frame_idx,
  (event_id % {EVENTS_PER_VIDEO}) / 30.0::DOUBLE AS timestamp_s,
  CASE WHEN event_type <> 'error' THEN value END AS foot_y, value,
  CASE WHEN event_type IN ('view', 'click') THEN 'track'
       WHEN event_type = 'purchase' THEN 'sand' ELSE 'unknown' END AS surface, user_id, ts
FROM events
"""

# ------------------------------------------------------------------ sessions

SLOTS = 5


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    """One session snapshot per order; the customer is the athlete."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    k, c = F.col("o_orderkey"), F.col("o_custkey")

    def interval(i):
        v = F.sqrt(((k * (7 + i) + c * 3) % 100).cast("double")) / 9.7 - 0.2
        return F.when((k + i) % 11 != 0, v)

    def length(i):
        return F.when((k + 2 * i) % 13 != 0, ((k * (3 + i)) % 90) / 19.7)

    def vector(i):
        return F.when(
            (k + i) % 7 != 0,
            F.array(*[((k * (i + 3) * (d + 5)) % 101) / 103.7 - 0.0193 for d in range(N_DIMS)]),
        )

    return o.select(
        c.cast("string").alias("athlete_id"),
        k.cast("string").alias("video_id"),
        F.array(*[interval(i) for i in range(4)]).alias("intervals_s"),
        F.array(*[length(i) for i in range(SLOTS)]).alias("lengths_m"),
        F.array(*[length(i) * 2 for i in range(4)]).alias("speeds_m_s"),
        F.array(*[vector(i) for i in range(SLOTS)]).alias("pose_vectors"),
        F.array(*[F.lit(p) for p in ("hop_1", "hop_2", "hop_3", "hop_4", "landing")]).alias(
            "contact_phases"
        ),
    )


def _sessions_sql() -> str:
    iv = ", ".join(
        f"CASE WHEN (o_orderkey + {i}) % 11 <> 0 THEN "
        f"sqrt(CAST((o_orderkey * {7 + i} + o_custkey * 3) % 100 AS DOUBLE)) / 9.7::DOUBLE - 0.2::DOUBLE END"
        for i in range(4)
    )
    ln = [
        f"CASE WHEN (o_orderkey + {2 * i}) % 13 <> 0 THEN "
        f"((o_orderkey * {3 + i}) % 90) / 19.7::DOUBLE END"
        for i in range(SLOTS)
    ]
    vec = ", ".join(
        f"CASE WHEN (o_orderkey + {i}) % 7 <> 0 THEN list_transform(range({N_DIMS}), "
        f"lambda d: ((o_orderkey * {i + 3} * (d + 5)) % 101) / 103.7::DOUBLE - 0.0193::DOUBLE) END"
        for i in range(SLOTS)
    )
    return (
        "SELECT CAST(o_custkey AS VARCHAR) AS athlete_id, CAST(o_orderkey AS VARCHAR) AS video_id, "
        f"[{iv}] AS intervals_s, [{', '.join(ln)}] AS lengths_m, "
        f"[{', '.join(f'2 * ({x})' for x in ln[:4])}] AS speeds_m_s, [{vec}] AS pose_vectors FROM orders"
    )


# ------------------------------------------------------------------ vectors

def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """The first 14 embedding values as a pose vector; the label as its tag."""
    return table(spark, sf, "embeddings").select(
        "vec_id",
        F.concat(F.lit("tag_"), F.col("label").cast("string")).alias("tag"),
        F.transform(F.slice("embedding", 1, N_DIMS), lambda v: v.cast("double")).alias("vector"),
    )


_VECTORS_SQL = f"""
SELECT vec_id, 'tag_' || CAST(label AS VARCHAR) AS tag,
  list_transform(embedding[1:{N_DIMS}], lambda v: CAST(v AS DOUBLE)) AS vector FROM embeddings
"""

# ------------------------------------------------------------------ pixels

LAYERS = {"A": "track", "N": "sand", "R": "grass"}


def pixels(spark: SparkSession, sf: str, read=None) -> DataFrame:
    li = (read or table)(spark, sf, "lineitem")
    layer = F.lit("grass")
    for flag, name in LAYERS.items():
        layer = F.when(F.col("l_returnflag") == flag, F.lit(name)).otherwise(layer)
    return li.select(
        (F.col("l_suppkey") % 3).cast("string").alias("venue_id"),
        F.floor(F.col("l_orderkey") / FRAMES_PER_VIDEO).cast("string").alias("video_id"),
        (STRIDE * (F.col("l_orderkey") % FRAMES_PER_VIDEO)).cast("int").alias("frame_idx"),
        layer.alias("layer"),
        (F.col("l_quantity") * 3.5).alias("h"),
        F.floor(F.col("l_extendedprice") % 256).cast("double").alias("s"),
        F.floor(F.col("l_discount") * 2500).cast("double").alias("v"),
    )


_PIXELS_SQL = f"""
SELECT CAST(l_suppkey % 3 AS VARCHAR) AS venue_id,
  CAST(l_orderkey // {FRAMES_PER_VIDEO} AS VARCHAR) AS video_id,
  CAST({STRIDE} * (l_orderkey % {FRAMES_PER_VIDEO}) AS INTEGER) AS frame_idx,
  CASE l_returnflag WHEN 'A' THEN 'track' WHEN 'N' THEN 'sand' ELSE 'grass' END AS layer,
  l_quantity * 3.5::DOUBLE AS h, floor(l_extendedprice % 256) AS s, floor(l_discount * 2500) AS v
FROM lineitem
"""

# ------------------------------------------------------------------ SQL text

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "frames_v": ((), _frames_sql()),
    "keyframes_v": (("frames_v",), _keyframes_sql()),
    "detections_v": ((), _DETECTIONS_SQL),
    "signals_v": ((), _SIGNALS_SQL),
    "sessions_v": ((), _sessions_sql()),
    "vectors_v": ((), _VECTORS_SQL),
    "pixels_v": ((), _PIXELS_SQL),
}


def view(name: str, body: str, *needs: str) -> str:
    """Register an intermediate SQL view used by several oracle queries."""
    VIEWS[name] = (needs, body)
    return name


def sql(body: str, *needs: str) -> str:
    """``body`` preceded by the views it needs, in dependency order."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for n in VIEWS[name][0]:
            visit(n)
        if name not in ordered:
            ordered.append(name)

    for n in needs:
        visit(n)
    if not ordered:
        return body.strip()
    parts = ", ".join(f"{n} AS ({VIEWS[n][1].strip()})" for n in ordered)
    lead = body.strip()
    if lead.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {parts}, {lead[15:]}"
    if lead.upper().startswith("WITH "):
        return f"WITH {parts}, {lead[5:]}"
    return f"WITH {parts} {lead}"
