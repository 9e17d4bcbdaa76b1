"""Registered queries: documents and tables written to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as T
from ..session import shared_folder
from ..sources import readers as RD
from ..sources import writers as WR
from . import carriers as C
from .carriers import rnd, sql
from .registry import query

BLOCK = 1000  # orders in one document


def new_path(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def documents(df: DataFrame, name: str) -> str:
    """One JSON document per ``folder``; the glob that names them all."""
    path = new_path(df.sparkSession, name)
    df.repartition("folder").write.partitionBy("folder").json(path)
    return f"{path}/*/*.json"


def in_folder(df: DataFrame) -> DataFrame:
    """The video id without what the partitioned writer puts in front of it."""
    return df.withColumn("video_id", F.replace("video_id", F.lit("folder="), F.lit("")))


def order_blocks(spark, sf) -> DataFrame:
    o = C.table(spark, sf, "orders")
    return o.select(
        F.floor(F.col("o_orderkey") / BLOCK).cast("string").alias("folder"), (F.col("o_orderkey") % BLOCK).cast("int").alias("i"),
        F.col("o_totalprice").cast("double").alias("price"), F.col("o_orderstatus").alias("status"),
    )


@query(
    "s1_read_analysis",
    sql("SELECT video_id, frame_idx, round(timestamp_s, 6) AS timestamp_s, round(track_overlap, 4) AS track_overlap, person_detected, 'refined' AS pass, 848 AS width, 30.0::DOUBLE AS fps FROM frames_v", "frames_v"),
)
def s1(spark, sf):
    f = C.frames(spark, sf).select("video_id", F.struct("frame_idx", "timestamp_s", "person_detected", "person_bbox", "keypoints", "track_overlap").alias("f"))
    docs = f.groupBy(F.concat("video_id", F.lit(RD.REFINED)).alias("folder")).agg(F.collect_list("f").alias("frames"))
    docs = docs.withColumn("video_info", F.struct(F.lit(848).alias("width"), F.lit(478).alias("height")))
    frames, videos = RD.read_analysis(spark, documents(docs, "analysis"))
    rows = in_folder(frames).join(in_folder(videos).select("video_id", "pass", "width", "fps"), ["video_id", "pass"])
    return rows.select(
        "video_id", "frame_idx", rnd(F.col("timestamp_s")).alias("timestamp_s"), rnd(F.col("track_overlap"), 4).alias("track_overlap"), "person_detected", "pass", "width", "fps"
    )


@query(
    "s3_read_calibration",
    sql("SELECT video_id, frame_idx, 4 AS points, round(least(1, greatest(0, t0x)), 6) AS x, round(least(1, greatest(0, t0y)), 6) AS y, 'manual' AS mode FROM keyframes_v", "keyframes_v"),
)
def s3(spark, sf):
    raw = F.transform("track_polygon", lambda p: F.array(p["x"].cast("string"), p["y"].cast("string")))
    broken = F.concat(raw, F.array(F.array(F.lit("none"), F.lit("1")), F.array(F.lit("0.5"))))
    k = C.keyframes(spark, sf).select("video_id", F.struct("frame_idx", broken.alias("track_polygon")).alias("k"))
    docs = k.groupBy(F.col("video_id").alias("folder")).agg(F.collect_list("k").alias("keyframes")).withColumn("schema_version", F.lit(2))
    read = RD.read_calibration(spark, documents(docs, "calibration"))
    rows = in_folder(read["keyframes"]).join(in_folder(read["calibrations"]).select("video_id", "mode"), "video_id")
    p = F.col("track_polygon")
    return rows.select("video_id", "frame_idx", F.size(p).alias("points"), rnd(p[0]["x"]).alias("x"), rnd(p[0]["y"]).alias("y"), "mode")


@query(
    "s4_read_sections",
    f"""WITH b AS (SELECT CAST(o_orderkey // {BLOCK} AS VARCHAR) AS video_id, o_orderkey % {BLOCK} AS i FROM orders)
SELECT v.video_id, p.phase, CASE WHEN p.phase = 'hop_1' THEN v.low END AS start_frame, CASE WHEN p.phase = 'hop_1' THEN v.high END AS end_frame, v.n AS contacts, 0.0::DOUBLE AS confidence
FROM (SELECT video_id, CAST(min(i) AS INTEGER) AS low, CAST(max(i) AS INTEGER) AS high, count(*) AS n FROM b GROUP BY 1) v,
  (SELECT unnest(['approach', 'hop_1', 'hop_2', 'hop_3', 'hop_4', 'final_jump', 'landing']) AS phase) p""",
)
def s4(spark, sf):
    b = order_blocks(spark, sf)
    contact = F.struct(F.col("i").alias("index"), F.col("i").alias("frame_idx"), F.lit("hop").alias("type"))
    hop = F.struct(F.min("i").alias("start_frame"), F.max("i").alias("end_frame"))
    docs = b.groupBy("folder").agg(F.collect_list(contact).alias("contacts"), F.create_map(F.lit("hop_1"), hop).alias("phases"))
    read = {k: in_folder(v) for k, v in RD.read_sections(spark, documents(docs, "sections")).items()}
    n = read["contacts"].groupBy("video_id").agg(F.count_distinct("index").alias("contacts"))
    return read["phases"].join(n, "video_id").join(read["sections"].select("video_id", "confidence"), "video_id")


@query(
    "s5_read_gt",
    f"SELECT CAST(o_orderkey // {BLOCK} AS VARCHAR) AS video_id, CAST(o_orderkey % {BLOCK} AS INTEGER) AS frame_idx, o_orderstatus AS phase, round(o_totalprice, 4) AS quality_score FROM orders",
)
def s5(spark, sf):
    sample = F.struct(F.col("folder").alias("video_id"), F.col("i").alias("frame_idx"), F.col("status").alias("phase"), F.col("price").alias("quality_score"))
    docs = order_blocks(spark, sf).groupBy("folder").agg(F.collect_list(sample).alias("samples"))
    return RD.read_gt(spark, documents(docs, "gt")).select("video_id", "frame_idx", "phase", rnd(F.col("quality_score"), 4).alias("quality_score"))


@query(
    "s6_read_sessions",
    f"""SELECT CAST(o_orderkey // {BLOCK} AS VARCHAR) AS video_name, 'ath_1' AS athlete_id, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders
WHERE (o_orderkey // {BLOCK}) % 2 = 1 GROUP BY 1""",
)
def s6(spark, sf):
    b = order_blocks(spark, sf).groupBy("folder").agg(F.collect_list("price").alias("intervals_s"))
    docs = b.withColumns({"video_name": F.col("folder"), "athlete_id": F.concat(F.lit("ath_"), (F.col("folder").cast("int") % 2).cast("string"))})
    rows = RD.read_sessions(spark, documents(docs, "sessions"), athlete="ath_1")
    total = F.aggregate("intervals_s", F.lit(0.0), lambda a, x: a + x)
    return rows.select("video_name", "athlete_id", F.size("intervals_s").cast("long").alias("n"), rnd(total, 2).alias("total"))


@query(
    "s11_read_detections",
    sql("SELECT video_id, frame_idx, det_id, track_id, round(x1, 4) AS x1 FROM detections_v WHERE (x2 - x1) * (y2 - y1) >= 4000", "detections_v"),
)
def s11(spark, sf):
    path = new_path(spark, "detections")
    C.detections(spark, sf).select(*[F.col(f.name).cast(f.dataType) for f in T.DETECTIONS]).write.parquet(path)
    return RD.read_detections(spark, path).select("video_id", "frame_idx", "det_id", "track_id", rnd(F.col("x1"), 4).alias("x1"))


@query(
    "k1_write_analysis",
    sql(
        """SELECT video_id, CASE WHEN CAST(video_id AS INTEGER) % 2 = 0 THEN 2 ELSE 1 END AS analysis_version, 1 AS derived_version, count(*) AS frames,
  CAST(sum(CASE WHEN CAST(video_id AS INTEGER) % 2 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS marks FROM frames_v GROUP BY 1""",
        "frames_v",
    ),
)
def k1(spark, sf):
    """Two passes: the second replaces every other video and leaves the rest alone."""
    path = new_path(spark, "passes")
    f = C.frames(spark, sf).select("video_id", "frame_idx", "timestamp_s").withColumn("pass", F.lit("first"))
    for run in (1, 2):
        some = f if run == 1 else f.filter(F.col("video_id").cast("int") % 2 == 0)
        stored = None if run == 1 else spark.read.parquet(f"{path}/videos").withColumn("video_id", F.col("video_id").cast("string"))
        if stored is not None:
            stored = stored.checkpoint()  # read before the folder is written again
        WR.write_analysis(some.withColumn("mark", F.lit(run)), some.select("video_id", "pass").distinct(), path, stored)
    frames = spark.read.parquet(f"{path}/frames").groupBy(F.col("video_id").cast("string").alias("video_id")).agg(F.count(F.lit(1)).alias("frames"), F.sum("mark").alias("marks"))
    videos = spark.read.parquet(f"{path}/videos").select(F.col("video_id").cast("string").alias("video_id"), "analysis_version", "derived_version")
    return videos.join(frames, "video_id")


@query(
    "k8_corrections_log",
    "SELECT o_orderstatus AS correction_type, count(*) AS n, CAST(sum(o_orderkey % 7) AS BIGINT) AS frames_updated FROM orders GROUP BY 1",
)
def k8(spark, sf):
    path = new_path(spark, "corrections")
    o = C.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("correction_type"), (F.col("o_orderkey") % 7).cast("int").alias("frames_updated"))
    for half in (0, 1):
        WR.append_corrections_log(o.filter(F.col("k") % 2 == half).drop("k"), path)
    log = spark.read.parquet(path).filter("logged_at is not null")
    return log.groupBy("correction_type").agg(F.count(F.lit(1)).alias("n"), F.sum("frames_updated").alias("frames_updated"))
