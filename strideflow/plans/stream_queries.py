"""Registered queries: the streaming jobs (R1 - R5), each run to the end of its input.

The stream reads the table files; results go to parquet in the shared folder
with an exactly-once file sink, or a folder a batch for update results.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder
from ..streaming import jobs as JB
from . import carriers as C
from .candidate_queries import STATE_SQL
from .carriers import rnd, sql
from .registry import query


def stream_table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table as a stream of its files."""
    schema = C.table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def streamed(carrier, spark: SparkSession, sf: str) -> DataFrame:
    """A carrier view over the streamed table."""
    return carrier(spark, sf, read=stream_table)


def run_append(out: DataFrame, spark: SparkSession) -> DataFrame:
    """Run to the end of the input and read back the result table."""
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    job = (
        out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{base}/state")
        .trigger(availableNow=True).start(f"{base}/table")
    )
    job.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/table")


def run_update(out: DataFrame, spark: SparkSession, keys: list[str], order: str) -> DataFrame:
    """Run an update-mode job to the end of its input; the result has the newest row of each key.

    A batch writes only the keys that it changed, into a folder of its own, so a repeated batch replaces
    itself and no batch rewrites what others wrote.
    """
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/table/batch={batch_id}")

    job = (
        out.writeStream.outputMode("update").option("checkpointLocation", f"{base}/state")
        .foreachBatch(write).trigger(availableNow=True).start()
    )
    job.awaitTermination()
    rows = spark.read.parquet(f"{base}/table")
    newest = F.max_by(F.struct(*[c for c in out.columns if c not in keys]), F.struct(order, "batch"))
    return rows.groupBy(*keys).agg(newest.alias("_s")).select(*keys, "_s.*")


def _timed(df: DataFrame) -> DataFrame:
    """Event time: the start of the recording plus the frame's time."""
    start = F.lit("2024-01-01").cast("timestamp")
    return df.withColumn("event_time", F.timestamp_seconds(F.unix_timestamp(start) + F.col("frame_idx") / 30.0))


def shuffled_files(df: DataFrame, spark: SparkSession, batches: int = 4, files: int = 16) -> DataFrame:
    """``df`` as a stream in random order, ``files`` files a micro-batch, and then a row that ends the stream.

    Each file is written by one task.  The last row belongs to no video; its late time moves the watermark past all others.
    """
    folder = f"{shared_folder(spark)}/stream-input-{uuid.uuid4().hex}"
    df = _timed(df)
    dealt = df.repartition(batches * files, F.xxhash64(*[c for c in df.columns if c in ("video_id", "frame_idx", "det_id")]) % 1009)
    dealt.write.parquet(folder)
    last = {"event_time": F.lit("2024-02-01").cast("timestamp"), "x1": F.lit(0), "y1": F.lit(0), "x2": F.lit(1000), "y2": F.lit(1000)}
    ends = spark.range(1).select(*[last.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in df.schema])
    ends.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(folder)


@query("r1_streaming_athlete_state", sql(STATE_SQL, "frames_v"))
def r1(spark, sf):
    return run_append(JB.streaming_athlete_state(shuffled_files(C.frames(spark, sf), spark)), spark)


@query("r2_streaming_motion_lock", sql("SELECT video_id, athlete_track_id, round(motion_px, 4) AS motion_px FROM lock_v", "lock_v"))
def r2(spark, sf):
    rows = shuffled_files(C.detections(spark, sf), spark)
    return run_append(JB.streaming_motion_lock(rows), spark).withColumn("motion_px", rnd(F.col("motion_px"), 4))


@query(
    "r3_streaming_video_summary",
    sql(
        """SELECT video_id, strftime(to_timestamp(epoch(TIMESTAMP '2024-01-01') + 2 * floor(frame_idx / 60.0))::TIMESTAMP, '%H:%M:%S') AS window_start, count(*) AS n,
  count(*) FILTER (foot_y IS NOT NULL) AS seen, count(*) FILTER (foot_y IS NOT NULL AND value > 0.5) AS usable, round(max(value) FILTER (foot_y IS NOT NULL), 6) AS top
FROM signals_v GROUP BY 1, 2""",
        "signals_v",
    ),
)
def r3(spark, sf):
    f = shuffled_files(C.signals(spark, sf), spark).select(
        "video_id", "event_time", F.col("foot_y").isNotNull().alias("person_detected"), (F.col("value") > 0.5).alias("usable_for_analysis"),
        F.col("value").alias("quality_score"),
    )
    got = run_append(JB.streaming_video_summary(f, window="2 seconds"), spark).filter("video_id is not null")
    return got.select(
        "video_id", F.date_format("window.start", "HH:mm:ss").alias("window_start"), F.col("total_frames_analyzed").alias("n"),
        F.col("frames_with_person").alias("seen"), F.col("frames_usable").alias("usable"), rnd(F.col("quality_max")).alias("top"),
    )


@query(
    "r4_streaming_job_state",
    """SELECT CAST(user_id AS VARCHAR) AS job_id, arg_max(event_type, ts) AS stage, round(arg_max(value, ts), 4) AS percent FROM events GROUP BY 1""",
)
def r4(spark, sf):
    e = stream_table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("job_id"), F.col("ts").alias("event_time"), F.lit("running").alias("status"),
        F.col("event_type").alias("stage"), F.col("value").alias("percent"), F.lit(0).alias("current_frame"), F.lit(0).alias("total_frames"),
        F.lit("").alias("message"),
    )
    return run_update(JB.streaming_job_state(e), spark, ["job_id"], "event_time").select("job_id", "stage", rnd(F.col("percent"), 4).alias("percent"))


@query(
    "r5_streaming_color_model",
    sql("SELECT venue_id, layer, n AS sample_count, round(hm, 4) AS h_mean, round(vs, 4) AS v_std FROM color_v WHERE n >= 50", "color_v"),
)
def r5(spark, sf):
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    job = (
        streamed(C.pixels, spark, sf).writeStream.option("checkpointLocation", f"{base}/state")
        .foreachBatch(JB.upsert_color_model(f"{base}/sums")).trigger(availableNow=True).start()
    )
    job.awaitTermination()
    model = JB.read_color_model(spark, f"{base}/sums")
    return model.select("venue_id", "layer", "sample_count", rnd(F.col("mean")[0], 4).alias("h_mean"), rnd(F.col("std")[2], 4).alias("v_std"))

