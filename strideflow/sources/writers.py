"""Table maintenance: partition overwrite, versions, merges and label export."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.masks import polygon_keyframes

TRACK, SAND = 0, 1


def next_version(videos: DataFrame, stored: DataFrame | None) -> DataFrame:
    """analysis_version = stored + 1 and a fresh derived_version."""
    if stored is None:
        return videos.withColumns({"analysis_version": F.lit(1), "derived_version": F.lit(1)})
    old = stored.select("video_id", "pass", F.col("analysis_version").alias("_v"))
    return videos.drop("analysis_version", "derived_version").join(old, ["video_id", "pass"], "left").withColumns(
        {"analysis_version": F.coalesce("_v", F.lit(0)) + 1, "derived_version": F.lit(1)}
    ).drop("_v")


#: Folders of a stored table; a video's rows lie in the folder of its hash, as a folder a video would make millions of small files.
GROUPS = 256


def _stored_rows(spark: SparkSession, path: str) -> DataFrame | None:
    """What a table's folder holds; none before its first write."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _replace_videos(rows: DataFrame, written: DataFrame, path: str, spread: Column | None = None) -> None:
    """Write ``rows`` in the place of all rows of the ``written`` videos and passes; folders without such a video stay as they are."""
    group = F.pmod(F.xxhash64(F.col("video_id").cast("string")), F.lit(GROUPS)).cast("int")
    rows = rows.withColumns({"video_id": F.col("video_id").cast("string"), "_group": group})
    old = _stored_rows(rows.sparkSession, path)
    if old is not None:
        keys = written.select(F.col("video_id").cast("string").alias("video_id"), "pass").distinct()
        touched = keys.select(group.alias("_group")).distinct()
        gone = keys.select(F.col("video_id").alias("_video"), F.col("pass").alias("_pass"))
        kept = old.join(F.broadcast(touched), "_group", "left_semi")  # a row for each folder at most
        kept = kept.join(gone, F.col("video_id").eqNullSafe(F.col("_video")) & F.col("pass").eqNullSafe(F.col("_pass")), "left_anti")
        rows = rows.unionByName(kept, allowMissingColumns=True)
    placed = rows.repartition("_group") if spread is None else rows.repartition("_group", spread)
    placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_group").parquet(path)


def write_analysis(frames: DataFrame, videos: DataFrame, path: str, stored: DataFrame | None = None) -> None:
    """Write a pass; only the rows of the videos written are replaced.

    The tables lie in ``GROUPS`` folders by the hash of the video; a folder that holds none of the videos is left
    alone, the others are written again with what they keep.  Rows are placed by folder, video and a slice of the
    frames, so the files of one folder or one long video come from many tasks.
    """
    part = F.struct(F.pmod(F.xxhash64("video_id"), F.lit(4 * GROUPS)), F.floor(F.col("frame_idx") / 100_000))
    _replace_videos(frames, frames.select("video_id", "pass"), f"{path}/frames", part)
    _replace_videos(next_version(videos, stored), videos.select("video_id", "pass"), f"{path}/videos")


def replace_partitions(df: DataFrame, path: str, by: str | list[str]) -> None:
    keys = [by] if isinstance(by, str) else by
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def append_corrections_log(record: DataFrame, path: str) -> None:
    """Append audit rows; existing files are never rewritten."""
    record.withColumn("logged_at", F.current_timestamp()).write.mode("append").parquet(path)


# ------------------------------------------------------------ label export

def split_train_val(keyframes: DataFrame, val_ratio: float = 0.2, seed: int = 42) -> DataFrame:
    """Random split per video, the same on every run: val gets max(1, int(n * ratio)) frames, 0 if n is 1."""
    text = F.concat_ws(":", F.lit(seed), "video_id", "frame_idx")
    order = F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")
    n = keyframes.groupBy("video_id").agg(F.count(F.lit(1)).alias("_n"))
    # Ranked by hash inside hash buckets, with bucket totals carried over, so a
    # video with very many keyframes is not sorted in one task.
    buckets = 256
    rows = keyframes.withColumn("_h", order).withColumn("_b", F.floor(F.col("_h") / (2.0**60 / buckets)).cast("int"))
    sizes = rows.groupBy("video_id", "_b").agg(F.count(F.lit(1)).alias("_c"))
    ahead = Window.partitionBy("video_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_c").over(ahead), F.lit(0))).drop("_c")
    inside = Window.partitionBy("video_id", "_b").orderBy("_h", "frame_idx")
    ranked = rows.withColumn("_i", F.row_number().over(inside)).join(sizes, ["video_id", "_b"]).join(n, "video_id")
    val = F.when(F.col("_n") > 1, F.greatest(F.lit(1), F.floor(F.col("_n") * val_ratio))).otherwise(0)
    return ranked.withColumn(
        "split", F.when(F.col("_before") + F.col("_i") <= val, "val").otherwise("train")
    ).drop("_h", "_b", "_before", "_i", "_n")


def label_line(kind: int, points: Column) -> Column:
    """``class x y x y ...`` with six decimals."""
    coords = F.transform(points, lambda p: F.concat_ws(" ", F.format_string("%.6f", p.x), F.format_string("%.6f", p.y)))
    return F.concat_ws(" ", F.lit(str(kind)), F.array_join(coords, " "))


def label_rows(keyframes: DataFrame, val_ratio: float = 0.2, seed: int = 42) -> DataFrame:
    """Label lines of the usable keyframes: split, video_id, frame_idx, class, line."""
    split = split_train_val(polygon_keyframes(keyframes), val_ratio, seed)
    lines = F.filter(
        F.array(
            F.when(F.size("track_polygon") >= 3, F.struct(F.lit(TRACK).alias("class"), label_line(TRACK, F.col("track_polygon")).alias("line"))),
            F.when(F.size("landing_zone") >= 3, F.struct(F.lit(SAND).alias("class"), label_line(SAND, F.col("landing_zone")).alias("line"))),
        ),
        lambda x: x.isNotNull(),
    )
    return split.select("split", "video_id", "frame_idx", F.inline(lines))


def export_labels(keyframes: DataFrame, path: str, val_ratio: float = 0.2, seed: int = 42) -> None:
    """Export labels; only the partitions of the exported videos are replaced."""
    replace_partitions(label_rows(keyframes, val_ratio, seed), path, ["video_id", "split"])


def rebuild_rows(manifest: DataFrame, keyframes: DataFrame, val_ratio: float = 0.2, seed: int = 42) -> DataFrame:
    """Label lines of every manifest video that has usable keyframes."""
    return label_rows(keyframes.join(manifest.select("video_id").distinct(), "video_id", "left_semi"), val_ratio, seed)


def rebuild_labels(manifest: DataFrame, keyframes: DataFrame, path: str, val_ratio: float = 0.2, seed: int = 42) -> None:
    """Write the whole label set again."""
    rows = rebuild_rows(manifest, keyframes, val_ratio, seed)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("video_id", "split").parquet(path)
