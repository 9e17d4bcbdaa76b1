"""Track and sand masks on a 160 x 90 grid, as runs of cells: one row for each run of a grid row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.pose import bind
from ..schemas import MASK_MODES
from .joins import GRID_H, GRID_W, bracket_interpolate, nearest_mark

MIN_KEYFRAMES = 5
SPAN_KEY = ["video_id", "frame_idx", "layer", "gy"]


# ------------------------------------------------------------ keyframe choice

def keyframe_source(kf: str = "track_polygon") -> Column:
    """Stored source, else guessed from the geometry (auto quads fill the image)."""
    poly = F.col(kf)
    n = F.coalesce(F.size(poly), F.lit(0))
    guess = (
        F.when(F.col("venue_confidence").isNotNull(), "venue_auto")
        .when(n > 4, "manual")
        .when((n >= 3) & (G.polygon_area(poly) > 0.5), "venue_auto")
        .otherwise("manual")
    )
    return F.when(F.col("source").isin("manual", "venue_auto"), F.col("source")).otherwise(guess)


def learnable(kf: str = "track_polygon") -> Column:
    return (F.coalesce(F.size(kf), F.lit(0)) >= 3) & (G.polygon_area(F.col(kf)) <= 0.5)


def polygon_keyframes(keyframes: DataFrame) -> DataFrame:
    """Keyframes with a polygon: the manual ones if a video has any, else all."""
    usable = keyframes.filter(F.coalesce(F.size("track_polygon"), F.lit(0)) >= 3).withColumn(
        "_manual", keyframe_source() != "venue_auto"
    )
    any_manual = usable.groupBy("video_id").agg(F.max("_manual").alias("_any"))
    return (
        usable.join(any_manual, "video_id")
        .filter(F.col("_manual") | ~F.col("_any"))
        .drop("_manual", "_any")
    )


# ------------------------------------------------------------ rasterising

def polygon_spans(poly: Column, edges: Column) -> Column:
    """ARRAY<STRUCT<gy, gx0, gx1>>: the runs [gx0, gx1) of grid cells of each row whose centre lies in a 0-1 polygon.

    ``edges`` are the polygon's edges, bound beforehand.  The line through a row's centres enters and leaves the
    polygon at the edges it crosses, so a row costs its crossings and not its cells.
    """
    def first_cell(x: Column) -> Column:
        """The first cell whose centre is not left of ``x``; set right where rounding misses it by one."""
        g = F.ceil(F.greatest(F.lit(-1.0), F.least(F.lit(GRID_W + 1.0), x)) * GRID_W - 0.5)
        near = F.when((g - 0.5) / GRID_W >= x, g - 1).when((g + 0.5) / GRID_W < x, g + 1).otherwise(g)
        return F.greatest(F.lit(0), F.least(F.lit(GRID_W), near)).cast("int")

    def row(gy: Column) -> Column:
        y = (gy + 0.5) / GRID_H
        crossed = F.filter(edges, lambda e: (e.py > y) != (e.qy > y))
        cuts = F.array_sort(F.transform(crossed, lambda e: first_cell((e.qx - e.px) * (y - e.py) / (e.qy - e.py) + e.px)))
        pairs = F.zip_with(cuts, F.slice(cuts, 2, GRID_W), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        inside = F.filter(pairs, lambda p, i: (i % 2 == 0) & (p.b > p.a))
        return F.transform(inside, lambda p: F.struct(gy.alias("gy"), p.a.alias("gx0"), p.b.alias("gx1")))

    def level(pick) -> Column:
        edge = F.floor(pick(F.transform(poly, lambda p: p.y)) * GRID_H)
        return F.greatest(F.lit(0), F.least(F.lit(GRID_H - 1), edge)).cast("int")

    low, high = level(F.array_min), level(F.array_max)
    return F.when(F.size(poly) >= 3, F.flatten(F.transform(F.sequence(low, F.greatest(low, high)), row)))


def spans_of(cells: DataFrame) -> DataFrame:
    """Cells (video_id, frame_idx, layer, gx, gy) as spans: video_id, frame_idx, layer, gy, gx0, gx1."""
    single = cells.select(*SPAN_KEY, F.col("gx").alias("gx0"), (F.col("gx") + 1).alias("gx1"))
    return _swept(single, None)


def cells_of(spans: DataFrame) -> DataFrame:
    """The single cells of spans."""
    return spans.select(*SPAN_KEY[:3], F.explode(F.sequence(F.col("gx0"), F.col("gx1") - 1)).alias("gx"), "gy")


def _swept(covers: DataFrame, holes: DataFrame | None) -> DataFrame:
    """What ``covers`` covers and ``holes`` do not, as spans that neither touch nor overlap.

    A sweep along each grid row: borders count up and down, and a span runs from where cover begins to where it ends.
    """
    def borders(spans: DataFrame, cover: int, hole: int) -> DataFrame:
        ends = F.array(*[F.struct(F.col(x).alias("x"), F.lit(s * cover).alias("c"), F.lit(s * hole).alias("h")) for x, s in (("gx0", 1), ("gx1", -1))])
        return spans.select(*SPAN_KEY, F.inline(ends))

    marks = borders(covers, 1, 0)
    if holes is not None:
        marks = marks.unionByName(borders(holes, 0, 1))
    marks = marks.groupBy(*SPAN_KEY, "x").agg(F.sum("c").alias("c"), F.sum("h").alias("h"))
    along = Window.partitionBy(*SPAN_KEY).orderBy("x")
    level = marks.withColumns({"c": F.sum("c").over(along), "h": F.sum("h").over(along)}).withColumn("on", (F.col("c") > 0) & (F.col("h") == 0))
    turns = level.withColumn("was", F.lag("on", 1, False).over(along)).filter(F.col("on") != F.col("was"))
    spans = turns.withColumn("gx1", F.lead("x").over(along)).filter("on")
    return spans.select(*SPAN_KEY, F.col("x").cast("int").alias("gx0"), F.col("gx1").cast("int").alias("gx1"))


def rasterise_polygons(
    frames: DataFrame, keyframes: DataFrame, min_keyframes: int = MIN_KEYFRAMES
) -> tuple[DataFrame, DataFrame]:
    """(mask_frames, mask_spans) of all frames of videos with enough keyframes, see :func:`draw_masks`."""
    return mask_tables(draw_masks(frames, keyframes, min_keyframes))


def draw_masks(frames: DataFrame, keyframes: DataFrame, min_keyframes: int = MIN_KEYFRAMES) -> DataFrame:
    """One row a frame of the videos with enough keyframes: source, confidence and the spans of both layers.

    An exact keyframe gives confidence 1.0, a blend of two 0.88.  A few bytes of polygon become up to 180 rows of
    the grid, so frames are spread by number over all partitions and not merged by their small size.
    """
    usable = polygon_keyframes(keyframes)
    enough = usable.groupBy("video_id").agg(F.count(F.lit(1)).alias("_k")).filter(F.col("_k") >= min_keyframes)
    usable = usable.join(enough.select("video_id"), "video_id", "left_semi")
    wanted = frames.select("video_id", "frame_idx").join(enough.select("video_id"), "video_id", "left_semi")
    shaped = bracket_interpolate(wanted, usable)
    exact = F.coalesce(F.col("kf_idx") == F.col("frame_idx"), F.lit(False))
    width = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shaped = bind(
        shaped.select("video_id", "frame_idx", "kf_idx", "track_polygon", "landing_zone").repartition(width, "video_id", "frame_idx"),
        {f"_{c}": G.polygon_edges(F.col(c)) for c in ("track_polygon", "landing_zone")},
    )
    none = F.array().cast("array<struct<gy:int,gx0:int,gx1:int>>")
    return bind(
        shaped,
        {
            "track": F.coalesce(polygon_spans(F.col("track_polygon"), F.col("_track_polygon")), none),
            "sand": F.coalesce(polygon_spans(F.col("landing_zone"), F.col("_landing_zone")), none),
        },
    ).select(
        "video_id",
        "frame_idx",
        F.when(exact, "keyframe").otherwise("interpolated").alias("source"),
        F.when(exact, 1.0).otherwise(0.88).alias("confidence"),
        "track",
        "sand",
    )


def mask_tables(drawn: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mask_frames, mask_spans) of drawn masks; what uses both stores the drawn ones first."""
    total = float(GRID_W * GRID_H)
    mask_frames = drawn.select(
        "video_id", "frame_idx", "source", "confidence",
        F.round(_covered("track") / total, 4).alias("track_area_norm"),
        F.round(_covered("sand") / total, 4).alias("sand_area_norm"),
    )
    layers = F.array(
        F.struct(F.lit("track").alias("layer"), F.col("track").alias("spans")),
        F.struct(F.lit("sand").alias("layer"), F.col("sand").alias("spans")),
    )
    spans = (
        drawn.select("video_id", "frame_idx", F.inline(layers))
        .select("video_id", "frame_idx", "layer", F.inline("spans"))
    )
    return mask_frames, spans


def _covered(spans: str) -> Column:
    """Number of cells in an array of spans."""
    return F.aggregate(spans, F.lit(0), lambda n, s: n + s.gx1 - s.gx0)


def mask_areas(spans: DataFrame) -> DataFrame:
    covered = F.col("gx1") - F.col("gx0")
    return spans.groupBy("video_id", "frame_idx").agg(
        *[
            F.round(F.coalesce(F.sum(F.when(F.col("layer") == n, covered)), F.lit(0)) / float(GRID_W * GRID_H), 4).alias(f"{n}_area_norm")
            for n in ("track", "sand")
        ]
    )


# ------------------------------------------------------------ edits

def mask_edit(spans: DataFrame, delta: DataFrame, op: str = "add") -> DataFrame:
    """Add, erase or replace spans of the layers and frames named by ``delta`` (spans that may overlap)."""
    columns = [*SPAN_KEY, "gx0", "gx1"]
    delta, spans = delta.select(*columns), spans.select(*columns)
    if op == "add":
        return _swept(spans.unionByName(delta), None)
    if op == "erase":
        return _swept(spans, delta)
    if op == "replace":
        touched = delta.select(*SPAN_KEY[:3]).distinct()
        return spans.join(touched, SPAN_KEY[:3], "left_anti").unionByName(_swept(delta, None))
    raise ValueError(f"unknown mask operation {op!r}: use add, erase or replace")


def edited_frames(edits: DataFrame, frames: DataFrame) -> DataFrame:
    """Analysed frames a mask edit reaches: within radius, in its direction."""
    e = edits.select(
        "video_id", F.col("frame_idx").alias("edit_idx"), "radius",
        F.coalesce("direction", F.lit("both")).alias("direction"),
    )
    low = F.when(F.col("direction") == "forward", F.col("edit_idx")).otherwise(
        F.greatest(F.lit(0), F.col("edit_idx") - F.col("radius"))
    )
    high = F.when(F.col("direction") == "backward", F.col("edit_idx")).otherwise(
        F.col("edit_idx") + F.col("radius")
    )
    # The radius is small, so the reach is written out and matched on the frame key.
    reach = e.select(
        "video_id", "edit_idx", F.explode(F.sequence(low, high)).alias("frame_idx")
    )
    present = reach.join(frames.select("video_id", "frame_idx"), ["video_id", "frame_idx"], "left_semi")
    source = e.select("video_id", "edit_idx", F.col("edit_idx").alias("frame_idx"))
    return present.unionByName(source, allowMissingColumns=True).distinct()


def fill_masks(wanted: DataFrame, mask_frames: DataFrame) -> DataFrame:
    """Every wanted frame with the mask it uses: its own or the nearest good one.

    A copied mask keeps 0.85 of the confidence; a frame that could not be read
    at all (no row in ``mask_frames``) is copied at 0.80, then counts as copied.
    """
    good = mask_frames.filter(F.col("track_area_norm") > 0)
    placed = nearest_mark(wanted.select("video_id", "frame_idx"), good, out="mask_idx")
    conf = good.select("video_id", F.col("frame_idx").alias("mask_idx"), F.col("confidence").alias("_c"))
    read = mask_frames.select("video_id", "frame_idx", F.lit(True).alias("_read"))
    joined = placed.join(conf, ["video_id", "mask_idx"], "left").join(read, ["video_id", "frame_idx"], "left")
    share = (
        F.when(F.col("mask_idx") == F.col("frame_idx"), 1.0)
        .when(F.col("_read"), 0.85)
        .otherwise(0.80)
    )
    return joined.filter(F.col("mask_idx").isNotNull()).select(
        "video_id", "frame_idx", "mask_idx", (F.col("_c") * share).alias("confidence"),
        (F.col("mask_idx") != F.col("frame_idx")).alias("copied"),
    )


# ------------------------------------------------------------ decisions and counts

def has_masks(mode: Column, n_mask_frames: Column) -> Column:
    return F.coalesce(mode.isin(*MASK_MODES), F.lit(False)) & (F.coalesce(n_mask_frames, F.lit(0)) > 0)


def mask_source(videos: DataFrame) -> DataFrame:
    """How the masks of a video are made.

    ``videos``: has_model, polygon_keyframes, profile_version (null: no profile).
    """
    has_model = F.coalesce("has_model", F.lit(False))
    enough = F.coalesce("polygon_keyframes", F.lit(0)) >= MIN_KEYFRAMES
    version = F.col("profile_version")
    return videos.withColumn(
        "mask_source",
        F.when(has_model, "cnn_masks")
        .when(enough, "keyframe_masks")
        .when(version >= 3, "color_masks")
        .when(version.isNotNull(), "venue_profile")
        .otherwise("error"),
    )


def mask_summary(mask_frames: DataFrame) -> DataFrame:
    """Frames with a mask, mean of the positive confidences, count by source."""
    conf = F.col("confidence")
    return mask_frames.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("frames_applied"),
        F.round(F.coalesce(F.avg(F.when(conf > 0, conf)), F.lit(0.0)), 3).alias("mean_confidence"),
        *[
            F.count(F.when(F.col("source") == s, 1)).alias(f"n_{s}")
            for s in ("keyframe", "interpolated", "cnn", "color")
        ],
    )


def keyframe_coverage(frames: DataFrame, keyframes: DataFrame) -> DataFrame:
    """Whether the keyframes miss too many analysed frames of a video.

    Incomplete: none at all, under half covered, or more than a tenth missing.
    """
    drawn = keyframes.filter(F.coalesce(F.size("track_polygon"), F.lit(0)) > 0)
    covered = drawn.groupBy("video_id").agg(F.count_distinct("frame_idx").alias("_covered"))
    hit = drawn.select("video_id", "frame_idx", F.lit(1).alias("_hit")).distinct()
    counted = (
        frames.select("video_id", "frame_idx").distinct()
        .join(hit, ["video_id", "frame_idx"], "left")
        .groupBy("video_id")
        .agg(F.count(F.lit(1)).alias("targets"), F.count(F.when(F.col("_hit").isNull(), 1)).alias("missing"))
    )
    n, missing = F.col("targets"), F.col("missing")
    cov = F.coalesce("_covered", F.lit(0))
    return counted.join(covered, "video_id", "left").select(
        "video_id", "targets", "missing",
        ((cov < n * 0.5) | (missing > F.greatest(F.lit(1), F.floor(n / 10)))).alias("incomplete"),
    )


def merge_keyframes(existing: DataFrame, detected: DataFrame) -> DataFrame:
    """Per frame a manual keyframe wins, then the newly detected, then the old one."""
    tagged = existing.withColumn(
        "_rank", F.when(keyframe_source() == "manual", 0).otherwise(2)
    ).unionByName(detected.withColumn("_rank", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in tagged.columns if c not in ("video_id", "frame_idx", "_rank")]
    best = tagged.groupBy("video_id", "frame_idx").agg(F.min_by(F.struct(*rest), "_rank").alias("b"))
    return best.select("video_id", "frame_idx", "b.*")


def auto_keyframes(frames: DataFrame, existing: DataFrame, propagated: DataFrame, detected: DataFrame) -> DataFrame:
    """Keyframes for every frame that can be covered; manual ones stay as they are.

    Propagated geometry comes first; frames without it take the colour detection.
    """
    drawn = propagated.filter(F.coalesce(F.size("track_polygon"), F.lit(0)) > 0)
    missing = frames.select("video_id", "frame_idx").join(
        drawn.select("video_id", "frame_idx"), ["video_id", "frame_idx"], "left_anti"
    )
    filled = detected.filter(F.coalesce(F.size("track_polygon"), F.lit(0)) >= 4).join(
        missing, ["video_id", "frame_idx"], "left_semi"
    )
    fresh = drawn.unionByName(filled, allowMissingColumns=True)
    stamped = fresh.withColumn("source", F.lit("venue_auto"))
    return merge_keyframes(existing, stamped)
