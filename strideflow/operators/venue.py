"""Venue colour models, colour histograms and mask regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S

MIN_TRACK_PX, MIN_SAND_PX = 50, 30
ZONE_WEIGHTS = {0: 0.10, 1: 0.60, 2: 0.30}
CHANNELS = ("h", "s", "v")
SHAPE = ("area", "aspect", "cx", "cy", "lane_angle")
#: Accuracy of the sketch, and how far from the middle its bracket reaches: more than its error.
ACCURACY, BRACKET = 10_000, 3e-4


# ------------------------------------------------------------ colour statistics

def color_moments(pixels: DataFrame, keys=("venue_id", "layer")) -> DataFrame:
    """Count, sums and squared sums per channel: partial sums merge by addition."""
    return pixels.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(c).alias(f"{c}1") for c in CHANNELS],
        *[F.sum(F.col(c) * F.col(c)).alias(f"{c}2") for c in CHANNELS],
    )


def merge_moments(parts: DataFrame, keys=("venue_id", "layer")) -> DataFrame:
    return parts.groupBy(*keys).agg(
        F.sum("n").alias("n"), *[F.sum(f"{c}{k}").alias(f"{c}{k}") for k in (1, 2) for c in CHANNELS]
    )


def stats_from_moments(moments: DataFrame, min_n: int = MIN_TRACK_PX) -> DataFrame:
    """mean, std (population) and sample_count; nothing below ``min_n`` samples."""
    n = F.col("n")
    mean = [F.col(f"{c}1") / n for c in CHANNELS]
    std = [F.sqrt(F.greatest(F.lit(0.0), F.col(f"{c}2") / n - m * m)) for c, m in zip(CHANNELS, mean)]
    return moments.filter(n >= min_n).withColumns(
        {"mean": F.array(*mean), "std": F.array(*std), "sample_count": n}
    ).drop("n", *[f"{c}{k}" for k in (1, 2) for c in CHANNELS])


def moments_from_stats(stats: DataFrame) -> DataFrame:
    """Stored mean / std / count back to sums, so that old and new data can be merged."""
    n = F.col("sample_count")
    out = {"n": n}
    for i, c in enumerate(CHANNELS):
        m, s = F.col("mean")[i], F.col("std")[i]
        out[f"{c}1"], out[f"{c}2"] = m * n, (s * s + m * m) * n
    return stats.withColumns(out).drop("mean", "std", "sample_count")


def merge_color_stats(old: DataFrame, new_pixels: DataFrame, keys=("venue_id", "layer")) -> DataFrame:
    """Stored statistics extended by new pixels (ignored when fewer than 50)."""
    fresh = color_moments(new_pixels, keys).filter(F.col("n") >= MIN_TRACK_PX)
    both = moments_from_stats(old.select(*keys, "mean", "std", "sample_count")).unionByName(fresh)
    return stats_from_moments(merge_moments(both, keys), 1)


def medians(rows: DataFrame, keys: list[str], columns: tuple[str, ...]) -> DataFrame:
    """Exact median of each column per key, nulls left out; a key may hold any share of the rows.

    A mergeable sketch brackets the middle of each key to within a few ten-thousandths of its rows.  Rows below
    the bracket are only counted; values inside it are counted one by one, and the middle ranks picked from them.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("_name"), F.col(c).cast("double").alias("_x")) for c in columns])
    long = rows.select(*keys, F.inline(pairs)).filter(F.col("_x").isNotNull())
    group = [*keys, "_name"]
    brackets = long.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_x", [0.5 - BRACKET, 0.5 + BRACKET], ACCURACY).alias("_b"))
    placed = long.join(brackets.select(*group, F.col("_b")[0].alias("_low"), F.col("_b")[1].alias("_high")), group)
    # all rows below the bracket share one value of their own
    value = F.when(F.col("_x") >= F.col("_low"), F.col("_x"))
    counts = placed.filter(F.col("_x") <= F.col("_high")).groupBy(*group, value.alias("_x")).agg(F.count(F.lit(1)).alias("_c"))
    upto = Window.partitionBy(*group).orderBy(F.col("_x").asc_nulls_first())
    ranked = counts.withColumn("_last", F.sum("_c").over(upto)).join(brackets.select(*group, "_n"), group)
    low, high = F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1

    def at(rank):
        return F.max(F.when((F.col("_last") >= rank) & (F.col("_last") - F.col("_c") < rank), F.col("_x")))

    middle = ranked.groupBy(*group).agg(((at(low) + at(high)) / 2).alias("_median"))
    return middle.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == c, F.col("_median"))).alias(c) for c in columns])


def _frame_moments(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Colour sums of the frames that count: at least 50 track or 30 sand pixels."""
    use = pixels.filter(F.col("layer").isin("track", "sand"))
    floor = F.when(F.col("layer") == "track", MIN_TRACK_PX).otherwise(MIN_SAND_PX)
    return color_moments(use, [*keys, "video_id", "frame_idx", "layer"]).filter(F.col("n") >= floor)


def contributors(pixels: DataFrame, before: DataFrame | None = None, keys=("venue_id",)) -> DataFrame:
    """The videos a profile was learned from, a row each; ``before`` holds those of the profile so far."""
    found = _frame_moments(pixels, list(keys)).select(*keys, "video_id")
    return (found if before is None else found.unionByName(before.select(*keys, "video_id"))).distinct()


def learn_venue(
    pixels: DataFrame, shapes: DataFrame, existing: DataFrame | None = None, contributed: DataFrame | None = None, keys=("venue_id",)
) -> DataFrame:
    """Profile per venue: colour model of both layers, median shape, counters.

    ``pixels``: venue_id, video_id, frame_idx, layer, h, s, v.  A frame counts
    with at least 50 track or 30 sand pixels.  ``shapes``: venue_id, area,
    aspect, cx, cy, lane_angle.  ``existing``: the profiles so far, ``contributed``
    their videos as rows (see :func:`contributors`); ``n_videos`` counts all of them.
    """
    keys = list(keys)
    per_frame = _frame_moments(pixels, keys)
    colors = stats_from_moments(merge_moments(per_frame, [*keys, "layer"]))
    if existing is not None:
        old = existing.select(*keys, F.inline(F.array(
            *[F.struct(F.lit(x).alias("layer"), F.col(f"{x}.mean").alias("mean"), F.col(f"{x}.std").alias("std"),
                       F.col(f"{x}.sample_count").alias("sample_count")) for x in ("track", "sand")]
        ))).filter("mean is not null")
        parts = moments_from_stats(old).unionByName(moments_from_stats(colors))
        colors = stats_from_moments(merge_moments(parts, [*keys, "layer"]), 1)
    colors = colors.withColumn("range", S.hsv_range(F.col("mean"), F.col("std"), F.col("layer")))
    block = F.struct("mean", "std", "sample_count", "range")
    wide = colors.groupBy(*keys).agg(
        *[F.max(F.when(F.col("layer") == x, block)).alias(x) for x in ("track", "sand")]
    )
    counts = per_frame.groupBy(*keys).agg(
        F.count(F.when(F.col("layer") == "track", 1)).alias("frames_used"),
        F.count(F.when(F.col("layer") == "sand", 1)).alias("sand_frames_used"),
    )
    videos = contributors(pixels, contributed, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_videos"))
    shape = medians(shapes, keys, SHAPE)
    out = wide.filter("track is not null").join(counts, keys).join(videos, keys, "left").join(shape, keys, "left")
    if existing is not None:
        learned = ("area", "aspect", "cx", "cy")
        prev = existing.select(*keys, *[F.col(c).alias(f"_{c}") for c in ("frames_used", "sand_frames_used", *learned)])
        out = out.join(prev, keys, "left").withColumns(
            {
                **{c: F.col(c) + F.coalesce(f"_{c}", F.lit(0)) for c in ("frames_used", "sand_frames_used")},
                **{c: F.coalesce(c, f"_{c}") for c in learned},
            }
        ).drop(*[f"_{c}" for c in ("frames_used", "sand_frames_used", *learned)])
    defaults = {"area": 0.12, "aspect": 4.0, "cx": 0.5, "cy": 0.6}
    return out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})


def match_pixels(pixels: DataFrame, stats: DataFrame, layer: str, k: float = 2.0) -> DataFrame:
    """Add ``matches``: whether a pixel has the colour of the venue's layer.

    ``stats``: venue_id, layer, mean, std (and range, optional); one row per venue.
    """
    cols = [F.col("mean").alias("_m"), F.col("std").alias("_s")]
    cols.append(F.col("range").alias("_r") if "range" in stats.columns else F.lit(None).cast("struct<low:array<int>,high:array<int>>").alias("_r"))
    one = stats.filter(F.col("layer") == layer).select("venue_id", *cols)
    j = pixels.join(one, "venue_id", "left")
    hit = S.color_match(F.col("h"), F.col("s"), F.col("v"), F.col("_m"), F.col("_s"), F.lit(layer), F.col("_r.low"), F.col("_r.high"), k)
    return j.withColumn("matches", hit).drop("_m", "_s", "_r")


# ------------------------------------------------------------ appearance histograms

def histogram(samples: DataFrame, bins=(32, 8, 8), keys=("sample_id", "zone"), min_px: int = 20) -> DataFrame:
    """Sparse colour histogram per sample and zone, counts scaled to 0-1.

    ``samples``: keys and h (0-180), s, v (0-256).  Zones with fewer than
    ``min_px`` pixels stay empty.  Zero bins are not stored.
    """
    def level(c, top, n):
        return F.floor(F.col(c) * n / top)

    bh, bs, bv = bins
    code = (level("h", 180, bh) * bs + level("s", 256, bs)) * bv + level("v", 256, bv)
    counted = samples.groupBy(*keys, code.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    total = counted.groupBy(*keys).agg(
        F.sum("c").alias("_n"), F.max("c").alias("_hi"), F.min("c").alias("_lo"), F.count(F.lit(1)).alias("_k")
    ).filter(F.col("_n") >= min_px)
    low = F.when(F.col("_k") == bh * bs * bv, F.col("_lo")).otherwise(0)
    weight = F.when(F.col("_hi") > low, (F.col("c") - low) / (F.col("_hi") - low)).otherwise(1.0)
    return counted.join(total, list(keys)).select(*keys, "bin", weight.alias("weight")).filter(F.col("weight") > 0)


def zone_distance(cands: DataFrame, refs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Weighted Bhattacharyya distance of (cand_id, ref_id) pairs; empty zones 0.5.

    Histograms are sparse rows, so only bins both sides share are joined, and
    only for the pairs asked for.
    """
    ca = cands.select(F.col("sample_id").alias("cand_id"), "zone", "bin", F.col("weight").alias("wa"))
    rb = refs.select(F.col("sample_id").alias("ref_id"), "zone", "bin", F.col("weight").alias("wb"))
    shared = pairs.join(ca, "cand_id").join(rb, ["ref_id", "zone", "bin"]).groupBy("cand_id", "ref_id", "zone").agg(
        F.sum(F.sqrt(F.col("wa") * F.col("wb"))).alias("_bc")
    )
    mass_a = ca.groupBy("cand_id", "zone").agg(F.sum("wa").alias("_a"))
    mass_b = rb.groupBy("ref_id", "zone").agg(F.sum("wb").alias("_b"))
    zones = F.array(*[F.struct(F.lit(z).alias("zone"), F.lit(w).alias("_w")) for z, w in ZONE_WEIGHTS.items()])
    grid = pairs.select("cand_id", "ref_id", F.inline(zones))
    j = (
        grid.join(mass_a, ["cand_id", "zone"], "left").join(mass_b, ["ref_id", "zone"], "left")
        .join(shared, ["cand_id", "ref_id", "zone"], "left")
    )
    full = F.sqrt(F.greatest(F.lit(0.0), 1 - F.coalesce("_bc", F.lit(0.0)) / F.sqrt(F.col("_a") * F.col("_b"))))
    part = F.when(F.col("_a").isNull() | F.col("_b").isNull(), 0.5).otherwise(full)
    return j.groupBy("cand_id", "ref_id").agg(F.sum(F.col("_w") * part).alias("distance"))


def appearance_similarity(positive: DataFrame, negative: DataFrame | None = None) -> DataFrame:
    """Similarity 0-1 from distances to references (at most 20) and negatives (15).

    One minus the median distance, reduced when a known other person is close.
    """
    sim = positive.groupBy("cand_id").agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.percentile("distance", 0.5))).alias("_pos"))
    if negative is None:
        return sim.select("cand_id", F.col("_pos").alias("similarity"))
    near = negative.groupBy("cand_id").agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.min("distance"))).alias("_neg"))
    factor = F.greatest(F.lit(0.40), F.least(F.lit(1.0), 1 - 0.60 * F.coalesce("_neg", F.lit(0.0))))
    return sim.join(near, "cand_id", "left").select("cand_id", (F.col("_pos") * factor).alias("similarity"))


def mean_reference(refs: DataFrame, n: int = 10) -> DataFrame:
    """First-pass reference: the mean histogram of the last ``n`` samples.

    ``refs``: video_id, ref_age (1 newest), zone, bin, weight.
    """
    kept = refs.filter(F.col("ref_age") <= n)
    count = kept.groupBy("video_id").agg(F.count_distinct("ref_age").alias("_n"))
    return kept.join(count, "video_id").groupBy("video_id", "zone", "bin").agg(
        (F.sum("weight") / F.first("_n")).alias("weight")
    )


# ------------------------------------------------------------ regions

def pick_regions(regions: DataFrame, profile: DataFrame) -> DataFrame:
    """Best track and sand region per frame with the frame's confidence.

    ``regions``: venue_id, video_id, frame_idx, region_id, layer, area, aspect,
    cx, cy; ``profile``: venue_id, area, aspect, cx, cy.
    """
    p = profile.select("venue_id", F.struct("area", "aspect", "cx", "cy").alias("_e"))
    r = regions.join(p, "venue_id")
    e = F.col("_e")
    score = S.shape_score(F.col("area"), F.col("aspect"), F.col("cy"), e, F.col("layer"))
    track = F.col("layer") == "track"
    roi = (F.col("cx") >= e["cx"] - 0.35) & F.when(
        track, F.abs(F.col("cy") - e["cy"]) <= 0.18
    ).otherwise(F.col("cy") >= e["cy"] - 0.05)
    r = r.withColumn("_score", F.when(roi, score))
    top = F.when(track, 0.25).otherwise(0.20)
    bottom = F.when(track, 0.005).otherwise(0.003)
    item = F.struct("region_id", "area", "cy", F.col("_score").alias("score"))
    key = ["venue_id", "video_id", "frame_idx"]

    def best(layer):
        mine = F.col("layer") == layer
        good = F.max_by(item, F.when(mine & (F.col("_score") > 0), F.struct("_score", -F.col("region_id"))))
        big = F.max_by(item, F.when(mine & F.col("area").between(bottom, top), F.struct("area", -F.col("region_id"))))
        return [good.alias(f"_{layer}"), big.alias(f"_{layer}_big")]

    agg = r.groupBy(*key).agg(F.first("_e").alias("_e"), *best("track"), *best("sand"))
    track_score = F.when(F.col("_track").isNotNull(), F.col("_track.score")).otherwise(0.55)
    chosen = F.coalesce("_track", "_track_big")
    size = S.gaussian(chosen["area"], F.col("_e.area"), 0.04)
    base = F.least(F.lit(1.0), track_score * 0.6 + size * 0.4)
    conf = (
        F.when(F.col("_sand").isNotNull(), F.least(F.lit(1.0), base * 0.7 + F.col("_sand.score") * 0.3))
        .when(F.col("_sand_big").isNotNull(), F.least(F.lit(1.0), base * 0.85 + 0.1))
        .otherwise(base)
    )
    return agg.filter(chosen.isNotNull()).select(
        *key, chosen["region_id"].alias("track_region"), F.coalesce("_sand", "_sand_big")["region_id"].alias("sand_region"),
        conf.alias("confidence"),
    )

