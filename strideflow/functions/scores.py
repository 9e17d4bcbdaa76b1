"""Labels, indicators and blended scores used across the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Label texts, limits and weights.
LABEL_GOOD, LABEL_FAIR, LABEL_WEAK = "buena", "regular", "débil"
NEAR_SHARE = 0.08
ABOVE, BELOW, NEAR = "+", "−", "~"


def label_pose(score: Column) -> Column:
    return F.when(score >= 0.75, LABEL_GOOD).when(score >= 0.55, LABEL_FAIR).when(
        score.isNotNull(), LABEL_WEAK
    )


def indicator(current: Column, mean: Column) -> Column:
    """``~`` within 8 % of the mean, else above or below; null if either is."""
    flat = F.abs(mean) < 1e-9
    share = (current - mean) / F.abs(mean)
    side = F.when(current > mean, F.lit(ABOVE)).otherwise(F.lit(BELOW))
    return F.when(
        current.isNotNull() & mean.isNotNull(),
        F.when(flat & (F.abs(current) < 1e-9), F.lit(NEAR))
        .when(~flat & (F.abs(share) <= NEAR_SHARE), F.lit(NEAR))
        .when(flat, F.when(current > 0, F.lit(ABOVE)).otherwise(F.lit(BELOW)))
        .otherwise(side),
    )


def fused_score(
    prominence: Column, pose: Column, landing: Column, surface: Column, prefer_landing: bool = False
) -> Column:
    """0.40 prominence + 0.45 pose + 0.15 surface bonus."""
    if prefer_landing:
        pose, best, unknown, other = landing, "sand", 0.35, 0.1
    else:
        best, unknown, other = "track", 0.55, 0.15
    bonus = F.when(surface == best, 1.0).when(surface == "unknown", unknown).otherwise(other)
    return 0.40 * prominence + 0.45 * pose + 0.15 * bonus


def contact_confidence(fused: Column, hop_sim: Column, surface: Column) -> Column:
    base = F.least(F.lit(1.0), 0.25 + 0.55 * fused + 0.2 * hop_sim)
    return F.when(surface != "unknown", F.least(F.lit(1.0), base + 0.1)).otherwise(base)


def blend_mask_score(sim: Column, track: Column, sand: Column, sand_weight: Column | float = 0.20) -> Column:
    return sim + 0.30 * track + sand_weight * sand


def zone(progress: Column) -> Column:
    return (
        F.when(progress >= 0.90, F.lit("landing")).when(progress >= 0.30, F.lit("mid")).otherwise("early")
    )


def gaussian(x: Column, mu: Column, sigma: float) -> Column:
    z = (x - mu) / sigma
    return F.exp(-0.5 * z * z)


# ------------------------------------------------------------ texts

def clean_athlete_id(raw: Column) -> Column:
    """Letters (accented too), digits, underscore, spaces and hyphen survive."""
    return F.trim(F.regexp_replace(F.trim(F.coalesce(raw, F.lit(""))), r"(?U)[^\w\s\-]", ""))


def slug(name: Column) -> Column:
    """Lower case, accents removed, blanks as hyphens."""
    accents, plain = "áàâäãéèêëíìîïóòôöõúùûüñç", "aaaaaeeeeiiiiooooouuuunc"
    return F.regexp_replace(F.translate(F.lower(name), accents, plain), r"\s+", "-")


def duration_label(seconds: Column) -> Column:
    total = F.greatest(F.lit(0), F.round(seconds).cast("long"))
    text = F.format_string("%d:%02d", F.floor(total / 60), total % 60)
    return F.when(seconds.isNotNull() & ~F.isnan(seconds), text).otherwise("—")


# ------------------------------------------------------------ session figures

def success_pct(consistency: Column, pose_overall: Column, hop_scores: Column) -> Column:
    """Consistency, else pose quality, else the mean hop score, in percent."""
    total = F.aggregate(hop_scores, F.lit(0.0), lambda a, s: a + F.coalesce(s, F.lit(0.0)))
    hops = F.when(F.size(hop_scores) > 0, total / F.size(hop_scores))
    return F.round(F.coalesce(consistency, pose_overall, hops) * 100).cast("int")


def analysis_state(has_analysis: Column, contacts: Column, segments: Column) -> Column:
    return (
        F.when(~F.coalesce(has_analysis, F.lit(False)), F.lit("none"))
        .when((F.coalesce(contacts, F.lit(0)) >= 4) & (F.coalesce(segments, F.lit(0)) > 0), F.lit("full"))
        .otherwise("partial")
    )


def delta_vs_row(speed_delta: Column, sign: Column) -> Column:
    """The speed difference when there is one, else 0.3 in the indicated direction."""
    return (
        F.when(speed_delta.isNotNull() & ~F.isnan(speed_delta), speed_delta)
        .when(sign == ABOVE, 0.3)
        .when(sign.isin("-", BELOW), -0.3)
        .otherwise(0.0)
    )


def section_confidence(n_contacts: Column, mean_conf: Column, usable: Column) -> Column:
    full = F.least(F.lit(1.0), n_contacts / 5)
    return F.round(0.5 * full + 0.3 * mean_conf + 0.2 * usable, 3)


def marker_confidence(n_contacts: Column) -> Column:
    return F.round(F.least(F.lit(1.0), n_contacts / 5) * 0.7 + 0.3, 3)


# ------------------------------------------------------------ colour ranges

# What the two layers may look like (OpenCV hue 0-179).
TRACK_HUE, TRACK_SAT_MIN, TRACK_VAL_MIN = (35, 100), 10, 80
SAND_HUE, SAND_SAT_MIN = (10, 35), 40
LIMITS = (179, 255, 255)


def _with_priors(low: list[Column], high: list[Column], layer: Column):
    track = layer == "track"
    hue = lambda i: F.when(track, F.lit(TRACK_HUE[i])).otherwise(F.lit(SAND_HUE[i]))
    sat = F.when(track, F.lit(TRACK_SAT_MIN)).otherwise(F.lit(SAND_SAT_MIN))
    low = [
        F.greatest(low[0], hue(0)),
        F.greatest(low[1], sat),
        F.when(track, F.greatest(low[2], F.lit(TRACK_VAL_MIN))).otherwise(low[2]),
    ]
    return low, [F.least(high[0], hue(1)), high[1], high[2]]


def hsv_range(mean: Column, std: Column, layer: Column, k: float = 1.5) -> Column:
    """STRUCT<low, high> of mean +- k std with the layer's priors.

    When the priors leave nothing, a band of +-k around the mean is used.
    """
    def band(lo, hi):
        return _with_priors(
            [F.greatest(F.lit(0), lo(i)) for i in range(3)],
            [F.least(F.lit(LIMITS[i]), hi(i)) for i in range(3)],
            layer,
        )

    low, high = band(
        lambda i: F.round(mean[i] - k * std[i]).cast("int"),
        lambda i: F.round(mean[i] + k * std[i]).cast("int"),
    )
    near_low, near_high = band(
        lambda i: (mean[i] - k).cast("int"), lambda i: (mean[i] + k).cast("int")
    )
    empty = (low[0] > high[0]) | (low[1] > high[1]) | (low[2] > high[2])
    return F.struct(
        F.when(empty, F.array(*near_low)).otherwise(F.array(*low)).alias("low"),
        F.when(empty, F.array(*near_high)).otherwise(F.array(*high)).alias("high"),
    )


def color_match(h: Column, s: Column, v: Column, mean: Column, std: Column, layer: Column,
                low: Column, high: Column, k: float = 2.0) -> Column:
    """Pixel test: mean +- k std with priors; stored ranges without statistics.

    The track has no upper limit on brightness; without a profile nothing matches.
    """
    track = layer == "track"
    lo = [mean[i] - k * std[i] for i in range(3)]
    hi = [mean[i] + k * std[i] for i in range(3)]
    lo, hi = _with_priors(lo, hi, layer)
    hi[1] = F.when(track, F.least(hi[1], F.lit(255.0))).otherwise(hi[1])
    by_stats = (
        h.between(lo[0], hi[0]) & s.between(lo[1], hi[1]) & (v >= lo[2]) & (track | (v <= hi[2]))
    )
    by_range = h.between(low[0], high[0]) & s.between(low[1], high[1]) & v.between(low[2], high[2])
    return F.coalesce(F.when(mean.isNotNull() & std.isNotNull(), by_stats), by_range, F.lit(False))


def shape_score(area: Column, aspect: Column, cy: Column, expected: Column, layer: Column) -> Column:
    """Likeness of a region to the venue's track or sand; -1 outside the size limits.

    ``expected`` is STRUCT<area, aspect, cx, cy>.
    """
    ceiling = F.when(layer == "sand", F.lit(0.20)).otherwise(F.lit(0.25))
    likeness = (
        0.45 * gaussian(area, expected.area, 0.04)
        + 0.30 * gaussian(aspect, expected.aspect, 2.0)
        + 0.25 * gaussian(cy, expected.cy, 0.15)
    )
    outside = (area > F.least(ceiling, expected.area * 2.5)) | (
        area < F.greatest(F.lit(0.015), expected.area * 0.2)
    )
    return F.when(outside, -1.0).otherwise(likeness)
