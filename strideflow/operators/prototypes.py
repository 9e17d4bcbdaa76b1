"""Prototypes, templates and everything scored against them.

A prototype set is a dozen rows, so it is folded into one row of maps and joined
by broadcast; frames are scored in place and never multiplied by the phases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..schemas import CONTACT_PHASES, HOPS, PHASES
from .sequence import positions

QUALITY_MIN = 0.35
EMA = 0.25
N_FEATURES = 14
TAGS = ("hop_contact", "landing", "feet_together")


def prototype_sheet(prototypes: DataFrame) -> DataFrame:
    """One row: ``_phases`` and ``_tags``, MAP<key, STRUCT<centroid, weights>>.

    Only the fixed phase and tag names are kept, which bounds the row's size; a name
    that comes twice counts once.
    """
    known = prototypes.filter(F.col("kind").isin("phase", "tag") & F.col("key").isin(*PHASES, *TAGS))
    one = known.groupBy("kind", "key").agg(F.min(F.struct("centroid", "weights")).alias("value"))
    entry = F.struct("key", "value")

    def as_map(kind):
        return F.map_from_entries(F.collect_list(F.when(F.col("kind") == kind, entry)))

    return one.agg(as_map("phase").alias("_phases"), as_map("tag").alias("_tags"))


def with_sheet(df: DataFrame, prototypes: DataFrame) -> DataFrame:
    """Attach the one-row prototype sheet (a broadcast of one row, by construction)."""
    return df.crossJoin(F.broadcast(prototype_sheet(prototypes)))


def tag_score(vec: Column, tag: str) -> Column:
    p = F.col("_tags")[tag]
    return V.prototype_similarity(vec, p["centroid"], p["weights"])


def phase_entry(phase: str | Column) -> Column:
    return F.coalesce(F.col("_phases")[phase], F.col("_tags")[phase])


def phase_score(vec: Column, quality: Column, phase: str, template: Column | None = None) -> Column:
    if template is None:
        template = F.lit(None).cast("struct<centroid:array<double>,weights:array<double>>")
    return V.phase_similarity(vec, quality, phase_entry(phase), template)


def with_templates(df: DataFrame, templates: DataFrame | None) -> DataFrame:
    """Attach ``_own``: the athlete's phase templates as a map (null when none).

    Templates are at most seven rows per athlete; the join is on ``athlete_id``
    and Spark picks broadcast or shuffle from the measured size.
    """
    kind = "map<string,struct<centroid:array<double>,weights:array<double>>>"
    if templates is None or "athlete_id" not in df.columns:
        return df.withColumn("_own", F.lit(None).cast(kind))
    per_athlete = templates.filter((F.col("kind") == "phase") & F.col("key").isin(*PHASES)).groupBy(
        "athlete_id"
    ).agg(
        F.map_from_entries(
            F.collect_list(F.struct("key", F.struct("centroid", "weights")))
        ).alias("_own")
    )
    return df.join(per_athlete, "athlete_id", "left")


def classify_frames(
    frames: DataFrame, prototypes: DataFrame, templates: DataFrame | None = None
) -> DataFrame:
    """Best phase of every valid pose, its score and the scores of all phases."""
    src = with_templates(with_sheet(frames.filter("pose.valid"), prototypes), templates)
    vec, quality = F.col("pose.vector"), F.col("pose.quality")
    # one expression for all phases: the plan does not grow with their number
    entries = F.array(*[F.struct(F.lit(p).alias("phase"), F.lit(-i).alias("rank"), phase_entry(p).alias("proto"), F.col("_own")[p].alias("own")) for i, p in enumerate(PHASES)])
    scores = F.transform(
        entries, lambda e: F.struct(V.phase_similarity(vec, quality, e["proto"], e["own"]).alias("score"), e["rank"].alias("rank"), e["phase"].alias("phase"))
    )
    scored = src.withColumn("_scores", scores)
    best = F.array_max("_scores")
    return scored.select(
        *[c for c in frames.columns if c != "keypoints"],
        best["phase"].alias("predicted_phase"),
        best["score"].alias("confidence"),
        F.map_from_entries(
            F.transform("_scores", lambda s: F.struct(s["phase"].alias("key"), s["score"].alias("value")))
        ).alias("scores"),
    )


def _bucket() -> Column:
    """Prototype a sample counts for; null when it counts for none."""
    tag = F.coalesce(
        F.col("pose_tag"), F.when(F.col("phase") == "landing", "landing").otherwise("hop_contact")
    )
    return F.when(tag.isin(*TAGS), tag).when(F.col("phase").isin(*HOPS), F.lit("hop_contact"))


def vector_means(vec: str | Column, n: int = N_FEATURES, digits: int = 4) -> Column:
    """Element-wise mean as one aggregate row: no explode, partial sums map-side."""
    v = F.col(vec) if isinstance(vec, str) else vec
    return F.array(*[F.round(F.avg(F.get(v, F.lit(i))), digits) for i in range(n)])


def rebuild_prototypes(gt: DataFrame, prototypes: DataFrame, quality_min: float = QUALITY_MIN) -> DataFrame:
    """New centroids from the ground truth; weights and untouched entries are kept.

    A tag needs two samples, except hop_contact.  The hop_contact mean is also
    written to the four hop phases.
    """
    used = gt.filter(
        (F.coalesce("quality_score", F.lit(0.0)) >= quality_min) & (F.size("feature_vector") > 0)
    ).withColumn("_tag", _bucket())
    means = (
        used.filter(F.col("_tag").isNotNull())
        .groupBy("_tag")
        .agg(vector_means("feature_vector").alias("_centroid"), F.count(F.lit(1)).cast("int").alias("_n"))
        .filter((F.col("_n") >= 2) | (F.col("_tag") == "hop_contact"))
    )
    entries = means.select(
        F.explode(
            F.when(
                F.col("_tag") == "hop_contact",
                F.array(
                    F.struct(F.lit("tag").alias("kind"), F.col("_tag").alias("key")),
                    *[F.struct(F.lit("phase").alias("kind"), F.lit(h).alias("key")) for h in HOPS],
                ),
            ).otherwise(F.array(F.struct(F.lit("tag").alias("kind"), F.col("_tag").alias("key"))))
        ).alias("e"),
        "_centroid",
        "_n",
    ).select("e.kind", "e.key", "_centroid", "_n")
    merged = prototypes.join(entries, ["kind", "key"], "full_outer")
    return merged.select(
        "kind",
        "key",
        F.coalesce("_centroid", "centroid").alias("centroid"),
        F.coalesce("weights", F.array_repeat(F.lit(1.0), N_FEATURES)).alias("weights"),
        F.coalesce("_n", "sample_count").alias("sample_count"),
    )


def ema_templates(markers: DataFrame, existing: DataFrame | None = None, n: int = N_FEATURES) -> DataFrame:
    """Exponential averages of confirmed poses per athlete and tag (or phase).

    ``markers``: athlete_id, phase, pose_tag, ``confirm_seq`` (unique per athlete)
    and ``vector``.  A moving average with factor a gives the k-th of n samples
    the weight a(1-a)^(n-k) (the first one (1-a)^(n-1)), so it is one weighted
    sum over row numbers instead of a fold over a collected list.
    """
    valid = markers.filter(F.col("athlete_id").isNotNull() & F.col("vector").isNotNull()).select(
        "athlete_id",
        F.when(F.col("pose_tag").isNotNull(), "tag").otherwise("phase").alias("kind"),
        F.coalesce("pose_tag", "phase").alias("key"),
        "confirm_seq",
        "vector",
    )
    keys = ["athlete_id", "kind", "key"]
    placed = positions(valid, keys, ["confirm_seq"], pos="_pos", count="_n")
    if existing is not None:
        known = existing.select(
            *keys, F.col("centroid").alias("_old"), F.col("weights").alias("_w"),
            F.coalesce("sample_count", F.lit(1)).alias("_count"),
        )
        placed = placed.join(known, keys, "left")
    else:
        placed = placed.withColumns(
            {
                "_old": F.lit(None).cast("array<double>"),
                "_w": F.lit(None).cast("array<double>"),
                "_count": F.lit(None).cast("int"),
            }
        )
    keep = F.pow(F.lit(1 - EMA), (F.col("_n") - F.col("_pos")).cast("double"))
    seeds = (F.col("_pos") == 1) & F.col("_old").isNull()
    weight = F.when(seeds, keep).otherwise(EMA * keep)
    carried = F.pow(F.lit(1 - EMA), F.max("_n").cast("double"))
    old = F.first("_old")
    return placed.groupBy(*keys).agg(
        F.array(
            *[
                F.round(
                    F.sum(weight * F.get("vector", F.lit(i)))
                    + F.coalesce(carried * F.get(old, F.lit(i)), F.lit(0.0)),
                    4,
                )
                for i in range(n)
            ]
        ).alias("centroid"),
        F.coalesce(F.first("_w"), F.array_repeat(F.lit(1.0), n)).alias("weights"),
        (F.max("_n") + F.coalesce(F.first("_count"), F.lit(0))).cast("int").alias("sample_count"),
    )


def pose_from_prototype(prototypes: DataFrame, tags: tuple[str, ...] = ("hop_contact",)) -> DataFrame:
    """Approximate leg joints of a tag in hip-centred unit coordinates.

    Knee positions come from the knee angles, ankle positions from their
    separation and asymmetry.  A tag without a full centroid gets neutral values.
    """
    spark = prototypes.sparkSession
    wanted = spark.createDataFrame([(t,) for t in tags], "key string")
    known = prototypes.filter((F.col("kind") == "tag") & (F.size("centroid") >= N_FEATURES))
    base = F.broadcast(wanted).join(known.select("key", "centroid"), "key", "left")

    def feature(i, default):
        return F.coalesce(F.get("centroid", F.lit(i)), F.lit(default))

    def degrees(value):
        wide = F.when(value <= 3.5, 90 + value * 90).otherwise(value)
        return F.greatest(F.lit(60.0), F.least(F.lit(175.0), wide))

    sep, asym = feature(3, 0.35), feature(4, 0.25)
    sep = F.greatest(F.lit(0.1), F.least(F.lit(1.0), F.when(sep > 0.05, sep).otherwise(0.35)))
    asym = F.greatest(F.lit(0.0), F.least(F.lit(0.8), F.when(asym < 2, asym).otherwise(0.25)))
    # Half hip width, thigh and shank length of the unit figure.
    hip, thigh, shank = 0.14, 0.42, 0.45
    joints = []
    for side, sign, angle in (("l", 1.0, degrees(feature(0, 140.0))), ("r", -1.0, degrees(feature(1, 155.0)))):
        bend = F.radians(180.0 - angle)
        hip_x = -sign * hip
        knee_x = hip_x + sign * thigh * F.sin(bend * 0.35)
        knee_y = thigh * F.cos(bend * 0.15)
        ankle_x = -sign * (sep * 0.5 + asym * 0.15)
        for name, x, y in (
            ("hip", F.lit(hip_x), F.lit(0.0)), ("knee", knee_x, knee_y), ("ankle", ankle_x, knee_y + shank * 0.95),
        ):
            joints.append(F.struct(F.lit(f"{side}_{name}").alias("name"), x.alias("x"), y.alias("y")))
    return base.select(F.col("key").alias("pose_tag"), F.array(*joints).alias("keypoints"))


def contact_phase(col: str | Column = "phase") -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return c.isin(*CONTACT_PHASES)
