"""Ground contacts: detection, selection, phases and hop propagation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pose as P
from ..functions import scores as S
from ..functions.geometry import project_box
from ..schemas import HOPS, PHASES
from ..session import cut_lineage
from .joins import bracket_interpolate, classify_surface, nearest_mark
from .prototypes import phase_score, tag_score, with_sheet, with_templates
from .sequence import contact_signal, local_maxima, min_gap_filter, peaks, scan

# Limits of the detector.
PROMINENCE = 4.0
MIN_GAP = 8
NEAR_GAP = 3
RUNNING_MAX_S = 0.45
HOP_GAP = (8, 35)
LAND_GAP = (5, 55)
SEARCH_WINDOW, SEARCH_GAP = 45, 10


# ------------------------------------------------------------ candidates

def pose_sims(frames: DataFrame, prototypes: DataFrame) -> DataFrame:
    """Add hop_sim and landing_sim: tag score blended with the pose's own score."""
    src = with_sheet(frames, prototypes)
    ok, vec = F.col("pose.valid"), F.col("pose.vector")

    def sim(tag, own):
        return F.when(ok, 0.7 * tag_score(vec, tag) + 0.3 * F.col(f"pose.{own}")).otherwise(0.0)

    return src.withColumns(
        {"hop_sim": sim("hop_contact", "hop_contact_score"), "landing_sim": sim("landing", "landing_score")}
    ).drop("_phases", "_tags")


def union_candidates(*parts: DataFrame) -> DataFrame:
    """Candidate frames of all finders; the most prominent entry of a frame wins."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("video_id", "frame_idx").agg(F.max("prominence").alias("prominence"))


def contact_candidates(frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates with prominence, prom_ref per video).

    ``frames``: detected frames with foot_y, hop_sim, landing_sim, pose_quality.
    """
    narrow = frames.select("video_id", "frame_idx", "foot_y", "hop_sim", "landing_sim", "pose_quality")
    signal = cut_lineage(
        contact_signal(narrow.filter(F.col("foot_y").isNotNull()).select("video_id", "frame_idx", "foot_y"))
    )
    ref = narrow.select("video_id").distinct().join(
        signal.groupBy("video_id").agg(
            F.stddev_pop("signal").alias("_sd"), F.count(F.lit(1)).alias("_n")
        ),
        "video_id", "left",
    ).select(
        "video_id",
        F.when(F.col("_n") >= 3, F.greatest(F.lit(PROMINENCE), F.col("_sd") * 0.2)).otherwise(PROMINENCE).alias("prom_ref"),
    )
    found = peaks(signal).join(ref, "video_id").filter(
        F.col("prominence") >= F.col("prom_ref") * 0.55
    ).select("video_id", "frame_idx", "prominence")

    def tops(col, floor, share):
        v = F.when(F.col("pose_quality") >= 0.2, F.col(col))
        marked = local_maxima(narrow.select("video_id", "frame_idx", v.alias("v")), "v", floor)
        return marked.filter("is_max").join(ref, "video_id").select(
            "video_id", "frame_idx", (F.col("prom_ref") * share).alias("prominence")
        )

    merged = union_candidates(found, tops("hop_sim", 0.32, 0.8), tops("landing_sim", 0.30, 0.7))
    return min_gap_filter(merged, "prominence", NEAR_GAP), ref


def detect_contacts(
    frames: DataFrame, prototypes: DataFrame, spans: DataFrame | None = None,
    mask_frames: DataFrame | None = None, keyframes: DataFrame | None = None,
    width: int = 1280, height: int = 720,
) -> DataFrame:
    """Contact candidates of each video, at least eight frames apart.

    ``frames`` carries keypoints, person_bbox, pose, timestamp_s, person_detected.
    The narrow per-frame table is written once to the shared checkpoint folder;
    everything after it works on that table instead of the raw frames.
    """
    seen = pose_sims(frames.filter("person_detected"), prototypes)
    point = P.foot_point()
    narrow = cut_lineage(
        seen.select(
            "video_id", "frame_idx", "timestamp_s", "person_bbox", P.foot_y().alias("foot_y"),
            point.x.alias("foot_x"), point.y.alias("foot_py"), "hop_sim", "landing_sim",
            F.col("pose.quality").alias("pose_quality"),
        )
    )
    picked, ref = contact_candidates(narrow)
    rows = picked.join(narrow.drop("foot_y"), ["video_id", "frame_idx"]).join(ref, "video_id")
    # From here on a few rows per video: cut, so that later steps do not repeat this.
    rows = cut_lineage(rows.withColumnRenamed("foot_py", "foot_y").filter(F.col("foot_x").isNotNull()))
    if spans is not None:
        marks = spans.select("video_id", "frame_idx") if mask_frames is None else mask_frames
        rows = cut_lineage(nearest_mark(rows, marks, out="near_mask"))
        rows = classify_surface(rows, spans, mask_idx="near_mask", width=width, height=height)
    else:
        rows = rows.withColumn("surface", F.lit("unknown"))
    if keyframes is not None:
        rows = bracket_interpolate(rows, keyframes.select("video_id", "frame_idx", "axis")).withColumn(
            "position_s", project_box(F.col("person_bbox"), F.col("axis"), F.lit(width), F.lit(height))
        )
    else:
        rows = rows.withColumn("position_s", F.lit(None).cast("double"))
    rows = rows.select(
        "video_id", "frame_idx", "timestamp_s", "surface", "position_s", "prominence", "prom_ref",
        "hop_sim", "landing_sim",
    )
    return settle_contacts(cut_lineage(rows))


def settle_contacts(rows: DataFrame) -> DataFrame:
    """Score, thin out to one per eight frames, infer surfaces and score again."""
    norm = F.least(F.lit(1.0), F.col("prominence") / F.greatest(F.col("prom_ref") * 2.5, F.lit(1.0)))
    first = P.bind(rows, {"_fused": S.fused_score(norm, F.col("hop_sim"), F.col("landing_sim"), F.col("surface"))})
    first = first.withColumns(
        {
            "confidence": F.round(S.contact_confidence(F.col("_fused"), F.col("hop_sim"), F.col("surface")), 3),
            "pose_sim": F.round("hop_sim", 3),
            "landing_sim": F.round("landing_sim", 3),
            "fused_score": F.round("_fused", 3),
        }
    ).drop("_fused", "hop_sim")
    kept = cut_lineage(min_gap_filter(first, "fused_score", MIN_GAP))
    ends = approach_end(kept)
    known = infer_surface(kept, ends)
    fused = S.fused_score(norm, F.col("pose_sim"), F.col("landing_sim"), F.col("surface"))
    return known.withColumn("fused_score", F.round(fused, 3))


# ------------------------------------------------------------ approach and surfaces

def approach_end(contacts: DataFrame) -> DataFrame:
    """Per video the last frame of the run-up.

    The run-up is the leading run of track contacts less than 0.45 s apart; the
    contact after it is the first hop.  Without track contacts the run-up ends
    just before the first contact.
    """
    track = contacts.filter(F.col("surface") == "track").select("video_id", "frame_idx", "timestamp_s")
    follow = F.struct(F.col("frame_idx").alias("f"), F.col("timestamp_s").alias("t"))
    linked = scan(track, ["video_id"], ["frame_idx"], after={"_next": follow})
    slow = F.abs(F.col("_next.t") - F.col("timestamp_s")) >= RUNNING_MAX_S
    # First break: the hop is the contact after it.  No break: the last contact.
    hop = linked.groupBy("video_id").agg(
        F.min(F.when(slow, F.col("_next.f"))).alias("_hop"), F.max("frame_idx").alias("_last")
    )
    first = contacts.groupBy("video_id").agg(F.min("frame_idx").alias("_first"))
    return first.join(hop, "video_id", "left").select(
        "video_id",
        F.greatest(F.lit(0), F.coalesce("_hop", "_last", "_first") - 1).alias("approach_end"),
    )


def infer_surface(contacts: DataFrame, ends: DataFrame) -> DataFrame:
    """Unknown contacts after the run-up: track before the first sand one; with no
    sand at all the first four are track."""
    rows = contacts.join(ends, "video_id", "left")
    late = F.col("frame_idx") > F.col("approach_end")
    placed = scan(
        rows, ["video_id"], ["frame_idx"],
        running={"_i": F.when(late, 1).otherwise(0)},
        totals={"_sand": ("min", F.when(late & (F.col("surface") == "sand"), F.col("frame_idx")))},
    )
    guess = late & (F.col("surface") == "unknown") & (
        F.when(F.col("_sand").isNotNull(), F.col("frame_idx") < F.col("_sand")).otherwise(F.col("_i") <= 4)
    )
    return placed.withColumn("surface", F.when(guess, "track").otherwise(F.col("surface"))).drop("_i", "_sand", "approach_end")


# ------------------------------------------------------------ selection

def pick_landing(contacts: DataFrame) -> DataFrame:
    """The landing contact of each video: video_id, landing (STRUCT), span bounds."""
    bounds = contacts.groupBy("video_id").agg(F.min("frame_idx").alias("first_f"), F.max("frame_idx").alias("last_f"))
    rows = contacts.join(bounds, "video_id")
    f, last = F.col("frame_idx"), F.col("last_f")
    span = F.greatest(last - F.col("first_f"), F.lit(1))

    def cut(share):
        return F.col("first_f") + F.floor(share * span)

    item = F.struct("frame_idx", "timestamp_s", "surface", "position_s", "confidence", "prominence",
                    "pose_sim", "landing_sim", "fused_score")
    tail = f / F.greatest(last, F.lit(1))
    sand = F.col("surface") == "sand"
    strong = 0.60 * F.col("landing_sim") + 0.20 * F.col("fused_score") + 0.20 * tail
    rescue = 0.55 * F.col("landing_sim") + 0.20 * F.col("fused_score") + 0.25 * tail

    def best(condition, key):
        # Ties go to the earlier frame, as in a scan from the start.
        return F.max_by(item, F.when(condition, F.struct(key, -f)))

    agg = rows.groupBy("video_id").agg(
        F.first("first_f").alias("first_f"), F.first("last_f").alias("last_f"),
        best(sand & (f >= cut(0.45)), f).alias("_late_sand"),
        best(sand, f).alias("_any_sand"),
        best(f >= cut(0.55), strong).alias("_strong"),
        best(f >= cut(0.60), rescue).alias("_rescue"),
    )
    span = F.greatest(F.col("last_f") - F.col("first_f"), F.lit(1))
    cand = F.coalesce("_late_sand", "_any_sand")
    agg = agg.withColumn("_cand", cand)
    trusted = F.col("_cand").isNotNull() & ~(
        F.col("last_f") - F.col("_cand.frame_idx") > F.greatest(F.lit(40), F.floor(0.25 * span))
    )
    better = (
        (F.col("_cand.landing_sim") < 0.35)
        & (F.col("_strong.landing_sim") > F.col("_cand.landing_sim") + 0.08)
        & (F.abs(F.col("_strong.frame_idx") - F.col("_cand.frame_idx")) <= 30)
    )
    pick = F.when(trusted & F.coalesce(better, F.lit(False)), F.col("_strong")).when(
        trusted, F.col("_cand")
    ).otherwise(F.col("_rescue"))
    return agg.select("video_id", "first_f", "last_f", pick.alias("landing"))


def hop_score(window_start: Column, hop_window: Column) -> Column:
    prom = F.least(F.lit(1.0), F.col("prominence") / 18.0)
    late = F.least(
        F.lit(1.0), F.greatest(F.lit(0), F.col("frame_idx") - window_start) / F.greatest(hop_window, F.lit(1))
    )
    score = (
        0.45 * F.col("pose_sim") + 0.30 * prom + 0.15 * F.col("fused_score")
        + F.when(F.col("surface") == "track", 0.05).otherwise(0.0) + 0.05 * late
    )
    return F.when((F.col("pose_sim") < 0.30) & (prom > 0.6), score * 0.55).otherwise(score)


def pick_hops(contacts: DataFrame, landing: DataFrame, ends: DataFrame) -> DataFrame:
    """The four hops before the landing (fewer when there are not enough).

    Chains of four are built by range joins.  Gaps of 8 to 35 frames and at most
    55 frames to the landing keep every chain within 160 frames, so a video of
    any length contributes at most some twenty contacts to the joins.
    """
    marks = landing.select("video_id", F.col("landing.frame_idx").alias("land_f"), "first_f", "last_f")
    rows = contacts.join(marks, "video_id").join(ends, "video_id", "left").filter(
        (F.col("frame_idx") < F.col("land_f")) & (F.col("surface") != "sand")
    )
    span = F.greatest(F.col("last_f") - F.col("first_f"), F.lit(1))
    window = F.greatest(F.lit(90), F.floor(0.45 * span))
    start = F.greatest(F.lit(0), F.col("land_f") - window)
    end = F.coalesce("approach_end", F.lit(0))
    start = F.when(end > 0, F.least(start, F.greatest(F.lit(0), end - 5))).otherwise(start)
    rows = P.bind(rows, {"_window": window, "_start": start})
    counts = rows.groupBy("video_id").agg(F.count(F.when(F.col("frame_idx") >= F.col("_start"), 1)).alias("_in"))
    rows = rows.join(counts, "video_id").filter((F.col("_in") < 4) | (F.col("frame_idx") >= F.col("_start")))
    item = F.struct("frame_idx", "timestamp_s", "surface", "position_s", "confidence", "prominence",
                    "pose_sim", "landing_sim", "fused_score")
    scored = cut_lineage(
        rows.select("video_id", "frame_idx", "land_f", hop_score(F.col("_start"), F.col("_window")).alias("score"),
                    (F.col("prominence") >= PROMINENCE).cast("int").alias("strong"), item.alias("c"))
    )
    near = scored.filter(F.col("land_f") - F.col("frame_idx") <= LAND_GAP[1] + 3 * HOP_GAP[1])

    def step(i):
        return near.select(
            "video_id", F.col("frame_idx").alias(f"f{i}"), F.col("score").alias(f"s{i}"),
            F.col("strong").alias(f"g{i}"), F.col("c").alias(f"c{i}"), *(["land_f"] if i == 4 else []),
        )

    chain = step(1)
    for i in (2, 3, 4):
        gap = F.col(f"f{i}") - F.col(f"f{i - 1}")
        chain = chain.join(step(i), "video_id").filter(gap.between(*HOP_GAP))
    to_land = F.col("land_f") - F.col("f4")
    chain = chain.filter(to_land.between(*LAND_GAP)).withColumn("_strong", F.col("g1") + F.col("g2") + F.col("g3") + F.col("g4"))
    chain = chain.filter(F.col("_strong") >= 2)
    gaps = [F.col(f"f{i + 1}") - F.col(f"f{i}") for i in (1, 2, 3)]
    mean = (gaps[0] + gaps[1] + gaps[2]) / 3
    var = ((gaps[0] - mean) * (gaps[0] - mean) + (gaps[1] - mean) * (gaps[1] - mean) + (gaps[2] - mean) * (gaps[2] - mean)) / 3
    bonus = F.when(mean.between(12, 24), 1.0).when(mean.between(8, 30), 0.55).otherwise(0.2)
    rhythm = bonus * F.greatest(F.lit(0.0), 1.0 - F.sqrt(var) / mean)
    score = (
        F.col("s1") + F.col("s2") + F.col("s3") + F.col("s4")
        + 0.15 * (1.0 - F.least(F.lit(1.0), to_land / 55.0)) + 0.55 * rhythm + 0.15 * F.col("_strong")
    )
    best = chain.groupBy("video_id").agg(
        F.max_by(F.array("c1", "c2", "c3", "c4"), F.struct(score, -F.col("f1"), -F.col("f2"), -F.col("f3"), -F.col("f4"))).alias("_chain")
    )
    # Otherwise the best scores at least eight frames apart.  Three kept rows rule
    # out at most 45 frames, so the first 49 by score always hold the answer.
    top = Window.partitionBy("video_id").orderBy(F.col("score").desc(), "frame_idx")
    pool = scored.withColumn("_r", F.row_number().over(top)).filter(F.col("_r") <= 49)
    greedy = pool.groupBy("video_id").agg(
        F.array_sort(F.collect_list(F.struct("_r", F.col("frame_idx").alias("f"), "c"))).alias("_pool")
    ).select(
        "video_id",
        F.aggregate(
            "_pool", F.slice("_pool", 1, 0),
            lambda kept, x: F.when(
                (F.size(kept) >= 4) | F.exists(kept, lambda k: F.abs(k.f - x.f) < MIN_GAP), kept
            ).otherwise(F.concat(kept, F.array(x))),
        ).alias("_g"),
    )
    joined = greedy.join(best, "video_id", "left")
    return joined.select(
        "video_id", F.array_sort(F.coalesce("_chain", F.transform("_g", lambda g: g["c"]))).alias("hops")
    )


def select_contacts(contacts: DataFrame, ends: DataFrame) -> DataFrame:
    """One row per video: ``selected``, the hops and the landing in frame order."""
    landing = cut_lineage(pick_landing(contacts))
    hops = pick_hops(contacts, landing, ends)
    fields = ("frame_idx", "timestamp_s", "position_s", "confidence", "prominence", "pose_sim", "landing_sim", "fused_score")

    def named(c, unknown):
        return F.struct(
            *[c[k].alias(k) for k in fields],
            F.when(c["surface"] == "unknown", unknown).otherwise(c["surface"]).alias("surface"),
        )

    return landing.join(hops, "video_id", "left").select(
        "video_id", "last_f",
        F.concat(
            F.coalesce(F.transform("hops", lambda c: named(c, "track")), F.array()),
            F.array(named(F.col("landing"), "sand")),
        ).alias("selected"),
    )


def refine_contacts(
    selected: DataFrame, posed_frames: DataFrame, prototypes: DataFrame,
    templates: DataFrame | None = None,
) -> DataFrame:
    """Move each selected contact to the best pose nearby (3 frames, landing 6).

    The moves are kept only when no two contacts end up on the same frame.
    """
    n = F.size("selected")
    items = selected.select("video_id", n.alias("_n"), *(["athlete_id"] if "athlete_id" in selected.columns else []),
                            F.posexplode("selected").alias("pos", "c"))
    land = (F.col("c.surface") == "sand") | (F.col("pos") == F.col("_n") - 1)
    items = items.withColumns({"_land": land, "_f": F.col("c.frame_idx")})
    radius = F.when(F.col("_land"), 6).otherwise(3)
    tries = items.select(
        "video_id", "pos", "_land", "_f", *(["athlete_id"] if "athlete_id" in items.columns else []),
        F.explode(F.sequence(F.greatest(F.lit(0), F.col("_f") - radius), F.col("_f") + radius)).alias("frame_idx"),
    )
    seen = tries.join(
        posed_frames.filter("person_detected AND pose.valid").select("video_id", "frame_idx", "timestamp_s", "pose"),
        ["video_id", "frame_idx"],
    )
    seen = with_templates(with_sheet(seen, prototypes), templates)
    vec, q = F.col("pose.vector"), F.col("pose.quality")
    landing = 0.45 * tag_score(vec, "landing") + 0.30 * F.col("pose.landing_score") + 0.25 * phase_score(
        vec, q, "landing", F.col("_own")["landing"])
    hop = 0.50 * tag_score(vec, "hop_contact") + 0.30 * F.col("pose.hop_contact_score") + 0.20 * phase_score(
        vec, q, "hop_1", F.col("_own")["hop_1"])
    scored = seen.select(
        "video_id", "pos", "frame_idx", "timestamp_s", F.when(F.col("_land"), landing).otherwise(hop).alias("s"),
        F.round(0.7 * tag_score(vec, "hop_contact") + 0.3 * F.col("pose.hop_contact_score"), 3).alias("pose_sim"),
        F.round(0.7 * tag_score(vec, "landing") + 0.3 * F.col("pose.landing_score"), 3).alias("landing_sim"),
    )
    best = scored.groupBy("video_id", "pos").agg(
        F.max_by(F.struct("frame_idx", "timestamp_s", "pose_sim", "landing_sim"), F.struct("s", -F.col("frame_idx"))).alias("b")
    )
    moved = items.join(best, ["video_id", "pos"], "left").groupBy("video_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "c", "b"))).alias("m")
    )

    def target(m):
        return F.coalesce(m["b"]["frame_idx"], m["c"]["frame_idx"])

    # In order: the better frame unless taken, else the old one unless taken.
    placed = F.aggregate(
        "m",
        F.array().cast("array<int>"),
        lambda acc, m: F.when(~F.array_contains(acc, target(m)), F.concat(acc, F.array(target(m))))
        .when(~F.array_contains(acc, m["c"]["frame_idx"]), F.concat(acc, F.array(m["c"]["frame_idx"])))
        .otherwise(acc),
    )
    moved = P.bind(moved, {"_to": F.array_sort(placed)})

    def rebuilt(m, i):
        to = F.get("_to", i)
        hit = F.get(F.filter("m", lambda x: x["b"]["frame_idx"] == to), F.lit(0))["b"]
        same = F.get(F.filter("m", lambda x: x["c"]["frame_idx"] == to), F.lit(0))["c"]
        c = m["c"]
        return F.struct(
            to.alias("frame_idx"),
            F.coalesce(hit["timestamp_s"], same["timestamp_s"], c["timestamp_s"]).alias("timestamp_s"),
            *[c[k].alias(k) for k in ("position_s", "confidence", "prominence")],
            F.coalesce(hit["pose_sim"], same["pose_sim"], c["pose_sim"]).alias("pose_sim"),
            F.coalesce(hit["landing_sim"], same["landing_sim"], c["landing_sim"]).alias("landing_sim"),
            c["fused_score"].alias("fused_score"), c["surface"].alias("surface"),
        )

    full = F.size("_to") == F.size("m")
    out = moved.select(
        "video_id",
        F.when(full, F.transform("m", rebuilt)).otherwise(F.transform("m", lambda m: m["c"])).alias("selected"),
    )
    return selected.drop("selected").join(out, "video_id")


# ------------------------------------------------------------ documents

def serialise_contacts(selected: DataFrame) -> DataFrame:
    """Selected contacts as rows: index, type, phase, rounded numbers."""
    c = F.slice("selected", 1, 5)
    n = F.size("selected")

    def is_land(x, i):
        return (x["surface"] == "sand") | ((i == n - 1) & (n >= 4))

    def row(x, i):
        before = F.size(F.filter(F.slice(c, 1, i + 1), lambda y: ~(y["surface"] == "sand")))
        land = is_land(x, i)
        return F.struct(
            (i + 1).alias("index"), x["frame_idx"].alias("frame_idx"), F.round(x["timestamp_s"], 3).alias("timestamp_s"),
            F.when(land, "landing").otherwise("hop").alias("type"), x["surface"].alias("surface"),
            F.when(land, F.lit("landing")).otherwise(F.concat(F.lit("hop_"), before.cast("string"))).alias("phase"),
            F.round(x["position_s"], 2).alias("position_s"), x["confidence"].alias("confidence"),
        )

    return selected.select("video_id", F.inline(F.transform(c, row)))


def phase_rows(bounds: dict[str, tuple[Column, Column]]) -> Column:
    """ARRAY of the seven phases; absent ones keep null bounds."""
    none = F.lit(None).cast("int")
    return F.array(
        *[
            F.struct(
                F.lit(p).alias("phase"), bounds.get(p, (none, none))[0].cast("int").alias("start_frame"),
                bounds.get(p, (none, none))[1].cast("int").alias("end_frame"),
            )
            for p in PHASES
        ]
    )


def phases_from_contacts(selected: DataFrame, ends: DataFrame, last_frames: DataFrame) -> DataFrame:
    """Phase intervals from the selected contacts (frame order)."""
    rows = selected.select("video_id", "selected").join(ends, "video_id", "left").join(
        last_frames.select("video_id", "last_frame_idx"), "video_id", "left"
    )
    s, n, last = F.col("selected"), F.size("selected"), F.col("last_frame_idx")
    tail = F.try_element_at(s, F.lit(-1))
    front = F.slice(s, 1, F.greatest(n - 1, F.lit(0)))
    firm = F.filter(front, lambda c: c["surface"] != "sand")
    hops = F.slice(F.when(F.size(firm) > 0, firm).otherwise(front), 1, 4)
    sand = F.get(F.filter(s, lambda c: c["surface"] == "sand"), F.lit(0))
    land = F.when((tail["surface"] == "sand") | (n >= 4), tail).otherwise(sand)
    rows = P.bind(rows, {"_h": F.transform(hops, lambda c: c["frame_idx"]), "_l": land["frame_idx"]})
    h, land_f, k = F.col("_h"), F.col("_l"), F.size("_h")
    bounds = {"approach": (F.lit(0), F.col("approach_end"))}
    for i, p in enumerate(HOPS):
        begin = F.get(h, F.lit(i))
        stop = F.coalesce(F.get(h, F.lit(i + 1)) - 1, land_f - 1, last)
        bounds[p] = (begin, F.when(begin.isNotNull(), F.greatest(begin, stop)))
    last_hop = F.try_element_at(h, F.lit(-1))
    fly = F.when(
        land_f.isNotNull(), F.when(k > 0, last_hop + 1).otherwise(F.col("approach_end") + 1)
    ).otherwise(last_hop)
    fly_end = F.when(land_f.isNotNull(), F.greatest(fly, land_f - 1)).otherwise(F.when(k > 0, last))
    bounds["final_jump"] = (fly, fly_end)
    bounds["landing"] = (land_f, F.when(land_f.isNotNull(), last))
    return rows.select("video_id", F.inline(phase_rows(bounds)))


def _marker_sheet(markers: DataFrame) -> DataFrame:
    """Per video: hop markers in frame order and the first landing, final, approach."""
    item = F.struct("frame_idx", "phase", "timestamp_s", "source", "confidence")

    def first(p):
        return F.min_by(item, F.when(F.col("phase") == p, F.col("frame_idx")))

    return markers.groupBy("video_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("phase").isin(*HOPS), item))).alias("_hops"),  # one per phase
        first("landing").alias("_land"), first("final_jump").alias("_final"), first("approach").alias("_appr"),
    )


def phases_from_markers(markers: DataFrame, last_frames: DataFrame) -> DataFrame:
    """Phase intervals from markers (at most one marker per phase and video)."""
    rows = _marker_sheet(markers).join(last_frames.select("video_id", "last_frame_idx"), "video_id", "left")
    h, last = F.col("_hops"), F.col("last_frame_idx")
    land, final, appr = (F.col(f"{c}.frame_idx") for c in ("_land", "_final", "_appr"))
    first_hop = F.get(h, F.lit(0))["frame_idx"]
    some = first_hop.isNotNull() | appr.isNotNull()
    run_up = F.when(first_hop.isNotNull(), F.greatest(F.lit(0), first_hop - 1)).otherwise(appr)
    bounds = {"approach": (F.when(some, 0), run_up)}
    numbered = F.transform(h, lambda m, i: F.struct(m.alias("m"), i.alias("i")))

    def marker_of(phase):
        return F.get(F.filter(numbered, lambda e: e["m"]["phase"] == phase), F.lit(0))

    for p in HOPS:
        mine = marker_of(p)
        begin = mine["m"]["frame_idx"]
        nxt = F.get(h, mine["i"] + 1)["frame_idx"]
        stop = F.coalesce(nxt - 1, final - 1, land - 1, last)
        bounds[p] = (begin, F.when(begin.isNotNull(), F.greatest(begin, stop)))
    last_hop = F.try_element_at(h, F.lit(-1))["frame_idx"]
    fly_end = F.when(final.isNotNull(), F.greatest(final, F.coalesce(land - 1, last))).otherwise(
        F.when(last_hop.isNotNull(), land - 1)
    )
    bounds["final_jump"] = (F.coalesce(final, F.when(land.isNotNull(), last_hop + 1)), fly_end)
    bounds["landing"] = (land, F.when(land.isNotNull(), last))
    return rows.select("video_id", F.inline(phase_rows(bounds)))


def contacts_from_markers(markers: DataFrame, frames: DataFrame) -> DataFrame:
    """Contacts of marked videos: the hop markers in order, then the landing."""
    sheet = _marker_sheet(markers)
    hops = F.transform(
        F.slice("_hops", 1, 4),
        lambda m, i: F.struct((i + 1).alias("index"), F.lit("hop").alias("type"), F.lit("track").alias("surface"), m.alias("m")),
    )
    land = F.when(
        F.col("_land").isNotNull(),
        F.array(
            F.struct(
                (F.size(F.slice("_hops", 1, 4)) + 1).alias("index"), F.lit("landing").alias("type"),
                F.lit("sand").alias("surface"), F.col("_land").alias("m"),
            )
        ),
    ).otherwise(F.slice(hops, 1, 0))
    rows = sheet.select("video_id", F.inline(F.concat(hops, land))).select(
        "video_id", "index", "type", "surface", F.col("m.frame_idx").alias("frame_idx"), F.col("m.phase").alias("phase"),
        F.col("m.timestamp_s").alias("_t"), F.col("m.source").alias("source"), F.col("m.confidence").alias("confidence"),
    )
    at = frames.select("video_id", "frame_idx", F.col("timestamp_s").alias("_ft"))
    return rows.join(at, ["video_id", "frame_idx"], "left").select(
        "video_id", "index", "frame_idx", F.round(F.coalesce("_ft", "_t", F.lit(0.0)), 3).alias("timestamp_s"),
        "type", "surface", "phase", F.coalesce("confidence", F.lit(1.0)).alias("confidence"),
        F.coalesce("source", F.lit("manual")).alias("source"),
    )


def marker_scores(markers: DataFrame) -> DataFrame:
    """Confidence of the sections that are rebuilt from markers: it grows with the contacts, up to five."""
    sheet = _marker_sheet(markers)
    n = F.least(F.size("_hops"), F.lit(4)) + F.col("_land").isNotNull().cast("int")
    return sheet.select("video_id", n.alias("n_contacts"), S.marker_confidence(n).alias("confidence"))


def section_scores(contacts: DataFrame, usable: DataFrame) -> DataFrame:
    """Overall confidence of each video's sections."""
    per = contacts.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("n_contacts"), F.avg(F.coalesce("confidence", F.lit(0.5))).alias("_c")
    )
    out = usable.join(per, "video_id", "left")
    n = F.coalesce("n_contacts", F.lit(0))
    return out.select(
        "video_id", n.alias("n_contacts"),
        F.when(n > 0, S.section_confidence(n, F.col("_c"), F.col("usable_ratio"))).otherwise(0.0).alias("confidence"),
    )


def analyze_sections(
    frames: DataFrame, prototypes: DataFrame, markers: DataFrame | None = None, spans: DataFrame | None = None,
    mask_frames: DataFrame | None = None, keyframes: DataFrame | None = None, templates: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Contacts, phases, markers and confidence of all videos.

    Videos with two or more manual or propagated markers are rebuilt from those;
    the others go through detection, selection and refinement.
    """
    from .frames import usable_ratio

    usable = cut_lineage(usable_ratio(frames))
    last = usable.select("video_id", "last_frame_idx")
    auto_frames, manual = frames, None
    if markers is not None:
        firm = markers.filter(F.col("source").isin("manual", "propagated")).groupBy("video_id").agg(
            F.count(F.lit(1)).alias("_m")
        ).filter(F.col("_m") >= 2).select("video_id")
        manual = markers.join(firm, "video_id", "left_semi")
        auto_frames = frames.join(firm, "video_id", "left_anti")
    found = cut_lineage(detect_contacts(auto_frames, prototypes, spans, mask_frames, keyframes))
    ends = cut_lineage(approach_end(found))
    chosen = select_contacts(found, ends)
    if "athlete_id" in frames.columns:
        chosen = chosen.join(frames.groupBy("video_id").agg(F.max("athlete_id").alias("athlete_id")), "video_id", "left")
    chosen = cut_lineage(refine_contacts(chosen, auto_frames, prototypes, templates))
    contacts = serialise_contacts(chosen)
    phases = phases_from_contacts(chosen, ends, last)
    auto = contacts.select(
        "video_id", "frame_idx", "phase", "timestamp_s", F.lit(None).cast("string").alias("pose_tag"),
        F.lit("auto").alias("source"), "confidence",
    )
    if manual is not None:
        contacts = contacts.withColumn("source", F.lit("auto")).unionByName(
            contacts_from_markers(manual, frames), allowMissingColumns=True
        )
        phases = phases.unionByName(phases_from_markers(manual, last))
        from .joins import new_markers_only

        auto = new_markers_only(auto, markers)
    return {
        "contacts": contacts, "phases": phases, "markers": auto, "scores": section_scores(contacts, usable),
    }


# ------------------------------------------------------------ propagation

def propagate_hops(
    posed_frames: DataFrame, markers: DataFrame, prototypes: DataFrame, templates: DataFrame | None = None
) -> DataFrame:
    """Hop markers found backwards from a landing or final-jump marker.

    Each hop is searched 10 to 45 frames before the previous one; a manual hop
    is taken over as the next starting point.  Returns the new markers.
    """
    landing = F.max(F.when(F.col("phase") == "landing", F.col("frame_idx")))
    final = F.max(F.when(F.col("phase") == "final_jump", F.col("frame_idx")))
    first_final = F.min(F.when(F.col("phase") == "final_jump", F.col("frame_idx")))
    manual = {
        h: F.max(F.when((F.col("phase") == h) & (F.col("source") == "manual"), F.col("frame_idx"))) for h in HOPS
    }
    state = markers.groupBy("video_id").agg(
        F.when(landing.isNotNull(), F.coalesce(first_final, landing - 5)).otherwise(final).alias("_at"),
        *[c.alias(f"_m_{h}") for h, c in manual.items()],
    ).filter(F.col("_at").isNotNull())
    seen = posed_frames.filter("person_detected AND pose.valid").join(
        state.select("video_id"), "video_id", "left_semi"
    )
    if "athlete_id" not in seen.columns:
        templates = None
    seen = with_templates(with_sheet(seen, prototypes), templates)
    vec, q = F.col("pose.vector"), F.col("pose.quality")
    base = phase_score(vec, q, "hop_1", F.col("_own")["hop_1"])
    scores = cut_lineage(
        seen.select(
            "video_id", "frame_idx", "timestamp_s",
            *[
                (0.45 * phase_score(vec, q, h, F.col("_own")[h]) + 0.35 * base + 0.2 * F.col("pose.hop_contact_score")).alias(h)
                for h in HOPS
            ],
        )
    )
    found = None
    for h in reversed(HOPS):
        # At most 35 candidate frames per video: written out, matched on the frame key.
        tries = state.filter(F.col(f"_m_{h}").isNull()).select(
            "video_id", F.explode(F.sequence(F.col("_at") - SEARCH_WINDOW, F.col("_at") - SEARCH_GAP - 1)).alias("frame_idx")
        )
        best = tries.join(scores, ["video_id", "frame_idx"]).groupBy("video_id").agg(
            F.max(F.struct(F.col(h).alias("s"), F.col("frame_idx").alias("f"), F.col("timestamp_s").alias("t"))).alias("_b")
        ).filter(F.col("_b.s") >= 0.25)
        new = best.select(
            "video_id", F.col("_b.f").alias("frame_idx"), F.lit(h).alias("phase"), F.round("_b.t", 3).alias("timestamp_s"),
            F.lit("hop_contact").alias("pose_tag"), F.lit("propagated").alias("source"), F.round("_b.s", 3).alias("confidence"),
        )
        new = cut_lineage(new)
        found = new if found is None else found.unionByName(new)
        state = state.join(new.select("video_id", F.col("frame_idx").alias("_n")), "video_id", "left").withColumn(
            "_at", F.coalesce(F.col(f"_m_{h}"), F.col("_n"), F.col("_at"))
        ).drop("_n")
    return found


def replace_propagated(markers: DataFrame, new: DataFrame) -> DataFrame:
    """Markers with the old propagated hops replaced by ``new``; manual ones stay."""
    kept = markers.filter(~((F.col("source") == "propagated") & F.col("phase").isin(*HOPS)))
    manual = markers.filter(F.col("source") == "manual").select("video_id", "frame_idx", "phase")
    fresh = new.join(manual, ["video_id", "frame_idx", "phase"], "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)

