"""Boxes, polygons and axes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def safe_div(num: Column, den: Column) -> Column:
    """``num / den``; null when either is null or the divisor is about zero."""
    return F.when(F.abs(den) >= 1e-12, num / den)


# ---------------------------------------------------------------- boxes
# A box is an ARRAY<DOUBLE> [x1, y1, x2, y2]; fewer values mean "no box".

def has_box(box: Column) -> Column:
    return F.coalesce(F.size(box) >= 4, F.lit(False))


def box_width(box: Column) -> Column:
    return box[2] - box[0]


def box_height(box: Column) -> Column:
    return box[3] - box[1]


def rect_area(box: Column) -> Column:
    return F.greatest(F.lit(0.0), box_width(box)) * F.greatest(F.lit(0.0), box_height(box))


def box_center(box: Column) -> Column:
    return F.when(
        has_box(box),
        F.struct(((box[0] + box[2]) * 0.5).alias("x"), ((box[1] + box[3]) * 0.5).alias("y")),
    )


def box_foot(box: Column) -> Column:
    """Bottom-centre of the box: where the feet are when no ankle is visible."""
    return F.when(
        has_box(box), F.struct(((box[0] + box[2]) * 0.5).alias("x"), box[3].alias("y"))
    )


def box_bottom_half(box: Column) -> Column:
    return F.when(
        has_box(box), F.array(box[0], box[1] + box_height(box) * 0.5, box[2], box[3])
    )


def box_iou(a: Column, b: Column) -> Column:
    """Overlap ratio; 0 when either box is missing or they do not touch."""
    width = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    height = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    shared = width * height
    union = rect_area(a) + rect_area(b) - shared
    return F.when(
        a.isNotNull() & b.isNotNull() & (shared > 0) & (union > 0), shared / union
    ).otherwise(F.lit(0.0))


def box_lerp(a: Column, b: Column, t: Column) -> Column:
    t = clamp(t, 0.0, 1.0)
    return F.array(*[a[i] + (b[i] - a[i]) * t for i in range(4)])


def box_grown(cx: Column, foot_y: Column, width: Column, height: Column) -> Column:
    """The box standing on ``(cx, foot_y)``."""
    return F.array(cx - width * 0.5, foot_y - height, cx + width * 0.5, foot_y)


# ---------------------------------------------------------------- axis
# STRUCT<ox, oy, dx, dy>: origin in 0-1 image units, direction of any length.

def project(x: Column, y: Column, axis: Column, width, height, eps: float) -> Column:
    """Signed distance of a point along the axis, in pixels."""
    norm = F.sqrt(axis.dx * axis.dx + axis.dy * axis.dy)
    along = (x - axis.ox * width) * (axis.dx / norm) + (y - axis.oy * height) * (axis.dy / norm)
    return F.when(norm > eps, along)


def project_box(box: Column, axis: Column, width, height) -> Column:
    return F.when(
        has_box(box), project((box[0] + box[2]) * 0.5, box[3], axis, width, height, 1e-6)
    )


def project_point(point: Column, axis: Column, width, height) -> Column:
    return project(point.x, point.y, axis, width, height, 1e-9)


def axis_lerp(a: Column, b: Column, t: Column) -> Column:
    return F.struct(
        *[(a[f] + t * (b[f] - a[f])).alias(f) for f in ("ox", "oy", "dx", "dy")]
    )


# ---------------------------------------------------------------- polygons
# ARRAY<STRUCT<x, y>>, not closed (the last vertex joins the first).

def _next_vertex(poly: Column) -> Column:
    return F.concat(F.slice(poly, 2, F.greatest(F.size(poly) - 1, F.lit(0))), F.slice(poly, 1, 1))


def polygon_area(poly: Column) -> Column:
    """Shoelace area; 0 below three vertices."""
    cross = F.zip_with(poly, _next_vertex(poly), lambda p, q: p.x * q.y - q.x * p.y)
    total = F.aggregate(cross, F.lit(0.0), lambda acc, v: acc + v)
    return F.when(F.size(poly) >= 3, F.abs(total) * 0.5).otherwise(F.lit(0.0))


def polygon_mean(poly: Column) -> Column:
    n = F.size(poly)
    return F.struct(
        (F.aggregate(poly, F.lit(0.0), lambda a, p: a + p.x) / n).alias("x"),
        (F.aggregate(poly, F.lit(0.0), lambda a, p: a + p.y) / n).alias("y"),
    )


def polygon_aspect(poly: Column) -> Column:
    """Long side over short side of the smallest rectangle around the polygon.

    That rectangle shares a direction with a hull edge.  Candidate directions
    are all vertex pairs (polygons here have a handful of vertices), which
    include every hull edge; the smallest area among them is the minimum.
    """
    pairs = F.flatten(
        F.transform(
            poly,
            lambda p: F.transform(
                poly, lambda q: F.struct((q.x - p.x).alias("dx"), (q.y - p.y).alias("dy"))
            ),
        )
    )

    def extent(ux, uy):
        along = F.transform(poly, lambda p: p.x * ux + p.y * uy)
        return F.array_max(along) - F.array_min(along)

    def rectangle(d):
        norm = F.sqrt(d.dx * d.dx + d.dy * d.dy)
        w, h = extent(d.dx / norm, d.dy / norm), extent(-d.dy / norm, d.dx / norm)
        return F.struct(
            # Around a triangle all edge rectangles are equally large: rounding makes
            # that a tie, which the shorter long side decides.
            F.round(w * h, 9).alias("area"), F.greatest(w, h).alias("long"), F.least(w, h).alias("short")
        )

    usable = F.filter(pairs, lambda d: (d.dx * d.dx + d.dy * d.dy) > 1e-18)
    best = F.array_min(F.transform(usable, rectangle))
    return F.when(F.size(poly) >= 3, safe_div(best["long"], best["short"]))


def polygon_lerp(a: Column, b: Column, t: Column) -> Column:
    """Vertex-wise blend; with different vertex counts the earlier one is kept."""
    blend = F.zip_with(
        a, b,
        lambda p, q: F.struct((p.x + t * (q.x - p.x)).alias("x"), (p.y + t * (q.y - p.y)).alias("y")),
    )
    n_a = F.coalesce(F.size(a), F.lit(0))
    n_b = F.coalesce(F.size(b), F.lit(0))
    return F.when((n_a == n_b) & (n_a > 0), blend).when(n_a > 0, a).otherwise(b)


def polygon_edges(poly: Column) -> Column:
    """ARRAY<STRUCT<px, py, qx, qy>>; bind it once before many point tests."""
    edges = F.zip_with(
        poly,
        _next_vertex(poly),
        lambda p, q: F.struct(p.x.alias("px"), p.y.alias("py"), q.x.alias("qx"), q.y.alias("qy")),
    )
    return F.when(F.size(poly) >= 3, edges)


def contains_point(edges: Column, x: Column, y: Column) -> Column:
    """Even-odd rule: whether a ray to the right crosses an odd number of edges."""
    return F.aggregate(
        edges,
        F.lit(False),
        lambda odd, e: odd
        != (
            ((e.py > y) != (e.qy > y))
            & (x < (e.qx - e.px) * (y - e.py) / (e.qy - e.py) + e.px)
        ),
    )


def box_polygon_share(half: Column, edges: Column) -> Column:
    """Exact share of a lower half box (see ``box_bottom_half``) inside a polygon, by the even-odd rule.

    Between two neighbouring heights at which an edge ends, meets another edge or meets a side of the box, the
    covered length changes evenly, so its value half-way times the height is the covered area.  Polygons may
    cross themselves.  Bind both arguments first: they are read many times.
    """
    x0, y0, x1, y1 = (F.get(half, F.lit(i)) for i in range(4))

    def on_side(x: Column) -> Column:
        reaching = F.filter(edges, lambda e: (e.px > x) != (e.qx > x))
        return F.transform(reaching, lambda e: e.py + (e.qy - e.py) * (x - e.px) / (e.qx - e.px))

    def with_others(e: Column) -> Column:
        """Heights at which an edge meets the lines of the others; heights too many do no harm."""
        def turn(o: Column) -> Column:
            return (e.qx - e.px) * (o.qy - o.py) - (e.qy - e.py) * (o.qx - o.px)

        def along(o: Column) -> Column:
            return ((o.px - e.px) * (o.qy - o.py) - (o.py - e.py) * (o.qx - o.px)) / turn(o)

        met = F.transform(F.filter(edges, lambda o: turn(o) != 0), along)
        return F.transform(F.filter(met, lambda t: (t > 0) & (t < 1)), lambda t: e.py + t * (e.qy - e.py))

    heights = F.concat(F.transform(edges, lambda e: e.py), on_side(x0), on_side(x1), F.flatten(F.transform(edges, with_others)))
    cuts = F.array_sort(F.concat(F.array(y0, y1), F.filter(heights, lambda y: (y > y0) & (y < y1))))

    def length(y: Column) -> Column:
        crossed = F.filter(edges, lambda e: (e.py > y) != (e.qy > y))
        at = F.array_sort(F.transform(crossed, lambda e: clamp(e.px + (e.qx - e.px) * (y - e.py) / (e.qy - e.py), x0, x1)))
        return F.aggregate(F.transform(at, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0.0), lambda a, x: a + x)

    slabs = F.zip_with(cuts, F.slice(cuts, 2, 1 << 20), lambda a, b: (b - a) * length((a + b) / 2))
    covered = F.aggregate(slabs, F.lit(0.0), lambda n, v: n + F.coalesce(v, F.lit(0.0)))
    return F.when((rect_area(half) > 0) & edges.isNotNull(), covered / rect_area(half)).otherwise(F.lit(0.0))


def scale_points(poly: Column, sx, sy) -> Column:
    """0-1 units to pixels."""
    return F.transform(poly, lambda p: F.struct((p.x * sx).alias("x"), (p.y * sy).alias("y")))


def normalise_points(poly: Column, width, height) -> Column:
    """Pixels to 0-1 units, clamped to the image."""
    return F.transform(
        poly,
        lambda p: F.struct(
            clamp(p.x / width, 0.0, 1.0).alias("x"), clamp(p.y / height, 0.0, 1.0).alias("y")
        ),
    )


def longest_edge_axis(poly: Column, width, height) -> Column:
    """Axis along the polygon's longest edge (the first one on ties)."""
    largest = F.array_max(F.transform(poly, lambda p: F.greatest(F.abs(p.x), F.abs(p.y))))
    in_pixels = largest > 1.5
    unit = F.transform(
        poly,
        lambda p: F.struct(
            F.when(in_pixels, p.x / width).otherwise(p.x).alias("x"),
            F.when(in_pixels, p.y / height).otherwise(p.y).alias("y"),
        ),
    )
    edges = F.transform(
        unit,
        lambda p, i: F.struct(
            F.hypot(
                F.get(_next_vertex(unit), i).x - p.x, F.get(_next_vertex(unit), i).y - p.y
            ).alias("len"),
            (-i).alias("rank"),
            p.x.alias("ox"),
            p.y.alias("oy"),
            (F.get(_next_vertex(unit), i).x - p.x).alias("dx"),
            (F.get(_next_vertex(unit), i).y - p.y).alias("dy"),
        ),
    )
    best = F.array_max(edges)
    return F.when(
        F.size(poly) >= 2,
        F.struct(best.ox.alias("ox"), best.oy.alias("oy"), best.dx.alias("dx"), best.dy.alias("dy")),
    )


def order_quad(poly: Column) -> Column:
    """Four corners as top-left, top-right, bottom-right, bottom-left."""

    def ranked(key):
        return F.transform(poly, lambda p: F.struct(key(p).alias("k"), p.x.alias("x"), p.y.alias("y")))

    def corner(entry):
        return F.struct(entry.x.alias("x"), entry.y.alias("y"))

    by_sum, by_diff = ranked(lambda p: p.x + p.y), ranked(lambda p: p.y - p.x)
    return F.when(
        F.size(poly) == 4,
        F.array(
            corner(F.array_min(by_sum)),
            corner(F.array_min(by_diff)),
            corner(F.array_max(by_sum)),
            corner(F.array_max(by_diff)),
        ),
    )


def corners_by_label(points: Column, labels: Column, wanted: tuple[str, ...]) -> Column:
    """Points whose labels are ``wanted``, in that order; null if one is missing."""
    picks = [F.get(points, F.array_position(labels, w).cast("int") - 1) for w in wanted]
    all_there = picks[0].isNotNull()
    for p in picks[1:]:
        all_there = all_there & p.isNotNull()
    for w in wanted:
        all_there = all_there & F.array_contains(labels, w)
    return F.when(all_there, F.array(*picks))
