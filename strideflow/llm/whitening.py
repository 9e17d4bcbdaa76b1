"""Whitening of embeddings by exact linear algebra: the characteristic polynomial of the integer scatter matrix."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from math import comb, gcd, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, store

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Components of a vector at most: the driver holds the matrix of their products, and a task reduces it.
DIMENSIONS = 1024
#: Quantised components are held within this, so that they are long at any float; it takes |c| above 10^16.
REACH = 1 << 60
#: Bits of a digit when exact sums are handed to Spark, of a root behind its first one, and of a component.
DIGIT, ROOT_BITS, WORK_BITS = 24, 160, 320
ROUNDS = 4


# ------------------------------------------------------------ exact sums

def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, y): floor(scale * c) of every component; vectors null or with null or non-finite components are left out."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda c: c.cast("double")).alias("v"))
    finite = F.forall("v", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    whole = F.transform("v", lambda c: F.greatest(F.lit(float(-REACH)), F.least(F.lit(float(REACH)), F.floor(c * scale).cast("double"))).cast("long"))
    return rows.filter(F.col("v").isNotNull() & finite).select("vec_id", whole.alias("y"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as an integer matrix; shorter vectors end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _products(rows: np.ndarray) -> np.ndarray:
    """rows.T @ rows exactly: in floats while every sum stays below 2^53, else in whole numbers of any size."""
    most = int(np.abs(rows).max(initial=0))
    if most * most * max(1, len(rows)) < 2**53:
        x = rows.astype(float)
        return (x.T @ x).astype(np.int64).astype(object)
    wide = rows.astype(object)
    return wide.T @ wide


def _totals(rows: np.ndarray) -> np.ndarray:
    """Exact sums of the columns."""
    safe = int(np.abs(rows).max(initial=0)) * len(rows) < 2**62
    return (rows if safe else rows.astype(object)).sum(axis=0).astype(object)


def sums(table: DataFrame, width: int) -> tuple[int, list[int], np.ndarray]:
    """Number of vectors, sums of the components, sums of their products; all exact.

    Tasks emit their sums in digits of 24 bits, one row a digit, and Spark adds the digits up.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first, n = np.zeros((width, width), object), np.zeros(width, object), 0
        for batch in batches:
            rows = _matrix(batch.column(0), width)
            total, first, n = total + _products(rows), first + _totals(rows), n + len(rows)
        places = [(-1, -1, n), *((i, -1, first[i]) for i in range(width)), *((i, j, total[i, j]) for i in range(width) for j in range(i, width))]
        out = [(i, j, k, d) for i, j, value in places for k, d in enumerate(_digits(int(value)))]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*out)], ["i", "j", "k", "digit"])

    parts = mapped(table.select("y"), add, "i long, j long, k long, digit long")
    n, first, total = 0, [0] * width, np.zeros((width, width), object)
    for i, j, k, digit in parts.groupBy("i", "j", "k").agg(F.sum("digit")).collect():  # a few numbers a pair of dimensions
        value = digit << (DIGIT * k)
        if i < 0:
            n += value
        elif j < 0:
            first[i] += value
        else:
            total[i, j] += value
    lower = np.tril_indices(width, -1)
    total[lower] = total.T[lower]
    return n, first, total


def _digits(value: int) -> list[int]:
    """Signed digits, lowest first."""
    sign, value, out = (-1 if value < 0 else 1), abs(value), []
    while value:
        out.append(sign * (value & ((1 << DIGIT) - 1)))
        value >>= DIGIT
    return out


# ------------------------------------------------------------ characteristic polynomial

def primes_below(top: int, count: int) -> list[int]:
    """The ``count`` largest primes below ``top`` (at most 2^31)."""
    sieve = np.ones(isqrt(top) + 1, bool)
    sieve[:2] = False
    for i in range(2, isqrt(len(sieve)) + 1):
        if sieve[i]:
            sieve[i * i :: i] = False
    small, out, at = np.flatnonzero(sieve), [], top - 1
    while len(out) < count:
        if (at % small).all():
            out.append(at)
        at -= 1
    return out


def polynomial_modulo(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients (constant first) of det(x - matrix) modulo a prime, over the Hessenberg form of the matrix."""
    h, d = matrix % p, len(matrix)
    for m in range(1, d - 1):
        found = np.flatnonzero(h[m:, m - 1])
        if not len(found):
            continue
        at = m + int(found[0])
        if at != m:
            h[[m, at]] = h[[at, m]]
            h[:, [m, at]] = h[:, [at, m]]
        u = h[m + 1 :, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1 :] = (h[m + 1 :] - u[:, None] * h[m][None, :] % p) % p
        h[:, m] = (h[:, m] + (h[:, m + 1 :] * u[None, :] % p).sum(axis=1)) % p
    known = np.zeros((d + 1, d + 1), np.int64)  # row k: polynomial of the leading k x k part
    known[0, 0] = 1
    for k in range(1, d + 1):
        row = (np.concatenate([[0], known[k - 1, :-1]]) - h[k - 1, k - 1] * known[k - 1]) % p
        below = 1
        for i in range(k - 1, 0, -1):
            below = below * int(h[i, i - 1]) % p
            if not below:
                break
            row = (row - below * int(h[i - 1, k - 1]) % p * known[i - 1]) % p
        known[k] = row
    return known[d]


def characteristic_polynomial(spark: SparkSession, matrix: np.ndarray) -> list[int]:
    """Exact coefficients (constant first) of det(x - matrix) for a whole-numbered positive semidefinite matrix.

    Each prime is a row that a task reduces; Chinese remaindering joins the residues.  As no eigenvalue is
    negative, coefficient k is at most comb(d, k) (trace / d)^k, which says how many primes are enough.
    """
    d, trace = len(matrix), int(np.trace(matrix))
    bound = max(comb(d, k) * (trace // d + 1) ** k for k in range(d + 1))
    primes = primes_below(1 << 31, (2 * bound).bit_length() // 30 + 1)
    entries = matrix.tolist()

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(p, polynomial_modulo(np.array([[x % p for x in row] for row in entries], np.int64), p).tolist()) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found]), pa.array([c for _, c in found], pa.list_(pa.int64()))], ["p", "c"])

    rows = spark.createDataFrame([(p,) for p in primes], "p long").repartition(min(len(primes), 64))
    values, modulus = [0] * (d + 1), 1
    for p, residues in sorted(mapped(rows, reduce, "p long, c array<long>").collect()):
        back = pow(modulus, -1, p)
        values = [v + modulus * ((r - v) * back % p) for v, r in zip(values, residues)]
        modulus *= p
    return [v - modulus if 2 * v > modulus else v for v in values]


# ------------------------------------------------------------ roots and components

def roots_above(coefficients: list[int], at: int) -> int:
    """How many roots are greater than ``at``, with multiplicity.

    All roots are real, so the sign changes of the polynomial moved by ``at`` count them exactly.
    """
    c = list(coefficients)
    if at:
        for i in range(len(c) - 1):
            for j in range(len(c) - 2, i - 1, -1):
                c[j] += at * c[j + 1]
    signs = [x > 0 for x in c if x]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _value(coefficients: list[int], at: int) -> int:
    out = 0
    for c in reversed(coefficients):
        out = out * at + c
    return out


def root(coefficients: list[int], k: int, top: int) -> tuple[int, int, int, int]:
    """The k-th greatest root, which is positive, as ``value`` / 2^``bits``; how many roots are greater, and its multiplicity.

    Halving by exact counts isolates the root; then the sign of the polynomial halves on.  Roots that differ by
    less than one part in 2^160 count as one of higher multiplicity.
    """
    d, bits = len(coefficients) - 1, 0
    low, high, over_low, over_high = 0, top + 1, roots_above(coefficients, 0), 0
    scaled, rising = coefficients, None
    while low.bit_length() <= ROOT_BITS:
        if high - low == 1:  # one more bit of the root: all roots double
            bits, low, high = bits + 1, low * 2, high * 2
            scaled = [c << (bits * (d - i)) for i, c in enumerate(coefficients)]
        middle = (low + high) // 2
        if over_low - over_high > 1:
            over = roots_above(scaled, middle)
            if over >= k:
                low, over_low = middle, over
            else:
                high, over_high = middle, over
            continue
        if rising is None:  # above its greatest root the polynomial is positive, and each root turns the sign
            rising = over_high % 2 == 0
        value = _value(scaled, middle)
        if value == 0 or (value > 0) == rising:
            high = middle
        else:
            low = middle
        if high - low == 1 and value == 0 and middle == high:
            bits, low = bits + ROOT_BITS, high << ROOT_BITS
            return low, bits, over_high, 1
    return low, bits, over_high, over_low - over_high


def null_space(matrix: list[list[int]], value: int, bits: int, size: int) -> np.ndarray:
    """``size`` orthonormal vectors that the matrix minus ``value`` / 2^``bits`` shrinks most: inverse iteration.

    Elimination runs in whole numbers with 320 bits behind the point, so close roots do not blur the vectors.
    """
    d, one = len(matrix), 1 << WORK_BITS
    most = max(abs(x) for row in matrix for x in row)
    unit = 1 << most.bit_length()
    a = np.array([[x * one // unit for x in row] for row in matrix], object)
    shift = (value * one // unit) >> bits
    for i in range(d):
        a[i, i] -= shift
    order, tiny = np.arange(d), 1 << 24
    for i in range(d):
        at = i + max(range(d - i), key=lambda r: abs(a[i + r, i]))
        if at != i:
            a[[i, at]] = a[[at, i]]
            order[[i, at]] = order[[at, i]]
        if abs(a[i, i]) < tiny:
            a[i, i] = tiny
        factors = (a[i + 1 :, i] << WORK_BITS) // a[i, i]
        a[i + 1 :, i] = factors
        a[i + 1 :, i + 1 :] -= (factors[:, None] * a[i, i + 1 :][None, :]) >> WORK_BITS
    draw = np.random.default_rng(d)
    found = [np.array([int(x) for x in draw.integers(-(1 << 30), 1 << 30, d)], object) << (WORK_BITS - 30) for _ in range(size)]
    for _ in range(ROUNDS):
        solved = []
        for x in found:
            x = x[order]
            for i in range(d):
                x[i + 1 :] -= (a[i + 1 :, i] * x[i]) >> WORK_BITS
            for i in range(d - 1, -1, -1):
                x[i] = (x[i] << WORK_BITS) // a[i, i]
                x[:i] -= (a[:i, i] * x[i]) >> WORK_BITS
            for other in solved:  # components of one value are made orthogonal
                x = x * one // max(1, int(max(abs(v) for v in x)))
                x -= (other * ((int(x @ other)) >> WORK_BITS)) >> WORK_BITS
            solved.append(_unit(x, one))
        found = solved
    out = np.array([[int(v) / one for v in x] for x in found])
    lead = np.abs(out).argmax(axis=1)
    return out * np.sign(out[np.arange(size), lead])[:, None]


def _unit(x: np.ndarray, one: int) -> np.ndarray:
    x = x * one // max(1, int(max(abs(v) for v in x)))
    return x * one // isqrt(int(x @ x))


@dataclass
class Whitening:
    """A fitted map: ``n`` vectors of ``width`` components with sums ``first``; row i of ``weights`` gives component i + 1."""

    n: int
    width: int
    first: list[int]
    weights: np.ndarray
    explained: list[float]


def fit(table: DataFrame, components: int = COMPONENTS) -> Whitening:
    """Principal components of quantised vectors (see :func:`quantised`) with the factors that make their variances one.

    The scatter matrix n sum(y y') - sum(y) sum(y)' is whole-numbered and n^2 times the covariance.  Its
    characteristic polynomial is computed exactly; tasks then isolate one root each, refine it and
    take the component from the null space.  Components of variance zero cannot be scaled and are left out.
    """
    spark = table.sparkSession
    width = table.agg(F.max(F.size("y"))).first()[0] or 0
    if width > DIMENSIONS:
        raise ValueError(f"vectors of {width} components: at most {DIMENSIONS} are supported")
    n, first, total = sums(table, width) if width else (0, [], np.zeros((0, 0), object))
    scatter = total * n - np.outer(np.array(first, object), np.array(first, object)) if width else total
    trace = int(np.trace(scatter)) if width else 0
    if not trace:
        return Whitening(n, width, first, np.zeros((0, width)), [])
    common = gcd(*(int(x) for x in scatter.flat))
    matrix = scatter // common
    coefficients, top = characteristic_polynomial(spark, matrix), trace // common
    rank, entries = roots_above(coefficients, 0), matrix.tolist()

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for k in batch.column(0).to_pylist():
                value, bits, before, size = root(coefficients, k, top)
                vector = null_space(entries, value, bits, size)[k - before - 1]
                # the variance of (n y - sum y) along the vector is the root of the scatter matrix over n
                spread = float(Decimal(value * common) / Decimal(1 << bits)) ** 0.5
                made.append((k, (vector / spread).tolist(), float(Decimal(value) / Decimal(top << bits))))
            yield pa.RecordBatch.from_arrays(
                [pa.array([m[0] for m in made]), pa.array([m[1] for m in made], pa.list_(pa.float64())), pa.array([m[2] for m in made])], ["k", "w", "share"]
            )

    wanted = min(components, rank)
    rows = spark.createDataFrame([(k,) for k in range(1, wanted + 1)], "k long").repartition(wanted)
    solved = sorted(mapped(rows, solve, "k long, w array<double>, share double").collect())
    # (n y - sum) . vector / sqrt(root of the scatter matrix) has variance 1: the root is n^2 times that of the covariance
    return Whitening(n, width, first, np.array([w for _, w, _ in solved]), [s for _, _, s in solved])


def transform(table: DataFrame, map_: Whitening) -> DataFrame:
    """``vec_id``, ``deviation`` (decimal; null beyond 38 digits) and ``whitened`` (one number a component) of every vector."""
    n, width, weights = map_.n, map_.width, map_.weights
    first = np.array(map_.first, object)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _matrix(batch.column(1), width)
            reach = int(np.abs(rows).max(initial=0)) * n + int(max(map(abs, map_.first), default=0))
            if width * reach * reach < 2**63:
                centred = rows * n - first.astype(np.int64)
                away = pa.array((centred * centred).sum(axis=1).tolist(), pa.int64()).cast(pa.decimal128(38, 0))
            else:
                centred = rows.astype(object) * n - first
                squares = (centred * centred).sum(axis=1)
                away = pa.array([Decimal(int(s)) if s < 10**38 else None for s in squares], pa.decimal128(38, 0))
            z = centred.astype(float) @ weights.T
            edges = np.arange(0, z.size + 1, max(1, z.shape[1]), dtype=np.int32) if z.shape[1] else np.zeros(len(rows) + 1, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), away, pa.ListArray.from_arrays(pa.array(edges), pa.array(z.reshape(-1)))], ["vec_id", "deviation", "whitened"])

    return mapped(table.select("vec_id", "y"), project, "vec_id long, deviation decimal(38,0), whitened array<double>")


def identity_error(whitened: DataFrame, n: int, components: int) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity; tasks add up their own products."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first = np.zeros((components, components)), np.zeros(components)
        for batch in batches:
            z = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, components)
            total, first = total + z.T @ z, first + z.sum(axis=0)
        i, j = np.triu_indices(components)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([i, np.arange(components)])), pa.array(np.concatenate([j, np.full(components, -1)])), pa.array(np.concatenate([total[i, j], first]))], ["i", "j", "x"]
        )

    added = mapped(whitened.select("whitened"), add, "i long, j long, x double").groupBy("i", "j").agg(F.sum("x")).collect()
    cells = {(i, j): x / n for i, j, x in added}
    # the vectors are centred before they are multiplied; what rounding leaves of their mean is taken off as well
    return max(abs(x - cells[i, -1] * cells[j, -1] - (i == j)) for (i, j), x in cells.items() if j >= 0)


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """Principal components of all vectors, scaled to variance one.

    ``vectors``: vec_id, embedding.  Every component c becomes floor(``scale`` * c), as double; the contract's
    further shift changes no result.  One row per vector and component: ``vec_id``, ``component`` (from 1 by
    falling variance), ``n`` (vectors), ``deviation`` (squared distance from the mean, times n^2, exact;
    decimal(38,0), null beyond), ``whitened``, ``explained`` (share of all variance) and ``identity_error``
    (largest entry of the whitened covariance minus the identity).

    Vectors that are null or hold null, NaN or infinite components are left out.  Shorter vectors count as
    padded with zeros.  Components beyond 2^60 after scaling are held at that limit.  Equal rows, repeated and
    null ids are vectors of their own.  Components without variance are not returned, so one vector, equal
    vectors and empty tables give no rows; equal variances share a space and get any orthonormal basis of it.
    Up to 1024 dimensions, as work grows with their cube a prime and a component; more raise ``ValueError``.  Other columns are not read.
    """
    table = store(quantised(vectors, scale), "whitening-rows")
    map_ = fit(table, components)
    kinds = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if not map_.explained:
        return vectors.sparkSession.createDataFrame([], kinds)
    rows = transform(table, map_)
    error = identity_error(rows, map_.n, len(map_.explained))
    shares = F.array(*[F.lit(x) for x in map_.explained])
    long = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("_at", "whitened"))
    return long.select(
        "vec_id", (F.col("_at") + 1).cast("int").alias("component"), F.lit(map_.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("_at")).alias("explained"), F.lit(error).alias("identity_error"),
    )
