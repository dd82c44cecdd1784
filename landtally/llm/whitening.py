"""Whitening of vectors by the exact characteristic polynomial of their scatter.

Components are scaled to integers, so the scatter of the distinct vectors is an integer matrix without rounding. Its
characteristic polynomial is found modulo many primes, in tasks, and put together by Chinese remainders. A scatter has only real
roots, so sign changes of the shifted polynomial count the roots above a point exactly, and bisection isolates
them to any precision. A component is the null vector at its root, by inverse iteration in fixed point. What reaches the driver
is bounded by the square of the number of dimensions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from landtally.llm.store import stored

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: Bits of a root beyond the trace's own, and of the fixed point that solves for its vector.
ROOT_BITS, POINT_BITS = 160, 512
#: Sums come from the tasks in limbs of 32 bits.
_LIMBS, _BASE = 8, 32


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x): floor(64 c) + 1,000,000 of each component, of vectors without NULL and non-finite components.

    A component whose integer does not fit a long counts as non-finite. Empty vectors are left out, and so are those of another length
    than the commonest, of equally common ones the greater.
    """
    c = F.transform(vector_col, lambda v: v.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), c.alias("c"))
    rows = rows.filter(F.col("c").isNotNull() & ~F.exists("c", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) >= 2.0 ** 56)))
    rows = stored(rows.select("vec_id", F.transform("c", lambda v: F.floor(v * SCALE) + OFFSET).alias("x")), "scaled")
    size = F.size("x").alias("size")
    common = rows.groupBy(size).count().filter("size > 0").orderBy(F.desc("count"), F.desc("size")).first()
    return rows.filter(F.size("x") == (common["size"] if common else 1))


def _matrices(batches, rows: int = 4096) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Pieces of the batches with their vectors, less the offset, as a matrix."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            piece = batch.slice(at, rows)
            x = piece.column(piece.num_columns - 1)
            yield piece, x.flatten().to_numpy().reshape(piece.num_rows, -1) - OFFSET


def _gram(y: np.ndarray) -> np.ndarray:
    """y' y without rounding, as Python integers: parts of 20 bits keep the products of 4,096 rows below 2^53."""
    parts = [y]
    while np.abs(parts[-1]).max(initial=0) >= 1 << 20:
        top = parts.pop()
        parts += [top & ((1 << 20) - 1), top >> 20]
    total = np.zeros((y.shape[1], y.shape[1]), object)
    for i, a in enumerate(parts):
        for j, b in enumerate(parts):
            total += (a.T.astype(np.float64) @ b.astype(np.float64)).astype(np.int64).astype(object) << (20 * (i + j))
    return total


def scatter(fit: DataFrame) -> tuple[int, list[int], list[list[int]]]:
    """(n, sums, M) of a table of distinct vectors ``x``, less the offset: M = n Σ y y' − s s', n² times the covariance."""
    def partial(batches):
        n, gram, sums = 0, 0, 0
        for piece, y in _matrices(batches):
            n, gram, sums = n + len(y), gram + _gram(y), sums + y.astype(object).sum(axis=0)
        if not n:
            return
        d = len(sums)
        cells = [(-1, -1, n), *[(-1, j, sums[j]) for j in range(d)], *[(i, j, gram[i, j]) for i in range(d) for j in range(i, d)]]
        mask = (1 << _BASE) - 1
        limbs = [[(int(v) >> (_BASE * k)) & mask if k < _LIMBS - 1 else int(v) >> (_BASE * k) for _, _, v in cells] for k in range(_LIMBS)]
        yield pa.record_batch([pa.array([c[0] for c in cells], pa.int32()), pa.array([c[1] for c in cells], pa.int32()),
                               *[pa.array(x, pa.int64()) for x in limbs]], names=["i", "j", *[f"l{k}" for k in range(_LIMBS)]])

    names = [f"l{k}" for k in range(_LIMBS)]
    rows = fit.select("x").mapInArrow(partial, "i int, j int, " + ", ".join(f"{x} long" for x in names))
    cells = {(r["i"], r["j"]): sum(r[x] << (_BASE * k) for k, x in enumerate(names)) for r in rows.groupBy("i", "j").agg(
        *[F.sum(x).alias(x) for x in names]).collect()}
    n = cells.get((-1, -1), 0)
    d = sum(i == -1 and j >= 0 for i, j in cells)
    s = [cells[-1, j] for j in range(d)]
    return n, s, [[n * cells[min(i, j), max(i, j)] - s[i] * s[j] for j in range(d)] for i in range(d)]


def _primes() -> Iterator[int]:
    """Primes below 2^31, falling; four bases decide there."""
    for p in range((1 << 31) - 1, 2, -2):
        odd, twos = p - 1, 0
        while odd % 2 == 0:
            odd, twos = odd // 2, twos + 1
        for base in (2, 3, 5, 7):
            x = pow(base, odd, p)
            if x not in (1, p - 1) and not any((x := x * x % p) == p - 1 for _ in range(twos - 1)):
                break
        else:
            yield p


def polynomial_mod(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients, constant first, of det(t − matrix) modulo the prime ``p`` < 2^31."""
    h, d = matrix.copy(), len(matrix)
    for k in range(d - 2):
        found = np.flatnonzero(h[k + 1:, k])
        if not len(found):
            continue
        at = k + 1 + found[0]
        h[[at, k + 1]] = h[[k + 1, at]]
        h[:, [at, k + 1]] = h[:, [k + 1, at]]
        u = h[k + 2:, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2:] = (h[k + 2:] - u[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2:] * u % p).sum(axis=1)) % p
    # Leading minors of t − h from the first to the whole: each from all before it.
    minors = np.zeros((d + 1, d + 1), np.int64)
    minors[0, 0] = 1
    for k in range(d):
        factors, below = np.zeros(k + 1, np.int64), 1
        factors[k] = h[k, k]
        for i in range(k - 1, -1, -1):
            below = below * int(h[i + 1, i]) % p
            factors[i] = int(h[i, k]) * below % p
        minors[k + 1, 1:] = minors[k, :-1]
        minors[k + 1] = (minors[k + 1] - (factors[:, None] * minors[:k + 1] % p).sum(axis=0)) % p
    return minors[d]


def polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Coefficients, constant first, of det(t − matrix) of a positive semidefinite integer matrix.

    The k-th elementary symmetric mean of roots that are not negative is at most the k-th power of their mean, which bounds the coefficients
    and so the number of primes.
    """
    d, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    mean = trace // d + 1
    bound = max(math.comb(d, k) * mean ** k for k in range(d + 1))
    primes, product = [], 1
    for p in _primes():
        if product > 2 * bound:
            break
        primes.append(p)
        product *= p

    def run(pieces):
        for piece in pieces:
            yield pd.DataFrame({"p": piece["p"], "c": [polynomial_mod(np.array([[v % p for v in row] for row in matrix], np.int64), p).tolist()
                                                      for p in map(int, piece["p"])]})

    tasks = min(len(primes), spark.sparkContext.defaultParallelism)
    table = spark.createDataFrame([(p,) for p in primes], "p long").repartition(tasks).mapInPandas(run, "p long, c array<long>")
    whole, modulus = [0] * (d + 1), 1
    for row in table.collect():
        p = row["p"]
        back = pow(modulus, -1, p)
        whole = [v + modulus * ((r - v) * back % p) for v, r in zip(whole, row["c"])]
        modulus *= p
    return [v - modulus if v > modulus // 2 else v for v in whole]


def _above(poly: list[int], point: int, bits: int) -> int:
    """How many roots of a polynomial with real roots only, counted by multiplicity, are above point / 2^bits."""
    d = len(poly) - 1
    c = [v << (bits * (d - k)) for k, v in enumerate(poly)]
    for i in range(d):
        for j in range(d - 1, i - 1, -1):
            c[j] += point * c[j + 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _sign(poly: list[int], point: int, bits: int) -> int:
    value = 0
    for k, v in enumerate(reversed(poly)):
        value = value * point + (v << (bits * k))
    return (value > 0) - (value < 0)


def roots(poly: list[int], most: int) -> list[tuple[int, int]]:
    """The ``most`` largest positive roots, falling and as often as their multiplicity: (a, bits), the root being in (a, a + 1] / 2^bits.

    Bisection by counts until a root is alone in its interval, then by the polynomial's sign.
    """
    d = len(poly) - 1
    trace = -poly[d - 1] if d else 0
    bits = max(0, ROOT_BITS - trace.bit_length())
    counts: dict[tuple[int, int], int] = {}

    def above(a: int, at: int) -> int:
        if (a, at) not in counts:
            counts[a, at] = _above(poly, a, at)
        return counts[a, at]

    out = []
    for k in range(1, min(most, above(0, 0)) + 1):
        # More than k − 1 roots are above low / 2^at, fewer than k above high / 2^at.
        low, high, at = 0, trace + 1, 0
        while not (above(low, at) == k and above(high, at) == k - 1) and (high - low > 1 or at < bits):
            if high - low == 1:
                step = min(8, bits - at)
                low, high, at = low << step, high << step, at + step
            middle = (low + high) // 2
            low, high = (middle, high) if above(middle, at) >= k else (low, middle)
        low, high = low << (bits - at), high << (bits - at)
        if high - low > 1:
            over = _sign(poly, high, bits)
            if not over:  # the root is the upper end
                low = high - 1
            while high - low > 1:
                middle = (low + high) // 2
                low, high = (low, middle) if _sign(poly, middle, bits) in (0, over) else (middle, high)
        out.append((low, bits))
    return out


def null_vectors(matrix: list[list[int]], root: int, bits: int, times: int) -> np.ndarray:
    """``times`` orthogonal unit vectors of the matrix at its root, by inverse iteration in fixed point."""
    d = len(matrix)
    b = np.array(matrix, object) << POINT_BITS
    for i in range(d):
        b[i, i] -= root << (POINT_BITS - bits)
    right = np.array([[((i + 1) * (2654435761 + 40503 * t)) % 65521 - 32760 for t in range(times)] for i in range(d)], object) << POINT_BITS
    for k in range(d):
        at = k + int(np.argmax(np.abs(b[k:, k])))
        b[[k, at]], right[[k, at]] = b[[at, k]], right[[at, k]]
        if not b[k, k]:
            b[k, k] = 1
        factor = (b[k + 1:, k] << POINT_BITS) // b[k, k]
        b[k + 1:, k:] -= (factor[:, None] * b[k, k:]) >> POINT_BITS
        right[k + 1:] -= (factor[:, None] * right[k]) >> POINT_BITS
    x = np.zeros((d, times), object)
    for k in range(d - 1, -1, -1):
        x[k] = ((right[k] << POINT_BITS) - (b[k, k + 1:, None] * x[k + 1:]).sum(axis=0)) // b[k, k]
    out = []
    for t in range(times):
        v = x[:, t]
        for _ in range(2):
            for u in out:
                v = v - ((u * v).sum() * u >> (2 * POINT_BITS))
            norm = max(1, math.isqrt(int((v * v).sum())))
            v = (v << POINT_BITS) // norm
        out.append(v)
    return np.array([[float(Fraction(int(c), 1 << POINT_BITS)) for c in v] for v in out])


class Basis:
    """Means, components (as columns), their variances and shares of the whole variance, from a scatter."""

    def __init__(self, spark: SparkSession, n: int, sums: list[int], matrix: list[list[int]], most: int = COMPONENTS):
        common = math.gcd(*[v for row in matrix for v in row]) or 1
        small = [[v // common for v in row] for row in matrix]
        found = roots(polynomial(spark, small), most) if n else []
        trace = sum(small[i][i] for i in range(len(small)))
        clusters: dict[tuple[int, int], int] = {}
        for r in found:
            clusters[r] = clusters.get(r, 0) + 1

        def solve(pieces):
            for piece in pieces:
                for a, bits, times in zip(piece["a"], piece["bits"], piece["times"]):
                    yield pd.DataFrame({"a": a, "v": null_vectors(small, int(a), int(bits), int(times)).tolist()})

        vectors: dict[str, list] = {}
        if found:
            table = spark.createDataFrame([(str(a), b, t) for (a, b), t in clusters.items()], "a string, bits int, times int")
            for r in table.repartition(len(clusters)).mapInPandas(solve, "a string, v array<double>").collect():
                vectors.setdefault(r["a"], []).append(r["v"])
        self.n, self.sums = n, sums
        self.values = [float(Fraction(a * common, n * n << bits)) for a, bits in found]
        self.explained = [float(Fraction(a, trace << bits)) for a, bits in found]
        self.vectors = np.array([vectors[str(a)].pop() for a, _ in found]).reshape(len(found), len(sums)).T
        self.means = np.array([float(Fraction(s, n)) for s in sums])

    def whiten(self, y: np.ndarray) -> np.ndarray:
        return (y - self.means) @ self.vectors / np.sqrt(self.values)

    def deviation(self, y: np.ndarray) -> list[int | None]:
        """Σ (n y − s)² of each row; NULL where it does not fit a long."""
        most = self.n * int(np.abs(y).max(initial=0)) + max(map(abs, self.sums))
        kind = np.int64 if len(self.sums) * most * most < 1 << 63 else object
        total = ((y.astype(kind) * self.n - np.array(self.sums, kind)) ** 2).sum(axis=1)
        return [v if v < 1 << 63 else None for v in map(int, total)]


def identity_error(fit: DataFrame, basis: Basis) -> float:
    """Largest entry, without sign, of the covariance of the whitened fit list less the identity."""
    k = len(basis.values)

    def partial(batches):
        gram, sums = np.zeros((k, k)), np.zeros(k)
        for _, y in _matrices(batches):
            z = basis.whiten(y)
            gram, sums = gram + z.T @ z, sums + z.sum(axis=0)
        cells = [(-1, j, sums[j]) for j in range(k)] + [(i, j, gram[i, j]) for i in range(k) for j in range(k)]
        yield pa.record_batch([pa.array([c[m] for c in cells], t) for m, t in enumerate((pa.int32(), pa.int32(), pa.float64()))], names=["i", "j", "v"])

    cells = fit.select("x").mapInArrow(partial, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    at = {(r["i"], r["j"]): r["v"] / basis.n for r in cells.collect()}
    return max(abs(at[i, j] - at[-1, i] * at[-1, j] - (i == j)) for i in range(k) for j in range(k))


def whitened(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """A row per usable vector and component, up to ``most``: n, deviation, whitened, explained, identity_error.

    The fit list holds every distinct integer vector once. Components have positive variance: fewer than ``most`` where the vectors
    span less, and none, so no row, for an empty table or a single distinct vector. Equal variances have an arbitrary orthogonal basis, the
    same for all rows. Repeated rows and NULL ids are kept as they are; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    fit = stored(rows.select("x").distinct(), "fit")
    basis = Basis(spark, *scatter(fit), most)
    k = len(basis.values)
    schema = f"{id_col} long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not k:
        return spark.createDataFrame([], schema)
    error = identity_error(fit, basis)

    def project(batches):
        for piece, y in _matrices(batches):
            m = len(y)
            yield pa.record_batch([
                piece.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, basis.n)), pa.array(basis.deviation(y), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                pa.array(basis.whiten(y).ravel()), pa.array(np.tile(basis.explained, m)), pa.array(np.full(m * k, error))],
                names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, schema)
