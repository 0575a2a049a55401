"""Whitening of embeddings on leading components that spectrum slicing finds.

Entries become integers (floor of 256 times the entry). The fit list holds
each distinct integer vector once. Its moments are exact: tasks shift vectors
by the rounded mean, multiply blocks whose products doubles hold exactly, and
hand on integers; what the rounding of the mean left is taken off in exact
arithmetic. The covariance is therefore the same however rows are dealt.

Eigenvalues are isolated on the driver by slicing the spectrum: the LDL^T
factors of the covariance less a shift have as many positive pivots as there
are eigenvalues above the shift (Sylvester's law of inertia). Halving by that
count gives each leading eigenvalue an interval of its own, Rayleigh quotient
iteration goes on from there with cubic convergence, and counts on both sides
of the result certify its number. Only d x d matrices reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import bounded_batches, discard, written

SCALE = 256
#: Integer entries beyond this count as non-finite: their vectors are dropped.
LARGEST = 1 << 40
#: Rows of a block of products; entries below 2^20 then have sums of products below 2^52.
BLOCK, LIMB = 4096, 20
EPS = float(np.finfo(float).eps)


@dataclass
class Component:
    value: float
    vector: np.ndarray
    #: Bounds that hold this eigenvalue, and eigenvalues above each, by inertia.
    low: float
    high: float
    above_low: int
    above_high: int


@dataclass
class Whitening:
    n: int
    sums: list[int]
    trace: float
    components: list[Component]

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums]) if self.n else np.zeros(0)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates (rows x components) of integer vectors; NaN for a component without variance."""
        basis = np.stack([c.vector for c in self.components], axis=1)
        e = np.array([c.value for c in self.components])
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(e > 0, ((x - self.mean) @ basis) / np.sqrt(e), np.nan)


# ---- spectrum slicing -------------------------------------------------------------------------------------------------


def inertia(matrix: np.ndarray, shift: float) -> int:
    """Eigenvalues of a symmetric matrix above ``shift``: positive pivots of the LDL^T factors of matrix - shift I.

    Pivots are 1 x 1 or 2 x 2 (Bunch and Kaufman's choice), so no shift breaks
    the factorisation; a 2 x 2 pivot has one eigenvalue of each sign.
    """
    a = np.array(matrix, float)
    d = len(a)
    a[np.diag_indices(d)] -= shift
    alpha = (1 + math.sqrt(17)) / 8
    positive = k = 0

    def swap(p: int, q: int) -> None:
        if p != q:
            a[[p, q]] = a[[q, p]]
            a[:, [p, q]] = a[:, [q, p]]

    while k < d:
        size = 1
        if k + 1 < d:
            r = k + 1 + int(np.abs(a[k + 1 :, k]).argmax())
            largest = abs(a[r, k])
            if abs(a[k, k]) < alpha * largest:
                row = np.abs(a[k:, r])
                row[r - k] = 0
                sigma = row.max()
                if abs(a[k, k]) * sigma >= alpha * largest * largest:
                    pass
                elif abs(a[r, r]) >= alpha * sigma:
                    swap(k, r)
                else:
                    swap(k + 1, r)
                    size = 2
        if size == 1:
            pivot = a[k, k]
            positive += pivot > 0
            if pivot != 0 and k + 1 < d:
                below = a[k + 1 :, k].copy()
                a[k + 1 :, k + 1 :] -= np.outer(below, below / pivot)
        else:
            block = a[k : k + 2, k : k + 2]
            det = block[0, 0] * block[1, 1] - block[0, 1] ** 2
            positive += 1 if det < 0 else 2 * int(block[0, 0] > 0)
            if k + 2 < d:
                below = a[k + 2 :, k : k + 2].copy()
                a[k + 2 :, k + 2 :] -= below @ np.linalg.solve(block, below.T)
        k += size
    return int(positive)


def _rayleigh(matrix: np.ndarray, low: float, high: float, found: list[np.ndarray], scale: float, seed: int) -> tuple[float, np.ndarray]:
    """An eigenpair inside (low, high), orthogonal to ``found``: inverse iteration from the middle, then Rayleigh quotient iteration."""
    d = len(matrix)
    rng = np.random.default_rng(seed)
    eye = np.eye(d)

    def free(v: np.ndarray) -> np.ndarray:
        for _ in range(2):
            for u in found:
                v = v - (u @ v) * u
        return v / np.linalg.norm(v)

    def solved(shift: float, v: np.ndarray) -> np.ndarray:
        for nudge in (0.0, EPS, 4 * EPS, 64 * EPS):
            try:
                w = np.linalg.solve(matrix - (shift + nudge * scale) * eye, v)
            except np.linalg.LinAlgError:
                continue
            if np.isfinite(w).all() and np.linalg.norm(w) > 0:
                return w / np.linalg.norm(w)
        return v

    best, v = None, free(rng.normal(size=d))
    middle = (low + high) / 2
    for _ in range(4):
        v = free(solved(middle, v))
    for _ in range(30):
        rho = float(v @ matrix @ v)
        miss = float(np.linalg.norm(matrix @ v - rho * v))
        inside = low < rho <= high
        if inside and (best is None or miss < best[0]):
            best = (miss, rho, v)
        elif inside and best is not None:
            break  # cubic convergence has met the last bit
        if best is not None and best[0] <= 2 * EPS * scale:
            break
        # A quotient that left the interval belongs to another eigenvalue: back to its middle.
        v = free(solved(rho if inside else middle, v))
    if best is None:
        rho = float(v @ matrix @ v)
        return rho, v
    return best[1], best[2]


def leading(matrix: np.ndarray, wanted: int) -> list[Component]:
    """The ``wanted`` largest eigenvalues of a symmetric matrix, falling, with unit vectors.

    Eigenvalues that no double between them parts share an interval; their
    vectors are made orthogonal one after the other, so ties get some
    orthonormal basis. Signs: the entry of largest size is positive.
    """
    matrix = np.asarray(matrix, float)
    d = len(matrix)
    wanted = min(wanted, d)
    radius = np.abs(matrix).sum(axis=1) - np.abs(np.diag(matrix))
    scale = max(float((np.abs(np.diag(matrix)) + radius).max(initial=0)), np.finfo(float).tiny)
    # Gershgorin's circles hold the whole spectrum.
    bounds = {float((np.diag(matrix) - radius).min(initial=0)) - EPS * scale: d, float((np.diag(matrix) + radius).max(initial=0)) + EPS * scale: 0}
    out: list[Component] = []
    while len(out) < wanted:
        k = len(out) + 1  # number of the eigenvalue sought
        low = max(s for s, above in bounds.items() if above >= k)
        high = min(s for s, above in bounds.items() if above < k)
        while bounds[low] - bounds[high] > 1 and high - low > 8 * EPS * scale:
            middle = (low + high) / 2
            above = bounds[middle] = inertia(matrix, middle)
            low, high = (middle, high) if above >= k else (low, middle)
        while True:
            found: list[Component] = []
            for j in range(len(out) + 1, min(bounds[low], wanted) + 1):
                value, vector = _rayleigh(matrix, low, high, [c.vector for c in (*out, *found)], scale, j)
                vector = vector * (1 if vector[np.abs(vector).argmax()] > 0 else -1)
                lo, hi = max(low, value - 64 * EPS * scale), min(high, value + 64 * EPS * scale)
                found.append(Component(value, vector, lo, hi, bounds.get(lo, inertia(matrix, lo)), bounds.get(hi, inertia(matrix, hi))))
            if high - low <= 8 * EPS * scale or all(c.above_high < j <= c.above_low for j, c in enumerate(found, len(out) + 1)):
                break
            # The quotient went to an eigenvalue at the interval's edge: narrow it and start again.
            middle = (low + high) / 2
            above = bounds[middle] = inertia(matrix, middle)
            low, high = (middle, high) if above >= k else (low, middle)
        found.sort(key=lambda c: -c.value)
        for j, c in enumerate(found, len(out) + 1):
            if not c.above_high < j <= c.above_low:
                raise ArithmeticError(f"eigenvalue {j} of the covariance is not certified: {c.above_high} above {c.high}, {c.above_low} above {c.low}")
        out.extend(found)
    return out


# ---- moments in Spark -------------------------------------------------------------------------------------------------


def _entries(cell: pa.Array, dimension: int) -> np.ndarray:
    return cell.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


def integers(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and x (floor of 256 times each entry, as long) of the vectors without null or non-finite entries."""
    v = F.col(f"`{vector_col}`")
    usable = v.isNotNull() & (F.size(v) > 0) & F.coalesce(F.forall(v, lambda c: c.isNotNull() & (F.abs(c.cast("double")) * SCALE < float(LARGEST))), F.lit(False))
    # The filter stands on the scanned column, so nothing that it drops is converted.
    rows = table.filter(usable).select(F.col(f"`{id_col}`").alias("vec_id"), F.transform(v, lambda c: F.floor(c.cast("double") * SCALE)).alias("x"))
    return rows


def _partial_sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, sums = 0, None
    for batch in batches:
        if batch.num_rows:
            x = batch["x"]
            d = len(x[0])
            n += batch.num_rows
            part = _entries(x, d).sum(axis=0)  # below 2^40 times the rows of a batch
            sums = part.astype(object) if sums is None else sums + part
    if n:
        yield pa.RecordBatch.from_pydict({"n": [n], "i": [0], "sums": [[str(s) for s in sums]]})


def _exact_products(y: np.ndarray) -> np.ndarray:
    """y^T y of integers, exact, as Python's whole numbers where they need be: split in limbs that doubles multiply exactly."""
    total: np.ndarray | int = 0
    for lo in range(0, len(y), BLOCK):
        part = y[lo : lo + BLOCK]
        if np.abs(part).max(initial=0) < 1 << LIMB:
            f = part.astype(float)
            total = total + (f.T @ f).astype(np.int64).astype(object)
            continue
        limbs = []
        rest = part
        while np.any((rest != 0) & (rest != -1)) or not limbs:
            limbs.append((rest & ((1 << LIMB) - 1)).astype(float))
            rest = rest >> LIMB
        limbs.append(rest.astype(float))  # signs: 0 or -1
        for i, a in enumerate(limbs):
            for j, b in enumerate(limbs):
                total = total + (a.T @ b).astype(np.int64).astype(object) * (1 << (LIMB * (i + j)))
    return total


def _decimals(total: np.ndarray) -> pa.RecordBatch:
    """One row for each row of a symmetric matrix of whole numbers."""
    d = len(total)
    return pa.RecordBatch.from_pydict({"n": [0] * d, "i": list(range(d)), "sums": [[str(s) for s in row] for row in total]})


def _summed(parts: DataFrame) -> list[tuple[int, int, list[int]]]:
    """Rows (i, n, sums) of whole numbers added up by Spark: what reaches the driver has d rows of d numbers, whatever the number of tasks."""
    long = parts.select("i", "n", F.posexplode("sums").alias("j", "s")).groupBy("i", "j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n"))
    rows: dict[int, dict[int, int]] = {}
    n = 0
    for r in long.collect():
        rows.setdefault(r.i, {})[r.j] = int(r.s)
        n = r.n
    return [(i, n, [cells[j] for j in range(len(cells))]) for i, cells in sorted(rows.items())]


PARTS = "n long, i long, sums array<string>"


def covariance(n: int, shift: list[int], sums: list[int], products: list[list[int]]) -> tuple[np.ndarray, float]:
    """Covariance (divisor n) and trace from exact products of vectors less ``shift``, each entry rounded once."""
    rest = [s - n * c for s, c in zip(sums, shift, strict=True)]
    d = len(sums)
    exact = [[n * products[i][j] - rest[i] * rest[j] for j in range(d)] for i in range(d)]
    square = n * n
    return np.array([[exact[i][j] / square for j in range(d)] for i in range(d)]), sum(exact[i][i] for i in range(d)) / square


def fit(rows: DataFrame, wanted: int) -> tuple[Whitening, DataFrame]:
    """Fits on each distinct x once; returns the fit and the written fit list (column x)."""
    distinct = written(rows.select("x").distinct(), "whitening-fit-list")
    found = _summed(distinct.mapInArrow(_partial_sums, PARTS))
    if not found:
        return Whitening(0, [], 0.0, []), distinct
    _, n, sums = found[0]
    shift = [round(Fraction(s, n)) for s in sums]
    centre = np.array(shift, np.int64)

    def products(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = _exact_products(_entries(batch["x"], len(centre)) - centre)
                total = part if total is None else total + part
        if total is not None:
            yield _decimals(total)

    matrix, trace = covariance(n, shift, sums, [s for _, _, s in _summed(distinct.mapInArrow(products, PARTS))])
    components = leading(matrix, wanted)
    # Variance within the rounding of the covariance is none.
    for c in components:
        if c.value <= len(sums) * EPS * trace:
            c.value = 0.0
    return Whitening(n, sums, trace, components), distinct


def identity_error(distinct: DataFrame, fitted: Whitening) -> float:
    """Largest absolute entry of the fit list's whitened covariance minus the identity, over components with variance."""
    kept = [k for k, c in enumerate(fitted.components) if c.value > 0]
    if not kept:
        return 0.0
    shared = distinct.sparkSession.sparkContext.broadcast(fitted)

    def products(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(kept) + 1, len(kept)))
        for batch in batches:
            if batch.num_rows:
                w = shared.value.project(_entries(batch["x"], len(shared.value.sums)))[:, kept]
                sums += np.vstack([w.sum(axis=0), w.T @ w])
        yield pa.RecordBatch.from_pydict({"i": list(range(len(sums))), "w": sums.tolist()})

    parts = distinct.mapInArrow(products, "i long, w array<double>").select("i", F.posexplode("w").alias("j", "w"))
    cells = {(r.i, r.j): r.w for r in parts.groupBy("i", "j").agg(F.sum("w").alias("w")).collect()}
    mean = np.array([cells[0, j] for j in range(len(kept))]) / fitted.n
    second = np.array([[cells[i + 1, j] for j in range(len(kept))] for i in range(len(kept))]) / fitted.n
    return float(np.abs(second - np.outer(mean, mean) - np.eye(len(kept))).max())


def whiten(table: DataFrame, wanted: int = 4, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row for each usable row and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null, empty, or holds null or non-finite entries (or
    entries of 2^32 and more, whose x passes 2^40) are dropped. All vectors
    have one length; where lengths differ, the most frequent (of equals the
    largest) is kept and rows of others are dropped. Repeated vectors count
    once in the fit and are whitened each; null and repeated ids stay. There
    are min(wanted, length) components. A component without variance has null
    whitened; without any variance, as with one distinct vector, explained is
    null too. A deviation that no long holds is null. Other columns are
    ignored, whatever their names. Empty input gives an empty result.
    """
    spark = table.sparkSession
    bounded_batches(spark)
    rows = integers(table, id_col, vector_col)
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    dimension = lengths[0].d if lengths else 0
    rows = rows.filter(F.size("x") == dimension)
    fitted, distinct = fit(rows, wanted)
    error = identity_error(distinct, fitted)
    discard(distinct)
    shared = spark.sparkContext.broadcast(fitted)
    schema = StructType().add("vec_id", rows.schema["vec_id"].dataType).add("component", "integer").add("n", "long").add("deviation", "long")
    schema = schema.add("whitened", "double").add("explained", "double").add("identity_error", "double")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        k = len(f.components)
        share = [c.value / f.trace if f.trace > 0 else None for c in f.components]
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            x = _entries(batch["x"], dimension)
            w = f.project(x).ravel()
            columns = [
                pa.array(np.repeat(deviations(x, f.n, f.sums), k), pa.int64(), from_pandas=True), pa.array(w, pa.float64(), from_pandas=True),
                pa.array(share * m, pa.float64()), pa.array(np.full(m * k, error)),
            ]
            place = pa.array(np.repeat(np.arange(m), k))
            ids, numbers = batch["vec_id"].take(place), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m))
            yield pa.RecordBatch.from_arrays([ids, numbers, pa.array(np.full(m * k, f.n, np.int64)), *columns], schema.names)

    return rows.mapInArrow(run, schema)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """Sum over dimensions of (n x - S)^2, exact; None where it passes a long."""
    far = max(int(np.abs(x).max(initial=0)) * n, *(abs(s) for s in sums)) * 2
    if far * far * len(sums) < 1 << 63:
        y = x * n - np.array(sums, np.int64)
        return (y * y).sum(axis=1).astype(object)
    exact = [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    return np.array([e if e < 1 << 63 else None for e in exact], object)
