"""Whitening of embeddings by Jacobi-Davidson with distributed centred products.

The covariance is never built: each product with a block of vectors is one pass over the rows. Subspace
Rayleigh-Ritz gives approximate eigenvectors; those with a residual at double precision are locked, for all others a
projected correction equation is solved by a few steps of MINRES, in lockstep, so that a step is one pass for all.
"""

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from scriptmill.llm.common import stage, table

COMPONENTS = 32
#: further vectors in the first subspace; subspaces of more than RESTART times the wanted vectors start anew
GUARD, RESTART = 4, 4
#: MINRES ends after so many steps, or when it has reduced all residuals to this share
STEPS, REDUCED = 8, 0.02
#: residuals of at most this share of the largest eigenvalue count as double precision
PRECISION = 256 * np.finfo(float).eps
MOST_ROUNDS = 200
#: numbers that a worker holds centred at a time
SLICE = 1 << 20
#: 64 * c + 1,000,000 is exact in doubles up to this size of c; larger entries count as not finite
LARGEST = 2.0 ** 46


def units(vector: str) -> Column:
    """floor(64 * c) + 1,000,000 of all entries, as long."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * 64).cast("long") + 1_000_000)


def whole_vectors(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is there, without null or non-finite entries, and of the most common length (of equally common
    ones, the longest). Empty vectors never are."""
    sound = df.where(F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda c: F.coalesce(
        F.abs(c.cast("double")) <= LARGEST, F.lit(False))), F.lit(False)))
    common = sound.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return sound.where(F.size(vector) == (common.d if common else 0))


def _matrices(column: pa.Array, d: int) -> Iterator[np.ndarray]:
    """The rows of a column of equally long lists, in slices."""
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    step = max(1, SLICE // d)
    for at in range(0, len(flat), step):
        yield flat[at:at + step]


@dataclass(frozen=True)
class Fit:
    """Rows `x` (array<long>), their number and exact sums. Passes over them add up what `part` makes of each
    centred slice; they move a matrix per task to the rows of that matrix, and only the sum to the driver."""

    rows: DataFrame
    d: int
    n: int
    sums: list[int]

    def centre(self) -> Callable[[np.ndarray], np.ndarray]:
        """x - sums / n, from the whole and the broken part of the means, so that nothing cancels."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        broken = np.array([s % self.n / self.n for s in self.sums])
        return lambda x: (x - whole) - broken

    def total(self, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        centre, d = self.centre(), self.d

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            summed = None
            for batch in batches:
                for x in _matrices(batch.column(0), d):
                    now = part(centre(x))
                    summed = now if summed is None else summed + now
            if summed is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(summed))), pa.array(list(summed))], ["i", "y"])

        width = part(np.zeros((1, d))).shape[1]
        parts = self.rows.select("x").mapInArrow(run, "i long, y array<double>")
        rows = parts.groupBy("i").agg(*[F.sum(F.col("y")[j]).alias(f"y{j}") for j in range(width)]).collect()
        return np.array([r[1:] for r in sorted(rows)], float)

    def product(self, u: np.ndarray) -> np.ndarray:
        """The covariance times the columns of `u`."""
        return self.total(lambda c: c.T @ (c @ u)) / self.n


def fit_list(rows: DataFrame, x: str) -> Fit | None:
    """Number and sums of staged rows of equally long lists of long; None without rows."""
    first = rows.select(F.size(x)).first()
    if first is None:
        return None
    d = first[0]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = [0] * d, 0
        for batch in batches:
            n += batch.num_rows
            for part in _matrices(batch.column(0), d):
                sums = [s + t for s, t in zip(sums, part.sum(axis=0).tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(range(d + 1), pa.int64()), pa.array(
            [Decimal(s) for s in [*sums, n]], pa.decimal128(38, 0))], ["i", "s"])

    told = rows.select(x).mapInArrow(run, "i long, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).collect()
    *sums, n = [int(r.s) for r in sorted(told)]
    return Fit(rows.select(F.col(x).alias("x")), d, n, sums)


def minres(apply: Callable[[np.ndarray], np.ndarray], b: np.ndarray) -> np.ndarray:
    """Approximate solutions of symmetric, maybe indefinite systems, one a column; `apply` is their operators at once."""
    tiny = np.finfo(float).tiny
    first = np.linalg.norm(b, axis=0)
    x, w, w_old, r_old, r, y = (np.zeros_like(b), np.zeros_like(b), np.zeros_like(b), b, b, b)
    beta, beta_old = first.copy(), np.ones_like(first)
    dbar, epsln, left = np.zeros_like(first), np.zeros_like(first), first.copy()
    cs, sn = -np.ones_like(first), np.zeros_like(first)
    for step in range(STEPS):
        going = (left > REDUCED * first) & (beta > 1e-14 * first)
        if not going.any():
            break
        v = np.where(going, y / np.maximum(beta, tiny), 0.0)
        y = apply(v)
        if step:
            y = y - beta / np.maximum(beta_old, tiny) * r_old
        alfa = (v * y).sum(axis=0)
        y = y - alfa / np.maximum(beta, tiny) * r
        r_old, r, beta_old, beta = r, y, beta, np.linalg.norm(y, axis=0)
        epsln_old, delta, gbar = epsln, cs * dbar + sn * alfa, sn * dbar - cs * alfa
        epsln, dbar = sn * beta, -cs * beta
        gamma = np.maximum(np.hypot(gbar, beta), tiny)
        cs, sn = gbar / gamma, beta / gamma
        w_old, w = w, (v - epsln_old * w_old - delta * w) / gamma
        x = np.where(going, x + cs * left * w, x)
        left = np.where(going, sn * left, left)
    return x


def _new_directions(t: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what `t` adds to the orthonormal `bases`."""
    known = np.hstack(bases)
    size = np.linalg.norm(t, axis=0)
    t = t[:, size > 0] / size[size > 0]
    for _ in range(2):
        t = t - known @ (known.T @ t)
        u, s, _ = np.linalg.svd(t, full_matrices=False)
        t = u[:, s > 1e-8]
    return t[:, :max(0, len(t) - known.shape[1])]


def jacobi_davidson(product: Callable[[np.ndarray], np.ndarray], d: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and their unit eigenvectors, of the symmetric operator `product` on d
    dimensions. All matrices here have d rows and a few times k columns."""
    q = np.linalg.qr(np.random.default_rng(1).standard_normal((d, min(d, k + GUARD))))[0]
    aq = product(q)
    locked, alocked = np.zeros((d, 0)), np.zeros((d, 0))
    for _ in range(MOST_ROUNDS):
        values, y = np.linalg.eigh((q.T @ aq + aq.T @ q) / 2)
        y = y[:, ::-1]
        q, aq, values = q @ y, aq @ y, values[::-1]
        scale = max([abs(values).max(), *np.linalg.norm(alocked, axis=0)])
        wanted = min(k - locked.shape[1], q.shape[1])
        left = aq[:, :wanted] - q[:, :wanted] * values[:wanted]
        left = left - locked @ (locked.T @ left)
        done = np.zeros(q.shape[1], bool)
        done[:wanted] = np.linalg.norm(left, axis=0) <= PRECISION * scale
        if locked.shape[1] + q.shape[1] == d:  # the whole space: what is left are rounding errors
            done[:wanted] = True
        locked, alocked = np.hstack([locked, q[:, done]]), np.hstack([alocked, aq[:, done]])
        if locked.shape[1] == k:
            # a last Rayleigh-Ritz step among the locked vectors
            values, y = np.linalg.eigh((locked.T @ alocked + alocked.T @ locked) / 2)
            return values[::-1], locked @ y[:, ::-1]
        left, theta, ritz = left[:, ~done[:wanted]], values[:wanted][~done[:wanted]], q[:, :wanted][:, ~done[:wanted]]
        q, aq = q[:, ~done], aq[:, ~done]
        known = np.hstack([locked, ritz])

        def corrected(v: np.ndarray) -> np.ndarray:
            v = v - known @ (known.T @ v)
            v = product(v) - theta * v
            return v - known @ (known.T @ v)

        if q.shape[1] > RESTART * k:
            q, aq = q[:, :k + GUARD], aq[:, :k + GUARD]
        new = _new_directions(minres(corrected, -left), locked, q)
        if not new.shape[1]:
            new = _new_directions(np.random.default_rng(2).standard_normal((d, GUARD)), locked, q)
        q, aq = np.hstack([q, new]), np.hstack([aq, product(new)])
    raise ArithmeticError(f"no {k} eigenvectors at double precision in {MOST_ROUNDS} rounds")


@dataclass(frozen=True)
class Whitening:
    """Components of a fit list: eigenvalues falling, unit eigenvectors as columns, each with its largest entry positive,
    shares of the trace, and the largest entry of the whitened rows' covariance minus the identity."""

    fit: Fit
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    identity_error: float

    def rows(self, rows: DataFrame, key: str, x: str) -> DataFrame:
        """key, `deviation` (decimal(38,0), the exact sum of (n * x - S)^2) and `whitened` (array<double>) of each row."""
        fit, centre, scaled = self.fit, self.fit.centre(), self.vectors / np.sqrt(self.values)
        n, sums, d = fit.n, np.array(fit.sums, object), fit.d
        kind = rows.schema[key].dataType.simpleString()

        def deviations(x: np.ndarray) -> pa.Array:
            reach = max(abs(int(s) - n * v) for s, v in [*zip(sums, x.max(axis=0).tolist()), *zip(sums, x.min(axis=0).tolist())])
            if reach * reach * d < 2**63 and n * int(abs(x).max()) < 2**63:
                off = n * x - sums.astype(np.int64)
                return pa.array((off * off).sum(axis=1)).cast(pa.decimal128(38, 0))
            off = n * x.astype(object) - sums
            return pa.array([Decimal(v) for v in (off * off).sum(axis=1)], pa.decimal128(38, 0))

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = 0
                for part in _matrices(batch.column(1), d):
                    keys = batch.column(0).slice(at, len(part))
                    at += len(part)
                    yield pa.RecordBatch.from_arrays([keys, deviations(part), pa.array(list(centre(part) @ scaled), pa.list_(
                        pa.float64()))], ["_key", "deviation", "whitened"])

        return rows.select(F.col(key).alias("_key"), x).mapInArrow(
            run, f"_key {kind}, deviation decimal(38,0), whitened array<double>").withColumnRenamed("_key", key)


def whitening(fit: Fit, most: int = COMPONENTS) -> Whitening | None:
    """The first `most` components of a fit list, or as many as its covariance has rank: eigenvalues that are rounding
    errors of the largest one have none. None if all rows are equal."""
    trace = float(fit.total(lambda c: (c * c).sum(axis=0)[:, None]).sum()) / fit.n
    if not trace > 0:
        return None
    values, vectors = jacobi_davidson(fit.product, fit.d, min(most, fit.d))
    sound = values > 16 * fit.d * np.finfo(float).eps * values[0]
    values, vectors = values[sound], vectors[:, sound]
    vectors = vectors * np.sign(vectors[abs(vectors).argmax(axis=0), np.arange(len(values))])
    scaled = vectors / np.sqrt(values)
    mean = fit.total(lambda c: (c @ scaled).sum(axis=0)[:, None])[:, 0] / fit.n

    def covariance(c: np.ndarray) -> np.ndarray:
        w = c @ scaled - mean
        return w.T @ w

    error = abs(fit.total(covariance) / fit.n - np.eye(len(values))).max()
    return Whitening(fit, values, vectors, values / trace, float(error))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null ids and repeated rows are rows like others. A deviation that no long holds fails the query."""
    kept = whole_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding")
    rows = stage(kept.select("vec_id", units("embedding").alias("x")), "units")
    fit = fit_list(rows, "x")
    made = fit and whitening(fit)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not made:
        return spark.createDataFrame([], schema)
    shares = F.array(*map(F.lit, made.explained.tolist()))
    return made.rows(rows, "vec_id", "x").select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(fit.n).cast("long").alias("n"),
        F.col("deviation").cast("long").alias("deviation"), "whitened", shares[F.col("at")].alias("explained"),
        F.lit(made.identity_error).alias("identity_error"))
