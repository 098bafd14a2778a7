"""Embedding whitening: leading covariance eigenvectors by a block Jacobi-Davidson on distributed products."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingrisk.llm.common import arrow_schema, prepare_session, ship_package
from filingrisk.session import materialise

#: Components asked for, and further directions that the search carries along.
COMPONENTS, GUARDS = 8, 4
#: Entries become floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: A residual is at double precision below so many units in the last place of the largest eigenvalue.
RESIDUAL_ULPS = 128
#: Steps of the inner solver for one correction, at most, and the share of the residual it leaves.
INNER_STEPS, INNER_RESIDUAL = 8, 0.05
#: Basis vectors before a restart, in blocks.
BASIS_BLOCKS = 8


def prepare(vectors: DataFrame, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """key, x (whole numbers) of each vector that takes part, stored.

    Null vectors and those with a null or not finite entry are left out, and so
    are those of another length than the most frequent one (of equally frequent
    ones the longest), which share no covariance. An entry too large for a long
    raises an arithmetic error, as Spark's own long arithmetic does.
    """
    entries = F.col(column).cast("array<double>")
    rows = vectors.select(F.col(key).alias("vec_id"), entries.alias("c")).where("c is not null")
    rows = rows.where(F.forall("c", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    whole = F.transform("c", lambda v: F.floor(v * F.lit(float(SCALE))) + F.lit(SHIFT).cast("long"))
    made = materialise(rows.select("vec_id", whole.alias("x")))
    common = made.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return made.where(F.size("x") == F.lit(common["d"] if common else 0))


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column without nulls as one whole-number matrix."""
    return column.flatten().to_numpy().reshape(len(column), -1)


def _sum_by_dimension(df: DataFrame, column: str, partial: Callable[[np.ndarray], np.ndarray], width: int, kind: str) -> np.ndarray:
    """Sum over all rows of a (dimensions x width) table that each task makes of its rows.

    A task sends one row for each dimension; Spark adds them up, so the driver
    receives one table whatever the number of tasks.
    """
    ship_package(df.sparkSession)
    names = [f"v{i}" for i in range(width)]
    ddl = "dim int, " + ", ".join(f"{n} {kind}" for n in names)
    schema = arrow_schema(ddl)

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                made = partial(matrix(batch.column(0)))
                total = made if total is None else total + made
        if total is not None:
            columns = [np.arange(len(total), dtype=np.int32), *np.ascontiguousarray(total.T)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    added = df.select(column).mapInArrow(run, ddl).groupBy("dim").agg(*(F.sum(n).alias(n) for n in names)).toArrow()
    order = np.argsort(added["dim"].to_numpy())
    return np.stack([added[n].to_numpy()[order] for n in names], axis=1) if len(order) else np.zeros((0, width))


def fit_sums(rows: DataFrame) -> tuple[int, np.ndarray]:
    """Number of vectors and exact sum of each dimension."""

    def partial(x):
        return np.stack([x.sum(axis=0), np.full(x.shape[1], len(x), dtype=np.int64)], axis=1)

    sums = _sum_by_dimension(rows, "x", partial, 2, "bigint")
    return (int(sums[0, 1]), sums[:, 0]) if len(sums) else (0, np.zeros(0, dtype=np.int64))


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x less the mean: the difference is taken in whole numbers, so it is right to the last place."""
    return (n * x - sums) / n


def covariance_product(rows: DataFrame, n: int, sums: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """V times a block of vectors: one pass over the rows, V itself is never formed."""

    def product(block: np.ndarray) -> np.ndarray:
        def partial(x):
            c = centred(x, n, sums)
            return c.T @ (c @ block)

        return _sum_by_dimension(rows, "x", partial, block.shape[1], "double") / n

    return product


def _orthonormal(block: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """Orthonormal basis of what `block` adds to the given orthonormal bases; dependent directions go."""
    kept = np.zeros((len(block), 0))
    for column in block.T:
        size = np.linalg.norm(column)
        if not size:
            continue
        v = column / size
        for _ in range(3):
            for basis in (*against, kept):
                v = v - basis @ (basis.T @ v)
            left = np.linalg.norm(v)
            if left < 1e-10:
                break
            v = v / left
        else:
            kept = np.column_stack([kept, v])
    return kept


def minres(product, shifts: np.ndarray, right: np.ndarray, project, steps: int = INNER_STEPS, tolerance: float = INNER_RESIDUAL) -> np.ndarray:
    """Approximate solutions of P (A - shift_j) P t_j = right_j, all columns in step.

    Each column has its own Lanczos recurrence and rotations; one step asks one
    product with the whole block. `right` is in the range of the projection P.
    """
    solution = np.zeros_like(right)
    beta = np.linalg.norm(right, axis=0)
    safe = np.where(beta > 0, beta, 1.0)
    v, v_old = right / safe, np.zeros_like(right)
    d, d_old = np.zeros_like(right), np.zeros_like(right)
    eta, start = beta.copy(), beta.copy()
    c_old, c, s_old, s = (np.full(len(beta), x) for x in (1.0, 1.0, 0.0, 0.0))
    going = beta > 0
    beta_old = np.zeros_like(beta)
    for _ in range(steps):
        if not going.any():
            break
        w = project(product(v)) - shifts * v
        alpha = (v * w).sum(axis=0)
        w = project(w - alpha * v - beta_old * v_old)
        beta_next = np.linalg.norm(w, axis=0)
        # Two old rotations act on the new column of the tridiagonal matrix, then a third clears beta_next.
        r3 = s_old * beta_old
        r2 = s * alpha + c * c_old * beta_old
        r1_hat = c * alpha - s * c_old * beta_old
        r1 = np.hypot(r1_hat, beta_next)
        usable = going & (r1 > 0)
        r1_safe = np.where(r1 > 0, r1, 1.0)
        c_new, s_new = r1_hat / r1_safe, beta_next / r1_safe
        direction = (v - r3 * d_old - r2 * d) / r1_safe
        solution = np.where(usable, solution + c_new * eta * direction, solution)
        eta = np.where(usable, -s_new * eta, eta)
        d_old, d = d, direction
        c_old, c, s_old, s = c, c_new, s, s_new
        going = usable & (np.abs(eta) > tolerance * start) & (beta_next > 1e-14 * np.abs(shifts).max(initial=1e-300))
        v_old, v = v, np.where(going, w / np.where(beta_next > 0, beta_next, 1.0), 0.0)
        beta_old = beta_next
    return solution


def jacobi_davidson(product, dimension: int, wanted: int, seed: int = 7, rounds: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """The `wanted` largest eigenvalues, falling, and unit eigenvectors of a symmetric positive operator.

    Rayleigh-Ritz on a growing subspace. Every Ritz pair with a residual above
    RESIDUAL_ULPS units in the last place of the largest eigenvalue gets a
    correction, solved by inner MINRES in the complement of the locked and the
    current vectors; a pair below is locked, largest first. A locked pair that a
    larger one follows is taken out of the answer, not out of the deflation.
    """
    wanted = min(wanted, dimension)
    width = min(dimension, wanted + GUARDS)
    rng = np.random.default_rng(seed)
    locked, values = np.zeros((dimension, 0)), []
    basis = _orthonormal(rng.standard_normal((dimension, width)))
    image = product(basis)
    for _ in range(rounds):
        small = basis.T @ image
        theta, turn = np.linalg.eigh((small + small.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        ritz, ritz_image = basis @ turn, image @ turn
        residual = ritz_image - ritz * theta
        residual -= locked @ (locked.T @ residual)
        size = np.linalg.norm(residual, axis=0)
        top = max([*values, *theta.tolist(), 0.0])
        limit = RESIDUAL_ULPS * np.finfo(float).eps * top
        done = 0
        while done < len(theta) and size[done] <= limit and (len(values) < wanted or theta[done] > sorted(values)[-wanted]):
            locked, values, done = np.column_stack([locked, ritz[:, done]]), [*values, float(theta[done])], done + 1
        basis, image, theta, residual = ritz[:, done:], ritz_image[:, done:], theta[done:], residual[:, done:]
        enough = len(values) >= wanted and (not len(theta) or theta[0] <= sorted(values)[-wanted] + limit)
        if enough or len(values) == dimension:
            break
        if basis.shape[1] > BASIS_BLOCKS * width:
            basis, image, theta, residual = (m[..., : 2 * width] for m in (basis, image, theta, residual))
        active = slice(0, max(1, min(width, wanted + GUARDS - min(wanted, len(values)))))
        near = np.column_stack([locked, basis[:, active]])

        def project(block, near=near):
            block = block - near @ (near.T @ block)
            return block - near @ (near.T @ block)

        asked = project(-residual[:, active])
        fresh = _orthonormal(minres(product, theta[active], asked, project), locked, basis)
        fresh = np.column_stack([fresh, _orthonormal(asked, locked, basis, fresh)])[:, : basis[:, active].shape[1]]
        if not fresh.shape[1]:
            # Nothing new to the current vectors: a random direction, unless they span all.
            fresh = _orthonormal(rng.standard_normal((dimension, 1)), locked, basis)
            if not fresh.shape[1]:
                # The whole space is spanned, so what is left is rounding.
                locked, values = np.column_stack([locked, basis]), [*values, *theta.tolist()]
                break
        image = np.column_stack([image, product(fresh)])
        basis = np.column_stack([basis, fresh])
    else:
        raise ArithmeticError(f"{len(values)} of {wanted} eigenpairs at double precision after {rounds} rounds")
    order = np.argsort(-np.array(values), kind="stable")[:wanted]
    return np.array(values)[order], locked[:, order]


@dataclass
class Whitening:
    """A fitted whitening: number of vectors, sums, eigenvalues, unit eigenvectors, total variance."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        return (centred(x, self.n, self.sums) @ self.vectors) / np.sqrt(self.values)


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening:
    """Whitening of the rows that `prepare` gives.

    Components whose eigenvalue is no more than rounding beside the largest are
    left out, since nothing scales them to one; equal vectors, one vector or
    none give no component.
    """
    prepare_session(rows.sparkSession)
    n, sums = fit_sums(rows)
    total = int(deviations(rows, n, sums).agg(F.sum("deviation")).first()[0] or 0) if n else 0
    if not total:
        return Whitening(n, sums, np.zeros(0), np.zeros((len(sums), 0)), 0.0)
    values, vectors = jacobi_davidson(covariance_product(rows, n, sums), len(sums), components)
    real = values > len(sums) * RESIDUAL_ULPS * np.finfo(float).eps * values.max()
    return Whitening(n, sums, values[real], vectors[:, real], total / n**3)


def squared_deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int]:
    """Exact sum over dimensions of (n x - S)^2 of each row."""
    off = n * x - sums
    if float(np.abs(off).max(initial=0)) ** 2 * max(1, x.shape[1]) < 2.0**62:
        return (off * off).sum(axis=1).tolist()
    return [sum(v * v for v in row) for row in off.tolist()]


def deviations(rows: DataFrame, n: int, sums: np.ndarray) -> DataFrame:
    """deviation (exact, a decimal of 38 digits) of every row."""
    ship_package(rows.sparkSession)
    schema = arrow_schema("deviation decimal(38,0)")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                made = [Decimal(v) for v in squared_deviations(matrix(batch.column(0)), n, sums)]
                yield pa.RecordBatch.from_arrays([pa.array(made, schema.types[0])], schema=schema)

    return rows.select("x").mapInArrow(run, "deviation decimal(38,0)")


def identity_error(rows: DataFrame, model: Whitening) -> float | None:
    """Largest absolute entry of the whitened rows' covariance less the identity; null without components."""
    k = len(model.values)
    if not k:
        return None

    def ones(x):
        return model.scores(x).sum(axis=0)[:, None]

    mean = _sum_by_dimension(rows, "x", ones, 1, "double")[:, 0] / model.n

    def products(x):
        w = model.scores(x) - mean
        return w.T @ w

    return float(np.abs(_sum_by_dimension(rows, "x", products, k, "double") / model.n - np.eye(k)).max())


def whiten(rows: DataFrame, model: Whitening, error: float | None = None) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), one row for each row and component.

    deviation is a decimal of 38 digits; components count from 1 by falling
    variance. Repeated rows and repeated or null vec_ids are rows like all others.
    """
    ship_package(rows.sparkSession)
    kind = rows.schema["vec_id"].dataType.simpleString()
    ddl = f"vec_id {kind}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
    schema = arrow_schema(ddl)
    k = len(model.values)

    def run(batches):
        for batch in batches:
            if not batch.num_rows or not k:
                continue
            x = matrix(batch.column(1))
            deviation = [Decimal(v) for v in squared_deviations(x, model.n, model.sums)]
            at = np.repeat(np.arange(len(x)), k)
            columns = (
                batch.column(0).take(pa.array(at)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(at), model.n, dtype=np.int64)),
                pa.array(deviation, schema.types[3]).take(pa.array(at)),
                pa.array(model.scores(x).ravel()),
                pa.array(np.tile(model.values / model.trace, len(x))),
                pa.array([error] * len(at), pa.float64()),
            )
            yield pa.RecordBatch.from_arrays(list(columns), schema=schema)

    return rows.select("vec_id", "x").mapInArrow(run, ddl)
