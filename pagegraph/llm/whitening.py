"""Whitening of embeddings by a covariance in two passes.

Entries c become integers x = floor(scale * c) + shift. The fit list holds each
distinct vector x once. Pass one sums x exactly, in integers; pass two sums outer
products of the centred vectors, a matrix product per Arrow batch, and a tree of
additions merges the tasks' matrices. The driver solves the symmetric eigenproblem
of that one matrix; mean and leading components are broadcast and every vector is
projected. A third pass over the fit list measures how far the covariance of the
whitened vectors is from the identity.

What is broadcast or reaches the driver has the size of the dimension squared at
most, whatever the number of rows.

Defined results: rows whose vector is null, empty, holds null or non-finite
entries, or entries whose scaled value is 2^52 or more (x would not be exact), are
dropped. All vectors of a fit have one dimension: where lengths differ, the most
frequent one (the longest of several) counts and other rows are dropped. Repeated
rows stay, and count once in the fit. A component without variance has null for
whitened and takes no part in identity_error; without any variance explained is
null. A deviation beyond a long is null. An empty table gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bounded_batches, ready_checkpoints, remove_folder

LOW = 26  # bits of the lower part in exact sums


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of equal length as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def merged(partial: DataFrame, add):
    """Rows of one per task added up by a tree; None without rows."""
    return partial.rdd.treeAggregate(None, lambda a, r: add(a, r) if a is not None else r, lambda a, b: a if b is None else b if a is None else add(a, b), depth=2)


def exact_sums(fit: DataFrame) -> tuple[int, list[int]]:
    """(rows, sums of x per dimension) as integers of any size."""

    def run(batches):
        n, total = 0, None
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(0))
                part = np.array([(x >> LOW).sum(axis=0), (x & (1 << LOW) - 1).sum(axis=0)])
                n, total = n + len(x), part if total is None else total + part
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), *[pa.array([t.tolist()], pa.list_(pa.int64())) for t in total]], names=["n", "high", "low"])

    partial = fit.select("x").mapInArrow(run, "n long, high array<long>, low array<long>").select("n", "high", "low")
    got = merged(partial, lambda a, b: (a[0] + b[0], *([p + q for p, q in zip(a[i], b[i], strict=True)] for i in (1, 2))))
    return (0, []) if got is None else (got[0], [(h << LOW) + v for h, v in zip(got[1], got[2], strict=True)])


class Model:
    """Mean and components; vectors are centred in integers before anything is multiplied."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.whole = np.array([s // n for s in sums], np.int64)
        self.part = np.array([s % n for s in sums], np.int64)  # x - mean = (x - whole) - part / n
        self.components = np.zeros((len(sums), 0))
        self.variances = np.zeros(0)
        self.trace = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.part / self.n

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sums over dimensions of (n x - S)^2, exact; null beyond a long."""
        y = x - self.whole
        most = self.n * (int(np.abs(y).max(initial=0)) + 1)
        if x.shape[1] * most * most < 1 << 63:
            return ((self.n * y - self.part) ** 2).sum(axis=1).tolist()
        exact = [sum((self.n * a - r) ** 2 for a, r in zip(row, self.part.tolist(), strict=True)) for row in y.tolist()]
        return [v if v < 1 << 63 else None for v in exact]

    def solve(self, outer: np.ndarray, most: int) -> None:
        """Components by falling eigenvalue from the sum of outer products."""
        covariance = outer / self.n
        values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
        self.trace = float(np.trace(covariance))
        self.variances = np.maximum(values[::-1][:most], 0)
        self.components = np.ascontiguousarray(vectors[:, ::-1][:, :most])

    def varies(self) -> np.ndarray:
        """Components whose variance is more than rounding."""
        return self.variances > len(self.whole) * np.finfo(float).eps * max(self.trace, np.finfo(float).tiny)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.varies(), self.centred(x) @ self.components / np.sqrt(self.variances), np.nan)


def outer_products(fit: DataFrame, vectors) -> np.ndarray | None:
    """The sum over the fit list of outer products of vectors(x), which are centred."""

    def run(batches):
        total = None
        for b in batches:
            if b.num_rows:
                c = vectors(matrix(b.column(0)))
                total = c.T @ c if total is None else total + c.T @ c
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["products"])

    partial = fit.select("x").mapInArrow(run, "products binary")
    got = merged(partial, lambda a, b: (np.add(np.frombuffer(a[0]), np.frombuffer(b[0])).tobytes(),))
    return None if got is None else np.frombuffer(got[0]).reshape(int(round((len(got[0]) / 8) ** 0.5)), -1)


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int, shift: int) -> DataFrame:
    """(id, x) of rows with usable vectors."""
    few = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("c"))
    usable = F.forall("c", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * scale) < float(1 << 52)))
    return few.where(F.col("c").isNotNull() & (F.size("c") > 0)).where(F.coalesce(usable, F.lit(False))).select("id", F.transform("c", lambda c: F.floor(c * scale) + F.lit(shift).cast("long")).alias("x"))


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = 16, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """One row per usable vector and component: id, component, n, deviation, whitened, explained, identity_error."""
    spark = vectors.sparkSession
    ready_checkpoints(spark)
    bounded_batches(spark)
    kind = vectors.schema[id_col].dataType.simpleString()
    result = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = integer_vectors(vectors, id_col, vector_col, scale, shift)
    sized = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if sized is None:
        return spark.createDataFrame([], result).withColumnRenamed("id", id_col)
    rows = rows.where(F.size("x") == sized.d)
    folder = f"{spark.sparkContext.getCheckpointDir()}/fit-{uuid.uuid4().hex}"
    rows.select("x").distinct().write.parquet(folder)
    fit = spark.read.parquet(folder)
    model = Model(*exact_sums(fit))
    model.solve(outer_products(fit, model.centred), most)
    varies, error = model.varies(), None
    if varies.any():
        left = Model.whitened
        unit = outer_products(fit, lambda x: left(model, x)[:, varies]) / model.n
        error = float(np.abs(unit - np.eye(len(unit))).max())
    remove_folder(spark, folder)
    shared = spark.sparkContext.broadcast(model)

    def project(batches):
        m = shared.value
        k = len(m.variances)
        explained = m.variances / m.trace if m.trace > 0 else np.full(k, np.nan)
        for b in batches:
            r = b.num_rows
            if not r:
                continue
            x = matrix(b.column(1))
            at = pa.array(np.repeat(np.arange(r), k))
            columns = [
                b.column(0).take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), r)), pa.array(np.full(r * k, m.n)), pa.array(m.deviation(x), pa.int64()).take(at),
                pa.array(m.whitened(x).ravel(), from_pandas=True), pa.array(np.tile(explained, r), from_pandas=True), pa.array([error] * (r * k), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, result).withColumnRenamed("id", id_col)
