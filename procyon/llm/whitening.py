"""Embedding whitening: a multiplicity-weighted covariance, each distinct vector whitened once, results joined back.

1. Entries are put on an integer grid, x = floor(scale * c) + shift, so that equal vectors are equal exactly.
2. Equal x vectors are grouped: the fit list, each with its number of rows. Its weights are one or that number.
3. Weighted sums S of the fit list, in exact integers; then the covariance by one centred, weighted matrix product of
   each batch, (x - S/n) of which every entry is an exact integer over n. Only d x d sums leave a task.
4. The driver takes the eigenvectors of that one d x d matrix.
5. Every distinct vector is projected once, and its rows get the result by a join on the SHA-256 of x. The covariance of
   what was projected, less the identity, is measured by another pass.

A vector that a third of all rows hold is one row of the fit list (the grouping pre-aggregates in each task), and in the
join back its rows are many of one key on one side, which adaptive execution splits.

Edge cases: rows whose vector is null, empty or holds null or non-finite entries are dropped, as are vectors of another
length than the commonest (the longer of equally common ones), and those with an entry beyond 2^40 after scaling; null
and repeated ids are rows like others; of equal eigenvalues the order is that of the solver; components whose share is
below 1e-12 are left out, so a table of one distinct vector gives no rows, as an empty one; a deviation that a long
cannot hold is null; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, save

SCALE, SHIFT, COMPONENTS = 64.0, 1_000_000, 16
LIMIT = float(1 << 40)
NONE = 1e-12


@dataclass
class Whitening:
    """What is fitted: total weight, sums of x by dimension, trace of the covariance, eigenvalues and -vectors (rows)."""

    weight: int
    sums: np.ndarray
    trace: float
    values: np.ndarray
    vectors: np.ndarray


def on_grid(embeddings: DataFrame, vector: str = "embedding", scale: float = SCALE, shift: int = SHIFT) -> DataFrame:
    """(vec_id, x, key) of the rows that are used; key is the SHA-256 of x."""
    wide = F.transform(F.col(vector), lambda c: c.cast("double") * F.lit(float(scale)))
    usable = F.coalesce(F.forall(wide, lambda c: c.isNotNull() & (F.abs(c) <= F.lit(LIMIT))), F.lit(False)) & (F.size(vector) > 0)  # a NaN is above any number
    near = F.transform(wide, lambda c: F.floor(F.least(F.greatest(c, F.lit(-LIMIT)), F.lit(LIMIT))) + F.lit(shift))  # whatever the filters' order
    rows = embeddings.where(usable).select("vec_id", near.alias("x"))
    sizes = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    rows = rows.where(F.size("x") == (sizes[0]["size"] if sizes else 0))
    return rows.withColumn("key", F.sha2(F.array_join("x", ",").cast("binary"), 256))


def _matrix(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _sums(fit: DataFrame, weights: str) -> tuple[int, np.ndarray]:
    """The total weight, and the weighted sums of each dimension, in integers of any size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, weight = None, 0
        for batch in batches:
            x, w = _matrix(batch.column("x")), batch.column("w").to_numpy()
            if len(w):
                small = float(np.abs(x).max()) * float(w.sum()) < float(1 << 62)
                own = (x * w[:, None]).sum(0) if small else (x.astype(object) * w[:, None].astype(object)).sum(0)
                total = own.astype(object) if total is None else total + own
                weight += int(w.sum())
        if total is not None:
            sums = pa.array([Decimal(int(s)) for s in total], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), sums, pa.array([weight] * len(total), pa.int64())], ["dim", "s", "w"])

    own = fit.select("x", (F.lit(1) if weights == "one" else F.col("copies")).cast("bigint").alias("w"))
    found = map_batches(own, run, "dim int, s decimal(38,0), w bigint").groupBy("dim").agg(F.sum("s").alias("s"), F.sum("w").alias("w")).orderBy("dim").collect()
    return (found[0]["w"], np.array([int(r["s"]) for r in found], object)) if found else (0, np.zeros(0, object))


def centred(x: np.ndarray, weight: int, sums: np.ndarray) -> np.ndarray:
    """weight * x - S, exactly: longs where they hold it, else Python integers."""
    small = max(int(np.abs(x).max(initial=0)) * weight, max((abs(int(s)) for s in sums), default=0)) < 1 << 61
    return x * weight - sums.astype(np.int64) if small else x.astype(object) * weight - sums


def _products(df: DataFrame, column: str, weights: str | None, weight: int, sums: np.ndarray | None, d: int) -> np.ndarray:
    """The sum over all rows of w * y y', d x d: y is (x - S/n), or the column itself without sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            y = _matrix(batch.column(column))
            if sums is not None:
                y = centred(y, weight, sums).astype(np.float64) / weight
            w = batch.column(weights).to_numpy()[:, None] if weights else 1.0
            total += y.T @ (y * w)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d), pa.int32()), pa.FixedSizeListArray.from_arrays(pa.array(total.ravel()), d).cast(pa.list_(pa.float64()))], ["i", "row"])

    cells = map_batches(df, run, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v"))
    out = np.zeros((d, d))
    for r in cells.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # d * d numbers
        out[r["i"], r["j"]] = r["v"]
    return (out + out.T) / 2


def fit(distinct: DataFrame, components: int = COMPONENTS, weights: str = "one") -> Whitening:
    """distinct (x, copies): each different vector once. weights: "one" for each of them, or "copies"."""
    weight, sums = _sums(distinct, weights)
    if not weight:
        return Whitening(0, sums, 0.0, np.zeros(0), np.zeros((0, 0)))
    used = distinct.select("x", "copies") if weights != "one" else distinct.select("x")
    covariance = _products(used, "x", "copies" if weights != "one" else None, weight, sums, len(sums)) / weight
    values, vectors = np.linalg.eigh(covariance)
    trace = float(np.trace(covariance))
    values, vectors = values[::-1][:components], vectors[:, ::-1].T[:components]
    some = values > NONE * trace
    return Whitening(weight, sums, trace, values[some], vectors[some])


def project(distinct: DataFrame, model: Whitening, carry: str = "key") -> DataFrame:
    """(carry, deviation, z) of each row of distinct: deviation is the sum of (n * x - S)^2, z the whitened components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = (model.vectors / np.sqrt(model.values)[:, None]).T
        for batch in batches:
            own = centred(_matrix(batch.column("x")), model.weight, model.sums)
            far = max(int(own.max(initial=0)), -int(own.min(initial=0)))
            square = (own if far * far * own.shape[1] < 1 << 62 else own.astype(object)) ** 2
            deviation = [s if s < 1 << 63 else None for s in map(int, square.sum(1))]
            z = own.astype(np.float64) / model.weight @ to
            lists = pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(z).ravel()), z.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(carry), pa.array(deviation, pa.int64()), lists], [carry, "deviation", "z"])

    return map_batches(distinct.select(carry, "x"), run, f"{carry} {distinct.schema[carry].dataType.simpleString()}, deviation bigint, z array<double>")


def whiten(embeddings: DataFrame, components: int = COMPONENTS, weights: str = "one", vector: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each used row and component from 1."""
    rows = on_grid(embeddings, vector)
    distinct = save(rows.groupBy("x").agg(F.count("*").alias("copies")).withColumn("key", F.sha2(F.array_join("x", ",").cast("binary"), 256)))
    model = fit(distinct, components, weights)
    found = len(model.values)
    if not found:
        return rows.where("false").selectExpr("vec_id", "0 AS component", "0L AS n", "0L AS deviation", "0D AS whitened", "0D AS explained", "0D AS identity_error")
    done = save(project(distinct, model))
    weighed = done.select("z", F.lit(1).alias("copies")) if weights == "one" else done.join(distinct.select("key", "copies"), "key").select("z", "copies")
    error = float(np.abs(_products(weighed, "z", "copies", 1, None, found) / model.weight - np.eye(found)).max())
    share = F.array(*[F.lit(float(v / model.trace)) for v in model.values])
    joined = rows.select("vec_id", "key").join(done, "key")
    each = joined.select("vec_id", "deviation", F.posexplode("z").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.weight).cast("bigint").alias("n"), "deviation", "whitened", F.element_at(share, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"))
