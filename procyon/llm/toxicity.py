"""Toxicity: a linear classifier of character n-grams, each feature scaled by its naive Bayes log-count ratio.

Fit: a bounded sample of labelled rows (`per_class` rows of each class, by the order of a hash; documented bound) gives
the documents that hold each hashed n-gram, per class. Each n-gram's value, where present, is its log-count ratio r; the
`features` n-grams of the largest |r| are kept, and a logistic regression is trained on them by Spark ML, its rows
weighted back to the share of the classes among all labels. Score: one pass over all whole texts.

Edge cases: null and empty texts have no n-grams and score as the intercept; null ids are scored, never learned from;
labels that are null are ignored, of repeated labels the highest counts; without labels of both classes every score is
the share of the one class (0 without any); repeated rows score equally; extra columns are ignored by `score`, kept by
`keep_clean`; empty tables give none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, mix, save, text_chunks

ORDERS = (4, 6)
BITS = 20
PER_CLASS, FEATURES, SUPPORT = 3000, 8192, 4
REJECT = 0.3


def grams(texts: list[str], orders: tuple[int, ...] = ORDERS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the bucket of every n-gram of the lower-cased texts, and the place where it starts."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    for n in orders:
        m = len(codes) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint64)
        for j in range(n):
            h *= np.uint64(0x9E3779B97F4A7C15)
            h += codes[j : j + m]
        yield (mix(h) >> np.uint64(64 - BITS)).astype(np.int64), np.arange(m)


def present(texts: list[str], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of the distinct n-grams of each text, of the wanted buckets only where given; sorted."""
    low = [t.lower() for t in texts]
    ends = np.cumsum([len(t) for t in low])
    keys = []
    for n, (bucket, at) in zip(ORDERS, grams(low), strict=False):
        if wanted is not None:
            at = at[wanted[bucket]]
            bucket = bucket[at]
        text = np.searchsorted(ends, at, "right")
        whole = at + n <= ends[text]
        keys.append((text[whole] << BITS) | bucket[whole])
    found = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    return found >> BITS, found & ((1 << BITS) - 1)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


@dataclass
class Model:
    """Weights of the buckets that count, and the intercept."""

    buckets: np.ndarray
    weights: np.ndarray
    intercept: float


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, features: int = FEATURES) -> Model:
    """docs (doc_id, text), labels (doc_id, toxic). Rows with a held-out id are not learned from."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors, VectorUDT

    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("y"))
    known = save(known)
    count = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    pos, neg = count.get(1, 0), count.get(0, 0)
    if not pos or not neg:
        p = float(pos > 0)
        return Model(np.zeros(0, np.int64), np.zeros(0), 50.0 * (2 * p - 1))
    ids = None
    for y, n in ((1, pos), (0, neg)):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).withColumn("w", F.lit(n / min(n, per_class)))
        ids = part if ids is None else ids.union(part)
    sample = docs.where("doc_id IS NOT NULL").select("doc_id", "text").join(F.broadcast(save(ids)), "doc_id")  # at most 2 * per_class ids

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            text, bucket = present(chunk.column("text").to_pylist())
            at = np.searchsorted(text, np.arange(chunk.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(bucket, pa.int32()))
            yield pa.RecordBatch.from_arrays([chunk.column("y"), chunk.column("w"), lists], ["y", "w", "buckets"])

    rows = save(map_batches(sample.select("y", "w", "text"), featurise, "y int, w double, buckets array<int>"))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            y = np.repeat(batch.column("y").to_numpy(), np.diff(batch.column("buckets").offsets.to_numpy()))
            flat = batch.column("buckets").flatten().to_numpy()
            for k in (0, 1):
                held[k] += np.bincount(flat[y == k], minlength=1 << BITS)
        some = np.flatnonzero(held.sum(0))
        for a in range(0, len(some), 1 << 16):
            own = some[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(held[1, own]), pa.array(held[0, own])], ["bucket", "p", "q"])

    found = map_batches(rows, counts, "bucket int, p bigint, q bigint").groupBy("bucket").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    found = save(found)
    total = found.agg(F.sum(F.col("p") + 1).alias("p"), F.sum(F.col("q") + 1).alias("q")).first()
    ratio = F.log((F.col("p") + 1) / float(total["p"] or 1)) - F.log((F.col("q") + 1) / float(total["q"] or 1))
    best = found.where(F.col("p") + F.col("q") >= SUPPORT).select("bucket", ratio.alias("r")).orderBy(F.abs("r").desc(), "bucket").limit(features).collect()
    if not best:
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(pos / neg)))
    buckets = np.array(sorted(r["bucket"] for r in best), np.int64)
    r = np.array([x["r"] for x in sorted(best, key=lambda x: x["bucket"])])

    @F.udf(VectorUDT())  # on at most 2 * per_class rows; Arrow has no sparse vectors
    def vector(own):  # noqa: ANN001, ANN202
        own = np.asarray(own, np.int64)
        at = np.searchsorted(buckets, own)
        hit = (at < len(buckets)) & (buckets[np.minimum(at, len(buckets) - 1)] == own)
        return Vectors.sparse(len(buckets), at[hit].tolist(), r[at[hit]].tolist())

    train = save(rows.select(F.col("y").cast("double").alias("label"), F.col("w").alias("weight"), vector("buckets").alias("features")))
    lr = LogisticRegression(maxIter=60, regParam=1e-4, standardization=False, weightCol="weight").fit(train)
    return Model(buckets, lr.coefficients.toArray() * r, float(lr.intercept))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of each row, 0 to 1, of its whole text alone."""
    shared = docs.sparkSession.sparkContext.broadcast((model.buckets, model.weights))  # `features` numbers at most
    intercept = model.intercept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, weights = shared.value
        weight = np.zeros(1 << BITS)
        weight[buckets] = weights
        wanted = np.zeros(1 << BITS, bool)
        wanted[buckets] = True
        for chunk in text_chunks(batches):
            text, bucket = present(chunk.column("text").to_pylist(), wanted)
            z = intercept + np.bincount(text, weight[bucket], chunk.num_rows)
            yield pa.RecordBatch.from_arrays([chunk.column("id"), pa.array(1 / (1 + np.exp(-np.clip(z, -50, 50))))], ["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, model: Model, reject: float = REJECT) -> DataFrame:
    """docs without the rows that score `reject` or more."""
    shared = docs.sparkSession.sparkContext.broadcast((model.buckets, model.weights))
    intercept, names = model.intercept, docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, weights = shared.value
        weight = np.zeros(1 << BITS)
        weight[buckets] = weights
        wanted = np.zeros(1 << BITS, bool)
        wanted[buckets] = True
        for batch in batches:
            start = 0
            for chunk in text_chunks([pa.RecordBatch.from_arrays([batch.column(at)], ["text"])]):
                text, bucket = present(chunk.column("text").to_pylist(), wanted)
                z = intercept + np.bincount(text, weight[bucket], chunk.num_rows)
                yield batch.slice(start, chunk.num_rows).filter(pa.array(1 / (1 + np.exp(-np.clip(z, -50, 50))) < reject))
                start += chunk.num_rows

    return map_batches(docs, run, docs.schema)
