"""Mixing sources to target weights: Efraimidis-Spirakis sampling to word budgets, complete epochs first.

Every row gets the exponential key -ln(u) / quality, u a fixed hash of its id and text. A source's target is its share
by weight of the mix, at most `most` times its own size; what is above is shared again by weight. The whole epochs in
target / size take every row so many times; the fraction left takes rows in the order of their keys until the prefix
sum is nearest to the budget. The order is cut at one (key, id) per source: key ranges are pre-summed, and only the
range in which the budget ends is sorted, so no source is sorted or gathered as a whole.

Edge cases: null texts have size 0; a null source is a source, the last in order; null ids and repeated rows are
rows of their own (equal rows tie and are taken together); a source of size 0 has target 0 and its rows are taken 0
times beyond whole epochs; an empty table gives none; quality that is null, not finite or not positive counts as 1.
Sources are taken as a small dimension: one row each is sorted in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import map_batches, save, text_buffers, text_chunks, word_spans

WEIGHTS = (5, 2, 1)
SHARE, MOST, RANGES = 1.5, 2, 4096


def sizes(docs: DataFrame, keep: dict[str, Column], text_col: str = "text") -> DataFrame:
    """The kept columns of each row, and size: the number of words `[^\\x20\\x09-\\x0D]+` of its text."""

    names = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches, "__text"):
            n = np.diff(word_spans(*text_buffers(chunk.column("__text")))[2])
            yield pa.RecordBatch.from_arrays([*[chunk.column(c) for c in names], pa.array(n, pa.int64())], [*names, "size"])

    narrow = docs.select(*[v.alias(k) for k, v in keep.items()], F.col(text_col).alias("__text"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in narrow.schema if f.name != "__text")
    return map_batches(narrow, run, f"{kinds}, size bigint")


def key_unit(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """A fixed number in (0, 1) of a row's id and text: 52 bits of their md5."""
    seed = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.md5(text_col), F.lit("")))
    return (F.conv(F.substring(F.md5(seed), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def targets(by_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """by_source (source, source_size) with target: weights repeat over the sources by code point, null last."""
    ranked = by_source.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    cases = F.lit(weights[0])
    for i, w in enumerate(weights[1:], 1):
        cases = F.when(F.col("rank") % len(weights) == i, w).otherwise(cases)
    rows = ranked.withColumn("weight", cases.cast("double")).withColumn("cap", (most * F.col("source_size")).cast("double"))
    order = W.orderBy(F.col("cap") / F.col("weight"), "rank")
    full = F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    every = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = rows.withColumn("total", share * F.sum("source_size").over(every)).withColumn("level", (F.col("total") - full) / left)
    level = level.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "rank", "level"))).over(every)["level"])
    return level.select("source", "source_size", F.least("cap", F.coalesce("level", F.lit(0.0)) * F.col("weight")).alias("target"))


def plan(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, ranges: int = RANGES) -> DataFrame:
    """(source, source_size, target, epochs, last_key, last_id): a row is taken `epochs` times, once more up to the last.

    sized: rows (doc_id, source, size, key).
    """
    goal = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    goal = save(goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")).withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size")))
    place = F.least(F.floor((1 - F.exp(-F.col("key"))) * ranges), F.lit(ranges - 1)).cast("int")
    rows = sized.withColumn("range", place)
    sums = rows.groupBy("source", "range").agg(F.sum("size").alias("words"))
    before = F.coalesce(F.sum("words").over(W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    sums = sums.withColumn("before", before)
    ends = sums.join(goal, same(sums, goal)).where((F.col("before") <= F.col("budget")) & (F.col("budget") < F.col("before") + F.col("words"))).select(sums["source"].alias("s2"), F.col("range").alias("r2"), "before", "budget")
    inside = rows.join(ends, rows["source"].eqNullSafe(ends["s2"]) & (rows["range"] == ends["r2"]))
    tied = inside.groupBy("source", "before", "budget", "key", "doc_id").agg(F.sum("size").alias("words"))
    run = tied.withColumn("upto", F.col("before") + F.sum("words").over(W.partitionBy("source").orderBy("key", F.col("doc_id").asc_nulls_first())))
    fits = run.where((F.col("upto") - F.col("words") / 2) <= F.col("budget"))
    cut = fits.groupBy("source").agg(F.max(F.struct("key", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"))).alias("last"))
    # A budget that ends before the first row of its range that fits is cut at the start of that range.
    cut = ends.join(cut, ends["s2"].eqNullSafe(cut["source"]), "left").select(F.col("s2").alias("s3"), F.coalesce(F.col("last.key"), -F.log(1 - F.col("r2") / ranges)).alias("last_key"), F.coalesce(F.col("last.id"), F.lit(-(1 << 63))).alias("last_id"))
    return save(goal.join(cut, goal["source"].eqNullSafe(cut["s3"]), "left").drop("s3", "budget"))


def taken_times(key: str = "key", id_col: str = "doc_id") -> Column:
    """How often a row is taken; on rows joined with plan()."""
    at = (F.col(key) < F.col("last_key")) | ((F.col(key) == F.col("last_key")) & (F.coalesce(F.col(id_col), F.lit(-(1 << 63))) <= F.col("last_id")))
    return F.coalesce(F.col("epochs"), F.lit(0)) + F.coalesce(at.cast("bigint"), F.lit(0))


def quality_key(id_col: str = "doc_id", text_col: str = "text", quality: Column | None = None) -> Column:
    unit = -F.log(key_unit(id_col, text_col))
    if quality is None:
        return unit
    q = quality.cast("double")
    return unit / F.when(q.isNull() | F.isnan(q) | (q <= 0) | (q == float("inf")), 1.0).otherwise(q)


def mix_table(docs: DataFrame, quality: Column | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of each row."""
    sized = save(sizes(docs, {"doc_id": F.col("doc_id"), "source": F.col("source"), "key": quality_key(quality=quality)}))
    goal = plan(sized).withColumnRenamed("source", "s")
    return sized.join(goal, sized["source"].eqNullSafe(goal["s"])).select("doc_id", "size", "source_size", "target", (F.col("size") * taken_times()).alias("taken"))


def mix(docs: DataFrame, quality: Column | None = None) -> DataFrame:
    """docs as the mix takes them: rows that it takes twice come twice, rows that it does not take are gone."""
    key = quality_key(quality=quality)
    goal = plan(save(sizes(docs, {"doc_id": F.col("doc_id"), "source": F.col("source"), "key": key})))
    # A row travels as one struct, so that none of its columns can clash with those of the plan.
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("source").alias("source"), F.col("doc_id").alias("doc_id"), key.alias("key"))
    goal = goal.select(F.col("source").alias("s"), "epochs", "last_key", "last_id")
    rows = whole.join(goal, whole["source"].eqNullSafe(goal["s"])).withColumn("n", taken_times())
    return rows.where("n > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("n")))).select("row.*")
