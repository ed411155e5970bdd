"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with cosine >= c are at squared distance <= 2 - 2c. Vectors are rotated (signs and Walsh-Hadamard, fixed)
and split into blocks of dimensions; a pair within the whole budget is within a proportional share of it in one block
at least. So each block is range-joined under its share, and the union of the candidates is verified exactly.

A block's range join deals vectors to the cells of a grid over its first `GRID` coordinates, as wide as the block's
radius. A cell's vectors are packed into tiles of at most `TILE` numbers, once for each block; a tile is home in its
cell and a guest in half of the cells around, and pairs of tiles are made by an equal join on the cell. So a vector is
shuffled a fixed number of times however many tiles it meets: a pair of tiles goes from the join straight into the
worker, one pair at a time, and is never written. Half of a cell's tiles may go to another task (`SPLIT`). Within a
pair, block distances are products of single-precision numbers with slack; candidates are then checked in double
precision. A pair counts in its first block within budget only; counts of links by vector and a spanning forest of its
links leave a pair of tiles, never the pairs of vectors.

Edge cases: null, empty and zero vectors, and those with null or non-finite components, link with nothing; vectors of
different lengths do not link; equal vectors (also under one id) are joined once and linked by their number; null ids
link with nothing and have no component; extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, map_batches, save

LEAST = 0.95
BLOCK, GRID, TILE, SPLIT, SMALL = 8, 2, 1 << 20, 2, 1 << 18
CELL = ["dim", "block", "row", "column"]
AROUND = ((0, 1), (1, -1), (1, 0), (1, 1))  # half of the eight cells around one: those that come after it
SLACK = 1e-5


def rotate(x: np.ndarray) -> np.ndarray:
    """Rows rotated by two rounds of fixed signs and a Walsh-Hadamard transform, padded to a power of two.

    Sums of single pairs of numbers only, so a row's result does not depend on the rows beside it.
    """
    d = 1 << max(3, (x.shape[1] - 1).bit_length())
    y = np.zeros((len(x), d))
    y[:, : x.shape[1]] = x
    for seed in (11, 12):
        y = y * np.random.default_rng(seed).choice([-1.0, 1.0], d)
        h = 1
        while h < d:
            z = y.reshape(len(y), -1, 2, h)
            y = np.stack([z[:, :, 0] + z[:, :, 1], z[:, :, 0] - z[:, :, 1]], 2).reshape(len(y), d)
            h *= 2
        y = y / np.sqrt(d)
    return y


def unit(rows: np.ndarray) -> np.ndarray:
    x = rows.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def element_type(vectors: DataFrame, vector_col: str) -> str:
    """Single-precision components are carried as such, others in double precision; nothing is rounded."""
    return "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"


def distinct_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(rep, vector, copies) of the usable distinct vectors: rep is the smallest id, copies the number of rows."""
    v = F.col("vector")
    usable = F.exists(v, lambda x: x != 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast(element_type(vectors, vector_col)).alias("vector")).where(F.col("id").isNotNull() & v.isNotNull() & F.coalesce(usable, F.lit(False)))
    return rows.groupBy("vector").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))


def cells(distinct: DataFrame, least: float) -> DataFrame:
    """A row for each vector and block: (dim, block, row, column, rep, copies, vector), at the place of its cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column("vector").offsets.to_numpy())
            for d in np.unique(sizes):
                own = np.flatnonzero(sizes == d)
                part = batch.take(pa.array(own))
                y = rotate(unit(part.column("vector").flatten().to_numpy().reshape(len(own), int(d))))
                blocks = y.shape[1] // BLOCK
                width = np.sqrt((2 - 2 * least) / blocks) * (1 + 1e-3) + SLACK
                base = np.floor(y.reshape(len(own), blocks, BLOCK)[:, :, :GRID] / width).astype(np.int64)
                for b in range(blocks):
                    yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(int(d), pa.int32()), len(own)), pa.repeat(pa.scalar(b, pa.int32()), len(own)), pa.array(base[:, b, 0]), pa.array(base[:, b, 1]), part.column("rep"), part.column("copies"), part.column("vector")], ["dim", "block", "row", "column", "rep", "copies", "vector"])

    kind = element_type(distinct, "vector")
    return distinct.select("rep", "copies", "vector").mapInArrow(run, f"dim int, block int, row bigint, column bigint, rep bigint, copies bigint, vector {kind}")


def packed_tiles(dealt: DataFrame, crowd: DataFrame) -> DataFrame:
    """(dim, block, row, column, tile, reps, copies, vectors): a cell's rows as tiles, their numbers as bytes."""
    key = [*CELL, "tile"]
    numbers = np.float32 if element_type(dealt, "vector") == "array<float>" else np.float64

    def pack(group: pa.Table) -> pa.Table:
        flat = lambda c: c.combine_chunks().flatten() if isinstance(c, pa.ChunkedArray) else c.flatten()
        values = [group.column("rep").to_numpy().astype(np.int64), group.column("copies").to_numpy().astype(np.int64), flat(group.column("vector")).to_numpy().astype(numbers)]
        first = [group.column(c).slice(0, 1).combine_chunks() for c in key]
        return pa.Table.from_arrays([*first, *[pa.array([v.tobytes()], pa.binary()) for v in values]], names=[*key, "reps", "copies", "vectors"])

    rows = dealt.join(F.broadcast(crowd), CELL)  # a row for each cell of the grid on the unit ball: bounded by its width
    rows = rows.withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles"))).select(*key, "rep", "copies", "vector")
    return rows.groupBy(*key).applyInArrow(pack, "dim int, block int, row bigint, column bigint, tile bigint, reps binary, copies binary, vectors binary")


def _near(x: np.ndarray, y: np.ndarray, width: float, i: np.ndarray, j: np.ndarray, at: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Groups (rows of x, rows of y) that hold every pair no further apart than width in each coordinate from `at` on.

    Slabs of one coordinate after another: a slab of x meets the slabs of y beside it, until groups are small.
    """
    if len(i) * len(j) <= SMALL or at == x.shape[1]:
        yield i, j
        return
    own, other = np.floor(x[i, at] / width), np.floor(y[j, at] / width)
    i, j = i[np.argsort(own, kind="stable")], j[np.argsort(other, kind="stable")]
    slabs, begin = np.unique(np.sort(own), return_index=True)
    other = np.sort(other)
    for slab, a, b in zip(slabs, begin, np.append(begin[1:], len(i)), strict=True):
        low, high = np.searchsorted(other, slab - 1), np.searchsorted(other, slab + 1, "right")
        if low < high:
            yield from _near(x, y, width, i[a:b], j[low:high], at + 1)


def _links(x: np.ndarray, y: np.ndarray, block: int, least: float, budget: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (of x, of y) that link and whose first block within budget is this one; a group of rows at a time."""
    rx, ry = rotate(x), rotate(y)
    at = slice(block * BLOCK, (block + 1) * BLOCK)
    bx, by = rx[:, at].astype(np.float32), ry[:, at].astype(np.float32)
    one = lambda z: np.ones((len(z), 1), np.float32)
    norm = lambda z: (z * z).sum(1, keepdims=True)
    ax, ay = np.hstack([-2 * bx, norm(bx), one(bx)]), np.hstack([by, one(by), norm(by)])  # their product is the squared distance
    width = np.sqrt(budget + SLACK) * (1 + 1e-3)
    for mine, theirs in _near(bx, by, width, np.arange(len(x)), np.arange(len(y)), GRID):
        step = max(1, (1 << 20) // max(1, len(theirs)))
        other = ay[theirs].T
        for a in range(0, len(mine), step):
            own = mine[a : a + step]
            i, j = np.divmod(np.flatnonzero(ax[own] @ other <= budget + SLACK), len(theirs))
            i, j = own[i], theirs[j]
            for c in range(0, len(i), 1 << 17):
                p, q = i[c : c + (1 << 17)], j[c : c + (1 << 17)]
                near = (x[p] * y[q]).sum(1) >= least - 1e-9
                p, q = p[near], q[near]
                d = rx[p] - ry[q]
                inside = (d * d).reshape(len(p), d.shape[1] // BLOCK, BLOCK).sum(2) <= budget + SLACK / 2
                first = inside.argmax(1) == block
                yield p[first & inside.any(1)], q[first & inside.any(1)]


def _exact(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Whether the cosine of the rows, in double precision, is at least `least`."""
    return (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1))) >= least


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest index that it reaches over the edges (i, j)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        new = new[label]
        if (new == label).all():
            return label
        label = new


def links(distinct: DataFrame, least: float = LEAST) -> DataFrame:
    """(rep, near, n): n other rows link with rep, counted where it is an end of a pair; near is linked with rep, or null."""
    dealt = cells(distinct, least)
    crowd = dealt.groupBy(*CELL).count().select(*CELL, F.ceil(F.col("count") * F.col("dim") / TILE).alias("tiles"))
    crowd = save(crowd)
    tiles = save(packed_tiles(dealt, crowd))
    salts = F.least(F.col("tiles"), F.lit(SPLIT))
    key = [*CELL, "salt"]
    home = tiles.join(F.broadcast(crowd), CELL).withColumn("salt", F.pmod("tile", salts))
    home = home.select(*key, "tile", *[F.col(c).alias(f"own_{c}") for c in ("reps", "copies", "vectors")])
    step = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(a == b == 0).alias("inside")) for a, b in ((0, 0), *AROUND)]))
    guests = tiles.withColumn("s", step).withColumns({"row": F.col("row") - F.col("s.a"), "column": F.col("column") - F.col("s.b")})
    guests = guests.join(F.broadcast(crowd), CELL).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1)))
    guests = guests.select(*key, F.col("tile").alias("other"), F.col("s.inside").alias("inside"), "reps", "copies", "vectors")
    pairs = home.join(guests.hint("merge"), key).where(~F.col("inside") | (F.col("tile") <= F.col("other")))
    pairs = pairs.select("dim", "block", (F.col("inside") & (F.col("tile") == F.col("other"))).alias("same"), "own_reps", "own_copies", "own_vectors", "reps", "copies", "vectors")
    numbers = np.float32 if element_type(distinct, "vector") == "array<float>" else np.float64

    def join(dim: int, block: int, same: bool, own: list[bytes], other: list[bytes]) -> Iterator[pa.RecordBatch]:
        sides = [own] if same else [own, other]
        rep, copies = (np.concatenate([np.frombuffer(s[k], np.int64) for s in sides]) for k in (0, 1))
        raw = np.concatenate([np.frombuffer(s[2], numbers) for s in sides]).astype(np.float64).reshape(len(rep), dim)
        raw = np.ldexp(raw, -np.frexp(np.abs(raw).max(1, keepdims=True))[1])  # by a power of two: no sum of squares leaves the range
        x = unit(raw)
        blocks = (1 << max(3, (dim - 1).bit_length())) // BLOCK
        first = len(own[0]) // 8
        at = 0 if same else first  # where the other side's rows begin
        n, label = np.zeros(len(rep), np.int64), np.arange(len(rep))
        for i, j in _links(x[:first], x[at:], block, least, (2 - 2 * least) / blocks):
            j = j + at
            good = i < j
            i, j = i[good], j[good]
            good = _exact(raw[i], raw[j], least)
            i, j = i[good], j[good]
            np.add.at(n, i, copies[j])
            np.add.at(n, j, copies[i])
            if len(i):
                label = _forest(len(rep), np.concatenate([i, np.arange(len(rep))]), np.concatenate([j, label]))
        hit = np.flatnonzero(n)
        if len(hit):
            yield pa.RecordBatch.from_arrays([pa.array(rep[hit]), pa.array(rep[label[hit]]), pa.array(n[hit])], ["rep", "near", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                dim, block, same, *sides = (batch.column(c)[k].as_py() for c in range(batch.num_columns))
                yield from join(dim, block, same, sides[:3], sides[3:])

    return map_batches(pairs, run, "rep bigint, near bigint, n bigint")


def near_duplicates(vectors: DataFrame, least: float = LEAST, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) of each row: other rows linked, smallest id reachable, whether it is its own."""
    distinct = save(distinct_vectors(vectors, id_col, vector_col))
    found = save(links(distinct, least))
    labels = components(found.select(F.col("rep").alias("src"), F.col("near").alias("dst")))
    counted = found.groupBy("rep").agg(F.sum("n").alias("n"))
    per = distinct.join(counted, "rep", "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    per = save(per.select(F.col("vector").alias("__v"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    rows = vectors.select(F.col(id_col).cast("bigint").alias(id_col), F.col(vector_col).cast(element_type(vectors, vector_col)).alias("__w"))
    out = rows.join(per, (F.col("__w") == F.col("__v")) & F.col(id_col).isNotNull(), "left")
    out = out.select(id_col, F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", id_col).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))
