"""Pieces that several operators share: shared-folder tables, Arrow helpers, word hashing, components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MAX_CHUNK_BYTES, BATCH_BYTES = 1 << 18, 1 << 20
pa.set_memory_pool(pa.system_memory_pool())  # Arrow's own pool keeps what is freed, in every Python worker
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; a temporary one only where it is unset on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


_scopes: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what was saved within it, but for what was saved with keep: that belongs to the scope around."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def save(df: DataFrame, keep: bool = False) -> DataFrame:
    """Cut lineage: write df as Parquet under the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"
    scope = _scopes[: len(_scopes) - keep]
    if scope:
        scope[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """df.mapInArrow(run, schema), with batches of at most BATCH_BYTES: rows of long texts would else fill a worker.

    The session's bound on the bytes of a batch is lowered to that, and left so, as Spark reads it when the plan runs.
    """
    spark = df.sparkSession
    if int(spark.conf.get(_BATCH, str(64 << 20)).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def unused(df: DataFrame, *names: str) -> list[str]:
    """For each name one that no column of df has, in upper or lower case."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(id_col: str, text_col: str) -> Column:
    """Identifies a row by id and text, so that repeated ids with different texts stay apart; null-safe."""
    return F.md5(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.coalesce(F.col(text_col), F.lit(""))))


def text_chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = MAX_CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of batches whose texts hold at most `limit` bytes together (one row at least); null texts become empty."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        if batch.column(at).null_count:
            batch = batch.set_column(at, batch.schema.field(at), batch.column(at).fill_null(""))
        offsets = text_buffers(batch.column(at))[1]
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


def text_buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (from 0) of a string array without nulls."""
    n = len(array)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = array.buffers()
    kind = np.int64 if pa.types.is_large_string(array.type) else np.int32
    offsets = np.frombuffer(where, kind)[array.offset : array.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_MULT = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_MULT), -1, 1 << 64))
_BYTE, _BYTE_2 = (np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for seed in (20240501, 20240502))
_MULT_2 = np.uint64(0xD1342543DE82EF95)
_INV_2 = np.uint64(pow(int(_MULT_2), -1, 1 << 64))
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.ones(size, np.uint64)
        have[1:] = base
        np.multiply.accumulate(have, out=have)
        _powers[name] = have
    return have[:n]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end bytes of the words `[^\\x20\\x09-\\x0D]+`, and each text's first word (n + 1 numbers)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    white = _WHITE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = True, white[:-1]
    starts = np.flatnonzero(~white & (before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, white[1:]
    ends = np.flatnonzero(~white & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool, second: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, and each text's first word. lower: A-Z as a-z; second: another hash, by other numbers."""
    starts, ends, first = word_spans(data, offsets)
    code, base, inverse = (_BYTE_2, _MULT_2, _INV_2) if second else (_BYTE, _MULT, _INV)
    code = code[_LOWER] if lower else code
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(code[data] * _power(f"up{second}", base, len(data)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power(f"down{second}", inverse, len(data) + 1)[starts]), first


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each k consecutive words, whatever text they are in; len(words) - k + 1 of them."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[i : i + n]
    return mix(out)


LANES = 16  # counters of a sketch that share a row


def sketch(df: DataFrame, length: int, counters: Callable[[Iterator[pa.RecordBatch]], np.ndarray]) -> np.ndarray:
    """The sum over all partitions of counters(batches), arrays of `length` numbers, a multiple of LANES."""
    lanes = [f"c{i}" for i in range(LANES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = counters(batches).reshape(-1, LANES)
        some = np.flatnonzero(held.any(1))
        for a in range(0, len(some), 1 << 13):
            own = some[a : a + (1 << 13)]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), *[pa.array(np.ascontiguousarray(c)) for c in held[own].T]], ["lot", *lanes])

    kinds = ", ".join(f"{c} bigint" for c in lanes)
    total = map_batches(df, run, f"lot int, {kinds}").groupBy("lot").agg(*[F.sum(c).alias(c) for c in lanes]).toArrow()
    out = np.zeros((length // LANES, LANES), np.int64)
    out[total["lot"].to_numpy()] = np.stack([total[c].to_numpy() for c in lanes], 1)
    return out.ravel()


EDGES = 1 << 18


def _stars(seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(node, root) of the nodes of edges: root is the first node, in an order of chance, reachable by a chunk's edges.

    The order of seed 0 is that of the ids. A fixed order would let a long monotone path shrink by its ends only.
    """

    def star(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        ends = np.concatenate([b.column(c).to_numpy() for c in (0, 1) for b in held])
        nodes, at = np.unique(ends, return_inverse=True)
        if seed:
            nodes, place = nodes[order := np.argsort(mix(nodes.view(np.uint64) ^ mix(np.array([seed], np.uint64))))], np.argsort(order)
            at = place[at]
        label = forest(len(nodes), at[: len(at) // 2], at[len(at) // 2 :])
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], ["node", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= EDGES:
                yield star(held)
                held = []
        if held:
            yield star(held)

    return run


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest index that it reaches over the edges (i, j)."""
    label = np.arange(n)
    while len(i):
        a, b = label[i], label[j]
        live = a != b
        i, j, a, b = i[live], j[live], a[live], b[live]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := label[label], label):
            label = up
    return label


def components(edges: DataFrame, lot: int = EDGES) -> DataFrame:
    """(node, component) of each node in edges (src, dst; longs): component is the smallest node reachable.

    Rounds of: each task joins up its own edges and points every node at a root of its part; the roots that tasks point
    one node at are joined by edges, which are the next round's. A round leaves two thirds of a path's nodes, less of
    denser graphs. Tasks get about `lot` edges, so few edges take one round. Only combinable minima and joins: a node
    with very many edges is pre-aggregated by each task. Empty edges give an empty table; loops and repeated edges are
    ignored; nulls are dropped. What the rounds save is deleted when the result is written.
    """
    with scratch(edges.sparkSession):
        return save(_joined_up(edges, lot), keep=True)


def _joined_up(edges: DataFrame, lot: int) -> DataFrame:
    live = edges.where("src < dst OR src > dst").select(F.col("src").cast("bigint"), F.col("dst").cast("bigint"))
    steps: list[DataFrame] = []
    while True:
        live = save(live.distinct())
        parts = max(1, -(-live.count() // lot))
        stars = save(map_batches(live.coalesce(parts), _stars(len(steps)), "node bigint, root bigint"))
        point = save(stars.groupBy("node").agg(F.min("root").alias("component"), F.max("root").alias("other")))
        steps.append(point.select("node", "component"))
        several = point.where("component != other")
        if parts == 1 or several.isEmpty():
            break
        live = stars.join(several.select("node", "component"), "node").where("root != component").select(F.col("root").alias("src"), F.col("component").alias("dst"))
    labels = steps.pop()
    if not steps:
        return labels
    while steps:
        later = labels.toDF("component", "last")
        labels = steps.pop().join(later, "component", "left").select("node", F.coalesce("last", "component").alias("component"))
    labels = save(labels)
    least = labels.groupBy("component").agg(F.min("node").alias("least"))
    return labels.join(least, "component").select("node", F.col("least").alias("component"))
