"""A stored full-text index: posting blocks by term and range of documents, ranked and boolean search over it.

`write_index` stores, for each term and each of a number of ranges of documents (about PER_RANGE in each, or RANGE_BYTES of
text, dealt by hash of their keys), one block: the documents with the term's positions, and how often it occurs in one of them at most. No
block grows with the table. Blocks lie in folders by the first letters of their terms, so that a query, also one for a
prefix, opens its terms' folders only. A common term is as many blocks as there are ranges.

Ranks are those of PostgreSQL's ts_rank with weights of 0.1. One term: 0.1 * (1 + 1/4 + ... + 1/n^2) / (pi^2 / 6) for n
positions. Several: 1 - product of (1 - 0.1 * sqrt(near(d))) over all pairs of positions of different terms, d apart,
near(d) = 1 / (1.005 + 0.05 * e^(d / 1.5 - 2)), 1e-30 beyond 100. A term has its first 256 positions at most, none above
16383, as there; which documents match does not depend on that. `search_top` reads whole blocks only where their bound
can still reach the k best.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stemming import stem_word

# Fixed list: the English stop words of PostgreSQL.
STOP = tuple(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those am is are was were be been being "
    "have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here "
    "there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now".split()
)
WORD = r"[\p{L}\p{N}]+"
MOST_POSITIONS, LAST_POSITION, WEIGHT = 256, 16383, 0.1
PER_RANGE, LETTERS, FOLDERS, WAVE = 4096, 2, 64, 16
RANGE_BYTES, TASK_RANGES, FOLDER_RANGES = 16 << 20, 4, 128
_STOPS = frozenset(STOP)


def _postings(rows: pa.Table, stemmed: bool) -> pa.Table:
    """The blocks of one range, from its (range, key, words) rows: one for each term, rows of equal keys being one document."""
    words = rows["words"].combine_chunks()
    sizes = pc.list_value_length(words).to_numpy()
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
    keys = rows["key"].combine_chunks().dictionary_encode(null_encoding="encode")
    doc = np.repeat(keys.indices.to_numpy(), sizes)
    coded = words.flatten().dictionary_encode()
    own = [None if w in _STOPS else stem_word(w) if stemmed else w for w in coded.dictionary.to_pylist()]
    terms = sorted({t for t in own if t is not None})
    place = {t: i for i, t in enumerate(terms)} | {None: -1}
    term = np.array([place[t] for t in own], dtype=np.int64)[coded.indices.to_numpy()]
    order = np.lexsort((at, doc, term))[np.count_nonzero(term < 0) :]
    term, doc, at = term[order], doc[order], np.minimum(at[order], LAST_POSITION)
    first = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])][: len(term)])  # of each document of a term
    count = np.diff(np.r_[first, len(term)])
    kept = np.arange(len(term)) - np.repeat(first, count) < MOST_POSITIONS
    count, term, doc = np.minimum(count, MOST_POSITIONS), term[first], doc[first]
    block = np.flatnonzero(np.r_[True, term[1:] != term[:-1]][: len(term)])
    ends = lambda sizes: pa.array(np.r_[0, np.cumsum(sizes)], pa.int32())
    positions = pa.ListArray.from_arrays(ends(count), pa.array(at[kept], pa.int32()))
    docs = pa.StructArray.from_arrays([keys.dictionary.take(pa.array(doc)), positions], ["key", "positions"])
    docs = pa.ListArray.from_arrays(pa.array(np.r_[block, len(term)], pa.int32()), docs)
    most = np.maximum.reduceat(count, block) if len(block) else count
    n = rows["range"][0].as_py()
    return pa.table({"term": pa.array(terms, pa.string()), "range": pa.array([n] * len(terms), pa.int32()), "docs": docs, "most": pa.array(most, pa.int32())})


def query_terms(q: str, stemmed: bool = True) -> list[str]:
    words = [w for w in re.findall(r"[^\W_]+", q.lower()) if w not in STOP]
    return sorted({stem_word(w) if stemmed else w for w in words})


def near(distance: int) -> float:
    return 1e-30 if distance > 100 else 1 / (1.005 + 0.05 * math.exp(distance / 1.5 - 2))


def rank_of(positions: list[Column]) -> Column:
    """The rank of a document that has these arrays of positions, one for each term of the query."""
    if len(positions) == 1:
        squares = F.aggregate(F.sequence(F.lit(1), F.size(positions[0])), F.lit(0.0), lambda acc, j: acc + 1 / (j * j).cast("double"))
        return WEIGHT * squares / (math.pi**2 / 6)
    away = lambda p, q: F.abs(p - q)
    close = lambda d: F.when(d > 100, F.lit(1e-30)).otherwise(1 / (1.005 + 0.05 * F.exp(d / 1.5 - 2)))

    def pairs(a: Column, b: Column) -> Column:
        within = lambda p: F.aggregate(b, F.lit(1.0), lambda acc, q: acc * (1 - WEIGHT * F.sqrt(close(away(p, q)))))
        return F.aggregate(a, F.lit(1.0), lambda acc, p: acc * within(p))

    return 1 - reduce(lambda x, y: x * y, [pairs(a, b) for i, a in enumerate(positions) for b in positions[i + 1 :]])


def bound_of(most: list[Column]) -> Column:
    """The highest rank of any document of which each term has at most so many positions."""
    if len(most) == 1:
        return rank_of([F.sequence(F.lit(1), most[0])])
    pairs = reduce(lambda x, y: x + y, [a * b for i, a in enumerate(most) for b in most[i + 1 :]])
    return 1 - F.pow(F.lit(1 - WEIGHT * math.sqrt(near(0))), pairs)


def folder_of(start: Column) -> Column:
    """The folder of a term or of a prefix of LETTERS letters."""
    return F.pmod(F.xxhash64(F.substring(start, 1, LETTERS)), F.lit(FOLDERS)).cast("int")


def write_index(df: DataFrame, text: str, path: str, key: str = "id", stemmed: bool = True) -> None:
    """Blocks (folder, term, range, docs array<struct<key, positions>>, most) under path/blocks, and path/about.

    Documents, not their words, are dealt to ranges, whose blocks are then made in one place; null and empty texts have no
    terms, rows of equal keys are one document, and stop words take up positions but are no terms.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("key"), F.lower(F.coalesce(text, F.lit(""))).alias("text"))
    size = rows.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    ranges = max(1, -(-size[0] // PER_RANGE), -(-(size[1] or 0) // RANGE_BYTES))
    kind = rows.schema["key"].dataType.simpleString()
    placed = rows.select(F.pmod(F.xxhash64("key"), F.lit(ranges)).cast("int").alias("range"), "key", "text")
    # as many parts as the session's, or more where those would hold many ranges each
    placed = placed.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-ranges // TASK_RANGES)), "range")
    words = placed.select("range", "key", F.regexp_extract_all("text", F.lit(WORD), 0).alias("words"))
    blocks = words.groupBy("range").applyInArrow(lambda rows: _postings(rows, stemmed), f"term string, range int, docs array<struct<key: {kind}, positions: array<int>>>, most int")
    blocks = blocks.withColumn("folder", folder_of(F.col("term")))
    # a folder is a file for each FOLDER_RANGES ranges, so that a common term goes to several tasks
    stretch = F.floor(F.col("range") / FOLDER_RANGES)
    blocks.repartition("folder", stretch).sortWithinPartitions("folder", "term", "range").write.mode("overwrite").partitionBy("folder").parquet(f"{path}/blocks")
    folders = sorted(r["folder"] for r in spark.read.schema("term string, folder int").parquet(f"{path}/blocks").select("folder").distinct().collect())
    spark.createDataFrame([(ranges, stemmed, kind, folders)], "ranges int, stemmed boolean, kind string, folders array<int>").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")


class Index:
    """A stored index, opened for queries."""

    def __init__(self, spark: SparkSession, path: str):
        about = spark.read.parquet(f"{path}/about").first()
        self.spark, self.path, self.stemmed, self.folders = spark, path, about["stemmed"], set(about["folders"])
        self.schema = f"term string, range int, docs array<struct<key: {about['kind']}, positions: array<int>>>, most int"

    def terms(self, q: str) -> list[str]:
        return query_terms(q, self.stemmed)

    def blocks(self, terms: list[str]) -> DataFrame:
        """The blocks of terms, `word*` being all that begin so; only their folders are read."""
        starts = [t.rstrip("*") for t in terms]
        wanted = set(self.folders)
        if all(len(s) >= LETTERS or not t.endswith("*") for s, t in zip(starts, terms, strict=True)) and terms:
            rows = self.spark.range(1).select(F.array(*[folder_of(F.lit(s)) for s in starts]).alias("f")).first()
            wanted &= set(rows["f"])
        reader = self.spark.read.schema(self.schema)
        df = reader.parquet(*[f"{self.path}/blocks/folder={f}" for f in sorted(wanted)]) if wanted else self.spark.createDataFrame([], self.schema)
        return df.where(reduce(lambda a, b: a | b, [matches(F.col("term"), t) for t in terms], F.lit(False)))

    def search(self, q: str) -> DataFrame:
        """(key, rank) of all documents that hold every term."""
        terms = self.terms(q)
        return self._ranked(self.blocks(terms), terms)

    def _ranked(self, blocks: DataFrame, terms: list[str]) -> DataFrame:
        rows = blocks.select("term", F.explode("docs").alias("doc")).select("term", "doc.*")
        own = [F.max(F.when(F.col("term") == t, F.col("positions"))).alias(f"p{i}") for i, t in enumerate(terms)]
        if not terms:
            return rows.select("key", F.lit(0.0).alias("rank"))
        whole = rows.groupBy("key").agg(*own).dropna(subset=[f"p{i}" for i in range(len(terms))])
        return whole.select("key", F.round(rank_of([F.col(f"p{i}") for i in range(len(terms))]), 9).alias("rank"))

    def bounds(self, terms: list[str]) -> DataFrame:
        """(range, bound) of the ranges where all terms occur: no document there ranks higher. No document is read."""
        own = [F.max(F.when(F.col("term") == t, F.col("most"))).alias(f"m{i}") for i, t in enumerate(terms)]
        found = self.blocks(terms).select("term", "range", "most").groupBy("range").agg(*own).dropna()
        return found.select("range", (bound_of([F.col(f"m{i}") for i in range(len(terms))]) + 1e-9).alias("bound"))

    def search_top(self, q: str, k: int = 20, told: Callable[[int], None] | None = None) -> DataFrame:
        """The k best of search(q), the smaller key first among equal ranks. told: gets the number of ranges read.

        First the ranges of the highest bounds; then those whose bound reaches the k-th best rank found there.
        """
        terms = self.terms(q)
        if not terms:
            return self.search(q).limit(0)
        bounds = self.bounds(terms)
        first = [r["range"] for r in bounds.orderBy(F.desc("bound"), "range").limit(WAVE).collect()]
        blocks = self.blocks(terms)
        best = lambda df: df.orderBy(F.desc("rank"), "key").limit(k)
        found = best(self._ranked(blocks.where(F.col("range").isin(first)), terms)).collect()
        least = found[-1]["rank"] if len(found) == k else 0.0
        rest = bounds.where(~F.col("range").isin(first) & (F.col("bound") >= least))
        if told:
            told(len(first) + rest.count())
        more = self._ranked(blocks.join(rest.select("range"), "range", "left_semi"), terms)
        return best(self.spark.createDataFrame(found, more.schema).union(more))

    def search_any(self, any_of: list[list[str]]) -> DataFrame:
        """(key) of documents that match any group of terms; in a group all must hold; `word*` is a prefix."""
        plain = lambda t: t if t.endswith("*") or not self.stemmed else stem_word(t)
        groups = [[plain(t.lower()) for t in g] for g in any_of]
        wanted = sorted({t for g in groups for t in g})
        rows = self.blocks(wanted).select("term", F.explode("docs.key").alias("key"))
        held = rows.groupBy("key").agg(*[F.bool_or(matches(F.col("term"), t)).alias(f"t{i}") for i, t in enumerate(wanted)])
        hit = [reduce(lambda a, b: a & b, [F.col(f"t{wanted.index(t)}") for t in g]) for g in groups]
        return held.where(reduce(lambda a, b: a | b, hit)).select("key")


def matches(term: Column, wanted: str) -> Column:
    return term.startswith(wanted[:-1]) if wanted.endswith("*") else term == wanted
