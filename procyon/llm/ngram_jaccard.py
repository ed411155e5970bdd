"""N-gram Jaccard join by grouped prefixes.

A document's set is its distinct word k-shingles, hashed to 64 bits. Any two sets with Jaccard similarity of at least t
share a token among the first |x| - ceil(t |x|) + 1 of each, in any one order of all tokens. The order here is rare
tokens first, by a count sketch of fixed size over all documents, so that passages in many documents come last.

1. Sketch: one pass counts tokens by 20 bits of their hash (summed by bucket; 2^20 numbers in all).
2. Sets: one pass gives each row's set size, set hash, prefix and parity bitmap. Equal sets collapse to one vertex, and
   vertices with the same size and prefix to one group; only groups are dealt out by token. Of tokens whose lists hold
   the same groups the first in the order stays, as it is the first that any two of these groups share.
3. Turns join each group with the group before it on each token's list (by size, then in orders of chance), and each
   vertex with the one before it in its group; per vertex only its nearest by bitmap goes on. Verified pairs give
   components. Lists that hold one component only are done, and those on which no two groups are of one component have
   no more turns; turns end when they find few links for the rows they look at. Groups whose members fall apart are taken apart. Long lists are ordered in parts of about `PART`
   groups, and the parts linked by their first groups. Of lists of at most `SHORT` groups, each of one vertex, the first
   turn takes all pairs, so they are done; what bitmaps leave of their pairs waits for the end.
4. At the end the group pairs on the lists left are filtered by size and position, their members, whose components
   differ, by bitmap: a big class of near copies is one component by then, so its pairs are not looked at; no link
   between components is lost. Lists are equi-joined by token, so that a long one may be split among tasks.

A pair is verified exactly: the bitmap bounds the overlap from above, then the sets are intersected.

Edge cases: null and empty texts have an empty set, which links with nothing; fewer than k words are one shingle; rows
with one doc_id and different texts are one document with several sets; null ids link with nothing and have no
component; extra columns are ignored by `components_of`, kept by `keep_one`; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import components, gram_hashes, map_batches, mix, save, sketch, text_buffers, text_chunks, unused, word_hashes

SKETCH_BITS, BITMAP_BITS = 20, (8, 14)
NEAREST, TURNS, YIELD, PART, SHORT = 1, 6, 100, 4096, 4
BLOOM_BITS = 23


def shingles(chunk: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, one after another, and where each text's begin (n + 1)."""
    words, first = word_hashes(*text_buffers(chunk.column("text")), lower=True)
    grams = gram_hashes(words, k)
    counts = np.diff(first)
    n = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(n)])
    out = np.empty(begin[-1], np.uint64)
    for i, (a, m) in enumerate(zip(first[:-1], n, strict=True)):
        own = out[begin[i] : begin[i + 1]]
        if counts[i] >= k:
            own[:] = grams[a : a + m]
            own.sort()
        elif m:
            own[:] = gram_hashes(words[a : a + counts[i]], int(counts[i]))
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[begin[:-1][n > 0]] = True
    return out[new], np.concatenate([[0], np.cumsum(new)])[begin]


def token_counts(docs: DataFrame, k: int) -> np.ndarray:
    """How often each bucket of tokens occurs, over all documents: 2^20 numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        held = np.zeros(1 << SKETCH_BITS, np.int64)
        for chunk in text_chunks(batches):
            np.add.at(held, (shingles(chunk, k)[0] >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
        return held

    return sketch(docs.select("text"), 1 << SKETCH_BITS, run)


def rarity(counts: np.ndarray, steps: float = 25) -> np.ndarray:
    """A class of 0 to 63 for each bucket: how far its count is above the mean, by so many steps to a factor of e."""
    mean = max(counts.sum() / max((counts > 0).sum(), 1), 1)
    return np.clip(np.log(np.maximum(counts, 1) / mean) * steps, 0, 63).astype(np.uint8)


def _bitmap(own: np.ndarray) -> np.ndarray:
    """The parity of the tokens in each of 256 classes, of as many as there are tokens for larger sets; halves fold by XOR."""
    bits = min(max(BITMAP_BITS[0], (len(own) - 1).bit_length()), BITMAP_BITS[1])
    at = (mix(own) & np.uint64((1 << bits) - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=1 << bits) & 1, bitorder="little").view("<i8")


def bits_apart(x: Column, y: Column) -> Column:
    """How many bits of two parity bitmaps differ, the longer folded to the shorter; 0 if they are too unlike in size."""
    def fold(v: Column) -> Column:
        n = F.floor(F.size(v) / 2).cast("int")
        return F.zip_with(F.slice(v, 1, n), F.slice(v, n + 1, n), lambda p, q: p.bitwiseXOR(q))

    def count(p: Column, q: Column) -> Column:
        return F.aggregate(F.zip_with(p, q, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda n, c: n + c)

    m, n = F.size(x), F.size(y)
    return F.when(m == n, count(x, y)).when(m == 2 * n, count(fold(x), y)).when(n == 2 * m, count(x, fold(y))).otherwise(F.lit(0))


def may_link(percent: int, na: Column, nb: Column, apart: Column) -> Column:
    """overlap <= (na + nb - apart) / 2, and a link needs overlap >= t (na + nb) / (1 + t)."""
    return (100 + percent) * (na + nb - apart) >= 2 * percent * (na + nb)


def prefixes(docs: DataFrame, k: int, percent: int, order: np.ndarray) -> DataFrame:
    """(doc_id, n, s1, s2, prefix, bitmap): set size, set hash of 128 bits, the prefix in the order, parity bitmap."""
    shared = docs.sparkSession.sparkContext.broadcast(order)  # 2^20 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = shared.value
        for chunk in text_chunks(batches):
            sets, begin = shingles(chunk, k)
            key = rank[(sets >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(58) | sets >> np.uint64(6)
            n = np.diff(begin)
            lists, bits, s1, s2 = [], [], np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            other = mix(sets ^ np.uint64(0x5851F42D4C957F2D))
            for i, (a, b) in enumerate(zip(begin[:-1], begin[1:], strict=True)):
                if a == b:
                    lists.append(np.zeros(0, np.int64))
                    bits.append(lists[-1])
                    continue
                p = b - a - -(-percent * (b - a) // 100) + 1
                own = np.sort(key[a:b])[:p]
                lists.append(own.view(np.int64))
                bits.append(_bitmap(sets[a:b]))
                s1[i], s2[i] = sets[a:b].sum(dtype=np.uint64).view(np.int64), other[a:b].sum(dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), pa.array(n, pa.int64()), pa.array(s1), pa.array(s2), _lists(lists), _lists(bits)], ["doc_id", "n", "s1", "s2", "prefix", "bitmap"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, n bigint, s1 bigint, s2 bigint, prefix array<bigint>, bitmap array<bigint>")


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    at = np.concatenate([[0], np.cumsum([len(x) for x in arrays])])
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays])))


def bloom(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of fixed size, 1 MB, over ids (doc_id): with more ids it only lets more others through."""
    spots = ids.select(F.explode(F.array(*_spots())).alias("spot"))
    words = spots.groupBy(F.shiftright("spot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(spot & 63))")).alias("bits")).toArrow()
    out = np.zeros(1 << (BLOOM_BITS - 6), np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out


def _spots() -> list[Column]:
    return [F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(i)), 64 - BLOOM_BITS) for i in (1, 2)]


def _verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of vertices whose sets link.

    Sets are made from the texts again, in one pass that a Bloom filter of the pairs' ids lets few documents through,
    so that no text is shuffled; each set is shuffled to its pairs.
    """
    wanted = save(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct())
    shared = docs.sparkSession.sparkContext.broadcast(bloom(wanted))  # 1 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            hit = np.ones(batch.num_rows, bool)
            for spot in ("s0", "s1"):
                at = batch.column(spot).to_numpy()
                hit &= (bits[at >> 6] >> (at & 63) & 1).astype(bool)
            for chunk in text_chunks([batch.filter(pa.array(hit))]):
                sets, begin = shingles(chunk, k)
                lists = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(sets.view(np.int64)))
                yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), lists], ["doc_id", "tokens"])

    spots = [spot.alias(f"s{i}") for i, spot in enumerate(_spots())]
    sets = map_batches(docs.where("doc_id IS NOT NULL").select("doc_id", "text", *spots), run, "doc_id bigint, tokens array<bigint>").join(wanted, "doc_id", "left_semi")
    sets = save(sets)
    joined = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").withColumn("both", F.size(F.array_intersect("x", "y")))
    linked = (F.col("both") > 0) & (100 * F.col("both") >= percent * (F.size("x") + F.size("y") - F.col("both")))
    return save(joined.where(linked).select("a", "b").distinct())


def _near(pairs: DataFrame, vertices: DataFrame, percent: int) -> DataFrame:
    """The distinct pairs (a, b) that sizes and bitmaps do not rule out, with `apart`, the bitmaps' distance."""
    side = lambda v: vertices.select(F.col("doc_id").alias(v), F.col("n").alias(f"n{v}"), F.col("bitmap").alias(f"m{v}"))
    na, nb = F.col("na"), F.col("nb")
    rows = pairs.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    rows = rows.join(side("a"), "a").join(side("b"), "b").where(100 * F.least(na, nb) >= percent * F.greatest(na, nb))
    rows = rows.select("a", "b", "na", "nb", bits_apart(F.col("ma"), F.col("mb")).alias("apart"))
    return rows.where(may_link(percent, na, nb, F.col("apart"))).select("a", "b", "apart")


def _beside(rest: DataFrame, turn: int, percent: int) -> DataFrame:
    """(a, b): each group of the lists and the one before it there, of another component, in the turn's order."""
    order = ("n", "gid") if turn == 0 else (F.xxhash64("gid", F.lit(turn)), "gid")
    dealt = rest.withColumn("part", F.pmod(F.xxhash64("gid", F.lit(~turn)), F.ceil(F.col("together") / PART)))
    one = W.partitionBy("token", "part").orderBy(*order)
    names = ["head", "component", "n"]
    before = [F.lag(F.struct(*names), i).over(one) for i in range(1, max(SHORT, 2))]
    others = F.array(before[0], *([F.when(F.coalesce("short", F.lit(False)), b) for b in before[1:]] if turn == 0 else []))
    inside = dealt.select(*names, others.alias("others")).select(*names, F.explode("others").alias("o")).select(*names, *[F.col(f"o.{c}").alias(f"{c}_b") for c in names])
    first = dealt.where(F.col("together") > PART).groupBy("token", "part").agg(F.min(F.struct("gid", *names)).alias("f")).select("token", "part", "f.*")
    by = W.partitionBy("token").orderBy("part")
    across = first.select(*names, *[F.lag(c).over(by).alias(f"{c}_b") for c in names])
    fits = (F.col("component") != F.col("component_b")) & (100 * F.least("n", "n_b") >= percent * F.greatest("n", "n_b"))
    return inside.union(across).where(fits).select(F.col("head").alias("a"), F.col("head_b").alias("b"))


def _sorted_out(listed: DataFrame, label: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(quiet, busy): the rows of lists on which more than one component stands; busy ones with their component.

    busy: two groups of the list are of one component, so that another turn may join more. Only rows of linked groups
    are counted: a list is done if all its groups are linked, to one component. Lists with groups that were taken apart
    (short is null there) hold more rows than they count, and never are.
    """
    linked = listed.join(label, "head").groupBy("token", "component").agg(F.count("*").alias("own"), F.max("together").alias("together"), F.bool_or(F.col("short").isNull()).alias("apart"))
    lists = linked.groupBy("token").agg(F.count("*").alias("components"), F.sum("own").alias("linked"), F.max("own").alias("own"), F.max("together").alias("together"), F.bool_or("apart").alias("apart"))
    one = (F.col("components") == 1) & (F.col("linked") == F.col("together")) & ~F.col("apart")
    lists = save(lists.where(one | (F.col("own") > 1)).select("token", one.alias("one")))
    busy = listed.join(lists.where("NOT one").select("token"), "token", "left_semi").join(label, "head", "left")
    quiet = listed.join(lists.select("token"), "token", "left_anti")
    return quiet, save(busy.withColumn("component", F.coalesce("component", "head")))


def _split_apart(listed: DataFrame, groups: DataFrame, sets: DataFrame, label: DataFrame) -> DataFrame:
    """listed with each member of its own, on its group's lists and its first token's, for groups of several components."""
    m = sets.select("gid", "doc_id").join(label.withColumnRenamed("head", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    apart = save(m.groupBy("gid").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("members")).where("lo != hi").select("gid", "members"))
    if apart.isEmpty():
        return listed
    first = groups.join(apart, "gid").select("gid", "n", F.lit(0).alias("pos"), F.get("prefix", F.lit(0)).alias("token"), "members")
    lists = listed.join(apart, "gid").select("gid", "n", "pos", "token", F.col("together") + F.col("members"))
    lists = first.union(lists).groupBy("gid", "n", "pos", "token").agg(F.max("members").alias("together"))
    own = lists.join(sets.select("gid", "doc_id"), "gid").select("token", F.xxhash64("gid", "doc_id").alias("gid"), "n", F.col("doc_id").alias("head"), "pos", "together", F.lit(None).cast("boolean").alias("short"))
    return save(listed.join(apart, "gid", "left_anti").select(*own.columns).union(own))


def classes(docs: DataFrame, k: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(rows, components): rows (doc_id, n, s1, s2) of docs, and (node, component) of the doc_ids that link."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rows = save(prefixes(docs, k, percent, rarity(token_counts(docs, k))))
    ided = rows.where("doc_id IS NOT NULL AND n > 0").withColumn("gid", F.xxhash64("n", "prefix"))
    # Equal sets are one vertex, named by its smallest id; the ids of one set, and the sets of one id, are joined by edges.
    sets = save(ided.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("doc_id"), F.min("gid").alias("gid"), F.min_by("bitmap", "doc_id").alias("bitmap")))
    same = ided.select("doc_id", "n", "s1", "s2").join(sets.select("n", "s1", "s2", F.col("doc_id").alias("rep")), ["n", "s1", "s2"]).where("doc_id != rep").select("doc_id", "rep")
    groups = save(ided.groupBy("gid", "n").agg(F.min("doc_id").alias("head"), F.min_by("prefix", "doc_id").alias("prefix"), (F.min(F.struct("s1", "s2")) == F.max(F.struct("s1", "s2"))).alias("single")))
    posts = groups.select("gid", "n", "head", "single", F.posexplode("prefix").alias("pos", "token"))
    together = posts.groupBy("token").agg(F.count("*").alias("together")).where("together > 1")
    listed = save(posts.join(together, "token").select("token", "gid", "n", "head", "pos", "together", "single"))
    like = listed.groupBy("token").agg(F.count("*").alias("c"), F.min("single").alias("single"), *[F.bit_xor(F.xxhash64("gid", F.lit(i))).alias(f"x{i}") for i in (0, 1)])
    first = like.groupBy("c", "x0", "x1").agg(F.min(F.col("token").bitwiseXOR(F.lit(-(1 << 63)))).alias("token"), F.min((F.col("c") <= SHORT) & F.col("single")).alias("short"))  # in the order, that of unsigned numbers
    listed = save(listed.drop("single").join(first.select(F.col("token").bitwiseXOR(F.lit(-(1 << 63))).alias("token"), "short"), "token"))
    vertices = sets.select("doc_id", "n", "bitmap")
    member = sets.select("gid", "doc_id")
    chain = member.withColumn("before", F.lag("doc_id").over(W.partitionBy("gid").orderBy("doc_id"))).where("before IS NOT NULL")
    found: list[DataFrame] = []
    edges = lambda: reduce(DataFrame.union, found)
    busy, label = listed.withColumn("component", F.col("head")), None
    quiet: list[DataFrame] = []
    for turn in range(TURNS):
        pairs = _beside(busy, turn, percent)
        near = _near(pairs.union(chain.select("doc_id", "before")) if turn == 0 else pairs, vertices, percent)
        if turn == 0:
            near = spare = save(near)
        place = [F.row_number().over(W.partitionBy(side).orderBy("apart", "a", "b")) for side in ("a", "b")]
        near = save(near.withColumn("pa", place[0]).withColumn("pb", place[1]).where(F.least("pa", "pb") <= NEAREST).select("a", "b"))
        new = _verified(near, docs, k, percent)
        found.append(new)
        label = components(edges().toDF("src", "dst")).toDF("head", "component")
        if turn == 0:
            busy = _split_apart(listed.where("NOT short").select("token", "gid", "n", "head", "pos", "together", "short"), groups, sets, label)
        done, busy = _sorted_out(busy.drop("component"), label)
        quiet.append(done)
        if new.count() * YIELD < busy.count() or busy.isEmpty():  # another turn costs more than it saves at the end
            break
    # The pairs on the lists whose components still differ, with groups expanded to their members.
    rest = reduce(DataFrame.union, [x.select("token", "n", "pos", "gid", "head") for x in (*quiet, busy)]).join(member, "gid", "left").withColumn("doc_id", F.coalesce("doc_id", "head")).join(label.withColumnRenamed("head", "doc_id"), "doc_id", "left")
    rest = rest.join(vertices.select("doc_id", "n", "bitmap"), ["doc_id", "n"])
    rest = save(rest.select("token", "n", "pos", "doc_id", F.coalesce("component", "doc_id").alias("component"), "bitmap"))
    x, y = rest.toDF("token", "na", "pa", "a", "ca", "ma"), rest.toDF("token", "nb", "pb", "b", "cb", "mb")
    na, nb = F.col("na"), F.col("nb")
    fits = (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & (100 * F.least(na, nb) >= percent * F.greatest(na, nb))
    # The first token that a linked pair has in common leaves enough tokens behind it in both sets.
    fits &= (100 + percent) * F.least(na - F.col("pa"), nb - F.col("pb")) >= percent * (na + nb)
    fits &= may_link(percent, na, nb, bits_apart(F.col("ma"), F.col("mb")))
    ends = lambda v: label.toDF(v, f"c{v}")
    apart = spare.select("a", "b").join(ends("a"), "a", "left").join(ends("b"), "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    more = save(x.join(y, (x["token"] == y["token"]) & fits).select("a", "b").union(apart).distinct())
    if not more.isEmpty():
        found.append(_verified(more, docs, k, percent))
    return rows.select("doc_id", "n", "s1", "s2"), components(edges().toDF("src", "dst").union(same))


def components_of(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row: the smallest doc_id reachable by links, itself included."""
    rows, found = classes(docs, k, percent)
    return rows.join(found, rows["doc_id"] == found["node"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each class of linked ones: that with the smallest doc_id.

    Equal rows of one id and text count once. Rows of one id with different texts are documents of their own here, each
    kept or dropped by its own links, ahead of others in the choice. Rows without an id, and empty texts, stay.
    """
    many, key = unused(docs, "many", "row_number_of_text")
    repeated = save(docs.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias(many)).count().where("count > 1").select(many))
    keyed = docs.withColumn(key, F.col("doc_id").cast("bigint"))
    if not repeated.isEmpty():
        own = -1 - F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).bitwiseAND(F.lit((1 << 62) - 1))
        again = keyed.join(repeated, keyed["doc_id"] == F.col(many), "left_semi").withColumn(key, own).dropDuplicates([key])
        keyed = save(keyed.join(repeated, keyed["doc_id"] == F.col(many), "left_anti").union(again))
    found = classes(keyed.select(F.col(key).alias("doc_id"), "text"), k, percent)[1]
    gone = save(found.where("node != component").select(F.col("node").alias(many)))
    return keyed.join(gone, keyed[key] == F.col(many), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
