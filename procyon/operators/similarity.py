"""Trigram set-similarity join by prefix filtering: no nested loop, no pair outside a shared rare trigram.

Trigrams are put in one order for all rows, rarest first, by a class of frequency (counted in CLASSES buckets of their
hashes, so what the driver holds is fixed) and then by hash; a row's prefix is cut from that order within the row.
Candidates share a trigram of both prefixes, far enough from the end of both, have compatible sizes, meet the caller's
own condition, and pass a bound by bitmaps: a bit that one row has and the other lacks is a trigram that it lacks. All
of this is tested while they are joined; what is left is verified exactly.

Where the caller gives blocks, no trigram is shuffled for a block of at most MOST right rows: its rows meet each other
once, under the same bounds, so that a row meets MOST others at most and is shuffled once. Trigrams part larger blocks.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import set_similarity, trigrams
from ..sources.state import materialise

CLASSES, WORDS, MOST = 4096, 4, 1024


def frequency_classes(*rows: DataFrame) -> Column:
    """An array of CLASSES numbers: for each bucket of hashes in `tokens`, half a power of two of how often it occurs."""
    tokens = reduce(DataFrame.union, [r.select(F.explode("tokens").alias("h")) for r in rows])
    counts = {r["bucket"]: r["count"] for r in tokens.groupBy(F.pmod("h", F.lit(CLASSES)).alias("bucket")).count().collect()}
    return F.split(F.lit(",".join(str(int(2 * math.log2(1 + counts.get(i, 0)))) for i in range(CLASSES))), ",").cast("array<int>")


def with_tokens(rows: DataFrame, title: str) -> DataFrame:
    """rows with grams, n, tokens (a hash of each gram) and the bitmap of the tokens in s0, s1, ..."""
    out = rows.withColumn("grams", trigrams(F.col(title))).withColumn("n", F.size("grams")).withColumn("tokens", F.transform("grams", lambda g: F.xxhash64(g)))
    # place of a bit: the word by the lowest bits of the hash, the bit by the next six
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftright(h, 2).bitwiseAND(F.lit(63)).cast("int"))
    own = lambda k: F.filter("tokens", lambda h: F.pmod(h, F.lit(WORDS)) == k)
    none = F.lit(0).cast("bigint")  # never null, so that no filter on nulls computes the bitmaps once more
    return out.withColumns({f"s{k}": F.coalesce(F.aggregate(own(k), none, lambda acc, h: acc.bitwiseOR(bit(h))), none) for k in range(WORDS)})


def signed(rows: DataFrame, title: str = "title") -> DataFrame:
    """rows with n and the bitmap of the tokens of their titles, which joins within blocks then need not make again."""
    return with_tokens(rows, title).drop("grams", "tokens")


def prefixed(rows: DataFrame, classes: Column, least: float, columns: list[str]) -> DataFrame:
    """(columns, token, pos) for the first n - ceil(least n) + 1 tokens of each row, rarest first."""
    ranked = F.array_sort(F.transform("tokens", lambda h: F.struct(F.get(classes, F.pmod(h, F.lit(CLASSES)).cast("int")).alias("c"), h.alias("h"))))
    kept = F.slice(ranked, F.lit(1), F.greatest(F.col("n") - F.ceil(least * F.col("n")) + 1, F.lit(0)).cast("int"))
    return rows.where("n > 0").select(*columns, F.posexplode(kept).alias("pos", "t")).select(*columns, "pos", F.col("t.h").alias("token"))


def similar_pairs(left: DataFrame, right: DataFrame, least: float, key: str = "id", title: str = "title", block: tuple[str, ...] = (), strict: bool = True, extra: Column | None = None, needs: tuple[str, ...] = (), short: int = 0) -> DataFrame:
    """(left_id, right_id, similarity) of rows whose titles' trigram similarity is above (or at) least.

    block: columns that must be equal. extra: a condition on l.* and r.*, of the columns `needs` besides key and block.
    Titles under `short` characters on the left are skipped. Missing titles have no trigrams and are similar to none.
    Right rows are looked at only in blocks that left has; equal keys and repeated rows are rows like others.
    """
    rest = {"least": least, "key": key, "title": title, "block": block, "extra": extra, "needs": needs}
    long = left.where(F.length(title) >= short) if short else left
    if block:
        large = materialise(right.dropna(subset=list(block)).groupBy(*block).count().where(F.col("count") > MOST).select(*block))
        within = lambda df, how: df.join(large, list(block), how)
        if large.isEmpty():
            scored = _within_blocks(long, right, **rest)
        else:
            far = within(right, "left_semi")
            scored = _within_blocks(within(long, "left_anti"), within(right, "left_anti"), **rest)
            scored = scored.union(_by_trigrams(far if long is right else within(long, "left_semi"), far, **rest))
    else:
        scored = _by_trigrams(long, right, **rest)
    return scored.where(F.col("similarity") > least if strict else F.col("similarity") >= least)


def _bounds(least: float) -> Column:
    """What the sizes and the bitmaps of l.* and r.* leave of the pairs: those that may share enough trigrams."""
    l, r = (lambda c: F.col(f"l.{c}")), (lambda c: F.col(f"r.{c}"))
    na, nb = l("n"), r("n")
    lacks = lambda x, y: reduce(lambda p, q: p + q, [F.bit_count(x(f"s{k}").bitwiseAND(F.bitwise_not(y(f"s{k}")))) for k in range(WORDS)])
    shared = least / (1 + least) * (na + nb) - 1e-9  # so many trigrams must be common
    return (na >= least * nb) & (nb >= least * na) & (na - lacks(l, r) >= shared) & (nb - lacks(r, l) >= shared)


def _within_blocks(left: DataFrame, right: DataFrame, least: float, key: str, title: str, block: tuple[str, ...], extra: Column | None, needs: tuple[str, ...]) -> DataFrame:
    """(left_id, right_id, similarity) of all rows of equal blocks that the bounds leave; a row carries its title only."""
    columns, made = list(dict.fromkeys([key, *block, *needs, title])), ["n", *[f"s{k}" for k in range(WORDS)]]
    ready = lambda df: df.select(*columns, *made) if set(made) <= set(df.columns) else signed(df.select(*columns), title)
    fits = reduce(lambda p, q: p & q, [F.col(f"l.{c}") == F.col(f"r.{c}") for c in block]) & _bounds(least)
    pairs = ready(left).alias("l").join(ready(right).alias("r"), fits if extra is None else fits & extra)
    both = F.size(F.array_intersect(trigrams(F.col(f"l.{title}")), trigrams(F.col(f"r.{title}"))))
    either = F.col("l.n") + F.col("r.n") - both
    # exploded, for a filter on a plain column would go before the bounds and compare the trigrams of all pairs
    return pairs.select(F.col(f"l.{key}").alias("left_id"), F.col(f"r.{key}").alias("right_id"), F.explode(F.array(F.when(either > 0, both / either).otherwise(0.0))).alias("similarity"))


def _by_trigrams(left: DataFrame, right: DataFrame, least: float, key: str, title: str, block: tuple[str, ...], extra: Column | None, needs: tuple[str, ...]) -> DataFrame:
    """(left_id, right_id, similarity) of rows that share a trigram of both prefixes and that the bounds leave."""
    columns = list(dict.fromkeys([key, *block, *needs]))
    gramed = lambda df: materialise(with_tokens(df.select(*dict.fromkeys([*columns, title])), title).drop(*({title} - set(columns))))
    if left is right:
        left = right = gramed(right)
    else:
        left = gramed(left)
        right = gramed(right.join(left.select(*block).distinct(), list(block), "left_semi") if block else right)
    classes = frequency_classes(*([right] if left is right else [left, right]))
    used = [*columns, "n", *[f"s{k}" for k in range(WORDS)]]
    a, b = prefixed(left, classes, least, used).alias("l"), prefixed(right, classes, least, used).alias("r")
    l, r = (lambda c: F.col(f"l.{c}")), (lambda c: F.col(f"r.{c}"))
    fits = _bounds(least) & (F.least(l("n") - l("pos"), r("n") - r("pos")) >= least / (1 + least) * (l("n") + r("n")) - 1e-9)
    same = reduce(lambda p, q: p & q, [l(c) == r(c) for c in ("token", *block)])
    pairs = a.join(b, same & fits if extra is None else same & fits & extra).select(l(key).alias("left_id"), r(key).alias("right_id")).distinct()
    one, two = left.select(F.col(key).alias("left_id"), F.col("grams").alias("lg")), right.select(F.col(key).alias("right_id"), F.col("grams").alias("rg"))
    return pairs.join(one, "left_id").join(two, "right_id").select("left_id", "right_id", set_similarity(F.col("lg"), F.col("rg")).alias("similarity"))


def duplicate_candidates(df: DataFrame, least: float, key: str = "id", title: str = "title", block: tuple[str, ...] = ()) -> DataFrame:
    """All pairs of a table, smaller id first."""
    return similar_pairs(df, df, least, key, title, block, extra=F.col(f"l.{key}") < F.col(f"r.{key}"))


def duplicate_classes(df: DataFrame, least: float, key: str = "id", title: str = "title") -> DataFrame:
    """(kind, left_id, right_id, similarity): 'member' rows give every row (right) its representative (left), the smallest
    id of its title in lower case; 'pair' rows are the duplicate_candidates of representatives. Missing titles stay apart.
    """
    rows = df.select(F.col(key).alias("id"), F.lower(title).alias("title"))
    kept = rows.where("title IS NOT NULL").groupBy("title").agg(F.min("id").alias("first"))
    members = rows.join(kept, "title", "left").select(F.lit("member").alias("kind"), F.coalesce("first", "id").alias("left_id"), F.col("id").alias("right_id"), F.lit(None).cast("double").alias("similarity"))
    pairs = duplicate_candidates(kept.select(F.col("first").alias("id"), "title"), least)
    return pairs.select(F.lit("pair").alias("kind"), "left_id", "right_id", "similarity").union(members)
