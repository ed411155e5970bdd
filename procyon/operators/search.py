"""Ranked and boolean full-text search over an inverted index table."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed list: words that are not indexed.
STOP = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "in", "is", "it", "its", "of", "on", "or", "that", "the", "to", "was", "were", "will", "with")

_STEPS = (("ational", "ate"), ("ization", "ize"), ("fulness", "ful"), ("iveness", "ive"), ("ousness", "ous"), ("tional", "tion"), ("ements", ""), ("ations", ""), ("ement", ""), ("ation", ""), ("ities", ""), ("ings", ""), ("ies", "i"), ("ing", ""), ("ity", ""), ("sses", "ss"), ("ed", ""), ("es", ""), ("ly", ""), ("y", "i"), ("s", ""))


def stem_word(word: str) -> str:
    """A light suffix stemmer: the longest suffix that leaves three letters, then a doubled consonant and a final e."""
    for suffix, to in _STEPS:
        if word.endswith(suffix) and len(word) - len(suffix) >= 3 and not word.endswith("ss"):
            word = word[: len(word) - len(suffix)] + to
            break
    word = re.sub(r"([bdfgmnprt])\1$", r"\1", word)
    return word[:-1] if word.endswith("e") and len(word) > 3 else word


@F.pandas_udf(StringType())
def stem(words: pd.Series) -> pd.Series:
    return words.map(stem_word)


def inverted_index(df: DataFrame, text: str, key: str = "id", stemmed: bool = True) -> DataFrame:
    """(term, key, tf, words). Stems are made once for each distinct token."""
    tokens = df.select(key, F.explode(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), 0)).alias("token"))
    counted = tokens.where(~F.col("token").isin(*STOP)).groupBy(key, "token").agg(F.count("*").alias("tf"))
    if stemmed:
        terms = counted.select("token").distinct().withColumn("term", stem("token"))
        counted = counted.join(terms, "token").groupBy(key, "term").agg(F.sum("tf").alias("tf"))
    else:
        counted = counted.withColumnRenamed("token", "term")
    sizes = counted.groupBy(key).agg(F.sum("tf").alias("words"))
    return counted.join(sizes, key).select("term", key, "tf", "words")


def query_terms(q: str, stemmed: bool = True) -> list[str]:
    words = [w for w in re.findall(r"\w+", q.lower()) if w not in STOP]
    return sorted({stem_word(w) if stemmed else w for w in words})


def search_ranked(index: DataFrame, q: str, key: str = "id", stemmed: bool = True) -> DataFrame:
    """(key, rank) of the rows that hold all terms, best first; rank is the sum of tf / (1 + ln words)."""
    terms = query_terms(q, stemmed)
    hits = index.where(F.col("term").isin(terms)).groupBy(key).agg(F.count("*").alias("n"), F.sum(F.col("tf") / (1 + F.log("words"))).alias("rank"))
    return hits.where(F.col("n") == len(terms)).select(key, F.round("rank", 6).alias("rank")).orderBy(F.col("rank").desc(), key)


def search_boolean(index: DataFrame, any_of: list[list[str]], key: str = "id") -> DataFrame:
    """Keys that match any group of terms; in a group all must hold; `word*` is a prefix. Terms as indexed."""
    from functools import reduce

    def match(t: str):  # noqa: ANN202
        return F.col("term").startswith(t[:-1]) if t.endswith("*") else F.col("term") == t

    wanted = sorted({t for g in any_of for t in g})
    rows = index.where(reduce(lambda a, b: a | b, [match(t) for t in wanted])).groupBy(key).agg(*[F.bool_or(match(t)).alias(f"t{i}") for i, t in enumerate(wanted)])
    groups = [reduce(lambda a, b: a & b, [F.col(f"t{wanted.index(t)}") for t in g]) for g in any_of]
    return rows.where(reduce(lambda a, b: a | b, groups)).select(key)
