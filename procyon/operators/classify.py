"""Rule-driven assignment: municipalities, categories, document types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse_whitespace

# Fixed rules: document type, keywords, base score; earlier ones win ties.
DOCUMENT_RULES = (
    ("ADDENDUM", ("addendum", "amendment", "erratum", "corrigendum", "notice of change"), 0.9),
    ("AWARD_NOTICE", ("award", "awarded bidder", "successful bidder", "appointment of"), 0.9),
    ("BRIEFING_NOTES", ("briefing", "site meeting", "compulsory meeting", "minutes of the briefing"), 0.85),
    ("BID_FORM", ("sbd 1", "sbd1", "sbd 4", "sbd 6", "returnable", "bid form", "declaration form"), 0.8),
    ("SPECIFICATION", ("specification", "scope of work", "terms of reference", "bill of quantities", "boq"), 0.8),
    ("RFQ_DOCUMENT", ("rfq", "request for quotation", "quotation document"), 0.8),
    ("TENDER_DOCUMENT", ("tender document", "bid document", "rfp", "rfb", "tender pack"), 0.75),
    ("ADVERT", ("advert", "advertisement", "invitation to bid", "notice to bidders"), 0.7),
)
HAYSTACKS = (1.0, 0.95, 0.8)
TEXT_WINDOW = 4000


def resolve_municipality(df: DataFrame, name: str, municipalities: DataFrame) -> DataFrame:
    """df with municipality_id: the one municipality whose name, slug or code it is, in any case; else null."""
    alias = municipalities.select("id", F.explode(F.array(*[F.lower(c) for c in ("name", "slug", "code")])).alias("__alias")).groupBy("__alias").agg(F.countDistinct("id").alias("n"), F.min("id").alias("municipality_id")).where("n = 1").drop("n")
    keyed = df.withColumn("__alias", F.lower(collapse_whitespace(F.col(name))))
    return keyed.join(alias, "__alias", "left").drop("__alias")


def assign_categories(df: DataFrame, categories: DataFrame) -> DataFrame:
    """(opportunity_id, category_id, assigned_by) wherever a category's keyword occurs in title or description.

    categories (id, keywords) is a rule table, of a few rows: its size is checked before it becomes a plan of conditions.
    """
    rules = categories.select("id", "keywords").orderBy("id").limit(1001).collect()
    if len(rules) > 1000:
        raise ValueError("more than 1000 categories: link them by an index of terms instead")
    low = F.lower(F.concat_ws(" ", "title", "description"))
    hits = F.array(*[F.when(_any(low, tuple(r["keywords"])), F.lit(r["id"])) for r in rules])
    links = df.select(F.col("id").alias("opportunity_id"), F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("category_id"))
    return links.withColumn("assigned_by", F.lit("RULE"))


def _any(low: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(low, F.lit(w))
    return out


def classify_documents(df: DataFrame, rules: tuple = DOCUMENT_RULES, filename: str = "filename", title: str | None = None, text: str | None = None) -> DataFrame:
    """df with document_type, confidence and matched_keyword: the best of rules times where the keyword stands."""
    low = [F.lower(F.coalesce(F.col(filename), F.lit(""))), F.lower(F.coalesce(F.col(title), F.lit(""))) if title else None, F.lower(F.substring(F.coalesce(F.col(text), F.lit("")), 1, TEXT_WINDOW)) if text else None]
    tries = []
    for i, (kind, words, base) in enumerate(rules):
        for j, (hay, weight) in enumerate(zip(low, HAYSTACKS, strict=True)):
            if hay is not None:
                word = F.lit(None).cast("string")
                for w in reversed(words):
                    word = F.when(F.contains(hay, F.lit(w)), F.lit(w)).otherwise(word)
                tries.append(F.when(word.isNotNull(), F.struct(F.lit(round(base * weight, 3)).alias("score"), F.lit(-(i * 3 + j)).alias("order"), F.lit(kind).alias("kind"), word.alias("word"))))
    best = F.greatest(*tries) if len(tries) > 1 else tries[0]
    return df.withColumn("__best", best).withColumn("document_type", F.coalesce("__best.kind", F.lit("UNKNOWN"))).withColumn("confidence", F.coalesce("__best.score", F.lit(0.0))).withColumn("matched_keyword", F.col("__best.word")).drop("__best")
