"""Text cleaning and light extraction as column expressions."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Patterns and symbols that decide what is recognised.
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
PHONE = r"(?:\+27|0)(?:[\s\-().]?[0-9]){8,11}"
MONEY = r"(?i)(R|ZAR|USD|EUR|\$|€|£)\s?([0-9][0-9\s,.]*[0-9]|[0-9])"
SYMBOLS = {"R": "ZAR", "$": "USD", "€": "EUR", "£": "GBP"}


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(StringType())
def _nfkc_list(lists: pd.Series) -> pd.Series:
    plain = lambda v: None if v is None else unicodedata.normalize("NFKC", v)
    return lists.map(lambda x: None if x is None else json.dumps([plain(v) for v in json.loads(x)], ensure_ascii=False))


def nfkc_values(fields: Column) -> Column:
    """A map with compatibility-normalised values; only maps with non-ASCII characters are sent to Python.

    Their values go there as a text: a column of maps costs every row, also those whose map stays behind.
    """
    values = F.map_values(fields)
    sent = _nfkc_list(F.when(F.array_join(values, "").rlike(r"[^\x00-\x7F]"), F.to_json(values)))
    return F.when(sent.isNotNull(), F.map_from_arrays(F.map_keys(fields), F.from_json(sent, "array<string>"))).otherwise(fields)


#: A first value, and steps that each make the next value of the last one.
Chain = tuple[Column, list[Callable[[Column], Column]]]


def nest(first: Column, steps: list[Callable[[Column], Column]]) -> Column:
    """A chain as one expression; each value is evaluated once, however often the next step uses it.

    Spark evaluates the steps outside generated code: for hot paths there is `stage`.
    """
    for step in steps:
        first = F.get(F.transform(F.array(first), step), F.lit(0))
    return first


def stage(df: DataFrame, chains: dict[str, Chain]) -> DataFrame:
    """df with the results of chains as columns, by one projection for each step, in generated code."""
    for i in range(1 + max(len(steps) for _, steps in chains.values())):
        df = df.withColumns({name: steps[i - 1](F.col(name)) if i else first for name, (first, steps) in chains.items() if i <= len(steps)})
    return df


def filled(text: Column) -> Column:
    """Null for an empty text. It holds its argument once, so that expressions do not grow with each use of it."""
    return F.get(F.array_remove(F.array(text), ""), F.lit(0))


def nfkc(text: Column) -> Column:
    """Compatibility-normalised text; only rows with non-ASCII characters are sent to Python."""
    return F.coalesce(_nfkc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


# What is cleaned, in order.
CLEANING = ((r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""), (r"\r\n?", "\n"), (r"[ \t\x{00A0}]+", " "), (r" ?\n ?", "\n"), (r"\n{3,}", "\n\n"), (r"^[ \n]+|[ \n]+$", ""))
#: A text that has none of these and no two blanks in a row is clean but for blanks at its ends.
UNCLEAN = r"[^\x20-\x7E]"


def clean_text(text: Column, most: int | None = None, unicode: bool = True) -> Column:
    """Control characters dropped, blanks collapsed by line, at most one empty line in a row, trimmed; '' is null."""
    out = nfkc(text) if unicode else text
    trimmed = F.trim(out)
    clean = ~F.contains(trimmed, F.lit("  ")) & ~trimmed.rlike(UNCLEAN)
    for pattern, instead in CLEANING:
        out = F.regexp_replace(out, pattern, instead)
    if most is not None:
        out = F.regexp_replace(F.substring(out, 1, most), r"\s+$", "")
        clean = clean & (F.length(trimmed) <= most)
    return filled(F.when(clean, trimmed).otherwise(out))


def has_text(text: Column) -> Column:
    """Whether clean_text leaves anything: a character that is neither a control nor a blank, also after NFKC."""
    return F.coalesce(text.rlike(r"[^\x00-\x20\x7F\x{00A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"), F.lit(False))


def collapse_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def truncate_words(text: Column, length: int, suffix: str = "…") -> Column:
    """At most `length` characters, cut back to whole words, with a suffix."""
    cut = F.substring(text, 1, length)
    inside = ~F.substring(text, length + 1, 1).rlike(r"^\s$") & F.contains(cut, F.lit(" "))
    cut = F.when(inside, F.regexp_replace(cut, r" [^ ]*$", "")).otherwise(cut)
    return F.when(F.length(text) > length, F.concat(F.regexp_replace(cut, r"\s+$", ""), F.lit(suffix))).otherwise(text)


def extract_emails(text: Column) -> Column:
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(EMAIL), 0)
    return F.array_distinct(F.transform(found, F.lower))


def extract_phones(text: Column) -> Column:
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PHONE), 0), lambda x: F.regexp_replace(x, r"[\s\-().]", ""))
    return F.array_distinct(F.filter(found, lambda x: F.length(F.ltrim(x, F.lit("+"))).between(9, 13)))


def normalize_reference(reference: Column, unicode: bool = True) -> Column:
    """The comparison key of a reference number."""
    out = F.upper(nfkc(reference) if unicode else reference)
    out = F.regexp_replace(F.regexp_replace(out, r"[^A-Z0-9/\-]", ""), r"[/\-]{2,}", "/")
    return filled(F.regexp_replace(out, r"^[/\-]+|[/\-]+$", ""))


def money_chain(text: Column) -> Chain:
    """parse_money in steps."""
    currencies = F.create_map(*[F.lit(x) for kv in SYMBOLS.items() for x in kv])
    first = F.struct(F.upper(F.regexp_extract(text, MONEY, 1)).alias("symbol"), F.replace(F.regexp_extract(text, MONEY, 2), F.lit(" "), F.lit("")).alias("raw"))

    def plain(m: Column) -> Column:
        raw = m["raw"]
        last = lambda c: F.length(raw) - F.locate(c, F.reverse(raw))
        comma, point = F.contains(raw, F.lit(",")), F.contains(raw, F.lit("."))
        out = F.when(comma & point & (last(",") > last(".")), F.translate(raw, ",.", ".")).when(comma & point, F.translate(raw, ",", ""))
        out = out.when(comma & (F.length(F.substring_index(raw, ",", -1)) == 2), F.translate(raw, ",", ".")).when(comma, F.translate(raw, ",", "")).otherwise(raw)
        return F.struct(F.coalesce(F.try_element_at(currencies, m["symbol"]), m["symbol"]).alias("currency"), F.when(raw != "", out.try_cast("decimal(18,2)")).alias("amount"))

    return first, [plain, lambda m: F.when(m["amount"].isNotNull(), m)]


def parse_money(text: Column) -> Column:
    """struct(currency, amount): the first amount with a currency; commas and points told apart."""
    return nest(*money_chain(text))


def slugify(text: Column, most: int = 200) -> Column:
    """Lower-case ASCII words joined by hyphens; accents of Latin letters are dropped."""
    accents = [c for c in map(chr, range(0xC0, 0x180)) if len(d := unicodedata.normalize("NFKD", c)) > 1 and d[0].isascii()]
    plain = F.translate(text, "".join(accents), "".join(unicodedata.normalize("NFKD", c)[0] for c in accents))
    out = F.regexp_replace(F.regexp_replace(plain, r"[^\x00-\x7F]", ""), r"[^a-zA-Z0-9]+", "-")
    out = F.lower(F.regexp_replace(out, r"^-+|-+$", ""))
    return F.regexp_replace(F.substring(out, 1, most), r"-+$", "")


def contains_any(text: Column, terms: list[str] | tuple[str, ...]) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(t.lower())) for t in terms], F.lit(False))


def strip_html(html: Column) -> Column:
    return collapse_whitespace(F.regexp_replace(html, r"<[^>]*>", " "))


def visible_text(html: Column) -> Column:
    """Text of a page: scripts, styles and comments dropped, tags as blanks, the commonest entities decoded."""
    out = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b.*?</(script|style|noscript)>", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return collapse_whitespace(out)


def first_meaningful_line(text: Column, least: int = 12, most: int = 300) -> Column:
    """The first line that has `least` characters after cleaning, cut at `most`; null without one."""
    lines = F.transform(F.split(text, r"\r\n?|\n"), lambda x: F.coalesce(clean_text(x, unicode=False), F.lit("")))
    return F.substring(F.get(F.filter(lines, lambda x: F.length(x) >= least), F.lit(0)), 1, most)


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the lower-case words, each padded by two blanks before and one after."""
    low = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    padded = F.concat(F.lit("  "), F.regexp_replace(low, r"[^\p{L}\p{N}]+", " \n  "), F.lit(" "))
    grams = F.regexp_extract_all(padded, F.lit("(?=(...))"), 1)  # a dot is no line feed, so none spans two words
    return F.array_distinct(F.when(low == "", F.slice(grams, 1, 0)).otherwise(grams))


def set_similarity(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either > 0, both / either).otherwise(F.lit(0.0))


def trigram_similarity(a: Column, b: Column) -> Column:
    return set_similarity(trigrams(a), trigrams(b))


def parse_enum(value: Column, members: tuple[str, ...], fallback: str) -> Column:
    out = F.regexp_replace(F.upper(F.trim(value)), r"[- ]", "_")
    return F.when(out.isin(*members), out).otherwise(F.lit(fallback))


def first_present(fields: Column, *keys: str) -> Column:
    """The first value of a map's keys that is neither absent nor empty."""
    return F.coalesce(*[filled(F.try_element_at(fields, F.lit(k))) for k in keys])


def first_rule(text: Column, rules: tuple[tuple[str, tuple[str, ...]], ...]) -> Column:
    """The name of the first rule of which a keyword occurs in the text; null if none."""
    out = F.lit(None).cast("string")
    for name, words in reversed(rules):
        out = F.when(contains_any(text, words), F.lit(name)).otherwise(out)
    return out
