"""The query surface: filters, geography, details, sorting and paging."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import normalize_reference

SORTS = {"published_at", "closing_at", "estimated_value", "title", "first_seen_at", "relevance"}


@dataclass
class TenderFilter:
    """What list_tenders selects by; None means any."""

    status: list[str] | None = None
    procurement_type: list[str] | None = None
    quality: list[str] | None = None
    source_id: int | None = None
    municipality_id: int | None = None
    reference: str | None = None
    published_from: str | None = None
    published_to: str | None = None
    closing_from: str | None = None
    closing_to: str | None = None
    value_from: float | None = None
    value_to: float | None = None
    province: str | None = None
    district: str | None = None
    category: str | None = None
    text: str | None = None
    include_fixtures: bool = False
    extra: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for a, b in ((self.published_from, self.published_to), (self.closing_from, self.closing_to), (self.value_from, self.value_to)):
            if a is not None and b is not None and a > b:
                raise ValueError(f"reversed range: {a} is after {b}")


def _named(dim: DataFrame, value: str) -> DataFrame:
    """Rows of a dimension by name, code or slug, in any case."""
    v = value.strip().lower()
    return dim.where(F.greatest(*[(F.lower(c) == v).cast("int") for c in ("name", "code", "slug") if c in dim.columns]) == 1)


def filter_by_province(df: DataFrame, value: str, provinces: DataFrame, municipalities: DataFrame) -> DataFrame:
    """Own province, or that of the municipality."""
    wanted = _named(provinces, value).select(F.col("id").alias("__p"))
    towns = municipalities.join(wanted, F.col("province_id") == F.col("__p"), "left_semi").select(F.col("id").alias("__m"), F.lit(True).alias("__by_town")).dropDuplicates(["__m"])
    own = wanted.withColumn("__by_own", F.lit(True)).dropDuplicates(["__p"])
    joined = df.join(own, df["province_id"] == F.col("__p"), "left").join(towns, df["municipality_id"] == F.col("__m"), "left")
    return joined.where("__by_own OR __by_town").select(*[df[c] for c in df.columns])


def filter_by_municipality(df: DataFrame, value: str, municipalities: DataFrame) -> DataFrame:
    return df.join(_named(municipalities, value).select(F.col("id").alias("municipality_id")), "municipality_id", "left_semi").select(*df.columns)


def filter_by_district(df: DataFrame, value: str, districts: DataFrame, municipalities: DataFrame) -> DataFrame:
    towns = municipalities.join(_named(districts, value).select(F.col("id").alias("district_id")), "district_id", "left_semi")
    return df.join(towns.select(F.col("id").alias("municipality_id")), "municipality_id", "left_semi").select(*df.columns)


def filter_by_category(df: DataFrame, slug: str, categories: DataFrame, links: DataFrame) -> DataFrame:
    ids = links.join(categories.where(F.lower("slug") == slug.lower()).select(F.col("id").alias("category_id")), "category_id", "left_semi")
    return df.join(ids.select(F.col("opportunity_id").alias("id")), "id", "left_semi").select(*df.columns)


def text_terms(q: str) -> list[str]:
    return [t for t in q.lower().split() if len(t) > 1][:8]


def search_terms(df: DataFrame, q: str, columns: tuple[str, ...] = ("title", "description", "reference_number")) -> DataFrame:
    """Rows in which every term occurs in some column."""
    for t in text_terms(q):
        hit = F.lit(False)
        for c in columns:
            hit = hit | F.coalesce(F.contains(F.lower(c), F.lit(t)), F.lit(False))
        df = df.where(hit)
    return df


def _day(value: str, end: bool) -> Column:
    return F.to_timestamp_ntz(F.lit(value if len(value) > 10 else f"{value} {'23:59:59' if end else '00:00:00'}"))


def list_tenders(df: DataFrame, f: TenderFilter, dims: dict[str, DataFrame] | None = None) -> DataFrame:
    """Column predicates first (they reach the scan), then semi joins with small dimensions."""
    dims = dims or {}
    if not f.include_fixtures:
        df = df.where("NOT is_fixture")
    for column, values in (("status", f.status), ("procurement_type", f.procurement_type), ("data_quality", f.quality)):
        if values:
            df = df.where(F.col(column).isin(values))
    for column, value in (("source_id", f.source_id), ("municipality_id", f.municipality_id), *f.extra.items()):
        if value is not None:
            df = df.where(F.col(column) == value)
    if f.reference:
        df = df.where((F.col("reference_number") == f.reference) | (F.col("reference_number_normalized") == normalize_reference(F.lit(f.reference), unicode=False)))
    for column, low, high in (("published_at", f.published_from, f.published_to), ("closing_at", f.closing_from, f.closing_to)):
        if low:
            df = df.where(F.col(column) >= _day(low, False))
        if high:
            df = df.where(F.col(column) <= _day(high, True))
    if f.value_from is not None:
        df = df.where(F.col("estimated_value") >= f.value_from)
    if f.value_to is not None:
        df = df.where(F.col("estimated_value") <= f.value_to)
    if f.province:
        df = filter_by_province(df, f.province, dims["provinces"], dims["municipalities"])
    if f.district:
        df = filter_by_district(df, f.district, dims["districts"], dims["municipalities"])
    if f.category:
        df = filter_by_category(df, f.category, dims["categories"], dims["links"])
    return search_terms(df, f.text) if f.text else df


def sort_tenders(df: DataFrame, key: str, descending: bool = True) -> DataFrame:
    if key not in SORTS:
        raise ValueError(f"unknown sort key: {key}")
    return df.orderBy(F.col(key).desc_nulls_last() if descending else F.col(key).asc_nulls_last(), "id")


def paginate(df: DataFrame, page: int = 1, size: int = 20, most: int = 1000) -> DataFrame:
    size = min(max(size, 1), most)
    return df.offset((max(page, 1) - 1) * size).limit(size)


def page_meta(df: DataFrame, page: int = 1, size: int = 20) -> DataFrame:
    """One row: total, pages, has_next, has_previous."""
    pages = F.ceil(F.col("total") / size).cast("bigint")
    return df.agg(F.count("*").alias("total")).select("total", F.lit(page).cast("bigint").alias("page"), pages.alias("pages"), (page < pages).alias("has_next"), (F.lit(page > 1) & (pages > 0)).alias("has_previous"))


def with_geography(df: DataFrame, municipalities: DataFrame, provinces: DataFrame) -> DataFrame:
    """df with municipality_name and province_name; the own province wins."""
    m = municipalities.select(F.col("id").alias("municipality_id"), F.col("name").alias("municipality_name"), F.col("province_id").alias("__mp"))
    p = provinces.select(F.col("id").alias("__p"), F.col("name").alias("province_name"))
    out = df.join(m, "municipality_id", "left").withColumn("__pid", F.coalesce("province_id", "__mp")).join(p, F.col("__pid") == F.col("__p"), "left")
    return out.select(*df.columns, "municipality_name", "province_name")


def tender_detail(df: DataFrame, contacts: DataFrame, documents: DataFrame, links: DataFrame, categories: DataFrame) -> DataFrame:
    """df with its contact, and sorted arrays of documents and categories; both are gathered before the join."""
    c = contacts.select(F.col("id").alias("contact_id"), F.struct("name", "email", "phone").alias("contact"))
    d = documents.groupBy(F.col("opportunity_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct(F.col("id").alias("document_id"), "filename"))).alias("documents"))
    k = links.join(categories.select(F.col("id").alias("category_id"), "slug"), "category_id").groupBy(F.col("opportunity_id").alias("id")).agg(F.sort_array(F.collect_list("slug")).alias("categories"))
    return df.join(c, "contact_id", "left").join(d, "id", "left").join(k, "id", "left")


def list_by(df: DataFrame, equals: dict[str, Any] | None = None, contains: dict[str, str] | None = None, text: tuple[str, tuple[str, ...]] | None = None, order: tuple[str, ...] = ("id",)) -> DataFrame:
    """Rows by equal columns, by substrings in any case, and by a text over several columns; ordered."""
    for c, v in (equals or {}).items():
        df = df.where(F.col(c) == v)
    for c, v in (contains or {}).items():
        df = df.where(F.contains(F.lower(c), F.lit(v.lower())))
    if text:
        df = search_terms(df, text[0], text[1])
    return df.orderBy(*order)


def list_sources(sources: DataFrame, equals: dict[str, Any] | None = None, text: str | None = None) -> DataFrame:
    """Sources by connector, health, municipality and other equal columns, and by a text in their name or organization."""
    out = list_by(sources, equals)
    if not text:
        return out
    return out.where(F.contains(F.lower("name"), F.lit(text.lower())) | F.contains(F.lower("organization"), F.lit(text.lower())))


def get_by(df: DataFrame, ref: Any, columns: tuple[str, ...] = ("id", "code", "slug", "name")) -> DataFrame:
    """The rows that a reference names, by the first of the columns in which any row does; texts in any case.

    Tables of reference data (provinces, municipalities, categories) are meant: a row at most is expected.
    """
    place = F.lit(None).cast("int")
    for i, c in reversed(list(enumerate(columns))):
        place = F.when(F.lower(F.col(c).cast("string")) == F.lit(str(ref).strip().lower()), F.lit(i)).otherwise(place)
    found = df.withColumn("__place", place).where("__place IS NOT NULL")
    best = found.agg(F.min("__place").alias("__best"))
    return found.join(F.broadcast(best), found["__place"] == best["__best"]).select(*df.columns)  # one row


def districts_of_province(districts: DataFrame, municipalities: DataFrame, provinces: DataFrame, ref: Any) -> DataFrame:
    """Districts with a municipality in the province, which comes along as `province`."""
    p = get_by(provinces, ref).select(F.col("id").alias("province_id"), F.col("name").alias("province"))
    m = municipalities.join(p, "province_id").select(F.col("district_id").alias("id"), "province").distinct()
    return districts.join(m, "id")


def document_versions_of(versions: DataFrame, document: Any, key: str = "document") -> DataFrame:
    """A document's versions, the newest first."""
    return versions.where(F.col(key) == F.lit(document)).orderBy(F.col("version").desc())


def text_of(texts: DataFrame, document: Any, key: str = "id", column: str = "content") -> DataFrame:
    """The text of a document, empty where it has none."""
    return texts.where(F.col(key) == F.lit(document)).select(key, F.coalesce(column, F.lit("")).alias("text"))


def list_categories(categories: DataFrame, taxonomy: str | None = None, active: bool | None = True) -> DataFrame:
    """Categories of a taxonomy, the active ones unless told otherwise, by slug."""
    equals = {c: v for c, v in (("taxonomy", taxonomy), ("active", active)) if v is not None and c in categories.columns}
    return list_by(categories, equals, order=("slug",))


def runs_with_sources(runs: DataFrame, sources: DataFrame) -> DataFrame:
    """Runs with their source's name as `source`; sources are joined by id."""
    return runs.join(sources.select(F.col("id").alias("source_id"), F.col("name").alias("source")), "source_id")


def runs_with_jobs(runs: DataFrame, jobs: DataFrame, key: str = "id", dead: tuple[str, ...] = ("FAILED", "CANCELLED")) -> DataFrame:
    """Runs with the status of their job as `job_status`, and `orphaned`: the job is missing or dead."""
    j = jobs.select(F.col("id").alias(key), F.col("status").alias("job_status"))
    return runs.join(j, key, "left").withColumn("orphaned", F.coalesce(F.col("job_status").isin(*dead), F.lit(True)))


def pending_documents(docs: DataFrame, most: int | None = 25, downloaded: str = "downloaded_at", error: str = "error", order: tuple[str, ...] = ("created_at", "id")) -> DataFrame:
    """Documents that are neither downloaded nor failed, the oldest first; most: None for all."""
    out = docs.where(F.col(downloaded).isNull() & F.col(error).isNull()).orderBy(*order)
    return out if most is None else out.limit(most)


def top_k_per_group(df: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    return df.withColumn("position", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("position") <= k)


def _holds(value: Column, probe: Any, top: bool = False) -> Column:
    """Whether a variant contains the probe, as JSONB has it."""
    kind = F.schema_of_variant(value)
    whole = F.try_variant_get(value, "$", "array<variant>")
    if isinstance(probe, dict):
        inner = [_holds(_member(value, k), v) for k, v in probe.items()]
        out = reduce(lambda a, b: a & b, inner, kind.startswith("OBJECT"))
    elif isinstance(probe, list):
        out = reduce(lambda a, b: a & b, [F.exists(whole, _element(x)) for x in probe], kind.startswith("ARRAY"))
    else:
        if probe is None:
            out = F.is_variant_null(value)
        elif isinstance(probe, bool):
            out = (kind == "BOOLEAN") & (F.try_variant_get(value, "$", "boolean") == probe)
        elif isinstance(probe, (int, float)):
            exact = Decimal(repr(probe)) if isinstance(probe, float) else Decimal(probe)
            same = F.try_variant_get(value, "$", "double") == float(probe)
            if abs(exact) < 10**20 and -exact.as_tuple().exponent <= 18:  # beyond that numbers are compared as doubles
                same = F.coalesce(F.try_variant_get(value, "$", "decimal(38,18)") == F.lit(exact).cast("decimal(38,18)"), same)
            out = kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)") & same
        else:
            out = (kind == "STRING") & (F.try_variant_get(value, "$", "string") == probe)
        if top:  # only there an array contains a bare value
            out = out | F.exists(whole, _element(probe))
    return F.coalesce(out, F.lit(False))


def _member(value: Column, key: str) -> Column:
    """The member of an object; paths have two kinds of quotes and no escapes, a key with both is looked up in a map."""
    quote = next((q for q in "'\"" if q not in key), None)
    if quote:
        return F.try_variant_get(value, f"$[{quote}{key}{quote}]", "variant")
    return F.try_element_at(F.try_variant_get(value, "$", "map<string,variant>"), F.lit(key))


def _element(probe: Any) -> Callable[[Column], Column]:
    return lambda e: _holds(e, probe)


def json_containment(df: DataFrame, column: str, probe: Any) -> DataFrame:
    """Rows whose JSON contains the probe: an object, a list or a value.

    As JSONB's @>: an object holds the probe's keys, each containing its value; an array holds, for each element of the
    probe, one that contains it, in any order and number; values are equal in kind and value (42 is 42.0 but not "42");
    an array holds a bare value at the top only. Null and malformed texts contain nothing.
    """
    return df.where(_holds(F.try_parse_json(F.col(column)), probe, True))


def snippet(text: Column, q: str, window: int = 240) -> Column:
    """A window that starts a third before the first term found (in the order of the terms); else the beginning."""
    at = F.lit(0)
    for t in reversed(text_terms(q)):
        here = F.locate(t, F.lower(text))
        at = F.when(here > 0, here).otherwise(at)
    start = F.greatest(at - window // 3, F.lit(1))
    cut = F.trim(F.substr(text, start, F.lit(window)))
    out = F.concat(F.when(start > 1, "…").otherwise(""), cut, F.when(start + window - 1 < F.length(text), "…").otherwise(""))
    return F.when(at > 0, out).when(F.length(text) > window, F.concat(F.regexp_replace(F.substring(text, 1, window), r"\s+\S*$", ""), F.lit("…"))).otherwise(text)
