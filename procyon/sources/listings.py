"""Captured listings to items: JSON bodies, WordPress posts, OCDS release packages.

raw: rows (source_id, url, body, ...). items: (source_id, source_url, fields map, documents array, payload).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_html
from ..functions.urls import filename_from_url, guess_format, normalize_url

DOCUMENT_EXTENSIONS = ("pdf", "doc", "docx", "xls", "xlsx", "csv", "zip")


def _path(dotted: str) -> str:
    return "$" + "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in dotted.split("."))


def json_listing_items(raw: DataFrame, records_path: str, field_map: dict[str, str], detail_url: str | None = None, body: str = "body", keep: tuple[str, ...] = ("source_id", "url")) -> tuple[DataFrame, DataFrame]:
    """(items, rejects). records_path leads to an array or to one object; field_map: name -> dotted path.

    Elements that are no objects are dropped, null fields too. detail_url may name fields in braces. A body that is no
    JSON is a reject.
    """
    doc = raw.withColumn("__doc", F.try_parse_json(F.col(body)))
    rejects = doc.where("__doc IS NULL").select(*keep, F.lit("PARSE").alias("stage"), F.lit("INVALID_JSON").alias("code"))
    at = F.try_variant_get("__doc", _path(records_path) if records_path else "$", "variant")
    many = F.try_variant_get("__doc", _path(records_path) if records_path else "$", "array<variant>")
    rows = doc.where("__doc IS NOT NULL").select(*keep, F.explode(F.coalesce(many, F.array(at))).alias("record"))
    rows = rows.where(F.schema_of_variant("record").startswith("OBJECT"))
    values = [(n, F.try_variant_get("record", _path(p), "string")) for n, p in field_map.items()]
    fields = F.map_filter(F.create_map(*[x for n, v in values for x in (F.lit(n), v)]), lambda k, v: v.isNotNull())
    url = F.col("url") if "url" in keep else F.lit(None).cast("string")
    if detail_url:
        url = F.lit(detail_url)
        for n, v in values:
            url = F.replace(url, F.lit(f"{{{n}}}"), F.coalesce(v, F.lit("")))
    return rows.select(*keep, url.alias("source_url"), fields.alias("fields"), F.to_json("record").alias("payload")), rejects


def json_documents(items: DataFrame, path: str, url_key: str = "url", title_key: str = "title", payload: str = "payload", base: str = "source_url") -> DataFrame:
    """(all of items, document_url, title): the documents nested in each item, with absolute URLs; bad ones skipped."""
    docs = F.try_variant_get(F.try_parse_json(F.col(payload)), _path(path), "array<variant>")
    rows = items.select("*", F.explode(docs).alias("__d"))
    url = normalize_url(F.try_variant_get("__d", f"$.{url_key}", "string"), F.col(base))
    return rows.withColumn("document_url", url).withColumn("document_title", F.try_variant_get("__d", f"$.{title_key}", "string")).where("document_url IS NOT NULL").drop("__d")


_RENDERED = "struct<rendered: string>"
WORDPRESS = f"array<struct<id: bigint, date: string, date_gmt: string, link: string, slug: string, title: {_RENDERED}, content: {_RENDERED}, excerpt: {_RENDERED}>>"


def links_in(html: Column) -> Column:
    """Array of struct(href, text) of the anchors in a page."""
    pattern = r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a>"""
    return F.transform(F.arrays_zip(F.regexp_extract_all(html, F.lit(pattern), 1).alias("href"), F.regexp_extract_all(html, F.lit(pattern), 2).alias("text")), lambda x: F.struct(x["href"].alias("href"), strip_html(x["text"]).alias("text")))


def wordpress_items(raw: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """(items, rejects) of posts arrays; an error object is a reject. Excerpt, else content, is the description."""
    parsed = raw.withColumn("__posts", F.from_json(body, WORDPRESS)).withColumn("__code", F.get_json_object(body, "$.code"))
    bad = F.col("__code").isNotNull() | F.col("__posts").isNull()
    rejects = parsed.where(bad).select("source_id", "url", F.lit("FETCH").alias("stage"), F.coalesce("__code", F.lit("INVALID_JSON")).alias("code"))
    posts = parsed.where(~bad).select("source_id", "url", F.explode("__posts").alias("p"))
    title, content = strip_html(F.col("p.title.rendered")), F.col("p.content.rendered")
    description = F.coalesce(F.nullif(strip_html(F.col("p.excerpt.rendered")), F.lit("")), strip_html(content))
    fields = {"external_id": F.col("p.id").cast("string"), "title": title, "description": description, "published_at": F.coalesce(F.concat("p.date_gmt", F.lit("Z")), "p.date")}
    docs = F.filter(F.transform(links_in(F.coalesce(content, F.lit(""))), lambda x: F.struct(normalize_url(x["href"], F.col("p.link")).alias("url"), x["text"].alias("title"))), lambda x: x["url"].isNotNull() & is_document(x["url"]))
    return posts.select("source_id", F.col("p.link").alias("source_url"), _map(fields), F.array_distinct(docs).alias("documents")), rejects


def _map(fields: dict[str, Column]) -> Column:
    return F.map_filter(F.create_map(*[x for n, v in fields.items() for x in (F.lit(n), v)]), lambda k, v: v.isNotNull()).alias("fields")


def is_document(url: Column, extensions: tuple[str, ...] = DOCUMENT_EXTENSIONS) -> Column:
    return F.lower(F.substring_index(F.substring_index(url, "#", 1), "?", 1)).rlike(r"\.(" + "|".join(extensions) + r")$")


_PARTY = "struct<id: string, name: string, roles: array<string>, contactPoint: struct<name: string, email: string, telephone: string>>"
OCDS = f"struct<releases: array<struct<ocid: string, id: string, date: string, tag: array<string>, buyer: struct<id: string, name: string>, parties: array<{_PARTY}>, tender: struct<id: string, title: string, description: string, status: string, procurementMethod: string, procurementMethodDetails: string, value: struct<amount: double, currency: string>, tenderPeriod: struct<startDate: string, endDate: string>, submissionMethod: array<string>, milestones: array<struct<type: string, title: string, description: string, dueDate: string>>, documents: array<struct<id: string, title: string, url: string>>>>>>"
# Fixed maps: OCDS codes to ours.
OCDS_STATUS = {"planning": "OPEN", "planned": "OPEN", "active": "OPEN", "open": "OPEN", "cancelled": "CANCELLED", "unsuccessful": "CLOSED", "complete": "CLOSED", "withdrawn": "CANCELLED"}
OCDS_METHOD = {"request for quotation": "RFQ", "request for proposal": "RFP", "request for bid": "RFB", "request for information": "RFI", "expression of interest": "EXPRESSION_OF_INTEREST"}


def ocds_items(raw: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """(items, rejects) of release packages."""
    parsed = raw.withColumn("__p", F.from_json(body, OCDS))
    rejects = parsed.where("__p.releases IS NULL").select("source_id", "url", F.lit("PARSE").alias("stage"), F.lit("NO_RELEASES").alias("code"))
    r = parsed.where("__p.releases IS NOT NULL").select("source_id", "url", F.explode("__p.releases").alias("r")).select("source_id", "url", "r", F.col("r.tender").alias("t"))
    table = lambda d, key: F.try_element_at(F.create_map(*[F.lit(x) for kv in d.items() for x in kv]), F.lower(F.coalesce(key, F.lit(""))))
    buyer = F.get(F.filter("r.parties", lambda p: F.array_contains(p["roles"], "buyer")), F.lit(0))
    meeting = F.get(F.filter("t.milestones", lambda m: F.lower(F.concat_ws(" ", m["type"], m["title"], m["description"])).rlike("briefing|site")), F.lit(0))
    fields = {
        "external_id": F.col("r.ocid"), "title": F.coalesce("t.title", "t.description", "r.ocid"), "description": F.col("t.description"), "reference_number": F.coalesce("t.id", "r.ocid"),
        "organization": F.coalesce("r.buyer.name", buyer["name"]), "status": table(OCDS_STATUS, F.col("t.status")), "procurement_type": F.coalesce(table(OCDS_METHOD, F.col("t.procurementMethodDetails")), F.lit("TENDER")),
        "published_at": F.coalesce("t.tenderPeriod.startDate", "r.date"), "closing_at": F.col("t.tenderPeriod.endDate"), "estimated_value": F.col("t.value.amount").cast("decimal(18,2)").cast("string"), "currency": F.col("t.value.currency"),
        "submission_method": F.array_join("t.submissionMethod", ", "), "briefing_date": meeting["dueDate"], "briefing": meeting["description"],
        "contact_name": buyer["contactPoint"]["name"], "contact_email": buyer["contactPoint"]["email"], "contact_phone": buyer["contactPoint"]["telephone"],
    }
    urls = F.array_distinct(F.transform(F.filter("t.documents", lambda d: d["url"].isNotNull()), lambda d: d["url"]))
    docs = F.transform(urls, lambda u: F.struct(u.alias("url"), F.get(F.filter("t.documents", lambda d: d["url"] == u), F.lit(0))["title"].alias("title")))
    return r.select("source_id", F.col("url").alias("source_url"), _map(fields), docs.alias("documents")), rejects


def item_gate(items: DataFrame, run: list[str], order: list[str], most: int = 5000, title: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(items with a title, at most `most` of a run, one error row for each run cut)."""
    from pyspark.sql import Window as W

    name = title if title is not None else F.try_element_at("fields", F.lit("title"))
    n = F.row_number().over(W.partitionBy(*run).orderBy(*order))
    numbered = items.where(F.coalesce(F.trim(name), F.lit("")) != "").withColumn("position", n)
    over = numbered.where(F.col("position") > most).groupBy(*run).agg(F.count("*").alias("dropped")).withColumn("code", F.lit("MAX_ITEMS_EXCEEDED"))
    return numbered.where(F.col("position") <= most), over


def dispatch_items(raw: DataFrame, sources: DataFrame, readers: dict[str, object]) -> tuple[DataFrame, DataFrame]:
    """(items, errors) of raw captures of all sources: each row goes to its source's reader; an unknown one is an error."""
    keyed = raw.join(sources.select(F.col("id").alias("source_id"), F.col("connector").alias("__reader")), "source_id", "left")
    items, rejects = [], []
    for key, read in readers.items():
        a, b = read(keyed.where(F.col("__reader") == key).drop("__reader"))
        items.append(a)
        rejects.append(b.select("source_id", "url", "stage", "code"))
    rejects.append(keyed.where(~F.coalesce(F.col("__reader").isin(*readers), F.lit(False))).select("source_id", "url", F.lit("DISCOVERY").alias("stage"), F.lit("UNKNOWN_READER").alias("code")))
    union = lambda a, b: a.unionByName(b, allowMissingColumns=True)
    return reduce(union, items), reduce(union, rejects)


def all_rejects(*tables: DataFrame, most: int = 2000) -> DataFrame:
    """One error table of every stage's rejects: (source_id, stage, code, message, url, retryable)."""

    def shaped(t: DataFrame) -> DataFrame:
        col = lambda *names: F.coalesce(*[F.col(n).cast("string") for n in names if n in t.columns] or [F.lit(None).cast("string")])
        retry = F.col("retryable") if "retryable" in t.columns else F.col("stage").isin("FETCH", "DISCOVERY")
        return t.select(F.col("source_id").cast("bigint").alias("source_id"), "stage", "code", F.substring(F.coalesce(col("message"), F.col("code")), 1, most).alias("message"), col("url", "source_url").alias("url"), retry.alias("retryable"))

    return reduce(DataFrame.unionByName, [shaped(t) for t in tables])


__all__ = ["all_rejects", "dispatch_items", "filename_from_url", "guess_format", "is_document", "item_gate", "json_documents", "json_listing_items", "links_in", "ocds_items", "wordpress_items"]
