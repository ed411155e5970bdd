"""Queries of the readers and writers: captured bodies are stand-ins, made by Spark from the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import documents, listings, pages, reference, state
from .registry import Tables, query_of

_SITE = "https://www.example.org"


def _field(name: str) -> F.Column:
    return F.try_element_at("fields", F.lit(name)).alias(name)


@query_of("s2_json_documents", "SELECT event_id AS id, 'https://www.example.org/d/' || CAST(event_id AS STRING) || '.pdf' AS document_url, event_type AS document_title FROM events")
def s2(t: Tables) -> DataFrame:
    docs = F.array(F.struct(F.concat(F.lit("/d/"), "event_id", F.lit(".pdf")).alias("url"), F.col("event_type").alias("title")), F.struct(F.lit("ftp://x/y").alias("url"), F.lit("no").alias("title")))
    items = t.events.select(F.col("event_id").alias("id"), "event_type", F.lit(f"{_SITE}/list").alias("source_url"), F.to_json(F.struct(F.struct(docs.alias("files")).alias("record"))).alias("payload"))
    return listings.json_documents(items, "record.files").select("id", "document_url", "document_title")


@query_of(
    "s3_wordpress_items",
    """SELECT 'item' AS kind, CAST(id AS STRING) AS external_id, title, coalesce(description, title || ' file') AS description, strftime(published_at, '%Y-%m-%dT%H:%M:%S') || CASE WHEN id % 3 = 0 THEN '' ELSE 'Z' END AS published_at, CAST(1 AS BIGINT) AS documents FROM opportunities WHERE id % 50 <> 1
       UNION ALL SELECT 'rest_error', NULL, NULL, NULL, NULL, count(*) FROM opportunities WHERE id % 50 = 1""",
)
def s3(t: Tables) -> DataFrame:
    """A body with one post for each opportunity, some bodies are errors."""
    rendered = lambda x, name: F.struct(x.alias("rendered")).alias(name)
    at, i = F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss"), F.col("id")
    content = F.concat(F.lit("<p>"), "title", F.lit(' <a href="/f/'), i, F.lit('.pdf">file</a> <a href="/about">'), F.lit("</a></p>"))
    post = F.struct(i, at.alias("date"), F.when(i % 3 != 0, at).alias("date_gmt"), F.concat(F.lit(f"{_SITE}/p/"), i).alias("link"), F.lit("s").alias("slug"), rendered(F.concat(F.lit("<b>"), "title", F.lit("</b>")), "title"), rendered(content, "content"), rendered(F.coalesce("description", F.lit("")), "excerpt"))
    raw = t.opportunities.select("source_id", F.lit(f"{_SITE}/wp-json").alias("url"), F.when(i % 50 == 1, '{"code": "rest_error"}').otherwise(F.to_json(F.array(post))).alias("body"))
    items, rejects = listings.wordpress_items(raw)
    found = items.select(F.lit("item").alias("kind"), _field("external_id"), _field("title"), _field("description"), _field("published_at"), F.size("documents").cast("bigint").alias("documents"))
    none = F.lit(None).cast("string")
    return found.union(rejects.groupBy("code").agg(F.count("*").alias("n")).select("code", none, none, none, none, "n"))


@query_of(
    "s4_ocds_items",
    """SELECT 'ocds-' || CAST(id AS STRING) AS external_id, title, CASE status WHEN 'OPEN' THEN 'OPEN' WHEN 'CLOSED' THEN 'CLOSED' END AS status, CASE WHEN procurement_type = 'RFQ' THEN 'RFQ' ELSE 'TENDER' END AS procurement_type, organization, CAST(estimated_value AS STRING) AS estimated_value,
       'desk' || CAST(contact_id AS STRING) || '@example.org' AS contact_email, CASE WHEN id % 7 = 0 THEN 'meet' END AS briefing, CAST(1 AS BIGINT) AS documents FROM opportunities""",
)
def s4(t: Tables) -> DataFrame:
    i, doc = F.col("id"), F.struct(F.lit("1").alias("id"), F.lit("plan").alias("title"), F.concat(F.lit(f"{_SITE}/d/"), F.col("id")).alias("url"))
    tender = F.struct(
        F.col("title"), F.when(F.col("status") == "OPEN", "active").when(F.col("status") == "CLOSED", "complete").otherwise("other").alias("status"), F.when(F.col("procurement_type") == "RFQ", "Request for Quotation").otherwise("Open").alias("procurementMethodDetails"),
        F.struct(F.col("estimated_value").alias("amount"), F.lit("ZAR").alias("currency")).alias("value"), F.array(F.struct(F.when(i % 7 == 0, "briefing").otherwise("other").alias("type"), F.lit("meet").alias("description"))).alias("milestones"), F.array(doc, doc).alias("documents"),
    ).alias("tender")
    party = F.struct(F.col("organization").alias("name"), F.array(F.lit("buyer")).alias("roles"), F.struct(F.concat(F.lit("desk"), "contact_id", F.lit("@example.org")).alias("email")).alias("contactPoint"))
    release = F.struct(F.concat(F.lit("ocds-"), i).alias("ocid"), F.array(party).alias("parties"), tender)
    raw = t.opportunities.select("source_id", F.lit(f"{_SITE}/ocds").alias("url"), F.to_json(F.struct(F.array(release).alias("releases"))).alias("body"))
    items, _ = listings.ocds_items(raw)
    names = ("external_id", "title", "status", "procurement_type", "organization", "estimated_value", "contact_email", "briefing")
    return items.select(*map(_field, names), F.size("documents").cast("bigint").alias("documents"))


def _listing_pages(t: Tables) -> DataFrame:
    """A listing page of at most 100 rows for each source and hundred of ids."""
    row = F.concat(F.lit('<tr class="t"><td>'), "title", F.lit('</td><td class="ref">'), "reference_number", F.lit('</td><td><a href="/t/'), "id", F.lit('">more</a></td></tr>'))
    part = t.opportunities.select("source_id", F.floor(F.col("id") / 100).alias("page"), F.struct("id", row.alias("row")).alias("r"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list("r")), lambda r: r["row"]), "\n")
    return part.groupBy("source_id", "page").agg(body.alias("rows")).select("source_id", F.concat(F.lit(f"{_SITE}/list/"), "page").alias("url"), F.concat(F.lit("<html><table><tr><th>Title</th></tr>"), "rows", F.lit("</table></html>")).alias("html"))


@query_of("s5_html_listing_items", "SELECT source_id, title, reference_number AS reference, 'https://www.example.org/t/' || CAST(id AS STRING) AS link FROM opportunities")
def s5(t: Tables) -> DataFrame:
    rules = t.sources.select(F.col("id").alias("source_id"), F.lit("tr").alias("row_tag"), F.lit("t").alias("row_class"), F.create_map(F.lit("title"), F.lit("0"), F.lit("reference"), F.lit("td.ref")).alias("fields"))
    found = pages.html_listing_items(_listing_pages(t), rules)
    return found.select("source_id", _field("title"), _field("reference"), F.get("links", F.lit(0)).alias("link"))


@query_of("s9_enrich_from_detail", "SELECT id, title, CASE WHEN id % 2 = 0 THEN 'extra ' || CAST(id AS STRING) END AS extra, CAST(CASE WHEN id % 2 = 0 THEN 2 ELSE 1 END AS BIGINT) AS documents FROM opportunities")
def s9(t: Tables) -> DataFrame:
    doc = lambda name: F.struct(F.concat(F.lit(f"{_SITE}/{name}/"), F.col("id")).alias("url"), F.lit(name).alias("title"))
    items = t.opportunities.select("id", "source_url", F.create_map(F.lit("title"), F.col("title")).alias("fields"), F.array(doc("a")).alias("documents"))
    details = t.opportunities.where("id % 2 = 0").select(F.col("source_url").alias("url"), F.create_map(F.lit("title"), F.lit("other"), F.lit("extra"), F.concat(F.lit("extra "), "id")).alias("fields"), F.array(doc("a"), doc("b")).alias("documents"))
    return pages.enrich_from_detail(items, details).select("id", _field("title"), _field("extra"), F.size("documents").cast("bigint").alias("documents"))


@query_of("s12_read_documents", r"SELECT 'TXT' AS format, CAST(sum(octet_length(encode(regexp_replace(text, '[\r\n]+', ' ', 'g'))) + 1) AS BIGINT) AS bytes FROM documents")
def s12(t: Tables) -> DataFrame:
    """Files that Spark writes from the documents' whole texts, a line for each, read back as bytes."""
    folder = f"{state.shared_folder(t.spark)}/{uuid.uuid4().hex}"
    t.documents.select(F.regexp_replace("text", r"[\r\n]+", " ")).write.text(folder)
    return documents.read_documents(t.spark, folder)[0].groupBy("format").agg(F.sum("length").alias("bytes"))


@query_of(
    "s13_extract_text",
    """SELECT id, CASE id % 4 WHEN 0 THEN '' WHEN 1 THEN content WHEN 2 THEN 'page ' || CAST(id AS STRING) ELSE 'a b | ' || CAST(id AS STRING) END AS text, CASE id % 4 WHEN 0 THEN 'NONE' WHEN 1 THEN 'PLAIN_TEXT' WHEN 2 THEN 'HTML_PARSE' ELSE 'SPREADSHEET' END AS method FROM doc_texts WHERE content IS NOT NULL""",
)
def s13(t: Tables) -> DataFrame:
    i = F.col("id") % 4
    body = F.when(i == 1, F.col("content")).when(i == 2, F.concat(F.lit("<p>page</p><script>no</script> <i>"), "id", F.lit("</i>"))).when(i == 3, F.concat(F.lit('"a b",'), "id")).otherwise("%PDF-1.4")
    files = t.doc_texts.where("content IS NOT NULL").select("id", body.cast("binary").alias("content"), F.when(i == 0, "PDF").when(i == 1, "TXT").when(i == 2, "HTML").otherwise("CSV").alias("format"))
    return documents.extract_text(files, ("id",)).select("id", "text", "method")


@query_of(
    "s16_import_sources",
    """SELECT CASE WHEN s_suppkey % 10 = 3 THEN 'url: local' WHEN s_suppkey % 7 = 2 THEN 'connector' WHEN s_suppkey % 11 = 5 THEN 'municipality' ELSE 'imported' END AS outcome, count(*) AS n, max(CASE WHEN s_suppkey % 10 = 3 OR s_suppkey % 7 = 2 OR s_suppkey % 11 = 5 THEN NULL ELSE regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g') END) AS last_slug FROM supplier GROUP BY 1""",
)
def s16(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    none = F.lit(None).cast("string")
    rows = t.supplier.select(F.col("s_name").alias("name"), F.when(k % 10 == 3, "http://localhost/").otherwise(F.concat(F.lit(f"{_SITE}/s/"), k)).alias("base_url"), F.when(k % 7 == 2, "FTP").otherwise("JSON").alias("connector"), F.concat(F.lit("M"), F.when(k % 11 == 5, F.lit(999)).otherwise(F.col("s_nationkey"))).alias("municipality_code"), none.alias("slug"), none.alias("scope"))
    good, skipped = reference.import_sources(rows, ["JSON", "HTML"], t.municipalities)
    found = good.groupBy(F.lit("imported").alias("outcome")).agg(F.count("*").alias("n"), F.max("slug").alias("last_slug"))
    return found.union(skipped.groupBy("reason").agg(F.count("*"), F.max(none)))


@query_of("w2_write_tables", "SELECT CAST(batch AS STRING) AS batch, count(*) AS n FROM (SELECT c_custkey, c_custkey % 3 AS batch FROM customer) WHERE batch > 0 GROUP BY 1 UNION ALL SELECT 'current', count(*) FROM customer WHERE c_custkey % 3 = 2")
def w2(t: Tables) -> DataFrame:
    """Two batches, the first of them replayed: nothing is there twice."""
    folder = f"{state.shared_folder(t.spark)}/{uuid.uuid4().hex}"
    rows = t.customer.select(F.col("c_custkey").alias("id"))
    for batch in ("1", "2", "1"):
        part = rows.where(F.col("id") % 3 == int(batch))
        state.write_tables({"opportunities": part, "versions": part}, folder, batch)
    history = t.spark.read.parquet(f"{folder}/versions").groupBy(F.col("batch_id").cast("string").alias("batch")).agg(F.count("*").alias("n"))
    return history.union(t.spark.read.parquet(f"{folder}/opportunities/batch=2").select(F.lit("current").alias("batch")).groupBy("batch").agg(F.count("*").alias("n")))
