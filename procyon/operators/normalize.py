"""Raw items to canonical records: one projection over a join with the sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, hashing, text, urls
from ..model import PROCUREMENT_TYPES, STATUSES

# Fixed keyword rules, in order; the first that hits decides.
TYPE_RULES = (("RFQ", ("rfq", "request for quotation", "quotation", "quote")), ("RFP", ("rfp", "request for proposal", "proposal")), ("RFB", ("rfb", "request for bid")), ("RFI", ("rfi", "request for information")), ("EXPRESSION_OF_INTEREST", ("expression of interest", "eoi", "call for expression")), ("AUCTION", ("auction", "disposal by auction")), ("TENDER", ("tender", "bid", "invitation to bid")))
STATUS_RULES = (("CANCELLED", ("cancelled", "canceled", "withdrawn")), ("AWARDED", ("awarded", "award notice", "successful bidder")), ("EXTENDED", ("extended", "extension of closing")), ("SUSPENDED", ("suspended", "on hold")), ("CLOSED", ("closed", "expired")), ("OPEN", ("open", "advertised", "current", "active", "invitation")))
BRIEFING, COMPULSORY, OPTIONAL = ("briefing", "site meeting", "site inspection", "clarification meeting"), ("compulsory", "mandatory"), ("non-compulsory", "not compulsory", "optional")
YES, NO = ("yes", "true", "y", "compulsory", "mandatory"), ("no", "false", "n", "none", "not applicable", "n/a")
NUMBER = r"^[\x00-\x20\x7F]*[+\-]?\.?\p{Nd}"  # how every text begins that can be cast to a number
MOST_TITLE, MOST_DESCRIPTION = 2000, 20_000


def infer_type(explicit: Column, title: Column, description: Column, rules: tuple = TYPE_RULES) -> Column:
    known = text.parse_enum(explicit, PROCUREMENT_TYPES, "OTHER")
    words = F.concat_ws(" ", title, description, explicit)
    return F.when(explicit.isNotNull() & (known != "OTHER"), known).otherwise(F.coalesce(text.first_rule(words, rules), F.lit("OTHER")))


def infer_status(explicit: Column, title: Column, closing_at: Column, as_of: Column, rules: tuple = STATUS_RULES) -> Column:
    known = text.parse_enum(explicit, STATUSES, "UNKNOWN")
    by_date = F.when(closing_at >= as_of, "OPEN").when(closing_at < as_of, "CLOSED").otherwise("UNKNOWN")
    return F.when(explicit.isNotNull() & (known != "UNKNOWN"), known).otherwise(F.coalesce(text.first_rule(explicit, rules), text.first_rule(title, rules), by_date))


def briefing_required(explicit: Column, date: Column, location: Column) -> Column:
    low = F.lower(F.trim(explicit))
    return F.when(low.isin(*YES), True).when(low.isin(*NO), False).when(date.isNotNull() | location.isNotNull(), True)


def briefing_compulsory(words: Column) -> Column:
    """Negations are tested before "compulsory"."""
    return F.when(text.contains_any(words, BRIEFING), F.when(text.contains_any(words, OPTIONAL), False).when(text.contains_any(words, COMPULSORY), True))


def value_chain(raw: Column, currency: Column) -> text.Chain:
    """struct(currency, amount) in steps: a plain number (negative: none) or an amount in text; a stated currency wins."""
    code = F.upper(F.substring(currency, 1, 3))
    found, steps = text.money_chain(raw)
    number = F.when(raw.rlike(NUMBER), raw.try_cast("decimal(18,2)"))  # a cast that fails costs an exception
    first = F.struct(number.alias("number"), F.when(code.rlike("^[A-Z]{3}$"), code).alias("code"), found.alias("money"))

    def within(step: Callable[[Column], Column]) -> Callable[[Column], Column]:
        return lambda p: F.struct(p["number"].alias("number"), p["code"].alias("code"), step(p["money"]).alias("money"))

    def chosen(p: Column) -> Column:
        plain = F.struct(p["code"].alias("currency"), F.when(p["number"] >= 0, p["number"]).alias("amount"))
        return F.when(p["number"].isNotNull(), plain).when(p["money"].isNotNull(), F.struct(F.coalesce(p["code"], p["money"]["currency"]).alias("currency"), p["money"]["amount"].alias("amount")))

    return first, [*map(within, steps), chosen]


def estimated_value(raw: Column, currency: Column) -> Column:
    return text.nest(*value_chain(raw, currency))


def contact_chain(fields: Column) -> text.Chain:
    """struct(name, email, phone, role, organization) in steps; null without a name, an address and a number."""
    get = lambda *k: text.filled(F.trim(text.first_present(fields, *k)))
    blob = F.concat_ws(" ", *[F.try_element_at(fields, F.lit(k)) for k in ("description", "contact", "details")])
    first = F.struct(get("contact_name", "contact_person", "contact").alias("name"), get("contact_email", "email").alias("email"), get("contact_phone", "telephone", "phone").alias("phone"), get("contact_role").alias("role"), get("organization").alias("organization"), blob.alias("blob"))

    def look(c: Column) -> Column:
        email = F.lower(F.coalesce(c["email"], text.filled(F.regexp_extract(c["blob"], text.EMAIL, 0))))
        phone = F.coalesce(c["phone"], text.filled(F.regexp_replace(F.regexp_extract(c["blob"], text.PHONE, 0), r"[\s\-().]", "")))
        return F.struct(c["name"].alias("name"), email.alias("email"), phone.alias("phone"), c["role"].alias("role"), c["organization"].alias("organization"))

    return first, [look, lambda c: F.when(F.coalesce(c["name"], c["email"], c["phone"]).isNotNull(), c)]


def extract_contact(fields: Column) -> Column:
    return text.nest(*contact_chain(fields))


def confidence(published: Column, closing: Column, reference: Column) -> Column:
    return F.round(F.least(F.lit(1.0), 0.5 + 0.2 * published + 0.2 * closing + F.when(reference.isNotNull(), 0.1).otherwise(0.0)), 3)


def normalize_items(items: DataFrame, sources: DataFrame, as_of: str, unicode: bool = True) -> tuple[DataFrame, DataFrame]:
    """(records, rejects). items (source_id, source_url, fields map, documents), sources (id, source_timezone, ...).

    sources are joined by id (a small table is broadcast by its size); a blank title is a reject.
    """
    f = F.col("fields")
    get = lambda *k, most=None: (text.first_present(F.col("plain"), *k), [lambda t: text.clean_text(t, most, unicode=False)])
    now = F.to_timestamp_ntz(F.lit(as_of))
    src = sources.select(F.col("id").alias("source_id"), *[(F.col(c) if c in sources.columns else F.lit(None).cast(t)).alias(f"s_{c}") for c, t in (("source_timezone", "string"), ("organization", "string"), ("municipality_id", "long"), ("province_id", "long"), ("base_url", "string"))])
    # A test of the raw title, not of the cleaned one: the filter is pushed below the join, and takes its expression along.
    named = text.has_text(text.first_present(f, "title", "name", "subject"))
    rejects = items.where(~named).select("source_id", "source_url", F.lit("NORMALIZE").alias("stage"), F.lit("MISSING_TITLE").alias("code"))
    rows = items.where(named).join(src, "source_id", "left").withColumns({"source_timezone": F.coalesce("s_source_timezone", F.lit(dates.ZONE)), "municipality_id": F.col("s_municipality_id"), "province_id": F.col("s_province_id"), "given_url": F.col("source_url"), "plain": text.nfkc_values(f) if unicode else f})
    zone = F.col("source_timezone")
    url = lambda k: urls.url_chain(F.try_element_at(f, F.lit(k)), F.col("s_base_url"))
    rows = text.stage(rows, {
        "title": get("title", "name", "subject", most=MOST_TITLE), "external_id": get("external_id", "id"), "reference_number": get("reference_number", "reference", "tender_number", "bid_number"),
        "description": get("description", "summary", "details", "body", most=MOST_DESCRIPTION), "own_organization": get("organization", "department", "buyer"),
        "briefing_location": get("briefing_location", "briefing_venue", "venue"), "submission_method": get("submission_method", "submission"), "submission_address": get("submission_address", "delivery_address"),
        "published": dates.datetime_chain(text.first_present(f, "published_at", "publication_date", "advertised_date", "date"), zone),
        "closing": dates.datetime_chain(text.first_present(f, "closing_at", "closing_date", "close_date", "deadline"), zone, dates.END_OF_DAY),
        "briefing": dates.datetime_chain(text.first_present(f, "briefing_date", "briefing", "site_meeting_date"), zone),
        "money": value_chain(text.first_present(f, "estimated_value", "value", "budget", "amount"), text.first_present(f, "currency")),
        "contact": contact_chain(f),
        "submission_url": url("submission_url"), "canonical_url": url("canonical_url"), "page_url": urls.url_chain(F.col("given_url"), F.coalesce("s_base_url", "given_url")),
    })
    words = F.concat_ws(" ", *[F.try_element_at(f, F.lit(k)) for k in ("briefing_required", "briefing_location", "briefing", "description")])
    raw = F.map_filter(F.create_map(*[x for n, c in (("published_at", "published"), ("closing_at", "closing"), ("briefing_date", "briefing")) for x in (F.lit(n), F.struct(F.col(f"{c}.raw").alias("raw"), F.col(f"{c}.zone").alias("timezone"), F.col(f"{c}.has_time").alias("has_time")))]), lambda k, v: v["raw"].isNotNull())
    out = rows.select(
        "source_id", "external_id", "reference_number", text.normalize_reference(F.col("reference_number"), unicode=False).alias("reference_number_normalized"), "title", "description",
        infer_type(text.first_present(f, "procurement_type", "type", "category_type"), F.col("title"), F.col("description")).alias("procurement_type"),
        infer_status(text.first_present(f, "status", "state"), F.col("title"), F.col("closing.value"), now).alias("status"),
        F.coalesce("own_organization", "s_organization").alias("organization"), "municipality_id", "province_id",
        F.col("published.value").alias("published_at"), F.col("closing.value").alias("closing_at"), "source_timezone", raw.alias("raw_dates"),
        F.col("money.amount").alias("estimated_value"), F.col("money.currency").alias("currency"), "submission_method", "submission_url", "submission_address",
        briefing_required(F.try_element_at(f, F.lit("briefing_required")), F.col("briefing.value"), F.col("briefing_location")).alias("briefing_required"), briefing_compulsory(words).alias("briefing_compulsory"),
        F.col("briefing.value").alias("briefing_date"), "briefing_location", "contact", F.coalesce("page_url", "s_base_url").alias("source_url"), "canonical_url",
        *[F.col(c) for c in ("documents",) if c in items.columns],
        confidence(F.col("published.confidence"), F.col("closing.confidence"), F.col("reference_number")).alias("confidence"),
    )
    out = out.withColumn("content_hash", hashing.content_hash(out.columns)).withColumn("fingerprint", hashing.fingerprint(F.col("title"), F.col("organization"), F.col("closing_at"), F.col("procurement_type")))
    return out, rejects
