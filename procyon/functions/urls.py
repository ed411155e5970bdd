"""URL canonicalisation and policy as column expressions; no name is resolved."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import Chain, filled, nest

# Parameters without meaning for a page's identity, allowed ports, literal private ranges (first, last).
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "mc_cid", "mc_eid", "_ga")
PORTS = (80, 443, 8080, 8443)
PRIVATE = (("0.0.0.0", "0.255.255.255"), ("10.0.0.0", "10.255.255.255"), ("100.64.0.0", "100.127.255.255"), ("127.0.0.0", "127.255.255.255"), ("169.254.0.0", "169.254.255.255"), ("172.16.0.0", "172.31.255.255"), ("192.168.0.0", "192.168.255.255"), ("224.0.0.0", "255.255.255.255"))
FORMATS = ("PDF", "DOC", "DOCX", "XLS", "XLSX", "CSV", "TXT", "HTML", "ZIP")

PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"


def part(url: Column, name: str) -> Column:
    return F.regexp_extract(F.trim(url), PARTS, ("scheme", "authority", "path", "query").index(name) + 1)


def is_http_url(url: Column) -> Column:
    return F.coalesce(F.lower(part(url, "scheme")).isin("http", "https") & (part(url, "authority") != ""), F.lit(False))


def url_chain(url: Column, base: Column | None = None) -> Chain:
    """normalize_url in steps."""
    whole = F.struct(filled(F.trim(url)).alias("url"), (F.lit(None).cast("string") if base is None else base).alias("base"))

    def split(p: Column) -> Column:
        own = part(p["url"], "scheme")
        of_base = lambda c: F.when(own == "", part(p["base"], c))
        return F.struct(p["url"].alias("url"), own.alias("own"), *[of_base(c).alias(c) for c in ("scheme", "authority", "path", "query")], F.regexp_extract(p["url"], "^[^?#]*", 0).alias("way"))

    def resolve(p: Column) -> Column:
        """struct(url) of an absolute URL, or (root, path, tail) of one that is relative to base."""
        url, way, none = p["url"], p["way"], F.lit(None).cast("string")
        tail = F.substr(url, F.length(way) + 1)
        folder = F.regexp_replace(p["path"], r"[^/]*$", "")
        joined = F.when(way.startswith("/"), way).otherwise(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), way))
        whole = F.when(p["own"] != "", url).when(url.startswith("//"), F.concat(p["scheme"], F.lit(":"), url))
        whole = whole.when(way == "", F.concat(p["scheme"], F.lit("://"), p["authority"], p["path"], F.when(tail.startswith("?"), tail).otherwise(p["query"])))
        return F.struct(whole.alias("url"), F.when(whole.isNull(), F.concat(p["scheme"], F.lit("://"), p["authority"])).alias("root"), F.when(whole.isNull(), joined).otherwise(none).alias("path"), way.startswith("/").alias("rooted"), tail.alias("tail"))

    def climb(p: Column) -> Column:
        """A stack of segments: `..` takes the last one away, `.` is dropped, and so are empty ones behind base's path."""
        path = p["path"]
        segments = F.split(path, "/")
        inner = F.filter(segments, lambda s, i: p["rooted"] | (s != "") | (i == 0) | (i == F.size(segments) - 1))
        stack = F.aggregate(inner, F.array().cast("array<string>"), lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(s == ".", acc).otherwise(F.array_append(acc, s)))
        folded = F.regexp_replace(F.concat(F.array_join(stack, "/"), F.when(path.rlike(r"(^|/)\.{1,2}$"), F.lit("/")).otherwise("")), "^/?", "/")
        plain = ~path.rlike(r"(^|/)\.{1,2}(/|$)|//")
        return F.coalesce(p["url"], F.concat(p["root"], F.when(plain, path).otherwise(folded), p["tail"]))

    def parts(url: Column) -> Column:
        return F.struct(F.lower(part(url, "scheme")).alias("scheme"), F.lower(part(url, "authority")).alias("authority"), part(url, "path").alias("path"), part(url, "query").alias("query"))

    def build(p: Column) -> Column:
        scheme, authority = p["scheme"], p["authority"]
        host = F.when(scheme == "http", F.regexp_replace(authority, r":80$", "")).when(scheme == "https", F.regexp_replace(authority, r":443$", "")).otherwise(authority)
        kept = F.filter(F.split(F.substring(p["query"], 2, 1 << 20), "&"), lambda x: (x != "") & ~F.lower(F.substring_index(x, "=", 1)).isin(*TRACKING))
        query = F.when(p["query"] == "", "").otherwise(F.regexp_replace(F.concat(F.lit("?"), F.array_join(kept, "&")), r"^\?$", ""))
        good = scheme.isin("http", "https") & (authority != "") & ~F.contains(authority, F.lit("@"))
        return F.when(good, F.concat(scheme, F.lit("://"), host, F.when(p["path"] == "", F.lit("/")).otherwise(p["path"]), query))

    return whole, [*([] if base is None else [split, resolve, climb]), *([lambda p: p["url"]] if base is None else []), parts, build]


def normalize_url(url: Column, base: Column | None = None) -> Column:
    """Scheme and host in lower case, default port, fragment and tracking dropped; credentials or no host give null."""
    return nest(*url_chain(url, base))


def _number(ip: Column) -> Column:
    a = F.split(ip, r"\.")
    return sum((F.try_element_at(a, F.lit(i + 1)).try_cast("bigint") * 256 ** (3 - i) for i in range(4)), F.lit(0))


def url_policy(url: Column) -> Column:
    """struct(ok, reason): scheme, host, credentials, port and literal addresses."""
    scheme, authority = F.lower(part(url, "scheme")), F.lower(part(url, "authority"))
    host = F.regexp_replace(F.substring_index(authority, "@", -1), r":[0-9]*$", "")
    port = filled(F.regexp_extract(authority, r":([0-9]*)$", 1)).try_cast("int")
    number = F.when(host.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), _number(host))
    value = lambda ip: sum(int(x) * 256 ** (3 - i) for i, x in enumerate(ip.split(".")))
    private = F.lit(False)
    for first, last in PRIVATE:
        private = private | number.between(value(first), value(last))
    reason = F.when(url.isNull() | (F.trim(url) == ""), "empty").when(~scheme.isin("http", "https"), "scheme").when(host == "", "host").when(F.contains(authority, F.lit("@")), "credentials")
    reason = reason.when(port.isNotNull() & ~port.isin(*PORTS), "port").when((host == "localhost") | host.endswith(".local") | host.endswith(".localhost") | (host == "[::1]"), "local").when(private, "private")
    return F.struct(reason.isNull().alias("ok"), reason.alias("reason"))


def same_host(a: Column, b: Column) -> Column:
    host = lambda u: F.regexp_replace(F.regexp_replace(F.lower(part(u, "authority")), r":[0-9]*$", ""), r"^www\.", "")
    return (host(a) == host(b)) & (host(a) != "")


def filename_from_url(url: Column) -> Column:
    return filled(F.substring_index(part(url, "path"), "/", -1))


def with_query(url: Column, query: Column) -> Column:
    return F.concat(F.substring_index(F.substring_index(url, "#", 1), "?", 1), F.lit("?"), query)


def guess_format(filename: Column) -> Column:
    ext = F.upper(F.when(F.contains(filename, F.lit(".")), F.substring_index(filename, ".", -1)))
    ext = F.when(ext == "HTM", "HTML").otherwise(ext)
    return F.when(ext.isin(*FORMATS), ext).otherwise("UNKNOWN")


def sniff_format(head: Column, declared: Column, filename: Column) -> Column:
    """The format of a file: magic bytes first, OOXML by its type or extension, then what is declared."""
    hexed, kind, by_name = F.hex(F.substring(head, 1, 8)), F.lower(F.coalesce(declared, F.lit(""))), guess_format(filename)
    text = F.lower(F.trim(F.decode(F.substring(head, 1, 64), "ISO-8859-1")))
    zipped = F.when(F.contains(kind, F.lit("wordprocessingml")) | (by_name == "DOCX"), "DOCX").when(F.contains(kind, F.lit("spreadsheetml")) | (by_name == "XLSX"), "XLSX").otherwise("ZIP")
    old = F.when(F.contains(kind, F.lit("excel")) | (by_name == "XLS"), "XLS").otherwise("DOC")
    out = F.when(hexed.startswith("25504446"), "PDF").when(hexed.startswith("504B0304"), zipped).when(hexed.startswith("D0CF11E0"), old)
    out = out.when(text.startswith("<!doctype html") | text.startswith("<html") | F.contains(kind, F.lit("html")), "HTML")
    return out.when(F.contains(kind, F.lit("csv")) | (by_name == "CSV"), "CSV").when(F.contains(kind, F.lit("text/plain")) | (by_name == "TXT"), "TXT").otherwise("UNKNOWN")
