"""Captured pages: links, document links, listing rows by rules, chains of pages, detail pages, visible text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import visible_text
from ..functions.urls import filename_from_url, guess_format, normalize_url
from .listings import DOCUMENT_EXTENSIONS, is_document, links_in
from .state import materialise


def page_links(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, page_url, link_url, link_text): the anchors of each page, absolute, each URL once with its first text."""
    rows = pages.select(key, F.col(url).alias("page_url"), F.posexplode(links_in(F.coalesce(html, F.lit("")))).alias("position", "a"))
    rows = rows.select(key, "page_url", normalize_url(F.col("a.href"), F.col("page_url")).alias("link_url"), "position", F.col("a.text").alias("link_text")).where("link_url IS NOT NULL")
    return rows.groupBy(key, "page_url", "link_url").agg(F.min_by("link_text", "position").alias("link_text"))


def page_document_links(pages: DataFrame, extensions: tuple[str, ...] = DOCUMENT_EXTENSIONS, key: str = "page_id") -> DataFrame:
    links = page_links(pages, key).where(is_document(F.col("link_url"), extensions))
    name = filename_from_url(F.col("link_url"))
    return links.withColumn("filename", name).withColumn("format", guess_format(name))


def pdf_link_items(pages: DataFrame, most: int = 50, key: str = "page_id") -> DataFrame:
    """One item for each PDF link, at most `most` of a page; the title is the link's text, else the file's name."""
    links = page_document_links(pages, ("pdf",), key)
    links = links.withColumn("position", F.row_number().over(W.partitionBy(key).orderBy("link_url"))).where(F.col("position") <= most)
    title = F.coalesce(F.nullif("link_text", F.lit("")), "filename")
    reference = F.nullif(F.regexp_extract(F.upper(title), r"([A-Z]{2,}[-/ ]?[0-9]+(?:[-/][0-9]+)*)", 1), F.lit(""))
    return links.select(key, F.col("page_url").alias("source_url"), F.map_filter(F.create_map(F.lit("title"), title, F.lit("reference_number"), reference), lambda k, v: v.isNotNull()).alias("fields"), F.array(F.struct(F.col("link_url").alias("url"), title.alias("title"))).alias("documents"))


def page_text(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    return pages.select(key, visible_text(F.coalesce(html, F.lit(""))).alias("text"))


def enrich_from_detail(items: DataFrame, details: DataFrame) -> DataFrame:
    """items with the fields of captured detail pages (url, fields, documents) where they lack them, and new documents.

    Of several captures of one address the first by its JSON counts, so that reruns agree.
    """
    whole = F.struct(F.col("fields").alias("__f"), F.col("documents").alias("__d"))
    d = details.groupBy(F.col("url").alias("source_url")).agg(F.min_by(whole, F.to_json(whole)).alias("d")).select("source_url", "d.*")
    out = items.join(d, "source_url", "left")
    new = F.map_filter(F.coalesce("__f", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), lambda k, v: ~F.array_contains(F.map_keys("fields"), k))
    fresh = F.filter(F.coalesce("__d", F.array().cast(items.schema["documents"].dataType)), lambda x: ~F.exists("documents", lambda y: y["url"] == x["url"]))
    return out.withColumn("fields", F.map_concat("fields", new)).withColumn("documents", F.concat("documents", fresh)).select(*items.columns)


def listing_chain(pages: DataFrame, most: int | None = 10) -> DataFrame:
    """(start, url, depth): pages reached from each first page by its next links, at most `most` of them (None: all).

    pages (url, next_url, is_first). Pointers are doubled: after k rounds each page knows the one 2^k links on, and a
    chain has its first 2^k pages, so a chain of n pages takes log2(n) rounds of two joins, whatever its length. A chain
    ends before a page that it already has, so that loops and links to oneself end it, and before a page that is not
    there. Of repeated pages the smallest next link counts; null addresses are no pages.
    """
    urls = pages.where("url IS NOT NULL")
    known = urls.select(F.col("url").alias("far")).distinct()
    jump = materialise(urls.where("next_url != url").groupBy("url").agg(F.min("next_url").alias("far")).join(known, "far").select("url", "far"))
    chain, step = materialise(urls.where("is_first").select(F.col("url").alias("start"), "url", F.lit(1).cast("bigint").alias("depth")).distinct()), 1
    while most is None or step < most:
        more = chain.join(jump, "url").select("start", F.col("far").alias("url"), (F.col("depth") + step).alias("depth"))
        if most is not None:
            more = more.where(F.col("depth") <= most)
        grown = materialise(chain.union(more).groupBy("start", "url").agg(F.min("depth").alias("depth")))
        if grown.count() == chain.count():
            break
        chain, step = grown, 2 * step
        if most is None or step < most:
            jump = materialise(jump.join(jump.toDF("far", "further"), "far").select("url", F.col("further").alias("far")))
    return chain


class _Rows(HTMLParser):
    """The rows of a listing: elements of one tag (and class), their cells, texts by class, and links."""

    VOID = {"br", "img", "input", "hr", "meta", "link"}

    def __init__(self, tag: str, cls: str | None):
        super().__init__(convert_charrefs=True)
        self.tag, self.cls, self.rows, self.stack, self.depth = tag, cls, [], [], 0

    def handle_starttag(self, tag, attrs):  # noqa: ANN001, ANN201
        a = {k: v or "" for k, v in attrs}
        classes = a.get("class", "").split()
        if not self.depth and tag == self.tag and (not self.cls or self.cls in classes):
            self.rows.append({"cells": [], "parts": {}, "links": [], "text": []})
            self.depth = 1
            self.stack = []
            return
        if self.depth and tag not in self.VOID:
            self.depth += tag == self.tag
            self.stack.append((tag, classes))
            row = self.rows[-1]
            if tag in ("td", "th"):
                row["cells"].append([])
            if tag == "a" and "href" in a:
                row["links"].append([a["href"], ""])

    def handle_endtag(self, tag):  # noqa: ANN001, ANN201
        if self.depth:
            self.depth -= tag == self.tag
            while self.stack and self.stack[-1][0] != tag and any(t == tag for t, _ in self.stack):
                self.stack.pop()
            if self.stack and self.stack[-1][0] == tag:
                self.stack.pop()

    def handle_data(self, data):  # noqa: ANN001, ANN201
        if not self.depth or not data.strip():
            return
        row = self.rows[-1]
        row["text"].append(data)
        open_tags = [t for t, _ in self.stack]
        if "td" in open_tags or "th" in open_tags:
            row["cells"][-1].append(data)
        if "a" in open_tags and row["links"]:
            row["links"][-1][1] += data
        for t, classes in self.stack:
            for key in (t, *(f"{t}.{c}" for c in classes), *(f".{c}" for c in classes)):
                row["parts"].setdefault(key, []).append(data)


#: Markup that HTMLParser reads as these tokens and no other: lower-case tags, quoted values without references, text.
_PLAIN = re.compile(r'<([a-z][a-z0-9]*)((?: [a-z][a-z-]*="[^"&<>]*")*)>|</([a-z][a-z0-9]*)>|([^<&]+)')
_VALUE = re.compile(r' ([a-z][a-z-]*)="([^"]*)"')
#: Elements whose content is text of other rules.
_OTHER = ("<script", "<style", "<textarea", "<title", "<xmp", "<iframe", "<noembed", "<noframes", "<noscript", "<plaintext", "<svg", "<math")


def _feed(parser: _Rows, html: str) -> None:
    """parser.feed(html), without HTMLParser's own reading where a page is plain throughout; any other page is fed to it."""
    found, end = [], 0
    if "&" not in html and not any(x in html for x in _OTHER):
        for m in _PLAIN.finditer(html):
            if m.start() != end:
                break
            end = m.end()
            found.append(m.groups())
    if end != len(html):
        parser.feed(html)
        return
    for start, values, close, data in found:
        if start:
            if parser.depth or start == parser.tag:  # no other start has an effect
                parser.handle_starttag(start, _VALUE.findall(values) if values else [])
        elif close:
            parser.handle_endtag(close)
        else:
            parser.handle_data(data)


def html_listing_items(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(source_id, source_url, fields, links): rows of listing pages by each source's rules.

    pages (source_id, url, html); rules (source_id, row_tag, row_class, fields map): a field is a cell's number or a
    `tag.class`. The title falls back to the first link's text, then the row's text. No row is no error.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        clean = lambda parts: " ".join(" ".join(parts).split())
        for frame in frames:
            out = []
            for r in frame.itertuples():
                parser = _Rows(r.row_tag, r.row_class)
                _feed(parser, r.html or "")
                for row in parser.rows:
                    fields = {}
                    for name, where in r.rule.items():
                        cells = row["cells"][int(where)] if where.isdigit() and int(where) < len(row["cells"]) else row["parts"].get(where, [])
                        if clean(cells):
                            fields[name] = clean(cells)
                    fields.setdefault("title", clean([row["links"][0][1]]) if row["links"] and row["links"][0][1].strip() else clean(row["text"]))
                    if fields["title"]:
                        out.append((r.source_id, r.url, fields, [x[0] for x in row["links"]]))
            yield pd.DataFrame(out, columns=["source_id", "source_url", "fields", "links"])

    joined = pages.select("source_id", "url", "html").join(rules.select("source_id", "row_tag", "row_class", F.col("fields").alias("rule")), "source_id")
    found = joined.mapInPandas(run, "source_id bigint, source_url string, fields map<string,string>, links array<string>")
    return found.withColumn("links", F.filter(F.transform("links", lambda u: normalize_url(u, F.col("source_url"))), lambda u: u.isNotNull()))
