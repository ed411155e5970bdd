"""Secret scans: findings by pattern, and multipart credentials linked by an interval join within scopes.

A scope is one text. Its parts are identifiers, secrets and endpoints with their intervals in code points. Strong
parts (keyword assignments, access keys, long hex runs) are reported as they are; weak ones (a login name, an e-mail
address, a bare 40-character token, a URL) are reported only when the complementary parts stand within `gap` code
points. An address within a login or a URL is part of that.

Edge cases: a null or empty text has no findings; a null id is kept and its row scanned; repeated rows give equal
rows; extra columns, whatever their names, are ignored by `scan` and kept by `redact`; an empty table gives none.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, row_key, save, text_chunks

#: Kinds in the order in which equal starts are listed: the strong ones, then the weak ones.
KINDS = ("assign", "access", "hex", "login", "token", "endpoint", "mail")
ROLE = {"assign": "secret", "access": "identifier", "hex": "secret", "login": "identifier", "token": "secret", "endpoint": "endpoint", "mail": "identifier"}
#: What must stand near a weak part of a role.
NEEDS = {"identifier": ("secret",), "secret": ("identifier",), "endpoint": ("identifier", "secret")}
GAP = 256

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_LOGIN = re.compile(r"""(?:client_id|username|user|login|account)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]{3,})""", re.I | re.A)
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/])")
_MAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}(?![A-Za-z0-9-])")
_ENDPOINT = re.compile(r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[A-Za-z0-9._~/%-]*)?", re.A)


def parts_of(text: str) -> list[tuple[int, int, str, int]]:
    """(start, rank of the kind, kind, end) of every part, strong and weak, sorted."""
    out = []
    low = text.lower()
    if any(w in low for w in ("passw", "secret", "token", "apikey", "api_key")):
        out += [(m.start(), 0, "assign", m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, "access", m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, "hex", m.end()) for m in _HEX.finditer(text)]
    taken = [(a, b) for a, _, _, b in out]
    weak = []
    if any(w in low for w in ("client_id", "user", "login", "account")):
        weak += [(m.start(), 3, "login", m.end()) for m in _LOGIN.finditer(text)]
    mails = [(m.start(), 6, "mail", m.end()) for m in _MAIL.finditer(text)] if "@" in text else []
    if taken or weak or mails:  # a bare token or a URL alone can never have a complementary part
        weak += [(m.start(), 4, "token", m.end()) for m in _TOKEN.finditer(text) if re.search("[a-z]", m[0]) and re.search("[A-Z]", m[0]) and re.search("[0-9]", m[0])]
        if "http" in text:
            weak += [(m.start(), 5, "endpoint", m.end()) for m in _ENDPOINT.finditer(text)]
        weak += _outside(mails, sorted((a, b) for a, rank, _, b in weak if rank != 4)) if weak else mails
    if weak and taken:
        taken.sort()
        weak = _outside(weak, taken)
    return sorted(out + weak)


def _outside(weak: list[tuple], taken: list[tuple[int, int]]) -> list[tuple]:
    """The weak parts that overlap no strong one (taken, sorted): each is looked up among the merged strong intervals."""
    starts, ends = [], []
    for a, b in taken:
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)

    def free(w: tuple) -> bool:
        i = bisect_right(ends, w[0])  # the first interval that ends behind the start of w
        return i == len(ends) or starts[i] >= w[3]

    return [w for w in sorted(weak) if free(w)]


_PART = pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("kind", pa.string()), ("end", pa.int64())])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, scope, parts) of each row: all parts of its text, sorted by start and kind. scope identifies id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            found = [[dict(zip(("start", "rank", "kind", "end"), p, strict=True)) for p in parts_of(t)] for t in chunk.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([chunk.column("id"), chunk.column("scope"), pa.array(found, pa.list_(_PART))], ["id", "scope", "parts"])

    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("scope"), F.col(text_col).alias("text"))
    return map_batches(narrow, run, f"id {kind}, scope string, parts array<struct<start: bigint, rank: int, kind: string, `end`: bigint>>").withColumnRenamed("id", id_col)


def link(parts: DataFrame, gap: int = GAP) -> DataFrame:
    """The weak rows of parts (scope, kind, start, end) whose complementary roles stand within gap of them.

    An interval join: both sides are dealt to bins of `gap` code points, a part to every bin that it, widened by gap,
    touches; within (scope, bin, role) a semi join tests the distance, so that no pair is emitted.
    """
    role = F.create_map(*[F.lit(x) for kv in ROLE.items() for x in kv])
    rows = parts.select("scope", "kind", "start", "end", role[F.col("kind")].alias("role")).distinct()
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / gap), F.floor(b / gap)))
    needs = F.create_map(*[x for k, v in NEEDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    weak = rows.where(~F.col("kind").isin(*KINDS[:3])).select("*", F.explode(needs[F.col("role")]).alias("need")).select("*", bins(F.col("start") - gap, F.col("end") + gap).alias("bin"))
    near = rows.select(F.col("scope").alias("s2"), F.col("role").alias("r2"), F.col("start").alias("a2"), F.col("end").alias("b2"), bins(F.col("start"), F.col("end")).alias("bin2"))
    joined = weak.join(near, (F.col("scope") == F.col("s2")) & (F.col("need") == F.col("r2")) & (F.col("bin") == F.col("bin2")) & (F.col("a2") <= F.col("end") + gap) & (F.col("b2") >= F.col("start") - gap), "left_semi")
    met = joined.groupBy("scope", "kind", "start", "end", "role").agg(F.size(F.collect_set("need")).alias("met"))
    return met.where(F.col("met") == F.size(needs[F.col("role")])).select("scope", "kind", "start", "end")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gap: int = GAP) -> DataFrame:
    """(id, scope, base, linked) of each row: arrays of (start, rank, kind, end), strong findings and linked weak ones."""
    scanned = save(scan(docs, id_col, text_col))
    strong = F.filter("parts", lambda p: p["rank"] < 3)
    several = scanned.where((F.size("parts") > 1) & F.exists("parts", lambda p: p["rank"] >= 3))
    linked = link(several.select("scope", F.explode("parts").alias("p")).select("scope", "p.kind", "p.start", "p.end"), gap)
    rank = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    linked = linked.groupBy("scope").agg(F.array_sort(F.collect_list(F.struct("start", rank[F.col("kind")].alias("rank"), "kind", "end"))).alias("linked"))
    empty = F.filter("parts", lambda p: F.lit(False))
    return scanned.join(linked, "scope", "left").select(id_col, "scope", strong.alias("base"), F.coalesce("linked", empty).alias("linked"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gap: int = GAP) -> DataFrame:
    """docs with every finding in its text replaced by `[kind]`; overlapping findings become one. Other columns stay."""
    spans = find_secrets(docs, id_col, text_col, gap).select("scope", F.array_sort(F.concat("base", "linked")).alias("spans")).where(F.size("spans") > 0).dropDuplicates(["scope"])

    @F.pandas_udf("string")
    def cut(texts, spans):  # noqa: ANN001, ANN202
        out = []
        for text, own in zip(texts, spans, strict=True):
            if own is not None and len(own):
                done, pieces = 0, []
                for s in own:
                    if s["start"] >= done:
                        pieces += [text[done : s["start"]], f"[{s['kind']}]"]
                    done = max(done, s["end"])
                text = "".join(pieces) + text[done:]
            out.append(text)
        return texts.__class__(out, dtype=object)

    # A row travels as one struct, so that none of its columns can clash with those of the spans.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), row_key(id_col, text_col).alias("scope"))
    text = F.col("row")[text_col]
    rows = rows.join(spans, "scope", "left").withColumn("text", F.coalesce(cut(F.when(F.col("spans").isNotNull(), text), F.col("spans")), text))
    return rows.select(*[F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
