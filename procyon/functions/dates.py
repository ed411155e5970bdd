"""Date parsing as column expressions. Values are UTC, as timestamps without a zone; nothing is guessed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import Chain, nest

ZONE = "Africa/Johannesburg"
END_OF_DAY = (23, 59, 59)
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
LONG = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")

# The forms of dates and times that are recognised.
ISO = r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}(:\d{2}(\.\d+)?)?([+-]\d{2}:?\d{2})?)?$"
YMD = r"\b\d{4}[-/]\d{1,2}[-/]\d{1,2}\b"
DMY = r"\b\d{1,2}[-/.]\d{1,2}[-/.]\d{4}\b"
DAY_MONTH = r"\b\d{1,2}\s+[A-Za-z]+\s+\d{4}\b"
MONTH_DAY = r"\b[A-Za-z]+\s+\d{1,2},?\s+\d{4}\b"
CLOCK = r"(?i)\b\d{1,2}\s*(?::|h)\s*\d{2}(?::\d{2})?\s*(am|pm)?\b"
#: What a text must hold to be changed by cleaning: an ordinal, "at" or a blank other than " " (or two of these, or one at an end).
ODD = r"[\x09-\x0D\x{00A0}]|\d[sSnNrRtT]|[aA][tT]"
OFFSET = r"[+-]\d{2}:?\d{2}$"


def _found(text: Column, pattern: str) -> Column:
    """The first match; empty without one."""
    return F.regexp_extract(text, pattern, 0)


def _int(text: Column) -> Column:
    """A number; null for an empty text, whose cast would cost an exception in every row."""
    return F.when(text != "", text.try_cast("int"))


def _piece(text: Column, mark: str, place: int) -> Column:
    """What split_part gives, which splits by a regular expression; empty beyond the last piece."""
    return F.substring_index(F.substring_index(F.concat(text, F.lit(mark)), mark, place), mark, -1)


def _n(text: Column, mark: str, place: int) -> Column:
    """The number at a place of a text split at a mark: a match is taken apart without another regular expression."""
    return _int(_piece(text, mark, place))


def _month(name: Column) -> Column:
    names = [(n, i + 1) for i, n in enumerate(MONTHS)] + [(n, i + 1) for i, n in enumerate(LONG) if n != "may"] + [("sept", 9)]
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in names for x in kv]), F.lower(name))


def _moment(y: Column, m: Column, d: Column, h: Column, mi: Column, s: Column) -> Column:
    return F.call_function("try_make_timestamp_ntz", y, m, d, h, mi, s.cast("decimal(16,6)"))


def _minutes(offset: Column) -> Column:
    """Minutes of a numeric offset as it was found; null for an empty one."""
    minutes = _int(F.substring(offset, 2, 2)) * 60 + _int(F.right(offset, F.lit(2)))
    return F.when(F.substring(offset, 1, 1) == "-", -minutes).otherwise(minutes)


def _loose(p: Column, at: Callable[[Column, Column, Column], Column]) -> Column:
    """The first date in free text, by the order of the forms; p holds what was found of each."""
    ymd, dmy, dm, md = (p[c] for c in ("ymd", "dmy", "dm", "md"))
    day = [_n(dmy, "-", g) for g in (1, 2, 3)]
    word, month = _month(_piece(dm, " ", 2)), _month(_piece(md, " ", 1))
    out = F.when(ymd != "", at(*[_n(ymd, "-", g) for g in (1, 2, 3)]))
    out = out.when((dmy != "") & (day[1] <= 12), F.coalesce(at(day[2], day[1], day[0]), at(day[2], day[0], day[1])))
    out = out.when((dm != "") & word.isNotNull(), at(_n(dm, " ", 3), word, _n(dm, " ", 1)))
    return out.when((md != "") & month.isNotNull(), at(_n(md, " ", 3), month, _n(md, " ", 2)))


def clock_of(found: Column) -> Column:
    """struct(h, m, s) of a match of CLOCK; null without one or if it is impossible."""
    plain = F.translate(F.lower(found), "h ", ":")
    half, plain = F.right(plain, F.lit(2)), F.rtrim(plain, F.lit("apm"))
    h = _n(plain, ":", 1)
    h = F.when((half == "pm") & (h < 12), h + 12).when((half == "am") & (h == 12), 0).otherwise(h)
    m, s = _n(plain, ":", 2), F.coalesce(_n(plain, ":", 3), F.lit(0))
    return F.when((h <= 23) & (m <= 59) & (s <= 59), F.struct(h.alias("h"), m.alias("m"), s.alias("s")))


def datetime_chain(raw: Column, zone: Column | str = ZONE, default: tuple[int, int, int] = (0, 0, 0), iso_end_of_day: bool = False) -> Chain:
    """parse_datetime in steps, for `stage` or `nest`."""
    zone = F.lit(zone) if isinstance(zone, str) else zone
    zero = F.lit(0)
    none = F.lit("")

    text = F.regexp_replace(raw, r"(?i)(?<=\d)(st|nd|rd|th)\b", "")
    text = F.regexp_replace(F.replace(text, F.lit("\u00a0"), F.lit(" ")), r"(?i)\bat\b", " ")
    odd = F.contains(raw, F.lit("  ")) | raw.startswith(" ") | raw.endswith(" ") | raw.rlike(ODD)
    clean = F.when(odd, F.trim(F.regexp_replace(text, r"\s+", " "))).otherwise(raw)
    first = F.struct(clean.alias("text"), raw.alias("raw"))

    def isolate(p: Column) -> Column:
        text = F.replace(p["text"], F.lit("Z"), F.lit("+00:00"))
        gap = F.locate(" ", text)
        iso = F.when(gap > 0, F.concat(F.substring(text, 1, gap - 1), F.lit("T"), F.substring(text, gap + 1, F.length(text)))).otherwise(text)
        return F.struct(p["raw"].alias("raw"), p["text"].alias("text"), iso.alias("iso"))

    def find(p: Column) -> Column:
        """An ISO text as it is, of others what the forms of digits find; days with a month's name are looked for next."""
        text, plain = p["text"], p["iso"].rlike(ISO)
        loose = lambda pattern: F.when(plain, none).otherwise(_found(text, pattern))
        found = {"text": F.when(plain, none).otherwise(text), "ymd": F.translate(loose(YMD), "/", "-"), "dmy": F.translate(loose(DMY), "/.", "--")}
        return F.struct(p["raw"].alias("raw"), F.when(plain, p["iso"]).alias("iso"), loose(OFFSET).alias("shift"), _found(text, CLOCK).alias("clock"), *[v.alias(k) for k, v in found.items()])

    def measure(p: Column) -> Column:
        iso = p["iso"]
        given = F.length(iso) > 10
        tail = F.substring(iso, 17, 40)
        signed = F.substring_index(F.translate(tail, "-", "+"), "+", -1)
        shift = F.when(given & (F.length(signed) < F.length(tail)), F.right(iso, F.length(signed) + 1))
        seconds = F.when(F.substring(iso, 17, 1) == ":", F.substring(iso, 18, 2).try_cast("int"))
        h, m = F.substring(iso, 12, 2).try_cast("int"), F.substring(iso, 15, 2).try_cast("int")
        end = default if iso_end_of_day else (0, 0, 0)
        clock = [F.when(given, F.coalesce(x, zero)).otherwise(F.lit(d)) for x, d in zip((h, m, seconds), end, strict=True)]
        exact = _moment(F.substring(iso, 1, 4).try_cast("int"), F.substring(iso, 6, 2).try_cast("int"), F.substring(iso, 9, 2).try_cast("int"), *clock)
        kept = [p[c].alias(c) for c in ("raw", "ymd", "dmy")]
        settled = (p["ymd"] != "") | F.coalesce((p["dmy"] != "") & (_n(p["dmy"], "-", 2) <= 12), F.lit(False)) | (p["text"] == "")
        named = lambda pattern: F.when(settled, none).otherwise(_found(p["text"], pattern))
        kept += [named(DAY_MONTH).alias("dm"), F.translate(named(MONTH_DAY), ",", "").alias("md")]
        return F.struct(*kept, exact.alias("exact"), F.coalesce(given, F.lit(False)).alias("given"), _minutes(shift).alias("iso_shift"), _minutes(p["shift"]).alias("shift"), clock_of(p["clock"]).alias("clock"))

    def place(p: Column) -> Column:
        h, m, s = (F.coalesce(p["clock"][c], F.lit(x)) for c, x in zip("hms", default, strict=True))
        kept = [p[c].alias(c) for c in ("raw", "exact", "given", "iso_shift", "shift", "clock")]
        return F.struct(*kept, _loose(p, lambda y, mo, d: _moment(y, mo, d, h, m, s)).alias("loose"))

    def utc(local: Column, shift: Column) -> Column:
        moved = F.call_function("convert_timezone", zone, F.lit("UTC"), local)
        return F.when(shift.isNotNull(), local - F.make_dt_interval(zero, zero, shift, zero)).otherwise(moved)

    def result(p: Column) -> Column:
        exact, loose = p["exact"], p["loose"]
        value = F.when(exact.isNotNull(), utc(exact, p["iso_shift"])).otherwise(utc(loose, p["shift"]))
        has_time = F.when(exact.isNotNull(), p["given"]).otherwise(p["clock"].isNotNull() & loose.isNotNull())
        sure = F.when(exact.isNotNull(), 1.0).when(loose.isNull(), 0.0).when(p["clock"].isNotNull() | p["shift"].isNotNull(), 0.9).otherwise(0.7)
        return F.struct(value.alias("value"), p["raw"].alias("raw"), F.when(F.coalesce(exact, loose).isNotNull(), zone).alias("zone"), F.coalesce(has_time, F.lit(False)).alias("has_time"), sure.alias("confidence"))

    return first, [isolate, find, measure, place, result]


def parse_datetime(raw: Column, zone: Column | str = ZONE, default: tuple[int, int, int] = (0, 0, 0), iso_end_of_day: bool = False) -> Column:
    """struct(value, raw, zone, has_time, confidence). For many rows `stage` with datetime_chain is faster.

    In order: ISO 8601; an ISO date in the text; day first, month first if only that is possible; `15 September 2026`;
    `September 15, 2026`. default: the time of a date without one (ISO dates keep midnight unless iso_end_of_day).
    """
    return nest(*datetime_chain(raw, zone, default, iso_end_of_day))


def parse_closing_datetime(raw: Column, zone: Column | str = ZONE, iso_end_of_day: bool = False) -> Column:
    """A closing date without a time ends at 23:59:59 local."""
    return parse_datetime(raw, zone, END_OF_DAY, iso_end_of_day)


def ensure_utc(local: Column, zone: Column | str = ZONE) -> Column:
    return F.call_function("convert_timezone", F.lit(zone) if isinstance(zone, str) else zone, F.lit("UTC"), local)


def to_iso(value: Column) -> Column:
    return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss'Z'")
