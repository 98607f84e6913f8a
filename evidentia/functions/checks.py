"""Predicates and text helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the reports and ledgers.
STATUSES = ["CURRENT", "HISTORY", "REVIEW", "UNKNOWN"]
PRIORITY = ["REVIEW", "UNKNOWN", "HISTORY", "CURRENT"]
ACTIONS = ["decide", "start", "finish"]
DISPOSITIONS = ["confirm", "reject", "investigate", "defer"]
STAGES = ["triage", "evidence", "decision"]


def non_empty(c: Column) -> Column:
    """Some character that is not white space, in the wide sense that also counts U+001C to U+001F."""
    return F.coalesce(c.rlike(r"(?U)[^\s\x1C-\x1F]"), F.lit(False))


def strict_date(c: Column) -> Column:
    """A real calendar day from year 1 on, written YYYY-MM-DD."""
    return F.coalesce(c.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z") & ~c.startswith("0000") & F.try_to_date(c, "yyyy-MM-dd").isNotNull(), F.lit(False))


def timestamp_with_offset(c: Column) -> Column:
    """Date, ``T``, time with seconds, optional fraction, and ``Z`` or an offset below 24 hours.

    Fields are checked by pattern: casts refuse offsets beyond 18 hours that are valid here.
    """
    shape = c.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\.[0-9]+)?(Z|[+-]([01][0-9]|2[0-3]):[0-5][0-9])\z")
    return F.coalesce(shape, F.lit(False)) & strict_date(F.substring(c, 1, 10))


def utc_timestamp(c: Column) -> Column:
    return timestamp_with_offset(c) & c.endswith("Z")


def sha256_text(c: Column) -> Column:
    return F.coalesce(c.rlike(r"\A[0-9a-f]{64}\z"), F.lit(False))


AUTHORITY = r"\A[hH][tT][tT][pP][sS]://([^/?#]*)"


def https_url(c: Column) -> Column:
    """HTTPS with a host and a usable port, without credentials, backslashes, white space or control characters.

    The authority is cut by pattern, since Java's URI type refuses hosts with underscores.
    """
    authority = F.regexp_extract(c, AUTHORITY, 1)
    host = F.regexp_extract(authority, r"\A(\[[0-9A-Fa-f:.]+\]|[^:\[\]]*)(:[0-9]*)?\z", 1)
    port = F.regexp_extract(authority, r":([0-9]*)\z", 1)
    fine = c.rlike(AUTHORITY) & (host != "") & ~authority.contains("@") & ~c.rlike(r"(?U)[\\\s\p{Cc}]") & ((port == "") | (F.coalesce(port.try_cast("int"), F.lit(99999)) <= 65535))
    return F.coalesce(fine, F.lit(False))


def safe_link(c: Column) -> Column:
    """What may become a link in a rendered page: an https_url without quotes, angle brackets or port 0."""
    return https_url(c) & ~c.rlike("[\"'<>]") & ~F.regexp_extract(c, AUTHORITY, 1).rlike(":0+\\z")


def html_escape(c: Column) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def effective(as_of: Column, start: Column, end: Column) -> Column:
    """Half-open interval; a null end is open."""
    return (start <= as_of) & (end.isNull() | (as_of < end))


def document_name(content_sha256: Column) -> Column:
    return F.concat(F.lit("document-"), F.substring(content_sha256, 1, 12), F.lit(".hwpx"))


def local_name(tag: Column) -> Column:
    return F.substring_index(tag, "}", -1)


def section_key(name: Column) -> Column:
    """Numeric order of a section entry without big integers: struct<size, digits>, null for other entries."""
    plain = F.regexp_replace(F.regexp_replace(name, "/(\\./)+", "/"), "/+", "/")
    digits = F.regexp_extract(plain, r"\A(?:\./)*Contents/section([0-9]+)\.xml\z", 1)
    bare = F.regexp_replace(digits, "\\A0+(?=[0-9])", "")
    return F.when(digits != "", F.struct(F.length(bare).alias("size"), bare.alias("digits")))


def repeated(rows: DataFrame, *key: str) -> DataFrame:
    """(key..., n): keys that more than one row has; nulls equal each other.  Counts meet after they are made up in each task."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
