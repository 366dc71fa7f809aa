"""Scalar functions on Columns. All of them are built-in Spark expressions, no Python per row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F, types as T

# Texts that stand for a missing value in study files.
MISSING_TOKENS = (
    "NA",
    "N/A",
    "",
    " ",
    "null",
    "NULL",
    "[Not Available]",
    "Na",
    "[Not Applicable]",
    "[Discrepancy]",
)
# The shorter list used for annotated metadata tables.
TABLE_MISSING_TOKENS = ("NA", "N/A", "", "null", "NULL", "[Not Available]", "Na")

# Accepted digest shapes. A 32-digit digest is md5; etag is what md5 does not match.
HASH_PATTERNS = {
    "md5": r"^[0-9a-f]{32}$",
    "sha1": r"^[0-9a-f]{40}$",
    "sha256": r"^[0-9a-f]{64}$",
    "sha512": r"^[0-9a-f]{128}$",
    "crc32": r"^[0-9a-f]{8}$",
    "etag": r"^[0-9a-f]{32}(-\d+)?$",
    "crc64": r"^[0-9a-f]{16}$",
}

# Accepted link shapes per protocol.
URL_PATTERNS = {
    "node": r"^node://([a-zA-Z0-9@\-_.]+)/(OEP[0-9]+)/(OEX[0-9]+)/(OES[0-9]+)/(OER[0-9]+)/(OED[0-9]+)$",
    "oss": r"^oss://([a-zA-Z0-9@\-_.]+)/(.*)$",
    "s3": r"^s3://([a-zA-Z0-9@\-_.]+)/(.*)$",
    "gsa": r"^gsa://([a-zA-Z0-9@\-_.]+)/(HRA[0-9]+)/(HRS[0-9]+)/(HRX[0-9]+)/(HRR[0-9]+)/(HRR[0-9]+.*)$",
    "minio": r"^minio://([a-zA-Z0-9@\-_.]+)/(.*)$",
}

# Which path part of a link names its project or bucket.
IDENTITY_PART = {"node:": 3, "gsa:": 3, "s3:": 2, "oss:": 2, "minio:": 2}

# Texts read as booleans.
TRUE_TEXTS = ("True", "true", "1")
FALSE_TEXTS = ("False", "false", "0")

# Fixed value: the URL namespace of name-based UUIDs (RFC 4122).
URL_NAMESPACE_HEX = "6ba7b8119dad11d180b400c04fd430c8"


def _first_match(col: Column, patterns: dict[str, str]) -> Column:
    return F.coalesce(*[F.when(col.rlike(pattern), F.lit(name)) for name, pattern in patterns.items()])


def missing_to_null(col: Column, tokens: Sequence[str] = MISSING_TOKENS) -> Column:
    return F.when(~col.isin(*tokens), col)


def hash_type(col: Column) -> Column:
    """Kind of a lower-case hex digest by its length; null when no kind fits."""
    return _first_match(col, HASH_PATTERNS)


def is_hash(col: Column, kind: str) -> Column:
    if kind not in HASH_PATTERNS:
        return F.lit(False)
    return F.coalesce(col.rlike(HASH_PATTERNS[kind]), F.lit(False))


def url_protocol(col: Column) -> Column:
    """Protocol of a well-formed link; null for anything else."""
    return _first_match(col, URL_PATTERNS)


def url_identity(col: Column) -> Column:
    """Project id or bucket of a link, empty text for other schemes."""
    parts = F.split(col, "/")
    scheme = F.get(parts, F.lit(0))
    found = F.coalesce(*[F.when(scheme == name, F.get(parts, F.lit(i))) for name, i in IDENTITY_PART.items()])
    return F.when(col.isNotNull(), F.coalesce(found, F.lit("")))


def event_code(col: Column, data_type: T.DataType) -> Column:
    """1 for an event, 0 for censored or unreadable, null for null.

    Texts such as ``1:DECEASED`` count by their first character, numbers and booleans by value.
    """
    if isinstance(data_type, T.BooleanType):
        hit = col
    elif isinstance(data_type, T.StringType):
        hit = col.startswith("1")
    else:
        hit = col == 1
    return F.when(col.isNotNull(), hit.cast("int"))


def make_guid(prefix: Column | str, uuid: Column) -> Column:
    return F.concat_ws("/", F.lit(prefix) if isinstance(prefix, str) else prefix, uuid)


def guid_prefix(guid: Column) -> Column:
    return F.substring_index(guid, "/", 1)


def guid_uuid(guid: Column) -> Column:
    return F.get(F.split(guid, "/"), F.lit(1))


def uuid5(name: Column) -> Column:
    """Name-based UUID (version 5) in the URL namespace, from the name's UTF-8 bytes."""
    digest = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE_HEX)), name.cast("binary")))
    variant = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int")
    variant_digit = F.lower(F.hex(variant.bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8)).cast("long")))
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant_digit, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def content_guid(content: Column, prefix: str) -> Column:
    """Deterministic guid of some bytes: the name is the sha1 digest of the content."""
    return make_guid(prefix, uuid5(F.sha1(content.cast("binary"))))


def content_baseid(content: Column) -> Column:
    return uuid5(F.md5(content.cast("binary")))


def fingerprints(content: Column) -> Column:
    """All digests of some bytes as a struct."""
    data = content.cast("binary")
    return F.struct(
        F.md5(data).alias("md5"),
        F.sha1(data).alias("sha1"),
        F.sha2(data, 256).alias("sha256"),
        F.sha2(data, 512).alias("sha512"),
    )


def two_decimals(value: Column) -> Column:
    """A number as text with two decimals.

    ``format_number`` rounds the exact binary value; only exact eighths can be true ties, and those
    round away from zero.
    """
    plain = F.call_function("format_number", value, F.lit("0.00"))
    return F.when(value * 8 == F.floor(value * 8), F.format_string("%.2f", value)).otherwise(plain)


def display_number(col: Column) -> Column:
    """Whole numbers as they are, others with at most two decimals and no trailing zeros."""
    value = col.cast("double")
    return F.when(value == F.floor(value), value.cast("decimal(38,0)").cast("string")).otherwise(
        F.regexp_replace(two_decimals(value), r"\.?0+$", "")
    )


def percent_of(part: Column, whole: Column) -> Column:
    """Percentage to two decimals."""
    return two_decimals(part / whole * 100).cast("double")


def hash_of_kind(hashes: Column, kind: str) -> Column:
    """Digests of one kind out of an array of (hash_type, hash) structs."""
    return F.transform(F.filter(hashes, lambda h: h["hash_type"] == kind), lambda h: h["hash"])


def preferred_url(urls: Column) -> Column:
    """The first link that a browser can fetch, that is one not starting with ``node``."""
    return F.get(F.filter(urls, lambda u: ~u["url"].startswith("node")), F.lit(0))


def json_text(col: Column) -> Column:
    """Parse a text that starts like a JSON object or array; anything else is null."""
    return F.when(col.rlike(r"^[{\[]"), F.try_parse_json(col))


def boolean_value(col: Column) -> Column:
    return F.when(col.isin(*TRUE_TEXTS), F.lit(True)).when(col.isin(*FALSE_TEXTS), F.lit(False))


def access_of(acl: Column) -> Column:
    return F.when(acl.isNull(), F.lit("public")).otherwise(F.lit("private"))


def epoch_day_label(millis: Column) -> Column:
    """``vYYYYMMDD`` (UTC) of an epoch-millisecond value, whatever the session time zone."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(millis / 86400000).cast("int"))
    return F.concat(F.lit("v"), F.date_format(day, "yyyyMMdd"))
