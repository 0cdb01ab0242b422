"""Exact conversions as columns: anchored patterns stand before Spark's lenient parsers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.types import EXACT_INT

# The forms that are taken.
INSTANT_FORM = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"
DATETIME_FORM = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?$"
DATE_FORM = r"^\d{4}-\d{2}-\d{2}$"
TIME_FORM = r"^([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d{1,6})?$"
LONG_FRACTION = r"\.\d{7,}"


def is_instant(text: Column) -> Column:
    """RFC 3339 with an offset."""
    return text.rlike(INSTANT_FORM) & F.try_to_timestamp(F.upper(text)).isNotNull()


def to_instant(text: Column) -> Column:
    """The instant, or null for other forms and for fractions beyond microseconds."""
    return F.when(text.rlike(INSTANT_FORM) & ~text.rlike(LONG_FRACTION), F.try_to_timestamp(F.upper(text)))


def to_datetime(text: Column) -> Column:
    return F.when(text.rlike(DATETIME_FORM), text.try_cast("timestamp_ntz"))


def to_date(text: Column) -> Column:
    return F.when(text.rlike(DATE_FORM), text.try_cast("date"))


def to_time(text: Column) -> Column:
    """Microseconds of the day."""
    seconds = F.substring(text, 1, 2).try_cast("long") * 3600 + F.substring(text, 4, 2).try_cast("long") * 60 + F.substring(text, 7, 2).try_cast("long")
    return F.when(text.rlike(TIME_FORM), seconds * 1_000_000 + F.rpad(F.coalesce(F.nullif(F.regexp_extract(text, r"\.(\d+)$", 1), F.lit("")), F.lit("0")), 6, "0").try_cast("long"))


def to_decimal(text: Column, precision: int, scale: int) -> Column:
    """Exact decimals: no longer fraction, no larger magnitude, no exponent."""
    plain = F.trim(text)
    form = rf"^-?(\d+\.?\d{{0,{scale}}}|\.\d{{1,{scale}}})$" if scale else r"^-?\d+\.?$"
    return F.when(plain.rlike(form), plain.try_cast(T.DecimalType(precision, scale)))


def int_is_exact(value: Column) -> Column:
    """Whether a long is a double without loss."""
    return value.between(-EXACT_INT, EXACT_INT)


def decimal_text(value: Column) -> Column:
    """Exact text of a decimal at its scale, without exponent."""
    return value.cast("string")


def length_prefixed(value: Column) -> Column:
    """UTF-8 bytes of a text after their number (8 bytes, least first)."""
    return F.concat(long_bytes(F.octet_length(value)), F.encode(value, "utf-8"))


def long_bytes(value: Column) -> Column:
    """A whole number as 8 bytes, least first."""
    digits = F.lpad(F.hex(value), 16, "0")
    return F.unhex(F.concat(*[F.substring(digits, i, 2) for i in range(15, 0, -2)]))


def plain_float(value: Column) -> Column:
    """Digits of a double without exponent, and without a fraction of zero."""
    text = value.cast("string")
    body = F.regexp_replace(text, "^-", "")
    mantissa = F.substring_index(body, "E", 1)
    power = F.coalesce(F.nullif(F.regexp_extract(body, r"E(-?\d+)$", 1), F.lit("")).cast("int"), F.lit(0))
    whole, part = F.substring_index(mantissa, ".", 1), F.regexp_replace(F.substring_index(mantissa, ".", -1), "0+$", "")
    digits = F.concat(whole, part)
    moved = F.when(F.length(part) <= power, F.concat(digits, F.repeat(F.lit("0"), power - F.length(part)))).otherwise(F.concat(F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, F.length(digits))))
    plain = (
        F.when(power > 0, moved)
        .when(power < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), F.regexp_replace(digits, "0+$", "")))
        .otherwise(F.when(part == "", whole).otherwise(F.concat(whole, F.lit("."), part)))
    )
    return F.concat(F.when(text.startswith("-"), F.lit("-")).otherwise(F.lit("")), plain)
