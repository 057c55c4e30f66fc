"""Text to numbers and times, null where the text is not one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that mean "not set" in an exported marker field.
UNSET_MARKERS = ["", "0", "False", "false"]


def filled(value: Column) -> Column:
    return F.coalesce(value != "", F.lit(False))


def has_items(value: Column) -> Column:
    return F.coalesce(F.size(value) > 0, F.lit(False))


def marked(value: Column) -> Column:
    """True for any text but the unset ones."""
    return F.coalesce(~value.isin(UNSET_MARKERS), F.lit(False))


def first_filled(*values: Column) -> Column:
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def _based(text: Column, prefix: str, digits: str, base: int) -> tuple[Column, Column]:
    body = F.conv(F.regexp_replace(text, f"^[+-]?0{prefix}", ""), base, 10).try_cast("bigint")
    return (text.rlike(f"^[+-]?0{prefix}{digits}+$"),
            F.when(text.startswith("-"), -body).otherwise(body))


def _integer(value: Column, decimal: str) -> Column:
    text = F.trim(value)
    result = F.when(text.rlike(decimal), text.try_cast("bigint"))
    for prefix, digits, base in (("[xX]", "[0-9a-fA-F]", 16), ("[oO]", "[0-7]", 8),
                                 ("[bB]", "[01]", 2)):
        matches, number = _based(text, prefix, digits, base)
        result = result.when(matches, number)
    return result


def safe_int(value: Column) -> Column:
    """Prefixed hexadecimal, octal or binary, else decimal; null when neither."""
    return _integer(value, r"^[+-]?[0-9]+$")


def row_int(value: Column) -> Column:
    """As `safe_int`, but a decimal with leading zeros is not a number."""
    return _integer(value, r"^[+-]?(0+|[1-9][0-9]*)$")


def first_row_int(value: Column) -> Column:
    """The first of several values joined by `|` or `,`."""
    return row_int(F.regexp_extract(value, r"^([^|,]*)", 1))


def plain_int(value: Column) -> Column:
    """Hexadecimal only behind a lower-case 0x, decimal otherwise."""
    return F.when(value.rlike("^0x[0-9a-fA-F]+$"),
                  F.conv(F.substring(value, 3, 64), 16, 10).try_cast("bigint")).when(
        F.trim(value).rlike(r"^[+-]?[0-9]+$"), F.trim(value).try_cast("bigint"))


def safe_float(value: Column) -> Column:
    text = F.trim(value)
    return F.when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"),
                  text.try_cast("double"))


def epoch(value: Column) -> Column:
    """Exact seconds, nine decimals."""
    return value.try_cast("decimal(20,9)")


def relative(value: Column) -> Column:
    """Seconds without the unit a display value may carry."""
    return F.get(F.split(F.trim(value), r"\s+"), F.lit(0)).try_cast("decimal(20,9)")


def nanoseconds(seconds: Column) -> Column:
    return (seconds.cast("decimal(20,9)") * F.lit(1_000_000_000)).cast("bigint")


def packet_time_ns() -> Column:
    """Capture time of a packet: the exact epoch text if it has one, else the timestamp.

    A text that is no number counts as a missing time and does not fall back.
    """
    clock = F.unix_micros(F.col("timestamp").cast("timestamp")) * 1000
    return F.when(filled(F.col("timestamp_epoch")),
                  nanoseconds(epoch(F.col("timestamp_epoch")))).otherwise(clock)


def vlan_stack(value: Column) -> Column:
    """Every all-digit id of a comma list, in order."""
    return F.transform(
        F.filter(F.split(value, ","), lambda v: v.rlike("^[0-9]+$")), lambda v: v.cast("int"))


def comma_items(value: Column) -> Column:
    parts = F.transform(F.split(value, ","), lambda v: F.trim(v))
    return F.coalesce(F.filter(parts, lambda v: v != ""), F.array().cast("array<string>"))
