"""Scalar rules of the canonical model, as column expressions (no UDFs)."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
TRUE_TOKENS = ("1", "true", "True", "TRUE", "yes", "Yes", "YES")
HIGH_RISK_DESTINATIONS = ("AE", "RU", "CY", "NG", "TR")
CITATION = r"\bT[123]-\d{3}\b"
CURRENCY = r"\A[A-Z]{3}\z"
ISO_O = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'0+00:00'"


def ws_trim(x: Column) -> Column:
    """All white space off both ends (``trim`` strips spaces only)."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def blank_to_null(x: Column) -> Column:
    return F.nullif(ws_trim(x), F.lit(""))


def first_non_blank(*columns: Column) -> Column:
    return F.coalesce(*[blank_to_null(c) for c in columns])


def parse_amount(x: Column) -> Column:
    """Decimal from text with thousands separators, exponent, currency sign or accounting parentheses; null if none."""
    t = ws_trim(x)
    negative = t.rlike(r"^\(.*\)$")
    plain = F.regexp_replace(F.regexp_replace(t, r"[,\s$¤€£]", ""), r"^\((.*)\)$", "$1")
    value = plain.try_cast("decimal(38,10)")
    return F.when(negative, -value).otherwise(value)


def parse_timestamp(x: Column) -> Column:
    t = ws_trim(x)
    return F.coalesce(F.try_to_timestamp(t), F.try_to_timestamp(t, F.lit("MM/dd/yyyy HH:mm:ss")), F.try_to_timestamp(t, F.lit("MM/dd/yyyy")))


def parse_currency(x: Column) -> Column:
    """Upper-case code; a blank one is null.  Validity is :func:`bad_currency`'s."""
    return F.upper(blank_to_null(x))


def bad_currency(x: Column) -> Column:
    code = parse_currency(x)
    return code.isNotNull() & ~code.rlike(CURRENCY)


def parse_flag(x: Column) -> Column:
    return F.coalesce(ws_trim(x).isin(*TRUE_TOKENS), F.lit(False))


def round4(x: Column) -> Column:
    """Half to even, four places."""
    return F.bround(x, 4)


def clamp01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def citations(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CITATION), F.lit(0))


def comma_list(x: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), ","), ws_trim), lambda v: v != "")


def key_values(x: Column) -> Column:
    """``k=v;k=v`` as a map."""
    return F.str_to_map(x, F.lit(";"), F.lit("="))


def iso_o(ts: Column) -> Column:
    return F.date_format(ts, ISO_O)


def as_text(x: Column, kind: str) -> Column:
    """Typed database values as invariant text."""
    if kind == "timestamp":
        return iso_o(x)
    if kind == "boolean":
        return F.initcap(x.cast("string"))
    return x.cast("string")


def escape_field(x: Column) -> Column:
    """A field of the canonical serialisation: null is empty; the separators are escaped."""
    return F.coalesce(F.regexp_replace(x.cast("string"), r"([\\|;,])", r"\\$1"), F.lit(""))


def table_of(sql: Column) -> Column:
    """The table named after FROM."""
    return F.nullif(F.regexp_extract(sql, r"(?i)\sFROM\s+([^\s;]+)", 1), F.lit(""))


def redact(text: Column, names: list[str]) -> Column:
    return F.regexp_replace(text, "(" + "|".join(map(re.escape, names)) + r")=\S+", "$1=***REDACTED***") if names else text


def up_to_four(x: Column) -> Column:
    """A number with at most four decimal places and no trailing zeros."""
    return F.regexp_replace(F.format_string("%.4f", F.bround(x.cast("double"), 4)), r"\.?0+$", "")


def percent(x: Column) -> Column:
    return F.format_string("%.1f%%", x * 100)


def points(x: Column) -> Column:
    return F.format_string("%+.1f pp", x * 100)


def truncate(x: Column, n: int) -> Column:
    return F.when(F.length(x) <= n, x).otherwise(F.concat(F.left(x, F.lit(n - 3)), F.lit("...")))


def combine_url(base: str, path: str | None) -> str:
    return base if not path else f"{base.rstrip('/')}/{path.lstrip('/')}"


def connection_variable(profile: str) -> str:
    """The environment variable that holds a connection profile."""
    return "AML_CONN_" + re.sub(r"[^A-Z0-9]", "_", profile.upper())


def connection(profile: str) -> str:
    name = connection_variable(profile)
    if not os.environ.get(name):
        raise LookupError(f"connection profile {profile!r}: {name} is not set")
    return os.environ[name]
