"""Display formats."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Numbers of the wire contract's error codes by what they say; a deployment puts its own prefix before them.
ERROR_CODES = (
    (4000, "NO_HANDLER_FOR_COMMAND"), (4001, "COMMAND_DISPATCH_ERROR"), (4002, "COMMAND_EXECUTION_ERROR"),
    (4003, "COMMAND_EXECUTION_NON_TRANSIENT_ERROR"), (4004, "CONCURRENCY_EXCEPTION"), (4005, "COMMAND_TIMEOUT"),
    (4100, "NO_HANDLER_FOR_QUERY"), (4101, "QUERY_DISPATCH_ERROR"), (4102, "QUERY_EXECUTION_ERROR"), (4105, "QUERY_TIMEOUT"),
    (4200, "APPEND_CONDITION_FAILED"), (4201, "CONTEXT_NOT_FOUND"), (4202, "INVALID_EVENT"),
    (5000, "INTERNAL_ERROR"), (5001, "NOT_LEADER"), (5002, "AUTHENTICATION_FAILED"),
)


@F.pandas_udf(T.StringType())
def number(n: pd.Series) -> pd.Series:
    """1.23M, 12.3K, or with commas: the ties of %.1f and %.2f round as in C."""
    return n.map(lambda x: None if pd.isna(x) else f"{x / 1e6:.2f}M" if x >= 1_000_000 else f"{x / 1e3:.1f}K" if x >= 10_000 else f"{int(x):,}")


@F.pandas_udf(T.StringType())
def size(n: pd.Series) -> pd.Series:
    gb, mb, kb = 1 << 30, 1 << 20, 1 << 10
    return n.map(lambda x: None if pd.isna(x) else f"{x / gb:.1f} GB" if x >= gb else f"{x / mb:.0f} MB" if x >= mb else f"{x / kb:.0f} KB" if x >= kb else f"{int(x)} B")


@F.pandas_udf(T.StringType())
def pretty_json(text: pd.Series) -> pd.Series:
    def one(t):
        try:
            return None if t is None else json.dumps(json.loads(t), indent=2, sort_keys=True, ensure_ascii=False)
        except ValueError:
            return t

    return text.map(one)


def timestamp(ms: Column) -> Column:
    """UTC, with milliseconds; the session's time zone must be UTC."""
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd HH:mm:ss.SSS")


def _units(seconds: Column) -> tuple[Column, Column, Column, Column]:
    s = seconds.cast("long")
    whole = lambda c: c.cast("long")
    return whole(F.floor(s / 86400)), whole(F.floor(s / 3600) % 24), whole(F.floor(s / 60) % 60), s % 60


def uptime(seconds: Column) -> Column:
    """All units from the largest that isn't zero down to seconds."""
    d, h, m, s = _units(seconds)
    return F.when(d > 0, F.format_string("%dd %dh %dm %ds", d, h, m, s)).when(h > 0, F.format_string("%dh %dm %ds", h, m, s)).when(m > 0, F.format_string("%dm %ds", m, s)).otherwise(F.format_string("%ds", s))


def ago(seconds: Column) -> Column:
    """The two largest units, as a time past."""
    d, h, m, s = _units(seconds)
    return F.when(d > 0, F.format_string("%dd %dh ago", d, h)).when(h > 0, F.format_string("%dh %dm ago", h, m)).when(m > 0, F.format_string("%dm %ds ago", m, s)).otherwise(F.format_string("%ds ago", s))


def connected(seconds: Column) -> Column:
    """Days with hours and minutes, else the two largest units."""
    d, h, m, s = _units(seconds)
    return F.when(d > 0, F.format_string("%dd %dh %dm", d, h, m)).when(h > 0, F.format_string("%dh %dm", h, m)).when(m > 0, F.format_string("%dm %ds", m, s)).otherwise(F.format_string("%ds", s))


def preview(payload: Column, most: int = 4096) -> Column:
    """Valid UTF-8 up to so many bytes, with dots where more follows; else half as many bytes in hexadecimal, with dots."""
    cut = F.decode(F.substr(payload, F.lit(1), F.lit(most)), "UTF-8")
    text = F.concat(cut, F.when(F.length(payload) > most, "...").otherwise(""))
    return F.when(F.is_valid_utf8(payload.cast("string")), text).otherwise(F.concat(F.lower(F.hex(F.substr(payload, F.lit(1), F.lit(most // 2)))), F.lit("...")))


def _replaced(text: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    for a, b in pairs:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def html_escape(text: Column) -> Column:
    return _replaced(text, (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")))


def json_escape(text: Column) -> Column:
    return _replaced(text, (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")))


def peers(text: Column) -> Column:
    """id=address pairs, split at the first =; entries without a number before it are dropped."""
    parts = F.transform(F.split(text, ","), lambda p: F.split(F.trim(p), "=", 2))
    return F.transform(F.filter(parts, lambda p: (F.size(p) == 2) & p[0].rlike("^[0-9]+$")), lambda p: F.struct(p[0].cast("long").alias("id"), p[1].alias("address")))
