"""Publication dates (C2) and the publication-year range."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import OPEN_END_YEAR, OPEN_START_YEAR

DEFAULT_FALLBACK = _dt.datetime(2024, 6, 1)


def _py_int(s: Column) -> Column:
    """int(s) as Python does it for ASCII text: optional sign, digits that may
    be grouped by single underscores, surrounding white space; else null."""
    ok = s.rlike(r"^\s*[+-]?[0-9]+(_[0-9]+)*\s*$")
    clean = F.regexp_replace(F.trim(s), "_", "")
    return F.when(ok, clean.try_cast("int"))


def parse_pub_date(dp: Column) -> Column:
    """Nullable timestamp_ntz; null where the reference falls back to "now".

    Rules: keep the text before the first space; fewer than four characters
    fail; year = chars 1-4, month = chars 6-7 (when length >= 7, else 1),
    day = chars 9-10 (when length >= 10, else 1); separators are not checked;
    any non-number or impossible date fails.
    """
    head = F.split_part(F.coalesce(dp, F.lit("")), F.lit(" "), F.lit(1))
    n = F.length(head)
    year = _py_int(F.substring(head, 1, 4))
    month = F.when(n >= 7, _py_int(F.substring(head, 6, 2))).otherwise(F.lit(1))
    day = F.when(n >= 10, _py_int(F.substring(head, 9, 2))).otherwise(F.lit(1))
    zero = F.lit(0)
    ts = F.try_make_timestamp_ntz(year, month, day, zero, zero, zero)
    return F.when((n >= 4) & (year >= 1), ts)


def with_fallback(parsed: Column, fallback: _dt.datetime = DEFAULT_FALLBACK) -> Column:
    return F.coalesce(parsed, F.lit(fallback).cast("timestamp_ntz"))


def year_bounds(start_year: Column, end_year: Column) -> tuple[Column, Column]:
    """(lo, hi) of the inclusive year filter; both null means no filter.

    Truthiness as in the reference: 0 or null means "not given".
    """
    s = F.coalesce(start_year, F.lit(0))
    e = F.coalesce(end_year, F.lit(0))
    lo = F.when(s != 0, s).when(e != 0, F.lit(OPEN_START_YEAR))
    hi = F.when(e != 0, e).when(s != 0, F.lit(OPEN_END_YEAR))
    return lo, hi


def in_year_range(year: Column, lo: Column, hi: Column) -> Column:
    """True when no bound is given, else year within [lo, hi]."""
    return lo.isNull() | F.coalesce(year.between(lo, hi), F.lit(False))
