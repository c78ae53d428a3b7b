"""Scalar column functions (P, SC): ids, numbers in text, ranges, dates, sessions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that stand for a missing number, and the unit suffixes.
MISSING = ["--", "-", "不变", "新进", ""]
UNITS = {"万亿": 1e12, "亿": 1e8, "万": 1e4, "%": 0.01}


def entity_part(entity_id: Column, part: int) -> Column:
    """P-3: 1 type, 2 exchange, 3 code of ``type_exchange_code``."""
    return F.try_element_at(F.split(entity_id, "_", 3), F.lit(part))


def china_stock_id(code: Column) -> Column:
    """P-3: 600000 to 799999 are sh, other codes from 400000 on bj, the rest sz."""
    n = code.try_cast("int")
    exchange = F.when((n >= 600000) & (n < 800000), "sh").when(n >= 400000, "bj").otherwise("sz")
    return F.concat_ws("_", F.lit("stock"), exchange, code)


def to_float(text: Column) -> Column:
    """P-9: number text with commas and a unit; NULL for a word that stands for none."""
    t = F.replace(F.trim(text), F.lit(","), F.lit(""))
    value, unit = F.lit(None).cast("double"), F.regexp_extract(t, "(万亿|亿|万|%)$", 1)
    number = F.regexp_replace(t, "(万亿|亿|万|%)$", "").try_cast("double")
    for u, scale in UNITS.items():
        value = F.when(unit == u, number * scale).otherwise(value)
    return F.when(t.isin(MISSING), None).when(unit == "", number).otherwise(value)


def in_session(ts: Column, sessions=(("09:30", "11:30"), ("13:00", "15:00"))) -> Column:
    """F-17: the time of day lies in a session, ends included."""
    at = F.date_format(ts, "HH:mm")
    ok = F.lit(False)
    for a, b in sessions:
        ok = ok | at.between(a, b)
    return ok


def limit_hit(code: Column, change: Column) -> Column:
    """F-11: 1 or -1 where the change reaches the limit of the code's board, else 0."""
    wide = code.rlike("^(83|87|88|889|82|920)")
    mid = code.rlike("^(300|301|688)")
    up = F.when(wide, change >= 0.29).when(mid, change >= 0.19).otherwise(change > 0.09)
    down = F.when(wide, change <= -0.29).when(mid, change <= -0.19).otherwise(change < -0.09)
    return F.when(up, 1).when(down, -1).otherwise(0)


def intersect(a: tuple[Column, Column], b: tuple[Column, Column]) -> tuple[Column, Column]:
    """SC-8: the shared part of two closed ranges, NULLs if there is none."""
    lo, hi = F.greatest(a[0], b[0]), F.least(a[1], b[1])
    return F.when(lo <= hi, lo), F.when(lo <= hi, hi)


def combine(a: tuple[Column, Column], b: tuple[Column, Column]) -> tuple[Column, Column]:
    """SC-8: the range over two that touch, NULLs if they don't."""
    touch = F.greatest(a[0], b[0]) <= F.least(a[1], b[1])
    return F.when(touch, F.least(a[0], b[0])), F.when(touch, F.greatest(a[1], b[1]))


def distance(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """SC-8: from a up to b positive, down negative, 0 where they meet."""
    return F.when(b[0] > a[1], b[0] - a[1]).when(b[1] < a[0], b[1] - a[0]).otherwise(0.0)


def report_period(day: Column) -> Column:
    """SC-6."""
    return F.element_at(F.array(*map(F.lit, ("season1", "half_year", "season3", "year"))), F.quarter(day))


def recent_report_date(day: Column, step: int = 0) -> Column:
    """SC-6: the end of the last full quarter, ``step`` quarters further back."""
    return F.date_sub(F.add_months(F.trunc(day, "quarter"), -3 * step), 1)


def bucket(x: Column, edges: list[float]) -> Column:
    """A-8: number of the half-open bucket [edge, next edge), NULL outside."""
    out = F.lit(None).cast("int")
    for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        out = F.when((x >= a) & (x < b), i).otherwise(out)
    return out


def occurrences(text: Column, word: Column) -> Column:
    """A-26: non-overlapping occurrences."""
    return ((F.length(text) - F.length(F.replace(text, word, F.lit("")))) / F.length(word)).cast("long")
