"""Dates as text, calendar quarters and fill tests, as JVM-side expressions.

A quarter is an INT index ``4 * year + quarter - 1`` for arithmetic; text forms
(``2015Q3``) and INT forms (20153) are made at the edges only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Placeholders that stand for a missing value (compared in upper case).
PLACEHOLDERS = ("", "N/A", "-", "0", "UNKNOWN", "0000-00-00")
MONTHS = "JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parse_date(x: Column | str) -> Column:
    """DATE of a text in any of the usual writings, NULL where no such day exists.

    Read are year-month-day with ``-``, ``/``, ``.`` or nothing between (a time of
    day may follow), day month-name year, month-name day year, and numeric
    month/day/year; padding is ignored. Never throws under ANSI mode.
    """
    s = F.trim(F.translate(_c(x), "\u00a0\t\r\n", "    "))

    def month(group: int, pattern: str) -> Column:
        name = F.upper(F.substring(F.regexp_extract(s, pattern, group), 1, 3))
        at = F.call_function("instr", F.lit(MONTHS), name)
        return F.when(at % 3 == 1, F.lpad(((at + 2) / 3).cast("int").cast("string"), 2, "0"))

    def part(group: int, pattern: str) -> Column:
        return F.regexp_extract(s, pattern, group)

    ymd = r"^(\d{4})[/.](\d{1,2})[/.](\d{1,2})(?:[T ].*)?$"
    packed = r"^(\d{4})(\d{2})(\d{2})(?:[T ].*)?$"
    dmy = r"^(\d{1,2})[-/. ]+([A-Za-z]{3,9})[-/., ]+(\d{4})$"
    mdy = r"^([A-Za-z]{3,9})[-/. ]+(\d{1,2})[,./ -]+(\d{4})$"
    us = r"^(\d{1,2})/(\d{1,2})/(\d{4})$"
    # the usual writing needs no pattern: a cast reads year-month-day and what may follow it
    return (
        F.when(s.rlike(r"^\d{4}-"), F.when(F.length(s) >= 8, s.try_cast("date")))
        .when(s.rlike(packed), F.regexp_replace(s, packed, "$1-$2-$3").try_cast("date"))
        .when(s.rlike(ymd), F.regexp_replace(s, ymd, "$1-$2-$3").try_cast("date"))
        .when(s.rlike(dmy), F.concat(part(3, dmy), F.lit("-"), month(2, dmy), F.lit("-"), part(1, dmy)).try_cast("date"))
        .when(s.rlike(mdy), F.concat(part(3, mdy), F.lit("-"), month(1, mdy), F.lit("-"), part(2, mdy)).try_cast("date"))
        .when(s.rlike(us), F.regexp_replace(s, us, "$3-$1-$2").try_cast("date"))
    )


def with_days(df: DataFrame, days: dict[str, str], *keep: Column | str) -> DataFrame:
    """``keep`` columns and a DATE column per entry of ``days`` (name -> text column), each text read once.

    The dates come out of a one-element explode: filters on them stay above it, so the
    long reading expression stands once in the plan and not in every later predicate.
    """
    kept = df.select(*keep).columns
    parsed = F.struct(*[parse_date(source).alias(name) for name, source in days.items()])
    return df.select(*keep, F.explode(F.array(parsed)).alias("__days")).select(*kept, *[F.col(f"__days.{n}").alias(n) for n in days])


def parse_yyyymmdd(x: Column | str) -> Column:
    """DATE of an INT yyyymmdd; 0, negative, impossible or out of 1700-2100: NULL."""
    d = F.call_function("try_to_date", _c(x).cast("string"), F.lit("yyyyMMdd"))
    return F.when(F.year(d).between(1700, 2100), d)


def yyyymmdd(d: Column | str) -> Column:
    d = _c(d)
    return (F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)).cast("int")


def yyyymm(d: Column | str) -> Column:
    d = _c(d)
    return (F.year(d) * 100 + F.month(d)).cast("int")


def q_index(d: Column | str) -> Column:
    d = _c(d)
    return (F.year(d) * 4 + F.quarter(d) - 1).cast("int")


def q_label(q: Column | str) -> Column:
    q = _c(q)
    return F.concat(F.floor(q / 4).cast("string"), F.lit("Q"), (q % 4 + 1).cast("string"))


def q_yyyyq(q: Column | str) -> Column:
    q = _c(q)
    return (F.floor(q / 4) * 10 + q % 4 + 1).cast("int")


def q_end(q: Column | str) -> Column:
    """Last day of the quarter of an index."""
    q = _c(q)
    first = F.make_date(F.floor(q / 4).cast("int"), (q % 4 * 3 + 1).cast("int"), F.lit(1))
    return F.last_day(F.add_months(first, 2))


def nearest_quarter(d: Column | str) -> Column:
    """Index of the calendar quarter whose last day is nearest; if two are equally near, the earlier."""
    d = _c(d)
    before = F.date_sub(F.trunc(d, "quarter"), 1)
    after = F.last_day(F.add_months(F.trunc(d, "quarter"), 2))
    return F.when(F.datediff(d, before) <= F.datediff(after, d), q_index(d) - 1).otherwise(q_index(d))


def is_filled(x: Column | str) -> Column:
    """True unless null, blank or a placeholder."""
    x = _c(x)
    return x.isNotNull() & ~F.upper(F.trim(x)).isin(*PLACEHOLDERS)
