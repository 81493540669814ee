"""Helpers for computed columns: what people do to cells, as Column expressions with lenient readings."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import date_key, filled, fold, half_up, number, phone_key, slug, text, trimmed  # noqa: F401

_NUMBER = r"[+-]?[0-9]+(?:[.,][0-9]+)?"


def num(c) -> Column:
    """The number at the start of a cell; empty is 0, no number is null."""
    s = F.regexp_replace(trimmed(c), "[   ]", "")
    found = F.regexp_extract(s, rf"^[€$£]?({_NUMBER})", 1)
    return F.when(s == "", F.lit(0.0)).otherwise(F.when(found != "", F.replace(found, F.lit(","), F.lit("."))).try_cast("double"))


def first_number(c) -> Column:
    return F.regexp_extract(text(c), _NUMBER, 0)


def digits(c) -> Column:
    return F.regexp_replace(text(c), "[^0-9]", "")


def collapse(c) -> Column:
    """Trimmed, and runs of white space as one space."""
    return F.trim(F.regexp_replace(text(c), "[\\s  ﻿]+", " "))


def capitalize(c) -> Column:
    """First letters upper, the rest lower: after the start, a space, hyphen, apostrophe or bracket."""
    parts = F.regexp_extract_all(F.lower(text(c)), F.lit(r"[^ \-'’(]+|[ \-'’(]"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(p.substr(F.lit(1), F.lit(1))), p.substr(F.lit(2), F.length(p)))), "")


def left(c, n: int) -> Column:
    s = text(c)
    return s.substr(F.lit(1), F.lit(n) if n >= 0 else F.greatest(F.length(s) + n, F.lit(0)))


def right(c, n: int) -> Column:
    s = text(c)
    return F.when(F.length(s) <= n, s).otherwise(F.right(s, F.lit(n)))


def mid(c, start: int, n: int) -> Column:
    return text(c).substr(F.lit(start), F.lit(n))


def part(c, separator: str, n: int) -> Column:
    """The nth part; -1 is the last one. No such part is empty."""
    return F.split_part(text(c), F.lit(separator), F.lit(n))


def pad(c, n: int, fill: str = "0") -> Column:
    s = text(c)
    return F.when(F.length(s) < n, F.lpad(s, n, fill)).otherwise(s)


def similarity(a, b) -> Column:
    """1 less the edit distance by the longer length; an empty text resembles only an empty one."""
    a, b = text(a), text(b)
    return F.when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))


def contains(c, what: str) -> Column:
    return fold(c).contains(fold(F.lit(what)))


def starts_with(c, what: str) -> Column:
    return fold(c).startswith(fold(F.lit(what)))


def ends_with(c, what: str) -> Column:
    return fold(c).endswith(fold(F.lit(what)))


def matches(c, pattern: str) -> Column:
    return text(c).rlike("(?i)" + pattern)


def extract(c, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(text(c), pattern, group)


def is_email(c) -> Column:
    return trimmed(c).rlike(r"^[^\s@]+@[^\s@.]+(?:\.[^\s@.]+)+$")


def first_filled(*cells) -> Column:
    return F.coalesce(*[F.when(filled(c), text(c)) for c in cells], F.lit(""))


def join_filled(separator: str, *cells) -> Column:
    return F.concat_ws(separator, *[F.when(filled(c), text(c)) for c in cells])


def ifs(*args) -> Column:
    """Test, value, test, value, ..., else."""
    out = F.when(args[0], args[1])
    for k in range(2, len(args) - 1, 2):
        out = out.when(args[k], args[k + 1])
    return out.otherwise(args[-1] if len(args) % 2 else F.lit(None))


def months(a: Column, b: Column) -> Column:
    """Whole months from a to b, the same with the sign turned when they change places."""

    def ahead(x: Column, y: Column) -> Column:
        return (F.year(y) - F.year(x)) * 12 + F.month(y) - F.month(x) - (F.dayofmonth(y) < F.dayofmonth(x)).cast("int")

    return F.when(b >= a, ahead(a, b)).otherwise(-ahead(b, a))


def years(a: Column, b: Column) -> Column:
    return F.when(b >= a, F.floor(months(a, b) / 12)).otherwise(-F.floor(-months(a, b) / 12))


def days(a: Column, b: Column) -> Column:
    return F.datediff(b, a)


def weekday(d: Column) -> Column:
    """1 Monday to 7 Sunday."""
    return F.weekday(d) + 1


def week(d: Column) -> Column:
    return F.weekofyear(d)


def add_months(d: Column, n: int) -> Column:
    return F.add_months(d, n)


def is_number(c) -> Column:
    """Whether the whole cell is a number as people write it."""
    return number(c).isNotNull()


def is_date(c) -> Column:
    return date_key(c).isNotNull()


def is_phone(c, country: str = "33") -> Column:
    return phone_key(c, country) != ""


def is_empty(c) -> Column:
    return ~filled(c)


def to_date(c) -> Column:
    """The day of a cell's date; null where it is none of the calendar."""
    digits_ = F.lpad(F.floor(date_key(c) / 1000000).cast("string"), 8, "0")
    return F.concat_ws("-", digits_.substr(1, 4), digits_.substr(5, 2), digits_.substr(7, 2)).try_cast("date")


#: Parts of a date's format and what Spark calls them.
_DATE_PARTS = {"YYYY": "yyyy", "YY": "yy", "MM": "MM", "M": "M", "DD": "dd", "D": "d"}


def fmt_date(c, form: str = "DD/MM/YYYY") -> Column:
    """A cell's date in a format of YYYY, YY, MM, M, DD and D; other text of the format stays. Empty where there is no date."""
    spark_form = re.sub("YYYY|YY|MM|M|DD|D|[A-Za-z']+", lambda m: _DATE_PARTS.get(m[0]) or "'" + m[0].replace("'", "''") + "'", form)
    return F.coalesce(F.date_format(to_date(c), spark_form), F.lit(""))


def fixed(c, decimals: int = 2) -> Column:
    """A number with so many decimals, halves away from zero; empty where there is none."""
    exact = number(c).cast(f"decimal(38,{max(decimals, 0) + 8})")
    return F.coalesce(F.round(exact, decimals).cast(f"decimal(38,{decimals})").cast("string"), F.lit(""))


def cases(c, *args) -> Column:
    """Value, result, value, result, ..., else: the result of the first value that the cell is, without case; numbers by value."""
    same = lambda v: number(c) == float(v) if isinstance(v, (int, float)) else F.lower(trimmed(c)) == str(v).strip().lower()
    tests = [x if k % 2 else same(x) for k, x in enumerate(args[: len(args) - len(args) % 2])]
    return ifs(*tests, *args[len(tests) :])


def _numbers(cells) -> Column:
    return F.filter(F.array(*[number(c) for c in cells]), lambda x: x.isNotNull())


def sum_of(*cells) -> Column:
    """The sum of the cells that are numbers, 0 without any."""
    return F.aggregate(_numbers(cells), F.lit(0.0), lambda a, x: a + x)


def avg_of(*cells) -> Column:
    return F.when(F.size(_numbers(cells)) > 0, sum_of(*cells) / F.size(_numbers(cells)))


def min_of(*cells) -> Column:
    return F.array_min(_numbers(cells))


def max_of(*cells) -> Column:
    return F.array_max(_numbers(cells))


def repeat(c, n: int) -> Column:
    return F.repeat(text(c), n)


def reverse(c) -> Column:
    return F.reverse(text(c))


def word_count(c) -> Column:
    """Runs of other signs than white space."""
    s = F.trim(F.regexp_replace(text(c), r"\s+", " "))
    return F.when(s == "", 0).otherwise(F.size(F.split(s, " ")))
