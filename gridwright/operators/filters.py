"""Filters: search terms, per-column operators, value sets and ranges, as boolean columns."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import filled, fold, folded_pattern, quantity, text, trimmed


def terms(search: str) -> list[str]:
    """Words and "quoted phrases" of a search; an open quote runs to the end; only quotes and spaces are the text itself."""
    found = [a or b for a, b in re.findall(r'"([^"]+)"?|([^\s"]+)', search)]
    return found or ([search] if search else [])


def _has(c, term: str, match_case: bool) -> Column:
    if match_case:
        return text(c).contains(term)
    pattern = folded_pattern(term)
    return text(c).rlike(pattern) if pattern else fold(c).contains(fold(F.lit(term)))


def search(columns: Sequence[str], what: str, match_case: bool = False) -> Column:
    """Every term is in some cell of the row."""
    out = F.lit(True)
    for term in terms(what):
        out &= F.exists(F.array(*[_has(c, term, match_case) for c in columns]), lambda x: x)
    return out


def _limit(written: str) -> float | int:
    """A condition's number as people write it, else its date as date_key gives it."""
    bare = re.sub(r"[€$£%¥ \u00a0\u202f'_]", "", re.sub(r"^\((.*)\)$", r"-\1", written.strip()))
    if day := re.fullmatch(r"(\d{4})([-/.])(\d{1,2})\2(\d{1,2})|(\d{1,2})([-/.])(\d{1,2})\6(\d{4})", bare):
        y, m, d = (int(x) for x in ((day[1], day[3], day[4]) if day[1] else (day[8], day[7], day[5])))
        return ((y * 100 + m) * 100 + d) * 1_000_000
    for drop, mark in ((",", "."), (".", ",")):
        clean = bare.replace(drop, "").replace(mark, ".") if "," in bare and "." in bare and bare.rfind(mark) > bare.rfind(drop) else None
        if clean:
            return float(clean)
    return float(bare.replace(",", "." if bare.count(",") == 1 else "").replace(".", "." if bare.count(".") <= 1 else ""))


def _compared(c: str, sign: str, limit: float | int | Column, kind: str | None) -> Column:
    """``c`` beside a limit; of a column whose type is known by a plain comparison, which the scan can use to leave data out."""
    number_type = kind is not None and re.match("tinyint|smallint|int|bigint|float|double|decimal", kind) is not None
    if isinstance(limit, Column):
        return F.coalesce({">": quantity(c) > limit, ">=": quantity(c) >= limit, "<": quantity(c) < limit, "<=": quantity(c) <= limit}[sign], F.lit(False))
    if number_type:
        whole = kind not in ("float", "double") and float(limit).is_integer()
        column, test = F.col(c), F.lit(int(limit) if whole else float(limit))
        known = ~F.isnan(c) if kind in ("float", "double") else F.lit(True)
    elif kind == "date" and isinstance(limit, int):
        y, rest = divmod(limit // 1_000_000, 10_000)
        column, test, known = F.col(c), F.lit(f"{y:04}-{rest // 100:02}-{rest % 100:02}").try_cast("date"), F.lit(True)
    else:
        column, test, known = quantity(c), F.lit(float(limit)), F.lit(True)
    compared = {">": column > test, ">=": column >= test, "<": column < test, "<=": column <= test}[sign]
    return compared & known if number_type or kind == "date" else F.coalesce(compared, F.lit(False))


def column_test(c: str, condition: str, match_case: bool = False, kind: str | None = None) -> Column:
    """``word``, ``=x``, ``!=x``, ``!x``, ``>n``, ``>=n``, ``<n``, ``<=n``; ``=`` alone is empty, ``!`` alone filled.

    ``kind`` is the column's type where it is known (as in ``df.dtypes``): numbers and dates then are compared as they are.
    """
    read = trimmed if match_case else lambda x: fold(trimmed(x))
    operator = re.match(r"!=|>=|<=|[=!<>]", condition)
    sign, rest = (operator[0], condition[operator.end() :].strip()) if operator else ("", condition)
    if sign in ("=", "!="):
        same = ~filled(c) if not rest else read(c) == read(F.lit(rest))
        return same if sign == "=" else ~same
    if sign == "!":
        return ~_has(c, rest, match_case) if rest else filled(c)
    if sign:
        if not re.search(r"\d", rest):
            raise ValueError(f"not a number: {rest}")
        try:
            limit = _limit(rest)
        except ValueError:  # a date with a clock, or what only a whole reading makes out
            limit = quantity(F.lit(rest))
        return _compared(c, sign, limit, kind)
    out = F.lit(True)
    for term in terms(rest):
        out &= _has(c, term, match_case)
    return out


def keep_where(df: DataFrame, conditions: dict[str, str], match_case: bool = False) -> DataFrame:
    """Rows that pass the condition of every column named, each compiled for the column's type."""
    kinds = dict(df.dtypes)
    return select_rows(df, [column_test(c, x, match_case, kinds[c]) for c, x in conditions.items()])


def regex_test(c: str, pattern: str, match_case: bool = False) -> Column:
    return text(c).rlike(("" if match_case else "(?i)") + pattern)


def select_rows(df: DataFrame, tests: Sequence[Column] = (), values: Sequence[Column] = (), invert: bool = False) -> DataFrame:
    """Rows that pass; ``invert`` turns the text tests, never the value tests."""
    text_test, value_test = F.lit(True), F.lit(True)
    for t in tests:
        text_test &= t
    for v in values:
        value_test &= v
    return df.where(value_test & (~text_test if invert else text_test))


def keep_values(c: str, values: Sequence[str]) -> Column:
    return text(c).isin(*values)


def hide_values(c: str, values: Sequence[str]) -> Column:
    return ~text(c).isin(*values)


def keep_range(c: str, low: float, high: float, kind: str | None = None) -> Column:
    """Numbers from ``low`` to ``high``; with the column's type (``kind``) a plain comparison that reaches the scan."""
    return _compared(c, ">=", low, kind) & _compared(c, "<=", high, kind)


def count_matches(df: DataFrame, columns: Sequence[str], what: str) -> DataFrame:
    """Cells that contain ``what``, for each column (column_name, matches)."""
    counts = df.agg(*[F.count_if(_has(c, what, False)).alias(c) for c in columns])
    return counts.unpivot([], list(columns), "column_name", "matches")


def closest(df: DataFrame, c: str, rid: str, value: float) -> DataFrame:
    """The first row whose number is closest to ``value``."""
    return df.agg(F.min_by(rid, F.when(quantity(c).isNotNull(), F.struct(F.abs(quantity(c) - value), F.col(rid)))).alias(rid))


def keep_rows(df: DataFrame, rid: str, rows: DataFrame) -> DataFrame:
    """The rows whose ids are in ``rows``."""
    return df.join(rows.select(rid).distinct(), rid, "left_semi").select(df.columns)


def without_rows(df: DataFrame, rid: str, rows: DataFrame) -> DataFrame:
    return df.join(rows.select(rid).distinct(), rid, "left_anti").select(df.columns)


def irregular(lines: DataFrame, c: str, delimiter: str, width: int) -> DataFrame:
    """Raw lines with another number of fields than ``width`` (fields); delimiters inside quotes don't count.

    A quote opens a cell only where the cell begins, a doubled one is a sign of the cell, and an open one runs to the end.
    """
    single = F.replace(text(c), F.lit('""'), F.lit(""))
    bare = F.regexp_replace(single, "(^|" + re.escape(delimiter) + ')"[^"]*("|\\z)', "$1")
    fields = F.floor((F.length(bare) - F.length(F.replace(bare, F.lit(delimiter), F.lit("")))) / len(delimiter)) + 1
    return lines.withColumn("fields", fields).where(F.col("fields") != width)
