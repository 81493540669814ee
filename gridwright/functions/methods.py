"""Methods of texts, numbers, dates and lists for computed columns, as JavaScript has them: places count from 0, from the end where negative.

Places and lengths are code points. Cells are read leniently; a place outside is null where JavaScript has undefined.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fold, half_up, number, text

#: Signs that count as white space in JavaScript. Fixed values.
SPACE = "[\\t\\n\\x0b\\f\\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"


def _from(length: Column, k: int | None, default: Column) -> Column:
    """A place as slices take it: from the end where negative, within the text."""
    if k is None:
        return default
    return F.least(F.lit(k), length) if k >= 0 else F.greatest(length + k, F.lit(0))


# texts


def slice_text(c, start: int, end: int | None = None) -> Column:
    s = text(c)
    a, b = _from(F.length(s), start, F.lit(0)), _from(F.length(s), end, F.length(s))
    return s.substr(a + 1, F.greatest(b - a, F.lit(0)))


def substring(c, start: int, end: int | None = None) -> Column:
    """Between two places in either order; negative ones are 0."""
    n = F.length(text(c))
    a, b = _from(n, max(start, 0), n), _from(n, None if end is None else max(end, 0), n)
    return text(c).substr(F.least(a, b) + 1, F.abs(b - a))


def at(c, k: int) -> Column:
    s = text(c)
    place = F.lit(k) if k >= 0 else F.length(s) + k
    return F.when((place >= 0) & (place < F.length(s)), s.substr(place + 1, F.lit(1)))


def char_at(c, k: int) -> Column:
    """The sign at a place, empty outside."""
    return F.coalesce(at(c, k), F.lit("")) if k >= 0 else F.lit("")


def code_point_at(c, k: int = 0) -> Column:
    return F.ascii(at(c, k)) if k >= 0 else F.lit(None).cast("int")


def starts_with(c, what: str, start: int = 0) -> Column:
    return substring(c, start).startswith(what)


def ends_with(c, what: str, end: int | None = None) -> Column:
    return substring(c, 0, end).endswith(what)


def includes(c, what: str, start: int = 0) -> Column:
    return substring(c, start).contains(what)


def index_of(c, what: str, start: int = 0) -> Column:
    """The first place of a text from a place on, -1 without one."""
    s, start = text(c), max(start, 0)
    return F.locate(what, s, start + 1) - 1 if what else F.least(F.lit(start), F.length(s))


def last_index_of(c, what: str, start: int | None = None) -> Column:
    s = text(c) if start is None else substring(c, 0, max(start, 0) + len(what))
    back = F.locate(what[::-1], F.reverse(s))
    return F.when(back > 0, F.length(s) - back - len(what) + 1).otherwise(-1) if what else F.length(s)


def compare(a, b) -> Column:
    """-1, 0 or 1 by folded texts, then by the texts themselves."""
    sign = lambda x, y: F.when(x < y, -1).when(x > y, 1)
    return F.coalesce(sign(fold(a), fold(b)), sign(text(a), text(b)), F.lit(0))


def _groups(pattern: str) -> int:
    found = re.findall(r"\\.|\[(?:\\.|[^\]\\])*\]|(\((?!\?)|\(\?<(?![=!]))", pattern, re.S)
    return sum(map(bool, found))


def _headed(pattern: str) -> str:
    """The pattern's first match and, as group 1, the text before it; the pattern's own groups count from 2."""
    own = re.sub(r"(\\\\)|\\([1-9][0-9]*)", lambda m: m[1] or f"\\{int(m[2]) + 1}", pattern)
    return rf"\A((?s:.*?))(?:{own})"


def _template(by: str, groups: int, shift: int = 0) -> str:
    """``$1``, ``$&``, ``$<name>`` and ``$$`` of a replacement as Java's; a number that no group has stays as written."""

    def java(m: re.Match) -> str:
        mark = m[0][1:]
        if mark.isdigit():
            n = mark if int(mark) <= groups else mark[0]
            return f"${int(n) + shift}" + re.escape(mark[len(n) :]) if 0 < int(n) <= groups else rf"\${mark}"
        return {"$": r"\$", "&": "$0", "\\": r"\\", "": r"\$"}.get(m[0] if m[0] == "\\" else mark) or "${" + mark[1:-1] + "}"

    return re.sub(r"\$(?:[0-9]{1,2}|\$|&|<[A-Za-z][A-Za-z0-9]*>|)|\\", java, by)


def replace_pattern(c, pattern: str, by: str) -> Column:
    """All matches replaced; ``by`` may hold ``$1``, ``$&`` (the match), ``$<name>`` and ``$$``."""
    return F.regexp_replace(text(c), pattern, _template(by, _groups(pattern)))


def replace_first(c, pattern: str, by: str) -> Column:
    """The first match replaced; ``by`` as in :func:`replace_pattern`, but for ``$&``, for which the pattern is to be in brackets."""
    if re.search(r"(?<!\$)(?:\$\$)*\$&", by):
        raise ValueError("$& is not read here: put the pattern in brackets and take $1")
    return F.regexp_replace(text(c), _headed(pattern), "$1" + _template(by, _groups(pattern), 1))


def search(c, pattern: str) -> Column:
    """The place of a pattern's first match, -1 without one."""
    return F.when(text(c).rlike(pattern), F.length(F.regexp_extract(text(c), _headed(pattern), 1))).otherwise(-1)


def match(c, pattern: str) -> Column:
    """The first match and its groups as a list, null without one."""
    groups = [F.regexp_extract(text(c), pattern, k) for k in range(_groups(pattern) + 1)]
    return F.when(text(c).rlike(pattern), F.array(*groups))


def match_all(c, pattern: str) -> Column:
    return F.regexp_extract_all(text(c), F.lit(pattern), F.lit(0))


def split_list(c, separator: str | None = None, limit: int | None = None) -> Column:
    s = text(c)
    signs = F.filter(F.split(s, ""), lambda x: x != "")
    parts = F.array(s) if separator is None else F.split(s, r"\Q" + separator.replace(r"\E", r"\E\\E\Q") + r"\E", -1) if separator else signs
    return parts if limit is None else F.slice(parts, 1, limit)


def pad_start(c, n: int, fill: str = " ") -> Column:
    return F.when(F.length(text(c)) < n, F.lpad(text(c), n, fill)).otherwise(text(c)) if fill else text(c)


def pad_end(c, n: int, fill: str = " ") -> Column:
    return F.when(F.length(text(c)) < n, F.rpad(text(c), n, fill)).otherwise(text(c)) if fill else text(c)


def trim_start(c) -> Column:
    return F.regexp_replace(text(c), rf"\A{SPACE}+", "")


def trim_end(c) -> Column:
    return F.regexp_replace(text(c), rf"(?<!{SPACE}){SPACE}+\z", "")


def trim(c) -> Column:
    return trim_end(trim_start(c))


def _by_batch(one):
    """A function of one value over Arrow batches; null stays null."""

    def of_batch(s: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) else one(x) for x in s], dtype=object)

    return F.pandas_udf(of_batch, "string")


def normalize(c, form: str = "NFC") -> Column:
    """A normal form of Unicode, which Spark has no function for."""
    import unicodedata

    if form not in ("NFC", "NFD", "NFKC", "NFKD"):
        raise ValueError(f"unknown normal form: {form}")
    return _by_batch(lambda x: unicodedata.normalize(form, x))(text(c))


def digest(c, name: str) -> Column:
    """sha3_256, sha3_512 or blake2b in hex, which Spark has no functions for; empty of an empty cell."""
    import hashlib

    if name not in ("sha3_256", "sha3_512", "blake2b"):
        raise ValueError(f"unknown digest: {name}")
    return _by_batch(lambda x: getattr(hashlib, name)(x.encode()).hexdigest() if x else "")(text(c))


def uuid7(row: Column) -> Column:
    """A UUID of version 7 that grows with the row's number (44 bits of it): the query's time, the number, 30 random bits."""
    row, low = row.cast("long"), row.cast("long").bitwiseAND(0xFFFFFFFF)
    hexed = lambda x, n: F.lpad(F.lower(F.hex(x)), n, "0")
    time = hexed(F.unix_millis(F.current_timestamp()), 12)
    high = hexed(F.shiftrightunsigned(row, 32).bitwiseAND(0xFFF), 3)
    end = F.shiftleft(low.bitwiseAND(0x3FFFF), 30) + F.floor(F.rand() * 2**30).cast("long")
    return F.concat_ws("-", time.substr(1, 8), time.substr(9, 4), F.concat(F.lit("7"), high), hexed(F.shiftrightunsigned(low, 18) + 0x8000, 4), hexed(end, 12))


# numbers


def _exact(x: float, decimals: int) -> str:
    """A number with so many decimals by its exact binary value, halves away from zero."""
    from decimal import ROUND_HALF_UP, Context, Decimal

    return f"{Decimal(x).quantize(Decimal(1).scaleb(-decimals), ROUND_HALF_UP, Context(prec=1200)):f}"


def _digits(x: float, precision: int) -> str:
    """A number with so many digits, with an exponent below -6 or from the precision on."""
    from decimal import ROUND_HALF_UP, Context, Decimal

    d = Context(prec=precision, rounding=ROUND_HALF_UP).create_decimal(Decimal(x))
    e = d.adjusted() if d else 0
    if -7 < e < precision:
        return f"{d.quantize(Decimal(1).scaleb(e - precision + 1)):f}"
    digits = "".join(map(str, d.as_tuple().digits)).ljust(precision, "0")
    return ("-" if d < 0 else "") + digits[0] + ("." + digits[1:] if precision > 1 else "") + f"e{'+' if e > 0 else '-'}{abs(e)}"


def to_fixed(c, decimals: int = 0) -> Column:
    if not 0 <= decimals <= 100:
        raise ValueError("decimals from 0 to 100")
    return _by_batch(lambda x: _exact(x, decimals))(F.when(F.abs(number(c)) < 1e21, number(c)))


def to_precision(c, precision: int) -> Column:
    if not 1 <= precision <= 100:
        raise ValueError("digits from 1 to 100")
    return _by_batch(lambda x: _digits(x, precision))(number(c))


def to_radix(c, radix: int) -> Column:
    """A whole number in a base of 2 to 36, small letters; null for other numbers and beyond 63 bits."""
    x = number(c)
    whole = F.when((x == F.floor(x)) & (F.abs(x) < 2.0**63), F.abs(x).cast("long").cast("string"))
    return F.concat(F.when(x < 0, "-").otherwise(""), F.lower(F.conv(whole, 10, radix)))


#: Functions of numbers by name; where they have no real value the result is null.
MATH = {
    "abs": F.abs, "ceil": lambda x: F.ceil(x).cast("double"), "floor": lambda x: F.floor(x).cast("double"), "round": lambda x: half_up(x),
    "trunc": lambda x: F.signum(x) * F.floor(F.abs(x)), "sign": F.signum, "sqrt": lambda x: F.when(x >= 0, F.sqrt(x)), "cbrt": F.cbrt,
    "pow": F.pow, "log": F.log, "log10": F.log10, "log2": F.log2, "exp": F.exp,
    "min": lambda *x: F.when(F.forall(F.array(*x), lambda v: v.isNotNull()), F.array_min(F.array(*x))),
    "max": lambda *x: F.when(F.forall(F.array(*x), lambda v: v.isNotNull()), F.array_max(F.array(*x))),
    "random": lambda: F.rand(),
}


def math(name: str, *cells) -> Column:
    """A function of MATH on cells read as numbers; null where one isn't a number."""
    if name not in MATH:
        raise ValueError(f"unknown function: {name}")
    return MATH[name](*map(number, cells))


# dates and lists

#: Parts of a date by name: months from 0, days of the week from 0 (Sunday).
_PARTS = {"FullYear": F.year, "Month": lambda d: F.month(d) - 1, "Date": F.dayofmonth, "Day": lambda d: F.dayofweek(d) - 1, "Hours": F.hour, "Minutes": F.minute, "Seconds": F.second}


def get(d: Column, part: str, utc: bool = False) -> Column:
    if part not in _PARTS:
        raise ValueError(f"unknown part: {part}")
    return _PARTS[part](F.to_utc_timestamp(d, F.current_timezone()) if utc else d)


def get_time(d: Column) -> Column:
    return F.unix_millis(d.cast("timestamp"))


def to_iso(d: Column) -> Column:
    return F.date_format(F.to_utc_timestamp(d, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def list_at(items: Column, k: int) -> Column:
    return F.get(items, F.lit(k)) if k >= 0 else F.get(items, F.size(items) + k)


def list_slice(items: Column, start: int, end: int | None = None) -> Column:
    a, b = _from(F.size(items), start, F.lit(0)), _from(F.size(items), end, F.size(items))
    return F.slice(items, a + 1, F.greatest(b - a, F.lit(0)))


def list_index_of(items: Column, x, start: int = 0) -> Column:
    found = F.array_position(list_slice(items, start), x)
    return F.when(found > 0, found - 1 + _from(F.size(items), start, F.lit(0))).otherwise(-1)


def list_last_index_of(items: Column, x) -> Column:
    found = F.array_position(F.reverse(items), x)
    return F.when(found > 0, F.size(items) - found).otherwise(-1)
