"""Edits of cells and columns."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence
from datetime import date, timedelta

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.formula import capitalize, collapse
from ..functions.text import _MARKED, _PLAIN, day_text, filled, repaired, text, trimmed
from ..plans.durable import keep

#: Words without meaning, as ready lists. Fixed values.
NOISE = {
    "legal forms": ("SARL", "S.A.R.L.", "SAS", "S.A.S.", "SASU", "SA", "S.A.", "EURL", "SCI", "SNC", "SCOP", "SELARL", "EIRL", "Ltd", "LLC", "Inc", "GmbH"),
    "titles": ("Monsieur", "Madame", "Mademoiselle", "M.", "Mme", "Mlle", "Mr", "Mrs", "Ms", "Dr"),
    "french small words": ("le", "la", "les", "l'", "de", "du", "des", "d'", "et", "un", "une", "au", "aux"),
}
COMPANY_WORDS = NOISE["legal forms"]


def replace_all(c: str, find: str, by: str, regex: bool = False, match_case: bool = True) -> Column:
    """Every occurrence; in a pattern's replacement ``$1`` is a group."""
    if regex:
        return F.regexp_replace(text(c), ("" if match_case else "(?i)") + find, by)
    if match_case:
        return F.replace(text(c), F.lit(find), F.lit(by))
    return F.regexp_replace(text(c), "(?i)" + _quoted(find), by.replace("\\", "\\\\").replace("$", "\\$"))


def _quoted(x: str) -> str:
    return "".join("\\" + ch if ch in r"\.[]{}()*+-?^$|" else ch for ch in x)


def bulk(c: str, what: str, value: str = "") -> Column:
    """``set``, ``clear``, ``trim``, ``upper``, ``lower`` or ``title``."""
    return {"set": F.lit(value), "clear": F.lit(""), "trim": collapse(c), "upper": F.upper(text(c)), "lower": F.lower(text(c)), "title": capitalize(c)}[what]


def clean(c: str) -> Column:
    """Invisible characters out, hard spaces and breaks as spaces, runs of spaces as one, trimmed."""
    seen = F.regexp_replace(text(c), "[​-‏⁠﻿­\\x00-\\x08\\x0e-\\x1f]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(seen, "[  \\r\\n\\t]+", " "), " {2,}", " "))


def convert_date(c: str, to: str = "iso", month_first: bool = False, pivot: int | None = None) -> Column:
    """A date as ``iso``, ``dmy``, ``mdy``, ``dmy_dot`` or ``dmy_dash``; what isn't a day of the calendar stays.

    Two-digit years up to ``pivot`` (ten years from now) are of this century, later ones of the last. A time stays behind it.
    """
    s = trimmed(c)
    pivot = (date.today().year + 10) % 100 if pivot is None else pivot
    clock = r"([T ][0-9]{1,2}:[0-9]{2}.*)?$"
    iso, other = r"^([0-9]{4})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})" + clock, r"^([0-9]{1,2})[-/.]([0-9]{1,2})[-/.]([0-9]{4}|[0-9]{2})" + clock
    a, b = (2, 1) if month_first else (1, 2)
    g = lambda i, j: F.when(s.rlike(iso), F.regexp_extract(s, iso, i)).otherwise(F.regexp_extract(s, other, j))
    short = g(1, 3)
    y = F.when(F.length(short) == 4, short).when(short.try_cast("int") <= pivot, F.concat(F.lit("20"), short)).otherwise(F.concat(F.lit("19"), short))
    m, d, rest = F.lpad(g(2, b), 2, "0"), F.lpad(g(3, a), 2, "0"), g(4, 4)
    out = {"iso": F.concat_ws("-", y, m, d), "dmy": F.concat_ws("/", d, m, y), "mdy": F.concat_ws("/", m, d, y), "dmy_dot": F.concat_ws(".", d, m, y), "dmy_dash": F.concat_ws("-", d, m, y)}[to]
    ok = (s.rlike(iso) | s.rlike(other)) & F.concat_ws("-", y, m, d).try_cast("date").isNotNull()
    return F.when(ok, F.concat(out, rest)).otherwise(text(c))


#: Group mark and decimal mark of each way to write numbers.
NUMBER_FORMS = {"point": ("", "."), "comma": ("", ","), "fr": (" ", ","), "en": (",", ".")}


def convert_number(c: str, to: str = "point", decimal_mark: str = ",", decimals: int | None = None) -> Column:
    """A number as ``point``, ``comma``, ``fr`` (1 234,5) or ``en`` (1,234.5), digit by digit; what isn't one stays, codes like 0612 too.

    A currency or % around it is kept. With ``decimals`` it is rounded, halves up; numbers of over 28 digits then stay.
    """
    s, other = trimmed(c), "." if decimal_mark == "," else ","
    shape = (
        r"^((?:[€$£][\s  ]?)?)([+-]?)[\s  ]*(0|[1-9][0-9]*|[1-9][0-9]{0,2}(?:[\s  '" + other + r"][0-9]{3})+)"
        rf"(?:[{decimal_mark}]([0-9]+))?((?:[\s  ]?(?:[€$£%]|EUR|USD))?)$"
    )
    group, mark = NUMBER_FORMS[to]
    part = lambda k: F.regexp_extract(s, shape, k)
    whole, after = F.regexp_replace(part(3), "[^0-9]", ""), part(4)
    ok = s.rlike(shape)
    if decimals is not None:
        ok &= F.length(whole) + F.length(after) <= 28
        exact = F.concat_ws(".", F.when(ok, whole), F.when(after != "", after)).try_cast("decimal(38,10)")
        plain = F.round(exact, decimals).cast(f"decimal(38,{decimals})").cast("string")
        whole, after = F.substring_index(plain, ".", 1), F.when(F.instr(plain, ".") > 0, F.substring_index(plain, ".", -1)).otherwise("")
    if group:
        whole = F.regexp_replace(whole, "(?<=[0-9])(?=(?:[0-9]{3})+$)", group)
    sign = F.when(part(2) == "-", "-").otherwise("")
    return F.when(ok, F.concat(part(1), sign, whole, F.when(after != "", F.concat(F.lit(mark), after)).otherwise(""), part(5))).otherwise(text(c))


def convert_phone(c: str, to: str = "e164", country: str = "33") -> Column:
    """A phone number as ``e164`` or ``national``; what isn't one stays."""
    bare = F.regexp_replace(F.replace(trimmed(c), F.lit("(0)"), F.lit("")), r"[ .()/\-]", "")
    plus = F.regexp_replace(F.regexp_replace(bare, "^00", "+"), "^0(?=[0-9]{6,14}$)", f"+{country}")
    national = F.regexp_replace(plus, rf"^\+{country}", "0")
    return F.when(plus.rlike(r"^\+[0-9]{8,15}$"), plus if to == "e164" else national).otherwise(text(c))


def split_column(df: DataFrame, c: str, separator: str, parts: int) -> DataFrame:
    """``c_1`` to ``c_n``: trimmed parts, the rest in the last one, missing ones empty."""
    pieces = F.split(text(c), _quoted(separator), parts)
    return df.select("*", *[F.trim(F.coalesce(F.try_element_at(pieces, F.lit(k)), F.lit(""))).alias(f"{c}_{k}") for k in range(1, parts + 1)])


def merge_columns(df: DataFrame, columns: Sequence[str], name: str, separator: str = " ") -> DataFrame:
    return df.withColumn(name, F.concat_ws(separator, *[F.when(filled(c), trimmed(c)) for c in columns]))


def fill_down(df: DataFrame, c: str, order: str, by: Sequence[str] = (), name: str = "filled") -> DataFrame:
    """Empty cells take the nearest filled one above, of the same ``by``; leading ones stay empty.

    Rows are range-partitioned by ``by`` and ``order`` and shuffled once, so that a hot group is cut like any rows; each partition fills itself
    as its rows pass by. What is empty at its head takes the last filled cell of its group in the partitions before: of these there
    is a row for either end of each partition, and only they are joined.
    """
    keys = [F.col(f"`{x}`") for x in by]
    cell, own, part = "__cell", "__own", "__part"
    ordered = df.withColumn(cell, F.when(filled(c), text(c))).repartitionByRange(*keys, F.col(f"`{order}`")).sortWithinPartitions(*keys, F.col(f"`{order}`"))
    schema = ordered.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, last = None, None
        for b in batches:
            cells = b.column(b.schema.get_field_index(cell)).to_pylist()
            groups = list(zip(*(b.column(b.schema.get_field_index(x)).to_pylist() for x in by), strict=True)) if by else [()] * len(cells)
            out = []
            for now, value in zip(groups, cells, strict=True):
                last = value if value is not None or now != group else last
                group = now
                out.append(last)
            at = b.schema.get_field_index(cell)
            yield b.set_column(at, b.schema.field(at), pa.array(out, pa.string()))

    at = F.monotonically_increasing_id()
    filled_rows = keep(ordered.mapInArrow(run, schema).withColumnRenamed(cell, own).withColumns({part: F.spark_partition_id(), "__at": at}))
    ends = filled_rows.select(part, "__at", F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)], F.col(own).alias("own")).alias("row"))
    ends = ends.groupBy(part).agg(F.min_by("row", "__at").alias("first"), F.max_by("row", "__at").alias("last"))
    both = ends.select(part, F.explode(F.array(F.struct(F.lit(0).alias("end"), F.col("first").alias("row")), F.struct(F.lit(1).alias("end"), F.col("last").alias("row")))).alias("e")).select(part, "e.end", "e.row.*")
    k = [f"k{i}" for i in range(len(keys))]
    before = Window.partitionBy(*k).orderBy(part, "end").rowsBetween(Window.unboundedPreceding, -1)
    carried = F.last(F.when(F.col("end") == 1, F.col("own")), ignorenulls=True).over(before)
    heads = F.broadcast(both.withColumn("__carried", carried).where("end = 0 and __carried is not null").select(F.col(part).alias("__head"), *k, "__carried"))  # a row for each partition at most
    same = F.col(part) == F.col("__head")
    for x, key in zip(k, keys, strict=True):
        same &= key.eqNullSafe(F.col(x))
    return filled_rows.join(heads, same, "left").select(*[F.col(f"`{x}`") for x in df.columns], F.coalesce(own, "__carried", F.lit("")).alias(name))


def number_series(row: str, start: float, step: float, decimals: int = 0) -> Column:
    """The series start, start + step, ... by row number (from 1)."""
    return F.round(F.lit(start) + (F.col(row) - 1) * F.lit(step), decimals)


def _blind(word: str) -> str:
    """A pattern of ``word`` with every letter's accented forms."""
    return "".join(f"[{ch}{''.join(a for a, b in zip(_MARKED, _PLAIN, strict=True) if b == ch)}]" if ch in _PLAIN else _quoted(ch) for ch in fold_title(word))


def fold_title(word: str) -> str:
    return "".join(ch for ch in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(ch))


def without_words(c: str, words: Sequence[str] = COMPANY_WORDS) -> Column:
    """Whole words out, whatever their case and accents, and the gaps tidied. A word that ends in an apostrophe is one before a letter."""
    plain, open_ended = [w for w in words if not w.endswith("'")], [w for w in words if w.endswith("'")]
    longest = lambda some: "|".join(map(_blind, sorted(some, key=len, reverse=True)))
    out = text(c)
    if open_ended:
        out = F.regexp_replace(out, r"(?iu)(^|[^\p{L}\p{N}])(?:" + longest(open_ended).replace("\\'", "'").replace("'", "['’]") + r")(?=\p{L})", "$1")
    if plain:
        out = F.regexp_replace(out, r"(?iu)(^|[^\p{L}\p{N}])(?:" + longest(plain) + r")(?=$|[^\p{L}\p{N}])", "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(out, " +([,.])", "$1"), " {2,}", " "))


def pseudonym(c: str, key: str) -> Column:
    """The same keyed code for the same value, empty for an empty one."""
    return F.when(filled(c), F.substring(F.sha2(F.concat(F.lit(key), trimmed(c)), 256), 1, 12)).otherwise(F.lit(""))


def unrecognised(df: DataFrame, c: str, reading: Column) -> DataFrame:
    """Rows whose filled cell a reading can't make out."""
    return df.where(filled(c) & reading.isNull())


def date_series(row: str, start: str, step: int, unit: str = "day") -> Column:
    """Dates from ``start`` by row number (from 1), ``step`` days, months (month ends stay) or years apart."""
    first, n = F.lit(start).cast("date"), ((F.col(row) - 1) * step).cast("int")
    if unit == "day":
        return F.date_add(first, n)
    return F.add_months(first, n if unit == "month" else 12 * n)


#: Steps of a clean-up, in the order in which they are applied.
CLEAN_STEPS = {
    "repair": lambda x: repaired(x),
    "invisible": lambda x: F.regexp_replace(x, "[\u200b-\u200f\u2060\ufeff\u00ad\\x00-\\x08\\x0e-\\x1f]", ""),
    "hard_spaces": lambda x: F.regexp_replace(x, "[\u00a0\u202f]", " "),
    "breaks": lambda x: F.regexp_replace(x, r"[\r\n\t]+", " "),
    "spaces": lambda x: F.regexp_replace(x, " {2,}", " "),
    "trim": lambda x: F.trim(x),
}


def clean_up(df: DataFrame, columns: Sequence[str], steps: Sequence[str] = tuple(CLEAN_STEPS), empty_rows: bool = False, empty_columns: bool = False) -> DataFrame:
    """``columns`` cleaned by ``steps`` in their fixed order; then rows and columns that are empty are left out where asked."""
    unknown = set(steps) - set(CLEAN_STEPS)
    if unknown:
        raise ValueError(f"unknown steps: {sorted(unknown)}")
    cleaned = {}
    for c in columns:
        x = text(c)
        for name, step in CLEAN_STEPS.items():
            x = step(x) if name in steps else x
        cleaned[c] = x
    out = df.withColumns(cleaned)
    out = without_empty_rows(out, columns) if empty_rows else out
    return without_empty_columns(out) if empty_columns else out


def set_cells(df: DataFrame, rid: str, patches: DataFrame) -> DataFrame:
    """``df`` with the cells of ``patches`` (rid, column_name, value) written; of several for a cell the largest value holds."""
    columns = [c for c in df.columns if c != rid]
    wanted = patches.groupBy(rid).agg(*[F.max(F.when(F.col("column_name") == c, F.struct("value"))).alias(f"_p{i}") for i, c in enumerate(columns)])
    joined = df.join(wanted, rid, "left")
    cells = {c: F.when(F.col(f"_p{i}").isNotNull(), F.col(f"_p{i}.value").cast(df.schema[c].dataType)).otherwise(F.col(f"`{c}`")) for i, c in enumerate(columns)}
    return joined.select(*[cells[c].alias(c) if c in cells else F.col(rid) for c in df.columns])


def insert_rows(df: DataFrame, row: str, new: DataFrame, before: int) -> DataFrame:
    """``new`` (numbered from 1 by ``row``) put before the row of that number; later rows move down. Missing columns are empty."""
    n = new.count()
    moved = df.withColumn(row, F.col(row) + F.when(F.col(row) >= before, n).otherwise(0))
    return moved.unionByName(new.withColumn(row, F.col(row) + (before - 1)), allowMissingColumns=True)


def move_rows(df: DataFrame, row: str, first: int, last: int, before: int) -> DataFrame:
    """The rows numbered ``first`` to ``last`` put before the row of number ``before``; the others close up."""
    n, r = last - first + 1, F.col(row)
    if first <= before <= last + 1:
        return df
    if before < first:
        place = F.when(r.between(first, last), r - (first - before)).when(r.between(before, first - 1), r + n)
    else:
        place = F.when(r.between(first, last), r + (before - last - 1)).when(r.between(last + 1, before - 1), r - n)
    return df.withColumn(row, place.otherwise(r))


def without_empty_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows in which some cell of ``columns`` is filled."""
    return df.where(F.exists(F.array(*[filled(c) for c in columns]), lambda x: x))


def without_empty_columns(df: DataFrame) -> DataFrame:
    """Columns with a filled cell, told by one aggregation."""
    if not df.columns:
        return df
    has = df.agg(*[F.max(filled(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    return df.select(*[F.col(f"`{c}`") for c, seen in zip(df.columns, has, strict=True) if seen])


#: Names that series go round, in their order. Fixed values.
NAME_CYCLES = (
    ("lundi", "mardi", "mercredi", "jeudi", "vendredi", "samedi", "dimanche"),
    ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"),
    ("janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre"),
    ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"),
)


def _cycle(at: Column, values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])[F.pmod(at, F.lit(len(values))).cast("int")]


def series(row: str, seeds: Sequence[str]) -> Column:
    """The series that ``seeds`` begin, by row number (from 1, the first seed's row).

    Numbers go on by their mean step (one number by 1) with the seeds' decimals, mark and leading zeros; ISO dates by days, by
    months where their day is one or all end a month; names of days and months in French or English go round; a text's
    trailing number counts on; anything else repeats.
    """
    at, n = F.col(row) - 1, len(seeds)
    if all(re.fullmatch(r"-?\d+(?:[.,]\d+)?", s) for s in seeds):
        values = [float(s.replace(",", ".")) for s in seeds]
        decimals = max(len(re.split("[.,]", s)[1]) if re.search("[.,]", s) else 0 for s in seeds)
        step = (values[-1] - values[0]) / (n - 1) if n > 1 else 1.0
        number = F.round(F.lit(values[0]).cast("decimal(28,10)") + at.cast("decimal(18,0)") * F.lit(round(step, 10)).cast("decimal(28,10)"), decimals).cast(f"decimal(38,{decimals})").cast("string")
        width = max((len(s) for s in seeds if re.fullmatch(r"0\d+", s)), default=0)
        padded = F.when(F.length(number) < width, F.lpad(number, width, "0")).otherwise(number) if width else number
        return F.replace(padded, F.lit("."), F.lit(",")) if any("," in s for s in seeds) else padded
    days = [_iso_day(s) for s in seeds]
    if all(days):
        months = [(b.year - a.year) * 12 + b.month - a.month for a, b in zip(days, days[1:], strict=False)]
        ends = all((x + timedelta(days=1)).day == 1 for x in days)
        if months and len(set(months)) == 1 and months[0] and (ends or len({x.day for x in days}) == 1):
            moved = F.add_months(F.lit(days[0].isoformat()).cast("date"), (at * months[0]).cast("int"))
            return day_text(F.last_day(moved) if ends else moved)
        step = round((days[-1] - days[0]).days / (n - 1)) if n > 1 else 1
        return day_text(F.date_add(F.lit(days[0].isoformat()).cast("date"), (at * step).cast("int")))
    for names in NAME_CYCLES:
        if all(s.lower() in names for s in seeds):
            places = [names.index(s.lower()) for s in seeds]
            step = (places[1] - places[0]) % len(names) if n > 1 else 1
            written = str.upper if seeds[0].isupper() else str.capitalize if seeds[0][0].isupper() else str
            return _cycle(at * step + places[0], [written(x) for x in names])
    parts = [re.fullmatch(r"(.*?)(\d+)", s, re.S) for s in seeds]
    if all(parts) and len({p[1] for p in parts}) == 1:
        first, width = int(parts[0][2]), len(parts[0][2]) if parts[0][2].startswith("0") else 0
        step = (int(parts[-1][2]) - first) // (n - 1) if n > 1 else 1
        count = (at * step + first).cast("string")
        return F.concat(F.lit(parts[0][1]), F.when(F.length(count) < width, F.lpad(count, width, "0")).otherwise(count))
    return _cycle(at, seeds)


def _iso_day(s: str) -> date | None:
    try:
        return date.fromisoformat(s) if re.fullmatch(r"\d{4}-\d{2}-\d{2}", s) else None
    except ValueError:
        return None


def hidden(c: str, mode: str, key: str = "", spread: float = 0.1, days: int = 30) -> Column:
    """A cell without what it tells, the same for the same value and ``key``; empty cells stay empty.

    ``clear`` empties it, ``mask`` stars its letters and digits, ``initial`` keeps first letters, ``digits`` draws each digit
    anew in the value's own format and ``scramble`` each letter too, ``noise`` moves a number by up to ``spread`` of itself, ``shift`` moves an ISO date by up
    to ``days``, ``year`` keeps its year, ``domain`` makes up the name before a mail's @, ``code`` is ``pseudonym``.
    """
    s = trimmed(c)
    drawn = F.sha2(F.concat(F.lit(key), s), 256)
    part = F.conv(F.substring(drawn, 1, 8), 16, 10).cast("double") / 4294967295.0  # 0 to 1
    place = lambda ch, i, n: (F.conv(F.substring(F.sha2(F.concat(F.lit(key), s, i.cast("string")), 256), 1, 6), 16, 10).cast("long") % n).cast("int")
    digit = lambda ch, i: place(ch, i, 10).cast("string")
    letter = lambda ch, i, first: F.char(place(ch, i, 26) + ord(first))
    one_digit = lambda ch, i: F.when(ch.rlike("[0-9]"), digit(ch, i)).otherwise(ch)
    one_sign = lambda ch, i: F.when(ch.rlike("[0-9]"), digit(ch, i)).when(ch.rlike(r"\p{Lu}"), letter(ch, i, "A")).when(ch.rlike(r"\p{L}"), letter(ch, i, "a")).otherwise(ch)
    out = {
        "clear": lambda: F.lit(""),
        "mask": lambda: F.regexp_replace(s, r"[\p{L}\p{N}]", "*"),
        "initial": lambda: F.regexp_replace(s, r"(?<=\p{L})\p{L}+", "."),
        "digits": lambda: F.array_join(F.transform(F.split(s, ""), one_digit), ""),
        "scramble": lambda: F.array_join(F.transform(F.split(s, ""), one_sign), ""),
        "noise": lambda: F.coalesce(F.round(s.try_cast("double") * (1 + F.lit(spread) * (2 * part - 1)), 2).cast("string"), F.lit("")),
        "shift": lambda: F.coalesce(day_text(F.date_add(s.try_cast("date"), F.floor(part * (2 * days + 0.999)).cast("int") - days)), F.lit("")),
        "year": lambda: F.coalesce(F.year(s.try_cast("date")).cast("string"), F.lit("")),
        "domain": lambda: F.when(s.contains("@"), F.concat(F.substring(drawn, 1, 10), F.lit("@"), F.substring_index(s, "@", -1))).otherwise(""),
        "code": lambda: F.substring(drawn, 1, 12),
    }
    if mode not in out:
        raise ValueError(f"unknown mode: {mode}")
    return F.when(filled(c), out[mode]()).otherwise(F.lit(""))


def drawn_from(c: str, choices: Sequence[str], key: str) -> Column:
    """One of ``choices`` (first names, streets, companies, ...), the same for the same value and ``key``; empty stays empty."""
    at = F.pmod(F.xxhash64(F.lit(key), trimmed(c)), F.lit(len(choices))).cast("int")
    return F.when(filled(c), F.array(*[F.lit(x) for x in choices])[at]).otherwise(F.lit(""))
