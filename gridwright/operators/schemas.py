"""Schemas that a table already follows, told from every row, and rows checked against a schema (Table Schema descriptors)."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import GARBLED, fold_text, text
from ..plans.durable import keep
from .counts import cell_counts

#: Pairs of words for true and false. Fixed values.
BOOLEANS = (("true", "false"), ("yes", "no"), ("oui", "non"), ("vrai", "faux"))
#: A list of values is a rule if it has at most so many, each seen so often on average; so many are looked at for pairs. Fixed values.
ENUM_MOST, ENUM_REPEATS, FEW_VALUES = 15, 10, 50
_PHONE = r"\+?[0-9 ().\/-]{6,24}"
_KEYISH = re.compile(r"(?i)(id|.*[_ \-]id|.*id|code|ref|reference|key|uuid|siret|siren)")


def _day(s: Column, y: int, m: int, d: int, shape: str) -> Column:
    part = lambda k, n: F.lpad(F.regexp_extract(s, shape, k), n, "0")
    return s.rlike(shape) & F.concat_ws("-", part(y, 4), part(m, 2), part(d, 2)).try_cast("date").isNotNull()


_ISO, _SLASHED = r"^([0-9]{4})-([0-9]{2})-([0-9]{2})$", r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})$"
_CLOCK = r"(?:[01][0-9]|2[0-3]):[0-5][0-9](?::[0-5][0-9](?:\.[0-9]+)?)?"
_NUMBER, _COMMA = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$", r"^[+-]?(?:[0-9]+|[0-9]{1,3}(?: [0-9]{3})+)(?:,[0-9]+)?$"
_MAIL = r"^[^\s@]+@[^\s@.]+(?:\.[^\s@.]+)+$"

#: What a filled value can be read as. A column is what all of its values can be.
READINGS = {
    "integer": lambda s: s.rlike("^[+-]?[0-9]+$"),
    "number": lambda s: s.rlike(_NUMBER),
    "comma": lambda s: s.rlike(_COMMA),
    "iso": lambda s: _day(s, 1, 2, 3, _ISO),
    "dmy": lambda s: _day(s, 3, 2, 1, _SLASHED),
    "mdy": lambda s: _day(s, 3, 1, 2, _SLASHED),
    "datetime": lambda s: s.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T" + _CLOCK + "Z?$") & F.substring(s, 1, 10).try_cast("date").isNotNull(),
    "time": lambda s: s.rlike(f"^{_CLOCK}$"),
    "email": lambda s: s.rlike(_MAIL),
    "phone": lambda s: s.rlike(f"^{_PHONE}$") & (F.length(F.regexp_replace(s, "[^0-9]", "")) >= 6),
}
#: What some value of a column is.
TRAITS = {
    "negative": lambda s: s.startswith("-"),
    "leading_zero": lambda s: s.rlike("^[+-]?0[0-9]+$"),
    "spaced": lambda s: s.contains(" "),
    "first_over_12": lambda s: s.rlike("^(?:1[3-9]|2[0-9]|3[01])/"),
    "second_over_12": lambda s: s.rlike("^[0-9]{1,2}/(?:1[3-9]|2[0-9]|3[01])/"),
}


def _bits(tests: Mapping, s: Column) -> Column:
    out = F.lit(0)
    for k, test in enumerate(tests.values()):
        out = out.bitwiseOR(F.when(test(s), 1 << k).otherwise(0))
    return out


def column_formats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, filled, empty, distinct_values, repeated, can_be, has, digits_low, digits_high): a row for each column.

    ``can_be`` has a bit for each of READINGS that all values allow, ``has`` one for each of TRAITS that some value has: sets that are merged
    by and and or in the one pass over the distinct texts, which are counted with a partial aggregate.
    """
    counts, s = cell_counts(df, columns, trim=False), F.col("t")
    ok, digits = s != "", F.length(F.regexp_replace(s, "^[+-]", ""))
    return counts.groupBy("column_name").agg(
        F.coalesce(F.sum(F.when(ok, F.col("n"))), F.lit(0)).alias("filled"), F.coalesce(F.sum(F.when(~ok, F.col("n"))), F.lit(0)).alias("empty"), F.count_if(ok).alias("distinct_values"), F.count_if(ok & (F.col("n") > 1)).alias("repeated"),
        F.bit_and(F.when(ok, _bits(READINGS, s))).alias("can_be"), F.bit_or(F.when(ok, _bits(TRAITS, s))).alias("has"), F.min(F.when(ok, digits)).alias("digits_low"), F.max(F.when(ok, digits)).alias("digits_high"),
    )


def infer_schema(df: DataFrame, columns: Sequence[str]) -> dict:
    """A Table Schema descriptor of the rules that all rows of ``columns`` follow. A row for each column, and the values of those that have few, reach the driver.

    Types are boolean (a pair of words), integer, number (also with a decimal comma), date (ISO, day or month first; where both fit,
    day first), datetime, time and string; numbers without a negative one have the minimum 0, whole numbers with leading zeros are strings of
    digits; e-mail addresses and phone numbers are told. Required are columns without an empty cell, unique are integers and texts
    without spaces that never come twice. The primary key is the first of these, one named like a key before others.
    """
    known = {r.column_name: r for r in column_formats(df, columns).collect()}
    few = [c for c in columns if c in known and 0 < known[c].distinct_values <= FEW_VALUES]
    values: dict[str, list[str]] = {}
    if few:
        for r in cell_counts(df, few, trim=False).where("t <> ''").select("column_name", "t").collect():
            values.setdefault(r.column_name, []).append(r.t)
    fields = [_field(c, known.get(c), values.get(c, [])) for c in columns]
    unique = [f["name"] for f in fields if f.get("constraints", {}).get("unique")]
    key = next((c for c in unique if _KEYISH.fullmatch(c)), unique[0] if unique else None)
    return {"fields": fields, "missingValues": [""]} | ({"primaryKey": key} if key else {})


def _field(name: str, x, values: list[str]) -> dict:
    out: dict = {"name": name}
    if x is None or not x.filled:
        return out | {"type": "string"}
    can = {k for i, k in enumerate(READINGS) if x.can_be >> i & 1}
    has = {k for i, k in enumerate(TRAITS) if x.has >> i & 1}
    rules: dict = {}
    pair = next((p for p in BOOLEANS if values and len(values) <= 2 and all(v.lower() in p for v in values)), None)
    if pair:
        out |= {"type": "boolean", "trueValues": sorted(v for v in values if v.lower() == pair[0]), "falseValues": sorted(v for v in values if v.lower() == pair[1])}
    elif "integer" in can and "leading_zero" in has:
        out["type"] = "string"
        rules["pattern"] = rf"\d{{{x.digits_low}}}" if x.digits_low == x.digits_high else r"\d+"
    elif can & {"integer", "number", "comma"}:
        out["type"] = "integer" if "integer" in can else "number"
        if not can & {"integer", "number"}:
            out |= {"decimalChar": ","} | ({"groupChar": " "} if "spaced" in has else {})
        if "negative" not in has:
            rules["minimum"] = 0
    elif "iso" in can:
        out["type"] = "date"
    elif "dmy" in can and ("mdy" not in can or "first_over_12" in has or "second_over_12" not in has):
        out |= {"type": "date", "format": "%d/%m/%Y"}
    elif "mdy" in can:
        out |= {"type": "date", "format": "%m/%d/%Y"}
    elif can & {"datetime", "time"}:
        out["type"] = "datetime" if "datetime" in can else "time"
    else:
        out["type"] = "string"
        if "email" in can:
            out["format"] = "email"
        elif "phone" in can:
            rules["pattern"] = _PHONE
    if not x.empty:
        rules["required"] = True
        if x.filled > 1 and not x.repeated and (out["type"] == "integer" or (out["type"] == "string" and "spaced" not in has)):
            rules["unique"] = True
    if out["type"] == "string" and "format" not in out and not rules.keys() & {"pattern", "unique"} and 1 < len(values) <= ENUM_MOST and x.filled >= len(values) * ENUM_REPEATS:
        rules["enum"] = sorted(values, key=lambda v: (fold_text(v), v.lower(), v.swapcase()))
    return out | ({"constraints": rules} if rules else {})


#: What a text must not have, by the name of the check.
CHECKS = {
    "edges": r"^\s|\s$", "double_space": "  ", "invisible": "[​-‏⁠﻿­\\x00-\\x08\\x0e-\\x1f]", "breaks": r"[\r\n]", "garbled": GARBLED, "formula": r"^[=+@-](?![\d\s.,]*$)(?!-*$)",
}


def _typed(f: Mapping, s: Column) -> tuple[Column, Column | None]:
    """Whether a filled cell is of a field's type, and its number, for bounds (dates as yyyymmdd)."""
    kind, form = f.get("type", "string"), f.get("format")
    if kind in ("integer", "number"):
        bare = s
        if f.get("groupChar"):
            bare = F.replace(bare, F.lit(f["groupChar"]), F.lit(""))
        if f.get("decimalChar", ".") != ".":
            bare = F.when(~F.contains(bare, F.lit(".")), F.replace(bare, F.lit(f["decimalChar"]), F.lit(".")))
        shape = "^[+-]?[0-9]+$" if kind == "integer" else _NUMBER
        return F.coalesce(bare.rlike(shape), F.lit(False)), bare.try_cast("double")
    if kind == "date":
        y, m, d, shape = {"%d/%m/%Y": (3, 2, 1, _SLASHED), "%m/%d/%Y": (3, 1, 2, _SLASHED)}.get(form, (1, 2, 3, _ISO))
        part = lambda k: F.regexp_extract(s, shape, k).try_cast("double")
        return _day(s, y, m, d, shape), part(y) * 10000 + part(m) * 100 + part(d)
    if kind == "boolean":
        return s.isin(*f.get("trueValues", ["true", "True", "TRUE", "1"]), *f.get("falseValues", ["false", "False", "FALSE", "0"])), None
    if kind in ("datetime", "time"):
        return READINGS[kind](s), None
    if form == "email":
        return s.rlike(_MAIL), None
    return F.lit(True), None


def _bound(f: Mapping, value) -> float:
    if isinstance(value, (int, float)):
        return float(value)
    order = {"%d/%m/%Y": r"(\d+)/(\d+)/(\d+)", "%m/%d/%Y": r"(\d+)/(\d+)/(\d+)"}.get(f.get("format"), r"(\d+)-(\d+)-(\d+)")
    found = re.fullmatch(order, value)
    if f.get("type") == "date" and found:
        a, b, c = map(int, found.groups())
        y, m, d = (c, b, a) if f.get("format") == "%d/%m/%Y" else (c, a, b) if f.get("format") == "%m/%d/%Y" else (a, b, c)
        return float(y * 10000 + m * 100 + d)
    return float(value.replace(f.get("groupChar") or "\0", "").replace(f.get("decimalChar", "."), "."))


def check_rows(df: DataFrame, schema: Mapping, rid: str, checks: Mapping[str, Sequence[str]] | None = None, width: Column | None = None) -> DataFrame:
    """(field, rule, n, first_row, examples): what breaks a schema, the first three values (rows) in order for each.

    Rules are required, type, enum, pattern (of the whole value), minimum, maximum, minLength, maxLength, unique and primaryKey, of which
    the rows after the first of a value count; then the names of CHECKS for the columns in ``checks``, ``fields`` for rows of another ``width``
    than the table has columns, and missing, unexpected and order for columns. A cell that isn't of its type breaks no other rule.
    """
    fields = [f for f in schema["fields"] if f["name"] in df.columns]
    s = {f["name"]: text(F.col(f"`{f['name']}`")) for f in fields}
    broken: list[Column] = []

    def breaks(name: str, rule: str, bad: Column, value: Column) -> None:
        broken.append(F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(name).alias("field"), F.lit(rule).alias("rule"), value.alias("value"))))

    for f in fields:
        name, cell, k = f["name"], s[f["name"]], f.get("constraints", {})
        ok = cell != ""
        typed, value = _typed(f, cell)
        live = ok & typed
        rules = {"required": ~ok if k.get("required") else None, "type": ok & ~typed, "enum": live & ~cell.isin(*k["enum"]) if k.get("enum") else None, "pattern": live & ~cell.rlike(f"^(?:{k['pattern']})$") if k.get("pattern") else None}
        if value is not None:
            rules |= {"minimum": live & (value < _bound(f, k["minimum"])) if "minimum" in k else None, "maximum": live & (value > _bound(f, k["maximum"])) if "maximum" in k else None}
        rules |= {"minLength": live & (F.length(cell) < k["minLength"]) if "minLength" in k else None, "maxLength": live & (F.length(cell) > k["maxLength"]) if "maxLength" in k else None}
        rules |= {check: ok & cell.rlike(CHECKS[check]) for check in (checks or {}).get(name, ())}
        for rule, bad in rules.items():
            if bad is not None:
                breaks(name, rule, bad, cell)
    row = F.col(f"`{rid}`").cast("long")
    if width is not None:
        breaks("", "fields", width != len([c for c in df.columns if c != rid]), F.concat(F.lit("row "), row.cast("string")))
    cells = df.select(row.alias("rid"), F.explode(F.array(*broken) if broken else F.array().cast("array<struct<field:string,rule:string,value:string>>")).alias("b")).where("b is not null").select("rid", "b.*")
    key = schema.get("primaryKey") or []
    key = [key] if isinstance(key, str) else list(key)
    keys = [(f["name"], "unique", [f["name"]]) for f in fields if f.get("constraints", {}).get("unique")]
    if len(key) > 1 or (key and key[0] not in [k[0] for k in keys]):
        keys += [(" + ".join(key), "primaryKey", key)] if all(c in df.columns for c in key) else []
    for name, rule, columns in keys:
        whole = F.forall(F.array(*[text(F.col(f"`{c}`")) for c in columns]), lambda x: x != "")
        shown = F.concat_ws(" + ", *[text(F.col(f"`{c}`")) for c in columns])
        rows = df.where(whole).select(row.alias("rid"), F.sha2(F.to_json(F.struct(*[text(F.col(f"`{c}`")).alias(f"k{i}") for i, c in enumerate(columns)])), 256).alias("key"), shown.alias("value"))
        firsts = keep(rows.groupBy("key").agg(F.min("rid").alias("first"), F.count("*").alias("n")).where("n > 1"))
        cells = cells.unionByName(rows.join(firsts, "key").where("rid > first").select("rid", F.lit(name).alias("field"), F.lit(rule).alias("rule"), "value"))
    cells = keep(cells)
    place = F.row_number().over(Window.partitionBy("field", "rule").orderBy("rid"))
    first = cells.withColumn("place", place).where("place <= 3").groupBy("field", "rule").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]).alias("examples"))
    out = cells.groupBy("field", "rule").agg(F.count("*").alias("n"), F.min("rid").alias("first_row")).join(first, ["field", "rule"])
    names, own = [f["name"] for f in schema["fields"]], [c for c in df.columns if c != rid]
    told = [(c, "missing") for c in names if c not in own] + [(c, "unexpected") for c in own if c not in names]
    told += [(a, "order") for a, b in zip([c for c in names if c in own], [c for c in own if c in names], strict=True) if a != b]
    return out.unionByName(df.sparkSession.createDataFrame([(c, r, 1, None, []) for c, r in told], "field string, rule string, n bigint, first_row bigint, examples array<string>"))
