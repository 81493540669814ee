"""Findings about a table, schemas inferred from it and rows checked against them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import date_key, filled, number, text, trimmed
from ..plans.durable import keep
from .counts import cell_counts
from .order_statistics import quantiles


def shape(c: str) -> Column:
    """A value's shape: runs of upper, lower and capitalised letters as A, a, Aa; digits as 9; spaces as one."""
    s = F.regexp_replace(trimmed(c).substr(1, 60), "[0-9]", "9")
    s = F.regexp_replace(F.regexp_replace(s, r"\p{Lu}\p{Ll}+", "\x01"), r"\p{Lu}+", "A")
    return F.regexp_replace(F.replace(F.regexp_replace(s, r"\p{Ll}+", "a"), F.lit("\x01"), F.lit("Aa")), " +", " ")


def column_findings(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, n_rows, empty, stray_spaces, constant, negatives) for each column."""
    found = []
    for c in columns:
        t = F.when(filled(c), text(c))
        found.append(F.struct(F.lit(c).alias("column_name"), F.count("*").alias("n_rows"), F.count_if(~filled(c)).alias("empty"), F.count_if(text(c) != trimmed(c)).alias("stray_spaces"), ((F.count_if(~filled(c)) == 0) & (F.min(t) == F.max(t))).alias("constant"), F.count_if(number(c) < 0).alias("negatives")).alias(c))
    return df.agg(*found).select(F.explode(F.array(*columns)).alias("r")).select("r.*")


def odd_shapes(df: DataFrame, c: str, usual: float = 0.85) -> DataFrame:
    """(shape, n, share, usual): how values are written; the usual shape has at least that share."""
    counts = df.where(filled(c)).groupBy(shape(c).alias("shape")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    share = F.round(F.col("n") / F.col("total"), 6)
    return counts.join(F.broadcast(total)).select("shape", "n", share.alias("share"), (share >= usual).alias("usual"))


def near_key(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, distinct_values, repeated_rows, is_key): how close each column is to a key."""
    counts = cell_counts(df, columns)
    filled_rows = F.coalesce(F.sum(F.when(F.col("t") != "", F.col("n"))), F.lit(0))
    found = counts.groupBy("column_name").agg(F.count_if(F.col("t") != "").alias("distinct_values"), filled_rows.alias("f"), F.sum("n").alias("rows"))
    return found.select("column_name", "distinct_values", (F.col("f") - F.col("distinct_values")).alias("repeated_rows"), ((F.col("f") == F.col("rows")) & (F.col("distinct_values") == F.col("rows"))).alias("is_key"))


def decided_by(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows that break "a decides b": (a, usual, value, n) for values of b that aren't the commonest of their a (ties: the smallest)."""
    counts = df.where(filled(a) & filled(b)).groupBy(trimmed(a).alias("a"), trimmed(b).alias("b")).agg(F.count("*").alias("n"))
    best = counts.groupBy("a").agg(F.min_by("b", F.struct(-F.col("n"), F.col("b"))).alias("usual"))
    return counts.join(best, "a").where(F.col("b") != F.col("usual")).select("a", "usual", F.col("b").alias("value"), "n")


def ratio_of(df: DataFrame, a: str, b: str, factor: float, decimals: int) -> DataFrame:
    """One row: rows with both numbers, and those in which b = a * factor within half the last decimal."""
    x, y = number(a), number(b)
    return df.where(x.isNotNull() & y.isNotNull()).agg(F.count("*").alias("both"), F.count_if(F.abs(y - x * factor) <= 0.5 * 10**-decimals + 1e-9).alias("agree"))


@dataclass(frozen=True)
class Field:
    """Rules for a column; a type failure stops the cell's other rules."""

    name: str
    type: str = "string"
    required: bool = False
    unique: bool = False
    pattern: str | None = None
    minimum: float | None = None
    maximum: float | None = None
    enum: tuple[str, ...] | None = None
    min_length: int | None = None
    max_length: int | None = None


def to_table_schema(fields: Sequence[Field], primary_key: Sequence[str] = ()) -> dict:
    """Fields as a Table Schema descriptor, ready for JSON; what isn't set isn't written."""
    out = []
    for f in fields:
        rules = {"required": f.required or None, "unique": f.unique or None, "pattern": f.pattern, "minimum": f.minimum, "maximum": f.maximum, "enum": list(f.enum) if f.enum else None, "minLength": f.min_length, "maxLength": f.max_length}
        kept = {k: v for k, v in rules.items() if v is not None}
        out.append({"name": f.name, "type": f.type} | ({"constraints": kept} if kept else {}))
    return {"fields": out} | ({"primaryKey": list(primary_key)} if primary_key else {})


def from_table_schema(schema: dict) -> list[Field]:
    """Fields of a Table Schema descriptor; parts of the primary key are required, and one alone is unique."""
    key = schema.get("primaryKey", [])
    key = [key] if isinstance(key, str) else key
    out = []
    for f in schema["fields"]:
        c = f.get("constraints", {})
        own = f["name"] in key
        out.append(Field(f["name"], f.get("type", "string"), c.get("required", False) or own, c.get("unique", False) or key == [f["name"]], c.get("pattern"), c.get("minimum"), c.get("maximum"), tuple(c["enum"]) if "enum" in c else None, c.get("minLength"), c.get("maxLength")))
    return out


_TYPES = {"integer": r"^[+-]?[0-9]+$", "number": r"^[+-]?(?:[0-9]+[.,]?[0-9]*|[.,][0-9]+)$", "boolean": "(?i)^(?:true|false|yes|no|oui|non|vrai|faux)$"}


def infer(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, type, required, is_unique, minimum_zero): from every row, each text of a column being judged once."""
    counts, s = cell_counts(df, columns, trim=False), F.col("t")
    ok = s != ""
    every = {k: F.every(F.when(ok, s.rlike(p))) for k, p in _TYPES.items()} | {"date": F.every(F.when(ok, date_key("t").isNotNull()))}
    kind = F.when(F.count_if(ok) == 0, "string")
    for k in ("boolean", "integer", "number", "date"):
        kind = kind.when(every[k], k)
    spaceless = F.every(F.when(ok, ~s.contains(" ")))
    unique = (F.max(F.when(ok, F.col("n"))) == 1) & (F.count_if(ok) > 1) & (every["integer"] | spaceless)
    return counts.groupBy("column_name").agg(kind.otherwise("string").alias("type"), (F.count_if(~ok) == 0).alias("required"), F.coalesce(unique, F.lit(False)).alias("is_unique"), F.coalesce(every["number"] & (F.min(number("t")) >= 0), F.lit(False)).alias("minimum_zero"))


def validate(df: DataFrame, fields: Sequence[Field], rid: str, primary_key: Sequence[str] = (), structure: bool = False) -> DataFrame:
    """(field, rule, n, first_row): what breaks the rules. A type failure stops the cell's other rules.

    ``unique`` and ``primaryKey`` (the field is its columns, joined by +) count the rows after the first of their value, and
    first_row is the first of these; ``primaryKey`` leaves rows without the whole key out, which ``required`` tells. With
    ``structure`` columns that are ``missing``, ``unexpected`` or out of ``order`` are told too (n is 1); rules of missing
    fields are passed over.
    """
    present = [f for f in fields if f.name in df.columns]
    broken = []
    for f in present:
        s, ok = text(f.name), text(f.name) != ""
        typed = s.rlike(_TYPES[f.type]) if f.type in _TYPES else date_key(f.name).isNotNull() if f.type == "date" else F.lit(True)
        live = ok & typed
        rules: dict[str, Column] = {"required": ~ok if f.required else F.lit(False), "type": ok & ~typed}
        if f.pattern:
            rules["pattern"] = live & ~s.rlike(f"^(?:{f.pattern})$")
        if f.minimum is not None:
            rules["minimum"] = live & (number(f.name) < f.minimum)
        if f.maximum is not None:
            rules["maximum"] = live & (number(f.name) > f.maximum)
        if f.enum:
            rules["enum"] = live & ~s.isin(*f.enum)
        if f.min_length is not None:
            rules["min_length"] = live & (F.length(s) < f.min_length)
        if f.max_length is not None:
            rules["max_length"] = live & (F.length(s) > f.max_length)
        broken += [F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(f.name).alias("field"), F.lit(rule).alias("rule"))) for rule, bad in rules.items()]
    cells = df.select(F.col(rid).cast("long").alias("rid"), F.explode(F.array(*broken) if broken else F.array().cast("array<struct<field:string,rule:string>>")).alias("b")).where("b is not null")
    out = cells.groupBy("b.field", "b.rule").agg(F.count("*").alias("n"), F.min("rid").alias("first_row"))
    keys = [(f.name, "unique", [f.name]) for f in present if f.unique]
    if primary_key and all(c in df.columns for c in primary_key):
        keys.append((" + ".join(primary_key), "primaryKey", list(primary_key)))
    for name, rule, columns in keys:
        out = out.unionByName(_repeats(df, columns, rid).select(F.lit(name).alias("field"), F.lit(rule).alias("rule"), "n", "first_row"))
    if structure:
        names, known = [f.name for f in fields], [f.name for f in present]
        own = [c for c in df.columns if c in known]
        told = [(c, "missing") for c in names if c not in df.columns] + [(c, "unexpected") for c in df.columns if c not in names and c != rid]
        told += [(c, "order") for c, d in zip(known, own, strict=True) if c != d]
        out = out.unionByName(df.sparkSession.createDataFrame([(c, r, 1, None) for c, r in told], "field string, rule string, n bigint, first_row bigint"))
    return out


def _repeats(df: DataFrame, columns: Sequence[str], rid: str) -> DataFrame:
    """No row or one (n, first_row): rows after the first of their key; keys are counted first, so only repeated ones meet their rows."""
    full = F.forall(F.array(*[text(c) for c in columns]), lambda x: x != "")
    key = F.sha2(F.to_json(F.struct(*[text(c).alias(f"k{i}") for i, c in enumerate(columns)])), 256)
    rows = df.where(full).select(key.alias("key"), F.col(rid).cast("long").alias("rid"))
    firsts = keep(rows.groupBy("key").agg(F.min("rid").alias("first"), F.count("*").alias("k")).where("k > 1"))
    second = rows.join(firsts, "key").where(F.col("rid") > F.col("first")).agg(F.min("rid").alias("first_row"))
    return firsts.agg(F.sum(F.col("k") - 1).alias("n")).where("n > 0").join(F.broadcast(second))  # one row each


#: Text checks: what a cell must not have, or must be.
TEXT_CHECKS = {"no_invisible": "[\u200b-\u200f\u2060\ufeff\u00ad]", "no_double_space": "  ", "upper_case": r"\p{Ll}", "capitalised": r"^\p{Ll}"}


def text_checks(df: DataFrame, c: str, checks: Sequence[str]) -> DataFrame:
    """(check_name, n): filled cells that break each check."""
    return df.agg(*[F.count_if(filled(c) & text(c).rlike(TEXT_CHECKS[k])).alias(k) for k in checks]).unpivot([], list(checks), "check_name", "n")


def far_values(df: DataFrame, c: str, rid: str) -> DataFrame:
    """Rows outside three interquartile ranges around the quartiles (rid, value)."""
    n = number(c)
    q = quantiles(df, n, [0.25, 0.75]).select(F.col("q0").alias("q1"), F.col("q1").alias("q3"))
    out = df.select(rid, n.alias("value")).join(F.broadcast(q))  # one row
    return out.where((F.col("value") < F.col("q1") - 3 * (F.col("q3") - F.col("q1"))) | (F.col("value") > F.col("q3") + 3 * (F.col("q3") - F.col("q1")))).select(rid, "value")


def written_otherwise(df: DataFrame, c: str, rid: str, usual: float = 0.85, odd: float = 0.05, odd_case: float = 0.12) -> DataFrame:
    """(rid, value) of cells written unlike the others: at least 20 filled and three distinct cells, one shape usual.

    A usual shape with digits makes all others odd, if they are at most ``odd`` of the cells; one of letters only those that
    differ in their case, up to ``odd_case``. Shapes are counted first, so a hot one is a single row.
    """
    cells = df.where(filled(c)).select(rid, text(c).alias("value"), shape(c).alias("shape"))
    counts = keep(cells.groupBy("shape").agg(F.count("*").alias("n")))
    best = counts.agg(F.sum("n").alias("total"), F.max_by("shape", F.struct("n", "shape")).alias("best"), F.max("n").alias("best_n"))
    several = cells.select("value").distinct().limit(3).agg((F.count("*") >= 3).alias("several"))
    judged = counts.join(F.broadcast(best)).join(F.broadcast(several)).where("several and total >= 20 and shape <> best").where(F.col("best_n") >= usual * F.col("total"))  # one row each
    digits = F.col("best").contains("9")
    case_only = F.lower("shape") == F.lower("best")
    named = judged.where(digits | case_only).select("shape", "n", "total", digits.alias("digits"))
    share = named.agg((F.sum("n") / F.max("total")).alias("share"))
    kept = named.join(F.broadcast(share)).where(F.col("share") <= F.when(F.col("digits"), odd).otherwise(odd_case)).select("shape")
    return cells.join(kept, "shape", "left_semi").select(rid, "value")


def few_negatives(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, negatives, others) where negatives are few, at most one or 1 %, among at least 50 other numbers."""
    found = [F.struct(F.lit(c).alias("column_name"), F.count_if(number(c) < 0).alias("negatives"), F.count_if(number(c) >= 0).alias("others")).alias(f"c{i}") for i, c in enumerate(columns)]
    rows = df.agg(*found).select(F.explode(F.array(*[f"c{i}" for i in range(len(columns))])).alias("r")).select("r.*")
    return rows.where((F.col("negatives") > 0) & (F.col("others") >= 50) & (F.col("negatives") <= F.greatest(F.lit(1.0), 0.01 * (F.col("negatives") + F.col("others")))))


def _decimals(c: str) -> Column:
    return F.max(F.length(F.regexp_extract(trimmed(c), r"[.,]([0-9]+)$", 1)))


def hidden_ratios(df: DataFrame, columns: Sequence[str], least: int = 20, share: float = 0.9) -> DataFrame:
    """(a, b, factor, both, agree): columns with b = a * factor, the commonest ratio to four digits (ties: the smallest).

    At least ``least`` rows have both numbers and ``share`` of them agree within half of b's last decimal. Ratios of every
    pair are counted in one pass, combined before the shuffle.
    """
    read = keep(df.select(*[number(c).alias(c) for c in columns]))
    pairs = [(a, b) for a in columns for b in columns if a != b]
    four = lambda x: F.round(x / F.pow(F.lit(10.0), F.floor(F.log10(F.abs(x))) - 3)) * F.pow(F.lit(10.0), F.floor(F.log10(F.abs(x))) - 3)
    told = [F.when((F.col(a) != 0) & (F.col(b) != 0), F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(four(F.col(b) / F.col(a)), 12).alias("factor"))) for a, b in pairs]
    ratios = read.select(F.explode(F.array(*told)).alias("r")).where("r is not null").groupBy("r.a", "r.b", "r.factor").agg(F.count("*").alias("n"))
    common = ratios.groupBy("a", "b").agg(F.sum("n").alias("seen"), F.max("n").alias("most"), F.min_by("factor", F.struct(-F.col("n"), F.col("factor"))).alias("factor"))
    common = [(r.a, r.b, r.factor) for r in common.where(F.col("most") >= 0.5 * F.col("seen")).collect() if r.factor != 1]  # a row for each pair of columns
    empty = df.sparkSession.createDataFrame([], "a string, b string, factor double, both bigint, agree bigint")
    if not common:
        return empty
    places = df.agg(*[_decimals(b).alias(f"d{i}") for i, (_, b, _) in enumerate(common)]).first()
    rows = []
    for i, (a, b, factor) in enumerate(common):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        close = F.abs(F.col(b) - F.col(a) * factor) <= 0.5 * 10.0 ** -(places[i] or 0) + 1e-9
        rows.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(float(factor)).alias("factor"), F.count_if(both).alias("both"), F.count_if(both & close).alias("agree")).alias(f"r{i}"))
    out = read.agg(*rows).select(F.explode(F.array(*[f"r{i}" for i in range(len(rows))])).alias("r")).select("r.*")
    return out.where((F.col("both") >= least) & (F.col("agree") >= share * F.col("both")))


#: Triples of columns that one pass of :func:`hidden_sums` aggregates.
TRIPLES = 300


def hidden_sums(df: DataFrame, columns: Sequence[str], least: int = 20, share: float = 0.9) -> DataFrame:
    """(a, b, c, both, agree): columns with c = a + b within half of c's last decimal; a pass aggregates TRIPLES triples of columns."""
    read = df.select(*[number(c).alias(c) for c in columns], *[F.length(F.regexp_extract(trimmed(c), r"[.,]([0-9]+)$", 1)).alias(f"_d_{c}") for c in columns])
    places = F.broadcast(read.agg(*[F.max(f"_d_{c}").alias(f"_m_{c}") for c in columns]))  # one row
    rows = read.drop(*[f"_d_{c}" for c in columns]).join(places)
    found, n = [], len(columns)
    for i in range(n):
        for j in range(i + 1, n):
            for k in set(range(n)) - {i, j}:
                a, b, c = columns[i], columns[j], columns[k]
                known = F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(c).isNotNull() & (F.col(a) != 0) & (F.col(b) != 0)
                close = F.abs(F.col(c) - F.col(a) - F.col(b)) <= 0.5 * F.pow(F.lit(10.0), -F.col(f"_m_{c}")) + 1e-9
                found.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c"), F.count_if(known).alias("both"), F.count_if(known & close).alias("agree")).alias(f"r{len(found)}"))
    out = None
    for k in range(0, len(found), TRIPLES):
        part = rows.agg(*found[k : k + TRIPLES])
        part = part.select(F.explode(F.array(*part.columns)).alias("r")).select("r.*")
        out = part if out is None else out.union(part)
    return out.where((F.col("both") >= least) & (F.col("agree") >= share * F.col("both")))


def composite_key(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(rows_repeated, rows_incomplete): rows after the first of their key, and rows in which a part of it is empty."""
    full = F.forall(F.array(*[text(c) for c in columns]), lambda x: x != "")
    counted = df.groupBy(*[text(c).alias(f"k{i}") for i, c in enumerate(columns)], full.alias("full")).agg(F.count("*").alias("n"))
    repeated = F.coalesce(F.sum(F.when(F.col("full"), F.col("n") - 1)), F.lit(0))
    return counted.agg(repeated.cast("long").alias("rows_repeated"), F.coalesce(F.sum(F.when(~F.col("full"), F.col("n"))), F.lit(0)).cast("long").alias("rows_incomplete"))


#: Formats of text fields. Fixed values.
TEXT_FORMATS = {
    "email": r"^[^\s@]+@[^\s@.]+(?:\.[^\s@.]+)+$",
    "uri": r"^[A-Za-z][A-Za-z0-9+.-]*:\S+$",
    "uuid": "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
}


def typed(c: str, kind: str, form: str | None = None, decimal_mark: str = ".", group_mark: str = "", true: Sequence[str] = ("true", "True", "TRUE", "1"), false: Sequence[str] = ("false", "False", "FALSE", "0")) -> Column:
    """A cell as a value of a schema's type; null where it isn't one.

    ``integer``, ``number`` (with marks), ``boolean`` (by lists), ``date``, ``datetime`` and ``time`` (``form`` is a Spark
    pattern, without it ISO), ``year``, ``string`` (``form`` one of TEXT_FORMATS).
    """
    s = text(c)
    if kind in ("integer", "number"):
        bare = F.replace(s, F.lit(group_mark), F.lit("")) if group_mark else s
        if kind == "integer":
            return F.when(bare.rlike("^[+-]?[0-9]+$"), bare).try_cast("long")
        dotted = F.replace(bare, F.lit(decimal_mark), F.lit(".")) if decimal_mark != "." else bare
        clean = ~bare.contains(".") if decimal_mark != "." else F.lit(True)
        return F.when(clean & dotted.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"), dotted).try_cast("double")
    if kind == "boolean":
        return F.when(s.isin(*true), True).when(s.isin(*false), False)
    if kind == "date":
        return F.to_date(F.try_to_timestamp(s, F.lit(form))) if form else F.when(s.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), s).try_cast("date")
    if kind == "datetime":
        return F.try_to_timestamp(s, F.lit(form)) if form else F.when(s.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}"), s).try_cast("timestamp")
    if kind == "time":
        return F.when(s.rlike("^(?:[01][0-9]|2[0-3]):[0-5][0-9](?::[0-5][0-9])?$"), s)
    if kind == "year":
        return F.when(s.rlike("^[0-9]{4}$"), s).try_cast("int")
    return F.when(s.rlike(TEXT_FORMATS[form]) if form else s != "", s)


#: What runs of a pattern stand for, by the letter that marks them.
_RUNS = {"9": "[0-9]", "A": r"\p{Lu}", "a": r"\p{Ll}"}


def pattern_hints(df: DataFrame, c: str, longest: int = 60) -> DataFrame:
    """(pattern, n): regular expressions that the filled cells of up to ``longest`` characters match, by the runs of their characters.

    Cells with the same sequence of digits, capitals, small letters and signs share a pattern; its repeat counts go from the
    shortest to the longest run at each place.
    """
    s = F.when(F.length(text(c)) <= longest, text(c))
    marked = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"\p{Lu}", "A"), r"\p{Ll}", "a"), "[0-9]", "9")
    counts = df.where(filled(c) & s.isNotNull()).groupBy(marked.alias("marked")).agg(F.count("*").alias("n"))
    runs = counts.select("n", F.regexp_extract_all("marked", F.lit(r"(?s)((.)\2*)"), F.lit(1)).alias("runs"))
    placed = runs.select("n", F.array_join(F.transform("runs", lambda r: r.substr(1, 1)), "").alias("signs"), F.posexplode("runs").alias("at", "run"))
    ends = placed.groupBy("signs", "at").agg(F.min(F.length("run")).alias("low"), F.max(F.length("run")).alias("high"), F.sum("n").alias("n"))
    sign = F.col("signs").substr(F.col("at") + 1, F.lit(1))
    one = F.regexp_replace(sign, r"([\\.*+?^${}()|\[\]/])", r"\\$1")
    for mark, runs_of in _RUNS.items():
        one = F.when(sign == mark, F.lit(runs_of)).otherwise(one)
    many = F.when(F.col("high") == 1, "").when(F.col("low") == F.col("high"), F.format_string("{%d}", "low")).otherwise(F.format_string("{%d,%d}", "low", "high"))
    pieces = ends.select("signs", "n", F.struct("at", F.concat(one, many).alias("piece")).alias("p"))
    joined = pieces.groupBy("signs").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["piece"]), "").alias("pattern"), F.max("n").alias("n"))
    return joined.select("pattern", "n")
