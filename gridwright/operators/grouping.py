"""Groups, pivots, value counts, totals and profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType
from pyspark.sql.window import Window

from ..functions.text import date_key, filled, fold, half_up, match_key, number, sort_key, text, trimmed
from ..plans.durable import keep, number_rows
from .counts import cell_counts
from .filters import terms
from .order_statistics import quantiles

FUNCTIONS = ("sum", "average", "min", "max", "distinct")


def _is_numeric(df: DataFrame, c: str) -> bool:
    return c in df.columns and isinstance(df.schema[c].dataType, NumericType)


def _numeric(df: DataFrame, c: str) -> Column:
    """A numeric column as it is (NaN unreadable), others by their text."""
    if _is_numeric(df, c):
        return F.nullif(F.col(c).cast("double"), F.lit(float("nan")))
    return number(c)


def _aggregate(df: DataFrame, fun: str, c: str, rid: str, kind: str) -> Column:
    n = _numeric(df, c)
    if fun in ("min", "max") and _is_numeric(df, c):  # equal numbers of one type have the same text
        best = (F.min if fun == "min" else F.max)(n)
        return F.coalesce(F.regexp_replace(best.cast(df.schema[c].dataType).cast("string"), r"\.0$", ""), F.lit("")).alias(f"{c}_{fun}")
    key = n if kind == "number" else date_key(c) if kind == "date" else fold(trimmed(c))
    known = F.when(key.isNotNull() & filled(c), F.struct(key.alias("key"), F.col(rid).alias("rid")))
    last = F.when(key.isNotNull() & filled(c), F.struct(key.alias("key"), (-F.col(rid)).alias("rid")))
    return {
        "sum": half_up(F.coalesce(F.sum(n), F.lit(0.0)), 6),
        "average": half_up(F.avg(n), 6),
        "min": F.coalesce(F.min_by(trimmed(c), known), F.lit("")),
        "max": F.coalesce(F.max_by(trimmed(c), last), F.lit("")),
        "distinct": F.count_distinct(F.col(c) if _is_numeric(df, c) else F.when(filled(c), trimmed(c))),
    }[fun].alias(f"{c}_{fun}")


def group_by(df: DataFrame, by: Sequence[str], aggregates: Sequence[tuple[str, str, str]], rid: str, how: str = "exact") -> DataFrame:
    """Groups with their count and aggregates (column, function, kind); keys compared ``exact``, ``loose`` or ``slug``.

    The spelling first met is shown, an empty key is a group; unreadable numbers are left out. ``first_row`` is the
    group's first row, by which groups of equal count follow each other.
    """
    keys = [match_key(c, how).alias(f"_g{i}") for i, c in enumerate(by)]
    measures = [F.count("*").alias("n"), F.min(rid).alias("first_row"), *[_aggregate(df, f, c, rid, k) for c, f, k in aggregates]]
    if how == "exact":  # the key is its own spelling
        return df.groupBy(*keys).agg(*measures).select(*[F.trim(f"_g{i}").alias(c) for i, c in enumerate(by)], *[c for c in ("n", "first_row", *[f"{c}_{f}" for c, f, _ in aggregates])])
    shown = [F.min_by(trimmed(c), F.col(rid)).alias(c) for c in by]
    out = df.groupBy(*keys).agg(*shown, *measures)
    return out.drop(*[f"_g{i}" for i in range(len(by))])


def date_bucket(c: str, unit: str) -> Column:
    """A date's ``year``, ``quarter``, ``month`` or ``day`` as a label; empty where there is no date."""
    d = F.lpad(date_key(c).cast("string"), 14, "0")
    y, m = d.substr(1, 4), d.substr(5, 2)
    quarter = F.concat(y, F.lit("-Q"), F.ceil(m.cast("int") / 3).cast("string"))
    label = {"year": y, "quarter": quarter, "month": F.concat_ws("-", y, m), "day": F.concat_ws("-", y, m, d.substr(7, 2))}[unit]
    return F.coalesce(F.when(date_key(c).isNotNull(), label), F.lit(""))


def pivot_cells(df: DataFrame, row: Column, column: Column, fun: str, value: str | None = None) -> DataFrame:
    """Cells and all totals of a pivot in long form: (row_label, column_label, is_total_row, is_total_column, value).

    Functions other than ``count`` leave rows with an empty value out; totals of ``distinct`` are unions, of ``average`` overall.
    """
    label = lambda x: F.when(F.trim(x) == "", F.lit("(empty)")).otherwise(F.trim(x))
    kept = df if fun == "count" else df.where(filled(value))
    n = _numeric(kept, value) if value else F.lit(None).cast("double")
    measure = {"count": F.count("*").cast("double"), "sum": half_up(F.sum("_v"), 6), "average": half_up(F.avg("_v"), 6), "min": F.min("_v"), "max": F.max("_v"), "distinct": F.count_distinct("_t").cast("double")}[fun]
    cells = kept.select(label(row).alias("row_label"), label(column).alias("column_label"), n.alias("_v"), (trimmed(value) if value else F.lit(None).cast("string")).alias("_t"))
    return cells.cube("row_label", "column_label").agg(F.grouping("row_label").cast("int").alias("is_total_row"), F.grouping("column_label").cast("int").alias("is_total_column"), measure.alias("value"))


def pivot_table(df: DataFrame, row: str, column: str, fun: str, value: str | None, labels: Sequence[str]) -> DataFrame:
    """A pivot as a table: one column for each of ``labels`` and ``Total``."""
    cells = pivot_cells(df, text(row), text(column), fun, value).where("is_total_row = 0")
    shown = [F.max(F.when((F.col("is_total_column") == 0) & (F.col("column_label") == x), F.col("value"))).alias(x) for x in labels]
    return cells.groupBy("row_label").agg(*shown, F.max(F.when(F.col("is_total_column") == 1, F.col("value"))).alias("Total"))


def value_counts(df: DataFrame, c: str, rid: str, trim: bool = True) -> DataFrame:
    """(value, n, first_row) of each exact value."""
    return df.groupBy((trimmed(c) if trim else text(c)).alias("value")).agg(F.count("*").alias("n"), F.min(rid).alias("first_row"))


def counted_values(df: DataFrame, c: str, rid: str, by: str = "first", search: str = "") -> DataFrame:
    """:func:`value_counts` with each value's place (from 1): by ``first`` appearance, ``count`` (ties collated) or ``value``; only values with all terms of ``search``."""
    counts = value_counts(df, c, rid)
    for term in terms(search):
        counts = counts.where(fold("value").contains(fold(F.lit(term))))
    order = {"first": [F.col("first_row")], "count": [(F.col("n"), True), fold("value"), F.col("first_row")], "value": [sort_key("value"), F.col("first_row")]}[by]
    return number_rows(counts, order, "place")


def totals(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A totals row for each column: (column_name, filled, empty, pct, bad, distinct_values, sum, average, median, min, max) of its numbers.

    pct is the share of filled cells in percent. Cells are counted by their text once, combined before the shuffle, and all
    totals and the median come from these counts.
    """
    seen = F.array(*[F.struct(F.lit(c).alias("column_name"), (F.lit(None).cast("string") if _is_numeric(df, c) else trimmed(c)).alias("t"), (_numeric(df, c) if _is_numeric(df, c) else F.lit(None).cast("double")).alias("v")) for c in columns])
    counts = df.select(F.explode(seen).alias("s")).select("s.*").groupBy("column_name", "t", "v").agg(F.count("*").alias("n"))
    typed = [c for c in columns if _is_numeric(df, c)]
    is_typed = F.col("column_name").isin(*typed) if typed else F.lit(False)
    value = F.when(is_typed, F.col("v")).otherwise(number("t"))
    counts = keep(counts.select("column_name", F.when(is_typed, F.col("v").isNotNull()).otherwise(F.col("t") != "").alias("ok"), value.alias("v"), F.col("n").cast("double").alias("n")))
    sums = counts.groupBy("column_name").agg(
        F.coalesce(F.sum(F.when(F.col("ok"), F.col("n"))), F.lit(0.0)).alias("filled"), F.coalesce(F.sum(F.when(~F.col("ok"), F.col("n"))), F.lit(0.0)).alias("empty"), F.coalesce(F.sum(F.when(F.col("ok") & F.col("v").isNull(), F.col("n"))), F.lit(0.0)).alias("bad"),
        F.count_if("ok").cast("double").alias("distinct_values"), F.sum(F.col("v") * F.col("n")).alias("s"), F.sum(F.when(F.col("v").isNotNull(), F.col("n"))).alias("k"), F.min("v").alias("min"), F.max("v").alias("max"),
    )
    middle = quantiles(counts, F.col("v"), [0.5], ["column_name"], weight="n").select("column_name", F.col("q0").alias("median"))
    pct = half_up(100 * F.col("filled") / (F.col("filled") + F.col("empty")), 2)
    return sums.join(middle, "column_name", "left").select("column_name", "filled", "empty", pct.alias("pct"), "bad", "distinct_values", half_up(F.col("s"), 6).alias("sum"), half_up(F.col("s") / F.col("k"), 6).alias("average"), "median", "min", "max")


def profile(df: DataFrame, columns: Sequence[str], rid: str) -> DataFrame:
    """(column_name, filled, nums, dates, texts, distinct_values, shortest, longest, all_distinct) for each column.

    Cells are counted by their text first, so that each text is read as a number or date once.
    """
    counts = cell_counts(df, columns, rid)
    ok, is_n = F.col("t") != "", F.col("is_n")
    read = counts.withColumns({"is_n": ok & number("t").isNotNull(), "is_d": ok & date_key("t").isNotNull()})
    rows = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).cast("long")
    near, far = F.when(ok, F.struct(F.length("t"), "first")), F.when(ok, F.struct(F.length("t"), -F.col("first")))
    out = read.groupBy("column_name").agg(
        rows(ok).alias("filled"), rows(is_n).alias("nums"), rows(~is_n & F.col("is_d")).alias("dates"), rows(ok & ~is_n & ~F.col("is_d")).alias("texts"),
        F.count_if(ok).alias("distinct_values"), F.min_by("t", near).alias("shortest"), F.max_by("t", far).alias("longest"),
    )
    return out.withColumn("all_distinct", (F.col("distinct_values") == F.col("filled")) & (F.col("filled") > 0))


def quantile_at(df: DataFrame, c: str, p: float, by: Sequence[str] = ()) -> DataFrame:
    """The number at place round(p * (n - 1)) of the sorted ones, in each group."""
    return quantiles(df, _numeric(df, c), [p], by, nearest=True).withColumnRenamed("q0", "value")


def fences(df: DataFrame, c: str, by: Sequence[str] = ()) -> DataFrame:
    """Quartiles and the fences three interquartile ranges outside them; where the quartiles are equal, the 1st and 99th percentile."""
    spread = F.col("q3") - F.col("q1")
    q = quantiles(df, _numeric(df, c), [0.25, 0.75, 0.01, 0.99], by).select(*by, F.col("q0").alias("q1"), F.col("q1").alias("q3"), F.col("q2").alias("p1"), F.col("q3").alias("p99"))
    low, high = F.when(spread == 0, F.col("p1")).otherwise(F.col("q1") - 3 * spread), F.when(spread == 0, F.col("p99")).otherwise(F.col("q3") + 3 * spread)
    return q.select(*by, "q1", "q3", low.alias("low"), high.alias("high"))


def histogram(df: DataFrame, c: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n): bins 1 to ``bins`` of the line, 0 and bins + 1 for what lies outside."""
    n = _numeric(df, c)
    at = F.when(n < low, 0).when(n > high, bins + 1).otherwise(F.least(F.floor((n - low) / ((high - low) / bins)).cast("int") + 1, F.lit(bins)))
    return df.where(n.isNotNull()).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def top_values(df: DataFrame, c: str, rid: str, k: int = 5) -> DataFrame:
    """The ``k`` most frequent values seen at least twice; ties keep first appearance."""
    return value_counts(df, c, rid).where((F.col("value") != "") & (F.col("n") > 1)).orderBy(F.desc("n"), "first_row").limit(k)


def pivot_order(cells: DataFrame, by: str = "label", descending: bool = False) -> DataFrame:
    """Pivot rows with their place (row_label, value, place): by ``label`` or ``total``; rows without a value last, ties by label."""
    rows = cells.where("is_total_row = 0 and is_total_column = 1").select("row_label", "value")
    key = F.col("value") if by == "total" else fold("row_label")
    return number_rows(rows, [(key, descending), F.col("row_label")], "place")


def chart_edges(df: DataFrame, c: str, bins: int = 28) -> dict[str, float | bool | int]:
    """A chart of a number column: ``low``, ``high``, ``bins`` and whether far values lie outside (``below``, ``above``).

    The line is that between the fences where values lie beyond them. Integers over fewer than 40 values have a bar each.
    """
    n = _numeric(df, c)
    f = fences(df, c).first()
    r = df.agg(F.min(n).alias("least"), F.max(n).alias("most"), F.coalesce(F.every(n == F.floor(n)), F.lit(True)).alias("whole"), F.min(F.when(n >= F.lit(f and f.low), n)).alias("low"), F.max(F.when(n <= F.lit(f and f.high), n)).alias("high")).first()
    if r.least is None:
        return {"low": 0.0, "high": 0.0, "bins": 0, "below": False, "above": False}
    below, above = r.least < r.low, r.most > r.high
    if r.whole and r.high - r.low < 40:
        return {"low": r.low - 0.5, "high": r.high + 0.5, "bins": int(r.high - r.low) + 1, "below": below, "above": above}
    return {"low": r.low, "high": r.high, "bins": 1 if r.low == r.high else bins - below - above, "below": below, "above": above}


def chart_bin(df: DataFrame, c: str, edges: dict) -> Column:
    """The bar of a cell: 1 to ``bins``, 0 and ``bins`` + 1 for the tails; null without a number."""
    n, bins = _numeric(df, c), edges["bins"]
    if bins <= 1:
        return F.when(n < edges["low"], 0).when(n > edges["high"], 2).when(n.isNotNull(), 1).cast("int")
    width = (edges["high"] - edges["low"]) / bins
    return F.when(n < edges["low"], 0).when(n > edges["high"], bins + 1).otherwise(F.least(F.floor((n - edges["low"]) / width).cast("int") + 1, F.lit(bins))).cast("int")


def keep_chart_part(df: DataFrame, c: str, part: str, edges: dict | None = None, bins: tuple[int, int] = (0, 0), values: Sequence[str] = ()) -> DataFrame:
    """Rows behind a part of a column's chart: ``bars`` from one to another, a ``value``, the ``others`` than values shown, ``filled`` or ``empty``."""
    tests = {"value": lambda: trimmed(c).isin(*values), "others": lambda: filled(c) & ~trimmed(c).isin(*values), "filled": lambda: filled(c), "empty": lambda: ~filled(c), "bars": lambda: F.coalesce(chart_bin(df, c, edges).between(*bins), F.lit(False))}
    return df.where(tests[part]())


def panel(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, kind, filled, low, high, sum, median) of columns: numbers by value, dates by day since 1970, texts by length.

    A column is of the kind that most of its filled cells have; a median of dates is a date of the column (the lower middle).
    """
    kinds = df.agg(*[F.struct(F.count_if(filled(c)).alias("n"), F.count_if(_numeric(df, c).isNotNull()).alias("nums"), F.count_if(date_key(c).isNotNull()).alias("dates")).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    kind = {c: "number" if k.n and 2 * k.nums > k.n else "date" if k.n and 2 * k.dates > k.n else "text" for c, k in zip(columns, kinds, strict=True)}
    day = lambda c: F.unix_date(F.regexp_replace(F.lpad(F.floor(date_key(c) / 1000000).cast("string"), 8, "0"), "^(....)(..)(..)$", "$1-$2-$3").try_cast("date")).cast("double")
    value = {c: _numeric(df, c) if k == "number" else day(c) if k == "date" else F.when(filled(c), F.length(trimmed(c))).cast("double") for c, k in kind.items()}
    cells = df.select(*[v.alias(c) for c, v in value.items()]).unpivot([], list(columns), "column_name", "value")
    sums = cells.groupBy("column_name").agg(F.count("value").alias("filled"), F.min("value").alias("low"), F.max("value").alias("high"), half_up(F.sum("value"), 6).alias("sum"))
    named = F.create_map(*[F.lit(x) for pair in kind.items() for x in pair])[F.col("column_name")]
    middle = F.when(F.col("kind") == "date", F.floor(F.col("q0"))).otherwise(F.col("q0"))
    return sums.withColumn("kind", named).join(quantiles(cells, F.col("value"), [0.5], ["column_name"]), "column_name", "left").select("column_name", "kind", "filled", "low", "high", F.when(F.col("kind") != "date", F.col("sum")).alias("sum"), middle.alias("median"))


def heat_and_bars(df: DataFrame, c: str) -> DataFrame:
    """``df`` with how a number cell is coloured: heat from 0 to 1 between the 2nd and the 98th percentile, and where its bar begins
    and ends on the range of the column, zero included (bar_from, bar_to, from 0 to 1); null without a number."""
    n = _numeric(df, c)
    ends = quantiles(df, n, [0.02, 0.98, 0.0, 1.0])
    low, high = F.least(F.col("q2"), F.lit(0.0)), F.greatest(F.col("q3"), F.lit(0.0))
    read = df.withColumn("__n", n).join(F.broadcast(ends), how="left")  # one row
    place = lambda x: F.when(high == low, 0.0).otherwise((x - low) / (high - low))
    heat = F.when(F.col("q1") == F.col("q0"), 0.5).otherwise(F.least(F.greatest((F.col("__n") - F.col("q0")) / (F.col("q1") - F.col("q0")), F.lit(0.0)), F.lit(1.0)))
    bar = lambda pick: F.when(F.col("__n").isNotNull(), pick(place(F.col("__n")), place(F.lit(0.0))))
    return read.select(*[F.col(f"`{x}`") for x in df.columns], F.when(F.col("__n").isNotNull(), heat).alias("heat"), bar(F.least).alias("bar_from"), bar(F.greatest).alias("bar_to"))


def selection_sum(df: DataFrame, columns: Sequence[str], rows: Column) -> DataFrame:
    """One row (cells, filled, numbers, sum, average, low, high) for the cells of ``columns`` in the rows that ``rows`` tells."""
    part = df.where(rows)
    cells = part.select(F.explode(F.array(*[F.struct(filled(c).alias("filled"), _numeric(df, c).alias("n")) for c in columns])).alias("x")).select("x.*")
    return cells.agg(F.count("*").alias("cells"), F.count_if("filled").alias("filled"), F.count("n").alias("numbers"), half_up(F.coalesce(F.sum("n"), F.lit(0.0)), 6).alias("sum"), half_up(F.avg("n"), 6).alias("average"), F.min("n").alias("low"), F.max("n").alias("high"))
