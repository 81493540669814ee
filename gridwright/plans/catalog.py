"""Registered queries of the table operators, each beside the DuckDB SQL that gives the same rows.

Names start with the row of the operator inventory that they cover.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formula as fx
from ..functions.text import cell_text, date_key, day_text, fold, match_key, number, slug, sort_key
from ..operators import duplicates, edits, filters, grouping, guesses, joining, matching, quality
from ..sources import readers, writers
from .durable import number_rows, tables_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_PLAIN = "replace(replace(replace(lower(strip_accents({0})), 'œ', 'oe'), 'æ', 'ae'), 'ß', 'ss')"


def _folded(c: str) -> str:
    return _PLAIN.format(c)


def _query(name: str, sql: str | None):
    def add(f: Callable) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


# groups, pivots, counts


@_query("G1_group_by", """
    SELECT l_returnflag, count(*) AS n, min(l_orderkey) AS first_row, round(sum(l_extendedprice), 2) AS price_sum, round(avg(l_extendedprice), 4) AS price_average,
           min(l_quantity) AS quantity_min, max(l_quantity) AS quantity_max, count(DISTINCT l_suppkey) AS l_suppkey_distinct
    FROM lineitem GROUP BY l_returnflag""")
def _(t):
    g = grouping.group_by(t("lineitem"), ["l_returnflag"], [("l_extendedprice", "sum", "number"), ("l_extendedprice", "average", "number"), ("l_quantity", "min", "number"), ("l_quantity", "max", "number"), ("l_suppkey", "distinct", "number")], "l_orderkey")
    return g.select("l_returnflag", "n", "first_row", F.round("l_extendedprice_sum", 2).alias("price_sum"), F.round("l_extendedprice_average", 4).alias("price_average"), F.col("l_quantity_min").cast("double").alias("quantity_min"), F.col("l_quantity_max").cast("double").alias("quantity_max"), "l_suppkey_distinct")


@_query("G4_min_max_first_met", """
    SELECT lower(trim(o_orderpriority)) AS o_orderpriority, count(*) AS n, min(o_orderkey) AS first_row,
           min_by(o_orderstatus, (lower(o_orderstatus), o_orderkey)) AS o_orderstatus_min, max_by(o_orderstatus, (lower(o_orderstatus), -o_orderkey)) AS o_orderstatus_max
    FROM orders GROUP BY 1""")
def _(t):
    return grouping.group_by(t("orders"), ["o_orderpriority"], [("o_orderstatus", "min", "text"), ("o_orderstatus", "max", "text")], "o_orderkey", "loose").withColumn("o_orderpriority", F.lower("o_orderpriority"))


@_query("G9_date_buckets", """
    SELECT strftime(o_orderdate, '%Y') AS year, strftime(o_orderdate, '%Y') || '-Q' || quarter(o_orderdate) AS quarter, strftime(o_orderdate, '%Y-%m') AS month, strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS n
    FROM orders GROUP BY ALL""")
def _(t):
    o = t("orders").withColumn("d", F.col("o_orderdate").cast("string"))
    return o.groupBy(*[grouping.date_bucket("d", u).alias(u) for u in ("year", "quarter", "month", "day")]).agg(F.count("*").alias("n"))


_PIVOT = """SELECT CASE WHEN grouping(o_orderstatus) = 1 THEN NULL ELSE o_orderstatus END AS row_label, CASE WHEN grouping(o_orderpriority) = 1 THEN NULL ELSE o_orderpriority END AS column_label,
    cast(grouping(o_orderstatus) AS INT) AS is_total_row, cast(grouping(o_orderpriority) AS INT) AS is_total_column, {0} AS value FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)"""


def _pivot(t, fun, value):
    return grouping.pivot_cells(t("orders"), F.col("o_orderstatus"), F.col("o_orderpriority"), fun, value)


for _fun, _sql in (("count", "cast(count(*) AS DOUBLE)"), ("sum", "round(sum(o_totalprice), 2)"), ("average", "round(avg(o_totalprice), 4)"), ("min", "min(o_totalprice)"), ("max", "max(o_totalprice)"), ("distinct", "cast(count(DISTINCT o_custkey) AS DOUBLE)")):
    _decimals = {"sum": 2, "average": 4}.get(_fun)
    _query(f"G8_pivot_{_fun}", _PIVOT.format(_sql))(lambda t, f=_fun, d=_decimals: (lambda p: p.withColumn("value", F.round("value", d)) if d else p)(_pivot(t, f, None if f == "count" else "o_custkey" if f == "distinct" else "o_totalprice")))


@_query("G12_pivot_table", """
    SELECT strftime(o_orderdate, '%Y') AS row_label, cast(count(*) FILTER (WHERE o_orderstatus = 'F') AS DOUBLE) AS F, cast(count(*) FILTER (WHERE o_orderstatus = 'O') AS DOUBLE) AS O, cast(count(*) FILTER (WHERE o_orderstatus = 'P') AS DOUBLE) AS P, cast(count(*) AS DOUBLE) AS Total
    FROM orders GROUP BY 1""")
def _(t):
    o = t("orders").withColumn("d", F.col("o_orderdate").cast("string")).withColumn("year", grouping.date_bucket("d", "year"))
    p = grouping.pivot_table(o, "year", "o_orderstatus", "count", None, ["F", "O", "P"])
    return p.na.fill(0.0, ["F", "O", "P"])


@_query("G13_drill_down", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND strftime(o_orderdate, '%Y-%m') = '1997-03'")
def _(t):
    o = t("orders").withColumn("d", F.col("o_orderdate").cast("string"))
    return o.where((F.col("o_orderstatus") == "F") & (grouping.date_bucket("d", "month") == "1997-03")).select("o_orderkey", "o_totalprice")


@_query("G15_value_counts", "SELECT event_type AS value, count(*) AS n, min(event_id) AS first_row FROM events GROUP BY 1")
def _(t):
    return grouping.value_counts(t("events"), "event_type", "event_id")


@_query("G16_totals_row", """
    SELECT 'o_totalprice' AS column_name, cast(count(o_totalprice) AS DOUBLE) AS filled, cast(count(*) - count(o_totalprice) AS DOUBLE) AS empty, 100.0 * count(o_totalprice) / count(*) AS pct, cast(count(o_totalprice) - count(try_cast(o_totalprice AS DOUBLE)) AS DOUBLE) AS bad, cast(count(DISTINCT o_totalprice) AS DOUBLE) AS distinct_values, round(sum(o_totalprice), 2) AS sum, round(avg(o_totalprice), 4) AS average, median(o_totalprice) AS median, min(o_totalprice) AS min, max(o_totalprice) AS max FROM orders
    UNION ALL SELECT 'o_orderpriority', count(nullif(trim(o_orderpriority), '')), count(*) - count(nullif(trim(o_orderpriority), '')), 100.0 * count(nullif(trim(o_orderpriority), '')) / count(*), count(nullif(trim(o_orderpriority), '')) - count(try_cast(o_orderpriority AS DOUBLE)), count(DISTINCT o_orderpriority), sum(try_cast(o_orderpriority AS DOUBLE)), NULL, median(try_cast(o_orderpriority AS DOUBLE)), min(try_cast(o_orderpriority AS DOUBLE)), max(try_cast(o_orderpriority AS DOUBLE)) FROM orders""")
def _(t):
    return grouping.totals(t("orders"), ["o_totalprice", "o_orderpriority"]).withColumns({"sum": F.round("sum", 2), "average": F.round("average", 4)})


@_query("G18_quantile", """
    WITH r AS (SELECT o_orderpriority, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) - 1 AS k, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
    SELECT o_orderpriority, o_totalprice AS value FROM r WHERE k = floor(0.9 * (n - 1) + 0.5)""")
def _(t):
    return grouping.quantile_at(t("orders"), "o_totalprice", 0.9, ["o_orderpriority"])


@_query("G20_profile", " UNION ALL ".join(f"""
    SELECT '{c}' AS column_name, count(v) AS filled, count(try_cast(v AS DOUBLE)) AS nums, count(try_cast(v AS DATE)) FILTER (WHERE try_cast(v AS DOUBLE) IS NULL) AS dates, count(v) - count(try_cast(v AS DOUBLE)) - count(try_cast(v AS DATE)) FILTER (WHERE try_cast(v AS DOUBLE) IS NULL) AS texts,
           count(DISTINCT v) AS distinct_values, min_by(v, (length(v), c_custkey)) AS shortest, max_by(v, (length(v), -c_custkey)) AS longest, count(DISTINCT v) = count(v) AS all_distinct
    FROM (SELECT c_custkey, nullif(trim({c}::VARCHAR), '') AS v FROM customer)""" for c in ("c_name", "c_nationkey")))  # fmt: skip
def _(t):
    return grouping.profile(t("customer"), ["c_name", "c_nationkey"], "c_custkey")


@_query("G22_fences", """
    WITH q AS (SELECT c_mktsegment, quantile_cont(c_acctbal, 0.25) AS q1, quantile_cont(c_acctbal, 0.75) AS q3 FROM customer GROUP BY 1),
    f AS (SELECT c_mktsegment || ' flat' AS c_mktsegment, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3, quantile_cont(v, 0.01) AS p1, quantile_cont(v, 0.99) AS p99 FROM (SELECT c_mktsegment, CASE WHEN c_custkey % 20 = 0 THEN c_acctbal ELSE 0 END AS v FROM customer) GROUP BY 1)
    SELECT c_mktsegment, round(q1, 4) AS q1, round(q3, 4) AS q3, round(q1 - 3 * (q3 - q1), 4) AS low, round(q3 + 3 * (q3 - q1), 4) AS high FROM q
    UNION ALL SELECT c_mktsegment, round(q1, 4), round(q3, 4), round(p1, 4), round(p99, 4) FROM f""")
def _(t):
    c = t("customer")
    both = c.select("c_mktsegment", "c_acctbal").union(c.selectExpr("c_mktsegment || ' flat'", "if(c_custkey % 20 = 0, c_acctbal, 0D)"))
    f = grouping.fences(both, "c_acctbal", ["c_mktsegment"])
    return f.select("c_mktsegment", *[F.round(c, 4).alias(c) for c in ("q1", "q3", "low", "high")])


@_query("G23_histogram", """
    SELECT cast(CASE WHEN l_quantity < 1 THEN 0 WHEN l_quantity > 40 THEN 11 ELSE least(floor((l_quantity - 1) / 3.9) + 1, 10) END AS INT) AS bin, count(*) AS n FROM lineitem GROUP BY 1""")
def _(t):
    return grouping.histogram(t("lineitem"), "l_quantity", 1, 40, 10)


@_query("G24_top_values", "SELECT p_brand AS value, count(*) AS n, min(p_partkey) AS first_row FROM part GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, first_row LIMIT 5")
def _(t):
    return grouping.top_values(t("part"), "p_brand", "p_partkey")


@_query("G15_counted_values", "SELECT p_type AS value, count(*) AS n, min(p_partkey) AS first_row, row_number() OVER (ORDER BY count(*) DESC, lower(p_type)) AS place FROM part WHERE lower(p_type) LIKE '%steel%' GROUP BY 1")
def _(t):
    return grouping.counted_values(t("part"), "p_type", "p_partkey", "count", "STEEL")


# filters


@_query("F1_search", f"SELECT doc_id FROM documents WHERE ({_folded('text')} LIKE '%license%' OR {_folded('source')} LIKE '%license%') AND ({_folded('text')} LIKE '%released under%' OR {_folded('source')} LIKE '%released under%')")
def _(t):
    return filters.select_rows(t("documents"), [filters.search(["text", "source"], 'licénse "released under"')]).select("doc_id")


@_query("F2_contains", f"SELECT doc_id, {_folded('text')} LIKE '%metion%' AS ascii_hit, {_folded('text')} LIKE '%strasse%' AS sharp_hit FROM documents WHERE {_folded('text')} LIKE '%ere%'")
def _(t):
    return filters.select_rows(t("documents"), [filters.column_test("text", "éré")]).select("doc_id", filters.column_test("text", "metion").alias("ascii_hit"), filters.column_test("text", "straße").alias("sharp_hit"))


@_query("F3_equals", "SELECT c_custkey FROM customer WHERE lower(trim(c_mktsegment)) = 'building'")
def _(t):
    return filters.select_rows(t("customer"), [filters.column_test("c_mktsegment", "= Building ")]).select("c_custkey")


@_query("F4_not_equals", "SELECT c_custkey FROM customer WHERE lower(trim(c_mktsegment)) <> 'building'")
def _(t):
    return filters.select_rows(t("customer"), [filters.column_test("c_mktsegment", "!=building")]).select("c_custkey")


@_query("F5_not_containing", "SELECT p_partkey FROM part WHERE lower(p_type) NOT LIKE '%steel%'")
def _(t):
    return filters.select_rows(t("part"), [filters.column_test("p_type", "!STEEL")]).select("p_partkey")


@_query("F6_compare", "SELECT o_orderkey FROM orders WHERE o_totalprice > 250000.5 AND strftime(o_orderdate, '%Y%m%d') < '19990401'")
def _(t):
    o = t("orders").withColumn("d", F.col("o_orderdate").cast("date"))
    return filters.keep_where(o, {"o_totalprice": ">250 000,5", "d": "<01/04/1999"}).select("o_orderkey")


@_query("F6_compare_text", "SELECT o_orderkey FROM orders WHERE o_totalprice > 250000.5 AND strftime(o_orderdate, '%Y%m%d') < '19990401'")
def _(t):
    o = t("orders").select("o_orderkey", F.date_format("o_orderdate", "d/M/yyyy").alias("d"), F.concat(F.format_number("o_totalprice", 2), F.lit(" €")).alias("p"))
    return filters.keep_where(o, {"p": ">250 000,5", "d": "<1999-04-01"}).select("o_orderkey")


@_query("F7_regex", "SELECT c_custkey FROM customer WHERE regexp_matches(c_name, '(?i)customer#0+[0-9]*7$')")
def _(t):
    return filters.select_rows(t("customer"), [filters.regex_test("c_name", "customer#0+[0-9]*7$")]).select("c_custkey")


@_query("F8_match_case", "SELECT doc_id FROM documents WHERE contains(text, 'License')")
def _(t):
    return filters.select_rows(t("documents"), [filters.column_test("text", "License", match_case=True)]).select("doc_id")


@_query("F9_invert", "SELECT event_id FROM events WHERE event_type <> 'click' AND NOT (value > 50)")
def _(t):
    return filters.select_rows(t("events"), [filters.column_test("value", ">50")], [filters.hide_values("event_type", ["click"])], invert=True).select("event_id")


@_query("F11_keep_values", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P')")
def _(t):
    return filters.select_rows(t("orders"), values=[filters.keep_values("o_orderstatus", ["F", "P"])]).select("o_orderkey")


@_query("F12_keep_range", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_quantity BETWEEN 10 AND 12")
def _(t):
    return filters.select_rows(t("lineitem"), values=[filters.keep_range("l_quantity", 10, 12, "double")]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@_query("F17_find", "SELECT 'text' AS column_name, count(*) FILTER (WHERE lower(text) LIKE '%license%') AS matches FROM documents UNION ALL SELECT 'source', count(*) FILTER (WHERE source LIKE '%license%') FROM documents")
def _(t):
    return filters.count_matches(t("documents"), ["text", "source"], "license")


@_query("F18_closest", "SELECT arg_min(o_orderkey, (abs(o_totalprice - 123456), o_orderkey)) AS o_orderkey FROM orders")
def _(t):
    return filters.closest(t("orders"), "o_totalprice", "o_orderkey", 123456)


# order


@_query("O2_sort_numbers", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS row FROM orders")
def _(t):
    o = t("orders")
    return number_rows(o.select("o_orderkey", "o_totalprice"), [(number("o_totalprice"), True), F.col("o_orderkey")]).select("o_orderkey", "row")


@_query("O3_sort_text", "SELECT c_custkey, row_number() OVER (ORDER BY lower(c_mktsegment), cast(regexp_extract(c_name, '([0-9]+)$', 1) AS BIGINT), c_custkey) AS row FROM customer")
def _(t):
    return number_rows(t("customer").select("c_custkey", "c_mktsegment", "c_name"), [sort_key("c_mktsegment"), sort_key("c_name"), F.col("c_custkey")]).select("c_custkey", "row")


# joins and sets


@_query("J1_look_up", "SELECT o_orderkey, n_name, r_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def _(t):
    nations = joining.look_up(t("nation"), "n_regionkey", t("region"), "r_regionkey", ["r_name"], "r_regionkey")
    customers = joining.look_up(t("customer"), "c_nationkey", nations, "n_nationkey", ["n_name", "r_name"], "n_nationkey")
    return joining.look_up(t("orders"), "o_custkey", customers, "c_custkey", ["n_name", "r_name"], "c_custkey").select("o_orderkey", "n_name", "r_name")


@_query("J2_look_up_report", "SELECT (SELECT count(*) FROM documents d WHERE doc_id IN (SELECT doc_id FROM labels)) AS hits, (SELECT count(*) FROM documents d WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS misses, 0::BIGINT AS empty_keys, 0::BIGINT AS repeated_keys")
def _(t):
    return joining.look_up_report(t("documents"), "doc_id", t("labels"), "doc_id", "doc_id")


@_query("J4_compare", """
    WITH a AS (SELECT * FROM orders WHERE o_orderkey % 3 <> 0), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 4 <> 0)
    SELECT cast(coalesce(a.o_orderkey, b.o_orderkey) AS VARCHAR) AS o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'only here' WHEN a.o_orderkey IS NULL THEN 'only there' WHEN a.o_orderstatus = b.o_orderstatus THEN 'same' ELSE 'changed' END AS status,
           CASE WHEN a.o_orderstatus <> b.o_orderstatus THEN 'o_orderstatus' ELSE '' END AS changed
    FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey""")
def _(t):
    a, b = t("orders").where("o_orderkey % 3 <> 0"), t("orders").where("o_orderkey % 4 <> 0").withColumn("o_orderstatus", F.expr("if(o_orderkey % 5 = 0, 'X', o_orderstatus)"))
    return joining.compare(a, b, "o_orderkey", ["o_orderstatus", "o_orderpriority"], "o_orderkey", "o_orderkey")


@_query("J4_report", """
    WITH a AS (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 3 <> 0), b AS (SELECT * FROM a WHERE o_orderkey % 4 <> 0)
    SELECT (SELECT count(*) FROM b) AS same, 0::BIGINT AS changed, (SELECT count(*) FROM a) - (SELECT count(*) FROM b) AS only_here, 0::BIGINT AS only_there, 0::BIGINT AS no_key_here, 0::BIGINT AS dup_here, (SELECT count(*) FROM orders WHERE o_orderkey % 5 = 0) AS no_key_there, (SELECT count(*) FROM b) AS dup_there""")
def _(t):
    a = t("orders").where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").cast("string").alias("k"), "o_orderstatus", "o_orderkey")
    b = a.where("o_orderkey % 4 <> 0")
    b = b.union(b).union(t("orders").where("o_orderkey % 5 = 0").selectExpr("'  '", "o_orderstatus", "o_orderkey"))
    return joining.compare_report(a, b, "k", ["o_orderstatus"], "o_orderkey", "o_orderkey")


@_query("J6_rows_to_append", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 4 <> 0")
def _(t):
    return joining.rows_to_append(t("orders").where("o_orderkey % 3 <> 0").select("o_orderkey", "o_orderstatus"), t("orders").where("o_orderkey % 4 <> 0"), "o_orderkey")


@_query("U1_combine", """
    SELECT cast(c_custkey AS VARCHAR) AS key, c_name AS name, cast(c_nationkey AS VARCHAR) AS nation, '' AS extra, 'customer' AS file FROM customer
    UNION ALL SELECT cast(s_suppkey AS VARCHAR), s_name, '', cast(s_nationkey AS VARCHAR), 'supplier' FROM supplier""")
def _(t):
    a = t("customer").selectExpr("c_custkey AS key", "c_name AS name", "c_nationkey AS nation")
    b = t("supplier").selectExpr("s_name AS ` Name`", "s_suppkey AS KEY", "s_nationkey AS extra")
    return joining.combine({"customer": a, "supplier": b}, source="file")


@_query("U2_split_plan", """
    WITH v AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_mktsegment || '/a' WHEN 1 THEN c_mktsegment || ':A' WHEN 2 THEN '' ELSE lower(c_mktsegment) END AS v FROM customer),
    g AS (SELECT min_by(v, c_custkey) AS value, count(*) AS n, min(c_custkey) AS first_row FROM v GROUP BY lower(v)),
    c AS (SELECT *, CASE WHEN value = '' THEN 'empty' ELSE replace(replace(value, '/', '_'), ':', '_') END AS clean FROM g),
    k AS (SELECT *, row_number() OVER (PARTITION BY lower(clean) ORDER BY first_row) AS place FROM c)
    SELECT value, clean || CASE WHEN place > 1 THEN ' (' || place || ')' ELSE '' END AS file_name, n, first_row FROM k""")
def _(t):
    v = F.when(F.col("c_custkey") % 4 == 0, F.concat("c_mktsegment", F.lit("/a"))).when(F.col("c_custkey") % 4 == 1, F.concat("c_mktsegment", F.lit(":A"))).when(F.col("c_custkey") % 4 == 2, "").otherwise(F.lower("c_mktsegment"))
    return joining.split_plan(t("customer").select("c_custkey", v.alias("v")), "v", "c_custkey")


# reading cells and computed columns


@_query("X1_lenient_numbers", """
    SELECT o_orderkey, o_totalprice AS plain, o_totalprice AS euros, -floor(o_totalprice) AS bracketed, o_totalprice AS grouped FROM orders""")
def _(t):
    s = F.format_string("%.2f", "o_totalprice")
    o = t("orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("a"), F.concat(F.translate(s, ".", ","), F.lit(" €")).alias("b"), F.concat(F.lit("("), F.floor("o_totalprice").cast("string"), F.lit(")")).alias("c"), F.format_number("o_totalprice", 2).alias("d"))
    return o.select("o_orderkey", number("a").alias("plain"), number("b").alias("euros"), number("c").alias("bracketed"), number("d").alias("grouped"))


@_query("X2_lenient_dates", "SELECT o_orderkey, cast(strftime(o_orderdate, '%Y%m%d000000') AS BIGINT) AS iso, cast(strftime(o_orderdate, '%Y%m%d143000') AS BIGINT) AS day_first FROM orders")
def _(t):
    o = t("orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("a"), F.concat(F.date_format("o_orderdate", "d/M/yyyy"), F.lit(" 14:30")).alias("b"))
    return o.select("o_orderkey", date_key("a").alias("iso"), date_key("b").alias("day_first"))


@_query("X3_fold_and_slug", f"SELECT doc_id, md5({_folded('text')}) AS folded, md5(trim(regexp_replace({_folded('text')}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))) AS slugged FROM documents")
def _(t):
    return t("documents").select("doc_id", F.md5(fold("text").cast("binary")).alias("folded"), F.md5(slug("text").cast("binary")).alias("slugged"))


@_query("X4_cell_text", "SELECT c_custkey, regexp_replace(cast(c_acctbal AS VARCHAR), '\\.0$', '') AS balance, cast(c_nationkey AS VARCHAR) AS nation FROM customer")
def _(t):
    return t("customer").select("c_custkey", cell_text("c_acctbal", "double").alias("balance"), cell_text("c_nationkey", "int").alias("nation"))


@_query("H1_text_helpers", """
    SELECT c_custkey, regexp_replace(c_name, '[^0-9]', '', 'g') AS digits, left(c_name, 8) AS head, right(c_name, 3) AS tail, substr(c_name, 4, 5) AS middle, split_part(c_name, '#', 2) AS second, lpad(cast(c_nationkey AS VARCHAR), 4, '0') AS padded, upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) AS capital, c_name || '/' || c_mktsegment AS joined
    FROM customer""")
def _(t):
    c = t("customer")
    return c.select("c_custkey", fx.digits("c_name").alias("digits"), fx.left("c_name", 8).alias("head"), fx.right("c_name", 3).alias("tail"), fx.mid("c_name", 4, 5).alias("middle"), fx.part("c_name", "#", 2).alias("second"), fx.pad("c_nationkey", 4).alias("padded"), fx.capitalize("c_mktsegment").alias("capital"), fx.join_filled("/", "c_name", F.lit(""), "c_mktsegment").alias("joined"))


@_query("H2_number_helpers", "SELECT o_orderkey, floor(o_totalprice / 7 + 0.5) AS rounded, floor(-o_totalprice / 7 + 0.5) AS rounded_negative, o_totalprice AS read, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'middle' ELSE 'low' END AS class FROM orders")
def _(t):
    p = F.col("o_totalprice")
    return t("orders").select("o_orderkey", fx.half_up(p / 7).cast("double").alias("rounded"), fx.half_up(-p / 7).cast("double").alias("rounded_negative"), fx.num(F.concat(F.format_string("%.2f", p), F.lit(" kg"))).alias("read"), fx.ifs(p > 200000, "high", p > 100000, "middle", "low").alias("class"))


@_query("H3_date_helpers", """
    WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS a, DATE '1998-02-28' AS b FROM orders),
    m AS (SELECT *, least(a, b) AS x, greatest(a, b) AS y FROM o),
    n AS (SELECT *, (year(y) - year(x)) * 12 + month(y) - month(x) - (CASE WHEN day(y) < day(x) THEN 1 ELSE 0 END) AS k FROM m)
    SELECT o_orderkey, cast(CASE WHEN b >= a THEN k ELSE -k END AS INT) AS months, cast(CASE WHEN b >= a THEN k // 12 ELSE -(k // 12) END AS BIGINT) AS years, cast(b - a AS INT) AS days, cast(isodow(a) AS INT) AS weekday, cast(week(a) AS INT) AS week, cast(cast(a + INTERVAL 1 MONTH AS DATE) AS VARCHAR) AS next_month FROM n""")
def _(t):
    a, b = F.col("o_orderdate").cast("date"), F.lit("1998-02-28").cast("date")
    return t("orders").select("o_orderkey", fx.months(a, b).alias("months"), fx.years(a, b).alias("years"), fx.days(a, b).alias("days"), fx.weekday(a).alias("weekday"), fx.week(a).alias("week"), fx.add_months(a, 1).cast("string").alias("next_month"))


@_query("H4_similarity", "SELECT p_partkey, CASE WHEN p_name = p_type THEN 1.0 ELSE round(1 - levenshtein(p_name, p_type) / greatest(length(p_name), length(p_type)), 6) END AS alike FROM part")
def _(t):
    return t("part").select("p_partkey", F.round(fx.similarity("p_name", "p_type"), 6).alias("alike"))


@_query("H5_hashes", "SELECT c_custkey, md5(c_name) AS md5, sha1(c_name) AS sha1, sha256(c_name) AS sha256 FROM customer")
def _(t):
    return t("customer").select("c_custkey", F.md5("c_name").alias("md5"), F.sha1("c_name").alias("sha1"), F.sha2("c_name", 256).alias("sha256"))


@_query("H6_tests_and_formats", """
    SELECT o_orderkey, o_orderkey % 3 <> 0 AS number, true AS day, false AS other_day, strftime(o_orderdate, '%-d.%-m.%y') AS short, printf('%.1f', o_totalprice::DECIMAL(18,2)::DECIMAL(18,1)) AS fixed,
           CASE o_orderstatus WHEN 'F' THEN 'full' WHEN 'O' THEN 'open' ELSE 'else' END AS status, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey ELSE 0 END + o_custkey + 1.5 AS total,
           least(CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey END, o_custkey, 1.5)::DOUBLE AS least, greatest(CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey END, o_custkey, 1.5)::DOUBLE AS most, o_orderkey % 2 = 0 AS empty, 2 AS words, reverse(o_orderpriority) AS backwards
    FROM orders""")
def _(t):
    o = t("orders").selectExpr("*", "if(o_orderkey % 3 <> 0, cast(o_orderkey AS string), 'none') AS k", "date_format(o_orderdate, 'dd/MM/yyyy') AS d", "if(o_orderkey % 2 = 0, '  ', 'x') AS blank", "'1,5' AS x", "cast(cast(o_totalprice AS decimal(18,2)) AS string) AS p", "concat(' ', o_orderstatus, '  b ') AS two")
    return o.select("o_orderkey", fx.is_number("k").alias("number"), fx.is_date("d").alias("day"), fx.is_date("k").alias("other_day"), fx.fmt_date("d", "D.M.YY").alias("short"), fx.fixed("p", 1).alias("fixed"), fx.cases("o_orderstatus", "f", "full", "O", "open", "else").alias("status"), fx.sum_of("k", "o_custkey", "x").alias("total"), fx.min_of("k", "o_custkey", "x").alias("least"), fx.max_of("k", "o_custkey", "x").alias("most"), fx.is_empty("blank").alias("empty"), fx.word_count("two").alias("words"), fx.reverse("o_orderpriority").alias("backwards"))


# edits


@_query("T1_replace", "SELECT p_partkey, replace(p_brand, 'Brand', 'Mark') AS literal, regexp_replace(p_brand, '^(\\w+)#(\\d+)$', '\\2-\\1') AS pattern FROM part")
def _(t):
    return t("part").select("p_partkey", edits.replace_all("p_brand", "Brand", "Mark").alias("literal"), edits.replace_all("p_brand", r"^(\w+)#(\d+)$", "$2-$1", regex=True).alias("pattern"))


@_query("T2_bulk", "SELECT c_custkey, upper(c_name) AS up, lower(c_name) AS low, '' AS cleared, 'x' AS filled FROM customer")
def _(t):
    return t("customer").select("c_custkey", edits.bulk("c_name", "upper").alias("up"), edits.bulk("c_name", "lower").alias("low"), edits.bulk("c_name", "clear").alias("cleared"), edits.bulk("c_name", "set", "x").alias("filled"))


@_query("T3_clean", "SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '[\\r\\n\\t]+', ' ', 'g'), ' {2,}', ' ', 'g'))) AS cleaned FROM documents")
def _(t):
    return t("documents").select("doc_id", F.md5(edits.clean("text").cast("binary")).alias("cleaned"))


@_query("T3_clean_up", "SELECT doc_id, trim(source) AS source, md5(trim(regexp_replace(regexp_replace(text, '[\\r\\n\\t]+', ' ', 'g'), ' {2,}', ' ', 'g'))) AS text FROM documents WHERE trim(source) <> '' OR trim(regexp_replace(text, '[\\r\\n\\t]+', ' ', 'g')) <> ''")
def _(t):
    d = t("documents").select("doc_id", F.concat(F.lit(" \u200b"), "source", F.lit("\u00a0")).alias("source"), "text", F.lit(" ").alias("blank"))
    out = edits.clean_up(d, ["source", "text"], ("invisible", "hard_spaces", "breaks", "spaces", "trim"), empty_rows=True, empty_columns=True)
    return out.withColumn("text", F.md5(F.col("text").cast("binary")))


@_query("T5_convert_dates", "SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS dmy, strftime(o_orderdate, '%d.%m.%Y') AS dotted FROM orders")
def _(t):
    o = t("orders").withColumn("d", F.date_format("o_orderdate", "yyyy-M-d"))
    return o.select("o_orderkey", edits.convert_date("d", "dmy").alias("dmy"), edits.convert_date("d", "dmy_dot").alias("dotted"))


@_query("T7_convert_phones", "SELECT c_custkey, '+331' || lpad(cast(c_custkey AS VARCHAR), 8, '0') AS e164, '01' || lpad(cast(c_custkey AS VARCHAR), 8, '0') AS national FROM customer")
def _(t):
    n = F.lpad(F.col("c_custkey").cast("string"), 8, "0")
    c = t("customer").withColumn("p", F.concat_ws(" ", F.lit("01"), *[n.substr(k, 2) for k in (1, 3, 5, 7)]))
    return c.select("c_custkey", edits.convert_phone("p").alias("e164"), edits.convert_phone("p", "national").alias("national"))


@_query("T10_split_column", "SELECT p_partkey, split_part(p_name, ' ', 1) AS p_name_1, split_part(p_name, ' ', 2) AS p_name_2 FROM part")
def _(t):
    return edits.split_column(t("part").select("p_partkey", "p_name"), "p_name", " ", 2).select("p_partkey", "p_name_1", "p_name_2")


@_query("T11_merge_columns", "SELECT p_partkey, p_brand || ' / ' || p_type AS merged FROM part")
def _(t):
    return edits.merge_columns(t("part"), ["p_brand", "p_type"], "merged", " / ").select("p_partkey", "merged")


_SPARSE = "CASE WHEN event_id % 7 = 3 THEN event_type ELSE '' END"


@_query("T12_fill_down", f"SELECT event_id, coalesce(last_value(nullif({_SPARSE}, '') IGNORE NULLS) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING), '') AS filled FROM events")
def _(t):
    return edits.fill_down(t("events").select("event_id", F.expr(_SPARSE).alias("kind")), "kind", "event_id").select("event_id", "filled")


@_query("T16_noise_words", "SELECT c_custkey, trim(regexp_replace(regexp_replace(c_mktsegment || ' SA Ltd', '(?i)(^| )(sa|ltd)\\b', '\\1', 'g'), ' {2,}', ' ', 'g')) AS tidy FROM customer")
def _(t):
    return t("customer").withColumn("x", F.concat("c_mktsegment", F.lit(" SA Ltd"))).select("c_custkey", edits.without_words("x").alias("tidy"))


@_query("T16_small_words", "SELECT c_custkey, 'societe ' || lower(c_mktsegment) || ' eau, marche' AS tidy FROM customer")
def _(t):
    c = t("customer").select("c_custkey", F.concat(F.lit("La societe de l’"), F.lower("c_mktsegment"), F.lit(" DÉ l'eau, aux marche")).alias("x"))
    return c.select("c_custkey", edits.without_words("x", edits.NOISE["french small words"]).alias("tidy"))


@_query("T17_pseudonyms", "SELECT c_custkey, left(sha256('key' || c_name), 12) AS code FROM customer")
def _(t):
    return t("customer").select("c_custkey", edits.pseudonym("c_name", "key").alias("code"))


# duplicates


@_query("D4_exact_rows", "SELECT doc_id, min(doc_id) OVER (PARTITION BY text, lang) AS group_id, count(*) OVER (PARTITION BY text, lang) AS n FROM documents QUALIFY n > 1")
def _(t):
    return duplicates.whole_rows(t("documents"), ["text", "lang"], "doc_id")


@_query("D3_chained_keys", None)
def _(t):
    c = t("customer").select("c_custkey", F.expr("concat('a', c_custkey div 4)").alias("a"), F.expr("if(c_custkey % 9 = 0, concat('b', c_custkey div 60), '')").alias("b"))
    return duplicates.by_keys(c, [["a"], ["b"]], "c_custkey")


ORACLE_SQL["D3_chained_keys"] = """
    WITH RECURSIVE c AS (SELECT c_custkey AS id, c_custkey // 4 AS a, CASE WHEN c_custkey % 9 = 0 THEN c_custkey // 60 END AS b FROM customer),
    e AS (SELECT DISTINCT x.id, y.id AS near FROM c x JOIN c y ON x.a = y.a OR x.b = y.b),
    r(id, near) AS (SELECT id, near FROM e UNION SELECT r.id, e.near FROM r JOIN e ON r.near = e.id)
    SELECT id AS c_custkey, min(near) AS group_id FROM r GROUP BY id HAVING count(*) > 1"""


@_query("D9_rows_to_delete", "SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS group_id FROM documents QUALIFY doc_id <> group_id")
def _(t):
    return duplicates.to_delete(duplicates.whole_rows(t("documents"), ["text"], "doc_id"), "doc_id")


@_query("D10_merged_rows", "SELECT min(doc_id) AS group_id, arg_min(source, doc_id) AS source, CASE WHEN count(DISTINCT source) > 1 THEN 'source' ELSE '' END AS differing FROM documents GROUP BY text HAVING count(*) > 1")
def _(t):
    d = t("documents")
    return duplicates.merged(d, duplicates.whole_rows(d, ["text"], "doc_id"), ["source"], "doc_id")


# findings and schemas


@_query("I1_column_findings", " UNION ALL ".join(f"""
    SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) FILTER (WHERE coalesce(trim(v), '') = '') AS empty, count(*) FILTER (WHERE v <> trim(v)) AS stray_spaces, count(v) = count(*) AND min(v) = max(v) AS constant, count(*) FILTER (WHERE try_cast(v AS DOUBLE) < 0) AS negatives
    FROM (SELECT {c}::VARCHAR AS v FROM customer)""" for c in ("c_acctbal", "c_mktsegment")))  # fmt: skip
def _(t):
    return quality.column_findings(t("customer"), ["c_acctbal", "c_mktsegment"])


@_query("I3_near_keys", "SELECT 'doc_id' AS column_name, count(DISTINCT doc_id) AS distinct_values, count(*) - count(DISTINCT doc_id) AS repeated_rows, true AS is_key FROM documents UNION ALL SELECT 'n_chars', count(DISTINCT n_chars), count(*) - count(DISTINCT n_chars), false FROM documents")
def _(t):
    return quality.near_key(t("documents"), ["doc_id", "n_chars"])


@_query("I4_shapes", "WITH s AS (SELECT 'Aa#' || regexp_replace(split_part(c_name, '#', 2), '[0-9]', '9', 'g') AS shape FROM customer) SELECT shape, count(*) AS n, round(count(*) / (SELECT count(*) FROM customer), 6) AS share, round(count(*) / (SELECT count(*) FROM customer), 6) >= 0.85 AS usual FROM s GROUP BY 1")
def _(t):
    return quality.odd_shapes(t("customer"), "c_name")


@_query("I8_ratio", "SELECT count(*) AS both, count(*) FILTER (WHERE abs(l_extendedprice - l_quantity * 1000) <= 0.5e-2 + 1e-9) AS agree FROM lineitem")
def _(t):
    return quality.ratio_of(t("lineitem"), "l_quantity", "l_extendedprice", 1000, 2)


@_query("I9_decided_by", """
    WITH c AS (SELECT p_brand AS a, cast(p_size AS VARCHAR) AS b, count(*) AS n FROM part GROUP BY ALL), u AS (SELECT a, arg_min(b, (-n, b)) AS usual FROM c GROUP BY a)
    SELECT a, usual, b AS value, n FROM c JOIN u USING (a) WHERE b <> usual""")
def _(t):
    return quality.decided_by(t("part"), "p_brand", "p_size")


@_query("V1_infer", " UNION ALL ".join(f"""
    SELECT '{c}' AS column_name, CASE WHEN bool_and(regexp_full_match(v, '[+-]?[0-9]+')) THEN 'integer' WHEN bool_and(regexp_full_match(v, '[+-]?[0-9]+[.,]?[0-9]*')) THEN 'number' WHEN bool_and(try_cast(v AS DATE) IS NOT NULL) THEN 'date' ELSE 'string' END AS type,
           count(v) = count(*) AS required, count(DISTINCT v) = count(v) AND count(v) > 1 AND bool_and(NOT contains(v, ' ')) AS is_unique, coalesce(bool_and(try_cast(v AS DOUBLE) IS NOT NULL) AND min(try_cast(v AS DOUBLE)) >= 0, false) AS minimum_zero
    FROM (SELECT {c}::VARCHAR AS v FROM customer)""" for c in ("c_custkey", "c_name", "c_acctbal")))  # fmt: skip
def _(t):
    return quality.infer(t("customer"), ["c_custkey", "c_name", "c_acctbal"])


@_query("V2_validate", """
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS k2 FROM customer)
    SELECT 'c_acctbal' AS field, 'minimum' AS rule, count(*) AS n, min(c_custkey) AS first_row FROM customer WHERE c_acctbal < 0 HAVING count(*) > 0
    UNION ALL SELECT 'c_name', 'type', count(*), min(c_custkey) FROM customer WHERE NOT regexp_full_match(c_name, '[0-9]+')
    UNION ALL SELECT 'c_mktsegment', 'enum', count(*), min(c_custkey) FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY') HAVING count(*) > 0
    UNION ALL SELECT 'c_mktsegment', 'max_length', count(*), min(c_custkey) FROM customer WHERE length(c_mktsegment) > 9 HAVING count(*) > 0
    UNION ALL SELECT 'c_nationkey', 'unique', count(*), min(c_custkey) FROM r WHERE k > 1 HAVING count(*) > 0
    UNION ALL SELECT 'c_nationkey + c_mktsegment', 'primaryKey', count(*), min(c_custkey) FROM r WHERE k2 > 1 HAVING count(*) > 0
    UNION ALL SELECT column_name, 'unexpected', 1, NULL FROM (DESCRIBE customer) WHERE column_name NOT IN ('c_acctbal', 'c_name', 'c_mktsegment', 'c_nationkey', 'c_custkey')
    UNION ALL SELECT 'c_phone', 'missing', 1, NULL
    UNION ALL SELECT c, 'order', 1, NULL FROM (SELECT unnest(['c_acctbal', 'c_name', 'c_mktsegment', 'c_nationkey']) AS c, unnest((SELECT list(column_name ORDER BY column_index) FROM duckdb_columns() WHERE table_name = 'customer' AND column_name IN ('c_acctbal', 'c_name', 'c_mktsegment', 'c_nationkey'))) AS d) WHERE c <> d""")
def _(t):
    rules = [quality.Field("c_acctbal", "number", minimum=0), quality.Field("c_name", "integer"), quality.Field("c_mktsegment", enum=("BUILDING", "MACHINERY"), max_length=9), quality.Field("c_nationkey", "integer", required=True, unique=True), quality.Field("c_phone", required=True)]
    return quality.validate(t("customer"), rules, "c_custkey", primary_key=["c_nationkey", "c_mktsegment"], structure=True)


# rows, versions, checks


@_query("F15_keep_rows", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def _(t):
    return filters.keep_rows(t("documents").select("doc_id"), "doc_id", t("labels"))


@_query("U3_without_rows", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(t):
    return filters.without_rows(t("documents").select("doc_id"), "doc_id", t("labels"))


@_query("F19_irregular_rows", r"""
    WITH b AS (SELECT doc_id, regexp_replace(replace(text, '""', ''), '(^|\|)"[^"]*("|\z)', '\1', 'g') AS bare FROM documents), f AS (SELECT doc_id, length(bare) - length(replace(bare, '|', '')) + 1 AS fields FROM b)
    SELECT doc_id, fields FROM f WHERE fields <> 1
    UNION ALL SELECT -1 - p_partkey, 3 FROM part""")
def _(t):
    lines = t("documents").select("doc_id", "text").union(t("part").selectExpr("-1 - p_partkey", """concat('"', p_name, '|""x|"|', p_type, '|"open | to the end')"""))
    return filters.irregular(lines, "text", "|", 1).select("doc_id", F.col("fields").cast("long").alias("fields"))


@_query("G11_pivot_order", "SELECT o_orderpriority AS row_label, cast(count(*) AS DOUBLE) AS value, row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) AS place FROM orders GROUP BY 1")
def _(t):
    return grouping.pivot_order(grouping.pivot_cells(t("orders"), F.col("o_orderpriority"), F.col("o_orderstatus"), "count"), "total", descending=True)


@_query("J7_review", "SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'deleted' ELSE 'changed' END AS status, CASE WHEN c_custkey % 10 = 0 THEN '' ELSE 'c_name' END AS changed FROM customer WHERE c_custkey % 10 = 0 OR c_custkey % 7 = 0")
def _(t):
    after = t("customer").where("c_custkey % 10 <> 0").withColumn("c_name", F.expr("if(c_custkey % 7 = 0, upper(c_name) || '!', c_name)"))
    return joining.review(t("customer"), after, "c_custkey", ["c_name", "c_mktsegment"])


_LETTERS = [x for x in "àâäçèéêëîïñôöùûüßÀÂÄÇÈÉÊËÎÏÑÔÖÙÛÜ’“”–—…€" if len(x.encode().decode("cp1252", errors="ignore")) == len(x.encode())]
_SPOILT = "text"
for _x in _LETTERS[:20]:
    _SPOILT = f"replace({_SPOILT}, '{_x}', '{_x.encode().decode('cp1252')}')"
_MENDED = "spoilt"
for _x in _LETTERS:
    _MENDED = f"replace({_MENDED}, '{_x.encode().decode('cp1252')}', '{_x}')"


@_query("T4_repair", f"WITH s AS (SELECT doc_id, text, {_SPOILT} AS spoilt FROM documents) SELECT doc_id, md5({_MENDED}) AS repaired FROM s")
def _(t):
    spoilt = F.col("text")
    for x in _LETTERS[:20]:
        spoilt = F.replace(spoilt, F.lit(x), F.lit(x.encode().decode("cp1252")))
    return t("documents").select("doc_id", F.md5(edits.repaired(spoilt).cast("binary")).alias("repaired"))


@_query("T9_unrecognised", "SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0")
def _(t):
    c = t("customer").withColumn("x", F.expr("if(c_custkey % 3 = 0, c_name, cast(c_acctbal AS string))"))
    return edits.unrecognised(c, "x", number("x")).select("c_custkey")


@_query("T13_series", "SELECT c_custkey, cast(cast(DATE '2024-01-31' + to_months(cast(c_custkey AS INT)) AS DATE) AS VARCHAR) AS month_end, cast(DATE '2024-01-31' + cast(7 * c_custkey AS INT) AS VARCHAR) AS weekly, 1.5 + c_custkey * 0.25 AS number FROM customer")
def _(t):
    c = t("customer").select("c_custkey", (F.col("c_custkey") + 1).alias("row"))
    return c.select("c_custkey", day_text(edits.date_series("row", "2024-01-31", 1, "month")).alias("month_end"), day_text(edits.date_series("row", "2024-01-31", 7)).alias("weekly"), edits.number_series("row", 1.5, 0.25, 2).alias("number"))


@_query("D1_cleanings", """
    SELECT c_custkey, CASE WHEN c_custkey > 0 THEN '+331' || lpad(cast(c_custkey AS VARCHAR), 8, '0') ELSE '' END AS phone, 'ab' || c_custkey || '@gmail.com' AS mail, '01' || lpad(cast(c_custkey AS VARCHAR), 8, '0') AS digits FROM customer""")
def _(t):
    n = F.lpad(F.col("c_custkey").cast("string"), 8, "0")
    c = t("customer").select("c_custkey", F.concat(F.lit("01."), n).alias("p"), F.concat(F.lit("A.b"), F.col("c_custkey").cast("string"), F.lit("+x@GoogleMail.com")).alias("m"))
    return c.select("c_custkey", match_key("p", "phone").alias("phone"), match_key("m", "mail").alias("mail"), match_key("p", "digits").alias("digits"))


@_query("I5_far_values", """
    WITH x AS (SELECT event_id, CASE WHEN event_id % 500 = 0 THEN value * 1000 + 5000 ELSE value END AS value FROM events), q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM x)
    SELECT event_id, value FROM x, q WHERE value < a - 3 * (b - a) OR value > b + 3 * (b - a)""")
def _(t):
    return quality.far_values(t("events").withColumn("value", F.expr("if(event_id % 500 = 0, value * 1000 + 5000, value)")), "value", "event_id")


@_query("V4_text_checks", "SELECT 'no_double_space' AS check_name, count(*) FILTER (WHERE contains(text, '  ')) AS n FROM documents UNION ALL SELECT 'capitalised', count(*) FILTER (WHERE regexp_matches(text, '^\\p{Ll}')) FROM documents")
def _(t):
    return quality.text_checks(t("documents"), "text", ["no_double_space", "capitalised"])


# duplicates by rules


@_query("D5_any_column", """
    SELECT c_custkey, c_custkey // 5 * 5 AS group_id, 2::BIGINT AS n, 85::INT AS confidence, 'phone or mobile' AS reasons
    FROM customer WHERE c_custkey % 5 < 2 AND c_custkey // 5 * 5 + 1 <= (SELECT max(c_custkey) FROM customer)""")
def _(t):
    digits = lambda add: F.lpad((F.col("c_custkey") + 1234567 + add).cast("string"), 8, "0")
    c = t("customer").select("c_custkey", F.concat(F.lit("01"), digits(0)).alias("phone"), F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("+33 (0)1."), digits(1))).alias("mobile"))
    return matching.grouped(c, [matching.any_of(["phone", "mobile"], "phone")], "c_custkey", ["phone", "mobile"])


@_query("D5_names", """
    SELECT c_custkey, c_custkey // 3 * 3 AS group_id, count(*) OVER g AS n, cast(CASE WHEN count(*) OVER g = 3 THEN 45 ELSE 60 END AS INT) AS confidence,
           'name: first + last' || CASE WHEN count(*) OVER g = 3 THEN ', initials: first + last' ELSE '' END AS reasons
    FROM customer WINDOW g AS (PARTITION BY c_custkey // 3) QUALIFY n > 1""")
def _(t):
    family = F.concat(F.lit("Dé"), F.translate(F.expr("cast(c_custkey div 3 as string)"), "0123456789", "bcdfghjklm"))
    given, turn = F.lit("Zoé"), F.col("c_custkey") % 3
    c = t("customer").select("c_custkey", F.when(turn == 0, given).when(turn == 1, F.upper(family)).otherwise("Z.").alias("first"), F.when(turn == 1, F.concat(F.lit("Mme "), given)).otherwise(family).alias("last"))
    return matching.grouped(c, [matching.names(["first", "last"]), matching.name_initials(["first", "last"])], "c_custkey", ["first", "last"])


@_query("D6_sounds", "SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_name) AS group_id, count(*) OVER (PARTITION BY p_name) AS n FROM part QUALIFY n > 1")
def _(t):
    p = t("part").select("p_partkey", F.expr("if(p_partkey % 2 = 0, p_name, replace(p_name, 'e', 'ee'))").alias("name"))
    return matching.grouped(p, [matching.sounds(["name"])], "p_partkey", ["name"]).select("p_partkey", "group_id", "n")


@_query("D7_confidence", """
    WITH c AS (SELECT c_custkey, c_custkey // 4 AS g, c_custkey % 4 AS k FROM customer WHERE c_custkey // 4 < (SELECT (max(c_custkey) + 1) // 4 FROM customer))
    SELECT c_custkey, g * 4 AS group_id, CASE WHEN g % 5 = 0 THEN 2 ELSE 4 END::BIGINT AS n, CASE WHEN g % 10 = 0 THEN 100 WHEN g % 5 = 0 THEN 99 ELSE 50 END::INT AS confidence,
           CASE WHEN g % 5 = 0 THEN 'mail, phone' ELSE 'mail, phone, code' END AS reasons FROM c WHERE g % 5 > 0 OR k < 2""")
def _(t):
    c = t("customer").withColumns({"g": F.expr("c_custkey div 4"), "k": F.expr("c_custkey % 4")})
    last = t("customer").agg(F.expr("(max(c_custkey) + 1) div 4").alias("top"))
    c = c.join(F.broadcast(last)).where("g < top")  # one row
    pair = F.col("g") % 5 == 0
    mail = F.when(F.col("k") < 2, F.concat(F.lit("m"), F.col("g"), F.lit("@x.org"))).otherwise("")
    phone = F.when(F.when(pair, F.col("k") < 2).otherwise(F.col("k").isin(1, 2)), F.concat(F.lit("01"), F.lpad((F.col("g") + 2345678).cast("string"), 8, "0"))).otherwise("")
    code = F.when(~pair & (F.col("k") > 1), F.concat(F.lit("c"), F.col("g"))).otherwise("")
    note = F.when(F.col("g") % 10 == 0, "same").otherwise(F.col("c_custkey").cast("string"))
    rules = [matching.all_of(["code"]), matching.all_of(["phone"], "phone"), matching.all_of(["mail"], "mail")]
    return matching.grouped(c.select("c_custkey", mail.alias("mail"), phone.alias("phone"), code.alias("code"), note.alias("note")), rules, "c_custkey", ["mail", "phone", "code", "note"])


# guesses from titles and values


@_query("G7_summed_columns", """
    WITH o AS (SELECT o_totalprice::VARCHAR AS price, o_orderkey::VARCHAR AS k, o_orderpriority AS p, '0' || o_orderkey || '.5' AS code, (o_custkey / 2)::VARCHAR AS half FROM orders),
    c AS (SELECT 'o_totalprice' AS column_name, true AS titled, price AS v FROM o UNION ALL SELECT 'o_orderkey', false, k FROM o UNION ALL SELECT 'o_orderpriority', false, p FROM o UNION ALL SELECT 'code', false, code FROM o UNION ALL SELECT 'half', false, half FROM o)
    SELECT column_name, bool_and(try_cast(v AS DOUBLE) IS NOT NULL) AND (bool_and(titled) OR (bool_or(regexp_matches(v, '[.][0-9]*[1-9]')) AND NOT bool_or(regexp_matches(v, '^0[0-9]') OR length(regexp_replace(v, '[^0-9]', '', 'g')) >= 9))) AS summed FROM c GROUP BY 1""")
def _(t):
    o = t("orders").selectExpr("o_totalprice", "o_orderkey", "o_orderpriority", "concat('0', o_orderkey, '.5') AS code", "o_custkey / 2 AS half").withColumnRenamed("o_totalprice", "total price")
    g = guesses.summed_columns(o, ["total price", "o_orderkey", "o_orderpriority", "code", "half"])
    return g.replace("total price", "o_totalprice", ["column_name"])


@_query("G14_category_columns", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_values, count(DISTINCT {c}) BETWEEN 2 AND 50 AS down, count(DISTINCT {c}) BETWEEN 2 AND 12 AND {'false' if c == 'o_custkey' else 'true'} AS across FROM orders"
    for c in ("o_custkey", "o_orderstatus", "o_orderpriority")))
def _(t):
    return guesses.category_columns(t("orders"), ["o_custkey", "o_orderstatus", "o_orderpriority"])


@_query("T8_reading", """
    WITH c AS (SELECT strftime(DATE '2024-01-20' + cast(c_custkey % 9 AS INT), '%m/%d/%Y') AS a, format('{:,.2f}', c_acctbal) AS b, replace(c_acctbal::VARCHAR, '.', ',') AS c, '06' || lpad(c_custkey::VARCHAR, 8, '0') AS d FROM customer)
    SELECT 'a' AS name, CASE WHEN count(*) = count(try_strptime(a, '%m/%d/%Y')) THEN 'date' ELSE 'text' END AS kind, bool_or(split_part(a, '/', 2)::INT > 12) AND NOT bool_or(split_part(a, '/', 1)::INT > 12) AS month_first, ',' AS decimal_mark FROM c
    UNION ALL SELECT 'b', CASE WHEN bool_and(try_cast(replace(b, ',', '') AS DOUBLE) IS NOT NULL) THEN 'number' ELSE 'text' END, false, CASE WHEN count(*) FILTER (WHERE regexp_matches(b, '[.][0-9]{2}$')) > count(*) FILTER (WHERE regexp_matches(b, ',[0-9]{2}$')) THEN '.' ELSE ',' END FROM c
    UNION ALL SELECT 'c', CASE WHEN bool_and(try_cast(replace(c, ',', '.') AS DOUBLE) IS NOT NULL) THEN 'number' ELSE 'text' END, false, CASE WHEN count(*) FILTER (WHERE contains(c, '.')) > count(*) FILTER (WHERE contains(c, ',')) THEN '.' ELSE ',' END FROM c
    UNION ALL SELECT 'd', CASE WHEN count(*) FILTER (WHERE regexp_full_match(d, '0[1-9][0-9]{8}')) * 2 > count(*) THEN 'phone' ELSE 'text' END, false, ',' FROM c""")
def _(t):
    c = t("customer").selectExpr("date_format(date_add(DATE '2024-01-20', cast(c_custkey % 9 AS INT)), 'MM/dd/yyyy') AS a", "format_number(c_acctbal, 2) AS b", "replace(cast(c_acctbal AS string), '.', ',') AS c", "concat('06', lpad(c_custkey, 8, '0')) AS d")
    out = None
    for x in "abcd":
        one = guesses.reading(c, x).select(F.lit(x).alias("name"), "kind", "month_first", "decimal_mark")
        out = one if out is None else out.union(one)
    return out


@_query("D11_roles", """
    WITH c AS (SELECT 'a' || c_custkey || '@x.org' AS mail, CASE WHEN c_custkey % 2 = 0 THEN '06' || lpad(c_custkey::VARCHAR, 8, '0') ELSE '?' END AS phone, 'Jean ' || lower(c_mktsegment) AS nom, c_mktsegment AS ville, lpad(c_custkey::VARCHAR, 5, '0') AS cp, c_name AS note FROM customer)
    SELECT 'E-mail' AS column_name, CASE WHEN avg(regexp_full_match(mail, '[^@ ]+@[^@ .]+[.][^@ .]+')::INT) >= 0.6 THEN 'mail' ELSE '' END AS role FROM c
    UNION ALL SELECT 'Téléphone', CASE WHEN avg(regexp_full_match(phone, '0[1-9][0-9]{8}')::INT) >= 0.4 THEN 'phone' ELSE '' END FROM c
    UNION ALL SELECT 'Nom', CASE WHEN avg((regexp_matches(nom, '[a-z]') AND NOT regexp_matches(nom, '[0-9]'))::INT) >= 0.8 THEN 'full' ELSE '' END FROM c
    UNION ALL SELECT 'Ville', CASE WHEN avg((regexp_matches(ville, '[A-Z]') AND NOT regexp_matches(ville, '[0-9]'))::INT) >= 0.8 THEN 'city' ELSE '' END FROM c
    UNION ALL SELECT 'Code postal', CASE WHEN avg(regexp_matches(cp, '[0-9]{2}')::INT) >= 0.6 THEN 'postal' ELSE '' END FROM c
    UNION ALL SELECT 'note', CASE WHEN avg(contains(note, '@')::INT) >= 0.6 THEN 'mail' WHEN avg(regexp_full_match(note, '0[1-9][0-9]{8}')::INT) >= 0.8 THEN 'phone' ELSE '' END FROM c""")
def _(t):
    c = t("customer").selectExpr("concat('a', c_custkey, '@x.org') AS `E-mail`", "if(c_custkey % 2 = 0, concat('06', lpad(c_custkey, 8, '0')), '?') AS `Téléphone`", "concat('Jean ', lower(c_mktsegment)) AS Nom", "c_mktsegment AS Ville", "lpad(c_custkey, 5, '0') AS `Code postal`", "c_name AS note")
    return guesses.roles(c, c.columns)


# conversions and series


@_query("T5_two_digit_years", """
    SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || ' 08:30' AS iso, strftime(o_orderdate, '%d.%m.%Y') AS dotted, '31/02/24' AS no_day FROM orders""")
def _(t):
    o = t("orders").selectExpr("o_orderkey", "date_format(o_orderdate, 'd/M/yy') || ' 08:30' AS a", "date_format(o_orderdate, 'M-d-yy') AS b", "'31/02/24' AS c")
    return o.select("o_orderkey", edits.convert_date("a").alias("iso"), edits.convert_date("b", "dmy_dot", month_first=True).alias("dotted"), edits.convert_date("c").alias("no_day"))


@_query("T6_convert_numbers", """
    SELECT o_orderkey, printf('%.2f', o_totalprice) AS point, replace(replace(format('{:,.2f}', o_totalprice), ',', ' '), '.', ',') || ' €' AS fr,
           format('{:,}', cast(floor(cast(o_totalprice AS DECIMAL(18,2)) + 0.5) AS BIGINT)) AS en, '0612' AS code FROM orders""")
def _(t):
    o = t("orders").selectExpr("o_orderkey", "replace(format_number(o_totalprice, 2), ',', ' ') AS a", "'0612' AS code")
    o = o.withColumn("a", F.replace("a", F.lit("."), F.lit(","))).withColumn("b", F.concat("a", F.lit(" €")))
    return o.select("o_orderkey", edits.convert_number("a").alias("point"), edits.convert_number("b", "fr").alias("fr"), edits.convert_number("a", "en", decimals=0).alias("en"), edits.convert_number("code").alias("code"))


@_query("T3_empty_rows", "SELECT d.doc_id, d.lang, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL")
def _(t):
    rows = t("documents").select("doc_id", "lang").join(t("labels").select("doc_id", "quality"), "doc_id", "left").withColumn("blank", F.lit("  "))
    return edits.without_empty_columns(edits.without_empty_rows(rows, ["quality", "blank"]))


@_query("T19_moved_rows", """
    WITH n AS (SELECT c_custkey, c_custkey + 1 AS r, CASE WHEN c_custkey % 50 = 0 THEN 'set' ELSE c_mktsegment END AS seg FROM customer),
    m AS (SELECT seg, CASE WHEN r BETWEEN 3 AND 5 THEN r + 5 WHEN r BETWEEN 6 AND 10 THEN r - 3 ELSE r END AS r FROM n)
    SELECT CASE WHEN r >= 2 THEN r + 2 ELSE r END AS row, seg AS segment FROM m UNION ALL SELECT 2, 'first new' UNION ALL SELECT 3, 'second new'""")
def _(t):
    c = t("customer").select((F.col("c_custkey") + 1).alias("row"), F.col("c_mktsegment").alias("segment"))
    patches = t("customer").where("c_custkey % 50 = 0").selectExpr("c_custkey + 1 AS row", "'segment' AS column_name", "'set' AS value")
    moved = edits.move_rows(edits.set_cells(c, "row", patches), "row", 3, 5, 11)
    new = c.sparkSession.createDataFrame([(1, "first new"), (2, "second new")], "row long, segment string")
    return edits.insert_rows(moved, "row", new, 2).select("row", "segment")


@_query("T13_series_from_seeds", """
    SELECT c_custkey, printf('%.1f', 1.5 + c_custkey * 0.5) AS numbers, lpad(cast(7 + c_custkey AS VARCHAR), greatest(3, length(cast(7 + c_custkey AS VARCHAR)))::INT, '0') AS padded,
           cast(last_day(DATE '2024-01-01' + to_months(cast(c_custkey AS INT))) AS VARCHAR) AS month_ends, 'Lot ' || (10 * (c_custkey + 1)) AS lots,
           ['Jeudi', 'Vendredi', 'Samedi', 'Dimanche', 'Lundi', 'Mardi', 'Mercredi'][c_custkey % 7 + 1] AS days, ['a', 'b'][c_custkey % 2 + 1] AS loop FROM customer""")
def _(t):
    made = {"numbers": ["1.5", "2.0"], "padded": ["007", "008"], "month_ends": ["2024-01-31", "2024-02-29"], "lots": ["Lot 10", "Lot 20"], "days": ["Jeudi"], "loop": ["a", "b"]}
    return t("customer").withColumn("row", F.col("c_custkey") + 1).select("c_custkey", *[edits.series("row", seeds).alias(k) for k, seeds in made.items()])


# charts, panels, findings between columns, typed readings


@_query("G21_column_panel", """
    SELECT 'o_totalprice' AS column_name, 'number' AS kind, count(*) AS filled, min(o_totalprice) AS low, max(o_totalprice) AS high, round(sum(o_totalprice), 2) AS sum, round(median(o_totalprice), 4) AS median FROM orders
    UNION ALL SELECT 'o_orderpriority', 'text', count(*), min(length(o_orderpriority)), max(length(o_orderpriority)), sum(length(o_orderpriority)), median(length(o_orderpriority)) FROM orders
    UNION ALL SELECT 'o_orderdate', 'date', count(*), min(d), max(d), NULL, floor(median(d)) FROM (SELECT date_diff('day', DATE '1970-01-01', cast(o_orderdate AS DATE)) AS d FROM orders)""")
def _(t):
    return grouping.panel(t("orders"), ["o_totalprice", "o_orderpriority", "o_orderdate"]).withColumns({"sum": F.round("sum", 2), "median": F.round("median", 4)})


@_query("G25_chart", """
    WITH e AS (SELECT l_quantity AS q FROM lineitem WHERE l_returnflag = 'R'), r AS (SELECT min(l_quantity) - 0.5 AS low, max(l_quantity) + 0.5 AS high FROM lineitem),
    w AS (SELECT low, CASE WHEN high - low - 1 < 40 THEN 1.0 ELSE (high - low - 1) / 28 END AS width, CASE WHEN high - low - 1 < 40 THEN low ELSE low + 0.5 END AS base, CASE WHEN high - low - 1 < 40 THEN high - low ELSE 28 END AS bins FROM r)
    SELECT cast(least(floor((q - base) / width) + 1, bins) AS INT) AS bin, count(*) AS n FROM e, w GROUP BY 1""")
def _(t):
    every = t("lineitem")
    part = every.where("l_returnflag = 'R'")
    return part.groupBy(grouping.chart_bin(part, "l_quantity", grouping.chart_edges(every, "l_quantity")).alias("bin")).agg(F.count("*").alias("n"))


@_query("F13_chart_part", """
    SELECT 'bars' AS part, count(*) AS n FROM orders WHERE o_totalprice >= 100000 AND o_totalprice < 300000
    UNION ALL SELECT 'value', count(*) FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'others', count(*) FROM orders WHERE o_orderstatus <> 'F'
    UNION ALL SELECT 'filled', count(*) FROM orders UNION ALL SELECT 'empty', 0""")
def _(t):
    o, edges = t("orders"), {"low": 0.0, "high": 400000.0, "bins": 4, "below": False, "above": True}
    parts = {"bars": grouping.keep_chart_part(o, "o_totalprice", "bars", edges, (2, 3))} | {p: grouping.keep_chart_part(o, "o_orderstatus", p, values=["F"]) for p in ("value", "others", "filled", "empty")}
    out = None
    for p, rows in parts.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(p).alias("part"), "n")
        out = one if out is None else out.union(one)
    return out


@_query("I4_written_otherwise", "SELECT c_custkey, CASE WHEN c_custkey % 30 = 7 THEN upper(c_name) ELSE c_name END AS value FROM customer WHERE c_custkey % 30 = 7")
def _(t):
    c = t("customer").select("c_custkey", F.expr("if(c_custkey % 30 = 7, upper(c_name), c_name)").alias("name"))
    return quality.written_otherwise(c, "name", "c_custkey")


@_query("I6_few_negatives", """
    SELECT 'amount' AS column_name, count(*) FILTER (WHERE l_orderkey % 500 = 3) AS negatives, count(*) FILTER (WHERE l_orderkey % 500 <> 3) AS others FROM lineitem
    HAVING negatives > 0 AND others >= 50 AND negatives <= greatest(1, 0.01 * count(*))""")
def _(t):
    return quality.few_negatives(t("lineitem").selectExpr("if(l_orderkey % 500 = 3, -l_extendedprice, l_extendedprice) AS amount", "l_tax"), ["amount", "l_tax"])


@_query("I8_hidden_ratios", "SELECT 'net' AS a, 'vat' AS b, 0.2 AS factor, count(*) AS both, count(*) FILTER (WHERE o_orderkey % 40 <> 3) AS agree FROM orders UNION ALL SELECT 'vat', 'net', 5.0, count(*), count(*) FILTER (WHERE o_orderkey % 40 <> 3) FROM orders")
def _(t):
    o = t("orders").select(F.expr("cast(o_orderkey * 5 + 5 AS int)").alias("net"), F.expr("cast(o_orderkey + 1 + if(o_orderkey % 40 = 3, 700, 0) AS int)").alias("vat"), F.col("o_custkey").alias("other"))
    return quality.hidden_ratios(o, ["net", "vat", "other"])


@_query("I8_hidden_sums", "SELECT 'net' AS a, 'vat' AS b, 'gross' AS c, count(*) FILTER (WHERE l_tax > 0) AS both, count(*) FILTER (WHERE l_tax > 0 AND l_orderkey % 40 <> 3) AS agree FROM lineitem")
def _(t):
    x = t("lineitem").select(F.expr("cast(l_extendedprice AS decimal(12,2))").alias("net"), F.expr("cast(l_tax * 100 AS decimal(12,2))").alias("vat"), "l_orderkey")
    return quality.hidden_sums(x.select("net", "vat", F.expr("net + vat + if(l_orderkey % 40 = 3, 5, 0)").alias("gross")), ["net", "vat", "gross"])


@_query("V2_composite_key", "SELECT count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS rows_repeated, 0::BIGINT AS rows_incomplete FROM lineitem")
def _(t):
    return quality.composite_key(t("lineitem"), ["l_orderkey", "l_linenumber"])


@_query("V3_typed", """
    SELECT o_orderkey, cast(cast(o_orderdate AS DATE) AS VARCHAR) AS day, o_totalprice AS price, o_orderkey % 2 = 0 AS even, o_orderkey AS whole, NULL::BIGINT AS none, CASE WHEN o_orderkey % 2 = 0 THEN 'a@b.org' END AS mail, year(o_orderdate)::INT AS year FROM orders""")
def _(t):
    o = t("orders").selectExpr("o_orderkey", "date_format(o_orderdate, 'dd/MM/yyyy') AS day", "replace(replace(format_number(o_totalprice, 2), ',', ' '), '.', ',') AS price", "if(o_orderkey % 2 = 0, 'oui', 'non') AS even", "o_orderpriority AS none", "if(o_orderkey % 2 = 0, 'a@b.org', 'a@b') AS mail", "cast(year(o_orderdate) AS string) AS year")
    return o.select("o_orderkey", quality.typed("day", "date", "dd/MM/yyyy").cast("string").alias("day"), quality.typed("price", "number", decimal_mark=",", group_mark=" ").alias("price"), quality.typed("even", "boolean", true=["oui"], false=["non"]).alias("even"), quality.typed("o_orderkey", "integer").alias("whole"), quality.typed("none", "integer").alias("none"), quality.typed("mail", "string", "email").alias("mail"), quality.typed("year", "year").alias("year"))


@_query("V5_pattern_hints", """
    SELECT '\\p{Lu}\\p{Ll}{4}#[0-9]' || CASE WHEN min(length(p_brand)) = max(length(p_brand)) THEN CASE WHEN min(length(p_brand)) > 7 THEN '{2}' ELSE '' END ELSE '{1,2}' END AS pattern, count(*) AS n FROM part""")
def _(t):
    return quality.pattern_hints(t("part"), "p_brand")


# orders and anonymity


@_query("O4_groups_together", """
    WITH o AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS g, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS own FROM documents),
    f AS (SELECT doc_id, own, min(own) OVER (PARTITION BY g) AS first FROM o)
    SELECT doc_id, row_number() OVER (ORDER BY first, own) AS place FROM f""")
def _(t):
    d = t("documents")
    return duplicates.groups_together(d.select("doc_id", "n_chars"), duplicates.whole_rows(d, ["text"], "doc_id"), [(F.col("n_chars"), True)], "doc_id").select("doc_id", "place")


@_query("O5_reordered", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS row FROM orders")
def _(t):
    return number_rows(t("orders"), [F.col("o_orderpriority"), (F.col("o_totalprice"), True), F.col("o_orderkey")]).select("o_orderkey", "row")


@_query("T17_hidden_values", """
    SELECT o_orderkey, sha256('k' || o_orderpriority)[1:12] AS code, regexp_replace(o_orderpriority, '[A-Z0-9]', '*', 'g') AS mask, year(o_orderdate)::VARCHAR AS year, sha256('ka' || o_custkey || '@x.org')[1:10] || '@x.org' AS domain,
           round(o_totalprice * (1 + 0.1 * (2 * (('0x' || sha256('k' || o_totalprice)[1:8])::BIGINT / 4294967295.0) - 1)), 2) AS noise FROM orders""")
def _(t):
    o = t("orders").select("o_orderkey", "o_orderpriority", F.col("o_orderdate").cast("date").cast("string").alias("d"), F.concat(F.lit("a"), F.col("o_custkey"), F.lit("@x.org")).alias("m"), F.regexp_replace(F.expr("cast(cast(o_totalprice AS decimal(18,2)) AS string)"), "(?<=[.][0-9])0$", "").alias("p"))
    return o.select("o_orderkey", edits.hidden("o_orderpriority", "code", "k").alias("code"), edits.hidden("o_orderpriority", "mask").alias("mask"), edits.hidden("d", "year").alias("year"), edits.hidden("m", "domain", "k").alias("domain"), edits.hidden("p", "noise", "k").cast("double").alias("noise"))


# written and read again


def _place(df: DataFrame, ending: str) -> str:
    return f"{tables_dir(df.sparkSession)}/{uuid.uuid4().hex}.{ending}"


_AWKWARD = """o_orderpriority || CASE o_orderkey % 5 WHEN 0 THEN ', "' || o_orderstatus || '"' WHEN 1 THEN ' ; |' WHEN 2 THEN ' ' ELSE '' END"""


def _awkward(t) -> DataFrame:
    return t("orders").select(F.col("o_orderkey").cast("string").alias("o_orderkey"), F.expr(_AWKWARD.replace("'\"'", "'\"'")).alias("remark"), F.expr("if(o_orderkey % 7 = 0, '', o_orderstatus)").alias("status"))


_AWKWARD_SQL = f"SELECT o_orderkey::VARCHAR AS o_orderkey, {_AWKWARD} AS remark, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE o_orderstatus END AS status FROM orders"


@_query("S1_delimited_round_trip", _AWKWARD_SQL)
def _(t):
    path = _place(t("orders"), "csv")
    writers.write_delimited(_awkward(t), path, ";")
    return readers.read_delimited(t("orders").sparkSession, path).na.fill("")


@_query("S10_json_round_trip", _AWKWARD_SQL)
def _(t):
    path = _place(t("orders"), "jsonl")
    writers.write_json(_awkward(t), path)
    return readers.read_table(t("orders").sparkSession, path).select("o_orderkey", "remark", "status")


@_query("K4_typed_round_trip", "SELECT o_orderkey, o_totalprice AS price, lpad(o_orderkey::VARCHAR, 9, '0') AS code, o_orderkey % 2 = 0 AS even FROM orders")
def _(t):
    path = _place(t("orders"), "parquet")
    o = t("orders").selectExpr("cast(o_orderkey AS string) AS o_orderkey", "cast(cast(o_totalprice AS decimal(18,2)) AS string) AS price", "lpad(o_orderkey, 9, '0') AS code", "if(o_orderkey % 2 = 0, 'yes', 'no') AS even")
    writers.write_typed_parquet(o, path)
    return readers.read_table(t("orders").sparkSession, path)


@_query("K5_html_rows", "SELECT '<tr><td>' || p_partkey || '</td><td>&lt;' || p_type || '&gt; &amp; ' || p_brand || '</td></tr>' AS line FROM part")
def _(t):
    return writers.html_rows(t("part").select("p_partkey", F.concat(F.lit("<"), "p_type", F.lit("> & "), "p_brand")))


# colours, selections, ways to hide, names that differ


@_query("G26_heat_and_bars", """
    WITH q AS (SELECT quantile_cont(c_acctbal, 0.02) AS a, quantile_cont(c_acctbal, 0.98) AS b, least(min(c_acctbal), 0) AS low, greatest(max(c_acctbal), 0) AS high FROM customer)
    SELECT c_custkey, round(least(greatest((c_acctbal - a) / (b - a), 0), 1), 6) AS heat, round(least((c_acctbal - low) / (high - low), -low / (high - low)), 6) AS bar_from, round(greatest((c_acctbal - low) / (high - low), -low / (high - low)), 6) AS bar_to FROM customer, q""")
def _(t):
    h = grouping.heat_and_bars(t("customer").select("c_custkey", "c_acctbal"), "c_acctbal")
    return h.select("c_custkey", *[F.round(c, 6).alias(c) for c in ("heat", "bar_from", "bar_to")])


@_query("G28_selection_sum", """
    SELECT 2 * count(*) AS cells, 2 * count(*) AS filled, count(*) AS numbers, round(sum(o_totalprice), 2) AS sum, round(avg(o_totalprice), 4) AS average, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders WHERE o_orderkey BETWEEN 100 AND 5000""")
def _(t):
    x = grouping.selection_sum(t("orders"), ["o_totalprice", "o_orderpriority"], F.col("o_orderkey").between(100, 5000))
    return x.withColumns({"sum": F.round("sum", 2), "average": F.round("average", 4)})


@_query("T18_hiding_modes", """
    WITH c AS (SELECT 'u' || c_custkey || '@x.org' AS m, CASE WHEN c_custkey % 2 = 0 THEN '06' || lpad(c_custkey::VARCHAR, 8, '0') ELSE '?' END AS p, strftime(DATE '1960-01-01' + c_custkey::INT % 9000, '%d/%m/%Y') AS d FROM customer)
    SELECT 'contact' AS column_name, CASE WHEN avg(regexp_full_match(m, '[^@ ]+@[^@ ]+[.][^@ ]+')::INT) >= 0.6 THEN 'email' ELSE 'full' END AS mode FROM c
    UNION ALL SELECT 'Téléphone', CASE WHEN avg(regexp_full_match(p, '0[1-9][0-9]{8}')::INT) >= 0.4 THEN 'phone' ELSE 'keep' END FROM c
    UNION ALL SELECT 'Date naissance', CASE WHEN count(try_strptime(d, '%d/%m/%Y')) >= 0.6 * count(*) THEN 'date' ELSE 'keep' END FROM c
    UNION ALL SELECT * FROM (VALUES ('Adresse', 'address'), ('adresse mail', 'keep'), ('Nom', 'last'), ('nom du fichier', 'keep'), ('IBAN', 'text'), ('note', 'keep')) v""")
def _(t):
    c = t("customer").selectExpr("concat('u', c_custkey, '@x.org') AS contact", "if(c_custkey % 2 = 0, concat('06', lpad(c_custkey, 8, '0')), '?') AS `Téléphone`", "date_format(date_add(DATE '1960-01-01', cast(c_custkey % 9000 AS INT)), 'dd/MM/yyyy') AS `Date naissance`", "c_address AS Adresse" if "c_address" in t("customer").columns else "c_name AS Adresse", "c_name AS `adresse mail`", "c_name AS Nom", "c_name AS `nom du fichier`", "c_name AS IBAN", "c_mktsegment AS note")
    return guesses.hiding_modes(c, c.columns)


@_query("D8_name_flags", """
    WITH c AS (SELECT c_custkey, c_custkey // 2 AS g, c_custkey // 2 % 3 AS kind FROM customer WHERE c_custkey // 2 * 2 + 1 <= (SELECT max(c_custkey) FROM customer))
    SELECT c_custkey, g * 2 AS group_id, 2::BIGINT AS n, CASE kind WHEN 0 THEN 85 WHEN 1 THEN 77 ELSE 30 END::INT AS confidence, 'phone' || CASE kind WHEN 0 THEN '' WHEN 1 THEN ', spelled differently' ELSE ', different names' END AS reasons FROM c""")
def _(t):
    g, odd = F.expr("c_custkey div 2"), F.col("c_custkey") % 2 == 1
    name = F.when(~odd | (g % 3 == 0), "Jeremy Bonamie").when(g % 3 == 1, "Bonami Jérémi").otherwise("Paul Dupont")
    c = t("customer").select("c_custkey", F.concat(F.lit("01"), F.lpad((g + 23456789).cast("string"), 8, "0")).alias("phone"), name.alias("name"), F.col("c_custkey").alias("note"))
    return matching.name_flags(c, matching.grouped(c, [matching.all_of(["phone"], "phone")], "c_custkey", ["phone", "name", "note"]), ["name"], "c_custkey")
