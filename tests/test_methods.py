"""Methods on cells beside values that JavaScript gives."""

import hashlib
import math

from pyspark.sql import functions as F

from gridwright.functions import methods as m


def _one(spark, *columns, text="Abc-abc é𝒳"):
    row = spark.createDataFrame([(text, [5, 7, 5])], "s string, l array<int>").select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).collect()[0]
    return list(row)


def test_places(spark):
    assert _one(spark, m.slice_text("s", -2), m.slice_text("s", 1, -3), m.slice_text("s", 5, 2), m.slice_text("s", 40), m.substring("s", 3, 1), m.substring("s", -4, 2)) == ["é𝒳", "bc-abc", "", "", "bc", "Ab"]
    assert _one(spark, m.at("s", -1), m.at("s", 10), m.at("s", -11), m.char_at("s", 10), m.char_at("s", -1), m.code_point_at("s", 9), m.code_point_at("s", 99)) == ["𝒳", None, None, "", "", 0x1D4B3, None]
    assert _one(spark, m.index_of("s", "bc"), m.index_of("s", "bc", 2), m.index_of("s", "zz"), m.index_of("s", "", 99), m.last_index_of("s", "bc"), m.last_index_of("s", "bc", 4), m.last_index_of("s", "Bc")) == [1, 5, -1, 10, 5, 1, -1]
    assert _one(spark, m.starts_with("s", "abc", 4), m.starts_with("s", "abc"), m.ends_with("s", "Abc", 3), m.includes("s", "Abc", 1), m.compare("s", F.lit("ABC-ABC E𝒳")), m.compare("s", F.lit("b")), m.compare("s", "s")) == [True, False, True, False, 1, -1, 0]


def test_patterns(spark):
    assert _one(spark, m.replace_pattern("s", "([aA])(b)", "$2$1$$"), m.replace_pattern("s", "b", "[$&]"), m.replace_pattern("s", "(?<x>b)c", "$<x>\\"), m.replace_pattern("s", "(b)", "$10$2$")) == ["bA$c-ba$c é𝒳", "A[b]c-a[b]c é𝒳", "Ab\\-ab\\ é𝒳", "Ab0$2$c-ab0$2$c é𝒳"]
    assert _one(spark, m.replace_first("s", "b(c)", "$1"), m.replace_first("s", "x*", "_"), m.replace_first("s", "zz", "_"), m.replace_first("s", r"(?i)(a)bc-\1", "<$1>")) == ["Ac-abc é𝒳", "_Abc-abc é𝒳", "Abc-abc é𝒳", "<A>bc é𝒳"]
    assert _one(spark, m.search("s", "𝒳"), m.search("s", "q"), m.search("s", r"(.)(.)c-.\2"), m.match("s", "(b)(c)"), m.match("s", "q"), m.match_all("s", "[ab]+")) == [9, -1, 0, ["bc", "b", "c"], None, ["b", "ab"]]
    assert _one(spark, m.split_list("s", "-"), m.split_list("s", "", 3), m.split_list("s"), m.split_list("s", "c", 2), m.split_list(F.lit(""), "x")) == [["Abc", "abc é𝒳"], ["A", "b", "c"], ["Abc-abc é𝒳"], ["Ab", "-ab"], [""]]


def test_padding_space_forms(spark):
    assert _one(spark, m.pad_start(F.lit("x"), 6, "ab"), m.pad_end(F.lit("x"), 4), m.pad_start("s", 3, "0"), m.pad_end(F.lit("x"), 4, "")) == ["ababax", "x   ", "Abc-abc é𝒳", "x"]
    assert _one(spark, m.trim("s"), m.trim_start("s"), m.trim_end("s"), text="\u00a0\ufeff\n a b\u3000") == ["a b", "a b\u3000", "\u00a0\ufeff\n a b"]
    assert _one(spark, m.normalize(F.lit("e\u0301")), m.normalize(F.lit("é"), "NFD"), m.normalize(F.lit("ﬁ"), "NFKC")) == ["é", "e\u0301", "fi"]
    assert _one(spark, *[m.digest("s", n) for n in ("sha3_256", "sha3_512", "blake2b")], m.digest(F.lit(""), "blake2b"), text="é") == [*[getattr(hashlib, n)("é".encode()).hexdigest() for n in ("sha3_256", "sha3_512", "blake2b")], ""]


def test_numbers(spark):
    cells = lambda f, *x: [f(F.lit(v)) for v in x]
    assert _one(spark, *cells(lambda c: m.to_fixed(c, 2), "1.005", "1,255", "-2.5", "x", "8.345"), *cells(m.to_fixed, "2.5", "-2.5", "1e20")) == ["1.00", "1.25", "-2.50", None, "8.35", "3", "-3", "100000000000000000000"]
    assert _one(spark, *cells(lambda c: m.to_precision(c, 3), "123.456", "0.000123", "1234", "0.0000001", "0", "-99.95", "999.6")) == ["123", "0.000123", "1.23e+3", "1.00e-7", "0.00", "-100", "1.00e+3"]
    assert _one(spark, m.to_radix(F.lit("255"), 16), m.to_radix(F.lit("-35"), 36), m.to_radix(F.lit("0"), 2), m.to_radix(F.lit("1.5"), 2)) == ["ff", "-z", "0", None]
    one = lambda name, *x: m.math(name, *map(F.lit, x))
    got = _one(spark, one("round", "-2,5"), one("trunc", "-2.7"), one("cbrt", "27"), one("sqrt", "-1"), one("pow", "2", "10"), one("min", "3", "-1"), one("max", "3", "x"), one("log2", "8"), one("log", "0"), one("exp", "1"), one("sign", "-3"), one("ceil", "1.2"))
    assert got[:5] == [-2.0, -2.0, 3.0, None, 1024.0] and got[5:9] == [-1.0, None, 3.0, None] and math.isclose(got[9], math.e) and got[10:] == [-1.0, 2.0]


def test_dates_lists_and_ids(spark):
    d = F.lit("2024-03-03 23:30:15.250").cast("timestamp")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert _one(spark, m.get(d, "Month"), m.get(d, "Day"), m.get(d, "Day", utc=True), m.get(d, "Hours", utc=True), m.get(d, "Seconds"), m.to_iso(d), m.get_time(d)) == [2, 0, 1, 4, 15, "2024-03-04T04:30:15.250Z", 1709526615250]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    items = F.col("l")
    assert _one(spark, m.list_at(items, -1), m.list_at(items, 3), m.list_slice(items, -2), m.list_index_of(items, 5, 1), m.list_index_of(items, 9), m.list_last_index_of(items, 5), m.list_last_index_of(items, 8)) == [5, None, [7, 5], 2, -1, 2, -1]
    ids = [r.u for r in spark.range(0, 2**34 + 1, 2**31).select(m.uuid7(F.col("id")).alias("u"), "id").orderBy("id").collect()]
    assert ids == sorted(ids) and len(set(ids)) == len(ids) and all(len(u) == 36 and u[14] == "7" and u[19] in "89ab" for u in ids)
