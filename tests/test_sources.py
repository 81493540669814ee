from datetime import datetime

from pyspark.sql import functions as F

from gridwright.functions.text import date_key, number, slug, sort_key
from gridwright.sources import readers, writers
from gridwright.streaming import follow


def test_delimited_round_trip(spark, tmp_path):
    rows = [("1", 'a "quoted"; cell', "two\nlines"), ("2", "", "é")]
    df = spark.createDataFrame(rows, "id string, name string, note string")
    writers.write_delimited(df, str(tmp_path / "t.csv"), ";")
    back = readers.read_delimited(spark, str(tmp_path / "t.csv"), ";").na.fill("")
    assert sorted(map(tuple, back.collect())) == rows
    assert readers.guess_delimiter("a;b;c\n1,5;2;3\n4;5;6") == ";" and readers.guess_delimiter("plain\ntext") is None


def test_json_is_flattened(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": {"b": 1, "c": [1, 2]}, "d": null}\n{"a": {"b": 2}}\n')
    got = readers.read_table(spark, str(tmp_path / "x.jsonl"))
    assert set(got.columns) >= {"a.b", "a.c"} and {r["a.c"] for r in got.collect()} == {'["1","2"]', None}


def test_typed_parquet(spark, tmp_path):
    df = spark.createDataFrame([("1", "1.5", "true", "x"), ("", "2", "false", "y")], "i string, n string, b string, s string")
    writers.write_typed_parquet(df, str(tmp_path / "p"))
    assert dict(spark.read.parquet(str(tmp_path / "p")).dtypes) == {"i": "bigint", "n": "double", "b": "boolean", "s": "string"}


def test_lenient_numbers_and_dates(spark):
    numbers = {"1 234,50 €": 1234.5, "(42)": -42.0, "1,234.5": 1234.5, "1.234,5": 1234.5, "1.234.567": 1234567.0, "1e3": 1000.0, "": None, "abc": None, "12 kg": None, "-0": 0.0, "1,5": 1.5}
    got = spark.createDataFrame([(k,) for k in numbers], "x string").select("x", number("x").alias("n")).collect()
    assert {r.x: r.n for r in got} == numbers
    dates = {"15/03/2024": 20240315000000, "2024-03-15": 20240315000000, "2024-02-30 1:05": 20240230010500, "2024-13-01": None, "15/03/24": None, "15/03-2024": None, "": None, "1.2.2024 23:59:58": 20240201235958}
    got = spark.createDataFrame([(k,) for k in dates], "x string").select("x", date_key("x").alias("n")).collect()
    assert {r.x: r.n for r in got} == dates


def test_slugs_and_sort_keys(spark):
    df = spark.createDataFrame([("Lot 10",), ("lot 2",), ("Émile",), ("emma",), ("Œuvre  à-b",)], "x string")
    assert [r.x for r in df.orderBy(sort_key("x")).collect()] == ["Émile", "emma", "lot 2", "Lot 10", "Œuvre  à-b"]
    assert {r[0] for r in df.select(slug("x")).collect()} >= {"oeuvre a b", "lot 10"}


def test_following_a_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.log").write_text("a\nb\n")
    stream = follow.follow_lines(spark, str(tmp_path / "in"))
    run = lambda: stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    run()
    (tmp_path / "in" / "2.log").write_text("c\n")
    run()
    assert sorted(r.line for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]


def test_windows_close_late(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1, 5), "x"), (datetime(2024, 1, 1, 9), "x"), (datetime(2024, 1, 2), "y")], "t timestamp, k string")
    assert {(r.k, r.n) for r in follow.count_by_window(df, "t", "k").collect()} == {("x", 2), ("y", 1)}
    assert df.select(F.lit(1)).count() == 3


def test_typed_columns_lose_nothing(spark):
    from gridwright.sources.writers import typed_columns

    df = spark.createDataFrame([("1,5", "oui", "007", "12", "1"), ("2", "non", "8", "", "1" * 25)], "price string, yes string, code string, whole string, long string")
    got = typed_columns(df)
    assert dict(got.dtypes) == {"price": "double", "yes": "boolean", "code": "string", "whole": "bigint", "long": "string"}
    assert sorted(map(tuple, got.collect())) == [(1.5, True, "007", 12, "1"), (2.0, False, "8", None, "1" * 25)]


def test_guesses_of_headers_and_encodings():
    from gridwright.sources.readers import guess_encoding, guess_header

    assert guess_header([["name", "amount"], ["a", "1"], ["b", "2"]])
    assert not guess_header([["a", "7"], ["b", "1"], ["c", "2"]])
    assert guess_header([["city", "2023"], ["a", "15,5"], ["b", "812"]])
    assert guess_header([["name", "town"], ["a", "b"]]) and not guess_header([["a", "b"], ["a", "c"]])
    assert guess_encoding("é".encode("cp1252") + b"t\xe9 abc") == "windows-1252"
    assert guess_encoding("été".encode()) == "UTF-8" and guess_encoding("abcd".encode("utf-16-le")) == "UTF-16LE"


def test_growing_file_gives_each_whole_line_once(spark, tmp_path):
    from gridwright.streaming.follow import follow_file

    path, out = str(tmp_path / "a.log"), str(tmp_path / "out")

    def run():
        follow_file(spark, path, bytes_per_task=7).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(once=True).start(out).awaitTermination(60)
        return sorted(r.line for r in spark.read.schema("line string, position bigint").parquet(out).collect())

    with open(path, "w") as f:
        f.write("one\ntwo two two\n\nthr")
    assert run() == ["", "one", "two two two"]
    with open(path, "a") as f:
        f.write("ee\n")
    assert run() == ["", "one", "three", "two two two"]
    assert run() == ["", "one", "three", "two two two"]
