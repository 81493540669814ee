"""What only shows on larger tables: series that run far, long texts, files of many blocks, and what is sent to the driver."""

from __future__ import annotations

import gzip
import sys
import tracemalloc
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

import pyarrow as pa
from pyspark.sql import functions as F

from gridwright.functions.text import repaired, repaired_text
from gridwright.operators import duplicates, edits, matching
from gridwright.plans import catalog_more, graph  # noqa: F401
from gridwright.plans.catalog import ORACLE_SQL, QUERIES
from gridwright.plans.durable import tables_dir
from gridwright.sources import encodings, quoted, readers, writers

from oracle import connect, rows

SF = "/root/testdata/sf0.001"


def copied(spark, folder, table: str, key: str, shift: int) -> str:
    """A folder of the smallest tables in which the keys of one begin ``shift`` further on."""
    for path in Path(SF).iterdir():
        if path.name != f"{table}.parquet":
            (folder / path.name).symlink_to(path)
    spark.read.parquet(f"{SF}/{table}.parquet").withColumn(key, F.col(key) + shift).write.parquet(str(folder / f"{table}.parquet"))
    (folder / f"{table}.parquet").rename(folder / "made")
    (folder / f"{table}.parquet").symlink_to(next((folder / "made").glob("part-*.parquet")))
    return str(folder)


def test_date_series_beyond_year_9999(spark, tmp_path):
    sf_dir = copied(spark, tmp_path, "customer", "c_custkey", 899_000)
    got = QUERIES["T13_series"](spark, sf_dir).toPandas()
    assert rows(got) == rows(connect(sf_dir).sql(ORACLE_SQL["T13_series"]).df())
    assert got["month_end"].str.fullmatch(r"\d{5}-\d\d-\d\d").all()


def test_series_from_seeds_beyond_year_9999(spark, tmp_path):
    sf_dir = copied(spark, tmp_path, "customer", "c_custkey", 899_000)
    got = QUERIES["T13_series_from_seeds"](spark, sf_dir).toPandas()
    assert rows(got) == rows(connect(sf_dir).sql(ORACLE_SQL["T13_series_from_seeds"]).df())
    far = spark.createDataFrame([(3_000_000,)], "row long").select(edits.series("row", ["2024-01-31"]).alias("a"), edits.series("row", ["2024-01-05", "2024-02-05"]).alias("b")).first()
    want = connect(SF).sql("SELECT (DATE '2024-01-31' + 2999999)::VARCHAR, (DATE '2024-01-05' + to_months(2999999))::DATE::VARCHAR").fetchall()[0]
    assert tuple(far) == want == ("10237-10-20", "252023-12-05")
    shifted = spark.range(40).select(F.lit("9999-12-31").alias("d"), "id").select(*[edits.hidden("d", "shift", f"k{k}").alias(f"s{k}") for k in range(8)]).first()
    assert any(len(x) == 11 for x in shifted) and not any(x.startswith("+") for x in shifted)


def test_repair_of_long_runs_reads_its_text_once(spark):
    texts = ["Ã©" * 20_000, "Ð¶" * 20_001 + "\n" + "Ã\n©", "x\n\nâ€™\n" * 3_000, "", "\n", "Ãƒ©" * 5_000 + "É"]
    table = spark.createDataFrame(list(enumerate(texts)), "k int, s string")
    mended = table.select("k", repaired("s").alias("r"))
    assert [r.r for r in mended.orderBy("k").collect()] == [repaired_text(s) for s in texts]
    wide = spark.range(1).select(repaired(F.concat(F.lit("é"), F.col("id").cast("string"))).alias("r"))
    assert wide._jdf.queryExecution().optimizedPlan().toString().count("id#") <= 4  # the whole expression, not one for each use of each pass


def test_name_flags_broadcast_no_table(spark, monkeypatch):
    plans = []
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for module in (matching, duplicates, graph):
        monkeypatch.setattr(module, "keep", lambda df, keep=module.keep: plans.append(plan(df)) or keep(df))
    got = QUERIES["D8_name_flags"](spark, SF)
    plans.append(plan(got))
    assert sum("SortMergeJoin" in p for p in plans) >= 4 and not any("Broadcast" in p for p in plans)
    assert rows(got.toPandas()) == rows(connect(SF).sql(ORACLE_SQL["D8_name_flags"]).df())


def test_long_lines_leave_arrow_in_portions(spark, tmp_path):
    lines = pa.record_batch({"file": ["f"] * 4000, "block": [0] * 4000, "raw": [b"x" * 10_000] * 4000})
    tracemalloc.start()
    n = sum(len(line) for _, line, _ in quoted._decoded(iter([lines]), encodings.encoding("GB18030"), False))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 40_000_000 and peak < 8_000_000
    table = spark.range(300).select(F.col("id").cast("string").alias("k"), F.concat(F.lit('é "a"\r\n;\n'), F.repeat(F.lit("bç "), 7000), "id").alias("t")).coalesce(1)
    for name in ("UTF-16LE", "GB18030", "UTF-8"):
        path = str(tmp_path / name)
        writers.write_encoded(table, path, name)
        back = readers.read_quoted(spark, path, ",", True, name)
        assert back.exceptAll(table).isEmpty() and back.count() == 300
        assert readers.read_lines(spark, path, name).agg(F.sum(F.length("line"))).first()[0] > 300 * 21_000


def test_encodings_take_less_disk_than_twice_their_input(spark, monkeypatch):
    folder, seen = Path(tables_dir(spark).removeprefix("file://")), []
    size = lambda: sum(p.stat().st_size for p in folder.rglob("part-*"))
    before = size()

    def written(*args, write=writers.write_encoded, **kwargs):
        write(*args, **kwargs)
        seen.append(size() - before)

    monkeypatch.setattr(writers, "write_encoded", written)
    got = QUERIES["S6_encodings"](spark, SF)
    given = sum(Path(f"{SF}/{t}.parquet").stat().st_size for t in ("documents", "part"))
    assert len(seen) == 8 and max(seen) < 2 * given
    assert not [*folder.rglob("part-*.gz")] and size() - before < given / 2
    assert rows(got.toPandas()) == rows(connect(SF).sql(ORACLE_SQL["S6_encodings"]).df())


def test_compressed_files_are_read_once_and_as_others(spark, tmp_path):
    texts = ['k;t\r\n1;"a;\n""b"\r\n\n2;"x "y" z"\n', 'k;t\n3;é\n4;"never\nclosed', 'k;t\n\n"', "k;t\n" + "".join(f'{k};"ç\n{k}"\n' for k in range(3000)) + '5;"', ""]
    for name in ("UTF-8", "UTF-16LE", "UTF-32BE", "GB18030"):
        for kind, packed in (("plain", ()), ("gz", (0, 1, 2, 3, 4)), ("mixed", (1, 3))):
            (tmp_path / name / kind).mkdir(parents=True)
            for k, text in enumerate(texts):
                raw = text.encode(encodings.encoding(name).codec)
                (tmp_path / name / kind / f"{k}.txt{'.gz' * (k in packed)}").write_bytes(gzip.compress(raw) if k in packed else raw)
        read = {kind: quoted.read_records(spark, str(tmp_path / name / kind), ";", name, keep_raw=True) for kind in ("plain", "gz", "mixed")}
        place = F.regexp_extract("file", r"([0-9]+)\.txt", 1).alias("file")
        plain, gz, mixed = ({tuple(map(str, r)) for r in df.select(place, "block", "at", "cells", "wrong_quotes", "raw").collect()} for df in read.values())
        assert len(plain) == 3010 and gz == plain == mixed
        assert read["gz"]._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    table = spark.range(500).select(F.col("id").cast("string").alias("k"), F.concat(F.lit('é "a"\r\n;\n'), F.repeat(F.lit("bç "), 50), "id").alias("t")).repartition(3)
    for name in ("UTF-16BE", "UTF-32LE", "UTF-8"):
        path = str(tmp_path / f"{name}.csv")
        writers.write_encoded(table, path, name, compression="gzip")
        assert len([*Path(path).glob("part-*.txt.gz")]) == 3
        back = readers.read_delimited(spark, path, ",", True, name)
        assert back.exceptAll(table).isEmpty() and back.count() == 500
        assert readers.read_lines(spark, path, name).count() == 3 + 3 * 500
