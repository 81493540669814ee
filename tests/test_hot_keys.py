"""Hot and empty keys: same results, and no task with most of the rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gridwright.operators import edits, joining


@pytest.fixture
def tiny_thresholds(spark):
    wanted = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    old = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def largest(df, path) -> int:
    """Rows of the largest task that makes the whole of ``df``."""
    df.withColumn("__p", F.spark_partition_id()).write.parquet(path)
    return df.sparkSession.read.parquet(path).groupBy("__p").count().agg(F.max("count")).first()[0]


@pytest.mark.parametrize("hot", ["", "k7"])
def test_look_up_spreads_hot_keys(spark, tiny_thresholds, tmp_path, hot):
    n = 200_000
    left = spark.range(n).select("id", F.when(F.col("id") % 50 == 0, F.concat(F.lit("k"), F.col("id") % 1000)).otherwise(hot).alias("key"), F.sha2(F.col("id").cast("string"), 256).alias("fill"))
    source = spark.range(2000).select("id", F.concat(F.lit("K"), F.col("id") % 1000).alias("key"), (F.col("id") * 2).alias("value"))
    got = joining.look_up(left, "key", source, "key", ["value"], "id")
    assert largest(got, str(tmp_path / "t")) < n / 4
    assert tuple(got.agg(F.count("*"), F.sum("value"), F.count("value")).first()) == (n, sum(2 * (k % 1000) for k in range(0, n, 50)) + (14 * (n - n // 50) if hot else 0), n if hot else n // 50)


def test_fill_down_within_groups(spark):
    rows = [(k, g, "" if k % 7 else f"{g}{k}") for k in range(3000) for g in ("a", "b", None) if not (g == "b" and k < 2900)]
    table = spark.createDataFrame(rows, "row int, g string, v string").repartition(5)
    want, last = {}, {}
    for k, g, v in sorted(rows, key=lambda r: r[0]):
        last[g] = v or last.get(g, "")
        want[k, g] = last[g]
    got = edits.fill_down(table, "v", "row", by=["g"])
    assert got.columns == ["row", "g", "v", "filled"] and {(r.row, r.g): r.filled for r in got.collect()} == want
    flat = {r.row: r.filled for r in edits.fill_down(table.where("g = 'a'"), "v", "row").collect()}
    assert flat == {k: v for (k, g), v in want.items() if g == "a"}
    assert edits.fill_down(table.limit(0), "v", "row", by=["g"]).count() == 0


def test_fill_down_cuts_hot_groups(spark, tiny_thresholds, monkeypatch):
    n = 100_000
    table = spark.range(n).select("id", F.when(F.col("id") % 100 == 0, F.col("id").cast("string")).otherwise("hot").alias("g"), F.when(F.col("id") == 5, "x").otherwise("").alias("v"))
    kept = []
    monkeypatch.setattr(edits, "keep", lambda df, keep=edits.keep: kept.append(keep(df)) or kept[-1])
    got = edits.fill_down(table, "v", "id", by=["g"])
    assert got.where("filled = 'x'").count() == sum(k % 100 != 0 for k in range(5, n))
    assert kept[0].groupBy("__part").count().agg(F.max("count")).first()[0] < n / 4
