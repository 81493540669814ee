"""Tables kept between steps, and numbers for the rows of an order."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``; a local one is made only for a local session without it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="gridwright-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def tables_dir(spark: SparkSession) -> str:
    """The folder of this application's tables."""
    return f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}"


def keep(df: DataFrame) -> DataFrame:
    """Write ``df`` into the shared folder and read it again.

    This cuts the lineage, survives lost executors, is computed once, and lets a following join read plain shuffles of
    both sides, which adaptive execution can split where a key is hot.
    """
    path = f"{tables_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that stays a shuffle of both sides (sorted and merged), whatever its size.

    A table that grows with the input is not to be broadcast, as that takes it through the driver: Spark, left alone, does so by the size of
    files, in which sorted ids or repeated names take a twentieth of the memory that they need.
    """
    return df.hint("merge")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder that nothing reads any more."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


def remove_kept(spark: SparkSession) -> None:
    """Delete the tables that this application keeps, not those of others: call it when the results that read them are written."""
    remove(spark, tables_dir(spark))


#: The parts of monotonically_increasing_id: the partition above, the place in it below. A fixed value of Spark's.
_PLACE_BITS = 33


def _dealt(df: DataFrame, keys: Sequence[Column]) -> DataFrame:
    """``df`` range-partitioned and sorted by ``keys``, with __part and the place in it, __at, from 0: the only shuffle of its rows."""
    at = F.monotonically_increasing_id()
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__id", at)
    return keep(dealt.withColumns({"__part": F.shiftright("__id", _PLACE_BITS), "__at": F.col("__id").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))}).drop("__id"))


def number_rows(df: DataFrame, order: Sequence[Column], name: str = "row") -> DataFrame:
    """``df`` with the place of each row in ``order``, from 1.

    Rows are range-partitioned and sorted once and numbered as they lie; each partition's first number comes from the
    counts of those before it: no task sees all rows. ``order`` should be unique; ties are numbered in any order.
    """
    keys = {f"__k{i}": c for i, c in enumerate(order)}
    dealt = _dealt(df.select("*", *[_value(c).alias(k) for k, c in keys.items()]), [_like(c, k) for k, c in keys.items()])
    counts = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(counts.select("__part", before.alias("__before")))  # a row for each partition
    return dealt.join(starts, "__part").select(*[F.col(f"`{c}`") for c in df.columns], (F.col("__at") + F.col("__before") + 1).cast("long").alias(name))


def rank_within(df: DataFrame, group: str, order: Sequence[str], name: str) -> DataFrame:
    """``df`` with each row's rank from 0 in ``order`` within its ``group``, a column of few values that isn't null.

    A hot group is cut like any other rows; only counts by partition and group, few as both are, are added up and broadcast.
    Rows equal in ``order`` take ranks in any order; where they are many, end ``order`` with a column that tells them apart.
    """
    dealt = _dealt(df, [F.col(f"`{c}`").asc_nulls_last() for c in (group, *order)])
    held = dealt.groupBy("__part", group).agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(held.select("__part", group, (before - F.col("__first")).alias("__shift")))
    return dealt.join(starts, ["__part", group]).select(*[F.col(f"`{c}`") for c in df.columns], (F.col("__at") + F.col("__shift")).cast("long").alias(name))


def _value(c) -> Column:
    return c[0] if isinstance(c, tuple) else c


def _like(c, name: str) -> Column:
    """The key's direction: (column, descending) or a column; nulls are last both ways."""
    return F.col(name).desc_nulls_last() if isinstance(c, tuple) and c[1] else F.col(name).asc_nulls_last()
