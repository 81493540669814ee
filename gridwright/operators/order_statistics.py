"""Exact quantiles of any number of rows: no task holds all values of a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import half_up
from ..plans.durable import keep


def quantiles(df: DataFrame, value: Column, at: Sequence[float], by: Sequence[str] = (), nearest: bool = False, weight: str | None = None) -> DataFrame:
    """(by, q0, q1, ...): the values at the places p * (n - 1) of each group, between two by interpolation, or the ``nearest``.

    Values are counted, the counts range-partitioned by group and value and added up inside each partition, from what the
    partitions before it hold of the group (a row for each partition and group). Nulls are left out; a group key may be null.
    With ``weight`` a row counts as often as that column says.
    """
    known = df.where(value.isNotNull())
    if weight:
        counts = known.select(*by, value.alias("_value"), F.col(weight).cast("long").alias("_n"))
    else:
        counts = known.groupBy(*by, value.alias("_value")).agg(F.count("*").alias("_n"))
    dealt = keep(counts.repartitionByRange(*by, "_value").withColumn("_part", F.spark_partition_id()))
    group = Window.partitionBy(*by)
    held = dealt.groupBy(*by, "_part").agg(F.sum("_n").alias("_held"))
    before = F.coalesce(F.sum("_held").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = held.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_part").alias("_of"), before.alias("_before"), F.sum("_held").over(group).alias("_total"))
    same = F.col("_part") == F.col("_of")
    for i, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"_by{i}"))
    own = F.sum("_n").over(Window.partitionBy(*by, "_part").orderBy("_value"))
    placed = dealt.withColumn("_own", own).join(starts, same).withColumn("_upto", F.col("_own") + F.col("_before"))
    first_past = lambda place: F.min(F.when(F.col("_upto") > place, F.col("_value")))
    ends, found = [F.max("_total").alias("_total")], []
    for i, p in enumerate(at):
        place = F.lit(float(p)) * (F.col("_total") - 1)
        low, high = (half_up(place), half_up(place)) if nearest else (F.floor(place), F.ceil(place))
        ends += [first_past(low).alias(f"_low{i}"), first_past(high).alias(f"_high{i}")]
        part = F.lit(0.0) if nearest else place - F.floor(place)
        found.append((F.col(f"_low{i}") + (F.col(f"_high{i}") - F.col(f"_low{i}")) * part).alias(f"q{i}"))
    return placed.groupBy(*by).agg(*ends).select(*by, *found)
