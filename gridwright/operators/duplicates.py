"""Duplicate rows: whole rows, one key, or any of several keys with chaining."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import filled, match_key, text
from ..plans import graph
from ..plans.durable import keep, number_rows, shuffled


def whole_rows(df: DataFrame, columns: Sequence[str], rid: str, how: str = "exact") -> DataFrame:
    """(rid, group_id, n) of rows that are there more than once, blank rows never; a group is named by its first row."""
    keys = [match_key(c, how) for c in columns]
    blank = ~F.greatest(*[filled(c) for c in columns]) if len(columns) > 1 else ~filled(columns[0])
    hashed = df.where(~blank).select(F.col(rid), F.sha2(F.to_json(F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)])), 256).alias("_key"))
    groups = keep(hashed.groupBy("_key").agg(F.min(rid).alias("group_id"), F.count("*").alias("n")).where("n > 1"))
    return hashed.join(shuffled(groups), "_key").select(rid, "group_id", "n")


def by_keys(df: DataFrame, keys: Sequence[Sequence[str]], rid: str, how: str = "slug") -> DataFrame:
    """(rid, group_id): rows with all filled fields of any key in common are one group, over as many steps as it takes.

    For each key, rows point to the first row of their value; then smallest ids are passed on until nothing changes.
    """
    edges = None
    for fields in keys:
        full = F.lit(True)
        for c in fields:
            full &= match_key(c, how) != ""
        name = F.sha2(F.to_json(F.struct(*[match_key(c, how).alias(f"k{i}") for i, c in enumerate(fields)])), 256)
        rows = df.where(full).select(F.col(rid).alias("id"), name.alias("_key"))
        first = keep(rows.groupBy("_key").agg(F.min("id").alias("root"), F.count("*").alias("n")).where("n > 1").drop("n"))
        own = rows.join(shuffled(first), "_key").select("id", "root").where("id <> root")
        edges = own if edges is None else edges.union(own)
    return components(edges).select(F.col("id").alias(rid), F.col("label").alias("group_id"))


def components(edges: DataFrame) -> DataFrame:
    """(id, label) of the ids in edges (id, root): the smallest id that can be reached."""
    return graph.components(edges.select(F.col("id").alias("src"), F.col("root").alias("dst"))).withColumnRenamed("component", "label")


def to_delete(groups: DataFrame, rid: str, keep_last: bool = False) -> DataFrame:
    """The rows of each group but its first, or last."""
    kept = keep(groups.groupBy("group_id").agg((F.max if keep_last else F.min)(rid).alias("_kept")))
    return groups.join(shuffled(kept), "group_id").where(F.col(rid) != F.col("_kept")).select(rid, "group_id")


def merged(df: DataFrame, groups: DataFrame, columns: Sequence[str], rid: str) -> DataFrame:
    """One row for each group: of each column the first filled cell, and which columns differ."""
    rows = df.join(shuffled(groups.select(rid, "group_id")), rid)
    first = [F.coalesce(F.min_by(text(c), F.when(filled(c), F.col(rid))), F.lit("")).alias(c) for c in columns]
    differ = F.concat_ws(", ", *[F.when(F.count_distinct(F.when(filled(c), text(c))) > 1, F.lit(c)) for c in columns]).alias("differing")
    return rows.groupBy("group_id").agg(*first, differ)


def groups_together(df: DataFrame, groups: DataFrame, order: Sequence, rid: str, name: str = "place") -> DataFrame:
    """``df`` with the place of each row: in ``order``, but a group's rows follow its first row in that order."""
    placed = keep(number_rows(df.join(shuffled(groups.select(rid, "group_id")), rid, "left"), [*order, F.col(rid)], "_own"))
    first = keep(placed.where("group_id is not null").groupBy("group_id").agg(F.min("_own").alias("_first")))
    together = placed.join(shuffled(first), "group_id", "left")
    return number_rows(together, [F.coalesce("_first", "_own"), F.col("_own")], name).select(*df.columns, name)
