"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .durable import keep, shuffled


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (src, dst: long) as (id, component), component being the smallest id reached.

    Alternating large-star and small-star steps: each takes every vertex's smallest neighbour by a partial
    aggregate and joins it back, so no neighbour list is ever gathered; ends when the edges no longer change.
    Vertices without an edge are not returned. Null ends are ignored, loops and repeated edges are harmless.
    """

    def watched(e: DataFrame) -> tuple[DataFrame, tuple]:
        """The edges, kept, with their number and a sum of their hashes, taken while they are written."""
        state = Observation()
        kept = keep(e.observe(state, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("src", "dst").cast("decimal(20,0)")).alias("h")))
        return kept, (state.get["n"], state.get["h"])

    def large_star(e: DataFrame) -> DataFrame:
        both = e.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        low = keep(both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("low")))
        return both.join(shuffled(low), "src").where("dst > src").select(F.col("dst").alias("src"), F.col("low").alias("dst"))

    def small_star(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        low = keep(down.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("low")))
        return down.join(shuffled(low), "src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).union(low.select("src", F.col("low").alias("dst")))

    plain = lambda e: e.where("src <> dst").distinct()
    e, seen = watched(plain(edges.select(F.col("src").cast("long"), F.col("dst").cast("long"))))
    while seen[0]:
        e, now = watched(plain(small_star(keep(plain(large_star(e))))))
        if now == seen:
            break
        seen = now
    return e.select(F.col("src").alias("id"), F.col("dst").alias("component")).union(e.select(F.col("dst").alias("id"), F.col("dst").alias("component")).distinct())
