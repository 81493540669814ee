"""Each column's cells counted by their text once, for all that can be told from the counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import text, trimmed


def cell_counts(df: DataFrame, columns: Sequence[str], rid: str | None = None, trim: bool = True) -> DataFrame:
    """(column_name, t, n, first): each text of a column with its rows and its first row. One shuffle, combined before it."""
    read = trimmed if trim else text
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), read(c).alias("t")) for c in columns])).alias("c")
    rows = df.select((F.col(rid) if rid else F.lit(0)).alias("rid"), cells)
    return rows.groupBy("c.column_name", "c.t").agg(F.count("*").alias("n"), F.min("rid").alias("first"))
