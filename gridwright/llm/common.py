"""What the training-data operators share: durable intermediate tables, components, text access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.durable import keep as materialize  # noqa: F401
from ..plans.durable import rank_within, tables_dir  # noqa: F401
from ..plans.graph import components  # noqa: F401

#: The white space that word and equality rules of these operators know: space, and tab to carriage return.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def free_names(df: DataFrame, n: int, stem: str = "own") -> list[str]:
    """``n`` names that no column of ``df`` has, whatever their case."""
    taken = {c.lower() for c in df.columns}
    found, k = [], 0
    while len(found) < n:
        if f"{stem}_{k}" not in taken:
            found.append(f"{stem}_{k}")
        k += 1
    return found
