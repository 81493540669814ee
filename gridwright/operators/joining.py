"""Look-ups, comparison and combination of tables."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import filled, match_key, text, trimmed
from ..plans.durable import keep


def _first_of_key(df: DataFrame, key: str, columns: Sequence[str], rid: str, how: str) -> DataFrame:
    row = F.struct(*[F.col(c) for c in columns])
    return df.where(filled(key)).groupBy(match_key(key, how).alias("_key")).agg(F.min_by(row, F.col(rid)).alias("_row"), F.count("*").alias("_n"))


def _found(left: DataFrame, first: DataFrame) -> DataFrame:
    """``left`` (with _key, null where it is empty) with the row of ``first`` for its key.

    Empty keys pass by the join, as they would all meet in one task. Where the optimizer's size of ``first`` is over that of a broadcast,
    it is kept, so that both sides are plain shuffles, of which adaptive execution splits hot keys.
    """
    session = left.sparkSession
    most = session._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    small = int(str(first._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= most
    filled_keys = left.where("_key is not null").join(first if small else keep(first), "_key", "left")
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in first.schema if f.name != "_key"]
    return filled_keys.unionByName(left.where("_key is null").select("*", *nothing))


def look_up(left: DataFrame, key: str, source: DataFrame, source_key: str, columns: Sequence[str], source_rid: str, how: str = "loose") -> DataFrame:
    """``left`` with ``columns`` of the first source row of an equal key; empty keys find nothing; a title that is taken gets " (source)"."""
    first = _first_of_key(source, source_key, columns, source_rid, how)
    names = {c: c if c not in left.columns else f"{c} (source)" for c in columns}
    joined = _found(left.withColumn("_key", F.when(filled(key), match_key(key, how))), first)
    return joined.select(*[F.col(f"`{c}`") for c in left.columns], *[F.col(f"_row.`{c}`").alias(n) for c, n in names.items()])


def look_up_report(left: DataFrame, key: str, source: DataFrame, source_key: str, source_rid: str, how: str = "loose") -> DataFrame:
    """One row: hits, misses, empty keys, and source rows that repeat a key."""
    first = _first_of_key(source, source_key, [source_key], source_rid, how)
    joined = _found(left.select(filled(key).alias("_f"), F.when(filled(key), match_key(key, how)).alias("_key")), first)
    hit = F.col("_f") & F.col("_n").isNotNull()
    found = joined.agg(F.count_if(hit).alias("hits"), F.count_if(F.col("_f") & ~hit).alias("misses"), F.count_if(~F.col("_f")).alias("empty_keys"))
    return found.crossJoin(first.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("repeated_keys")))  # one row each


def compare(here: DataFrame, there: DataFrame, key: str, columns: Sequence[str], rid: str, there_rid: str, how: str = "exact") -> DataFrame:
    """(key, status, changed): same, changed (with the columns), only here or only there, by the first row of each key."""
    a = _first_of_key(here, key, [key, *columns], rid, how).withColumnRenamed("_row", "_a").drop("_n")
    b = _first_of_key(there, key, [key, *columns], there_rid, how).withColumnRenamed("_row", "_b").drop("_n")
    both = a.join(b, "_key", "full")
    differs = [F.when(match_key(F.col(f"_a.`{c}`"), how) != match_key(F.col(f"_b.`{c}`"), how), F.lit(c)) for c in columns]
    changed = F.concat_ws(", ", *differs)
    status = F.when(F.col("_b").isNull(), "only here").when(F.col("_a").isNull(), "only there").when(changed == "", "same").otherwise("changed")
    key_text = trimmed(F.coalesce(F.col(f"_a.`{key}`").cast("string"), F.col(f"_b.`{key}`").cast("string")))
    return both.select(key_text.alias(key), status.alias("status"), F.when(status == "changed", changed).otherwise(F.lit("")).alias("changed"))


def rows_to_append(here: DataFrame, there: DataFrame, key: str, how: str = "exact") -> DataFrame:
    """Rows of ``there`` whose key isn't ``here``, with the columns of ``here``; missing ones are empty."""
    keys = here.where(filled(key)).select(match_key(key, how).alias("_key")).distinct()
    new = there.where(filled(key)).withColumn("_key", match_key(key, how)).join(keys, "_key", "left_anti")
    return new.select(*[F.col(c) if c in there.columns else F.lit("").alias(c) for c in here.columns])


def title_slug(title: str) -> str:
    plain = "".join(c for c in unicodedata.normalize("NFD", title.lower()) if not unicodedata.combining(c))
    return re.sub(r"[\W_]+", " ", plain).strip()


def combine(tables: dict[str, DataFrame], by_slug: bool = True, only_common: bool = False, source: str | None = None) -> DataFrame:
    """Rows of all tables; columns match by title (a repeated one by its rank), missing cells are empty, ``source`` names the table."""
    titles: dict[tuple[str, int], str] = {}
    named = []
    for name, df in tables.items():
        seen: dict[str, int] = {}
        keys = []
        for title in df.columns:
            s = title_slug(title) if by_slug else title
            keys.append((s, seen.setdefault(s, 0)))
            seen[s] += 1
            titles.setdefault(keys[-1], title)
        named.append((name, df.toDF(*[f"c{i}" for i in range(len(keys))]), keys))
    wanted = [k for k in titles if not only_common or all(k in keys for _, _, keys in named)]
    parts = []
    for name, df, keys in named:
        cells = [(text(f"c{keys.index(k)}") if k in keys else F.lit("")).alias(titles[k]) for k in wanted]
        parts.append(df.select(*cells, *([F.lit(name).alias(source)] if source else [])))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def split_plan(df: DataFrame, c: str, rid: str, how: str = "loose") -> DataFrame:
    """Files that a split by value gives: (value, file_name, n, first_row).

    Signs that file names can't have become _, an empty value is "empty". Names that are equal but for case are told apart:
    the first by row keeps its name, the others get " (2)", " (3)" and so on.
    """
    return _split_plan(df, c, rid, how).drop("_key")


def _split_plan(df: DataFrame, c: str, rid: str, how: str) -> DataFrame:
    groups = df.groupBy(match_key(c, how).alias("_key")).agg(F.min_by(trimmed(c), F.col(rid)).alias("value"), F.count("*").alias("n"), F.min(rid).alias("first_row"))
    clean = F.trim(F.regexp_replace("value", r'[\\/:*?"<>|\x00-\x1f]+', "_"))
    named = groups.withColumn("file_name", F.when(clean == "", "empty").otherwise(clean))
    place = F.row_number().over(Window.partitionBy(F.lower("file_name")).orderBy("first_row"))
    told = F.when(place == 1, F.col("file_name")).otherwise(F.concat("file_name", F.lit(" ("), place.cast("string"), F.lit(")")))
    return named.select("_key", "value", told.alias("file_name"), "n", "first_row")


#: Files that a split writes at most.
MOST_FILES = 5000


def split_write(df: DataFrame, c: str, path: str, rid: str, how: str = "loose") -> None:
    """One folder of CSV files for each value, named as :func:`split_plan` says; more than MOST_FILES values are refused."""
    plan = keep(_split_plan(df, c, rid, how).select("_key", "file_name"))
    if plan.count() > MOST_FILES:
        raise ValueError(f"more than {MOST_FILES} values")
    named = df.withColumn("_key", match_key(c, how)).join(F.broadcast(plan), "_key").drop("_key")  # at most MOST_FILES rows
    named.write.partitionBy("file_name").option("header", True).csv(path)


def compare_report(here: DataFrame, there: DataFrame, key: str, columns: Sequence[str], rid: str, there_rid: str, how: str = "exact") -> DataFrame:
    """One row: keys that are same, changed, only_here, only_there, rows of either table without a key and rows that repeat one."""
    status = compare(here, there, key, columns, rid, there_rid, how).agg(*[F.count_if(F.col("status") == s).alias(s.replace(" ", "_")) for s in ("same", "changed", "only here", "only there")])
    one = lambda df, name: df.groupBy(F.when(filled(key), match_key(key, how)).alias("_key")).agg(F.count("*").alias("_n")).agg(F.coalesce(F.sum(F.when(F.col("_key").isNull(), F.col("_n"))), F.lit(0)).alias(f"no_key_{name}"), F.coalesce(F.sum(F.when(F.col("_key").isNotNull(), F.col("_n") - 1)), F.lit(0)).alias(f"dup_{name}"))
    return status.crossJoin(one(here, "here")).crossJoin(one(there, "there"))  # one row each


def review(before: DataFrame, after: DataFrame, rid: str, columns: Sequence[str]) -> DataFrame:
    """(rid, status, changed): rows added, deleted or changed between two versions; equal rows are left out."""
    row = lambda df, name: df.select(F.col(rid), F.struct(*[text(c).alias(c) for c in columns]).alias(name))
    both = row(before, "_a").join(row(after, "_b"), rid, "full")
    changed = F.concat_ws(", ", *[F.when(F.col(f"_a.`{c}`") != F.col(f"_b.`{c}`"), F.lit(c)) for c in columns])
    status = F.when(F.col("_b").isNull(), "deleted").when(F.col("_a").isNull(), "added").when(changed != "", "changed")
    return both.select(rid, status.alias("status"), F.when(status == "changed", changed).otherwise(F.lit("")).alias("changed")).where("status is not null")
