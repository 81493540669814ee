"""Columns that identify rows, or nearly, and columns that decide others but for a few rows: found by searching all of them."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import date_key, fold_text, number, trimmed
from ..plans.durable import keep
from .counts import cell_counts

#: Thresholds of a key: filled and distinct shares, rows, columns that are looked at; repeated rows that a near key may have, at least and as a share, for
#: columns named like an identifier more. Fixed values.
KEY_FILLED, KEY_DISTINCT, KEY_ROWS, KEY_COLUMNS = 0.98, 0.9, 20, 6
REPEATS_LEAST, REPEATS, REPEATS_OF_IDS = 2, 0.02, 0.2
#: Thresholds of a decision: rows, groups of two rows or more, rows a group, their share of all rows, rows that break it, values that are decided, and the
#: share of groups that decide for nothing. Fixed values.
RULE_ROWS, RULE_GROUPS, GROUP_ROWS, COVERED, BROKEN, MODES, EMPTY_COVER = 30, 5, 3, 0.3, 0.02, 2, 0.2
_ID_LIKE = re.compile(r"(id|.*[ _-]id|id[ _-].*|.*Id|code|ref|reference|key|uuid|siret|siren|num|numero|number|no)")


def id_like(title: str) -> bool:
    """Whether a title is one of an identifier."""
    return bool(_ID_LIKE.fullmatch(title) or _ID_LIKE.fullmatch(fold_text(title).strip()))


def near_keys(df: DataFrame, columns: Sequence[str], rid: str) -> DataFrame:
    """(column_name, is_key, repeated_values, repeated_rows, examples): columns that are filled and different on every row, or but for few values.

    Of the columns that are filled and mostly different, those named like identifiers come first and at most KEY_COLUMNS are told of; only
    the first whole key is. Columns that aren't named so must be texts without spaces to be near keys. Examples are the up to three values
    that come back most often, first ones first. A row for each column reaches the driver.
    """
    counts = keep(cell_counts(df, columns, rid))
    t, n = F.col("t"), F.col("n")
    ok = t != ""
    dated, spaced, numeric = ok & date_key("t").isNotNull(), ok & t.rlike(r"\s"), ok & number("t").isNotNull()
    known = counts.groupBy("column_name").agg(
        F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(ok, n)), F.lit(0)).alias("filled"), F.count_if(ok).alias("different"), F.coalesce(F.sum(F.when(ok & (n > 1), n)), F.lit(0)).alias("repeated_rows"),
        F.count_if(dated).alias("dates"), F.count_if(spaced).alias("spaced"), F.count_if(numeric).alias("numbers"),
    )
    found = {r.column_name: r for r in known.collect()}
    likely = [c for c in columns if (x := found.get(c)) and x.rows >= KEY_ROWS and x.filled >= KEY_FILLED * x.rows and x.different >= KEY_DISTINCT * x.filled and x.dates < 0.5 * x.different]
    told, keyed = [], False
    for c in sorted(likely, key=lambda c: (not id_like(c), columns.index(c)))[:KEY_COLUMNS]:
        x = found[c]
        if x.repeated_rows == 0 and x.filled == x.rows:
            if not keyed:
                told.append((c, True))
                keyed = True
        elif x.repeated_rows and x.repeated_rows <= max(REPEATS_LEAST, x.filled * (REPEATS_OF_IDS if id_like(c) else REPEATS)) and (id_like(c) or (not x.spaced and x.numbers < 0.5 * x.different)):
            told.append((c, False))
    near = df.sparkSession.createDataFrame(told, "column_name string, is_key boolean")
    # values that come back are few here: at most a fifth of the rows
    back = counts.where(ok & (n > 1)).join(F.broadcast(near), "column_name").groupBy("column_name").agg(F.count("*").alias("repeated_values"), F.sum("n").alias("repeated_rows"), *[F.min(F.struct(-n, F.col("first"), t)).alias("most")])
    return near.join(back, "column_name", "left").select("column_name", "is_key", F.coalesce("repeated_values", F.lit(0)).alias("repeated_values"), F.coalesce("repeated_rows", F.lit(0)).alias("repeated_rows"), F.coalesce("most.t", F.lit("")).alias("example"))


def decisions(df: DataFrame, columns: Sequence[str], best: int = 3) -> DataFrame:
    """(decides, decided, cover, broken, groups): pairs of columns in which each value of the first comes with one of the second but for a few rows.

    Pairs are pruned by the distinct counts of their columns before any is counted: the first has from 2 to half as many values as there are
    rows and is filled in half of them, the second has no more values than the first but for a tenth and two, and less than nine tenths of the
    rows. The rest are counted together, with a partial aggregate by pair and both values. A pair's reverse isn't told beside it; of all the
    ``best`` with the least share of broken rows are. Values are trimmed, an empty one is one that can be decided but decides nothing.
    """
    sizes = {r.column_name: r for r in cell_counts(df, columns).groupBy("column_name").agg(F.sum("n").alias("rows"), F.count_if(F.col("t") != "").alias("different"), F.coalesce(F.sum(F.when(F.col("t") != "", F.col("n"))), F.lit(0)).alias("filled")).collect()}
    schema = "decides string, decided string, cover bigint, broken bigint, groups bigint"
    rows = max((x.rows for x in sizes.values()), default=0)
    first = [c for c in columns if c in sizes and 2 <= sizes[c].different <= rows / 2 and sizes[c].filled >= rows / 2]
    second = [c for c in columns if c in sizes and 2 <= sizes[c].different < 0.9 * rows]
    pairs = [(a, b) for a in first for b in second if a != b and sizes[b].different <= 1.1 * sizes[a].different + 2]
    if rows < RULE_ROWS or not pairs:
        return df.sparkSession.createDataFrame([], schema)
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("pair"), trimmed(a).alias("a"), trimmed(b).alias("b")) for k, (a, b) in enumerate(pairs)])).alias("c")
    counts = df.select(cells).select("c.*").where("a <> ''").groupBy("pair", "a", "b").agg(F.count("*").alias("n"))
    groups = counts.groupBy("pair", "a").agg(F.sum("n").alias("size"), F.max("n").alias("most"), F.min_by("b", F.struct(-F.col("n"), F.col("b"))).alias("usual")).where("size >= 2")
    modes = groups.groupBy("pair", "usual").agg(F.count("*").alias("groups"), F.sum("size").alias("cover"), F.sum(F.col("size") - F.col("most")).alias("broken"))
    found = modes.groupBy("pair").agg(F.sum("groups").alias("groups"), F.sum("cover").alias("cover"), F.sum("broken").alias("broken"), F.count("*").alias("modes"), F.coalesce(F.sum(F.when(F.col("usual") == "", F.col("cover"))), F.lit(0)).alias("for_nothing"))
    holds = (F.col("groups") >= RULE_GROUPS) & (F.col("cover") >= GROUP_ROWS * F.col("groups")) & (F.col("cover") >= COVERED * rows) & (F.col("broken") > 0) & (F.col("broken") <= BROKEN * F.col("cover")) & (F.col("broken") <= F.col("groups")) & (F.col("modes") >= MODES) & (F.col("for_nothing") <= EMPTY_COVER * F.col("cover"))
    told, seen = [], set()
    for r in found.where(holds).orderBy("pair").collect():  # at most a row for each pair of columns
        a, b = pairs[r.pair]
        if (b, a) not in seen:
            seen.add((a, b))
            told.append((a, b, r.cover, r.broken, r.groups))
    told.sort(key=lambda x: x[3] / x[2])
    return df.sparkSession.createDataFrame(told[:best], schema)
