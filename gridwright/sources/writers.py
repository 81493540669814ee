"""Writing tables: delimited text, JSON lines, typed Parquet, Markdown and HTML lines."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import number, text
from ..operators.quality import infer
from . import encodings


def write_delimited(df: DataFrame, path: str, delimiter: str = ",", compression: str | None = None) -> None:
    df.write.csv(path, sep=delimiter, header=True, quote='"', escape='"', compression=compression, emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_encoded(df: DataFrame, path: str, encoding: str, delimiter: str = ",", header: bool = True, compression: str | None = None) -> None:
    """Delimited text in any encoding of ``encodings.CODECS``; a sign that it lacks is refused. Cells with a delimiter, quote or break are quoted.

    With ``compression``, a codec of Spark's for text, wide encodings take little more disk than narrow ones. A file of ``gzip`` isn't cut into
    blocks: one task reads what one has written. It is written at zlib's best speed, as the usual level takes up to three times as long.
    """
    enc = encodings.encoding(encoding)
    odd = "[" + "".join("\\" + x for x in ('"', delimiter)) + "\r\n]"
    cell = lambda x: F.when(x.rlike(odd) | x.rlike("^ | $"), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)
    titles = ['"' + c.replace('"', '""') + '"' if any(x in c for x in ('"', delimiter, "\n")) else c for c in df.columns]
    lines = df.select(F.concat_ws(delimiter, *[cell(text(f"`{c}`")) for c in df.columns]).alias("value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = header
        for b in encodings.portions(batches):
            made = [line.encode(enc.codec) for line in b.column(0).to_pylist()]
            if first and made:
                made.insert(0, delimiter.join(titles).encode(enc.codec))
                first = False
            yield pa.record_batch([pa.array(made, pa.binary())], names=["value"])

    lines.mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.option("zlib.compress.level", "BEST_SPEED").text(path, compression=compression, lineSep=enc.line_end.decode())


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path, ignoreNullFields=False)


def typed_columns(df: DataFrame) -> DataFrame:
    """Text columns with the type that all their cells have, told by one more pass; empty cells are null.

    A column keeps its text where a cell would lose by the change: whole numbers with leading zeros or of over 18 digits,
    numbers of over 15 digits.
    """
    types = {r.column_name: r.type for r in infer(df, df.columns).collect()}  # a row for each column
    s = {c: F.trim(text(f"`{c}`")) for c in df.columns}
    lossy = {"integer": lambda x: x.rlike("^[+-]?0[0-9]") | (F.length(x) > 18), "number": lambda x: x.rlike("^[+-]?0[0-9]") | (F.length(F.regexp_replace(x, "[^0-9]", "")) > 15)}
    asked = [c for c in df.columns if types[c] in lossy]
    loses = df.agg(*[F.coalesce(F.max(lossy[types[c]](s[c])), F.lit(False)).alias(f"c{i}") for i, c in enumerate(asked)]).first() if asked else []
    kept = {c for c, bad in zip(asked, loses, strict=True) if bad}
    read = {
        "integer": lambda c: s[c].try_cast("long"),
        "number": lambda c: number(f"`{c}`"),
        "boolean": lambda c: F.when(F.lower(s[c]).isin("true", "yes", "oui", "vrai"), True).when(s[c] != "", False),
    }
    return df.select(*[(read[types[c]](c) if types[c] in read and c not in kept else F.col(f"`{c}`")).alias(c) for c in df.columns])


def write_typed_parquet(df: DataFrame, path: str) -> None:
    typed_columns(df).write.parquet(path, compression="zstd")


def markdown_lines(df: DataFrame) -> DataFrame:
    """Each row as a line of a Markdown table (the two lines of its head are in ``markdown_head``)."""
    cells = [F.regexp_replace(F.replace(text(f"`{c}`"), F.lit("|"), F.lit("\\|")), "[\r\n]+", " ") for c in df.columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def markdown_head(df: DataFrame) -> list[str]:
    return ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]


def html_rows(df: DataFrame) -> DataFrame:
    """Each row as a row of an HTML table (its head is ``html_head``)."""
    escape = lambda x: F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    cells = [F.concat(F.lit("<td>"), escape(text(f"`{c}`")), F.lit("</td>")) for c in df.columns]
    return df.select(F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("line"))


def html_head(df: DataFrame) -> str:
    from html import escape

    return "<tr>" + "".join(f"<th>{escape(c, quote=False)}</th>" for c in df.columns) + "</tr>"
