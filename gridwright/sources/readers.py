"""Reading tables: delimited text, raw lines, JSON and Parquet, all with their cells as text where asked."""

from __future__ import annotations

import csv
import io
import re
from collections import Counter
from collections.abc import Sequence
from pathlib import PurePath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..functions.text import cell_text
from . import encodings
from .quoted import decoded_lines, head_bytes, read_quoted

DELIMITERS = (";", ",", "\t", "|")


def guess_delimiter(head: str) -> str | None:
    """The candidate that cuts the first lines most regularly, quotes respected; None for raw text."""
    best, found = 0.0, None
    for d in DELIMITERS:
        widths = [len(r) for r in csv.reader(io.StringIO(head), delimiter=d) if r][:200]
        if not widths:
            continue
        width, n = Counter(widths).most_common(1)[0]
        regular = n / len(widths)
        if width > 1 and regular >= 0.6 and (regular, width) > (best, 0):
            best, found = regular, d
    return found


#: What a cell of a file's head looks like, tried in this order; anything else is text.
_LOOKS = {
    "year": r"1[89][0-9]{2}|2[01][0-9]{2}",
    "date": r"[0-9]{1,4}([-/.])[0-9]{1,2}\1[0-9]{1,4}(?:[T ].*)?",
    "number": r"[+-]?(?:[0-9][0-9 .,\u00a0\u202f]*|[.,][0-9]+)%?",
}


def _look(cell: str) -> str:
    return next((name for name, shape in _LOOKS.items() if re.fullmatch(shape, cell)), "text")


def guess_header(head: Sequence[Sequence[str]]) -> bool:
    """Whether the first of a few rows holds titles, by the evidence of each column.

    A title of another look than most of its values speaks for a header by their share, one of the same look against it,
    and so does a number or date above text. Text above text tells nothing. Where columns don't tell, or not more for than
    against, titles are filled for the most part, short, all different and none a value of its column; a file of one row
    has a header if most of it is text.
    """
    if not head or not any(cell.strip() for cell in head[0]):
        return False
    rows = [[cell.strip() for cell in row] for row in head[:6]]
    titles, columns = rows[0], [[row[k] for row in rows[1:] if k < len(row) and row[k]] for k in range(len(rows[0]))]
    evidence = 0.0
    for title, values in zip(titles, columns, strict=True):
        if title and values:
            usual, n = Counter(map(_look, values)).most_common(1)[0]
            look = _look(title)
            if (look, usual) != ("text", "text"):
                evidence += (n if look != usual and usual != "text" else -n) / len(values)
    if evidence:
        return evidence > 0
    filled = [title.lower() for title in titles if title]
    if len(rows) == 1:
        return 3 * sum(_look(title) == "text" for title in filled) >= 2 * len(filled)
    repeated = any(title and title.lower() in map(str.lower, values) for title, values in zip(titles, columns, strict=True))
    return 2 * len(filled) >= len(titles) and len(set(filled)) == len(filled) and max(map(len, filled)) <= 60 and not repeated


def guess_encoding(head: bytes) -> str:
    """The name of the encoding that some bytes are in, one that all readers know."""
    return encodings.guess(head).name


def read_delimited(spark: SparkSession, path: str, delimiter: str | None = None, header: bool | None = None, encoding: str | None = "UTF-8", breaks_in_cells: bool | None = None) -> DataFrame:
    """All columns as text. Without ``delimiter``, ``header`` and ``encoding`` (None) the head of the file decides; a file without a delimiter is read as lines.

    Files are split at line ends. Where quoted cells hold line breaks, so that some line has an odd number of quotes, and in
    all encodings but UTF-8, records are cut by ``quoted.read_quoted``, by many tasks too; without ``breaks_in_cells`` a pass over the
    lines tells.
    """
    enc = encodings.encoding(encoding) if encoding else None
    lines = spark.read.text(path)
    head: list[str] = []
    if delimiter is None or header is None or enc is None:
        sample = head_bytes(spark, path)
        enc = enc or encodings.guess(sample)
        head = sample[: len(sample) - len(sample) % enc.width].decode(enc.codec, "replace").removeprefix("\ufeff").replace("\r\n", "\n").split("\n")[:200]
    if delimiter is None:
        delimiter = guess_delimiter("\n".join(head))
        if delimiter is None:
            return read_lines(spark, path, enc.name)
    if header is None:
        header = guess_header(list(csv.reader(io.StringIO("\n".join(head)), delimiter=delimiter))[:6])
    if breaks_in_cells is None and enc.name == "UTF-8":
        odd = (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1
        breaks_in_cells = not lines.where(odd).isEmpty()
    if breaks_in_cells or enc.name != "UTF-8":
        return read_quoted(spark, path, delimiter, header, enc.name)
    return spark.read.csv(path, sep=delimiter, header=header, quote='"', escape='"', inferSchema=False)


def read_lines(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    if encodings.encoding(encoding).name != "UTF-8":
        return decoded_lines(spark, path, encoding)
    return spark.read.text(path).withColumnRenamed("value", "line")


def flatten(df: DataFrame) -> DataFrame:
    """Nested fields as columns joined by a dot, lists as JSON text."""
    while any(isinstance(f.dataType, StructType) for f in df.schema):
        columns = []
        for f in df.schema:
            if isinstance(f.dataType, StructType):
                columns += [F.col(f"`{f.name}`").getField(x).alias(f"{f.name}.{x}") for x in f.dataType.names]
            else:
                columns.append(F.col(f"`{f.name}`"))
        df = df.select(*columns)
    return df.select(*[(F.to_json(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, ArrayType) else F.col(f"`{f.name}`")) for f in df.schema])


def read_json(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    return flatten(spark.read.json(path, multiLine=not lines, primitivesAsString=True))


def as_cells(df: DataFrame) -> DataFrame:
    """Every column as the text of its cells."""
    return df.select(*[cell_text(F.col(f"`{n}`"), t).alias(n) for n, t in df.dtypes])


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """By the name's ending: csv, tsv, txt, json, jsonl or parquet, compressed or not."""
    endings = [s.lower() for s in PurePath(path).suffixes if s.lower() not in (".gz", ".zst", ".bz2")]
    kind = endings[-1] if endings else ""
    readers = {".parquet": lambda: spark.read.parquet(path), ".json": lambda: read_json(spark, path, lines=False), ".jsonl": lambda: read_json(spark, path), ".tsv": lambda: read_delimited(spark, path, "\t"), ".log": lambda: read_lines(spark, path)}
    return readers.get(kind, lambda: read_delimited(spark, path))()
