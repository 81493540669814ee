"""Delimited text whose cells hold line breaks, in any encoding, read by many tasks.

Spark cuts files into blocks at line ends, wherever quotes are. A first pass tells for each block in which state it ends, inside a
quoted cell or not, for either state that it may begin in. These functions, a row for each block, are joined in order of the blocks,
which gives each block's real state. A second pass then cuts records; only those that lie across blocks are shuffled and put together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import encodings


@lru_cache(maxsize=16)
def _cell_end(delimiter: str) -> re.Pattern:
    """From behind an opening quote to behind its closing one and blanks: a closing quote is one before a delimiter or the line's end."""
    d = re.escape(delimiter)
    blank = "[ ]" if delimiter == "\t" else r"[ \t]"
    closing = rf'"{blank}*(?={d}|\r?\Z)'
    return re.compile(rf'((?>[^"]*(?:""[^"]*|(?!{closing})"[^"]*)*)){closing}')


def ends_inside(line: str, inside: bool, delimiter: str) -> bool:
    """Whether a line that begins inside a quoted cell, or not, ends inside one. A cell is quoted only if a quote is its first character."""
    end, at = _cell_end(delimiter), 0
    if inside:
        found = end.match(line)
        if not found:
            return True
        at = found.end() + 1
    while at < len(line):
        if line[at] == '"':
            found = end.match(line, at + 1)
            if not found:
                return True
            at = found.end() + 1
        else:
            at = line.find(delimiter, at) + 1
            if at == 0:
                return False
    return False


def cut(record: str, delimiter: str) -> tuple[list[str], int]:
    """The cells of a record, and how many of its quotes are wrong: quotes within a quoted cell that aren't doubled (kept as text), one never closed."""
    end, at, cells, wrong = _cell_end(delimiter), 0, [], 0
    record = record.removesuffix("\r")
    while True:
        if record[at : at + 1] == '"':
            found = end.match(record, at + 1)
            body = found.group(1) if found else record[at + 1 :]
            single = body.replace('""', "")
            wrong += single.count('"') + (not found)
            cells.append(body.replace('""', '"'))
            at = found.end() if found else len(record)
        else:
            stop = record.find(delimiter, at)
            stop = len(record) if stop < 0 else stop
            cells.append(record[at:stop])
            at = stop
        if at >= len(record):
            return cells, wrong
        at += len(delimiter)


def _lines(spark: SparkSession, path: str, enc: encodings.Encoding) -> DataFrame:
    """(file, block, raw): the lines of each block as bytes, in their order."""
    lines = spark.read.text(path, lineSep=enc.line_end.decode())
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("raw"))


def _decoded(batches: Iterator[pa.RecordBatch], enc: encodings.Encoding, lazy: bool) -> Iterator[tuple[tuple[str, int], str | None, bool]]:
    """((file, block), line, inside) one after the other; with ``lazy`` a line that can't hold a quote is None.

    What is cut at the bytes of a line break that lie across two characters of a wide encoding is put together again.
    """
    now, before, first = None, b"", True
    for b in encodings.portions(batches):
        files, blocks, raws = (b.column(c) for c in ("file", "block", "raw"))
        inside = b.column("inside").to_pylist() if "inside" in b.schema.names else [False] * b.num_rows
        for file, block, raw, within in zip(files.to_pylist(), blocks.to_pylist(), raws.to_pylist(), inside, strict=True):
            if (file, block) != now:
                if before:
                    raise ValueError(f"{now[0]}: bytes of a line break lie across two characters at the end of a block; read it with larger blocks")
                now, first = (file, block), True
            raw = before + raw if before else raw
            before = b""
            if len(raw) % enc.width:
                before = raw + enc.line_end
                continue
            if lazy and enc.plain_quotes and b'"' not in raw:
                yield now, None, within
            else:
                line = raw.decode(enc.codec, "replace")
                yield now, line.removeprefix("﻿") if first and block == 0 else line, within
            first = False


def _states(spark: SparkSession, path: str, enc: encodings.Encoding, delimiter: str) -> DataFrame:
    """(file, block, inside): the blocks that begin inside a quoted cell."""
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("from_outside", pa.bool_()), ("from_inside", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], list[bool]] = {}
        for block, line, _ in _decoded(batches, enc, True):
            ends = found.setdefault(block, [False, True])
            if line is not None and '"' in line:
                same = ends[0] == ends[1]
                ends[0] = ends_inside(line, ends[0], delimiter)
                ends[1] = ends[0] if same else ends_inside(line, ends[1], delimiter)
        yield pa.RecordBatch.from_pylist([{"file": f, "block": k, "from_outside": a, "from_inside": b} for (f, k), (a, b) in found.items()], schema)

    blocks = _lines(spark, path, enc).mapInArrow(run, "file string, block long, from_outside boolean, from_inside boolean")
    # a block that ends alike from both states decides what follows; blocks after it that keep the state change nothing, others turn it
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    turns = (F.col("from_outside") & ~F.col("from_inside")).cast("int")
    decided = F.when(F.col("from_outside") == F.col("from_inside"), F.struct(F.col("from_outside").alias("state"), F.col("turned")))
    counted = blocks.withColumn("turned", F.sum(turns).over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)))
    last = F.last(decided, ignorenulls=True).over(before)
    known = counted.select("file", "block", last.alias("last"), F.coalesce(F.lag("turned").over(Window.partitionBy("file").orderBy("block")), F.lit(0)).alias("so_far"))
    odd = (F.col("so_far") - F.coalesce(F.col("last.turned"), F.lit(0))) % 2 == 1
    return known.select("file", "block", (F.coalesce(F.col("last.state"), F.lit(False)) != odd).alias("inside"))


#: Endings of compressed files that Spark reads from their start only, each as one block. Fixed values.
UNCUT = (".gz", ".deflate", ".lz4", ".snappy", ".zst")

_RECORD = "file string, block long, part int, at long, cells array<string>, wrong int, raw string"
_RECORD_SCHEMA = pa.schema([("file", pa.string()), ("block", pa.int64()), ("part", pa.int32()), ("at", pa.int64()), ("cells", pa.list_(pa.string())), ("wrong", pa.int32()), ("raw", pa.string())])
#: Whole records, and the parts of those across blocks: what a block ends with, and what one begins with, up to its end or as a whole.
WHOLE, TAIL, HEAD = 0, 2, 1


def read_records(spark: SparkSession, path: str, delimiter: str = ",", encoding: str = "UTF-8", keep_raw: bool = False) -> DataFrame:
    """(file, block, at, cells, wrong_quotes): the records of delimited files with their places, which order them; with ``keep_raw`` their text too.

    A cell is quoted only if its first character is a quote; within it quotes are doubled; one that is neither doubled nor before a
    delimiter or line end is text, and counted. Empty lines outside of quotes are no records. A cell that is never closed reaches to the
    end of its file. Lines end in a line feed, also after a carriage return. Of each block one row is broadcast, if it begins inside a cell.
    Where all files are compressed ones that aren't cut into blocks, no record lies across blocks, and they are read once.
    """
    enc = encodings.encoding(encoding)
    lines = _lines(spark, path, enc)
    files = lines.inputFiles()
    uncut = bool(files) and all(f.endswith(UNCUT) for f in files)
    if not uncut:
        starts = _states(spark, path, enc, delimiter).where("inside")
        lines = lines.join(F.broadcast(starts), ["file", "block"], "left").select("file", "block", "raw", F.coalesce("inside", F.lit(False)).alias("inside"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, inside, part, at, size = None, [], False, WHOLE, 0, 0
        out: list[tuple] = []

        def end_block() -> None:
            if held and uncut:  # a cell never closed
                text = "\n".join(held)
                out.append((*now, WHOLE, at, *cut(text, delimiter), text if keep_raw else None))
            elif held:  # it goes on in the next block, as it may have begun in the one before
                out.append((*now, HEAD if part == HEAD else TAIL, at, None, 0, "\n".join(held)))

        def written() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[]] * len(_RECORD_SCHEMA)
            out.clear()
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _RECORD_SCHEMA, strict=True)], schema=_RECORD_SCHEMA)

        for block, line, within in _decoded(batches, enc, False):
            if block != now:
                end_block()
                if uncut and block[1]:
                    raise ValueError(f"{block[0]}: a codec that cuts files with this ending is not supported; name them otherwise")
                now, held, inside, part, at = block, [], within, HEAD if within else WHOLE, 0
            if not inside and line in ("", "\r"):
                continue
            held.append(line)
            if '"' in line:
                inside = ends_inside(line, inside, delimiter)
            if not inside:
                text = "\n".join(held)
                size += len(text)
                out.append((*now, part, at, *(cut(text, delimiter) if part == WHOLE else (None, 0)), text if part != WHOLE or keep_raw else None))
                held, part, at = [], WHOLE, at + 1
            if len(out) >= 2000 or size >= encodings.PORTION:
                yield written()
                size = 0
        end_block()
        yield written()

    pieces = lines.mapInArrow(run, _RECORD)
    whole = pieces.where(F.col("part") == WHOLE).select("file", "block", "at", "cells", F.col("wrong").alias("wrong_quotes"), *["raw"] * keep_raw)
    if uncut:
        return whole

    # a record across blocks: what one block ends with, and all that blocks after it begin with up to the next such end
    order = Window.partitionBy("file").orderBy("block", "part")
    across = pieces.where(F.col("part") != WHOLE).withColumn("begun", F.sum((F.col("part") == TAIL).cast("int")).over(order))
    joined = across.groupBy("file", "begun").agg(F.min("block").alias("block"), F.min_by("at", "block").alias("at"), F.array_sort(F.collect_list(F.struct("block", "raw"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["raw"]), "\n")

    def cut_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in encodings.portions(batches):
            done = [cut(t, delimiter) for t in b.column("text").to_pylist()]
            cut_batch = pa.record_batch([b.column("file"), b.column("block"), b.column("at"), pa.array([c for c, _ in done], pa.list_(pa.string())), pa.array([w for _, w in done], pa.int32())], names=["file", "block", "at", "cells", "wrong_quotes"])
            if keep_raw:
                yield pa.RecordBatch.from_arrays([*cut_batch.columns, b.column("text")], names=[*cut_batch.schema.names, "raw"])
            else:
                yield cut_batch

    mended = joined.select("file", "block", "at", text.alias("text")).mapInArrow(cut_all, "file string, block long, at long, cells array<string>, wrong_quotes int" + ", raw string" * keep_raw)
    return whole.unionByName(mended)


def head_bytes(spark: SparkSession, path: str, lines: int = 400) -> bytes:
    """The first lines of a file, then some of those with signs beyond ASCII, as bytes: what guesses look at."""
    raw = spark.read.text(path).select(F.col("value").cast("binary").alias("raw"), F.col("value").rlike(r"[^\x00-\x7F]").alias("high"))
    first = [bytes(r.raw) for r in raw.limit(lines).collect()]
    if any(max(x, default=0) > 0x7F or 0 in x or b"\x1b$" in x for x in first):
        return b"\n".join(first)
    return b"\n".join([*first, *(bytes(r.raw) for r in raw.where("high").limit(lines).collect())])


def decoded_lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """The lines of files in an encoding, without a carriage return at their end."""
    enc = encodings.encoding(encoding)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[str] = []
        size = 0
        for _, line, _ in _decoded(batches, enc, False):
            out.append(line.removesuffix("\r"))
            size += len(line)
            if len(out) >= 5000 or size >= encodings.PORTION:
                yield pa.record_batch([pa.array(out, pa.string())], names=["line"])
                out, size = [], 0
        yield pa.record_batch([pa.array(out, pa.string())], names=["line"])

    return _lines(spark, path, enc).mapInArrow(run, "line string")


def read_quoted(spark: SparkSession, path: str, delimiter: str = ",", header: bool = True, encoding: str = "UTF-8", wrong_quotes: str | None = None, rest: str | None = None) -> DataFrame:
    """The records as a table of text: missing and empty cells are empty. Columns are named by the first record of the first file, with ``header``,
    which then isn't a row of any file; else c1, c2, ... as wide as its first record. ``rest`` names a column for the cells beyond, as
    an array, ``wrong_quotes`` one for the count of wrong quotes.
    """
    enc = encodings.encoding(encoding)
    first = _first_record(head_bytes(spark, path), enc, delimiter)
    records = read_records(spark, path, delimiter, encoding)
    if header:
        records = records.where((F.col("block") > 0) | (F.col("at") > 0))
    titles = _titles(first) if header else [f"c{k}" for k in range(1, len(first) + 1)]
    cells = [F.coalesce(F.try_element_at("cells", F.lit(k)), F.lit("")).alias(t) for k, t in enumerate(titles, 1)]
    more = [F.slice("cells", len(titles) + 1, 1 << 30).alias(rest)] if rest else []
    return records.select(*cells, *more, *([F.col("wrong_quotes").alias(wrong_quotes)] if wrong_quotes else []))


def _first_record(head: bytes, enc: encodings.Encoding, delimiter: str) -> list[str]:
    whole = len(head) - len(head) % enc.width
    lines = head[:whole].decode(enc.codec, "replace").removeprefix("﻿").split("\n")
    held: list[str] = []
    for line in lines:
        if held or line not in ("", "\r"):
            held.append(line)
            if not ends_inside("\n".join(held), False, delimiter):
                break
    return cut("\n".join(held), delimiter)[0] if held else []


def _titles(cells: list[str]) -> list[str]:
    """Titles as they are, empty ones as Column k, and a number behind one that another column has already, whatever its case."""
    out: list[str] = []
    taken: set[str] = set()
    for k, cell in enumerate(cells, 1):
        name = stem = cell.strip() or f"Column {k}"
        n = 2
        while name.lower() in taken:
            name, n = f"{stem} {n}", n + 1
        taken.add(name.lower())
        out.append(name)
    return out
