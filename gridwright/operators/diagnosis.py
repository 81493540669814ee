"""Why a row of a delimited file looks wrong: what is off in its text and bytes, and a repair where one is safe."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import repaired_text
from ..plans.durable import keep
from ..sources import encodings
from ..sources.quoted import _cell_end, cut, read_records

#: Kinds of damage and how bad each is. Fixed values.
SEVERITY = {
    "extra-fields": "error", "trailing-delimiter": "warn", "split-line": "error", "missing-fields": "warn", "unclosed-quote": "error", "runaway-quote": "error", "text-after-quote": "warn",
    "space-before-quote": "warn", "quote-inside": "info", "multiline": "info", "nul": "error", "replacement": "error", "invisible": "info", "mojibake": "warn", "utf8-line": "error", "cp1252": "info", "formula": "info",
}
#: What a cell looks like, for Java and Python alike; anything else that is filled is text.
LOOKS = {"date": r"[0-9]{1,4}([-/.])[0-9]{1,2}\1[0-9]{1,4}(?:[T ].*)?", "number": r"[+-]?[0-9][0-9 .,'   ]*%?"}
#: Characters that aren't seen, but for the pair of a joiner between pictures.
_UNSEEN = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\xad​-‏‪-‮⁠-⁤﻿�]")
#: Weights of a cell in the column of its kind, of an empty one, of a delimiter before a space, of a column of text. Fixed values.
FITS, EMPTY_FITS, BEFORE_SPACE, TEXT_COLUMN = 1.0, 0.5, 0.75, 0.25
_SIGNS = re.compile(r"[+-]?[0-9\s.,]+")


@dataclass
class Field:
    start: int
    end: int
    value: str
    issues: list[tuple[str, int]] = field(default_factory=list)


def fields_of(record: str, delimiter: str) -> list[Field]:
    """The cells of a record with their places and what is odd about their quotes; the same cells as ``quoted.cut`` gives."""
    closing, out, at = _cell_end(delimiter), [], 0
    while True:
        if record[at : at + 1] == '"':
            found = closing.match(record, at + 1)
            body = found.group(1) if found else record[at + 1 :]
            one = Field(at, found.end() if found else len(record), body.replace('""', '"'))
            stray = re.search(r'(?<!")"(?:"")*(?!")', body)
            if stray:
                one.issues.append(("runaway-quote" if "\n" in body else "text-after-quote", at + 1 + stray.end()))
            if not found:
                one.issues.append(("unclosed-quote", at))
        else:
            stop = record.find(delimiter, at)
            stop = len(record) if stop < 0 else stop
            one = Field(at, stop, record[at:stop])
            if '"' in one.value:
                one.issues.append(("space-before-quote" if one.value.lstrip(" ").startswith('"') else "quote-inside", at + one.value.index('"')))
        out.append(one)
        if one.end >= len(record):
            return out
        at = one.end + len(delimiter)


def look(cell: str) -> str:
    return next((name for name, shape in LOOKS.items() if re.fullmatch(shape, cell.strip())), "text" if cell.strip() else "")


@dataclass(frozen=True)
class Usual:
    """What the file's rows are like: its delimiter, encoding, titles and the usual look of each column."""

    delimiter: str
    encoding: str
    titles: tuple[str, ...]
    looks: tuple[str, ...]

    @property
    def width(self) -> int:
        return max(1, len(self.titles))


def _is_formula(cell: str) -> bool:
    return cell[:1] in tuple("=+-@\t\r") and not _SIGNS.fullmatch(cell) and cell.strip("-") != ""


def _pictured(ch: str) -> bool:
    return bool(ch) and (unicodedata.category(ch) in ("So", "Sk") or ord(ch) == 0xFE0F)


def diagnose_record(record: str, following: str | None, usual: Usual) -> dict:
    """Findings of one record, the cause of a wrong number of fields, and a repair; ``following`` is the next record of the file."""
    enc = encodings.encoding(usual.encoding)
    record = record.removesuffix("\r")
    cells = fields_of(record, usual.delimiter)
    values = [f.value for f in cells]
    out: dict = {"observed": len(cells), "expected": usual.width, "findings": [], "cause": None, "repair": None, "repaired": None}
    raw = record.encode(enc.codec, "replace")

    def add(kind: str, column: int | None, detail: str, at: int | None, length: int = 1) -> None:
        place = None if at is None else len(record[:at].encode(enc.codec, "replace"))
        hit = None if at is None else record[at : at + length].encode(enc.codec, "replace").hex(" ").upper() or None
        out["findings"].append({"kind": kind, "severity": SEVERITY[kind], "column": column, "detail": detail, "at_byte": place, "bytes": hit})

    def propose(kind: str, repaired: Sequence[str], cause: str | None = None) -> None:
        out.update(repair=kind, repaired=list(repaired), cause=cause or out["cause"])

    named = lambda k: usual.titles[k] if k < len(usual.titles) else f"field {k + 1}"
    more = len(cells) - usual.width
    if more > 0:
        _too_many(cells, record, usual, add, propose, out, named)
    elif more < 0:
        rest = cut(following, usual.delimiter)[0] if following is not None else []
        if rest and len(cells) + len(rest) - 1 == usual.width:
            add("split-line", len(cells), f"{len(cells)} fields here and {len(rest)} on the next line make {usual.width}", len(record))
            propose("join", [*values[:-1], values[-1] + "\n" + rest[0], *rest[1:]], "an unquoted line break")
        else:
            add("missing-fields", None, f"{-more} of {usual.width} fields are missing", None)
            propose("pad", values + [""] * -more, "fields are missing at the end")
    for k, f in enumerate(cells):
        for kind, at in f.issues:
            add(kind, k + 1, f"quotes of {named(k)}", at)
    breaks = record.count("\n")
    if breaks and not any(x["kind"] in ("runaway-quote", "unclosed-quote") for x in out["findings"]):
        add("multiline", None, f"{breaks + 1} lines", record.index("\n"))
    _characters(record, cells, add)
    _encoding(record, raw, enc, usual, add, propose, out)
    first = next((k for k, v in enumerate(values) if _is_formula(v)), None)
    if first is not None:
        add("formula", first + 1, f"{named(first)} starts with {values[first][0]!r}", cells[first].start)
    return out


def _too_many(cells, record, usual, add, propose, out, named) -> None:
    """Empty fields at the end are dropped; else each run of fields that could be one is tried, and rows in which columns look as usual score best."""
    more, values = len(cells) - usual.width, [f.value for f in cells]
    if not any(values[usual.width :]):
        add("trailing-delimiter", None, f"{more} empty fields at the end", cells[usual.width].start - 1)
        propose("trim", values[: usual.width], "a delimiter at the end of the line")
        return
    scores = []
    for p in range(usual.width):
        row = [*values[:p], usual.delimiter.join(values[p : p + more + 1]), *values[p + more + 1 :]]
        score = TEXT_COLUMN * (usual.looks[p] == "text")
        score += sum(EMPTY_FITS if not look(v) or not kind else FITS * (look(v) == kind) for v, kind in zip(row, usual.looks, strict=True))
        score += BEFORE_SPACE * sum(record[f.end + len(usual.delimiter) :].startswith(" ") for f in cells[p : p + more])
        scores.append((score, p, row))
    best = max(s[0] for s in scores)
    first = next(s for s in scores if s[0] == best)
    sure = sum(s[0] == best for s in scores) == 1
    add("extra-fields", first[1] + 1, f"{'' if sure else 'perhaps '}an unquoted delimiter in {named(first[1])}", cells[first[1]].end)
    propose("merge", first[2], f"an unquoted delimiter{'' if sure else ', perhaps'} in {named(first[1])}")


def _characters(record: str, cells: list[Field], add) -> None:
    seen: set[str] = set()
    for found in _UNSEEN.finditer(record):
        ch, at = found.group(), found.start()
        if ch in seen or (ch == "‍" and _pictured(record[at - 1 : at]) and _pictured(record[at + 1 : at + 2])):
            continue
        if ch == "‍" and at > 1 and unicodedata.category(record[at - 1]) in ("Sk", "Mn") and _pictured(record[at + 1 : at + 2]):
            continue
        seen.add(ch)
        column = next((k for k, f in enumerate(cells, 1) if f.start <= at < max(f.end, f.start + 1)), None)
        add("nul" if ch == "\0" else "replacement" if ch == "�" else "invisible", column, f"U+{ord(ch):04X}", at)


def _encoding(record, raw, enc, usual, add, propose, out) -> None:
    high = next((k for k, ch in enumerate(record) if ch > "\x7f"), None)
    if high is None or enc.width > 1:
        return
    if enc.name == "UTF-8":
        fixed = repaired_text(record)
        if fixed != record:
            at = next(k for k, (a, b) in enumerate(zip(record, fixed + "\0" * len(record), strict=False)) if a != b)
            add("mojibake", None, "UTF-8 that was read as windows-1252", at)
        return
    try:
        line = raw.decode()
    except UnicodeDecodeError:
        if enc.codec == "cp1252":
            add("cp1252", None, f"{sum(b > 0x7F for b in raw)} bytes beyond ASCII, not UTF-8", high)
        return
    add("utf8-line", None, "this line is UTF-8", high, 2)
    if out["repair"] is None:
        propose("reencode", cut(line, usual.delimiter)[0])


_FINDING = pa.struct([("kind", pa.string()), ("severity", pa.string()), ("column", pa.int32()), ("detail", pa.string()), ("at_byte", pa.int64()), ("bytes", pa.string())])
_FOUND = [("file", pa.string()), ("block", pa.int64()), ("at", pa.int64()), ("raw", pa.string()), ("observed", pa.int32()), ("expected", pa.int32()), ("findings", pa.list_(_FINDING)), ("cause", pa.string()), ("repair", pa.string()), ("repaired", pa.list_(pa.string())), ("edge", pa.string())]
_SCHEMA = pa.schema(_FOUND)
_DDL = "file string, block long, at long, raw string, observed int, expected int, findings array<struct<kind: string, severity: string, column: int, detail: string, at_byte: long, bytes: string>>, cause string, repair string, repaired array<string>, edge string"


def usual_rows(records: DataFrame, titles: Sequence[str], delimiter: str, encoding: str) -> Usual:
    """The usual look of each column: that of most filled cells (three of five), else text. One row reaches the driver."""
    counts = []
    for k in range(1, len(titles) + 1):
        cell = F.trim(F.coalesce(F.try_element_at("cells", F.lit(k)), F.lit("")))
        is_date, is_number = (cell.rlike(f"^(?:{LOOKS[x]})$") for x in ("date", "number"))
        counts += [F.count_if(cell != ""), F.count_if(is_date), F.count_if(is_number & ~is_date)]
    seen = list(records.agg(*[c.alias(f"n{i}") for i, c in enumerate(counts)]).first())
    looks = []
    for filled, dates, numbers in zip(seen[::3], seen[1::3], seen[2::3], strict=True):
        looks.append("" if not filled else "date" if dates >= 0.6 * filled else "number" if numbers >= 0.6 * filled else "text")
    return Usual(delimiter, encoding, tuple(titles), tuple(looks))


def diagnose(spark: SparkSession, path: str, titles: Sequence[str], delimiter: str = ",", encoding: str = "UTF-8", header: bool = True) -> DataFrame:
    """(file, block, at, raw, observed, expected, findings, cause, repair, repaired): a row for each record of delimited files.

    Findings are those of ``SEVERITY``, with the column, and the byte where it starts and its bytes. A repair is a list of cells: empty ones
    at the end dropped (trim), fields cut by an unquoted delimiter made one (merge), a row cut by a line break joined with the next (join),
    missing ones added (pad), a line read as UTF-8 (reencode). ``titles`` tell how many fields are expected; the first record of each file
    is left out with ``header``. Rows of a block are read as a stream, in which the next one follows; the last ones of blocks and those
    across blocks find theirs among the blocks' first ones, of which there are few.
    """
    records = keep(read_records(spark, path, delimiter, encoding, keep_raw=True).where((F.col("block") > 0) | (F.col("at") > 0) | F.lit(not header)))
    usual = usual_rows(records, titles, delimiter, encoding)

    def row(file, block, at, raw, following, edge) -> dict:
        return {"file": file, "block": block, "at": at, "raw": raw.removesuffix("\r"), "edge": edge, **diagnose_record(raw, following, usual)}

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first = None, True
        for b in encodings.portions(batches):
            out = []
            for now in zip(*(b.column(c).to_pylist() for c in ("file", "block", "at", "raw")), strict=True):
                if held is not None:
                    last = held[:2] != now[:2]
                    out.append(row(*held, None if last else now[3], ("first " if first else "") + ("last" if last else "")))
                    first = last
                held = now
            yield pa.RecordBatch.from_pylist(out, _SCHEMA)
        if held is not None:
            yield pa.RecordBatch.from_pylist([row(*held, None, ("first " if first else "") + "last")], _SCHEMA)

    ordered = records.repartitionByRange("file", "block").sortWithinPartitions("file", "block", "at").select("file", "block", "at", "raw")
    found = keep(ordered.mapInArrow(stream, _DDL))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in encodings.portions(batches):
            rows = zip(*(b.column(c).to_pylist() for c in ("file", "block", "at", "raw", "following")), strict=True)
            yield pa.RecordBatch.from_pylist([row(*r, "") for r in rows], _SCHEMA)

    edges = found.where("edge <> ''").withColumn("following", F.lead("raw").over(Window.partitionBy("file").orderBy("block", "at")))
    short = edges.where(F.col("edge").contains("last") & (F.col("observed") < F.col("expected"))).select("file", "block", "at", "raw", "following")
    inner = found.where(~(F.col("edge").contains("last") & (F.col("observed") < F.col("expected"))))
    return inner.unionByName(short.mapInArrow(again, _DDL)).drop("edge")
