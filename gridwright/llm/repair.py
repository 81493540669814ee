"""Conversation structure repair: the cheapest edits that make roles alternate, by A* on a lattice of rows and states."""

from __future__ import annotations

import hashlib
import heapq
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE

#: Costs of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: What a row suffers from, by its first fault.
FINE, BLANK, DUPLICATE, CUT = range(4)
#: States of ``(s?(ua)+)?``: nothing yet, after a system, a user and an assistant row. It may end in the first and last.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Rows that are searched together: longer conversations go from block to block by the best ways to each state.
BLOCK = 512
#: From any state what remains costs at most so much more than from any other: two insertions and a deleted system row.
SLACK = 2 * INSERT + DELETE


def _next(state: int) -> int:
    """The only user or assistant state that may follow."""
    return ASSISTANT if state == USER else USER


def _kept(state: int, initial: str) -> int | None:
    """The state after a row that stays as it is; None where it may not stand there."""
    if initial == "s":
        return SYSTEM if state == START else None
    return _next(state) if initial == ("a" if state == USER else "u") else None


def search(rows: list[tuple[str, int]], begin: int, ends: frozenset[int], first_only: bool) -> dict[int, tuple[int, str]]:
    """The cheapest edits of ``rows`` (role initial, fault) from a state to each of ``ends``: (cost, initials in order), ties ASCII-least.

    A* over (rows done, state). The heuristic sums what the rows ahead cost in any case: a deletion where it must be, and
    for a truncated row the charge for keeping it, which is less than deleting it. It is admissible and consistent, so the first
    time that a node leaves the queue, which is ordered by (cost plus heuristic, audit), its way is the cheapest and of those
    the least: of two ways of one cost to a node neither begins with the other. With ``first_only`` it ends at the first of ``ends``.
    """
    ahead = [0] * (len(rows) + 1)
    for k in range(len(rows) - 1, -1, -1):
        ahead[k] = ahead[k + 1] + (DELETE if rows[k][1] in (BLANK, DUPLICATE) else TRUNCATED if rows[k][1] == CUT else 0)
    queue, done, found = [(ahead[0], "", 0, begin)], set(), {}
    while queue:
        total, audit, k, state = heapq.heappop(queue)
        if (k, state) in done:
            continue
        done.add((k, state))
        cost = total - ahead[k]
        if k == len(rows) and state in ends:
            found[state] = (cost, audit)
            if first_only or len(found) == len(ends):
                break
        ways = [(INSERT, "I", k, _next(state))]
        if k < len(rows):
            initial, fault = rows[k]
            ways.append((DELETE, "D", k + 1, state))
            if fault in (FINE, CUT):
                charge = TRUNCATED if fault == CUT else 0
                ways.append((REROLE + charge, "R", k + 1, _next(state)))
                if (then := _kept(state, initial)) is not None:
                    ways.append((charge, "K", k + 1, then))
        for price, edit, at, then in ways:
            if (at, then) not in done:
                heapq.heappush(queue, (cost + price + ahead[at], audit + edit, at, then))
    return found


@dataclass
class Repair:
    """One conversation, whose rows come in order. ``emit`` gets (edit, role, text) of each repaired row as soon as it is certain.

    Held are the rows not yet decided, 16 bytes of each different row, and one character an edit.
    """

    emit: Callable[[str, str, str], None]
    counts: list[int] = field(default_factory=lambda: [0] * 4)
    illegal: int = 0
    turns: int = 0
    first_turn: int | None = None
    last_turn: int | None = None
    before: str | None = None
    seen: set[bytes] = field(default_factory=set)
    waiting: list[tuple[str, str]] = field(default_factory=list)
    block: list[tuple[str, int]] = field(default_factory=list)
    ways: dict[int, tuple[int, str]] = field(default_factory=lambda: {START: (0, "")})
    settled: int = START
    audit: list[str] = field(default_factory=list)

    def add(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        mark = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
        bare = text.rstrip(ASCII_SPACE)
        fault = BLANK if not bare else DUPLICATE if mark in self.seen else FINE if bare[-1] in ".!?" else CUT
        self.seen.add(mark)
        self.counts[fault] += 1
        if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = role[:1]
        if len(self.block) == BLOCK:
            self._advance(frozenset(range(4)), False)
        self.block.append((role[:1], fault))
        self.waiting.append((role, text))

    def _advance(self, ends: frozenset[int], last: bool) -> None:
        """The best ways to each state through the block; what all of them have in common is decided."""
        best: dict[int, tuple[int, str]] = {}
        for state, (cost, audit) in self.ways.items():
            for end, (more, edits) in search(self.block, state, ends, last and len(self.ways) == 1).items():
                way = (cost + more, audit + edits)
                best[end] = min(best.get(end, way), way)
        least = min(cost for cost, _ in best.values())
        self.ways = {s: w for s, w in best.items() if w[0] <= least + SLACK}
        self.block = []
        if not last:
            self._decide(os.path.commonprefix([audit for _, audit in self.ways.values()]))

    def _decide(self, edits: str) -> None:
        done = 0
        for edit in edits:
            if edit == "I":
                role, text = None, ""
            else:
                (role, text), done = self.waiting[done], done + 1
            if edit == "D":
                continue
            self.settled = _kept(self.settled, role[:1]) if edit == "K" else _next(self.settled)
            if edit != "K":
                role = "assistant" if self.settled == ASSISTANT else "user"
            self.emit(edit, role, text)
        del self.waiting[:done]
        self.audit.append(edits)
        self.ways = {s: (cost, audit[len(edits) :]) for s, (cost, audit) in self.ways.items()}

    def finish(self) -> dict[str, int | str]:
        self._advance(frozenset((START, ASSISTANT)), True)
        cost, edits = min(self.ways.values())
        self.ways = {}
        self._decide(edits)
        gaps = self.last_turn - self.first_turn + 1 - self.turns if self.turns else 0
        return {"gaps": gaps, "blank": self.counts[BLANK], "duplicate": self.counts[DUPLICATE], "truncated": self.counts[CUT], "illegal": self.illegal, "cost": cost, "audit": "".join(self.audit)}


def _in_order(rows: DataFrame) -> DataFrame:
    """One shuffle by conversation; rows sorted by turn (null first), role and text, those without a row (``there`` is false) too."""
    there = F.col("there") if "there" in rows.columns else F.lit(True)
    nulls = [F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")]
    table = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *nulls, there.alias("there"))
    return table.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")


def _conversations(batches: Iterator[pa.RecordBatch], begin: Callable[[int | None], Callable[[str, str, str], None]]) -> Iterator[tuple[int | None, Repair | None]]:
    """Repairs of conversations as their rows pass by, each given when its last row has; after each batch (None, None), to write out what there is."""
    now, repair = None, None
    for b in batches:
        for conv, turn, role, text, there in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if repair is None or conv != now:
                if repair is not None:
                    yield now, repair
                now, repair = conv, Repair(begin(conv))
            if there:
                repair.add(turn, role, text)
        yield None, None
    if repair is not None:
        yield now, repair


_REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repair_report(rows: DataFrame) -> DataFrame:
    """A row for each conv_id of ``rows`` (conv_id, turn, role, text): counts of its faults, cost and initials of the cheapest edits,
    and the SHA-256 of the repaired ``role:text`` lines.

    A row's fault is the first of blank (no sign but white space), duplicate (role and text were there before) and truncated
    (its last sign isn't one of ``.!?``). Blank and duplicate rows must be deleted (4); any other row may be deleted, kept or
    given another role (3), and costs 3 more if it is truncated and stays; empty user and assistant rows may be inserted (3).
    Initials of the roles must then be ``(s?(ua)+)?``. Ties go to the ASCII-least initials of edits.

    Null roles and texts are one space, a null conv_id is a conversation of its own, null turns come first, rows of one turn
    are ordered by role and text. Where ``rows`` has a boolean ``there``, rows without it only name their conversation; one with
    no other rows has zeros, an empty audit and the hash of nothing. Other columns, whatever their names, are not read. An empty
    table gives no rows. Very long texts are read whole. A conversation passes through one task as a stream: rows are dropped as
    soon as all ways that can still be the best agree about them.
    """
    schema = pa.schema([(n, pa.string() if t == "string" else pa.int64()) for n, t in (x.split() for x in _REPORT.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}

        def begin(conv: int | None) -> Callable[[str, str, str], None]:
            digest = state["digest"] = hashlib.sha256()
            lines = iter([""])

            def emit(edit: str, role: str, text: str) -> None:
                digest.update(f"{next(lines, chr(10))}{role}:{text}".encode())

            return emit

        out: list[dict] = []
        for conv, repair in _conversations(batches, begin):
            if repair is not None:
                report = repair.finish()
                out.append({"conv_id": conv, **report, "repaired_sha256": state["digest"].hexdigest()})
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        yield pa.RecordBatch.from_pylist(out, schema)

    return _in_order(rows).mapInArrow(run, _REPORT)


_TURNS = "conv_id long, place long, edit string, role string, text string"


def repaired_turns(rows: DataFrame) -> DataFrame:
    """The repaired conversations: (conv_id, place from 0, edit, role, text), a row for each that was kept (K), given another role (R) or inserted (I).

    Same rules and same defined cases as :func:`repair_report`.
    """
    schema = pa.schema([(n, pa.string() if t == "string" else pa.int64()) for n, t in (x.split() for x in _TURNS.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def begin(conv: int | None) -> Callable[[str, str, str], None]:
            place = iter(range(1 << 62))
            return lambda edit, role, text: out.append((conv, next(place), edit, role, text))

        def written() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[]] * len(schema)
            out.clear()
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for _, repair in _conversations(batches, begin):
            if repair is not None:
                repair.finish()
            else:
                yield written()
        yield written()

    return _in_order(rows).mapInArrow(run, _TURNS)


def damage(rows: DataFrame) -> DataFrame:
    """``rows`` spoilt by the crc32 of ``conv_id:turn``, modulo 20: dropped (0: ``there`` is false), emptied (1), without ``.!?`` (2), twice (3), of role user (4).

    Nulls are one space. Used to try repairs on.
    """
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("long").cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind, role, text = F.crc32(key) % 20, *[F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text")]
    return rows.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind.isin(0, 1), "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (kind != 0).alias("there"), F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")
