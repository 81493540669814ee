"""Fill by example: a rule learnt from a few results, as a Column over the other cells of the row."""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import _MARKED, _PLAIN, cell_text

#: Examples that are taken, those that a search begins with, and characters of an example or cell that is read.
MOST_EXAMPLES, FIRST_EXAMPLES, LONGEST = 40, 6, 200
#: Parts of a cell that are told apart, characters of a slice, and places that a search goes through.
MOST_PARTS, LONGEST_SLICE, MOST_PLACES = 12, 4, 20000

#: Kinds of words, as classes that Java and Python read alike. Costs of readings are fixed values, as are those below.
WORDS = {"run": r"[^\p{IsWhite_Space}]+", "word": r"\p{IsAlphabetic}+", "letters and digits": r"[\p{IsAlphabetic}\p{N}]+", "number": r"\p{N}+"}
COSTS = {"all": 1.0, "digits": 1.4, "run": 1.1, "word": 1.15, "letters and digits": 1.2, "number": 1.15, "part": 1.25, "from": 1.35, "to": 1.35}
CASE_COSTS = {"": 0.0, "upper": 0.2, "lower": 0.2, "capital": 0.2, "lower plain": 0.3, "upper plain": 0.3}
STEP_COST, SLICE_COST, CHARACTER_COST, TEXT_COST, LETTER_COST, SIGN_COST = 0.03, 0.4, 0.05, 1.0, 1.5, 0.15

_EDGES = r"^[\p{IsWhite_Space}]+|[\p{IsWhite_Space}]+$"
_LETTER = regex.compile(r"[\p{IsAlphabetic}\p{N}]")
_CAPITAL = r"[\p{IsAlphabetic}\p{N}'’]+|[^\p{IsAlphabetic}\p{N}'’]+"


def _trim(s: str) -> str:
    return regex.sub(_EDGES, "", s)


def _plain(s: str) -> str:
    return s.lower().translate(str.maketrans(_MARKED, _PLAIN))


@dataclass(frozen=True)
class Reading:
    """What is taken of a cell: a piece (its ``at``-th of a kind, from the end where negative), in a case, then some first or last characters.

    The same reading is a function of a text, for the search, and a Column.
    """

    column: str
    kind: str = "all"
    at: int = 0
    separator: str = ""
    case: str = ""
    slice: int = 0

    @property
    def cost(self) -> float:
        steps = (-self.at - 1 if self.at < 0 else self.at) * STEP_COST
        return COSTS[self.kind] + steps + CASE_COSTS[self.case] + (SLICE_COST + CHARACTER_COST * abs(self.slice) if self.slice else 0)

    def of(self, cell: str) -> str | None:
        """The reading of a trimmed cell; None where it has no such piece."""
        return self.shaped(piece(cell, self.kind, self.at, self.separator))

    def shaped(self, s: str | None) -> str | None:
        if not s:
            return None
        s = _CASES[self.case](s)
        return s[: self.slice] if self.slice > 0 else s[self.slice :] if self.slice < 0 else s

    def expression(self, kind: str = "string") -> Column:
        """The reading of a column of a type as a Column: null where the cell has no such piece."""
        cell = F.regexp_replace(cell_text(F.col(f"`{self.column}`"), kind), _EDGES, "")
        spot = F.lit(self.at + 1 if self.at >= 0 else self.at)
        if self.kind == "all":
            found = cell
        elif self.kind == "digits":
            found = F.regexp_replace(cell, "[^0-9]", "")
        elif self.kind in WORDS:
            found = F.try_element_at(F.regexp_extract_all(cell, F.lit(WORDS[self.kind]), F.lit(0)), spot)
        else:
            parts = F.split(cell, "\\Q" + self.separator + "\\E", -1)
            n = F.size(parts)
            at = F.lit(self.at) if self.at >= 0 else n + self.at
            first, count = (at, F.lit(1)) if self.kind == "part" else (at, n - at) if self.kind == "from" else (F.lit(0), at + 1)
            there = (n >= 2) & (at >= (1 if self.kind == "from" else 0)) & (at < (n - 1 if self.kind == "to" else n))
            found = F.when(there, F.regexp_replace(F.array_join(F.slice(parts, first + 1, F.greatest(count, F.lit(0))), self.separator), _EDGES, ""))
        found = F.when(found != "", found)
        low = F.lower(found)
        if self.case == "capital":
            words = F.regexp_extract_all(low, F.lit(_CAPITAL), F.lit(0))
            shaped = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, LONGEST * 50))), "")
        else:
            shaped = {"": found, "upper": F.upper(found), "lower": low, "lower plain": F.translate(low, _MARKED, _PLAIN), "upper plain": F.upper(F.translate(low, _MARKED, _PLAIN))}[self.case]
        return F.left(shaped, F.lit(self.slice)) if self.slice > 0 else F.right(shaped, F.lit(-self.slice)) if self.slice < 0 else shaped

    def __str__(self) -> str:
        nth = f"{self.at + 1}." if self.at >= 0 else f"{-self.at}. from the end"
        said = {"all": "", "digits": "digits", "part": f"part {nth} between “{self.separator}”", "from": f"from part {nth} on, cut at “{self.separator}”", "to": f"up to part {nth}, cut at “{self.separator}”"}
        took = f"first {self.slice}" if self.slice > 0 else f"last {-self.slice}" if self.slice else ""
        about = ", ".join(filter(None, (said.get(self.kind, f"{self.kind} {nth}"), self.case, took)))
        return f"{self.column} ({about})" if about else self.column


_CASES = {
    "": lambda s: s,
    "upper": str.upper,
    "lower": str.lower,
    "capital": lambda s: "".join(w[0].upper() + w[1:] for w in regex.findall(_CAPITAL, s.lower())),
    "lower plain": _plain,
    "upper plain": lambda s: _plain(s).upper(),
}


def piece(cell: str, kind: str, at: int = 0, separator: str = "") -> str | None:
    """The piece of a trimmed cell, None where there is none or it is empty. A cell without the separator has no parts."""
    if kind == "all":
        return cell or None
    if kind == "digits":
        return regex.sub("[^0-9]", "", cell) or None
    some = regex.findall(WORDS[kind], cell) if kind in WORDS else cell.split(separator)
    n = len(some)
    at = at + n if at < 0 else at
    if not 0 <= at < n:
        return None
    if kind in WORDS:
        return some[at]
    if n < 2 or (kind == "from" and at == 0) or (kind == "to" and at == n - 1):
        return None
    return _trim(separator.join(some[at : at + 1] if kind == "part" else some[at:] if kind == "from" else some[: at + 1])) or None


def _readings(column: str, cell: str) -> Iterator[Reading]:
    """Every piece of a cell, from both ends, uncased."""
    yield Reading(column)
    if regex.search("[0-9]", cell) and regex.search("[^0-9]", cell):
        yield Reading(column, "digits")
    for kind, shape in WORDS.items():
        n = len(regex.findall(shape, cell))
        if n <= 2 * MOST_PARTS:
            yield from (Reading(column, kind, at) for at in range(-n, n))
    for sep in dict.fromkeys(ch for ch in cell if not _LETTER.match(ch)):
        n = cell.count(sep) + 1
        if n <= MOST_PARTS:
            kinds = ("from", "to") if regex.match(r"\p{IsWhite_Space}", sep) else ("part", "from", "to")
            yield from (Reading(column, kind, at, sep) for kind in kinds for at in range(-n, n))


def _candidates(rows: Sequence[Mapping[str, str]], wanted: Sequence[str]) -> dict[tuple[str, ...], Reading]:
    """Of all readings whose texts occur in all the results, the cheapest one for each tuple of texts."""
    best: dict[tuple[str, ...], Reading] = {}
    for column, cell in rows[0].items():
        if not cell or len(cell) > LONGEST:
            continue
        for raw in _readings(column, cell):
            pieces = [piece(r.get(column, ""), raw.kind, raw.at, raw.separator) for r in rows]
            if None in pieces:
                continue
            for case in _CASES:
                for size in range(-LONGEST_SLICE, LONGEST_SLICE + 1):
                    one = Reading(column, raw.kind, raw.at, raw.separator, case, size)
                    texts = tuple(one.shaped(p) for p in pieces)
                    if abs(size) >= len(_CASES[case](pieces[0])) or not all(t in w for t, w in zip(texts, wanted, strict=True)):
                        continue
                    if texts not in best or one.cost < best[texts].cost:
                        best[texts] = one
    return best


def _search(rows: Sequence[Mapping[str, str]], wanted: Sequence[str]) -> tuple[Reading | str, ...] | None:
    """The cheapest chain of readings and constant texts that spells every result at once; a constant alone is no rule.

    Uniform-cost search over the places reached in all results, one of which is in step with the first: a chain that strays
    from any result isn't followed.
    """
    begins: dict[str, list[tuple[tuple[str, ...], Reading]]] = {}
    for texts, reading in _candidates(rows, wanted).items():
        begins.setdefault(texts[0], []).append((texts, reading))
    lengths = sorted({len(t) for t in begins})
    goal = tuple(map(len, wanted))
    queue: list[tuple] = [(0.0, 0, (0,) * len(wanted), False, False, ())]
    done, pushed = set(), 0
    while queue and len(done) < MOST_PLACES:
        cost, _, places, read, after_text, chain = heapq.heappop(queue)
        if (places, read, after_text) in done:
            continue
        done.add((places, read, after_text))
        if read and places == goal:
            return chain
        first, at = wanted[0], places[0]
        ways = [(r.cost, texts, r) for n in lengths for texts, r in begins.get(first[at : at + n], ()) if len(first) - at >= n]
        if not after_text:
            price = TEXT_COST
            for k in range(at, len(first)):
                price += LETTER_COST if _LETTER.match(first[k]) else SIGN_COST
                ways.append((price, (first[at : k + 1],) * len(wanted), first[at : k + 1]))
        for price, texts, part in ways:
            if all(w.startswith(t, p) for w, t, p in zip(wanted, texts, places, strict=True)):
                pushed += 1
                then = tuple(p + len(t) for p, t in zip(places, texts, strict=True))
                plain = isinstance(part, str)
                heapq.heappush(queue, (cost + price, pushed, then, read or not plain, plain, (*chain, part)))
    return None


@dataclass(frozen=True)
class Rule:
    """A chain of readings and constant texts."""

    parts: tuple[Reading | str, ...]

    def of(self, row: Mapping[str, str]) -> str | None:
        texts = [p if isinstance(p, str) else p.of(_trim(row.get(p.column, ""))) for p in self.parts]
        return None if None in texts else "".join(texts)

    def expression(self, kinds: Mapping[str, str] | None = None) -> Column:
        """The rule as a Column over columns of these types (text where none is told): null where one of its pieces isn't there."""
        return F.concat(*[F.lit(p) if isinstance(p, str) else p.expression((kinds or {}).get(p.column, "string")) for p in self.parts])

    def __str__(self) -> str:
        return " + ".join(f"“{p}”" if isinstance(p, str) else str(p) for p in self.parts)


def learn(examples: Sequence[tuple[Mapping[str, str], str]]) -> Rule | None:
    """The plainest rule that gives the result of every example (cells by column, result) from its cells; None if none does.

    Results are trimmed; empty ones and those over LONGEST characters aren't looked at, and of the rest the first
    MOST_EXAMPLES are. The search begins with a few; an example that its rule gets wrong joins it. Examples whose cells are
    the same but not their results contradict each other: no rule.
    """
    known = [({c: _trim(v or "") for c, v in row.items()}, _trim(result)) for row, result in examples]
    known = [(row, result) for row, result in known if result and len(result) <= LONGEST][:MOST_EXAMPLES]
    if not known:
        return None
    taken = list(range(min(FIRST_EXAMPLES, len(known))))
    while True:
        parts = _search([known[k][0] for k in taken], [known[k][1] for k in taken])
        if parts is None:
            return None
        rule = Rule(parts)
        wrong = next((k for k, (row, result) in enumerate(known) if rule.of(row) != result), None)
        if wrong is None:
            return rule
        if wrong in taken:
            return None
        taken.append(wrong)


def column_examples(df: DataFrame, target: str, order: Sequence[str], most: int = MOST_EXAMPLES) -> list[tuple[dict[str, str], str]]:
    """The first filled cells of ``target`` in ``order``, with the other cells of their rows: at most ``most``, which is all that reaches the driver."""
    cells = [cell_text(F.col(f"`{c}`"), t).alias(c) for c, t in df.dtypes]
    filled = df.orderBy(*order).select(*cells).where(F.regexp_replace(F.col(f"`{target}`"), _EDGES, "") != "")
    return [({c: v for c, v in r.asDict().items() if c != target}, r[target]) for r in filled.limit(most).collect()]


def fill_by_example(df: DataFrame, target: str, rule: Rule) -> DataFrame:
    """``df`` with the empty cells of ``target`` filled by ``rule``, where it gives something; filled cells stay as they are."""
    kinds = dict(df.dtypes)
    cell = F.coalesce(F.col(f"`{target}`"), F.lit(""))
    empty = F.regexp_replace(cell, _EDGES, "") == ""
    made = rule.expression(kinds)
    return df.withColumn(target, F.when(empty, F.coalesce(F.when(made != "", made), cell)).otherwise(cell))
