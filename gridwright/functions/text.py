"""How cells are read: folding, keys for comparing and sorting, lenient numbers and dates. All are Column expressions."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def _base_letters() -> tuple[str, str]:
    """Lower-case Latin letters with marks (U+00C0 to U+024F) and the first character of their decomposition."""
    pairs = {c.lower(): unicodedata.normalize("NFD", c.lower())[0] for c in map(chr, range(0xC0, 0x250)) if len(c.lower()) == 1}
    pairs = {a: b for a, b in pairs.items() if a != b}
    return "".join(pairs), "".join(pairs.values())


_MARKED, _PLAIN = _base_letters()
#: Ligatures and final forms that fold to several or other letters; spaces that fold to a plain one. Fixed values.
LIGATURES = (("œ", "oe"), ("æ", "ae"), ("ß", "ss"), ("ς", "σ"), (" ", " "), (" ", " "))


def text(c) -> Column:
    """A cell's text: null reads as empty."""
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def trimmed(c) -> Column:
    return F.trim(text(c))


def filled(c) -> Column:
    return trimmed(c) != ""


def fold(c) -> Column:
    """Lower case without accents, ligatures spelled out."""
    out = F.lower(text(c))
    for a, b in LIGATURES:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.translate(out, _MARKED, _PLAIN)


@lru_cache(maxsize=4096)
def _spellings(letter: str) -> str:
    """Characters that :func:`fold` turns into one letter, as a class of a pattern."""
    plain = {letter} | {a for a, b in zip(_MARKED, _PLAIN, strict=True) if b == letter} | {a for a, b in LIGATURES if b == letter}
    capital = {c.upper() for c in plain if len(c.upper()) == 1} | {c for c in "\u212a\u212b" if c.lower() in plain}
    codes = sorted(ord(c) for c in plain | capital if fold_text(c) == letter)
    near = "".join(map(chr, (c for c in codes if c < 256)))
    far = [c for c in codes if c >= 256]  # as ranges, of which a class may have few without getting slow
    starts = [c for c in far if c - 1 not in far]
    ends = [c for c in far if c + 1 not in far]
    return "[" + re.sub(r"([\\\[\]^&-])", r"\\\1", near) + "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in zip(starts, ends, strict=True)) + "]"


def fold_text(s: str) -> str:
    """What :func:`fold` does, for a text of the plan."""
    s = s.lower()
    for a, b in LIGATURES:
        s = s.replace(a, b)
    return s.translate(str.maketrans(_MARKED, _PLAIN))


def folded_pattern(term: str) -> str | None:
    """A pattern that a text matches where its folded form contains the folded ``term``; None where it can't be told by one.

    It spares folding whole texts: letters stand for all their spellings, two letters for their ligature too, of which a
    term may begin or end with a half.
    """
    term = fold_text(term)
    pairs = {b: a for a, b in LIGATURES if len(b) == 2}
    both = lambda a: a + ("ẞ" if a == "ß" else a.upper())
    halves = lambda ch, k: "".join(both(a) for b, a in pairs.items() if b[k] == ch)
    if not term or any(term[k : k + 2] in pairs and term[k + 1 : k + 3] in pairs for k in range(len(term))):
        return None
    out, k = "", 0
    while k < len(term):
        pair, single = term[k : k + 2], _spellings(term[k])
        if pair in pairs:
            out += f"(?:{single}{_spellings(term[k + 1])}|[{both(pairs[pair])}])"
            # a half at an end of the term: only where the pair is all there is beside it
            if k == 0 or k + 2 == len(term):
                return None
            k += 2
            continue
        half = (halves(term[k], 1) if k == 0 else "") + (halves(term[k], 0) if k + 1 == len(term) else "")
        out += f"(?:{single}|[{half}])" if half else single
        k += 1
    return out


def slug(c) -> Column:
    """Folded words with one space between them."""
    return F.trim(F.regexp_replace(fold(c), r"[^\p{L}\p{N}]+", " "))


def phone_key(c, country: str = "33") -> Column:
    """A phone number in international form, empty where there is none or all its digits are one."""
    bare = F.regexp_replace(F.replace(trimmed(c), F.lit("(0)"), F.lit("")), r"[ .()/\-]", "")
    plus = F.regexp_replace(F.regexp_replace(bare, "^00", "+"), "^0(?=[0-9]{6,14}$)", f"+{country}")
    return F.when(plus.rlike(r"^\+[0-9]{8,15}$") & ~plus.rlike(r"([0-9])\1{7,}$"), plus).otherwise(F.lit(""))


def mail_key(c) -> Column:
    """A mail address without a tag, and for Gmail without dots; empty where there is none."""
    s = F.lower(trimmed(c))
    name, domain = F.regexp_replace(F.substring_index(s, "@", 1), r"\+.*$", ""), F.regexp_replace(F.substring_index(s, "@", -1), "^googlemail\\.com$", "gmail.com")
    name = F.when(domain == "gmail.com", F.replace(name, F.lit("."), F.lit(""))).otherwise(name)
    return F.when(s.rlike(r"^[^\s@]+@[^\s@.]+(?:\.[^\s@.]+)+$"), F.concat_ws("@", name, domain)).otherwise(F.lit(""))


#: Ways to compare cells.
MATCHING = {"exact": text, "loose": lambda c: F.lower(trimmed(c)), "slug": slug, "digits": lambda c: F.regexp_replace(text(c), "[^0-9]", ""), "phone": phone_key, "mail": mail_key}


def match_key(c, how: str) -> Column:
    """What two cells must have in common to match, by a name of MATCHING."""
    if how not in MATCHING:
        raise ValueError(f"unknown matching: {how}")
    return MATCHING[how](c)


def _once(value: Column, then) -> Column:
    """``then(value)`` with ``value`` computed once, however often it is used."""
    return F.transform(F.array(value), then)[0]


def number(c) -> Column:
    """A number as people write it, else null: currency and group marks dropped, (42) negative, the last of ``,`` and ``.`` decimal.

    The type is a constant of the plan, so for a numeric column the optimizer leaves the plain conversion alone; NaN is unreadable.
    """
    s = trimmed(c)
    bare_text = F.regexp_replace(F.regexp_replace(s, r"^\((.*)\)$", "-$1"), "[€$£%¥   '_]", "")

    def read_bare(bare: Column) -> Column:
        commas, dots = (F.length(bare) - F.length(F.replace(bare, F.lit(x), F.lit(""))) for x in (",", "."))
        no = lambda x: F.replace(bare, F.lit(x), F.lit(""))
        comma_last = F.instr(F.reverse(bare), ",") < F.instr(F.reverse(bare), ".")
        return (
            F.when((commas > 0) & (dots > 0) & comma_last, F.replace(no("."), F.lit(","), F.lit("."))).when((commas > 0) & (dots > 0), no(","))
            .when(commas == 1, F.replace(bare, F.lit(","), F.lit("."))).when(commas > 1, no(",")).when(dots > 1, no(".")).otherwise(bare)
        )

    shape = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
    lenient = _once(_once(bare_text, read_bare), lambda x: F.when(x.rlike(shape), x))
    short = F.octet_length(s) <= 40
    read = F.when(short & s.rlike(shape), s.try_cast("double")).when(short & s.rlike("[0-9]"), lenient.try_cast("double"))
    typed = (F.col(c) if isinstance(c, str) else c).cast("string").try_cast("double")
    return F.when(_is_numeric(c), F.when(~F.isnan(typed), typed)).otherwise(read)


def _is_numeric(c) -> Column:
    """A constant of the plan, folded before the query runs."""
    return F.typeof(F.col(c) if isinstance(c, str) else c).rlike("^(?:tinyint|smallint|int|bigint|float|double|decimal.*)$")


def date_key(c) -> Column:
    """A date as the number yyyymmddhhmmss, else null: y-m-d or d-m-y with one separator twice, 4-digit years; days up to 31 in any month."""
    s = trimmed(c)
    clock = r"(?:[T ][0-9]{1,2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]+)?)?)?$"
    shaped = s.rlike(r"^(?:[0-9]{4}([-/.])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\2[0-9]{4})" + clock)

    def key(p: Column) -> Column:
        n = lambda k: F.coalesce(F.try_element_at(p, F.lit(k)).try_cast("long"), F.lit(0))
        iso = F.length(F.try_element_at(p, F.lit(1))) == 4
        y, m, d = F.when(iso, n(1)).otherwise(n(3)), n(2), F.when(iso, n(3)).otherwise(n(1))
        ok = m.between(1, 12) & d.between(1, 31) & (n(4) < 24) & (n(5) < 60) & (n(6) < 60)
        return F.when(ok, ((((y * 100 + m) * 100 + d) * 100 + n(4)) * 100 + n(5)) * 100 + n(6))

    plain = F.translate(s, "-", "")
    day = F.when(F.substring(plain, 5, 2).between("01", "12") & F.substring(plain, 7, 2).between("01", "31"), plain.try_cast("long") * 1000000)
    iso = s.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$")
    return F.when(~_is_numeric(c), F.when(iso, day).when(s.rlike("^[0-9]"), _once(F.when(shaped, F.split(s, r"[-/.T :]")), key)))


def quantity(c) -> Column:
    """A number, or else a date's key."""
    return F.coalesce(number(c), date_key(c).cast("double"))


#: Punctuation that bytes put after digits, and where it goes: before the mark of a run of digits, which is a capital, of which folded text has none.
_LATE_SIGNS, _EARLY = ":;<=>?@[\\]^_`{|}~", "0123456789:;<=>?@"


def sort_key(c) -> Column:
    """Folded text in which signs come before digits and these before letters, and digit runs of any length compare by value.

    A run is written as a mark, the length of its length, its length and its digits, without zeros before them.
    """
    s = fold(trimmed(c))
    parts = F.regexp_extract_all(s, F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))
    bare = lambda x: F.regexp_replace(x, "^0+(?=[0-9])", "")
    size = lambda x: F.length(bare(x)).cast("string")
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike("^[0-9]"), F.concat(F.lit("A"), F.length(size(x)).cast("string"), size(x), bare(x))).otherwise(F.translate(x, _LATE_SIGNS, _EARLY))), "")


#: The order of marks on one letter; other marks come after them, then letters that fold to others. Fixed values.
MARKS = "\u0301\u0300\u0306\u0302\u030c\u030a\u0308\u030b\u0303\u0307\u0327\u0328\u0304"


def _mark_ranks() -> tuple[str, str]:
    """Letters with a mark, and ligatures, beside characters that stand for their ranks."""
    ranks = {}
    for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]):
        found = [d for d in unicodedata.normalize("NFD", c) if unicodedata.combining(d)]
        if found:
            ranks[c] = 2 + (MARKS.index(found[0]) if found[0] in MARKS else len(MARKS))
    ranks |= dict.fromkeys("œŒæÆß\u00a0\u202f", 0x40)
    return "".join(ranks), "".join(chr(0xE000 + r) for r in ranks.values())


_RANKED, _RANKS = _mark_ranks()


def tie_key(c) -> Column:
    """What comes after :func:`sort_key`, for texts that differ only in accents and case: plain letters first, then by mark; then small ones first."""
    s = trimmed(c)
    marks = F.regexp_replace(F.translate(s, _RANKED, _RANKS), "[^\ue002-\ue040]", "\ue001")
    capitals = F.regexp_replace(F.regexp_replace(s, r"[^\p{Lu}]", "0"), "[^0]", "1")
    return F.concat(marks, F.lit("\ue000"), capitals)


def cell_text(c, kind: str) -> Column:
    """The text of a typed cell: null empty, floats without a trailing ``.0``, local timestamps with a space, nested values as JSON."""
    c = F.col(c) if isinstance(c, str) else c
    if kind in ("float", "double"):
        return F.coalesce(F.regexp_replace(c.cast("string"), r"\.0$", ""), F.lit(""))
    if kind.startswith(("array", "map", "struct")):
        return F.coalesce(F.to_json(c), F.lit(""))
    if kind == "binary":
        return F.coalesce(F.concat(F.lit("0x"), F.lower(F.hex(c))), F.lit(""))
    return text(c)


def _read_as_1252() -> tuple[str, str, str]:
    """UTF-8 sequences whose bytes were read as Windows-1252, as a pattern of its characters; those characters and the bytes that they were, as Latin-1.

    Only sequences of characters are taken that garbled Latin text, signs and pictures have, and at least two Greek or Cyrillic
    letters: a capital before a quotation mark or a blank that doesn't break is a sequence too, but of a letter that nobody writes.
    """
    shown = [bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(256)]
    some = lambda low, high: "[" + "".join(re.sub(r"([\\\[\]^&~-])", r"\\\1", shown[b]) for b in range(low, high + 1)) + "]"
    rest = some(0x80, 0xBF)
    two = f"{some(0xC2, 0xC8)}{rest}|{shown[0xC9]}{some(0x80, 0x8F)}|{shown[0xCB]}[{shown[0x86]}{shown[0x9C]}]|(?:{some(0xCD, 0xD3)}{rest}){{2,}}"
    three = f"{shown[0xE2]}{some(0x80, 0x84)}{rest}|{shown[0xE2]}{shown[0x85]}{some(0x80, 0x8F)}"
    four = f"{shown[0xF0]}{shown[0x9F]}{rest}{rest}"
    odd = "".join(shown[b] for b in range(0x80, 0xA0) if shown[b] != chr(b))
    first = "".join(shown[b] for b in (*range(0xC2, 0xCA), 0xCB, *range(0xCD, 0xD4), 0xE2, 0xF0))  # looked for alone, most characters cost one test
    return f"(?:(?=[{first}])(?:{two}|{three}|{four}))", odd, "".join(chr(b) for b in range(0x80, 0xA0) if shown[b] != chr(b))


GARBLED, _SHOWN, _BYTES = _read_as_1252()
#: Passes of a repair: texts may have been garbled more than once.
REPAIR_PASSES = 3


def repaired(c) -> Column:
    """Text in which UTF-8 was read as Windows-1252, once or more often, as it was: ``Ã©`` is ``é``, ``Ð¶`` is ``ж``.

    Each sequence that is one in UTF-8 is turned back by itself, so that a cell with sound and garbled letters is repaired too.
    """
    back = lambda x: F.decode(F.encode(F.translate(x, _SHOWN, _BYTES), "ISO-8859-1"), "UTF-8")

    def once(x: Column) -> Column:
        """The sequences of a text are turned back all at once, as lines, and put between what is sound."""
        sound, garbled = F.split(x, GARBLED, -1), F.array_join(F.regexp_extract_all(x, F.lit(GARBLED), F.lit(0)), "\n")
        mended = F.array_join(F.zip_with(sound, F.split(back(garbled), "\n", -1), lambda p, q: F.concat(p, F.coalesce(q, F.lit("")))), "")
        return F.when(x.rlike(GARBLED), mended).otherwise(x)

    out = text(c)
    for _ in range(REPAIR_PASSES):
        out = F.element_at(F.transform(F.array(out), once), 1)  # what the passes before give is bound to a name, not computed for each use
    return out


def repaired_text(s: str) -> str:
    """What :func:`repaired` does, for one text."""
    for _ in range(REPAIR_PASSES):
        s = re.sub(GARBLED, lambda m: m.group().translate(str.maketrans(_SHOWN, _BYTES)).encode("latin-1").decode(), s)
    return s


def day_text(d: Column) -> Column:
    """A date as ISO text; years of five digits and more have no sign, unlike in Spark's own cast."""
    return F.ltrim(d.cast("string"), F.lit("+"))


def half_up(c: Column, decimals: int = 0) -> Column:
    """Rounding with halves towards plus infinity."""
    return F.floor(c * 10.0**decimals + F.lit(0.5)) / 10.0**decimals
