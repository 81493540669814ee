"""How French names sound: a transcription by rules of spelling, and a code that casts wider. Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import slug, text

#: Spellings and their sounds, applied in this order to the words of a slug; 1, 2 and 3 are the nasal vowels, S is sh, G a hard g. Fixed values.
RULES = (
    ("ph", "f"), ("th", "t"), ("ch(?=[rl])", "k"), ("sch|ch|sh", "S"), ("ck|cq|qu|q", "k"), ("gu(?=[eiy])", "G"), ("ge(?=[aou])", "j"), ("g(?=[eiy])", "j"), ("G", "g"),
    ("c(?=[eiy])", "s"), ("c", "k"), ("w", "v"), ("z", "s"), ("y", "i"), ("x(?![^ ])", ""), ("x", "ks"), ("h", ""),
    ("(?:ain|ein|aim|eim)(?![aeioumn])", "1"), ("(?:in|im|un|um)(?![aeioumn])", "1"), ("(?:an|am|en|em)(?![aeioumn])", "2"), ("(?:on|om)(?![aeioumn])", "3"),
    ("aul(?=[tdx])", "o"), ("eau|au", "o"), ("ou", "u"), ("ai|ei", "e"), ("oeu|eu", "e"), ("bv", "v"), ("([^ ])\\1+", "$1"),
    ("(?<=[^ ]{2})[dtsxzp](?![^ ])", ""), ("(?<=[^ ]{2})[dtsxzp](?![^ ])", ""), ("(?<=[^ ]{2})e(?![^ ])", ""),
)
#: Sounds that the code doesn't tell apart: the nasals, then pairs. Fixed values.
MERGED = ("123Sdvgz", "NNNXtfks")


def transcription(c) -> Column:
    """The words of a text as they sound, with one space between them."""
    out = slug(F.translate(text(c), "çÇ", "ss"))
    for spelled, sound in RULES:
        out = F.regexp_replace(out, spelled, sound)
    return out


def code_of(heard: Column) -> Column:
    """The code of a transcription: like sounds are one, vowels are left out but for an initial one."""
    out = F.translate(heard, *MERGED)
    for spelled, sound in (("(?<![^ ])[aeiou]", "A"), ("[aeiou]", ""), ("([^ ])\\1+", "$1")):
        out = F.regexp_replace(out, spelled, sound)
    return F.upper(out)


def phonetic(c) -> Column:
    """The code of every word: Dupont and Dupond, Lefebvre and Lefèvre, Philippe and Filippe have one."""
    return code_of(transcription(c))
