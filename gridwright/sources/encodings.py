"""Text encodings: what Python calls them, how their lines are cut, and which one some bytes are in."""

from __future__ import annotations

import codecs
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa

#: Encodings that are read and written, with the codec that does it. ISO-8859-1 is read as windows-1252, of which it is a part. Fixed values.
CODECS = {
    "UTF-8": "utf-8", "windows-1252": "cp1252", "ISO-8859-1": "cp1252", "ISO-8859-15": "iso8859_15", "Macintosh": "mac_roman",
    "UTF-16LE": "utf-16-le", "UTF-16BE": "utf-16-be", "UTF-32LE": "utf-32-le", "UTF-32BE": "utf-32-be",
    "windows-1251": "cp1251", "KOI8-R": "koi8_r", "KOI8-U": "koi8_u", "ISO-8859-5": "iso8859_5", "IBM866": "cp866",
    "windows-1250": "cp1250", "ISO-8859-2": "iso8859_2", "windows-1253": "cp1253", "ISO-8859-7": "iso8859_7",
    "windows-1254": "cp1254", "windows-1257": "cp1257", "windows-1258": "cp1258", "windows-874": "cp874",
    "windows-1255": "cp1255", "ISO-8859-8": "iso8859_8", "windows-1256": "cp1256", "ISO-8859-6": "iso8859_6",
    "Shift_JIS": "cp932", "EUC-JP": "euc_jp", "ISO-2022-JP": "iso2022_jp", "EUC-KR": "cp949", "GBK": "gbk", "GB18030": "gb18030", "Big5": "cp950",
}
MARKS = {"UTF-32LE": codecs.BOM_UTF32_LE, "UTF-32BE": codecs.BOM_UTF32_BE, "UTF-8": codecs.BOM_UTF8, "UTF-16LE": codecs.BOM_UTF16_LE, "UTF-16BE": codecs.BOM_UTF16_BE}


@dataclass(frozen=True)
class Encoding:
    name: str
    codec: str

    @property
    def width(self) -> int:
        """Bytes of the smallest unit, of which a line break is one."""
        return {"UTF-16": 2, "UTF-32": 4}.get(self.name[:6], 1)

    @property
    def line_end(self) -> bytes:
        return "\n".encode(self.codec)

    @property
    def plain_quotes(self) -> bool:
        """Whether a line without the byte of a quote has no quote."""
        return self.width == 1


def encoding(name: str) -> Encoding:
    """An encoding by its name in any case, with or without hyphens; unknown ones are refused."""
    plain = lambda s: s.lower().replace("-", "").replace("_", "")
    found = {plain(n): n for n in CODECS} | {"latin1": "ISO-8859-1", "latin9": "ISO-8859-15", "macroman": "Macintosh", "cp866": "IBM866", "sjis": "Shift_JIS", "utf16": "UTF-16LE", "utf32": "UTF-32LE"}
    found |= {plain(c): n for n, c in reversed(CODECS.items()) if plain(c) not in found}
    if plain(name) not in found:
        raise ValueError(f"unknown encoding {name!r}: one of {', '.join(CODECS)}")
    return Encoding(found[plain(name)], CODECS[found[plain(name)]])


#: Bytes of rows that a worker takes out of Arrow, or gathers for it, at once: as Python objects they take several times that.
PORTION = 1 << 20


def portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of batches in pieces of about :data:`PORTION` bytes, one row at least: batches are cut by rows, however long these are."""
    for b in batches:
        step = max(1, b.num_rows * PORTION // max(1, b.nbytes))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


#: Letters that texts have most of, by script, and for Latin by code page: what tells pages with the same letters in other places apart.
#: Then the first bytes of the common characters of each encoding of two bytes. Fixed values.
COMMON = {"CYRILLIC": "оеаинтсрвлкмдпуяыьг", "GREEK": "αοιετσνηυρπκμλςίόά", "HEBREW": "יוהלאםרבתנש", "ARABIC": "اليمونرتبةعدسفهكحق", "THAI": "านรกเงมยลวดทส่้ตะปบคหแพจชขใไ"}
_WESTERN = "éèàçùêâîôûëïöäüßñáíóúãõåæøœÉÀÖÄÜ"
LATIN = {
    "cp1252": _WESTERN, "iso8859_15": _WESTERN, "mac_roman": _WESTERN, "cp1250": "ąęłśżźćńóáéíěščřžýůúťďňäöüőűôŁŚŻŹČŠŘŽ", "iso8859_2": "ąęłśżźćńóáéíěščřžýůúťďňäöüőűôŁŚŻŹČŠŘŽ",
    "cp1254": "ğışçöüâîûİŞĞÇÖÜ", "cp1257": "āēīūšžķļņģčėįųąęõäöüŠŽČĀ", "cp1258": "ăâđêôơưàáéèíìóòúùĐ",
}
LEVEL_ONE = {"cp932": (0x88, 0x97), "euc_jp": (0xB0, 0xCF), "gbk": (0xB0, 0xD7), "gb18030": (0xB0, 0xD7), "cp950": (0xA4, 0xC6), "cp949": (0xB0, 0xC8)}
SIGNS = "’‘“”«»–—…€£°·№„•§¿¡ 、。「」・ー，！？：；（）《》【】"


def _letter(ch: str, script: str, codec: str) -> float:
    if script in ("CJK", "HANGUL") and codec in LEVEL_ONE:
        low, high = LEVEL_ONE[codec]
        return 1.0 if low <= ch.encode(codec)[0] <= high else 0.3
    if script in ("HIRAGANA", "KATAKANA", "CJK"):
        return 1.0 if codec in ("cp932", "euc_jp", "iso2022_jp") else 0.3
    if codec in LEVEL_ONE:
        return 0.3
    return 1.0 if ch in (LATIN.get(codec, "") if script == "LATIN" else COMMON.get(script, "")) else 0.5


def _script(ch: str) -> str:
    return unicodedata.name(ch, "").split(" ")[0]


def _plausible(text: str, codec: str) -> float:
    """How much a text looks like one that people wrote: its letters beyond ASCII, their pairs and neighbours, by character beyond ASCII."""
    score, count, before = 0.0, 0, " "
    for ch in text:
        category = unicodedata.category(ch)
        if ch > "\x7f":
            count += 1
            if category[0] == "L":
                script = _script(ch)
                score += _letter(ch, script, codec)
                if category == "Lu" and unicodedata.category(before) == "Ll":
                    score -= 2  # a capital within a word
                if before > "\x7f" and before.isalpha() and codec not in LEVEL_ONE and _script(before) != script:
                    score -= 1.5  # two scripts in a word
                if script == "LATIN" and before > "\x7f":
                    score -= 0.4  # accented letters seldom stand side by side
                if script != "LATIN" and before.isascii() and before.isalpha():
                    score -= 1
                if script in ("HALFWIDTH", "FULLWIDTH"):
                    score -= 0.6
            elif category[0] == "M":
                score += 0.4 if before.isalpha() or unicodedata.category(before)[0] == "M" else -1
            else:
                score += 0.3 if ch in SIGNS else -1 if category in ("Cc", "Co", "Cn") or ch == "\ufffd" else -0.7
        else:
            if category == "Cc" and ch not in "\t\r\n":
                score -= 1
            if before > "\x7f" and ch.isalpha() and codec in LEVEL_ONE:
                score -= 1
        before = ch
    kana = codec not in ("cp932", "euc_jp") or any("\u3040" <= ch <= "\u30ff" for ch in text)
    return score / max(1, count) - (0 if kana else 0.1)


def guess(sample: bytes) -> Encoding:
    """The encoding of some bytes: by the mark at their start, the places of their zeros, as UTF-8 where they are that, else by evidence.

    Every encoding that the bytes are whole in is tried; letters, their pairs and what stands beside them tell how much the text
    looks written by people, each character beyond ASCII counting once, however many bytes it takes. Of equal ones the first of CODECS
    is taken, so that texts of western Europe are windows-1252. Bytes that none of them knows are windows-1252 too.
    """
    for name, mark in MARKS.items():
        if sample.startswith(mark):
            return encoding(name)
    for width, names in ((4, ("UTF-32LE", "UTF-32BE")), (2, ("UTF-16LE", "UTF-16BE"))):
        units = len(sample) // width
        zeros = [sample[k : units * width : width].count(0) / max(1, units) for k in range(width)]
        if units and width == 4 and min(zeros[2], zeros[3]) > 0.9 and zeros[0] < 0.5:
            return encoding(names[0])
        if units and width == 4 and min(zeros[0], zeros[1]) > 0.9 and zeros[3] < 0.5:
            return encoding(names[1])
        if units and width == 2 and max(zeros) > 0.15 and min(zeros) < 0.1:
            return encoding(names[0] if zeros[1] > zeros[0] else names[1])
    try:
        codecs.getincrementaldecoder("utf-8")().decode(sample)
        if b"\x1b$" not in sample:
            return encoding("UTF-8")
    except UnicodeDecodeError:
        pass
    best, found = float("-inf"), "windows-1252"
    for name, codec in CODECS.items():
        if name.startswith("UTF") or (name == "ISO-2022-JP") != (b"\x1b$" in sample):
            continue
        try:
            text = codecs.getincrementaldecoder(codec)().decode(sample)
        except UnicodeDecodeError:
            continue
        score = _plausible(text, codec) - (0.02 if name in ("GB18030", "KOI8-U") else 0)
        if score > best + 1e-9:
            best, found = score, name
    return encoding(found)
