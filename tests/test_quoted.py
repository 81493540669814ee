"""Delimited files with breaks in cells, cut into many blocks, and files in all encodings."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from gridwright.sources import encodings, quoted, readers, writers

WORDS = {
    "UTF-8": "日本語 Москва 😀 é", "windows-1252": "Hôtel à Noël", "windows-1251": "Москва, улица Ленина", "windows-1250": "Łódź żółć święty", "windows-1253": "Αθήνα και Θεσσαλονίκη",
    "windows-1254": "İstanbul ağaç şeker", "windows-1257": "Rīga Tallinn ķēniņš", "windows-1258": "Hà ăn cơm đưa", "windows-874": "กรุงเทพมหานคร", "windows-1255": "ירושלים תל אביב",
    "windows-1256": "القاهرة والرياض", "Shift_JIS": "東京都ソフト表能申予", "EUC-KR": "서울특별시 한국어", "GBK": "北京市朝阳区中文", "Big5": "臺北市許功蓋",
}
LIKE = {
    **dict.fromkeys(("UTF-16LE", "UTF-16BE", "UTF-32LE", "UTF-32BE", "GB18030"), "UTF-8"), **dict.fromkeys(("ISO-8859-1", "ISO-8859-15", "Macintosh"), "windows-1252"),
    **dict.fromkeys(("KOI8-R", "KOI8-U", "ISO-8859-5", "IBM866"), "windows-1251"), "ISO-8859-2": "windows-1250", "ISO-8859-7": "windows-1253", "ISO-8859-8": "windows-1255", "ISO-8859-6": "windows-1256",
    "EUC-JP": "Shift_JIS", "ISO-2022-JP": "Shift_JIS",
}


@pytest.fixture
def small_blocks(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "257")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def scanned(text: str, d: str) -> tuple[list[list[str]], int]:
    """Records and wrong quotes, character by character over the whole file."""
    out, wrong, i, n = [], 0, 0, len(text)
    while i < n:
        stop = text.find("\n", i)
        stop = n if stop < 0 else stop
        if text[i:stop] in ("", "\r"):
            i = stop + 1
            continue
        cells = []
        while True:
            if i < n and text[i] == '"':
                cell, i = "", i + 1
                while True:
                    if i >= n:
                        wrong += 1
                        break
                    if text[i] != '"':
                        cell, i = cell + text[i], i + 1
                    elif text[i + 1 : i + 2] == '"':
                        cell, i = cell + '"', i + 2
                    else:
                        k = i + 1
                        while k < n and text[k] in " \t" and text[k] != d:
                            k += 1
                        if k >= n or text[k] in (d, "\n") or text[k : k + 2] == "\r\n" or text[k:] == "\r":
                            i = k
                            break
                        wrong, cell, i = wrong + 1, cell + '"', i + 1
            else:
                k = i
                while k < n and text[k] not in (d, "\n"):
                    k += 1
                cell, i = text[i:k], k
                if k >= n or text[k] == "\n":
                    cell = cell.removesuffix("\r")
            cells.append(cell)
            if i < n and text[i] == d:
                i += 1
                continue
            i = i + 1 if text[i : i + 1] == "\n" else i + 2
            break
        out.append(cells)
    return out, wrong


def _hostile(rnd: random.Random, n: int) -> str:
    bits = ['"', '""', ";", "\n", "\r\n", "a", "bc ", " ", '";', '"\n', ';"', "é", "日本"]
    return "".join(rnd.choice(bits) for _ in range(n))


@pytest.mark.parametrize("seed", range(3))
def test_blocks_change_nothing(spark, small_blocks, tmp_path, seed):
    text = _hostile(random.Random(seed), 4000)
    (tmp_path / "t.csv").write_bytes(text.encode())
    got = quoted.read_records(spark, str(tmp_path / "t.csv"), ";").orderBy("block", "at").collect()
    want, wrong = scanned(text, ";")
    assert [r.cells for r in got] == want
    assert sum(r.wrong_quotes for r in got) == wrong
    assert quoted._lines(spark, str(tmp_path / "t.csv"), encodings.encoding("UTF-8")).rdd.getNumPartitions() > 20


def test_records_that_span_blocks(spark, small_blocks, tmp_path):
    rows = [(str(k), f'a "{k}"\n' * (k % 90), "x;y") for k in range(300)]
    for name in ("one", "two"):
        (tmp_path / f"{name}.csv").write_text("id;text;more\n" + "".join('{};"{}";"{}"\r\n'.format(a, b.replace('"', '""'), c) for a, b, c in rows), newline="")
    got = quoted.read_quoted(spark, str(tmp_path), ";", wrong_quotes="wrong")
    assert got.columns == ["id", "text", "more", "wrong"]
    assert sorted(tuple(r) for r in got.collect()) == sorted((*r, 0) for r in rows * 2)
    tasks = got.select(F.spark_partition_id().alias("p"), "id").groupBy("p").count().count()
    assert tasks > 50


def test_wide_and_narrow_rows(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes(b'\xef\xbb\xbfa,a,\n1\n2,3,4,5,6\n\n"7",8"9,"un"c"losed\n1,2')
    got = quoted.read_quoted(spark, str(tmp_path / "t.csv"), ",", wrong_quotes="w", rest="rest")
    assert got.columns == ["a", "a 2", "Column 3", "rest", "w"]
    assert sorted(map(tuple, got.collect())) == [("1", "", "", [], 0), ("2", "3", "4", ["5", "6"], 0), ("7", '8"9', 'un"c"losed\n1,2', [], 3)]
    assert [tuple(r) for r in quoted.read_quoted(spark, str(tmp_path / "t.csv"), ",", header=False).limit(1).collect()] == [("a", "a", "")]
    (tmp_path / "empty.csv").write_bytes(b"")
    assert quoted.read_records(spark, str(tmp_path / "empty.csv")).count() == 0


@pytest.mark.parametrize("name", list(encodings.CODECS))
def test_every_encoding(spark, small_blocks, tmp_path, name):
    """Guessed from its bytes, read by many tasks, and written again."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    words = WORDS.get(name) or WORDS[LIKE[name]]
    rows = [(words, f'{words}; "{k}"\n{words}', str(k)) for k in range(10)]
    text = "name;city;n\r\n" + "".join('{};"{}";{}\r\n'.format(a, b.replace('"', '""'), c) for a, b, c in rows)
    (tmp_path / "t.csv").write_bytes(encodings.MARKS.get(name, b"") * (name != "UTF-8") + text.encode(encodings.CODECS[name]))
    found = encodings.guess(text.encode(encodings.CODECS[name]))
    assert text.encode(encodings.CODECS[name]).decode(found.codec) == text, found
    table = readers.read_delimited(spark, str(tmp_path / "t.csv"), ";", encoding=name)
    assert table.columns == ["name", "city", "n"]
    assert sorted(map(tuple, table.collect())) == sorted(rows)
    guessed = readers.read_delimited(spark, str(tmp_path / "t.csv"), encoding=None)
    assert sorted(map(tuple, guessed.collect())) == sorted(rows)
    writers.write_encoded(table, str(tmp_path / "out"), name, ";")
    again = readers.read_delimited(spark, str(tmp_path / "out"), ";", encoding=name)
    assert sorted(map(tuple, again.collect())) == sorted(rows)


def test_unknown_encodings_and_signs_are_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="unknown encoding"):
        encodings.encoding("EBCDIC")
    with pytest.raises(Exception, match="can't encode"):
        writers.write_encoded(spark.createDataFrame([("Москва",)], "a string"), str(tmp_path / "o"), "windows-1252")


def test_characters_that_hold_a_line_break(spark, tmp_path):
    """U+0A41 before U+0100 holds the bytes of a UTF-16LE line feed across both."""
    text = "a;b\nĀ䄊Āx;1\nੁĀ;2\n"
    (tmp_path / "t.csv").write_bytes(text.encode("utf-16-le"))
    got = readers.read_delimited(spark, str(tmp_path / "t.csv"), ";", header=True, encoding="UTF-16LE")
    assert sorted(map(tuple, got.collect())) == sorted([("Ā䄊Āx", "1"), ("ੁĀ", "2")])


def test_guesses_of_plain_texts():
    for text, codec in (("Über die Straße läuft ein größerer Hund", "cp1252"), ("El niño pequeño, mañana será otro día", "cp1252"), ("Příliš žluťoučký kůň úpěl ďábelské ódy", "cp1250"), ("Съешь же ещё этих мягких французских булок", "koi8_r"), ("这是一个简单的测试文件", "gbk"), ("안녕하세요 반갑습니다", "cp949")):
        assert text.encode(codec).decode(encodings.guess(text.encode(codec)).codec) == text
    assert encodings.guess(b"plain").name == "UTF-8" and encodings.guess(b"").name == "UTF-8"
