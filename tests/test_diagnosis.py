"""Diagnosis of rows: each kind of damage, its place and its repair."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gridwright.functions.text import repaired, repaired_text
from gridwright.operators import diagnosis


def found(record: str, titles: str, looks=None, following=None, delimiter=";", encoding="UTF-8") -> dict:
    names = tuple(titles.split(delimiter))
    return diagnosis.diagnose_record(record, following, diagnosis.Usual(delimiter, encoding, names, tuple(looks or ["text"] * len(names))))


def kinds(d: dict) -> list[str]:
    return [f["kind"] for f in d["findings"]]


def test_shapes():
    titles, looks = "id;nom;adresse;ville;cp", ("number", "text", "text", "text", "number")
    assert kinds(found("1;Ann;12 rue Vert;Lyon;69001", titles, looks)) == []
    d = found("3;Cy;7; rue Haute;Lyon;69002", titles, looks)
    assert (kinds(d), d["findings"][0]["bytes"], d["repair"], d["repaired"]) == (["extra-fields"], "3B", "merge", ["3", "Cy", "7; rue Haute", "Lyon", "69002"])
    assert "adresse" in d["cause"]
    d = found("2;5 av. Foch", "id;adresse;ville", following="bat. B;Paris")
    assert (kinds(d), d["repair"], d["repaired"]) == (["split-line"], "join", ["2", "5 av. Foch\nbat. B", "Paris"])
    d = found("4;5", "a;b;c", following="6;7;8")
    assert (kinds(d), d["repair"], d["repaired"]) == (["missing-fields"], "pad", ["4", "5", ""])
    d = found("1;2;;", "a;b")
    assert (kinds(d), d["repair"], d["repaired"]) == (["trailing-delimiter"], "trim", ["1", "2"])
    assert kinds(found("1;2;", "a;b;")) == []
    d = found("a;b;c", "x;y")
    assert kinds(d) == ["extra-fields"] and "perhaps" in d["cause"]


def test_quotes():
    q = lambda record, titles="a,b": kinds(found(record, titles, delimiter=","))
    assert q('1,"unclosed\n2,3') == ["unclosed-quote"]
    assert q('0,"ok"z "w"') == ["text-after-quote"]
    assert q('1,x "quoted" y') == ["quote-inside"]
    assert q('2,"ok"z\n3,4') == ["runaway-quote", "unclosed-quote"]
    assert q('1, "two" ,3', "a, b ,c") == ["space-before-quote"]
    assert q('1,"line one\nline two"') == ["multiline"]
    assert q('1,"a ""b"" c"') == [] and q('1,"""a"""') == []


def test_characters_and_formulas():
    d = found("1,x\0y", "a,b", delimiter=",")
    assert (kinds(d), d["findings"][0]["bytes"], d["findings"][0]["at_byte"]) == (["nul"], "00", 3)
    assert kinds(found("1;﻿x", "a;b")) == ["invisible"]
    assert kinds(found("=1+1,+cmd|' /C calc'!A0,-2+3,@SUM(A1)", "a,b,c,d", delimiter=",")) == ["formula"]
    assert kinds(found("B;-0,5;1", "produit;prix;qte")) == [] and kinds(found("B;--;+1 234,5", "a;b;c")) == []
    assert kinds(found("1;x�", "a;b")) == ["replacement"]
    for picture in ("👍🏽", "👨‍👩‍👧‍👦", "🇫🇷", "é"):
        assert kinds(found(f"2;{picture}", "id;txt")) == []


def test_encodings():
    d = found("ZoÃ©;Lyon", "nom;ville", encoding="windows-1252")
    assert (kinds(d), d["findings"][0]["bytes"], d["repair"], d["repaired"]) == (["utf8-line"], "C3 A9", "reencode", ["Zoé", "Lyon"])
    assert kinds(found("Zoé;Orléans", "nom;ville", encoding="windows-1252")) == ["cp1252"]
    d = found("1;Ã©cole", "a;b")
    assert (kinds(d), d["findings"][0]["bytes"]) == (["mojibake"], "C3 83")


GARBLED = ["Ã©cole", "lâ€™Ã©tÃ© Ã  NoÃ«l", "ÃƒÂ©", "Ð¶ÑƒÐº", "Ïƒ", "ðŸ˜€ ok", "â‚¬ 5", "été « ÉTÉ »", "voilà »", "É»", "plain", "Ä…", "Å¡koda", "Â°C", "â‚¬ Ã"]


def test_repair_is_the_same_as_text_and_column(spark):
    for s in ("école", "Kraków", "жук, σίγμα", "l’été — où", "😀 ok", "€ 5"):
        once = s.encode().decode("cp1252", "ignore") if all(b in range(0x80) or bytes([b]).decode("cp1252", "ignore") for b in s.encode()) else None
        if once:
            assert repaired_text(once) == s
            twice = once.encode()
            if all(bytes([b]).decode("cp1252", "ignore") for b in twice):
                assert repaired_text(twice.decode("cp1252")) == s
    for s in ("été « ÉTÉ »", "voilà »", "É»", "plain", "Ärger Ü"):
        assert repaired_text(s) == s
    table = spark.createDataFrame([(k, s) for k, s in enumerate(GARBLED)], "k int, s string")
    assert [r[1] for r in table.select("k", repaired("s").alias("x")).orderBy("k").collect()] == [repaired_text(s) for s in GARBLED]


@pytest.mark.parametrize("size", ["600", "134217728"])
def test_files(spark, tmp_path, size):
    """All records of a file, in one block and in many."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        lines = ["id;adresse;ville"]
        for k in range(40):
            lines += [f"{k};rue {k};Lyon", f"{k};5 av. Foch\nbat. B;Paris", f'{k};"a\nb";Nice', f"{k};x", f"{k};7; rue Haute;Lyon"]
        (tmp_path / "t.csv").write_text("\n".join(lines) + "\n")
        got = diagnosis.diagnose(spark, str(tmp_path / "t.csv"), ["id", "adresse", "ville"], ";").withColumn("kinds", F.expr("transform(findings, f -> f.kind)"))
        rows = [(tuple(r.kinds), r.repair, tuple(r.repaired or ())) for r in got.orderBy("block", "at").collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    want = []
    for k in range(40):
        want += [((), None, ()), (("split-line",), "join", (str(k), "5 av. Foch\nbat. B", "Paris")), (("missing-fields",), "pad", ("bat. B", "Paris", "")), (("multiline",), None, ()), (("missing-fields",), "pad", (str(k), "x", "")), (("extra-fields",), "merge", (str(k), "7; rue Haute", "Lyon"))]
    assert rows == want
