"""Rules learnt from examples: the same as a function of texts and as a Column."""

from __future__ import annotations

import pytest

from gridwright.operators import by_example as ex

COLUMNS = ("civilite", "prenom", "nom", "client", "naissance", "tel", "ville")
ROWS = [
    ("M.", "Jean", "DUPONT", "M. Jean DUPONT", "1984-03-15", "06 12 34 56 78", "Paris"),
    ("Mme", "Élodie", "Martin", "Mme Élodie Martin", "1990-11-02", "07 98 76 54 32", "Lyon"),
    ("M.", "Jean-Pierre", "LE GALL", "M. Jean-Pierre LE GALL", "1975-07-30", "01 23 45 67 89", "Brest"),
    ("Mme", "Anne", "ROUX", "Mme Anne ROUX", "2001-01-09", "06 00 00 00 01", "Nantes"),
    ("M.", "Paul", "Petit", "M. Paul Petit", "1968-12-24", "", "Paris"),
]
CASES = [
    (["Dupont", "Martin"], ["Dupont", "Martin", "Le Gall", "Roux", "Petit"]),
    (["jean.dupont@acme.fr", "elodie.martin@acme.fr"], ["jean.dupont@acme.fr", "elodie.martin@acme.fr", "jean-pierre.le gall@acme.fr", "anne.roux@acme.fr", "paul.petit@acme.fr"]),
    (["15/03/1984"], ["15/03/1984", "02/11/1990", "30/07/1975", "09/01/2001", "24/12/1968"]),
    (["J. DUPONT", "É. MARTIN"], ["J. DUPONT", "É. MARTIN", "J. LE GALL", "A. ROUX", "P. PETIT"]),
    (["0612345678", "0798765432"], ["0612345678", "0798765432", "0123456789", "0600000001", None]),
    (["J.D.", "É.M."], ["J.D.", "É.M.", "J.L.", "A.R.", "P.P."]),
]


def rows():
    return [dict(zip(COLUMNS, r, strict=True)) for r in ROWS]


@pytest.mark.parametrize(("given", "want"), CASES)
def test_rules(spark, given, want):
    rule = ex.learn(list(zip(rows(), given, strict=False)))
    assert [rule.of(r) for r in rows()] == want
    table = spark.createDataFrame([(k, *r) for k, r in enumerate(ROWS)], "k int, " + ", ".join(f"{c} string" for c in COLUMNS))
    assert [r[1] for r in table.select("k", rule.expression().alias("x")).orderBy("k").collect()] == want


def test_refusals():
    assert ex.learn(list(zip(rows(), ["rouge", "vert"], strict=False))) is None
    assert ex.learn([(rows()[0], "Dupont"), (rows()[0], "Jean")]) is None  # the same cells, two results
    assert ex.learn([(rows()[0], "Dupont"), (rows()[1], "Élodie")]) is None
    assert ex.learn([(rows()[0], "  ")]) is None and ex.learn([]) is None
    assert ex.learn([({"a": ""}, "x")]) is None


def test_late_examples_join_the_search():
    made = [({"a": f"x{k}-{'y' if k < 9 else 'zz'}{k}-q"}, f"{'y' if k < 9 else 'zz'}{k}") for k in range(12)]
    assert all(ex.learn(made).of(row) == result for row, result in made)


def test_pieces():
    assert ex.piece("a-b-c", "from", 1, "-") == "b-c" and ex.piece("a-b-c", "to", -2, "-") == "a-b"
    assert ex.piece("a-b-c", "to", 2, "-") is None and ex.piece("abc", "part", 0, "-") is None
    assert ex.piece("x 12 y 7", "number", -1) == "7"
    assert ex._CASES["capital"]("jean-pierre o'neil LE GALL") == "Jean-Pierre O'neil Le Gall"
    assert str(ex.Reading("nom", "word", -1, case="capital")) == "nom (word 1. from the end, capital)"


def test_readings_agree_with_columns(spark):
    """Every reading of hostile cells gives the same as a function and as a Column."""
    cells = ["", "  ", "a", "Ça-va  bien? ", "a;b;;c", ";", " x ; y ", "12 rue É. 7", "o'NEIL l’été", "a.b.c.d", "ÀÉ œuf ß", "  nb sp  ", "1", "a\nb\tc", "\\d+ (x) [y]"]
    some = {r for c in cells if ex._trim(c) for r in ex._readings("c", ex._trim(c))}
    readings = sorted((ex.Reading(r.column, r.kind, r.at, r.separator, case, size) for r in some for case, size in (("", 0), ("capital", 0), ("upper plain", 2), ("lower", -1))), key=str)
    table = spark.createDataFrame([(k, c) for k, c in enumerate(cells)], "k int, c string")
    for first in range(0, len(readings), 150):
        part = readings[first : first + 150]
        got = table.select("k", *[r.expression().alias(f"r{i}") for i, r in enumerate(part)]).orderBy("k").collect()
        for cell, row in zip(cells, got, strict=True):
            for r, x in zip(part, list(row)[1:], strict=True):
                assert x == r.of(ex._trim(cell)), (cell, r)


def test_fills_only_empty_cells(spark):
    table = spark.createDataFrame([(1, "Jean", "DUPONT", "Dupont"), (2, "Anne", "ROUX", " "), (3, "Zoé", "", None), (4, "Ali", "B", "kept")], "k int, prenom string, nom string, cible string")
    rule = ex.learn(ex.column_examples(table, "cible", ["k"], 1))
    assert [r.cible for r in ex.fill_by_example(table, "cible", rule).orderBy("k").collect()] == ["Dupont", "Roux", "", "kept"]
