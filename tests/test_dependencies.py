"""Near keys and decisions on a table with planted defects."""

from __future__ import annotations

import pytest

from gridwright.operators import dependencies, quality

TOWNS = (("75001", "Paris"), ("69001", "Lyon"), ("13001", "Marseille"), ("31000", "Toulouse"), ("44000", "Nantes"), ("33000", "Bordeaux"))
NAMES = ("Martin", "Bernard", "Thomas", "Petit", "Robert", "Richard", "Durand", "Dubois", "Moreau", "Laurent")


@pytest.fixture(scope="module")
def piege(spark):
    rows = []
    for i in range(198):
        cp, town = TOWNS[i % 6]
        rows.append((str(i + 1), "7501" if i in (54, 66) else cp, "Pariss" if i == 12 else town, NAMES[i % 10], f"{1 + i % 28:02}/{1 + i % 12:02}/2024", f"{(i * 7) % 300 + 10.5:.2f}", "FR", "", str(1 + i * 3 % 7)))
    rows += rows[:2]
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "row int, id string, cp string, ville string, nom string, date string, ht string, pays string, fax string, qte string")


def test_decisions(piege):
    got = [tuple(r) for r in dependencies.decisions(piege, piege.columns[1:]).collect()]
    assert [x[:2] for x in got][0] == ("cp", "ville") and got[0][3] == 1
    assert [tuple(r)[:3] for r in quality.decided_by(piege, "cp", "ville").collect()] == [("75001", "Paris", "Pariss")]
    assert dependencies.decisions(piege.limit(10), piege.columns[1:]).count() == 0
    assert dependencies.decisions(piege.limit(0), ["id", "cp"]).count() == 0


def test_near_keys(piege):
    got = {r.column_name: tuple(r)[1:] for r in dependencies.near_keys(piege, piege.columns[1:], "row").collect()}
    assert got == {"id": (False, 2, 4, "1")}
    whole = {r.column_name: tuple(r)[1:] for r in dependencies.near_keys(piege.where("row < 198"), piege.columns[1:], "row").collect()}
    assert whole == {"id": (True, 0, 0, "")}
    assert dependencies.near_keys(piege.limit(5), ["id"], "row").count() == 0


def test_id_like():
    assert all(map(dependencies.id_like, ("id", "Client ID", "c_id", "code", "Référence", "orderId")))
    assert not any(map(dependencies.id_like, ("city", "paid", "amount", "Nom")))
