"""Schemas told from rows, and rows checked against them."""

from __future__ import annotations

import pytest

from gridwright.operators import schemas

COLUMNS = ("id", "code", "montant", "date", "actif", "email", "statut", "note")


def good():
    return [
        (str(i), f"{i % 7:05}", f"{i * 3},{i % 10}0", f"{i % 28 + 1:02}/{i % 12 + 1:02}/2024", "oui" if i % 3 else "non", f"client{i}@exemple.fr", ("actif", "inactif", "vip")[i % 3], f"texte libre {i}" if i % 4 else "")
        for i in range(1, 121)
    ]


def table(spark, rows, columns=COLUMNS):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows, 1)], "row int, " + ", ".join(f"`{c}` string" for c in columns))


@pytest.fixture(scope="module")
def inferred(spark):
    return schemas.infer_schema(table(spark, good()), COLUMNS)


def test_inference(inferred):
    by = {f["name"]: f for f in inferred["fields"]}
    assert by["id"] == {"name": "id", "type": "integer", "constraints": {"minimum": 0, "required": True, "unique": True}}
    assert by["code"] == {"name": "code", "type": "string", "constraints": {"pattern": "\\d{5}", "required": True}}
    assert by["montant"] == {"name": "montant", "type": "number", "decimalChar": ",", "constraints": {"minimum": 0, "required": True}}
    assert by["date"] == {"name": "date", "type": "date", "format": "%d/%m/%Y", "constraints": {"required": True}}
    assert by["actif"] == {"name": "actif", "type": "boolean", "trueValues": ["oui"], "falseValues": ["non"], "constraints": {"required": True}}
    assert by["email"] == {"name": "email", "type": "string", "format": "email", "constraints": {"required": True, "unique": True}}
    assert by["statut"]["constraints"] == {"required": True, "enum": ["actif", "inactif", "vip"]}
    assert by["note"] == {"name": "note", "type": "string"}
    assert inferred["primaryKey"] == "id"


def test_own_rows_are_valid(spark, inferred):
    assert schemas.check_rows(table(spark, good()), inferred, "row").count() == 0


def test_bad_rows(spark, inferred):
    from pyspark.sql import functions as F

    bad = [
        ("1", "00001", "10,50", "01/01/2024", "oui", "a@b.fr", "actif", "x"), ("1", "00002", "-3,00", "31/02/2024", "peut-être", "pas-un-mail", "inconnu", "x"),
        ("3", "123", "abc", "01/01/2024", "non", "c@d.fr", "vip", "x"), ("", "00004", "1,00", "01/01/2024", "oui", "e@f.fr", "actif", ""),
    ]
    t = table(spark, bad, (*COLUMNS[:-1], "extra"))
    got = {(r.field, r.rule): (r.n, r.examples) for r in schemas.check_rows(t, inferred, "row", width=F.when(F.col("row") == 4, 7).otherwise(8)).collect()}
    assert got == {
        ("id", "unique"): (1, ["1"]), ("id", "required"): (1, [""]), ("montant", "minimum"): (1, ["-3,00"]), ("montant", "type"): (1, ["abc"]), ("date", "type"): (1, ["31/02/2024"]), ("actif", "type"): (1, ["peut-être"]),
        ("email", "type"): (1, ["pas-un-mail"]), ("statut", "enum"): (1, ["inconnu"]), ("code", "pattern"): (1, ["123"]), ("", "fields"): (1, ["row 4"]), ("note", "missing"): (1, []), ("extra", "unexpected"): (1, []),
    }


def test_keys_of_two_columns_and_checks(spark):
    t = table(spark, [("1", "x"), ("1", "y"), ("1", "x"), (" 1", "É =1"), ("=1+1", "Ã©cole")], ("a", "b"))
    schema = {"fields": [{"name": "b"}, {"name": "a", "constraints": {"maxLength": 3}}], "primaryKey": ["a", "b"]}
    got = {(r.field, r.rule): (r.n, r.first_row, r.examples) for r in schemas.check_rows(t, schema, "row", checks={"a": ["edges", "formula"], "b": ["garbled"]}).collect()}
    assert got == {("a + b", "primaryKey"): (1, 3, ["1 + x"]), ("a", "edges"): (1, 4, [" 1"]), ("a", "formula"): (1, 5, ["=1+1"]), ("a", "maxLength"): (1, 5, ["=1+1"]), ("b", "garbled"): (1, 5, ["Ã©cole"]), ("b", "order"): (1, None, []), ("a", "order"): (1, None, [])}


def test_odd_columns(spark):
    rows = [("", "01/13/2024", "1 234,5", "12:30", "06 12 34 56 78", "2024-02-30", "0", "True"), ("", "02/03/2024", "-7", "23:59:01", "+33 6 11 22 33", "2024-02-28", "-1", "FALSE")]
    names = ("none", "mdy", "comma", "time", "phone", "nodate", "neg", "flag")
    by = {f["name"]: f for f in schemas.infer_schema(table(spark, rows, names), names)["fields"]}
    assert by["none"] == {"name": "none", "type": "string"}
    assert by["mdy"]["format"] == "%m/%d/%Y" and by["comma"] == {"name": "comma", "type": "number", "decimalChar": ",", "groupChar": " ", "constraints": {"required": True}}
    assert by["time"]["type"] == "time" and by["phone"]["constraints"]["pattern"].startswith(r"\+?[0-9") and by["nodate"]["type"] == "string"
    assert by["neg"]["constraints"] == {"required": True, "unique": True} and (by["flag"]["trueValues"], by["flag"]["falseValues"]) == (["True"], ["FALSE"])
    assert schemas.infer_schema(table(spark, [], ("a", "b")), ("a", "b"))["fields"] == [{"name": "a", "type": "string"}, {"name": "b", "type": "string"}]
