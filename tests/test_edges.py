"""Small tables with nulls, ties, empty and odd cells."""

import re

import numpy as np

from pyspark.sql import functions as F

from gridwright.operators import edits, grouping, guesses, matching, order_statistics, quality


def test_quantiles_of_nulls_ties_and_nothing(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0), ("a", 5.0), ("a", 9.0), ("b", None)], "k string, v double")
    got = {r.k: (r.q0, r.q1) for r in order_statistics.quantiles(df, F.col("v"), [0.5, 0.25], ["k"]).collect()}
    assert got == {None: (2.0, 1.5), "a": (5.0, 5.0)}
    empty = df.where("false")
    assert [r.q0 for r in order_statistics.quantiles(empty, F.col("v"), [0.5]).collect()] == [None]
    assert grouping.chart_edges(empty, "v")["bins"] == 0


def test_rules_on_empty_and_blank_tables(spark):
    df = spark.createDataFrame([(1, None, ""), (2, None, ""), (3, "Ann Lee", "x@y.org"), (4, "lee ANN", "X@y.org")], "id long, name string, mail string")
    rules = [matching.names(["name"]), matching.name_initials(["name"]), matching.any_of(["mail"], "mail"), matching.sounds(["name"])]
    got = {r.id: (r.group_id, r.confidence) for r in matching.grouped(df, rules, "id", ["name", "mail"]).collect()}
    assert got == {3: (3, 98), 4: (3, 98)}
    assert matching.grouped(df.where("false"), rules, "id", ["name", "mail"]).count() == 0


def test_two_full_names_share_an_initial_only_through_it(spark):
    df = spark.createDataFrame([(1, "Jean Dupont"), (2, "Jacques Dupont"), (3, "Marie Noir"), (4, "M. Noir"), (5, "Z Noir")], "id long, name string")
    links = {(r.id, r.root) for r in matching.name_initials(["name"]).links(df, "id").collect()}
    assert links == set()  # M. is a title, and no name begins with z
    df = df.union(spark.createDataFrame([(6, "J. Dupont")], df.schema))
    assert {(r.id, r.root) for r in matching.name_initials(["name"]).links(df, "id").collect()} == {(6, 1), (6, 2)}


def test_sounds_follow_leaders_in_row_order(spark):
    words = ["robert", "rupert", "roobert", "rubert", "robertt"]
    df = spark.createDataFrame(list(enumerate(words)), "id long, name string")
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    leaders, want = [], set()
    for i, w in enumerate(words):
        near = next((k for k, lead in leaders if 1 - distance(w, lead) / max(len(w), len(lead)) >= 0.8), None)
        if near is None:
            leaders.append((i, w))
        else:
            want.add((i, near))
    assert {(r.id, r.root) for r in matching.sounds(["name"], like=0.8).links(df, "id").collect()} == want


def test_numbers_and_dates_that_stay(spark):
    cells = ["1 234,5", "0612", "", None, "12 kg", "-7,25 €", "1.234.567,8", "9" * 40, "(3)"]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    assert [r[0] for r in df.select(edits.convert_number("c", "en")).collect()] == ["1,234.5", "0612", "", "", "12 kg", "-7.25 €", "1,234,567.8", ",".join(["9"] + ["999"] * 13), "(3)"]
    assert [r[0] for r in df.select(edits.convert_number("c", "point", decimals=1)).collect()] == ["1234.5", "0612", "", "", "12 kg", "-7.3 €", "1234567.8", "9" * 40, "(3)"]
    dates = spark.createDataFrame([(c,) for c in ["31/02/2024", "29/02/24", "1-2-99", None, "2024-13-01", "1/2/2024 8:05"]], "c string")
    assert [r[0] for r in dates.select(edits.convert_date("c", pivot=36)).collect()] == ["31/02/2024", "2024-02-29", "1999-02-01", "", "2024-13-01", "2024-02-01 8:05"]


def test_findings_on_empty_tables(spark):
    df = spark.createDataFrame([], "rid long, a string, b string")
    assert quality.written_otherwise(df, "a", "rid").count() == 0
    assert quality.hidden_ratios(df, ["a", "b"]).count() == 0
    assert quality.hidden_sums(df, ["rid", "a", "b"]).count() == 0
    assert quality.pattern_hints(df, "a").count() == 0
    assert [r.summed for r in guesses.summed_columns(df, ["a"]).collect()] == [False]
    assert edits.without_empty_columns(df).columns == []
    assert guesses.reading(df, "a").first().kind == "text"


def test_pattern_hints_escape_signs(spark):
    df = spark.createDataFrame([("A.1",), ("B.22",), ("x$",), (None,)], "c string")
    assert {r.pattern: r.n for r in quality.pattern_hints(df, "c").collect()} == {r"\p{Lu}\.[0-9]{1,2}": 2, r"\p{Ll}\$": 1}


def test_suggested_rules_and_pivot_choice(spark):
    df = spark.createDataFrame([(f"Jo{'abcdefghij'[i]}", "Lee", f"m{i}@x.org", "u" if i % 2 else "v", 1.5 * i) for i in range(10)], "first string, last string, mail string, state string, price double")
    assert [r.label for r in guesses.suggested_rules(df, df.columns)] == ["mail", "name: first + last"]
    assert guesses.pivot_choice(df, ["state", "mail", "price"]) == {"rows": "state", "columns": "mail", "value": "price"}
    assert guesses.same_titles(["Ville", "x"], ["VILLE", "y"]) == [("Ville", "VILLE")]


def test_hidden_values_keep_their_form(spark):
    df = spark.createDataFrame([("06 12-34",), ("06 12-34",), ("",), (None,), ("Ann Lee",)], "c string")
    got = [r[0] for r in df.select(edits.hidden("c", "digits", "k")).collect()]
    assert got[0] == got[1] and re.fullmatch(r"\d\d \d\d-\d\d", got[0]) and got[2:] == ["", "", "Ann Lee"]
    assert [r[0] for r in df.select(edits.hidden("c", "initial")).collect()][4] == "A. L."
    same = [r[0] for r in df.select(edits.hidden("c", "scramble", "k")).collect()]
    assert re.fullmatch(r"\d\d \d\d-\d\d", same[0]) and re.fullmatch("[A-Z][a-z]{2} [A-Z][a-z]{2}", same[4])
    names = [r[0] for r in df.select(edits.drawn_from("c", ["x", "y", "z"], "k")).collect()]
    assert names[0] == names[1] and names[0] in "xyz" and names[2:4] == ["", ""]
    days = spark.createDataFrame([("2024-03-01",), ("no day",)], "c string")
    moved = [r[0] for r in days.select(edits.hidden("c", "shift", "k", days=3)).collect()]
    assert "2024-02-27" <= moved[0] <= "2024-03-04" and moved[1] == ""


def test_schemas_as_json():
    fields = [quality.Field("id", "integer", required=True, unique=True), quality.Field("state", enum=("a", "b"), max_length=1)]
    said = quality.to_table_schema(fields, ["id"])
    assert said["primaryKey"] == ["id"] and quality.from_table_schema(said) == fields


def test_patterns_find_what_folded_texts_contain(spark):
    from gridwright.functions.text import fold, folded_pattern

    rng = np.random.default_rng(2)
    letters = list("sSßẞaeéÉoœŒæÆkK iİşσςΣ-.^[]\\&z")
    texts = ["".join(rng.choice(letters, rng.integers(0, 12))) for _ in range(3000)] + ["Straße", "STRASSE", "cœur", "ÆON", "été", "a b"]
    terms = sorted({"".join(rng.choice(letters, rng.integers(1, 4))) for _ in range(150)} | {"strasse", "asse", "sse", "as", "oeu", "aeon", "ÉTÉ", "a b", "ß"})
    terms = [t for t in terms if folded_pattern(t) and "İ" not in t]
    assert len(terms) > 60
    df = spark.createDataFrame([(t,) for t in texts if "İ" not in t], "t string")
    wrong = df.agg(*[F.count_if(F.col("t").rlike(folded_pattern(x)) != fold("t").contains(fold(F.lit(x)))).alias(f"c{i}") for i, x in enumerate(terms)]).first()
    assert {x: n for x, n in zip(terms, wrong, strict=True) if n} == {}


def test_typed_conditions_reach_the_scan(spark, tmp_path):
    from gridwright.operators import filters

    path = str(tmp_path / "t")
    spark.range(1000).selectExpr("id", "id / 4D AS price", "date_add(DATE '2024-01-01', cast(id AS int)) AS day", "cast(id AS string) || ' €' AS written").write.parquet(path)
    df = spark.read.parquet(path)
    for conditions, n in (({"price": ">=100,25"}, 599), ({"id": "<10"}, 10), ({"day": ">31/12/2025"}, 269)):
        got = filters.keep_where(df, conditions)
        plan = got._jdf.queryExecution().executedPlan().toString()
        pushed = re.search(r"PushedFilters: \[(.*?)\]", plan)[1]
        assert got.count() == n and re.search("Than", pushed), (conditions, pushed)
    assert filters.keep_where(df, {"written": ">= 1 0 0"}).count() == 900
    assert filters.keep_where(df, {"day": ">= 2024-01-02 00:00"}).count() == 999
