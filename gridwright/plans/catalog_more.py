"""More registered queries: files in blocks and encodings, rules learnt from examples, diagnosed lines, sounds, phone numbers, text order, schemas and findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import methods, phones, sounds
from ..functions.text import sort_key, tie_key
from ..operators import by_example, dependencies, diagnosis, schemas
from ..sources import readers, writers
from .catalog import ORACLE_SQL, QUERIES, _place, _query  # noqa: F401
from .durable import keep, number_rows, remove


@_query("T15_fill_by_example", """
    SELECT c_custkey, lower(c_name[1:8]) || '-' || c_name[10:] || '@' || lower(c_mktsegment) || '.example' AS mail FROM customer""")
def _(t):
    """The first customer of each segment has a mail address; the others get theirs by the rule that these tell."""
    c = t("customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    firsts = F.broadcast(c.groupBy("c_mktsegment").agg(F.min("c_custkey").alias("first")))  # a row for each of the few segments
    typed = F.expr("lower(substr(c_name, 1, 8)) || '-' || substr(c_name, 10) || '@' || lower(c_mktsegment) || '.example'")
    table = c.join(firsts, "c_mktsegment").withColumn("mail", F.when(F.col("c_custkey") == F.col("first"), typed).otherwise("")).drop("first")
    rule = by_example.learn(by_example.column_examples(table, "mail", ["c_custkey"]))
    return by_example.fill_by_example(table, "mail", rule).select("c_custkey", "mail")


@_query("T15_fill_dates", "SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') || ' (' || lower(o_orderstatus) || ')' AS label FROM orders")
def _(t):
    o = t("orders").select("o_orderkey", "o_orderdate", "o_orderstatus")
    typed = F.concat(F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit(" ("), F.lower("o_orderstatus"), F.lit(")"))
    table = o.withColumn("label", F.when(F.col("o_orderkey") <= 40, typed).otherwise(""))
    rule = by_example.learn(by_example.column_examples(table, "label", ["o_orderkey"]))
    return by_example.fill_by_example(table, "label", rule).select("o_orderkey", "label")


@_query("S1_breaks_in_cells", "SELECT doc_id::VARCHAR AS doc_id, md5(text) AS text_md5, lang, '0' AS wrong_quotes FROM documents")
def _(t):
    """All documents as a file whose quoted cells hold line breaks, quotes and delimiters, read by many tasks."""
    d = t("documents").select("doc_id", "text", "lang")
    path = _place(d, "csv")
    writers.write_encoded(d, path, "UTF-8", ";")
    back = readers.read_quoted(d.sparkSession, path, ";", wrong_quotes="wrong_quotes")
    return back.select("doc_id", F.md5("text").alias("text_md5"), "lang", F.col("wrong_quotes").cast("string").alias("wrong_quotes"))


@_query("S6_encodings", """
    SELECT e.encoding, doc_id::VARCHAR AS doc_id, md5(text) AS text_md5 FROM documents, (VALUES ('UTF-16LE'), ('UTF-16BE'), ('UTF-32LE'), ('GB18030')) e(encoding)
    UNION ALL SELECT e.encoding, p_partkey::VARCHAR, md5('Hôtel à ' || p_name || ', Noël; ' || p_brand)
    FROM part, (VALUES ('windows-1252'), ('ISO-8859-15'), ('Macintosh'), ('windows-1254')) e(encoding)""")
def _(t):
    """Tables written in an encoding each and read again, where it is told by the bytes for all but code pages that hold the same letters alike.

    In four encodings texts take nine times their size. So files are compressed, and each is removed when what was read from it is kept.
    """
    spark = t("part").sparkSession
    documents = t("documents").select("doc_id", "text")
    parts = t("part").select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("Hôtel à "), "p_name", F.lit(", Noël; "), "p_brand").alias("text"))
    found = []
    for table, names, told in ((documents, ("UTF-16LE", "UTF-16BE", "UTF-32LE", "GB18030"), ("UTF-16LE", "UTF-16BE", "UTF-32LE")), (parts, ("windows-1252", "ISO-8859-15", "Macintosh", "windows-1254"), ("windows-1252", "Macintosh"))):
        for name in names:
            path = _place(table, "csv")
            writers.write_encoded(table, path, name, compression="gzip")
            back = readers.read_delimited(spark, path, ",", True, None if name in told else name)
            digests = keep(back.select("doc_id", F.unhex(F.md5("text")).alias("digest")))
            remove(spark, path)
            found.append(digests.select(F.lit(name).alias("encoding"), "doc_id", F.lower(F.hex("digest")).alias("text_md5")))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


#: A row of each kind of damage in a file of four columns, by key % 20: text of the record, then what is found and how it is repaired.
_DAMAGE = [
    ("{k};rue 1;{n};12", "", ""),
    ("{k};rue; 1;{n};12", "extra-fields", "merge"),
    ("{k};rue 1;{n};12;;", "trailing-delimiter", "trim"),
    ("{k};rue 1\nbat. B;{n};12", "split-line / missing-fields", "join / pad"),
    ("{k};rue 1;{n}", "missing-fields", "pad"),
    ('{k};"rue"1 "a";{n};12', "text-after-quote", ""),
    ('{k};"rue"1\nx";{n};12', "runaway-quote", ""),
    ('{k}; "rue 1";{n};12', "space-before-quote", ""),
    ('{k};rue "1";{n};12', "quote-inside", ""),
    ('{k};"rue\n1";{n};12', "multiline", ""),
    ("{k};rue\0 1;{n};12", "nul", ""),
    ("{k};rue � 1;{n};12", "replacement", ""),
    ("{k};rue​ 1;{n};12", "invisible", ""),
    ("{k};rÃ©e 1;{n};12", "mojibake", ""),
    ("{k};=1+1;{n};12", "formula", ""),
    ("{k};rue 👨‍👩‍👧 1;{n};12", "", ""),
    ("{k};;{n};-12", "", ""),
    ('{k};"a ""b""; c";{n};12', "", ""),
    ("{k};-12,5;{n};--", "", ""),
    ("{k};rue 1;{n};12", "", ""),
]


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\0", "' || chr(0) || '").replace("\n", "' || chr(10) || '") + "'"


_KINDS_SQL = " ".join(f"WHEN {k} THEN '{kind}'" for k, (_, kind, _) in enumerate(_DAMAGE))
_REPAIRS_SQL = " ".join(f"WHEN {k} THEN '{repair}'" for k, (_, _, repair) in enumerate(_DAMAGE))


@_query("V8_diagnosis", f"""
    WITH c AS (SELECT c_custkey, CASE c_custkey % 20 {_KINDS_SQL} END AS kinds, CASE c_custkey % 20 {_REPAIRS_SQL} END AS repairs FROM customer)
    SELECT 'UTF-8' AS encoding, split_part(kinds, ' / ', k) AS kinds, split_part(repairs, ' / ', k) AS repair, count(*) AS n
    FROM c, (VALUES (1), (2)) v(k) WHERE k = 1 OR contains(kinds, ' / ') GROUP BY ALL
    UNION ALL SELECT 'windows-1252', CASE c_custkey % 3 WHEN 0 THEN 'utf8-line' WHEN 1 THEN 'cp1252' ELSE '' END, CASE c_custkey % 3 WHEN 0 THEN 'reencode' ELSE '' END, count(*) FROM customer GROUP BY ALL
    UNION ALL SELECT 'unclosed', CASE WHEN c_custkey = (SELECT max(c_custkey) FROM customer) THEN 'missing-fields, unclosed-quote' ELSE '' END, CASE WHEN c_custkey = (SELECT max(c_custkey) FROM customer) THEN 'pad' ELSE '' END, count(*) FROM customer GROUP BY ALL""")
def _(t):
    """Customers as files with rows damaged in every way: the findings and repairs, counted."""
    c, key = t("customer").select("c_custkey", "c_name"), F.col("c_custkey")
    spark = c.sparkSession
    record = F.when(F.lit(False), "")
    for k, (template, _, _) in enumerate(_DAMAGE):
        record = record.when(key % 20 == k, F.replace(F.replace(F.lit(template), F.lit("{k}"), key.cast("string")), F.lit("{n}"), F.col("c_name")))
    last = c.agg(F.max("c_custkey")).first()[0]
    as_bytes = lambda x, name: F.encode(x, name).cast("string")
    accented = F.concat(key.cast("string"), F.lit(";ré;"), "c_name", F.lit(";12"))
    files = {
        "UTF-8": record,
        "windows-1252": F.when(key % 3 == 0, as_bytes(accented, "UTF-8")).when(key % 3 == 1, as_bytes(accented, "ISO-8859-1")).otherwise(F.replace(accented, F.lit("é"), F.lit("e"))),
        "unclosed": F.concat(key.cast("string"), F.when(key == last, ';"rue;').otherwise(";rue;"), "c_name", F.lit(";12")),
    }
    out = None
    for name, value in files.items():
        path = _place(c, "csv")
        rows = c if name != "unclosed" else c.repartitionByRange(1, "c_custkey").sortWithinPartitions("c_custkey")
        rows.select(value.alias("value")).write.text(path)
        found = diagnosis.diagnose(spark, path, ["id", "street", "name", "size"], ";", "windows-1252" if name == "windows-1252" else "UTF-8", header=False)
        kinds = F.array_join(F.transform("findings", lambda f: f["kind"]), ", ")
        one = found.select(F.lit(name).alias("encoding"), kinds.alias("kinds"), F.coalesce("repair", F.lit("")).alias("repair"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("encoding", "kinds", "repair").agg(F.count("*").alias("n"))


#: Countries in turn: calling code, what national numbers begin with, digits behind which the key follows.
_PLAN = (("33", "0", "6"), ("32", "0", "47"), ("41", "0", "79"), ("44", "0", "20"), ("49", "0", "30"), ("34", "", "91"), ("39", "", "06"), ("351", "", "21"), ("31", "0", "6"), ("43", "0", "66"), ("46", "0", "70"), ("1", "", "20"))
_PLAN_SQL = ", ".join(f"({k}, '{code}', '{trunk}', '{first}', {9 - len(first) if code == '33' else 10 - len(first) if code == '1' else 8})" for k, (code, trunk, first) in enumerate(_PLAN))
_NUMBERED = f"""
    WITH p AS (SELECT * FROM (VALUES {_PLAN_SQL}) v(k, code, trunk, first, width)),
    c AS (SELECT c_custkey, code, trunk, first || lpad(reverse(cast(c_custkey * 7919 + 12345 AS VARCHAR)), width, '4271') AS own FROM customer JOIN p ON c_custkey % 12 = k)"""


def _numbered(t):
    """Customers with a national phone number, each of the country whose turn it is."""
    plan = F.create_map(*[x for k, row in enumerate(_PLAN) for x in (F.lit(k), F.array(*map(F.lit, row)))])
    row = F.try_element_at(plan, (F.col("c_custkey") % 12).cast("int"))
    width = F.when(row[0] == "33", 9 - F.length(row[2])).when(row[0] == "1", 10 - F.length(row[2])).otherwise(8)
    c = t("customer").select("c_custkey", row[0].alias("code"), row[1].alias("trunk"), row[2].alias("first"), width.alias("width"))
    number = F.concat("trunk", "first", F.lit(" "), F.expr("lpad(reverse(cast(c_custkey * 7919 + 12345 as string)), width, '4271')"))
    return c.select("c_custkey", "code", number.alias("phone"))


@_query("T7_phone_forms", _NUMBERED + """
    SELECT c_custkey, '+' || code || own AS e164, CASE code WHEN '33' THEN '+33 ' || own[1] || regexp_replace(own[2:], '(..)', ' \\1', 'g') ELSE '+' || code || own END AS intl,
           CASE code WHEN '33' THEN '0' || own[1] || regexp_replace(own[2:], '(..)', ' \\1', 'g') ELSE trunk || own END AS nat FROM c""")
def _(t):
    return _numbered(t).select("c_custkey", *[phones.written("phone", to, F.col("code")).alias(to) for to in ("e164", "intl", "nat")])


@_query("D1_phones_of_countries", _NUMBERED + " SELECT '+' || code || own AS e164, count(*) * 2 AS n, min(c_custkey) AS first FROM c GROUP BY ALL")
def _(t):
    """Numbers of customers and their international forms meet in one key, the country told by its name."""
    names = F.create_map(*[F.lit(x) for pair in (("33", "France"), ("32", "Belgique"), ("41", "Suisse"), ("44", "United Kingdom"), ("49", "ALLEMAGNE"), ("34", "España"), ("39", "it"), ("351", "Portugal"), ("31", "Pays-Bas"), ("43", "Austria"), ("46", "Suède"), ("1", "États-Unis")) for x in pair])
    c = _numbered(t).withColumn("country", F.try_element_at(names, F.col("code")))
    own = F.when(F.col("code") == "39", F.col("phone")).otherwise(F.regexp_replace("phone", "^0", ""))
    abroad = c.withColumn("phone", F.concat(F.lit("00"), "code", F.lit(" (0)"), own)).withColumn("country", F.lit(None).cast("string"))
    keys = c.unionByName(abroad).select("c_custkey", phones.e164("phone", F.coalesce(phones.calling_code("country"), F.lit("33"))).alias("e164"))
    return keys.groupBy("e164").agg(F.count("*").alias("n"), F.min("c_custkey").alias("first"))


#: Names, how they sound and their code.
_HEARD = (("Dupont", "dup3", "TPN"), ("DUPOND", "dup3", "TPN"), ("Lefebvre", "lefevr", "LFR"), ("Lefèvre", "lefevr", "LFR"), ("Philippe", "filip", "FLP"), ("Filippe", "filip", "FLP"), ("Christophe", "kristof", "KRSTF"), ("Kristof", "kristof", "KRSTF"), ("Schmitt", "Smi", "XM"), ("Schmidt", "Smi", "XM"), ("Guillaume", "gilom", "KLM"))
_HEARD_SQL = ", ".join(f"({k}, '{n}', '{s}', '{c}')" for k, (n, s, c) in enumerate(_HEARD))


@_query("D6_french_sounds", f"SELECT c_custkey, sound, code FROM customer JOIN (VALUES {_HEARD_SQL}) v(k, name, sound, code) ON c_custkey % 11 = k")
def _(t):
    name = F.element_at(F.array(*[F.lit(n) for n, _, _ in _HEARD]), (F.col("c_custkey") % 11 + 1).cast("int"))
    c = t("customer").select("c_custkey", name.alias("name"))
    return c.select("c_custkey", sounds.transcription("name").alias("sound"), sounds.phonetic("name").alias("code"))


_IN_ORDER = ("#3", "_x", "9", "10", "a b", "a-b", "ab", "emile", "Emile", "EMILE", "émile", "Émile", "èmile", "emma", "lot", "Lot 1", "lot 2", "lot 02b", "Lot 10", "lot 10000000000000000000001", "oeuvre", "Oeuvre", "œuvre", "Zoe", "zoé")
_IN_ORDER_SQL = ", ".join(f"({k}, '{v}')" for k, v in enumerate(_IN_ORDER))


@_query("O3_text_order", f"SELECT c_custkey, value, row_number() OVER (ORDER BY k, c_custkey) AS place FROM customer JOIN (VALUES {_IN_ORDER_SQL}) v(k, value) ON c_custkey * 7 % 25 = k")
def _(t):
    value = F.element_at(F.array(*map(F.lit, _IN_ORDER)), (F.col("c_custkey") * 7 % 25 + 1).cast("int"))
    c = t("customer").select("c_custkey", value.alias("value"))
    return number_rows(c, [sort_key("value"), tie_key("value"), F.col("c_custkey")], "place")


_RULED = """
    SELECT o_orderkey::VARCHAR AS id, lpad((o_orderkey % 7)::VARCHAR, 5, '0') AS code, o_orderkey::VARCHAR || ',' || (o_orderkey % 10)::VARCHAR || '0' AS amount, strftime(o_orderdate, '%d/%m/%Y') AS day,
           CASE WHEN o_orderkey % 3 = 0 THEN 'non' ELSE 'oui' END AS active, 'c' || o_orderkey || '@x.example' AS mail, o_orderpriority AS priority, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'free ' || o_custkey END AS note,
           CASE WHEN o_orderkey % 2 = 0 THEN '-' ELSE '' END || (o_orderkey % 50)::VARCHAR AS change, '06' || lpad((o_custkey % 1000)::VARCHAR, 8, '1') AS phone, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders"""


def _ruled(t):
    o = t("orders")
    return o.selectExpr(
        "o_orderkey AS row", "cast(o_orderkey AS string) AS id", "lpad(cast(o_orderkey % 7 AS string), 5, '0') AS code", "concat(o_orderkey, ',', o_orderkey % 10, '0') AS amount", "date_format(o_orderdate, 'dd/MM/yyyy') AS day",
        "if(o_orderkey % 3 = 0, 'non', 'oui') AS active", "concat('c', o_orderkey, '@x.example') AS mail", "o_orderpriority AS priority", "if(o_orderkey % 4 = 0, '', concat('free ', o_custkey)) AS note",
        "concat(if(o_orderkey % 2 = 0, '-', ''), o_orderkey % 50) AS change", "concat('06', lpad(cast(o_custkey % 1000 AS string), 8, '1')) AS phone", "date_format(o_orderdate, 'yyyy-MM-dd') AS iso",
    )


_RULED_COLUMNS = ("id", "code", "amount", "day", "active", "mail", "priority", "note", "change", "phone", "iso")


@_query("V1_schema", f"""
    WITH o AS ({_RULED}), c AS (UNPIVOT o ON COLUMNS(*) INTO NAME name VALUE v),
    s AS (SELECT name, count(*) FILTER (v = '') = 0 AS required, count(DISTINCT v) = count(*) AS different, count(DISTINCT v) FILTER (v <> '') AS n_values, count(*) FILTER (v <> '') AS n, bool_or(starts_with(v, '-')) AS negative, max(length(v)) AS longest, min(length(v)) AS shortest,
          string_agg(DISTINCT v, '|' ORDER BY v) FILTER (name = 'priority') AS vs FROM c GROUP BY name)
    SELECT name, CASE name WHEN 'id' THEN 'integer' WHEN 'amount' THEN 'number' WHEN 'day' THEN 'date' WHEN 'active' THEN 'boolean' WHEN 'change' THEN 'integer' WHEN 'iso' THEN 'date' ELSE 'string' END AS type,
           CASE name WHEN 'day' THEN '%d/%m/%Y' WHEN 'mail' THEN 'email' ELSE '' END AS format, CASE name WHEN 'amount' THEN ',' ELSE '' END AS decimal_char,
           required, CASE WHEN name IN ('id', 'change', 'mail', 'priority') THEN required AND different ELSE false END AS is_unique,
           CASE WHEN name IN ('code', 'phone') AND longest = shortest THEN '\\d{{' || longest || '}}' ELSE '' END AS pattern, name IN ('id', 'amount', 'change') AND NOT negative AS not_negative,
           CASE WHEN name = 'priority' AND n_values <= 15 AND n >= 10 * n_values THEN vs ELSE '' END AS allowed, name = 'id' AND required AND different AS is_key FROM s""")
def _(t):
    found = schemas.infer_schema(_ruled(t), _RULED_COLUMNS)
    rows = []
    for f in found["fields"]:
        k = f.get("constraints", {})
        rows.append((f["name"], f["type"], f.get("format", ""), f.get("decimalChar", ""), k.get("required", False), k.get("unique", False), k.get("pattern", ""), "minimum" in k, "|".join(sorted(k.get("enum", []))), found.get("primaryKey") == f["name"]))
    return t("orders").sparkSession.createDataFrame(rows, "name string, type string, format string, decimal_char string, required boolean, is_unique boolean, pattern string, not_negative boolean, allowed string, is_key boolean")


@_query("V2_check_rows", """
    WITH o AS (SELECT o_orderkey AS k FROM orders), e AS (
        SELECT 'id' AS field, 'unique' AS rule, k, (k - 1)::VARCHAR AS v FROM o WHERE k % 50 = 1 AND k - 1 IN (SELECT k FROM o) UNION ALL SELECT 'code', 'pattern', k, '12' FROM o WHERE k % 40 = 2 UNION ALL SELECT 'amount', 'type', k, 'abc' FROM o WHERE k % 30 = 3
        UNION ALL SELECT 'amount', 'minimum', k, '-3,00' FROM o WHERE k % 30 = 4 UNION ALL SELECT 'day', 'type', k, '31/02/2024' FROM o WHERE k % 20 = 5 UNION ALL SELECT 'active', 'type', k, 'maybe' FROM o WHERE k % 20 = 6 UNION ALL SELECT 'mail', 'type', k, 'no-mail' FROM o WHERE k % 20 = 7
        UNION ALL SELECT 'priority', 'required', k, '' FROM o WHERE k % 20 = 8 UNION ALL SELECT 'note', 'edges', k, ' ' || k || ' ' FROM o WHERE k % 20 = 9 UNION ALL SELECT '', 'fields', k, 'row ' || k FROM o WHERE k % 20 = 10 UNION ALL SELECT 'mail', 'unique', k, 'no-mail' FROM o WHERE k % 20 = 7 AND k > (SELECT min(k) FROM o WHERE k % 20 = 7)),
    r AS (SELECT *, row_number() OVER (PARTITION BY field, rule ORDER BY k) AS i FROM e)
    SELECT field, rule, count(*) AS n, min(k) AS first_row, string_agg(v, ' / ' ORDER BY k) FILTER (i <= 3) AS examples FROM r GROUP BY field, rule
    UNION ALL SELECT 'gone', 'missing', 1, NULL, '' UNION ALL SELECT 'iso', 'unexpected', 1, NULL, ''""")
def _(t):
    k = F.col("row")
    o = _ruled(t).drop("change", "phone")
    spoilt = {"id": F.when(k % 50 == 1, (k - 1).cast("string")), "code": F.when(k % 40 == 2, "12"), "amount": F.when(k % 30 == 3, "abc").when(k % 30 == 4, "-3,00"), "day": F.when(k % 20 == 5, "31/02/2024"), "active": F.when(k % 20 == 6, "maybe"), "mail": F.when(k % 20 == 7, "no-mail"), "priority": F.when(k % 20 == 8, ""), "note": F.when(k % 20 == 9, F.concat(F.lit(" "), k.cast("string"), F.lit(" ")))}
    o = o.withColumns({c: x.otherwise(F.col(c)) for c, x in spoilt.items()})
    rule = lambda **x: {"constraints": x}
    fields = [
        {"name": "id", "type": "integer"} | rule(unique=True), {"name": "code"} | rule(pattern=r"\d{5}"), {"name": "amount", "type": "number", "decimalChar": ","} | rule(minimum=0), {"name": "day", "type": "date", "format": "%d/%m/%Y"},
        {"name": "active", "type": "boolean", "trueValues": ["oui"], "falseValues": ["non"]}, {"name": "mail", "type": "string", "format": "email"} | rule(unique=True), {"name": "priority"} | rule(required=True), {"name": "note"}, {"name": "gone"},
    ]
    found = schemas.check_rows(o, {"fields": fields}, "row", checks={"note": ["edges"]}, width=F.when(k % 20 == 10, 8).otherwise(9))
    return found.withColumn("examples", F.array_join("examples", " / "))


#: Columns of customers and their nations, some values changed: nation decides region, but not in a few rows.
_PLACES = "SELECT c_custkey, n_name AS nation, CASE WHEN c_custkey % 97 = 0 THEN 'region ' || (n_regionkey + 1) % 5 ELSE 'region ' || n_regionkey END AS region, c_mktsegment AS segment, CASE WHEN c_custkey % 60 = 0 THEN 'X' ELSE c_mktsegment[1:2] END AS short, n_nationkey::VARCHAR AS number FROM customer JOIN nation ON c_nationkey = n_nationkey"
_PLACE_COLUMNS = ("nation", "region", "segment", "short", "number")
_PLACE_PAIRS = " UNION ALL ".join(f"SELECT {i * 10 + j} AS k, {i} AS ka, {j} AS kb, '{a}' AS decides, '{b}' AS decided, {a} AS a, {b} AS b FROM p" for i, a in enumerate(_PLACE_COLUMNS) for j, b in enumerate(_PLACE_COLUMNS) if a != b)


@_query("I9_decisions", f"""
    WITH p AS ({_PLACES}), c AS ({_PLACE_PAIRS}),
    d AS (SELECT decides AS name, count(DISTINCT a) AS d, (SELECT count(*) FROM p) AS n FROM c GROUP BY decides),
    g AS (SELECT k, ka, kb, decides, decided, a, b, count(*) AS n FROM c GROUP BY ALL), u AS (SELECT k, ka, kb, decides, decided, a, sum(n) AS size, max(n) AS most, arg_min(b, (-n, b)) AS usual FROM g GROUP BY ALL HAVING sum(n) >= 2),
    s AS (SELECT k, ka, kb, decides, decided, count(*) AS groups, sum(size) AS cover, sum(size - most) AS broken, count(DISTINCT usual) AS modes FROM u GROUP BY ALL),
    h AS (SELECT s.* FROM s JOIN d da ON da.name = decides JOIN d db ON db.name = decided WHERE da.d BETWEEN 2 AND da.n / 2 AND db.d >= 2 AND db.d < 0.9 * db.n AND db.d <= 1.1 * da.d + 2 AND groups >= 5 AND cover >= 3 * groups AND cover >= 0.3 * da.n AND broken > 0 AND broken <= 0.02 * cover AND broken <= groups AND modes >= 2)
    SELECT decides, decided, cover::BIGINT AS cover, broken::BIGINT AS broken, groups FROM h WHERE NOT EXISTS (SELECT 1 FROM h r WHERE r.ka = h.kb AND r.kb = h.ka AND r.k < h.k) ORDER BY broken / cover, k LIMIT 3""")
def _(t):
    places = t("customer").join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey")).selectExpr(
        "c_custkey", "n_name AS nation", "if(c_custkey % 97 = 0, concat('region ', (n_regionkey + 1) % 5), concat('region ', n_regionkey)) AS region", "c_mktsegment AS segment", "if(c_custkey % 60 = 0, 'X', substr(c_mktsegment, 1, 2)) AS short", "cast(n_nationkey AS string) AS number"
    )
    return dependencies.decisions(places, _PLACE_COLUMNS)


@_query("I3_near_keys", """
    WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 500 = 7 THEN 'K' || (c_custkey - 1) ELSE 'K' || c_custkey END AS code FROM customer), r AS (SELECT code, count(*) AS n FROM c GROUP BY code HAVING count(*) > 1)
    SELECT 'code' AS column_name, count(*) = 0 AS is_key, count(*) AS repeated_values, coalesce(sum(n), 0)::BIGINT AS repeated_rows, coalesce((SELECT code FROM r ORDER BY -n, (SELECT min(c_custkey) FROM c WHERE c.code = r.code) LIMIT 1), '') AS example FROM r
    UNION ALL SELECT 'c_custkey', true, 0, 0, ''""")
def _(t):
    c = t("customer").selectExpr("c_custkey AS row", "cast(c_custkey AS string) AS c_custkey", "if(c_custkey % 500 = 7, concat('K', c_custkey - 1), concat('K', c_custkey)) AS code", "c_mktsegment", "cast(c_acctbal AS string) AS c_acctbal")
    return dependencies.near_keys(c, ["c_custkey", "code", "c_mktsegment"], "row")


# methods of texts, numbers and dates


@_query("M1_text_methods", """
    SELECT p_partkey, p_name[-4:] AS tail, substr(p_name, 3, 4) AS middle, CASE WHEN length(p_name) > 12 THEN substr(p_name, 13, 1) END AS thirteenth, (strpos(p_name, 'a') - 1)::INT AS first_a,
           (CASE WHEN contains(p_name, 'a') THEN length(p_name) - strpos(reverse(p_name), 'a') ELSE -1 END)::INT AS last_a, CASE WHEN lower(p_type) < lower(p_name) THEN -1 WHEN lower(p_type) > lower(p_name) THEN 1 ELSE 0 END AS compared,
           starts_with(p_name[6:], 'a') AS starts, len(string_split(p_name, ' '))::INT AS words, string_split(p_name, ' ')[-1] AS last_word, rpad(p_brand, 12, '.') AS padded, list_contains(string_split(p_type, ' '), 'STANDARD') AS standard
    FROM part""")
def _(t):
    p = t("part")
    words = methods.split_list("p_name", " ")
    return p.select("p_partkey", methods.slice_text("p_name", -4).alias("tail"), methods.substring("p_name", 6, 2).alias("middle"), methods.at("p_name", 12).alias("thirteenth"), methods.index_of("p_name", "a").alias("first_a"), methods.last_index_of("p_name", "a").alias("last_a"), methods.compare("p_type", "p_name").alias("compared"), methods.starts_with("p_name", "a", 5).alias("starts"), F.size(words).alias("words"), methods.list_at(words, -1).alias("last_word"), methods.pad_end("p_brand", 12, ".").alias("padded"), (methods.list_index_of(methods.split_list("p_type", " "), "STANDARD") >= 0).alias("standard"))


@_query("M2_patterns", """
    SELECT doc_id, md5(regexp_replace(coalesce(text, ''), '([aeiou])([a-z])', '\\2[\\1]', 'g')) AS swapped, md5(regexp_replace(coalesce(text, ''), '([A-Za-z]+) ([a-z]+)', '\\2 \\1')) AS first_swapped,
           (CASE WHEN regexp_matches(text, '[0-9]+') THEN length(regexp_extract(text, '^[^0-9]*')) ELSE -1 END)::INT AS digits_at, len(regexp_extract_all(coalesce(text, ''), '[A-Z][a-z]+'))::INT AS capitals
    FROM documents""")
def _(t):
    return t("documents").select("doc_id", F.md5(methods.replace_pattern("text", "([aeiou])([a-z])", "$2[$1]")).alias("swapped"), F.md5(methods.replace_first("text", "([A-Za-z]+) ([a-z]+)", "$2 $1")).alias("first_swapped"), methods.search("text", "[0-9]+").alias("digits_at"), F.size(methods.match_all("text", "[A-Z][a-z]+")).alias("capitals"))


@_query("M3_math", """
    SELECT l_orderkey, l_linenumber, abs(x) AS absolute, ceil(x) AS up, floor(x) AS down, floor(x + 0.5) AS nearest, trunc(x) AS cut, sign(x)::DOUBLE AS sign, round(cbrt(x), 9) AS cube_root, CASE WHEN x >= 0 THEN round(sqrt(x), 9) END AS root,
           round(pow(l_quantity, 1.5), 6) AS power, round(ln(l_quantity), 9) AS log, round(log10(l_quantity), 9) AS log10, round(log2(l_quantity), 9) AS log2, round(exp(l_quantity / 10), 6) AS exp, least(x, l_quantity) AS least, greatest(x, l_quantity) AS most,
           printf('%d', l_orderkey) AS whole, lower(to_hex(l_orderkey)) AS hex
    FROM (SELECT *, (25 - l_quantity) * 1.25 AS x FROM lineitem)""")
def _(t):
    of = methods.math
    q = F.col("l_quantity").cast("double")
    rows = t("lineitem").withColumn("x", (25 - q) * 1.25)
    return rows.select("l_orderkey", "l_linenumber", of("abs", "x").alias("absolute"), of("ceil", "x").alias("up"), of("floor", "x").alias("down"), of("round", "x").alias("nearest"), of("trunc", "x").alias("cut"), of("sign", "x").alias("sign"), F.round(of("cbrt", "x"), 9).alias("cube_root"), F.round(of("sqrt", "x"), 9).alias("root"), F.round(of("pow", q, F.lit(1.5)), 6).alias("power"), F.round(of("log", q), 9).alias("log"), F.round(of("log10", q), 9).alias("log10"), F.round(of("log2", q), 9).alias("log2"), F.round(of("exp", q / 10), 6).alias("exp"), of("min", "x", q).alias("least"), of("max", "x", q).alias("most"), methods.to_fixed("l_orderkey").alias("whole"), methods.to_radix("l_orderkey", 16).alias("hex"))


@_query("M4_date_methods", """
    SELECT event_id, year(ts)::INT AS year, (month(ts) - 1)::INT AS month, day(ts)::INT AS date, dayofweek(ts)::INT AS day, hour(ts)::INT AS hours, minute(ts)::INT AS minutes, second(ts)::INT AS seconds, epoch_us(ts) // 1000 AS time, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS iso
    FROM events""")
def _(t):
    """Times without a zone are taken as universal ones, so that the result does not depend on the session's zone."""
    ts = F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz")))
    part = lambda p: methods.get(ts, p, utc=True)
    return t("events").select("event_id", part("FullYear").alias("year"), part("Month").alias("month"), part("Date").alias("date"), part("Day").alias("day"), part("Hours").alias("hours"), part("Minutes").alias("minutes"), part("Seconds").alias("seconds"), methods.get_time(ts).alias("time"), methods.to_iso(ts).alias("iso"))
