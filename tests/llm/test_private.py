"""Surrogates for personal data: coreference, case, hostile texts, and all documents beside a brute-force search."""

import re

import pytest
import regex
from pyspark.sql import functions as F

from gridwright.llm import pii, queries

SF = "/root/testdata/sf0.001"
ONE = "doc_id long, text string"


def _replaced(spark, texts, key="k"):
    rows = pii.replace_private(spark.createDataFrame(list(enumerate(texts)), ONE), key).orderBy("doc_id").collect()
    return [r.text for r in rows]


def test_names_are_one_person_everywhere(spark):
    texts = ["Mr John Smith came. Smith left, JOHN SMITH said. John's hat.", "Dr. JOHN SMITH and Dr. Anna Maria Schmidt; Schmidt left", "Mr. John Q. Smith", "Smith and John without a person", "Frau von der Leyen, Herr Müller-Lüdenscheidt, Mrs O'Neil's cat"]
    got = _replaced(spark, texts)
    m = re.fullmatch(r"Mr (\w+) (\w+) came\. (\w+) left, (\w+) (\w+) said\. (\w+)'s hat\.", got[0])
    john, smith = m[1], m[2]
    assert m[3] == smith and (m[4], m[5]) == (john.upper(), smith.upper()) and m[6] == john and "John" not in got[0] and "Smith" not in got[0]
    m = re.fullmatch(r"Dr\. (\w+) (\w+) and Dr\. (\w+) (\w+) (\w+); (\w+) left", got[1])
    assert (m[1], m[2]) == (john.upper(), smith.upper()) and m[5] == m[6] and len({john, smith, m[3], m[4], m[5]}) == 5
    m = re.fullmatch(r"Mr\. (\w+) ([A-Z])\. (\w+)", got[2])
    assert m[1] == john and m[3] == smith and m[2] != "Q"
    assert got[3] == texts[3]
    assert not re.search("Leyen|Müller|Neil", got[4]) and re.fullmatch(r"Frau von der \w+, Herr \w+, Mrs \w+'s cat", got[4])


def test_mail_in_any_case_is_one(spark):
    got = _replaced(spark, ["write to anna.b@mail.org", "or Anna.B@Mail.org!", "x ANNA.B@MAIL.ORG"])
    a, b, c = (re.search(r"\S+@\S+?\.\w+", t, re.I)[0] for t in got)
    assert a == b.lower() == c.lower() and b[0].isupper() and c == c.upper() and "anna" not in a


def test_short_formats_never_run_out(spark):
    every = [f"{a}@{b}.io" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"]
    got = _replaced(spark, every)
    assert len(set(got)) == len(every) and not set(got) & set(every) and all(re.fullmatch(r"[a-z]+@[a-z]\.io", t) for t in got)


def test_hostile_texts(spark):
    labels = "x@" + "a." * 100_000 + "com"
    many = "".join(f"Mr Name{chr(97 + k % 26)} q{k}@w.org " for k in range(5_000))
    texts = [labels, "x@" + "." * 100_000, "Mr " + "A-" * 100_000 + "A", "Z" * 300_000, "1 " * 200_000, "+" + "1 " * 100_000 + "+", many, "Mr", "Mr  X", "@", "\n" * 100_000]
    got = _replaced(spark, texts)
    assert got[0] != labels and len(got[0]) == len(labels)
    assert [got[k] for k in (1, 3, 4, 7, 8, 9, 10)] == [texts[k] for k in (1, 3, 4, 7, 8, 9, 10)]
    assert len(re.findall(r"\w+@\w\.org", got[6])) == 5_000 and "Namea" not in got[6]


def test_columns_of_any_name(spark):
    names = ["c0", "of", "entries", "tail", "text", "pos", "n_private", "a b.c"]
    docs = spark.createDataFrame([(1, "x", "y", "z", "mail a.b@c.de", "p", 7, "q"), (None, None, None, None, None, None, None, None), (1, "x", "y", "z", "mail a.b@c.de", "p", 7, "q")], "`c0` long, `of` string, `entries` string, `tail` string, `text` string, `pos` string, `n_private` long, `a b.c` string")
    out = pii.replace_private(docs, "k")
    assert out.columns == [c for c in names if c != "n_private"] + ["n_private"]
    rows = sorted(map(tuple, out.collect()), key=str)
    assert rows[0] == rows[1] and rows[0][:4] == (1, "x", "y", "z") and rows[0][5:] == ("p", "q", 1) and "a.b@c.de" not in rows[0][4]
    assert rows[2] == (None,) * 7 + (0,)


def test_key_is_asked_for(spark):
    with pytest.raises(TypeError):
        pii.replace_private(spark.createDataFrame([(1, "")], ONE))
    assert _replaced(spark, ["a.b@c.de"], "one") != _replaced(spark, ["a.b@c.de"], "two")


def _search(text):
    """Entities of a text by Python's own search: (start, end) of each value, names of a person one by one."""
    out = []
    for m in regex.finditer(pii.PATTERN, text):
        start = m.start()
        if head := regex.match(pii._HONORIFIC, m[0]):
            for word in regex.finditer(r"[^ ]+", m[0][head.end() :]):
                if word[0] not in pii.PARTICLES:
                    out.append((start + head.end() + word.start(), start + head.end() + word.end()))
        elif head := regex.match(pii._ASSIGNMENT, m[0]):
            out.append((start + head.end(), m.end()))
        else:
            out.append((start, m.end()))
    return out


@pytest.mark.parametrize("sf_dir", [SF, "/root/testdata/sf0.01"])
def test_all_documents_beside_a_brute_force_search(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    after = {r.doc_id: r for r in queries.op9_pii(spark, sf_dir).collect()}
    assert after.keys() == before.keys() and docs.where(F.col("text").rlike(pii.PATTERN) & ~pii.may_be_private(F.col("text"))).count() == 0
    drawn, back = {}, {}
    for i, text in before.items():
        found = _search(text or "")
        assert after[i].n_private == len(found)
        if not found:
            assert after[i].text == text
            continue
        ends = [0, *(e for _, e in found)]
        gaps = [text[a:b] for a, (b, _) in zip(ends, found)] + [text[ends[-1] :]]
        m = re.fullmatch("(.+?)".join(map(re.escape, gaps)), after[i].text, re.S)
        assert m, i
        for (a, b), new in zip(found, m.groups(), strict=True):
            value = text[a:b]
            assert drawn.setdefault(value, new) == new and back.setdefault(new, value) == value and new != value
            assert "@" in value or len(new) == len(value) or regex.fullmatch(r"[0-9.]+", value)
    assert not set(drawn) & set(back)


def test_formats_that_were_passed_over(spark):
    """National phones, assigned mail addresses and other honorifics: nothing of the real value stays, and one mailbox has one surrogate."""
    import re

    cases = [
        ("password: jane5doe@mail.org and jane5doe@mail.org", ["jane5doe", "mail.org"]), ("token=abc.def@x1yz7", ["abc.def", "x1yz7"]), ("call 06 12 34 56 78 now", ["12 34 56 78"]), ("call 06.12.34.56.78 now", ["12.34.56.78"]),
        ("call 0612345678.", ["612345678"]), ("call 020 7946 0958", ["7946 0958"]), ("call 0049 30 1234567", ["30 1234567"]), ("MR JOHN SMITH came", ["JOHN", "SMITH"]), ("Lady Ann Porter came", ["Ann", "Porter"]),
        ("Mr. Peter Quill and Mr. Otto Hahn", ["Peter", "Quill", "Otto", "Hahn"]), ("password = " + "x" * 90 + "7", ["x" * 20]),
    ]
    table = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.replace_private(table, "key").collect()}
    for k, (text, gone) in enumerate(cases):
        assert got[k].n_private and not any(g in got[k].text for g in gone), got[k].text
        assert re.sub(r"[\w]", "x", got[k].text.split(" ")[0]) == re.sub(r"[\w]", "x", text.split(" ")[0]) or k >= 7
    mails = re.findall(r"\S+@\S+", got[0].text)
    assert len(mails) == 2 and mails[0] == mails[1]
    plain = ["0.06 12", "on 2024 0612 3456 78901", "version 01.02.03.04", "ratio 0.0612345678", "score 06-12", "id 012345678901234567890"]
    table = spark.createDataFrame([(k, t) for k, t in enumerate(plain)], "doc_id long, text string")
    left = {r.doc_id: r.text for r in pii.replace_private(table, "key").collect()}
    assert {k: left[k] for k in (0, 3, 4, 5)} == {k: plain[k] for k in (0, 3, 4, 5)}


def test_addresses_of_version_six_and_spaced_numbers(spark):
    """An address is one in either case, keeps its groups and its start; times, slices and words with colons stay."""
    found = ["from 2001:db8:85a3::8a2e:370:7334 to", "FROM 2001:DB8:85A3::8A2E:370:7334.", "at fe80::1ff:fe23:4567:890a", "2001:0db8:0000:0042:0000:8a2e:0370:7334", "ssn 123 45 6789."]
    got = _replaced(spark, found)
    a, b = got[0].split(" ")[1], got[1].split(" ")[1].rstrip(".")
    assert a == b.lower() and b == b.upper() and a != found[0].split(" ")[1] and [len(x) for x in a.split(":")] == [4, 3, 4, 0, 4, 3, 4] and a.startswith("20")
    assert re.fullmatch(r"at fe[0-9a-f]{2}::[0-9a-f]{3}:[0-9a-f]{4}:[0-9a-f]{4}:[0-9a-f]{4}", got[2]) and got[2] != found[2]
    assert re.fullmatch(r"(?:[0-9a-f]{4}:){7}[0-9a-f]{4}", got[3]) and got[3] != found[3]
    assert re.fullmatch(r"ssn [0-9]{3} [0-9]{2} [0-9]{4}\.", got[4]) and got[4] != found[4]
    plain = ["at 12:30:45", "x[1::2]", "std::cout", "dead::beef", "2024:01:02", "face: it", "1 123 45 6789", "123 45 6789 1", "a 2001:db8", "64:32"]
    assert _replaced(spark, plain) == plain
    draws = spark.createDataFrame([("ip6", "ip6", "2001:db8::1", k) for k in (0, 23, 24, 150)], "kind string, form string, value string, attempt int")
    drawn = {r.attempt: r.surrogate for r in pii.with_surrogates(draws, "k").collect()}
    assert all(re.fullmatch(r"20[0-9a-f]{2}:[0-9a-f]{3}::[0-9a-f]", drawn[k]) for k in (0, 23)) and all(re.fullmatch(r"20[0-9a-f]{2}(?::[0-9a-f]{4}){7}", drawn[k]) for k in (24, 150)) and drawn[24] != drawn[150]
