"""What columns hold, told from their titles and from all their values: amounts, categories, readings and roles.

Each guess is one aggregation of the table with a row or two for each column; only those rows reach the driver.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import date_key, filled, mail_key, number, phone_key, text, trimmed
from .matching import Rule, all_of, any_of, names

#: Words of the titles of amounts. Fixed values.
AMOUNT_WORDS = (
    "montant", "amount", "total", "totaux", "prix", "price", "tarif", "ca", "chiffre", "revenue", "revenu", "qty", "quantite",
    "quantity", "nb", "nombre", "count", "somme", "sum", "cout", "cost", "budget", "salaire", "salary", "poids", "weight", "volume", "surface",
    "duree", "duration", "heures", "hours", "points", "score", "solde", "balance", "ht", "ttc", "tva", "vat", "remise", "discount", "marge", "margin",
)

#: Words and whole titles of columns by what they hold. Fixed values.
TITLE_WORDS = {
    "mail": ("email", "mail", "courriel"),
    "phone": ("tel", "telephone", "phone", "mobile", "portable", "gsm", "cell", "cellulaire", "telephones", "phones"),
    "first": ("prenom", "prenoms", "firstname", "first", "given", "givenname", "forename"),
    "last": ("lastname", "last", "surname", "family", "familyname", "patronyme", "nom de famille"),
    "full": ("fullname", "full", "complet", "displayname", "display", "contact", "interlocuteur", "name", "nom", "noms", "names", "nom prenom", "prenom nom"),
    "company": ("societe", "company", "entreprise", "organisation", "organization", "organisme", "employeur", "employer", "firme", "raison", "etablissement", "structure", "compagnie"),
    "city": ("ville", "city", "commune", "localite", "town", "locality", "municipality"),
    "postal": ("postal", "postcode", "zip"),
    "country": ("pays", "country", "nation"),
}


def _plain_title(title: str) -> list[str]:
    bare = "".join(ch for ch in unicodedata.normalize("NFD", title.lower()) if not unicodedata.combining(ch))
    return [w for w in re.split(r"[^a-z0-9]+", bare) if w]


def _titled(title: str, what: str) -> bool:
    words, known = _plain_title(title), TITLE_WORDS[what]
    return " ".join(words) in known or any(w in known for w in words)


def _by_column(df: DataFrame, columns: Sequence[str], found) -> DataFrame:
    """One row for each column from one aggregation: ``found(column)`` gives its named aggregates."""
    one = df.agg(*[F.struct(F.lit(c).alias("column_name"), *found(c)).alias(f"c{i}") for i, c in enumerate(columns)])
    return one.select(F.explode(F.array(*[f"c{i}" for i in range(len(columns))])).alias("r")).select("r.*")


def summed_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, summed): numbers with an amount's title, or with decimals and without codes (a leading zero, nine digits)."""

    def found(c: str):
        ok, s = filled(c), trimmed(c)
        numbers = (F.count_if(ok) > 0) & (F.count_if(ok & number(c).isNull()) == 0)
        titled = F.lit(any(w in AMOUNT_WORDS for w in _plain_title(c)))
        codes = s.rlike("^0[0-9]") | (F.length(F.regexp_replace(s, "[^0-9]", "")) >= 9)
        return [(numbers & (titled | ((F.count_if(ok & s.rlike("[.,][0-9]")) > 0) & (F.count_if(ok & codes) == 0)))).alias("summed")]

    return _by_column(df, columns, found)


def category_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, n_values, down, across): 2 to 50 values suit the side of a pivot, 2 to 12 that aren't numbers its top."""

    def found(c: str):
        n = F.count_distinct(text(c))
        numbers = F.count_if(filled(c) & number(c).isNull()) == 0
        return [n.alias("n_values"), n.between(2, 50).alias("down"), (n.between(2, 12) & ~numbers).alias("across")]

    return _by_column(df, columns, found)


def pivot_choice(df: DataFrame, columns: Sequence[str]) -> dict[str, str | None]:
    """A first pivot: the first columns that suit its side, its top and its values (``rows``, ``columns``, ``value``)."""
    told = {r.column_name: r for r in category_columns(df, columns).collect()}  # a row for each column
    summed = {r.column_name for r in summed_columns(df, columns).where("summed").collect()}
    value = next((c for c in columns if c in summed), None)
    side = next((c for c in columns if told[c].down and c != value), columns[0])
    return {"rows": side, "columns": next((c for c in columns if told[c].across and c not in (side, value)), None), "value": value}


def reading(df: DataFrame, c: str) -> DataFrame:
    """One row (kind, month_first, decimal_mark): what reads most of the column, how its dates are ordered, its decimal mark."""
    s = trimmed(c)
    ok = filled(c)
    dated = s.rlike(r"^(?:[0-9]{4}([-/.])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\2(?:[0-9]{4}|[0-9]{2}))(?:[T ][0-9]{1,2}:[0-9]{2}.*)?$")
    part = lambda k: F.regexp_extract(s, r"^([0-9]{1,2})[-/.]([0-9]{1,2})[-/.](?:[0-9]{4}|[0-9]{2})", k).try_cast("int")
    day_first, month_first = F.count_if(ok & (part(1) > 12)), F.count_if(ok & (part(2) > 12))
    comma, point = s.rlike(r"\..*,|\..*\.|^[^.,]*,(?![0-9]{3}(?:[^0-9]|$))[^.,]*$"), s.rlike(r",.*\.|,.*,|^[^.,]*\.(?![0-9]{3}(?:[^0-9]|$))[^.,]*$")
    both = s.contains(",") & s.contains(".")
    last_comma = F.instr(F.reverse(s), ",") < F.instr(F.reverse(s), ".")
    says_comma = F.when(both, last_comma).otherwise(comma)
    says_point = F.when(both, ~last_comma).otherwise(point)
    phoned = F.lit(_titled(c, "phone"))
    dates, numbers, phones = F.count_if(ok & dated), F.count_if(ok & ~dated & number(c).isNotNull() & ~s.rlike("^0[0-9]")), F.count_if(ok & (phone_key(c) != ""))
    kind = F.when(phoned & (phones >= numbers) & (phones > 0), "phone").when((phones > dates) & (phones > numbers), "phone").when(numbers > dates, "number").when(dates > 0, "date").otherwise("text")
    return df.agg(kind.alias("kind"), ((month_first > 0) & (day_first == 0)).alias("month_first"), F.when(F.count_if(ok & says_point & ~dated) > F.count_if(ok & says_comma & ~dated), ".").otherwise(",").alias("decimal_mark"))


def roles(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, role): ``mail``, ``phone``, ``first``, ``last``, ``full``, ``company``, ``city``, ``postal``, ``country`` or empty.

    A title proposes, the values decide: mails by six of ten cells, phones by four of ten under such a title or eight of ten
    without, names and places by letters in eight of ten, postal codes by digits.
    """

    def found(c: str):
        titled = [r for r in TITLE_WORDS if _titled(c, r)]
        share = lambda test: F.count_if(filled(c) & test) / F.greatest(F.count_if(filled(c)), F.lit(1))
        s = trimmed(c)
        mails, phones = share(mail_key(c) != ""), share(phone_key(c) != "")
        letters, digits = share(s.rlike(r"\p{L}") & ~s.rlike("[0-9]")), share(s.rlike("^[A-Za-z0-9 -]*[0-9]{2}[A-Za-z0-9 -]*$"))
        role = F.when(mails >= 0.6, "mail").when(phones >= (0.4 if "phone" in titled else 0.8), "phone")
        for r in titled:
            if r == "postal":
                role = role.when(digits >= 0.6, r)
            elif r not in ("mail", "phone"):
                role = role.when(letters >= 0.8, r)
        return [role.otherwise("").alias("role")]

    return _by_column(df, columns, found)


def suggested_rules(df: DataFrame, columns: Sequence[str]) -> list[Rule]:
    """Rules for the duplicates of a table of people or companies, the surest first."""
    held: dict[str, list[str]] = {}
    for r in roles(df, columns).collect():  # a row for each column
        held.setdefault(r.role, []).append(r.column_name)
    rules = [any_of(held[r], r) for r in ("mail", "phone") if r in held]
    person = held.get("first", [])[:1] + held.get("last", [])[:1] or held.get("full", [])[:1]
    if person:
        rules.append(names(person))
    place = (held.get("postal") or held.get("city") or [None])[0]
    if held.get("company") and place:
        rules.append(all_of([held["company"][0], place]))
    return sorted(rules, key=lambda r: -r.strength)


def same_titles(left: Sequence[str], right: Sequence[str]) -> list[tuple[str, str]]:
    """Pairs of columns with the same title but for case, accents and signs: a key for look-ups is the first of them."""
    known: dict[str, str] = {}
    for c in right:
        known.setdefault(" ".join(_plain_title(c)), c)
    return [(c, known[k]) for c in left if (k := " ".join(_plain_title(c))) in known and k]


#: What to hide in a column, by its title (folded words): mode, titles that tell it, titles that don't. Fixed values, in their order.
HIDING = (
    ("phone", r"tel|telephone|phone|mobile|portable|fax|gsm|cell|cellulaire", None),
    ("postal", r"code postal|codepostal|cp|zip|zipcode|postcode|postal", None),
    ("address", r"adresse|address|rue|street|voie|adr", r"mail|email|e mail|ip|web|site|url"),
    ("company", r"societe|company|entreprise|organisation|organization|raison sociale|employeur|employer|firme|compte|account|client", r"id|numero|number|no|code|type"),
    ("first", r"prenom|prenoms|firstname|first name|givenname|given", None),
    ("full", r"nom complet|fullname|full name|contact|interlocuteur|dirigeant|responsable|signataire|commercial|manager", None),
    ("last", r"nom|noms|lastname|last name|surname|family name|name|patronyme", r"fichier|file|societe|company|produit|product|projet|project|domaine|domain|user|utilisateur|login|campagne|rue|etablissement"),
    ("text", r"iban|bic|rib|siret|siren|nir|secu|securite sociale|passeport|passport|cni|permis|licence|vat|tva|numero de compte", None),
    ("date", r"naissance|birth|birthday|dob|ne le|nee le", None),
    ("text", r"login|user|username|identifiant|pseudo|nickname", None),
)
#: The share of a column's filled cells that a mode must read.
HIDING_SHARE = {"phone": 0.4, "date": 0.6}


def hiding_modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, mode): how each column is best hidden, ``keep`` where nothing tells. Mails are told by six of ten cells, from all rows."""

    def found(c: str):
        title, s, ok = " ".join(_plain_title(c)), trimmed(c), filled(c)
        says = lambda words: bool(words and re.search(rf"\b(?:{words})\b", title))
        share = lambda test: F.count_if(ok & test) / F.greatest(F.count_if(ok), F.lit(1))
        reads = {"phone": phone_key(c) != "", "date": date_key(c).isNotNull()}
        mode = F.when(share(s.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$")) >= 0.6, "email")
        for name, words, unless in HIDING:
            if says(words) and not says(unless):
                mode = mode.when(share(reads[name]) >= HIDING_SHARE[name] if name in reads else F.lit(True), name)
        return [mode.otherwise("keep").alias("mode")]

    return _by_column(df, columns, found)
