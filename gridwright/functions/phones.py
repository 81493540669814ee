"""Phone numbers of any country by their calling codes. Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import MATCHING, _once, slug, text

#: Calling codes: one digit, the pairs that are one, else three digits; none is the beginning of another. Fixed values of the numbering plan.
CODE = r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{2})"
#: Where the 0 before a national number belongs to it, and where national numbers have no digit before them. Fixed values.
KEEPS_ZERO = ("39", "378", "379")
NO_TRUNK = ("1", "30", "34", "45", "47", "48", "65", "351", "352", "377", "420", "852")
#: Names of countries in English and French, and their ISO codes. Fixed values.
COUNTRIES = {
    "33": "fr|fra|france|france metropolitaine", "32": "be|bel|belgium|belgique|belgie", "41": "ch|che|switzerland|suisse|schweiz", "352": "lu|lux|luxembourg", "377": "mc|monaco",
    "1": "us|usa|united states|united states of america|etats unis|ca|can|canada|quebec", "44": "gb|gbr|uk|united kingdom|great britain|royaume uni|england|angleterre", "49": "de|deu|germany|allemagne|deutschland",
    "34": "es|esp|spain|espagne|espana", "39": "it|ita|italy|italie|italia", "351": "pt|prt|portugal", "31": "nl|nld|netherlands|pays bas|nederland", "353": "ie|irl|ireland|irlande", "43": "at|aut|austria|autriche",
    "46": "se|swe|sweden|suede", "47": "no|nor|norway|norvege", "45": "dk|dnk|denmark|danemark", "358": "fi|fin|finland|finlande", "48": "pl|pol|poland|pologne", "30": "gr|grc|greece|grece", "420": "cz|cze|czechia|tchequie",
    "212": "ma|mar|morocco|maroc", "213": "dz|dza|algeria|algerie", "216": "tn|tun|tunisia|tunisie", "61": "au|aus|australia|australie", "81": "jp|jpn|japan|japon", "86": "cn|chn|china|chine", "91": "in|ind|india|inde", "55": "br|bra|brazil|bresil",
}


def calling_code(country) -> Column:
    """The calling code of a country by its name or ISO code, whatever its case and accents; null for others."""
    known = F.create_map(*[F.lit(x) for code, names in COUNTRIES.items() for name in names.split("|") for x in (name, code)])
    return F.try_element_at(known, slug(country))


def _code(code) -> Column:
    return F.regexp_replace(code if isinstance(code, Column) else F.lit(str(code)), "[^0-9]", "")


def e164(c, code="33") -> Column:
    """A number as +33612345678, national ones read in the country of ``code`` (a calling code or a column of them); empty for what is no
    phone number, or a placeholder whose digits after the first are all one.

    A 0 after the calling code goes, as in +44 (0)20, but not Italy's. In France a mobile whose 0 was lost is known, and 33 without its plus.
    """
    given = F.regexp_replace(F.replace(text(c), F.lit("(0)"), F.lit("")), r"[\s\p{Z}\p{Cf}.()/\-]", "")
    return _once(F.struct(given.alias("bare"), F.coalesce(_code(code), F.lit("")).alias("code")), lambda x: _once(_digits(x["bare"], x["code"]), _sound))


def _abroad(rest: Column) -> Column:
    """Digits behind a plus sign or what is dialled for it: the calling code, and the number without the 0 that is dialled at home."""
    code = F.regexp_extract(rest, CODE, 0)
    behind = rest.substr(F.length(code) + 1, F.lit(60))
    own = F.when(code.isin(*KEEPS_ZERO), behind).otherwise(F.regexp_replace(behind, "^0(?=.)", ""))
    return F.when(rest.rlike("^[0-9]+$") & (code != "") & (own != ""), F.concat(code, own))


def _digits(bare: Column, code: Column) -> Column:
    """All digits from the calling code on; null where there is no number."""
    long = bare.startswith(code) & (F.length(bare) >= F.length(code) + 8)
    french = F.when(bare.rlike("^0[0-9]{6,14}$"), F.substring(bare, 2, 60)).when(bare.rlike("^[1-9][0-9]{8}$"), bare).when(bare.rlike("^330?[1-9][0-9]{8}$"), F.right(bare, F.lit(9)))
    at_home = (
        F.when(code == "33", F.concat(F.lit("33"), french))
        .when(code == "1", F.when(F.length(bare) == 10, F.concat(F.lit("1"), bare)).when(bare.rlike("^1[0-9]{10}$"), bare))
        .when(code.isin(*KEEPS_ZERO), F.when(long & (bare.substr(F.length(code) + 1, F.lit(1)) != "0"), bare).otherwise(F.concat(code, bare)))
        .when((code == "7") & bare.rlike("^8[0-9]{10}$"), F.concat(code, F.substring(bare, 2, 60))).when((code == "36") & bare.rlike("^06[0-9]{8,9}$"), F.concat(code, F.substring(bare, 3, 60)))
        .when(bare.startswith("0"), F.when(~bare.startswith("00"), F.concat(code, F.substring(bare, 2, 60)))).when(long, bare).otherwise(F.concat(code, bare))
    )
    rest = F.when((code == "1") & bare.startswith("011"), F.substring(bare, 4, 60)).when(bare.startswith("+"), F.substring(bare, 2, 60)).when(bare.startswith("00"), F.substring(bare, 3, 60))
    return F.when(rest.isNotNull(), _once(rest, _abroad)).when((code != "") & bare.rlike("^[0-9]+$"), at_home)


def _sound(digits: Column) -> Column:
    own = digits.substr(F.length(F.regexp_extract(digits, CODE, 0)) + 1, F.lit(60))
    sound = F.length(digits).between(8, 15) & ~digits.startswith("0") & ~(digits.rlike("^(?:33|1)") & (F.length(digits) != 11)) & ~own.rlike(r"^.(.)\1+$")
    return F.when(sound, F.concat(F.lit("+"), digits)).otherwise(F.lit(""))


def written(c, to: str = "e164", code="33") -> Column:
    """A phone number as ``e164``, ``intl`` (+33 6 12 34 56 78) or ``nat`` (06 12 34 56 78); what isn't one stays.

    French numbers are written in pairs, those of other countries, which have no one way, without gaps. Numbers of another
    country than ``code`` are never national ones.
    """
    if to not in ("e164", "intl", "nat"):
        raise ValueError(f"unknown form: {to}")
    pairs = lambda x: F.regexp_replace(x, "(?<=^(?:..){1,9})(?=.)", " ")

    def shown(x: Column) -> Column:
        e, own, french = x["e"], x["own"], x["e"].startswith("+33")
        if to == "intl":
            out = F.when(french, F.concat(F.lit("+33 "), F.substring(e, 4, 1), F.lit(" "), pairs(F.substring(e, 5, 20)))).otherwise(e)
        elif to == "nat":
            rest = e.substr(F.length(own) + 2, F.lit(20))
            trunk = F.when(own.isin(*NO_TRUNK, *KEEPS_ZERO), "").when(own == "7", "8").when(own == "36", "06").otherwise("0")
            mine = (own != "") & (F.regexp_extract(F.substring(e, 2, 20), CODE, 0) == own)
            out = F.when(mine & french, pairs(F.concat(F.lit("0"), rest))).when(mine, F.concat(trunk, rest)).otherwise(e)
        else:
            out = e
        return F.when(e != "", out).otherwise(x["given"])

    return _once(F.struct(e164(c, code).alias("e"), F.coalesce(_code(code), F.lit("")).alias("own"), text(c).alias("given")), shown)


MATCHING["e164"] = e164
