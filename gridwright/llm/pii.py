"""Personal data replaced by keyed surrogates, with DataFrame functions only."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

# Honorifics by gender, given names by script and gender, syllables of made-up names.
MALE = ("Mr", "MR", "Mister", "Sir", "Lord", "Herr", "Monsieur", "Señor", "Sr", "Signor", "господин", "г-н", "κύριος")
FEMALE = ("Mrs", "MRS", "Ms", "MS", "Miss", "Lady", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Señorita", "Signora", "госпожа", "г-жа", "κυρία")
EITHER = ("Dr", "DR", "Prof", "Professor")
GIVEN = {
    ("latin", "male"): ("Adrian", "Bruno", "Conrad", "Damian", "Edgar", "Felix", "Gregor", "Hugo", "Ivan", "Julian", "Konrad", "Lucas", "Marcel", "Nestor", "Oscar", "Patrick"),
    ("latin", "female"): ("Agatha", "Beatrice", "Clara", "Diana", "Elena", "Flora", "Greta", "Helena", "Irene", "Julia", "Katharina", "Livia", "Marta", "Nora", "Olivia", "Paula"),
    ("latin", "either"): ("Alexis", "Robin", "Dominique", "Kim", "Noel", "Sascha", "Andrea", "Jordan"),
    ("cyrillic", "male"): ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Павел", "Роман"),
    ("cyrillic", "female"): ("Алла", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Зоя", "Ирина"),
    ("cyrillic", "either"): ("Саша", "Женя", "Валя", "Слава"),
    ("greek", "male"): ("Ανδρέας", "Γιώργος", "Νίκος", "Πέτρος"),
    ("greek", "female"): ("Άννα", "Ελένη", "Ζωή", "Σοφία"),
    ("greek", "either"): ("Αλέξης", "Χριστίνα"),
}
SYLLABLES = {
    "latin": ("ba", "be", "bo", "da", "de", "do", "fa", "fe", "ka", "ke", "ko", "la", "le", "lo", "ma", "me", "mo", "na", "ne", "no", "ra", "re", "ro", "sa", "se", "so", "ta", "te", "to", "va", "ve", "vo"),
    "cyrillic": ("ба", "бе", "да", "де", "ка", "ко", "ла", "ле", "ма", "мо", "на", "но", "ра", "ро", "са", "та"),
    "greek": ("βα", "δα", "δο", "κα", "κο", "λα", "λο", "μα", "μο", "να", "νο", "ρα", "ρο", "σα", "τα", "το"),
}
#: Letters that stand for letters of the same script and case.
ALPHABETS = (
    ("[a-z]", "abcdefghijklmnopqrstuvwxyz"), ("[A-Z]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("[ß-ÿ]", "àâäçèéêëîïñôöùûü"), ("[À-Þ]", "ÀÂÄÇÈÉÊËÎÏÑÔÖÙÛÜ"),
    ("[а-яё]", "абвгдежзиклмнопрстуфхцчшэюя"), ("[А-ЯЁ]", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ"), ("[α-ω]", "αβγδεζηθικλμνξοπρστυφχψω"), ("[Α-Ω]", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"),
)

#: Words between names that stay. Fixed values.
PARTICLES = ("van", "von", "der", "den", "de", "del", "della", "du", "da", "di", "la", "le", "bin", "al")

_NAME = r"\p{Lu}\p{L}*+(?:['’-]\p{Lu}\p{L}*+){0,4}"
_ITEM = rf"(?:(?:{'|'.join(PARTICLES)}) ){{0,3}}(?:\p{{Lu}}\.(?= \p{{Lu}})|{_NAME})"
_HONORIFIC = "(?:" + "|".join(sorted((*MALE, *FEMALE, *EITHER), key=len, reverse=True)) + r")\.?[ \u00a0]"
#: Patterns of what is found. They have no loops over groups without a small bound, for which Java needs stack.
_EMAIL = r"(?<![._+-])[\p{L}\p{N}._+-]++@(?=[\p{L}\p{N}])[\p{L}\p{N}.-]*\.\p{L}{2,}"
_SECRET = r"[0-9a-fA-F]{32,}+(?![\p{L}\p{N}])"
_IP = r"(?<![.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
#: IPv6 addresses by their allocated starts, so that times and slices of code are none.
_IP6 = r"(?<![:.])(?=(?i:[23][0-9a-f]{3}|f[cdef][0-9a-f]{2}|(?:00)?64):)(?i:(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}|(?:[0-9a-f]{1,4}:){1,6}(?::[0-9a-f]{1,4}){1,6}|(?:[0-9a-f]{1,4}:){1,7}:)(?![\p{L}\p{N}:]|\.[0-9])"
_SSN = r"(?<!-)(?<![0-9][ .,])[0-9]{3}(?:-[0-9]{2}-| [0-9]{2} )[0-9]{4}(?![\p{N}-]|[ .,][0-9])"
_CARD = r"(?:[0-9]{4}[ -]?){3}[0-9]{4}(?:[ -]?[0-9]{1,3})?(?!\p{N})"
_IBAN = r"[A-Z]{2}[0-9]{2}(?:(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?|(?: ?[A-Z0-9]{4}){2} ?[A-Z0-9]{3})(?![\p{L}\p{N}])"
_PHONE = (
    r"(?<!\+)(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-][0-9]{3,4}(?!\p{N})"
    r"|(?<!\+)\+(?=[0-9](?:[ .-]?[0-9]){6,14}(?!\p{N}))[0-9]{1,3}(?:[ .-]?[0-9]{1,4}){2,7}(?!\p{N})"
    r"|(?<![.+-])(?:1[ .-])?[0-9]{3}(?:-[0-9]{3}-|\.[0-9]{3}\.| [0-9]{3} )[0-9]{4}(?![\p{N}-])"
    r"|(?<![.,+-])0[1-9](?:(?: [0-9]{2}){4}|(?:\.[0-9]{2}){4}|(?:-[0-9]{2}){4}|[0-9]{8})(?![\p{N}-]|[.,][0-9])"
    r"|(?<![.,+-])0[1-9][0-9]{1,3} [0-9]{3,4} [0-9]{3,4}(?![\p{N}-]|[.,][0-9])"
    r"|(?<![.,+-])00[1-9][0-9]{0,2}(?:[ .-][0-9]{2,4}){1,5}[ .-][0-9]{2,7}(?![\p{N}-]|[.,][0-9])"
)
_PERSON = rf"(?<!-){_HONORIFIC}{_ITEM}(?: {_ITEM}){{0,3}}"
_ACCESS_KEY = r"(?:AKIA|ASIA)[A-Z0-9]{16}(?![\p{L}\p{N}])"
_ASSIGNMENT = r"(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\s{0,2}[=:]\s{0,2}[\"']?"
_ASSIGNED = _ASSIGNMENT + r"(?=[\p{L}_~+/!.@-]*+[0-9])[\p{L}\p{N}_~+/!.@-]{5,}[\p{L}\p{N}]"
_START = r"(?<![\p{L}\p{N}])"
#: Everything that is replaced, in the order of preference at one place; an address may follow a letter.
PATTERN = rf"{_START}(?:" + "|".join((_EMAIL, _ASSIGNED, _SECRET, _ACCESS_KEY, _IBAN, _PHONE, _SSN, _CARD, _IP, _IP6, _PERSON)) + rf")|(?<=\p{{L}}){_IP}"
#: A word that may be a name found elsewhere in its text.
_MENTION = rf"{_START}(?<!['’-])(?=\p{{Lu}}\p{{L}}){_NAME}"

#: What a match has at least, pattern by pattern: numbers three digits running, addresses their middle, phones also a plus
#: sign with a digit, bank accounts their start, IPv6 addresses a group and more; the others are told by signs and words below.
_HINT = r"[0-9]{3}|[0-9]\.[0-9]{1,3}\.[0-9]|\+[0-9]|[A-Z]{2}[0-9]{2}|0[1-9][ -][0-9]{2}[ -][0-9]{2}|[0-9a-fA-F]{2}:[0-9a-fA-F:]"
_LONG_HEX = "[0-9a-fA-F]{32}"

#: Rounds of drawing again. Surrogates grow with the rounds, so no format runs out of them.
ROUNDS = 200


def _honorific(text: Column) -> Column:
    hint = F.lit(False)
    for word in (*MALE, *FEMALE, *EITHER):
        hint = hint | text.contains(word)
    return hint


def may_be_private(text: Column) -> Column:
    """A cheap test that all texts pass in which anything is found; it keeps the whole pattern from most others."""
    assigned = (text.contains("=") | text.contains(":")) & text.rlike(_ASSIGNED)
    hint = text.contains("@") | text.rlike(_HINT) | text.contains("AKIA") | text.contains("ASIA") | _honorific(text) | text.rlike(_LONG_HEX) | assigned
    return F.coalesce(hint, F.lit(False))


_ENTRY = "array<struct<gap: string, kind: string, value: string>>"


def _entry(gap: Column, kind: Column, value: Column) -> Column:
    return F.struct(gap.alias("gap"), kind.cast("string").alias("kind"), value.alias("value"))


def _entries(gap: Column, m: Column) -> Column:
    """A match as entries (gap before it, kind, value): each name of a person is one, of an assignment the value alone."""
    head = F.regexp_extract(m, f"^{_HONORIFIC}", 0)
    named = lambda words: F.regexp_extract(head, r"^(?:" + "|".join(words) + r")\.?[ \u00a0]$", 0) != ""
    gender = F.when(named(MALE), "male").when(named(FEMALE), "female").otherwise("either")
    words = F.split(m.substr(F.length(head) + 1, F.length(m)), " ")
    person = F.transform(words, lambda w, k: _entry(F.when(k == 0, F.concat(gap, head)).otherwise(" "), F.when(w.isin(*PARTICLES), "same").when(w.rlike(r"^\p{Lu}\.$"), "initial").when(k == F.size(words) - 1, "surname").otherwise(F.concat(F.lit("given_"), gender)), w))
    name = F.regexp_extract(m, _ASSIGNMENT, 0)
    given = m.substr(F.length(name) + 1, F.length(m))
    assigned = F.array(_entry(F.concat(gap, name), F.when(given.rlike(f"^{_EMAIL}$"), "email").otherwise("assigned"), given))
    one = lambda kind: F.array(_entry(gap, F.lit(kind), m))
    out = (
        F.when(m.rlike(rf"^{_PERSON}$"), person).when(m.rlike(rf"^{_ASSIGNED}$"), assigned).when(m.contains("@"), one("email")).when(m.rlike(r"^[0-9a-fA-F]{32,}$"), one("secret"))
        .when(m.rlike(r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$"), one("ip")).when(m.rlike(r"^[0-9]{3}[ -][0-9]{2}[ -][0-9]{4}$"), one("ssn")).when(m.rlike(r"^[0-9a-fA-F]{2,4}:"), one("ip6")).when(m.rlike(r"^(?:AKIA|ASIA)[A-Z0-9]{16}$"), one("access_key"))
        .when(m.rlike(r"^[A-Z]{2}[0-9]{2}"), one("iban")).when(m.rlike(r"^[(+]|^(?:1[ .-])?[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}$|^0(?:[ .-]?[0-9]){8,14}$"), one("phone")).when(m.rlike(rf"^{_NAME}$"), one("mention")).otherwise(one("card"))
    )
    return out.cast(_ENTRY)


def with_entries(df: DataFrame) -> DataFrame:
    """``df`` (.., text) with ``entries``, what is found in the text with the gap before each (null: nothing), and ``tail``, the text after the last.

    In a text with a person, all other words in capitals are entries of kind ``mention``: they may be its names again.
    """
    text = F.col("text")
    person = _honorific(text) & text.rlike(_START + _PERSON)
    pattern = F.when(person, F.lit(f"{PATTERN}|{_MENTION}")).otherwise(F.lit(PATTERN))
    df = df.withColumn("found", F.when(may_be_private(text), F.regexp_extract_all(text, pattern, F.lit(0))))
    df = df.withColumn("gaps", F.when(F.size("found") > 0, F.split(text, pattern, -1)))
    entries = F.flatten(F.zip_with(F.slice("gaps", 1, F.size("found")), "found", _entries))
    return df.withColumns({"entries": F.when(F.col("gaps").isNotNull(), entries), "tail": F.element_at("gaps", -1)}).drop("found", "gaps")


def _byte(stream: Column, k: Column) -> Column:
    """Four of the 256 hex digits of a keyed stream as a number; 253 places start at different ones."""
    return F.conv(stream.substr((4 * k) % 253 + 1, F.lit(4)), 16, 10).cast("int")


def _spelled(value: Column, stream: Column, keep: Column) -> Column:
    """``value`` with digits and letters drawn anew within their class from place ``keep`` on; signs and hex case stay."""

    def drawn(c: Column, k: Column) -> Column:
        b = _byte(stream, k)
        out = F.when(k < keep, c).when(c.rlike("[0-9]"), (b % 10).cast("string"))
        for group, letters in ALPHABETS:
            out = out.when(c.rlike(group), F.lit(letters).substr(b % len(letters) + 1, F.lit(1)))
        return out.otherwise(c)

    return F.array_join(F.transform(F.split(value, ""), drawn), "")


def _pick(items: tuple[str, ...], b: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, items)), b % len(items) + 1)


def _check_sum(number: Column) -> Column:
    """The sum that is 0 for numbers with the check digit of payment cards, modulo 10."""
    digits = F.split(F.reverse(F.regexp_replace(number, "[^0-9]", "")), "")
    value = lambda c, k: F.try_element_at(F.array(*map(F.lit, (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), c.cast("int") + 10 * (k % 2) + 1)
    return F.aggregate(F.transform(digits, value), F.lit(0), lambda a, x: a + x) % 10


def with_surrogates(df: DataFrame, key: str) -> DataFrame:
    """``df`` (kind, form, value, attempt) with the draw of that number as surrogate: same kind, length and signs (IP addresses:
    same form); names, in small letters, keep gender and script, card numbers whether they pass their check, phones their
    country. From the sixth draw on, mail names get longer, from the twenty-fourth all other numbers and keys, and
    IPv6 addresses have all eight groups."""
    kind, form, value, attempt, stream = F.col("kind"), F.col("form"), F.col("value"), F.col("attempt"), F.col("stream")
    seed = F.concat_ws("\x1f", F.lit(key), kind, value, attempt.cast("string"))
    byte = lambda k: _byte(stream, F.lit(k))
    script = F.when(value.rlike("[а-яё]"), "cyrillic").when(value.rlike("[α-ωά-ώ]"), "greek").otherwise("latin")
    start = F.when(kind == "phone", F.length(F.regexp_extract(value, r"^(?:\+|00)[0-9]{1,3}(?=[ .(-])|^0", 0))).when(kind == "iban", F.lit(2)).when(kind == "access_key", F.lit(4)).otherwise(F.lit(0))
    end = F.when(kind == "email", F.substring_index(value, ".", -1)).otherwise(F.lit(""))
    drawn = df.withColumns({"stream": F.concat(F.sha2(seed, 512), F.sha2(F.concat(seed, F.lit("\x1f")), 512)), "end": end})
    drawn = drawn.withColumn("body", F.concat(_spelled(value.substr(F.lit(1), F.length(value) - F.length("end")), stream, start), F.col("end")))

    headless = F.concat(F.col("body").substr(F.lit(1), F.length("body") - 1), F.lit("0"))
    card = F.when(_check_sum(value) == 0, F.concat(F.col("body").substr(F.lit(1), F.length("body") - 1), ((10 - _check_sum(headless)) % 10).cast("string"))).otherwise(F.col("body"))
    ip = F.concat_ws(".", *[(byte(k) % 254 + 1).cast("string") for k in range(4)])
    hexed = F.array_join(F.transform(F.split(value, ""), lambda c, k: F.when(c == ":", c).when(c.rlike("[A-F]"), F.lit("ABCDEF").substr(_byte(stream, k) % 6 + 1, F.lit(1))).otherwise(F.lit("0123456789abcdef").substr(_byte(stream, k) % 16 + 1, F.lit(1)))), "")

    def family(s: str) -> Column:
        size = 3 + F.least(F.lit(20), F.floor(attempt / 4).cast("int"))
        return F.array_join(F.transform(F.sequence(F.lit(0), size), lambda k: _pick(SYLLABLES[s], _byte(stream, k))), "")

    def given(s: str) -> Column:
        ends = {"male": {"latin": "n", "cyrillic": "н", "greek": "ς"}, "female": {"latin": "a", "cyrillic": "а", "greek": "α"}, "either": {}}
        of = lambda g: F.when(attempt < 3, _pick(tuple(x.lower() for x in GIVEN[s, g]), byte(5))).otherwise(F.concat(family(s), F.lit(ends[g].get(s, ""))))
        return F.when(form == "given_male", of("male")).when(form == "given_female", of("female")).otherwise(of("either"))

    by_script = lambda f: F.when(script == "cyrillic", f("cyrillic")).when(script == "greek", f("greek")).otherwise(f("latin"))
    in_hex = (kind == "secret") | ((kind == "assigned") & value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"))
    fresh = F.sha2(F.concat(seed, F.lit("\x1e")), 256)
    longer = lambda after, each: fresh.substr(F.lit(1), F.greatest(F.lit(0), F.least(F.lit(40), F.floor((attempt - after) / each).cast("int"))))
    groups = F.concat_ws(":", F.concat(value.substr(1, 2), fresh.substr(1, 2)), *[fresh.substr(4 * k, 4) for k in range(1, 8)])
    ip6 = F.when(attempt < 24, F.concat(value.substr(1, 2), hexed.substr(F.lit(3), F.length(value)))).otherwise(groups)
    mail = F.concat(F.translate(longer(4, 2), "0123456789", "ghijklmnop"), F.col("body"))
    other = F.when(kind == "ip", ip).when(kind == "ip6", ip6).when(in_hex, hexed).when(kind == "card", card).otherwise(F.col("body"))
    out = F.when(kind == "name", F.when(form == "surname", by_script(family)).otherwise(by_script(given))).when(kind == "email", mail).otherwise(F.concat(other, F.when(kind == "ip6", "").otherwise(F.translate(longer(22, 2), "abcdef", "012345"))))
    return drawn.withColumn("surrogate", out).drop("stream", "end", "body")


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, value, surrogate) for distinct ``entities`` (kind, form, value): one to one within a kind, never a value that the data has.

    Who loses a collision draws again, in rounds until none is left. The smallest value of a surrogate keeps it, so the
    result depends on the set of entities and the key alone.
    """
    entities = materialize(entities.select("kind", "form", "value"))
    real = entities.select("kind", F.col("value").alias("surrogate"), F.lit(True).alias("real"))
    drawn, settled = materialize(with_surrogates(entities.withColumn("attempt", F.lit(0)), key)), None
    for _ in range(ROUNDS):
        every = drawn.withColumn("new", F.lit(True))
        every = every if settled is None else settled.withColumn("new", F.lit(False)).unionByName(every)
        own = materialize(every.groupBy("kind", "surrogate").agg(F.min(F.struct("new", "value")).getField("value").alias("owner")))
        lost = (F.col("owner") != F.col("value")) | F.col("real").isNotNull()
        checked = materialize(drawn.join(own, ["kind", "surrogate"]).join(real, ["kind", "surrogate"], "left").select("kind", "form", "value", "attempt", "surrogate", lost.alias("lost")))
        kept = checked.where("not lost").drop("lost")
        settled = kept if settled is None else settled.unionByName(kept)
        again = checked.where("lost").select("kind", "form", "value", (F.col("attempt") + 1).alias("attempt"))
        if again.isEmpty():
            return settled.select("kind", "value", "surrogate")
        drawn = materialize(with_surrogates(again, key))
    raise RuntimeError("no distinct surrogates after all rounds")


def _rotated(key: str) -> tuple[str, str]:
    """Capitals of each script and what stands for them as initials: the alphabet turned by a keyed step, so one to one."""
    plain = [letters for _, letters in ALPHABETS if letters.isupper()]
    step = int(hashlib.sha256(f"initials {key}".encode()).hexdigest()[:8], 16)
    turned = [x[k:] + x[:k] for x in plain for k in [1 + step % (len(x) - 1)]]
    return "".join(plain), "".join(turned)


def _in_case_of(value: Column, surrogate: Column, kind: Column) -> Column:
    """A surrogate in small letters as its value is written: names whole, mail addresses letter by letter."""
    first = F.upper(surrogate.substr(F.lit(1), F.lit(1)))
    name = F.when((F.length(value) > 1) & (F.upper(value) == value), F.upper(surrogate)).otherwise(F.concat(first, surrogate.substr(F.lit(2), F.length(surrogate))))
    letters = F.zip_with(F.split(value, ""), F.split(surrogate, ""), lambda a, b: F.when(a != F.lower(a), F.upper(b)).otherwise(F.coalesce(b, F.lit(""))))
    mail = F.when(F.lower(value) == value, surrogate).otherwise(F.array_join(letters, ""))
    address = F.when(F.upper(value) == value, F.upper(surrogate)).otherwise(surrogate)
    return F.when(kind == "name", name).when(kind == "email", mail).when(kind == "ip6", address).otherwise(surrogate)


def replace_private(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with private data in ``text`` replaced, and n_private, the number of entities found (long).

    E-mail addresses, phone numbers, IP addresses of both versions, card, social-security and bank account numbers, access keys, long hex
    secrets, values assigned to a password, token or key, and the names after an honorific are found, and such names again
    wherever they stand in their text as words in capitals or with a capital. Equal values get equal surrogates in all
    documents, different values of a kind different ones; names and mail addresses are equal whatever their case, which
    the surrogate keeps, and a name is one person's whatever the honorifics (male or female where all agree). Initials are
    turned by a keyed step. ``key`` decides the draw: keep it secret. Names without an honorific in their text are not found. A
    value that is assigned and is an e-mail address is treated as one. Phones are found in international form, with a plus or 00, as
    North American ones, and as national ones that begin with a 0, in pairs, in one or in groups of three and four.

    Null texts stay null; texts without entities stay as they are and are not shuffled. Rows that repeat a text are treated
    alike. Texts of any length are read whole, in time linear in them. Columns and their order stay, whatever their names;
    a column of ``docs`` that is called n_private is replaced. An empty table gives no rows. Texts are searched once and
    kept as found; only entities are shuffled for their surrogates, then the texts that have some.
    """
    columns = [c for c in docs.columns if c != "n_private"]
    others = [c for c in columns if c != "text"]
    plain = [f"c{i}" for i in range(len(others))]
    rows = docs.select(*[F.col(f"`{c}`").alias(p) for c, p in zip(others, plain, strict=True)], "text")
    cut = with_entries(rows)
    private = F.col("entries").isNotNull()
    cut = materialize(cut.select(*plain, F.when(~private, F.col("text")).alias("text"), F.when(private, F.sha2("text", 256)).alias("of"), "entries", "tail"))
    searched = cut.where("of is not null")

    found = materialize(searched.select("of", F.posexplode("entries").alias("pos", "e")).select("of", "pos", "e.kind", "e.value").distinct())
    name = F.col("kind").startswith("given_") | (F.col("kind") == "surname")
    known = found.where(name).select("of", F.lower("value").alias("folded"), F.lit(True).alias("known")).distinct()
    again = found.where("kind = 'mention'").withColumn("folded", F.lower("value")).join(known, ["of", "folded"], "left")
    again = again.select("of", "pos", F.when(F.col("known"), "name").otherwise("same").alias("kind"), F.lit(None).cast("string").alias("form"), "value", "folded")
    folded = F.when(name | F.col("kind").isin("email", "ip6"), F.lower("value")).otherwise(F.col("value"))
    told = found.where("kind <> 'mention'").select("of", "pos", F.when(name, "name").otherwise(F.col("kind")).alias("kind"), F.when(name, F.col("kind")).alias("form"), "value", folded.alias("folded"))
    told = materialize(told.unionByName(again))

    has = lambda form: F.max(F.coalesce(F.col("form") == form, F.lit(False)))
    forms = told.where(~F.col("kind").isin("same", "initial")).groupBy("kind", F.col("folded").alias("value")).agg(has("given_male").alias("m"), has("given_female").alias("f"), has("given_either").alias("e"))
    form = F.when(F.col("m") & ~F.col("f"), "given_male").when(F.col("f") & ~F.col("m"), "given_female").when(F.col("m") | F.col("e"), "given_either").otherwise("surname")
    drawn = materialize(surrogates(forms.select("kind", F.when(F.col("kind") == "name", form).alias("form"), "value"), key))

    placed = told.join(drawn.select("kind", F.col("value").alias("folded"), "surrogate"), ["kind", "folded"], "left")
    letters, turned = _rotated(key)
    new = F.when(F.col("kind") == "same", F.col("value")).when(F.col("kind") == "initial", F.translate("value", letters, turned)).otherwise(_in_case_of(F.col("value"), F.col("surrogate"), F.col("kind")))
    fills = placed.groupBy("of").agg(F.array_sort(F.collect_list(F.struct("pos", new.alias("new")))).alias("news"), F.count_if(F.col("kind") != "same").alias("n_private"))
    touched = searched.join(materialize(fills), "of")
    text = F.concat(F.array_join(F.zip_with("entries", "news", lambda e, s: F.concat(e["gap"], s["new"])), ""), F.col("tail"))
    touched = touched.select(*plain, text.alias("text"), "n_private")
    out = cut.where("of is null").select(*plain, "text", F.lit(0).cast("long").alias("n_private")).unionByName(touched)
    named = dict(zip(others, plain, strict=True)) | {"text": "text"}
    return out.select(*[F.col(named[c]).alias(c) for c in columns], "n_private")
