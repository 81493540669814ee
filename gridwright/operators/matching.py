"""Duplicate groups by rules of different strength: any of several columns, names in any order, words that sound alike."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import phones  # noqa: F401
from ..functions.sounds import code_of, transcription
from ..functions.text import match_key, slug, text
from ..plans.durable import keep, shuffled
from .duplicates import components

#: How sure a match of one field is, by its reading. Fixed values.
STRENGTH = {"mail": 0.95, "phone": 0.85}
OTHER_STRENGTH, SOUND_STRENGTH, NAME_STRENGTH, NAME_SOUND, NAME_INITIAL = 0.5, 0.35, 0.6, 0.6, 0.75
#: Titles before a name, dropped from it. Fixed values.
CIVILITIES = ("m", "mr", "mme", "mlle", "mrs", "ms", "miss", "dr", "me", "monsieur", "madame", "mademoiselle")


@dataclass(frozen=True)
class Rule:
    """``links`` gives (id, root) of the rows of a table that match, the root being the first of them."""

    label: str
    strength: float
    links: Callable[[DataFrame, str], DataFrame]


def _first_of(keys: DataFrame) -> DataFrame:
    """Links of rows (id, key) to the first row of their key."""
    first = keep(keys.groupBy("key").agg(F.min("id").alias("root"), F.max("id").alias("last")).where("root < last").drop("last"))
    return keys.join(shuffled(first), "key").where("id > root").select("id", "root")


def _hashed(*parts: Column) -> Column:
    return F.sha2(F.to_json(F.struct(*[p.alias(f"k{i}") for i, p in enumerate(parts)])), 256)


def all_of(fields: Sequence[str], how: str = "slug") -> Rule:
    """All fields in common, each filled after its reading."""

    def links(df: DataFrame, rid: str) -> DataFrame:
        keys = [match_key(c, how) for c in fields]
        full = F.forall(F.array(*keys), lambda k: k != "")
        return _first_of(df.where(full).select(F.col(rid).alias("id"), _hashed(*keys).alias("key")))

    return Rule(" + ".join(fields), 1 - (1 - STRENGTH.get(how, OTHER_STRENGTH)) ** len(fields), links)


def any_of(fields: Sequence[str], how: str = "slug") -> Rule:
    """A value of any of the fields is a value of any of them elsewhere."""

    def links(df: DataFrame, rid: str) -> DataFrame:
        keys = F.array_distinct(F.filter(F.array(*[match_key(c, how) for c in fields]), lambda k: k != ""))
        return _first_of(df.select(F.col(rid).alias("id"), F.explode(keys).alias("key")))

    return Rule(" or ".join(fields), STRENGTH.get(how, OTHER_STRENGTH), links)


def name_words(fields: Sequence[str]) -> Column:
    """The words of a name, sorted and each once, without titles and numbers; null for fewer than two, or initials alone."""
    words = F.split(slug(F.concat_ws(" ", *[text(c) for c in fields])), " ")
    kept = F.array_sort(F.array_distinct(F.filter(words, lambda w: (w != "") & ~w.isin(*CIVILITIES) & ~w.rlike("^[0-9]+$"))))
    return F.when((F.size(kept) >= 2) & F.exists(kept, lambda w: F.length(w) > 1), kept)


def names(fields: Sequence[str]) -> Rule:
    """The same words in any order."""

    def links(df: DataFrame, rid: str) -> DataFrame:
        rows = df.select(F.col(rid).alias("id"), F.array_join(name_words(fields), " ").alias("key"))
        return _first_of(rows.where("key is not null"))

    return Rule("name: " + " + ".join(fields), NAME_STRENGTH, links)


def name_initials(fields: Sequence[str]) -> Rule:
    """A name with an initial, and names that have a word beginning with it in its place; two full names never link directly."""

    def links(df: DataFrame, rid: str) -> DataFrame:
        rows = df.select(F.col(rid).alias("id"), name_words(fields).alias("words")).where("words is not null")
        joined = lambda w: F.array_join(F.array_sort(w), " ")
        short = rows.where(F.exists("words", lambda w: F.length(w) == 1)).select("id", joined(F.col("words")).alias("key"))
        first = keep(short.groupBy("key").agg(F.min("id").alias("near")))
        cut = F.transform("words", lambda w: F.when(F.length(w) > 1, joined(F.concat(F.array_except("words", F.array(w)), F.array(w.substr(1, 1))))))
        full = rows.select("id", F.explode(F.array_distinct(cut)).alias("key")).where("key is not null")
        linked = full.join(shuffled(first), "key").where("id <> near")
        return linked.select(F.greatest("id", "near").alias("id"), F.least("id", "near").alias("root")).distinct()

    return Rule("initials: " + " + ".join(fields), NAME_STRENGTH * NAME_INITIAL, links)


def sound_code(words: Column) -> Column:
    """The Soundex codes of words, sorted."""
    return F.array_join(F.array_sort(F.transform(words, lambda w: F.soundex(w))), " ")


def sounds(fields: Sequence[str], like: float = 0.75, strength: float = SOUND_STRENGTH, leaders_of_a_code: int = 64, french: bool = False) -> Rule:
    """Words of the same sound whose spellings are alike: 1 - edit distance / longer length is at least ``like``.

    The sound is the Soundex codes, in any order; with ``french`` it is the code of ``functions.sounds``, and what must be alike
    are the transcriptions.

    In each code the first spelling by row order leads; those like it are its group, and the first of the others leads next,
    until none is left: spelling by spelling in row order, each goes to the first leader that it is like. A round is one
    join of distinct spellings with one leader for each code; there are as many rounds as leaders in the fullest code, at
    most ``leaders_of_a_code``, as the rule is defined: a spelling that is like none of so many leaders stays alone.
    """

    def links(df: DataFrame, rid: str) -> DataFrame:
        said = F.concat_ws(" ", *[text(c) for c in fields])
        rows = df.select(F.col(rid).alias("id"), (transcription(said) if french else slug(said)).alias("spelling")).where("spelling <> ''")
        rows = rows.withColumn("code", code_of(F.col("spelling")) if french else sound_code(F.split("spelling", " ")))
        left = keep(rows.groupBy("code", "spelling").agg(F.min("id").alias("first")))
        joined = None
        for _ in range(leaders_of_a_code):
            leaders = left.groupBy("code").agg(F.min_by("spelling", "first").alias("leader"), F.min("first").alias("root"))
            alike = 1 - F.levenshtein("spelling", "leader") / F.greatest(F.length("spelling"), F.length("leader"))
            near = keep(left.join(shuffled(leaders), "code").select("code", "spelling", "first", "root", (alike >= like).alias("near")))
            found = near.where("near").select("code", "spelling", "root")
            joined = found if joined is None else joined.union(found)
            left = near.where("not near").select("code", "spelling", "first")
            if left.isEmpty():
                break
        return rows.join(shuffled(joined), ["code", "spelling"]).where("id > root").select("id", "root")

    return Rule("sound: " + " + ".join(fields), strength, links)


def _alike(a: Column, b: Column) -> Column:
    """Whether two names (sorted words) may be one person's: word by word of close spelling, or one with an initial for a word of the other."""
    close = lambda x, y: 1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y)) >= 0.75
    spelled = (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, close), lambda ok: F.coalesce(ok, F.lit(False)))
    whole, initials = lambda w: F.filter(w, lambda x: F.length(x) > 1), lambda w: F.filter(w, lambda x: F.length(x) == 1)

    def fits(x: Column, y: Column) -> Column:
        more = F.array_except(whole(y), whole(x))
        same = (F.size(whole(x)) > 0) & (F.size(F.array_except(whole(x), whole(y))) == 0) & (F.size(whole(y)) == F.size(whole(x)) + 1)
        return (F.size(initials(x)) == 1) & same & F.forall(more, lambda w: w.startswith(F.element_at(initials(x), 1)))

    return spelled | fits(a, b) | fits(b, a)


def name_flags(df: DataFrame, groups: DataFrame, fields: Sequence[str], rid: str) -> DataFrame:
    """``groups`` (of :func:`grouped`) with lower confidence and a reason where the names of a group's rows differ.

    Each name is compared with that of the group's first row that has one. Where one is unlike it, the group gets at most 30
    and "different names"; where all are alike but not equal, nine tenths and "spelled differently". Identical groups stay.
    """
    rows = groups.select(rid, "group_id").join(shuffled(df.select(rid, name_words(fields).alias("words"))), rid).where("words is not null")
    firsts = keep(rows.groupBy("group_id").agg(F.min_by("words", rid).alias("first")))
    judged = rows.groupBy("group_id", "words").agg(F.count("*").alias("n")).join(shuffled(firsts), "group_id")
    flags = judged.groupBy("group_id").agg(F.max(~_alike(F.col("words"), F.col("first"))).alias("other"), F.max(F.col("words") != F.col("first")).alias("spelled"))
    out = groups.join(shuffled(flags), "group_id", "left")
    live = F.col("confidence") < 100
    score = F.when(live & F.col("other"), F.least(F.col("confidence"), F.lit(30))).when(live & F.col("spelled"), F.floor(F.col("confidence") * 0.9 + 0.5).cast("int")).otherwise(F.col("confidence"))
    reason = F.when(live & F.col("other"), "different names").when(live & F.col("spelled"), "spelled differently")
    return out.select(rid, "group_id", "n", score.alias("confidence"), F.concat_ws(", ", "reasons", reason).alias("reasons"))


def grouped(df: DataFrame, rules: Sequence[Rule], rid: str, columns: Sequence[str]) -> DataFrame:
    """(rid, group_id, n, confidence, reasons) of rows that a rule ties to others, however many steps apart.

    Rules join rows from the strongest to the weakest. A pair is as sure as all its rules together; a larger group as its
    weakest link, the weakest rule that still joined parts of it; both at most 99. Rows equal in all ``columns`` are sure (100).
    """
    rules = sorted(rules, key=lambda r: -r.strength)
    links = [keep(r.links(df, rid)) for r in rules]
    steps = []
    for tied in links:
        steps.append(components(tied if not steps else tied.union(steps[-1].select("id", F.col("label").alias("root")))))
    rows = steps[-1].select("id", F.col("label").alias("group_id"))
    whole = df.select(F.col(rid).alias("id"), _hashed(*[text(c) for c in columns]).alias("whole"))
    held = rows.join(shuffled(whole), "id")
    for k, step in enumerate(steps[:-1]):
        held = held.join(shuffled(step.select("id", F.col("label").alias(f"part{k}"))), "id", "left")
    weakest = F.lit(0)
    for k in range(1, len(rules)):
        before = F.coalesce(f"part{k - 1}", "id")
        weakest = F.when(F.min(before) < F.max(before), k).otherwise(weakest)
    groups = held.groupBy("group_id").agg(F.count("*").alias("n"), (F.min("whole") == F.max("whole")).alias("identical"), weakest.alias("weakest"))
    by_rule = None
    for k, tied in enumerate(links):
        marked = tied.select("id", F.lit(k).alias("rule"))
        by_rule = marked if by_rule is None else by_rule.union(marked)
    used = by_rule.join(shuffled(rows), "id").groupBy("group_id").agg(*[F.max(F.when(F.col("rule") == k, True)).alias(f"rule{k}") for k in range(len(rules))])
    doubt, strengths = F.lit(1.0), F.array(*[F.lit(r.strength) for r in rules])
    for k, r in enumerate(rules):
        doubt = doubt * F.when(F.col(f"rule{k}"), 1 - r.strength).otherwise(1.0)
    sure = F.when(F.col("n") == 2, 1 - doubt).otherwise(strengths[F.col("weakest")])
    confidence = F.when(F.col("identical"), 100).otherwise(F.least(F.floor(F.round(sure * 100, 6) + 0.5), F.lit(99))).cast("int")
    reasons = F.concat_ws(", ", *[F.when(F.col(f"rule{k}"), F.lit(r.label)) for k, r in enumerate(rules)])
    told = keep(groups.join(shuffled(used), "group_id").select("group_id", "n", confidence.alias("confidence"), reasons.alias("reasons")))
    return rows.join(shuffled(told), "group_id").select(F.col("id").alias(rid), "group_id", "n", "confidence", "reasons")
