"""Text functions as columns: tokens, stems, roots, set overlap. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import LATIN, RulePack

#: Characters that may stand at either end of a word.
MARKS = ".,?!…~"
NOT_WORD = r"[^\p{L}\p{N}_]"


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Words between white space, without marks at their ends; none is empty."""
    split = F.split(F.coalesce(text, F.lit("")), r"\s+")
    return F.filter(F.transform(split, lambda w: F.btrim(w, F.lit(MARKS))), lambda w: w != "")


def raw_words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def pairs(s: Column) -> Column:
    """All pairs of neighbouring characters; a single character stands for itself, an empty text gives one empty string."""


    def of(s: Column) -> Column:
        n = F.length(s)
        return F.when(n < 2, F.array(s)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(s, i, F.lit(2))))

    return let(s, of)


def bigrams(text: Column) -> Column:
    """Pairs of characters of the text without its white space."""
    return pairs(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", ""))


def hybrid(text: Column) -> Column:
    return F.concat(words(text), bigrams(text))


def stem(word: Column, pack: RulePack = LATIN) -> Column:
    """Peels endings off until none is left or one character remains."""
    once = lambda w: F.when(F.length(w) > 1, F.regexp_replace(w, pack.endings, "")).otherwise(w)
    peeled = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(word), F.lit(1))), word, lambda w, _: once(w))  # every ending has a character at least
    return F.when(word.rlike(pack.endings), peeled).otherwise(word)  # most words have no ending and are looked at once


def bare(word: Column) -> Column:
    return F.regexp_replace(word, NOT_WORD, "")


def stemmed_bigrams(text: Column, pack: RulePack = LATIN) -> Column:
    """Pairs of characters of the stems, put together."""
    return pairs(F.array_join(F.transform(raw_words(text), lambda w: stem(bare(w), pack)), ""))


def roots(text: Column, pack: RulePack = LATIN) -> Column:
    """The set of stems without particles; a word of one character is none, and a root that got too short is put back."""
    kept = F.filter(F.transform(raw_words(text), bare), lambda w: F.length(w) >= 2)

    def root(w: Column) -> Column:
        return let(stem(w, pack), lambda s: F.when(F.length(F.regexp_replace(s, pack.particles, "")) >= 2, F.regexp_replace(s, pack.particles, "")).otherwise(s))

    return F.array_distinct(F.transform(kept, root))


def tokens(text: Column) -> Column:
    """An estimate of tokens: one and a half a character, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(text, F.lit(""))) * 1.5)).cast("long")


def session_number(name: Column) -> Column:
    """7 of ``S07``; null of anything else."""
    return F.nullif(F.regexp_extract(F.trim(name), r"^S([0-9]{1,18})$", 1), F.lit("")).cast("long")


def days(spec: Column) -> Column:
    """3 of ``3d``; null of anything else."""
    return F.nullif(F.regexp_extract(F.trim(spec), r"^([0-9]{1,18})d$", 1), F.lit("")).cast("long")


def first_due(setup: Column, spec: Column) -> Column:
    """The first session, later than the one of number ``setup``, at which a trigger fires: after so many days, a session being a day, in a named session
    or the first after it, or at the next start of a session. Null where the trigger names no time."""
    after = F.coalesce(setup + days(spec), session_number(spec), F.when(F.trim(spec) == "session_start", setup + 1))
    return F.when(after.isNotNull(), F.greatest(after, setup + 1))


def containment(query: Column, doc: Column) -> Column:
    """The share of a set of terms that another set has."""
    return F.size(F.array_intersect(query, doc)) / F.greatest(F.size(F.array_distinct(query)), F.lit(1))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def percentile(values: Column, p: int) -> Column:
    """The value at place ``n * p / 100`` of the sorted array, by whole places and without interpolation."""
    return let(F.sort_array(values), lambda v: F.get(v, F.least(F.size(v) - 1, F.floor(F.size(v) * p / 100).cast("int"))))
