"""The recall gate: whether an utterance needs a look into memory, and why. Ordered rules as one column expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config

#: Variants by name; ``shipped`` tests references to the past before length, ``content`` the other way round.
VARIANTS = ("past_only", "always", "ritual_only", "content", "shipped")


def starts(text: Column, config: Config = DEFAULT) -> Column:
    """The first two characters of every content word of a text, as a set."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({config.pack.content_word})"), 1)
    return F.array_distinct(F.transform(found, lambda w: F.substring(w, 1, 2)))


def vocabulary(items: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(chat, vocab): what each chat's stored summaries start their content words with."""
    return items.groupBy("chat").agg(F.array_distinct(F.flatten(F.collect_set(starts(F.col("summary"), config)))).alias("vocab"))


def decide(utterance: Column, vocab: Column, variant: str = "shipped", config: Config = DEFAULT) -> Column:
    """The reason why the gate opens or stays shut: past, short, ritual, contact, none or always. It opens for past, contact and always, and for ``ritual_only`` also for none."""
    past = utterance.rlike(config.pack.past_reference)
    short = F.length(utterance) < config.min_utterance
    ritual = F.trim(utterance).rlike(config.pack.ritual)
    contact = F.arrays_overlap(starts(utterance, config), F.coalesce(vocab, F.array().cast("array<string>")))
    return {
        "past_only": F.when(past, "past").when(short, "short").when(ritual, "ritual").otherwise("none"),
        "always": F.lit("always"),
        "ritual_only": F.when(ritual, "ritual").when(short, "short").otherwise("always"),
        "content": F.when(ritual, "ritual").when(short, "short").when(past, "past").when(contact, "contact").otherwise("none"),
        "shipped": F.when(past, "past").when(short, "short").when(ritual, "ritual").when(contact, "contact").otherwise("none"),
    }[variant]


def opens(reason: Column) -> Column:
    return reason.isin("past", "contact", "always")
