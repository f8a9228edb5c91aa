"""From raw documents to packed sequences: language ID, near-duplicates, personal data, mixing, packing.

Every stage takes all that its predecessor kept. The first four return the columns of ``documents``; the last returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import langid, mixing, packing, pii, simhash
from palimpsest.llm.common import stash, table

#: A document whose best language has a lower score is in no language that was learned.
LEAST_SCORE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sets ``lang`` to the predicted language; documents without text, letters or a likely language go.

    Null, empty and letterless texts go; null ids and null languages don't matter; repeated rows are judged each, alike; long texts are read
    whole; an empty table, or one without any labelled text to learn from, gives no rows. Other columns pass through."""
    names = [c if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)]  # the operator's own columns may have the same names
    found = langid.identify(docs.toDF(*names), langid.learn(docs)).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return found.select(*(F.col("lang_pred" if c == "lang" else n).alias(c) for c, n in zip(docs.columns, names)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5-word shingles, similarity of at least 0.8) stays, the one with the smallest doc_id.

    Classes of close SimHash fingerprints and blocks of minima propose pairs, sets of shingles decide.
    Null, empty and blank texts are copies of each other; a null doc_id stays only where its group has no other; of repeated rows
    one stays; long texts are compared whole; an empty table gives no rows. Other columns pass through."""
    return simhash.survivors(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data becomes the name of its kind; all documents stay.

    Null texts stay null, empty ones empty; repeated rows are masked each; long texts are read whole; n_chars, if there, is that of the new
    text; an empty table gives no rows. Other columns pass through."""
    return pii.scan(docs, mask=True)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The calibrated sample of the documents: half of the tokens, sources and topics and languages by their flattened shares.

    Null sources and languages are groups of their own; a null or empty text counts one token; rows of one doc_id (a null counts as
    one, too) in one cell are kept or left together; an empty table gives no rows. Other columns pass through."""
    return mixing.sampled(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 token ids, one row per piece.

    Null and empty texts are documents of the end id alone; null ids stay null; repeated rows are packed each; long texts are cut over as many
    sequences as they need; an empty table gives no rows. Other columns are ignored."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", language), ("near_dedup", near_dedup), ("personal_data", personal_data), ("mix", mix), ("pack", pack)]

#: The networks of the first and third stage can't be written in SQL; tests hold the pipeline against a plain version in Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name)
    return docs
