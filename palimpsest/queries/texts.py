"""Text functions over every turn of ``conversations``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import LATIN
from ..functions import text as T
from .base import Book, table

book = Book()
QUERIES, ORACLES = book.queries, book.oracles

# the same rules in SQL
SQL_WORDS = r"list_filter(list_transform(string_split_regex({0}, '\s+'), lambda w: regexp_replace(w, '^[.,?!…~]+|[.,?!…~]+$', '', 'g')), lambda w: w <> '')"
SQL_RAW = r"list_filter(string_split_regex({0}, '\s+'), lambda w: w <> '')"
SQL_PAIRS = "CASE WHEN length({0}) < 2 THEN [{0}] ELSE list_transform(range(1, length({0})), lambda i: substr({0}, i, 2)) END"


#: Rounds that the SQL peels: every ending of the Latin pack has two characters at least, so words of twice as many characters reach their fixpoint.
PEELS = 24
PEEL = f"CASE WHEN length(w) > 1 THEN regexp_replace(w, '{LATIN.endings}', '') ELSE w END"


def stems_cte(source: str, word: str, keep: str) -> str:
    """CTEs st0..stN that peel endings from ``word`` of ``source``, carrying the columns ``keep``."""
    out = [f"st0 AS (SELECT {keep}, {word} AS w FROM {source})"]
    out += [f"st{i + 1} AS (SELECT {keep}, {PEEL} AS w FROM st{i})" for i in range(PEELS)]
    return ", ".join(out)


LAST = f"st{PEELS}"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


@book.query(f"SELECT conv_id, turn, len(w) AS n_tokens, array_to_string(w, ' ') AS tokens FROM (SELECT conv_id, turn, {SQL_WORDS.format('text')} AS w FROM conversations)")
def tok_eojeol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """words without marks at their ends."""
    w = turns(spark, sf_dir).select("conv_id", "turn", T.words(F.col("text")).alias("w"))
    return w.select("conv_id", "turn", F.size("w").cast("long").alias("n_tokens"), F.array_join("w", " ").alias("tokens"))


@book.query(f"SELECT conv_id, turn, len(b) AS n_pairs, len(list_distinct(b)) AS n_distinct FROM (SELECT conv_id, turn, {SQL_PAIRS.format('s')} AS b FROM (SELECT conv_id, turn, regexp_replace(text, '\\s+', '', 'g') AS s FROM conversations))")
def tok_bigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pairs of characters."""
    b = turns(spark, sf_dir).select("conv_id", "turn", T.bigrams(F.col("text")).alias("b"))
    return b.select("conv_id", "turn", F.size("b").cast("long").alias("n_pairs"), F.size(F.array_distinct("b")).cast("long").alias("n_distinct"))


@book.query(f"SELECT conv_id, turn, len(w) + len(b) AS n_hybrid FROM (SELECT conv_id, turn, {SQL_WORDS.format('text')} AS w, {SQL_PAIRS.format('s')} AS b FROM (SELECT *, regexp_replace(text, '\\s+', '', 'g') AS s FROM conversations))")
def tok_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """both kinds of tokens in one bag."""
    return turns(spark, sf_dir).select("conv_id", "turn", F.size(T.hybrid(F.col("text"))).cast("long").alias("n_hybrid"))


@book.query("SELECT conv_id, count(*) AS turns, sum(greatest(1, floor(length(text) * 1.5)))::BIGINT AS tokens FROM conversations GROUP BY 1")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimated tokens of every chat."""
    return turns(spark, sf_dir).groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum(T.tokens(F.col("text"))).alias("tokens"))


@book.query(rf"WITH u AS (SELECT regexp_replace(unnest({SQL_RAW.format('text')}), '[^\p{{L}}\p{{N}}_]', '', 'g') AS word FROM conversations), d AS (SELECT word, count(*) AS n FROM u GROUP BY 1), {stems_cte('d', 'word', 'word, n')} SELECT w AS stem, sum(n)::BIGINT AS n, count(*) AS forms FROM {LAST} GROUP BY 1")
def stem_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stems of all words, with how many words and forms they stand for."""
    w = turns(spark, sf_dir).select(F.explode(T.raw_words(F.col("text"))).alias("w")).select(T.bare(F.col("w")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return w.select(T.stem(F.col("word")).alias("stem"), "n").groupBy("stem").agg(F.sum("n").alias("n"), F.count("*").alias("forms"))


@book.query(
    rf"WITH u AS (SELECT conv_id, turn, i, regexp_replace(r, '[^\p{{L}}\p{{N}}_]', '', 'g') AS word FROM (SELECT conv_id, turn, unnest(w) AS r, unnest(range(len(w))) AS i FROM (SELECT conv_id, turn, {SQL_RAW.format('text')} AS w FROM conversations))), {stems_cte('u', 'word', 'conv_id, turn, i')}, "
    f"j AS (SELECT conv_id, turn, string_agg(w, '' ORDER BY i) AS s FROM {LAST} GROUP BY 1, 2) "
    f"SELECT conv_id, turn, len(list_distinct({SQL_PAIRS.format('s')})) AS n_terms FROM (SELECT c.conv_id, c.turn, coalesce(s, '') AS s FROM conversations c LEFT JOIN j USING (conv_id, turn))"
)
def tok_stemmed_bigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pairs of characters over stems."""
    return turns(spark, sf_dir).select("conv_id", "turn", F.size(F.array_distinct(T.stemmed_bigrams(F.col("text")))).cast("long").alias("n_terms"))


SQL_ROOTS = rf"""u AS (SELECT conv_id, turn, regexp_replace(unnest({SQL_RAW.format('text')}), '[^\p{{L}}\p{{N}}_]', '', 'g') AS word FROM conversations),
v AS (SELECT * FROM u WHERE length(word) >= 2), {stems_cte('v', 'word', 'conv_id, turn')},
roots AS (SELECT DISTINCT conv_id, turn, CASE WHEN length(regexp_replace(w, '{LATIN.particles}', '')) >= 2 THEN regexp_replace(w, '{LATIN.particles}', '') ELSE w END AS root FROM {LAST})"""


@book.query(f"WITH {SQL_ROOTS} SELECT conv_id, turn, count(*) AS n_roots FROM roots GROUP BY 1, 2")
def root_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """how many roots every turn has; turns without any are left out."""
    return turns(spark, sf_dir).select("conv_id", "turn", F.size(T.roots(F.col("text"))).cast("long").alias("n_roots")).where("n_roots > 0")


@book.query(
    f"WITH {SQL_ROOTS}, l AS (SELECT conv_id, turn, list(root) AS r FROM roots GROUP BY 1, 2), p AS (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) "
    "SELECT p.conv_id, p.turn, round(CASE WHEN a.r IS NULL OR b.r IS NULL THEN 0 ELSE len(list_intersect(a.r, b.r)) / greatest(1, len(list_distinct(list_concat(a.r, b.r)))) END, 6)::DOUBLE AS jaccard "
    "FROM p LEFT JOIN l a ON a.conv_id = p.conv_id AND a.turn = p.turn LEFT JOIN l b ON b.conv_id = p.conv_id AND b.turn = p.before WHERE p.before IS NOT NULL"
)
def jaccard_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: overlap of each turn's roots with those of the turn before."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    r = turns(spark, sf_dir).select("conv_id", "turn", T.roots(F.col("text")).alias("r")).withColumn("before", F.lag("r").over(w)).where("before IS NOT NULL")
    return r.select("conv_id", "turn", F.round(T.jaccard(F.col("r"), F.col("before")), 6).alias("jaccard"))
