"""Operator 4, quality rules: base counts of a text, and lines that too many documents of a host share.

DataFrame functions only. Line hashes of all documents are counted per host; a line that more than ``max_docs`` documents
of its host hold is removed from all of them but the one with the smallest id, and a document that loses more than ``max_lost``
of its characters is depleted. Only hashes and lengths of lines are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Production limits of the query.
MAX_DOCS, MAX_LOST = 20, 0.5


def _let(value, body):
    """``body`` of ``value``, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words, window: int = 5):
    """How many words lie in windows of ``window`` words that occur twice or more in the array. Windows are compared by 64-bit hashes."""
    ends = F.size(words) - window
    hashes = F.when(ends < 0, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), ends), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(window))))
    )

    def places(sorted_pairs):
        again = lambda e, j: F.coalesce(F.get(sorted_pairs, j - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(sorted_pairs, j + 1)["h"] == e["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(sorted_pairs, again), lambda e: e["i"]))

    def covered(at):
        return F.aggregate(F.transform(at, lambda x, j: F.least(F.lit(window), F.coalesce(F.get(at, j + 1) - x, F.lit(window)))), F.lit(0), lambda a, x: a + x)

    def count(h):
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_let(_let(pairs, places), covered))

    return _let(hashes, count)


def base_counts(text):
    """A struct of n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    with_word = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))

    def of_pieces(pieces):
        chars = F.length(text) - (F.size(pieces) - 1)  # every piece but the last ends at one white-space character
        return _let(
            F.filter(pieces, lambda w: w != ""),
            lambda words: F.struct(F.size(words).cast("long").alias("n_words"), chars.cast("long").alias("word_chars"), repeated_words(words).cast("long").alias("n_repeat_words")),
        )

    counts = _let(F.split(text, r"[\x20\x09-\x0D]"), of_pieces)
    symbols = (F.size(F.split(text, r"[#*$%&|<>]")) - 1).cast("long")
    again = _let(with_word, lambda lines: F.size(lines) - F.size(F.array_distinct(lines))).cast("long")
    return counts, symbols, again


def depleted_documents(docs: DataFrame, max_docs: int = MAX_DOCS, max_lost: float = MAX_LOST) -> DataFrame:
    """(row_key, doc_id, lost) of the rows of ``docs(row_key, doc_id, host, text)`` that lose more than ``max_lost`` of their line characters."""
    line = F.explode(F.split("text", "\n"))
    lines = docs.where(F.col("text").isNotNull()).select("row_key", "doc_id", "host", line.alias("line")).select(
        "row_key", "doc_id", "host", F.lower(F.btrim("line", F.lit(" \t\x0b\x0c\r"))).alias("line")
    ).where("line <> ''").select("row_key", "doc_id", "host", F.xxhash64("line").alias("h"), F.length("line").alias("chars"))
    common = lines.groupBy("host", "h").agg(F.count_distinct("doc_id").alias("docs"), F.min("doc_id").alias("first")).where(F.col("docs") > max_docs)
    common = common.select(F.col("host").alias("common_host"), F.col("h").alias("common_h"), "first")
    # lines of no shared host or hash stay out of the sum of what is lost, but count in the whole
    found = lines.join(common, F.col("host").eqNullSafe(F.col("common_host")) & (F.col("h") == F.col("common_h")))
    lost = found.where(~F.col("doc_id").eqNullSafe(F.col("first"))).groupBy("row_key", "doc_id").agg(F.sum("chars").alias("gone"))
    whole = lines.groupBy("row_key", "doc_id").agg(F.sum("chars").alias("all"))
    both = whole.unionByName(lost, allowMissingColumns=True).groupBy("row_key", "doc_id").agg(F.sum("all").alias("all"), F.sum("gone").alias("gone"))
    return both.where(F.col("gone") > max_lost * F.col("all")).select("row_key", "doc_id", (F.col("gone") / F.col("all")).alias("lost"))


def quality(docs: DataFrame, host: str = "source", max_docs: int = MAX_DOCS, max_lost: float = MAX_LOST) -> DataFrame:
    """One row per row of ``docs(doc_id, text, <host>)`` with base counts, base_failed, lost (share of characters in removed lines) and kept.

    A null text has no words and fails; a null host is a host of its own; a null doc_id counts as no document when lines are
    counted; repeated rows with one doc_id count once and get the same verdict; an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select("doc_id", F.col(host).alias("host"), "text").withColumn("row_key", F.xxhash64("doc_id", "host", "text"))
    counts, symbols, again = base_counts(F.col("text"))
    made = rows.select("row_key", "doc_id", counts.alias("c"), symbols.alias("n_symbols"), again.alias("n_dup_lines"))
    made = made.select("row_key", "doc_id", "c.n_words", "c.word_chars", "n_symbols", "n_dup_lines", "c.n_repeat_words")
    gone = depleted_documents(rows, max_docs, max_lost).withColumnsRenamed({"row_key": "gone_key", "doc_id": "gone_id"})
    joined = made.join(gone, (F.col("row_key") == F.col("gone_key")) & F.col("doc_id").eqNullSafe(F.col("gone_id")), "left")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & F.col("lost").isNull()).alias("kept"),
    )


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the base counts, base_failed and kept of all ``documents``."""
    return quality(table(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, word, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS pos FROM (
    SELECT doc_id, unnest(l) AS word, unnest(range(len(l))) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS l FROM d))),
g AS (SELECT doc_id, pos, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o AS gram
    FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
t AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g WHERE gram IS NOT NULL) WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(pos, pos + 5)) AS p FROM t) GROUP BY doc_id),
c AS (SELECT doc_id, count(*) AS n_words, sum(length(word)) AS word_chars FROM w GROUP BY doc_id),
l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM d),
u AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
n AS (SELECT * FROM (SELECT doc_id, source, lower(trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13))) AS line FROM l) WHERE line <> ''),
f AS (SELECT source, line, min(doc_id) AS first FROM n GROUP BY source, line HAVING count(DISTINCT doc_id) > {MAX_DOCS}),
x AS (SELECT n.doc_id FROM n LEFT JOIN f ON n.source IS NOT DISTINCT FROM f.source AND n.line = f.line GROUP BY n.doc_id
    HAVING sum(CASE WHEN f.first <> n.doc_id THEN length(n.line) ELSE 0 END) > {MAX_LOST} * sum(length(n.line))),
b AS (SELECT d.doc_id, coalesce(c.n_words, 0)::BIGINT AS n_words, coalesce(c.word_chars, 0)::BIGINT AS word_chars,
    (length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(u.n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(r.n_repeat_words, 0)::BIGINT AS n_repeat_words, x.doc_id IS NOT NULL AS depleted
    FROM d LEFT JOIN c USING (doc_id) LEFT JOIN u USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN x ON x.doc_id = d.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT depleted AS kept FROM b
"""
