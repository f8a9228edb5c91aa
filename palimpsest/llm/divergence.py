"""Operator 11, source divergence audit: how far the vocabularies of sources of one language lie apart, and by which terms.

A group (language, source) gives every kept term of its language a smoothed share ``p`` in billionths, and two shares differ
by ``f = (p - q)^2 div (p + q)``. Most terms are missing from most sources, so a pair starts at V times the ``f`` of two zero
counts, and an inverted index corrects it: only a posting of a term changes a pair. Postings meet in cells of a part of the
terms and two blocks of sources; a cell sums its corrections, so pairs are sent on once a cell and not once a term. All arithmetic is
in integers. The result has every pair of sources of a language and is quadratic in them for that reason only.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import modest, stash, table
from .tokens import slices

#: Lower-cases A-Z and turns every other sign of ASCII into a space; bytes of other characters stay.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Shares are in billionths.
SCALE = 10**9
#: Distinct terms that a task counts before it sends them on; sources in a block and terms in a part of a cell.
HELD, SOURCES, TERMS = 300_000, 256, 4096


#: Rows of counted terms.
COUNTED, COUNTED_SQL = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())]), "lang string, source string, term string, n long, docs long"


def _counted(batches):
    """Counts terms and documents with them by language and source, a bounded number of terms at a time."""
    groups: dict[tuple, tuple[Counter, Counter]] = {}
    held = 0

    def sent():
        for (lang, source), (words, docs) in groups.items():
            n = len(words)
            terms = pa.array(list(words), pa.binary()).view(pa.string())
            columns = [pa.repeat(pa.scalar(lang), n), pa.repeat(pa.scalar(source), n), terms, pa.array(words.values(), pa.int64()), pa.array(map(docs.__getitem__, words), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema=COUNTED)
        groups.clear()

    for whole in batches:
        for batch in slices(whole):
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
                words = text.translate(LETTERS).split()
                if (lang, source) not in groups:
                    groups[lang, source] = Counter(), Counter()
                n, docs = groups[lang, source]
                held -= len(n)
                n.update(words)
                docs.update(set(words))
                held += len(n)
                if held > HELD:
                    yield from sent()
                    held = 0
    yield from sent()


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * kept)), exact for every long."""
    wide = lambda c: c.cast("decimal(20,0)")
    return 1 + F.call_function("div", wide(count + 2) * SCALE, wide(F.nullif(total + 2 * kept, F.lit(0))))


def distance(p, q):
    """f of two shares, of columns or arrays."""
    if isinstance(p, Column):
        return F.call_function("div", (p - q) * (p - q), p + q)
    gap = p - q
    return gap * gap // (p + q)


def _corrections(key, postings: pa.Table, groups: pa.Table) -> pa.Table:
    """(lang, a, b, value) of a cell: what its postings change in the pairs of its sources; the first part of the terms has the pairs' starts, too."""
    part, low, high = (k.as_py() for k in key[1:])
    names, zero, kept, block = (groups.column(c) for c in ("source", "p0", "kept", "block"))
    names, zero, block = names.combine_chunks(), zero.to_numpy(), block.to_numpy()
    where = pa.compute.index_in(postings.column("source"), names).to_numpy()
    terms = postings.column("term").combine_chunks().dictionary_encode()
    p = np.repeat(zero[:, None], len(terms.dictionary), axis=1)
    here = np.zeros(p.shape, bool)
    p[where, terms.indices.to_numpy()], here[where, terms.indices.to_numpy()] = postings.column("p").to_numpy(), True
    start = distance(zero[:, None], zero[None, :]) if kept[0].as_py() else np.zeros((len(names), len(names)), np.int64)
    value = np.zeros_like(start)
    for x in range(len(names)):
        at = np.flatnonzero(here[x])
        ys = np.flatnonzero(block != block[x]) if low != high else np.arange(len(names))
        for some in np.array_split(at, -(-len(at) // 1024)) if len(at) else ():
            change = distance(p[x, some], p[np.ix_(ys, some)]) - start[x, ys, None]
            change[here[np.ix_(ys, some)] & (ys < x)[:, None]] = 0  # the other source's turn has counted it
            value[x, ys] += change.sum(1)
    value += value.T
    if part == 0:
        value += start * kept[0].as_py()
    i, j = np.nonzero(np.triu(np.ones_like(value, bool), 1) & ((block[:, None] != block[None, :]) | (low == high)) & ((value != 0) | (part == 0)))
    return pa.table({"lang": pa.repeat(key[0], len(i)), "a": names.take(i), "b": names.take(j), "value": value[i, j]})


def divergence(docs: DataFrame, lang: str = "lang", source: str = "source", least_docs: int = 10, top: int = 10) -> DataFrame:
    """lang, source, part, item, value and rank: in part ``pair`` every other source of the language with the sum of ``f`` over all kept
    terms, in part ``term`` the ``top`` terms that the source uses more than its language does.

    Every row of ``docs(text, <lang>, <source>)`` is a document, repeated rows, too. A null text, language or source is ''; a text of any length is
    read whole; a group without terms has zero counts only; a language without kept terms has pairs of value 0 and no terms; a source alone in its
    language has no pairs; an empty table gives no rows; other columns are ignored. Ranks break ties by item. Counts are exact
    up to 2^63, sources per language are met in blocks, and a task holds a bounded number of terms."""
    named = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), "text")
    counted = modest(named.where("text IS NOT NULL").withColumn("text", F.col("text").cast("binary"))).mapInArrow(_counted, COUNTED_SQL)
    cells = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    post = cells.select(
        "lang", "source", "term", "n", F.sum("n").over(of_term).alias("total"), F.sum("docs").over(of_term).alias("docs"), (F.min("source").over(of_term) == F.col("source")).cast("long").alias("first"),
    )
    post = stash(post.where(F.col("docs") >= least_docs).drop("docs"), "postings")
    sums = post.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum("first").alias("first"))
    groups = named.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").fillna(0)
    langs = groups.groupBy("lang").agg(F.sum("n").alias("all"), F.sum("first").alias("kept"), F.ceil(F.count("*") / SOURCES).alias("blocks"))
    groups = groups.select("lang", "source", "n").join(langs, "lang").withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("kept") / TERMS)))
    groups = stash(groups.select("*", share(F.lit(0), F.col("n"), F.col("kept")).alias("p0")), "groups")
    of_group = groups.withColumnRenamed("n", "size").drop("p0")
    weighed = post.join(of_group, ["lang", "source"]).select(
        "lang", "source", "term", share(F.col("n"), F.col("size"), F.col("kept")).alias("p"), share(F.col("total"), F.col("all"), F.col("kept")).alias("q"), "blocks", "parts"
    )
    weighed = stash(weighed, "weights")

    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    cell = ["lang", "part", "low", "high"]

    def dealt(rows: DataFrame) -> DataFrame:
        """A row in every cell that its block of sources has with another."""
        rows = rows.withColumn("block", F.pmod(F.xxhash64("source"), "blocks")).withColumn("other", every("blocks"))
        return rows.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("other", "blocks", "parts")

    left = dealt(weighed.drop("q").withColumn("part", F.pmod(F.xxhash64("term"), "parts"))).groupBy(cell)
    right = dealt(groups.select("lang", "source", "p0", "kept", "blocks", "parts").fillna({"p0": 1}).withColumn("part", every("parts"))).groupBy(cell)
    changes = left.cogroup(right).applyInArrow(_corrections, "lang string, a string, b string, value long")
    sums = changes.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = sums.select("lang", both.alias("e"), "value").select("lang", "e.source", F.lit("pair").alias("part"), "e.item", "value")
    terms = weighed.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    return pairs.select("*", rank).unionByName(terms.select("*", rank).where(F.col("rank") <= top))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, source, part, item, value and rank of all ``documents``; terms in at least 10 documents of a language, ten terms of every source."""
    return divergence(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
v AS (SELECT lang, count(*) AS kept, sum(total) AS size FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT w.lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY w.lang, source, term),
s AS (SELECT lang, source, sum(n) AS size FROM c GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, (1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (coalesce(s.size, 0) + 2 * v.kept))::HUGEINT AS p,
    (1 + 1000000000::HUGEINT * (k.total + 2) // (v.size + 2 * v.kept))::HUGEINT AS q
    FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN s ON s.lang = g.lang AND s.source = g.source),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
    UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q),
o AS (SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM r)
SELECT * FROM o WHERE part = 'pair' OR rank <= 10
"""
