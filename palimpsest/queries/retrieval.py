"""Retrieval: ``benchmark`` passages are queries, ``documents`` the corpus, documents that hold a passage word for word its gold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import text as T
from ..operators import retrieval as ops
from .base import Book, saved, table
from .texts import SQL_WORDS

book = Book()
QUERIES, ORACLES = book.queries, book.oracles
C = DEFAULT


def probed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of the passages: (query_id, term, qtf)."""
    return ops.postings(table(spark, sf_dir, "benchmark"), T.words(F.col("text")), "item_id").select(F.col("item_id").alias("query_id"), "term", F.col("tf").alias("qtf"))


def indexed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The documents with the terms that are asked for, a row each, which are written once, and the query terms."""
    asked = probed(spark, sf_dir)
    index = saved(ops.tallied(table(spark, sf_dir, "documents"), T.words(F.col("text")), asked), "index")
    return saved(ops.merged(index, F.col("doc_id"), "doc_id"), "merged") if ops.repeated(index) else index, asked


def corpus(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Postings of the terms that are asked for, which are written once, query terms, and the documents' lengths."""
    docs = table(spark, sf_dir, "documents")
    asked = probed(spark, sf_dir)
    index = saved(ops.indexed(docs, T.words(F.col("text")), asked), "postings")
    return index.where("term <> ''"), asked, index.where("term = ''").select("doc_id", "dl")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, asked, docs = corpus(spark, sf_dir)
    return ops.bm25(index, asked, C, docs=docs)


def best(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """(query_id, doc_id, score): BM25 of what can be among the best ``k`` documents of every passage."""
    return ops.contenders(*indexed(spark, sf_dir), k, config=C)


def best_by_importance(spark: SparkSession, sf_dir: str, k: int, labelled: bool = False, probes: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, score, importance): BM25 of what can be among the best ``k`` of the documents of any importance, or also of those without a label. ``probes(query_id)`` are the passages, if not all are asked."""
    index, asked = indexed(spark, sf_dir)
    asked = asked if probes is None else asked.join(probes.select("query_id").distinct(), "query_id", "left_semi")
    known = importance(spark, sf_dir)
    # sizes and frequencies are those of all documents, so others stay as rows of a kind of their own
    found = ops.contenders(saved(index.join(known, "doc_id", "left"), "important"), asked, k, config=C, kind="importance")
    return found.where("importance IS NOT NULL") if labelled else found


def importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance of documents from their labels; others have the middle value."""
    w = 0.2 + 0.6 * F.col("quality") - 0.2 * F.col("toxic")
    return table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max(w).alias("importance"))


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, doc_id) where the document holds the passage."""
    items, docs = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")
    return ops.holding(docs.select("doc_id", "text"), items.select(F.col("item_id").alias("query_id"), F.col("text").alias("passage")))


W = SQL_WORDS.format("text")
BM25 = f"""WITH p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({W}) AS term FROM documents) GROUP BY ALL),
q AS (SELECT item_id AS query_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({W}) AS term FROM benchmark) GROUP BY ALL),
l AS (SELECT doc_id, sum(tf) AS dl FROM p GROUP BY 1), f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
z AS (SELECT (SELECT count(*) FROM documents)::DOUBLE AS n, (SELECT sum(dl) FROM l) / (SELECT count(*) FROM documents)::DOUBLE AS avgdl),
s AS (SELECT query_id, doc_id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {C.bm25_k1 + 1} / (tf + {C.bm25_k1} * (1 - {C.bm25_b} + {C.bm25_b} * dl / avgdl)))::DOUBLE AS raw
    FROM q JOIN p USING (term) JOIN f USING (term) JOIN l USING (doc_id), z GROUP BY ALL),
r AS (SELECT query_id, doc_id, round(raw, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 6) DESC, doc_id) AS rank FROM s WHERE round(raw, 6) > 0),
imp AS (SELECT doc_id, max(0.2 + 0.6 * quality - 0.2 * toxic)::DOUBLE AS importance FROM labels GROUP BY 1),
gold AS (SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE length(b.text) > 0)"""


@book.query(f"{BM25} SELECT query_id, rank, doc_id, score FROM r WHERE rank <= 5")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best documents of every passage."""
    return ops.ranked(best(spark, sf_dir, C.top_k), C.top_k).select("query_id", "rank", "doc_id", "score")


@book.query(f"{BM25}, x AS (SELECT query_id, doc_id, round(raw / max(raw) OVER (PARTITION BY query_id), 6) AS relevance FROM s) SELECT query_id, doc_id, relevance FROM x QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, doc_id) <= 5")
def bm25_norm_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """relevance as a share of the best score."""
    n = ops.normalised(best(spark, sf_dir, 5)).select("query_id", "doc_id", F.round("relevance", 6).alias("relevance"))
    return n.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevance"), "doc_id"))).where("r <= 5").drop("r")


@book.query(f"""{BM25}, x AS (SELECT query_id, doc_id, raw / max(raw) OVER (PARTITION BY query_id) AS rel, coalesce(importance, 0.5) AS i FROM s LEFT JOIN imp USING (doc_id)),
y AS (SELECT query_id, doc_id, unnest([{{'c': 'product', 's': round(rel * i, 6)}}, {{'c': 'sum', 's': round({C.relevance_weight} * rel + {C.importance_weight} * i, 6)}}, {{'c': 'gate', 's': CASE WHEN i < {C.importance_gate} THEN -1.0 ELSE round(rel, 6) END}}], recursive := true) FROM x)
SELECT c AS combiner, query_id, doc_id, s::DOUBLE AS score FROM y QUALIFY row_number() OVER (PARTITION BY c, query_id ORDER BY s DESC, doc_id) <= 3""")
def salience_combiners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the three best by product, by weighted sum and behind a hard gate."""
    x = ops.normalised(best_by_importance(spark, sf_dir, 3)).withColumn("i", F.coalesce("importance", F.lit(0.5)))
    rel, i = F.col("relevance"), F.col("i")
    each = [
        F.struct(F.lit("product").alias("c"), F.round(rel * i, 6).alias("s")), F.struct(F.lit("sum").alias("c"), F.round(C.relevance_weight * rel + C.importance_weight * i, 6).alias("s")),
        F.struct(F.lit("gate").alias("c"), F.when(i < C.importance_gate, F.lit(-1.0)).otherwise(F.round(rel, 6)).alias("s")),
    ]
    y = x.select("query_id", "doc_id", F.explode(F.array(*each)).alias("e")).select(F.col("e.c").alias("combiner"), "query_id", "doc_id", F.col("e.s").alias("score"))
    return y.withColumn("r", F.row_number().over(Window.partitionBy("combiner", "query_id").orderBy(F.desc("score"), "doc_id"))).where("r <= 3").drop("r")


@book.query(f"""{BM25}, g AS (SELECT query_id, min(rank) AS best FROM gold LEFT JOIN r USING (query_id, doc_id) GROUP BY 1),
h AS (SELECT query_id, coalesce(best, (SELECT count(*) FROM documents)) AS best FROM g)
SELECT count(*) AS probes, round(avg((best <= 1)::INT), 6)::DOUBLE AS recall_1, round(avg((best <= 5)::INT), 6)::DOUBLE AS recall_5, round(avg((best <= 10)::INT), 6)::DOUBLE AS recall_10, round(avg(best), 6)::DOUBLE AS mean_rank FROM h""")
def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall at 1, 5 and 10 and the mean rank of the gold document."""
    n = table(spark, sf_dir, "documents").count()
    best = ops.gold_ranks(ops.ranked(scores(spark, sf_dir)), gold(spark, sf_dir), n)
    share = lambda k: F.round(F.avg((F.col("best") <= k).cast("int")), 6).alias(f"recall_{k}")
    return best.agg(F.count("*").alias("probes"), share(1), share(5), share(10), F.round(F.avg("best"), 6).alias("mean_rank"))


THRESHOLDS = (0, 20, 40, 80, 160, 320)


@book.query(f"{BM25}, t AS (SELECT query_id, max(score) AS top, query_id IN (SELECT query_id FROM gold) AS needed FROM r GROUP BY 1) SELECT needed, th::INTEGER AS threshold, count(*) AS probes, round(avg((top > th)::INT), 6)::DOUBLE AS passed FROM t, unnest([{', '.join(map(str, THRESHOLDS))}]) AS u(th) GROUP BY ALL")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the share of needed and idle probes whose best score passes a threshold."""
    top = ops.ranked(best(spark, sf_dir, 1)).groupBy("query_id").agg(F.max("score").alias("top"))
    needed = gold(spark, sf_dir).select("query_id").distinct().withColumn("needed", F.lit(True))
    t = top.join(needed, "query_id", "left").withColumn("needed", F.coalesce("needed", F.lit(False))).withColumn("threshold", F.explode(F.array(*map(F.lit, THRESHOLDS))))
    return t.groupBy("needed", "threshold").agg(F.count("*").alias("probes"), F.round(F.avg((F.col("top") > F.col("threshold")).cast("int")), 6).alias("passed"))


@book.query(f"""{BM25}, qs AS (SELECT query_id, count(*) AS size FROM q GROUP BY 1), c AS (SELECT query_id, doc_id, count(*) / any_value(size) AS v FROM q JOIN p USING (term) JOIN qs USING (query_id) GROUP BY ALL),
cr AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(v, 6) DESC, doc_id) AS rank FROM c),
u AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / ({C.rrf_k} + rank)), 6) AS score FROM (SELECT query_id, doc_id, rank FROM r UNION ALL SELECT query_id, doc_id, rank FROM cr) GROUP BY ALL)
SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM u) WHERE rank <= 5""")
def rrf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 and containment fused by reciprocal ranks."""
    index, asked = indexed(spark, sf_dir)
    # the k-th of one ranking has 1 / (rrf_k + k) at least; what is in none of the first rrf_k + 2 k + 1 places of either has less, by both together
    depth = C.rrf_k + 2 * C.top_k + 1
    first = [ops.ranked(ops.contenders(index, asked, depth, bm25, C), depth).select("query_id", "doc_id") for bm25 in (True, False)]
    pairs = saved(first[0].union(first[1]).distinct(), "pairs")
    a, b = ops.places(index, asked, pairs, config=C), ops.places(index, asked, pairs, bm25=False)
    return ops.ranked(ops.fused([a, b], C), C.top_k).select("query_id", "rank", "doc_id", "score")


@book.query(f"""{BM25}, pol AS (SELECT unnest(['all', 'extracted', 'weighted']) AS policy),
x AS (SELECT policy, query_id, doc_id, round(CASE WHEN policy = 'weighted' THEN score * coalesce(importance, 0.5) ELSE score END, 6) AS s, importance IS NOT NULL AS known
    FROM r LEFT JOIN imp USING (doc_id), pol WHERE policy = 'all' OR importance IS NOT NULL),
y AS (SELECT * FROM x WHERE s > 0 QUALIFY row_number() OVER (PARTITION BY policy, query_id ORDER BY s DESC, doc_id) <= 5)
SELECT policy, count(*) AS picked, count(*) FILTER (WHERE g.doc_id IS NOT NULL) AS useful, count(*) FILTER (WHERE g.doc_id IS NULL) AS noise FROM y LEFT JOIN gold g USING (query_id, doc_id) GROUP BY 1""")
def write_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """everything indexed, only labelled documents, or these weighted by importance; useful and noisy hits among five."""
    x = ops.ranked(best_by_importance(spark, sf_dir, 5))
    x = x.withColumn("policy", F.explode(F.array(*map(F.lit, ("all", "extracted", "weighted"))))).where("policy = 'all' OR importance IS NOT NULL")
    x = x.withColumn("s", F.round(F.when(F.col("policy") == "weighted", F.col("score") * F.col("importance")).otherwise(F.col("score")), 6)).where("s > 0")
    y = x.withColumn("r", F.row_number().over(Window.partitionBy("policy", "query_id").orderBy(F.desc("s"), "doc_id"))).where("r <= 5")
    y = y.join(gold(spark, sf_dir).withColumn("hit", F.lit(1)), ["query_id", "doc_id"], "left")
    return y.groupBy("policy").agg(F.count("*").alias("picked"), F.count("hit").alias("useful"), (F.count("*") - F.count("hit")).alias("noise"))


DOT = """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, x.vec_id, round(list_dot_product(q.v, x.v), 6) AS score FROM v q JOIN v x ON q.vec_id % 20 = 0 AND q.vec_id <> x.vec_id)"""


@book.query(f"{DOT} SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5")
def vec_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors by inner product."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    s = ops.dense(v, v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), C.top_k)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return s.withColumn("score", F.round("score", 6)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= C.top_k).select("query_id", "rank", "vec_id", "score")
