"""Selection policies, depth of reference, parameter sweeps and what is chosen from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import text as T
from ..operators import retrieval as ops
from .base import Book, saved, table
from .retrieval import BM25, best_by_importance, corpus, gold, indexed

book = Book()
QUERIES, ORACLES = book.queries, book.oracles
C = DEFAULT
LAST_N, TAU, THETA = 15, C.importance_gate, 0.15
D = 'coalesce(text, \'\')'
TOK = f"greatest(1, floor(length({D}) * 1.5))::BIGINT"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, its tokens, its place from the end, and its place by a hash of its id."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", T.tokens(F.col("text")).alias("tokens"))
    everything = Window.orderBy(F.desc("doc_id"))
    last = d.orderBy(F.desc("doc_id")).limit(LAST_N).withColumn("back", F.row_number().over(everything)).select("doc_id", "back")
    some = d.select("doc_id", F.md5(F.col("doc_id").cast("string").cast("binary")).alias("h")).orderBy("h", "doc_id").limit(C.top_k).select("doc_id", F.lit(True).alias("random"))
    return d.join(last, "doc_id", "left").join(some, "doc_id", "left")


def arms(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(arm, query_id, doc_id) picks of the seven policies that pick documents one by one, and the gold pairs; what is picked twice stays twice."""
    docs, g = documents(spark, sf_dir), saved(gold(spark, sf_dir), "gold")
    probes = g.select("query_id").distinct()
    scored = saved(best_by_importance(spark, sf_dir, C.top_k, probes=probes), "scores")
    ranked = ops.ranked(scored)
    known = scored.where("importance IS NOT NULL")
    labelled = ops.ranked(known)
    rel = ops.normalised(known).withColumn("relevance", F.round("relevance", 6))
    w = Window.partitionBy("query_id").orderBy(F.desc("s"), "doc_id")
    kept = rel.where((F.col("importance") >= TAU) & (F.col("relevance") >= THETA)).withColumn("s", F.round(C.relevance_weight * F.col("relevance") + C.importance_weight * F.col("importance"), 6))
    kept = kept.withColumn("r", F.row_number().over(w)).where(F.col("r") <= C.top_k)
    window = lambda n: probes.join(docs.where(F.col("back") <= n).select("doc_id"))  # n rows of documents
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id").distinct().orderBy("doc_id").limit(6)
    parts = {
        "oracle": [g], "window": [window(LAST_N)], "random": [probes.join(docs.where("random").select("doc_id"))], "window_summary": [window(LAST_N), probes.join(good)],
        "extracted": [labelled.where(F.col("rank") <= C.top_k)], "window_rag": [window(10), ranked.where(F.col("rank") <= C.top_k)], "proposed": [kept, window(10)],
    }
    out = None
    for arm, picks in parts.items():
        for p in picks:
            p = p.select(F.lit(arm).alias("arm"), "query_id", "doc_id")
            out = p if out is None else out.unionByName(p)
    return out, g


ARMS = f"""{BM25}, dt AS (SELECT doc_id, {TOK} AS tokens, row_number() OVER (ORDER BY doc_id DESC) AS back, row_number() OVER (ORDER BY md5(doc_id::VARCHAR), doc_id) AS shuffled FROM documents),
pr AS (SELECT DISTINCT query_id FROM gold), ex AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 6) DESC, doc_id) AS rank FROM s JOIN imp USING (doc_id) WHERE round(raw, 6) > 0),
nl AS (SELECT query_id, doc_id, importance, round(raw / max(raw) OVER (PARTITION BY query_id), 6) AS rel FROM s JOIN imp USING (doc_id)),
kp AS (SELECT query_id, doc_id FROM nl WHERE importance >= {TAU} AND rel >= {THETA} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round({C.relevance_weight}::DOUBLE * rel + {C.importance_weight}::DOUBLE * importance, 6) DESC, doc_id) <= {C.top_k}),
gd6 AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 ORDER BY doc_id LIMIT 6),
picks AS (SELECT 'oracle' AS arm, query_id, doc_id FROM gold UNION ALL SELECT 'window', query_id, doc_id FROM pr, dt WHERE back <= {LAST_N} UNION ALL SELECT 'random', query_id, doc_id FROM pr, dt WHERE shuffled <= {C.top_k}
    UNION ALL SELECT 'window_summary', query_id, doc_id FROM pr, dt WHERE back <= {LAST_N} UNION ALL SELECT 'window_summary', query_id, doc_id FROM pr, gd6
    UNION ALL SELECT 'extracted', query_id, doc_id FROM ex JOIN pr USING (query_id) WHERE rank <= {C.top_k}
    UNION ALL SELECT 'window_rag', query_id, doc_id FROM pr, dt WHERE back <= 10 UNION ALL SELECT 'window_rag', query_id, doc_id FROM r JOIN pr USING (query_id) WHERE rank <= {C.top_k}
    UNION ALL SELECT 'proposed', query_id, doc_id FROM kp JOIN pr USING (query_id) UNION ALL SELECT 'proposed', query_id, doc_id FROM pr, dt WHERE back <= 10)"""


@book.query(f"""{ARMS}, m AS (SELECT arm, query_id, count(*) AS picked, count(*) FILTER (WHERE g.doc_id IS NOT NULL) AS hits, sum(tokens) AS tokens FROM picks JOIN dt USING (doc_id) LEFT JOIN gold g USING (query_id, doc_id) GROUP BY ALL)
SELECT arm, count(*) AS probes, round(avg((hits > 0)::INT), 6)::DOUBLE AS recall, round(sum(hits) / sum(greatest(picked, 1)), 6)::DOUBLE AS precision, round(avg(tokens), 4)::DOUBLE AS tokens, avg(tokens) + {C.fixed_blocks} <= {C.budget} AS within_budget FROM m GROUP BY 1""")
def arm_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall, precision, tokens and budget of the selection policies."""
    picks, g = arms(spark, sf_dir)
    picks = picks.join(documents(spark, sf_dir).select("doc_id", "tokens"), "doc_id").join(g.withColumn("hit", F.lit(1)), ["query_id", "doc_id"], "left")
    m = picks.groupBy("arm", "query_id").agg(F.count("*").alias("picked"), F.count("hit").alias("hits"), F.sum("tokens").alias("tokens"))
    return m.groupBy("arm").agg(
        F.count("*").alias("probes"), F.round(F.avg((F.col("hits") > 0).cast("int")), 6).alias("recall"), F.round(F.sum("hits") / F.sum(F.greatest("picked", F.lit(1))), 6).alias("precision"),
        F.round(F.avg("tokens"), 4).alias("tokens"), (F.avg("tokens") + C.fixed_blocks <= C.budget).alias("within_budget"),
    )


#: Neighbouring documents that are one session, and sessions that a probe brings back.
SITTING, SESSIONS = 10, 3


@book.query(f"""{BM25}, dt AS (SELECT doc_id, doc_id // {SITTING} AS session, {TOK} AS tokens FROM documents), pr AS (SELECT DISTINCT query_id FROM gold),
sp AS (SELECT doc_id // {SITTING} AS session, term, sum(tf) AS tf FROM p GROUP BY ALL), sl AS (SELECT session, sum(tf) AS dl FROM sp GROUP BY 1), sf AS (SELECT term, count(*) AS df FROM sp GROUP BY 1),
sz AS (SELECT (SELECT count(DISTINCT session) FROM dt)::DOUBLE AS n, (SELECT sum(dl) FROM sl) / (SELECT count(DISTINCT session) FROM dt)::DOUBLE AS avgdl),
ss AS (SELECT query_id, session, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {C.bm25_k1 + 1} / (tf + {C.bm25_k1} * (1 - {C.bm25_b} + {C.bm25_b} * dl / avgdl)))::DOUBLE, 6) AS score
    FROM pr JOIN q USING (query_id) JOIN sp USING (term) JOIN sf USING (term) JOIN sl USING (session), sz GROUP BY ALL),
sr AS (SELECT query_id, session FROM ss WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, session) <= {SESSIONS}),
picks AS (SELECT 'session_rag' AS arm, query_id, doc_id, tokens FROM sr JOIN dt USING (session) UNION ALL SELECT 'full', query_id, doc_id, tokens FROM pr, dt),
m AS (SELECT arm, query_id, count(*) AS picked, count(*) FILTER (WHERE g.doc_id IS NOT NULL) AS hits, sum(tokens) AS tokens FROM picks LEFT JOIN gold g USING (query_id, doc_id) GROUP BY ALL)
SELECT arm, count(*) AS probes, round(avg((hits > 0)::INT), 6)::DOUBLE AS recall, round(sum(hits) / sum(picked), 6)::DOUBLE AS precision, round(avg(tokens), 4)::DOUBLE AS tokens, avg(tokens) + {C.fixed_blocks} <= {C.budget} AS within_budget FROM m GROUP BY 1""")
def arm_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the arms that take everything, and whole sessions by BM25; a session's postings are the sums of its documents', and it hits by a member.

    What the full arm takes is the same for every probe, so it is summed once and no probe meets a document."""
    session = F.floor(F.col("doc_id") / SITTING).alias("session")
    index, asked = indexed(spark, sf_dir)
    g = saved(gold(spark, sf_dir), "gold").distinct()
    sizes = table(spark, sf_dir, "documents").select("doc_id", session, T.tokens(F.col("text")).alias("tokens"))
    probes = g.groupBy("query_id").agg(F.count("*").alias("hits"))
    whole = sizes.agg(F.count("*").alias("picked"), F.sum("tokens").alias("tokens"))  # one row
    full = probes.crossJoin(whole).select(F.lit("full").alias("arm"), "picked", "hits", "tokens")
    sessions = saved(ops.merged(index, session, "session").withColumn("n", F.lit(1).cast("long")), "sessions")
    best = ops.ranked(ops.contenders(sessions, asked.join(probes, "query_id", "left_semi"), SESSIONS, config=C, key="session"), SESSIONS, key="session").select("query_id", "session")
    of_session = sizes.groupBy("session").agg(F.count("*").alias("picked"), F.sum("tokens").alias("tokens"))
    found = g.groupBy("query_id", session).agg(F.count("*").alias("hits"))
    picked = best.join(of_session, "session").join(found, ["query_id", "session"], "left").groupBy("query_id").agg(F.sum("picked").alias("picked"), F.sum(F.coalesce("hits", F.lit(0))).alias("hits"), F.sum("tokens").alias("tokens"))
    m = full.unionByName(picked.select(F.lit("session_rag").alias("arm"), "picked", "hits", "tokens"))
    return m.groupBy("arm").agg(
        F.count("*").alias("probes"), F.round(F.avg((F.col("hits") > 0).cast("int")), 6).alias("recall"), F.round(F.sum("hits") / F.sum("picked"), 6).alias("precision"),
        F.round(F.avg("tokens"), 4).alias("tokens"), (F.avg("tokens") + C.fixed_blocks <= C.budget).alias("within_budget"),
    )


@book.query("SELECT conv_id, count(*) AS members, sum(length(text))::BIGINT AS chars, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY 1")
def session_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the turns of a session put together in order, as one text to retrieve; a digest stands for it. A session is one conversation."""
    t = table(spark, sf_dir, "conversations")
    line = F.struct("turn", F.concat_ws(": ", "role", "text").alias("line"))
    g = t.groupBy("conv_id").agg(F.count("*").alias("members"), F.sum(F.length("text")).alias("chars"), F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["line"]), "\n").alias("chunk"))
    return g.select("conv_id", "members", "chars", F.md5(F.col("chunk").cast("binary")).alias("digest"))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, gold, depth, weight, upto): every probe asked so many documents after its evidence; probes past the end drop out."""
    n = table(spark, sf_dir, "documents").agg(F.max("doc_id").alias("last"))
    each = F.explode(F.array(*(F.struct(F.lit(d).alias("depth"), F.lit(w).alias("weight")) for d, w in C.depths)))
    g = gold(spark, sf_dir).groupBy("query_id").agg(F.min("doc_id").alias("gold")).select("query_id", "gold", each.alias("x")).select("query_id", "gold", "x.depth", "x.weight", (F.col("gold") + F.col("x.depth")).alias("upto"))
    return g.join(n).where("upto <= last").drop("last")  # one row


SNAP = f"""{ARMS}, sn AS (SELECT query_id, gold, d.depth, d.weight, gold + d.depth AS upto FROM (SELECT query_id, min(doc_id) AS gold FROM gold GROUP BY 1), (VALUES {', '.join(f'({d}, {w}::DOUBLE)' for d, w in C.depths)}) d(depth, weight)
    WHERE gold + d.depth <= (SELECT max(doc_id) FROM documents)),
cum AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n, sum(coalesce(dl, 0)) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS terms FROM documents LEFT JOIN l USING (doc_id)),
hit AS (SELECT query_id, depth, gold, upto, term, qtf, doc_id, tf, count(*) OVER (PARTITION BY query_id, depth, term) AS df FROM sn JOIN q USING (query_id) JOIN p USING (term) WHERE doc_id <= upto),
vs AS (SELECT query_id, depth, gold, h.doc_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {C.bm25_k1 + 1} / (tf + {C.bm25_k1} * (1 - {C.bm25_b} + {C.bm25_b} * dl / (terms / n)))), 6)::DOUBLE AS score
    FROM hit h JOIN l ON l.doc_id = h.doc_id JOIN cum c ON c.doc_id = h.upto GROUP BY ALL),
vr AS (SELECT *, row_number() OVER (PARTITION BY query_id, depth ORDER BY score DESC, doc_id) AS rank FROM vs),
rec AS (SELECT depth, weight, arm, avg(hit) AS recall FROM (SELECT sn.depth, sn.weight, a.arm, CASE a.arm WHEN 'oracle' THEN 1 WHEN 'window' THEN (sn.depth < {LAST_N})::INT WHEN 'rag' THEN (coalesce(rank, 99999) <= {C.top_k})::INT
    ELSE (sn.depth < 10 OR coalesce(rank, 99999) <= {C.top_k})::INT END AS hit FROM sn LEFT JOIN vr ON vr.query_id = sn.query_id AND vr.depth = sn.depth AND vr.doc_id = sn.gold, (VALUES ('oracle'), ('window'), ('rag'), ('window_rag')) a(arm)) GROUP BY ALL)"""


#: Neighbouring doc_ids that are summed together.
BLOCK = 10_000


def sizes_upto(seen: DataFrame, points: DataFrame) -> DataFrame:
    """(upto, n, terms): how many documents of ``seen(doc_id, dl)`` come up to each of ``points(upto)``, and their terms.

    Sums of blocks of ids are added up (one row a block meets in one task); within its own block a point meets the documents one by one."""
    block = lambda c: F.floor(F.col(c) / BLOCK)
    seen = seen.withColumn("block", block("doc_id"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    both = seen.groupBy("block").agg(F.count("*").alias("n"), F.sum("dl").alias("terms")).unionByName(points.select(block("upto").alias("block"), F.lit(0).alias("n"), F.lit(0).alias("terms")))
    blocks = both.groupBy("block").agg(F.sum("n").alias("n"), F.sum("terms").alias("terms"))
    blocks = blocks.select("block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("terms").over(before), F.lit(0)).alias("terms0"))
    own = points.withColumn("block", block("upto")).join(blocks, "block").join(seen, "block", "left")
    inside = F.col("doc_id") <= F.col("upto")
    sums = own.groupBy("upto", "n0", "terms0").agg(F.count_if(inside).alias("n"), F.sum(F.when(inside, F.col("dl")).otherwise(0)).alias("terms"))
    return sums.select("upto", (F.col("n0") + F.col("n")).alias("n"), (F.col("terms0") + F.col("terms")).alias("terms"))


def depth_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(arm, depth, weight, recall): each probe sees only the documents up to its own time; frequencies and lengths are those of what it sees."""
    index, asked, docs = corpus(spark, sf_dir)
    snaps = snapshots(spark, sf_dir)
    sizes = sizes_upto(docs, snaps.select("upto").distinct())
    hits = snaps.join(asked, "query_id").join(index, "term").where("doc_id <= upto")
    df = hits.groupBy("query_id", "depth", "term").agg(F.count("*").alias("df"))
    rows = hits.join(df, ["query_id", "depth", "term"]).join(sizes, "upto")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    k1, b = C.bm25_k1, C.bm25_b
    part = F.col("qtf") * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / (F.col("terms") / F.col("n"))))
    scored = rows.groupBy("query_id", "depth", "gold", "doc_id").agg(F.round(F.sum(part), 6).alias("score"))
    w = Window.partitionBy("query_id", "depth").orderBy(F.desc("score"), "doc_id")
    best = scored.withColumn("rank", F.row_number().over(w)).where("doc_id = gold").select("query_id", "depth", "rank")
    found = snaps.join(best, ["query_id", "depth"], "left").withColumn("in_rag", F.coalesce(F.col("rank") <= C.top_k, F.lit(False)))
    hit = {"oracle": F.lit(True), "window": F.col("depth") < LAST_N, "rag": F.col("in_rag"), "window_rag": (F.col("depth") < 10) | F.col("in_rag")}
    each = F.explode(F.array(*(F.struct(F.lit(a).alias("arm"), c.cast("int").alias("hit")) for a, c in hit.items())))
    return found.select("depth", "weight", each.alias("x")).groupBy("depth", "weight", F.col("x.arm").alias("arm")).agg(F.avg("x.hit").alias("recall"))


@book.query(f"{SNAP} SELECT arm, round(sum(weight * recall), 6)::DOUBLE AS weighted_recall FROM rec GROUP BY 1")
def depth_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall weighted by how far back questions reach."""
    return depth_recall(spark, sf_dir).groupBy("arm").agg(F.round(F.sum(F.col("weight") * F.col("recall")), 6).alias("weighted_recall"))


#: Shares of shallow, middle and deep references that are assumed.
DISTRIBUTIONS = {"extreme": (0.95, 0.04, 0.01), "recent": (0.90, 0.08, 0.02), "guess": (0.75, 0.20, 0.05), "middle": (0.60, 0.25, 0.15), "deep": (0.50, 0.30, 0.20), "deepest": (0.35, 0.35, 0.30)}
DIST_ROWS = [(name, depth, share) for name, shares in DISTRIBUTIONS.items() for (depth, _), share in zip(C.depths, shares)]


@book.query(f"""{SNAP}, ds(dist, depth, share) AS (VALUES {', '.join(f"('{a}', {b}, {c}::DOUBLE)" for a, b, c in DIST_ROWS)}),
gn AS (SELECT dist, round(sum(share * recall) FILTER (WHERE arm = 'window_rag') - sum(share * recall) FILTER (WHERE arm = 'window'), 6)::DOUBLE AS gain FROM rec JOIN ds USING (depth) GROUP BY 1)
SELECT dist, gain, CASE WHEN gain < 0.10 THEN 'weak' WHEN gain < 0.25 THEN 'unclear' ELSE 'needed' END AS verdict FROM gn""")
def sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H5: what retrieval gains over a window alone under several assumptions; recall is computed once and reused."""
    ds = spark.createDataFrame(DIST_ROWS, "dist string, depth int, share double")
    x = depth_recall(spark, sf_dir).join(ds, "depth")
    of = lambda arm: F.sum(F.when(F.col("arm") == arm, F.col("share") * F.col("recall")))
    gain = x.groupBy("dist").agg(F.round(of("window_rag") - of("window"), 6).alias("gain"))
    return gain.withColumn("verdict", F.when(F.col("gain") < 0.10, "weak").when(F.col("gain") < 0.25, "unclear").otherwise("needed"))


TAUS, KS, THETAS = (0.0, 0.2, 0.4, 0.6), (1, 3, 5, 10), (0.0, 0.15, 0.4, 0.7)
GRID = [(t, k, h) for t in TAUS for k in KS for h in THETAS]


def swept(spark: SparkSession, sf_dir: str, probes: DataFrame | None = None) -> DataFrame:
    """(tau, k, theta, hits, noise, tokens) of the retriever over a grid of parameters, in one plan. ``probes`` are the gold pairs, if they are known."""
    probes = saved(gold(spark, sf_dir), "gold") if probes is None else probes
    rel = ops.normalised(best_by_importance(spark, sf_dir, max(KS), labelled=True, probes=probes)).withColumn("relevance", F.round("relevance", 6))
    rel = rel.withColumn("s", F.round(C.relevance_weight * F.col("relevance") + C.importance_weight * F.col("importance"), 6))
    rel = rel.join(probes.withColumn("hit", F.lit(1)), ["query_id", "doc_id"], "left").join(table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text")).alias("tokens")), "doc_id")
    cuts = F.array(*(F.struct(F.lit(t).alias("tau"), F.lit(h).alias("theta")) for t in TAUS for h in THETAS))
    kept = rel.withColumn("c", F.explode(cuts)).select("*", "c.tau", "c.theta").where((F.col("importance") >= F.col("tau")) & (F.col("relevance") >= F.col("theta")))
    w = Window.partitionBy("tau", "theta", "query_id").orderBy(F.desc("s"), "doc_id")
    top = kept.withColumn("r", F.row_number().over(w)).where(F.col("r") <= max(KS)).withColumn("k", F.explode(F.array(*map(F.lit, KS)))).where(F.col("r") <= F.col("k"))
    per = top.groupBy("tau", "k", "theta", "query_id").agg(F.count("hit").alias("h"), F.count("*").alias("n"), F.sum("tokens").alias("tokens"))
    made = per.groupBy("tau", "k", "theta").agg(F.sum((F.col("h") > 0).cast("long")).alias("hits"), F.sum(F.col("n") - F.col("h")).alias("noise"), F.sum("tokens").alias("tokens"))
    grid = spark.createDataFrame(GRID, "tau double, k int, theta double")
    return grid.join(made, ["tau", "k", "theta"], "left").fillna(0)


SWEEP = f"""{ARMS}, gr(tau, k, theta) AS (VALUES {', '.join(f'({t}::DOUBLE, {k}, {h}::DOUBLE)' for t, k, h in GRID)}), ct AS (SELECT DISTINCT tau, theta FROM gr),
ky AS (SELECT tau, theta, nl.query_id, nl.doc_id, row_number() OVER (PARTITION BY tau, theta, nl.query_id ORDER BY round({C.relevance_weight}::DOUBLE * rel + {C.importance_weight}::DOUBLE * importance, 6) DESC, nl.doc_id) AS r
    FROM nl JOIN pr USING (query_id), ct WHERE importance >= tau AND rel >= theta),
pq AS (SELECT tau, k, theta, ky.query_id, count(g.doc_id) AS h, count(*) AS n, sum(tokens) AS tokens FROM ky JOIN gr USING (tau, theta) JOIN dt USING (doc_id) LEFT JOIN gold g ON g.query_id = ky.query_id AND g.doc_id = ky.doc_id WHERE r <= k GROUP BY ALL),
sw AS (SELECT gr.tau, gr.k, gr.theta, coalesce(sum((h > 0)::INT), 0)::BIGINT AS hits, coalesce(sum(n - h), 0)::BIGINT AS noise, coalesce(sum(tokens), 0)::BIGINT AS tokens FROM gr LEFT JOIN pq USING (tau, k, theta) GROUP BY ALL)"""


@book.query(f"{SWEEP} SELECT * FROM sw")
def param_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid of gates, cuts and sizes."""
    return swept(spark, sf_dir)


@book.query(f"""{SWEEP}, o AS (SELECT k, theta, noise - lag(noise) OVER w AS more_noise, hits - lag(hits) OVER w AS more_hits FROM sw WHERE tau = {TAU} WINDOW w AS (PARTITION BY theta ORDER BY k))
SELECT theta, k, more_hits, more_noise, round(more_noise / more_hits, 6)::DOUBLE AS noise_per_hit, more_noise / more_hits > 50 AS past_knee FROM o WHERE more_hits > 0""")
def knee(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The noise that each further hit costs as k grows."""
    w = Window.partitionBy("theta").orderBy("k")
    o = swept(spark, sf_dir).where(F.col("tau") == TAU).select("theta", "k", (F.col("noise") - F.lag("noise").over(w)).alias("more_noise"), (F.col("hits") - F.lag("hits").over(w)).alias("more_hits")).where("more_hits > 0")
    cost = F.col("more_noise") / F.col("more_hits")
    return o.select("theta", "k", "more_hits", "more_noise", F.round(cost, 6).alias("noise_per_hit"), (cost > 50).alias("past_knee"))


@book.query(f"{SWEEP}, a AS (SELECT *, hits / (SELECT count(*) FROM pr) AS recall FROM sw), b AS (SELECT * FROM a WHERE recall >= (SELECT max(recall) FROM a) - 0.005) SELECT tau, k, theta, hits, noise FROM b ORDER BY noise, tokens, tau, k, theta LIMIT 1")
def pareto_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the settings within half a point of the best recall, the one with the least noise."""
    probes = saved(gold(spark, sf_dir), "gold")
    n = probes.agg(F.count_distinct("query_id").alias("n"))
    a = swept(spark, sf_dir, probes).join(n).withColumn("recall", F.col("hits") / F.col("n"))  # one row
    top = a.withColumn("top", F.max("recall").over(Window.partitionBy(F.lit(0))))  # one row a setting
    return top.where("recall >= top - 0.005").orderBy("noise", "tokens", "tau", "k", "theta").limit(1).select("tau", "k", "theta", "hits", "noise")
