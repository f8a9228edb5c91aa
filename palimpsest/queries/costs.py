"""Simulated costs: cache layouts, summary policies, growth, debts and coverage over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..plans import cache
from .base import Book, table

book = Book()
QUERIES, ORACLES = book.queries, book.oracles
C = DEFAULT
TURNS, CHUNKS = 2000, (1, 10)


def values(rows) -> str:
    lit = lambda x: "NULL" if x is None else str(x).upper() if isinstance(x, bool) else f"'{x}'" if isinstance(x, str) else str(x)
    return "(VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + ")"


CACHE = f"""WITH b(layout, pos, name, tokens, change_every, scope, slides) AS (SELECT * FROM {values(cache.ROWS)}),
v AS (SELECT *, CASE WHEN slides THEN turn // chunk WHEN change_every IS NULL THEN 0 ELSE turn // change_every END AS version FROM b, range({TURNS}) t(turn), (VALUES {', '.join(f'({c})' for c in CHUNKS)}) c(chunk)),
l AS (SELECT *, turn % 50 = 0 OR version <> lag(version) OVER (PARTITION BY layout, chunk, pos ORDER BY turn) AS changed FROM v),
m AS (SELECT *, min(pos) FILTER (WHERE changed) OVER w AS broken, min(pos) FILTER (WHERE scope = 'chat') OVER w AS shared_end FROM l WINDOW w AS (PARTITION BY layout, chunk, turn)),
p AS (SELECT layout, chunk, turn, sum(tokens) AS whole, sum(CASE WHEN pos < coalesce(broken, 999) THEN tokens ELSE 0 END) AS own, sum(CASE WHEN pos < coalesce(shared_end, 999) THEN tokens ELSE 0 END) AS shared FROM m GROUP BY ALL),
u AS (SELECT *, CASE WHEN popular THEN greatest(own, shared) ELSE own END AS c FROM p, (VALUES (FALSE), (TRUE)) q(popular)),
sim AS (SELECT layout, chunk, popular, sum(c)::BIGINT AS cached, sum(whole - c)::BIGINT AS uncached FROM u GROUP BY ALL)"""
MONTH = C.turns_per_month / TURNS / 1e6


@book.query(f"{CACHE} SELECT layout, chunk, popular, cached, uncached, round(cached / (cached + uncached), 6)::DOUBLE AS hit, round((uncached * {C.price_in} + cached * {C.price_cached})::DOUBLE * {MONTH}::DOUBLE, 6)::DOUBLE AS input_cost, round({C.output_tokens * TURNS * C.price_out * MONTH}, 6)::DOUBLE AS output_cost FROM sim")
def cache_sim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached tokens and monthly cost of every layout, window step and popularity."""
    return cache.simulate(cache.layouts(spark), TURNS, CHUNKS)


# The load that the long-horizon figures assume.
PER_SESSION, PER_TURN, SESSION_DIGEST, LIFETIME_DIGEST, EVENTS, FACTS, IN_RATE, OUT_RATE = 50, 250, 300, 500, 4, 1, 0.375e-6, 1.875e-6
HORIZONS = (24, 100, 400, 1000)
POLICIES = {
    "P1_full_rewrite": (f"s * {PER_SESSION * PER_TURN}", f"{LIFETIME_DIGEST}"),
    "P2_incremental": (f"{LIFETIME_DIGEST + SESSION_DIGEST}", f"{LIFETIME_DIGEST}"),
    "P3_tiered": (f"CASE WHEN s % 20 = 0 THEN s * {PER_SESSION * PER_TURN} ELSE {LIFETIME_DIGEST + 5 * SESSION_DIGEST} END", f"{LIFETIME_DIGEST}"),
    "P4_all_digests": (f"s * {SESSION_DIGEST}", f"{LIFETIME_DIGEST}"),
}


@book.query(
    "WITH h AS (SELECT * FROM (VALUES " + ", ".join(f"({n})" for n in HORIZONS) + ") h(sessions)), x AS ("
    + " UNION ALL ".join(f"SELECT sessions, '{p}' AS policy, ({i})::BIGINT AS tin, ({o})::BIGINT AS tout FROM h, range(1, 1001) r(s) WHERE s <= sessions" for p, (i, o) in POLICIES.items())
    + f") SELECT sessions, policy, sum(tin)::BIGINT AS tokens_in, sum(tout)::BIGINT AS tokens_out, round(sum(tin)::DOUBLE * {IN_RATE!r}::DOUBLE + sum(tout)::DOUBLE * {OUT_RATE!r}::DOUBLE, 6)::DOUBLE AS usd FROM x GROUP BY ALL"
)
def summary_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What four ways of keeping a lifetime summary cost over a number of sessions."""
    h = spark.createDataFrame([(n,) for n in HORIZONS], "sessions long").select("sessions", F.explode(F.sequence(F.lit(1), F.col("sessions"))).alias("s"))
    each = F.explode(F.array(*(F.struct(F.lit(p).alias("policy"), F.expr(i).cast("long").alias("tin"), F.expr(o).cast("long").alias("tout")) for p, (i, o) in POLICIES.items())))
    x = h.select("sessions", each.alias("x")).select("sessions", "x.*").groupBy("sessions", "policy").agg(F.sum("tin").alias("tokens_in"), F.sum("tout").alias("tokens_out"))
    return x.withColumn("usd", F.round(F.col("tokens_in") * IN_RATE + F.col("tokens_out") * OUT_RATE, 6))


@book.query("SELECT sessions, sessions * 50 AS turns, sessions * 5 AS candidates, round(sessions * 50 * 210 / 1048576, 6)::DOUBLE AS megabytes, round(least(sessions * 5 * 0.65 * 0.01 / 5 * 100, 100), 6)::DOUBLE AS contamination FROM (VALUES " + ", ".join(f"({n}::BIGINT)" for n in HORIZONS) + ") h(sessions)")
def contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H4: growth of storage and candidates, and the share of the top five that unrelated items take."""
    s = F.col("sessions")
    return spark.createDataFrame([(n,) for n in HORIZONS], "sessions long").select(
        "sessions", (s * PER_SESSION).alias("turns"), (s * (EVENTS + FACTS)).alias("candidates"), F.round(s * PER_SESSION * 210 / 1048576, 6).alias("megabytes"),
        F.round(F.least(s * (EVENTS + FACTS) * 0.65 * 0.01 / 5 * 100, F.lit(100.0)), 6).alias("contamination"),
    )


# --- debts: the k-th event of a user is its k-th turn; every purchase sets up a debt ---------------------------------------------

B1, B2, B3 = (b * C.window_turns for b in C.backoff)
S = C.session_turns
DEBTS = f"""WITH e AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events),
n AS (SELECT user_id, max(seq) AS last FROM e GROUP BY 1), d AS (SELECT user_id, event_id, seq AS setup, CASE WHEN event_id % 2 = 0 THEN 'session_start' ELSE 'time' END AS kind, last FROM e JOIN n USING (user_id) WHERE event_type = 'purchase')"""


def next_due(after: str) -> str:
    """SQL, for both engines, of the first turn from ``after`` on at which a debt may be raised."""
    return f"CASE WHEN kind = 'time' THEN {after} ELSE CAST(ceil(({after} - 1) / {S}.0) AS BIGINT) * {S} + 1 END"


STEPS = [("a1", f"setup + {B1}"), ("a2", f"a1 + {B2}"), ("a3", f"a2 + {B3}"), ("expires", f"a3 + {B3}")]


def debts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every debt with the turns of its three attempts and of its expiry, as far as its user's turns reach."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts").withColumn("seq", F.row_number().over(w).cast("long"))
    last = e.groupBy("user_id").agg(F.max("seq").alias("last"))
    d = e.where("event_type = 'purchase'").join(last, "user_id").select("user_id", "event_id", F.col("seq").alias("setup"), F.when(F.col("event_id") % 2 == 0, "session_start").otherwise("time").alias("kind"), "last")
    for name, after in STEPS:
        d = d.withColumn(name, F.expr(next_due(after))).withColumn(name, F.when(F.col(name) <= F.col("last"), F.col(name)))
    return d


sql = DEBTS
for i, (name, after) in enumerate(STEPS):
    sql += f", s{i} AS (SELECT *, CASE WHEN x <= last THEN x END AS {name} FROM (SELECT *, {next_due(after)} AS x FROM {'d' if not i else f'(SELECT * EXCLUDE (x) FROM s{i - 1})'}))"
FOLDED = sql


@book.query(f"{FOLDED} SELECT event_id, user_id, kind, setup, a1, a2, a3, CASE WHEN expires IS NOT NULL THEN 'expired' ELSE 'open' END AS status FROM s3")
def debts_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When every debt is raised under back-off, and whether it expires. The fold over turns has a closed form, as the next
    attempt depends only on the last."""
    return debts(spark, sf_dir).select("event_id", "user_id", "kind", "setup", "a1", "a2", "a3", F.when(F.col("expires").isNotNull(), "expired").otherwise("open").alias("status"))


@book.query(f"{FOLDED} SELECT kind, count(*) AS debts, sum((last - setup) // CASE WHEN kind = 'time' THEN {B1} ELSE {S} END)::BIGINT AS without_backoff, sum((a1 IS NOT NULL)::INT + (a2 IS NOT NULL)::INT + (a3 IS NOT NULL)::INT)::BIGINT AS with_backoff FROM s3 GROUP BY 1")
def debt_trigger_sim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H6: how often debts fire without and with back-off."""
    every = F.floor((F.col("last") - F.col("setup")) / F.when(F.col("kind") == "time", B1).otherwise(S))
    fired = sum(F.col(a).isNotNull().cast("long") for a in ("a1", "a2", "a3"))
    return debts(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("debts"), F.sum(every).alias("without_backoff"), F.sum(fired).alias("with_backoff"))


# Which days are kept at which detail.
COVERAGE = [(1, 10, "digest"), (11, 20, "event"), (21, 24, "raw")]
MODES = {"raw": "exact", "event": "by_event", "digest": "vague", "lost": "unknown"}


@book.query(f"""WITH e AS (SELECT event_id, day(ts)::INTEGER AS session FROM events), c(lo, hi, resolution) AS (SELECT * FROM {values(COVERAGE)}), m(resolution, mode) AS (SELECT * FROM {values(MODES.items())})
SELECT session, mode, count(*) AS items FROM (SELECT session, coalesce(resolution, 'lost') AS resolution FROM e LEFT JOIN c ON session BETWEEN lo AND hi) JOIN m USING (resolution) GROUP BY ALL""")
def coverage_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range join of sessions with the coverage plan decides how exactly an item may be recalled."""
    e = table(spark, sf_dir, "events").select("event_id", F.dayofmonth("ts").alias("session"))
    plan = F.broadcast(spark.createDataFrame(COVERAGE, "lo int, hi int, resolution string"))  # three rows
    found = e.join(plan, F.col("session").between(F.col("lo"), F.col("hi")), "left").withColumn("resolution", F.coalesce("resolution", F.lit("lost")))
    mode = F.create_map(*(F.lit(x) for kv in MODES.items() for x in kv))[F.col("resolution")]
    return found.groupBy("session", mode.alias("mode")).agg(F.count("*").alias("items"))
