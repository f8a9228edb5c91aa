"""Fact store over ``events``: a user is a subject, an event type a predicate, a band of values an object."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..operators import facts as ops
from .base import Book, table

book = Book()
QUERIES, ORACLES = book.queries, book.oracles
C = DEFAULT
ONE = ", ".join(f"'{p}'" for p in C.pack.cardinality_one)
#: The time of the as-of view.
WHEN = "2024-01-15 00:00:00"


def statements(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("user_id").alias("subject"), F.col("event_type").alias("predicate"), F.floor(F.col("value") / 25).cast("string").alias("object"),
        (F.regexp_extract("props", "[0-9]+", 0).cast("double") / 100).alias("confidence"), "ts", F.col("event_id").alias("id"),
    )


def acted(spark: SparkSession, sf_dir: str, predicates: tuple[str, ...] | None = None) -> DataFrame:
    said = statements(table(spark, sf_dir, "events"))
    return ops.actions(said.where(F.col("predicate").isin(*predicates)) if predicates else said, C)


def stored(spark: SparkSession, sf_dir: str, predicates: tuple[str, ...] | None = None) -> DataFrame:
    """All facts, or those of some predicates; a predicate is part of a fact's key, so no other statement bears on them."""
    return ops.history(acted(spark, sf_dir, predicates), C)


TOL = f"CASE WHEN predicate = 'view' THEN {C.tolerance['high']} WHEN predicate = 'signup' THEN {C.tolerance['low']} ELSE {C.tolerance['mid']} END::DOUBLE"

ACTED = f"""WITH RECURSIVE s AS (SELECT user_id AS subject, event_type AS predicate, floor(value / 25)::BIGINT::VARCHAR AS object,
    regexp_extract(props, '[0-9]+')::DOUBLE / 100 AS confidence, ts, event_id AS id,
    row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events),
o AS (SELECT * FROM s WHERE predicate IN ({ONE})),
f AS (SELECT *, object AS live, confidence AS conf, 'created' AS action FROM o WHERE rn = 1
    UNION ALL SELECT n.*, CASE WHEN n.object <> f.live AND NOT n.confidence < f.conf - ({TOL.replace('predicate', 'n.predicate')}) THEN n.object ELSE f.live END,
    CASE WHEN n.object = f.live THEN least(1.0::DOUBLE, f.conf + {C.reinforce}::DOUBLE) WHEN n.confidence < f.conf - ({TOL.replace('predicate', 'n.predicate')}) THEN f.conf ELSE n.confidence END,
    CASE WHEN n.object = f.live THEN 'reinforced' WHEN n.confidence < f.conf - ({TOL.replace('predicate', 'n.predicate')}) THEN 'held' ELSE 'superseded' END
    FROM f JOIN o n ON n.subject = f.subject AND n.predicate = f.predicate AND n.rn = f.rn + 1),
m AS (SELECT *, coalesce(max((rn = 1 OR confidence >= {C.confidence_floor})::INT) OVER (PARTITION BY subject, predicate, object ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM s WHERE predicate NOT IN ({ONE})),
acted AS (SELECT subject, predicate, object, confidence, ts, id, action FROM f UNION ALL
    SELECT subject, predicate, object, confidence, ts, id, CASE WHEN before = 1 THEN 'reinforced' WHEN rn = 1 THEN 'created' WHEN confidence >= {C.confidence_floor} THEN 'coexist' ELSE 'held' END FROM m)"""

STORED = f"""{ACTED},
r AS (SELECT *, CASE WHEN predicate IN ({ONE}) THEN '' ELSE object END AS slot, action IN ('created', 'coexist', 'superseded') AS ins FROM acted WHERE action <> 'held'),
g AS (SELECT *, last_value(CASE WHEN ins THEN id END IGNORE NULLS) OVER (PARTITION BY subject, predicate, slot ORDER BY ts, id) AS fact_id FROM r),
h AS (SELECT subject, predicate, slot, fact_id, max(CASE WHEN ins THEN object END) AS object, max(CASE WHEN ins THEN ts END) AS valid_from,
    max(CASE WHEN ins THEN confidence END) AS stated, count(*) AS mention_count FROM g GROUP BY ALL),
stored AS (SELECT fact_id, subject, predicate, object, valid_from, lead(valid_from) OVER w AS valid_until, lead(fact_id) OVER w AS superseded_by, mention_count,
    round(least(1.0, stated + {C.reinforce} * (mention_count - 1)), 6)::DOUBLE AS confidence FROM h WINDOW w AS (PARTITION BY subject, predicate, slot ORDER BY valid_from, fact_id))"""


@book.query(f"{ACTED} SELECT id, subject, predicate, object, action FROM acted")
def fact_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outcome of every statement."""
    return acted(spark, sf_dir).select("id", "subject", "predicate", "object", "action")


@book.query(f"{ACTED} SELECT predicate, action, count(*) AS n FROM acted GROUP BY ALL")
def fact_action_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A histogram of outcomes."""
    return acted(spark, sf_dir).groupBy("predicate", "action").agg(F.count("*").alias("n"))


@book.query(f"{STORED} SELECT fact_id, subject, predicate, object, valid_from, valid_until, superseded_by, mention_count, confidence FROM stored")
def fact_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored facts with their validity."""
    return stored(spark, sf_dir)


@book.query(f"{STORED} SELECT subject, predicate, object, confidence FROM stored WHERE valid_until IS NULL AND predicate IN ('purchase', 'signup', 'click')")
def fact_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live facts of the standing predicates."""
    return ops.current(stored(spark, sf_dir), C.pack.standing).select("subject", "predicate", "object", "confidence")


@book.query(f"{STORED} SELECT subject, predicate, object, valid_from FROM stored WHERE valid_from <= TIMESTAMP '{WHEN}' AND (valid_until IS NULL OR valid_until > TIMESTAMP '{WHEN}')")
def fact_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts valid at one time, half-open."""
    return ops.valid_at(stored(spark, sf_dir), F.lit(WHEN).cast("timestamp_ntz")).select("subject", "predicate", "object", "valid_from")


@book.query(f"{STORED}, p AS (SELECT user_id AS subject, max(ts) - INTERVAL 1 DAY AS probe FROM events GROUP BY 1) SELECT subject, count(*) AS live_then FROM p JOIN stored USING (subject) WHERE valid_from <= probe AND (valid_until IS NULL OR valid_until > probe) GROUP BY 1")
def fact_asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C10 for many times: what held for each subject a day before its last event."""
    probes = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("subject")).agg((F.max("ts") - F.expr("INTERVAL 1 DAY")).alias("at"))
    return ops.as_of(stored(spark, sf_dir), probes).groupBy("subject").agg(F.count("*").alias("live_then"))


@book.query(f"{STORED} SELECT a.fact_id AS old_id, b.fact_id AS new_id, a.subject, a.predicate, a.object AS old_object, b.object AS new_object FROM stored a JOIN stored b ON a.superseded_by = b.fact_id")
def supersession_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The self join along supersession."""
    return ops.supersessions(stored(spark, sf_dir))


def derivations(documents: DataFrame) -> DataFrame:
    """Every ten neighbouring documents have a digest, and every source has one."""
    each = [F.struct(F.lit("digest").alias("k"), F.concat(F.lit("d"), F.floor(F.col("doc_id") / 10).cast("string")).alias("v")), F.struct(F.lit("source").alias("k"), F.col("source").alias("v"))]
    return documents.select(F.lit("doc").alias("source_kind"), F.col("doc_id").alias("source_id"), F.explode(F.array(*each)).alias("d")).select("source_kind", "source_id", F.col("d.k").alias("derived_kind"), F.col("d.v").alias("derived_key"))


DERIVED = """WITH d AS (SELECT doc_id, 'digest' AS derived_kind, 'd' || (doc_id // 10)::VARCHAR AS derived_key FROM documents UNION ALL SELECT doc_id, 'source', source FROM documents),
stale AS (SELECT derived_kind, derived_key, count(DISTINCT doc_id) AS causes FROM d JOIN labels USING (doc_id) WHERE toxic = 1 GROUP BY ALL)"""


def stale(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    links = derivations(table(spark, sf_dir, "documents"))
    deleted = table(spark, sf_dir, "labels").where("toxic = 1").select(F.lit("doc").alias("source_kind"), F.col("doc_id").alias("source_id")).distinct()
    return links, ops.stale_from(deleted, links)


@book.query(f"{DERIVED} SELECT * FROM stale")
def deletion_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxic documents are deleted; what was derived from them goes stale."""
    return stale(spark, sf_dir)[1]


@book.query(f"{DERIVED} SELECT DISTINCT derived_kind, derived_key FROM d WHERE (derived_kind, derived_key) NOT IN (SELECT derived_kind, derived_key FROM stale)")
def stale_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived things that may still be served."""
    links, gone = stale(spark, sf_dir)
    return ops.without_stale(links.select("derived_kind", "derived_key").distinct(), gone)


@book.query(f"""{DERIVED.split("stale AS")[0].rstrip().rstrip(',')}, e AS (SELECT * FROM d UNION ALL SELECT doc_id, 'event', 'e' || doc_id FROM documents)
SELECT derived_kind, derived_key, count(DISTINCT doc_id) AS causes, CASE WHEN derived_kind = 'event' THEN 'deleted' ELSE 'stale' END AS action FROM e JOIN labels USING (doc_id) WHERE quality = 0 GROUP BY ALL""")
def derived_invalidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of poor quality are updated; events copied from them are deleted at once, digests of them go stale."""
    documents = table(spark, sf_dir, "documents")
    events = documents.select(F.lit("doc").alias("source_kind"), F.col("doc_id").alias("source_id"), F.lit("event").alias("derived_kind"), F.concat(F.lit("e"), F.col("doc_id").cast("string")).alias("derived_key"))
    updated = table(spark, sf_dir, "labels").where("quality = 0").select(F.lit("doc").alias("source_kind"), F.col("doc_id").alias("source_id")).distinct()
    return ops.invalidated(ops.stale_from(updated, derivations(documents).unionByName(events)))
