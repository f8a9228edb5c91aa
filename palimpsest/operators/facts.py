"""The bi-temporal fact store: ordered upserts, validity intervals, as-of views, supersession and deletion.

A stream of statements has (subject, predicate, object, confidence, ts, id). Predicates of one value need an ordered fold per key;
predicates of many values do not: what is live there follows from the first statement of each object that is accepted, so
window functions answer it and a hot key is no burden for Python.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT, Config

KEY, ORDER = ["subject", "predicate"], ["ts", "id"]
INSERTED = ("created", "coexist", "superseded")


def mutability(predicate: str, config: Config) -> str:
    pack = config.pack
    return "high" if predicate in pack.mutability_high else "low" if predicate in pack.mutability_low else "mid"


class OneValue:
    """The fold of a key with one value: the live object and its confidence, statement by statement."""

    def __init__(self, tolerance: float, reinforce: float, live: str | None = None, confidence: float = 0.0):
        self.tolerance, self.reinforce, self.live, self.confidence = tolerance, reinforce, live, confidence

    def step(self, obj: str, confidence: float) -> str:
        if self.live is None:
            self.live, self.confidence = obj, confidence
            return "created"
        if self.live == obj:
            self.confidence = min(1.0, self.confidence + self.reinforce)
            return "reinforced"
        if confidence < self.confidence - self.tolerance:
            return "held"
        self.live, self.confidence = obj, confidence
        return "superseded"


def actions(statements: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Every statement with its ``action``: created, reinforced, superseded, coexist or held."""
    one = F.col("predicate").isin(*config.pack.cardinality_one)
    columns = [c for c in statements.columns if c != "action"]
    schema = T.StructType([*statements.select(*columns).schema.fields, T.StructField("action", T.StringType())])

    def fold(batches):
        """Rows come by key and in order; the state of the last key is carried from batch to batch."""
        now, state = None, None
        for batch in batches:
            out = []
            for subject, predicate, obj, confidence in zip(*(batch.column(c).to_pylist() for c in (*KEY, "object", "confidence"))):
                if (subject, predicate) != now:
                    now, state = (subject, predicate), OneValue(config.tolerance[mutability(predicate, config)], config.reinforce)
                out.append(state.step(obj, confidence))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, "action"])

    single = statements.where(one).select(*columns).repartition(*KEY).sortWithinPartitions(*KEY, *ORDER).mapInArrow(fold, schema)
    key, same = Window.partitionBy(*KEY).orderBy(*ORDER), Window.partitionBy(*KEY, "object").orderBy(*ORDER)
    many = statements.where(~one).withColumn("first", F.row_number().over(key) == 1)
    accepted = F.col("first") | (F.col("confidence") >= config.confidence_floor)
    many = many.withColumn("before", F.coalesce(F.max(accepted.cast("int")).over(same.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    action = F.when(F.col("before") == 1, "reinforced").when(F.col("first"), "created").when(accepted, "coexist").otherwise("held")
    return single.unionByName(many.withColumn("action", action).select(*columns, "action"))


def history(acted: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Stored facts from :func:`actions`: fact_id, validity, supersession, mentions and confidence."""
    one = F.col("predicate").isin(*config.pack.cardinality_one)
    slot = F.when(one, F.lit("")).otherwise(F.col("object"))  # of one value: the key's only slot; of many: one for each object
    rows = acted.where("action <> 'held'").withColumn("slot", slot).withColumn("inserted", F.col("action").isin(*INSERTED))
    w = Window.partitionBy(*KEY, "slot").orderBy(*ORDER)
    rows = rows.withColumn("fact_id", F.last(F.when(F.col("inserted"), F.col("id")), ignorenulls=True).over(w))
    mentions = rows.groupBy(*KEY, "slot", "fact_id").agg(
        F.max(F.when(F.col("inserted"), F.col("object"))).alias("object"), F.max(F.when(F.col("inserted"), F.col("ts"))).alias("valid_from"),
        F.max(F.when(F.col("inserted"), F.col("confidence"))).alias("stated"), F.count("*").alias("mention_count"),
    )
    w = Window.partitionBy(*KEY, "slot").orderBy("valid_from", "fact_id")
    return mentions.select(
        "fact_id", *KEY, "object", "valid_from", F.lead("valid_from").over(w).alias("valid_until"), F.lead("fact_id").over(w).alias("superseded_by"),
        "mention_count", F.round(F.least(F.lit(1.0), F.col("stated") + config.reinforce * (F.col("mention_count") - 1)), 6).alias("confidence"),
    )


def valid_at(facts: DataFrame, when: Column) -> DataFrame:
    """Facts valid at a time: from ``valid_from``, up to but without ``valid_until``."""
    return facts.where((F.col("valid_from") <= when) & (F.col("valid_until").isNull() | (F.col("valid_until") > when)))


def as_of(facts: DataFrame, probes: DataFrame, at: str = "at") -> DataFrame:
    """Facts of every probe's subject that are valid at its own time."""
    return probes.join(facts, "subject").where((F.col("valid_from") <= F.col(at)) & (F.col("valid_until").isNull() | (F.col("valid_until") > F.col(at))))


def current(facts: DataFrame, standing: tuple[str, ...] | None = None) -> DataFrame:
    live = facts.where("valid_until IS NULL")
    return live.where(F.col("predicate").isin(*standing)) if standing else live


def supersessions(facts: DataFrame) -> DataFrame:
    """Every superseded fact beside the one that took its place."""
    old, new = facts.alias("old"), facts.alias("new")
    return old.join(new, F.col("old.superseded_by") == F.col("new.fact_id")).select(
        F.col("old.fact_id").alias("old_id"), F.col("new.fact_id").alias("new_id"), F.col("old.subject").alias("subject"), F.col("old.predicate").alias("predicate"),
        F.col("old.object").alias("old_object"), F.col("new.object").alias("new_object"),
    )


def stale_from(changed: DataFrame, derivations: DataFrame) -> DataFrame:
    """What is derived, in one step, from any changed source: (derived_kind, derived_key, causes). Deleting and updating spread alike."""
    hit = derivations.join(changed, ["source_kind", "source_id"])
    return hit.groupBy("derived_kind", "derived_key").agg(F.count_distinct("source_id").alias("causes"))


#: Kinds of derived things that are copies: they need no new text, so they go when their source changes.
COPIES = ("event",)


def invalidated(stale: DataFrame, copies: tuple[str, ...] = COPIES) -> DataFrame:
    """What :func:`stale_from` found with its ``action``: copies are deleted at once, all else is stale until it is made anew."""
    return stale.withColumn("action", F.when(F.col("derived_kind").isin(*copies), "deleted").otherwise("stale"))


def without_stale(derived: DataFrame, stale: DataFrame) -> DataFrame:
    return derived.join(stale, ["derived_kind", "derived_key"], "left_anti")
