"""Explicit schemas of the memory tables, and additive evolution between their versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = 3

KINDS = {"STRING": T.StringType(), "BIGINT": T.LongType(), "INT": T.IntegerType(), "DOUBLE": T.DoubleType(), "BOOLEAN": T.BooleanType(), "TIMESTAMP": T.TimestampType()}


def struct(columns: str) -> T.StructType:
    """A schema from ``name TYPE, ...`` with the plain types of ``KINDS``; it needs no session."""
    return T.StructType([T.StructField(name, KINDS[kind]) for name, kind in (c.split() for c in columns.split(","))])


SCHEMAS = {
    name: struct(ddl)
    for name, ddl in {
        "turn": "chat STRING, seq BIGINT, role STRING, text STRING, created TIMESTAMP, tokens BIGINT, extract_status STRING",
        "relationship": "chat STRING, stage STRING, affinity INT, called_as STRING, stage_note STRING, user_locked BOOLEAN, updated_by_turn BIGINT",
        "scene": "chat STRING, place STRING, present STRING, situation STRING, updated_by_turn BIGINT",
        "digest": "chat STRING, kind STRING, content STRING, upto_seq BIGINT",
        "fact": "fact_id BIGINT, chat STRING, subject STRING, predicate STRING, object STRING, realm STRING, valid_from TIMESTAMP, valid_until TIMESTAMP, superseded_by BIGINT, mention_count BIGINT, confidence DOUBLE, importance DOUBLE, source_turn_seq BIGINT, user_deleted BOOLEAN",
        "event": "event_id BIGINT, chat STRING, summary STRING, seq BIGINT, emotional_weight DOUBLE, importance DOUBLE, narrative_role STRING, surfaced_count BIGINT, mention_count BIGINT, dedup_key STRING, user_deleted BOOLEAN",
        "debt": "debt_id BIGINT, chat STRING, content STRING, setup_turn_seq BIGINT, trigger_kind STRING, trigger_spec STRING, emotional_stake DOUBLE, last_attempted_seq BIGINT, attempt_count INT, status STRING",
        "coverage": "chat STRING, from_seq BIGINT, to_seq BIGINT, resolution STRING",
        "derivation": "chat STRING, derived_kind STRING, derived_key STRING, source_kind STRING, source_id STRING",
        "stale": "chat STRING, derived_kind STRING, derived_key STRING, reason STRING",
        "provenance": "chat STRING, turn_seq BIGINT, kind STRING, item STRING, reason STRING",
        "corpus": "seq BIGINT, session STRING, turn INT, role STRING, text STRING, planted_id STRING, kind STRING",
    }.items()
}

#: Columns that a version added, with their value in older rows; versions only go up.
ADDED = {2: {"event": {"mention_count": 1}}, 3: {"event": {"dedup_key": None}}}


def migrated(df: DataFrame, name: str, have: int) -> DataFrame:
    """A table of version ``have`` with the columns of the current one; columns that are there already are left alone."""
    if have > VERSION:
        raise ValueError(f"{name} has version {have}, and this code knows {VERSION}")
    for version in range(have + 1, VERSION + 1):
        for column, value in ADDED.get(version, {}).get(name, {}).items():
            if column not in df.columns:
                df = df.withColumn(column, F.lit(value).cast(SCHEMAS[name][column].dataType))
    return df
