"""Prefix-cache accounting of context layouts, fully declarative: a block is cached while it and all blocks before it are unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config

# Blocks as (tokens, turns between changes or None, scope, whether the block is a sliding window).
BLOCKS = {
    "system": (200, None, "global", False), "persona": (700, None, "character", False), "speech_rules": (120, None, "character", False),
    "relationship": (150, 15, "chat", False), "character_memory": (150, 30, "chat", False), "scene": (50, 5, "chat", False),
    "digest_lifetime": (400, 50, "chat", False), "digest_session": (300, 10, "chat", False), "debt": (100, 25, "chat", False),
    "recent_turns": (1500, None, "chat", True), "retrieved": (400, 1, "chat", False), "current_utterance": (80, 1, "chat", False),
}

# Orders of the blocks.
LAYOUTS = {
    "K1_memory_first": ["system", "persona", "speech_rules", "retrieved", "relationship", "character_memory", "scene", "digest_lifetime", "digest_session", "debt", "recent_turns", "current_utterance"],
    "K2_by_meaning": ["system", "persona", "speech_rules", "relationship", "character_memory", "digest_lifetime", "digest_session", "debt", "scene", "recent_turns", "retrieved", "current_utterance"],
    "K3_by_frequency": ["system", "persona", "speech_rules", "digest_lifetime", "character_memory", "debt", "relationship", "digest_session", "scene", "recent_turns", "retrieved", "current_utterance"],
}

ROWS = [(layout, pos, name, *BLOCKS[name]) for layout, names in LAYOUTS.items() for pos, name in enumerate(names)]


def layouts(spark: SparkSession, rows=ROWS) -> DataFrame:
    return spark.createDataFrame(rows, "layout string, pos int, name string, tokens int, change_every int, scope string, slides boolean")


def versions(blocks: DataFrame, turns: int, chunks: tuple[int, ...]) -> DataFrame:
    """Every block at every turn with the version of its content."""
    time = blocks.sparkSession.range(turns).select(F.col("id").alias("turn"))
    each = blocks.withColumn("chunk", F.explode(F.array(*map(F.lit, chunks))))
    version = F.when(F.col("slides"), F.floor(F.col("turn") / F.col("chunk"))).when(F.col("change_every").isNull(), F.lit(0)).otherwise(F.floor(F.col("turn") / F.col("change_every")))
    return time.join(F.broadcast(each)).withColumn("version", version.cast("long"))  # a few dozen rows of layouts


def simulate(blocks: DataFrame, turns: int = 2000, chunks: tuple[int, ...] = (1, 10), session: int = 50, config: Config = DEFAULT) -> DataFrame:
    """(layout, chunk, popular, cached, uncached, hit, input_cost, output_cost) over all turns.

    At the start of a session the user's own cache is gone. For a popular character the leading global and character blocks stay warm."""
    v = versions(blocks, turns, chunks)
    # the version of the turn before, by arithmetic on the turn: a layout's turns need not be gathered in one task
    past = F.col("turn") - 1
    before = F.when(F.col("slides"), F.floor(past / F.col("chunk"))).when(F.col("change_every").isNull(), F.lit(0)).otherwise(F.floor(past / F.col("change_every")))
    changed = (F.col("turn") % session == 0) | (F.col("version") != before)
    own = F.col("scope").isin("global", "character")
    v = v.withColumn("changed", changed).withColumn("broken", F.min(F.when(F.col("changed"), F.col("pos"))).over(Window.partitionBy("layout", "chunk", "turn")))
    v = v.withColumn("shared_end", F.min(F.when(~own, F.col("pos"))).over(Window.partitionBy("layout", "chunk", "turn")))
    per = v.groupBy("layout", "chunk", "turn").agg(
        F.sum("tokens").alias("all"), F.sum(F.when(F.col("pos") < F.coalesce("broken", F.lit(999)), F.col("tokens")).otherwise(0)).alias("own"),
        F.sum(F.when(F.col("pos") < F.coalesce("shared_end", F.lit(999)), F.col("tokens")).otherwise(0)).alias("shared"),
    )
    both = per.withColumn("popular", F.explode(F.array(F.lit(False), F.lit(True))))
    both = both.withColumn("cached", F.when(F.col("popular"), F.greatest("own", "shared")).otherwise(F.col("own")))
    total = both.groupBy("layout", "chunk", "popular").agg(F.sum("cached").alias("cached"), F.sum(F.col("all") - F.col("cached")).alias("uncached"))
    month = config.turns_per_month / turns / 1e6
    return total.select(
        "layout", "chunk", "popular", "cached", "uncached", F.round(F.col("cached") / (F.col("cached") + F.col("uncached")), 6).alias("hit"),
        F.round((F.col("uncached") * config.price_in + F.col("cached") * config.price_cached) * month, 6).alias("input_cost"),
        F.round(F.lit(config.output_tokens * turns * config.price_out * month), 6).alias("output_cost"),
    )
