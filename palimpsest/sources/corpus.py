"""A synthetic chat corpus: a grid of sessions and turns with planted items, and noise by a hash, so it is the same on every run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config

# Shares of hard negatives among free turns.
HARD = {"hard_neg_food": 0.12, "hard_neg_regret": 0.20}


def generate(spark: SparkSession, planted: DataFrame, sessions: int = 24, config: Config = DEFAULT, seed: int = 20260903) -> DataFrame:
    """Turns as ``seq, session, turn, role, text, planted_id, kind`` from ``planted(session, turn, planted_id, kind, text)``.

    Items whose slot is taken move to the next free turns of their session, in order; none is lost. An item that would pass the end of
    its session takes the session's last turns' place in the order it came, one turn further back each."""
    grid = spark.range(1, sessions + 1).select(F.format_string("S%02d", "id").alias("session")).join(spark.range(1, config.session_turns + 1).select(F.col("id").cast("int").alias("turn")))
    # in turn order, the place of an item is the greatest of its turn and one past the item before: max(turn - n) + n
    w = Window.partitionBy("session").orderBy("turn", "planted_id")
    placed = planted.withColumn("n", F.row_number().over(w)).withColumn("slot", F.max(F.col("turn") - F.col("n")).over(w) + F.col("n"))
    placed = placed.withColumn("over", F.greatest(F.lit(0), F.max("slot").over(Window.partitionBy("session")) - config.session_turns))
    placed = placed.withColumn("slot", F.when(F.col("over") > 0, F.least(F.col("slot"), config.session_turns - (F.count("*").over(Window.partitionBy("session")) - F.col("n")))).otherwise(F.col("slot")))
    placed = placed.select("session", F.col("slot").cast("int").alias("turn"), "planted_id", "kind", "text")
    r = F.pmod(F.xxhash64(F.lit(seed), "session", "turn"), F.lit(1_000_000)) / 1e6
    noise = F.when(r < HARD["hard_neg_food"], "hard_neg_food").when(r < HARD["hard_neg_regret"], "hard_neg_regret").otherwise("noise")
    turns = grid.join(placed, ["session", "turn"], "left")
    seq = (F.substring("session", 2, 9).cast("long") - 1) * config.session_turns + F.col("turn")
    return turns.select(
        seq.alias("seq"), "session", "turn", F.when((F.col("turn") % 2 == 1) | F.col("planted_id").isNotNull(), "user").otherwise("character").alias("role"),
        F.coalesce("text", F.concat_ws(" ", noise, F.hex(F.xxhash64(F.lit(seed), "session", "turn")))).alias("text"), "planted_id", F.coalesce("kind", noise).alias("kind"),
    )
