"""Merging of repeated events as a stream: state per (chat, bucket of turns), turn by turn."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import DEFAULT, Config
from ..functions import text as T
from ..operators.episodes import overlap


#: Milliseconds that the state of a bucket outlives its last item.
REST = 60_000
#: Stands for null in keys of state.
NONE = -(2**63)


def dedup(items: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(chat, seq, action, into) of a stream ``items(chat, seq, summary)``: an item that overlaps an earlier kept one of its bucket is merged into it.

    Within a micro-batch the items of a bucket are taken in order of turn and text; over batches they must arrive in order. The state of a bucket is
    the roots of its kept items, so it is bounded by the bucket's turns. A stream with a time column ``at`` and a watermark on it lets go of a bucket's state
    once the watermark has passed its last item by REST; rows without a turn only move the watermark; what comes later than the watermark is dropped, and counted in the stream's progress."""
    timed = "at" in items.columns

    def fold(key, groups, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        if key[1] == NONE:  # rows without a turn are in no bucket
            return
        kept = [(seq, frozenset(roots)) for seq, roots in (json.loads(state.get[0]) if state.exists else [])]
        rows = pd.concat(list(groups)).sort_values(["seq", "summary"], kind="stable")  # the turns of one bucket
        into = []
        for seq, roots in zip(rows["seq"].tolist(), map(frozenset, rows["roots"])):
            hit = next((s for s, other in kept if overlap(roots, other) >= config.dedup_jaccard), None)
            if hit is None:
                kept.append((seq, roots))
            into.append(seq if hit is None else hit)
        seqs = rows["seq"].tolist()
        yield pd.DataFrame({"chat": rows["chat"].tolist(), "seq": seqs, "action": ["created" if i == s else "merged" for i, s in zip(into, seqs)], "into": into})
        state.update((json.dumps([(seq, sorted(roots)) for seq, roots in kept]),))
        if timed:
            last = int(rows["at"].max().timestamp() * 1000)
            state.setTimeoutTimestamp(max(last + REST, state.getCurrentWatermarkMs() + 1))

    rows = items.select(F.coalesce("chat", F.lit(NONE)).alias("chat"), "seq", "summary", *(["at"] if timed else []), T.roots(F.col("summary"), config.pack).alias("roots"), F.coalesce(F.floor(F.col("seq") / config.dedup_window), F.lit(NONE)).alias("bucket"))
    out = rows.groupBy("chat", "bucket").applyInPandasWithState(fold, "chat long, seq long, action string, into long", "state string", "append", GroupStateTimeout.EventTimeTimeout if timed else GroupStateTimeout.NoTimeout)
    return out.withColumn("chat", F.nullif("chat", F.lit(NONE)))
