"""Reading memory: scored retrieval with reasons for every rejection, windows of recent turns, and context assembly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types

from ..config import DEFAULT, Config
from ..functions import text as T


def terms_of(asked: DataFrame, items: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
    """Queries and items with their terms, pairs of characters over stems, and the items' weights."""
    q = asked.select("chat", "now", F.array_distinct(T.stemmed_bigrams(F.col("query"), config.pack)).alias("q"))
    weight = F.greatest(F.coalesce("importance", F.lit(0.0)), F.coalesce("emotion", F.lit(0.0)))
    return q, items.select("chat", "item", "seq", "summary", weight.alias("weight"), "surfaced", F.array_distinct(T.stemmed_bigrams(F.col("summary"), config.pack)).alias("d"))


def _scored(rows: DataFrame, config: Config) -> DataFrame:
    decision = F.when(F.col("weight") < config.importance_gate, "unimportant").when(F.col("relevance") < config.relevance_cut, "irrelevant").otherwise("kept")
    score = config.relevance_weight * F.col("relevance") + config.importance_weight * F.col("weight") - config.surfaced_penalty * F.coalesce("surfaced", F.lit(0))
    return rows.select("chat", "now", "item", "seq", "summary", "weight", "relevance", F.round(score, 6).alias("score"), decision.alias("decision"))


def judged(asked: DataFrame, items: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Every item of a query's chat that is older than the query, with relevance, score and decision.

    ``asked``: chat, now, query; ``items``: chat, item, seq, summary, importance, emotion, surfaced. The decision is ``kept``,
    ``unimportant`` or ``irrelevant``; nothing is dropped, so the result is quadratic in a chat; ``retrieved`` gives the best items without it."""
    q, d = terms_of(asked, items, config)
    return _scored(q.join(d, "chat").where("seq < now").withColumn("relevance", F.round(T.containment(F.col("q"), F.col("d")), 6)), config)


#: Turns of a chat in a block, items that share a group of blocks, and pairs and shared terms that a task counts at once.
TURNS, ITEMS, PAIRS = 4096, 2_000, 1 << 18
#: What is told of an item.
KEPT = ("item", "seq", "summary", "weight", "surfaced")


def retrieved(asked: DataFrame, items: DataFrame, k: int, config: Config = DEFAULT) -> DataFrame:
    """The ``k`` best kept items of every query, as ``best(judged(...), k)`` gives them, by an inverted index of every chat.

    Items under the gate of importance are out before anything meets. Blocks of a chat's turns meet the blocks before them; in a task the postings of
    a query's terms are counted by item, and only what can be among the k best leaves it. So no pair of a query and an item is a row of a plan, and
    a chat of any length is dealt over tasks of bounded size."""
    q, d = terms_of(asked, items.where(F.greatest(F.coalesce("importance", F.lit(0.0)), F.coalesce("emotion", F.lit(0.0))) >= config.importance_gate), config)
    buckets = max(1, -(-items.count() // ITEMS))
    block = lambda c: F.floor(F.col(c) / TURNS)
    bucket = F.pmod(F.xxhash64("chat"), F.lit(buckets)).alias("bucket")
    q = q.where("chat IS NOT NULL").select("*", bucket, block("now").alias("late"))
    meets = q.select("chat", "late").distinct()
    d = d.where("chat IS NOT NULL").select("*", bucket, block("seq").alias("early")).join(meets, "chat").where("early <= late")
    q = q.join(d.select("chat", "early", "late").distinct(), ["chat", "late"])
    q, d = q.toDF(*q.columns), d.toDF(*d.columns)  # both stem from both by now; fresh names tell them apart
    key = ["bucket", "late", "early"]
    schema = types.StructType([asked.schema["chat"], asked.schema["now"], *(d.schema[n] for n in KEPT), *(types.StructField(n, types.LongType()) for n in ("shared", "asked"))])
    close = q.select(*key, "chat", "now", "q").groupBy(key).cogroup(d.select(*key, "chat", *KEPT, "d").groupBy(key)).applyInArrow(_closest(k, schema, config), schema)
    relevance = F.round(F.col("shared") / F.greatest(F.col("asked"), F.lit(1)), 6).alias("relevance")
    return best(_scored(close.select("*", relevance), config), k)


def _flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """The row of every element, and the elements."""
    lists = lists.combine_chunks()
    lengths = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), 0))
    return np.repeat(np.arange(len(lists)), lengths), lists.flatten()


def _closest(k: int, schema: types.StructType, config: Config):
    """Counts shared terms of the queries and items of some chats; tells for every query what can be among its k best."""

    def meet(queries: pa.Table, items: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        queries, items = queries.sort_by([("chat", "ascending"), ("now", "ascending")]), items.sort_by([("chat", "ascending"), ("seq", "ascending")])
        chats = pa.concat_arrays([t.column("chat").combine_chunks() for t in (items, queries)]).dictionary_encode().indices.to_numpy()
        d_chat, q_chat = chats[: len(items)], chats[len(items) :]  # items are sorted, so their chats' numbers rise
        (q_row, q_terms), (d_row, d_terms) = _flat(queries.column("q")), _flat(items.column("d"))
        terms = pa.concat_arrays([q_terms, d_terms]).dictionary_encode().indices.to_numpy().astype(np.int64)
        many = int(chats.max(initial=0)) + 1
        q_key, d_key = terms[: len(q_terms)] * many + q_chat[q_row], terms[len(q_terms) :] * many + d_chat[d_row]
        order = np.argsort(d_key, kind="stable")
        d_key, posting = d_key[order], d_row[order]
        begin, end = np.searchsorted(d_key, q_key, "left"), np.searchsorted(d_key, q_key, "right")
        first = np.searchsorted(d_chat, np.arange(many))
        sizes = np.bincount(d_chat, minlength=many)
        weight, seq = items.column("weight").to_numpy(), items.column("seq").to_numpy()
        base = config.importance_weight * weight - config.surfaced_penalty * np.asarray(pa.compute.fill_null(items.column("surfaced"), 0))
        now, asked = queries.column("now").to_numpy(), np.bincount(q_row, minlength=len(queries))
        starts = np.searchsorted(q_row, np.arange(len(queries) + 1))
        met = np.concatenate([[0], np.cumsum(end - begin)])  # postings of the terms before
        pairs = np.cumsum(sizes[q_chat] + np.diff(met[starts]))
        out: list[tuple] = []
        at = 0
        while at < len(queries):
            upto = max(at + 1, int(np.searchsorted(pairs, (pairs[at - 1] if at else 0) + PAIRS, "right")))
            rows = np.arange(at, upto)
            n = sizes[q_chat[rows]]
            offset = np.cumsum(n) - n
            some = slice(starts[at], starts[upto])
            length = end[some] - begin[some]
            place = posting[np.repeat(begin[some] - np.cumsum(length) + length, length) + np.arange(length.sum())]
            of = np.repeat(q_row[some] - at, length)
            shared = np.bincount(offset[of] + place - first[q_chat[rows]][of], minlength=int(n.sum()))
            owner = np.repeat(np.arange(len(rows)), n)
            item = np.arange(len(owner)) - offset[owner] + first[q_chat[rows]][owner]
            relevance = shared / np.maximum(asked[rows], 1)[owner]
            good = np.flatnonzero((relevance >= config.relevance_cut - 1e-6) & (seq[item] < now[rows][owner]))
            score = config.relevance_weight * relevance[good] + base[item[good]]
            order = np.lexsort((-score, owner[good]))
            good, score = good[order], score[order]
            new = np.flatnonzero(np.diff(owner[good], prepend=-1))
            group = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(good))))
            last = np.minimum(new + k, np.append(new[1:], len(good))) - 1
            keep = good[score >= score[last][group] - 3e-6] if len(good) else good  # ties are broken by rounded scores later
            out.append((rows[owner[keep]], item[keep], shared[keep]))
            at = upto
        a, b, c = (np.concatenate(part) for part in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
        q_part, d_part = queries.take(a), items.take(b)
        columns = [q_part.column("chat"), q_part.column("now"), *(d_part.column(n) for n in KEPT), pa.array(c.astype(np.int64)), pa.array(asked[a].astype(np.int64))]
        return pa.table(dict(zip(schema.names, columns))).cast(kinds)

    return meet


def best(rows: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("chat", "now").orderBy(F.desc("score"), "item")
    return rows.where("decision = 'kept'").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def recent(turns: DataFrame, config: Config = DEFAULT, at: DataFrame | None = None) -> DataFrame:
    """(chat, now, seq, role, text): the turns in every turn's window, or in those of the turns ``at(chat, now)``. The window's far end moves in steps of ``window_chunk``, so it
    holds between ``window_turns - 1`` and ``window_turns + window_chunk - 2`` turns.

    A turn is handed to the few steps whose windows can hold it, so turns meet by chat and step, not by chat."""
    step = config.window_chunk
    first = F.floor(F.col("seq") / step) * step
    a = turns.select("chat", F.col("seq").alias("now"), first.alias("anchor"))
    a = a if at is None else a.join(at, ["chat", "now"], "left_semi")
    b = turns.select("chat", "seq", "role", "text", F.explode(F.sequence(first, F.greatest(first, F.col("seq") + config.window_turns - 1), F.lit(step).cast("long"))).alias("anchor"))
    return a.join(b, ["chat", "anchor"]).where((F.col("seq") > F.col("anchor") - config.window_turns) & (F.col("seq") < F.col("now"))).drop("anchor")


def block(name: str | Column, volatility: float, scope: str, text: Column) -> list[Column]:
    return [F.col("chat"), F.col("now"), (F.lit(name) if isinstance(name, str) else name).alias("name"), F.lit(float(volatility)).alias("volatility"), F.lit(scope).alias("scope"), text.alias("text")]


def lines(rows: DataFrame, order: Column, line: Column) -> DataFrame:
    """(chat, now, text): the lines of every context, in order."""
    return rows.groupBy("chat", "now").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))


def assembled(blocks: list[DataFrame]) -> DataFrame:
    """All blocks (chat, now, name, volatility, scope, text) in one table with their tokens."""
    out = blocks[0]
    for more in blocks[1:]:
        out = out.unionByName(more)
    return out.withColumn("tokens", T.tokens(F.col("text")))


def rendered(blocks: DataFrame, *more: Column) -> DataFrame:
    """(chat, now, n_blocks, tokens, context) and what ``more`` aggregates: blocks by rising volatility, so what changes least comes first."""
    order = F.sort_array(F.collect_list(F.struct("volatility", "name", "text")))
    whole = F.array_join(F.transform(order, lambda b: F.concat(F.lit("["), b["name"], F.lit("]\n"), b["text"])), "\n\n")
    return blocks.groupBy("chat", "now").agg(F.count("*").alias("n_blocks"), F.sum("tokens").alias("tokens"), whole.alias("context"), *more)
