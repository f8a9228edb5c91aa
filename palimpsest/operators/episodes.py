"""Order-dependent folds over the items of a chat: event dedup, clusters of observations, repetition under a penalty."""

from __future__ import annotations

from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT, Config
from ..functions import text as text_functions


def overlap(a: frozenset, b: frozenset) -> float:
    return len(a & b) / (len(a | b) or 1)


def merged_into(sets: list[frozenset], at_least: float) -> list[int]:
    """For every set the place of the first earlier kept one that it overlaps enough, else its own."""
    kept, out = [], []
    for i, s in enumerate(sets):
        hit = next((j for j in kept if overlap(s, sets[j]) >= at_least), i)
        if hit == i:
            kept.append(i)
        out.append(hit)
    return out


#: Observations of a chat in a block, observations that share a group of blocks, and bytes of sets that are compared at once.
TURNS, SETS, BYTES = 4096, 20_000, 1 << 25
#: Pairs that are so few that comparing them all costs less than looking for candidates.
PAIRS = 4096


def _bits(row: np.ndarray, term: np.ndarray, sets: int, terms: int) -> np.ndarray:
    """Every set as a row of bits, in words of 64."""
    out = np.zeros((sets, -(-terms // 64) * 8), np.uint8)
    for at in range(0, sets, 256):
        some = slice(*np.searchsorted(row, (at, at + 256)))
        has = np.zeros((min(256, sets - at), out.shape[1] * 8), bool)
        has[row[some] - at, term[some]] = True
        out[at : at + len(has)] = np.packbits(has, axis=1)
    return out.view(np.uint64)


def _prefix(row: np.ndarray, term: np.ndarray, rank: np.ndarray, size: np.ndarray, at_least: float) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """An inverted list for every term that is among the rarest of a set: the sets, and how many of their terms come from it on.

    Sets that are alike enough share one of these, as each has no more other terms than it may lack."""
    order = np.lexsort((rank[term], row))
    row, term = row[order], term[order]
    place = np.arange(len(row)) - (np.cumsum(size) - size)[row]
    few = np.flatnonzero(place <= size[row] - np.ceil(at_least * size[row] - 1e-9))
    few = few[np.argsort(term[few], kind="stable")]
    cuts = np.flatnonzero(np.diff(term[few])) + 1
    return {int(term[some[0]]): (row[some], size[row[some]] - place[some]) for some in np.split(few, cuts) if len(some)}


def closest(late: tuple, early: tuple, at_least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(late set, early set, share) of the earlier sets that are closest to a set and close enough; more than one where they tie.

    Each side is (place of every set, set of every term, term), terms in the order of their sets. Candidates share a rare term whose places
    leave room for enough common terms; candidates are compared in full."""
    (q_place, q_row, q_term), (d_place, d_row, d_term) = late, early
    terms = int(max(q_term.max(initial=-1), d_term.max(initial=-1))) + 1
    q_size, d_size = np.bincount(q_row, minlength=len(q_place)), np.bincount(d_row, minlength=len(d_place))
    rank = np.argsort(np.argsort(np.bincount(np.concatenate([q_term, d_term]), minlength=terms), kind="stable"))
    may = np.full((len(q_place), len(d_place)), len(q_place) * len(d_place) <= PAIRS)
    asked, held = ({}, {}) if may.all() else (_prefix(q_row, q_term, rank, q_size, at_least), _prefix(d_row, d_term, rank, d_size, at_least))
    for term in asked.keys() & held.keys():
        (q, q_left), (d, d_left) = asked[term], held[term]
        room = np.minimum(q_left[:, None], d_left) * (1 + at_least) + 1e-9 >= at_least * (q_size[q][:, None] + d_size[d])
        may[np.ix_(q, d)] |= room
    q, d = np.nonzero(may & (q_place[:, None] > d_place))
    q_bits, d_bits = _bits(q_row, q_term, len(q_place), terms), _bits(d_row, d_term, len(d_place), terms)
    step = max(1, BYTES // max(8, q_bits.shape[1] * 8))
    both = [np.bitwise_count(q_bits[q[at : at + step]] & d_bits[d[at : at + step]]).sum(1, dtype=np.int64) for at in range(0, len(q), step)]
    both = np.concatenate(both) if both else np.zeros(0, np.int64)
    share = both / np.maximum(q_size[q] + d_size[d] - both, 1)
    best = np.zeros(len(q_place))
    np.maximum.at(best, q, share)
    top = (share == best[q]) & (share > 0) & (share >= at_least)
    return q[top], d[top], share[top]


class Founders:
    """Greedy clusters in one pass: a set goes where its closest earlier set went if that is close enough, ties to the oldest cluster,
    else it founds one. Holds one number a set."""

    def __init__(self, at_least: float):
        self.at_least, self.of = at_least, []

    def step(self, share: float, ties: list[int]) -> int:
        self.of.append(min(self.of[j] for j in ties) if ties and share >= self.at_least else len(self.of))
        return self.of[-1]


def clustered(sets: list[frozenset], at_least: float) -> list[int]:
    """Labels of the greedy clusters of a few sets, in their order."""
    ids: dict = {}
    flat = np.array([(i, ids.setdefault(t, len(ids))) for i, s in enumerate(sets) for t in s], np.int64).reshape(-1, 2)
    side = (np.arange(len(sets)), flat[:, 0], flat[:, 1])
    ties: list[list[int]] = [[] for _ in sets]
    share = [0.0] * len(sets)
    for i, j, x in zip(*(a.tolist() for a in closest(side, side, at_least))):
        ties[i].append(j)
        share[i] = x
    founders = Founders(at_least)
    labels: dict = {}
    return [labels.setdefault(founders.step(x, t), len(labels)) for x, t in zip(share, ties)]


def dedup(items: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """``items(chat, seq, summary, weight)`` -> chat, seq, action (created or merged), into. Only items of one bucket of turns are
    compared, so a group is no larger than the bucket; items of equal seq are taken in order of their text."""
    rows = items.select("chat", "seq", "weight", "summary", text_functions.roots(F.col("summary"), config.pack).alias("roots"), F.floor(F.col("seq") / config.dedup_window).alias("bucket"))

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["seq", "summary"], kind="stable")
        into = merged_into([frozenset(r) for r in group["roots"]], config.dedup_jaccard)
        seqs = group["seq"].tolist()
        return pd.DataFrame({"chat": group["chat"], "seq": seqs, "action": ["created" if i == j else "merged" for i, j in enumerate(into)], "into": [seqs[j] for j in into]})

    schema = T.StructType([rows.schema["chat"], rows.schema["seq"], T.StructField("action", T.StringType()), T.StructField("into", rows.schema["seq"].dataType)])
    return rows.groupBy("chat", "bucket").applyInPandas(fold, schema)


def stored_events(items: DataFrame, actions: DataFrame) -> DataFrame:
    """(chat, seq, mentions, weight): kept events with the largest weight of all that was merged into them."""
    return items.join(actions, ["chat", "seq"]).groupBy("chat", F.col("into").alias("seq")).agg(F.count("*").alias("mentions"), F.max("weight").alias("weight"))


def clusters(items: DataFrame, thresholds: tuple[float, ...], config: Config = DEFAULT) -> DataFrame:
    """``items(chat, seq, text)`` -> threshold, chat, seq, founder, copies: the cluster of every different observation of a chat.

    ``seq`` is where an observation is first made, ``founder`` the number of the one that founded its cluster, ``copies`` how often it is made;
    observations of the same terms always share a cluster, so only different ones are compared, in order of seq, then terms. A null text is
    an empty one; rows without a chat are a chat of their own.

    Blocks of a chat meet the blocks before them in tasks, which tell the closest earlier observations; a sorted pass over these, which holds a number
    for each observation of one chat, then follows them to their founders."""
    terms = F.array_sort(F.array_distinct(text_functions.stemmed_bigrams(F.col("text"), config.pack)))
    sets = items.select("chat", "seq", terms.alias("terms")).groupBy("chat", "terms").agg(F.min("seq").alias("seq"), F.count("*").alias("copies"))
    sets = sets.withColumn("place", F.row_number().over(Window.partitionBy("chat").orderBy("seq", "terms")).cast("long") - 1)
    buckets = max(1, -(-items.count() // SETS))
    sets = sets.select("*", F.pmod(F.xxhash64("chat"), F.lit(buckets)).alias("bucket"), F.floor(F.col("place") / TURNS).alias("block"))
    last = sets.groupBy(F.col("chat").alias("of")).agg(F.max("block").alias("last"))
    early = sets.join(last, F.col("chat").eqNullSafe(F.col("of"))).select("*", F.explode(F.sequence("block", "last")).alias("late"))
    late = sets.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("block"))).alias("early"))
    key = ["bucket", "late", "early"]
    late = late.select("bucket", F.col("block").alias("late"), "early", "chat", "place", "seq", "copies", "terms")
    early = early.select("bucket", "late", F.col("block").alias("early"), "chat", "place", "terms")
    late, early = late.toDF(*late.columns), early.toDF(*early.columns)  # both stem from the same sets; fresh names tell them apart
    schema = T.StructType([*late.select("chat", "place", "seq", "copies").schema.fields, T.StructField("share", T.DoubleType()), T.StructField("ties", T.ArrayType(T.LongType()))])
    near = late.groupBy(key).cogroup(early.groupBy(key)).applyInArrow(_near(min(thresholds), schema), schema)
    out = T.StructType([T.StructField("threshold", T.DoubleType()), *late.select("chat", "seq").schema.fields, T.StructField("founder", T.LongType()), T.StructField("copies", T.LongType())])
    return near.repartition("chat").sortWithinPartitions("chat", "place").mapInArrow(_followed(thresholds, out), out)


def _near(at_least: float, schema: T.StructType):
    """Tells for every late observation of some chats which early ones are closest."""

    def sides(tables: list[pa.Table]) -> list[dict]:
        chats = pa.concat_arrays([t.column("chat").combine_chunks() for t in tables]).dictionary_encode(null_encoding="encode").indices.to_numpy()
        out, at = [], 0
        for t in tables:
            chat, lists = chats[at : at + len(t)], t.column("terms").combine_chunks()
            at += len(t)
            out.append((chat, np.asarray(pa.compute.list_value_length(lists)), lists.flatten(), t.column("place").to_numpy()))
        terms = pa.concat_arrays([o[2] for o in out]).dictionary_encode().indices.to_numpy().astype(np.int64)
        at, parts = 0, []
        for chat, lengths, flat, place in out:
            of, own = np.cumsum(lengths) - lengths, {}
            order = np.argsort(chat, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(chat[order])) + 1):
                n = lengths[rows]
                row = np.repeat(np.arange(len(rows)), n)
                own[int(chat[rows[0]])] = (rows, place[rows], row, terms[at + of[rows][row] + np.arange(len(row)) - (np.cumsum(n) - n)[row]])
            at += len(flat)
            parts.append(own)
        return parts

    def meet(late: pa.Table, early: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        share, ties = np.zeros(len(late)), [[] for _ in range(len(late))]
        asked, held = sides([late, early]) if len(late) and len(early) else ({}, {})
        for chat in asked.keys() & held.keys():
            (q_rows, q_place, q_row, q_term), (_, d_place, d_row, d_term) = asked[chat], held[chat]
            used, both = np.unique(np.concatenate([q_term, d_term]), return_inverse=True)
            for q, d, x in zip(*closest((q_place, q_row, both[: len(q_term)]), (d_place, d_row, both[len(q_term) :]), at_least)):
                share[q_rows[q]] = x
                ties[q_rows[q]].append(int(d_place[d]))
        found = late.select(["chat", "place", "seq", "copies"]).append_column("share", pa.array(share)).append_column("ties", pa.array(ties, pa.list_(pa.int64())))
        return found.cast(to_arrow_schema(schema))

    return meet


def _followed(thresholds: tuple[float, ...], schema: T.StructType):
    """Rows come by chat and place; several of one place tell of different blocks."""

    def follow(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        chat, founders, row, share, ties = None, None, None, 0.0, []

        def told():
            return [(f.at_least, row[0], row[2], f.step(share, ties), row[3]) for f in founders] if row else []

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows), kinds)], schema=kinds)

        for batch in batches:
            out = []
            for new in zip(*(batch.column(c).to_pylist() for c in ("chat", "place", "seq", "copies", "share", "ties"))):
                if row is None or new[:2] != row[:2]:
                    out += told()
                    if row is None or new[0] != chat:
                        chat, founders = new[0], [Founders(t) for t in thresholds]
                    row, share, ties = new[:4], 0.0, []
                if new[4] > share:
                    share, ties = new[4], []
                if new[4] == share:
                    ties += new[5]
            if out:
                yield batch_of(out)
        if row is not None:
            yield batch_of(told())

    return follow


def observations(items: DataFrame, thresholds: tuple[float, ...], config: Config = DEFAULT) -> DataFrame:
    """``items(chat, seq, text)`` -> threshold, chat, clusters, largest: clusters of a chat's observations in their order."""
    sizes = clusters(items, thresholds, config).groupBy("threshold", "chat", "founder").agg(F.sum("copies").alias("n"))
    return sizes.groupBy("threshold", "chat").agg(F.count("*").alias("clusters"), F.max("n").alias("largest"))


#: Scores are compared in millionths.
MICRO = 1_000_000
#: Items that a query brings back, and queries before it in which a pick counts as a repeat.
PICKS, BEFORE = 3, 3


class Picks:
    """Picks of queries in order, where every earlier pick of an item lowers its score; ties to the smaller item."""

    def __init__(self, penalty: float, top: int = PICKS):
        self.penalty, self.top, self.shown, self.last = round(penalty * MICRO), top, np.zeros(64, np.int64), []
        self.repeats = self.picks = 0

    def step(self, items: list, scores: np.ndarray) -> list[int]:
        n = len(scores)
        if n > len(self.shown):
            self.shown = np.concatenate([self.shown, np.zeros(n, np.int64)])
        left = scores - self.penalty * self.shown[:n]
        floor = np.partition(left, n - self.top)[n - self.top] if n > self.top else left.min()
        now = sorted(np.flatnonzero(left >= floor).tolist(), key=lambda i: (-left[i], items[i]))[: self.top]
        self.shown[now] += 1
        self.repeats += sum(any(i in before for before in self.last) for i in now)
        self.picks += len(now)
        self.last = [*self.last, now][-BEFORE:]
        return now


def penalised(scores: list[dict[int, float]], penalty: float, top: int = PICKS) -> list[list[int]]:
    """The picks of a few queries that all score the same items."""
    items, picks = sorted(scores[0]), Picks(penalty, top)
    return [[items[i] for i in picks.step(items, np.array([round(s[i] * MICRO) for i in items]))] for s in scores]


class Shelf:
    """The items of a chat so far: an inverted list for every term, and what an item's weight adds to its score."""

    def __init__(self, config: Config):
        self.config, self.lists, self.items, self.weight = config, {}, [], array("d")

    def put(self, item, terms: list[str], weight: float, surfaced: int) -> None:
        for t in terms:
            self.lists.setdefault(t, array("i")).append(len(self.items))
        self.items.append(item)
        self.weight.append(self.config.importance_weight * weight - self.config.surfaced_penalty * surfaced)

    def scores(self, terms: list[str]) -> np.ndarray:
        """The score of every item, in millionths."""
        hits = [np.frombuffer(self.lists[t], np.int32) for t in terms if t in self.lists]
        shared = np.bincount(np.concatenate(hits), minlength=len(self.items)) if hits else np.zeros(len(self.items))
        relevance = np.floor(shared / max(len(terms), 1) * MICRO + 0.5) / MICRO
        return np.floor((self.config.relevance_weight * relevance + np.array(self.weight)) * MICRO + 0.5).astype(np.int64)


def repetition(asked: DataFrame, items: DataFrame, penalties: tuple[float, ...], config: Config = DEFAULT) -> DataFrame:
    """``asked(chat, now, query)``, ``items(chat, item, seq, summary, importance, emotion, surfaced)`` -> penalty, chat, repeats, picks, distinct_items.

    Every query picks the three best of the items before it by relevance and weight, less the penalty for every earlier pick; a repeat was among the
    picks of the last three queries. Queries with nothing before them pick nothing. Of equal ``now`` the text decides the order, of equal ``seq`` the item.

    Queries and items of a chat come as one sorted stream, so no pair of a query and an item is a row of a plan; a task holds the terms of one
    chat's items, and the number of times that they were picked."""
    from .memory import terms_of

    q, d = terms_of(asked, items, config)
    rows = d.select("chat", F.col("seq").alias("at"), F.lit(1).alias("kind"), "item", F.col("d").alias("terms"), "weight", F.coalesce("surfaced", F.lit(0)).cast("long").alias("surfaced")).unionByName(
        q.select("chat", F.col("now").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast(items.schema["item"].dataType).alias("item"), F.col("q").alias("terms"), F.lit(None).cast("double").alias("weight"), F.lit(None).cast("long").alias("surfaced"))
    )
    schema = T.StructType([T.StructField("penalty", T.DoubleType()), asked.schema["chat"], *(T.StructField(c, T.LongType()) for c in ("repeats", "picks", "distinct_items"))])

    def fold(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        chat, shelf, picks = None, None, None

        def told():
            rows = [(p, chat, x.repeats, x.picks, int(np.count_nonzero(x.shown))) for p, x in zip(penalties, picks)]
            return pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows), kinds)], schema=kinds)

        for batch in batches:
            for new, kind, item, terms, weight, surfaced in zip(*(batch.column(c).to_pylist() for c in ("chat", "kind", "item", "terms", "weight", "surfaced"))):
                if shelf is None or new != chat:
                    if shelf is not None:
                        yield told()
                    chat, shelf, picks = new, Shelf(config), [Picks(p) for p in penalties]
                if kind:
                    shelf.put(item, terms, weight, surfaced)
                elif shelf.items:
                    scores = shelf.scores(terms)
                    for x in picks:
                        x.step(shelf.items, scores)
        if shelf is not None:
            yield told()

    # an item is seen by later queries only, so of equal turns the queries come first
    return rows.repartition("chat").sortWithinPartitions("chat", "at", "kind", "item", "terms").mapInArrow(fold, schema)
