"""Near copies by Jaccard similarity, for the pipeline: documents whose sets of 5-word shingles agree by at least 0.8.

Classes of close fingerprints (:mod:`simhash`) are compared exactly. Bits of a SimHash differ too often at this similarity (about 10 of 64)
for classes that hold every such pair, so sketches are cut into blocks, too: a sketch has 150 minima of a text's 64-bit shingle hashes, in 30 blocks of 5: two sets of similarity 0.8 miss each other in all 30 with odds of 7e-6, more similar ones with less.
Sets that share a block meet in one task, which compares them exactly and gives the edges of a spanning forest of its links, not its
pairs. Blocks with the same members meet once. Only sets that meet another one are sent; a bitmap of fixed size tells which texts
can have such sets.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import modest, stash
from .tokens import slices

#: Words of a shingle; links are of similarity PARTS in WHOLE or more.
WORDS, PARTS, WHOLE = 5, 4, 5
#: Keys of a sketch and minima of a key.
KEYS, ROWS = 30, 5
#: Shingles of the sets of one key that are compared in one group.
MOST = 1 << 19
#: The bitmap has 2**BITS bits.
BITS = 24

_random = np.random.default_rng(8_005)
TIMES, PLUS = (_random.integers(0, 1 << 32, KEYS * ROWS, dtype=np.uint32) for _ in range(2))
TIMES |= np.uint32(1)


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles, A-Z lower-cased; of the whole sequence if it is shorter, none if it has no word."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxh64_intdigest, words, repeat(42)), np.uint64, len(words))
    width = min(WORDS, len(words))
    n = len(words) - width + 1
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = h * np.uint64(0x9E3779B97F4A7C17) + w[k : k + n]
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(h ^ h >> np.uint64(32))


def named(own: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    from xxhash import xxh64_intdigest

    name = xxh64_intdigest(own.tobytes(), 5)
    return name - (1 << 64) if name >> 63 else name


def keys(own: np.ndarray) -> np.ndarray:
    """The KEYS keys of a set."""
    least, low = np.full(KEYS * ROWS, (1 << 32) - 1, np.uint32), (own >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(low), 1024):
        least = np.minimum(least, (low[at : at + 1024, None] * TIMES + PLUS).min(axis=0))
    key = np.zeros(KEYS, np.uint64)
    for column in least.reshape(KEYS, ROWS).T:
        key = (key ^ column) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


def names(texts: pa.Array) -> pa.Array:
    return pa.array([named(shingles(t)) for t in texts.to_pylist()], pa.int64())


def sketches(docs: DataFrame, prints) -> DataFrame:
    """doc_id, the name of its set (fp), the set's size (n), keys and the fingerprint (bits) that ``prints`` gives of its text, for every row."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("fp", T.LongType()), T.StructField("n", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("bits", T.LongType())])

    def run(batches):
        for whole in batches:
            for batch in slices(whole):
                sets = [shingles(t) for t in batch.column(1).to_pylist()]
                made = np.concatenate([keys(s) for s in sets]) if sets else np.zeros(0, np.int64)
                ends = pa.array(np.arange(len(sets) + 1) * KEYS, pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([named(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(ends, pa.array(made)), prints(batch.column(1))], names=schema.names)

    return modest(docs.select("doc_id", "text")).mapInArrow(run, schema)


def _places(fp):
    return (fp.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)).astype(np.int64)


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(fp, own): the sets that ``wanted(fp)`` names, each once, as bytes."""

    def places(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_places(batch.column(0).to_numpy()))], names=["at"])

    bit = F.expr("shiftleft(1, cast(at & 7 as int))")
    marked = wanted.mapInArrow(places, "at long").groupBy(F.expr("shiftright(at, 3)").alias("byte")).agg(F.bit_or(bit).alias("bits")).toArrow()
    bitmap = np.zeros(1 << BITS - 3, np.uint8)
    bitmap[marked.column("byte").to_numpy()] = marked.column("bits").to_numpy()
    box = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches):
        marks, sent = box.value, set()
        for whole in batches:
            for batch in slices(whole):
                out = {}
                for text in batch.column(0).to_pylist():
                    own = shingles(text)
                    fp = named(own)
                    at = int(_places(np.array([fp], np.int64))[0])
                    if marks[at >> 3] >> (at & 7) & 1 and fp not in sent:
                        out[fp] = own.tobytes()
                        sent.add(fp)
                if len(sent) > 100_000:
                    sent.clear()
                yield pa.RecordBatch.from_arrays([pa.array(out.keys(), pa.int64()), pa.array(out.values(), pa.binary())], names=["fp", "own"])

    found = modest(docs.select("text")).mapInArrow(run, "fp long, own binary")
    return found.join(wanted, "fp").groupBy("fp").agg(F.first("own").alias("own"))


def forest(fps: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Edges that join what links join among distinct sets; every set that is not joined yet is held against each new member."""
    m, sizes, edges = len(sets), np.array([len(s) for s in sets]), []
    if m == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return [(fps[0], fps[1])] if (PARTS + WHOLE) * both >= PARTS * int(sizes.sum()) else []
    ends = np.concatenate([[0], np.cumsum(sizes)])
    word = np.unique(np.concatenate(sets), return_inverse=True)[1]
    owners = np.repeat(np.arange(m), sizes)[np.argsort(word, kind="stable")]
    starts = np.concatenate([[0], np.cumsum(np.bincount(word))])
    left = np.ones(m, bool)
    for first in range(m):
        if not left[first]:
            continue
        left[first], queue = False, [first]
        while queue and left.any():
            i = queue.pop()
            mine = word[ends[i] : ends[i + 1]]
            both = np.bincount(np.concatenate([owners[starts[k] : starts[k + 1]] for k in mine.tolist()]), minlength=m)
            # both / (|i| + |j| - both) >= PARTS / WHOLE
            near = np.flatnonzero(left & ((PARTS + WHOLE) * both >= PARTS * (sizes[i] + sizes))).tolist()
            left[near] = False
            queue += near
            edges += [(fps[first], fps[j]) for j in near]
    return edges


def _linked(batches):
    """Rows come sorted by group."""
    at, held = None, {}

    def ready():
        return forest(list(held), [np.frombuffer(x, np.uint64) for x in held.values()]) if len(held) > 1 else []

    for batch in batches:
        edges = []
        for *group, fp, own in zip(*(batch.column(c).to_pylist() for c in ("key", "bits", "one", "two", "fp", "own"))):
            if group != at:
                edges += ready()
                at, held = group, {}
            held[fp] = own
        yield _edges(edges)
    yield _edges(ready())


def _edges(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], names=["a", "b"])


def links(docs: DataFrame, made: DataFrame, proposed: DataFrame) -> DataFrame:
    """Edges (a, b) between the sets named in ``made(fp, n, keys)`` whose components are those of all links.

    Sets of one group of ``proposed(fp, n, bits)``, the classes of close fingerprints, meet like those that share one more key."""
    once = made.groupBy("fp").agg(F.first("n").alias("n"), F.first("keys").alias("keys"))
    keyed = once.select("fp", "n", F.posexplode("keys").alias("key", "bits"))
    keyed = stash(keyed.unionByName(proposed.select("fp", "n", F.lit(KEYS).alias("key"), "bits")), "keyed")
    members = lambda salt: F.bit_xor(F.xxhash64("fp", F.lit(salt)))
    groups = keyed.groupBy("key", "bits").agg(F.count("*").alias("count"), members(1).alias("x"), members(2).alias("y"), F.sum("n").alias("size")).where("count > 1")
    # near copies share most of their keys; keys with the same members need not meet more than once
    groups = groups.groupBy("count", "x", "y").agg(F.min(F.struct("key", "bits")).alias("k"), F.first("size").alias("size"))
    shared = groups.select("k.key", "k.bits", F.greatest(F.lit(1), F.ceil(F.col("size") / MOST)).cast("int").alias("parts"))
    meeting = stash(keyed.select("fp", "key", "bits").join(shared, ["key", "bits"]), "meeting")
    sets = stash(sets_of(docs, meeting.select("fp").distinct()), "sets")
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("parts")).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least(own, j).alias("one"), F.greatest(own, j).alias("two")))
    spread = meeting.select("key", "bits", "fp", F.explode(parts).alias("p")).select("key", "bits", "p.one", "p.two", "fp").join(sets, "fp")
    dealt = modest(spread.repartition("key", "bits", "one", "two").sortWithinPartitions("key", "bits", "one", "two"))
    return dealt.mapInArrow(_linked, "a long, b long").distinct()
