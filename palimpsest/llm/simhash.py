"""Operator 8, SimHash near-duplicates: pigeonhole blocks find every pair of close fingerprints, stars give components.

Fingerprints of 64 bits are cut into 6 blocks. Two that differ in at most 3 bits agree on at least 3 whole blocks, so the
20 choices of 3 blocks, used as join keys, bring every such pair together. Work is done on distinct fingerprints only, so
exact copies cost nothing here. Fingerprints that share a key are compared with exclusive-or and bit counts; each group
gives the edges of a spanning forest of its links, not its pairs. A key with more than ``MOST`` fingerprints is split at random
into parts and every two parts meet in a task of their own, so no task holds more than about two parts and no link is lost.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import copies
from .common import cut, modest, stash, table
from .tokens import slices

#: Widths of the blocks, from the lowest bit.
BLOCKS = (11, 11, 11, 11, 10, 10)
#: Links at this many differing bits or fewer; with 6 blocks such pairs share 3.
NEAR = 3
#: Fingerprints of one key that are compared in one group.
MOST = 4096
#: Parts of a node's neighbours that components deal with apart.
SALTS = 8


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """SimHash of a text: A-Z lower-cased, word shingles with repeats, XXH64; the whole sequence if it is shorter, 0 if it has no word."""
    from xxhash import xxh64_intdigest

    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    if len(parts) < words:
        return xxh64_intdigest(b" ".join(parts), seed)
    shingles = map(b" ".join, zip(*(parts[i:] for i in range(words))))
    count = len(parts) - words + 1
    hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(seed)), np.uint64, count)
    ones = np.zeros(64, np.int64)
    for at in range(0, count, 1 << 15):
        ones += np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > count, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and its fingerprint as a signed 64-bit number, for every row."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("fp", T.LongType())])

    def run(batches):
        for whole in batches:
            for batch in slices(whole):
                yield pa.RecordBatch.from_arrays([batch.column(0), hashed(batch.column(1))], names=schema.names)

    return modest(docs.select("doc_id", "text")).mapInArrow(run, schema)


def hashed(texts: pa.Array) -> pa.Array:
    return pa.array(np.fromiter(map(fingerprint, texts.to_pylist()), np.uint64, len(texts)).view(np.int64))


def named(docs: DataFrame) -> DataFrame:
    """(own, fp): the whole row of ``docs`` as a struct, whatever its columns are called, and the name of its set of shingles."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own"))
    schema, at = T.StructType([rows.schema["own"], T.StructField("fp", T.LongType())]), docs.columns.index("text")

    def run(batches):
        for whole in batches:
            for batch in slices(whole):
                yield pa.RecordBatch.from_arrays([batch.column(0), copies.names(batch.column(0).field(at))], names=schema.names)

    return modest(rows).mapInArrow(run, schema)


def _keys() -> F.Column:
    """An array of the 20 keys of a fingerprint: its bits under a mask of three blocks, and the number of the mask."""
    ends = np.cumsum(BLOCKS)
    masks = [((1 << int(e)) - 1) ^ ((1 << int(e) - w) - 1) for e, w in zip(ends, BLOCKS)]
    chosen = [reduce(int.__or__, c) for c in combinations(masks, len(BLOCKS) - NEAR)]
    signed = [m - (1 << 64) if m >> 63 else m for m in chosen]
    return F.array(*(F.struct(F.lit(i).cast("byte").alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(signed)))


def _forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join what links of at most NEAR bits join among ``fps``: from the smallest of each component to the others."""
    n = len(fps)
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    bits = fps.view(np.uint64)
    for i in range(n - 1):
        for j in np.flatnonzero(np.bitwise_count(bits[i + 1 :] ^ bits[i]) <= NEAR):
            a, b = root(i), root(i + 1 + int(j))
            if a != b:
                parent[max(a, b)] = min(a, b)
    return [(int(fps[r]), int(fps[i])) for i in range(n) if (r := root(i)) != i]


def _linked(batches):
    """Rows come sorted by group; groups of one are passed over, groups of two are compared all at once."""
    held: list = []

    def ready(table: pa.Table, final: bool):
        cols = [table.column(c).to_numpy() for c in ("mask", "bits", "one", "two", "fp")]
        new = np.zeros(len(cols[0]), bool)
        for c in cols[:4]:
            new[1:] |= c[1:] != c[:-1]
        new[:1] = True
        starts = np.flatnonzero(new)
        keep = len(cols[0]) if final or not len(starts) else int(starts[-1])
        sizes = np.diff(np.append(starts, len(cols[0])))
        if not final:
            starts, sizes = starts[:-1], sizes[:-1]
        fp, edges = cols[4], []
        twos = starts[sizes == 2]
        close = twos[np.bitwise_count((fp[twos] ^ fp[twos + 1]).view(np.uint64)) <= NEAR]
        for s, z in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            edges += _forest(np.sort(fp[s : s + z]))
        a = np.concatenate([fp[close], np.array([e[0] for e in edges], np.int64)])
        b = np.concatenate([fp[close + 1], np.array([e[1] for e in edges], np.int64)])
        return keep, pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= 1 << 16:
            whole = pa.Table.from_batches(held)
            keep, out = ready(whole, False)
            yield out
            held = whole.slice(keep).combine_chunks().to_batches() if keep < whole.num_rows else []
    if held:
        yield ready(pa.Table.from_batches(held), True)[1]


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fps(fp)`` whose components are those of all links of at most NEAR bits."""
    keyed = fps.select("fp", F.explode(_keys()).alias("k")).select("fp", "k.mask", "k.bits")
    crowded = keyed.groupBy("mask", "bits").count().where(F.col("count") > MOST).select("mask", "bits", F.ceil(F.col("count") / MOST).cast("int").alias("parts"))
    crowded = stash(crowded, "crowded")  # few rows or none; its size is known before the join
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("parts")).cast("int")
    parts = F.when(F.col("parts").isNull(), F.array(F.struct(F.lit(0).alias("one"), F.lit(0).alias("two")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least(own, j).alias("one"), F.greatest(own, j).alias("two")))
    )
    spread = keyed.join(crowded, ["mask", "bits"], "left").select("mask", "bits", "fp", F.explode(parts).alias("p")).select("mask", "bits", "p.one", "p.two", "fp")
    dealt = spread.repartition("mask", "bits", "one", "two").sortWithinPartitions("mask", "bits", "one", "two")
    return dealt.mapInArrow(_linked, "a long, b long").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``; the root is the smallest node that can be reached.

    Large-star and small-star steps in turn: each hangs neighbours on the smallest one they see, until nothing moves. Only
    minima are gathered by key, with partial sums, and handed out to SALTS parts of a node's neighbours, so a node with very many
    neighbours is no burden for one task.
    """
    salt = lambda c: F.pmod(F.xxhash64(c, F.lit(3)), F.lit(SALTS)).cast("int").alias("salt")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    edges = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    state = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").select("a", "b", salt("b")).join(least.select("a", "m", salts), ["a", "salt"]).select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m"))  # small-star: every b has neighbours a < b
        small = large.select("a", "b", salt("a")).join(least.select("b", "m", salts), ["b", "salt"]).select(F.col("m"), F.col("a"), F.col("b"))
        edges = cut(small.select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")), F.struct(F.col("m").alias("a"), F.col("b").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        state = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def classes(made: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """(fp, root) for every distinct fingerprint of ``made(doc_id, fp)`` and the smallest doc_id of its component; ``edges`` other than those of :func:`links` may be given."""
    distinct = stash(made.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    member = components(links(distinct.select("fp")) if edges is None else edges)
    linked = distinct.join(member.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    return linked.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, fp (signed), component_id.

    component_id is the smallest doc_id among all documents whose fingerprints can be reached by links of at most NEAR
    bits. Null and blank texts have fingerprint zero and are linked like any other; a null doc_id is kept and is the
    component's id only if the component has no other; repeated rows are returned each; an empty table gives no rows;
    other columns are ignored.
    """
    made = stash(fingerprints(docs), "fingerprints")
    return made.join(classes(made), "fp").select("doc_id", "fp", "component_id")


def proposed(made: DataFrame) -> DataFrame:
    """(fp, n, bits): the sets of ``made(fp, n, bits)``, each under the smallest fingerprint that links of at most NEAR bits reach from its own."""
    sets = stash(made.select("fp", "n", "bits").distinct(), "proposed")
    member = components(links(sets.select(F.col("bits").alias("fp")).distinct()))
    return sets.join(member.withColumnRenamed("node", "bits"), "bits", "left").select("fp", "n", F.coalesce("root", "bits").alias("bits")).distinct()


def survivors(docs: DataFrame) -> DataFrame:
    """One row of every group of near copies, with the columns of ``docs``: the one with the smallest doc_id.

    Links are sets of 5-word shingles with a Jaccard similarity of at least 0.8, groups what links join. Pairs come from the classes of close
    fingerprints and, as such sets may differ in more bits, from the blocks of :mod:`copies`; all are compared exactly. A group without any doc_id keeps one of its rows; of repeated rows one stays; texts without a word are copies of each other."""
    made = stash(copies.sketches(docs, hashed), "sketches")
    key = F.xxhash64(F.col("doc_id").isNull(), "doc_id", "fp")
    found = made.select("doc_id", "fp").join(classes(made, copies.links(docs, made, proposed(made))), "fp").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "fp")).alias("k"))
    keep = found.select(F.col("k.doc_id").alias("keep_id"), F.col("k.fp").alias("keep_fp")).select("keep_id", "keep_fp", F.xxhash64(F.col("keep_id").isNull(), "keep_id", "keep_fp").alias("keep_key"))
    rows = named(docs).select("own", F.col("own.doc_id").alias("doc_id"), "fp").select("own", "doc_id", "fp", key.alias("row_key"))
    same = (F.col("row_key") == F.col("keep_key")) & F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("fp") == F.col("keep_fp"))
    one = Window.partitionBy("row_key", "doc_id", "fp").orderBy("fp")
    return rows.join(keep, same).withColumn("copy", F.row_number().over(one)).where("copy = 1").select("own.*")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of all ``documents``."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
