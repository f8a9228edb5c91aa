"""Operator 9, a content-addressed store of token ids.

Documents become id streams; a rolling hash over the last few ids cuts each stream into chunks, so equal passages give equal
chunks wherever they stand. A chunk's name is the BLAKE2b hash of its bytes, and each distinct chunk is written once. A
recipe lists a document's chunk names in order, with the Merkle root over them; a manifest has one root per file of recipes and the
root over those. Reading verifies every chunk against its name, every document against its root, the documents of every file
against the manifest's root and counts, and the manifest against the root over all: what is lost or changed raises an error.

Layout below the store's path, all Parquet: ``content/kind=chunk`` (name, ids, n_tokens), ``ordered/kind=recipe`` (part, within,
doc_id, n_tokens, chunks, root; in doc_id order over files and rows) and ``manifest`` (part, documents, tokens, root, last_doc_id, first, parts, whole). A
document's place among all ids is its part's ``first`` plus its own ``within``.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import modest, scratch, table
from .tokens import MORE_BYTES, REMEMBER_MORE, encoder, slices

#: Ids that the rolling hash looks back on, and the least, usual and greatest length of a chunk.
REACH, LEAST, USUAL, GREATEST = 8, 64, 512, 4096
#: Names of chunks that a task remembers having sent on (about 100 bytes each); a chunk may be sent again, but is stored once.
SENT = 500_000


@lru_cache(maxsize=4)
def gear(vocabulary: int) -> np.ndarray:
    """A fixed random number for every id."""
    return np.random.default_rng(20_011).integers(0, 1 << 63, vocabulary, dtype=np.uint64)


def cuts(ids: np.ndarray, stops: np.ndarray, vocabulary: int) -> list[int]:
    """Where chunks end in a run of documents that end at ``stops``; no chunk spans two documents.

    The hash of a place mixes its last REACH ids; the places where its low bits vanish are cut unless a chunk would be shorter
    than LEAST, and no chunk is longer than GREATEST."""
    g = gear(vocabulary)[ids]
    h = g.copy()
    for back in range(1, REACH):
        h[back:] += g[:-back] << np.uint64(back)
    places = np.flatnonzero((h >> np.uint64(16)) % np.uint64(USUAL) == 0) + 1
    out, at, k = [], 0, 0
    places = places.tolist()
    for stop in stops.tolist():
        while at < stop:
            while k < len(places) and places[k] < at + LEAST:
                k += 1
            end = min(stop, at + GREATEST, places[k] if k < len(places) else stop)
            out.append(end)
            at = end
    return out


def merkle(names: list[bytes]) -> bytes:
    """The root of a binary tree over names; an odd one moves up as it is."""
    level = names or [b""]
    while len(level) > 1:
        level = [hashlib.blake2b(b"".join(level[i : i + 2]), digest_size=16).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def _layout(doc_id: T.DataType) -> tuple[T.StructType, T.StructType]:
    """The schemas of ``content`` and ``ordered``."""
    field, chunk = T.StructField, T.StructType([T.StructField("name", T.BinaryType()), T.StructField("n", T.LongType())])
    content = [field("kind", T.StringType()), field("name", T.BinaryType()), field("ids", T.BinaryType()), field("doc_id", doc_id), field("n_tokens", T.LongType()), field("chunks", T.ArrayType(chunk))]
    ordered = [content[0], field("part", T.LongType()), field("within", T.LongType()), *content[3:], field("root", T.BinaryType())]
    return T.StructType(content), T.StructType(ordered)


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2) -> None:
    """Writes all ``docs(doc_id, text)`` to a store at ``path``.

    Every row is a document: a null or empty text has the end id alone; rows are ordered by doc_id (null first), equal ids by their
    content, so repeated rows stand side by side; other columns are ignored; an empty table gives an empty store."""
    spark = docs.sparkSession
    made, ordered = _layout(docs.schema["doc_id"].dataType)

    def chunked(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, encode, sent = to_arrow_schema(made), encoder(tokenizer, REMEMBER_MORE), set()
        for whole in batches:
            for batch in slices(whole, MORE_BYTES):
                ids, stops = encode(batch.column(1).to_pylist(), end_id)
                raw, width = memoryview(ids.tobytes()), ids.dtype.itemsize
                names, blobs, sizes, recipes, at, ends = [], [], [], [], 0, iter(cuts(ids, stops, len(encode.spaced)))
                start = 0
                for stop in stops.tolist():
                    recipe = []
                    while at < stop:
                        end = next(ends)
                        blob = raw[at * width : end * width]
                        name = hashlib.blake2b(blob, digest_size=16).digest()
                        recipe.append({"name": name, "n": end - at})
                        if name not in sent:
                            sent.add(name)
                            names.append(name)
                            blobs.append(bytes(blob))
                            sizes.append(end - at)
                        at = end
                    recipes.append((stop - start, recipe))
                    start = stop
                if len(sent) > SENT:
                    sent.clear()
                c, d = len(names), len(recipes)
                yield pa.RecordBatch.from_arrays([
                    pa.array(["chunk"] * c + ["recipe"] * d), pa.array(names + [merkle([x["name"] for x in r]) for _, r in recipes], pa.binary()), pa.array(blobs + [None] * d, pa.binary()),
                    pa.concat_arrays([pa.nulls(c, schema.field("doc_id").type), batch.column(0).cast(schema.field("doc_id").type)]),
                    pa.array(sizes + [n for n, _ in recipes], pa.int64()), pa.array([None] * c + [r for _, r in recipes], schema.field("chunks").type),
                ], schema=schema)

    # equal chunks meet by name, of which each task has sent one; a recipe is always written
    copy = F.row_number().over(Window.partitionBy("kind", "name", "doc_id").orderBy("n_tokens"))
    once = modest(docs.select("doc_id", "text")).mapInArrow(chunked, made).withColumn("copy", copy).where("kind = 'recipe' OR copy = 1").drop("copy")
    once.write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/content")
    recipes = spark.read.schema(made).parquet(f"{path}/content").where("kind = 'recipe'").select("doc_id", "n_tokens", "chunks", F.col("name").alias("root"))
    order = ["doc_id", "root", "n_tokens"]

    def placed(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, part, at, roots, last_id = to_arrow_schema(ordered), TaskContext.get().partitionId(), 0, [], None
        for batch in batches:
            n, rows = batch.column("n_tokens").to_numpy(), batch.num_rows
            within = at + np.cumsum(n) - n
            at += int(n.sum())
            roots += batch.column("root").to_pylist()
            last_id = batch.column("doc_id")[rows - 1].as_py() if rows else last_id
            yield pa.RecordBatch.from_arrays([pa.array(["recipe"] * rows), pa.array([part] * rows, pa.int64()), pa.array(within, pa.int64()), *(batch.column(f).cast(schema.field(f).type) for f in ("doc_id", "n_tokens", "chunks", "root"))], schema=schema)
        if roots:
            last = {"kind": "part", "part": part, "within": len(roots), "doc_id": last_id, "n_tokens": at, "chunks": None, "root": merkle(roots)}
            yield pa.RecordBatch.from_pylist([last], schema=schema)

    recipes.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(placed, ordered).write.partitionBy("kind").parquet(f"{path}/ordered")
    parts = spark.read.schema(ordered).parquet(f"{path}/ordered").where("kind = 'part'")  # one row a file
    listed = parts.select("part", F.col("within").alias("documents"), F.col("n_tokens").alias("tokens"), "root", F.col("doc_id").alias("last_doc_id"))
    listed.coalesce(1).sortWithinPartitions("part").mapInArrow(_listing, _manifest(listed.schema)).write.parquet(f"{path}/manifest")


def _manifest(listed: T.StructType) -> T.StructType:
    """The schema of ``manifest``: ``whole`` is the root over the roots of all parts."""
    return T.StructType([*listed.fields, T.StructField("first", T.LongType()), T.StructField("parts", T.LongType()), T.StructField("whole", T.BinaryType())])


def _listing(batches):
    """Adds to the parts, which come in order in one task, the ids before each and the root over all; there is one row a file."""
    held = list(batches)
    if not held:
        return
    parts = pa.Table.from_batches(held)
    tokens, roots = parts.column("tokens").to_numpy(), parts.column("root").to_pylist()
    for name, values in (("first", np.cumsum(tokens) - tokens), ("parts", [len(roots)] * len(roots)), ("whole", [merkle(roots)] * len(roots))):
        parts = parts.append_column(name, pa.array(values, pa.binary() if name == "whole" else pa.int64()))
    yield from parts.combine_chunks().to_batches()


def _parts_of(batches):
    """(part, documents, tokens, root) from recipes that come sorted by part and place; a gap between two of them gives no root."""
    at, documents, tokens, roots, gap = None, 0, 0, [], False

    def done():
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([documents], pa.int64()), pa.array([tokens], pa.int64()), pa.array([None if gap else merkle(roots)], pa.binary())], names=["part", "documents", "tokens", "root"])

    for batch in batches:
        for part, within, n, root in zip(*(batch.column(c).to_pylist() for c in ("part", "within", "n_tokens", "root"))):
            if part != at:
                if at is not None:
                    yield done()
                at, documents, tokens, roots, gap = part, 0, 0, [], False
            gap |= within != tokens
            documents, tokens = documents + 1, tokens + n
            roots.append(root)
    if at is not None:
        yield done()


def check_manifest(spark: SparkSession, path: str) -> None:
    """Raises unless the recipes are those that the manifest lists: every part's documents, tokens and root, and the root over all parts.

    Only (part, place, tokens, root) of the recipes is shuffled, by part, which is one file each; the manifest has one row a file."""
    manifest = spark.read.parquet(f"{path}/manifest")
    listed = manifest.orderBy("part").select("root", "parts", "whole").collect()
    if listed and ({r.parts for r in listed} != {len(listed)} or {bytes(r.whole) for r in listed} != {merkle([bytes(r.root) for r in listed])}):
        raise ValueError(f"the manifest of {path} does not match its root: parts are missing or changed")
    ordered = _layout(manifest.schema["last_doc_id"].dataType)[1]
    recipes = spark.read.schema(ordered).parquet(f"{path}/ordered").where("kind = 'recipe'").select("part", "within", "n_tokens", "root")
    found = recipes.repartition("part").sortWithinPartitions("part", "within").mapInArrow(_parts_of, "part long, documents long, tokens long, root binary")
    same = ["part", "documents", "tokens", "root"]
    odd = manifest.select(*same, F.lit(1).alias("side")).unionByName(found.withColumn("side", F.lit(2))).groupBy(*same).agg(F.sum("side").alias("sides")).where("sides <> 3").agg(F.count("*").alias("n"), F.min("part").alias("part")).first()
    if odd.n:
        raise ValueError(f"recipes of {path} are missing or changed: part {odd.part} is not as the manifest has it")


def verified(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Chunks (name, ids, n, crc) and their uses (start, doc_id, n_tokens, name, pos, after), each checked against its hash as it is read.

    The recipes are first held against the manifest (:func:`check_manifest`)."""
    check_manifest(spark, path)
    whole = spark.read.parquet(f"{path}/manifest")
    manifest, (content, ordered) = whole.select("part", "first"), _layout(whole.schema["last_doc_id"].dataType)
    chunks = spark.read.schema(content).parquet(f"{path}/content").where("kind = 'chunk'").select("name", "ids", "n_tokens")
    recipes = spark.read.schema(ordered).parquet(f"{path}/ordered").where("kind = 'recipe'").select("part", "within", "doc_id", "n_tokens", "chunks", "root")

    def check(batches):
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            crcs = []
            for name, blob, n in rows:
                if hashlib.blake2b(blob, digest_size=16).digest() != name:
                    raise ValueError(f"chunk {name.hex()} does not match its name")
                crcs.append(zlib.crc32(np.frombuffer(blob, f"<u{len(blob) // n}").astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(crcs, pa.int64())], names=["name", "ids", "n", "crc"])

    uses = T.StructType([*recipes.select("part", "within", "doc_id", "n_tokens").schema.fields])
    for name, t in (("name", T.BinaryType()), ("pos", T.LongType()), ("after", T.LongType())):
        uses.add(name, t)

    def spread(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(uses)
        for batch in batches:
            rows, out = batch.select(["part", "within", "n_tokens"]).to_pylist(), {"at": [], "name": [], "pos": [], "after": []}
            for i, (row, recipe, root) in enumerate(zip(rows, batch.column("chunks").to_pylist(), batch.column("root").to_pylist())):
                left = row["n_tokens"]
                if merkle([c["name"] for c in recipe]) != root or sum(c["n"] for c in recipe) != left:
                    raise ValueError(f"the recipe at part {row['part']}, {row['within']} does not match its root")
                for pos, c in enumerate(recipe):
                    left -= c["n"]
                    for key, value in (("at", i), ("name", c["name"]), ("pos", pos), ("after", left)):
                        out[key].append(value)
            at = pa.array(out["at"], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).cast(schema.field(c).type).take(at) for c in schema.names[:4]), *(pa.array(out[c], schema.field(c).type) for c in schema.names[4:])], schema=schema)

    placed = recipes.mapInArrow(spread, uses).join(manifest, "part").withColumn("start", F.col("first") + F.col("within")).drop("part", "first", "within")
    with_crc = T.StructType([T.StructField("name", T.BinaryType()), T.StructField("ids", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("crc", T.LongType())])
    return chunks.mapInArrow(check, with_crc), placed


@lru_cache(maxsize=1)
def _shifts() -> list[np.ndarray]:
    """For every k, what 2**k zero bytes after a text do to its CRC-32 state: four tables by the state's bytes."""
    one = np.zeros(32, np.uint64)  # a zero byte as a matrix over bits
    for bit in range(32):
        state = 1 << bit
        for _ in range(8):
            state = state >> 1 ^ (0xEDB88320 if state & 1 else 0)
        one[bit] = state

    def apply(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
        return tables[0][x & np.uint64(255)] ^ tables[1][x >> np.uint64(8) & np.uint64(255)] ^ tables[2][x >> np.uint64(16) & np.uint64(255)] ^ tables[3][x >> np.uint64(24)]

    out, byte = [], np.arange(256)
    for _ in range(48):
        tables = np.zeros((4, 256), np.uint64)
        for bit in range(32):
            tables[bit // 8][byte >> bit % 8 & 1 == 1] ^= one[bit]
        out.append(tables)
        one = apply(tables, one)
    return out


def shifted(crc: np.ndarray, count: np.ndarray) -> np.ndarray:
    """What each CRC-32 adds, by exclusive or, to the CRC-32 of a text in which ``count`` bytes follow."""
    x = crc.astype(np.uint64)
    for k, t in enumerate(_shifts()):
        on = np.flatnonzero(count >> k & 1)
        y = x[on]
        x[on] = t[0][y & np.uint64(255)] ^ t[1][y >> np.uint64(8) & np.uint64(255)] ^ t[2][y >> np.uint64(16) & np.uint64(255)] ^ t[3][y >> np.uint64(24)]
        if not (count >> (k + 1)).any():
            break
    return x.astype(np.int64)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the store's files.

    Chunks are read once and checked; a document's CRC-32 follows from its chunks' by CRC arithmetic, so ids need not be shuffled."""
    chunks, uses = verified(spark, path)

    @F.pandas_udf("long")
    def part(crc: pd.Series, after: pd.Series) -> pd.Series:
        return pd.Series(shifted(crc.to_numpy(np.int64), after.to_numpy(np.int64) * 4))

    found = uses.join(chunks.select("name", "n", "crc"), "name", "left")
    whole = found.select("start", "doc_id", "n_tokens", "n", part(F.coalesce("crc", F.lit(0)), "after").alias("crc")).groupBy("start", "doc_id", "n_tokens").agg(F.bit_xor("crc").alias("ids_crc32"), F.sum("n").alias("n"))
    return whole.select("doc_id", "start", "n_tokens", _whole(F.col("ids_crc32")).alias("ids_crc32"))


def _whole(value: F.Column) -> F.Column:
    """``value`` if the chunks at hand have all ``n_tokens`` of their document, else an error."""
    lost = F.raise_error(F.concat(F.lit("chunks are missing for the document at id "), F.col("start").cast("string")))
    return F.when(F.coalesce("n", F.lit(0)) == F.col("n_tokens"), value).otherwise(lost)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) with each document's ids rebuilt from its chunks, little-endian and as wide as stored."""
    chunks, uses = verified(spark, path)
    rows = uses.join(chunks.select("name", "n", "ids"), "name", "left").groupBy("start", "doc_id", "n_tokens").agg(F.sort_array(F.collect_list(F.struct("pos", "ids"))).alias("c"), F.sum("n").alias("n"))
    return rows.select("doc_id", "start", _whole(F.aggregate("c", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))).alias("ids"))


def op9_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of all ``documents``, from a store that is written and read back; end id 2."""
    import public_tokenizers

    path = scratch(spark, "store")
    write_store(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return digests(spark, path)
