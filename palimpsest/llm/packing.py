"""Operator 1, packing: bounded-space online best fit over token ids, with leftovers merged at the end.

Every partition keeps a fixed number of open windows. A document gives whole windows first; what remains goes to the open
window that it fills best. When none fits, the fullest window is topped up with the beginning of the document and emitted,
so emitted windows have no padding. A partition's open windows are poured together at its end, which leaves at most one
partial window; groups of partial windows are merged over as many rounds as the number of partitions asks for, and the one
that is left is split into sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import modest, stash, table
from .tokens import MORE_BYTES, REMEMBER, REMEMBER_MORE, encoder, slices

#: Partial windows that one task merges in a round (each has fewer than ``size`` ids).
MERGE = 256


class Packer:
    """Open windows of one task. A piece is (document, start, ids, ids of the whole document)."""

    def __init__(self, size: int, windows: int, emit):
        self.size, self.windows, self.emit = size, windows, emit
        self.open: list[tuple[int, list]] = []

    def put(self, slot: int | None, piece: tuple) -> None:
        used, pieces = self.open.pop(slot) if slot is not None else (0, [])
        used += len(piece[2])
        pieces.append(piece)
        if used == self.size:
            self.emit(pieces)
        else:
            self.open.append((used, pieces))

    def add(self, doc, ids: np.ndarray, start: int = 0, total: int | None = None) -> None:
        total = len(ids) if total is None else total
        at = 0
        while len(ids) - at >= self.size:
            self.put(None, (doc, start + at, ids[at : at + self.size], total))
            at += self.size
        if at == len(ids):
            return
        rest, slacks = len(ids) - at, [self.size - used for used, _ in self.open]
        if fits := [(slack, i) for i, slack in enumerate(slacks) if slack >= rest]:
            return self.put(min(fits)[1], (doc, start + at, ids[at:], total))
        if len(self.open) >= self.windows:
            slack, slot = min((slack, i) for i, slack in enumerate(slacks))
            self.put(slot, (doc, start + at, ids[at : at + slack], total))
            at += slack
        self.put(None, (doc, start + at, ids[at:], total))

    def pour(self) -> list:
        """Empties the open windows into full ones, cutting freely; the pieces of the partial window that is left."""
        left = [p for _, pieces in sorted(self.open, key=lambda w: -w[0]) for p in pieces]
        self.open = []
        return fill(left, self.size, self.emit)


def fill(pieces: list, size: int, emit) -> list:
    """Lays pieces end to end and emits every ``size`` ids; returns the pieces of the rest."""
    used, window = 0, []
    for doc, start, ids, total in pieces:
        at = 0
        while at < len(ids):
            take = min(size - used, len(ids) - at)
            window.append((doc, start + at, ids[at : at + take], total))
            at += take
            used += take
            if used == size:
                emit(window)
                used, window = 0, []
    return window


class Rows:
    """Collects rows of pieces for Arrow."""

    def __init__(self, schema: pa.Schema, base: int, with_ids: bool):
        self.schema, self.base, self.with_ids, self.sequences, self.rows = schema, base, with_ids, 0, []

    def emit(self, pieces: list) -> None:
        self.add(pieces, self.base + self.sequences, self.with_ids)
        self.sequences += 1

    def add(self, pieces: list, sequence: int | None, with_ids: bool) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            raw = ids.astype("<u4").tobytes()
            self.rows.append((doc, start, len(ids), zlib.crc32(raw), total, sequence, offset, self.base >> 32, raw if with_ids or sequence is None else None))
            offset += len(ids)

    def batch(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        columns = list(zip(*rows)) if rows else [[]] * len(self.schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema)], schema=self.schema)


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, windows: int = 16, end_id: int = 1, with_ids: bool = True, remember: int = REMEMBER) -> DataFrame:
    """Packs ``docs(doc_id, text)`` into sequences of at most ``size`` ids, a power of two. One row per piece.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if ``with_ids``, ids (little-endian
    unsigned 32-bit). A null or empty text is a document of the end id alone; a null doc_id stays null; repeated rows are
    packed each; an empty table gives no rows; other columns of ``docs`` are ignored. Sequences have ``size`` ids, but for
    the last few of the corpus, whose lengths are powers of two. A task holds ``windows`` open windows, whatever it reads, and
    ``remember`` words of the encoder.
    """
    if size & (size - 1):
        raise ValueError("size must be a power of two")
    spark = docs.sparkSession
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType)])
    for name in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "part"):
        schema.add(name, T.LongType())
    schema.add("ids", T.BinaryType())

    def windows_of(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        out = Rows(to_arrow_schema(schema), TaskContext.get().partitionId() << 32, with_ids)
        packer = Packer(size, windows, out.emit)
        encode, most = encoder(tokenizer, remember), MORE_BYTES if remember >= REMEMBER_MORE else MORE_BYTES // 4
        for whole in batches:
            for batch in slices(whole, most):
                ids, stops = encode(batch.column(1).to_pylist(), end_id)
                at = 0
                for doc, stop in zip(batch.column(0).to_pylist(), stops.tolist()):
                    packer.add(doc, ids[at:stop].copy())  # a slice would keep the whole batch in memory
                    at = stop
                yield out.batch()
        out.add(packer.pour(), None, True)
        yield out.batch()

    made = stash(modest(docs.select("doc_id", "text")).mapInArrow(windows_of, schema), "packed")
    done, left = [made.where(F.col("sequence_id").isNotNull())], made.where(F.col("sequence_id").isNull())
    groups, level = (made.agg(F.max("part")).first()[0] or 0) + 1, 1
    while True:
        last = groups <= MERGE
        merged = stash(left.withColumn("group", F.floor(F.col("part") / MERGE)).groupBy("group").applyInArrow(_merging(schema, size, level, with_ids, last), schema), "merged")
        done.append(merged.where(F.col("sequence_id").isNotNull()))
        if last:
            break
        left, groups, level = merged.where(F.col("sequence_id").isNull()), -(-groups // MERGE), level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("part") if with_ids else out.drop("part", "ids")


def _merging(schema: T.StructType, size: int, level: int, with_ids: bool, last: bool):
    """Merges the partial windows of a group; of the last group of all, what is left becomes sequences of powers of two."""

    def merge(group: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        rows = group.sort_by([("part", "ascending"), ("offset", "ascending")]).to_pylist()
        number = rows[0]["part"] // MERGE
        out = Rows(to_arrow_schema(schema), level << 56 | number << 32, with_ids)
        rest = fill([(r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4"), r["doc_tokens"]) for r in rows], size, out.emit)
        if last:
            for power in range(size.bit_length() - 1, -1, -1):
                if sum(len(p[2]) for p in rest) >> power & 1:
                    full: list = []
                    rest = fill_first(rest, 1 << power, full)
                    out.emit(full)
        else:
            out.base = number << 32
            out.add(rest, None, True)
        return pa.Table.from_batches([out.batch()])

    return merge


def fill_first(pieces: list, size: int, into: list) -> list:
    """Moves the first ``size`` ids to ``into``; returns the pieces of the rest."""
    rest = []
    for doc, start, ids, total in pieces:
        take = min(size, len(ids))
        if take:
            into.append((doc, start, ids[:take], total))
        if take < len(ids):
            rest.append((doc, start + take, ids[take:], total))
        size -= take
    return rest


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all ``documents`` in sequences of 2048: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False, remember=REMEMBER_MORE)
