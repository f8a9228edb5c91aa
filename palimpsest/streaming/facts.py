"""The fact upsert as a stream: state per (subject, predicate); the first live objects of a key lie together, the others are the keys of a map state, one entry each."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import DEFAULT, Config
from ..operators.facts import KEY, ORDER, OneValue, mutability


def in_order(row: Row) -> tuple:
    """The order of statements; without a time or an id they come last."""
    return tuple(p for c in ORDER for p in (row[c] is None, 0 if row[c] is None else row[c]))


#: Live objects of a key that lie together and are read at once; each further one is an entry of its own.
FIRST = 64


class Upsert(StatefulProcessor):
    """A statement touches one value of its key, which holds FIRST objects at most, and the entry of its own object if there are more, however many objects the key has.
    Most keys have few, so a key costs two exchanges with the state in a micro-batch, not two an object."""

    def __init__(self, config: Config):
        self.config = config

    def init(self, handle: StatefulProcessorHandle) -> None:
        # of a key with one value: the live object and its confidence; of others: the first objects that are live, and whether there are more
        self.held = handle.getValueState("held", "object string, confidence double, first array<string>, more boolean")
        self.live = handle.getMapState("live", "object string", "since long")  # objects beyond the first

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        predicate = key[1]
        batch = sorted(rows, key=in_order)  # one micro-batch of one key; the source's trigger bounds it
        one = predicate in self.config.pack.cardinality_one
        old = self.held.get()
        step, told = self.one(predicate, old) if one else self.many(old)
        for r in batch:
            yield Row(id=r.id, subject=r.subject, predicate=r.predicate, object=r.object, action=step(r.id, r.object, math.nan if r.confidence is None else r.confidence))
        if (new := told()) is not None:
            self.held.update(new)

    def one(self, predicate: str, old: tuple | None):
        now = OneValue(self.config.tolerance[mutability(predicate, self.config)], self.config.reinforce, *(old[:2] if old else (None, 0.0)))
        return lambda _, obj, confidence: now.step(obj, confidence), lambda: (now.live, now.confidence, None, None)

    def many(self, old: tuple | None):
        first, more = (list(old[2]), old[3]) if old else ([], False)
        few, was = len(first), more
        known = dict.fromkeys(first, True)  # other objects of this batch are looked up once, and not at all where the key has no more than these

        def step(number: int, obj: str, confidence: float) -> str:
            nonlocal more
            if obj not in known:
                known[obj] = was and self.live.containsKey((obj,))
            if known[obj]:
                return "reinforced"
            if first and confidence < self.config.confidence_floor:
                return "held"
            if len(first) < FIRST:
                first.append(obj)
            else:
                self.live.updateValue((obj,), (number,))
                more = True
            known[obj] = True
            return "created" if len(first) == 1 else "coexist"

        return step, lambda: (None, None, first, more) if len(first) > few or more != was else None

    def close(self) -> None:
        pass


def actions(statements: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(id, subject, predicate, object, action) of a stream of statements. Within a micro-batch a key's statements are taken in order of
    time and id; over batches they must arrive in order. State lies in RocksDB (``streaming.keyed_state``)."""
    out = "id long, subject long, predicate string, object string, action string"
    return statements.groupBy(*KEY).transformWithState(statefulProcessor=Upsert(config), outputStructType=out, outputMode="append", timeMode="none")
