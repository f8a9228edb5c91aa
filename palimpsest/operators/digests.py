"""Digests of sessions and of a whole life: extractive summaries under four policies, and what survives in them."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT, Config
from ..functions import text as text_functions

#: Turns that a session's digest and a life's digest hold.
SESSION, LIFE = 3, 5
#: Sessions after which the tiered policy reads everything again, and last sessions whose digests it reads else.
EVERY, WINDOW = 4, 5
POLICIES = ("P1_full_rewrite", "P2_incremental", "P3_tiered", "P4_all_digests")

#: A turn: its place, and its roots.
Unit = tuple[int, frozenset]


def extract(units: list[Unit], k: int) -> list[Unit]:
    """The ``k`` units whose roots are in the most of the units, on average, in their order; ties to the earlier. What is kept depends on what it is kept from."""
    common = Counter(r for _, roots in units for r in roots)
    return sorted(sorted(units, key=lambda u: (-(sum(common[r] for r in u[1]) * 1_000_000 // len(u[1])), u[0]))[:k])


@dataclass
class Chain:
    """The digests of one owner, as its sessions come. Only the incremental policy needs no more than its last digest; the others read what they are defined to read."""

    sessions: int = 0
    history: list[Unit] = field(default_factory=list)
    digests: list[list[Unit]] = field(default_factory=list)
    items: list[frozenset] = field(default_factory=list)
    lives: dict[str, tuple[int, list[Unit]]] = field(default_factory=dict)

    def step(self, units: list[Unit], items: list[frozenset]) -> list[tuple]:
        """(policy, depth, digest, items, survived) after one more session. A digest of turns has depth 1, a digest of digests one more than they."""
        self.sessions += 1
        self.history += units
        self.items += items
        self.digests.append(extract(units, SESSION))
        sources = {
            "P1_full_rewrite": (0, self.history), "P2_incremental": self.after("P2_incremental", 1),
            "P3_tiered": (0, self.history) if self.sessions % EVERY == 0 else self.after("P3_tiered", WINDOW), "P4_all_digests": (1, [u for d in self.digests for u in d]),
        }
        self.lives = {policy: (depth + 1, extract(source, LIFE)) for policy, (depth, source) in sources.items()}
        return [(policy, depth, ",".join(str(at) for at, _ in life), len(self.items), self.survived(life)) for policy, (depth, life) in self.lives.items()]

    def after(self, policy: str, last: int) -> tuple[int, list[Unit]]:
        """The last digest of a policy and those of the last sessions, and how deep they are."""
        depth, life = self.lives.get(policy, (1, []))
        return depth, list(dict([*life, *(u for d in self.digests[-last:] for u in d)]).items())

    def survived(self, life: list[Unit]) -> int:
        told = frozenset().union(*(roots for _, roots in life))
        return sum(2 * len(i & told) >= len(i) for i in self.items)


def chains(turns: DataFrame, item: Column, config: Config = DEFAULT) -> DataFrame:
    """``turns(owner, session, at, text)`` -> owner, session, policy, depth, digest, items, survived after every session of an owner.

    ``at`` numbers the turns of an owner, rising with its sessions; ``item`` tells which turns are to survive: those with half of their roots in the digest
    do. ``digest`` lists the turns that it holds. Turns without roots (null or empty texts) are left aside, and so is a session that has no others; of rows of
    one session and ``at`` the first counts, by roots. Rows without an owner are an owner of their own.
    Owners are dealt over tasks; a task holds the roots of one owner's turns."""
    rows = turns.select("owner", "session", "at", item.alias("item"), text_functions.roots(F.col("text"), config.pack).alias("roots")).where(F.size("roots") > 0)
    told = [T.StructField("policy", T.StringType()), T.StructField("depth", T.LongType()), T.StructField("digest", T.StringType()), T.StructField("items", T.LongType()), T.StructField("survived", T.LongType())]
    schema = T.StructType([turns.schema["owner"], turns.schema["session"], *told])

    def fold(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        now, chain, units, items = None, None, [], []

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows), kinds)], schema=kinds)

        for batch in batches:
            out = []
            for owner, session, at, wanted, roots in zip(*(batch.column(c).to_pylist() for c in ("owner", "session", "at", "item", "roots"))):
                if chain is None or (owner, session) != now:
                    if chain is not None:
                        out += [(*now, *x) for x in chain.step(units, items)]
                    if chain is None or owner != now[0]:
                        chain = Chain()
                    now, units, items = (owner, session), [], []
                if units and units[-1][0] == at:
                    continue
                units.append((at, frozenset(roots)))
                if wanted:
                    items.append(units[-1][1])
            if out:
                yield batch_of(out)
        if chain is not None:
            yield batch_of([(*now, *x) for x in chain.step(units, items)])

    return rows.repartition("owner").sortWithinPartitions("owner", "session", "at", "roots", "item").mapInArrow(fold, schema)
