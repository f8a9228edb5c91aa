"""Operator 10, mixing to target weights: iterative proportional fitting of token weights, then calibrated sampling.

The corpus is first summed to cells (source, language, topic) of tokens. Raking finds a factor for every source, language and
topic such that the weighted tokens have the target share in every margin. Sources may be very many, so their factors stay in
Spark: every sweep is one aggregation over the cells that gives the source factors and, summed over sources, one small table
of languages by topics on which the driver updates those two. Sweeps end when every margin is within ``TOLERANCE`` of its target.
A document is kept with a probability in proportion to its cell's weight, at most 1, at the one rate that makes the expected
tokens of the sample the budget, by a hash of its id, so the sample is the same on every run.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stash, table

#: Targets are shares to this power, made to sum to one: below 1 rare groups gain.
FLATTEN = 0.9
#: The largest error of a margin, as a share of all tokens, and the sweeps that are made at most to get there.
TOLERANCE, SWEEPS = 1e-4, 20
#: The share of the corpus's tokens that the sample is to have.
BUDGET = 0.5
#: Languages times topics at most; their factors are on the driver and in the plan.
MOST = 20_000
MISSING = "unknown"
#: Groups of hashed words that topics are made of.
GROUPS = 8


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]"), lambda w: w != "")


def group_counts(words: Column) -> Column:
    """How many words of each of the hashed groups an array has."""
    groups = F.transform(words, lambda w: F.pmod(F.ascii(w) * 31 + F.ascii(F.substring(w, 2, 1)) * 7 + F.ascii(F.substring(w, 3, 1)) * 3 + F.length(w), F.lit(GROUPS)))
    return F.get(F.transform(F.array(groups), lambda g: F.transform(F.sequence(F.lit(0), F.lit(GROUPS - 1)), lambda k: F.size(F.filter(g, lambda x: x == k)).cast("long"))), F.lit(0))


def keyed(docs: DataFrame, source: str = "source", lang: str = "lang", topic: str | None = None) -> list[Column]:
    """Columns s and l (null is ``MISSING``), tokens (words, at least one), and of topics either t, from a column, or the counts of word groups."""
    key = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(MISSING))
    words = words_of(F.col("text"))
    return [key(source).alias("s"), key(lang).alias("l"), F.greatest(F.lit(1), F.size(words)).cast("long").alias("tokens"), key(topic).alias("t") if topic else group_counts(words).alias("counts")]


def usage(rows: DataFrame) -> DataFrame | None:
    """(l, used, whole): how many words of each group, and in all, a language has in ``rows(l, counts, ..)``; None if topics are a column."""
    if "counts" not in rows.columns:
        return None
    used = rows.groupBy("l").agg(F.array(*(F.sum(F.col("counts")[k]) for k in range(GROUPS))).alias("used"))
    return stash(used.withColumn("whole", F.aggregate("used", F.lit(0).cast("long"), lambda a, x: a + x).cast("double")), "usage")


def with_topics(rows: DataFrame, used: DataFrame | None) -> DataFrame:
    """``rows(l, counts, ..)`` with t in place of counts: the group of words that a document uses most beyond its language's share of it.

    Of equal groups the first counts. Rows that have t already stay as they are."""
    if used is None:
        return rows
    n = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    beyond = F.array(*((F.col("counts")[k] + 1) * F.col("whole") / (n * F.col("used")[k].cast("double") + (F.col("whole") + 1)) for k in range(GROUPS)))
    joined = rows.join(F.broadcast(used) if used.count() <= MOST else used, "l").withColumn("beyond", beyond)
    return joined.withColumn("t", F.concat(F.lit("words"), (F.array_position("beyond", F.array_max("beyond")) - 1).cast("string"))).drop("counts", "used", "whole", "beyond")


def flattened(shares: dict[str, float], power: float) -> dict[str, float]:
    whole = sum(v**power for v in shares.values()) or 1.0
    return {k: v**power / whole for k, v in shares.items()}


def _factor(key: str, factors: dict[str, float]) -> Column:
    """A column's factor from a small table; a key that is not in it has none."""
    if not factors:
        return F.lit(0.0)
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in sorted(factors.items()) for x in kv)), F.col(key)), F.lit(0.0))


class Mixture:
    """Raking factors: ``sources`` is a frame (s, a), ``languages`` and ``topics`` are dictionaries; ``rate`` times a weight is a probability; ``error`` is the largest error of a margin."""

    def __init__(self, rows: DataFrame, targets: dict[str, dict[str, float]] | None = None, power: float = FLATTEN, budget: float = BUDGET, tolerance: float = TOLERANCE, sweeps: int = SWEEPS):
        """Rakes ``rows(s, l, t, tokens)``. ``targets`` may give shares by name under ``source``, ``language`` or ``topic``, where a group
        that is not named gets none; all others are the corpus's own shares to the power ``power``, made to sum to one. Those of
        sources may also be a frame (s, goal), as they can be very many. ``budget`` is the share of all tokens to be kept. Targets that no
        weights can meet together end in a warning that names the error that is left."""
        targets = targets or {}
        if unknown := set(targets) - {"source", "language", "topic"}:
            raise ValueError(f"unknown targets: {', '.join(sorted(unknown))}")
        cells = rows.groupBy("s", "l", "t").agg(F.sum("tokens").cast("double").alias("n"))
        cells = stash(cells, "cells")
        cells = stash(self._with_goals(cells, targets.get("source"), power), "cells_with_goals")
        pairs = stash(cells.groupBy("l", "t").agg(F.sum("n").alias("n")), "pairs")
        if pairs.count() > MOST:
            raise ValueError(f"more than {MOST} pairs of languages and topics; give coarser columns")
        margins = self._margins(pairs)
        self.whole = sum(margins.values())
        want = []
        for at, name in enumerate(("language", "topic")):
            own = {k: sum(v for lt, v in sorted(margins.items()) if lt[at] == k) for k in sorted({lt[at] for lt in margins})}
            want.append(targets.get(name) or flattened(own, power))
        b, c = (dict.fromkeys(w, 1.0) for w in want)
        self.error = 0.0
        for sweep in range(sweeps + 1 if margins else 0):
            m = self._margins(cells.join(self._sources(cells, b, c), "s").groupBy("l", "t").agg(F.sum(F.col("n") * F.col("a")).alias("n")))
            share = lambda key, at: sum(v * b.get(k[0], 0.0) * c.get(k[1], 0.0) for k, v in sorted(m.items()) if k[at] == key)
            self.error = max(abs(share(key, at) - goal) for at in (0, 1) for key, goal in want[at].items())
            if self.error <= tolerance or sweep == sweeps:
                break
            for mine, goals, at in ((b, want[0], 0), (c, want[1], 1)):
                for key in sorted(mine):
                    got = share(key, at)
                    mine[key] *= goals[key] / got if got > 0 else 1.0
        if self.error > tolerance:
            warnings.warn(f"after {sweep} sweeps a margin is still off by {self.error:.6f} of all tokens", stacklevel=2)
        self.languages, self.topics = b, c
        self.sources = stash(self._sources(cells, b, c), "source_factors")
        self.known = self.sources.count()
        self.rate = self._rate(stash(cells.join(self.sources, "s").select("n", self.weight().alias("weight")).where("weight > 0"), "weights"), budget * self.whole)

    @staticmethod
    def _margins(cells: DataFrame) -> dict[tuple[str, str], float]:
        return {(r.l, r.t): r.n for r in cells.collect()}

    @staticmethod
    def _rate(cells: DataFrame, budget: float) -> float:
        """The rate at which ``cells(n, weight)`` are expected to give ``budget`` tokens: every round takes those at probability 1 out, until no more get there."""
        rate, taken = 0.0, -1
        while True:
            sure = F.col("weight") * F.lit(rate) >= 1
            count, full, rest = cells.agg(F.count_if(sure), F.sum(F.when(sure, F.col("n")).otherwise(0.0)), F.sum(F.when(~sure, F.col("n") * F.col("weight")).otherwise(0.0))).first()
            if not rest or count == taken:
                return rate or 1.0
            taken, rate = count, max(rate, (budget - full) / rest)

    @staticmethod
    def _with_goals(cells: DataFrame, given: dict[str, float] | DataFrame | None, power: float) -> DataFrame:
        if isinstance(given, dict) and given:
            given = cells.sparkSession.createDataFrame([(k, float(v)) for k, v in given.items()], "s string, goal double")
        if isinstance(given, DataFrame):
            named = given.select(F.coalesce(F.col("s").cast("string"), F.lit(MISSING)).alias("s"), F.col("goal").cast("double").alias("goal")).groupBy("s").agg(F.sum("goal").alias("goal"))
            return cells.join(named, "s", "left").select(*cells.columns, F.coalesce("goal", F.lit(0.0)).alias("goal"))
        sources = cells.groupBy("s").agg(F.sum("n").alias("n"))
        grown = sources.agg(F.sum(F.pow("n", F.lit(power)))).first()[0] or 1.0
        return cells.join(sources.select("s", (F.pow("n", F.lit(power)) / F.lit(grown)).alias("goal")), "s")

    @staticmethod
    def _sources(cells: DataFrame, b: dict, c: dict) -> DataFrame:
        """Source factors that set the source margin right, given the others."""
        w = F.sum(F.col("n") * _factor("l", b) * _factor("t", c))
        return cells.groupBy("s").agg(F.first("goal").alias("goal"), w.alias("w")).select("s", F.when(F.col("w") > 0, F.col("goal") / F.col("w")).otherwise(0.0).alias("a"))

    def weight(self) -> Column:
        """The weight of a row with s's factor in ``a``; over the corpus the mean by tokens is 1."""
        return F.col("a") * _factor("l", self.languages) * _factor("t", self.topics) * F.lit(float(self.whole))

    def applied(self, rows: DataFrame) -> DataFrame:
        """``rows`` with s, l, t and doc_id, and weight, probability and kept besides. Source factors are broadcast only if they are few."""
        few = self.known <= 100_000
        joined = rows.join(F.broadcast(self.sources) if few else self.sources, "s")
        p = F.least(F.lit(1.0), F.col("weight") * F.lit(self.rate))
        return joined.withColumn("weight", self.weight()).drop("a").withColumn("probability", p).withColumn("kept", draw(F.col("doc_id")) < F.col("probability"))


def draw(doc_id: Column) -> Column:
    """A number in [0, 1) by the id's MD5; a null id draws that of the empty string."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def mix(docs: DataFrame, targets: dict | None = None, power: float = FLATTEN, budget: float = BUDGET, topic: str | None = None, sweeps: int = SWEEPS) -> DataFrame:
    """One row per row of ``docs(doc_id, text, lang, source)``: doc_id, source, language, topic, tokens, weight, probability, kept.

    Topics come from the column ``topic`` or, where none is named, from the words of the texts (:func:`with_topics`). Null sources and
    languages form the group ``unknown``; a null or empty text counts one token; repeated rows are drawn alike, by doc_id; an empty
    table gives no rows; other columns are ignored. Nothing is kept of groups that the targets leave out."""
    rows = stash(docs.select("doc_id", *keyed(docs, topic=topic)), "rows")
    rows = with_topics(rows, usage(rows))
    return Mixture(rows, targets, power, budget, sweeps=sweeps).applied(rows).select("doc_id", F.col("s").alias("source"), F.col("l").alias("language"), F.col("t").alias("topic"), "tokens", "weight", "probability", "kept")


def sampled(docs: DataFrame, targets: dict | None = None, power: float = FLATTEN, budget: float = BUDGET, topic: str | None = None) -> DataFrame:
    """The rows of ``docs`` that are kept, with the columns of ``docs``; nulls, empty and repeated rows as in :func:`mix`."""
    own = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own")
    rows = stash(docs.select(*keyed(docs, topic=topic)), "rows")
    used = usage(rows)
    mixture = Mixture(with_topics(rows, used), targets, power, budget)
    return mixture.applied(with_topics(docs.select(own, "doc_id", *keyed(docs, topic=topic)), used)).where("kept").select("own.*")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, language, topic, tokens, weight, probability and kept of all ``documents``, for the corpus's own shares flattened and half of its tokens."""
    made = mix(table(spark, sf_dir, "documents"))
    return made.withColumns({"weight": F.round("weight", 6), "probability": F.round("probability", 6)})


def oracle(base: str = "documents", power: float = FLATTEN, budget: float = BUDGET, sweeps: int = SWEEPS) -> str:
    """SQL of the common table expressions up to ``mixed``: every sweep is written out, and the first that is close enough is taken."""
    counts = ", ".join(f"len(list_filter(g, lambda x: x = {k}))::BIGINT AS c{k}" for k in range(GROUPS))
    beyond = ", ".join(f"(c{k} + 1) * v::DOUBLE / ((c0{''.join(f' + c{i}' for i in range(1, GROUPS))}) * v{k}::DOUBLE + (v::DOUBLE + 1))" for k in range(GROUPS))
    sql = rf"""
h AS MATERIALIZED (SELECT doc_id, coalesce(source, '{MISSING}') AS s, coalesce(lang, '{MISSING}') AS l, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM {base}),
j AS MATERIALIZED (SELECT doc_id, s, l, greatest(1, len(ws))::BIGINT AS tokens, {counts} FROM (
    SELECT *, list_transform(ws, lambda w: (unicode(w) * 31 + coalesce(nullif(unicode(substr(w, 2, 1)), -1), 0) * 7 + coalesce(nullif(unicode(substr(w, 3, 1)), -1), 0) * 3 + length(w)) % {GROUPS}) AS g FROM h)),
v AS MATERIALIZED (SELECT l, {', '.join(f'sum(c{k}) AS v{k}' for k in range(GROUPS))}, sum({' + '.join(f'c{k}' for k in range(GROUPS))}) AS v FROM j GROUP BY l),
k AS MATERIALIZED (SELECT doc_id, s, l, tokens, 'words' || (list_position(b, list_max(b)) - 1) AS t FROM (SELECT *, [{beyond}] AS b FROM j JOIN v USING (l))),
cell AS MATERIALIZED (SELECT s, l, t, sum(tokens)::DOUBLE AS n FROM k GROUP BY ALL),
gs AS MATERIALIZED (SELECT s, pow(sum(n), {power}) / sum(pow(sum(n), {power})) OVER () AS goal FROM cell GROUP BY s),
gl AS MATERIALIZED (SELECT l, pow(sum(n), {power}) / sum(pow(sum(n), {power})) OVER () AS goal FROM cell GROUP BY l),
gt AS MATERIALIZED (SELECT t, pow(sum(n), {power}) / sum(pow(sum(n), {power})) OVER () AS goal FROM cell GROUP BY t),
b0 AS MATERIALIZED (SELECT l, 1.0::DOUBLE AS b FROM gl), c0 AS MATERIALIZED (SELECT t, 1.0::DOUBLE AS c FROM gt),"""
    for i in range(sweeps + 1):
        sql += f"""
a{i} AS MATERIALIZED (SELECT s, any_value(goal) / sum(n * b * c) AS a FROM cell JOIN gs USING (s) JOIN b{i} USING (l) JOIN c{i} USING (t) GROUP BY s),
m{i} AS MATERIALIZED (SELECT l, t, sum(n * a) AS n FROM cell JOIN a{i} USING (s) GROUP BY l, t),
x{i} AS MATERIALIZED (SELECT {i} AS sweep, max(e) AS error FROM (SELECT abs(sum(n * b * c) - any_value(goal)) AS e FROM m{i} JOIN b{i} USING (l) JOIN c{i} USING (t) JOIN gl USING (l) GROUP BY l
    UNION ALL SELECT abs(sum(n * b * c) - any_value(goal)) FROM m{i} JOIN b{i} USING (l) JOIN c{i} USING (t) JOIN gt USING (t) GROUP BY t)),"""
        if i < sweeps:
            sql += f"""
b{i + 1} AS MATERIALIZED (SELECT l, any_value(b) * any_value(goal) / sum(n * b * c) AS b FROM m{i} JOIN b{i} USING (l) JOIN c{i} USING (t) JOIN gl USING (l) GROUP BY l),
c{i + 1} AS MATERIALIZED (SELECT t, any_value(c) * any_value(goal) / sum(n * b * c) AS c FROM m{i} JOIN b{i + 1} USING (l) JOIN c{i} USING (t) JOIN gt USING (t) GROUP BY t),"""
    every = range(sweeps + 1)
    return sql + f"""
z AS MATERIALIZED (SELECT min(sweep) AS sweep FROM ({' UNION ALL '.join(f'SELECT * FROM x{i}' for i in every)}) WHERE error <= {TOLERANCE} OR sweep = {sweeps}),
w AS MATERIALIZED (SELECT s, l, t, n, weight * (SELECT sum(n) FROM cell) AS weight FROM ({' UNION ALL '.join(f'SELECT {i} AS sweep, s, l, t, n, a * b * c AS weight FROM cell JOIN a{i} USING (s) JOIN b{i} USING (l) JOIN c{i} USING (t)' for i in every)}) JOIN z USING (sweep)),
o AS MATERIALIZED (SELECT weight, coalesce(lag(upto) OVER q, 0) AS n, coalesce(lag(mass) OVER q, 0) AS m, (SELECT sum(n * weight) FROM w) AS whole, {budget} * (SELECT sum(n) FROM w) AS goal
    FROM (SELECT weight, sum(sum(n)) OVER p AS upto, sum(sum(n) * weight) OVER p AS mass FROM w GROUP BY weight WINDOW p AS (ORDER BY weight DESC)) WINDOW q AS (ORDER BY weight DESC)),
r AS MATERIALIZED (SELECT arg_max((goal - n) / (whole - m), weight) AS rate FROM o WHERE weight * (goal - n) / (whole - m) <= 1),
mixed AS MATERIALIZED (SELECT doc_id, s AS source, l AS language, t AS topic, tokens, weight, least(1.0, weight * (SELECT rate FROM r)) AS probability,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS draw FROM k JOIN w USING (s, l, t))"""


ORACLE = f"WITH {oracle()} SELECT doc_id, source, language, topic, tokens, round(weight, 6) AS weight, round(probability, 6) AS probability, draw < probability AS kept FROM mixed"
