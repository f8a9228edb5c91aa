"""Operator 12, periodic runs of words by Kolpakov and Kucherov's method.

A run is a longest stretch of words with a period q that it holds at least ``least_exponent`` times. In a text, the Lempel-Ziv factors
are read off a suffix automaton; Main's algorithm finds the runs that start before a factor or at its edge and end in it; runs
inside a factor are copied from the factor's earlier occurrence. All of it takes time in proportion to the words.

Only stretches are factorised in which every window of a few words occurs again in the text. Every wanted run lies in one such
stretch: a run of at least 24 words and 3 periods has, for each of its 8-word windows, an equal one a period before or after.
"""

from __future__ import annotations

from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import modest, table, words_of
from .tokens import slices


def automaton(word: list) -> tuple[list[dict], list[int]]:
    """The suffix automaton: moves of every state, and where the first occurrence of its strings ends."""
    moves: list[dict] = [{}]
    link, length, first = [-1], [0], [-1]
    last = 0
    for at, sign in enumerate(word):
        new, p = len(moves), last
        moves.append({})
        length.append(at + 1)
        first.append(at)
        link.append(0)
        while p >= 0 and sign not in moves[p]:
            moves[p][sign] = new
            p = link[p]
        if p >= 0:
            q = moves[p][sign]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(moves)
                moves.append(moves[q].copy())
                length.append(length[p] + 1)
                first.append(first[q])
                link.append(link[q])
                link[q] = link[new] = copy
                while p >= 0 and moves[p].get(sign) == q:
                    moves[p][sign] = copy
                    p = link[p]
        last = new
    return moves, first


def factors(word: list) -> list[tuple[int, int, int]]:
    """(start, end, earlier start) of the Lempel-Ziv factors: the longest beginning of the rest that occurs before, overlaps allowed, or a new sign (earlier start -1)."""
    moves, first = automaton(word)
    out, at = [], 0
    while at < len(word):
        state, end, source = 0, at, -1
        while end < len(word):
            state = moves[state][word[end]]  # every part of the word has a state
            if (begin := first[state] - (end - at)) >= at:
                break
            source, end = begin, end + 1
        out.append((at, max(end, at + 1), source))
        at = max(end, at + 1)
    return out


def shared_beginnings(word: list) -> list[int]:
    """How many signs every suffix has in common with the whole word (the Z function)."""
    n = len(word)
    out, left, right = [n] + [0] * (n - 1), 0, 0
    for i in range(1, n):
        k = min(out[i - left], right - i) if i < right else 0
        while i + k < n and word[k] == word[i + k]:
            k += 1
        if i + k > right:
            left, right = i, i + k
        out[i] = k
    return out


def crossing(word: list, low: int, at: int, end: int, most: int):
    """Main's algorithm: (start, end, period) of the stretches in ``word[low:end]`` that touch the edge at ``at``, by rising period up to ``most``."""
    left, right = word[low:at], word[at:end]
    back, n, m = left[::-1], at - low, end - at
    # what is common to words at distance q: from the edge on with q words earlier, and up to the edge with q words earlier or later
    ahead = shared_beginnings([*right, None, *left[-most:], *right]) if n else []
    behind = shared_beginnings(back)
    within = shared_beginnings(right)
    turned = shared_beginnings([*back, None, *right[:most][::-1], *back]) if m else []
    ahead_at, turned_at = m + 1 + min(most, n), n + 1 + min(most, m)
    for q in range(1, min(most, max(n, m)) + 1):
        if q <= n:  # the stretch holds the q words before the edge
            yield at - q - (behind[q] if q < n else 0), at + ahead[ahead_at - q], q
        if q <= m:  # the stretch holds the q words after it
            yield at - turned[turned_at - q], at + q + (within[q] if q < m else 0), q


def runs_of(word: list, shortest: int = 2, exponent: int = 2) -> list[tuple[int, int, int]]:
    """(start, end, smallest period) of all runs of at least ``shortest`` signs that hold their period at least ``exponent`` times, by start and end."""
    n = len(word)
    found: list[tuple[int, int, int]] = []
    places: set[tuple[int, int]] = set()

    def add(a: int, b: int, q: int) -> None:
        if (a, b) not in places:  # its smallest period came first
            places.add((a, b))
            insort(found, (a, b, q))

    before = 0
    for at, end, source in [*factors(word), (n, n, -1)]:
        # a run that ends in this factor reaches less than a period beyond the last one, or the last one would be longer
        most = max(1, (end - before - 1) // (exponent - 1))
        low = max(0, before - most)
        if end - low >= shortest:
            for a, b, q in crossing(word, low, at, end, most):
                if b - a >= max(shortest, exponent * q) and (a == 0 or word[a - 1] != word[a - 1 + q]) and (b == n or word[b] != word[b - q]):
                    add(a, b, q)
        if source >= 0:  # runs inside the factor are those inside its earlier occurrence
            shift = at - source
            i = bisect_right(found, (source, n + 1, 0))
            while i < len(found) and found[i][0] + shift < end:
                a, b, q = found[i]
                if b + shift < end:
                    add(a + shift, b + shift, q)
                i += 1
        before = at
    return found


#: Odd, for hashes of windows.
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def stretches(words: list, shortest: int, exponent: int) -> list[tuple[int, int]]:
    """(start, end) of the parts of a text that can hold runs: each window of ``width`` words there occurs twice or more in the text.

    A window of a run has an equal one a period before or after it, still in the run, as long as the run has 2 periods and ``width - 1`` words."""
    width = max(1, shortest - -(-2 * shortest // exponent))
    n = len(words) - width + 1
    if len(words) < shortest:
        return []
    signs = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    keys = np.zeros(n, np.uint64)
    for k in range(width):
        keys = keys * FACTOR + signs[k : k + n]
    order = np.sort(keys)
    again = order[1:][order[1:] == order[:-1]]
    if not len(again):
        return []
    edges = np.flatnonzero(np.diff(np.isin(keys, again), prepend=False, append=False)).tolist()
    return [(a, b + width - 1) for a, b in zip(edges[::2], edges[1::2]) if b + width - 1 - a >= shortest]


def runs_in(words: list, shortest: int, exponent: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a text, by start and period."""
    out = []
    for a, b in stretches(words, shortest, exponent):
        number: dict = {}
        out += [(a + s, e - s, q) for s, e, q in runs_of([number.setdefault(w, len(number)) for w in words[a:b]], shortest, exponent)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that a run holds after its first period."""
    gone: set[int] = set()
    for start, length, period in runs:
        gone.update(range(start + period, start + length))
    return [w for i, w in enumerate(words) if i not in gone] if gone else words


RUN = T.StructType([T.StructField(name, T.LongType()) for name in ("start", "length", "period")])


def find_runs(docs: DataFrame, shortest: int = 24, exponent: int = 3) -> DataFrame:
    """The columns of ``docs(doc_id, text)`` and n_words, runs (start, length and smallest period, counted in words, by start and period) and collapsed, the
    text's words joined by single spaces, but for those that a run of at least ``shortest`` words and ``exponent`` periods repeats.

    Words are separated by ASCII white space. A null, empty or blank text has no words, no runs and an empty collapsed text; a null doc_id stays null;
    repeated rows are read each; a text of any length is read whole, and the memory it takes grows with its longest repetitive stretch; an empty
    table gives no rows; of other columns only doc_id is kept. No row is shuffled."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])

    def found(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        for whole in batches:
            for batch in slices(whole):
                texts = [text.split() if text else [] for text in batch.column(1).to_pylist()]  # bytes are split at ASCII white space only
                runs = [runs_in(words, shortest, exponent) for words in texts]
                kept = pa.array([b" ".join(collapsed(words, some)) for words, some in zip(texts, runs)], pa.binary()).view(pa.string())
                named = pa.array([[dict(zip(("start", "length", "period"), run)) for run in some] for some in runs], kinds.field("runs").type)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), named, kept], schema=kinds)

    return modest(docs.select("doc_id", F.col("text").cast("binary").alias("text"))).mapInArrow(found, schema)


def repetitive(doc_id: Column, text: Column) -> Column:
    """The text in which one document of ten (by CRC-32 of its id) repeats a part of itself from some word on, 3 to 10 times or more."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def looped(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, (a + (i - a) % p).cast("int")))), " ")

    made = F.get(F.transform(F.array(words_of(text)), lambda words: F.when(F.size(words) > 0, looped(words)).otherwise(F.lit(""))), F.lit(0))
    return F.when(h % 10 == 0, made).otherwise(text)


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_runs, start, length, period and exponent_milli of the run with the most periods, runs_sha256 and collapsed_sha256 of all ``documents``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", repetitive(F.col("doc_id"), F.col("text")).alias("text"))
    better = lambda best, run: F.when(best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"]), run).otherwise(best)
    none = F.lit(None).cast(RUN)
    listed = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    rows = find_runs(docs).select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.aggregate("runs", none, better).alias("best"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    best = F.col("best")
    return rows.select("doc_id", "n_runs", best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"), F.floor(1000 * best["length"] / best["period"]).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
