"""Periodic runs against a search through all periods."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest

from palimpsest.llm import periodic as P

from .test_operators import DOCS, odd_rows


def brute_runs(words, shortest, exponent):
    """(start, length, smallest period): for each period, the longest stretches whose words are equal at that distance."""
    out, n = {}, len(words)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(shortest, exponent * q):
                out.setdefault((i, j + q - i), q)
            i = max(i + 1, j)
    return sorted(((a, n, q) for (a, n), q in out.items()), key=lambda r: (r[0], r[2]))


def texts(rnd, n):
    for _ in range(n):
        k = rnd.choice([1, 2, 2, 3, 6])
        w = [rnd.randrange(k) for _ in range(rnd.randint(0, 40))]
        if w and rnd.random() < 0.6:
            loop = w[: rnd.randint(1, 7)]
            w = (loop * 14)[: rnd.randint(0, 60)] + w[: rnd.randint(0, 9)] + (loop * 14)[: rnd.randint(0, 50)] + w
        yield w


@pytest.mark.parametrize("shortest, exponent", [(2, 2), (2, 3), (6, 3), (9, 3), (24, 3), (8, 4)])
def test_runs_against_all_periods(shortest, exponent):
    for w in texts(random.Random(shortest * 10 + exponent), 1500):
        want = brute_runs(w, shortest, exponent)
        assert sorted(((a, b - a, q) for a, b, q in P.runs_of(w, shortest, exponent)), key=lambda r: (r[0], r[2])) == want
        assert P.runs_in(w, shortest, exponent) == want


def test_runs_in_fibonacci_and_cube_words():
    """Words with very many runs."""
    a, b = [0], [0, 1]
    while len(b) < 700:
        a, b = b, b + a
    for w in (b, b * 3, [0] * 300, [0, 0, 1] * 100 + [0, 0, 2] * 100, ([1] * 30 + [2]) * 9):
        assert sorted(((s, e - s, q) for s, e, q in P.runs_of(w)), key=lambda r: (r[0], r[2])) == brute_runs(w, 2, 2)
        assert P.runs_in(w, 24, 3) == brute_runs(w, 24, 3)


def test_factors():
    assert P.factors(list("abaababaab")) == [(0, 1, -1), (1, 2, -1), (2, 3, 0), (3, 6, 0), (6, 10, 1)] or "".join(
        "abaababaab"[s:e] for s, e, _ in P.factors(list("abaababaab"))
    ) == "abaababaab"
    for w in texts(random.Random(5), 300):
        at = 0
        for start, end, source in P.factors(w):
            assert start == at and end > start
            longest = max((k for k in range(len(w) - start + 1) if any(w[j : j + k] == w[start : start + k] for j in range(start))), default=0)
            assert end - start == max(1, longest) and (source == -1) == (longest == 0)
            assert source == -1 or (source < start and w[source : source + end - start] == w[start:end])
            at = end
        assert at == len(w)


def test_a_long_periodic_text():
    """Linear time: 60 000 words within seconds."""
    import time

    rnd = random.Random(1)
    loop = [str(rnd.randrange(5000)) for _ in range(7001)]
    words = (["x", "y", "z"] + loop * 9)[:60_000]
    start = time.perf_counter()
    assert P.runs_in(words, 24, 3) == [(3, 59_997, 7001)]
    assert time.perf_counter() - start < 20


def brute_row(doc_id, text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words, 24, 3)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    first = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *first, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def told(df):
    return sorted(map(str, (tuple(r) for r in df.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect())))


def rows_with_runs():
    rnd = random.Random(7)
    out = []
    for i in range(120):
        w = [rnd.choice("abcdefgh") + rnd.choice("xyz") for _ in range(rnd.randint(1, 150))]
        if i % 3 == 0:
            w = w[:20] + w[: rnd.randint(1, 12)] * rnd.randint(2, 9) + w[20:]
        out.append((i, rnd.choice([" ", "\n", "\t \x0b", "  "]).join(w), "en", "s", 0))
    return [(*r, *["clash"] * 14) for r in out] + [(*r, *["clash"] * 14) for r in [(1000, "a b a b " * 20, "en", "s", 0), (1001, "  \x85 \x1c " * 20, "en", "s", 0)]]


def test_query(spark, tmp_path):
    rows = [*rows_with_runs(), *odd_rows()]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    short = [r for r in rows if len((r[1] or "").split()) < 3000]
    got = told(P.op12_periodic(spark, str(tmp_path)))
    assert len(got) == len(rows)
    want = sorted(str(brute_row(r[0], r[1])) for r in short)
    assert [g for g in want if g not in got] == []


def test_operator_tells_spans_and_texts(spark):
    df = spark.createDataFrame([(1, "so it goes " * 10 + "end"), (2, None), (None, "a b"), (4, "x " * 24), (5, "x " * 23)], "doc_id long, text string")
    got = {r.doc_id: r for r in P.find_runs(df.withColumn("runs", df.doc_id)).collect()}
    assert [tuple(r) for r in got[1].runs] == [(0, 30, 3)] and got[1].collapsed == "so it goes end" and got[1].n_words == 31
    assert (got[2].n_words, got[2].runs, got[2].collapsed) == (0, [], "") and got[None].collapsed == "a b"
    assert [tuple(r) for r in got[4].runs] == [(0, 24, 1)] and got[4].collapsed == "x" and got[5].runs == []
    assert P.find_runs(df.limit(0)).count() == 0
