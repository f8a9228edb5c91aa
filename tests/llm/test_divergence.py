"""Source divergence against all pairs and terms in plain Python."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import divergence as D

from .test_operators import DOCS, odd_rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=10, top=10):
    """Rows (text, lang, source)."""
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
        groups.add((lang, source))
        counts[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= least]
        size = lambda c: sum(c[t] for t in kept) + 2 * len(kept)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // size(c) for t in kept}
        mine = share(counts[lang, source])
        pairs = [(f"{s}", sum(f(mine[t], q) for t, q in share(counts[lang, s]).items())) for g, s in groups if g == lang and s != source]
        whole = share(sum((counts[g] for g in groups if g[0] == lang), Counter()))
        terms = [(t, f(mine[t], whole[t])) for t in kept if counts[lang, source][t] and mine[t] > whole[t]]
        for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
            best = sorted(items, key=lambda i: (-i[1], i[0].encode()))[:most]
            out += [(lang, source, part, item, value, rank + 1) for rank, (item, value) in enumerate(best)]
    return sorted(out)


def told(df):
    return sorted((r.lang, r.source, r.part, r["item"], r.value, r["rank"]) for r in df.collect())


def made(seed=0, sources=9, docs=300):
    import random

    rnd = random.Random(seed)
    words = [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(100)] + ["Äpfel", "äpfel", "ÉTÉ", "été", "日本", "The", "the"]
    rows = []
    for _ in range(docs):
        s = rnd.randrange(sources)
        rows.append((rnd.choice([" ", "-1\n", "\x00"]).join(rnd.choice(words[s * 5 :]) for _ in range(rnd.randint(0, 30))), rnd.choice(["en", "de", None]), rnd.choice([f"s{s}", "s1", None])))
    return rows + [(None, "fr", "alone"), ("", "xx", "a"), (None, "xx", "b"), ("few words", "xx", "c")] + [("again and again", "en", "s1")] * 12


@pytest.mark.parametrize("sources, terms", [(256, 4096), (3, 16), (1, 5)])
def test_blocks_and_parts(spark, monkeypatch, sources, terms):
    """Any number of blocks of sources and parts of terms gives the same values."""
    monkeypatch.setattr(D, "SOURCES", sources)
    monkeypatch.setattr(D, "TERMS", terms)
    rows = made()
    assert told(D.divergence(spark.createDataFrame(rows, "text string, lang string, source string"))) == brute(rows)


def test_odd_rows(spark):
    df = spark.createDataFrame(odd_rows(), DOCS)
    rows = [(r.text, r.lang, r.source) for r in df.collect()]
    assert told(D.divergence(df, least_docs=1)) == brute(rows, 1)
    assert told(D.divergence(df.withColumnRenamed("n_chars", "term"), least_docs=2, top=3)) == brute(rows, 2, 3)
    assert D.divergence(df.limit(0)).count() == 0


def test_counts_are_sent_in_parts(spark, monkeypatch):
    """A task that holds few terms sends partial counts; documents are counted once all the same."""
    import pyarrow as pa

    monkeypatch.setattr(D, "HELD", 10)
    rows = [("en", "a", b"one two three two"), ("en", "b", b"two " * 5)] * 20
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["lang", "source", "text"])
    got = defaultdict(lambda: [0, 0])
    for out in D._counted([batch]):
        for lang, source, term, n, docs in zip(*(c.to_pylist() for c in out.columns)):
            got[lang, source, term][0] += n
            got[lang, source, term][1] += docs
    assert got == {("en", "a", "one"): [20, 20], ("en", "a", "two"): [40, 20], ("en", "a", "three"): [20, 20], ("en", "b", "two"): [100, 20]}


def test_shares_are_exact(spark):
    n, total, kept = 3 * 10**15 + 7, 8 * 10**17 + 11, 12_345
    row = spark.range(1).select(D.share(*map(F.lit, (n, total, kept))).alias("p")).first()
    assert row.p == 1 + 10**9 * (n + 2) // (total + 2 * kept)
