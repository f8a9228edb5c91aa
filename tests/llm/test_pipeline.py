"""The pipeline, stage by stage, against plain Python on the smallest table."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from palimpsest.llm import copies, langid, mixing, pii, simhash
from palimpsest.llm.common import stash

from .test_operators import DOCS, odd_rows


def test_stages_against_plain_python(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_dedup", "personal_data", "mix", "pack"]
    outs = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stash(stage(spark, docs, data), name)
        outs.append(docs)
        assert name == "pack" or docs.columns == columns
    first = spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id").collect()
    lang, score = langid.predict(langid.learn(spark.createDataFrame(first)), [r.text for r in first])
    kept = [r for r, a, s in zip(first, lang, score) if a != "und" and s >= corpus_pipeline.LEAST_SCORE]
    by = {r.doc_id: r for r in outs[0].collect()}
    assert set(by) == {r.doc_id for r in kept} and len(kept) >= 0.99 * len(first)
    assert {i: r.lang for i, r in by.items()} == {r.doc_id: a for r, a in zip(first, lang) if r.doc_id in by}
    alone = {kept[g].doc_id for g in jaccard_groups([r.text for r in kept])}
    assert {r.doc_id for r in outs[1].collect()} == alone
    found = dict(zip([r.doc_id for r in kept], pii.find(pii.trained(), [r.text for r in kept])))
    masked = {r.doc_id: r.text for r in outs[2].collect()}
    assert masked == {r.doc_id: pii.masked(r.text, found[r.doc_id][1]) for r in kept if r.doc_id in alone}
    sample = {r.doc_id for r in mixing.mix(outs[2]).where("kept").collect()}
    assert {r.doc_id for r in outs[3].collect()} == sample and sample
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = {}
    for r in outs[4].orderBy("doc_id", "start").collect():
        pieces.setdefault(r.doc_id, []).append(r.ids)
    assert {d: np.frombuffer(b"".join(p), "<u4").tolist() for d, p in pieces.items()} == {d: [*t.encode(masked[d], add_special_tokens=False).ids, 1] for d in sample}


def test_run_gives_the_last_stage(spark, data):
    made = corpus_pipeline.run(spark, data)
    assert made.count() > 0 and {"doc_id", "start", "length", "ids", "sequence_id", "offset"} <= set(made.columns)
    assert made.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def jaccard_groups(texts):
    """Groups of sets of 5-word shingles that agree by at least 0.8, by comparing all pairs."""
    words = [(t or "").lower().split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    group = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    return group


@pytest.mark.parametrize("most", [1 << 19, 2000])
def test_near_dedup_takes_all_pairs_of_similarity_four_fifths(spark, data, monkeypatch, most):
    monkeypatch.setattr(copies, "MOST", most)  # with 2000, crowded keys are split into parts
    r = np.random.default_rng(8)
    word = lambda n: [f"w{x}" for x in r.integers(0, 10_000, n)]
    rows = [(x.doc_id, x.text) for x in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    for n in (20, 60, 100, 200, 600):
        for changes in (1, 2, 4):
            own = word(n)
            other = list(own)
            for at in np.linspace(10, n - 10, changes).astype(int):
                other[at] = "changed"
            rows += [(1000 + len(rows), " ".join(own)), (1000 + len(rows) + 1, " ".join(other))]
    own = word(100)
    rows += [(5000 + i, " ".join([*own, "more", str(i)])) for i in range(40)]
    group = jaccard_groups([t for _, t in rows])
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), data)
    assert sorted(x.doc_id for x in got.collect()) == sorted(rows[g][0] for g in set(group))


def test_odd_rows_and_empty_tables_through_all_stages(spark, data, tmp_path):
    odd = spark.createDataFrame(odd_rows(), DOCS)
    for name, docs in (("odd", odd), ("none", odd.limit(0))):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        assert corpus_pipeline.run(spark, str(tmp_path / name)).count() >= 0
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            made = stage(spark, docs, data)
            assert name == "pack" or made.schema == docs.schema, name
            ids = sorted(str(r.doc_id) for r in made.select("doc_id").distinct().collect())
            if docs is not odd:
                assert ids == []
            elif name == "language":  # blank and letterless texts go
                assert {"1", "5", "6", "9", "None"} >= set(ids) - {"8"} and not {"2", "3", "4", "7"} & set(ids)
            elif name == "near_dedup":
                assert ids == ["1", "2", "5", "7", "8", "9", "None"] and made.count() == 7
            elif name == "personal_data":
                assert made.count() == len(odd_rows()) and made.where("text LIKE '%<EMAIL>%'").count() == 2 and made.where("text IS NULL").count() == 1
            elif name == "pack":
                assert len(ids) == 10


def test_near_dedup_goes_through_classes_of_close_fingerprints(spark):
    """Texts whose fingerprints differ in at most 3 bits meet under one name, whatever their other keys are; all others stay apart."""
    own = [f"w{i}" for i in range(3000)]
    texts = [" ".join(own), " ".join([*own[:1500], "changed", *own[1501:]]), " ".join(f"v{i}" for i in range(3000)), "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bits = [simhash.fingerprint(t) for t in texts]
    assert 0 < (bits[0] ^ bits[1]).bit_count() <= 3 < (bits[0] ^ bits[2]).bit_count()
    made = stash(copies.sketches(docs, simhash.hashed), "sketches")
    name = {r.doc_id: r.fp for r in made.collect()}
    at = {r.fp: r.bits for r in simhash.proposed(made).collect()}
    assert at[name[0]] == at[name[1]] != at[name[2]] and name[3] == name[4] and len(at) == 4
    met = {frozenset((r.a, r.b)) for r in copies.links(docs, made.withColumn("keys", F.array(F.col("fp"))), simhash.proposed(made)).collect()}
    assert met == {frozenset((name[0], name[1]))}  # no other key is shared
