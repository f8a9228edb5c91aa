"""The ten registered queries, called as the driver calls them, on odd tables and on empty ones."""

import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from palimpsest.llm import registry

from .test_operators import DOCS, brute_base, brute_base_counts, brute_components, brute_fingerprint, brute_topk, brute_url, odd_rows

QUERIES = registry.QUERIES
URLS = [(1, "http://b.example.net/en/x?y#z"), (2, None), (3, ""), (None, "HTTP://A.NET"), (5, "http://" + "q" * 40_000 + ".org/"), (5, "https://example.com/de/1"), (5, "https://example.com/de/1"), (6, "no scheme")]
VECTORS = [(0, [0.5, -0.25]), (1, [0.5, -0.25]), (2, None), (20, []), (21, []), (None, [1.0, 1.0]), (40, [1.0, None]), (60, [float("nan"), 0.0]), (80, [0.1, 0.1]), (81, [-1.0, 2.0])]


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("registered")
    tables = {
        "documents": spark.createDataFrame(odd_rows(), DOCS), "pages": spark.createDataFrame([(*u, "x", "y") for u in URLS], "page_id long, url string, host string, verdict string"),
        "embeddings": spark.createDataFrame([(*v, "x") for v in VECTORS], "vec_id long, embedding array<double>, score string"),
    }
    for name, df in tables.items():
        df.write.parquet(str(base / "odd" / f"{name}.parquet"))
        df.limit(0).write.parquet(str(base / "none" / f"{name}.parquet"))
    return str(base / "odd"), str(base / "none")


def rows(spark, folders, name):
    assert QUERIES[name](spark, folders[1]).count() == 0
    return QUERIES[name](spark, folders[0]).collect()


def token_ids(text, end):
    return [*Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op1(spark, folders):
    got = rows(spark, folders, "op1_packing")
    want = {}
    for i, text, *_ in odd_rows():
        want.setdefault(i, []).append(token_ids(text, 1))
    assert sum(r.length for r in got) == sum(len(ids) for group in want.values() for ids in group)
    for r in got:
        assert any(r.doc_tokens == len(ids) and r.ids_crc32 == crc(ids[r.start : r.start + r.length]) for ids in want[r.doc_id])
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        ends = np.cumsum([n for _, n in sorted(pieces)])
        assert [at for at, _ in sorted(pieces)] == [0, *ends[:-1]] and (ends[-1] == 2048 or ends[-1] & (ends[-1] - 1) == 0)


def test_op2(spark, folders):
    got = sorted((str(r.page_id), r.host, r.path, str(r.rule)) for r in rows(spark, folders, "op2_urls"))
    assert got == sorted((str(i), *brute_url(u)[:2], str(brute_url(u)[2] and brute_url(u)[2][1])) for i, u in URLS)


def test_op3(spark, folders):
    got = rows(spark, folders, "op3_pii")
    kinds = ("email", "ip", "card", "phone")
    want = sorted((str(i), *(sum(k == kind for k, *_ in brute_base(t or "")) for kind in kinds)) for i, t, *_ in odd_rows())
    assert sorted((str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone) for r in got) == want


def test_op4(spark, folders):
    got = rows(spark, folders, "op4_quality")
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == sorted((str(i), *brute_base_counts(t)) for i, t, *_ in odd_rows())
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept) for r in got)


def test_op5(spark, folders):
    assert rows(spark, folders, "op5_licenses") == []


def test_op6(spark, folders):
    good = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in VECTORS if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in rows(spark, folders, "op6_topk")} == brute_topk(good, 20)


def test_op7(spark, folders):
    got = rows(spark, folders, "op7_langid")
    assert got[0].__fields__ == ["doc_id", "held_out", "lang_pred", "score"] and len(got) == len(odd_rows())
    text = {str(i): t for i, t, *_ in odd_rows()}
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not re.search(r"[^\W\d_]", text[str(r.doc_id)] or ""))


def test_op8(spark, folders):
    got = rows(spark, folders, "op8_simhash")
    known = [(i, brute_fingerprint(t)) for i, t, *_ in odd_rows()]
    comps = brute_components([f for _, f in known])
    least = {c: min(i for (i, _), k in zip(known, comps) if k == c and i is not None) if any(i is not None for (i, _), k in zip(known, comps) if k == c) else None for c in comps}
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == sorted((str(i), f"{f:016x}", str(least[c])) for (i, f), c in zip(known, comps))


def test_op9(spark, folders):
    got = sorted(rows(spark, folders, "op9_store"), key=lambda r: r.start)
    assert [r.start for r in got] == list(np.cumsum([0] + [r.n_tokens for r in got[:-1]])) and [r.doc_id for r in got if r.doc_id is not None] == sorted(i for i, *_ in odd_rows() if i is not None)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((str(i), len(ids), crc(ids)) for i, t, *_ in odd_rows() for ids in [token_ids(t, 2)])


def test_op10(spark, folders):
    got = rows(spark, folders, "op10_mixing")
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, *_ in odd_rows()) and all(0 <= r.probability <= 1 and r.tokens >= 1 for r in got)
