"""The ten operators against brute force, and on rows that are null, empty, very long, tied, repeated, or have clashing columns."""

import hashlib
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer
from xxhash import xxh64_intdigest

from palimpsest.llm import langid, licenses, mixing, packing, pii, quality, simhash, store, topk, urls
from palimpsest.llm.tokens import BatchEncoder

BPE = public_tokenizers.path("byte_bpe_50k.json")
DOCS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in ("fp", "score", "sequence_id", "host", "line", "s", "l", "t", "tokens", "kept", "part", "own", "h", "start")]
)  # the last are clashes with names that operators use themselves
LONG = "word " * 30_000


def odd_rows() -> list[tuple]:
    rows = [
        (1, "The cat sat on the mat and the dog lay on the rug.", "en", "a", 50), (2, None, "en", "a", None), (3, "", None, None, 0), (4, " \n\t ", "de", "b", 4),
        (5, LONG, "en", "a", len(LONG)), (6, "The cat sat on the mat and the dog lay on the rug.", "fr", "b", 50), (6, "The cat sat on the mat and the dog lay on the rug.", "fr", "b", 50),
        (None, "No id here at all, mail me at ann.lee@mail.example.com today.", "en", "a", 9), (None, "No id here at all, mail me at ann.lee@mail.example.com today.", "en", "a", 9),
        (7, "1234 !!! ---", "en", "a", 12), (8, "<|endoftext|> a  b \n \n c\u00a0d\u3000e", "en", "c", 5), (9, "x", "en", "c", 1),
    ]
    return [(*r, *["clash"] * 14) for r in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(BPE)  # as it is loaded


def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


# --- tokens -------------------------------------------------------------------------------------------------------------------


def test_encoder_equals_the_tokenizer(tokenizer):
    r = np.random.default_rng(4)
    parts = ["a", "bc", " ", "  ", "\n", "\t", "'s", "12", "é", "$$", "\u00a0", "\x1c", "\r\n", "<|endoftext|>", "日本", ".", "\u3000", "\x85"]
    texts = ["".join(r.choice(parts, r.integers(0, 30))) for _ in range(4000)] + [None, "", LONG]
    texts += ["<|endoftext|>", "<|endoftext|> a", "a <|endoftext|>", "a <|endoftext|> b", "a<|endoftext|>b  c", "<|endoftext|><|endoftext|>", " <|endoftext|> \n", "<|endoftext", "|endoftext|> a"]
    encode = BatchEncoder(BPE, remember=500)  # it forgets many times
    for at in range(0, len(texts), 700):
        some = texts[at : at + 700]
        ids, stops = encode(some, 7)
        start = 0
        for text, stop in zip(some, stops.tolist()):
            assert ids[start:stop].tolist() == [*tokenizer.encode(text or "", add_special_tokens=False).ids, 7]
            start = stop


# --- 1 packing ----------------------------------------------------------------------------------------------------------------


def packed_right(rows: list, texts: list[tuple], tokenizer, end: int = 1):
    """Every id of every row lies in exactly one piece, and sequences have no gaps and hardly any padding."""
    want = sorted((str(d), zlib.crc32(x.tobytes()), len(x)) for d, t in texts for x in [np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, end], "<u4")])
    left = {}
    for r in rows:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        left.setdefault((str(r.doc_id), r.doc_tokens), []).append((r.start, r.ids))
    got = []
    for (doc, n), pieces in left.items():
        pieces.sort()
        copies = sum(len(p[1]) for p in pieces) // (4 * n)  # repeated rows have equal pieces or equal cuts
        if copies == 1:
            assert [p[0] for p in pieces] == list(np.cumsum([0] + [len(p[1]) // 4 for p in pieces[:-1]]))
            got.append((doc, zlib.crc32(b"".join(p[1] for p in pieces)), n))
        else:
            covered = np.zeros(n, int)
            for start, ids in pieces:
                covered[start : start + len(ids) // 4] += 1
            assert (covered == copies).all()
            got += [w for w in want if w[0] == doc and w[2] == n][:copies]
    assert sorted(got) == want
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == packing_size or at & (at - 1) == 0
    return by


packing_size = 64


def test_packing_keeps_every_id_once(spark, data, tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "MERGE", 2)  # several rounds of merging
    d = documents(spark, data).repartition(7)
    made = packing.pack(d, BPE, size=packing_size, windows=3).collect()
    by = packed_right(made, [(r.doc_id, r.text) for r in d.collect()], tokenizer)
    assert sum(sum(n for _, n in p) < packing_size for p in by.values()) <= packing_size.bit_length()


def test_packing_odd_rows(odd, empty, tokenizer):
    made = packing.pack(odd, BPE, size=packing_size).collect()
    packed_right(made, [(r[0], r[1]) for r in odd_rows()], tokenizer)
    assert packing.pack(empty, BPE).count() == 0


# --- 2 urls -------------------------------------------------------------------------------------------------------------------


def brute_url(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, rule in urls.RULES:
        name, start = rule.split("/", 1)
        if (host == name or host.endswith("." + name)) and path.startswith("/" + start) and (best is None or len(rule) > len(best[1])):
            best = verdict, rule
    return host, path, best


def brute_ngrams(host, path):
    out = set()
    for salt, text in ((1, f"^{host}$"), (2, f"^{path}$")):
        raw = text.encode("utf-8", "replace")
        for n in (3, 4, 5):
            for i in range(len(raw) - n + 1):
                h = 31 * salt + n
                for c in raw[i : i + n]:
                    h = (h ^ c) * 0x100000001B3 % (1 << 64)
                out.add((h ^ h >> 29) * 0x9E3779B97F4A7C15 % (1 << 64) >> 48)
    return out


def test_urls_against_brute_force(spark, data):
    odd = [None, "", "no scheme", "http://", "HTTP://A.NET", "x://A.Net/", "http://b.example.net/en/x?y#z", "http://example.net/en", "http://example.com/de/1", "ftp://org/fr/", "a://b://c/d", "http://h\nx.net/\np?q", "http://É.net/" + "p" * 50_000, "https://notnet/"]
    pages = spark.read.parquet(f"{data}/pages.parquet").select("page_id", "url").union(spark.createDataFrame([(i, u) for i, u in enumerate(odd, -99)] + [(None, "http://q.org/")] * 2, "page_id long, url string"))
    pages = pages.withColumns({c: F.lit("clash") for c in ("host", "path", "rule", "verdict", "score")})
    w, b = urls.fit(urls.varied([(*urls.plain_host_path(u), y) for u, y in urls.LABELLED]))
    wanted = {}
    for r in pages.collect():
        host, path, best = brute_url(r.url)
        at = sorted(brute_ngrams(host, path))
        p = 1 / (1 + np.exp(-(w[at].astype(float).sum() / np.sqrt(len(at)) + b))) if host or path else 0
        wanted.setdefault(r.page_id, []).append((host, path, best and best[1], best[0] if best else "block" if p > 0.45 else "allow"))
    got = {}
    for r in urls.filter_urls(pages).collect():
        got.setdefault(r.page_id, []).append((r.host, r.path, r.rule, r.verdict))
    assert got == wanted
    assert urls.filter_urls(pages.limit(0)).count() == 0


# Host names that the labelled table has not, as a person would label them.
UNSEEN_BAD = "casinospin lucky-casino pillmart bulk-pills spamming megaspam pornstar-hd pornzone xxxclips adult-toys adultzone betwinner livebets lotterypick prizedraw-win pokerking replica-shoes fakewatch crackzone torrentz keygenhub malwarebin clickbaity cryptodoubler linkspam freecasinos payday24 loan-payday viagra24 nudecams sexchats warez-crack slots-casino jackpot-win adtracker2 popup-adclick phish-mail".split()
UNSEEN_GOOD = "thameside ththor erthon tionan anenth gardenclub weatherwise oldlibrary museumofart teapot mathsteacher geology violin seaside-walks gallery bicycle lighthouse parliament dictionary philosophy chemist river-trust woodland planetarium childrens-books cathedral sculpture vegetables meteorology astronomer typography ecology harvest shipbuilding mountain rivers genealogy quarterly translation thimble ontheon rethan".split()


def test_url_model_on_hosts_that_are_not_in_the_table(spark):
    known = {part for u, _ in urls.LABELLED for part in urls.plain_host_path(u)[0].split(".")}
    assert not known & {*UNSEEN_BAD, *UNSEEN_GOOD}
    rows = [(name in UNSEEN_BAD, f"https://{pre}{name}.example.{tld}/{path}") for name in UNSEEN_BAD + UNSEEN_GOOD for pre, tld, path in (("", "com", "en/12"), ("www.", "org", "de/7.html"), ("m.", "net", ""), ("shop.", "co", "a/b?c=d"))]
    found = urls.filter_urls(spark.createDataFrame([(i, u) for i, (_, u) in enumerate(rows)], "page_id long, url string"), rules=[]).collect()
    blocked = [rows[r.page_id][0] for r in found if r.verdict == "block"]
    precision, recall = sum(blocked) / len(blocked), sum(blocked) / sum(bad for bad, _ in rows)
    print(f"url model on unseen hosts: precision {precision:.3f}, recall {recall:.3f}")
    assert precision >= 0.9 and recall >= 0.9


def test_url_model_leaves_ordinary_hosts_alone(spark):
    found = urls.filter_urls(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
    blocked = {r.host for r in found.where("rule IS NULL AND verdict = 'block'").select("host").distinct().collect()}
    assert blocked and all("-" in h for h in blocked)  # the table's made-up names have no hyphen


# --- 3 personal data ------------------------------------------------------------------------------------------------------------

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_base(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c.isdigit()]
            doubled = [d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits))]
            fine = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0, "phone": 9 <= len(digits) <= 15}[kind]
            if fine:
                out.append((kind, m.start(), m.end()))
    return out


@pytest.fixture(scope="module")
def tagger():
    return pii.trained()


def test_base_spans_against_plain_patterns(spark, data):
    r = np.random.default_rng(1)
    parts = list("aA1290.@-+() %é\n") + ["example.com", "4111 1111 1111 1111", "1.2.3.4", "+49 30 123456", "a@b.c@d.e", "256.1.1.1", "0001.2.3.4"]
    texts = ["".join(r.choice(parts, r.integers(0, 25))) for _ in range(3000)] + [x.text for x in documents(spark, data).collect()]
    for t in texts:
        assert [(pii.KINDS[k], a, b) for k, a, b in pii.base_spans(t)] == brute_base(t), t


def test_network_gradients_against_differences():
    r, m = np.random.default_rng(0), pii.Tagger()
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    x, y = (a[:, :15] for a in pii.lesson_windows(r, 5))
    g = m.gradients(x, y)
    for k in m.p:
        for _ in range(4):
            at = tuple(int(r.integers(0, n)) for n in m.p[k].shape)
            old, loss = m.p[k][at], []
            for step in (1e-5, -1e-5):
                m.p[k][at] = old + step
                loss.append(m.likelihood(x, y))
            m.p[k][at] = old
            assert (loss[0] - loss[1]) / 2e-5 == pytest.approx(g[k][at], abs=1e-6), (k, at)


def test_decoding_against_all_paths():
    from itertools import product

    m = pii.Tagger(seed=8)
    m.p["t"], m.p["s"] = (np.random.default_rng(2).normal(0, 1, m.p[k].shape).astype(np.float32) for k in "ts")
    x = np.random.default_rng(1).integers(1, 40, (6, 4)).astype(np.int16)
    em, (tags, q) = m.emissions(x)[0], m.decode(x)
    for row in range(len(x)):
        paths = {p: m.p["s"][p[0]] + sum(em[row, i, k] for i, k in enumerate(p)) + sum(m.p["t"][a, b] for a, b in zip(p, p[1:])) for p in product(range(pii.TAGS), repeat=4)}
        assert tuple(tags[row]) == max(paths, key=paths.get)
        odds = {p: np.exp(v) for p, v in paths.items()}
        for i, kind in ((0, 1), (3, 2)):
            want = sum(v for p, v in odds.items() if p[i] in (1 + 2 * kind, 2 + 2 * kind)) / sum(odds.values())
            assert not tags[row].any() or q[row, i, kind] == pytest.approx(want, abs=1e-4)


def test_reconciling_against_all_subsets():
    from itertools import combinations

    r = np.random.default_rng(6)
    for _ in range(200):
        spans = [(float(r.normal(1, 1)), int(r.integers(0, 2)), a, a + int(r.integers(1, 6))) for a in r.integers(0, 15, int(r.integers(0, 8))).tolist()]
        total = lambda some: sum(max(s for s, *rest in spans if tuple(rest) == x) for x in some)
        best = 0.0
        for n in range(len(spans) + 1):
            for some in combinations({tuple(rest) for _, *rest in spans}, n):
                if all(x[2] <= y[1] or y[2] <= x[1] for x, y in combinations(some, 2)):
                    best = max(best, total(some))
        got = pii.reconciled(spans)
        assert all(x[2] <= y[1] or y[2] <= x[1] for x, y in combinations(got, 2)) and total(got) == pytest.approx(best)


# Pieces of plain text and of personal data of another kind than the generator that the network learns from.
PLAIN_WORDS = "the report was sent on Monday and nobody asked about it before lunch so we kept walking along the river until it rained".split()
PLANTED = [
    "anna.smith@mail.example.com", "j.doe_88@uni-bonn.de", "info+news@shop-24.example.co.uk", "maria at example dot org", "jörg.weiß@straße.example.de", "10.0.12.254", "192.168.1.7", "203[.]0[.]113[.]9",
    "4111 1111 1111 1111", "5500-0000-0000-0004", "4012888888881881", "4111.1111.1111.1111", "(212) 555-0147", "212-555-0147", "020 7946 0018", "01 70 18 99 00", "0171 2345678", "+49 30 901820", "+44 20 7946 0991", "612 34 56 78",
]
ORDINARY = ["2021-05-12", "10:30:45", "978-3-16-148410-0", "1,234,567", "v2.10.3", "@home", "3.14159", "42%", "12/11/2020", "1998-2004", "4839201745", "$19.99", "route66", "0x1f", "page 112"]


def test_spans_of_another_generator(tagger):
    r, hit, said, there, missed = np.random.default_rng(31), 0, 0, 0, set()
    for _ in range(300):
        text, spans = "", []
        for _ in range(6):
            text += " ".join(r.choice(PLAIN_WORDS, int(r.integers(3, 9)))) + " "
            what = str(r.choice(PLANTED if r.random() < 0.5 else ORDINARY))
            if what in PLANTED:
                spans.append((len(text), len(text) + len(what)))
            text += what + str(r.choice([" ", ", ", ". ", "; "]))
        got = {(a, b) for _, a, b in pii.find(tagger, [text])[0][1]}
        hit, said, there = hit + len(got & set(spans)), said + len(got), there + len(spans)
        missed |= {text[a:b] for a, b in set(spans) - got}
    print(f"spans of another generator: precision {hit / said:.3f}, recall {hit / there:.3f}, missed {missed}")
    assert hit / said > 0.9 and hit / there > 0.85


def test_added_spans_alone(tagger):
    """Precision and recall of what the network adds, apart from what the patterns find: over all, and recall by kind."""
    r, hit, said, there = np.random.default_rng(77), 0, 0, 0
    by_kind = {}
    for _ in range(400):
        text, spans = "", {}
        for _ in range(6):
            text += " ".join(r.choice(PLAIN_WORDS, int(r.integers(3, 9)))) + " "
            what = str(r.choice(PLANTED if r.random() < 0.5 else ORDINARY))
            if what in PLANTED:
                spans[len(text), len(text) + len(what)] = PLANTED.index(what)
            text += what + str(r.choice([" ", ", ", ". ", "; "]))
        base, every = pii.find(tagger, [text])[0]
        known = {(a, b) for _, a, b in base}
        added, want = {(a, b) for _, a, b in every} - known, set(spans) - known
        hit, said, there = hit + len(added & want), said + len(added), there + len(want)
        for s in want:
            kind = "email" if spans[s] < 5 else "ip" if spans[s] < 8 else "card" if spans[s] < 12 else "phone"
            found, of = by_kind.get(kind, (0, 0))
            by_kind[kind] = (found + (s in added), of + 1)
    print(f"added spans: precision {hit / said:.3f}, recall {hit / there:.3f}, by kind {by_kind}")
    assert hit / said > 0.9 and hit / there > 0.9
    assert all(found / of > 0.8 for found, of in by_kind.values())


def test_spelled_addresses_begin_with_one_word():
    for text, want in (("mail john at example dot com", "john at example dot com"), ("to anna.b [at] mail [dot] org", "anna.b [at] mail [dot] org"), ("to joe(at)web(dot)de", "joe(at)web(dot)de"), ("x AT y DOT z", "x AT y DOT z"), ("nothing", "nothing")):
        start, end = pii.tidied(text, 0, 0, len(text))
        assert text[start:end] == want
    assert pii.splits("dot and", 0, 6) and not pii.splits("dot and", 0, 7) and pii.splits("1234", 0, 2) and not pii.splits("tel12", 3, 5)


def test_network_alone_on_held_out_spans(tagger):
    r, hit, said, there = np.random.default_rng(99), 0, 0, 0
    for _ in range(200):
        text, spans = pii.lesson(r)
        got = set(pii.reconciled([p for p in pii.proposals(tagger, [text])[0] if pii.plausible(p[1], text[p[2] : p[3]], p[0])]))
        hit, said, there = hit + len(got & set(spans)), said + len(got), there + len(spans)
    assert hit / said > 0.9 and hit / there > 0.85


def test_network_adds_what_the_patterns_lose(tagger):
    lost = {
        "Call me maybe: {} or write.": ("phone", "+1 (843) 555-7672 170.106.47.218"), "Call {} now": ("phone", "020 7946 0958"), "tel. {}, merci": ("phone", "06 12 34 56 78"), "Ruf an: {} bitte": ("phone", "030 12345678"),
        "write to {} please": ("email", "jane.doe at example dot com"), "{} is it": ("email", "jörg.schmidt@müller.de"), "see {} there": ("ip", "10[.]20[.]30[.]40"), "card {} it is": ("card", "4111/1111/1111/1111"),
    }
    hits = 0
    for text, (kind, what) in lost.items():
        base, every = pii.find(tagger, [text.format(what)])[0]
        what = what.removesuffix(" 170.106.47.218")  # the pattern takes both numbers for one phone, of too many digits
        start = text.index("{")
        hits += (pii.KINDS.index(kind), start, start + len(what)) in set(every) - set(base)
        assert set(base) <= set(every), text
    assert hits >= len(lost) - 2  # trained weights may differ a little between machines


def test_spans_over_the_edges_of_windows_are_proposed_whole(tagger):
    long = "katharina.margarete.von.hohenstein-lindau_88@mail.department-of-physics.university.example.org"
    assert len(long) > pii.WINDOW + 16
    for what, kind in ((long, 0), ("4111 1111 1111 1111", 2), ("anna.smith@mail.example.com", 0)):
        hits = []
        for shift in range(0, pii.STRIDE, 3):
            text = " ".join(PLAIN_WORDS)[shift:100].rpartition(" ")[0] + " " + what + " and so on until the end of it all"
            start = text.index(what)
            hits.append((kind, start, start + len(what)) in {tuple(p[1:]) for p in pii.proposals(tagger, [text])[0]})
        assert sum(hits) >= 0.9 * len(hits), (what, hits)


def test_network_leaves_ordinary_texts_alone(spark, tagger):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = pii.scan(d, model=tagger)
    assert found.where("n_added > 0").count() <= 5 and found.where("n_added > 0 AND n_email + n_ip + n_card + n_phone = 0").count() <= 2


def test_pii_rows_against_plain_patterns(spark, data, tagger):
    d = documents(spark, data)
    for r in pii.scan(d, model=tagger).join(d.select("doc_id", "text"), "doc_id").collect():
        base = brute_base(r.text)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == kind for k, *_ in base) for kind in PLAIN)
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        every = [tuple(x.split(":")) for x in r.spans.split(",") if x]
        assert {(k, str(a), str(b)) for k, a, b in base} <= set(every) and len(every) == len(base) + r.n_added
        assert every == sorted(every, key=lambda x: (pii.KINDS.index(x[0]), int(x[1])))


def test_pii_odd_rows(odd, empty, tagger):
    rows = pii.scan(odd, model=tagger).collect()
    assert len(rows) == len(odd_rows()) and sum(r.n_email for r in rows) == 2
    none = hashlib.sha256(b"").hexdigest()
    assert all(r.base_sha256 == none and r.spans == "" for r in rows if r.doc_id in (2, 3, 4, 5))
    masked = pii.scan(odd, mask=True, model=tagger)
    assert masked.schema == odd.schema and masked.where("text LIKE '%<EMAIL>%'").count() == 2 and masked.where("text IS NULL").count() == 1
    assert all(r.n_chars == len(r.text) for r in masked.where("text LIKE '%<EMAIL>%'").collect())
    assert pii.scan(empty, model=tagger).count() == 0


def test_long_runs_take_linear_time(tagger):
    assert len(pii.find(tagger, ["1" * 60_000 + "a" * 200_000 + "@"])) == 1


# --- 4 quality ------------------------------------------------------------------------------------------------------------------


def brute_base_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    again = {w for w in windows if windows.count(w) > 1} if len(windows) < 3000 else {w for w, n in pd.Series(windows).value_counts().items() if n > 1}
    at = {i + k for i, w in enumerate(windows) if w in again for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(at)


def test_quality_odd_rows(odd, empty):
    rows = quality.quality(odd).collect()
    want = sorted([(str(r[0]), *brute_base_counts(r[1])) for r in odd_rows()])
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == want
    assert quality.quality(empty).count() == 0


def test_shared_lines_deplete_all_but_the_first(spark):
    line = "this very line is shared by a great many pages of one single host"
    rows = [(i, f"{line}\nand number {i}", "a") for i in range(30)] + [(100 + i, f"{line}\n" + " ".join(f"own{i}x{k}" for k in range(20)), "b") for i in range(5)]
    kept = {r.doc_id for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).where("kept").collect()}
    assert kept == {0} | {100 + i for i in range(5)}


# --- 5 licenses -----------------------------------------------------------------------------------------------------------------


def test_licenses_find_edited_notices(spark, odd, empty):
    mit = licenses.TEMPLATES["MIT"]
    rows = [(1, f"x y z {mit} tail"), (2, mit.replace("sublicense, ", "").upper()), (3, "Released under the MIT License."), (4, "Released the license."), (5, LONG + licenses.TEMPLATES["ISC"]), (None, licenses.TEMPLATES["GPL-3.0"]), (6, mit + " " + mit), (7, "x " + licenses.TEMPLATES["CC-BY-SA-4.0-reference"])]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = sorted((str(r.doc_id), r.license) for r in got)
    assert found == [("1", "MIT"), ("2", "MIT"), ("3", "MIT-reference"), ("5", "ISC"), ("6", "MIT"), ("6", "MIT"), ("7", "CC-BY-4.0-reference"), ("7", "CC-BY-SA-4.0-reference"), ("None", "GPL-3.0")]
    assert {r.license for r in got if r.doc_id == 7 and r.best} == {"CC-BY-SA-4.0-reference"}
    one = next(r for r in got if r.doc_id == 1)
    assert one.coverage == 1.0 and (one.span_start, one.span_end) == (6, 6 + len(mit) - 1)
    assert licenses.scan_licenses(odd).count() == 0 and licenses.scan_licenses(empty).count() == 0


def full_alignment(template, text):
    """Matched words of the best local alignment without a band: of equal scores the one with more matched words."""
    cells = [(0, 0)] * (len(text) + 1)
    best = (0, 0)
    for a in template:
        new = [(0, 0)]
        for j, b in enumerate(text):
            s, m = cells[j]
            options = [(s + 1, m + 1) if a == b else (s - 1, m), (cells[j + 1][0] - 1, cells[j + 1][1]), (new[-1][0] - 1, new[-1][1])]
            top = max(options)
            new.append(top if top[0] > 0 else (0, 0))
            best = max(best, new[-1])
        cells = new
    return best[1]


def edited(r, template, share):
    """The words of a template with about ``share`` of them replaced, dropped, or followed by another."""
    out = []
    for w in template:
        kind = r.integers(0, 3) if r.random() < share else 9
        out += {0: ["zzz"], 1: [], 2: [w, "yyy"]}.get(int(kind), [w])
    return out


def test_licenses_against_full_alignment_of_edited_notices():
    r, index = np.random.default_rng(12), licenses.Index(licenses.TEMPLATES)
    tally = {}
    for name, template in licenses.TEMPLATES.items():
        for share in (0.01, 0.05, 0.1, 0.15, 0.2):
            for _ in range(12):
                text = ["lorem"] * int(r.integers(0, 9)) + edited(r, licenses.words(template), share) + ["ipsum"] * int(r.integers(0, 9))
                found = {x[0] for x in licenses.scan_texts(index, [" ".join(text)])[0]}
                for other in licenses.TEMPLATES:
                    t = licenses.words(licenses.TEMPLATES[other])
                    if other == name or other in found:
                        want = full_alignment(t, text) >= licenses.COVERAGE * len(t) - 1e-9
                        right, there, said = tally.get(other, (0, 0, 0))
                        tally[other] = (right + (want and other in found), there + want, said + (other in found))
    for name, (right, there, said) in tally.items():
        print(f"{name}: recall {right}/{there}, precision {right}/{said}")
        assert right >= 0.9 * there and right == said, name


def test_licenses_one_changed_word_in_short_references():
    index = licenses.Index(licenses.TEMPLATES)
    for name, template in licenses.TEMPLATES.items():
        t = licenses.words(template)
        for i in range(len(t)):
            text = [*t[:i], "zzz", *t[i + 1 :]]
            if full_alignment(t, text) >= licenses.COVERAGE * len(t) - 1e-9:
                assert name in {x[0] for x in licenses.scan_texts(index, [" ".join(text)])[0]}, (name, i)


def test_licenses_on_the_documents(spark, data):
    """Every text that holds a template's words in a row is found, and no text without most of them is."""
    index = licenses.Index(licenses.TEMPLATES)
    for r in documents(spark, data).collect():
        words = licenses.words(r.text)
        found = {x[0] for x in licenses.scan_texts(index, [r.text])[0]}
        for name, template in licenses.TEMPLATES.items():
            t = licenses.words(template)
            whole = any(words[i : i + len(t)] == t for i in range(len(words) - len(t) + 1))
            assert not whole or name in found
            assert name not in found or len(set(t) & set(words)) >= 0.75 * len(set(t))


# --- 6 top-k --------------------------------------------------------------------------------------------------------------------


def brute_topk(rows, k):
    out = set()
    for q, a in rows:
        if q is None or q % 20:
            continue
        s = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in rows if i is not None and i != q and len(a) == len(b))
        out |= {(q, n + 1, i, -v) for n, (v, i) in enumerate(s[:k])}
    return out


@pytest.mark.parametrize("blocks", [(16_384, 4_096), (7, 2)])
@pytest.mark.parametrize("scale", [1.0, 1e6])
def test_topk_is_exact_with_ties(spark, monkeypatch, blocks, scale):
    monkeypatch.setattr(topk, "ROWS", blocks[0])
    monkeypatch.setattr(topk, "QUERIES", blocks[1])
    monkeypatch.setattr(topk, "HELD", 100 * blocks[1])
    r = np.random.default_rng(2)
    v = [[float(x) for x in r.integers(-3, 4, 6) / 4 * scale] for _ in range(90)]
    v[21:40] = [v[20]] * 19
    rows = list(enumerate(v))
    d = spark.createDataFrame([*rows, (100, None), (120, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (140, [float("nan")] * 6), (160, [float("inf")] * 6), (None, v[0]), (3, v[3])], "vec_id long, embedding array<double>")
    got = {(x.query_id, x.rank, x.vec_id, x.score) for x in topk.top_k(d, d.where("vec_id % 20 = 0"), 5).collect()}
    assert got == brute_topk([(i, [int(np.floor(64 * x)) for x in a]) for i, a in rows], 5)


def test_topk_few_rows_and_none(spark):
    d = spark.createDataFrame([(0, [1.0, 0.0]), (1, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(d, d.where("vec_id = 0")).collect()] == [(0, 1, 1, -4096)]
    assert topk.top_k(d.limit(0), d.limit(0)).count() == 0


def test_topk_of_repeated_ids_with_unlike_vectors(spark, monkeypatch):
    """Answers are lists: equal triples of one id stand for different rows and none is lost."""
    r = np.random.default_rng(6)
    for rows_of, blocks in (((1, 25),), 65_536), (((1, 25), (20, 3), (33, 4)), 16):
        monkeypatch.setattr(topk, "ROWS", blocks)
        rows = [(0, [8, 0, 0, 0])] + [(i, [4, k, -k, k % 3]) for i, n in rows_of for k in range(n)] + [(100 + i, r.integers(-9, 5, 4).tolist()) for i in range(28)]
        d = spark.createDataFrame([(i, [x / 64 for x in v]) for i, v in rows], "vec_id long, embedding array<double>")
        want = []
        for q in sorted({i for i, _ in rows if i % 20 == 0}):
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for p, a in rows if p == q for i, b in rows if i != q)
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:20])]
        assert sorted(map(tuple, topk.top_k(d, d.where("vec_id % 20 = 0")).collect())) == sorted(want)


def test_topk_empty_and_unlike_lengths_and_clashing_names(spark):
    rows = [(0, []), (1, []), (2, [1.0]), (20, [2.0]), (40, [1.0, 1.0]), (41, [2.0, -1.0]), (60, [0.5] * 7), (61, []), (80, None)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("clash") for c in ("v", "r", "c", "n", "rank", "score", "cutoff", "query_id")})
    got = {tuple(r) for r in topk.top_k(d, d.where("vec_id % 20 = 0"), 2).collect()}
    assert got == brute_topk([(i, [int(64 * x) for x in a]) for i, a in rows if a is not None], 2) and (0, 1, 1, 0) in got


def test_topk_scores_fewer_pairs_than_brute_force():
    r = np.random.default_rng(4)
    near = r.normal(0, 1, (30, 1, 64)) + r.normal(0, 0.05, (30, 40, 64))  # 30 close groups of 40, and 1000 rows far from all
    x = np.concatenate([near.reshape(-1, 64), r.normal(0, 1, (1000, 64))])
    x = np.floor(64 * x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.int64)
    order = r.permutation(len(x))
    q, x = topk.exact(x[::20], x[order])
    i, j, s = topk.local_lists(q, x, 21)
    cutoff = np.array([np.sort(s[i == k])[-20] for k in range(len(q))], float)
    i, j, s, n = topk.sufficient(q, x, cutoff)
    assert set(zip(i.tolist(), j.tolist(), s.tolist())) == {(a, b, int(v)) for a, row in enumerate(q @ x.T) for b, v in enumerate(row) if v >= cutoff[a]}
    assert n < 0.55 * len(q) * len(x)


# --- 7 language -----------------------------------------------------------------------------------------------------------------


def test_language_on_held_out_documents(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.learn(d)
    found = langid.identify(d, model).where(langid.held_out())
    right, n = found.where("lang = lang_pred").count(), found.count()
    assert right / n > 0.97
    assert found.where("score < 0 OR score > 1").count() == 0


def test_language_odd_rows(odd, empty):
    model = langid.learn(odd)
    rows = langid.identify(odd, model).collect()
    assert len(rows) == len(odd_rows())
    for r in rows:
        letters = r.text is not None and any(map(str.isalpha, r.text))
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1
    assert langid.learn(empty) is None and langid.identify(empty, None).count() == 0
    assert {r.lang_pred for r in langid.identify(odd, None).collect()} == {"und"}


def test_compiled_filters_equal_the_plain_network():
    m = langid.ByteCNN(["a", "b"])
    x = np.random.default_rng(0).integers(0, 256, (3, 20)).astype(np.uint8)
    h = []
    for w in langid.WIDTHS:
        padded = np.concatenate([x, np.zeros((3, 8), np.uint8)], 1)
        z = sum((m.p["e"] @ m.p[f"w{w}"][k])[padded[:, k : k + 19]] for k in range(w))
        h.append(z.max(1) + m.p[f"b{w}"])
    q = np.exp(np.maximum(np.concatenate(h, 1), 0) @ m.p["v"] + m.p["c"])
    assert np.allclose(langid.probabilities(m.compile(), x), q / q.sum(1, keepdims=True), atol=1e-4)


# --- 8 near-duplicates ----------------------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


@pytest.mark.parametrize("most", [4096, 5])
def test_simhash_against_brute_force(spark, data, monkeypatch, most):
    monkeypatch.setattr(simhash, "MOST", most)  # with 5, crowded keys are split into parts
    d = documents(spark, data).select("doc_id", "text").orderBy("doc_id")
    rows = d.collect()
    near = [(1000 + i, " ".join([*rows[0].text.split()[:200], "new" * (i % 9), str(i // 9)])) for i in range(40)]
    every = [(r.doc_id, r.text) for r in rows] + near
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(every, "doc_id long, text string")).collect()}
    fps = [brute_fingerprint(t) for _, t in every]
    comps = brute_components(fps)
    assert got == {i: (f, every[c][0]) for (i, _), f, c in zip(every, fps, comps)}


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 200)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {200: 200, 201: 200}


def test_simhash_odd_rows(odd, empty):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == len(odd_rows())
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add((r.fp, r.component_id))
    assert by[2] == by[3] == by[4] == {(0, 2)} and {c for _, c in by[6]} == {1}
    kept = simhash.survivors(odd)
    assert kept.schema == odd.schema and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "5", "7", "8", "9", "None"]
    assert simhash.near_duplicates(empty).count() == 0 and simhash.survivors(empty).count() == 0


# --- 9 store --------------------------------------------------------------------------------------------------------------------


def test_store_round_trip(spark, data, tokenizer, tmp_path):
    d = documents(spark, data).repartition(5)
    path = str(tmp_path / "store")
    store.write_store(d, path, BPE)
    at, want = 0, {}
    for r in sorted(d.collect(), key=lambda r: r.doc_id):
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        want[r.doc_id] = (at, len(ids), zlib.crc32(ids.tobytes()), ids)
        at += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in store.digests(spark, path).collect()} == {k: v[:3] for k, v in want.items()}
    for r in store.read_documents(spark, path).collect():
        assert np.frombuffer(r.ids, "<u2").tolist() == want[r.doc_id][3].tolist()
    chunks = spark.read.parquet(f"{path}/content").where("kind = 'chunk'")
    assert chunks.count() == chunks.select("name").distinct().count()
    m = spark.read.parquet(f"{path}/manifest")
    assert m.agg(F.sum("documents"), F.sum("tokens")).first() == (len(want), at)


def test_store_sees_damage(spark, tmp_path):
    path = str(tmp_path / "store")
    store.write_store(spark.createDataFrame([(1, "hello there")], "doc_id long, text string"), path, BPE)
    content = spark.read.parquet(f"{path}/content").where("kind = 'chunk'").withColumn("ids", F.encode(F.lit("xxxx"), "utf-8"))
    content.write.mode("overwrite").parquet(str(tmp_path / "bad"))
    import shutil

    shutil.rmtree(f"{path}/content/kind=chunk")
    spark.read.parquet(str(tmp_path / "bad")).drop("kind").write.parquet(f"{path}/content/kind=chunk")
    with pytest.raises(Exception, match="does not match its name"):
        store.digests(spark, path).collect()


@pytest.fixture(scope="module")
def stored(spark, data, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("whole") / "store")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several parts
    store.write_store(documents(spark, data), path, BPE)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spark.read.parquet(f"{path}/manifest").count() > 1
    return path


def parquet_files(path):
    import glob

    return sorted(glob.glob(f"{path}/*.parquet"))


@pytest.mark.parametrize("part, match", [("ordered/kind=recipe", "missing or changed"), ("content/kind=chunk", "chunks are missing"), ("manifest", "missing or changed")])
def test_store_sees_what_is_lost(spark, stored, tmp_path, part, match):
    import os
    import shutil

    path = str(tmp_path / "store")
    shutil.copytree(stored, path)
    if part != "manifest":
        os.remove(parquet_files(f"{path}/{part}")[0])
    else:  # one row of the manifest
        spark.read.parquet(f"{stored}/manifest").where("part > 0").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")
    with pytest.raises(Exception, match=match):
        store.digests(spark, path).collect()
    with pytest.raises(Exception, match=match):
        store.read_documents(spark, path).collect()


def test_store_sees_changed_recipes(spark, stored, tmp_path):
    """A recipe whose own root fits it, but which is not the one that was written."""
    import shutil

    path = str(tmp_path / "store")
    shutil.copytree(stored, path)
    recipes = spark.read.parquet(f"{stored}/ordered/kind=recipe")
    other = recipes.where("part = 0").orderBy("within").first()
    swapped = recipes.withColumn("root", F.when((F.col("part") == 0) & (F.col("within") > 0) & (F.col("n_tokens") == other.n_tokens), F.lit(bytes(other.root))).otherwise(F.col("root")))
    swapped = swapped.withColumn("doc_id", F.col("doc_id") + 1).withColumn("n_tokens", F.when(F.col("within") == 0, F.col("n_tokens") + 1).otherwise(F.col("n_tokens")))
    shutil.rmtree(f"{path}/ordered/kind=recipe")
    swapped.write.parquet(f"{path}/ordered/kind=recipe")
    with pytest.raises(ValueError, match="missing or changed"):
        store.check_manifest(spark, path)


def test_store_odd_rows(spark, odd, empty, tokenizer, tmp_path):
    path = str(tmp_path / "store")
    store.write_store(odd, path, BPE)
    rows = sorted(store.digests(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, None, 1, 2, 3, 4, 5, 6, 6, 7, 8, 9]
    assert [r.start for r in rows] == list(np.cumsum([0] + [r.n_tokens for r in rows[:-1]])) and rows[3].n_tokens == rows[4].n_tokens == 1
    store.write_store(empty, str(tmp_path / "none"), BPE)
    assert store.digests(spark, str(tmp_path / "none")).count() == 0


def test_equal_passages_share_chunks():
    r = np.random.default_rng(3)
    shared, a, b = (r.integers(0, 50_000, n).astype(np.uint16) for n in (20_000, 3_000, 5_000))
    names = []
    for ids in (np.concatenate([a, shared]), np.concatenate([b, shared])):
        at, own = 0, set()
        for end in store.cuts(ids, np.array([len(ids)]), 50_257):
            own.add(ids[at:end].tobytes())
            at = end
        names.append(own)
    assert len(names[0] & names[1]) > 0.6 * len(names[0])


def test_crc_arithmetic():
    r = np.random.default_rng(5)
    parts = [r.bytes(int(n)) for n in r.integers(0, 5000, 12)]
    after = np.cumsum([0] + [len(p) for p in parts[::-1]])[:-1][::-1]
    assert np.bitwise_xor.reduce(store.shifted(np.array([zlib.crc32(p) for p in parts]), after)) == zlib.crc32(b"".join(parts))


# --- 10 mixing ------------------------------------------------------------------------------------------------------------------


def test_mixing_meets_its_margins_and_its_budget(spark, data):
    d = documents(spark, data)
    for budget in (0.5, 0.15):
        rows = mixing.mix(d, budget=budget).toPandas()
        rows["mass"] = rows.tokens * rows.weight
        for col in ("source", "language", "topic"):
            own = rows.groupby(col).tokens.sum() ** mixing.FLATTEN
            want, got = own / own.sum(), rows.groupby(col).mass.sum() / rows.tokens.sum()
            assert np.allclose(want, got.reindex(want.index), atol=mixing.TOLERANCE), col
        assert ((rows.probability > 0) & (rows.probability <= 1)).all() and rows.topic.nunique() > 3
        assert (rows.tokens * rows.probability).sum() == pytest.approx(budget * rows.tokens.sum(), rel=1e-6)
        ratio = rows.probability / rows.weight  # one rate for all that are not certain
        assert ratio[rows.probability < 1].std() < 1e-9 and (ratio[rows.probability == 1] <= ratio[rows.probability < 1].max() + 1e-12).all()
        assert abs(rows.kept.mean() - rows.probability.mean()) < 0.1


def test_mixing_topics_against_plain_counts(spark, data):
    d = documents(spark, data)
    words = {r.doc_id: re.findall(r"[^\x20\x09-\x0D]+", r.text) for r in d.collect()}
    group = lambda w: (sum(f * ord(c) for f, c in zip((31, 7, 3), w)) + len(w)) % 8
    counts = {i: np.bincount([group(w) for w in ws], minlength=8) for i, ws in words.items()}
    lang = {r.doc_id: r.lang or "unknown" for r in d.collect()}
    used = {x: sum(c for i, c in counts.items() if lang[i] == x) for x in set(lang.values())}
    for r in mixing.mix(d).collect():
        c, u = counts[r.doc_id], used[r.language]
        over = [(c[k] + 1) * float(u.sum()) / (float(c.sum()) * u[k] + u.sum() + 1) for k in range(8)]
        assert r.topic == f"words{over.index(max(over))}"


def test_mixing_says_what_cannot_be_met(spark):
    d = spark.createDataFrame([(1, "a b", "en", "x"), (2, "c d", "de", "y")], "doc_id long, text string, lang string, source string")
    with pytest.warns(UserWarning, match="a margin is still off by 0.[45]"):
        mixing.mix(d, targets={"source": {"x": 0.9, "y": 0.1}, "language": {"en": 0.4, "de": 0.6}}, topic="lang")
    own = mixing.mix(d.withColumn("theme", F.lit("t")), topic="theme")
    assert {r.topic for r in own.collect()} == {"t"}


def test_mixing_given_targets(spark, data):
    d = documents(spark, "/root/testdata/sf0.01")  # with 200 documents most cells are empty
    rows = mixing.mix(d, targets={"language": {"en": 0.25, "de": 0.75}}).toPandas()
    mass = (rows.tokens * rows.weight).groupby(rows.language).sum() / rows.tokens.sum()
    assert mass["en"] == pytest.approx(0.25, abs=1e-3) and mass["de"] == pytest.approx(0.75, abs=1e-3) and not rows[rows.language == "fr"].kept.any()


def test_mixing_odd_rows(odd, empty):
    rows = mixing.mix(odd).collect()
    assert len(rows) == len(odd_rows()) and {r.source for r in rows} == {"a", "b", "c", "unknown"} and all(r.tokens >= 1 for r in rows)
    kept = mixing.sampled(odd)
    assert kept.schema == odd.schema and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in rows if r.kept)
    assert mixing.mix(empty).count() == 0 and mixing.sampled(empty).count() == 0


def test_mixing_given_source_targets(spark, data):
    d = documents(spark, data)
    names = sorted(r.source for r in d.select("source").distinct().collect() if r.source)[:2]
    goals = dict(zip(names, (0.25, 0.75)))
    frame = spark.createDataFrame(list(goals.items()), "s string, goal double")
    for given in (goals, frame):
        rows = mixing.mix(d, targets={"source": given}).toPandas()
        share = (rows.tokens * rows.weight).groupby(rows.source).sum() / (rows.tokens * rows.weight).sum()
        assert np.allclose(share[names], list(goals.values()), atol=1e-6) and set(rows[rows.kept].source) <= set(names)
    with pytest.raises(ValueError, match="unknown targets: sources"):
        mixing.mix(d, targets={"sources": goals})
