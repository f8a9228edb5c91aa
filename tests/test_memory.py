"""Golden cases of the memory engine: tables of statements, events, guards, coverage, caches."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.config import DEFAULT, KOREAN, Config
from palimpsest.functions import scoring, text
from palimpsest.operators import digests, episodes, facts, gate, memory, retrieval
from palimpsest.plans import cache

K = Config(pack=KOREAN)


def test_fact_stream(spark):
    rows = [
        (10, "유저", "직업", "마케팅 회사 대리", 0.90), (60, "유저", "반려동물_이름", "나비", 0.90), (95, "유저", "신체_특성", "카페인 민감", 0.90),
        (240, "유저", "가족", "여동생 1명", 0.85), (250, "유저", "직업", "마케팅 회사 대리", 0.90), (390, "친구", "지인_반려동물", "코코", 0.80),
        (630, "유저", "직업", "스타트업 프로덕트 매니저", 0.95), (700, "유저", "가족", "오빠 1명", 0.40), (705, "유저", "반려동물_이름", "코코", 0.50),
    ]
    start = dt.datetime(2026, 1, 1)
    s = spark.createDataFrame([(n, a, b, c, d, start + dt.timedelta(minutes=n)) for n, a, b, c, d in rows], "id long, subject string, predicate string, object string, confidence double, ts timestamp")
    acted = facts.actions(s, K)
    assert [r.action for r in acted.orderBy("id").collect()] == ["created"] * 4 + ["reinforced", "created", "superseded", "held", "held"]
    stored = facts.history(acted, K)
    assert stored.count() == 6 and facts.current(stored).count() == 5 and facts.supersessions(stored).count() == 1
    old = stored.where("fact_id = 10").first()
    assert (old.mention_count, old.confidence, old.superseded_by) == (2, 0.95, 630)
    at = lambda n: F.lit(start + dt.timedelta(minutes=n))
    job = lambda n: [r.object for r in facts.valid_at(stored, at(n)).where("predicate = '직업'").collect()]
    assert job(629) == ["마케팅 회사 대리"] and job(630) == ["스타트업 프로덕트 매니저"]


def test_one_live_row_and_disjoint_intervals(spark, data):
    from palimpsest.queries.facts import stored

    f = stored(spark, data).where(F.col("predicate").isin(*DEFAULT.pack.cardinality_one))
    assert f.where("valid_until IS NULL").groupBy("subject", "predicate").count().where("count > 1").count() == 0
    assert f.where("valid_until < valid_from").count() == 0


def test_deletion_spreads_to_all_that_is_derived(spark):
    links = spark.createDataFrame([("f", 1, "digest", "a"), ("f", 2, "digest", "a"), ("f", 3, "event", "b")], "source_kind string, source_id long, derived_kind string, derived_key string")
    gone = facts.stale_from(spark.createDataFrame([("f", 2)], "source_kind string, source_id long"), links)
    assert [tuple(r) for r in gone.collect()] == [("digest", "a", 1)]
    assert [r.derived_key for r in facts.without_stale(links.select("derived_kind", "derived_key").distinct(), gone).collect()] == ["b"]


def test_korean_text(spark):
    d = spark.createDataFrame([("나비 아팠던 거 기억나?", "나비가 갑자기 아파서 응급실에 감")], "q string, d string")
    n, raw = text.stemmed_bigrams, text.bigrams
    r = d.select(text.containment(F.array_distinct(n(F.col("q"), KOREAN)), F.array_distinct(n(F.col("d"), KOREAN))), text.containment(F.array_distinct(raw(F.col("q"))), F.array_distinct(raw(F.col("d"))))).first()
    assert (round(r[0], 6), round(r[1], 6)) == (round(1 / 6, 6), round(1 / 9, 6))


def test_text_edges(spark):
    d = spark.createDataFrame([(None,), ("",), ("a",), (" Hi,  there! ",)], "t string")
    assert [r[0] for r in d.select(text.words(F.col("t"))).collect()] == [[], [], ["a"], ["Hi", "there"]]
    assert [r[0] for r in d.select(text.bigrams(F.col("t"))).collect()] == [[""], [""], ["a"], ["Hi", "i,", ",t", "th", "he", "er", "re", "e!"]]
    assert [r[0] for r in d.select(text.tokens(F.col("t"))).collect()] == [1, 1, 1, 19]


def test_event_dedup(spark):
    rows = [("c", 1, "나비가 갑자기 아파서 응급실에 갔다", 0.5), ("c", 5, "나비가 아파서 응급실 갔다", 0.9), ("c", 19, "비가 와서 늦었다 정말", 0.1), ("c", 20, "비가 와서 늦었다 정말", 0.1)]
    items = spark.createDataFrame(rows, "chat string, seq long, summary string, weight double")
    a = episodes.dedup(items, K)
    assert [tuple(r) for r in a.orderBy("seq").select("seq", "action", "into").collect()] == [(1, "created", 1), (5, "merged", 1), (19, "created", 19), (20, "created", 20)]
    assert [tuple(r) for r in episodes.stored_events(items, a).where("seq = 1").select("mentions", "weight").collect()] == [(2, 0.9)]


def test_clusters_and_penalty():
    s = [frozenset("ab"), frozenset("abc"), frozenset("xy"), frozenset("bc")]
    assert episodes.clustered(s, 0.5) == [0, 0, 1, 0] and episodes.clustered(s, 0.9) == [0, 1, 2, 3]
    same = [{1: 0.9, 2: 0.8, 3: 0.7, 4: 0.65}] * 3
    assert episodes.penalised(same, 0.0) == [[1, 2, 3]] * 3
    assert episodes.penalised(same, 0.3)[1] == [4, 1, 2]


def plain_clusters(sets, at_least):
    """How many sets every cluster gets: each set joins the cluster that holds its closest earlier set, if that is close enough."""
    clusters = []
    for s in sets:
        found = [(max(len(s & t) / (len(s | t) or 1) for t in members), -n) for n, members in enumerate(clusters)]
        share, which = max(found, default=(0.0, 0))
        if share > 0 and share >= at_least:
            clusters[-which].append(s)
        else:
            clusters.append([s])
    return [len(c) for c in clusters]


def plain_picks(queries, penalty):
    """(repeats, picks, distinct items) of one chat: the three best of every query, where an item loses ``penalty`` for every earlier pick."""
    shown, log = {}, []
    for scores in queries:
        left, now = {i: round(v - penalty * shown.get(i, 0), 6) for i, v in scores.items()}, []
        while left and len(now) < 3:
            top = max(left.values())
            now.append(min(i for i, v in left.items() if v == top))
            del left[now[-1]]
        for i in now:
            shown[i] = shown.get(i, 0) + 1
        log.append(now)
    repeats = sum(any(i in before for before in log[max(0, n - 3) : n]) for n, now in enumerate(log) for i in now)
    return repeats, sum(map(len, log)), len(shown)


def test_queries_without_sql_match_a_plain_version(spark, data):
    from palimpsest.queries import QUERIES, context
    from palimpsest.queries.context import turns

    rows = turns(spark, data).select("chat", "seq", text.stemmed_bigrams(F.col("text")).alias("t")).orderBy("chat", "seq").collect()
    chats = {}
    for r in rows:
        chats.setdefault(r.chat, []).append(frozenset(r.t))
    want = {(t, c): plain_clusters(s, t) for c, s in chats.items() for t in (0.2, 0.3, 0.45)}
    got = {(r.threshold, r.chat): (r.clusters, r.largest) for r in QUERIES["observation_clusters"](spark, data).collect()}
    assert got == {k: (len(v), max(v)) for k, v in want.items()} and len({len(v) for v in want.values()}) > 2
    scored = memory.judged(context.asked(spark, data), context.items(spark, data).withColumn("surfaced", F.lit(0)), context.C).collect()
    per = {}
    for r in scored:
        per.setdefault(r.chat, {}).setdefault(r.now, {})[r.item] = r.score
    for r in QUERIES["repeat_penalty"](spark, data).collect():
        sums = [plain_picks([q[n] for n in sorted(q)], r.penalty) for q in per.values()]
        assert (r.repeats, r.picks, r.distinct_items) == tuple(map(sum, zip(*sums)))


def test_clusters_over_blocks(spark, monkeypatch):
    """Blocks of a chat, ties, repeated rows, equal turns, null texts and a null chat, against the plain version."""
    monkeypatch.setattr(episodes, "TURNS", 16)
    monkeypatch.setattr(episodes, "SETS", 60)
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(12)]
    rows = [(c, n // (2 if c == "b" else 1), " ".join(rng.choices(words, k=rng.randint(1, 4)))) for c in ("a", "b", None) for n in range(70)]
    rows += [("a", 100, None), ("a", 101, ""), ("a", 102, None), ("one", 0, "x"), *rows[:20]]
    items = spark.createDataFrame(rows, "chat string, seq long, text string")
    terms = items.select("chat", "seq", F.array_sort(F.array_distinct(text.stemmed_bigrams(F.col("text"), K.pack))).alias("t")).collect()
    firsts = {}
    for r in terms:
        key = (r.chat, tuple(r.t))
        seq, n = firsts.get(key, (r.seq, 0))
        firsts[key] = (min(seq, r.seq), n + 1)
    got = {(r.threshold, r.chat): (r.clusters, r.largest) for r in episodes.observations(items, (0.3, 0.5, 0.7), K).collect()}
    for chat in ("a", "b", None, "one"):
        order = sorted((seq, t, n) for (c, t), (seq, n) in firsts.items() if c == chat)
        for at in (0.3, 0.5, 0.7):
            sets = [frozenset(t) for _, t, n in order]
            labels = episodes.clustered(sets, at)
            assert [labels.count(x) for x in sorted(set(labels))] == plain_clusters(sets, at)
            sizes = {}
            for x, (_, _, n) in zip(labels, order):
                sizes[x] = sizes.get(x, 0) + n
            assert got[at, chat] == (len(sizes), max(sizes.values()))
    assert episodes.observations(items.limit(0), (0.3,), K).count() == 0


def test_closest_is_exact():
    rng = random.Random(9)
    for at_least in (0.1, 0.34, 0.5, 0.8, 1.0):
        sets = [frozenset(rng.sample(range(14), rng.randint(1, 6))) for _ in range(90)]
        flat = np.array([(i, t) for i, s in enumerate(sets) for t in s])
        side = (np.arange(90), flat[:, 0], flat[:, 1])
        want = set()
        for i, s in enumerate(sets):
            shares = [len(s & t) / len(s | t) for t in sets[:i]]
            want |= {(i, j, x) for j, x in enumerate(shares) if x == max(shares) and x > 0 and x >= at_least}
        assert set(zip(*(a.tolist() for a in episodes.closest(side, side, at_least)))) == want


def test_repetition_of_odd_rows(spark):
    """Nothing before a query, equal turns, null texts, a null chat; the stream against scores of all pairs."""
    rng = random.Random(3)
    words = ["river", "stone", "cloud", "bread", "lamp", "horse", "glass"]
    say = lambda: " ".join(rng.choices(words, k=rng.randint(1, 5)))
    asked = spark.createDataFrame([(c, n, say() if n % 9 else None) for c in ("a", "b") for n in range(0, 60, 2)] + [("c", 1, "river"), (None, 3, "river")], "chat string, now long, query string")
    rows = [(c, 100 + n, n, say() if n % 7 else None, rng.random(), rng.random(), None if n % 5 else 1) for c in ("a", "b") for n in range(1, 60, 3)] + [("c", 9, 1, "river", 0.5, None, 0), (None, 7, 1, "river", None, 0.5, 0)]
    items = spark.createDataFrame(rows, "chat string, item long, seq long, summary string, importance double, emotion double, surfaced int")
    got = {(r.penalty, r.chat): (r.repeats, r.picks, r.distinct_items) for r in episodes.repetition(asked, items, (0.0, 0.2), K).collect()}
    per = {}
    for r in memory.judged(asked, items, K).collect():
        per.setdefault(r.chat, {}).setdefault(r.now, {})[r.item] = r.score
    for p in (0.0, 0.2):
        for chat, q in per.items():
            assert got[p, chat] == plain_picks([q[n] for n in sorted(q)], p)
        assert got[p, "c"] == (0, 0, 0) and got[p, None] == (0, 1, 1)


def test_stems_reach_their_fixpoint(spark):
    word = "w" + "ed" * 12
    d = spark.createDataFrame([(word,), ("xx" + "tioning" * 6,)], "w string")
    assert [r[0] for r in d.select(text.stem(F.col("w"))).collect()] == ["w", "xx"]


# Answers and what the typed scorer must say of them.
TYPED = [
    ("single_hop", "나비", "나비잖아. 벌써 잊었냐.", True), ("single_hop", "나비", "글쎄, 기억이 잘 안 나는데.", False), ("single_hop", "안 된다 / 카페인 민감하다", "너 카페인 민감하잖아. 마시지 마라.", True),
    ("single_hop", "안 된다 / 카페인 민감하다", "마셔도 되지 뭐.", False), ("single_hop", "여동생 한 명", "여동생 하나 있다고 했지.", True), ("single_hop", "스타트업 프로덕트 매니저", "스타트업에서 PM 하잖아.", None),
    ("abstention", None, "그런 적 없는데?", None), ("abstention", None, "아 그거 재밌었지.", None), ("coverage", None, "초반은 기억이 잘 안 나.", None),
]


def test_typed_scorer(spark):
    d = spark.createDataFrame([(i, *row[:3]) for i, row in enumerate(TYPED)], "i int, kind string, gold string, answer string")
    said = scoring.typed_verdict(F.col("kind"), F.col("gold"), F.col("answer"), KOREAN, scoring.NUMBERS_KOREAN, scoring.TAIL_KOREAN, scoring.SMALL_KOREAN)
    assert [r[0] for r in d.orderBy("i").select(said).collect()] == [row[3] for row in TYPED]


def test_guard_reads_the_state(spark):
    rows = [
        ("자기야, 밥은 먹었어?", "헤어짐", "반말", False, ["stage=헤어짐"], ["stage=헤어짐"]), ("자기야, 밥은 먹었어?", "연인", "반말", False, [], []), ("네, 알겠습니다.", "연인", "반말", False, ["speech=반말"], ["speech=반말"]),
        ("네, 알겠습니다.", "연인", "존댓말", False, [], []), ("엄마가 부르시네.", "연인", "반말", True, ["scene=roster"], ["scene=roster"]), ("엄마가 부르시네.", "연인", "반말", False, [], []),
        ("예전엔 자기야라고 불렀지.", "낯섦", "반말", False, ["stage=낯섦"], []),
    ]
    d = spark.createDataFrame([(i, *r[:4]) for i, r in enumerate(rows)], "i int, t string, stage string, speech string, locked boolean")
    state = {c: F.col(c) for c in ("stage", "speech", "locked")}
    for at, excuse in ((4, None), (5, scoring.GUARD_KOREAN["excuse"])):
        got = d.orderBy("i").select(scoring.violations(F.col("t"), state, scoring.STATE_RULES_KOREAN, scoring.GUARD_KOREAN["roster"], excuse)).collect()
        assert [r[0] for r in got] == [r[at] for r in rows]


def test_polite_endings_and_questions_about_the_family(spark):
    rows = [("밥 먹었어요.", True, False), ("밥 먹었어. 그랬습니다! 응", True, False), ("밥 먹었어", False, False), ("요", False, False), ("동생은 잘 지내?", False, True), ("동생 얘기 그만해", False, False), ("집에 무슨 일 있냐", False, True)]
    d = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(rows)], "i int, t string")
    got = d.orderBy("i").select(scoring.polite(F.col("t"), scoring.HONORIFIC_KOREAN), scoring.probes(F.col("t"), scoring.FAMILY_KOREAN)).collect()
    assert [tuple(r) for r in got] == [r[1:] for r in rows]


def test_passages_are_found_in_texts(spark):
    docs = [(1, "one two three four five six seven"), (2, "xone two three four fivex"), (3, None), (4, ""), (5, "two  three four"), (6, "a-b c"), (7, "one two\nthree four five six")]
    asked = [(1, "two three four five six"), (2, "one two three four five"), (3, "b c"), (4, ""), (5, None), (6, "-"), (7, "e two three"), (8, "two\nthree four five"), (9, " three four")]
    got = retrieval.holding(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asked, "query_id long, passage string"))
    assert sorted(map(tuple, got.collect())) == sorted((q, d) for q, p in asked if p for d, t in docs if t and p in t)


def test_passages_in_long_texts_are_found_in_one_pass(spark, monkeypatch):
    """A text of 20 000 words and passages of one word and more, dealt over several passes; in time that grows with the text only."""
    import random
    import time

    rnd = random.Random(2)
    words = [f"w{rnd.randrange(3000)}" for _ in range(20_000)]
    docs = [(1, " ".join(words)), (2, " ".join(words[::-1])), (3, "w1"), (4, " ".join(words)), (None, "w1 w2")]
    asked = [(i, " ".join(words[i : i + 1 + i % 40])) for i in range(0, 3000, 7)] + [(9000, "w1"), (9001, "w1"), (9002, " ".join(words)), (9003, "no such words"), (9004, "w" * 60)]
    monkeypatch.setattr(retrieval, "PASS", 40_000)
    start = time.perf_counter()
    got = retrieval.holding(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asked, "query_id long, passage string")).collect()
    assert time.perf_counter() - start < 30
    assert sorted(map(str, map(tuple, got))) == sorted(str((q, d)) for q, p in asked for d, t in docs if p in t)


def test_word_borders_know_accents(spark):
    d = spark.createDataFrame([("éour ?",), ("our?",), ("(our) ?",), ("ours ?",), ("x_our ?",), ("our",), ("?\nour",)], "t string")
    assert [r[0] for r in d.select(scoring.probes(F.col("t"), scoring.FAMILY_LATIN)).collect()] == [False, True, True, False, False, False, True]


def test_vectors_meet_in_blocks(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(retrieval, "ROWS", 7)
    monkeypatch.setattr(retrieval, "QUERIES", 2)
    v = np.random.default_rng(3).normal(0, 1, (40, 5)).round(2)
    v[5:9] = v[4]
    d = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(50, None), (51, [1.0])], "vec_id long, v array<double>")
    got = retrieval.dense(d, d.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), 3).toPandas()
    for q in (0, 10, 20, 30):
        best = sorted((-round(float(v[q] @ v[i]), 6), i) for i in range(40) if i != q)[:3]
        mine = got[got.query_id == q].assign(score=lambda x: x.score.round(6)).sort_values(["score", "vec_id"], ascending=[False, True]).head(3)
        assert [(-s, i) for s, i in zip(mine.score, mine.vec_id)] == best


def test_sizes_up_to_a_point(spark, monkeypatch):
    from palimpsest.queries import analysis

    monkeypatch.setattr(analysis, "BLOCK", 10)
    seen = [(i, i % 7) for i in range(95) if i % 3]
    got = analysis.sizes_upto(spark.createDataFrame(seen, "doc_id long, dl long"), spark.createDataFrame([(u,) for u in (4, 10, 33, 94, 200)], "upto long")).collect()
    assert {tuple(r) for r in got} == {(u, sum(i <= u for i, _ in seen), sum(n for i, n in seen if i <= u)) for u in (4, 10, 33, 94, 200)}


def test_contexts_say_when_facts_are_lost(spark, data):
    from palimpsest.queries import context

    names = {r.name: r.n for r in context.blocks(spark, "/root/testdata/sf0.01").groupBy("name").agg(F.count("*").alias("n")).collect()}
    assert {"system", "persona", "speech_rules", "known_facts", "relationship", "digest:lifetime", "digest:recent", "recent", "debt", "retrieved", "utterance"} <= set(names)
    lost = context.blocks(spark, data, facts_failed=True).where("name = 'known_facts'").select("text").distinct().collect()
    assert [r.text for r in lost] == [context.FAILED]


def test_percentiles_by_ranges(spark):
    from palimpsest.queries.context import place_percentiles

    values = [3, 3, 5000, 7, 2048, 2047, 9, 1_000_000, 2048, 1]
    got = place_percentiles(spark.createDataFrame([(v,) for v in values], "tokens long"), "tokens", (0, 50, 95)).first()
    v = sorted(values)
    assert (got.p0, got.p50, got.p95) == (v[0], v[5], v[9])


@pytest.mark.parametrize("variant,want", [("shipped", ["past", "short", "short", "contact", "none"]), ("content", ["short", "ritual", "short", "contact", "none"]), ("always", ["always"] * 5)])
def test_gate(spark, variant, want):
    said = ["기억나?", "응", "뭐 해", "나 이직 준비하고 면접 몇 번 봤더라", "오늘은 날씨가 참 좋네요"]
    d = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, s string")
    vocab = F.array(F.lit("면접"))
    got = [r[0] for r in d.orderBy("i").select(gate.decide(F.col("s"), vocab, variant, K)).collect()]
    assert got == want


def test_window_lengths(spark):
    t = spark.range(1, 720).select(F.lit("c").alias("chat"), F.col("id").alias("seq"), F.lit("user").alias("role"), F.lit("x").alias("text"))
    n = {r.now: r["count"] for r in memory.recent(t, DEFAULT).groupBy("now").count().collect()}
    assert n[700] == 9 and n[709] == 18


def test_guard_korean(spark):
    g = scoring.GUARD_KOREAN
    affection, polite, roster = g["affection"], g["polite"], g["roster"]
    cases = [
        ("자기야, 밥은 먹었어?", affection, True), ("사랑해. 그건 변함없어.", affection, True), ("네, 알겠습니다.", polite, True), ("엄마가 부르시네. 잠깐만.", roster, True),
        ("밥은 먹었냐.", affection, False), ("……그래서 괜찮은 거냐고.", affection, False), ("택시 타고 가라.", polite, False), ("우리 다시 만나서 진짜 좋다.", affection, True),
        ("너랑 나 사이가 어디 보통이냐.", affection, True), ("아직도 네 생각만 하고 있어. 매일.", affection, True), ("예전엔 자기야라고 불렀는데. 이제 아니지.", affection, False),
        ("사랑해 같은 말은 이제 안 할게.", affection, False), ("'알겠습니다' 이런 말투 진짜 싫어.", polite, False), ("친구라는 단어도 이제 애매하네.", roster, False),
    ]
    for excuse, want in ((None, (4, 4, 3, 3)), (g["excuse"], (4, 0, 3, 7))):
        got = []
        for s, forbid, truth in cases:
            hit = spark.createDataFrame([(s,)], "s string").select(scoring.violates(F.col("s"), forbid, excuse)).first()[0]
            got.append((hit, truth))
        assert (got.count((True, True)), got.count((True, False)), got.count((False, True)), got.count((False, False))) == want


def test_cache_golden(spark):
    r = {(x.layout, x.chunk, x.popular): x for x in cache.simulate(cache.layouts(spark)).collect()}
    k1, k3 = r["K1_memory_first", 1, False], r["K3_by_frequency", 10, False]
    assert round(k1.hit, 4) == 0.2409 and round(k1.input_cost, 2) == 24.38
    assert round(k3.hit, 2) == 0.79 and round(k3.input_cost, 2) == 9.12
    assert all(x.cached + x.uncached == 4150 * 2000 for x in r.values())


def test_long_horizon_golden(spark, data):
    from palimpsest.queries import QUERIES

    usd = {(r.sessions, r.policy[:2]): r.usd for r in QUERIES["summary_cost"](spark, data).collect()}
    assert [round(usd[24, p], 2) for p in ("P1", "P2", "P3", "P4")] == [1.43, 0.03, 0.13, 0.06]
    assert [round(usd[400, p], 2) for p in ("P1", "P3", "P4")] == [376.31, 20.35, 9.40]
    assert [int(r.contamination + 0.5) for r in QUERIES["contamination"](spark, data).orderBy("sessions").collect()] == [16, 65, 100, 100]


def test_bm25_counts_repeated_terms(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, "")], "doc_id long, text string")
    q = spark.createDataFrame([(0, "a", 2), (0, "c", 1)], "query_id long, term string, qtf long")
    import math

    index = retrieval.postings(docs, text.words(F.col("text")))
    got = {r.doc_id: r.score for r in retrieval.bm25(index, q, DEFAULT, docs=docs).collect()}
    idf = math.log(1 + (3 - 1 + 0.5) / 1.5)
    part = lambda tf, dl: idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (5 / 3)))
    assert got == pytest.approx({1: 2 * part(2, 3), 2: part(1, 2)})


def items_of(spark, rows):
    return spark.createDataFrame(rows, "chat long, item long, seq long, summary string, importance double, emotion double, surfaced int")


def test_retrieval_by_index_equals_the_full_comparison(spark, monkeypatch):
    import random

    rnd = random.Random(4)
    words = ["river", "garden", "melody", "thunder", "lantern", "x", "Ä", "kettle", "of", "running", "runs"]
    text = lambda: " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 6)))
    rows = [(c, s, s, rnd.choice([text(), text(), None]), rnd.choice([None, 0.1, 0.5, 0.9]), rnd.choice([None, 0.0, 0.8]), rnd.choice([None, 0, 1, 3])) for c in (1, 2, 3, None) for s in range(0, 60, 2)]
    asked = spark.createDataFrame([(c, s, text()) for c in (1, 2, 4, None) for s in range(1, 70, 3)] + [(1, 9, None), (2, 0, "river")], "chat long, now long, query string")
    want = sorted(map(str, memory.best(memory.judged(asked, items_of(spark, rows)), 5).collect()))
    for turns, items, pairs in ((4096, 20_000, 1 << 21), (16, 7, 50), (1, 1, 1)):
        monkeypatch.setattr(memory, "TURNS", turns)
        monkeypatch.setattr(memory, "ITEMS", items)
        monkeypatch.setattr(memory, "PAIRS", pairs)
        assert sorted(map(str, memory.retrieved(asked, items_of(spark, rows), 5).collect())) == want
    assert memory.retrieved(asked, items_of(spark, []), 5).count() == 0 and memory.retrieved(asked.limit(0), items_of(spark, rows), 5).count() == 0


def test_one_chat_of_fifty_thousand_turns(spark):
    """No pair of a turn and an item is a row of the plan: the chat is dealt over blocks, and the answers are those of a direct count."""
    n = 50_000
    words = ["river", "garden", "melody", "thunder", "lantern", "kettle", "orchard", "window"]
    turns = spark.range(n).select(F.lit(1).cast("long").alias("chat"), F.col("id").alias("seq"), F.concat_ws(" ", *(F.element_at(F.array(*map(F.lit, words)), (F.pmod(F.xxhash64("id", F.lit(i)), F.lit(8)) + 1).cast("int")) for i in range(2))).alias("text"))
    items = turns.where("seq % 2 = 0").select("chat", F.col("seq").alias("item"), "seq", F.col("text").alias("summary"), (F.col("seq") * 37 % 100 / 100.0).alias("importance"), F.lit(0.0).alias("emotion"), F.lit(0).alias("surfaced"))
    asked = turns.where("seq % 2 = 1").select("chat", F.col("seq").alias("now"), F.col("text").alias("query"))
    got = memory.retrieved(asked, items, 3)
    some = asked.where("now % 9973 = 1 OR now = 49999")
    want = memory.best(memory.judged(some, items), 3)
    found = got.join(some.select("chat", "now"), ["chat", "now"], "left_semi")
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect()))
    assert "CartesianProduct" not in got._jdf.queryExecution().executedPlan().toString()


def test_map_state_costs_the_same_for_keys_with_many_objects(spark, tmp_path):
    """The stream of statements equals the batch over several micro-batches, for a key with thousands of live objects, too."""
    from palimpsest.streaming import facts as stream_facts
    from palimpsest.streaming import keyed_state

    keyed_state(spark)
    start = dt.datetime(2026, 1, 1)
    rows = [(n, 1, "likes", f"o{n * 7919 % 6000}", 0.9 if n % 3 else 0.1, start + dt.timedelta(seconds=n)) for n in range(9000)] + [(20_000 + n, 2, "likes", f"o{n % 5}", 0.2 + n % 7 / 10, start + dt.timedelta(seconds=n)) for n in range(60)]
    schema = "id long, subject long, predicate string, object string, confidence double, ts timestamp"
    for part in range(3):
        some = [r for r in rows if r[0] % 20_000 * 3 // (9000 if r[1] == 1 else 60) == part]
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = stream_facts.actions(stream, DEFAULT).writeStream.format("memory").queryName("acted").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    want = facts.actions(spark.createDataFrame(rows, schema), DEFAULT).select("id", "subject", "predicate", "object", "action")
    got = spark.table("acted")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert [p["batchId"] for p in query.recentProgress if p["numInputRows"]] == [0, 1, 2]


def test_bucket_state_ends_with_the_stream(spark, tmp_path):
    """Timers drop every bucket's state once the watermark has passed; a late row is dropped and counted."""
    from palimpsest.streaming import dedup as stream_dedup

    schema, at = "chat long, seq long, summary string, at timestamp", lambda n: dt.datetime(2026, 1, 1) + dt.timedelta(seconds=n)
    batches = [[(1, s, f"the river garden {s % 3}", at(s)) for s in range(40)], [(None, None, None, at(10_000))], [(1, 5, "late river garden", at(5))], [(None, None, None, at(20_000))]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withWatermark("at", "10 seconds")
    query = stream_dedup.dedup(stream, DEFAULT).writeStream.format("memory").queryName("deduped").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    states = [(p["stateOperators"][0]["numRowsTotal"], p["stateOperators"][0]["numRowsDroppedByWatermark"]) for p in query.recentProgress if p["stateOperators"]]
    assert max(n for n, _ in states) == 2 and states[-1][0] == 0 and sum(late for _, late in states) == 1
    assert spark.table("deduped").count() == 40


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    from palimpsest.streaming import resume

    rows = [(i, f"t{i}") for i in range(50)]
    source = spark.createDataFrame(rows, "id long, text string")
    source.repartition(5).write.parquet(str(tmp_path / "in"))
    stream, path = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), str(tmp_path / "out")
    counts = lambda: {r.status: r["count"] for r in resume.status(spark, path, source, ["id"]).groupBy("status").count().collect()}
    assert counts() == {"pending": 50}

    def stop(number):
        if number == 2:
            raise RuntimeError("pulled the plug")

    with pytest.raises(Exception, match="pulled the plug"):
        resume.run(stream, path, stop)
    seen = resume.written(spark, path, source.schema)
    assert seen.select("batch").distinct().count() == 3 and resume.committed(spark, path).count() == 2  # the third batch is written but not done
    assert counts()["done"] == seen.where("batch < 2").count()
    resume.run(stream, path)
    assert counts() == {"done": 50} and sorted(map(tuple, resume.written(spark, path, source.schema).select("id", "text").collect())) == rows
    resume.run(stream, path)  # nothing is left to do
    assert resume.written(spark, path, source.schema).count() == 50


def test_session_names_and_times(spark):
    d = spark.createDataFrame([("S07", "3d"), ("S1", "S09"), ("S12", "S02"), ("S3", "session_start"), ("7", "0d"), (None, None), ("S03", " 0d "), ("S03", "d3"), ("S03", "soon")], "name string, spec string")
    n = text.session_number(F.col("name"))
    got = [tuple(r) for r in d.select(n, text.days(F.col("spec")), text.first_due(n, F.col("spec"))).collect()]
    assert got == [(7, 3, 10), (1, None, 9), (12, None, 13), (3, None, 4), (None, 0, None), (None, None, None), (3, 0, 4), (3, None, None), (3, None, None)]


def test_copies_are_deleted_and_digests_go_stale(spark):
    links = spark.createDataFrame([("doc", 1, "event", "e1"), ("doc", 1, "digest", "d"), ("doc", 2, "digest", "d"), ("doc", 3, "event", "e3")], "source_kind string, source_id long, derived_kind string, derived_key string")
    changed = spark.createDataFrame([("doc", 1), ("doc", 2)], "source_kind string, source_id long")
    got = {(r.derived_key, r.causes, r.action) for r in facts.invalidated(facts.stale_from(changed, links)).collect()}
    assert got == {("e1", 1, "deleted"), ("d", 2, "stale")}


def test_digest_chains(spark):
    """Depth by policy, drift along the incremental chain only, null and empty texts, a null owner, an empty table."""
    topics = [["harbour", "ship", "sail"], ["garden", "tulip", "spade"], ["oven", "bread", "flour"], ["violin", "concert", "stage"]]
    rows = [(1, s, 100 * s + i, " ".join(topics[s % 4] + [f"word{s}x{i}"])) for s in range(9) for i in range(4)]
    rows += [(1, 9, 900, None), (1, 10, 1000, ""), (2, 0, 5, "only turn here"), (None, 0, 1, "nobody said this"), (2, 0, 5, "only turn here")]
    t = spark.createDataFrame(rows, "owner long, session long, at long, text string")
    got = {(r.owner, r.session, r.policy): r for r in digests.chains(t, F.col("at") % 2 == 0, K).collect()}
    assert {s for o, s, _ in got if o == 1} == set(range(9))  # sessions without words are left aside
    assert [got[1, s, "P1_full_rewrite"].depth for s in range(9)] == [1] * 9 and [got[1, s, "P4_all_digests"].depth for s in range(9)] == [2] * 9
    assert [got[1, s, "P2_incremental"].depth for s in range(9)] == list(range(2, 11))
    assert [got[1, s, "P3_tiered"].depth for s in range(9)] == [2, 3, 4, 1, 2, 3, 4, 1, 2]
    assert all(got[1, s, p].items == 2 * (s + 1) for s in range(9) for p in digests.POLICIES)
    for s in range(9):
        whole = digests.extract([(100 * q + i, frozenset(x[3].split())) for q in range(s + 1) for i, x in enumerate(rows[4 * q : 4 * q + 4])], digests.LIFE)
        assert got[1, s, "P1_full_rewrite"].digest == ",".join(str(at) for at, _ in whole)
    assert got[2, 0, "P2_incremental"].digest == "5" and got[2, 0, "P1_full_rewrite"].items == 0 and got[None, 0, "P1_full_rewrite"].digest == "1"
    assert got[1, 8, "P2_incremental"].digest != got[1, 8, "P1_full_rewrite"].digest
    assert digests.chains(t.limit(0), F.lit(True), K).count() == 0


def test_the_search_of_many_chats_counts_few_pairs_at_once():
    """Counting shared terms takes memory by what is counted at once, not by the terms of all queries and items of a task."""
    import tracemalloc

    import pyarrow as pa
    from pyspark.sql import types as T

    r = np.random.default_rng(3)
    chats, turns, terms = 4, 400, [f"t{i}" for i in range(300)]
    some = lambda: [terms[i] for i in r.permutation(300)[:150]]
    at = [(c, s) for c in range(chats) for s in range(turns)]
    chat, seq = [c for c, _ in at], [s for _, s in at]
    queries = pa.table({"chat": chat, "now": seq, "q": [some() for _ in at]})
    items = pa.table({"chat": chat, "item": seq, "seq": seq, "summary": ["x"] * len(at), "weight": [0.5] * len(at), "surfaced": [0] * len(at), "d": [some() for _ in at]})
    kinds = {"chat": T.LongType(), "now": T.LongType(), "item": T.LongType(), "seq": T.LongType(), "summary": T.StringType(), "weight": T.DoubleType(), "surfaced": T.LongType(), "shared": T.LongType(), "asked": T.LongType()}
    schema = T.StructType([T.StructField(n, k) for n, k in kinds.items()])
    tracemalloc.start()
    found = memory._closest(5, schema, DEFAULT)(queries, items)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    q, d = {(c, s): set(x) for c, s, x in zip(chat, seq, queries.column("q").to_pylist())}, {(c, s): set(x) for c, s, x in zip(chat, seq, items.column("d").to_pylist())}
    assert all(row["shared"] == len(q[row["chat"], row["now"]] & d[row["chat"], row["item"]]) for row in found.to_pylist()) and len(found) >= chats * (turns - 5) * 5
    assert peak < 150e6


def test_settings_share_what_none_of_them_changes(spark, data, monkeypatch):
    """However many settings are compared, facts are folded once, and only the windows of the questions are put together."""
    from palimpsest.queries import context, evaluation

    folds, windows = [], []
    real_stored, real_recent = evaluation.stored, memory.recent
    for module in (context, evaluation):
        monkeypatch.setattr(module, "stored", lambda *a: folds.append(a) or real_stored(*a))
    monkeypatch.setattr(memory, "recent", lambda *a: windows.append(real_recent(*a)) or windows[-1])
    assert evaluation.ablation(spark, data).count() == 4
    assert len(folds) == 1 and len(windows) == 1
    assert windows[0].select("chat", "now").distinct().count() <= evaluation.questions(spark, data).count()


def test_texts_come_in_small_batches_to_the_search_for_passages(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, "10000")
    docs = spark.range(1500).select(F.col("id").alias("doc_id"), F.concat(F.lit("it says so "), F.col("id").cast("string")).alias("text"))
    found = retrieval.holding(docs, spark.createDataFrame([(1, "says so 7"), (2, "so 1499")], "query_id long, passage string"))
    assert found.groupBy("query_id").count().orderBy("query_id").collect() == [(1, 111), (2, 1)]
    assert int(spark.conf.get(name)) <= retrieval.TEXTS


def test_the_best_setting_looks_for_passages_once(spark, data, monkeypatch):
    from palimpsest.queries import analysis

    calls, real = [], analysis.gold
    monkeypatch.setattr(analysis, "gold", lambda *a: calls.append(a) or real(*a))
    assert analysis.pareto_pick(spark, data).count() == 1 and len(calls) == 1
