"""What reaches the context: evidence of questions, traps, and how gates, cuts and injected facts change it.

A chat's question is its last user turn. Its evidence are its live standing facts, one a predicate, and the weightiest of its stored items; each has a
set of accepted strings, and counts as reached if one of them stands in the rendered context.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import text as T
from ..operators import memory
from .base import Book, saved, table
from .context import ORACLES as CONTEXT
from .context import SHARED, asked, blocks, blocks_sql, carried, evidence_facts, facts_block, found_block, items, prefix_stability, turns
from .facts import stored

book = Book()
QUERIES, ORACLES = book.queries, book.oracles
C = DEFAULT
#: A fact of a predicate that does not stand, so nothing should bring it up.
TRAP = "view"


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = Window.partitionBy("chat").orderBy(F.desc("now"))
    return asked(spark, sf_dir).withColumn("n", F.row_number().over(last)).where("n = 1").drop("n")


def evidence(spark: SparkSession, sf_dir: str, known: DataFrame | None = None) -> DataFrame:
    """(chat, evidence, accepted): ids of evidence and the strings that stand for them."""
    line = evidence_facts(spark, sf_dir, C.pack.standing, known).withColumn("predicate", F.substring_index("line", ":", 1))
    facts = line.groupBy("chat", "predicate").agg(F.min("line").alias("line")).select("chat", F.concat(F.lit("fact:"), "predicate").alias("evidence"), F.array("line", F.concat(F.lit("the "), F.regexp_replace("line", ": ", " is "))).alias("accepted"))
    it = items(spark, sf_dir).join(questions(spark, sf_dir).select("chat", "now"), "chat").where("item < now")
    best = Window.partitionBy("chat").orderBy(F.desc(F.greatest("importance", "emotion")), "item")
    events = it.withColumn("n", F.row_number().over(best)).where("n = 1").select("chat", F.concat(F.lit("event:"), F.col("item").cast("string")).alias("evidence"), F.array("summary").alias("accepted"))
    return facts.unionByName(events)


def reach(spark: SparkSession, sf_dir: str, settings: dict[str, dict]) -> DataFrame:
    """(setting, chat, n_want, n_found, ok, via_facts, trapped, tokens) of every chat's question, in contexts that are put together as each setting tells.

    Facts, evidence and the blocks that no setting changes are made once, what is brought back once for each gate and cut."""
    u, known = saved(questions(spark, sf_dir), "questions"), saved(stored(spark, sf_dir), "facts")
    same = saved(memory.assembled(carried(spark, sf_dir, u)), "carried")
    trap = evidence_facts(spark, sf_dir, (TRAP,), known).groupBy("chat").agg(F.min("line").alias("trap"))
    wanted = saved(u.select("chat").join(trap, "chat", "left").join(evidence(spark, sf_dir, known), "chat", "left"), "wanted")
    found: dict[tuple, DataFrame] = {}
    every = None
    for name, how in settings.items():
        search = {k: how[k] for k in ("gate_variant", "cut") if k in how}
        key = tuple(search.items())
        if key not in found:
            found[key] = saved(memory.assembled([found_block(spark, sf_dir, u, **search)]), "found")
        b = same.unionByName(found[key])
        if how.get("inject", True):
            b = b.unionByName(memory.assembled([facts_block(spark, sf_dir, u, how.get("standing", C.pack.standing), known)]))
        whole = memory.rendered(b, F.max(F.when(F.col("name") == "known_facts", F.col("text"))).alias("facts")).select(F.lit(name).alias("setting"), "chat", "tokens", "context", "facts")
        every = whole if every is None else every.unionByName(whole)
    holds = lambda text: F.exists("accepted", lambda a: F.coalesce(F.col(text), F.lit("")).contains(a))
    per = every.join(wanted, "chat", "left").withColumn("found", F.coalesce(holds("context"), F.lit(False))).withColumn("in_facts", F.coalesce(holds("facts"), F.lit(False)))
    per = per.groupBy("setting", "chat", "tokens").agg(F.count("evidence").alias("n_want"), F.count_if("found").alias("n_found"), F.max("in_facts").alias("via_facts"), F.max(F.coalesce(F.col("context").contains(F.col("trap")), F.lit(False))).alias("trapped"))
    return per.withColumn("ok", (F.col("n_want") > 0) & (F.col("n_found") == F.col("n_want")))


QUESTIONS = "SELECT chat, max(seq) AS now, arg_max(text, seq) AS text FROM t WHERE role = 'user' GROUP BY 1"
LIVE = "SELECT subject AS chat, predicate, predicate || ': ' || object AS line FROM stored WHERE valid_until IS NULL"
EVIDENCE = f"""ln AS ({LIVE}), qu AS ({QUESTIONS}),
ev AS (SELECT chat, 'fact:' || predicate AS evidence, [min(line), 'the ' || replace(min(line), ': ', ' is ')] AS accepted FROM ln WHERE predicate IN ({', '.join(f"'{p}'" for p in C.pack.standing)}) GROUP BY chat, predicate
    UNION ALL SELECT chat, 'event:' || item, [summary] FROM it JOIN (SELECT chat, now FROM qu) USING (chat) WHERE item < now QUALIFY row_number() OVER (PARTITION BY chat ORDER BY weight DESC, item) = 1),
tr AS (SELECT chat, min(line) AS trap FROM ln WHERE predicate = '{TRAP}' GROUP BY 1)"""


def reach_sql(name: str, **how) -> str:
    return f"""{blocks_sql(f'{name}_b', QUESTIONS, **how)}, {name}_w AS (SELECT chat, sum(tokens)::BIGINT AS tokens, string_agg('[' || name || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY volatility, name) AS context, max(text) FILTER (WHERE name = 'known_facts') AS facts FROM {name}_b GROUP BY 1),
{name} AS (SELECT *, n_want > 0 AND n_found = n_want AS ok FROM (SELECT chat, tokens, count(evidence) AS n_want, count(*) FILTER (WHERE evidence IS NOT NULL AND len(list_filter(accepted, lambda a: contains(context, a))) > 0) AS n_found,
    bool_or(coalesce(len(list_filter(accepted, lambda a: contains(coalesce(facts, ''), a))) > 0, FALSE)) AS via_facts, bool_or(coalesce(contains(context, trap), FALSE)) AS trapped FROM {name}_w LEFT JOIN tr USING (chat) LEFT JOIN ev USING (chat) GROUP BY ALL))"""


@book.query(f"{SHARED}, {EVIDENCE}, {reach_sql('qa')} SELECT chat, n_want, n_found, ok, via_facts, tokens FROM qa")
def qa_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of a question's evidence its context holds, and whether through the injected facts."""
    return reach(spark, sf_dir, {"shipped": {}}).select("chat", "n_want", "n_found", "ok", "via_facts", "tokens")


@book.query(f"{SHARED}, {EVIDENCE}, {blocks_sql('bl', QUESTIONS, standing=None)} SELECT chat, name FROM bl JOIN tr USING (chat) WHERE contains(text, trap)")
def trap_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks that bring a trap fact up, with all facts injected."""
    trap = evidence_facts(spark, sf_dir, (TRAP,)).groupBy("chat").agg(F.min("line").alias("trap"))
    return blocks(spark, sf_dir, questions(spark, sf_dir), standing=None).join(trap, "chat").where(F.col("text").contains(F.col("trap"))).select("chat", "name")


#: From search alone to the shipped settings.
ABLATION = {
    "A": {"inject": False, "cut": 0.15, "gate_variant": "past_only"}, "B": {"standing": None, "cut": 0.15, "gate_variant": "past_only"}, "C": {"cut": 0.15, "gate_variant": "past_only"}, "D": {},
}
CELLS = {f"{variant}_{cut}": {"gate_variant": variant, "cut": cut} for variant in ("shipped", "always") for cut in (0.15, 0.05)}


def compared(spark: SparkSession, sf_dir: str, settings: dict[str, dict]) -> DataFrame:
    """One row a setting: questions with evidence, those whose evidence is all reached, those reached by search, contexts with the trap, and the middle number of tokens."""
    every = reach(spark, sf_dir, settings)
    return every.groupBy("setting").agg(F.count_if(F.col("n_want") > 0).alias("questions"), F.count_if("ok").alias("reached"), F.count_if(F.col("ok") & ~F.col("via_facts")).alias("by_search"), F.count_if("trapped").alias("traps"), F.median("tokens").alias("median_tokens"))


def compared_sql(settings: dict[str, dict]) -> str:
    one = "SELECT '{0}' AS setting, count(*) FILTER (WHERE n_want > 0) AS questions, count(*) FILTER (WHERE ok) AS reached, count(*) FILTER (WHERE ok AND NOT via_facts) AS by_search, count(*) FILTER (WHERE trapped) AS traps, median(tokens)::DOUBLE AS median_tokens FROM {1}"
    return f"{SHARED}, {EVIDENCE}, " + ", ".join(reach_sql(f"s{i}", **how) for i, how in enumerate(settings.values())) + " " + " UNION ALL ".join(one.format(name, f"s{i}") for i, name in enumerate(settings))


@book.query(compared_sql(ABLATION))
def ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search alone, all facts injected, standing facts injected, and the shipped gate and cut."""
    return compared(spark, sf_dir, ABLATION)


@book.query(compared_sql(CELLS))
def gate_cut_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate and the cut of relevance, each alone and both together."""
    return compared(spark, sf_dir, CELLS)


#: Blocks that hold memory; the recent turns and the utterance are the chat itself.
MEMORY = ("known_facts", "retrieved", "digest:lifetime", "digest:recent", "relationship")
COUNTED = {"standing": C.pack.standing, "all": None}


def event_counts_sql(name: str, standing) -> str:
    return f"""{blocks_sql(f'{name}_b', standing=standing)}, {name}_m AS (SELECT chat, now, string_agg(text, chr(10) ORDER BY volatility, name) FILTER (WHERE name IN {MEMORY}) AS mem, max(text) FILTER (WHERE name = 'known_facts') AS facts,
    coalesce(max((length(text) - length(replace(text, '[memory] ', ''))) // 9) FILTER (WHERE name = 'retrieved'), 0) AS picked, max(text) FILTER (WHERE name = 'retrieved') AS found FROM {name}_b GROUP BY ALL),
{name} AS (SELECT chat, now, facts, coalesce(contains(mem, trap), FALSE) AS trapped, coalesce(len(list_filter(old, lambda o: contains(mem, o))) > 0, FALSE) AS stale, picked - coalesce(contains(found, '[memory] ' || best), FALSE)::INT AS noise
    FROM {name}_m LEFT JOIN tr USING (chat) LEFT JOIN od USING (chat) LEFT JOIN be USING (chat))"""


@book.query(f"""{SHARED}, {EVIDENCE}, od AS (SELECT subject AS chat, list(DISTINCT predicate || ': ' || object) AS old FROM stored WHERE valid_until IS NOT NULL GROUP BY 1), be AS (SELECT chat, accepted[1] AS best FROM ev WHERE evidence LIKE 'event:%'),
{', '.join(event_counts_sql(f'c{i}', v) for i, v in enumerate(COUNTED.values()))}
{' UNION ALL '.join(f"SELECT '{n}' AS facts, count(*) AS turns, count(*) FILTER (WHERE trapped) AS traps, count(*) FILTER (WHERE stale) AS stale, sum(noise)::BIGINT AS noise, count(DISTINCT facts) AS variants FROM c{i}" for i, n in enumerate(COUNTED))}""")
def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns whose memory blocks bring up the trap or a superseded fact, retrieved items that are no evidence, and forms of the facts block."""
    lines = lambda f: f.select(F.col("subject").alias("chat"), F.concat_ws(": ", "predicate", "object").alias("line"))
    u, known = asked(spark, sf_dir), saved(stored(spark, sf_dir), "facts")
    old = lines(known.where("valid_until IS NOT NULL")).groupBy("chat").agg(F.collect_set("line").alias("old"))  # a chat's superseded facts
    trap = evidence_facts(spark, sf_dir, (TRAP,), known).groupBy("chat").agg(F.min("line").alias("trap"))
    best = evidence(spark, sf_dir, known).where("evidence LIKE 'event:%'").select("chat", F.concat(F.lit("[memory] "), F.col("accepted")[0]).alias("best"))
    same = saved(memory.assembled([*carried(spark, sf_dir, u), found_block(spark, sf_dir, u)]).where(F.col("name").isin(*MEMORY)), "blocks")  # facts change nothing here
    every = None
    for name, standing in COUNTED.items():
        b = same.unionByName(memory.assembled([facts_block(spark, sf_dir, u, standing, known)]))
        of = lambda n, b=b: F.max(F.when(F.col("name") == n, F.col("text")))
        in_order = F.sort_array(F.collect_list(F.when(F.col("name").isin(*MEMORY), F.struct("volatility", "name", "text"))))
        m = b.groupBy("chat", "now").agg(F.array_join(F.transform(in_order, lambda x: x["text"]), "\n").alias("mem"), of("known_facts").alias("known"), of("retrieved").alias("found"))
        m = m.join(trap, "chat", "left").join(old, "chat", "left").join(best, "chat", "left")
        holds = lambda c: F.coalesce(c, F.lit(False))
        noise = F.coalesce(F.size(F.split("found", r"\[memory\] ")) - 1, F.lit(0)) - holds(F.col("found").contains(F.col("best"))).cast("int")
        m = m.select(F.lit(name).alias("facts"), "known", holds(F.col("mem").contains(F.col("trap"))).alias("trapped"), holds(F.exists("old", lambda o: F.col("mem").contains(o))).alias("stale"), F.when(F.col("found").isNull(), 0).otherwise(noise).alias("noise"))
        every = m if every is None else every.unionByName(m)
    return every.groupBy("facts").agg(F.count("*").alias("turns"), F.count_if("trapped").alias("traps"), F.count_if("stale").alias("stale"), F.sum("noise").alias("noise"), F.count_distinct("known").alias("variants"))


MONTH = C.turns_per_month / 1e6


@book.query(f"WITH p AS ({CONTEXT['prefix_stability']}) SELECT count(*) AS turns, round((avg((tokens - stable_tokens) * {C.price_in} + stable_tokens * {C.price_cached}) + {C.output_tokens * C.price_out}) * {MONTH}, 4)::DOUBLE AS usd_month, round((avg(tokens * {C.price_in}) + {C.output_tokens * C.price_out}) * {MONTH}, 4)::DOUBLE AS usd_month_without_cache FROM p")
def context_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a month of turns costs, with the stable prefix of every context read from the cache and without."""
    p = prefix_stability(spark, sf_dir)
    cost = lambda per: F.round((F.avg(per) + C.output_tokens * C.price_out) * MONTH, 4)
    fresh = (F.col("tokens") - F.col("stable_tokens")) * C.price_in + F.col("stable_tokens") * C.price_cached
    return p.agg(F.count("*").alias("turns"), cost(fresh).alias("usd_month"), cost(F.col("tokens") * C.price_in).alias("usd_month_without_cache"))


# --- raw turns and places ---------------------------------------------------------------------------------------------------------

PAIRS = "list_distinct(CASE WHEN length({0}) < 2 THEN [{0}] ELSE list_transform(range(1, length({0})), lambda i: substr({0}, i, 2)) END)"


@book.query(f"""WITH t AS (SELECT conv_id AS chat, turn AS seq, role, text, {PAIRS.format("regexp_replace(text, chr(92) || 's+', '', 'g')")} AS b FROM conversations), qu AS (SELECT chat, max(seq) AS now FROM t WHERE role = 'user' GROUP BY 1),
s AS (SELECT q.chat, q.seq AS now, x.seq, round(len(list_intersect(q.b, x.b)) / greatest(1, len(q.b)), 6)::DOUBLE AS score FROM qu JOIN t q ON q.chat = qu.chat AND q.seq = qu.now JOIN t x ON x.chat = q.chat AND x.seq <> q.seq)
SELECT chat, now, row_number() OVER (PARTITION BY chat ORDER BY score DESC, seq) AS rank, seq, score FROM s QUALIFY rank <= 5""")
def raw_turn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the five turns of a chat that share most pairs of characters with its question; no gate, no cut, no weights."""
    t = turns(spark, sf_dir).select("chat", "seq", F.array_distinct(T.bigrams(F.col("text"))).alias("b"))
    q = questions(spark, sf_dir).select("chat", "now", F.array_distinct(T.bigrams(F.col("query"))).alias("q"))
    s = q.join(t, "chat").where("seq <> now").select("chat", "now", "seq", F.round(T.containment(F.col("q"), F.col("b")), 6).alias("score"))
    w = Window.partitionBy("chat").orderBy(F.desc("score"), "seq")
    return s.withColumn("rank", F.row_number().over(w)).where("rank <= 5").select("chat", "now", "rank", "seq", "score")


@book.query("""WITH n AS (SELECT conv_id, count(*) AS size FROM conversations GROUP BY 1), o AS (SELECT conv_id, coalesce(sum(size) OVER (ORDER BY conv_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n),
m AS (SELECT conv_id, turn, before + row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS seq FROM conversations JOIN o USING (conv_id)),
e AS (SELECT event_id, user_id AS session, event_id % 10 AS turn FROM events)
SELECT event_id, coalesce(seq, 0)::BIGINT AS seq FROM e LEFT JOIN m ON m.conv_id = e.session AND m.turn = e.turn""")
def turn_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session, turn) of every statement to its place among all turns; 0 where there is no such turn. Offsets are sums over sessions, places counted inside."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    sizes = t.groupBy("conv_id").agg(F.count("*").alias("size")).withColumn("block", F.floor(F.col("conv_id") / 10_000))
    before = lambda w: F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks_ = sizes.groupBy("block").agg(F.sum("size").alias("size")).select("block", before(Window.orderBy("block")).alias("base"))  # one row for 10 000 sessions
    offsets = sizes.join(blocks_, "block").select("conv_id", (F.col("base") + before(Window.partitionBy("block").orderBy("conv_id"))).alias("offset"))
    places = t.join(offsets, "conv_id").select(F.col("conv_id").alias("session"), "turn", (F.col("offset") + F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).alias("seq"))
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("session"), (F.col("event_id") % 10).alias("turn"))
    return e.join(places, ["session", "turn"], "left").select("event_id", F.coalesce("seq", F.lit(0)).cast("long").alias("seq"))
