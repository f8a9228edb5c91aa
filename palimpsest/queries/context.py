"""Gate, retrieval and context assembly over ``conversations``; facts of the user with the chat's number come from ``events``.

A chat's stored items are its assistant turns. Their importance, emotion and surfacing are fixed functions of length and turn.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..operators import facts as fact_ops
from ..operators import gate, memory
from . import costs
from .base import Book, saved, table
from .facts import STORED, stored
from .texts import LAST, SQL_PAIRS, SQL_RAW, stems_cte

book = Book()
QUERIES, ORACLES = book.queries, book.oracles
C = DEFAULT
P = C.pack
#: Tokens of a range in which percentiles are looked for.
WIDTH = 1024


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("chat"), F.col("turn").alias("seq"), "role", "text")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).where("role = 'user'").select("chat", F.col("seq").alias("now"), F.col("text").alias("query"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir).where("role = 'assistant'")
    return t.select("chat", F.col("seq").alias("item"), "seq", F.col("text").alias("summary"), (F.length("text") % 100 / 100.0).alias("importance"), (F.col("seq") * 37 % 100 / 100.0).alias("emotion"), (F.col("seq") % 3).alias("surfaced"))


T_CTE = "t AS (SELECT conv_id AS chat, turn AS seq, role, text FROM conversations)"
ITEMS = "it AS (SELECT chat, seq AS item, seq, text AS summary, greatest(length(text) % 100 / 100.0, seq * 37 % 100 / 100.0)::DOUBLE AS weight, seq % 3 AS surfaced FROM t WHERE role = 'assistant')"


def sql_starts(text: str) -> str:
    return f"list_distinct(list_transform(regexp_extract_all({text}, '{P.content_word}'), lambda w: substr(w, 1, 2)))"


VOCAB = f"voc AS (SELECT chat, list_distinct(flatten(list({sql_starts('summary')}))) AS vocab FROM it GROUP BY 1)"
PAST, SHORT, RITUAL = f"regexp_matches(text, '{P.past_reference}')", f"length(text) < {C.min_utterance}", f"regexp_matches(trim(text), '{P.ritual}')"
CONTACT = f"list_has_any({sql_starts('text')}, coalesce(vocab, []::VARCHAR[]))"
REASONS = {
    "past_only": f"CASE WHEN {PAST} THEN 'past' WHEN {SHORT} THEN 'short' WHEN {RITUAL} THEN 'ritual' ELSE 'none' END",
    "always": "'always'",
    "ritual_only": f"CASE WHEN {RITUAL} THEN 'ritual' WHEN {SHORT} THEN 'short' ELSE 'always' END",
    "content": f"CASE WHEN {RITUAL} THEN 'ritual' WHEN {SHORT} THEN 'short' WHEN {PAST} THEN 'past' WHEN {CONTACT} THEN 'contact' ELSE 'none' END",
    "shipped": f"CASE WHEN {PAST} THEN 'past' WHEN {SHORT} THEN 'short' WHEN {RITUAL} THEN 'ritual' WHEN {CONTACT} THEN 'contact' ELSE 'none' END",
}
GATED = f"{T_CTE}, {ITEMS}, {VOCAB}, gd AS (" + " UNION ALL ".join(f"SELECT '{v}' AS variant, chat, seq AS now, {e} AS reason FROM t LEFT JOIN voc USING (chat) WHERE role = 'user'" for v, e in REASONS.items()) + ")"


def gated(spark: SparkSession, sf_dir: str, variants: tuple[str, ...] = gate.VARIANTS, at: DataFrame | None = None) -> DataFrame:
    """(variant, chat, now, reason) of every utterance, or of those of ``at(chat, now)``."""
    u = asked(spark, sf_dir) if at is None else asked(spark, sf_dir).join(at, ["chat", "now"], "left_semi")
    both = u.join(gate.vocabulary(items(spark, sf_dir), C), "chat", "left")
    each = F.array(*(F.struct(F.lit(v).alias("variant"), gate.decide(F.col("query"), F.col("vocab"), v, C).alias("reason")) for v in variants))
    return both.select("chat", "now", F.explode(each).alias("g")).select("g.variant", "chat", "now", "g.reason")


@book.query(f"WITH {GATED} SELECT variant, chat, now, reason, reason IN ('past', 'contact', 'always') AS opened FROM gd")
def gate_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every variant of the gate on every utterance."""
    return gated(spark, sf_dir).withColumn("opened", gate.opens(F.col("reason")))


def sql_terms(source: str, text: str, keep: str, name: str) -> str:
    """CTE ``name``: ``keep`` and the list of distinct pairs over stems of ``text``."""
    cte = stems_cte(f"{name}_u", "word", f"{keep}, i").replace("st", f"{name}_st")
    last = LAST.replace("st", f"{name}_st")
    return (
        rf"{name}_u AS (SELECT {keep}, i, regexp_replace(r, '[^\p{{L}}\p{{N}}_]', '', 'g') AS word FROM (SELECT {keep}, unnest(w) AS r, unnest(range(len(w))) AS i FROM (SELECT {keep}, {SQL_RAW.format(text)} AS w FROM {source}))), {cte}, "
        f"{name}_j AS (SELECT {keep}, string_agg(w, '' ORDER BY i) AS s FROM {last} GROUP BY ALL), {name} AS (SELECT {keep}, list_distinct({SQL_PAIRS.format('s')}) AS terms FROM (SELECT {', '.join('a.' + k.strip() for k in keep.split(','))}, coalesce(s, '') AS s FROM {source} a LEFT JOIN {name}_j USING ({keep})))"
    )


JUDGED = f"""{GATED}, ut AS (SELECT chat, seq AS now, text FROM t WHERE role = 'user'), {sql_terms('ut', 'text', 'chat, now', 'qt')}, {sql_terms('it', 'summary', 'chat, item', 'dt')},
jd AS (SELECT chat, now, item, weight, round(len(list_intersect(qt.terms, dt.terms)) / greatest(1, len(qt.terms)), 6) AS relevance, surfaced, summary FROM qt JOIN dt USING (chat) JOIN it USING (chat, item) WHERE item < now),
judged AS (SELECT chat, now, item, summary, weight, relevance, round({C.relevance_weight}::DOUBLE * relevance + {C.importance_weight}::DOUBLE * weight - {C.surfaced_penalty}::DOUBLE * surfaced, 6) AS score,
    CASE WHEN weight < {C.importance_gate} THEN 'unimportant' WHEN relevance < {C.relevance_cut} THEN 'irrelevant' ELSE 'kept' END AS decision FROM jd),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chat, now ORDER BY score DESC, item) AS rank FROM judged WHERE decision = 'kept') WHERE rank <= {C.top_k})"""


@book.query(f"WITH {JUDGED} SELECT chat, now, rank, item, relevance, score FROM hits")
def retrieve_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """what every utterance would bring back."""
    return memory.retrieved(asked(spark, sf_dir), items(spark, sf_dir), C.top_k, C).select("chat", "now", "rank", "item", "relevance", "score")


@book.query(f"WITH {JUDGED} SELECT chat, now, item, decision FROM judged WHERE decision <> 'kept'")
def retrieve_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was passed over, and why."""
    return memory.judged(asked(spark, sf_dir), items(spark, sf_dir), C).where("decision <> 'kept'").select("chat", "now", "item", "decision")


ANCHOR = f"(a.seq // {C.window_chunk}) * {C.window_chunk} - {C.window_turns}"
RECENT = f"rc AS (SELECT a.chat, a.seq AS now, b.seq, b.role, b.text FROM t a JOIN t b ON a.chat = b.chat AND b.seq > {ANCHOR} AND b.seq < a.seq)"


@book.query(f"WITH {T_CTE}, {RECENT} SELECT chat, now, count(*) AS window_turns, sum(greatest(1, floor(length(text) * 1.5)))::BIGINT AS window_tokens FROM rc GROUP BY ALL")
def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns and tokens in the window of every turn that has one."""
    from ..functions import text as T

    r = memory.recent(turns(spark, sf_dir), C)
    return r.groupBy("chat", "now").agg(F.count("*").alias("window_turns"), F.sum(T.tokens(F.col("text"))).alias("window_tokens"))


# --- what a chat always carries: its character, its relationship, its digests, its debts -------------------------------------------

#: Versions of every character; a chat keeps the version that it began with.
VERSIONS = 2
#: A user's turns before its chat begins, on the clock by which debts fall due.
CLOCK = 40
#: Deleted turns: those whose chat and place give this remainder.
FORGOTTEN = "(chat * 7 + seq) % 5 = 0"
FAILED = "(memory could not be loaded; do not pretend to know, say that you don't)"


def characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4: (chat, persona, speech) of the version of the character that the chat is pinned to; a nation is a character."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    known = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("n_nationkey").alias("character"), F.explode(F.sequence(F.lit(1), F.lit(VERSIONS))).alias("version"), "n_name", "r_name")
    known = known.select("character", "version", F.concat(F.lit("You are "), "n_name", F.lit(".")).alias("persona"), F.concat(F.lit("Speak as they do in "), "r_name", F.lit(", manner "), F.col("version").cast("string"), F.lit(".")).alias("speech"))
    chats = turns(spark, sf_dir).select("chat").distinct().select("chat", (F.col("chat") % 25).cast("int").alias("character"), (F.col("chat") % VERSIONS + 1).cast("int").alias("version"))
    return chats.join(known, ["character", "version"]).select("chat", "persona", "speech")


def relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chat, line, note): the line is injected, the free note is not."""
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("chat")).agg(
        F.max_by("event_type", F.struct("ts", "event_id")).alias("stage"), (F.count_if(F.col("event_type") == "purchase") - F.count_if(F.col("event_type") == "error")).alias("affinity"), F.max_by("props", F.struct("ts", "event_id")).alias("note")
    )
    return e.select("chat", F.concat(F.lit("stage="), "stage", F.lit(" affinity="), F.col("affinity").cast("string"), F.lit(" called_as="), F.when(F.col("affinity") > 0, "friend").otherwise("you")).alias("line"), "note")


def digests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Digests (chat, kind, text) and what is stale of them (derived_kind, derived_key): a digest of deleted turns waits until it is made anew."""
    t = turns(spark, sf_dir).where("role = 'assistant'")
    last = Window.partitionBy("chat").orderBy(F.desc("seq"))
    parts = t.where("seq <= 3").select("chat", F.lit("lifetime").alias("kind"), "seq", "text").unionByName(t.withColumn("n", F.row_number().over(last)).where("n = 1").select("chat", F.lit("recent").alias("kind"), "seq", "text"))
    made = parts.groupBy("chat", "kind").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", F.substring("text", 1, 40).alias("x")))), lambda x: x["x"]), " / ").alias("text"))
    source = F.concat_ws(":", F.col("chat").cast("string"), F.col("seq").cast("string")).alias("source_id")
    links = parts.select(F.lit("turn").alias("source_kind"), source, F.lit("digest").alias("derived_kind"), F.concat_ws(":", F.col("chat").cast("string"), "kind").alias("derived_key"))
    gone = fact_ops.stale_from(turns(spark, sf_dir).where(FORGOTTEN).select(F.lit("turn").alias("source_kind"), source), links)
    keyed = made.withColumn("derived_kind", F.lit("digest")).withColumn("derived_key", F.concat_ws(":", F.col("chat").cast("string"), "kind"))
    return keyed, gone


def due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chat, now, setup) of the debts that are raised at a turn of the chat."""
    d = costs.debts(spark, sf_dir).select(F.col("user_id").alias("chat"), "setup", F.explode(F.array("a1", "a2", "a3")).alias("at"))
    return d.where("at IS NOT NULL").select("chat", (F.col("at") - CLOCK).alias("now"), "setup")


CARRIED = f"""ch AS (SELECT DISTINCT chat FROM t), pe AS (SELECT chat, 'You are ' || n_name || '.' AS persona, 'Speak as they do in ' || r_name || ', manner ' || (chat % {VERSIONS} + 1) || '.' AS speech
    FROM ch JOIN nation ON n_nationkey = chat % 25 JOIN region ON r_regionkey = n_regionkey),
re AS (SELECT user_id AS chat, arg_max(event_type, (ts, event_id)) AS stage, count(*) FILTER (WHERE event_type = 'purchase') - count(*) FILTER (WHERE event_type = 'error') AS affinity, arg_max(props, (ts, event_id)) AS note FROM events GROUP BY 1),
dp AS (SELECT chat, 'lifetime' AS kind, seq, text FROM t WHERE role = 'assistant' AND seq <= 3 UNION ALL SELECT chat, 'recent', max(seq), arg_max(text, seq) FROM t WHERE role = 'assistant' GROUP BY 1),
dg AS (SELECT chat, kind, string_agg(substr(text, 1, 40), ' / ' ORDER BY seq) AS text, bool_or({FORGOTTEN}) AS stale FROM dp GROUP BY ALL),
du AS (SELECT user_id AS chat, due_at - {CLOCK} AS now, setup FROM (SELECT user_id, setup, unnest([a1, a2, a3]) AS due_at FROM ({costs.FOLDED} SELECT * FROM s3)) WHERE due_at IS NOT NULL)"""


def evidence_facts(spark: SparkSession, sf_dir: str, standing: tuple[str, ...] | None, known: DataFrame | None = None) -> DataFrame:
    """(chat, line) of live facts; of the standing predicates, or of all. ``known`` are all stored facts, if they have been made before."""
    live = fact_ops.current(stored(spark, sf_dir, standing) if known is None else known, standing)
    return live.select(F.col("subject").alias("chat"), F.concat_ws(": ", "predicate", "object").alias("line"))


def carried(spark: SparkSession, sf_dir: str, u: DataFrame) -> list[DataFrame]:
    """The blocks of ``u(chat, now, query)`` that no setting changes."""
    t, b, now = turns(spark, sf_dir), memory.block, u.select("chat", "now")
    state = t.where("role = 'system'").groupBy("chat").agg(F.max(F.struct("seq", "text"))["text"].alias("text"))
    character, (digest, gone) = characters(spark, sf_dir), digests(spark, sf_dir)
    fresh = fact_ops.without_stale(digest, gone)
    r = memory.lines(memory.recent(t, C, now), F.col("seq"), F.concat_ws(": ", "role", "text"))
    owed = memory.lines(due(spark, sf_dir).join(now, ["chat", "now"], "left_semi"), F.col("setup"), F.concat(F.lit("- owed since turn "), F.col("setup").cast("string")))
    return [
        now.select(*b("system", 0, "global", F.lit("Play the character. Do not leave the setting."))),
        now.join(character, "chat").select(*b("persona", 1, "character", F.col("persona"))),
        now.join(character, "chat").select(*b("speech_rules", 1, "character", F.col("speech"))),
        now.join(relationships(spark, sf_dir), "chat", "left").select(*b("relationship", 3, "chat", F.coalesce("line", F.lit("stage=none affinity=0 called_as=you")))),
        now.join(fresh.where("kind = 'lifetime'"), "chat").select(*b("digest:lifetime", 4, "chat", F.col("text"))),
        now.join(fresh.where("kind = 'recent'"), "chat").select(*b("digest:recent", 5, "chat", F.col("text"))),
        now.join(state, "chat").select(*b("scene", 7, "chat", F.col("text"))),
        r.select(*b("recent", 8, "chat", F.col("text"))),
        owed.select(*b("debt", 8.5, "chat", F.col("text"))),
        u.select(*b("utterance", 10, "chat", F.col("query"))),
    ]


def facts_block(spark: SparkSession, sf_dir: str, u: DataFrame, standing: tuple[str, ...] | None = P.standing, known: DataFrame | None = None) -> DataFrame:
    few = turns(spark, sf_dir).groupBy("chat").agg((F.count("*") <= C.window_turns).alias("first_chat"))
    told = evidence_facts(spark, sf_dir, standing, known).groupBy("chat").agg(F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("known"))
    text = F.coalesce("known", F.when(F.col("first_chat"), "(none yet)\nThis is the first conversation.").otherwise("(none yet)"))
    return u.select("chat", "now").join(told, "chat", "left").join(few, "chat").select(*memory.block("known_facts", 2.5, "chat", text))


def found_block(spark: SparkSession, sf_dir: str, u: DataFrame, gate_variant: str = "shipped", cut: float = C.relevance_cut) -> DataFrame:
    """What the gate lets the utterances bring back."""
    reason = gated(spark, sf_dir, (gate_variant,), u.select("chat", "now")).where(gate.opens(F.col("reason"))).select("chat", "now")
    hits = memory.retrieved(u.join(reason, ["chat", "now"], "left_semi"), items(spark, sf_dir), C.top_k, replace(C, relevance_cut=cut))
    return memory.lines(hits, F.col("rank"), F.concat(F.lit("[memory] "), F.col("summary"))).select(*memory.block("retrieved", 9, "chat", F.col("text")))


def blocks(spark: SparkSession, sf_dir: str, u: DataFrame | None = None, gate_variant: str = "shipped", cut: float = C.relevance_cut, standing: tuple[str, ...] | None = P.standing, inject: bool = True, facts_failed: bool = False) -> DataFrame:
    """One row for every block of the context of every user turn, or of those in ``u(chat, now, query)``.

    ``inject`` tells whether facts are injected, ``standing`` which (None: all), ``facts_failed`` that they could not be read, which the context
    then says. The gate's variant and the cut of relevance decide what is retrieved."""
    u = asked(spark, sf_dir) if u is None else u
    facts = u.select(*memory.block("known_facts", 2.5, "chat", F.lit(FAILED))) if facts_failed else facts_block(spark, sf_dir, u, standing)
    return memory.assembled([*carried(spark, sf_dir, u), *([facts] if inject else []), found_block(spark, sf_dir, u, gate_variant, cut)])


def blocks_sql(name: str = "blocks", only: str = "SELECT chat, now, text FROM ut", gate_variant: str = "shipped", cut: float = C.relevance_cut, standing: tuple[str, ...] | None = P.standing, inject: bool = True) -> str:
    """CTE ``name``, after those of SHARED, for the turns that ``only`` gives."""
    predicates = f"AND predicate IN ({', '.join(f"'{p}'" for p in standing)})" if standing else ""
    kept = f"weight >= {C.importance_gate} AND relevance >= {cut}"
    facts = f"UNION ALL SELECT chat, now, 'known_facts', 2.5, 'chat', coalesce(known, CASE WHEN first_chat THEN '(none yet)' || chr(10) || 'This is the first conversation.' ELSE '(none yet)' END) FROM {name}_u LEFT JOIN {name}_k USING (chat) JOIN fw USING (chat)"
    return f"""{name}_u AS ({only}), {name}_k AS (SELECT subject AS chat, string_agg(predicate || ': ' || object, chr(10) ORDER BY predicate || ': ' || object) AS known FROM stored WHERE valid_until IS NULL {predicates} GROUP BY 1),
{name}_h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chat, now ORDER BY score DESC, item) AS rank FROM judged WHERE {kept}) WHERE rank <= {C.top_k}),
{name} AS (SELECT *, greatest(1, floor(length(text) * 1.5))::BIGINT AS tokens FROM (
    SELECT chat, now, 'system' AS name, 0.0::DOUBLE AS volatility, 'global' AS scope, 'Play the character. Do not leave the setting.' AS text FROM {name}_u
    UNION ALL SELECT chat, now, 'persona', 1, 'character', persona FROM {name}_u JOIN pe USING (chat) UNION ALL SELECT chat, now, 'speech_rules', 1, 'character', speech FROM {name}_u JOIN pe USING (chat)
    {facts if inject else ''}
    UNION ALL SELECT chat, now, 'relationship', 3, 'chat', coalesce('stage=' || stage || ' affinity=' || affinity || ' called_as=' || CASE WHEN affinity > 0 THEN 'friend' ELSE 'you' END, 'stage=none affinity=0 called_as=you') FROM {name}_u LEFT JOIN re USING (chat)
    UNION ALL SELECT chat, now, 'digest:' || kind, CASE WHEN kind = 'lifetime' THEN 4 ELSE 5 END, 'chat', dg.text FROM {name}_u JOIN dg USING (chat) WHERE NOT stale
    UNION ALL SELECT chat, now, 'scene', 7, 'chat', sy.text FROM {name}_u JOIN sy USING (chat)
    UNION ALL SELECT chat, now, 'recent', 8, 'chat', string_agg(role || ': ' || rc.text, chr(10) ORDER BY seq) FROM rc JOIN {name}_u USING (chat, now) GROUP BY chat, now
    UNION ALL SELECT chat, now, 'debt', 8.5, 'chat', string_agg('- owed since turn ' || setup, chr(10) ORDER BY setup) FROM du JOIN {name}_u USING (chat, now) GROUP BY chat, now
    UNION ALL SELECT chat, now, 'retrieved', 9, 'chat', string_agg('[memory] ' || summary, chr(10) ORDER BY rank) FROM {name}_h JOIN gd USING (chat, now) JOIN {name}_u USING (chat, now) WHERE variant = '{gate_variant}' AND reason IN ('past', 'contact', 'always') GROUP BY chat, now
    UNION ALL SELECT chat, now, 'utterance', 10, 'chat', text FROM {name}_u))"""


SHARED = f"""{STORED}, {JUDGED}, {RECENT}, {CARRIED}, nw AS (SELECT chat, now FROM ut), fw AS (SELECT chat, count(*) <= {C.window_turns} AS first_chat FROM t GROUP BY 1),
sy AS (SELECT chat, arg_max(text, seq) AS text FROM t WHERE role = 'system' GROUP BY 1)"""
BLOCKS = f"{SHARED}, {blocks_sql()}"


@book.query(f"{SHARED} SELECT chat, 'excluded' AS kind, 'stage_note: ' || note AS what FROM re JOIN ch USING (chat) WHERE note IS NOT NULL UNION ALL SELECT chat, 'stale', 'digest:' || kind FROM dg WHERE stale")
def context_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a chat has but its contexts leave out: the free note on the relationship, and digests of deleted turns."""
    digest, gone = digests(spark, sf_dir)
    chats = turns(spark, sf_dir).select("chat").distinct()
    notes = relationships(spark, sf_dir).join(chats, "chat", "left_semi").where("note IS NOT NULL").select("chat", F.lit("excluded").alias("kind"), F.concat(F.lit("stage_note: "), "note").alias("what"))
    return notes.unionByName(digest.join(gone, ["derived_kind", "derived_key"], "left_semi").select("chat", F.lit("stale").alias("kind"), F.concat(F.lit("digest:"), "kind").alias("what")))


@book.query(f"{BLOCKS} SELECT chat, now, name, volatility, scope, tokens FROM blocks")
def context_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S2, §2.10: the blocks of every context."""
    return blocks(spark, sf_dir).select("chat", "now", "name", "volatility", "scope", "tokens")


@book.query(f"{BLOCKS} SELECT chat, now, count(*) AS n_blocks, sum(tokens)::BIGINT AS tokens, string_agg('[' || name || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY volatility, name) AS context FROM blocks GROUP BY ALL")
def context_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: the whole context of every user turn."""
    return memory.rendered(blocks(spark, sf_dir))


@book.query(f"""{BLOCKS}, pv AS (SELECT chat, now, lag(now) OVER (PARTITION BY chat ORDER BY now) AS before FROM nw),
sm AS (SELECT p.chat, p.now, a.volatility, a.tokens, b.text IS NOT DISTINCT FROM a.text AS same FROM pv p JOIN blocks a ON a.chat = p.chat AND a.now = p.now LEFT JOIN blocks b ON b.chat = p.chat AND b.now = p.before AND b.name = a.name WHERE p.before IS NOT NULL),
fb AS (SELECT chat, now, min(volatility) FILTER (WHERE NOT same) AS broken FROM sm GROUP BY ALL)
SELECT chat, now, sum(tokens)::BIGINT AS tokens, coalesce(sum(tokens) FILTER (WHERE volatility < coalesce(broken, 99)), 0)::BIGINT AS stable_tokens FROM sm JOIN fb USING (chat, now) GROUP BY ALL""")
def prefix_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of the leading blocks that did not change since the user's last turn."""
    b = saved(blocks(spark, sf_dir), "blocks")
    w = Window.partitionBy("chat").orderBy("now")
    before = asked(spark, sf_dir).select("chat", "now").withColumn("before", F.lag("now").over(w)).where("before IS NOT NULL")
    old = b.select("chat", F.col("now").alias("before"), "name", F.col("text").alias("old"))
    same = b.join(before, ["chat", "now"]).join(old, ["chat", "before", "name"], "left").withColumn("same", F.coalesce(F.col("text") == F.col("old"), F.lit(False)))
    broken = F.min(F.when(~F.col("same"), F.col("volatility"))).over(Window.partitionBy("chat", "now"))
    kept = F.sum(F.when(F.col("volatility") < F.coalesce("broken", F.lit(99.0)), F.col("tokens")).otherwise(0))
    return same.withColumn("broken", broken).groupBy("chat", "now").agg(F.sum("tokens").alias("tokens"), kept.alias("stable_tokens"))


@book.query(f"WITH {GATED} SELECT variant, count(*) AS turns, count(*) FILTER (WHERE reason IN ('past', 'contact', 'always')) AS calls, count(*) FILTER (WHERE reason = 'short') AS short, count(*) FILTER (WHERE reason = 'ritual') AS ritual FROM gd GROUP BY 1")
def gate_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often every variant calls the memory."""
    g = gated(spark, sf_dir)
    return g.groupBy("variant").agg(F.count("*").alias("turns"), F.count_if(gate.opens(F.col("reason"))).alias("calls"), F.count_if(F.col("reason") == "short").alias("short"), F.count_if(F.col("reason") == "ritual").alias("ritual"))


@book.query(f"""{BLOCKS}, tk AS (SELECT chat, now, sum(tokens)::BIGINT AS tokens FROM blocks GROUP BY ALL), ls AS (SELECT list_sort(list(tokens)) AS v FROM tk)
SELECT (SELECT count(*) FROM tk) AS contexts, v[least(len(v) - 1, len(v) * 50 // 100) + 1] AS p50, v[least(len(v) - 1, len(v) * 95 // 100) + 1] AS p95, (SELECT median(tokens) FROM tk) AS median,
(SELECT count(DISTINCT text) FROM blocks WHERE name = 'known_facts') AS fact_shapes, (SELECT count(*) FROM blocks WHERE name = 'retrieved') AS with_memory FROM ls""")
def replay_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token percentiles over all contexts, shapes of the facts block, contexts with memory."""
    b = blocks(spark, sf_dir)
    per = b.groupBy("chat", "now").agg(F.sum("tokens").alias("tokens"), F.max(F.when(F.col("name") == "known_facts", F.col("text"))).alias("facts"), F.max((F.col("name") == "retrieved").cast("int")).alias("memory"))
    per = saved(per, "contexts")
    n = per.agg(F.count("*").alias("contexts"), F.median("tokens").alias("median"), F.count_distinct("facts").alias("fact_shapes"), F.sum("memory").alias("with_memory"))
    return n.join(place_percentiles(per, "tokens", (50, 95)))  # one row each


def place_percentiles(rows: DataFrame, value: str, points: tuple[int, ...]) -> DataFrame:
    """One row with p<point> columns: the value at place n * p / 100 of the sorted values, which are numbers of tokens.

    Counts by ranges of WIDTH tokens tell which range holds a place (one row a range meets in one task), and only its values are counted one by one."""
    counts = saved(rows.groupBy(F.floor(F.col(value) / WIDTH).alias("range"), value).agg(F.count("*").alias("c")), "counts")
    ranges = counts.groupBy("range").agg(F.sum("c").alias("c")).withColumn("after", F.sum("c").over(Window.orderBy("range"))).withColumn("n", F.sum("c").over(Window.partitionBy(F.lit(0))))
    place = lambda p: F.least(F.col("n") - 1, F.floor(F.col("n") * p / 100))
    each = F.explode(F.array(*(F.struct(F.lit(p).alias("p"), place(p).alias("place")) for p in points)))
    held = ranges.select("range", "c", "after", each.alias("x")).select("range", (F.col("after") - F.col("c")).alias("before"), "after", "x.p", "x.place").where("place >= before AND place < after")
    upto = counts.join(held, "range").withColumn("upto", F.col("before") + F.sum("c").over(Window.partitionBy("p").orderBy(value)))
    return upto.agg(*(F.min(F.when((F.col("p") == p) & (F.col("upto") > F.col("place")), F.col(value))).alias(f"p{p}") for p in points))


RULES = "Use only what is written above. Where it says nothing, say that you don't know."
#: The parts of every arm's prompt, before the utterance; each is a column or a text, and one that is missing is left out.
PROMPTS = {
    "oracle": ("persona", "known", "rules"), "proposed": ("context", "rules"), "current": ("persona", "summary", "found", "lately", "rules"),
    "window": ("persona", "lately", "rules"), "no_memory": ("persona",), "rules_only": ("persona", "rules"),
}
#: Search as it was before there were gates: by relevance alone.
BY_RELEVANCE = replace(C, importance_gate=0.0, relevance_cut=1e-6, relevance_weight=1.0, importance_weight=0.0, surfaced_penalty=0.0)
OF_BLOCK = {"persona": ("persona", ""), "known": ("known_facts", "[known]\n"), "summary": ("digest:lifetime", "[summary]\n"), "lately": ("recent", "[recent]\n"), "said": ("utterance", "user: ")}
SQL_NL = "' || chr(10) || '"


@book.query(f"""{BLOCKS}, hr AS (SELECT chat, now, '[found]' || chr(10) || string_agg('- ' || summary, chr(10) ORDER BY rank) AS found FROM (SELECT *, row_number() OVER (PARTITION BY chat, now ORDER BY relevance DESC, item) AS rank FROM judged WHERE relevance >= 0.000001) WHERE rank <= {C.top_k} GROUP BY chat, now),
pt AS (SELECT chat, now, string_agg('[' || name || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY volatility, name) AS context, '{RULES.replace("'", "''")}' AS rules, {', '.join(f"'{mark.replace(chr(10), SQL_NL)}' || max(text) FILTER (WHERE name = '{block}') AS {part}" for part, (block, mark) in OF_BLOCK.items())} FROM blocks GROUP BY chat, now),
pm AS ({' UNION ALL '.join(f"SELECT chat, now, '{arm}' AS arm, concat_ws(chr(10), {', '.join(parts)}, said, 'assistant:') AS prompt FROM pt LEFT JOIN hr USING (chat, now)" for arm, parts in PROMPTS.items())})
SELECT *, greatest(1, floor(length(prompt) * 1.5))::BIGINT AS tokens FROM pm""")
def prompt_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H8: the prompt of every user turn in six arms, which differ in what is remembered only; the parts are those of the context, built once."""
    from ..functions import text as T

    u = asked(spark, sf_dir)
    b = saved(blocks(spark, sf_dir), "blocks")
    parts = [F.concat(F.lit(mark), F.max(F.when(F.col("name") == block, F.col("text")))).alias(part) for part, (block, mark) in OF_BLOCK.items()]
    hits = memory.lines(memory.retrieved(u, items(spark, sf_dir), C.top_k, BY_RELEVANCE), F.col("rank"), F.concat(F.lit("- "), "summary")).select("chat", "now", F.concat(F.lit("[found]\n"), "text").alias("found"))
    p = b.groupBy("chat", "now").agg(*parts).join(memory.rendered(b).select("chat", "now", "context"), ["chat", "now"]).join(hits, ["chat", "now"], "left").withColumn("rules", F.lit(RULES))
    each = F.array(*(F.struct(F.lit(arm).alias("arm"), F.concat_ws("\n", *names, "said", F.lit("assistant:")).alias("prompt")) for arm, names in PROMPTS.items()))
    return p.select("chat", "now", F.explode(each).alias("x")).select("chat", "now", "x.arm", "x.prompt").withColumn("tokens", T.tokens(F.col("prompt")))
