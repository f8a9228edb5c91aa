"""Episodes, interpretations, guards, scorers and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import scoring as S
from ..functions import text as T
from ..operators import digests, episodes
from ..operators import retrieval as ops
from . import context
from .analysis import ARMS, arms
from .base import Book, table
from .context import items, turns
from .retrieval import BM25, best, gold, indexed
from .texts import LAST, SQL_RAW, SQL_ROOTS, stems_cte

book = Book()
QUERIES, ORACLES = book.queries, book.oracles
C = DEFAULT


@book.query(f"""WITH RECURSIVE {SQL_ROOTS}, ev AS (SELECT conv_id AS chat, turn AS seq, turn // {C.dedup_window} AS bucket, coalesce(r, []::VARCHAR[]) AS r, row_number() OVER (PARTITION BY conv_id, turn // {C.dedup_window} ORDER BY turn, text) AS rn
    FROM conversations LEFT JOIN (SELECT conv_id, turn, list(root) AS r FROM roots GROUP BY 1, 2) USING (conv_id, turn) WHERE role <> 'system'),
near AS (SELECT a.chat, a.bucket, a.rn, coalesce(list(b.rn ORDER BY b.rn) FILTER (WHERE len(list_intersect(a.r, b.r)) / greatest(1, len(list_distinct(list_concat(a.r, b.r)))) >= {C.dedup_jaccard}), []::BIGINT[]) AS js
    FROM ev a LEFT JOIN ev b ON a.chat = b.chat AND a.bucket = b.bucket AND b.rn < a.rn GROUP BY ALL),
f AS (SELECT chat, bucket, rn, [rn] AS kept, rn AS j FROM near WHERE rn = 1
    UNION ALL SELECT n.chat, n.bucket, n.rn, CASE WHEN len(list_intersect(n.js, f.kept)) = 0 THEN list_append(f.kept, n.rn) ELSE f.kept END, coalesce(list_min(list_intersect(n.js, f.kept)), n.rn)
    FROM f JOIN near n ON n.chat = f.chat AND n.bucket = f.bucket AND n.rn = f.rn + 1)
SELECT f.chat, a.seq, CASE WHEN f.rn = f.j THEN 'created' ELSE 'merged' END AS action, b.seq AS into FROM f JOIN ev a ON a.chat = f.chat AND a.bucket = f.bucket AND a.rn = f.rn JOIN ev b ON b.chat = f.chat AND b.bucket = f.bucket AND b.rn = f.j""".replace("AS into", 'AS "into"'))
def event_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a chat that repeat an earlier one of the same bucket."""
    t = turns(spark, sf_dir).where("role <> 'system'").select("chat", "seq", F.col("text").alias("summary"), F.lit(0.5).alias("weight"))
    return episodes.dedup(t, C)


#: How alike observations of a cluster are, and what an earlier pick costs.
ALIKE, PENALTIES = (0.2, 0.3, 0.45), (0.0, 0.05, 0.1, 0.2, 0.3, 0.5)


@book.query(f"""WITH RECURSIVE {context.T_CTE}, {context.sql_terms('t', 'text', 'chat, seq', 'ot')},
o AS (SELECT chat, terms, row_number() OVER (PARTITION BY chat ORDER BY seq) AS rn FROM ot), th AS (SELECT unnest([{', '.join(map(str, ALIKE))}]::DOUBLE[]) AS threshold),
nb AS (SELECT a.chat, a.rn, b.rn AS j, len(list_intersect(a.terms, b.terms)) / len(list_distinct(list_concat(a.terms, b.terms))) AS share FROM o a JOIN o b ON a.chat = b.chat AND b.rn < a.rn),
bs AS (SELECT * FROM nb WHERE share > 0 QUALIFY share = max(share) OVER (PARTITION BY chat, rn)),
js AS (SELECT threshold, o.chat, o.rn, coalesce(list(j) FILTER (WHERE share >= threshold), []::BIGINT[]) AS js FROM o CROSS JOIN th LEFT JOIN bs ON bs.chat = o.chat AND bs.rn = o.rn GROUP BY ALL),
f AS (SELECT threshold, chat, rn, [rn] AS fs FROM js WHERE rn = 1
    UNION ALL SELECT j.threshold, j.chat, j.rn, list_append(f.fs, coalesce(list_min(list_transform(j.js, lambda x: f.fs[x])), j.rn)) FROM f JOIN js j ON j.threshold = f.threshold AND j.chat = f.chat AND j.rn = f.rn + 1),
e AS (SELECT threshold, chat, unnest(fs) AS founder FROM (SELECT * FROM f QUALIFY rn = max(rn) OVER (PARTITION BY threshold, chat)))
SELECT threshold, chat, count(*) AS clusters, max(n) AS largest FROM (SELECT threshold, chat, founder, count(*) AS n FROM e GROUP BY ALL) GROUP BY ALL""")
def observation_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy clusters of a chat's turns at three thresholds; a turn goes where its closest earlier turn went."""
    t = turns(spark, sf_dir).select("chat", "seq", "text")
    return episodes.observations(t, ALIKE, C)


@book.query(f"""WITH RECURSIVE {context.JUDGED.replace('surfaced, summary FROM qt', '0 AS surfaced, summary FROM qt')},
sc AS (SELECT chat, row_number() OVER (PARTITION BY chat ORDER BY now) AS k, c FROM (SELECT chat, now, list(struct_pack(i := item, m := floor(({C.relevance_weight}::DOUBLE * relevance + {C.importance_weight}::DOUBLE * weight) * 1000000 + 0.5)::BIGINT)) AS c FROM jd GROUP BY ALL)),
pn AS (SELECT unnest([{', '.join(map(str, PENALTIES))}]::DOUBLE[]) AS penalty),
f AS (SELECT penalty, chat, 0::BIGINT AS k, []::BIGINT[][] AS log FROM pn, (SELECT DISTINCT chat FROM sc)
    UNION ALL SELECT f.penalty, f.chat, sc.k, list_append(f.log, list_transform(list_sort(list_transform(sc.c, lambda x: struct_pack(s := round(f.penalty * 1000000)::BIGINT * len(list_filter(flatten(f.log), lambda y: y = x.i)) - x.m, i := x.i)))[1:3], lambda z: z.i))
    FROM f JOIN sc ON sc.chat = f.chat AND sc.k = f.k + 1),
e AS (SELECT penalty, log FROM f QUALIFY k = max(k) OVER (PARTITION BY penalty, chat))
SELECT penalty, sum(list_sum(list_transform(range(1, len(log) + 1), lambda n: len(list_filter(log[n], lambda i: list_contains(flatten(log[greatest(1, n - 3):n - 1]), i))))))::BIGINT AS repeats,
    sum(len(flatten(log)))::BIGINT AS picks, sum(len(list_distinct(flatten(log))))::BIGINT AS distinct_items FROM e GROUP BY 1""")
def repeat_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a penalty on surfaced items thins repeats."""
    per = episodes.repetition(context.asked(spark, sf_dir), items(spark, sf_dir).withColumn("surfaced", F.lit(0)), PENALTIES, C)
    return per.groupBy("penalty").agg(F.sum("repeats").alias("repeats"), F.sum("picks").alias("picks"), F.sum("distinct_items").alias("distinct_items"))


@book.query(f"""WITH g AS (SELECT user_id, event_type AS trigger, floor(value / 100)::BIGINT AS response, count(*) AS n FROM events GROUP BY ALL), w AS (SELECT *, sum(n) OVER (PARTITION BY user_id, trigger) - n AS counter FROM g)
SELECT user_id, trigger, response, n, counter::BIGINT AS counter, CASE WHEN n >= {DEFAULT.min_evidence} THEN round(least(0.5 + 0.1 * (n - {DEFAULT.min_evidence}), 0.9) - 0.15 * counter, 6)::DOUBLE END AS confidence FROM w""")
def interpretation_conf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns of (trigger, response) with counter-evidence; fewer than three observations are held."""
    g = table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("trigger"), F.floor(F.col("value") / 100).alias("response")).agg(F.count("*").alias("n"))
    w = g.withColumn("counter", F.sum("n").over(Window.partitionBy("user_id", "trigger")) - F.col("n"))
    conf = F.least(0.5 + 0.1 * (F.col("n") - DEFAULT.min_evidence), F.lit(0.9)) - 0.15 * F.col("counter")
    return w.withColumn("confidence", F.when(F.col("n") >= DEFAULT.min_evidence, F.round(conf, 6)))


G = S.GUARD_LATIN
SQL_EXCUSE = G["excuse"].replace("'", "''")
NEAR = f"substr(text, greatest(1, spot - {S.REACH}), spot + length(m) - 1 + {S.REACH} - greatest(1, spot - {S.REACH}) + 1)"


@book.query(f"""WITH d AS (SELECT text, toxic = 1 AS truth, regexp_extract(text, '{G["forbid"]}') AS m FROM documents JOIN labels USING (doc_id)),
h AS (SELECT text, truth, m, length(string_split_regex(text, '{G["forbid"]}')[1]) + 1 AS spot FROM d),
p AS (SELECT truth, 'v1' AS version, m <> '' AS hit FROM h UNION ALL SELECT truth, 'v2', m <> '' AND NOT regexp_matches({NEAR}, '{SQL_EXCUSE}') FROM h),
c AS (SELECT version, count(*) FILTER (WHERE hit AND truth) AS tp, count(*) FILTER (WHERE hit AND NOT truth) AS fp, count(*) FILTER (WHERE NOT hit AND truth) AS fn, count(*) FILTER (WHERE NOT hit AND NOT truth) AS tn FROM p GROUP BY 1)
SELECT *, round(tp / nullif(tp + fp, 0), 6)::DOUBLE AS precision, round(tp / nullif(tp + fn, 0), 6)::DOUBLE AS recall FROM c""")
def guard_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The guard without and with excuses, against labels."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("text", (F.col("toxic") == 1).alias("truth"))
    each = F.array(*(F.struct(F.lit(v).alias("version"), S.violates(F.col("text"), G["forbid"], e).alias("hit")) for v, e in (("v1", None), ("v2", G["excuse"]))))
    return d.select("truth", F.explode(each).alias("g")).groupBy(F.col("g.version").alias("version")).agg(*S.confusion(F.col("g.hit"), F.col("truth")))


def state() -> dict:
    """A made-up state for every document: how close two characters are, how they speak, and whether the scene is closed."""
    stage = F.element_at(F.array(*map(F.lit, ("apart", "strange", "close"))), (F.col("doc_id") % 3 + 1).cast("int"))
    return {"stage": stage, "speech": F.when(F.col("doc_id") % 2 == 0, "casual").otherwise("polite"), "locked": F.col("doc_id") % 5 == 0}


SQL_STATE = {"stage": "['apart', 'strange', 'close'][doc_id % 3 + 1]", "speech": "CASE WHEN doc_id % 2 = 0 THEN 'casual' ELSE 'polite' END"}
BROKEN = " UNION ALL ".join(
    f"SELECT '{name}' AS rule, version FROM (SELECT text, regexp_extract(text, '{forbid}') AS m, length(string_split_regex(text, '{forbid}')[1]) + 1 AS spot FROM documents WHERE {SQL_STATE[field]} = '{value}'), v WHERE m <> '' AND (version = 'v1' OR NOT regexp_matches({NEAR}, '{SQL_EXCUSE}'))"
    for name, field, value, forbid in S.STATE_RULES_LATIN
) + f" UNION ALL SELECT '{S.ROSTER_RULE}', version FROM documents, v WHERE doc_id % 5 = 0 AND regexp_matches(text, '{S.ROSTER_LATIN}') AND (version = 'v1' OR NOT regexp_matches(text, '{SQL_EXCUSE}'))"


@book.query(f"WITH v AS (SELECT unnest(['v1', 'v2']) AS version) SELECT version, rule, count(*) AS hits FROM ({BROKEN}) GROUP BY ALL")
def guard_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What texts break of the rules of their state and of a closed scene, without and with excuses."""
    each = F.array(*(F.struct(F.lit(v).alias("version"), S.violations(F.col("text"), state(), S.STATE_RULES_LATIN, S.ROSTER_LATIN, e).alias("rules")) for v, e in (("v1", None), ("v2", G["excuse"]))))
    found = table(spark, sf_dir, "documents").select(F.explode(each).alias("g")).select("g.version", F.explode("g.rules").alias("rule"))
    return found.groupBy("version", "rule").agg(F.count("*").alias("hits"))


CS = S.COLD_START_LATIN


@book.query(f"SELECT role, count(*) AS turns, count(*) FILTER (WHERE regexp_matches(text, '{CS['past']}') AND NOT regexp_matches(text, '{CS['admit']}')) AS claims, count(*) FILTER (WHERE regexp_matches(text, '{CS['admit']}')) AS admits, count(*) FILTER (WHERE regexp_matches(text, '{CS['ask']}')) AS asks FROM conversations GROUP BY 1")
def answer_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classifiers of answers: claims of a past, admissions, questions back."""
    rules = S.cold_start(F.col("text"), CS)
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("turns"), *(F.count_if(c).alias(n) for n, c in rules.items()))


@book.query(rf"""SELECT role, count(*) AS turns, count(*) FILTER (WHERE len(list_filter(list_transform(string_split_regex(text, '[.!?…\n]'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: length(s) >= 2 AND regexp_matches(s, '{S.HONORIFIC_LATIN}'))) > 0) AS polite,
count(*) FILTER (WHERE regexp_matches(text, '{S.FAMILY_LATIN["topic"]}') AND regexp_matches(text, '{S.FAMILY_LATIN["ask"]}')) AS probes FROM conversations GROUP BY 1""")
def answer_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with a polite ending, and turns that ask about a family."""
    t = table(spark, sf_dir, "conversations")
    return t.groupBy("role").agg(F.count("*").alias("turns"), F.count_if(S.polite(F.col("text"), S.HONORIFIC_LATIN)).alias("polite"), F.count_if(S.probes(F.col("text"), S.FAMILY_LATIN)).alias("probes"))


def stem_lists(source: str, text: str, keys: str, name: str) -> str:
    cte = stems_cte(f"{name}_u", "word", f"{keys}, i").replace("st", f"{name}_st")
    return (
        rf"{name}_u AS (SELECT {keys}, i, regexp_replace(r, '[^\p{{L}}\p{{N}}_]', '', 'g') AS word FROM (SELECT {keys}, unnest(w) AS r, unnest(range(len(w))) AS i FROM (SELECT {keys}, {SQL_RAW.format(text)} AS w FROM {source}))), {cte}, "
        f"{name} AS (SELECT {keys}, list(w ORDER BY i) AS l, string_agg(w, '' ORDER BY i) AS whole FROM {LAST.replace('st', f'{name}_st')} WHERE w <> '' GROUP BY ALL)"
    )


@book.query(f"""{BM25}, tops AS (SELECT query_id, rank, doc_id, d.text FROM r JOIN documents d USING (doc_id) WHERE rank <= 3), {stem_lists('benchmark', 'text', 'item_id', 'gg')}, {stem_lists('tops', 'text', 'query_id, rank', 'aa')},
x AS (SELECT query_id, rank, contains(aa.whole, gg.whole) AS one, len(list_filter(gg.l, lambda w: contains(aa.whole, w))) / greatest(1, len(gg.l)) AS share FROM aa JOIN gg ON gg.item_id = query_id)
SELECT query_id, rank, CASE WHEN one OR share = 1 THEN TRUE WHEN share > 0 THEN NULL ELSE FALSE END AS ok FROM x""")
def score_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule scorer: the three best documents as answers to a passage; null is left to a person."""
    top = F.broadcast(ops.ranked(best(spark, sf_dir, 3), 3)).join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select("query_id", "rank", S.stems(F.col("text")).alias("a"))
    g = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), S.stems(F.col("text")).alias("g"))
    both = top.join(g, "query_id").withColumn("whole", F.array_join("a", ""))
    return both.select("query_id", "rank", S.verdict(F.col("g"), F.array(F.col("whole"))).alias("ok"))


def replaced(text: str) -> str:
    for pattern, sign in S.NUMBERS_LATIN:
        text = f"regexp_replace({text}, '{pattern}', '{sign}', 'g')"
    return text


ROOTED = f"list_transform(l, lambda w: CASE WHEN length(w) > 1 THEN regexp_replace(w, '{S.TAIL_LATIN}', '') ELSE w END)"
PART = "array_to_string(list_slice(string_split(text, ' '), {0}, {1}), ' ')"


@book.query(rf"""WITH gs AS (SELECT item_id, text, item_id % 4 = 0 AS by_hand, {PART.format(1, 3)} || ' / ' || {PART.format(4, 6)} AS gold FROM benchmark), al AS (SELECT item_id, n, {replaced('alt')} AS text FROM (SELECT item_id, unnest(string_split_regex(gold, '\s*/\s*')) AS alt, generate_subscripts(string_split_regex(gold, '\s*/\s*'), 1) AS n FROM gs) WHERE trim(alt) <> ''),
an AS (SELECT doc_id AS item_id, {replaced("coalesce(text, '')")} AS text FROM documents WHERE doc_id IN (SELECT item_id FROM benchmark)), {stem_lists('al', 'text', 'item_id, n', 'ag')}, {stem_lists('an', 'text', 'item_id', 'aw')},
cg AS (SELECT item_id, {ROOTED} AS r FROM ag), cw AS (SELECT an.item_id, coalesce(array_to_string({ROOTED}, ''), '') AS whole FROM an LEFT JOIN aw USING (item_id)),
sh AS (SELECT item_id, CASE WHEN array_to_string(r, '') <> '' AND contains(whole, array_to_string(r, '')) THEN 1.0 WHEN len(c) > 0 THEN len(list_filter(c, lambda w: contains(whole, w))) / len(c) ELSE 0.0 END AS share
    FROM (SELECT item_id, r, whole, list_filter(r, lambda w: w <> '' AND w NOT IN ({', '.join(f"'{w}'" for w in S.SMALL_LATIN)})) AS c FROM cg JOIN cw USING (item_id))),
bs AS (SELECT item_id, max(share) AS best FROM sh GROUP BY 1)
SELECT gs.item_id, CASE WHEN by_hand THEN NULL WHEN best = 1 THEN TRUE WHEN best > 0 THEN NULL ELSE FALSE END AS ok FROM gs JOIN an USING (item_id) LEFT JOIN bs USING (item_id)""")
def score_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed scorer with alternatives, number words and kinds that are left to a person; the document of the same number is the answer."""
    part = lambda a: F.array_join(F.slice(F.split("text", " "), a, 3), " ")
    g = table(spark, sf_dir, "benchmark").select("item_id", F.when(F.col("item_id") % 4 == 0, "abstention").otherwise("single_hop").alias("kind"), F.concat(part(1), F.lit(" / "), part(4)).alias("gold"))
    a = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.coalesce("text", F.lit("")).alias("answer"))
    return g.join(a, "item_id").select("item_id", S.typed_verdict(F.col("kind"), F.col("gold"), F.col("answer")).alias("ok"))


@book.query(f"""{ARMS}, ok AS (SELECT arm, query_id, max((g.doc_id IS NOT NULL)::INT) AS ok FROM picks LEFT JOIN gold g USING (query_id, doc_id) GROUP BY ALL),
j AS (SELECT o.arm, o.ok, t.ok AS oracle, w.ok AS base FROM ok o JOIN ok t ON t.query_id = o.query_id AND t.arm = 'oracle' JOIN ok w ON w.query_id = o.query_id AND w.arm = 'window')
SELECT arm, count(*) AS questions, sum(ok)::BIGINT AS right_answers, count(*) FILTER (WHERE oracle = 0) AS use_failures, count(*) FILTER (WHERE oracle = 1 AND ok = 0) AS search_failures, count(*) FILTER (WHERE ok = 1 AND base = 0) AS beats_window FROM j GROUP BY 1""")
def layer_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each policy fails, by comparison with the oracle's and the window's answers."""
    picks, g = arms(spark, sf_dir)
    ok = picks.join(g.withColumn("hit", F.lit(1)), ["query_id", "doc_id"], "left").groupBy("arm", "query_id").agg(F.max(F.coalesce("hit", F.lit(0))).alias("ok"))
    arm = lambda name, col: ok.where(F.col("arm") == name).select("query_id", F.col("ok").alias(col))
    j = ok.join(arm("oracle", "oracle"), "query_id").join(arm("window", "base"), "query_id")
    return j.groupBy("arm").agg(
        F.count("*").alias("questions"), F.sum("ok").cast("long").alias("right_answers"), F.count_if(F.col("oracle") == 0).alias("use_failures"),
        F.count_if((F.col("oracle") == 1) & (F.col("ok") == 0)).alias("search_failures"), F.count_if((F.col("ok") == 1) & (F.col("base") == 0)).alias("beats_window"),
    )


@book.query(f"""{BM25}, qs AS (SELECT query_id, count(*) AS size FROM q GROUP BY 1), c AS (SELECT query_id, doc_id, count(*) / any_value(size) AS v FROM q JOIN p USING (term) JOIN qs USING (query_id) GROUP BY ALL),
cr AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(v, 6) DESC, doc_id) AS rank FROM c),
o AS (SELECT g.query_id, max((coalesce(r.rank, 99999) <= 5)::INT) AS a, max((coalesce(cr.rank, 99999) <= 5)::INT) AS b FROM gold g LEFT JOIN r USING (query_id, doc_id) LEFT JOIN cr ON cr.query_id = g.query_id AND cr.doc_id = g.doc_id GROUP BY 1)
SELECT count(*) AS questions, sum(a)::BIGINT AS bm25, sum(b)::BIGINT AS containment, abs(sum(a) - sum(b))::BIGINT AS range, count(*) FILTER (WHERE a <> b) AS flipped FROM o""")
def run_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How two runs with different rankings differ, in sum and question by question."""
    index, asked = indexed(spark, sf_dir)
    runs = {name: ops.ranked(ops.contenders(index, asked, 5, bm25, DEFAULT), 5) for name, bm25 in (("a", True), ("b", False))}
    o = gold(spark, sf_dir)
    for name, r in runs.items():
        o = o.join(r.select("query_id", "doc_id", F.lit(1).alias(name)), ["query_id", "doc_id"], "left")
    o = o.groupBy("query_id").agg(*(F.max(F.coalesce(n, F.lit(0))).alias(n) for n in runs))
    a, b = F.sum("a").cast("long"), F.sum("b").cast("long")
    return o.agg(F.count("*").alias("questions"), a.alias("bm25"), b.alias("containment"), F.abs(a - b).alias("range"), F.count_if(F.col("a") != F.col("b")).alias("flipped"))


@book.query("WITH c AS (SELECT regexp_extract(url, '://([^/?#]*)', 1) AS claim, regexp_extract(url, '/(en|de|fr|es)/', 1) AS value FROM pages WHERE url IS NOT NULL) SELECT claim, count(DISTINCT value) AS n_values, array_to_string(list_sort(list(DISTINCT value)), ',') AS found FROM c GROUP BY 1 HAVING count(DISTINCT value) > 1")
def claim_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts that state more than one value of the same claim, here the language of their pages."""
    c = table(spark, sf_dir, "pages").where("url IS NOT NULL").select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("claim"), F.regexp_extract("url", "/(en|de|fr|es)/", 1).alias("value"))
    return c.groupBy("claim").agg(F.count_distinct("value").alias("n_values"), F.array_join(F.sort_array(F.collect_set("value")), ",").alias("found")).where("n_values > 1")


@book.query(f"""WITH a AS (SELECT doc_id, source, regexp_matches(text, '{G["forbid"]}') AS auto FROM documents), m AS (SELECT doc_id, max(toxic) = 1 AS manual FROM labels GROUP BY 1)
SELECT source, count(*) AS documents, count(*) FILTER (WHERE auto) AS auto_toxic, count(*) FILTER (WHERE coalesce(manual, auto)) AS final_toxic, count(*) FILTER (WHERE manual <> auto) AS overridden FROM a LEFT JOIN m USING (doc_id) GROUP BY 1""")
def adjudicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Automatic verdicts, overridden by a person's where there is one."""
    a = table(spark, sf_dir, "documents").select("doc_id", "source", F.col("text").rlike(G["forbid"]).alias("auto"))
    m = table(spark, sf_dir, "labels").groupBy("doc_id").agg((F.max("toxic") == 1).alias("manual"))
    j = a.join(m, "doc_id", "left")
    return j.groupBy("source").agg(F.count("*").alias("documents"), F.count_if("auto").alias("auto_toxic"), F.count_if(F.coalesce("manual", "auto")).alias("final_toxic"), F.count_if(F.col("manual") != F.col("auto")).alias("overridden"))


@book.query(f"""WITH {SQL_ROOTS}, l AS (SELECT conv_id, turn, list(root) AS r FROM roots GROUP BY 1, 2), sm AS (SELECT conv_id, arg_min(r, turn) AS s FROM l JOIN conversations USING (conv_id, turn) WHERE role = 'assistant' GROUP BY 1)
SELECT conv_id, count(*) AS items, count(*) FILTER (WHERE len(list_intersect(r, s)) / len(r) >= 0.5) AS survived FROM l JOIN conversations USING (conv_id, turn) JOIN sm USING (conv_id) WHERE role = 'user' GROUP BY 1""")
def summary_survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of a chat's user turns have half of their roots in its first answer."""
    r = turns(spark, sf_dir).select("chat", "seq", "role", T.roots(F.col("text")).alias("r")).where(F.size("r") > 0)
    s = r.where("role = 'assistant'").groupBy("chat").agg(F.min(F.struct("seq", "r"))["r"].alias("s"))
    kept = F.size(F.array_intersect("r", "s")) / F.size("r") >= 0.5
    return r.where("role = 'user'").join(s, "chat").groupBy(F.col("chat").alias("conv_id")).agg(F.count("*").alias("items"), F.count_if(kept).alias("survived"))


def sql_extract(units: str, k: int) -> str:
    """SQL: the ``k`` units of a list of (i, r) whose roots are most common in the list."""
    common = f"len(list_filter(flatten(list_transform({units}, lambda v: v.r)), lambda y: y = x))"
    scored = f"list_transform({units}, lambda u: struct_pack(s := -(list_sum(list_transform(u.r, lambda x: {common}))::BIGINT * 1000000 // len(u.r)), i := u.i, r := u.r))"
    return f"list_sort(list_transform(list_sort({scored})[1:{k}], lambda z: struct_pack(i := z.i, r := z.r)))"


#: Neighbouring conversations that are the sessions of one user.
LIFETIME = 10
DG = digests


@book.query(f"""WITH RECURSIVE {SQL_ROOTS}, un AS (SELECT conv_id // {LIFETIME} AS owner, conv_id AS session, conv_id * 1000 + turn AS i, role, list(root) AS r FROM roots JOIN conversations USING (conv_id, turn) WHERE role <> 'system' GROUP BY ALL),
se AS (SELECT owner, session, row_number() OVER (PARTITION BY owner ORDER BY session) AS n, e, {sql_extract('e', DG.SESSION)} AS d FROM (SELECT owner, session, list(struct_pack(i := i, r := r) ORDER BY i) AS e FROM un GROUP BY ALL)),
al AS (SELECT owner, session, n, d, flatten(list(e) OVER w) AS e, flatten(list(d) OVER w) AS ds, flatten(list(d) OVER (PARTITION BY owner ORDER BY n ROWS {DG.WINDOW - 1} PRECEDING)) AS lw FROM se WINDOW w AS (PARTITION BY owner ORDER BY n)),
f AS (SELECT owner, n, {sql_extract('d', DG.LIFE)} AS p2, {sql_extract('d', DG.LIFE)} AS p3, 2::BIGINT AS depth FROM al WHERE n = 1
    UNION ALL SELECT owner, n, {sql_extract('c2', DG.LIFE)}, {sql_extract('c3', DG.LIFE)}, depth
    FROM (SELECT al.owner, al.n, list_concat(f.p2, al.d) AS c2, CASE WHEN al.n % {DG.EVERY} = 0 THEN al.e ELSE list_concat(f.p3, list_filter(al.lw, lambda v: NOT list_contains(list_transform(f.p3, lambda z: z.i), v.i))) END AS c3,
        CASE WHEN al.n % {DG.EVERY} = 0 THEN 1 ELSE f.depth + 1 END AS depth FROM f JOIN al ON al.owner = f.owner AND al.n = f.n + 1)),
li AS (SELECT owner, n, '{DG.POLICIES[0]}' AS policy, 1 AS depth, {sql_extract('e', DG.LIFE)} AS l FROM al UNION ALL SELECT owner, n, '{DG.POLICIES[1]}', n + 1, p2 FROM f
    UNION ALL SELECT owner, n, '{DG.POLICIES[2]}', depth, p3 FROM f UNION ALL SELECT owner, n, '{DG.POLICIES[3]}', 2, {sql_extract('ds', DG.LIFE)} FROM al),
tl AS (SELECT owner, session, policy, depth, array_to_string(list_transform(l, lambda z: z.i), ',') AS digest, flatten(list_transform(l, lambda z: z.r)) AS told FROM li JOIN (SELECT owner, n, session FROM al) USING (owner, n))
SELECT tl.owner, tl.session, policy, depth::BIGINT AS depth, digest, count(un.i) AS items, count(*) FILTER (WHERE len(list_intersect(un.r, told)) * 2 >= len(un.r)) AS survived
FROM tl LEFT JOIN un ON un.owner = tl.owner AND un.session <= tl.session AND un.role = 'user' GROUP BY ALL""")
def digest_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of a user's life after every session by four policies, how deep it is, and how many of the user's turns survive in it."""
    t = turns(spark, sf_dir).where("role <> 'system'")
    t = t.select(F.floor(F.col("chat") / LIFETIME).alias("owner"), F.col("chat").alias("session"), (F.col("chat") * 1000 + F.col("seq")).alias("at"), "role", "text")
    return digests.chains(t, F.col("role") == "user", C)


@book.query("SELECT user_id, count(*) AS events FROM (SELECT user_id, dense_rank() OVER (PARTITION BY user_id ORDER BY ts::DATE) AS d FROM events) WHERE d <= 3 GROUP BY 1")
def first_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in the first three days on which a user was seen."""
    e = table(spark, sf_dir, "events").withColumn("d", F.dense_rank().over(Window.partitionBy("user_id").orderBy(F.col("ts").cast("date"))))
    return e.where("d <= 3").groupBy("user_id").agg(F.count("*").alias("events"))
