"""Sources, sinks and tables: what is written to the shared folder and read back must be what the tables hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..schemas import migrated
from ..sources import corpus, files
from ..streaming import shared
from .base import Book, table

book = Book()
QUERIES, ORACLES = book.queries, book.oracles
CHAT = 3


@book.query("SELECT turn + 1000 * conv_id AS seq, 'S' || conv_id AS session, turn::INTEGER AS turn, role, text FROM conversations")
def lines_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as JSON lines under a fixed schema, written in order and read back."""
    t = table(spark, sf_dir, "conversations")
    seq = F.col("turn") + 1000 * F.col("conv_id")
    path = shared(spark, "lines")
    files.write_lines(t.select(seq.alias("seq"), F.concat(F.lit("S"), F.col("conv_id").cast("string")).alias("session"), F.col("turn").cast("int").alias("turn"), "role", "text"), path, ["seq"])
    return files.read_corpus(spark, path).select("seq", "session", "turn", "role", "text")


@book.query("SELECT 'R' || r_regionkey AS id, r_name AS text, r_regionkey::INTEGER AS turn FROM region")
def ledger_from_yaml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: a small ledger of facts in YAML."""
    r = table(spark, sf_dir, "region").select(F.format_string("  - {id: R%s, text: %s, at: {session: S01, turn: %s}}", "r_regionkey", "r_name", "r_regionkey").alias("value"), F.lit(1).alias("n"))
    path = shared(spark, "ledger")
    spark.createDataFrame([("facts:", 0)], "value string, n int").unionByName(r).coalesce(1).sortWithinPartitions("n").select("value").write.text(path)
    return files.read_yaml(spark, path, "facts", files.FACT).select("id", "text", F.col("at.turn").alias("turn"))


@book.query("SELECT r_name AS arm, 'N' || n_nationkey AS id, n_nationkey % 2 = 0 AS ok, n_name AS ans FROM nation JOIN region ON n_regionkey = r_regionkey")
def answers_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results as one JSON object of arms to lists of answers, written with to_json and read back."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    answer = F.struct(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("id"), (F.col("n_nationkey") % 2 == 0).alias("ok"), F.col("n_name").alias("ans"))
    arms = n.join(r, n["n_regionkey"] == r["r_regionkey"]).groupBy("r_name").agg(F.collect_list(answer).alias("answers"))  # 25 rows
    path = shared(spark, "answers")
    arms.groupBy().agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("r_name", "answers")))).alias("value")).coalesce(1).write.text(path)
    return files.read_answers(spark, path).select("arm", "id", "ok", "ans")


@book.query(f"SELECT conv_id AS chat, turn AS seq, CASE WHEN role = 'user' THEN upper(text) ELSE text END AS text, CASE WHEN role = 'user' THEN 2 ELSE 1 END AS version FROM conversations WHERE conv_id = {CHAT}")
def turns_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns added in two batches, where the second replaces the user's; one chat is read, from its own folder."""
    t = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("chat"), F.col("turn").alias("seq"), "role", "text", F.lit(1).alias("version"))
    path = shared(spark, "turns")
    files.append(t, path)
    files.append(t.where("role = 'user'").withColumns({"text": F.upper("text"), "version": F.lit(2)}), path)
    return files.latest(files.scan(spark, path, t.schema, CHAT), ["chat", "seq"], ["version"]).select("chat", "seq", "text", "version")


OPS = "CASE event_type WHEN 'view' THEN 'add' WHEN 'click' THEN 'add' WHEN 'error' THEN 'drop' WHEN 'signup' THEN 'keep' ELSE 'reset' END"


@book.query(f"""WITH l AS (SELECT user_id, {OPS} AS op, ts, event_id FROM events), r AS (SELECT *, count(*) FILTER (WHERE op = 'reset') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS resets FROM l)
SELECT user_id, count(*) FILTER (WHERE op = 'add' AND resets = 0) AS count, coalesce(arg_max(op, (ts, event_id)) FILTER (WHERE op IN ('drop', 'keep')), 'keep') = 'keep' AS valid FROM r GROUP BY 1""")
def counters_from_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters and flags as the state of a log of updates, in place of updates of rows."""
    log = table(spark, sf_dir, "events").select("user_id", F.expr(OPS).alias("op"), F.lit(1).alias("amount"), "ts", "event_id")
    return files.counted(log, ["user_id"], ["ts", "event_id"])


FIELDS = ["stage", "affinity"]


@book.query("""WITH l AS (SELECT user_id AS chat, event_type, value, event_id, ts FROM events)
SELECT chat, 'stage' AS field, arg_max(event_type, (ts, event_id)) AS value FROM l WHERE event_id % 3 = 0 GROUP BY 1
UNION ALL SELECT chat, 'affinity', arg_max(floor(value)::BIGINT::VARCHAR, (ts, event_id)) FROM l WHERE event_id % 3 = 1 GROUP BY 1
UNION ALL SELECT chat, 'event:' || (event_id % 50), count(*)::VARCHAR FROM l WHERE event_id % 3 = 2 GROUP BY 1, 2
UNION ALL SELECT chat, 'debts', count(*)::VARCHAR FROM l WHERE event_id % 7 = 0 GROUP BY 1""")
def deltas_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3: deltas of a chat's state: listed fields take the last value, ``event:<id>`` counts how often an item was surfaced, ``debt`` sets one up, all else is ignored."""
    e = table(spark, sf_dir, "events")
    third = F.col("event_id") % 3
    named = F.map_filter(
        F.create_map(F.lit("stage"), F.when(third == 0, F.col("event_type")), F.lit("affinity"), F.when(third == 1, F.floor("value").cast("string")), F.concat(F.lit("event:"), (F.col("event_id") % 50).cast("string")), F.when(third == 2, "1"), F.lit("debt"), F.when(F.col("event_id") % 7 == 0, F.col("props")), F.lit("other"), F.lit("x")),
        lambda _, v: v.isNotNull(),
    )
    d = e.select(F.col("user_id").alias("chat"), F.struct("ts", "event_id").alias("seq"), named.alias("delta"))
    state = files.last_state(d, FIELDS).select("chat", F.explode(F.create_map(*(x for f in FIELDS for x in (F.lit(f), F.col(f))))).alias("field", "value")).where("value IS NOT NULL")
    each = d.select("chat", F.explode("delta").alias("field", "value"))
    shown = each.where("field LIKE 'event:%'").groupBy("chat", "field").agg(F.count("*").cast("string").alias("value"))
    debts = each.where("field = 'debt'").groupBy("chat").agg(F.count("*").cast("string").alias("value")).select("chat", F.lit("debts").alias("field"), "value")
    return state.unionByName(shown).unionByName(debts)


@book.query("SELECT doc_id, coalesce(length(text), 0)::BIGINT AS chars, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 2 END AS run FROM documents")
def resumed_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: a run that was stopped after a third of its rows goes on with the rest, and what both wrote is read as one."""
    todo = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"))
    path = shared(spark, "results")
    todo.where("doc_id % 3 = 0").withColumn("run", F.lit(1)).write.parquet(path)
    done = spark.read.parquet(path)
    files.undone(todo, done, ["doc_id"]).withColumn("run", F.lit(2)).write.mode("append").parquet(path)
    return files.latest(spark.read.parquet(path), ["doc_id"], ["run"])


@book.query("SELECT event_id, user_id::VARCHAR AS chat, 1::BIGINT AS mention_count, NULL::VARCHAR AS dedup_key FROM events")
def events_migrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of an old version gets the columns that later versions added."""
    return migrated(table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("chat")), "event", 1)


@book.query("""WITH p AS (SELECT item_id % (SELECT greatest(24, ceil(count(*) / 15))::BIGINT FROM benchmark) + 1 AS s, item_id % 30 + 1 AS turn, 'B' || lpad(item_id::VARCHAR, 9, '0') AS planted_id FROM benchmark),
n AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY turn, planted_id) AS n, count(*) OVER (PARTITION BY s) AS size FROM p), t AS (SELECT *, max(turn - n) OVER (PARTITION BY s ORDER BY turn, planted_id) + n AS slot FROM n),
o AS (SELECT *, greatest(0, max(slot) OVER (PARTITION BY s) - 30) AS over FROM t), z AS (SELECT s, planted_id, CASE WHEN over > 0 THEN least(slot, 30 - (size - n)) ELSE slot END AS turn FROM o)
SELECT ((s - 1) * 30 + turn)::BIGINT AS seq, printf('S%02d', s) AS session, turn::INTEGER AS turn, planted_id FROM z""".replace(" AS over ", ' AS "over" ').replace("WHEN over >", 'WHEN "over" >'))
def corpus_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The synthetic corpus over items that fall into the same slots, and only its planted turns; there are sessions for 15 items each."""
    b = table(spark, sf_dir, "benchmark")
    sessions = max(24, -(-b.count() // 15))
    planted = b.select(F.format_string("S%02d", F.col("item_id") % sessions + 1).alias("session"), (F.col("item_id") % 30 + 1).cast("int").alias("turn"), F.concat(F.lit("B"), F.lpad(F.col("item_id").cast("string"), 9, "0")).alias("planted_id"), F.lit("event").alias("kind"), "text")
    return corpus.generate(spark, planted, sessions).where("planted_id IS NOT NULL").select("seq", "session", "turn", "planted_id")


SPEC = "CASE n % 4 WHEN 0 THEN concat(n % 7, 'd') WHEN 1 THEN concat('S', lpad(CAST(n % 30 + 1 AS VARCHAR(9)), 2, '0')) WHEN 2 THEN 'session_start' ELSE 'soon' END"


@book.query(f"""WITH c AS ({ORACLES["corpus_planted"]}), n AS (SELECT seq, session, CAST(substr(planted_id, 2) AS BIGINT) AS n, CAST(substr(session, 2) AS BIGINT) AS setup FROM c), s AS (SELECT *, {SPEC} AS spec FROM n)
SELECT seq, session, spec, CASE WHEN regexp_full_match(spec, '[0-9]+d') THEN greatest(setup + CAST(replace(spec, 'd', '') AS BIGINT), setup + 1) WHEN regexp_full_match(spec, 'S[0-9]+') THEN greatest(CAST(substr(spec, 2) AS BIGINT), setup + 1) WHEN spec = 'session_start' THEN setup + 1 END AS due FROM s""")
def trigger_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session names such as ``S07`` and times such as ``3d`` of the planted items, and the session in which each trigger first fires."""
    c = corpus_planted(spark, sf_dir).withColumn("n", F.expr("CAST(substr(planted_id, 2) AS BIGINT)")).withColumn("spec", F.expr(SPEC))
    return c.select("seq", "session", "spec", T.first_due(T.session_number(F.col("session")), F.col("spec")).alias("due"))
