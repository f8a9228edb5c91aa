"""JSON lines, nested JSON results, YAML ledgers and Markdown as DataFrames, and the sinks that go with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import SCHEMAS, struct

FACT = T.StructType([*struct("id STRING, text STRING, predicate STRING, object STRING, realm STRING"), T.StructField("at", struct("session STRING, turn INT")), *struct("superseded_by STRING, importance DOUBLE")])
ANSWERS = T.MapType(T.StringType(), T.ArrayType(struct("id STRING, type STRING, ok BOOLEAN, why STRING, ans STRING, gold STRING, model STRING")))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Turns from JSON lines under a fixed schema; a line that is no JSON raises."""
    return spark.read.schema(SCHEMAS["corpus"]).option("mode", "FAILFAST").json(path)


def read_yaml(spark: SparkSession, path: str, key: str, schema: T.StructType) -> DataFrame:
    """The list under ``key`` of a small YAML file; it is read through Spark, so any store will do. Dates stay text where the schema says so."""
    import yaml

    text = spark.read.text(path, wholetext=True).first()[0]
    return spark.createDataFrame([_shaped(x, schema) for x in yaml.safe_load(text).get(key) or []], schema)


def _shaped(value, kind: T.DataType):
    if value is None:
        return None
    if isinstance(kind, T.StructType):
        return tuple(_shaped(value.get(f.name), f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return [_shaped(x, kind.elementType) for x in value]
    if isinstance(kind, T.MapType):
        return {str(k): _shaped(v, kind.valueType) for k, v in value.items()}
    return str(value) if isinstance(kind, T.StringType) else float(value) if isinstance(kind, T.DoubleType) else value


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """(arm, id, type, ok, why, ans, gold, model) from one JSON object of arms to lists of answers."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", ANSWERS).alias("m"))
    return raw.select(F.explode("m").alias("arm", "answers")).select("arm", F.explode("answers").alias("a")).select("arm", "a.*")


def read_markdown(spark: SparkSession, path: str, without: tuple[str, ...] = ()) -> DataFrame:
    """(name, text) of every Markdown file below a path, but for files of the given names."""
    d = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(path, wholetext=True)
    d = d.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("name"), F.col("value").alias("text"))
    return d.where(~F.col("name").isin(*without)) if without else d


def parse_session(sessions: DataFrame) -> DataFrame:
    """(name, n, speaker, text, marker) of numbered turns ``**n. speaker** text`` with an optional marker after an arrow."""
    line = sessions.select("name", F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").rlike(r"^\*\*\d+\. "))
    take = lambda pattern, group: F.regexp_extract("line", pattern, group)
    shape = r"^\*\*(\d+)\. ([^*]+)\*\*\s*(.*?)\s*(?:← `([^`]+)`.*)?$"
    return line.select("name", take(shape, 1).cast("int").alias("n"), F.trim(take(shape, 2)).alias("speaker"), take(shape, 3).alias("text"), F.nullif(take(shape, 4), F.lit("")).alias("marker"))


def latest(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of every key of an append-only log: insert-or-replace without updates in place."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return log.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


#: Folders that a table of chats is dealt over.
BUCKETS = 8


def append(df: DataFrame, path: str, key: str = "chat") -> None:
    """A batch of rows added to a table of chats, in one write; nothing that is there is touched. Chats are dealt over folders."""
    df.withColumn("bucket", F.pmod(F.col(key), F.lit(BUCKETS)).cast("int")).repartition("bucket").write.mode("append").partitionBy("bucket").parquet(path)


def scan(spark: SparkSession, path: str, schema: T.StructType, chat: int, key: str = "chat") -> DataFrame:
    """The rows of one chat; only its folder is read, and the rest of the predicate reaches the Parquet files."""
    whole = spark.read.schema(T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(path)
    return whole.where((F.col("bucket") == chat % BUCKETS) & (F.col(key) == chat)).drop("bucket")


def counted(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """State of an append-only log of updates ``(keys, op, amount, order)``: the sum of all ``add`` rows since the last ``reset``, and whether the last ``drop`` or ``keep`` leaves the row valid."""
    w = Window.partitionBy(*keys).orderBy(*order)
    ahead = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = log.withColumn("resets", F.count_if(F.col("op") == "reset").over(ahead))
    when = F.when(F.col("op").isin("drop", "keep"), F.struct(*order))
    return rows.groupBy(*keys).agg(F.sum(F.when((F.col("op") == "add") & (F.col("resets") == 0), F.col("amount")).otherwise(0)).alias("count"), (F.coalesce(F.max_by("op", when), F.lit("keep")) == "keep").alias("valid"))


def last_state(deltas: DataFrame, fields: list[str], key: str = "chat", order: str = "seq") -> DataFrame:
    """The last value of every field that a chat's deltas named; ``deltas(chat, seq, delta MAP)``. Fields that are not listed are ignored."""
    return deltas.groupBy(key).agg(*(F.max_by(F.col("delta")[f], F.when(F.col("delta")[f].isNotNull(), F.col(order))).alias(f) for f in fields))


def undone(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What a resumed run has still to do."""
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")


def write_lines(df: DataFrame, path: str, order: list[str]) -> None:
    """JSON lines in order over files and rows."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.json(path)


def write_report(df: DataFrame, path: str, title: str) -> None:
    """The rows of a small result as a Markdown table under a title, in one text file. Null is an empty cell."""
    cell = lambda c: F.regexp_replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), r"[|\n]", " ")
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, df.columns)), F.lit(" |"))
    head = [f"# {title}", "", f"| {' | '.join(df.columns)} |", f"|{' --- |' * len(df.columns)}"]
    lines = df.sparkSession.createDataFrame([(i, line) for i, line in enumerate(head)], "n long, value string")
    body = df.select(F.lit(len(head)).cast("long").alias("n"), row.alias("value"))
    lines.unionByName(body).coalesce(1).sortWithinPartitions("n", "value").select("value").write.text(path)
