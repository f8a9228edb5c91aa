import json

from pyspark.sql import functions as F

from palimpsest.schemas import SCHEMAS, migrated
from palimpsest.sources import corpus, files


def test_corpus_places_every_item_and_round_trips(spark, tmp_path):
    planted = [("S01", 3, "F1", "fact", "one"), ("S01", 3, "F2", "fact", "two"), ("S01", 3, "E1", "event", "three"), ("S02", 30, "E2", "event", "four"), ("S02", 30, "E3", "event", "five")]
    p = spark.createDataFrame(planted, "session string, turn int, planted_id string, kind string, text string")
    c = corpus.generate(spark, p)
    assert c.count() == 720 and c.where("planted_id IS NOT NULL").count() == 5 and c.select("seq").distinct().count() == 720
    assert {r.planted_id: (r.session, r.turn) for r in c.where("planted_id IS NOT NULL").collect()} == {"E1": ("S01", 3), "F1": ("S01", 4), "F2": ("S01", 5), "E2": ("S02", 29), "E3": ("S02", 30)}
    files.write_lines(c, str(tmp_path / "c"), ["seq"])
    again = files.read_corpus(spark, str(tmp_path / "c"))
    assert again.schema.names == SCHEMAS["corpus"].names and again.exceptAll(c.select(*SCHEMAS["corpus"].names)).count() == 0
    share = c.where(F.col("kind").startswith("hard_neg")).count() / 715
    assert 0.15 < share < 0.26


def test_yaml_answers_and_markdown(spark, tmp_path):
    (tmp_path / "l.yaml").write_text("facts:\n  - {id: F1, text: t, predicate: p, object: o, at: {session: S01, turn: 2}, importance: 1}\n  - {id: F2}\n")
    f = files.read_yaml(spark, str(tmp_path / "l.yaml"), "facts", files.FACT).orderBy("id").collect()
    assert f[0].at.turn == 2 and f[0].importance == 1.0 and f[1].at is None
    (tmp_path / "r.json").write_text(json.dumps({"oracle": [{"id": "Q1", "ok": True}, {"id": "Q2", "ok": None}], "none": []}))
    a = files.read_answers(spark, str(tmp_path / "r.json"))
    assert [(r.arm, r.id, r.ok) for r in a.orderBy("id").collect()] == [("oracle", "Q1", True), ("oracle", "Q2", None)]
    (tmp_path / "d").mkdir()
    (tmp_path / "d/S03.md").write_text("# head\n**1. A**  hello  ← `F001` more\n**2. B**  bye\n")
    (tmp_path / "d/skip.md").write_text("x")
    m = files.read_markdown(spark, str(tmp_path / "d"), ("skip.md",))
    assert [tuple(r) for r in files.parse_session(m).orderBy("n").collect()] == [("S03.md", 1, "A", "hello", "F001"), ("S03.md", 2, "B", "bye", None)]


def test_logs_and_resuming(spark):
    log = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, n int, v string")
    assert sorted(r.v for r in files.latest(log, ["k"], ["n"]).collect()) == ["y", "z"]
    assert files.undone(log, log.where("n = 2"), ["k", "n"]).count() == 2
    d = spark.createDataFrame([("c", 1, {"stage": "cold", "evil": "x"}), ("c", 2, {"affinity": "3"}), ("c", 3, {"stage": "warm"})], "chat string, seq long, delta map<string,string>")
    assert tuple(files.last_state(d, ["stage", "affinity"]).first()) == ("c", "warm", "3")


def test_migration_adds_columns_once(spark):
    old = spark.createDataFrame([(1, "c")], "event_id long, chat string")
    new = migrated(migrated(old, "event", 1), "event", 1)
    assert new.columns == ["event_id", "chat", "mention_count", "dedup_key"] and new.first().mention_count == 1


def test_report_is_a_table(spark, tmp_path):
    d = spark.createDataFrame([("a", 1.5), ("b|c", None)], "arm string, recall double")
    files.write_report(d, str(tmp_path / "report"), "Arms")
    assert [r.value for r in spark.read.text(str(tmp_path / "report")).collect()] == ["# Arms", "", "| arm | recall |", "| --- | --- |", "| a | 1.5 |", "| b c |  |"]
