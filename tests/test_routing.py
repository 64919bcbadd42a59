"""Routing by any number of words, reference ids, names of traces, files and small rules that had no test."""

import datetime
import json
import random

from pyspark.sql import functions as F

from granary.functions import jsonx
from granary.functions import text as T
from granary.operators import measures, ordered, review, rules
from granary.sources import files
from granary.streaming import events


def test_any_number_of_words(spark):
    r = random.Random(1)
    words = list({"".join(r.choice("abcdef") for _ in range(r.randint(3, 6))) for _ in range(3000)})
    table = [(f"a{i % 40}", w.upper() if i % 3 else w) for i, w in enumerate(words)] + [(None, "x"), ("z", None)]
    texts = [(i, "".join(r.choice("abcdefG ") for _ in range(r.randint(0, 40)))) for i in range(100)] + [(200, None), (201, "")]
    wanted = {(i, a) for i, t in texts for a in ({a for a, w in table if a and w and t and w.lower() in t.lower()} or {"none"})}
    clauses, routing = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(table, "agent string, word string")
    for most in (10_000, 500):
        assert {tuple(x) for x in rules.route(clauses, routing, "id", "text", "none", most).collect()} == wanted
    everywhere = rules.route(clauses, spark.createDataFrame([("all", "")], "agent string, word string"), "id", "text", "none")
    assert {tuple(x) for x in everywhere.collect()} == {(i, "none" if t is None else "all") for i, t in texts}


def test_reference_ids(spark):
    rows = [("see [b_1_2] and [b_3_4], [b_1_2]", json.dumps([{"block_id": "b_3_4"}, {"block_id": "b_9_9"}, {}])), (None, "[{\"block_id\": \"b_1_1\"}]"), ("[b_5_5]", "no json"), (None, None)]
    found = spark.createDataFrame(rows, "a string, g string").select(jsonx.reference_ids(F.col("a"), F.col("g")).alias("ids")).collect()
    assert [x["ids"] for x in found] == [["b_1_2", "b_3_4", "b_9_9"], ["b_1_1"], ["b_5_5"], []]


def test_trace_names(spark):
    rows = [("a", "c1"), ("a", None), ("", "c2"), (None, "c1"), ("b", "")]
    assert {tuple(x) for x in measures.trace_names(spark.createDataFrame(rows, "agent string, clause string"), "agent", "clause").collect()} == {("agents", "a"), ("agents", "b"), ("clauses", "c1"), ("clauses", "c2")}


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "ä", ["x", "y"]), (2, None, None)], "k long, t string, l array<string>")
    files.write_jsonl(df, f"{tmp_path}/j")
    assert sorted(json.loads(x)["k"] for p in tmp_path.glob("j/part*") for x in p.read_text().splitlines()) == [1, 2]
    files.write_csv(df, f"{tmp_path}/c")
    parts = [p.read_bytes() for p in tmp_path.glob("c/part*.csv")]
    assert parts and all(p.startswith(b"\xef\xbb\xbf") for p in parts)
    assert {x for p in parts for x in p.decode("utf-8-sig").splitlines()[1:]} == {"1,ä,x|y", "2,,"}


def test_unpack(spark):
    lines = spark.createDataFrame([("event: done\ndata: {\"x\": 1}",), ('{"type": "phase", "data": {"m": 2}}',), ('{"type": "bare"}',)], "value string")
    assert [tuple(x) for x in events.unpack(lines).collect()] == [("done", '{"x": 1}'), ("phase", '{"m":2}'), ("bare", '{"type": "bare"}')]


def test_reconciled(spark):
    assert [x["k"] for x in events.reconciled(spark.createDataFrame([(1,), (2,)], "k long"), spark.createDataFrame([(1,)], "k long"), "k").collect()] == [2]


def test_actionable_and_triage(spark):
    rows = [(True, None, "high", False, False), (False, "", "high", True, False), (False, "short", "high", False, False), (False, "short", "high", True, False), (False, "q" * 30, "info", False, True), (False, "q" * 30, "low", False, True)]
    found = spark.createDataFrame(rows, "n boolean, q string, s string, m boolean, g boolean").select(rules.actionable(F.col("n"), F.col("q"), F.col("s"), F.col("m"), F.col("g")).alias("x")).collect()
    assert [x["x"] for x in found] == [True, False, False, True, False, True]
    marked = spark.createDataFrame([("r1", "low", 0.9, None), ("r2", "high", 0.1, "finding"), ("r3", "high", 0.8, ""), ("r4", "high", 1.0, "hypothesis")], "risk_id string, severity string, confidence double, finding_role string")
    assert [x["risk_id"] for x in rules.triage(marked).collect()] == ["r3", "r2", "r1"]


def test_rates_and_times(spark):
    one = spark.range(1)
    assert one.select(measures.dedup_rate(F.lit(8), F.lit(6))).first()[0] == 0.25
    assert "《" not in one.select(review.law_query(F.lit("《法》[第一条](http://x)"))).first()[0]
    found = one.select(T.timestamp_or(F.lit("2024-05-06 07:08:09"), F.lit("2020-01-01").cast("timestamp")).alias("a"), T.timestamp_or(F.lit("never"), F.lit("2020-01-01").cast("timestamp")).alias("b")).first()
    assert found["a"] == datetime.datetime(2024, 5, 6, 7, 8, 9) and found["b"].year == 2020
