import hashlib
import json

from pyspark.sql import functions as F

from granary import plugins
from granary.operators import dedup, graph, measures, ordered, relational, rules, structure, vector
from granary.sources import files
from granary.streaming import events as stream


def test_classes_of_common_keys(spark):
    df = spark.createDataFrame([(i, "hot") for i in range(50)] + [(1, "k"), (2, "k"), (2, "k"), (3, "alone")], "item long, key string")
    found = graph.same_key_classes(df, "item", "key")
    assert found.filter("key = 'hot'").count() == 50 and found.filter("key = 'alone'").count() == 0
    assert {tuple(r) for r in found.filter("key = 'k'").collect()} == {("k", 1, 2, 1), ("k", 2, 2, 1)}
    edges = graph.class_edges(found, "item", "key")
    assert edges.count() == 50 * 49 and edges.filter("src = 1 and dst = 2").count() == 1


def test_many_queries_are_searched_in_blocks(spark):
    df = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(60)], "vec_id long, embedding array<float>")
    q = df.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    one = sorted(map(tuple, vector.search(df, q, 3).select("query_id", "rank", "vec_id").collect()))
    assert sorted(map(tuple, vector.search(df, q, 3, max_queries=7).select("query_id", "rank", "vec_id").collect())) == one and len(one) == 180


def test_keep_first_keeps_nulls_and_short_texts(spark):
    df = spark.createDataFrame([(1, "k", "a" * 30), (2, "k", "a" * 30), (3, None, "a" * 30), (4, None, "a" * 30), (5, "k", None), (6, "k", None), (7, "k", "ab"), (8, "k", "ab")], "o long, k string, t string")
    assert sorted(r["o"] for r in dedup.keep_first(df, ["k"], "t", "o").collect()) == [1, 3, 5, 6, 7, 8]


def test_critical_metrics(spark):
    rows = [("g", "p", True, True, "重大", "High"), ("g", "p", True, False, "high", "高"), ("g", None, True, None, "high", None), (None, "p", None, True, None, "low"), ("g", "p", False, False, "low", "低风险")]
    df = spark.createDataFrame(rows, "g string, p string, gc boolean, pc boolean, gs string, ps string")
    c = F.col
    found = measures.critical_metrics(df, c("g").isNotNull(), c("p").isNotNull(), c("gc"), c("pc"), c("gs"), c("ps")).first()
    assert tuple(found) == (3, 0.6667, 0.3333, 0.5, 0.3333, 0.6667)
    types = spark.createDataFrame([("A01_BRAND", "brand", "x", "", []), ("A01_X", "B2_Y", "品牌 锁定", "品牌锁定问题", []), ("P", "Q", "R", "one two", ["TWO"]), ("P", "Q", "R", None, ["TWO"])], "gc string, pc string, gt string, pt string, al array<string>")
    assert [r[0] for r in types.select(measures.type_matches(c("gc"), c("pc"), c("gt"), c("pt"), c("al"))).collect()] == [True, True, True, False]


def test_findings_are_normalised(spark):
    rows = [("BRAND_LOCK", "x", "仅接受指定品牌", False, "low"), ("A01_BRAND_LOCK", "x", "普通文字", False, "high"), ("BRAND_LOCK", "x", "仅接受指定品牌", True, "info"), ("", "", "", False, "high")]
    df = spark.createDataFrame(rows, "category_code string, risk_type string, source_quote string, no_risk boolean, severity string")
    found = rules.normalised_findings(df).collect()
    assert [r["is_critical"] for r in found] == [True, False, False, False]
    assert found[0]["severity"] == "high" and "BRAND_LOCK" in found[0]["critical_reason"] and found[1]["critical_reason"] == "" and found[1]["severity"] == "high"


def test_parent_and_boundary(spark):
    df = spark.createDataFrame([(1, i, lv) for i, lv in enumerate([1, 2, 3, 2, 1])], "d long, o long, level int")
    up = {r["o"]: r["parent"] for r in ordered.parent(df, ["d"], "o", "level", 3).collect()}
    assert up == {0: None, 1: 0, 2: 1, 3: 0, 4: None}
    end = {r["o"]: r["boundary"] for r in ordered.next_boundary(df, ["d"], "o", "level", 3).collect()}
    assert end == {0: 4, 1: 3, 2: 3, 3: 4, 4: None}


def test_sections_and_chunks(spark):
    text = "第一章 总则\n前言文字\n1. 范围\n适用本项目\n2. 要求\n" + "长" * 2000
    docs = spark.createDataFrame([(7, text), (8, "没有标题的文字行"), (9, "")], "doc_id long, text string")
    found = structure.paths(structure.sections(structure.lines(docs)))
    by = {(r["doc_id"], r["title"]): r for r in found.collect()}
    assert by[7, "1. 范围"]["path"] == ["第一章 总则", "1. 范围"] and by[7, "第一章 总则"]["body"] == "前言文字"
    chunks = structure.chunks(found).collect()
    assert {r["doc_id"] for r in chunks} == {7, 8}
    assert all(len(r["text"]) <= 1500 for r in chunks if r["kind"] == "split")
    for parts in (1, 5):
        again = structure.chunks(found.repartition(parts)).collect()
        assert sorted(map(str, again)) == sorted(map(str, chunks))


def test_stitched_tables(spark):
    rows = [(1, 1, 0, [["h", "x"], ["a", "1"]]), (1, 2, 0, [["b", "2"]]), (1, 3, 0, [["b", "3"]]), (1, 5, 0, [["c", "4"]])]
    found = structure.stitched_tables(spark.createDataFrame(rows, "d long, page int, idx int, rows array<array<string>>"), "d", "page", "rows")
    assert sorted((r["first_page"], r["last_page"], len(r["rows"])) for r in found.collect()) == [(1, 2, 3), (3, 3, 1), (5, 5, 1)]


def test_search_is_exact(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.6, 0.8]), (2, [0.0, 0.0]), (3, [2.0, 0.0])], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, q array<float>")
    assert [r["vec_id"] for r in vector.search(df, q, 3).orderBy("rank").collect()] == [0, 3, 1]


def test_jsonl_and_manifest(spark, tmp_path):
    (tmp_path / "a.jsonl").write_bytes("﻿{\"x\": 1}\n\n{broken\n".encode())
    from pyspark.sql.types import LongType, StructField, StructType

    found = files.read_jsonl(spark, str(tmp_path / "a.jsonl"), StructType([StructField("x", LongType())])).collect()
    assert [r["x"] for r in found] == [1, None] and found[1]["_corrupt_record"] == "{broken"
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "one.bin").write_bytes(b"1")
    (tmp_path / "f" / "new.bin").write_bytes(b"2")
    manifest = spark.createDataFrame([("one.bin", hashlib.sha256(b"1").hexdigest()), ("gone.bin", "x")], "name string, sha256 string")
    assert {r["name"]: r["status"] for r in files.verify_manifest(spark, str(tmp_path / "f"), manifest).collect()} == {"one.bin": "ok", "gone.bin": "missing", "new.bin": "extra"}


def test_vectors_round_trip(spark, tmp_path):
    (tmp_path / "v.bin").write_bytes(files.pack_vectors([[1.0, 2.0], [3.0, 4.0]]))
    assert [r["embedding"] for r in files.read_vectors(spark, str(tmp_path / "v.bin"), 2).orderBy("row").collect()] == [[1.0, 2.0], [3.0, 4.0]]


def test_dead_letters(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(2):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps({"x": i}))
    source = spark.readStream.schema("x long").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))

    def work(rows):
        return rows.select(F.assert_true(F.col("x") != 1).alias("a"), "x")

    stream.consume(source, work, str(tmp_path / "out"), str(tmp_path / "dead"), str(tmp_path / "check"))
    assert [r["x"] for r in spark.read.parquet(str(tmp_path / "dead")).collect()] == [1]
    good = [r["x"] for r in spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "out")).collect()]
    assert good == [0]


def test_plugins(spark):
    df = spark.createDataFrame([("c1", "投标保证金为5%"), ("c2", "x")], "chunk_id string, text string")
    assert [(r["chunk_id"], r["agent"]) for r in plugins.rule_reviewer(df).collect()] == [("c1", "ProcedureAgent")]
    v = df.select(plugins.hashed_embedder(8)(F.col("text")).alias("v")).collect()
    assert all(abs(sum(x * x for x in r["v"]) - 1) < 1e-5 for r in v)
    corpus = spark.createDataFrame([("u1", "About X things"), ("u2", "none")], "url string, text string")
    assert plugins.corpus_searcher(corpus)(spark.createDataFrame([("X things!",)], "query string")).first()["urls"] == ["u1"]
    tools = plugins.Tools()
    tools.register("a", len)
    assert tools.only("a")("a", [1, 2]) == 2


def test_folds(spark):
    df = spark.createDataFrame([(1, 5, "open"), (1, 9, "closed"), (2, None, "open")], "k long, p int, s string")
    assert {r["k"]: r["p"] for r in relational.progress_fold(df, "k", "p", "s", ["open"]).collect()} == {1: 5, 2: 0}
