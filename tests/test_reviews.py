"""Templates, clauses, search in redacted documents and partitions, on small rows."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.operators import redact, retrieval, templates
from granary.plugins import Refused, chosen_embedder, letter_embedder, service_embedder
from granary.sources import files


def test_templates(spark):
    kind = templates.TEMPLATES[1][0]
    rows = [
        (1, kind, "合同金额及付款方式 履约保证金 违约责任 争议解决方式 验收标准与程序 合同履行期限 保密条款"),
        (2, kind, "甲方放弃一切权利，以甲方意见为准"),
        (3, kind, None),
        (4, "none", "x"),
        (5, None, "x"),
        (6, "own", "ALPHA then beta, b before a"),
    ]
    own = [("own", "Own", [("alpha beta", "low", "-"), ("xyz abcdef, alpha", "low", "-")], ["b.*a", ".*then.*ALPHA", "beta"], ["alpha", "Beta"])]
    held = templates.registered(templates.store(spark), templates.store(spark, own))
    assert held.count() == 4
    found = {r["id"]: r for r in templates.compared(spark.createDataFrame(rows, "id int, template_type string, text string"), held).collect()}
    assert [len(found[1][c]) for c in ("missing", "extra", "wording")] == [0, 0, 0]
    assert found[1]["summary"] == "✅ 该条款与'政府采购合同必须条款'模板完全匹配"
    assert [(e["item"], e["flag"]) for e in found[2]["extra"]] == [("以.*意见为准", "unusual"), ("放弃.*权利", "unusual")]
    assert found[2]["summary"] == "⚠️ 缺失 7 项必须条款，发现 2 处可疑内容，6 处措辞差异"
    assert len(found[3]["missing"]) == 7 and found[3]["missing"][1]["severity"] == "medium"
    assert [found[i]["error"] for i in (3, 4, 5, 6)] == [None, "unknown template", "unknown template", None]
    assert found[4]["summary"] is None and found[4]["missing"] is None
    assert [m["item"] for m in found[6]["missing"]] == ["xyz abcdef, alpha"]
    assert [e["item"] for e in found[6]["extra"]] == ["b.*a", "beta"]
    assert [w["field"] for w in found[6]["wording"]] == ["alpha"]


def test_a_new_template_takes_the_place_of_its_type(spark):
    kind = templates.TEMPLATES[0][0]
    held = templates.registered(templates.store(spark), templates.store(spark, [(kind, "New", [], [], [])]))
    assert sorted(r["name"] for r in held.filter(F.col("template_type") == kind).collect()) == ["New"] and held.count() == 3


def test_phrases_like_a_search_part_by_part(spark):
    draw = random.Random(3)
    rows = [("".join(draw.choices("abc", k=draw.randrange(8))), ".*".join("".join(draw.choices("abc", k=draw.randrange(3))) for _ in range(draw.randrange(1, 4)))) for _ in range(300)]

    def plain(text, phrase):
        at = 0
        for part in phrase.split(".*"):
            at = text.find(part, at)
            if at < 0:
                return False
            at += len(part)
        return True

    found = spark.createDataFrame(rows, "t string, p string").select("t", "p", templates.has_phrase(F.col("t"), F.col("p")).alias("r")).collect()
    assert all(r["r"] == plain(r["t"], r["p"]) for r in found) and {r["r"] for r in found} == {True, False}


def test_clauses_and_their_texts(spark):
    chunks = spark.createDataFrame([("a", "指定品牌", ["one", "two", "x" * 50]), ("b", "目录", None), ("c", None, []), ("d", "plain", ["t"])], "chunk_id string, text string, path array<string>")
    made = templates.clauses(chunks)
    found = {r["chunk_id"]: r for r in made.collect()}
    assert [(found[i]["tier"]) for i in "abcd"] == ["L3", "L1", "L2", "L2"]
    assert found["a"]["text"] == "【two > " + "x" * 40 + "…】指定品牌" and found["b"]["text"] == "目录" and found["c"]["text"] == ""
    asked = spark.createDataFrame([("a",), ("a",), ("zz",), (None,)], "chunk_id string")
    texts = sorted((r["chunk_id"] or "", r["known"], r["text"] is None) for r in templates.with_texts(asked, made).collect())
    assert texts == [("", False, True), ("a", True, False), ("a", True, False), ("zz", False, True)]
    held = templates.compared(templates.with_texts(asked, made).withColumn("template_type", F.lit("none")), templates.store(spark))
    assert sorted(r["error"] for r in held.collect()) == ["unknown clause", "unknown clause", "unknown template", "unknown template"]


DOCS = [
    (1, "write to x@y.org\ncall 13812345678\nx@y.org again\nnothing here"),
    (2, "x@y.org is not known elsewhere\n[email_7] is text"),
    (3, ""),
]


def _searched(spark, queries, embed, **more):
    hidden = redact.redacted(spark.createDataFrame(DOCS, "doc_id long, text string"), "text")
    chunks = hidden.select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_id", "text"))
    asked = spark.createDataFrame(queries, "doc_id long, query_id int, query string")
    return chunks, asked, hidden.select("doc_id", "vault"), retrieval.redacted_search(chunks, asked, hidden.select("doc_id", "vault"), embed, **more)


def test_queries_share_the_placeholders_of_their_document(spark):
    queries = [(1, 1, "is x@y.org or z@y.org there?"), (2, 1, "z@y.org x@y.org"), (3, 1, None), (9, 1, "13912345678")]
    _, asked, vaults, _ = _searched(spark, queries, letter_embedder())
    found = {r["doc_id"]: r for r in retrieval.redacted_queries(asked, vaults).collect()}
    assert found[1]["hidden"] == "is [email_1] or [email_2] there?"
    assert found[2]["hidden"] == "[email_9] [email_8]" and found[3]["hidden"] == "" and found[9]["hidden"] == "[phone_1]"
    assert [e["value"] for e in found[1]["vault"] if e["label"] == "email"] == ["x@y.org", "z@y.org"]


def test_values_give_way_where_they_match(spark):
    """Equal characters elsewhere stay, in documents and in queries; a document's value keeps its placeholder."""
    texts = ["1391381234567800 and 13812345678", "euxtreenauxelleeux xeuxtreenauxelleeux", "ABCDEFGHJKLMNPQRTU13812345678\n13812345678"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    hidden = redact.redacted(docs, "text")
    assert [r["text"] for r in hidden.orderBy("doc_id").collect()] == ["[bank_1] and [phone_1]", "[credit_code_1] xeuxtreenauxelleeux", "ABCDEFGHJKLMNPQRTU[phone_1]\n[phone_1]"]
    queries = docs.select("doc_id", F.lit(0).alias("query_id"), F.concat("text", F.lit(" \u0002 13912345678")).alias("query"))
    found = retrieval.redacted_queries(queries, hidden.select("doc_id", "vault")).orderBy("doc_id").collect()
    assert [r["hidden"] for r in found] == ["[bank_1] and [phone_1] \u0002 [phone_2]", "[credit_code_1] xeuxtreenauxelleeux \u0002 [phone_1]", "ABCDEFGHJKLMNPQRTU[phone_1]\n[phone_1] \u0002 [phone_2]"]


def test_search_sees_redacted_texts_and_gives_restored_ones(spark):
    def service(texts):
        for t in texts:
            if re.search(r"@|\d{8}", t):
                raise ValueError(f"personal data: {t}")
        if len(texts) > 2:
            raise Refused("too many")
        return [[float(t.count(c)) for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts]

    remote = lambda text: chosen_embedder(service_embedder(service), letter_embedder(), text, F.lit(True)).getField("v")
    found = _searched(spark, [(1, 1, "x@y.org again"), (1, 2, "call"), (2, 1, "text"), (8, 1, "no chunks")], remote, k=2)[3].collect()
    assert {(r["doc_id"], r["query_id"]): r["text"] for r in found if r["rank"] == 1} == {(1, 1): "x@y.org again", (1, 2): "call 13812345678", (2, 1): "[email_7] is text"}
    assert sorted(r["rank"] for r in found) == [1, 1, 1, 2, 2, 2]
    assert all(r["snippet"] == r["text"][:200] for r in found)


@pytest.mark.parametrize("block", [50_000, 3])
def test_search_like_all_comparisons(spark, block, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK", block)
    draw = random.Random(5)
    text = lambda: "".join(draw.choices("abcd ", k=draw.randrange(6)))
    chunks = [(d, i, text()) for d, n in ((1, 40), (2, 3), (3, 1)) for i in range(n)]
    queries = [(d, q, text()) for d in (1, 2, 3, 4) for q in range(3)]
    wanted = set()
    for d, q, t in queries:
        vector = lambda s: np.array([s.count(c) for c in "abcd"], float)
        scored = []
        for d2, i, s in chunks:
            a, b = vector(t), vector(s)
            n = np.sqrt(a @ a) * np.sqrt(b @ b)
            if d2 == d:
                scored.append((-(a @ b / n if n else 0.0), i))
        wanted |= {(d, q, i, r + 1) for r, (_, i) in enumerate(sorted(scored)[:5])}
    none = spark.createDataFrame([], f"doc_id long, vault {redact.VAULT}")
    found = retrieval.redacted_search(spark.createDataFrame(chunks, "doc_id long, chunk_id int, text string"), spark.createDataFrame(queries, "doc_id long, query_id int, query string"), none, letter_embedder())
    assert {(r["doc_id"], r["query_id"], r["chunk_id"], r["rank"]) for r in found.collect()} == wanted


def test_partitions_are_replaced_and_others_stay(spark, tmp_path):
    path = str(tmp_path / "parts")
    rows = spark.createDataFrame([(i, i % 3, None if i % 2 else "a b/c=d") for i in range(12)], "id int, task int, kind string")
    files.replace_partitions(rows, path, ["task", "kind"])
    new = spark.createDataFrame([(100, 0, None), (101, 0, None)], "id int, task int, kind string")
    gone = spark.createDataFrame([(0, None), (1, "a b/c=d"), (7, "not there")], "task int, kind string")
    for _ in range(2):  # doing it again gives the same
        files.replace_partitions(new, path, ["task", "kind"], gone)
        found = {(r["id"], r["task"], r["kind"]) for r in files.read_partitions(spark, path, rows.schema).collect()}
        kept = {(r["id"], r["task"], r["kind"]) for r in rows.collect() if (r["task"], r["kind"]) not in {(0, None), (1, "a b/c=d")}}
        assert found == kept | {(100, 0, None), (101, 0, None)}


def test_a_write_that_fails_leaves_partitions_as_they_were(spark, tmp_path):
    path = str(tmp_path / "parts")
    rows = spark.range(20).selectExpr("id", "id % 2 AS task")
    files.replace_partitions(rows, path, ["task"])
    broken = spark.range(20).selectExpr("IF(id = 13, CAST(raise_error('lost') AS bigint), id + 100) AS id", "0L AS task")
    with pytest.raises(Exception, match="lost"):
        files.replace_partitions(broken, path, ["task"])
    assert sorted(r["id"] for r in files.read_partitions(spark, path, rows.schema).collect()) == list(range(20))
    files.replace_partitions(spark.range(3).selectExpr("id + 100 AS id", "0L AS task"), path, ["task"])
    assert sorted(r["id"] for r in files.read_partitions(spark, path, rows.schema).collect()) == [*range(1, 20, 2), 100, 101, 102]
