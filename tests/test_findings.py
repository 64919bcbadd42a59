import random

import pytest
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.operators import findings, graph, structure

FINDING = "doc long, cat string, o long, clause_ids array<string>, source_quote string, confidence double, agent string, reason string, suggestion string, severity string, legal_basis array<string>, hypothesized_by array<string>, verified_by array<string>, is_critical boolean, critical_reason string"


def row(doc, cat, o, clauses, quote, confidence=0.5, agent="x", critical=False, laws=(), reason="r"):
    return (doc, cat, o, clauses, quote, confidence, agent, reason, f"s{o}", "low", list(laws), None, [agent], critical, f"c{o}" if critical else None)


def test_likeness_is_the_columns(spark):
    texts = ["", None, "ab", "评审因素", "评审 因素", "2024年1月2日开标，地点另定", "[日期]开标，地点另行通知", "abc-def ghi", "ABC def ghi jkl", "  abc-def ghi ", "x²³½ Ⅷ a", "a　b c d e"]
    df = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    for r in df.select("a", "b", T.evidence_similarity(F.col("a"), F.col("b")).alias("s")).collect():
        assert r["s"] == pytest.approx(findings.likeness(r["a"], r["b"])), (r["a"], r["b"])


def test_merged_fields(spark):
    rows = [
        row(1, "A", 1, ["c1"], "指定品牌为某某牌", 0.5, "scout", laws=["L1"], reason="one"),
        row(1, "A", 2, ["c1", "c2"], "指定品牌为某某牌，型号九", 0.9, "brand", True, ["L1", "L2"], "two"),
        row(1, "A", 3, ["c2"], "指定品牌为某某牌", 0.6, "legal", laws=["L3"]),
        row(1, "A", 4, ["c9"], "指定品牌为某某牌"),
        row(1, "B", 5, ["c1"], "指定品牌为某某牌"),
        row(2, "A", 6, ["c1"], "指定品牌为某某牌"),
        row(2, "A", 7, None, None, None), row(2, "A", 8, None, None, None),
        row(None, "A", 9, ["c1"], "指定品牌为某某牌"), row(None, "A", 10, ["c1"], "指定品牌为某某牌"),
    ]
    found = {r["o"]: r for r in findings.merge_findings(spark.createDataFrame(rows, FINDING), ["doc", "cat"], "o").collect()}
    assert sorted(found) == [1, 4, 5, 6, 7, 8, 9] and found[9]["merged"] == [10]
    one = found[1]
    assert one["merged"] == [2, 3] and one["clause_ids"] == ["c1", "c2"] and one["verified_by"] == ["scout", "brand", "legal"] and one["legal_basis"] == ["L1", "L2"]
    assert one["confidence"] == 0.9 and one["suggestion"] == "s2" and one["reason"] == "one\n\n[补充验证 — brand]: two"
    assert one["is_critical"] and one["severity"] == "high" and one["critical_reason"] == "c2"
    assert findings.merge_findings(spark.createDataFrame([], FINDING), ["doc", "cat"], "o").count() == 0


def test_merge_against_all_comparisons(spark):
    dice = random.Random(5)
    words = [dice.choice("abcdefgh") * dice.randint(1, 3) for _ in range(12)]
    rows = [row(dice.randint(0, 3), dice.choice("AB"), o, dice.sample(["c1", "c2", "c3", "c4"], dice.randint(1, 2)), " ".join(words[k] for k in sorted(dice.sample(range(12), 9)))) for o in range(240)]

    def stage(items, least):
        heads = []
        for clauses, quote, ids in items:
            head = next((h for h in heads if h[0] & clauses and findings.likeness(h[1], quote) >= least), None)
            if head is None:
                heads.append([set(clauses), quote, list(ids)])
            else:
                head[0] |= clauses
                head[2] += ids
        return heads

    wanted = set()
    for key in {(r[0], r[1]) for r in rows}:
        items = [(set(r[3]), r[4], [r[2]]) for r in rows if (r[0], r[1]) == key]
        wanted |= {tuple(h[2]) for h in stage(stage(items, 0.70), 0.65)}
    found = {(r["o"], *r["merged"]) for r in findings.merge_findings(spark.createDataFrame(rows, FINDING).repartition(5), ["doc", "cat"], "o").collect()}
    assert found == wanted and len(found) < 230


def test_relevant_results(spark):
    good = "政府采购案例说明与投诉处理"
    rows = [(q, i, u, s) for q in ("many", None) for i, (u, s) in enumerate([("http://a/", good), ("http://x.gov.cn/", "0123456789"), ("http://apple.com/", good), ("http://a/", "短"), ("http://a/", "plain words here"), (None, "government rules"), ("http://a/", None)])]
    rows += [("few", i, "http://reddit.com/", None) for i in range(5)]
    found = findings.relevant_results(spark.createDataFrame(rows, "q string, i int, u string, s string"), "q", "u", "s").collect()
    assert sorted(r["i"] for r in found if r["q"] == "many") == [0, 1, 5] == sorted(r["i"] for r in found if r["q"] is None)
    assert sum(r["q"] == "few" for r in found) == 5


def test_small_rules(spark):
    c = F.col
    df = spark.createDataFrame([("程序违规", "★要求资质与认证，品牌不限", '{"risk_id": null}'), ("x", "无", '{"risk_id": 1, "issueNo": 2}'), ("需求不清", None, None)], "k string, t string, j string")
    found = df.select(findings.search_template(c("k")).alias("a"), findings.clause_keywords(c("t")).alias("b"), findings.is_finding(c("j")).alias("c")).collect()
    assert [tuple(r) for r in found] == [("政府采购 招标程序 合规要求 违规案例", "★ 品牌 认证", True), (None, "", False), ("政府采购 采购需求 明确性 规范性要求", "", False)]
    heads = spark.createDataFrame([("heading", " 12 \n采购需求\nx"), ("heading", "长" * 31), ("paragraph", "采购需求"), ("heading", "")], "k string, t string").select(T.plain_heading(c("k"), c("t")).alias("h")).collect()
    assert [r["h"] and tuple(r["h"]) for r in heads] == [("采购需求", "plain_heading", 5), None, None, None]


def test_sections_and_tables(spark, tmp_path):
    s = spark.createDataFrame([(1, True), (2, False), (2, False), (5, True)], "level int, loose boolean")
    one = structure.section_statistics(s, orphan=F.col("loose")).first()
    assert (one["total"], one["levels"], one["orphans"]) == (4, {1: 1, 2: 2, 5: 1}, 2)
    assert tuple(structure.section_statistics(s.limit(0)).first()) == (0, {}, 0)
    blocks = [(0, 0, "p", "a|b"), (0, 1, "p", " c | "), (0, 2, "p", "x|y|z"), (0, 3, "p", "no"), (0, 4, "p", "1|2"), (0, 5, "h", "3|4"), (0, 6, "p", "5|6"), (0, 7, "p", "7|8"), (1, 0, "p", None)]
    df = spark.createDataFrame(blocks, "page int, o int, k string, t string").withColumn("k", F.when(F.col("k") == "p", "paragraph").otherwise("heading"))
    known = spark.createDataFrame([(0, 3)], "page int, tables int")
    found = structure.pipe_tables(df, ["page"], "o", "t", "k", known=known).orderBy("table").collect()
    assert [(r["page"], r["table"], r["first"], r["last"], r["rows"]) for r in found] == [(0, 3, 0, 1, [["a", "b"], ["c", None]]), (0, 4, 6, 7, [["5", "6"], ["7", "8"]])]
    graph.snapshot(str(tmp_path / "g"), nodes=s, edges=df)
    assert graph.read_snapshot(spark, str(tmp_path / "g"), "nodes", "edges")["edges"].count() == len(blocks)
    order = graph.tree_order(spark.createDataFrame([("重庆", 1), ("安徽", 1), ("北京", 2)], "title string, n int"), "n", "title").collect()
    assert [r["title"] for r in order] == ["北京", "安徽", "重庆"]


def test_injection_chunks(spark):
    hits = [("d1", "q1", 1, "far", "nothing", 8), ("d1", "q1", 2, "page", "nothing", 3), ("d1", "q1", 3, "quote", "必须 指定品牌 甲", 9), ("d1", "q2", 1, "before", "-", 2), ("d2", "q1", 1, "z", "nothing", 50), ("d1", "q3", 1, "quote", "指定\n品牌", 0)]
    shape = "document_id string, query string, rank int, chunk_id string, snippet string, page_start int"
    gold = spark.createDataFrame([("d1", 4, "指定品牌"), ("d2", 9, "x"), ("d3", 1, None)], "document_id string, page_number int, source_quote string")
    back = spark.createDataFrame([("d2", "f", 2, "late", "文件编号 d2 补充条款", 0), ("d2", "f", 1, "soon", "补充条款 d 2", 0), ("d1", "f", 1, "no", "d1补充条款", 0)], shape)
    found = findings.injection_chunks(spark.createDataFrame(hits, shape), gold, back)
    assert sorted(tuple(r) for r in found.collect()) == [("d1", "before"), ("d1", "page"), ("d1", "quote"), ("d2", "soon")]


def test_summaries_and_counts(spark):
    rows = [(1, 2, "verified", "high", "品牌指定", 0.9, "b", [], ["L1", "L2"]), (1, 1, "hypothesis", "low", "其他", 0.456, "a", ["V"], [])]
    df = spark.createDataFrame(rows, "k long, o int, finding_role string, severity string, risk_type string, confidence double, reason string, verification_required array<string>, legal_basis array<string>")
    found = {r["k"]: r["summary"] for r in findings.summaries(spark.createDataFrame([(1,), (2,)], "k long"), df, "k", "o").collect()}
    assert found[1] == "- [Scout 假设, 待验证] [low] 其他 (confidence=0.46): a\n  🔍 建议搜索验证: V\n- [已验证] [high] 品牌指定 (confidence=0.90): b\n  法规依据: L1, L2" and found[2] == "（无）"
    flags = spark.createDataFrame([(True, True), (False, True), (None, None), (False, False)], "r boolean, m boolean")
    assert tuple(findings.process_counts(flags, F.col("r"), F.col("m")).first()) == (4, 2, 1, 1)


def test_links_count_items_that_are_there(spark):
    """A class needs two items that aren't null and two agents, as in SQL; the rows are not joined with themselves."""
    rows = [(1, 10, 1), (1, None, 2), (2, 20, 1), (2, 21, 2), (2, None, None), (3, 30, 1), (3, 31, 1), (3, 32, None), (None, 40, 1), (None, 41, 2)]
    found = graph.links_of_several(spark.createDataFrame(rows, "k int, i int, a int"), "i", "k", "a")
    assert {tuple(r) for r in found.collect()} == {(2, 20, 2, 20), (2, 21, 2, 20), (2, None, 2, 20)}
    assert "LeftSemi" not in found._jdf.queryExecution().optimizedPlan().toString()
