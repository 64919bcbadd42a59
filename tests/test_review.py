import pytest
from pyspark.sql import functions as F

from granary.operators import review


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "n"), [("第二十条", 20), ("第二十三条", 23), ("第一百零五条", 105), ("第87条", 87), ("第十条", 10), ("无", None)])
def test_article(spark, text, n):
    assert one(spark, review.article(F.lit(text))) == n


@pytest.mark.parametrize(("law", "known"), [("《政府采购法》第二十二条", True), ("政府采购法第99条", False), ("[政府采购法实施条例](http://x)", True), ("民法典第1条", None), ("招标投标法实施条例第80条", True)])
def test_known_law(spark, law, known):
    assert one(spark, review.known_law(F.lit(law))) == known


def test_laws(spark):
    held = lambda laws, x: one(spark, review.laws_hold(F.array(*(F.lit(v) for v in laws)), F.lit(x), F.lit(True)))
    assert held(["政府采购法第22条"], 0.8) and not held(["政府采购法第22条"], 0.5) and not held(["民法典"], 0.9) and not held(["政府采购法第22条", "招标投标法第90条"], 0.9)
    assert one(spark, review.law_references(F.lit("依据《政府采购法》第二十二条和财政部令第八十七号，〔2020〕46号"))) == ["第二十二条", "《政府采购法》第二十二条", "依据《政府采购法》第二十二条和财政部令第八十七号", "〔2020〕46号"]
    assert tuple(one(spark, review.domain(F.lit("指定品牌"), F.array(F.lit("第二十二条")))))[:1] == ("brand",)


def test_obligations(spark):
    df = spark.createDataFrame([(1, "供应商必须具有资质证书，否则投标无效。保修三年服务响应。短"), (2, "")], "k long, t string")
    found = {(r["type"], r["starred"], r["consequence"]) for r in review.obligations(df, "k", "t").collect()}
    assert ("资质", False, "投标无效") in found and ("售后", False, None) in found and all(t != "工期" for t, _, _ in found)


def test_references(spark):
    refs = spark.createDataFrame([(1, "附件三"), (1, "第九章"), (1, "附表")], "d long, r string")
    clauses = spark.createDataFrame([(1, 1, "附件三 清单"), (1, 2, "附表一 与 附表二"), (1, 3, "附表三"), (2, 4, "第九章")], "d long, k long, t string")
    assert {r["r"]: r["status"] for r in review.resolve_references(refs, clauses, "d", "r", "k", "t").collect()} == {"附件三": "valid", "第九章": "dangling", "附表": "ambiguous"}
    assert one(spark, review.reference_type(F.lit("附件三"))) == "attachment"


def test_timeline(spark):
    dates = spark.createDataFrame([(1, "公告", "2024-01-01", "announcement"), (1, "截止", "2024/01/11", "deadline"), (1, "开标", "2024-01-10", "opening")], "case_id long, label string, date_str string, event_type string")
    limits = spark.createDataFrame([(1, "公告", "截止", 20, None), (1, "公告", "开标", None, None), (1, "公告", "中标", 1, 2)], "case_id long, `from` string, `to` string, min_days int, max_days int")
    assert {r["to"]: (r["days"], r["status"]) for r in review.timeline(dates, limits).collect()} == {"截止": (10, "fail"), "开标": (9, "uncertain"), "中标": (None, "uncertain")}
    assert [(r["a_label"], r["b_label"]) for r in review.timeline_conflicts(dates).collect()] == [("开标", "截止")]
    assert review.inferred_constraints(dates, limits).count() == 0
    assert [r["min_days"] for r in review.inferred_constraints(dates, limits.filter("max_days = 2")).collect()] == [20]


def test_places(spark):
    chunks = spark.createDataFrame([(1, "c", ["b2", "none", "b1"])], "doc_id long, chunk_id string, source_block_ids array<string>")
    blocks = spark.createDataFrame([(1, "b1", 1, 0.5), (1, "b2", 2, 0.7)], "doc_id long, block_id string, page int, bbox double")
    assert [x["block_id"] for x in review.block_places(chunks, blocks).first()["bbox_refs"]] == ["b2", "b1"]
    tables = spark.createDataFrame([(1, "t", 3, [["a", "b"], ["", "c"]])], "doc_id long, table_id string, page int, rows array<array<string>>")
    sections = spark.createDataFrame([(1, 0, 1, 1, 9), (1, 1, 2, 3, 4), (1, 2, 2, 3, 3)], "doc_id long, sec_idx int, level int, page_start int, page_end int")
    assert review.tables_in_sections(tables, sections).first()["sec_idx"] == 1
    texts = spark.createDataFrame([(1, 2, 3, "a and c")], "doc_id long, page_start int, page_end int, text string")
    assert tuple(review.cell_retention(tables, texts).first())[2:] == (3, 2, "partial")


def test_scope_and_hypotheses(spark):
    gold = spark.createDataFrame([("d", 3, "quote one")], "document_id string, page_number int, source_quote string")
    found = spark.createDataFrame([("d", 3, "x"), ("d", 9, "a Quote one b"), ("d", 9, "other"), ("e", 3, "x")], "document_id string, page_number int, source_quote string")
    assert sorted(r["source_quote"] for r in review.in_scope(found, gold).collect()) == ["a Quote one b", "x"]
    h = spark.createDataFrame([("A", ["1", "2"], "X"), ("B", ["1"], "Y")], "category_code string, clause_ids array<string>, agent string")
    v = spark.createDataFrame([("r", "A", ["2"])], "risk_id string, category_code string, clause_ids array<string>")
    assert review.verified_hypotheses(h, v).first()["hypothesized_by"] == ["X"]


def test_text_forms(spark):
    from granary.functions import text as T
    from granary.operators import measures, structure

    assert one(spark, T.inline_headings(F.lit("(一)1.甲(二)2、乙"))) == ["(一)", "1.甲(二)", "2、乙"]
    long = "关于本项目投标文件递交与开标的若干具体要求说明以及"
    assert one(spark, T.truncated_title(F.lit(long), F.lit("其他事项。正文"))) == long + "其他事项。"
    assert one(spark, T.truncated_title(F.lit("短标题"), F.lit("正文。"))) == "短标题"
    assert [tuple(x) for x in one(spark, T.markdown_sections(F.lit("# A\nx\n## B\ny\nz")))] == [(1, "A", "x"), (2, "B", "y\nz")]
    assert tuple(one(spark, T.path_anomalies(F.array(F.lit("未归类"), F.lit("x" * 51))))) == (True, True)
    heads = spark.createDataFrame([(1, i, 3, f"（{c}）句子。") for i, c in enumerate("一二三")] + [(1, 9, 1, "第一章"), (1, 10, 3, "（四）句。")], "doc_id long, ord long, level int, title string")
    assert structure.pseudo_headings(heads).count() == 3
    rows = spark.createDataFrame([(i,) for i in range(1, 8)], "i long")
    assert [r["split"] for r in measures.splits(rows, "i", 3, 2).orderBy("i").collect()] == ["train"] * 3 + ["dev"] * 2 + ["test"] * 2
    kinds = spark.createDataFrame([(0, "a"), (1, "b")], "n long, v string")
    assert [r["v"] for r in measures.paired(rows, "i", kinds, "n").orderBy("i").collect()] == list("bababab")
    assert tuple(measures.marks(rows, big=F.col("i") > 5).first()) == (7, 2, True)


def test_follow_ups(spark):
    known = spark.createDataFrame([("c", "A", "some words")], "chunk_id string, category_code string, source_quote string")
    new = spark.createDataFrame([("c", "A", "Some Words here"), ("c", "B", "some words"), ("d", "A", "some words")], known.schema)
    assert sorted((r["chunk_id"], r["category_code"]) for r in review.same_finding(new, known).collect()) == [("c", "B"), ("d", "A")]
    clauses = spark.createDataFrame([(i,) for i in range(4)], "k long")
    reviews = spark.createDataFrame([(0,), (0,), (1,)], "k long")
    assert [(r["k"], r["why"]) for r in review.follow_ups(clauses, reviews, "k").collect()] == [(2, "unreviewed"), (3, "unreviewed"), (1, "one review")]
