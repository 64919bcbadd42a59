import random

import pytest
from pyspark.sql import functions as F

from granary.functions import calc, jsonx
from granary.functions import text as T
from granary.operators import dedup, redact, rules, structure


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("build", "text", "wanted"),
    [
        (T.clean_layout, "  甲 乙\n\n a    b \n", "甲乙\na  b"),
        (T.strip_emphasis, "★▲ 要求", "要求"),
        (T.normalise_query, " A, b!\tC ", "a b c"),
        (T.category_code, "A01_brand-lock", "BRANDLOCK"),
        (T.category_code, "brand_lock", "BRAND_LOCK"),
        (T.numbered_items, "1. a\n 2、b\nc", 2),
        (T.snippet, "甲乙。丙", "甲乙。"),
        (T.page_noise, "12", True),
        (T.page_noise, "第1页共9页", True),
        (T.page_noise, "some words", False),
        (T.letter_share, "ab1甲", 0.75),
        (T.strip_html, "<p>a <b>b</b></p><script>x</script>", "a b"),
        (T.without_emoji, "a\U0001f600b", "ab"),
    ],
)
def test_text(spark, build, text, wanted):
    assert one(spark, build(F.col("t")), t=text) == wanted


@pytest.mark.parametrize(("n", "wanted"), [(None, "-"), (12, "12B"), (2048, "2.00KB"), (3 << 20, "3.00MB")])
def test_file_size(spark, n, wanted):
    assert one(spark, T.file_size(F.lit(n).cast("long"))) == wanted


@pytest.mark.parametrize(
    ("line", "wanted"),
    [("第一章 总则", ("chapter", 1)), ("第二节 要求", ("section", 2)), ("一、范围", ("cjk", 2)), ("1.2 Scope", ("decimal2", 4)), ("1.2.3 Depth", ("decimal3", 5)), ("1. A sentence。", None), ("plain", None)],
)
def test_heading(spark, line, wanted):
    found = one(spark, T.heading(F.col("t")), t=line)
    assert (tuple(found) if found else None) == wanted


def test_similarity(spark):
    f = lambda a, b: one(spark, T.evidence_similarity(F.col("a"), F.col("b")), a=a, b=b)
    assert f("2024年1月2日 开标", " [日期]开标") == 1.0 and f("2024-1-2开标", "[日期]开标") == 0.0
    assert f("", "") == 0.0 and f(None, "x") == 0.0 and f("a-b,c", "x") == 0.0 and f("评审 因素", "评审因素") == 1.0
    assert f("abcdef", "abcxyz") == pytest.approx(1 / 7)
    assert f("abc", "xyz") == 0.0


def test_tables(spark):
    rows = F.array(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("c")))
    assert one(spark, T.markdown_table(rows)) == "| a | b |\n| --- | --- |\n| c |  |"
    assert one(spark, T.table_keys(F.lit("| a | b |\n| --- | --- |\n| c | d |"))) == ["a", "c"]
    assert one(spark, T.embed_text(F.lit("x"), F.array(F.lit("p"), F.lit("q"), F.lit("r")))) == "【q > r】x"


@pytest.mark.parametrize(("a", "b", "days"), [("2024-02-28", "2024/03/01", 2), ("2025-02-31", "2025-03-03", 0), ("x", "2024-01-01", None)])
def test_days(spark, a, b, days):
    assert one(spark, calc.days_between(F.lit(a), F.lit(b))) == days


@pytest.mark.parametrize(("limit", "value", "inside"), [("<= 30", 30.0, True), ("< 30", 30.0, False), ("≥ 3", 2.9, False), ("1 <= x < 3", 3.0, False), ("== 2", 2.0, True), ("about 2", 2.0, None)])
def test_threshold(spark, limit, value, inside):
    assert one(spark, calc.within(F.lit(value), calc.threshold(F.lit(limit)))) == inside


@pytest.mark.parametrize(("formula", "value"), [("1 + 2 * 3", 7), ("-(2 - 5) / 2", 1.5), ("a * ab", 6), ("1 / 0", None), ("1 +", None), ("（1＋2）", None), ("2 × 3 ÷ 4", 1.5)])
def test_formula(formula, value):
    assert calc.evaluate(formula, {"a": 2, "ab": 3}) == value


def test_json(spark):
    assert one(spark, jsonx.value(F.lit('{"a": {"b": 3}}'), "$.x", "$.a.b", kind="long")) == 3
    assert one(spark, jsonx.value(F.lit("no json"), "$.x", default="d")) == "d"
    assert one(spark, jsonx.string_list(F.lit('["a", "b"]'))) == ["a", "b"]
    assert one(spark, jsonx.string_list(F.lit("a"))) == ["a"]
    assert one(spark, jsonx.hit_count(F.lit('{"results": [1, 2]}'))) == 2
    assert tuple(one(spark, jsonx.token_usage(F.lit('{"usage": {"input_tokens": 5, "output_tokens": 2}}')))) == (5, 2)


def test_redaction_within_rows(spark):
    texts = ["１１０１０５１９４９１２３１００２Ｘ and １１０１０５１９４９１２３１００２X, card ６２２２０２１２３４５６７８９０", "[email_1] wrote to a@b.com and c@d.org, a@b.com", "phone 13８-1234-５６７８", None, "plain [phone_3]", "x@y.zz " * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    hidden = {r["doc_id"]: r for r in redact.redacted(docs, "text").collect()}
    assert [e["label"] for e in hidden[0]["vault"]][:1] == ["id"] and "bank" in [e["label"] for e in hidden[0]["vault"]]
    assert hidden[1]["text"] == "[email_1] wrote to [email_2] and [email_3], [email_2]"
    assert hidden[2]["text"] == "phone [phone_1]" and hidden[3]["text"] is None and hidden[4]["text"] == texts[4] and hidden[4]["vault"] == []
    assert hidden[5]["text"] == "[email_1] " * 3000
    back = redact.restored(redact.redacted(docs, "text"), "text").collect()
    assert {r["doc_id"]: r["text"] for r in back} == dict(enumerate(texts))
    assert {r["label"] for r in redact.vault(docs, "doc_id", "text", ("phone",)).collect()} == {"phone"}


def test_redaction_round_trip(spark):
    text = "mail 张三 a@b.com or a@b.com, id 11010519491231002X, phone 13800138000 and 010-12345678, 金额 100万元"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    vault = redact.vault(docs, "doc_id", "text")
    found = {r["placeholder"]: r["value"] for r in vault.collect()}
    assert found == {"[email_1]": "a@b.com", "[id_1]": "11010519491231002X", "[phone_1]": "13800138000", "[phone_2]": "010-12345678"}
    hidden = redact.redact(docs, vault, "doc_id", "text")
    assert "a@b.com" not in hidden.filter("doc_id = 1").first()["text"]
    assert {r["doc_id"]: r["text"] for r in redact.restore(hidden, vault, "doc_id", "text").collect()} == {1: text, 2: None, 3: ""}
    with pytest.raises(ValueError):
        redact.redaction_on("sometimes")


@pytest.mark.parametrize(
    ("text", "category"),
    [("本市注册的供应商须", "LOCAL_REGISTRATION"), ("指定品牌，不接受其他", "BRAND_LOCK"), ("投标保证金为5%", "EXCESSIVE_DEPOSIT"), ("验收以采购人满意为准", "VAGUE_ACCEPTANCE"), ("评委酌情评分", "SUBJECTIVE_SCORING"), ("违约金累计", "UNCLEAR_PENALTY"), ("普通文字", None)],
)
def test_categories(spark, text, category):
    assert one(spark, rules.evidence_category(F.lit(text))) == category


def test_rules(spark):
    assert one(spark, rules.alias_category(F.lit("A12_TIME_LIMIT"))) == "SHORT_DEADLINE"
    assert one(spark, rules.canonical_category(F.lit("x"), F.lit(""), F.lit("made up"))) == "MADEUP"
    assert one(spark, rules.tier(F.lit("密封并指定品牌"))) == "L3"
    assert one(spark, rules.turns(F.lit("L1"), F.lit(5))) == 5
    assert one(spark, rules.candidate_categories(F.lit("投标保证金为5%。验收以满意为准"))) == ["EXCESSIVE_DEPOSIT", "VAGUE_ACCEPTANCE"]


def test_chunking():
    limits = structure.Limits(merge_below=20, split_above=60, overlap=10, tiny_below=5)
    text = "甲" * 50 + "\n一" + "乙" * 70
    parts = structure.split_text(text, limits)
    assert parts[0] == "甲" * 50 + "\n" and all(len(p) <= 60 for p in parts)
    whole = parts[0]
    for p in parts[1:]:
        k = next(k for k in range(min(len(whole), len(p)), -1, -1) if whole.endswith(p[:k]))
        whole += p[k:]
    assert set(whole) == set(text)
    leaf = lambda t, page: structure.Chunk(["a", t], t, page, page)
    merged = list(structure.merged_leaves([leaf("x", 1), leaf("y", 2), leaf("z", 9), leaf("w" * 30, 9)], limits))
    assert [(c.kind, c.text) for c in merged] == [("merged", "x\n\ny"), ("leaf", "z"), ("leaf", "w" * 30)]


def test_greedy_merge_order(spark):
    df = spark.createDataFrame([(1, 1, "abcdefgh"), (1, 2, "abcdefgx"), (1, 3, "zzzz"), (2, 1, "abcdefgh")], "b long, o long, t string")
    for parts in (1, 3):
        found = {(r["b"], r["o"]): r["merged_into"] for r in dedup.greedy_merge(df.repartition(parts), ["b"], "o", "t", 0.75).collect()}
        assert found == {(1, 1): 1, (1, 2): 1, (1, 3): 3, (2, 1): 1}


def test_greedy_merge_matches_blocks_for_near_texts_only(spark, monkeypatch):
    """Each head as by all comparisons, with blocks matched only where a pair's longest common subsequence allows it."""
    r = random.Random(7)
    texts = ["".join(r.choice("abcdefg h") for _ in range(r.randint(0, 60))) for _ in range(60)]
    texts += [t[: r.randint(0, len(t))] + r.choice("xyz") + t[r.randint(0, len(t)) :] for t in texts] + texts[:20] + [None, "", "B" * 300]
    matched = []
    real = dedup.SequenceMatcher
    monkeypatch.setattr(dedup, "SequenceMatcher", lambda *a: matched.append(a) or real(*a))
    heads, pairs = [], 0
    for i, t in enumerate(texts):
        found = dedup._first_like(dedup._squeezed(t), heads, 0.75)
        before = len(matched)
        assert found == next((h for h, other in heads if dedup.quotation_similarity(t, other) >= 0.75), None)
        pairs += len(matched) - before
        del matched[before:]
        if found is None:
            heads.append((i, dedup._squeezed(t)))
    assert len(matched) * 10 < pairs
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "b int, o int, t string")
    by = {x["o"]: x["merged_into"] for x in dedup.greedy_merge(df, ["b"], "o", "t", 0.75).collect()}
    kept, wanted = [], {}
    for i, t in enumerate(texts):
        wanted[i] = next((h for h in kept if dedup.quotation_similarity(t, texts[h]) >= 0.75), i)
        if wanted[i] == i:
            kept.append(i)
    assert by == wanted
