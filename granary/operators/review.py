"""Reviewing clauses and findings: obligations, laws, references, dates, blocks and consolidation. The lists are fixed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import calc
from granary.functions import text as T

#: Words by which sentences are obligations of a type; the first word of a type that a text has picks its sentences.
OBLIGATIONS = [
    ("资质", "资质 证书 许可证 资格 等级 备案 注册 认定 核准"),
    ("业绩", "业绩 合同 项目经验 案例 成功案例 同类项目 类似项目 承担过"),
    ("人员", "人员 项目经理 技术负责人 工程师 注册 持证 职称 学历 专业 从业"),
    ("设备", "设备 仪器 工具 车辆 机械 生产 检测 实验室 车间"),
    ("工期", "工期 交付 完成 期限 日历日 工作日 进度 节点 里程碑"),
    ("付款条件", "付款 预付款 进度款 结算 质保金 支付 合同金额 报价"),
    ("售后", "售后 保修 维护 服务 技术支持 培训 响应 到场 7×24 驻场"),
    ("保密", "保密 信息安全 数据 隐私 商业秘密 敏感 加密"),
    ("保险", "保险 担保 保函 保证金 履约 投标"),
    ("其他", "必须 须 应 不得 禁止 需 要求"),
]
STARRED = "★ * 必须满足 实质性"
VOID_WORDS = "取消 废标 无效"
#: Domains of law in order: words and confidence; those marked take the check of known laws before a reviewer.
DOMAINS = [
    ("geographic", "地域 本地 所在地 分支机构 常驻 排斥 歧视 地区 第5条 第二十条第七项", 0.95, True),
    ("brand", "品牌 型号 专利 原厂 独家 排他 指定 唯一 第二十条第二项 第二十二条", 0.90, False),
    ("procedure", "采购方式 公开招标 邀请招标 竞争性 公告 公示 开标 评标 废标 流标 第二十七条 第二十三条 第十三条 87号令", 0.85, True),
    ("scoring", "评分 分值 权重 价格分 技术分 商务分 评审因素 评审标准 第三十四条 第55条 第64条", 0.90, True),
    ("contract", "付款 验收 质保 违约 售后 保修 合同 第43条 第50条 第47条 第52条", 0.85, False),
    ("bond", "保证金 截止 期限 工作日 日历日 第三十三条 第二十九条 第三十一条 第20条", 0.90, True),
    ("qualification", "资格 资质 业绩 条件 准入 特定 第二十二条 第二十三条 第十七条 第二十条", 0.85, False),
    ("technical", "技术 参数 规格 认证 国产 性能 功能 配置 第二十条", 0.80, False),
]
#: Known laws with their first and last article.
LAWS = [("政府采购法", 1, 90), ("政府采购法实施条例", 1, 60), ("87号令", 1, 90), ("财政部令第87号", 1, 90), ("招标投标法", 1, 70), ("招标投标法实施条例", 1, 100), ("公平竞争审查条例", 1, 30)]
#: Forms in which texts cite laws.
LAW_FORMS = ["第[零一二三四五六七八九十百]+条", "《[^》]+》第[零一二三四五六七八九十百]+条", "\\S+令第[零一二三四五六七八九十百]+号", "〔\\d{4}〕\\d+号"]


def obligations(clauses: DataFrame, key: str, text: str, rules=OBLIGATIONS) -> DataFrame:
    """(key, type, sentence, starred, consequence) of the sentences of over ten bytes that carry a type's word."""
    words = F.array(*(F.struct(F.lit(kind).alias("type"), F.array(*(F.lit(w) for w in ws.split())).alias("words")) for kind, ws in rules))
    chosen = F.transform(words, lambda r: F.struct(r["type"].alias("type"), F.element_at(F.concat(F.filter(r["words"], lambda w: F.contains(F.col(text), w)), F.array(F.lit(None).cast("string"))), 1).alias("word")))
    rows = clauses.select(key, F.explode(chosen).alias("r"), F.split(text, "[。；\n!]").alias("s")).filter("r.word is not null")
    rows = rows.select(key, F.col("r.type").alias("type"), F.explode(F.filter("s", lambda x: F.contains(x, F.col("r.word")))).alias("s")).filter(F.octet_length(F.trim("s")) > 10)
    after = F.trim(F.element_at(F.split("s", "否则"), 2))
    consequence = F.when(F.contains("s", F.lit("否则")), after).when(T.any_of(F.col("s"), VOID_WORDS.split()), "可能导致投标无效或被取消资格")
    return rows.select(key, "type", F.trim("s").alias("sentence"), T.any_of(F.col("s"), STARRED.split()).alias("starred"), consequence.alias("consequence")).distinct()


def domain(kind: Column, basis: Column) -> Column:
    """struct(domain, confidence, prefilter) of a finding by its type and its array of laws."""
    both = F.lower(F.concat_ws(" ", kind, F.array_join(basis, " ")))
    make = lambda name, x, pre: F.struct(F.lit(name).alias("domain"), F.lit(x).alias("confidence"), F.lit(pre).alias("prefilter"))
    return T.cascade(make("other", 0.5, False), [(T.any_of(both, [w.lower() for w in words.split()]), make(name, x, pre)) for name, words, x, pre in DOMAINS])


def cjk_number(c: Column) -> Column:
    """The value of a CJK numeral below one thousand, or of digits; null for other texts."""
    part = lambda pattern, empty: F.when(F.regexp_extract(c, pattern, 1) != "", _place(F.regexp_extract(c, pattern, 1))).otherwise(F.lit(empty))
    hundreds = F.when(F.contains(c, F.lit("百")), part("([一二三四五六七八九])百", 1)).otherwise(0)
    tens = F.when(F.contains(c, F.lit("十")), part("([一二三四五六七八九])十", 1)).otherwise(0)
    return F.when(c.rlike("^[0-9]+$"), c.try_cast("int")).when(c.rlike("^[零一二三四五六七八九十百]+$"), 100 * hundreds + 10 * tens + part("([一二三四五六七八九])$", 0))


def _place(c: Column) -> Column:
    return F.coalesce(*(F.when(c == d, F.lit(i)) for i, d in enumerate("一二三四五六七八九", 1)), F.lit(0))


def article(c: Column) -> Column:
    """The number of the article that a law reference names."""
    return cjk_number(F.regexp_extract(c, "第([0-9]+|[零一二三四五六七八九十百]+)条", 1))


def known_law(reference: Column) -> Column:
    """true for a known law with an article in range or none, false for one out of range, null for an unknown law."""
    clean = F.regexp_replace(F.regexp_replace(reference, "\\]\\(.*$", ""), "[\\[\\]《》]", "")
    n = article(clean)
    ordered = sorted(LAWS, key=lambda x: -len(x[0]))  # a longer name is the more exact one
    return T.cascade(F.lit(None).cast("boolean"), [(F.contains(clean, F.lit(name)), n.isNull() | n.between(low, high)) for name, low, high in ordered])


def laws_hold(basis: Column, confidence: Column, prefilter: Column) -> Column:
    """Whether the known-law check clears a finding: some known law, none of them out of range, enough confidence."""
    checks = F.transform(basis, known_law)
    return prefilter & F.exists(checks, lambda x: x.isNotNull()) & ~F.exists(checks, lambda x: ~x) & (confidence >= 0.7)


def law_references(c: Column) -> Column:
    """Distinct references in the four forms."""
    return F.array_distinct(F.concat(*(F.regexp_extract_all(c, F.lit(p), F.lit(0)) for p in LAW_FORMS)))


def law_query(c: Column) -> Column:
    """A law reference as words to search for: without link markup and brackets."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, "\\]\\([^)]*\\)", ""), "[\\[\\]《》]", " "))


def reference_type(c: Column) -> Column:
    return F.when(F.contains(c, F.lit("附件")), "attachment").when(F.contains(c, F.lit("附录")), "appendix").when(c.rlike("[章节条]"), "section").when(c.rlike("[表图]"), "table").otherwise("clause")


def resolve_references(references: DataFrame, clauses: DataFrame, doc: str, ref: str, key: str, text: str, path: str | None = None) -> DataFrame:
    """(doc, ref, candidates, status) of references within their document: none is dangling, one valid, several ambiguous.

    A clause is searched in its path and its first 500 characters; documents bound the pairs."""
    place = F.substring(F.col(text), 1, 500) if path is None else F.concat_ws(" ", F.array_join(path, " "), F.substring(F.col(text), 1, 500))
    there = clauses.select(F.col(doc).alias("__d"), F.col(key).alias("__k"), place.alias("__t"))
    found = references.select(doc, ref).distinct().join(there, (F.col(doc) == F.col("__d")) & F.contains("__t", ref), "left")
    n = F.count("__k")
    return found.groupBy(doc, ref).agg(n.alias("candidates"), F.when(n == 0, "dangling").when(n == 1, "valid").otherwise("ambiguous").alias("status"))


def timeline(dates: DataFrame, constraints: DataFrame, case: str = "case_id") -> DataFrame:
    """Constraints (case, from, to, min_days, max_days) with the days between their dates (case, label, date_str)."""
    day = dates.select(case, "label", calc.julian_day(F.col("date_str")).alias("day"))
    a, b = (day.select(case, F.col("label").alias(side), F.col("day").alias(f"{side}_day")) for side in ("from", "to"))
    found = constraints.join(a, [case, "from"], "left").join(b, [case, "to"], "left").withColumn("days", F.col("to_day") - F.col("from_day"))
    return found.withColumn("status", calc.constraint_status(F.col("days"), F.col("min_days"), F.col("max_days")))


def timeline_conflicts(dates: DataFrame, case: str = "case_id") -> DataFrame:
    """Pairs of dates in the wrong order: openings before deadlines, announcements after them, awards before openings."""
    day = dates.select(case, "label", "event_type", calc.julian_day(F.col("date_str")).alias("day")).filter("day is not null")
    a, b = (day.select(case, *(F.col(c).alias(f"{side}_{c}") for c in ("label", "event_type", "day"))) for side in ("a", "b"))
    kinds = F.concat_ws(">", "a_event_type", "b_event_type")
    wrong = F.when(kinds == "opening>deadline", F.col("a_day") < F.col("b_day")).when(kinds == "announcement>deadline", F.col("a_day") >= F.col("b_day")).when(kinds == "award>opening", F.col("a_day") < F.col("b_day"))
    return a.join(b, case).filter(F.coalesce(wrong, F.lit(False)))


def inferred_constraints(dates: DataFrame, constraints: DataFrame, least: int = 20, case: str = "case_id") -> DataFrame:
    """Announcement to deadline pairs of a case that no constraint names yet, with the least days that the law asks for."""
    a = dates.filter("event_type = 'announcement'").select(case, F.col("label").alias("from"))
    b = dates.filter("event_type = 'deadline'").select(case, F.col("label").alias("to"))
    return a.join(b, case).join(constraints.select(case, "from", "to"), [case, "from", "to"], "left_anti").withColumn("min_days", F.lit(least)).withColumn("max_days", F.lit(None).cast("int"))


def block_places(chunks: DataFrame, blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Chunks with the places of their blocks in order; ids without a block are left out."""
    each = chunks.select(key, "chunk_id", F.posexplode("source_block_ids").alias("pos", "block_id"))
    found = each.join(blocks.select(key, "block_id", "page", "bbox"), [key, "block_id"])
    grouped = found.groupBy(key, "chunk_id").agg(F.array_sort(F.collect_list(F.struct("pos", "block_id", "page", "bbox"))).alias("bbox_refs"))
    return chunks.join(grouped, [key, "chunk_id"], "left")


def tables_in_sections(tables: DataFrame, sections: DataFrame, key: str = "doc_id") -> DataFrame:
    """Each table with the deepest first section whose pages hold it. Pages are the join's key, so there is no range join."""
    paged = sections.select(key, "sec_idx", "level", F.explode(F.sequence("page_start", "page_end")).alias("page"))
    w = Window.partitionBy(key, "table_id").orderBy(F.desc("level"), "sec_idx")
    return tables.join(paged, [key, "page"]).withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def in_scope(predictions: DataFrame, gold: DataFrame, doc: str = "document_id") -> DataFrame:
    """Predictions on a page that holds gold, or whose quotation is contained in a gold quotation or contains it."""
    g = gold.select(F.col(doc).alias("__d"), F.col("page_number").alias("__p"), T.normalise_quote(F.col("source_quote")).alias("__q"))
    q = T.normalise_quote(F.col("source_quote"))
    near = (F.col("page_number") == F.col("__p")) | ((q != "") & (F.col("__q") != "") & (F.contains(q, F.col("__q")) | F.contains(F.col("__q"), q)))
    return predictions.join(g, (F.col(doc) == F.col("__d")) & near, "left_semi")


def verified_hypotheses(hypotheses: DataFrame, verified: DataFrame) -> DataFrame:
    """Verified findings with the agents whose hypotheses share a clause and the category."""
    h = hypotheses.select("category_code", F.explode("clause_ids").alias("c"), "agent").distinct()
    v = verified.select("risk_id", "category_code", F.explode("clause_ids").alias("c")).distinct()
    agents = v.join(h, ["category_code", "c"]).groupBy("risk_id").agg(F.array_sort(F.collect_set("agent")).alias("hypothesized_by"))
    return verified.drop("hypothesized_by").join(agents, "risk_id", "left")


def cell_retention(tables: DataFrame, chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """How many distinct cells of a table stand in the chunks that cover its page: full, partial or lost."""
    cells = tables.select(key, "table_id", "page", F.explode(F.array_distinct(F.flatten("rows"))).alias("cell")).filter(F.trim("cell") != "")
    paged = chunks.select(key, F.explode(F.sequence("page_start", "page_end")).alias("page"), "text")
    held = cells.join(paged, [key, "page"], "left").groupBy(key, "table_id", "cell").agg(F.max(F.coalesce(F.contains("text", "cell"), F.lit(False))).alias("there"))
    found = held.groupBy(key, "table_id").agg(F.count(F.lit(1)).alias("cells"), F.count_if("there").alias("kept"))
    return found.withColumn("status", F.when(F.col("kept") == F.col("cells"), "full").when(F.col("kept") > 0, "partial").otherwise("lost"))


def capped_batch(findings: Column, most: int = 5) -> Column:
    """struct(kept, overflow) of an array of findings."""
    return F.struct(F.slice(findings, 1, most).alias("kept"), (F.size(findings) > most).alias("overflow"))


def combined_reason(a: Column, b: Column, most: int = 800) -> Column:
    both = F.when(F.contains(a, b), a).otherwise(F.concat_ws("\n", a, b))
    return F.when(F.char_length(both) > most, F.substring(both, 1, most)).otherwise(both)


def same_finding(new: DataFrame, known: DataFrame) -> DataFrame:
    """New findings of a chunk that no known one of its category equals or contains, or is contained by."""
    k = known.select(F.col("chunk_id").alias("__c"), F.col("category_code").alias("__k"), T.normalise_quote(F.col("source_quote")).alias("__q"))
    q = T.normalise_quote(F.col("source_quote"))
    same = (F.col("chunk_id") == F.col("__c")) & (F.col("category_code") == F.col("__k")) & ((q == F.col("__q")) | F.contains(q, F.col("__q")) | F.contains(F.col("__q"), q))
    return new.join(k, same, "left_anti")


def follow_ups(clauses: DataFrame, reviews: DataFrame, key: str, most: int = 12) -> DataFrame:
    """Clauses without a review and clauses with one alone, the former first, at most `most` (1 to 50) of them."""
    seen = reviews.groupBy(key).agg(F.count(F.lit(1)).alias("reviews"))
    none = clauses.join(seen.select(key), key, "left_anti").withColumn("why", F.lit("unreviewed"))
    weak = clauses.join(seen.filter("reviews = 1").select(key), key, "left_semi").withColumn("why", F.lit("one review"))
    return none.unionByName(weak).orderBy(F.desc(F.col("why") == "unreviewed"), key).limit(max(1, min(50, most)))
