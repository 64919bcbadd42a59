"""Rules kept as data: categories, tiers, routing, templates, conflicts. The lists are fixed values."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.session import ship

#: Words of one automaton, about.
MOST_WORDS = 200_000

#: Category codes, names and the reviewer that owns each.
CATEGORIES = [
    ("LOCAL_REGISTRATION", "地域注册限制", "SemanticRiskAgent"),
    ("BRAND_LOCK", "指定品牌且不接受同等产品", "DemandAgent"),
    ("UNRELATED_CERT", "设置与履约无关的资格条件", "DemandAgent"),
    ("REGIONAL_PERFORMANCE", "特定区域业绩限制", "SemanticRiskAgent"),
    ("SCALE_THRESHOLD", "以经营规模设置资格门槛", "DemandAgent"),
    ("SHORT_DEADLINE", "投标准备期不足", "ProcedureAgent"),
    ("EXCESSIVE_DEPOSIT", "投标保证金比例过高", "ProcedureAgent"),
    ("OEM_AUTHORIZATION", "将厂家授权作为资格条件", "ProcedureAgent"),
    ("SUBJECTIVE_SCORING", "主观评分未细化量化", "ScoringAgent"),
    ("LOCAL_AWARD", "本地奖项加分", "ScoringAgent"),
    ("VAGUE_ACCEPTANCE", "验收标准模糊", "ContractAgent"),
    ("UNBOUNDED_IP", "知识产权责任无限扩大", "ContractAgent"),
    ("UNILATERAL_CHANGE", "采购人可单方无限变更需求", "ContractAgent"),
    ("CONFLICTING_DATES", "关键日期相互矛盾", "FactCheckAgent"),
    ("UNCLEAR_PENALTY", "违约责任口径不清", "ContractAgent"),
]
DEFAULT_OWNER = "RuleEngineAgent"
_REGION = "本市 本区 本县 本省 当地 所在地 所在区县 采购人所在地"
#: Evidence rules in order; a rule holds when the text has a word of each of its groups.
EVIDENCE = [
    ("LOCAL_REGISTRATION", [_REGION, "注册 分公司 分支机构 经营满", "须 必须 仅限 不接受 资格"]),
    ("REGIONAL_PERFORMANCE", [_REGION, "业绩 案例 合同", "须 必须 仅限 不认可 不予认可 不得"]),
    ("LOCAL_AWARD", [_REGION, "奖项 荣誉 获奖 证书 诚信企业", "加分 得分 评分 分"]),
    ("SCALE_THRESHOLD", ["注册资本 营业收入 资产总额 净资产", "不得低于 不少于 以上 门槛 资格"]),
    ("BRAND_LOCK", ["品牌 商标 型号", "仅 只能 唯一 指定 不接受 不得偏离"]),
    ("OEM_AUTHORIZATION", ["原厂 厂家 制造商", "授权 承诺函 证明", "资格 无效 废标 必须 须"]),
    ("UNRELATED_CERT", ["认证 证书 荣誉 示范企业", "资格 无效 废标 不通过 必须 须提供 无关"]),
    ("EXCESSIVE_DEPOSIT", ["投标保证金", "3% 4% 5% 百分之三 百分之四 百分之五 比例过高"]),
    ("SHORT_DEADLINE", ["投标截止 开标 投标准备 获取招标文件", "3日 5日 不足 少于 仅有 仅"]),
    ("SUBJECTIVE_SCORING", ["评分 得分 评委", "酌情 自行掌握 主观 优良 满意程度 综合判断"]),
    ("VAGUE_ACCEPTANCE", ["验收", "满意 自行判断 无异议 未明确 不明确 无需说明"]),
    ("UNBOUNDED_IP", ["知识产权 侵权 专利 既有软件 权利", "全部责任 一切责任 无限 无上限 既有 永久归"]),
    ("UNILATERAL_CHANGE", ["单方 新增需求 任意变更 采购人有权变更", "不得调整 不调整 无条件 原合同范围 费用 工期"]),
    ("CONFLICTING_DATES", ["日期 截止 开标时间", "矛盾 不一致 另一处 分别为 同时规定"]),
    ("UNCLEAR_PENALTY", ["违约金 违约责任 处罚", "重复 累计 无上限 自行决定 不明确 不清"]),
]
#: Other codes by which categories are known.
ALIASES = {
    "UNRELATED_CERT": "UNRELATED_CERTIFICATE UNRELATED_CERTIFICATION UNRELATED_QUALIFICATION IRRELEVANT_CERTIFICATE",
    "SHORT_DEADLINE": "SHORT_PREPARATION_PERIOD UNREASONABLE_TIME_LIMIT UNREASONABLE_PREPARATION_TIME SHORT_BIDDING_PERIOD TIME_LIMIT",
    "SCALE_THRESHOLD": "ASSET_THRESHOLD ASSET_REQUIREMENT CAPITAL_THRESHOLD",
    "OEM_AUTHORIZATION": "MANUFACTURER_AUTHORIZATION FACTORY_AUTHORIZATION",
    "SUBJECTIVE_SCORING": "SCORING_DISCRETION UNSPECIFIED_SCORING UNQUANTIFIED_ASSESSMENT",
    "LOCAL_AWARD": "LOCAL_CERTIFICATE_BONUS LOCAL_HONOR_BONUS",
    "VAGUE_ACCEPTANCE": "UNCLEAR_ACCEPTANCE_CRITERIA ACCEPTANCE_CRITERIA AMBIGUOUS_ACCEPTANCE UNCLEAR_ACCEPTANCE",
    "UNBOUNDED_IP": "UNLIMITED_IP_LIABILITY IP_LIABILITY",
    "UNCLEAR_PENALTY": "UNDEFINED_PENALTY UNLIMITED_PENALTY UNCLEAR_CONTRACTUAL_RESPONSIBILITY",
    "CONFLICTING_DATES": "DATE_CONFLICT",
}
#: Words of the high and the low tier, and the turns a tier may take.
HIGH_WORDS = "品牌 型号 指定 必须采用 原厂 专利 专有技术 本地 东莞 深圳 本市 所在地 分支机构 常驻 唯一 独家 排他 不接受替代 原厂商授权 制造商授权函 项目授权 ★"
LOW_WORDS = "格式 装订 密封 签字 盖章 份数 封面 目录 页码 字体 字号 行距 采购计划编号 采购项目编号 竞争性磋商文件 磋商邀请 投标邀请函"
TURNS = {"L1": 8, "L2": 12, "L3": 14}
#: Reviewers with the words that route a clause to them; no words take every clause.
ROUTES = [
    ("FactCheckAgent", "时限 金额 预算 截止 格式 装订 密封 盖章"),
    ("ProcedureAgent", "采购方式 公告 保证金 评审 废标 流标 开标 评标"),
    ("RuleEngineAgent", "必须 不得 禁止 应 不应 资格条件 实质性"),
    ("SemanticRiskAgent", "品牌 型号 原厂 专利 独家 指定 本地 区域"),
]
#: Pairs that contradict each other: the first in one clause, the second in another.
CONFLICTS = [("不接受联合体", "联合体"), ("不允许分包", "分包"), ("不允许转包", "转包"), ("资格后审", "资格预审"), ("最低评标价法", "综合评分法"), ("不接受替代方案", "备选方案"), ("不接受进口", "进口产品")]
SEVERITIES = {"info": 0, "low": 1, "medium": 2, "high": 3}


def severity_rank(c: Column) -> Column:
    return T.cascade(F.lit(-1), [(c == k, F.lit(v)) for k, v in SEVERITIES.items()])


def evidence_category(text: Column, rules=EVIDENCE) -> Column:
    """The first category whose groups of words the text has, or null."""
    cases = []
    for code, groups in rules:
        holds = F.lit(True)
        for words in groups:
            holds = holds & T.any_of(text, words.split())
        cases.append((holds, F.lit(code)))
    return T.cascade(F.lit(None).cast("string"), cases)


def alias_category(code: Column) -> Column:
    known = {c: c for c, _, _ in CATEGORIES} | {a: c for c, names in ALIASES.items() for a in names.split()}
    found = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    return F.element_at(found, T.category_code(code))


def canonical_category(quotation: Column, code: Column, kind: Column) -> Column:
    """Evidence first, then the code's alias, then the type's, then the cleaned code or type."""
    plain = F.when(F.trim(F.coalesce(code, F.lit(""))) != "", code).otherwise(kind)
    return F.coalesce(evidence_category(F.trim(quotation)), alias_category(code), alias_category(kind), T.category_code(plain))


def candidate_categories(text: Column, rules=EVIDENCE) -> Column:
    """Categories of the segments in order, then of the whole text, each once."""
    parts = F.concat(F.split(text, "[\n。；]"), F.array(text))
    return F.array_distinct(F.filter(F.transform(parts, lambda p: evidence_category(p, rules)), lambda c: c.isNotNull()))


#: Fixed groups of words: a quotation is critical evidence of a category when it has a word of each of its groups.
CRITICAL = [
    ("LOCAL_REGISTRATION", ("注册 分公司 分支机构", "本市 本区 本县 所在地 外地")),
    ("BRAND_LOCK", ("品牌 商标 型号", "仅 只能 唯一 不接受 指定")),
    ("UNRELATED_CERT", ("认证 证书 荣誉 示范企业", "资格 无效 废标 不通过 必须 须 无关")),
    ("REGIONAL_PERFORMANCE", ("业绩 案例 合同", "本市 本区 本县 本省 当地 所在区县")),
    ("SCALE_THRESHOLD", ("注册资本 营业收入 资产总额 净资产", "不得低于 不少于 以上 资格")),
]
#: Fixed text: the reason of a critical finding, around its category.
CRITICAL_REASON = ("命中重大问题分类 ", "，且原文证据满足红线判定条件。")


def critical_evidence(code: Column, quotation: Column, rules=CRITICAL) -> Column:
    """Whether the quotation has a word of each group of its category; false for categories without groups."""
    found = F.lit(False)
    for name, groups in rules:
        holds = code == name
        for words in groups:
            holds = holds & T.any_of(quotation, words.split())
        found = found | holds
    return F.coalesce(found, F.lit(False))


def normalised_findings(findings: DataFrame, rules=CRITICAL) -> DataFrame:
    """Findings with canonical category, the category's display name as their type, and the critical flag, severity and reason
    that their quotation gives, whatever they said before. A finding without risk or quotation is never critical."""
    quotation = F.trim(F.coalesce(F.col("source_quote"), F.lit("")))
    rows = findings.withColumn("category_code", canonical_category(F.col("source_quote"), F.col("category_code"), F.col("risk_type")))
    rows = rows.withColumn("risk_type", F.coalesce(display_name(F.col("category_code")), F.col("risk_type")))
    critical = (quotation != "") & critical_evidence(F.col("category_code"), quotation, rules)
    rows = rows.withColumn("is_critical", ~F.coalesce(F.col("no_risk"), F.lit(False)) & critical)
    rows = rows.withColumn("severity", F.when(F.col("is_critical"), "high").otherwise(F.col("severity")))
    before, after = CRITICAL_REASON
    return rows.withColumn("critical_reason", F.when(F.col("is_critical"), F.concat(F.lit(before), "category_code", F.lit(after))).otherwise(""))


def owner(code: Column) -> Column:
    return T.cascade(F.lit(DEFAULT_OWNER), [(code == c, F.lit(o)) for c, _, o in CATEGORIES])


def display_name(code: Column) -> Column:
    return T.cascade(F.lit(None).cast("string"), [(code == c, F.lit(n)) for c, n, _ in CATEGORIES])


def tier(text: Column, high: str = HIGH_WORDS, low: str = LOW_WORDS) -> Column:
    """L3 for a word of the high tier, else L1 for one of the low tier, else L2."""
    t = F.lower(text)
    return F.when(T.any_of(t, high.lower().split()), "L3").when(T.any_of(t, low.lower().split()), "L1").otherwise("L2")


def turns(tier_: Column, own: Column | None = None) -> Column:
    """The turns of a tier, at most the reviewer's own."""
    most = T.cascade(F.lit(TURNS["L2"]), [(tier_ == k, F.lit(v)) for k, v in TURNS.items()])
    return most if own is None else F.least(most, own)


def routes(spark: SparkSession, rules=ROUTES) -> DataFrame:
    return spark.createDataFrame([(a, w) for a, words in rules for w in (words.split() or [""])], "agent string, word string")


def route(clauses: DataFrame, rules: DataFrame, key: str, text: str, fallback: str = DEFAULT_OWNER, most: int = MOST_WORDS) -> DataFrame:
    """(key, agent): every reviewer one of whose words a clause has, case aside; clauses of no reviewer go to the fallback.

    The words of all reviewers, made while the engine runs or not, are compiled to an automaton that finds them all in one pass
    over a text. An automaton holds about `most` words; more words are dealt to several by a hash, each a further narrow pass that
    adds to the row what it finds. An empty word is in every clause; null words and agents are in none, a null text has none."""
    ship(clauses.sparkSession)
    words = rules.filter("agent IS NOT NULL AND word IS NOT NULL").select("agent", F.lower("word").alias("word")).distinct()
    parts = -(-words.count() // most) or 1
    rows = clauses.select(key, F.lower(text).alias("__t"), F.array().cast("array<string>").alias("__a"))
    for i in range(parts):
        some = words.filter(F.pmod(F.xxhash64("word"), F.lit(parts)) == i).collect()
        shared = clauses.sparkSession.sparkContext.broadcast([(r["word"], r["agent"]) for r in some])
        rows = rows.mapInArrow(_finder(shared), rows.schema)
    return rows.select(key, F.explode(F.when(F.size("__a") > 0, F.array_distinct("__a")).otherwise(F.array(F.lit(fallback)))).alias("agent"))


def _finder(shared: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        agents: dict[str, list[str]] = {}
        for word, agent in shared.value:
            agents.setdefault(word, []).append(agent)
        always, automaton = set(agents.pop("", [])), ahocorasick.Automaton()
        for word, who in agents.items():
            automaton.add_word(word, tuple(who))
        automaton.make_automaton()
        for batch in batches:
            found = []
            for t, before in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                mine = set(before) | (always if t is not None else set())
                if t and agents:
                    for _, who in automaton.iter(t):
                        mine.update(who)
                found.append(sorted(mine))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.string()))], names=batch.schema.names)

    return work


def template_check(clauses: DataFrame, text: str, required: list[str], forbidden: list[str]) -> DataFrame:
    """Adds the required items a text misses and the forbidden ones it has."""
    pick = lambda items, test: F.filter(F.array(*(F.when(test(i), F.lit(i)) for i in items)), lambda x: x.isNotNull())
    return clauses.withColumn("missing", pick(required, lambda i: ~F.contains(F.col(text), F.lit(i)))).withColumn("extra", pick(forbidden, lambda i: T.forbidden_in(F.col(text), i)))


def actionable(no_risk: Column, quotation: Column, severity: Column, mandatory: Column, negative: Column) -> Column:
    """Findings worth showing: no-risk notes pass; others need a quotation that is no heading and no empty remark."""
    q = F.trim(F.coalesce(quotation, F.lit("")))
    return no_risk | ((q != "") & ~((F.char_length(q) < 20) & ~mandatory) & ~((severity == "info") & negative))


def triage(findings: DataFrame) -> DataFrame:
    """Findings by severity, then confidence; hypotheses are left out."""
    return findings.filter(F.coalesce(F.col("finding_role"), F.lit("")) != "hypothesis").orderBy(F.desc(severity_rank(F.col("severity"))), F.desc("confidence"), "risk_id")
