"""Clauses of chunks, their texts by id, and templates kept as a table: what a clause of a kind must say, must not say and usually names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.operators import relational, rules

#: Templates up to which their table is broadcast.
MOST_TEMPLATES = 1_000
SCHEMA = "template_type string, name string, required array<struct<item:string,severity:string,basis:string>>, forbidden array<string>, expected array<string>"

#: Type, name, required items (item, severity, legal basis), forbidden phrases (`.*` stands for anything), fields.
TEMPLATES = [
    (
        "资格条件标准模板",
        "政府采购供应商资格条件标准模板",
        [
            ("具有独立承担民事责任的能力", "high", "《政府采购法》第22条(一)"),
            ("具有良好的商业信誉和健全的财务会计制度", "high", "《政府采购法》第22条(二)"),
            ("具有履行合同所必需的设备和专业技术能力", "high", "《政府采购法》第22条(三)"),
            ("有依法缴纳税收和社会保障资金的良好记录", "high", "《政府采购法》第22条(四)"),
            ("参加政府采购活动前三年内，在经营活动中没有重大违法记录", "high", "《政府采购法》第22条(五)"),
            ("未被列入失信被执行人、重大税收违法案件当事人名单、政府采购严重违法失信行为记录名单", "high", "《政府采购法》第22条、《关于在政府采购活动中查询及使用信用记录有关问题的通知》"),
        ],
        ["注册资本", "资产总额", "营业收入", "从业人员", "利润", "纳税额", "本地注册", "在.*设有分支机构", "本地业绩", "特定品牌", "唯一授权", "原厂商", "地域", "规模"],
        ["供应商资格要求", "资质要求", "需要提供的证明材料", "联合体"],
    ),
    (
        "合同必须条款模板",
        "政府采购合同必须条款",
        [
            ("合同金额及付款方式", "high", "《政府采购法》第46条"),
            ("履约保证金", "medium", "《政府采购法实施条例》第48条"),
            ("违约责任", "high", "《民法典》合同编"),
            ("争议解决方式", "medium", "政府采购标准合同文本"),
            ("验收标准与程序", "high", "《政府采购法》第41条"),
            ("合同履行期限", "high", "《政府采购法》第46条"),
            ("保密条款", "medium", "政府采购标准合同文本"),
        ],
        ["最终解释权", "以.*意见为准", "无条件接受", "不得异议", "放弃.*权利", "无限期"],
        ["合同金额", "付款", "履约保证金", "违约责任", "争议解决", "验收"],
    ),
    (
        "评审标准模板",
        "政府采购评审标准模板",
        [
            ("价格分权重（货物≥30%，服务≥10%）", "high", "《政府采购货物和服务招标投标管理办法》第55条"),
            ("技术评审因素", "medium", "政府采购标准评审办法"),
            ("商务评审因素", "medium", "政府采购标准评审办法"),
            ("评分权重总计100%", "high", "政府采购评审原则"),
        ],
        ["地域.*加分", "本地.*业绩.*加分", "品牌.*加分", "特定.*型号.*加分", "注册地"],
        ["价格分", "技术评审", "商务评审"],
    ),
]
#: What a forbidden phrase holds and the flag it gets; the first that fits decides.
FLAGS = [("本地", "restrictive"), ("地域", "restrictive"), ("解释权", "overbroad"), ("不得异议", "overbroad"), ("品牌", "restrictive"), ("授权", "restrictive")]
OTHER_FLAG = "unusual"
#: Fixed wordings of a comparison's rows and summary.
EXPECTED, FOUND_NONE = ("应包含 '", "' 相关条款"), "未找到"
FITS, DIFFERS = ("✅ 该条款与'", "'模板完全匹配"), "⚠️ "
COUNTS = (("缺失 ", " 项必须条款"), ("发现 ", " 处可疑内容"), ("", " 处措辞差异"))


def clauses(chunks: DataFrame, depth: int = 2, most: int = 40, text: str = "text", path: str = "path") -> DataFrame:
    """Chunks as clauses for review: the text with its place in front, and the tier and turns of that text. Nothing leaves the row.

    A null text counts as empty, a null path as one without titles; other columns stay."""
    placed = T.embed_text(F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(path), F.array().cast("array<string>")), depth, most)
    # Behind a generator, so that the tier's tests don't make the text again.
    made = chunks.select(*(F.col(f"`{c}`") for c in chunks.columns if c != text), F.explode(F.array(placed)).alias(text))
    return made.withColumn("tier", rules.tier(F.col(text))).withColumn("turns", rules.turns(F.col("tier")))


def with_texts(requests: DataFrame, held: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Requests with the text and path of the clause they name, and whether there is such a clause; `held` has each key once."""
    cols = [F.col(c).alias(f"__{c}") for c in ("text", "path") if c in held.columns]
    joined = requests.drop("text", "path").join(held.select(key, *cols, F.lit(True).alias("known")), key, "left")
    return joined.withColumn("known", F.coalesce("known", F.lit(False))).withColumnsRenamed({"__text": "text", "__path": "path"})


def store(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """The templates as a table."""
    return spark.createDataFrame(templates, SCHEMA)


def registered(held: DataFrame, new: DataFrame) -> DataFrame:
    """The store after new templates: each takes the place of the one of its type. Types of `new` differ from each other."""
    return relational.replaced_children(held, new, "template_type")


def has_item(lowered: Column, item: Column) -> Column:
    """Whether a lower-cased text has an item: a word (of four bytes or more) of what stands before its first comma or bracket, or
    its first six characters."""
    words = F.split(F.regexp_extract(item, "^[^、，,（(]*", 0), "\\s+")
    return F.exists(words, lambda w: (F.octet_length(w) >= 4) & F.contains(lowered, F.lower(w))) | F.contains(lowered, F.lower(F.substring(item, 1, 6)))


def has_phrase(lowered: Column, phrase: Column) -> Column:
    """Whether a lower-cased text has the parts of a phrase, which `.*` separates, one behind the other."""

    def onward(at: Column, part: Column) -> Column:
        found = F.call_function("locate", part, lowered, at)
        return F.when((at == 0) | (part == ""), at).when(found == 0, 0).otherwise(found + F.char_length(part))

    return F.aggregate(F.split(F.lower(phrase), "\\.\\*"), F.lit(1), onward) > 0


def compared(rows: DataFrame, templates: DataFrame, text: str = "text") -> DataFrame:
    """Rows (template_type, text, perhaps known) held against the template of their type.

    Adds template_name, missing (item, severity, basis), extra (item, flag), wording (field, expected, actual), summary, and
    error: `unknown clause` where `known` is false, else `unknown template`; then the others are null. A null text counts as empty. The
    templates are broadcast if a count shows that they are few; otherwise they are joined by type."""
    few = templates.limit(MOST_TEMPLATES + 1).count() <= MOST_TEMPLATES
    named = templates.select("template_type", F.struct("name", "required", "forbidden", "expected").alias("__t"))
    joined = rows.join(F.broadcast(named) if few else named, "template_type", "left")
    known = F.col("known") if "known" in rows.columns else F.lit(True)
    error = F.when(~known, "unknown clause").when(F.col("__t").isNull(), "unknown template")
    whole = F.coalesce(F.col(text), F.lit(""))
    flag = lambda p: T.cascade(F.lit(OTHER_FLAG), [(F.contains(p, F.lit(w)), F.lit(f)) for w, f in FLAGS])
    missing = F.filter("__t.required", lambda r: ~has_item(F.col("__low"), r["item"]))
    extra = F.transform(F.filter("__t.forbidden", lambda p: has_phrase(F.col("__low"), p)), lambda p: F.struct(p.alias("item"), flag(p).alias("flag")))
    absent = F.filter("__t.expected", lambda f: ~F.contains(whole, f) & ~F.contains(whole, F.lower(f)))
    wording = F.transform(absent, lambda f: F.struct(f.alias("field"), F.concat(F.lit(EXPECTED[0]), f, F.lit(EXPECTED[1])).alias("expected"), F.lit(FOUND_NONE).alias("actual")))
    judged = joined.withColumn("error", error).withColumn("__low", F.lower(whole))
    for name, value in (("missing", missing), ("extra", extra), ("wording", wording)):
        judged = judged.withColumn(name, F.when(F.col("error").isNull(), value))
    parts = [F.when(F.size(c) > 0, F.concat(F.lit(before), F.size(c).cast("string"), F.lit(after))) for c, (before, after) in zip(("missing", "extra", "wording"), COUNTS)]
    counts = F.concat_ws("，", *parts)
    summary = F.when(counts == "", F.concat(F.lit(FITS[0]), "__t.name", F.lit(FITS[1]))).otherwise(F.concat(F.lit(DIFFERS), counts))
    return judged.withColumn("template_name", F.when(F.col("error").isNull(), F.col("__t.name"))).withColumn("summary", F.when(F.col("error").isNull(), summary)).drop("__t", "__low")
