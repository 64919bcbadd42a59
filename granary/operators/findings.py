"""Findings of reviewers: which are shown, searched for, debated and merged, and what is told about them. Lists are fixed values."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import groupby

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.operators import rules

#: Words of a search for each type of risk.
TEMPLATES = {
    "程序违规": "政府采购 招标程序 合规要求 违规案例",
    "品牌指定": "政府采购 指定品牌 禁止 投诉案例",
    "排他条款": "政府采购 不合理条件 差别待遇 歧视待遇 案例",
    "资质门槛": "政府采购 供应商资格 限制竞争 投诉案例",
    "评分不公": "政府采购 评分标准 评审因素 投诉案例",
    "合同陷阱": "政府采购 合同条款 验收标准 违约责任",
    "技术缺失": "政府采购 技术参数 需求描述 规范",
    "地域限制": "政府采购 地域限制 本地业绩 差别待遇",
    "资金风险": "政府采购 预算 最高限价 资金支付",
    "需求不清": "政府采购 采购需求 明确性 规范性要求",
}
#: Words of clauses that are searched for, in order.
KEYWORDS = "★ ▲ 品牌 型号 专利 原厂 本地 地域 排他 唯一 微信 小程序 App 内部规范 标准 认证 资质 否决 废标 无效标 一票否决"
#: Parts of addresses that no search result may have.
BLOCKED = "google.com/accounts google.com/signin accounts.google apple.com discussions.apple reddit.com forbes.com wikihow.com gmail.com inbodyusa malwaretips"
#: Words of results about public procurement.
PUBLIC_WORDS, PUBLIC_HOSTS = "procurement government", "gov.cn gov."


def skipped(no_risk: Column, truncated: Column) -> Column:
    """Findings without a risk are passed over, unless they were cut off. A null flag is false."""
    return F.coalesce(no_risk, F.lit(False)) & ~F.coalesce(truncated, F.lit(False))


def debated(findings: DataFrame, most: float = 0.85) -> DataFrame:
    """Verified risks of high severity whose confidence is `most` or less."""
    return findings.filter((F.col("severity") == "high") & (F.col("confidence") <= most) & ~F.col("no_risk") & (F.col("finding_role") == "verified"))


def search_template(kind: Column, templates: dict[str, str] = TEMPLATES) -> Column:
    """The words to search for, null for types without a template."""
    return F.element_at(F.create_map(*(F.lit(x) for pair in templates.items() for x in pair)), kind)


def clause_keywords(text: Column, most: int = 3, words: str = KEYWORDS) -> Column:
    """The first `most` of the listed words that a clause has, joined by blanks."""
    found = F.filter(F.array(*(F.when(F.contains(text, F.lit(w)), F.lit(w)) for w in words.split())), lambda w: w.isNotNull())
    return F.array_join(F.slice(found, 1, most), " ")


def relevant(url: Column, snippet: Column) -> Column:
    """Results of no blocked address, with a snippet of ten characters or more that is Chinese or about public procurement."""
    u, s = F.coalesce(url, F.lit("")), F.coalesce(snippet, F.lit(""))
    public = s.rlike("[\\x{4e00}-\\x{9fff}]") | T.any_of(s, PUBLIC_WORDS.split()) | T.any_of(u, PUBLIC_HOSTS.split())
    return ~T.any_of(u, BLOCKED.split()) & (F.char_length(s) >= 10) & public


def relevant_results(results: DataFrame, query: str, url: str, snippet: str, few: int = 5) -> DataFrame:
    """The relevant results of each query; queries of `few` results or less keep all. Counts are taken within tasks first, and
    rows of a common query are not gathered: only the queries with many results meet them."""
    many = results.groupBy(F.col(query).alias("__q")).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > few).select("__q", F.lit(True).alias("__many"))
    joined = results.join(many, F.col(query).eqNullSafe(F.col("__q")), "left")
    return joined.filter(F.col("__many").isNull() | relevant(F.col(url), F.col(snippet))).select(*results.columns)


def is_finding(row: Column) -> Column:
    """Whether a JSON row is a finding as the engine gives it: it has a `risk_id` and no `issueNo`."""
    keys = F.coalesce(F.json_object_keys(row), F.array().cast("array<string>"))
    return F.array_contains(keys, "risk_id") & ~F.array_contains(keys, "issueNo")


def process_counts(rows: DataFrame, rejected: Column, merged: Column) -> DataFrame:
    """One row: input, retained, rejected and deduplicated; a rejected row isn't counted as merged."""
    off, twice = F.coalesce(rejected, F.lit(False)), F.coalesce(merged, F.lit(False))
    return rows.agg(F.count(F.lit(1)).alias("input"), F.count_if(~off & ~twice).alias("retained"), F.count_if(off).alias("rejected"), F.count_if(~off & twice).alias("deduplicated"))


def summaries(clauses: DataFrame, findings: DataFrame, key: str, order: str) -> DataFrame:
    """Clauses with a text of their findings, one line each in order; a clause without one says so."""
    role = F.when(F.col("finding_role") == "hypothesis", "[Scout 假设, 待验证]").otherwise("[已验证]")
    head = F.format_string("- %s [%s] %s (confidence=%.2f): %s", role, F.col("severity"), F.col("risk_type"), F.col("confidence"), F.col("reason"))
    listed = lambda name, c: F.when(F.size(c) > 0, F.concat(F.lit(f"\n  {name}: "), F.array_join(c, ", ")))
    asked = F.when(F.col("finding_role") == "hypothesis", listed("🔍 建议搜索验证", F.col("verification_required")))
    lines = findings.select(F.col(key).alias("__k"), F.col(order).alias("o"), F.concat_ws("", head, asked, listed("法规依据", F.col("legal_basis"))).alias("line"))
    texts = lines.groupBy("__k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "line"))), lambda x: x["line"]), "\n").alias("summary"))
    return clauses.join(texts, F.col(key) == F.col("__k"), "left").drop("__k").withColumn("summary", F.coalesce("summary", F.lit("（无）")))


def injection_chunks(hits: DataFrame, gold: DataFrame, fallback: DataFrame, doc: str = "document_id") -> DataFrame:
    """(doc, chunk_id): for each query of a document its best hit whose snippet holds a gold quotation, or is held by one, or
    that starts on a gold page or the page before it; hits are (doc, query, rank, chunk_id, snippet, page_start from 0) and
    gold rows are (doc, page_number from 1, source_quote). A document where no query finds one takes the best hits of
    `fallback` that name it and its additional clauses. A document's hits meet its own gold rows alone."""
    bare = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "(?U)\\s+", "")
    g = gold.select(F.col(doc).alias("__d"), F.col("page_number").alias("__p"), bare(F.col("source_quote")).alias("__q")).distinct()
    s = bare(F.col("snippet"))
    quoted = (s != "") & (F.col("__q") != "") & (F.contains(s, F.col("__q")) | F.contains(F.col("__q"), s))
    near = hits.join(g, (F.col(doc) == F.col("__d")) & (quoted | (F.col("__p") - F.col("page_start")).isin(1, 2)), "left_semi")
    best = lambda rows: rows.groupBy(doc, "query").agg(F.min_by("chunk_id", F.struct("rank", "chunk_id")).alias("chunk_id")).select(doc, "chunk_id").distinct()
    found = best(near)
    named = fallback.filter((bare(F.col(doc)) != "") & F.contains(s, bare(F.col(doc))) & F.contains(s, F.lit("补充条款")))
    return found.unionByName(best(named.join(found.select(doc), doc, "left_anti")))


_DATE = regex.compile(r"\p{Nd}{4}年\p{Nd}{1,2}月\p{Nd}{1,2}日|\[日期\]")
_OTHER = regex.compile(r"[^\p{Alphabetic}\p{N}]+")


def likeness(a: str | None, b: str | None) -> float:
    """`T.evidence_similarity` of two strings."""
    a, b = (a or "").strip(), (b or "").strip()
    if not a or not b:
        return 0.0
    x, y = (_DATE.sub("日期", t).replace(" ", "") for t in (a, b))
    if a in b or b in a or x in y or y in x:
        return 1.0
    p, q = ({t[i : i + 3] for i in range(len(t) - 2)} for t in (_OTHER.sub("", x), _OTHER.sub("", y)))
    return len(p & q) / len(p | q) if p and q else 0.0


#: Lists that a merged finding unites with those of the finding that joins it.
UNITED = "clause_ids hypothesized_by verified_by"


def _absorb(head: dict, row: dict, order: str, laws: bool) -> None:
    for name in UNITED.split() + ["legal_basis"] * (laws and row["confidence"] > head["confidence"]):
        head[name] = list(dict.fromkeys([*head[name], *row[name]]))
    if row["is_critical"]:
        own, more = head["critical_reason"].strip(), row["critical_reason"].strip()
        head["critical_reason"] = more if not own else own if more in own else f"{own}；{more}"
        head["is_critical"], head["severity"] = True, "high"
    if row["confidence"] > head["confidence"]:
        both = f"{head['reason'].strip()}\n\n[补充验证 — {row['agent']}]: {row['reason'].strip()}"
        head["reason"] = both if len(both) <= 800 else both[:797] + "…"
        head["suggestion"], head["confidence"] = row["suggestion"], row["confidence"]
    head["merged"] = [*head["merged"], row[order], *row["merged"]]


def _fold(rows: Iterable[dict], order: str, least: float, laws: bool) -> list[dict]:
    heads: list[dict] = []
    at = defaultdict(list)
    for row in rows:
        near = sorted({h for c in row["clause_ids"] for h in at[c]})
        head = next((h for h in near if likeness(heads[h]["source_quote"], row["source_quote"]) >= least), None)
        known = set() if head is None else set(heads[head]["clause_ids"])
        if head is None:
            head = len(heads)
            heads.append(row)
        else:
            _absorb(heads[head], row, order, laws)
        for c in dict.fromkeys(row["clause_ids"]):
            if c not in known:
                at[c].append(head)
    return heads


def merge_findings(findings: DataFrame, keys: list[str], order: str, stages: tuple[float, float] = (0.70, 0.65)) -> DataFrame:
    """The findings that stay, with the order values of those that joined them in `merged`.

    In order, a finding joins the first earlier one of its keys (document and category) that shares a clause and has similar
    evidence, or stays; what stays of the first stage goes through the second. Clauses and contributors are united. A more confident
    finding adds its reason, and in the first stage its laws, and gives its suggestion and confidence. Rows come sorted to a
    task and are folded as they pass, so a task holds what stays of one document's category, and a finding is compared with
    those of its clauses alone. Null lists are empty, null texts empty, a null confidence is 0; findings without a clause all stay.
    `order` is unique within the keys. Needs the columns clause_ids, source_quote, confidence, agent, reason, suggestion,
    severity, legal_basis, hypothesized_by, verified_by, is_critical and critical_reason; others stay as they are."""
    empty = lambda c, kind: F.coalesce(F.col(c), F.lit(kind) if not isinstance(kind, list) else F.array().cast("array<string>")).alias(c)
    usual = dict.fromkeys(("clause_ids", "legal_basis", "hypothesized_by", "verified_by"), []) | dict.fromkeys(("source_quote", "reason", "agent", "critical_reason"), "") | {"confidence": 0.0, "is_critical": False}
    rows = findings.select(*(empty(c, usual[c]) if c in usual else F.col(c) for c in findings.columns))
    kind = findings.schema[order].dataType.simpleString()
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", merged array<{kind}>"

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def plain(row: dict) -> dict:
            return {k: list(v) if hasattr(v, "tolist") and getattr(v, "ndim", 0) else v for k, v in row.items()} | {"merged": []}

        def place(row: dict) -> tuple:
            return tuple(None if pd.isna(row[k]) else row[k] for k in keys)

        ready: list[dict] = []
        for _, group in groupby((plain(r) for b in batches for r in b.to_dict("records")), place):
            first = _fold(group, order, stages[0], True)
            ready += _fold(first, order, stages[1], False)
            if len(ready) >= 1000:
                yield pd.DataFrame(ready)
                ready = []
        if ready:
            yield pd.DataFrame(ready)

    return rows.repartition(*keys).sortWithinPartitions(*keys, order).mapInPandas(merge, schema)


def checked_outputs(outputs: DataFrame, key: str, payload: str, most: int = 5) -> DataFrame:
    """(key, pos, severity, category_code, source_quote, confidence, error): each finding of a reviewer's output by itself.

    A payload is JSON with an array `findings`. A finding that is no object, lacks its quotation, is of no known severity or category,
    has no confidence from 0 to 1, or is high below 0.6, is a row with the reason; so is each one past the first `most`. A
    payload that is no JSON or has no such array is a row with pos -1; an empty array gives none. The good ones of a payload stay,
    whatever the others are."""
    parsed = outputs.select(key, F.try_parse_json(payload).alias("__j"))
    listed = parsed.select(key, F.try_variant_get("__j", "$.findings", "array<variant>").alias("__f"), F.col("__j").isNull().alias("__bad"))
    broken = listed.filter(F.col("__f").isNull()).select(key, F.lit(-1).alias("pos"), F.lit(None).cast("variant").alias("__e"), F.when(F.col("__bad"), "no JSON").otherwise("no findings").alias("__why"))
    each = listed.select(key, F.posexplode_outer("__f").alias("pos", "__e")).filter("pos IS NOT NULL").select(key, "pos", "__e", F.lit(None).cast("string").alias("__why"))
    kinds = {"severity": "string", "category_code": "string", "source_quote": "string", "confidence": "double"}
    rows = broken.union(each).withColumns({c: F.try_variant_get("__e", f"$.{c}", kind) for c, kind in kinds.items()})
    object_ = F.coalesce(F.schema_of_variant("__e").startswith("OBJECT"), F.lit(False))
    error = F.coalesce(
        F.col("__why"),
        F.when(F.col("pos") >= most, "too many"),
        F.when(~object_, "no object"),
        F.when(F.trim(F.coalesce("source_quote", F.lit(""))) == "", "no quotation"),
        F.when(~F.coalesce(F.col("severity").isin(list(rules.SEVERITIES)), F.lit(False)), "unknown severity"),
        F.when(~F.coalesce(F.col("category_code").isin([c for c, *_ in rules.CATEGORIES] + ["OTHER"]), F.lit(False)), "unknown category"),
        F.when(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "no confidence"),
        F.when((F.col("severity") == "high") & (F.col("confidence") < 0.6), "high without confidence"),
    )
    return rows.select(key, "pos", *kinds, error.alias("error"))
