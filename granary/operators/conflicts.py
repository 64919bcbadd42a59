"""Clauses of a document that contradict each other, by four rules in order: the first that holds names the pair.

1. upgrade: one clause sets a threshold, the other rewards what exceeds it
2. logic: one has the first side of a pair of phrases, the other the second side, without the first
3. data: both speak of one subject and have numbers that differ by over 1 and by under a hundredfold
4. dangling: one refers elsewhere by a phrase that the other hasn't

What the rules look at is a clause's signature: a few bits and, where it speaks of a subject, its numbers. Clauses of a document
with one signature contradict the same others, so signatures are compared, not clauses, and of those with one signature no
more than the first few can be among a clause's first partners. Partners are looked for in the document's order, in blocks of
doubling size, and a signature that has enough of them leaves; what is left of a document's pairs is thus met only where
there are few contradictions.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.operators.rules import CONFLICTS
from granary.session import shared_folder


@dataclass(frozen=True)
class Words:
    """Fixed words of the rules. A level's place in its list is its rank; the first that a text has counts."""

    thresholds: list[str] = field(default_factory=lambda: ["资质", "等级", "资格", "门槛"])
    rewards: list[str] = field(default_factory=lambda: ["加分", "评分", "优先", "额外"])
    levels: list[tuple[str, int]] = field(default_factory=lambda: [("一级", 1), ("二级", 2), ("三级", 3), ("甲级", 1), ("乙级", 2), ("丙级", 3)])
    pairs: list[tuple[str, str]] = field(default_factory=lambda: list(CONFLICTS))
    subjects: list[str] = field(default_factory=lambda: ["保证金", "合同金额", "预算", "付款", "预付款", "质保金", "履约"])
    references: list[str] = field(default_factory=lambda: ["详见", "参照", "按照", "参见", "见附件", "见附表"])


def _bits(tests: list[Column]) -> Column:
    return sum((F.when(t, F.lit(1 << i)).otherwise(F.lit(0)) for i, t in enumerate(tests)), F.lit(0))


def signature(text: Column, words: Words) -> Column:
    """What the rules look at in a text."""
    t = F.lower(text)
    has = lambda w: F.contains(t, F.lit(w.lower()))
    subjects = _bits([has(w) for w in words.subjects])
    level = T.cascade(F.lit(0), [(has(w), F.lit(n)) for w, n in words.levels])
    return F.struct(
        T.any_of(t, [w.lower() for w in words.thresholds]).alias("threshold"),
        T.any_of(t, [w.lower() for w in words.rewards]).alias("reward"),
        level.alias("level"),
        _bits([has(n) for n, _ in words.pairs]).alias("no"),
        _bits([has(p) & ~has(n) for n, p in words.pairs]).alias("yes"),
        subjects.alias("subjects"),
        F.when(subjects > 0, F.array_sort(F.array_distinct(T.numbers_in(t)))).otherwise(F.array().cast("array<double>")).alias("numbers"),
        _bits([has(w) for w in words.references]).alias("references"),
    )


def number_conflict(a: Column, b: Column) -> Column:
    """Whether two arrays of positive numbers have a pair that differs by over 1 and by under a hundredfold."""
    return F.exists(a, lambda x: F.exists(b, lambda y: (F.abs(x - y) > 1) & (F.greatest(x, y) / F.least(x, y) < 100)))


def contradiction(a: Column, b: Column) -> Column:
    """The first rule that holds for two signatures, or null; `upgrade_level` where the levels say so too."""
    upgrade = a["threshold"] & b["reward"]
    levels = (a["level"] > 0) & (b["level"] > 0) & (a["level"] > b["level"])
    logic = (a["no"].bitwiseAND(b["yes"]) != 0) | (b["no"].bitwiseAND(a["yes"]) != 0)
    data = (a["subjects"].bitwiseAND(b["subjects"]) != 0) & number_conflict(a["numbers"], b["numbers"])
    dangling = a["references"].bitwiseAND(F.bitwise_not(b["references"])) != 0
    return F.when(upgrade, F.when(levels, "upgrade_level").otherwise("upgrade")).when(logic, "logic").when(data, "data").when(dangling, "dangling")


def contradictions(clauses: DataFrame, doc: str, key: str, text: str, words: Words | None = None, most: int = 10, block: int = 64) -> DataFrame:
    """(doc, a, b, rule): for each clause `a` the first `most` clauses of its document, by `key`, that contradict it.

    `key` is unique in a document. Null texts contradict nothing. A document's signatures are compared with each other in
    blocks of its order, as the module says; a signature's clauses meet their partners, at most `most` + 1, by its hash."""
    spark, words = clauses.sparkSession, words or Words()
    rows = clauses.filter(F.col(text).isNotNull()).select(F.col(doc).alias("doc"), F.col(key).alias("key"), signature(F.col(text), words).alias("sig")).withColumn("id", F.xxhash64("sig"))
    path = shared_folder(spark, "signatures")
    rows.write.parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    first = Window.partitionBy("doc", "id").orderBy("key")
    heads = rows.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= most + 1).select("doc", "key", "id", "sig")
    heads = heads.withColumn("place", F.row_number().over(Window.partitionBy("doc").orderBy("key")))
    left = rows.groupBy("doc", "id").agg(F.first("sig").alias("sig"))
    longest = heads.agg(F.max("place")).first()[0] or 0
    low, found = 0, None
    while low < longest:
        part = heads.filter((F.col("place") > low) & (F.col("place") <= low + block)).select("doc", F.col("key").alias("b"), F.col("sig").alias("other"))
        hits = left.join(part, "doc").withColumn("rule", contradiction(F.col("sig"), F.col("other"))).filter("rule IS NOT NULL").select("doc", "id", "b", "rule")
        path = shared_folder(spark, "contradictions")
        hits.write.parquet(path)
        hits = spark.read.schema(hits.schema).parquet(path)
        found = hits if found is None else found.union(hits)
        enough = found.groupBy("doc", "id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most)
        left = left.join(enough, ["doc", "id"], "left_anti")
        low, block = low + block, 2 * block
    if found is None:
        return rows.select(F.col("doc").alias(doc), F.col("key").alias("a"), F.col("key").alias("b"), F.lit("").alias("rule")).filter(F.lit(False))
    foremost = found.withColumn("n", F.row_number().over(Window.partitionBy("doc", "id").orderBy("b"))).filter(F.col("n") <= most + 1).drop("n")
    partners = foremost.groupBy("doc", "id").agg(F.array_sort(F.collect_list(F.struct("b", "rule"))).alias("partners"))
    mine = F.slice(F.filter("partners", lambda p: p["b"] != F.col("key")), 1, most)
    each = rows.select("doc", "key", "id").join(partners, ["doc", "id"]).select("doc", F.col("key").alias("a"), F.explode_outer(mine).alias("p")).filter("p IS NOT NULL")
    return each.select(F.col("doc").alias(doc), "a", "p.b", "p.rule")
