"""Mixing sources to target weights by temperature, with DataFrame operations alone.

A source's share p of all tokens becomes the weight p ** t, normalised. The exponent t lies between 0 (all sources
alike) and 1 (shares as they are) and is found by bisection: the largest t whose weights reach `entropy` times the
entropy of equal weights, raised as far as needed so that no source repeats more than `repeats` times. With no budget
given, the budget is the least that takes every document once, so that mixing adds copies and drops nothing.

The weights are realised by block permutations. A source's documents fall into blocks by a hash of their key; each
epoch goes over the blocks in an order of its own and takes them whole while the source's budget lasts; of the block in
which it ends, it takes the documents whose hash lies below the share that remains. Blocks are counted in advance and
the plan has at most `MAX_BLOCKS` + one row for each source, so it is broadcast; with more sources than that it is
joined by its key. `turn` orders the result: within each source evenly over 0 to 1, so the sources interleave by weight.

Tokens are white-space words, as a tokenizer's ids would need Python. A null source is a source of its own, null texts have no tokens, sources without tokens stay as they are (each
document once). Rows with equal keys fall into one block and are taken together, ties between blocks go by
their number. Texts of any length are counted whole. An empty table gives an empty result.
Additional columns pass through whatever their names are.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.llm import common

ENTROPY, REPEATS = 0.98, 2.0
#: Blocks over all sources, about, and the least tokens of a block.
MAX_BLOCKS, BLOCK_TOKENS = 20_000, 100_000
#: Sources whose shares the driver holds; with more of them each bisection step is an aggregation.
MAX_SOURCES = 100_000


def tokens(column: str):
    """White-space words of a text."""
    return F.coalesce(F.regexp_count(F.col(column), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_shares(docs: DataFrame) -> DataFrame:
    return docs.groupBy("source").agg(F.sum("tokens").alias("tokens"))


class Sums:
    """Sums over sources of functions of p ** t: by the driver for few sources, by aggregation for many."""

    def __init__(self, shares: DataFrame):
        self.shares = shares.filter("tokens > 0")
        got = self.shares.agg(F.count(F.lit(1)), F.sum("tokens"), F.min("tokens"), F.max("tokens")).first()
        self.n, self.total, self.least, self.most = got[0], got[1] or 0, got[2] or 0, got[3] or 0
        self.held = sorted(r["tokens"] for r in self.shares.select("tokens").collect()) if self.n <= MAX_SOURCES else None

    def powers(self, t: float) -> tuple[float, float]:
        """Sum of p ** t and of p ** t * ln(p ** t)."""
        if self.held is not None:
            w = [(x / self.total) ** t for x in self.held]
            return math.fsum(w), math.fsum(x * math.log(x) for x in w)
        w = F.pow(F.col("tokens") / F.lit(float(self.total)), F.lit(t))
        return tuple(self.shares.agg(F.sum(w), F.sum(w * F.log(w))).first())

    def entropy(self, t: float) -> float:
        z, zlog = self.powers(t)
        return math.log(z) - zlog / z


def bisect(holds, low: float = 0.0, high: float = 1.0, steps: int = 50, largest: bool = True) -> float:
    """The largest (or smallest) t in [low, high] where `holds` is true, for a condition that is monotone in t."""
    if holds(high if largest else low):
        return high if largest else low
    for _ in range(steps):
        middle = (low + high) / 2
        if holds(middle) == largest:
            low = middle
        else:
            high = middle
    return low if largest else high


def exponent(sums: Sums, entropy: float = ENTROPY, repeats: float = REPEATS, budget: float | None = None) -> float:
    if sums.n <= 1:
        return 1.0
    t = bisect(lambda x: sums.entropy(x) >= entropy * math.log(sums.n))

    def within(x: float) -> bool:
        if budget is None:
            return (sums.least / sums.most) ** (x - 1) <= repeats
        return budget * (sums.least / sums.total) ** x / sums.powers(x)[0] / sums.least <= repeats

    return max(t, bisect(within, largest=False)) if not within(t) else t


def mix(docs: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: float | None = None, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """Rows (doc, source, tokens, weight, epoch, block, turn): one for each time that a document is taken."""
    base = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")).alias("source"), tokens(text).alias("tokens"), F.xxhash64(F.col(key), F.lit(17)).alias("hash"))
    # Texts are counted once: sources and blocks are summed from this narrow table.
    narrow = common.written(base.select("source", "hash", "tokens"), "mix-tokens")
    shares = source_shares(narrow)
    sums = Sums(shares)
    t = exponent(sums, entropy, repeats, budget)
    z = sums.powers(t)[0] if sums.n else 1.0
    total = F.lit(float(max(1, sums.total)))
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / total, F.lit(t)) / F.lit(z)).otherwise(F.lit(0.0))
    # The budget that takes the least repeated source, the largest one, exactly once.
    whole = budget if budget is not None else (sums.most * z / (sums.most / sums.total) ** t if sums.n else 0.0)
    per_block = max(BLOCK_TOKENS, sums.total // MAX_BLOCKS + 1)
    plan = shares.select("source", weight.alias("weight"), F.when(F.col("tokens") > 0, weight * F.lit(float(whole)) / F.col("tokens")).otherwise(F.lit(1.0)).alias("repeat"), F.ceil((F.col("tokens") + 1) / F.lit(per_block)).alias("blocks"))
    few = shares.limit(MAX_BLOCKS + 1).count() <= MAX_BLOCKS  # sources without tokens have a row of the plan as well

    def held(rows: DataFrame, plan: DataFrame, on: list[str], counted: DataFrame) -> DataFrame:
        """Rows with the plan of their source (and block): broadcast while it is small, else joined by a salted key."""
        if few:
            return rows.join(F.broadcast(plan), on)
        by = F.to_json(F.struct(*on))
        return common.spread_join(rows.withColumn("_on", by), plan.withColumn("_on", by).drop(*on), "_on", ["hash"], counted=counted.select(by.alias("_on"))).drop("_on")

    placed = lambda rows: held(rows, plan, ["source"], narrow).withColumn("block", F.pmod("hash", F.col("blocks")))
    # Tokens of each block, then where each block begins in each epoch's own order.
    counted = placed(narrow).groupBy("source", "block").agg(F.sum("tokens").alias("size"), F.first("repeat").alias("repeat"), F.first("weight").alias("weight"))
    rounds = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.round(F.col("repeat"), 9)) - 1).cast("int")))
    order = Window.partitionBy("source", "epoch").orderBy(F.xxhash64("block", "epoch"), "block")
    epochs = counted.withColumn("epoch", rounds)
    until = F.sum("size").over(order)
    all_tokens = F.sum("size").over(Window.partitionBy("source", "epoch"))
    epochs = epochs.withColumn("before", until - F.col("size")).withColumn("all", all_tokens)
    left = F.round((F.col("repeat") - F.col("epoch")) * F.col("all"), 6) - F.col("before")
    share = F.when(F.col("repeat") - F.col("epoch") >= 1 - 1e-9, F.lit(1.0)).when(F.col("size") == 0, F.when(left > 0, 1.0).otherwise(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), left / F.col("size"))))
    span = F.greatest(F.lit(1.0), F.col("repeat") * F.col("all"))
    taken = epochs.select("source", "block", "epoch", share.alias("share"), ((F.col("epoch") * F.col("all") + F.col("before")) / span).alias("turn")).filter("share > 0")
    plans = taken.groupBy("source", "block").agg(F.array_sort(F.collect_list(F.struct("epoch", "share", "turn"))).alias("plan"))
    rank = F.pmod(F.xxhash64("hash"), F.lit(1_000_000)) / F.lit(1_000_000.0)
    base = placed(base).select("doc", "source", "tokens", "weight", "block", "hash", rank.alias("rank"))
    chosen = held(base, plans, ["source", "block"], placed(narrow).select("source", "block") if not few else narrow)
    chosen = chosen.select("*", F.explode(F.filter("plan", lambda p: F.col("rank") < p["share"])).alias("p"))
    return chosen.select("doc", F.when(F.col("source") != "", F.expr("substring(source, 2)")).alias("source"), "tokens", "weight", F.col("p.epoch").alias("epoch"), "block", F.col("p.turn").alias("turn"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.documents(spark, sf_dir)).select("doc.doc_id", "source", "tokens", "weight", "epoch", "block", "turn")
