"""URL filter by the ratio of two character language models.

Rules decide first. A rule names a host with all its subdomains and the start of a path, and the longest rule that fits
wins. Where no rule fits, smoothed variable-order Markov models decide: one of accepted and one of rejected URLs, each
with the contexts of up to `ORDER` characters that occur often enough, interpolated from the longest known context down
by Witten-Bell weights. The score is the difference of the log likelihoods for each character, and a URL is blocked when
its score lies below a threshold: 0, or lower where needed so that at most about `FALSE_BLOCKS` of the accepted URLs that were
kept from training for this calibration would be blocked.

The models learn from the table itself: URLs whose host has one of the seed words of spam as a word of its own (letters
between other characters) are rejected ones, the others accepted ones; what a rule says is about places, not about the make
of a URL, and labels only if no URL has a seed word. Counts cover all URLs and are summed within tasks first. Each model
keeps, for each length, the grams that make up a `SHARE`-th or more of all its grams of that length, so at most `SHARE` of
them at any size of the table and whatever the other model holds, and the exact totals of their contexts. That is what a
variable order means here: rarer contexts fall back on shorter ones, and what a kept context has in grams that are not kept
falls back as well, so the probabilities of all characters still sum to one.

Null URLs and URLs without `://` have an empty host and path, fit no rule, and are allowed. URLs of any length are judged
whole. A score equal to the threshold is allowed; of rules that fit equally long ones cannot differ. Rows repeat as they
come; additional columns pass through `judge` in its column `row`. Without rejected or without accepted URLs the models
allow everything; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import common
from granary.session import ship, table

ORDER = 5
#: A gram is kept when it makes up one in so many of its model's grams of its length, or more.
SHARE = 20_000
FALSE_BLOCKS = 0.01
ALPHABET = 128
SEEDS = ("spam", "pills", "casino", "bets", "viagra", "porn", "xxx", "lottery", "payday")


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    block: bool

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("com", "/en/", True),
    Rule("example.com", "/en/7", False),
    Rule("net", "/de/", False),
    Rule("example.net", "/de/8", True),
    Rule("org", "/es/", True),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), upper, lower), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(rules: tuple[Rule, ...], host: Column, path: Column) -> tuple[Column, Column]:
    """Name and block flag of the longest rule that fits, or nulls."""
    name, block = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, block = F.when(fits, F.lit(r.name)).otherwise(name), F.when(fits, F.lit(r.block)).otherwise(block)
    return name, block


def symbols(url: str) -> str:
    """The characters that the models see: digits alike, between a start and an end mark."""
    return "\x02" + re.sub("[0-9]", "0", url.lower()) + "\x03"


def grams(text: str) -> Iterator[str]:
    for i in range(1, len(text)):
        for k in range(min(i, ORDER) + 1):
            yield text[i - k : i + 1]


@dataclass
class Markov:
    """Counts of grams (a context and the character after it), and of contexts: all their uses, different characters and
    uses in kept grams."""

    counts: dict[str, int] = field(default_factory=dict)
    total: dict[str, int] = field(default_factory=dict)
    kinds: dict[str, int] = field(default_factory=dict)
    held: dict[str, int] = field(default_factory=dict)
    memo: dict[str, float] = field(default_factory=dict)

    def add(self, gram: str, n: int) -> None:
        self.counts[gram] = n
        self.held[gram[:-1]] = self.held.get(gram[:-1], 0) + n

    def context(self, context: str, total: int, kinds: int) -> None:
        self.total[context], self.kinds[context] = total, kinds

    def probability(self, gram: str) -> float:
        found = self.memo.get(gram)
        if found is None:
            context = gram[:-1]
            shorter = self.probability(gram[1:]) if context else 1 / ALPHABET
            n, kinds = self.total.get(context, 0), self.kinds.get(context, 0)
            found = (self.counts.get(gram, 0) + (kinds + n - self.held.get(context, 0)) * shorter) / (n + kinds) if n else shorter
            if len(self.memo) > 500_000:
                self.memo.clear()
            self.memo[gram] = found
        return found

    def log_likelihood(self, text: str) -> float:
        return math.fsum(math.log(self.probability(text[max(0, i - ORDER) : i + 1])) for i in range(1, len(text)))


@dataclass
class Model:
    accepted: Markov
    rejected: Markov
    threshold: float = -math.inf

    def score(self, url: str) -> float:
        text = symbols(url)
        return (self.accepted.log_likelihood(text) - self.rejected.log_likelihood(text)) / (len(text) - 1)


def fit_counts(urls: DataFrame) -> tuple[Markov, Markov]:
    """Models of the rows (url, bad)."""
    schema = pa.schema([("gram", pa.string()), ("bad", pa.bool_()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for url, bad in zip(common.texts(batch, "url"), batch.column(1).to_pylist()):
                seen.update((g, bad) for g in grams(symbols(url)))
            if len(seen) > 200_000:
                yield common.out(schema, gram=[g for g, _ in seen], bad=[b for _, b in seen], n=list(seen.values()))
                seen.clear()
        yield common.out(schema, gram=[g for g, _ in seen], bad=[b for _, b in seen], n=list(seen.values()))

    counts = common.written(common.map_batches(urls.select("url", "bad"), count, "gram string, bad boolean, n long").groupBy("gram", "bad").agg(F.sum("n").alias("n")), "url-grams")
    size = F.length("gram")
    sums = {(r["bad"], r["size"]): r["n"] for r in counts.groupBy("bad", size.alias("size")).agg(F.sum("n").alias("n")).collect()}

    def least(bad: Column, length: Column) -> Column:
        """The uses from which on a gram of this length is kept."""
        found = F.lit(1.0)
        for (b, k), n in sums.items():
            found = F.when((bad == F.lit(b)) & (length == k), F.lit(n / SHARE)).otherwise(found)
        return found

    models = Markov(), Markov()
    for r in counts.filter(F.col("n") >= least(F.col("bad"), size)).toLocalIterator():
        models[r["bad"]].add(r["gram"], r["n"])
    contexts = counts.groupBy("bad", F.expr("substring(gram, 1, length(gram) - 1)").alias("context")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds"))
    for r in contexts.filter(F.col("n") >= least(F.col("bad"), F.length("context") + 1)).toLocalIterator():
        models[r["bad"]].context(r["context"], r["n"], r["kinds"])
    return models


def scored(urls: DataFrame, model: Model, into: str = "score") -> DataFrame:
    """`urls` with the score of the column url; null for null URLs."""
    shared = urls.sparkSession.sparkContext.broadcast(model)
    names = urls.columns
    place = names.index("url")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Model = shared.value
        for batch in batches:
            got = [None if u is None else held.score(u) for u in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.float64())], names=[*names, into])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in urls.schema)
    return common.map_batches(urls, score, f"{kinds}, `{into}` double")


def train(urls: DataFrame, rules: tuple[Rule, ...] = RULES, seeds: tuple[str, ...] = SEEDS, false_blocks: float = FALSE_BLOCKS) -> Model:
    """A calibrated model from the column url of all rows."""
    host, path = host_and_path(F.col("url"))
    _, block = rule_of(rules, host, path)
    spam = F.lit(False)
    for s in seeds:
        spam = spam | host.rlike(f"(^|[^a-z]){s}($|[^a-z])")
    rows = urls.filter(F.col("url").isNotNull() & (host != "")).select("url", spam.alias("bad"), F.coalesce(block, F.lit(False)).alias("ruled"), (F.pmod(F.crc32(F.col("url").cast("binary")), F.lit(5)) == 0).alias("kept"))
    if not rows.filter("bad").head(1):
        rows = rows.withColumn("bad", F.col("ruled"))
    accepted, rejected = fit_counts(rows.filter(~F.col("kept")))
    model = Model(accepted, rejected)
    if accepted.counts and rejected.counts:
        held = scored(rows.filter(F.col("kept") & ~F.col("bad")).select("url"), model)
        found = held.agg(F.percentile_approx("score", false_blocks, 10_000)).first()[0]
        model.threshold = -math.inf if found is None else min(0.0, found)
    return model


def judge(pages: DataFrame, model: Model, rules: tuple[Rule, ...] = RULES, url: str = "url") -> DataFrame:
    """(row, host, path, rule, score, verdict) of every row; `row` holds all columns of `pages`."""
    rows = pages.select(F.struct(*(F.col(f"`{c}`") for c in pages.columns)).alias("row"), F.col(url).alias("url"))
    host, path = host_and_path(F.col("url"))
    name, block = rule_of(rules, F.col("host"), F.col("path"))
    rows = scored(rows, model).withColumn("host", host).withColumn("path", path)
    rows = rows.select("row", "host", "path", name.alias("rule"), block.alias("by_rule"), "score")
    bad = F.coalesce("by_rule", (F.col("host") != "") & (F.col("score") < F.lit(model.threshold)), F.lit(False))
    return rows.select("row", "host", "path", "rule", "score", F.when(bad, "block").otherwise("allow").alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(ship(spark), sf_dir, "pages").select("page_id", "url")
    return judge(pages, train(pages)).select("row.page_id", "host", "path", "rule", "verdict", "score")
