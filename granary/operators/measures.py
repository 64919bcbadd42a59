"""Run metrics and evaluation against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, digits: int = 4) -> Column:
    return F.when(b > 0, F.round(a / b, digits)).otherwise(F.lit(0.0))


def precision_recall(df: DataFrame, actual: Column, predicted: Column, *keys: str) -> DataFrame:
    """tp, fp, fn, precision, recall and F1 of two flags, for each group."""
    counts = df.groupBy(*keys).agg(F.count_if(actual & predicted).alias("tp"), F.count_if(~actual & predicted).alias("fp"), F.count_if(actual & ~predicted).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn)).withColumn("f1", ratio(2 * tp, 2 * tp + fp + fn))


#: Fixed names of severities in labels and predictions.
SEVERITIES = {"critical": "critical 重大 严重", "high": "high 高 高风险", "medium": "medium 中 中风险", "low": "low 低 低风险", "info": "info 提示"}


def folded(c: Column) -> Column:
    """Lower case without white space and punctuation; null is empty."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)[\s\p{P}]+", "")


def severity_group(c: Column) -> Column:
    """The severity that a name stands for; other names stay, none is `unknown`."""
    found = F.when(folded(c) == "", "unknown").otherwise(folded(c))
    for group, names in SEVERITIES.items():
        found = F.when(folded(c).isin(names.split()), group).otherwise(found)
    return found


def type_matches(gold_code: Column, code: Column, gold_type: Column, kind: Column, aliases: Column) -> Column:
    """Whether a prediction is of the gold finding's type: equal codes, or its type contains one of the gold's type, code and
    aliases, or is contained in one."""
    plain = lambda c: F.regexp_replace(folded(c), "^[a-z][0-9]+", "")
    target = folded(kind)
    names = F.concat(F.array(folded(gold_type), folded(gold_code)), F.transform(F.coalesce(aliases, F.array().cast("array<string>")), folded))
    near = F.exists(F.filter(names, lambda n: n != ""), lambda n: F.contains(target, n) | F.contains(n, target))
    return ((plain(gold_code) != "") & (plain(gold_code) == plain(code))) | ((target != "") & near)


def critical_metrics(rows: DataFrame, is_gold: Column, is_found: Column, gold_critical: Column, critical: Column, gold_severity: Column, severity: Column) -> DataFrame:
    """One row of measures over gold findings and predictions, matched ones in one row: shares of critical gold findings that
    were found, found and flagged, and found with their severity; the share of critical predictions that flag a critical
    gold finding; the share of matches with equal severity."""
    both = is_gold & is_found
    count = lambda c: F.count_if(c)
    same = severity_group(gold_severity) == severity_group(severity)
    sums = rows.agg(
        count(is_gold & gold_critical).alias("critical_gold"), count(both & gold_critical).alias("hit"), count(both & gold_critical & critical).alias("flagged"),
        count(is_found & critical).alias("predicted"), count(both & gold_critical & same).alias("same_critical"), count(both & same).alias("same"), count(both).alias("matched"),
    )
    c = F.col
    return sums.select(
        "critical_gold", ratio(c("hit"), c("critical_gold")).alias("detection_recall"), ratio(c("flagged"), c("critical_gold")).alias("flag_recall"), ratio(c("flagged"), c("predicted")).alias("flag_precision"),
        ratio(c("same_critical"), c("critical_gold")).alias("severity_recall"), ratio(c("same"), c("matched")).alias("severity_agreement"),
    )


def release_gate(metrics: DataFrame, **least: float) -> DataFrame:
    """Whether every named metric reaches its threshold."""
    good = F.lit(True)
    for name, x in least.items():
        good = good & (F.col(name) >= x)
    return metrics.withColumn("gate", good)


def histogram(df: DataFrame, value: str, edges: list[int]) -> DataFrame:
    """Rows in each bucket [edge, next edge), empty buckets included; the last one is open."""
    spark = df.sparkSession
    bounds = list(zip(edges, [*edges[1:], None]))
    buckets = spark.createDataFrame([(i, lo, hi) for i, (lo, hi) in enumerate(bounds)], "bucket int, low long, high long")
    which = F.lit(None).cast("int")
    for i, (lo, hi) in enumerate(bounds):
        inside = F.col(value) >= lo if hi is None else (F.col(value) >= lo) & (F.col(value) < hi)
        which = F.when(inside, F.lit(i)).otherwise(which)
    counted = df.select(which.alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    return buckets.join(counted, "bucket", "left").select("bucket", "low", F.coalesce("n", F.lit(0)).alias("n"))


def size_statistics(df: DataFrame, size: Column, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("total"), F.round(F.avg(size), 1).alias("mean"), F.max(size).alias("largest"), F.min(size).alias("smallest"))


def cost(model: Column, tokens_in: Column, tokens_out: Column, prices: dict[str, tuple[float, float]], default: tuple[float, float]) -> Column:
    """Cost by prices for a million tokens in and out; the first name that the model contains counts."""
    price_in, price_out = F.lit(default[0]), F.lit(default[1])
    for name, (a, b) in reversed(prices.items()):
        fits = F.contains(F.lower(model), F.lit(name))
        price_in, price_out = F.when(fits, F.lit(a)).otherwise(price_in), F.when(fits, F.lit(b)).otherwise(price_out)
    return (tokens_in * price_in + tokens_out * price_out) / 1e6


def call_report(calls: DataFrame) -> DataFrame:
    """By agent: calls, tokens, most turns, mean duration, calls without a finding and their share, tools by use."""
    tools = calls.select("agent_name", F.explode("tools_called").alias("tool")).groupBy("agent_name", "tool").agg(F.count(F.lit(1)).alias("n"))
    tools = tools.groupBy("agent_name").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tool", "n")))).alias("tools"))
    found = calls.groupBy("agent_name").agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens_input").alias("tokens_input"), F.sum("tokens_output").alias("tokens_output"), F.max("turn").alias("max_turn"), F.round(F.avg("duration_ms"), 2).alias("mean_ms"), F.count_if(~F.col("produced_finding")).alias("wasted"))
    return found.withColumn("wasted_share", ratio(F.col("wasted"), F.col("calls"), 2)).join(tools, "agent_name", "left")


def dedup_rate(raw: Column, after: Column) -> Column:
    return F.when(raw > 0, F.round((raw - after) / raw, 2)).otherwise(F.lit(0.0))


def recall_by(gold: DataFrame, matches: DataFrame, key: str, group: str) -> DataFrame:
    """Recall of each group of gold rows, groups without a match included."""
    hit = matches.select(F.col(key).alias("__key")).distinct()
    return gold.join(hit, F.col(key) == F.col("__key"), "left").groupBy(group).agg(F.count(F.lit(1)).alias("gold"), F.count("__key").alias("hit")).withColumn("recall", ratio(F.col("hit"), F.col("gold")))


def shared_items(df: DataFrame, owner: str, items: str) -> DataFrame:
    """One row: distinct items, those that several owners have, and their percentage."""
    per = df.select(owner, F.explode(items).alias("i")).groupBy("i").agg(F.countDistinct(owner).alias("owners"))
    return per.agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("owners") > 1).alias("shared")).withColumn("percent", ratio(100.0 * F.col("shared"), F.col("items"), 2))


def run_summaries(runs: DataFrame, fields: dict[str, str], order: str) -> DataFrame:
    """Chosen fields of nested run documents, newest first."""
    return runs.select(*(F.col(path).alias(name) for name, path in fields.items())).orderBy(F.desc(order))


def splits(df: DataFrame, index: str, train: int, dev: int) -> DataFrame:
    """A split by a running index: the first rows train, the next ones dev, the others test."""
    i = F.col(index)
    return df.withColumn("split", F.when(i <= train, "train").when(i <= train + dev, "dev").otherwise("test"))


def paired(df: DataFrame, index: str, variants: DataFrame, number: str) -> DataFrame:
    """Rows with their variant in turn; `variants` are numbered from 0 without gaps."""
    n = variants.count()
    turn = F.pmod(F.col(index), F.lit(max(1, n)))
    return df.join(F.broadcast(variants) if n <= 10_000 else variants, turn == F.col(number))


def marks(df: DataFrame, **conditions: Column) -> DataFrame:
    """One row: rows, and for each named condition how many meet it and whether any does."""
    return df.agg(F.count(F.lit(1)).alias("rows"), *(x for k, c in conditions.items() for x in (F.count_if(c).alias(k), F.coalesce(F.bool_or(c), F.lit(False)).alias(f"any_{k}"))))


def run_progress(runs: DataFrame, status: str, seconds: str) -> DataFrame:
    return runs.agg(F.count_if(F.col(status) == "completed").alias("completed"), F.count_if(F.col(status) == "failed").alias("failed"), F.round(F.sum(seconds), 1).alias("seconds"))


def trace_names(events: DataFrame, agent: str, clause: str) -> DataFrame:
    """(kind, name): the different agents and clauses of a trace, without empty and null ones."""
    kinds = F.array(F.struct(F.lit("agents").alias("kind"), F.col(agent).cast("string").alias("name")), F.struct(F.lit("clauses").alias("kind"), F.col(clause).cast("string").alias("name")))
    return events.select(F.explode(kinds).alias("x")).select("x.*").filter("name <> ''").distinct()
