"""Operators on ordered rows within a group (a document, a session, a conversation)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def over(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def neighbours(df: DataFrame, keys: list[str], order: list[str], text: str, most: int = 200) -> DataFrame:
    """The snippets before and after each row."""
    w = over(keys, order)
    return df.withColumn("previous", F.substring(F.lag(text).over(w), 1, most)).withColumn("next", F.substring(F.lead(text).over(w), 1, most))


def sequential_ids(df: DataFrame, keys: list[str], order: list[str], pattern: str = "ch_%03d") -> DataFrame:
    return df.withColumn("id", F.format_string(pattern, F.row_number().over(over(keys, order)) - 1))


def tail(df: DataFrame, keys: list[str], order: str, most: int) -> DataFrame:
    """The last `most` rows of each group."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= most).drop("__n")


def islands(df: DataFrame, keys: list[str], number: str) -> DataFrame:
    """Runs of consecutive numbers: keys, first, last and size of each."""
    distinct = df.select(*keys, number).distinct()
    w = over(keys, [number])
    return distinct.withColumn("__k", F.col(number) - F.row_number().over(w)).groupBy(*keys, "__k").agg(F.min(number).alias("first"), F.max(number).alias("last"), F.count(F.lit(1)).alias("size")).drop("__k")


def runs(df: DataFrame, keys: list[str], order: list[str], shape: str, least: int = 2) -> DataFrame:
    """Adjacent rows of one shape, at least `least`: keys, run number, shape, size, first and last of the first order column."""
    w = over(keys, order)
    changed = F.when(F.lag(shape).over(w).eqNullSafe(F.col(shape)), 0).otherwise(1)
    numbered = df.withColumn("__c", changed).withColumn("run", F.sum("__c").over(w))
    found = numbered.groupBy(*keys, "run").agg(F.first(shape).alias(shape), F.count(F.lit(1)).alias("size"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"))
    return found.filter(F.col("size") >= least)


def next_boundary(df: DataFrame, keys: list[str], order: str, level: str, levels: int) -> DataFrame:
    """For each row the first later row of the same or a lower level: a window for each level, no self join."""
    ahead = over(keys, [order]).rowsBetween(1, Window.unboundedFollowing)
    per_level = [F.min(F.when(F.col(level) <= k, F.col(order))).over(ahead) for k in range(levels + 1)]
    return df.withColumn("boundary", F.element_at(F.array(*per_level), F.col(level).cast("int") + 1))


def parent(df: DataFrame, keys: list[str], order: str, level: str, levels: int) -> DataFrame:
    """For each row the nearest earlier row of a lower level."""
    back = over(keys, [order]).rowsBetween(Window.unboundedPreceding, -1)
    per_level = [F.max(F.when(F.col(level) < k, F.col(order))).over(back) for k in range(levels + 1)]
    return df.withColumn("parent", F.element_at(F.array(*per_level), F.col(level).cast("int") + 1))


def covered_days(df: DataFrame, start: Column, end: Column, *keys: str) -> DataFrame:
    """Every number (or day) that a row's interval covers, each once."""
    return df.select(*keys, F.explode(F.sequence(start, end)).alias("covered")).distinct()


def disorder(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Rows whose value lies below the one before: breaks in what should rise."""
    return df.withColumn("before", F.lag(value).over(over(keys, [order]))).filter(F.col("before") > F.col(value))


def first_occurrence_numbers(df: DataFrame, keys: list[str], value: str, place: list[str]) -> DataFrame:
    """Each distinct value of a group with a number by its first occurrence, from 1."""
    firsts = df.groupBy(*keys, value).agg(F.min(F.struct(*place)).alias("__first"))
    return firsts.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("__first", value))).drop("__first")


def overlap_length(df: DataFrame, keys: list[str], order: str, text: str, sizes: tuple[int, ...] = (200, 100, 50, 20)) -> DataFrame:
    """The longest of the tried ends of a part that stands in the next part."""
    after = F.lead(text).over(over(keys, [order]))
    found = F.lit(0)
    for k in sorted(sizes):
        found = F.when((F.char_length(text) >= k) & F.contains(F.col("__after"), F.expr(f"right(`{text}`, {k})")), F.lit(k)).otherwise(found)
    return df.withColumn("__after", after).withColumn("overlap", found).drop("__after")


def complete_splits(df: DataFrame, keys: list[str], part: str, total: str) -> DataFrame:
    """Whether each group's parts are 1 to its total, each once."""
    return df.groupBy(*keys).agg(F.max(total).alias("total"), F.count(F.lit(1)).alias("parts"), ((F.count(F.lit(1)) == F.max(total)) & (F.countDistinct(part) == F.max(total)) & (F.min(part) == 1) & (F.max(part) == F.max(total))).alias("complete"))
