"""Listing, statistics and state operators over tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def where_given(df: DataFrame, *conditions: Column | None) -> DataFrame:
    """Rows that meet every condition that is given."""
    given = [c for c in conditions if c is not None]
    return df.filter(reduce(lambda a, b: a & b, given)) if given else df


def between_days(column: str, first: str | None, last: str | None) -> Column | None:
    """The days from `first` to the whole of `last`; either may be open."""
    parts = []
    if first is not None:
        parts.append(F.col(column) >= F.lit(first).cast("timestamp"))
    if last is not None:
        parts.append(F.col(column) < F.date_add(F.lit(last).cast("date"), 1).cast("timestamp"))
    return reduce(lambda a, b: a & b, parts) if parts else None


def keyword(columns: list[str], word: str | None) -> Column | None:
    """Whether one of the columns contains the word in any case; no word, no condition."""
    if not word:
        return None
    return reduce(lambda a, b: a | b, [F.contains(F.lower(F.col(c)), F.lit(word.lower())) for c in columns])


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page of the ordered rows; filters belong before it, so that totals and pages agree."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def counts_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def count_total_and(df: DataFrame, **conditions: Column) -> DataFrame:
    """One row: all rows, and those that meet each named condition."""
    return df.agg(F.count(F.lit(1)).alias("total"), *(F.count_if(c).alias(k) for k, c in conditions.items()))


def counts_with_total(df: DataFrame, column: str) -> DataFrame:
    """Counts by a column with a row `all` for the total."""
    return df.rollup(column).agg(F.count(F.lit(1)).alias("n"), F.grouping(column).alias("g")).select(F.when(F.col("g") == 1, F.lit("all")).otherwise(F.col(column)).alias("status"), "n")


def week_counts(df: DataFrame, ts: str, day: str) -> DataFrame:
    """Rows on each day of the week (from Monday) that holds `day`, zeros included."""
    monday = F.date_trunc("week", F.lit(day).cast("timestamp")).cast("date")
    spark = df.sparkSession
    days = spark.range(1).select(F.explode(F.sequence(monday, F.date_add(monday, 6))).alias("day"))
    counted = df.filter((F.col(ts) >= monday.cast("timestamp")) & (F.col(ts) < F.date_add(monday, 7).cast("timestamp"))).groupBy(F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return days.join(counted, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def extreme_per_group(df: DataFrame, keys: list[str], order: list[str], latest: bool = True) -> DataFrame:
    """The last (or first) row of each group by a total order, aggregated before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if latest else F.min_by
    rows = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("row"))
    return rows.select(*keys, "row.*")


def latest_with_fallback(df: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """The value of the last row of each key, or of the last row that has one."""
    return df.groupBy(key).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias(value))


def first_and_last(df: DataFrame, key: str, order: str, *values: str) -> DataFrame:
    """Values of the first and last row of each key and the highest order, in one aggregation."""
    return df.groupBy(key).agg(F.max(order).alias(f"last_{order}"), *(F.min_by(v, order).alias(f"first_{v}") for v in values), *(F.max_by(v, order).alias(f"last_{v}") for v in values))


def semi_chain(df: DataFrame, *steps: tuple[DataFrame, str, str]) -> DataFrame:
    """Rows whose key is in the first step's table, which holds only keys of the next step's table, and so on; a step is
    (table, its key, its key into the next table)."""
    inner = None
    for other, key, onward in reversed(steps):
        inner = (other if inner is None else other.join(inner, other[onward] == inner["__key"], "left_semi")).select(F.col(key).alias("__key"))
    own = steps[0][1]
    return df.join(inner, df[own] == inner["__key"], "left_semi")


def orphans(df: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    return df.join(parents.select(F.col(parent_key).alias("__key")), F.col(key) == F.col("__key"), "left_anti")


def level_summary(df: DataFrame, level: Column, critical: Column, levels: list[str]) -> DataFrame:
    """One row: rows of each level, and critical rows whatever their level."""
    return df.agg(*(F.count_if(level == x).alias(x) for x in levels), F.count_if(critical).alias("critical"))


def report_bucket(level: Column, critical: Column) -> Column:
    return F.when(critical, "critical").when(level == "high", "high").when(level.isin("medium", "low"), "warning").otherwise("info")


def verdict(critical: Column, high: Column, warning: Column) -> Column:
    """The overall verdict that bucket counts give."""
    return F.when(critical > 0, "reject").when(high > 0, "revise").when(warning > 0, "pass with remarks").otherwise("pass")


def pass_rate(passed: Column, total: Column) -> Column:
    return F.when(total > 0, F.round(100.0 * passed / total, 1)).otherwise(F.lit(0.0))


def after_cursor(df: DataFrame, key: str, cursor: int, most: int = 100) -> DataFrame:
    """The next rows after a cursor, for replay."""
    return df.filter(F.col(key) > cursor).orderBy(key).limit(most)


def patched(df: DataFrame, patches: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Columns replaced by the patch of the same key where it has a value."""
    named = patches.select(key, *(F.col(c).alias(f"__{c}") for c in columns))
    joined = df.join(named, key, "left")
    return joined.select(*(F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in df.columns))


def without_keys(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return df.join(gone.select(key), key, "left_anti")


def replaced_children(df: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """Rows of the parents in `new` give way to the new ones."""
    return without_keys(df, new.select(parent).distinct(), parent).unionByName(new)


def capped_upsert(df: DataFrame, new: DataFrame, key: str, order: str, most: int = 20) -> DataFrame:
    """New rows replace those of their key; the `most` newest stay."""
    return without_keys(df, new, key).unionByName(new).orderBy(F.desc(order), key).limit(most)


def cascaded(parents: DataFrame, chain: list[tuple[str, DataFrame, str, str]], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """Tables after the parents in `gone` are deleted with all that hangs below: chain entries are (name, table, foreign
    key, own key)."""
    kept = {"parents": without_keys(parents, gone, key)}
    lost = gone.select(F.col(key).alias("__key"))
    for name, child, foreign, own in chain:
        kept[name] = child.join(lost, F.col(foreign) == F.col("__key"), "left_anti")
        lost = child.join(lost, F.col(foreign) == F.col("__key"), "left_semi").select(F.col(own).alias("__key"))
    return kept


def progress_fold(events: DataFrame, key: str, progress: str, status: str, open_states: list[str]) -> DataFrame:
    """The highest progress of each key among events of open states; null counts as 0."""
    return events.groupBy(key).agg(F.coalesce(F.max(F.when(F.col(status).isin(open_states), F.coalesce(progress, F.lit(0)))), F.lit(0)).alias(progress))


def share_of_total(df: DataFrame, value: str, digits: int = 1) -> DataFrame:
    """Each row's percentage of the sum; the sum is one row and is joined, so no window gathers all rows."""
    total = df.agg(F.sum(value).alias("__total"))
    return df.crossJoin(F.broadcast(total)).withColumn("share", F.when(F.col("__total") > 0, F.round(100.0 * F.col(value) / F.col("__total"), digits)).otherwise(0.0)).drop("__total")


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first `k` rows of each group; Spark limits within tasks before it shuffles."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)
