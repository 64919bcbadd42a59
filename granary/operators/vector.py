"""Vectors as array<float>: normalisation, exact search, diversified retrieval and quality checks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.session import shared_folder, ship

#: Scores that a task computes at once.
SCORES = 4_000_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalised(v: Column) -> Column:
    """Unit length; a zero vector stays."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    length = norm(a) * norm(b)
    return F.when(length > 0, dot(a, b) / length).otherwise(F.lit(0.0))


def search(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", embedding: str = "embedding", max_queries: int = 50_000) -> DataFrame:
    """The `k` nearest rows of each query (query_id, q) by cosine, ties by key: exact, over all rows.

    The queries are a stated set, broadcast in blocks of about `max_queries` (by a hash, so any number of them can be searched; each
    block is one read of the vectors and is stored). A task multiplies batches of vectors with the block and keeps `k` rows a query:
    what a batch adds are the rows that reach a query's worst kept score. Scores count to 12 decimals, so equal vectors tie. Rows
    and queries without a vector find nothing; a zero vector has score 0."""
    spark = vectors.sparkSession
    ship(spark)
    blocks = -(-queries.count() // max_queries) or 1
    rest = [c for c in vectors.columns if c not in (key, embedding)]
    rows = vectors.select(key, *rest, F.col(embedding).cast("array<double>").alias("__v")).filter("__v IS NOT NULL")
    names, kind = [*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("__v").schema)], queries.schema["query_id"].dataType.simpleString()
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    found = None
    for i in range(blocks):
        some = queries.filter(F.col("q").isNotNull() & (F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)).select("query_id", F.col("q").cast("array<double>").alias("q")).toPandas()
        shared = spark.sparkContext.broadcast((some["query_id"].to_numpy(), _units(some["q"])))
        near = rows.mapInPandas(_nearest(shared, k, key), ", ".join([*names, f"query_id {kind}", "score double"]))
        best = near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
        if blocks > 1:
            path = shared_folder(spark, "nearest")
            best.write.parquet(path)
            best = spark.read.schema(best.schema).parquet(path)
        found = best if found is None else found.unionByName(best)
    return found


def _units(column: pd.Series) -> np.ndarray:
    """A matrix of the vectors at unit length."""
    held = np.array(column.tolist(), np.float64).reshape(len(column), -1)
    length = np.sqrt((held * held).sum(1, keepdims=True))
    return held / np.where(length > 0, length, 1.0)


def _nearest(shared: Broadcast, k: int, key: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The `k` best rows of each query within a task. A step takes on at most 2 * `k` rows a query, whatever its scores: those above
    the step's own k-th score and, of those equal to it, the first by key. What waits is merged before it outgrows what is held."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, wanted = shared.value
        worst = np.full(len(ids), -np.inf)
        held: list[pd.DataFrame] = []

        def merged() -> None:
            both = pd.concat(held, ignore_index=True)
            held.clear()
            both = both.sort_values(["__q", "score", key], ascending=[True, False, True], kind="stable")
            place = both.groupby("__q").cumcount()
            full = both[place == k - 1]
            worst[full["__q"].to_numpy()] = full["score"].to_numpy()
            held.append(both[place < k])

        for rows in batches:
            if not len(ids) or not len(rows):
                continue
            rows = rows.sort_values(key, kind="stable")
            units, rows = _units(rows["__v"]), rows.drop(columns="__v")
            good = ~np.isnan(units).any(1)
            units, rows = units[good], rows[good]
            step = max(1, SCORES // len(ids))
            for a in range(0, len(rows), step):
                scores = np.round(wanted @ units[a : a + step].T, 12) + 0.0
                n = scores.shape[1]
                if n > k:
                    np.maximum(worst, np.partition(scores, n - k, axis=1)[:, n - k], out=worst)
                j, i = np.nonzero(scores >= worst[:, None])
                if not len(j):
                    continue
                found = scores[j, i]
                ties = np.cumsum(found == worst[j])
                starts = np.flatnonzero(np.r_[True, j[1:] != j[:-1]])
                before = np.repeat(np.r_[0, ties[starts[1:] - 1]], np.diff(np.r_[starts, len(j)]))
                taken = (found > worst[j]) | (ties - before <= k)
                j, i, found = j[taken], i[taken], found[taken]
                held.append(rows.iloc[a + i].assign(__q=j, score=found))
                if sum(map(len, held[1:])) > max(len(held[0]), 100_000):
                    merged()
        if held:
            merged()
            best = held[0]
            yield best.assign(query_id=ids[best["__q"].to_numpy()])[[*(c for c in best.columns if c not in ("__q", "score")), "query_id", "score"]]

    return work


def low_scores(hits: DataFrame, least: float = 0.5) -> DataFrame:
    """Queries with a flag when even the best hit is weak."""
    return hits.groupBy("query_id").agg((F.max("score") < least).alias("weak"))


def diversified(hits: DataFrame, group: str, k: int, key: str = "vec_id") -> DataFrame:
    """The best hit of each group first, then the others by score, `k` in all for each query."""
    by_group = Window.partitionBy("query_id", group).orderBy(F.desc("score"), key)
    best = hits.withColumn("is_best", F.row_number().over(by_group) == 1)
    w = Window.partitionBy("query_id").orderBy(F.desc("is_best"), F.desc("score"), key)
    return best.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def stars(score: Column) -> Column:
    return F.when(score >= 0.7, "***").when(score >= 0.5, "**").otherwise("*")


def norm_statistics(vectors: DataFrame, embedding: str = "embedding") -> DataFrame:
    n = norm(F.col(embedding))
    return vectors.select(n.alias("n")).agg(F.min("n").alias("min_norm"), F.max("n").alias("max_norm"), F.avg("n").alias("mean_norm"), F.stddev_pop("n").alias("std_norm"), F.count_if(F.col("n") == 0).alias("zero_vectors"))


def dimension_statistics(vectors: DataFrame, embedding: str = "embedding") -> DataFrame:
    """Population variance of each dimension, whether it is dead, and its share of large values."""
    each = vectors.select(F.posexplode(embedding).alias("dim", "x"))
    return each.groupBy("dim").agg(F.var_pop(F.col("x").cast("double")).alias("variance"), (F.var_pop(F.col("x").cast("double")) < 1e-12).alias("dead"), F.avg(F.when(F.abs("x") > 0.5, 1.0).otherwise(0.0)).alias("large"), F.count_if(F.isnan("x")).alias("nan"))


def separation(vectors: DataFrame, group: str, embedding: str = "embedding") -> DataFrame:
    """Mean cosine of pairs within and across groups, without any pair: the sums of unit vectors give both.

    The sum over all pairs of a set is (|sum of its vectors| ** 2 - sum of squares) / 2."""
    unit = vectors.select(F.col(group).alias("g"), normalised(F.col(embedding)).alias("v"))
    each = unit.select("g", F.posexplode("v").alias("dim", "x"))
    sums = each.groupBy("g", "dim").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("ss"))
    own = sums.groupBy("g").agg(F.sum(F.col("s") * F.col("s")).alias("square"), F.sum("ss").alias("ss")).join(unit.groupBy("g").agg(F.count(F.lit(1)).alias("n")), "g")
    total = sums.groupBy("dim").agg(F.sum("s").alias("s"), F.sum("ss").alias("ss")).agg(F.sum(F.col("s") * F.col("s")).alias("square"), F.sum("ss").alias("ss"))
    inner = own.agg(F.sum((F.col("square") - F.col("ss")) / 2).alias("same_sum"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("same_pairs"), F.sum("n").alias("n"))
    both = inner.crossJoin(total).select("same_sum", "same_pairs", ((F.col("square") - F.col("ss")) / 2 - F.col("same_sum")).alias("other_sum"), (F.col("n") * (F.col("n") - 1) / 2 - F.col("same_pairs")).alias("other_pairs"))
    mean = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return both.select(mean("same_sum", "same_pairs").alias("same"), mean("other_sum", "other_pairs").alias("other"), (mean("same_sum", "same_pairs") - mean("other_sum", "other_pairs")).alias("gap"))
