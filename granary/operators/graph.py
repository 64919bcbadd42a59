"""Relations between clauses, findings and laws as edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def edges(df: DataFrame, source: str, targets: str, kind: str) -> DataFrame:
    """(src, dst, kind) for each element of an array column, each once."""
    pairs = df.select(F.col(source).cast("string").alias("src"), F.explode(targets).alias("dst"))
    return pairs.select("src", F.col("dst").cast("string").alias("dst")).distinct().withColumn("kind", F.lit(kind))


def symmetric(df: DataFrame) -> DataFrame:
    return df.unionByName(df.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "kind")).distinct()


def same_key_classes(df: DataFrame, item: str, shared: str) -> DataFrame:
    """(key, item, items, first) for each item of a key that several items share: every two items of a class are linked.
    A class of n items takes n rows and not n * (n - 1) edges, whatever its size; `first` is its smallest item."""
    cites = df.select(shared, item).distinct()
    sizes = cites.groupBy(shared).agg(F.count(F.lit(1)).alias("items"), F.min(item).alias("first")).filter("items > 1")
    return cites.join(sizes, shared).select(shared, item, "items", "first")


def class_edges(classes: DataFrame, item: str, shared: str) -> DataFrame:
    """The classes' symmetric edges one by one, for classes whose size the caller has bounded."""
    a, b = (classes.select(shared, F.col(item).alias(n)) for n in ("src", "dst"))
    return a.join(b, shared).filter("src <> dst").select("src", "dst").distinct()


def links_of_several(df: DataFrame, item: str, kind: str, agent: str) -> DataFrame:
    """The classes of items of one kind that several agents found. Items carry their least and greatest agent, so the rows are
    read, dealt and summed once; the classes' sizes come from those sums."""
    cites = df.groupBy(kind, item).agg(F.min(agent).alias("__a"), F.max(agent).alias("__b"))
    sums = cites.groupBy(kind).agg(F.count(item).alias("items"), F.min(item).alias("first"), F.min("__a").alias("__a"), F.max("__b").alias("__b"))
    sizes = sums.filter((F.col("items") > 1) & (F.col("__a") < F.col("__b"))).select(kind, "items", "first")
    return cites.select(kind, item).join(sizes, kind).select(kind, item, "items", "first")


def context(items: DataFrame, key: str, *edge_tables: tuple[str, DataFrame]) -> DataFrame:
    """Each item with the sorted neighbours of every named edge table."""
    found = items
    for name, table in edge_tables:
        grouped = table.groupBy(F.col("src").alias("__src")).agg(F.array_sort(F.collect_set("dst")).alias(name))
        found = found.join(grouped, F.col(key).cast("string") == F.col("__src"), "left").drop("__src")
        found = found.withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return found


def blind_spots(clauses: DataFrame, reviews: DataFrame, key: str, tier: str) -> DataFrame:
    """Clauses that no review, or one without a finding, has seen; reviews are (key, has_risk)."""
    seen = reviews.groupBy(key).agg(F.count(F.lit(1)).alias("reviews"), F.count_if("has_risk").alias("risks"))
    joined = clauses.join(seen, key, "left").na.fill(0, ["reviews", "risks"])
    return joined.filter((F.col(tier) != "L1") & ((F.col("reviews") == 0) | ((F.col("reviews") <= 1) & (F.col("risks") == 0))))


def coverage(clauses: DataFrame, reviews: DataFrame, key: str) -> DataFrame:
    """One row: clauses, reviewed ones, others."""
    seen = reviews.select(F.col(key).alias("__key")).distinct()
    return clauses.join(seen, F.col(key) == F.col("__key"), "left").agg(F.count(F.lit(1)).alias("total"), F.count("__key").alias("reviewed"), F.count_if(F.col("__key").isNull()).alias("unreviewed"))


def path_rollup(df: DataFrame, path: str, severity_rank: str) -> DataFrame:
    """Findings and highest severity of every prefix of the path."""
    prefixes = F.explode(F.transform(F.sequence(F.lit(1), F.size(path)), lambda n: F.slice(path, F.lit(1), n)))
    return df.filter(F.size(path) > 0).select(prefixes.alias("prefix"), severity_rank).groupBy("prefix").agg(F.count(F.lit(1)).alias("n"), F.max(severity_rank).alias("worst"))


def tree_order(df: DataFrame, risks: str, title: str, language: str = "zh") -> DataFrame:
    """Most findings first, then titles as the language sorts them."""
    return df.orderBy(F.desc(risks), F.collate(title, language), title)


def snapshot(folder: str, **tables: DataFrame) -> None:
    """Nodes and edges as Parquet, a folder for each table; tables are written by tasks and none is gathered."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{folder}/{name}")


def read_snapshot(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}
