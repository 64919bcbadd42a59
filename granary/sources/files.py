"""Sources and sinks: JSON lines, run documents, packed vectors, manifests and tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from urllib.parse import unquote

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from granary.session import remove_folder


def read_jsonl(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """JSON lines with a byte-order mark and blank lines tolerated; broken lines are kept in `_corrupt_record`."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("value")).filter(F.trim("value") != "")
    whole = StructType([*schema.fields, StructField("_corrupt_record", StringType())])
    return lines.select(F.from_json("value", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r")).select("r.*")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; array columns are joined with |. Each file begins with a byte-order mark, in front of the header."""
    flat = [(F.array_join(c, "|") if t.startswith("array") else F.col(c)).alias("\ufeff" * (i == 0) + c) for i, (c, t) in enumerate(df.dtypes)]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def replace_partitions(df: DataFrame, path: str, keys: list[str], replaced: DataFrame | None = None, format: str = "parquet") -> None:
    """Write `df` below `path`, a folder for each value of `keys`: folders that `df` has rows for give way to its rows, others stay.
    Doing it again gives the same; a write that fails leaves all as it was, as folders change only when the job commits.

    replaced (keys): what was made anew, so that those without rows lose theirs, after the write. Large folders are written by
    several tasks, small ones by one. An empty string is stored as a null."""
    spark = df.sparkSession
    df.hint("rebalance", *keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).format(format).save(path)
    if replaced is not None:
        same = lambda a, b: reduce(lambda x, y: x & y, (a[c].eqNullSafe(b[c]) for c in keys))
        old = read_partitions(spark, path, df.schema, format).select(*keys, F.regexp_extract("_metadata.file_path", "^(.*)/[^/]*$", 1).alias("__folder")).distinct()
        new = df.select(*keys).distinct()
        emptied = replaced.select(*keys).join(new, same(replaced, new), "left_anti")
        for row in old.join(emptied, same(old, emptied), "left_semi").select("__folder").distinct().toLocalIterator():
            remove_folder(spark, unquote(row[0]))  # the column holds addresses, in which % codes stand for some characters


def read_partitions(spark: SparkSession, path: str, schema: StructType, format: str = "parquet") -> DataFrame:
    """What `replace_partitions` wrote; the schema keeps the keys' types and is known without looking at files."""
    return spark.read.schema(schema).format(format).load(path)


def read_runs(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Run documents below a folder at any depth; the parent folder is their group."""
    runs = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    return runs.withColumn("group", F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)/[^/]+$", 1))


def read_documents(spark: SparkSession, path: str, parse: Callable[[bytes], str], fallback: Callable[[bytes], str] | None = None) -> DataFrame:
    """(path, text, error) of binary documents by a parser; a second parser takes what the first can't, and what neither can
    is an error in the row. Spark lists no files without bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content in zip(batch.path, batch.content):
                text, error = None, None
                for parser in (parse, fallback):
                    if parser is None or text:
                        continue
                    try:
                        text = parser(bytes(content)) or None
                        error = None if text else "empty"
                    except Exception as e:  # noqa: BLE001
                        error = str(e)
                rows.append((name, text, error))
            yield pd.DataFrame(rows, columns=["path", "text", "error"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, text string, error string")


def read_vectors(spark: SparkSession, path: str, dimension: int) -> DataFrame:
    """(path, row, embedding) of packed little-endian float files; a file whose size doesn't fit is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch.path, batch.content):
                if len(content) % (4 * dimension):
                    raise ValueError(f"{name} has {len(content)} bytes, no multiple of {4 * dimension}")
                values = np.frombuffer(bytes(content), "<f4").reshape(-1, dimension)
                for i in range(0, len(values), 4096):
                    part = values[i : i + 4096]
                    yield pd.DataFrame({"path": name, "row": np.arange(i, i + len(part)), "embedding": list(part)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, row long, embedding array<float>")


def pack_vectors(embeddings: list[list[float]]) -> bytes:
    return np.asarray(embeddings, "<f4").tobytes()


def verify_manifest(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """(name, expected, actual, status) of files against their listed SHA-256: ok, changed, missing or extra."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    actual = files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.sha2("content", 256).alias("actual"))
    both = manifest.select("name", F.col("sha256").alias("expected")).join(actual, "name", "full_outer")
    state = F.when(F.col("actual").isNull(), "missing").when(F.col("expected").isNull(), "extra").when(F.col("actual") == F.col("expected"), "ok").otherwise("changed")
    return both.withColumn("status", state)


def with_fallbacks(keys: DataFrame, key: str, *sources: tuple[str, DataFrame]) -> DataFrame:
    """For each key the result of the first source that has one, and the source's name; sources are (name, table of key and
    result)."""
    found = keys
    names = []
    for i, (_, table) in enumerate(sources):
        found = found.join(table.select(F.col(key), F.col("result").alias(f"__r{i}")), key, "left")
        names.append(f"__r{i}")
    origin = F.lit("none")
    for (name, _), c in reversed(list(zip(sources, names))):
        origin = F.when(F.col(c).isNotNull(), F.lit(name)).otherwise(origin)
    return found.select(key, F.coalesce(*names).alias("result"), origin.alias("origin"))


def jdbc(spark: SparkSession, url: str, table: str, column: str, low: int, high: int, parts: int) -> DataFrame:
    """A relational table read in ranges of a numeric column."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=parts).load()
