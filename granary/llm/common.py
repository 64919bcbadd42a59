"""What the operators of this subpackage share: tables, shared folders and Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from granary.session import remove_folder, shared_folder, ship, table

#: Rows of a batch handed to Python. Whole texts may be long, so batches hold few rows.
BATCH_ROWS = 512
#: Rows of an Arrow batch between the JVM and Python.
ARROW_ROWS = 1024
#: Bytes of text that one step works on; a longer text is a step of its own.
STEP_BYTES = 4 << 20
_kept: dict = {}
_asked: set = set()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return table(spark, sf_dir, "documents")


def stored(df: DataFrame, kind: str) -> tuple[DataFrame, str]:
    """`df` stored as Parquet in a new shared folder and read again, and that folder."""
    spark = df.sparkSession
    path = shared_folder(spark, kind)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, kind: str) -> DataFrame:
    """`df` stored in the shared folder and read again: short lineage that outlives executors."""
    return stored(df, kind)[0]


def spread_join(left: DataFrame, right: DataFrame, key: str, rest: list[str], how: str = "inner", counted: DataFrame | None = None, least: int = 1000) -> DataFrame:
    """Join `left` with the few rows that `right` has for each key, without a task that takes all of a common key.

    Keys with more rows in `left` (or in `counted`, a stored table of the same keys) than a thousandth of it (or `least`)
    are at most a thousand, so they are broadcast with a number of salts; `left` rows of such a key are dealt to its salts
    by a hash of `rest`, and `right` has its rows for the key once for each salt. Rows without a key, which join with
    nothing, are dealt alike."""
    counted = left if counted is None else counted
    rows = counted.count()
    each = max(least, rows // 1000)
    if rows <= each:  # no key can have more
        return left.join(right.hint("merge"), key, how)
    hot = counted.groupBy(key).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > each).select(key, F.ceil(F.col("_rows") / each).alias("_salts"))
    hot = F.broadcast(hot)
    dealt = left.join(hot, key, "left").withColumn("_salt", F.when(F.col(key).isNull(), F.xxhash64(*rest)).otherwise(F.coalesce(F.pmod(F.xxhash64(*rest), F.col("_salts")), F.lit(0).cast("long")))).drop("_salts")
    salts = F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("_salts"), F.lit(1).cast("long")) - 1)
    copies = right.join(hot, key, "left").withColumn("_salt", F.explode(salts)).drop("_salts")
    return dealt.join(copies.hint("merge"), [key, "_salt"], how).drop("_salt")


def crc_bucket(column: str, modulus: int):
    """crc32 of the decimal text of an id, modulo `modulus`; null ids are in bucket -1."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus)), F.lit(-1))


def py_crc_bucket(value: int | None, modulus: int) -> int:
    return -1 if value is None else zlib.crc32(str(value).encode()) % modulus


def limit_batches(spark: SparkSession) -> None:
    """Limit the session's Arrow batches: whole texts are long, and a batch is in the JVM and in Python at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= ARROW_ROWS:
        spark.conf.set(name, str(ARROW_ROWS))


def map_batches(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow over batches of at most BATCH_ROWS rows."""
    return map_arrow(df, lambda batches: work(small(batches)), schema)


def map_arrow(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow over limited batches, in tasks that give their memory back when they end."""
    limit_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def kept(key: tuple, make: Callable):
    """What `make` gives, made once in a process and kept from task to task for as long as every task asks for it."""
    _asked.add(key)
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def give_back() -> None:
    """Return memory to the system: a worker outlives its task and would keep it beside the next task's. What the task didn't
    ask for goes too: it is from another operator's tasks."""
    for key in [k for k in _kept if k not in _asked]:
        del _kept[key]
    _asked.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def small(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most `rows` rows, halved further while a slice holds over `most` bytes."""
    for batch in batches:
        todo = [batch.slice(i, rows) for i in range(0, batch.num_rows, rows)][::-1]
        while todo:
            part = todo.pop()
            if part.num_rows > 1 and part.get_total_buffer_size() > most and part.nbytes > most:
                half = part.num_rows // 2
                todo += [part.slice(half), part.slice(0, half)]
            else:
                yield part


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str | None]:
    return batch.column(batch.schema.get_field_index(column)).to_pylist()


def out(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
