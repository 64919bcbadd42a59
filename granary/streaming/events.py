"""Structured Streaming over event files, with batch twins that give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read(spark: SparkSession, folder: str, schema: StructType, fmt: str = "parquet", files: int = 1) -> DataFrame:
    """A stream of the files of a folder, `files` of them in a batch."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files).load(folder)


def run(stream: DataFrame, mode: str, folder: str) -> DataFrame:
    """Run a stream over what there is into Parquet files below `folder` and give them as a table: of the last batch for
    complete results, of all batches for appended ones. A batch that runs twice overwrites its own files."""
    spark = stream.sparkSession

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows" if mode == "complete" else f"{folder}/rows/batch={number}")

    query = stream.writeStream.foreachBatch(store).outputMode(mode).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def important(events: DataFrame, severity: Column, topics: dict[str, str]) -> DataFrame:
    """High events with a topic by their type."""
    topic = F.lit("general")
    for kind, name in topics.items():
        topic = F.when(F.col("event_type") == kind, F.lit(name)).otherwise(topic)
    return events.filter(severity == "high").withColumn("topic", topic)


def unpack(lines: DataFrame, column: str = "value") -> DataFrame:
    """Envelopes to (kind, payload): tagged JSON, or an `event:` line before a `data:` line."""
    c = F.col(column)
    kind = F.when(c.startswith("event:"), F.trim(F.regexp_extract(c, "^event:([^\n]*)", 1))).otherwise(F.get_json_object(c, "$.type"))
    payload = F.when(c.startswith("event:"), F.trim(F.regexp_extract(c, "(?s)\ndata:(.*)$", 1))).otherwise(F.coalesce(F.get_json_object(c, "$.data"), c))
    return lines.select(kind.alias("kind"), payload.alias("payload"))


def sessions(events: DataFrame, keys: list[str]) -> DataFrame:
    """Counters, highest turn, last type and whether a session is closed, by key; runs on streams (update mode) and tables."""
    return events.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("events"),
        F.max("event_id").alias("last_event"),
        F.max_by("event_type", "event_id").alias("last_type"),
        F.count_if(F.col("event_type") == "click").alias("clicks"),
        F.max(F.col("event_type") == "purchase").alias("closed"),
    )


def gap_sessions(events: DataFrame, key: str, gap: str, late: str | None = None) -> DataFrame:
    """Sessions of events less than `gap` apart; `late` bounds the state of a stream."""
    rows = events.withWatermark("ts", late) if late else events
    found = rows.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return found.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def tumbling(events: DataFrame, keys: list[str], size: str, late: str | None = None) -> DataFrame:
    rows = events.withWatermark("ts", late) if late else events
    found = rows.groupBy(*keys, F.window("ts", size).alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return found.select(*keys, F.col("w.start").alias("start"), "events")


def once(events: DataFrame, key: str, late: str) -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def fold_changes(changes: DataFrame, key: str, seq: str, op: str, fields: list[str], patched: str) -> DataFrame:
    """The present rows of a changelog, as its changes one after the other leave them: `added` sets all fields, `updated` sets
    those named in the array `patched`, null included, of a row that is there, and `removed` takes the row away; updates
    and removals of what isn't there do nothing. A row added again is set anew.

    An add sets every field, so a field's value is that of the last change that set it: one aggregation, with a state of one row for
    a key, on tables and on streams alike. `seq` orders the changes of a key; a stream keeps removed keys in its state."""
    at = F.col(seq)
    added, removed = (F.max(F.when(F.col(op) == kind, at)) for kind in ("added", "removed"))
    values = [F.max_by(f, F.when((F.col(op) == "added") | ((F.col(op) == "updated") & F.array_contains(patched, f)), at)).alias(f) for f in fields]
    found = changes.groupBy(key).agg(added.alias("__added"), removed.alias("__removed"), *values)
    return found.filter(F.col("__added").isNotNull() & (F.col("__removed").isNull() | (F.col("__added") > F.col("__removed")))).select(key, *fields)


def latest(events: DataFrame, key: str, seq: str, *fields: str) -> DataFrame:
    return events.groupBy(key).agg(F.max_by(F.struct(*fields), seq).alias("x")).select(key, "x.*")


def status(events: DataFrame, key: str, ranks: dict[str, int], names: list[str]) -> DataFrame:
    """The furthest status that a key has reached."""
    rank = F.lit(0)
    for kind, r in ranks.items():
        rank = F.when(F.col("event_type") == kind, F.lit(r)).otherwise(rank)
    return events.groupBy(key).agg(F.element_at(F.array(*(F.lit(n) for n in names)), F.max(rank) + 1).alias("status"))


def consume(stream: DataFrame, work: Callable[[DataFrame], DataFrame], sink: str, dead: str, checkpoint: str, attempts: int = 3) -> None:
    """At-least-once work in batches: a batch that fails is tried again, and after `attempts` goes to the dead-letter folder.
    Sinks are overwritten by batch, so a replayed batch leaves the same rows."""

    def batch(rows: DataFrame, number: int) -> None:
        error = ""
        for _ in range(attempts):
            try:
                work(rows).write.mode("overwrite").parquet(f"{sink}/batch={number}")
                return
            except Exception as e:  # noqa: BLE001
                error = str(e).splitlines()[0][:200]
        rows.withColumn("error", F.lit(error)).write.mode("overwrite").parquet(f"{dead}/batch={number}")

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def reconciled(table: DataFrame, stream: DataFrame, key: str) -> DataFrame:
    """Rows of the table that the stream lost."""
    return table.join(stream.select(key), key, "left_anti")
