"""Queries of document structure and event streams."""

from __future__ import annotations


from pyspark.sql import functions as F

from granary.functions import text as T
from granary.operators import ordered, redact, rules, structure, vector
from granary.plugins import hashed_embedder
from granary.session import shared_folder, ship, table
from granary.streaming import events as stream

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("session_fold", """
SELECT user_id, count(*) AS events, max(event_id) AS last_event, arg_max(event_type, event_id) AS last_type, count(*) FILTER (WHERE event_type = 'click') AS clicks, bool_or(event_type = 'purchase') AS closed FROM events GROUP BY 1""")
def session_fold(spark, d):
    return stream.sessions(table(spark, d, "events"), ["user_id"])


@query("gap_sessions", """
WITH m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT user_id, epoch_us(min(ts)) AS start, epoch_us(max(ts) + INTERVAL 6 HOUR) AS end, count(*) AS events FROM s GROUP BY user_id, k""")
def gap_sessions(spark, d):
    found = stream.gap_sessions(table(spark, d, "events"), "user_id", "6 hours")
    return found.select("user_id", F.unix_micros(F.col("start").cast("timestamp")).alias("start"), F.unix_micros(F.col("end").cast("timestamp")).alias("end"), "events")


def _changes(events):
    e = F.col("event_type")
    value = F.round("value", 3)
    return events.select(
        "user_id", "event_id", F.when(e == "signup", "added").when(e == "error", "removed").otherwise("updated").alias("op"),
        F.when(e.isin("signup", "click"), value).alias("a"), F.when(e.isin("signup", "view"), value).alias("b"), F.array(F.when(e == "click", "a").when(e == "view", "b").otherwise("")).alias("patched"),
    )


CHANGELOG = """
WITH c AS (SELECT user_id, list({'kind': event_type, 'a': round(value, 3), 'b': round(value, 3), 'held': false} ORDER BY event_id) AS changes FROM events GROUP BY 1),
f AS (SELECT user_id, list_reduce(changes, lambda s, x: CASE
  WHEN x.kind = 'signup' THEN {'kind': '', 'a': x.a, 'b': x.b, 'held': true}
  WHEN x.kind = 'error' THEN {'kind': '', 'a': NULL, 'b': NULL, 'held': false}
  WHEN s.held AND x.kind = 'click' THEN {'kind': '', 'a': x.a, 'b': s.b, 'held': true}
  WHEN s.held AND x.kind = 'view' THEN {'kind': '', 'a': s.a, 'b': x.b, 'held': true}
  ELSE s END, {'kind': '', 'a': NULL::DOUBLE, 'b': NULL::DOUBLE, 'held': false}) AS s FROM c)
SELECT user_id, s.a AS a, s.b AS b FROM f WHERE s.held"""


@query("changelog_fold", CHANGELOG)
def changelog_fold(spark, d):
    return stream.fold_changes(_changes(table(spark, d, "events")), "user_id", "event_id", "op", ["a", "b"], "patched")


@query("latest_per_key", "SELECT user_id, arg_max(event_type, event_id) AS event_type, round(arg_max(value, event_id), 3) AS value FROM events GROUP BY 1")
def latest_per_key(spark, d):
    return stream.latest(table(spark, d, "events"), "user_id", "event_id", "event_type", "value").withColumn("value", F.round("value", 3))


@query("status_fold", "SELECT user_id, CASE max(CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 ELSE 0 END) WHEN 0 THEN 'pending' WHEN 1 THEN 'reviewing' ELSE 'reviewed' END AS status FROM events GROUP BY 1")
def status_fold(spark, d):
    return stream.status(table(spark, d, "events"), "user_id", {"click": 1, "purchase": 2}, ["pending", "reviewing", "reviewed"])


@query("important_events", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'failures' ELSE 'general' END AS topic FROM events WHERE event_type IN ('error', 'purchase')")
def important_events(spark, d):
    severity = F.when(F.col("event_type").isin("error", "purchase"), "high").otherwise("low")
    return stream.important(table(spark, d, "events"), severity, {"error": "failures"}).select("event_id", "topic")


def _streamed(spark, d):
    """The event table as a stream of its file, by a folder that holds only that file."""
    events = table(spark, d, "events")
    pattern = f"{d}/events.parque[t]"
    return spark.readStream.schema(events.schema).parquet(pattern)


@query("stream_equals_batch")
def stream_equals_batch(spark, d):
    """The difference of the streamed fold and its batch twin, both ways: no rows if they agree."""
    found = stream.run(stream.sessions(_streamed(spark, d), ["user_id"]), "complete", shared_folder(spark, "stream"))
    batch = stream.sessions(table(spark, d, "events"), ["user_id"])
    return found.exceptAll(batch).withColumn("side", F.lit("stream")).unionByName(batch.exceptAll(found).withColumn("side", F.lit("batch")))


@query("changelog_stream", CHANGELOG)
def changelog_stream(spark, d):
    """The same present rows from the events as they come in."""
    return stream.run(stream.fold_changes(_changes(_streamed(spark, d)), "user_id", "event_id", "op", ["a", "b"], "patched"), "complete", shared_folder(spark, "stream"))


@query("stream_windows", "SELECT event_type, epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS start, count(*) AS events FROM events GROUP BY 1, 2")
def stream_windows(spark, d):
    found = stream.run(stream.tumbling(_streamed(spark, d), ["event_type"], "1 day"), "complete", shared_folder(spark, "stream"))
    return found.select("event_type", F.unix_micros(F.col("start").cast("timestamp")).alias("start"), "events")


@query("line_sections")
def line_sections(spark, d):
    """Sections of texts whose lines are numbered as headings where they hold three words or fewer."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    rows = structure.lines(docs)
    short = F.size(F.split("line", " ")) <= 3
    w = F.row_number().over(ordered.over(["doc_id"], ["ord"]))
    rows = rows.withColumn("line", F.when(short, F.concat(w.cast("string"), F.lit(". "), F.regexp_replace("line", "[.!?;]", ""))).otherwise(F.col("line")))
    return structure.sections(rows).select("doc_id", "ord", "title", "level", F.coalesce("parent", F.lit(-1)).alias("parent"), F.char_length("body").alias("body_chars"))


@query("document_chunks")
def document_chunks(spark, d):
    ship(spark)
    docs = table(spark, d, "documents").select("doc_id", "text")
    rows = structure.lines(docs)
    return structure.chunks(structure.sections(rows)).select("doc_id", "chunk_id", "kind", "part", "total", F.char_length("text").alias("chars"))


@query("fixed_chunks", """
WITH l AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS ord, trim(string_split(text, chr(10))[i]) AS line FROM documents, generate_series(1, 5000) t(i) WHERE i <= len(string_split(text, chr(10)))),
k AS (SELECT * FROM l WHERE line <> '' AND NOT regexp_matches(line, '^[0-9 ]{0,3}$') AND strlen(line) > 3),
c AS (SELECT *, CAST(floor((sum(length(line)) OVER (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING) - length(line)) / 1500) AS INTEGER) AS chunk FROM k)
SELECT doc_id, chunk, min(ord) AS first, max(ord) AS last, CAST(sum(length(line)) + count(*) - 1 AS INTEGER) AS chars FROM c GROUP BY 1, 2""")
def fixed_chunks(spark, d):
    found = structure.fixed_chunks(structure.lines(table(spark, d, "documents").select("doc_id", "text")))
    return found.select("doc_id", "chunk", "first", "last", F.char_length("text").alias("chars"))


@query("chunk_embeddings")
def chunk_embeddings(spark, d):
    ship(spark)
    rows = structure.fixed_chunks(structure.lines(table(spark, d, "documents").select("doc_id", "text")))
    return rows.select("doc_id", "chunk", hashed_embedder()(F.col("text")).alias("v")).select("doc_id", "chunk", F.round(vector.norm(F.col("v")), 3).alias("norm"))


@query("pii_by_label")
def pii_by_label(spark, d):
    """The flagship: which chunks of which documents carry personal data, and how their redacted texts begin."""
    rows = structure.fixed_chunks(structure.lines(table(spark, d, "documents").select("doc_id", "text")))
    rows = rows.withColumn("chunk_id", F.format_string("%d_%03d", "doc_id", "chunk"))
    hidden = redact.redacted(rows.select("doc_id", "chunk_id", "text"), "text").filter(F.size("vault") > 0)
    labels = F.array_join(F.array_sort(F.array_distinct(F.transform("vault", lambda e: e["label"]))), ",")
    return hidden.select("doc_id", "chunk_id", labels.alias("labels"), F.size("vault").cast("long").alias("values"), T.snippet(F.col("text"), 80).alias("snippet"), rules.tier(F.col("text")).alias("tier"))
