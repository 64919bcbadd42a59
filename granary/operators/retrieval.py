"""Search in redacted documents: queries are redacted by the vault of their document, hits are restored."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.operators import redact, vector
from granary.plugins import Embedder

#: Chunks of a document that one task compares, and how many documents may be split into blocks of that many.
BLOCK, MOST_SPLIT = 50_000, 10_000


def redacted_queries(queries: DataFrame, vaults: DataFrame, key: str = "doc_id", patterns: list[tuple[str, str]] = redact.PATTERNS) -> DataFrame:
    """queries (key, query_id, query) with `hidden`, the redacted query, and `vault`, its document's entries and its own.

    The patterns see the query once, as they saw the document. A value that the document's vault holds gets the placeholder
    it has there; other values are numbered above the document's. Documents without a row in `vaults` (key, vault; each
    key once) have none."""
    joined = queries.join(vaults.select(key, F.col("vault").alias("__held")), key, "left").withColumn("__held", F.coalesce("__held", F.array().cast(redact.VAULT)))
    own = redact.redacted(joined.withColumn("hidden", F.coalesce("query", F.lit(""))), "hidden", "__own", patterns, "__held")
    return own.withColumn("vault", F.concat("__held", "__own")).drop("__held", "__own")


def redacted_search(chunks: DataFrame, queries: DataFrame, vaults: DataFrame, embed: Embedder, k: int = 5, key: str = "doc_id", snippet: int = 200, patterns: list[tuple[str, str]] = redact.PATTERNS) -> DataFrame:
    """(key, query_id, query, chunk_id, score, rank, text, snippet, and the chunks' other columns): the `k` best chunks of each
    query among those of its own document, by cosine, ties by chunk_id.

    chunks (key, chunk_id, text, perhaps title and page_start) are redacted already; queries (key, query_id, query) aren't. What
    is embedded is redacted on both sides, so the embedder may be a service; what comes out is restored by the document's
    and the query's entries. A null query or text counts as empty; a query whose document has no chunk has no row.

    Vectors meet on their document, so scores are as many as queries times chunks of each document. Documents of many chunks are
    split into blocks, each with all queries of the document: those of more than `BLOCK` chunks or, if that is more, of one part in
    `MOST_SPLIT` of all chunks, so that at most `MOST_SPLIT` rows are broadcast. Each block passes on its `k` best of a query, and
    only ids and scores. Texts and vaults are joined to the hits."""
    asked = redacted_queries(queries, vaults, key, patterns)
    vectors = chunks.select(key, "chunk_id", embed(F.coalesce("text", F.lit(""))).alias("__v")).withColumn("__vn", vector.norm(F.col("__v")))
    wanted = asked.select(key, "query_id", embed(F.col("hidden")).alias("__q")).withColumn("__qn", vector.norm(F.col("__q")))
    length = F.col("__vn") * F.col("__qn")
    cosine = F.when(length > 0, vector.dot(F.col("__v"), F.col("__q")) / length).otherwise(F.lit(0.0))
    size = max(BLOCK, -(-chunks.count() // MOST_SPLIT))
    large = chunks.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > size).select(key, F.ceil(F.col("__n") / size).alias("__blocks"))
    blocks = F.coalesce("__blocks", F.lit(1))
    vectors = vectors.join(F.broadcast(large), key, "left").withColumn("__b", F.pmod(F.xxhash64("chunk_id"), blocks)).drop("__blocks")
    wanted = wanted.join(F.broadcast(large), key, "left").withColumn("__b", F.explode(F.sequence(F.lit(0).cast("long"), blocks.cast("long") - 1))).drop("__blocks")
    scores = vectors.join(wanted, [key, "__b"]).select(key, "__b", "query_id", "chunk_id", cosine.alias("score"))
    order = (F.desc("score"), F.asc("chunk_id"))
    best = scores.withColumn("rank", F.row_number().over(Window.partitionBy(key, "__b", "query_id").orderBy(*order))).filter(F.col("rank") <= k).drop("__b")
    hits = best.withColumn("rank", F.row_number().over(Window.partitionBy(key, "query_id").orderBy(*order))).filter(F.col("rank") <= k)
    found = hits.join(chunks, [key, "chunk_id"]).join(asked.select(key, "query_id", "query", "vault"), [key, "query_id"])
    found = found.withColumn("snippet", F.substring("text", 1, snippet))
    for name in ("text", "snippet", *(["title"] if "title" in chunks.columns else [])):
        found = found.withColumn(name, redact.replaced(F.col(name), F.col("vault"), "placeholder", "value"))
    return found.drop("vault")
