"""One-to-one matching of labelled findings with predictions.

Labelled rows choose in their order: each takes the best prediction that is left (its similarity, plus a bonus where the
severities agree; the earliest of equal ones). All edges of possible pairs are scored first, by all tasks; then rounds settle
every pair that no later choice can change: the prediction is the best that is left for the labelled row, and no earlier
labelled row that is left could take it. All predictions rank the labelled rows alike, so the rounds end with just the matching
that choosing one after the other gives. A round is two aggregations; the edges that are left are stored between rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.operators import measures
from granary.operators.dedup import quotation_similarity
from granary.session import remove_folder, shared_folder, ship

#: Words that a pair must have in common, in a row, to be scored where no block brings pairs together.
SHARED_WORDS = 5
BONUS = 0.05


def _similarity(a: str | None, b: str | None, least: float) -> float:
    """The similarity of two quotations, or 0 where even equal lengths' worth of matches couldn't reach `least`."""
    a, b = "".join((a or "").lower().split()), "".join((b or "").lower().split())
    if not a or not b or (not (a in b or b in a) and 2 * min(len(a), len(b)) < least * (len(a) + len(b))):
        return 0.0
    return quotation_similarity(a, b)


def scored(pairs: DataFrame, least: float) -> DataFrame:
    """`pairs` (gold, found, gold_text, found_text and more) that are similar enough, with `similarity`, without the texts."""
    ship(pairs.sparkSession)
    kept = [f for f in pairs.schema if f.name not in ("gold_text", "found_text")]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            rows = rows.assign(similarity=[_similarity(a, b, least) for a, b in zip(rows.gold_text, rows.found_text)])
            yield rows[rows.similarity >= least][[*(f.name for f in kept), "similarity"]]

    return pairs.mapInPandas(work, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", similarity double")


def sharing(gold: DataFrame, found: DataFrame, words: int = SHARED_WORDS) -> DataFrame:
    """Pairs (gold, found) of texts with `words` words in a row in common; of a text of fewer words, all of them.

    Only the labelled side's runs reach the join, so the other side's texts are cut into runs and filtered in place; the
    filter is a semi-join by the run's hash, and each pair is aggregated within tasks before it is shuffled."""

    def runs(rows: DataFrame, key: str, text: str) -> DataFrame:
        split = rows.select(key, F.expr(f"regexp_extract_all(lower({text}), '[^\\\\x20\\\\x09-\\\\x0D]+', 0)").alias("__w")).filter(F.size("__w") > 0)
        at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("__w") - (words - 1)))
        hashed = F.transform(at, lambda i: F.xxhash64(F.array_join(F.slice("__w", i, F.lit(words)), " ")))
        return split.select(key, F.explode_outer(F.array_distinct(hashed)).alias("__run"))

    return runs(gold, "gold", "gold_text").join(runs(found, "found", "found_text"), "__run").select("gold", "found").distinct()


def settle(edges: DataFrame) -> DataFrame:
    """The matching of `edges` (gold, found, score): gold rows choose in ascending order, the best score first, then the smallest
    `found`. gold and found must be unique ids whose order is the order of choice."""
    spark, done, path = edges.sparkSession, None, None
    while True:
        new = shared_folder(spark, "matching")
        edges.write.parquet(new)
        if path:
            remove_folder(spark, path)
        edges, path = spark.read.schema(edges.schema).parquet(new), new
        if not edges.head(1):
            return done if done is not None else edges.select("gold", "found", "score")
        best = edges.groupBy("gold").agg(F.max(F.struct("score", (-F.col("found")).alias("o"))).alias("b")).select("gold", (-F.col("b.o")).alias("found"), "b.score")
        first = edges.groupBy("found").agg(F.min("gold").alias("gold"))
        pairs, folder = best.join(first, ["gold", "found"]).select("gold", "found", "score"), shared_folder(spark, "matched")
        pairs.write.parquet(folder)
        pairs = spark.read.schema(pairs.schema).parquet(folder)
        done = pairs if done is None else done.union(pairs)
        edges = edges.join(pairs.select("gold"), "gold", "left_anti").join(pairs.select("found"), "found", "left_anti").select("gold", "found", "score")


def match_texts(gold: DataFrame, found: DataFrame, least: float) -> DataFrame:
    """(gold, found, score) of labelled rows (gold, gold_text) and predictions (found, found_text) of a whole corpus.

    Pairs without a run of `SHARED_WORDS` words in common aren't scored; no length is left out. Null and empty texts
    match nothing. Repeated ids count once."""
    near = sharing(gold, found)
    pairs = near.join(gold.dropDuplicates(["gold"]), "gold").join(found.dropDuplicates(["found"]), "found")
    return settle(scored(pairs, least).select("gold", "found", F.col("similarity").alias("score")))


def match_findings(gold: DataFrame, found: DataFrame, least: float = 0.45) -> DataFrame:
    """(gold, found, score, similarity) of labelled and predicted findings, document by document.

    gold: gold, doc, page, gold_text, gold_code, gold_type, gold_severity, aliases; found: found, doc, page, found_text, code, kind,
    severity. A prediction is in scope on a page of a labelled finding of its document, or where its quotation is similar to
    one; it may match labelled findings of its type that are similar enough. Pairs are those of one document."""
    pairs = gold.withColumnRenamed("page", "gold_page").join(found.withColumnRenamed("page", "found_page"), "doc")
    typed = measures.type_matches(F.col("gold_code"), F.col("code"), F.col("gold_type"), F.col("kind"), F.col("aliases"))
    same = measures.severity_group(F.col("gold_severity")) == measures.severity_group(F.col("severity"))
    # A pair that matches is similar enough, so its prediction is in scope by its quotation alone: pages decide on rows
    # that match nothing (`review.in_scope`), not on pairs.
    kept = pairs.filter(typed).select("gold", "found", F.coalesce(same, F.lit(False)).alias("same"), "gold_text", "found_text")
    edges = scored(kept, least).withColumn("score", F.col("similarity") + F.when(F.col("same"), BONUS).otherwise(0.0))
    chosen = settle(edges.select("gold", "found", "score"))
    return chosen.join(edges.select("gold", "found", "similarity"), ["gold", "found"])
