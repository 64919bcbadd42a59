"""Duplicates and entity resolution."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import text as T


def keep_first(df: DataFrame, keys: list[str], text: str, order: str, short: int = 20) -> DataFrame:
    """The first row of each text under the same keys; null texts and texts of under `short` characters are all kept. Only a
    digest of the other texts is shuffled. The rows that go are taken away by keys and order, which together must be unique;
    null keys are equal to each other."""
    long = df.filter(F.char_length(text) >= short).select(*keys, F.sha2(F.col(text).cast("binary"), 256).alias("__d"), order)
    groups = long.groupBy(*keys, "__d").agg(F.min(order).alias("__first"), F.count(F.lit(1)).alias("__n")).filter("__n > 1")

    def same(a: str, b: str, names: list[str]) -> Column:
        return reduce(lambda x, y: x & y, (F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in names))

    gone = long.alias("a").join(groups.alias("b"), same("a", "b", [*keys, "__d"])).filter(F.col(f"a.{order}") > F.col("b.__first")).select(*(F.col(f"a.{k}").alias(k) for k in [*keys, order]))
    return df.alias("c").join(gone.alias("d"), same("c", "d", [*keys, order]), "left_anti").select(*df.columns)


def keep_best(df: DataFrame, keys: list[str], best: list[Column]) -> DataFrame:
    """The best row of each key."""
    w = Window.partitionBy(*keys).orderBy(*best)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def removed(df: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    """The rows that a deduplication took away, as removal events."""
    return df.join(kept.select(key), key, "left_anti")


def distinct_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each non-blank key."""
    return keep_best(df.filter(F.trim(F.col(key)) != ""), [key], [F.col(order)])


#: Buckets of grams by hash whose counts say which grams are rare; the table of counts has no more rows than that.
BUCKETS = 65_536


def _rare_first(sets: DataFrame, counts: DataFrame) -> DataFrame:
    """sets (k, g) with their grams by rising count of the gram's bucket, then by gram: a total order of all grams."""
    each = sets.select("k", F.explode("g").alias("x")).withColumn("bucket", F.pmod(F.xxhash64("x"), F.lit(BUCKETS)))
    placed = each.join(F.broadcast(counts), "bucket")
    return placed.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("n", "x"))).alias("g")).select("k", F.transform("g", lambda e: e["x"]).alias("g"))


def near_sets(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(a, b, similarity) of all pairs of a set of `left` and one of `right` whose Jaccard similarity is `least` (above 0) or more.

    left, right: (k, g), each key once, g an array of different grams; sets that are null or empty are in no pair. Sets so similar share a gram
    among the foremost of each in any order of grams, so pairs meet on those alone, the rare ones, if their sizes allow it. Each
    pair is verified once, by whole sets. Frequent grams lead to pairs only where a set has no others."""
    both = left.select("g").unionByName(right.select("g"))
    counts = both.select(F.explode("g").alias("x")).groupBy(F.pmod(F.xxhash64("x"), F.lit(BUCKETS)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    a, b = _rare_first(left, counts), _rare_first(right, counts)
    # A little is taken off, so that rounding lengthens a prefix and never shortens it.
    shared = F.ceil(F.size("g") * least - 1e-6)
    prefix = lambda rows, k, n: rows.select(F.col("k").alias(k), F.size("g").alias(n), F.explode(F.slice("g", F.lit(1), (F.size("g") - shared + 1).cast("int"))).alias("x"))
    met = prefix(a, "a", "na").join(prefix(b, "b", "nb"), "x").filter(F.least("na", "nb") >= F.greatest("na", "nb") * least - 1e-6).select("a", "b").distinct()
    whole = met.join(left.select(F.col("k").alias("a"), F.col("g").alias("ga")), "a").join(right.select(F.col("k").alias("b"), F.col("g").alias("gb")), "b")
    common = F.size(F.array_intersect("ga", "gb"))
    return whole.select("a", "b", (common / (F.size("ga") + F.size("gb") - common)).alias("similarity")).filter(F.col("similarity") >= least)


def gram_pairs(df: DataFrame, key: str, text: str, least: float, n: int = 3) -> DataFrame:
    """Pairs (a, b, similarity), a < b, of rows whose sets of character n-grams have that Jaccard similarity or more, by `near_sets`.

    Keys are unique. Rows with a null text are in no pair."""
    rows = df.select(F.col(key).alias("k"), T.grams(F.col(text), n).alias("g"))
    return near_sets(rows, rows, least).filter("a < b")


def _squeezed(text: str | None) -> str:
    return "".join((text or "").lower().split())


def quotation_similarity(a: str, b: str) -> float:
    """1 for containment, else the ratio of matching blocks."""
    a, b = _squeezed(a), _squeezed(b)
    if not a or not b:
        return 0.0
    return 1.0 if a in b or b in a else SequenceMatcher(None, a, b).ratio()


def _common(places: dict[str, int], size: int, b: str) -> int:
    """Length of the longest common subsequence of `b` and a text of `size` characters, by the bits of their places there."""
    whole = left = (1 << size) - 1
    for c in b:
        both = left & places.get(c, 0)
        left = (left + both | left - both) & whole
    return size - left.bit_count()


def _first_like(words: str, heads: list[tuple], least: float) -> object | None:
    """The first of `heads` (key, squeezed text) that is similar to `words`. Matching blocks follow each other in both texts, so
    their ratio is at most that of the longest common subsequence, and of the lengths; only where these reach `least`, blocks are matched."""
    places: dict[str, int] = {}
    for i, c in enumerate(words):
        places[c] = places.get(c, 0) | 1 << i
    for key, other in heads:
        if not words or not other:
            alike = least <= 0
        elif words in other or other in words:
            alike = least <= 1
        else:
            size, need = len(words) + len(other), least - 1e-9
            alike = 2 * min(len(words), len(other)) >= need * size and 2 * _common(places, len(words), other) >= need * size and SequenceMatcher(None, words, other).ratio() >= least
        if alike:
            return key
    return None


def greedy_merge(df: DataFrame, block: list[str], order: str, text: str, least: float) -> DataFrame:
    """Each row of a block, in order, joins the first earlier representative that is similar, or becomes one.

    Order decides, so a block is one task; `block` should be a document or smaller. A text that came before joins what it
    joined then, as representatives are only added behind."""

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        heads: list[tuple[object, str]] = []
        met: dict[str, object] = {}
        found = []
        for place, raw in zip(rows[order], rows[text]):
            words = _squeezed(raw)
            head = met.get(words)
            if head is None:
                head = _first_like(words, heads, least)
            if head is None:
                heads.append((place, words))
                head = place
            if words and least <= 1:
                met[words] = head
            found.append(head)
        return rows.assign(merged_into=found)

    ordered = lambda rows: merge(rows.sort_values(order))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    kind = df.schema[order].dataType.simpleString()
    return df.groupBy(*block).applyInPandas(ordered, f"{schema}, merged_into {kind}")


def fuzzy_lookup(queries: DataFrame, cache: DataFrame, query: str, entry: str, least: float = 0.25) -> DataFrame:
    """The cached entry of each query: the equal one, else the one of the best overlap of bigrams, of equal ones the last by name."""
    sets = lambda rows, c: rows.select(F.col(c).alias("k")).distinct().withColumn("g", T.grams(T.normalise_query(F.col("k")), 2))
    scored = near_sets(sets(queries, query), sets(cache, entry), least).withColumn("score", F.when(F.col("a") == F.col("b"), 2.0).otherwise(F.col("similarity")))
    return scored.groupBy(F.col("a").alias("query")).agg(F.max_by(F.struct(F.col("b").alias("entry"), "score"), F.struct("score", "b")).alias("best")).select("query", "best.entry", F.least("best.score", F.lit(1.0)).alias("score"))


def set_intersection(df: DataFrame, key: str, kind: str, kinds: list) -> DataFrame:
    """Keys that occur with every one of the kinds."""
    return df.filter(F.col(kind).isin(kinds)).groupBy(key).agg(F.countDistinct(kind).alias("__n")).filter(F.col("__n") == len(kinds)).select(key)
