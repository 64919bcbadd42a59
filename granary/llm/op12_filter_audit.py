"""Audit of how filters interact, over all orders of applying them.

Each document gets a mask: one bit for each filter it fails. Whatever an order of filters does to a part of the documents
follows from the part's mask cells, the counts of documents (all, good, toxic) with each mask, so texts are read once and
the orders are walked over 32 cells a part. The walk visits every order by single swaps of neighbours (adjacent
transpositions, each order once): a swap at places i and i + 1 changes neither what is kept before place i nor after place
i + 1, so only these two steps are counted anew, from the cells. The Shapley value of a filter is its number of removed
documents summed over all orders; it grows along the walk.

Filters
    A  under 200 words
    B  100 * distinct words < 50 * words
    C  100 * letters A-Z > 2 * code points
    D  holds any of ``#$%&*|``
    E  the text is identical to that of a smaller id in the whole table

E needs the smallest id of each text: ids are compared within texts (by sha256) on narrow rows that are first added up
within tasks, so a text that a third of all rows repeat is one row of a task; its rows are then dealt by (text, id).

Null texts count as empty; an empty text has no words: it fails A, no other but E. A null part is the empty string. A null id is
neither smaller than another nor has it a smaller one, so it never fails E, and it has no labels. Repeated rows count one
by one and don't fail E for each other. Several label rows of an id: good if any says so, toxic if any says so. Texts of
any length are judged whole. An empty table has no parts and gives no rows. Additional columns aren't read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import common
from granary.session import table

FILTERS = "ABCDE"
MEASURES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
#: Parts that one step of the walk counts side by side.
PARTS = 256


def word_sizes(text: str) -> Column:
    """words and distinct words of a text column, which is split once."""
    words = F.expr(f"regexp_extract_all({text}, '[^\\\\x20\\\\x09-\\\\x0D]+', 0)")
    return F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("words"), F.size(F.array_distinct(w)).alias("distinct")))[0]


def text_failures(text: Column, sizes: Column) -> list[Column]:
    """The filters that look at a text alone, in the order of their letters."""
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [sizes["words"] < 200, 100 * sizes["distinct"] < 50 * sizes["words"], 100 * capitals > 2 * F.length(text), text.rlike(r"[#$%&*|]")]


def mask_cells(docs: DataFrame, labels: DataFrame, key: str = "doc_id", column: str = "text", part: str = "source") -> DataFrame:
    """part, mask, n, good, toxic: how many documents of each part fail just the filters of the mask."""
    rows = docs.select(F.col(key).cast("long").alias("_key"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(column), F.lit("")).alias("_text")).withColumn("_sizes", word_sizes("_text"))
    bits = sum((F.when(f, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(text_failures(F.col("_text"), F.col("_sizes")))), F.lit(0))
    judged = rows.select("_key", "part", F.unhex(F.sha2(F.col("_text").cast("binary"), 256)).alias("_sha"), bits.alias("_mask"))
    counted, path = common.stored(judged.groupBy("_key", "part", "_sha", "_mask").agg(F.count(F.lit(1)).alias("n")), "filter-audit")
    firsts = counted.filter("_key IS NOT NULL").groupBy("_sha").agg(F.min("_key").alias("_key")).withColumn("_first", F.lit(True))
    known = labels.filter(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("_key")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("_good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("_toxic"))
    whole = common.spread_join(counted.join(firsts.hint("merge"), ["_sha", "_key"], "left"), known, "_key", ["_sha", "part"], "left", counted=counted)
    repeats = F.col("_key").isNotNull() & F.col("_first").isNull()
    mask = F.col("_mask") + F.when(repeats, F.lit(1 << 4)).otherwise(F.lit(0))
    return whole.groupBy("part", mask.alias("mask")).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("_good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("_toxic"), F.col("n")).otherwise(0)).alias("toxic"))


def swaps(n: int) -> Iterator[int]:
    """Places i such that swapping i and i + 1, one after the other, visits every order of n things once.

    The largest thing runs through the order of the others; at each end the others make one swap of theirs."""
    if n < 2:
        return
    down = True
    for inner in itertools.chain(swaps(n - 1), [None]):
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        if inner is not None:
            yield inner + 1 if down else inner
        down = not down


class Walk:
    """The steps of an order over the mask cells of several parts, kept up to date from swap to swap.

    `cells`: parts x masks x (documents, good, toxic)."""

    def __init__(self, cells: np.ndarray, n: int):
        self.n, self.cells, self.order = n, cells.astype(np.int64), list(range(n))
        self.masks = np.arange(1 << n)
        self.failing = [self.cells[:, (self.masks >> f & 1) == 1, 0].sum(1) for f in range(n)]
        self.unique = [self.cells[:, 1 << f, 0] for f in range(n)]
        self.before = [0] * n  # the bits of the filters before each step
        self.kept = np.empty((len(cells), n + 1), np.int64)
        self.kept[:, 0] = self.cells[:, :, 0].sum(1)
        self.lost = np.empty((len(cells), n, 3), np.int64)
        self.shapley = np.zeros((len(cells), n), np.int64)
        for i in range(n):
            self._step(i)
        self._visit()

    def _step(self, i: int) -> None:
        """Count step `i`: its filter takes those that fail it and none before it."""
        f = self.order[i]
        self.before[i] = self.before[i - 1] | 1 << self.order[i - 1] if i else 0
        taken = (self.masks >> f & 1 == 1) & (self.masks & self.before[i] == 0)
        self.lost[:, i] = self.cells[:, taken].sum(1)
        self.kept[:, i + 1] = self.kept[:, i] - self.lost[:, i, 0]

    def _visit(self) -> None:
        self.shapley[:, self.order] += self.lost[:, :, 0]

    def swap(self, i: int) -> None:
        self.order[i], self.order[i + 1] = self.order[i + 1], self.order[i]
        self._step(i)
        self._step(i + 1)
        self._visit()

    def state(self) -> np.ndarray:
        """parts x steps x measures, but the Shapley values, which are whole after the walk only."""
        at = self.order
        failing, unique = (np.stack([x[f] for f in at], 1) for x in (self.failing, self.unique))
        return np.stack([self.kept[:, 1:], self.lost[:, :, 0], failing - self.lost[:, :, 0], unique, self.lost[:, :, 1], self.lost[:, :, 2]], 2)


def audit_parts(cells: np.ndarray, filters: str) -> tuple[list[str], np.ndarray]:
    """The orders in the walk's sequence, and parts x orders x steps x measures."""
    walk = Walk(cells, len(filters))
    orders, states = [list(walk.order)], [walk.state()]
    for i in swaps(len(filters)):
        walk.swap(i)
        orders.append(list(walk.order))
        states.append(walk.state())
    values = np.stack([walk.shapley[:, o] for o in orders], 1)
    return ["".join(filters[f] for f in o) for o in orders], np.concatenate([np.stack(states, 1), values[..., None]], 3)


def audit(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, filter_order, step and the measures, for every part, order and step. Parts are walked where they are."""
    n = len(filters)
    parts = cells.groupBy("part").agg(F.collect_list(F.struct(*(F.col(c).cast("long").alias(c) for c in ("mask", "n", "good", "toxic")))).alias("cells"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small(batches, PARTS):
            names = batch.column(0).to_pylist()
            held = np.zeros((len(names), 1 << n, 3), np.int64)
            for i, found in enumerate(batch.column(1).to_pylist()):
                for c in found:
                    held[i, c["mask"]] = c["n"], c["good"], c["toxic"]
            orders, values = audit_parts(held, filters)
            each = len(orders) * n
            made = [pa.array(np.repeat(names, each).tolist(), pa.string()), pa.array(np.tile(np.repeat(orders, n), len(names)).tolist(), pa.string()), pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), len(names) * len(orders)))]
            flat = values.reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([*made, *(pa.array(flat[:, k]) for k in range(len(MEASURES)))], names=["part", "filter_order", "step", *MEASURES])

    return common.map_arrow(parts, work, "part string, filter_order string, step int, " + ", ".join(f"{m} long" for m in MEASURES))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(mask_cells(common.documents(spark, sf_dir), table(spark, sf_dir, "labels")))
