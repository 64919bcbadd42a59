"""Packing of documents into sequences by column generation for the cutting-stock problem.

Documents are encoded once, an end id is appended, and they are cut at multiples of `CAPACITY` ids, so that each piece has 1
to `CAPACITY` ids and all but a document's last piece are full. What is packed are then pieces of whole documents, or the
rest of a long one.

The plan is made from the histogram of the pieces' lengths alone (at most `CAPACITY` numbers, whatever the corpus):
1. Lengths next to each other are merged into at most `CLASSES` classes where that wastes least; a class counts as long as
   its longest length. With no more distinct lengths than classes nothing is wasted.
2. A pattern says how many pieces of each class a sequence takes. The linear program asks for the fewest sequences that
   hold all pieces. It is solved by a revised simplex over generated columns: the dual prices of the classes go to a
   knapsack by dynamic programming over the capacity, which gives the pattern of most worth, until none is worth more than
   1 + `GAP`; the bound of the duals then puts the solution within that share of the optimum.
3. The uses of the patterns are rounded down, then up by size of their fractions while pieces remain for them. The few pieces
   that no rounded pattern takes (a number bounded by classes and capacity) are placed by best fit, longest first.
4. Sequences filled by less than `FILL` are taken apart: their pieces follow each other, longest first, and are cut where a
   sequence is full. So each sequence but the last of these has padding of at most a share of 1 - `FILL`, even where no
   whole pieces fit together (all of 1100 ids, say).

The patterns' places are given to ranked pieces: pieces of a length are ranked by (group, id, start), where groups are dealt by a
hash and hold about `GROUP` pieces, so no length is one task; ranges of ranks go to ranges of sequences by a broadcast table whose
size the histogram bounds. Offsets are running sums within a sequence, which has at most `CAPACITY` pieces.

Encoded pieces are stored once in the shared folder. Numbers of rows within their task tell equal rows apart, so a text that
a third of all rows repeat is dealt as evenly as others.

Null texts count as empty: one piece, the end id. A null id is an id like others. Texts of any length are encoded whole. Repeated rows
are packed each. An empty table gives an empty result. Additional columns aren't read.
"""

from __future__ import annotations

import bisect
import heapq
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.llm import common
from granary.llm.op1_sorted_shards import encoder

TOKENIZER = "byte_bpe_50k.json"
END_ID = 1
CAPACITY = 2048
CLASSES = 128
GAP = 0.002
FILL = 0.985
GROUP = 4000
#: Columns that the simplex may generate before it stops with what it has (never met; a guard against cycling).
MOST_COLUMNS = 20_000
#: Columns without a gain after which it stops: the basis holds all pieces at any time, and what it lacks goes to rounding.
STALLED = 150


# The plan -------------------------------------------------------------------------------------------------------------


def merged_lengths(histogram: dict[int, int], most: int = CLASSES) -> list[list[int]]:
    """The lengths in at most `most` runs, each in descending order, the longest run first.

    Starts with a run for each length and merges the neighbours whose merging adds the least rounding, again and again."""
    lengths = sorted(histogram)
    top, count, low = dict(zip(lengths, lengths)), dict(histogram), {x: x for x in lengths}  # runs by their longest length
    above = dict(zip(lengths, lengths[1:]))
    below = {b: a for a, b in above.items()}
    heap = [(count[a] * (b - a), a, b) for a, b in above.items()]
    heapq.heapify(heap)
    while len(top) > most:
        cost, a, b = heapq.heappop(heap)
        if a not in top or above.get(a) != b or cost != count[a] * (b - a):
            continue  # of an earlier state
        count[b] += count.pop(a)
        low[b] = low.pop(a)
        del top[a]
        before = below.pop(a, None)
        below.pop(b, None)
        above.pop(a)
        if before is not None:
            above[before], below[b] = b, before
            heapq.heappush(heap, (count[before] * (b - before), before, b))
        if b in above:
            heapq.heappush(heap, (count[b] * (above[b] - b), b, above[b]))
    held = np.array(lengths)
    return [held[np.searchsorted(held, low[b]) : np.searchsorted(held, b, "right")][::-1].tolist() for b in sorted(top, reverse=True)]


class Knapsack:
    """The most worth that a sequence can hold, by dynamic programming over the capacity."""

    def __init__(self, sizes: list[int], capacity: int):
        self.capacity, self.order = capacity, np.argsort(sizes, kind="stable")
        self.sizes = np.array(sizes)[self.order]
        self.fitting = np.searchsorted(self.sizes, np.arange(capacity + 1), "right")
        self.before = [c - self.sizes[:k] for c, k in enumerate(self.fitting)]

    def best(self, worth: np.ndarray) -> tuple[float, dict[int, int]]:
        """The worth and the pattern: how often each thing is taken."""
        worth = worth[self.order]
        best, taken = np.zeros(self.capacity + 1), np.full(self.capacity + 1, -1)
        for c in range(1, self.capacity + 1):
            best[c], k = best[c - 1], self.fitting[c]
            if k:
                sums = best[self.before[c]] + worth[:k]
                i = int(sums.argmax())
                if sums[i] > best[c]:
                    best[c], taken[c] = sums[i], i
        pattern, c = {}, self.capacity
        while c > 0:
            if taken[c] < 0:
                c -= 1
                continue
            i = int(self.order[taken[c]])
            pattern[i] = pattern.get(i, 0) + 1
            c -= int(self.sizes[taken[c]])
        return float(best[self.capacity]), pattern


def solve(sizes: list[int], demand: list[int], capacity: int = CAPACITY, gap: float = GAP) -> tuple[list[dict[int, int]], np.ndarray, float]:
    """Patterns of the basis, how often each is used (fractions) and a lower bound on the number of sequences."""
    m = len(sizes)
    patterns = [{i: capacity // s} for i, s in enumerate(sizes)]
    inverse = np.diag([1.0 / (capacity // s) for s in sizes])
    # Slightly different demands keep equal ratios, and with them pivots that change nothing, away.
    wanted = np.array(demand, float) * (1 + 1e-7 * np.random.default_rng(1).random(m))
    best, since = math.inf, 0
    used, knapsack, bound = inverse @ wanted, Knapsack(sizes, capacity), 0.0
    for turn in range(MOST_COLUMNS):
        prices = inverse.sum(0)
        worth, pattern = knapsack.best(prices)
        bound = max(bound, float(prices @ wanted) / max(worth, 1.0))  # prices / worth are dual feasible
        since = 0 if used.sum() < best * (1 - 1e-5) else since + 1
        best = min(best, float(used.sum()))
        if worth <= 1 + max(gap, 1e-9) or used.sum() <= bound * (1 + gap) or since > STALLED:
            break
        column = np.zeros(m)
        for i, k in pattern.items():
            column[i] = k
        step = inverse @ column
        ratios = np.where(step > 1e-9, used / np.where(step > 1e-9, step, 1.0), np.inf)
        leaves = int(ratios.argmin())
        amount = max(0.0, float(ratios[leaves]))
        used -= amount * step
        used[leaves] = amount
        row = inverse[leaves] / step[leaves]
        inverse -= np.outer(step, row)
        inverse[leaves] = row
        patterns[leaves] = pattern
        if turn % 500 == 499:  # a Newton step takes rounding errors away; einsum, as it starts no threads in the driver
            basis = np.array([[p.get(i, 0) for p in patterns] for i in range(m)], float)
            inverse = 2 * inverse - np.einsum("ij,jk->ik", np.einsum("ij,jk->ik", inverse, basis), inverse)
            used = np.maximum(inverse @ wanted, 0.0)
    return patterns, np.maximum(inverse @ np.array(demand, float), 0.0), bound


def rounded(patterns: list[dict[int, int]], used: np.ndarray, demand: list[int]) -> tuple[list[int], list[int]]:
    """Whole uses of the patterns that no class runs out in, and the pieces of each class that are left."""
    times = [max(0, math.floor(x + 1e-9)) for x in used]
    left = np.array(demand, np.int64)
    for p, k in zip(patterns, times):
        for i, a in p.items():
            left[i] -= a * k
    for i in np.flatnonzero(left < 0).tolist():  # a floor that rounding errors made too large
        for j, p in enumerate(patterns):
            while left[i] < 0 and p.get(i) and times[j]:
                times[j] -= 1
                for x, a in p.items():
                    left[x] += a
    for j in np.argsort(-(used - np.floor(used)), kind="stable").tolist():
        if all(left[i] >= a for i, a in patterns[j].items()):
            times[j] += 1
            for i, a in patterns[j].items():
                left[i] -= a
    return times, left.tolist()


def best_fit(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Sequences as lists of the places of `lengths` (descending): each piece goes where it leaves least."""
    rooms: list[tuple[int, int]] = []  # (room, sequence), ascending
    found: list[list[int]] = []
    for i, n in enumerate(lengths):
        at = bisect.bisect_left(rooms, (n, -1))
        room, s = rooms.pop(at) if at < len(rooms) else (capacity, len(found))
        if s == len(found):
            found.append([])
        found[s].append(i)
        bisect.insort(rooms, (room - n, s))
    return found


@dataclass
class Plan:
    """Rows (length, first rank, rank behind, sequence of the first place, pieces a sequence takes, place of the first rank), and
    cut rows (length, first rank, rank behind, place in the stream of what is cut); `cut_base` is the stream's first sequence."""

    places: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)
    cuts: list[tuple[int, int, int, int]] = field(default_factory=list)
    cut_base: int = 0
    sequences: int = 0
    bound: float = 0.0


def make_plan(histogram: dict[int, int], capacity: int = CAPACITY, classes: int = CLASSES, gap: float = GAP, fill: float = FILL) -> Plan:
    plan, whole = Plan(), {n: c for n, c in histogram.items() if c > 0}
    if not whole:
        return plan
    runs = merged_lengths(whole, classes)
    demand = [sum(whole[n] for n in run) for run in runs]
    patterns, used, plan.bound = solve([run[0] for run in runs], demand, capacity, gap)
    times, left = rounded(patterns, used, demand)
    begins = []  # per class: (first rank of the class, length), descending lengths
    for run in runs:
        at, held = 0, []
        for n in run:
            held.append((at, n))
            at += whole[n]
        begins.append(held)

    def split(i: int, low: int, high: int) -> Iterator[tuple[int, int, int]]:
        """The ranks low to high of class `i` as ranges of ranks of single lengths, with the rank in the class they begin at."""
        for at, n in begins[i]:
            a, b = max(low, at), min(high, at + whole[n])
            if a < b:
                yield n, a - at, b - at

    given = [0] * len(runs)
    loose: list[tuple[int, int, int]] = []  # (length, first rank, rank behind) of what is cut
    for p, k in zip(patterns, times):
        if not k:
            continue
        poor = sum(runs[i][0] * a for i, a in p.items()) < fill * capacity
        for i, a in p.items():
            place = 0
            for n, low, high in split(i, given[i], given[i] + a * k):
                if poor:
                    loose.append((n, low, high))
                else:
                    plan.places.append((n, low, high, plan.sequences, a, place))
                place += high - low
            given[i] += a * k
        plan.sequences += 0 if poor else k
    rest = [(n, r) for i, k in enumerate(left) for n, low, high in split(i, given[i], given[i] + k) for r in range(low, high)]
    rest.sort(reverse=True)
    for held in best_fit([n for n, _ in rest], capacity):
        if sum(rest[j][0] for j in held) < fill * capacity:
            loose += [(rest[j][0], rest[j][1], rest[j][1] + 1) for j in held]
            continue
        plan.places += [(rest[j][0], rest[j][1], rest[j][1] + 1, plan.sequences, 1, 0) for j in held]
        plan.sequences += 1
    plan.cut_base, at = plan.sequences, 0
    for n, low, high in sorted(loose, reverse=True):
        plan.cuts.append((n, low, high, at))
        at += n * (high - low)
    plan.sequences += -(-at // capacity)
    return plan


# The pieces -----------------------------------------------------------------------------------------------------------


def encoded(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID, capacity: int = CAPACITY, key: str = "doc_id", column: str = "text") -> DataFrame:
    """A row for each piece: id, start, length, ids (little-endian unsigned 32-bit), their crc32, doc_tokens, and the row's
    number in its task."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(column).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, row = encoder(tokenizer, end_id), 0
        for batch in common.small(batches):
            doc, start, length, ids, crc, total, number = ([] for _ in range(7))
            for d, packed in zip(batch.column(0).to_pylist(), held.encode(common.texts(batch))):
                wide = np.frombuffer(packed, f"<u{held.width}").astype("<u4").tobytes()
                n = len(wide) // 4
                for at in range(0, n, capacity):
                    piece = wide[4 * at : 4 * (at + capacity)]
                    for c, x in zip((doc, start, length, ids, crc, total, number), (d, at, len(piece) // 4, piece, zlib.crc32(piece), n, row)):
                        c.append(x)
                    row += 1
            long = pa.int64()
            yield pa.RecordBatch.from_arrays([pa.array(doc, long), pa.array(start, long), pa.array(length, pa.int32()), pa.array(ids, pa.binary()), pa.array(crc, long), pa.array(total, long), pa.array(number, long)], names=["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "row"])

    return common.map_arrow(rows, work, "doc_id long, start long, length int, ids binary, ids_crc32 long, doc_tokens long, row long")


def ranked(pieces: DataFrame, histogram: dict[int, int], group: int = GROUP) -> DataFrame:
    """`pieces` with their rank (from 0) among those of their length.

    A length's pieces are dealt to groups of about `group` by a hash; ranks are within groups, after the groups before."""
    spark = pieces.sparkSession
    sizes = F.broadcast(spark.createDataFrame([(n, -(-c // group)) for n, c in histogram.items()], "length int, _groups long"))
    dealt = pieces.join(sizes, "length").withColumn("_group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "row"), F.col("_groups"))).drop("_groups")
    counts = dealt.groupBy("length", "_group").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("length", "_group", F.coalesce(before, F.lit(0)).alias("_base"))
    within = F.row_number().over(Window.partitionBy("length", "_group").orderBy("doc_id", "start", "ids_crc32", "row")) - 1
    return dealt.withColumn("_within", within).join(bases, ["length", "_group"]).withColumn("rank", F.col("_base") + F.col("_within")).drop("_group", "_within", "_base")


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID, capacity: int = CAPACITY, classes: int = CLASSES, fill: float = FILL, key: str = "doc_id", column: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for each piece, and its ids if wanted."""
    spark, stored = docs.sparkSession, common.written(encoded(docs, tokenizer, end_id, capacity, key, column), "pieces")
    histogram = {r["length"]: r["count"] for r in stored.groupBy("length").count().collect()}  # at most `capacity` rows
    plan = make_plan(histogram, capacity, classes, fill=fill)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids]
    kept = [*names, "sequence_id", "offset"]
    between = (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))

    places = spark.createDataFrame(plan.places, "_length int, low long, high long, base long, per long, place long")
    pieces = ranked(stored.select(*names, "row"), histogram)
    at = F.col("place") + F.col("rank") - F.col("low")
    whole = pieces.join(F.broadcast(places), (F.col("length") == F.col("_length")) & between).withColumn("sequence_id", F.col("base") + F.floor(at / F.col("per")))
    before = F.sum("length").over(Window.partitionBy("sequence_id").orderBy(F.desc("length"), "rank").rowsBetween(Window.unboundedPreceding, -1))
    found = whole.withColumn("offset", F.coalesce(before, F.lit(0))).select(*[F.col(c).cast("long") if c == "length" else c for c in kept])
    if not plan.cuts:
        return found
    # What is cut needs its ids, and only these lengths are read with them.
    cuts = spark.createDataFrame(plan.cuts, "_length int, low long, high long, at long")
    lengths = sorted({c[0] for c in plan.cuts})
    taken = ranked(stored.filter(F.col("length").isin(lengths)), {n: histogram[n] for n in lengths})
    begin = F.col("at") + (F.col("rank") - F.col("low")) * F.col("length")
    placed = taken.join(F.broadcast(cuts), (F.col("length") == F.col("_length")) & between).withColumn("begin", begin)
    first = F.floor(F.col("begin") / capacity)
    last = F.floor((F.col("begin") + F.col("length") - 1) / capacity)
    parts = placed.withColumn("_s", F.explode(F.sequence(first, last)))
    low = F.greatest(F.col("begin"), F.col("_s") * capacity)
    high = F.least(F.col("begin") + F.col("length"), (F.col("_s") + 1) * capacity)
    parts = parts.withColumn("_low", low).withColumn("_high", high).withColumn("ids", F.expr("substring(ids, CAST(4 * (_low - begin) + 1 AS INT), CAST(4 * (_high - _low) AS INT))"))
    made = {"start": F.col("start") + F.col("_low") - F.col("begin"), "length": F.col("_high") - F.col("_low"), "ids_crc32": F.crc32("ids"), "sequence_id": F.lit(plan.cut_base) + F.col("_s"), "offset": F.col("_low") - F.col("_s") * capacity}
    return found.union(parts.select(*[made[c].alias(c) if c in made else F.col(c) for c in kept]))


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its ids, from pieces with ids. A sequence has at most the capacity's number of pieces."""
    held = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("_pieces"))
    return held.select("sequence_id", F.aggregate("_pieces", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.documents(spark, sf_dir))
