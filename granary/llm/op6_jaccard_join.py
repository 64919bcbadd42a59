"""N-gram Jaccard join by rare-first prefix filtering, and the components of its links.

A document's set holds the 64-bit hashes of its distinct shingles (`size` consecutive words, A-Z lower-cased; of fewer
words, the whole sequence). Documents with equal sets are one node, known by a 64-bit hash of the set. Two nodes link
when |x & y| * 100 >= percent * |x | y|.

Steps
    scan        one pass notes each document's node and packs its shingles, by hash ranges, for an exact count: windows of
                each task merge their own first, then each range is summed in one place
    order       shingles by that count, rare first, then by hash. At most `FREQUENT` counts, as a histogram proves, are
                broadcast; every other shingle is known to be rarer than all of those and comes before them. The order
                is the same everywhere, and any such order gives the same links
    prefixes    each set gives its first n - ceil(n * percent / 100) + 1 shingles: linked sets share one of them. A
                shingle that may stand in over `BLOCK` sets, by its count or by the bound for those without one, is
                dealt to several salts, so no run of rows is longer than about that
    candidates  rows of one shingle meet in order. Pairs must pass the length filter, the positional filter (the sets
                can't share more than what follows their places) and the suffix filter (the sum of the differences of
                shingle counts in hash ranges bounds the sets' difference from below)
    verify      each distinct pair once, on the whole texts
    components  by large-star and small-star rounds

A shingle that over `STAR` nodes share first links each of them to the two nodes in which it stands foremost. The
components of those links are found, and then all pairs that pass the filters and lie in different components are verified,
so that a large group of near copies does not give all its pairs while no link between components is missed. Shingles
with over `BLOCK` nodes are compared in pairs of blocks. Joins by a node that very many rows share (the centre of a star,
the root of a component) are salted.

Null and empty texts have no set: 0 shingles, linked with nothing, their own component. Rows with a null key are not
linked and have a null component. Rows with one key count as one document. Equal sets are one node, whatever their texts;
texts of any length are taken whole, each a step of its own. An empty table gives an empty result. Additional columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import common

SIZE = 3
PERCENT = 90
#: Shingles whose counts are broadcast, at most; shingles a task holds while it counts; bits of a hash that are counted by
#: (all others alike are one), and the count from which a shingle has a place among the frequent ones.
FREQUENT, HELD, COUNTED_BITS, LEAST = 400_000, 2_000_000, 42, 3
STAR, BLOCK = 4, 20_000
#: Pairs that are compared in one step.
PAIRS = 1 << 20
#: Hash ranges (as a power of two) in which each set's shingles are counted once, a byte each.
RANGE_BITS = 7
#: Keys that a fetch of texts broadcasts, at most (8 MB), and words whose hashes a task remembers.
FETCHED, WORDS = 500_000, 250_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xBF58476D1CE4E5B9)


class Shingler(dict):
    """Texts to sorted arrays of shingle hashes, many texts at a time; word hashes are remembered within bounds."""

    def __init__(self, size: int = SIZE):
        super().__init__()
        self.size = size

    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self) > WORDS:
            self.clear()
        lists = [(t or "").encode("utf-8", "replace").translate(_LOWER).split() for t in texts]
        sizes = [len(words) for words in lists]
        ids = np.fromiter(map(self.__getitem__, (w for words in lists for w in words)), np.uint64, sum(sizes))
        whole = self._keys(ids, self.size)
        found, at = [], 0
        for n in sizes:
            key = whole[at : at + n - self.size + 1] if n >= self.size else self._keys(ids[at : at + n], n)
            at += n
            key = np.sort(key)
            found.append(key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key)
        return found

    @staticmethod
    def _keys(ids: np.ndarray, n: int) -> np.ndarray:
        if not n or len(ids) < n:
            return np.empty(0, np.uint64)
        with np.errstate(over="ignore"):
            key = np.full(len(ids) - n + 1, n, np.uint64)
            for k in range(n):
                key = (key ^ (key >> np.uint64(31))) * _MIX + ids[k : k + len(key)]
            key = (key ^ (key >> np.uint64(29))) * _MIX2
            return key ^ (key >> np.uint64(32))


def node_of(shingles: np.ndarray) -> int | None:
    """The signed 64-bit hash of a set; None for an empty one."""
    if not len(shingles):
        return None
    found = xxhash.xxh3_64_intdigest(shingles.tobytes())
    return found - (1 << 64) if found >> 63 else found


def ceil_share(n, percent: int = PERCENT):
    return (n * percent + 99) // 100


def least_overlap(a, b, percent: int = PERCENT):
    """Shared shingles that sets of these sizes need to link."""
    return ((a + b) * percent + 100 + percent - 1) // (100 + percent)


def signature(shingles: np.ndarray) -> int:
    """Counts of shingles in eight hash ranges, each modulo 256, in one integer."""
    counts = np.bincount((shingles >> np.uint64(61)).astype(np.int64), minlength=8) & 255
    return int.from_bytes(counts.astype(np.uint8).tobytes(), "little", signed=True)


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A lower bound of the sets' difference, from signatures."""
    x, y = (v.astype("<i8").view(np.uint8).reshape(-1, 8).astype(np.int16) for v in (a, b))
    gap = np.abs(x - y)
    return np.minimum(gap, 256 - gap).sum(1)


def ranges(shingles: np.ndarray) -> bytes:
    """Counts of shingles in 2 ** RANGE_BITS hash ranges, at most 255 each."""
    counts = np.bincount((shingles >> np.uint64(64 - RANGE_BITS)).astype(np.int64), minlength=1 << RANGE_BITS)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def close(n: np.ndarray, m: np.ndarray, a: list[bytes], b: list[bytes], percent: int) -> np.ndarray:
    """Which pairs of sets, of sizes n and m, can link by their counts in hash ranges: the suffix filter, in finer ranges.
    Counts at their most hide a difference and never make one."""
    x, y = (np.frombuffer(b"".join(v), np.uint8).reshape(-1, 1 << RANGE_BITS).astype(np.int16) for v in (a, b))
    return np.abs(x - y).sum(1) <= n + m - 2 * least_overlap(n, m, percent)


def passes(n, place, sign, i, j, percent: int) -> np.ndarray:
    """Which of the pairs (i, j) of rows pass the length, positional and suffix filters."""
    a, b = n[i], n[j]
    need = least_overlap(a, b, percent)
    good = (100 * np.minimum(a, b) >= percent * np.maximum(a, b)) & (np.minimum(a - place[i], b - place[j]) >= need)
    some = np.flatnonzero(good)
    good[some] = apart(sign[i[some]], sign[j[some]]) <= (a + b - 2 * need)[some]
    return good


def range_bits(parts: int) -> int:
    """Hash ranges by which shingles are counted, as a power of two: several for each shuffle partition."""
    return max(10, min(30, (8 * parts - 1).bit_length()))


def scan(docs: DataFrame, key: str, column: str, size: int, bits: int) -> DataFrame:
    """Rows (key, node, n, ranges) for each document, the ranges once while a task remembers the node, and rows (range,
    hashes, counts) with the packed shingles of those sets. Rows with a null key link with nothing, so they give neither."""
    names = ["key", "node", "n", "ranges", "range", "hashes", "counts"]
    low = COUNTED_BITS - bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, held, total, seen = Shingler(size), [], 0, set()

        def packed() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held or [np.empty(0, np.uint64)]) >> np.uint64(64 - COUNTED_BITS), return_counts=True)
            owner = (values >> np.uint64(low)).astype(np.int64)
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.empty(0, np.int64)
            rest = (values & np.uint64((1 << low) - 1)).astype(np.uint32)
            pieces = [(a, b) for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(owner)])]
            longs, few = pa.nulls(len(pieces), pa.int64()), counts.astype(np.uint32)
            arrays = [longs, longs, longs, pa.nulls(len(pieces), pa.binary()), pa.array(owner[starts].astype(np.int32)), pa.array([rest[a:b].tobytes() for a, b in pieces], pa.binary()), pa.array([few[a:b].tobytes() for a, b in pieces], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            nodes, sizes, marks = [], [], []
            for keyed, s in zip(batch.column(0).is_valid().to_pylist(), shingler(common.texts(batch))):
                node = node_of(s)
                fresh = keyed and node is not None and node not in seen
                nodes.append(node)
                sizes.append(len(s))
                marks.append(ranges(s) if fresh else None)
                if fresh:
                    seen.add(node)
                    held.append(s)
                    total += len(s)
            n = len(nodes)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(marks, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], names=names)
            if total > HELD:
                yield packed()
                held, total, seen = [], 0, set()
        yield packed()

    return common.map_batches(docs.select(F.col(key).cast("long").alias("key"), F.col(column).alias("text")), run, "key long, node long, n long, ranges binary, range int, hashes binary, counts binary")


def exact_counts(scanned: DataFrame, bits: int) -> DataFrame:
    """(shingle, count) of every shingle, by its first COUNTED_BITS bits, with a count of LEAST or more."""
    parts = int(scanned.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = scanned.filter("range is not null").select("range", "hashes", "counts").repartition(parts, "range").sortWithinPartitions("range")
    low = COUNTED_BITS - bits

    def merged(owner: int, hashes: list[bytes], counts: list[bytes]) -> pa.RecordBatch:
        values, n = np.frombuffer(b"".join(hashes), np.uint32), np.frombuffer(b"".join(counts), np.uint32)
        order = np.argsort(values, kind="stable")
        values = values[order]
        starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
        total = np.add.reduceat(n[order].astype(np.int64), starts)
        some = total >= LEAST
        found = values[starts][some].astype(np.int64) | owner << low
        return pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[some])], names=["shingle", "count"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, hashes, counts = None, [], []
        for batch in batches:
            for r, h, c in zip(*(x.to_pylist() for x in batch.columns)):
                if r != owner and hashes:
                    yield merged(owner, hashes, counts)
                    hashes, counts = [], []
                owner = r
                hashes.append(h)
                counts.append(c)
        if hashes:
            yield merged(owner, hashes, counts)

    return common.map_batches(rows, run, "shingle long, count long")


@dataclass
class Order:
    """Sorted shingles (their first COUNTED_BITS bits) with counts, at most FREQUENT; others have counts of `rest` at most."""

    keys: np.ndarray
    counts: np.ndarray
    rest: int


def frequent_order(scanned: DataFrame, bits: int) -> Order:
    counts = common.written(exact_counts(scanned, bits), "join-counts")
    step = F.floor(4 * F.log2("count")).cast("int")
    taken, least = 0, None
    for b in counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n"), F.max("count").alias("most")).orderBy(F.desc("step")).collect():
        taken += b["n"]
        if taken > FREQUENT:
            rest = b["most"]
            break
        least = b["step"]
    else:
        rest = LEAST - 1
    rows = counts.filter(step >= least if least is not None else F.lit(False)).toArrow()
    keys = rows["shingle"].to_numpy().astype(np.int64)
    order = np.argsort(keys)
    return Order(keys[order].astype(np.uint64), rows["count"].to_numpy()[order], rest)


def noticed(shingles: np.ndarray, order: Order) -> np.ndarray:
    """The broadcast counts of shingles, 0 where there is none."""
    if not len(order.keys):
        return np.zeros(len(shingles), np.int64)
    known = shingles >> np.uint64(64 - COUNTED_BITS)
    at = np.minimum(np.searchsorted(order.keys, known), len(order.keys) - 1)
    return np.where(order.keys[at] == known, order.counts[at], 0)


def prefix(shingles: np.ndarray, order: Order, percent: int) -> np.ndarray:
    n = len(shingles)
    return shingles[np.lexsort((shingles, noticed(shingles, order)))[: n - ceil_share(n, percent) + 1]]


def prefix_rows(docs: DataFrame, order: Order, column: str, size: int, percent: int, block: int) -> DataFrame:
    """A row (shingle, salt, salts, node, n, place, sign) for each shingle of each set's prefix; a task gives a node once
    while it remembers it. Shingles that over `block` sets may hold are dealt by the node to several salts."""
    shared = docs.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen = Shingler(size), set()
        for batch in batches:
            parts, about = [], []
            for s in shingler(common.texts(batch, column)):
                node = node_of(s)
                if node is None or node in seen:
                    continue
                seen.add(node)
                parts.append(prefix(s, shared.value, percent))
                about.append((node, len(s), signature(s)))
            if len(seen) > 1_000_000:
                seen.clear()
            if parts:
                sizes = [len(p) for p in parts]
                node, n, sign = (np.repeat(np.array(c, np.int64), sizes) for c in zip(*about))
                place = np.concatenate([np.arange(k) for k in sizes])
                shingle = np.concatenate(parts)
                held = noticed(shingle, shared.value)
                salts = np.maximum(1, -(-np.where(held, held, shared.value.rest) // block))
                yield pa.RecordBatch.from_arrays([pa.array(shingle.view(np.int64)), pa.array((node % salts).astype(np.int32)), pa.array(salts.astype(np.int32)), pa.array(node), pa.array(n.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(sign)], names=["shingle", "salt", "salts", "node", "n", "place", "sign"])

    return common.map_batches(docs.select(column), run, "shingle long, salt int, salts int, node long, n int, place int, sign long")


def runs(batches: Iterator[pa.RecordBatch], keys: int = 1) -> Iterator[list[np.ndarray]]:
    """Sorted rows in whole runs of equal first `keys` columns, many runs at a time."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        held = new if held is None else [np.concatenate(p) for p in zip(held, new)]
        last = np.ones(len(held[0]), bool)
        for k in range(keys):
            last &= held[k] == held[k][-1]
        cut = int(np.argmax(last))
        if cut:
            yield [c[:cut] for c in held]
            held = [c[cut:] for c in held]
    if held is not None:
        yield held


def edges_of(columns: list[np.ndarray]) -> np.ndarray:
    change = np.zeros(len(columns[0]), bool)
    change[0] = True
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(change)


_PAIR_NAMES = ["x", "y", "shingle", "blocks", "node", "n", "place", "sign"]


def _unique_nodes(cols: list[np.ndarray]) -> list[np.ndarray]:
    """Rows (shingle, salt, salts, node, ...) sorted by shingle, salt and node, each once."""
    order = np.lexsort((cols[3], cols[1], cols[0]))
    cols = [c[order] for c in cols]
    first = edges_of([cols[0], cols[1], cols[3]])
    return [c[first] for c in cols]


def first_candidates(rows: DataFrame, percent: int, block: int) -> DataFrame:
    """Pairs (x, y) of rare shingles and stars of shared ones, and the rows of shared shingles with their number of blocks;
    `rows` are sorted by (shingle, salt)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in runs(batches, 2):
            shingle, salt, salts, node, n, place, sign = _unique_nodes(cols)
            n, place = n.astype(np.int64), place.astype(np.int64)
            starts = edges_of([shingle, salt])
            sizes = np.diff(np.append(starts, len(shingle)))
            several = (sizes > STAR) | (salts[starts] > 1)
            blocks = np.repeat(np.where(salts[starts] > 1, salts[starts], -(-sizes // block)), sizes).astype(np.int32)
            left, right, kept = [], [], []
            for k in range(2, STAR + 1):  # all runs of one size together
                own = starts[(sizes == k) & ~several]
                if len(own):
                    a, b = np.triu_indices(k, 1)
                    left.append((own[:, None] + a).ravel())
                    right.append((own[:, None] + b).ravel())
            for s, k in zip(starts[several].tolist(), sizes[several].tolist()):
                own = np.arange(s, s + k)
                kept.append(own)
                for centre in own[np.lexsort((node[own], place[own]))[:2]]:
                    left.append(np.full(k - 1, centre))
                    right.append(own[own != centre])
            i, j = (np.concatenate(v) if v else np.empty(0, np.int64) for v in (left, right))
            good = passes(n, place, sign, i, j, percent)
            x, y = np.minimum(node[i[good]], node[j[good]]), np.maximum(node[i[good]], node[j[good]])
            pairs = np.unique(np.stack([x, y], 1), axis=0)
            if len(pairs):
                nulls = [pa.nulls(len(pairs), t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), *nulls], names=_PAIR_NAMES)
            if kept:
                at = np.concatenate(kept)
                nulls = pa.nulls(len(at), pa.int64())
                found = (shingle, blocks, node, n.astype(np.int32), place.astype(np.int32), sign)
                yield pa.RecordBatch.from_arrays([nulls, nulls, *(pa.array(c[at]) for c in found)], names=_PAIR_NAMES)

    return common.map_arrow(rows, run, "x long, y long, shingle long, blocks int, node long, n int, place int, sign long")


def second_candidates(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that pass the filters; `rows` are sorted by (shingle, low, high)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in runs(batches, 3):
            shingle, low, high, block, node, n, place, sign, part = cols
            n, place = n.astype(np.int64), place.astype(np.int64)
            starts = edges_of([shingle, low, high])
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(shingle)]):
                own = np.arange(s, e)
                names, sizes = np.unique(part[own], return_counts=True)
                if len(names) < 2:
                    continue
                largest = names[sizes.argmax()]
                inner = own[part[own] == largest]
                outer = own[part[own] != largest]
                same = low[s] == high[s]
                for other in (inner, outer):
                    step = max(1, PAIRS // len(other))
                    for at in range(0, len(outer), step):
                        some = outer[at : at + step]
                        i, j = np.repeat(some, len(other)), np.tile(other, len(some))
                        ok = part[i] != part[j]
                        if not same:
                            ok &= block[i] != block[j]
                        i, j = i[ok], j[ok]
                        good = passes(n, place, sign, i, j, percent)
                        pairs = np.unique(np.stack([np.minimum(node[i[good]], node[j[good]]), np.maximum(node[i[good]], node[j[good]])], 1), axis=0)
                        if len(pairs):
                            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["x", "y"])

    return common.map_arrow(rows, run, "x long, y long")


def verify(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (x, y) that link: those that counts in fine hash ranges don't exclude are compared, once, by the whole
    sets of their texts.

    Each node's text comes from the row of the node's smallest key. Keys are broadcast up to `FETCHED` of them and joined
    by a shuffle beyond that."""
    a, b = (nodes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("ranges").alias(f"r{c}")) for c in ("x", "y"))
    pairs = common.written(pairs.select("x", "y").distinct(), "join-met")
    marked = common.spread_join(common.spread_join(pairs, a, "x", ["y"]), b, "y", ["x"], counted=pairs).select("x", "y", "nx", "ny", "rx", "ry")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            good = close(n, m, batch.column(4).to_pylist(), batch.column(5).to_pylist(), percent) if len(n) else []
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    pairs = common.written(common.map_arrow(marked, near, "x long, y long"), "join-pairs")
    wanted = pairs.select(F.explode(F.array("x", "y")).alias("node")).distinct()
    keys = common.written(nodes.select("node", "key").join(wanted, "node"), "join-keys")
    few = keys.count() <= FETCHED
    rows = (docs.join(F.broadcast(keys), "key") if few else common.spread_join(docs, keys, "key", ["text"], counted=docs.select("key"))).select("node", "text")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen = Shingler(size), set()  # repeated rows of a node: the first of a task stays
        for batch in batches:
            nodes = batch.column(0).to_pylist()
            good = [node_of(s) == n and not (n in seen or seen.add(n)) for s, n in zip(shingler(common.texts(batch)), nodes)]
            yield batch.filter(pa.array(good, pa.bool_()))

    found = common.written(common.map_batches(rows, own, "node long, text string"), "join-texts")
    if found.groupBy("node").count().filter("count > 1").head(1):  # and one of those of several tasks
        found = common.written(found.groupBy("node").agg(F.min("text").alias("text")), "join-texts")
    left = found.select(F.col("node").alias("x"), F.col("text").alias("tx"))
    right = found.select(F.col("node").alias("y"), F.col("text").alias("ty"))
    both = common.spread_join(common.spread_join(pairs, left, "x", ["y"]), right, "y", ["x"], counted=pairs).select("x", "y", "tx", "ty")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, known = Shingler(size), {}
        for batch in batches:
            names = [batch.column(k).to_pylist() for k in (0, 1)]
            new = {n: (2 + k, i) for k in (0, 1) for i, n in enumerate(names[k]) if n not in known}
            known.update(zip(new, shingler([batch.column(c)[i].as_py() for c, i in new.values()])))
            good = []
            for a, b in zip(*names):
                p, q = known[a], known[b]
                shared = len(np.intersect1d(p, q, assume_unique=True))
                good.append(100 * shared >= percent * (len(p) + len(q) - shared))
            if len(known) > 2000:
                known.clear()
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return common.written(common.map_batches(both, compare, "x long, y long").distinct(), "join-links")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in a link; the root is the component's smallest node."""
    spark = links.sparkSession
    edges = links.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).filter("u <> v").distinct()
    edges, path = common.stored(edges, "join-edges")
    before = None
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        before = mark
        turned = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
        least = edges.unionByName(turned).groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = common.spread_join(turned, least, "u", ["v"]).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large, middle = common.stored(large, "join-edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = common.spread_join(large, least, "u", ["v"]).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges, new = common.stored(small.filter("u <> v").distinct(), "join-edges")
        for old in (path, middle):
            common.remove_folder(spark, old)
        path = new


def link_sets(docs: DataFrame, scanned: DataFrame, nodes: DataFrame, column: str, size: int, percent: int, bits: int) -> DataFrame:
    """(node, root) of every node that links with another; `docs` has the columns key and text."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = prefix_rows(docs, frequent_order(scanned, bits), column, size, percent, BLOCK)
    rows = rows.repartition(parts, "shingle", "salt").sortWithinPartitions("shingle", "salt")
    met = common.written(first_candidates(rows, percent, BLOCK), "join-met")
    links = verify(docs, nodes, met.filter("x is not null"), size, percent)
    found = common.written(components(links), "join-components")
    blocks = F.col("blocks").cast("long")
    each = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda c: F.struct(F.least(F.col("block"), c).alias("low"), F.greatest(F.col("block"), c).alias("high"))))
    rows = (
        common.spread_join(met.filter("x is null").drop("x", "y"), found, "node", ["shingle"], "left").withColumn("block", F.pmod(F.xxhash64("node"), blocks)).withColumn("p", each)
        .select("shingle", "p.low", "p.high", "block", "node", "n", "place", "sign", F.coalesce("root", "node").alias("part"))
    )
    rows = rows.repartition(parts, "shingle", "low", "high").sortWithinPartitions("shingle", "low", "high")
    more = verify(docs, nodes, second_candidates(rows, percent), size, percent)
    return components(links.unionByName(more))


def join(docs: DataFrame, key: str = "doc_id", column: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """key, n_shingles and component_id (the smallest key of the component) of every row."""
    docs = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{column}`").alias("text"))
    bits = range_bits(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    scanned = common.written(scan(docs, "key", "text", size, bits), "join-scan")
    ids = scanned.filter("range is null").select("key", "node", "n")
    keyed = ids.filter("key is not null and node is not null")
    nodes = scanned.filter("key is not null and node is not null").groupBy("node").agg(F.min("key").alias("key"), F.max(F.struct("n", "ranges")).alias("m"))
    nodes = common.written(nodes.select("node", "key", "m.n", "m.ranges"), "join-nodes")
    found = common.written(link_sets(docs.filter(F.col("key").isNotNull()), scanned, nodes, "text", size, percent, bits), "join-roots")
    # Rows of one key are one document: their sets' components are one.
    twice = keyed.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a <> b").select("key", "a")
    doubled = common.spread_join(keyed, twice, "key", ["node"]).filter("node <> a").select(F.col("node").alias("x"), F.col("a").alias("y"))
    doubled = common.written(doubled.distinct(), "join-doubled")
    if doubled.head(1):
        found = common.written(components(found.select(F.col("node").alias("x"), F.col("root").alias("y")).unionByName(doubled)), "join-roots")
    # The smallest key of each component by its nodes' smallest keys.
    least = found.join(nodes.select("node", "key"), "node").groupBy("root").agg(F.min("key").alias("component_id"))
    named = common.spread_join(found, least, "root", ["node"]).select("node", "component_id")
    named = nodes.select("node", "key").join(named, "node", "left").select("node", F.coalesce("component_id", "key").alias("component_id"))
    done = common.spread_join(ids, common.written(named, "join-named"), "node", ["key"], "left")
    return done.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("key").isNotNull(), F.coalesce("component_id", "key")).alias("component_id"))


def deduplicate(docs: DataFrame, key: str = "doc_id", column: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """One row of each component: that of its smallest key. Rows without a key are all kept; of several rows with one
    key the one whose columns hash lowest stays."""
    names = docs.columns
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.col(key).alias("key"))
    found = common.written(join(docs, key, column, size, percent).toDF("key", "n", "component").filter("key is not null"), "join-found")

    def held(keys: DataFrame) -> DataFrame:
        """Keys to join with whole rows: broadcast up to FETCHED of them, merged beyond that."""
        return F.broadcast(keys) if keys.count() <= FETCHED else keys.hint("merge")

    gone = common.written(found.filter(F.col("key") != F.col("component")).select("key").distinct(), "join-gone")
    kept = rows.join(held(gone), "key", "left_anti").select("key", "row")
    twice = common.written(found.groupBy("key").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("key"), "join-twice")
    if twice.head(1):
        several = kept.join(held(twice), "key", "left_semi").groupBy("key").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
        kept = kept.join(held(twice), "key", "left_anti").select("key", "row").unionByName(several)
    return kept.select("row.*").select(*(F.col(f"`{c}`") for c in names))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(common.documents(spark, sf_dir))
