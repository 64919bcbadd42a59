"""Benchmark decontamination by a broadcast hash set of normalised test n-grams.

Words are runs of digits, a-z and non-ASCII characters after A-Z are lower-cased. A window is `n` consecutive words of
a benchmark item; an item of fewer words is one window of its length. The windows' hashes are broadcast in slices of
at most `max_windows` pairs of window and item, so what a task holds has a bound that is checked, also where items share
windows; a larger benchmark takes several
passes over the training texts, each a narrow map, and the passes' hits meet in the row itself. Each task numbers the
benchmark's words, rolls hashes over runs of known words, looks them up by binary search, and compares every hash hit
word by word before it counts.

`decontaminate` reports spans, removes them from the text, or drops the documents that hold enough of them.

Null and empty texts have no words and no hits. Items without words have no window. Repeated items each count.
Windows that several items share count for each of them. Texts of any length are scanned whole; an empty table gives an
empty result, an empty benchmark no hits. Additional columns are not read, `decontaminate` passes them on whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import common
from granary.session import table

N = 13
#: Pairs of a window and its item in one broadcast slice; about 150 bytes each in a task.
MAX_WINDOWS = 200_000
#: Slices that one task holds, at most.
TOGETHER = 4
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: A document is contaminated when its hit words times this reach its words.
LEAST_SHARE = 20
FOUND = "struct<n_words:bigint,spans:array<struct<start:bigint,end:bigint>>,items:array<string>>"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """Normalised words, as UTF-8."""
    return (text or "").encode("utf-8", "replace").translate(_TABLE).split()


@dataclass
class Slice:
    """Windows of equal or different lengths with the items that hold them."""

    numbers: dict[bytes, int]
    by_length: dict[int, np.ndarray]  # sorted hashes
    windows: dict[int, np.ndarray]
    items: dict[int, list[list[str]]]


def rolled(ids: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every `n` consecutive word numbers."""
    with np.errstate(over="ignore"):
        key = np.zeros(max(0, len(ids) - n + 1), np.uint64)
        for k in range(n):
            key = (key ^ (key >> np.uint64(31))) * _MIX + ids[k : k + len(key)].astype(np.uint64) + np.uint64(1)
    return key


def rolled_rows(ids: np.ndarray) -> np.ndarray:
    """The same hash for each row of a matrix of word numbers."""
    with np.errstate(over="ignore"):
        key = np.zeros(len(ids), np.uint64)
        for k in range(ids.shape[1]):
            key = (key ^ (key >> np.uint64(31))) * _MIX + ids[:, k].astype(np.uint64) + np.uint64(1)
    return key


def item_windows(text: str | None, n: int = N) -> Iterator[tuple]:
    """The windows of one item, one after the other."""
    words = words_of(text)
    size = min(n, len(words))
    for i in range(len(words) - size + 1 if size else 0):
        yield tuple(words[i : i + size])


def windows_of(items: list[tuple], n: int = N) -> dict[tuple, set]:
    """Every window (a tuple of words) with the ids of the items that hold it."""
    found: dict[tuple, set] = {}
    for item, text in items:
        for window in item_windows(text, n):
            found.setdefault(window, set()).add(item)
    return found


def slices(items: Iterable[tuple], n: int = N, most: int = MAX_WINDOWS) -> Iterator[Slice]:
    """Slices of at most `most` pairs of a window and an item that holds it, one at a time; a window that two slices hold counts
    for the items of both."""
    held: dict[tuple, set] = {}
    pairs = 0
    for item, text in items:
        for window in item_windows(text, n):
            who = held.setdefault(window, set())
            pairs += item not in who
            who.add(item)
            if pairs >= most:
                yield _slice(held)
                held, pairs = {}, 0
    if held:
        yield _slice(held)


def _slice(found: dict[tuple, set]) -> Slice:
    numbers: dict[bytes, int] = {}
    grouped: dict[int, list[tuple]] = {}
    for window in found:
        for w in window:
            numbers.setdefault(w, len(numbers))
        grouped.setdefault(len(window), []).append(window)
    by_length, rows, items = {}, {}, {}
    for size, group in grouped.items():
        ids = np.array([[numbers[w] for w in window] for window in group], np.int64)
        keys = rolled_rows(ids)
        order = np.argsort(keys, kind="stable")
        by_length[size] = keys[order]
        rows[size] = ids[order]
        items[size] = [sorted(map(str, found[group[i]])) for i in order]
    return Slice(numbers, by_length, rows, items)


def hits(part: Slice, ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, row) of every occurrence of the slice's windows in word numbers; -1 is an unknown word."""
    found = []
    known = np.concatenate([[0], np.cumsum(ids >= 0)])
    for size, keys in part.by_length.items():
        if len(ids) < size:
            continue
        starts = np.flatnonzero(known[size:] - known[:-size] == size)
        if not len(starts):
            continue
        own = rolled(ids, size)[starts]
        left, right = np.searchsorted(keys, own), np.searchsorted(keys, own, side="right")
        for k in np.flatnonzero(right > left):
            start = int(starts[k])
            for row in range(left[k], right[k]):
                if np.array_equal(part.windows[size][row], ids[start : start + size]):
                    found.append((start, size, row))
    return found


def benchmark_slices(benchmark: DataFrame, n: int = N, most: int = MAX_WINDOWS, key: str = "item_id", column: str = "text") -> Iterator[Slice]:
    """The benchmark's slices, read item by item: the driver holds one slice, whatever the benchmark's size."""
    return slices(((r[0], r[1]) for r in benchmark.select(key, column).toLocalIterator()), n, most)


def find_hits(docs: DataFrame, parts: Iterable[Slice], into: str, column: str = "text") -> DataFrame:
    """`docs` with a column `into`: struct<n_words, spans: array<struct<start, end>>, items: array<string>>, the merged spans of
    hit words by word positions and the items that own the windows, each once.

    The rows are stored after every `TOGETHER` passes, so a task holds that many slices at most."""
    df = docs.withColumn(into, F.lit(None).cast(FOUND))
    done = 0
    for done, part in enumerate(parts, 1):
        if done > 1 and done % TOGETHER == 1:
            df = common.written(df, "decontaminate")
        df = _pass(df, docs.sparkSession.sparkContext.broadcast(part), into, column)
    return df if done else _pass(df, docs.sparkSession.sparkContext.broadcast(Slice({}, {}, {}, {})), into, column)


def _pass(df: DataFrame, shared, into: str, column: str) -> DataFrame:
    names = df.columns
    kind = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: Slice = shared.value
        get = part.numbers.get
        for batch in batches:
            rows = []
            for text, before in zip(common.texts(batch, column), batch.column(names.index(into)).to_pylist()):
                words = words_of(text)
                ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
                new = hits(part, ids)
                items = set(before["items"] if before else ())
                for z, r in {(z, r) for _, z, r in new}:
                    items.update(part.items[z][r])
                old = [(s["start"], s["end"]) for s in before["spans"]] if before else []
                rows.append({"n_words": len(words), "spans": [{"start": a, "end": b} for a, b in merged(old + [(s, s + z) for s, z, _ in new])], "items": sorted(items)})
            arrays = list(batch.columns)
            arrays[names.index(into)] = pa.array(rows, kind)
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return common.map_batches(df, scan, df.schema)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans [start, end) that touch or overlap, as one."""
    found: list[list[int]] = []
    for start, end in sorted(spans):
        if found and start <= found[-1][1]:
            found[-1][1] = max(found[-1][1], end)
        else:
            found.append([start, end])
    return [tuple(m) for m in found]


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = N, key: str = "doc_id", column: str = "text", max_windows: int = MAX_WINDOWS) -> DataFrame:
    """Per row: n_words, n_hit, n_items, items_sha256 and contaminated (hit words are a twentieth or more)."""
    found = find_hits(docs.select(F.col(key).alias("key"), F.col(column).alias("text")), benchmark_slices(benchmark, n, max_windows), "found", "text")
    zero = F.lit(0).cast("long")
    covered = F.aggregate("found.spans", zero, lambda n, s: n + s["end"] - s["start"])
    items = F.col("found.items")
    n_hit, total = F.col("n_hit"), F.col("n_words")
    return found.select(F.col("key"), F.col("found.n_words").alias("n_words"), covered.alias("n_hit"), items.alias("items")).select(
        F.col("key").alias(key),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (LEAST_SHARE * n_hit >= total)).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, action: str = "drop", n: int = N, column: str = "text", max_windows: int = MAX_WINDOWS) -> DataFrame:
    """`docs` without contaminated documents (action "drop") or without the words of the hits (action "cut").

    Cutting removes each merged span of hit words with what stands between them; the rest of the text stays as it is.
    """
    into = next(x for x in (f"found{i}" for i in range(len(docs.columns) + 1)) if x not in docs.columns)
    found = find_hits(docs, benchmark_slices(benchmark, n, max_windows), into, column)
    names = docs.columns
    if action == "drop":  # without a second Python worker beside the one that found the hits
        hit = F.aggregate(F.col(f"{into}.spans"), F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
        return found.filter(~((hit > 0) & (LEAST_SHARE * hit >= F.col(f"{into}.n_words")))).select(*(F.col(f"`{c}`") for c in names))
    place = names.index(column)

    def act(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = []
            for text, got in zip(common.texts(batch, column), batch.column(len(names)).to_pylist()):
                found_spans = [(s["start"], s["end"]) for s in got["spans"]]
                new.append(cut(text, found_spans) if found_spans else text)
            arrays = list(batch.columns)[: len(names)]
            arrays[place] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return common.map_batches(found, act, docs.schema)


def cut(text: str, found: list[tuple[int, int]]) -> str:
    raw = text.encode("utf-8", "replace")
    plain = raw.translate(_TABLE)
    bounds, at = [], 0
    for w in plain.split():
        at = plain.index(w, at)
        bounds.append((at, at + len(w)))
        at += len(w)
    out, last = [], 0
    for a, b in found:
        out.append(raw[last : bounds[a][0]])
        last = bounds[b - 1][1]
    return b"".join([*out, raw[last:]]).decode("utf-8")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(common.documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))

