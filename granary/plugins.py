"""Extension points with offline defaults: embedders, reviewers, searchers and a registry of tools."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.operators import rules


#: Grams whose hashes a task remembers, and characters of a text that it reads at once.
KNOWN_GRAMS, PIECE = 500_000, 16_384


class Embedder(Protocol):
    def __call__(self, text: Column) -> Column: ...


class Reviewer(Protocol):
    def __call__(self, clauses: DataFrame) -> DataFrame: ...


class Searcher(Protocol):
    def __call__(self, queries: DataFrame) -> DataFrame: ...


def hashed_embedder(dimension: int = 64, batch: int = 32) -> Embedder:
    """Unit vectors of hashed character trigrams: deterministic, without a model. Batches keep the order of rows."""

    def place(gram: str) -> tuple[int, int]:
        h = int.from_bytes(hashlib.blake2b(gram.encode(), digest_size=8).digest(), "little")
        return h % dimension, 1 if h >> 63 else -1

    def vectors(texts: list[str], known: dict[int, tuple[int, int]]) -> list[list[float]]:
        """Grams are numbers of three characters; each different one of a batch is looked up once, and hashed if it is new."""
        sums = np.zeros((len(texts), dimension), np.float32)
        for i, text in enumerate(texts):
            if len(text) < 3:
                at, sign = place(text)
                sums[i, at] += sign
        pieces = [(i, text[a : a + PIECE + 2]) for i, text in enumerate(texts) for a in range(0, len(text) - 2, PIECE)]
        for a in range(0, len(pieces), batch):
            some = pieces[a : a + batch]
            letters = [np.frombuffer(x.encode("utf-32-le"), "<u4").astype(np.int64) for _, x in some]
            codes, back = np.unique(np.concatenate([x[:-2] << 42 | x[1:-1] << 21 | x[2:] for x in letters]), return_inverse=True)
            if len(known) > KNOWN_GRAMS:
                known.clear()
            for code in codes.tolist():
                if code not in known:
                    known[code] = place(chr(code >> 42) + chr(code >> 21 & 0x1FFFFF) + chr(code & 0x1FFFFF))
            places = np.array([known[code] for code in codes.tolist()])
            rows = np.repeat([i for i, _ in some], [len(x) - 2 for x in letters]) * dimension
            sums += np.bincount(rows + places[back, 0], places[back, 1], sums.size).reshape(sums.shape).astype(np.float32)
        found = []
        for v in sums:
            n = float(np.linalg.norm(v))
            found.append((v / n if n else v).tolist())
        return found

    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[int, tuple[int, int]] = {}
        for texts in batches:
            held = [t or "" for t in texts]
            found = [v for i in range(0, len(held), batch) for v in vectors(held[i : i + batch], known)]
            yield pd.Series(found, index=texts.index, dtype=object)

    return lambda text: F.pandas_udf(encode, "array<float>", F.PandasUDFType.SCALAR_ITER)(text)


def letter_embedder() -> Embedder:
    """Counts of the letters a to z, case aside: expressions alone, so that SQL can follow it."""

    def encode(text: Column) -> Column:
        letters = F.sequence(F.lit(97), F.lit(122))
        count = lambda t, c: (F.char_length(t) - F.char_length(F.replace(t, F.char(c), F.lit("")))).cast("float")
        # The text is made once, not for each letter: the optimiser doesn't look into the outer lambda.
        return F.transform(F.array(F.lower(text)), lambda t: F.transform(letters, lambda c: count(t, c)))[0]

    return encode


class Refused(Exception):
    """What a service raises for a batch that is too large for it."""


def halved(service: Callable[[list[str]], list[list[float]]], texts: list[str]) -> list[tuple[list[float] | None, str | None]]:
    """(vector, error) of each text, in order: a batch that the service refuses goes to it in halves until it fits, and a text
    that it refuses alone gets the reason instead of a vector."""
    found: list[tuple[list[float] | None, str | None]] = [(None, None)] * len(texts)
    todo = [(0, len(texts))] if texts else []
    while todo:
        low, high = todo.pop()
        try:
            found[low:high] = [(v, None) for v in service(texts[low:high])]
        except Refused as e:
            if high - low == 1:
                found[low] = (None, str(e))
            else:
                middle = (low + high) // 2
                todo += [(middle, high), (low, middle)]
    return found


def service_embedder(service: Callable[[list[str]], list[list[float]]], batch: int = 32) -> Embedder:
    """struct<v, error> of texts by a service that takes batches and may refuse them. Null texts count as empty."""

    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            held = [t if t is not None else "" for t in texts]
            found = [x for i in range(0, len(held), batch) for x in halved(service, held[i : i + batch])]
            yield pd.DataFrame({"v": [v for v, _ in found], "error": [e for _, e in found]}, index=texts.index)

    return lambda text: F.pandas_udf(encode, "v array<float>, error string", F.PandasUDFType.SCALAR_ITER)(text)


def chosen_embedder(remote: Embedder, local: Embedder, text: Column, is_remote: Column) -> Column:
    """struct<v, error> by a choice for each row. A remote service sees redacted texts alone: `text` is what `redact.redacted` left."""
    mine = F.struct(local(F.when(~is_remote, text)).alias("v"), F.lit(None).cast("string").alias("error"))
    return F.when(is_remote, remote(F.when(is_remote, text))).otherwise(mine)


def rule_reviewer(clauses: DataFrame) -> DataFrame:
    """Findings by the category rules: (chunk_id, category, agent) for each candidate category of a clause."""
    found = clauses.select("chunk_id", F.explode(rules.candidate_categories(F.col("text"))).alias("category"))
    return found.withColumn("agent", rules.owner(F.col("category"))).withColumn("name", rules.display_name(F.col("category")))


def corpus_searcher(corpus: DataFrame, most: int = 5) -> Searcher:
    """Search over a table (url, text): equal normalised queries are looked up once; hits contain the query, the first `most` by url.

    All queries are found in one pass over the texts, by the automata of `rules.route`. Empty queries find nothing."""

    def search(queries: DataFrame) -> DataFrame:
        keyed = queries.select("query", T.normalise_query(F.col("query")).alias("key"))
        words = keyed.filter("key <> ''").select(F.col("key").alias("agent"), F.col("key").alias("word"))
        found = rules.route(corpus, words, "url", "text", fallback="").filter("agent <> ''").select(F.col("agent").alias("key"), "url").distinct()
        ranked = found.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy("url"))).filter(F.col("place") <= most)
        return keyed.join(ranked.groupBy("key").agg(F.array_sort(F.collect_list("url")).alias("urls")), "key", "left")

    return search


class Tools:
    """Operators by name."""

    def __init__(self) -> None:
        self._held: dict[str, Callable] = {}

    def register(self, name: str, operator: Callable) -> None:
        if name in self._held:
            raise ValueError(f"{name} is taken")
        self._held[name] = operator

    def only(self, *names: str) -> Tools:
        kept = Tools()
        kept._held = {n: f for n, f in self._held.items() if n in names}
        return kept

    def names(self) -> list[str]:
        return sorted(self._held)

    def __call__(self, name: str, *args, **kwargs):
        return self._held[name](*args, **kwargs)
