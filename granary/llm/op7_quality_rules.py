"""Quality rules as a short-circuit cascade, ordered by rejection per cost.

Measures of a text
    words           runs of characters other than ASCII white space
    word_chars      code points in words
    n_symbols       characters of ``#*$%&|<>``
    n_dup_lines     lines with a word that equal an earlier line of the text
    n_repeat_words  words inside five-word windows that occur twice or more in the text

The base rule rejects texts of under ten words and texts whose repeated words exceed a fifth of all words; it stands in
the cascade as two rules (`too_few_words`, `repetition`) beside the others in `RULES`. A rule computes the measures it needs
when it needs them, so its cost is real: on a bounded sample of whole texts the planner measures each rule's time and the
share it rejects, orders the rules by rejection per cost, and the texts of a batch then meet the rules in that order,
those that are rejected leaving at once. Rejection is a conjunction, so the order changes the cost and never the verdict.
`quality_filter` computes for a text no more than the rules it meets; with `measures` all measures of every text as well.

Null text counts as empty; an empty text has no words, all measures 0, fails the base rule and isn't kept. Texts of any
length are judged whole. A measure at its threshold passes. Repeated rows are judged one by one, rules of equal merit are
ordered by name. An empty table gives an empty result. Additional columns are not read, whatever their names.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import common

SYMBOLS = b"#*$%&|<>"
_DROP_SYMBOLS = bytes(SYMBOLS)
WINDOW = 5
#: Rows of the sample that costs and selectivities are estimated on (a bound for the planner only).
SAMPLE_ROWS = 2000


class Text:
    """One text with the measures that the rules share, each computed when it is first asked for."""

    def __init__(self, text: str | None):
        self.raw = (text or "").encode("utf-8", "replace")

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @cached_property
    def word_chars(self) -> int:
        return sum(map(len, self.words)) if self.raw.isascii() else len(b"".join(self.words).decode("utf-8"))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, _DROP_SYMBOLS))

    @cached_property
    def n_dup_lines(self) -> int:
        return duplicate_lines(self.raw)

    n_repeat_words: int | None = None  # of several texts at once, by `count_repeats`


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Text], bool]
    prepare: Callable[[list[Text]], None] | None = None

    def of(self, texts: list[Text]) -> list[bool]:
        if self.prepare:
            self.prepare(texts)
        return [self.rejects(t) for t in texts]


def count_repeats(texts: list[Text]) -> None:
    todo = [t for t in texts if t.n_repeat_words is None]
    for t, n in zip(todo, repeat_words([t.words for t in todo]).tolist()):
        t.n_repeat_words = n


_UPPER_WORD = re.compile(rb"[A-Z]{2}")
_LETTER = re.compile(rb"[A-Za-z\x80-\xff]")

#: The two rules of the base verdict; the first names a text that fails both.
BASE = (
    Rule("too_few_words", lambda t: len(t.words) < 10),
    Rule("repetition", lambda t: 100 * t.n_repeat_words > 20 * len(t.words), count_repeats),
)
#: The cascade; thresholds are those of published web-corpus filters.
RULES = BASE + (
    Rule("symbols_per_word", lambda t: 10 * t.n_symbols > len(t.words)),
    Rule("mean_word_length", lambda t: not 2 * len(t.words) <= t.word_chars <= 20 * len(t.words)),
    Rule("duplicate_lines", lambda t: 10 * t.n_dup_lines > 3 * max(1, t.raw.count(b"\n") + 1)),
    Rule("words_with_letters", lambda t: 10 * sum(1 for w in t.words if _LETTER.search(w)) < 8 * len(t.words)),
    Rule("shouting", lambda t: 2 * sum(1 for w in t.words if _UPPER_WORD.match(w)) > len(t.words)),
    Rule("exclamations", lambda t: 3 * t.raw.count(b"!") > len(t.words)),
)


def duplicate_lines(raw: bytes) -> int:
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def repeat_words(word_lists: list[list[bytes]]) -> np.ndarray:
    """For each list, the words inside five-word windows that occur twice or more in that list.

    Windows of all lists are compared at once by a 64-bit hash of word numbers; every window that shares its hash is
    then compared word by word with the first of its hash, and lists with a false match are counted by exact keys.
    """
    out = np.zeros(len(word_lists), np.int64)
    sizes = np.array([len(w) for w in word_lists], np.int64)
    if sizes.sum() == 0:
        return out
    seen: dict[bytes, int] = {}
    number = seen.setdefault
    ids = np.fromiter((number(w, len(seen)) for words in word_lists for w in words), np.uint64, int(sizes.sum()))
    owner = np.repeat(np.arange(len(word_lists)), sizes)
    if len(ids) < WINDOW:
        return out
    with np.errstate(over="ignore"):
        key = np.zeros(len(ids) - WINDOW + 1, np.uint64)
        for k in range(WINDOW):
            key = key * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + len(key)] + np.uint64(1)
            key ^= key >> np.uint64(29)
        key = (key + owner[: len(key)].astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
    starts = np.flatnonzero(owner[: len(key)] == owner[WINDOW - 1 :])
    order = starts[np.argsort(key[starts], kind="stable")]
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return out
    edge = np.concatenate([[True], ~same])
    first = order[np.maximum.accumulate(np.where(edge, np.arange(len(order)), 0))]
    twice = np.concatenate([same, [False]]) | ~edge
    pos, ref = order[twice], first[twice]
    true = owner[pos] == owner[ref]
    for k in range(WINDOW):
        true &= ids[pos + k] == ids[ref + k]
    hit = np.zeros(len(ids), bool)
    for k in range(WINDOW):
        hit[pos + k] = True
    out = np.bincount(owner[hit], minlength=len(word_lists)).astype(np.int64)
    for i in np.unique(np.concatenate([owner[pos[~true]], owner[ref[~true]]])):
        out[i] = _repeat_words_exact(word_lists[i])
    return out


def _repeat_words_exact(words: list[bytes]) -> int:
    places: dict[tuple, list[int]] = {}
    for i in range(len(words) - WINDOW + 1):
        places.setdefault(tuple(words[i : i + WINDOW]), []).append(i)
    return len({i + k for p in places.values() if len(p) > 1 for i in p for k in range(WINDOW)})


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 10 or 100 * n_repeat_words > 20 * n_words


def cascade_order(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS, column: str = "text") -> list[str]:
    """Rule names by rejection per cost, measured on about `sample_rows` whole texts picked by hash."""
    total = docs.count()
    if total == 0:
        return [r.name for r in rules]
    share = min(1.0, sample_rows / total)
    picked = docs.filter(F.pmod(F.xxhash64(F.coalesce(F.col(column), F.lit(""))), F.lit(1_000_000)) < F.lit(int(share * 1_000_000) + 1))
    schema = pa.schema([("rule", pa.string()), ("seen", pa.int64()), ("rejected", pa.int64()), ("seconds", pa.float64())])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for rule in rules:
                items = [Text(t) for t in common.texts(batch, column)]  # without measures, so that each rule pays its own
                began = time.perf_counter()
                gone = sum(rule.of(items))
                rows.append((rule.name, len(items), gone, time.perf_counter() - began))
            name, seen, gone, took = zip(*rows)
            yield common.out(schema, rule=name, seen=seen, rejected=gone, seconds=took)

    found = common.map_batches(picked.select(column), probe, "rule string, seen long, rejected long, seconds double")
    rows = found.groupBy("rule").agg(F.sum("seen").alias("n"), F.sum("rejected").alias("r"), F.sum("seconds").alias("s")).collect()
    by = {x["rule"]: (x["r"] / max(1, x["n"])) / max(x["s"] / max(1, x["n"]), 1e-9) for x in rows}
    return sorted((r.name for r in rules), key=lambda name: (-by.get(name, 0.0), name))


def cascade(items: list[Text], chain: list[Rule]) -> list[str | None]:
    """The first rule of the chain that rejects each text, or None."""
    why: list[str | None] = [None] * len(items)
    left = list(range(len(items)))
    for rule in chain:
        if not left:
            break
        gone = rule.of([items[i] for i in left])
        for i, g in zip(left, gone):
            if g:
                why[i] = rule.name
        left = [i for i, g in zip(left, gone) if not g]
    return why


def quality_filter(docs: DataFrame, order: list[str] | None = None, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", column: str = "text", measures: bool = False) -> DataFrame:
    """Verdict and the first rule that rejected, for each row of `docs`; with `measures` the measures and the base verdict
    of every text, which are computed whatever rule rejects it."""
    named = {r.name: r for r in rules}
    chain = [named[n] for n in (order or cascade_order(docs, rules, column=column))]
    kind = docs.schema[key].dataType.simpleString()
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"] if measures else []
    schema = f"`{key}` {kind}, " + "".join(f"{c} long, " for c in counts) + ("base_failed boolean, " if measures else "") + "kept boolean, rejected_by string"

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = [Text(t) for t in common.texts(batch, column)]
            why = cascade(items, chain)
            arrays, names = [batch.column(0)], [key]
            if measures:
                count_repeats(items)
                columns = [[len(t.words) for t in items], *([getattr(t, c) for t in items] for c in counts[1:])]
                arrays += [pa.array(c, pa.int64()) for c in columns] + [pa.array([base_failed(a, b) for a, b in zip(columns[0], columns[4])], pa.bool_())]
                names += [*counts, "base_failed"]
            arrays += [pa.array([w is None for w in why], pa.bool_()), pa.array(why, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, "kept", "rejected_by"])

    return common.map_batches(docs.select(F.col(f"`{key}`"), F.col(f"`{column}`")), judge, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without the rejecting rule, which depends on the order that the planner measured."""
    return quality_filter(common.documents(spark, sf_dir), measures=True).drop("rejected_by")
