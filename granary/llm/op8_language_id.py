"""Language identification by segmentation-marginalised unigrams over a fixed public vocabulary.

Each language has a probability for every piece of a public byte-level vocabulary. The probability of a word (with the
space before it) is the sum over all its segmentations into pieces, found by the forward algorithm; the log
probability of a text is the sum over its words, and the language with the highest posterior wins.

Training: expected piece counts by the forward-backward algorithm, `rounds` times, over the words of a bounded sample
of labelled rows (`sample_docs` whole texts per language, picked by a hash of the key); priors come from the label
counts of all training rows. Every text is scored whole, in vectorised dynamic programs over the batch's distinct
words.

Every word is summed over all its segmentations into entries of the whole vocabulary, whatever its length: sums of short
words are kept as probabilities, those of long ones, which would underflow, as their logarithms, which is the same sum.

Null texts and texts without a letter are `und` with score 0. Equal posteriors give the language first in order. Rows
repeat as they come; additional columns are not read, and a column of the result's name is replaced. With no labelled
row every text is `und` and `reject` takes away only texts without letters. An empty table gives an empty result. The
labels are a bounded set: over `MAX_LANGS` of them are an error.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import common

#: Whole texts per language that the piece probabilities are fitted on, about.
SAMPLE_DOCS = 400
ROUNDS = 3
MAX_LANGS = 500
#: Bytes of a word up to which its sums stay above underflow, and cells (bytes x words) of one dynamic program.
PLAIN, CELLS = 30, 250_000
#: The same where texts are scored, in all tasks at once.
SCORED = 60_000
#: Words whose log probabilities a task remembers.
MEMO_WORDS = 250_000
_LETTER = regex.compile(r"\p{L}")
_VOCAB = "byte_bpe_50k.tiktoken"
UNKNOWN = "und"


def vocabulary(path: str | None = None) -> dict[bytes, int]:
    """All pieces, numbered; all single bytes are among them."""
    import public_tokenizers

    with open(path or public_tokenizers.path(_VOCAB), "rb") as lines:
        pieces = [base64.b64decode(line.split()[0]) for line in lines]
    known = set(pieces)
    pieces += [bytes([b]) for b in range(256) if bytes([b]) not in known]
    return {p: i for i, p in enumerate(pieces)}


@dataclass
class Model:
    langs: list[str]
    log_prior: np.ndarray
    probs: np.ndarray  # pieces x languages


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def words_of(text: str) -> list[bytes]:
    """Words with the space before them, A-Z lower-cased."""
    return [b" " + w for w in text.encode("utf-8", "replace").translate(_LOWER).split()]


class Trie:
    """The vocabulary as arrays, so that all starts of all words walk it together."""

    def __init__(self, vocab: dict[bytes, int]):
        children: dict[int, int] = {}
        piece = [-1]
        for entry, i in vocab.items():
            node = 0
            for b in entry:
                new = children.setdefault(node << 8 | b, len(piece))
                if new == len(piece):
                    piece.append(-1)
                node = new
            piece[node] = i
        self.size, self.piece = len(vocab), np.array(piece, np.int32)
        bits = (4 * len(children)).bit_length()
        self.shift = np.uint64(64 - bits)
        self.keys, self.nodes = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        for key, node in children.items():
            at = int(self._slots(np.array([key]))[0])
            while self.keys[at] >= 0:
                at = (at + 1) & (len(self.keys) - 1)
            self.keys[at], self.nodes[at] = key, node

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def child(self, nodes: np.ndarray, data: np.ndarray) -> np.ndarray:
        """The node below by a byte, or -1."""
        keys = nodes.astype(np.int64) << 8 | data
        at = self._slots(keys)
        todo = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & (len(self.keys) - 1)
            todo = todo[(self.keys[at[todo]] != keys[todo]) & (self.keys[at[todo]] >= 0)]
        return np.where(self.keys[at] == keys, self.nodes[at], -1)


def trie(path: str | None = None) -> Trie:
    return common.kept(("trie", path), lambda: Trie(vocabulary(path)))


@dataclass
class Lattice:
    """Every occurrence of a piece in a group of words, by its start; `edges[i]` is where those that start at i begin."""

    sizes: np.ndarray
    word: np.ndarray
    length: np.ndarray
    piece: np.ndarray
    edges: np.ndarray

    def at(self, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words, ends and pieces; no word has an end twice."""
        own = slice(self.edges[start], self.edges[start + 1])
        return self.word[own], start + self.length[own], self.piece[own]


def lattice(words: list[bytes], tree: Trie) -> Lattice:
    sizes = np.array([len(w) for w in words])
    most = int(sizes.max())
    data = np.frombuffer(b"".join(words), np.uint8)
    word = np.repeat(np.arange(len(words)), sizes)
    start = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    place = np.arange(len(data))
    node = np.zeros(len(data), np.int32)
    found: list[tuple] = []
    k = 0
    while len(word):
        fits = start + k < sizes[word]
        word, start, place, node = word[fits], start[fits], place[fits], node[fits]
        node = tree.child(node, data[place + k])
        some = node >= 0
        word, start, place, node = word[some], start[some], place[some], node[some]
        ends = tree.piece[node] >= 0
        found.append((start[ends], word[ends], np.full(int(ends.sum()), k + 1), tree.piece[node[ends]]))
        k += 1
    starts, owners, lengths, pieces = (np.concatenate(c) for c in zip(*found))
    order = np.argsort(starts, kind="stable")
    edges = np.searchsorted(starts[order], np.arange(most + 1))
    return Lattice(sizes, owners[order], lengths[order], pieces[order], np.append(edges, len(order))[: most + 1])


def forward(lat: Lattice, probs: np.ndarray, logs: bool) -> np.ndarray:
    """alpha[position, word, language]; at a word's length stands the sum over all its segmentations. `logs`: `probs` and
    the sums are logarithms."""
    most, n = int(lat.sizes.max()), len(lat.sizes)
    alpha = np.full((most + 1, n, probs.shape[1]), -np.inf if logs else 0.0)
    alpha[0] = 0 if logs else 1
    for i in range(most):
        word, end, piece = lat.at(i)
        if logs:
            alpha[end, word] = np.logaddexp(alpha[end, word], alpha[i, word] + probs[piece])
        else:
            alpha[end, word] += alpha[i, word] * probs[piece]
    return alpha


def backward(lat: Lattice, probs: np.ndarray, logs: bool) -> np.ndarray:
    most, n = int(lat.sizes.max()), len(lat.sizes)
    beta = np.full((most + 1, n, probs.shape[1]), -np.inf if logs else 0.0)
    beta[lat.sizes, np.arange(n)] = 0 if logs else 1
    for i in range(most - 1, -1, -1):
        word, end, piece = lat.at(i)
        order = np.argsort(word, kind="stable")
        word, end, piece = word[order], end[order], piece[order]
        if not len(word):
            continue
        edges = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        if logs:
            beta[i, word[edges]] = np.logaddexp.reduceat(beta[end, word] + probs[piece], edges, axis=0)
        else:
            beta[i, word[edges]] = np.add.reduceat(beta[end, word] * probs[piece], edges, axis=0)
    return beta


def by_length(words: list[bytes], cells: int = CELLS) -> Iterator[tuple[list[bytes], bool]]:
    """The words in groups of like lengths and of so many cells at most, or of one word; whether they are long ones."""
    held: list[bytes] = []
    for w in sorted(words, key=len):
        if held and ((len(held) + 1) * len(w) > cells or (len(w) > PLAIN) != (len(held[0]) > PLAIN) or len(w) > 1.25 * len(held[0]) + 2):
            yield held, len(held[0]) > PLAIN
            held = []
        held.append(w)
    if held:
        yield held, len(held[0]) > PLAIN


def log_probs(words: list[bytes], tree: Trie, probs: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The words, in another order, and their log probabilities by language."""
    order, found, log = [], [np.zeros((0, probs.shape[1]))], np.log(probs)
    for group, long in by_length(words, SCORED):
        lat = lattice(group, tree)
        order += group
        sums = forward(lat, log if long else probs, long)[lat.sizes, np.arange(len(group))]
        found.append(sums if long else np.log(sums))
    return order, np.vstack(found)


def expected_counts(counts: dict[bytes, np.ndarray], tree: Trie, probs: np.ndarray) -> np.ndarray:
    """Expected uses of each piece by language, for words with counts by language."""
    gathered, log = np.zeros_like(probs), np.log(probs)
    for group, long in by_length(list(counts)):
        lat = lattice(group, tree)
        alpha, beta = forward(lat, log if long else probs, long), backward(lat, log if long else probs, long)
        whole = alpha[lat.sizes, np.arange(len(group))]
        weight = np.array([counts[w] for w in group])
        start = np.repeat(np.arange(len(lat.edges) - 1), np.diff(lat.edges))
        for at in range(0, len(start), CELLS):
            i, w, piece = start[at : at + CELLS], lat.word[at : at + CELLS], lat.piece[at : at + CELLS]
            end = i + lat.length[at : at + CELLS]
            share = np.exp(alpha[i, w] + beta[end, w] + log[piece] - whole[w]) if long else alpha[i, w] * beta[end, w] * probs[piece] / whole[w]
            for k in range(probs.shape[1]):
                gathered[:, k] += np.bincount(piece, share[:, k] * weight[w, k], len(probs))
    return gathered


def train(docs: DataFrame, training: Column, lang: str = "lang", key: str = "doc_id", column: str = "text", sample_docs: int = SAMPLE_DOCS, rounds: int = ROUNDS) -> Model:
    """A model from the rows where `training` holds and the label isn't null."""
    rows = docs.filter(training & F.col(lang).isNotNull()).select(F.col(key).alias("key"), F.col(lang).cast("string").alias("lang"), F.col(column).alias("text"))
    per_lang = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    totals = {r["lang"]: r["n"] for r in per_lang.limit(MAX_LANGS + 1).collect()}
    if len(totals) > MAX_LANGS:
        raise ValueError(f"over {MAX_LANGS} languages among the labels")
    langs = sorted(totals)
    vocab, tree = vocabulary(), trie()
    if not langs:
        return Model([], np.zeros(0), np.zeros((len(vocab), 0)))
    shares = docs.sparkSession.createDataFrame(pa.table({"lang": list(totals), "share": [min(1_000_000, sample_docs * 1_000_000 // n + 1) for n in totals.values()]}))
    picked = rows.join(F.broadcast(shares), "lang").filter(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < F.col("share")).select("lang", "text")
    schema = pa.schema([("lang", pa.string()), ("word", pa.binary()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for name, text in zip(common.texts(batch, "lang"), common.texts(batch, "text")):
                seen.update((name, w) for w in words_of(text or ""))
            yield common.out(schema, lang=[a for a, _ in seen], word=[w for _, w in seen], n=list(seen.values()))

    place = {name: i for i, name in enumerate(langs)}
    counts: dict[bytes, np.ndarray] = {}
    for r in common.map_batches(picked, count, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toLocalIterator():
        counts.setdefault(bytes(r["word"]), np.zeros(len(langs)))[place[r["lang"]]] = r["n"]
    probs = np.full((len(vocab), len(langs)), 1.0)
    lengths = np.array([len(p) for p in vocab])
    probs *= (0.1 ** np.minimum(lengths, 5))[:, None]
    probs /= probs.sum(0)
    for _ in range(rounds):
        gathered = expected_counts(counts, tree, probs) + 0.05
        probs = gathered / gathered.sum(0)
    total = np.array([totals[n] for n in langs], float)
    return Model(langs, np.log(total / total.sum()), probs)


def predict(docs: DataFrame, model: Model, into: tuple[str, str] = ("lang_pred", "score"), column: str = "text") -> DataFrame:
    """`docs` with the predicted language and its posterior probability, in place of columns of their names."""
    if column in into:
        raise ValueError("the text's column can't hold the result")
    kept_names = [c for c in docs.columns if c not in into]
    docs = docs.select(*(F.col(f"`{c}`") for c in kept_names))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Model = shared.value
        tree, number = trie(), {}
        logs = np.zeros((1 << 16, len(held.langs)))
        for batch in batches:
            lists = [words_of(t) if t and held.langs and _LETTER.search(t) else [] for t in common.texts(batch, column)]
            if len(number) > MEMO_WORDS:
                number.clear()
            flat = [w for words in lists for w in words]
            new, values = log_probs(list({w for w in flat if w not in number}), tree, held.probs)
            while len(number) + len(new) > len(logs):
                logs = np.vstack([logs, np.zeros_like(logs)])
            logs[len(number) : len(number) + len(new)] = values
            number.update(zip(new, range(len(number), len(number) + len(new))))
            langs, scores = [UNKNOWN] * len(lists), [0.0] * len(lists)
            full = [i for i, words in enumerate(lists) if words]
            if full:
                sizes = np.array([len(lists[i]) for i in full])
                totals = np.add.reduceat(logs[np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))], np.cumsum(sizes) - sizes, axis=0) + held.log_prior
                best = totals.argmax(1)
                sure = 1 / np.exp(totals - totals[np.arange(len(full)), best][:, None]).sum(1)
                for i, k, p in zip(full, best.tolist(), sure.tolist()):
                    langs[i], scores[i] = held.langs[k], p
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*names, *into])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return common.map_batches(docs, score, f"{kept}, {into[0]} string, {into[1]} double")


def reject(docs: DataFrame, model: Model, least: float = 0.5, column: str = "text") -> DataFrame:
    """`docs` without rows of no language: those without letters and those whose best posterior is under `least`. A model
    that learnt from no labelled row rejects only the former."""
    if not model.langs:
        return docs.filter(F.col(f"`{column}`").rlike(r"\p{L}"))
    names = docs.columns
    numbered = docs.toDF(*[f"c{i}" for i in range(len(names))])
    judged = predict(numbered, model, ("lang_pred", "score"), f"c{names.index(column)}")
    return judged.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).drop("lang_pred", "score").toDF(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    held = common.crc_bucket("doc_id", 4) == 2
    model = train(docs, ~held)
    rows = docs.select("doc_id", held.alias("held_out"), "text")
    return predict(rows, model).drop("text")
