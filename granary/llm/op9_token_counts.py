"""Token counts by a tokenizer compiled to deterministic transducers.

The byte-level BPE of a public tokenizer file is compiled on demand to a deterministic finite-state transducer over
bytes. After the bytes read so far, a state holds, for every start from which the bytes up to here may still grow into
a vocabulary entry, the place in the vocabulary's trie, the last token of the encoding that ends at that start, and
how many tokens that encoding has more or less than the encoding of everything read. That is all that decides the
future, so equal contents are one state. Each transition carries the change of the token count, and a piece's count is
the sum over its path. A new token may follow an earlier one if BPE leaves the two alone side by side.

Texts are cut into pieces as the tokenizer's pattern does, by array expressions over code point classes; a piece begins
in the start state. The bytes of each text lie in chunks of `CHUNK` bytes and all chunks of a batch advance together,
one array step for each byte. A chunk has a map from the state before it to the state behind it and the tokens gained.
The map of a chunk that holds a piece start is constant from there on, so only the bytes before it, its head, depend on
what came before. Heads that follow each other without a piece start between them (a long word, a text without spaces)
are mapped for the states that can occur before them: first for the start state, then for whatever states the maps
before them lead to, all heads in parallel; a prefix scan by doubling composes the maps, until the path from each
stretch's true state is known.

Null counts as empty: 0 bytes, 0 tokens. Special strings inside a text count as one token each, as the library's
default has it. Rows repeat as they come and additional columns are not read, whatever their names. Texts of any length
are counted whole; an empty table gives an empty result. A count of exactly `limit` is not over it.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from granary.llm import common

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 512
CHUNK = 128
#: States a task keeps; beyond them the transducer starts anew, compiled from the texts still to come.
MAX_STATES = 600_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: A transition's change of the count, plus _BIAS, stands in its lowest _SHIFT bits; no change exceeds the longest entry.
_BIAS = 1 << 11
_SHIFT = 12
#: Rounds in which the heads' maps are widened before the rest of a stretch is walked in order.
WIDEN = 40


def byte_symbols() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def known_make(data: dict) -> bool:
    """Whether a tokenizer file is a byte-level BPE without normaliser whose pieces are those that `piece_starts` cuts; any
    other one encodes whole texts by the library."""
    pre, model = data.get("pre_tokenizer") or {}, data["model"]
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    options = any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    return model.get("type") == "BPE" and data.get("normalizer") is None and plain and not options


@functools.lru_cache(4)
def load(path: str) -> tuple[list[bytes], dict[tuple[bytes, bytes], int], tuple[str, ...]]:
    """Vocabulary entries, merge ranks and special strings of a tokenizer file."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    if not known_make(data):
        raise ValueError(f"{path} is not a byte-level BPE of the make that is compiled here")
    to_byte = byte_symbols()
    plain = lambda s: bytes(to_byte[c] for c in s)
    special = tuple(t["content"] for t in data["added_tokens"])
    vocab = [plain(t) for t in data["model"]["vocab"] if t not in special]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"]]
    return vocab, {(plain(a), plain(b)): i for i, (a, b) in enumerate(pairs)}, special


def merge(word: bytes, ranks: dict[tuple[bytes, bytes], int]) -> list[bytes]:
    """BPE by its definition: the leftmost pair of the lowest rank merges until none is left."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get((parts[i], parts[i + 1]), 1 << 60))
        if (parts[best], parts[best + 1]) not in ranks:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return parts


class Transducer:
    """The lazily compiled machine. State 0 is the start of a piece, state 1 takes everything and counts nothing."""

    def __init__(self, vocab: list[bytes], ranks: dict[tuple[bytes, bytes], int], max_states: int = MAX_STATES):
        if max(map(len, vocab), default=0) >= _BIAS:
            raise ValueError("vocabulary entries are too long to pack changes of the count")
        self.ranks, self.max_states = ranks, max_states
        self.children: list[dict[int, int]] = [{}]
        self.token: list[bytes | None] = [None]
        for entry in vocab:
            node = 0
            for b in entry:
                node = self.children[node].setdefault(b, len(self.children))
                if node == len(self.token):
                    self.children.append({})
                    self.token.append(None)
            self.token[node] = entry
        self.may_follow: dict[tuple[bytes | None, bytes], bool] = {}
        self.reset()

    def reset(self) -> None:
        self.number: dict[tuple, int] = {}
        self.content: list[tuple] = []
        self.keys, self.values, self.filled = np.full(1 << 16, -1, np.int64), np.zeros(1 << 16, np.int64), 0
        self.state(((0, None, 0),))
        self.state(("sink",))
        for byte in range(256):
            self.insert(256 + byte, (1 << _SHIFT) + _BIAS)

    def state(self, content: tuple) -> int:
        found = self.number.get(content)
        if found is None:
            found = self.number[content] = len(self.content)
            self.content.append(content)
        return found

    def slots(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * _MIX) >> np.uint64(65 - len(self.keys).bit_length())).astype(np.int64)

    def insert(self, key: int, packed: int) -> None:
        """Open addressing: transitions lie in the first free slot from their hash on; at most half are taken."""
        if 2 * self.filled >= len(self.keys):
            old = self.keys >= 0
            keys, values = self.keys[old], self.values[old]
            self.keys, self.values, self.filled = np.full(2 * len(self.keys), -1, np.int64), np.zeros(2 * len(self.keys), np.int64), 0
            slot, todo = self.slots(keys), np.arange(len(keys))
            while len(todo):
                free = self.keys[slot[todo]] < 0
                self.keys[slot[todo[free]]] = keys[todo[free]]
                todo = todo[self.keys[slot[todo]] != keys[todo]]
                slot[todo] = (slot[todo] + 1) & (len(self.keys) - 1)
            slot = self.find(keys)
            self.values[slot] = values
            self.filled = len(keys)
        slot = int(self.slots(np.array([key]))[0])
        while self.keys[slot] >= 0:
            slot = (slot + 1) & (len(self.keys) - 1)
        self.keys[slot], self.values[slot] = key, packed
        self.filled += 1

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slots of transitions: theirs, or the free one where the search ended."""
        slot = self.slots(keys)
        held = self.keys[slot]
        todo = np.flatnonzero((held != keys) & (held >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (len(self.keys) - 1)
            held = self.keys[slot[todo]]
            todo = todo[(held != keys[todo]) & (held >= 0)]
        return slot

    def follows(self, left: bytes | None, right: bytes) -> bool:
        key = (left, right)
        if key not in self.may_follow:
            if len(self.may_follow) > 2_000_000:
                self.may_follow.clear()
            self.may_follow[key] = merge((left or b"") + right, self.ranks) == ([left, right] if left else [right])
        return self.may_follow[key]

    def compile(self, state: int, byte: int) -> None:
        """Add the transition from a state by a byte: next state and change of the count, packed."""
        grown = [(self.children[node][byte], last, more) for node, last, more in self.content[state] if byte in self.children[node]]
        for node, last, more in grown:  # the longest first
            entry = self.token[node]
            if entry is not None and self.follows(last, entry):
                change = more + 1
                break
        else:
            raise ValueError("a byte without a vocabulary entry")
        chain = tuple((node, last, more - change) for node, last, more in grown if self.children[node]) + ((0, entry, 0),)
        self.insert(state * 256 + byte, (self.state(chain) << _SHIFT) + change + _BIAS)

    def step(self, states: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and changes of the counts."""
        keys = states * np.int64(256) + data
        slot = self.find(keys)
        new = self.keys[slot] < 0
        if new.any():
            for key in np.unique(keys[new]).tolist():
                self.compile(key >> 8, key & 255)
            slot = self.find(keys)
        packed = self.values[slot]
        return packed >> _SHIFT, (packed & ((1 << _SHIFT) - 1)) - _BIAS


@functools.lru_cache(4)
def transducer(path: str) -> Transducer:
    vocab, ranks, _ = load(path)
    return Transducer(vocab, ranks)


LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4


@functools.lru_cache(1)
def code_point_classes() -> np.ndarray:
    import regex

    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
        for m in regex.finditer(pattern, every):
            low, high = ord(every[m.start()]), ord(every[m.end() - 1])
            table[low : high + 1] = np.where((np.arange(low, high + 1) >= 0xD800) & (np.arange(low, high + 1) < 0xE000), OTHER, kind)
    return table


def piece_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which code points start a piece; `first` marks the first of each text.

    Same pieces as the pattern 's|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?other+|space+(?!non-space)|space+ gives.
    """
    kind = code_point_classes()[points]
    before = np.concatenate([[0], kind[:-1]])
    before[first] = 0
    after = np.concatenate([kind[1:], [0]])
    after[np.flatnonzero(first[1:])] = 0
    space = kind == SPACE
    blank_before = np.concatenate([[False], points[:-1] == 32]) & (before == SPACE)
    cut = np.where(space, (before != SPACE) | ((after != 0) & (after != SPACE)), np.where(before == SPACE, ~blank_before, before != kind))
    cut[first] = True
    ticks = np.flatnonzero((points == 39) & cut & (before != OTHER))
    if len(ticks):
        size = len(points)
        text_of = np.cumsum(first)
        at = lambda i: np.where((i < size) & (text_of[np.minimum(i, size - 1)] == text_of[ticks]), points[np.minimum(i, size - 1)], 0)
        one, two = at(ticks + 1), at(ticks + 2)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = np.zeros(len(ticks), bool)
        for a, b in ("re", "ve", "ll"):
            long |= (one == ord(a)) & (two == ord(b))
        cut[ticks[short | long] + 1] = False
        cut[ticks[long] + 2] = False
        for i in (ticks[short] + 2, ticks[long] + 3):
            cut[i[i < size]] |= kind[i[i < size]] == LETTER
    return cut


def count_tokens(texts: list[str], machine: Transducer) -> np.ndarray:
    """Token counts of texts without special strings."""
    texts_utf8 = [t.encode("utf-8", "replace") for t in texts]
    sizes = np.array([len(b) for b in texts_utf8], np.int64)
    counts = np.zeros(len(texts), np.int64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return counts
    if len(machine.content) > machine.max_states:
        machine.reset()
    data = np.frombuffer(b"".join(texts_utf8), np.uint8)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    point_bytes = np.flatnonzero((data & 0xC0) != 0x80)
    first_byte = np.zeros(len(data), bool)
    first_byte[begins[full]] = True
    cut = np.zeros(len(data), bool)
    cut[point_bytes[piece_starts(points, first_byte[point_bytes])]] = True

    lanes = -(-sizes // CHUNK)
    owner = np.repeat(np.arange(len(texts)), lanes)
    place = np.arange(len(data)) + np.repeat(np.concatenate([[0], np.cumsum(lanes)[:-1]]) * CHUNK - begins, sizes)
    cells = np.zeros(len(owner) * CHUNK, np.uint8)
    cells[place] = data
    starts = np.zeros(len(cells), bool)
    starts[place] = cut
    real = np.zeros(len(cells), bool)
    real[place] = True

    grid, reset, live = cells.reshape(-1, CHUNK).T, starts.reshape(-1, CHUNK).T, real.reshape(-1, CHUNK).T
    states = np.ones(len(owner), np.int32)
    total = np.zeros(len(owner), np.int64)
    for j in range(CHUNK):
        states = np.where(reset[j], 0, states)
        held = states
        states, change = machine.step(np.where(live[j], states, 1), grid[j])
        states = np.where(live[j], states, held)
        total += change
    counts += np.bincount(owner, total, len(texts)).astype(np.int64)

    # The scan over chunk maps: those with a piece start are constant from there on and absorb what came before.
    synced = starts.reshape(-1, CHUNK).any(1)
    head = np.where(synced, starts.reshape(-1, CHUNK).argmax(1), CHUNK)
    last = np.maximum.accumulate(np.where(synced, np.arange(len(owner)), 0))
    previous = np.concatenate([[0], last[:-1]])
    ends = np.flatnonzero((head > 0) & (synced | np.concatenate([owner[1:] != owner[:-1], [True]])))
    lead = previous[ends]  # the chunk whose state a stretch begins with
    heads = ends - lead  # heads of a stretch, the last one perhaps shorter than a chunk
    first = np.cumsum(heads) - heads
    chunk = np.arange(int(heads.sum())) - np.repeat(first - lead - 1, heads)
    gain = stretches(machine, cells, real, chunk * CHUNK, np.minimum(head[chunk], CHUNK), first, states[lead].astype(np.int64))
    counts += np.bincount(owner[ends], gain, len(texts)).astype(np.int64)
    return counts


def advance(machine: Transducer, cells: np.ndarray, real: np.ndarray, begin: np.ndarray, length: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """States behind stretches of cells and the tokens gained, from the states before them, all together."""
    order = np.argsort(-length, kind="stable")
    begin, length, at = begin[order], length[order], at[order].astype(np.int64)
    gain = np.zeros(len(order), np.int64)
    for j in range(int(length.max(initial=0))):
        n = int(np.searchsorted(-length, -j, side="left"))
        spot = begin[:n] + j
        live = real[spot]
        new, change = machine.step(np.where(live, at[:n], 1), cells[spot])
        at[:n] = np.where(live, new, at[:n])
        gain[:n] += np.where(live, change, 0)
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return at[back], gain[back]


def composed(nexts: np.ndarray, gains: np.ndarray, lanes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix compositions of maps over columns, [head, column] -> column before the next head (-1: not known) and gain,
    by doubling; `lanes` is each head's place in its stretch."""
    nexts, gains, step = nexts.copy(), gains.copy(), 1
    while step <= int(lanes.max(initial=0)):
        some = np.flatnonzero(lanes >= step)  # heads with a prefix that ends `step` before them
        before = nexts[some - step]
        known = before >= 0
        column = np.where(known, before, 0)
        new = np.where(known, np.take_along_axis(nexts[some], column, 1), -1)
        more = np.where(known, np.take_along_axis(gains[some], column, 1), 0)
        nexts[some], gains[some] = new, gains[some - step] + more
        step *= 2
    return nexts, gains


def stretches(machine: Transducer, cells: np.ndarray, real: np.ndarray, begin: np.ndarray, length: np.ndarray, first: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Tokens gained over each stretch of heads: `first` is a stretch's first head, `at` the state before it."""
    n = len(begin)
    if not n:
        return np.zeros(0, np.int64)
    last = np.append(first[1:], n) - 1
    lanes = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
    # The first heads start from their true states, the others from the start of a piece until more is known.
    known: list[dict[int, int]] = [{} for _ in range(n)]  # state before a head -> its column
    start = np.zeros(n, np.int64)
    start[first] = at
    ends_at, gains = np.zeros((n, 0), np.int64), np.zeros((n, 0), np.int64)
    todo, states = np.arange(n), start
    for _ in range(WIDEN):
        behind, more = advance(machine, cells, real, begin[todo], length[todo], states)
        column = np.empty(len(todo), np.int64)
        for k, (h, s) in enumerate(zip(todo.tolist(), states.tolist())):
            column[k] = known[h].setdefault(s, len(known[h]))
        wide = int(column.max()) + 1
        if wide > ends_at.shape[1]:
            pad = wide - ends_at.shape[1]
            ends_at, gains = np.pad(ends_at, ((0, 0), (0, pad)), constant_values=-1), np.pad(gains, ((0, 0), (0, pad)))
        ends_at[todo, column], gains[todo, column] = behind, more
        nexts = np.full(ends_at.shape, -1, np.int64)
        new: list[tuple[int, int]] = []
        inner = np.flatnonzero(lanes[1:] > 0) if n > 1 else np.empty(0, np.int64)  # heads that have a next one
        for h in inner.tolist():
            for k, s in enumerate(ends_at[h].tolist()):
                if s >= 0:
                    place = known[h + 1].get(s, -1)
                    nexts[h, k] = place
                    if place < 0 and (h + 1, s) not in new[-ends_at.shape[1] :]:
                        new.append((h + 1, s))
        nexts[last] = np.where(ends_at[last] >= 0, 0, -1)
        total_next, total = composed(nexts, gains, lanes)
        done = total_next[last, 0] >= 0
        if done.all():
            return total[last, 0]
        # Heads of finished stretches need no more states.
        unfinished = np.repeat(~done, np.diff(np.append(first, n)))
        new = [x for x in new if unfinished[x[0]]]
        todo, states = np.array([h for h, _ in new], np.int64), np.array([s for _, s in new], np.int64)
    found = total[last, 0]
    for k in np.flatnonzero(~done).tolist():
        state, found[k] = np.array([at[k]]), 0
        for h in range(int(first[k]), int(last[k]) + 1):
            column = known[h].get(int(state[0]))
            if column is None:
                state, more = advance(machine, cells, real, begin[h : h + 1], length[h : h + 1], state)
                found[k] += int(more[0])
            else:
                state, found[k] = np.array([ends_at[h, column]]), found[k] + gains[h, column]
    return found


def count_batch(texts: list[str | None], path: str) -> list[int]:
    """Token counts of whole texts, special strings as one token each."""
    special = load(path)[2]
    parts, owner, extra = [], [], [0] * len(texts)
    for i, text in enumerate(texts):
        pieces = [text or ""]
        for s in special:
            if s in (text or ""):
                pieces = [q for p in pieces for q in p.split(s)]
                extra[i] = len(pieces) - 1
        parts += pieces
        owner += [i] * len(pieces)
    counts = np.bincount(owner, count_tokens(parts, transducer(path)), len(texts)) if parts else []
    return [int(c) + e for c, e in zip(counts, extra)]


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER, limit: int = LIMIT, key: str = "doc_id", column: str = "text") -> DataFrame:
    """UTF-8 bytes, tokens and whether the tokens exceed `limit`, for each row."""
    kind = docs.schema[key].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        path = public_tokenizers.path(tokenizer)
        for batch in batches:
            texts = common.texts(batch, column)
            n = count_batch(texts, path)
            sizes = [len((t or "").encode("utf-8", "replace")) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=[key, "n_bytes", "n_tokens", "over_limit"])

    return common.map_batches(docs.select(key, column), count, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(common.documents(spark, sf_dir))
