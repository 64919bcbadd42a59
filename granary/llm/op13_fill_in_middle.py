"""Fill-in-the-middle by a parallel automaton scan.

A unit of text is a run of ASCII letters or one other code point. A deterministic automaton over code point classes reads
texts: a transition that begins a unit emits 1, and two absorbing states say that a mark (`<P>`, `<S>`, `<M>`) was met. A
text is cut into chunks; each chunk has, for every state that it may be entered in, the state it is left in and the units
it emits. These maps compose associatively, so all chunks are read side by side, one array step for each code point, and a
prefix scan by doubling gives the state before each chunk and the units before it. A cut after u units stands where unit
u begins: the scan finds the chunk that holds it, and that chunk alone is read once more, from its entry state.

Texts of up to `GIANT_BYTES` are scanned within a batch. The chunks of longer texts are dealt to all tasks by (text, number
of the chunk); their maps come together for each text (at most 2 GB / `PIECE` small maps, as Spark's strings are under
2 GB), are composed there, and what comes back to the text is one row: for each cut the piece, its entry state and the
units to go. Texts are known by id and sha256, so equal rows share their maps.

Cuts and forms come from the sha256 of seed, `:` and the decimal id: h1 and h2 modulo (units + 1) are the cuts, h3 decides on
`plain`, h4 between `spm` and `psm`.

Null texts count as empty; a null id hashes as no digits. Empty texts and texts that hold a mark are `plain`: their output
is the text. Texts of any length are taken whole. Equal rows get equal results, one for each row. An empty table gives an
empty result. Columns besides id and text stay, but those that have the name of a result are replaced; `text` becomes
`output`, from which `restored` rebuilds it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import common

SEED, PLAIN_PERCENT, SPM_PERCENT = 1, 10, 20
#: Code points of a chunk within a batch, and of a piece that is dealt to another task.
CHUNK, PIECE = 256, 1 << 14
#: Longer texts are dealt out in pieces.
GIANT_BYTES = 1 << 16
RESULTS = ["n", "form", "prefix_chars", "middle_chars", "output"]

OTHER, LETTER, OPEN, MARK_LETTER, CLOSE, NOTHING = range(6)  # classes of code points; NOTHING fills up the last chunk
OUTSIDE, WORD, OPENED, MARKED, FOUND_OUTSIDE, FOUND_WORD = range(6)  # states: the last code point and what it may begin
STATES = CLASSES = 6
#: State reached from a state by a class.
NEXT = np.array(
    [
        [OUTSIDE, WORD, OPENED, WORD, OUTSIDE, OUTSIDE],
        [OUTSIDE, WORD, OPENED, WORD, OUTSIDE, WORD],
        [OUTSIDE, WORD, OPENED, MARKED, OUTSIDE, OPENED],
        [OUTSIDE, WORD, OPENED, WORD, FOUND_OUTSIDE, MARKED],
        [FOUND_OUTSIDE, FOUND_WORD, FOUND_OUTSIDE, FOUND_WORD, FOUND_OUTSIDE, FOUND_OUTSIDE],
        [FOUND_OUTSIDE, FOUND_WORD, FOUND_OUTSIDE, FOUND_WORD, FOUND_OUTSIDE, FOUND_WORD],
    ],
    np.uint8,
)
#: Units that begin: every code point but a letter after a letter.
EMITS = np.array([[c != NOTHING and not (c in (LETTER, MARK_LETTER) and s in (WORD, MARKED, FOUND_WORD)) for c in range(CLASSES)] for s in range(STATES)], np.uint8)
#: Both in one table of place state * CLASSES + class: the next state's place and, in the lowest bit, what is emitted.
STEP = (NEXT * CLASSES * 2 + EMITS).astype(np.uint8).ravel()

_CLASS = np.full(129, OTHER, np.uint8)
for _c in range(128):
    if chr(_c).isalpha():
        _CLASS[_c] = MARK_LETTER if chr(_c) in "PSM" else LETTER
_CLASS[ord("<")], _CLASS[ord(">")] = OPEN, CLOSE


def classes(text: str) -> np.ndarray:
    return _CLASS[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), 128)]


def read(table: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Read the rows of `table` (steps x chunks) from `states` (chunks x entries): states at the end, units emitted."""
    places, counts = (states * CLASSES).astype(np.uint8), np.zeros(states.shape, np.int64)
    for row in table:
        step = STEP[places + row[:, None]]
        counts += step & 1
        places = step >> 1
    return places // CLASSES, counts


def chunk_maps(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each chunk and each state it may be entered in: the state it is left in and the units it emits."""
    return read(table, np.broadcast_to(np.arange(STATES, dtype=np.uint8), (table.shape[1], STATES)))


def compose(first: tuple[np.ndarray, np.ndarray], second: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The maps of `first` followed by `second`, chunk by chunk; associative."""
    ends, counts = first
    return np.take_along_axis(second[0], ends, 1), counts + np.take_along_axis(second[1], ends, 1)


def prefix_scan(ends: np.ndarray, counts: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each chunk the composed map of all chunks of its text up to and with it, by doubling. `first`: the number of
    the first chunk of each chunk's text."""
    ends, counts, at, width = ends.copy(), counts.copy(), np.arange(len(ends)), 1
    while (late := at[at - width >= first]).size:
        ends[late], counts[late] = compose((ends[late - width], counts[late - width]), (ends[late], counts[late]))
        width *= 2
    return ends, counts


def place(row: np.ndarray, state: int, unit: int) -> int:
    """Where unit `unit` (from 0) of a chunk of classes begins, entered in `state`; its length if it has no such unit."""
    letters = (row == LETTER) | (row == MARK_LETTER)
    begins = ~letters
    begins[1:] |= ~letters[:-1]
    if row.size:
        begins[0] = EMITS[state, row[0]]
    found = np.flatnonzero(begins)
    return int(found[unit]) if unit < found.size else int(row.size)


class Scan:
    """The scan of a batch of texts."""

    def __init__(self, texts: list[str]):
        self.rows = classes("".join(texts))
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        many = -(-self.sizes // CHUNK)
        self.firsts = np.cumsum(many) - many
        chunks = int(many.sum())
        self.text = np.repeat(np.arange(len(texts)), many)
        self.inside = (np.arange(chunks) - self.firsts[self.text]) * CHUNK
        table = np.full(chunks * CHUNK, NOTHING, np.uint8)
        table[np.arange(self.rows.size) + np.repeat(self.firsts * CHUNK - self.begins, self.sizes)] = self.rows
        ends, counts = prefix_scan(*chunk_maps(np.ascontiguousarray(table.reshape(chunks, CHUNK).T)), self.firsts[self.text])
        self.ends, self.counts = ends[:, OUTSIDE], counts[:, OUTSIDE]  # texts are entered in OUTSIDE
        last = self.firsts + many - 1
        some = many > 0
        self.n = np.where(some, self.counts[np.where(some, last, 0)] if chunks else 0, 0)
        self.marked = np.where(some, self.ends[np.where(some, last, 0)] >= FOUND_OUTSIDE if chunks else False, False)

    def cut(self, i: int, unit: int) -> int:
        """The code points of text `i` before its unit `unit`."""
        if unit >= self.n[i]:
            return int(self.sizes[i])
        low = self.firsts[i]
        high = low + -(-int(self.sizes[i]) // CHUNK)
        chunk = low + int(np.searchsorted(self.counts[low:high], unit, "right"))
        before, state = (self.counts[chunk - 1], self.ends[chunk - 1]) if chunk > low else (0, OUTSIDE)
        begin = self.begins[i] + self.inside[chunk]
        end = min(begin + CHUNK, self.begins[i] + self.sizes[i])
        return int(self.inside[chunk] + place(self.rows[begin:end], int(state), int(unit - before)))


def rendered(text: str, form: str, a: int, b: int) -> str:
    if form == "plain":
        return text
    return f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}" if form == "psm" else f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"


def form_of(text: str, marked: bool, h3: int, h4: int, plain: int, spm: int) -> str:
    if not text or marked or h3 % 100 >= 100 - plain:
        return "plain"
    return "spm" if h4 % 100 < spm else "psm"


def _columns(batch: pa.RecordBatch, rest: list[str], found: list[tuple[int, str, int | None, int | None, str]]) -> pa.RecordBatch:
    """The kept columns of a batch beside the results."""
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    made = [pa.array(c, k) for c, k in zip(zip(*found) if found else [[]] * 5, kinds)]
    return pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in rest] + made, names=[*rest, *RESULTS])


def _cuts(n: int, h1: int, h2: int) -> tuple[int, int]:
    return tuple(sorted((h1 % (n + 1), h2 % (n + 1))))


def transform(docs: DataFrame, seed: int = SEED, plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT, giant_bytes: int = GIANT_BYTES, key: str = "doc_id", column: str = "text") -> DataFrame:
    """`docs` with `output` instead of the text, and n, form, prefix_chars and middle_chars (null where plain)."""
    rest = [c for c in docs.columns if c != column and c not in RESULTS]
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256)
    hashes = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"_h{i + 1}") for i in range(4)]
    rows = docs.select(*rest, F.coalesce(F.col(column), F.lit("")).alias("_text"), *hashes)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*rest).schema] + ["n long, form string, prefix_chars long, middle_chars long, output string"])

    def result(text: str, n: int, form: str, cut) -> tuple:
        if form == "plain":
            return n, form, None, None, text
        a, b = map(cut, (0, 1))
        return n, form, a, b - a, rendered(text, form, a, b)

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small(batches):
            held = common.texts(batch, "_text")
            h1, h2, h3, h4 = (common.texts(batch, f"_h{i}") for i in (1, 2, 3, 4))
            scan, found = Scan(held), []
            for i, t in enumerate(held):
                n = int(scan.n[i])
                units = _cuts(n, h1[i], h2[i])
                found.append(result(t, n, form_of(t, bool(scan.marked[i]), h3[i], h4[i], plain_percent, spm_percent), lambda k, i=i, units=units: scan.cut(i, units[k])))
            yield _columns(batch, rest, found)

    def among(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small(batches):
            found = []
            for t, h3, h4, n, marked, pieces, states, units in zip(*(common.texts(batch, c) for c in ("_text", "_h3", "_h4", "_n", "_marked", "_pieces", "_states", "_units"))):

                def cut(k, t=t, pieces=pieces, states=states, units=units):
                    at = pieces[k] * PIECE
                    return at + place(classes(t[at : at + PIECE]), states[k], units[k])

                found.append(result(t, n, form_of(t, marked, h3, h4, plain_percent, spm_percent), cut))
            yield _columns(batch, rest, found)

    giant = F.octet_length("_text") > giant_bytes
    short = common.map_arrow(rows.filter(~giant), within, schema)
    long = rows.filter(giant).withColumn("_key", F.struct(F.col(key).cast("string").alias("id"), F.sha2(F.col("_text").cast("binary"), 256).alias("sha")))
    found = long.join(selected(long).hint("merge"), F.col("_key").eqNullSafe(F.col("_of")))
    return short.union(common.map_arrow(found.drop("_key", "_of"), among, schema))


def selected(long: DataFrame) -> DataFrame:
    """For each `_key` of `long`: units, whether a mark is in it, and for both cuts the piece, its entry state and the
    units to go in it. Pieces are dealt to all tasks and mapped there."""
    pieces = long.select("_key", "_h1", "_h2", F.posexplode_outer(F.expr(f"regexp_extract_all(_text, '(?s).{{1,{PIECE}}}', 0)")).alias("_piece", "_part"))

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small(batches):
            scan = PieceMaps(common.texts(batch, "_part"))
            kept = [batch.column(i) for i in range(4)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(scan.ends.tolist(), pa.list_(pa.int32())), pa.array(scan.counts.tolist(), pa.list_(pa.int64()))], names=["_key", "_h1", "_h2", "_piece", "_ends", "_counts"])

    dealt = pieces.repartition("_key", "_piece")
    mapped = common.map_arrow(dealt.select("_key", "_h1", "_h2", "_piece", "_part"), maps, "_key struct<id string, sha string>, _h1 long, _h2 long, _piece int, _ends array<int>, _counts array<long>")
    each = mapped.groupBy("_key", "_h1", "_h2", "_piece").agg(F.min(F.struct("_ends", "_counts")).alias("_map"))  # equal rows have equal maps
    texts = each.groupBy("_key", "_h1", "_h2").agg(F.sort_array(F.collect_list(F.struct("_piece", "_map._ends", "_map._counts"))).alias("_maps"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for h1, h2, maps in zip(*(common.texts(batch, c) for c in ("_h1", "_h2", "_maps"))):
                ends, counts = (np.array([m[c] for m in maps]) for c in ("_ends", "_counts"))
                ends, counts = (x[:, OUTSIDE] for x in prefix_scan(ends, counts, np.zeros(len(maps), np.int64)))
                n, where = int(counts[-1]), []
                for unit in _cuts(n, h1, h2):
                    i = min(int(np.searchsorted(counts, unit, "right")), len(maps) - 1)
                    where.append((i, int(ends[i - 1]) if i else OUTSIDE, unit - (int(counts[i - 1]) if i else 0)))
                found.append((n, bool(ends[-1] >= FOUND_OUTSIDE), *(list(x) for x in zip(*where))))
            kinds = [pa.int64(), pa.bool_(), *[pa.list_(pa.int64())] * 3]
            made = [pa.array(c, k) for c, k in zip(zip(*found) if found else [[]] * 5, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["_of", "_n", "_marked", "_pieces", "_states", "_units"])

    return common.map_arrow(texts, choose, "_of struct<id string, sha string>, _n long, _marked boolean, _pieces array<long>, _states array<long>, _units array<long>")


class PieceMaps:
    """The maps of whole pieces: their chunks' maps, composed."""

    def __init__(self, pieces: list[str]):
        many = [max(1, -(-len(p) // CHUNK)) for p in pieces]
        table = np.full((sum(many), CHUNK), NOTHING, np.uint8)
        at = 0
        for p, k in zip(pieces, many):
            table[at : at + k].reshape(-1)[: len(p)] = classes(p)
            at += k
        ends_at = np.cumsum(many)
        ends, counts = prefix_scan(*chunk_maps(np.ascontiguousarray(table.T)), np.repeat(ends_at - many, many))
        self.ends, self.counts = ends[ends_at - 1], counts[ends_at - 1]


def restored(output: Column, form: Column) -> Column:
    """The exact text, from an output and its form. A part holds no mark, so the marks of an output are its own."""
    parts = F.split(output, "<[PSM]>", -1)
    whole = {"psm": (1, 3, 2), "spm": (2, 3, 1)}
    return reduce(lambda rest, f: F.when(form == f, F.concat(*(parts[i] for i in whole[f]))).otherwise(rest), whole, output)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = transform(common.documents(spark, sf_dir).select("doc_id", "text"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"))
