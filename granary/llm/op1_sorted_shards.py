"""Token-id output as sorted-string-table shards.

File layout (all integers little-endian unless said otherwise)
    data blocks     entries in key order, each `varint shared, varint rest, varint size, rest of key, value`: a key
                    repeats `shared` bytes of the key before it; every `RESTART` entries, and at the block's start, the
                    whole key stands; then the u32 places of those restarts and their u32 count. Blocks are closed at
                    about `BLOCK_BYTES`, compressed with zstd and followed by the u32 crc32 of the compressed bytes.
    Bloom filter    u8 number of hashes, then the bits
    block index     one entry for each data block in the same layout: its last key -> u64 place, u32 size
    footer          u64 place and u32 size of the Bloom filter, the same of the index, u64 entries, u64 token ids,
                    u8 bytes of a token id, 8 bytes of magic

A key orders as its bytes: eight big-endian bytes of a long with the sign bit turned, UTF-8 for strings, no bytes for
null (null sorts first). A value is the ids of one document, two or four bytes each. Lookups test the Bloom filter,
search the index and the block's restarts by bisection, and read one block.

Writing: rows are dealt to shards by ranges of (key, hash of the text), so that a repeated key spreads as well, sorted in
each task, encoded there in a stream, and written to a file of the attempt's own. The manifest has the file of each
shard's attempt that counted; what lost or doubled attempts left is deleted when all are done. Reading streams the shards
block by block.

Null texts count as empty and hold the end id alone. Rows with equal keys are all kept, next to each other. An empty
table gives no shard. Very long texts have a block of their own. Additional columns are not read.
"""

from __future__ import annotations

import array
import functools
import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from granary.llm import common
from granary.llm.op9_token_counts import byte_symbols, known_make, piece_starts

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
BLOCK_BYTES = 64 << 10
RESTART = 16
BITS_PER_KEY = 10
HASHES = 7
MAGIC = b"GRNSST01"
FOOTER = struct.Struct("<QIQIQQB8s")
#: Pieces a task remembers; about 200 bytes each.
MEMO_PIECES = 400_000
#: Texts that are cut into pieces together.
TEXTS = 128


def put_varint(out: bytearray, n: int) -> None:
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)


def get_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 0x7F) << shift
        if b < 0x80:
            return n, at
        shift += 7


def key_bytes(key: int | str | None) -> bytes:
    if key is None:
        return b""
    return key.encode("utf-8", "replace") if isinstance(key, str) else struct.pack(">Q", key + (1 << 63))


def key_value(key: bytes, is_text: bool) -> int | str | None:
    if is_text:
        return key.decode("utf-8")
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


class BlockWriter:
    def __init__(self) -> None:
        self.body, self.restarts, self.n, self.last = bytearray(), [], 0, b""

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.n % RESTART == 0:
            self.restarts.append(len(self.body))
        else:
            most = min(len(key), len(self.last))
            while shared < most and key[shared] == self.last[shared]:
                shared += 1
        for x in (shared, len(key) - shared, len(value)):
            put_varint(self.body, x)
        self.body += key[shared:]
        self.body += value
        self.n, self.last = self.n + 1, key

    def finish(self) -> bytes:
        return bytes(self.body) + struct.pack(f"<{len(self.restarts) + 1}I", *self.restarts, len(self.restarts))


def _entry(block: bytes, at: int, before: bytes) -> tuple[bytes, int, int, int]:
    """Key, value's place and end, and the next entry's place."""
    shared, at = get_varint(block, at)
    rest, at = get_varint(block, at)
    size, at = get_varint(block, at)
    key = before[:shared] + block[at : at + rest]
    return key, at + rest, at + rest + size, at + rest + size


def entries(block: bytes, start: int = 0) -> Iterator[tuple[bytes, bytes]]:
    end = len(block) - 4 - 4 * struct.unpack_from("<I", block, len(block) - 4)[0]
    at, key = start, b""
    while at < end:
        key, low, high, at = _entry(block, at, key)
        yield key, block[low:high]


def seek(block: bytes, key: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Entries from the first whose key isn't below `key`, found by bisection of the restarts."""
    n = struct.unpack_from("<I", block, len(block) - 4)[0]
    places = struct.unpack_from(f"<{n}I", block, len(block) - 4 - 4 * n)
    low, high = 0, n
    while low < high:
        middle = (low + high) // 2
        if _entry(block, places[middle], b"")[0] < key:
            low = middle + 1
        else:
            high = middle
    return (e for e in entries(block, places[max(0, low - 1)] if n else 0) if e[0] >= key)


def key_hash(key: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(key)


def bloom_places(h: int, bits: int, hashes: int = HASHES) -> list[int]:
    step = (h >> 32) | 1
    return [(h + i * step) % bits for i in range(hashes)]


class ShardWriter:
    """One shard, written in key order to an open binary stream."""

    def __init__(self, stream, width: int):
        import zstandard

        self.stream, self.width, self.place = stream, width, 0
        self.packer = zstandard.ZstdCompressor(level=1)
        self.block, self.index, self.last, self.hashes = BlockWriter(), BlockWriter(), None, array.array("Q")
        self.n = self.tokens = 0

    def add(self, key: bytes, ids: bytes) -> None:
        if self.block.n and len(self.block.body) + len(ids) > BLOCK_BYTES:
            self._flush()
        self.block.add(key, ids)
        if self.last != key:
            self.hashes.append(key_hash(key))
            self.last = key
        self.n, self.tokens = self.n + 1, self.tokens + len(ids) // self.width

    def _write(self, data: bytes) -> tuple[int, int]:
        place = self.place
        self.stream.write(data)
        self.place += len(data)
        return place, len(data)

    def _flush(self) -> None:
        if self.block.n:
            packed = self.packer.compress(self.block.finish())
            self.index.add(self.block.last, struct.pack("<QI", *self._write(packed + struct.pack("<I", zlib.crc32(packed)))))
            self.block = BlockWriter()

    def finish(self) -> None:
        self._flush()
        bits = max(64, len(self.hashes) * BITS_PER_KEY)
        field = np.zeros(bits, bool)
        for h in self.hashes:
            field[bloom_places(h, bits)] = True
        bloom = self._write(struct.pack("<BQ", HASHES, bits) + np.packbits(field).tobytes())
        index = self._write(self.index.finish())
        self._write(FOOTER.pack(*bloom, *index, self.n, self.tokens, self.width, MAGIC))


class ShardReader:
    """One shard, by a random-access file."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        footer = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if footer[-1] != MAGIC:
            raise ValueError("not a sorted shard")
        self.bloom_at, self.index_at = footer[0:2], footer[2:4]
        self.n, self.tokens, self.width = footer[4:7]

    def _read(self, place: int, size: int) -> bytes:
        self.file.seek(place)
        return self.file.read(size)

    @functools.cached_property
    def bloom(self) -> tuple[int, int, bytes]:
        data = self._read(*self.bloom_at)
        return (*struct.unpack_from("<BQ", data), data[9:])

    @functools.cached_property
    def index(self) -> bytes:
        return self._read(*self.index_at)

    def _block(self, place: int, size: int) -> bytes:
        import zstandard

        data = self._read(place, size)
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("a damaged block")
        return zstandard.ZstdDecompressor().decompress(data[:-4])

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for _, at in entries(self.index):
            yield from entries(self._block(*struct.unpack("<QI", at)))

    def may_have(self, key: bytes) -> bool:
        hashes, bits, data = self.bloom
        return all(data[p >> 3] >> (7 - (p & 7)) & 1 for p in bloom_places(key_hash(key), bits, hashes))

    def get(self, key: int | str | None) -> list[np.ndarray]:
        """The ids of every document of a key."""
        wanted, found = key_bytes(key), []
        if not self.may_have(wanted):
            return found
        for _, at in seek(self.index, wanted):
            for k, value in seek(self._block(*struct.unpack("<QI", at)), wanted):
                if k != wanted:
                    return found
                found.append(np.frombuffer(value, f"<u{self.width}"))
        return found


class Encoder:
    """Whole texts to ids with the tokenizers library.

    The library cuts a text into pieces by a fixed pattern and its BPE model encodes each by itself, so pieces met before
    are taken from memory and only new ones go to the model. Texts with special strings go to the library whole, and so do
    all texts where the tokenizer is of another make.
    """

    def __init__(self, path: str, end_id: int = END_ID):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import models

        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        self.path, self.known = path, known_make(data)
        self.special = [t["content"] for t in data["added_tokens"]]
        self.symbols = {b: c for c, b in byte_symbols().items()}
        if self.known:
            model = data["model"]
            self.model = models.BPE(vocab=model["vocab"], merges=[tuple(m) for m in model["merges"]], cache_capacity=0)
            ids = [*model["vocab"].values(), *(t["id"] for t in data["added_tokens"])]
        else:
            ids = self.tokenizer.get_vocab(with_added_tokens=True).values()
        largest = max(end_id, *ids)
        self.width = 2 if largest < 1 << 16 else 4
        self.end = int(end_id).to_bytes(self.width, "little")
        self.memo: dict[str, bytes] = {}

    @functools.cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _pack(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{'H' if self.width == 2 else 'I'}", *ids)

    def _piece(self, piece: str) -> bytes:
        return self._pack([t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.symbols))])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text with the end id, as little-endian bytes."""
        texts = [t or "" for t in texts]
        whole = [i for i, t in enumerate(texts) if not self.known or any(s in t for s in self.special)]
        found: list[bytes] = [b""] * len(texts)
        for i in whole:
            found[i] = self._pack(self.tokenizer.encode(texts[i], add_special_tokens=False).ids)
        rest = [i for i in sorted(set(range(len(texts))) - set(whole)) if texts[i]]
        if rest:
            for i, ids in zip(rest, self._by_pieces([texts[i] for i in rest])):
                found[i] = ids
        return [ids + self.end for ids in found]

    def _by_pieces(self, texts: list[str]) -> list[bytes]:
        joined = "".join(texts)
        sizes = np.array([len(t) for t in texts])
        begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        first = np.zeros(len(joined), bool)
        first[begins] = True
        cuts = np.flatnonzero(piece_starts(np.frombuffer(joined.encode("utf-32-le"), "<u4"), first))
        ends = [*cuts[1:].tolist(), len(joined)]
        pieces = [joined[a:b] for a, b in zip(cuts.tolist(), ends)]
        if len(self.memo) > MEMO_PIECES:  # what this batch has of them, the frequent ones, stays
            self.memo = {p: self.memo[p] for p in set(pieces) if p in self.memo}
        ids = list(map(self.memo.get, pieces))
        for i in [i for i, x in enumerate(ids) if x is None]:
            piece = pieces[i]
            if piece not in self.memo:
                self.memo[piece] = self._piece(piece)
            ids[i] = self.memo[piece]
        bounds = [*np.searchsorted(cuts, begins).tolist(), len(cuts)]
        return [b"".join(ids[a:b]) for a, b in zip(bounds, bounds[1:])]


def encoder(name: str, end_id: int) -> Encoder:
    import public_tokenizers

    return common.kept(("encoder", name, end_id), lambda: Encoder(public_tokenizers.path(name), end_id))


@dataclass(frozen=True)
class Shard:
    path: str
    base: int
    is_text: bool


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def write_shards(docs: DataFrame, folder: str, tokenizer: str = TOKENIZER, end_id: int = END_ID, shards: int | None = None, key: str = "doc_id", column: str = "text") -> list[Shard]:
    """Write `docs` in key order into a new folder below `folder` (a URI that all executors reach), so that several tables may be
    written to one place; the shards, in key order."""
    folder = f"{folder}/{uuid.uuid4().hex}"
    n = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    is_text = isinstance(docs.schema[key].dataType, StringType)
    rows = docs.select((F.col(key) if is_text else F.col(key).cast("long")).alias("key"), F.coalesce(F.col(column), F.lit("")).alias("text"))
    dealt = rows.repartitionByRange(n, "key", F.xxhash64("text")).sortWithinPartitions("key", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, name = context.partitionId(), f"shard-{context.partitionId():07d}-{context.taskAttemptId()}.sst"
        held = encoder(tokenizer, end_id)
        writer = None
        for batch in common.small(batches, TEXTS):
            if writer is None:
                store, root = filesystem(folder)
                store.create_dir(root, recursive=True)
                stream = store.open_output_stream(f"{root}/{name}")
                writer = ShardWriter(stream, held.width)
            for k, ids in zip(batch.column(0).to_pylist(), held.encode(common.texts(batch))):
                writer.add(key_bytes(k), ids)
        held.memo.clear()
        if writer is not None:
            writer.finish()
            stream.close()
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([f"{folder}/{name}"]), pa.array([writer.tokens])], names=["part", "path", "tokens"])

    made = sorted(common.map_arrow(dealt, write, "part long, path string, tokens long").collect())
    kept = {r["path"].rsplit("/", 1)[1] for r in made}
    if made:
        store, root = filesystem(folder)
        for f in store.get_file_info(fs.FileSelector(root)):
            if f.base_name.startswith("shard-") and f.base_name not in kept:
                store.delete_file(f.path)
    base, found = 0, []
    for r in made:
        found.append(Shard(r["path"], base, is_text))
        base += r["tokens"]
    return found


def read_shards(spark: SparkSession, shards: list[Shard], key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """A row for each document, from the files: key, start, n_tokens, ids_crc32 and, if wanted, the ids."""
    is_text = bool(shards) and shards[0].is_text
    kind = "string" if is_text else "long"
    arrow = pa.string() if is_text else pa.int64()
    schema = f"`{key}` {kind}, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    if not shards:
        return spark.createDataFrame([], schema)
    # From Arrow: rows of Python objects would go through Python workers of another kind, which stay beside the tasks'.
    todo = spark.createDataFrame(pa.table({"path": [s.path for s in shards], "base": [s.base for s in shards]})).repartition(len(shards))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush():
            names = [key, "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
            arrays = [pa.array(keys, arrow), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())]
            return pa.RecordBatch.from_arrays(arrays + [pa.array(lists, pa.list_(pa.int64()))] * with_ids, names=names)

        for batch in batches:
            for path, at in zip(*(c.to_pylist() for c in batch.columns)):
                store, inside = filesystem(path)
                with store.open_input_file(inside) as file:
                    reader = ShardReader(file)
                    keys, starts, sizes, sums, lists, held = [], [], [], [], [], 0
                    for k, value in reader:
                        ids = np.frombuffer(value, f"<u{reader.width}")
                        keys.append(key_value(k, is_text))
                        starts.append(at)
                        sizes.append(len(ids))
                        sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
                        if with_ids:
                            lists.append(ids.astype(np.int64))
                        at += len(ids)
                        held += len(ids) * with_ids + 1
                        if held >= 100_000:
                            yield flush()
                            keys, starts, sizes, sums, lists, held = [], [], [], [], [], 0
                    yield flush()

    return common.map_arrow(todo, read, schema)


def lookup(shards: list[Shard], key: int | str) -> list[np.ndarray]:
    """The ids of every document of a key; shards whose Bloom filter excludes it are not searched."""
    found = []
    for s in shards:
        store, inside = filesystem(s.path)
        with store.open_input_file(inside) as file:
            found += ShardReader(file).get(key)
    return found


def to_shards(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """Write `docs` to the shared folder and read the files back, a row for each document."""
    spark = docs.sparkSession
    folder = common.shared_folder(spark, "shards")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    return read_shards(spark, write_shards(docs, folder, tokenizer, end_id))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_shards(common.documents(spark, sf_dir))
