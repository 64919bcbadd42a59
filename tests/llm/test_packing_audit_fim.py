"""Packing, the filter audit and fill-in-the-middle against brute force, and on odd rows."""

import hashlib
import itertools
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm import op11_pack_patterns, op12_filter_audit, op13_fill_in_middle

SCHEMA = "doc_id long, text string, source string, n long, form string, mask int, row string, length string"



def odd_rows():
    rnd = random.Random(11)
    prose = " ".join(rnd.choice("the of and Ab cd e".split()) + str(rnd.randint(0, 300)) for _ in range(700))
    texts = [None, "", " \n\t ", "one", "A", "<P>", "a<S>b", "x < y > P", "<<M> ", "<p> <Q>", "é ß 漢字 😀a😀", prose, prose, prose + "!", "ab\ncd\n" * 9, "z" * 3000, "Zz9 " * 2000, "don't <|endoftext|> stop"]
    rows = [(i, t, None if i % 5 == 0 else f"s{i % 3}", 7, "f", 3, "r", "l") for i, t in enumerate(texts)]
    return rows + [rows[11], (None, prose, "s1", 7, "f", 3, "r", "l"), (None, None, None, 7, "f", 3, "r", "l")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


# Packing


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check_packed(rows, wanted, capacity):
    """Every id of every document in one piece, sequences without gaps and within the capacity; the share of padding."""
    documents, held = defaultdict(list), defaultdict(list)
    for r in rows:
        documents[r["doc_id"]].append(r)
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for d, lists in wanted.items():
        found = sorted((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in documents.pop(d))
        todo = []  # rows of one id may be cut in different ways, so cut each of them as it was
        for ids in lists:
            todo.append(len(ids))
        assert sum(x[1] for x in found) == sum(todo)
        for start, n, crc, total in found:
            assert any(len(ids) == total and zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes()) == crc and len(ids[start : start + n]) == n for ids in lists)
        if len(lists) == 1:
            assert [x[0] for x in found] == list(itertools.accumulate([x[1] for x in found], initial=0))[:-1]
    assert not documents
    for pieces in held.values():
        pieces.sort()
        assert [p[0] for p in pieces] == list(itertools.accumulate([p[1] for p in pieces], initial=0))[:-1]
        assert sum(p[1] for p in pieces) <= capacity
    return 1 - sum(r["length"] for r in rows) / (capacity * len(held))


def test_packing(odd, empty, tokenizer):
    wanted = defaultdict(list)
    for r in odd_rows():
        wanted[r[0]].append([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1])
    for capacity, most in ((2048, 0.3), (256, 0.05), (64, 0.02)):
        assert check_packed(op11_pack_patterns.pack(odd, capacity=capacity).collect(), wanted, capacity) <= most
    assert op11_pack_patterns.pack(empty).collect() == []
    assert op11_pack_patterns.pack(empty).columns == "doc_id start length ids_crc32 doc_tokens sequence_id offset".split()


def test_packed_sequences(odd):
    packed = op11_pack_patterns.pack(odd, capacity=128, with_ids=True)
    sizes = {r["sequence_id"]: r["n"] for r in packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()}
    assert {r["sequence_id"]: len(r["ids"]) // 4 for r in op11_pack_patterns.sequences(packed).collect()} == sizes
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in packed.collect())


def test_packing_of_one_length(spark):
    docs = spark.createDataFrame([(i, "a " * 600) for i in range(60)], "doc_id long, text string").repartition(4)
    rows = op11_pack_patterns.pack(docs, capacity=1000).collect()
    assert len({r["sequence_id"] for r in rows}) == -(-sum(r["length"] for r in rows) // 1000)  # they are cut


def fewest(lengths, capacity):
    """The smallest number of sequences, by trying all ways to put the pieces."""
    best = len(lengths)

    def put(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for j in {r: j for j, r in enumerate(rooms) if r >= lengths[i]}.values():
            put(i + 1, [*rooms[:j], rooms[j] - lengths[i], *rooms[j + 1 :]])
        put(i + 1, [*rooms, capacity - lengths[i]])

    put(0, [])
    return best


def test_column_generation():
    for seed in range(12):
        r = random.Random(seed)
        lengths = sorted((r.randint(5, 60) for _ in range(9)), reverse=True)
        h = Counter(lengths)
        sizes = sorted(h, reverse=True)
        patterns, used, bound = op11_pack_patterns.solve(sizes, [h[s] for s in sizes], 64, 0.0)
        assert all(sum(sizes[i] * a for i, a in p.items()) <= 64 for p in patterns)
        np.testing.assert_allclose([sum(p.get(i, 0) * x for p, x in zip(patterns, used)) for i in range(len(sizes))], [h[s] for s in sizes], atol=1e-6)
        assert bound - 1e-6 <= used.sum() and bound <= fewest(lengths, 64) + 1e-6 and fewest(lengths, 64) <= np.ceil(bound - 1e-6) + 1


def test_plans_cover_all_ranks():
    for seed, n, classes in ((1, 30, 128), (2, 3000, 16), (3, 3000, 64)):
        r = random.Random(seed)
        h = Counter(min(512, int(r.lognormvariate(4, 1)) + 1) for _ in range(n))
        plan = op11_pack_patterns.make_plan(dict(h), 512, classes)
        ranges, filled = defaultdict(list), Counter()
        for length, low, high, base, per, place in plan.places:
            ranges[length].append((low, high))
            for j in range(high - low):
                filled[base + (place + j) // per] += length
        for length, low, high, _ in plan.cuts:
            ranges[length].append((low, high))
        for length, c in h.items():
            assert [x for low, high in sorted(ranges[length]) for x in range(low, high)] == list(range(c))
        assert max(filled.values(), default=0) <= 512
        if classes >= 64:
            assert plan.sequences <= 1.03 * sum(x * c for x, c in h.items()) / 512 + 1
    assert len(op11_pack_patterns.merged_lengths({i: 1 for i in range(1, 100)}, 10)) == 10


# Audit of filters


def failures(rows):
    first = {}
    for d, t, *_ in rows:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    for d, t, part, *_ in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        flags = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in t) > 2 * len(t), any(c in "#$%&*|" for c in t), d is not None and d > first[t]]
        yield part or "", "".join(f for f, x in zip("ABCDE", flags) if x), d


def audited(rows, good, toxic):
    held, found = defaultdict(list), {}
    for part, fails, d in failures(rows):
        held[part].append((fails, d))
    for part, docs in held.items():
        shapley = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                shapley[f] += len(gone)
                found[part, order, step] = [len(left), len(gone), sum(f in x[0] for x in docs) - len(gone), sum(x[0] == f for x in docs), sum(x[1] in good for x in gone), sum(x[1] in toxic for x in gone)]
        for (p, order, step), values in found.items():
            if p == part:
                values.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in found.items()}


def test_audit(spark, odd, empty):
    rows = odd_rows()
    labels = spark.createDataFrame([(i, i % 2, int(i % 4 == 0)) for i in range(12)] + [(3, 0, 1), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    good, toxic = {i for i in range(12) if i % 2}, {i for i in range(12) if i % 4 == 0} | {3}
    found = {(r["part"], r["filter_order"], r["step"]): tuple(r[m] for m in op12_filter_audit.MEASURES) for r in op12_filter_audit.audit(op12_filter_audit.mask_cells(odd, labels)).collect()}
    assert found == audited(rows, good, toxic)
    assert op12_filter_audit.audit(op12_filter_audit.mask_cells(empty, labels)).collect() == []


def test_walk_visits_each_order_by_swaps():
    for n in range(1, 7):
        order, seen = list(range(n)), {tuple(range(n))}
        for i in op12_filter_audit.swaps(n):
            order[i], order[i + 1] = order[i + 1], order[i]
            assert tuple(order) not in seen
            seen.add(tuple(order))
        assert len(seen) == np.prod(range(1, n + 1))


# Fill in the middle


def middle(d, t, seed=1):
    t = t or ""
    h = [int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[i : i + 8], 16) for i in (0, 8, 16, 24)]
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return d, n, "plain", None, None, t, t
    form = "spm" if h[3] % 100 < 20 else "psm"
    return d, n, form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}", t


def test_middle(odd, empty):
    for giant in (1 << 16, 40):  # the second sends most texts through dealt pieces
        made = op13_fill_in_middle.transform(odd, giant_bytes=giant)
        found = made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", op13_fill_in_middle.restored(F.col("output"), F.col("form")).alias("back"))
        assert sorted(map(tuple, found.collect()), key=repr) == sorted((middle(r[0], r[1]) for r in odd_rows()), key=repr)
        assert set(made.columns) == {"doc_id", "source", "mask", "row", "length", *op13_fill_in_middle.RESULTS}
    assert op13_fill_in_middle.transform(empty).collect() == []


def test_middle_of_giants(spark):
    r = random.Random(3)
    texts = ["".join(r.choice("abC <>PSM.é漢") for _ in range(100_000)), "ab" * 40_000, "ab" * 40_000 + "<M" + "c" * 70_000 + ">", "ab " * 30_000 + "<M>"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1, texts[1]), (9, texts[1])]
    found = op13_fill_in_middle.transform(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")
    assert sorted(map(tuple, found.collect())) == sorted(middle(*x)[:-1] for x in rows)


def test_chunk_maps_compose():
    r = random.Random(4)
    step = op13_fill_in_middle
    text = "".join(r.choice("ab <P>SMé") for _ in range(999))
    rows = step.classes(text)
    whole = step.chunk_maps(rows[:, None])
    parts = [step.chunk_maps(rows[a:b, None]) for a, b in ((0, 400), (400, 405), (405, 999))]
    left, right = step.compose(step.compose(parts[0], parts[1]), parts[2]), step.compose(parts[0], step.compose(parts[1], parts[2]))
    for x in (left, right):
        assert (x[0] == whole[0]).all() and (x[1] == whole[1]).all()
    assert whole[1][0, 0] == len(re.findall(r"[A-Za-z]+|[^A-Za-z]", text))
    began = time.time()
    assert step.Scan(["a" * 4_000_000]).n.tolist() == [1] and time.time() - began < 10
