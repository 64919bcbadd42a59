"""The stages of the pipeline on a small corpus with planted cases, against brute force where there is one."""

import zlib

import numpy as np

import corpus_pipeline
from granary.llm import common, op1_sorted_shards, op5_decontaminate, op8_language_id
from tests.llm.test_operators import VOCAB, brute_components, brute_contamination, prose


def edited(text, edits):
    """The text with so many words replaced, far from each other."""
    w = text.split()
    for k in range(edits):
        w[(2 * k + 1) * len(w) // (2 * edits)] = f"edit{k}"
    return " ".join(w)


def similarity(a, b, n):
    p, q = ({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} for w in (a.split(), b.split()))
    return len(p & q) / len(p | q)


def test_near_copies_at_five_words_and_four_fifths(spark):
    rows = []
    for i, edits in enumerate((8, 9, 15, 20)):
        text = prose(450, 2000 + i)
        copy = edited(text, edits)
        assert similarity(text, copy, 3) < 0.9 and (similarity(text, copy, 5) >= 0.8) == (edits < 10)
        rows += [(10 * i, text), (10 * i + 1, copy)]
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 10, 20, 21, 30, 31]


def test_stages(spark, tmp_path):
    passage = prose(60, 900)
    rows = [(i, prose(80 + i % 50, 1000 + i), "en", "hot" if i % 3 else f"s{i % 5}", 1) for i in range(300)]
    rows += [(400, rows[3][1], "en", "s1", 1), (401, rows[3][1] + " end", "en", "s1", 1), (402, passage + " " + prose(20, 4), "en", "s2", 1), (403, "12345 !!", "en", "s2", 1), (404, None, "en", "s2", 1), (405, "", None, None, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    items = [(1, passage)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    text = {r[0]: r[1] for r in rows}
    held = set(text)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = f"{tmp_path}/{name.replace(' ', '_')}"
        result = stage(spark, docs, str(tmp_path))
        assert result.columns == docs.columns
        result.write.parquet(out)
        docs = spark.read.parquet(out)
        now = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if name == "language ID":
            assert now == held - {403, 404, 405}
        elif name == "n-gram Jaccard join":
            assert now == set(brute_components([(k, text[k]) for k in held]).values()) and 400 not in now and 401 not in now and 3 in now
        elif name == "benchmark decontamination":
            assert now == {k for k in held if not brute_contamination(text[k], items)[4]} and 402 not in now
        else:
            assert now == held
        held = now
    last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    found = sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in last.collect())
    assert len(found) == docs.count() and {f[0] for f in found} == held
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for key, _, n, crc in found[:40]:
        ids = np.array(tokenizer.encode(text[key], add_special_tokens=False).ids + [0], "<u4")
        assert (n, crc) == (len(ids), zlib.crc32(ids.tobytes()))
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in whole.collect()) == sorted((f[0], f[2], f[3]) for f in found)
    assert len(VOCAB) == 400


def test_odd_tables(spark, tmp_path):
    """Empty, with repeated rows and keys, nulls in every column, columns of the operators' own names, and no labels."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, key long, score double, node string"
    long = prose(20_000, 50)
    rows = [(1, prose(60, 1), None, "a", 1, 7, 0.5, "n"), (1, prose(60, 1), None, "a", 1, 7, 0.5, "n"), (1, prose(60, 2), None, "a", 1, 7, 0.5, "n"), (2, None, None, None, None, None, None, None), (None, prose(60, 3), None, None, 1, 7, 0.5, "n"), (3, long, None, "a", 1, 7, 0.5, "n"), (4, long + " end", None, "b", 1, 7, 0.5, "n")]
    bench = spark.createDataFrame([(1, prose(40, 70)), (2, None)], "item_id long, text string")
    for name, some in (("full", rows), ("none", [])):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(some, schema).coalesce(1).write.parquet(f"{folder}/documents.parquet")
        bench.write.parquet(f"{folder}/benchmark.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        sizes = []
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
            result = stage(spark, docs, folder)
            assert result.columns == docs.columns
            result.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            sizes.append(docs.count())
        assert sizes[:3] == ([6, 3, 3] if some else [0, 0, 0]) and sizes[3] <= 2 * sizes[2]
        last = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
        assert sorted({r["doc_id"] or 0 for r in last.collect()}) == ([0, 1, 3] if some else [])


def test_stages_leave_no_workers_or_tables_beside_the_next_ones(spark, tmp_path):
    """What an executor holds beside a stage's own tasks: workers of a second kind or of a second map, other operators' tables."""
    docs = spark.createDataFrame([(i, prose(40, i), "en") for i in range(20)], "doc_id long, text string, lang string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    benchmark = spark.createDataFrame([(1, prose(40, 3))], "item_id long, text string")
    plan = lambda df: df._jdf.queryExecution().toString()
    kept = op5_decontaminate.decontaminate(docs, benchmark)
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i in range(20) if i != 3]
    assert plan(kept).partition("== Physical Plan ==")[2].count("MapInArrow") == 1
    assert "ExistingRDD" not in plan(op1_sorted_shards.to_shards(docs))
    seen, tables = [], spark.createDataFrame
    spark.createDataFrame = lambda data, *a, **b: (seen.append(type(data).__name__), tables(data, *a, **b))[1]
    try:
        op8_language_id.train(docs, common.crc_bucket("doc_id", 4) != 2)
    finally:
        del spark.createDataFrame
    assert seen == ["Table"]

    def work(batches):
        tree = op8_language_id.trie()
        yield from batches
        assert tree is op8_language_id.trie()

    def other(batches):
        assert not [k for k in common._kept if k[0] != "trie"]
        yield from batches

    def third(batches):
        assert not common._kept
        yield from batches

    for f in (work, other, third):
        assert common.map_arrow(docs.select("doc_id").coalesce(1), f, "doc_id long").count() == 20
