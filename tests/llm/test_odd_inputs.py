"""Inputs that once took too long, too much memory or gave wrong results."""

import time
import unicodedata

import pytest
from pyspark.sql import functions as F

from granary.llm import common, op1_sorted_shards, op3_html_text, op4_mixing, op5_decontaminate, op6_jaccard_join, op8_language_id


def test_repeated_rows_give_one_verified_pair(spark, monkeypatch):
    base = " ".join(f"w{i}" for i in range(300))
    other = base.replace("w150", "changed")
    rows = [(1, base)] * 200 + [(2, other)] * 200
    stored = {}
    written = common.written

    def counted(df, kind):
        found = written(df, kind)
        stored.setdefault(kind, []).append(found.count())
        return found

    monkeypatch.setattr(common, "written", counted)
    found = op6_jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert {tuple(r) for r in found.distinct().collect()} == {(1, 298, 1), (2, 298, 1)} and found.count() == 400
    assert max(stored["join-texts"][-1:]) <= 2


def test_items_of_one_window_are_bounded():
    parts = list(op5_decontaminate.slices(((i, "one two three") for i in range(2500)), 13, 1000))
    assert [len(p.items[3][0]) for p in parts] == [1000, 1000, 500]
    long = " ".join(f"w{i}" for i in range(5000))
    assert all(sum(len(x) for x in p.windows.values()) <= 1000 for p in op5_decontaminate.slices([(1, long)], 13, 1000))


def test_items_of_several_slices_meet(spark):
    benchmark = spark.createDataFrame([(i, "one two three") for i in range(25)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "zero one two three four"), (2, "one two")], "doc_id long, text string")
    parts = op5_decontaminate.benchmark_slices(benchmark, most=10)
    found = {r["doc_id"]: len(r["f"]["items"]) for r in op5_decontaminate.find_hits(docs, parts, "f").collect()}
    assert found == {1: 25, 2: 0}


def test_letters_are_letters():
    for c in map(chr, range(0x30000)):
        if unicodedata.category(c) != "Cs" and unicodedata.category(c) != "Cn":
            assert bool(op8_language_id._LETTER.search(c)) == unicodedata.category(c).startswith("L"), hex(ord(c))


@pytest.mark.parametrize("part", ["</script ", "<script ", "<", "<a b=", "</p", "&am"])
def test_long_pages_take_time_in_proportion(part):
    page = "<html><body><article><p>text</p><script>" + part * (1_000_000 // len(part))
    began = time.time()
    assert op3_html_text.raw_end("script", page, page.index("<script>") + 8) is None
    op3_html_text.parse(page)
    assert time.time() - began < 15


def test_two_tables_in_one_folder(spark, tmp_path):
    a, b = (spark.createDataFrame([(i, t) for i in range(n)], "doc_id long, text string") for t, n in (("a b", 20), ("c", 5)))
    first = op1_sorted_shards.write_shards(a, f"file://{tmp_path}/s", shards=2)
    second = op1_sorted_shards.write_shards(b, f"file://{tmp_path}/s", shards=2)
    assert op1_sorted_shards.read_shards(spark, first).count() == 20 and op1_sorted_shards.read_shards(spark, second).count() == 5


def test_sources_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b", "\0null"), (2, "a b", None), (3, "a b", ""), (4, "a b", "=")], "doc_id long, text string, source string")
    found = op4_mixing.mix(docs).select("doc.doc_id", "source").distinct().collect()
    assert {r["doc_id"]: r["source"] for r in found} == {1: "\0null", 2: None, 3: "", 4: "="}
