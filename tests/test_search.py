"""Search against all products, with ties, zero vectors and blocks of queries; joins of sets of grams; lookups."""

import random
import tracemalloc
import types

import numpy as np
import pandas as pd
import pytest

from granary import plugins
from granary.operators import dedup, vector


def test_search_is_exact(spark):
    r = random.Random(1)
    made = [[float(r.randint(-2, 2)) for _ in range(6)] for _ in range(200)]
    rows = [(i, v, f"l{i % 3}") for i, v in enumerate(made)] + [(1000 + i, made[i], "copy") for i in range(40)] + [(2000, [0.0] * 6, "zero"), (2001, None, "none")]
    queries = [(i, v) for i, v, _ in rows if i % 7 == 0] + [(5000, None)]

    def cosine(a, b):
        n = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
        return round(sum(x * y for x, y in zip(a, b)) / n, 9) if n else 0.0

    wanted = set()
    for q, v in queries:
        if v is not None:
            best = sorted((-cosine(v, u), i, lab) for i, u, lab in rows if u is not None)[:4]
            wanted |= {(q, i, lab, k) for k, (_, i, lab) in enumerate(best, 1)}
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string").repartition(3)
    asked = spark.createDataFrame(queries, "query_id long, q array<float>")
    for most in (1000, 10):
        found = vector.search(vectors, asked, 4, max_queries=most)
        assert {(x["query_id"], x["vec_id"], x["label"], x["rank"]) for x in found.collect()} == wanted
    assert vector.search(vectors.limit(0), asked, 4).collect() == []


@pytest.mark.parametrize("least", [0.25, 0.3, 0.5, 0.9, 1.0])
def test_near_sets_like_all_pairs(spark, least):
    draw = random.Random(11)
    some = lambda n: [(i, draw.choice([None, [], *[sorted({"hot", *draw.choices("abcdefghij", k=draw.randrange(1, 8))})] * 8])) for i in range(n)]
    left, right = some(60), some(40)
    share = lambda g, h: len(set(g) & set(h)) / len(set(g) | set(h))
    wanted = {(a, b): share(g, h) for a, g in left for b, h in right if g and h and share(g, h) >= least}
    frames = [spark.createDataFrame(rows, "k int, g array<string>") for rows in (left, right)]
    found = dedup.near_sets(*frames, least).collect()
    assert len(found) == len(wanted) > 0
    assert all(abs(wanted[r["a"], r["b"]] - r["similarity"]) < 1e-12 for r in found)


def test_gram_pairs_of_odd_rows(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, ""), (4, "ab"), (5, "abcd"), (6, "abcde"), (7, "ab")], "k int, t string")
    assert {(r["a"], r["b"], round(r["similarity"], 3)) for r in dedup.gram_pairs(rows, "k", "t", 0.3).collect()} == {(2, 3, 1.0), (4, 7, 1.0), (5, 6, 0.667)}
    assert dedup.gram_pairs(rows.limit(0), "k", "t", 0.3).count() == 0


def test_lookup_of_cached_queries(spark):
    cache = spark.createDataFrame([("red shoes",), ("red shoe",), ("Blue hat!",), (None,)], "e string")
    asked = spark.createDataFrame([("red shoe",), ("red shoes now",), ("blue hat",), ("zzz",), (None,)], "q string")
    found = {r["query"]: (r["entry"], round(r["score"], 3)) for r in dedup.fuzzy_lookup(asked, cache, "q", "e").collect()}
    assert found == {"red shoe": ("red shoe", 1.0), "red shoes now": ("red shoes", 0.667), "blue hat": ("Blue hat!", 1.0)}


def test_searches_of_any_number_of_queries(spark):
    corpus = spark.createDataFrame([(f"u{i:02d}", f"page {i} about x things") for i in range(30)] + [("u03", "page 3 again"), ("v", None)], "url string, text string")
    asked = spark.createDataFrame([("Page 7 about",), ("page",), ("PAGE!",), ("nowhere",), ("",), (None,)], "query string")
    found = {r["query"]: r["urls"] for r in plugins.corpus_searcher(corpus, 3)(asked).collect()}
    assert found == {"Page 7 about": ["u07"], "page": ["u00", "u01", "u02"], "PAGE!": ["u00", "u01", "u02"], "nowhere": None, "": None, None: None}
    many = spark.range(12_000).selectExpr("concat('page ', id) AS query")
    assert plugins.corpus_searcher(corpus, 3)(many).filter("urls IS NOT NULL").count() == 30


@pytest.mark.parametrize("values", [1000, 1])
def test_search_holds_few_rows_a_query(values):
    """A task's memory goes by queries times k and the scores of a step, not by the rows that reach a query; `values` 1 makes all tie."""
    r = np.random.default_rng(5)
    queries, k = 8000, 15
    ids, wanted = np.arange(queries), vector._units(pd.Series(list(r.normal(size=(queries, 8)))))
    rows = pd.DataFrame({"vec_id": r.permutation(3000), "label": ["a", "b", "c"] * 1000, "__v": list(r.normal(size=(values, 8))[r.integers(0, values, 3000)])})
    tracemalloc.start()
    found = pd.concat(vector._nearest(types.SimpleNamespace(value=(ids, wanted)), k, "vec_id")([rows[:2000], rows[2000:]]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300_000_000
    for q in range(0, queries, 800):
        score = np.round(vector._units(rows["__v"]) @ wanted[q], 12)
        best = sorted(zip((-score).tolist(), rows["vec_id"].tolist()))[:k]
        assert sorted(found[found["query_id"] == q]["vec_id"]) == sorted(i for _, i in best)
