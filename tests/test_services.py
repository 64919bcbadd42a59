"""Services that refuse batches, and outputs that are only partly right."""

import hashlib
import json

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from granary import plugins
from granary.operators import findings


def service(texts):
    if sum(map(len, texts)) > 20:
        raise plugins.Refused("too large")
    return [[float(len(t)), 1.0] for t in texts]


def test_refused_batches_are_halved(spark):
    texts = ["a" * n for n in (3, 9, 12, 1, 30, 0, 7, 25, 2, 2)] + [None]
    assert plugins.halved(service, []) == []
    df = spark.createDataFrame([(i, t, i % 3 == 0) for i, t in enumerate(texts)], "k long, t string, far boolean").repartition(2)
    found = {r["k"]: (r["x"]["v"], r["x"]["error"]) for r in df.select("k", plugins.service_embedder(service, 4)(F.col("t")).alias("x")).collect()}
    assert found == {i: (None, "too large") if len(t or "") > 20 else ([float(len(t or "")), 1.0], None) for i, t in enumerate(texts)}
    both = df.select("k", "far", plugins.chosen_embedder(plugins.service_embedder(service, 4), plugins.hashed_embedder(8), F.col("t"), F.col("far")).alias("x")).collect()
    assert all(len(r["x"]["v"]) == (2 if r["far"] else 8) for r in both if r["x"]["v"] is not None) and {r["k"] for r in both if r["x"]["error"]} == {i for i, t in enumerate(texts) if i % 3 == 0 and len(t or "") > 20}


def test_outputs_are_checked_one_by_one(spark):
    good = {"severity": "high", "category_code": "BRAND_LOCK", "source_quote": "q", "confidence": 0.9}
    rows = [
        (1, json.dumps({"findings": [good, {**good, "severity": "severe"}, 7, None, {**good, "confidence": "much"}, good]})),
        (2, json.dumps({"findings": [{**good, "confidence": 0.5}, {**good, "severity": "low", "confidence": 0.5}, {**good, "category_code": "X"}, {**good, "source_quote": " "}]})),
        (3, "{"), (4, "{}"), (5, json.dumps({"findings": []})), (6, None), (7, json.dumps({"findings": "none"})),
    ]
    found = findings.checked_outputs(spark.createDataFrame(rows, "k long, p string"), "k", "p").collect()
    assert sorted((r["k"], r["pos"], r["error"]) for r in found if r["error"]) == [
        (1, 1, "unknown severity"), (1, 2, "no object"), (1, 3, "no object"), (1, 4, "no confidence"), (1, 5, "too many"),
        (2, 0, "high without confidence"), (2, 2, "unknown category"), (2, 3, "no quotation"), (3, -1, "no JSON"), (4, -1, "no findings"), (6, -1, "no JSON"), (7, -1, "no findings"),
    ]
    assert sorted((r["k"], r["pos"]) for r in found if not r["error"]) == [(1, 0), (2, 1)]


def test_hashed_embedder_hashes_each_gram_once(spark, monkeypatch):
    """The vectors of a loop over all grams, from one hash for each different gram of a task."""
    texts = ["", "a", "é𝄞", "aaaa", "the cat 𝄞 sat", None, "abcé " * 9000, "x" * 20_000] * 5

    def plain(text):
        v = np.zeros(64, np.float32)
        for i in range(max(1, len(text) - 2)):
            h = int.from_bytes(hashlib.blake2b(text[i : i + 3].encode(), digest_size=8).digest(), "little")
            v[h % 64] += 1 if h >> 63 else -1
        n = float(np.linalg.norm(v))
        return (v / n if n else v).tolist()

    found = spark.createDataFrame(list(enumerate(texts)), "k long, t string").select("k", plugins.hashed_embedder()(F.col("t")).alias("v")).collect()
    assert {r["k"]: r["v"] for r in found} == {k: plain(t or "") for k, t in enumerate(texts)}
    hashes = []
    real = hashlib.blake2b
    monkeypatch.setattr(plugins.hashlib, "blake2b", lambda *a, **k: hashes.append(a) or real(*a, **k))
    monkeypatch.setattr(plugins.F, "pandas_udf", lambda f, *_: lambda column: f)
    list(plugins.hashed_embedder()(None)(iter([pd.Series(["abcd" * 1000] * 40)])))
    assert len(hashes) <= 8
