"""Redaction, markup, first texts and changelogs against plain Python, with limits of time."""

import random
import re
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from granary import plans
from granary.functions import text as T
from granary.operators import dedup, redact
from granary.streaming import events as stream

EMAIL = r"[\w.\-+]+@[\w.\-]+\.[a-zA-Z]{2,}"


def texts(n, seed):
    r = random.Random(seed)
    parts = ["a", "b.c", "@", "@x.org", "+", ".co", ".com", " ", "é", "1381234", "5678", "-", "123456789012345678", "x", "0571-", "\n", "["]
    return ["".join(r.choice(parts) for _ in range(r.randint(1, 14))) for _ in range(n)]


def test_addresses_as_by_the_plain_pattern(spark):
    rows = list(enumerate(texts(400, 1)))
    found = spark.createDataFrame(rows, "k long, t string").select("k", F.regexp_extract_all("t", F.lit(redact.PATTERNS[0][1]), F.lit(0)).alias("f")).collect()
    assert {r["k"]: r["f"] for r in found} == {k: re.findall(EMAIL, t) for k, t in rows}


def test_redaction_as_by_its_sql(spark, tmp_path):
    """Word borders, blanks and letters of any script count as in the SQL of the queries."""
    r = random.Random(3)
    parts = ["a", "K", "\u212a", "é", "１", "1", "12345678", "１２３４", "123456789012345678", "ABCDEFGHJKLMNPQRTU", "@", "a@b.co", "-", " ", "\x0b", "\xa0", "_", "138", "0571", "\u200d"]
    rows = [(0, "êeuxtreenauxelleeux, x")] + [(k, "".join(r.choice(parts) for _ in range(r.randint(1, 9)))) for k in range(1, 1500)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("redact_counts", "redact_summary"):
        df = plans.QUERIES[name](spark, str(tmp_path))
        assert sorted(map(tuple, df.collect())) == sorted(c.sql(f"SELECT {', '.join(df.columns)} FROM ({plans.ORACLES[name]})").fetchall())


def test_vault_is_by_each_pattern_once(spark):
    docs = spark.createDataFrame(list(enumerate(texts(300, 2))), "k long, text string")
    back = redact.restored(redact.redacted(docs.withColumn("before", F.col("text")), "text"), "text")
    assert back.filter(~F.col("before").eqNullSafe(F.col("text"))).count() == 0
    for df in (redact.vault(docs, "k", "text").groupBy("k", "label").count(), redact.redacted(docs, "text").filter(F.size("vault") > 0)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("++@") <= 2  # found once, rewritten once


@pytest.mark.parametrize("part", ["a", "<", "</script ", "<script ", "<script>", "a@", "1", "a.", ".-+"])
def test_long_texts_take_time_in_proportion(spark, part):
    df = spark.createDataFrame([(1, part * (1_000_000 // len(part)))], "k long, text string")
    df.limit(0).collect()
    began = time.time()
    redact.redacted(df, "text").select(F.char_length("text")).collect()
    df.select(F.char_length(T.strip_html(F.col("text")))).collect()
    assert time.time() - began < 15


def test_strip_html(spark):
    samples = ["a<b>c</b>", "x<script>1</script>y", "x<script>1 <b>z</b>", "a < b <c", "<style x>q</style><script", "<<a>>b", "a<script <script>b</script>c"]
    plain = [re.sub(r"[ \t\r\n]+", " ", re.sub(r"<[^>]*>", " ", re.sub(r"(?s)<(script|style)[^>]*>.*?</(script|style)>", " ", s))).strip(" ") for s in samples]
    assert [r[0] for r in spark.createDataFrame([(s,) for s in samples], "t string").select(T.strip_html(F.col("t"))).collect()] == plain


def test_keep_first_goes_by_keys_and_order(spark):
    long, other = "the same long text of a row", "another long text, of its own"
    rows = [(1, 1, long), (1, 2, long), (2, 2, other), (None, 1, long), (None, 2, long), (None, 3, "short"), (None, 4, "short"), (2, 3, None)]
    found = dedup.keep_first(spark.createDataFrame(rows, "doc long, ord long, text string"), ["doc"], "text", "ord").collect()
    assert sorted(map(tuple, found), key=repr) == sorted([(1, 1, long), (2, 2, other), (None, 1, long), (None, 3, "short"), (None, 4, "short"), (2, 3, None)], key=repr)


def folded(changes):
    held = {}
    for k, _, op, f, g, patched in sorted(changes, key=lambda x: x[1]):
        if op == "added":
            held[k] = (f, g)
        elif op == "removed":
            held.pop(k, None)
        elif k in held:
            held[k] = (f if "f" in patched else held[k][0], g if "g" in patched else held[k][1])
    return held


def test_changelog(spark, tmp_path):
    schema = "k long, s long, op string, f long, g long, patched array<string>"
    fixed = [(1, 1, "added", 5, None, []), (1, 2, "removed", None, None, []), (1, 3, "updated", None, 7, ["g"]), (2, 4, "updated", 1, 1, ["f"]), (3, 5, "added", 1, 2, []), (3, 6, "updated", None, 9, ["f"])]
    r = random.Random(3)
    made = [(r.randint(10, 25), 10 + i, r.choice(["added", "updated", "updated", "removed"]), r.choice([None, 1, 2]), r.choice([None, 3, 4]), r.sample(["f", "g"], r.randint(0, 2))) for i in range(300)]
    changes = fixed + made
    df = spark.createDataFrame(changes, schema)
    batch = stream.fold_changes(df, "k", "s", "op", ["f", "g"], "patched")
    wanted = folded(changes)
    assert 1 not in wanted and 2 not in wanted and wanted[3] == (None, 2)
    assert {x["k"]: (x["f"], x["g"]) for x in batch.collect()} == wanted
    df.repartition(5).write.parquet(f"{tmp_path}/changes")
    source = stream.read(spark, f"{tmp_path}/changes", df.schema)
    streamed = stream.run(stream.fold_changes(source, "k", "s", "op", ["f", "g"], "patched"), "complete", f"{tmp_path}/out")
    assert {x["k"]: (x["f"], x["g"]) for x in streamed.collect()} == wanted
