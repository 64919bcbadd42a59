from granary.operators import structure
from granary.sources import files


def test_blocks(spark):
    rows = [(1, 1, i, t, x, top, x + 10, top + 10) for i, (t, x, top) in enumerate([("Title", 0.0, 0.0), ("first", 0.0, 40.0), ("row", 20.0, 41.0), ("second", 0.0, 52.0), ("far", 0.0, 120.0)])]
    words = spark.createDataFrame(rows, "doc_id long, page int, word_idx int, text string, x0 double, top double, x1 double, bottom double")
    found = structure.blocks(words).orderBy("block_idx").collect()
    assert [(r["type"], r["text"]) for r in found] == [("heading", "Title"), ("paragraph", "first row\nsecond"), ("heading", "far")]
    assert (found[1]["x0"], found[1]["bottom"]) == (0.0, 62.0)


def test_rows_and_lines():
    assert structure.row_text([(0, 10, "ab"), (12, 20, "cd"), (90, 99, "ef")]) == "ab cd\tef"
    assert structure.join_lines(["甲", "乙。", "丙", "1. 丁"]) == "甲乙。\n丙\n1. 丁"


def test_fallbacks(spark):
    keys = spark.createDataFrame([(1,), (2,), (3,)], "k long")
    a, b = (spark.createDataFrame(r, "k long, result string") for r in ([(1, "a")], [(1, "b"), (2, "b")]))
    found = {r["k"]: (r["result"], r["origin"]) for r in files.with_fallbacks(keys, "k", ("memory", a), ("disk", b)).collect()}
    assert found == {1: ("a", "memory"), 2: ("b", "disk"), 3: (None, "none")}


def test_documents(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"good")
    (tmp_path / "b.bin").write_bytes(b"\xff")
    (tmp_path / "c.bin").write_bytes(b"\xff\xff")
    found = {r["path"][-5:]: (r["text"], r["error"]) for r in files.read_documents(spark, str(tmp_path), lambda c: c.decode(), lambda c: "rescued" if len(c) == 1 else "").collect()}
    assert found == {"a.bin": ("good", None), "b.bin": ("rescued", None), "c.bin": (None, "empty")}


def test_numbering_and_contents(spark):
    heads = spark.createDataFrame([(1, 1, "decimal2", "1.1 a"), (1, 2, "decimal2", "1.3 b"), (1, 3, "decimal2", "1.2 c")], "doc_id long, ord long, pattern string, title string")
    assert [r["title"] for r in structure.numbering_breaks(heads).collect()] == ["1.2 c"]
    rows = spark.createDataFrame([(1, 1, 1)] * 3 + [(1, 2, 1)] * 3 + [(1, 2, None)], "doc_id long, page int, level int")
    assert [r["page"] for r in structure.contents_pages(rows, ["doc_id", "page"], "level").collect()] == [1]
