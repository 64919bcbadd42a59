"""The ten operators against brute force, and on nulls, empty and long texts, ties, repeated rows and clashing columns."""

import collections
import hashlib
import math
import random
import re
import types
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from granary.llm import common, op1_sorted_shards, op2_url_filter, op3_html_text, op4_mixing, op5_decontaminate, op6_jaccard_join, op7_quality_rules, op8_language_id, op9_token_counts, op10_maxent_lm

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, node string, n int, found string"
rnd = random.Random(5)
VOCAB = ["".join(rnd.choice("aeioustrnlm") for _ in range(rnd.randint(2, 7))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) for _ in range(n))


def odd_rows():
    base = prose(120, 1)
    texts = [None, "", " \n\t ", "one", "one two", base, base, base.upper(), base.replace(base.split()[60], "changed"), "é" * 3 + " ß 漢字 " + prose(20, 2), "x" * 50_000, prose(30_000, 3), "don't <|endoftext|> stop", "a\nb\na\nb\nb"]
    rows = [(i, t, "en" if i % 2 else None, None if i % 5 == 0 else f"s{i % 3}", len(t or ""), 1, "n", 2, "f") for i, t in enumerate(texts)]
    return rows + [rows[5], (None, base, "en", "s1", 1, 1, "n", 2, "f")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def words(t):
    return (t or "").encode().translate(LOWER).split()


def strings(n=400):
    r = random.Random(9)
    alphabet = "aabceilmnorstuv   ''''\n\t 0123 .,!?-éüñß  漢字"
    found = ["", "<|endoftext|>", "a<|endoftext|> b<|endoftext|>", "  x", "x  ", "\n\n x\n", "he's they're I'll''s 's't", "abc" * 400, "日本語" * 200, "x'" * 300, " " * 500]
    found += ["".join(r.choice(alphabet) for _ in range(r.randint(1, 300))) for _ in range(n)]
    return found + ["".join(chr(r.choice([r.randint(1, 0x2FF), r.randint(0x300, 0xD7FF), r.randint(0xE000, 0x10FFFF)])) for _ in range(r.randint(1, 60))) for _ in range(n // 2)]


# 1: sorted shards


def test_shards(spark, odd, empty, tokenizer):
    rows = odd.orderBy("doc_id", "text").collect()
    found = op1_sorted_shards.to_shards(odd).orderBy("start").collect()
    start = 0
    ids_of = lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
    wanted = collections.Counter()
    for r in rows:
        ids = ids_of(r["text"])
        wanted[r["doc_id"], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert wanted == collections.Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in found)
    keys = [-1 if r["doc_id"] is None else r["doc_id"] for r in found]
    assert keys == sorted(keys)
    for r in found:
        assert r["start"] == start
        start += r["n_tokens"]
    assert op1_sorted_shards.to_shards(empty).count() == 0


def test_lookup(spark, tmp_path, tokenizer):
    docs = spark.createDataFrame([(i * 3, prose(40, i)) for i in range(300)], "doc_id long, text string")
    shards = op1_sorted_shards.write_shards(docs, f"file://{tmp_path}/s", shards=3)
    assert len(shards) > 1
    for i in (0, 7, 299):
        assert op1_sorted_shards.lookup(shards, i * 3)[0].tolist() == tokenizer.encode(prose(40, i), add_special_tokens=False).ids + [0]
    assert op1_sorted_shards.lookup(shards, 4) == []
    text = spark.createDataFrame([("b", "x"), ("a", "y y")], "name string, text string")
    named = op1_sorted_shards.write_shards(text, f"file://{tmp_path}/t", shards=2, key="name")
    assert [r["name"] for r in op1_sorted_shards.read_shards(spark, named, "name").orderBy("start").collect()] == ["a", "b"]


def test_blocks():
    writer = op1_sorted_shards.BlockWriter()
    keys = [op1_sorted_shards.key_bytes(i * 7 - 300) for i in range(100)]
    for k in keys:
        writer.add(k, b"v" + k)
    block = writer.finish()
    assert list(op1_sorted_shards.entries(block)) == [(k, b"v" + k) for k in keys]
    assert next(op1_sorted_shards.seek(block, keys[40]))[0] == keys[40]
    assert next(op1_sorted_shards.seek(block, op1_sorted_shards.key_bytes(-298)))[0] == keys[1]
    assert len(block) < 100 * (3 + 8 + 9)


def test_encoder_agrees(tokenizer):
    held = op1_sorted_shards.encoder(op1_sorted_shards.TOKENIZER, 0)
    texts = strings(300)
    wanted = [np.array(e.ids + [0], "<u2").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert held.encode(texts) == wanted


def test_other_makes_encode_by_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    name = "word_bpe_49k.json"
    held, library = op1_sorted_shards.encoder(name, 0), Tokenizer.from_file(public_tokenizers.path(name))
    texts = strings(60)
    wanted = [(e.ids + [0]) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, f"<u{held.width}").tolist() for x in held.encode(texts)] == wanted
    if not held.known:
        with pytest.raises(ValueError):
            op9_token_counts.load(public_tokenizers.path(name))


def test_files_of_lost_attempts_go(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, prose(9, i)) for i in range(20)], "doc_id long, text string")
    monkeypatch.setattr(op1_sorted_shards.uuid, "uuid4", lambda: types.SimpleNamespace(hex="own"))  # the folder of this write
    (tmp_path / "s" / "own").mkdir(parents=True)
    (tmp_path / "s" / "own" / "shard-0000000-99999.sst").write_bytes(b"half")
    shards = op1_sorted_shards.write_shards(docs, f"file://{tmp_path}/s", shards=2)
    assert sorted(p.name for p in (tmp_path / "s" / "own").iterdir() if p.name.startswith("shard")) == sorted(x.path.rsplit("/", 1)[1] for x in shards)
    assert op1_sorted_shards.read_shards(spark, shards).count() == 20


# 2: URL filter


def brute_url(url):
    at = (url or "").find("://")
    rest = url[at + 3 :] if url and at >= 0 else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in op2_url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, best.name if best else None, None if best is None else "block" if best.block else "allow"


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "http://a.COM/en/x?y", "http://com/en/", "http://xcom/en/", "https://example.com/en/7", "https://a.example.com/en/71#f", "http://b.net/de", "http://b.net/de/", "http://example.net/de/81", "x://h.org/es/?a", "http://h.org?es/", "a://b://c/d", "http://É.org/es/\n"]
    urls += [f"http://{w}.example.org/fr/{i}" for i, w in enumerate(VOCAB)] + [f"http://casino-spam{i}.example.org/fr/{i}" for i in range(80)] + ["http://spam-pills-new.example.org/de/1"]
    pages = spark.createDataFrame([(i, u, "x", 1.0) for i, u in enumerate(urls)], "page_id long, url string, host string, score double")
    model = op2_url_filter.train(pages)
    found = {r["page_id"]: r for r in op2_url_filter.judge(pages, model).select("row.page_id", "host", "path", "rule", "verdict").collect()}
    for i, u in enumerate(urls):
        host, path, rule, verdict = brute_url(u)
        assert (found[i]["host"], found[i]["path"], found[i]["rule"]) == (host, path, rule), u
        if verdict:
            assert found[i]["verdict"] == verdict
    assert all(found[i]["verdict"] == "allow" for i in range(4))
    good = [found[i]["verdict"] == "allow" for i, u in enumerate(urls) if u and "/fr/" in u and "spam" not in u]
    assert sum(good) >= 0.97 * len(good)
    assert found[len(urls) - 1]["verdict"] == "block"
    none = pages.limit(0)
    assert op2_url_filter.judge(none, op2_url_filter.train(none)).count() == 0


def test_rules_of_the_contract(spark):
    """Each rule's word as its contract lists it, on the host itself and on a subdomain."""
    wanted = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    urls = [(name, f"http://{sub}{name}9") for name in wanted for sub in ("", "a.")]
    pages = spark.createDataFrame([(i, u) for i, (_, u) in enumerate(urls)], "page_id long, url string")
    found = {r["page_id"]: r for r in op2_url_filter.judge(pages, op2_url_filter.train(pages)).select("row.page_id", "rule", "verdict").collect()}
    assert [(found[i]["rule"], found[i]["verdict"]) for i in range(len(urls))] == [(name, wanted[name]) for name, _ in urls]


@pytest.mark.parametrize("share", [20_000, 30])
def test_markov_sums_to_one(spark, monkeypatch, share):
    monkeypatch.setattr(op2_url_filter, "SHARE", share)
    rows = [(f"http://{w}.org/{i}", i % 5 == 0) for i, w in enumerate(VOCAB)]
    for held, bad in zip(op2_url_filter.fit_counts(spark.createDataFrame(rows, "url string, bad boolean")), (False, True)):
        every = collections.Counter(g for u, b in rows if b == bad for g in op2_url_filter.grams(op2_url_filter.symbols(u)))
        by = collections.Counter()
        for g, n in every.items():
            by[len(g)] += n
        assert held.counts == {g: n for g, n in every.items() if n >= by[len(g)] / share}
        for context in ("", "\x02", "ae", "qq", "://", "http"):
            assert math.fsum(held.probability(context + chr(c)) for c in range(128)) == pytest.approx(1)


def test_unseeded_spam_is_caught(spark):
    """Two seed words are held out: hosts that only they mark are caught by what they share with the others."""
    r = random.Random(8)
    tails = ["win", "cheap", "best", "free", "bonus", "deal"]
    spam = [f"https://{a}-{b}.example.org/{r.choice(tails)}/{i}" for i, (a, b) in enumerate((r.choice(("casino", "pills", "lottery", "payday")), r.choice(tails)) for _ in range(300))]
    unseen = [f"https://{a}-{b}.example.org/{r.choice(tails)}/{i}" for i, (a, b) in enumerate((r.choice(("viagra", "bets")), r.choice(tails)) for _ in range(100))]
    good = [f"https://{w}.example.org/fr/{i}" for i, w in enumerate(VOCAB)] + ["https://alphabets.example.org/fr/1"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(spam + unseen + good)], "page_id long, url string")
    seeds = tuple(s for s in op2_url_filter.SEEDS if s not in ("viagra", "bets"))
    # The held-out ones are labelled accepted, so the calibration must leave room for them.
    model = op2_url_filter.train(spark.createDataFrame([(i, u) for i, u in enumerate(spam + good)], "page_id long, url string"), seeds=seeds)
    found = {x["page_id"]: x["verdict"] for x in op2_url_filter.judge(pages, model).select("row.page_id", "verdict").collect()}
    assert sum(found[300 + i] == "block" for i in range(100)) >= 80
    assert sum(found[400 + i] == "allow" for i in range(len(good))) >= 0.97 * len(good) and found[len(found) - 1] == "allow"


def test_urls_repeat_and_may_be_long(spark):
    long = "http://" + "a" * 200_000 + ".org/fr/" + "b" * 200_000
    pages = spark.createDataFrame([(1, long), (1, long), (None, long), (2, "http://casino.example.org/fr/1")], "page_id long, url string")
    found = op2_url_filter.judge(pages, op2_url_filter.train(pages)).collect()
    assert len(found) == 4 and sum(r["path"] == "/fr/" + "b" * 200_000 for r in found) == 3


# 3: HTML extraction


def test_marginals_against_enumeration():
    page = op3_html_text.parse("<body><div class=menu><p>a</p></div><article><p>bb.</p><p>c</p></article></body>")
    r = np.random.default_rng(1)
    model = op3_html_text.Model(r.normal(size=len(op3_html_text.FEATURES)), r.normal(size=(len(op3_html_text.KIND_NAMES), 2, 2)))
    trees = op3_html_text.forest([page])
    n = len(page.nodes)
    total, ones = 0.0, np.zeros(n)
    for bits in range(1 << n):
        y = [(bits >> i) & 1 for i in range(n)]
        s = sum(float(trees.sums(model.weights)[i]) * y[i] for i in range(n)) + sum(model.pairs[trees.kind[i], y[trees.parent[i]], y[i]] for i in range(1, n))
        total += math.exp(s)
        ones += np.array(y) * math.exp(s)
    assert op3_html_text.marginals(trees, model)[0] == pytest.approx(ones / total)


def test_layouts(spark):
    semantic = [f"<html><body><nav><a>Home</a></nav><article><h1>T {i}</h1><p>{prose(30, i)}.</p></article><footer>&copy; x</footer></body></html>" for i in range(60)]
    pages = spark.createDataFrame([(i, f"u{i}", h) for i, h in enumerate(semantic + [None, "", "plain & text", "<p>open <b>x", "<script>a</script>", "<" * 1000])], "page_id long, url string, html string")
    model = op3_html_text.train(pages)
    found = {r["page_id"]: r for r in op3_html_text.extract(pages, model).collect()}
    assert all(found[i]["text"] == f"T {i}\n{prose(30, i)}." and found[i]["n_chars"] == len(found[i]["text"]) for i in range(60))
    assert found[60]["text"] == found[61]["text"] == "" and found[64]["text"] == ""
    layouts = [s.format(t=op3_html_text._TEXT) for s, _ in op3_html_text.LAYOUTS]
    for text in op3_html_text.main_texts(layouts, model):
        assert "The river" in text and "cookies" not in text and "All rights" not in text and "I agree" not in text and "Buy one" not in text
    assert op3_html_text.extract(pages.limit(0), op3_html_text.train(pages.limit(0))).count() == 0


#: Layouts that training never sees: class names and structures of their own, and the main text of each.
OTHER_LAYOUTS = [
    ('<body><div id="page-top"><a>Gazette</a> <a>Log in</a></div><div class="wrap"><div class="leftcol"><ul><li><a>One</a></li><li><a>Two</a></li><li><a>Three</a></li></ul></div><div class="centre"><h1>{0}</h1><p>{1}</p><p>{2}</p></div></div><div class="bottomline"><a>Terms</a> <a>Privacy</a></div></body>', "{0}\n{1}\n{2}"),
    ('<body><nav><a>Home</a></nav><article><h2>{0}</h2><div><p>{1}</p><ol><li>{2}</li><li>{3}</li></ol></div></article><footer><p>Made by hand.</p></footer></body>', "{0}\n{1}\n{2}\n{3}"),
    ('<body><header><p>Daily</p></header><main><p>{1}</p><blockquote>{2}</blockquote><pre>{3}</pre></main><aside><p>{0}</p></aside></body>', "{1}\n{2}\n{3}"),
    ('<html><body><ul><li><a>Start</a></li><li><a>Archive</a></li></ul><p>{1}<p>{2}<p>{3}<div><a>Next</a> <a>Previous</a></div></body></html>', "{1}\n{2}\n{3}"),
    ('<body><section><h1>{0}</h1><p>{1} <b>bold</b> <i>words</i></p><table><tr><th>{2}<td>{3}</table></section><div id="disqus_thread"><p>{1}</p></div></body>', "{0}\n{1} bold words\n{2}\n{3}"),
]


def test_unseen_layouts(spark):
    semantic = [f"<html><body><nav><a>Home</a></nav><article><h1>T {i}</h1><p>{prose(30, i)}.</p></article><footer>&copy; x</footer></body></html>" for i in range(60)]
    model = op3_html_text.train(spark.createDataFrame([(i, h) for i, h in enumerate(semantic)], "page_id long, html string"))
    hit = found = wanted = 0
    for seed in range(5):
        fill = [f"{prose(6, 50 + seed).capitalize()}", *(f"{prose(40, 60 + 7 * seed + k).capitalize()}. {prose(25, 90 + k)}." for k in range(3))]
        for source, main in OTHER_LAYOUTS:
            got = collections.Counter(op3_html_text.main_texts([source.format(*fill)], model)[0].split("\n"))
            aim = collections.Counter(main.format(*fill).split("\n"))
            hit, found, wanted = hit + sum((got & aim).values()), found + sum(got.values()), wanted + sum(aim.values())
    assert 2 * hit / (found + wanted) >= 0.9


@pytest.mark.parametrize("source, blocks", [
    ('<p class="x>Hello', ["Hello"]), ("<!-->x", ["x"]), ("a < b <", ["a < b <"]), ("<b><p>t</b> more</p>", ["t more"]), ("İ" * 30 + "<SCRIPT>x</sCript><p>next</p>", ["İ" * 30, "next"]),
    ("<table><tr><td>x</div>y<td>z</table>w", ["xy", "z", "w"]), ("<p>a<h1>b<h2>c</h2>d", ["a", "b", "c", "d"]), ("<script>a", []), ("x</p>y", ["x", "y"]), ("<p>a</zz><zz>b", ["ab"]), ("a<b", ["a"]),
])
def test_odd_markup(source, blocks):
    assert [t for _, t in op3_html_text.parse(source).blocks] == blocks


@pytest.mark.parametrize("source", ["<a", "<a ", "<div>", "İ<script>", '<a href="', "<!--", "<b>", "<p><b>", "<li><div>", "<script>", "<td></div>"])
def test_long_pages_take_linear_time(source):
    page = "İ<p>first</p>" + source * (200_000 // len(source))
    assert op3_html_text.main_texts([page], op3_html_text.Model()) == [""]
    assert [t for _, t in op3_html_text.parse(page).blocks][1] == "first"


def test_pages_repeat_and_names_clash(spark):
    one = f"<article><h1>Title</h1><p>{prose(3000, 5)}.</p></article>"
    pages = spark.createDataFrame([(1, "u", one, "x", 0), (1, "u", one, "x", 0), (None, None, one, "x", 0), (2, "u", None, "y", 1)], "page_id long, url string, html string, text string, n_chars int")
    found = op3_html_text.extract(pages, op3_html_text.train(pages)).collect()
    assert sorted((r["page_id"] or 0, r["text"]) for r in found) == sorted([(1, f"Title\n{prose(3000, 5)}.")] * 2 + [(0, f"Title\n{prose(3000, 5)}."), (2, "")])


def test_references_and_space():
    page = op3_html_text.parse("<article><p> a&amp;b&nbsp;&#233;\n c<br>d <span>e</span></p><ul><li>f<li>g</ul><!-- no --><style>p{}</style></article>")
    assert [t for _, t in page.blocks] == ["a&b é c d e", "f", "g"]


# 4: mixing


def test_mixing(spark, odd, empty):
    rows = [(i, " ".join(["w"] * 50), "hot" if i % 3 else f"s{i % 4}", "en") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, tokens string")
    found = op4_mixing.mix(docs, entropy=0.999, repeats=2.0)
    by = {r["source"]: r for r in found.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc.doc_id").alias("d"), F.max("epoch").alias("e"), F.first("weight").alias("w")).collect()}
    own = collections.Counter(r[2] for r in rows)
    assert by["hot"]["n"] == by["hot"]["d"] == own["hot"]
    for s in ("s0", "s1", "s2", "s3"):
        assert by[s]["d"] == own[s] and own[s] < by[s]["n"] <= 2 * own[s] + 1
        ratio = (by[s]["w"] / own[s]) / (by["hot"]["w"] / own["hot"])
        assert by[s]["n"] / own[s] == pytest.approx(ratio, abs=0.15)
    assert sum(r["w"] for r in by.values()) == pytest.approx(1)
    again = op4_mixing.mix(docs.repartition(7), entropy=0.999, repeats=2.0)
    assert sorted(map(str, again.select("doc.doc_id", "epoch", "turn").collect())) == sorted(map(str, found.select("doc.doc_id", "epoch", "turn").collect()))
    kept = op4_mixing.mix(odd).select("doc.*")
    assert kept.columns == odd.columns and kept.select("doc_id", "text").distinct().count() == odd.select("doc_id", "text").distinct().count()
    assert op4_mixing.mix(empty).count() == 0
    half = op4_mixing.mix(docs, entropy=0.0, repeats=9.0, budget=75_000.0)
    assert 0.4 < half.count() / 3000 < 0.6


def spark_hash(*values):
    """Spark's xxhash64 of longs (8 bytes) and, marked by a one-tuple, ints (4 bytes)."""
    h = 42
    for v in values:
        data = v[0].to_bytes(4, "little", signed=True) if isinstance(v, tuple) else v.to_bytes(8, "little", signed=True)
        h = xxhash.xxh64_intdigest(data, seed=h)
    return h - (1 << 64) if h >> 63 else h


def brute_mixing(rows, entropy, repeats, per_block):
    """Bisection over shares, then block permutations listed source by source."""
    n = {k: len(words(t)) for k, t, _ in rows}
    shares = collections.Counter()
    for k, _, s in rows:
        shares[s] += n[k]
    total = sum(shares.values())
    weights = lambda t: {s: (x / total) ** t for s, x in shares.items() if x}

    def holds(t):
        w = weights(t)
        z = sum(w.values())
        return -sum(x / z * math.log(x / z) for x in w.values()) >= entropy * math.log(len(w))

    spread = min(x for x in shares.values() if x) / max(shares.values())
    low, high = 0.0, 1.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if holds(middle) else (low, middle)
    t = 1.0 if holds(1.0) else low
    t = max(t, 1 + math.log(repeats) / math.log(spread)) if spread < 1 else t
    w = weights(t)
    largest = max(shares.values())
    found = []
    for s, x in shares.items():
        repeat = (w[s] / x) / (w[max(shares, key=shares.get)] / largest) if x else 1.0
        own = [(k, n[k], spark_hash(k, (17,))) for k, _, source in rows if source == s]
        blocks = -(-(x + 1) // per_block)
        size = collections.Counter()
        for k, m, h in own:
            size[h % blocks] += m
        for epoch in range(math.ceil(round(repeat, 9))):
            left = round((repeat - epoch) * x, 6)
            for b in sorted(size, key=lambda b: (spark_hash(b, (epoch,)), b)):
                share = 1.0 if repeat - epoch >= 1 - 1e-9 else (float(left > 0) if not size[b] else max(0.0, min(1.0, left / size[b])))
                left -= size[b]
                found += [(k, epoch, b) for k, _, h in own if h % blocks == b and spark_hash(h) % 1_000_000 / 1e6 < share]
    return sorted(found)


@pytest.mark.parametrize("most", [20_000, 2])
def test_mixing_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(op4_mixing, "BLOCK_TOKENS", 500)
    rows = [(i, prose(1 + i % 60, i) if i % 17 else "", "hot" if i % 3 else f"s{i % 4}") for i in range(600)] + [(900 + i, "", f"none{i}") for i in range(5)]
    total = sum(len(words(t)) for _, t, _ in rows)
    monkeypatch.setattr(op4_mixing, "MAX_BLOCKS", most)
    found = op4_mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), 0.95, 3.0)
    assert sorted((r["doc_id"], r["epoch"], r["block"]) for r in found.select("doc.doc_id", "epoch", "block").collect()) == brute_mixing(rows, 0.95, 3.0, max(500, total // most + 1))


def test_exponent_hits_the_entropy(spark):
    class Fixed(op4_mixing.Sums):
        def __init__(self, held):
            self.held, self.n, self.total, self.least, self.most = held, len(held), sum(held), min(held), max(held)

    sums = Fixed([1000, 50, 20, 5])
    t = op4_mixing.exponent(sums, 0.9, 1e9)
    assert sums.entropy(t) == pytest.approx(0.9 * math.log(4), abs=1e-6)
    t = op4_mixing.exponent(sums, 0.9, 3.0)
    assert (5 / 1000) ** (t - 1) == pytest.approx(3.0, rel=1e-6)


# 5: decontamination


def brute_contamination(text, items):
    w = op5_decontaminate.words_of(text)
    hit, who = set(), set()
    for item, other in items:
        o = op5_decontaminate.words_of(other)
        n = min(13, len(o))
        windows = {tuple(o[i : i + n]) for i in range(len(o) - n + 1)} if n else set()
        for i in range(len(w) - n + 1 if n else 0):
            if tuple(w[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                who.add(str(item))
    return len(w), len(hit), len(who), hashlib.sha256(",".join(sorted(who)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("most", [200_000, 7])
def test_contamination(spark, odd, empty, most):
    passage = prose(40, 77)
    items = [(1, passage), (10, passage[30:] + " tail"), (2, "Hein-Ten, zwölf"), (3, None), (4, "!!!"), (5, passage)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    extra = [(100, prose(500, 8) + " " + passage), (101, passage.upper().replace(" ", " -- ")), (102, prose(9000, 9) + passage), (103, "hein ten zwölf " * 3), (104, " ".join(passage.split()[:12]))]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    found = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in op5_decontaminate.contamination(docs, bench, max_windows=most).collect()), key=str)
    assert found == sorted(((r["doc_id"], *brute_contamination(r["text"], items)) for r in docs.collect()), key=str)
    wide = odd.unionByName(spark.createDataFrame(extra, "doc_id long, text string"), allowMissingColumns=True)
    kept = op5_decontaminate.decontaminate(wide, bench, max_windows=most)
    assert kept.columns == odd.columns
    clean = [r["doc_id"] for r in wide.collect() if not brute_contamination(r["text"], items)[4]]
    assert sorted(map(str, clean)) == sorted(str(r["doc_id"]) for r in kept.collect())
    cut = op5_decontaminate.decontaminate(wide, bench, "cut", max_windows=most)
    assert cut.count() == wide.count()
    assert all(brute_contamination(r["text"], items)[1] == 0 for r in cut.filter("doc_id in (100, 101, 102)").collect())
    assert op5_decontaminate.contamination(empty, bench).count() == 0
    assert op5_decontaminate.contamination(odd, bench.limit(0)).filter("n_hit > 0").count() == 0


# 6: n-gram Jaccard join


def brute_components(rows):
    sets = {}
    for key, text in rows:
        w = words(text)
        sets.setdefault(key, []).append(frozenset(tuple(w[i : i + 3]) for i in range(len(w) - 2)) if len(w) >= 3 else frozenset([tuple(w)] if w else []))
    keys = sorted(k for k in sets if k is not None)
    parent = {k: k for k in keys}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            for p in sets[a]:
                for q in sets[b]:
                    both = len(p & q)
                    if p and q and 100 * both >= 90 * (len(p) + len(q) - both):
                        x, y = sorted((root(a), root(b)))
                        parent[y] = x
    return {k: root(k) for k in keys}


def copies(n, seed):
    r = random.Random(seed)
    base = prose(150, seed).split()
    for i in range(n):
        w = list(base)
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = f"edit{r.randrange(6)}"
        yield " ".join(w)


def test_components(spark, odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    rows += [(1000 + i, t) for i, t in enumerate(copies(90, 21))] + [(2000 + i, t) for i, t in enumerate(copies(25, 22))]
    rows += [(3000 + i, prose(60, 23) + " " + prose(60, 400 + i)) for i in range(40)] + [(4000 + i, prose(40, 500 + i)) for i in range(30)]
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, node string").repartition(4)
    wanted = brute_components(rows)
    found = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in op6_jaccard_join.join(docs).collect()]
    assert len(found) == len(rows)
    for k, n, c in found:
        assert c == (wanted[k] if k is not None else None)
    size = {k: len({tuple(words(t)[i : i + 3]) for i in range(len(words(t)) - 2)}) if len(words(t)) >= 3 else min(1, len(words(t))) for k, t in rows}
    assert all(n == size[k] for k, n, _ in found if k is not None)
    kept = op6_jaccard_join.deduplicate(odd)
    assert kept.columns == odd.columns
    roots = brute_components([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(set(roots.values()))
    assert op6_jaccard_join.join(empty).count() == 0 and op6_jaccard_join.deduplicate(empty).count() == 0


def test_copy_without_a_key_hides_no_link(spark):
    text = prose(100, 77)
    rows = [(None, text), (1, text), (2, text + " end"), (None, text + " end"), (3, prose(100, 78))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert {(r["doc_id"], r["component_id"]) for r in op6_jaccard_join.join(docs).collect()} == {(None, None), (1, 1), (2, 1), (3, 3)}
    assert sorted(r["doc_id"] or 0 for r in op6_jaccard_join.deduplicate(docs).collect()) == [0, 0, 1, 3]


def test_blocks_of_common_shingles(spark, monkeypatch):
    monkeypatch.setattr(op6_jaccard_join, "BLOCK", 10)
    rows = [(i, t) for i, t in enumerate(copies(60, 31))]
    found = op6_jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == brute_components(rows)


def test_counts_are_exact(spark, monkeypatch):
    monkeypatch.setattr(op6_jaccard_join, "HELD", 500)
    rows = [(i, t) for i, t in enumerate([*copies(40, 41), *(prose(90, 700 + i) for i in range(20))])]
    docs = spark.createDataFrame(rows, "key long, text string").repartition(5)
    counted = {r["shingle"]: r["count"] for r in op6_jaccard_join.exact_counts(op6_jaccard_join.scan(docs, "key", "text", 3, 10), 10).collect()}
    shingler, wanted = op6_jaccard_join.Shingler(3), collections.Counter()
    for s in shingler([t for _, t in rows]):
        wanted.update((s >> np.uint64(22)).tolist())
    # Copies of one set count once for each window of a task, so counts lie between the sets' and the rows'.
    distinct = collections.Counter(x for s in {s.tobytes(): s for s in shingler([t for _, t in rows])}.values() for x in (s >> np.uint64(22)).tolist())
    assert {k for k, n in distinct.items() if n >= 3} <= set(counted) and all(distinct[k] <= n <= wanted[k] for k, n in counted.items())


def test_unknown_counts_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(op6_jaccard_join, "FREQUENT", 1)
    monkeypatch.setattr(op6_jaccard_join, "BLOCK", 10)
    monkeypatch.setattr(op6_jaccard_join, "PAIRS", 50)
    rows = [(i, t) for i, t in enumerate(copies(60, 33))] + [(1000 + i, prose(60, 23) + " " + prose(60, 400 + i)) for i in range(30)]
    found = op6_jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == brute_components(rows)


def test_spread_join(spark):
    left = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 0), (3, 1), (None, 7)], "k long, v long")
    right = spark.createDataFrame([(1, "a"), (2, "b"), (4, "d")], "k long, w string")
    for how in ("inner", "left"):
        found = common.spread_join(left, right, "k", ["v"], how, least=5)
        assert sorted(map(str, found.select("k", "v", "w").collect())) == sorted(map(str, left.join(right, "k", how).select("k", "v", "w").collect()))


@pytest.mark.parametrize("seed", range(3))
def test_filters_never_lose_a_link(seed):
    r = np.random.default_rng(seed)
    for _ in range(300):
        base = r.integers(0, 1 << 63, 60).astype(np.uint64)
        a = np.unique(np.concatenate([base, r.integers(0, 1 << 63, r.integers(0, 5)).astype(np.uint64)]))
        b = np.unique(np.concatenate([base[r.integers(0, 4) :], r.integers(0, 1 << 63, r.integers(0, 4)).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both < 90 * (len(a) + len(b) - both):
            continue
        order = op6_jaccard_join.Order(np.unique(base[:20] >> np.uint64(22)), np.arange(3, 23), 2)
        p, q = op6_jaccard_join.prefix(a, order, 90), op6_jaccard_join.prefix(b, order, 90)
        shared = [x for x in p if x in q]
        assert shared
        i, j = int(np.flatnonzero(p == shared[0])[0]), int(np.flatnonzero(q == shared[0])[0])
        sign = np.array([op6_jaccard_join.signature(a), op6_jaccard_join.signature(b)])
        assert op6_jaccard_join.passes(np.array([len(a), len(b)]), np.array([i, j]), sign, np.array([0]), np.array([1]), 90)[0]


# 7: quality rules


def brute_quality(text):
    text = text or ""
    w = [x for x in re.findall(r"[^\x20\x09-\x0D]+", text)]
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, op7_quality_rules._repeat_words_exact(w)


def test_quality(spark, odd, empty):
    extra = [(200 + i, t) for i, t in enumerate(["a b c d e " * 30, "a b c d e f a b c d e", "# x | y", " ".join("abcdefgh") + " " + " ".join("abcdefgh"), "l\n" * 50])]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    found = op7_quality_rules.quality_filter(docs, measures=True).collect()
    wanted = collections.Counter((r["doc_id"], *brute_quality(r["text"])) for r in docs.collect())
    assert wanted == collections.Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in found)
    for r in found:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["kept"] and r["base_failed"]) and r["kept"] == (r["rejected_by"] is None)
    names = [r.name for r in op7_quality_rules.RULES]
    verdicts = {tuple(sorted((r["doc_id"] or -1, r["kept"]) for r in op7_quality_rules.quality_filter(docs, order).collect())) for order in (names, names[::-1])}
    assert len(verdicts) == 1
    assert sorted(op7_quality_rules.cascade_order(empty)) == sorted(names)
    assert op7_quality_rules.quality_filter(empty).count() == 0
    lean = op7_quality_rules.quality_filter(docs.withColumnRenamed("doc_id", "doc id"), names, key="doc id").collect()
    assert collections.Counter((r["doc id"], r["kept"]) for r in lean) == collections.Counter((r["doc_id"], r["kept"]) for r in found)


def test_cascade_computes_no_more_than_it_needs():
    by = {r.name: r for r in op7_quality_rules.RULES}
    few, many = op7_quality_rules.Text("only three words"), op7_quality_rules.Text(prose(30, 1))
    assert op7_quality_rules.cascade([few, many], [by["too_few_words"], by["duplicate_lines"], by["repetition"]]) == ["too_few_words", None]
    assert "n_dup_lines" not in vars(few) and few.n_repeat_words is None and "n_dup_lines" in vars(many) and many.n_repeat_words == 0


# 8: language ID


def test_forward_sums_segmentations():
    vocab = {b"a": 0, b"b": 1, b"ab": 2, b"aba": 3, b" ": 4, b" a": 5}
    probs = np.random.default_rng(2).random((6, 2))
    tree = op8_language_id.Trie(vocab)

    def total(word):
        return np.ones(2) if not word else sum((probs[vocab[word[:k]]] * total(word[k:]) for k in range(1, len(word) + 1) if word[:k] in vocab), np.zeros(2))

    some = [b" abab", b" a", b"abaab", b" bbbb"]
    order, found = op8_language_id.log_probs(some, tree, probs)
    for w, x in zip(order, found):
        assert np.exp(x) == pytest.approx(total(w))
    counts = {w: np.ones(2) for w in some}
    gathered = op8_language_id.expected_counts(counts, tree, probs)
    step = 1e-6
    for p in range(6):  # the gradient of the log likelihood by the log of a probability is the expected count
        moved = probs.copy()
        moved[p] *= 1 + step
        gain = op8_language_id.log_probs(some, tree, moved)[1].sum(0) - found.sum(0)
        assert gain / step == pytest.approx(gathered[p], rel=1e-3, abs=1e-4)


def test_long_words_sum_all_segmentations():
    tree, vocab = op8_language_id.trie(), op8_language_id.vocabulary()
    probs = np.random.default_rng(3).random((len(vocab), 2)) ** 3 + 1e-9
    probs /= probs.sum(0)
    longest = max(map(len, vocab))
    words = [b" " + ("ab漢字é" * 60).encode()[:500], b" " + b"-" * 300, b" " + prose(60, 5).replace(" ", "").encode(), b" short", b" " + b"a" * 29, b" " + b"a" * 30]

    def total(word):  # by logs, from the end
        log = np.log(probs)
        sums = [np.full(2, -np.inf) for _ in word] + [np.zeros(2)]
        for i in range(len(word) - 1, -1, -1):
            for k in range(1, min(longest, len(word) - i) + 1):
                if word[i : i + k] in vocab:
                    sums[i] = np.logaddexp(sums[i], log[vocab[word[i : i + k]]] + sums[i + k])
        return sums[0]

    for w, x in zip(*op8_language_id.log_probs(words, tree, probs)):
        assert x == pytest.approx(total(w), rel=1e-9)
    gathered = op8_language_id.expected_counts({words[0]: np.ones(2)}, tree, probs)
    piece, moved = int(gathered.sum(1).argmax()), probs.copy()
    moved[piece] *= 1 + 1e-5
    gain = op8_language_id.log_probs([words[0]], tree, moved)[1] - op8_language_id.log_probs([words[0]], tree, probs)[1]
    assert gain[0] / 1e-5 == pytest.approx(gathered[piece], rel=1e-3)


def test_language_columns_clash_and_no_labels(spark):
    rows = [(1, "kalo mipe suta", "xx", "old", 9.0), (2, "漢字" * 400, "zh", "old", 9.0), (3, "kalo rone", "xx", "old", 9.0), (4, "123", None, "old", 9.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double")
    found = {r["doc_id"]: r for r in op8_language_id.predict(docs, op8_language_id.train(docs, F.lit(True))).collect()}
    assert [found[k]["lang_pred"] for k in (1, 2, 3, 4)] == ["xx", "zh", "xx", "und"] and found[4]["score"] == 0
    bare = op8_language_id.train(docs.withColumn("lang", F.lit(None).cast("string")), F.lit(True))
    kept = op8_language_id.reject(docs, bare)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3]


def test_languages(spark, odd, empty):
    kinds = {"xx": "kalo mipe suta rone", "yy": "zgrk bwtl ptsk mnvd", "zz": "éàö üñç ßøå îêô"}
    rows = []
    for i in range(240):
        lang = sorted(kinds)[i % 3]
        r = random.Random(i)
        rows.append((i, " ".join("".join(r.choice(kinds[lang].split())) for _ in range(r.randint(1, 40))), lang if i % 11 else None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = op8_language_id.train(docs, common.crc_bucket("doc_id", 4) != 2)
    found = {r["doc_id"]: r for r in op8_language_id.predict(docs, model).collect()}
    assert all(found[i]["lang_pred"] == sorted(kinds)[i % 3] and 0 <= found[i]["score"] <= 1 for i in range(240))
    judged = op8_language_id.predict(odd.select("doc_id", "text"), model).collect()
    assert len(judged) == odd.count()
    assert all((r["lang_pred"] == "und") == (not re.search(r"[^\W\d_]", r["text"] or "")) for r in judged)
    kept = op8_language_id.reject(odd, model)
    assert kept.columns == odd.columns and kept.filter("text is null or trim(text) = ''").count() == 0
    blank = op8_language_id.train(empty, F.lit(True))
    assert {r["lang_pred"] for r in op8_language_id.predict(odd.select("doc_id", "text"), blank).collect()} == {"und"}
    assert op8_language_id.predict(empty.select("doc_id", "text"), model).count() == 0


# 9: token counts


def test_token_counts(spark, odd, empty, tokenizer):
    found = collections.Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in op9_token_counts.token_counts(odd).collect())
    n = lambda t: len(tokenizer.encode(t or "", add_special_tokens=False).ids)
    assert found == collections.Counter((r["doc_id"], len((r["text"] or "").encode()), n(r["text"]), n(r["text"]) > 512) for r in odd.collect())
    assert op9_token_counts.token_counts(empty).count() == 0


def test_transducer_agrees(tokenizer):
    import public_tokenizers

    texts = strings(500)
    wanted = [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert op9_token_counts.count_batch(texts, path) == wanted
    vocab, ranks, special = op9_token_counts.load(path)
    small = op9_token_counts.Transducer(vocab, ranks, max_states=500)
    plain = [(t, w) for t, w in zip(texts, wanted) if not any(s in t for s in special)]
    got = [int(x) for i in range(0, len(plain), 20) for x in op9_token_counts.count_tokens([t for t, _ in plain[i : i + 20]], small)]
    assert got == [w for _, w in plain]


# 10: language model


def test_language_model(spark, odd, empty):
    rows = [(i, " ".join(random.Random(i).choice((VOCAB[:40], VOCAB[200:240])[i % 2]) for _ in range(60))) for i in range(400)]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(i + 100, t) for i, t in rows], "doc_id long, text string"))
    held = common.crc_bucket("doc_id", 7) == 2
    found = op10_maxent_lm.score_all(docs, ~held).collect()
    everything = [(r["doc_id"], words(r["text"]) + [b""]) for r in docs.collect()]
    c = collections.Counter(w for k, t in everything if common.py_crc_bucket(k, 7) != 2 for w in t)
    total, kinds = sum(c.values()), len(c)
    wanted = sorted(((k, len(t), sum(c[w] > 0 for w in t), total, round(sum(math.log10((c[w] + 1) / (total + kinds + 1)) for w in t), 6)) for k, t in everything), key=str)
    assert sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in found), key=str) == wanted
    own = [r for r in found if r["doc_id"] is not None and r["doc_id"] >= 100 and common.py_crc_bucket(r["doc_id"], 7) == 2]
    assert sum(r["score"] for r in own) > sum(r["base_score"] for r in own) * 0.98
    none = op10_maxent_lm.score_all(odd, F.lit(False)).collect()
    assert len(none) == odd.count() and all(r["n_known"] == 0 and math.isfinite(r["score"]) for r in none)
    assert op10_maxent_lm.score_all(empty, F.lit(True)).count() == 0


def test_score_is_a_normalised_product(spark):
    rows = [(i, " ".join(random.Random(i).choice((VOCAB[:40], VOCAB[200:300])[i % 2]) for _ in range(50))) for i in range(120)] + [(200, "x" * 300 + " new é " + "y" * 65)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model, counts = op10_maxent_lm.train(docs.filter("doc_id <> 200").select("text"))
    found = {r["doc_id"]: r["score"] for r in op10_maxent_lm.score(docs, model, counts).collect()}
    c = collections.Counter(w for k, t in rows if k != 200 for w in words(t) + [b""])
    other = [w for w in c if w not in model.leaves]
    n = [sum(c[w] for w in other if model.class_of(w) == k) for k in range(op10_maxent_lm.CLASSES)]
    v = [sum(model.class_of(w) == k for w in other) for k in range(op10_maxent_lm.CLASSES)]
    bits = len(model.weights).bit_length() - 1
    for key in (0, 1, 5, 200):
        tokens = op10_maxent_lm.tokens_of(dict(rows)[key])
        numbers = np.array([zlib.crc32(w) << 8 | model.class_of(w) for w in tokens], np.uint64)
        outer, inner = op10_maxent_lm.features(numbers, np.arange(len(tokens)), bits)
        total = 0.0
        for i, w in enumerate(tokens):
            k, leaf = model.class_of(w), model.leaves.get(w, 0)
            for table, at, pick, prior in ((model.weights, outer[i], k, model.class_prior), (model.inner, inner[i], leaf, model.leaf_prior[k])):
                scores = prior + sum(table[j].astype(float) for j in at)
                total += scores[pick] - math.log(np.exp(scores).sum())
            total += 0 if leaf else math.log((c[w] + 1) / (n[k] + v[k] + 1))
        assert found[key] == pytest.approx(total / math.log(10), rel=1e-5)
    for k in range(op10_maxent_lm.CLASSES):  # what the leaf of other words gives its words, and one more for all new ones, is 1
        assert sum((c[w] + 1) / (n[k] + v[k] + 1) for w in other if model.class_of(w) == k) + 1 / (n[k] + v[k] + 1) == pytest.approx(1)
    assert model.leaves and all(len(w) <= 64 for w in model.hot)


def test_neighbours_are_counted_over_all_texts(spark):
    docs = spark.createDataFrame([(prose(30, i),) for i in range(60)], "text string").repartition(7)
    counts = op10_maxent_lm.neighbour_counts(docs, [w.encode() for w in VOCAB[:30]], "text")
    wanted = np.zeros_like(counts)
    for i in range(60):
        t = prose(30, i).split()
        for a in range(len(t)):
            for gap in (1, 2):
                if a >= gap and t[a] in VOCAB[:30] and t[a - gap] in VOCAB[:30]:
                    wanted[VOCAB.index(t[a]), VOCAB.index(t[a - gap])] += 1
                    wanted[VOCAB.index(t[a - gap]), 30 + VOCAB.index(t[a])] += 1
    assert (counts == wanted).all()


def test_rare_tokens_take_the_join(spark, monkeypatch):
    docs = spark.createDataFrame([(i, prose(80, i)) for i in range(40)], "doc_id long, text string")
    whole = {r["doc_id"]: r["base_score"] for r in op10_maxent_lm.score_all(docs, F.lit(True)).collect()}
    monkeypatch.setattr(op10_maxent_lm, "HOT_TOKENS", 30)
    few = {r["doc_id"]: r["base_score"] for r in op10_maxent_lm.score_all(docs, F.lit(True)).collect()}
    assert few == pytest.approx(whole)


@pytest.mark.parametrize("hot", [0, 12])
def test_a_bin_larger_than_what_is_broadcast_still_trains(spark, monkeypatch, hot):
    rows = [(i, " ".join(random.Random(i).choice((VOCAB[:40], VOCAB[200:240])[i % 2]) for _ in range(60)) + " " + "y" * (60 + i % 9)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {r["doc_id"]: (r["n_known"], r["base_score"]) for r in op10_maxent_lm.score_all(docs, F.lit(True)).collect()}
    monkeypatch.setattr(op10_maxent_lm, "HOT_TOKENS", hot)
    monkeypatch.setattr(op10_maxent_lm, "step_of", lambda n="n": F.lit(3))  # all tokens are in one bin
    model, counts = op10_maxent_lm.train(docs)
    assert model.weights.any() and len(model.hot) < 20 and bool(model.hot) == bool(hot)
    found = op10_maxent_lm.score(docs, model, counts).collect()
    assert {r["doc_id"]: r["n_known"] for r in found} == {k: v[0] for k, v in whole.items()}
    assert {r["doc_id"]: r["base_score"] for r in found} == pytest.approx({k: v[1] for k, v in whole.items()})
    assert sum(r["score"] for r in found) > sum(r["base_score"] for r in found)


def test_gradient_raises_the_likelihood():
    r = np.random.default_rng(3)
    rows = r.integers(0, 50, (4000, 4)).astype(np.int32)
    classes = rows[:, 0].astype(np.int64) % op10_maxent_lm.CLASSES
    w = np.zeros((1 << op10_maxent_lm.BITS, op10_maxent_lm.CLASSES), np.float32)
    before = op10_maxent_lm.log_softmax(op10_maxent_lm.class_scores(w, rows, np.zeros(16)))[np.arange(4000), classes].mean()
    squares, uses = np.ones_like(w), np.zeros(len(w), np.int64)
    for _ in range(20):
        op10_maxent_lm.gradient_pass(w, squares, uses, rows, classes, np.zeros(16, np.float32))
    assert op10_maxent_lm.log_softmax(op10_maxent_lm.class_scores(w, rows, np.zeros(16)))[np.arange(4000), classes].mean() > before * 0.6


@pytest.mark.parametrize("widen", [1, 2, 40])
def test_long_pieces_compose(monkeypatch, tokenizer, widen):
    monkeypatch.setattr(op9_token_counts, "WIDEN", widen)
    import public_tokenizers

    r = random.Random(3)
    texts = ["".join(r.choice("etaoinshrdlu") for _ in range(5000)), "a" * 3001, "thetionment" * 300, prose(700, 3).replace(" ", ""), "".join(chr(r.randint(0x4E00, 0x9000)) for _ in range(900)), "-=" * 700 + " x", "é" * 999]
    texts += ["".join(r.choice("abxyz漢-") for _ in range(r.randint(100, 900))) + r.choice(["", " tail"]) for _ in range(40)]
    wanted = [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert op9_token_counts.count_batch(texts, public_tokenizers.path("byte_bpe_50k.json")) == wanted


def test_composed_prefixes():
    r = np.random.default_rng(4)
    sizes = np.array([1, 7, 2, 16, 5])
    lanes = np.concatenate([np.arange(k) for k in sizes])
    nexts, gains = r.integers(-1, 3, (len(lanes), 3)), r.integers(0, 9, (len(lanes), 3))
    found, total = op9_token_counts.composed(nexts, gains, lanes)
    for h in range(len(lanes)):
        for c in range(3):
            at, n = c, 0
            for k in range(h - lanes[h], h + 1):
                n, at = (n + gains[k, at], nexts[k, at]) if at >= 0 else (n, -1)
            assert found[h, c] == at and (at < 0 or total[h, c] == n)
