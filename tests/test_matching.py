"""Matching against choosing one after the other."""

import random

from granary.operators import matching
from granary.operators.dedup import quotation_similarity


def test_rounds_choose_one_after_the_other(spark):
    for seed in range(4):
        r = random.Random(seed)
        edges = [(g, f, r.choice([0.5, 0.6, 0.7, 1.0])) for g in range(25) for f in range(20) if r.random() < 0.25]
        left, wanted = {f for _, f, _ in edges}, set()
        for g in sorted({e[0] for e in edges}):
            mine = [(-s, f) for x, f, s in edges if x == g and f in left]
            if mine:
                s, f = min(mine)
                left.discard(f)
                wanted.add((g, f, -s))
        found = matching.settle(spark.createDataFrame(edges, "gold long, found long, score double"))
        assert {tuple(x) for x in found.collect()} == wanted
    assert matching.settle(spark.createDataFrame([], "gold long, found long, score double")).collect() == []


def test_texts(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    gold = [(i, " ".join(r.choice(words) for _ in range(r.randint(5, 30)))) for i in range(20)] + [(50, None), (51, ""), (52, "one two")]
    found = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 400))) + " " + gold[r.randrange(20)][1] + (" and more" if i % 2 else "")) for i in range(30)] + [(90, None), (91, "One two")]

    def runs(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    left, wanted = dict(found), {}
    for g, t in gold:
        best = min(((-quotation_similarity(t, u), f) for f, u in left.items() if runs(t) & runs(u)), default=(0, None))
        if -best[0] >= 0.5:
            wanted[g] = best[1]
            del left[best[1]]
    rows = matching.match_texts(spark.createDataFrame(gold, "gold long, gold_text string"), spark.createDataFrame(found, "found long, found_text string"), 0.5).collect()
    assert {x["gold"]: x["found"] for x in rows} == wanted and len(rows) == len(wanted) > 10


def test_findings(spark):
    gold = [(1, 7, 1, "deposit must be paid in full", "A1_GUAR", "deposit", "high", ["guarantee"]), (2, 7, 1, "deposit must be paid in part", "A1_GUAR", "deposit", "low", []), (3, 8, 1, "deposit must be paid in full", "A1_GUAR", "deposit", "high", None)]
    found = [(1, 7, 1, "deposit must be paid in full", "x", "guarantee terms", "low"), (2, 7, 9, "deposit must be paid in full", "A1_GUAR", "", "high"), (3, 7, 1, "deposit must be paid in full", "B2", "else", "high"), (4, 8, 1, "nothing of the kind", "A1_GUAR", "", "high")]
    rows = matching.match_findings(
        spark.createDataFrame(gold, "gold long, doc long, page int, gold_text string, gold_code string, gold_type string, gold_severity string, aliases array<string>"),
        spark.createDataFrame(found, "found long, doc long, page int, found_text string, code string, kind string, severity string"),
    ).collect()
    # 1 takes prediction 2, as similar as 1 and of its severity; what is left is of no other labelled row's type.
    assert {(x["gold"], x["found"]) for x in rows} == {(1, 2)}
