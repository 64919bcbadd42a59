"""Contradictions against comparing all pairs of clauses one by one."""

import random
import re

from granary.operators import conflicts

W = conflicts.Words()


def rule(a, b):
    level = lambda t: next((n for w, n in W.levels if w in t), 0)
    numbers = lambda t: [float(x) for x in re.findall(r"[0-9][0-9.]*", t) if x.count(".") < 2 and float(x) > 0]
    if any(w in a for w in W.thresholds) and any(w in b for w in W.rewards):
        return "upgrade_level" if level(a) and level(b) and level(a) > level(b) else "upgrade"
    if any((n in x and p in y and n not in y) for n, p in W.pairs for x, y in ((a, b), (b, a))):
        return "logic"
    if any(w in a and w in b for w in W.subjects) and any(abs(x - y) > 1 and max(x / y, y / x) < 100 for x in numbers(a) for y in numbers(b)):
        return "data"
    return "dangling" if any(w in a and w not in b for w in W.references) else None


def test_all_pairs(spark):
    parts = ["资格", "评分", "二级", "一级", "不接受联合体", "联合体", "保证金", "预算", "5", "5.5", "80", "900", "90000", "详见", "参见", "其他", "1.2.3"]
    for seed, most, block in ((1, 10, 64), (2, 3, 2), (3, 2, 5)):
        r = random.Random(seed)
        rows = [(i % 3 and 1, i, " ".join(r.sample(parts, r.randint(0, 4)))) for i in range(90)] + [(1, 500, None), (2, 0, "详见"), (2, 1, "")]
        wanted = set()
        for d, a, t in rows:
            mine = [(b, rule(t, u)) for e, b, u in sorted(rows, key=lambda x: x[1]) if e == d and b != a and t is not None and u is not None and rule(t, u)]
            wanted |= {(d, a, b, k) for b, k in mine[:most]}
        found = conflicts.contradictions(spark.createDataFrame(rows, "doc long, key long, text string").repartition(3), "doc", "key", "text", most=most, block=block)
        assert {tuple(x) for x in found.collect()} == wanted
    assert conflicts.contradictions(spark.createDataFrame([], "doc long, key long, text string"), "doc", "key", "text").collect() == []
