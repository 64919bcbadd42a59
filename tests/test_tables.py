"""Tables put into the bodies of sections, against a walk of the tree."""

import random

from granary.operators import structure


def walked(sections, tables):
    children, done, bodies = {}, set(), {}
    for s in sections:
        children.setdefault(s["parent"], []).append(s)

    def visit(nodes):
        for s in nodes:
            below = sorted(children.get(s["sec"], []), key=lambda c: c["body_first"] or 0)
            visit(below)
            taken = []
            spans = [(s["body_first"], s["body_last"])] if s["body_first"] is not None else []
            if below and not s["body"]:
                spans.append((s["first"], s["last"]))
            for low, high in spans:
                for t in sorted(tables, key=lambda t: (t["page"], t["idx"])):
                    if low <= t["page"] <= high and t["table"] not in done and t["rows"]:
                        done.add(t["table"])
                        taken.append(t)
            drawn = ["\n".join(["| " + " | ".join(r) + " |" for r in t["rows"][:1]] + ["| " + " | ".join("---" for _ in t["rows"][0]) + " |"] + ["| " + " | ".join(r) + " |" for r in t["rows"][1:]]) for t in taken]
            bodies[s["sec"]] = ("\n\n".join([s["body"]] * bool(s["body"]) + drawn), [t["table"] for t in taken])

    visit(children.get(None, []))
    return bodies


def test_tables_go_to_the_first_visitor(spark):
    for seed in range(5):
        r = random.Random(seed)
        sections, level = [], {}
        for i in range(25):
            parent = r.choice([None, *[s["sec"] for s in sections if level[s["sec"]] < 4]])
            level[i] = 1 if parent is None else level[parent] + 1
            body = r.choice(["", "text"])
            low = r.randint(0, 12)
            sections.append({"doc_id": 1, "sec": i, "parent": parent, "body_first": low if body else None, "body_last": low + r.randint(0, 2) if body else None, "first": low, "last": low + r.randint(0, 5), "body": body})
        tables = [{"doc_id": 1, "table": f"t{k}", "page": r.randint(0, 15), "idx": k, "rows": [["a", str(k)]] * r.randint(0, 3)} for k in range(20)]
        found = structure.with_tables(
            spark.createDataFrame(sections, "doc_id long, sec int, parent int, body_first int, body_last int, first int, last int, body string"),
            spark.createDataFrame(tables, "doc_id long, table string, page int, idx int, rows array<array<string>>"),
        )
        assert {x["sec"]: (x["body"], x["tables"]) for x in found.collect()} == walked(sections, tables)
