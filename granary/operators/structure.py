"""Document structure: words to blocks, lines to sections, sections to size-bounded chunks.

Candidates, parents and bodies are expressions and windows; only what depends on running state (blocks of words, merging and
splitting of chunks) runs in Python, one document (or page) at a time, because documents are the unit of order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.operators import ordered


@dataclass(frozen=True)
class Limits:
    """Sizes in characters, pages for the gap."""

    merge_below: int = 120
    split_above: int = 1500
    overlap: int = 200
    tiny_below: int = 50
    page_gap: int = 2


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ord, line) of the non-blank lines without page furniture."""
    rows = docs.select(key, F.posexplode(F.split(text, "\n")).alias("ord", "line"))
    return rows.select(key, "ord", F.trim("line").alias("line")).filter((F.col("line") != "") & ~T.page_noise(F.col("line")))


def sections(rows: DataFrame, key: str = "doc_id", levels: int = 6) -> DataFrame:
    """(key, ord, line, pattern, level, parent, body) of the headings among lines; text before the first heading is a
    section of level 0 without a title."""
    w = Window.partitionBy(key).orderBy("ord")
    marked = rows.withColumn("h", T.heading(F.col("line")))
    marked = marked.withColumn("own", F.coalesce(F.last(F.when(F.col("h").isNotNull(), F.col("ord")), ignorenulls=True).over(w), F.lit(-1)))
    parts = marked.groupBy(key, "own").agg(
        F.max(F.when(F.col("h").isNotNull(), F.struct("line", "h"))).alias("head"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("h").isNull(), F.struct("ord", "line")))), lambda x: x["line"]), "\n").alias("body"),
    )
    flat = parts.select(key, F.col("own").alias("ord"), F.coalesce("head.line", F.lit("")).alias("title"), F.col("head.h.pattern").alias("pattern"), F.coalesce("head.h.level", F.lit(0)).alias("level"), "body")
    return ordered.parent(flat, [key], "ord", "level", levels)


def paths(found: DataFrame, key: str = "doc_id", depth: int = 6) -> DataFrame:
    """Sections with the titles of their ancestors and themselves, by at most `depth` joins on (document, parent)."""
    up = found.select(F.col(key).alias("__k"), F.col("ord").alias("__o"), F.col("parent").alias("__p"), F.col("title").alias("__t"))
    rows = found.withColumn("path", F.array("title")).withColumn("__at", F.col("parent"))
    for _ in range(depth):
        rows = rows.join(up, (F.col(key) == F.col("__k")) & (F.col("__at") == F.col("__o")), "left")
        rows = rows.withColumn("path", F.when(F.col("__t").isNotNull() & (F.col("__t") != ""), F.concat(F.array("__t"), "path")).otherwise(F.col("path"))).withColumn("__at", F.col("__p")).drop("__k", "__o", "__p", "__t")
    return rows.drop("__at").withColumn("path", F.filter("path", lambda t: t != ""))


def section_statistics(found: DataFrame, level: str = "level", orphan: Column | None = None) -> DataFrame:
    """One row: sections, how many of each level, and orphans if a condition says which these are."""
    per = found.groupBy(level).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.lit(False) if orphan is None else orphan).alias("o"))
    levels = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col(level).isNotNull(), F.struct(level, "n")))))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), levels.alias("levels"), F.coalesce(F.sum("o"), F.lit(0)).alias("orphans"))


def pipe_tables(blocks: DataFrame, keys: list[str], order: str, text: str, kind: str | None = None, mark: str = "|", known: DataFrame | None = None) -> DataFrame:
    """(keys, table, first, last, rows): runs of two or more adjacent paragraphs of one number of cells, at least two, as
    tables with trimmed cells; empty cells are null. `keys` are a page; `known` (keys, tables) says how many tables it has,
    and new ones are numbered after those. A page's blocks are one window."""
    cells = F.transform(F.split(text, T.quote(mark), -1), lambda x: F.when(F.trim(x) != "", F.trim(x)))
    paragraph = F.lit(True) if kind is None else F.col(kind) == "paragraph"
    shaped = blocks.select(*keys, F.col(order).alias("o"), F.when(paragraph, cells).alias("c")).withColumn("n", F.when(F.size("c") >= 2, F.size("c")))
    w = Window.partitionBy(*keys).orderBy("o")
    changed = F.when(F.lag("n").over(w).eqNullSafe(F.col("n")), 0).otherwise(1)
    runs = shaped.withColumn("new", changed).withColumn("run", F.sum("new").over(w)).filter("n is not null")
    found = runs.groupBy(*keys, "run").agg(F.array_sort(F.collect_list(F.struct("o", "c"))).alias("rows")).filter(F.size("rows") >= 2)
    found = found.select(*keys, "run", F.col("rows")[0]["o"].alias("first"), F.element_at("rows", -1)["o"].alias("last"), F.transform("rows", lambda x: x["c"]).alias("rows"))
    found = found.withColumn("table", F.row_number().over(Window.partitionBy(*keys).orderBy("run")) - 1)
    if known is not None:
        found = found.join(known.select(*keys, F.col("tables").alias("before")), keys, "left").withColumn("table", F.col("table") + F.coalesce("before", F.lit(0))).drop("before")
    return found.select(*keys, "table", "first", "last", "rows")


def numbering_breaks(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Headings of one pattern whose numbering doesn't rise over the one before."""
    numbered = found.withColumn("numbers", T.numbering(F.col("title"))).filter(F.size("numbers") > 0)
    before = F.lag("numbers").over(Window.partitionBy(key, "pattern").orderBy("ord"))
    return numbered.withColumn("before", before).filter(F.col("before") >= F.col("numbers"))


def pseudo_headings(found: DataFrame, key: str = "doc_id", least: int = 3, share: float = 0.7) -> DataFrame:
    """Runs of bracketed headings before the first heading of level 1 that mostly end as sentences: lists, not headings."""
    w = Window.partitionBy(key).orderBy("ord")
    early = F.coalesce(F.max(F.when(F.col("level") == 1, 1)).over(w), F.lit(0)) == 0
    bracket = F.col("title").rlike("^[(（]")
    run = F.sum(F.when(bracket, 0).otherwise(1)).over(w)
    rows = found.withColumn("__run", run).withColumn("__early", early).filter(F.col("__early") & bracket).drop("__early")
    group = Window.partitionBy(key, "__run")
    ends = F.avg(F.when(F.col("title").rlike("[。；;]$"), 1.0).otherwise(0.0)).over(group)
    return rows.withColumn("__n", F.count(F.lit(1)).over(group)).withColumn("__e", ends).filter((F.col("__n") >= least) & (F.col("__e") >= share)).drop("__run", "__n", "__e")


def contents_pages(rows: DataFrame, keys: list[str], level: str, least: int = 3) -> DataFrame:
    """Pages with at least `least` headings of level 1 and no plain line: tables of contents."""
    return rows.groupBy(*keys).agg(F.count_if(F.col(level) == 1).alias("heads"), F.count_if(F.col(level).isNull()).alias("plain")).filter((F.col("heads") >= least) & (F.col("plain") == 0))


def stitched_tables(tables: DataFrame, key: str, page: str, rows: str) -> DataFrame:
    """Tables that go on over page ends: the last table of a page and the first of the next are one when they are as wide
    and don't begin with the same cell. Rows have (key, page, idx, rows)."""
    w = Window.partitionBy(key).orderBy(page, "idx")
    per_page = Window.partitionBy(key, page)
    width = F.size(F.element_at(rows, 1))
    first = F.element_at(F.element_at(rows, 1), 1)
    known = tables.withColumn("__w", width).withColumn("__f", first).withColumn("__top", F.min("idx").over(per_page) == F.col("idx")).withColumn("__end", F.max("idx").over(per_page) == F.col("idx"))
    joined = F.lag("__end").over(w) & F.col("__top") & (F.lag(page).over(w) + 1 == F.col(page)) & (F.lag("__w").over(w) == F.col("__w")) & ~F.lag("__f").over(w).eqNullSafe(F.col("__f"))
    chained = known.withColumn("table", F.sum(F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1)).over(w))
    return chained.groupBy(key, "table").agg(F.min(page).alias("first_page"), F.max(page).alias("last_page"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(page, "idx", rows))), lambda x: x[rows])).alias("rows"))


def blocks(words: DataFrame, key: str = "doc_id", page: str = "page") -> DataFrame:
    """Words with boxes (key, page, word_idx, text, x0, top, x1, bottom) to blocks: words of nearly one height are a row, rows
    with a small gap a block, single rows of few words headings."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("word_idx")
        height = float((rows.bottom - rows.top).median())
        found: list[list] = []
        for w in rows.itertuples():
            if not found or abs(w.top - found[-1][0].top) >= 1.2 * height:
                found.append([])
            found[-1].append(w)
        parts: list[list[list]] = []
        for row in found:
            if not parts or row[0].top - parts[-1][-1][0].bottom > 1.8 * height:
                parts.append([])
            parts[-1].append(row)
        made = [(rows[key].iloc[0], int(rows[page].iloc[0]), i, "heading" if len(p) == 1 and len(p[0]) <= 10 else "paragraph", "\n".join(" ".join(w.text for w in r) for r in p), min(w.x0 for r in p for w in r), min(w.top for r in p for w in r), max(w.x1 for r in p for w in r), max(w.bottom for r in p for w in r)) for i, p in enumerate(parts)]
        return pd.DataFrame(made, columns=[key, page, "block_idx", "type", "text", "x0", "top", "x1", "bottom"])

    kind = words.schema[key].dataType.simpleString()
    return words.groupBy(key, page).applyInPandas(build, f"{key} {kind}, {page} int, block_idx int, type string, text string, x0 double, top double, x1 double, bottom double")


def row_text(words: list[tuple[float, float, str]], gap: float = 8.0) -> str:
    """Words (x0, x1, text) of a row as text; a gap of over `gap` mean character widths is a tab."""
    widths = [(b - a) / max(1, len(t)) for a, b, t in words]
    wide = gap * sum(widths) / max(1, len(widths))
    return "".join(("" if i == 0 else "\t" if a - words[i - 1][1] > wide else " ") + t for i, (a, _, t) in enumerate(words))


def join_lines(found: list[str]) -> str:
    """Lines run together, with a break before numbers, brackets and marks and after the end of a sentence."""
    text = ""
    for line in found:
        fresh = bool(re.match(r"[0-9(（▲★●■◆]", line.strip())) or text.rstrip().endswith(("。", "！", "？"))
        text += ("\n" if text and line.strip() and fresh else "") + line
    return text


_BREAK = re.compile(r"\n(?=\n|[一二三四五六七八九十])")
#: Where the overlap of two parts may begin, the best kinds first.
_RESTARTS = [re.compile(r"(?<=[。！？])\n\n?"), re.compile(r"\n\n"), re.compile(r"\n(?=[一二三四五六七八九十（(0-9])"), re.compile(r"\n")]


def restart(text: str, cut: int, overlap: int) -> int:
    """Where the part after a cut begins: at the first sentence, paragraph, number or line in the overlap, else at its start."""
    low = max(0, cut - overlap)
    for kind in _RESTARTS:
        m = kind.search(text, low, cut)
        if m and m.end() < cut:
            return m.end()
    return low


def split_text(text: str, limits: Limits = Limits()) -> list[str]:
    """Parts of at most `split_above` characters, cut at paragraph ends where there are any, with an overlap."""
    if len(text) <= limits.split_above:
        return [text]
    ends = [m.end() for m in _BREAK.finditer(text)]
    parts, at = [], 0
    while len(text) - at > limits.split_above:
        most = at + limits.split_above
        cut = max((e for e in ends if at < e <= most), default=most)
        parts.append(text[at:cut])
        following = restart(text, cut, limits.overlap)
        if following <= cut - limits.overlap // 2:
            following = cut - limits.overlap
        at = following if following > at else cut
    return [*parts, text[at:]]


@dataclass
class Chunk:
    path: list[str]
    text: str
    first: int
    last: int
    kind: str = "leaf"
    rule: str | None = None
    count: int | None = None
    part: int | None = None
    total: int | None = None
    blocks: list[str] = field(default_factory=list)


def as_chunks(whole: Chunk, limits: Limits) -> Iterator[Chunk]:
    parts = split_text(whole.text, limits)
    if len(parts) == 1:
        yield whole
    else:
        for i, p in enumerate(parts, 1):
            yield replace(whole, text=p, kind="split", part=i, total=len(parts))


def united(group: list[Chunk], rule: str) -> Chunk:
    return Chunk(group[0].path[:-1] or group[0].path, "\n\n".join(c.text for c in group), min(c.first for c in group), max(c.last for c in group), "merged", rule, len(group), blocks=list(dict.fromkeys(b for c in group for b in c.blocks)))


def merged_leaves(leaves: list[Chunk], limits: Limits) -> Iterator[Chunk]:
    """Short neighbours under one parent become one chunk, until it is long or the pages lie apart."""
    held: list[Chunk] = []

    def flush() -> Iterator[Chunk]:
        if held:
            yield from as_chunks(held[0] if len(held) == 1 else united(held, "adjacent"), limits)
        held.clear()

    for leaf in leaves:
        short = len(leaf.text) < limits.merge_below
        if not short or (held and leaf.first - max(c.last for c in held) > limits.page_gap):
            yield from flush()
        if not short:
            yield from as_chunks(leaf, limits)
            continue
        held.append(leaf)
        if sum(len(c.text) for c in held) > limits.split_above:
            yield from flush()
    yield from flush()


def absorb_tiny(chunks: list[Chunk], limits: Limits) -> list[Chunk]:
    """Chunks too small to stand alone join the one before under the same parent, else the one after."""

    def take(into: Chunk, tiny: Chunk, before: bool, reach: int) -> Chunk:
        pages = (min(into.first, tiny.first), max(into.last, tiny.last)) if reach <= limits.page_gap else (into.first, into.last)
        text = f"{tiny.text}\n\n{into.text}" if before else f"{into.text}\n\n{tiny.text}"
        return replace(into, text=text, first=pages[0], last=pages[1], kind="merged", rule="tiny", count=(into.count or 1) + 1 if into.kind == "merged" else 2, part=None, total=None, blocks=list(dict.fromkeys(into.blocks + tiny.blocks)))

    kept: list[Chunk] = []
    anchor = 0
    for c in chunks:
        if kept and len(c.text) < limits.tiny_below and kept[-1].path[:-1] == c.path[:-1]:
            kept[-1] = take(kept[-1], c, False, c.first - anchor)
        else:
            kept.append(c)
            anchor = c.last
    done: list[Chunk] = []
    for c in reversed(kept):
        if done and len(c.text) < limits.tiny_below and done[-1].path[:-1] == c.path[:-1]:
            done[-1] = take(done[-1], c, True, done[-1].first - c.last)
        else:
            done.append(c)
    return done[::-1]


CHUNK_SCHEMA = "chunk_id:string,kind:string,rule:string,child_count:int,part:int,total:int,path:array<string>,text:string,page_start:int,page_end:int,blocks:array<string>"


def chunk_document(found: list[dict], limits: Limits = Limits()) -> list[Chunk]:
    """Chunks of one document's sections (ord, parent, title, body, page_start, page_end, blocks), in order."""
    up = {r["ord"]: (r["title"], r["parent"]) for r in found}
    parents = {p for _, p in up.values() if p is not None}
    made: list[Chunk] = []

    def path(at: int | None) -> list[str]:
        titles: list[str] = []
        while at is not None and at in up:
            title, at = up[at]
            titles += [title] if title else []
        return titles[::-1]

    for (_, holds_others), group in groupby(found, key=lambda r: (r["parent"], r["ord"] in parents)):
        leaves = []
        for r in group:
            text = "\n".join(x for x in (r["title"], r["body"]) if x)
            if text.strip():
                leaves.append(Chunk(path(r["ord"]) or [""], text, r["page_start"], r["page_end"], blocks=list(r["blocks"])))
        if holds_others:
            made += [part for c in leaves if "\n" in c.text for part in as_chunks(c, limits)]
        else:
            made += merged_leaves(leaves, limits)
    made.sort(key=lambda c: c.first)
    seen, kept = set(), []
    for c in absorb_tiny(made, limits):
        if len(c.text) < 20 or c.text not in seen:
            seen.add(c.text)
            kept.append(c)
    return kept


def chunks(found: DataFrame, key: str = "doc_id", limits: Limits = Limits()) -> DataFrame:
    """Chunks of all documents' sections; pages and blocks default to the section's order.

    A document's sections become one row, so batches of documents go to Python and no group is a call of its own."""
    for name, value in (("page_start", F.col("ord").cast("int")), ("page_end", F.col("ord").cast("int")), ("blocks", F.array(F.concat(F.lit("b_"), F.col("ord").cast("string"))))):
        if name not in found.columns:
            found = found.withColumn(name, value)
    kind = found.schema[key].dataType.simpleString()
    rows = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", "parent", "title", "body", "page_start", "page_end", "blocks"))).alias("sections"))
    made = pa.struct([("chunk_id", pa.string()), ("kind", pa.string()), ("rule", pa.string()), ("child_count", pa.int32()), ("part", pa.int32()), ("total", pa.int32()), ("path", pa.list_(pa.string())), ("text", pa.string()), ("page_start", pa.int32()), ("page_end", pa.int32()), ("blocks", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                lists = [[{"chunk_id": f"ch_{i:03d}", "kind": c.kind, "rule": c.rule, "child_count": c.count, "part": c.part, "total": c.total, "path": c.path, "text": c.text, "page_start": c.first, "page_end": c.last, "blocks": c.blocks} for i, c in enumerate(chunk_document(s, limits))] for s in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lists, pa.list_(made))], names=[key, "chunks"])

    return rows.mapInArrow(run, f"{key} {kind}, chunks array<struct<{CHUNK_SCHEMA}>>").select(key, F.explode("chunks").alias("c")).select(key, "c.*")


def fixed_chunks(rows: DataFrame, key: str = "doc_id", size: int = 1500) -> DataFrame:
    """Runs of lines of about `size` characters, by a running sum: the chunks of texts without headings."""
    w = Window.partitionBy(key).orderBy("ord")
    place = F.floor((F.sum(F.char_length("line")).over(w) - F.char_length("line")) / size).cast("int")
    grouped = rows.withColumn("chunk", place).groupBy(key, "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n").alias("text"), F.min("ord").alias("first"), F.max("ord").alias("last"))
    return grouped


def visit_order(found: DataFrame, key: str, depth: int = 6) -> DataFrame:
    """`found` (key, sec, parent, body_first, ...) with `visit`, an array whose order is that of a walk that visits a section after
    its subsections, these by the first page of their bodies: the places of its ancestors and its own, then a place behind all.
    Roots are visited by `sec`. Trees have at most `depth` levels."""
    place = F.struct(F.when(F.col("parent").isNull(), F.lit(0)).otherwise(F.coalesce("body_first", F.lit(0))).cast("long").alias("page"), F.col("sec").cast("long").alias("sec"))
    up = found.select(F.col(key).alias("__k"), F.col("sec").alias("__s"), F.col("parent").alias("__p"), place.alias("__o"))
    rows = found.withColumn("visit", F.array(place, F.struct(F.lit(1 << 62).cast("long").alias("page"), F.lit(0).cast("long").alias("sec")))).withColumn("__at", F.col("parent"))
    for _ in range(depth - 1):
        rows = rows.join(up, (F.col(key) == F.col("__k")) & (F.col("__at") == F.col("__s")), "left")
        rows = rows.withColumn("visit", F.when(F.col("__o").isNotNull(), F.concat(F.array("__o"), "visit")).otherwise(F.col("visit"))).withColumn("__at", F.col("__p")).drop("__k", "__s", "__p", "__o")
    return rows.drop("__at")


def with_tables(found: DataFrame, tables: DataFrame, key: str = "doc_id", depth: int = 6) -> DataFrame:
    """(key, sec, body, tables): sections with the tables that they hold put behind their bodies as pipe tables.

    found: key, sec, parent, body_first, body_last (null without a body), first, last, body; tables: key, table, page, idx, rows. A table
    goes to the first section of the walk (see `visit_order`) whose body is on its page, or that has subsections, no body and the
    page among its own. Tables without rows go nowhere. Pages are the join's key; only pages with tables are joined."""
    order = visit_order(found, key, depth)
    inner = found.filter("parent IS NOT NULL").select(key, F.col("parent").alias("sec")).distinct().withColumn("__inner", F.lit(True))
    spans = F.array(
        F.when(F.col("body_first").isNotNull(), F.struct(F.lit(0).alias("stage"), F.col("body_first").alias("low"), F.col("body_last").alias("high"))),
        F.when(F.col("__inner") & (F.coalesce("body", F.lit("")) == ""), F.struct(F.lit(1).alias("stage"), F.col("first").alias("low"), F.col("last").alias("high"))),
    )
    held = order.join(inner, [key, "sec"], "left").select(key, "sec", "visit", F.explode_outer(F.filter(spans, lambda s: s.isNotNull() & (s["low"] <= s["high"]))).alias("s")).filter("s IS NOT NULL")
    paged = held.select(key, "sec", "visit", "s.stage", F.explode(F.sequence("s.low", "s.high")).alias("page"))
    drawn = tables.withColumn("__t", T.markdown_table(F.col("rows"))).filter("__t IS NOT NULL").drop("rows")
    owners = drawn.select(key, "table", "page").join(paged, [key, "page"]).groupBy(key, "table").agg(F.min(F.struct("visit", "stage", "sec")).alias("o")).select(key, "table", "o.sec", "o.stage")
    parts = drawn.join(owners, [key, "table"]).groupBy(key, "sec").agg(F.array_sort(F.collect_list(F.struct("stage", "page", "idx", "table", "__t"))).alias("__parts"))
    body = F.coalesce("body", F.lit(""))
    text = F.array_join(F.transform("__parts", lambda p: p["__t"]), "\n\n")
    whole = F.when(F.col("__parts").isNull(), body).when(body == "", text).otherwise(F.concat(body, F.lit("\n\n"), text))
    ids = F.coalesce(F.transform("__parts", lambda p: p["table"]), F.array().cast(f"array<{drawn.schema['table'].dataType.simpleString()}>"))
    return found.join(parts, [key, "sec"], "left").select(key, "sec", whole.alias("body"), ids.alias("tables"))
