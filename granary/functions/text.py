"""Text functions as Column -> Column expressions. Character classes are Unicode-aware where `(?U)` stands."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def char_len(c: Column) -> Column:
    return F.char_length(c)


def byte_len(c: Column) -> Column:
    return F.octet_length(c)


def quote(text: str) -> str:
    """A literal as a Java regular expression."""
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def any_of(c: Column, words: list[str]) -> Column:
    """Whether the text contains one of the words."""
    return c.rlike("|".join(quote(w) for w in words)) if words else F.lit(False)


def clean_layout(c: Column) -> Column:
    """Trimmed non-blank lines; blanks between CJK characters go; runs of spaces become two at most."""
    lines = F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    joined = F.array_join(lines, "\n")
    joined = F.regexp_replace(joined, "(?<=[一-鿿]) +(?=[一-鿿])", "")
    return F.regexp_replace(joined, " {3,}", "  ")


def strip_emphasis(c: Column) -> Column:
    """Without leading emphasis marks."""
    return F.regexp_replace(c, "^[★▲●■◆※☆△○□◇*]+\\s*", "")


def normalise_query(c: Column) -> Column:
    """Lower case, ASCII punctuation to blanks, single blanks: the key that equal queries share."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "[!-/:-@\\[-`{-~]", " "), "[ \\t\\r\\n]+", " "))


def normalise_quote(c: Column) -> Column:
    """Lower case without white space and ASCII punctuation, for comparing quotations."""
    return F.regexp_replace(F.lower(c), "[\\s!-/:-@\\[-`{-~，。；：、（）【】《》“”‘’！？]", "")


def numbers_in(c: Column) -> Column:
    """Positive numbers in a text; runs of digits and dots that are no number are left out."""
    found = F.transform(F.regexp_extract_all(c, F.lit("[0-9][0-9.]*"), F.lit(0)), lambda x: x.try_cast("double"))
    return F.filter(found, lambda x: x.isNotNull() & (x > 0))


def grams(c: Column, n: int) -> Column:
    """Distinct runs of `n` characters; a shorter text is its own only gram."""
    size = F.char_length(c)
    return F.when(size < n, F.array(c)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), size - n + 1)), lambda i: F.substring(c, i, F.lit(n)))))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two arrays of distinct items; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def trigrams(c: Column) -> Column:
    """Distinct runs of three letters or digits, other characters left out; none in shorter texts."""
    kept = F.regexp_replace(c, "[^\\p{IsAlphabetic}\\p{N}]+", "")
    return F.when(F.char_length(kept) >= 3, grams(kept, 3)).otherwise(F.array().cast("array<string>"))


def evidence_similarity(a: Column, b: Column) -> Column:
    """1 for equal or contained evidence, else the Jaccard share of trigrams; 0 if one is empty or null. Dates such as
    2024年1月2日 and their mask [日期] count as equal, and blanks don't count."""
    a, b = (F.regexp_replace(F.coalesce(c, F.lit("")), "(?U)^\\s+|\\s+$", "") for c in (a, b))
    x, y = (F.replace(F.regexp_replace(c, "\\p{Nd}{4}年\\p{Nd}{1,2}月\\p{Nd}{1,2}日|\\[日期\\]", "日期"), F.lit(" "), F.lit("")) for c in (a, b))
    inside = F.contains(a, b) | F.contains(b, a) | F.contains(x, y) | F.contains(y, x)
    return F.when((a == "") | (b == ""), F.lit(0.0)).when(inside, F.lit(1.0)).otherwise(jaccard(trigrams(x), trigrams(y)))


def plain_heading(kind: Column, text: Column) -> Column:
    """struct(title, pattern, level) of a heading block that no numbering marks: its first clean line, if of 2 to 30 characters."""
    clean = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~page_noise(x))
    first = F.get(clean, F.lit(0))
    fits = (kind == "heading") & F.char_length(first).between(2, 30)
    return F.when(fits, F.struct(first.alias("title"), F.lit("plain_heading").alias("pattern"), F.lit(5).alias("level")))


def identifier(c: Column, default: str = "item") -> Column:
    """Letters, digits and underscores of a text, or a default."""
    kept = F.regexp_replace(c, "[^A-Za-z0-9_]", "")
    return F.when(kept == "", F.lit(default)).otherwise(kept)


def category_code(c: Column) -> Column:
    """Upper-case code of [A-Z0-9_] without a prefix such as A01_."""
    return F.regexp_replace(F.regexp_replace(F.upper(c), "[^A-Z0-9_]", ""), "^[A-Z][0-9]+_", "")


def numbered_items(c: Column) -> Column:
    """Lines that begin with a number and a mark."""
    return F.regexp_count(c, F.lit("(?m)^[ \\t]*[0-9][.、)）]"))


def snippet(c: Column, most: int = 120) -> Column:
    """The first sentence, cut at `most` characters."""
    return F.substring(F.regexp_extract(c, "^([^。.\n]*[。.]?)", 1), 1, most)


def page_noise(c: Column) -> Column:
    """Lines of page furniture: a few digits, page counters, private-use characters, three bytes or fewer."""
    t = F.trim(c)
    return t.rlike("^[0-9 ]{0,3}$") | (F.octet_length(t) <= 3) | (t.rlike("第.*页.*共") & (F.char_length(t) <= 20)) | t.rlike("[-]")


def letter_share(c: Column) -> Column:
    """Letters over characters; 0 for an empty text."""
    n = F.char_length(c)
    return F.when(n > 0, F.char_length(F.regexp_replace(c, "[^\\p{L}]", "")) / n).otherwise(F.lit(0.0))


def strip_html(c: Column) -> Column:
    """Without script and style elements and tags, runs of white space as one blank.

    From an element or tag that isn't closed on, nothing is: the rest of the text is taken at once (and put back), so the time
    is in proportion to the text."""
    bare = F.regexp_replace(c, "(?s)<(?:script|style)[^>]*>.*?</(?:script|style)>|(<(?:script|style).*)", "$1 ")
    bare = F.regexp_replace(bare, "(?s)<[^>]*>|(<.*)", "$1 ")
    return F.trim(F.regexp_replace(bare, "[ \\t\\r\\n]+", " "))


def file_size(c: Column) -> Column:
    """Bytes as B, KB, MB or GB with two decimals."""
    k, m, g = 1024.0, 1024.0**2, 1024.0**3
    return F.when(c.isNull(), F.lit("-")).when(c < k, F.concat(c.cast("string"), F.lit("B"))).when(c < m, F.format_string("%.2fKB", c / k)).when(c < g, F.format_string("%.2fMB", c / m)).otherwise(F.format_string("%.2fGB", c / g))


def without_emoji(c: Column) -> Column:
    return F.regexp_replace(c, "[\\x{1F300}-\\x{1FAFF}\\x{2600}-\\x{27BF}\\x{FE0F}\\x{200D}]", "")


def block_references(c: Column) -> Column:
    """Distinct references such as [b_1_2], in order."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit("\\[(b_[0-9]+_[0-9]+)\\]"), F.lit(1)))


def quoted_in(quotation: Column, text: Column) -> Column:
    """Whether a quotation stands in a text, white space aside."""
    squeeze = lambda x: F.regexp_replace(x, "\\s+", "")
    return F.contains(squeeze(text), squeeze(quotation))


def forbidden_in(text: Column, pattern: str) -> Column:
    """A forbidden phrase whose parts may stand apart: `a*b` is a, later b."""
    return text.rlike("(?s)" + ".*".join(quote(p) for p in pattern.split("*")))


def markdown_table(rows: Column) -> Column:
    """An array of rows of cells as a pipe table; short rows are padded, null cells are empty."""
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(F.sequence(F.lit(1), width), lambda i: F.coalesce(F.try_element_at(r, i), F.lit(""))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    lines = F.transform(rows, line)
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, 1_000_000)), "\n"))


def table_keys(c: Column, most: int = 5) -> Column:
    """First cells of pipe rows, at most 30 characters, distinct, at most `most`."""
    rows = F.filter(F.split(c, "\n"), lambda x: F.trim(x).startswith("|") & ~x.rlike("^[| :-]*$"))
    cells = F.transform(rows, lambda x: F.trim(F.regexp_extract(x, "^\\s*\\|([^|]*)", 1)))
    return F.slice(F.array_distinct(F.filter(cells, lambda x: (x != "") & (F.char_length(x) <= 30))), 1, most)


def embed_text(text: Column, path: Column, depth: int = 2, most: int = 40) -> Column:
    """The text with the last titles of its path, each cut, and the keys of its tables in front."""
    titles = F.slice(path, F.greatest(F.size(path) - depth + 1, F.lit(1)), depth)
    titles = F.transform(titles, lambda t: F.when(F.char_length(t) > most, F.concat(F.substring(t, 1, most), F.lit("…"))).otherwise(t))
    parts = F.filter(F.array(F.array_join(titles, " > "), F.array_join(table_keys(text), "、")), lambda x: x != "")
    return F.when(F.size(parts) > 0, F.concat(F.lit("【"), F.array_join(parts, " | "), F.lit("】"), text)).otherwise(text)


#: Fixed forms of headings: (name, level, pattern of the trimmed line, most characters of the title).
HEADINGS = [
    ("chapter", 1, "^第[一二三四五六七八九十百0-9]+[章部编]", 60),
    ("section", 2, "^第[一二三四五六七八九十百0-9]+节", 60),
    ("cjk", 2, "^[一二三四五六七八九十]+[、.]", 40),
    ("cjk-bracket", 3, "^[(（][一二三四五六七八九十]+[)）]", 40),
    ("decimal3", 5, "^[0-9]+\\.[0-9]+\\.[0-9]+", 40),
    ("decimal2", 4, "^[0-9]+\\.[0-9]+", 40),
    ("decimal1", 3, "^[0-9]+[.、]", 40),
    ("digit-bracket", 5, "^[(（][0-9]+[)）]", 40),
]


def heading(c: Column) -> Column:
    """struct(pattern, level) of the first form of heading that fits a line, or null; numbered ones hold no sentence."""
    line = strip_emphasis(F.trim(c))
    sentence = line.rlike("[。；;!！?？]")
    found = F.lit(None).cast("struct<pattern:string,level:int>")
    for name, level, pattern, most in reversed(HEADINGS):
        fits = line.rlike(pattern) & (F.char_length(line) <= most)
        if name.startswith(("decimal", "digit")):
            fits &= ~sentence
        found = F.when(fits, F.struct(F.lit(name).alias("pattern"), F.lit(level).alias("level"))).otherwise(found)
    return found


def numbering(c: Column) -> Column:
    """The leading decimal numbering as an array of integers; empty if there is none."""
    return F.transform(F.filter(F.split(F.regexp_extract(F.trim(c), "^([0-9]+(?:\\.[0-9]+)*)", 1), "\\."), lambda x: x != ""), lambda x: x.cast("int"))


def inline_headings(c: Column) -> Column:
    """A text with line breaks put before numbers that follow a closing bracket, as lines."""
    return F.split(F.regexp_replace(c, "([)）])(?=[0-9]+[.、)）])", "$1\n"), "\n")


def truncated_title(title: Column, body: Column, least: int = 15, most: int = 60) -> Column:
    """A long title without an end, completed by the first sentence of its body where that stays short; else the title."""
    first = F.regexp_extract(body, "^([^。；\n]*[。；]?)", 1)
    cut = (F.char_length(title) >= least) & ~title.rlike("[。；！？)）]$") & (first != "") & ~first.rlike("^[0-9(（]")
    return F.when(cut & (F.char_length(title) + F.char_length(first) <= most), F.concat(title, first)).otherwise(title)


def markdown_sections(c: Column) -> Column:
    """array<struct<level, title, body>> of a text with # headings."""
    parts = F.filter(F.split(F.concat(F.lit("\n"), c), "\n(?=#{1,6} )"), lambda x: x.rlike("^#{1,6} "))
    return F.transform(parts, lambda x: F.struct(F.char_length(F.regexp_extract(x, "^(#+)", 1)).alias("level"), F.trim(F.regexp_extract(x, "^#+ ([^\n]*)", 1)).alias("title"), F.trim(F.regexp_replace(x, "^[^\n]*\n?", "")).alias("body")))


def path_anomalies(path: Column, most: int = 50) -> Column:
    """struct(long, unsorted): titles over `most` characters, and paths that no heading was found for."""
    return F.struct(F.exists(path, lambda t: F.char_length(t) > most).alias("long"), F.exists(path, lambda t: F.contains(t, F.lit("未归类"))).alias("unsorted"))


def timestamp_or(c: Column, default: Column) -> Column:
    """A timestamp text, or the default where it is none."""
    return F.coalesce(F.try_to_timestamp(c), default)


def sentences(c: Column) -> Column:
    """Trimmed non-empty sentences."""
    return F.filter(F.transform(F.split(c, "[。；;\n!！.]"), lambda x: F.trim(x)), lambda x: x != "")


def cascade(default: Column, cases: list[tuple[Column, Column]]) -> Column:
    """The value of the first case that holds."""
    return reduce(lambda rest, case: F.when(case[0], case[1]).otherwise(rest), reversed(cases), default)
