"""Reversible redaction: personal data gives way to numbered placeholders, and a vault gives it back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns in the order in which they apply; mobile and landline numbers share a label. (?U) makes classes, digits and
#: word borders Unicode-aware, so that full-width digits count as digits.
PATTERNS = [
    # An address begins where no address character stands before it, or where the last match ended: a run is read once, not
    # from each of its characters.
    ("email", r"(?U)(?:\G|(?<![\w.\-+]))[\w.\-+]++@[\w.\-]+\.[a-zA-Z]{2,}"),
    ("id", r"(?U)\d{17}[\dXx]"),
    ("credit_code", r"(?U)(?i)\b[0-9A-HJ-NPQRTUWXY]{18}\b"),
    ("bank", r"(?U)\b\d{16,19}\b"),
    ("phone", r"(?U)1[3-9]\d-?\d{4}-?\d{4}"),
    ("phone", r"(?U)0\d{2,3}[-\s]?\d{7,8}"),
]
#: The same as SQL engines write them, for queries that have SQL: word borders and blanks are those of ASCII, so that a code
#: between letters such as é counts as a word of its own. A border is where one side alone is a word character; it is told from
#: the side that the match has, which for most characters ends the trial. The Kelvin sign is a K in small letters.
_WORD, _ASCII, _CODE, _KELVIN = r"0-9A-Za-z_\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}", "[0-9A-Za-z_]", "0-9A-HJ-NPQRTUWXYa-hj-npqrtuwxy", "K"
SQL_PATTERNS = [
    ("email", rf"(?:\G|(?<![{_WORD}.\-+]))[{_WORD}.\-+]++@[{_WORD}.\-]+\.[a-zA-Z]{{2,}}"),
    ("id", r"\p{Nd}{17}[\p{Nd}Xx]"),
    ("credit_code", rf"(?:(?=[{_CODE}])(?<!{_ASCII})|(?={_KELVIN})(?<={_ASCII}))[{_CODE}{_KELVIN}]{{18}}(?:(?<!{_KELVIN})(?!{_ASCII})|(?<={_KELVIN})(?={_ASCII}))"),
    ("bank", rf"(?:(?=[0-9])(?<!{_ASCII})|(?=[^\x00-\x7F])(?<={_ASCII}))\p{{Nd}}{{16,19}}(?:(?<=[0-9])(?!{_ASCII})|(?<=[^\x00-\x7F])(?={_ASCII}))"),
    ("phone", r"1[3-9]\p{Nd}-?\p{Nd}{4}-?\p{Nd}{4}"),
    ("phone", r"0\p{Nd}{2,3}[-\t\n\f\r ]?\p{Nd}{7,8}"),
]
LABELS = tuple(dict.fromkeys(label for label, _ in PATTERNS))
VAULT = "array<struct<label:string,value:string,n:int,placeholder:string>>"
MODES = {"off": False, "false": False, "none": False, "low": True, "standard": True, "true": True, "on": True}


def redaction_on(mode: str) -> bool:
    """Whether a mode redacts; an unknown one is an error."""
    if mode.strip().lower() not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    return MODES[mode.strip().lower()]


def _entry(label: str, above: Column):
    """From a value and its place to its entry in the vault, numbered from `above` on."""

    def entry(v: Column, k: Column) -> Column:
        n = (above + k + 1).cast("int")
        return F.struct(F.lit(label).alias("label"), v.alias("value"), n.alias("n"), F.concat(F.lit(f"[{label}_"), n.cast("string"), F.lit("]")).alias("placeholder"))

    return entry


def _numbered(label: str, above: Column) -> Callable[[Column], Column]:
    """From the values of a label to their entries."""
    return lambda values: F.when(F.size(values) > 0, F.transform(values, _entry(label, above))).otherwise(F.array().cast(VAULT))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often the body names it: the optimiser doesn't look into lambdas."""
    return F.transform(F.array(value), body)[0]


def _entries_of(label: str, text: Column, found: list[Column], known: Column | None = None) -> Column:
    """The entries of a label's values, those that the vault `known` doesn't hold."""
    values = F.array_distinct(F.concat(*found))
    taken = F.regexp_extract_all(text, F.lit(rf"\[{label}_([0-9]{{1,8}})\]"), F.lit(1))
    above = F.when(F.contains(text, F.lit(f"[{label}_")), F.coalesce(F.array_max(F.transform(taken, lambda x: x.cast("int"))), F.lit(0))).otherwise(0)
    if known is not None:
        own = F.filter(known, lambda e: e["label"] == label)
        values = F.array_except(values, F.transform(own, lambda e: e["value"]))
        above = F.greatest(above, F.array_max(F.transform(own, lambda e: e["n"])))
    return _let(values, _numbered(label, above))


def _entries(text: Column, labels: tuple[str, ...], patterns: list[tuple[str, str]]) -> Column:
    """The vault of one text. Patterns follow each other; a text is rewritten only for a pattern that found something."""
    last = max(i for i, (label, _) in enumerate(patterns) if label in labels)

    def scan(i: int, rest: Column, held: list[tuple[str, Column]]) -> Column:
        def with_found(found: Column) -> Column:
            now = [*held, (patterns[i][0], found)]
            if i == last:
                return vault_of(now)
            return _let(F.when(F.size(found) > 0, F.regexp_replace(rest, patterns[i][1], "\u0001")).otherwise(rest), lambda t: scan(i + 1, t, now))

        return _let(F.regexp_extract_all(rest, F.lit(patterns[i][1]), F.lit(0)), with_found)

    def vault_of(held: list[tuple[str, Column]]) -> Column:
        parts = [_entries_of(label, text, [found for own, found in held if own == label]) for label in labels]
        return F.concat(*parts)

    return scan(0, text, [])


def with_vault(docs: DataFrame, text: str, into: str = "vault", labels: tuple[str, ...] = LABELS, patterns: list[tuple[str, str]] = PATTERNS) -> DataFrame:
    """`docs` with an array of what the patterns find in each row's text: each value once, numbered by its first occurrence
    under its label, with its placeholder. Only `labels` are listed.

    Each pattern sees the text without what the ones before it took, and nothing leaves the row. The time is in proportion to
    the text: each pattern reads it once, and the vault is made behind a generator, so that filters on it don't make it again.
    Numbers start above those of placeholders that the text itself holds, so these are never given back as somebody's data. A
    null text has an empty vault."""
    made = F.coalesce(_entries(F.col(f"`{text}`"), labels, patterns), F.array().cast(VAULT))
    return docs.select(*(F.col(f"`{c}`") for c in docs.columns if c != into), F.explode_outer(F.array(made)).alias(into))


def replaced(text: Column, vault: Column, old: str, new: str) -> Column:
    """The text with each entry's `old` replaced by its `new`, longest first, so that no value breaks a longer one."""
    entries = F.array_sort(F.transform(vault, lambda e: F.struct((-F.char_length(e[old])).alias("o"), e[old].alias("old"), e[new].alias("new"))))
    return F.when(F.size(vault) > 0, F.aggregate(entries, text, lambda t, e: F.replace(t, e["old"], e["new"]))).otherwise(text)


def redacted(docs: DataFrame, text: str, into: str = "vault", patterns: list[tuple[str, str]] = PATTERNS, known: str | None = None) -> DataFrame:
    """`docs` with placeholders in the text and each row's vault beside it. Each match gives way where it is, so equal
    characters elsewhere stay, and the text is read twice for each pattern. A value that the column `known` (a vault) holds
    under its label gets the placeholder it has there; the vault lists the others, numbered above those."""
    held = None if known is None else F.col(f"`{known}`")
    first, rest = F.col(f"`{text}`"), [F.col(f"`{c}`") for c in docs.columns if c != into]
    rows = docs.select(*rest, first.alias("__t"))
    for i, (label, pattern) in enumerate(patterns):
        earlier = [F.col(f"__f{j}") for j in range(i)]

        def step(found: Column) -> Column:
            same = [F.col(f"__f{j}") for j in range(i) if patterns[j][0] == label] + [found]
            entries = _entries_of(label, first, same, held)
            entries = entries if held is None else F.concat(F.filter(held, lambda e: e["label"] == label), entries)
            placed = _let(entries, lambda e: _let(F.transform(e, lambda x: x["value"]), lambda v: F.transform(found, lambda x: F.element_at(e, F.array_position(v, x).cast("int"))["placeholder"])))
            pieces = F.zip_with(F.split("__t", pattern, -1), F.concat(placed, F.array(F.lit(""))), lambda x, y: F.concat(x, y))
            return F.struct(found.alias("f"), F.when(F.size(found) > 0, F.array_join(pieces, "")).otherwise(F.col("__t")).alias("t"))

        made = _let(F.regexp_extract_all("__t", F.lit(pattern), F.lit(0)), step)
        # Behind a generator, what is made is made once.
        rows = rows.select(*rest, "__t", *earlier, F.explode_outer(F.array(made)).alias("__m")).select(*rest, F.col("__m.t").alias("__t"), *earlier, F.col("__m.f").alias(f"__f{i}"))
    found = lambda label: [F.col(f"__f{i}") for i, (own, _) in enumerate(patterns) if own == label]
    made = F.coalesce(F.concat(*(_entries_of(label, first, found(label), held) for label in LABELS)), F.array().cast(VAULT))
    rows = rows.select(*rest, "__t", F.explode_outer(F.array(made)).alias("__m"))
    return rows.select(*(F.col("__t").alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns if c != into), F.col("__m").alias(into))


def restored(docs: DataFrame, text: str, vault: str = "vault") -> DataFrame:
    """`docs` with the values of each row's vault given back, without the vault."""
    return docs.withColumn(text, replaced(F.col(text), F.col(vault), "placeholder", "value")).drop(vault)


def vault(docs: DataFrame, key: str, text: str, labels: tuple[str, ...] = LABELS, patterns: list[tuple[str, str]] = PATTERNS) -> DataFrame:
    """(key, label, value, n, placeholder): the rows' vaults as a table."""
    return with_vault(docs.select(key, text), text, "__v", labels, patterns).select(key, F.explode_outer("__v").alias("e")).filter("e IS NOT NULL").select(key, "e.*")


def _with_entries(docs: DataFrame, vaults: DataFrame, key: str) -> DataFrame:
    entries = vaults.groupBy(key).agg(F.collect_list(F.struct("label", "value", "n", "placeholder")).alias("__v"))
    return docs.join(entries, key, "left").withColumn("__v", F.coalesce("__v", F.array().cast(VAULT)))


def redact(docs: DataFrame, vaults: DataFrame, key: str, text: str) -> DataFrame:
    """The text redacted by a vault table that is kept elsewhere; `redacted` needs no join."""
    return _with_entries(docs, vaults, key).withColumn(text, replaced(F.col(text), F.col("__v"), "value", "placeholder")).drop("__v")


def restore(docs: DataFrame, vaults: DataFrame, key: str, text: str) -> DataFrame:
    """The text restored from a vault table that is kept elsewhere."""
    return _with_entries(docs, vaults, key).withColumn(text, replaced(F.col(text), F.col("__v"), "placeholder", "value")).drop("__v")


def summary(vaults: DataFrame) -> DataFrame:
    """Distinct values of each label and in all."""
    return vaults.rollup("label").agg(F.count(F.lit(1)).alias("n"), F.grouping("label").alias("g")).select(F.when(F.col("g") == 1, "total").otherwise(F.col("label")).alias("label"), "n")
