"""Tolerant access to JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions import text as T


def value(c: Column, *paths: str, kind: str = "string", default=None) -> Column:
    """The first path that has a value, cast, or the default; text that isn't JSON counts as having none."""
    found = F.coalesce(*(F.get_json_object(c, p) for p in paths)).try_cast(kind)
    return found if default is None else F.coalesce(found, F.lit(default).cast(kind))


def string_list(c: Column) -> Column:
    """A JSON array of strings, else the text itself as its only element, else null."""
    return F.when(c.isNull(), F.lit(None).cast("array<string>")).otherwise(F.coalesce(F.when(F.trim(c).startswith("["), F.from_json(c, "array<string>")), F.array(c)))


def token_usage(c: Column) -> Column:
    """struct(input, output) over the two shapes that model services answer in."""
    return F.struct(value(c, "$.usage.prompt_tokens", "$.usage.input_tokens", kind="long", default=0).alias("input"), value(c, "$.usage.completion_tokens", "$.usage.output_tokens", kind="long", default=0).alias("output"))


def hit_count(c: Column) -> Column:
    """Search hits over three shapes: a list of results, a nested list, a bare list."""
    return F.coalesce(F.json_array_length(F.get_json_object(c, "$.results")), F.json_array_length(F.get_json_object(c, "$.data.webPages.value")), F.when(F.trim(c).startswith("["), F.json_array_length(c)), F.lit(0))


def reference_ids(answer: Column, given: Column) -> Column:
    """Block ids marked in an answer, then those of a JSON array of references; each once; what is null or no JSON
    gives none."""
    beside = F.filter(F.from_json(given, "array<struct<block_id:string>>")["block_id"], lambda x: x.isNotNull())
    return F.array_distinct(F.concat(F.coalesce(T.block_references(answer), F.array().cast("array<string>")), F.coalesce(beside, F.array().cast("array<string>"))))
