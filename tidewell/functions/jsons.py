"""JSON that may be wrapped, broken or nested."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def recovered(text: Column) -> Column:
    """The text from its first to its last brace, code fences off; null if there is no object."""
    plain = F.regexp_replace(text, r"(?m)^\s*```[A-Za-z]*\s*$", "")
    found = F.regexp_extract(plain, r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(found).isNotNull() & (found != ""), found)


def first_key(text: Column, names: Sequence[str]) -> Column:
    """The value of the first of some alias keys that is there."""
    return F.coalesce(*[F.get_json_object(text, f"$.{n}") for n in names])


def score_value(raw: Column) -> Column:
    """A number rounded half up and clamped to 0..100, null if it is none."""
    number = F.trim(raw).try_cast("double")
    return F.when(number.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(100), F.floor(number + 0.5)))).cast("int")


def boolean_value(raw: Column) -> Column:
    return F.coalesce(F.lower(F.trim(raw)).isin("true", "1", "yes"), F.lit(False))


def string_list(raw: Column) -> Column:
    """A JSON array, or parts between commas, semicolons and line feeds; no blanks."""
    parsed = F.from_json(raw, "array<string>")
    parts = F.coalesce(F.when(F.trim(raw).startswith("["), parsed), F.split(raw, r"[,;，；\n]"))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def ordered_map(raw: Column) -> Column:
    """A map of strings without blank values; a list becomes a map by number."""
    listed = F.from_json(raw, "array<string>")
    by_number = F.map_from_entries(F.transform(listed, lambda x, i: F.struct((i + 1).cast("string"), x)))
    either = F.when(F.trim(raw).startswith("["), by_number).otherwise(F.from_json(raw, "map<string,string>"))
    return F.map_filter(either, lambda k, v: v.isNotNull() & (F.trim(v) != ""))


def nested_value(raw: Column, key: str, depth: int = 4) -> Column:
    """The value of a key in the object, or in objects within it up to a depth: outer levels first."""
    level = F.array(F.try_parse_json(raw))
    found = []
    for _ in range(depth):
        found.append(F.get(F.filter(F.transform(level, lambda v: F.try_variant_get(v, f"$.{key}", "string")), lambda x: x.isNotNull()), 0))
        inner = F.transform(level, lambda v: F.coalesce(F.map_values(F.try_variant_get(v, "$", "map<string,variant>")), F.try_variant_get(v, "$", "array<variant>"), F.array()))
        level = F.flatten(inner)
    return F.coalesce(*found)
