"""Reading the answers of language models: clean-up, repair, extraction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["batch_labels", "batch_tags", "clean_json", "entities_in", "numbered_objects", "repaired_json", "single_label"]

NAME_KEYS = ("name", "entity", "entity_name", "mention")
TYPE_KEYS = ("type", "category", "label", "kind", "entity_type")


def clean_json(text: Column) -> Column:
    """Without code fences, XML-like tags and line comments, with plain quotes."""
    out = F.regexp_replace(text, r"(?m)^\s*```[A-Za-z]*\s*$", "")
    out = F.regexp_replace(out, r"</?[A-Za-z_][A-Za-z0-9_]*>", "")
    out = F.translate(out, "“”‘’", "\"\"''")
    return F.trim(F.regexp_replace(out, r"(?m)(?<![:\"])//[^\n\"]*$", ""))


def repaired_json(text: Column) -> Column:
    """The text if it parses, else with double quotes, quoted keys and no trailing commas."""
    fixed = F.regexp_replace(text, r"'", '"')
    fixed = F.regexp_replace(fixed, r",\s*([\]}])", "$1")
    fixed = F.regexp_replace(fixed, r"([{,]\s*)([A-Za-z_]\w*)\s*:", '$1"$2":')
    return F.when(F.try_parse_json(text).isNotNull(), text).when(F.try_parse_json(fixed).isNotNull(), fixed)


def numbered_objects(text: Column) -> Column:
    """A JSON array of the objects in lines such as ``1. {...}``; null without one."""
    found = F.regexp_extract_all(text, F.lit(r"(?m)^\s*\d+[.)]\s*(\{.*\})\s*$"), F.lit(1))
    return F.when(F.size(found) > 0, F.concat(F.lit("["), F.array_join(found, ","), F.lit("]")))


def entities_in(text: Column) -> Column:
    """array<struct<name, entity_type>> of an answer: its array, an array in an object, or numbered objects.

    Keys are read without regard to case and under their usual other names; the type falls back to ``concept``, and
    rows without a name are left out.
    """
    clean = clean_json(text)
    outer = F.regexp_extract(clean, r"(?s)(\[.*\])", 1)
    array = F.coalesce(F.when(outer != "", repaired_json(outer)), numbered_objects(clean))
    rows = F.from_json(array, "array<map<string,string>>")
    folded = F.transform(rows, lambda m: F.transform_keys(m, lambda k, v: F.lower(k)))
    pick = lambda m, keys: F.coalesce(*(m[k] for k in keys))
    named = F.transform(folded, lambda m: F.struct(F.trim(pick(m, NAME_KEYS)).alias("name"), F.lower(F.coalesce(pick(m, TYPE_KEYS), F.lit("concept"))).alias("entity_type")))
    return F.filter(named, lambda e: e["name"].isNotNull() & (e["name"] != ""))


def batch_tags(text: Column, size: Column) -> Column:
    """array of JSON arrays for the numbers "1" to ``size`` of an answer, null where one is missing; null if all are."""
    by_number = F.from_json(repaired_json(F.regexp_extract(clean_json(text), r"(?s)(\{.*\})", 1)), "map<string,string>")
    found = F.transform(F.sequence(F.lit(1), size), lambda n: by_number[n.cast("string")])
    return F.when(F.exists(found, lambda x: x.isNotNull()), found)


def batch_labels(text: Column, allowed: tuple[str, ...], size: Column) -> Column:
    """The labels of an answer of one for each line, cut to ``size``; null if there are fewer."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.lower(F.regexp_extract(F.regexp_replace(x, r"^\s*\d+[.):]?\s*", ""), r"([A-Za-z_]+)", 1)))
    found = F.filter(lines, lambda x: x.isin(*allowed))
    return F.when(F.size(found) >= size, F.slice(found, 1, size))


def single_label(text: Column, allowed: tuple[str, ...], default: str = "background") -> Column:
    """The first word of an answer without marks if it is allowed, else ``default``."""
    word = F.lower(F.regexp_extract(text, r"^\W*([A-Za-z_]+)", 1))
    return F.when(word.isin(*allowed), word).otherwise(F.lit(default))
