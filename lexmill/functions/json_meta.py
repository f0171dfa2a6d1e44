"""JSON held as text: tolerant parsing, overlay of ``meta``, model answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill import fixed_values as V
from lexmill.functions.binding import let
from lexmill.functions.text import js_trim

VARIANT_MAP = "map<string,variant>"


# Strings of any length are read (a stored file is one string), and nothing beyond plain JSON.
READ_OPTIONS = {
    "maxStringLen": "2147483647",
    "maxNumLen": "1000000",
    "allowSingleQuotes": "false",
    "allowNonNumericNumbers": "false",
}
END_MARK = "\u0001end\u0001"


def safe_json_parse(text: Column) -> Column:
    """The parsed value as a variant; null for null, blank and invalid text.

    Spark's parser stops after the first value. So the text is read as the first
    of two list entries: only one value alone is followed by the end mark.
    An object that repeats a key keeps its last value, see ``session.prepare``.
    """
    listed = F.concat(F.lit("["), text, F.lit(r',"\u0001end\u0001"]'))

    def alone(values: Column) -> Column:
        ended = (F.size(values) == 2) & (F.try_variant_get(F.get(values, F.lit(1)), "$", "string") == END_MARK)
        return F.when(ended, F.get(values, F.lit(0)))

    return let(F.from_json(listed, "array<variant>", READ_OPTIONS), alone)


def is_valid_json(text: Column) -> Column:
    return safe_json_parse(text).isNotNull()


def empty_map() -> Column:
    return F.create_map().cast(VARIANT_MAP)


def object_map(value: Column) -> Column:
    """Entries of a variant object; an empty map for anything else."""
    return F.coalesce(F.try_variant_get(value, "$", VARIANT_MAP), empty_map())


def overlay(base: Column, patch: Column) -> Column:
    """Entries of ``patch`` over ``base``, whatever the key de-duplication policy is."""
    return let(patch, lambda over: F.map_concat(_without(base, lambda key: F.map_contains_key(over, key)), over))


def _without(entries: Column, drop) -> Column:
    return F.map_filter(entries, lambda key, _: ~drop(key))


def meta_map(parsed: Column) -> Column:
    return F.coalesce(F.try_variant_get(parsed, "$.meta", VARIANT_MAP), empty_map())


def merge_json_meta(json_text: Column, patch: Column) -> Column:
    """Shallow overlay of ``patch`` (``map<string,variant>``) on the ``meta`` object.

    Invalid JSON and a ``meta`` that is no object count as empty. An explicit
    null in the patch overwrites; an absent key leaves the stored value.
    """

    def merged(parsed: Column) -> Column:
        meta = overlay(meta_map(parsed), F.coalesce(patch, empty_map()))
        rest = _without(object_map(parsed), lambda key: key == "meta")
        return F.to_json(F.map_concat(rest, F.create_map(F.lit("meta"), F.to_variant_object(meta))))

    return let(safe_json_parse(json_text), merged)


def patch_from_json(text: Column, keys: tuple[str, ...] | None = None) -> Column:
    """A request body as a patch map, reduced to ``keys`` when they are given."""
    return let(safe_json_parse(text), lambda parsed: parsed_patch(parsed, keys))


def parsed_patch(parsed: Column, keys: tuple[str, ...] | None = None) -> Column:
    entries = object_map(parsed)
    if keys is None:
        return entries
    return F.map_filter(entries, lambda key, _: key.isin(*keys))


def is_unreadable(text: Column, parsed: Column) -> Column:
    """A text that is there and is no JSON value."""
    return parsed.isNull() & (js_trim(text) != "")


def meta_text(parsed: Column, key: str) -> Column:
    return F.try_variant_get(parsed, f"$.meta.{key}", "string")


def meta_view(json_text: Column, file_name: Column) -> Column:
    """``struct(title, category, description)`` for the edit form."""
    return let(safe_json_parse(json_text), lambda parsed: parsed_view(parsed, file_name))


def parsed_view(parsed: Column, file_name: Column) -> Column:
    """``meta_view`` of a text that is parsed already."""
    return F.struct(
        F.coalesce(meta_text(parsed, "title"), file_name, F.lit("")).alias("title"),
        F.coalesce(meta_text(parsed, "category"), F.lit("")).alias("category"),
        F.coalesce(meta_text(parsed, "description"), F.lit("")).alias("description"),
    )


def first_object_text(answer: Column) -> Column:
    """Text from the first ``{`` to the last ``}``, code fences removed."""
    bare = js_trim(F.replace(F.replace(answer, F.lit("```json"), F.lit("")), F.lit("```"), F.lit("")))
    return F.regexp_extract(bare, r"(?s)\{.*\}", 0)


def clean_model_json(answer: Column, fallback_json: Column | None = None) -> Column:
    """JSON text of a model answer, or the fixed failure record."""
    fallback = model_failure_json() if fallback_json is None else fallback_json
    return let(first_object_text(answer), lambda body: F.when(is_valid_json(body), body).otherwise(fallback))


def model_failure_json() -> Column:
    clause, issue, severity = V.MODEL_FAILURE["risk"]
    risk = F.struct(
        F.lit(clause).alias("clause"), F.lit(issue).alias("issue"), F.lit(severity).alias("severity")
    )
    return F.to_json(
        F.struct(
            F.lit(V.MODEL_FAILURE["summary"]).alias("summary"),
            F.lit(V.MODEL_FAILURE["risk_score"]).alias("risk_score"),
            F.array(risk).alias("risks"),
            F.lit(V.MODEL_FAILURE["recommendation"]).alias("recommendation"),
        )
    )
