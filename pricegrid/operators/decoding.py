"""Closed configuration decoders: a document is taken only as a whole, and every reason against it is told with its path.

A schema is a dict of field names: a type, a dict for an object within, or a tuple of allowed texts; a name with a question mark may be
missing or null. Types: text, whole, number (finite, as a number or a text of one), flag, time (with a zone), and list:<type>.
Documents are parsed once, as variants; a syntax error, a number that is none (NaN, Infinity) and a repeated key make the whole undecodable.

Defined results: a null document is undecodable; refusals are sorted; a document without refusals is decoded as its variant.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

Schema = dict[str, Any]
_NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_TIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?(Z|[+-][0-9]{2}:[0-9]{2})?$"
_ZONE = r"(Z|[+-][0-9]{2}:[0-9]{2})$"


def _kind(value: Column) -> Column:
    """STRING, BIGINT, DECIMAL(..), DOUBLE, BOOLEAN, VOID, OBJECT<..> or ARRAY<..> of a variant; null without one."""
    return F.schema_of_variant(value)


def _scalar(value: Column, wanted: Any, path: str) -> Column:
    """The code against a value that is there, null if there is none."""
    kind, text = _kind(value), F.try_variant_get(value, "$", "string")
    whole = kind == "BIGINT"
    number = whole | kind.startswith("DECIMAL") | (kind == "DOUBLE") | (kind == "FLOAT")
    if isinstance(wanted, tuple):
        return F.when((kind != "STRING") | ~text.isin(*wanted), "invalid_literal")
    if wanted == "text":
        return F.when(kind != "STRING", "invalid_scalar")
    if wanted == "whole":
        return F.when(~whole, "invalid_scalar")
    if wanted == "flag":
        return F.when(kind != "BOOLEAN", "invalid_scalar")
    if wanted == "number":
        return F.when(~number & (kind != "STRING"), "invalid_scalar").when((kind == "STRING") & ~text.rlike(_NUMBER), "non_finite_decimal")
    if wanted == "time":
        return F.when((kind != "STRING") | ~text.rlike(_TIME), "invalid_scalar").when(~text.rlike(_ZONE), "timezone_required")
    raise ValueError(f"unknown type at {path}: {wanted}")


def refusals(document: Column, schema: Schema) -> Column:
    """array<string>: path:code of each reason against the JSON text; empty where the document is taken."""
    return F.element_at(F.transform(F.array(F.try_parse_json(document)), lambda parsed: _refused(parsed, schema)), 1)


def _refused(parsed: Column, schema: Schema) -> Column:
    """The refusals of a document that was parsed, or null."""
    found: list[Column] = []

    def told(path: str, code: Column) -> Column:
        return F.when(code.isNotNull(), F.concat(F.lit(f"{path}:"), code))

    def item(wanted: str, path: str):
        """What is told about a list's item; bound here, as a lambda's own parameters are the item and its place."""

        def tell(x: Column, i: Column) -> Column:
            return F.when(_scalar(x, wanted, path).isNotNull(), F.concat(F.lit(f"{path}["), i.cast("string"), F.lit("]:"), _scalar(x, wanted, path)))

        return tell

    def walk(schema: Schema, path: str) -> None:
        value = F.try_variant_get(parsed, path, "variant")
        is_object = _kind(value).startswith("OBJECT")
        found.append(told(path, F.when(value.isNotNull() & ~is_object, "invalid_object")))
        names = [n.removesuffix("?") for n in schema]
        keys = F.map_keys(F.try_variant_get(parsed, path, "map<string,variant>"))
        unknown = F.array_except(F.coalesce(keys, F.array().cast("array<string>")), F.array(*map(F.lit, names)) if names else F.array().cast("array<string>"))
        found.append(F.when(is_object & (F.size(unknown) > 0), F.concat(F.lit(f"{path}:unknown_schema_fields:"), F.array_join(F.array_sort(unknown), ","))))
        for name, wanted in schema.items():
            optional, at = name.endswith("?"), f"{path}.{name.removesuffix('?')}"
            inner = F.try_variant_get(parsed, at, "variant")
            absent = inner.isNull() | F.is_variant_null(inner)
            if not optional:
                found.append(told(at, F.when(is_object & absent, "missing_field")))
            if isinstance(wanted, dict):
                walk_absent = absent  # an object that is left out has nothing to say
                before = len(found)
                walk(wanted, at)
                found[before:] = [F.when(~walk_absent, c) for c in found[before:]]
            elif isinstance(wanted, str) and wanted.startswith("list:"):
                items = F.try_variant_get(parsed, at, "array<variant>")
                each = F.transform(items, item(wanted.removeprefix("list:"), at))
                found.append(F.when(~absent, F.when(~_kind(inner).startswith("ARRAY"), F.lit(f"{at}:invalid_tuple")).otherwise(F.array_join(F.array_compact(each), ";"))))
            else:
                found.append(F.when(~absent, told(at, _scalar(inner, wanted, at))))

    walk(schema, "$")
    each = F.filter(F.flatten(F.transform(F.array_compact(F.array(*found)), lambda c: F.split(c, ";"))), lambda c: c != "")
    return F.when(parsed.isNull(), F.array(F.lit("$:undecodable_json"))).otherwise(F.coalesce(F.array_sort(F.array_distinct(each)), F.array().cast("array<string>")))


def decoded(document: Column, schema: Schema) -> Column:
    """The document as a variant where nothing speaks against it, else null."""
    return F.when(F.size(refusals(document, schema)) == 0, F.try_parse_json(document))


def feed_mode(config: Column, instrument: Column, symbol: Column, old_offset: Column) -> Column:
    """binding or legacy, or the code of the settings that don't fit together, by which of the four are there."""
    return (
        F.when(config & instrument & ~symbol, F.when(old_offset, "time_offset_conflict").otherwise("binding"))
        .when((config & symbol) | (~config & instrument), "feed_mode_conflict").when(config, "not_configured").when(symbol, "legacy").otherwise("not_configured")
    )
