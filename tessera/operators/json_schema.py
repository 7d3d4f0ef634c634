"""JSON Schema as Catalyst columns over variants.

The part of JSON Schema that case schemas use (type, enum, lengths, pattern, bounds, required, properties,
additionalProperties, items) is compiled, keyword by keyword, into one expression that gives a value's errors as an
array of strings.  The schema is walked on the driver, once; values are never walked in Python.  Messages stand in the
order of the schema; an object or array that is none of an enum's values is shown as JSON.

A value that is no JSON has the one error that says so; null text too.  Whole numbers of more than 64 bits count as numbers,
not as integers.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of JSON's kinds in the messages, by the first word of a variant's own schema.
_KIND = {"OBJECT": "dict", "ARRAY": "list", "STRING": "str", "BOOLEAN": "bool", "BIGINT": "int", "VOID": "NoneType"}
#: The kinds that each type of a schema allows.
_ALLOWED = {"object": ("dict",), "array": ("list",), "string": ("str",), "boolean": ("bool",), "null": ("NoneType",), "integer": ("int",), "number": ("int", "float")}


def _none() -> Column:
    return F.array().cast("array<string>")


def kind_of(value: Column) -> Column:
    """dict, list, str, bool, int, float or NoneType of a variant."""
    word = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in _KIND.items() for x in kv]), word), F.lit("float"))


def _shown(value: Column, kind: Column) -> Column:
    """A scalar as a message shows it."""
    text = F.variant_get(value, "$", "string")
    return F.when(kind == "str", F.concat(F.lit("'"), text, F.lit("'"))).when(kind == "bool", F.initcap(text)).when(kind == "NoneType", "None").otherwise(F.coalesce(text, F.to_json(value)))


def _bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), use), 0)


def _said(wrong: Column, *message: Column | str) -> Column:
    """One message where ``wrong`` holds."""
    return F.when(F.coalesce(wrong, F.lit(False)), F.array(F.concat(*[F.lit(m) if isinstance(m, str) else m for m in message]))).otherwise(_none())


def errors(value: Column, schema: dict, path: Column) -> Column:
    """array<string>: the errors of a variant against ``schema``; ``path`` names the value."""
    return _bind(kind_of(value), lambda kind: _errors(value, kind, schema, path))


def _errors(value: Column, kind: Column, schema: dict, path: Column) -> Column:
    found = []
    if "enum" in schema:
        same = F.lit(False)
        for x in schema["enum"]:
            other = F.parse_json(F.lit(json.dumps(x)))
            number = isinstance(x, (int, float)) and not isinstance(x, bool)
            alike = F.variant_get(value, "$", "double") == float(x) if number else F.to_json(value) == F.to_json(other)
            same = same | (kind.isin("int", "float") if number else kind == type(x).__name__) & F.coalesce(alike, F.lit(False))
        found.append(_said(~same, path, ": ", _shown(value, kind), f" is not one of {schema['enum']}"))
    text = F.when(kind == "str", F.variant_get(value, "$", "string"))
    number = F.when(kind.isin("int", "float"), F.variant_get(value, "$", "double"))
    for keyword, wrong, words in (
        ("minLength", lambda x: F.length(text) < x, "shorter than"), ("maxLength", lambda x: F.length(text) > x, "longer than"), ("pattern", lambda x: ~text.rlike(x), "doesn't match"),
        ("minimum", lambda x: number < float(x), "below"), ("maximum", lambda x: number > float(x), "above"),
    ):
        if keyword in schema:
            found.append(_said(wrong(schema[keyword]), path, f": {words} {schema[keyword]}"))
    known = schema.get("properties", {})
    if known or "required" in schema or schema.get("additionalProperties") is False:
        fields = F.when(kind == "dict", F.variant_get(value, "$", "map<string,variant>"))
        found.append(_bind(fields, lambda f: _field_errors(f, known, schema, path)))
    if "items" in schema:
        items = F.coalesce(F.when(kind == "list", F.variant_get(value, "$", "array<variant>")), F.array().cast("array<variant>"))
        found.append(F.flatten(F.transform(items, lambda x, i: errors(F.coalesce(x, F.parse_json(F.lit("null"))), schema["items"], F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))))
    rest = F.concat(*found) if found else _none()
    if "type" not in schema:
        return rest
    wanted = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
    fits = kind.isin(*{k for w in wanted for k in _ALLOWED[w]})
    return F.when(fits, rest).otherwise(F.array(F.concat(path, F.lit(f": expected {'/'.join(wanted)}, got "), kind)))


def _field_errors(fields: Column, known: dict, schema: dict, path: Column) -> Column:
    """Errors of an object's fields, a map that is null for what is no object."""
    keys = F.map_keys(fields)
    found = [_said(~F.array_contains(keys, k), path, f".{k}: required") for k in schema.get("required", [])]
    if schema.get("additionalProperties") is False:
        more = F.array_except(keys, F.array(*[F.lit(k) for k in known]).cast("array<string>"))
        found.append(F.coalesce(F.transform(more, lambda k: F.concat(path, F.lit("."), k, F.lit(": not allowed"))), _none()))
    null = F.parse_json(F.lit("null"))
    for k, own in known.items():
        below = errors(F.coalesce(F.try_element_at(fields, F.lit(k)), null), own, F.concat(path, F.lit(f".{k}")))
        found.append(F.when(F.array_contains(keys, k), below).otherwise(_none()))
    return F.concat(*found) if found else _none()


def schema_errors(records: DataFrame, schema: dict, column: str = "value") -> DataFrame:
    """(line, error) of every JSON text in ``column``; ``line`` names the row."""
    parsed = records.select("line", F.try_parse_json(F.col(column)).alias("value"))
    said = F.when(F.col("value").isNull(), F.array(F.lit("$: not JSON"))).otherwise(errors(F.col("value"), schema, F.lit("$")))
    return parsed.select("line", F.explode(said).alias("error"))
