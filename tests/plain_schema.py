"""A plain walk of a value along a JSON Schema, which the compiled form is held against."""

from __future__ import annotations


def check_schema(value: object, schema: dict, path: str = "$") -> list[str]:
    """Errors of a JSON value against the part of JSON Schema that the case schema uses."""
    import re

    kinds = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None), "integer": int, "number": (int, float)}
    wanted = schema.get("type")
    wanted = [wanted] if isinstance(wanted, str) else wanted or []
    if wanted and not any(isinstance(value, kinds[k]) and not (k in ("integer", "number") and isinstance(value, bool)) for k in wanted):
        return [f"{path}: expected {'/'.join(wanted)}, got {type(value).__name__}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{path}: {value!r} is not one of {schema['enum']}")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            out.append(f"{path}: shorter than {schema['minLength']}")
        if len(value) > schema.get("maxLength", len(value)):
            out.append(f"{path}: longer than {schema['maxLength']}")
        if "pattern" in schema and not re.search(schema["pattern"], value):
            out.append(f"{path}: doesn't match {schema['pattern']}")
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value):
            out.append(f"{path}: below {schema['minimum']}")
        if value > schema.get("maximum", value):
            out.append(f"{path}: above {schema['maximum']}")
    elif isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{path}.{k}: required" for k in schema.get("required", []) if k not in value]
        if schema.get("additionalProperties") is False:
            out += [f"{path}.{k}: not allowed" for k in value if k not in known]
        for k, v in value.items():
            if k in known:
                out += check_schema(v, known[k], f"{path}.{k}")
    elif isinstance(value, list) and "items" in schema:
        for i, v in enumerate(value):
            out += check_schema(v, schema["items"], f"{path}[{i}]")
    return out
