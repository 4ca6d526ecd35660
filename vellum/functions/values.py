"""Object values as Column expressions: coercion, integers from bytes, arrays in parts, JSON schemas of relations."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DataType, DoubleType, StringType, StructType

_PARTS = {"point": ("x", "y"), "rect": ("x0", "y0", "x1", "y1"), "matrix": ("a", "b", "c", "d", "e", "f")}


def coerce(obj: Column, kind: str) -> Column:
    """The value of an object, as the `obj` column writes it in JSON, in a kind; null where it isn't of that kind.

    Kinds: bool, int, uint, number, text, list (of JSON texts), dict (of JSON texts), stream (a dictionary's JSON),
    point, rect (its corners in order) and matrix.
    """
    if kind == "bool":
        return F.when(obj == "true", True).when(obj == "false", False)
    if kind in ("int", "uint"):
        return F.when(obj.rlike(r"^-?\d{1,18}$" if kind == "int" else r"^\d{1,18}$"), obj.cast("bigint"))
    if kind == "number":
        return F.when(obj.rlike(r"^-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?$"), obj.cast("double"))
    if kind == "text":
        return F.when(obj.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), obj, F.lit("}")), "$.v"))
    if kind == "list":
        return F.when(obj.startswith("["), F.from_json(obj, "array<string>"))
    if kind == "dict":
        return F.when(obj.startswith("{") & ~obj.startswith('{"stream":'), F.from_json(obj, "map<string,string>"))
    if kind == "stream":
        return F.when(obj.startswith('{"stream":'), F.get_json_object(obj, "$.stream"))
    names = _PARTS[kind]
    v = F.from_json(obj, "array<double>")
    x = [F.get(v, k) for k in range(len(names))]
    if kind == "rect":
        x = [F.least(x[0], x[2]), F.least(x[1], x[3]), F.greatest(x[0], x[2]), F.greatest(x[1], x[3])]
    whole = obj.startswith("[") & (F.size(v) == len(names)) & ~F.exists(v, lambda e: e.isNull())
    return F.when(whole, F.struct(*(c.alias(n) for c, n in zip(x, names, strict=True))))


def big_endian(raw: Column, default: int = 0) -> Column:
    """The unsigned integer of up to seven bytes; default for none."""
    return F.when(F.length(raw) == 0, F.lit(default).cast("bigint")).otherwise(F.conv(F.hex(raw), 16, 10).cast("bigint"))


def chunks(values: Column, size: int) -> Column:
    """An array in parts of so many; a last one of fewer is left out."""
    n = F.floor(F.size(values) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.slice(values, k * size + 1, size))).when(values.isNotNull(), F.slice(F.array(values), 1, 0))


def json_schema(kind: DataType, title: str | None = None) -> dict[str, Any]:
    """The JSON schema of what to_json writes of a type; nulls are left out there, so that nothing is required but what can't be null."""
    if isinstance(kind, StructType):
        out: dict[str, Any] = {"type": "object", "properties": {f.name: json_schema(f.dataType) for f in kind.fields}, "additionalProperties": False}
        if needed := [f.name for f in kind.fields if not f.nullable]:
            out["required"] = needed
    elif isinstance(kind, ArrayType):
        out = {"type": "array", "items": json_schema(kind.elementType)}
    elif isinstance(kind, BooleanType):
        out = {"type": "boolean"}
    elif isinstance(kind, DoubleType):
        out = {"type": "number"}
    elif isinstance(kind, BinaryType):
        out = {"type": "string", "contentEncoding": "base64"}
    else:
        out = {"type": "string" if isinstance(kind, StringType) else "integer"}
    return out | ({"title": title, "$schema": "https://json-schema.org/draft/2020-12/schema"} if title else {})
