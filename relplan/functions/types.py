"""Type names of the engine, and the Spark types that hold them.

Widths and signs that Spark's types don't carry are kept in the metadata of a field.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTS = ((1, T.ByteType), (2, T.ShortType), (4, T.IntegerType), (8, T.LongType))
_SQL = {"BOOL": "BIT_FIELD[1]", "BOOLEAN": "BIT_FIELD[1]", "SMALLINT": "INT[2]", "INTEGER": "INT[4]", "REAL": "FLOAT[4]", "DOUBLE": "FLOAT[8]", "TEXT": "STRING", "CHAR": "STRING", "VARCHAR": "STRING", "CLOB": "STRING", "BLOB": "BINARY", "NUMBER": "NUMERIC", "DECIMAL": "NUMERIC", "JSON": "JSONB"}


def signed(width: int) -> T.DataType:
    """The smallest Spark integer of at least ``width`` bytes."""
    return next((kind() for n, kind in _INTS if n >= width), T.DecimalType(38, 0))


def parse(name: str) -> tuple[T.DataType, dict]:
    """Spark type and metadata for a type name such as ``UINT[4]``, ``ARRAY[INT[2]]``, ``BIGINT(16)`` or ``VARCHAR(20)``."""
    text = name.strip().upper()
    if m := re.fullmatch(r"ARRAY\s*\[(.*)\]", text, re.S):
        inner, meta = parse(m[1])
        return T.ArrayType(inner), {"element": meta}
    m = re.fullmatch(r"(\w+)\s*(?:[\[(]\s*([\w\s,]*)[\])])?", text)
    if not m:
        raise TypeError(f"unsupported type {name}")
    base, args = m[1], [a.strip() for a in (m[2] or "").split(",") if a.strip()]
    number = int(args[0]) if args and args[0].isdigit() else None
    if base in ("INT", "BIGINT") and text != base and "(" in text:
        base = ("LARGE_" if base == "BIGINT" else "") + ("UINT" if "UNSIGNED" in args else "INT")
    elif base == "BIT" and number:
        base = "BIT_FIELD"
    elif base == "BIGINT":
        base, number = "INT", 8
    elif base == "INT" and number is None:
        number = 4
    elif base == "FLOAT" and number is None:
        number = 8
    elif base in _SQL:
        return parse(_SQL[base])
    if base == "BIT_FIELD" and number and 1 <= number <= 64:
        kind = T.BooleanType() if number == 1 else T.LongType() if number < 64 else T.DecimalType(20, 0)
        return kind, {"bits": number}
    if base == "INT" and number and 1 <= number <= 8:
        return signed(number), {"width": number, "unsigned": False}
    if base == "UINT" and number and 1 <= number <= 8:
        return (signed(number + 1) if number < 8 else T.DecimalType(20, 0)), {"width": number, "unsigned": True}
    if base in ("LARGE_INT", "LARGE_UINT") and number and 1 <= number <= 32:
        return T.DecimalType(38, 0), {"width": number, "unsigned": base == "LARGE_UINT"}
    if base == "FLOAT" and number in (4, 8):
        return (T.FloatType() if number == 4 else T.DoubleType()), {"width": number}
    if base == "STRING":
        return T.StringType(), {}
    if base == "BINARY":
        return T.BinaryType(), {}
    if base == "NUMERIC":
        return T.DecimalType(38, 18), {}
    if base == "JSONB":
        return T.VariantType(), {}
    raise TypeError(f"unsupported type {name}")


def field(name: str, type_name: str, nullable: bool = True) -> T.StructField:
    kind, meta = parse(type_name)
    return T.StructField(name, kind, nullable, meta | {"type": type_name})


def schema(**columns: str) -> T.StructType:
    """A schema from column names and type names."""
    return T.StructType([field(n, t) for n, t in columns.items()])


def bounds(kind: T.DataType, meta: dict) -> tuple[int, int] | None:
    """Least and greatest value of an integer type."""
    if "bits" in meta:
        return 0, 2 ** meta["bits"] - 1
    if "width" in meta and not isinstance(kind, (T.FloatType, T.DoubleType)):
        bits = 8 * meta["width"]
        return (0, min(2**bits, 10**38) - 1) if meta["unsigned"] else (-min(2 ** (bits - 1), 10**38 - 1), min(2 ** (bits - 1), 10**38) - 1)
    return None


def family(kind: T.DataType) -> str:
    """What a type may be compared, joined and inserted with."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType, T.BooleanType)):
        return "number"
    for cls, name in ((T.StringType, "string"), (T.BinaryType, "binary"), (T.NullType, "null"), (T.StructType, "tuple"), (T.ArrayType, "array"), (T.VariantType, "json")):
        if isinstance(kind, cls):
            return name
    return kind.simpleString()


def comparable(a: T.DataType, b: T.DataType) -> bool:
    """Whether operators may compare values of the two types; tuples and arrays element by element."""
    one, two = family(a), family(b)
    if "null" in (one, two):
        return True
    if one != two or one == "json":
        return False
    if one == "tuple":
        return len(a.fields) == len(b.fields) and all(comparable(x.dataType, y.dataType) for x, y in zip(a.fields, b.fields, strict=True))
    return comparable(a.elementType, b.elementType) if one == "array" else True


def in_range(value: Column, limits: tuple[int, int]) -> Column:
    low, high = (F.lit(str(x)).cast("decimal(38,0)") for x in limits)
    return value.between(low, high)
