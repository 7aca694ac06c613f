"""Positional and dotted paths into rows: ``(1, 0)``, ``"o_orderkey"``, ``"left.num.2"``; SELF is the whole row.

A position beyond the end of an array, or of a row, is null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SELF = "*"
Path = int | str | tuple


def steps(path: Path) -> tuple:
    if isinstance(path, tuple):
        return path
    if isinstance(path, int):
        return (path,)
    return tuple(int(p) if p.isdigit() else p for p in path.split("."))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def find(schema: T.StructType, path: Path, root: Column | None = None) -> tuple[Column, T.DataType]:
    """The column at a path, and its type; null of type void where a position doesn't exist."""
    if path == SELF or path == ():
        return (F.struct(*[F.col(quoted(n)) for n in schema.names]) if root is None else root), schema
    column, kind = root, schema
    for step in steps(path):
        if isinstance(kind, T.StructType):
            if isinstance(step, int):
                if step >= len(kind.fields):
                    return F.lit(None), T.NullType()
                step = kind.fields[step].name
            if step not in kind.names:
                raise KeyError(f"no column {step} in {kind.simpleString()}")
            column = F.col(quoted(step)) if column is None else column.getField(step)
            kind = kind[step].dataType
        elif isinstance(kind, T.ArrayType) and isinstance(step, int):
            column, kind = F.get(column, F.lit(step)), kind.elementType
        elif isinstance(kind, T.StringType) and isinstance(step, int):
            column = F.nullif(F.substring(column, step + 1, 1), F.lit(""))
        else:
            raise KeyError(f"{step} doesn't lead into {kind.simpleString()}")
    return column, kind
