"""Render values as feed text, natively (no Python hop).

* scalars           -> ``CAST(x AS STRING)``
* ``array<scalar>`` -> ``[a, b]``, empty ``[]``
* ``map``           -> ``{k=v, k2=v2}``
* ``struct``        -> ``{field=v, ...}`` with field names
* nested arrays     -> ``[{k=v}, {...}]``
* a null value inside a map/struct/array of nested values -> ``null_text`` (``None``);
  a null top-level value stays null.

Expressions are generated from the schema, so the same code renders every column of both
log tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

NULL_TEXT = "None"


def _is_nested(dt: T.DataType) -> bool:
    return isinstance(dt, (T.MapType, T.StructType)) or (
        isinstance(dt, T.ArrayType) and _is_nested(dt.elementType)
    )


def _render(c: Column, dt: T.DataType, null_text: str) -> Column:
    """String expression for ``c`` of type ``dt``; null in -> null out."""
    inner = lambda x, t: F.coalesce(_render(x, t, null_text), F.lit(null_text))
    if isinstance(dt, T.StringType):
        return c
    if isinstance(dt, T.MapType):
        entries = F.transform(
            F.map_entries(c),
            lambda e: F.concat(inner(e["key"], dt.keyType), F.lit("="), inner(e["value"], dt.valueType)),
        )
        return F.concat(F.lit("{"), F.array_join(entries, ", "), F.lit("}"))
    if isinstance(dt, T.StructType):
        parts = []
        for i, f in enumerate(dt.fields):
            if i:
                parts.append(F.lit(", "))
            parts += [F.lit(f"{f.name}="), inner(c[f.name], f.dataType)]
        body = F.concat(F.lit("{"), *parts, F.lit("}")) if parts else F.lit("{}")
        return F.when(c.isNull(), F.lit(None).cast("string")).otherwise(body)
    if isinstance(dt, T.ArrayType) and _is_nested(dt.elementType):
        items = F.transform(c, lambda x: inner(x, dt.elementType))
        return F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))
    # scalars and arrays of scalars: Spark's own cast text (``[a, b]``)
    return c.cast("string")


def render_column(df: DataFrame, name: str, null_text: str = NULL_TEXT) -> Column:
    return _render(F.col(name), df.schema[name].dataType, null_text).alias(name)


def render_nested(df: DataFrame, null_text: str = NULL_TEXT) -> DataFrame:
    """Nested columns (maps, structs, arrays) -> text; scalar columns keep their type."""
    cols = [
        render_column(df, f.name, null_text)
        if isinstance(f.dataType, (T.MapType, T.StructType, T.ArrayType)) else F.col(f.name)
        for f in df.schema.fields
    ]
    return df.select(*cols)


def csv_safe(df: DataFrame, null_text: str = NULL_TEXT) -> DataFrame:
    """Every column as text, names kept (the CSV feed's row form)."""
    return df.select(*[render_column(df, f.name, null_text) for f in df.schema.fields])
