"""Canonical JSON of nested values: names in order, nulls kept, whatever the columns' types and order; equal texts mean equal values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_safe(value: Column, kind: T.DataType) -> Column:
    """``value`` with all that JSON can't name made text: keys of maps at any depth, intervals; bytes, dates and odd numbers become text in :func:`canonical_json`."""
    if isinstance(kind, T.StructType):
        fields = [json_safe(value[f.name], f.dataType).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: json_safe(x, kind.elementType))
    if isinstance(kind, T.MapType):
        entries = F.transform(F.map_entries(value), lambda e: F.struct(e["key"].cast("string").alias("key"), json_safe(e["value"], kind.valueType).alias("value")))
        return F.map_from_entries(entries)
    if isinstance(kind, (T.DayTimeIntervalType, T.YearMonthIntervalType)):
        return value.cast("string")
    return value


def canonical_json(fields: dict[str, tuple[Column, T.DataType]]) -> Column:
    """One object of named values with their types, as canonical JSON."""
    return F.to_json(F.to_variant_object(F.struct(*[json_safe(c, kind).alias(name) for name, (c, kind) in fields.items()])))


def canonical_row(rows: DataFrame, leave_out: tuple[str, ...] = ()) -> Column:
    """Canonical JSON of all columns of ``rows`` but some."""
    return canonical_json({f.name: (F.col(f"`{f.name}`"), f.dataType) for f in rows.schema.fields if f.name not in leave_out})
