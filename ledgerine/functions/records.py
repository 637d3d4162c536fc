"""Values and rows in a given type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shaped(value: Column, own: T.DataType, wanted: T.DataType) -> Column:
    """A value in another type of records: fields by name, those it has not are null."""
    if isinstance(wanted, T.StructType) and isinstance(own, T.StructType):
        fields = {f.name: f.dataType for f in own}
        parts = [(shaped(value[f.name], fields[f.name], f.dataType) if f.name in fields else F.lit(None).cast(f.dataType)).alias(f.name) for f in wanted]
        return F.when(value.isNotNull(), F.struct(*parts))
    if isinstance(wanted, T.ArrayType) and isinstance(own, T.ArrayType):
        return F.transform(value, lambda x: shaped(x, own.elementType, wanted.elementType))
    return value.cast(wanted)


def conformed(rows: DataFrame, wanted: T.StructType) -> DataFrame:
    """Rows in a schema: columns by name, nested fields too; absent ones are null, and one that the schema has not is an error."""
    types = {f.name: f.dataType for f in rows.schema}
    if unknown := [n for n in types if n not in wanted.names]:
        raise ValueError(f"no such columns: {', '.join(unknown)}")
    return rows.select(*[(shaped(F.col(f"`{f.name}`"), types[f.name], f.dataType) if f.name in types else F.lit(None).cast(f.dataType)).alias(f.name) for f in wanted])
