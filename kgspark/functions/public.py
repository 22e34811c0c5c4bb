"""Rows as an interface gives them out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The fields of a public retrieval hit and of a public conflict.
HIT = "document_id title score match_reason canonical_md untranslated canonical_hash source_lang verification_level terms entities provenance".split()
CONFLICT = "id entity_id property value_a value_b source_a source_b status suggestion resolved_by resolved_at created_at".split()


def iso(value: Column, kind: T.DataType) -> Column:
    """A date or time as ISO 8601: microseconds where there are any, the offset where the type has one."""
    if isinstance(kind, T.DateType):
        return F.date_format(value, "yyyy-MM-dd")
    micros = F.date_format(value, "SSSSSS")
    text = F.concat(F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)))
    return F.concat(text, F.date_format(value, "xxx")) if isinstance(kind, T.TimestampType) else text


def json_safe(value: Column, kind: T.DataType) -> Column:
    """A value with every date and time in it, however deep, as ISO text."""
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return iso(value, kind)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: json_safe(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda k, v: json_safe(v, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[json_safe(value[f.name], f.dataType).alias(f.name) for f in kind]))
    return value


def safe_rows(rows: DataFrame) -> DataFrame:
    """All columns as ``json_safe`` makes them."""
    return rows.select(*[json_safe(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in rows.schema])


def shaped(rows: DataFrame, fields: list[str]) -> DataFrame:
    """the public fields in their order, safe for JSON; those that rows do not have are null."""
    safe = safe_rows(rows.select(*[c for c in fields if c in rows.columns]))
    return safe.select(*[F.col(c) if c in safe.columns else F.lit(None).cast("string").alias(c) for c in fields])


def hits(rows: DataFrame) -> DataFrame:
    return shaped(rows, HIT)


def public_conflicts(rows: DataFrame) -> DataFrame:
    return shaped(rows.withColumn("resolved_by", F.col("resolved_by").cast("string")), CONFLICT)
