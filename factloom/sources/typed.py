"""Typed tables: declared record types with versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.operators.grouped import top_per_key
from factloom.schema import schema_fingerprint, struct_from_json_schema


def table_name(source: str, record_type: str, version: str) -> str:
    return f"{source}_{record_type}_{version.replace('.', '_')}"


def _typed(text: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return F.from_json(text, kind.simpleString())
    return text.try_cast(kind)


def project_typed(records: DataFrame, schema: dict) -> DataFrame:
    """Metadata of records as the columns a schema declares; values that do not fit become null."""
    bag = F.col("metadata")
    fields = struct_from_json_schema(schema).fields
    return records.select(
        "record_id", *[_typed(bag[f.name], f.dataType).alias(f.name) for f in fields]
    )


def write_typed_table(
    records: DataFrame, base: str, source: str, record_type: str, version: str, schema: dict
) -> str:
    """Appends records of a type to the folder of their version and returns the folder."""
    name = table_name(source, record_type, version)
    typed = project_typed(records.filter(F.col("type") == record_type), schema)
    typed.write.mode("append").parquet(f"{base}/{name}")
    return f"{base}/{name}"


def register_schema(source: str, record_type: str, version: str, schema: dict) -> tuple:
    """The registry row of a version: (source, record_type, version, table_name, schema_hash)."""
    name = table_name(source, record_type, version)
    return (source, record_type, version, name, schema_fingerprint(schema))


def active_typed_tables(schemas: DataFrame) -> DataFrame:
    """The newest table per (source, record type)."""
    return top_per_key(
        schemas,
        ["source", "record_type"],
        [F.col("created_at").desc_nulls_last(), F.col("table_name").desc()],
        1,
    )


def all_typed_tables(schemas: DataFrame) -> DataFrame:
    return schemas.select("table_name").distinct()
