"""Readers and checks for point tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..session import shared_dir

INVENTORY = "sample_id string, longitude double, latitude double"


def read_csv(spark: SparkSession, path: str, schema: str | StructType = INVENTORY) -> DataFrame:
    """CSV with a header and a declared schema; nothing is inferred."""
    return spark.read.schema(schema).option("header", True).csv(path)


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    table = spark.read.parquet(path)
    return table.select(*columns) if columns else table


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def require_columns(df: DataFrame, required: list[str]) -> DataFrame:
    """Raise with the list of absent columns."""
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"columns not in the table: {', '.join(missing)}")
    return df


def select_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Fixed output column order."""
    return require_columns(df, columns).select(*columns)


def round_trip_csv(df: DataFrame, schema: str | StructType | None = None) -> DataFrame:
    """Write as CSV and read back."""
    from .sinks import write_table

    path = shared_dir(df.sparkSession, "csv")
    write_table(df, path)
    return read_csv(df.sparkSession, path, schema or df.schema)


def landed_csv(inventory: DataFrame) -> DataFrame:
    return round_trip_csv(inventory.select("sample_id", "longitude", "latitude"), INVENTORY)
