"""Tables of the driver, and places that all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import new_path, shared_dir, written

__all__ = ["new_path", "shared_dir", "table", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
