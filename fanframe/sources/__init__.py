"""Edges to pandas: frames with their index as an explicit order column."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

ORDER = "row_order"


def from_pandas(spark: SparkSession, pdf: pd.DataFrame, index: str = "row_index") -> DataFrame:
    """The frame's columns, its index and each row's position (row_order)."""
    flat = pdf.rename_axis(index).reset_index()
    return spark.createDataFrame(flat.assign(**{ORDER: range(len(flat))}))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
