"""Feature contract helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def select_feature_contract(df: DataFrame, features: list[str]) -> tuple[DataFrame, dict]:
    """pick and order columns by the stored feature list; report the mismatch.

    Missing features are reported (not invented); the selection uses the ones present.
    """
    present = set(df.columns)
    report = {"missing": [f for f in features if f not in present],
              "extra": sorted(present - set(features))}
    return df.select(*[f for f in features if f in present]), report


def align_columns(reference_columns: list[str], df: DataFrame, fill: float = 0.0) -> DataFrame:
    """give ``df`` exactly the reference's columns in order; absent ones filled with ``fill``."""
    have = set(df.columns)
    return df.select(*[(F.col(c) if c in have else F.lit(fill)).alias(c) for c in reference_columns])
