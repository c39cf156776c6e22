"""Joins that keep one very large key from landing in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPLITS = 16


def spread_join(
    rows: DataFrame, dimension: DataFrame, key: str, spread: str, how: str = "inner", splits: int = SPLITS
) -> DataFrame:
    """Join rows to a dimension with at most one row per ``key``.

    Rows choose one of ``splits`` parts of their key by the hash of ``spread``;
    each dimension row is repeated once per part. A location with a third of
    all rows is so shared by ``splits`` tasks. Meant for dimensions that are
    small next to the rows, such as location labels.
    """
    parts = F.sequence(F.lit(0), F.lit(splits - 1))
    split_rows = rows.withColumn("_part", F.pmod(F.hash(spread), F.lit(splits)))
    copies = dimension.withColumn("_part", F.explode(parts))
    return split_rows.join(copies, [key, "_part"], how).drop("_part")
