"""Table scans with date pruning."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def between_dates(df: DataFrame, column: str, start: date | None = None, end: date | None = None) -> DataFrame:
    """Keep days start..end using the raw column, so partitions and row groups prune.

    For a timestamp column the upper bound becomes "before the next midnight",
    which avoids wrapping the column in a function.
    """
    kind = df.schema[column].dataType.typeName()
    if start is not None:
        df = df.filter(F.col(column) >= F.lit(start))
    if end is not None and kind == "date":
        df = df.filter(F.col(column) <= F.lit(end))
    elif end is not None:
        df = df.filter(F.col(column) < F.date_add(F.lit(end), 1))
    return df


def date_span(df: DataFrame, column: str) -> tuple[date, date] | None:
    """First and last day of a date or timestamp column, None for a table without any; reads that column alone."""
    day = F.to_date(column)
    first, last = df.agg(F.min(day), F.max(day)).first()
    return None if first is None else (first, last)


def scan(
    spark: SparkSession,
    path: str,
    date_column: str | None = None,
    start: date | None = None,
    end: date | None = None,
    source: str = "parquet",
) -> DataFrame:
    """Read a table by path, or by name with ``source="table"``."""
    df = spark.table(path) if source == "table" else spark.read.format(source).load(path)
    return between_dates(df, date_column, start, end) if date_column else df


def jdbc_scan(
    spark: SparkSession,
    url: str,
    table: str,
    split_column: str,
    bounds: tuple,
    splits: int,
    options: dict | None = None,
) -> DataFrame:
    """Roster tables kept in a relational database.

    ``split_column``, its bounds and the number of splits are required, since
    without them the whole table would come through one task. Filters are
    pushed to the database.
    """
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    low, high = bounds
    reader = (
        reader.option("partitionColumn", split_column)
        .option("lowerBound", str(low))
        .option("upperBound", str(high))
        .option("numPartitions", str(splits))
    )
    return reader.options(**(options or {})).load()


def union_years(tables: dict[int, DataFrame]) -> DataFrame:
    """Yearly tables as one table tagged with ``yr``."""
    tagged = [df.withColumn("yr", F.lit(year)) for year, df in sorted(tables.items())]
    return reduce(lambda left, right: left.unionByName(right), tagged)


def register_views(views: dict[str, DataFrame]) -> None:
    """Expose frames to SQL users under short names."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
