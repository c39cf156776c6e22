"""Result writers."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def replace_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), files_per_partition: int = 8) -> None:
    """Rebuild a parquet table.

    With partition columns only the partitions present in ``df`` are replaced,
    so one benchmark year or one date range is rebuilt without touching the
    rest. A partition is written by ``files_per_partition`` tasks that share its
    rows by row hash: the file count is bounded, and neither a large partition
    nor a large location in it goes through a single task.
    """
    if not partition_by:
        df.write.mode("overwrite").parquet(path)
        return
    others = [F.col(name) for name in df.columns if name not in partition_by]
    part = F.pmod(F.xxhash64(*others), F.lit(files_per_partition))
    (
        df.repartition(*partition_by, part)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_by)
        .parquet(path)
    )


def _at(spark: SparkSession, path: str):
    """A Hadoop path and its file system, whatever store the path names."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def table_exists(spark: SparkSession, path: str) -> bool:
    found, system = _at(spark, path)
    return system.exists(found)


def remove_table(spark: SparkSession, path: str) -> None:
    found, system = _at(spark, path)
    system.delete(found, True)


def list_folder(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies directly in a folder, in order."""
    found, system = _at(spark, path)
    return sorted(entry.getPath().getName() for entry in system.listStatus(found))


def rename_table(spark: SparkSession, source: str, target: str) -> None:
    (old, system), (new, _) = _at(spark, source), _at(spark, target)
    if not system.rename(old, new):
        raise OSError(f"could not rename {source} to {target}")


def replace_partitions(df: DataFrame, path: str, column: str, values: Iterable, files_per_partition: int = 8) -> None:
    """Make ``df`` the content of the partitions ``values`` of a table: they are replaced, or removed where it has no rows.

    Other partitions stay untouched, so ``df`` may hold rows of ``values`` only. It must not read the partitions it
    replaces; stage it first.
    """
    wanted = set(values)
    # One row for each partition.
    present = {r[0] for r in df.select(column).distinct().collect()}
    if not present <= wanted:
        raise ValueError(f"rows of {column} {sorted(present - wanted)[:3]} lie outside the partitions to replace")
    if present:
        replace_table(df, path, [column], files_per_partition)
    for value in wanted - present:
        remove_table(df.sparkSession, f"{path}/{column}={value}")


def replace_saved_table(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> None:
    """CREATE OR REPLACE TABLE AS for a catalog table."""
    df.write.mode("overwrite").partitionBy(*partition_by).saveAsTable(name)


def write_csv(df: DataFrame, path: str, header: bool = True) -> None:
    """Report export. Report frames are aggregates, so they keep Spark's
    partitioning instead of being forced through a single task."""
    df.write.mode("overwrite").option("header", str(header).lower()).csv(path)
