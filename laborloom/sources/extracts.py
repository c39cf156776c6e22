"""Ordered extracts: a total order kept across numbered files, with a manifest.

Rows are dealt by ranges of the order to as many files as asked for, so the first
row of a file follows the last one of the file before, and no task holds more than
one file. A hash of the whole row ends the order: it makes it total, and a value
shared by very many rows still spreads over files. The manifest has a row for each
file: its number of rows, a checksum of their content and the order of reading.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from laborloom.operators.reuse import staging
from laborloom.sources.sinks import list_folder, remove_table, rename_table

# Numbers that survive a round through text, for checksums that are summed.
MODULUS = (1 << 31) - 1
MANIFEST = "file string, number int, rows long, checksum long"


def _shown(df: DataFrame) -> DataFrame:
    """All columns as the text that a CSV file holds."""
    return df.select([F.col(name).cast("string").alias(name) for name in df.columns])


def _content(columns: Sequence[str]) -> Column:
    """A row's share of the checksum; null and the empty text, which CSV readers may not tell apart, count alike."""
    return F.pmod(F.xxhash64(*[F.coalesce(F.col(name), F.lit("")) for name in columns]), F.lit(MODULUS))


def write_extract(df: DataFrame, path: str, order: Sequence[str | Column], files: int = 16) -> DataFrame:
    """Write CSV files ``part-00000.csv``, ``part-00001.csv``, ... in order, and the manifest; returns the manifest.

    The rows are ordered once, in a staged table that also gives the manifest, so file contents and manifest cannot
    differ however often a task is tried.
    """
    spark = df.sparkSession
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    # Equal rows share a hash; those alone may stay together.
    total = [*keys, F.xxhash64(*df.columns)]
    with staging(spark, "extract") as stage:
        ranged = df.repartitionByRange(files, *total).sortWithinPartitions(*total)
        numbered = ranged.select("*", F.spark_partition_id().alias("__file"), F.monotonically_increasing_id().alias("__place"))
        dealt = stage.put(numbered, "rows")
        text = _shown(dealt.drop("__file", "__place"))
        counted = dealt.select("__file", *text.columns).withColumns({name: F.col(name).cast("string") for name in text.columns})
        sizes = counted.groupBy("__file").agg(F.count(F.lit(1)).alias("rows"), F.sum(_content(text.columns)).alias("checksum"))
        # One row for each file.
        found = {r["__file"]: r for r in sizes.collect()}
        remove_table(spark, path)
        # A file's rows are sorted by their places, since a staged file may be read in pieces.
        ready = dealt.repartition("__file").sortWithinPartitions("__file", "__place").drop("__place")
        ready.write.partitionBy("__file").option("header", "true").option("escape", '"').csv(f"{path}/_files")
        rows = []
        for number, file in enumerate(sorted(found)):
            folder = f"{path}/_files/__file={file}"
            parts = [name for name in list_folder(spark, folder) if name.startswith("part-")]
            if len(parts) != 1:
                raise OSError(f"{folder} holds {len(parts)} files")
            name = f"part-{number:05d}.csv"
            rename_table(spark, f"{folder}/{parts[0]}", f"{path}/{name}")
            rows.append((name, number, found[file]["rows"], found[file]["checksum"]))
        remove_table(spark, f"{path}/_files")
    manifest = spark.createDataFrame(rows, MANIFEST).coalesce(1)
    manifest.write.mode("overwrite").json(f"{path}/_manifest")
    return manifest


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(f"{path}/_manifest")


def read_extract(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of an extract with ``place``, their number (from 1) in its order."""
    names = [r["file"] for r in read_manifest(spark, path).orderBy("number").collect()]
    plain = spark.read.schema(schema)
    if not names:
        return spark.createDataFrame([], schema).withColumn("place", F.lit(0).cast("long"))
    rows = plain.option("header", "true").option("escape", '"').option("multiLine", "true").csv([f"{path}/{n}" for n in names])
    # A multi-line file is read by one task from its first row to its last.
    rows = rows.select("*", F.regexp_extract(F.input_file_name(), "(part-[0-9]+[.]csv)$", 1).alias("file"), F.monotonically_increasing_id().alias("__at"))
    within = Window.partitionBy("file").orderBy("__at")
    before = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    starts = read_manifest(spark, path).select("file", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    placed = rows.withColumn("row", F.row_number().over(within)).join(starts, "file")
    return placed.withColumn("place", F.col("start") + F.col("row")).drop("__at", "row", "start", "file")


def check_extract(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """A row for each file of the manifest: what it should hold, what it holds, and whether both agree.

    ``columns`` are the file's, all read as text. A missing file shows as one without rows.
    """
    listed = read_manifest(spark, path)
    names = [name for name in list_folder(spark, path) if name.startswith("part-")]
    schema = ", ".join(f"`{name}` string" for name in columns)
    if names:
        rows = spark.read.schema(schema).option("header", "true").option("escape", '"').option("multiLine", "true")
        rows = rows.csv([f"{path}/{n}" for n in names])
        held = rows.groupBy(F.regexp_extract(F.input_file_name(), "(part-[0-9]+[.]csv)$", 1).alias("file")).agg(
            F.count(F.lit(1)).alias("held_rows"), F.sum(_content(columns)).alias("held_checksum")
        )
    else:
        held = spark.createDataFrame([], "file string, held_rows long, held_checksum long")
    both = listed.join(held, "file", "full")
    same = F.col("rows").eqNullSafe(F.col("held_rows")) & F.col("checksum").eqNullSafe(F.col("held_checksum"))
    return both.withColumn("sound", same)
