"""Reading, staging and small column helpers shared by the training-data operators."""

from __future__ import annotations

import sys
import tempfile
from uuid import uuid4

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Executors need not have this package installed: functions used in tasks travel with them.
cloudpickle.register_pickle_by_value(sys.modules["laborloom.llm"])

# The characters that separate words, and the pattern of a run of them.
SPACES = " \t\n\x0b\x0c\r"
GAPS = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; one of this process only where the session names none and runs locally."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="laborloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{spark.sparkContext.applicationId}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, survives lost executors, computes once."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*staged: DataFrame | None) -> None:
    """Delete tables that saved() has staged, once what was made from them has been written."""
    for df in staged:
        if df is not None:
            spark = df.sparkSession
            # All files of such a table lie in one folder.
            for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()[:1]}:
                if f"/{spark.sparkContext.applicationId}/" in folder:
                    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
                    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Delete what saved() has staged in this application; call it when its results have been written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Whole words of a text in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAPS), "")


def crc_mod(key: str, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``; -1 for a null key, which is so never held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % parts, F.lit(-1))


def hash_share(key: str, seed: int) -> Column:
    """A number from 0 to 1 that depends on the key's value alone."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 30)) / float(1 << 30)


NO_KEY = -(1 << 63)


def with_key(key: str) -> Column:
    """The key as a long that Python tasks can carry: a null one as NO_KEY."""
    return F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY))


def without_key(column: str) -> Column:
    return F.when(F.col(column) != NO_KEY, F.col(column))


def by_ids(rows: DataFrame, ids: DataFrame, on: str, how: str, most: int = 1_000_000) -> DataFrame:
    """Semi or anti join with a table of distinct ids: sent to all tasks if counted to be few, else shuffled."""
    few = ids.limit(most + 1).count() <= most
    return rows.join(F.broadcast(ids) if few else ids, on, how)


def sample_of(df: DataFrame, key: str, rows: int, seed: int = 11) -> DataFrame:
    """About ``rows`` rows at most, chosen by their key's hash: the bounded sample a model may be fitted on."""
    total = df.count()
    return df if total <= rows else df.filter(hash_share(key, seed) < rows / total)
