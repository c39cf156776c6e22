"""Tables whose stored order saves shuffles: bucketed by the keys that joins and windows share."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Bucketed:
    """A parquet table under ``path``, known to the session as ``name``, in ``buckets`` by the hash of ``by``.

    Tables with the same bucket count and the same key meet without an exchange, and a window or aggregate whose keys
    include ``by`` needs none either. A key that may hold a large share of the rows belongs in ``by`` together with a
    part number (:func:`part_of`), else one bucket holds it all.
    """

    name: str
    path: str
    by: tuple[str, ...]
    buckets: int
    sort: tuple[str, ...] = ()

    def write(self, df: DataFrame) -> DataFrame:
        """Replace the table. Rows go through one shuffle by ``by``, so each bucket is one file."""
        spread = df.repartition(self.buckets, *self.by)
        writer = spread.write.mode("overwrite").format("parquet").option("path", self.path)
        # Columns are plain names, so the table's schema is that of the rows.
        writer.bucketBy(self.buckets, *self.by).sortBy(*(self.sort or self.by)).saveAsTable(self.name)
        return df.sparkSession.table(self.name)

    def read(self, spark: SparkSession) -> DataFrame:
        """The table; in a session that does not know it yet, it is declared over the stored files first."""
        if not spark.catalog.tableExists(self.name):
            stored = spark.read.parquet(self.path).schema
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stored)
            spark.sql(
                f"CREATE TABLE {self.name} ({columns}) USING parquet CLUSTERED BY ({', '.join(self.by)}) "
                f"SORTED BY ({', '.join(self.sort or self.by)}) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
            )
        return spark.table(self.name)

    def drop(self, spark: SparkSession) -> None:
        """Forget the table; its files stay."""
        spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def part_of(column: str, parts: int) -> Column:
    """The part of its key's rows that a row belongs to, by the hash of another column."""
    return F.pmod(F.xxhash64(column), F.lit(parts)).cast("int")


def in_every_part(df: DataFrame, parts: int, into: str = "part") -> DataFrame:
    """Each row once for every part: the narrow side of a join with rows dealt by :func:`part_of`."""
    return df.withColumn(into, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

