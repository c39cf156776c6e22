"""Compute a shared intermediate once."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from laborloom.sources.sinks import remove_table


def shared_path(spark: SparkSession, name: str) -> str | None:
    """A fresh path in the cluster's shared folder, or None when it names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        return None
    return f"{folder.rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid4().hex}"


class Staging:
    """A folder of staged tables that are deleted together."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, shared_path(spark, name)
        if self.folder is None:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        self.names: list[str] = []

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` now and read it back."""
        path = f"{self.folder}/{len(self.names)}-{name}"
        self.names.append(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        remove_table(self.spark, self.folder)


@contextmanager
def staging(spark: SparkSession, name: str) -> Iterator[Staging]:
    """Staged tables that live as long as the block."""
    tables = Staging(spark, name)
    try:
        yield tables
    finally:
        tables.close()


class SharedFrames(Staging):
    """Tables staged for one report: each distinct plan once, all deleted at the end.

    Frames are told apart by their canonical plans, so two queries of a report that build the same aggregate on their
    own, from the same inputs, share one table. Inputs must not change while the report is made.
    """

    def __init__(self, spark: SparkSession):
        super().__init__(spark, "report")
        self.kept: dict[int, list[tuple[DataFrame, DataFrame]]] = {}

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        """The staged table of ``df``; written at the first call for its plan."""
        alike = self.kept.setdefault(df.semanticHash(), [])
        for known, staged in alike:
            if known.sameSemantics(df):
                # Column names may differ where values agree.
                return staged.toDF(*df.columns)
        staged = self.put(df, name)
        alike.append((df, staged))
        return staged


_ACTIVE: ContextVar[SharedFrames | None] = ContextVar("shared_frames", default=None)


@contextmanager
def shared_frames(spark: SparkSession) -> Iterator[SharedFrames]:
    """Within this block, queries share what they stage; results must be written before it ends.

    Blocks may nest: the outermost one owns the tables.
    """
    outer = _ACTIVE.get()
    if outer is not None:
        yield outer
        return
    frames = SharedFrames(spark)
    token = _ACTIVE.set(frames)
    try:
        yield frames
    finally:
        _ACTIVE.reset(token)
        frames.close()


def shared(df: DataFrame, name: str) -> DataFrame:
    """``df`` staged once for all queries of the enclosing :func:`shared_frames` block; lazy outside of one."""
    frames = _ACTIVE.get()
    return df if frames is None else frames.stage(df, name)


def computed_once(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the cluster's checkpoint folder and read it back.

    Two consumers of one aggregate usually prune it to different columns, which
    defeats exchange reuse and reads the events again for each of them. A table
    in the shared folder named by ``spark.checkpoint.dir`` is computed once,
    survives lost executors, stays columnar and has a known size for join
    planning. Where no folder is configured the plan simply stays lazy. Inside
    :func:`shared_frames` the table is the report's, and goes with it.
    """
    if _ACTIVE.get() is not None:
        return shared(df, name)
    path = shared_path(df.sparkSession, name)
    if path is None:
        return df
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
