"""Session settings the operators are designed for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Runtime re-planning does the size-dependent choices: it coalesces small
# shuffle partitions, splits skewed ones and swaps in broadcast joins only
# when the measured side is below the threshold.
RUNTIME = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Skips call-site capture for every column expression built in Python.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def cluster_settings(total_cores: int) -> dict[str, str]:
    """Settings for a large cluster, to pass to spark-submit or the builder.

    Shuffles start with a few partitions per core and are then coalesced to the
    advisory size, so small reports do not pay for the partition count that the
    event-level aggregates need.
    """
    return {
        **RUNTIME,
        "spark.sql.shuffle.partitions": str(3 * total_cores),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
        "spark.sql.files.maxPartitionBytes": "256m",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256m",
    }


def local_session(cpus: int | str = 8, memory: str = "8g", extra: dict | None = None) -> SparkSession:
    """Session for tests and the bench; clusters bring their own sizing."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("laborloom")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus).replace("*", "8"))
    )
    for key, value in {**RUNTIME, **(extra or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
