"""Frames shared by the queries of one report: staged once by plan, removed at the end."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from catalog.common import WINDOWS
from catalog.quality_queries import report
from laborloom.operators.reuse import shared, shared_frames
from laborloom.plans.publish import export_monthly, published_overview
from tests.conftest import SF_DIR


def _folders(spark):
    root = Path(spark.conf.get("spark.checkpoint.dir"), spark.sparkContext.applicationId)
    return {p.name for p in root.glob("report-*")} if root.exists() else set()


def test_equal_plans_share_one_table(spark):
    def total(column):
        rows = spark.read.parquet(f"{SF_DIR}/lineitem.parquet")
        return rows.groupBy("l_suppkey").agg(F.sum(column).alias("s"))

    before = _folders(spark)
    with shared_frames(spark) as frames:
        one, two, other = (shared(total(c), c) for c in ("l_quantity", "l_quantity", "l_tax"))
        assert frames.names == ["l_quantity", "l_tax"]
        assert one.inputFiles() == two.inputFiles() != other.inputFiles()
        with shared_frames(spark) as inner:
            assert inner is frames
        assert one.count() > 0
        assert len(_folders(spark) - before) == 1
    assert _folders(spark) == before
    assert shared(total("l_tax"), "x").inputFiles() == spark.read.parquet(f"{SF_DIR}/lineitem.parquet").inputFiles()


def test_a_failed_report_leaves_nothing(spark):
    before = _folders(spark)
    with pytest.raises(RuntimeError), shared_frames(spark):
        shared(spark.range(3), "r").count()
        raise RuntimeError("report failed")
    assert _folders(spark) == before


def test_overview_stages_each_aggregate_once(spark, tmp_path):
    before, made = _folders(spark), report(spark, SF_DIR)
    with shared_frames(spark) as frames:
        cards = made.overview(WINDOWS)
        made.labor(WINDOWS), made.wages(), made.hiring(), made.turnover()
        assert sorted(frames.names) == ["hiring", "job-pay", "labor", "location-info", "turnover"]
        shown = sorted(map(str, cards.collect()))
    assert _folders(spark) == before
    written = published_overview(made, WINDOWS, str(tmp_path / "overview"))
    assert sorted(map(str, written.collect())) == shown == sorted(map(str, made.overview(WINDOWS).collect()))
    assert _folders(spark) == before
    export_monthly(made, str(tmp_path / "report"), WINDOWS, None)
    assert _folders(spark) == before
