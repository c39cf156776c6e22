"""Ordered extracts: order across files, counts, checksums, hot values and awkward texts."""

from __future__ import annotations

import csv
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from laborloom.sources import extracts

SCHEMA = "name string, day date, value double"


@pytest.fixture(scope="module")
def table(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("n"), (F.col("id") * 7919 % 997).cast("string"))).alias("name"),
        F.date_add(F.lit("2001-01-01").cast("date"), (F.col("id") % 50).cast("int")).alias("day"),
        (F.col("id") / 8).alias("value"),
    )
    odd = spark.createDataFrame([('a "quoted", name', None, 1.5), ("two\nlines", None, None), (None, None, -0.0)], SCHEMA)
    return rows.unionByName(odd).unionByName(odd)


def _plain(path):
    """Rows of all files in the order of their numbers, read without Spark."""
    found = []
    for file in sorted(Path(path).glob("part-*.csv")):
        with file.open(newline="") as lines:
            found.append(list(csv.reader(lines))[1:])
    return found


def test_files_follow_one_order(spark, table, tmp_path):
    path = str(tmp_path / "extract")
    manifest = extracts.write_extract(table, path, ["name", F.col("day").desc()], files=6).collect()
    files = _plain(path)
    assert len(files) == len(manifest) == 6 and [len(f) for f in files] == [r["rows"] for r in manifest]
    assert sum(map(len, files)) == 3006 and max(map(len, files)) < 1500  # the hot name is spread
    rows = [r for f in files for r in f]
    for a, b in zip(rows, rows[1:]):
        assert a[0] < b[0] or (a[0] == b[0] and (a[1] or "") >= (b[1] or ""))
    back = extracts.read_extract(spark, path, SCHEMA).orderBy("place").collect()
    assert [r["place"] for r in back] == list(range(1, 3007))
    assert [(r["name"] or "", str(r["day"] or "")) for r in back] == [(r[0], r[1]) for r in rows]
    assert sorted(map(str, (tuple(r)[:3] for r in back))) == sorted(map(str, (tuple(r) for r in table.collect())))


def test_the_manifest_shows_damage(spark, table, tmp_path):
    path = str(tmp_path / "extract")
    extracts.write_extract(table, path, ["name"], files=4)
    assert extracts.check_extract(spark, path, table.columns).filter("sound").count() == 4
    first, second = sorted(Path(path).glob("part-*.csv"))[:2]
    for crc in Path(path).glob(".part-*.crc"):
        crc.unlink()
    first.write_text(first.read_text().replace("hot", "hat", 1) if "hot" in first.read_text() else first.read_text().replace("n", "m", 2))
    lines = second.read_text().splitlines(keepends=True)
    second.write_text("".join(lines[:-1]))
    found = {r["number"]: r["sound"] for r in extracts.check_extract(spark, path, table.columns).collect()}
    assert found == {0: False, 1: False, 2: True, 3: True}


def test_rewriting_and_empty_tables(spark, table, tmp_path):
    path = str(tmp_path / "extract")
    extracts.write_extract(table, path, ["name"], files=5)
    extracts.write_extract(table.limit(7), path, ["value"], files=2)
    assert extracts.read_extract(spark, path, SCHEMA).count() == 7
    extracts.write_extract(table.filter("value > 1e9"), path, ["value"])
    assert extracts.read_extract(spark, path, SCHEMA).count() == 0
    assert extracts.check_extract(spark, path, table.columns).count() == 0
