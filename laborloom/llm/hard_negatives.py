"""Hard negatives by segment summary filtering.

Vectors are scaled to integers and cut into segments of 64, 16 and 4 components.
For each segment the index stores its mean and its deviation (the length of
what is left without the mean). With L components a segment, the inner product
of two vectors is at most, and at least,

    sum over segments of  L * mean * mean'  plus, or minus,  deviation * deviation'

so summaries alone bound a score from both sides. For an anchor, rows whose
bounds exclude them are dropped under the widest segments first, the rest are
bounded again under narrower ones, and only what is left is scored exactly.

* Positives: the k-th largest lower bound among rows of the anchor's label is a
  floor; rows with a smaller upper bound go.
* Negatives: each positive's score gives a band; rows whose bounds miss every
  band go, and so do those below the k-th largest lower bound of rows that are
  certain to lie in it.

Rows and anchors are dealt by hash into blocks of ``block_rows`` and
``anchor_rows``; every block of the one meets every block of the other in a task
of its own, which gives the first few rows of each anchor. So no label, however
frequent, and no number of equal vectors fills a task. Scores are exact 64-bit
integers.

Edge cases: rows whose id, label or vector is null, or whose vector holds a null
or non-finite component, take no part; rows that share an id count once, the
smallest by label, then components; shorter vectors count as filled up with
zeros; an empty vector scores 0; equal scores go by the smaller id; anchors
without another row of their label, or with none in the band, give no rows; an
empty table gives no rows; other columns do not take part.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laborloom.llm.common import saved

LENGTHS = (64, 16, 4)  # components of a segment, from coarse to fine
WIDTH = LENGTHS[0]
FIRST = "anchor_id long, vec_id long, score long"
SECOND = "anchor_id long, positive_id long, positive_score long, vec_id long, score long"


def usable(vector: Column) -> Column:
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def summaries(x: np.ndarray) -> np.ndarray:
    """Means, then deviations, of all segments, for each length."""
    found = []
    for length in LENGTHS:
        parts = x.astype(float).reshape(len(x), -1, length)
        mean = parts.mean(axis=2)
        found += [mean, np.sqrt(((parts - mean[:, :, None]) ** 2).sum(axis=2))]
    return np.concatenate(found, axis=1)


def matrix(table: pa.Table, column: str) -> np.ndarray:
    """A column of arrays of one length."""
    flat = pa.concat_arrays([chunk.flatten() for chunk in table.column(column).chunks]).to_numpy(zero_copy_only=False)
    return flat.reshape(table.num_rows, -1)


class Block:
    """Rows of a block with their summaries by level."""

    def __init__(self, table: pa.Table):
        order = np.argsort(table.column("vec_id").to_numpy(), kind="stable")
        self.ids = table.column("vec_id").to_numpy()[order]
        self.label = table.column("label").to_numpy()[order]
        self.x = matrix(table, "x")[order]
        stored, at = matrix(table, "summary")[order], 0
        self.levels = []
        for length in LENGTHS:
            n = self.x.shape[1] // length
            # The mean times the root of L: products of two such are L * mean * mean'.
            self.levels.append((np.ascontiguousarray(stored[:, at : at + n]) * length**0.5, np.ascontiguousarray(stored[:, at + n : at + 2 * n])))
            at += 2 * n
        self.norm = np.sqrt((self.x.astype(float) ** 2).sum(axis=1))
        self.largest = float(np.abs(self.x).max(initial=0))


def products(rows: np.ndarray, chosen: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Products of the chosen rows with one vector; all rows at once where most are chosen."""
    return (rows @ one)[chosen] if 2 * len(chosen) > len(rows) else rows[chosen] @ one


class Search:
    """One block of rows against anchors of a block, from coarse bounds to exact scores."""

    def __init__(self, rows: Block, anchors: Block):
        self.rows, self.anchors = rows, anchors
        # Sums of whole numbers below 2^53 are exact as doubles, and faster.
        self.exact = rows.x.astype(float) if rows.largest * anchors.largest * rows.x.shape[1] < 2**53 else rows.x
        self.most = rows.norm.max(initial=0)

    def bounded(self, i: int, chosen: np.ndarray, drop: Callable) -> np.ndarray:
        """The rows that ``drop(lower, upper)`` keeps under every level's bounds for the anchor ``i``."""
        slack = 1e-9 * self.anchors.norm[i] * self.most + 1e-6
        for (mean, deviation), (own_mean, own_deviation) in zip(self.rows.levels, self.anchors.levels, strict=True):
            if not len(chosen):
                break
            middle, reach = products(mean, chosen, own_mean[i]), products(deviation, chosen, own_deviation[i]) + slack
            chosen = chosen[drop(middle - reach, middle + reach)]
        return chosen

    def scores(self, i: int, chosen: np.ndarray) -> np.ndarray:
        return products(self.exact, chosen, self.anchors.x[i].astype(self.exact.dtype)).astype(np.int64)

    def positives(self, i: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the first k rows of the anchor's label."""
        chosen = np.flatnonzero((self.rows.label == self.anchors.label[i]) & (self.rows.ids != self.anchors.ids[i]))
        left = self.bounded(i, chosen, lambda lower, upper: upper >= floor_of(lower, k))
        score = self.scores(i, left)
        first = np.argsort(-score, kind="stable")[:k]  # rows are in order of id
        return self.rows.ids[left[first]], score[first]

    def negatives(self, i: int, wanted: np.ndarray, k: int, low: int, high: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """For each positive score: its number, ids and scores of the first k rows of other labels in its band."""
        wide = wanted.astype(float)[:, None]
        least, most = wide * (low / 100), wide * (high / 100)

        def drop(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
            kept = np.zeros(len(lower), bool)
            for a, b in zip(least, most, strict=True):
                certain = lower[(lower >= a) & (upper <= b)]
                kept |= (upper >= a) & (lower <= b) & (upper >= floor_of(certain, k))
            return kept

        left = self.bounded(i, np.flatnonzero(self.rows.label != self.anchors.label[i]), drop)
        score = self.scores(i, left)
        order = np.argsort(-score, kind="stable")
        left, score = left[order], score[order]
        found = []
        for number, positive in enumerate(wanted):
            first = np.flatnonzero((low * positive <= 100 * score) & (100 * score <= high * positive))[:k]
            found.append((number, self.rows.ids[left[first]], score[first]))
        return found


def floor_of(lower: np.ndarray, k: int) -> float:
    """The k-th largest of the lower bounds: a row below it has k rows before it."""
    return np.partition(lower, len(lower) - k)[len(lower) - k] if len(lower) >= k else -np.inf


def indexed(vectors: DataFrame, key: str, label: Column, vector: str, scale: int, marks: dict[str, Column]) -> DataFrame:
    """vec_id, label, the scaled vector x, its summary, and ``marks`` (functions of vec_id); one row for each id."""
    rows = vectors.filter(F.col(key).isNotNull() & label.isNotNull() & usable(F.col(vector)))
    x = F.transform(F.col(vector), lambda v: F.floor(scale * v.cast("double")).cast("long"))
    rows = rows.select(F.col(key).cast("long").alias("vec_id"), label.cast("long").alias("label"), x.alias("x"))
    once = saved(rows.groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("row")).select("vec_id", "row.*"), "scaled_vectors")
    longest = once.agg(F.max(F.size("x"))).first()[0] or 0
    width = max(1, -(-longest // WIDTH)) * WIDTH
    filled = once.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x"))))

    def add(batches):
        for batch in batches:
            if batch.num_rows:
                found = summaries(matrix(pa.Table.from_batches([batch]), "x"))
                offsets = pa.array(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(found.ravel()))], [*batch.schema.names, "summary"]
                )

    whole = filled.mapInArrow(add, "vec_id long, label long, x array<long>, summary array<double>")
    return saved(whole.withColumns(marks), "segment_summaries")


def blocks_met(rows: DataFrame, anchors: DataFrame, row_parts: int, anchor_parts: int, compare: Callable, schema: str) -> DataFrame:
    """``compare`` applied to every pair of a block of rows and a block of anchors."""

    def every(parts: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))

    def dealt(parts: int, seed: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(parts)).cast("int")

    one = rows.withColumn("row_part", dealt(row_parts, 3)).withColumn("anchor_part", every(anchor_parts))
    two = anchors.withColumn("anchor_part", dealt(anchor_parts, 5)).withColumn("row_part", every(row_parts))
    on = ["row_part", "anchor_part"]
    return one.groupBy(*on).cogroup(two.groupBy(*on)).applyInArrow(compare, schema)


def mine_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    label: Column | None = None,
    key: str = "vec_id",
    vector: str = "embedding",
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    scale: int = 256,
    block_rows: int = 4096,
    anchor_rows: int = 2048,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id and both scores.

    For each row where ``is_anchor`` (a function of ``vec_id``) holds: its ``positives`` first rows of the same label
    and, for each, the ``negatives`` first rows of other labels that score ``low`` to ``high`` per cent of the positive.
    """
    label = F.col("label") if label is None else label
    rows = indexed(vectors, key, label, vector, scale, {"is_anchor": F.coalesce(is_anchor, F.lit(False))})
    anchors = saved(rows.filter("is_anchor").select("vec_id", "label", "x", "summary"), "anchors")
    total, asked = rows.count(), anchors.count()
    row_parts, anchor_parts = max(1, -(-total // block_rows)), max(1, -(-asked // anchor_rows))
    rows = rows.select("vec_id", "label", "x", "summary")

    def best_positives(held: pa.Table, asking: pa.Table) -> pa.Table:
        out = []
        if held.num_rows and asking.num_rows:
            search = Search(Block(held), Block(asking))
            for i, anchor in enumerate(search.anchors.ids):
                ids, score = search.positives(i, positives)
                out.append((np.full(len(ids), anchor), ids, score))
        return as_table(out, ["anchor_id", "vec_id", "score"])

    order = Window.partitionBy("anchor_id").orderBy(F.col("score").desc(), "vec_id")
    found = blocks_met(rows, anchors, row_parts, anchor_parts, best_positives, FIRST)
    chosen = saved(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= positives), "positives")
    # At most ``positives`` to an anchor.
    own = chosen.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.sort_array(F.collect_list(F.struct("rank", F.col("vec_id").alias("id"), "score"))).alias("p"))
    own = own.select("vec_id", F.col("p.id").alias("positive_ids"), F.col("p.score").alias("positive_scores"))

    def best_negatives(held: pa.Table, asking: pa.Table) -> pa.Table:
        out = []
        if held.num_rows and asking.num_rows:
            search = Search(Block(held), Block(asking))
            by_id = np.argsort(asking.column("vec_id").to_numpy(), kind="stable")
            names, wanted = (asking.column(c).to_pylist() for c in ("positive_ids", "positive_scores"))
            for i, at in enumerate(by_id):
                for number, ids, score in search.negatives(i, np.array(wanted[at], np.int64), negatives, low, high):
                    each = (search.anchors.ids[i], names[at][number], wanted[at][number])
                    out.append((*[np.full(len(ids), v) for v in each], ids, score))
        return as_table(out, ["anchor_id", "positive_id", "positive_score", "vec_id", "score"])

    met = blocks_met(rows, anchors.join(own, "vec_id"), row_parts, anchor_parts, best_negatives, SECOND)
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return ranked.select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def as_table(parts: list[tuple[np.ndarray, ...]], names: list[str]) -> pa.Table:
    columns = zip(*parts, strict=True) if parts else [[]] * len(names)
    return pa.table({name: np.concatenate([np.zeros(0, np.int64), *values]) for name, values in zip(names, columns, strict=True)})
