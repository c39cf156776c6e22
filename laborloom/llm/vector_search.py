"""Approximate nearest neighbours over balanced posting lists.

Vectors are kept in posting lists around centroids. Centroids come from a
k-means that charges for crowded clusters, so lists stay alike in size; a
vector near the border of several clusters is replicated to each of them. The
centroids form a neighbour graph in memory; a query enters it at its nearest
centroids, walks it best first and takes the lists it opens first. How many is
measured, not set: ``tried`` queries of the table, chosen by hash, are compared
with every row, and the number is the smallest with which these walks find the
target share of the truly nearest rows. Taken lists are read in full and
distances are exact.

Rows equal in id and vector are collapsed first. Centroids are fitted on about
``fit_rows`` of these rows, chosen by a hash of both, and every one is indexed.
A list is dealt in parts of about ``part_rows`` rows by that hash and its
queries in parts too, so many equal vectors, or many vectors of one id, which
share a list, spread over tasks. Each part gives its k nearest distinct ids. What every task holds is at most ``most_lists`` centroids.

Edge cases: vectors that are null, zero, not of the most common length, or
that hold null or non-finite components take no part; equal distances go to the
smaller vec_id; rows that share a vec_id are no candidates of each other, count
once with their nearest vector, and the smallest vector of a repeated query id
is searched; a query gets k neighbours or, if there are fewer, all candidates; tables with few vectors
have one list and exact results; other columns do not take part.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laborloom.llm.common import sample_of, saved


@dataclass(frozen=True)
class Lists:
    """Centroids, their neighbour graph, and to how many lists a vector goes."""

    centroids: np.ndarray
    graph: np.ndarray
    replicas: int
    closure: float


def usable(vector: Column) -> Column:
    """Not null or zero, all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all rows of b, by products; good enough to choose lists."""
    return np.maximum((a**2).sum(1)[:, None] - 2 * a @ b.T + (b**2).sum(1)[None], 0)


CELLS = 4_000_000  # distances held at once


def in_slices(rows: int, width: int) -> list[slice]:
    """Runs of rows whose distances to ``width`` others are CELLS at most."""
    step = max(1, CELLS // max(width, 1))
    return [slice(first, first + step) for first in range(0, rows, step)]


def balanced_centroids(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """k-means in which a cluster's size adds to its distance."""
    distinct = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    k = min(k, len(distinct))
    centroids = distinct[rng.choice(len(distinct), k, replace=False)].copy()
    charge = np.zeros(k)
    for _ in range(rounds):
        nearest, least = np.zeros(len(distinct), np.int64), np.zeros(len(distinct))
        for part in in_slices(len(distinct), k):
            d = squared(distinct[part], centroids)
            nearest[part], least[part] = (d + charge).argmin(axis=1), d.min(axis=1)
        sizes = np.bincount(nearest, minlength=k)
        # The charge follows how much more than its share a cluster holds, in units of a typical squared distance.
        charge += 0.02 * np.median(least) * np.log(np.maximum(sizes, 0.5) * k / len(distinct))
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, distinct)
        centroids = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centroids)
    return centroids


def neighbour_graph(centroids: np.ndarray, degree: int) -> np.ndarray:
    degree = min(degree, max(len(centroids) - 1, 0))
    found = np.zeros((len(centroids), degree), np.int64)
    for part in in_slices(len(centroids), len(centroids)):
        d = squared(centroids[part], centroids)
        d[np.arange(len(d)), np.arange(len(centroids))[part]] = np.inf
        found[part] = np.argsort(d, axis=1)[:, :degree]
    return found


def lists_of(x: np.ndarray, centroids: np.ndarray, replicas: int, closure: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) of the nearest lists of each vector, those at most ``closure`` times as far as the nearest."""
    rows, lists = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for part in in_slices(len(x), len(centroids)):
        d = np.sqrt(squared(x[part], centroids))
        near = np.argsort(d, axis=1, kind="stable")[:, :replicas]
        far = np.take_along_axis(d, near, axis=1)
        row, place = np.nonzero(far <= far[:, :1] * closure + 1e-12)
        rows.append(row + part.start)
        lists.append(near[row, place])
    return np.concatenate(rows), np.concatenate(lists)


def walk(query: np.ndarray, lists: Lists) -> Iterator[int]:
    """All lists, in the order in which a best-first walk over the graph from the nearest centroids opens them."""
    centroids, graph = lists.centroids, lists.graph
    # All at once: no way leads from one group of centroids to another where neighbours lie in the group.
    distances = ((centroids - query) ** 2).sum(axis=1)
    entries = np.argsort(distances, kind="stable")
    entered = min(8, len(entries))
    seen = np.zeros(len(centroids), bool)
    seen[entries[:entered]] = True
    heap = [(float(distances[c]), int(c)) for c in entries[:entered]]
    heapq.heapify(heap)
    while True:
        # A centroid nearer than all that are open and not yet seen is a new way in.
        while entered < len(entries) and (seen[entries[entered]] or not heap or distances[entries[entered]] < heap[0][0]):
            c = entries[entered]
            entered += 1
            if not seen[c]:
                seen[c] = True
                heapq.heappush(heap, (float(distances[c]), int(c)))
        if not heap:
            return
        _, c = heapq.heappop(heap)
        yield c
        fresh = graph[c][~seen[graph[c]]]
        seen[fresh] = True
        for other in fresh:
            heapq.heappush(heap, (float(distances[other]), int(other)))


def fit_lists(x: np.ndarray, k: int, replicas: int, closure: float, degree: int, seed: int) -> Lists:
    # Without copies row order does not count.
    centroids = balanced_centroids(np.unique(x, axis=0), k, seed)
    return Lists(centroids, neighbour_graph(centroids, degree), replicas, closure)


def truly_nearest(rows: DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """query_id and vector ``v`` of the ``k`` rows of other ids nearest to each of a few queries, by comparing all."""
    q, own = np.array(queries["v"].tolist(), float), queries["vec_id"].to_numpy()

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x, ids = np.array(batch["v"].tolist(), float), batch["vec_id"].to_numpy()
                found = []
                for part in in_slices(len(q), len(x)):
                    d = squared(q[part], x)
                    d[own[part][:, None] == ids[None]] = np.inf
                    near = np.argpartition(d, min(k, len(x)) - 1, axis=1)[:, :k]
                    at = np.take_along_axis(d, near, axis=1)
                    i, j = np.nonzero(np.isfinite(at))
                    found.append(pd.DataFrame({"query_id": own[part][i], "d": at[i, j], "v": batch["v"].to_numpy()[near[i, j]], "vec_id": ids[near[i, j]]}))
                yield pd.concat(found)

    kind = rows.schema["v"].dataType.simpleString()
    all_near = rows.select("vec_id", "v").mapInPandas(nearest, f"query_id long, d double, v {kind}, vec_id long")
    order = Window.partitionBy("query_id").orderBy("d", "vec_id")
    best = all_near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select("query_id", "v").toPandas()


def lists_needed(near: pd.DataFrame, queries: pd.DataFrame, lists: Lists, recall: float) -> int:
    """With how many opened lists the walks of these queries meet the share ``recall`` of their nearest rows."""
    needed = []
    for query_id, v in zip(queries["vec_id"], queries["v"], strict=True):
        wanted = near["v"][near["query_id"] == query_id].tolist()
        if wanted:
            row, own = lists_of(np.array(wanted, float), lists.centroids, lists.replicas, lists.closure)
            left = {int(r): {*own[row == r].tolist()} for r in np.unique(row)}
            for turn, c in enumerate(walk(np.array(v, float), lists), 1):
                met = [r for r, held in left.items() if c in held]
                needed += [turn] * len(met)
                for r in met:
                    del left[r]
                if not left:
                    break
    return int(np.quantile(needed, recall, method="higher")) if needed else 1


def nearest_vectors(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    key: str = "vec_id",
    vector: str = "embedding",
    list_rows: int = 200,
    most_lists: int = 4096,
    fit_rows: int = 20_000,
    recall: float = 0.97,
    replicas: int = 4,
    closure: float = 1.3,
    degree: int = 24,
    part_rows: int = 4_000,
    tried: int = 100,
    seed: int = 13,
) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest found for each row where ``is_query`` holds."""
    rows = vectors.filter(F.col(key).isNotNull() & usable(F.col(vector)))
    rows = rows.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("v"), is_query.alias("is_query"))
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.col("count").desc(), F.col("d").desc()).first()
    if lengths is None:
        return vectors.sparkSession.createDataFrame([], RESULT)
    rows = rows.filter(F.size("v") == lengths["d"]).groupBy("vec_id", "v").agg(F.max("is_query").alias("is_query"))
    rows = saved(rows.withColumn("mark", F.xxhash64("vec_id", "v")), "vectors")
    n = rows.count()
    sample = np.array(sample_of(rows.select("mark", "v"), "mark", fit_rows).select("v").toPandas()["v"].tolist(), float)
    lists = fit_lists(sample, min(most_lists, -(-n // list_rows)), replicas, closure, degree, seed)

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                row, own = lists_of(np.array(batch["v"].tolist(), float), lists.centroids, lists.replicas, lists.closure)
                yield pd.DataFrame({"list": own, **{c: batch[c].to_numpy()[row] for c in ("vec_id", "mark", "v")}})

    kind = vectors.schema[vector].dataType.simpleString()
    postings = saved(rows.select("vec_id", "mark", "v").mapInPandas(post, f"list int, vec_id long, mark long, v {kind}"), "postings")
    sizes = {r["list"]: r["count"] for r in postings.groupBy("list").count().collect()}
    # An id in m lists counts 1/m in each, so lists whose counts sum to k + 1 hold that many ids at least.
    spread = postings.groupBy("vec_id").agg(F.collect_set("list").alias("lists"))
    spread = spread.select(F.explode("lists").alias("list"), F.floor(F.lit(ONE) / F.size("lists")).alias("part"))
    ids = np.zeros(len(lists.centroids), np.int64)
    for r in spread.groupBy("list").agg(F.sum("part").alias("ids")).collect():
        ids[r["list"]] = r["ids"]

    queries = saved(rows.filter("is_query").groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    trial = queries.orderBy(F.xxhash64(F.lit(seed), "vec_id"), "vec_id").limit(tried).toPandas()
    opened = lists_needed(truly_nearest(rows, trial, k), trial, lists, recall) if len(trial) and len(lists.centroids) > 1 else 1

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for vec_id, v in zip(batch["vec_id"], batch["v"], strict=True):
                held = 0
                for turn, c in enumerate(walk(np.array(v, float), lists)):
                    # Whatever was measured, enough lists for the answer to be full, the query's own id counted.
                    if turn >= opened and held >= (k + 1) * ONE:
                        break
                    out.append((c, vec_id, v))
                    held += ids[c]
            yield pd.DataFrame(out, columns=["list", "query_id", "q"])

    probes = saved(queries.mapInPandas(probe, f"list int, query_id long, q {kind}"), "probes")
    asked = {r["list"]: r["count"] for r in probes.groupBy("list").count().collect()}
    # Parts of each list and of its queries; every part of the one meets every part of the other.
    deals = [(c, -(-sizes[c] // part_rows), -(-asked[c] // part_rows)) for c in sorted(asked) if c in sizes]
    plan = vectors.sparkSession.createDataFrame(deals, "list int, parts int, query_parts int")
    dealt = (
        postings.join(plan, "list")
        .withColumn("part", F.pmod(F.col("mark"), F.col("parts")))
        .withColumn("query_part", F.explode(F.sequence(F.lit(0), F.col("query_parts") - 1)))
        .select("list", "part", "query_part", "vec_id", "v")
    )
    asking = (
        probes.join(plan, "list")
        .withColumn("query_part", F.pmod(F.xxhash64("query_id"), F.col("query_parts")).cast("int"))
        .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)))
        .select("list", "part", "query_part", "query_id", "q")
    )

    def compare(held: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(held) and len(wanted):
            held = held.sort_values("vec_id")
            ids, first = np.unique(held["vec_id"].to_numpy(), return_index=True)
            x = np.array(held["v"].tolist(), float)
            for query_id, q in zip(wanted["query_id"], wanted["q"], strict=True):
                # Of each id the nearest row.
                d = np.minimum.reduceat(np.sqrt(((x - np.array(q, float)) ** 2).sum(axis=1)), first)
                d[ids == query_id] = np.inf
                # Ids as near as the k-th at least, then ties by id.
                limit = np.partition(d, k - 1)[k - 1] if len(d) > k else np.inf
                near = np.flatnonzero((d <= limit) & np.isfinite(d))
                near = near[np.lexsort((ids[near], d[near]))][:k]
                out += [(query_id, int(ids[j]), float(d[j])) for j in near]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    on = ["list", "part", "query_part"]
    met = dealt.groupBy(*on).cogroup(asking.groupBy(*on)).applyInPandas(compare, "query_id long, vec_id long, score double")
    # An id in several lists or parts is found several times.
    once = met.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


ONE = 1 << 20
RESULT = "query_id long, rank int, vec_id long, score double"
