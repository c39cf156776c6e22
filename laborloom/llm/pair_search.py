"""Ranked lexical search by MaxScore with bounds of term pairs.

Documents are tokenized once, whole, and kept as (term, frequency) lists of the
terms that items name; document frequencies, the number of documents and the
number of their terms come from all of them. They are then dealt by hash into
shards of about ``shard_postings`` postings. Each shard's index holds

* a list for each term: the documents, their impacts, and the largest impact;
* a list for each pair of terms that are neighbours by weight in some item: the
  documents that hold both, and the largest sum of the two impacts in one of
  them, which is often well below the sum of the two largest impacts.

A search puts an item's terms in order of weight. ``bounds[i]`` is the most that
a document can get from the ``i`` lightest terms: one more term adds its largest
impact, or two more add the bound of their pair, whichever is less. Terms whose
bound stays below the threshold cannot lift a document into the result by
themselves, so only the lists of the others are read in full; the rest are read
for documents that are still open, and a document goes as soon as its score and
the bound of what is left fall below the threshold.

Thresholds are global: first, every shard scores the documents in the pair lists
with the largest joint impacts of each item; the k-th best of all shards is the
threshold the search starts from. All scores are exact 64-bit integers and the
result is that of scoring every document.

Tasks hold the terms of one block of at most ``block_items`` items; more items
are searched block by block.

Edge cases: a null or empty text, or one without a term, matches nothing and
counts in no statistic; a document without a shared term scores 0 and is not
listed; equal scores go by the smaller doc_id, a null one first; rows that share
a doc_id are documents of their own; rows that share an item_id count once, with
the smallest text; terms repeated in an item count as often; items without a
term, and empty tables, give no rows; other columns do not take part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from laborloom.llm.common import saved, with_key, without_key

PART = 2_000_000  # bytes tokenized at once
FORWARD = "mark long, doc long, n long, terms array<int>, times array<int>"
INDEX = "shard int, a int, b int, docs array<int>, impacts array<int>, most long, ids array<long>"
HITS = "item int, doc long, score long"
RESULT = "item_id long, rank int, doc_id long, score long"


def separators() -> bytes:
    """Bytes as they count: A-Z lowered, other ASCII that is no letter or digit a space, the rest unchanged."""
    table = bytearray(b" " * 128 + bytes(range(128, 256)))
    for c in b"0123456789abcdefghijklmnopqrstuvwxyz":
        table[c] = c
    for c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
        table[c] = c + 32
    return bytes(table)


def terms_of(text: bytes, table: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order, in lists made from about PART bytes each."""
    start = 0
    while start < len(text):
        end = start + PART
        if end < len(text):
            # A cut never parts a term.
            part = text[start:end].translate(table)
            cut = part.rfind(b" ")
            while cut < 0 and end < len(text):
                end += PART
                part = text[start:end].translate(table)
                cut = part.rfind(b" ") if end < len(text) else len(part)
            yield part[:cut].split()
            start += max(cut, 1)
        else:
            yield text[start:].translate(table).split()
            return


def forward_lists(docs: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """A row per document: its number of terms, and those of ``terms`` that it holds with their frequencies."""
    count = max(1, len(terms))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table, marked = separators(), TaskContext.get().partitionId() << 40

        def listed(rows: list[int], sizes: list[int], held: list[np.ndarray]) -> pa.RecordBatch:
            # One sort for all documents: keys are document, then term.
            length = np.array([len(x) for x in held], np.int64)
            key = np.repeat(np.arange(len(rows), dtype=np.int64), length) * count + np.concatenate([np.zeros(0, np.int32), *held])
            key, times = np.unique(key, return_counts=True)
            offsets = np.searchsorted(key, np.arange(len(rows) + 1, dtype=np.int64) * count).astype(np.int32)
            lists = [pa.ListArray.from_arrays(offsets, x.astype(np.int32)) for x in (key % count, times)]
            marks = pa.array(np.arange(marked, marked + len(rows)))
            return pa.RecordBatch.from_arrays([marks, pa.array(rows), pa.array(sizes), *lists], ["mark", "doc", "n", "terms", "times"])

        for batch in batches:
            rows, sizes, held, total = [], [], [], 0
            for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text"), strict=True):
                ids, n = [], 0
                for found in terms_of(text.as_py() or b"", table):
                    n += len(found)
                    known = np.fromiter(map(terms.get, found, repeat(-1)), np.int32, len(found))
                    ids.append(known[known >= 0])
                rows.append(doc)
                sizes.append(n)
                held.append(np.concatenate([np.zeros(0, np.int32), *ids]))
                total += n
                if total > PART // 4:
                    yield listed(rows, sizes, held)
                    marked += len(rows)
                    rows, sizes, held, total = [], [], [], 0
            if rows:
                yield listed(rows, sizes, held)
                marked += len(rows)

    return docs.mapInArrow(read, FORWARD)


@dataclass(frozen=True)
class Items:
    """Items of a block: terms by falling weight with their repeats; term weights; the pairs that have a list."""

    terms: list[np.ndarray]
    repeats: list[np.ndarray]
    weights: np.ndarray
    documents: int
    length: int

    def pairs(self) -> set[tuple[int, int]]:
        return {tuple(sorted(p)) for terms in self.terms for p in zip(terms[:-1].tolist(), terms[1:].tolist(), strict=True)}

    def impact(self, times: np.ndarray, n: np.ndarray) -> np.ndarray:
        m = 100 - 25 + (25 * n * self.documents) // self.length
        return (1_000_000_000 * times) // (1000 * times + 12 * m)


def build_shard(forward: pa.Table, items: Items, shard: int) -> pa.Table:
    """The index rows of a shard: document ids under a = -1, terms under (a, -1), pairs under (a, b)."""
    docs = forward.column("doc").to_numpy()
    by_doc = np.argsort(docs, kind="stable")
    place = np.empty(len(docs), np.int32)
    place[by_doc] = np.arange(len(docs), dtype=np.int32)
    lists = forward.column("terms").combine_chunks()
    length = np.diff(lists.offsets.to_numpy())
    term, times = lists.flatten().to_numpy(), forward.column("times").combine_chunks().flatten().to_numpy().astype(np.int64)
    impact = items.impact(times, np.repeat(forward.column("n").to_numpy(), length)).astype(np.int32)
    order = np.lexsort((np.repeat(place, length), term))
    term, at, impact = term[order], np.repeat(place, length)[order], impact[order]
    first = np.searchsorted(term, np.arange(len(items.weights) + 1))
    out = [(-1, -1, at[:0], impact[:0], 0, docs[by_doc])]
    for t in np.flatnonzero(np.diff(first)):
        own = slice(first[t], first[t + 1])
        out.append((t, -1, at[own], impact[own], int(items.weights[t]) * int(impact[own].max()), docs[:0]))
    score = np.zeros(len(docs), np.int64)
    for a, b in sorted(items.pairs()):
        one, two = slice(first[a], first[a + 1]), slice(first[b], first[b + 1])
        score[at[one]] = items.weights[a] * impact[one]
        # Only documents of both terms: an impact of 0 cannot be, so marks are told by the score.
        marked = np.zeros(len(docs), bool)
        marked[at[one]] = True
        both = marked[at[two]]
        shared = at[two][both]
        most = int((score[shared] + items.weights[b] * impact[two][both]).max(initial=0))
        out.append((a, b, shared, impact[:0], most, docs[:0]))
    a, b, shared, impacts, most, ids = zip(*out, strict=True)
    return pa.table(
        {
            "shard": pa.array([shard] * len(out), pa.int32()),
            "a": pa.array(a, pa.int32()),
            "b": pa.array(b, pa.int32()),
            "docs": pa.array(shared, pa.list_(pa.int32())),
            "impacts": pa.array(impacts, pa.list_(pa.int32())),
            "most": pa.array(most, pa.int64()),
            "ids": pa.array(ids, pa.list_(pa.int64())),
        }
    )


class Shard:
    """A shard's lists, as a search reads them."""

    def __init__(self, rows: pa.Table, items: Items):
        self.items, self.lists, self.joint, self.most = items, {}, {}, {}
        self.ids = np.zeros(0, np.int64)
        columns = [rows.column(c).combine_chunks() for c in ("docs", "impacts", "ids")]
        flat = [(c.offsets.to_numpy(), c.values.to_numpy()) for c in columns]
        self.opened = 0  # postings read
        for i, (a, b, most) in enumerate(zip(*(rows.column(c).to_pylist() for c in ("a", "b", "most")), strict=True)):
            docs, impacts, ids = (values[at[i] : at[i + 1]] for at, values in flat)
            if a < 0:
                self.ids = ids
            elif b < 0:
                self.lists[a], self.most[a] = (docs, impacts), most
            else:
                self.joint[a, b] = (docs, most)

    def bounds(self, item: int, with_pairs: bool = True) -> list[int]:
        """The most that a document can score by the 0, 1, 2, ... lightest terms of an item."""
        terms, repeats = self.items.terms[item][::-1].tolist(), self.items.repeats[item][::-1].tolist()
        found = [0]
        for i, (t, r) in enumerate(zip(terms, repeats, strict=True)):
            own = r * self.most.get(t, 0)
            bound = found[i] + own
            if i and with_pairs:
                s, q = terms[i - 1], repeats[i - 1]
                other, both = self.most.get(s, 0), min(r, q)
                joint = self.joint.get((min(s, t), max(s, t)), (None, 0))[1]
                together = both * joint + (r - both) * self.most.get(t, 0) + (q - both) * other if joint else 0
                bound = min(bound, found[i - 1] + max(own, q * other, together))
            found.append(bound)
        return found

    def add(self, score: np.ndarray, term: int, repeats: int, chosen: np.ndarray | None = None) -> None:
        """Add a term's part to the scores of all its documents, or of the chosen ones."""
        if term not in self.lists:
            return
        docs, impacts = self.lists[term]
        weight = repeats * int(self.items.weights[term])
        if chosen is None or 8 * len(chosen) > len(docs):
            self.opened += len(docs)
            score[docs] += weight * impacts.astype(np.int64)
        else:
            self.opened += len(chosen)
            at = np.minimum(np.searchsorted(docs, chosen), len(docs) - 1)
            met = docs[at] == chosen
            score[chosen[met]] += weight * impacts[at[met]].astype(np.int64)

    def best(self, score: np.ndarray, chosen: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best of the chosen; places are in order of id."""
        chosen = chosen[score[chosen] > 0]
        first = chosen[np.argsort(-score[chosen], kind="stable")[:k]]
        return self.ids[first], score[first]

    def promising(self, item: int, k: int, pairs: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best of the documents in the pair lists of the largest joint impacts."""
        terms, repeats = self.items.terms[item], self.items.repeats[item]
        near = [self.joint[tuple(sorted(p))] for p in zip(terms[:-1].tolist(), terms[1:].tolist(), strict=True)]
        near = [docs for docs, most in sorted(near, key=lambda x: -x[1])[:pairs]]
        if len(terms) == 1 and int(terms[0]) in self.lists:
            near = [self.lists[int(terms[0])][0]]
        chosen = np.unique(np.concatenate([np.zeros(0, np.int32), *near]))
        score = np.zeros(len(self.ids), np.int64)
        if len(chosen):
            for t, r in zip(terms.tolist(), repeats.tolist(), strict=True):
                self.add(score, t, r, chosen)
        return self.best(score, chosen, k)

    def search(self, item: int, k: int, threshold: int, with_pairs: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """The k best documents, but for those that cannot reach the threshold."""
        terms, repeats = self.items.terms[item][::-1].tolist(), self.items.repeats[item][::-1].tolist()
        bounds = self.bounds(item, with_pairs)
        light = sum(b < threshold for b in bounds[1:])  # bounds never fall
        score = np.zeros(len(self.ids), np.int64)
        for t, r in zip(terms[light:], repeats[light:], strict=True):
            self.add(score, t, r)
        chosen = np.flatnonzero(score)
        for i in reversed(range(light)):
            if len(chosen) >= k:
                # Scores so far only grow, so the k-th best of them is a threshold too.
                threshold = max(threshold, int(np.partition(score[chosen], len(chosen) - k)[len(chosen) - k]))
            chosen = chosen[score[chosen] + bounds[i + 1] >= threshold]
            if not len(chosen):
                break
            self.add(score, terms[i], repeats[i], chosen)
        ids, found = self.best(score, chosen, k)
        return ids[found >= threshold], found[found >= threshold]


def weight_of(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def _block_search(docs: DataFrame, wanted: list, k: int, shard_postings: int, pairs: int) -> DataFrame | None:
    """HITS of one block of items: (item_id, text) rows."""
    spark, table = docs.sparkSession, separators()
    texts = [[t for part in terms_of((r["text"] or "").encode(), table) for t in part] for r in wanted]
    terms = {t: i for i, t in enumerate(sorted({t for text in texts for t in text}))}
    if not terms:
        return None
    forward = saved(forward_lists(docs, terms), "forward_lists")
    counted = forward.filter("n > 0").agg(F.count(F.lit(1)), F.sum("n"), F.sum(F.size("terms"))).first()
    if not counted[0]:
        return None
    held = np.zeros(len(terms), np.int64)
    # One row for each term of the block.
    for r in forward.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        held[r["term"]] = r["count"]
    weights = np.array([weight_of(counted[0], int(n)) for n in held], np.int64)
    own, often = [], []
    for text in texts:
        ids, times = np.unique(np.array([terms[t] for t in text], np.int64), return_counts=True)
        order = np.lexsort((ids, -weights[ids]))
        own.append(ids[order])
        often.append(times[order].astype(np.int64))
    items = Items(own, often, weights, counted[0], counted[1])
    shards = max(1, -(-counted[2] // shard_postings))
    dealt = forward.filter(F.size("terms") > 0).withColumn("shard", F.pmod(F.xxhash64("mark"), F.lit(shards)).cast("int")).drop("mark")
    index = saved(
        dealt.groupBy("shard").applyInArrow(lambda rows: build_shard(rows, items, rows.column("shard")[0].as_py()), INDEX), "pair_index"
    )

    def hits(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
        numbers = [np.full(len(ids), i, np.int32) for i, (ids, _) in enumerate(found)]
        return pa.table(
            {
                "item": np.concatenate([np.zeros(0, np.int32), *numbers]),
                "doc": np.concatenate([np.zeros(0, np.int64), *[ids for ids, _ in found]]),
                "score": np.concatenate([np.zeros(0, np.int64), *[score for _, score in found]]),
            }
        )

    def start(rows: pa.Table) -> pa.Table:
        shard = Shard(rows, items)
        return hits([shard.promising(i, k, pairs) for i in range(len(items.terms))])

    order = Window.partitionBy("item").orderBy(F.col("score").desc())
    first = index.groupBy("shard").applyInArrow(start, HITS).withColumn("rank", F.row_number().over(order))
    # One row for each item of the block.
    thresholds = dict.fromkeys(range(len(items.terms)), 0)
    thresholds |= {r["item"]: r["score"] for r in first.filter(F.col("rank") == k).collect()}

    def search(rows: pa.Table) -> pa.Table:
        shard = Shard(rows, items)
        return hits([shard.search(i, k, thresholds[i]) for i in range(len(items.terms))])

    names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(wanted)], "item int, item_id long")
    return index.groupBy("shard").applyInArrow(search, HITS).join(names, "item").select("item_id", "item", "doc", "score")


def ranked_search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 20,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    block_items: int = 2_000,
    shard_postings: int = 1_000_000,
    pairs: int = 3,
) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents of each item."""
    texts = docs.select(with_key(key).alias("doc"), F.col(text).cast("binary").alias("text"))
    asked = items.groupBy(F.col(item_key).cast("long").alias("item_id")).agg(F.min(item_text).alias("text"))
    asked = saved(asked.withColumn("block", F.lit(0)), "items")
    blocks = max(1, -(-asked.count() // block_items))
    part = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    found = None
    for b in range(blocks):
        # A block holds about ``block_items`` items.
        hits = _block_search(texts, asked.filter(part == b).orderBy("item_id").collect(), k, shard_postings, pairs)
        if hits is not None:
            found = hits if found is None else found.unionByName(hits)
    if found is None:
        return docs.sparkSession.createDataFrame([], RESULT)
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), "doc")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("item_id", "rank", without_key("doc").alias("doc_id"), "score")
