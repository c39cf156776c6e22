"""N-gram Jaccard join with token-combination prefixes.

Documents are sets of word n-grams; two link when their Jaccard similarity
reaches ``per_cent``. Equal sets become one class first, so copies never meet
each other. The sets' tokens have one global order, rare before frequent, and

* a document whose prefix (the tokens that cannot all be missing from a linked
  set) holds rare tokens alone is indexed under each of them;
* any other is indexed under all its rare tokens, and its prefix is extended
  into the frequent ones until two linked sets must share two tokens that are
  neighbours in both. Those pairs of frequent tokens are its further keys.

With n tokens and threshold t: at most a = n - ceil(t n) tokens are missing
from a linked set and at most d = n (1 - t) / t tokens lie in one of the two
sets alone, so among the first a + d + 2 tokens some neighbours stay
neighbours. No link is lost, and keys stay linear in the set.

Candidate pairs under a key are all checked, except those that links have
connected already. Where the pairs would be many more than the index entries,
rounds come first in which each document meets a few others of its key, dealt
by hash: in a large group of near copies that connects nearly all of them, at a
cost that follows the group's size and not its square. Then come the pairs that
still lie in different components, so the components are those of all links.
Under a key of more than ``BLOCK_FROM`` documents these do not become rows: blocks
of at most ``BLOCK_ROWS`` documents meet in a task of their own, which passes on
what its filters leave.

A pair passes two filters before sets travel: the sizes must allow a link, and
so must counts of tokens in ``BINS`` hash ranges, whose smaller values bound the
common tokens from above. The check itself is exact, on 64-bit n-gram hashes.

The listed tokens are the only thing every task holds, ``most_listed`` at most.
They steer the order alone; any list gives the same links.

Edge cases: null texts and texts without words have an empty set, link with
nothing and are their own component; a text of fewer words than n is one
n-gram; rows that share a doc_id count as one document; a null doc_id links with
nothing; an empty table gives no rows; other columns do not take part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laborloom.llm.common import NO_KEY, by_ids, discard, saved, with_key, without_key
from laborloom.llm.components import connected_components

KEEP_WORDS = 200_000
COUNT_TOKENS = 2_000_000
BLOCK_FROM = 64  # documents under a key from which pairs are judged in blocks
BLOCK_ROWS = 1_024
PAIRS = 40_000  # pairs whose counts a task compares at once
SLICE_ROWS = 500  # documents whose sets a task holds at once
BINS = 128
BIN_LIMIT = 1_000_000  # sets above this size are not judged by their bins, which hold short integers


class WordHashes(dict):
    """64-bit hash of each word met."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > KEEP_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None, n: int, hashes: WordHashes) -> np.ndarray:
    """Sorted hashes of the distinct n-word shingles; bytes.lower() lowers A-Z alone and split() knows the six spaces."""
    found = (text or b"").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    words = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    if len(words) < n:
        # A short text is one shingle, told from full ones by its length.
        words, n = np.concatenate([np.full(n - len(words), 2**63 + len(words), np.uint64), words]), n
    value = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        value = mixed(value + words[k : len(words) - n + 1 + k] + np.uint64(0x9E3779B97F4A7C15))
    return np.unique(value)


def sliced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for first in range(0, len(batch), SLICE_ROWS):
            yield batch.iloc[first : first + SLICE_ROWS]


@dataclass(frozen=True)
class Order:
    """Tokens of many documents, sorted, with their rank by count and whether they are of the frequent class."""

    tokens: np.ndarray
    rank: np.ndarray
    often: np.ndarray


def prefix_keys(tokens: np.ndarray, order: Order, per_cent: int) -> np.ndarray:
    """Index keys of a set (sorted tokens). Tokens that are not listed come first, by hash, then listed ones by count."""
    n = len(tokens)
    missing = n + (-per_cent * n // 100)
    apart = n * (100 - per_cent) // per_cent
    if not missing + apart:
        return tokens[:0]  # so small a set links with its equal only
    if not len(order.tokens):
        return tokens[: missing + 1]
    at = np.minimum(np.searchsorted(order.tokens, tokens), len(order.tokens) - 1)
    listed = order.tokens[at] == tokens
    by_rank = tokens[listed][np.argsort(order.rank[at[listed]], kind="stable")]
    often = np.sort(order.often[at[listed]])  # the frequent class has the highest ranks
    rare = np.concatenate([tokens[~listed], by_rank[~often]])
    if len(rare) > missing:
        return rare[: missing + 1]
    common = by_rank[often][: max(0, min(n, missing + apart + 2) - len(rare))]
    return np.concatenate([rare, mixed(mixed(common[:-1]) + common[1:])])


def token_order(texts: DataFrame, n: int, frequent_from: int, most: int) -> Order:
    """The tokens found in most documents.

    Tasks count what they hold, every document of it, in parts of COUNT_TOKENS, and pass on tokens met twice or more in
    a part.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, held, size = WordHashes(), [], 0

        def counted() -> pd.DataFrame:
            token, times = np.unique(np.concatenate(held) if held else np.zeros(0, np.uint64), return_counts=True)
            return pd.DataFrame({"token": token[times > 1].view(np.int64), "n": times[times > 1]})

        for batch in batches:
            for text in batch["text"]:
                held.append(shingle_set(text, n, hashes))
                size += len(held[-1])
                if size > COUNT_TOKENS:
                    yield counted()
                    held, size = [], 0
        yield counted()

    counts = texts.select("text").mapInPandas(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = counts.filter("n > 3").orderBy(F.col("n").desc(), "token").limit(most).toPandas()
    tokens, times = top["token"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    by_token = np.argsort(tokens)
    rank = np.empty(len(tokens), np.int32)
    rank[np.lexsort((tokens, times))] = np.arange(len(tokens), dtype=np.int32)
    return Order(tokens[by_token], rank[by_token], (times >= frequent_from)[by_token])


def indexed(texts: DataFrame, n: int, per_cent: int, order: Order) -> DataFrame:
    """doc, n_shingles, a 128-bit signature of the set, its index keys, and its counts by hash range."""

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in sliced(batches):
            sizes, one, two, keys, bins = [], [], [], [], []
            for text in batch["text"]:
                s = shingle_set(text, n, hashes)
                sizes.append(len(s))
                one.append(int(mixed(s).sum(dtype=np.uint64).view(np.int64)))
                two.append(int(np.bitwise_xor.reduce(mixed(s + np.uint64(1))).view(np.int64)) if len(s) else 0)
                keys.append(prefix_keys(s, order, per_cent).view(np.int64))
                bins.append(np.bincount((s >> np.uint64(20)).astype(np.int64) % BINS, minlength=BINS).clip(max=32_767).astype(np.int16))
            yield pd.DataFrame(
                {"doc": batch["doc"], "n_shingles": sizes, "sig_a": one, "sig_b": two, "keys": keys, "bins": bins}
            )

    return texts.mapInPandas(
        index, "doc long, n_shingles long, sig_a long, sig_b long, keys array<long>, bins array<short>"
    )


def sets_of(texts: DataFrame, n: int) -> DataFrame:
    def shingle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in sliced(batches):
            sets = [shingle_set(text, n, hashes).view(np.int64) for text in batch["text"]]
            yield pd.DataFrame({"doc": batch["doc"], "tokens": sets})

    return texts.mapInPandas(shingle, "doc long, tokens array<long>")


def _fits(small: Column, large: Column, per_cent: int) -> Column:
    """Sizes that allow a link."""
    return 100 * F.least(small, large) >= per_cent * F.greatest(small, large)


def _both_sides(pairs: DataFrame, rows: DataFrame, *columns: str) -> DataFrame:
    """The pairs (a, b) with the columns of both documents, named _a and _b at the end."""
    left = rows.select(F.col("doc").alias("a"), *[F.col(c).alias(f"{c}_a") for c in columns])
    right = rows.select(F.col("doc").alias("b"), *[F.col(c).alias(f"{c}_b") for c in columns])
    return pairs.join(left, "a").join(right, "b")


@dataclass(frozen=True)
class Verifier:
    """Which candidate pairs link: counts by hash range first, then whole sets of the documents that are left."""

    texts: DataFrame
    index: DataFrame
    n: int
    per_cent: int

    def near(self, pairs: DataFrame) -> DataFrame:
        """The pairs that sizes and counts by hash range leave."""
        common = F.zip_with("bins_a", "bins_b", lambda x, y: F.least(x, y).cast("int"))
        bound = F.aggregate(common, F.lit(0), lambda total, x: total + x)
        near = _both_sides(pairs, self.index, "bins", "n_shingles").filter(
            (100 * bound >= self.per_cent * (F.col("n_shingles_a") + F.col("n_shingles_b") - bound))
            | (F.greatest("n_shingles_a", "n_shingles_b") > BIN_LIMIT)
        )
        return near.select("a", "b")

    def near_in_blocks(self, entries: DataFrame, low: tuple[str, ...]) -> DataFrame:
        """The same for all pairs under each token of ``entries``, whose ``k`` is the number of its documents."""
        per_cent = self.per_cent

        def judge(rows: pa.Table) -> pa.Table:
            first, second = rows.column("low_part")[0].as_py(), rows.column("high_part")[0].as_py()
            part = rows.column("part").to_numpy()
            doc, comp, size = (rows.column(c).to_numpy() for c in ("doc", "comp", "size"))
            bins = rows.column("bins").combine_chunks().flatten().to_numpy().reshape(-1, BINS)
            lows = np.stack([rows.column(c).to_numpy() for c in low])
            token = rows.column("token")[0].as_py()
            one, two = np.flatnonzero(part == first), np.flatnonzero(part == second)
            met = comp[one][:, None] != comp[two][None]
            small, large = np.minimum(size[one][:, None], size[two][None]), np.maximum(size[one][:, None], size[two][None])
            met &= 100 * small >= per_cent * large
            if first == second:
                met &= doc[one][:, None] < doc[two][None]
            for x in lows[:, one]:
                for y in lows[:, two]:
                    met &= ~((x[:, None] == y[None]) & (x < token)[:, None])
            found = []
            left, right = np.nonzero(met)
            for k in range(0, len(left), PAIRS):
                i, j = one[left[k : k + PAIRS]], two[right[k : k + PAIRS]]
                bound = np.minimum(bins[i], bins[j]).sum(axis=1, dtype=np.int64)
                kept = (100 * bound >= per_cent * (size[i] + size[j] - bound)) | (np.maximum(size[i], size[j]) > BIN_LIMIT)
                found.append(np.stack([doc[i[kept]], doc[j[kept]]]))
            pairs = np.concatenate([np.zeros((2, 0), np.int64), *found], axis=1)
            return pa.table({"a": pairs.min(axis=0), "b": pairs.max(axis=0)})

        parts = F.ceil(F.col("k") / BLOCK_ROWS).cast("int")
        # A document with fewer tokens has the one at hand in their place, which leaves no pair to another token.
        entries = entries.withColumns({name: F.coalesce(name, "token") for name in low})
        dealt = entries.join(self.index.select("doc", "bins"), "doc").withColumns(
            {"part": F.pmod(F.xxhash64("doc", F.lit(9)), parts).cast("int"), "other": F.explode(F.sequence(F.lit(0), parts - 1))}
        )
        dealt = dealt.withColumns({"low_part": F.least("part", "other"), "high_part": F.greatest("part", "other")}).drop("other", "k")
        return dealt.groupBy("token", "low_part", "high_part").applyInArrow(judge, "a long, b long")

    def confirmed(self, near: DataFrame) -> DataFrame:
        """Of the near pairs those that link, by their whole sets."""
        near = saved(near.distinct(), "near_pairs")
        docs = saved(near.select("a").union(near.select("b")).distinct().withColumnRenamed("a", "doc"), "near_docs")
        sets = saved(sets_of(by_ids(self.texts, docs, "doc", "left_semi"), self.n), "near_sets")
        both = F.size(F.array_intersect("tokens_a", "tokens_b"))
        union = F.size("tokens_a") + F.size("tokens_b") - both
        met = _both_sides(near, sets, "tokens").filter(100 * both >= self.per_cent * union)
        links = saved(met.select("a", "b").distinct(), "links")
        discard(near, docs, sets)
        return links

    def links(self, pairs: DataFrame) -> DataFrame:
        return self.confirmed(self.near(pairs))


def jaccard_components(
    docs: DataFrame,
    n: int = 4,
    per_cent: int = 85,
    frequent_from: int = 64,
    most_listed: int = 1_000_000,
    text: str = "text",
    key: str = "doc_id",
) -> DataFrame:
    """One row per document: its number of shingles and the smallest doc_id that links reach."""
    texts = docs.select(with_key(key).alias("doc"), F.col(text).cast("binary").alias("text"))
    order = token_order(texts, n, frequent_from, most_listed)
    index = saved(indexed(texts, n, per_cent, order), "set_index")
    full = index.filter((F.col("n_shingles") > 0) & (F.col("doc") != NO_KEY))
    same = ["sig_a", "sig_b", "n_shingles"]
    classes = full.groupBy(*same).agg(F.min("doc").alias("rep"))
    members = saved(full.select("doc", *same).join(classes, same).select("doc", "rep"), "set_classes")

    # Keys met in two classes or more, with the documents under them. Wide rows are not moved for that.
    copies = saved(members.filter("doc <> rep").select("doc").distinct(), "set_copies")
    firsts = by_ids(full, copies, "doc", "left_anti")
    postings = firsts.select("doc", F.col("n_shingles").alias("size"), F.explode("keys").alias("token"))
    shared = postings.groupBy("token").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    hits = saved(postings.join(shared, "token"), "shared_keys")

    links = _all_links(hits, Verifier(texts, firsts.select("doc", "bins", "n_shingles"), n, per_cent))
    found = connected_components(links, "a", "b")
    merged = (
        members.join(found, members["rep"] == found["node"], "left")
        .groupBy("doc")
        .agg(F.min(F.coalesce("component", "rep")).alias("component"))
    )
    return (
        index.select("doc", "n_shingles")
        .join(merged, "doc", "left")
        .withColumn("component", F.coalesce("component", without_key("doc")))
        .select(without_key("doc").alias(key), "n_shingles", F.col("component").alias("component_id"))
    )


def _pairs(entries: DataFrame, on: list[str], per_cent: int, low: tuple[str, ...] = ()) -> DataFrame:
    """Distinct pairs of documents that share the columns ``on``, lie in two components and may link by size.

    ``low``: columns with some of each document's own tokens. A pair that has one of them in common, smaller than the
    token at hand, is left to the smallest such token, where it meets too.
    """
    kept = [*on, *low]
    one = entries.select(*kept, F.col("doc").alias("a"), F.col("size").alias("size_a"), F.col("comp").alias("comp_a"))
    two = entries.select(*kept, F.col("doc").alias("b"), F.col("size").alias("size_b"), F.col("comp").alias("comp_b"))
    two = two.withColumnsRenamed({c: f"{c}_b" for c in low})
    met = (F.col("a") < F.col("b")) & (F.col("comp_a") != F.col("comp_b"))
    for c in low:
        earlier = F.col(c).isin(*[F.col(f"{d}_b") for d in low]) & (F.col(c) < one["token"])
        met = met & ~F.coalesce(earlier, F.lit(False))
    return one.join(two, on).filter(met & _fits(F.col("size_a"), F.col("size_b"), per_cent)).select("a", "b").distinct()


def _with_low(entries: DataFrame, most: int = 4) -> tuple[DataFrame, tuple[str, ...]]:
    """Entries with the smallest tokens of their document as columns; a document's entries, one for each of its keys,
    are brought together once."""
    names = tuple(f"low{k}" for k in range(most))
    each = entries.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("token", "k", "size", "comp"))).alias("own"))
    lows = [F.get("own", F.lit(k))["token"].alias(n) for k, n in enumerate(names)]
    return each.select("doc", *lows, F.inline("own")), names


def _final_links(entries: DataFrame, verifier: Verifier) -> DataFrame:
    """Links of all pairs under a common token that lie in different components."""
    marked, names = _with_low(entries)
    marked = saved(marked, "marked_entries")
    few = _pairs(marked.filter(F.col("k") <= BLOCK_FROM), ["token"], verifier.per_cent, names)
    many = verifier.near_in_blocks(marked.filter(F.col("k") > BLOCK_FROM), names)
    near = saved(verifier.near(few).unionByName(many).distinct(), "final_pairs")
    discard(marked)
    # One pair of each document first: in a group of copies that connects nearly all, at a cost that follows its size and
    # not its square. Then come the pairs that still lie apart.
    first = saved(near.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "first_pairs")
    links = verifier.confirmed(first)
    parts = connected_components(links, "a", "b")
    sides = [parts.select(F.col("node").alias(c), F.col("component").alias(f"part_{c}")) for c in ("a", "b")]
    placed = near.join(first, ["a", "b"], "left_anti").join(sides[0], "a", "left").join(sides[1], "b", "left")
    apart = F.coalesce("part_a", "a") != F.coalesce("part_b", "b")
    return links.unionByName(verifier.confirmed(placed.filter(apart).select("a", "b")))


def _all_links(
    hits: DataFrame, verifier: Verifier, crowd: int = 32, share: int = 4, per_entry: int = 24, turns: int = 12
) -> DataFrame:
    """Links that connect whatever links connect: every candidate pair is checked or connected by others.

    While the open pairs exceed ``per_entry`` for each index entry, documents under crowded keys (more than ``crowd``)
    first meet in groups of about four, under one ``share``-th of those keys in each round, as long as each round at
    least halves the open pairs.
    """
    # Each document is a component of its own at first, so every key is open and each entry has half its pairs.
    entries, found, turn = hits.withColumn("comp", F.col("doc")), None, 0
    total, pairs = hits.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("k") - 1) / 2), F.lit(0.0))).first()
    before, used = float("inf"), ()
    while True:
        if turn:
            by_part = entries.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("k"))
            counts = by_part.groupBy("token").agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.col("k")).alias("kk"))
            open_keys = saved(counts.filter(F.col("k") * F.col("k") > F.col("kk")), "open_keys")
            entries = saved(entries.join(open_keys.select("token", "k"), "token"), "open_entries")
            discard(*used)
            used = (open_keys, entries)
            pairs = float(open_keys.agg(F.sum((F.col("k") * F.col("k") - F.col("kk")) / 2)).first()[0] or 0)
        if pairs <= per_entry * total or turn >= turns or pairs > before / 2:
            break
        before, turn = pairs, turn + 1
        chosen = (F.col("k") > crowd) & (F.pmod(F.xxhash64("token", F.lit(turn)), F.lit(share)) == 0)
        groups = F.pmod(F.xxhash64("doc", "token", F.lit(turn)), F.ceil(F.col("k") / 4))
        meetings = _pairs(entries.filter(chosen).withColumn("group", groups), ["token", "group"], verifier.per_cent)
        fresh = verifier.links(meetings)
        if fresh.isEmpty():
            break
        # Stars so far and the new links connect what all links connect.
        parts = connected_components(fresh if found is None else found.unionByName(fresh), "a", "b")
        found = parts.select(F.col("node").alias("a"), F.col("component").alias("b"))
        entries = (
            entries.select("token", "doc", "size")
            .join(parts, entries["doc"] == parts["node"], "left")
            .select("token", "doc", "size", F.coalesce("component", "doc").alias("comp"))
        )
    last = _final_links(entries, verifier)
    return last if found is None else found.unionByName(last)
