"""Ranked search against plain scoring of every document; pair bounds hold and read less; the SQL form agrees."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from catalog.compare import compare
from laborloom.llm import pair_search, queries
from tests.conftest import SF_DIR

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, item_id string, rank string, score string, doc string"


def terms(text):
    lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return TERM.findall(lowered)


def plain(docs, items, k):
    texts = [(d, terms(t)) for d, t, *_ in docs]
    n_docs = sum(bool(t) for _, t in texts)
    length = sum(len(t) for _, t in texts)
    holding = Counter(t for _, ts in texts for t in set(ts))
    asked = {}
    for item, text, *_ in items:
        asked[item] = min(x for x in (asked.get(item), text) if x is not None) if (asked.get(item) or text) is not None else None
    out = set()
    for item, text in asked.items():
        wanted, found = terms(text), []
        for d, ts in texts:
            tf, score = Counter(ts), 0
            for t in wanted:
                if tf[t]:
                    m = 100 - 25 + (25 * len(ts) * n_docs) // length
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 12 * m))
            if score > 0:
                found.append((-score, d is not None, d or 0, d))
        out |= {(item, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(found)[:k], 1)}
    return out


def rows_of(result):
    found = [(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in result.collect()]
    assert len(found) == len(set(found))
    return set(found)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(9)
    vocabulary = [f"w{int(rng.paretovariate(0.6)) % 400}" for _ in range(4000)] + ["Été", "ΣΑΣ", "中文", "It's", "A.B", "½x", " "]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 80))), "i", "r", "s", "d") for i in range(500)]
    docs += [(500 + i, docs[3][1], "", "", "", "") for i in range(40)]  # copies: ties
    docs += [docs[7], docs[7], (None, docs[8][1], "", "", "", ""), (None, None, "", "", "", ""), (600, "", "", "", "", "")]
    docs += [(601, " \n!? ", "", "", "", ""), (602, "long " * 30_000 + docs[9][1], "", "", "", ""), (602, "x\x00y\x7fz", "", "", "", "")]
    items = [(i, docs[rng.randrange(500)][1]) for i in range(25)]
    items += [(30, "W1 w1 w1 été ÉTÉ"), (31, None), (32, ""), (33, "nowhere"), (34, "w1"), (34, "w2 w3"), (None, "w5 it s 中文"), (35, "long")]
    return docs, [(i, t, "", "") for i, t in items]


@pytest.mark.parametrize(("k", "block_items", "shard_postings"), [(20, 2000, 2_000_000), (3, 7, 900)])
def test_matches_plain_scoring(spark, corpus, k, block_items, shard_postings):
    docs, items = corpus
    got = pair_search.ranked_search(
        spark.createDataFrame(docs, DOCS),
        spark.createDataFrame(items, "item_id long, text string, rank string, doc_id string"),
        k=k,
        block_items=block_items,
        shard_postings=shard_postings,
    )
    assert rows_of(got) == plain(docs, items, k)


def test_parts_of_a_long_text_never_part_a_term(monkeypatch):
    text = ("ab, Cde-é " * 50 + "x" * 300 + " y ").encode()
    whole = [t for part in pair_search.terms_of(text, pair_search.separators()) for t in part]
    monkeypatch.setattr(pair_search, "PART", 17)
    assert [t for part in pair_search.terms_of(text, pair_search.separators()) for t in part] == whole
    assert [t.decode() for t in whole] == terms(text.decode())


def test_pair_bounds_hold_and_read_less():
    rng = np.random.default_rng(2)
    count, n_terms = 3000, 40
    held = [np.flatnonzero(rng.random(n_terms) < np.linspace(0.01, 0.5, n_terms)) for _ in range(count)]
    times = [rng.integers(1, 4, len(h)) for h in held]
    # Pairs of heavy terms that hardly ever meet with high impacts.
    forward = pa.table(
        {
            "doc": np.arange(count),
            "n": np.array([int(t.sum()) + 20 for t in times]),
            "terms": pa.array([h.astype(np.int32) for h in held], pa.list_(pa.int32())),
            "times": pa.array([t.astype(np.int32) for t in times], pa.list_(pa.int32())),
        }
    )
    holding = Counter(int(t) for h in held for t in h)
    weights = np.array([pair_search.weight_of(count, holding[t]) for t in range(n_terms)])
    chosen = [np.sort(rng.choice(n_terms, 8, replace=False)) for _ in range(30)]
    chosen = [c[np.lexsort((c, -weights[c]))] for c in chosen]
    items = pair_search.Items(chosen, [rng.integers(1, 3, 8) for _ in chosen], weights, count, int(sum(t.sum() + 20 for t in times)))
    index = pair_search.build_shard(forward, items, 0)
    read = defaultdict(int)
    for i in range(len(chosen)):
        every = pair_search.Shard(index, items)
        ids, scores = every.search(i, 10, 0)
        for with_pairs in (False, True):
            shard = pair_search.Shard(index, items)
            bounds = shard.bounds(i, with_pairs)
            for j in range(9):
                part = np.zeros(count, np.int64)
                for t, r in zip(chosen[i][::-1][:j].tolist(), items.repeats[i][::-1][:j].tolist(), strict=True):
                    shard.add(part, t, r)
                assert part.max(initial=0) <= bounds[j]
            shard.opened = 0
            again = shard.search(i, 10, int(scores[-1]), with_pairs)
            assert again[0].tolist() == ids.tolist() and again[1].tolist() == scores.tolist()
            read[with_pairs] += shard.opened
        read["all"] += sum(len(every.lists[t][0]) for t in chosen[i].tolist())
    assert read[True] <= read[False] < read["all"]


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a b", "", "", "", "")], DOCS)
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert pair_search.ranked_search(none, items).count() == 0
    assert pair_search.ranked_search(some, items.limit(0)).count() == 0
    assert pair_search.ranked_search(some, items).count() == 1


def test_query_matches_its_sql(spark, duck):
    name = "op12_ranked_search"
    assert compare(spark, duck, SF_DIR, queries.QUERIES[name], queries.SQL[name]).startswith("ok")
