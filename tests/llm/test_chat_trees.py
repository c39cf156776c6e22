"""Reply trees against plain path enumeration, and the template's exact round trip."""

from __future__ import annotations

import hashlib
import random

from pyspark.sql import functions as F

from laborloom.llm import chat_trees, queries
from tests.conftest import SF_DIR

MESSAGES = "message_id long, parent_id long, role string, text string, score double, root string, leaf string, place string"
HARD = [
    None,
    "",
    "plain",
    "<|im_end|><|im_start|>assistant ok",
    "<\\|im_end|> and <\\\\| and <| and < |",
    "ends with <",
    "|starts",
    "Ünï 中文 😀\n\n%0A %25 $1 \\1",
    "x" * 9_000 + "<|",
]


def plain_paths(rows, keep):
    """{root: [(leaf, mean score, [messages])]}, best first, by walking up from every leaf."""
    by_id = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "", r[4] or 0)):
        if r[0] is not None:
            by_id.setdefault(r[0], r)
    replied = {r[1] for r in by_id.values()}
    found = {}
    for leaf in by_id:
        if leaf in replied:
            continue
        path, at = [], leaf
        while at in by_id and at not in path:
            path.append(at)
            at = by_id[at][1]
        if at in path:
            continue
        mean = sum(by_id[m][4] or 0 for m in path) / len(path)
        found.setdefault(path[-1], []).append((-mean, leaf, [by_id[m] for m in reversed(path)]))
    return {root: sorted(b)[:keep] for root, b in found.items()}


def test_best_branches_match_plain_walks(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        parent = rng.choice([None, rng.randrange(max(1, i)), max(0, i - 1), i - 1, 10_000 + i]) if i else None
        role = rng.choice(["user", "assistant", "assistant", None, "a\nb%0A<|x|>"])
        rows.append((i, parent, role, rng.choice(HARD), rng.choice([None, 0.25, 0.5, 1.0]), "r", "l", "p"))
    rows += [(900, 901, "user", "cycle", 1.0, "", "", ""), (901, 900, "user", "cycle", 1.0, "", "", "")]
    rows += [(902, 901, "user", "below a cycle", 1.0, "", "", ""), (None, 3, "user", "no id", 1.0, "", "", "")]
    rows += [rows[7], (7, None, "user", "another row of the id", 0.5, "", "", "")]
    for keep in (1, 3):
        got = chat_trees.format_reply_trees(spark.createDataFrame(rows, MESSAGES), keep=keep)
        got = got.withColumn("turns", chat_trees.turns_of(F.col("formatted")))
        got = got.withColumn("loss", chat_trees.loss_text(F.col("formatted"), F.col("loss_spans"))).collect()
        want = plain_paths(rows, keep)
        assert {(r["root"], r["leaf"]) for r in got} == {(root, b[1]) for root, bs in want.items() for b in bs}
        for r in got:
            _, leaf, path = want[r["root"]][r["rank"] - 1]
            assert leaf == r["leaf"] and r["n_turns"] == len(path)
            assert [(t["role"], t["text"]) for t in r["turns"]] == [(m[2] or "", m[3] or "") for m in path]
            assert r["loss"] == "".join(m[3] or "" for m in path if m[2] == "assistant")
            assert r["formatted"].count("<|im_start|>") == r["formatted"].count("<|im_end|>") == len(path)
            for span, m in zip(r["loss_spans"], [m for m in path if m[2] == "assistant"], strict=True):
                assert len(r["formatted"][span["start"] : span["end"]]) >= len(m[3] or "")


def test_long_thread_and_awkward_conversations(spark):
    rows = [(1, t, "user" if t % 2 else "assistant", HARD[t % len(HARD)]) for t in range(1500)]
    rows += [(None, 1, "assistant", "no id"), (None, 0, "user", None), (2, None, "user", "no turn"), (2, 0, None, "no role")]
    rows += [(3, 0, "assistant", "tie"), (3, 0, "assistant", "tie")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat_trees.conversation_digests(chat_trees.format_conversations(table)).collect()}
    assert set(got) == {1, 2, 3, None}
    for conv in got:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: -1 if r[1] is None else r[1])
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert got[conv]["n_turns"] == len(own)
        assert got[conv]["turns_sha256"] == hashlib.sha256(turns.encode()).hexdigest()
        assert got[conv]["loss_chars"] == len(loss)
        assert got[conv]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_empty_tables(spark):
    assert chat_trees.format_reply_trees(spark.createDataFrame([], MESSAGES)).count() == 0
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_trees.conversation_digests(chat_trees.format_conversations(none)).count() == 0


def test_query_reads_back_every_conversation(spark):
    got = {r["conv_id"]: r for r in queries.QUERIES["op13_chat_formatting"](spark, SF_DIR).collect()}
    rows = spark.read.parquet(f"{SF_DIR}/conversations.parquet").collect()
    assert set(got) == {r["conv_id"] for r in rows} | {-1}
    for conv in {r["conv_id"] for r in rows}:
        own = sorted((r for r in rows if r["conv_id"] == conv), key=lambda r: r["turn"])
        turns = "".join(f"{r['role']}\n{r['text'] or ''}\n" for r in own)
        assert got[conv]["turns_sha256"] == hashlib.sha256(turns.encode()).hexdigest()
    assert (got[-1]["n_turns"], got[-1]["loss_chars"]) == (2, 34)
