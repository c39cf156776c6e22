"""Packing along a space-filling curve.

Each document becomes token ids and a short vector: token ids hashed to signed
buckets, the buckets projected to a few dimensions. Each dimension is cut at
its quantiles into a grid, the grid cell gives a Hilbert key, and rows are
range-sorted by that key, so a sequence holds documents that lie near each
other on the curve. Along the curve documents are cut freely into sequences of
``length`` tokens; what is left at the end of a range goes into sequences whose
lengths are powers of two, so nothing is padded.

Tokens are made once: ids are staged with the vectors in the shared folder and
sorted from there, so the range sort samples a table and not the tokenizer. The
sort key ends with doc_id, so that many equal documents, which share a Hilbert
key, still spread over tasks. A task holds one batch and one open sequence.

Edge cases: null and empty texts are the end token alone; documents longer than
a sequence continue in the next; repeated rows are packed each for itself; an
empty table gives no rows; null keys stay null; other columns do not take part.
"""

from __future__ import annotations

import struct
import sys
import types
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laborloom.llm.common import saved, with_key, without_key

# Signs of ASCII: a run of them after a word is one piece of the tokenizer's splitting.
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
KEEP_WORDS = 400_000  # words remembered in each of two generations
PLACE_TOKENS = 500_000  # tokens whose directions are added up at once


class WordTokens:
    """Token ids of whole texts, remembered per word.

    The vocabulary drops white space and never joins across it, so a text's ids are those of its words. Words of
    Latin letters, with signs after them or not, skip the library's normalizer, which would only lower their case; any
    other word goes through the whole tokenizer, as does a text that holds a special token's string.
    """

    def __init__(self, vocabulary: str, end: int):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_str(vocabulary)
        self.model, self.end = self.full.model, end
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.signs = {b: 256 + n for n, b in enumerate(hidden)}
        self.special = [t.content for t in self.full.get_added_tokens_decoder().values()]
        wide = self.full.get_vocab_size() > 1 << 16
        self.code, self.type = ("I", np.dtype("<u4")) if wide else ("H", np.dtype("<u2"))
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def piece(self, piece: str) -> bytes:
        found = self.known.get(piece)
        if found is None:
            shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.signs)
            found = self.known[piece] = self.packed([t.id for t in self.model.tokenize(shown)])
        return found

    def word(self, word: str) -> bytes:
        """Ids of a text without white space."""
        low = word.lower()
        if not word or max(low) <= "\xff":
            core = low.rstrip(SIGNS)
            if not core or core.isalpha():
                return b"".join(self.piece(p) for p in (core, low[len(core) :]) if p)
        return self.packed(self.full.encode(word, add_special_tokens=False).ids)

    def text(self, text: str | None) -> bytes:
        last = self.packed([self.end])
        if not text:
            return last
        if any(s in text for s in self.special):
            return self.packed(self.full.encode(text, add_special_tokens=False).ids) + last
        known, words = self.known, text.replace("\n", " ").split(" ")
        try:
            found = b"".join([known[w] for w in words])
        except KeyError:
            older = self.older
            for w in words:
                if w not in known:
                    known[w] = older[w] if w in older else self.word(w)
            found = b"".join([known[w] for w in words])
        if len(known) > KEEP_WORDS:
            # Words in use come back from the older generation as they are met.
            self.known, self.older = {}, known
        return found + last


def tokens_of(vocabulary: str, end: int) -> WordTokens:
    """One tokenizer per worker process: a worker serves many tasks, and its known words stay useful.

    Tasks bring their functions along, so what outlives a task is kept in a module made for that.
    """
    kept = vars(sys.modules.setdefault("laborloom_kept", types.ModuleType("laborloom_kept")))
    name = f"tokens {zlib.crc32(vocabulary.encode())} {end}"
    if name not in kept:
        kept[name] = WordTokens(vocabulary, end)
    return kept[name]


def projection(vocabulary: int, buckets: int, dims: int, seed: int) -> np.ndarray:
    """Row per token id: its bucket's signed random direction."""
    rng = np.random.default_rng(seed)
    directions = rng.standard_normal((buckets, dims)).astype(np.float32)
    ids = np.arange(vocabulary, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    signs = ((ids >> np.uint64(20)) & np.uint64(1)).astype(np.float32) * 2 - 1
    return directions[(ids >> np.uint64(32)).astype(np.int64) % buckets] * signs[:, None]


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of grid coordinates (Skilling's transposed form, all rows at once)."""
    x = cells.T.astype(np.int64).copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            turned = (x[i] & q) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(turned, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[dims - 1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def mean_directions(ids: list[bytes], rows: np.ndarray, kind: np.dtype) -> np.ndarray:
    """Mean direction of each document's tokens; many documents in one gather."""
    sizes = np.array([len(i) // kind.itemsize for i in ids], np.int64)
    found, first = [np.zeros((0, rows.shape[1]), np.float32)], 0
    while first < len(ids):
        last = first + max(1, int(np.searchsorted(np.cumsum(sizes[first:]), PLACE_TOKENS, "right")))
        starts = np.cumsum(sizes[first:last]) - sizes[first:last]
        gathered = rows[np.frombuffer(b"".join(ids[first:last]), kind)]
        found.append(np.add.reduceat(gathered, starts, axis=0) / sizes[first:last, None].astype(np.float32))
        first = last
    return np.concatenate(found)


def tokenized(docs: DataFrame, vocabulary: str, end: int, dims: int, buckets: int, seed: int, text: str, key: str) -> DataFrame:
    """key, ids (little-endian bytes) and the document's place in ``dims`` dimensions."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = tokens_of(vocabulary, end)
        rows = projection(tokens.full.get_vocab_size(), buckets, dims, seed)
        for batch in batches:
            ids = [tokens.text(t) for t in batch[text]]
            places = list(mean_directions(ids, rows, tokens.type))
            yield pd.DataFrame({"key": batch[key], "ids": ids, "place": places, "width": tokens.type.itemsize})

    narrow = docs.select(with_key(key).alias(key), text)
    return narrow.mapInPandas(encode, "key long, ids binary, place array<float>, width int")


def pack(
    docs: DataFrame,
    tokenizer: str,
    end: int = 2,
    length: int = 4096,
    dims: int = 3,
    bits: int = 8,
    buckets: int = 4096,
    seed: int = 5,
    text: str = "text",
    key: str = "doc_id",
) -> DataFrame:
    """One row per piece: whose it is, where it starts there, how long it is, its ids' checksum, and where it lies."""
    # The vocabulary travels with the tasks: executors need not have the file.
    vocabulary = Path(tokenizer).read_text(encoding="utf-8")
    staged = saved(tokenized(docs, vocabulary, end, dims, buckets, seed, text, key), "tokens")
    cells = 1 << bits
    steps = [k / cells for k in range(1, cells)]
    cuts = staged.select([F.percentile_approx(F.col("place")[d], steps, 10_000).alias(f"d{d}") for d in range(dims)]).first()
    grid = [np.array(cuts[d] if cuts[d] is not None else [], np.float32) for d in range(dims)]

    @F.pandas_udf("long")
    def curve(places: pd.Series) -> pd.Series:
        at = np.stack(places.to_numpy()) if len(places) else np.zeros((0, dims), np.float32)
        return pd.Series(hilbert_keys(np.stack([np.searchsorted(grid[d], at[:, d]) for d in range(dims)], axis=1), bits))

    placed = staged.select("key", "ids", "width", curve("place").alias("curve"))
    # Bytes of ids settle the order of rows that share a doc_id.
    ordered = placed.withColumn("tie", F.xxhash64("ids")).repartitionByRange("curve", "key", "tie")
    ordered = ordered.sortWithinPartitions("curve", "key", "tie").select("key", "ids", "width")

    def lay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sequence, room_used = TaskContext.get().partitionId() << 36, 0
        held: list[tuple] = []  # pieces of the open sequence, at most ``length``

        def piece(doc, start, n, ids, total):
            crc = zlib.crc32(ids[start : start + n].astype("<u4").tobytes())
            return (doc, start, n, crc, total)

        for batch in batches:
            out: list[tuple] = []
            for doc, raw, width in zip(batch["key"], batch["ids"], batch["width"], strict=True):
                ids = np.frombuffer(raw, f"<u{width}")
                start = 0
                while start < len(ids):
                    n = min(len(ids) - start, length - room_used)
                    held.append((doc, start, n, ids, len(ids), room_used))
                    start, room_used = start + n, room_used + n
                    if room_used == length:
                        out += [(*piece(*h[:5]), sequence, h[5]) for h in held]
                        held, room_used, sequence = [], 0, sequence + 1
            yield _pieces(out)
        # The last tokens of this range: the longest power of two that they fill, again and again.
        out, offset, room = [], 0, _power_below(room_used)
        left = room_used
        for doc, start, n, ids, total, _ in held:
            while n:
                part = min(n, room - offset)
                out.append((*piece(doc, start, part, ids, total), sequence, offset))
                start, n, offset, left = start + part, n - part, offset + part, left - part
                if offset == room:
                    offset, room, sequence = 0, _power_below(left), sequence + 1
        yield _pieces(out)

    pieces = ordered.mapInPandas(lay, SCHEMA)
    return pieces.withColumn("doc_id", without_key("doc_id")).withColumnRenamed("doc_id", key)


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _power_below(n: int) -> int:
    return 1 << (n.bit_length() - 1) if n else 0


def _pieces(rows: list[tuple]) -> pd.DataFrame:
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return pd.DataFrame(rows, columns=names).astype("int64")
