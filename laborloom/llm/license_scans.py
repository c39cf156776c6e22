"""License scans: MinHash bands over overlapping windows find templates, exact containment confirms them.

A text is a list of words (lower case, signs at their ends dropped, words of
signs alone left out, so comment markers, bullets and rules do not break a
passage), a template likewise, both seen as five-word shingles. Templates of like size share blocks
of g shingles, and a window is so many blocks that wherever a template lies,
some window holds all of it. A window that holds ``share`` of a template with n
shingles has Jaccard similarity s of at least share n / (window + (1 - share)
n) with it; with bands of one row, ceil(log(1 - sure) / log(1 - s)) bands
collide with probability ``sure``. Candidates are then checked: the share of
the template's shingles that lie in the window, exactly.

Templates are a parameter of bounded size and travel with the tasks; documents
are scanned in one pass over whole texts, no shuffle. A text goes through the
bands of a group of templates only if it has as many of the group's shingles as
``share`` of its shortest template; no match is lost by that.

The default set does not depend on any corpus: notices and the full texts in
license_texts. Each template is reported for itself: where licenses share
wording (a BSD text of three clauses holds most of the one of two, an AGPL text
most of the GPL's), each that reaches ``share`` is, and containment tells them
apart. Names alone, such as SPDX identifiers, are below five words.

Reported positions count the text's words as separated by white space, those of
signs alone included.

Edge cases: null texts and texts of fewer than five words match nothing; a
template of fewer than five words is refused; of overlapping windows with one
template the best is reported, the first of equals; equal rows give equal
matches each; an empty table gives no rows; other columns do not take part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, floor, log, log2
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from laborloom.llm.common import with_key, without_key

# Notices of common licenses, as their texts ask for them or as they are usually cited.
NOTICES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": "Unless required by applicable law or agreed to in writing, software distributed under the License is "
    'distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "mit": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-terms": "under the terms of the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files, to deal in the Software without restriction",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
    "Public License as published by the Free Software Foundation",
    "gpl-2.0-only-notice": "it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
    "lgpl-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
    "General Public License as published by the Free Software Foundation",
    "agpl-notice": "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "agpl-3.0-section-13": "Notwithstanding any other provision of this License, if you modify the Program, your modified version "
    "must prominently offer all users interacting with it remotely through a computer network",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
    "was not distributed with this file, You can obtain one at",
    "epl-2.0-notice": "made available under the terms of the Eclipse Public License 2.0 which is available at",
    "epl-2.0-notice-v": "made available under the terms of the Eclipse Public License v2.0",
    "epl-1.0-notice": "made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met",
    "bsd-style": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file",
    "bsl-1.0-notice": "Distributed under the Boost Software License, Version 1.0.",
    "cc0-1.0-notice": "has waived all copyright and related or neighboring rights to",
    **{f"cc-{kind}-4.0": f"Licensed under CC {kind.upper()} 4.0." for kind in ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd")},
    **{
        f"cc-{kind}-4.0-notice": f"licensed under a Creative Commons {name} 4.0 International License"
        for kind, name in (
            ("by", "Attribution"),
            ("by-sa", "Attribution-ShareAlike"),
            ("by-nc", "Attribution-NonCommercial"),
            ("by-nd", "Attribution-NoDerivatives"),
            ("by-nc-sa", "Attribution-NonCommercial-ShareAlike"),
            ("by-nc-nd", "Attribution-NonCommercial-NoDerivatives"),
        )
    },
}


def full_texts() -> dict[str, str]:
    """The license texts beside this module, named after their files; read on the driver only."""
    folder = Path(__file__).resolve().parent / "license_texts"
    return {f"{p.stem}-text": p.read_text(encoding="utf-8") for p in sorted(folder.glob("*.txt"))}


TEMPLATES = NOTICES | full_texts()
SHINGLE = 5
EDGES = "\"'`.,;:!?()[]{}<>*#|/\\-%=~_+@$&^“”‘’«»–—…•·"


def normal_words(text: str | None) -> list[str]:
    return [s for w in (text or "").lower().split() if (s := w.strip(EDGES))]


def places_of(text: str | None) -> list[int]:
    """Place of each normal word among the words of the text."""
    return [i for i, w in enumerate((text or "").lower().split()) if w.strip(EDGES)]


@dataclass(frozen=True)
class Bands:
    """Templates whose windows are ``blocks`` blocks of ``block`` shingles, with their MinHash value per band."""

    block: int
    blocks: int
    names: tuple[str, ...]
    shingles: tuple[frozenset, ...]
    seeds: np.ndarray
    values: np.ndarray
    hashes: np.ndarray
    least: int


def hashes_of(words: list[str], known: dict[str, int]) -> np.ndarray:
    """Hash of each five-word shingle, in order."""
    import xxhash

    if len(words) < SHINGLE:
        return np.zeros(0, np.uint64)
    if len(known) > 400_000:
        known.clear()
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh3_64_intdigest(w)
    ids = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    value = np.zeros(len(ids) - SHINGLE + 1, np.uint64)
    for k in range(SHINGLE):
        value = (value ^ (value >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + ids[k : len(ids) - SHINGLE + 1 + k]
    return value ^ (value >> np.uint64(32))


def shingles_of(words: list[str]) -> list[tuple]:
    return [tuple(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)]


def banded(templates: dict[str, str], share: float, sure: float) -> list[Bands]:
    """Templates grouped by the power of two at or below half their number of shingles."""
    groups: dict[int, list[str]] = {}
    sets = {name: frozenset(shingles_of(normal_words(text))) for name, text in templates.items()}
    lists = {name: shingles_of(normal_words(text)) for name, text in templates.items()}
    for name, own in lists.items():
        if not own:
            raise ValueError(f"template {name} has fewer than {SHINGLE} words")
        groups.setdefault(2 ** max(0, floor(log2(max(len(own) / 2, 1)))), []).append(name)
    out = []
    for block, names in sorted(groups.items()):
        longest, shortest = max(len(lists[n]) for n in names), min(len(sets[n]) for n in names)
        blocks = ceil(longest / block) + 1
        held = ceil(share * shortest)
        alike = held / (block * blocks + shortest - held)
        bands = 1 if alike >= 1 else ceil(log(1 - sure) / log(1 - alike))
        seeds = np.random.default_rng(block).integers(1, 1 << 62, bands, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        values = [(hashes_of(normal_words(templates[n]), {})[:, None] * seeds >> np.uint64(32)).min(axis=0) for n in names]
        own = np.unique(np.concatenate([hashes_of(normal_words(templates[n]), {}) for n in names]))
        # A text that holds ``share`` of any template here has at least so many of these shingles.
        least = max(ceil(share * shortest - 1e-9), 1)
        sets_of = tuple(sets[n] for n in names)
        out.append(Bands(block, blocks, tuple(names), sets_of, seeds, np.array(values, np.uint32), own, least))
    return out


def windows_of(n: int, group: Bands) -> list[tuple[int, int]]:
    """(first, end) shingle of every window over n shingles."""
    starts = range(0, max(n - (group.blocks - 1) * group.block, 1), group.block)
    return [(s, min(s + group.blocks * group.block, n)) for s in starts]


MARKS = 1 << 22


def marks_of(groups: list[Bands]) -> np.ndarray:
    """Which low bits of a hash some template's shingle has: most other shingles are told apart by this alone."""
    marks = np.zeros(MARKS, bool)
    for group in groups:
        marks[group.hashes & np.uint64(MARKS - 1)] = True
    return marks


def worth_scanning(hashes: np.ndarray, sizes: np.ndarray, groups: list[Bands], marks: np.ndarray) -> list[np.ndarray]:
    """Per group, the texts with enough of its templates' shingles; others cannot hold ``share`` of any."""
    hits = np.flatnonzero(marks[hashes & np.uint64(MARKS - 1)])
    owner = np.searchsorted(np.cumsum(sizes), hits, side="right")
    met = [np.bincount(owner[np.isin(hashes[hits], g.hashes)], minlength=len(sizes)) for g in groups]
    return [np.flatnonzero(m >= g.least) for m, g in zip(met, groups, strict=True)]


def candidates(hashes: np.ndarray, sizes: np.ndarray, group: Bands) -> list[tuple[int, int, int]]:
    """(text, window, template) of every band collision; ``hashes`` holds the texts' shingles end to end."""
    used = np.flatnonzero(sizes)
    if not len(used):
        return []
    counts = -(-sizes[used] // group.block)
    ends = np.cumsum(counts)
    number = np.arange(ends[-1]) - np.repeat(ends - counts, counts)
    first = np.cumsum(sizes[used]) - sizes[used]
    starts = np.repeat(first, counts) + number * group.block
    met = np.zeros((len(group.names), ends[-1]), bool)
    for band, seed in enumerate(group.seeds):
        least = np.minimum.reduceat((hashes * seed >> np.uint64(32)).astype(np.uint32), starts)
        # A window's value is the least of its blocks; at a text's end there are fewer.
        window = least.copy()
        for k in range(1, group.blocks):
            inside = np.flatnonzero(number[k:] == number[:-k] + k) if len(number) > k else np.zeros(0, np.int64)
            window[inside] = np.minimum(window[inside], least[inside + k])
        for t in range(len(group.names)):
            met[t] |= window == group.values[t, band]
    template, at = np.nonzero(met)
    owner = np.repeat(used, counts)
    return [(int(owner[a]), int(number[a]), int(t)) for t, a in zip(template, at, strict=True)]


def confirm(words: list[str], window: tuple[int, int], wanted: frozenset) -> tuple[float, int, int]:
    """Share of the template's shingles in the window, and the first and last word that it covers there."""
    found = [i for i in range(*window) if tuple(words[i : i + SHINGLE]) in wanted]
    held = {tuple(words[i : i + SHINGLE]) for i in found}
    return (len(held) / len(wanted), found[0], found[-1] + SHINGLE) if found else (0.0, 0, 0)


def best_matches(matches: list[tuple[float, int, int]]) -> list[tuple[float, int, int]]:
    """Of matches that overlap the best, the first of equals."""
    kept: list[tuple[float, int, int]] = []
    for m in sorted(set(matches), key=lambda m: (-m[0], m[1], m[2])):
        if all(m[2] <= k[1] or m[1] >= k[2] for k in kept):
            kept.append(m)
    return sorted(kept, key=lambda m: m[1])


SCHEMA = "doc_id long, license string, containment double, start_word long, end_word long"


def scan_licenses(
    docs: DataFrame,
    templates: dict[str, str] = TEMPLATES,
    share: float = 0.8,
    sure: float = 0.999,
    text: str = "text",
    key: str = "doc_id",
) -> DataFrame:
    """One row per place where ``share`` or more of a template's shingles lie in one window."""
    groups = banded(templates, share, sure)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        marks = marks_of(groups)
        for batch in batches:
            words = [normal_words(t) for t in batch["text"]]
            each = [hashes_of(w, known) for w in words]
            sizes = np.array([len(h) for h in each], np.int64)
            hashes = np.concatenate(each) if each else np.zeros(0, np.uint64)
            found: dict[tuple[int, str], list] = {}
            for group, kept in zip(groups, worth_scanning(hashes, sizes, groups, marks), strict=True):
                if not len(kept):
                    continue
                for at, number, t in candidates(np.concatenate([each[k] for k in kept]), sizes[kept], group):
                    k = int(kept[at])
                    first = number * group.block
                    window = (first, min(first + group.block * group.blocks, int(sizes[k])))
                    match = confirm(words[k], window, group.shingles[t])
                    if match[0] >= share:
                        found.setdefault((k, group.names[t]), []).append(match)
            keys = batch["key"].tolist()
            places = {k: places_of(batch["text"].iloc[k]) for k, _ in found}
            rows = [
                (keys[k], name, held, places[k][first], places[k][end - 1] + 1)
                for (k, name), ms in sorted(found.items())
                for held, first, end in best_matches(ms)
            ]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    rows = docs.select(with_key(key).alias("key"), docs[text].alias("text")).mapInPandas(scan, SCHEMA)
    return rows.withColumn("doc_id", without_key("doc_id")).withColumnRenamed("doc_id", key)
