"""Licence notices by conditional compression.

Blocks: an accepted notice holds all key words of its template, so the places
of one of them, its anchor, lead to every notice.  Neighbouring anchors share a
block; a block reaches as many words to both sides as the longest notice may
have, and its anchors span as many at most, so its size is bounded.  A block
without the key words, or without as many words as the allowed edits must leave,
of any template of its anchors is no candidate.

Compression: a block's words (lower case, single spaces) are compressed alone and
with every template as zstandard raw-content dictionary, under the same
parameters.  A template's gain is the number of bytes that knowing it saves.  The
gain chooses: only templates that save at least their limit are looked for in
the block.  A template's limit follows from the edits that a notice may have: it
is a share of the least that was saved over its wordings with the allowed number
of words replaced at even distances, which leave the shortest runs of its words,
in texts of other words and beside the notices that are most like it (a block
that holds a similar notice is cheap without the template as well).  Short
notices may save nothing then; such a template has no limit and is looked for in
every block of its anchor.  The tests hold the choice against trying every
template everywhere.

Confirmation: the exact difference in words, at most one edit for every five
words (similarity 0.8).  Words that tell licences apart (names, versions, terms
such as lesser or noncommercial) must be the template's own, in order: none may
be missing, changed or inserted.  Of overlapping occurrences the one with the
smaller share of edits wins, then the longer.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator, Sequence
from itertools import product
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .alignment import Pattern
from .common import bounded_batches, small_batches

SIMILARITY, LEVEL = 0.8, 9
#: Share of the least saving that was seen which a notice must reach.
MARGIN = 0.25
#: Bytes below which a saving tells nothing.
NOISE = 8


class Template(NamedTuple):
    license: str
    keys: tuple[str, ...]
    text: str


# Published licence notices, their usual one-line forms, and the
# identifiers of licence tags.
_GNU = "you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
_GNU_LINE = "This work is licensed under the GNU {}, version {}."
_GNU_NAMES = [
    ("GPL-3.0", "General Public License", "3", ("general", "public", "3")),
    ("GPL-2.0", "General Public License", "2", ("general", "public", "2")),
    ("LGPL-3.0", "Lesser General Public License", "3", ("lesser", "3")),
    ("LGPL-2.1", "Lesser General Public License", "2.1", ("lesser", "2", "1")),
    ("LGPL-2.0", "Library General Public License", "2", ("library", "general", "2")),
    ("AGPL-3.0", "Affero General Public License", "3", ("affero", "3")),
]
_CC_TERMS = [((), ""), (("NC",), "NonCommercial"), (("SA",), "ShareAlike"), (("ND",), "NoDerivatives"),
             (("NC", "SA"), "NonCommercial-ShareAlike"), (("NC", "ND"), "NonCommercial-NoDerivatives")]
_TAGS = ["MIT", "Apache-2.0", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later",
         "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later",
         "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Unlicense",
         "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC-BY-ND-4.0"]
_NOTICES = [
    Template("MIT", ("mit",), "Released under the MIT License."),
    Template("MIT", ("mit",), "Licensed under the MIT License."),
    Template("MIT", ("permission", "free", "charge"), "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    Template("Apache-2.0", ("apache", "2", "0"), "Licensed under the Apache License, Version 2.0."),
    Template("Apache-2.0", ("apache", "2", "0"), "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    Template("MPL-2.0", ("mozilla", "2", "0"), "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    Template("BSD-2-Clause", ("redistribution", "binary"), "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    Template("BSD-3-Clause", ("neither", "endorse"), "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    Template("BSD", ("bsd",), "Released under the BSD License."),
    Template("BSD-2-Clause", ("bsd", "2", "clause"), "Released under the BSD 2-Clause License."),
    Template("BSD-3-Clause", ("bsd", "3", "clause"), "Released under the BSD 3-Clause License."),
    Template("ISC", ("permission", "fee"), "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    Template("Unlicense", ("unencumbered",), "This is free and unencumbered software released into the public domain."),
]
#: Words that tell licences apart, beside all numbers.
_TELLING = {"mit", "apache", "mozilla", "mpl", "gpl", "lgpl", "agpl", "lesser", "library", "affero", "bsd", "isc", "unlicense", "clause",
            "cc", "cc0", "sa", "nc", "nd", "attribution", "noncommercial", "sharealike", "noderivatives", "noderivs", "only"}

_WORD = re.compile(r"[^\W_]+")


def words_at(text: str) -> list[tuple[str, int, int]]:
    return [(m[0].lower(), m.start(), m.end()) for m in _WORD.finditer(text)]


def _tagged(name: str) -> Template:
    text = f"SPDX-License-Identifier: {name}"
    return Template(name, tuple(dict.fromkeys(w for w, _, _ in words_at(text) if w not in ("license", "identifier"))), text)


def templates() -> list[Template]:
    """Notices, the family of GNU headers and lines, the Creative Commons by
    terms and version, and tags."""
    out = list(_NOTICES)
    for name, title, version, keys in _GNU_NAMES:
        out += [Template(name, keys, _GNU_LINE.format(title, version)), Template(name, keys, _GNU.format(title, version))]
    for version, ((terms, long), place) in product(("4.0", "3.0"), product(_CC_TERMS, ("International", "Unported"))):
        if (place == "International") != (version == "4.0"):
            continue
        name = "-".join(("CC", "BY", *terms, version))
        short = ("cc", "by", *(t.lower() for t in terms), *version.split("."))
        full = ("creative", "commons", "attribution", *(w.lower() for w in long.split("-") if w), *version.split("."))
        title = "-".join(("Attribution", *(w for w in long.split("-") if w)))
        out += [Template(name, short, f"Licensed under CC {'-'.join(('BY', *terms))} {version}."),
                Template(name, full, f"This work is licensed under a Creative Commons {title} {version} {place} License.")]
    return out + [_tagged(t) for t in _TAGS]


TEMPLATES = templates()


def telling(words: Sequence[str]) -> list[str]:
    """The words that tell licences apart, in order."""
    return [w for w in words if w in _TELLING or w.isdigit()]


_rng = random.Random(0)
_BEFORE = " ".join("".join(_rng.choices("etaoinshrdlucmfwypvbgkqjxz", range(26, 0, -1), k=_rng.randrange(2, 9))) for _ in range(90)).encode() + b" "


class Matcher:
    """Finds templates in texts.  ``ranked``: templates are chosen by compression;
    without it every template is tried on every block (the plain form, for
    tests).  ``tried`` counts the searches of a template around an anchor."""

    def __init__(self, templates: Sequence[Template] = TEMPLATES, similarity: float = SIMILARITY, ranked: bool = True,
                 least: Sequence[float] | None = None):
        self.templates, self.ranked, self.tried = list(templates), ranked, 0
        self.patterns = [Pattern([w for w, _, _ in words_at(t.text)]) for t in templates]
        self.limits = [int(p.n * (1 - similarity) + 1e-9) for p in self.patterns]
        self.told = [telling(p.words) for p in self.patterns]
        # without key words the first ones are anchors, of which one outlasts the edits
        self.anchors: dict[str, list[int]] = {}
        for i, (t, p) in enumerate(zip(templates, self.patterns)):
            for w in {max(t.keys, key=len)} if t.keys else set(p.words[: self.limits[i] + 1]):
                self.anchors.setdefault(w, []).append(i)
        # no notice is longer, so one that holds an anchor lies within its block
        self.reach = [p.n + n for p, n in zip(self.patterns, self.limits)]
        self.most = max([1, *self.reach])
        texts = [" ".join(p.words).encode() for p in self.patterns]
        self.params = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, source_size=24 * self.most + len(_BEFORE), dict_size=max([64, *map(len, texts)]),
            write_content_size=False, write_checksum=False, write_dict_id=False)
        self.plain = zstandard.ZstdCompressor(compression_params=self.params)
        self.given = [zstandard.ZstdCompressor(compression_params=self.params, dict_data=zstandard.ZstdCompressionDict(
            t, dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for t in texts]
        none = len(self.plain.compress(b""))
        self.sizes = [max(1, len(self.plain.compress(t)) - none) for t in texts]
        none = float("-inf")
        self.least = list(least) if least else [self._least(i) for i in range(len(texts))] if ranked else [none] * len(texts)

    def _least(self, i: int) -> float:
        """The limit of template i, minus infinity for one that may save nothing."""
        p, rng = self.patterns[i], random.Random(i)
        # few letters: what costs little alone saves little
        word = lambda: "".join(rng.choices("abcdefgh", k=rng.randrange(2, 8)))
        other = lambda n: " ".join(word() for _ in range(n))
        mine = set(p.words)
        alike = sorted((j for j in range(len(self.patterns)) if j != i), key=lambda j: -len(mine & set(self.patterns[j].words)))[:6]
        beside = ["", other(self.most), *(" ".join(self.patterns[j].words) for j in alike), " ".join(p.words)]
        step, seen = p.n / (self.limits[i] + 1), []
        for shift in range(max(1, int(step))):
            words = p.words[:]
            for j in range(self.limits[i]):
                at = int(shift + (j + 0.5) * step) % p.n
                if words[at] not in self.templates[i].keys and words[at] not in self.told[i]:
                    words[at] = word()
            own = " ".join(words)
            seen += [self.saved(block, [i])[i] for text in beside for block in (f"{text} {own}", f"{own} {text}")]
        return MARGIN * min(seen) if min(seen) >= NOISE else float("-inf")

    def _may_hold(self, i: int, words: set[str]) -> bool:
        """A block of these words can hold an accepted notice of template i: its
        key words, and as many of its words as the edits must leave."""
        p = self.patterns[i]
        return words.issuperset(self.templates[i].keys) and sum(w in words for w in p.words) >= p.n - self.limits[i]

    def saved(self, block: str, among: Sequence[int] | None = None) -> dict[int, int]:
        """Bytes that knowing each template saves on a block of words.  The same
        words go before every block: the compressor codes few literals otherwise
        than many, which would hide a short notice's saving in a short block."""
        raw = _BEFORE + block.encode("utf-8", "surrogatepass")
        alone = len(self.plain.compress(raw))
        return {i: alone - len(self.given[i].compress(raw)) for i in (range(len(self.templates)) if among is None else among)}

    def rank(self, text: str) -> list[tuple[float, int]]:
        """(gain, template), most bytes saved first, of equals the shorter template:
        the gain is the saving as a share of the template's own compressed size."""
        got = self.saved(" ".join(w for w, _, _ in words_at(text)))
        return [(n / self.sizes[i], i) for i, n in sorted(got.items(), key=lambda x: (-x[1], self.sizes[x[0]], x[0]))]

    def _occurrences(self, i: int, words: list[str], at: int = 0) -> Iterator[tuple[int, int, int]]:
        """(edits, first, end) of every occurrence of template i that is confirmed."""
        todo = [(at, words)]
        while todo:
            at, words = todo.pop()
            if len(words) < self.patterns[i].n - self.limits[i]:
                continue
            edits, a, b = self.patterns[i].locate(words)
            if edits > self.limits[i]:
                continue
            # a number right after changed words may belong to the notice
            more = edits and b < len(words) and words[b].isdigit()
            if not more and set(self.templates[i].keys) <= set(words[a:b]) and telling(words[a:b]) == self.told[i]:
                yield edits, at + a, at + b
            todo += [(at, words[:a]), (at + b, words[b:])]

    def _blocks(self, plain: list[str]) -> Iterator[list[int]]:
        """Anchors of one block: neighbours, at most ``most`` words apart in all."""
        held: list[int] = []
        for p, w in enumerate(plain):
            if w in self.anchors:
                if held and p - held[0] > self.most:
                    yield held
                    held = []
                held.append(p)
        if held:
            yield held

    def find(self, text: str | None) -> list[tuple[int, int, str, int, float]]:
        """(start, end, license, edits, gain) of the notices, in order."""
        words = words_at(text or "")
        plain = [w for w, _, _ in words]
        best: dict[tuple[int, int, int], tuple[int, float]] = {}
        for places in self._blocks(plain):
            block = plain[max(0, places[0] - self.most):places[-1] + self.most]
            if self.ranked:
                here = set(block)
                if not any(self._may_hold(i, here) for i in {i for p in places for i in self.anchors[plain[p]]}):
                    continue  # an ordinary word that happens to be an anchor
            got = self.saved(" ".join(block))
            chosen = {i for i, n in got.items() if n >= self.least[i]} if self.ranked else set(got)
            for p in places:
                for i in self.anchors[plain[p]]:
                    if i not in chosen:
                        continue
                    self.tried += 1
                    first = max(0, p - self.reach[i])
                    for edits, x, y in self._occurrences(i, plain[first:p + self.reach[i]], first):
                        if x <= p < y and not self._goes_on(words, text, y):  # others belong to anchors of their own
                            gain = got[i] / self.sizes[i]
                            best[x, y, i] = edits, max(gain, best.get((x, y, i), (0, gain))[1])
        found = sorted((edits / self.patterns[i].n, -self.patterns[i].n, x, y, i, edits, gain)
                       for (x, y, i), (edits, gain) in best.items())
        out, taken = [], bytearray(len(plain))
        for _, _, x, y, i, edits, gain in found:
            if taken.find(1, x, y) < 0:
                taken[x:y] = b"\1" * (y - x)
                out.append((words[x][1], words[y - 1][2], self.templates[i].license, edits, gain))
        return sorted(out)

    @staticmethod
    def _goes_on(words: list[tuple[str, int, int]], text: str, end: int) -> bool:
        """The last word is a number that the next one continues, as in 2.1."""
        if end >= len(words) or not (words[end - 1][0].isdigit() and words[end][0].isdigit()):
            return False
        return text[words[end - 1][2]:words[end][1]] == "."


def by_clauses(found: list[tuple[int, int, str, int, float]], text: str) -> list[tuple[int, int, str, int, float]]:
    """The opening words of the two- and the three-clause licence are alike; the
    third clause, where it follows within 2,000 characters, decides."""
    out = []
    for j, (a, b, name, edits, gain) in enumerate(found):
        if name == "BSD-2-Clause" and text[a:a + 14].lower() == "redistribution":
            if any(x[2] == "BSD-3-Clause" and x[0] - b < 2_000 for x in found[j + 1:j + 4]):
                name = "BSD-3-Clause"
        out.append((a, b, name, edits, gain))
    return out


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """One row per input row: doc_id, n_hits, licenses (distinct names, sorted,
    comma-joined), hits (license:start:end:edits by start, comma-joined; code
    points, end exclusive), gains (of the hits, in their order: bytes saved as a
    share of the template's compressed size, three decimals).

    Whole texts are scanned; null and empty ones have no hits.  Ties between
    templates go to the earlier in the list.  Repeated rows give equal rows,
    null ids stay, an empty table gives an empty result; other columns are
    ignored, whatever their names."""
    listed = list(templates)
    least = Matcher(listed).least  # once, on the driver

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(listed, least=least)
        for b in small_batches(batches):
            found = [by_clauses(matcher.find(t), t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(f) for f in found], pa.int64()),
                 pa.array([",".join(sorted({x[2] for x in f})) for f in found], pa.string()),
                 pa.array([",".join(f"{lic}:{a}:{e}:{n}" for a, e, lic, n, _ in f) for f in found], pa.string()),
                 pa.array([",".join(f"{x[4]:.3f}" for x in f) for f in found], pa.string())],
                names=["doc_id", "n_hits", "licenses", "hits", "gains"])

    d = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return bounded_batches(d).mapInArrow(run, f"doc_id {dict(d.dtypes)['doc_id']}, n_hits bigint, licenses string, hits string, gains string")
