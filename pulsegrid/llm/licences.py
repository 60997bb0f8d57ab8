"""Licence scan by a positional index of rare template words.

Licence templates are indexed by their rarest words, by inverse document frequency over all documents: each posting is a (template,
position). A document's occurrences of these words are joined with the postings; hits whose positions differ by nearly the
same amount lie on one diagonal, and a diagonal with enough different words is a candidate. It is accepted if all mandatory
phrases of the template stand there word for word and enough of the template's weight is covered. The base phrases are posted too, each
under its rarest word alone: wherever that word occurs, the whole phrase is looked for around it, so no place is missed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.text import ALNUM, hash_of, HashSet, lean, word_blocks

# Phrases of the base scan and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


@dataclass(frozen=True)
class Template:
    """A licence notice and the phrases that must stand in it."""

    label: str
    text: str
    mandatory: tuple[str, ...]


# Wordings of public licence notices.
TEMPLATES = (
    Template("mit", "Released under the MIT License.", ("mit license",)),
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        ("permission is hereby granted free of charge", "to deal in the software without restriction"),
    ),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0.", ("apache license version 2 0",)),
    Template(
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at",
        ("apache license version 2 0", "you may not use this file except in compliance with the license"),
    ),
    Template("gpl-3.0", "This work is licensed under the GNU General Public License, version 3.", ("gnu general public license version 3",)),
    Template("gpl-2.0", "This work is licensed under the GNU General Public License, version 2.", ("gnu general public license version 2",)),
    Template(
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation",
        ("redistribute it and or modify it under the terms of the gnu general public license",),
    ),
    Template("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ("gnu lesser general public license",)),
    Template("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", ("gnu affero general public license",)),
    Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met",
        ("redistribution and use in source and binary forms", "with or without modification are permitted"),
    ),
    Template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice",
        ("permission to use copy modify and or distribute this software for any purpose with or without fee",),
    ),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ("mozilla public license v 2 0",)),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0.", ("cc by nc 4 0",)),
    Template("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0.", ("cc by sa 4 0",)),
    Template("cc-by-4.0", "Licensed under CC BY 4.0.", ("cc by 4 0",)),
    Template("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0 international",)),
    Template("cc0", "To the extent possible under law, the author has dedicated this work to the public domain, CC0", ("dedicated this work to the public domain",)),
    Template("unlicense", "This is free and unencumbered software released into the public domain.", ("free and unencumbered software released into the public domain",)),
    Template("proprietary", "All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited", ("unauthorized copying of this file",)),
)


@dataclass(frozen=True)
class Settings:
    """`anchors` rarest words of each template are indexed; `slack` words may be missing or added between two of them."""

    anchors: int = 6
    slack: int = 4
    min_anchor_share: float = 0.5
    min_coverage: float = 0.6
    band: int = 65
    window: int = 1 << 16


def words_of(text: str) -> list[str]:
    """Words by the rule of the scan: A-Z lower-cased, then runs of digits, a-z and other scripts."""
    small = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", small)


def _hashes(words: list[str]) -> np.ndarray:
    return np.array([hash_of(w) for w in words], dtype=np.uint64)


def document_frequencies(docs: DataFrame, templates: tuple[Template, ...]) -> tuple[int, dict[str, int]]:
    """Number of rows of `docs`, and how many hold each word of a template or base phrase; tasks send one count a word."""
    vocabulary = sorted({w for text in (*BASE, *(t.text for t in templates)) for w in words_of(text)})
    hashes = _hashes(vocabulary)
    order = np.argsort(hashes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, wanted = np.zeros(len(vocabulary), np.int64), 0, HashSet(hashes)
        for batch in batches:
            rows += batch.num_rows
            for block in word_blocks(batch.column(0), ALNUM):
                at, rank = wanted.find(block.hashes())
                pairs = np.unique(block.owner()[at] * len(vocabulary) + rank)
                held += np.bincount(pairs % len(vocabulary), minlength=len(vocabulary))
        words = [vocabulary[k] for k in order] + [None]
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(np.r_[held, rows])], names=["word", "n"])

    found = docs.select("text").mapInArrow(lean(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {r["word"]: r["n"] for r in found}
    return counts.pop(None, 0), counts


class Index:
    """Anchor words with postings (template, position), and what candidates are verified with."""

    #: Cells of the comparison of a template with the words of a run that are held at once.
    CELLS = 1 << 18

    def __init__(self, templates: tuple[Template, ...], rows: int, frequency: dict[str, int], s: Settings):
        self.settings, self.templates = s, templates
        self.words, self.weights, self.phrases, self.needed = [], [], [], []
        posts: dict[int, list[tuple[int, int]]] = {}
        for t, template in enumerate(templates):
            words = words_of(template.text)
            idf = np.array([np.log((rows + 1) / (frequency.get(w, 0) + 1)) + 1e-3 for w in words])
            rare = sorted(set(words), key=lambda w: (-idf[words.index(w)], w))[: s.anchors]
            hashes = _hashes(words)
            for q, w in enumerate(words):
                if w in rare:
                    posts.setdefault(int(hashes[q]), []).append((t, q))
            self.words.append(hashes)
            self.weights.append(idf)
            self.needed.append(max(2, int(np.ceil(s.min_anchor_share * len(rare)))))
            self.phrases.append([(self._place(words, words_of(p)), _hashes(words_of(p))) for p in template.mandatory])
        self.vocabulary = HashSet(list(posts))
        listed = [posts[int(h)] for h in self.vocabulary.values]
        self.bounds = np.r_[0, np.cumsum([len(x) for x in listed])]
        self.posts = np.array([p for x in listed for p in x], dtype=np.int64).reshape(-1, 2)
        self.base = [(_hashes(phrase.split()), label) for phrase, label in BASE.items()]
        # (phrase, position) of the rarest word of each base phrase.
        self.base_posts: dict[int, list[tuple[int, int]]] = {}
        for k, phrase in enumerate(BASE):
            held = phrase.split()
            q = min(range(len(held)), key=lambda j: (frequency.get(held[j], 0), j))
            self.base_posts.setdefault(int(self.base[k][0][q]), []).append((k, q))
        self.base_words = HashSet(list(self.base_posts))

    @staticmethod
    def _place(words: list[str], phrase: list[str]) -> int:
        for q in range(len(words) - len(phrase) + 1):
            if words[q : q + len(phrase)] == phrase:
                return q
        raise ValueError(f"a mandatory phrase is not in its template: {' '.join(phrase)}")

    def base_places(self, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        """(label, documents, places) of each base phrase: its posted word, and the others at the positions that it implies."""
        at, rank = self.base_words.find(words)
        for r, h in enumerate(self.base_words.values):
            for k, q in self.base_posts[int(h)]:
                phrase, label = self.base[k]
                start = at[rank == r] - q
                doc = np.searchsorted(first, start + q, side="right") - 1
                inside = (start >= first[doc]) & (start + len(phrase) <= first[doc + 1])
                start, doc = start[inside], doc[inside]
                for j, word in enumerate(phrase):
                    same = words[start + j] == word
                    start, doc = start[same], doc[same]
                yield label, doc, start

    def candidates(self, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(document, template, lowest and highest diagonal) of runs of hits with enough different anchors.

        Words are taken in overlapping windows, so memory is bounded whatever a text repeats.
        """
        s = self.settings
        reach = max((len(w) for w in self.words), default=0) + 2 * s.slack
        every, rank = self.vocabulary.find(words)
        for lo in range(0, len(words), s.window):
            a, b = np.searchsorted(every, [lo, lo + s.window + reach])
            at, r = every[a:b], rank[a:b]
            if len(at) < 2:
                continue
            size = self.bounds[r + 1] - self.bounds[r]
            each = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.bounds[r], size)
            template, q = self.posts[each].T
            where = np.repeat(at, size)
            doc = np.searchsorted(first, where, side="right") - 1
            diagonal = where - q
            order = np.lexsort((q, diagonal, template, doc))
            doc, template, diagonal, which = doc[order], template[order], diagonal[order], np.repeat(r, size)[order]
            new = np.ones(len(doc), dtype=bool)
            new[1:] = (doc[1:] != doc[:-1]) | (template[1:] != template[:-1]) | (diagonal[1:] - diagonal[:-1] > s.slack)
            start = np.flatnonzero(new)
            end = np.r_[start[1:], len(doc)]
            for x, y in zip(start[end - start > 1].tolist(), end[end - start > 1].tolist(), strict=True):
                t = int(template[x])
                if y - x >= self.needed[t] and len(set(which[x:y].tolist())) >= self.needed[t]:
                    yield int(doc[x]), t, int(diagonal[x]), int(diagonal[y - 1])

    def coverage(self, words: np.ndarray, lo: int, hi: int, t: int, low: int, high: int) -> float:
        """Largest share of the template's weight found in document words lo to hi in a band of diagonals that holds all its phrases.

        A band is as wide as a notice with `slack` words between any two of its words. A run of more diagonals is gone through whole,
        band by band in bounded steps; 0 if no band holds all phrases.
        """
        s = self.settings
        places = []
        for q, phrase in self.phrases[t]:
            a, b = max(lo, low + q - s.slack), min(hi, high + q + s.slack + len(phrase))
            places.append(a + consecutive(words[a:b], phrase) - q)
            if not len(places[-1]):
                return 0.0
        template, weights = self.words[t], self.weights[t]
        first, last, best = low - s.slack, high + s.slack, 0.0
        width = min(last - first + 1, max(s.band, s.slack * len(template)) + 2 * s.slack)
        step = max(1, self.CELLS // len(template))
        for start in range(first, last - width + 2, step):
            bands = np.arange(start, min(start + step, last - width + 2))
            whole = np.all([np.searchsorted(p, bands + width) > np.searchsorted(p, bands) for p in places], axis=0)
            if not whole.any():
                continue
            end = int(bands[-1]) + width
            at = np.arange(len(template))[:, None] + np.arange(start, end)[None, :]
            hit = (words[np.clip(at, 0, len(words) - 1)] == template[:, None]) & (at >= lo) & (at < hi)
            held = np.zeros((len(template), hit.shape[1] + 1), dtype=np.int32)
            np.cumsum(hit, axis=1, out=held[:, 1:])
            shares = weights @ (held[:, width:] > held[:, :-width])
            best = max(best, float(shares[whole].max() / weights.sum()))
        return best


def consecutive(words: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Where the words of a phrase stand one after another."""
    n = len(words) - len(phrase) + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    hit = np.ones(n, dtype=bool)
    for k, h in enumerate(phrase):
        hit &= words[k : k + n] == h
    return np.flatnonzero(hit)


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_licences(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, settings: Settings | None = None) -> DataFrame:
    """Licences of each whole text of `docs` (doc_id, text); one row for each row, none is shuffled.

    `n_base`, `first_word`, `last_word` and `base_labels` are those of the base phrases; `labels` adds those of accepted templates.
    `score` is the largest coverage of an accepted template, 0.5 if only base phrases stand there, 0 without a licence.
    Null and empty texts have no words, an empty table gives no rows. Repeated rows are scanned each; ties do not occur, since all
    labels are given. Long texts are one block each and are read whole; other columns are not read.
    """
    s = settings or Settings()
    index = Index(templates, *document_frequencies(docs, templates), s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            n_words, n_base = np.zeros(n, np.int64), np.zeros(n, np.int64)
            first, last = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
            base: list[set[str]] = [set() for _ in range(n)]
            more: list[set[str]] = [set() for _ in range(n)]
            score = np.zeros(n)
            for block in word_blocks(batch.column(1), ALNUM):
                words = block.hashes()
                n_words[block.lo : block.hi] = block.counts
                for label, doc, at in index.base_places(words, block.first):
                    place = at - block.first[doc]
                    np.add.at(n_base, block.lo + doc, 1)
                    np.minimum.at(first, block.lo + doc, place)
                    np.maximum.at(last, block.lo + doc, place)
                    for d in np.unique(doc).tolist():
                        base[block.lo + d].add(label)
                for d, t, low, high in index.candidates(words, block.first):
                    found = index.coverage(words, int(block.first[d]), int(block.first[d + 1]), t, low, high)
                    if found >= s.min_coverage:
                        more[block.lo + d].add(index.templates[t].label)
                        score[block.lo + d] = max(score[block.lo + d], min(found, 1.0))
            score = np.where((score == 0) & (n_base > 0), 0.5, score)
            none = n_base == 0
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n_words),
                    pa.array(n_base),
                    pa.array(first, mask=none),
                    pa.array(last, mask=none),
                    pa.array([",".join(sorted(x)) for x in base], pa.string()),
                    pa.array([",".join(sorted(x | y)) for x, y in zip(base, more, strict=True)], pa.string()),
                    pa.array(score),
                ],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), SCHEMA)
