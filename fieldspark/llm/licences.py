"""License scans: winnowed fingerprints find candidates, banded alignment reports coverage and spans.

Of each template and text, hashes of GRAM consecutive words are winnowed: the smallest of every
WINDOW ones is kept, so a shared run of GRAM + WINDOW - 1 words always shares a fingerprint.  An
inverted index from fingerprint to (template, place) gives hits (of templates of up to SHORT words also by every run of
NEAR words, so that any two neighbouring words of a notice are enough to try it).  These hits come with their diagonal, the place in the
text less the place in the template.  Hits of a short template on near diagonals and places are one
candidate.  Those of a long one are chained, so that they rise in both texts, and cut where more words
than a passage put in may have lie between; pieces with enough anchors are candidates.  A candidate is
aligned with its template inside a band around its anchors' diagonals, which widens to the gap between
two anchors; the alignment's matched words give the covered share of the template and the span of the
text, an inserted passage included.  Of matches that overlap the one with the most words is reported.

The index holds templates alone, whose number and length the caller gives, and goes to the tasks
after a check of its size.  Defined cases: null, empty and wordless texts have no matches; a template
without words is left out, one of fewer than GRAM words is one gram of its own; equal rows give equal
matches; extra columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.llm import arrays as A
from fieldspark.llm.common import arrow_type, narrow, sql_type, tidy

GRAM = 3
WINDOW = 3
#: Templates of so many words are found by all runs of NEAR words too.
SHORT, NEAR = 40, 2
#: Diagonals on either side of a candidate's that the alignment may use.
BAND = 6
#: Words that may be put into a long template in one place, and the share of its words that must be anchors of a piece.
PASSAGE, ANCHORS = 200, 0.02
#: Anchors in a row on near diagonals that bend the band, at least (and the share ANCHORS of a piece).
STEADY = 3
#: Least share of a template's words that a match covers.
COVERAGE = 0.7
TEMPLATE_WORDS = 2_000_000

#: Notices by which works state their licence, and the whole texts of licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
                         "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "MIT": "Released under the MIT License",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
                 "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
                 "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
                      "the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "BSD-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "all-rights": "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means",
    "all-rights-bare": "All rights reserved",
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by "
                       "the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "LGPL-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
                   "the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    "BSD-disclaimer": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
                      "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED",
    **{f"{p.stem}-text": p.read_text("utf-8") for p in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))},
}


def winnow(grams: np.ndarray) -> np.ndarray:
    """Places of the kept grams: the rightmost smallest of each window of WINDOW, of all if there are fewer."""
    if len(grams) <= WINDOW:
        return np.array([len(grams) - 1 - int(np.argmin(grams[::-1]))]) if len(grams) else np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(grams, WINDOW)[:, ::-1]
    return np.unique(np.arange(len(views)) + WINDOW - 1 - views.argmin(1))


def _grams(w: A.Words) -> tuple[np.ndarray, np.ndarray]:
    return A.windows(w, GRAM, short=True)


class Index:
    """Inverted index of the templates' fingerprints, runs of ``gram`` words; of those of up to ``most`` words."""

    def __init__(self, templates: dict[str, str], gram: int = GRAM, most: int = TEMPLATE_WORDS):
        self.names = list(templates)
        if sum(len(t) for t in templates.values()) > 12 * TEMPLATE_WORDS:
            raise ValueError("templates are too long for one index: scan with parts of them")
        column = pa.array(list(templates.values()), pa.string())
        self.words: list[np.ndarray] = []
        keys, owners, places = [], [], []
        for i, j, data, offs in A.text_slices(column):
            w = A.words_of(data, offs, A.ALNUM, lower=True)
            at, h = A.windows(w, gram, short=True)
            for d in range(j - i):
                self.words.append(w.hash[w.first[d]:w.first[d] + w.count[d]])
                mine = (w.doc[at] == d) & (w.count[d] <= most)
                # every gram of a template is in the index, so that a text's winnowed grams always meet it
                keys.append(h[mine])
                owners.append(np.full(mine.sum(), i + d))
                places.append(at[mine] - w.first[d])
        self.key, self.owner, self.place = np.concatenate(keys), np.concatenate(owners), np.concatenate(places)
        order = np.argsort(self.key, kind="stable")
        self.key, self.owner, self.place = self.key[order], self.owner[order], self.place[order]


def _known(index: Index, h: np.ndarray) -> np.ndarray:
    if not len(index.key):
        return np.zeros(len(h), bool)
    return index.key[np.minimum(np.searchsorted(index.key, h), len(index.key) - 1)] == h


def within_reach(text: np.ndarray, template: np.ndarray, lo: int, hi: int, least: float) -> bool:
    """Whether the words that the band reaches can match so many of the template's; a bound, so no match is lost."""
    reach = text[max(0, lo):max(0, hi)]
    return len(reach) >= least and np.isin(template, reach).sum() >= least


def band(n: int, places: np.ndarray, diagonals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word of a template of n words, the text words that may match it: BAND around the anchors' diagonals.

    Anchors rise in both texts; between two of them the band holds both diagonals, so that it widens to a gap.
    """
    after = np.searchsorted(places, np.arange(n))
    before, after = np.clip(after - 1, 0, None), np.clip(after, None, len(places) - 1)
    d, e = diagonals[before], diagonals[after]
    lo, hi = np.arange(n) + np.minimum(d, e) - BAND, np.arange(n) + np.maximum(d, e) + BAND + 1
    return np.minimum.accumulate(lo[::-1])[::-1], np.maximum.accumulate(hi)


#: A match weighs more than any place in a text.
MATCH = 1 << 32


def align(text: np.ndarray, template: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[int, int, int]:
    """(matched words, first, behind last word of the text) of the best common subsequence in the band.

    Row by row of the template; a cell holds matches and, among equally many, the last first word.  Among
    alignments with equally many matches the one with the shortest span of the text counts.
    """
    start, end = max(0, int(lo[0])), min(len(text), int(hi[-1]))
    if start >= end:
        return 0, 0, 0
    words, best, reached = text[start:end], np.zeros(end - start + 1, dtype=np.int64), 0
    for word, a, b in zip(template.tolist(), np.clip(lo - start, 0, end - start).tolist(), np.clip(hi - start, 0, end - start).tolist()):
        if b > reached:
            best[reached + 1:b + 1] = best[reached]
            reached = b
        if a >= b:
            continue
        same = np.flatnonzero(words[a:b] == word)
        if len(same):
            before = best[a + same]
            row = best[a + 1:b + 1].copy()
            row[same] = np.maximum(row[same], np.where(before > 0, before + MATCH, MATCH + a + same))
            best[a + 1:b + 1] = np.maximum.accumulate(row)
            np.maximum(best[b + 1:reached + 1], best[b], out=best[b + 1:reached + 1])
    n = int(best[reached] // MATCH)
    if not n:
        return 0, 0, 0
    ends = np.flatnonzero(best[:reached + 1] // MATCH == n)
    first = best[ends] % MATCH
    k = int(np.argmin(ends - first))
    return n, start + int(first[k]), start + int(ends[k])


def chain(at: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Hits (numbers) of a longest chain that rises in the text and in the template."""
    order = np.lexsort((-place, at))
    tails, last, back = [], [], np.full(len(at), -1)
    for k in order.tolist():
        q = int(place[k])
        i = bisect_left(tails, q)
        back[k] = last[i - 1] if i else -1
        tails[i:i + 1], last[i:i + 1] = [q], [k]
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(k)
        k = int(back[k])
    return np.array(out[::-1], dtype=np.int64)


def long_matches(text: np.ndarray, template: np.ndarray, at: np.ndarray, place: np.ndarray, coverage: float) -> list[tuple[int, int, int]]:
    """(matched words, first, behind last) of a long template, from its hits by chains of anchors.

    A chain is cut where more words lie between two anchors than a passage put in may have; a piece with too few
    anchors is not aligned.  The band goes on to both ends of the template, so that a piece finds all of its match.
    """
    n, out = len(template), []
    passage, least = min(PASSAGE, max(BAND, n // 2)), ANCHORS * n
    while len(at) >= least:
        anchors = chain(at, place)
        if len(anchors) < least:
            break
        p, q = at[anchors], place[anchors]
        used = np.zeros(len(at), dtype=bool)
        for piece in np.split(np.arange(len(p)), np.flatnonzero(np.diff(p) - np.diff(q) > passage) + 1):
            done = np.zeros(len(at), dtype=bool)
            done[anchors[piece]] = True  # unless a match is found: then what lies outside it stays for another one
            if len(piece) < least:
                used |= done
                continue
            runs = np.split(piece, np.flatnonzero(np.abs(np.diff((p - q)[piece])) > BAND // 2) + 1)
            piece = np.concatenate([r for r in runs if len(r) >= max(STEADY, ANCHORS * len(piece))] or [piece])  # chance hits stand alone on their diagonals
            lo, hi = band(n, q[piece], (p - q)[piece])
            if within_reach(text, template, int(lo[0]), int(hi[-1]), coverage * n):
                m, a, b = align(text, template, lo, hi)
                if m and m >= coverage * n:
                    out.append((m, a, b))
                    within = (at >= a) & (at < b)
                    done = within if within.any() else done
            used |= done
        at, place = at[~used], place[~used]
    return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """One row per document and match: template, matched and all words of it, coverage, span of words and its text."""
    docs = narrow(docs, doc_id=id_col, text=text_col)
    index, near = Index(templates or TEMPLATES), Index(templates or TEMPLATES, NEAR, SHORT)
    size = np.array([len(w) for w in index.words], dtype=np.int64)
    schema = pa.schema([("doc_id", arrow_type(docs, "doc_id")), ("template", pa.string()), ("n_matched", pa.int64()), ("n_template", pa.int64()),
                        ("coverage", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("matched_text", pa.string())])

    def hits(index: Index, h: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rows of (template, place in the text, diagonal) of fingerprints."""
        lo, hi = np.searchsorted(index.key, h, "left"), np.searchsorted(index.key, h, "right")
        n = hi - lo
        hit = np.repeat(lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        place = np.repeat(at, n)
        return np.stack([index.owner[hit], place, place - index.place[hit]], axis=1).astype(np.int64)

    def candidates(rows: np.ndarray):
        """(template, diagonal, place in the text) of hits of short templates, together where they belong to one candidate."""
        out: list[list[int]] = []
        for t, p, d in sorted(set(map(tuple, rows.tolist()))):
            if out and out[-1][0] == t and abs(out[-1][1] - d) <= BAND // 2 and p - out[-1][2] <= len(index.words[t]) + BAND:
                out[-1][2] = p
            else:
                out.append([t, d, p])
        return out

    def run(batches):
        for batch in batches:
            rows = []
            for i, j, data, offs in A.text_slices(batch.column(1)):
                w = A.words_of(data, offs, A.ALNUM, lower=True)
                at, h = _grams(w)
                doc = w.doc[at]
                at2, h2 = A.windows(w, NEAR, short=True)
                known2 = np.flatnonzero(_known(near, h2))
                at2, h2, doc2 = at2[known2], h2[known2], w.doc[at2[known2]]
                for d in np.unique(np.r_[doc[_known(index, h)], doc2]).tolist():
                    first, n = int(w.first[d]), int(w.count[d])
                    text = w.hash[first:first + n]
                    if n < GRAM:
                        grams, places = h[doc == d], np.zeros(1, np.int64)
                    else:
                        places = np.arange(n - GRAM + 1)
                        grams = A.window_hash(text, places, GRAM)
                        kept = winnow(grams)
                        grams, places = grams[kept], places[kept]
                    found: dict[tuple, tuple] = {}
                    wide = hits(index, grams, places)
                    mine, long = doc2 == d, size[wide[:, 0]] > SHORT
                    for t, diagonal, _ in candidates(np.concatenate([wide[~long], hits(near, h2[mine], at2[mine] - first)])):
                        lo, hi = band(size[t], np.zeros(1, np.int64), np.array([diagonal]))
                        if within_reach(text, index.words[t], int(lo[0]), int(hi[-1]), coverage * size[t]):
                            m, a, b = align(text, index.words[t], lo, hi)
                            if m and m >= coverage * size[t]:
                                found[(t, a, b)] = (m, diagonal)
                    wide = wide[long]
                    for t in np.unique(wide[:, 0]).tolist():
                        own = wide[wide[:, 0] == t]
                        for m, a, b in long_matches(text, index.words[t], own[:, 1], own[:, 1] - own[:, 2], coverage):
                            found[(t, a, b)] = (m, 0)
                    taken: list[tuple[int, int]] = []  # of matches of the same words the one with the most of them counts
                    ranked = sorted(found.items(), key=lambda x: (-x[1][0], -x[1][0] / len(index.words[x[0][0]]), x[0]))
                    for (t, a, b), (m, _) in ranked:
                        if any(a < y and x < b for x, y in taken):
                            continue
                        taken.append((a, b))
                        s, e = int(w.start[first + a]), int(w.end[first + b - 1])
                        rows.append((i + d, index.names[t], m, len(index.words[t]), m / len(index.words[t]), a, b,
                                     np.asarray(data)[s - d:e - d].tobytes().decode("utf-8", "replace")))
            if rows:
                picked = pa.array([r[0] for r in rows])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(picked), *[pa.array([r[k] for r in rows], schema.field(k).type) for k in range(1, 8)]], schema=schema)

    return docs.mapInArrow(tidy(run), f"doc_id {sql_type(docs, 'doc_id')}, template string, n_matched long, n_template long, coverage double, "
                                "first_word long, last_word long, matched_text string")


def digest(matches: DataFrame) -> DataFrame:
    return matches.select("doc_id", "template", "n_matched", "n_template", F.round("coverage", 6).alias("coverage"), "first_word", "last_word", "matched_text")
