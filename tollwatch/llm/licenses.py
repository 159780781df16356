"""License scans: matching statistics against a suffix automaton of template tokens.

The texts of all templates go into one automaton. A text is streamed through
it: at each word the automaton knows the longest run of words that ends there
and stands in some template. Long runs are chained, template by template, into
spans that keep the template's order, and a template is reported if the chain
covers enough of it.
"""

import bisect
import functools

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F

from tollwatch.llm.words import ALNUM, LOWER, Texts, chunks, of_strings

# Phrases of the base scan and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Wordings of public licenses and notices, by label.
TEMPLATES = [
    ("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of"
     " this software and associated documentation files, to deal in the software without"
     " restriction, including without limitation the rights to use, copy, modify, merge, publish,"
     " distribute, sublicense, and/or sell copies of the software, and to permit persons to whom"
     " the software is furnished to do so, subject to the following conditions"),
    ("mit-notice", "Released under the MIT License"),
    ("mit-notice", "Licensed under the MIT License"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0-text", "you may not use this file except in compliance with the License. You may"
     " obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required"
     " by applicable law or agreed to in writing, software distributed under the License is"
     " distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express"
     " or implied"),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    ("gpl-text", "This program is free software: you can redistribute it and/or modify it under"
     " the terms of the GNU General Public License as published by the Free Software Foundation,"
     " either version 3 of the License, or (at your option) any later version"),
    ("bsd-text", "Redistribution and use in source and binary forms, with or without modification,"
     " are permitted provided that the following conditions are met"),
    ("isc-text", "Permission to use, copy, modify, and/or distribute this software for any purpose"
     " with or without fee is hereby granted, provided that the above copyright notice and this"
     " permission notice appear in all copies"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v."
     " 2.0"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("warranty", "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,"
     " INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR"
     " PURPOSE AND NONINFRINGEMENT"),
]


class Automaton:
    """Suffix automaton of several token sequences."""

    def __init__(self, sequences):
        self.next, self.link, self.length, self.ends = [{}], [-1], [0], [set()]
        for number, sequence in enumerate(sequences):
            last = 0
            for place, token in enumerate(sequence):
                last = self._extend(last, token)
                state = last
                while state > 0 and (number, place) not in self.ends[state]:
                    self.ends[state].add((number, place))
                    state = self.link[state]
        self._spread()

    def _state(self, length, link, following):
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(set())
        return len(self.next) - 1

    def _clone(self, p, q, token):
        new = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.ends[new] |= self.ends[q]
        self.link[q] = new
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = new
            p = self.link[p]
        return new

    def _extend(self, last, token):
        q = self.next[last].get(token)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, token)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][token]
            same = self.length[q] == self.length[p] + 1
            self.link[new] = q if same else self._clone(p, q, token)
        return new

    def _spread(self):
        """Every state also ends where the longer states that it is a suffix of end."""
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            if self.link[state] > 0:
                self.ends[self.link[state]] |= self.ends[state]

    def runs(self, tokens, least):
        """Maximal runs (end, length, state) of at least ``least`` tokens."""
        state, length, found = 0, 0, []
        for i, token in enumerate(tokens):
            before, grown = (length, state), True
            while state and token not in self.next[state]:
                state, grown = self.link[state], False
                length = self.length[state]
            if token in self.next[state]:
                state, length = self.next[state][token], length + 1
            else:
                length, grown = 0, False
            if not grown and before[0] >= least:
                found.append((i - 1, *before))
        if length >= least:
            found.append((len(tokens) - 1, length, state))
        return found


class Scanner:
    """Templates, phrases and the automaton over them."""

    def __init__(self, templates=TEMPLATES, phrases=PHRASES, least=5, gap=40):
        self.labels = [label for label, _ in templates]
        self.least, self.gap, self.phrases = least, gap, []
        for phrase, label in phrases.items():
            self.phrases.append((of_strings([phrase], word_bytes=ALNUM, fold=LOWER).words(), label))
        texts = of_strings([t for _, t in templates], word_bytes=ALNUM, fold=LOWER)
        hashes = texts.words()
        self.sizes = texts.counts
        self.known, ids = np.unique(hashes, return_inverse=True)
        n = len(self.known)
        inside = texts.doc[1:] == texts.doc[:-1] if len(hashes) else np.zeros(0, bool)
        self.pairs = np.unique((ids[:-1] * n + ids[1:])[inside])
        self.automaton = Automaton([ids[a:b].tolist()
                                    for a, b in zip(texts.first[:-1], texts.first[1:])])

    def places(self, texts, hashes):
        """Start word and phrase number of each base phrase."""
        starts, which = [], []
        for k, (phrase, _) in enumerate(self.phrases):
            at = texts.window_starts(len(phrase))
            for i, h in enumerate(phrase):
                at = at[hashes[at + i] == h]
            starts.append(at)
            which.append(np.full(len(at), k))
        return np.concatenate(starts), np.concatenate(which)

    def matches(self, texts, hashes):
        """For each text with one: the matched spans (word, length, state).

        A run of ``least`` words holds only pairs of words that stand together in
        some template; stretches without such pairs cannot match and are not streamed.
        """
        if len(hashes) < 2 or not len(self.known):
            return {}
        ids = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        known = self.known[ids] == hashes
        pair = ids[:-1] * len(self.known) + ids[1:]
        good = known[:-1] & known[1:] & (texts.doc[1:] == texts.doc[:-1]) & np.isin(pair, self.pairs)
        edges = np.flatnonzero(np.diff(np.concatenate([[False], good, [False]])))
        found = {}
        for low, high in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if high - low + 1 < self.least:
                continue
            doc = int(texts.doc[low])
            base = low - int(texts.first[doc])
            for end, length, state in self.automaton.runs(ids[low:high + 1].tolist(), self.least):
                found.setdefault(doc, []).append((base + end - length + 1, length, state))
        return found

    def chains(self, matches, covered):
        """Chains per template, best first: (label, covered share, first word, end word).

        The runs that the best chains use or overlap are left out and the rest is
        chained anew, as long as a chain reaches the share ``covered``. The best one
        of a template is listed in any case.
        """
        spans = {}
        for start, length, state in matches:
            for template, end in self.automaton.ends[state]:
                spans.setdefault(template, set()).add((start, end - length + 1, length))
        out = []
        for template, own in sorted(spans.items()):
            size = int(self.sizes[template])
            own, found = sorted(own), []
            while own:
                chains = self._best_chains(template, own)
                free = [c for c in chains if c[0] >= covered * size] or chains[:not found]
                found += [(self.labels[template], min(1.0, n / size), *at) for n, *at in free]
                if free[:1] and free[0][0] >= covered * size:
                    taken = Spans([[*c[1:]] for c in free])
                    own = [r for r in own if taken.free(r[0], r[0] + r[2])]
                else:
                    own = []
            out += sorted(found, key=lambda c: (-c[1], c[2]))
        return out

    def _best_chains(self, template, own):
        """Words, first word and end word of chains of sorted runs, best first, none over another."""
        best, open_from = [], 0
        for i, (start, place, length) in enumerate(own):
            while own[open_from][0] + max(self.sizes[template], own[open_from][2]) + self.gap < start:
                open_from += 1
            top = (length, start, start + length)
            for j in range(open_from, i):
                s, p, n = own[j]
                skip = max(0, s + n - start, p + n - place)
                if s < start and p < place and skip < length and start - (s + n) <= self.gap:
                    gain = best[j][0] + length - skip
                    top = max(top, (gain, best[j][1], start + length))
            best.append(top)
        taken = Spans([])
        return [b for b in sorted(best, key=lambda b: (-b[0], b[1])) if taken.take(*b[1:])]


class Spans:
    """Spans of words none of which lies over another."""

    def __init__(self, spans):
        self.spans = sorted(spans)

    def free(self, low, high):
        i = bisect.bisect_left(self.spans, [high]) if self.spans else 0
        return i == 0 or self.spans[i - 1][1] <= low

    def take(self, low, high):
        """Whether the span was free; then it is taken."""
        free = self.free(low, high)
        if free:
            bisect.insort(self.spans, [low, high])
        return free


@functools.lru_cache(4)
def scanner(templates, phrases, least, gap):
    return Scanner(list(templates), dict(phrases), least, gap)


SPANS = "array<struct<label:string,covered:double,first_word:long,end_word:long>>"
COLUMNS = ("n_words long, n_base long, first_word long, last_word long, base_labels string,"
           f" labels string, score double, spans {SPANS}")
SPAN = pa.list_(pa.struct([("label", pa.string()), ("covered", pa.float64()),
                           ("first_word", pa.int64()), ("end_word", pa.int64())]))


def scan_licenses(docs, templates=None, phrases=None, least=5, gap=40, covered=0.6,
                  doc_id="doc_id", text="text"):
    """Base phrases and covered license templates of each row's whole text.

    ``spans`` has, for every place where a chain of runs of at least ``least``
    words covers the share ``covered`` of a template, the label, that share and the
    words from ``first_word`` to before ``end_word``; ``labels`` joins their
    labels with those of the base phrases, ``score`` is the best share over all
    templates. A null or empty text has no words, no labels and score 0. Rows
    keep their place even if ids repeat or are null.
    """
    setup = (tuple(templates or TEMPLATES), tuple((phrases or PHRASES).items()), least, gap)
    kind = dict(docs.dtypes)[doc_id]

    def run(batches):
        scan = scanner(*setup)
        for batch, data, at in chunks(batches, 1):
            texts = Texts(data, at, ALNUM, LOWER)
            hashes = texts.words()
            places, which = scan.places(texts, hashes)
            doc = texts.doc[places] if len(places) else places
            within = places - texts.first[doc] if len(places) else places
            n_base = np.bincount(doc, minlength=len(texts)) if len(places) else np.zeros(
                len(texts), int)
            first = np.full(len(texts), np.iinfo(np.int64).max)
            last = np.full(len(texts), -1)
            np.minimum.at(first, doc, within)
            np.maximum.at(last, doc, within)
            base = [set() for _ in range(len(texts))]
            for d, k in zip(doc.tolist(), which.tolist(), strict=True):
                base[d].add(scan.phrases[k][1])
            spans, score = [[] for _ in base], np.zeros(len(texts))
            for d, found in scan.matches(texts, hashes).items():
                chained = scan.chains(found, covered)
                score[d] = max(c[1] for c in chained)
                spans[d] = [dict(zip(("label", "covered", "first_word", "end_word"), c, strict=True))
                            for c in chained if c[1] >= covered]
            none = n_base == 0
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(texts.counts), pa.array(n_base),
                pa.array(first, mask=none), pa.array(last, mask=none),
                pa.array([",".join(sorted(b)) for b in base], pa.string()),
                pa.array([",".join(sorted(b | {s["label"] for s in own}))
                          for b, own in zip(base, spans, strict=True)], pa.string()),
                pa.array(score), pa.array(spans, SPAN),
            ], names=[doc_id, "n_words", "n_base", "first_word", "last_word", "base_labels",
                      "labels", "score", "spans"])

    return docs.select(doc_id, F.coalesce(F.col(text), F.lit("")).alias("__text")).mapInArrow(
        run, f"`{doc_id}` {kind}, {COLUMNS}")
