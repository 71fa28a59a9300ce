"""Licence scans with a generalised suffix automaton of licence tokens.

The automaton holds every licence template as a sequence of words. A text is streamed through it, which gives matching
statistics: for each word the longest run ending there that occurs in some template, and by suffix links the longest for each
place of each template. Runs that can't be extended and are long enough are chained, per template, in the order of text and template; a chain that covers enough of the template is
a found span. Templates are whole licences, their paragraphs, notices and tags (``license_texts``, ``TEMPLATES``).

A chain must cover 0.6 of a long template and 0.9 of a notice of fewer than a dozen words, and have a run that only one
licence has or that is too long for a stock phrase ("licensed under the"). Of spans that overlap, whatever their labels, the
one that covers most words, less half of those it lacks, stays: the same paragraph is in many licences.

Defined results: a null or empty text has no words, no labels and score 0; texts of any length are scanned whole; repeated rows
give repeated results; a null id stays null; an empty table gives an empty result; columns other than the two that are named
are ignored, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame

from .common import map_texts, text_rows
from .license_texts import templates as licenses

#: Phrases whose places are always reported, and their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Templates by label: short notices as authors write them, and openings of the licences themselves.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "licensed under the apache license 2 0"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("gpl-2.0", "licensed under the gnu general public license version 2"),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("lgpl", "under the terms of the gnu lesser general public license"),
    ("agpl-3.0", "licensed under the gnu affero general public license version 3"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "licensed under the bsd license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by-4.0", "licensed under cc by 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
]

#: bytes.translate table: A-Z to lower case, every other ASCII byte that is no digit or letter to a space.
_WORD_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Words of ``text`` in lower case (ASCII only): runs of digits, letters and non-ASCII characters."""
    return text.translate(_WORD_TABLE).split()


class SuffixAutomaton:
    """Generalised suffix automaton over sequences of integers (1 and up; 0 is a word that no template has)."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]  #: per state: (sequence, index of the last element)
        spots = []
        for k, seq in enumerate(sequences):
            last = 0
            for i, c in enumerate(seq):
                last = self._extend(last, c)
                spots.append((last, k, i))
        for state, k, i in spots:
            while state > 0:
                self.ends[state].append((k, i))
                state = self.link[state]

    def _new(self, length: int, like: int | None = None) -> int:
        self.next.append(dict(self.next[like]) if like is not None else {})
        self.link.append(self.link[like] if like is not None else 0)
        self.length.append(length)
        self.ends.append([])
        return len(self.length) - 1

    def _split(self, parent: int, child: int, c: int) -> int:
        """The state of ``parent``'s longest string plus ``c``, cut out of ``child`` if that has longer ones."""
        if self.length[child] == self.length[parent] + 1:
            return child
        copy = self._new(self.length[parent] + 1, child)
        self.link[child] = copy
        while parent >= 0 and self.next[parent].get(c) == child:
            self.next[parent][c] = copy
            parent = self.link[parent]
        return copy

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:  # an earlier sequence has this prefix
            return self._split(last, self.next[last][c], c)
        new, at = self._new(self.length[last] + 1), last
        while at >= 0 and c not in self.next[at]:
            self.next[at][c] = new
            at = self.link[at]
        self.link[new] = 0 if at < 0 else self._split(at, self.next[at][c], c)
        return new

    def step(self, state: int, matched: int, c: int) -> tuple[int, int]:
        while state and c not in self.next[state]:
            state = self.link[state]
            matched = self.length[state]
        if c in self.next[state]:
            return self.next[state][c], matched + 1
        return 0, 0


class LicenseScanner:
    """Built once per task from the templates, whose number is fixed."""

    def __init__(self, templates=None, phrases=None, min_match: int = 3, min_coverage: float = 0.6, max_gap: int = 12, short: int = 12, short_coverage: float = 0.9, long_run: int = 8):
        known: dict[tuple[bytes, ...], str] = {}
        for label, t in TEMPLATES + licenses() if templates is None else templates:
            known.setdefault(tuple(words_of(t.encode())), label)
        self.templates = [(label, list(t)) for t, label in known.items()]
        self.short, self.short_coverage, self.long_run = short, short_coverage, long_run
        self.phrases = [(label, words_of(p.encode())) for p, label in (BASE_PHRASES if phrases is None else phrases).items()]
        self.min_match, self.min_coverage, self.max_gap = min_match, min_coverage, max_gap
        self.ids: dict[bytes, int] = {}
        number = lambda ws: [self.ids.setdefault(w, len(self.ids) + 1) for w in ws]
        known = self.sequences = [number(t) for _, t in self.templates]
        self.broken: dict[tuple[int, int], list[tuple[int, int, int, bool]]] = {}
        base = [number(p) for _, p in self.phrases]
        self.automaton = SuffixAutomaton(known + base)
        self.base_at: dict[int, list[tuple[int, int]]] = {}  #: state -> (phrase, its words) that its strings end with, if as long
        full = {}
        for p, seq in enumerate(base):
            state = 0
            for c in seq:
                state = self.automaton.next[state][c]
            full.setdefault(state, []).append((p, len(seq)))
        for v in range(1, len(self.automaton.length)):
            at, found = v, []
            while at > 0:
                found += full.get(at, [])
                at = self.automaton.link[at]
            if found:
                self.base_at[v] = found
        size = len(self.ids) + 1
        self.pairs, self.base_pairs = np.zeros(size * size, bool), np.zeros(size * size, bool)
        for seq in known + base:
            for a, b in zip(seq, seq[1:]):
                self.pairs[a * size + b] = True
        for a, b in (seq for seq in base if len(seq) == 2):
            self.base_pairs[a * size + b] = True
        self.size = size
        labels = [{self.templates[k][0] for k, _ in ends if k < len(self.templates)} for ends in self.automaton.ends]
        self.own = [len(x) == 1 for x in labels]  #: per state: whether one licence alone has its strings
        if min_match < 3:
            raise ValueError("a match has three words at least")
        if min(map(len, base), default=2) < 2:
            raise ValueError("a phrase has two words at least")

    def scan(self, texts: list[bytes]) -> list[dict]:
        """Per text: n_words, base (phrase index, start) in order, spans (label, start, end, coverage)."""
        words, counts = [], []
        for t in texts:
            found = words_of(t)
            counts.append(len(found))
            words += found
            words.append(b" ")  # no template has it: matches end with the text
        out = [{"n_words": n, "base": [], "segments": []} for n in counts]
        starts = np.concatenate([[0], np.cumsum(np.array(counts, np.int64) + 1)])
        ids = np.fromiter(map(self.ids.get, words, repeat(0)), np.int64, len(words))
        # Matches of three words or more are runs of two pairs or more that some template has; a pair alone can only be a base phrase.
        pair = ids[:-1] * self.size + ids[1:]
        hit = np.concatenate([[False], self.pairs[pair], [False]])
        at = np.flatnonzero(hit[1:-1] & (hit[:-2] | hit[2:] | self.base_pairs[pair]))
        for run in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1) if len(at) else []:
            first, last = int(run[0]), int(run[-1]) + 1
            doc = int(np.searchsorted(starts, first, "right")) - 1
            self._walk(ids[first : last + 1].tolist(), first - int(starts[doc]), out[doc])
        for x in out:
            x["spans"] = self._chains(x.pop("segments"))
        return out

    def _walk(self, ids: list[int], offset: int, into: dict) -> None:
        state = matched = 0
        sa = self.automaton
        for i, c in enumerate(ids):
            if matched >= self.min_match:
                self._end(state, matched, c, offset + i, into)
            state, matched = sa.step(state, matched, c)
            for phrase, n in self.base_at.get(state, ()):
                if n <= matched:
                    into["base"].append((phrase, offset + i - n + 1))
        if matched >= self.min_match:
            self._end(state, matched, 0, offset + len(ids), into)

    def _end(self, state: int, matched: int, c: int, at: int, into: dict) -> None:
        """Adds the matches that end before word ``at`` of the text, whose number is ``c``: start in the text, start in the template, words, template, whether only one licence has them."""
        key = state, c
        if key not in self.broken:
            self.broken[key] = self._breaks(state, c)
        for k, end, n, own in self.broken[key]:
            n = n or matched
            into["segments"].append((at - n, end - n + 1, n, k, own))

    def _breaks(self, state: int, c: int) -> list[tuple[int, int, int, bool]]:
        """Places in templates where what is matched ends and doesn't go on with ``c``: template, last word, words (0: all that is matched), whether only one licence has them.

        The places of a state have all that is matched before them, those of its suffix links only as much as these hold.
        """
        out, seen, u, sa = [], set(), state, self.automaton
        while u > 0 and (u == state or sa.length[u] >= self.min_match):
            for place in sa.ends[u]:
                k, end = place
                if place not in seen and k < len(self.templates):
                    seen.add(place)
                    seq = self.sequences[k]
                    if end + 1 == len(seq) or seq[end + 1] != c:
                        out.append((k, end, 0 if u == state else sa.length[u], self.own[u]))
            u = sa.link[u]
        return out

    def least(self, size: int) -> float:
        """Words of a template of so many that a chain must cover."""
        return size * (self.short_coverage if size < self.short else self.min_coverage)

    def _chains(self, segments: list[tuple[int, int, int, int, bool]]) -> list[tuple[str, int, int, float]]:
        """All chains that cover enough of a template and have a run that tells; of those that overlap, the one with most words covered, less half of those it lacks."""
        by: dict[int, list[tuple[int, int, int, bool]]] = {}
        for start, t, n, k, own in segments:
            by.setdefault(k, []).append((start, t, n, own or n >= self.long_run or n == len(self.sequences[k])))
        found = []
        for k, parts in by.items():
            label, template = self.templates[k]
            if sum(x[2] for x in parts) < self.least(len(template)) or not any(x[3] for x in parts):
                continue
            todo = [sorted(parts)]
            while todo:
                some = todo.pop()
                taken = _apart([(cov, s, e) for cov, s, e, told in self.chained(some, len(template)) if told and cov >= self.least(len(template))], lambda x: (-x[0], x[1]))
                found.extend((label, s, e, min(1.0, cov / len(template)), cov - (len(template) - cov) / 2) for cov, s, e in taken)
                # What lies between the chains taken may hold others that began in one of them.
                cuts = [0, *(x for _, s, e in sorted(taken, key=lambda x: x[1]) for x in (s, e)), float("inf")]
                gaps = [[x for x in some if lo <= x[0] and x[0] + x[2] <= hi] for lo, hi in zip(cuts[::2], cuts[1::2])] if taken else []
                todo += [g for g in gaps if g]
        return sorted(x[:4] for x in _apart(found, lambda x: (-x[4], -x[3], x[1] - x[2], x[1], x[0])))

    def chained(self, parts: list[tuple[int, int, int, bool]], size: int) -> list[tuple[int, int, int, bool]]:
        """For each match (start in text, start in template, words, whether it tells), the best chain that ends with it: covered words, start and end in the text, whether one of its matches tells.

        Matches follow each other in text and template, at most ``max_gap`` words apart in both; words that two of them share count once.
        """
        chains: list[tuple[int, int, int, int, bool]] = []  # covered words, start, end in the text, end in the template, tells
        recent = 0
        for start, t, n, tells in parts:
            while recent < len(chains) and parts[recent][0] + parts[recent][2] + self.max_gap + size < start:
                recent += 1
            cov, first, told = n, start, tells
            for c, s, e, te, before in chains[recent:]:
                cut = max(0, e - start, te - t)
                if cut < n and start - e <= self.max_gap and t - te <= self.max_gap and s < start and (c + n - cut, before or tells) > (cov, told):
                    cov, first, told = c + n - cut, s, before or tells
            chains.append((cov, first, start + n, t + n, told))
        return [(c, s, e, told) for c, s, e, _, told in chains]


def _apart(spans: list[tuple], rank) -> list[tuple]:
    """Spans (start and end in the second and third place) in the order of ``rank`` that overlap none before them."""
    starts, ends, out = [], [], []
    for x in sorted(spans, key=rank):
        k = bisect_right(starts, x[1])
        if (not k or ends[k - 1] <= x[1]) and (k == len(starts) or x[2] <= starts[k]):
            starts.insert(k, x[1])
            ends.insert(k, x[2])
            out.append(x)
    return out


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, span_labels array<string>, span_starts array<long>, span_ends array<long>"


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row: counts and places of the base phrases, labels, the best coverage as score, and the covered spans (in words)."""
    import pyarrow as pa

    def scan(ids, texts, scanner):
        cols: dict[str, list] = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "span_labels", "span_starts", "span_ends")}
        for x in scanner.scan(texts):
            at = [s for _, s in x["base"]]
            base = {scanner.phrases[p][0] for p, _ in x["base"]}
            cols["n_words"].append(x["n_words"])
            cols["n_base"].append(len(at))
            cols["first_word"].append(min(at, default=None))
            cols["last_word"].append(max(at, default=None))
            cols["base_labels"].append(",".join(sorted(base)))
            cols["labels"].append(",".join(sorted(base | {s[0] for s in x["spans"]})))
            cols["score"].append(max([s[3] for s in x["spans"]] + [0.5 * bool(at)]))
            cols["span_labels"].append([s[0] for s in x["spans"]])
            cols["span_starts"].append([s[1] for s in x["spans"]])
            cols["span_ends"].append([s[2] for s in x["spans"]])
        for k in ("span_starts", "span_ends"):
            cols[k] = pa.array(cols[k], pa.list_(pa.int64()))
        cols["span_labels"] = pa.array(cols["span_labels"], pa.list_(pa.string()))
        return {"doc_id": ids, **cols}

    return map_texts(text_rows(df, id_col, text_col), scan, SCHEMA, lambda: LicenseScanner(**options))
