"""Licence scans with a generalised suffix automaton of licence tokens.

Files stream through the automaton of the templates' tokens. The matching statistics give, for each word, the longest
factor of any template that ends there, and suffix links lead to the shorter ones of other templates and places. Runs of
``LEAST_MATCH`` words or more that end where their template goes on otherwise are chained in file and template order, by
the chain that covers most, into the spans of a template that a file covers. A template whose chained words reach
``COVERAGE`` of its length gives its label. A second automaton of whole phrases gives the base places.

Scale: narrow, one pass, no shuffle; the automata are fixed and small, so they travel in the task closure.

Null, empty and word-less texts have no places, no labels and score 0. Repeated rows are judged one by one. Of equally
good chains that overlap the first one stays. Very long texts are read as a whole, a chain looks back ``MOST_GAP`` words
before its run. Extra columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame

from .automaton import SuffixAutomaton
from .spark_util import map_texts, words

#: The base phrases and their labels.
PHRASES = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]
#: Licence notices and the openings of licence texts, with the method's labels.
TEMPLATES = [
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "apache-2.0"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", "mit"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", "gpl-2.0+"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "gpl-3.0+"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("this work is licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa-4.0"),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc-4.0"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version", "lgpl-2.1+"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", "agpl-3.0+"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "isc"),
    ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "bsd-3-clause"),
    ("this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", "unlicense"),
    ("to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "cc0-1.0"),
    ("boost software license version 1 0 august 17th 2003 permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "bsl-1.0"),
    ("all rights reserved", "all-rights-reserved"),
]
LEAST_MATCH = 3
COVERAGE = 0.75
#: Words of file or template that may lie between two chained matches.
MOST_GAP = 8


class Licences:
    """Both automata, and where each state's factor ends in which template."""

    def __init__(self, phrases: list[tuple[str, str]] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES) -> None:
        self.labels = [label for _, label in templates]
        self.base_labels = [label for _, label in phrases]
        self.phrases, self.templates = SuffixAutomaton(), SuffixAutomaton()
        for text, _ in phrases:
            self.phrases.add(words(text.encode()))
        for text, _ in templates:
            self.templates.add(words(text.encode()))
        self.least = min(map(len, self.phrases.sequences))
        #: By the state of a whole phrase: its length and number.
        self.whole: dict[int, list[tuple[int, int]]] = {}
        for k, sequence in enumerate(self.phrases.sequences):
            *_, state = self.phrases.walk(sequence)
            self.whole.setdefault(state, []).append((len(sequence), k))
        #: By state: (template, end) of every occurrence of its factors.
        t = self.templates
        self.ends: list[set[tuple[int, int]]] = [set() for _ in t.next]
        for k, sequence in enumerate(t.sequences):
            for end, state in enumerate(t.walk(sequence), 1):
                self.ends[state].add((k, end))
        for state in reversed(t.top_down()):
            if t.link[state] > 0:
                self.ends[t.link[state]] |= self.ends[state]

    def places(self, text: list[bytes]) -> list[tuple[int, int]]:
        """(start word, phrase) of every place where a phrase's words stand consecutively."""
        a, found = self.phrases, []
        for i, state, length in a.matches(a.encode(text), self.least):
            while state > 0:
                found += [(i + 1 - n, k) for n, k in self.whole.get(state, ()) if n <= length]
                state = a.link[state]
                length = a.length[state]
        return found

    def found(self, text: list[bytes]) -> dict[int, list[tuple[int, int, int, int]]]:
        """By template: (start and end in the file, start and end in the template) of all longest common runs of
        ``LEAST_MATCH`` words or more, in the order of their ends. A run ends where this template goes on otherwise."""
        a, out = self.templates, {}
        ids = a.encode(text)
        for i, state, length in a.matches(ids, LEAST_MATCH):
            after, seen = int(ids[i + 1]) if i + 1 < len(ids) else -1, set()
            while length >= LEAST_MATCH:  # shorter runs are those of other places and templates
                for k, end in self.ends[state] - seen:
                    if end == len(a.sequences[k]) or a.sequences[k][end] != after:
                        out.setdefault(k, []).append((i + 1 - length, i + 1, end - length, end))
                seen |= self.ends[state]
                state = a.link[state]
                length = a.length[state]
        return out

    def spans(self, text: list[bytes]) -> list[tuple[int, int, int, float]]:
        """(first word, end, template, covered share) of the chains that reach ``COVERAGE``; those of one template don't overlap."""
        out = []
        for k, runs in self.found(text).items():
            total, starts, ends = len(self.templates.sequences[k]), [], []  # of the chains that are taken, in order
            good = [c for c in chained(runs) if c[0] >= COVERAGE * total]
            for covered, start, end in sorted(good, key=lambda c: (-c[0], c[1], c[2])):
                at = bisect_left(starts, end)  # those before it begin before this one ends
                if at == 0 or ends[at - 1] <= start:
                    starts.insert(at, start)
                    ends.insert(at, end)
                    out.append((start, end, k, covered / total))
        return sorted(out)


def chained(runs: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int]]:
    """For each run the chain that ends with it and covers most: (covered words of the template, start and end in the file).

    A run goes on from one that ends before it in both, ``MOST_GAP`` words away at most. Runs that overlap count the new
    words only. runs: in the order of their ends in the file.
    """
    best: list[tuple[int, int, int]] = []
    ends = [r[1] for r in runs]
    for start, end, begin, stop in runs:
        covered, first = end - start, start
        for m in range(bisect_left(ends, start - MOST_GAP), bisect_left(ends, end)):
            _, end_m, _, stop_m = runs[m]
            if stop_m < stop and begin - stop_m <= MOST_GAP and runs[m][0] <= start and runs[m][2] <= begin:
                more = best[m][0] + min(end - start, end - end_m, stop - stop_m)
                if (more, -best[m][1]) > (covered, -first):
                    covered, first = more, best[m][1]
        best.append((covered, first, end))
    return best


def scan(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    ``spans`` lists what the method found: words from ``start`` to before ``end``, the label, and the covered share.
    ``score`` is the largest covered share, and 1 where a base phrase stands.
    """

    def factory():
        licences = Licences()

        def kernel(text):
            found = words(text)
            places, spans = licences.places(found), licences.spans(found)
            starts = [s for s, _ in places]
            base = {licences.base_labels[k] for _, k in places}
            own = {licences.labels[k] for _, _, k, _ in spans}
            score = 1.0 if base else min(1.0, max((x[3] for x in spans), default=0.0))
            listed = [{"start": a, "end": b, "label": licences.labels[k], "covered": min(1.0, c)} for a, b, k, c in spans]
            return len(found), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | own)), score, listed

        return kernel

    schema = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans array<struct<start: bigint, end: bigint, label: string, covered: double>>"
    return map_texts(docs, schema, factory)
