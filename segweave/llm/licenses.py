"""License scans: exact phrases, then an exact set-similarity join of text blocks with license templates.

The join asks for containment: a block matches a template if it holds at least threshold of the template's distinct
words. Blocks are lines and, across line ends, all windows of twice the template's words; paragraphs of any length would
hold a short template's words by chance. The whole text passes the filters first, since it holds all its blocks. Words
are ordered by their frequency over the whole corpus, rarest first. With o = ceil(threshold * n) words
needed of a template's n, a matching block must hold one of the template's n - o + 1 rarest words (prefix filter), have
at least o distinct words (length filter), and from the places of a first common word on both sides still have o words to
come (positional filter); survivors are verified. A short template's telling words (its license's name or number) must be
there, as four fifths of its words would hold without them; and of templates of different licenses that share most of
their words, as the members of a family do, only the best counts where both match one place. Templates are a bounded parameter, so the index over their prefixes is a
small constant of each task; the corpus side is read twice, once to count words and once to join, and never shuffled.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import bound_batches, tidy

#: (phrase, label) whose consecutive words are looked for everywhere.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

#: (label, text, telling words) of the templates; short license statements and the first sentences of common licenses.
TEMPLATES = [
    ("gpl-3", "licensed under the gnu general public license version 3", "gnu 3"),
    ("gpl-2", "licensed under the gnu general public license version 2", "gnu 2"),
    ("lgpl-3", "licensed under the gnu lesser general public license version 3", "lesser 3"),
    ("agpl-3", "licensed under the gnu affero general public license version 3", "affero 3"),
    ("gpl-3", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "3"),
    ("mit", "released under the mit license", "mit"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ""),
    ("apache-2", "licensed under the apache license version 2 0", "apache 2"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at apache org licenses license 2 0", "apache"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ""),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ""),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc nc"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", "noncommercial"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", "sharealike"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", "attribution"),
    ("cc0", "dedicated to the public domain under the creative commons cc0 1 0 universal license", "cc0"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered"),
]

#: FAMILY: the share of a template's words that another license's must hold to be of its family.
THRESHOLD, WINDOW, FAMILY = 0.8, 2, 0.6

#: Of each byte: A-Z to a-z, line feeds as they are, other separators to a space; digits, a-z and all of UTF-8 past ASCII stay.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 or b == 10 else 32 for b in range(256))


def plain(text: str | None) -> bytes:
    """The text's words parted by spaces, and line feeds where they were."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_BYTES)


def required(n: int, threshold: float) -> int:
    """Words of a template's n that a match needs."""
    return max(1, math.ceil(threshold * n - 1e-9))


class TemplateIndex:
    """The templates' words in global order and an inverted index over their prefixes."""

    def __init__(self, templates: list[tuple[str, str, str]], frequency: dict[bytes, int], threshold: float):
        self.threshold = threshold
        sets = [(label, set(plain(text).split())) for label, text, _ in templates]
        self.rank = {w: i for i, w in enumerate(sorted(set().union(*(s for _, s in sets)), key=lambda w: (frequency.get(w, 0), w)))}
        self.templates = [(label, sorted(self.rank[w] for w in s)) for label, s in sets if s]
        #: Words of each template's windows: it is found if no more words than it has stand between its own.
        self.windows = [WINDOW * n for n in (len(plain(text).split()) for _, text, _ in templates) if n]
        #: Words that a match must hold, and other licenses' templates of the same family.
        self.telling = [{self.rank[w] for w in plain(must).split()} for _, text, must in templates if plain(text).split()]
        self.family = family(templates)
        self.prefixes: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, (_, ranks) in enumerate(self.templates):
            for at in range(len(ranks) - required(len(ranks), threshold) + 1):
                self.prefixes[ranks[at]].append((t, at))
        words = {r: w for w, r in self.rank.items()}
        self.prefix_words = {words[r] for r in self.prefixes}

    def match(self, words: set[bytes]) -> dict[int, float]:
        """Containment by template of each template that the block's words match."""
        # Words of no template can't add to an overlap; the block's template words in global order are its record.
        record = sorted(r for r in map(self.rank.get, words) if r is not None)
        seen: dict[int, int] = {}
        for place, r in enumerate(record):
            for t, at in self.prefixes.get(r, ()):
                n = len(self.templates[t][1])
                need = required(n, self.threshold)
                if t in seen or len(words) < need:  # length filter
                    continue
                seen[t] = -1 if 1 + min(n - at - 1, len(record) - place - 1) < need else at  # positional filter
        held = set(record)
        out = {}
        for t, at in seen.items():
            if at >= 0:
                ranks = self.templates[t][1]
                common = sum(r in held for r in ranks)
                if common >= required(len(ranks), self.threshold) and self.telling[t] <= held:
                    out[t] = common / len(ranks)
        return out

    def best(self, matches: list[tuple[int, int, int, float]]) -> list[tuple[int, float]]:
        """(template, containment) of matches(template, first word, last word, containment) that none of the family beats at their place."""
        strength = lambda t, c: (c, len(self.templates[t][1]))
        beaten = lambda t, a, b, c: any(u in self.family[t] and a <= b1 and a1 <= b and strength(u, c1) > strength(t, c) for u, a1, b1, c1 in matches)
        return [(t, c) for t, a, b, c in matches if not beaten(t, a, b, c)]

    def best_window(self, words: list[bytes], t: int) -> tuple[int, int, float] | None:
        """First word, last word and containment of the window of the words that holds most of template t, None if none matches."""
        wanted, length = set(self.templates[t][1]), self.windows[t]
        held: deque[tuple[int, int]] = deque()
        counts: Counter = Counter()
        most, found = 0, None
        for at, word in enumerate(words):
            r = self.rank.get(word)
            if r not in wanted:
                continue
            held.append((at, r))
            counts[r] += 1
            while held[0][0] <= at - length:
                _, gone = held.popleft()
                counts[gone] -= 1
                if not counts[gone]:
                    del counts[gone]
            if len(counts) > most and len(counts) >= required(len(wanted), self.threshold) and self.telling[t] <= counts.keys():
                most, found = len(counts), (held[0][0], at, len(counts) / len(wanted))
        return found


def family(templates: list[tuple[str, str, str]]) -> list[set[int]]:
    """For each template the numbers of other licenses' templates that hold FAMILY of its words."""
    sets = [(label, set(plain(text).split())) for label, text, _ in templates if plain(text).split()]
    return [{k for k, (other, more) in enumerate(sets) if other != label and len(words & more) >= FAMILY * len(words)} for label, words in sets]


def word_frequencies(docs: DataFrame, templates: list[tuple[str, str, str]]) -> dict[bytes, int]:
    """Occurrences over all texts of the templates' words; one row for each such word reaches the driver."""
    vocabulary = set().union(*(plain(t).split() for _, t, _ in templates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                counts.update(filter(vocabulary.__contains__, plain(text.as_py()).split()))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    rows = docs.select("text").mapInArrow(tidy(run), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(r.word): r.n for r in rows}


def phrase_places(words: bytes, phrase: bytes) -> Iterator[int]:
    """Word numbers at which the phrase starts; words and phrase have a space around every word."""
    at = words.find(phrase)
    while at >= 0:
        yield words.count(b" ", 0, at)
        at = words.find(phrase, at + 1)


def scan_text(text: str | None, phrases: list[tuple[bytes, str]], index: TemplateIndex) -> tuple:
    lines = plain(text)
    words = lines.split()
    n = len(words)
    places: list[int] = []
    base: set[str] = set()
    found: set[str] = set()
    score = 0.0
    if not index.prefix_words.isdisjoint(words) and (known := index.match(set(words))):
        matches, at = [], 0
        for line in lines.split(b"\n"):
            in_line = line.split()
            matches += [(t, at, at + len(in_line) - 1, c) for t, c in index.match(set(in_line)).items()]
            at += len(in_line)
        matches += [(t, *w) for t in known if (w := index.best_window(words, t))]
        for t, containment in index.best(matches):
            found.add(index.templates[t][0])
            score = max(score, containment)
    joined = b" " + b" ".join(words) + b" "
    for phrase, label in phrases:
        if phrase in joined:
            starts = list(phrase_places(joined, phrase))
            places += starts
            base.add(label)
    if base:
        score = 1.0
    return n, len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | found)), score


def scan_licenses(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row of docs(doc_id, text).

    Null text is empty: no words, no labels, score 0. Null ids and repeated rows come out as they came in; other columns
    are not read. The score is 1 where a phrase stands, else the highest containment of a matched template, else 0.
    """
    bound_batches(docs.sparkSession)
    index = TemplateIndex(templates, word_frequencies(docs, templates), threshold)
    known = [(b" " + b" ".join(plain(p).split()) + b" ", label) for p, label in phrases]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan_text(x.as_py(), known, index) for x in batch.column("text")]
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", *names])

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.select("doc_id", "text").mapInArrow(tidy(run), schema)
