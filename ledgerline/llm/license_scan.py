"""License scan: fixed phrases, and an exact set-similarity join of text blocks with license templates.

A text block is a line, or a window of words, which a wrap can't break: for a template of l words (repeated ones count) any
ceil(l / threshold) words in a row, so that a few words between, as of comment signs, do no harm. A block meets a template if
it holds at least `threshold` of the template's distinct words. Both
sides are sets of template words in one order: by how many documents have them, rarest first (one pass over the corpus);
other words can't meet anything. For a template of n words, need = ceil(threshold * n), and a block of m such words:
length: m >= need, else no word is looked at;
prefix: a common word must be among the template's n - need + 1 and the block's m - need + 1 rarest;
position: the first common word, at places i and j, leaves at most min(n - i, m - j) common ones, which must be >= need.
What passes is verified on whole sets, so no block is lost. A document's words go through the filters first, as a block has
no more of them; only for the templates that all its words meet are its lines and windows looked at. The templates, and so the table of word counts, are
parameters of at most WORDS_MAX distinct words; they alone go to the driver and the executors.

Words are runs of digits, a to z and non-ASCII characters after lower-casing A to Z. A null text is an empty one: no
words, no labels, score 0. Repeated rows are kept; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import texts

WORDS_MAX = 50_000
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Phrases and their labels (fixed values).
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Templates and their labels (fixed values: the usual notices of these licenses).
TEMPLATES = {
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl-notice",
    "licensed under the apache license version 2 0": "apache-2.0",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "apache-2.0-notice",
    "released under the mit license": "mit-notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "mit-text",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4.0",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
}


def words_of(text: str) -> list[str]:
    return WORD.findall(text.encode().lower().decode())  # of bytes, lower() changes A to Z alone


def word_counts(docs: DataFrame, vocabulary: set[str]) -> dict[str, int]:
    """In how many documents each word of the vocabulary stands; one sum per task and word is shuffled."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column("text"):
                total.update(vocabulary.intersection(words_of(text.as_py())))
        yield pa.RecordBatch.from_pydict({"word": list(total), "n": list(total.values())}, pa.schema([("word", pa.string()), ("n", pa.int64())]))

    rows = texts(docs).select("text").mapInArrow(work, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r["word"]: r["n"] for r in rows.collect()}  # at most WORDS_MAX rows


class TemplateJoin:
    """The templates' side of the join."""

    def __init__(self, templates: dict[str, str], counts: dict[str, int], threshold: float):
        sets = [set(words_of(text)) for text in templates]
        #: Template words by their place in the global order, rarest first.
        self.place = {w: i for i, w in enumerate(sorted(set().union(*sets), key=lambda w: (counts.get(w, 0), w)))}
        self.sets = [frozenset(self.place[w] for w in words) for words in sets]
        self.needs = [math.ceil(threshold * len(words) - 1e-9) for words in sets]
        self.labels = list(templates.values())
        #: Words of a template's window.
        self.spans = [math.ceil(len(words_of(text)) / threshold - 1e-9) for text in templates]
        self.least = min(self.needs, default=0)
        #: Prefix word to (template, words of the template from this one on).
        self.prefixes: dict[int, list[tuple[int, int]]] = {}
        for number, (words, need) in enumerate(zip(self.sets, self.needs, strict=True)):
            for i, w in enumerate(sorted(words)[: len(words) - need + 1]):
                self.prefixes.setdefault(w, []).append((number, len(words) - i))
        self.starts = {w for w, i in self.place.items() if i in self.prefixes}

    def candidates(self, ordered: list[int]) -> Iterator[int]:
        """Templates that a block of these template words, in order, can meet by length, prefixes and positions."""
        seen = set()
        for j, w in enumerate(ordered[: len(ordered) - self.least + 1]):
            for number, left in self.prefixes.get(w, ()):
                if number not in seen:  # its first common word, as a prefix is the start of the order
                    seen.add(number)
                    if min(left, len(ordered) - j) >= self.needs[number]:
                        yield number

    def meets(self, block: set[str]) -> dict[int, float]:
        """Containment by template, of those that the block meets."""
        known = {self.place[w] for w in self.place.keys() & block}
        if len(known) < self.least:
            return {}
        common = {number: len(self.sets[number] & known) for number in self.candidates(sorted(known))}
        return {number: n / len(self.sets[number]) for number, n in common.items() if n >= self.needs[number]}

    def windows(self, words: list[str], number: int) -> Iterator[tuple[int, int, float]]:
        """(first word, last word, containment) of the places where windows meet a template; overlapping windows are one place, the best of them."""
        known, span, need = self.sets[number], self.spans[number], self.needs[number]
        hits = [(at, p) for at, w in enumerate(words) if (p := self.place.get(w)) in known]
        held: Counter[int] = Counter()
        best, until, lo = None, -1, 0
        for at, p in hits:
            held[p] += 1
            while hits[lo][0] <= at - span:
                held[hits[lo][1]] -= 1
                if not held[hits[lo][1]]:
                    del held[hits[lo][1]]
                lo += 1
            if len(held) >= need:
                if best and hits[lo][0] > until:
                    yield best
                    best = None
                if not best or len(held) / len(known) > best[2]:
                    best = hits[lo][0], at, len(held) / len(known)
                until = at
        if best:
            yield best

    def blocks(self, text: str, words: list[str]) -> list[dict]:
        """The lines that meet templates, and the windows over several lines that hold more of a template than each of these lines; `line` is the first one."""
        able = self.meets(set(words))
        if not able:
            return []
        out, starts, n = [], [], 0
        met: dict[int, dict[int, float]] = {}
        for number, line in enumerate(text.split("\n")):
            row = words_of(line)
            starts.append(n)
            n += len(row)
            met[number] = self.meets(set(row))
            out += [(number, t, c) for t, c in met[number].items()]
        for t in able:
            for first, last, c in self.windows(words, t):
                lo, hi = bisect_right(starts, first) - 1, bisect_right(starts, last) - 1
                if lo < hi and all(c > met[line].get(t, 0.0) for line in range(lo, hi + 1)):
                    out.append((lo, t, c))
        return [{"line": line, "label": self.labels[t], "containment": c} for line, t, c in sorted(out)]


def phrase_places(words: list[str], phrases: dict[str, str]) -> list[tuple[int, str]]:
    """(first word, label) of each place where a phrase's words stand."""
    line, found = f" {' '.join(words)} ", []
    for phrase, label in phrases.items():
        at, before, counted = line.find(f" {phrase} "), 0, 0
        while at >= 0:
            before, counted = before + line.count(" ", counted, at), at  # words up to the last place are not counted anew
            found.append((before, label))
            at = line.find(f" {phrase} ", at + 1)
    return found


def scan(docs: DataFrame, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None, threshold: float = 0.8) -> DataFrame:
    """Per document: word count, phrase places, labels, score, and the blocks (numbers of their first lines) with their template labels.

    score is 1 where a phrase stands, else the largest containment of a block that meets a template, else 0.
    """
    templates, phrases = templates or TEMPLATES, phrases or PHRASES
    vocabulary = {w for t in templates for w in words_of(t)}
    if len(vocabulary) > WORDS_MAX:
        raise ValueError(f"templates of over {WORDS_MAX} distinct words")
    join = TemplateJoin(templates, word_counts(docs, vocabulary), threshold)
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks array<struct<line: int, label: string, containment: double>>"
    block_type = pa.list_(pa.struct([("line", pa.int32()), ("label", pa.string()), ("containment", pa.float64())]))

    def row(text: str) -> tuple:
        words = words_of(text)
        places = phrase_places(words, phrases)
        blocks = [] if join.starts.isdisjoint(words) else join.blocks(text, words)  # else no prefix word in any block
        base = {label for _, label in places}
        at = [p for p, _ in places]
        score = 1.0 if places else max((b["containment"] for b in blocks), default=0.0)
        return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | {b["label"] for b in blocks})), score, blocks

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 1_000):
                part = batch.slice(lo, 1_000)
                columns = list(zip(*[row(t.as_py()) for t in part.column("text")], strict=True))
                kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), block_type]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"])

    return texts(docs).mapInArrow(work, schema)
