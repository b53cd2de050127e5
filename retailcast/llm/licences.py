"""Licence notices, found with a generalised suffix automaton over the words of licence templates.

Files are streamed through the automaton word by word, which gives the matching statistics: the
longest run of words ending here that stands in any template. Long matches are chained in the order
of a template; a chain that covers most of it is a span of that licence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailcast.llm.common import text_or_empty

# Phrases whose every place is reported, with their labels.
PHRASES = (
    ("cc-by", "cc by"),
    ("gpl", "general public license"),
    ("reserved", "all rights reserved"),
)
# Opening passages and one-line notices of public licences.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4.0 international license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "released under the mit license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2.0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
MIN_MATCH = 3  # words of a match that may be chained
MAX_GAP = 8  # words between two matches of a chain
MIN_COVER = 0.8  # share of a template that a chain must cover

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
SPAN = "array<struct<label:string,first_word:long,end_word:long,cover:double,phrase:boolean>>"


def words_of(text: str) -> list[bytes]:
    """Words of a text with A-Z in lower case: runs of digits, letters and all non-ASCII characters."""
    return _WORD.findall(text.encode("utf-8", "surrogatepass").lower())


class Automaton:
    """Suffix automaton of several word sequences."""

    def __init__(self, texts: list[list[bytes]]) -> None:
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.lengths = [len(t) for t in texts]
        ends: list[list[tuple[int, int]]] = [[]]
        for number, text in enumerate(texts):
            last = 0
            for place, word in enumerate(text):
                last = self._add(last, self.ids.setdefault(word, len(self.ids)), ends)
                ends[last].append((number, place))
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            ends[self.link[state]].extend(ends[state])
        #: (text, place of the last word) of every occurrence of a state's words.
        self.ends = [sorted(set(e)) for e in ends]

    def _clone(self, state: int, length: int, ends: list) -> int:
        self.next.append(dict(self.next[state]))
        self.link.append(self.link[state])
        self.length.append(length)
        ends.append([])
        return len(self.next) - 1

    def _redirect(self, state: int, word: int, old: int, new: int) -> None:
        while state >= 0 and self.next[state].get(word) == old:
            self.next[state][word] = new
            state = self.link[state]

    def _split(self, before: int, word: int, target: int, ends: list) -> int:
        """The state for the words of ``before`` and ``word`` alone, split off ``target`` if need be."""
        if self.length[target] == self.length[before] + 1:
            return target
        copy = self._clone(target, self.length[before] + 1, ends)
        self.link[target] = copy
        self._redirect(before, word, target, copy)
        return copy

    def _add(self, last: int, word: int, ends: list) -> int:
        if word in self.next[last]:
            return self._split(last, word, self.next[last][word], ends)
        state = len(self.next)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        ends.append([])
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = state
            last = self.link[last]
        if last >= 0:
            self.link[state] = self._split(last, word, self.next[last][word], ends)
        return state

    def whole_texts(self) -> list[list[int]]:
        """For every state, the texts that are a suffix of its words."""
        own: list[list[int]] = [[] for _ in self.next]
        for number, size in enumerate(self.lengths):
            for state in range(1, len(self.next)):
                if self.length[self.link[state]] < size <= self.length[state] and (number, size - 1) in self.ends[state]:
                    own[state].append(number)
        for state in sorted(range(1, len(self.next)), key=lambda s: self.length[s]):
            own[state] = own[state] + own[self.link[state]]
        return own


@lru_cache(maxsize=4)
def _matcher(templates: tuple, phrases: tuple) -> tuple[Automaton, list[list[int]]]:
    automaton = Automaton([words_of(t) for _, t in (*phrases, *templates)])
    whole = [[n for n in found if n < len(phrases)] for found in automaton.whole_texts()]
    return automaton, whole


def _stream(automaton: Automaton, whole: list[list[int]], words: list[bytes]) -> tuple[list, list]:
    """(phrase, first word) of all places of phrases; (state, length, last word) of the matches that
    the next word ends."""
    follow, link, length = automaton.next, automaton.link, automaton.length
    places, matches, state, size = [], [], 0, 0
    for at, word in enumerate(map(automaton.ids.get, words)):
        if word is None:
            if size >= MIN_MATCH:
                matches.append((state, size, at - 1))
            if state:
                state = size = 0
            continue
        to = follow[state].get(word)
        if to is None:
            if size >= MIN_MATCH:
                matches.append((state, size, at - 1))
            while state and to is None:
                state = link[state]
                to = follow[state].get(word)
            size = length[state]
            if to is None:
                continue
        state, size = to, size + 1
        for number in whole[state]:
            if automaton.lengths[number] <= size:
                places.append((number, at - automaton.lengths[number] + 1))
    if size >= MIN_MATCH:
        matches.append((state, size, len(words) - 1))
    return places, matches


def _chains(automaton: Automaton, matches: list, skip: int) -> Iterator[tuple[int, int, int, int]]:
    """(text, first word, end word, words covered) of the chains of matches, by text."""
    by_text: dict[int, list] = {}
    for state, size, last in matches:
        for number, place in automaton.ends[state]:
            if number >= skip:
                by_text.setdefault(number, []).append((last - size + 1, place - size + 1, size))
    for number, found in by_text.items():
        found.sort()
        best: list[tuple[int, int]] = []  # words covered, first word
        open_from, used = 0, set()
        for i, (start, place, size) in enumerate(found):
            while found[open_from][0] + automaton.lengths[number] + MAX_GAP < start:
                open_from += 1
            covered, first, came = size, start, -1
            for j in range(open_from, i):
                s, p, n = found[j]
                if 0 <= start - s - n <= MAX_GAP and 0 <= place - p - n <= MAX_GAP and best[j][0] + size > covered:
                    covered, first, came = best[j][0] + size, best[j][1], j
            best.append((covered, first))
            used.add(came)
        for i, (start, _, size) in enumerate(found):
            if i not in used:
                yield number, best[i][1], start + size, best[i][0]


def scan_text(text: str | None, templates: tuple = TEMPLATES, phrases: tuple = PHRASES) -> tuple[int, list[tuple]]:
    """Number of words, and (label, first word, end word, share of the template, is a phrase)."""
    words = words_of(text or "")
    automaton, whole = _matcher(templates, phrases)
    places, matches = _stream(automaton, whole, words)
    spans = [(phrases[n][0], at, at + automaton.lengths[n], 1.0, True) for n, at in places]
    names = [label for label, _ in (*phrases, *templates)]
    for number, first, end, covered in _chains(automaton, matches, len(phrases)):
        share = covered / automaton.lengths[number]
        if share >= MIN_COVER:
            spans.append((names[number], first, end, share, False))
    return len(words), sorted(spans, key=lambda s: (s[1], s[2], s[0], s[4]))


def licence_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple = TEMPLATES, phrases: tuple = PHRASES) -> DataFrame:
    """doc_id, n_words and spans of every row: places of phrases, and covered template spans.

    Word numbers count from 0, ends are exclusive. Null and empty texts have no words and no spans;
    equal rows give equal rows; an empty table gives an empty result; null ids stay null; long texts
    are streamed whole. Other columns, whatever their names, are not read.
    """
    kind = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("cover", pa.float64()), ("phrase", pa.bool_())]))
    names = ("label", "first_word", "end_word", "cover", "phrase")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan_text(t.as_py(), templates, phrases) for t in batch.column(1)]
            spans = pa.array([[dict(zip(names, s)) for s in spans] for _, spans in found], kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in found], pa.int64()), spans], ["doc_id", "n_words", "spans"])

    narrow = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    return narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, n_words long, spans {SPAN}")


def licence_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, labels and score of every row; the score is the largest share of a template or phrase."""
    spans = licence_spans(docs, id_col, text_col)
    base = F.filter("spans", lambda s: s["phrase"])
    starts = F.transform(base, lambda s: s["first_word"])
    labels = lambda found: F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda s: s["label"]))), ",")
    return spans.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["cover"])), F.lit(0.0)).alias("score"),
    )
