"""License scans: fixed phrases, and license templates compiled to token automata.

Templates use the markup of public license lists: ``<<beginOptional>> ... <<endOptional>>`` may be
left out, ``<<var;max=N>>`` stands for 0 to N words of any kind, everything else is mandatory wording
that must match word for word. A template becomes a small automaton over words; a document carries
the template's label if the automaton accepts a stretch of its words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases and their labels.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Short notices and license texts as templates, by label.
TEMPLATES = {
    "mit": [
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software
        and associated documentation files <<beginOptional>>(the "Software")<<endOptional>>, to deal in the Software without restriction,
        including without limitation the rights to use, copy, modify, merge, publish, distribute,
        sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is
        furnished to do so, subject to the following conditions: The above copyright notice and this
        permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software."""
    ],
    "isc": [
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without
        fee is hereby granted, provided that the above copyright notice and this permission notice
        appear in all copies."""
    ],
    "bsd": [
        """Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met: <<var;max=2>> Redistributions of source code must retain
        the above copyright notice, this list of conditions and the following disclaimer.
        <<var;max=2>> Redistributions in binary form must reproduce the above copyright notice, this list of
        conditions and the following disclaimer in the documentation and/or other materials provided
        with the distribution."""
    ],
    "apache-2": [
        """Licensed under the Apache License, Version 2.0 <<beginOptional>>(the "License"); you may not use
        this file except in compliance with the License.<<endOptional>>""",
    ],
    "gpl": [
        """<<beginOptional>>licensed <<endOptional>>under the <<beginOptional>>terms of the <<endOptional>>GNU General Public License<<beginOptional>>
        as published by the Free Software Foundation<<endOptional>><<beginOptional>>; either<<endOptional>> version <<var;max=1>>"""
    ],
    "lgpl": ["""under the <<beginOptional>>terms of the <<endOptional>>GNU <<beginOptional>>Lesser<<endOptional>><<beginOptional>>Library<<endOptional>> General Public License version 2.1"""],
    "mpl-2": ["""subject to the terms of the Mozilla Public License, v<<var;max=1>> 2.0"""],
    "unlicense": ["""This is free and unencumbered software released into the public domain."""],
}

_WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text, A-Z lower-cased.

    All bytes of characters beyond ASCII are word bytes, so translating bytes and splitting them at
    spaces gives the same words as the pattern does on characters.
    """
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split() if text else []


def _var_words(markup: str) -> tuple[int, int | None]:
    """Least and most words (None: any number) of a replaceable region.

    ``max=n`` says so in words; ``match="..."`` is a pattern over characters, as in published templates:
    ``.*`` and ``.+`` any number, ``.{m,n}`` no more words than fit n characters. What has neither, or
    another pattern, is any number of words from one on.
    """
    if found := re.search(r";\s*max=(\d+)", markup):
        return 0, int(found[1])
    pattern = found[1] if (found := re.search(r'match="([^"]*)"', markup)) else ".+"
    if found := re.fullmatch(r"\.\{(\d*),(\d*)\}", pattern):
        least, most = int(found[1] or 0), int(found[2]) if found[2] else None
        return int(least > 0), None if most is None else max(int(least > 0), (most + 1) // 2)
    return (0, None) if pattern in (".*", "") else (1, None)


class Automaton:
    """A template over words. States are numbered; state 0 starts and the last state accepts."""

    def __init__(self, template: str):
        self.steps: list[tuple[bytes | None, int]] = []  # (word, or None for any word; state it leads to) by state
        self.skips: list[list[int]] = []  # states reached without a word
        opened: list[int] = []
        for part in re.findall(r'<<(?:"[^"]*"|[^">]|>(?!>))*>>|[^<]+|<', template):
            if part.startswith("<<beginOptional"):
                opened.append(self._state(None, 0))
                self.steps[-1] = (b"", -1)
            elif part.startswith("<<endOptional"):
                if not opened:
                    raise ValueError("an optional region ends that has not begun")
                self.skips[opened.pop()].append(len(self.steps))
            elif part.startswith("<<var"):
                least, most = _var_words(part)
                for _ in range(least):
                    self._state(None, 1)
                more = [self._state(None, 1) for _ in range((most or least) - least)]
                for state in more:  # from each of them the region may end
                    self.skips[state].append(len(self.steps))
                if most is None:  # any number of words: a state that leads to itself
                    loop = self._state(None, 1)
                    self.steps[loop] = (None, loop)
                    self.skips[loop].append(len(self.steps))
            else:
                for word in words_of(part):
                    self._state(word, 1)
        if opened:
            raise ValueError("an optional region does not end")
        self._state(b"", 0)
        self.final = len(self.steps) - 1
        self.closed = [self._closure(s) for s in range(len(self.steps))]
        self.first = {self.steps[s][0] for s in self.closed[0]} - {b""}

    def _state(self, word: bytes | None, consumes: int) -> int:
        at = len(self.steps)
        self.steps.append((word, at + 1) if consumes else (b"", -1))
        self.skips.append([] if consumes or word == b"" else [at + 1])
        return at

    def _closure(self, state: int) -> frozenset[int]:
        found, todo = {state}, [state]
        while todo:
            for x in self.skips[todo.pop()]:
                if x not in found:
                    found.add(x)
                    todo.append(x)
        return frozenset(found)

    def end(self, words: list[bytes], start: int) -> int:
        """One past the last word of the longest stretch from start that is accepted; -1 for none."""
        states, best, at = self.closed[0], -1, start
        while states:
            if self.final in states:
                best = at
            if at == len(words):
                break
            word, moved = words[at], set()
            for s in states:
                wanted, to = self.steps[s]
                if to >= 0 and (wanted is None or wanted == word):
                    moved |= self.closed[to]
            states, at = moved, at + 1
        return best

    def spans(self, words: list[bytes], places: dict[bytes, list[int]]) -> list[tuple[int, int]]:
        """(start, end) of accepted stretches, for every end the longest; ``places`` lists where words that may begin one stand.

        All stretches go through the text together: a state keeps the earliest start that leads to it, as
        a later one cannot give a longer stretch. So the work is the text's words times the states that
        are open, whatever the regions; between starts, where none is open, words are passed over.
        """
        anywhere = None in self.first
        starts = range(len(words)) if anywhere else sorted(i for w in self.first for i in places.get(w, ()))
        out: list[tuple[int, int]] = []
        active: dict[int, int] = {}
        at = following = 0
        while at < len(words):
            if not active:
                if following == len(starts):
                    break
                at = starts[following]
            if following < len(starts) and starts[following] == at:
                following += 1
                for s in self.closed[0]:
                    active.setdefault(s, at)
            moved: dict[int, int] = {}
            for s, start in active.items():
                wanted, to = self.steps[s]
                if to >= 0 and (wanted is None or wanted == words[at]):
                    for t in self.closed[to]:
                        if moved.get(t, start) >= start:
                            moved[t] = start
            active, at = moved, at + 1
            if self.final in active:
                out.append((active[self.final], at))
        return out


def compiled(templates: dict[str, list[str]]) -> list[tuple[str, Automaton]]:
    return [(label, Automaton(text)) for label, texts in sorted(templates.items()) for text in texts]


def scan(words: list[bytes], phrases: list[tuple[list[bytes], str]], automata: list[tuple[str, Automaton]], first: set[bytes]) -> tuple:
    """(n_base, first_word, last_word, base labels, all labels, covered words) of one document."""
    joined = b" " + b" ".join(words) + b" "
    places: list[int] = []
    base: set[str] = set()
    spans: list[tuple[int, int]] = []
    for phrase, label in phrases:
        needle = b" " + b" ".join(phrase) + b" "
        at = joined.find(needle)
        word = seen = 0
        while at >= 0:
            word += joined.count(b" ", seen, at)
            seen = at
            places.append(word)
            spans.append((word, word + len(phrase)))
            base.add(label)
            at = joined.find(needle, at + 1)
    labels = set(base)
    starts: dict[bytes, list[int]] = {}
    for i, w in enumerate(words):
        if w in first:
            starts.setdefault(w, []).append(i)
    for label, automaton in automata:
        if found := automaton.spans(words, starts):
            labels.add(label)
            spans += found
    covered, reached = 0, 0
    for a, b in sorted(spans):
        covered += max(0, b - max(a, reached))
        reached = max(reached, b)
    return len(places), min(places, default=None), max(places, default=None), base, labels, covered


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts every place where a phrase's words stand consecutively, first_word and last_word
    are the smallest and largest start of such a place, base_labels the phrases' labels; labels adds
    those of the accepted templates. score is the share of the document's words that phrases and
    accepted templates cover. A null or empty text has no words: counts 0, places null, labels
    empty, score 0. Repeated rows are judged each by itself; other columns are ignored; an empty
    table gives an empty result.
    """
    listed = sorted((words_of(p), label) for p, label in (BASE_PHRASES if phrases is None else phrases).items())
    wanted = TEMPLATES if templates is None else templates

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automata = compiled(wanted)
        first = set().union(*(a.first for _, a in automata))
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                words = words_of(text)
                n, lo, hi, base, labels, covered = scan(words, listed, automata, first)
                out.append((doc_id, len(words), n, lo, hi, ",".join(sorted(base)), ",".join(sorted(labels)), covered / max(1, len(words))))
            frame = pd.DataFrame(out, columns=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])
            yield frame.astype({"doc_id": "Int64", "first_word": "Int64", "last_word": "Int64"})

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInPandas(kernel, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
