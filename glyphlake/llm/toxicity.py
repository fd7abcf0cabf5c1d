"""Toxicity: a learned lexicon, Levenshtein automata over its trie, and scores of the hits' context.

The lexicon holds words, and stems of several words, that labelled toxic documents have far more
often than others. Its trie is intersected with Levenshtein automata (one edit for terms of five
characters, two from nine on; a swap of neighbours is one edit), so misspelled terms are caught. The
intersection runs as one automaton whose states are made when a word first reaches them. Around each
hit a window of words tells quotation from abuse: quotation marks and words of reporting lower a
hit's weight, words of address raise it. A small logistic model turns the weights into a score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphlake.llm.common import written

#: Bound of the labelled rows that are learned from.
MOST_ROWS = 20_000
#: A term is in at least this share of the toxic rows (and three to five of them) and this much likelier there.
LEAST_SHARE, LEAST_LOG_ODDS = 0.006, 4.0
STEM_LENGTHS, STEM_WORDS = (4, 5, 6), 3
#: Weight of a misspelled hit against a true one; words on either side of a hit that are its context.
MISSPELLED, WINDOW = 0.7, 6
# Cues of quotation and of address.
QUOTES = "\"'“”„«»‘’‹›「」"
REPORTING = frozenset("said says quote quoted quoting called word words term dit mot sagte wort dijo palabra".split())
ADDRESS = frozenset("you your youre u tu toi vous du dich sie tú te usted".split())
TOKEN = re.compile(r"[^\W_]+")


def _edits(length: int) -> int:
    return 0 if length < 5 else 1 if length < 9 else 2


class Lexicon:
    """Terms in a trie; ``find`` gives the best (weight, edits) that a word reaches, or None."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.words, self.stems = words, stems
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[tuple[float, int, bool] | None] = [None]  # weight, edits allowed, whether a stem
        self.allowed = [0]  # most edits of any term below
        for term, weight, stem in [*((t, w, False) for t, w in words.items()), *((t, w, True) for t, w in stems.items())]:
            node, edits = 0, 0 if stem else _edits(len(term))
            self.allowed[0] = max(self.allowed[0], edits)
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(None)
                    self.allowed.append(0)
                node = self.children[node][c]
                self.allowed[node] = max(self.allowed[node], edits)
            if self.ends[node] is None or self.ends[node][0] < weight:
                self.ends[node] = (weight, edits, stem)
        self._reset()

    def __getstate__(self) -> dict:
        return {"words": self.words, "stems": self.stems}

    def __setstate__(self, state: dict) -> None:
        self.__init__(state["words"], state["stems"])

    def _reset(self) -> None:
        start = self._closed({(0, 0, "")})
        self.numbers: dict[frozenset, int] = {start: 0}
        self.sets = [start]
        self.moves: list[dict[str, int]] = [{}]
        self.found: list[tuple[float, int] | None] = [self._accepts(start)]

    def _closed(self, states: set) -> frozenset:
        """States (node, edits, expected) with letters of terms left out; expected is the second letter of a swap."""
        todo = list(states)
        while todo:
            node, edits, expected = todo.pop()
            if not expected and node >= 0 and edits < self.allowed[node]:
                for child in self.children[node].values():
                    if edits + 1 <= self.allowed[child] and (s := (child, edits + 1, "")) not in states:
                        states.add(s)
                        todo.append(s)
        return frozenset(states)

    def _accepts(self, states: frozenset) -> tuple[float, int] | None:
        best = None
        for node, edits, expected in states:
            end = self.ends[abs(node)] if not expected and node else None
            if end and edits <= end[1] and (best is None or (edits, -end[0]) < (best[1], -best[0])):
                best = (end[0], edits)
        return best

    def _step(self, number: int, letter: str) -> int:
        moved: set = set()
        for node, edits, expected in self.sets[number]:
            if node < 0:
                moved.add((node, edits, ""))  # behind a stem any letter will do
                continue
            if expected:
                if letter == expected:
                    moved.add((node, edits, ""))
                continue
            children = self.children[node]
            if letter in children:
                moved.add((children[letter], edits, ""))
            if edits < self.allowed[node]:
                moved.add((node, edits + 1, ""))
                for c, child in children.items():
                    if edits + 1 <= self.allowed[child]:
                        moved.add((child, edits + 1, ""))
                        if letter in self.children[child] and letter != c:
                            moved.add((self.children[child][letter], edits + 1, c))
        for node, edits, expected in list(moved):
            if node > 0 and not expected and (end := self.ends[node]) and end[2] and edits == 0:
                moved.add((-node, 0, ""))
        states = self._closed({s for s in moved if s[0] < 0 or s[1] <= self.allowed[s[0]]})
        if not states:
            return -1
        if states not in self.numbers:
            self.numbers[states] = len(self.sets)
            self.sets.append(states)
            self.moves.append({})
            self.found.append(self._accepts(states))
        return self.numbers[states]

    def find(self, word: str) -> tuple[float, int] | None:
        if len(self.sets) > 50_000:
            self._reset()
        at, moves = 0, self.moves
        for c in word:
            to = moves[at].get(c)
            if to is None:
                to = moves[at][c] = self._step(at, c)
            if to < 0:
                return None
            at = to
        return self.found[at]


def _context(text: str, tokens: list, i: int) -> float:
    """Factor of the hit at token i: halved for quotation marks around it and for reporting nearby, raised for address."""
    near = {t.group() for t in tokens[max(0, i - WINDOW) : i + WINDOW + 1]}
    begin, end = tokens[i].span()
    lead = text[tokens[max(0, i - WINDOW)].start() : begin]
    tail = text[end : tokens[min(len(tokens) - 1, i + WINDOW)].end()]
    quoted = any(q in lead for q in QUOTES) and any(q in tail for q in QUOTES)
    return (0.5 if quoted else 1.0) * (0.5 if near & REPORTING else 1.0) * (1.25 if near & ADDRESS else 1.0)


def hits(lexicon: Lexicon, text: str | None) -> tuple[list[tuple[str, float, int, float]], int]:
    """(word, weight, edits, context factor) of every hit of a text, and its number of words."""
    if not text:
        return [], 0
    text = text.lower()
    words = TOKEN.findall(text)
    found = {w: f for w in set(words) if (f := lexicon.find(w))}
    if not found:
        return [], len(words)
    tokens = list(TOKEN.finditer(text))
    return [(w, *found[w], _context(text, tokens, i)) for i, t in enumerate(tokens) if (w := t.group()) in found], len(words)


def _features(found: list, n_words: int, ignored: frozenset) -> list[float]:
    weights = [w * f * (1 if not edits else MISSPELLED) for word, w, edits, f in found if not (edits and word in ignored)]
    total = sum(weights)
    return [1.0, math.log1p(total), max(weights, default=0.0), math.log1p(100 * total / max(n_words, 20))]


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    beta = np.zeros(x.shape[1])
    ridge = np.diag([1e-6] + [0.5] * (x.shape[1] - 1))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(x.shape[1]), x.T @ (y - p) - ridge @ beta)
        beta += np.clip(step, -3, 3)
        if abs(step).max() < 1e-6:
            break
    return beta


def is_held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text has remainder 0 modulo 5; a null id is held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


class Model:
    """A lexicon, words that only look like its terms, and coefficients."""

    def __init__(self, lexicon: Lexicon, ignored: frozenset, beta: list[float]):
        self.lexicon, self.ignored, self.beta = lexicon, ignored, beta

    def score(self, text: str | None) -> float:
        found, n = hits(self.lexicon, text)
        z = sum(a * b for a, b in zip(self.beta, _features(found, n, self.ignored), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_rows: int = MOST_ROWS) -> Model:
    """Fit on at most ``most_rows`` labelled rows, those of the smallest id hashes that are not held out.

    Labels are 0 or 1; null labels, ids and rows without a document are left out, an id that repeats
    counts as toxic if any of its labels says so. Texts that repeat are learned from once. Without
    toxic rows the lexicon is empty and every score the same small number.
    """
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label is not null")
    known = known.where(~is_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    sample = written(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows), "sample")
    # The sample is bounded by most_rows, so it can be broadcast and no text is shuffled to find it.
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    texts = texts.join(F.broadcast(sample), "doc_id").groupBy(F.md5("text").alias("key")).agg(F.max("label").alias("label"), F.first("text").alias("text"))
    texts = written(texts.select("label", "text"), "texts")
    totals = {r["label"]: r["n"] for r in texts.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    positives, negatives = totals.get(1, 0), totals.get(0, 0)
    least = max(3.0, min(4.0, positives / 10), LEAST_SHARE * positives)

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for label, text in zip(batch["label"], batch["text"], strict=True):
                own = set(TOKEN.findall(text.lower()))
                stems = {(w[:n], w) for w in own for n in STEM_LENGTHS if len(w) > n}
                rows = [(False, w, "") for w in own] + [(True, s, w) for s, w in stems]
                yield pd.DataFrame(rows, columns=["stem", "term", "word"]).assign(label=label)

    listed = texts.mapInPandas(words, "stem boolean, term string, word string, label int")
    spread = listed.groupBy("stem", "term", "word").agg(F.sum("label").alias("pos"), F.count(F.lit(1)).alias("n"))
    summed = spread.groupBy("stem", "term").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"), F.sum((F.col("pos") > 0).cast("int")).alias("several"))
    enough = summed.where(F.col("pos") >= least).withColumn("neg", F.col("n") - F.col("pos"))
    odds = F.log((F.col("pos") + 0.5) / F.lit(positives + 1.0)) - F.log((F.col("neg") + 0.5) / F.lit(negatives + 1.0))
    bar = min(LEAST_LOG_ODDS, max(1.0, math.log(negatives + 1) - 2.0))
    rows = enough.withColumn("odds", odds).where(F.col("odds") >= bar).where(~F.col("stem") | ((F.col("several") >= STEM_WORDS) & (F.col("pos") >= 2 * least))).orderBy("term").collect()  # LEAST_SHARE of the toxic rows hold each: bounded by the sample
    found_words = {r["term"]: min(r["odds"], 8.0) for r in rows if not r["stem"] and len(r["term"]) >= 3}
    found_stems = {r["term"]: min(r["odds"], 8.0) for r in rows if r["stem"]}
    # A stem that begins with another stem says nothing new.
    found_stems = {s: w for s, w in found_stems.items() if not any(s[:n] in found_stems for n in STEM_LENGTHS if n < len(s))}
    lexicon = Lexicon(found_words, found_stems)

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for label, text in zip(batch["label"], batch["text"], strict=True):
                found, n = hits(lexicon, text)
                out.append((label, n, [f[0] for f in found], [f[1] for f in found], [f[2] for f in found], [f[3] for f in found]))
            yield pd.DataFrame(out, columns=["label", "n", "words", "weights", "edits", "factors"])

    # Hits stay on the executors; what comes back is bounded by the sample of labelled rows.
    seen = written(texts.mapInPandas(measured, "label int, n long, words array<string>, weights array<double>, edits array<int>, factors array<double>"), "hits")
    looks = seen.select("label", F.explode(F.expr("array_distinct(transform(filter(arrays_zip(words, edits), h -> h.edits > 0), h -> h.words))")).alias("word"))
    looks = looks.groupBy("word").agg(F.sum((F.col("label") == 0).cast("int")).alias("clean"), F.sum((F.col("label") > 0).cast("int")).alias("toxic"))
    common = looks.where((F.col("clean") > 0) & (F.col("clean") * (positives + 1) >= F.col("toxic") * (negatives + 1) / 4))
    ignored = frozenset(r["word"] for r in common.select("word").collect())
    if not positives or not negatives:
        return Model(lexicon, ignored, [-4.0 if not positives else 0.0, 1.0, 0.0, 0.0])

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [_features(list(zip(*h, strict=True)), n, ignored) for n, *h in zip(batch["n"], batch["words"], batch["weights"], batch["edits"], batch["factors"], strict=True)]
            yield pd.DataFrame({"x": rows, "y": (batch["label"] > 0).astype(float)})

    rows = seen.mapInPandas(features, "x array<double>, y double").collect()
    x, y = np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows])
    return Model(lexicon, ignored, _logistic(x, y).tolist())


def scorer(model: Model):
    """A pandas UDF from text to score; null and empty texts get the model's score of no evidence."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts], dtype="float64")

    return score


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Repeated rows are scored each by itself; other columns are ignored and never inputs of a score;
    an empty table gives an empty result.
    """
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), scorer(model)(F.col(text_col)).alias("score"))
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
