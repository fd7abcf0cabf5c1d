"""SentencePiece encoding and decoding by suffix-array matching.

The distinct words of a batch are laid end to end and indexed by a suffix array, cut at the longest
piece's length. Binary search finds the range of suffixes that begin with each piece; the ranges'
positions are the edges of the piece lattice, sorted by position. The relaxation joins neighbouring
symbols along edges, best-scored edge of a word first and the leftmost of equal ones, until no edge
spans two symbols: the pieces of a byte-pair model. What no piece covers falls back to byte pieces.

Words are runs of the space mark followed by other characters. They can be encoded one by one
because no piece has a space mark behind another character; ``Model`` checks that.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphlake.llm.common import short_batches

SPACE = "▁"
#: Characters indexed at a time, words kept between batches, characters of texts handled at a time.
INDEXED, KEPT, HANDLED = 1 << 18, 1_000_000, 1 << 22
#: Words longer than this are relaxed one by one from a heap.
LONG = 96
NEVER = np.iinfo(np.int32).max


class Model:
    """Pieces, scores and byte pieces of a model file."""

    def __init__(self, path: str):
        import sentencepiece

        read = sentencepiece.SentencePieceProcessor(model_file=path)
        n = read.get_piece_size()
        self.bytes_at = {}
        names, ids, scores = [], [], []
        self.spelled: list[bytes] = [b""] * n
        for i in range(n):
            piece = read.id_to_piece(i)
            if read.is_byte(i):
                self.bytes_at[int(piece[3:5], 16)] = i
                self.spelled[i] = bytes([int(piece[3:5], 16)])
            elif not read.is_control(i) and not read.is_unknown(i):
                names.append(piece)
                ids.append(i)
                scores.append(read.get_score(i))
                self.spelled[i] = piece.replace(SPACE, " ").encode()
        self.unknown = read.unk_id()
        if any(SPACE in p.lstrip(SPACE) for p in names):
            raise ValueError("a piece has a space mark inside: words cannot be encoded one by one")
        self.ids = np.array(ids, np.int32)
        # Equal scores share a rank, so that among them the leftmost edge comes first.
        self.rank = (np.unique(-np.array(scores), return_inverse=True)[1]).astype(np.int32)
        self.rank = np.r_[self.rank, np.int32(NEVER)]  # at -1: no piece
        self.lengths = np.array([len(p) for p in names])
        self.longest = int(self.lengths.max())
        self.codes = np.zeros((len(names), self.longest), np.uint32)
        for row, p in zip(self.codes, names, strict=True):
            row[: len(p)] = np.frombuffer(p.encode("utf-32-le"), np.uint32)

    def edges(self, text: np.ndarray) -> np.ndarray:
        """For code points with zeros between words the piece number, or -1, by position and length."""
        width = self.longest
        alphabet = np.unique(text[text > 0])
        kind, room = (np.dtype(np.uint8), 8) if len(alphabet) < 255 else (np.dtype(">u4"), 2)
        padded = np.zeros(len(text) + -(-width // room) * room, kind)
        padded[: len(text)] = np.searchsorted(alphabet, text) + (text > 0)
        columns = -(-width // room)
        windows = np.lib.stride_tricks.sliding_window_view(padded, columns * room)[: len(text)]
        keys = np.ascontiguousarray(windows).view(">u8").astype(np.uint64)
        suffixes = np.lexsort(keys.T[::-1])
        ordered = keys[suffixes]
        known = np.isin(self.codes, np.r_[np.uint32(0), alphabet]).all(1)
        rows = np.flatnonzero(known)
        wanted = np.zeros((len(rows), columns * room), kind)
        wanted[:, :width] = np.searchsorted(alphabet, self.codes[rows]) + (self.codes[rows] > 0)
        low = wanted.copy()
        high = wanted
        beyond = np.arange(columns * room)[None, :] >= self.lengths[rows][:, None]
        high[beyond] = np.iinfo(kind).max
        starts = self._searched(ordered, low.view(">u8").astype(np.uint64), False)
        ends = self._searched(ordered, high.view(">u8").astype(np.uint64), True)
        counts = ends - starts
        total = int(counts.sum())
        within = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
        position = suffixes[np.repeat(starts, counts) + within].astype(np.int32)
        piece = np.repeat(rows.astype(np.int32), counts)
        by_position = np.argsort(position, kind="stable")
        position, piece = position[by_position], piece[by_position]
        which = np.full((len(text), width), -1, np.int32)
        which.ravel()[position * np.int64(width) + self.lengths[piece] - 1] = piece
        return which

    @staticmethod
    def _searched(ordered: np.ndarray, wanted: np.ndarray, after: bool) -> np.ndarray:
        """Binary search of every wanted key among ordered keys of several columns."""
        lo, hi = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(ordered), np.int64)
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            at = ordered[np.minimum(mid, len(ordered) - 1)]
            less = np.zeros(len(wanted), bool)
            tied = np.ones(len(wanted), bool)
            for c in range(wanted.shape[1]):
                less |= tied & (at[:, c] < wanted[:, c])
                tied &= at[:, c] == wanted[:, c]
            if after:
                less |= tied
            lo = np.where(open_ & less, mid + 1, lo)
            hi = np.where(open_ & ~less, mid, hi)
        return lo

    def encode_words(self, words: list[str]) -> list[tuple[int, ...]]:
        """Piece ids of each word."""
        out: list = [None] * len(words)
        at = 0
        while at < len(words):
            size, upto = 0, at
            while upto < len(words) and (size == 0 or size + len(words[upto]) < INDEXED):
                size += len(words[upto]) + 1
                upto += 1
            out[at:upto] = self._encoded(words[at:upto])
            at = upto
        return out

    def _encoded(self, words: list[str]) -> list[tuple[int, ...]]:
        text = np.frombuffer("\0".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(lengths + 1) - lengths - 1
        bare = text.copy()
        bare[starts[1:] - 1] = 0
        which = self.edges(bare)
        word = np.repeat(np.arange(len(words)), lengths)
        first = np.repeat(starts, lengths) + np.arange(len(word)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        size = np.ones(len(first), np.int64)
        long = lengths > LONG
        done_word, done_first, done_size = [], [], []
        for w in np.flatnonzero(long):
            a, b = self._from_heap(which, int(starts[w]), int(lengths[w]))
            done_word.append(np.full(len(a), w))
            done_first.append(a)
            done_size.append(b)
        short = ~long[word]
        word, first, size = word[short], first[short], size[short]
        while len(word):
            joint = np.zeros(len(word), np.int64)
            joint[:-1] = np.where(word[1:] == word[:-1], size[:-1] + size[1:], 0)
            rank = np.where((joint > 0) & (joint <= self.longest), self.rank[which.ravel()[first * self.longest + np.clip(joint, 1, self.longest) - 1]], NEVER)
            cut = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(rank, cut)
            counts = np.diff(np.r_[cut, len(word)])
            going = least < NEVER
            rest = np.repeat(going, counts)
            done_word.append(word[~rest])
            done_first.append(first[~rest])
            done_size.append(size[~rest])
            hit = np.flatnonzero(rest & (rank == np.repeat(least, counts)))
            hit = hit[np.r_[True, word[hit[1:]] != word[hit[:-1]]]] if len(hit) else hit
            size[hit] = joint[hit]
            rest[hit + 1] = False
            word, first, size = word[rest], first[rest], size[rest]
        word, first, size = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (done_word, done_first, done_size))
        order = np.argsort(first, kind="stable")
        word, first, size = word[order], first[order], size[order]
        piece = which[first, size - 1]
        ids = np.where(piece >= 0, self.ids[piece], -1)
        cuts = np.searchsorted(word, np.arange(len(words) + 1))
        found = ids.tolist()
        missing = np.flatnonzero(ids < 0)
        out = [tuple(found[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        for w in dict.fromkeys(word[missing].tolist()):
            spelled: list[int] = []
            for i in range(cuts[w], cuts[w + 1]):
                spelled += [found[i]] if found[i] >= 0 else self._as_bytes(chr(text[first[i]]))
            out[w] = tuple(spelled)
        return out

    def _as_bytes(self, character: str) -> list[int]:
        return [self.bytes_at.get(b, self.unknown) for b in character.encode("utf-8", "surrogatepass")]

    def _from_heap(self, which: np.ndarray, start: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Symbols (first, size) of one long word."""
        size = [1] * n
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] >= 0 and (joint := size[i] + size[after[i]]) <= self.longest and (rank := int(self.rank[which[start + i, joint - 1]])) < NEVER:
                heapq.heappush(heap, (rank, i, joint))

        for i in range(n - 1):
            offer(i)
        while heap:
            rank, i, joint = heapq.heappop(heap)
            if not size[i] or after[i] < 0 or size[i] + size[after[i]] != joint:
                continue
            gone = after[i]
            size[i], size[gone], after[i] = joint, 0, after[gone]
            if after[gone] >= 0:
                before[after[gone]] = i
            offer(before[i])
            offer(i)
        kept = [i for i in range(n) if size[i]]
        return np.array(kept, np.int64) + start, np.array([size[i] for i in kept], np.int64)

    def encode(self, texts: list, kept: Words) -> tuple[np.ndarray, np.ndarray, list[bool]]:
        """The ids of all texts in one array, where each text's ids end, and whether decoding gives it back.

        A null or empty text has no ids. ``kept`` remembers words, KEPT of them at most between calls.
        """
        if len(kept.at) > KEPT:
            kept.__init__()
        split = [_WORDS.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        new = list(set(chain.from_iterable(split)).difference(kept.at))
        kept.add(new, self.encode_words(new), self)
        used = np.fromiter(map(kept.at.__getitem__, chain.from_iterable(split)), np.int64)
        starts, lengths = kept.ends[used], kept.ends[used + 1] - kept.ends[used]
        ends = np.cumsum(lengths)
        ids = kept.ids[np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]
        cuts = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))
        same = [not t or (SPACE not in t and kept.bad.isdisjoint(words)) for t, words in zip(texts, split, strict=True)]
        return ids, np.r_[0, ends][cuts], same

    def decode(self, ids) -> str:
        """The text of ids; the space that encoding puts before a text is taken off."""
        if any(not 0 <= i < len(self.spelled) for i in ids):
            raise ValueError(f"an id is outside the model's 0 to {len(self.spelled) - 1}")
        text = b"".join(map(self.spelled.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


class Words:
    """Words and their ids in one array; word i has those from ``ends[i]`` to ``ends[i + 1]``. ``bad`` words do not decode to themselves."""

    def __init__(self) -> None:
        self.at: dict[str, int] = {}
        self.ids, self.ends, self.bad = np.zeros(0, np.int32), np.zeros(1, np.int64), set()

    def add(self, words: list[str], ids: list[tuple[int, ...]], model: Model) -> None:
        if not words:
            return
        self.at.update(zip(words, range(len(self.at), len(self.at) + len(words)), strict=True))
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        self.ends = np.r_[self.ends, self.ends[-1] + np.cumsum(lengths)]
        self.ids = np.r_[self.ids, np.fromiter(chain.from_iterable(ids), np.int32, int(lengths.sum()))]
        spelled = model.spelled
        for word, own in zip(words, ids, strict=True):
            if b"".join([spelled[i] for i in own]) != word.replace(SPACE, " ").encode("utf-8", "surrogatepass"):
                self.bad.add(word)


_WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_MODELS: dict[str, tuple[Model, Words]] = {}


def _model(path: str) -> tuple[Model, Words]:
    if path not in _MODELS:
        _MODELS[path] = (Model(path), Words())
    return _MODELS[path]


def _runs(texts: list) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= HANDLED:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, n_tokens, token_ids, round_trip and the columns that ``keep`` names.

    Ids are those of the model's own library. round_trip tells whether decoding them gives the text
    back; it is false only for texts that hold the space mark U+2581, which reads as a space. Null
    and empty texts have no tokens and true. The model file must be at ``model_path`` on every
    executor. Repeated rows are encoded each by itself; other columns are ignored; an empty table
    gives an empty result.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, kept = _model(model_path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in _runs(texts):
                ids, ends, same = model.encode(texts[a:b], kept)
                ends = np.r_[0, ends].astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], pa.array(np.diff(ends).astype(np.int64)), listed, pa.array(same, pa.bool_()), *(batch.column(i + 2)[a:b] for i in range(len(keep)))], names)

    names = ["doc_id", "n_tokens", "token_ids", "round_trip", *keep]
    schema = "doc_id long, n_tokens long, token_ids array<int>, round_trip boolean" + "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *(docs[c] for c in keep))
    with short_batches(docs.sparkSession):
        return picked.mapInArrow(kernel, schema)


def decode(tokens: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """One row per input row: doc_id and text; null ids give a null text, ids outside the model fail."""

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, _ = _model(model_path)
        for batch in batches:
            texts = [None if x is None else model.decode(list(x)) for x in batch["ids"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "text": texts})

    picked = tokens.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids"))
    return picked.mapInPandas(kernel, "doc_id long, text string")
