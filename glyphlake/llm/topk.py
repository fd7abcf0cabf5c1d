"""Exact top-k inner products with an impact-ordered, score-at-a-time index.

Components are whole numbers. Vectors are indexed in chunks: for every dimension and every quantised
level (LEVEL component values wide) a posting segment lists the chunk's rows with that level. A
segment's impact is how far it moves a score of some query from the middle of its dimension; the
segments are read by descending impact, each once for all queries of a block, and every row keeps
bounds of its score for every query: a dimension that a row still waits for adds something between
the outermost levels left there. A query stops only on proof: once so few rows can still be among its
k best that rescoring them exactly is cheaper, or all segments are done. The rows that remain
possible are rescored from their full vectors, so results are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphlake.llm.common import written

#: Width of a quantised level in component values; rows in an indexed chunk.
LEVEL, CHUNK = 4, 4096
#: Queries in a block and blocks in a pass: a pass broadcasts at most BLOCK * PER_PASS queries.
BLOCK, PER_PASS = 512, 16
#: Queries whose bounds are held at once; shares of the postings after which they are looked at, and the share of rows at which rescoring takes over.
TOGETHER, SHARES, LEFT = 128, (1 / 2, 3 / 4, 7 / 8, 15 / 16, 1), 1 / 16
#: A usable vector with a component beyond this magnitude fails the query: its scores might not fit 64 bits.
RANGE = float(1 << 20)


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """(vec_id, v): components as floor(scale * x).

    Rows with a null id, a null or empty vector, or null or non-finite components take no part. Among
    the others a component beyond RANGE raises an error, as no row may be lost in silence.
    """
    picked = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(F.col(vector_col), lambda e: e.cast("double")).alias("x"))
    usable = F.forall("x", lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < float("inf")), F.lit(False)))
    usable = F.col("vec_id").isNotNull() & (F.size("x") > 0) & usable
    beyond = F.exists("x", lambda e: F.abs(e) > RANGE)
    said = F.raise_error(F.concat(F.lit(f"a component is beyond {RANGE:.0f} in the vector of id "), F.col("vec_id").cast("string"))).cast("boolean")
    return picked.where(F.when(~F.coalesce(usable, F.lit(False)), F.lit(False)).when(beyond, said).otherwise(F.lit(True))).select("vec_id", F.transform("x", lambda e: F.floor(e * scale).cast("long")).alias("v"))


class Chunk:
    """Posting segments of rows of one length, by dimension and level."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        self.largest = float(np.abs(rows).max(initial=0)) + LEVEL
        levels = rows // LEVEL
        low = levels.min(0)
        first = np.r_[0, np.cumsum(levels.max(0) - low + 1)]
        cells = (levels - low + first[:-1]).T.ravel()  # by dimension, then row
        self.posted = np.argsort(cells, kind="stable")  # a posting's place among all components
        cells = cells[self.posted]
        self.starts = np.flatnonzero(np.r_[True, np.diff(cells) != 0])
        self.lengths = np.diff(np.r_[self.starts, len(cells)])
        self.dims = self.posted[self.starts] // len(ids)
        self.edges = ((cells[self.starts] - first[self.dims] + low[self.dims]) * LEVEL).astype(float)

    def _left(self, done: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Middle and half width of what the segments that are not done hold, by dimension; 0 where there are none."""
        first = np.flatnonzero(np.r_[True, np.diff(self.dims) != 0])
        lo = np.minimum.reduceat(np.where(done, np.inf, self.edges), first)
        hi = np.maximum.reduceat(np.where(done, -np.inf, self.edges + LEVEL - 1), first)
        some = lo <= hi
        lo, hi = np.where(some, lo, 0.0), np.where(some, hi, 0.0)
        return (lo + hi) / 2, (hi - lo) / 2

    def best(self, queries: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(place, scores, ids) for each row of queries, in any order: its k best rows of this chunk but those of its own id, ties to smaller ids."""
        n, dims = self.rows.shape
        weights = queries.astype(float)
        sizes = np.abs(weights)
        # Half a level's width for every component, and what sums of doubles may be off by.
        slack = sizes.sum(1) * ((LEVEL - 1) / 2 + self.largest * (dims + 8) * 2.0**-50) + 1
        centres = self.edges + (LEVEL - 1) / 2
        done = np.zeros(len(centres), bool)
        middle, half = self._left(done)
        order = np.argsort(-sizes.max(0)[self.dims] * np.abs(centres - middle[self.dims]), kind="stable")
        ends = np.cumsum(self.lengths[order])
        value, waiting = np.zeros(dims * n), np.ones(dims * n)
        open_ = np.arange(len(queries))
        read = 0
        for share in SHARES:
            upto = int(np.searchsorted(ends, share * ends[-1])) + 1
            part, read = order[read:upto], max(read, upto)
            lengths = self.lengths[part]
            places = self.posted[np.arange(lengths.sum()) + np.repeat(self.starts[part] - np.cumsum(lengths) + lengths, lengths)]
            value[places], waiting[places], done[part] = np.repeat(centres[part], lengths), 0.0, True
            middle, half = self._left(done)
            held = waiting.reshape(dims, n)
            score = weights[open_] @ (value.reshape(dims, n) + middle[:, None] * held)
            off = (sizes[open_] * half) @ held + slack[open_, None]
            others = self.ids != own[open_, None]
            if n > k:
                line = np.partition(np.where(others, score - off, -np.inf), n - k, axis=1)[:, n - k]  # k rows reach it
                others &= score + off >= line[:, None]
            few = np.full(len(open_), share == 1) | (others.sum(1) <= max(4 * k, n * LEFT))
            for i in np.flatnonzero(few):
                possible = np.flatnonzero(others[i])
                ids, scores = self.ids[possible], self.rows[possible] @ queries[open_[i]]
                top = np.lexsort((ids, -scores))[:k]
                yield int(open_[i]), scores[top], ids[top]
            open_ = open_[~few]
            if not len(open_):
                return


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        lengths = batch["v"].map(len)
        for dims in sorted(lengths.unique()):
            own = batch[lengths == dims]
            for i in range(0, len(own), CHUNK):
                part = own.iloc[i : i + CHUNK]
                yield pd.DataFrame({"ids": [part["vec_id"].to_numpy(np.int64).tobytes()], "rows": [np.stack(part["v"]).astype(np.int64).tobytes()], "dims": [dims]})


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k rows of the highest inner product but itself.

    Both inputs have (vec_id long, v array<long>), see ``whole_vectors``. Ties go to the smaller
    vec_id; a query with fewer other rows gets all of them; only vectors of the query's length are
    compared, and rows with the query's own id never. Rows that repeat a vec_id are each a candidate;
    as a query such an id counts once, with its smallest vector. Empty inputs give an empty result.

    Every vector is indexed, in chunks that stay where the rows are read. Queries come in blocks; a
    pass sends at most BLOCK * PER_PASS of them to all chunks, which bounds the broadcast, and yields
    k rows per query and chunk, merged at the end.
    """
    asked = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    n = max(1, -(-asked.count() // BLOCK))
    blocks = asked.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int").alias("block")).agg(F.collect_list(F.struct("vec_id", "v")).alias("queries"))
    blocks = written(blocks, "queries")
    chunks = written(vectors.mapInPandas(_chunks, "ids binary, rows binary, dims int"), "chunks")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: tuple = (None, None)
        for batch in batches:
            for ids, rows, dims, asked in zip(batch["ids"], batch["rows"], batch["dims"], batch["queries"], strict=True):
                if last[0] != (ids, rows):
                    last = ((ids, rows), Chunk(np.frombuffer(ids, np.int64), np.frombuffer(rows, np.int64).reshape(-1, dims)))
                fitting = [q for q in asked if len(q["v"]) == dims]
                for i in range(0, len(fitting), TOGETHER):
                    some = fitting[i : i + TOGETHER]
                    own = np.array([q["vec_id"] for q in some], np.int64)
                    found = list(last[1].best(np.stack([q["v"] for q in some]).astype(np.int64), own, k))
                    names = np.repeat(own[[place for place, _, _ in found]], [len(near) for _, _, near in found])
                    yield pd.DataFrame({"query_id": names, "vec_id": np.concatenate([near for _, _, near in found]), "score": np.concatenate([scores for _, scores, _ in found])})

    parts = []
    for first in range(0, n, PER_PASS):
        some = blocks.where(F.col("block").between(first, first + PER_PASS - 1)).select("queries")
        found = chunks.join(F.broadcast(some)).mapInPandas(search, "query_id long, vec_id long, score long")
        parts.append(written(found, "nearest") if n > PER_PASS else found)
    found = parts[0]
    for x in parts[1:]:
        found = found.unionByName(x)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
