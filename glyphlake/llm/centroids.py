"""Centroid clustering in whole numbers, with a table of distances to pivots.

The distances of every vector to a few fixed pivots are worked out once and stored beside it. In each
round the difference between a vector's and a centroid's distance to a pivot bounds their distance
from below (triangle inequality); a centroid whose bound is beyond the best distance so far is passed
over, and only the others get an exact squared distance in whole numbers. Bounds are doubles and are
lowered by more than rounding can add, so that they never pass over a nearest centroid or a tie.

A round is one pass over the stored table. Its tasks yield a sum for each centroid, so what is
shuffled and what the driver reads depends on the number of centroids and dimensions alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphlake.llm.common import discard, setting, written

#: Pivots at most, and the vectors (those of the smallest hashes) of whose clusters some of them are the means.
PIVOTS, POOL = 16, 512
#: Components up to this magnitude are 64-bit numbers throughout, larger ones Python's.
NARROW = 1 << 26
#: Bounds are lowered by this share of the distances they come from.
SLACK = 1e-12
#: Vectors in a batch.
BATCH = 4096


def kept_vectors(vectors: DataFrame, id_col: str, vector_col: str, dims: int) -> DataFrame:
    """(vec_id, x): rows whose vector has exactly ``dims`` components, none of them null or non-finite.

    A row without an id takes part but comes last among the starts.
    """
    kind = vectors.schema[vector_col].dataType.elementType.simpleString()
    x = F.col(vector_col) if kind in ("float", "double") else F.transform(F.col(vector_col), lambda e: e.cast("double"))
    picked = vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"))
    finite = F.forall("x", lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < float("inf")), F.lit(False)))
    return picked.where((F.size("x") == dims) & finite)


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as 64-bit numbers, or as Python's where one is beyond NARROW."""
    x = x.astype(np.float64)
    if np.abs(x).max(initial=0) * scale <= NARROW - 1:
        return np.floor(x * scale).astype(np.int64)
    exact = [math.floor(v * scale) if abs(v) < 2.0**53 else int(v) * scale for v in x.ravel().tolist()]
    out = np.empty(len(exact), object)
    out[:] = exact
    return out.reshape(x.shape)


def squared(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows to a point."""
    if rows.dtype != object and point.dtype == object:
        rows = rows.astype(object)
    gap = rows - point
    return (gap * gap).sum(1)


def roots(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64))


def pivot_table(rows: np.ndarray, pivots: list[np.ndarray]) -> np.ndarray:
    """Distances of the rows to all pivots, one row each."""
    return np.stack([roots(squared(rows, p)) for p in pivots], 1)


def nearest(rows: np.ndarray, table: np.ndarray, centroids: list[np.ndarray], across: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(number of the nearest centroid, squared distance, exact distances worked out) for every row.

    ``table`` has the rows' distances to the pivots, ``across`` the centroids'. Ties go to the smaller number.
    """
    n, k = len(rows), len(centroids)
    bounds = np.zeros((n, k))
    for p in range(table.shape[1]):
        mine, theirs = table[:, p, None], across[None, :, p]
        np.maximum(bounds, np.abs(mine - theirs) - SLACK * (mine + theirs), out=bounds)
    bounds = bounds * bounds * (1 - SLACK)
    first = bounds.argmin(1)
    best, which, done = np.empty(n, rows.dtype), first.copy(), n
    wide = any(c.dtype == object for c in centroids)
    if wide:
        best = best.astype(object)
    for c in np.unique(first):
        own = first == c
        best[own] = squared(rows[own], centroids[c])
    for c in range(k):
        near = np.flatnonzero((first != c) & (bounds[:, c] <= best.astype(np.float64)))
        if len(near):
            d = squared(rows[near], centroids[c])
            done += len(near)
            better = (d < best[near]) | ((d == best[near]) & (c < which[near]))
            best[near[better]], which[near[better]] = d[better], c
    return which, best, done


def means(points: np.ndarray, which: np.ndarray, centroids: list[np.ndarray]) -> list[np.ndarray]:
    """The centroids, those that have points moved to the floor of their mean."""
    return [points[which == c].sum(0) // int((which == c).sum()) if (which == c).any() else old for c, old in enumerate(centroids)]


def fixed_pivots(starts: list[np.ndarray], pool: np.ndarray, rounds: int, count: int) -> list[np.ndarray]:
    """Up to ``count`` different points far from each other, of the starts and of the means of a pool's clusters.

    The starts are where the centroids are in the first round and the pool's means near where they
    will be: a bound is as good as a pivot is near the centroid.
    """
    if not starts:
        return []
    moved = list(starts)
    for _ in range(rounds):
        moved = means(pool, np.stack([squared(pool, c) for c in moved], 1).argmin(1), moved)
    points = np.stack([*starts, *moved])
    picked, far = [0], roots(squared(points, points[0]))
    while len(picked) < count and far.max() > 0:
        picked.append(int(far.argmax()))
        far = np.minimum(far, roots(squared(points, points[picked[-1]])))
    return [points[i] for i in picked]


def _blocks(batch: pa.RecordBatch, dims: int, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in the batch, whole vectors), narrow and wide ones apart."""
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    narrow = np.abs(x).max(1, initial=0).astype(np.float64) * scale <= NARROW - 1
    for own in (narrow, ~narrow):
        if own.any():
            yield np.flatnonzero(own), whole(x[own], scale)


def _first(vectors: DataFrame, salt: str, count: int, scale: int) -> np.ndarray:
    """The ``count`` vectors with the smallest hash of the salt and their id, in that order."""
    order = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = vectors.orderBy(order.asc_nulls_last(), "x").limit(count).select("x").collect()  # bounded by count
    return whole(np.array([r.x for r in rows], np.float64), scale) if rows else np.zeros((0, 0), np.int64)


@dataclass
class Clustering:
    """What ``cluster`` found: assigned rows (vec_id, cluster, distance), centroids, rows of each, and the share of exact distances."""

    assigned: DataFrame
    centroids: list[np.ndarray]
    exact_share: float


def cluster(vectors: DataFrame, k: int, rounds: int, scale: int, dims: int, salt: str) -> Clustering:
    """k-means over (vec_id, x) of ``kept_vectors``, in whole numbers floor(scale * x).

    Centroids start as the k vectors with the smallest sha256 of ``salt`` and id (all vectors, if
    there are fewer; repeated ids in the order of their vectors). A round assigns every vector to the
    nearest centroid, ties to the smaller number, and replaces centroids that have vectors by the
    floor of the mean. Rounds end early only when no centroid moves, as all further ones would be
    the same. Sums beyond 38 digits and distances beyond 64 bits are errors. An empty table gives no
    centroids and no rows; repeated rows each count.
    """
    spark = vectors.sparkSession
    centroids = list(_first(vectors, salt, k, scale))
    pivots = fixed_pivots(centroids, _first(vectors, "pivot:", POOL, scale), rounds, PIVOTS)
    schema = f"vec_id long, x {vectors.schema['x'].dataType.simpleString()}, pivots array<double>"

    def with_pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = np.zeros((batch.num_rows, len(pivots)))
            for at, rows in _blocks(batch, dims, scale):
                table[at] = pivot_table(rows, pivots)
            ends = pa.array(np.arange(0, table.size + 1, len(pivots), np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, pa.array(table.ravel()))], ["vec_id", "x", "pivots"])

    def assigning(batches: Iterator[pa.RecordBatch], now: list[np.ndarray]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, int, list]]:
        across = np.stack([pivot_table(c[None, :], pivots)[0] for c in now])
        for batch in batches:
            if not batch.num_rows:
                continue
            table = batch.column("pivots").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(pivots))
            which, best, done, sums = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, object), 0, []
            for at, rows in _blocks(batch, dims, scale):
                which[at], best[at], n = nearest(rows, table[at], now, across)
                done += n
                sums += [(int(c), int((which[at] == c).sum()), rows[which[at] == c].sum(0)) for c in np.unique(which[at])]
            yield batch, which, best, done, sums

    def summing(now: list[np.ndarray]):
        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts, totals, exact = [0] * len(now), [np.zeros(dims, object) for _ in now], 0
            for _, _, _, done, sums in assigning(batches, now):
                exact += done
                for c, n, s in sums:
                    counts[c] += n
                    totals[c] = totals[c] + s.astype(object)
            used = [c for c, n in enumerate(counts) if n]
            columns = [pa.array(used, pa.int32()), pa.array([counts[c] for c in used], pa.int64()), pa.array([[str(v) for v in totals[c]] for c in used], pa.list_(pa.string())), pa.array([exact if c == used[0] else 0 for c in used], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["cluster", "n", "sums", "exact"])

        return kernel

    def labelling(now: list[np.ndarray]):
        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, which, best, _, _ in assigning(batches, now):
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(which.astype(np.int32)), pa.array(best.tolist(), pa.int64())], ["vec_id", "cluster", "distance"])

        return kernel

    done = "vec_id long, cluster int, distance long"
    if not centroids:
        return Clustering(spark.createDataFrame([], done), [], 0.0)
    exact = compared = 0
    with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH)):
        stored = written(vectors.mapInArrow(with_pivots, schema), "pivots")
        for _ in range(rounds):
            partial = stored.mapInArrow(summing(centroids), "cluster int, n long, sums array<string>, exact long")
            each = partial.select("cluster", "n", "exact", F.posexplode("sums").alias("dim", "s"))
            totals = each.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum("exact").alias("exact"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()  # k times dims rows
            moved = [list(c) for c in centroids]
            for r in totals:
                if r.s is None:
                    raise ArithmeticError("a sum of components is beyond 38 digits")
                moved[r.cluster][r.dim] = int(r.s) // r.n
            exact += sum(r.exact for r in totals if r.dim == 0)
            compared += sum(r.n for r in totals if r.dim == 0) * len(centroids)
            moved = [np.array(m, np.int64) if max(map(abs, m)) <= NARROW else np.array([int(v) for v in m], object) for m in moved]
            if all((a == b).all() for a, b in zip(moved, centroids, strict=True)):
                break
            centroids = moved
        assigned = written(stored.mapInArrow(labelling(centroids), done), "assigned")
    discard(stored)
    return Clustering(assigned, centroids, exact / compared if compared else 0.0)


def summary(found: Clustering) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 (of its components, joined by commas) of every vector."""
    spark = found.assigned.sparkSession
    sums = found.assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # a row for each centroid
    own = {r.cluster: int(r.s) for r in sums}
    hashes = [sha256(",".join(str(int(v)) for v in c).encode()).hexdigest() for c in found.centroids]
    rows = [(c, own[c], sum(own.values()), hashes[c]) for c in sorted(own)]
    stats = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.assigned.join(F.broadcast(stats), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle_sql(k: int, rounds: int, scale: int, dims: int, salt: str) -> str:
    """DuckDB SQL for the same rows: every round compares all vectors with all centroids."""
    space = "list_sum(list_transform(range(1, {d} + 1), lambda i: (v.e[i] - c.e[i]) * (v.e[i] - c.e[i])))".format(d=dims)
    ctes = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, embedding AS x, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, x) - 1 AS INTEGER) AS c, e FROM (SELECT sha256('{salt}' || CAST(vec_id AS VARCHAR)) AS h, x, e FROM v ORDER BY h NULLS LAST, x LIMIT {k}))",
    ]
    for n in range(rounds + 1):
        ctes.append(f"a{n} AS MATERIALIZED (SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT v.r, c.c, CAST({space} AS BIGINT) AS d FROM v CROSS JOIN c{n} c) GROUP BY r)")
        if n < rounds:
            total = f"t{n} AS MATERIALIZED (SELECT c, i, sum(q) AS s, count(*) AS m FROM (SELECT a.c, unnest(range(1, {dims} + 1)) AS i, unnest(v.e) AS q FROM a{n} a JOIN v USING (r)) GROUP BY c, i)"
            mean = f"m{n} AS MATERIALIZED (SELECT c, list(CAST((s - ((s % m) + m) % m) // m AS BIGINT) ORDER BY i) AS e FROM t{n} GROUP BY c)"
            ctes += [total, mean, f"c{n + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.e, o.e) AS e FROM c{n} o LEFT JOIN m{n} m USING (c))"]
    return (
        "WITH " + ",\n  ".join(ctes) + f"\nSELECT v.vec_id, a.c AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia, "
        f"sha256(array_to_string(o.e, ',')) AS centroid_sha256 FROM a{rounds} a JOIN v USING (r) JOIN c{rounds} o USING (c)"
    )
