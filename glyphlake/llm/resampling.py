"""Importance resampling towards a target: hashed n-gram features, gains of buckets, Gumbel scores.

A text's separators are collapsed to single spaces; a regular expression with a look-around at either
end is then run over it with overlapping matches, one pattern for each number of words, so that every
match's span is one feature, and the CRC of the spanned bytes gives its bucket. A document's features
are kept as counts of buckets. A bucket's gain compares its share in the target with its share in all
documents; a document's score is its gains' sum and a Gumbel number from a hash of its id, so that the
best scores are a sample without replacement in proportion to the weights.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from hashlib import sha256
from operator import methodcaller

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphlake.llm.common import discard, setting, written

#: Texts in a batch, and features whose CRC a task remembers.
BATCH, KNOWN = 256, 500_000
#: What a byte becomes: letters A to Z small, digits, small letters and all bytes beyond ASCII themselves, separators spaces.
FOLDED = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
#: A feature's bucket and how often it is there.
PAIR = np.dtype([("bucket", "<u4"), ("n", "<u4")])


def collapsed(text: str | None) -> bytes:
    """Words of the text in UTF-8, single spaces between them; null is empty."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").translate(FOLDED).split())


def patterns(least: int, most: int) -> list[regex.Pattern]:
    """For every number of words a pattern of which each overlapping match is a run of so many words."""
    return [regex.compile(rb"(?<![^ ])[^ ]++(?: [^ ]++){%d}(?![^ ])" % (n - 1)) for n in range(least, most + 1)]


class Buckets:
    """Counts of a text's features by bucket."""

    def __init__(self, least: int, most: int, buckets: int):
        self.patterns, self.buckets, self.known = patterns(least, most), buckets, {}

    def of(self, feature: bytes) -> int:
        got = self.known.get(feature)
        if got is None:
            if len(self.known) >= KNOWN:
                self.known.clear()
            got = self.known[feature] = zlib.crc32(feature) % self.buckets
        return got

    def count(self, words: bytes) -> np.ndarray:
        """(bucket, n) by bucket for a collapsed text."""
        found: Counter[bytes] = Counter()
        for p in self.patterns:
            found.update(map(methodcaller("group"), p.finditer(words, overlapped=True)))
        if not found:
            return np.zeros(0, PAIR)
        at = np.fromiter(map(self.of, found), np.int64, len(found))
        order = np.argsort(at, kind="stable")
        at, n = at[order], np.fromiter(found.values(), np.int64, len(found))[order]
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        out = np.empty(len(first), PAIR)
        out["bucket"], out["n"] = at[first], np.add.reduceat(n, first)
        return out


def features(docs: DataFrame, id_col: str | None, text_col: str, least: int = 1, most: int = 1, buckets: int = 10_000) -> DataFrame:
    """(id, n_words, n_features, pairs) of every row: its words, its features of ``least`` to ``most`` words and their counts by bucket.

    ``pairs`` are bytes of PAIR. A null text has none; without ``id_col`` the ids are null. Other
    columns are ignored and repeated rows each count.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Buckets(least, most, buckets)
        for batch in batches:
            texts = [collapsed(t) for t in batch.column("text").to_pylist()]
            found = [counter.count(t) for t in texts]
            words = pa.array([t.count(b" ") + 1 if t else 0 for t in texts], pa.int64())
            columns = [batch.column("id"), words, pa.array([int(f["n"].sum()) for f in found], pa.int64()), pa.array([f.tobytes() for f in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_words", "n_features", "pairs"])

    own = F.col(id_col).cast("long") if id_col else F.lit(None).cast("long")
    return docs.select(own.alias("id"), F.col(text_col).alias("text")).mapInArrow(kernel, "id long, n_words long, n_features long, pairs binary")


def bucket_counts(found: DataFrame, buckets: int) -> np.ndarray:
    """How many features of all rows are in each bucket; a task hands on one row for each bucket at most."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            pairs = np.frombuffer(b"".join(batch.column("pairs").to_pylist()), PAIR)
            np.add.at(total, pairs["bucket"], pairs["n"].astype(np.int64))
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], ["bucket", "n"])

    sums = found.select("pairs").mapInArrow(kernel, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in sums.collect():  # a row for each bucket
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's share in the target over that in the source, one feature added to every bucket."""
    buckets, s, t = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((float(b) + 1) * (s + buckets) / ((float(a) + 1) * (t + buckets)))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def gumbel(salt: str, doc_id: int | None) -> int:
    """floor(-1000 ln(-ln u)) for u in (0, 1) from the hash of salt and id; without an id, of the salt alone."""
    h = int(sha256(f"{salt}{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(found: DataFrame, gain: np.ndarray, salt: str) -> DataFrame:
    """(id, n_words, n_features, weight, score) for rows of ``features``."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = []
            for b in batch.column("pairs").to_pylist():
                pairs = np.frombuffer(b, PAIR)
                weights.append(int(gain[pairs["bucket"]] @ pairs["n"].astype(np.int64)))
            scores = [w + gumbel(salt, i) for w, i in zip(weights, batch.column("id").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "n_words", "n_features")), pa.array(weights, pa.int64()), pa.array(scores, pa.int64())], ["id", "n_words", "n_features", "weight", "score"])

    return found.mapInArrow(kernel, "id long, n_words long, n_features long, weight long, score long")


def ranked(rows: DataFrame) -> DataFrame:
    """The rows with their rank, 1 for the highest score, ties to the smaller id (none: last) and then to the place in the table.

    Rows are dealt by range, a part's rank begins after the rows of the parts before it; no task holds
    more than a part, whatever the number of equal scores.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.withColumn("_place", F.monotonically_increasing_id())
    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("_place")]
    dealt = written(placed.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "ranked")
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.select("_part", (F.sum("_size").over(W.orderBy("_part")) - F.col("_size")).alias("_before"))
    inside = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return dealt.withColumn("_inside", inside).join(before, "_part").withColumn("rank", (F.col("_before") + F.col("_inside")).cast("long")).drop("_place", "_part", "_inside", "_before")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, salt: str = "2024:", ngrams: tuple[int, int] = (1, 1), buckets: int = 10_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document of ``docs``; those that are not drawn have no rank.

    Of the N documents with ``least_words`` words or more, floor(percent * N / 100) are drawn. A null
    or empty text has no features and weight 0. Without any target text gains compare with an empty
    target. Repeated rows are documents of their own; empty tables give an empty result.
    """
    spark = docs.sparkSession
    with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH)):
        found = written(features(docs, id_col, text_col, *ngrams, buckets), "features")
        aim = bucket_counts(features(target, None, text_col, *ngrams, buckets), buckets)
        gain = gains(bucket_counts(found, buckets), aim)
        rows = written(scored(found, gain, salt), "scores")
    discard(found)
    open_ = F.col("n_words") >= least_words
    drawn = percent * rows.where(open_).count() // 100
    best = ranked(rows.where(open_)).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = rows.where(~open_).withColumn("rank", F.lit(None).cast("long"))
    return best.unionByName(rest).select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


def oracle_sql(percent: int, least_words: int, salt: str, buckets: int) -> str:
    """DuckDB SQL for the same rows with features of one word; CRCs are worked out byte by byte for every different word."""
    step = "CASE WHEN {x} & 1 = 1 THEN xor({x} >> 1, 3988292384) ELSE {x} >> 1 END"
    words = r"list_filter(regexp_split_to_array(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
    return f"""WITH entries AS (SELECT CAST(b AS BIGINT) AS b, CAST(b AS BIGINT) AS v, 0 AS k FROM range(256) r(b)),
  t1 AS (SELECT b, {step.format(x="v")} AS v FROM entries), t2 AS (SELECT b, {step.format(x="v")} AS v FROM t1), t3 AS (SELECT b, {step.format(x="v")} AS v FROM t2),
  t4 AS (SELECT b, {step.format(x="v")} AS v FROM t3), t5 AS (SELECT b, {step.format(x="v")} AS v FROM t4), t6 AS (SELECT b, {step.format(x="v")} AS v FROM t5),
  t7 AS (SELECT b, {step.format(x="v")} AS v FROM t6), t8 AS (SELECT b, {step.format(x="v")} AS v FROM t7),
  crc AS MATERIALIZED (SELECT list(v ORDER BY b) AS t FROM t8),
  d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {words.format(t="coalesce(text, '')")} AS w FROM documents),
  f AS MATERIALIZED (SELECT r, w, count(*) AS n FROM (SELECT r, unnest(w) AS w FROM d) GROUP BY r, w),
  g AS MATERIALIZED (SELECT w, count(*) AS n FROM (SELECT unnest({words.format(t="coalesce(text, '')")}) AS w FROM benchmark) GROUP BY w),
  h AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM f UNION SELECT w FROM g)),
  k AS MATERIALIZED (SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, CAST(len(x) // 2 AS BIGINT)), lambda i: CAST('0x' || substr(x, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))),
      lambda a, y: xor(a >> 8, t[CAST(xor(a & 255, y) + 1 AS BIGINT)])), 4294967295) % {buckets} AS b FROM h, crc),
  s AS (SELECT b, sum(n) AS n FROM f JOIN k USING (w) GROUP BY b), t AS (SELECT b, sum(n) AS n FROM g JOIN k USING (w) GROUP BY b),
  gain AS MATERIALIZED (SELECT b, CAST(floor(1000 * ln((CAST(coalesce(t.n, 0) + 1 AS DOUBLE)) * ((SELECT CAST(coalesce(sum(n), 0) AS DOUBLE) FROM s) + {buckets}) /
      ((CAST(coalesce(s.n, 0) + 1 AS DOUBLE)) * ((SELECT CAST(coalesce(sum(n), 0) AS DOUBLE) FROM t) + {buckets})))) AS BIGINT) AS gain FROM s FULL JOIN t USING (b)),
  own AS (SELECT r, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM f JOIN k USING (w) JOIN gain USING (b) GROUP BY r),
  scored AS (SELECT d.r, d.doc_id, len(d.w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) +
      CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{salt}' || CAST(d.doc_id AS VARCHAR)), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM d LEFT JOIN own USING (r)),
  best AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_words >= {least_words})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {percent} * (SELECT count(*) FROM best) // 100 THEN rank END AS rank FROM scored LEFT JOIN best USING (r)"""
