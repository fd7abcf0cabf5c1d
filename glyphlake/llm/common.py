"""Shared pieces: durable intermediate tables, table readers and connected components."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphlake.sources.durable import discard, setting, written  # noqa: F401

#: Bytes of small Arrow batches that are handled together.
BATCH_BYTES = 8 << 20


@contextmanager
def short_batches(spark: SparkSession, rows: int = 500) -> Iterator[None]:
    """Within it, rows go to Python in batches of at most ``rows``: texts may be long, and a batch is held whole."""
    with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows)):
        yield


def gathered(batches: Iterator[pa.RecordBatch], least: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``least`` bytes or a little more: what is held is that and one batch as it comes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= least:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def connected_components(edges: DataFrame, name: str = "cc", most_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph as (node, component), the component being its smallest node.

    ``edges`` has two columns ``a`` and ``b`` of one comparable type; null ends and self loops are
    ignored and repeated edges do no harm. Alternates large-star and small-star steps: each step
    hangs the neighbours of a node on the smallest of them, so hubs shrink quickly, no step emits
    more rows than there are edges and nothing is gathered on the driver but one count a round.
    An empty graph gives an empty result.
    """
    links = (
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), F.col("a").isNotNull().alias("x"), F.col("b").isNotNull().alias("y"))
        .where("x and y and a > b")
        .select("a", "b")
        .distinct()
    )
    links = written(links, name)
    for _ in range(most_rounds):
        # Settled when every node has one parent at most and no parent has a parent.
        ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(links.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        open_ = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up > 0 and down > 0")
        if not open_.limit(1).count():
            break
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        own = least.where("m < a").select("a", F.col("m").alias("b"))
        large = large.unionByName(own).where("a > b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.withColumnRenamed("m", "b"))
        links, before = written(small.where("a > b").distinct(), name), links
        discard(before)
    else:
        raise RuntimeError(f"components not settled after {most_rounds} rounds")
    roots = links.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
