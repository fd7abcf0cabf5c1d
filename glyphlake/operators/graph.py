"""Connected components of ink and of boxes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphlake.operators.raster import runs
from glyphlake.sources.durable import kept, shuffled


#: Pages of more links than this are not gathered: their components are found by rounds of joins.
MOST_LINKS = 1 << 14


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of the nodes 0 to n - 1 the smallest one that it hangs together with by the links a to b."""
    root = np.arange(n)
    while True:
        low, then = np.minimum(root[a], root[b]), root.copy()
        for ends in (a, b, root[a], root[b]):
            np.minimum.at(then, ends, low)
        then = then[then]
        if (then == root).all():
            return root
        root = then


def _by_page(links: DataFrame) -> DataFrame:
    """(page_id, node, root) of all ends of links: a page's links come together, many pages are solved at once."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            if not len(lists):
                continue
            ends, page = lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            order = np.lexsort((ends, page))
            new = np.r_[True, (np.diff(page[order]) != 0) | (np.diff(ends[order]) != 0)]
            code = np.empty(len(ends), np.int64)
            code[order] = np.cumsum(new) - 1
            first = order[new]  # one place of every node, in order: the smallest code is the smallest node
            roots = least_labels(len(first), code[::2], code[1::2])
            yield pa.record_batch([batch.column(0).take(pa.array(page[first])), pa.array(ends[first]), pa.array(ends[first][roots])], names=["page_id", "node", "root"])

    listed = links.groupBy("page_id").agg(F.flatten(F.collect_list(F.array(F.col("a").cast("long"), F.col("b").cast("long")))).alias("ends"))
    return listed.mapInArrow(kernel, f"page_id {links.schema['page_id'].dataType.simpleString()}, node long, root long")


def smallest_reachable(nodes: DataFrame, edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """(page_id, node, root): the smallest node that hangs together with each node.

    ``edges`` (page_id, a, b) may name each link once; they join nodes of one page, so pages are solved
    each by itself. Those of very many links take rounds of joins over their nodes instead.
    """
    links = kept(edges.where("a <> b").select("page_id", "a", "b"), "links")
    wide = links.groupBy("page_id").count().where(F.col("count") > MOST_LINKS).select("page_id")
    if wide.limit(1).count():
        wide = kept(wide, "wide-pages")
        large = _by_rounds(nodes.join(wide, "page_id", "left_semi"), links.join(wide, "page_id", "left_semi"), most_rounds)
        labels = _by_page(links.join(wide, "page_id", "left_anti")).unionByName(large)
    else:
        labels = _by_page(links)
    root = F.coalesce(F.col("root").cast(nodes.schema["node"].dataType), "node").alias("root")
    return nodes.select("page_id", "node").join(shuffled(labels), ["page_id", "node"], "left").select("page_id", "node", root)


def _by_rounds(nodes: DataFrame, edges: DataFrame, most_rounds: int) -> DataFrame:
    """The same by rounds: each takes the smallest root among the neighbours and then that root's own root, so chains shorten by doubling."""
    links = kept(edges.select("page_id", "a", "b").unionByName(edges.select("page_id", F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links")
    now = kept(nodes.select("page_id", "node", F.col("node").alias("root")), "roots")
    for _ in range(most_rounds):
        seen = links.join(now.withColumnsRenamed({"node": "b"}), ["page_id", "b"]).groupBy("page_id", F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = now.join(seen, ["page_id", "node"], "left").select("page_id", "node", F.col("root").alias("old"), F.least("root", F.coalesce("near", "root")).alias("root"))
        jump = now.select("page_id", F.col("node").alias("root"), F.col("root").alias("far"))
        then = kept(step.join(jump, ["page_id", "root"], "left").select("page_id", "node", "old", F.least("root", F.coalesce("far", "root")).alias("root")), "roots")
        now = then.select("page_id", "node", "root")
        if not then.where("root < old").limit(1).count():
            return now
    raise RuntimeError(f"components not settled after {most_rounds} rounds")


def labelled_runs(ink: DataFrame) -> DataFrame:
    """(page_id, y, x0, x1, root): runs of ink with the first pixel, in raster order, of their 8-connected component.

    Runs touch if their rows are neighbours and their columns at most one apart; the graph has runs
    for nodes, which are far fewer than pixels.
    """
    own = kept(runs(ink).withColumn("node", F.col("y").cast("long") * (1 << 24) + F.col("x0")), "runs")
    below = own.select("page_id", (F.col("y") - 1).alias("y"), F.col("x0").alias("bx0"), F.col("x1").alias("bx1"), F.col("node").alias("b"))
    edges = own.join(below, ["page_id", "y"]).where("bx0 <= x1 + 1 and bx1 >= x0 - 1").select("page_id", F.col("node").alias("a"), "b")
    return own.join(smallest_reachable(own, edges), ["page_id", "node"]).drop("node")


def components(ink: DataFrame, min_area: int = 1) -> DataFrame:
    """(page_id, root, x0, y0, x1, y1, area) of every 8-connected component of at least min_area pixels."""
    size = F.sum(F.col("x1") - F.col("x0") + 1)
    return labelled_runs(ink).groupBy("page_id", "root").agg(F.min("x0").alias("x0"), F.min("y").alias("y0"), F.max("x1").alias("x1"), F.max("y").alias("y1"), size.alias("area")).where(F.col("area") >= min_area)


def labelled_pixels(ink: DataFrame) -> DataFrame:
    """(page_id, y, x, root) of every ink pixel."""
    return labelled_runs(ink).select("page_id", "y", F.explode(F.sequence("x0", "x1")).alias("x"), "root")
