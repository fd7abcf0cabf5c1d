"""Operators on the boxes of a page: islands, filters, allocation, grouping, ordering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphlake.functions.scalars import half_up, upper_median, upper_quartile
from glyphlake.operators.graph import smallest_reachable
from glyphlake.operators.ownership import pixels_in_boxes
from glyphlake.sources.durable import shuffled


def _page():
    return W.partitionBy("page_id")


def islands(boxes: DataFrame) -> DataFrame:
    """(page_id, chunk, x0, x1, y0, y1, area): runs of boxes whose columns overlap, numbered from 0 from the left."""
    order = _page().orderBy("x0", "box_id")
    reach = F.max("x1").over(order.rowsBetween(W.unboundedPreceding, -1))
    opens = F.when(F.col("x0") <= reach, 0).otherwise(1)
    flagged = boxes.withColumn("opens", opens)
    numbered = flagged.withColumn("chunk", (F.sum("opens").over(order.rowsBetween(W.unboundedPreceding, 0)) - 1).cast("int"))
    return numbered.groupBy("page_id", "chunk").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.sum("area").alias("area"))


def median_heights(boxes: DataFrame) -> DataFrame:
    """(page_id, median_height): the upper median height, specks under 8 pixels aside unless there is nothing else."""
    heights = boxes.groupBy("page_id").agg(F.collect_list(F.col("y1") - F.col("y0") + 1).alias("h"))
    tall = F.filter("h", lambda h: h >= 8)
    return heights.select("page_id", upper_median(F.when(F.size(tall) > 0, tall).otherwise(F.col("h"))).alias("median_height"))


def without_debris(chunks: DataFrame) -> DataFrame:
    """Chunks of at least 15 percent of their page's upper-quartile area, on pages of three or more; all if none is."""
    upper = chunks.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), upper_quartile(F.collect_list("area")).alias("upper"))
    solid = F.col("area") >= F.col("upper") * 0.15
    judged = chunks.join(upper, "page_id").withColumn("solid", solid).withColumn("any", F.max("solid").over(_page()))
    return judged.where("n < 3 or solid or not any").drop("n", "upper", "solid", "any")


def on_baseline(boxes: DataFrame) -> DataFrame:
    """Boxes whose centre is within max(100, 3 median heights) of the page's median centre (upper medians)."""
    lists = boxes.groupBy("page_id").agg(F.collect_list((F.col("y0") + F.col("y1")) / 2).alias("c"), F.collect_list((F.col("y1") - F.col("y0") + 1).cast("double")).alias("h"))
    middle = lists.select("page_id", F.element_at(F.array_sort("c"), (F.floor(F.size("c") / 2) + 1).cast("int")).alias("centre"), F.greatest(F.lit(100.0), upper_median(F.col("h")) * 3).alias("reach"))
    return boxes.join(middle, "page_id").where(F.abs((F.col("y0") + F.col("y1")) / 2 - F.col("centre")) <= F.col("reach")).drop("centre", "reach")


def inside_page(boxes: DataFrame, width: int, height: int, least: int = 4) -> DataFrame:
    """Boxes of at least ``least`` pixels on both sides that stay clear of the page's frame."""
    return boxes.where(f"x1 - x0 + 1 >= {least} and y1 - y0 + 1 >= {least} and x0 > 1 and y0 > 1 and x1 < {width - 2} and y1 < {height - 2}")


def widest_gaps(chunks: DataFrame) -> DataFrame:
    """(page_id, chunk, gap): the chunk before which the widest gap of the page lies, the first of equal ones."""
    gaps = chunks.withColumn("gap", F.col("x0") - F.lag("x1").over(_page().orderBy("chunk"))).where("gap is not null")
    return gaps.withColumn("rn", F.row_number().over(_page().orderBy(F.desc("gap"), "chunk"))).where("rn = 1").select("page_id", "chunk", "gap")


def _quotients(chunks: DataFrame, totals: DataFrame) -> DataFrame:
    """(page_id, chunk, width, spare, k): the quotients width / k that may win one of the ``spare`` further characters of a page, one a chunk at least.

    With c chunks of W columns and t characters, quotients of at least W / (t + c) number t or more,
    as a chunk has less than one fewer of them than its share of t + c. Smaller ones cannot win, so a
    page lists t + 2c quotients at most and not t for each chunk.
    """
    sized = chunks.join(totals, "page_id").select("page_id", "chunk", (F.col("x1") - F.col("x0") + 1).alias("width"), "total")
    page = {"chunks": F.count(F.lit(1)), "all": F.sum("width"), "least": F.min("width")}
    sized = sized.select("*", *(total.over(_page()).alias(name) for name, total in page.items()))
    most = F.expr("if(least > 0, least(total - chunks, width * total div all), total - chunks)").cast("int")
    k = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), most)))
    return sized.select("page_id", "chunk", "width", (F.col("total") - F.col("chunks")).alias("spare"), k.alias("k"))


def allocated(chunks: DataFrame, totals: DataFrame) -> DataFrame:
    """(page_id, chunk, n): the page's ``total`` characters over its chunks.

    Each chunk has one; each further one goes to the chunk that is widest per character it has, the
    leftmost of equal ones. As a chunk of width w wins its k-th further character at w / k, the
    largest quotients of all chunks are what is handed out: one ranking in place of a loop.
    """
    ranked = _quotients(chunks, totals).withColumn("rn", F.row_number().over(_page().orderBy(F.desc(F.col("width") / F.col("k")), "chunk", "k")))
    won = (F.col("rn") <= F.col("spare")).cast("int")
    return ranked.groupBy("page_id", "chunk").agg((1 + F.sum(won)).cast("int").alias("n"))


def valley_slices(chunks: DataFrame, counts: DataFrame, ink: DataFrame, tile: int = 64) -> DataFrame:
    """(page_id, chunk, i, x0, y0, x1, y1, area): chunks of several characters cut where the least ink stands, near even places.

    ``counts`` (page_id, chunk, n) tells into how many. A cut is the column with the least ink of its
    chunk within 0.38 widths (2 columns at least) of its even place, the nearest and then the leftmost
    of equal ones. Slices are as large as their ink; those without ink go, but for a chunk of which
    nothing is left. Ink is looked at by columns, so that a chunk's pixels never come together.
    """
    many = chunks.join(counts, ["page_id", "chunk"]).where("n > 1").withColumn("width", F.col("x1") - F.col("x0") + 1)
    columns = pixels_in_boxes(ink, many.select("page_id", "chunk", "x0", "y0", "x1", "y1"), tile).groupBy("page_id", "chunk", "x").agg(F.count(F.lit(1)).alias("ink"), F.min("y").alias("low"), F.max("y").alias("high"))
    even = half_up(F.col("k") * (F.col("width") / F.col("n"))).cast("int")
    cuts = many.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n") - 1))).withColumn("even", even)
    around = F.greatest(F.lit(2), half_up(F.col("width") / F.col("n") * F.lit(0.38)).cast("int"))
    first, last = F.greatest(F.lit(1), F.col("even") - around), F.least(F.col("width") - 2, F.col("even") + around)
    tried = cuts.select("page_id", "chunk", "k", "even", "x0", F.when(first <= last, F.sequence(first, last)).otherwise(F.array("even")).alias("at")).withColumn("at", F.explode("at"))
    inked = tried.withColumn("x", F.col("x0") + F.col("at")).join(columns, ["page_id", "chunk", "x"], "left")
    cost = F.struct(F.coalesce("ink", F.lit(0)) * 1000 + F.abs(F.col("at") - F.col("even")), F.col("at"))
    best = inked.groupBy("page_id", "chunk", "k").agg(F.min_by("at", cost).alias("at"))
    bounds = best.groupBy("page_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("k", "at"))).alias("cuts"))
    whole = many.join(bounds, ["page_id", "chunk"]).withColumn("edges", F.concat(F.array(F.lit(0)), F.col("cuts.at"), F.array("width")))
    slices = whole.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select("page_id", "chunk", "i", (F.col("x0") + F.get("edges", F.col("i"))).alias("a"), (F.col("x0") + F.get("edges", F.col("i") + 1) - 1).alias("b"))
    filled = columns.join(slices, ["page_id", "chunk"]).where("x between a and b").groupBy("page_id", "chunk", "i").agg(F.min("x").cast("int").alias("x0"), F.min("low").alias("y0"), F.max("x").cast("int").alias("x1"), F.max("high").alias("y1"), F.sum("ink").alias("area"))
    bare = many.join(filled.select("page_id", "chunk").distinct(), ["page_id", "chunk"], "left_anti")
    return filled.unionByName(bare.select("page_id", "chunk", F.lit(0).alias("i"), "x0", "y0", "x1", "y1", "area"))


def _near_pairs(boxes: DataFrame, apart: str) -> DataFrame:
    """Pairs of boxes of a page, the second's columns named b_, that overlap along x or stand ``apart`` (a column of theirs) at most.

    Boxes are dealt to tiles along x as wide as the page's widest box and what may lie between, so that
    a box meets those of its own tile and the next one only: a full page is no square of its boxes.
    """
    widest = boxes.groupBy("page_id").agg(F.max(F.col("x1") - F.col("x0") + 1).alias("widest"))
    placed = boxes.join(shuffled(widest), "page_id").withColumn("tile", F.floor(F.col("x0") / (F.col("widest") + F.col(apart) + 1)).cast("int")).drop("widest")
    right = placed.select("page_id", *(F.col(c).alias(f"b_{c}") for c in ("box_id", "x0", "x1", "y0", "y1")), F.explode(F.array(F.col("tile") - 1, "tile", F.col("tile") + 1)).alias("tile"))
    return placed.join(shuffled(right), ["page_id", "tile"]).where("box_id < b_box_id").drop("tile")


def proximity_groups(boxes: DataFrame) -> DataFrame:
    """(page_id, group_id, x0, y0, x1, y1, area, n): boxes that meet once each is grown by 0.36 median heights (4 at least)."""
    median = boxes.groupBy("page_id").agg(upper_median(F.collect_list(F.col("y1") - F.col("y0") + 1)).alias("m"))
    grown = boxes.join(shuffled(median), "page_id").withColumn("grow", F.greatest(F.lit(4.0), F.col("m") * 0.36)).withColumn("apart", F.col("grow") * 2)
    meets = "least(x1, b_x1) - greatest(x0, b_x0) + 2 * grow >= 0 and least(y1, b_y1) - greatest(y0, b_y0) + 2 * grow >= 0"
    edges = _near_pairs(grown, "apart").where(meets).select("page_id", F.col("box_id").alias("a"), F.col("b_box_id").alias("b"))
    roots = smallest_reachable(boxes.select("page_id", F.col("box_id").alias("node")), edges).withColumnsRenamed({"node": "box_id", "root": "group_id"})
    return boxes.join(shuffled(roots), ["page_id", "box_id"]).groupBy("page_id", "group_id").agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.sum("area").alias("area"), F.count(F.lit(1)).alias("n")
    )


MERGE_RULES = """
 (least(y1 - y0, b_y1 - b_y0) + 1 < 0.5 * median_height and least(x1, b_x1) - greatest(x0, b_x0) + 1 > 0.5 * (least(x1 - x0, b_x1 - b_x0) + 1)
   and greatest(0, greatest(y0, b_y0) - least(y1, b_y1) - 1) < 0.8 * median_height)
 or (y1 - y0 < 0.5 * median_height and b_y1 - b_y0 < 0.5 * median_height and least(y1, b_y1) - greatest(y0, b_y0) + 1 > 0
   and greatest(0, greatest(x0, b_x0) - least(x1, b_x1) - 1) < 0.3 * median_height)
 or (least(x1, b_x1) - greatest(x0, b_x0) + 1 > 0 and least(y1, b_y1) - greatest(y0, b_y0) + 1 >= 0.6 * least(y1 - y0 + 1, b_y1 - b_y0 + 1)
   and greatest(x1, b_x1) - least(x0, b_x0) + 1 <= 1.6 * median_height)"""


def merge_candidates(boxes: DataFrame) -> DataFrame:
    """(page_id, a, b, dist): the closest pair of boxes of each page that are parts of one glyph.

    Parts are stacked (one of them small), or tiny marks side by side, or strokes whose boxes meet
    and whose union is letter-sized; the first pair in box order wins among equally close ones. Parts of
    one glyph stand no further apart along x than 0.3 median heights, so only near pairs are looked at.
    """
    gaps = "greatest(0, greatest(y0, b_y0) - least(y1, b_y1) - 1) + greatest(0, greatest(x0, b_x0) - least(x1, b_x1) - 1)"
    sized = boxes.join(median_heights(boxes), "page_id").withColumn("apart", F.col("median_height") * 0.3)
    found = _near_pairs(sized, "apart").where(MERGE_RULES).withColumn("dist", F.expr(gaps))
    rank = F.row_number().over(_page().orderBy("dist", "box_id", "b_box_id"))
    return found.withColumn("rn", rank).where("rn = 1").select("page_id", F.col("box_id").alias("a"), F.col("b_box_id").alias("b"), "dist")


def overridden(boxes: DataFrame, overrides: DataFrame, width: int, height: int) -> DataFrame:
    """Boxes with those of ``overrides`` (page_id, box_id, ox0, oy0, ox1, oy1) in their place, clamped and corners in order."""
    joined = boxes.join(overrides, ["page_id", "box_id"], "left")

    def side(own: str, one: str, other: str, pick, most: int):
        return F.when(F.col(one).isNull(), F.col(own)).otherwise(F.greatest(F.lit(0), F.least(F.lit(most), pick(F.col(one), F.col(other))))).cast("int").alias(own)

    return joined.select(
        "page_id", "box_id", side("x0", "ox0", "ox1", F.least, width - 1), side("y0", "oy0", "oy1", F.least, height - 1), side("x1", "ox0", "ox1", F.greatest, width - 1), side("y1", "oy0", "oy1", F.greatest, height - 1), F.col("ox0").isNotNull().alias("pinned")
    )


def hit(points: DataFrame, boxes: DataFrame, tile: int = 64) -> DataFrame:
    """(page_id, px, py, box_id): the smallest box of a page that holds a point, the first of equal ones."""
    sized = boxes.select("page_id", "box_id", "x0", "y0", "x1", "y1", ((F.col("x1") - F.col("x0") + 1) * (F.col("y1") - F.col("y0") + 1)).alias("size"))
    held = pixels_in_boxes(points.select("page_id", F.col("px").alias("x"), F.col("py").alias("y")).distinct(), sized, tile)
    return held.groupBy("page_id", F.col("x").alias("px"), F.col("y").alias("py")).agg(F.min_by("box_id", F.struct("size", "box_id")).alias("box_id"))


def grabbed_corner(points: DataFrame, boxes: DataFrame, radius: int) -> DataFrame:
    """(page_id, px, py, box_id, corner): corners nw, ne, sw, se of boxes within ``radius`` of a point along both axes.

    A corner is a small box around itself, so points find it by tiles of the radius's size.
    """
    corners = F.array(*(F.struct(F.lit(n).alias("corner"), F.col(x).alias("cx"), F.col(y).alias("cy")) for n, x, y in (("nw", "x0", "y0"), ("ne", "x1", "y0"), ("sw", "x0", "y1"), ("se", "x1", "y1"))))
    around = boxes.select("page_id", "box_id", F.explode(corners).alias("c")).select("page_id", "box_id", "c.corner", *((F.col(f"c.c{a}") + d * radius).alias(f"{a}{n}") for a in "xy" for n, d in ((0, -1), (1, 1))))
    placed = points.select("page_id", F.col("px").alias("x"), F.col("py").alias("y"))
    near = pixels_in_boxes(placed, around, 2 * radius + 1)
    return near.select("page_id", F.col("x").alias("px"), F.col("y").alias("py"), "box_id", "corner")
