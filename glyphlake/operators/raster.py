"""Thresholds, masks and morphology over sparse pixels (page_id, y, x[, gray]).

Pages are independent, so every plan is keyed by page_id: histograms are summed before the exchange
and masks stay sparse. Running sums go over the at most 256 bins of a page.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphlake.functions.scalars import half_up

#: Darkest share of a page that counts as ink where no threshold separates it, and the most that can be ink.
DARKEST, MOST_INK = 0.012, 0.35
#: Tiles that the background's blur reaches as its standard deviation.
SIGMA = 2


def histogram(gray: DataFrame) -> DataFrame:
    """(page_id, gray, n): pixels of every grey level that occurs."""
    return gray.groupBy("page_id", "gray").agg(F.count(F.lit(1)).alias("n"))


def _cumulative(hist: DataFrame) -> DataFrame:
    page = W.partitionBy("page_id")
    up_to = page.orderBy("gray").rowsBetween(W.unboundedPreceding, 0)
    return hist.select(
        "page_id", "gray", "n", F.sum("n").over(up_to).alias("below"), F.sum(F.col("gray") * F.col("n")).over(up_to).alias("mass"), F.sum("n").over(page).alias("total"), F.sum(F.col("gray") * F.col("n")).over(page).alias("total_mass")
    )


def otsu(hist: DataFrame) -> DataFrame:
    """(page_id, best): the level that separates a page best; the lowest of equal ones, 0 for a single level.

    Levels that do not occur leave the variance between the classes as it is, so the levels that do
    are enough.
    """
    c = _cumulative(hist).withColumn("above", F.col("total") - F.col("below"))
    mean_gap = F.expr("double(mass) / double(below) - double(total_mass - mass) / nullif(double(above), 0D)")
    scored = c.withColumn("gap", mean_gap).withColumn("between", F.when(F.col("above") > 0, F.expr("double(below) * double(above) * (gap * gap)")))
    rank = F.row_number().over(W.partitionBy("page_id").orderBy(F.desc_nulls_last("between"), "gray"))
    return scored.withColumn("rn", rank).where("rn = 1").select("page_id", F.when(F.col("between").isNull(), 0).otherwise(F.col("gray")).cast("int").alias("best"))


def quantile_level(hist: DataFrame, share: float = DARKEST) -> DataFrame:
    """(page_id, level): the first level at which the darkest share of a page is reached."""
    c = _cumulative(hist).where(F.col("below") >= F.ceil(F.col("total") * share))
    return c.groupBy("page_id").agg(F.min("gray").alias("level"))


def ink_fraction(hist: DataFrame, level: Column) -> Column:
    """Share of pixels darker than a level, as an aggregate over a page's bins."""
    return F.sum(F.when(F.col("gray") < level, F.col("n")).otherwise(0)) / F.sum("n")


def thresholds(hist: DataFrame, cap: int | None = None) -> DataFrame:
    """(page_id, threshold, lean_threshold) of the freehand path.

    The best separation within 50..200; if that calls over MOST_INK of the page ink, the darkest
    share within 55..90 instead. A cap overrides both and thins nothing.
    """
    joined = hist.join(otsu(hist), "page_id").join(quantile_level(hist), "page_id")
    clamped = F.greatest(F.lit(50), F.least(F.lit(200), F.col("best")))
    found = joined.groupBy("page_id").agg(F.first(clamped).alias("otsu"), F.first("level").alias("level"), ink_fraction(hist, clamped).alias("share"))
    fallback = F.greatest(F.lit(55), F.least(F.lit(90), F.col("level")))
    chosen = F.when(F.col("share") > MOST_INK, fallback).otherwise(F.col("otsu")).cast("int")
    if cap is not None:
        return found.select("page_id", F.lit(cap).alias("threshold"), F.lit(cap).alias("lean_threshold"))
    return found.select("page_id", chosen.alias("threshold"), F.greatest(F.lit(40), half_up(chosen * 0.55)).cast("int").alias("lean_threshold"))


def contrast_bounds(hist: DataFrame, tail: float = 0.01) -> DataFrame:
    """(page_id, lo, hi): the levels within which a page is stretched, a hundredth of the pixels on either side."""
    c = _cumulative(hist).withColumn("from_top", F.col("total") - F.col("below") + F.col("n"))
    return c.groupBy("page_id").agg(
        F.coalesce(F.min(F.when(F.col("below") >= F.col("total") * tail, F.col("gray"))), F.lit(0)).alias("lo"), F.coalesce(F.max(F.when(F.col("from_top") >= F.col("total") * tail, F.col("gray"))), F.lit(255)).alias("hi")
    )


def stretched(gray: DataFrame, bounds: DataFrame) -> DataFrame:
    """Pixels with their grey level stretched between the page's bounds."""
    level = half_up((F.col("gray") - F.col("lo")) * 255 / F.greatest(F.lit(1), F.col("hi") - F.col("lo")))
    return gray.join(bounds, "page_id").withColumn("gray", F.greatest(F.lit(0), F.least(F.lit(255), level)).cast("int")).drop("lo", "hi")


def tile_background(gray: DataFrame, tile: int) -> DataFrame:
    """(page_id, ty, tx, background, n): the mean level of every tile, rounded half up."""
    tiles = gray.groupBy("page_id", F.expr(f"y div {tile}").cast("int").alias("ty"), F.expr(f"x div {tile}").cast("int").alias("tx"))
    return tiles.agg(half_up(F.sum("gray") / F.count(F.lit(1))).cast("int").alias("background"), F.count(F.lit(1)).alias("n"))


def _stencil() -> list[tuple[int, int]]:
    """(offset, weight) of a Gaussian of SIGMA tiles, in whole 1024ths of its peak."""
    return [(o, w) for o in range(-3 * SIGMA, 3 * SIGMA + 1) if (w := int(1024 * math.exp(-o * o / (2 * SIGMA * SIGMA)) + 0.5))]


def blurred_tiles(tiles: DataFrame) -> DataFrame:
    """(page_id, ty, tx, background): tile levels (page_id, ty, tx, background) under a Gaussian of SIGMA tiles, rounded half up.

    Along x and then along y, as sums of whole numbers, so that the order of rows does not matter; at
    the page's edge the weights that are there count. A page's tiles are a full rectangle.
    """
    weights = F.array(*(F.struct(F.lit(o).alias("o"), F.lit(w).cast("long").alias("w")) for o, w in _stencil()))
    across = tiles.select("page_id", "ty", F.col("tx").alias("from_x"), F.col("background").cast("long").alias("level"), F.explode(weights).alias("k"))
    there = tiles.groupBy("page_id").agg(F.max("tx").alias("last_x"), F.max("ty").alias("last_y"))
    rows = across.join(there, "page_id").withColumn("tx", F.col("from_x") + F.col("k.o")).where("tx between 0 and last_x")
    rows = rows.groupBy("page_id", "ty", "tx", "last_y").agg(F.sum(F.col("level") * F.col("k.w")).alias("s"), F.sum("k.w").alias("w"))
    down = rows.withColumn("k", F.explode(weights)).withColumn("ty", F.col("ty") + F.col("k.o")).where("ty between 0 and last_y")
    sums = down.groupBy("page_id", "ty", "tx").agg(F.sum(F.col("s") * F.col("k.w")).alias("s"), F.sum(F.col("w") * F.col("k.w")).alias("w"))
    return sums.select("page_id", "ty", "tx", F.expr("int((2 * s + w) div (2 * w))").alias("background"))


def _surrounded(tiles: DataFrame) -> DataFrame:
    """(page_id, ty, tx, around): each tile with the levels of the nine tiles around and on it, by rows; beyond the page the nearest one's."""
    steps = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    offsets = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in steps))
    sent = tiles.withColumn("o", F.explode(offsets)).select("page_id", (F.col("ty") - F.col("o.dy")).alias("ty"), (F.col("tx") - F.col("o.dx")).alias("tx"), "o.dy", "o.dx", "background")
    name = {step: f"n{i}" for i, step in enumerate(steps)}
    found = sent.groupBy("page_id", "ty", "tx").agg(*(F.max(F.when((F.col("dy") == dy) & (F.col("dx") == dx), F.col("background"))).alias(name[dy, dx]) for dy, dx in steps))
    near = [F.coalesce(name[dy, dx], name[dy, 0], name[0, dx], name[0, 0]) for dy, dx in steps]
    return found.where(F.col(name[0, 0]).isNotNull()).select("page_id", "ty", "tx", F.array(*near).alias("around"))


def with_background(gray: DataFrame, tile: int) -> DataFrame:
    """Pixels with their local background: tile means, blurred, drawn out between the centres of the four nearest tiles.

    A pixel's own tile brings all levels that it can need, so pixels meet tiles in one join on equal
    keys. Shares are whole numbers of half pixels; the level is rounded half up.
    """
    keyed = gray.withColumn("ty", F.expr(f"y div {tile}").cast("int")).withColumn("tx", F.expr(f"x div {tile}").cast("int"))
    joined = keyed.join(_surrounded(blurred_tiles(tile_background(gray, tile))), ["page_id", "ty", "tx"])

    def reach(v: str) -> Column:  # half pixels from the tile's centre
        return F.expr(f"2 * {v} + 1 - {tile} - 2 * {tile} * t{v}")

    def share(d: Column, step: int) -> Column:
        return F.when(F.signum(d) == step, F.abs(d)).otherwise(0) if step else 2 * tile - F.abs(d)

    total = sum((share(reach("y"), dy) * share(reach("x"), dx) * F.col("around")[3 * (dy + 1) + dx + 1] for dy in (-1, 0, 1) for dx in (-1, 0, 1)), F.lit(0).cast("long"))
    return joined.withColumn("total", total).withColumn("background", F.expr(f"int((total + {2 * tile * tile}) div {4 * tile * tile})")).drop("ty", "tx", "around", "total")


def adaptive_ink(gray: DataFrame, tile: int, cap: int = 165, delta: int = 40) -> DataFrame:
    """Pixels darker than the cap and by delta than their local background."""
    return with_background(gray, tile).where((F.col("gray") < cap) & (F.col("gray") < F.col("background") - delta)).select("page_id", "y", "x")


def _neighbours(ink: DataFrame) -> DataFrame:
    offsets = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 0), (-1, 0), (1, 0), (0, -1), (0, 1))))
    return ink.select("page_id", "y", "x", F.explode(offsets).alias("o")).select("page_id", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"))


def dilated(ink: DataFrame, height: int, width: int) -> DataFrame:
    """Ink and its four neighbours on the page."""
    return _neighbours(ink).where((F.col("y").between(0, height - 1)) & (F.col("x").between(0, width - 1))).distinct()


def eroded(ink: DataFrame) -> DataFrame:
    """Ink whose four neighbours are ink; beyond the page there is none."""
    return _neighbours(ink).groupBy("page_id", "y", "x").agg(F.count(F.lit(1)).alias("n")).where("n = 5").select("page_id", "y", "x")


def closed(ink: DataFrame, height: int, width: int) -> DataFrame:
    """Dilation, then erosion: pinholes and gaps of one pixel are sealed."""
    return eroded(dilated(ink, height, width))


def with_weight(ink: DataFrame, weight: int, height: int, width: int) -> DataFrame:
    """Strokes grown (positive) or thinned (negative) by up to two pixels."""
    weight = max(-2, min(2, weight))
    for _ in range(abs(weight)):
        ink = dilated(ink, height, width) if weight > 0 else eroded(ink)
    return ink


def runs(ink: DataFrame) -> DataFrame:
    """(page_id, y, x0, x1): maximal horizontal runs of ink."""
    row = W.partitionBy("page_id", "y").orderBy("x")
    island = ink.withColumn("island", F.col("x") - F.row_number().over(row))
    return island.groupBy("page_id", "y", "island").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("island")


def column_profile(ink: DataFrame) -> DataFrame:
    """(page_id, x, n, prefix): ink of every inked column and of all columns up to it."""
    cols = ink.groupBy("page_id", "x").agg(F.count(F.lit(1)).alias("n"))
    return cols.withColumn("prefix", F.sum("n").over(W.partitionBy("page_id").orderBy("x").rowsBetween(W.unboundedPreceding, 0)))


def coverage_profile(boxes: DataFrame) -> DataFrame:
    """(page_id, x, n): how many boxes stand over every column from a page's first to its last one, where there are no pixels to count.

    Boxes are counted where they begin and end, not column by column; runs of columns are drawn out at the end.
    """
    ends = boxes.select("page_id", F.explode(F.array(F.struct(F.col("x0").alias("x"), F.lit(1).alias("d")), F.struct((F.col("x1") + 1).alias("x"), F.lit(-1).alias("d")))).alias("e"))
    steps = ends.groupBy("page_id", "e.x").agg(F.sum("e.d").alias("d"))
    page = W.partitionBy("page_id").orderBy("x")
    spans = steps.select("page_id", "x", F.sum("d").over(page.rowsBetween(W.unboundedPreceding, 0)).alias("n"), F.lead("x").over(page).alias("upto")).where("upto is not null")
    return spans.select("page_id", F.explode(F.sequence("x", F.col("upto") - 1)).alias("x"), "n")
