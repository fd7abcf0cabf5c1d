"""Which box owns which ink: range joins, owners, crops, audits and proposals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphlake.sources.durable import kept, shuffled


def pixels_in_boxes(pixels: DataFrame, boxes: DataFrame, tile: int) -> DataFrame:
    """Every pixel with every box that holds it: boxes are dealt to the tiles they touch, so the join has an equal key.

    Both sides need page_id; pixels y and x, boxes x0, y0, x1 and y1. A pixel lies in one tile and a
    box is listed once a tile, so no pair comes twice.
    """
    across, down = (F.sequence(F.floor(F.col(f"{a}0") / tile).cast("int"), F.floor(F.col(f"{a}1") / tile).cast("int")) for a in "xy")
    dealt = boxes.withColumn("tx", F.explode(across)).withColumn("ty", F.explode(down))
    placed = pixels.withColumn("tx", F.floor(F.col("x") / tile).cast("int")).withColumn("ty", F.floor(F.col("y") / tile).cast("int"))
    return placed.join(shuffled(dealt), ["page_id", "tx", "ty"]).where("x between x0 and x1 and y between y0 and y1").drop("tx", "ty")


def tallies(labelled: DataFrame, boxes: DataFrame, tile: int) -> DataFrame:
    """(page_id, root, box_id, here): pixels of each component in each box."""
    return pixels_in_boxes(labelled, boxes, tile).groupBy("page_id", "root", "box_id").agg(F.count(F.lit(1)).alias("here"))


def owners(tally: DataFrame) -> DataFrame:
    """(page_id, root, owner): the box that holds most of a component, the first of equal ones."""
    rank = F.row_number().over(W.partitionBy("page_id", "root").orderBy(F.desc("here"), "box_id"))
    return tally.withColumn("rn", rank).where("rn = 1").select("page_id", "root", F.col("box_id").alias("owner"))


def areas(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("page_id", "root").agg(F.count(F.lit(1)).alias("area"))


def keep_rule(tally: DataFrame, labelled: DataFrame, by_owner: bool = True) -> DataFrame:
    """(page_id, root, box_id, here, area, kept): whether a component's ink in a box belongs in the box's crop.

    Specks under 0.5 percent of the box's largest part go. With owners, what the box owns stays, and
    of others' what lies in it by a quarter; without owners, what lies in it by half.
    """
    joined = tally.join(shuffled(areas(labelled)), ["page_id", "root"])
    main = F.max("here").over(W.partitionBy("page_id", "box_id"))
    solid = F.col("here") >= 0.005 * main
    if not by_owner:
        return joined.withColumn("kept", solid & (F.col("here") >= 0.5 * F.col("area")))
    owned = joined.join(shuffled(owners(tally)), ["page_id", "root"])
    return owned.withColumn("kept", solid & ((F.col("owner") == F.col("box_id")) | (F.col("here") >= 0.25 * F.col("area")))).drop("owner")


def beyond_seams(x: Column, y: Column, y0: Column, left: Column, right: Column) -> Column:
    """Whether a pixel lies left of the left seam or on or right of the right one, where they reach its row."""
    row = (y - y0).cast("int")

    def at(seam: Column) -> Column:
        return F.when(seam.isNotNull() & (row >= 0) & (row < F.size(seam)), F.get(seam, row))

    return F.coalesce(x < at(left), F.lit(False)) | F.coalesce(x >= at(right), F.lit(False))


def cell_shares(pixels: DataFrame) -> DataFrame:
    """(page_id, cell, root, here, first): pixels of each component in each cell, and where it is first met, for (page_id, cell, y, x, root)."""
    return pixels.groupBy("page_id", "cell", "root").agg(F.count(F.lit(1)).alias("here"), F.min(F.struct("cell", "y", "x")).alias("first"))


def dominant(shares: DataFrame, least: float = 0.6) -> DataFrame:
    """(page_id, cell, root): each cell's largest component, if ``least`` of what all cells of the page have of it is there.

    Of equally large ones the one counts that is met first, by cells, rows and columns.
    """
    page = W.partitionBy("page_id", "root")
    met = shares.withColumn("first", F.min("first").over(page)).withColumn("total", F.sum("here").over(page))
    rank = F.row_number().over(W.partitionBy("page_id", "cell").orderBy(F.desc("here"), "first"))
    return met.withColumn("rn", rank).where((F.col("rn") == 1) & (F.col("here") >= F.col("total") * F.lit(least))).select("page_id", "cell", "root")


def extended(cells: DataFrame, mains: DataFrame, reach: DataFrame) -> DataFrame:
    """Cells with their boxes grown over the whole of their dominant component, and the box before in the column core.

    ``mains`` (page_id, cell, root) comes from ``dominant``, ``reach`` (page_id, root, ex0, ey0, ex1,
    ey1) has the extents of components over their whole page. Order is to be judged on the core:
    grown boxes of neighbouring lines overlap.
    """
    grown = cells.join(shuffled(mains), ["page_id", "cell"], "left").join(shuffled(reach), ["page_id", "root"], "left")
    sides = {"x0": F.least("x0", "ex0"), "y0": F.least("y0", "ey0"), "x1": F.greatest("x1", "ex1"), "y1": F.greatest("y1", "ey1")}  # nulls are passed over
    return grown.withColumn("core", F.struct("x0", "y0", "x1", "y1")).withColumns(sides).drop("root", "ex0", "ey0", "ex1", "ey1")


def crop_pixels(labelled: DataFrame, boxes: DataFrame, tile: int, by_owner: bool = True, every: bool = False) -> DataFrame:
    """(page_id, box_id, y, x, root): the ink that each box's crop keeps.

    ``every`` keeps all ink of the box, as printed sheets and Latin pages do. Boxes may carry
    seam_y0, seam_left and seam_right; ink beyond a seam goes unless the box owns it.
    """
    inside = pixels_in_boxes(labelled, boxes, tile)
    if every:
        return inside.select("page_id", "box_id", "y", "x", "root")
    tally = inside.groupBy("page_id", "root", "box_id").agg(F.count(F.lit(1)).alias("here"))
    rule = keep_rule(tally, labelled, by_owner).where("kept").select("page_id", "root", "box_id")
    out = inside.join(shuffled(rule), ["page_id", "root", "box_id"])
    if "seam_left" in boxes.columns:
        out = out.join(shuffled(owners(tally)), ["page_id", "root"])
        out = out.where((F.col("owner") == F.col("box_id")) | ~beyond_seams(F.col("x"), F.col("y"), F.col("seam_y0"), F.col("seam_left"), F.col("seam_right")))
    return out.select("page_id", "box_id", "y", "x", "root")


def audit(labelled: DataFrame, boxes: DataFrame, tile: int) -> DataFrame:
    """(page_id, box_id, owned, kept_own, kept_foreign, missing, clipped, foreign): how much of its own ink each crop keeps.

    Pixels meet boxes once, for the tally; what crops keep follows from its counts. Only where boxes
    carry seams, which cut components, the crops' pixels are counted.
    """
    tally = kept(tallies(labelled, boxes, tile), "tally")
    own = owners(tally)
    sizes = areas(labelled).join(own, ["page_id", "root"]).groupBy("page_id", F.col("owner").alias("box_id")).agg(F.sum("area").alias("owned"))
    if "seam_left" in boxes.columns:
        held = crop_pixels(labelled, boxes, tile).withColumn("here", F.lit(1))
    else:
        held = keep_rule(tally, labelled).where("kept").select("page_id", "root", "box_id", "here")
    mine = F.col("owner") == F.col("box_id")
    sums = (F.sum(F.when(rule, F.col("here")).otherwise(0)).alias(n) for n, rule in (("kept_own", mine), ("kept_foreign", ~mine)))
    counts = held.join(own, ["page_id", "root"]).groupBy("page_id", "box_id").agg(*sums)
    rows = boxes.select("page_id", "box_id").join(shuffled(sizes), ["page_id", "box_id"], "left").join(shuffled(counts), ["page_id", "box_id"], "left").na.fill(0)
    missing = F.col("owned") - F.col("kept_own")
    share = F.coalesce(F.try_divide(missing, F.col("owned")), F.lit(0.0))
    foreign = F.coalesce(F.try_divide(F.col("kept_foreign"), F.col("kept_own") + F.col("kept_foreign")), F.lit(0.0))
    return rows.select("*", missing.alias("missing"), share.alias("clipped"), foreign.alias("foreign"))


def orphans(labelled: DataFrame, boxes: DataFrame, tile: int) -> DataFrame:
    """(page_id, orphan, total, share): ink of components that no box owns."""
    joined = areas(labelled).join(shuffled(owners(tallies(labelled, boxes, tile))), ["page_id", "root"], "left")
    sums = joined.groupBy("page_id").agg(F.coalesce(F.sum(F.when(F.col("owner").isNull(), F.col("area"))), F.lit(0)).alias("orphan"), F.sum("area").alias("total"))
    return sums.withColumn("share", F.coalesce(F.try_divide("orphan", "total"), F.lit(0.0)))


def proposals(labelled: DataFrame, boxes: DataFrame, tile: int) -> DataFrame:
    """(page_id, box_id, x0, y0, x1, y1): boxes that must grow, and never shrink, to hold all ink they own."""
    own = kept(owners(tallies(labelled, boxes, tile)), "owners")
    reach = labelled.join(own, ["page_id", "root"]).groupBy("page_id", F.col("owner").alias("box_id")).agg(F.min("x").alias("ex0"), F.min("y").alias("ey0"), F.max("x").alias("ex1"), F.max("y").alias("ey1"))
    grown = boxes.join(shuffled(reach), ["page_id", "box_id"])
    new = grown.select("page_id", "box_id", F.least("x0", "ex0").alias("x0"), F.least("y0", "ey0").alias("y0"), F.greatest("x1", "ex1").alias("x1"), F.greatest("y1", "ey1").alias("y1"), (F.col("ex0") < F.col("x0")).alias("l"), (F.col("ey0") < F.col("y0")).alias("t"), (F.col("ex1") > F.col("x1")).alias("r"), (F.col("ey1") > F.col("y1")).alias("b"))
    return new.where("l or t or r or b").drop("l", "t", "r", "b")
