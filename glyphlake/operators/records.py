"""Records of a run: ids over all photos, labels by id, merged overrides, the audit's text and the glyph sheet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphlake.functions.scalars import nfc
from glyphlake.operators import dims
from glyphlake.operators.ownership import pixels_in_boxes
from glyphlake.operators.text import first_uses

#: Pages in one group of the running ids.
SPAN = 4096
#: Shares in thousandths beyond which a glyph is clipped, or noticed for its own or for foreign ink.
CLIPPED, NOTICED, FOREIGN = 20, 5, 100
#: Cells of the glyph sheet: how many in a row, their side, the place of baseline and caption.
COLUMNS, SIDE, BASELINE, CAPTION = 10, 120, 88, 112


def running_ids(boxes: DataFrame, order: str = "box_id") -> DataFrame:
    """``boxes`` with id, which runs on from 0 over all pages in their order.

    Pages' counts are summed within groups of pages and groups' counts over groups, so that no
    window sees more than a group's pages, a page's boxes or the table of groups.
    """
    sizes = boxes.groupBy("page_id").agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.expr(f"floor(page_id / {SPAN})"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    groups = sizes.groupBy("part").agg(F.sum("n").alias("m")).withColumn("base", F.coalesce(F.sum("m").over(before), F.lit(0)))
    within = W.partitionBy("part").orderBy("page_id").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.withColumn("above", F.coalesce(F.sum("n").over(within), F.lit(0))).join(groups, "part").select("page_id", (F.col("base") + F.col("above")).alias("above"))
    place = F.row_number().over(W.partitionBy("page_id").orderBy(order))
    return boxes.withColumn("place", place).join(offsets, "page_id").withColumn("id", (F.col("above") + F.col("place") - 1).cast("long")).drop("place", "above")


def labelled_boxes(boxes: DataFrame, labels: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """Boxes with ch, the composed label of their id, from labels (page_id, box_id, label).

    Null and empty labels, those of several code points and those outside ``allowed`` (ch) go; of
    boxes of one label on a page the first stays.
    """
    single = labels.select("page_id", "box_id", nfc(F.col("label")).alias("ch")).where("length(ch) = 1")
    if allowed is not None:
        single = single.join(allowed, "ch", "left_semi")
    return first_uses(boxes.join(single, ["page_id", "box_id"]), "box_id")


def merged_overrides(earlier: DataFrame, later: DataFrame) -> DataFrame:
    """(page_id, box_id, x0, y0, x1, y1, changed) of two maps of overrides: the later one wins, changed where it says something new."""
    sides = ("x0", "y0", "x1", "y1")
    old, new = (df.select("page_id", "box_id", F.struct(*sides).alias(name)) for df, name in ((earlier, "old"), (later, "new")))
    both = old.join(new, ["page_id", "box_id"], "full").withColumn("box", F.coalesce("new", "old"))
    changed = F.col("new").isNotNull() & ~F.col("new").eqNullSafe(F.col("old"))
    return both.select("page_id", "box_id", *(F.col("box")[s].alias(s) for s in sides), changed.alias("changed"))


def recounted(ink: DataFrame, boxes: DataFrame, tile: int) -> DataFrame:
    """(page_id, box_id, area): the ink in every box, counted anew; 0 where there is none."""
    counts = pixels_in_boxes(ink, boxes, tile).groupBy("page_id", "box_id").agg(F.count(F.lit(1)).alias("n"))
    return boxes.select("page_id", "box_id").join(counts, ["page_id", "box_id"], "left").select("page_id", "box_id", F.coalesce("n", F.lit(0)).alias("area"))


def extents(labelled: DataFrame, wanted: DataFrame) -> DataFrame:
    """(page_id, root, x0, y0, x1, y1) of the components that ``wanted`` (page_id, root) names."""
    own = labelled.join(wanted, ["page_id", "root"], "left_semi")
    return own.groupBy("page_id", "root").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))


def by_crop(glyphs: DataFrame, blobs: DataFrame) -> DataFrame:
    """Glyphs with the box of the crop that is their source; a glyph without one keeps its row."""
    return glyphs.join(blobs.withColumnRenamed("crop", "source"), "source", "left")


def _tenths(part: Column, whole: Column) -> Column:
    """100 * part / whole with one decimal, half up, in whole numbers; 0.0 of nothing."""
    n = F.coalesce(F.floor(F.try_divide(2000 * part + whole, 2 * whole)), F.lit(0))
    return F.concat(F.floor(n / 10).cast("string"), F.lit("."), (n % 10).cast("string"))


def report_lines(audited: DataFrame, pinned: DataFrame | None = None) -> DataFrame:
    """(page_id, box_id, place, line): noticed boxes by falling share of clipped ink, those of equal share by id.

    ``audited`` is the table of ``ownership.audit``; ``pinned`` (page_id, box_id) was set by hand.
    """
    every = F.col("kept_own") + F.col("kept_foreign")
    noticed = audited.where((F.col("missing") * 1000 >= NOTICED * F.col("owned")) & (F.col("owned") > 0) | (F.col("kept_foreign") * 1000 >= FOREIGN * every) & (every > 0))
    by_hand = F.lit(False)
    if pinned is not None:
        noticed = noticed.join(pinned.select("page_id", "box_id", F.lit(True).alias("by_hand")), ["page_id", "box_id"], "left")
        by_hand = F.coalesce("by_hand", F.lit(False))
    bad = F.col("missing") * 1000 > CLIPPED * F.col("owned")
    flag = F.when(bad & by_hand, "  (pinned by hand)").when(bad, "  <- clipped").otherwise("")
    share = [F.lpad(_tenths(F.col(part), whole), 5, " ") for part, whole in (("missing", F.col("owned")), ("kept_foreign", every))]
    line = F.concat(F.lit("  "), F.lpad(F.col("box_id").cast("string"), 2, " "), F.lit("  clipped "), share[0], F.lit("%  foreign "), share[1], F.lit("%"), flag)
    place = F.row_number().over(W.partitionBy("page_id").orderBy(F.desc("clipped"), "box_id"))
    return noticed.select("page_id", "box_id", place.alias("place"), line.alias("line"))


def report_head(audited: DataFrame, orphaned: DataFrame, pinned: DataFrame | None = None, absent: DataFrame | None = None) -> DataFrame:
    """(page_id, line, clean): the audit's first line for every page, and whether it passes.

    ``audited`` and ``orphaned`` are the tables of ``ownership.audit`` and ``orphans``, ``pinned``
    (page_id, box_id) was set by hand and is no defect, ``absent`` (page_id, ch) are characters that the
    font lacks. A page passes with no clipped box, at most a fiftieth of its ink ownerless and nothing
    absent. A page without ink has no orphans.
    """
    bad = F.col("missing") * 1000 > CLIPPED * F.col("owned")
    if pinned is not None:
        audited = audited.join(pinned.select("page_id", "box_id", F.lit(True).alias("by_hand")), ["page_id", "box_id"], "left")
        bad = bad & F.col("by_hand").isNull()
    counts = audited.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("bad")).join(orphaned.select("page_id", "orphan", "total"), "page_id", "left").na.fill(0)
    lacks = F.lit(None).cast("string")
    if absent is not None:
        listed = absent.groupBy("page_id").agg(F.array_join(F.array_sort(F.collect_set("ch")), " ").alias("lacks"))
        counts, lacks = counts.join(listed, "page_id", "left"), F.col("lacks")
    hundredths = F.coalesce(F.floor(F.try_divide(20_000 * F.col("orphan") + F.col("total"), 2 * F.col("total"))), F.lit(0))
    share = F.concat(F.floor(hundredths / 100).cast("string"), F.lit("."), F.lpad((hundredths % 100).cast("string"), 2, "0"))
    line = F.concat(F.format_string("%d glyphs | clipped %d | orphan ink %dpx (%s%%)", "n", "bad", "orphan", share), F.coalesce(F.concat(F.lit(" | MISSING FROM FONT: "), lacks), F.lit("")))
    clean = (F.col("bad") == 0) & (F.col("orphan") * 50 <= F.col("total")) & lacks.isNull()
    return counts.select("page_id", line.alias("line"), clean.alias("clean"))


def glyph_sheet(glyphs: DataFrame, order: str) -> DataFrame:
    """(page_id, ch, cx, cy, caption): cells of a sheet of ten glyphs a row, the space left out, and the caption's SVG text.

    With a column d of outlines there is one more, drawing: the SVG text of the outline on the cell's
    base line, nothing for a null or empty one.
    """
    shown = glyphs.where("ch <> ' '")
    i = F.row_number().over(W.partitionBy("page_id").orderBy(order)) - 1
    placed = shown.withColumn("i", i).withColumn("cx", F.expr(f"i % {COLUMNS} * {SIDE} + 10")).withColumn("cy", F.expr(f"int(i div {COLUMNS}) * {SIDE}"))
    escaped = F.replace(F.replace("ch", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    caption = F.format_string('<line x1="%d" y1="%d" x2="%d" y2="%d" stroke="#bbe"/><text x="%d" y="%d" font-size="12">%s</text>', "cx", F.col("cy") + BASELINE, F.col("cx") + SIDE - 20, F.col("cy") + BASELINE, "cx", F.col("cy") + CAPTION, escaped)
    columns = ["page_id", "ch", "cx", "cy", caption.alias("caption")]
    if "d" in glyphs.columns:
        drawing = F.format_string('<path transform="translate(%d,%d) scale(0.08,-0.08)" d="%s" fill="#111" fill-rule="evenodd"/>', F.col("cx") + 8, F.col("cy") + BASELINE, "d")
        columns.append(F.when(F.coalesce("d", F.lit("")) != "", drawing).otherwise("").alias("drawing"))
    return placed.select(*columns)


def glyph_fragment(d: Column, size: int) -> Column:
    """The SVG text of an outline on a tile of ``size`` pixels; nothing for a null or empty outline."""
    k, x, y = f"{size * 0.78 / dims.UPM:.4f}", f"{size * 0.11:.1f}", f"{size * 0.84:.1f}"
    mark = F.concat(F.lit(f'<path transform="translate({x},{y}) scale({k},-{k})" d="'), d, F.lit('" fill="#111" fill-rule="evenodd"/>'))
    return F.when(F.coalesce(d, F.lit("")) != "", mark).otherwise("")


def with_outline(glyphs: DataFrame, d_col: str = "d") -> DataFrame:
    """Glyphs that have an outline: what traced to nothing goes."""
    return glyphs.where(F.coalesce(F.trim(d_col), F.lit("")) != "")


def guide_box(w: Column, h: Column, y: Column) -> tuple[Column, Column]:
    """(y, height) of the guide for final consonants, 4.05 times as wide as high, in the middle of an area."""
    own = F.least(h, w / F.lit(4.05))
    return y + (h - own) / 2, own


def map_file(path: Column) -> Column:
    """The map file beside a worksheet: its name without extension and -map.txt."""
    return F.concat(F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", ""), F.lit("-map.txt"))
