"""Sheets, text lines and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphlake.functions.scalars import half_up, is_hangul
from glyphlake.operators import dims

WORD_SPACE, UNKNOWN_ADVANCE, BEARING = 300, 500, 50


def sheet_places(item: Column) -> list[Column]:
    """(page, row, col) of the item-th cell of a printed sheet, all from 0."""
    return [F.floor(item / dims.PER_PAGE).cast("int").alias("page"), F.floor(item % dims.PER_PAGE / dims.COLUMNS).cast("int").alias("row"), (item % dims.COLUMNS).cast("int").alias("col")]


def cell_rectangles(places: DataFrame) -> DataFrame:
    """Rows with width, height, row and col get the pixels x0, y0, x1 and y1 of that cell in a photo of a sheet."""
    cw, ch = (dims.A4_WIDTH - 2 * dims.MARGIN) / dims.COLUMNS, (dims.A4_HEIGHT - 2 * dims.MARGIN - dims.HEADER) / dims.ROWS
    sx, sy = F.col("width") / dims.A4_WIDTH, F.col("height") / dims.A4_HEIGHT
    left, top = dims.MARGIN + F.col("col") * cw, dims.MARGIN + dims.HEADER + F.col("row") * ch
    sides = {"x0": left * sx, "y0": top * sy, "x1": (left + cw - dims.INSET) * sx, "y1": (top + ch - dims.INSET) * sy}
    return places.withColumns({k: half_up(v).cast("int") for k, v in sides.items()})


def captured_cells(ink: DataFrame, photos: DataFrame, items: DataFrame) -> DataFrame:
    """(item, page, x0, y0, x1, y1, area, clipped): the ink of every cell of printed sheets; clipped names the sides it touches.

    photos is (page, width, height), items (item), ink (page, y, x). A pixel's cell is computed from
    where it lies, so the join is on equal keys. Cells without ink have null boxes.
    """
    cells = cell_rectangles(items.select("item", *sheet_places(F.col("item"))).join(photos, "page"))
    cells = cells.withColumnsRenamed({"x0": "cx0", "y0": "cy0", "x1": "cx1", "y1": "cy1"})
    cw, ch = (dims.A4_WIDTH - 2 * dims.MARGIN) / dims.COLUMNS, (dims.A4_HEIGHT - 2 * dims.MARGIN - dims.HEADER) / dims.ROWS
    keyed = ink.join(photos, "page")
    near_col, near_row = (F.col("x") * dims.A4_WIDTH / F.col("width") - dims.MARGIN) / cw, (F.col("y") * dims.A4_HEIGHT / F.col("height") - dims.MARGIN - dims.HEADER) / ch
    around = F.array(*(F.struct(F.floor(near_row + dr).cast("int").alias("row"), F.floor(near_col + dc).cast("int").alias("col")) for dr in (-0.02, 0.02) for dc in (-0.02, 0.02)))
    keyed = keyed.select("page", "y", "x", F.explode(F.array_distinct(around)).alias("p")).select("page", "y", "x", "p.row", "p.col")
    held = keyed.join(cells.drop("width", "height"), ["page", "row", "col"]).where("x >= cx0 and x < cx1 and y >= cy0 and y < cy1")
    found = held.groupBy("item").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.count(F.lit(1)).alias("area"))
    joined = cells.join(found, "item", "left")
    touched = F.array(F.when(F.expr("y0 - cy0 <= 2"), "top"), F.when(F.expr("cy1 - 1 - y1 <= 2"), "bottom"), F.when(F.expr("x0 - cx0 <= 2"), "left"), F.when(F.expr("cx1 - 1 - x1 <= 2"), "right"))
    return joined.select("item", "page", "x0", "y0", "x1", "y1", "area", F.filter(touched, lambda s: s.isNotNull()).alias("clipped"))


def with_bands(glyphs: DataFrame, bands: DataFrame) -> DataFrame:
    """Glyphs with bottom and top of their character's band; the cap height for Hangul and unlisted ones."""
    joined = glyphs.join(F.broadcast(bands), "ch", "left")
    plain = is_hangul(F.col("ch"))
    return joined.withColumn("bottom", F.when(plain, dims.DEFAULT_BAND[0]).otherwise(F.coalesce("bottom", F.lit(dims.DEFAULT_BAND[0])))).withColumn("top", F.when(plain, dims.DEFAULT_BAND[1]).otherwise(F.coalesce("top", F.lit(dims.DEFAULT_BAND[1]))))


def placement(banded: DataFrame) -> DataFrame:
    """Adds scale, dx, dy and advance that bring ink of ink_w by ink_h pixels into the em: y up, the baseline at 0.

    Latin is scaled by its height between side bearings; a Hangul block is fitted into a square.
    """
    size = F.col("top") - F.col("bottom")
    square = size / F.greatest("ink_w", "ink_h")
    block = is_hangul(F.col("ch"))
    scale = F.when(block, square).otherwise(size / F.col("ink_h"))
    out = banded.withColumn("scale", scale)
    return out.withColumns(
        {
            "dx": F.when(block, (dims.UPM - F.col("ink_w") * F.col("scale")) / 2).otherwise(float(BEARING)),
            "dy": F.when(block, F.col("bottom") + (size - F.col("ink_h") * F.col("scale")) / 2 + F.col("ink_h") * F.col("scale")).otherwise(F.col("top").cast("double")),
            "advance": F.when(block, dims.UPM).otherwise(half_up(2 * BEARING + F.col("ink_w") * F.col("scale"))).cast("int"),
        }
    )


def pen_positions(chars: DataFrame, advances: DataFrame) -> DataFrame:
    """(line_id, ordinal, ch, pen): where each character of a line starts, in font units."""
    known = chars.join(advances, "ch", "left")
    step = F.coalesce("advance", F.when(F.col("ch") == " ", WORD_SPACE).otherwise(UNKNOWN_ADVANCE))
    before = W.partitionBy("line_id").orderBy("ordinal").rowsBetween(W.unboundedPreceding, -1)
    return known.select("line_id", "ordinal", "ch", F.coalesce(F.sum(step).over(before), F.lit(0)).alias("pen"))


def word_widths(text: Column, advances: dict[str, int]) -> Column:
    """Array of (word, width) of a text's words."""
    table = F.create_map(*(x for k, v in sorted(advances.items()) for x in (F.lit(k), F.lit(v))))
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.transform(words, lambda w: F.struct(w.alias("word"), F.aggregate(F.filter(F.split(w, ""), lambda c: c != ""), F.lit(0), lambda s, c: s + F.coalesce(F.element_at(table, c), F.lit(UNKNOWN_ADVANCE))).alias("width")))


def wrapped(words: Column, most: int | Column) -> Column:
    """Array of (line, words, width): words set greedily into lines of at most ``most`` units, one word at least."""
    start = F.expr("cast(array() as array<struct<line: int, words: int, width: int>>)")

    def add(lines: Column, w: Column) -> Column:
        last = F.element_at(lines, -1)
        fits = (F.size(lines) > 0) & (F.try_element_at(lines, F.lit(-1))["width"] + WORD_SPACE + w["width"] <= most)
        grown = F.concat(F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0))), F.array(F.struct(last["line"].alias("line"), (last["words"] + 1).alias("words"), (last["width"] + WORD_SPACE + w["width"]).alias("width"))))
        fresh = F.concat(lines, F.array(F.struct(F.size(lines).alias("line"), F.lit(1).alias("words"), w["width"].alias("width"))))
        return F.when(fits, grown).otherwise(fresh)

    return F.aggregate(words, start, add)


def sheet_of_review(place: Column, per_sheet: int = 7) -> Column:
    return F.floor(place / per_sheet).cast("int")


#: The preview's sizes in pixels, its width and margin; the line's feed before, between and after lines, in tenths of the size.
SIZES, SHEET_WIDTH, MARGIN = (64, 40, 28, 18), 1280, 40
BEFORE, FEED, AFTER = 11, 14, 4


def drawn_words(texts: DataFrame, glyphs: DataFrame) -> DataFrame:
    """(page_id, words): the words (word, width, marks) of texts (page_id, text), with the pen at and the outline d of every mark.

    ``glyphs`` is (ch, d, advance), one row a character. Only the different characters of a page meet
    them; its words stay together as a list, and nothing larger. Pages without words go.
    """
    words = F.transform(F.filter(F.split("text", r"\s+"), lambda w: w != ""), lambda w, i: F.struct(i.alias("i"), w.alias("word")))
    listed = texts.select("page_id", words.alias("words")).groupBy("page_id").agg(F.array_sort(F.flatten(F.collect_list("words"))).alias("words")).where("size(words) > 0")
    chars = listed.select("page_id", F.explode(F.array_distinct(F.split(F.array_join("words.word", ""), ""))).alias("ch"))
    known = chars.join(glyphs, "ch").groupBy("page_id").agg(F.map_from_entries(F.collect_list(F.struct("ch", F.struct("advance", "d")))).alias("known"))

    def drawn(word: Column) -> Column:
        met = F.transform(F.filter(F.split(word, ""), lambda c: c != ""), lambda c: F.try_element_at(F.col("known"), c))
        begin = F.struct(word.alias("word"), F.lit(0).alias("width"), F.expr("cast(array() as array<struct<at: int, d: string>>)").alias("marks"))
        mark = lambda s, g: F.when(g["d"] != "", F.concat(s["marks"], F.array(F.struct(s["width"].alias("at"), g["d"].alias("d"))))).otherwise(s["marks"])
        return F.aggregate(met, begin, lambda s, g: F.struct(s["word"].alias("word"), (s["width"] + F.coalesce(g["advance"].cast("int"), F.lit(UNKNOWN_ADVANCE))).alias("width"), mark(s, g).alias("marks")))

    whole = listed.join(known, "page_id", "left").select("page_id", F.transform("words", lambda w: drawn(w["word"])).alias("words"))
    # The words are behind a generator: the optimiser would move them into the functions that read them, to be drawn for every element.
    return whole.select("page_id", F.inline(F.array(F.struct("words"))))


def fixed(value: Column, decimals: int) -> Column:
    """A whole number of tenths, hundredths and so on, with so many decimals."""
    unit = 10**decimals
    return F.concat(F.when(value < 0, "-").otherwise(""), F.floor(F.abs(value) / unit).cast("string"), F.lit("."), F.lpad((F.abs(value) % unit).cast("string"), decimals, "0"))


def waterfall(texts: DataFrame, glyphs: DataFrame, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """(page_id, svg): every page's text as outlines in every size, for glyphs (ch, d, advance).

    Words are set greedily within the sheet's width. Characters without a glyph leave their room,
    glyphs without an outline theirs; pages without words have no sheet. A sheet is put together in
    its page's row: outlines, which take the room of the text's characters times the sizes, are never
    moved.
    """

    def marks(words: Column, size: int, y: Column) -> Column:
        """The marks of a line's words, whose base line is the text y."""
        k = f"{size / 1000:.4f}"
        x = lambda pen: fixed(F.floor((F.lit(1000 * MARGIN + 50) + pen.cast("long") * size) / 100), 1)
        mark = lambda pen, d: F.concat(F.lit('<path transform="translate('), x(pen), F.lit(","), y, F.lit(f') scale({k},-{k})" d="'), d, F.lit('" fill="#111" fill-rule="evenodd"/>'))
        begin = F.struct(F.lit(0).alias("pen"), F.expr("cast(array() as array<string>)").alias("marks"))
        add = lambda s, w: F.struct((s["pen"] + w["width"] + WORD_SPACE).alias("pen"), F.concat(s["marks"], F.transform(w["marks"], lambda m: mark(s["pen"] + m["at"], m["d"]))).alias("marks"))
        return F.aggregate(words, begin, add, lambda s: F.array_join(s["marks"], ""))

    def body(lines: Column, size: int, top: Column) -> Column:
        """All lines of a size, the first of which begins at ``top``, in tenths of a pixel."""
        begin = F.struct(F.lit(0).alias("first"), F.expr("cast(array() as array<string>)").alias("lines"))
        based = F.transform(lines, lambda l: F.struct(l["words"].alias("words"), fixed(top + size * (BEFORE + FEED * l["line"]), 1).alias("y")))
        add = lambda s, l: F.struct((s["first"] + l["words"]).alias("first"), F.concat(s["lines"], F.array(marks(F.slice("words", s["first"] + 1, l["words"]), size, l["y"]))).alias("lines"))
        return F.aggregate(based, begin, add, lambda s: F.array_join(s["lines"], ""))

    most = [(SHEET_WIDTH - 2 * MARGIN) * dims.UPM // s for s in sizes]
    lines = drawn_words(texts, glyphs).select("page_id", F.col("words"), *(wrapped(F.col("words"), m).alias(f"lines{n}") for n, m in enumerate(most)))
    tops = [F.lit(10 * MARGIN)]
    for n, size in enumerate(sizes):
        tops.append(tops[-1] + size * (BEFORE + AFTER + FEED * F.size(f"lines{n}")))
    head = F.format_string('<svg width="%d" height="%d" xmlns="http://www.w3.org/2000/svg"><rect width="100%%" height="100%%" fill="#fff"/>', F.lit(SHEET_WIDTH), F.ceil((tops[-1] + 10 * MARGIN) / 10))
    return lines.select("page_id", F.concat(head, *(body(F.col(f"lines{n}"), size, tops[n]) for n, size in enumerate(sizes)), F.lit("</svg>")).alias("svg"))
