"""What comes out: manifests as JSON, SVG fonts and previews as text, crops as PNG, stylesheets."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphlake.functions.scalars import css_escape, glyph_name, xml_escape
from glyphlake.operators import dims
from glyphlake.sources.files import write_files


def blob_manifest(boxes: DataFrame) -> DataFrame:
    """(page_id, json): a page's boxes (box_id, row, x0, y0, x1, y1, area) in order, as one JSON text a page."""
    entry = F.struct(F.col("box_id").alias("id"), "row", F.struct("x0", "y0", "x1", "y1").alias("box"), "area")
    return boxes.groupBy("page_id").agg(F.to_json(F.struct(F.lit(8).alias("pad"), F.array_sort(F.collect_list(entry)).alias("blobs"))).alias("json"))


def font_manifest(glyphs: DataFrame) -> DataFrame:
    """(font, json): the glyphs (font, ch, d, advance) of each font by character."""
    entry = F.struct("ch", F.struct("d", "advance").alias("g"))
    listed = F.array_sort(F.collect_list(entry))
    return glyphs.groupBy("font").agg(listed.alias("l")).select("font", F.to_json(F.struct(F.col("font").alias("name"), F.lit(dims.UPM).alias("unitsPerEm"), F.map_from_entries("l").alias("glyphs"))).alias("json"))


def label_manifest(labels: DataFrame) -> DataFrame:
    """(page_id, json): a page's labels (box_id, ch) as one JSON map by id; null labels go."""
    entries = F.array_sort(F.collect_list(F.struct(F.col("box_id").alias("i"), "ch")))
    each = labels.where("ch is not null").groupBy("page_id").agg(entries.alias("l"))
    return each.select("page_id", F.to_json(F.map_from_entries(F.transform("l", lambda e: F.struct(e["i"].cast("string"), e["ch"])))).alias("json"))


#: Where the last line of a font stands: beyond all code points.
LAST = 0x110000


def svg_font_frame(name: str, word_space: int = 300) -> list[tuple[int, str]]:
    """(ordinal, line) of what an SVG font has around its glyphs."""
    head = [
        '<?xml version="1.0" encoding="UTF-8"?>',
        '<svg xmlns="http://www.w3.org/2000/svg"><defs>',
        f'<font id="{"".join(c for c in name if c.isascii() and (c.isalnum() or c in "_-")) or "MyHand"}" horiz-adv-x="{word_space}">',
        f'<font-face font-family="{"".join(f"&#x{ord(c):X};" for c in name)}" units-per-em="{dims.UPM}" ascent="{dims.ASCENT}" descent="{dims.DESCENT}" x-height="{dims.X_HEIGHT}" cap-height="{dims.CAP_HEIGHT}"/>',
        f'<missing-glyph horiz-adv-x="{dims.UPM // 2}"/>',
        f'<glyph glyph-name="space" unicode="&#x20;" horiz-adv-x="{word_space}" d=""/>',
    ]
    return [(i - len(head), line) for i, line in enumerate(head)] + [(LAST, "</font></defs></svg>")]


def svg_font(glyphs: DataFrame, name: str, word_space: int = 300) -> DataFrame:
    """Lines (ordinal, line) of an SVG font of glyphs (codepoint, ch, d, advance), to be written in that order.

    Glyphs stay distributed: a line's place is its code point, so a sorted write needs no single task.
    """
    frame = glyphs.sparkSession.createDataFrame(svg_font_frame(name, word_space), "ordinal long, line string")
    line = F.format_string('<glyph glyph-name="%s" unicode="%s" horiz-adv-x="%d" d="%s"/>', glyph_name(F.col("codepoint")), xml_escape(F.col("ch")), F.col("advance").cast("int"), F.col("d"))
    return frame.unionByName(glyphs.where("ch <> ' '").select(F.col("codepoint").cast("long").alias("ordinal"), line.alias("line")))


def stylesheet(fonts: DataFrame) -> DataFrame:
    """(family, css) for fonts (family, base): an @font-face rule with the three file kinds."""
    css = "@font-face {\n  font-family: '%s';\n  src: url('%s.woff2') format('woff2'),\n       url('%s.woff') format('woff'),\n       url('%s.ttf') format('truetype');\n  font-weight: normal;\n  font-style: normal;\n  font-display: swap;\n}"
    return fonts.select("family", F.format_string(css, css_escape(F.col("family")), "base", "base", "base").alias("css"))


def contact_sheet(boxes: DataFrame) -> DataFrame:
    """(page_id, svg): a page's boxes with their numbers."""
    mark = F.format_string('<rect x="%d" y="%d" width="%d" height="%d" fill="none" stroke="#e00"/><text x="%d" y="%d" font-size="12">%d</text>', "x0", "y0", F.expr("x1 - x0 + 1"), F.expr("y1 - y0 + 1"), "x0", "y0", "box_id")
    marks = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("box_id", mark.alias("m")))), lambda s: s["m"]), "")
    return boxes.groupBy("page_id").agg(F.max("x1").alias("w"), F.max("y1").alias("h"), marks.alias("marks")).select("page_id", F.format_string('<svg xmlns="http://www.w3.org/2000/svg" width="%d" height="%d">%s</svg>', F.expr("w + 1"), F.expr("h + 1"), "marks").alias("svg"))


def _png(image: np.ndarray) -> bytes:
    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    h, w = image.shape
    rows = np.zeros((h, w + 1), np.uint8)
    rows[:, 1:] = image
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def crops(pixels: DataFrame, boxes: DataFrame, pad: int = 8) -> DataFrame:
    """(page_id, box_id, png): each box's kept ink (page_id, box_id, y, x), black on white with a margin.

    The ink of a box comes together as a list, bounded by the box's area.
    """
    listed = pixels.groupBy("page_id", "box_id").agg(F.collect_list(F.struct("y", "x")).alias("ink"))
    joined = boxes.select("page_id", "box_id", "x0", "y0", "x1", "y1").join(listed, ["page_id", "box_id"], "left")

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                image = np.full((r.y1 - r.y0 + 1 + 2 * pad, r.x1 - r.x0 + 1 + 2 * pad), 255, np.uint8)
                for p in r.ink if r.ink is not None else ():
                    image[p["y"] - r.y0 + pad, p["x"] - r.x0 + pad] = 0
                out.append((r.page_id, r.box_id, _png(image)))
            yield pd.DataFrame(out, columns=["page_id", "box_id", "png"])

    return joined.mapInPandas(kernel, f"page_id {boxes.schema['page_id'].dataType.simpleString()}, box_id int, png binary")


def snapshots(gray: DataFrame) -> DataFrame:
    """(page_id, png): the grey raster (page_id, y, x, gray) of every page; pixels that are not there are white.

    A page's rows of pixels come together as a list, bounded by a page.
    """
    rows = gray.groupBy("page_id", "y").agg(F.collect_list(F.struct("x", F.col("gray").cast("int").alias("gray"))).alias("row"))
    pages = rows.groupBy("page_id").agg(F.collect_list(F.struct("y", F.col("row.x").alias("x"), F.col("row.gray").alias("gray"))).alias("rows"))

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for page, listed in zip(batch["page_id"], batch["rows"], strict=True):
                image = np.full((max(r["y"] for r in listed) + 1, max(max(r["x"]) for r in listed) + 1), 255, np.uint8)
                for r in listed:
                    image[r["y"], np.asarray(r["x"])] = np.asarray(r["gray"])
                yield pd.DataFrame({"page_id": [page], "png": [_png(image)]})

    return pages.mapInPandas(kernel, f"page_id {gray.schema['page_id'].dataType.simpleString()}, png binary")


def write_images(images: DataFrame, folder: str, name: Column, mode: str = "append") -> None:
    """Write images (png) as files under the folder, named by a column; all of them appear, or none."""
    write_files(images.select(name.alias("name"), F.col("png").alias("content")), folder, mode)


def write_crops(images: DataFrame, folder: str, mode: str = "append") -> None:
    """Write crops (page_id, box_id, png) as crops/<page>-<box>.png under the folder."""
    write_images(images, folder, F.concat(F.lit("crops/"), F.col("page_id").cast("string"), F.lit("-"), F.col("box_id").cast("string"), F.lit(".png")), mode)
