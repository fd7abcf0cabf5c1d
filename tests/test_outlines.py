"""Path grammar, winding and previews against golden cases and brute force."""

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glyphlake.functions.pathtext import absolute
from glyphlake.operators import layout, outline, records


def read(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, d string")
    return [r.t for r in df.select("i", outline.path_text(outline.parsed(F.col("d"))).alias("t")).orderBy("i").collect()]


def test_grammar(spark):
    # Texts and what they read as.
    golden = {
        "M0 0L10 0 20 5Z": "M0 0L10 0L20 5Z",
        "m10 10 5 5h10v-3l2 2zm1 1H0V.5e1": "M10 10L15 15L25 15L25 12L27 14ZM11 11L0 11L0 5",
        "M0,0C1 1 2 2 3 3S5 5 6 6t2 2 3 3": "M0 0C1 1 2 2 3 3C4 4 5 5 6 6Q6 6 8 8Q10 10 11 11",
        "M0 0s1 2 3 4q1 0 2 0T9 9": "M0 0C0 0 1 2 3 4Q4 4 5 4Q6 4 9 9",
        "M0 0A10 10 0 0 1 10 10a5 5 0 1020 0": "M0 0C5.5 0 10 4.5 10 10C10 15.5 14.5 20 20 20C25.5 20 30 15.5 30 10",
        "M0 0A0 5 0 0 1 3 4A5 5 0 0 1 3 4": "M0 0L3 4",
        " M1-2+3-4": "M1 -2L3 -4",
        "": "",
        None: None,
    }
    assert read(spark, *golden) == list(golden.values())


@pytest.mark.parametrize("bad", ["L1 1", "M1", "M1 2 3", "M1 2X", "M1 2L3 4 foo", "M1 2Z3", "M1 2A5 5 0 2 1 3 3"])
def test_what_cannot_be_read_is_an_error(spark, bad):
    with pytest.raises(Exception, match="number at|path command at"):
        read(spark, bad)


@settings(max_examples=60, deadline=None)
@given(st.floats(0.5, 50), st.floats(0.5, 50), st.floats(-180, 180), st.booleans(), st.booleans(), st.floats(-60, 60), st.floats(-60, 60))
def test_arcs_stay_on_their_ellipse(rx, ry, turn, large, sweep, x, y):
    segments = absolute(f"M0 0A{rx!r} {ry!r} {turn!r} {int(large)} {int(sweep)} {x!r} {y!r}")[1:]
    if abs(x) + abs(y) < 1e-3:
        return
    c, s = math.cos(math.radians(turn)), math.sin(math.radians(turn))
    half = math.hypot((c * x + s * y) / rx, (c * y - s * x) / ry) / 2
    rx, ry = rx * max(1, half), ry * max(1, half)
    points, pen = [(0.0, 0.0)], (0.0, 0.0)
    for _, v in segments:
        for t in (0.25, 0.5, 0.75, 1.0):
            points.append(tuple((1 - t) ** 3 * pen[k] + 3 * (1 - t) ** 2 * t * v[k] + 3 * (1 - t) * t * t * v[2 + k] + t**3 * v[4 + k] for k in (0, 1)))
        pen = v[4:]
    assert math.isclose(pen[0], x) and math.isclose(pen[1], y)
    unit = [((c * px + s * py) / rx, (c * py - s * px) / ry) for px, py in points]
    # One circle through all of them: its centre is as far from each.
    (ax, ay), (bx, by) = unit[0], unit[-1]
    away = math.sqrt(max(0, 1 - (math.hypot(bx - ax, by - ay) / 2) ** 2))
    d = math.hypot(bx - ax, by - ay)
    centres = [((ax + bx) / 2 + k * away * (by - ay) / d, (ay + by) / 2 - k * away * (bx - ax) / d) for k in (1, -1)]
    assert min(max(abs(math.hypot(px - cx, py - cy) - 1) for px, py in unit) for cx, cy in centres) < 2e-3


def test_a_letter_with_a_hole_is_wound(spark):
    ring = "M0 0L100 0L100 100L0 100Z"  # runs against the clock
    hole = "M20 20L80 20L80 80L20 80Z"
    dot = "M40 40L40 60L60 60L60 40Z"  # with the clock
    curved = "M0 0C0 60 100 60 100 0C100 -60 0 -60 0 0Z"
    texts = [(1, ring + hole + dot), (2, ring), (3, ""), (4, None), (5, curved), (6, "M0 0l100 0 0 100-100 0z" + hole), (7, "M0 0L5 5")]
    got = {r.glyph_id: r.d for r in outline.wound(spark.createDataFrame(texts, "glyph_id int, d string")).collect()}
    turned = "M0 100L100 100L100 0L0 0Z"
    assert got[1] == turned + hole + dot and got[2] == turned and got[6] == turned + hole
    assert got[3] == "" and got[4] is None and got[7] == "M0 0L5 5"
    assert got[5] == "M0 0C0 60 100 60 100 0C100 -60 0 -60 0 0Z"  # with the clock already, by its curves' middles


def test_fragments_and_empty_outlines(spark):
    df = spark.createDataFrame([(1, "M0 0L1 1Z"), (2, ""), (3, None), (4, " ")], "i int, d string")
    assert [r.i for r in records.with_outline(df).collect()] == [1]
    got = [r.s for r in df.select("i", records.glyph_fragment(F.col("d"), 120).alias("s")).orderBy("i").collect()]
    assert got[0] == '<path transform="translate(13.2,100.8) scale(0.0936,-0.0936)" d="M0 0L1 1Z" fill="#111" fill-rule="evenodd"/>' and got[1] == got[2] == ""


def by_hand(text, glyphs, sizes):
    """The preview of one text, in exact tenths."""
    out, y = [], 400
    for size in sizes:
        y += 11 * size
        lines, line, width = [], [], 0
        for word in text.split():
            w = sum(glyphs.get(c, (None, 500))[1] for c in word)
            if line and (width + 300 + w) * size > 1200 * 1000:
                lines.append(line)
                line, width = [], 0
            width += w + (300 if line else 0)
            line = [*line, word]
        for words in [*lines, line] if line else lines:
            pen = 0
            for c in " ".join(words):
                d, advance = glyphs.get(c, (None, 300 if c == " " else 500))
                if d:
                    x = (40000 + pen * size + 50) // 100
                    out.append(f'<path transform="translate({x // 10}.{x % 10},{y // 10}.{y % 10}) scale({size / 1000:.4f},-{size / 1000:.4f})" d="{d}" fill="#111" fill-rule="evenodd"/>')
                pen += advance
            y += 14 * size
        y += 4 * size
    return f'<svg width="1280" height="{-(-(y + 400) // 10)}" xmlns="http://www.w3.org/2000/svg"><rect width="100%" height="100%" fill="#fff"/>{"".join(out)}</svg>'


def test_previews_match_those_made_by_hand(spark):
    random.seed(2)
    glyphs = {"a": ("M0 0Z", 431), "b": ("M1 0Z", 600), "가": ("M2 0Z", 1000), "i": ("", 250)}
    texts = {i: "".join(random.choice("aab가i?  \n") for _ in range(random.randrange(200))) for i in range(12)} | {50: "", 51: "  ", 52: "b" * 60 + " a"}
    got = layout.waterfall(spark.createDataFrame(list(texts.items()), "page_id long, text string"), spark.createDataFrame([(c, d, a) for c, (d, a) in glyphs.items()], "ch string, d string, advance int"))
    assert {r.page_id: r.svg for r in got.collect()} == {i: by_hand(t, glyphs, layout.SIZES) for i, t in texts.items() if t.split()}


def test_glyph_sheet_draws_outlines(spark):
    glyphs = spark.createDataFrame([(1, i, c, d) for i, (c, d) in enumerate([("a", "M0 0Z"), (" ", "M9 9Z"), ("b", ""), ("c", None)] + [(chr(100 + k), f"M{k} 0Z") for k in range(9)])], "page_id long, place int, ch string, d string")
    got = {r.ch: (r.cx, r.cy, r.drawing) for r in records.glyph_sheet(glyphs, "place").collect()}
    assert got["a"] == (10, 0, '<path transform="translate(18,88) scale(0.08,-0.08)" d="M0 0Z" fill="#111" fill-rule="evenodd"/>')
    assert " " not in got and got["b"] == (130, 0, "") and got["c"] == (250, 0, "")
    assert got["k"][:2] == (10, 120) and 'translate(18,208)' in got["k"][2]


def test_previews_never_move_outlines(spark):
    texts, glyphs = spark.createDataFrame([(1, "ab ba")], "page_id long, text string"), spark.createDataFrame([("a", "M0 0Z", 431)], "ch string, d string, advance int")
    plan = layout.waterfall(texts, glyphs)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "glyphlake-" not in plan  # neither sorted by character nor written between
