"""Relational operators against golden cases."""

import random

from pyspark.sql import functions as F

from glyphlake import catalogue
from glyphlake.functions import scalars as s
from glyphlake.operators import boxes, compose, dims, graph, layout, outline, ownership, raster, text
from glyphlake.plans.refine import refined
from glyphlake.sources import sinks, views

BOX = "page_id long, box_id int, x0 int, x1 int, y0 int, y1 int, area long"


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def ink(spark, rects, page=1):
    found = {(page, y, x) for x0, y0, x1, y1 in rects for y in range(y0, y1 + 1) for x in range(x0, x1 + 1)}
    return spark.createDataFrame(sorted(found), "page_id long, y int, x int")


def test_scalars(spark):
    df = spark.createDataFrame([(-2.5, "한", "a'b\\c")], "v double, ch string, name string")
    got = df.select(s.half_up(F.col("v")), s.is_hangul(F.col("ch")), s.css_escape(F.col("name")), s.glyph_name(F.lit(65)), s.xml_escape(F.lit("A한")), s.font_id(F.lit("!!")), s.grey_css(F.lit(210))).first()
    assert list(got) == [-2, True, "a\\'b\\\\c", "uni0041", "&#x41;&#xD55C;", "MyHand", "#d2d2d2"]
    assert spark.range(1).select(s.upper_median(F.array(F.lit(4), F.lit(1), F.lit(3), F.lit(2)))).first()[0] == 3
    assert spark.createDataFrame([("é",)], "t string").select(s.nfc(F.col("t"))).first()[0] == "é"


def test_hangul(spark):
    one = spark.createDataFrame([(ord("한"),)], "codepoint int").select(*compose.decomposed(F.col("codepoint"))).first()
    assert tuple(one) == ("한", "ㅎ", "ㅏ", "ㄴ")
    every = spark.range(0xAC00, 0xAC00 + compose.COUNT).select(F.col("id").cast("int").alias("codepoint"))
    classes = compose.layouts(every).groupBy("upright", "has_final").count()
    assert rows(classes, "upright", "has_final", "count") == [(False, False, 228), (False, True, 6156), (True, False, 171), (True, True, 4617)]
    assert dims.letters(spark).where("role <> 'X'").count() == 67 and dims.letters(spark).count() == 84


def test_composed_geometry(spark):
    square = [(r, c, 0.0, 0.0, 200.0, 200.0) for r, cs in (("L", dims.LEADS), ("T", dims.FINALS)) for c in cs]
    parts = spark.createDataFrame(square + [("V", c, 0.0, 0.0, 400.0, 100.0) for c in dims.VOWELS], "role string, jamo string, x0 double, y0 double, x1 double, y1 double")
    placed = compose.placed_parts(parts, dims.slots(spark))
    assert placed.count() == 19 * 4 + 9 * 2 + 12 * 2 + 27 * 2
    assert all(max(r.kx / r.ky, r.ky / r.kx) <= 1.5 + 1e-9 for r in placed.collect())
    got = {r.role: r for r in compose.composed(spark.createDataFrame([(ord("각"),)], "codepoint int"), placed).collect()}
    assert len(got) == 3 and got["T"].by1 < 3200 and got["T"].by1 <= min(got["L"].by0, got["V"].by0)
    flat = {r.role: r for r in compose.composed(spark.createDataFrame([(ord("고"),)], "codepoint int"), placed).collect()}
    assert len(flat) == 2 and flat["V"].by1 <= flat["L"].by0


def test_otsu_separates_two_modes(spark):
    gray = spark.createDataFrame([("p", v) for v in [20] * 30 + [25] * 30 + [200] * 200 + [220] * 300], "page_id string, gray int")
    hist = raster.histogram(gray)
    assert raster.otsu(hist).first().best == 25
    assert raster.thresholds(hist).first()[1:] == (50, 40)
    assert raster.otsu(raster.histogram(gray.where("gray = 20"))).first().best == 0


def test_morphology_matches_dense(spark):
    import random

    random.seed(3)
    dense = {(y, x) for y in range(8) for x in range(8) if random.random() < 0.5}
    df = spark.createDataFrame([(1, y, x) for y, x in dense], "page_id long, y int, x int")
    around = lambda p: {p, (p[0] - 1, p[1]), (p[0] + 1, p[1]), (p[0], p[1] - 1), (p[0], p[1] + 1)}
    grown = {q for p in dense for q in around(p) if 0 <= q[0] < 8 and 0 <= q[1] < 8}
    assert set(rows(raster.dilated(df, 8, 8), "y", "x")) == grown
    assert set(rows(raster.eroded(df), "y", "x")) == {p for p in dense if around(p) <= dense}
    assert set(rows(raster.closed(df, 8, 8), "y", "x")) == {p for p in grown if around(p) <= grown}


def test_components(spark):
    df = ink(spark, [(0, 0, 2, 0), (3, 1, 3, 3), (10, 0, 11, 1)]).unionByName(ink(spark, [(0, 0, 0, 0)], page=2))
    assert rows(graph.components(df), "page_id", "x0", "y0", "x1", "y1", "area") == [(1, 0, 0, 3, 3, 6), (1, 10, 0, 11, 1, 4), (2, 0, 0, 0, 0, 1)]
    assert graph.components(df, 2).count() == 2


def test_allocation_is_the_greedy_one(spark):
    import random

    random.seed(5)
    for _ in range(3):
        widths, total = [random.randint(1, 90) for _ in range(5)], 14
        counts = [1] * 5
        for _ in range(total - 5):
            best = max(range(5), key=lambda i: (widths[i] / counts[i], -i))
            counts[best] += 1
        chunks = spark.createDataFrame([(1, i, 0, w - 1) for i, w in enumerate(widths)], "page_id long, chunk int, x0 int, x1 int")
        got = boxes.allocated(chunks, spark.createDataFrame([(1, total)], "page_id long, total int"))
        assert [n for _, n in rows(got, "chunk", "n")] == counts


def test_islands_and_groups(spark):
    # Boxes x0, x1, y0, y1, area of four written characters in eight strokes.
    golden = [(0, 42, 20, 80, 100), (8, 55, 85, 120, 80), (75, 120, 20, 80, 100), (78, 130, 84, 120, 80), (155, 195, 20, 80, 100), (212, 245, 20, 80, 100), (260, 292, 20, 80, 100), (305, 332, 20, 80, 100)]
    df = spark.createDataFrame([(1, i, *b) for i, b in enumerate(golden)], BOX)
    chunks = boxes.islands(df)
    assert rows(chunks, "chunk", "x0", "x1")[:2] == [(0, 0, 55), (1, 75, 130)] and chunks.count() == 6
    assert boxes.widest_gaps(chunks).first().chunk == 2
    assert boxes.proximity_groups(df).agg(F.sum("n")).first()[0] == 8


def test_crop_rule_without_owners(spark):
    # A body, a piece apart, a stroke that crosses and a speck.
    df = ink(spark, [(40, 40, 90, 100), (44, 108, 74, 120), (80, 20, 280, 28), (100, 46, 100, 46)])
    labelled = graph.labelled_pixels(df)
    box = spark.createDataFrame([(1, 1, 38, 102, 18, 122, 0)], BOX)
    kept = set(rows(ownership.crop_pixels(labelled, box, 64, by_owner=False), "x", "y"))
    assert {(60, 70), (60, 114)} <= kept and not {(90, 24), (100, 46)} & kept


def test_refine_grows_boxes_and_leaves_pinned_ones(spark):
    labelled = graph.labelled_pixels(ink(spark, [(10, 10, 30, 40), (50, 10, 70, 40)]))
    given = spark.createDataFrame([(1, 1, 12, 30, 12, 40, 0), (1, 2, 50, 70, 10, 30, 0)], BOX)
    got = rows(refined(labelled, given, 32), "box_id", "x0", "y0", "x1", "y1", "missing")
    assert got == [(1, 10, 10, 30, 40, 0), (2, 50, 10, 70, 40, 0)]
    pinned = spark.createDataFrame([(1, 2)], "page_id long, box_id int")
    assert rows(refined(labelled, given, 32, pinned), "box_id", "y1")[1] == (2, 30)


def test_cells_are_captured_and_clipping_is_named(spark):
    photos = spark.createDataFrame([(0, 595, 842)], "page int, width int, height int")
    places = layout.cell_rectangles(spark.range(2).select(F.col("id").alias("item"), *layout.sheet_places(F.col("id"))).join(photos, "page")).orderBy("item").collect()
    a, b = places
    pixels = [(0, y, x) for y in range(a.y0 + 20, a.y0 + 30) for x in range(a.x0 + 20, a.x0 + 40)] + [(0, y, b.x0) for y in range(b.y0 + 30, b.y0 + 33)]
    got = layout.captured_cells(spark.createDataFrame(pixels, "page int, y int, x int"), photos, spark.range(2).select(F.col("id").alias("item"))).orderBy("item").collect()
    assert (got[0].area, got[0].clipped, got[1].area, got[1].clipped) == (200, [], 3, ["left"])


def test_outlines(spark):
    ring = [(1, i, x, y) for i, (x, y) in enumerate([(0, 0), (100, 0), (100, 100), (0, 100)])] + [(2, i, x, y) for i, (x, y) in enumerate([(20, 20), (20, 60), (60, 60), (60, 20)])]
    df = spark.createDataFrame(ring, "poly_id long, i int, x long, y long")
    assert rows(outline.doubled_areas(df), "poly_id", "area2") == [(1, 20000), (2, -3200)]
    groups = spark.createDataFrame([(9, 1), (9, 2)], "group_id long, poly_id long")
    assert rows(outline.winding(df, groups), "poly_id", "depth", "reverse") == [(1, 0, True), (2, 1, True)]
    path = spark.createDataFrame([("M0 0L10 0C10 5 5 10 0 10Z",)], "d string").select(outline.parsed(F.col("d")).alias("p"))
    got = path.select(outline.path_text(F.col("p")), outline.path_text(outline.reversed_path(F.col("p"))), outline.bounds(F.col("p")), outline.path_text(outline.mapped(F.col("p"), F.lit(2.0), F.lit(-1.0), F.lit(1.0), F.lit(0.0)))).first()
    assert got[0] == "M0 0L10 0C10 5 5 10 0 10Z" and got[1] == "M0 10C5 10 10 5 10 0L0 0Z" and tuple(got[2]) == (0, 0, 10, 10)
    assert got[3] == "M1 0L21 0C21 -5 11 -10 1 -10Z"


def test_text(spark):
    df = spark.createDataFrame([(1, "안녕 글/하세요\\nx"), (2, "")], "id long, t string")
    assert rows(text.expected_lines(df, "id", "t"), "id", "line", "chars") == [(1, 0, "안녕글"), (1, 1, "하세요"), (1, 2, "x")]
    words = spark.createDataFrame([("aa bb c",)], "t string").select(layout.wrapped(layout.word_widths(F.col("t"), {"a": 100, "b": 100, "c": 50}), 600).alias("l")).first().l
    assert [tuple(x) for x in words] == [(0, 1, 200), (1, 2, 550)]  # 200 + 300 + 200 is more than 600
    long = spark.createDataFrame([("ab abababab a",)], "t string").select(layout.wrapped(layout.word_widths(F.col("t"), {"a": 100, "b": 100}), 600).alias("l")).first().l
    assert [tuple(x) for x in long] == [(0, 1, 200), (1, 1, 800), (2, 1, 100)]  # a word wider than the line has a line of its own


def test_metrics(spark):
    glyphs = spark.createDataFrame([("g", 40, 70), ("A", 50, 70), ("가", 50, 100)], "ch string, ink_w int, ink_h int")
    got = {r.ch: r for r in layout.placement(layout.with_bands(glyphs, dims.bands(spark))).collect()}
    assert got["g"].dy == 480 and got["A"].advance == 600 and got["가"].advance == 1000 and abs(got["가"].dx - 325) < 1e-9


def test_sinks(spark):
    glyphs = spark.createDataFrame([(65, "A", "M0 0Z", 600), (44032, "가", "M0 0Z", 1000)], "codepoint int, ch string, d string, advance int")
    lines = [r.line for r in sinks.svg_font(glyphs, "My Hand").orderBy("ordinal").collect()]
    assert lines[2].startswith('<font id="MyHand"') and 'glyph-name="uni0041"' in lines[6] and lines[-1].endswith("</svg>")
    png = sinks.crops(spark.createDataFrame([(1, 1, 5, 5)], "page_id long, box_id int, y int, x int"), spark.createDataFrame([(1, 1, 5, 6, 5, 6, 1)], BOX)).first().png
    assert bytes(png[:4]) == b"\x89PNG"


def test_missing_parts_reads_every_order(spark):
    d = "/root/testdata/sf0.001"
    smaller = views.syllables(spark, d).where("codepoint % 28 < 20 and codepoint < 50000")  # every order, a smaller repertoire
    seen = compose.layouts(smaller).select("lead", "vowel", "final").distinct().collect()
    needed = {f"{role}:{r[i]}" for r in seen for i, role in enumerate("LVT")}
    want = {f"{role}:{c}" for role, cs in (("L", dims.LEADS), ("V", dims.VOWELS), ("T", dims.FINALS)) for c in cs} - needed
    got = {r.key for r in catalogue.QUERIES["missing_parts"](spark, d).collect()}
    assert got == want and len(got) >= 16


def test_components_of_pages_need_no_rounds(spark, monkeypatch):
    rng = random.Random(5)
    links = [(p, a, a + rng.randrange(1, 4)) for p in ("x", "y", "z") for a in rng.sample(range(60), 30)] + [("chain", i, i + 1) for i in range(300)]
    nodes = spark.createDataFrame([(p, n) for p in ("x", "y", "z") for n in range(70)] + [("chain", n) for n in range(301)], "page_id string, node int")
    edges = spark.createDataFrame(links, "page_id string, a int, b int")
    root = {(r.page_id, r.node): r.node for r in nodes.collect()}
    changed = True
    while changed:
        changed = False
        for p, a, b in links:
            if root[p, a] != root[p, b]:
                root[p, a] = root[p, b] = min(root[p, a], root[p, b])
                changed = True
    for most in (1 << 14, 100):  # at 100 the chain takes the rounds
        monkeypatch.setattr(graph, "MOST_LINKS", most)
        got = graph.smallest_reachable(nodes, edges, most_rounds=0 if most > 100 else 200)
        assert {(r.page_id, r.node): r.root for r in got.collect()} == root


def test_components_and_owners_send_no_table_through_the_driver(spark):
    from glyphlake.operators import graph, ownership

    ink = spark.createDataFrame([(p, y, x) for p in range(3) for y in range(4) for x in range(4) if (x + y + p) % 3], "page_id long, y int, x int")
    boxes = spark.createDataFrame([(p, 1, 0, 0, 2, 2) for p in range(3)], "page_id long, box_id int, x0 int, y0 int, x1 int, y1 int")
    labelled = graph.labelled_pixels(ink)
    tally = ownership.tallies(labelled, boxes, 4)
    for df in (labelled, graph.components(ink), tally, ownership.keep_rule(tally, labelled), ownership.crop_pixels(labelled, boxes, 4), ownership.audit(labelled, boxes, 4), ownership.orphans(labelled, boxes, 4), ownership.proposals(labelled, boxes, 4)):
        df.collect()
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_only_quotients_that_can_win_are_ranked(spark):
    # 40 chunks share 400 further characters: 16,000 quotients, of which at most 480 are listed.
    chunks = spark.createDataFrame([(1, c, 100 * c, 100 * c + (c * 37) % 90) for c in range(40)], "page_id long, chunk int, x0 int, x1 int")
    totals = spark.createDataFrame([(1, 440)], "page_id long, total int")
    n = dict.fromkeys(range(40), 1)
    for _ in range(400):
        n[min(n, key=lambda c: (-((c * 37) % 90 + 1) / n[c], c))] += 1
    assert {r.chunk: r.n for r in boxes.allocated(chunks, totals).collect()} == n
    assert boxes._quotients(chunks, totals).count() <= 480


def test_boxes_meet_texts_with_what_they_carry(spark):
    placed = spark.createDataFrame([(1, 2, 20), (1, 1, 10), (1, 3, 30), (2, 1, 5), (3, 1, 7)], "page_id long, box_id int, w int")
    texts = spark.createDataFrame([(1, "é𝄞"), (2, "abc"), (3, ""), (4, "x"), (5, None)], "page_id long, text string")
    assert sorted(map(tuple, text.zipped_text(placed, texts).collect())) == [(1, 1, 10, "é"), (1, 2, 20, "𝄞"), (2, 1, 5, "a")]
