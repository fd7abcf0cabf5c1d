"""Backgrounds, dominant components and the repair loop against dense and exhaustive versions."""

import math

import numpy as np
from pyspark.sql import functions as F

from glyphlake.operators import boxes, ownership, raster
from glyphlake.plans.refine import refined
from glyphlake.sources import images, sinks
from glyphlake.sources.files import read_files

BOX = "page_id long, box_id int, x0 int, x1 int, y0 int, y1 int, area long"


def pixels(spark, image, page=1):
    y, x = np.indices(image.shape)
    return spark.createDataFrame([(page, int(a), int(b), int(g)) for a, b, g in zip(y.ravel(), x.ravel(), image.ravel(), strict=True)], "page_id long, y int, x int, gray int")


def dense_background(image, tile):
    """Tile means, Gaussian of two tiles, bilinear between tile centres, every step rounded half up; whole numbers throughout."""
    rows, columns = (-(-n // tile) for n in image.shape)
    half_up = lambda a, b: (2 * a + b) // (2 * b)
    means = [[half_up(int(c.sum()), c.size) for c in (image[r * tile : (r + 1) * tile, k * tile : (k + 1) * tile] for k in range(columns))] for r in range(rows)]
    weight = lambda d: int(1024 * math.exp(-d * d / 8) + 0.5) if abs(d) <= 6 else 0
    blurred = np.zeros((rows, columns), int)
    for r in range(rows):
        for k in range(columns):
            w = [(weight(r - i) * weight(k - j), means[i][j]) for i in range(rows) for j in range(columns)]
            blurred[r, k] = half_up(sum(a * b for a, b in w), sum(a for a, _ in w))
    out = np.zeros(image.shape, int)
    for y in range(image.shape[0]):
        for x in range(image.shape[1]):
            total = 0
            (r, fy), (k, fx) = divmod(2 * y + 1 - tile, 2 * tile), divmod(2 * x + 1 - tile, 2 * tile)
            for i, wy in ((r, 2 * tile - fy), (r + 1, fy)):
                for j, wx in ((k, 2 * tile - fx), (k + 1, fx)):
                    total += wy * wx * int(blurred[min(max(i, 0), rows - 1), min(max(j, 0), columns - 1)])
            out[y, x] = half_up(total, 4 * tile * tile)
    return out


def test_background_is_blurred_and_drawn_out(spark):
    rng = np.random.default_rng(5)
    for shape, tile in (((37, 70), 8), ((5, 3), 8), ((24, 24), 3)):
        image = rng.integers(0, 256, shape)
        got = {(r.y, r.x): r.background for r in raster.with_background(pixels(spark, image), tile).collect()}
        want = dense_background(image, tile)
        assert got == {(y, x): want[y, x] for y in range(shape[0]) for x in range(shape[1])}


def test_a_shaded_page_keeps_its_strokes_only(spark):
    shade = (np.add.outer(np.zeros(96), np.linspace(90, 235, 128))).astype(int)  # a shadow darker than the cap
    page = shade.copy()
    page[40:50, 10:120:6] = np.maximum(0, shade[40:50, 10:120:6] - 90)
    ink = {(r.y, r.x) for r in raster.adaptive_ink(pixels(spark, page), 16).collect()}
    strokes = {(y, x) for y in range(40, 50) for x in range(10, 120, 6) if page[y, x] < 165}
    assert ink == strokes and 0.005 < len(ink) / page.size < 0.1


def test_dominant_components(spark):
    # Component 1 has 6 of 10 pixels in cell 0, component 2 as many there as 1, component 3 is half and half.
    rows = [(1, 0, y, 0, 1) for y in range(6)] + [(1, 1, y, 9, 1) for y in range(4)] + [(1, 0, y, 1, 2) for y in range(6)] + [(1, 2, y, 20, 3) for y in range(5)] + [(1, 3, y, 30, 3) for y in range(5)]
    shares = ownership.cell_shares(spark.createDataFrame(rows, "page_id long, cell int, y int, x int, root long"))
    mains = ownership.dominant(shares)
    assert sorted((r.cell, r.root) for r in mains.collect()) == [(0, 1)]  # 1 is met first; of cell 1 it has too little, of 2 and 3 nothing has enough
    cells = spark.createDataFrame([(1, c, 10 * c, 0, 10 * c + 1, 5) for c in range(4)], "page_id long, cell int, x0 int, y0 int, x1 int, y1 int")
    reach = spark.createDataFrame([(1, 1, -3, 0, 9, 40)], "page_id long, root long, ex0 int, ey0 int, ex1 int, ey1 int")
    got = ownership.extended(cells, mains, reach).orderBy("cell").collect()
    assert [(r.x0, r.y0, r.x1, r.y1) for r in got] == [(-3, 0, 9, 40), (10, 0, 11, 5), (20, 0, 21, 5), (30, 0, 31, 5)] and tuple(got[0].core) == (0, 0, 1, 5)


def test_valleys_match_a_search(spark):
    rng = np.random.default_rng(7)
    for width, count, density in ((40, 4, 0.3), (9, 4, 0.4), (3, 5, 0.9), (30, 2, 0.05)):
        image = rng.random((12, width)) < density
        chunk = (1, 0, 100, 100 + width - 1, 50, 61, int(image.sum()))
        ink = spark.createDataFrame([(1, int(y) + 50, int(x) + 100) for y, x in np.argwhere(image)], "page_id long, y int, x int")
        chunks = spark.createDataFrame([chunk], "page_id long, chunk int, x0 int, x1 int, y0 int, y1 int, area long")
        got = boxes.valley_slices(chunks, spark.createDataFrame([(1, 0, count)], "page_id long, chunk int, n int"), ink, 16).orderBy("i").collect()
        columns, bounds = image.sum(0), [0]
        near = max(2, math.floor(width / count * 0.38 + 0.5))
        for k in range(1, count):
            even = math.floor(k * (width / count) + 0.5)
            tried = range(max(1, even - near), min(width - 2, even + near) + 1)
            bounds.append(min(tried, key=lambda c: (columns[c] * 1000 + abs(c - even), c)) if tried else even)
        want = []
        for i, (a, b) in enumerate(zip(bounds, [*bounds[1:], width], strict=True)):
            found = np.argwhere(image[:, a:b]) if a < b else np.zeros((0, 2))
            if len(found):
                want.append((i, 100 + a + found[:, 1].min(), 50 + found[:, 0].min(), 100 + a + found[:, 1].max(), 50 + found[:, 0].max(), len(found)))
        assert [tuple(r)[2:] for r in got] == (want or [(0, 100, 50, 100 + width - 1, 61, int(image.sum()))])


def labelled(spark, rects):
    rows = [(page, y, x, root) for page, root, x0, y0, x1, y1 in rects for y in range(y0, y1 + 1) for x in range(x0, x1 + 1)]
    return spark.createDataFrame(rows, "page_id long, y int, x int, root long")


def test_repair_stops_at_the_gate_and_keeps_the_best_round_of_a_run(spark):
    # Page 1 misses 1 of 100 pixels, which is under the gate; page 2 is clipped; pages 3 and 4 belong together.
    ink = labelled(spark, [(1, 1, 0, 0, 9, 9), (2, 1, 0, 0, 9, 9), (3, 1, 0, 0, 9, 9), (4, 1, 0, 0, 9, 9)])
    ink = ink.where("page_id <> 1 or not (x = 9 and y = 9)").unionByName(labelled(spark, [(1, 1, 9, 10, 9, 10)]))
    given = spark.createDataFrame([(1, 1, 0, 9, 0, 9, 0), (2, 1, 0, 9, 0, 4, 0), (3, 1, 0, 9, 0, 9, 0), (4, 1, 0, 9, 0, 7, 0)], BOX)
    got = {r.page_id: (r.y1, r.round, r.missing) for r in refined(ink, given, 8).collect()}
    assert got == {1: (9, 0, 1), 2: (9, 1, 0), 3: (9, 0, 0), 4: (9, 1, 0)}
    runs = spark.createDataFrame([(3, "a"), (4, "a")], "page_id long, run_id string")
    got = {r.page_id: (r.y1, r.round, r.missing) for r in refined(ink, given, 8, runs=runs).collect()}
    assert got == {1: (9, 0, 1), 2: (9, 1, 0), 3: (9, 1, 0), 4: (9, 1, 0)}  # pages of one run have one best round
    pinned = spark.createDataFrame([(2, 1)], "page_id long, box_id int")
    assert {r.page_id: (r.y1, r.round, r.missing) for r in refined(ink, given, 8, pinned).collect()}[2] == (4, 0, 50)
    assert {r.page_id: r.round for r in refined(ink, given, 8, rounds=1).collect()} == dict.fromkeys((1, 2, 3, 4), 0)
    assert refined(ink, given.limit(0), 8).count() == 0


def exif(order, held):
    mark = {"little": b"II", "big": b"MM"}[order]
    number = lambda v, n: v.to_bytes(n, order)
    entries = [number(0x010F, 2) + number(2, 2) + number(1, 4) + b"x\0\0\0", number(0x0112, 2) + number(3, 2) + number(1, 4) + number(held, 2) + b"\0\0"]
    body = b"Exif\0\0" + mark + number(42, 2) + number(8, 4) + number(len(entries), 2) + b"".join(entries) + number(0, 4)
    return b"\xff\xe1" + (len(body) + 2).to_bytes(2, "big") + body


def test_orientation_is_read():
    other = b"\xff\xe0\x00\x10JFIF\0\x01\x02\0\0\x01\0\x01\0\0"
    for order in ("little", "big"):
        for held in range(1, 9):
            assert images.orientation(b"\xff\xd8" + other + exif(order, held) + b"\xff\xda") == held
    whole = b"\xff\xd8" + exif("big", 6)
    assert images.orientation(b"\xff\xd8" + exif("big", 9)) == 1 and images.orientation(b"\x89PNG") == 1 and images.orientation(b"") == 1
    assert all(images.orientation(whole[:n]) in (1, 6) for n in range(len(whole)))


def test_pages_are_turned_upright(spark):
    seen = np.array([[1, 2, 3], [4, 5, 6]])
    stored = {1: seen, 2: seen[:, ::-1], 3: seen[::-1, ::-1], 4: seen[::-1], 5: seen.T, 6: np.rot90(seen), 7: seen.T[::-1, ::-1], 8: np.rot90(seen, -1)}
    for held, image in stored.items():
        assert (images.upright(image, held) == seen).all(), held
    row = [("p", 2, 3, 1, bytearray(stored[6].astype(np.uint8).tobytes()), 6)]
    df = spark.createDataFrame(row, "photo string, width int, height int, channels int, data binary, orientation int")
    got = {(r.y, r.x): r.gray for r in images.gray_pixels(df, median=False).collect()}
    assert got == {(y, x): seen[y, x] for y in range(2) for x in range(3)}


def test_images_are_written_as_files_and_read_again(spark, tmp_path):
    rng = np.random.default_rng(2)
    pages = {p: rng.integers(0, 256, (20, 30)) for p in (1, 2)}
    gray = pixels(spark, pages[1], 1).unionByName(pixels(spark, pages[2], 2))
    sinks.write_images(sinks.snapshots(gray.where("gray < 255")), f"file://{tmp_path}/pages", F.format_string("page-%d.png", "page_id"))
    photos = images.photos(spark, f"{tmp_path}/pages")
    assert {r.orientation for r in photos.collect()} == {1}
    got = images.gray_pixels(photos, median=False).collect()
    assert len(got) == 1200 and all(pages[int(r.page_id[-5])][r.y, r.x] == r.gray for r in got)
    box = spark.createDataFrame([(1, 3, 5, 6, 5, 6, 1)], BOX)
    sinks.write_crops(sinks.crops(spark.createDataFrame([(1, 3, 5, 5)], "page_id long, box_id int, y int, x int"), box), f"file://{tmp_path}/out")
    crop = images.gray_pixels(images.photos(spark, f"{tmp_path}/out/crops"), median=False)
    assert [(r.y, r.x) for r in crop.where("gray = 0").collect()] == [(8, 8)] and crop.count() == 18 * 18
    assert [r.name for r in read_files(spark, f"file://{tmp_path}/out").collect()] == ["1-3.png"]


def test_manifests_labels_and_overrides_are_read(spark, tmp_path):
    (tmp_path / "blobs.json").write_text('{"pad": 8, "mode": "cells", "photos": ["a.jpg", "b.jpg"], "blobs": [{"id": 0, "row": 1, "box": {"x0": 1, "y0": 2, "x1": 3, "y1": 4}, "area": 9, "crop": "crops/0.png"}, {"id": 1, "photo": "b.jpg", "row": 2, "box": {"x0": 5, "y0": 6, "x1": 7, "y1": 8}, "area": 4}]}')
    got = images.blobs(spark, f"{tmp_path}/blobs.json").orderBy("id").collect()
    assert [tuple(r) for r in got] == [(0, "a.jpg", 1, 1, 2, 3, 4, 9, "crops/0.png"), (1, "b.jpg", 2, 5, 6, 7, 8, 4, None)]
    (tmp_path / "labels.json").write_text('{"0": "가", "1": "", "12": "b"}')
    assert sorted(map(tuple, images.labels(spark, f"{tmp_path}/labels.json").collect())) == [(0, "가"), (12, "b")]
    (tmp_path / "boxes.json").write_text('{"3": [9, 8, 7, 6]}')
    assert [tuple(r) for r in images.overrides(spark, f"{tmp_path}/boxes.json").collect()] == [(3, 9, 8, 7, 6)]
    (tmp_path / "bad.json").write_text('{"3": [9, 8, 7]}')
    try:
        images.overrides(spark, f"{tmp_path}/bad.json").collect()
    except Exception as e:
        assert "a box needs four numbers: 3" in str(e)
    else:
        raise AssertionError("three numbers were taken for a box")
    labels = spark.createDataFrame([(1, 10, "b"), (1, 2, '"'), (1, 3, None)], "page_id long, box_id int, ch string")
    assert [r.json for r in sinks.label_manifest(labels).collect()] == ['{"2":"\\"","10":"b"}']
