"""Photos: decoding, paper behind transparency, sizes."""

import numpy as np
import pytest

from glyphlake.sources import images, sinks


def save(folder, name, data):
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(data)
    return str(folder)


def test_a_photo_that_cannot_be_decoded_is_an_error(spark, tmp_path):
    where = save(tmp_path / "bad", "a.png", b"no image")
    with pytest.raises(Exception, match="cannot decode"):
        images.photos(spark, where).collect()


def test_gray_of_a_photo(spark, tmp_path):
    page = np.full((40, 60), 255, np.uint8)
    page[10:30, 20:40] = 0
    where = save(tmp_path / "good", "a.png", sinks._png(page))
    rows = images.gray_pixels(images.photos(spark, where), median=False).collect()
    assert len(rows) == 2400 and {(r.y, r.x) for r in rows if r.gray < 128} == {(y, x) for y in range(10, 30) for x in range(20, 40)}
    assert images.photos(spark, where).count() == 1


def test_transparent_paper_is_white(spark):
    data = bytearray([0, 0, 0, 0] * (16 * 16))
    data[:4] = [0, 0, 0, 255]
    one = spark.createDataFrame([("p", 16, 16, 4, bytes(data))], "photo string, width int, height int, channels int, data binary")
    got = {(r.y, r.x): r.gray for r in images.gray_pixels(one, median=False).collect()}
    assert got[0, 0] == 0 and all(g == 255 for at, g in got.items() if at != (0, 0))


def test_shrinking_keeps_the_limit_and_every_pixel():
    g = np.zeros((500, 300), np.uint8)
    g[-1, -1] = 250
    small = images._shrunk(g, 420)
    assert small.shape == (420, 252) and small[-1, -1] > 0
    assert images._shrunk(g, 500) is g and images._shrunk(np.full((10, 1000), 7, np.uint8), 100).tolist() == [[7] * 100]
