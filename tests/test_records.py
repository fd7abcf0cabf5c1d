"""Ids, labels, overrides and the report against cases by hand."""

from pyspark.sql import functions as F

from glyphlake.operators import records

BOX = "page_id long, box_id int, x0 int, x1 int, y0 int, y1 int"


def test_ids_run_on_over_pages_and_groups_of_pages(spark):
    boxes = spark.createDataFrame([(p, b, 0, 1, 0, 1) for p in (0, 1, records.SPAN, 3 * records.SPAN + 5, -7) for b in (3, 1)], BOX)
    got = records.running_ids(boxes).orderBy("id").collect()
    assert [r.id for r in got] == list(range(10)) and [(r.page_id, r.box_id) for r in got] == sorted((r.page_id, r.box_id) for r in got)
    assert records.running_ids(boxes.limit(0)).count() == 0


def test_labels_by_id(spark):
    boxes = spark.createDataFrame([(1, i, 0, 1, 0, 1) for i in range(7)], BOX)
    labels = spark.createDataFrame([(1, 0, None), (1, 1, ""), (1, 2, "é"), (1, 3, "ab"), (1, 4, "é"), (1, 5, "q"), (9, 6, "a")], "page_id long, box_id int, label string")
    got = [(r.box_id, r.ch) for r in records.labelled_boxes(boxes, labels).orderBy("box_id").collect()]
    assert got == [(2, "é"), (5, "q")]
    assert [r.ch for r in records.labelled_boxes(boxes, labels, spark.createDataFrame([("q",)], "ch string")).collect()] == ["q"]


def test_later_overrides_win(spark):
    earlier = spark.createDataFrame([(1, 1, 0, 1, 0, 1), (1, 2, 0, 1, 0, 1), (1, 3, 5, 6, 5, 6)], BOX)
    later = spark.createDataFrame([(1, 2, 0, 9, 0, 1), (1, 3, 5, 6, 5, 6), (1, 4, 1, 2, 1, 2)], BOX)
    got = {r.box_id: (r.x1, r.changed) for r in records.merged_overrides(earlier, later).collect()}
    assert got == {1: (1, False), 2: (9, True), 3: (6, False), 4: (2, True)}


def test_report_is_ordered_and_rounds_half_up(spark):
    audited = spark.createDataFrame([(1, 1, 1000, 996, 0), (1, 2, 16, 15, 1), (1, 3, 100, 90, 0), (1, 4, 0, 0, 0), (1, 5, 10, 10, 2)], "page_id long, box_id int, owned long, kept_own long, kept_foreign long")
    audited = audited.withColumn("missing", F.col("owned") - F.col("kept_own")).withColumn("clipped", F.coalesce(F.try_divide("missing", "owned"), F.lit(0.0)))
    got = [r.line for r in records.report_lines(audited, spark.createDataFrame([(1, 2)], "page_id long, box_id int")).orderBy("place").collect()]
    assert got == ["   3  clipped  10.0%  foreign   0.0%  <- clipped", "   2  clipped   6.3%  foreign   6.3%  (pinned by hand)", "   5  clipped   0.0%  foreign  16.7%"]


def test_paths_and_guides(spark):
    paths = ["a.b/c.pdf", "c", ".x", "d/.x", "d.e/f.g.pdf"]
    got = [r[0] for r in spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, p string").orderBy("i").select(records.map_file(F.col("p"))).collect()]
    assert got == ["a.b/c-map.txt", "c-map.txt", ".x-map.txt", "d/.x-map.txt", "d.e/f.g-map.txt"]
    assert spark.range(1).select(*records.guide_box(F.lit(81.0), F.lit(40.0), F.lit(0.0))).first() == (10.0, 20.0)
