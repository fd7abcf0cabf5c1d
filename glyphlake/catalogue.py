"""Queries over the given tables and their SQL twins, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphlake.functions.scalars import css_escape, font_id, glyph_name, half_up, xml_escape
from glyphlake.operators import boxes as bx
from glyphlake.operators import compose, dims, graph, layout, outline, ownership, raster, records, text
from glyphlake.plans import kernels, pages, refine
from glyphlake.sources import sinks
from glyphlake.sources import views as v

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
SIDE = 8  # of the rasters


def query(name: str, *ctes: str, sql: str | None = None):
    """Register a query and, where SQL can express it, its twin over the named relations."""

    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = ("WITH " + ", ".join(ctes) + " " if ctes else "") + sql
        return f

    return keep


# Grey levels and masks

CUM = """c AS (SELECT page_id, gray, n, sum(n) OVER w AS below, sum(gray * n) OVER w AS mass, sum(n) OVER (PARTITION BY page_id) AS total,
 sum(gray * n) OVER (PARTITION BY page_id) AS total_mass FROM v_gray WINDOW w AS (PARTITION BY page_id ORDER BY gray ROWS UNBOUNDED PRECEDING))"""
OTSU = """s AS (SELECT *, CASE WHEN total > below THEN CAST(below AS DOUBLE) * CAST(total - below AS DOUBLE) *
 ((CAST(mass AS DOUBLE) / CAST(below AS DOUBLE) - CAST(total_mass - mass AS DOUBLE) / nullif(CAST(total - below AS DOUBLE), 0.0)) *
 (CAST(mass AS DOUBLE) / CAST(below AS DOUBLE) - CAST(total_mass - mass AS DOUBLE) / nullif(CAST(total - below AS DOUBLE), 0.0))) END AS b FROM c),
 o AS (SELECT page_id, CASE WHEN b IS NULL THEN 0 ELSE gray END AS best FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY b DESC NULLS LAST, gray) AS rn FROM s) x WHERE rn = 1),
 k AS (SELECT page_id, min(gray) AS level FROM c WHERE below >= ceil(total * 0.012) GROUP BY 1),
 f AS (SELECT g.page_id, greatest(50, least(200, any_value(best))) AS otsu, any_value(level) AS level, sum(CASE WHEN gray < greatest(50, least(200, best)) THEN n ELSE 0 END) / sum(n) AS share
   FROM v_gray g JOIN o ON g.page_id = o.page_id JOIN k ON g.page_id = k.page_id GROUP BY 1),
 t AS (SELECT page_id, CAST(CASE WHEN share > 0.35 THEN greatest(55, least(90, level)) ELSE otsu END AS INT) AS threshold FROM f)"""


def _hist(spark: SparkSession, d: str) -> DataFrame:
    return raster.histogram(v.gray(spark, d))


@query("gray_histogram", v.GRAY, sql="SELECT page_id, gray, n FROM v_gray")
def gray_histogram(spark, d):
    return _hist(spark, d)


@query("otsu_threshold", v.GRAY, CUM, OTSU, sql="SELECT page_id, CAST(best AS INT) AS best FROM o")
def otsu_threshold(spark, d):
    return raster.otsu(_hist(spark, d))


@query("quantile_threshold", v.GRAY, CUM, sql="SELECT page_id, min(gray) AS level FROM c WHERE below >= ceil(total * 0.012) GROUP BY 1")
def quantile_threshold(spark, d):
    return raster.quantile_level(_hist(spark, d))


@query("ink_fraction", v.GRAY, sql="SELECT page_id, sum(CASE WHEN gray < 128 THEN n ELSE 0 END) / sum(n) AS share FROM v_gray GROUP BY 1")
def ink_fraction(spark, d):
    return _hist(spark, d).groupBy("page_id").agg(raster.ink_fraction(None, F.lit(128)).alias("share"))


@query(
    "lean_mask_counts", v.GRAY, CUM, OTSU,
    sql="""SELECT page_id, threshold, lean_threshold, CAST(sum(CASE WHEN gray < threshold THEN n ELSE 0 END) AS BIGINT) AS ink, CAST(sum(CASE WHEN gray < lean_threshold THEN n ELSE 0 END) AS BIGINT) AS lean
 FROM (SELECT g.*, threshold, CAST(greatest(40, floor(CAST(threshold AS DOUBLE) * CAST(0.55 AS DOUBLE) + 0.5)) AS INT) AS lean_threshold FROM v_gray g JOIN t ON g.page_id = t.page_id) x GROUP BY 1, 2, 3""",
)
def lean_mask_counts(spark, d):
    hist = _hist(spark, d)
    joined = hist.join(raster.thresholds(hist), "page_id")
    counts = (F.sum(F.when(F.col("gray") < F.col(c), F.col("n")).otherwise(0)).alias(a) for c, a in (("threshold", "ink"), ("lean_threshold", "lean")))
    return joined.groupBy("page_id", "threshold", "lean_threshold").agg(*counts)


BOUNDS = "b AS (SELECT page_id, coalesce(min(CASE WHEN below >= total * 0.01 THEN gray END), 0) AS lo, coalesce(max(CASE WHEN total - below + n >= total * 0.01 THEN gray END), 255) AS hi FROM c GROUP BY 1)"


@query("contrast_bounds", v.GRAY, CUM, BOUNDS, sql="SELECT page_id, lo, hi FROM b")
def contrast_bounds(spark, d):
    return raster.contrast_bounds(_hist(spark, d))


@query(
    "contrast_stretch", v.GRAY, CUM, BOUNDS,
    sql="""SELECT page_id, gray, CAST(sum(n) AS BIGINT) AS n FROM (SELECT g.page_id, n, CAST(greatest(0, least(255, floor((gray - lo) * 255 / CAST(greatest(1, hi - lo) AS DOUBLE) + 0.5))) AS INT) AS gray
 FROM v_gray g JOIN b ON g.page_id = b.page_id) x GROUP BY 1, 2""",
)
def contrast_stretch(spark, d):
    gray = v.gray(spark, d)
    return raster.histogram(raster.stretched(gray, raster.contrast_bounds(raster.histogram(gray))))


AROUND = "(VALUES (0,0),(-1,0),(1,0),(0,-1),(0,1)) o(dy,dx)"


def _dilate(src: str) -> str:
    return f"SELECT DISTINCT page_id, y + dy AS y, x + dx AS x FROM {src}, {AROUND} WHERE y + dy BETWEEN 0 AND 7 AND x + dx BETWEEN 0 AND 7"


def _erode(src: str) -> str:
    return f"SELECT page_id, y + dy AS y, x + dx AS x FROM {src}, {AROUND} GROUP BY 1, 2, 3 HAVING count(*) = 5"


@query("dilate", v.PIXELS, sql=_dilate("v_ink"))
def dilate(spark, d):
    return raster.dilated(v.ink(spark, d), SIDE, SIDE)


@query("erode", v.PIXELS, sql=_erode("v_ink"))
def erode(spark, d):
    return raster.eroded(v.ink(spark, d))


@query("closing", v.PIXELS, f"g AS ({_dilate('v_ink')})", sql=_erode("g"))
def closing(spark, d):
    return raster.closed(v.ink(spark, d), SIDE, SIDE)


@query("stroke_weight", v.PIXELS, f"g AS ({_dilate('v_ink')})", sql=_dilate("g"))
def stroke_weight(spark, d):
    return raster.with_weight(v.ink(spark, d), 2, SIDE, SIDE)


@query("stroke_thinning", v.PIXELS, sql=_erode("v_ink"))
def stroke_thinning(spark, d):
    return raster.with_weight(v.ink(spark, d), -1, SIDE, SIDE)


TILES = "ti AS (SELECT page_id, CAST(y // 4 AS INT) AS ty, CAST(x // 4 AS INT) AS tx, CAST(floor(sum(gray) / CAST(count(*) AS DOUBLE) + 0.5) AS INT) AS background, count(*) AS n FROM v_pixels GROUP BY 1, 2, 3)"


@query("tile_background", v.PIXELS, TILES, sql="SELECT * FROM ti")
def tile_background(spark, d):
    return raster.tile_background(v.pixels(spark, d), 4)


# The twin works every tile's and every pixel's level out from all pairs, without sums along the axes and without neighbourhoods.
BLUR = """pr AS (SELECT a.page_id, a.ty, a.tx, b.background AS level, CAST(floor(1024 * exp(-((a.ty - b.ty) * (a.ty - b.ty)) / CAST(8 AS DOUBLE)) + 0.5) AS BIGINT) * CAST(floor(1024 * exp(-((a.tx - b.tx) * (a.tx - b.tx)) / CAST(8 AS DOUBLE)) + 0.5) AS BIGINT) AS w
 FROM ti a JOIN ti b ON a.page_id = b.page_id AND abs(a.ty - b.ty) <= 6 AND abs(a.tx - b.tx) <= 6),
 bt AS (SELECT page_id, ty, tx, CAST(floor(CAST(sum(level * w) AS DOUBLE) / CAST(sum(w) AS DOUBLE) + 0.5) AS BIGINT) AS b FROM pr GROUP BY 1, 2, 3),
 bg AS (SELECT p.page_id, p.y, p.x, p.gray, CAST(floor(sum(b * greatest(0, 1 - abs(least(greatest((y + 0.5) / 2 - 0.5, 0), 3) - ty)) * greatest(0, 1 - abs(least(greatest((x + 0.5) / 2 - 0.5, 0), 3) - tx))) + 0.5) AS INT) AS background
  FROM v_pixels p JOIN bt ON p.page_id = bt.page_id GROUP BY 1, 2, 3, 4)"""
FINE = TILES.replace("// 4", "// 2")


@query("local_background", v.PIXELS, FINE, BLUR, sql="SELECT page_id, y, x, gray, background FROM bg")
def local_background(spark, d):
    return raster.with_background(v.pixels(spark, d), 2)


@query("adaptive_ink", v.PIXELS, FINE, BLUR, sql="SELECT page_id, y, x FROM bg WHERE gray < 165 AND gray < background - 10")
def adaptive_ink(spark, d):
    return raster.adaptive_ink(v.pixels(spark, d), 2, delta=10)


@query("ink_runs", v.PIXELS, sql="SELECT page_id, y, min(x) AS x0, max(x) AS x1 FROM (SELECT *, x - row_number() OVER (PARTITION BY page_id, y ORDER BY x) AS g FROM v_ink) a GROUP BY page_id, y, g")
def ink_runs(spark, d):
    return raster.runs(v.ink(spark, d))


REACH = """RECURSIVE {0}, reach AS (SELECT page_id, y * 16777216 + x AS a, y * 16777216 + x AS b, y, x FROM v_ink UNION SELECT r.page_id, r.a, i.y * 16777216 + i.x, i.y, i.x FROM reach r JOIN v_ink i
 ON r.page_id = i.page_id AND abs(r.y - i.y) <= 1 AND abs(r.x - i.x) <= 1),
 comp AS (SELECT page_id, y, x, CAST(min(a) AS BIGINT) AS root FROM reach GROUP BY 1, 2, 3)""".format(v.PIXELS)


@query("connected_components", REACH, sql="SELECT page_id, root, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, count(*) AS area FROM comp GROUP BY 1, 2 HAVING count(*) >= 2")
def connected_components(spark, d):
    return graph.components(v.ink(spark, d), 2)


@query("label_components", REACH, sql="SELECT page_id, y, x, root FROM comp")
def label_components(spark, d):
    return graph.labelled_pixels(v.ink(spark, d))


@query("column_profile", v.PIXELS, sql="SELECT page_id, x, n, CAST(sum(n) OVER (PARTITION BY page_id ORDER BY x ROWS UNBOUNDED PRECEDING) AS BIGINT) AS prefix FROM (SELECT page_id, x, count(*) AS n FROM v_ink GROUP BY 1, 2) a")
def column_profile(spark, d):
    return raster.column_profile(v.ink(spark, d))


@query(
    "dominant_components", REACH,
    sql="""SELECT c.page_id, c.cell, least(c.x0, coalesce(e.ex0, c.x0)) AS x0, least(c.y0, coalesce(e.ey0, c.y0)) AS y0, greatest(c.x1, coalesce(e.ex1, c.x1)) AS x1, greatest(c.y1, coalesce(e.ey1, c.y1)) AS y1, c.area,
 c.x0 AS core_x0, c.y0 AS core_y0, c.x1 AS core_x1, c.y1 AS core_y1 FROM (SELECT page_id, CAST(x // 3 AS INT) AS cell, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, count(*) AS area FROM comp WHERE y BETWEEN 2 AND 5 GROUP BY 1, 2) c
 LEFT JOIN (SELECT page_id, cell, root FROM (SELECT *, sum(here) OVER (PARTITION BY page_id, root) AS total, row_number() OVER (PARTITION BY page_id, cell ORDER BY here DESC, met) AS rn FROM
  (SELECT page_id, CAST(x // 3 AS INT) AS cell, root, count(*) AS here, min(min((x // 3) * 10000 + y * 100 + x)) OVER (PARTITION BY page_id, root) AS met FROM comp WHERE y BETWEEN 2 AND 5 GROUP BY 1, 2, 3) s) t WHERE rn = 1 AND here >= total * CAST(0.6 AS DOUBLE)) m
  ON c.page_id = m.page_id AND c.cell = m.cell LEFT JOIN (SELECT page_id, root, min(x) AS ex0, min(y) AS ey0, max(x) AS ex1, max(y) AS ey1 FROM comp GROUP BY 1, 2) e ON m.page_id = e.page_id AND m.root = e.root""",
)
def dominant_components(spark, d):
    """Cells of three columns of each raster's middle rows, grown over their dominant component."""
    runs = graph.kept(graph.labelled_runs(v.ink(spark, d)), "labels")
    reach = runs.groupBy("page_id", "root").agg(F.min("x0").alias("ex0"), F.min("y").alias("ey0"), F.max("x1").alias("ex1"), F.max("y").alias("ey1"))
    pixels = runs.select("page_id", "y", F.explode(F.sequence("x0", "x1")).alias("x"), "root").where("y between 2 and 5").withColumn("cell", F.expr("int(x div 3)"))
    cells = pixels.groupBy("page_id", "cell").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.count(F.lit(1)).alias("area"))
    grown = ownership.extended(cells, ownership.dominant(ownership.cell_shares(pixels)), reach)
    return grown.select("page_id", "cell", "x0", "y0", "x1", "y1", "area", *(F.col(f"core.{c}").alias(f"core_{c}") for c in ("x0", "y0", "x1", "y1")))


VALLEYS = """cn AS (SELECT page_id, page_id % 3 + 2 AS n, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, count(*) AS area FROM v_ink GROUP BY 1),
 co AS (SELECT page_id, x, count(*) AS ink, min(y) AS low, max(y) AS high FROM v_ink GROUP BY 1, 2),
 ev AS (SELECT page_id, x0, x1 - x0 + 1 AS w, n, k, CAST(floor(k * ((x1 - x0 + 1) / CAST(n AS DOUBLE)) + 0.5) AS INT) AS even, CAST(greatest(2, floor((x1 - x0 + 1) / CAST(n AS DOUBLE) * CAST(0.38 AS DOUBLE) + 0.5)) AS INT) AS near FROM cn, range(1, 5) r(k) WHERE k < n),
 ca AS (SELECT ev.*, a AS spot FROM ev, range(0, 8) s(a) WHERE a BETWEEN greatest(1, even - near) AND least(w - 2, even + near)),
 pk AS (SELECT page_id, k, spot FROM (SELECT ca.page_id, k, spot, row_number() OVER (PARTITION BY ca.page_id, k ORDER BY coalesce(ink, 0) * 1000 + abs(spot - even), spot) AS rn FROM ca LEFT JOIN co ON ca.page_id = co.page_id AND co.x = ca.x0 + spot) z WHERE rn = 1),
 cb AS (SELECT ev.page_id, ev.k, coalesce(pk.spot, even) AS spot FROM ev LEFT JOIN pk ON ev.page_id = pk.page_id AND ev.k = pk.k UNION ALL SELECT page_id, 0, 0 FROM cn UNION ALL SELECT page_id, n, x1 - x0 + 1 FROM cn),
 sl AS (SELECT f.page_id, f.k AS i, cn.x0 + f.spot AS a, cn.x0 + t.spot - 1 AS b FROM cb f JOIN cb t ON f.page_id = t.page_id AND t.k = f.k + 1 JOIN cn ON cn.page_id = f.page_id)"""


@query("valley_slices", v.PIXELS, VALLEYS, sql="SELECT sl.page_id, CAST(i AS INT) AS i, min(x) AS x0, min(low) AS y0, max(x) AS x1, max(high) AS y1, CAST(sum(ink) AS BIGINT) AS area FROM sl JOIN co ON sl.page_id = co.page_id AND x BETWEEN a AND b GROUP BY 1, 2")
def valley_slices(spark, d):
    """Each raster's ink cut into two to four slices where little of it stands."""
    ink = v.ink(spark, d)
    chunks = ink.groupBy("page_id").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.count(F.lit(1)).alias("area")).withColumn("chunk", F.lit(0))
    return bx.valley_slices(chunks, chunks.select("page_id", "chunk", F.expr("int(page_id % 3 + 2)").alias("n")), ink, 4).drop("chunk")


@query("coverage_profile", v.BOXES, sql="SELECT s.page_id, CAST(s.x AS INT) AS x, count(b.page_id) AS n FROM (SELECT page_id, unnest(range(min(x0), max(x1) + 1)) AS x FROM v_boxes GROUP BY 1) s LEFT JOIN v_boxes b ON s.page_id = b.page_id AND s.x BETWEEN b.x0 AND b.x1 GROUP BY 1, 2")
def coverage_profile(spark, d):
    """How many of an order's boxes stand over every column."""
    return raster.coverage_profile(v.boxes(spark, d))


# Boxes

CHUNKS = """fl AS (SELECT *, CASE WHEN x0 <= max(x1) OVER (PARTITION BY page_id ORDER BY x0, box_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens FROM v_boxes),
 nu AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY page_id ORDER BY x0, box_id ROWS UNBOUNDED PRECEDING) - 1 AS INT) AS chunk FROM fl),
 ch AS (SELECT page_id, chunk, min(x0) AS x0, max(x1) AS x1, min(y0) AS y0, max(y1) AS y1, CAST(sum(area) AS BIGINT) AS area FROM nu GROUP BY 1, 2)"""
MEDIANS = """hl AS (SELECT page_id, list_sort(list(y1 - y0 + 1)) AS al, list_sort(list(y1 - y0 + 1) FILTER (WHERE y1 - y0 + 1 >= 8)) AS ta FROM v_boxes GROUP BY 1),
 md AS (SELECT page_id, CASE WHEN len(ta) > 0 THEN ta[len(ta) // 2 + 1] ELSE al[len(al) // 2 + 1] END AS median_height FROM hl)"""
TOTALS = "tot AS (SELECT page_id, CAST(count(*) + 3 AS INT) AS total FROM v_boxes GROUP BY 1)"


def _chunks(spark, d):
    return bx.islands(v.boxes(spark, d))


def _totals(spark, d):
    return v.boxes(spark, d).groupBy("page_id").agg((F.count(F.lit(1)) + 3).cast("int").alias("total"))


@query("chunk_islands", v.BOXES, CHUNKS, sql="SELECT * FROM ch")
def chunk_islands(spark, d):
    return _chunks(spark, d)


@query("upper_median_height", v.BOXES, MEDIANS, sql="SELECT page_id, CAST(median_height AS INT) AS median_height FROM md")
def upper_median_height(spark, d):
    return bx.median_heights(v.boxes(spark, d))


@query(
    "debris_filter", v.BOXES, CHUNKS,
    sql="""SELECT page_id, chunk, x0, x1, y0, y1, area FROM (SELECT *, max(CASE WHEN solid THEN 1 ELSE 0 END) OVER (PARTITION BY page_id) AS anysolid FROM (SELECT ch.*, n, area >= CAST(upper * 0.15 AS DOUBLE) AS solid FROM ch JOIN
 (SELECT page_id, count(*) AS n, list_sort(list(area))[least(count(*) - 1, CAST(floor(count(*) * 0.75) AS BIGINT)) + 1] AS upper FROM ch GROUP BY 1) u ON ch.page_id = u.page_id) a) b WHERE n < 3 OR solid OR anysolid = 0""",
)
def debris_filter(spark, d):
    return bx.without_debris(_chunks(spark, d))


FAR = "far AS (SELECT page_id, box_id, x0, x1, y0 * 8 AS y0, y0 * 8 + (y1 - y0) AS y1, area FROM v_boxes)"


@query(
    "baseline_filter", v.BOXES, FAR,
    sql="""SELECT b.* FROM far b JOIN (SELECT page_id, list_sort(list((y0 + y1) / 2.0))[count(*) // 2 + 1] AS centre, greatest(100.0, 3.0 * list_sort(list(y1 - y0 + 1))[count(*) // 2 + 1]) AS reach FROM far GROUP BY 1) m
 ON b.page_id = m.page_id WHERE abs((y0 + y1) / 2.0 - centre) <= reach""",
)
def baseline_filter(spark, d):
    """Boxes near their page's baseline, on pages whose boxes stand far apart."""
    return bx.on_baseline(v.boxes(spark, d).withColumn("y1", F.expr("y0 * 8 + (y1 - y0)")).withColumn("y0", F.col("y0") * 8))


@query("border_reject", v.BOXES, sql="SELECT * FROM v_boxes WHERE x1 - x0 + 1 >= 4 AND y1 - y0 + 1 >= 4 AND x0 > 1 AND y0 > 1 AND x1 < 238 AND y1 < 78")
def border_reject(spark, d):
    return bx.inside_page(v.boxes(spark, d), 240, 80)


@query("widest_gap", v.BOXES, CHUNKS, sql="SELECT page_id, chunk, gap FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY gap DESC, chunk) AS rn FROM (SELECT page_id, chunk, x0 - lag(x1) OVER (PARTITION BY page_id ORDER BY chunk) AS gap FROM ch) a WHERE gap IS NOT NULL) b WHERE rn = 1")
def widest_gap(spark, d):
    return bx.widest_gaps(_chunks(spark, d))


@query(
    "apportion_chars", v.BOXES, CHUNKS, TOTALS,
    sql="""SELECT page_id, chunk, CAST(1 + sum(CASE WHEN rn <= total - m THEN 1 ELSE 0 END) AS INT) AS n FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY w / CAST(k AS DOUBLE) DESC, chunk, k) AS rn FROM
 (SELECT c.page_id, chunk, total, x1 - x0 + 1 AS w, m, unnest(range(1, greatest(1, total - m) + 1)) AS k FROM (SELECT *, count(*) OVER (PARTITION BY page_id) AS m FROM ch) c JOIN tot ON c.page_id = tot.page_id) a) b GROUP BY 1, 2""",
)
def apportion_chars(spark, d):
    return bx.allocated(_chunks(spark, d), _totals(spark, d))


PROXIMITY = f"""RECURSIVE {v.BOXES}, gm AS (SELECT page_id, greatest(4.0, coalesce(nullif(list_sort(list(y1 - y0 + 1))[count(*) // 2 + 1], 0), 1) * 0.36) AS grow FROM v_boxes GROUP BY 1),
 ed AS (SELECT a.page_id, a.box_id AS a, b.box_id AS b FROM v_boxes a JOIN v_boxes b ON a.page_id = b.page_id JOIN gm ON a.page_id = gm.page_id
  WHERE least(a.x1, b.x1) - greatest(a.x0, b.x0) + 2 * grow >= 0 AND least(a.y1, b.y1) - greatest(a.y0, b.y0) + 2 * grow >= 0),
 re AS (SELECT page_id, box_id AS s, box_id AS t FROM v_boxes UNION SELECT re.page_id, re.s, ed.b FROM re JOIN ed ON re.page_id = ed.page_id AND re.t = ed.a),
 ro AS (SELECT page_id, t AS box_id, min(s) AS group_id FROM re GROUP BY 1, 2)"""


@query("proximity_groups", PROXIMITY, sql="SELECT b.page_id, group_id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, CAST(sum(area) AS BIGINT) AS area, count(*) AS n FROM v_boxes b JOIN ro ON b.page_id = ro.page_id AND b.box_id = ro.box_id GROUP BY 1, 2")
def proximity_groups(spark, d):
    return bx.proximity_groups(v.boxes(spark, d))


MERGES = """SELECT page_id, a, b, dist FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY dist, a, b) AS rn FROM (SELECT p.page_id, p.box_id AS a, q.box_id AS b,
 greatest(0, greatest(p.y0, q.y0) - least(p.y1, q.y1) - 1) + greatest(0, greatest(p.x0, q.x0) - least(p.x1, q.x1) - 1) AS dist,
 least(p.x1, q.x1) - greatest(p.x0, q.x0) + 1 AS ox, least(p.y1, q.y1) - greatest(p.y0, q.y0) + 1 AS oy, least(p.y1 - p.y0, q.y1 - q.y0) AS lowest, greatest(p.y1 - p.y0, q.y1 - q.y0) AS tallest,
 least(p.x1 - p.x0, q.x1 - q.x0) + 1 AS narrow, greatest(p.x1, q.x1) - least(p.x0, q.x0) + 1 AS wide, median_height AS m
 FROM v_boxes p JOIN v_boxes q ON p.page_id = q.page_id AND p.box_id < q.box_id JOIN md ON p.page_id = md.page_id) x
 WHERE (lowest + 1 < 0.5 * m AND ox > 0.5 * narrow AND greatest(0, -oy) < 0.8 * m) OR (tallest < 0.5 * m AND oy > 0 AND greatest(0, -ox) < 0.3 * m) OR (ox > 0 AND oy >= 0.6 * (lowest + 1) AND wide <= 1.6 * m)) y WHERE rn = 1"""


@query("merge_candidates", v.BOXES, MEDIANS, sql=MERGES)
def merge_candidates(spark, d):
    return bx.merge_candidates(v.boxes(spark, d))


@query(
    "hit_test", v.BOXES,
    sql="""SELECT page_id, px, py, box_id FROM (SELECT p.page_id, px, py, box_id, row_number() OVER (PARTITION BY p.page_id, px, py ORDER BY (x1 - x0 + 1) * (y1 - y0 + 1), box_id) AS rn
 FROM (SELECT o_orderkey AS page_id, CAST(o_custkey % 240 AS INT) AS px, CAST(o_orderkey % 80 AS INT) AS py FROM orders) p JOIN v_boxes b ON p.page_id = b.page_id AND px BETWEEN x0 AND x1 AND py BETWEEN y0 AND y1) x WHERE rn = 1""",
)
def hit_test(spark, d):
    points = v.read(spark, d, "orders").select(F.col("o_orderkey").alias("page_id"), F.expr("int(o_custkey % 240)").alias("px"), F.expr("int(o_orderkey % 80)").alias("py"))
    return bx.hit(points, v.boxes(spark, d))


@query("merge_parts")
def merge_parts(spark, d):
    return kernels.merged_parts(v.boxes(spark, d))


@query("reading_order")
def reading_order(spark, d):
    return kernels.reading_order(v.boxes(spark, d))


LINES = """an AS (SELECT page_id, box_id, 10 * y0 + 3 * (y1 - y0) AS c FROM v_boxes),
 pr AS (SELECT page_id, box_id, row_number() OVER w AS i, CAST(sum(c) OVER w AS DOUBLE) AS s1, CAST(sum(c * c) OVER w AS DOUBLE) AS s2, count(*) OVER (PARTITION BY page_id) AS n FROM an WINDOW w AS (PARTITION BY page_id ORDER BY c, box_id ROWS UNBOUNDED PRECEDING)),
 la AS (SELECT * FROM pr WHERE i = n AND n > 3),
 cu AS (SELECT la.page_id, p.i AS i, q.i AS j, ((p.s2 - p.s1 * p.s1 / p.i) + ((q.s2 - p.s2) - (q.s1 - p.s1) * (q.s1 - p.s1) / (q.i - p.i))) + ((la.s2 - q.s2) - (la.s1 - q.s1) * (la.s1 - q.s1) / (la.n - q.i)) AS cost
  FROM la JOIN pr p ON la.page_id = p.page_id JOIN pr q ON la.page_id = q.page_id WHERE p.i < q.i AND q.i < la.n),
 be AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY cost, j, i) AS rn FROM cu) x WHERE rn = 1)"""


@query("split_lines", v.BOXES, LINES, sql="SELECT pr.page_id, box_id, CAST(CASE WHEN n <= 3 THEN pr.i - 1 WHEN pr.i <= be.i THEN 0 WHEN pr.i <= be.j THEN 1 ELSE 2 END AS INT) AS line FROM pr LEFT JOIN be ON pr.page_id = be.page_id")
def split_lines(spark, d):
    return kernels.text_lines(v.boxes(spark, d), 3)


PARTS = """tw AS (SELECT page_id, count(*) AS n, max(x1) - min(x0) + 1 AS span FROM ch GROUP BY 1),
 r2 AS (SELECT c.page_id, c.chunk + 1 AS i, (max(c.x1) OVER (PARTITION BY c.page_id ORDER BY c.chunk ROWS UNBOUNDED PRECEDING) - min(c.x0) OVER (PARTITION BY c.page_id) + 1) / (span / 2.0) AS left_r,
   (max(c.x1) OVER (PARTITION BY c.page_id) - lead(c.x0) OVER (PARTITION BY c.page_id ORDER BY c.chunk) + 1) / (span / 2.0) AS right_r, n FROM ch c JOIN tw ON c.page_id = tw.page_id WHERE n > 2),
 bp AS (SELECT page_id, i FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY (left_r - 1) * (left_r - 1) + CASE WHEN left_r > 2.2 THEN 20 ELSE 0 END + ((right_r - 1) * (right_r - 1) + CASE WHEN right_r > 2.2 THEN 20 ELSE 0 END), i) AS rn FROM r2 WHERE i < n) x WHERE rn = 1),
 cl AS (SELECT c.*, CAST(CASE WHEN i IS NULL THEN chunk WHEN chunk < i THEN 0 ELSE 1 END AS INT) AS cell FROM ch c LEFT JOIN bp ON c.page_id = bp.page_id)"""


@query("partition_chunks", v.BOXES, CHUNKS, PARTS, sql="SELECT page_id, cell, min(x0) AS x0, max(x1) AS x1, min(y0) AS y0, max(y1) AS y1, CAST(sum(area) AS BIGINT) AS area FROM cl GROUP BY 1, 2")
def partition_chunks(spark, d):
    chunks = _chunks(spark, d)
    return kernels.partitioned(chunks, chunks.select("page_id").distinct().withColumn("total", F.lit(2)))


@query("cut_line")
def cut_line(spark, d):
    return kernels.line_cells(v.ink(spark, d), 3).select("page_id", "cell", "x_from", "x_to", "y0")


@query("carve_seam")
def carve_seam(spark, d):
    cells = kernels.line_cells(v.ink(spark, d), 2).where("seam_right is not null")
    return cells.select("page_id", "y0", F.posexplode("seam_right").alias("row", "x")).select("page_id", (F.col("y0") + F.col("row")).alias("y"), "x")


@query("character_cells")
def character_cells(spark, d):
    """Every order's boxes cut into the characters that its document's lines expect."""
    boxes = v.boxes(spark, d)
    lines = text.expected_lines(v.read(spark, d, "documents"), "doc_id", "text").select(F.col("id").alias("page_id"), "line", "chars")
    return pages.character_cells(boxes, lines, v.ink(spark, d))


@query("freehand_page_cells")
def freehand_page_cells(spark, d):
    """Rasters side by side as pages of 64 by 64 pixels, cut on the thin mask into their document's lines, read from the full one."""
    pixels = v.pixels(spark, d).select(F.expr("page_id div 64").alias("page_id"), F.expr("int(page_id % 64 div 8 * 8 + y)").alias("y"), F.expr("int(page_id % 8 * 8 + x)").alias("x"), "gray")
    thin, full = (pixels.where(F.col("gray") < most).drop("gray") for most in (85, v.INK))
    lines = text.expected_lines(v.read(spark, d, "documents"), "doc_id", "text").select(F.col("id").alias("page_id"), "line", "chars")
    cells = pages.character_cells(graph.components(thin, 2), lines, thin, full)
    return cells.select("page_id", "line", "cell", "x0", "y0", "x1", "y1", "area", "seam_y0", *(F.col(f"core.{c}").alias(f"core_{c}") for c in ("x0", "y0", "x1", "y1")))


# Ownership, over the components of the rasters' ink.

LAB = "lab AS (SELECT page_id, y, x, root FROM comp)"
TALLY = "ta AS (SELECT l.page_id, root, box_id, count(*) AS here FROM lab l JOIN v_small b ON l.page_id = b.page_id AND x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY 1, 2, 3)"
OWNER = "ow AS (SELECT page_id, root, box_id AS owner FROM (SELECT *, row_number() OVER (PARTITION BY page_id, root ORDER BY here DESC, box_id) AS rn FROM ta) x WHERE rn = 1), ar AS (SELECT page_id, root, count(*) AS area FROM lab GROUP BY 1, 2)"
KEEP = """ke AS (SELECT ta.page_id, ta.root, ta.box_id, here, area, owner, here >= 0.005 * max(here) OVER (PARTITION BY ta.page_id, ta.box_id) AND (owner = ta.box_id OR here >= 0.25 * area) AS kept
 FROM ta JOIN ar ON ta.page_id = ar.page_id AND ta.root = ar.root JOIN ow ON ta.page_id = ow.page_id AND ta.root = ow.root)"""
AUDIT = """ob AS (SELECT ar.page_id, owner AS box_id, CAST(sum(area) AS BIGINT) AS owned FROM ar JOIN ow ON ar.page_id = ow.page_id AND ar.root = ow.root GROUP BY 1, 2),
 kb AS (SELECT page_id, box_id, CAST(sum(CASE WHEN owner = box_id THEN here ELSE 0 END) AS BIGINT) AS kept_own, CAST(sum(CASE WHEN owner <> box_id THEN here ELSE 0 END) AS BIGINT) AS kept_foreign FROM ke WHERE kept GROUP BY 1, 2),
 au AS (SELECT b.page_id, b.box_id, coalesce(owned, 0) AS owned, coalesce(kept_own, 0) AS kept_own, coalesce(kept_foreign, 0) AS kept_foreign FROM v_small b LEFT JOIN ob ON b.page_id = ob.page_id AND b.box_id = ob.box_id LEFT JOIN kb ON b.page_id = kb.page_id AND b.box_id = kb.box_id)"""


def _labelled(spark, d):
    return graph.labelled_pixels(v.ink(spark, d))


def _small(spark, d):
    return v.small_boxes(spark, d)


@query("pixel_in_box", v.BOXES, v.SMALL, v.PIXELS, sql="SELECT b.page_id, box_id, y, x FROM v_ink i JOIN v_small b ON i.page_id = b.page_id AND x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1")
def pixel_in_box(spark, d):
    return ownership.pixels_in_boxes(v.ink(spark, d), _small(spark, d), 4).select("page_id", "box_id", "y", "x")


@query("component_tally", REACH, v.BOXES, v.SMALL, LAB, TALLY, sql="SELECT * FROM ta")
def component_tally(spark, d):
    return ownership.tallies(_labelled(spark, d), _small(spark, d), 4)


@query("assign_owner", REACH, v.BOXES, v.SMALL, LAB, TALLY, OWNER, sql="SELECT page_id, root, owner FROM ow")
def assign_owner(spark, d):
    return ownership.owners(ownership.tallies(_labelled(spark, d), _small(spark, d), 4))


@query("crop_keep", REACH, v.BOXES, v.SMALL, LAB, TALLY, OWNER, KEEP, sql="SELECT page_id, root, box_id, here, area, kept FROM ke")
def crop_keep(spark, d):
    labelled = _labelled(spark, d)
    return ownership.keep_rule(ownership.tallies(labelled, _small(spark, d), 4), labelled)


@query("crop_pixels", REACH, v.BOXES, v.SMALL, LAB, TALLY, OWNER, KEEP, sql="SELECT l.page_id, k.box_id, l.y, l.x, l.root FROM lab l JOIN ke k ON l.page_id = k.page_id AND l.root = k.root AND kept JOIN v_small b ON b.page_id = l.page_id AND b.box_id = k.box_id AND x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1")
def crop_pixels(spark, d):
    return ownership.crop_pixels(_labelled(spark, d), _small(spark, d), 4)


@query(
    "audit_report", REACH, v.BOXES, v.SMALL, LAB, TALLY, OWNER, KEEP, AUDIT,
    sql="SELECT *, owned - kept_own AS missing, CASE WHEN owned > 0 THEN (owned - kept_own) / owned ELSE 0.0 END AS clipped, CASE WHEN kept_own + kept_foreign > 0 THEN kept_foreign / (kept_own + kept_foreign) ELSE 0.0 END AS foreign FROM au",
)
def audit_report(spark, d):
    return ownership.audit(_labelled(spark, d), _small(spark, d), 4)


@query("orphan_share", REACH, v.BOXES, v.SMALL, LAB, TALLY, OWNER, sql="SELECT page_id, CAST(sum(CASE WHEN owner IS NULL THEN area ELSE 0 END) AS BIGINT) AS orphan, CAST(sum(area) AS BIGINT) AS total, sum(CASE WHEN owner IS NULL THEN area ELSE 0 END) / sum(area) AS share FROM ar LEFT JOIN ow USING (page_id, root) GROUP BY 1")
def orphan_share(spark, d):
    return ownership.orphans(_labelled(spark, d), _small(spark, d), 4)


@query(
    "propose_boxes", REACH, v.BOXES, v.SMALL, LAB, TALLY, OWNER,
    sql="""SELECT b.page_id, b.box_id, least(x0, ex0) AS x0, least(y0, ey0) AS y0, greatest(x1, ex1) AS x1, greatest(y1, ey1) AS y1 FROM v_small b JOIN
 (SELECT l.page_id, owner AS box_id, min(x) AS ex0, min(y) AS ey0, max(x) AS ex1, max(y) AS ey1 FROM lab l JOIN ow ON l.page_id = ow.page_id AND l.root = ow.root GROUP BY 1, 2) e ON b.page_id = e.page_id AND b.box_id = e.box_id
 WHERE ex0 < x0 OR ey0 < y0 OR ex1 > x1 OR ey1 > y1""",
)
def propose_boxes(spark, d):
    return ownership.proposals(_labelled(spark, d), _small(spark, d), 4)


@query("refine_loop")
def refine_loop(spark, d):
    return refine.refined(graph.labelled_pixels(v.ink(spark, d)), _small(spark, d), 4)


# Labels

ZIP = "z AS (SELECT b.page_id, b.box_id, ch FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY box_id) - 1 AS o FROM v_boxes) b JOIN v_chars c ON b.page_id = c.page_id AND b.o = c.ordinal)"


def _zip(spark, d):
    return text.zipped(v.boxes(spark, d).select("page_id", "box_id"), v.texts(spark, d))


@query("zip_labels", v.BOXES, v.CHARS, ZIP, sql="SELECT * FROM z")
def zip_labels(spark, d):
    return _zip(spark, d)


@query("first_wins", v.CHARS, sql="SELECT page_id, ordinal, ch FROM (SELECT *, row_number() OVER (PARTITION BY page_id, ch ORDER BY ordinal) AS rn FROM v_chars) a WHERE rn = 1")
def first_wins(spark, d):
    return text.first_characters(v.texts(spark, d))


BANDED = [(c, lo, hi) for cs, lo, hi in dims.BANDS for c in cs]
CHARSET = [(c,) for c in dims.SPANISH]


@query("absent_chars", v.CHARS, sql=f"SELECT DISTINCT ch FROM v_chars WHERE ch NOT IN (SELECT ch FROM {dims.values(CHARSET, 'ch')})")
def absent_chars(spark, d):
    return text.absent(text.first_characters(v.texts(spark, d)), spark.createDataFrame(CHARSET, "ch string"))


@query("missing_letters", v.CHARS, sql=f"SELECT page_id, ch FROM (SELECT DISTINCT page_id FROM v_chars) p, {dims.values([(c,) for c in dims.MINIMAL], 'ch')} EXCEPT SELECT page_id, ch FROM v_chars")
def missing_letters(spark, d):
    """Characters of the minimal set, a fixed 79, that a document lacks."""
    chars = text.first_characters(v.texts(spark, d)).select("page_id", "ch")
    wanted = chars.select("page_id").distinct().select("page_id", F.explode(F.split(F.lit(dims.MINIMAL), "")).alias("ch")).where("ch <> ''")
    return wanted.join(chars, ["page_id", "ch"], "left_anti")


@query(
    "override_boxes", v.BOXES,
    sql="""SELECT page_id, box_id, CASE WHEN o THEN greatest(0, least(239, least(x1 + 3, x0 - 3))) ELSE x0 END AS x0, CASE WHEN o THEN greatest(0, least(79, least(y1 + 3, y0 - 3))) ELSE y0 END AS y0,
 CASE WHEN o THEN greatest(0, least(239, greatest(x1 + 3, x0 - 3))) ELSE x1 END AS x1, CASE WHEN o THEN greatest(0, least(79, greatest(y1 + 3, y0 - 3))) ELSE y1 END AS y1, o AS pinned FROM (SELECT *, box_id % 3 = 1 AS o FROM v_boxes) a""",
)
def override_boxes(spark, d):
    boxes = v.boxes(spark, d)
    given = boxes.where("box_id % 3 = 1").select("page_id", "box_id", F.expr("x1 + 3").alias("ox0"), F.expr("y0 - 3").alias("oy0"), F.expr("x0 - 3").alias("ox1"), F.expr("y1 + 3").alias("oy1"))
    return bx.overridden(boxes, given, 240, 80)


@query(
    "expected_lines",
    sql=r"""SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY pos) - 1 AS INT) AS line, chars, CAST(length(chars) AS INT) AS n FROM (SELECT id, pos, regexp_replace(ls[pos], '\s+', '', 'g') AS chars FROM (SELECT id, ls, unnest(range(1, len(ls) + 1)) AS pos FROM
 (SELECT doc_id AS id, regexp_split_to_array(nfc_normalize(text), '\r?\n|\\n|/') AS ls FROM documents) a) b) c WHERE chars <> ''""",
)
def expected_lines(spark, d):
    return text.expected_lines(v.read(spark, d, "documents"), "doc_id", "text")


@query("char_bands", v.CHARS, sql=f"SELECT c.ch, n, coalesce(bottom, 0) AS bottom, coalesce(top, 700) AS top FROM (SELECT ch, count(*) AS n FROM v_chars GROUP BY 1) c LEFT JOIN (SELECT * FROM {dims.values(BANDED, 'ch, bottom, top')}) b ON c.ch = b.ch")
def char_bands(spark, d):
    return layout.with_bands(v.chars(spark, d).groupBy("ch").agg(F.count(F.lit(1)).alias("n")), dims.bands(spark))


GLYPHS = f"gl AS (SELECT z.page_id, z.box_id, z.ch, x1 - x0 + 1 AS w, y1 - y0 + 1 AS h, coalesce(bottom, 0) AS lo, coalesce(top, 700) AS hi FROM z JOIN v_boxes b ON z.page_id = b.page_id AND z.box_id = b.box_id LEFT JOIN (SELECT * FROM {dims.values(BANDED, 'ch, bottom, top')}) t ON z.ch = t.ch)"


@query("glyph_metrics", v.BOXES, v.CHARS, ZIP, GLYPHS, sql="SELECT page_id, box_id, ch, CAST(floor((hi - lo) / CAST(h AS DOUBLE) * 1000 + 0.5) AS BIGINT) AS scale_milli, CAST(hi AS BIGINT) AS dy, CAST(floor(100 + w * ((hi - lo) / CAST(h AS DOUBLE)) + 0.5) AS INT) AS advance FROM gl")
def glyph_metrics(spark, d):
    boxes = v.boxes(spark, d).select("page_id", "box_id", F.expr("x1 - x0 + 1").alias("ink_w"), F.expr("y1 - y0 + 1").alias("ink_h"))
    placed = layout.placement(layout.with_bands(text.zipped_text(boxes, v.bare_texts(spark, d)), dims.bands(spark)))
    return placed.select("page_id", "box_id", "ch", half_up(F.col("scale") * 1000).alias("scale_milli"), F.col("dy").cast("long").alias("dy"), "advance")


# Text layout. A character's advance is 400 and what its band is high.

ADVANCES = {c: 400 + (hi - lo) // 4 for c, lo, hi in BANDED}
ADV = f"ad AS (SELECT * FROM {dims.values(sorted(ADVANCES.items()), 'ch, advance')})"
SPLIT = "tx AS (SELECT conv_id * 1000 + turn AS line_id, string_split(text, '') AS cs FROM conversations), ci AS (SELECT line_id, CAST(i - 1 AS INT) AS ordinal, cs[i] AS ch FROM (SELECT line_id, cs, unnest(range(1, len(cs) + 1)) AS i FROM tx) a WHERE cs[i] <> '')"


@query("text_layout", ADV, SPLIT, sql="SELECT line_id, ordinal, ci.ch, CAST(coalesce(sum(coalesce(advance, CASE WHEN ci.ch = ' ' THEN 300 ELSE 500 END)) OVER (PARTITION BY line_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pen FROM ci LEFT JOIN ad ON ci.ch = ad.ch")
def text_layout(spark, d):
    turns = v.read(spark, d, "conversations").select(F.expr("conv_id * 1000 + turn").alias("line_id"), F.posexplode(F.split("text", "")).alias("ordinal", "ch")).where("ch <> ''")
    return layout.pen_positions(turns, spark.createDataFrame(sorted(ADVANCES.items()), "ch string, advance int"))


WORDS = r"""wd AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS ws FROM conversations),
 ww AS (SELECT conv_id, turn, i, ws[i] AS word FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM wd) a),
 cw AS (SELECT word, CAST(sum(coalesce(advance, 500)) AS INT) AS width FROM (SELECT word, unnest(string_split(word, '')) AS ch FROM (SELECT DISTINCT word FROM ww) b) c LEFT JOIN ad USING (ch) WHERE ch <> '' GROUP BY 1),
 wo AS MATERIALIZED (SELECT conv_id, turn, i, word, width FROM ww JOIN cw USING (word)),
 fit AS (SELECT conv_id, turn, n, size, i, CAST(0 AS INT) AS line, width AS w FROM wo, sz WHERE i = 1 UNION ALL
  SELECT f.conv_id, f.turn, f.n, f.size, o.i, CASE WHEN f.w + 300 + o.width <= {0} THEN f.line ELSE f.line + 1 END, CASE WHEN f.w + 300 + o.width <= {0} THEN f.w + 300 + o.width ELSE o.width END
  FROM fit f JOIN wo o ON f.conv_id = o.conv_id AND f.turn = o.turn AND o.i = f.i + 1)"""


@query("word_wrap", f"RECURSIVE {ADV}", "sz AS (SELECT 0 AS n, 0 AS size)", WORDS.format(30_000), sql="SELECT conv_id, turn, line, CAST(count(*) AS INT) AS words, max(w) AS width FROM fit GROUP BY 1, 2, 3")
def word_wrap(spark, d):
    turns = v.read(spark, d, "conversations").select("conv_id", "turn", layout.word_widths(F.col("text"), ADVANCES).alias("words"))
    return turns.select("conv_id", "turn", F.explode(layout.wrapped(F.col("words"), 30_000)).alias("l")).select("conv_id", "turn", "l.line", "l.words", "l.width")


# A letter of the preview is the rectangle of its band; every third advance has no outline.
DRAWN = [(c, "" if ADVANCES[c] % 3 == 0 else f"M0 {lo}L{ADVANCES[c] - 100} {lo}L{ADVANCES[c] - 100} {hi}L0 {hi}Z", ADVANCES[c]) for c, lo, hi in {c: (c, lo, hi) for c, lo, hi in BANDED}.values()]
PREVIEW = """li AS (SELECT f.conv_id, f.turn, n, size, line, string_agg(word, ' ' ORDER BY f.i) AS t FROM fit f JOIN wo o ON f.conv_id = o.conv_id AND f.turn = o.turn AND f.i = o.i GROUP BY 1, 2, 3, 4, 5),
 hs AS (SELECT conv_id, turn, n, CAST(size * (15 + 14 * count(*)) AS BIGINT) AS h FROM li GROUP BY conv_id, turn, n, size),
 ys AS (SELECT conv_id, turn, n, CAST(400 + sum(h) OVER (PARTITION BY conv_id, turn ORDER BY n) - h AS BIGINT) AS top, CAST(400 + sum(h) OVER (PARTITION BY conv_id, turn) AS BIGINT) AS bottom FROM hs),
 pe AS (SELECT conv_id, turn, n, size, line, o, ch, CAST(coalesce(sum(coalesce(advance, CASE WHEN ch = ' ' THEN 300 ELSE 500 END)) OVER (PARTITION BY conv_id, turn, n, line ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pen
  FROM (SELECT conv_id, turn, n, size, line, o, cs[o] AS ch FROM (SELECT *, string_split(t, '') AS cs, unnest(range(1, len(string_split(t, '')) + 1)) AS o FROM li) q) r LEFT JOIN ad USING (ch)),
 mk AS (SELECT p.conv_id, p.turn, p.n, line, o, '<path transform="translate(' || (40000 + pen * size + 50) // 100 // 10 || '.' || (40000 + pen * size + 50) // 100 % 10 || ',' || (top + size * (11 + 14 * line)) // 10 || '.' || (top + size * (11 + 14 * line)) % 10 ||
  ') scale(0.' || lpad(CAST(size * 10 AS VARCHAR), 4, '0') || ',-0.' || lpad(CAST(size * 10 AS VARCHAR), 4, '0') || ')" d="' || d || '" fill="#111" fill-rule="evenodd"/>' AS mark
  FROM pe p JOIN dr USING (ch) JOIN ys y ON p.conv_id = y.conv_id AND p.turn = y.turn AND p.n = y.n WHERE d <> '')"""


@query(
    "preview_waterfall", f"RECURSIVE {ADV}", f"dr AS (SELECT ch, d FROM {dims.values(DRAWN, 'ch, d, advance')})", f"sz AS (SELECT * FROM {dims.values(list(enumerate(layout.SIZES)), 'n, size')})", WORDS.format("1200000 // f.size"), PREVIEW,
    sql="""SELECT y.conv_id * 1000 + y.turn AS page_id, '<svg width="1280" height="' || (max(bottom) + 409) // 10 || '" xmlns="http://www.w3.org/2000/svg"><rect width="100%" height="100%" fill="#fff"/>' || coalesce(string_agg(mark, '' ORDER BY y.n, line, o), '') || '</svg>' AS svg
 FROM ys y LEFT JOIN mk ON y.conv_id = mk.conv_id AND y.turn = mk.turn AND y.n = mk.n GROUP BY y.conv_id, y.turn""",
)
def preview_waterfall(spark, d):
    """Every turn of a conversation as outlines in four sizes."""
    texts = v.read(spark, d, "conversations").select(F.expr("conv_id * 1000 + turn").alias("page_id"), "text")
    return layout.waterfall(texts, spark.createDataFrame(DRAWN, "ch string, d string, advance int"))


@query("uncovered_chars", sql=r"SELECT DISTINCT ch FROM (SELECT unnest(string_split(regexp_replace(upper(replace(regexp_replace(t, '<[^>]+>', '', 'g'), 'ß', 'SS')), '\s', '', 'g'), '')) AS ch FROM (SELECT unnest(regexp_extract_all(html, '(?s)<h1[^>]*>(.*?)</h1>', 1)) AS t FROM pages) a) b WHERE ch <> '' AND ch NOT IN (SELECT ch FROM " + dims.values([(c,) for c in dims.MINIMAL], "ch") + ")")
def uncovered_chars(spark, d):
    """Characters that the headings of all pages need and the minimal set does not cover."""
    needed = text.display_chars(v.read(spark, d, "pages"), "page_id", "html", r"(?s)<h1[^>]*>(.*?)</h1>")
    return text.absent(needed, spark.createDataFrame([(c,) for c in dims.MINIMAL], "ch string"))


@query("html_needed_chars", sql=r"SELECT DISTINCT id, ch FROM (SELECT id, unnest(string_split(regexp_replace(upper(replace(regexp_replace(t, '<[^>]+>', '', 'g'), 'ß', 'SS')), '\s', '', 'g'), '')) AS ch FROM (SELECT page_id AS id, unnest(regexp_extract_all(html, '(?s)<h1[^>]*>(.*?)</h1>', 1)) AS t FROM pages) a) b WHERE ch <> ''")
def html_needed_chars(spark, d):
    return text.display_chars(v.read(spark, d, "pages"), "page_id", "html", r"(?s)<h1[^>]*>(.*?)</h1>")


# Hangul

SYL = f"""sy AS (SELECT row_id, codepoint, chr(codepoint) AS ch, substring('{dims.LEADS}', (codepoint - 44032) // 588 + 1, 1) AS lead, substring('{dims.VOWELS}', (codepoint - 44032) % 588 // 28 + 1, 1) AS vowel,
 CASE WHEN (codepoint - 44032) % 28 = 0 THEN '' ELSE substring('{dims.FINALS}', (codepoint - 44032) % 28, 1) END AS final FROM v_syll),
 ly AS (SELECT *, contains('{dims.UPRIGHT_VOWELS}', vowel) AS upright, final <> '' AS has_final FROM sy)"""


@query("hangul_decompose", v.SYLL, SYL, sql="SELECT row_id, codepoint, ch, lead, vowel, final FROM sy")
def hangul_decompose(spark, d):
    return v.syllables(spark, d).select("row_id", "codepoint", *compose.decomposed(F.col("codepoint")))


@query("hangul_layout_classes", v.SYLL, SYL, sql="SELECT upright, has_final, count(*) AS n, count(DISTINCT codepoint) AS syllables FROM ly GROUP BY 1, 2")
def hangul_layout_classes(spark, d):
    return compose.layouts(v.syllables(spark, d)).groupBy("upright", "has_final").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("codepoint").alias("syllables"))


def _parts(spark):
    """Letters as rectangles: leads and finals square, vowels tall or flat by their direction."""
    shape = F.when(F.col("role") == "V", F.when(F.col("ch").isin(*dims.UPRIGHT_VOWELS), F.struct(F.lit(300.0).alias("w"), F.lit(800.0).alias("h"))).otherwise(F.struct(F.lit(800.0).alias("w"), F.lit(200.0).alias("h")))).otherwise(F.struct(F.lit(400.0).alias("w"), F.lit(400.0).alias("h")))
    return dims.letters(spark).where("role <> 'X'").select("role", F.col("ch").alias("jamo"), shape.alias("s")).select("role", "jamo", F.lit(100.0).alias("x0"), F.lit(50.0).alias("y0"), (100 + F.col("s.w")).alias("x1"), (50 + F.col("s.h")).alias("y1"))


SLOT = f"""sl AS (SELECT * FROM {dims.values(dims.SLOTS, 'upright, has_final, role, sx, sy, sw, sh')}),
 pl AS (SELECT *, CASE WHEN role <> 'V' THEN 400.0 WHEN upright THEN 300.0 ELSE 800.0 END AS w, CASE WHEN role <> 'V' THEN 400.0 WHEN upright THEN 800.0 ELSE 200.0 END AS h FROM sl),
 kx AS (SELECT *, least(CAST(sw AS DOUBLE) / w, least(CAST(sw AS DOUBLE) / w, CAST(sh AS DOUBLE) / h) * 1.5) AS k, least(CAST(sh AS DOUBLE) / h, least(CAST(sw AS DOUBLE) / w, CAST(sh AS DOUBLE) / h) * 1.5) AS l FROM pl),
 bo AS (SELECT upright, has_final, role, floor((sx + (sw - w * k) / 2) * 10 + 0.5) AS x0, floor((1000 - (sy + (sh - h * l) / 2) - h * l) * 10 + 0.5) AS y0,
  floor((sx + (sw - w * k) / 2 + w * k) * 10 + 0.5) AS x1, floor((1000 - (sy + (sh - h * l) / 2)) * 10 + 0.5) AS y1 FROM kx)"""


@query(
    "hangul_compose_bbox", v.SYLL, SYL, SLOT,
    sql="SELECT codepoint, CAST(min(x0) AS BIGINT) AS x0, CAST(min(y0) AS BIGINT) AS y0, CAST(max(x1) AS BIGINT) AS x1, CAST(max(y1) AS BIGINT) AS y1, count(*) AS parts FROM (SELECT DISTINCT codepoint, upright, has_final FROM ly) s JOIN bo ON s.upright = bo.upright AND s.has_final = bo.has_final GROUP BY 1",
)
def hangul_compose_bbox(spark, d):
    syllables = v.syllables(spark, d).select("codepoint").distinct()
    parts = compose.composed(syllables, compose.placed_parts(_parts(spark), dims.slots(spark)))
    return parts.groupBy("codepoint").agg(F.min("bx0").alias("x0"), F.min("by0").alias("y0"), F.max("bx1").alias("x1"), F.max("by1").alias("y1"), F.count(F.lit(1)).alias("parts"))


NEEDED = "FROM sy WHERE codepoint % 28 < 20 AND codepoint < 50000"


@query(
    "missing_parts", v.SYLL, SYL,
    sql=f"SELECT item, role, ch, key FROM {dims.values([(i, r, c, f'{r}:{c}') for i, (r, c) in enumerate([('L', x) for x in dims.LEADS] + [('V', x) for x in dims.VOWELS] + [('T', x) for x in dims.FINALS])], 'item, role, ch, key')} WHERE key NOT IN (SELECT 'L:' || lead {NEEDED} UNION SELECT 'V:' || vowel {NEEDED} UNION SELECT 'T:' || final {NEEDED})",
)
def missing_parts(spark, d):
    """Letters that no syllable of any order needs, among the syllables of a smaller repertoire."""
    needed = v.syllables(spark, d).where("codepoint % 28 < 20 and codepoint < 50000")
    seen = compose.layouts(needed).select(F.explode(F.array(F.struct(F.lit("L").alias("role"), F.col("lead").alias("jamo")), F.struct(F.lit("V").alias("role"), F.col("vowel").alias("jamo")), F.struct(F.lit("T").alias("role"), F.col("final").alias("jamo")))).alias("p"))
    return compose.missing_parts(dims.letters(spark).where("role <> 'X'"), seen.select("p.role", "p.jamo").distinct())


@query(
    "text_sources", v.SYLL, SYL,
    sql="SELECT ch, CASE WHEN codepoint % 5 = 0 THEN 'written' ELSE 'composed' END AS source, CAST(CASE WHEN codepoint % 5 = 0 THEN 1 WHEN has_final THEN 3 ELSE 2 END AS BIGINT) AS parts FROM (SELECT DISTINCT ch, codepoint, has_final FROM ly) a",
)
def text_sources(spark, d):
    """What the distinct syllables of all orders are drawn from, every fifth code point written as itself."""
    chars = v.syllables(spark, d).select("codepoint", compose.decomposed(F.col("codepoint"))[0])
    return compose.for_text(chars, chars.where("codepoint % 5 = 0"), compose.placed_parts(_parts(spark), dims.slots(spark)))


# Sheets

@query("worksheet_cells", sql=f"SELECT p_partkey, key, CAST(item // 42 AS INT) AS page, CAST(item % 42 // 6 AS INT) AS row, CAST(item % 6 AS INT) AS col FROM part JOIN {dims.values([(i, f'{r}:{c}') for i, (r, c) in enumerate([('L', x) for x in dims.LEADS] + [('V', x) for x in dims.VOWELS] + [('T', x) for x in dims.FINALS] + [('X', x) for x in dims.EXTRAS])], 'item, key')} ON p_partkey % 84 = item")
def worksheet_cells(spark, d):
    parts = v.read(spark, d, "part").select("p_partkey", F.expr("int(p_partkey % 84)").alias("item"))
    return parts.join(F.broadcast(dims.letters(spark)), "item").select("p_partkey", "key", *layout.sheet_places(F.col("item")))


CELL = "SELECT p_partkey, {0} FROM (SELECT p_partkey, p_partkey % 6 AS col, p_partkey % 42 // 6 AS row, (600 + p_size * 10) / CAST(595.28 AS DOUBLE) AS sx, (850 + p_size * 14) / CAST(841.89 AS DOUBLE) AS sy, CAST(85.88 AS DOUBLE) AS cw, CAST(98.84142857142857 AS DOUBLE) AS ch FROM part) a".format(
    ", ".join(f"CAST(floor(({e}) + 0.5) AS INT) AS {n}" for n, e in (("x0", "(40 + col * cw) * sx"), ("y0", "(110 + row * ch) * sy"), ("x1", "(40 + col * cw + cw - 4) * sx"), ("y1", "(110 + row * ch + ch - 4) * sy")))
)


@query("cell_rects", sql=CELL)
def cell_rects(spark, d):
    places = v.read(spark, d, "part").select("p_partkey", F.expr("p_partkey % 6").alias("col"), F.expr("p_partkey % 42 div 6").alias("row"), F.expr("600 + p_size * 10").alias("width"), F.expr("850 + p_size * 14").alias("height"))
    return layout.cell_rectangles(places).select("p_partkey", "x0", "y0", "x1", "y1")


@query("review_sheets", v.BOXES, sql="SELECT page_id, box_id, CAST((row_number() OVER (PARTITION BY page_id ORDER BY box_id) - 1) // 7 AS INT) AS sheet FROM v_boxes")
def review_sheets(spark, d):
    return v.boxes(spark, d).select("page_id", "box_id", layout.sheet_of_review(F.col("box_id") - 1).alias("sheet"))


# Outlines

@query("shoelace_area", v.POLY, sql="SELECT poly_id, CAST(sum(x * ny - nx * y) AS BIGINT) AS area2 FROM (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM v_poly WINDOW w AS (PARTITION BY poly_id ORDER BY i)) a GROUP BY 1")
def shoelace_area(spark, d):
    return outline.doubled_areas(v.polygons(spark, d))


EDGES = "eg AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM v_poly WINDOW w AS (PARTITION BY poly_id ORDER BY i))"
WIND = """st AS (SELECT poly_id, poly_id // 4 AS group_id, x AS px, y AS py FROM v_poly WHERE i = 0),
 ins AS (SELECT s.group_id, s.poly_id, e.poly_id AS other, count(*) FILTER (WHERE (e.y > py) <> (e.ny > py) AND px < CAST((e.nx - e.x) * (py - e.y) AS DOUBLE) / nullif(e.ny - e.y, 0) + e.x) % 2 AS inn FROM st s JOIN eg e ON e.poly_id // 4 = s.group_id AND e.poly_id <> s.poly_id GROUP BY 1, 2, 3),
 de AS (SELECT group_id, poly_id, CAST(sum(inn) AS BIGINT) AS depth FROM ins GROUP BY 1, 2), aa AS (SELECT poly_id, sum(x * ny - nx * y) AS area2 FROM eg GROUP BY 1)"""


@query("winding_depth", v.POLY, EDGES, WIND, sql="SELECT st.group_id, st.poly_id, coalesce(depth, 0) AS depth, (area2 > 0) <> (coalesce(depth, 0) % 2 = 1) AS reverse FROM st LEFT JOIN de ON st.poly_id = de.poly_id JOIN aa ON st.poly_id = aa.poly_id")
def winding_depth(spark, d):
    polygons = v.polygons(spark, d)
    return outline.winding(polygons, polygons.select("poly_id").distinct().withColumn("group_id", F.expr("poly_id div 4")))


POINTS = "transform(sequence(0, size(embedding) div 2 - 1), i -> struct(bigint(floor(double(embedding[2 * i]) * 1000D)) as x, bigint(floor(double(embedding[2 * i + 1]) * 1000D)) as y))"
STEPS = """transform(sequence(0, size(p) - 1), i -> case when i = 0 then concat('m', p[i].x, ' ', p[i].y) when i % 5 = 1 then concat('l', p[i].x - p[i - 1].x, ',', p[i].y - p[i - 1].y)
 when i % 5 = 2 then concat(' ', p[i].x - p[i - 1].x, ' ', p[i].y - p[i - 1].y) when i % 5 = 3 then concat('V', p[i].y, 'h', p[i].x - p[i - 1].x) when i % 5 = 4 then concat('L', p[i].x, ' ', p[i].y) else concat('l', p[i].x - p[i - 1].x, ' ', p[i].y - p[i - 1].y) end)"""


@query(
    "path_grammar", v.POLY,
    sql="""SELECT poly_id, CAST(row_number() OVER (PARTITION BY poly_id ORDER BY i, half) - 1 AS INT) AS place, cmd, x, y FROM (SELECT poly_id, i, 1 AS half, CASE WHEN i = 0 THEN 'M' ELSE 'L' END AS cmd, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM v_poly
 UNION ALL SELECT poly_id, i, 0, 'L', CAST(before AS DOUBLE), CAST(y AS DOUBLE) FROM (SELECT *, lag(x) OVER (PARTITION BY poly_id ORDER BY i) AS before FROM v_poly) a WHERE i % 5 = 3
 UNION ALL SELECT DISTINCT poly_id, 32, 1, 'Z', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE) FROM v_poly) b""",
)
def path_grammar(spark, d):
    """Polygons written as relative, repeated, horizontal and vertical steps, read back as absolute segments."""
    steps = v.read(spark, d, "embeddings").select(F.col("vec_id").alias("poly_id"), F.expr(POINTS).alias("p")).select("poly_id", F.concat(F.array_join(F.expr(STEPS), ""), F.lit("z")).alias("d"))
    return steps.select("poly_id", F.posexplode(outline.parsed(F.col("d"))).alias("place", "s")).select("poly_id", "place", "s.cmd", "s.x", "s.y")


SUBS = """su AS (SELECT poly_id, 0 AS sub, i, CASE WHEN i IN (1, 2) THEN 3000 ELSE -3000 END AS x, CASE WHEN i > 1 THEN 3000 ELSE -3000 END AS y FROM (SELECT DISTINCT poly_id FROM v_poly) p, range(4) r(i)
 UNION ALL SELECT poly_id, 1, i, x, y FROM v_poly UNION ALL SELECT poly_id, 2, i, CAST(floor(x / 2.0) AS BIGINT), CAST(floor(y / 2.0) AS BIGINT) FROM v_poly WHERE i < 5),
 se AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM su WINDOW w AS (PARTITION BY poly_id, sub ORDER BY i)),
 sd AS (SELECT s.poly_id, s.sub, count(*) FILTER (WHERE (e.y > s.y) <> (e.ny > s.y) AND s.x < CAST((e.nx - e.x) * (s.y - e.y) AS DOUBLE) / nullif(e.ny - e.y, 0) + e.x) % 2 AS inn FROM su s JOIN se e ON s.poly_id = e.poly_id AND s.sub <> e.sub WHERE s.i = 0 GROUP BY s.poly_id, s.sub, e.sub),
 sr AS (SELECT a.poly_id, a.sub, (area2 > 0) <> (depth % 2 = 1) AS turn FROM (SELECT poly_id, sub, sum(x * ny - nx * y) AS area2 FROM se GROUP BY 1, 2) a JOIN (SELECT poly_id, sub, sum(inn) AS depth FROM sd GROUP BY 1, 2) b ON a.poly_id = b.poly_id AND a.sub = b.sub)"""


@query(
    "wound_paths", v.POLY, SUBS,
    sql="""SELECT poly_id, string_agg('M' || t || 'Z', '' ORDER BY sub) AS d FROM (SELECT s.poly_id, s.sub, string_agg(x || ' ' || y, 'L' ORDER BY CASE WHEN turn THEN -i ELSE i END) AS t FROM su s JOIN sr ON s.poly_id = sr.poly_id AND s.sub = sr.sub GROUP BY 1, 2) a GROUP BY 1""",
)
def wound_paths(spark, d):
    """A square, each polygon and half a corner of it as one path, every part turned as the nonzero rule wants it."""
    own = F.expr("concat('M', array_join(transform(p, q -> concat(q.x, ' ', q.y)), 'L'), 'Z')")
    half = F.expr("concat('M', array_join(transform(slice(p, 1, 5), q -> concat(floor(q.x / 2), ' ', floor(q.y / 2))), 'L'), 'Z')")
    paths = v.read(spark, d, "embeddings").select(F.col("vec_id").alias("poly_id"), F.expr(POINTS).alias("p")).select("poly_id", F.concat(F.lit("M-3000 -3000L3000 -3000L3000 3000L-3000 3000Z"), own, half).alias("d"))
    return outline.wound(paths, "poly_id", "d")


@query(
    "glyph_fragments", v.POLY,
    sql="""SELECT poly_id, '<path transform="translate(26.4,201.6) scale(0.1872,-0.1872)" d="M' || string_agg(x || ' ' || y, 'L' ORDER BY i) || 'Z" fill="#111" fill-rule="evenodd"/>' AS svg FROM v_poly WHERE poly_id % 4 <> 0 AND i < 6 GROUP BY 1""",
)
def glyph_fragments(spark, d):
    """The tile of every glyph that traced to something; every fourth polygon has traced to nothing."""
    points = v.polygons(spark, d).where("i < 6").groupBy("poly_id").agg(F.array_sort(F.collect_list(F.struct("i", "x", "y"))).alias("p"))
    glyphs = points.select("poly_id", F.expr("case when poly_id % 8 = 0 then '' when poly_id % 4 = 0 then null else concat('M', array_join(transform(p, q -> concat(q.x, ' ', q.y)), 'L'), 'Z') end").alias("d"))
    return records.with_outline(glyphs).select("poly_id", records.glyph_fragment(F.col("d"), 240).alias("svg"))


# Sinks as text

@query("svg_font_rows", v.SYLL, sql="SELECT row_id, codepoint, '<glyph glyph-name=\"uni' || upper(hex(codepoint)) || '\" unicode=\"&#x' || upper(hex(codepoint)) || ';\" horiz-adv-x=\"1000\"/>' AS xml FROM v_syll")
def svg_font_rows(spark, d):
    named = v.syllables(spark, d).withColumn("ch", compose.decomposed(F.col("codepoint"))[0])
    return named.select("row_id", "codepoint", F.format_string('<glyph glyph-name="%s" unicode="%s" horiz-adv-x="1000"/>', glyph_name(F.col("codepoint")), xml_escape(F.col("ch"))).alias("xml"))


@query("font_face_css", sql=r"""SELECT p_partkey, coalesce(nullif(regexp_replace(p_name, '[^A-Za-z0-9_-]', '', 'g'), ''), 'MyHand') AS font_id, '@font-face { font-family: ''' || regexp_replace(p_name, '([\\''])', '\\\1', 'g') || '''; font-display: swap; }' AS css FROM part""")
def font_face_css(spark, d):
    return v.read(spark, d, "part").select("p_partkey", font_id(F.col("p_name")).alias("font_id"), F.format_string("@font-face { font-family: '%s'; font-display: swap; }", css_escape(F.col("p_name"))).alias("css"))


@query(
    "svg_font_lines", v.SYLL,
    sql=f"""SELECT CAST(ordinal AS BIGINT) AS ordinal, line FROM (SELECT codepoint AS ordinal, '<glyph glyph-name="uni' || upper(hex(codepoint)) || '" unicode="&#x' || upper(hex(codepoint)) || ';" horiz-adv-x="1000" d="M0 0L' || (codepoint % 900 + 50) || ' 0Z"/>' AS line FROM (SELECT DISTINCT codepoint FROM v_syll) a
 UNION ALL SELECT * FROM {dims.values(sinks.svg_font_frame("Order Hand"), 'ordinal, line')}) b""",
)
def svg_font_lines(spark, d):
    """The SVG font of all orders' syllables, line by line."""
    glyphs = v.syllables(spark, d).select("codepoint").distinct().select("codepoint", compose.decomposed(F.col("codepoint"))[0], F.expr("'M0 0L' || (codepoint % 900 + 50) || ' 0Z'").alias("d"), F.lit(dims.UPM).alias("advance"))
    return sinks.svg_font(glyphs, "Order Hand")


FACE = r"""'@font-face {' || n || '  font-family: ''' || regexp_replace(family, '([\\''])', '\\\1', 'g') || ''';' || n || '  src: url(''' || base || '.woff2'') format(''woff2''),' || n || '       url(''' || base || '.woff'') format(''woff''),' || n
 || '       url(''' || base || '.ttf'') format(''truetype'');' || n || '  font-weight: normal;' || n || '  font-style: normal;' || n || '  font-display: swap;' || n || '}'"""


@query("font_stylesheet", sql=f"SELECT family, {FACE} AS css FROM (SELECT p_name || '''s' || chr(92) AS family, coalesce(nullif(regexp_replace(p_name, '[^A-Za-z0-9_-]', '', 'g'), ''), 'MyHand') AS base, chr(10) AS n FROM part) a")
def font_stylesheet(spark, d):
    """The stylesheet of a font for every part."""
    return sinks.stylesheet(v.read(spark, d, "part").select(F.concat("p_name", F.lit("'s\\")).alias("family"), font_id(F.col("p_name")).alias("base")))


QUOTED = "replace(replace(ch, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"')"


@query(
    "font_manifest", v.BOXES, v.CHARS, ZIP,
    sql=f"""SELECT page_id AS font, '{{"name":' || page_id || ',"unitsPerEm":1000,"glyphs":{{' || string_agg('"' || {QUOTED} || '":{{"d":"M' || box_id || ' 0Z","advance":' || (500 + box_id) || '}}', ',' ORDER BY encode(ch)) || '}}}}' AS json
 FROM (SELECT page_id, ch, min(box_id) AS box_id FROM z WHERE ch > ' ' GROUP BY 1, 2) a GROUP BY 1""",
)
def font_manifest(spark, d):
    """The manifest of a font for every page, its first boxes' characters for glyphs."""
    glyphs = text.first_uses(_zip(spark, d), "box_id").where("ch > ' '")
    return sinks.font_manifest(glyphs.select(F.col("page_id").alias("font"), "ch", F.format_string("M%d 0Z", "box_id").alias("d"), (F.col("box_id") + 500).alias("advance")))


@query("label_manifest", v.BOXES, v.CHARS, ZIP, sql=f"""SELECT page_id, '{{' || string_agg('"' || box_id || '":"' || {QUOTED} || '"', ',' ORDER BY box_id) || '}}' AS json FROM z WHERE ch > ' ' GROUP BY 1""")
def label_manifest(spark, d):
    """The labels of every page by box."""
    return sinks.label_manifest(_zip(spark, d).where("ch > ' '"))


# Records of a run

@query("running_ids", v.BOXES, sql="SELECT page_id, box_id, CAST(row_number() OVER (ORDER BY page_id, box_id) - 1 AS BIGINT) AS id FROM v_boxes")
def running_ids(spark, d):
    return records.running_ids(v.boxes(spark, d)).select("page_id", "box_id", "id")


LABELS = """lb AS (SELECT page_id, box_id, nfc_normalize(CASE box_id % 4 WHEN 0 THEN '' WHEN 1 THEN l_returnflag || chr(769) WHEN 2 THEN l_linestatus ELSE l_returnflag || l_linestatus END) AS ch FROM
 (SELECT l_orderkey AS page_id, l_linenumber AS box_id, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus FROM lineitem GROUP BY 1, 2) a)"""


@query(
    "labelled_by_id", v.BOXES, LABELS,
    sql=f"""SELECT page_id, box_id, x0, x1, ch FROM (SELECT b.page_id, b.box_id, x0, x1, ch, row_number() OVER (PARTITION BY b.page_id, ch ORDER BY b.box_id) AS rn FROM v_boxes b JOIN lb ON b.page_id = lb.page_id AND b.box_id = lb.box_id
 WHERE length(ch) = 1 AND ch IN (SELECT ch FROM {dims.values(CHARSET, 'ch')})) c WHERE rn = 1""",
)
def labelled_by_id(spark, d):
    """Boxes with their labels by id: composed, of one code point, of the Spanish set, the first of each on its page."""
    flags = v.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("box_id")).agg(F.min("l_returnflag").alias("r"), F.min("l_linestatus").alias("s"))
    labels = flags.select("page_id", "box_id", F.expr("case box_id % 4 when 0 then '' when 1 then r || '\u0301' when 2 then s else r || s end").alias("label"))
    return records.labelled_boxes(v.boxes(spark, d), labels, spark.createDataFrame(CHARSET, "ch string")).select("page_id", "box_id", "x0", "x1", "ch")


@query(
    "merge_overrides", v.BOXES,
    sql="""SELECT page_id, box_id, x0 + s AS x0, y0 AS y0, x1 + s AS x1, y1, box_id % 2 = 1 AND (s > 0 OR box_id % 3 <> 1) AS changed
 FROM (SELECT *, CASE WHEN box_id % 2 = 1 THEN CAST(page_id % 2 AS INT) ELSE 0 END AS s FROM v_boxes WHERE box_id % 3 = 1 OR box_id % 2 = 1) a""",
)
def merge_overrides(spark, d):
    """Overrides of every third box, then of every second one, moved by a pixel on odd pages."""
    boxes = v.boxes(spark, d)
    later = boxes.where("box_id % 2 = 1").withColumn("x0", F.expr("int(x0 + page_id % 2)")).withColumn("x1", F.expr("int(x1 + page_id % 2)"))
    return records.merged_overrides(boxes.where("box_id % 3 = 1"), later)


@query(
    "override_ink", v.BOXES, v.SMALL, v.PIXELS,
    sql="""SELECT b.page_id, b.box_id, count(i.x) AS area FROM (SELECT page_id, box_id, CASE WHEN o THEN greatest(0, x0 - 2) ELSE x0 END AS x0, CASE WHEN o THEN least(7, x1 + 1) ELSE x1 END AS x1, y0, y1
 FROM (SELECT *, box_id % 3 = 1 AS o FROM v_small) a) b LEFT JOIN v_ink i ON b.page_id = i.page_id AND x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY 1, 2""",
)
def override_ink(spark, d):
    small = _small(spark, d)
    given = small.where("box_id % 3 = 1").select("page_id", "box_id", F.expr("x1 + 1").alias("ox0"), F.col("y0").alias("oy0"), F.expr("x0 - 2").alias("ox1"), F.col("y1").alias("oy1"))
    return records.recounted(v.ink(spark, d), bx.overridden(small, given, SIDE, SIDE), 4)


@query("component_extents", REACH, v.BOXES, v.SMALL, LAB, TALLY, sql="SELECT page_id, root, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM lab WHERE (page_id, root) IN (SELECT (page_id, root) FROM ta) GROUP BY 1, 2")
def component_extents(spark, d):
    """Extents of the components that some box of their page holds a part of."""
    labelled = _labelled(spark, d)
    return records.extents(labelled, ownership.tallies(labelled, _small(spark, d), 4))


TENTHS = "CASE WHEN {1} > 0 THEN lpad(CAST((2000 * {0} + {1}) // (2 * {1}) // 10 AS VARCHAR) || '.' || CAST((2000 * {0} + {1}) // (2 * {1}) % 10 AS VARCHAR), 5, ' ') ELSE '  0.0' END"


@query(
    "audit_lines", REACH, v.BOXES, v.SMALL, LAB, TALLY, OWNER, KEEP, AUDIT,
    sql=f"""SELECT page_id, box_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY CASE WHEN owned > 0 THEN missing / owned ELSE 0 END DESC, box_id) AS INT) AS place,
 '  ' || lpad(CAST(box_id AS VARCHAR), 2, ' ') || '  clipped ' || {TENTHS.format('missing', 'owned')} || '%  foreign ' || {TENTHS.format('kept_foreign', 'kept')} || '%' ||
 CASE WHEN missing * 1000 <= 20 * owned THEN '' WHEN box_id % 2 = 0 THEN '  (pinned by hand)' ELSE '  <- clipped' END AS line
 FROM (SELECT *, owned - kept_own AS missing, kept_own + kept_foreign AS kept FROM au) a WHERE owned > 0 AND missing * 1000 >= 5 * owned OR kept > 0 AND kept_foreign * 1000 >= 100 * kept""",
)
def audit_lines(spark, d):
    """The audit's lines in their order; boxes of even numbers count as set by hand."""
    small = _small(spark, d)
    return records.report_lines(ownership.audit(_labelled(spark, d), small, 4), small.where("box_id % 2 = 0"))


@query(
    "glyph_by_crop", v.BOXES,
    sql="""SELECT g.page_id, g.source, b.box_id, b.x0, b.x1 FROM (SELECT o_orderkey AS page_id, 'crops/' || CAST(o_orderkey AS VARCHAR) || '-' || CAST(o_orderkey % 5 + 1 AS VARCHAR) || '.png' AS source FROM orders) g
 LEFT JOIN (SELECT *, 'crops/' || CAST(page_id AS VARCHAR) || '-' || CAST(box_id AS VARCHAR) || '.png' AS crop FROM v_boxes) b ON g.source = b.crop""",
)
def glyph_by_crop(spark, d):
    """One glyph an order, its source a crop that a box may have."""
    glyphs = v.read(spark, d, "orders").select(F.col("o_orderkey").alias("page_id"), F.expr("'crops/' || o_orderkey || '-' || (o_orderkey % 5 + 1) || '.png'").alias("source"))
    blobs = v.boxes(spark, d).select("box_id", "x0", "x1", F.expr("'crops/' || page_id || '-' || box_id || '.png'").alias("crop"))
    return records.by_crop(glyphs, blobs).select("page_id", "source", "box_id", "x0", "x1")


@query(
    "glyph_sheet", v.CHARS,
    sql="""SELECT page_id, ch, CAST(cx AS INT) AS cx, CAST(cy AS INT) AS cy, '<line x1="' || cx || '" y1="' || (cy + 88) || '" x2="' || (cx + 100) || '" y2="' || (cy + 88) || '" stroke="#bbe"/><text x="' || cx || '" y="' || (cy + 112) || '" font-size="12">'
 || replace(replace(ch, '&', '&amp;'), '<', '&lt;') || '</text>' AS caption FROM (SELECT page_id, ch, i % 10 * 120 + 10 AS cx, i // 10 * 120 AS cy FROM (SELECT page_id, ch, row_number() OVER (PARTITION BY page_id ORDER BY min(ordinal)) - 1 AS i FROM v_chars GROUP BY 1, 2) a) b""",
)
def glyph_sheet(spark, d):
    return records.glyph_sheet(text.first_characters(v.texts(spark, d)), "ordinal")


@query("guide_box", sql="SELECT p_partkey, CAST(p_size AS DOUBLE) + (p_partkey % 50 - h) / 2 AS y, h FROM (SELECT *, least(CAST(p_partkey % 50 AS DOUBLE), 2 * p_size / CAST(4.05 AS DOUBLE)) AS h FROM part) a")
def guide_box(spark, d):
    y, h = records.guide_box(F.col("p_size") * 2, (F.col("p_partkey") % 50).cast("double"), F.col("p_size").cast("double"))
    return v.read(spark, d, "part").select("p_partkey", y.alias("y"), h.alias("h"))


@query("map_file", sql="SELECT s_suppkey, 'out.d/' || replace(s_name, '#', '.') || '-map.txt' AS path FROM supplier")
def map_file(spark, d):
    """The map file of a worksheet for every supplier, whose names have dots of their own."""
    return v.read(spark, d, "supplier").select("s_suppkey", records.map_file(F.expr("'out.d/' || replace(s_name, '#', '.') || '.pdf'")).alias("path"))


@query(
    "audit_heads", REACH, v.BOXES, v.SMALL, LAB, TALLY, OWNER, KEEP, AUDIT, v.CHARS,
    sql="""SELECT page_id, n || ' glyphs | clipped ' || bad || ' | orphan ink ' || orphan || 'px (' || share // 100 || '.' || lpad(CAST(share % 100 AS VARCHAR), 2, '0') || '%)' || coalesce(' | MISSING FROM FONT: ' || lacks, '') AS line, bad = 0 AND orphan * 50 <= total AND lacks IS NULL AS clean
 FROM (SELECT a.page_id, n, bad, coalesce(orphan, 0) AS orphan, coalesce(total, 0) AS total, CASE WHEN total > 0 THEN (20000 * orphan + total) // (2 * total) ELSE 0 END AS share, lacks
  FROM (SELECT page_id, count(*) AS n, count(*) FILTER (WHERE (owned - kept_own) * 1000 > 20 * owned AND box_id % 2 = 1) AS bad FROM au GROUP BY 1) a
  LEFT JOIN (SELECT page_id, CAST(sum(CASE WHEN owner IS NULL THEN area ELSE 0 END) AS BIGINT) AS orphan, CAST(sum(area) AS BIGINT) AS total FROM ar LEFT JOIN ow USING (page_id, root) GROUP BY 1) o ON a.page_id = o.page_id
  LEFT JOIN (SELECT page_id, string_agg(ch, ' ' ORDER BY ch) AS lacks FROM (SELECT page_id, ch FROM (SELECT DISTINCT page_id FROM v_chars) p, (VALUES ('j'), ('q'), ('x')) t(ch) EXCEPT SELECT page_id, ch FROM v_chars) e GROUP BY 1) l ON a.page_id = l.page_id) b""",
)
def audit_heads(spark, d):
    """The audit's first line of every page; even boxes count as set by hand, three letters are wanted of each document."""
    small, labelled = _small(spark, d), graph.kept(_labelled(spark, d), "labelled")
    chars = text.first_characters(v.texts(spark, d)).select("page_id", "ch")
    wanted = chars.select("page_id").distinct().select("page_id", F.explode(F.array(*map(F.lit, "jqx"))).alias("ch"))
    return records.report_head(ownership.audit(labelled, small, 4), ownership.orphans(labelled, small, 4), small.where("box_id % 2 = 0"), wanted.join(chars, ["page_id", "ch"], "left_anti"))
