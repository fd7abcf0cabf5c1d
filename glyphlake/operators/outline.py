"""Outlines: areas, nesting, direction, affine maps and path text.

A polygon is rows (poly_id, i, x, y) in order. A path column is an array of segments (cmd, x1, y1,
x2, y2, x, y) with cmd M, L, Q, C or Z.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphlake.functions.pathtext import read_paths
from glyphlake.functions.scalars import half_up
from glyphlake.operators.graph import kept

NUMBER = r"-?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"


def edges(polygons: DataFrame) -> DataFrame:
    """(poly_id, x, y, nx, ny): every edge, the last one back to the first point."""
    ring = W.partitionBy("poly_id").orderBy("i")
    first = ring.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return polygons.select("poly_id", "x", "y", F.coalesce(F.lead("x").over(ring), F.first("x").over(first)).alias("nx"), F.coalesce(F.lead("y").over(ring), F.first("y").over(first)).alias("ny"))


def doubled_areas(polygons: DataFrame) -> DataFrame:
    """(poly_id, area2): twice the signed area, positive for counter-clockwise ones with y upwards."""
    return edges(polygons).groupBy("poly_id").agg(F.sum(F.col("x") * F.col("ny") - F.col("nx") * F.col("y")).alias("area2"))


def inside(points: DataFrame, polygons: DataFrame) -> DataFrame:
    """(point_id, poly_id, inside): even-odd rule, for points (point_id, poly_id, px, py) of the polygons they name."""
    joined = points.join(edges(polygons), "poly_id")
    crosses = ((F.col("y") > F.col("py")) != (F.col("ny") > F.col("py"))) & (F.col("px") < (F.col("nx") - F.col("x")) * (F.col("py") - F.col("y")) / F.nullif(F.col("ny") - F.col("y"), F.lit(0)) + F.col("x"))
    return joined.groupBy("point_id", "poly_id").agg((F.count_if(crosses) % 2 == 1).alias("inside"))


def winding(polygons: DataFrame, groups: DataFrame) -> DataFrame:
    """(group_id, poly_id, depth, reverse) of subpaths (group_id, poly_id): which must turn round.

    Depth is the number of the group's other polygons around a subpath's first point; even depths run
    clockwise (negative area), odd ones counter-clockwise. A pair is only tested if the point lies
    in the other's bounding box.
    """
    spans = polygons.groupBy("poly_id").agg(F.min("x").alias("lx"), F.max("x").alias("hx"), F.min("y").alias("ly"), F.max("y").alias("hy"))
    starts = polygons.where("i = 0").select("poly_id", F.col("x").alias("px"), F.col("y").alias("py"))
    own = groups.join(starts, "poly_id")
    others = groups.join(spans, "poly_id").withColumnRenamed("poly_id", "other")
    near = own.join(others, "group_id").where("poly_id <> other and px between lx and hx and py between ly and hy")
    points = near.select(F.struct("group_id", F.col("poly_id").alias("own")).alias("point_id"), F.col("other").alias("poly_id"), "px", "py")
    depth = inside(points, polygons).where("inside").groupBy("point_id.group_id", F.col("point_id.own").alias("poly_id")).agg(F.count(F.lit(1)).alias("depth"))
    judged = groups.join(doubled_areas(polygons), "poly_id").join(depth, ["group_id", "poly_id"], "left").withColumn("depth", F.coalesce("depth", F.lit(0)))
    return judged.select("group_id", "poly_id", "depth", ((F.col("area2") > 0) != (F.col("depth") % 2 == 1)).alias("reverse"))


def parsed(d: Column) -> Column:
    """Segments of a path text with absolute points: M, L, Q, C and Z.

    Texts that have only these commands, each with all its numbers, are read by expressions; any
    other text of the grammar (relative or repeated commands, H, V, S, T, A) with the pen's state, arcs
    and short curves written out. A text with anything that cannot be read is an error.
    """
    pieces = F.regexp_extract_all(d, F.lit(r"([MLQCZz][^MLQCZz]*)"), F.lit(1))
    cmd_of = lambda p: F.upper(F.substring(p, 1, 1))
    texts_of = lambda p: F.regexp_extract_all(p, F.lit(f"({NUMBER})"), F.lit(1))
    takes = lambda c: F.when(c == "C", 6).when(c == "Q", 4).when(c == "Z", 0).otherwise(2)
    bare = lambda p: F.regexp_replace(F.substring(p, F.lit(2), F.length(p)), NUMBER, " ").rlike(r"^[\s,]*$")
    plain = d.rlike(r"^[\s,]*M") & ~d.rlike("[^MLQCZz0-9eE.,+\\s-]") & F.forall(pieces, lambda p: (F.size(texts_of(p)) == takes(cmd_of(p))) & bare(p))
    plain = F.coalesce(plain | (F.trim(d) == ""), F.lit(True))

    def segment(piece: Column) -> Column:
        cmd = cmd_of(piece)
        v = F.transform(texts_of(piece), lambda t: t.cast("double"))
        at = [F.get(v, F.lit(k)) for k in range(6)]
        long, mid = cmd == "C", cmd == "Q"
        return F.struct(
            cmd.alias("cmd"), F.when(long | mid, at[0]).alias("x1"), F.when(long | mid, at[1]).alias("y1"), F.when(long, at[2]).alias("x2"), F.when(long, at[3]).alias("y2"),
            F.when(long, at[4]).when(mid, at[2]).otherwise(at[0]).alias("x"), F.when(long, at[5]).when(mid, at[3]).otherwise(at[1]).alias("y"),
        )

    return F.when(plain, F.transform(pieces, segment)).otherwise(read_paths(F.when(~plain, d)))


def subpaths(path: Column) -> Column:
    """A path as an array of paths that each begin with a move."""
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.size(path), F.lit(1))), lambda i: F.get(path, i - 1)["cmd"] == "M")
    upto = lambda k: F.coalesce(F.get(places, k + 1), F.size(path) + 1)
    return F.transform(places, lambda at, k: F.slice(path, at, upto(k) - at))


def sampled(path: Column) -> Column:
    """Points (x, y) of one subpath as a polygon: ends of segments, and the middle of a cubic curve."""

    def points(s: Column, i: Column) -> Column:
        before = F.get(path, i - 1)
        middle = F.struct(*((F.lit(0.125) * before[c] + F.lit(0.375) * s[f"{c}1"] + F.lit(0.375) * s[f"{c}2"] + F.lit(0.125) * s[c]).alias(c) for c in ("x", "y")))
        end = F.struct(s["x"].alias("x"), s["y"].alias("y"))
        return F.when(s["cmd"] == "C", F.array(middle, end)).when(s["cmd"] != "Z", F.array(end)).otherwise(F.slice(F.array(end), 1, 0))

    return F.flatten(F.transform(path, points))


def wound(glyphs: DataFrame, id_col: str = "glyph_id", d_col: str = "d") -> DataFrame:
    """(id, d): path texts whose subpaths run as the nonzero rule wants them, outer ones clockwise with y upwards and holes against it.

    A path is cut into subpaths within its row; their nesting is judged by ``winding`` on sampled
    points, and those that run the wrong way are turned round. Coordinates are to tenths. A path
    without a subpath, or null, stays as it is. Ids must differ.
    """
    cut = kept(glyphs.select(F.col(id_col).alias("group_id"), F.col(d_col).alias("d"), parsed(F.col(d_col)).alias("path")).select("group_id", "d", subpaths(F.col("path")).alias("subs")), "subpaths")
    each = cut.select("group_id", F.posexplode("subs").alias("sub", "path")).withColumn("poly_id", F.struct("group_id", "sub"))
    polygons = each.select("poly_id", F.posexplode(sampled(F.col("path"))).alias("i", "p")).select("poly_id", "i", "p.x", "p.y")
    judged = winding(kept(polygons, "polygons"), each.select("group_id", "poly_id")).select("poly_id", "reverse")
    turned = each.join(judged, "poly_id").select("group_id", "sub", F.when(F.col("reverse"), path_text(reversed_path(F.col("path")))).otherwise(path_text(F.col("path"))).alias("text"))
    texts = turned.groupBy("group_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sub", "text"))), lambda s: s["text"]), "").alias("turned"))
    return cut.join(texts, "group_id", "left").select(F.col("group_id").alias(id_col), F.coalesce("turned", "d").alias(d_col))


def mapped(path: Column, kx: Column, ky: Column, dx: Column, dy: Column) -> Column:
    """The path under x -> kx x + dx, y -> ky y + dy, rounded to tenths."""

    def tenth(v: Column, k: Column, d: Column) -> Column:
        return half_up((v * k + d) * 10) / 10

    return F.transform(path, lambda s: F.struct(s["cmd"].alias("cmd"), *(tenth(s[c], kx if c[0] == "x" else ky, dx if c[0] == "x" else dy).alias(c) for c in ("x1", "y1", "x2", "y2", "x", "y"))))


def bounds(path: Column) -> Column:
    """Box of all points and control points; the whole block for an empty path."""

    def pick(f, names: tuple) -> Column:
        return f(F.flatten(F.transform(path, lambda s: F.filter(F.array(*(s[n] for n in names)), lambda v: v.isNotNull()))))

    xs, ys = ("x1", "x2", "x"), ("y1", "y2", "y")
    return F.struct(
        F.coalesce(pick(F.array_min, xs), F.lit(0.0)).alias("x0"), F.coalesce(pick(F.array_min, ys), F.lit(0.0)).alias("y0"), F.coalesce(pick(F.array_max, xs), F.lit(1000.0)).alias("x1"), F.coalesce(pick(F.array_max, ys), F.lit(1000.0)).alias("y1")
    )


def reversed_path(path: Column) -> Column:
    """One closed subpath run the other way: it starts at its last point, and curves swap their control points."""
    drawn = F.filter(path, lambda s: s["cmd"] != "Z")
    n = F.size(drawn)
    last = F.element_at(drawn, -1)
    nothing = F.lit(None).cast("double")
    start = F.struct(F.lit("M").alias("cmd"), nothing.alias("x1"), nothing.alias("y1"), nothing.alias("x2"), nothing.alias("y2"), last["x"].alias("x"), last["y"].alias("y"))

    def back(k: Column) -> Column:
        s, to = F.element_at(drawn, (n - k + 1).cast("int")), F.element_at(drawn, (n - k).cast("int"))
        curve = s["cmd"] == "C"
        return F.struct(
            s["cmd"].alias("cmd"), F.when(curve, s["x2"]).otherwise(s["x1"]).alias("x1"), F.when(curve, s["y2"]).otherwise(s["y1"]).alias("y1"), F.when(curve, s["x1"]).alias("x2"), F.when(curve, s["y1"]).alias("y2"), to["x"].alias("x"), to["y"].alias("y")
        )

    end = F.struct(F.lit("Z").alias("cmd"), *(nothing.alias(c) for c in ("x1", "y1", "x2", "y2", "x", "y")))
    return F.concat(F.array(start), F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), back)).otherwise(F.slice(path, 1, 0)), F.array(end))


def path_text(path: Column) -> Column:
    """The path as text, coordinates to tenths."""

    def number(v: Column) -> Column:
        return F.regexp_replace((half_up(v * 10) / 10).cast("decimal(18,1)").cast("string"), r"\.0$", "")

    def segment(s: Column) -> Column:
        pairs = [F.concat_ws(" ", number(s[a]), number(s[b])) for a, b in (("x1", "y1"), ("x2", "y2"), ("x", "y"))]
        return F.concat(s["cmd"], F.array_join(F.filter(F.array(*pairs), lambda p: p != ""), " "))

    return F.array_join(F.transform(path, segment), "")
