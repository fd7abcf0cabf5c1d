"""Page-like relations derived from the given tables, for Spark and, as SQL text, for DuckDB.

An order is a page of boxes, an embedding an 8 by 8 grey raster or a polygon, an event's value a grey
level, a document's text a run of characters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

INK = 112  # a pixel darker than this is ink


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, box_id, x0, x1, y0, y1, area): one box per order line, numbered from 1 on its page."""
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    lines = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("page_id"),
        F.row_number().over(order).alias("box_id"),
        F.expr("int(l_partkey % 200)").alias("x0"),
        F.expr("int(l_partkey % 200 + floor(l_quantity) - 1)").alias("x1"),
        F.expr("int(l_suppkey % 60)").alias("y0"),
        F.expr("int(l_suppkey % 60 + 4 * l_linenumber)").alias("y1"),
    )
    return lines.withColumn("area", F.expr("bigint((x1 - x0 + 1) * (y1 - y0 + 1))"))


BOXES = """v_boxes AS (SELECT page_id, box_id, x0, x1, y0, y1, CAST((x1-x0+1)*(y1-y0+1) AS BIGINT) AS area FROM (
 SELECT l_orderkey AS page_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber,l_partkey,l_suppkey,l_quantity,
  l_extendedprice,l_discount,l_tax,l_returnflag,l_linestatus,l_shipdate) AS INT) AS box_id, CAST(l_partkey % 200 AS INT) AS x0,
  CAST(l_partkey % 200 + floor(l_quantity) - 1 AS INT) AS x1, CAST(l_suppkey % 60 AS INT) AS y0, CAST(l_suppkey % 60 + 4*l_linenumber AS INT) AS y1 FROM lineitem) b)"""


def gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, gray): one grey level per event, its type as the page."""
    return read(spark, sf_dir, "events").select(F.col("event_type").alias("page_id"), F.expr("int(least(255D, floor(value)))").alias("gray"))


GRAY = "v_gray AS (SELECT event_type AS page_id, CAST(least(255.0, floor(value)) AS INT) AS gray, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2)"


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, y, x, gray): one 8 by 8 raster per embedding."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("page_id"), F.posexplode("embedding").alias("pos", "e")).select(
        "page_id", F.expr("int(pos div 8)").alias("y"), F.expr("int(pos % 8)").alias("x"), F.expr("int(floor(greatest(0D, least(255D, (double(e) + 0.5D) * 255D))))").alias("gray")
    )


PIXELS = """v_pixels AS (SELECT vec_id AS page_id, CAST(i // 8 AS INT) AS y, CAST(i % 8 AS INT) AS x,
 CAST(floor(greatest(0.0,least(255.0,(CAST(embedding[i+1] AS DOUBLE)+0.5)*255.0))) AS INT) AS gray FROM embeddings, range(64) r(i)), v_ink AS (SELECT page_id, y, x FROM v_pixels WHERE gray < 112)"""


def ink(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).where(F.col("gray") < INK).select("page_id", "y", "x")


def bare_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, text): every document without its blanks."""
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.regexp_replace("text", r"[ \t\r\n]", "").alias("text"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, chars): the non-blank characters of every document, as an array."""
    chars = F.when(F.col("text") == "", F.array().cast("array<string>")).otherwise(F.split("text", ""))
    return bare_texts(spark, sf_dir).select("page_id", chars.alias("chars"))


def chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, ordinal, ch): every non-blank character of every document."""
    text = F.regexp_replace("text", r"[ \t\r\n]", "")
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.posexplode(F.split(text, "")).alias("ordinal", "ch")).where("ch <> ''")


CHARS = r"""v_chars AS (SELECT page_id, CAST(i - 1 AS INT) AS ordinal, cs[i] AS ch FROM (SELECT page_id, cs, unnest(range(1, len(cs) + 1)) AS i FROM (SELECT doc_id AS page_id,
 string_split(regexp_replace(text, '[ \t\r\n]', '', 'g'), '') AS cs FROM documents) a) b WHERE cs[i] <> '')"""


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(poly_id, i, x, y): a closed polygon of whole coordinates per embedding."""
    pairs = F.expr("transform(sequence(0, size(embedding) div 2 - 1), i -> struct(bigint(floor(double(embedding[2 * i]) * 1000D)) as x, bigint(floor(double(embedding[2 * i + 1]) * 1000D)) as y))")
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("poly_id"), F.posexplode(pairs).alias("i", "p")).select("poly_id", "i", "p.x", "p.y")


POLY = """v_poly AS (SELECT vec_id AS poly_id, CAST(i AS INT) AS i, CAST(floor(CAST(embedding[2*i+1] AS DOUBLE)*1000) AS BIGINT) AS x,
 CAST(floor(CAST(embedding[2*i+2] AS DOUBLE)*1000) AS BIGINT) AS y FROM embeddings, range(32) r(i))"""


def small_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of 3 by 3 that fall on the rasters."""
    return boxes(spark, sf_dir).select("page_id", "box_id", F.expr("x0 % 6").alias("x0"), F.expr("x0 % 6 + 2").alias("x1"), F.expr("y0 % 6").alias("y0"), F.expr("y0 % 6 + 2").alias("y1"))


SMALL = "v_small AS (SELECT page_id, box_id, x0 % 6 AS x0, x0 % 6 + 2 AS x1, y0 % 6 AS y0, y0 % 6 + 2 AS y1 FROM v_boxes)"


def syllables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, codepoint): a Hangul syllable per part and supplier of an order line."""
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("row_id"), F.expr("int(44032 + (l_partkey * 31 + l_suppkey * 7 + l_linenumber) % 11172)").alias("codepoint"))


SYLL = "v_syll AS (SELECT l_orderkey AS row_id, CAST(44032 + (l_partkey * 31 + l_suppkey * 7 + l_linenumber) % 11172 AS INT) AS codepoint FROM lineitem)"
