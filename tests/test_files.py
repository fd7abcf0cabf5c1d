"""The sink of files: published whole, or not at all."""

import os

import pytest
from pyspark.sql import functions as F

from glyphlake.sources.files import read_files, write_files


def test_files_are_published_whole(spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    rows = spark.range(50, numPartitions=7).select(F.format_string("g%02d/U+%04X.png", F.col("id") % 3, "id").alias("name"), F.encode(F.col("id").cast("string"), "utf-8").alias("content"), F.lit(1).alias("path"))
    write_files(rows, folder)
    got = {r.name: bytes(r.content) for r in read_files(spark, folder, "*.png").collect()}
    assert got == {f"U+{i:04X}.png": str(i).encode() for i in range(50)}
    assert os.listdir(tmp_path / "out/_staging") == []
    with pytest.raises(Exception, match="a name is there twice"):
        write_files(rows.where("id = 4"), folder)
    write_files(spark.createDataFrame([("one", None)], "name string, content binary"), folder, "overwrite")
    assert [f for f in os.listdir(tmp_path / "out") if f[0] not in "._"] == ["one"]


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    name = F.when(F.col("id") == 17, "../out").otherwise(F.col("id").cast("string"))
    with pytest.raises(Exception, match="not a name of a file"):
        write_files(spark.range(20, numPartitions=4).select(name.alias("name"), F.lit(b"x").alias("content")), folder)
    with pytest.raises(Exception, match="a name is there twice"):
        write_files(spark.range(2, numPartitions=2).select(F.lit("same").alias("name"), F.lit(b"x").alias("content")), folder)
    left = [f for _, _, files in os.walk(tmp_path / "out") for f in files]
    assert left == []
    write_files(spark.range(0).select(F.lit("a").alias("name"), F.lit(b"").alias("content")), folder)
