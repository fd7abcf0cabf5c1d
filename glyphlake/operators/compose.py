"""Hangul: letters of a syllable, the slots of its layout, and the outlines put together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphlake.functions.scalars import char_of, half_up
from glyphlake.operators import dims

FIRST, COUNT = 0xAC00, 11172
MOST_STRETCH = 1.5


def _letter(of: str, at: Column) -> Column:
    return F.element_at(F.split(F.lit(of), ""), (at + 1).cast("int"))


def decomposed(codepoint: Column) -> list[Column]:
    """Columns ch, lead, vowel and final ('' for none) of a modern syllable; others raise an error."""
    n = codepoint - FIRST
    valid = F.when((n >= 0) & (n < COUNT), n).otherwise(F.raise_error(F.concat(F.lit("not a modern Hangul syllable: "), codepoint.cast("string"))).cast("int"))
    final = (valid % 28).cast("int")
    return [
        char_of(codepoint).alias("ch"),
        _letter(dims.LEADS, F.floor(valid / 588)).alias("lead"),
        _letter(dims.VOWELS, F.floor((valid % 588) / 28)).alias("vowel"),
        F.when(final == 0, "").otherwise(_letter(dims.FINALS, F.greatest(final - 1, F.lit(0)))).alias("final"),
    ]


def layouts(syllables: DataFrame) -> DataFrame:
    """Syllables with ch, lead, vowel, final, upright and has_final."""
    split = syllables.select("*", *decomposed(F.col("codepoint")))
    return split.withColumn("upright", F.col("vowel").isin(*dims.UPRIGHT_VOWELS)).withColumn("has_final", F.col("final") != "")


def placed_parts(parts: DataFrame, slots: DataFrame) -> DataFrame:
    """(upright, has_final, role, jamo, kx, ky, dx, dy, bx0, by0, bx1, by1): each part fitted into each slot of its role.

    Parts (role, jamo, x0, y0, x1, y1) are outlines' boxes in font coordinates; slots measure
    downwards. A part grows with its aspect and up to MOST_STRETCH in the roomier direction, centred.
    These are the only transforms there are, 145 for the full set, so syllables join them instead of
    fitting each letter anew.
    """
    fits = (F.col("role") != "V") | (F.col("upright") == F.col("jamo").isin(*dims.UPRIGHT_VOWELS))
    joined = parts.join(F.broadcast(slots), "role").where(fits).withColumn("w", F.greatest(F.lit(1.0), F.col("x1") - F.col("x0"))).withColumn("h", F.greatest(F.lit(1.0), F.col("y1") - F.col("y0")))
    fit = F.least(F.col("sw") / F.col("w"), F.col("sh") / F.col("h")) * MOST_STRETCH
    scaled = joined.withColumn("kx", F.least(F.col("sw") / F.col("w"), fit)).withColumn("ky", F.least(F.col("sh") / F.col("h"), fit))
    left = F.col("sx") + (F.col("sw") - F.col("w") * F.col("kx")) / 2
    bottom = 1000 - (F.col("sy") + (F.col("sh") - F.col("h") * F.col("ky")) / 2) - F.col("h") * F.col("ky")
    moved = scaled.withColumn("dx", left - F.col("x0") * F.col("kx")).withColumn("dy", bottom - F.col("y0") * F.col("ky"))

    def side(at: str, k: str, d: str) -> Column:
        return half_up((F.col(at) * F.col(k) + F.col(d)) * 10).cast("long")  # tenths of a unit

    return moved.select(
        "upright", "has_final", "role", "jamo", "kx", "ky", "dx", "dy", side("x0", "kx", "dx").alias("bx0"), side("y0", "ky", "dy").alias("by0"), side("x1", "kx", "dx").alias("bx1"), side("y1", "ky", "dy").alias("by1")
    )


def composed(syllables: DataFrame, placed: DataFrame) -> DataFrame:
    """(codepoint, role, jamo, kx, ky, dx, dy, bx0, by0, bx1, by1): the placed parts of every syllable."""
    roles = F.array(F.struct(F.lit("L").alias("role"), F.col("lead").alias("jamo")), F.struct(F.lit("V").alias("role"), F.col("vowel").alias("jamo")), F.struct(F.lit("T").alias("role"), F.col("final").alias("jamo")))
    wanted = layouts(syllables).select("codepoint", "upright", "has_final", F.explode(roles).alias("p")).select("codepoint", "upright", "has_final", "p.role", "p.jamo").where("jamo <> ''")
    return wanted.join(F.broadcast(placed), ["upright", "has_final", "role", "jamo"]).drop("upright", "has_final")


def missing_parts(required: DataFrame, have: DataFrame) -> DataFrame:
    """Required (role, ch) without a part."""
    return required.join(have, [required["role"] == have["role"], required["ch"] == have["jamo"]], "left_anti")


def placed_in_block(x0: Column, y0: Column, x1: Column, y1: Column, inset: int = 60) -> list[Column]:
    """(scale, dx, dy) that fit a crop's box, y downwards, into the middle of a 1000 by 1000 block."""
    w, h = x1 - x0, y1 - y0
    scale = F.least((1000 - 2 * inset) / w, (1000 - 2 * inset) / h)
    return [scale.alias("scale"), ((1000 - w * scale) / 2).alias("dx"), ((1000 - h * scale) / 2).alias("dy")]


def for_text(chars: DataFrame, written: DataFrame, placed: DataFrame) -> DataFrame:
    """(ch, source, parts): what each distinct character of a text is drawn from.

    A character that was written itself (ch) is used as it is; a modern syllable is composed if all
    its letters have parts; others are left out.
    """
    distinct = chars.select("ch").distinct()
    literal = distinct.join(written.select("ch").distinct(), "ch", "left_semi").select("ch", F.lit("written").alias("source"), F.lit(1).cast("long").alias("parts"))
    rest = distinct.join(literal, "ch", "left_anti").where(F.ascii("ch").between(FIRST, FIRST + COUNT - 1)).select(F.ascii("ch").alias("codepoint"))
    counted = composed(rest, placed).groupBy("codepoint").agg(F.count(F.lit(1)).alias("parts"))
    wanted = F.when(F.col("codepoint").cast("int") % 28 == FIRST % 28, 2).otherwise(3)
    return literal.unionByName(counted.where(F.col("parts") == wanted).select(char_of(F.col("codepoint")).alias("ch"), F.lit("composed").alias("source"), "parts"))
