"""Letters, layouts, metrics and sheet geometry, as small DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The letters of Hangul and the characters that a worksheet has besides.
LEADS = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ"
VOWELS = "ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ"
FINALS = "ㄱㄲㄳㄴㄵㄶㄷㄹㄺㄻㄼㄽㄾㄿㅀㅁㅂㅄㅅㅆㅇㅈㅊㅋㅌㅍㅎ"
UPRIGHT_VOWELS = "ㅏㅐㅑㅒㅓㅔㅕㅖㅣ"
EXTRAS = "0123456789.,?!-()"

# Slots (upright vowel, final, role, x, y, width, height) in a 1000 by 1000 block, y downwards.
SLOTS = [
    (True, False, "L", 65, 75, 460, 850),
    (True, False, "V", 545, 75, 390, 850),
    (True, True, "L", 65, 65, 460, 590),
    (True, True, "V", 545, 65, 390, 590),
    (True, True, "T", 95, 715, 810, 200),
    (False, False, "L", 75, 60, 850, 430),
    (False, False, "V", 75, 535, 850, 380),
    (False, True, "L", 75, 55, 850, 310),
    (False, True, "V", 75, 400, 850, 270),
    (False, True, "T", 95, 715, 810, 200),
]

# Fixed values: (characters, bottom, top) in font units.
BANDS = [
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 0, 700),
    ("ÑÁÉÍÓÚÜ", 0, 800),
    ("bdfhkl", 0, 720),
    ("t", 0, 640),
    ("acemnorsuvwxz", 0, 480),
    ("ñáéíóúü", 0, 720),
    ("i", 0, 660),
    ("j", -220, 660),
    ("gpqy", -220, 480),
    (".", 0, 110),
    (",", -140, 110),
    (":", 0, 480),
    (";", -140, 480),
    ("!?", 0, 700),
    ("'’", 480, 700),
    ('"“”', 480, 700),
    ("-–—", 250, 350),
    ("_", -120, -40),
    ("()[]{}", -160, 720),
    ("@", -50, 650),
    ("#&%", 0, 700),
    ("+", 110, 550),
    ("=", 180, 480),
    ("*", 420, 700),
    ("$€£", -40, 730),
    ("/\\|", -100, 720),
    ("<>", 110, 550),
    ("~", 220, 420),
    ("^", 450, 700),
    ("¿¡", -220, 480),
]
UPM, ASCENT, DESCENT, CAP_HEIGHT, X_HEIGHT = 1000, 800, -200, 700, 480
DEFAULT_BAND = (0, CAP_HEIGHT)

# Character sets for a template.
MINIMAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789.,;:!?'\"-()@#&+/$"
SPANISH = MINIMAL + "ÑñÁÉÍÓÚáéíóúü¿¡"

# An A4 sheet in points, its margin, header, columns, rows and the inset of a cell.
A4_WIDTH, A4_HEIGHT, MARGIN, HEADER, COLUMNS, ROWS, INSET = 595.28, 841.89, 40, 70, 6, 7, 4
PER_PAGE = COLUMNS * ROWS


def bands(spark: SparkSession) -> DataFrame:
    """(ch, bottom, top)."""
    return spark.createDataFrame([(c, lo, hi) for chars, lo, hi in BANDS for c in chars], "ch string, bottom int, top int")


def slots(spark: SparkSession) -> DataFrame:
    """(upright, has_final, role, sx, sy, sw, sh)."""
    return spark.createDataFrame(SLOTS, "upright boolean, has_final boolean, role string, sx int, sy int, sw int, sh int")


def letters(spark: SparkSession) -> DataFrame:
    """(item, role, ch, key): what a worksheet asks for, in cell order from 0: leads, vowels, finals, extras."""
    rows = [("L", c) for c in LEADS] + [("V", c) for c in VOWELS] + [("T", c) for c in FINALS] + [("X", c) for c in EXTRAS]
    return spark.createDataFrame([(i, r, c, f"{r}:{c}") for i, (r, c) in enumerate(rows)], "item int, role string, ch string, key string")


def values(rows: list, names: str) -> str:
    """The rows as a SQL table expression of another engine, for the twins of queries."""

    def literal(x) -> str:
        return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else str(x)

    return "(VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + f") t({names})"
