"""Path texts of the whole grammar, read with the state of the pen."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

NUMBER = re.compile(r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?")
FLAG = re.compile("[01]")
BETWEEN = re.compile(r"[\s,]*")
#: How many numbers a command takes, again and again.
TAKES = {"M": 2, "L": 2, "H": 1, "V": 1, "C": 6, "S": 4, "Q": 4, "T": 2, "A": 7, "Z": 0}

Segment = tuple[str, list[float]]  # M, L, Q, C with absolute points, or Z
FIELDS = ("cmd", "x1", "y1", "x2", "y2", "x", "y")
SEGMENTS = T.ArrayType(T.StructType([T.StructField(n, T.DoubleType() if n != "cmd" else T.StringType()) for n in FIELDS]))


def commands(text: str) -> Iterator[tuple[str, list[float]]]:
    """Commands with their numbers, one for each repetition; a ValueError where anything is left unread."""
    at, first = BETWEEN.match(text).end(), True
    while at < len(text):
        cmd = text[at]
        if cmd.upper() not in TAKES or first and cmd not in "Mm":
            raise ValueError(f"no path command at {at}: {text[at : at + 20]!r}")
        at, first, n = BETWEEN.match(text, at + 1).end(), False, TAKES[cmd.upper()]
        if not n:
            yield cmd, []
            continue
        while True:
            numbers = []
            for k in range(n):
                got = (FLAG if cmd in "Aa" and k in (3, 4) else NUMBER).match(text, at)
                if not got:
                    raise ValueError(f"{cmd} needs a number at {at}: {text[at : at + 20]!r}")
                numbers.append(float(got[0]))
                at = BETWEEN.match(text, got.end()).end()
            yield cmd, numbers
            cmd = {"M": "L", "m": "l"}.get(cmd, cmd)
            if at == len(text) or text[at].isalpha():
                break


def arc(x0: float, y0: float, rx: float, ry: float, turn: float, large: bool, sweep: bool, x: float, y: float) -> list[Segment]:
    """An elliptical arc as cubic curves of a quarter turn at most each."""
    rx, ry = abs(rx), abs(ry)
    if (x0, y0) == (x, y):
        return []
    if not rx or not ry:
        return [("L", [x, y])]
    c, s = math.cos(math.radians(turn)), math.sin(math.radians(turn))
    # In the ellipse's own axes, scaled to the unit circle: both ends, and the centre on their bisector.
    (ax, ay), (bx, by) = (((c * px + s * py) / rx, (c * py - s * px) / ry) for px, py in ((x0, y0), (x, y)))
    half = math.hypot(bx - ax, by - ay) / 2
    if half > 1:  # radii too small: the ellipse grows until it reaches
        rx, ry, ax, ay, bx, by, half = rx * half, ry * half, ax / half, ay / half, bx / half, by / half, 1.0
    away = math.sqrt(max(0.0, 1 - half * half)) / half / 2 * (1 if large != sweep else -1)
    mx, my = (ax + bx) / 2 - away * (by - ay), (ay + by) / 2 + away * (bx - ax)
    start, end = math.atan2(ay - my, ax - mx), math.atan2(by - my, bx - mx)
    angle = (end - start) % (2 * math.pi) if sweep else -((start - end) % (2 * math.pi))
    n = max(1, math.ceil(abs(angle) / (math.pi / 2) - 1e-9))
    step = angle / n
    k = 4 / 3 * math.tan(step / 4)

    def back(u: float, v: float) -> tuple[float, float]:
        u, v = (u + mx) * rx, (v + my) * ry
        return c * u - s * v, s * u + c * v

    out: list[Segment] = []
    for i in range(n):
        a, b = start + i * step, start + (i + 1) * step
        points = back(math.cos(a) - k * math.sin(a), math.sin(a) + k * math.cos(a)), back(math.cos(b) + k * math.sin(b), math.sin(b) - k * math.cos(b)), (x, y) if i + 1 == n else back(math.cos(b), math.sin(b))
        out.append(("C", [v for p in points for v in p]))
    return out


def absolute(text: str) -> list[Segment]:
    """M, L, Q, C and Z with absolute points for any path text."""
    out: list[Segment] = []
    x = y = x_first = y_first = 0.0
    turned: tuple[str, float, float] | None = None  # kind of the curve before, and its last control point
    for cmd, v in commands(text):
        kind, last, turned = cmd.upper(), turned, None
        if cmd.islower() and kind == "A":
            v = [*v[:5], v[5] + x, v[6] + y]
        elif cmd.islower():
            v = [n + (y if kind == "V" or i % 2 else x) for i, n in enumerate(v)]
        if kind in "ST":  # the control point before, mirrored at the pen
            curve = "C" if kind == "S" else "Q"
            v = [*((2 * x - last[1], 2 * y - last[2]) if last and last[0] == curve else (x, y)), *v]
            kind = curve
        if kind == "Z":
            out.append(("Z", []))
            x, y = x_first, y_first
            continue
        if kind == "A":
            out += arc(x, y, *v[:3], v[3] == 1, v[4] == 1, *v[5:])
        elif kind in "HV":
            out.append(("L", [v[0], y] if kind == "H" else [x, v[0]]))
        else:
            out.append((kind, v))
        if kind in "CQ":
            turned = (kind, *v[-4:-2])
        x, y = (out[-1][1] if kind in "HV" else v)[-2:]
        if kind == "M":
            x_first, y_first = x, y
    return out


@pandas_udf(SEGMENTS)
def read_paths(texts: pd.Series) -> pd.Series:
    """``absolute`` of every text as rows of segments; null for null."""

    def row(cmd: str, v: list[float]) -> tuple:
        return (cmd, *([None] * 4 if len(v) < 4 else [*v[:2], None, None] if len(v) == 4 else v[:4]), *(v[-2:] or (None, None)))

    return texts.map(lambda t: None if t is None else [dict(zip(FIELDS, row(*s), strict=True)) for s in absolute(t)])
