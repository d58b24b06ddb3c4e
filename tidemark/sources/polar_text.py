"""Boat speed tables as text files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tidemark.functions.polar import Polar

MAX_AXIS = 512


def parse(lines: list[str]) -> Polar:
    """A table: first row wind speeds, first column wind angles; the corner may be text or missing.

    Values are separated by the first of `;`, `,`, tab and blanks that the header has;
    `#`, `!` and `//` begin comments. A column for 0 knots is added where it is missing.
    """
    rows = [r for r in (re.split(r"#|!|//", line.lstrip("﻿"))[0].strip() for line in lines) if r]
    if len(rows) < 2:
        raise ValueError("a table needs a header and a row")
    cut = next((d for d in ";,\t" if d in rows[0]), None)
    cells = [[x.strip() for x in r.split(cut)] for r in rows]
    head = cells[0]
    width = len(cells[1])
    tws = _numbers(head[1:] if len(head) == width else head, "wind speeds")
    body = [_numbers(r, "row") for r in cells[1:]]
    if any(len(r) != len(tws) + 1 for r in body):
        raise ValueError("rows differ in length")
    twa, speeds = [r[0] for r in body], [r[1:] for r in body]
    for axis, low, high in ((tws, 0.0, float("inf")), (twa, 0.0, 180.0)):
        if axis != sorted(set(axis)) or axis[0] < low or axis[-1] > high or len(axis) > MAX_AXIS:
            raise ValueError("an axis must ascend within its range")
    if any(v < 0 for r in speeds for v in r):
        raise ValueError("a speed is negative")
    if tws[0] > 0:
        tws, speeds = [0.0, *tws], [[0.0, *r] for r in speeds]
    if len(twa) < 2 or len(tws) < 2:
        raise ValueError("a table needs two angles and speeds")
    return Polar(twa, tws, speeds)


def _numbers(cells: list[str], what: str) -> list[float]:
    try:
        out = [float(x) for x in cells if x]
    except ValueError:
        raise ValueError(f"{what}: not a number") from None
    if any(x != x or abs(x) == float("inf") for x in out):
        raise ValueError(f"{what}: not finite")
    return out


def read_polar(spark: SparkSession, path: str) -> Polar:
    """A table from any path Spark reads; at most one line more than an axis may have comes to the driver."""
    rows = spark.read.text(path, wholetext=True).limit(2).collect()
    if len(rows) != 1:
        raise ValueError("a path must name one file")
    return parse(rows[0][0].splitlines())


def polar_frame(spark: SparkSession, path: str) -> DataFrame:
    return read_polar(spark, path).table(spark)
