"""Angles in degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_angle(x: Column) -> Column:
    """To [0, 360), with values next to a whole turn put on 0. Not finite: null."""
    y = F.pmod(x, F.lit(360.0))
    y = F.when((F.abs(y) < 1e-10) | (F.abs(y - 360.0) < 1e-10), F.lit(0.0)).otherwise(y)
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(y)


def zone(x: Column) -> Column:
    """Quarter of the turn, 1 to 4."""
    return (F.floor(normal_angle(x) / 90.0) + 1).cast("int")


def circular_error(a: Column, b: Column) -> Column:
    d = F.abs(normal_angle(a) - normal_angle(b))
    return F.least(d, 360.0 - d)


def signed_correction(x: Column) -> Column:
    """The clockwise turn that undoes a counter-clockwise angle."""
    return -normal_angle(x)


def rotation_name(page: Column, angle: Column) -> Column:
    y = normal_angle(angle)
    whole = y == F.floor(y)
    shown = F.when(whole, F.lpad(F.floor(y).cast("string"), 3, "0")).otherwise(F.regexp_replace(F.format_string("%07.3f", y), r"\.", "p"))
    return F.concat(page, F.lit("_angle_"), shown, F.lit("_zone_"), zone(angle).cast("string"), F.lit(".png"))
