"""Complex numbers as STRUCT<re, im>."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def complex_of(re: Column, im: Column) -> Column:
    return F.struct(re.cast("double").alias("re"), im.cast("double").alias("im"))


def real(z: Column) -> Column:
    return z["re"]


def imag(z: Column) -> Column:
    return z["im"]


def modulus(z: Column) -> Column:
    return F.hypot(z["re"], z["im"])


def angle(z: Column) -> Column:
    return F.atan2(z["im"], z["re"])


def conj(z: Column) -> Column:
    return complex_of(z["re"], -z["im"])


def times(a: Column, b: Column) -> Column:
    return complex_of(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])


def sqrt_cut(z: Column, cut: float = math.pi) -> Column:
    """Square root whose branch cut lies at angle `cut`: angles are taken in (cut - 2 pi, cut]."""
    two = 2 * math.pi
    theta = F.lit(cut) - F.pmod(F.lit(cut) - angle(z), F.lit(two))
    r = F.sqrt(modulus(z))
    return complex_of(r * F.cos(theta / 2), r * F.sin(theta / 2))
