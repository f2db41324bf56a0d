"""Arithmetic of sound levels as column expressions. Silence is energy 0 and level null."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hours and penalties (dB) of day, evening and night, and the A-weighting of the octave bands 63 Hz - 8 kHz (fixed).
PERIOD_HOURS = (12, 4, 8)
PERIOD_PENALTY_DB = (0, 5, 10)
A_WEIGHT_DB = (-26.2, -16.1, -8.6, -3.2, 0.0, 1.2, 1.0, -1.1)


def rounded(x: Column, places: int = 4) -> Column:
    """Half-up rounding on the binary value, which other engines give alike."""
    return F.floor(x * float(10**places) + 0.5) / float(10**places)


def energy(level_db: Column) -> Column:
    """10 ^ (L / 10); silence (null) has none."""
    return F.coalesce(F.exp(level_db * (math.log(10) / 10)), F.lit(0.0))


def level(e: Column) -> Column:
    """10 lg E; null for no energy."""
    return 10 * F.log10(F.nullif(e, F.lit(0.0)))


def lden_energy(day: Column, evening: Column, night: Column) -> Column:
    """Mean energy over a day of 24 hours with the penalties of evening and night."""
    parts = zip((day, evening, night), PERIOD_HOURS, PERIOD_PENALTY_DB, strict=True)
    return sum(e * (hours / 24 * 10 ** (penalty / 10)) for e, hours, penalty in parts)


def period_of_hour(hour: Column) -> Column:
    """0 day (7-19), 1 evening (19-23), 2 night."""
    return F.when(hour.between(7, 18), 0).when(hour.between(19, 22), 1).otherwise(2)


def seconds_in(start_s: Column, end_s: Column, from_h: int, to_h: int) -> Column:
    """Seconds of an interval within a day (seconds of the day) that fall between two hours."""
    return F.greatest(F.least(end_s, F.lit(to_h * 3600)) - F.greatest(start_s, F.lit(from_h * 3600)), F.lit(0))


def a_weighted(bands_db: Column) -> Column:
    """Energy of an array of eight octave-band levels, A-weighted."""
    weights = F.array(*[F.lit(w) for w in A_WEIGHT_DB])
    return F.aggregate(F.zip_with(bands_db, weights, lambda x, w: energy(x + w)), F.lit(0.0), lambda a, x: a + x)


def loudness_code(sone: Column) -> Column:
    """One byte for a loudness: 80 + 20 log2 sone, at most 253; 254 silence, 255 (null) not assessed."""
    code = F.floor(80 + 20 * F.log2(F.nullif(sone, F.lit(0.0))) + 0.5)
    return F.when(sone.isNull(), 255).when((sone <= 0) | (code < 0), 254).otherwise(F.least(code, F.lit(253))).cast("int")


def loudness_of(code: Column) -> Column:
    """The loudness of a code; null where not assessed."""
    return F.when(code == 254, 0.0).when(code < 254, F.pow(F.lit(2.0), (code - 80) / 20.0))


def interpolate_nodes(x: Column, nodes: Sequence[tuple[float, float]]) -> Column:
    """Linear interpolation over a few nodes, constant beyond them."""
    out = F.when(x <= nodes[0][0], F.lit(float(nodes[0][1])))
    for (x0, y0), (x1, y1) in zip(nodes, nodes[1:], strict=False):
        out = out.when(x <= x1, y0 + (x - x0) * ((y1 - y0) / (x1 - x0)))
    return out.otherwise(F.lit(float(nodes[-1][1])))


def p_norm(values: Column, p: Column) -> Column:
    """(sum x^p)^(1/p) of an array of non-negative numbers."""
    return F.pow(F.aggregate(F.transform(values, lambda x: F.pow(x, p)), F.lit(0.0), lambda a, x: a + x), 1 / p)


def air_absorption_db_per_m(
    frequency_hz: Column | float, celsius: Column, humidity_percent: Column, pressure_kpa: float = 101.325
) -> Column:
    """Pure-tone absorption of air after ISO 9613-1."""
    f = frequency_hz if isinstance(frequency_hz, Column) else F.lit(float(frequency_hz))
    t, ratio = celsius + 273.15, pressure_kpa / 101.325
    saturation = F.pow(F.lit(10.0), -6.8346 * F.pow(273.16 / t, 1.261) + 4.6151)
    h = humidity_percent * saturation / ratio
    oxygen = ratio * (24 + 4.04e4 * h * (0.02 + h) / (0.391 + h))
    warm = t / 293.15
    nitrogen = ratio * F.pow(warm, -0.5) * (9 + 280 * h * F.exp(-4.170 * (F.pow(warm, -1 / 3) - 1)))
    o = 0.01275 * F.exp(-2239.1 / t) / (oxygen + f * f / oxygen)
    n = 0.1068 * F.exp(-3352.0 / t) / (nitrogen + f * f / nitrogen)
    return 8.686 * f * f * (1.84e-11 / ratio * F.sqrt(warm) + F.pow(warm, -2.5) * (o + n))
