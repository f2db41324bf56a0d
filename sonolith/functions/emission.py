"""Sound power of roads, turbines, solar farms, substations and works, and what a source gives at most, as column
expressions over arrays of the eight octave bands 63 Hz - 8 kHz. No joins: a row's emission stays in its row."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sonolith.functions.levels import A_WEIGHT_DB, energy

# Fixed values. Coefficients of the European road noise method (Directive 2015/996 as amended by 2021/1226), tables F-1
# and F-3, by category: rolling A and B, propulsion A and B of the bands 63 Hz - 8 kHz.
CATEGORIES = ("light", "medium", "heavy", "moto")
ROLLING_A = {
    "light": (83.1, 89.2, 87.7, 93.1, 100.1, 96.7, 86.8, 76.2),
    "medium": (88.7, 93.2, 95.7, 100.9, 101.7, 95.1, 87.8, 83.6),
    "heavy": (91.7, 96.2, 98.2, 104.9, 105.1, 98.5, 91.1, 85.6),
}
ROLLING_B = {
    "light": (30.0, 41.5, 38.9, 25.7, 32.5, 37.2, 39.0, 40.0),
    "medium": (30.0, 35.8, 32.6, 23.8, 30.1, 36.2, 38.3, 40.1),
    "heavy": (30.0, 33.5, 31.3, 25.4, 31.8, 37.1, 38.6, 40.6),
}
PROPULSION_A = {
    "light": (97.9, 92.5, 90.7, 87.2, 84.7, 88.0, 84.4, 77.1),
    "medium": (105.5, 100.2, 100.5, 98.7, 101.0, 97.8, 91.2, 85.0),
    "heavy": (108.8, 104.2, 103.5, 102.9, 102.6, 98.5, 93.8, 87.5),
    "moto": (99.9, 101.9, 96.7, 94.4, 95.2, 94.7, 92.1, 88.6),
}
PROPULSION_B = {
    "light": (-1.3, 7.2, 7.7, 8.0, 8.0, 8.0, 8.0, 8.0),
    "medium": (-1.9, 4.7, 6.4, 6.5, 6.5, 6.5, 6.5, 6.5),
    "heavy": (0.0, 3.0, 4.6, 5.0, 5.0, 5.0, 5.0, 5.0),
    "moto": (3.2, 5.9, 11.9, 11.6, 11.5, 12.6, 11.1, 12.0),
}
REFERENCE_KMH, SLOWEST_KMH, STEEPEST_PERCENT, JUNCTION_REACH_M = 70.0, 20.0, 12.0, 100.0
#: dB a degree below 20 C of rolling noise.
TEMPERATURE_K = {"light": 0.08, "medium": 0.04, "heavy": 0.04, "moto": 0.0}
#: Rolling and propulsion terms (dB) at traffic lights and at roundabouts.
JUNCTION_DB = {
    "light": ((-4.5, 5.5), (-4.4, 3.1)),
    "medium": ((-4.0, 9.0), (-2.3, 6.7)),
    "heavy": ((-4.0, 9.0), (-2.3, 6.7)),
    "moto": ((0.0, 0.0), (0.0, 0.0)),
}
#: A motorcycle over a car in steady and in stop-and-go flow (ASJ RTN-Model 2018).
MOTO_STEADY_DB, MOTO_STOPPING_DB = 3.8, 2.9
#: Sound power (dB(A)) of a turbine by rated kW (from, level), its operating level below that, and its octave spectrum.
TURBINE_DBA = ((0.0, 98.0), (1000.0, 104.0), (2001.0, 105.0), (3000.0, 106.0), (5000.0, 106.5))
TURBINE_UNKNOWN_DBA, WIND_DUTY_DB = 105.0, -2.14
TURBINE_SPECTRUM = (13.2, 11.1, 7.8, 4.4, 0.0, -3.9, -9.7, -19.4)
#: Solar inverters: dB(A) a MW, day duty, MW a hectare where untagged. Substations: 74 + 14 lg MVA, 64 up to 0.2 MVA.
SOLAR_DBA, SOLAR_DUTY_DB, SOLAR_MW_PER_HA = 88.0, -5.0, 0.55
SUBSTATION_DBA, SUBSTATION_SLOPE, SUBSTATION_LEAST = 74.0, 14.0, (0.2, 64.0)
#: Least effective area of the area law (m2); divergence of points (dB) and the largest gain over free field (dB).
AREA_FLOOR_M2, POINT_DB, LARGEST_GAIN_DB = 100.0, 11.0, 18.0

LN10 = math.log(10) / 10


def _array(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _linear(a: Sequence[float], b: Sequence[float], x: Column, more: Column) -> Column:
    """Energies 10^((a + b x + more) / 10) of the bands."""
    return F.zip_with(_array(a), _array(b), lambda p, q: F.exp((p + q * x + more) * LN10))


def _sum(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def gradient_db(category: str, slope: Column, speed: Column) -> Column:
    """Propulsion term of a slope (%, uphill above 0) at a speed."""
    up, down = F.least(slope, F.lit(STEEPEST_PERCENT)), F.least(-slope, F.lit(STEEPEST_PERCENT))
    if category == "light":
        return F.when(slope < -6, down - 6).when(slope > 2, (up - 2) / 1.5 * speed / 100).otherwise(0.0)
    if category == "medium":
        return F.when(slope < -4, (down - 4) / 0.7 * (speed - 20) / 100).when(slope > 0, up * speed / 100).otherwise(0.0)
    if category == "heavy":
        return F.when(slope < -4, (down - 4) / 0.5 * (speed - 10) / 100).when(slope > 0, up / 0.8 * speed / 100).otherwise(0.0)
    return F.lit(0.0)


def junction_fade(distance_m: Column) -> Column:
    """1 at a junction, 0 from its reach on or without one (null)."""
    return F.coalesce(F.greatest(1 - F.abs(distance_m) / JUNCTION_REACH_M, F.lit(0.0)), F.lit(0.0))


def vehicle_energy(
    category: str, speed: Column, slope: Column, roundabout: Column, distance_m: Column, celsius: Column, surface_db: Column, electric: Column
) -> Column:
    """Energy of one vehicle by band: rolling and propulsion with the terms of slope, junction, temperature, surface."""
    law = F.greatest(speed, F.lit(SLOWEST_KMH))
    ratio, relative = F.log10(law / REFERENCE_KMH), (law - REFERENCE_KMH) / REFERENCE_KMH
    fade = junction_fade(distance_m)
    lights, circle = JUNCTION_DB[category]
    rolls, drives = (fade * F.when(roundabout, circle[i]).otherwise(lights[i]) for i in (0, 1))
    push = _linear(PROPULSION_A[category], PROPULSION_B[category], relative, gradient_db(category, slope, law) + drives)
    if category == "light":
        burning = 1 - F.least(F.greatest(electric, F.lit(0.0)), F.lit(1.0))
        push = F.transform(push, lambda x: x * burning)
    if category == "moto":
        # Its spectrum at the level of a car there (without slope, surface and temperature) and so much more.
        car = _sum(
            _linear(PROPULSION_A["light"], PROPULSION_B["light"], relative, fade * F.when(roundabout, JUNCTION_DB["light"][1][1]).otherwise(JUNCTION_DB["light"][0][1])),
            _linear(ROLLING_A["light"], ROLLING_B["light"], ratio, fade * F.when(roundabout, JUNCTION_DB["light"][1][0]).otherwise(JUNCTION_DB["light"][0][0])),
        )
        own = _linear(PROPULSION_A["moto"], PROPULSION_B["moto"], relative, F.lit(0.0))
        over = F.exp((MOTO_STEADY_DB + (MOTO_STOPPING_DB - MOTO_STEADY_DB) * fade) * LN10)
        scale = a_energy(car) / a_energy(own) * over
        return F.transform(push, lambda x: x * scale)
    cold = TEMPERATURE_K[category] * (20.0 - celsius)
    return _sum(push, _linear(ROLLING_A[category], ROLLING_B[category], ratio, rolls + cold + surface_db))


def a_energy(bands: Column) -> Column:
    """A-weighted sum of band energies."""
    weighted = F.zip_with(bands, _array([10 ** (w / 10) for w in A_WEIGHT_DB]), lambda x, w: x * w)
    return F.aggregate(weighted, F.lit(0.0), lambda a, x: a + x)


def road_energy(flows: dict[str, tuple[Column, Column]], *conditions: Column) -> Column:
    """Energy a metre of road by band. flows: vehicles an hour and speed by category (unknown or none: no part);
    conditions: as for vehicle_energy, without category and speed."""
    total = _array([0.0] * 8)
    for category, (flow, speed) in flows.items():
        good = (flow > 0) & (speed > 0)
        density = flow / (1000 * speed)
        one = vehicle_energy(category, speed, *conditions)
        total = _sum(total, F.coalesce(F.when(good, _scaled(one, density)), _array([0.0] * 8)))
    return total


def _scaled(bands: Column, by: Column) -> Column:
    return F.transform(bands, lambda x: x * by)


def turbine_dba(power_kw: Column) -> Column:
    """Sound power of a turbine at its yearly operating level."""
    out = F.lit(TURBINE_UNKNOWN_DBA)
    known = F.lit(None).cast("double")
    for start, value in TURBINE_DBA:
        known = F.when(F.floor(power_kw) >= start, value).otherwise(known)
    return F.coalesce(F.when((power_kw > 0) & ~F.isnan(power_kw), known), out) + WIND_DUTY_DB


def solar_dba(capacity_mw: Column, area_m2: Column) -> Column:
    mw = F.coalesce(F.when((capacity_mw > 0) & ~F.isnan(capacity_mw), capacity_mw), area_m2 / 10_000 * SOLAR_MW_PER_HA)
    return SOLAR_DBA + 10 * F.log10(F.greatest(mw, F.lit(1e-6))) + SOLAR_DUTY_DB


def substation_dba(mva: Column) -> Column:
    least, value = SUBSTATION_LEAST
    return F.when(mva <= least, value).otherwise(SUBSTATION_DBA + SUBSTATION_SLOPE * F.log10(F.greatest(mva, F.lit(least))))


def area_law_dba(hectare_dba: Column, area_m2: Column, cap_m2: float) -> Column:
    """Sound power of works of an area: that of a hectare and 10 lg of its effective hectares."""
    held = F.greatest(F.least(area_m2, F.lit(float(cap_m2))), F.lit(AREA_FLOOR_M2))
    return hectare_dba + 10 * F.log10(held / 10_000)


def spectrum_energy(dba: Column, spectrum: Sequence[float]) -> Column:
    """Band energies of a spectrum whose A-weighted sum is dba."""
    whole = 10 * math.log10(sum(10 ** ((s + w) / 10) for s, w in zip(spectrum, A_WEIGHT_DB, strict=True)))
    return F.transform(_array(spectrum), lambda s: energy(s - whole + dba))


def divergence_db(distance_m: Column, length_m: Column | None = None) -> Column:
    """Loss by spreading: of a point, or of a line of a length (the louder bound of its infinite line and of its whole
    power as a point is never passed)."""
    d = F.greatest(distance_m, F.lit(1.0))
    if length_m is None:
        return 20 * F.log10(d) + POINT_DB
    return -10 * F.log10(F.least(F.lit(math.pi) / d, length_m / (d * d))) + POINT_DB


def bound_energy(bands: Column, distance_m: Column, alpha_db_km: Sequence[float], length_m: Column | None = None) -> Column:
    """The A-weighted energy that a source of these band energies gives at most."""
    weights = _array([10 ** (w / 10) for w in A_WEIGHT_DB])
    air = F.transform(_array(alpha_db_km), lambda a: F.exp(-a * distance_m / 1000 * LN10))
    left = F.aggregate(F.zip_with(F.zip_with(bands, weights, lambda x, w: x * w), air, lambda x, a: x * a), F.lit(0.0), lambda s, x: s + x)
    return left * F.exp((LARGEST_GAIN_DB - divergence_db(distance_m, length_m)) * LN10)
