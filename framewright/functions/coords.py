"""Column expressions: coordinates, units, times, arrays."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def center(size: Column | int) -> Column:
    """Middle of an axis of ``size`` cells."""
    return (F.lit(size) if isinstance(size, int) else size) / 2 - 0.5


def rotated(x: Column, y: Column, cx: Column, cy: Column, degrees: Column) -> tuple[Column, Column]:
    """A point turned about (cx, cy)."""
    phi, dx, dy = F.radians(degrees), x - cx, y - cy
    return cx + dx * F.cos(phi) - dy * F.sin(phi), cy + dx * F.sin(phi) + dy * F.cos(phi)


def polar_to_cartesian(separation: Column, angle: Column, cx: Column, cy: Column) -> tuple[Column, Column]:
    """Angle in radians, zero pointing up."""
    phi = angle + math.pi / 2
    return cx + separation * F.cos(phi), cy + separation * F.sin(phi)


def cartesian_to_polar(x: Column, y: Column, cx: Column, cy: Column) -> tuple[Column, Column]:
    """Separation and angle; the angle keeps its sign."""
    angle = (F.atan2(y - cy, x - cx) - math.pi / 2) % F.lit(2 * math.pi)
    return F.hypot(x - cx, y - cy), angle


def in_pixels(value: Column, unit: Column, pixscale: Column, lambda_over_d: Column) -> Column:
    """A length in pixels; units are pixel, arcsec and lambda/D."""
    return F.when(unit == "pixel", value).when(unit == "arcsec", value / pixscale).when(unit == "lambda_over_d", value * lambda_over_d / pixscale)


def magnitudes(flux_ratio: Column) -> Column:
    """NULL where the ratio is not positive."""
    return -2.5 * F.log10(F.when(flux_ratio > 0, flux_ratio))


def flux_ratio(magnitude: Column) -> Column:
    return F.pow(F.lit(10.0), -magnitude / 2.5)


def gaussian_integral(amplitude: Column, sigma: Column, radius: float = 0.5) -> Column:
    """A circular Gaussian over a disk at its centre."""
    return 2 * math.pi * amplitude * sigma * sigma * (1 - F.exp(-(radius**2) / (2 * sigma * sigma)))


def round_minutes(ts: Column, up: bool, resolution: int = 5) -> Column:
    """To a multiple of ``resolution`` minutes, seconds dropped; up always moves on."""
    minute = F.date_trunc("minute", ts)
    step = F.minute(ts) % resolution
    shift = (F.lit(resolution) - step) if up else -step
    return F.timestamp_seconds(F.unix_timestamp(minute) + shift * 60)


def geometric_steps(start: float, stop: float, n: int) -> Column:
    """``n`` values in equal ratios."""
    if n < 2:
        return F.array(F.lit(float(start)))
    ratio = stop / start
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lit(float(start)) * F.pow(F.lit(ratio), i / float(n - 1)))


def dot(a: Column, b: Column) -> Column:
    """Of two series."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def checked(ok: Column, value: Column, message: str) -> Column:
    """``value``, or an error where ``ok`` does not hold."""
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message)).cast("double"))


def clipped(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(value, F.lit(high)), F.lit(low))


INJECTION_ANGLES = {"a": 270.0, "b": 330.0, "c": 30.0, "d": 90.0, "e": 150.0, "f": 210.0}  # fixed values


def injection_angle(label: Column) -> Column:
    """Degrees of the six azimuthal positions; another label is an error."""
    found = F.create_map(*[F.lit(x) for pair in INJECTION_ANGLES.items() for x in pair])[label]
    return checked(found.isNotNull(), found, "unknown azimuthal position")


def with_setting(config: Column, path: str, value: Column) -> Column:
    """A nested field of a struct, named by its dotted path, set to ``value``."""
    return config.withField(path, value)


def flattened(name: str, schema: StructType, separator: str = "_") -> list[Column]:
    """The leaves of a struct column, each named by the fields that lead to it."""
    def leaves(path: tuple[str, ...], kind: StructType) -> list[Column]:
        out = []
        for f in kind.fields:
            below = (*path, f.name)
            if isinstance(f.dataType, StructType):
                out += leaves(below, f.dataType)
            else:
                out.append(F.col(".".join(f"`{p}`" for p in (name, *below))).alias(separator.join(below)))
        return out

    return leaves((), schema)
