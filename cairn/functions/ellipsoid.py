"""Ellipsoid arithmetic: geodetic and geocentric coordinates and local axes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.stages import apply_stages


@dataclass(frozen=True)
class Ellipsoid:
    a: float
    rf: float

    @property
    def f(self) -> float:
        return 1.0 / self.rf if self.rf else 0.0

    @property
    def b(self) -> float:
        return self.a * (1.0 - self.f)

    @property
    def e2(self) -> float:
        return self.f * (2.0 - self.f)

    @property
    def n(self) -> float:
        return self.f / (2.0 - self.f)


# Published ellipsoid dimensions.
GRS80 = Ellipsoid(6378137.0, 298.257222101)
WGS84 = Ellipsoid(6378137.0, 298.257223563)
INTERNATIONAL_1924 = Ellipsoid(6378388.0, 297.0)


def prime_vertical(lat: Column, ell: Ellipsoid) -> Column:
    return F.lit(ell.a) / F.sqrt(1.0 - F.lit(ell.e2) * F.sin(lat) * F.sin(lat))


def meridian_radius(lat: Column, ell: Ellipsoid) -> Column:
    w2 = 1.0 - F.lit(ell.e2) * F.sin(lat) * F.sin(lat)
    return F.lit(ell.a * (1.0 - ell.e2)) / (w2 * F.sqrt(w2))


def geocentric(lon: Column, lat: Column, hgt: Column, ell: Ellipsoid) -> tuple[Column, Column, Column]:
    """X, Y, Z of radians and metres."""
    nu = prime_vertical(lat, ell)
    return (
        (nu + hgt) * F.cos(lat) * F.cos(lon),
        (nu + hgt) * F.cos(lat) * F.sin(lon),
        (nu * (1.0 - ell.e2) + hgt) * F.sin(lat),
    )


def with_geocentric(df: DataFrame, lon: str, lat: str, hgt: str, ell: Ellipsoid, names=("x", "y", "z")) -> DataFrame:
    x, y, z = geocentric(F.col(lon), F.col(lat), F.col(hgt), ell)
    return df.withColumns(dict(zip(names, (x, y, z))))


def with_geodetic(
    df: DataFrame, x: str, y: str, z: str, ell: Ellipsoid, names=("lon", "lat", "hgt"), steps: int = 4
) -> DataFrame:
    """Longitude, latitude (radians) and height of geocentric columns, by a fixed number of refinements."""
    ep2 = ell.e2 / (1.0 - ell.e2)
    stages = [
        {"_p": F.hypot(F.col(x), F.col(y))},
        {"_u0": F.atan2(F.col(z) * ell.a, F.col("_p") * ell.b)},
    ]
    for i in range(steps):
        u = F.col(f"_u{i}")
        lat = F.atan2(
            F.col(z) + ep2 * ell.b * F.pow(F.sin(u), 3), F.col("_p") - ell.e2 * ell.a * F.pow(F.cos(u), 3)
        )
        stages.append({f"_lat{i}": lat})
        stages.append({f"_u{i + 1}": F.atan2((1.0 - ell.f) * F.sin(f"_lat{i}"), F.cos(f"_lat{i}"))})
    last = f"_lat{steps - 1}"
    s, c = F.sin(last), F.cos(last)
    stages.append(
        {
            "_glon": F.atan2(F.col(y), F.col(x)),
            "_glat": F.col(last),
            "_ghgt": F.col("_p") * c + F.col(z) * s - ell.a * F.sqrt(1.0 - ell.e2 * s * s),
        }
    )
    return apply_stages(df, stages, dict(zip(("_glon", "_glat", "_ghgt"), names)))


def to_enu(lon: Column, lat: Column, dx: Column, dy: Column, dz: Column) -> tuple[Column, Column, Column]:
    """East, north, up components of a geocentric difference at a position in radians."""
    return (
        dy * F.cos(lon) - dx * F.sin(lon),
        dz * F.cos(lat) - F.sin(lat) * (dx * F.cos(lon) + dy * F.sin(lon)),
        dz * F.sin(lat) + F.cos(lat) * (dx * F.cos(lon) + dy * F.sin(lon)),
    )


def to_xyz(lon: Column, lat: Column, e: Column, n: Column, u: Column) -> tuple[Column, Column, Column]:
    """Geocentric components of an east, north, up difference."""
    radial = u * F.cos(lat) - n * F.sin(lat)
    return (
        radial * F.cos(lon) - e * F.sin(lon),
        radial * F.sin(lon) + e * F.cos(lon),
        n * F.cos(lat) + u * F.sin(lat),
    )


def enu_axes(lon: Column, lat: Column) -> list[list[Column]]:
    """Rows are the east, north and up unit vectors in geocentric axes."""
    zero = F.lit(0.0)
    return [
        [-F.sin(lon), F.cos(lon), zero],
        [-F.sin(lat) * F.cos(lon), -F.sin(lat) * F.sin(lon), F.cos(lat)],
        [F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat)],
    ]


# Lower-triangle order of a 3x3 covariance: 11, 21, 22, 31, 32, 33.
LOWER = [(0, 0), (1, 0), (1, 1), (2, 0), (2, 1), (2, 2)]


def rotate_covariance(cov: list[Column], axes: list[list[Column]], transpose: bool = False) -> list[Column]:
    """Lower triangle of ``R C R'`` (or ``R' C R``) for a six-element lower triangle ``cov``."""
    full = [[None] * 3 for _ in range(3)]
    for value, (i, j) in zip(cov, LOWER):
        full[i][j] = full[j][i] = value
    r = [[axes[j][i] for j in range(3)] for i in range(3)] if transpose else axes
    out = []
    for i, j in LOWER:
        total = F.lit(0.0)
        for k in range(3):
            for m in range(3):
                total = total + r[i][k] * full[k][m] * r[j][m]
        out.append(total)
    return out
