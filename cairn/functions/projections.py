"""Map projections as column stages; angles in radians, lengths in metres."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.ellipsoid import GRS80, INTERNATIONAL_1924, Ellipsoid
from cairn.functions.stages import apply_stages


def wrap(angle: Column) -> Column:
    """Into -pi..pi."""
    return angle - 2.0 * math.pi * F.round(angle / (2.0 * math.pi))


def isometric(lat: Column, ell: Ellipsoid) -> Column:
    e = math.sqrt(ell.e2)
    s = F.sin(lat)
    return F.atanh(s) - (e * F.atanh(e * s) if e else F.lit(0.0))


def _isometric(lat: float, ell: Ellipsoid) -> float:
    e = math.sqrt(ell.e2)
    return math.atanh(math.sin(lat)) - (e * math.atanh(e * math.sin(lat)) if e else 0.0)


def from_conformal(chi: Column, ell: Ellipsoid) -> Column:
    """Geodetic latitude of a conformal latitude: its series in the third flattening, then one fixed-point step."""
    n = ell.n
    terms = (
        2 * n - 2 / 3 * n**2 - 2 * n**3 + 116 / 45 * n**4,
        7 / 3 * n**2 - 8 / 5 * n**3 - 227 / 45 * n**4,
        56 / 15 * n**3 - 136 / 35 * n**4,
        4279 / 630 * n**4,
    )
    e = math.sqrt(ell.e2)
    series = sum((t * F.sin(2.0 * (j + 1) * chi) for j, t in enumerate(terms)), chi)
    return F.atan(F.sinh(F.asinh(F.tan(chi)) + e * F.atanh(e * F.sin(series)))) if e else series


def from_isometric(q: Column, ell: Ellipsoid) -> Column:
    return from_conformal(F.atan(F.sinh(q)), ell)


@dataclass(frozen=True)
class TransverseMercator:
    """Krueger's series to the fourth order: below a tenth of a millimetre some thousands of km from the meridian."""

    lon0: float
    lat0: float = 0.0
    scale: float = 1.0
    fe: float = 0.0
    fn: float = 0.0
    ell: Ellipsoid = GRS80

    def _constants(self):
        n = self.ell.n
        radius = self.ell.a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
        alpha = (
            n / 2 - 2 / 3 * n**2 + 5 / 16 * n**3 + 41 / 180 * n**4,
            13 / 48 * n**2 - 3 / 5 * n**3 + 557 / 1440 * n**4,
            61 / 240 * n**3 - 103 / 140 * n**4,
            49561 / 161280 * n**4,
        )
        beta = (
            n / 2 - 2 / 3 * n**2 + 37 / 96 * n**3 - 1 / 360 * n**4,
            1 / 48 * n**2 + 1 / 15 * n**3 - 437 / 1440 * n**4,
            17 / 480 * n**3 - 37 / 840 * n**4,
            4397 / 161280 * n**4,
        )
        chi0 = math.atan(math.sinh(_isometric(self.lat0, self.ell)))
        xi0 = chi0 + sum(a * math.sin(2 * (j + 1) * chi0) for j, a in enumerate(alpha))
        return radius * self.scale, alpha, beta, xi0

    def forward(self, df: DataFrame, lon: str, lat: str, names=("easting", "northing")) -> DataFrame:
        radius, alpha, _, xi0 = self._constants()
        x, h = F.col("_xi"), F.col("_eta")
        stages = [
            {"_t": F.sinh(isometric(F.col(lat), self.ell)), "_dl": wrap(F.col(lon) - self.lon0)},
            {
                "_xi": F.atan2(F.col("_t"), F.cos("_dl")),
                "_eta": F.asinh(F.sin("_dl") / F.hypot(F.col("_t"), F.cos("_dl"))),
            },
            {
                "_pe": self.fe + radius * sum((a * F.cos(2 * (j + 1) * x) * F.sinh(2 * (j + 1) * h) for j, a in enumerate(alpha)), h),
                "_pn": self.fn
                + radius * (sum((a * F.sin(2 * (j + 1) * x) * F.cosh(2 * (j + 1) * h) for j, a in enumerate(alpha)), x) - xi0),
            },
        ]
        return apply_stages(df, stages, {"_pe": names[0], "_pn": names[1]})

    def inverse(self, df: DataFrame, easting: str, northing: str, names=("lon", "lat")) -> DataFrame:
        radius, _, beta, xi0 = self._constants()
        x, h = F.col("_xi"), F.col("_eta")
        stages = [
            {"_xi": (F.col(northing) - self.fn) / radius + xi0, "_eta": (F.col(easting) - self.fe) / radius},
            {
                "_xp": x - sum((b * F.sin(2 * (j + 1) * x) * F.cosh(2 * (j + 1) * h) for j, b in enumerate(beta)), F.lit(0.0)),
                "_ep": h - sum((b * F.cos(2 * (j + 1) * x) * F.sinh(2 * (j + 1) * h) for j, b in enumerate(beta)), F.lit(0.0)),
            },
            {
                "_chi": F.asin(F.sin("_xp") / F.cosh("_ep")),
                "_ilon": wrap(F.atan2(F.sinh("_ep"), F.cos("_xp")) + self.lon0),
            },
            {"_ilat": from_conformal(F.col("_chi"), self.ell)},
        ]
        return apply_stages(df, stages, {"_ilon": names[0], "_ilat": names[1]})


@dataclass(frozen=True)
class LambertConic:
    sp1: float
    sp2: float
    lat0: float
    lon0: float
    fe: float = 0.0
    fn: float = 0.0
    ell: Ellipsoid = GRS80

    def _constants(self):
        flip = 1.0 if self.sp1 + self.sp2 >= 0 else -1.0
        p1, p2, p0 = sorted((flip * self.sp1, flip * self.sp2)) + [flip * self.lat0]
        m = lambda p: math.cos(p) / math.sqrt(1 - self.ell.e2 * math.sin(p) ** 2)
        q1, q2, q0 = (_isometric(p, self.ell) for p in (p1, p2, p0))
        n = (math.log(m(p1)) - math.log(m(p2))) / (q2 - q1) if abs(p1 - p2) > 1e-5 else math.sin(p1)
        size = self.ell.a * m(p1) * math.exp(n * q1) / n
        return flip, n, size, size * math.exp(-n * q0)

    def forward(self, df: DataFrame, lon: str, lat: str, names=("easting", "northing")) -> DataFrame:
        flip, n, size, r0 = self._constants()
        stages = [
            {"_r": size * F.exp(-n * isometric(flip * F.col(lat), self.ell)), "_th": n * wrap(F.col(lon) - self.lon0)},
            {
                "_pe": self.fe + F.col("_r") * F.sin("_th"),
                "_pn": self.fn + flip * (r0 - F.col("_r") * F.cos("_th")),
            },
        ]
        return apply_stages(df, stages, {"_pe": names[0], "_pn": names[1]})

    def inverse(self, df: DataFrame, easting: str, northing: str, names=("lon", "lat")) -> DataFrame:
        flip, n, size, r0 = self._constants()
        stages = [
            {"_dx": F.col(easting) - self.fe, "_dy": r0 - flip * (F.col(northing) - self.fn)},
            {"_r": F.hypot("_dx", "_dy")},
            {
                "_ilon": wrap(F.atan2("_dx", "_dy") / n + self.lon0),
                "_ilat": flip * from_isometric(F.log(size / F.col("_r")) / n, self.ell),
            },
        ]
        return apply_stages(df, stages, {"_ilon": names[0], "_ilat": names[1]})


@dataclass(frozen=True)
class PolarStereographic:
    lon0: float
    scale: float = 1.0
    fe: float = 0.0
    fn: float = 0.0
    south: bool = True
    ell: Ellipsoid = GRS80

    @property
    def _size(self) -> float:
        e = math.sqrt(self.ell.e2)
        return 2 * self.scale * self.ell.a / math.sqrt(1 - self.ell.e2) * ((1 - e) / (1 + e)) ** (e / 2)

    def forward(self, df: DataFrame, lon: str, lat: str, names=("easting", "northing")) -> DataFrame:
        flip = -1.0 if self.south else 1.0
        at_pole = (math.pi / 2 - F.abs(F.col(lat))) < 0.00015 * math.pi / 180 / 3600
        stages = [
            {"_r": F.when(at_pole, 0.0).otherwise(self._size * F.exp(-isometric(flip * F.col(lat), self.ell)))},
            {
                "_pe": self.fe + F.col("_r") * F.sin(F.col(lon) - self.lon0),
                "_pn": self.fn - flip * F.col("_r") * F.cos(F.col(lon) - self.lon0),
            },
        ]
        return apply_stages(df, stages, {"_pe": names[0], "_pn": names[1]})

    def inverse(self, df: DataFrame, easting: str, northing: str, names=("lon", "lat")) -> DataFrame:
        flip = -1.0 if self.south else 1.0
        stages = [
            {"_dx": F.col(easting) - self.fe, "_dy": -flip * (F.col(northing) - self.fn)},
            {"_r": F.hypot("_dx", "_dy")},
            {
                "_ilon": wrap(F.atan2("_dx", "_dy") + self.lon0),
                "_ilat": F.when(F.col("_r") <= 0, flip * math.pi / 2).otherwise(
                    flip * from_isometric(F.log(self._size / F.col("_r")), self.ell)
                ),
            },
        ]
        return apply_stages(df, stages, {"_ilon": names[0], "_ilat": names[1]})


@dataclass(frozen=True)
class Mercator:
    lon0: float
    true_scale: float = 0.0
    ell: Ellipsoid = GRS80

    @property
    def _size(self) -> float:
        s = math.sin(self.true_scale)
        return self.ell.a * math.cos(self.true_scale) / math.sqrt(1 - self.ell.e2 * s * s)

    def forward(self, df: DataFrame, lon: str, lat: str, names=("easting", "northing")) -> DataFrame:
        stage = {
            "_pe": self._size * wrap(F.col(lon) - self.lon0),
            "_pn": self._size * isometric(F.col(lat), self.ell),
        }
        return apply_stages(df, [stage], {"_pe": names[0], "_pn": names[1]})

    def inverse(self, df: DataFrame, easting: str, northing: str, names=("lon", "lat")) -> DataFrame:
        stage = {
            "_ilon": wrap(F.col(easting) / self._size + self.lon0),
            "_ilat": from_isometric(F.col(northing) / self._size, self.ell),
        }
        return apply_stages(df, [stage], {"_ilon": names[0], "_ilat": names[1]})


@dataclass(frozen=True)
class Gnomonic:
    """From the centre of a sphere with the ellipsoid's equatorial radius."""

    lon0: float
    lat0: float
    fe: float = 0.0
    fn: float = 0.0
    ell: Ellipsoid = GRS80

    def forward(self, df: DataFrame, lon: str, lat: str, names=("easting", "northing")) -> DataFrame:
        s0, c0 = math.sin(self.lat0), math.cos(self.lat0)
        s, c = F.sin(F.col(lat)), F.cos(F.col(lat))
        stages = [
            {"_dl": F.col(lon) - self.lon0},
            {"_w": s0 * s + c0 * c * F.cos("_dl")},
            {
                "_pe": self.fe + self.ell.a * c * F.sin("_dl") / F.col("_w"),
                "_pn": self.fn + self.ell.a * (c0 * s - s0 * c * F.cos("_dl")) / F.col("_w"),
            },
        ]
        return apply_stages(df, stages, {"_pe": names[0], "_pn": names[1]})

    def inverse(self, df: DataFrame, easting: str, northing: str, names=("lon", "lat")) -> DataFrame:
        # The point's direction from the centre is (1, x, y) in axes turned to the origin.
        s0, c0 = math.sin(self.lat0), math.cos(self.lat0)
        x = (F.col(easting) - self.fe) / self.ell.a
        y = (F.col(northing) - self.fn) / self.ell.a
        stages = [
            {"_x": x, "_y": y},
            {"_u": c0 - F.col("_y") * s0, "_z": s0 + F.col("_y") * c0},
            {
                "_ilon": wrap(F.atan2("_x", "_u") + self.lon0),
                "_ilat": F.atan2(F.col("_z"), F.hypot("_x", "_u")),
            },
        ]
        return apply_stages(df, stages, {"_ilon": names[0], "_ilat": names[1]})


# Coefficients of the New Zealand map grid as published for that projection.
NZMG_LAT = (
    0.6399175073, -0.1358797613, 0.063294409, -0.02526853, 0.0117879,
    -0.0055161, 0.0026906, -0.001333, 0.00067, -0.00034,
)
NZMG_ISO = (
    1.5627014243, 0.5185406398, -0.03333098, -0.1052906, -0.0368594,
    0.007317, 0.01220, 0.00394, -0.0013,
)
NZMG_FORWARD = (
    (0.7557853228, 0.0), (0.249204646, 0.003371507), (-0.001541739, 0.041058560),
    (-0.10162907, 0.01727609), (-0.26623489, -0.36249218), (-0.6870983, -1.1651967),
)
NZMG_INVERSE = (
    (1.3231270439, 0.0), (-0.577245789, -0.007809598), (0.508307513, -0.112208952),
    (-0.15094762, 0.18200602), (1.01418179, 1.64497696), (1.9660549, 2.5127645),
)
NZMG_ORIGIN = {"lat": -41.0, "lon": 173.0, "fe": 2510000.0, "fn": 6023150.0}


def _times(a, b):
    return a[0] * b[0] - a[1] * b[1], a[0] * b[1] + a[1] * b[0]




def _poly(coefficients, x: Column) -> Column:
    acc = F.lit(0.0)
    for c in reversed(coefficients):
        acc = (acc + c) * x
    return acc


@dataclass(frozen=True)
class NewZealandMapGrid:
    ell: Ellipsoid = INTERNATIONAL_1924

    def forward(self, df: DataFrame, lon: str, lat: str, names=("easting", "northing")) -> DataFrame:
        o = NZMG_ORIGIN
        stages: list[dict[str, Column]] = [
            {
                "_re": _poly(NZMG_LAT, (F.degrees(F.col(lat)) - o["lat"]) * 3600.0 * 1.0e-5),
                "_im": F.col(lon) - math.radians(o["lon"]),
            }
        ]
        z = (F.col("_re"), F.col("_im"))
        # One stage per Horner step keeps the expression linear in the degree.
        last = (F.lit(0.0), F.lit(0.0))
        for k, (re, im) in enumerate(reversed(NZMG_FORWARD)):
            a, b = _times((last[0] + re, last[1] + im), z)
            stages.append({f"_a{k}": a, f"_b{k}": b})
            last = (F.col(f"_a{k}"), F.col(f"_b{k}"))
        stages.append({"_pe": o["fe"] + self.ell.a * last[1], "_pn": o["fn"] + self.ell.a * last[0]})
        return apply_stages(df, stages, {"_pe": names[0], "_pn": names[1]})

    def inverse(self, df: DataFrame, easting: str, northing: str, names=("lon", "lat")) -> DataFrame:
        o = NZMG_ORIGIN
        stages: list[dict[str, Column]] = [
            {"_zr": (F.col(northing) - o["fn"]) / self.ell.a, "_zi": (F.col(easting) - o["fe"]) / self.ell.a}
        ]

        def horner(tag: str, coefficients, z, constant=False):
            acc = (F.lit(0.0), F.lit(0.0))
            items = list(reversed(coefficients))
            for k, (re, im) in enumerate(items):
                acc = (acc[0] + re, acc[1] + im)
                if not (constant and k == len(items) - 1):
                    acc = _times(acc, z)
                stages.append({f"_{tag}r{k}": acc[0], f"_{tag}i{k}": acc[1]})
                acc = (F.col(f"_{tag}r{k}"), F.col(f"_{tag}i{k}"))
            return acc

        z = (F.col("_zr"), F.col("_zi"))
        t = horner("c", NZMG_INVERSE, z)
        for step in range(2):
            # Newton's step on the forward polynomial.
            top_c = [(i * re, i * im) for i, (re, im) in enumerate(NZMG_FORWARD)]
            low_c = [((i + 1) * re, (i + 1) * im) for i, (re, im) in enumerate(NZMG_FORWARD)]
            top = horner(f"t{step}", top_c, t)
            low = horner(f"l{step}", low_c, t, constant=True)
            top = (top[0] + z[0], top[1] + z[1])
            size = low[0] * low[0] + low[1] * low[1]
            quotient = _times(top, (low[0], -low[1]))
            stages.append({f"_n{step}r": quotient[0] / size, f"_n{step}i": quotient[1] / size})
            t = (F.col(f"_n{step}r"), F.col(f"_n{step}i"))
        stages.append(
            {
                "_ilon": t[1] + math.radians(o["lon"]),
                "_ilat": F.radians(o["lat"] + _poly(NZMG_ISO, t[0]) * 1.0e5 / 3600.0),
            }
        )
        return apply_stages(df, stages, {"_ilon": names[0], "_ilat": names[1]})
