"""Bulk coordinate conversion: a list of column stages built once on the driver, applied in one pass."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.ellipsoid import GRS80, Ellipsoid, with_geocentric, with_geodetic
from cairn.functions.stages import apply_stages


@dataclass(frozen=True)
class Frame:
    """A reference frame by its transformation to the base frame: metres, arc-seconds, ppm, and yearly rates."""

    name: str
    ell: Ellipsoid = GRS80
    shift: Sequence[float] = (0.0, 0.0, 0.0)
    rotation: Sequence[float] = (0.0, 0.0, 0.0)
    scale: float = 0.0
    epoch: float = 0.0
    shift_rate: Sequence[float] = (0.0, 0.0, 0.0)
    rotation_rate: Sequence[float] = (0.0, 0.0, 0.0)
    scale_rate: float = 0.0
    # Displacement (de, dn, du columns) of the frame's points from its definition epoch to a date, as a
    # function (df, lon, lat, year) -> df with de, dn, du.
    deformation: Callable[[DataFrame, str, str, Column], DataFrame] | None = None
    deformation_epoch: float = 0.0

    def at(self, year: Column | None) -> tuple[list[Column], list[Column], Column]:
        """Shift, rotation (radians) and scale factor at a date."""
        span = (year - self.epoch) if year is not None and self.epoch else F.lit(0.0)
        shift = [F.lit(s) + span * r for s, r in zip(self.shift, self.shift_rate)]
        turn = [(F.lit(s) + span * r) * (math.pi / 648000.0) for s, r in zip(self.rotation, self.rotation_rate)]
        return shift, turn, 1.0 + (F.lit(self.scale) + span * self.scale_rate) * 1.0e-6


def _turn(stages: list, tag: str, xyz: list[Column], angles: list[Column], backward: bool) -> list[Column]:
    """Rotate the axes about x, y, z in turn (or undo that), one stage per axis."""
    cur = list(xyz)
    order = [2, 1, 0] if backward else [0, 1, 2]
    for i in order:
        j, k = (i + 1) % 3, (i + 2) % 3
        c, s = F.cos(angles[i]), F.sin(angles[i])
        if backward:
            s = -s
        nxt = list(cur)
        nxt[j] = cur[j] * c + cur[k] * s
        nxt[k] = cur[k] * c - cur[j] * s
        names = [f"_{tag}{i}{a}" for a in "xyz"]
        stages.append(dict(zip(names, nxt)))
        cur = [F.col(n) for n in names]
    return cur


def to_base(df: DataFrame, frame: Frame, x: str, y: str, z: str, year: Column | None = None) -> DataFrame:
    """Geocentric columns of a frame to the base frame: rotate, scale, shift."""
    shift, turn, scale = frame.at(year)
    stages: list = []
    cur = _turn(stages, "b", [F.col(x), F.col(y), F.col(z)], turn, False)
    stages.append({f"_o{a}": c * scale + s for a, c, s in zip("xyz", cur, shift)})
    return apply_stages(df, stages, {"_ox": x, "_oy": y, "_oz": z})


def from_base(df: DataFrame, frame: Frame, x: str, y: str, z: str, year: Column | None = None) -> DataFrame:
    """Undo :func:`to_base`."""
    shift, turn, scale = frame.at(year)
    stages: list = [{f"_i{a}": (F.col(n) - s) / scale for a, n, s in zip("xyz", (x, y, z), shift)}]
    cur = _turn(stages, "f", [F.col(f"_i{a}") for a in "xyz"], turn, True)
    stages.append({f"_o{a}": c for a, c in zip("xyz", cur)})
    return apply_stages(df, stages, {"_ox": x, "_oy": y, "_oz": z})


@dataclass(frozen=True)
class VerticalDatum:
    """Heights above a surface: a constant offset, and/or a function adding its ellipsoidal height as a column.

    ``surface(df, lon_deg, lat_deg) -> (df, column)``; ``base`` is the datum this one's offset is relative to.
    """

    name: str
    offset: float = 0.0
    surface: Callable[[DataFrame, str, str], tuple[DataFrame, Column]] | None = None
    base: "VerticalDatum | None" = None

    def chain(self) -> list["VerticalDatum"]:
        return [self, *(self.base.chain() if self.base else [])]


@dataclass(frozen=True)
class CoordinateSystem:
    """``kind`` is geodetic (degrees), projected or geocentric (metres)."""

    name: str
    kind: str
    frame: Frame
    projection: object | None = None
    vertical: VerticalDatum | None = None
    # lon_min, lat_min, lon_max, lat_max in degrees
    bounds: tuple[float, float, float, float] | None = None


def surface_height(df: DataFrame, datum: VerticalDatum, lon: str, lat: str) -> tuple[DataFrame, Column]:
    """Ellipsoidal height of a vertical datum's zero surface, summed along its chain."""
    total = F.lit(0.0)
    for i, d in enumerate(datum.chain()):
        total = total + d.offset
        if d.surface is not None:
            df, column = d.surface(df, lon, lat)
            df = df.withColumn(f"_surface{i}", column)
            total = total + F.col(f"_surface{i}")
    return df, total


def _deform(df: DataFrame, frame: Frame, year: Column | None, back: bool) -> DataFrame:
    """Between the date of conversion and the frame's definition epoch, on geodetic columns ``_lon, _lat, _hgt``."""
    from cairn.operators.deform import apply_displacement

    if frame.deformation is None or year is None:
        return df
    df = frame.deformation(df, "_lon", "_lat", year)
    sign = -1.0 if back else 1.0
    out = apply_displacement(
        df, "_lon", "_lat", "_hgt", F.col("de") * sign, F.col("dn") * sign, F.col("du") * sign, frame.ell
    )
    return out.drop("de", "dn", "du")


def in_bounds(lon: Column, lat: Column, bounds: tuple[float, float, float, float]) -> Column:
    """Inside a system's rectangle (degrees) once the longitude is brought into its turn."""
    turned = lon - 360.0 * F.floor((lon - bounds[0]) / 360.0)
    return turned.between(bounds[0], bounds[2]) & lat.between(bounds[1], bounds[3])


def convert(
    df: DataFrame, source: CoordinateSystem, target: CoordinateSystem, columns: tuple[str, str, str],
    out: tuple[str, str, str], year: Column | None = None,
) -> DataFrame:
    """Convert coordinate columns and add ``status``; rows that cannot be converted stay, with null results.

    Geodetic columns are longitude, latitude (degrees) and height; projected ones easting, northing, height.
    """
    keep = df.columns
    work = df.withColumns({"_1": F.col(columns[0]), "_2": F.col(columns[1]), "_3": F.col(columns[2])})
    same_frame = source.frame == target.frame
    if source.kind == "geocentric":
        work = with_geodetic(work, "_1", "_2", "_3", source.frame.ell, ("_lon", "_lat", "_hgt"))
    elif source.kind == "projected":
        work = source.projection.inverse(work, "_1", "_2", ("_lon", "_lat")).withColumn("_hgt", F.col("_3"))
    else:
        work = work.withColumns({"_lon": F.radians("_1"), "_lat": F.radians("_2"), "_hgt": F.col("_3")})
    if source.vertical is not None and source.vertical != target.vertical or source.vertical is not None and not same_frame:
        work = work.withColumns({"_lond": F.degrees("_lon"), "_latd": F.degrees("_lat")})
        work, surface = surface_height(work, source.vertical, "_lond", "_latd")
        work = work.withColumn("_hgt", F.col("_hgt") + surface)
        vertical_done = True
    else:
        vertical_done = source.vertical is None
    if not same_frame:
        work = _deform(work, source.frame, year, back=False)
        work = with_geocentric(work, "_lon", "_lat", "_hgt", source.frame.ell, ("_x", "_y", "_z"))
        work = to_base(work, source.frame, "_x", "_y", "_z", year)
        work = from_base(work, target.frame, "_x", "_y", "_z", year)
        work = with_geodetic(work, "_x", "_y", "_z", target.frame.ell, ("_lon", "_lat", "_hgt"))
        work = _deform(work, target.frame, year, back=True)
    if target.vertical is not None and vertical_done:
        work = work.withColumns({"_lond": F.degrees("_lon"), "_latd": F.degrees("_lat")})
        work, surface = surface_height(work, target.vertical, "_lond", "_latd")
        work = work.withColumn("_hgt", F.col("_hgt") - surface)
    work = work.withColumns({"_lond": F.degrees("_lon"), "_latd": F.degrees("_lat")})
    fits = in_bounds(F.col("_lond"), F.col("_latd"), target.bounds) if target.bounds else F.lit(True)
    if target.kind == "geocentric":
        work = with_geocentric(work, "_lon", "_lat", "_hgt", target.frame.ell, ("_r1", "_r2", "_r3"))
    elif target.kind == "projected":
        work = target.projection.forward(work, "_lon", "_lat", ("_r1", "_r2")).withColumn("_r3", F.col("_hgt"))
    else:
        work = work.withColumns({"_r1": F.col("_lond"), "_r2": F.col("_latd"), "_r3": F.col("_hgt")})
    usable = F.col("_r1").isNotNull() & F.col("_r2").isNotNull() & ~F.isnan("_r1") & ~F.isnan("_r2")
    status = (
        F.when(~F.coalesce(usable, F.lit(False)), "invalid")
        .when(~F.coalesce(fits, F.lit(False)), "range")
        .when(F.col("_r3").isNull(), "height")
        .otherwise("ok")
    )
    good = status.isin("ok", "height")
    return work.select(
        *keep, *[F.when(good, F.col(f"_r{i + 1}")).alias(n) for i, n in enumerate(out)], status.alias("status")
    )


def projection_bearing(df: DataFrame, projection, names=("f_lon", "f_lat", "t_lon", "t_lat"), out: str = "calc") -> DataFrame:
    """Grid bearing (0..2 pi) from one end to the other in a projection."""
    work = projection.forward(df, names[0], names[1], ("_fe", "_fn"))
    work = projection.forward(work, names[2], names[3], ("_te", "_tn"))
    bearing = F.atan2(F.col("_te") - F.col("_fe"), F.col("_tn") - F.col("_fn"))
    return work.withColumn(out, F.when(bearing < 0, bearing + 2 * math.pi).otherwise(bearing)).drop("_fe", "_fn", "_te", "_tn")
