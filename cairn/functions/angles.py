"""Angle text to degrees and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DMS = r"^\s*([-NSEWnsew]?)\s*(\d{1,3})[\s:]+(\d{1,2})[\s:]+(\d{1,2}(?:\.\d*)?)\s*([NSEWnsew]?)\s*$"
_HP = r"^\s*(-?)(\d{1,3})\.(\d{2})(\d{2})(\d*)\s*$"


def _signed(value: Column, sign: Column, hemispheres: str) -> Column:
    mark = F.upper(sign)
    if not hemispheres:
        return F.when(mark == "", value)
    plus, minus = hemispheres
    return (
        F.when((mark == "") | (mark == plus), value).when((mark == "-") | (mark == minus), -value)
    )


def _checked(deg: Column, minute: Column, sec: Column) -> Column:
    value = deg + minute / F.lit(60.0) + sec / F.lit(3600.0)
    return F.when((deg < 360) & (minute < 60) & (sec < 60), value)


def parse_dms(text: Column, hemispheres: str = "") -> Column:
    """Degrees from ``D M S[.s]`` with an optional sign or hemisphere letter; NULL when badly formed."""
    part = lambda i: F.regexp_extract(text, _DMS, i)
    value = _checked(part(2).try_cast("double"), part(3).try_cast("double"), part(4).try_cast("double"))
    one_mark = (part(1) == "") | (part(5) == "")
    return F.when(text.rlike(_DMS) & one_mark, _signed(value, F.concat(part(1), part(5)), hemispheres))


def parse_hp(text: Column, hemispheres: str = "") -> Column:
    """Degrees from packed ``D.MMSSssss``; missing digits read as zeros."""
    padded = F.concat(F.when(text.contains("."), F.trim(text)).otherwise(F.concat(F.trim(text), F.lit("."))), F.lit("0000"))
    part = lambda i: F.regexp_extract(padded, _HP, i)
    seconds = F.concat(part(4), F.lit("."), part(5)).try_cast("double")
    value = _checked(part(2).try_cast("double"), part(3).try_cast("double"), seconds)
    return F.when(padded.rlike(_HP), _signed(value, part(1), hemispheres))


def parse_angle(text: Column, form: str = "degrees", hemispheres: str = "") -> Column:
    if form in ("dms", "dms_angles"):
        return parse_dms(text, hemispheres)
    if form in ("hp", "hp_angles"):
        return parse_hp(text, hemispheres)
    if form in ("deg", "degrees", "deg_angles"):
        return F.trim(text).try_cast("double")
    raise ValueError(f"unknown angle form {form!r}")


def parse_coordinate_text(text: Column, hemispheres: str) -> Column:
    """Decimal degrees or degrees-minutes-seconds, whichever the text holds."""
    return F.coalesce(F.trim(text).try_cast("double"), parse_dms(text, hemispheres))


def format_dms(degrees: Column, places: int, hemispheres: str = "") -> Column:
    """``D MM SS.sss`` text with seconds rounded first so that 60 seconds never shows."""
    scale = 10**places
    units = F.round(F.abs(degrees) * F.lit(3600.0 * scale)).cast("long")
    deg = F.floor(units / F.lit(3600 * scale)).cast("long")
    minute = F.pmod(F.floor(units / F.lit(60 * scale)).cast("long"), F.lit(60))
    whole = F.pmod(F.floor(units / F.lit(scale)).cast("long"), F.lit(60))
    frac = F.pmod(units, F.lit(scale).cast("long"))
    sec = F.lpad(whole.cast("string"), 2, "0")
    if places:
        sec = F.concat(sec, F.lit("."), F.lpad(frac.cast("string"), places, "0"))
    body = F.concat_ws(" ", deg.cast("string"), F.lpad(minute.cast("string"), 2, "0"), sec)
    negative = degrees < 0
    if hemispheres:
        return F.concat_ws(" ", body, F.when(negative, hemispheres[1]).otherwise(hemispheres[0]))
    return F.concat(F.when(negative, "-").otherwise(""), body)
