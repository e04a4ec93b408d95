"""Observation rules: ignore, reject, reweight, added errors, antenna heights, options and station modes.

A rule is data. Its condition is a Column over the flagged observations, so a
rule list becomes one wide pass; only per-set effects need a grouping, and that
grouping carries one boolean per rule.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.ellipsoid import enu_axes, rotate_covariance


@dataclass(frozen=True)
class Rule:
    """One modification: what it does to which observations."""

    name: str
    when: Column
    action: str  # ignore, reject, reweight, reweight_set, offset_error, centroid_error, antenna, set_option, unset_option
    factor: float = 1.0
    factor_v: float = 0.0
    option: int = 0
    match_from: Column = field(default_factory=lambda: F.lit(True))
    match_to: Column = field(default_factory=lambda: F.lit(True))


def _flags(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One boolean per rule; an ignore rule hides its rows from every later rule."""
    alive = F.lit(True)
    out = df
    for i, rule in enumerate(rules):
        hit = F.coalesce(rule.when, F.lit(False)) & alive
        out = out.withColumn(f"_r{i}", hit)
        if rule.action == "ignore":
            alive = alive & ~F.col(f"_r{i}")
    return out


def _product(flags: list[tuple[str, float]]) -> Column:
    out = F.lit(1.0)
    for name, factor in flags:
        out = out * F.when(F.col(name), factor).otherwise(1.0)
    return out


def _total(flags: list[tuple[Column, float]]) -> Column:
    out = F.lit(0.0)
    for hit, amount in flags:
        out = out + F.when(hit, amount).otherwise(0.0)
    return out


def apply_rules(observations: DataFrame, rules: Sequence[Rule], set_id: str = "set_id") -> DataFrame:
    """Observations with rules applied.

    Adds ``ignored``, ``rejected``, ``error_factor`` (per row), ``set_factor``,
    ``offset_hv``/``offset_vv`` (variance at the target), ``centroid_hv``/``centroid_vv``
    (variance common to the set, base offsets included), ``to_hgt_add``,
    ``from_hgt_add`` and ``options``. Ignored rows stay, flagged; drop them with a filter.
    """
    df = _flags(observations, rules)
    flag = {i: f"_r{i}" for i in range(len(rules))}
    baseline = F.col("obs_type") == "GB" if "obs_type" in observations.columns else F.lit(False)
    vector = F.col("obs_type").isin("GB", "GX") if "obs_type" in observations.columns else F.lit(False)

    def chosen(action: str) -> list[int]:
        return [i for i, r in enumerate(rules) if r.action == action]

    # Effects that count once per set even when several members match.
    once = chosen("reweight_set") + chosen("centroid_error") + chosen("offset_error") + chosen("antenna")
    if once:
        member = {
            i: F.col(flag[i])
            & (baseline & rules[i].match_from if rules[i].action in ("offset_error", "antenna") else F.lit(True))
            for i in once
        }
        per_set = df.filter(F.col(set_id).isNotNull()).groupBy(set_id).agg(*[F.max(member[i]).alias(f"_s{i}") for i in once])
        # A row without a set is a set by itself.
        df = df.join(per_set, set_id, "left").withColumns(
            {f"_s{i}": F.when(F.col(set_id).isNull(), member[i]).otherwise(F.col(f"_s{i}")) for i in once}
        )
    had_reject = F.col("rejected") if "rejected" in observations.columns else F.lit(False)
    hits = lambda ids: [F.col(flag[i]) for i in ids]
    any_hit = lambda cols: F.greatest(F.lit(False), F.lit(False), *cols) if cols else F.lit(False)
    square = lambda v: v * v
    base_offsets = [(F.col(f"_s{i}"), rules[i]) for i in chosen("offset_error")]
    centroids = [(F.col(f"_s{i}"), rules[i]) for i in chosen("centroid_error")]
    options = F.col("options") if "options" in observations.columns else F.lit(0)
    for i, rule in enumerate(rules):
        if rule.action == "set_option":
            options = F.when(F.col(flag[i]), options.bitwiseOR(F.lit(rule.option))).otherwise(options)
        elif rule.action == "unset_option":
            options = F.when(F.col(flag[i]), options.bitwiseAND(F.lit(~rule.option))).otherwise(options)
    out = df.withColumns(
        {
            "ignored": any_hit(hits(chosen("ignore"))),
            "rejected": any_hit(hits(chosen("reject"))) | had_reject,
            "error_factor": _product([(flag[i], rules[i].factor) for i in chosen("reweight")]),
            "set_factor": _product([(f"_s{i}", rules[i].factor) for i in chosen("reweight_set")]),
            "offset_hv": _total(
                [(F.col(flag[i]) & rules[i].match_to, square(rules[i].factor)) for i in chosen("offset_error")]
            ),
            "offset_vv": _total(
                [(F.col(flag[i]) & rules[i].match_to, square(rules[i].factor_v)) for i in chosen("offset_error")]
            ),
            "centroid_hv": _total([(c, square(r.factor)) for c, r in base_offsets + centroids]),
            "centroid_vv": _total([(c, square(r.factor_v)) for c, r in base_offsets + centroids]),
            "to_hgt_add": _total(
                [(F.col(flag[i]) & vector & rules[i].match_to, rules[i].factor) for i in chosen("antenna")]
            ),
            "from_hgt_add": _total([(F.col(f"_s{i}"), rules[i].factor) for i in chosen("antenna")]),
            "options": options,
        }
    )
    return out.drop(*flag.values(), *[f"_s{i}" for i in once])


def rule_usage(observations: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """How many observations each rule matched, as one row per rule."""
    df = _flags(observations, rules)
    counts = df.agg(*[F.count_if(F.col(f"_r{i}")).alias(f"_c{i}") for i in range(len(rules))])
    rows = F.array(
        *[
            F.struct(F.lit(r.name).alias("rule"), F.lit(r.action).alias("action"), F.col(f"_c{i}").alias("matched"))
            for i, r in enumerate(rules)
        ]
    )
    return counts.select(F.inline(rows))


def scale_covariance_blocks(
    blocks: DataFrame, members: DataFrame, set_id: str = "set_id"
) -> DataFrame:
    """Covariance elements ``(set_id, i, j, r, c, value)`` scaled by the members' factors and widened by their errors.

    ``members(set_id, i, factor, offset_hv, offset_vv, centroid_hv, centroid_vv, lon, lat)`` has one row per
    observation of the set. Row and column factors multiply, so off-diagonal blocks take one of each. The
    centroid part uses the set's position in ``set_lon``/``set_lat``.
    """
    left = members.select(
        set_id, F.col("i"), F.col("factor").alias("_fi"), "offset_hv", "offset_vv", "centroid_hv", "centroid_vv",
        "lon", "lat", "set_lon", "set_lat",
    )
    right = members.select(F.col(set_id), F.col("i").alias("j"), F.col("factor").alias("_fj"))
    joined = blocks.join(left, [set_id, "i"]).join(right, [set_id, "j"])

    def local(hv: str, vv: str, lon: str, lat: str) -> Column:
        zero = F.lit(0.0)
        tri = rotate_covariance(
            [F.col(hv), zero, F.col(hv), zero, zero, F.col(vv)], enu_axes(F.col(lon), F.col(lat)), transpose=True
        )
        index = F.greatest("r", "c") * (F.greatest("r", "c") + 1) / 2 + F.least("r", "c")
        return F.element_at(F.array(*tri), (index + 1).cast("int"))

    own = F.when(F.col("i") == F.col("j"), local("offset_hv", "offset_vv", "lon", "lat")).otherwise(0.0)
    common = local("centroid_hv", "centroid_vv", "set_lon", "set_lat")
    return joined.select(
        set_id, "i", "j", "r", "c", (F.col("value") * F.col("_fi") * F.col("_fj") + own + common).alias("value")
    )


def file_factor(observations: DataFrame, files: DataFrame) -> DataFrame:
    """Scale each observation's error by its file's factor; files without one keep their errors."""
    dim = files.select("data_file", F.col("factor").alias("_factor"))
    return (
        observations.join(dim, "data_file", "left")
        .withColumn("error", F.col("error") * F.coalesce(F.col("_factor"), F.lit(1.0)))
        .drop("_factor")
    )


@dataclass(frozen=True)
class ModeRule:
    """A station-mode command; ``h``/``v`` left as None keep what earlier rules set."""

    when: Column
    h: str | None = None
    v: str | None = None
    h_error: float | None = None
    v_error: float | None = None


def station_modes(stations: DataFrame, rules: Sequence[ModeRule], default: str = "free") -> DataFrame:
    """Horizontal and vertical mode per station; the last matching rule wins on each axis.

    ``ignore`` and ``reject`` are modes of both axes; ``accept`` takes a station back to the default.
    """
    mode = {"h": F.lit(default), "v": F.lit(default)}
    error = {"h": F.lit(None).cast("double"), "v": F.lit(None).cast("double")}
    use = F.lit("use")
    for rule in rules:
        hit = F.coalesce(rule.when, F.lit(False))
        for axis, value, err in (("h", rule.h, rule.h_error), ("v", rule.v, rule.v_error)):
            if value in ("ignore", "reject", "accept"):
                use = F.when(hit, "use" if value == "accept" else value).otherwise(use)
            elif value is not None:
                mode[axis] = F.when(hit, value).otherwise(mode[axis])
                error[axis] = F.when(hit, F.lit(err).cast("double")).otherwise(error[axis])
    return stations.withColumns(
        {"mode_h": mode["h"], "mode_v": mode["v"], "float_h": error["h"], "float_v": error["v"], "use": use}
    )
