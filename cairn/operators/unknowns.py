"""What an adjustment models beside the positions: named unknowns with their values and ties, paired marks, motion, correlated sets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.ellipsoid import GRS80, Ellipsoid, meridian_radius, prime_vertical
from cairn.operators import covariance, observe
from cairn.operators.graph import connected_components
from cairn.plans.lineage import cut
from cairn.plans.skew import bounded_broadcast, salted_join

KINDS = ("distsf", "refcoef", "brngref", "syserr", "frame")


@dataclass(frozen=True)
class Model:
    """Tables an adjustment may be given besides observations and stations; each may be left out.

    ``parameters(name, value, solve)``: values known beforehand, in the names of the equations (``refcoef|day1``). They are
    taken off the misclosures; unknowns with ``solve`` false leave the equations, for the others the change is solved for.
    ``ties(param, same_as)``: unknowns that are one. In ``name`` and ``param``, ``*`` and ``?`` stand for any text and any
    character behind the kind: an exact name goes before a pattern, a longer pattern before a shorter.
    ``colocated(a, b, h_error, v_error)``: marks held together. ``displacements(code, year, de, dn, du)``: how far a mark
    has moved by the date of an observation (its column ``year``); rows of one mark and date add up.
    ``blocks(set_id, i, j, cov)``: covariances of the vectors that have a member number ``i`` in their set.
    """

    parameters: DataFrame | None = None
    ties: DataFrame | None = None
    colocated: DataFrame | None = None
    displacements: DataFrame | None = None
    blocks: DataFrame | None = None


def line_terms(columns: list[str]) -> list[Column]:
    """Terms that lines name in ``distsf`` (distances), ``refcoef`` (zenith distances) and ``brngref`` (azimuths and bearings)."""
    kind = F.col("obs_type")
    wanted = {
        "distsf": (("SD", "HD", "ED", "MD"), observe.scale_term),
        "refcoef": (("ZD",), observe.refraction_term),
        "brngref": (("AZ", "PB"), observe.orientation_term),
    }
    return [F.when(kind.isin(*types), term(F.col(name))) for name, (types, term) in wanted.items() if name in columns]


def with_systematic(equations: DataFrame) -> DataFrame:
    """Equations with the terms of their column ``systematic array<struct<prm, influence>>``, where they have one."""
    if "systematic" not in equations.columns:
        return equations
    terms = F.filter(observe.systematic_terms(F.col("systematic")), lambda t: t["param"].isNotNull() & t["coef"].isNotNull())
    return equations.withColumn("design", F.when(F.col("systematic").isNull(), F.col("design")).otherwise(F.concat("design", terms)))


def displaced(resolved: DataFrame, displacements: DataFrame, ell: Ellipsoid = GRS80) -> DataFrame:
    """Resolved observations with both ends moved to where they were in the observation's ``year``.

    Marks that are held fixed move as well. Observations without a year, and marks without a displacement for it, stay.
    """
    moved = displacements.groupBy("code", "year").agg(*[F.sum(c).alias(c) for c in ("de", "dn", "du")])
    out = resolved
    for end, code in (("f", "from_code"), ("t", "to_code")):
        d = moved.select(F.col("code").alias(code), "year", *[F.col(c).alias(f"_{c}") for c in ("de", "dn", "du")])
        out = salted_join(out, d, [code, "year"], ["obs_key"], how="left")
        lon, lat, up = (F.col(f"{end}_{c}") for c in ("lon", "lat", "ohgt"))
        h = up + F.col(f"{end}_und")
        by = lambda c: F.coalesce(F.col(c), F.lit(0.0))
        out = out.withColumns(
            {
                f"{end}_lon": lon + by("_de") / ((prime_vertical(lat, ell) + h) * F.cos(lat)),
                f"{end}_lat": lat + by("_dn") / (meridian_radius(lat, ell) + h),
                f"{end}_ohgt": up + by("_du"),
            }
        ).drop("_de", "_dn", "_du")
    return out


def correlated_rows(vectors: DataFrame, blocks: DataFrame, **vector_options) -> DataFrame:
    """Equations of vectors whose sets have covariances between members, uncorrelated by set.

    Rejected members leave the set together with their covariances; their rows come back unused. A set's own
    translations stay parameters, named ``session|<set>|tx`` and so on, as whitening mixes the members' equations.
    """
    unit = F.array(*[F.lit(v) for v in (1.0, 0.0, 1.0, 0.0, 0.0, 1.0)])
    raw = observe.vector_rows(vectors.withColumn("cov", unit), **vector_options)
    if "set_design" in raw.columns:
        named = F.transform(
            "set_design", lambda t: F.struct(F.concat(F.lit("session|"), F.col("set_id"), F.lit("|"), t["param"]).alias("param"), t["coef"].alias("coef"))
        )
        raw = raw.withColumn("design", F.concat("design", named)).drop("set_design")
    raw = cut(raw.select("obs_key", "set_id", F.col("i").cast("long").alias("i"), "component", "misclosure", "weight", "used", "design"))
    members = raw.filter("used AND component = 0").select("set_id", "i", "obs_key")
    known = blocks.select("set_id", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "cov")
    known = known.join(members.select("set_id", "i"), ["set_id", "i"], "left_semi")
    known = known.join(members.select("set_id", F.col("i").alias("j")), ["set_id", "j"], "left_semi")
    white = covariance.whiten_sets(raw.filter("used").select("set_id", "i", "component", "misclosure", "design"), known)
    white = white.join(members, ["set_id", "i"]).withColumn("used", F.lit(True))
    columns = ["obs_key", "set_id", "component", "misclosure", "weight", "used", "design"]
    return white.select(*columns).unionByName(raw.filter("NOT used").select(*columns))


def _kind(name: Column | str) -> Column:
    return F.substring_index(name, "|", 1)


def _matched(seen: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """Every seen name with the row of ``table`` that names it best; a name that patterns tie on takes the larger pattern."""
    wild = F.coalesce(F.col(column).rlike(r"[*?]"), F.lit(False))
    exact = seen.join(table.filter(~wild).withColumnRenamed(column, "_said"), F.col("param") == F.col("_said"))
    text = F.replace(F.replace(F.col("_said"), F.lit("*"), F.lit(r"\E.*\Q")), F.lit("?"), F.lit(r"\E.\Q"))
    patterns = table.filter(wild).withColumnRenamed(column, "_said").withColumn("_like", F.concat(F.lit(r"^\Q"), text, F.lit(r"\E$")))
    fits = seen.join(bounded_broadcast(patterns), F.regexp_like(F.col("param"), F.col("_like")) & (_kind("param") == _kind("_said")))
    both = exact.withColumn("_rank", F.lit(1)).unionByName(fits.drop("_like").withColumn("_rank", F.lit(0)))
    rest = [c for c in both.columns if c not in ("param", "_rank")]
    best = both.groupBy("param").agg(F.max_by(F.struct(*rest), F.struct("_rank", F.length("_said"), F.col("_said"))).alias("_b"))
    return best.select("param", "_b.*").drop("_said")


def resolved_names(equations: DataFrame, model: Model) -> DataFrame | None:
    """``(param, name, value, solve)`` of every named unknown of the equations: the class it is tied into, with the class's value.

    Null without values and ties. An unknown without a value starts at zero and is solved for; one tied to others takes theirs.
    Classes that are given different values are refused.
    """
    if model.parameters is None and model.ties is None:
        return None
    seen = cut(equations.select(F.explode("design.param").alias("param")).filter(_kind("param").isin(*KINDS)).distinct())
    out = seen.withColumn("name", F.col("param"))
    if model.ties is not None:
        # A tie may lead through a name that no equation has.
        every = seen.unionByName(model.ties.select(F.col("same_as").alias("param"))).filter("param IS NOT NULL").distinct()
        links = _matched(every, model.ties.select(F.col("param").alias("_from"), "same_as").distinct(), "_from")
        # An exact name may be tied to several others.
        stated = model.ties.filter("param IS NOT NULL AND same_as IS NOT NULL").filter(~F.col("param").rlike(r"[*?]"))
        links = links.unionByName(stated.select("param", "same_as"))
        groups = connected_components(links.select(F.col("param").alias("a"), F.col("same_as").alias("b")))
        out = every.join(groups, F.col("param") == F.col("node"), "left").select("param", F.coalesce("component", "param").alias("name"))
    if model.parameters is not None:
        given = model.parameters.select("name", F.col("value").cast("double").alias("value"), F.coalesce("solve", F.lit(True)).alias("solve"))
        valued = _matched(out.select("param"), given.withColumnRenamed("name", "_name"), "_name")
        classes = out.join(valued, "param").groupBy("name").agg(
            F.count_distinct(F.struct("value", "solve")).alias("_n"), F.max("value").alias("value"), F.bool_and("solve").alias("solve")
        )
        classes = cut(classes)
        odd = classes.filter("_n > 1").agg(F.min("name")).first()[0]
        if odd is not None:
            raise ValueError(f"unknowns tied to {odd} are given different values")
        out = out.join(classes.drop("_n"), "name", "left")
    else:
        out = out.withColumns({"value": F.lit(None).cast("double"), "solve": F.lit(True)})
    out = out.join(seen, "param", "left_semi")
    return cut(out.select("param", "name", F.coalesce("value", F.lit(0.0)).alias("value"), F.coalesce("solve", F.lit(True)).alias("solve")))


def with_names(equations: DataFrame, names: DataFrame | None) -> DataFrame:
    """Equations in the unknowns that remain: tied ones summed under one name, known values taken off the misclosures.

    Only equations that have a named unknown are taken apart.
    """
    if names is None:
        return equations
    named = F.exists("design", lambda t: _kind(t["param"]).isin(*KINDS))
    # Written once, so both sides of the join back see the same numbers.
    flat = cut(equations.filter(named).withColumn("_eq", F.monotonically_increasing_id()))
    terms = flat.select("_eq", F.explode("design").alias("_t")).select("_eq", "_t.param", "_t.coef")
    known = terms.join(bounded_broadcast(names), "param", "left").select(
        "_eq", F.coalesce("name", "param").alias("param"), "coef", F.coalesce("value", F.lit(0.0)).alias("value"), F.coalesce("solve", F.lit(True)).alias("solve")
    )
    sums = known.groupBy("_eq", "param").agg(F.sum("coef").alias("coef"), F.max("value").alias("value"), F.bool_and("solve").alias("solve"))
    packed = sums.groupBy("_eq").agg(
        F.collect_list(F.when(F.col("solve"), F.struct("param", "coef"))).alias("design"), F.sum(F.col("coef") * F.col("value")).alias("_known")
    )
    whole = flat.drop("design").join(packed, "_eq").withColumn("misclosure", F.col("misclosure") - F.col("_known"))
    return equations.filter(~F.coalesce(named, F.lit(False))).unionByName(whole.select(*equations.columns))


def parameter_values(solution: DataFrame, names: DataFrame | None) -> DataFrame:
    """``(param, name, solve, value)`` of the named unknowns after the adjustment: what they were given and the solved change."""
    x = solution.filter(_kind("param").isin(*KINDS) & (F.size(F.split("param", r"\|")) >= 2))
    if names is None:
        return x.select("param", F.col("param").alias("name"), F.lit(True).alias("solve"), F.col("x").alias("value"))
    change = x.select(F.col("param").alias("name"), "x")
    return names.join(change, "name", "left").select("param", "name", "solve", (F.col("value") + F.coalesce("x", F.lit(0.0))).alias("value"))
