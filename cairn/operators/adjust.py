"""The iterated adjustment: sum, solve, move the stations, stop when they no longer move."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.ellipsoid import GRS80, Ellipsoid, meridian_radius, prime_vertical
from cairn.operators import normal, observe, solve, unknowns
from cairn.operators.unknowns import Model
from cairn.plans.lineage import cut, store
from cairn.plans.skew import spread

STATION_COLUMNS = ("lon", "lat", "ohgt", "und", "free")


@dataclass(frozen=True)
class Options:
    mode: str = "adjust"  # adjust, preanalysis, datacheck, freenet
    dimension: str = "enu"  # enu, en for plan only, u for heights only
    max_iterations: int = 10
    tolerance: float = 1.0e-4
    max_adjustment: float = 1.0e4
    dense_limit: int = solve.DENSE_LIMIT
    ellipsoid: Ellipsoid = field(default_factory=lambda: GRS80)
    projection: object = None  # the projection in which PB rows are bearings
    translated_sets: bool = False  # point sets have three translations each; rows name theirs in set_id
    frame_rates: bool = False  # frames (the observations' column frame) have rates over the column frame_years


@dataclass
class Adjustment:
    stations: DataFrame
    equations: DataFrame
    solution: DataFrame
    matrix: DataFrame
    params: DataFrame
    stats: dict
    iterations: list[dict]
    set_values: DataFrame | None = None
    parameters: DataFrame | None = None  # named unknowns: (param, name, solve, value)

    @property
    def converged(self) -> bool:
        """Whether the last iteration moved no station by the tolerance or more."""
        return bool(self.iterations) and self.iterations[-1]["converged"]


def free_axes(mode_h: Column, mode_v: Column, options: Options) -> Column:
    """Axes a station may move in: floating stations move too, tied by an equation of their own."""
    if options.mode == "datacheck":
        return F.lit("")
    if options.mode == "freenet":
        return F.lit(options.dimension)
    plan = F.when(mode_h.isin("free", "float"), "".join(a for a in "en" if a in options.dimension)).otherwise("")
    up = F.when(mode_v.isin("free", "float"), "u" if "u" in options.dimension else "").otherwise("")
    return F.concat(plan, up)


def float_equations(stations: DataFrame, initial: DataFrame | None = None, ell: Ellipsoid = GRS80) -> DataFrame:
    """A floating station's initial position as observations with its float errors.

    ``float_h``/``float_v`` are the errors; ``initial(code, lon, lat, ohgt)`` the positions the stations are
    tied to, by default where they are now.
    """
    df = stations
    if initial is not None:
        df = df.join(
            initial.select("code", F.col("lon").alias("_lon0"), F.col("lat").alias("_lat0"), F.col("ohgt").alias("_h0")),
            "code",
        )
    else:
        df = df.withColumns({"_lon0": F.col("lon"), "_lat0": F.col("lat"), "_h0": F.col("ohgt")})
    h = F.col("ohgt") + F.col("und")
    away = {
        "e": (F.col("_lon0") - F.col("lon")) * (prime_vertical(F.col("lat"), ell) + h) * F.cos("lat"),
        "n": (F.col("_lat0") - F.col("lat")) * (meridian_radius(F.col("lat"), ell) + h),
        "u": F.col("_h0") - F.col("ohgt"),
    }
    error = {"e": F.col("float_h"), "n": F.col("float_h"), "u": F.col("float_v")}
    rows = F.array(
        *[
            F.struct(
                F.concat(F.lit("float|"), F.col("code"), F.lit(f"|{a}")).alias("obs_key"),
                away[a].alias("misclosure"),
                F.try_divide(F.lit(1.0), error[a] * error[a]).alias("weight"),
                F.array(
                    F.struct(F.concat(F.col("code"), F.lit(f"|{a}")).alias("param"), F.lit(1.0).alias("coef"))
                ).alias("design"),
                (F.col("free").contains(a) & error[a].isNotNull()).alias("_on"),
            )
            for a in "enu"
        ]
    )
    return df.select(F.inline(rows)).filter("_on").drop("_on")


def colocation_equations(pairs: DataFrame, stations: DataFrame, ell: Ellipsoid = GRS80) -> DataFrame:
    """Paired stations held together: the difference of their positions is observed as zero with the pair's errors."""
    a = stations.select(F.col("code").alias("a"), *[F.col(c).alias(f"a_{c}") for c in STATION_COLUMNS])
    b = stations.select(F.col("code").alias("b"), *[F.col(c).alias(f"b_{c}") for c in STATION_COLUMNS])
    df = pairs.join(a, "a").join(b, "b")
    h = F.col("a_ohgt") + F.col("a_und")
    gap = {
        "e": (F.col("a_lon") - F.col("b_lon")) * (prime_vertical(F.col("a_lat"), ell) + h) * F.cos("a_lat"),
        "n": (F.col("a_lat") - F.col("b_lat")) * (meridian_radius(F.col("a_lat"), ell) + h),
        "u": F.col("a_ohgt") - F.col("b_ohgt"),
    }
    error = {"e": F.col("h_error"), "n": F.col("h_error"), "u": F.col("v_error")}

    def term(code: str, a_: str, sign: float) -> Column:
        return F.when(
            F.col(f"{code}_free").contains(a_),
            F.struct(F.concat(F.col(code), F.lit(f"|{a_}")).alias("param"), F.lit(sign).alias("coef")),
        )

    rows = F.array(
        *[
            F.struct(
                F.concat(F.lit("coloc|"), F.col("a"), F.lit("|"), F.col("b"), F.lit(f"|{a_}")).alias("obs_key"),
                gap[a_].alias("misclosure"),
                F.try_divide(F.lit(1.0), error[a_] * error[a_]).alias("weight"),
                F.array_compact(F.array(term("b", a_, 1.0), term("a", a_, -1.0))).alias("design"),
                (error[a_] > 0).alias("_on"),
            )
            for a_ in "enu"
        ]
    )
    return df.select(F.inline(rows)).filter("_on").drop("_on")


def apply_shifts(stations: DataFrame, solution: DataFrame, ell: Ellipsoid = GRS80) -> DataFrame:
    """Move stations by the solved east, north and up shifts; adds ``de``, ``dn``, ``du`` of this step."""
    parts = F.split("param", r"\|")
    station_part = solution.filter(F.size(parts) == 2).select(
        parts[0].alias("code"), parts[1].alias("axis"), "x"
    )
    wide = station_part.groupBy("code").agg(
        *[F.sum(F.when(F.col("axis") == a, F.col("x"))).alias(f"d{a}") for a in "enu"]
    )
    keep = [c for c in stations.columns if c not in ("de", "dn", "du")]
    out = stations.select(*keep).join(wide, "code", "left").withColumns(
        {f"d{a}": F.coalesce(F.col(f"d{a}"), F.lit(0.0)) for a in "enu"}
    )
    h = F.col("ohgt") + F.col("und")
    return out.withColumns(
        {
            "lon": F.col("lon") + F.col("de") / ((prime_vertical(F.col("lat"), ell) + h) * F.cos("lat")),
            "lat": F.col("lat") + F.col("dn") / (meridian_radius(F.col("lat"), ell) + h),
            "ohgt": F.col("ohgt") + F.col("du"),
        }
    )


def equations_for(
    observations: DataFrame, stations: DataFrame, options: Options, initial: DataFrame | None = None, model: Model | None = None
) -> DataFrame:
    """All equations at the present positions: ``(obs_key, set_id, misclosure, weight, set_coef, used, design)``.

    Observations may name unknowns in ``distsf``, ``refcoef``, ``brngref`` and ``systematic`` (:mod:`cairn.operators.unknowns`).
    """
    ell, model = options.ellipsoid, model or Model()
    resolved = observe.resolve_ends(observations, stations, STATION_COLUMNS)
    if model.displacements is not None:
        resolved = unknowns.displaced(resolved, model.displacements, ell)
    columns = ["obs_key", "set_id", "component", "misclosure", "weight", "set_coef", "used", "design"]
    none = F.lit(None).cast("double")
    used = ~F.coalesce(F.col("rejected"), F.lit(False)) if "rejected" in observations.columns else F.lit(True)
    resolved = resolved.withColumn("used", used).withColumn("component", F.lit(0))
    lines, _ = observe.reject_collocated(
        observe.calculate(resolved.filter(~F.col("obs_type").isin(*observe.POINTS, "GB")), ell, options.projection)
    )
    set_coef = F.when(F.col("obs_type") == "HA", 1.0).when(F.col("obs_type") == "DR", F.col("_chord") * 1.0e-6)
    rows = observe.design_rows(lines, ell, options.dimension, unknowns.line_terms(observations.columns))
    parts = [unknowns.with_systematic(rows).withColumn("set_coef", set_coef).select(*columns)]
    if "vec" in observations.columns:
        vectors = resolved.filter(F.col("obs_type").isin(*observe.VECTORS)).drop("component")
        of_set = {
            "ell": ell,
            "frame": F.col("frame") if "frame" in observations.columns else None,
            "years": F.col("frame_years") if options.frame_rates else None,
            "translated": F.col("set_id").isNotNull() if options.translated_sets else None,
        }
        if model.blocks is not None:
            together = F.col("i").isNotNull() & F.col("set_id").isNotNull()
            rows = unknowns.correlated_rows(vectors.filter(together), model.blocks, **of_set)
            parts.append(rows.withColumn("set_coef", none).select(*columns))
            vectors = vectors.filter(~together)
        rows = observe.vector_rows(vectors, **of_set)
        parts.append(rows.withColumn("set_coef", none).select(*columns, *(["set_design"] if options.translated_sets else [])))
    points = resolved.filter(F.col("obs_type").isin("OH", "EH", "LT", "LN"))
    parts.append(unknowns.with_systematic(observe.point_rows(points, ell)).withColumn("set_coef", none).select(*columns))
    held = []
    if "float_h" in stations.columns:
        held.append(float_equations(stations, initial, ell))
    if model.colocated is not None:
        # Between two marks that are both fixed there is nothing to hold together.
        held.append(colocation_equations(model.colocated, stations, ell).filter(F.size("design") > 0))
    for tied in held:
        alone = {"set_id": F.lit(None).cast("string"), "component": F.lit(0), "set_coef": none, "used": F.lit(True)}
        parts.append(tied.withColumns(alone).select(*columns))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def summed_cells(equations: DataFrame, preanalysis: bool = False) -> tuple[DataFrame, int, int]:
    """Bordered normal cells of the used equations with the number of observations and of implicit unknowns.

    A used equation without misclosure or weight would count without adding anything, so it is refused.
    """
    used = equations.filter("used")
    if preanalysis:
        used = used.withColumn("misclosure", F.lit(0.0))
    counts = used.agg(
        F.count("*").alias("n"),
        # A row with a set unknown but no set is a set by itself.
        (F.count_distinct(F.when(F.col("set_coef").isNotNull(), F.col("set_id"))) + F.count_if(F.col("set_coef").isNotNull() & F.col("set_id").isNull())).alias("sets"),
        F.min(F.when(F.col("misclosure").isNull() | F.col("weight").isNull(), F.col("obs_key").cast("string"))).alias("lacking"),
    ).first()
    if counts["lacking"] is not None:
        raise ValueError(f"used equations lack a misclosure or a weight, the first of them {counts['lacking']}")
    plain, blocks = used.filter(F.col("set_coef").isNull()), 0
    if "set_design" in used.columns:
        own = plain.filter(F.size("set_design") > 0)
        blocks = own.select("set_id", F.explode("set_design.param")).distinct().count()
        plain = plain.filter(F.coalesce(F.size("set_design") <= 0, F.lit(True))).select("misclosure", "weight", "design")
        if blocks:
            plain = plain.unionByName(normal.eliminate_set_blocks(own).select("misclosure", "weight", "design"))
    plain = plain.select("misclosure", "weight", "design")
    if counts["sets"]:
        reduced = normal.eliminate_set_unknowns(used.filter(F.col("set_coef").isNotNull()))
        plain = plain.unionByName(reduced.select("misclosure", "weight", "design"))
    return cut(normal.normal_cells(plain)), counts["n"], counts["sets"] + blocks


def statistics(nobs: int, nprm: int, implicit: int, vwv: float, b_dot_x: float) -> dict:
    """Degrees of freedom, residual sum and standard error of unit weight; one when nothing is left over."""
    dof = nobs - nprm - implicit
    ssr = max(vwv - b_dot_x, 0.0)
    seu = (ssr / dof) ** 0.5 if dof > 0 and ssr > 0 else (1.0 if dof <= 0 else 0.0)
    return {"nobs": nobs, "nprm": nprm, "nset": implicit, "dof": dof, "ssr": ssr, "seu": seu}


def adjust(
    observations: DataFrame, stations: DataFrame, options: Options | None = None, model: Model | None = None
) -> Adjustment:
    """Least-squares positions from observations.

    ``stations`` has ``code, lon, lat`` (radians), ``ohgt, und, mode_h, mode_v`` and may have
    ``float_h, float_v``; ``observations`` as in :mod:`cairn.operators.observe`. ``model`` adds values and ties of named
    unknowns, paired marks, displacements and covariances within sets.
    """
    options, model = options or Options(), model or Model()
    now = cut(stations.withColumn("free", free_axes(F.col("mode_h"), F.col("mode_v"), options)))
    initial = now.select("code", "lon", "lat", "ohgt")
    # Equations are long formulas with many products to a row, so the observations' own few splits are not kept.
    observations = cut(spread(observations))
    history: list[dict] = []
    solution = matrix = equations = comps = names = None
    stats: dict = {}
    kept: dict = {}
    for number in range(1, options.max_iterations + 1):
        equations = cut(equations_for(observations, now, options, initial, model))
        # The observations name the same unknowns in every iteration.
        names = names if names is not None else unknowns.resolved_names(equations, model)
        equations = cut(unknowns.with_names(equations, names)) if names is not None else equations
        cells, nobs, nset = summed_cells(equations, options.mode == "preanalysis")
        matrix, rhs, vwv = normal.split_cells(cells)
        explicit_sets = matrix.filter((F.col("row") == F.col("col")) & F.col("row").startswith("set|")).count()
        # The observations link the same stations in every iteration.
        comps = comps if comps is not None else store(solve.components_of(matrix))
        solution = store(solve.solve(matrix, rhs, options.dense_limit, comps=comps, stored=True, kept=kept))
        totals = solution.join(rhs, "param").agg(
            F.sum(F.col("x") * F.col("b")).alias("bx"), F.count("*").alias("n")
        ).first()
        total_vwv = vwv.first()
        stats = statistics(
            nobs, totals["n"] - explicit_sets, nset, total_vwv["vwv"] if total_vwv else 0.0, totals["bx"] or 0.0
        )
        if options.mode in ("preanalysis", "datacheck"):
            history.append({"iteration": number, "max_shift": 0.0, "converged": True})
            break
        now = cut(apply_shifts(now, solution, options.ellipsoid))
        worst = now.select(F.max(F.greatest(F.abs("de"), F.abs("dn"), F.abs("du"))).alias("m")).first()["m"] or 0.0
        history.append({"iteration": number, "max_shift": worst, "converged": worst < options.tolerance})
        if worst > options.max_adjustment:
            raise ValueError(f"a station moved by {worst:.1f} m in iteration {number}")
        if worst < options.tolerance:
            break
    params = solution.select("param", "x", "singular")
    values = None
    if "set_design" in equations.columns:
        values = normal.set_block_values(equations.filter("used"), solution)
    named = unknowns.parameter_values(solution, names)
    return Adjustment(now, equations, solution, matrix, params, stats, history, values, named)


def max_adjustment(stations: DataFrame, tolerance: float) -> DataFrame:
    """Largest shift of the last step, whose it is, and how many stations moved more than ``tolerance``."""
    size = F.greatest(F.abs("de"), F.abs("dn"), F.abs("du"))
    return stations.select("code", size.alias("s")).agg(
        F.max("s").alias("max_shift"),
        F.max_by("code", F.struct("s", "code")).alias("code"),
        F.count_if(F.col("s") > tolerance).alias("above"),
    )


def update_parameters(params: DataFrame, solution: DataFrame, inverse: DataFrame | None = None) -> DataFrame:
    """Named parameters with their solved changes added and, given inverse cells, their variances."""
    x = solution.select(F.col("param").alias("name"), F.col("x").alias("_x"))
    out = params.join(x, "name", "left").withColumn("value", F.col("value") + F.coalesce("_x", F.lit(0.0)))
    if inverse is None:
        return out.drop("_x")
    own = inverse.filter("row = col").select(F.col("row").alias("name"), F.col("value").alias("variance"))
    return out.drop("_x").join(own, "name", "left")
