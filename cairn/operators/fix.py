"""Approximate positions from observations, a frontier at a time.

Every round joins stations without a position to neighbours that have one,
works out all candidate fixes in parallel, keeps the best method per station and
goes on from there. A method that can use many observations is written as sums
of normal equations, so a station with any number of neighbours is still one
combinable aggregate and never a list of pairs. The order differs from fixing
one station at a time, and so may the approximate positions.

Positions are plane: ``x`` east, ``y`` north, ``h`` height. Azimuths are radians
clockwise from north.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.operators.graph import connected_components
from cairn.plans.lineage import cut

EARTH = 6_371_000.0
# Quality of a plan fix: the lower is used first.
WEIGHTS = {"vector": 1, "point": 2, "polar": 3, "bearings": 4, "distance_angle": 5, "resection": 6, "distances": 7}
SINE_LIMIT = 0.05


def line_summary(observations: DataFrame, tolerance: float = 1.0, angle_tolerance: float = 0.01) -> DataFrame:
    """One row per station pair ``a < b`` with the mean vector, distance, azimuth and height difference from ``a`` to ``b``.

    ``observations(from_code, to_code, kind, value, dx, dy, dh)`` with kinds ``vector``, ``distance``, ``azimuth`` and
    ``height``. Observations taken the other way are turned round first. ``disagrees`` marks pairs whose repeats differ
    by more than the tolerance.
    """
    forward = F.col("from_code") < F.col("to_code")
    sign = F.when(forward, 1.0).otherwise(-1.0)
    az = F.when(forward, F.col("value")).otherwise(F.col("value") + math.pi)
    kind = F.col("kind")
    of = lambda k, c: F.when(kind == k, c)
    per = observations.filter("from_code <> to_code").groupBy(
        F.least("from_code", "to_code").alias("a"), F.greatest("from_code", "to_code").alias("b")
    ).agg(
        *[F.avg(of("vector", F.col(c) * sign)).alias(c) for c in ("dx", "dy", "dh")],
        F.avg(of("distance", F.col("value"))).alias("distance"),
        F.avg(of("azimuth", F.sin(az))).alias("_s"),
        F.avg(of("azimuth", F.cos(az))).alias("_c"),
        F.avg(of("height", F.col("value") * sign)).alias("height"),
        (F.max(of("distance", F.col("value"))) - F.min(of("distance", F.col("value")))).alias("_dd"),
        (F.max(of("height", F.col("value") * sign)) - F.min(of("height", F.col("value") * sign))).alias("_dh"),
        F.count("*").alias("n"),
    )
    azimuth = F.atan2("_s", "_c")
    azimuth = F.when(azimuth < 0, azimuth + 2 * math.pi).otherwise(azimuth)
    # The mean direction shortens as repeats disagree: r = cos of their spread.
    spread = F.acos(F.least(F.lit(1.0), F.hypot("_s", "_c")))
    bad = (F.coalesce("_dd", F.lit(0.0)) > tolerance) | (F.coalesce("_dh", F.lit(0.0)) > tolerance) | (
        F.coalesce(spread, F.lit(0.0)) > angle_tolerance
    )
    return per.withColumns({"azimuth": azimuth, "disagrees": bad}).drop("_s", "_c", "_dd", "_dh")


def both_ways(lines: DataFrame) -> DataFrame:
    """Lines seen from either end as ``(code, other, dx, dy, dh, distance, azimuth, height)``."""
    there = lines.select(
        F.col("a").alias("code"), F.col("b").alias("other"), "dx", "dy", "dh", "distance", "azimuth", "height"
    )
    back_az = F.pmod(F.col("azimuth") + math.pi, F.lit(2 * math.pi))
    back = lines.select(
        F.col("b").alias("code"), F.col("a").alias("other"), (-F.col("dx")).alias("dx"), (-F.col("dy")).alias("dy"), (-F.col("dh")).alias("dh"),
        "distance", back_az.alias("azimuth"), (-F.col("height")).alias("height"),
    )
    return there.unionByName(back)


def zenith_to_height(zenith: Column, distance: Column, from_hgt: Column, to_hgt: Column, refraction: float = 0.0) -> Column:
    """Height difference of a zenith distance over a horizontal distance, with curvature and refraction."""
    curvature = distance * distance * ((1.0 - refraction) / (2.0 * EARTH))
    return distance * F.cos(zenith) / F.sin(zenith) + curvature + from_hgt - to_hgt


def orient_rounds(rounds: DataFrame, known: DataFrame) -> DataFrame:
    """Orientation of every round that hangs together with a known azimuth: ``(round_id, orientation, step)``.

    ``rounds(round_id, code, other, reading)``; ``known(code, other, azimuth)`` are lines of known azimuth, either
    way round. Rounds on a line of known azimuth are oriented by their mean; then their own lines become known for
    the rounds that share them, until nothing is added.
    """
    lines = known.select("code", "other", "azimuth").unionAll(
        known.select("other", "code", F.col("azimuth") + math.pi)
    )
    lines = cut(_mean_azimuth(lines.select(F.col("code"), F.col("other"), F.col("azimuth"))))
    rounds = cut(rounds.select("round_id", "code", "other", "reading"))
    done = None
    for step in itertools.count():
        left = rounds if done is None else rounds.join(done.select("round_id"), "round_id", "left_anti")
        hits = left.join(lines, ["code", "other"]).withColumn("_o", F.col("azimuth") - F.col("reading"))
        fresh = hits.groupBy("round_id").agg(F.atan2(F.avg(F.sin("_o")), F.avg(F.cos("_o"))).alias("orientation"))
        fresh = cut(fresh.withColumn("step", F.lit(step)))
        if not fresh.limit(1).count():
            break
        done = fresh if done is None else cut(done.unionByName(fresh))
        seen = rounds.join(fresh, "round_id").select("code", "other", (F.col("orientation") + F.col("reading")).alias("azimuth"))
        both = seen.unionAll(seen.select("other", "code", F.col("azimuth") + math.pi))
        new = _mean_azimuth(both).join(lines.select("code", "other"), ["code", "other"], "left_anti")
        lines = cut(lines.unionByName(new))
    if done is None:
        return rounds.limit(0).select("round_id", F.lit(0.0).alias("orientation"), F.lit(0).alias("step"))
    return done


def _mean_azimuth(df: DataFrame) -> DataFrame:
    return df.groupBy("code", "other").agg(F.atan2(F.avg(F.sin("azimuth")), F.avg(F.cos("azimuth"))).alias("azimuth"))


def _frontier(edges: DataFrame, fixed: DataFrame, need: str = "x") -> DataFrame:
    """Edges from stations without a position to neighbours with one."""
    known = fixed.filter(F.col(need).isNotNull())
    waiting = edges.join(known.select("code"), "code", "left_anti")
    return waiting.join(known.select(F.col("code").alias("other"), *[F.col(c).alias(f"o_{c}") for c in ("x", "y", "h")]), "other")


def fix_by_vectors(frontier: DataFrame) -> DataFrame:
    """Mean over vectors from fixed marks; the vector here points from the waiting station to the fixed one."""
    return frontier.filter("dx IS NOT NULL").groupBy("code").agg(
        F.avg(F.col("o_x") - F.col("dx")).alias("x"), F.avg(F.col("o_y") - F.col("dy")).alias("y"), F.count("*").alias("n")
    ).withColumn("method", F.lit("vector"))


def fix_by_points(points: DataFrame, fixed: DataFrame) -> DataFrame:
    """Mean of a station's own point observations ``(code, x, y)``."""
    waiting = points.join(fixed.filter("x IS NOT NULL").select("code"), "code", "left_anti")
    return waiting.groupBy("code").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n")).withColumn(
        "method", F.lit("point")
    )


def fix_by_polar(frontier: DataFrame) -> DataFrame:
    """Azimuth and distance from fixed marks, averaged; the azimuth here looks from the waiting station to the fixed one."""
    hit = frontier.filter("azimuth IS NOT NULL AND distance IS NOT NULL")
    return hit.groupBy("code").agg(
        F.avg(F.col("o_x") - F.col("distance") * F.sin("azimuth")).alias("x"),
        F.avg(F.col("o_y") - F.col("distance") * F.cos("azimuth")).alias("y"),
        F.count("*").alias("n"),
    ).withColumn("method", F.lit("polar"))


def fix_by_bearings(frontier: DataFrame) -> DataFrame:
    """Where the lines of sight to fixed marks meet: exact for two, least squares for more."""
    s, c = F.sin("azimuth"), F.cos("azimuth")
    t = F.col("o_x") * c - F.col("o_y") * s
    sums = frontier.filter("azimuth IS NOT NULL").groupBy("code").agg(
        F.sum(c * c).alias("cc"), F.sum(-s * c).alias("sc"), F.sum(s * s).alias("ss"), F.sum(c * t).alias("ct"), F.sum(-s * t).alias("st"),
        F.count("*").alias("n"),
    )
    det = F.col("cc") * F.col("ss") - F.col("sc") * F.col("sc")
    good = sums.filter((F.col("n") >= 2) & (det > SINE_LIMIT * SINE_LIMIT))
    return good.select(
        "code",
        ((F.col("ct") * F.col("ss") - F.col("st") * F.col("sc")) / det).alias("x"),
        ((F.col("cc") * F.col("st") - F.col("sc") * F.col("ct")) / det).alias("y"),
        "n",
        F.lit("bearings").alias("method"),
    )


def fix_by_distances(frontier: DataFrame) -> DataFrame:
    """Distances to three or more fixed marks; two alone leave the side open and fix nothing.

    Taking the mean circle equation off each one leaves a linear system, whose sums are taken about the mean mark.
    """
    hit = frontier.filter("distance IS NOT NULL")
    mean = hit.groupBy("code").agg(
        F.avg("o_x").alias("mx"), F.avg("o_y").alias("my"), F.count("*").alias("n"),
        F.avg(F.col("o_x") ** 2 + F.col("o_y") ** 2 - F.col("distance") ** 2).alias("mk"),
    ).filter("n >= 3")
    rows = hit.join(mean, "code").select(
        "code", "n", "mx", "my", (F.col("o_x") - F.col("mx")).alias("u"), (F.col("o_y") - F.col("my")).alias("v"),
        ((F.col("o_x") ** 2 + F.col("o_y") ** 2 - F.col("distance") ** 2 - F.col("mk")) / 2.0).alias("k"),
    )
    sums = rows.groupBy("code", "n", "mx", "my").agg(
        *[F.sum(F.col(p) * F.col(q)).alias(p + q) for p, q in (("u", "u"), ("u", "v"), ("v", "v"), ("u", "k"), ("v", "k"))]
    )
    det = F.col("uu") * F.col("vv") - F.col("uv") ** 2
    good = sums.filter(det > SINE_LIMIT**2 * F.col("uu") * F.col("vv") + 1.0e-12)
    return good.select(
        "code", ((F.col("uk") * F.col("vv") - F.col("vk") * F.col("uv")) / det).alias("x"),
        ((F.col("uu") * F.col("vk") - F.col("uv") * F.col("uk")) / det).alias("y"), "n", F.lit("distances").alias("method"),
    )


def _resection_point(m: pd.Series) -> pd.DataFrame:
    """Null direction of a station's 4x4 sums gives cosine and sine of the orientation and the position."""
    a = np.array([np.asarray(v, dtype=float) for v in m])
    full = np.zeros((len(a), 4, 4))
    k = 0
    for i in range(4):
        for j in range(i + 1):
            full[:, i, j] = full[:, j, i] = a[:, k]
            k += 1
    scale = 1.0 / np.sqrt(np.maximum(np.einsum("nii->ni", full), 1e-300))
    values, vectors = np.linalg.eigh(full * scale[:, :, None] * scale[:, None, :])
    v = vectors[:, :, 0] * scale
    size = np.hypot(v[:, 0], v[:, 1])
    c, s, u, w = (v[:, i] / np.maximum(size, 1e-300) for i in range(4))
    return pd.DataFrame({"x": u * c + w * s, "y": w * c - u * s, "quality": values[:, 1]})


def fix_by_resection(directions: DataFrame) -> DataFrame:
    """Directions of one round from the waiting station to three or more fixed marks.

    ``directions(code, round_id, reading, o_x, o_y)``. The condition that each mark lies on its line of sight is linear in
    the cosine and sine of the orientation and the turned position, so a round is four sums by four.
    """
    mean = directions.groupBy("code", "round_id").agg(F.avg("o_x").alias("mx"), F.avg("o_y").alias("my"), F.count("*").alias("n")).filter("n >= 3")
    x, y = F.col("o_x") - F.col("mx"), F.col("o_y") - F.col("my")
    s, c = F.sin("reading"), F.cos("reading")
    row = [x * c - y * s, -(x * s + y * c), -c, s]
    rows = directions.join(mean, ["code", "round_id"]).select("code", "round_id", "mx", "my", "n", *[r.alias(f"r{i}") for i, r in enumerate(row)])
    sums = rows.groupBy("code", "round_id", "mx", "my", "n").agg(
        F.array(*[F.sum(F.col(f"r{i}") * F.col(f"r{j}")) for i in range(4) for j in range(i + 1)]).alias("m")
    )
    point = F.pandas_udf(_resection_point, "x double, y double, quality double")
    solved = sums.withColumn("p", point("m")).filter(F.col("p.quality") > 1.0e-9)
    best = solved.groupBy("code").agg(
        F.max_by(F.struct((F.col("p.x") + F.col("mx")).alias("x"), (F.col("p.y") + F.col("my")).alias("y"), "n"), F.struct("n", "round_id")).alias("_b")
    )
    return best.select("code", "_b.x", "_b.y", "_b.n", F.lit("resection").alias("method"))


def fix_by_distance_angle(frontier: DataFrame, directions: DataFrame) -> DataFrame:
    """Distance to one fixed mark and the angle from it to another in one round.

    The angle at the second mark follows from the sine rule; it is unique while the measured side is not the
    longer one, so longer ones are left to other methods. The lowest marks in code order are used.
    """
    near = frontier.filter("distance IS NOT NULL").groupBy("code").agg(
        F.min_by(F.struct("other", "distance", "o_x", "o_y"), F.col("other")).alias("_a")
    )
    d = directions.join(near, "code")
    from_a = d.filter(F.col("other") == F.col("_a.other")).select("code", "round_id", F.col("reading").alias("_ra"))
    to_b = d.filter(F.col("other") != F.col("_a.other")).join(from_a, ["code", "round_id"])
    pair = to_b.groupBy("code").agg(
        F.min_by(F.struct("_a", "_ra", "reading", "o_x", "o_y"), F.struct("other", "round_id")).alias("_p"), F.count("*").alias("n")
    )
    ax, ay, side = F.col("_p._a.o_x"), F.col("_p._a.o_y"), F.col("_p._a.distance")
    bx, by = F.col("_p.o_x"), F.col("_p.o_y")
    base = F.hypot(bx - ax, by - ay)
    turn = F.col("_p.reading") - F.col("_p._ra")
    turn = turn - 2.0 * math.pi * F.round(turn / (2.0 * math.pi))
    angle_b = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), side * F.sin(turn) / base)))
    # Azimuth from the first mark to the station: turn from the line between the marks by the angle there.
    azimuth = F.atan2(bx - ax, by - ay) + F.signum(turn) * math.pi - turn - angle_b
    out = pair.filter((base > 0) & (side <= base) & (F.abs(F.sin(turn)) > SINE_LIMIT))
    return out.select(
        "code", (ax + side * F.sin(azimuth)).alias("x"), (ay + side * F.cos(azimuth)).alias("y"), "n", F.lit("distance_angle").alias("method")
    )


def fix_heights(edges: DataFrame, fixed: DataFrame) -> DataFrame:
    """Mean of fixed heights and height differences (or the height part of vectors) to them."""
    known = fixed.filter("h IS NOT NULL")
    waiting = edges.join(known.select("code"), "code", "left_anti")
    hit = waiting.join(known.select(F.col("code").alias("other"), F.col("h").alias("o_h")), "other")
    step = F.coalesce("height", "dh")
    return hit.filter(step.isNotNull()).groupBy("code").agg(F.avg(F.col("o_h") - step).alias("h"), F.count("*").alias("n"))


def rank_candidates(candidates: DataFrame) -> DataFrame:
    """The best fix per station: lowest method weight, then the most observations."""
    pairs = [F.lit(v) for kv in WEIGHTS.items() for v in kv]
    weight = F.element_at(F.create_map(*pairs), F.col("method"))
    best = candidates.withColumn("_w", weight).groupBy("code").agg(
        F.min_by(F.struct("x", "y", "method", "n"), F.struct(F.col("_w"), -F.col("n"), F.col("method"))).alias("_b")
    )
    return best.select("code", "_b.x", "_b.y", "_b.method", "_b.n")


def traverses(lines: DataFrame, fixed: DataFrame) -> DataFrame:
    """Positions along chains of azimuth-and-distance legs between two fixed marks, with the misclose spread by length.

    A chain is a run of waiting stations with two such neighbours each. Both ends must be fixed and different.
    ``(code, x, y, chain, misclose)``; chains of any length are walked to their end.
    """
    legs = both_ways(lines).filter("azimuth IS NOT NULL AND distance IS NOT NULL").select("code", "other", "azimuth", "distance")
    known = fixed.filter("x IS NOT NULL").select("code", "x", "y")
    waiting = legs.select("code").distinct().join(known.select("code"), "code", "left_anti")
    degree = legs.join(waiting, "code", "left_semi").groupBy("code").agg(F.count("*").alias("deg"))
    inner = degree.filter("deg = 2").select("code")
    legs = cut(legs)
    between = legs.join(inner, "code", "left_semi").join(inner.select(F.col("code").alias("other")), "other", "left_semi")
    chains = cut(connected_components(between.select(F.col("code").alias("a"), F.col("other").alias("b")), inner))
    chain = chains.select(F.col("node").alias("code"), F.col("component").alias("chain"))
    # A chain starts at the fixed mark that is lower in code order, on the inner station next to it.
    ends = legs.join(known.select(F.col("code").alias("other"), F.col("x").alias("fx"), F.col("y").alias("fy")), "other").join(chain, "code")
    sides = ends.groupBy("chain").agg(
        F.count("*").alias("n_ends"), F.min(F.struct(F.col("other"), F.col("code"), "azimuth", "distance", "fx", "fy")).alias("first"),
        F.max(F.struct(F.col("other"), F.col("code"), "azimuth", "distance", "fx", "fy")).alias("last"),
    ).filter((F.col("n_ends") == 2) & (F.col("first.other") != F.col("last.other")))
    at = sides.select(
        "chain", F.col("first.code").alias("code"), F.col("first.other").alias("prev"), F.lit(1).alias("place"),
        # The leg is seen from the waiting station, so its azimuth is turned round.
        (-F.col("first.distance") * F.sin("first.azimuth")).alias("dx"), (-F.col("first.distance") * F.cos("first.azimuth")).alias("dy"),
        F.col("first.distance").alias("length"),
    )
    walked = at = cut(at)
    # A chain has no more legs than there are inner stations.
    for _ in range(inner.count()):
        onward = at.join(legs, "code").filter(F.col("other") != F.col("prev")).join(
            chain.select(F.col("code").alias("other"), F.col("chain").alias("_c")), "other"
        ).filter(F.col("chain") == F.col("_c"))
        at = cut(
            onward.select(
                "chain", F.col("other").alias("_next"), F.col("code").alias("prev"), (F.col("place") + 1).alias("place"),
                (F.col("dx") + F.col("distance") * F.sin("azimuth")).alias("dx"), (F.col("dy") + F.col("distance") * F.cos("azimuth")).alias("dy"),
                (F.col("length") + F.col("distance")).alias("length"),
            ).withColumnRenamed("_next", "code")
        )
        if not at.limit(1).count():
            break
        walked = cut(walked.unionByName(at.select(*walked.columns)))
    tail = walked.join(
        sides.select("chain", F.col("last.code").alias("code"), F.col("last").alias("_l"), F.col("first.fx").alias("sx"), F.col("first.fy").alias("sy")), ["chain", "code"]
    )
    closed = tail.select(
        "chain", "sx", "sy",
        (F.col("_l.fx") - F.col("sx") - F.col("dx") - F.col("_l.distance") * F.sin("_l.azimuth")).alias("ex"),
        (F.col("_l.fy") - F.col("sy") - F.col("dy") - F.col("_l.distance") * F.cos("_l.azimuth")).alias("ey"),
        (F.col("length") + F.col("_l.distance")).alias("total"),
    )
    share = F.col("length") / F.col("total")
    return walked.join(closed, "chain").select(
        "code", (F.col("sx") + F.col("dx") + F.col("ex") * share).alias("x"), (F.col("sy") + F.col("dy") + F.col("ey") * share).alias("y"),
        "chain", F.hypot("ex", "ey").alias("misclose"),
    )


def fix_positions(
    lines: DataFrame, stations: DataFrame, rounds: DataFrame | None = None, points: DataFrame | None = None
) -> DataFrame:
    """Stations ``(code, x, y, h, method, step)`` after repeating the best fixes until none is added.

    ``lines`` as from :func:`line_summary`, ``stations(code, x, y, h)`` with nulls where unknown, ``rounds`` of directions,
    ``points(code, x, y)`` observed directly.
    """
    edges = cut(both_ways(lines))
    state = cut(
        stations.select(
            "code", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("h").cast("double").alias("h"),
            F.when(F.col("x").isNotNull(), "given").alias("method"), F.lit(0).alias("step"),
        )
    )
    for step in itertools.count(1):
        here = edges
        if rounds is not None:
            here = _with_round_azimuths(edges, rounds, state)
        frontier = cut(_frontier(here, state))
        found = fix_by_vectors(frontier).unionByName(fix_by_polar(frontier)).unionByName(fix_by_bearings(frontier)).unionByName(
            fix_by_distances(frontier)
        )
        if points is not None:
            found = found.unionByName(fix_by_points(points, state))
        if rounds is not None:
            known = state.filter("x IS NOT NULL").select(F.col("code").alias("other"), F.col("x").alias("o_x"), F.col("y").alias("o_y"))
            sights = rounds.join(state.filter("x IS NULL").select("code"), "code", "left_semi").join(known, "other")
            found = found.unionByName(fix_by_resection(sights)).unionByName(fix_by_distance_angle(frontier, sights))
        best = cut(rank_candidates(found).join(state.filter("x IS NULL").select("code"), "code", "left_semi"))
        heights = cut(fix_heights(edges, state).join(state.filter("h IS NULL").select("code"), "code", "left_semi"))
        if not best.limit(1).count() and not heights.limit(1).count():
            break
        state = cut(
            state.join(best.select("code", F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("method").alias("_m")), "code", "left")
            .join(heights.select("code", F.col("h").alias("_h")), "code", "left")
            .select(
                "code", F.coalesce("x", "_x").alias("x"), F.coalesce("y", "_y").alias("y"), F.coalesce("h", "_h").alias("h"),
                F.coalesce("method", "_m").alias("method"), F.when(F.col("_m").isNotNull(), F.lit(step)).otherwise(F.col("step")).alias("step"),
            )
        )
    return state


def _with_round_azimuths(edges: DataFrame, rounds: DataFrame, state: DataFrame) -> DataFrame:
    """Edges with azimuths from rounds oriented on lines whose azimuth is observed or follows from two positions."""
    known = state.filter("x IS NOT NULL")
    a = known.select("code", F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = known.select(F.col("code").alias("other"), F.col("x").alias("bx"), F.col("y").alias("by"))
    placed = rounds.select("code", "other").distinct().join(a, "code").join(b, "other").select(
        "code", "other", F.atan2(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")).alias("azimuth")
    )
    seen = edges.filter("azimuth IS NOT NULL").select("code", "other", "azimuth").join(placed.select("code", "other"), ["code", "other"], "left_anti")
    done = orient_rounds(rounds, placed.unionByName(seen))
    looked = rounds.join(done, "round_id").select("code", "other", (F.col("orientation") + F.col("reading")).alias("azimuth"))
    both = _mean_azimuth(looked.unionAll(looked.select("other", "code", F.col("azimuth") + math.pi))).withColumnRenamed("azimuth", "_az")
    joined = edges.join(both, ["code", "other"], "full_outer")
    return joined.withColumn("azimuth", F.coalesce("azimuth", "_az")).drop("_az")


def unfixed_stations(state: DataFrame) -> DataFrame:
    """Stations still without plan or height."""
    return state.filter("x IS NULL OR h IS NULL").select(
        "code", F.col("x").isNull().alias("no_plan"), F.col("h").isNull().alias("no_height")
    )
