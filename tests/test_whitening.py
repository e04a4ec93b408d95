import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.functions.ellipsoid import LOWER
from cairn.operators import covariance as CV

ROWS = "set_id string, i long, component int, misclosure double, design array<struct<param:string,coef:double>>"
BLOCKS = "set_id string, i long, j long, cov array<double>"


def planted(sizes, seed=3):
    """Sets of vectors with smooth correlated errors; a set may be named null, start anywhere and skip numbers."""
    rng = np.random.default_rng(seed)
    rows, blocks = [], []
    for s, (name, members) in enumerate(sizes):
        at = rng.normal(size=(len(members), 2))
        for p, i in enumerate(members):
            for comp in range(3):
                design = [(f"p{(p + d) % len(members)}:{comp}", float(rng.normal())) for d in range(2)]
                rows.append((name, i, comp, float(rng.normal()), design))
            for q in range(p + 1):
                near = float(np.exp(-((at[p] - at[q]) ** 2).sum()))
                cov = [(near + 0.5 * (p == q)) * (1.0 if a == c else 0.1) for a, c in LOWER]
                blocks.append((name, members[q], i, cov))
    return rows, blocks


def table(df):
    out = {}
    for r in df.collect():
        key = (r.set_id, r.i, r.component)
        assert key not in out and r.weight == 1.0
        out[key] = r.misclosure, {t.param: t.coef for t in r.design if abs(t.coef) > 1e-11}
    return out


def same(got, want):
    assert got.keys() == want.keys()
    for key, (mis, design) in want.items():
        assert got[key][0] == pytest.approx(mis, abs=1e-8)
        assert {p: pytest.approx(c, abs=1e-8) for p, c in design.items() if abs(c) > 1e-7} == {p: c for p, c in got[key][1].items() if p in design and abs(design[p]) > 1e-7}
        assert all(abs(c) < 1e-7 for p, c in got[key][1].items() if p not in design)


def test_tiles_equal_one_matrix(spark):
    rows, blocks = planted([("a", list(range(1, 24))), ("b", [7, 9, 30]), (None, list(range(-5, 6))), ("c", list(range(100, 130, 2)))])
    r, b = spark.createDataFrame(rows, ROWS), spark.createDataFrame(blocks, BLOCKS)
    whole = table(CV.whiten_sets(r, b))
    same(table(CV.whiten_sets(r, b, limit=5, tile=4)), whole)


def test_tiles_of_the_usual_size(spark):
    """Above the limit: the whitened misclosures have the weighted square sum of numpy's full matrix."""
    n = 150
    x, y = F.sin(F.col("id") * 12.9898), F.cos(F.col("id") * 78.233)
    at = spark.range(n).select("id", x.alias("x"), y.alias("y"))
    other = at.select(*[F.col(c).alias(c + "_") for c in at.columns])
    near = F.exp(-((F.col("x") - F.col("x_")) ** 2) - (F.col("y") - F.col("y_")) ** 2) + F.when(F.col("id") == F.col("id_"), 0.5).otherwise(0.0)
    cov = F.array(*[near * (1.0 if a == c else 0.1) for a, c in LOWER])
    b = at.join(other, F.col("id") <= F.col("id_")).select(F.lit("big").alias("set_id"), F.col("id").alias("i"), F.col("id_").alias("j"), cov.alias("cov"))
    term = F.array(F.struct(F.concat(F.lit("p"), F.col("id") % 50).alias("param"), F.lit(1.0).alias("coef")))
    eq = spark.range(n).withColumn("component", F.explode(F.array(*[F.lit(c) for c in range(3)])))
    r = eq.select(F.lit("big").alias("set_id"), F.col("id").alias("i"), "component", F.cos(F.col("id") + F.col("component") * 7).alias("misclosure"), term.alias("design"))
    sums = CV.whiten_sets(r, b, limit=50).agg(F.count("*").alias("n"), F.sum(F.col("misclosure") ** 2).alias("square")).first()
    i = np.arange(n)
    px, py = np.sin(i * 12.9898), np.cos(i * 78.233)
    kernel = np.exp(-((px[:, None] - px) ** 2) - (py[:, None] - py) ** 2) + 0.5 * np.eye(n)
    full = np.kron(kernel, 0.9 * np.eye(3) + 0.1)
    w = np.cos(i[:, None] + np.arange(3) * 7).ravel()
    assert sums.n == 3 * n
    assert sums.square == pytest.approx(w @ np.linalg.solve(full, w), rel=1e-9)


def test_members_without_covariance_are_refused(spark):
    rows, blocks = planted([("a", list(range(9)))])
    b = [x for x in blocks if 8 not in x[1:3]]
    with pytest.raises(ValueError, match="member 8 of set .*a"):
        CV.whiten_sets(spark.createDataFrame(rows, ROWS), spark.createDataFrame(b, BLOCKS), limit=4, tile=4)
    nothing = CV.whiten_sets(spark.createDataFrame([], ROWS), spark.createDataFrame([], BLOCKS), limit=4)
    assert nothing.collect() == []


def test_default_blocks_read_their_vectors_once(spark):
    from cairn.functions.ellipsoid import enu_axes, rotate_covariance

    seen = spark.sparkContext.accumulator(0)

    def mark(i):
        seen.add(1)
        return [float(i * 100), float(i * i), 7.0]

    vectors = spark.range(1, 5).select(
        F.lit("S").alias("set_id"), F.col("id").alias("i"), F.udf(mark, "array<double>")("id").alias("vec"), (0.1 * F.col("id")).alias("lon"), F.lit(-0.7).alias("lat")
    )
    blocks = CV.default_set_blocks(vectors, (3.0, 3.0, 5.0), (1.0, 1.0, 2.0))
    found = {(r.i, r.j): r.cov for r in blocks.collect()}
    assert seen.value == 4
    assert "zip_with" not in blocks._jdf.queryExecution().optimizedPlan().toString()
    at = {i: [i * 100.0, i * i * 1.0, 7.0] for i in range(1, 5)}

    def own(v, lon):
        length = sum(c * c for c in v) ** 0.5
        var = [m * m * 1e-6 + length * length * p * p * 1e-12 for m, p in ((3.0, 1.0), (3.0, 1.0), (5.0, 2.0))]
        axes = [[spark.range(1).select(c).first()[0] for c in row] for row in enu_axes(F.lit(lon), F.lit(-0.7))]
        return rotate_covariance([var[0], 0.0, var[1], 0.0, 0.0, var[2]], [[F.lit(c) for c in row] for row in axes], transpose=True)

    assert sorted(found) == [(i, j) for i in range(1, 5) for j in range(i, 5)]
    for i, j in ((1, 1), (1, 3), (2, 4)):
        a, b = own(at[i], 0.1 * i), own(at[j], 0.1 * j)
        d = own([p - q for p, q in zip(at[i], at[j])], (0.1 * i + 0.1 * j) / 2)
        wanted = a if i == j else [(p + q - r) / 2.0 for p, q, r in zip(a, b, d)]
        assert np.allclose(found[i, j], list(spark.range(1).select(*wanted).first()), rtol=1e-9, atol=1e-18)


def test_many_sets_share_a_call(spark, monkeypatch):
    """Hundreds of sets of several sizes, one of them without a name, in as many calls as partitions; each equals its own matrix."""
    sizes = [(None if s == 7 else f"s{s}", list(range(s % 3, s % 3 + 1 + s % 4))) for s in range(300)]
    rows, blocks = planted(sizes)
    calls, made = spark.sparkContext.accumulator(0), CV._whitener

    def counted(set_id):
        whiten = made(set_id)

        def run(left, right):
            calls.add(1)
            return whiten(left, right)

        return run

    monkeypatch.setattr(CV, "_whitener", counted)
    got = table(CV.whiten_sets(spark.createDataFrame(rows, ROWS), spark.createDataFrame(blocks, BLOCKS)))
    assert 0 < calls.value <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    want = {}
    for name, members in sizes:
        n = 3 * len(members)
        full, own = np.zeros((n, n)), [r for r in rows if r[0] == name]
        for _, i, j, cov in (b for b in blocks if b[0] == name):
            p, q = 3 * members.index(i), 3 * members.index(j)
            for v, (a, c) in zip(cov, LOWER):
                full[p + a, q + c] = full[p + c, q + a] = full[q + c, p + a] = full[q + a, p + c] = v
        named = sorted({t[0] for r in own for t in r[4]})
        raw = np.zeros((n, len(named) + 1))
        for _, i, comp, mis, design in own:
            at = 3 * members.index(i) + comp
            raw[at, -1] = mis
            for param, coef in design:
                raw[at, named.index(param)] += coef
        white = np.linalg.solve(np.linalg.cholesky(full), raw)
        for k in range(n):
            want[name, members[k // 3], k % 3] = white[k, -1], {p: c for p, c in zip(named, white[k]) if abs(c) > 1e-11}
    same(got, want)


def test_members_without_equations_are_refused(spark):
    rows, blocks = planted([("a", [1, 2, 3]), ("b", [1, 2])])
    some = [r for r in rows if r[:2] != ("b", 2)]
    with pytest.raises(Exception, match="members without equations"):
        CV.whiten_sets(spark.createDataFrame(some, ROWS), spark.createDataFrame(blocks, BLOCKS)).collect()
