import random

from pyspark.sql import functions as F

from cairn.plans import ordered as O
from cairn.plans.settle import settle
from cairn.plans.skew import salted_join


def rows(n=200):
    rnd = random.Random(5)
    # One group holds most rows, as a hot file would.
    return [("hot" if rnd.random() < 0.8 else "b", i, f"v{i}" if rnd.random() < 0.2 else None, rnd.randint(0, 3)) for i in range(n)]


def test_blocked_scans_match_plain_ones(spark):
    data = rows()
    df = spark.createDataFrame(data, "g string, k long, v string, n long").repartition(7)
    out = O.carry_forward(df, ["g"], "k", {"last": F.col("v")}, block=16)
    out = O.running_sum(out, ["g"], "k", F.col("n"), "total", block=16)
    out = O.previous_value(out, ["g"], "k", {"before": F.col("k")}, block=16)
    got = {(r.g, r.k): (r["last"], r.total, r.before) for r in out.collect()}
    assert len(got) == len(data)
    state = {}
    for g, k, v, n in data:
        last, total, before = state.get(g, (None, 0, None))
        last, total = v or last, total + n
        assert got[g, k] == (last, total, before)
        state[g] = (last, total, k)


def test_number_rows_is_consecutive_in_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k"), "id").repartition(9)
    got = sorted((r.no, r.k) for r in O.number_rows(df, ["k", "id"], "no").collect())
    assert [n for n, _ in got] == list(range(1000))
    assert [k for _, k in got] == sorted(k for _, k in got)


def test_lines_are_numbered_across_splits(spark, tmp_path):
    for name, n in (("a.txt", 5000), ("b.txt", 37)):
        (tmp_path / name).write_text("".join(f"{name} line {i}\n" for i in range(1, n + 1)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = O.read_numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == 5037
    assert all(r.text.endswith(f"line {r.line_no}") for r in got)


def test_salted_join_is_the_plain_join(spark):
    left = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(300)], "k long, v long")
    right = spark.createDataFrame([(i, i * 10) for i in range(200)] + [(1, 11)], "k long, w long")
    for how in ("inner", "left"):
        plain = sorted(tuple(r) for r in left.join(right, "k", how).select("k", "v", "w").collect())
        salted = sorted(tuple(r) for r in salted_join(left, right, ["k"], ["v"], how, hot_rows=20).select("k", "v", "w").collect())
        assert plain == salted


def test_settle_keeps_rows_and_stops_filter_copies(spark):
    df = spark.range(10).withColumn("x", F.sqrt(F.col("id") + 1.0))
    out = settle(df, ["x"]).filter("x > 2")
    assert sorted(r.id for r in out.collect()) == [4, 5, 6, 7, 8, 9]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("SQRT") == 1
