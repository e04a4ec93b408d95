"""Dated station recodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _precedence() -> Column:
    """Which of several matching rules counts: ``before``, ``between``, the latest ``after``, then undated ones."""
    far = F.lit("9999-12-31").cast("timestamp_ntz")
    kind = (
        F.when(F.col("date_from").isNull() & F.col("date_to").isNull(), 3)
        .when(F.col("date_to").isNull(), 2)
        .when(F.col("date_from").isNull(), 0)
        .otherwise(1)
    )
    start = F.coalesce(F.datediff(F.to_date("date_from"), F.lit("1970-01-01").cast("date")), F.lit(0)) * 86400 + (
        F.coalesce(F.hour("date_from") * 3600 + F.minute("date_from") * 60, F.lit(0))
    )
    return F.struct(
        kind.alias("kind"),
        F.when(kind == 2, -start).when(kind == 1, start).otherwise(0).alias("start"),
        F.coalesce(F.col("date_to"), far).alias("until"),
        F.col("code_to").alias("target"),
    )


def _applies(ts: Column) -> Column:
    """``before`` excludes its date, ``between`` and ``after`` include theirs; undated rows meet undated rules only."""
    undated = F.col("date_from").isNull() & F.col("date_to").isNull()
    before = F.col("date_from").isNull() & (ts < F.col("date_to"))
    between = (ts >= F.col("date_from")) & (ts <= F.col("date_to"))
    after = F.col("date_to").isNull() & (ts >= F.col("date_from"))
    return undated | F.coalesce(before, F.lit(False)) | F.coalesce(between, F.lit(False)) | F.coalesce(after, F.lit(False))


def resolve(uses: DataFrame, rules: DataFrame) -> DataFrame:
    """``(code, ts, new_code, reject)`` for the distinct ``uses(code, ts)`` that a rule changes.

    Working on distinct pairs keeps a station that a third of all observations use down to its dates;
    the choice among matching rules is a combinable minimum.
    """
    r = rules.select(
        F.lower("code_from").alias("_key"), "code_to", "date_from", "date_to", F.col("reject").alias("_reject")
    )
    hits = uses.join(r, F.lower("code") == F.col("_key")).filter(_applies(F.col("ts")))
    chosen = hits.groupBy("code", "ts").agg(
        F.min_by(F.struct("code_to", "_reject"), _precedence()).alias("_best")
    )
    return chosen.select(
        "code", "ts", F.col("_best.code_to").alias("new_code"), F.col("_best._reject").alias("reject")
    )


def _uses(df: DataFrame, code: Column) -> DataFrame:
    return df.select(code.alias("code"), F.col("obs_ts").alias("ts")).filter(F.col("code").isNotNull())


def recode_ends(
    observations: DataFrame, global_rules: DataFrame, file_rules: DataFrame | None = None
) -> DataFrame:
    """Observations with both ends recoded, file rules first and global rules on what they give.

    Adds ``from_original``, ``to_original`` and ``recode_rejected`` (a rule for either end says not to use it).
    """
    out = observations.withColumns(
        {
            "from_original": F.col("from_code"),
            "to_original": F.col("to_code"),
            "recode_rejected": F.lit(False),
        }
    )
    for rules in [r for r in (file_rules, global_rules) if r is not None]:
        uses = _uses(out, F.col("from_code")).unionAll(_uses(out, F.col("to_code"))).distinct()
        table = resolve(uses, rules)
        for end in ("from_code", "to_code"):
            t = table.select(
                F.col("code").alias(end), F.col("ts").alias("_ts"), F.col("new_code").alias("_new"), F.col("reject").alias("_rej")
            )
            out = (
                out.join(t, [out[end] == t[end], out["obs_ts"].eqNullSafe(t["_ts"])], "left")
                .drop(t[end])
                .withColumns(
                    {
                        end: F.coalesce("_new", end),
                        "recode_rejected": F.col("recode_rejected") | F.coalesce("_rej", F.lit(False)),
                    }
                )
                .drop("_ts", "_new", "_rej")
            )
    return out


def stations_from_recodes(stations: DataFrame, recoded: DataFrame) -> DataFrame:
    """Stations plus copies of the originals for recoded codes that have no station of their own.

    ``recoded`` holds :func:`recode_ends` rows. Where several originals share a new code the first in code order is copied.
    """
    pairs = recoded.select(F.col("from_original").alias("old"), F.col("from_code").alias("new")).unionAll(
        recoded.select(F.col("to_original"), F.col("to_code"))
    )
    wanted = pairs.filter("old <> new").groupBy("new").agg(F.min("old").alias("old"))
    wanted = wanted.join(stations.select(F.col("code").alias("new")), "new", "left_anti")
    copies = stations.join(wanted, F.col("code") == F.col("old")).withColumn("code", F.col("new")).drop("old", "new")
    return stations.unionByName(copies)


def merge_definitions(rules: DataFrame) -> DataFrame:
    """Repeated definitions of one recode: the larger error stands, and an error of zero means none at all.

    ``conflict`` marks a code and period recoded to more than one target.
    """
    key = ["code_from", "date_from", "date_to"]
    error = lambda c: F.when(F.min(c) <= 0, 0.0).otherwise(F.max(c))
    merged = rules.groupBy(*key, "code_to").agg(
        error("h_error").alias("h_error"), error("v_error").alias("v_error"), F.bool_or("reject").alias("reject")
    )
    targets = merged.groupBy(*key).agg((F.count("*") > 1).alias("conflict"))
    cond = [merged[k].eqNullSafe(targets[k]) for k in key]
    return merged.join(targets, cond).select(merged["*"], "conflict")


def colocations(rules: DataFrame, stations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs ``(a, b, h_error, v_error)`` of an original and its recoded mark that share a place, and bad repeats.

    Both marks must be stations. A mark tied to two originals, or with different errors, is reported.
    """
    errors = rules.filter((F.col("h_error") > 0) | (F.col("v_error") > 0))
    pairs = errors.select(F.col("code_from").alias("a"), F.col("code_to").alias("b"), "h_error", "v_error").distinct()
    known = stations.select("code")
    pairs = pairs.join(known.withColumnRenamed("code", "a"), "a", "left_semi")
    pairs = pairs.join(known.withColumnRenamed("code", "b"), "b", "left_semi")
    bad = pairs.groupBy("b").agg(F.count("*").alias("n"), F.count_distinct("a").alias("n_originals")).filter("n > 1")
    return pairs.join(bad.select("b"), "b", "left_anti").select("a", "b", "h_error", "v_error"), bad


def recode_table(df: DataFrame, code_map: DataFrame, columns: list[str]) -> DataFrame:
    """Apply ``code_map(old, new)`` to code columns of a whole table."""
    out = df
    for c in columns:
        m = code_map.select(F.col("old").alias(c), F.col("new").alias("_new"))
        out = out.join(m, c, "left").withColumn(c, F.coalesce("_new", c)).drop("_new")
    return out.select(*df.columns)
