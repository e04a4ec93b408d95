"""Survey-network views over the driver's tables.

Each view is one SQL text that runs unchanged in Spark and in DuckDB, so a
query and its check read the same rows. Exponent literals keep Spark from
reading decimals, and text is rounded before it is cast.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# name -> (tables and views it reads, SQL with {name} placeholders; {ts} is the zone-free timestamp type)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    # Stations over lat -46..-34, lon 167..178; one in ten is fixed control.
    "stations": (
        ("customer",),
        """SELECT concat('C', c_custkey) AS code, c_name AS name,
       -4.6E1 + ((c_custkey * 7919) % 100003) * 1.2E1 / 1.00003E5 AS lat_deg,
       1.67E2 + ((c_custkey * 104729) % 100003) * 1.1E1 / 1.00003E5 AS lon_deg,
       ((c_custkey * 613) % 2000) * 1.0E0 AS ohgt,
       ((c_custkey * 37) % 400) * 1.0E-1 AS und,
       c_mktsegment AS class_mark_type, concat('D', c_nationkey) AS class_district,
       CASE WHEN c_custkey % 10 = 0 THEN 'fix' ELSE 'free' END AS mode_v,
       CASE WHEN c_custkey % 10 = 0 THEN 'fix' WHEN c_custkey % 10 = 1 THEN 'float' ELSE 'free' END AS mode_h
FROM {customer}""",
    ),
    # Observation skeleton: who observed whom, when, how well.
    "obs": (
        ("lineitem", "orders", "customer"),
        """SELECT concat(l.l_orderkey, '-', l.l_linenumber, '-', l.l_partkey, '-', l.l_suppkey, '-',
              CAST(round(l.l_extendedprice * 100) AS BIGINT)) AS obs_key,
       concat('S', l.l_orderkey) AS set_id,
       concat('C', o.o_custkey) AS from_code,
       concat('C', 1 + (l.l_partkey * 37 + l.l_orderkey * 11 + l.l_linenumber)
              % (SELECT count(*) + 5 FROM {customer})) AS to_code,
       CASE WHEN l.l_orderkey % 53 = 0 THEN NULL ELSE l.l_shipdate END AS obs_ts,
       concat('F', l.l_returnflag) AS data_file, l.l_linestatus AS class_method,
       concat('P', l.l_suppkey % 7) AS class_party,
       1.0E-3 + l.l_tax * 1.0E-2 AS error,
       ((l.l_orderkey * 8191 + l.l_linenumber * 131) % 2001 - 1000) * 1.0E-6 AS noise,
       l.l_orderkey % 97 = 0 AS rejected,
       CAST(l.l_orderkey AS BIGINT) AS order_no, CAST(l.l_linenumber AS BIGINT) AS line_no
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey""",
    ),
    # The skeleton with both ends resolved; rows with an unknown end or equal ends drop out.
    "lines": (
        ("obs", "stations"),
        """SELECT o.*, f.lat_deg AS f_lat, f.lon_deg AS f_lon, f.ohgt AS f_ohgt, f.und AS f_und, f.mode_v AS f_mode,
       t.lat_deg AS t_lat, t.lon_deg AS t_lon, t.ohgt AS t_ohgt, t.und AS t_und, t.mode_v AS t_mode
FROM {obs} o JOIN {stations} f ON o.from_code = f.code JOIN {stations} t ON o.to_code = t.code
WHERE o.from_code <> o.to_code""",
    ),
    # Levelled height differences: the true difference plus deterministic noise.
    "levels": (
        ("lines",),
        """SELECT obs_key, set_id, 'LV' AS obs_type, from_code, to_code, obs_ts, data_file, class_method, class_party,
       error, rejected, t_ohgt - f_ohgt + noise AS value
FROM {lines}""",
    ),
    # Observations of several types; the type follows the line number.
    "mixed": (
        ("obs",),
        """SELECT o.*, CASE line_no % 7 WHEN 0 THEN 'SD' WHEN 1 THEN 'LV' WHEN 2 THEN 'AZ' WHEN 3 THEN 'ZD'
                       WHEN 4 THEN 'GB' WHEN 5 THEN 'HA' ELSE 'HD' END AS obs_type
FROM {obs} o""",
    ),
    # Results of an adjustment as the reports see them: residuals with their errors.
    "residuals": (
        ("mixed",),
        """SELECT m.*, noise AS residual, error * 9.0E-1 AS res_error,
       CASE WHEN order_no % 41 = 0 THEN NULL ELSE abs(noise) / (error * 9.0E-1) END AS sres,
       CASE WHEN obs_type = 'GB' THEN 3 ELSE 1 END AS rank
FROM {mixed} m""",
    ),
    # Dated recodes: half-open intervals, some reject.
    "recode": (
        ("supplier",),
        """SELECT concat('C', s_suppkey * 3) AS code_from, concat('C', s_suppkey * 3, 'R') AS code_to,
       CAST('1995-01-01' AS {ts}) AS date_from,
       CASE WHEN s_suppkey % 2 = 0 THEN CAST('1997-01-01' AS {ts}) END AS date_to,
       s_suppkey % 5 = 0 AS reject,
       (s_suppkey % 4) * 1.0E-3 AS h_error, (s_suppkey % 3) * 1.0E-3 AS v_error
FROM {supplier}""",
    ),
    # 25 x 25 geoid grid, 0.5 degree spacing from (-46.5, 166.5).
    "grid": (
        ("lineitem",),
        """SELECT CAST(floor(k / 25) AS BIGINT) AS iy, CAST(k % 25 AS BIGINT) AS ix,
       ((CAST(floor(k / 25) AS BIGINT) * 17 + (k % 25) * 29) % 101) * 1.0E-1 AS v
FROM (SELECT DISTINCT (l_orderkey * 7 + l_partkey) % 625 AS k FROM {lineitem}) d""",
    ),
    # One triangle with a triangular hole per supplier, as well-known text.
    "polygons": (
        ("supplier",),
        """SELECT s_suppkey AS poly_id, concat('POLYGON((', x, ' ', y, ',', x + 1, ' ', y, ',', x, ' ', y - 1, ',', x, ' ', y,
              '),(', x, '.1 ', y, '.1,', x, '.4 ', y, '.1,', x, '.1 ', y, '.4,', x, '.1 ', y, '.1))') AS wkt
FROM (SELECT s_suppkey, 167 + (s_suppkey * 7) % 10 AS x, -45 + (s_suppkey * 5) % 11 AS y FROM {supplier}) s
WHERE s_suppkey % 3 = 0""",
    ),
    # A second coordinate table: part of the stations moved a little, and new ones.
    "update_stations": (
        ("customer",),
        """SELECT concat('C', c_custkey * 2) AS code, concat('upd ', c_name) AS name,
       -4.6E1 + ((c_custkey * 2 * 7919) % 100003) * 1.2E1 / 1.00003E5 + 1.0E-6 AS lat_deg,
       1.67E2 + ((c_custkey * 2 * 104729) % 100003) * 1.1E1 / 1.00003E5 - 1.0E-6 AS lon_deg,
       ((c_custkey * 2 * 613) % 2000) * 1.0E0 + 5.0E-2 AS ohgt,
       ((c_custkey * 2 * 37) % 400) * 1.0E-1 + 1.0E-2 AS und,
       concat('N', c_custkey % 4) AS class_order
FROM {customer}""",
    ),
}


@lru_cache(maxsize=None)
def _closure(name: str) -> tuple[str, ...]:
    """The views ``name`` needs, dependencies first."""
    out: list[str] = []
    for need in VIEWS[name][0]:
        if need in VIEWS:
            out += [v for v in _closure(need) if v not in out]
    return (*out, name)


def with_views(*names: str) -> str:
    """A ``WITH`` list in DuckDB's terms defining ``names`` as ``fx_<name>``."""
    order: list[str] = []
    for name in names:
        order += [v for v in _closure(name) if v not in order]
    parts = []
    for view in order:
        needs, text = VIEWS[view]
        fill = {n: (f"fx_{n}" if n in VIEWS else n) for n in needs}
        parts.append(f"fx_{view} AS ({text.format(ts='TIMESTAMP', **fill)})")
    return "WITH " + ",\n".join(parts) + "\n"


class Tables:
    """Lazily opened tables and views of one scale-factor folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._open: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._open:
            self._open[name] = self._make(name)
        return self._open[name]

    def _make(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if name in VIEWS:
            needs, text = VIEWS[name]
            fill = {n: "{" + n + "}" for n in needs}
            return self.spark.sql(
                text.format(ts="TIMESTAMP_NTZ", **fill), **{n: getattr(self, n) for n in needs}
            )
        raise AttributeError(name)
