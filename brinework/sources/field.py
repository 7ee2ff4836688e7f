"""A field in the raw schema, derived from the driver's tables by integer arithmetic that SQL engines share.

supplier = completion (every fourth an injector), nation = pattern, region = asset, lineitem by (supplier, ship date) = daily
volumes, monthly orders by customer nation = pressure readings. The texts run unchanged in Spark and in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PATTERN = "select n_nationkey id_pattern, n_name pattern_name, r_name asset from {nation} join {region} on n_regionkey = r_regionkey"

VOLUMES = """
select l_suppkey id_completion, cast(l_shipdate as date) prod_date,
 sum(case when l_suppkey % 4 <> 0 then l_quantity * 10 else 0 end) oil, sum(case when l_suppkey % 4 <> 0 then l_quantity * 25 else 0 end) water,
 sum(case when l_suppkey % 4 <> 0 then l_quantity * 6 else 0 end) gas, sum(case when l_suppkey % 4 = 0 then l_quantity * 160 else 0 end) water_inj,
 sum(case when l_suppkey % 8 = 0 then l_quantity * 4 else 0 end) gas_inj from {lineitem} group by l_suppkey, cast(l_shipdate as date)"""

FACTOR = """
select s_suppkey id_completion, s_nationkey id_pattern, cast((40 + (s_suppkey * 7) % 20) as double) / 100 factor, date '1994-12-31' effect_date from {supplier}
union all select s_suppkey, s_nationkey, cast((case when s_suppkey % 6 = 0 then 0 else 30 end) as double) / 100, date '1998-06-01' from {supplier} where s_suppkey % 3 = 0
union all select s_suppkey, (s_nationkey + 1 + s_suppkey % 7) % 25, cast((20 + (s_suppkey * 3) % 20) as double) / 100, date '1994-12-31' from {supplier} where s_suppkey % 3 = 1
union all select s_suppkey, (s_nationkey + 1 + s_suppkey % 7) % 25, cast((50 + (s_suppkey * 3) % 20) as double) / 100, date '1998-06-01' from {supplier} where s_suppkey % 3 = 0"""

PRESSURE = """
select c_nationkey id_pattern, cast(date_trunc('month', o_orderdate) as date) pressure_date,
 cast(2000 + 25 * ((count(*) * 37 + c_nationkey * 53) % 68) as double) pressure from {orders} join {customer} on o_custkey = c_custkey
where o_orderdate >= timestamp '1995-02-01' group by c_nationkey, cast(date_trunc('month', o_orderdate) as date)"""

PVT = """
select s_suppkey id_completion, td test_date, cast(2100 + 350 * j + 25 * (s_suppkey % 2) as double) pressure,
 cast(1.18 as double) + cast(0.00004 as double) * (350 * j - 400) bo, cast(1.02 as double) + cast(0.0001 as double) * (s_suppkey % 7) bw, cast(2.25 as double) / (2100 + 350 * j) bg,
 cast(520 as double) + cast(0.09 as double) * (350 * j - 400) rs, cast(0 as double) rv, cast(1.01 as double) bw_inj, cast(2.25 as double) / (2100 + 350 * j) bg_inj
from {supplier} cross join (select 0 j union all select 1 union all select 2 union all select 3) jj cross join (select date '1994-12-02' td union all select date '1998-03-01') tt
where (td < date '1998-01-01' or s_suppkey % 5 = 0) and (s_suppkey % 17 <> 3 or j = 1) and s_suppkey % 23 <> 5"""

TARGET = "select n_nationkey id_pattern, cast(90 + 5 * (n_nationkey % 5) as double) / 100 target_vrr from {nation} where n_nationkey % 6 <> 5"

MEMORY = """
select n_nationkey id_pattern, cast(80 + 5 * (n_nationkey % 4) as double) / 100 band_low, cast(case when n_nationkey % 9 = 0 then 0 else 120 end as double) / 100 band_high,
 cast(80 + 10 * (n_nationkey % 5) as double) / 100 response_factor, n_nationkey % 4 n_adjustments from {nation} where n_nationkey % 3 = 0"""

LIMITS = "select cast(0.15 as double) max_inj_rate_change_pct union all select cast(0.12 as double)"

ADJUSTMENT = """
select n_nationkey * 100 + k action_id, n_nationkey id_pattern, cast(concat(cast(1995 + (n_nationkey + k) % 4 as string), '-0', cast(1 + (n_nationkey * 3 + k) % 9 as string), '-01') as date) vrr_date,
 k ts, case when (n_nationkey + k) % 3 = 0 then 'water_inj_res' else 'oil_res' end driver, case when (n_nationkey + k) % 2 = 0 then 'reduce_injection' else 'increase_injection' end change_type,
 case when (n_nationkey + k) % 4 = 0 then 'rejected' else 'executed' end outcome, cast(5 + k as double) / 100 d_surface_pct, cast(100 + 5 * k as double) / 100 pre_vrr,
 cast(100 + 5 * k + (case when (n_nationkey + k) % 5 = 0 then 0 else 7 end) as double) / 100 predicted_post_vrr
from {nation} cross join (select 0 k union all select 1 union all select 2 union all select 3) kk"""

TABLES = {"pattern": PATTERN, "volumes": VOLUMES, "factors": FACTOR, "pressures": PRESSURE, "pvt": PVT, "targets": TARGET, "memory": MEMORY, "limits": LIMITS, "adjustments": ADJUSTMENT}
_SOURCES = ["region", "nation", "customer", "supplier", "orders", "lineitem"]


class Field:
    """The raw tables of one sf_dir, as lazy DataFrames: field.volumes, field.factors, ..."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._parts = spark, sf_dir, None

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        used = {t: self.spark.read.parquet(f"{self.sf_dir}/{t}.parquet") for t in _SOURCES if "{" + t + "}" in TABLES[name]}
        if name == "volumes":
            used["lineitem"] = self._by_completion(used["lineitem"], "l_suppkey")
        return self.spark.sql(TABLES[name], **used)

    def _by_completion(self, rows: DataFrame, key: str) -> DataFrame:
        """The rows dealt by completion, before they are summed to days, so that the sums and all joins by completion behind them need no
        further shuffle. A part for about a million rows, as a session's number of partitions is not made for every size."""
        if self._parts is None:
            self._parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), rows.count() >> 20)  # by the files' footers
        return rows.repartition(self._parts, key)


def as_ctes(names: list[str]) -> str:
    """The tables as CTEs over views of the same names as the driver's tables."""
    return ",\n".join(f"{n} as ({TABLES[n].format(**{t: t for t in _SOURCES})})" for n in names)
