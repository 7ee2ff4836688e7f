"""Every registered query of the library with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brinework.functions.scalars import comparable
from brinework.operators import build, cases, knowledge, layout, routing, rules, search, text, tools, workflow
from brinework.sources.field import Field, as_ctes
from brinework.sources.store import new_path, written
from brinework.sources.versioned import VersionedTable
from brinework.streaming import intake

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query of (field) or (spark, sf_dir)."""

    def keep(f):
        if f.__code__.co_argcount == 1:
            QUERIES[name] = lambda spark, sf_dir: f(Field(spark, sf_dir))
        else:
            QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


def r4(name: str) -> F.Column:
    return comparable(F.col(name), 4).alias(name)


def d4(expr: str, name: str) -> str:
    return f"round({expr} + cast(3.17e-8 as double), 4) + 0.0 as {name}"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# --- the same plan as SQL, from the raw tables up ---

RAW = as_ctes(["pattern", "volumes", "factors", "pressures", "pvt"])
CONTRIB = f"""{RAW},
fw as (select *, lead(effect_date) over (partition by id_completion, id_pattern order by effect_date) f_end from factors),
pw as (select *, lead(pressure_date) over (partition by id_pattern order by pressure_date) p_end from pressures),
ctx as (select f.id_pattern, p.pattern_name, v.id_completion, v.prod_date vrr_date, case when v.oil + v.water + v.gas > 0 then 'Production' else 'Injection' end amount_type, f.factor, f.effect_date factor_effect_date, pw.pressure,
  cast(v.oil as double) oil, cast(v.water as double) water, cast(v.gas as double) gas, cast(v.water_inj as double) water_inj, cast(v.gas_inj as double) gas_inj
 from volumes v join fw f on v.id_completion = f.id_completion and v.prod_date >= f.effect_date and (f.f_end is null or v.prod_date < f.f_end)
 left join pattern p on p.id_pattern = f.id_pattern left join pw on pw.id_pattern = f.id_pattern and v.prod_date >= pw.pressure_date and (pw.p_end is null or v.prod_date < pw.p_end)),
tests as (select id_completion, test_date, lag(test_date) over w before, lead(test_date) over w nxt from (select distinct id_completion, test_date from pvt) window w as (partition by id_completion order by test_date)),
ctx2 as (select c.*, t.test_date from ctx c left join tests t on t.id_completion = c.id_completion and (t.before is null or c.vrr_date >= t.test_date) and (t.nxt is null or c.vrr_date < t.nxt)),
needs as (select distinct id_completion, test_date, pressure t from ctx2),
sides as (select n.id_completion, n.test_date, n.t, count(p.pressure) k, max(p.pressure) top, max(case when p.pressure = n.t then p.pressure end) ex,
  list(p.pressure order by p.pressure desc) filter (where p.pressure < n.t) lo, list(p.pressure order by p.pressure) filter (where p.pressure > n.t) up
 from needs n left join pvt p on p.id_completion = n.id_completion and p.test_date = n.test_date group by n.id_completion, n.test_date, n.t),
picks as (select *, case when k = 0 then 'none' when t is null then 'closest' when ex is not null then 'exact' when len(lo) > 0 and len(up) > 0 then 'interpolated' when len(lo) > 1 or len(up) > 1 then 'extrapolated' else 'closest' end pvt_method from sides),
ends as (select *, case when k = 0 then null when t is null then top when ex is not null then ex when len(lo) > 0 then lo[1] else up[1] end pa,
  case when pvt_method = 'interpolated' then up[1] when pvt_method = 'extrapolated' then (case when len(lo) > 1 then lo[2] else up[2] end) end pb from picks),
looks as (select e.id_completion, e.test_date, e.t, e.pvt_method,
  {", ".join(f"a.{p} + case when b.pressure is null or b.pressure = a.pressure then 0 else (e.t - a.pressure) / (b.pressure - a.pressure) * (b.{p} - a.{p}) end {p if p != 'bg' else 'bg_raw'}" for p in build.PROPERTIES)}
 from ends e left join pvt a on a.id_completion = e.id_completion and a.test_date = e.test_date and a.pressure = e.pa left join pvt b on b.id_completion = e.id_completion and b.test_date = e.test_date and b.pressure = e.pb),
contrib as (select c.id_pattern, c.pattern_name, c.id_completion, c.vrr_date, c.amount_type, c.factor, c.factor_effect_date, c.pressure, c.oil, c.water, c.gas, c.water_inj, c.gas_inj, l.pvt_method, c.test_date pvt_test_date,
  l.bo, l.bw, round(l.bg_raw, 5) bg, l.rs, l.rv, l.bw_inj, l.bg_inj,
  coalesce(c.factor * c.oil * l.bo, 0) oil_res, coalesce(c.factor * c.water * l.bw, 0) water_res,
  case when c.amount_type = 'Production' and c.oil > 0 and l.rs is not null and l.bg_raw is not null then c.factor * (c.gas * 1000 - l.rs * c.oil) * round(l.bg_raw, 5) end free_gas_res,
  coalesce(c.factor * c.water_inj * l.bw_inj, 0) water_inj_res, coalesce(c.factor * c.gas_inj * 1000 * l.bg_inj, 0) gas_inj_res
 from ctx2 c join looks l on l.id_completion = c.id_completion and l.test_date is not distinct from c.test_date and l.t is not distinct from c.pressure)"""


def pattern_sql(grain: str) -> str:
    period = "cast(date_trunc('month', vrr_date) as date)" if grain == "monthly" else "vrr_date"
    w = {"bo": "oil", "bw": "water", "bg": "gas", "bw_inj": "water_inj", "bg_inj": "gas_inj", "rs": "oil", "rv": "gas"}
    return f"""(select id_pattern, max(pattern_name) pattern_name, {period} vrr_date, '{grain}' grain, concat(id_pattern, '_{grain[0].upper()}') id_alias, avg(pressure) pressure,
 {", ".join(f"sum({c}) {c}" for c in build.VOLUME_COLUMNS + build.TERMS)}, sum(oil_res + water_res + coalesce(free_gas_res, 0)) prod_res, sum(water_inj_res + gas_inj_res) inj_res,
 coalesce(sum(water_inj_res + gas_inj_res) / nullif(sum(oil_res + water_res + coalesce(free_gas_res, 0)), 0), 0) vrr,
 {", ".join(f"sum({k} * {v}) / nullif(sum({v}), 0) {k}" for k, v in w.items())}, count(distinct id_completion) n_completions, bool_or(pvt_method in ('extrapolated', 'closest', 'none')) any_extrapolated
 from contrib group by id_pattern, {period} having sum(oil_res) + sum(water_res) <> 0 or sum(water_inj + gas_inj) > 0)"""


MONTHLY = f"{CONTRIB},\nmonthly as {pattern_sql('monthly')}"
DAILY = f"{CONTRIB},\ndaily as {pattern_sql('daily')}"


def with_monthly(tables: list[str]) -> str:
    return MONTHLY + "".join(f",\n{as_ctes([t])}" for t in tables)


_STORED: dict[tuple[str, str], str] = {}


def curated_of(field: Field) -> build.Curated:
    """The stored build of the field. It is made once in a session, as the tools read what a build has stored."""
    key = (field.spark.sparkContext.applicationId, field.sf_dir)
    if key not in _STORED:
        path = new_path(field.spark, "curated")
        build.store(field, path, run_id=path.rpartition("-")[2])
        _STORED[key] = path
    return build.Curated(field.spark, _STORED[key])


def contrib_of(field: Field) -> DataFrame:
    return curated_of(field).contrib


def monthly_of(field: Field) -> DataFrame:
    return curated_of(field).monthly


# --- curated build ---

@query("b10_curated_build", f"""with {MONTHLY}, daily as {pattern_sql('daily')}
select 'completion_contrib' table_name, count(*) n, count(*) stamped from contrib union all select t, n, n from (select unnest(['pattern_vrr', 'pattern_vrr_cumulative']) t), (select (select count(*) from monthly) + (select count(*) from daily) n)""")
def _(field):
    built = build.store(field, new_path(field.spark, "curated"), run_id="bench")
    stamped = lambda df, name: df.agg(F.count("*").alias("n"), F.count_if(F.col("run_id") == "bench").alias("stamped")).select(F.lit(name).alias("table_name"), "n", "stamped")
    return stamped(built.contrib, "completion_contrib").unionByName(stamped(built.pattern, "pattern_vrr")).unionByName(stamped(built.cumulative, "pattern_vrr_cumulative"))


@query("b01_factor_windows", f"with {as_ctes(['factors'])} select *, lead(effect_date) over (partition by id_completion, id_pattern order by effect_date) end_date from factors")
def _(field):
    return build.with_end_date(field.factors, ["id_completion", "id_pattern"], "effect_date")


@query("b02_pressure_windows", f"with {as_ctes(['pressures'])} select *, lead(pressure_date) over (partition by id_pattern order by pressure_date) end_date from pressures")
def _(field):
    return build.with_end_date(field.pressures, ["id_pattern"], "pressure_date")


@query("b03_daily_volumes", f"with {as_ctes(['volumes'])} select id_completion, prod_date, {', '.join(f'greatest(coalesce(cast({c} as double), 0), 0) {c}' for c in build.VOLUME_COLUMNS)} from volumes")
def _(field):
    return build.clamped_volumes(field.volumes)


@query("b04_volume_context", f"with {CONTRIB} select id_pattern, id_completion, vrr_date, amount_type, factor, factor_effect_date, pressure from ctx")
def _(field):
    x = build.volume_context(field.volumes, field.factors, field.pattern, field.pressures)
    return x.select("id_pattern", "id_completion", "vrr_date", "amount_type", "factor", "factor_effect_date", "pressure")


@query("b05_applicable_pvt_test", f"with {CONTRIB} select id_pattern, id_completion, vrr_date, test_date from ctx2")
def _(field):
    return build.contrib_of(field).select("id_pattern", "id_completion", "vrr_date", F.col("pvt_test_date").alias("test_date"))


@query("b06_pvt_lookup", f"with {CONTRIB} select id_pattern, id_completion, vrr_date, pvt_method, {', '.join(f'round({p} + cast(3.17e-8 as double), 5) + 0.0 {p}' for p in build.PROPERTIES)} from contrib")
def _(field):
    return build.contrib_of(field).select("id_pattern", "id_completion", "vrr_date", "pvt_method", *[comparable(F.col(p), 5).alias(p) for p in build.PROPERTIES])


@query("b06_pvt_method_counts", f"with {CONTRIB} select pvt_method, count(*) n from contrib group by pvt_method")
def _(field):
    return build.contrib_of(field).groupBy("pvt_method").agg(F.count("*").alias("n"))


@query("b08_contribution_terms", f"with {CONTRIB} select id_pattern, id_completion, vrr_date, {', '.join(d4(t, t) for t in build.TERMS)} from contrib")
def _(field):
    return build.contrib_of(field).select("id_pattern", "id_completion", "vrr_date", *map(r4, build.TERMS))


_PATTERN_COLUMNS = ["pressure", *build.VOLUME_COLUMNS, *build.TERMS, "prod_res", "inj_res", "vrr", *build.PROPERTIES]


def _pattern_rows(df: DataFrame) -> DataFrame:
    return df.select("id_pattern", "pattern_name", "vrr_date", "grain", "id_alias", *map(r4, _PATTERN_COLUMNS), "n_completions", "any_extrapolated")


def _pattern_select(table: str) -> str:
    return f"select id_pattern, pattern_name, vrr_date, grain, id_alias, {', '.join(d4(c, c) for c in _PATTERN_COLUMNS)}, n_completions, any_extrapolated from {table}"


@query("b11_pattern_vrr_monthly", f"with {MONTHLY} {_pattern_select('monthly')}")
def _(field):
    return _pattern_rows(build.pattern_vrr(build.contrib_of(field), "monthly"))


@query("b11_pattern_vrr_daily", f"with {DAILY} {_pattern_select('daily')}")
def _(field):
    return _pattern_rows(build.pattern_vrr(build.contrib_of(field), "daily"))


_CUMULATIVE = ["oil_res", "water_res", "water_inj_res", "gas_inj_res", "prod_res", "inj_res"]


@query("b13_cumulative_vrr", f"""with {MONTHLY}, c as (select id_pattern, vrr_date, {', '.join(f'sum({x}) over w cum_{x}' for x in _CUMULATIVE)} from monthly window w as (partition by id_pattern order by vrr_date rows between unbounded preceding and current row))
select id_pattern, vrr_date, {', '.join(d4(f'cum_{x}', f'cum_{x}') for x in _CUMULATIVE)}, {d4('coalesce(cum_inj_res / nullif(cum_prod_res, 0), 0)', 'cum_vrr')} from c""")
def _(field):
    return build.cumulative(build.pattern_vrr(build.contrib_of(field), "monthly")).select("id_pattern", "vrr_date", *[r4(f"cum_{x}") for x in _CUMULATIVE], r4("cum_vrr"))


class _Given:
    """The tables of a field, some of them replaced."""

    def __init__(self, field: Field, **tables: DataFrame):
        self.spark, self._field, self._tables = field.spark, field, tables

    def __getattr__(self, name: str) -> DataFrame:
        return self._tables[name] if name in self._tables else getattr(self._field, name)


# a month of all completions and another of a third of them come late: what they touch is built anew, the rest stays
_LATE = "(prod_date >= date '1996-03-01' and prod_date < date '1996-04-01') or (prod_date >= date '1997-11-01' and prod_date < date '1997-12-01' and id_completion % 3 = 0)"


@query("st11_incremental_rebuild", f"""with {MONTHLY}, c as (select id_pattern, vrr_date, sum(inj_res) over w cum_inj_res, sum(prod_res) over w cum_prod_res from monthly window w as (partition by id_pattern order by vrr_date rows between unbounded preceding and current row))
select m.id_pattern, m.vrr_date, {', '.join(d4(f'm.{x}', x) for x in (*build.TERMS, 'prod_res', 'inj_res', 'vrr'))}, {d4('cum_inj_res', 'cum_inj_res')}, {d4('cum_prod_res', 'cum_prod_res')} from monthly m join c using (id_pattern, vrr_date)""")
def _(field):
    path = new_path(field.spark, "curated-by-month")
    raw = field.volumes.where(f"not ({_LATE})")
    build.store(_Given(field, volumes=raw), path, "first", months=True)
    state = field.volumes.where(_LATE).withColumnRenamed("prod_date", "event_date")
    now = build.rebuilt(_Given(field, volumes=intake.promoted(raw, state)), path, intake.unpromoted(raw, state), "second")
    x = now.monthly.join(now.cumulative.where("grain = 'monthly'").select("id_pattern", "vrr_date", "cum_inj_res", "cum_prod_res"), ["id_pattern", "vrr_date"])
    return x.select("id_pattern", "vrr_date", *map(r4, [*build.TERMS, "prod_res", "inj_res", "vrr", "cum_inj_res", "cum_prod_res"]))


# --- analyst's tools ---

# by a name in other letters, by an id, by nothing that exists, and by what begins several ids (of patterns named by their number)
_LONG_IDS = "select concat('PAT', cast(1000 + id_pattern // 10 as varchar), cast(id_pattern % 10 as varchar), 'Z') id_pattern, pattern_name from pattern"


@query("t00_resolve_pattern", f"""with {as_ctes(['pattern'])}, long as ({_LONG_IDS}) select 'name' asked, id_pattern, pattern_name from long where upper(pattern_name) = (select min(upper(pattern_name)) from long)
 union all select 'id', id_pattern, pattern_name from long where id_pattern = 'PAT10017Z' union all select 'prefix', id_pattern, pattern_name from long where starts_with(id_pattern, 'PAT10024')""")
def _(field):
    long = field.pattern.select(F.concat(F.lit("PAT"), (1000 + F.floor(F.col("id_pattern") / 10)).cast("string"), (F.col("id_pattern") % 10).cast("string"), F.lit("Z")).alias("id_pattern"), "pattern_name")
    first = long.agg(F.min(F.upper("pattern_name"))).collect()[0][0] or ""
    asked = {"name": f" {first.lower()} ", "id": "PAT10017Z", "prefix": "PAT10024", "ambiguous": "PAT100", "short": "PAT", "unknown": "atlantis"}
    out = None
    for kind, name in asked.items():
        found = tools.resolve(long, name).select(F.lit(kind).alias("asked"), "id_pattern", "pattern_name")
        out = found if out is None else out.unionByName(found)
    return out


@query("t01_list_patterns", f"with {MONTHLY} select id_pattern, max(pattern_name) pattern_name, count(*) n_periods, max(vrr_date) last_date from monthly group by id_pattern")
def _(field):
    return tools.list_patterns(monthly_of(field))


_BANDS = "case when coalesce(m.band_low, 0) = 0 then 0.9 else m.band_low end band_low, case when coalesce(m.band_high, 0) = 0 then 1.1 else m.band_high end band_high"
_BOTH = "case when coalesce(m.band_low, 0) <> 0 and coalesce(m.band_high, 0) <> 0 then m.band_low else 0.9 end band_low, case when coalesce(m.band_low, 0) <> 0 and coalesce(m.band_high, 0) <> 0 then m.band_high else 1.1 end band_high"
_LATEST = "latest as (select * from (select *, row_number() over (partition by id_pattern order by vrr_date desc) rn from monthly) where rn = 1)"


@query("t02_overview", f"""with {with_monthly(['targets', 'memory'])}, {_LATEST},
o as (select l.*, coalesce(t.target_vrr, 1.0) target, {_BANDS} from latest l left join targets t using (id_pattern) left join memory m using (id_pattern))
select id_pattern, pattern_name, vrr_date, {d4('vrr', 'vrr')}, {d4('target', 'target_vrr')}, {d4('abs(vrr - target)', 'drift')}, case when vrr > band_high then 'above band' when vrr < band_low then 'below band' else 'in band' end verdict, any_extrapolated from o order by abs(vrr - target) desc, id_pattern limit 50""")
def _(field):
    x = tools.overview(monthly_of(field), field.targets, field.memory, 50)
    return x.select("id_pattern", "pattern_name", "vrr_date", r4("vrr"), r4("target_vrr"), r4("drift"), "verdict", "any_extrapolated")


@query("t03_data_quality", f"""with {RAW},
v as (select distinct id_completion from volumes), f as (select distinct id_completion from factors), registered as (select s_suppkey id_completion from supplier where s_suppkey % 11 <> 3)
select 'factor_sum_over_one' check_name, concat(id_completion, '|', effect_date) key from factors group by id_completion, effect_date having sum(factor) > 1.0001
union all select 'volumes_without_allocation', cast(id_completion as varchar) from v anti join f using (id_completion)
union all select 'allocation_without_volumes', cast(id_completion as varchar) from f anti join v using (id_completion)
union all select 'patterns_without_pressure', cast(id_pattern as varchar) from (select distinct id_pattern from factors) anti join pressures using (id_pattern)
union all select 'completions_without_pvt', cast(id_completion as varchar) from v anti join pvt using (id_completion)
union all select 'unregistered_completions', cast(id_completion as varchar) from v anti join registered using (id_completion)""")
def _(field):
    registered = field.spark.read.parquet(f"{field.sf_dir}/supplier.parquet").where("s_suppkey % 11 <> 3").select(F.col("s_suppkey").alias("id_completion"))
    return tools.quality_report(tools.data_quality(field.volumes, field.factors, field.pattern, field.pressures, field.pvt, registered))


@query("t03_overlapping_allocation", f"""with {as_ctes(['factors'])}, w as (select *, lead(effect_date) over (partition by id_completion, id_pattern order by effect_date) f_end from factors),
days as (select distinct id_completion, effect_date d from w union select distinct id_completion, f_end from w where f_end is not null),
held as (select d.id_completion, d.d, round(sum(w.factor), 9) total, lead(d.d) over (partition by d.id_completion order by d.d) nxt from days d left join w on w.id_completion = d.id_completion and d.d >= w.effect_date and (w.f_end is null or d.d < w.f_end) group by d.id_completion, d.d),
isl as (select *, d - lag(nxt) over (partition by id_completion order by d) gap from held where total > 0.8),
grp as (select *, sum(case when gap = 0 then 0 else 1 end) over (partition by id_completion order by d) g from isl)
select id_completion, min(d) from_date, arg_max(nxt, d) until_date, max(total) most_allocated from grp group by id_completion, g""")
def _(field):
    return tools.over_allocated(field.factors, most=0.8)  # nothing of this field is above one


@query("t04_trend", f"with {MONTHLY} select id_pattern, vrr_date, {d4('vrr', 'vrr')} from monthly where vrr_date between date '1996-01-01' and date '1997-06-01'")
def _(field):
    return tools.trend(monthly_of(field), "1996-01-01", "1997-06-01").select("id_pattern", "vrr_date", r4("vrr"))


@query("t05_latest", f"with {MONTHLY}, {_LATEST} select id_pattern, vrr_date, {d4('vrr', 'vrr')} from latest")
def _(field):
    return tools.latest(monthly_of(field)).select("id_pattern", "vrr_date", r4("vrr"))


@query("t06_term_totals", f"with {CONTRIB} select id_pattern, cast(date_trunc('month', vrr_date) as date) vrr_date, {', '.join(d4(f'coalesce(sum({t}), 0)', t) for t in build.TERMS)} from contrib group by all")
def _(field):
    return tools.term_totals(contrib_of(field)).select("id_pattern", "vrr_date", *map(r4, build.TERMS))


_COMPLETIONS = f"""{CONTRIB}, comp as (select id_pattern, cast(date_trunc('month', vrr_date) as date) vrr_date, id_completion, count(*) n_days, avg(factor) factor, string_agg(distinct pvt_method, ',' order by pvt_method) pvt_methods, min(pressure) min_pressure, max(pressure) max_pressure,
 sum(oil_res + water_res + coalesce(free_gas_res, 0)) prod_res, sum(water_inj_res + gas_inj_res) inj_res from contrib group by all)"""


@query("t08_completions", f"""with {_COMPLETIONS} select id_pattern, vrr_date, id_completion, n_days, {d4('factor', 'factor')}, pvt_methods, min_pressure, max_pressure, {d4('prod_res', 'prod_res')}, {d4('inj_res', 'inj_res')},
 case when inj_res > prod_res then 'injector' when prod_res > 0 then 'producer' else 'idle' end as role, {d4('coalesce(prod_res / nullif(sum(prod_res) over w, 0), 0)', 'share_of_production')}, {d4('coalesce(inj_res / nullif(sum(inj_res) over w, 0), 0)', 'share_of_injection')} from comp window w as (partition by id_pattern, vrr_date)""")
def _(field):
    x = tools.completions(contrib_of(field))
    return x.select("id_pattern", "vrr_date", "id_completion", "n_days", r4("factor"), "pvt_methods", "min_pressure", "max_pressure", r4("prod_res"), r4("inj_res"), "role", r4("share_of_production"), r4("share_of_injection"))


@query("t10_lineage", f"""with {_COMPLETIONS} select id_pattern, vrr_date, count(*) n_completions, {d4('min(factor)', 'min_factor')}, {d4('max(factor)', 'max_factor')}, {d4('sum(factor * (prod_res + inj_res)) / nullif(sum(prod_res + inj_res), 0)', 'weighted_factor')}, {d4('sum(inj_res) / nullif(sum(prod_res), 0)', 'vrr')} from comp group by id_pattern, vrr_date""")
def _(field):
    x = tools.lineage(contrib_of(field))
    return x.select("id_pattern", "vrr_date", "n_completions", *map(r4, ["min_factor", "max_factor", "weighted_factor", "vrr"]))


_ROLLED = f"""{MONTHLY}, rolled as (select id_pattern, cast(date_trunc('month', vrr_date) as date) vrr_date, id_completion, count(*) n_days, min(pressure) min_pressure, max(pressure) max_pressure, string_agg(distinct pvt_method, ',' order by pvt_method) pvt_methods, avg(factor) factor,
 {', '.join(f'sum(coalesce({c}, 0)) {c}' for c in build.VOLUME_COLUMNS + build.TERMS)} from contrib group by all)"""


@query("t10_lineage_rows", f"with {_ROLLED} select id_pattern, vrr_date, id_completion, n_days, min_pressure, max_pressure, pvt_methods, {', '.join(d4(c, c) for c in ['factor', *build.VOLUME_COLUMNS, *build.TERMS])} from rolled")
def _(field):
    x = tools.lineage_rows(contrib_of(field))
    return x.select("id_pattern", "vrr_date", "id_completion", "n_days", "min_pressure", "max_pressure", "pvt_methods", *map(r4, ["factor", *build.VOLUME_COLUMNS, *build.TERMS]))


@query("t10_lineage_detail", f"""with {_ROLLED}, t as (select id_pattern, vrr_date, {', '.join(f'sum({c}) {c}' for c in build.TERMS)}, count(factor) n_factors, sum(factor * ({' + '.join(build.TERMS)})) / nullif(sum({' + '.join(build.TERMS)}), 0) weighted, string_agg(cast(id_completion as varchar), ',' order by id_completion) ids from rolled group by all)
select t.id_pattern, t.vrr_date, {', '.join(d4(f't.{c}', c) for c in build.TERMS)}, n_factors, {d4('weighted', 'weighted_factor')}, ids completions, {d4('(t.water_inj_res + t.gas_inj_res) / nullif(t.oil_res + t.water_res + t.free_gas_res, 0)', 'recomputed_vrr')}, {d4('m.vrr', 'stored_vrr')} from t left join monthly m using (id_pattern, vrr_date)""")
def _(field):
    x = tools.lineage_detail(contrib_of(field), monthly_of(field))
    ids = F.array_join(F.transform("completions", lambda c: c["id_completion"].cast("string")), ",").alias("completions")
    return x.select("id_pattern", "vrr_date", *map(r4, build.TERMS), "n_factors", r4("weighted_factor"), ids, r4("recomputed_vrr"), r4("stored_vrr"))


@query("t05_one_month", f"with {MONTHLY} select id_pattern, pattern_name, vrr_date, {d4('vrr', 'vrr')}, any_extrapolated from monthly where vrr_date = date '1996-06-01'")
def _(field):
    return tools.one_month(monthly_of(field), "1996-06-01").select("id_pattern", "pattern_name", "vrr_date", r4("vrr"), "any_extrapolated")


@query("t11_audit", f"""with {MONTHLY}, a as (select id_pattern, vrr_date, vrr stored_vrr, inj_res / nullif(prod_res, 0) recomputed_vrr from monthly)
select id_pattern, vrr_date, {d4('stored_vrr', 'stored_vrr')}, {d4('recomputed_vrr', 'recomputed_vrr')}, coalesce(abs(recomputed_vrr - stored_vrr) <= 1e-6, false) matches from a""")
def _(field):
    again = build.pattern_vrr(build.contrib_of(field), "monthly")  # from the raw tables, not from what is stored
    x = tools.audit(monthly_of(field), again)
    return x.select("id_pattern", "vrr_date", r4("stored_vrr"), r4("recomputed_vrr"), "matches")


# --- rules ---

_INJ, _PROD = rules.INJECTION, rules.PRODUCTION
_SAME = "abs({a} - {b}) <= greatest(abs({a}), abs({b})) * 1e-9"
_LM = "case when {a} > 0 and {b} > 0 then case when " + _SAME + " then {a} else ({b} - {a}) / ln({b} / {a}) end else 0 end"


def _side(side: str, terms: list[str]) -> str:
    same = _SAME.format(a=f"{side}_a", b=f"{side}_b")
    ok = " and ".join([f"{side}_a > 0", f"{side}_b > 0", f"not ({same})", *[f"{t}_{s} > 0" for t in terms for s in "ab"]])
    each = []
    for t in terms:
        lm = "(" + _LM.format(a=f"{t}_a", b=f"{t}_b") + ")/(" + _LM.format(a=f"{side}_a", b=f"{side}_b") + ")"
        each.append(f"{side}_side * case when {ok} then {lm} * ln({t}_b / {t}_a) / ln({side}_b / {side}_a) when {same} then 0 else ({t}_b - {t}_a) / nullif({side}_b - {side}_a, 0) end c_{t}")
    name = "injection" if side == "inj" else "production"
    return ", ".join([f"case when {ok} then 'lmdi' when {same} then 'no_change' else 'share_of_change' end {name}_method", *each])


DECOMPOSED = f"""{MONTHLY},
z as (select id_pattern, vrr_date, {', '.join(f'coalesce({t}, 0) {t}' for t in _INJ + _PROD)} from monthly),
q as (select b.id_pattern, b.vrr_date, {', '.join(f'a.{t} {t}_a, b.{t} {t}_b' for t in _INJ + _PROD)} from z b join z a on a.id_pattern = b.id_pattern and cast(a.vrr_date + interval 1 month as date) = b.vrr_date),
q1 as (select *, {', '.join(f"{' + '.join(f'{t}_{s}' for t in ts)} {n}_{s}" for n, ts in (('inj', _INJ), ('prod', _PROD)) for s in 'ab')} from q),
q2 as (select *, inj_a / prod_a vrr_a, inj_b / prod_b vrr_b from q1 where prod_a > 0 and prod_b > 0),
q3 as (select *, vrr_b - vrr_a d_vrr, case when inj_a > 0 and inj_b > 0 then (case when ({_LM.format(a='vrr_a', b='vrr_b')}) = 0 then vrr_a else ({_LM.format(a='vrr_a', b='vrr_b')}) end) * ln(inj_b / inj_a) when {_SAME.format(a='prod_a', b='prod_b')} then vrr_b - vrr_a else 0 end inj_side from q2),
q4 as (select *, d_vrr - inj_side prod_side from q3),
decomposed as (select *, {_side('inj', _INJ)}, {_side('prod', _PROD)} from q4)"""


@query("r03_decompose", f"with {DECOMPOSED} select id_pattern, vrr_date, {d4('vrr_a', 'vrr_a')}, {d4('vrr_b', 'vrr_b')}, {d4('d_vrr', 'd_vrr')}, {d4('inj_side', 'inj_side')}, {d4('prod_side', 'prod_side')}, injection_method, production_method, {', '.join(d4(f'c_{t}', f'c_{t}') for t in _INJ + _PROD)} from decomposed")
def _(field):
    x = rules.decompose(rules.month_pairs(monthly_of(field)))
    return x.select("id_pattern", "vrr_date", *map(r4, ["vrr_a", "vrr_b", "d_vrr", "inj_side", "prod_side"]), "injection_method", "production_method", *[r4(f"c_{t}") for t in _INJ + _PROD])


@query("r04_driver_shares", f"""with {DECOMPOSED}, u as ({' union all '.join(f"select id_pattern, vrr_date, '{t}' term, c_{t} contribution, {t}_b - {t}_a delta from decomposed" for t in _INJ + _PROD)})
select id_pattern, vrr_date, term, {d4('contribution', 'contribution')}, {d4('delta', 'delta')}, {d4('abs(contribution) / case when sum(abs(contribution)) over w = 0 then 1 else sum(abs(contribution)) over w end', 'share')}, case when contribution > 0 then 'increased VRR' else 'decreased VRR' end direction from u window w as (partition by id_pattern, vrr_date)""")
def _(field):
    x = rules.drivers(rules.decompose(rules.month_pairs(monthly_of(field))))
    return x.select("id_pattern", "vrr_date", "term", r4("contribution"), r4("delta"), r4("share"), "direction")


ANOMALIES = f"""{with_monthly(['memory'])}, {_LATEST},
mv as (select *, vrr - lag(vrr) over (partition by id_pattern order by vrr_date) move from monthly),
mr as (select *, row_number() over (partition by id_pattern order by vrr_date desc) k, sign(move) s from mv where move is not null),
br as (select a.id_pattern, min(a.k) filter (where a.s = 0 or a.s <> b.s) cut, max(a.k) last from mr a join mr b on a.id_pattern = b.id_pattern and b.k = 1 group by a.id_pattern),
runs as (select m.id_pattern, count(*) run, sum(m.move) total from mr m join br on br.id_pattern = m.id_pattern and m.k < coalesce(br.cut, br.last + 1) group by m.id_pattern),
st as (select l.id_pattern, l.vrr_date, l.vrr, l.any_extrapolated x, {_BOTH}, r.run, r.total from latest l left join memory m using (id_pattern) left join runs r using (id_pattern)),
anomalies as (select id_pattern, vrr_date, vrr, 'extrapolated_pvt' kind, 'low' severity, false actionable from st where x
 union all select id_pattern, vrr_date, vrr, 'out_of_band', 'high', not x from st where vrr < band_low or vrr > band_high
 union all select id_pattern, vrr_date, vrr, 'sustained_drift', 'medium', not x from st where run >= 3 and abs(total) >= 0.10)"""


@query("r05_detect_anomalies", f"with {ANOMALIES} select id_pattern, vrr_date, {d4('vrr', 'vrr')}, kind, severity, actionable from anomalies")
def _(field):
    return rules.detect_anomalies(monthly_of(field), field.memory).select("id_pattern", "vrr_date", r4("vrr"), "kind", "severity", "actionable")


STATE = f"""{MONTHLY},
periods as (select id_pattern, cast(date_trunc('month', vrr_date) as date) period, count(*) n_rows, list_sort(list(distinct pvt_method)) methods, count(*) filter (where pressure is null) n_missing_pressure, min(factor_effect_date) oldest from contrib group by all),
months as (select distinct cast(date_trunc('month', vrr_date) as date) period from contrib),
seen as (select distinct id_pattern, id_completion, cast(date_trunc('month', vrr_date) as date) period from contrib),
silent as (select f.id_pattern, p.period, count(distinct f.id_completion) n from factors f cross join months p left join seen s on s.id_pattern = f.id_pattern and s.id_completion = f.id_completion and s.period = p.period where s.id_completion is null and f.factor > 0 group by all),
state as (select p.*, (select count(*) from volumes v anti join factors f on f.id_completion = v.id_completion) n_missing_factor, (select count(*) from (select 1 from factors group by id_completion, effect_date having sum(factor) > 1.0001)) n_allocation_over_one,
 coalesce(s.n, 0) n_allocated_without_volumes, date_diff('day', p.oldest, p.period) allocation_age_days from periods p left join silent s on s.id_pattern = p.id_pattern and s.period = p.period)"""


@query("j01_input_state", f"with {STATE} select id_pattern, period, n_rows, array_to_string(methods, ',') pvt_methods, n_missing_pressure, n_missing_factor, n_allocation_over_one, n_allocated_without_volumes, allocation_age_days from state")
def _(field):
    x = rules.input_state(contrib_of(field), field.volumes, field.factors)
    return x.select("id_pattern", "period", "n_rows", F.array_join("pvt_methods", ",").alias("pvt_methods"), "n_missing_pressure", "n_missing_factor", "n_allocation_over_one", "n_allocated_without_volumes", "allocation_age_days")


def _verdicts(field: Field) -> DataFrame:
    stored = curated_of(field)
    state = rules.input_state(stored.contrib, field.volumes, field.factors)
    diff = rules.recompute_difference(stored.monthly, stored.contrib)
    return rules.assess_inputs(state.join(diff, ["id_pattern", "period"], "left"))


VERDICTS = f"""{STATE},
flags as (select *, list_has_any(methods, ['extrapolated', 'closest', 'none']) low, case when list_has_any(methods, ['extrapolated', 'closest', 'none']) or n_missing_pressure > 0 or n_missing_factor > 0 or n_allocation_over_one > 0 then 'high' when n_allocated_without_volumes > 0 or allocation_age_days > 1095 then 'medium' end worst from state),
verdicts as (select id_pattern, period, case worst when 'high' then 'DATA_ARTIFACT' when 'medium' then 'INCONCLUSIVE' else 'REAL_SIGNAL' end verdict,
 case when low then 'pvt_not_measured' when n_missing_pressure > 0 then 'missing_pressure' when n_missing_factor > 0 then 'missing_allocation' when n_allocation_over_one > 0 then 'allocation_over_one' when n_allocated_without_volumes > 0 then 'allocated_without_volumes' when allocation_age_days > 1095 then 'stale_allocation' end summary from flags)"""


@query("r12_input_verdicts", f"with {VERDICTS} select id_pattern, period, verdict, summary from verdicts")
def _(field):
    return _verdicts(field).select("id_pattern", "period", "verdict", "summary")


@query("r13_summaries", f"""with {VERDICTS} select v.id_pattern, v.period, summary, case when verdict = 'DATA_ARTIFACT' then 'data_steward' else 'analyst' end as owner, case summary
 when 'pvt_not_measured' then 'fluid properties were not measured at this pressure: ' || array_to_string(list_filter(s.methods, lambda m: m in ('extrapolated', 'closest', 'none')), ', ') when 'missing_pressure' then s.n_missing_pressure || ' rows have no pressure reading in force'
 when 'missing_allocation' then s.n_missing_factor || ' volume rows of the field belong to completions without any allocation' when 'allocation_over_one' then s.n_allocation_over_one || ' completions of the field are allocated above one'
 when 'allocated_without_volumes' then s.n_allocated_without_volumes || ' allocated completions reported no volumes' when 'stale_allocation' then 'the oldest allocation in use is ' || s.allocation_age_days || ' days old' end summary_text
 from verdicts v join state s on s.id_pattern = v.id_pattern and s.period = v.period""")
def _(field):
    return _verdicts(field).select("id_pattern", "period", "summary", "owner", "summary_text")


@query("t12_verdict_counts", f"with {VERDICTS} select verdict, count(*) n from verdicts group by verdict")
def _(field):
    return _verdicts(field).groupBy("verdict").agg(F.count("*").alias("n"))


@query("t15_injector_states", f"with {CONTRIB} select id_pattern, cast(date_trunc('month', vrr_date) as date) vrr_date, id_completion, {d4('avg(factor)', 'factor')}, {d4('sum(water_inj)', 'surface')}, {d4('sum(water_inj_res)', 'inj_res')}, {d4('coalesce(sum(water_inj_res) / nullif(avg(factor) * sum(water_inj), 0), 0)', 'bw_inj')} from contrib where water_inj > 0 group by all")
def _(field):
    x = rules.injector_states(contrib_of(field))
    return x.select("id_pattern", "vrr_date", "id_completion", *map(r4, ["factor", "surface", "inj_res", "bw_inj"]))


RECOMMENDED = """base as (select m.id_pattern, m.vrr_date, m.prod_res, m.inj_res total_inj, m.inj_res / m.prod_res cur, coalesce(t.target_vrr, 1.0) target, coalesce(mem.response_factor, 1.0) rho, (select min(max_inj_rate_change_pct) from limits) cap from monthly m left join targets t using (id_pattern) left join memory mem using (id_pattern) where m.prod_res > 0),
off as (select *, (target * prod_res - total_inj) / rho d from base where abs(cur - target) > 0.02),
inj as (select id_pattern, cast(date_trunc('month', vrr_date) as date) vrr_date, id_completion, avg(factor) factor, sum(water_inj) surface, sum(water_inj_res) inj_res from contrib where water_inj > 0 group by all),
j as (select o.*, i.id_completion, i.surface, i.inj_res, i.factor * coalesce(i.inj_res / nullif(i.factor * i.surface, 0), 0) denom, sum(i.inj_res) over (partition by o.id_pattern, o.vrr_date) s from off o join inj i on i.id_pattern = o.id_pattern and i.vrr_date = o.vrr_date),
k as (select *, d * inj_res / case when s <> 0 then s when total_inj <> 0 then total_inj else 1 end / denom / surface pct from j where denom <> 0 and surface <> 0),
l as (select *, greatest(-cap, least(cap, pct)) change from k)"""


@query("r09_recommend_change", f"""with {with_monthly(['targets', 'memory', 'limits'])}, {RECOMMENDED}
select id_pattern, vrr_date, id_completion, {d4('change', 'change_pct')}, {d4('change * surface', 'delta_surface')}, {d4('cur + rho * sum(change * surface * denom) over (partition by id_pattern, vrr_date) / prod_res', 'expected_post_vrr')}, case when d < 0 then 'reduce_injection' when d > 0 then 'increase_injection' else 'none' end direction from l""")
def _(field):
    x = _recommended(field)
    return x.select("id_pattern", "vrr_date", "id_completion", r4("change_pct"), r4("delta_surface"), r4("expected_post_vrr"), "direction")


def _recommended(field: Field) -> DataFrame:
    stored = curated_of(field)
    return rules.recommend(stored.monthly, rules.injector_states(stored.contrib), field.targets, field.memory, field.limits)


@query("r11_precedents", f"""with {as_ctes(['adjustments'])} select driver, change_type, action_id, id_pattern, vrr_date, d_surface_pct, pre_vrr from (select *, row_number() over (partition by driver, change_type order by ts desc, action_id desc) rn from adjustments where outcome = 'executed') where rn = 1""".replace(" as string", " as varchar"))
def _(field):
    return rules.precedents(field.adjustments).select("driver", "change_type", "action_id", "id_pattern", "vrr_date", "d_surface_pct", "pre_vrr")


OUTCOMES = f"""{with_monthly(['adjustments', 'memory'])}, outcomes as (select a.action_id, a.id_pattern, a.vrr_date, a.ts, a.pre_vrr, a.predicted_post_vrr, arg_min(m.vrr, m.vrr_date) actual from adjustments a join monthly m on m.id_pattern = a.id_pattern and m.vrr_date > a.vrr_date and m.vrr is not null where a.outcome = 'executed' group by all)""".replace(" as string", " as varchar")


@query("j07_outcome_write_back", f"with {OUTCOMES} select action_id, id_pattern, {d4('actual', 'actual_post_vrr')} from outcomes")
def _(field):
    return rules.outcome_write_back(field.adjustments, monthly_of(field), field.memory).where("status = 'written'").select("action_id", "id_pattern", r4("actual_post_vrr"))


# a third of the history has its outcome already; the job runs twice, and the second run finds only what still waits
_HALF_LEARNED = "pend as (select *, case when action_id % 3 = 0 then cast(1 as double) end known from adjustments), obs as (select p.action_id, arg_min(m.vrr, m.vrr_date) seen, min(m.vrr_date) on_date from pend p join monthly m on m.id_pattern = p.id_pattern and m.vrr_date > p.vrr_date and m.vrr is not null where p.outcome = 'executed' and p.known is null group by p.action_id)"


def _written_back(field: Field) -> tuple[DataFrame, DataFrame, DataFrame]:
    history = field.adjustments.withColumn("actual_post_vrr", F.when(F.col("action_id") % 3 == 0, F.lit(1.0)))
    memory = field.memory
    for _ in range(2):
        outcomes = rules.outcome_write_back(history, monthly_of(field), memory)
        history, memory = rules.written_back(history, memory, outcomes)
    return history, memory, outcomes


@query("j07_history_after_two_runs", f"""with {OUTCOMES}, {_HALF_LEARNED} select p.action_id, {d4('coalesce(p.known, o.seen)', 'actual_post_vrr')} from pend p left join obs o using (action_id)""")
def _(field):
    return _written_back(field)[0].select("action_id", r4("actual_post_vrr"))


@query("j07_still_waiting", f"""with {OUTCOMES}, {_HALF_LEARNED} select p.action_id, p.id_pattern, 'waiting' status, 'no later period' skip_reason from pend p left join obs o using (action_id) where p.outcome = 'executed' and p.known is null and o.seen is null""")
def _(field):
    return _written_back(field)[2].select("action_id", "id_pattern", "status", "skip_reason")


@query("j07_memory_after_two_runs", f"""with recursive {OUTCOMES}, {_HALF_LEARNED},
o as (select p.id_pattern, row_number() over (partition by p.id_pattern order by p.vrr_date, p.ts) k, p.predicted_post_vrr - p.pre_vrr p, b.seen - p.pre_vrr a from pend p join obs b using (action_id)),
fold as (select id_pattern, cast(0 as bigint) k, cast(response_factor as double) rho from memory union all
 select f.id_pattern, o.k, case when o.p = 0 then f.rho else greatest(0.3, least(3.0, cast(0.7 as double) * f.rho + cast(0.3 as double) * greatest(0.2, least(5.0, o.a / o.p)))) end from fold f join o on o.id_pattern = f.id_pattern and o.k = f.k + 1)
select f.id_pattern, {d4('arg_max(f.rho, f.k)', 'response_factor')}, cast(max(f.k) + max(m.n_adjustments) as bigint) n_adjustments from fold f join memory m using (id_pattern) group by f.id_pattern""")
def _(field):
    return _written_back(field)[1].select("id_pattern", r4("response_factor"), F.col("n_adjustments").cast("long").alias("n_adjustments"))


@query("r10_learned_response", f"""with recursive {OUTCOMES},
o as (select *, row_number() over (partition by id_pattern order by vrr_date, ts) k, predicted_post_vrr - pre_vrr p, actual - pre_vrr a from outcomes),
fold as (select id_pattern, cast(0 as bigint) k, cast(response_factor as double) rho from memory union all
 select f.id_pattern, o.k, case when o.p = 0 then f.rho else greatest(0.3, least(3.0, cast(0.7 as double) * f.rho + cast(0.3 as double) * greatest(0.2, least(5.0, o.a / o.p)))) end from fold f join o on o.id_pattern = f.id_pattern and o.k = f.k + 1)
select f.id_pattern, {d4('arg_max(f.rho, f.k)', 'response_factor')}, cast(max(f.k) + max(m.n_adjustments) as bigint) n_adjustments from fold f join memory m using (id_pattern) group by f.id_pattern having max(f.k) > 0""")
def _(field):
    x = rules.learned_responses(rules.outcome_write_back(field.adjustments, monthly_of(field), field.memory), field.memory)
    return x.select("id_pattern", r4("response_factor"), "n_adjustments")


AT = f"""{with_monthly(['memory'])},
mv as (select *, vrr - lag(vrr) over (partition by id_pattern order by vrr_date) move from monthly where vrr is not null),
ms as (select *, sign(move) s, row_number() over (partition by id_pattern order by vrr_date) k from mv),
brk as (select *, max(case when s is null or s = 0 or s is distinct from prior then k end) over (partition by id_pattern order by k) began from (select *, lag(s) over (partition by id_pattern order by k) prior from ms)),
st as (select b.id_pattern, b.vrr_date, b.vrr, b.any_extrapolated x, {_BOTH}, case when coalesce(s, 0) = 0 then 0 else k - began + 1 end run, case when coalesce(s, 0) <> 0 then sum(move) over (partition by b.id_pattern, began order by k) end total from brk b left join memory m using (id_pattern)),
anomalies as (select id_pattern, vrr_date, 'extrapolated_pvt' kind, 'low' severity, false actionable from st where x
 union all select id_pattern, vrr_date, 'out_of_band', 'high', not x from st where vrr < band_low or vrr > band_high
 union all select id_pattern, vrr_date, 'sustained_drift', 'medium', not x from st where run >= 3 and abs(total) >= 0.10)"""


@query("t14_anomalies_as_of_each_month", f"with {AT} select id_pattern, vrr_date, kind, severity, actionable from anomalies")
def _(field):
    return rules.anomalies_at(monthly_of(field), field.memory).select("id_pattern", "vrr_date", "kind", "severity", "actionable")


def _cases(field: Field) -> DataFrame:
    verdicts = _verdicts(field).select("id_pattern", F.col("period").alias("vrr_date"), "verdict", "summary", "summary_text", "findings", "pvt_methods", "difference")
    executed = field.adjustments.where("outcome = 'executed'")
    return cases.case_files(monthly_of(field), verdicts, _recommended(field), field.targets, field.memory, executed)


CASES = f"""{DECOMPOSED}, {VERDICTS[len(MONTHLY) + 2:]}, {AT[len(MONTHLY) + 2:]}, {as_ctes(['targets', 'limits', 'adjustments']).replace(" as string", " as varchar")}, {RECOMMENDED},
sized as (select id_pattern, vrr_date, max(case when d < 0 then 'reduce_injection' when d > 0 then 'increase_injection' else 'none' end) direction, max(cur + rho * s2 / prod_res) expected, count(*) n_changes, sum(change) sum_change, count(*) filter (where change <> pct) n_bounded
 from (select *, sum(change * surface * denom) over (partition by id_pattern, vrr_date) s2 from l) group by id_pattern, vrr_date),
u as ({' union all '.join(f"select id_pattern, vrr_date, {i} o, '{t}' term, c_{t} c from decomposed" for i, t in enumerate(_INJ + _PROD))}),
lead_term as (select id_pattern, vrr_date, term from (select *, row_number() over (partition by id_pattern, vrr_date order by abs(c) desc, o) rn from u) where rn = 1),
top as (select * from (select *, row_number() over (partition by id_pattern, vrr_date order by case severity when 'high' then 0 when 'medium' then 1 else 2 end, kind) rn from anomalies) where rn = 1),
prec as (select driver, arg_max(action_id, ts * 1000000 + action_id) p from adjustments where outcome = 'executed' group by driver),
joined as (select m.id_pattern, m.pattern_name, m.vrr_date, m.vrr, coalesce(t.target_vrr, 1.0) target_vrr, coalesce(v.verdict, 'INCONCLUSIVE') verdict, d.d_vrr, l.term driver, a.kind, a.severity sev, coalesce(a.actionable, false) act, z.direction dir0, z.expected exp0, z.n_changes n0, z.sum_change s0, z.n_bounded b0, prec.p precedent, mem.n_adjustments, {_BOTH.replace('m.', 'mem.')}
 from monthly m left join targets t using (id_pattern) left join memory mem using (id_pattern) left join verdicts v on v.id_pattern = m.id_pattern and v.period = m.vrr_date left join decomposed d on d.id_pattern = m.id_pattern and d.vrr_date = m.vrr_date
 left join lead_term l on l.id_pattern = m.id_pattern and l.vrr_date = m.vrr_date left join top a on a.id_pattern = m.id_pattern and a.vrr_date = m.vrr_date left join prec on prec.driver = l.term left join sized z on z.id_pattern = m.id_pattern and z.vrr_date = m.vrr_date),
cased as (select *, case when verdict = 'DATA_ARTIFACT' then 'data_steward' else 'analyst' end as owner, coalesce(kind, case when verdict = 'DATA_ARTIFACT' then 'input_audit' end) primary_anomaly, case when kind is not null then sev when verdict = 'DATA_ARTIFACT' then 'high' end severity,
 case when verdict = 'REAL_SIGNAL' then dir0 end direction, case when verdict = 'REAL_SIGNAL' then exp0 end expected, case when verdict = 'REAL_SIGNAL' then n0 end n_changes, case when verdict = 'REAL_SIGNAL' then s0 end sum_change, case when verdict = 'REAL_SIGNAL' then b0 end n_bounded,
 case when vrr between band_low and band_high then 'on target' when vrr > band_high then 'OVER-replicating (injecting too much)' else 'UNDER-replicating (injecting too little)' end as position from joined),
filed as (select *, case when primary_anomaly is null then null when not act then 'low' when precedent is not null and coalesce(n_adjustments, 0) >= 3 then 'high' else 'medium' end confidence,
 case when primary_anomaly is null then null when verdict = 'DATA_ARTIFACT' then 'fix_inputs' when verdict <> 'REAL_SIGNAL' or not act then 'investigate_inputs' when direction <> 'none' then direction else 'none' end action_type from cased)"""


@query("j04_case_files", f"""with {CASES} select id_pattern, vrr_date, {d4('vrr', 'vrr')}, target_vrr, verdict, owner, {d4('d_vrr', 'd_vrr')}, driver, primary_anomaly, confidence, severity, position, action_type, direction, {d4('expected', 'expected_post_vrr')}, n_changes, n_bounded, {d4('sum_change', 'sum_change')}, precedent from filed""")
def _(field):
    changes = {"n_changes": F.when(F.col("changes").isNotNull(), F.size("changes")), "n_bounded": F.size(F.filter("changes", lambda c: c["bounded"])), "sum_change": F.aggregate("changes", F.lit(0.0), lambda s, c: s + c["change_pct"])}
    x = _cases(field).withColumns(changes).withColumn("n_bounded", F.when(F.col("changes").isNotNull(), F.col("n_bounded")))
    return x.select("id_pattern", "vrr_date", r4("vrr"), "target_vrr", "verdict", "owner", r4("d_vrr"), "driver", "primary_anomaly", "confidence", "severity", "position", "action_type", "direction", r4("expected_post_vrr"), "n_changes", "n_bounded", r4("sum_change"), "precedent")


_DRAFT = "id_pattern, vrr_date, primary_anomaly anomaly_kind, severity, driver, action_type, confidence, verdict audit_verdict, owner owner_role"
_DRAFT_COLUMNS = ["id_pattern", "vrr_date", "anomaly_kind", "severity", "driver", "action_type", "confidence", "audit_verdict", "owner_role"]


@query("j06_anomaly_queue", f"""with {CASES} select {_DRAFT}, 'draft' stage from (select *, row_number() over (partition by id_pattern order by vrr_date desc) back from filed) where back = 1 and primary_anomaly is not null""")
def _(field):
    latest = tools.latest(_cases(field))
    queue = workflow.action_queue(field.spark, new_path(field.spark, "action-queue"))
    for _ in range(2):  # the second run replaces what is pending by the same
        workflow.queue_anomalies(queue, cases.drafts(latest))
    return queue.read().select(*_DRAFT_COLUMNS, "stage")


@query("r08_drafts", f"with {CASES} select {_DRAFT}, precedent, {d4('case when action_type in (%sreduce_injection%s, %sincrease_injection%s) then expected end' % tuple([chr(39)] * 4), 'expected_post_vrr')} from filed where primary_anomaly is not null")
def _(field):
    return cases.drafts(_cases(field)).select(*_DRAFT_COLUMNS, "precedent", r4("expected_post_vrr"))


# every draft is submitted twice under its request, a third then goes on to the analyst, and the anomalies are queued anew: what is
# pending is replaced, what has moved on stays and has a new draft beside it
@query("t17_submitted_drafts", f"""with {CASES}, d as (select {_DRAFT} from filed where primary_anomaly is not null)
select *, 'draft' stage, 'anomaly_to_queue' stage_by from d union all select *, 'analyst', 'someone' from d where id_pattern % 3 = 0""")
def _(field):
    queue = workflow.action_queue(field.spark, new_path(field.spark, "action-queue"))
    drafts = written(cases.drafts(_cases(field)).withColumn("request_id", F.concat_ws("/", "id_pattern", F.col("vrr_date").cast("string"))), "drafts")  # queued three times
    for _ in range(2):
        workflow.submit(queue, drafts)
    workflow.advance(queue, queue.read().where("id_pattern % 3 = 0").select("action_id", F.lit("advance").alias("verb"), F.lit("someone").alias("user"), F.lit("analyst").alias("role")))
    workflow.queue_anomalies(queue, drafts)
    return queue.read().select(*_DRAFT_COLUMNS, "stage", "stage_by")


@query("q02_lane_of_the_analyst", f"""with {CASES}, d as (select {_DRAFT} from filed where primary_anomaly is not null and id_pattern % 3 = 0)
select *, row_number() over (order by case severity when 'high' then 0 when 'medium' then 1 else 2 end, vrr_date desc, id_pattern) place from d qualify place <= 50""")
def _(field):
    staged = cases.drafts(_cases(field)).withColumn("stage", F.when(F.col("id_pattern") % 3 == 0, "analyst").otherwise("draft")).withColumn("action_id", F.col("id_pattern"))
    # the board's first fifty; their places show the order
    shown = workflow.by_stage(staged, "analyst").limit(50)
    order = Window.partitionBy("stage").orderBy(workflow.severity_rank(F.col("severity")), F.col("vrr_date").desc(), "action_id")
    return shown.withColumn("place", F.row_number().over(order).cast("long")).select(*_DRAFT_COLUMNS, "place")


@query("q02_newest_adjustments", f"with {as_ctes(['adjustments'])} select action_id, id_pattern, outcome from adjustments order by ts desc, action_id desc limit 20".replace(" as string", " as varchar"))
def _(field):
    return workflow.newest(field.adjustments, 20).select("action_id", "id_pattern", "outcome")


@query("j03_stored_audit", f"with {VERDICTS} select id_pattern, period vrr_date, verdict, summary from verdicts")
def _(field):
    table, found = workflow.audit_table(field.spark, new_path(field.spark, "input-audit")), written(_verdicts(field), "verdicts")  # stored three times
    workflow.store_audit(table, found.withColumn("verdict", F.lit("old")), every_period=False)
    for _ in range(2):
        workflow.store_audit(table, found)
    return table.read().select("id_pattern", "vrr_date", "verdict", "summary")


@query("j05_narratives")
def _(field):
    x = cases.narrated(_cases(field))
    return x.select("id_pattern", "vrr_date", "narrative", F.size(text.uncited(F.col("narrative"), F.col("facts"))).alias("n_uncited"))


_OTHERS = "select id_completion, count(distinct id_pattern) n_patterns from contrib group by id_completion"


@query("t09_pattern_layout", f"""with {_COMPLETIONS}, roles as (select *, case when inj_res > prod_res then 'injector' when prod_res > 0 then 'producer' else 'idle' end as role from comp),
n as (select id_pattern, vrr_date, count(*) filter (where role = 'injector') i, count(*) filter (where role = 'producer') p from roles group by all), o as ({_OTHERS})
select r.id_pattern, r.vrr_date, r.id_completion, r.role, case when i = 0 then 'no_injector' when i > 1 then 'multi_injector' else case p when 2 then 'line_drive' when 3 then 'triangular' when 4 then 'five_spot' when 6 then 'seven_spot' when 8 then 'nine_spot' else 'irregular' end end geometry, o.n_patterns > 1 shared, contains(pvt_methods, 'extrapolated') low_confidence
from roles r join n using (id_pattern, vrr_date) join o using (id_completion)""")
def _(field):
    contrib = contrib_of(field)
    others = contrib.groupBy("id_completion").agg(F.countDistinct("id_pattern").alias("n_patterns"))
    named = tools.completions(contrib).withColumn("completion_name", F.col("id_completion").cast("string"))
    return layout.placed(named, others).select("id_pattern", "vrr_date", "id_completion", "role", "geometry", "shared", "low_confidence")


@query("t09_layout_drawing", f"""with {_COMPLETIONS}, roles as (select *, case when inj_res > prod_res then 'injector' when prod_res > 0 then 'producer' else 'idle' end as role from comp), o as ({_OTHERS}),
n as (select id_pattern, vrr_date, count(*) filter (where role = 'injector') i, count(*) filter (where role = 'producer') p, count(*) filter (where role = 'idle') d, max(case when role = 'injector' then least(14, length(cast(id_completion as varchar))) else 0 end) longest,
 count(*) filter (where role = 'producer') n_links, string_agg(case when o.n_patterns > 1 then cast(id_completion as varchar) end, ',' order by cast(id_completion as varchar)) shared, sum(case when role = 'producer' then round(greatest(0, least(1, factor)), 4) end) total from roles join o using (id_completion) group by id_pattern, vrr_date),
g as (select *, case when i = 0 then 'no injector' when i > 1 then 'multi injector' else case p when 2 then 'line drive' when 3 then 'triangular' when 4 then 'five spot' when 6 then 'seven spot' when 8 then 'nine spot' else 'irregular' end end geometry from n)
select id_pattern, vrr_date, n_links, {d4('total', 'factors')}, round(100 * case when i <= 1 then 0 else greatest(0.17 + 0.085 * (i - 1), (greatest(longest * 5.1, 14 * 4.9) + 6) / (2 * sin(3.141592653589793 / i)) / 100) end, 2) + 0.0 hub_radius, coalesce(shared, '') shared,
 geometry || ': ' || i || ' injector' || case when i = 1 then '' else 's' end || ', ' || p || ' producer' || case when p = 1 then '' else 's' end || case when d > 0 then ', ' || d || ' idle' else '' end || '; a scheme, not a map' caption from g""")
def _(field):
    contrib = contrib_of(field)
    others = contrib.groupBy("id_completion").agg(F.countDistinct("id_pattern").alias("n_patterns"))
    x = layout.drawing(layout.placed(tools.completions(contrib).withColumn("completion_name", F.col("id_completion").cast("string")), others))
    total = F.when(F.size("links") > 0, F.aggregate("links", F.lit(0.0), lambda s, v: s + v["factor"]))
    return x.withColumn("factors", total).select("id_pattern", "vrr_date", F.size("links").cast("long").alias("n_links"), r4("factors"), "hub_radius", F.array_join("shared", ",").alias("shared"), "caption")


@query("t13_pattern_context", f"""with {as_ctes(['pattern', 'targets', 'memory', 'limits', 'adjustments']).replace(" as string", " as varchar")},
a as (select id_pattern, string_agg(cast(action_id as varchar), ',' order by ts desc, action_id desc) actions from (select *, row_number() over (partition by id_pattern order by ts desc, action_id desc) n from adjustments) where n <= 20 group by id_pattern)
select p.id_pattern, coalesce(target_vrr, 1.0) target_vrr, response_factor, (select min(max_inj_rate_change_pct) from limits) max_change, actions from pattern p left join targets using (id_pattern) left join memory using (id_pattern) left join a using (id_pattern)""")
def _(field):
    x = tools.pattern_context(field.pattern, field.targets, field.memory, field.adjustments, field.limits)
    return x.select("id_pattern", "target_vrr", "response_factor", "max_change", F.array_join(F.transform("adjustments", lambda a: a.cast("string")), ",").alias("actions"))


@query("j08_refreshed_memory", f"with {with_monthly(['memory'])}, {_LATEST} select m.id_pattern, m.response_factor, {d4('l.vrr', 'latest_vrr')}, l.vrr_date latest_date from memory m left join latest l using (id_pattern)")
def _(field):
    return tools.refreshed_memory(field.memory, monthly_of(field)).select("id_pattern", "response_factor", r4("latest_vrr"), "latest_date")


# every adjustment as a queued action: its stage from its number, and a request from the role that its number names
_QUEUE = """queue as (select *, case action_id % 6 when 0 then 'draft' when 1 then 'analyst' when 2 then 'rm' when 3 then 'site' when 4 then 'executed' else 'rejected' end stage, case action_id % 4 when 0 then 'analyst' when 1 then 'rm' else 'site' end as role, case when action_id % 7 = 0 then 'reject' else 'advance' end verb from adjustments)"""


@query("q03_moved_actions", f"""with {as_ctes(['adjustments']).replace(" as string", " as varchar")}, {_QUEUE},
need as (select *, case stage when 'draft' then 'analyst' when 'analyst' then 'rm' when 'rm' then 'site' when 'site' then 'site' end needed from queue)
select action_id, stage, case when needed is null then 'stage is final' when role <> needed then 'needs ' || needed end refused,
 case when needed is null or role <> needed then stage when verb = 'reject' then 'rejected' else case stage when 'draft' then 'analyst' when 'analyst' then 'rm' when 'rm' then 'site' else 'executed' end end moved_to from need""")
def _(field):
    return _moves(field).select("action_id", "stage", "refused", "moved_to")


def _moves(field: Field) -> DataFrame:
    number = F.col("action_id")
    stage = F.element_at(F.array(*map(F.lit, [*workflow.STAGES, "rejected"])), (number % 6 + 1).cast("int"))
    queue = field.adjustments.withColumns({"stage": stage, "direction": F.col("change_type"), "action_type": F.col("change_type"), "changes": F.array(F.struct(F.col("d_surface_pct").alias("change_pct")), F.struct((F.col("d_surface_pct") * 3).alias("change_pct")))})
    role = F.when(number % 4 == 0, "analyst").when(number % 4 == 1, "rm").otherwise("site")
    asked = queue.select("action_id", F.when(number % 7 == 0, "reject").otherwise("advance").alias("verb"), F.lit("someone").alias("user"), role.alias("role"))
    return workflow.moved(queue, asked)


@query("r15_adjustment_rows", f"""with {as_ctes(['adjustments']).replace(" as string", " as varchar")}, {_QUEUE}
select action_id, id_pattern, change_type, {d4('d_surface_pct * 2', 'd_surface_pct')}, approved_by, outcome from (select *, 'someone' approved_by, 'executed' outcome from (select * exclude (outcome) from queue where stage = 'site' and role = 'site' and verb = 'advance'))""")
def _(field):
    return workflow.adjustment_rows(_moves(field)).select("action_id", "id_pattern", "change_type", r4("d_surface_pct"), "approved_by", "outcome")


@query("q05_rate_limits", """with recursive lim as (select * from (values ('chat', 20, 60.0), ('chat_agentic', 5, 300.0), ('upload', 10, 600.0), ('review', 60, 600.0)) l(bucket, most, width)),
c as (select case event_id % 4 when 0 then 'chat' when 1 then 'chat_agentic' when 2 then 'upload' else 'review' end bucket, cast(user_id as varchar) who, epoch_us(ts::timestamp) ts from events),
o as (select c.*, most, cast(width * 1000000 as bigint) w, row_number() over (partition by bucket, who order by ts) k from c join lim using (bucket)),
fold as (select bucket, who, k, ts, ts start, 1 n from o where k = 1 union all
 select o.bucket, o.who, o.k, o.ts, case when o.ts - f.start >= o.w then o.ts else f.start end, case when o.ts - f.start >= o.w then 1 else f.n + 1 end from fold f join o on o.bucket = f.bucket and o.who is not distinct from f.who and o.k = f.k + 1)
select f.bucket, count(*) calls, count(*) filter (where n > most) refused, sum(n)::bigint numbers from fold f join lim using (bucket) group by f.bucket""")
def _(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    calls = events.select(F.element_at(F.array(*map(F.lit, workflow.CALLS)), (F.pmod(F.col("event_id"), F.lit(4)) + 1).cast("int")).alias("bucket"), F.col("user_id").cast("string").alias("who"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("ts"))
    return workflow.rate_limited(calls.withColumn("ts", F.col("ts") / 1e6)).groupBy("bucket").agg(F.count("*").alias("calls"), F.count_if("refused").alias("refused"), F.sum("n").alias("numbers"))


@query("k04_ingested_chunks")
def _(spark, sf_dir):
    return knowledge.ingested(_documents(spark, sf_dir)).select("doc_id", "chunk", "chunks_in_doc", "piece", F.array_join("kinds", ",").alias("kinds"))


@query("k06_previews")
def _(spark, sf_dir):
    shown = text.preview(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.lit(1).alias("page"), "text"))
    return shown.withColumn("pii_kinds", F.array_join(F.transform(F.map_entries("pii_kinds"), lambda e: F.concat_ws("=", e["key"], e["value"])), ","))


@query("q08_asked_months")
def _(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", workflow.asked_date(F.col("text")).alias("asked"))


@query("q01_board_lanes", f"""with {as_ctes(['adjustments'])}, stages as (select * from (values (0, 'draft'), (1, 'analyst'), (2, 'rm'), (3, 'site'), (4, 'executed')) s(ordinal, stage))
select s.ordinal, s.stage, count(a.action_id) n from stages s left join adjustments a on a.outcome = s.stage group by all""".replace(" as string", " as varchar"))
def _(field):
    return tools.lanes(field.adjustments.withColumn("stage", F.col("outcome")), workflow.STAGES)


# --- documents, conversations, vectors, events ---

_NORMALIZED = r"""select doc_id, regexp_replace(replace(replace(regexp_replace(regexp_replace(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(160), ' '), '[ \t]+', ' ', 'g'), '\n{2,}', chr(57344), 'g'), chr(10), ' '), chr(57344), chr(10) || chr(10)), '^[\t\n\x0B\f\r ]+|[\t\n\x0B\f\r ]+$', '', 'g') normalized from documents"""


@query("k01_normalized_documents", _NORMALIZED)
@query("k01_normalized_all_documents", _NORMALIZED)
def _(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", text.normalized(F.col("text")).alias("normalized"))


@query("r19_redacted_emails", r"""select doc_id, regexp_replace(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b', '[REDACTED:email]', 'g') clean from documents""")
def _(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", F.regexp_replace("text", text.PII["email"], "[REDACTED:email]").alias("clean"))


@query("r19_redacted_documents")
def _(spark, sf_dir):
    return text.redacted(_documents(spark, sf_dir)).select("doc_id", "clean", F.array_join("kinds", ",").alias("kinds"))


@query("r18_detected_ssn_email", r"""select doc_id, kind, unnest(list_distinct(hits)) as "match" from (select doc_id, 'email' kind, regexp_extract_all(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b') hits from documents union all select doc_id, 'ssn', regexp_extract_all(text, '\b\d{3}-\d{2}-\d{4}\b') from documents)""")
def _(spark, sf_dir):
    return text.detected(_documents(spark, sf_dir), ["email", "ssn"])


@query("r18_detected_all_kinds")
def _(spark, sf_dir):
    return text.detected(_documents(spark, sf_dir))


@query("k02_fixed_chunks", """select doc_id, chunk, chunks_in_doc, piece from (select doc_id, cast(unnest(range(len(pieces))) as int) chunk, cast(len(pieces) as int) chunks_in_doc, unnest(pieces) piece from
 (select doc_id, list_filter(list_transform(range(1, length(text) + 1, 200), lambda i: trim(substring(text, i, 200), ' ')), lambda p: p <> '') pieces from documents where length(text) > 0))""")
def _(spark, sf_dir):
    return text.split_fixed(_documents(spark, sf_dir))


@query("k02_recursive_chunks")
def _(spark, sf_dir):
    return text.chunked(_documents(spark, sf_dir), "recursive")


@query("k02_semantic_chunks")
def _(spark, sf_dir):
    embed = lambda sentences: sentences.withColumn("embedding", text.letter_counts(F.col("sentence")))
    return text.chunked(_documents(spark, sf_dir), "semantic", embed)


@query("r20_paragraph_chunks")
def _(spark, sf_dir):
    return text.chunked(_documents(spark, sf_dir), "paragraphs")


@query("k07_boundary_quality", """with pieces as (select unnest(list_filter(list_transform(range(1, length(text) + 1, 200), lambda i: trim(substring(text, i, 200), ' ')), lambda p: p <> '')) piece from documents where length(text) > 0)
select count(*) chunks, round(avg(case when regexp_matches(piece, '[.!?:]$') then 1.0 else 0.0 end), 2) ends_on_sentence, min(length(piece)) "min", max(length(piece)) "max", cast(round(avg(length(piece))) as bigint) "avg" from pieces""")
def _(spark, sf_dir):
    return text.boundary_quality(text.split_fixed(_documents(spark, sf_dir)))


@query("k10_unique_documents", "select min(doc_id) doc_id, sha256(text) sha256, count(*) copies from documents group by sha256(text)")
def _(spark, sf_dir):
    return text.unique_by_content(_documents(spark, sf_dir))


@query("i11_html_titles", r"select page_id, trim(regexp_extract(coalesce(html, ''), '(?is)<title[^>]*>(.*?)</title>', 1)) title from pages")
def _(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", text.html_title(F.col("html")).alias("title"))


@query("i17_batch_summary", "select lang, count(*) n_docs, sum(length(text))::bigint n_chars, round(avg(length(text)))::bigint avg_chars from documents group by lang")
def _(spark, sf_dir):
    return text.batch_summary(_documents(spark, sf_dir), "lang")


_SEARCHED = f"""with q as (select vec_id query_id, embedding query from embeddings where vec_id % 50 = 0),
p as (select query_id, vec_id, list_cosine_similarity(cast(query as double[]), cast(embedding as double[])) s from embeddings cross join q)
select query_id, vec_id, {d4('s', 'similarity')}, rank from (select *, cast(row_number() over (partition by query_id order by s desc, vec_id) as int) as rank from p where s >= 0.2) where rank <= 3"""


def _every_50th(vectors: DataFrame) -> DataFrame:
    """The stated query set of searches: every row whose id is divisible by 50, against all rows."""
    return vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), "label")


@query("k05_vector_search", _SEARCHED)
@query("k05_vector_search_every_50th", _SEARCHED)
def _(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    found = search.search(vectors, _every_50th(vectors).select("query_id", "query"), 3, 0.2)
    return found.select("query_id", "vec_id", r4("similarity"), "rank")


@query("t18_search_by_kind", f"""with e as (select vec_id, embedding, case when label < 6 then 'reservoir' when label < 9 then 'app_help' end doc_kind from embeddings), q as (select vec_id query_id, embedding query, case when vec_id % 100 = 0 then 'reservoir' when vec_id % 150 = 0 then 'app_help' end asked from e where vec_id % 50 = 0),
p as (select query_id, vec_id, list_cosine_similarity(cast(query as double[]), cast(embedding as double[])) s from e cross join q where asked is null or asked = doc_kind)
select query_id, vec_id, {d4('s', 'similarity')}, rank from (select *, cast(row_number() over (partition by query_id order by s desc, vec_id) as int) as rank from p where s >= 0.1) where rank <= 5""")
def _(spark, sf_dir):
    kind = F.when(F.col("label") < 6, "reservoir").when(F.col("label") < 9, "app_help")
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("doc_kind", kind)
    asked = F.when(F.col("query_id") % 100 == 0, "reservoir").when(F.col("query_id") % 150 == 0, "app_help")
    queries = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")).withColumn("doc_kind", asked)
    return search.search(vectors, queries, 5, 0.1).select("query_id", "vec_id", r4("similarity"), "rank")


_RETRIEVED = f"""with q as (select vec_id query_id, embedding query, label from embeddings where vec_id % 50 = 0),
p as (select query_id, vec_id, row_number() over (partition by query_id order by list_cosine_similarity(cast(query as double[]), cast(embedding as double[])) desc, vec_id) rank from embeddings cross join q),
r as (select q.query_id, e.vec_id from q join embeddings e on e.label = q.label and e.vec_id <> q.query_id),
f as (select query_id, min(rank) rank from p join r using (query_id, vec_id) where rank <= 10 group by query_id)
select count(*) queries, {d4('avg(case when rank <= 3 then 1.0 else 0.0 end)', 'recall_at_k')}, {d4('avg(coalesce(1.0::double / rank, 0.0))', 'mrr')} from (select distinct query_id from r) left join f using (query_id)"""


@query("k08_retrieval_quality", _RETRIEVED)
@query("k08_retrieval_quality_every_50th", _RETRIEVED)
def _(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    queries = _every_50th(vectors)
    found = search.search(vectors, queries.select("query_id", "query"), 10, -1.0)
    return search.labelled_quality(found, vectors, queries, 3).select("queries", r4("recall_at_k"), r4("mrr"))


@query("q04_turns_after_a_cutoff", "select conv_id, turn, role, text from (select *, row_number() over (partition by conv_id order by turn desc, role, text) rn from conversations where not (conv_id % 5 = 0 and role = 'user') and not (conv_id % 2 = 0 and turn <= 1)) where rn <= 3")
def _(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    deleted = turns.withColumn("deleted_at", F.when((F.col("conv_id") % 5 == 0) & (F.col("role") == "user"), F.current_timestamp()))
    cutoffs = turns.select("conv_id", F.when(F.col("conv_id") % 2 == 0, 1).alias("after"))
    return workflow.recent_turns(deleted, 3, cutoffs).select("conv_id", "turn", "role", "text")


@query("q04_recent_turns", "select conv_id, turn, role, text from (select *, row_number() over (partition by conv_id order by turn desc, role, text) rn from conversations) where rn <= 3")
def _(spark, sf_dir):
    return workflow.recent_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"), 3).select("conv_id", "turn", "role", "text")


def _intent_sql() -> str:
    cases = " ".join("when " + " or ".join("contains(lower(text), '{}')".format(w.replace("'", "''")) for w in words) + f" then '{name}'" for name, words in workflow.INTENTS.items())
    return f"select intent, count(*) n from (select case {cases} else 'explain' end intent from conversations) group by intent"


@query("q07_intents", _intent_sql())
def _(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return turns.groupBy(workflow.intent(F.col("text")).alias("intent")).agg(F.count("*").alias("n"))


def _any(words: list[str]) -> str:
    return "(" + " or ".join("contains(q, '{}')".format(w.replace("'", "''")) for w in words) + ")"


def _total(words: list[str]) -> str:
    return " + ".join("case when contains(q, '{}') then {} else 0 end".format(w.replace("'", "''"), len(w)) for w in dict.fromkeys(words))


_ROUTED = f"""q as (select conv_id, turn, role, coalesce(lower(text), '') q from conversations),
s as (select *, {_total(routing.STATUS)} + case when rtrim(q, '?.! ') like '%how many patterns' then 17 else 0 end status_score, ({_any([p for p in routing.STATUS if 'pattern' in p])} or rtrim(q, '?.! ') like '%how many patterns') counted, {_any(routing.NOT_STATUS)} portfolio from q),
topics as (select * from ({' union all '.join(f"select conv_id, turn, role, q, '{k}' topic, {_total(v)} total, greatest({', '.join(f'case when contains(q, {chr(39)}{w.replace(chr(39), chr(39) * 2)}{chr(39)}) then {len(w)} else 0 end' for w in v)}) longest from q" for k, v in routing.TOPICS.items())}) where total > 0),
best as (select conv_id, turn, role, q, arg_min(topic, (-total, -longest, topic)) topic from topics group by all),
routed as (select s.conv_id, s.turn, s.role, status_score, b.topic, case when status_score > 0 and not (counted and portfolio) then 'status' when {_any(routing.STRONG_HELP).replace('(q,', '(s.q,')} or ({_any(routing.APP_NOUNS).replace('(q,', '(s.q,')} and b.topic is not null) then 'help'
 {' '.join(f"when {_any(v)} then '{k}'".replace('(q,', '(s.q,') for k, v in workflow.INTENTS.items())} else 'explain' end intent from s left join (select distinct on (q) q, topic from best) b on b.q = s.q)"""


@query("r24_routed_questions", f"with {_ROUTED} select conv_id, turn, role, status_score::bigint status_score, topic, intent from routed")
def _(spark, sf_dir):
    x = routing.routed(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"), "text")
    return x.select("conv_id", "turn", "role", "status_score", "topic", "intent")


# what people ask of the system and its screens, each word of a document being the pattern that is asked about
_ASKED = ["how many patterns are loaded? {}", "how do I move the card of {} to the RM zone?", "is {} off target?", "which role can approve {}", "why is {} high", "show me the lineage of {}", "how many patterns in {} are furthest from target", "{}: how many patterns?!"]


@query("r25_help_topics_of_documents", "with conversations as (select doc_id conv_id, 0 turn, '' as role, replace(case doc_id % 8 " + " ".join(f"when {i} then '{q}'" for i, q in enumerate(_ASKED)) + " end, '{}', coalesce(lang, '')) as text from documents), " + f"{_ROUTED} select conv_id doc_id, intent, topic, status_score::bigint status_score from routed")
def _(spark, sf_dir):
    asked = F.element_at(F.array(*map(F.lit, _ASKED)), (F.pmod("doc_id", F.lit(8)) + 1).cast("int"))
    docs = _documents(spark, sf_dir).select("doc_id", F.replace(asked, F.lit("{}"), F.coalesce("lang", F.lit(""))).alias("question"))
    return routing.routed(docs).select("doc_id", "intent", "topic", "status_score")


@query("q06_health", f"with {MONTHLY} select (select count(*) from monthly) monthly_rows, (select count(distinct id_pattern) from monthly) n_patterns, (select count(*) from documents where doc_id % 2 = 0 and length(text) > 0) docs, (select count(*) from documents where doc_id % 2 = 0 and length(text) > 0) chunks, (select count(*) from documents where doc_id % 2 = 1) pending_review")
def _(spark, sf_dir):
    registry = _documents(spark, sf_dir).select("doc_id", "text", F.when(F.col("doc_id") % 2 == 0, "approved").otherwise("pending_review").alias("status"))
    chunks = registry.where("status = 'approved' and length(text) > 0").select("doc_id")
    return knowledge.health(monthly_of(Field(spark, sf_dir)), registry, chunks)


_FIRST = "firsts as (select doc_id, text, doc_id = min(doc_id) over (partition by text) fresh from documents), placed as (select *, coalesce(sum(case when fresh then 1 else 0 end) over (order by doc_id rows between unbounded preceding and 1 preceding), 0) earlier from firsts)"


@query("k10_admitted_uploads", f"with {_FIRST} select doc_id received, case when earlier >= 200 then 'documents are full' when not fresh then 'content is registered already' end reason, earlier < 200 and fresh accepted from placed")
def _(spark, sf_dir):
    uploads = _documents(spark, sf_dir).select(F.col("doc_id").alias("received"), F.col("doc_id").cast("string").alias("file_name"), F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("content"), F.lit("u").alias("uploaded_by"))
    empty = spark.createDataFrame([], "status string, sha256 string")
    return knowledge.registered(empty, uploads).select("received", "reason", "accepted")


@query("k10_reviewed_documents", """with n as (select doc_id, cast(ceil(length(text) / 200.0) as bigint) k from documents where length(text) > 0), x as (select d.doc_id, n.k, d.doc_id % 10 <> 3 ok from documents d left join n using (doc_id)),
b as (select *, coalesce(sum(case when ok then k end) over (order by doc_id rows between unbounded preceding and 1 preceding), 0) before from x)
select doc_id, case when not ok then 'rejected' when k is not null and before < 20000 then 'approved' else 'pending_review' end status, case when ok and k is not null and before >= 20000 then 'chunks are full' when ok and k is null then 'nothing could be ingested' end review_note from b""")
def _(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    registry = docs.select("doc_id", F.lit("pending_review").alias("status"))
    chunks = docs.where("length(text) > 0").select("doc_id", F.explode(F.sequence(F.lit(1), F.ceil(F.length("text") / 200).cast("int"))))
    return knowledge.reviewed(registry, docs.select("doc_id", (F.col("doc_id") % 10 != 3).alias("approve")), chunks)


@query("k04_stored_chunks", """with pieces as (select doc_id, list_filter(list_transform(range(1, length(t) + 1, 200), lambda i: trim(substring(t, i, 200), ' ')), lambda p: p <> '') p from (select doc_id, normalized t from ({0}))) select doc_id, cast(len(p) as bigint) n_chunks from pieces""".replace("{0}", _NORMALIZED))
def _(spark, sf_dir):
    table = knowledge.chunk_table(spark, new_path(spark, "stored-chunks"))
    docs = _documents(spark, sf_dir)
    knowledge.upserted_chunks(table, docs.withColumn("text", F.concat_ws(" ", "text", F.lit("an older state of the document"))), "fixed")
    counters = knowledge.upserted_chunks(table, docs, "fixed")  # every document's chunks in place of those it had
    kept = table.read().groupBy("doc_id").agg(F.count("*").alias("kept"))
    return counters.join(kept, "doc_id", "left").select("doc_id", F.when(F.coalesce("kept", F.lit(0)) == F.col("n_chunks"), F.col("n_chunks")).alias("n_chunks"))


_DELIVERIES = "select user_id id_completion, cast(ts as date) event_date, value oil, event_id from events"


def _deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").cast("long").alias("id_completion"), F.to_date("ts").alias("event_date"), F.col("value").alias("oil"), *[F.lit(0.0).alias(c) for c in intake.VOLUMES[1:]], F.lit("OilField").alias("uom"), F.col("ts").cast("timestamp").alias("emitted_ts"), "event_id")


@query("st06_idempotent_merge", f"with d as ({_DELIVERIES}) select id_completion, event_date, {d4('arg_max(oil, event_id)', 'oil')}, min(event_id) first_order, count(*) n_deliveries from d group by id_completion, event_date")
def _(spark, sf_dir):
    return intake.merged(_deliveries(spark, sf_dir), "event_id").select("id_completion", "event_date", r4("oil"), "first_order", "n_deliveries")


@query("st06_streamed_state", f"with d as ({_DELIVERIES}) select id_completion, event_date, {d4('arg_max(oil, event_id)', 'oil')}, min(event_id) first_order, count(*) n_deliveries from d group by id_completion, event_date")
def _(spark, sf_dir):
    x = _deliveries(spark, sf_dir)
    source, out = new_path(spark, "deliveries"), new_path(spark, "stream-state")
    x.repartition(4, "event_id").write.parquet(source)  # so that a completion's day comes again in later batches
    stream = spark.readStream.schema(x.schema).option("maxFilesPerTrigger", 1).parquet(source)
    intake.stream_to(stream, out, new_path(spark, "stream-checkpoint"), "event_id")
    return VersionedTable(spark, out).read().select("id_completion", "event_date", r4("oil"), "first_order", "n_deliveries")


@query("st07_redeliveries", f"with d as ({_DELIVERIES}) select coalesce(sum(n - 1), 0)::bigint redeliveries from (select count(*) n from d group by id_completion, event_date)")
def _(spark, sf_dir):
    x = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id", F.to_date("ts").alias("d")).agg(F.count("*").alias("n_deliveries"))
    return intake.redeliveries(x)


@query("st_tumbling_windows", f"select date_trunc('day', ts)::timestamp window_start, event_type, count(*) n, {d4('sum(value)', 'total')} from events group by all")
def _(spark, sf_dir):
    return intake.windowed(spark.read.parquet(f"{sf_dir}/events.parquet")).select("window_start", "event_type", "n", r4("total"))


@query("st_sliding_windows", f"select w window_start, w + interval 7 day window_end, event_type, count(*) n, {d4('sum(value)', 'total')} from (select *, unnest(list_transform(range(0, 7), lambda i: date_trunc('day', ts::timestamp) - to_days(i::int))) w from events where ts is not null) group by all")
def _(spark, sf_dir):
    return intake.windowed(spark.read.parquet(f"{sf_dir}/events.parquet"), width="7 days", slide="1 day").select("window_start", "window_end", "event_type", "n", r4("total"))


@query("st_sessions", f"""with e as (select user_id, ts::timestamp ts, value, lag(ts::timestamp) over (partition by user_id order by ts) before from events where ts is not null),
g as (select *, sum(case when before is null or ts >= before + interval 12 hour then 1 else 0 end) over (partition by user_id order by ts rows unbounded preceding) s from e)
select user_id, min(ts) session_start, max(ts) + interval 12 hour session_end, count(*) n, {d4('sum(value)', 'total')} from g group by user_id, s""")
def _(spark, sf_dir):
    return intake.sessions(spark.read.parquet(f"{sf_dir}/events.parquet"), "12 hours").select("user_id", "session_start", "session_end", "n", r4("total"))


# as a stream, in three batches: all events, one more of the last day, and one far behind the watermark, which is left out
@query("st_streamed_windows", f"select * from (select date_trunc('day', ts::timestamp) window_start, event_type, count(*) n, {d4('sum(value)', 'total')} from events group by all) where window_start + interval 1 day <= (select max(ts)::timestamp - interval 7 day from events)")
def _(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    source, out = new_path(spark, "events"), new_path(spark, "windows")
    events.coalesce(1).write.parquet(source)
    for at, kind in ((F.max("ts"), "last"), (F.min("ts"), "late")):
        events.groupBy().agg(at.alias("ts")).select("ts", F.lit(kind).alias("event_type"), F.lit(1.0).alias("value")).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(source)
    intake.stream_windows(intake.windowed(stream), out, new_path(spark, "windows-checkpoint"))
    return spark.read.schema("window_start timestamp, window_end timestamp, event_type string, n long, total double").option("recursiveFileLookup", "true").parquet(out).select("window_start", "event_type", "n", r4("total"))


@query("st04_resume_date", f"with {as_ctes(['volumes'])} select cast(greatest((select max(cast(ts as date)) from events), (select max(prod_date) from volumes)) + 1 as date) resume_date")
def _(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.to_date("ts").alias("event_date"))
    return intake.resume_date(events, Field(spark, sf_dir).volumes)


@query("i18_kafka_rows", """select cast(user_id as varchar) as key, cast(ts as date) event_date, round(value + cast(3.17e-8 as double), 4) + 0.0 oil, count(*) n, user_id is null or ts is null dead from events group by all""")
def _(spark, sf_dir):
    good, dead = intake.parsed(intake.kafka_rows(_deliveries(spark, sf_dir)))
    lost = dead.select("key", F.to_date(F.get_json_object("value", "$.event_date")).alias("event_date"), F.get_json_object("value", "$.oil").cast("double").alias("oil"), F.lit(True).alias("dead"))
    return good.select("key", "event_date", "oil", F.lit(False).alias("dead")).unionByName(lost).groupBy("key", "event_date", r4("oil"), "dead").agg(F.count("*").alias("n"))
