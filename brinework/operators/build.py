"""From raw volumes, allocation, pressures and laboratory tests to completion terms and pattern ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brinework.sources.store import written

PROPERTIES = ["bo", "bw", "bg", "rs", "rv", "bw_inj", "bg_inj"]
VOLUME_COLUMNS = ["oil", "water", "gas", "water_inj", "gas_inj"]
TERMS = ["oil_res", "water_res", "free_gas_res", "water_inj_res", "gas_inj_res"]
#: All that pvt_lookup gives as a method, in order.
METHODS = ["closest", "exact", "extrapolated", "interpolated", "none"]
LOW_CONFIDENCE = ["extrapolated", "closest", "none"]


def with_end_date(df: DataFrame, keys: list[str], start: str, end: str = "end_date") -> DataFrame:
    """Half-open validity windows: each row holds until its key's next one, the last one without end."""
    return df.withColumn(end, F.lead(start).over(Window.partitionBy(*keys).orderBy(start)))


def in_window(date: Column, start: Column, end: Column) -> Column:
    return (date >= start) & (end.isNull() | (date < end))


def clamped_volumes(volumes: DataFrame) -> DataFrame:
    """Null and negative volumes count as zero."""
    return volumes.withColumns({c: F.greatest(F.coalesce(F.col(c), F.lit(0.0)), F.lit(0.0)).cast("double") for c in VOLUME_COLUMNS})


def held_values(needs: DataFrame, readings: DataFrame, key: str, date: str, read_on: str, value: str) -> DataFrame:
    """(key, date, value): for each (key, date) of needs the latest reading on or before the date, null if there is none. Needs and
    readings go through one window in order of their dates, so that no day meets a key's whole history."""
    asked = needs.select(key, F.col(date).alias("at"), F.lit(None).cast(f"struct<v: {dict(readings.dtypes)[value]}>").alias("r"), F.lit(1).alias("asked")).distinct()
    known = readings.select(key, F.col(read_on).alias("at"), F.struct(F.col(value).alias("v")).alias("r"), F.lit(0).alias("asked"))
    by = Window.partitionBy(key).orderBy("at", "asked").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = asked.unionByName(known).withColumn("r", F.last("r", ignorenulls=True).over(by))
    return x.where("asked = 1").select(key, F.col("at").alias(date), F.col("r.v").alias(value))


def volume_context(volumes: DataFrame, factors: DataFrame, patterns: DataFrame, pressures: DataFrame) -> DataFrame:
    """A row for each day, completion and pattern that it is allocated to, with the pressure in force (null if none is yet)."""
    v = clamped_volumes(volumes).withColumnRenamed("prod_date", "vrr_date")
    f = with_end_date(factors, ["id_completion", "id_pattern"], "effect_date", "f_end").withColumnRenamed("effect_date", "factor_effect_date")
    # hash tables of a completion's windows: neither the days nor what they are joined with below are sorted or dealt again
    x = v.join(f.hint("shuffle_hash"), (v["id_completion"] == f["id_completion"]) & in_window(v["vrr_date"], f["factor_effect_date"], f["f_end"])).drop(f["id_completion"])
    # stored, so that Spark knows how small it is: a row for each pattern and day
    held = written(held_values(x, pressures, "id_pattern", "vrr_date", "pressure_date", "pressure"), "pressures")
    x = x.join(patterns.select("id_pattern", "pattern_name"), "id_pattern", "left")
    x = x.join(held, ["id_pattern", "vrr_date"], "left")
    kind = F.when(F.col("oil") + F.col("water") + F.col("gas") > 0, "Production").otherwise("Injection")
    return x.withColumn("amount_type", kind).drop("f_end")


def pvt_windows(pvt: DataFrame) -> DataFrame:
    """For each completion and test the days it applies to, and its points by pressure. The first test also holds before its day."""
    points = F.array_sort(F.collect_list(F.struct("pressure", *PROPERTIES)))
    tests = pvt.groupBy("id_completion", "test_date").agg(points.alias("points"))
    by = Window.partitionBy("id_completion").orderBy("test_date")
    return tests.select("id_completion", "test_date", "points", F.when(F.lag("test_date").over(by).isNotNull(), F.col("test_date")).alias("from_date"), F.lead("test_date").over(by).alias("to_date"))


def _ends(points: Column, t: Column) -> dict[str, Column]:
    """What the points (sorted by pressure) give at t: the method, and the points _a and _b between which is interpolated."""
    lo, up, equal = F.filter(points, lambda p: p["pressure"] < t), F.filter(points, lambda p: p["pressure"] > t), F.filter(points, lambda p: p["pressure"] == t)
    n, m, exact = F.size(lo), F.size(up), F.size(equal) > 0
    method = (
        F.when(points.isNull() | (F.size(points) == 0), "none").when(t.isNull(), "closest").when(exact, "exact")
        .when((n > 0) & (m > 0), "interpolated").when((n > 1) | (m > 1), "extrapolated").otherwise("closest")
    )
    first = F.when(t.isNull(), F.get(points, F.size(points) - 1)).when(exact, F.get(equal, F.lit(0))).when(n > 0, F.get(lo, n - 1)).otherwise(F.get(up, F.lit(0)))
    second = F.when((n > 0) & (m > 0), F.get(up, F.lit(0))).when(n > 1, F.get(lo, n - 2)).when(m > 1, F.get(up, F.lit(1)))
    return {"pvt_method": method, "_a": first, "_b": second}


def _between_ends(x: DataFrame) -> DataFrame:
    """x (pressure, pvt_method, _a, _b) with the properties at the pressure."""
    c, t = F.col, F.col("pressure")
    alone = c("pvt_method").isin("exact", "closest") | (c("_a.pressure") == c("_b.pressure"))
    share = (t - c("_a.pressure")) / F.nullif(c("_b.pressure") - c("_a.pressure"), F.lit(0.0))
    x = x.withColumn("_t", F.when(~alone, share))

    def at(name: str) -> Column:
        value = F.when(c("_t").isNull(), c(f"_a.{name}")).otherwise(c(f"_a.{name}") + c("_t") * (c(f"_b.{name}") - c(f"_a.{name}")))
        return F.when(c("pvt_method") != "none", F.round(value, 5) if name == "bg" else value)

    return x.withColumns({p: at(p) for p in PROPERTIES}).drop("_a", "_b", "_t")


def pvt_lookup(needs: DataFrame) -> DataFrame:
    """needs (points sorted by pressure, pressure, any keys) with pvt_method and the properties at the pressure: exact, interpolated
    between neighbours, extrapolated from the two nearest on one side, closest (one point, or no pressure: the highest point),
    none. bg is rounded to 5 places."""
    return _between_ends(needs.withColumns(_ends(F.col("points"), F.col("pressure"))).drop("points"))


def pvt_stretches(windows: DataFrame) -> DataFrame:
    """For each window (see pvt_windows) the stretches of pressure on which pvt_lookup takes the same points: each point alone, between two,
    below and above all, and no pressure; with what it takes there. So a day's look is a join."""
    q = F.array_sort(F.array_distinct(F.filter(F.transform("points", lambda p: p["pressure"].cast("double")), lambda p: p.isNotNull())))
    none = F.lit(None).cast("double")
    row = lambda eq, lo, hi, at, missing=False: F.struct(eq.alias("eq"), lo.alias("lo"), hi.alias("hi"), at.alias("at"), F.lit(missing).alias("missing"))
    x = windows.withColumn("q", q)
    n, first, last = F.size("q"), F.get("q", F.lit(0)), F.get("q", F.size("q") - 1)
    points = F.transform("q", lambda p: row(p, none, none, p))
    gaps = F.filter(F.transform("q", lambda p, i: row(none, p, F.get("q", i + 1), p / 2 + F.get("q", i + 1) / 2)), lambda s: s["hi"].isNotNull())
    outer = F.array(row(none, none, first, F.lit(float("-inf"))), row(none, last, none, F.lit(float("inf"))))
    some = F.when(n > 0, F.concat(points, gaps, outer)).otherwise(F.array(row(none, none, none, F.lit(0.0))))
    x = x.select(*windows.columns, F.explode(F.concat(some, F.array(row(none, none, none, none, True)))).alias("s"))
    return x.withColumns(_ends(F.col("points"), F.col("s.at"))).select(*[c for c in windows.columns if c != "points"], "s.eq", "s.lo", "s.hi", "s.missing", "pvt_method", "_a", "_b")


def reservoir_terms(gas_multiplier: Column | None = None) -> dict[str, Column]:
    """The five reservoir volumes of a row. A missing factor makes its term 0; free gas is null unless an oil producer has rs and bg."""
    c, zero = F.col, F.lit(0.0)
    mult = F.lit(1000.0) if gas_multiplier is None else gas_multiplier
    free = c("factor") * (c("gas") * mult - c("rs") * c("oil")) * c("bg")
    return {
        "oil_res": F.coalesce(c("factor") * c("oil") * c("bo"), zero),
        "water_res": F.coalesce(c("factor") * c("water") * c("bw"), zero),
        "free_gas_res": F.when((c("amount_type") == "Production") & (c("oil") > 0) & c("rs").isNotNull() & c("bg").isNotNull(), free),
        "water_inj_res": F.coalesce(c("factor") * c("water_inj") * c("bw_inj"), zero),
        "gas_inj_res": F.coalesce(c("factor") * c("gas_inj") * mult * c("bg_inj"), zero),
    }


def unit_multiplier(uom: Column) -> Column:
    """Standard cubic feet in a unit of gas volume: 1 for Metric, 1000 for anything else or none."""
    return F.when(F.coalesce(uom, F.lit("OilField")) == "Metric", 1.0).otherwise(1000.0)


def completion_contrib(volumes: DataFrame, factors: DataFrame, patterns: DataFrame, pressures: DataFrame, pvt: DataFrame) -> DataFrame:
    """The lineage layer: every input, the PVT method, the volume factors and the five terms of each day, completion and pattern."""
    x = volume_context(volumes, factors, patterns, pressures)
    w = pvt_stretches(pvt_windows(pvt)).withColumnRenamed("id_completion", "w_completion")
    applies = (F.col("from_date").isNull() | (x["vrr_date"] >= F.col("from_date"))) & (F.col("to_date").isNull() | (x["vrr_date"] < F.col("to_date")))
    t, inside = x["pressure"], (F.col("lo").isNull() | (x["pressure"] > F.col("lo"))) & (F.col("hi").isNull() | (x["pressure"] < F.col("hi")))
    applies = applies & F.when(t.isNull(), F.col("missing")).otherwise(~F.col("missing") & ((t == F.col("eq")) | (F.col("eq").isNull() & inside)))
    # by completion alone, as all rows lie: bringing back looks for each pressure would deal all rows out anew
    x = x.join(w.hint("shuffle_hash"), (x["id_completion"] == w["w_completion"]) & applies, "left").drop("w_completion", "from_date", "to_date", "eq", "lo", "hi", "missing")
    x = _between_ends(x.withColumn("pvt_method", F.coalesce("pvt_method", F.lit("none"))))
    mult = unit_multiplier(F.col("uom")) if "uom" in volumes.columns else None
    x = x.select("id_pattern", "pattern_name", "id_completion", "vrr_date", "amount_type", "factor", "factor_effect_date", "pressure", *VOLUME_COLUMNS, "pvt_method", F.col("test_date").alias("pvt_test_date"), *PROPERTIES, *(["uom"] if mult is not None else []))
    return x.withColumns(reservoir_terms(mult))


def contrib_of(field) -> DataFrame:
    return completion_contrib(field.volumes, field.factors, field.pattern, field.pressures, field.pvt)


_WEIGHTS = {"bo": "oil", "bw": "water", "bg": "gas", "bw_inj": "water_inj", "bg_inj": "gas_inj", "rs": "oil", "rv": "gas"}


def _day_sums(contrib: DataFrame) -> DataFrame:
    """A row for each pattern and day with what both grains are sums of. Names, which no hash table can hold as values, are keys."""
    parts = {**{c: F.sum(c) for c in VOLUME_COLUMNS + TERMS}, "pressure": F.sum("pressure"), "n_pressure": F.count("pressure")}
    parts |= {"prod_res": F.sum(F.col("oil_res") + F.col("water_res") + F.coalesce("free_gas_res", F.lit(0.0))), "inj_res": F.sum(F.col("water_inj_res") + F.col("gas_inj_res"))}
    parts |= {k: F.sum(F.col(k) * F.col(w)) for k, w in _WEIGHTS.items()} | {"any_extrapolated": F.bool_or(F.col("pvt_method").isin(LOW_CONFIDENCE))}
    return contrib.groupBy("id_pattern", "pattern_name", "vrr_date").agg(*[x.alias(k) for k, x in parts.items()])


def _day_completions(contrib: DataFrame) -> DataFrame:
    """The distinct (id_pattern, id_completion, vrr_date), dealt by the first two, so that months can be counted where the days are."""
    return contrib.select("id_pattern", "id_completion", "vrr_date").repartition("id_pattern", "id_completion").distinct()


def _of_grain(days: DataFrame, completions: DataFrame, grain: str) -> DataFrame:
    period = F.trunc("vrr_date", "MM") if grain == "monthly" else F.col("vrr_date")
    sums = [*VOLUME_COLUMNS, *TERMS, "prod_res", "inj_res", *_WEIGHTS]
    out = days.groupBy("id_pattern", period.alias("vrr_date")).agg(
        F.max("pattern_name").alias("pattern_name"), (F.sum("pressure") / F.nullif(F.sum("n_pressure"), F.lit(0))).alias("pressure"), *[F.sum(c).alias(c) for c in sums], F.bool_or("any_extrapolated").alias("any_extrapolated"),
    )
    out = out.where((F.coalesce("oil_res", F.lit(0.0)) + F.coalesce("water_res", F.lit(0.0)) != 0) | (F.col("water_inj") + F.col("gas_inj") > 0))
    seen = completions.select("id_pattern", "id_completion", period.alias("vrr_date"))
    seen = (seen.distinct() if grain == "monthly" else seen).groupBy("id_pattern", "vrr_date").agg(F.count("id_completion").alias("n_completions"))
    out = out.join(seen, out["id_pattern"].eqNullSafe(seen["id_pattern"]) & out["vrr_date"].eqNullSafe(seen["vrr_date"])).drop(seen["id_pattern"], seen["vrr_date"])
    ratio = F.coalesce(F.col("inj_res") / F.nullif(F.col("prod_res"), F.lit(0.0)), F.lit(0.0))
    alias = F.concat(F.col("id_pattern").cast("string"), F.lit("_M" if grain == "monthly" else "_D"))
    return out.select(
        "id_pattern", "vrr_date", "pattern_name", "pressure", *VOLUME_COLUMNS, *TERMS, "prod_res", "inj_res", *[(F.col(k) / F.nullif(F.col(w), F.lit(0.0))).alias(k) for k, w in _WEIGHTS.items()],
        "n_completions", "any_extrapolated", ratio.alias("vrr"), F.lit(grain).alias("grain"), alias.alias("id_alias"),
    )


def pattern_vrr(contrib: DataFrame, grain: str = "monthly") -> DataFrame:
    """Totals, ratio and volume-weighted factors of each pattern and period. Periods without any production or injection go."""
    return _of_grain(_day_sums(contrib), _day_completions(contrib), grain)


def both_grains(contrib: DataFrame) -> DataFrame:
    """pattern_vrr of months and of days, from one pass over the rows: the sums of days are stored in between."""
    days, seen = written(_day_sums(contrib), "day-sums"), _day_completions(contrib)
    return _of_grain(days, seen, "monthly").unionByName(_of_grain(days, seen, "daily"))


def methods_of(column: str = "pvt_method") -> Column:
    """Aggregate: the distinct methods of the rows, in order, as array. Of the known ones, as bits, which a hash table can hold."""
    bit = F.lit(0)
    for i, m in enumerate(METHODS):
        bit = F.when(F.col(column) == m, 1 << i).otherwise(bit)
    bits = F.bit_or(bit)
    return F.filter(F.array(*[F.when(bits.bitwiseAND(F.lit(1 << i)) != 0, m) for i, m in enumerate(METHODS)]), lambda m: m.isNotNull())


class Curated:
    """The stored tables of a build: contrib (lineage rows), pattern (both grains), cumulative; monthly is one grain of pattern."""

    def __init__(self, spark, path: str):
        self.path = path
        self.contrib, self.pattern, self.cumulative = (spark.read.parquet(f"{path}/{t}").drop("month") for t in ("completion_contrib", "pattern_vrr", "pattern_vrr_cumulative"))
        self.monthly = self.pattern.where("grain = 'monthly'")


def _put(rows: DataFrame, path: str, run_id: str, by: list[str], months: bool) -> None:
    """Writes rows of days over the partitions that they belong to (all of the table, where it is new)."""
    rows = rows.withColumn("run_id", F.lit(run_id))
    if months:
        rows = rows.withColumn("month", F.trunc("vrr_date", "MM")).hint("rebalance", "month")
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if months else "static")
    by = [*by, *(["month"] if months else [])]
    (writer.partitionBy(*by) if by else writer).parquet(path)


def _stored_tables(spark, field, path: str, run_id: str, months: bool) -> Curated:
    _put(contrib_of(field), f"{path}/completion_contrib", run_id, [], months)
    contrib = spark.read.parquet(f"{path}/completion_contrib").drop("month")
    _put(both_grains(contrib), f"{path}/pattern_vrr", run_id, ["grain"], months)
    _put(cumulative(spark.read.parquet(f"{path}/pattern_vrr")), f"{path}/pattern_vrr_cumulative", run_id, ["grain"], months)
    return Curated(spark, path)


def store(field, path: str, run_id: str, months: bool = False) -> Curated:
    """Builds the curated tables of a field and writes them over what is at path, each row with the run's id. The lineage layer is
    computed once; the other tables are made from what was written. months: the tables are kept by month, so that rebuilt() can
    bring them up to date; path must then be new."""
    return _stored_tables(field.spark, field, path, run_id, months)


def rebuilt(field, path: str, days: DataFrame, run_id: str) -> Curated:
    """Brings a build that is kept by month up to date with volumes of days (id_completion, prod_date) that have come or changed. Only
    the months of those days are computed anew from the raw tables, and the cumulative rows from the first of them on, which
    go on from the last ones before; files of other months stay as they are. Done twice it gives the same; if it
    is broken off it must be done again, as the tables are written one after the other."""
    spark = field.spark
    months = [r[0] for r in days.select(F.trunc("prod_date", "MM").alias("m")).where("m is not null").distinct().orderBy("m").collect()]  # one row a month
    if not months:
        return Curated(spark, path)
    touched = F.lit(False)
    for m in months:  # bounds of days, which reach the scan
        touched = touched | ((F.col("prod_date") >= F.lit(m)) & (F.col("prod_date") < F.add_months(F.lit(m), 1)))
    part = completion_contrib(field.volumes.where(touched), field.factors, field.pattern, field.pressures, field.pvt)
    _replace(part, f"{path}/completion_contrib", run_id, [], months)
    contrib = spark.read.parquet(f"{path}/completion_contrib").where(F.col("month").isin(months)).drop("month")
    _replace(both_grains(contrib), f"{path}/pattern_vrr", run_id, ["grain"], months)
    pattern = spark.read.parquet(f"{path}/pattern_vrr")
    before = spark.read.parquet(f"{path}/pattern_vrr_cumulative").where(F.col("month") < F.lit(months[0]))
    sums = [f"cum_{c}" for c in CUMULATED]
    last = before.groupBy("id_pattern", "grain").agg(F.max_by(F.struct(*sums), "vrr_date").alias("b"), F.max("vrr_date").alias("vrr_date"))
    # the last row before stands for all that came before it
    start = last.select("id_pattern", "vrr_date", "grain", *[F.col(f"b.cum_{c}").alias(c) for c in CUMULATED])
    rows = pattern.where(F.col("month") >= F.lit(months[0])).select("id_pattern", "vrr_date", "grain", *CUMULATED)
    again = written(cumulative(start.unionByName(rows)).where(F.col("vrr_date") >= F.lit(months[0])), "cumulative")
    later = [r[0] for r in pattern.where(F.col("month") >= F.lit(months[0])).select("month").distinct().collect()]
    _replace(again, f"{path}/pattern_vrr_cumulative", run_id, ["grain"], sorted({*later, *months}))
    return Curated(spark, path)


def _replace(rows: DataFrame, path: str, run_id: str, by: list[str], months: list) -> None:
    """Writes the months' rows; a month that has none any more loses its folder."""
    spark, rows = rows.sparkSession, written(rows, "months")
    _put(rows, path, run_id, by, True)
    there = {(r["month"], *(r[c] for c in by)) for r in rows.withColumn("month", F.trunc("vrr_date", "MM")).select("month", *by).distinct().collect()}
    for grain in ["monthly", "daily"] if by else [None]:
        for m in months:
            if (m, *([grain] if by else [])) not in there:
                folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/" + (f"grain={grain}/" if by else "") + f"month={m}")
                folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


CUMULATED = ["oil_res", "water_res", "water_inj_res", "gas_inj_res", "prod_res", "inj_res"]


def cumulative(pattern: DataFrame) -> DataFrame:
    """Running sums of each pattern and grain, and the ratio of the running sums."""
    w = Window.partitionBy("id_pattern", "grain").orderBy("vrr_date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = {f"cum_{c}": F.sum(c).over(w) for c in CUMULATED}
    out = pattern.select("id_pattern", "vrr_date", "grain", *[x.alias(k) for k, x in sums.items()])
    return out.withColumn("cum_vrr", F.coalesce(F.col("cum_inj_res") / F.nullif(F.col("cum_prod_res"), F.lit(0.0)), F.lit(0.0)))
