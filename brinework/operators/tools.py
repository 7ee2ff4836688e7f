"""Queries of the analyst's tools, for all patterns at once; filters narrow them to one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brinework.operators.build import methods_of, with_end_date
from brinework.operators.rules import with_bands



def resolve(patterns: DataFrame, asked: str) -> DataFrame:
    """The pattern with this id or name (any case), else the only one whose id begins with it (six characters at least)."""
    text = asked.strip()
    exact = patterns.where((F.col("id_pattern").cast("string") == text) | (F.upper("pattern_name") == text.upper()))
    if len(text) < 6:
        return exact
    begun = patterns.where(F.col("id_pattern").cast("string").startswith(text))
    prefix = begun.crossJoin(F.broadcast(begun.agg(F.count("*").alias("n")))).where("n = 1").drop("n")  # one row
    return exact.unionByName(prefix.join(exact.limit(1).select(F.lit(1).alias("one")), F.lit(True), "left_anti"))


def list_patterns(monthly: DataFrame) -> DataFrame:
    return monthly.groupBy("id_pattern", "pattern_name").agg(F.count("*").alias("n_periods"), F.max("vrr_date").alias("last_date"))


def latest(monthly: DataFrame) -> DataFrame:
    """Each pattern's latest row."""
    by = Window.partitionBy("id_pattern").orderBy(F.col("vrr_date").desc())
    return monthly.withColumn("_rn", F.row_number().over(by)).where("_rn = 1").drop("_rn")


def overview(monthly: DataFrame, targets: DataFrame, memory: DataFrame, limit: int = 50) -> DataFrame:
    """The latest month of each pattern by its distance from the target (1 if it has none), furthest first."""
    x = latest(monthly).join(targets, "id_pattern", "left").withColumn("target_vrr", F.coalesce("target_vrr", F.lit(1.0)))
    x = x.join(with_bands(monthly, memory), "id_pattern").withColumn("drift", F.abs(F.col("vrr") - F.col("target_vrr")))
    side = F.when(F.col("vrr") > F.col("band_high"), "above band").when(F.col("vrr") < F.col("band_low"), "below band").otherwise("in band")
    return x.select("id_pattern", "pattern_name", "vrr_date", "vrr", "target_vrr", "drift", side.alias("verdict"), "any_extrapolated").orderBy(F.col("drift").desc(), "id_pattern").limit(limit)


def trend(pattern: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows between two dates, both included."""
    out = pattern
    if start:
        out = out.where(F.col("vrr_date") >= F.lit(start).cast("date"))
    if end:
        out = out.where(F.col("vrr_date") <= F.lit(end).cast("date"))
    return out


def term_totals(contrib: DataFrame) -> DataFrame:
    terms = ["oil_res", "water_res", "free_gas_res", "water_inj_res", "gas_inj_res"]
    return contrib.groupBy("id_pattern", F.trunc("vrr_date", "MM").alias("vrr_date")).agg(*[F.coalesce(F.sum(t), F.lit(0.0)).alias(t) for t in terms])


def completions(contrib: DataFrame) -> DataFrame:
    """Each completion of a pattern month: volumes, terms, the role it played and its shares."""
    free = F.coalesce("free_gas_res", F.lit(0.0))
    x = contrib.groupBy("id_pattern", F.trunc("vrr_date", "MM").alias("vrr_date"), "id_completion").agg(
        F.count("*").alias("n_days"), F.avg("factor").alias("factor"), F.array_join(methods_of(), ",").alias("pvt_methods"),
        F.min("pressure").alias("min_pressure"), F.max("pressure").alias("max_pressure"),
        F.sum(F.col("oil_res") + F.col("water_res") + free).alias("prod_res"), F.sum(F.col("water_inj_res") + F.col("gas_inj_res")).alias("inj_res"),
    )
    by = Window.partitionBy("id_pattern", "vrr_date")
    share = lambda c: F.coalesce(F.col(c) / F.nullif(F.sum(c).over(by), F.lit(0.0)), F.lit(0.0))
    role = F.when(F.col("inj_res") > F.col("prod_res"), "injector").when(F.col("prod_res") > 0, "producer").otherwise("idle")
    return x.withColumns({"role": role, "share_of_production": share("prod_res"), "share_of_injection": share("inj_res")})


def lineage(contrib: DataFrame) -> DataFrame:
    """Of each pattern month: completions, allocation (least, most, weighted by reservoir volume), and the ratio from its terms."""
    c = completions(contrib)
    size = F.col("prod_res") + F.col("inj_res")
    return c.groupBy("id_pattern", "vrr_date").agg(
        F.count("*").alias("n_completions"), F.min("factor").alias("min_factor"), F.max("factor").alias("max_factor"),
        (F.sum(F.col("factor") * size) / F.nullif(F.sum(size), F.lit(0.0))).alias("weighted_factor"), (F.sum("inj_res") / F.nullif(F.sum("prod_res"), F.lit(0.0))).alias("vrr"),
    )


# What each term is the product of.
FORMULAS = {
    "oil_res": "factor x oil x bo", "water_res": "factor x water x bw", "free_gas_res": "factor x (gas x 1000 - rs x oil) x bg, of producers with oil", "water_inj_res": "factor x water_inj x bw_inj",
    "gas_inj_res": "factor x gas_inj x 1000 x bg_inj", "vrr": "injected reservoir volume / produced reservoir volume, 0 without production",
}
_VOLUMES, _TERMS = ["oil", "water", "gas", "water_inj", "gas_inj"], ["oil_res", "water_res", "free_gas_res", "water_inj_res", "gas_inj_res"]


def lineage_rows(contrib: DataFrame) -> DataFrame:
    """What each completion gave to a pattern month: days, pressures, fluid property methods, mean factor, volumes and reservoir terms."""
    sums = [F.sum(F.coalesce(c, F.lit(0.0))).alias(c) for c in (*_VOLUMES, *_TERMS)]
    return contrib.groupBy("id_pattern", F.trunc("vrr_date", "MM").alias("vrr_date"), "id_completion").agg(
        F.count("*").alias("n_days"), F.min("pressure").alias("min_pressure"), F.max("pressure").alias("max_pressure"), F.array_join(methods_of(), ",").alias("pvt_methods"), F.avg("factor").alias("factor"), *sums,
    )


def lineage_detail(contrib: DataFrame, monthly: DataFrame) -> DataFrame:
    """A row for each pattern month: what is stored (stored_vrr), the totals of the terms and volumes, the ratio recomputed from them (null
    without production), the allocation (number, least, most, mean weighted by reservoir volume), the rows of its completions in order, and
    the formulas."""
    rows = lineage_rows(contrib)
    names = ["id_completion", "n_days", "min_pressure", "max_pressure", "pvt_methods", "factor", *_VOLUMES, *_TERMS]
    size = sum((F.col(t) for t in _TERMS[1:]), F.col(_TERMS[0]))
    x = rows.groupBy("id_pattern", "vrr_date").agg(
        *[F.sum(c).alias(c) for c in (*_VOLUMES, *_TERMS)], F.count("factor").alias("n_factors"), F.min("factor").alias("min_factor"), F.max("factor").alias("max_factor"),
        (F.sum(F.col("factor") * size) / F.nullif(F.sum(size), F.lit(0.0))).alias("weighted_factor"), F.array_sort(F.collect_list(F.struct(*names))).alias("completions"),
    )
    x = x.withColumn("prod_res", F.col("oil_res") + F.col("water_res") + F.col("free_gas_res")).withColumn("inj_res", F.col("water_inj_res") + F.col("gas_inj_res"))
    x = x.withColumn("recomputed_vrr", F.col("inj_res") / F.nullif(F.col("prod_res"), F.lit(0.0))).withColumn("formulas", F.create_map(*[F.lit(v) for kv in FORMULAS.items() for v in kv]))
    return x.join(monthly.select("id_pattern", "vrr_date", "pattern_name", F.col("vrr").alias("stored_vrr")), ["id_pattern", "vrr_date"], "left")


def one_month(monthly: DataFrame, date: str, patterns: list | None = None) -> DataFrame:
    """The rows of one month, of all patterns or of those named."""
    out = monthly.where(F.col("vrr_date") == F.lit(date).cast("date"))
    return out.where(F.col("id_pattern").isin(patterns)) if patterns is not None else out


def audit(monthly: DataFrame, recomputed: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Stored ratios beside those from an independent run over the raw tables; matches is false where either is undefined."""
    again = recomputed.select("id_pattern", "vrr_date", (F.col("inj_res") / F.nullif(F.col("prod_res"), F.lit(0.0))).alias("recomputed_vrr"))
    x = monthly.select("id_pattern", "vrr_date", F.col("vrr").alias("stored_vrr")).join(again, ["id_pattern", "vrr_date"], "left")
    x = x.withColumn("difference", F.col("recomputed_vrr") - F.col("stored_vrr"))
    return x.withColumn("matches", F.coalesce(F.abs("difference") <= tolerance, F.lit(False)))


def data_quality(volumes: DataFrame, factors: DataFrame, patterns: DataFrame, pressures: DataFrame, pvt: DataFrame, registered: DataFrame) -> dict[str, DataFrame]:
    """The six checks, each with the keys that fail it."""
    v, f = volumes.select("id_completion").distinct(), factors.select("id_completion").distinct()
    over = factors.groupBy("id_completion", "effect_date").agg(F.sum("factor").alias("total")).where("total > 1.0001")
    key = lambda df, c: df.select(F.col(c).cast("string").alias("key"))
    return {
        "factor_sum_over_one": over.select(F.concat_ws("|", F.col("id_completion").cast("string"), F.col("effect_date").cast("string")).alias("key")),
        "volumes_without_allocation": key(v.join(f, "id_completion", "left_anti"), "id_completion"),
        "allocation_without_volumes": key(f.join(v, "id_completion", "left_anti"), "id_completion"),
        "patterns_without_pressure": key(factors.select("id_pattern").distinct().join(pressures.select("id_pattern").distinct(), "id_pattern", "left_anti"), "id_pattern"),
        "completions_without_pvt": key(v.join(pvt.select("id_completion").distinct(), "id_completion", "left_anti"), "id_completion"),
        "unregistered_completions": key(v.join(registered.select("id_completion").distinct(), "id_completion", "left_anti"), "id_completion"),
    }


def over_allocated(factors: DataFrame, most: float = 1.0001) -> DataFrame:
    """(id_completion, from_date, until_date, most_allocated): the stretches of days on which the windows in force, whatever day each
    began, allocate more than `most` of a completion in all; until_date is null where the last one has no end. Windows' starts and
    ends are steps up and down, summed in order of their days, so no day and no pair of windows is made."""
    w = with_end_date(factors, ["id_completion", "id_pattern"], "effect_date", "f_end")
    steps = w.select("id_completion", F.col("effect_date").alias("at"), F.col("factor").alias("step"))
    steps = steps.unionByName(w.where("f_end is not null").select("id_completion", F.col("f_end").alias("at"), (-F.col("factor")).alias("step")))
    by = Window.partitionBy("id_completion").orderBy("at")
    x = steps.groupBy("id_completion", "at").agg(F.sum("step").alias("step"))
    x = x.withColumn("total", F.round(F.sum("step").over(by), 9)).withColumn("until", F.lead("at").over(by)).withColumn("over", F.col("total") > most)
    x = x.withColumn("stretch", F.sum(F.when(F.col("over") == F.lag("over").over(by), 0).otherwise(1)).over(by)).where("over")
    return x.groupBy("id_completion", "stretch").agg(F.min("at").alias("from_date"), F.max_by("until", "at").alias("until_date"), F.max("total").alias("most_allocated")).drop("stretch")


def quality_report(checks: dict[str, DataFrame], limit: int | None = None) -> DataFrame:
    out = None
    for name, df in checks.items():
        rows = (df.orderBy("key").limit(limit) if limit else df).select(F.lit(name).alias("check_name"), "key")
        out = rows if out is None else out.unionByName(rows)
    return out


def lanes(queue: DataFrame, stages: list[str]) -> DataFrame:
    """A count for each stage, those without rows among them."""
    every = queue.sparkSession.createDataFrame([(i, s) for i, s in enumerate(stages)], "ordinal int, stage string")
    return every.join(queue.groupBy("stage").agg(F.count("*").alias("n")), "stage", "left").select("ordinal", "stage", F.coalesce("n", F.lit(0)).alias("n"))


def pattern_context(patterns: DataFrame, targets: DataFrame, memory: DataFrame, adjustments: DataFrame, limits: DataFrame, newest: int = 20) -> DataFrame:
    """For each pattern its target (1 if it has none), learned memory, the tightest limit, and its newest adjustments, newest first."""
    by = Window.partitionBy("id_pattern").orderBy(F.col("ts").desc(), F.col("action_id").desc())
    last = adjustments.withColumn("n", F.row_number().over(by)).where(F.col("n") <= newest)
    last = last.groupBy("id_pattern").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "action_id", "outcome"))), lambda a: a["action_id"]).alias("adjustments"))
    cap = limits.agg(F.min("max_inj_rate_change_pct").alias("max_change"))
    x = patterns.select("id_pattern", "pattern_name").join(targets, "id_pattern", "left").join(memory, "id_pattern", "left").join(last, "id_pattern", "left")
    return x.crossJoin(F.broadcast(cap)).withColumn("target_vrr", F.coalesce("target_vrr", F.lit(1.0)))  # one row


def refreshed_memory(memory: DataFrame, monthly: DataFrame) -> DataFrame:
    """The memory with each pattern's latest monthly ratio and its month."""
    now = monthly.groupBy("id_pattern").agg(F.max_by(F.struct("vrr_date", "vrr"), "vrr_date").alias("l"))
    return memory.join(now, "id_pattern", "left").select(*[memory[c] for c in memory.columns], F.col("l.vrr").alias("latest_vrr"), F.col("l.vrr_date").alias("latest_date"))
