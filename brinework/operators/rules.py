"""Deterministic rules over pattern periods: attribution of changes, anomalies, input audit, bounded recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brinework.functions.scalars import log_mean, same
from brinework.operators.build import LOW_CONFIDENCE, methods_of

INJECTION, PRODUCTION = ["water_inj_res", "gas_inj_res"], ["oil_res", "water_res", "free_gas_res"]
#: The default band, drift and target tolerance, recommendation limits, learning, audit tolerances.
BAND, DRIFT_PERIODS, DRIFT_TOTAL, ON_TARGET, MAX_CHANGE = (0.9, 1.1), 3, 0.10, 0.02, 0.15
ALPHA, RATIO_RANGE, RHO_RANGE = 0.3, (0.2, 5.0), (0.3, 3.0)
RECOMPUTE_TOLERANCE, STALE_DAYS = 1e-6, 1095


def _sum(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out + c
    return out


def month_pairs(monthly: DataFrame) -> DataFrame:
    """Each pattern month beside its previous calendar month, where that exists: terms with suffixes _a (before) and _b."""
    terms = INJECTION + PRODUCTION
    b = monthly.select("id_pattern", "vrr_date", *[F.coalesce(t, F.lit(0.0)).alias(f"{t}_b") for t in terms])
    a = monthly.select("id_pattern", F.add_months("vrr_date", 1).alias("vrr_date"), *[F.coalesce(t, F.lit(0.0)).alias(f"{t}_a") for t in terms])
    return b.join(a, ["id_pattern", "vrr_date"])


def decompose(pairs: DataFrame) -> DataFrame:
    """Exact attribution of the change of the ratio to its five terms.

    The change is split between injection and production by the logarithmic mean of the two ratios, and within a side by
    logarithmic means of its terms (lmdi); where a term or total is not positive, in proportion to the terms' changes
    (share_of_change), or not at all (no_change: totals that are the same but for the order of summing). Contributions sum to the change. Rows without production go.
    """
    c = F.col
    x = pairs
    for s in "ab":
        x = x.withColumn(f"inj_{s}", _sum([c(f"{t}_{s}") for t in INJECTION])).withColumn(f"prod_{s}", _sum([c(f"{t}_{s}") for t in PRODUCTION]))
    x = x.where((c("prod_a") > 0) & (c("prod_b") > 0))
    x = x.withColumn("vrr_a", c("inj_a") / c("prod_a")).withColumn("vrr_b", c("inj_b") / c("prod_b")).withColumn("d_vrr", c("vrr_b") - c("vrr_a"))
    mean = log_mean(c("vrr_a"), c("vrr_b"))
    mean = F.when(mean == 0, c("vrr_a")).otherwise(mean)
    both = (c("inj_a") > 0) & (c("inj_b") > 0)
    x = x.withColumn("inj_side", F.when(both, mean * F.ln(F.when(both, c("inj_b") / c("inj_a")))).when(same(c("prod_a"), c("prod_b")), c("d_vrr")).otherwise(0.0))
    x = x.withColumn("prod_side", c("d_vrr") - c("inj_side"))
    for side, terms, name in (("inj", INJECTION, "injection"), ("prod", PRODUCTION, "production")):
        ta, tb = c(f"{side}_a"), c(f"{side}_b")
        positive = (ta > 0) & (tb > 0) & ~same(ta, tb)
        for t in terms:
            positive = positive & (c(f"{t}_a") > 0) & (c(f"{t}_b") > 0)
        x = x.withColumn(f"{name}_method", F.when(positive, "lmdi").when(same(ta, tb), "no_change").otherwise("share_of_change"))
        for t in terms:
            a, b = c(f"{t}_a"), c(f"{t}_b")
            share = log_mean(a, b) / F.nullif(log_mean(ta, tb), F.lit(0.0)) * F.ln(F.when(positive, b / F.nullif(a, F.lit(0.0)))) / F.nullif(F.ln(F.when(positive, tb / ta)), F.lit(0.0))
            part = F.when(positive, share).when(same(ta, tb), 0.0).otherwise((b - a) / F.nullif(tb - ta, F.lit(0.0)))
            x = x.withColumn(f"c_{t}", c(f"{side}_side") * part)
    return x


def drivers(decomposed: DataFrame) -> DataFrame:
    """A row for each term, ranked by the size of its contribution (ties: injection terms first)."""
    terms = INJECTION + PRODUCTION
    each = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(t).alias("term"), F.col(f"c_{t}").alias("contribution"), (F.col(f"{t}_b") - F.col(f"{t}_a")).alias("delta")) for i, t in enumerate(terms)])
    x = decomposed.select("id_pattern", "vrr_date", F.inline(each))
    by = Window.partitionBy("id_pattern", "vrr_date")
    total = F.sum(F.abs("contribution")).over(by)
    x = x.withColumn("share", F.abs("contribution") / F.when(total == 0, 1.0).otherwise(total))
    x = x.withColumn("rank", F.row_number().over(by.orderBy(F.abs("contribution").desc(), "ordinal")))
    return x.withColumn("direction", F.when(F.col("contribution") > 0, "increased VRR").otherwise("decreased VRR"))


def with_bands(patterns: DataFrame, memory: DataFrame, together: bool = False) -> DataFrame:
    """(id_pattern, band_low, band_high): the learned band; a bound that is missing or 0 is the default's. together: where either is
    missing or 0, both are."""
    there = {k: F.coalesce(F.col(k), F.lit(0.0)) != 0 for k in ("band_low", "band_high")}
    both = there["band_low"] & there["band_high"]
    low, high = (F.when(both if together else there[k], F.col(k)).otherwise(d).alias(k) for k, d in zip(there, BAND, strict=True))
    return patterns.select("id_pattern").distinct().join(memory.select("id_pattern", "band_low", "band_high"), "id_pattern", "left").select("id_pattern", low, high)


def trailing_runs(monthly: DataFrame) -> DataFrame:
    """(id_pattern, run, total): the consecutive moves of one sign that end at each pattern's latest row; a move of 0 ends a run."""
    by = Window.partitionBy("id_pattern").orderBy("vrr_date")
    back = Window.partitionBy("id_pattern").orderBy(F.col("vrr_date").desc())
    x = monthly.where("vrr is not null").withColumn("move", F.col("vrr") - F.lag("vrr").over(by)).where("move is not null")
    x = x.withColumn("rn", F.row_number().over(back)).withColumn("sign", F.signum("move")).withColumn("last_sign", F.first("sign").over(back))
    ended = F.max(F.when((F.col("sign") != F.col("last_sign")) | (F.col("sign") == 0), 1).otherwise(0)).over(back)
    return x.withColumn("ended", ended).where("ended = 0").groupBy("id_pattern").agg(F.count("*").alias("run"), F.sum("move").alias("total"))


def detect_anomalies(monthly: DataFrame, memory: DataFrame) -> DataFrame:
    """(id_pattern, vrr_date, kind, severity, vrr, actionable) for each pattern's latest month: extrapolated inputs, out of band,
    sustained drift. Nothing is actionable on extrapolated inputs."""
    rows = monthly.where("vrr is not null")
    latest = rows.groupBy("id_pattern").agg(F.max_by(F.struct("vrr_date", "vrr", "any_extrapolated"), "vrr_date").alias("r")).select("id_pattern", "r.*")
    return _found(latest.join(with_bands(latest, memory, together=True), "id_pattern").join(trailing_runs(monthly), "id_pattern", "left"))


def runs_at(monthly: DataFrame) -> DataFrame:
    """(id_pattern, vrr_date, run, total): at each month the consecutive moves of one sign that end there; 0 after a move of 0."""
    by = Window.partitionBy("id_pattern").orderBy("vrr_date")
    x = monthly.where("vrr is not null").select("id_pattern", "vrr_date", (F.col("vrr") - F.lag("vrr").over(by)).alias("move")).withColumn("sign", F.signum("move"))
    x = x.withColumn("breaks", F.sum(F.when(F.col("sign") == F.lag("sign").over(by), 0).otherwise(1)).over(by))
    island = Window.partitionBy("id_pattern", "breaks").orderBy("vrr_date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    moved = F.coalesce(F.col("sign"), F.lit(0.0)) != 0
    return x.select("id_pattern", "vrr_date", F.when(moved, F.count("*").over(island)).otherwise(0).alias("run"), F.when(moved, F.sum("move").over(island)).alias("total"))


def anomalies_at(monthly: DataFrame, memory: DataFrame) -> DataFrame:
    """detect_anomalies as of every month: each month is judged as if it were the latest."""
    rows = monthly.where("vrr is not null").select("id_pattern", "vrr_date", "vrr", "any_extrapolated")
    return _found(rows.join(with_bands(rows, memory, together=True), "id_pattern").join(runs_at(monthly), ["id_pattern", "vrr_date"], "left"))


def _found(x: DataFrame) -> DataFrame:
    fine = ~F.col("any_extrapolated")
    found = F.array(
        F.when(F.col("any_extrapolated"), F.struct(F.lit("extrapolated_pvt").alias("kind"), F.lit("low").alias("severity"), F.lit(False).alias("actionable"))),
        F.when((F.col("vrr") < F.col("band_low")) | (F.col("vrr") > F.col("band_high")), F.struct(F.lit("out_of_band").alias("kind"), F.lit("high").alias("severity"), fine.alias("actionable"))),
        F.when((F.col("run") >= DRIFT_PERIODS) & (F.abs("total") >= DRIFT_TOTAL), F.struct(F.lit("sustained_drift").alias("kind"), F.lit("medium").alias("severity"), fine.alias("actionable"))),
    )
    return x.select("id_pattern", "vrr_date", "vrr", F.inline(F.filter(found, lambda s: s.isNotNull())))


def input_state(contrib: DataFrame, volumes: DataFrame, factors: DataFrame) -> DataFrame:
    """What the audit looks at, for each pattern and month. Completions without any allocation and allocations above one are
    counted in the whole field and charged to every pattern; allocation dates do not matter for silent completions."""
    month = F.trunc("vrr_date", "MM")
    # names are keys first, as no hash table can hold them as values
    periods = contrib.groupBy("id_pattern", "pattern_name", month.alias("period")).agg(F.count("*").alias("n_rows"), methods_of().alias("pvt_methods"), F.count_if(F.col("pressure").isNull()).alias("n_missing_pressure"), F.min("factor_effect_date").alias("oldest"))
    periods = periods.groupBy("id_pattern", "period").agg(
        F.max("pattern_name").alias("pattern_name"), F.sum("n_rows").alias("n_rows"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("pvt_methods")))).alias("pvt_methods"),
        F.sum("n_missing_pressure").alias("n_missing_pressure"), F.min("oldest").alias("oldest"),
    )
    orphans = volumes.join(factors.select("id_completion").distinct(), "id_completion", "left_anti").agg(F.count("*").alias("n_missing_factor"))
    over = factors.groupBy("id_completion", "effect_date").agg(F.sum("factor").alias("f")).where("f > 1.0001").agg(F.count("*").alias("n_allocation_over_one"))
    pairs = factors.where("factor > 0").select("id_pattern", "id_completion").distinct()
    n_pairs = pairs.groupBy("id_pattern").agg(F.count("*").alias("allocated"))
    active = contrib.select("id_pattern", "id_completion", month.alias("period")).distinct().join(pairs, ["id_pattern", "id_completion"], "left_semi")
    active = active.groupBy("id_pattern", "period").agg(F.count("*").alias("active"))
    x = periods.join(n_pairs, "id_pattern", "left").join(active, ["id_pattern", "period"], "left")
    silent = F.coalesce(F.col("allocated"), F.lit(0)) - F.coalesce(F.col("active"), F.lit(0))
    x = x.withColumn("n_allocated_without_volumes", silent).withColumn("allocation_age_days", F.datediff("period", "oldest"))
    return x.crossJoin(F.broadcast(orphans)).crossJoin(F.broadcast(over)).drop("allocated", "active", "oldest")  # one row each


def recompute_difference(monthly: DataFrame, contrib: DataFrame) -> DataFrame:
    """(id_pattern, period, difference): the stored monthly ratio less the one from the lineage rows."""
    produced = F.sum(F.col("oil_res") + F.col("water_res") + F.coalesce("free_gas_res", F.lit(0.0)))
    again = contrib.groupBy("id_pattern", F.trunc("vrr_date", "MM").alias("period")).agg((F.sum(F.col("water_inj_res") + F.col("gas_inj_res")) / F.nullif(produced, F.lit(0.0))).alias("again"))
    return again.join(monthly.select("id_pattern", F.col("vrr_date").alias("period"), "vrr"), ["id_pattern", "period"]).select("id_pattern", "period", (F.col("vrr") - F.col("again")).alias("difference"))


def assess_inputs(state: DataFrame) -> DataFrame:
    """The state with findings (rule, severity), verdict, summary, actionable and owner. Any high finding: DATA_ARTIFACT; any medium, or no
    rows: INCONCLUSIVE; else REAL_SIGNAL. A difference counts only where no PVT is of low confidence and no pressure missing."""
    c = F.col
    low = F.arrays_overlap("pvt_methods", F.array(*map(F.lit, LOW_CONFIDENCE)))
    gate = ~low & (c("n_missing_pressure") == 0)
    rules = [
        ("pvt_not_measured", "high", low),
        ("missing_pressure", "high", c("n_missing_pressure") > 0),
        ("missing_allocation", "high", c("n_missing_factor") > 0),
        ("allocation_over_one", "high", c("n_allocation_over_one") > 0),
        ("stale_build", "high", gate & (F.abs("difference") > RECOMPUTE_TOLERANCE)),
        ("allocated_without_volumes", "medium", c("n_allocated_without_volumes") > 0),
        ("stale_allocation", "medium", c("allocation_age_days") > STALE_DAYS),
    ]
    found = F.array(*[F.when(test, F.struct(F.lit(rule).alias("rule"), F.lit(level).alias("severity"))) for rule, level, test in rules])
    x = state.withColumn("findings", F.filter(found, lambda f: f.isNotNull()))
    is_high, is_medium = F.exists("findings", lambda f: f["severity"] == "high"), F.exists("findings", lambda f: f["severity"] == "medium")
    verdict = F.when(c("n_rows") <= 0, "INCONCLUSIVE").when(is_high, "DATA_ARTIFACT").when(is_medium, "INCONCLUSIVE").otherwise("REAL_SIGNAL")
    first = F.coalesce(F.get(F.filter("findings", lambda f: f["severity"] == "high"), F.lit(0)), F.get("findings", F.lit(0)))
    x = x.withColumn("summary_text", _said(first["rule"]))
    return x.withColumn("verdict", verdict).withColumn("summary", first["rule"]).withColumn("actionable", c("verdict") == "REAL_SIGNAL").withColumn("owner", owner_of(c("verdict")))


def _said(rule: Column) -> Column:
    """A sentence for a finding of the audit, with its count."""
    n = lambda text, c: F.format_string(text, F.col(c).cast("long"))
    said = {
        "pvt_not_measured": F.concat(F.lit("fluid properties were not measured at this pressure: "), F.array_join(F.array_intersect("pvt_methods", F.array(*map(F.lit, LOW_CONFIDENCE))), ", ")),
        "missing_pressure": n("%d rows have no pressure reading in force", "n_missing_pressure"),
        "missing_allocation": n("%d volume rows of the field belong to completions without any allocation", "n_missing_factor"),
        "allocation_over_one": n("%d completions of the field are allocated above one", "n_allocation_over_one"),
        "stale_build": F.lit("the stored ratio is not the one that its lineage rows give"),
        "allocated_without_volumes": n("%d allocated completions reported no volumes", "n_allocated_without_volumes"),
        "stale_allocation": n("the oldest allocation in use is %d days old", "allocation_age_days"),
    }
    out = F.lit(None).cast("string")
    for name, text in said.items():
        out = F.when(rule == name, text).otherwise(out)
    return out


#: Who looks at a case with each verdict.
OWNERS = {"REAL_SIGNAL": "analyst", "DATA_ARTIFACT": "data_steward", "INCONCLUSIVE": "analyst"}


def owner_of(verdict: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in OWNERS.items() for x in pair]), verdict)


def injector_states(contrib: DataFrame) -> DataFrame:
    """Each injector of a pattern month: mean factor, surface and reservoir injection, and the volume factor they imply."""
    rows = contrib.where("water_inj > 0").groupBy("id_pattern", F.trunc("vrr_date", "MM").alias("vrr_date"), "id_completion")
    out = rows.agg(F.avg("factor").alias("factor"), F.sum("water_inj").alias("surface"), F.sum("water_inj_res").alias("inj_res"))
    return out.withColumn("bw_inj", F.coalesce(F.col("inj_res") / F.nullif(F.col("factor") * F.col("surface"), F.lit(0.0)), F.lit(0.0)))


def recommend(monthly: DataFrame, injectors: DataFrame, targets: DataFrame, memory: DataFrame, limits: DataFrame) -> DataFrame:
    """A row for each injector of each month off target: the change that steers the ratio to its target, divided by the learned
    response, shared by reservoir injection and clamped to the tightest limit, with the ratio to expect."""
    c = F.col
    cap = limits.agg(F.coalesce(F.min("max_inj_rate_change_pct"), F.lit(MAX_CHANGE)).alias("cap"))
    x = monthly.where("prod_res > 0").select("id_pattern", "vrr_date", "prod_res", c("inj_res").alias("total_inj"), (c("inj_res") / c("prod_res")).alias("current_vrr"))
    x = x.join(targets, "id_pattern", "left").join(memory.select("id_pattern", "response_factor"), "id_pattern", "left")
    rho = F.coalesce("response_factor", F.lit(1.0))
    x = x.withColumn("target_vrr", F.coalesce("target_vrr", F.lit(1.0))).withColumn("rho", F.when(rho > 0, rho).otherwise(1.0)).crossJoin(F.broadcast(cap))  # one row
    x = x.where(F.abs(c("current_vrr") - c("target_vrr")) > ON_TARGET).withColumn("d_inj_res", (c("target_vrr") * c("prod_res") - c("total_inj")) / c("rho"))
    x = x.join(injectors, ["id_pattern", "vrr_date"])
    by = Window.partitionBy("id_pattern", "vrr_date")
    summed = F.sum("inj_res").over(by)
    base = F.when(summed != 0, summed).when(c("total_inj") != 0, c("total_inj")).otherwise(1.0)
    x = x.withColumn("share", c("inj_res") / base).withColumn("denom", c("factor") * c("bw_inj"))
    x = x.where((c("denom") != 0) & (c("surface") != 0))
    x = x.withColumn("pct", c("d_inj_res") * c("share") / c("denom") / c("surface")).withColumn("change_pct", F.greatest(-c("cap"), F.least(c("cap"), c("pct"))))
    x = x.withColumn("bounded", c("change_pct") != c("pct")).withColumn("delta_surface", c("change_pct") * c("surface"))
    x = x.withColumn("expected_post_vrr", c("current_vrr") + c("rho") * F.sum(c("delta_surface") * c("denom")).over(by) / c("prod_res"))
    return x.withColumn("direction", F.when(c("d_inj_res") < 0, "reduce_injection").when(c("d_inj_res") > 0, "increase_injection").otherwise("none"))


def updated_response(rho: Column, predicted: Column, actual: Column) -> Column:
    """The response factor after one outcome: a moving average of actual over predicted change, both clamped."""
    ratio = F.greatest(F.lit(RATIO_RANGE[0]), F.least(F.lit(RATIO_RANGE[1]), actual / F.nullif(predicted, F.lit(0.0))))
    new = F.greatest(F.lit(RHO_RANGE[0]), F.least(F.lit(RHO_RANGE[1]), (1 - ALPHA) * rho + ALPHA * ratio))
    return F.when(F.coalesce(predicted, F.lit(0.0)) == 0, rho).otherwise(new)


def outcome_write_back(adjustments: DataFrame, monthly: DataFrame, memory: DataFrame) -> DataFrame:
    """(action_id, id_pattern, vrr_date, ts, pre_vrr, predicted_post_vrr, observed_date, actual_post_vrr, status, skip_reason) of each
    executed adjustment that still waits for its outcome (actual_post_vrr null, or no such column): the next later month with a ratio,
    which may be any number of months on. Where there is none it goes on waiting."""
    later = monthly.where("vrr is not null").select(F.col("id_pattern").alias("m_pattern"), F.col("vrr_date").alias("m_date"), "vrr")
    x = adjustments.where("outcome = 'executed'")
    if "actual_post_vrr" in adjustments.columns:
        x = x.where("actual_post_vrr is null")
    x = x.select("action_id", "id_pattern", "vrr_date", "ts", "pre_vrr", "predicted_post_vrr")
    x = x.join(later, (x["id_pattern"] == later["m_pattern"]) & (later["m_date"] > x["vrr_date"]), "left")
    x = x.groupBy("action_id", "id_pattern", "vrr_date", "ts", "pre_vrr", "predicted_post_vrr").agg(F.min("m_date").alias("observed_date"), F.min_by("vrr", "m_date").alias("actual_post_vrr"))
    waits = F.col("actual_post_vrr").isNull()
    return x.withColumn("status", F.when(waits, "waiting").otherwise("written")).withColumn("skip_reason", F.when(waits, "no later period"))


def learned_responses(outcomes: DataFrame, memory: DataFrame) -> DataFrame:
    """(id_pattern, response_factor, n_adjustments): each pattern's outcomes folded in date order into its response factor. Outcomes that
    wait, or lack a ratio before or a prediction, teach nothing; a pattern without a response factor in memory learns nothing."""
    x = outcomes.where("actual_post_vrr is not null and pre_vrr is not null and predicted_post_vrr is not null")
    steps = F.array_sort(F.collect_list(F.struct("vrr_date", "ts", "action_id", (F.col("predicted_post_vrr") - F.col("pre_vrr")).alias("p"), (F.col("actual_post_vrr") - F.col("pre_vrr")).alias("a"))))
    x = memory.where("response_factor is not null").join(x.groupBy("id_pattern").agg(steps.alias("steps")), "id_pattern")
    fold = F.aggregate("steps", F.col("response_factor"), lambda rho, s: updated_response(rho, s["p"], s["a"]))
    return x.select("id_pattern", fold.alias("response_factor"), (F.coalesce(F.col("n_adjustments"), F.lit(0)) + F.size("steps")).cast("long").alias("n_adjustments"))


def written_back(adjustments: DataFrame, memory: DataFrame, outcomes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The history with what was observed filled in, and the memory with what was learned from it. Once more with both, and with the
    outcomes that are then pending, changes nothing until new months come."""
    seen = outcomes.where("status = 'written'").select("action_id", F.col("actual_post_vrr").alias("_seen"))
    known = F.col("actual_post_vrr") if "actual_post_vrr" in adjustments.columns else F.lit(None).cast("double")
    history = adjustments.join(seen, "action_id", "left").withColumn("actual_post_vrr", F.coalesce(known, F.col("_seen"))).drop("_seen")
    learned = learned_responses(outcomes, memory).select("id_pattern", F.col("response_factor").alias("_rho"), F.col("n_adjustments").alias("_n"))
    x = memory.join(learned, "id_pattern", "left").withColumn("response_factor", F.coalesce("_rho", "response_factor")).withColumn("n_adjustments", F.coalesce(F.col("_n"), F.col("n_adjustments").cast("long")))
    return history, x.select(*memory.columns)


def precedents(adjustments: DataFrame) -> DataFrame:
    """The latest executed adjustment of each driver and direction (ties: the higher action_id)."""
    best = F.max_by(F.struct("action_id", "id_pattern", "vrr_date", "d_surface_pct", "pre_vrr"), F.struct("ts", "action_id"))
    return adjustments.where("outcome = 'executed'").groupBy("driver", "change_type").agg(best.alias("b")).select("driver", "change_type", "b.*")
