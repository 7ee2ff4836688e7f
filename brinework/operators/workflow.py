"""Approval workflow, conversations, question routing and trace scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brinework.operators.text import uncited
from brinework.sources.store import written
from brinework.sources.versioned import VersionedTable

# Stages in order, and the role that may advance each.
STAGES = ["draft", "analyst", "rm", "site", "executed"]
AUDIT_TOOLS, ADVICE_TOOLS = ["VRR_AUDIT", "INPUT_AUDIT"], ["RECOMMEND_CHANGE", "SUBMIT_FOR_APPROVAL"]
# Words that route a question, first match wins.
INTENTS = {
    "lineage": ["lineage", "calculat", "derive", "derivation", "which tables", "what tables", "where does", "where do", "provenance", "trace", "how do you compute", "how is it computed", "formula", "built from"],
    "audit": ["audit", "verify", "correct", "accurate", "double check", "double-check", "prove", "sanity check", "recompute", "reconcile", "trust", "right?"],
    "knowledge": ["document", "handbook", "literature", "paper", "manual", "guideline", "guidance", "policy", "procedure", "sop", "standard", "reference say", "knowledge base", "what does the doc"],
    "recommend": ["recommend", "what should", "fix", "valve", "adjust", "change injection", "action", "remediate"],
    "submit": ["submit", "send for approval", "queue it", "raise a draft", "send to rm", "approval"],
    "completions": ["completion", "wells", "well list", "which wells", "injectors", "producers", "injector list"],
    "data_quality": ["data quality", "input data", "data sane", "is the data", "ingestion", "orphan", "allocation sum", "missing pvt"],
    "portfolio": ["furthest from target", "worst", "which patterns are", "portfolio", "rank", "ranked", "overview", "across the field", "off target", "needs attention", "look first"],
    "list": ["list patterns", "which patterns", "what patterns", "all patterns"],
}


def next_stage(stage: Column) -> Column:
    """The stage that approval leads to; null from executed, rejected or anything unknown."""
    pairs = [x for a, b in zip(STAGES[:-1], STAGES[1:], strict=True) for x in (F.lit(a), F.lit(b))]
    return F.element_at(F.create_map(*pairs), stage)


def can_transition(now: Column, then: Column) -> Column:
    live = ~F.coalesce(now.isin("executed", "rejected"), F.lit(True))
    return live & ((then == "rejected") | F.coalesce(then == next_stage(now), F.lit(False)))


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "high", 0).when(severity == "medium", 1).otherwise(2)


# Whose sign-off a stage needs.
SIGN_OFF = {"draft": "analyst", "analyst": "rm", "rm": "site", "site": "site"}


def moved(queue: DataFrame, requests: DataFrame) -> DataFrame:
    """The queue (action_id, stage, ...) with `moved_to`, `moved_by` and `refused` after requests (action_id, verb: advance or reject,
    user, role), at most one for each action. A request is refused on a stage that is final or that another role signs off; an
    action without a request is as it was."""
    needed = F.element_at(F.create_map(*[F.lit(x) for pair in SIGN_OFF.items() for x in pair]), F.col("stage"))
    x = queue.join(requests.select("action_id", "verb", "user", "role"), "action_id", "left")
    refused = F.when(F.col("verb").isNull(), None).when(needed.isNull(), "stage is final").when(F.coalesce(F.col("role"), F.lit("")) != needed, F.concat(F.lit("needs "), needed))
    then = F.when(F.col("verb") == "reject", F.lit("rejected")).otherwise(next_stage(F.col("stage")))
    goes = F.col("verb").isNotNull() & F.col("refused").isNull()
    x = x.withColumn("refused", refused).withColumn("moved_to", F.when(goes, then).otherwise(F.col("stage"))).withColumn("moved_by", F.when(goes, F.col("user")))
    return x.drop("verb", "user", "role")


def adjustment_rows(moves: DataFrame) -> DataFrame:
    """The history rows of moves (see moved) that lead to executed: what was predicted, for the response to be learned from.
    changes is an array with change_pct; its mean is kept."""
    mean = F.aggregate("changes", F.lit(0.0), lambda a, c: a + F.coalesce(c["change_pct"], F.lit(0.0))) / F.nullif(F.size("changes"), F.lit(0))
    x = moves.where("moved_to = 'executed' and stage <> 'executed'")
    return x.select("action_id", "id_pattern", "vrr_date", "driver", F.coalesce("direction", "action_type").alias("change_type"), F.when(F.size("changes") > 0, mean).alias("d_surface_pct"), "pre_vrr", "predicted_post_vrr", F.lit(None).cast("double").alias("actual_post_vrr"), F.lit("approved").alias("decision"), F.col("moved_by").alias("approved_by"), F.lit("executed").alias("outcome"))


# Calls in so many seconds that a user has of each kind.
CALLS = {"chat": (20, 60), "chat_agentic": (5, 300), "upload": (10, 600), "review": (60, 600)}


def rate_limited(calls: DataFrame) -> DataFrame:
    """calls (bucket, who, ts: seconds as double) with n, the call's number in its window, and refused. A window starts with a
    user's first call and ends when a call comes at least its width later. Calls of unknown kinds are numbered throughout and never
    refused; those without a time have no number.

    Time is cut into stretches as wide as a window, so that each holds one start of a window at most, and only a user's calls of one
    stretch meet in a task. Behind an empty stretch a window always starts; from there on each call names the one that would start the
    next window, and following these names 1, 2, 4, ... windows at a time finds all starts."""
    kinds = F.create_map(*[F.lit(v) for k, (most, width) in CALLS.items() for v in (k, F.struct(F.lit(most).alias("most"), F.lit(float(width)).alias("width")))])
    x = calls.select("bucket", "who", F.col("ts").cast("double").alias("ts")).withColumn("u", F.to_json(F.struct("bucket", "who"))).withColumn("kind", F.try_element_at(kinds, F.col("bucket")))
    x = x.withColumn("width", F.coalesce("kind.width", F.lit(86400.0))).withColumn("c", F.floor(F.col("ts") / F.col("width")))
    x = written(x.select("bucket", "who", "ts", "u", F.col("kind.most").alias("most"), "width", "c"), "calls")
    known = x.where("most is not null and ts is not null")
    times = written(known.select("u", "c", "ts", "width").distinct(), "call-times")
    stretches = times.groupBy("u", "c").agg(F.min("ts").alias("first"))
    before = stretches.select("u", (F.col("c") + 1).alias("c"))
    reached = written(stretches.join(before, ["u", "c"], "left_anti").select("u", F.col("first").alias("t")), "window-starts")
    # the next start from each call: the first call of the next stretch that is late enough, else the first of the one after that
    probes = times.select("u", (F.col("c") + 1).alias("c"), (F.col("ts") + F.col("width")).alias("at"), F.col("ts").alias("probe"))
    asked = times.select("u", "c", F.col("ts").alias("at"), F.lit(None).cast("double").alias("probe")).unionByName(probes)
    by = Window.partitionBy("u", "c").orderBy(F.col("at").desc(), F.col("probe").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    asked = asked.withColumn("then", F.min(F.when(F.col("probe").isNull(), F.col("at"))).over(by)).withColumn("full", F.count(F.when(F.col("probe").isNull(), 1)).over(Window.partitionBy("u", "c")) > 0).where("probe is not null and full")
    after = stretches.select("u", (F.col("c") - 1).alias("c"), F.col("first").alias("after"))
    jumps = written(asked.join(after, ["u", "c"], "left").select("u", F.col("probe").alias("t"), F.coalesce("then", "after").alias("to")).where("to is not null"), "jumps")
    while True:
        new = reached.join(jumps, ["u", "t"]).select("u", F.col("to").alias("t")).join(reached, ["u", "t"], "left_anti").distinct()
        new = written(new, "window-starts")
        if new.isEmpty():
            break
        reached = written(reached.unionByName(new), "window-starts")
        on = jumps.select("u", F.col("t").alias("to"), F.col("to").alias("further"))
        jumps = written(jumps.join(on, ["u", "to"]).select("u", "t", F.col("further").alias("to")), "jumps")
    starts = reached.join(times.select("u", F.col("ts").alias("t"), "c"), ["u", "t"]).select("u", "c", F.col("t").alias("start"))
    y = known.join(starts, ["u", "c"], "left").join(starts.select("u", (F.col("c") + 1).alias("c"), F.col("start").alias("prior")), ["u", "c"], "left")
    y = y.withColumn("start", F.when(F.col("start") <= F.col("ts"), F.col("start")).otherwise(F.col("prior")))
    y = y.drop("prior").unionByName(x.where("most is null and ts is not null").withColumn("start", F.lit(0.0)))
    counts = y.groupBy("u", "start", "c").agg(F.count("*").alias("here"))
    counts = counts.withColumn("earlier", F.sum("here").over(Window.partitionBy("u", "start").orderBy("c")) - F.col("here"))
    y = y.join(counts.drop("here"), ["u", "start", "c"]).withColumn("n", F.col("earlier") + F.row_number().over(Window.partitionBy("u", "start", "c").orderBy("ts")))
    y = y.select("bucket", "who", "ts", "n", F.coalesce(F.col("n") > F.col("most"), F.lit(False)).alias("refused"))
    return y.unionByName(x.where("ts is null").select("bucket", "who", "ts", F.lit(None).cast("long").alias("n"), F.lit(False).alias("refused")))


#: A queued action: its draft, and where it stands.
QUEUE = (
    "action_id string, id_pattern long, pattern_name string, vrr_date date, anomaly_kind string, severity string, anomaly_detail string, driver string, action_type string, recommendation string, "
    "expected_post_vrr double, precedent long, confidence string, narrative string, audit_verdict string, owner_role string, stage string, stage_by string"
)


def action_queue(spark: SparkSession, path: str, buckets: int = 16) -> VersionedTable:
    """The stored queue, in buckets by pattern and month, as a new draft replaces the pending one of its pattern and month."""
    return VersionedTable(spark, path).create(QUEUE, ["id_pattern", "vrr_date"], buckets)


def _queued(drafts: DataFrame, by: str, name: Column) -> DataFrame:
    fields = [f.split()[0] for f in QUEUE.split(", ")]
    x = drafts.withColumn("action_id", F.concat(F.lit("ACT-"), F.substring(F.sha2(name, 256), 1, 10))).withColumn("recommendation", F.to_json("recommendation"))
    return x.withColumn("stage", F.lit("draft")).withColumn("stage_by", F.lit(by)).select(*fields)


def submit(queue: VersionedTable, drafts: DataFrame, by: str = "agent") -> int:
    """Queues drafts (see cases.drafts) that carry a request_id each; a request that is queued already, in whatever stage, is not
    queued again. The version of the queue after it."""
    return queue.insert_if_absent(_queued(drafts, by, F.col("request_id").cast("string")), ["action_id"])


def queue_anomalies(queue: VersionedTable, drafts: DataFrame, by: str = "anomaly_to_queue") -> int:
    """Queues one draft for each pattern and month, in place of the one that is pending there; actions that have moved on stay."""

    def how(old: DataFrame, new: DataFrame) -> DataFrame:
        moved_on = old.where("stage <> 'draft'").groupBy("id_pattern", "vrr_date").agg(F.count("*").alias("moved_on"))
        named = new.dropDuplicates(["id_pattern", "vrr_date"]).join(moved_on, ["id_pattern", "vrr_date"], "left")
        name = F.concat_ws("|", "id_pattern", F.col("vrr_date").cast("string"), F.lit(by), F.coalesce("moved_on", F.lit(0)).cast("string"))
        return replaced_drafts(old, _queued(named, by, name))

    return queue.change(drafts, how)


def advance(queue: VersionedTable, requests: DataFrame, history: VersionedTable | None = None) -> int:
    """Moves queued actions by requests (action_id, verb, user, role; see moved); refused ones stay where they are. With history (of
    adjustment_rows' columns, keyed by action_id), actions that become executed are written there first."""
    fields = [f.split()[0] for f in QUEUE.split(", ")]
    moves = moved(queue.read(), requests)
    if history is not None:
        done = moves.where("moved_to = 'executed' and stage <> 'executed'")
        history.insert_if_absent(done.select("action_id", "id_pattern", "vrr_date", "driver", F.col("action_type").alias("change_type"), F.col("expected_post_vrr").alias("predicted_post_vrr"), F.col("moved_by").alias("approved_by"), F.lit("executed").alias("outcome")))
    gone = moves.where("moved_by is not null").withColumn("stage", F.col("moved_to")).withColumn("stage_by", F.col("moved_by")).select(*fields)
    return queue.upsert(gone, ["action_id"])


def by_stage(queue: DataFrame, stage: str) -> DataFrame:
    """The board's lane of a stage: the most severe first, then the latest month, then the action."""
    return queue.where(F.col("stage") == stage).orderBy(severity_rank(F.col("severity")), F.col("vrr_date").desc(), "action_id")


def newest(adjustments: DataFrame, n: int = 50) -> DataFrame:
    """The n newest adjustments, newest first."""
    return adjustments.orderBy(F.col("ts").desc(), F.col("action_id").desc()).limit(n)


#: A stored verdict of the input audit.
AUDIT = "id_pattern long, vrr_date date, verdict string, summary string, summary_text string, actionable boolean, owner string, findings string"


def audit_table(spark: SparkSession, path: str, buckets: int = 16) -> VersionedTable:
    return VersionedTable(spark, path).create(AUDIT, ["id_pattern", "vrr_date"], buckets)


def store_audit(table: VersionedTable, assessed: DataFrame, every_period: bool = True) -> int:
    """Puts the audit of each pattern month (rules.assess_inputs), or of each pattern's latest one, in place of what is stored for it."""
    x = assessed.withColumnRenamed("period", "vrr_date")
    if not every_period:
        x = x.withColumn("back", F.row_number().over(Window.partitionBy("id_pattern").orderBy(F.col("vrr_date").desc()))).where("back = 1")
    return table.upsert(x.withColumn("findings", F.to_json("findings")).select(*[f.split()[0] for f in AUDIT.split(", ")]))


def replaced_drafts(queue: DataFrame, new: DataFrame) -> DataFrame:
    """The queue with pending drafts of the new rows' patterns and dates replaced by them."""
    old = queue.where("stage = 'draft'").join(new.select("id_pattern", "vrr_date"), ["id_pattern", "vrr_date"], "left_anti")
    return queue.where("stage <> 'draft'").unionByName(old.select(*queue.columns)).unionByName(new.select(*queue.columns))


def upserted(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The table with rows of equal keys replaced."""
    return table.join(rows.select(*keys), keys, "left_anti").select(*table.columns).unionByName(rows.select(*table.columns))


def inserted_if_absent(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    return table.unionByName(rows.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti").select(*table.columns))


def recent_turns(conversations: DataFrame, k: int = 3, cutoffs: DataFrame | None = None) -> DataFrame:
    """The newest k turns of each conversation, oldest first by turn; back counts from the newest. Turns with a deleted_at (where there is
    such a column) do not count. cutoffs (conv_id, after): only later turns count for those conversations; a null one hides nothing."""
    x = conversations.where("deleted_at is null") if "deleted_at" in conversations.columns else conversations
    if cutoffs is not None:
        x = x.join(cutoffs.groupBy("conv_id").agg(F.max("after").alias("_after")), "conv_id", "left").where("_after is null or turn > _after").drop("_after")
    by = Window.partitionBy("conv_id").orderBy(F.col("turn").desc(), F.col("role"), F.col("text"))
    return x.withColumn("back", F.row_number().over(by)).where(F.col("back") <= k)


def intent(question: Column) -> Column:
    """Where a question goes: the first intent with a word in it; explain where none has."""
    q = F.lower(question)
    out = F.lit("explain")
    for name, words in reversed(INTENTS.items()):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(q, F.lit(w))
        out = F.when(hit, name).otherwise(out)
    return out


_MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]


def asked_date(question: Column) -> Column:
    """The first day of the month that a question names: the first YYYY-MM or YYYY-MM-DD, else the first word before a year of four
    digits, if it is a month's name or its three-letter form; else null."""
    iso = F.regexp_extract(question, r"(\d{4}-\d{2})", 1)
    named = F.regexp_extract(F.lower(question), r"([a-z]+)\s+(\d{4})", 1)
    year = F.regexp_extract(F.lower(question), r"([a-z]+)\s+(\d{4})", 2)
    months = F.create_map(*[x for i, m in enumerate(_MONTHS, 1) for name in dict.fromkeys((m, m[:3])) for x in (F.lit(name), F.lit(f"{i:02d}"))])
    return F.when(iso != "", F.try_to_date(F.concat(iso, F.lit("-01")))).when(named != "", F.try_to_date(F.concat(year, F.lit("-"), F.element_at(months, named), F.lit("-01"))))


# The words and phrases that the scores look for are fixed values.
def trace_scores(spans: DataFrame) -> DataFrame:
    """Of each trace (spans: trace_id, ordinal, name, span_type, outputs, answer): tools used, whether inputs were audited before
    advice, whether nothing was rejected, whether no change is proposed on an artefact, and whether every decimal of the answer is
    in the output of a tool (as it is, as a percentage, or rounded). A `tool_call` span stands for the tool in its `tool` field."""
    wrapped = F.get_json_object("outputs", "$.tool")
    spans = spans.withColumn("name", F.when((F.lower("name") == "tool_call") & wrapped.isNotNull(), wrapped).otherwise(F.col("name")))
    tool = F.upper("span_type") == "TOOL"
    first = lambda names: F.min(F.when(tool & F.col("name").isin(names), F.col("ordinal")))
    blob = F.lower(F.coalesce("outputs", F.lit("")))
    refused = (blob.contains("rejected") & blob.contains("gate")) | (blob.contains('"ok": false') & blob.contains("violations"))
    answer = F.lower(F.coalesce(F.max("answer"), F.lit("")))
    proposes = answer.rlike("reduce injection|increase injection|new_surface|→ 4|change injection")
    artefact = F.bool_or(F.coalesce("outputs", F.lit("")).contains("DATA_ARTIFACT"))
    advice, audited = first(ADVICE_TOOLS), first(AUDIT_TOOLS)
    told = F.when(F.upper("span_type").isin("TOOL", "RETRIEVER"), F.transform(F.regexp_extract_all(F.coalesce("outputs", F.lit("")), F.lit(r"-?\d+\.\d+"), F.lit(0)), lambda v: v.cast("double")))
    allowed = F.flatten(F.transform(F.coalesce(told, F.array().cast("array<double>")), lambda v: F.array(v, v * 100, F.round(v, 2), F.round(v, 3))))
    scores = spans.groupBy("trace_id").agg(
        F.count_if(tool).alias("tools_used"), (advice.isNull() | F.coalesce(audited < advice, F.lit(False))).alias("audit_before_advice"),
        (~F.bool_or(refused)).alias("gate_passed"), (~(artefact & proposes)).alias("no_advice_on_artifact"), F.coalesce(F.max("answer"), F.lit("")).alias("_said"), F.count("*").alias("_spans"),
    )
    # a decimal is ungrounded if every span of its trace, by its own numbers, leaves it so; no trace's numbers are gathered
    scores = written(scores, "trace-scores")
    each = spans.select("trace_id", allowed.alias("allowed")).join(scores.select("trace_id", "_said", "_spans"), "trace_id")
    left = each.select("trace_id", "_spans", F.explode(F.array_distinct(uncited(F.col("_said"), F.col("allowed")))).alias("figure"))
    bad = left.groupBy("trace_id", "figure").agg(F.count("*").alias("n"), F.max("_spans").alias("of")).where("n = of").select("trace_id", F.lit(False).alias("_grounded")).distinct()
    return scores.drop("_said", "_spans").join(bad, "trace_id", "left").withColumn("numbers_grounded", F.coalesce("_grounded", F.lit(True))).drop("_grounded")


def latency_summary(traces: DataFrame) -> DataFrame:
    """One row from (trace_id, duration_ms): mean, 90th percentile and maximum."""
    return traces.agg(F.avg("duration_ms").alias("mean_ms"), F.percentile("duration_ms", F.lit(0.9)).alias("p90_ms"), F.max("duration_ms").alias("max_ms"))
