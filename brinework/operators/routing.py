"""Where questions go: about the running system, about the software, or to one of the analyst's tools; and which help topic fits.

All phrases are looked for together, by one automaton that reads a question once; what was found is then weighed by column rules.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinework.operators.workflow import INTENTS

# Phrases that ask about the running system, and words that make one of them a question about the portfolio.
STATUS = [
    "are you connected", "connected to an llm", "connected to a llm", "connected to the llm", "connected to ollama", "connected to a large language model", "connected to the large language model",
    "which model", "what model", "which llm", "what llm", "what provider", "which provider",
    "how many patterns?", "how many patterns do", "how many patterns have", "how many patterns loaded", "how many patterns are loaded", "how many patterns are there", "how many patterns in", "how many patterns currently",
    "number of patterns", "pattern count", "count of patterns",
    "are you tracing", "is tracing", "tracing on", "tracing enabled", "tracing off", "is mlflow", "mlflow up", "mlflow running",
    "ollama up", "ollama running", "is ollama", "llm available", "is the llm", "is the model up", "is the model running", "is the narrator",
    "system status", "your status", "runtime status", "health check",
]
STATUS_AT_END = "how many patterns"
NOT_STATUS = ["off target", "furthest", "worst", "needs attention", "ranked", "from target"]
# Words of the software, and phrases that are about its use without them.
APP_NOUNS = [
    "view", "screen", "page", "tab", "button", "click", "drag", "panel", "board", "lane", "sidebar", "menu", "workbench", "app", "application", "ui", "interface",
    "dashboard", "navigate", "sign in", "log in", "login", "sign out", "upload", "drawer", "chat window", "this tool", "the tool", "get started", "how do i use",
    "how to use", "where do i", "where can i", "how do i find", "walk me through", "card", "zone", "column", "swim lane", "swimlane", "kanban", "scrum",
]
STRONG_HELP = [
    "how do i use", "how to use", "help me use", "what can this do", "what can you do", "what can i do here", "getting started", "get started", "show me around",
    "walk me through the app", "how does this app work",
]
# Keywords of the help topics.
TOPICS = {
    "overview": ["overview", "what is this", "what can", "getting started", "get started", "show me around", "how does this app", "what does this app", "views", "navigate", "sections", "menu", "sidebar", "rail", "architecture", "how do i use this", "use this app", "use the app", "using this app", "what can you do", "what can i do"],
    "portfolio": ["portfolio", "first view", "home", "landing", "rank", "ranked", "off target", "which pattern", "overview table", "look first"],
    "report": ["report", "trend", "chart", "attribution", "driver", "what moved", "decompose", "diagram", "schematic", "well layout", "pattern diagram", "narrative", "draft", "recommendation"],
    "lineage": ["lineage", "audit", "provenance", "where does the number come from", "derivation", "recompute", "graph", "dag", "trust the number", "verify the number", "source table"],
    "approvals": ["approval", "approve", "board", "swim lane", "swimlane", "lane", "stage", "sign off", "signoff", "reject", "execute", "chain", "kanban", "scrum", "move a card", "drag a card"],
    "move_card": ["move a card", "move the card", "move it", "drag", "drop", "advance", "next lane", "analyst to rm", "analyst lane to", "lane to rm", "rm zone", "analyst zone", "to the rm", "cannot move", "can't move", "won't move", "cannot drag", "can't drag", "greyed", "grayed", "no button", "stuck", "move from"],
    "roles": ["role", "which role", "what role", "role can", "my role", "who can", "who is allowed", "permission", "403", "not allowed", "forbidden", "may not do this", "access", "reservoir manager", "site engineer", "data_steward", "steward", "admin", "see mine"],
    "knowledge": ["knowledge", "upload", "document", "pdf", "ingest", "embed", "index", "attach", "add a file", "my file", "file was rejected", "rejected on upload", "rejected my file", "file type", "too large", "pending review", "not searchable"],
    "chat": ["chat", "ask the agent", "drawer", "chatbot", "bot", "assistant", "agentic", "model picks the tools", "transcript", "clear the chat", "history", "trace"],
    "signin": ["sign in", "signin", "log in", "login", "password", "account", "401", "not authenticated", "token", "expired", "sign out", "who am i", "logged in as"],
    "suspect": ["suspect", "flag", "amber", "warning", "extrapolated", "low confidence", "off target", "red", "colour", "color", "why is it highlighted", "what does the icon mean"],
}


def found_phrases(questions: DataFrame, column: str, lists: dict[str, list[str]]) -> DataFrame:
    """questions with `found`: for each of the named lists with a phrase in the question (any case), the list's name, the number of
    different phrases, their lengths in all and the longest. Null questions have none."""
    wanted: dict[str, list[str]] = {}
    for name, phrases in lists.items():
        for p in dict.fromkeys(phrases):
            wanted.setdefault(p, []).append(name)
    kind = pa.list_(pa.struct([("name", pa.string()), ("n", pa.int32()), ("total", pa.int32()), ("longest", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for p in wanted:
            automaton.add_word(p, p)
        automaton.make_automaton()
        for batch in batches:
            out = []
            for text in batch.column(column).to_pylist():
                lengths: dict[str, list[int]] = {}
                for p in {p for _, p in automaton.iter((text or "").lower())}:
                    for name in wanted[p]:
                        lengths.setdefault(name, []).append(len(p))
                out.append([{"name": n, "n": len(v), "total": sum(v), "longest": max(v)} for n, v in sorted(lengths.items())])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], names=[*batch.schema.names, "found"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in questions.schema), "found array<struct<name: string, n: int, total: int, longest: int>>"])
    return questions.mapInArrow(run, schema)


def routed(questions: DataFrame, column: str = "question") -> DataFrame:
    """questions with `intent`, `status_score` (length of the status phrases in it) and `topic` (the best help topic, null if none fits).
    A question about the running system is `status`, one about the software `help`; then the first intent with a word in it, else
    explain. How many patterns are off target is no question about the system."""
    lists = {"status": STATUS, "status.pattern": [p for p in STATUS if "pattern" in p], "portfolio": NOT_STATUS, "noun": APP_NOUNS, "strong": STRONG_HELP}
    lists |= {f"topic.{k}": v for k, v in TOPICS.items()} | {f"intent.{k}": v for k, v in INTENTS.items()}
    x = found_phrases(questions, column, lists)
    has = lambda name: F.exists("found", lambda f: f["name"] == name)
    at_end = F.coalesce(F.regexp_replace(F.lower(column), r"[?.! ]+$", "").endswith(STATUS_AT_END), F.lit(False))
    score = F.aggregate(F.filter("found", lambda f: f["name"] == "status"), F.lit(0), lambda s, f: s + f["total"]) + F.when(at_end, len(STATUS_AT_END)).otherwise(0)
    status = (score > 0) & ~((has("status.pattern") | at_end) & has("portfolio"))
    topics = F.filter("found", lambda f: f["name"].startswith("topic."))
    best = F.get(F.array_sort(F.transform(topics, lambda f: F.struct((-f["total"]).alias("t"), (-f["longest"]).alias("l"), F.substring_index(f["name"], ".", -1).alias("id")))), F.lit(0))["id"]
    out: Column = F.lit("explain")
    for name in reversed(INTENTS):
        out = F.when(has(f"intent.{name}"), name).otherwise(out)
    out = F.when(status, "status").when(has("strong") | (has("noun") & (F.size(topics) > 0)), "help").otherwise(out)
    return x.withColumns({"intent": out, "status_score": score.cast("long"), "topic": best}).drop("found")


def status_text(facts: DataFrame) -> Column:
    """What is known of the running system, from facts (provider, model, available, tracing, n_patterns): what was not measured is said
    to be unknown, never taken as none."""
    c = F.col
    narrator = F.concat(F.coalesce("provider", F.lit("unknown provider")), F.when(~F.coalesce("available", F.lit(False)), F.lit(" is not reachable; answers are computed and not rephrased")).when(c("model").isNull(), F.lit(" is reachable, its model not named")).otherwise(F.concat(F.lit(" is reachable with "), "model")))
    tracing = F.when(c("tracing").isNull(), "unknown").when(c("tracing"), "on").otherwise("off")
    patterns = F.when(c("n_patterns").isNull(), F.lit("unknown, the tables gave no answer")).otherwise(c("n_patterns").cast("string"))
    return F.concat(F.lit("Model: "), narrator, F.lit(". Tracing: "), tracing, F.lit(". Patterns: "), patterns, F.lit("."))
