"""Whether a narration says what the attribution of a change says."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases that name a term, phrases that claim a cause, and words of direction.
PHRASES = {
    "water_inj_res": ["water injection", "injected water", "water inj", "injection water"],
    "gas_inj_res": ["gas injection", "injected gas", "gas inj"],
    "oil_res": ["oil production", "oil rate", "oil volume", "produced oil"],
    "water_res": ["water production", "water cut", "produced water", "water rate"],
    "free_gas_res": ["free gas", "gas production", "produced gas", "gas rate"],
}
CAUSES = ["driven by", "drove", "due to", "because of", "caused by", "cause of", "main", "primary", "dominant", "key driver", "responsible for", "attributable to", "explained by", "the driver", "result of"]
UP = ["increase", "increased", "higher", "rise", "rose", "up", "drove up", "raised"]
DOWN = ["decrease", "decreased", "lower", "fell", "drop", "dropped", "down", "reduced"]
#: A term below this share of the change may not be called its cause.
LEAST_SHARE = 0.10


def _any(text: Column, phrases: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in phrases])


def _said_of(term: str, phrases: list[str], low: Column, clauses: Column, least: float) -> Column:
    """What an answer says of a term: whether it is named, and the kind of its violation, if any."""
    own = F.get(F.filter("drivers", lambda d: d["term"] == term), F.lit(0))
    about = F.filter(clauses, lambda c: _any(c, phrases))
    moved = F.coalesce(own["delta"], own["contribution"])
    wrong = F.exists(about, lambda c: (_any(c, UP) & ~_any(c, DOWN) & (moved < 0)) | (_any(c, DOWN) & ~_any(c, UP) & (moved > 0)))
    claimed = F.exists(about, lambda c: _any(c, CAUSES))
    kind = F.when(own.isNull() | ((own["share"] < least) & claimed), "unsupported_driver").when(wrong, "wrong_direction")
    return F.struct(F.lit(term).alias("term"), _any(low, phrases).alias("named"), kind.alias("kind"))


def checked(answers: DataFrame, least: float = LEAST_SHARE) -> DataFrame:
    """answers (answer, drivers: array of term, share, contribution, delta; other columns stay) with `violations`, an array of (kind,
    term), `supported` and `faithful`.

    A term that is named must be among the drivers; one of less than the least share may not be given as a cause; and a clause
    that says which way it moved must agree with its own change. Without drivers nothing can be contradicted; a null answer names
    nothing.
    """
    low = F.lower(F.coalesce("answer", F.lit("")))
    clauses = F.split(low, r"[.,;:!?\n]|\band\b|\bwhile\b|\bwhereas\b")
    kinds = []
    for term, phrases in PHRASES.items():
        kinds.append(_said_of(term, phrases, low, clauses, least))
    x = answers.withColumn("_said", F.when(F.size("drivers") > 0, F.array(*kinds)).otherwise(F.array().cast("array<struct<term: string, named: boolean, kind: string>>")))
    violations = F.transform(F.filter("_said", lambda s: s["named"] & s["kind"].isNotNull()), lambda s: F.struct(s["kind"].alias("kind"), s["term"].alias("term")))
    supported = F.transform(F.filter("_said", lambda s: s["named"] & (F.coalesce(s["kind"], F.lit("")) != "unsupported_driver")), lambda s: s["term"])
    return x.withColumn("violations", violations).withColumn("supported", supported).withColumn("faithful", F.size("violations") == 0).drop("_said")
