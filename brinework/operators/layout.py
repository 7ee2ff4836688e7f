"""Schematic placement of a pattern's completions: injectors in the middle, producers around them by allocation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Shapes and angles (degrees clockwise from north) by number of producers, and radii.
SHAPES = {2: "line_drive", 3: "triangular", 4: "five_spot", 6: "seven_spot", 8: "nine_spot"}
FIRST_ANGLE = {2: 90.0, 4: 45.0}
NEAR, FAR, HALF_WIDTH = 0.62, 0.98, 100.0
NAME_WIDTH, VALUE_LINE, MARGIN = 5.1, 14 * 4.9, 6.0


def geometry(injectors: Column, producers: Column) -> Column:
    named = F.element_at(F.create_map(*[x for k, v in SHAPES.items() for x in (F.lit(k), F.lit(v))]), producers.cast("int"))
    return F.when(injectors == 0, "no_injector").when(injectors > 1, "multi_injector").otherwise(F.coalesce(named, F.lit("irregular")))


def placed(completions: DataFrame, n_patterns: DataFrame) -> DataFrame:
    """completions (see tools.completions, with completion_name) with geometry, ring, x, y, size, shared and low_confidence.

    Of each pattern month one injector stands in the centre, several on a ring wide enough for their names; producers stand
    outside, nearer the larger their factor, the largest contributor first, on the angles of a named shape where there is one
    injector; idle completions stand on the rim. n_patterns: (id_completion, n_patterns)."""
    c = F.col
    month = Window.partitionBy("id_pattern", "vrr_date")
    x = completions.join(n_patterns, "id_completion", "left").withColumn("share", F.when(c("role") == "injector", c("share_of_injection")).otherwise(c("share_of_production")))
    ring = Window.partitionBy("id_pattern", "vrr_date", "role").orderBy(F.when(c("role") != "idle", -F.coalesce("share", F.lit(0.0))), F.col("id_completion").cast("string"))
    x = x.withColumn("ring", F.row_number().over(ring) - 1)
    for role in ("injector", "producer", "idle"):
        x = x.withColumn(f"n_{role}", F.count_if(c("role") == role).over(month))
    name = F.length(F.substring(F.coalesce(c("completion_name"), c("id_completion").cast("string")), 1, 14))
    longest = F.coalesce(F.max(F.when(c("role") == "injector", name)).over(month), F.lit(0))
    needed = F.greatest(longest * NAME_WIDTH, F.lit(VALUE_LINE)) + MARGIN
    by_label = needed / (2 * F.sin(F.lit(3.141592653589793) / F.greatest(c("n_injector"), F.lit(1)))) / 100
    x = x.withColumn("hub", F.when(c("n_injector") <= 1, 0.0).otherwise(F.greatest(0.17 + 0.085 * (c("n_injector") - 1), by_label)))
    x = x.withColumn("geometry", geometry(c("n_injector"), c("n_producer"))).withColumn("factor", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("factor", F.lit(1.0)))), 4))
    first = F.coalesce(F.element_at(F.create_map(*[v for k, a in FIRST_ANGLE.items() for v in (F.lit(k), F.lit(a))]), c("n_producer").cast("int")), F.lit(0.0))
    start = F.when((c("role") == "producer") & (c("n_injector") == 1), first).when(c("role") == "idle", 22.5).otherwise(0.0)
    count = F.when(c("role") == "injector", c("n_injector")).when(c("role") == "producer", c("n_producer")).otherwise(c("n_idle"))
    angle = F.radians(start + c("ring") * 360.0 / count)
    near, far = NEAR + c("hub") * 0.9, FAR + c("hub") * 0.9
    radius = F.when(c("role") == "injector", c("hub")).when(c("role") == "producer", far - (far - near) * c("factor")).otherwise(far + 0.14) * HALF_WIDTH
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("share", F.lit(0.0))))
    return x.withColumns({
        "x": F.round(radius * F.sin(angle), 2), "y": F.round(-radius * F.cos(angle), 2), "size": F.round(0.45 + 0.55 * F.sqrt(share), 3),
        "shared": F.coalesce("n_patterns", F.lit(1)) > 1, "low_confidence": F.contains(F.coalesce("pvt_methods", F.lit("")), F.lit("extrapolated")),
    })


def drawing(nodes: DataFrame) -> DataFrame:
    """A row for each pattern month of placed completions: geometry, counts, the radius of the hub from which sweep lines start, one line to
    each producer (which injector feeds it is not known), the shared and doubtful completions, and a caption that says the counts."""
    c = F.col
    name = F.coalesce(c("completion_name"), c("id_completion").cast("string"))
    line = F.when(c("role") == "producer", F.struct(c("ring"), c("id_completion").alias("to"), c("factor"), F.coalesce("share_of_production", F.lit(0.0)).alias("share_of_production")))
    names = lambda flag: F.array_sort(F.collect_list(F.when(c(flag), name)))
    x = nodes.groupBy("id_pattern", "vrr_date").agg(
        F.max("geometry").alias("geometry"), *[F.max(f"n_{r}").alias(f"n_{r}") for r in ("injector", "producer", "idle")], F.round(F.max("hub") * HALF_WIDTH, 2).alias("hub_radius"),
        F.array_sort(F.collect_list(line)).alias("links"), names("shared").alias("shared"), names("low_confidence").alias("low_confidence"),
    )
    said = [F.concat(c(f"n_{r}").cast("string"), F.lit(f" {r}"), F.when(c(f"n_{r}") == 1, "").otherwise("s")) for r in ("injector", "producer")]
    idle = F.when(c("n_idle") > 0, F.concat(F.lit(", "), c("n_idle").cast("string"), F.lit(" idle"))).otherwise("")
    return x.withColumn("caption", F.concat(F.regexp_replace("geometry", "_", " "), F.lit(": "), said[0], F.lit(", "), said[1], idle, F.lit("; a scheme, not a map")))
