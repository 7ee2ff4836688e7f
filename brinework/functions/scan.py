"""Running sums over a whole table without a task that sees all of its rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brinework.sources.store import written


def running_sums(df: DataFrame, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """df with, for each name of sums, the sum of its column over all rows before this one in `order`, which must be total. Rows are dealt
    to ranges of the order; what a range adds up to is summed over the ranges (as many as there are shuffle partitions), and then
    within each range."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = {name: f"_own_{i}" for i, name in enumerate(sums)}
    x = df.withColumns({own[name]: F.coalesce(value, F.lit(0)) for name, value in sums.items()})
    x = written(x.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ends = x.groupBy("_part").agg(*[F.sum(c).alias(c) for c in own.values()])
    starts = ends.select("_part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in own.values()])
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    x = x.join(F.broadcast(starts), "_part")  # a row for each shuffle partition
    return x.select(*df.columns, *[(F.col(f"{c}_before") + F.coalesce(F.sum(c).over(within), F.lit(0))).alias(name) for name, c in own.items()])
