"""Places of rows in a sorted table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import kept


def placed(rows: DataFrame, name: str = "place") -> DataFrame:
    """Adds the place of each row, from 0, of a sorted table: its place in its partition, and the rows of the partitions before. No task sees more than a partition."""
    own = kept(rows.withColumn("_at", F.monotonically_increasing_id()))
    part, at = F.shiftright("_at", 33), F.col("_at").bitwiseAND(2**33 - 1)
    counts = own.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).drop("_n")  # a row for each partition
    joined = own.withColumn("_part", part).join(F.broadcast(before), "_part")
    return joined.withColumn(name, F.coalesce("_before", F.lit(0)) + at).drop("_part", "_at", "_before")
