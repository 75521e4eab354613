"""Row numbers and running sums over groups of any size: inside parts of a group, and over the parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def place_in(df: DataFrame, by: list[str], part: Column, order: list, name: str = "place") -> DataFrame:
    """``df`` with the row number of each row in its group, counted from 1. ``part`` cuts a group into parts in the order of
    ``order`` (its leading digits, say), so a hot group is sorted by many tasks; only one row a part is sorted by group."""
    cut = df.withColumn("__part", part)
    inside = cut.withColumn(name, F.row_number().over(W.partitionBy(*by, "__part").orderBy(*order)))
    counts = cut.groupBy(*by, "__part").agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(W.partitionBy(*by).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in (*by, "__part")]
    joined = inside.alias("x").join(before.alias("y"), same)
    return joined.select(*[F.col(f"x.{c}") for c in df.columns], (F.col(f"x.{name}") + F.col("y.__before")).alias(name))
