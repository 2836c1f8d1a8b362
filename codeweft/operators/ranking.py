"""Ranks over a whole table without a single task that sees all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Scratch


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """df with the place of each row in the given order, from 1 on. Rows that tie in all of the order get places in any order.

    Rows are range-partitioned and sorted; the partitions' row counts, one number each, shift the
    places within them. An empty table gives no rows.
    """
    s = Scratch(df.sparkSession, "ranking")
    row, part = F.col("_row"), F.shiftright("_row", 33)
    placed = s.cut(df.orderBy(*order).withColumn("_row", F.monotonically_increasing_id()))  # partition in the upper bits, place in the lower 33
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n")).collect()  # as many rows as partitions
    before, shifts = 0, []
    for r in sorted(counts):
        shifts.append((r["_part"], before))
        before += r["n"]
    at = df.sparkSession.createDataFrame(shifts, "_part bigint, _before bigint")
    inside = row.bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.withColumn("_part", part).join(F.broadcast(at), "_part").withColumn(name, F.col("_before") + inside).drop("_row", "_part", "_before")
