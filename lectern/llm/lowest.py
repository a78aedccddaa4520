"""The rows of lowest keys up to a quota in each group, without sorting groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most groups whose quotas are sent to every worker.
MAX_GROUPS = 100_000
BUCKETS = 4096


def uniform(*columns: str, seed: int = 0) -> Column:
    """A number in (0, 1) that depends on the columns' values and the seed only."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11)
    return (bits.cast("double") + 0.5) / float(1 << 53)


def take_lowest(rows: DataFrame, group: list[str], key: str, size: str, quotas: DataFrame) -> DataFrame:
    """The rows of lowest key (a double from 0 on) in each group, as long as
    their running size stays nearest to the group's quota.

    quotas: group and quota, at most MAX_GROUPS rows, not null. Keys are
    counted in BUCKETS ranges per group; whole ranges are taken or left, and
    only the range in which the quota ends is sorted, so no task sees a group.
    """
    if quotas.count() > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} groups")
    placed = rows.withColumn("_bucket", F.floor(F.col(key) / (F.col(key) + 1) * BUCKETS).cast("int"))
    sums = placed.groupBy(*group, "_bucket").agg(F.sum(size).cast("double").alias("_sum"))
    upto = Window.partitionBy(*group).orderBy("_bucket")
    ends = (
        sums.join(F.broadcast(quotas), group)
        .withColumn("_running", F.sum("_sum").over(upto))
        .groupBy(*group)
        .agg(
            F.first("quota").alias("_quota"),
            F.min(F.when(F.col("_running") > F.col("quota"), F.col("_bucket"))).alias("_end"),
            F.coalesce(F.max(F.when(F.col("_running") <= F.col("quota"), F.col("_running"))), F.lit(0.0)).alias("_before"),
        )
    )
    met = placed.join(F.broadcast(ends), group)
    whole = met.where(F.col("_end").isNull() | (F.col("_bucket") < F.col("_end")))
    edge = met.where(F.col("_bucket") == F.col("_end")).withColumn(
        "_running", F.sum(F.col(size).cast("double")).over(Window.partitionBy(*group).orderBy(F.col(key), *[c for c in rows.columns if c != key]).rowsBetween(Window.unboundedPreceding, 0))
    )
    cut = edge.where(F.col("_before") + F.col("_running") - F.col(size) / 2 <= F.col("_quota"))
    return whole.select(*rows.columns).unionByName(cut.select(*rows.columns))
