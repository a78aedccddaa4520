"""Shards, systematic and stratified samples, first rows of groups."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle

#: Most strata whose draws the driver makes.
MAX_STRATA = 100_000


def numbered(rows: DataFrame, order: list[Column | str], name: str = "row_index") -> DataFrame:
    """Row numbers from 0 in a total order, without a single task that gets all
    rows: the rows are range-sorted and settled (the ranges' bounds are sampled,
    so they must be drawn once), each range is counted, and the ranges' first
    numbers (one row per partition) are joined back."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_mono", F.monotonically_increasing_id())
    ranged = settle(ranged, "ranged")
    local = F.col("_mono") - F.shiftleft(F.col("_part").cast("long"), 33)
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return ranged.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + local).drop("_part", "_mono", "_start")


def shard(rows: DataFrame, index: int, count: int, order: list[Column | str]) -> DataFrame:
    """Rows whose number in the order is index modulo count; a count of 1 or less gives all."""
    return rows if count <= 1 else numbered(rows, order, "_row").where(F.col("_row") % count == index).drop("_row")


def hash_shard(rows: DataFrame, index: int, count: int, key: str) -> DataFrame:
    """The scalable shard: by the key's hash, no order and no shuffle."""
    return rows if count <= 1 else rows.where(F.pmod(F.xxhash64(key), F.lit(count)) == index)


def systematic(rows: DataFrame, size: int, order: list[Column | str]) -> DataFrame:
    """Every step-th row in the order, step being the rows over size, at least 1."""
    step = max(1, rows.count() // max(1, size))
    return numbered(rows, order, "_row").where(F.col("_row") % step == 0).drop("_row")


def first_n(rows: DataFrame, group: list[str], order: list[Column | str], n: int) -> DataFrame:
    """The first n rows of each group; Spark keeps n rows per group before the
    shuffle, so a hot group costs no more than others."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")


def first_seen(rows: DataFrame, tokens: Column, order: Column) -> DataFrame:
    """(token, seen): distinct tokens of the lists with the first (order, place) at which each occurs."""
    return (
        rows.select(order.alias("_order"), F.posexplode(tokens).alias("_pos", "token"))
        .groupBy("token")
        .agg(F.min(F.struct("_order", "_pos")).alias("seen"))
    )


def stratified_by_hash(rows: DataFrame, strata: Column, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows of lowest hash from each stratum with at least n rows, with a
    column subfield; strata is a list per row, so a row may be drawn twice."""
    wide = rows.withColumn("subfield", F.explode(strata)).withColumn("_draw", F.md5(F.concat(F.col(key), F.lit(f"|{seed}"))))
    # n rows at most are left of a stratum, so counting them costs nothing more
    drawn = first_n(wide, ["subfield"], ["_draw", key], n).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("subfield")))
    return drawn.where(F.col("_n") == n).drop("_draw", "_n")


def stratified_by_draw(rows: DataFrame, strata: Column, order: str, n: int, seed: int = 42, wanted: list[str] | None = None) -> DataFrame:
    """n rows of each stratum as one random generator draws them, stratum after
    stratum in first-seen order: only (stratum, size) comes to the driver, which
    draws places; the places are joined back to rows numbered by a range sort, so
    a stratum is no one task's. Strata with too few rows are left
    out and use no randomness; named ones (wanted) raise an error."""
    spark = rows.sparkSession
    wide = rows.withColumn("subfield", F.explode(F.array_distinct(strata)))
    seen = first_seen(rows, strata, F.col(order)).withColumnRenamed("token", "subfield")
    sizes = wide.groupBy("subfield").agg(F.count(F.lit(1)).alias("n")).join(seen, "subfield").orderBy("seen").limit(MAX_STRATA + 1).select("subfield", "n").collect()
    if len(sizes) > MAX_STRATA:
        raise ValueError(f"more than {MAX_STRATA} strata")
    size = {r["subfield"]: r["n"] for r in sizes}
    rng, drawn = random.Random(seed), []
    for name in wanted if wanted is not None else list(size):
        if size.get(name, 0) < n:
            if wanted is not None:
                raise ValueError(f"{name} has {size.get(name, 0)} rows, {n} are needed")
            continue
        drawn += [(name, p, len(drawn) + i) for i, p in enumerate(rng.sample(range(size[name]), n))]
    places = spark.createDataFrame(drawn or [("", -1, 0)], "subfield string, _place long, draw_no int")
    drawn_from = wide.join(F.broadcast(places.select("subfield").distinct()), "subfield")
    ranked = numbered(drawn_from, ["subfield", order], "_number")
    firsts = ranked.groupBy("subfield").agg(F.min("_number").alias("_first"))
    ranked = ranked.join(F.broadcast(firsts), "subfield").withColumn("_place", F.col("_number") - F.col("_first")).drop("_number", "_first")
    return ranked.join(F.broadcast(places), ["subfield", "_place"]).drop("_place")
