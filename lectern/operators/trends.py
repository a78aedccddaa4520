"""Reporting rates, subgroup means and value shares by year and stage.

Rows of a null group are left out; a null flag stays in a rate's denominator
but not in a share's. Percentages that aren't numbers are skipped by mean and
count. One pass gives all categories and both groups, by grouping sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.jsonmaps import lenient_map, lenient_number
from ..functions.stages import stage_rank
from .score import CATEGORIES


def reporting_rate(facts: DataFrame, flag: str, group: str) -> DataFrame:
    """(group, reporting_rate_pct)"""
    rate = F.lit(100.0) * F.count_if(F.col(flag) == 1) / F.count(F.lit(1))
    return facts.where(F.col(group).isNotNull()).groupBy(group).agg(rate.alias("reporting_rate_pct"))


def _as_map(facts: DataFrame, column: str) -> Column:
    return lenient_map(F.col(column)) if dict(facts.dtypes)[column] == "string" else F.col(column).cast("map<string,string>")


def subgroup_means(facts: DataFrame, flag: str, pct: str, group: str) -> DataFrame:
    """(group, subgroup, mean_pct, n) over the rows that report; n counts numbers only."""
    wide = facts.where((F.col(flag) == 1) & F.col(group).isNotNull()).select(group, F.explode(_as_map(facts, pct)).alias("subgroup", "_text"))
    value = lenient_number(F.col("_text"))
    return wide.select(group, "subgroup", value.alias("_v")).groupBy(group, "subgroup").agg(F.avg("_v").alias("mean_pct"), F.count("_v").alias("n"))


def value_share(facts: DataFrame, value: str, group: str) -> DataFrame:
    """(group, value, share_pct) of the values that aren't null."""
    counts = facts.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("_n"))
    return counts.select(group, value, (F.lit(100.0) * F.col("_n") / F.sum("_n").over(Window.partitionBy(group))).alias("share_pct"))


def all_rates(facts: DataFrame, groups: tuple[str, ...] = ("year", "stage")) -> DataFrame:
    """(category, group_by, group_value, reporting_rate_pct): every category and
    group in one pass, each task combining its rows before the shuffle."""
    rows = facts.select(
        F.explode(F.array(*[F.struct(F.lit(g).alias("group_by"), F.col(g).cast("string").alias("group_value")) for g in groups])).alias("_g"),
        *[F.col(f).alias(f) for f, _ in CATEGORIES.values()],
    ).where("_g.group_value is not null")
    counts = rows.groupBy("_g.group_by", "_g.group_value").agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(f) == 1).alias(c) for c, (f, _) in CATEGORIES.items()])
    pairs = F.array(*[F.struct(F.lit(c).alias("category"), (F.lit(100.0) * F.col(c) / F.col("_n")).alias("reporting_rate_pct")) for c in CATEGORIES])
    return counts.select("group_by", "group_value", F.inline(pairs)).select("category", "group_by", "group_value", "reporting_rate_pct")


def all_means(facts: DataFrame, groups: tuple[str, ...] = ("year", "stage")) -> DataFrame:
    """(category, group_by, group_value, subgroup, mean_pct, n) in one pass."""
    maps = F.array(*[F.struct(F.lit(c).alias("category"), F.col(f).alias("flag"), _as_map(facts, p).alias("pct")) for c, (f, p) in CATEGORIES.items()])
    rows = facts.select(*groups, F.inline(maps)).where("flag = 1").select(*groups, "category", F.explode("pct").alias("subgroup", "_text"))
    rows = rows.select(
        F.explode(F.array(*[F.struct(F.lit(g).alias("group_by"), F.col(g).cast("string").alias("group_value")) for g in groups])).alias("_g"),
        "category", "subgroup", lenient_number(F.col("_text")).alias("_v"),
    ).where("_g.group_value is not null")
    return rows.groupBy("category", F.col("_g.group_by").alias("group_by"), F.col("_g.group_value").alias("group_value"), "subgroup").agg(F.avg("_v").alias("mean_pct"), F.count("_v").alias("n"))


def in_order(rows: DataFrame, group: str) -> DataFrame:
    """Sorted by the group; stages by time, unknown ones as null at the end."""
    if group != "stage":
        return rows.orderBy(group)
    rank = stage_rank(F.col("stage"))
    return rows.withColumn("stage", F.when(rank.isNotNull(), F.col("stage"))).orderBy(stage_rank(F.col("stage")).asc_nulls_last())


def export(facts: DataFrame, folder: str, groups: tuple[str, ...] = ("year", "stage")) -> list[str]:
    """One CSV folder per category, metric and group, and two for socioeconomic status; each is small."""
    written = []
    for group in groups:
        tables = {f"ses_by_{group}": value_share(facts, "ses_reported", group)}
        for c, (flag, pct) in CATEGORIES.items():
            tables[f"{c}_reporting_rate_by_{group}"] = reporting_rate(facts, flag, group)
            tables[f"{c}_mean_pct_by_{group}"] = subgroup_means(facts, flag, pct, group)
        for name, rows in tables.items():
            in_order(rows, group).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/{name}.csv")
            written.append(f"{folder}/{name}.csv")
    return written


def plot(rates: DataFrame, group: str, path: str) -> bool:
    """A line of the rates; False if matplotlib is missing or there is nothing to draw. rates has a row per group."""
    try:
        from matplotlib import pyplot
    except ImportError:
        return False
    rows = in_order(rates, group).collect()
    if not rows:
        return False
    figure, axes = pyplot.subplots()
    axes.plot([str(r[group]) for r in rows], [r["reporting_rate_pct"] for r in rows], marker="o")
    axes.set_ylim(0, 100)
    figure.savefig(path)
    pyplot.close(figure)
    return True
