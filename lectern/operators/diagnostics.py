"""Counts that show what filters keep and leave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def funnel(rows: DataFrame, predicates: dict[str, Column], population: int | None = None) -> DataFrame:
    """One row: total, rows that meet each predicate and all of them, their
    percentage and, for a population the rows were drawn from, its estimate to hundreds."""
    every = F.lit(True)
    for p in predicates.values():
        every = every & F.coalesce(p, F.lit(False))
    out = rows.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(p).alias(n) for n, p in predicates.items()], F.count_if(every).alias("all_of_them"))
    out = out.withColumn("all_pct", F.try_divide(F.lit(100.0) * F.col("all_of_them"), F.col("total")))
    if population is not None:
        out = out.withColumn("estimate", F.bround(F.try_divide(F.col("all_of_them") * F.lit(float(population)), F.col("total")), -2))
    return out


def cumulative(rows: DataFrame, predicates: list[tuple[str, Column]]) -> DataFrame:
    """One row: the rows that meet the first predicate, the first two, and so on, in one pass."""
    so_far, columns = F.lit(True), []
    for name, p in predicates:
        so_far = so_far & F.coalesce(p, F.lit(False))
        columns.append(F.count_if(so_far).alias(name))
    return rows.agg(*columns)


def histogram(rows: DataFrame, value: Column, missing: str = "NONE") -> DataFrame:
    """(bucket, n), null values under `missing`, sorted as text."""
    return rows.groupBy(F.coalesce(value.cast("string"), F.lit(missing)).alias("bucket")).agg(F.count(F.lit(1)).alias("n")).orderBy("bucket")


def conditional_counts(rows: DataFrame, group: str, conditions: dict[str, Column]) -> DataFrame:
    """Per group that isn't null: n and the rows that meet each condition."""
    return rows.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(k) for k, c in conditions.items()])


def frequency(rows: DataFrame, column: str) -> DataFrame:
    """(column, n), most frequent first, null included."""
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def corpus_report(parsed: DataFrame, population: int) -> tuple[DataFrame, DataFrame]:
    """Of parsed articles (struct article): the inclusion funnel, estimated for
    a population, and the subfields by frequency. Files that don't parse are left out."""
    from .index import criteria

    rows = parsed.where("article.error is null").select("article.*")
    c = criteria(journal=F.col("journal"), article_type=F.col("article_type"), date=F.col("publication_date"), subfields=F.col("psychology_subfields"))
    return funnel(rows, c, population), frequency(rows.select(F.explode("psychology_subfields").alias("subfield")), "subfield")


def dates_report(parsed: DataFrame) -> DataFrame:
    """Articles by year, undated ones under NONE; files that don't parse are left out."""
    return histogram(parsed.where("article.error is null"), F.year("article.publication_date"))


def subjects_report(parsed: DataFrame, node: str = "Psychology") -> DataFrame:
    """Per year: articles, those with the node, those with a subject that holds
    its stem, and those without subjects; undated ones are left out."""
    rows = parsed.where("article.error is null").select(F.year("article.publication_date").alias("year"), "article.subject", "article.psychology_subfields")
    stem = node[:5].lower()
    conditions = {
        "n_node": F.size("psychology_subfields") > 0,
        "n_stem": F.exists("subject", lambda x: F.contains(F.lower(x), F.lit(stem))),
        "n_without": F.size("subject") == 0,
    }
    return conditional_counts(rows, "year", conditions).orderBy("year")
