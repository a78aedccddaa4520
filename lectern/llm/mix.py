"""Sources mixed to target shares of the total size in tokens.

A source's budget is its share of the total. As many whole copies as the
budget holds, up to the source's cap, are certain; the rest of the budget is
drawn by Pareto order sampling: documents have a chance of inclusion that is
proportional to their size, rank by the odds of a random number over the odds
of inclusion, and the lowest ranks fill the size that is left. The report has
the share that each source reaches, and the gaps.

Documents of sources without a target count in the total only. Null and empty
texts have no size: they come along with their source's whole copies. A source
without documents, or an empty table, gives a report row with nothing taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle
from .lowest import MAX_GROUPS, take_lowest, uniform


def plan(sizes: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """A row per source: target_share, max_repeats, documents, available and
    budget tokens, whole copies, rest (tokens to draw beside them), reachable
    tokens. sizes: source, n_tokens."""
    spark = sizes.sparkSession
    listed = targets.select("source", "target_share", "max_repeats").where("source is not null").limit(MAX_GROUPS + 1).collect()
    if len(listed) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} sources")
    wanted = spark.createDataFrame([(r["source"],) for r in listed], "source string").withColumn("listed", F.lit(True))
    counted = (
        sizes.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("k"))
        .join(F.broadcast(wanted), "source", "left")
        .groupBy(F.when(F.col("listed"), F.col("source")).alias("source"))
        .agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
        .collect()
    )
    have = {r["source"]: r["n"] or 0 for r in counted}
    count = {r["source"]: r["k"] for r in counted}
    total = sum(have.values()) if total is None else total
    out = []
    for r in listed:
        n, budget, cap = have.get(r["source"], 0), r["target_share"] * total, r["max_repeats"] or 0
        copies = min(cap, int(budget // n)) if n else 0
        rest = budget - copies * n if n and copies < cap else 0.0
        out.append((r["source"], r["target_share"], cap, count.get(r["source"], 0), n, budget, copies, rest, min(budget, float(n * cap))))
    return spark.createDataFrame(
        out, "source string, target_share double, max_repeats int, documents long, available long, budget double, copies int, rest double, reachable double"
    )


def inclusion(sizes: DataFrame, report: DataFrame, weight: str) -> DataFrame:
    """(source, factor): the chance of one more copy of a document is its weight
    times its source's factor, at most 1, such that the expected size of what is
    drawn is the source's rest. Documents whose chance would exceed 1 are set
    apart in ranges of weights, so one aggregation serves all rounds of it."""
    open_sources = report.where("rest > 0").select("source", "rest")
    rows = sizes.join(F.broadcast(open_sources), "source").where(F.col(weight) > 0)
    ranges = rows.groupBy("source", "rest", F.floor(F.log2(weight) * 8).alias("at")).agg(
        F.sum("n_tokens").cast("double").alias("size"), F.sum(F.col(weight).cast("double") * F.col("n_tokens")).alias("both"), F.max(weight).cast("double").alias("most")
    )
    above = Window.partitionBy("source").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("source").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    tried = ranges.select("source", "at", "most", ((F.col("rest") - F.coalesce(F.sum("size").over(above), F.lit(0.0))) / F.sum("both").over(upto)).alias("factor"))
    fits = tried.where("factor > 0 and factor * most <= 1").groupBy("source").agg(F.max_by("factor", "at").alias("factor"))
    return open_sources.select("source").join(fits, "source", "left").select("source", F.coalesce("factor", F.lit(1e9)).alias("factor"))


def mix(sizes: DataFrame, key: str, report: DataFrame, weight: str = "n_tokens", seed: int = 0) -> DataFrame:
    """(key, source, n_tokens, repeats): how often each document is used.

    The chance of one more copy is proportional to the document's weight, its
    size unless another column is named. sizes must be settled: it is read for
    the chances and for the draw.
    """
    factor = inclusion(sizes, report, weight)
    p = F.least(F.greatest(F.coalesce("factor", F.lit(0.0)) * F.col(weight), F.lit(1e-9)), F.lit(1 - 1e-9))
    u = uniform(key, seed=seed)
    about = settle(report.select("source", "copies", "rest").join(factor, "source", "left"), "chances")
    docs = sizes.join(F.broadcast(about), "source").select(
        key, "source", F.col("n_tokens").cast("double").alias("n_tokens"), ((u / (1 - u)) / (p / (1 - p))).alias("_rank"), "copies"
    )
    quotas = report.where("rest > 0").select("source", F.col("rest").alias("quota"))
    drawn = take_lowest(docs.drop("copies"), ["source"], "_rank", "n_tokens", quotas).select(key, "source", "n_tokens", F.lit(1).alias("times"))
    certain = docs.where("copies > 0").select(key, "source", "n_tokens", F.col("copies").alias("times"))
    return certain.unionByName(drawn).groupBy(key, "source", "n_tokens").agg(F.sum("times").cast("int").alias("repeats"))


def reached(mixed: DataFrame, report: DataFrame) -> DataFrame:
    """The report with the tokens taken, the share of the mixture, and the gap to
    the budget; short only if the gap is one of supply, not of whole documents."""
    taken = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).cast("long").alias("taken"), F.max("repeats").alias("most_repeats"))
    out = report.join(taken, "source", "left").fillna(0, ["taken", "most_repeats"])
    out = out.withColumn("gap", F.greatest(F.lit(0.0), F.col("budget") - F.col("taken")))
    out = out.withColumn("short", (F.col("gap") > 0) & (F.col("available") * F.col("max_repeats") < F.col("budget")))
    everything = out.agg(F.sum("taken").alias("all_taken"))
    return out.crossJoin(F.broadcast(everything)).withColumn("share", F.try_divide(F.col("taken"), F.col("all_taken"))).drop("all_taken")
