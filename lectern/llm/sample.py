"""A sample whose shares of each stratum follow given targets.

The strata's sizes are raked to the targets' margins (stage and subfield) by
iterative proportional fitting, each stratum held to what it has; the fitted
sizes give whole quotas and the rows' weights. Rows have exponential keys
-ln(u)/weight with u from a hash of the key, and the lowest keys up to the
quota are drawn. Strata under their minimum are repaired from those with most
to spare; what can't be met is reported.

Rows whose stage or subfield is null or blank belong to no stratum. A key that
occurs repeatedly counts once in each of its strata. An empty table gives an
empty sample and a report in which every stratum that asks for rows is short.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lowest import MAX_GROUPS, take_lowest, uniform

ROUNDS, CLOSE = 500, 1e-9


def folded(column: str) -> Column:
    """Without letter case and outer blanks; null if nothing is left."""
    bare = F.lower(F.regexp_replace(F.col(column), r"(?U)^\s+|\s+$", ""))
    return F.when(bare != "", bare)


def members(rows: DataFrame, key: str, margins: list[str]) -> DataFrame:
    """(key, margins): each key once in each of its strata. The combination of
    repeats begins on the map side, so a hot stratum is no hot group."""
    names = {m: folded(m) for m in margins}
    return rows.select(key, *[c.alias(m) for m, c in names.items()]).dropna(subset=[key, *margins]).distinct()


def rake(sizes: dict, wanted: dict, margins: int) -> dict:
    """Fitted size of each stratum: as wanted, held to its size, and scaled
    along each margin in turn until the margins' wanted sums are met or can't be."""
    sums = [{} for _ in range(margins)]
    for c, w in wanted.items():
        for i in range(margins):
            sums[i][c[i]] = sums[i].get(c[i], 0.0) + w
    fitted = {c: min(w, float(sizes.get(c, 0))) for c, w in wanted.items()}
    for _ in range(ROUNDS):
        most = 0.0
        for i in range(margins):
            have = {}
            for c, x in fitted.items():
                have[c[i]] = have.get(c[i], 0.0) + x
            for c, x in fitted.items():
                if x > 0 and have[c[i]] > 0:
                    y = min(x * sums[i][c[i]] / have[c[i]], float(sizes.get(c, 0)))
                    most, fitted[c] = max(most, abs(y - x)), y
        if most < CLOSE:
            break
    return fitted


def whole_quotas(sizes: dict, fitted: dict, least: dict, total: int) -> dict:
    """Whole quotas near the fitted sizes that add up to total if they can,
    with minimums repaired from the strata that have most above theirs."""
    quota = {c: min(math.floor(x + CLOSE), sizes.get(c, 0)) for c, x in fitted.items()}
    by_rest = sorted(fitted, key=lambda c: (quota[c] - fitted[c], c))
    while (open_rows := total - sum(quota.values())) > 0:
        room = [c for c in by_rest if quota[c] < sizes.get(c, 0)]
        if not room:
            break
        for c in room[:open_rows]:
            quota[c] += 1
    floor = {c: min(least[c], sizes.get(c, 0)) for c in quota}
    for c in quota:
        quota[c] = max(quota[c], floor[c])
    import heapq

    spare = [(floor[c] - q, c) for c, q in quota.items() if q > floor[c]]
    heapq.heapify(spare)
    excess = sum(quota.values()) - total
    while excess > 0 and spare:
        s, c = heapq.heappop(spare)
        quota[c], excess = quota[c] - 1, excess - 1
        if s + 1 < 0:
            heapq.heappush(spare, (s + 1, c))
    return quota


def plan(rows: DataFrame, key: str, margins: list[str], targets: DataFrame, fraction: float = 0.2, size: int | None = None) -> DataFrame:
    """A row per target stratum: margins as in targets, target_share, min_rows,
    available, wanted, fitted, quota.

    The driver holds the targets and one count per stratum.
    """
    spark = rows.sparkSession
    listed = targets.select(*margins, *[folded(m).alias(f"_{m}") for m in margins], "target_share", "min_rows").limit(MAX_GROUPS + 1).collect()
    if len(listed) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} strata")
    cells = members(rows, key, margins)
    names = spark.createDataFrame([tuple(r[f"_{m}"] for m in margins) for r in listed], ", ".join(f"{m} string" for m in margins))
    counted = cells.join(F.broadcast(names.distinct()), margins).groupBy(*margins).agg(F.count(F.lit(1)).alias("n")).collect()
    sizes = {tuple(r[m] for m in margins): r["n"] for r in counted}
    total = cells.select(key).distinct().count()
    size = math.floor(total * fraction + 1e-9) if size is None else size
    cell = {tuple(r[f"_{m}"] for m in margins): r for r in listed}
    wanted = {c: (r["target_share"] or 0.0) * size for c, r in cell.items()}
    least = {c: r["min_rows"] or 0 for c, r in cell.items()}
    fitted = rake(sizes, wanted, len(margins))
    quota = whole_quotas(sizes, fitted, least, size)
    out = []
    for c, r in cell.items():
        out.append((*[r[m] for m in margins], r["target_share"], r["min_rows"], sizes.get(c, 0), wanted[c], fitted[c], quota[c]))
    schema = ", ".join(f"{m} string" for m in margins)
    return spark.createDataFrame(out, f"{schema}, target_share double, min_rows int, available long, wanted double, fitted double, quota long")


def reached(planned: DataFrame, sample: DataFrame, margins: list[str]) -> DataFrame:
    """The plan with the rows drawn, the residual gap to target and minimum,
    and whether it is one of supply (short): strata without a gap had enough
    rows, and of the others those are short whose rows are fewer than the
    target or the minimum asks for; the rest of the gaps is rounding, or what
    minimums elsewhere have taken."""
    drawn = sample.groupBy(*margins).agg(F.count(F.lit(1)).alias("drawn"))
    asked = F.greatest(F.col("wanted"), F.coalesce("min_rows", F.lit(0)).cast("double"))
    out = planned.join(drawn, margins, "left").fillna(0, ["drawn"]).withColumn("gap", F.greatest(F.lit(0.0), asked - F.col("drawn")))
    return out.withColumn("short", (F.col("gap") > 0) & (F.col("available") < asked))


def draw(rows: DataFrame, key: str, margins: list[str], planned: DataFrame, seed: int = 0) -> DataFrame:
    """(key, margins as in the plan) of the sample."""
    weights = planned.where("quota > 0").select(
        *margins, *[folded(m).alias(f"_{m}") for m in margins], "quota", (F.greatest("fitted", F.lit(0.5)) / F.col("available")).alias("_weight")
    )
    cells = members(rows, key, margins).select(key, *[F.col(m).alias(f"_{m}") for m in margins])
    keyed = cells.join(F.broadcast(weights), [f"_{m}" for m in margins]).select(key, *margins, (-F.log(uniform(key, seed=seed)) / F.col("_weight")).alias("_key"), F.lit(1).alias("_one"))
    return take_lowest(keyed, margins, "_key", "_one", weights.select(*margins, "quota")).select(key, *margins)
