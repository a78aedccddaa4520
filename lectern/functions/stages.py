"""Time stages of publication years."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stages with their first and last year.
STAGES = (("early", 2010, 2014), ("middle", 2015, 2019), ("covid", 2020, 2023), ("post_covid", 2024, 2026))


def stage_of_year(year: Column, stages: Sequence[tuple[str, int, int]] = STAGES) -> Column:
    """The first stage whose years hold the year, else null."""
    return F.coalesce(*[F.when(year.between(a, b), name) for name, a, b in stages], F.lit(None).cast("string"))


def stage_of_date(date: Column, stages: Sequence[tuple[str, int, int]] = STAGES) -> Column:
    return stage_of_year(F.year(date), stages)


def stage_rank(stage: Column, stages: Sequence[tuple[str, int, int]] = STAGES) -> Column:
    """Place of a stage in time, from 1; null if it is none. Sort it with nulls last."""
    return F.nullif(F.array_position(F.array(*[F.lit(s[0]) for s in stages]), stage).cast("int"), F.lit(0))
