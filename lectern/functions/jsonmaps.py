"""Percentages as JSON text, and numbers typed by people or models."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lenient_map(text: Column) -> Column:
    """map<string,string> of a JSON object; anything else gives an empty map."""
    return F.coalesce(F.from_json(text, "map<string,string>"), F.expr("cast(map() as map<string,string>)"))


def strict_map(text: Column) -> Column:
    """map<string,double>; null and '' give an empty map, other malformed text ends the job."""
    filled = F.when(F.coalesce(text, F.lit("")) == "", F.lit("{}")).otherwise(text)
    return F.from_json(filled, "map<string,double>", {"mode": "FAILFAST"})


def map_text(m: Column) -> Column:
    return F.coalesce(F.to_json(m), F.lit("{}"))


def lenient_number(text: Column) -> Column:
    """A double, or null for what isn't a number; NaN counts as none, a type letter isn't accepted."""
    plain = F.trim(text)
    value = F.when(~plain.rlike(r"(?i)[df]$"), plain.try_cast("double"))
    return F.when(~F.isnan(value), value)


def strict_number(text: Column) -> Column:
    """0 for null and ''; other text that isn't a number ends the job."""
    return F.coalesce(F.nullif(F.trim(text), F.lit("")).cast("double"), F.lit(0.0))


def strict_int(text: Column) -> Column:
    """Null for null and ''; '1.0' is 1; other text ends the job."""
    return F.nullif(F.trim(text), F.lit("")).cast("double").cast("int")


def maps_agree(a: Column, b: Column, tolerance: float = 1.0) -> Column:
    """Whether all keys of either map differ by no more than the tolerance, an absent one being 0."""
    at = lambda m, k: F.coalesce(F.try_element_at(m, k), F.lit(0.0))
    keys = F.array_union(F.coalesce(F.map_keys(a), F.array().cast("array<string>")), F.coalesce(F.map_keys(b), F.array().cast("array<string>")))
    return F.forall(keys, lambda k: F.abs(at(a, k) - at(b, k)) <= tolerance)


def missing_keys(json_object: Column, required: list[str]) -> Column:
    """Required keys that a JSON object lacks, sorted; all of them if it is no object."""
    have = F.coalesce(F.json_object_keys(json_object), F.array().cast("array<string>"))
    return F.array_sort(F.array_except(F.array(*[F.lit(k) for k in required]), have))
