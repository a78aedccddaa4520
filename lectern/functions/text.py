"""Texts: prompts, sections, captures and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words in the titles of the sections that are read first.
PRIORITY_WORDS = ("method", "participant", "sample", "procedure")
#: Of our own making; {doi} and {article_text} are filled in, other braces stay.
PROMPT = """Code the demographics of every participant sample in the article below.
For each sample say whether gender, race and education are reported (0 or 1) with
their percentages, and socioeconomic status as 0 (not reported), 1 (in words) or
2 (as a number). Answer with a JSON array only; each element has the keys doi,
sample_id, gender_reported, gender_pct, race_reported, race_pct,
education_reported, education_pct, ses_reported, ses_value.

Article DOI: {doi}

Article text:
{article_text}
"""


def contains_ci(text: Column, part: str) -> Column:
    """Whether the text has the part in any letter case; null counts as no."""
    return F.coalesce(F.contains(F.lower(text), F.lit(part.lower())), F.lit(False))


def build_prompt(doi: Column, text: Column, template: str = PROMPT) -> Column:
    """The template with both slots filled; braces in the values are text."""
    before, rest = template.split("{doi}")
    between, after = rest.split("{article_text}")
    return F.concat(F.lit(before), doi, F.lit(between), text, F.lit(after))


def doi_in_prompt(prompt: Column) -> Column:
    return F.regexp_extract(prompt, r"Article DOI:\s*(\S+)", 1)


def priority_first(sections: Column, is_priority) -> Column:
    """The sections that is_priority names, then the rest, each in order."""
    return F.concat(F.filter(sections, is_priority), F.filter(sections, lambda x: ~is_priority(x)))


def round_hundreds(number: Column) -> Column:
    """To hundreds, halves to even."""
    return F.bround(number, -2)


def round_3(number: Column) -> Column:
    """To three digits, halves to even in decimal; Python, which rounds the exact
    binary value, may differ in the last digit, so keep the unrounded number too."""
    return F.bround(number, 3)


def cut(text: Column, length: int) -> Column:
    return F.left(text, F.lit(length))
