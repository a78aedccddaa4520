"""Running a model client over articles, with strict validation and resuming.

A client's answer must be a JSON array of objects that all have the required
keys and the article's doi; else the article as a whole is an error, recorded
with its text. An empty array is a valid answer without rows. Ledgers hold one
row per article and run, so an article with no samples isn't run again.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..clients.base import ModelClient
from ..functions.text import build_prompt
from ..schemas import FACT_COLUMNS, REQUIRED_KEYS, RESULT
from ..session import ship


class ValidationError(ValueError):
    """An answer that isn't what was asked for."""


def validated(answer: str, doi: str) -> list[dict]:
    """The rows of a model's answer."""
    try:
        rows = json.loads(answer)
    except ValueError as e:
        raise ValidationError(f"the answer is not JSON: {e}") from e
    if not isinstance(rows, list):
        raise ValidationError("the answer is not an array")
    for i, row in enumerate(rows):
        if not isinstance(row, dict):
            raise ValidationError(f"element {i} is not an object")
        if lacking := sorted(set(REQUIRED_KEYS) - row.keys()):
            raise ValidationError(f"element {i} lacks {', '.join(lacking)}")
        if row["doi"] != doi:
            raise ValidationError(f"element {i} is about {row['doi']!r}, not {doi!r}")
    return rows


def _number(value) -> float | None:
    try:
        return float(value)
    except (TypeError, ValueError):
        return None


def typed(row: dict) -> dict:
    """A row in the types of the fact table; what has no such type is null."""
    out: dict = {"doi": row["doi"]}
    for k in REQUIRED_KEYS[1:]:
        v = row.get(k)
        if k.endswith("_pct"):
            out[k] = {str(a): _number(b) for a, b in v.items()} if isinstance(v, dict) else {}
        elif k == "ses_value":
            out[k] = v if v is None or isinstance(v, str) else json.dumps(v)
        else:
            n = _number(v)
            out[k] = None if n is None else int(n)
    return out


def answers_of(client: ModelClient, prompts: list[str]) -> list[str | Exception]:
    """An answer or an error for each prompt. A batch that fails, or that comes
    back with more or fewer answers than prompts, is halved until what fails is
    a prompt by itself: one article's failure is no other's."""
    try:
        got = list(client.generate_batch(prompts))
        if len(got) != len(prompts):
            raise ValidationError(f"{len(got)} answers to {len(prompts)} prompts")
        return got
    except Exception as e:  # noqa: BLE001 - whatever the model throws
        if len(prompts) <= 1:
            return [e] * len(prompts)
        half = len(prompts) // 2
        return answers_of(client, prompts[:half]) + answers_of(client, prompts[half:])


def extract(articles: DataFrame, factory: Callable[[str], ModelClient], model: str, keep: list[str] = ()) -> DataFrame:
    """(keep, doi, model, status, error, rows, full_keys) of articles (doi, text).

    keep: columns of the articles that come along, so that nothing is joined
    back. An article with a text in an optional column problem is an error
    without being asked about. The client is built once per Python worker, when
    the first article comes; an answer may be asked for again if a task is
    repeated. A client that can't be built is the error of each article.
    """
    problem = F.col("problem") if "problem" in articles.columns else F.lit(None).cast("string")
    asked = articles.select(*[F.col(c).alias(f"_k_{c}") for c in keep], "doi", build_prompt(F.col("doi"), F.coalesce("text", F.lit(""))).alias("prompt"), problem.alias("problem"))
    kept = [f"_k_{c}" for c in keep]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = None
        for b in batches:
            open_rows = [i for i, p in enumerate(b["problem"]) if not isinstance(p, str)]
            prompts = [b["prompt"].iloc[i] for i in open_rows]
            answers: list = [ValidationError(p) if isinstance(p, str) else None for p in b["problem"]]
            if prompts:
                try:
                    client = client or factory(model)
                    got = answers_of(client, prompts)
                except Exception as e:  # noqa: BLE001
                    got = [e] * len(prompts)
                for i, answer in zip(open_rows, got):
                    answers[i] = answer
            out = []
            for doi, answer in zip(b["doi"], answers):
                try:
                    if isinstance(answer, Exception):
                        raise answer
                    out.append((doi, model, "ok", None, [typed(r) for r in validated(answer, doi)], True))
                except Exception as e:  # noqa: BLE001 - one article's error is its result
                    out.append((doi, model, "error", str(e) if isinstance(e, ValidationError) else repr(e), None, False))
            done = pd.DataFrame(out, columns=RESULT.fieldNames())
            for c in kept:
                done[c] = b[c].array
            yield done[kept + RESULT.fieldNames()]

    ship(articles.sparkSession)
    schema = T.StructType([*asked.select(*kept).schema, *RESULT])
    return asked.mapInPandas(run, schema).withColumnsRenamed({k: c for k, c in zip(kept, keep) if c not in RESULT.fieldNames()})


def not_done(articles: DataFrame, ledger: DataFrame | None, overwrite: bool = False) -> DataFrame:
    """Articles that no earlier run finished; errors are tried again."""
    if ledger is None or overwrite:
        return articles
    return articles.join(ledger.where("status = 'ok'").select("doi"), "doi", "left_anti")


ARTICLE_COLUMNS = ["matched_subfields", "subject_level_1", "subject", "publication_date", "year", "stage", "lead_institution"]


def facts(results: DataFrame) -> DataFrame:
    """The fact table's rows: each sample with its article's columns, which come
    from the index and never from the model. results: of extract, with
    ARTICLE_COLUMNS kept, so that no join finds them again."""
    about = [c for c in FACT_COLUMNS if c in ARTICLE_COLUMNS]
    rows = results.where("status = 'ok'").select(F.col("doi").alias("_doi"), *about, F.inline("rows")).drop("doi").withColumnRenamed("_doi", "doi")
    return rows.withColumn("subfield", F.try_element_at("matched_subfields", F.lit(1))).select(*FACT_COLUMNS)


def gold_template(sample: DataFrame) -> DataFrame:
    """One blank coding row per article of the sample."""
    blank = {k: "" for k in REQUIRED_KEYS[1:]} | {k: "{}" for k in REQUIRED_KEYS if k.endswith("_pct")}
    helper = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in sample.columns else F.lit("").alias(c)
    coding = [F.lit(1).alias("sample_id"), *[F.lit(v).alias(k) for k, v in blank.items() if k != "sample_id"]]
    return sample.select(*[helper(c) for c in ("doi", "subfield", "title", "xml_path")], *coding)
