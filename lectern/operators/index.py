"""The population table, from article XML or from a search index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.dates import iso_date
from ..functions.stages import stage_of_date
from ..functions.taxonomy import subfields_of_paths, xml_path_of_doi
from ..functions.text import contains_ci
from ..schemas import INDEX_COLUMNS
from .jats import parse_articles

#: What the population is made of.
JOURNAL, ARTICLE_TYPE, FIRST_YEAR, LAST_YEAR = "plos one", "research-article", 2010, 2026


def criteria(journal: Column, article_type: Column, date: Column, subfields: Column) -> dict[str, Column]:
    """The predicates of inclusion, null counting as no."""
    no = F.lit(False)
    return {
        "journal_ok": contains_ci(journal, JOURNAL),
        "type_ok": F.coalesce(article_type == ARTICLE_TYPE, no),
        "date_ok": F.coalesce(F.year(date).between(FIRST_YEAR, LAST_YEAR), no),
        "subfield_ok": F.coalesce(F.size(subfields) > 0, no),
    }


def included(**columns: Column) -> Column:
    out = F.lit(True)
    for c in criteria(**columns).values():
        out = out & c
    return out


def from_xml(files: DataFrame, column: str = "xml_text", counters: Observation | None = None) -> DataFrame:
    """Index rows of the files (xml_path, xml_text) that parse and pass; one
    stage, no shuffle. counters sees the files seen, broken and kept."""
    a = F.col("article")
    rows = parse_articles(files.select("xml_path", column), column)
    passed = included(journal=a["journal"], article_type=a["article_type"], date=a["publication_date"], subfields=a["psychology_subfields"]) & a["error"].isNull()
    if counters is not None:
        rows = rows.observe(counters, F.count(F.lit(1)).alias("seen"), F.count(a["error"]).alias("broken"), F.count_if(passed).alias("kept"))
    rows = rows.where(passed)
    return rows.select("article.*", "xml_path").select(
        "*", F.year("publication_date").alias("year"), stage_of_date(F.col("publication_date")).alias("stage"), F.col("psychology_subfields").alias("matched_subfields")
    ).select(*INDEX_COLUMNS)


def rejected(files: DataFrame, column: str = "xml_text") -> DataFrame:
    """(xml_path, error) of the files that don't parse."""
    return parse_articles(files.select("xml_path", column), column).where("article.error is not null").select("xml_path", "article.error")


def from_search(hits: DataFrame, folder: str, counters: Observation | None = None) -> DataFrame:
    """Index rows of search hits (id, subject, publication_date); hits without a
    subfield are left out. counters sees the rows seen and left out."""
    rows = hits.withColumn("matched_subfields", subfields_of_paths(F.col("subject")))
    if counters is not None:
        rows = rows.observe(counters, F.count(F.lit(1)).alias("seen"), F.count_if(F.size("matched_subfields") == 0).alias("no_subfield"))
    date = iso_date(F.col("publication_date"))
    return rows.where(F.size("matched_subfields") > 0).select(
        F.col("id").alias("doi"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("journal"), F.lit(None).cast("string").alias("article_type"),
        date.alias("publication_date"), F.year(date).alias("year"), stage_of_date(date).alias("stage"), "matched_subfields",
        F.lit(None).cast("array<string>").alias("subject_level_1"), "subject", F.lit(None).cast("string").alias("lead_institution"),
        xml_path_of_doi(F.col("id"), folder).alias("xml_path"),
    )


def with_file(index: DataFrame, files: DataFrame) -> DataFrame:
    """Index rows whose file is among the listed ones (column xml_path): a semi join, no look at each file."""
    return index.join(files.select("xml_path").where("xml_path is not null"), "xml_path", "left_semi")


def without_file(index: DataFrame, files: DataFrame) -> DataFrame:
    return index.join(files.select("xml_path").where("xml_path is not null"), "xml_path", "left_anti")
