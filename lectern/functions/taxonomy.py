"""Slash paths, joined lists and names of files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the taxonomy's node whose children are subfields.
NODE = "Psychology"


def subfields_of_paths(paths: Column, node: str = NODE) -> Column:
    """Per path the part after the first that is exactly the node, or the node
    itself at the end; distinct in first-seen order. Paths without it give nothing."""

    def after(path: Column) -> Column:
        parts = F.filter(F.split(path, "/"), lambda x: x != "")
        at = F.array_position(parts, F.lit(node)).cast("int")
        return F.when(at > 0, F.coalesce(F.try_element_at(parts, at + 1), F.lit(node)))

    return F.array_distinct(F.filter(F.transform(paths, after), lambda x: x.isNotNull()))


def xml_path_of_doi(doi: Column, folder: str) -> Column:
    return F.concat_ws("/", F.lit(folder.rstrip("/")), F.concat(F.substring_index(doi, "/", -1), F.lit(".xml")))


def join_list(items: Column) -> Column:
    """';'-joined text of a list, '' for null; a term that holds ';' becomes ambiguous, so for export only."""
    return F.coalesce(F.array_join(items, ";"), F.lit(""))


def split_list(text: Column) -> Column:
    """Trimmed, non-empty tokens of a ';'-joined text; null gives none."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")


def first_token(text: Column) -> Column:
    return F.substring_index(text, ";", 1)


def has_token(text: Column, token: str | Column) -> Column:
    """Whether a ';'-joined text has exactly this token."""
    return F.array_contains(split_list(text), token)


def folder_of_model(model: str) -> str:
    return model.replace("/", "__")


def file_of_doi(doi: Column) -> Column:
    return F.replace(doi, F.lit("/"), F.lit("_"))
