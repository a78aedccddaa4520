"""Schemas of the tables between stages; lists and maps stay typed, CSV is for export."""

from __future__ import annotations

from pyspark.sql import types as T

_LIST, _MAP = T.ArrayType(T.StringType()), T.MapType(T.StringType(), T.DoubleType())


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


METADATA = _schema(
    doi=T.StringType(), title=T.StringType(), journal=T.StringType(), article_type=T.StringType(), publication_date=T.DateType(),
    subject_level_1=_LIST, subject=_LIST, psychology_subfields=_LIST, lead_institution=T.StringType(), extraction_text=T.StringType(), error=T.StringType(),
)
INDEX = _schema(
    doi=T.StringType(), title=T.StringType(), journal=T.StringType(), article_type=T.StringType(), publication_date=T.DateType(), year=T.IntegerType(),
    stage=T.StringType(), matched_subfields=_LIST, subject_level_1=_LIST, subject=_LIST, lead_institution=T.StringType(), xml_path=T.StringType(),
)
SAMPLE_ROW = _schema(
    doi=T.StringType(), sample_id=T.IntegerType(), gender_reported=T.IntegerType(), gender_pct=_MAP, race_reported=T.IntegerType(), race_pct=_MAP,
    education_reported=T.IntegerType(), education_pct=_MAP, ses_reported=T.IntegerType(), ses_value=T.StringType(),
)
RESULT = _schema(doi=T.StringType(), model=T.StringType(), status=T.StringType(), error=T.StringType(), rows=T.ArrayType(SAMPLE_ROW), full_keys=T.BooleanType())
SEARCH_DOCUMENT = _schema(id=T.StringType(), subject=_LIST, publication_date=T.StringType(), year=T.IntegerType())

#: Columns of the exported tables, in order.
INDEX_COLUMNS = INDEX.fieldNames()
PILOT_COLUMNS = ["doi", "subfield", "title", "publication_date", "year", "stage", "lead_institution", "subject_level_1", "subject", "xml_path"]
REQUIRED_KEYS = SAMPLE_ROW.fieldNames()
FACT_COLUMNS = [
    "doi", "sample_id", "subfield", "matched_subfields", "subject_level_1", "subject", "publication_date", "year", "stage", "lead_institution",
    *REQUIRED_KEYS[2:],
]
TEMPLATE_COLUMNS = ["doi", "subfield", "title", "xml_path", *REQUIRED_KEYS[1:]]
SCORE_COLUMNS = ["doi", "n_gold_samples", "n_model_samples", "reporting_flag_accuracy", "numeric_accuracy", "sample_count_match", "schema_ok", "notes"]
