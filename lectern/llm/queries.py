"""Queries of the operators for language-model data, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settle, table
from . import mix, names, pii, sample, split, tokens

STRATA = ["stage", "subfield"]
SEED = 20


def p3_entities(spark: SparkSession, d: str) -> DataFrame:
    """Each spelling with the entity that it names."""
    return names.entities(table(spark, d, "article_metadata"), "lead_institution")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return names.pairs(p3_entities(spark, d))


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    """All pieces of all texts."""
    return split.split_texts(table(spark, d, "article_texts"), "text_id", "body_text", table(spark, d, "split_limits"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    limits = table(spark, d, "split_limits").select("size_class", "max_chars")
    texts = table(spark, d, "article_texts").select("text_id", "size_class")
    cut = p4_pieces(spark, d).where("n_pieces > 1 and piece_no = 1").join(texts, "text_id").join(limits, "size_class")
    kinds = F.when(F.col("longest_run") > F.col("max_chars"), F.array(F.lit("oversized"), F.lit("unbroken"))).otherwise(F.array(F.lit("oversized")))
    return cut.select("text_id", F.explode(kinds).alias("kind"))


def p4_rejoined(spark: SparkSession, d: str) -> DataFrame:
    """The texts put together again from their pieces' own parts."""
    own = F.expr("substr(piece, own_start - start_pos + 1)")
    parts = p4_pieces(spark, d).groupBy("text_id").agg(F.sort_array(F.collect_list(F.struct("piece_no", own.alias("part")))).alias("parts"))
    return parts.select("text_id", F.md5(F.array_join(F.col("parts.part"), "")).alias("digest"))


def _sampled(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The plan and the sample drawn by it."""
    rows = table(spark, d, "corpus_index")
    planned = sample.plan(rows, "doi", STRATA, table(spark, d, "sample_targets"))
    return planned, sample.draw(rows, "doi", STRATA, planned, SEED)


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """Targets, quotas, rows drawn and residual gaps of all strata."""
    return sample.reached(*_sampled(spark, d), STRATA)


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    """What of the report doesn't depend on raking and draw."""
    return p6_report(spark, d).select(*STRATA, "target_share", "min_rows", "available", "wanted", "short")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_report(spark, d).where("short").select(*STRATA)


def p6_sample(spark: SparkSession, d: str) -> DataFrame:
    return _sampled(spark, d)[1]


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"), "doc_id", "text", tokens.load_ranks())


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Each text back from its ids; a null text comes back empty."""
    return p8_ids(spark, d).select("doc_id", tokens.decode(F.col("ids"), tokens.load_ranks()).alias("text"))


def document_sizes(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, source, n_tokens), settled."""
    ids = tokens.encode(table(spark, d, "documents"), "doc_id", "text", tokens.load_ranks(), keep=("source",))
    return settle(ids.select("doc_id", "source", F.size("ids").alias("n_tokens")), "sizes")


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The mixture and the plan that it follows."""
    sizes = document_sizes(spark, d)
    planned = mix.plan(sizes, table(spark, d, "mix_targets"))
    return mix.mix(sizes, "doc_id", planned, seed=SEED), planned


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    """Budgets, copies, tokens taken, shares reached and gaps of all sources."""
    return mix.reached(*_mixed(spark, d))


def p9_counts(spark: SparkSession, d: str) -> DataFrame:
    """What of the report doesn't depend on tokens."""
    return p9_report(spark, d).select("source", "target_share", "max_repeats", "documents")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_report(spark, d).where("short").select("source")


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    """How often each document is used."""
    return _mixed(spark, d)[0]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.items(table(spark, d, "documents"), "doc_id", "text")


def p10_redacted(spark: SparkSession, d: str) -> DataFrame:
    """The texts with typed placeholders."""
    return pii.redact(table(spark, d, "documents"), "doc_id", "text")


QUERIES = {f.__name__: f for f in (p3_found, p3_entities, p4_found, p4_pieces, p4_rejoined, p6_found, p6_report, p6_counts, p6_sample, p8_ids, p8_decoded, p9_found, p9_report, p9_counts, p9_mixture, p10_found, p10_redacted)}

_BLANK = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_FOLD = "lower(regexp_replace({0}, '^[\\s\\x{{a0}}]+|[\\s\\x{{a0}}]+$', '', 'g'))"

_STRATA_SQL = f"""
WITH k AS (
  SELECT DISTINCT doi, {_FOLD.format("stage")} AS stage, {_FOLD.format("subfield")} AS subfield FROM corpus_index
), known AS (SELECT * FROM k WHERE stage <> '' AND subfield <> '' AND doi IS NOT NULL),
n AS (SELECT stage, subfield, count(*) AS n FROM known GROUP BY ALL),
s AS (SELECT count(DISTINCT doi) // 5 AS s FROM known),
asked AS (
  SELECT t.stage, t.subfield, t.target_share, t.min_rows, coalesce(n.n, 0) AS available, t.target_share * s.s AS wanted,
    coalesce(n.n, 0) < t.min_rows OR coalesce(n.n, 0) < t.target_share * s.s AS short
  FROM sample_targets t CROSS JOIN s LEFT JOIN n ON n.stage = {_FOLD.format("t.stage")} AND n.subfield = {_FOLD.format("t.subfield")}
)
"""

SQL = {
    "p4_found": f"""
WITH t AS (SELECT text_id, body_text, max_chars FROM article_texts JOIN split_limits USING (size_class) WHERE length(body_text) > max_chars)
SELECT text_id, 'oversized' AS kind FROM t UNION ALL
SELECT text_id, 'unbroken' AS kind FROM t
WHERE list_max(list_transform(regexp_split_to_array(body_text, '{_BLANK}+'), lambda x: length(x))) > max_chars
""",
    "p4_rejoined": "SELECT text_id, md5(body_text) AS digest FROM article_texts WHERE body_text IS NOT NULL",
    "p6_found": _STRATA_SQL + "SELECT t.stage, t.subfield FROM asked t WHERE short",
    "p6_counts": _STRATA_SQL + "SELECT stage, subfield, target_share, min_rows, available, wanted, short FROM asked",
    "p9_counts": "SELECT source, target_share, max_repeats, (SELECT count(*) FROM documents d WHERE d.source = t.source) AS documents FROM mix_targets t WHERE source IS NOT NULL",
    "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
