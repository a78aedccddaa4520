"""Queries of the document-analytics operators on the domain tables, with their SQL."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..clients.base import EchoClient
from ..functions import dates, jsonmaps, stages, taxonomy, text
from ..operators import diagnostics, extract, index, sampling, score, trends
from ..operators.jats import parse_articles
from ..session import scratch, table
from ..sources import tables, xml_corpus

#: The generic tables' years have stages of their own.
ORDER_STAGES = (("early", 1995, 1996), ("middle", 1997, 1998), ("late", 1999, 2000))


def facts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "demographics_table")


def rate_by_year_stage(spark, d):
    """All reporting rates by year and stage in one pass (flagship)."""
    return trends.all_rates(facts(spark, d))


def reporting_rate_by_year(spark, d):
    return trends.reporting_rate(facts(spark, d), "gender_reported", "year")


def reporting_rate_by_stage(spark, d):
    return trends.reporting_rate(facts(spark, d), "race_reported", "stage")


def share_within_stage(spark, d):
    return trends.value_share(facts(spark, d), "ses_reported", "stage")


def share_within_year(spark, d):
    return trends.value_share(facts(spark, d), "ses_reported", "year")


def map_unpivot_mean(spark, d):
    return trends.subgroup_means(facts(spark, d), "gender_reported", "gender_pct", "year")


def means_by_year_stage(spark, d):
    return trends.all_means(facts(spark, d))


def stage_order(spark, d):
    """Stages in time order; unknown ones are null and come last."""
    rank = stages.stage_rank(F.col("stage"))
    return facts(spark, d).groupBy(F.when(rank.isNotNull(), F.col("stage")).alias("stage"), rank.alias("stage_rank")).agg(F.count(F.lit(1)).alias("n"))


def order_rate_by_year_stage(spark, d):
    """The rate on the generic tables: returned lines by year and stage of their order."""
    o = table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"))
    lines = table(spark, d, "lineitem").select("l_orderkey", F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("flag"))
    rows = lines.join(o, lines["l_orderkey"] == o["o_orderkey"]).withColumn("stage", stages.stage_of_year(F.col("year"), ORDER_STAGES))
    rate = F.lit(100.0) * F.count_if(F.col("flag") == 1) / F.count(F.lit(1))
    return rows.groupingSets([["year"], ["stage"]], "year", "stage").agg(rate.alias("reporting_rate_pct"), F.count(F.lit(1)).alias("n")).where("year is not null or stage is not null")


def stage_bucket(spark, d):
    return table(spark, d, "article_metadata").select("meta_id", stages.stage_of_date(F.col("publication_date")).alias("stage"))


def path_segment(spark, d):
    """Subfields of the paths in every cell, '' where a cell holds none."""
    paths = facts(spark, d).select("row_id", F.split(F.coalesce("subject", F.lit("")), ";").alias("paths"))
    return paths.select("row_id", F.array_join(taxonomy.subfields_of_paths(F.col("paths")), "|").alias("subfields"))


def doi_path(spark, d):
    return table(spark, d, "corpus_index").select("doi", taxonomy.xml_path_of_doi(F.col("doi"), "/data/corpus/").alias("path"), taxonomy.file_of_doi(F.col("doi")).alias("file"))


def list_tokens(spark, d):
    """Tokens of ';'-joined lists, joined again, with the first."""
    t = taxonomy.split_list(F.col("subject"))
    return table(spark, d, "corpus_index").select("doi", F.size(t).alias("n"), taxonomy.join_list(t).alias("joined"), taxonomy.first_token(F.col("subject")).alias("first_token"))


def priority_reorder(spark, d):
    sections = F.filter(F.split("text", "\n"), lambda x: x != "")
    first = lambda x: F.lower(x).rlike("|".join(text.PRIORITY_WORDS))
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", F.md5(F.array_join(text.priority_first(sections, first), "\n\n")).alias("digest"))


def prompt_build(spark, d):
    p = text.build_prompt(F.col("doi"), F.col("body_text"))
    return table(spark, d, "article_texts").select("text_id", F.md5(p).alias("digest"), F.length(p).cast("long").alias("n_chars"), text.doi_in_prompt(p).alias("doi"))


def systematic_sample(spark, d):
    return sampling.systematic(table(spark, d, "article_metadata").select("meta_id", "doi"), 100, ["meta_id"])


def mod_shard(spark, d):
    return sampling.shard(table(spark, d, "article_metadata").select("meta_id", "doi"), 2, 7, ["meta_id"])


def union_shards(spark, d):
    """Three shards, written as CSV and merged again: together they are the table."""
    rows = table(spark, d, "article_metadata").select("meta_id", "doi", "title")
    folder = scratch(spark, "shards")
    for i in range(3):
        tables.write_csv(sampling.hash_shard(rows, i, 3, "meta_id"), f"{folder}/shard-{i}", ["meta_id", "doi", "title"])
    merged = tables.read_shards(spark, f"{folder}/shard-*", ["meta_id", "doi", "title", "stage"])
    return merged.select(F.col("meta_id").cast("long").alias("meta_id"), "doi", "title", "stage")


def stratified_hash_sample(spark, d):
    rows = table(spark, d, "article_metadata").groupBy("doi").agg(F.max_by("psychology_subfields", "meta_id").alias("subfields"))
    return sampling.stratified_by_hash(rows, F.array_distinct("subfields"), "doi", 2).select("subfield", "doi")


def stratified_python_sample(spark, d):
    rows = table(spark, d, "article_metadata")
    return sampling.stratified_by_draw(rows, F.col("psychology_subfields"), "meta_id", 2).select("draw_no", "subfield", "meta_id", "doi")


def first_seen_distinct(spark, d):
    seen = sampling.first_seen(table(spark, d, "article_metadata"), F.col("psychology_subfields"), F.col("meta_id"))
    return seen.select("token", F.col("seen._order").alias("first_id"), F.col("seen._pos").cast("int").alias("first_pos"))


def _ledger(spark, d):
    """Articles whose text is at hand count as run, those with a blank one as failed."""
    blank = F.length(F.regexp_replace(F.coalesce("body_text", F.lit("")), r"\s", "")) == 0
    return table(spark, d, "article_texts").select("doi", F.when(blank, "error").otherwise("ok").alias("status"))


def resume_anti(spark, d):
    """Articles that no finished result of the ledger has; failed ones are run again."""
    return extract.not_done(table(spark, d, "article_metadata").select("meta_id", "doi"), _ledger(spark, d))


def file_exists_semi(spark, d):
    return index.with_file(table(spark, d, "corpus_index").select("doi", "xml_path"), table(spark, d, "xml_files"))


def file_missing_anti(spark, d):
    return index.without_file(table(spark, d, "corpus_index").select("doi", "xml_path"), table(spark, d, "xml_files"))


def _criteria():
    return index.criteria(journal=F.col("journal"), article_type=F.col("article_type"), date=F.col("publication_date"), subfields=F.col("psychology_subfields"))


def inclusion_filter(spark, d):
    c = index.included(journal=F.col("journal"), article_type=F.col("article_type"), date=F.col("publication_date"), subfields=F.col("psychology_subfields"))
    return table(spark, d, "article_metadata").where(c).select("meta_id", "doi")


def inclusion_funnel(spark, d):
    return diagnostics.funnel(table(spark, d, "article_metadata"), _criteria(), population=391_000)


def cumulative_filters(spark, d):
    return diagnostics.cumulative(table(spark, d, "article_metadata"), list(_criteria().items()))


def lead_pick(spark, d):
    """Per article the first institution that isn't blank, else the first."""
    filled = F.length(F.trim(F.coalesce("lead_institution", F.lit("")))) > 0
    pick = F.max_by(F.coalesce("lead_institution", F.lit("")), F.struct(filled, -F.col("meta_id")))
    return table(spark, d, "article_metadata").groupBy("doi").agg(pick.alias("lead_institution"))


def _two_codings(spark, d):
    """First and last version of each sample, as gold and model rows side by side: one aggregation gives both."""
    columns = [*score.FLAGS, "ses_value", *[p for _, p in score.CATEGORIES.values()]]
    row = F.struct(*columns)
    pairs = facts(spark, d).groupBy("doi", "sample_id").agg(F.min_by(row, "row_id").alias("g"), F.max_by(row, "row_id").alias("m"))
    number = lambda _, v: F.coalesce(jsonmaps.lenient_number(v), F.lit(0.0))
    typed = lambda x: F.struct(*[F.transform_values(jsonmaps.lenient_map(x[c]), number).alias(c) if c.endswith("_pct") else x[c].alias(c) for c in columns])
    return pairs.select("doi", "sample_id", typed(F.col("g")).alias("g"), typed(F.col("m")).alias("m"))


def _scores(spark, d):
    """All articles ran; one has all required keys if no version of it lacks its percentages."""
    results = facts(spark, d).groupBy("doi").agg(F.bool_and(F.col("gender_pct").isNotNull() & F.col("education_pct").isNotNull()).alias("full_keys")).withColumn("status", F.lit("ok"))
    return score.score_articles(_two_codings(spark, d), results)


def score_per_key(spark, d):
    return _scores(spark, d).select("doi", "n_gold_samples", "n_model_samples", "flag_total", "flag_correct", "reporting_flag_accuracy", "num_total", "num_correct", "sample_count_match", "schema_ok")


def score_summary(spark, d):
    return score.summary(_scores(spark, d))


def tolerance_map_compare(spark, d):
    return _two_codings(spark, d).select("doi", "sample_id", jsonmaps.maps_agree(F.col("g.gender_pct"), F.col("m.gender_pct"), 1.0).alias("agree"))


def set_match(spark, d):
    """Per article the samples that report gender and race: the same, and how many in common; sets are counted, not collected."""
    said = lambda c: F.coalesce(F.bool_or(F.col(c) == 1), F.lit(False))
    samples = facts(spark, d).groupBy("doi", "sample_id").agg(said("gender_reported").alias("a"), said("race_reported").alias("b"))
    return samples.groupBy("doi").agg(F.bool_and(F.col("a") == F.col("b")).alias("same"), F.count_if(F.col("a") & F.col("b")).cast("int").alias("common"))


def json_required_keys(spark, d):
    """Keys that the percentages of each row lack."""
    keys = {"gender_pct": ["female", "male"], "race_pct": ["black", "white"], "education_pct": ["college"]}
    lacking = [F.array_join(jsonmaps.missing_keys(F.col(c), k), ",").alias(f"missing_{c}") for c, k in keys.items()]
    return facts(spark, d).select("row_id", *lacking)


def _articles(spark, d):
    return table(spark, d, "article_texts").where("doi is not null").groupBy("doi").agg(F.min_by("body_text", "text_id").alias("text"))


def _echo(spark, d):
    return extract.extract(_articles(spark, d), EchoClient, "echo")


class Unreliable(EchoClient):
    """Answers well, badly, or not at all, as the digest of the article's doi has it."""

    def generate_batch(self, prompts):
        if len(prompts) > 1 and any(self._case(p) == "0" for p in prompts):
            raise RuntimeError("out of memory")  # one bad prompt takes its batch down
        return [self.generate(p) for p in prompts]

    def _case(self, prompt):
        return hashlib.md5(re.search(r"Article DOI:\s*(\S+)", prompt)[1].encode()).hexdigest()[0]

    def generate(self, prompt):
        case, good = self._case(prompt), json.loads(super().generate(prompt))
        if case == "0":
            raise RuntimeError("out of memory")
        if case == "1":
            return "The article reports no sample."
        if case == "2":
            return json.dumps(good[0])
        if case == "3":
            return json.dumps([{k: v for k, v in good[0].items() if k != "ses_value"}])
        if case == "4":
            return json.dumps([good[0] | {"doi": "another"}])
        return "[]" if case == "5" else json.dumps([*good, 7] if case == "6" else good)


def extract_validation(spark, d):
    """Every way in which an answer can be refused, and articles beside them that are not."""
    done = extract.extract(_articles(spark, d), Unreliable, "unreliable")
    why = F.regexp_extract("error", "(not JSON|not an array|not an object|lacks ses_value|is about|out of memory)", 1)
    return done.select("doi", "status", F.coalesce(why, F.lit("")).alias("why"), F.coalesce(F.size("rows"), F.lit(-1)).alias("n_rows"))


def resume_results(spark, d):
    """Results written and read again, and the articles that a second run takes up."""
    folder = scratch(spark, "results")
    tables.write_results(extract.extract(_articles(spark, d), Unreliable, "my/model"), folder)
    return extract.not_done(_articles(spark, d).select("doi"), tables.read_results(spark, folder, "my/model"))


def article_results(spark, d):
    """One JSON file per article, read back."""
    folder = scratch(spark, "files")
    tables.write_article_results(_echo(spark, d), folder).count()
    files = spark.read.schema("doi string, model string, status string, rows array<struct<sample_id:int>>").json(f"{folder}/echo", multiLine=True)
    return files.select("doi", "model", "status", F.col("rows")[0]["sample_id"].alias("sample_id"), F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"))


def csv_round_trip(spark, d):
    """The index as CSV and back, texts as they were; '' comes back as null."""
    folder, columns = scratch(spark, "csv"), ["doi", "title", "journal", "publication_date", "year", "stage", "subject"]
    tables.write_csv(table(spark, d, "corpus_index"), folder, columns)
    return tables.read_csv(spark, folder, columns)


def text_dump(spark, d):
    """Article texts as files, read back by their names."""
    folder = scratch(spark, "texts")
    rows = table(spark, d, "article_texts").select(F.concat(F.lit("t/"), F.col("text_id").cast("string")).alias("doi"), F.col("body_text").alias("text"))
    tables.write_texts(rows, folder).count()
    files = spark.read.format("binaryFile").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.md5("content").alias("digest"))


def corpus_files(spark, d):
    """The article files as a folder: found, listed with their sizes and read."""
    folder = scratch(spark, "corpus")
    rows = table(spark, d, "xml_files").where("xml_text is not null").select(F.col("file_id").cast("string").alias("doi"), F.col("xml_text").alias("text"))
    tables.write_texts(rows, folder, "xml").count()
    listed = xml_corpus.list_corpus(spark, folder).select(_name("xml_path"), "n_bytes")
    texts = xml_corpus.read_files(xml_corpus.present(xml_corpus.list_corpus(spark, folder))).select(_name("xml_path"), F.md5("xml_text").alias("digest"))
    return listed.join(texts, "file")


def _name(column):
    return F.element_at(F.split(column, "/"), -1).alias("file")


def xml_metadata(spark, d):
    """Articles made of the metadata, as XML, and what the parser reads from them."""
    escaped = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    e = lambda name, c: F.when(c.isNull(), "").otherwise(F.concat(F.lit(f"<{name}>"), escaped(c), F.lit(f"</{name}>")))
    wrap = lambda name, *c: F.concat(F.lit(f"<{name}>"), *c, F.lit(f"</{name.split()[0]}>"))
    day = F.col("publication_date")
    part = lambda f: e(f, F.date_format(day, {"year": "yyyy", "month": "MM", "day": "dd"}[f]))
    below = F.array_join(F.transform(F.coalesce("psychology_subfields", F.array().cast("array<string>")), lambda x: wrap("subj-group", e("subject", x))), "")
    text = F.concat(
        F.lit('<article article-type="'), escaped(F.coalesce("article_type", F.lit(""))), F.lit('"><front>'), wrap("journal-meta", wrap("journal-title-group", e("journal-title", F.col("journal")))),
        F.lit("<article-meta>"), wrap('article-id pub-id-type="doi"', escaped(F.coalesce("doi", F.lit("")))), wrap("article-categories", wrap('subj-group subj-group-type="Discipline-v3"', F.lit("<subject>Psychology</subject>"), below)),
        wrap("title-group", e("article-title", F.col("title"))),
        F.lit('<contrib-group><contrib contrib-type="author"><xref ref-type="aff" rid="a1"/></contrib><contrib contrib-type="author" corresp="yes"><xref ref-type="fn" rid="a1"/><xref ref-type="aff" rid="a2"/></contrib></contrib-group>'),
        F.lit('<aff id="a1">first</aff><aff id="a2">'), e("institution", F.col("lead_institution")), F.lit("</aff>"),
        F.when(day.isNull(), "").otherwise(F.concat(F.lit('<pub-date pub-type="ppub"><year>1900</year></pub-date>'), wrap('pub-date pub-type="epub"', part("day"), part("month"), part("year")))),
        F.lit("</article-meta></front></article>"),
    )
    a = parse_articles(table(spark, d, "article_metadata").select("meta_id", text.alias("xml_text")))
    return a.select("meta_id", "article.doi", "article.title", "article.journal", "article.article_type", F.col("article.publication_date").cast("string").alias("day"), F.array_join("article.psychology_subfields", "|").alias("subfields"), "article.lead_institution", "article.error")


def xml_sections(spark, d):
    """Texts as articles of one section a line, and the parser's text of them: sections on methods and samples first."""
    line = lambda x: F.concat(F.lit("<sec><title>"), x, F.lit("</title><p>.</p></sec>"))
    clean = F.regexp_replace("body_text", r"[^\n a-zA-Z0-9.,;:()\-]", "")
    lines = F.filter(F.split(clean, "\n"), lambda x: x.rlike("[a-z]"))
    body = F.concat(F.lit("<article><body>"), F.array_join(F.transform(lines, lambda x: line(F.trim(x))), ""), F.lit("</body></article>"))
    a = parse_articles(table(spark, d, "article_texts").where("body_text is not null").select("text_id", body.alias("xml_text")))
    return a.select("text_id", F.md5("article.extraction_text").alias("digest"))


def echo_extract(spark, d):
    rows = _echo(spark, d).select("doi", "status", F.inline("rows").alias(*["_doi", *extract.REQUIRED_KEYS[1:]]))
    return rows.select("doi", "status", "sample_id", "gender_reported", "race_reported", "education_reported", "ses_reported", jsonmaps.map_text(F.col("gender_pct")).alias("gender_pct"))


def echo_facts(spark, d):
    """Samples with their article's columns, which come from the index and go through the extraction."""
    about = table(spark, d, "article_metadata").groupBy("doi").agg(
        F.max_by("psychology_subfields", "meta_id").alias("matched_subfields"), F.max_by("subject_level_1", "meta_id").alias("subject_level_1"), F.max_by("subject", "meta_id").alias("subject"),
        F.max("publication_date").alias("publication_date"), F.max("lead_institution").alias("lead_institution"),
    )
    about = about.withColumns({"year": F.year("publication_date"), "stage": stages.stage_of_date(F.col("publication_date"))})
    done = extract.extract(_articles(spark, d).join(about, "doi"), EchoClient, "echo", extract.ARTICLE_COLUMNS)
    return extract.facts(done).select("doi", "sample_id", "subfield", "year", "stage", "ses_reported")


def gold_template(spark, d):
    sample = table(spark, d, "corpus_index").select("doi", "subfield", "title", "xml_path")
    return extract.gold_template(sample).select("doi", "subfield", "title", "sample_id", "gender_reported", "gender_pct", "ses_value")


def year_histogram_none(spark, d):
    return diagnostics.histogram(facts(spark, d), F.col("year"))


def conditional_counts(spark, d):
    c = {"n_long": F.col("n_chars") > 1000, "n_study": text.contains_ci(F.col("text"), "study"), "n_empty": F.coalesce(F.col("text"), F.lit("")) == ""}
    return diagnostics.conditional_counts(table(spark, d, "documents"), "source", c)


def top_frequency(spark, d):
    return diagnostics.frequency(table(spark, d, "documents"), "lang")


def first_n_per_bucket(spark, d):
    return sampling.first_n(table(spark, d, "corpus_index").select("year", "doi").distinct(), ["year"], ["doi"], 2)


def date_fallback(spark, d):
    o = table(spark, d, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    broken = F.when(F.col("o_orderkey") % 3 == 0, F.replace(day, F.lit("-0"), F.lit("-9"))).when(F.col("o_orderkey") % 3 == 1, F.concat(day, F.lit("T00:00:00Z")))
    return o.select("o_orderkey", dates.date_text(dates.first_date(dates.iso_date(broken), dates.iso_date(day))).alias("day"), dates.date_text(dates.iso_date(broken)).alias("first_day"))


def token_membership(spark, d):
    return table(spark, d, "corpus_index").where(taxonomy.has_token(F.col("matched_subfields"), "Perception")).select("doi", "matched_subfields")


def xml_index(spark, d):
    return index.from_xml(table(spark, d, "xml_files"))


def xml_rejected(spark, d):
    return index.rejected(table(spark, d, "xml_files"))


def xml_text(spark, d):
    """Extraction texts of all files that parse."""
    rows = parse_articles(table(spark, d, "xml_files").select("file_id", "xml_text"))
    return rows.where("article.error is null").select("file_id", "article.doi", "article.extraction_text")


def search_index(spark, d):
    """Index rows from search hits, here made of the metadata."""
    paths = F.transform("psychology_subfields", lambda x: F.concat(F.lit("/Life sciences/Psychology/"), x))
    hits = table(spark, d, "article_metadata").select("meta_id", F.col("doi").alias("id"), paths.alias("subject"), F.date_format("publication_date", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("publication_date"))
    rows = index.from_search(hits, "/data/corpus").withColumn("subfields", F.array_join("matched_subfields", "|"))
    return rows.select("doi", F.col("publication_date").cast("string").alias("day"), "year", "stage", "subfields", "xml_path")


def round_hundreds(spark, d):
    return table(spark, d, "orders").select("o_orderkey", text.round_hundreds(F.round("o_totalprice").cast("long")).alias("hundreds"))


_ALL = (
    rate_by_year_stage, reporting_rate_by_year, reporting_rate_by_stage, share_within_stage, share_within_year, map_unpivot_mean, means_by_year_stage, stage_order,
    order_rate_by_year_stage, stage_bucket, path_segment, doi_path, list_tokens, priority_reorder, prompt_build, systematic_sample, mod_shard, union_shards,
    stratified_hash_sample, stratified_python_sample, first_seen_distinct, resume_anti, file_exists_semi, file_missing_anti, inclusion_filter, inclusion_funnel,
    cumulative_filters, lead_pick, score_per_key, score_summary, tolerance_map_compare, set_match, json_required_keys, echo_extract, echo_facts, extract_validation, resume_results, article_results, csv_round_trip, text_dump, corpus_files, xml_metadata, xml_sections, gold_template,
    year_histogram_none, conditional_counts, top_frequency, first_n_per_bucket, date_fallback, token_membership, xml_index, xml_rejected, xml_text, search_index, round_hundreds,
)
QUERIES = {f.__name__: f for f in _ALL}

_STAGE = "CASE WHEN {y} BETWEEN 2010 AND 2014 THEN 'early' WHEN {y} BETWEEN 2015 AND 2019 THEN 'middle' WHEN {y} BETWEEN 2020 AND 2023 THEN 'covid' WHEN {y} BETWEEN 2024 AND 2026 THEN 'post_covid' END"
_CATS = "(VALUES ('gender'), ('race'), ('education')) c(category)"
_LONG = """
SELECT category, group_by, group_value, flag, pct FROM (
  SELECT unnest([{'category': 'gender', 'flag': gender_reported, 'pct': gender_pct}, {'category': 'race', 'flag': race_reported, 'pct': race_pct},
    {'category': 'education', 'flag': education_reported, 'pct': education_pct}], recursive := true), year, stage FROM demographics_table) t,
  LATERAL (SELECT unnest([{'group_by': 'year', 'group_value': year::varchar}, {'group_by': 'stage', 'group_value': stage}], recursive := true)) g
WHERE group_value IS NOT NULL
"""
_NUM = "CASE WHEN NOT isnan(coalesce(try_cast({v} AS double), 0)) THEN try_cast({v} AS double) END"
_INCLUDED = "coalesce(contains(lower(journal), 'plos one'), false) AS journal_ok, coalesce(article_type = 'research-article', false) AS type_ok, coalesce(year(publication_date) BETWEEN 2010 AND 2026, false) AS date_ok, coalesce(len(psychology_subfields) > 0, false) AS subfield_ok"
_VERSIONS = """
gold AS (SELECT * FROM demographics_table QUALIFY row_number() OVER (PARTITION BY doi, sample_id ORDER BY row_id) = 1),
model AS (SELECT * FROM demographics_table QUALIFY row_number() OVER (PARTITION BY doi, sample_id ORDER BY row_id DESC) = 1)
"""


def _agree(p: str, g: str = "g", m: str = "m") -> str:
    at = lambda t: f"coalesce(CASE WHEN json_valid({t}.{p}) THEN " + _NUM.format(v=f"json_extract_string({t}.{p}, '$.' || k)") + " END, 0.0)"
    keys = lambda t: f"(CASE WHEN json_valid({t}.{p}) THEN json_keys({t}.{p}) ELSE [] END)"
    return f"coalesce(list_bool_and(list_transform(list_concat({keys(g)}, {keys(m)}), lambda k: abs({at(g)} - {at(m)}) <= 1.0)), true)"


SQL = {
    "rate_by_year_stage": f"SELECT category, group_by, group_value, 100.0::double * count(*) FILTER (flag = 1) / count(*) AS reporting_rate_pct FROM ({_LONG}) GROUP BY ALL",
    "reporting_rate_by_year": "SELECT year, 100.0::double * count(*) FILTER (gender_reported = 1) / count(*) AS reporting_rate_pct FROM demographics_table WHERE year IS NOT NULL GROUP BY year",
    "reporting_rate_by_stage": "SELECT stage, 100.0::double * count(*) FILTER (race_reported = 1) / count(*) AS reporting_rate_pct FROM demographics_table WHERE stage IS NOT NULL GROUP BY stage",
    "share_within_stage": "SELECT stage, ses_reported, 100.0::double * count(*) / sum(count(*)) OVER (PARTITION BY stage) AS share_pct FROM demographics_table WHERE ses_reported IS NOT NULL AND stage IS NOT NULL GROUP BY stage, ses_reported",
    "share_within_year": "SELECT year, ses_reported, 100.0::double * count(*) / sum(count(*)) OVER (PARTITION BY year) AS share_pct FROM demographics_table WHERE ses_reported IS NOT NULL AND year IS NOT NULL GROUP BY year, ses_reported",
    "map_unpivot_mean": f"""
SELECT year, subgroup, avg(v) AS mean_pct, count(v) AS n FROM (SELECT t.year, je.key AS subgroup, {_NUM.format(v="(je.value->>'$')")} AS v
  FROM (SELECT * FROM demographics_table WHERE json_valid(gender_pct) AND gender_reported = 1 AND year IS NOT NULL) t, json_each(t.gender_pct) je) GROUP BY ALL""",
    "means_by_year_stage": f"""
SELECT category, group_by, group_value, subgroup, avg(v) AS mean_pct, count(v) AS n FROM (
  SELECT category, group_by, group_value, je.key AS subgroup, {_NUM.format(v="(je.value->>'$')")} AS v FROM (SELECT * FROM ({_LONG}) WHERE json_valid(pct) AND flag = 1) t, json_each(t.pct) je) GROUP BY ALL""",
    "stage_order": "SELECT CASE WHEN r > 0 THEN stage END AS stage, nullif(r, 0)::int AS stage_rank, count(*) AS n FROM (SELECT stage, coalesce(list_position(['early', 'middle', 'covid', 'post_covid'], stage), 0) AS r FROM demographics_table) GROUP BY 1, 2",
    "order_rate_by_year_stage": """
SELECT year, stage, 100.0::double * count(*) FILTER (l_returnflag = 'R') / count(*) AS reporting_rate_pct, count(*) AS n FROM (
  SELECT l_returnflag, year(o_orderdate)::int AS year, CASE WHEN year(o_orderdate) BETWEEN 1995 AND 1996 THEN 'early' WHEN year(o_orderdate) BETWEEN 1997 AND 1998 THEN 'middle' WHEN year(o_orderdate) BETWEEN 1999 AND 2000 THEN 'late' END AS stage
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY GROUPING SETS ((year), (stage)) HAVING year IS NOT NULL OR stage IS NOT NULL""",
    "stage_bucket": f"SELECT meta_id, {_STAGE.format(y='year(publication_date)')} AS stage FROM article_metadata",
    "path_segment": """
SELECT row_id, coalesce(array_to_string(list_transform(list_filter(u, lambda x, i: list_position(u, x) = i), lambda x: x), '|'), '') AS subfields FROM (
  SELECT row_id, list_filter(list_transform(list_transform(string_split(subject, ';'), lambda p: list_filter(string_split(p, '/'), lambda x: x <> '')),
    lambda a: CASE WHEN list_contains(a, 'Psychology') THEN coalesce(a[list_position(a, 'Psychology') + 1], 'Psychology') END), lambda x: x IS NOT NULL) AS u
  FROM (SELECT row_id, coalesce(subject, '') AS subject FROM demographics_table))""",
    "doi_path": "SELECT doi, '/data/corpus/' || split_part(doi, '/', -1) || '.xml' AS path, replace(doi, '/', '_') AS file FROM corpus_index",
    "list_tokens": "SELECT doi, len(t)::int AS n, array_to_string(t, ';') AS joined, split_part(subject, ';', 1) AS first_token FROM (SELECT doi, subject, list_filter(list_transform(string_split(coalesce(subject, ''), ';'), lambda x: trim(x)), lambda x: x <> '') AS t FROM corpus_index)",
    "priority_reorder": """
SELECT doc_id, md5(coalesce(array_to_string(list_concat(list_filter(a, lambda x: regexp_matches(lower(x), 'method|participant|sample|procedure')), list_filter(a, lambda x: NOT regexp_matches(lower(x), 'method|participant|sample|procedure'))), e'\\n\\n'), '')) AS digest
FROM (SELECT doc_id, list_filter(string_split(text, e'\\n'), lambda x: x <> '') AS a FROM documents WHERE text IS NOT NULL)""",
    "prompt_build": "SELECT text_id, md5(p) AS digest, length(p) AS n_chars, doi FROM (SELECT text_id, doi, '"
    + text.PROMPT.split("{doi}")[0].replace("'", "''")
    + "' || doi || '"
    + text.PROMPT.split("{doi}")[1].split("{article_text}")[0].replace("'", "''")
    + "' || body_text || '"
    + text.PROMPT.split("{article_text}")[1].replace("'", "''")
    + "' AS p FROM article_texts)",
    "systematic_sample": "SELECT meta_id, doi FROM (SELECT *, row_number() OVER (ORDER BY meta_id) - 1 AS i, count(*) OVER () AS n FROM article_metadata) WHERE i % greatest(1, n // 100) = 0",
    "mod_shard": "SELECT meta_id, doi FROM (SELECT *, row_number() OVER (ORDER BY meta_id) - 1 AS i FROM article_metadata) WHERE i % 7 = 2",
    "union_shards": "SELECT meta_id, doi, nullif(title, '') AS title, NULL::varchar AS stage FROM article_metadata",
    "stratified_hash_sample": """
WITH a AS (SELECT doi, arg_max(psychology_subfields, meta_id) AS s FROM article_metadata GROUP BY doi), w AS (SELECT doi, unnest(list_distinct(s)) AS subfield FROM a)
SELECT subfield, doi FROM (SELECT *, count(*) OVER (PARTITION BY subfield) AS n FROM w) WHERE n >= 2 QUALIFY row_number() OVER (PARTITION BY subfield ORDER BY md5(doi || '|42'), doi) <= 2""",
    "first_seen_distinct": "SELECT token, m.a AS first_id, m.b::int AS first_pos FROM (SELECT token, min({'a': meta_id, 'b': pos}) AS m FROM (SELECT meta_id, unnest(psychology_subfields) AS token, generate_subscripts(psychology_subfields, 1) - 1 AS pos FROM article_metadata) GROUP BY token)",
    "resume_anti": r"SELECT meta_id, doi FROM article_metadata ANTI JOIN (SELECT doi FROM article_texts WHERE regexp_replace(coalesce(body_text, ''), '\s', '', 'g') <> '') USING (doi)",
    "file_exists_semi": "SELECT doi, xml_path FROM corpus_index SEMI JOIN xml_files USING (xml_path)",
    "file_missing_anti": "SELECT doi, xml_path FROM corpus_index ANTI JOIN xml_files USING (xml_path)",
    "inclusion_filter": f"SELECT meta_id, doi FROM (SELECT *, {_INCLUDED} FROM article_metadata) WHERE journal_ok AND type_ok AND date_ok AND subfield_ok",
    "inclusion_funnel": f"SELECT *, 100.0::double * all_of_them / total AS all_pct, round_even(all_of_them * 391000.0::double / total, -2) AS estimate FROM (SELECT count(*) AS total, count(*) FILTER (journal_ok) AS journal_ok, count(*) FILTER (type_ok) AS type_ok, count(*) FILTER (date_ok) AS date_ok, count(*) FILTER (subfield_ok) AS subfield_ok, count(*) FILTER (journal_ok AND type_ok AND date_ok AND subfield_ok) AS all_of_them FROM (SELECT {_INCLUDED} FROM article_metadata))",
    "cumulative_filters": f"SELECT count(*) FILTER (journal_ok) AS journal_ok, count(*) FILTER (journal_ok AND type_ok) AS type_ok, count(*) FILTER (journal_ok AND type_ok AND date_ok) AS date_ok, count(*) FILTER (journal_ok AND type_ok AND date_ok AND subfield_ok) AS subfield_ok FROM (SELECT {_INCLUDED} FROM article_metadata)",
    "lead_pick": "SELECT doi, arg_max(coalesce(lead_institution, ''), {'f': trim(coalesce(lead_institution, '')) <> '', 'm': -meta_id}) AS lead_institution FROM article_metadata GROUP BY doi",
    "tolerance_map_compare": f"WITH {_VERSIONS} SELECT doi, sample_id, {_agree('gender_pct')} AS agree FROM gold g JOIN model m USING (doi, sample_id)",
    "set_match": "SELECT doi, a = b AS same, len(list_intersect(a, b))::int AS common FROM (SELECT doi, coalesce(list_sort(list(DISTINCT sample_id) FILTER (gender_reported = 1)), []) AS a, coalesce(list_sort(list(DISTINCT sample_id) FILTER (race_reported = 1)), []) AS b FROM demographics_table GROUP BY doi)",
    "json_required_keys": "SELECT row_id, array_to_string(list_filter(['female', 'male'], lambda x: NOT list_contains(CASE WHEN json_valid(gender_pct) THEN coalesce(json_keys(gender_pct), []) ELSE [] END, x)), ',') AS missing_gender_pct, array_to_string(list_filter(['black', 'white'], lambda x: NOT list_contains(CASE WHEN json_valid(race_pct) THEN coalesce(json_keys(race_pct), []) ELSE [] END, x)), ',') AS missing_race_pct, array_to_string(list_filter(['college'], lambda x: NOT list_contains(CASE WHEN json_valid(education_pct) THEN coalesce(json_keys(education_pct), []) ELSE [] END, x)), ',') AS missing_education_pct FROM demographics_table",
    "echo_extract": "SELECT DISTINCT doi, 'ok' AS status, 1 AS sample_id, 0 AS gender_reported, 0 AS race_reported, 0 AS education_reported, 0 AS ses_reported, '{}' AS gender_pct FROM article_texts WHERE doi IS NOT NULL",
    "extract_validation": "SELECT doi, CASE WHEN why = '' THEN 'ok' ELSE 'error' END AS status, why, CASE WHEN why <> '' THEN -1 WHEN left(md5(doi), 1) = '5' THEN 0 ELSE 1 END AS n_rows FROM (SELECT DISTINCT doi, CASE left(md5(doi), 1) WHEN '0' THEN 'out of memory' WHEN '1' THEN 'not JSON' WHEN '2' THEN 'not an array' WHEN '3' THEN 'lacks ses_value' WHEN '4' THEN 'is about' WHEN '6' THEN 'not an object' ELSE '' END AS why FROM article_texts WHERE doi IS NOT NULL)",
    "resume_results": "SELECT DISTINCT doi FROM article_texts WHERE doi IS NOT NULL AND left(md5(doi), 1) IN ('0', '1', '2', '3', '4', '6')",
    "article_results": "SELECT DISTINCT doi, 'echo' AS model, 'ok' AS status, 1 AS sample_id, replace(doi, '/', '_') || '.json' AS file FROM article_texts WHERE doi IS NOT NULL",
    "csv_round_trip": "SELECT nullif(doi, '') AS doi, nullif(title, '') AS title, nullif(journal, '') AS journal, publication_date::varchar AS publication_date, year::varchar AS year, nullif(stage, '') AS stage, nullif(subject, '') AS subject FROM corpus_index",
    "text_dump": "SELECT 't_' || text_id || '.txt' AS file, md5(body_text) AS digest FROM article_texts WHERE body_text IS NOT NULL",
    "corpus_files": "SELECT file_id || '.xml' AS file, octet_length(encode(xml_text)) AS n_bytes, md5(xml_text) AS digest FROM xml_files WHERE xml_text IS NOT NULL",
    "xml_metadata": r"SELECT meta_id, trim(doi) AS doi, coalesce(trim(title), '') AS title, coalesce(trim(journal), '') AS journal, coalesce(article_type, '') AS article_type, publication_date::varchar AS day, CASE WHEN len(s) > 0 THEN array_to_string(s, '|') ELSE 'Psychology' END AS subfields, nullif(trim(lead_institution), '') AS lead_institution, NULL::varchar AS error FROM (SELECT *, list_filter(psychology_subfields, lambda x, i: list_position(psychology_subfields, x) = i) AS s FROM article_metadata)",
    "xml_sections": r"""
SELECT text_id, md5(coalesce(array_to_string(list_transform(list_concat(list_filter(a, lambda x: regexp_matches(lower(x), 'method|participant|sample|procedure')), list_filter(a, lambda x: NOT regexp_matches(lower(x), 'method|participant|sample|procedure'))), lambda x: x || '.'), e'\n\n'), '')) AS digest
FROM (SELECT text_id, list_transform(list_filter(string_split(regexp_replace(body_text, '[^\n a-zA-Z0-9.,;:()-]', '', 'g'), e'\n'), lambda x: regexp_matches(x, '[a-z]')), lambda x: trim(x)) AS a FROM article_texts WHERE body_text IS NOT NULL)""",
    "echo_facts": f"SELECT doi, 1 AS sample_id, s[1] AS subfield, year(p)::int AS year, {_STAGE.format(y='year(p)')} AS stage, 0 AS ses_reported FROM (SELECT doi, arg_max(psychology_subfields, meta_id) AS s, max(publication_date) AS p FROM article_metadata GROUP BY doi) SEMI JOIN article_texts USING (doi)",
    "gold_template": "SELECT coalesce(doi, '') AS doi, coalesce(subfield, '') AS subfield, coalesce(title, '') AS title, 1 AS sample_id, '' AS gender_reported, '{}' AS gender_pct, '' AS ses_value FROM corpus_index",
    "year_histogram_none": "SELECT coalesce(year::varchar, 'NONE') AS bucket, count(*) AS n FROM demographics_table GROUP BY 1",
    "conditional_counts": "SELECT source, count(*) AS n, count(*) FILTER (n_chars > 1000) AS n_long, count(*) FILTER (contains(lower(text), 'study')) AS n_study, count(*) FILTER (coalesce(text, '') = '') AS n_empty FROM documents WHERE source IS NOT NULL GROUP BY source",
    "top_frequency": "SELECT lang, count(*) AS n FROM documents GROUP BY lang",
    "first_n_per_bucket": "SELECT year, doi FROM (SELECT DISTINCT year, doi FROM corpus_index) QUALIFY row_number() OVER (PARTITION BY year ORDER BY doi) <= 2",
    "date_fallback": """
SELECT o_orderkey, strftime(coalesce(try_cast(left(b, 10) AS date), o_orderdate::date), '%Y-%m-%d') AS day, coalesce(strftime(try_cast(left(b, 10) AS date), '%Y-%m-%d'), '') AS first_day FROM (
  SELECT o_orderkey, o_orderdate, CASE WHEN o_orderkey % 3 = 0 THEN replace(strftime(o_orderdate, '%Y-%m-%d'), '-0', '-9') WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate, '%Y-%m-%d') || 'T00:00:00Z' END AS b FROM orders)""",
    "token_membership": "SELECT doi, matched_subfields FROM corpus_index WHERE list_contains(list_transform(string_split(matched_subfields, ';'), lambda x: trim(x)), 'Perception')",
    "search_index": f"SELECT doi, coalesce(publication_date::varchar, NULL) AS day, year(publication_date)::int AS year, {_STAGE.format(y='year(publication_date)')} AS stage, array_to_string(list_filter(psychology_subfields, lambda x, i: list_position(psychology_subfields, x) = i), '|') AS subfields, '/data/corpus/' || split_part(doi, '/', -1) || '.xml' AS xml_path FROM (SELECT doi, publication_date, list_transform(psychology_subfields, lambda x: split_part(x, '/', 1)) AS psychology_subfields FROM article_metadata) WHERE len(psychology_subfields) > 0",
    "round_hundreds": "SELECT o_orderkey, round_even(round(o_totalprice), -2)::bigint AS hundreds FROM orders",
}
_FLAGS = " + ".join(f"(CASE WHEN g.{c} IS NOT DISTINCT FROM m.{c} THEN 1 ELSE 0 END)" for c in score.FLAGS)
_GATES = [(f"coalesce(g.{f} = 1 AND m.{f} = 1, false)", _agree(p)) for f, p in score.CATEGORIES.values()]
_SES = "coalesce(" + _NUM.format(v="{t}.ses_value") + ", 0.0)"
_GATES.append(("coalesce(g.ses_reported = 2 AND m.ses_reported = 2, false)", f"abs({_SES.format(t='g')} - {_SES.format(t='m')}) <= 1.0"))

_SCORES = f"""WITH {_VERSIONS}, both_sides AS (
  SELECT g.doi, m.row_id IS NOT NULL AS there, CASE WHEN m.row_id IS NOT NULL THEN {_FLAGS} ELSE 0 END AS flag_correct,
    CASE WHEN m.row_id IS NOT NULL THEN {" + ".join(f"CAST({a} AS INT)" for a, _ in _GATES)} ELSE 0 END AS num_total,
    CASE WHEN m.row_id IS NOT NULL THEN {" + ".join(f"CAST({a} AND {b} AS INT)" for a, b in _GATES)} ELSE 0 END AS num_correct
  FROM gold g LEFT JOIN model m USING (doi, sample_id)
), sums AS (
  SELECT doi, true AS ok, count(*) AS n_gold, count(*) FILTER (there) AS n_model, sum(flag_correct)::bigint AS fc, sum(num_total)::bigint AS nt, sum(num_correct)::bigint AS nc FROM both_sides GROUP BY doi
), scores AS (
  SELECT doi, n_gold AS n_gold_samples, CASE WHEN ok THEN n_model ELSE 0 END AS n_model_samples, CASE WHEN ok THEN 4 * n_model ELSE 0 END AS flag_total, CASE WHEN ok THEN fc ELSE 0 END AS flag_correct,
    CASE WHEN ok THEN fc::double / nullif(4 * n_model, 0) ELSE 0.0 END AS reporting_flag_accuracy, CASE WHEN ok THEN nt ELSE 0 END AS num_total, CASE WHEN ok THEN nc ELSE 0 END AS num_correct,
    ok AND n_gold = n_model AS sample_count_match, schema_ok FROM sums JOIN (SELECT doi, bool_and(gender_pct IS NOT NULL AND education_pct IS NOT NULL) AS schema_ok FROM demographics_table GROUP BY doi) USING (doi))
"""
SQL["score_per_key"] = _SCORES + "SELECT * FROM scores"
SQL["score_summary"] = _SCORES + """
SELECT count(*) AS n_articles, sum(flag_correct)::double / nullif(sum(flag_total), 0) AS reporting_flag_accuracy, sum(num_correct)::double / nullif(sum(num_total), 0) AS numeric_accuracy,
  count(*) FILTER (sample_count_match)::double / count(*) AS sample_count_match_rate, count(*) FILTER (schema_ok)::double / count(*) AS schema_ok_rate FROM scores"""
