"""Commands: python -m lectern.cli COMMAND --help"""

from __future__ import annotations

import argparse
from functools import partial

from pyspark.sql import Observation
from pyspark.sql import functions as F

from .clients.base import build_client
from .config import Settings, load_settings
from .functions import text
from .functions.taxonomy import split_list
from .operators import diagnostics, extract, index, sampling, score, trends
from .operators.jats import parse_articles
from .schemas import FACT_COLUMNS, INDEX_COLUMNS, PILOT_COLUMNS, RESULT, SCORE_COLUMNS, TEMPLATE_COLUMNS
from .session import clean, local_session, progress, settle
from .sources import paged_search, tables, xml_corpus

_LISTS = ["matched_subfields", "subject_level_1", "subject"]


def read_index(spark, path: str):
    """A Parquet or CSV index with list columns."""
    if not path.endswith(".csv"):
        return spark.read.parquet(path)
    rows = tables.read_csv(spark, path, INDEX_COLUMNS)
    return rows.withColumns({c: split_list(F.col(c)) for c in _LISTS})


def texts_of(sample):
    """sample with text and problem of each row's file; tasks read and parse the files."""
    parsed = parse_articles(xml_corpus.read_files(sample.drop("text", "problem", "article")))
    missing = F.when(F.col("article.error").isNotNull(), F.concat(F.lit("no article could be read: "), F.col("article.error")))
    return parsed.withColumns({"text": F.col("article.extraction_text"), "problem": missing}).drop("article")


def _told(rows, *counts):
    """(rows, counts) such that counts() tells, after rows are written, how many there were."""
    seen = Observation()
    rows = rows.observe(seen, F.count(F.lit(1)).alias("rows"), *counts)
    return rows, lambda: seen.get


def build_corpus_index(spark, a):
    seen = Observation()
    tables.write_csv(index.from_xml(xml_corpus.read_corpus(spark, a.corpus_dir), counters=seen), a.out, INDEX_COLUMNS)
    n = seen.get
    print(f"{n['seen']} files seen, {n['broken']} broken, {n['kept']} kept, written to {a.out}")


def build_index_search(spark, a):
    paged_search.register(spark)
    hits = spark.read.format("paged_search").options(url=a.url, start_year=a.start_year, end_year=a.end_year, pause=a.pause).load()
    seen = Observation()
    tables.write_csv(index.from_search(hits, a.corpus_dir, seen), a.out, INDEX_COLUMNS)
    rows = tables.read_csv(spark, a.out, INDEX_COLUMNS)
    kept, missing = rows.count(), rows.count() - xml_corpus.present(rows.select("xml_path")).count()
    print(f"{seen.get['seen']} hits seen, {seen.get['no_subfield']} without a subfield, {kept} kept, {missing} of them without a file, written to {a.out}")


def sample_articles(spark, a):
    rows = read_index(spark, a.index)
    if not a.any_file:
        here = settle(index.with_file(rows, xml_corpus.list_corpus(spark, a.corpus_dir)) if a.corpus_dir else xml_corpus.present(rows))
        print(f"{rows.count() - here.count()} of {rows.count()} index rows have no file and are left out")
        rows = here
    rows = sampling.numbered(rows, ["doi", "xml_path"], "row_no")
    done, told = _told(sampling.stratified_by_draw(rows, F.col("matched_subfields"), "row_no", a.per_subfield, a.seed), F.collect_set("subfield").alias("subfields"))
    tables.write_csv(done, a.out, PILOT_COLUMNS, one_file=True)
    print(f"{told()['rows']} articles of {len(told()['subfields'])} subfields written to {a.out}: {', '.join(sorted(told()['subfields']))}")


def make_gold_template(spark, a):
    sample = tables.read_csv(spark, a.sample, PILOT_COLUMNS)
    done, told = _told(extract.gold_template(sample))
    tables.write_csv(done, a.out, TEMPLATE_COLUMNS, one_file=True)
    print(told()["rows"], "blank coding rows written to", a.out)
    if a.text_dir:
        print(tables.write_texts(texts_of(sample).select("doi", "text"), a.text_dir).count(), "texts written to", a.text_dir)


def _client(a):
    """The client's factory, with the options that its backend knows."""
    return partial(build_client, a.backend, **({"tensor_parallel_size": a.tensor_parallel_size} if a.backend == "vllm" else {}))


def run_pilot(spark, a):
    sample = tables.read_csv(spark, a.sample, PILOT_COLUMNS)
    todo = extract.not_done(sample, tables.read_results(spark, a.results_dir, a.model), a.overwrite)
    skipped = sample.count() - todo.count()
    with progress(spark, "articles"):
        done = settle(extract.extract(texts_of(todo), _client(a), a.model), "results")
    tables.write_results(done, a.results_dir)
    if a.article_files:
        tables.write_article_results(done, a.article_files).count()
    counts = {r["status"]: r["count"] for r in done.groupBy("status").count().collect()}
    print(f"{a.model}: {counts.get('ok', 0)} ok, {counts.get('error', 0)} error, {skipped} skipped")


def score_pilot(spark, a):
    gold = score.typed_gold(tables.read_csv(spark, a.gold, TEMPLATE_COLUMNS)).withColumn("pos", F.monotonically_increasing_id())
    results = tables.read_results(spark, a.results_dir, a.model)
    model = results.where("status = 'ok'").select(F.posexplode("rows").alias("pos", "r")).select("pos", "r.*")
    scores = settle(score.per_article(gold, model, results, a.tol), "scores")
    tables.write_csv(scores.orderBy("doi"), a.out, SCORE_COLUMNS, one_file=True)
    score.summary(scores).show(truncate=False)


def run_pipeline(spark, a):
    """Facts are appended first, results after: an article with facts or with a
    finished result is done, so a run that dies in between repeats nothing."""
    rows = sampling.shard(read_index(spark, a.index), a.shard_index, a.shard_count, ["doi", "xml_path"])
    todo = extract.not_done(rows, tables.read_results(spark, a.results_dir, a.model))
    if tables.exists(spark, a.out):
        todo = todo.join(tables.read_csv(spark, a.out, FACT_COLUMNS).select("doi"), "doi", "left_anti")
    with progress(spark, "articles"):
        done = settle(extract.extract(texts_of(todo), _client(a), a.model, extract.ARTICLE_COLUMNS), "results")
    new, told = _told(extract.facts(done))
    tables.write_csv(new, a.out, FACT_COLUMNS, mode="append")
    tables.write_results(done.select(*RESULT.fieldNames()), a.results_dir)
    print(f"shard {a.shard_index} of {a.shard_count}: {done.count()} articles, {told()['rows']} samples appended to {a.out}")


def merge_shards(spark, a):
    rows, told = _told(tables.read_shards(spark, a.glob, FACT_COLUMNS))
    tables.write_csv(rows, a.out, FACT_COLUMNS)
    print(told()["rows"], "rows merged into", a.out)


def analyze_trends(spark, a):
    facts = tables.read_csv(spark, a.table, FACT_COLUMNS) if a.table.endswith(".csv") else spark.read.parquet(a.table)
    facts = facts.withColumns({c: F.col(c).try_cast("double").cast("int") for c in ["year", *score.FLAGS]})
    for path in trends.export(facts, a.out_dir):
        print(path)
    if not a.no_plots:
        for c, (flag, _) in score.CATEGORIES.items():
            for g in ("year", "stage"):
                trends.plot(trends.reporting_rate(facts, flag, g), g, f"{a.out_dir}/{c}_by_{g}.png")


def _sampled(spark, a):
    """(corpus size, parsed articles with their text) of a systematic sample of the folder."""
    listed = settle(xml_corpus.list_corpus(spark, a.corpus_dir).select("xml_path"), "listed")
    chosen = sampling.systematic(listed, a.sample_size, ["xml_path"])
    files = xml_corpus.read_files(chosen).withColumn("raw", F.col("xml_text"))
    return listed.count(), settle(parse_articles(files), "parsed")


def validate_corpus_filter(spark, a):
    size, parsed = _sampled(spark, a)
    for table in diagnostics.corpus_report(parsed, size):
        table.show(100, truncate=False)


def diagnose_dates(spark, a):
    _, parsed = _sampled(spark, a)
    diagnostics.dates_report(parsed).show(100)
    rows = parsed.where("article.error is null").select(F.year("article.publication_date").alias("year"), "xml_path", text.cut(F.regexp_extract("raw", r"(?s)<pub-date.*</pub-date>", 0), 600).alias("dates"))
    sampling.first_n(rows.where(F.col("year").between(2014, 2016)), ["year"], ["xml_path"], 2).show(truncate=False)


def diagnose_subjects(spark, a):
    _, parsed = _sampled(spark, a)
    diagnostics.subjects_report(parsed).show(100)
    rows = parsed.where(f"article.error is null and year(article.publication_date) = {int(a.year)} and size(article.psychology_subfields) = 0")
    rows.orderBy("xml_path").limit(3).select("xml_path", text.cut(F.regexp_extract("raw", r"(?s)<article-categories.*</article-categories>", 0), 2000).alias("categories")).show(truncate=False)
    kinds = parsed.select(F.explode(F.regexp_extract_all("raw", F.lit('subj-group-type="([^"]*)"'), F.lit(1))).alias("group_type"))
    diagnostics.frequency(kinds, "group_type").show(100, truncate=False)


def probe_search(spark, a):
    year = f"publication_date:[{a.year}-01-01T00:00:00Z TO {a.year}-12-31T23:59:59Z]"
    for clause, hits in paged_search.probe(a.url, [*paged_search.CLAUSES, year]):
        print(hits, clause)


def main(args: list[str] | None = None) -> None:
    s = Settings()
    parser = argparse.ArgumentParser(prog="lectern")
    sub = parser.add_subparsers(required=True)

    def command(f, *options: tuple[str, dict]) -> None:
        p = sub.add_parser(f.__name__.replace("_", "-"))
        p.set_defaults(run=f)
        p.add_argument("--config")
        for name, kw in options:
            p.add_argument(name, **kw)

    need = {"required": True}
    model = [("--backend", {"default": "echo"}), ("--tensor-parallel-size", {"type": int, "default": 1}), ("--model", {"default": s.default_model}), ("--results-dir", {"default": "results"})]
    command(build_corpus_index, ("--corpus-dir", {"default": s.corpus_dir}), ("--out", need))
    command(build_index_search, ("--url", need), ("--corpus-dir", {"default": s.corpus_dir}), ("--out", need), ("--start-year", {"type": int, "default": s.min_year}), ("--end-year", {"type": int, "default": s.max_year}), ("--pause", {"type": float, "default": 1.0}))
    command(sample_articles, ("--index", need), ("--out", need), ("--corpus-dir", {}), ("--any-file", {"action": "store_true"}), ("--per-subfield", {"type": int, "default": s.per_subfield}), ("--seed", {"type": int, "default": s.seed}))
    command(make_gold_template, ("--sample", need), ("--out", need), ("--text-dir", {}))
    command(run_pilot, ("--sample", need), *model, ("--overwrite", {"action": "store_true"}), ("--article-files", {}))
    command(score_pilot, ("--gold", need), ("--out", need), ("--tol", {"type": float, "default": 1.0}), *model[2:])
    command(run_pipeline, ("--index", need), ("--out", need), ("--shard-index", {"type": int, "default": 0}), ("--shard-count", {"type": int, "default": 1}), *model)
    command(merge_shards, ("--glob", need), ("--out", need))
    command(analyze_trends, ("--table", need), ("--out-dir", need), ("--no-plots", {"action": "store_true"}))
    for f, size in ((validate_corpus_filter, 2000), (diagnose_dates, 4000), (diagnose_subjects, 6000)):
        command(f, ("--corpus-dir", {"default": s.corpus_dir}), ("--sample-size", {"type": int, "default": size}), ("--year", {"type": int, "default": 2015}))
    command(probe_search, ("--url", need), ("--year", {"type": int, "default": 2015}))
    a = parser.parse_args(args)
    if a.config:
        for k, v in vars(load_settings(a.config)).items():
            if getattr(a, k, None) in (None, getattr(s, k, None)):
                setattr(a, k, v)
    spark = local_session()
    try:
        a.run(spark, a)
    finally:
        clean(spark)


if __name__ == "__main__":
    main()
