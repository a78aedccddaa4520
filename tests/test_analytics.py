"""The document-analytics operators on small fixtures."""

import datetime
import json
import random
import threading
from functools import partial
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.clients.base import EchoClient, OneByOne, build_client
from lectern.functions import dates, jsonmaps, stages, taxonomy, text
from lectern.operators import diagnostics, extract, index, jats, sampling, score, trends
from lectern.schemas import FACT_COLUMNS, REQUIRED_KEYS
from lectern.sources import paged_search, tables, xml_corpus
from lectern.streaming import ingest


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def article(doi="10.1/a", journal="PLoS ONE", kind="research-article", groups=None, dates_="<pub-date pub-type='epub'><year>2016</year><month>3</month><day>9</day></pub-date>", body=""):
    groups = groups or "<subj-group subj-group-type='Discipline-v3'><subject>Social sciences</subject><subj-group><subject> Psychology </subject><subj-group><subject>Perception</subject></subj-group></subj-group></subj-group>"
    return f"""<article article-type="{kind}"><front><journal-meta><journal-title-group><journal-title>{journal}</journal-title></journal-title-group></journal-meta>
<article-meta><article-id pub-id-type="doi"> {doi} </article-id><title-group><article-title>A <i>mixed</i> title</article-title></title-group>
<article-categories>{groups}</article-categories>
<contrib-group><contrib contrib-type="author"><xref ref-type="aff" rid="a1"/></contrib><contrib contrib-type="author" corresp="yes"><xref ref-type="fn" rid="n"/><xref ref-type="aff" rid="a2"/></contrib></contrib-group>
<aff id="a1"><institution>First U</institution></aff><aff id="a2">Second <b>U</b>, Town</aff>{dates_}</article-meta></front>{body}</article>"""


# ---- stages, dates, paths, maps


@pytest.mark.parametrize(("year", "stage"), [(2009, None), (2010, "early"), (2014, "early"), (2015, "middle"), (2019, "middle"), (2020, "covid"), (2023, "covid"), (2024, "post_covid"), (2026, "post_covid"), (2027, None), (None, None)])
def test_stage(spark, year, stage):
    day = F.lit(datetime.date(year, 12, 31) if year else None).cast("date")
    assert one(spark, stages.stage_of_date(day)) == stage


def test_first_of_overlapping_stages_counts(spark):
    assert one(spark, stages.stage_of_year(F.lit(2000), [("a", 1999, 2001), ("b", 2000, 2002)])) == "a"


@pytest.mark.parametrize(
    ("paths", "found"),
    [(["/S/Psychology/Perception", "/L/Psychology/Perception"], ["Perception"]), (["/S/Psychology"], ["Psychology"]), (["/S/Psychology of music/X"], []), ([], []), (["//S//Psychology//B/C", "/Psychology/Psychology"], ["B", "Psychology"])],
)
def test_subfields_of_paths(spark, paths, found):
    assert one(spark, taxonomy.subfields_of_paths(F.lit(paths).cast("array<string>") if paths else F.array().cast("array<string>"))) == found


def test_names_and_lists(spark):
    assert one(spark, taxonomy.xml_path_of_doi(F.lit("10.1/j.x.1"), "/c/")) == "/c/j.x.1.xml"
    assert one(spark, taxonomy.split_list(F.lit(" a;; b c ;"))) == ["a", "b c"]
    assert one(spark, taxonomy.join_list(F.lit(None).cast("array<string>"))) == ""
    assert one(spark, taxonomy.has_token(F.lit("Social psychology;B"), "psychology")) is False
    assert taxonomy.folder_of_model("a/b") == "a__b"


@pytest.mark.parametrize(("given_text", "day"), [("2015-02-03T00:00:00Z", "2015-02-03"), ("2015-2", None), ("2015-02-30", None), (None, None), ("", None), ("20150203", None)])
def test_iso_date(spark, given_text, day):
    found = one(spark, dates.iso_date(F.lit(given_text).cast("string")))
    assert (str(found) if found else None) == day


def test_date_of_parts(spark):
    parts = lambda y, m, d: one(spark, dates.date_of_parts(F.lit(y).cast("string"), F.lit(m).cast("string"), F.lit(d).cast("string")))
    assert parts("2016", "3", None) == datetime.date(2016, 3, 1)
    assert parts("2016", "13", "1") is None and parts(None, "1", "1") is None and parts("2016", None, "") == datetime.date(2016, 1, 1)


@pytest.mark.parametrize(("value", "number"), [("45%", None), ("1,000", None), ("", None), (" 7 ", 7.0), ("1e3", 1000.0), ("nan", None), ("5d", None), (None, None)])
def test_lenient_number(spark, value, number):
    assert one(spark, jsonmaps.lenient_number(F.lit(value).cast("string"))) == number


def test_maps(spark):
    lenient = lambda t: one(spark, jsonmaps.lenient_map(F.lit(t).cast("string")))
    assert lenient('{"a": 1}') == {"a": "1"} and lenient("[1]") == lenient("x") == lenient("") == lenient(None) == {}
    agree = lambda a, b: one(spark, jsonmaps.maps_agree(jsonmaps.strict_map(F.lit(a)), jsonmaps.strict_map(F.lit(b))))
    assert agree('{"a": 1.0}', "{}") and not agree('{"a": 1.01}', "{}") and agree("{}", "") and agree('{"a": 2, "b": 3}', '{"b": 2, "a": 3}')
    with pytest.raises(Exception):
        one(spark, jsonmaps.strict_map(F.lit("{bad")))
    assert one(spark, jsonmaps.missing_keys(F.lit('{"b": 1}'), ["c", "b", "a"])) == ["a", "c"]


def test_prompt_keeps_braces(spark):
    p = one(spark, text.build_prompt(F.lit("10.1/a"), F.lit("x {doi} y")))
    assert "Article DOI: 10.1/a\n" in p and "x {doi} y" in p
    assert one(spark, text.doi_in_prompt(F.lit(p))) == "10.1/a"


# ---- XML


def test_metadata():
    m = dict(zip(("doi", "title", "journal", "article_type", "date", "level_1", "subject", "subfields", "institution", "text"), jats.metadata(jats.parse(article()))))
    assert m["doi"] == "10.1/a" and m["title"] == "A mixed title" and m["journal"] == "PLoS ONE" and m["date"] == datetime.date(2016, 3, 9)
    assert m["level_1"] == ["Social sciences"] and m["subject"] == ["Social sciences", "Psychology", "Perception"] and m["subfields"] == ["Perception"]
    assert m["institution"] == "Second U, Town" and m["text"] == ""


@pytest.mark.parametrize(
    ("given_dates", "day"),
    [
        ("<pub-date pub-type='collection'><year>2011</year></pub-date><pub-date pub-type='epub'><year>2012</year><month>2</month><day>30</day></pub-date>", datetime.date(2011, 1, 1)),
        ("<pub-date pub-type='x'><year>2013</year><month>5</month></pub-date>", datetime.date(2013, 5, 1)), ("<pub-date pub-type='epub'><month>5</month></pub-date>", None), ("", None),
    ],
)
def test_date_fallback(given_dates, day):
    assert jats.publication_date(jats.parse(article(dates_=given_dates))) == day


def test_node_as_leaf_and_in_any_group():
    groups = "<subj-group subj-group-type='heading'><subject>Psychology</subject></subj-group><subj-group subj-group-type='Discipline'><subject>L</subject><subj-group><subject>Psychology</subject><subj-group><subject>B</subject></subj-group><subj-group><subject>Psychology</subject></subj-group></subj-group></subj-group>"
    assert jats.subfields(jats.parse(article(groups=groups))) == ["Psychology", "B"]


def test_methods_first_and_no_doubling():
    body = "<body><sec><title>Intro</title><p>i</p></sec><sec><title>Study 1</title><p>s</p><sec><title>Participants</title><p>p</p></sec></sec></body>"
    t = jats.extraction_text(jats.parse(article(body=body)))
    assert t == "Study 1sParticipantsp\n\nIntroi"
    assert jats.extraction_text(jats.parse(article(body="<body><p>only</p></body>"))) == "only"


def test_index_of_a_folder(spark, tmp_path):
    files = {
        "a.xml": article(), "b.xml": article(kind="editorial"), "c.xml": article(journal="Other"), "d.xml": article(groups="<subj-group subj-group-type='Discipline'><subject>Biology</subject></subj-group>"),
        "e.xml": "<article><front>", "f.xml": "<!DOCTYPE article SYSTEM 'http://nowhere.invalid/x.dtd'>" + article("10.1/f").replace("mixed", "mi&nbsp;xed"), "g.xml": article(dates_=""), "h.xml": article(dates_="<pub-date><year>2009</year></pub-date>"),
        "note.txt": "x",
    }
    for n, t in files.items():
        (tmp_path / n).write_text(t)
    rows = index.from_xml(xml_corpus.read_corpus(spark, str(tmp_path))).collect()
    assert sorted(r["doi"] for r in rows) == ["10.1/a", "10.1/f"] and {r["stage"] for r in rows} == {"middle"}
    assert xml_corpus.corpus_size(spark, str(tmp_path)) == 8
    assert [r["xml_path"][-5:] for r in index.rejected(xml_corpus.read_corpus(spark, str(tmp_path))).collect()] == ["e.xml"]
    out, mark = f"{tmp_path}/sub/out", f"{tmp_path}/sub/mark"
    ingest.ingest(spark, str(tmp_path), out, mark).awaitTermination()
    (tmp_path / "i.xml").write_text(article("10.1/i"))
    ingest.ingest(spark, str(tmp_path), out, mark).awaitTermination()
    assert sorted(r["doi"] for r in spark.read.parquet(out).collect()) == ["10.1/a", "10.1/f", "10.1/i"]


def test_no_corpus(spark, tmp_path):
    for folder in (str(tmp_path), f"{tmp_path}/none"):
        with pytest.raises(xml_corpus.CorpusNotFoundError):
            xml_corpus.ensure_corpus(spark, folder)


# ---- search source


class _Service(BaseHTTPRequestHandler):
    asked: list = []

    def do_GET(self):  # noqa: N802
        q = parse_qs(urlparse(self.path).query)
        year = int((q["fq"][-1].split("[") + ["2000"])[1][:4])
        self.asked.append(year)
        hits = [{"id": f"10.1/{year}.{i}", "subject": ["/S/Psychology/Perception"] if i else [], "publication_date": f"{year}-05-01T00:00:00Z"} for i in range(5)]
        start, rows = int(q.get("start", ["0"])[0]), int(q["rows"][0])
        body = json.dumps({"response": {"numFound": 5, "docs": hits[start : start + rows]}}).encode()
        self.send_response(500 if year == 1999 else 200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def service():
    server = HTTPServer(("127.0.0.1", 0), _Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/search"
    server.shutdown()


def test_search_source(spark, service):
    paged_search.register(spark)
    hits = spark.read.format("paged_search").options(url=service, start_year=2014, end_year=2016, rows=2, pause=0).load()
    assert hits.count() == 15 and hits.rdd.getNumPartitions() == 3
    rows = index.from_search(hits, "/c").collect()
    assert len(rows) == 12 and {r["stage"] for r in rows} == {"early", "middle"} and rows[0]["xml_path"].startswith("/c/20")
    with pytest.raises(Exception):
        spark.read.format("paged_search").options(url=service, start_year=1999, end_year=1999, pause=0).load().count()


def test_search_filters_are_pushed():
    from pyspark.sql.datasource import EqualTo, GreaterThan

    reader = paged_search.SearchReader({"url": "x", "start_year": "2010", "end_year": "2020"})
    rest = list(reader.pushFilters([GreaterThan(("year",), 2017), EqualTo(("id",), "a")]))
    assert reader.years == [2018, 2019, 2020] and len(rest) == 1


# ---- sampling


@pytest.fixture(scope="module")
def population(spark):
    rows = [(i, f"d{i}", ["A"] if i < 5 else ["B", "C"] if i == 7 else ["B"]) for i in range(10)]
    return spark.createDataFrame(rows, "row_no int, doi string, matched_subfields array<string>").repartition(3)


def test_stratified_draw_is_that_of_one_generator(population):
    got = [(r["subfield"], r["row_no"]) for r in sampling.stratified_by_draw(population, F.col("matched_subfields"), "row_no", 2, 42).orderBy("draw_no").collect()]
    rng = random.Random(42)
    assert got == [("A", i) for i in rng.sample(range(5), 2)] + [("B", i) for i in rng.sample(range(5, 10), 2)]
    with pytest.raises(ValueError, match="C"):
        sampling.stratified_by_draw(population, F.col("matched_subfields"), "row_no", 2, wanted=["C"])


def test_too_many_strata_are_an_error(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [f"s{i}"]) for i in range(4)], "row_no long, of array<string>")
    monkeypatch.setattr(sampling, "MAX_STRATA", 4)
    assert sampling.stratified_by_draw(rows, F.col("of"), "row_no", 1).count() == 4
    monkeypatch.setattr(sampling, "MAX_STRATA", 3)
    with pytest.raises(ValueError, match="more than 3 strata"):
        sampling.stratified_by_draw(rows, F.col("of"), "row_no", 1, wanted=["s3"])


def test_stratified_hash(population):
    got = sampling.stratified_by_hash(population, F.col("matched_subfields"), "doi", 2).groupBy("subfield").count().collect()
    assert {r["subfield"]: r["count"] for r in got} == {"A": 2, "B": 2}


def test_first_seen(population):
    got = sampling.first_seen(population, F.col("matched_subfields"), F.col("row_no")).orderBy("seen").collect()
    assert [r["token"] for r in got] == ["A", "B", "C"]


def test_shards_partition_the_rows(spark):
    rows = spark.range(101).repartition(5)
    parts = [sorted(r["id"] for r in sampling.shard(rows, i, 4, ["id"]).collect()) for i in range(4)]
    assert parts == [list(range(i, 101, 4)) for i in range(4)] and sampling.shard(rows, 0, 1, ["id"]).count() == 101
    hashed = [r["id"] for i in range(4) for r in sampling.hash_shard(rows, i, 4, "id").collect()]
    assert sorted(hashed) == list(range(101))


def test_numbers_are_those_of_the_order(spark):
    rows = spark.range(60_000).select((F.col("id") * 7919 % 60_000).alias("k")).repartition(7)
    got = sampling.numbered(rows, ["k"], "n")
    assert got.where("n <> k").count() == 0 and got.count() == 60_000


def test_systematic(spark):
    assert sorted(r["id"] for r in sampling.systematic(spark.range(100).repartition(3), 30, ["id"]).collect()) == list(range(0, 100, 3))
    assert sampling.systematic(spark.range(0), 30, ["id"]).count() == 0


# ---- extraction


class Flaky(OneByOne):
    def __init__(self, model):
        self.model = model

    def generate(self, prompt):
        doi = prompt.split("Article DOI: ")[1].split("\n")[0]
        row = json.loads(EchoClient("m").generate(prompt))[0]
        answers = {
            "text": "no", "object": "{}", "scalar": "[1]", "key": json.dumps([{k: v for k, v in row.items() if k != "race_pct"}]), "doi": json.dumps([row | {"doi": "x"}]), "empty": "[]",
            "extra": json.dumps([row | {"more": 1, "gender_pct": {"male": 40, "other": "n/a"}, "ses_value": 5}, row | {"sample_id": 2}]), "tail": json.dumps([row]) + " done",
        }
        if doi == "raise":
            raise RuntimeError("boom")
        return answers.get(doi, json.dumps([row]))


def test_extraction_isolates_errors(spark):
    dois = ["text", "object", "scalar", "key", "doi", "empty", "extra", "tail", "raise", "fine"]
    done = extract.extract(spark.createDataFrame([(d, None) for d in dois], "doi string, text string"), Flaky, "m").persist()
    got = {r["doi"]: r for r in done.collect()}
    assert {d for d, r in got.items() if r["status"] == "ok"} == {"empty", "extra", "fine"}
    assert "not JSON" in got["tail"]["error"] and "lacks race_pct" in got["key"]["error"] and "boom" in got["raise"]["error"] and "not an array" in got["object"]["error"]
    assert got["empty"]["rows"] == [] and [r["sample_id"] for r in got["extra"]["rows"]] == [1, 2]
    assert got["extra"]["rows"][0]["gender_pct"] == {"male": 40.0, "other": None} and got["extra"]["rows"][0]["ses_value"] == "5"
    todo = spark.createDataFrame([(d,) for d in dois], "doi string")
    assert sorted(r["doi"] for r in extract.not_done(todo, done).collect()) == sorted(set(dois) - {"empty", "extra", "fine"})
    assert extract.not_done(todo, done, overwrite=True).count() == len(dois)


def test_results_are_written_and_resumed(spark, tmp_path):
    articles = spark.createDataFrame([("10.1/a", "t"), ("10.1/b", "t")], "doi string, text string")
    folder = str(tmp_path / "results")
    assert tables.read_results(spark, folder, "my/model").count() == 0
    tables.write_results(extract.extract(articles, partial(build_client, "echo"), "my/model"), folder)
    back = tables.read_results(spark, folder, "my/model")
    assert back.where("status = 'ok'").count() == 2 and extract.not_done(articles, back).count() == 0
    tables.write_article_results(back, f"{tmp_path}/files").count()
    one = json.loads((tmp_path / "files/my__model/10.1_a.json").read_text())
    assert one["doi"] == "10.1/a" and one["status"] == "ok" and [r["sample_id"] for r in one["rows"]] == [1]


def test_facts_have_the_columns_of_their_article(spark):
    columns = "doi string, text string, matched_subfields array<string>, subject_level_1 array<string>, subject array<string>, publication_date date, year int, stage string, lead_institution string"
    articles = spark.createDataFrame([("a", "t", ["S", "R"], None, None, None, 2012, "early", "I"), ("b", "t", None, None, None, None, None, None, None), ("b", "t", [], None, None, None, 1, None, None)], columns)
    facts = extract.facts(extract.extract(articles, EchoClient, "m", extract.ARTICLE_COLUMNS))
    assert facts.columns == FACT_COLUMNS
    assert sorted((tuple(r) for r in facts.select("doi", "subfield", "sample_id", "year", "lead_institution").collect()), key=str) == [("a", "S", 1, 2012, "I"), ("b", None, 1, 1, None), ("b", None, 1, None, None)]


class Batched(OneByOne):
    """Batches that fail, or come back short or long, as the model's name says; one prompt always fails."""

    def __init__(self, model):
        if model == "unbuilt":
            raise RuntimeError("no GPU")
        self.model = model

    def generate_batch(self, prompts):
        if len(prompts) > 2 and self.model == "fails" or any("DOI: bad" in p for p in prompts):
            raise RuntimeError("out of memory")
        got = [EchoClient("m").generate(p) for p in prompts]
        return got[1:] if self.model == "short" and len(got) > 1 else got + got[:1] if self.model == "long" and len(got) > 1 else got


@pytest.mark.parametrize("model", ["fine", "fails", "short", "long", "unbuilt"])
def test_one_failing_batch_fails_no_other_article(spark, model):
    dois = ["a", "b", "bad", "c", "d", "gone"]
    articles = spark.createDataFrame([(d, "t", "no such file" if d == "gone" else None) for d in dois], "doi string, text string, problem string").coalesce(1)
    got = {r["doi"]: r for r in extract.extract(articles, Batched, model).collect()}
    assert set(got) == set(dois) and got["gone"]["error"] == "no such file"
    if model == "unbuilt":
        assert all(r["status"] == "error" for r in got.values()) and "no GPU" in got["a"]["error"]
    else:
        assert "out of memory" in got["bad"]["error"] and all(got[d]["status"] == "ok" and got[d]["rows"][0]["doi"] == d for d in "abcd")


def test_answers_are_sorted_by_their_request(monkeypatch):
    import sys
    import types

    made = {}

    class LLM:
        def __init__(self, model, **options):
            made.update(options)

        def generate(self, prompts, params):
            out = [types.SimpleNamespace(request_id=str(i), outputs=[types.SimpleNamespace(text=p)]) for i, p in enumerate(prompts)]
            return out[::-1]

    monkeypatch.setitem(sys.modules, "vllm", types.SimpleNamespace(LLM=LLM, SamplingParams=dict))
    prompts = [f"p{i}" for i in range(12)]
    assert build_client("vllm", "m", tensor_parallel_size=4).generate_batch(prompts) == prompts and made == {"dtype": "bfloat16", "tensor_parallel_size": 4}


def test_transformers_run_in_half_precision(monkeypatch):
    import sys
    import types

    made = {}

    def pipeline(task, **options):
        made.update(options)
        return lambda prompt, **asked: [{"generated_text": f"{prompt} {asked['do_sample']}"}]

    monkeypatch.setitem(sys.modules, "torch", types.SimpleNamespace(bfloat16="bf16"))
    monkeypatch.setitem(sys.modules, "transformers", types.SimpleNamespace(pipeline=pipeline))
    assert build_client("transformers", "m").generate_batch(["p"]) == ["p False"] and made["torch_dtype"] == "bf16" and made["device_map"] == "auto"


def test_unknown_client():
    with pytest.raises(ValueError, match="nobody"):
        build_client("nobody", "m")


def test_gold_template(spark):
    row = extract.gold_template(spark.createDataFrame([("10.1/a", None)], "doi string, subfield string")).first().asDict()
    assert set(REQUIRED_KEYS) <= set(row) and row["sample_id"] == 1 and row["race_pct"] == "{}" and row["title"] == ""


# ---- scoring

GOLD = {"gender_reported": 1, "race_reported": 0, "education_reported": 0, "ses_reported": 2, "gender_pct": {"male": 40.0}, "race_pct": {}, "education_pct": {}, "ses_value": "100"}
_ROW = "doi string, sample_id int, pos int, gender_reported int, race_reported int, education_reported int, ses_reported int, gender_pct map<string,double>, race_pct map<string,double>, education_pct map<string,double>, ses_value string"


def scores(spark, gold, model, results):
    make = lambda rows: spark.createDataFrame([{"doi": d, "sample_id": s, "pos": i, **GOLD, **x} for i, (d, s, x) in enumerate(rows)], _ROW)
    done = spark.createDataFrame([(d, st_, True) for d, st_ in results], "doi string, status string, full_keys boolean")
    table = score.per_article(make(gold), make(model), done).persist()
    return {r["doi"]: r.asDict() for r in table.collect()}, score.summary(table).first().asDict()


def test_perfect_score(spark):
    per, total = scores(spark, [("a", 1, {})], [("a", 1, {})], [("a", "ok")])
    assert per["a"]["reporting_flag_accuracy"] == per["a"]["numeric_accuracy"] == 1.0 and per["a"]["notes"] == ""
    assert total == {"n_articles": 1, "reporting_flag_accuracy": 1.0, "numeric_accuracy": 1.0, "sample_count_match_rate": 1.0, "schema_ok_rate": 1.0}


def test_flags_tolerance_and_repeats(spark):
    model = [("a", 1, {"race_reported": 1, "gender_pct": {"male": 41.0}, "ses_value": "102"}), ("b", 1, {}), ("b", 2, {}), ("b", 2, {"gender_pct": {"male": 50.0}}), ("extra", 1, {})]
    per, total = scores(spark, [("a", 1, {}), ("b", 1, {}), ("c", 1, {}), ("d", 1, {})], model, [("a", "ok"), ("b", "ok"), ("d", "error"), ("extra", "ok")])
    assert set(per) == {"a", "b", "c", "d"}
    assert per["a"]["reporting_flag_accuracy"] == 0.75 and per["a"]["numeric_accuracy"] == 0.5 and "race_reported" in per["a"]["notes"]
    assert per["b"]["sample_count_match"] is False and per["b"]["n_model_samples"] == 2
    assert per["c"]["notes"] == "no model output" and per["c"]["reporting_flag_accuracy"] == 0.0 and per["d"]["notes"] == "model status=error"
    assert total["reporting_flag_accuracy"] == 7 / 8 and total["sample_count_match_rate"] == 0.25 and total["schema_ok_rate"] == 0.5


def test_empty_scores(spark):
    per, total = scores(spark, [], [], [])
    assert per == {} and total["n_articles"] == 0 and total["reporting_flag_accuracy"] is None


def test_typed_gold(spark, tmp_path):
    (tmp_path / "gold.csv").write_text('doi,sample_id,gender_reported,gender_pct,race_reported,race_pct,education_reported,education_pct,ses_reported,ses_value\n10.1/a,0,1.0,"{""male"": 40}",,,0,{},2,\n,1,,,,,,,,\n')
    rows = score.typed_gold(tables.read_csv(spark, f"{tmp_path}/gold.csv", REQUIRED_KEYS)).collect()
    assert len(rows) == 1 and rows[0]["sample_id"] == 1 and rows[0]["gender_reported"] == 1 and rows[0]["gender_pct"] == {"male": 40.0} and rows[0]["race_pct"] == {} and rows[0]["ses_value"] is None


# ---- trends and diagnostics


@pytest.fixture(scope="module")
def facts(spark):
    rows = [(2016, "middle", 1, '{"male": 40, "female": "60"}', 0), (2016, "middle", None, "{}", None), (2021, "covid", 1, '{"male": "45%", "x": "nan"}', 2), (None, "odd", 1, '{"male": 1}', 1), (2021, None, 0, "[1]", 2)]
    wide = spark.createDataFrame(rows, "year int, stage string, gender_reported int, gender_pct string, ses_reported int")
    return wide.withColumns({c: F.lit(0) if "rep" in c else F.lit("") for c in ("race_reported", "race_pct", "education_reported", "education_pct")})


def test_trends(facts, tmp_path):
    assert {r["year"]: r["reporting_rate_pct"] for r in trends.reporting_rate(facts, "gender_reported", "year").collect()} == {2016: 50.0, 2021: 50.0}
    means = {(r["year"], r["subgroup"]): (r["mean_pct"], r["n"]) for r in trends.subgroup_means(facts, "gender_reported", "gender_pct", "year").collect()}
    assert means == {(2016, "male"): (40.0, 1), (2016, "female"): (60.0, 1), (2021, "male"): (None, 0), (2021, "x"): (None, 0)}
    assert {(r["year"], r["ses_reported"]): r["share_pct"] for r in trends.value_share(facts, "ses_reported", "year").collect()} == {(2016, 0): 100.0, (2021, 2): 100.0}
    ordered = [r["stage"] for r in trends.in_order(trends.reporting_rate(facts, "gender_reported", "stage"), "stage").collect()]
    assert ordered == ["middle", "covid", None]
    single = {(r["group_value"], r["reporting_rate_pct"]) for r in trends.all_rates(facts).where("category = 'gender' and group_by = 'year'").collect()}
    assert single == {("2016", 50.0), ("2021", 50.0)}
    assert len(trends.export(facts, str(tmp_path / "t"))) == 14


def test_diagnostics(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (None, "a"), (4, "b")], "n int, s string")
    p = {"even": F.col("n") % 2 == 0, "has_s": F.col("s").isNotNull()}
    assert diagnostics.funnel(rows, p, 1000).first().asDict() == {"total": 4, "even": 2, "has_s": 3, "all_of_them": 1, "all_pct": 25.0, "estimate": 200.0}
    assert tuple(diagnostics.cumulative(rows, list(p.items())).first()) == (2, 1)
    assert [tuple(r) for r in diagnostics.histogram(rows, F.col("n")).collect()] == [("1", 1), ("2", 1), ("4", 1), ("NONE", 1)]
    assert [tuple(r) for r in diagnostics.frequency(rows, "s").collect()] == [("a", 2), (None, 1), ("b", 1)]


def test_shards_are_united(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        tables.read_shards(spark, f"{tmp_path}/s*.csv", ["doi", "sample_id"])
    (tmp_path / "s1.csv").write_text("doi,sample_id\na,1\n")
    (tmp_path / "s2.csv").write_text("doi\nb\nc\n")
    assert sorted((r["doi"], r["sample_id"]) for r in tables.read_shards(spark, f"{tmp_path}/s*.csv", ["doi", "sample_id"]).collect()) == [("a", "1"), ("b", None), ("c", None)]
    (tmp_path / "s3.csv").write_text("doi,odd\nd,1\n")
    with pytest.raises(ValueError, match="odd"):
        tables.read_shards(spark, f"{tmp_path}/s*.csv", ["doi", "sample_id"])


def test_csv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([('say "hi",\nyou', ["a", "b"], {"m": 1.5}, None)], "t string, l array<string>, p map<string,double>, n string")
    tables.write_csv(rows, f"{tmp_path}/out.csv", ["t", "l", "p", "n"], one_file=True)
    back = tables.read_csv(spark, f"{tmp_path}/out.csv", ["t", "l", "p", "n"]).first()
    assert back["t"] == 'say "hi",\nyou' and back["l"] == "a;b" and json.loads(back["p"]) == {"m": 1.5} and not back["n"]


@settings(max_examples=30, deadline=None)
@given(st.integers(2010, 2026))
def test_every_year_in_range_has_one_stage(year):
    assert sum(a <= year <= b for _, a, b in stages.STAGES) == 1


def test_commands(spark, tmp_path, capfd):
    from lectern import cli

    (tmp_path / "corpus").mkdir()
    body = "<body><sec><title>Methods</title><p>m</p></sec></body>"
    for i in range(4):
        (tmp_path / f"corpus/a{i}.xml").write_text(article(f"10.1/a{i}", body=body))
    t = lambda n: f"{tmp_path}/{n}"
    cli.main(["build-corpus-index", "--corpus-dir", t("corpus"), "--out", t("index.csv")])
    cli.main(["sample-articles", "--index", t("index.csv"), "--out", t("sample.csv")])
    cli.main(["make-gold-template", "--sample", t("sample.csv"), "--out", t("gold.csv"), "--text-dir", t("texts")])
    cli.main(["run-pilot", "--sample", t("sample.csv"), "--results-dir", t("results"), "--model", "m", "--article-files", t("files")])
    cli.main(["run-pilot", "--sample", t("sample.csv"), "--results-dir", t("results"), "--model", "m"])
    assert len(list((tmp_path / "files/m").glob("*.json"))) == 2 and "m: 0 ok, 0 error, 2 skipped" in capfd.readouterr().out
    cli.main(["score-pilot", "--gold", t("gold.csv"), "--results-dir", t("results"), "--model", "m", "--out", t("scores.csv")])
    for shard in ("0", "1", "0"):
        cli.main(["run-pipeline", "--index", t("index.csv"), "--out", t("facts.csv"), "--results-dir", t("results2"), "--model", "m", "--shard-index", shard, "--shard-count", "2", "--tensor-parallel-size", "4"])
    cli.main(["merge-shards", "--glob", t("facts.csv/part*"), "--out", t("all.csv")])
    cli.main(["analyze-trends", "--table", t("all.csv"), "--out-dir", t("trends"), "--no-plots"])
    assert spark.read.csv(t("scores.csv"), header=True).count() == 2 and len(list((tmp_path / "texts").glob("*.txt"))) == 2
    assert spark.read.csv(t("all.csv"), header=True).count() == 4
    said = capfd.readouterr().out
    for line in ("shard 0 of 2: 2 articles, 2 samples", "shard 0 of 2: 0 articles, 0 samples", "4 rows merged"):
        assert line in said, line
    assert spark.read.csv(t("trends/gender_reporting_rate_by_year.csv"), header=True).first()["reporting_rate_pct"] == "0.0"


def test_diagnostic_commands(spark, tmp_path, capfd, service):
    from lectern import cli

    (tmp_path / "a.xml").write_text(article("10.1/a"))
    (tmp_path / "b.xml").write_text(article("10.1/b", groups="<subj-group subj-group-type='heading'><subject>Biology</subject></subj-group>", dates_="<pub-date><year>2015</year></pub-date>"))
    (tmp_path / "c.xml").write_text("<broken")
    for command in ("validate-corpus-filter", "diagnose-dates", "diagnose-subjects"):
        cli.main([command, "--corpus-dir", str(tmp_path)])
    cli.main(["probe-search", "--url", service])
    said = capfd.readouterr().out
    assert "Perception" in said and "2016" in said and "heading" in said and said.count("5 doc_type:full") == 1
