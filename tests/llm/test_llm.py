"""The operators for language-model data on small fixtures, against plain Python."""

import math
import os
import random
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.llm import lowest, mix, names, pii, pii_rules, queries, sample, split, tokens
from tests.sqlcheck import DATA, check

TOKENIZERS = os.path.exists(f"{tokens.DEFAULT_FOLDER}/{tokens.BYTE_BPE}")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    check(spark, queries.QUERIES[name], queries.SQL[name])


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, DATA).count() >= 0


# ---- names

SPELLINGS = [
    {"Brimvale University", "University of Brimvale", "Univ. of Brimvale", "brimvale university", "Brimvale, University of", "Brímvale University", "University  of Brimvale (UK)", "Brimvlae University", "Dept Psychol, Brimvale University", "Brimvale U."},
    {"Brimvale State University", "Brimvale State", "State University of Brimvale"},
    {"Brimvale General Hospital", "General Hospital of Brimvale", "Brimvale Genl Hosp", "Brimvale General Hospital (BGHRE)", "BGHRE", "Department of Psychology; Brimvale General Hospital; USA"},
    {"William Dorkenfeld College", "Will Dorkenfeld College", "W. Dorkenfeld Coll.", "Dorkenfeld, William, College", "William Dorkenfeld Colege, Tollmouth"},
    {"Quartzmere Research Centre for Mind and Behavioural Science", "Quartzmere Rsch Ctr. for Mind &amp; Behav. Sci.", "Quartzmere Mind & Behaviour Centre"},
]


def _linked(spark, values):
    rows = spark.createDataFrame([(v,) for v in values], "lead_institution string").withColumn("name", F.lit("x"))
    return [tuple(r) for r in names.pairs(names.entities(rows, "lead_institution")).collect()]


def test_spellings_are_linked_and_institutions_are_not(spark):
    values = [v for group in SPELLINGS for v in group] + [None, "", "  "] + ["Brimvale University"] * 3
    got = _linked(spark, values)
    want = {(a, b) for g in SPELLINGS for a in g for b in g if a < b}
    assert set(got) == want and len(got) == len(want)


def _forms(name, n):
    return [f"{p}{name}{s} University" for p in ("", "The ", "the ", "THE ") for s in ("", " ", ",", " -", ";", " .")][:n]


@pytest.mark.parametrize("n", [2, 3, 5])
def test_a_frequent_second_spelling_is_linked(spark, n):
    values = _forms("Quarlingen", 8) + _forms("Quaerlingen", n)
    got = _linked(spark, values)
    assert len(got) == len(set(got)) == len(values) * (len(values) - 1) // 2


def test_look_alikes_with_their_own_abbreviations_stay_apart(spark):
    a = [*_forms("Brimvalen", 4), "Brimvalen University (BURN)", "University of Brimvalen (UBRN)"]
    b = [*_forms("Brimvales", 3), "Brimvales University (BURS)"]
    assert set(_linked(spark, a + b)) == {(x, y) for g in (a, b) for x in g for y in g if x < y}


APART = [
    ("University of North Carolina", "University of South Carolina"), ("New York University", "University of York"), ("University of California, Berkeley", "University of California, Los Angeles"),
    ("Northern Illinois University", "Northern Michigan University"), ("King's College London", "University College London"), ("Northwestern University", "Southwestern University"),
    ("University of Kent", "University of Bath"), ("Kent State University", "Penn State University"), ("St John's College", "St Mary's College"), ("Boston University", "Boston College"),
    ("University of New South Wales", "University of South Wales"), ("University of Ireland, Galway", "University of Ireland, Maynooth"), ("Robert Brimvale College", "Richard Brimvale College"),
]
TOGETHER = [
    ("University of Kent", "Univ. of Kent, UK"), ("New York University", "new york univ, USA"), ("King's College London", "Kings Coll. London; England"), ("University of Michigan", "Univeristy of Michigan, Ann Arbor"),
    ("University of California, Berkeley", "Univ California, Berkeley, USA"), ("Northern Illinois University", "Nothern Illinois University, Dept. of Psychology"), ("Massachusetts Institute of Technology", "Massachusets Inst. of Technol."),
]


def test_well_known_names(spark):
    values = sorted({v for pair in APART + TOGETHER for v in pair})
    got = set(_linked(spark, values))
    assert not got & {tuple(sorted(p)) for p in APART}
    assert got >= {tuple(sorted(p)) for p in TOGETHER}
    for pair in APART:
        assert _linked(spark, pair) == [], pair


def test_given_names_and_campuses_count_only_where_they_tell(spark):
    a = ["Robert Brimvale College", "Bob Brimvale College", "Brimvale College, Rob", "Rboert Brimvale College"]
    b = ["Susan Brimvale College", "S. Brimvale College", "Sue Brimvale College, Tollmouth"]
    assert set(_linked(spark, a + b)) == {tuple(sorted((x, y))) for g in (a, b) for x in g for y in g if x != y}
    c = ["Brimvale College", *a, "R. Brimvale College, Tollmouth, UK"]
    assert len(_linked(spark, c)) == 15


def test_abbreviations_alone(spark):
    values = ["Quartzmere Institute of Technology", "QITZE", "Dorkenfeld Institute of Technology (DITKL)", "DITKL", "XYZ", "Brimvale University", "Bromvaal University", "BUAL"]
    got = set(_linked(spark, values))
    assert got == {("QITZE", "Quartzmere Institute of Technology"), ("DITKL", "Dorkenfeld Institute of Technology (DITKL)")}


def test_no_names(spark):
    assert _linked(spark, []) == [] and _linked(spark, [None, ""]) == [] and _linked(spark, ["???"]) == []


def test_large_entities_are_joined_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(names, "BLOCK", 3)
    rows = spark.createDataFrame([(f"v{i}", "e") for i in range(10)], "value string, entity string")
    assert names.pairs(rows).count() == 45


def _osa(a, b):
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=9), st.text("abc", max_size=9), st.integers(0, 4))
def test_banded_distance(a, b, most):
    assert names.edit_distance(a, b, most) == min(_osa(a, b), most + 1)


@pytest.mark.parametrize("hot", [2000, 2])
def test_segments_find_all_near_words(spark, monkeypatch, hot):
    monkeypatch.setattr(names, "HOT_SEGMENT", hot)
    rng = random.Random(3)
    base = ["".join(rng.choice("abdefgiklmnorstu") for _ in range(rng.randint(8, 14))) for _ in range(60)]
    typed = set(base)
    for b in base:
        at = rng.randrange(len(b) - 1)
        typed |= {b[:at] + b[at + 1 :], b[:at] + "z" + b[at:], b[:at] + b[at + 1] + b[at] + b[at + 2 :]}
    rows = spark.createDataFrame([(t, 9 if t in base else 1) for t in sorted(typed)], "word string, forms long")
    got = {(r["word"], r["other"]) for r in names.near_words(rows).collect()}
    want = {(a, b) for a in typed - set(base) for b in base if _osa(a, b) <= names.EDITS}
    assert want <= got


def _joins_on_key(rows):
    """The joins on a segment or on initials, as they ran."""
    rows.collect()
    ran = rows._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in ran
    return re.findall(r"(\w+Join) \[key#", ran.partition("== Initial Plan ==")[0])


def test_what_is_cut_from_words_is_not_broadcast(spark, tmp_path):
    def stored(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    words = stored("words", [("brimvale", 2), ("brimvael", 1), ("dorkenfeld", 2)], "word string, forms long")
    assert _joins_on_key(names.near_words(words)) == ["SortMergeJoin"]
    known = stored("known", [("v", "e", ["brimvale"], "bu", "")], "value string, entity string, words array<string>, initials string, mark string")
    alone = stored("alone", [("BUAL", "bual")], "value string, mark string")
    assert _joins_on_key(names.abbreviated(alone, known)) == ["SortMergeJoin"]


# ---- splitting

TEXTS = st.text(st.sampled_from("ab .,!?\n\r\té字。；— ́"), max_size=400)


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.integers(5, 60), st.integers(0, 4))
def test_pieces(text, limit, overlap):
    pieces = split.split(text, limit, overlap)
    assert "".join(text[own:end] for _, own, end, _ in pieces) == text
    assert all(end - start <= max(limit, 0) for start, _, end, _ in pieces)
    assert (len(pieces) == 1) == (len(text) <= limit)
    for (_, _, end, _), (start, own, _, _) in zip(pieces, pieces[1:]):
        assert own == end and own - start == min(overlap, own)


def test_cuts_at_the_strongest_boundaries():
    text = "One two three. Four five six.\n\nSeven eight nine. Ten."
    assert [text[o:e] for _, o, e, _ in split.split(text, 31, 0)] == ["One two three. Four five six.\n\n", "Seven eight nine. Ten."]
    assert [k for *_, k in split.split("a" * 25, 10, 2)] == ["cut", "cut", "cut", "end"]


def test_split_table(spark):
    rows = spark.createDataFrame([(1, "x" * 11 + " y", "s"), (2, "", "s"), (3, None, "s"), (4, "z" * 50, None), (5, "ok", "s")], "text_id long, body_text string, size_class string").withColumn("piece", F.lit(1))
    limits = spark.createDataFrame([("s", 10, 2), ("s", 10, 2)], "size_class string, max_chars int, overlap_chars int")
    got = [(r["text_id"], r["piece_no"], r["n_pieces"]) for r in split.split_texts(rows, "text_id", "body_text", limits).collect()]
    assert sorted(got) == [(1, 1, 2), (1, 2, 2), (2, 1, 1), (4, 1, 1), (5, 1, 1)]


def test_long_text_is_split_in_time():
    text = ("word " * 7 + "end. ") * 20_000
    assert "".join(text[o:e] for _, o, e, _ in split.split(text, 4000, 300)) == text


# ---- sampling


def _quotas(spark, rows, targets, size):
    r = spark.createDataFrame(rows, "doi string, stage string, subfield string")
    t = spark.createDataFrame(targets, "stage string, subfield string, target_share double, min_rows int")
    planned = sample.plan(r, "doi", ["stage", "subfield"], t, size=size)
    drawn = sample.draw(r, "doi", ["stage", "subfield"], planned, 1)
    return sample.reached(planned, drawn, ["stage", "subfield"]), drawn


def test_sample_follows_targets(spark):
    rows = [(f"d{i}", [" A ", "b"][i % 2], ["X", "y "][i // 2 % 2]) for i in range(4000)] + [("d1", "B", "X")] * 5 + [("n", None, "X"), ("e", "A", " ")]
    report, drawn = _quotas(spark, rows, [("a", "x", 0.4, 1), ("a", "y", 0.1, 1), ("b", "x", 0.3, 1), ("b", "y", 0.2, 1)], 100)
    got = Counter((r["stage"], r["subfield"]) for r in drawn.collect())
    assert got == {("a", "x"): 40, ("a", "y"): 10, ("b", "x"): 30, ("b", "y"): 20}
    assert report.where("short or gap > 0").count() == 0 and drawn.select("doi").distinct().count() == 100


def test_sample_repairs_minimums_and_reports_gaps(spark):
    rows = [(f"d{i}", "a", "x") for i in range(100)] + [(f"e{i}", "b", "x") for i in range(2)]
    report, drawn = _quotas(spark, rows, [("a", "x", 0.9, 1), ("b", "x", 0.0, 5), ("c", "x", 0.1, 0)], 20)
    by = {r["stage"]: r for r in report.collect()}
    got = Counter(r["stage"] for r in drawn.collect())
    assert got["b"] == 2 and by["b"]["short"] and by["b"]["gap"] == 3 and by["c"]["short"] and by["c"]["gap"] == 2 and not by["a"]["short"]
    assert sum(got.values()) == 20


def test_sample_of_nothing(spark):
    report, drawn = _quotas(spark, [], [("a", "x", 1.0, 1)], None)
    assert drawn.count() == 0 and report.first()["short"]


def test_take_lowest_is_exact(spark):
    rng = random.Random(5)
    rows = [(g, i, rng.expovariate(1), rng.randint(1, 9)) for i, g in enumerate(["a"] * 500 + ["b"] * 40 + ["c"] * 5)]
    quota = {"a": 300.0, "b": 77.0, "c": 1e9}
    df = spark.createDataFrame(rows, "g string, i long, k double, s int").repartition(3)
    got = {r["i"] for r in lowest.take_lowest(df, ["g"], "k", "s", spark.createDataFrame(list(quota.items()), "g string, quota double")).collect()}
    want = set()
    for g in quota:
        total = 0
        for r in sorted((r for r in rows if r[0] == g), key=lambda r: r[2]):
            total += r[3]
            if total - r[3] / 2 <= quota[g]:
                want.add(r[1])
    assert got == want


@settings(max_examples=50, deadline=None)
@given(st.dictionaries(st.tuples(st.sampled_from("ab"), st.sampled_from("xyz")), st.tuples(st.integers(0, 50), st.floats(0, 1), st.integers(0, 4)), min_size=1), st.integers(0, 80))
def test_quotas_stay_within_what_there_is(cells, size):
    sizes = {c: n for c, (n, _, _) in cells.items()}
    fitted = sample.rake(sizes, {c: w * size for c, (_, w, _) in cells.items()}, 2)
    quota = sample.whole_quotas(sizes, fitted, {c: m for c, (_, _, m) in cells.items()}, size)
    assert all(min(cells[c][2], sizes[c]) <= q <= sizes[c] for c, q in quota.items())


# ---- tokens

ODD = ["", None, " ", "a" * 3000, "ab" * 1500, "漢字" * 400, "   x\x1c\x85y  \n\n z", "it's we'll I'M ’s", "<|endoftext|>", "é" * 1200, "🙂👨‍👩‍👧" * 30, "٣٤ ½²", "\r\n\t\x0b", "nbsp x 　 ", "x" * 2100 + " y"]


@pytest.fixture(scope="module")
def ranks():
    if not TOKENIZERS:
        pytest.skip("no vocabularies")
    return tokens.load_ranks()


@pytest.mark.parametrize("frequent", [1, 10_000])
def test_ids_are_those_of_the_library(spark, ranks, monkeypatch, frequent):
    tiktoken = pytest.importorskip("tiktoken")
    monkeypatch.setattr(tokens, "FREQUENT", frequent)
    known = tiktoken.Encoding("t", pat_str=r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", mergeable_ranks=ranks, special_tokens={})
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)] + [(7, "it's a repeat"), (None, "no id")], "doc_id long, text string").withColumn("word", F.lit(1)).withColumn("ids", F.lit(1))
    got = tokens.encode(rows, "doc_id", "text", ranks, null_ids=(50256,)).persist()
    want = Counter((i, tuple([50256] if t is None else known.encode_ordinary(t))) for i, t in [*enumerate(ODD), (7, "it's a repeat"), (None, "no id")])
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got.collect()) == want
    back = {r[0]: r[1] for r in got.where("doc_id <> 7").select("doc_id", tokens.decode(F.col("ids"), ranks)).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(ODD) if i != 7)


def test_a_long_frequent_word_is_no_key_of_the_join(spark, ranks, monkeypatch):
    rule = "=" * 300
    rows = spark.createDataFrame([(i, f"{rule} w{i}") for i in range(50)], "doc_id long, text string")
    seen = []
    plain = tokens.frequent_words
    monkeypatch.setattr(tokens, "frequent_words", lambda w: seen.append(plain(w)) or seen[-1])
    monkeypatch.setattr(tokens, "FREQUENT", 3)
    assert tokens.encode(rows, "doc_id", "text", ranks).count() == 50 and rule in seen[0]
    monkeypatch.setattr(tokens, "LITERAL_BYTES", 100)
    assert tokens.encode(rows, "doc_id", "text", ranks, keep=("text",)).columns == ["doc_id", "text", "ids"] and rule not in seen[1]


def test_heap_and_fold_agree(spark, ranks):
    words = ["tokenization", " antidisestablishmentarianism", "ЖЖЖЖ", "aaaaaaa", "a"]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    folded = {r[0]: r[1] for r in df.select("word", tokens.fold_merges(F.col("word"), tokens.rank_map(ranks))).collect()}
    assert all(folded[w] == tokens.heap_merges(w.encode(), ranks) for w in words)


def test_no_texts(spark, ranks):
    assert tokens.encode(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text", ranks).count() == 0


# ---- mixing


def test_mixture_reaches_targets(spark):
    rng = random.Random(1)
    rows = [(i, ["a", "b", "c", "other"][i % 4], rng.randint(1, 200)) for i in range(4000)] + [(9000, "d", 50), (9001, "d", 0)]
    sizes = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    total = sum(r[2] for r in rows)
    targets = spark.createDataFrame([("a", 0.1, 1), ("b", 0.5, 3), ("c", 0.3, 1), ("d", 0.1, 4), ("none", 0.0, 2)], "source string, target_share double, max_repeats int")
    report = mix.plan(sizes, targets)
    mixed = mix.mix(sizes, "doc_id", report, seed=3).persist()
    out = {r["source"]: r for r in mix.reached(mixed, report).collect()}
    assert {s for s, r in out.items() if r["short"]} == {"c", "d"} and out["d"]["documents"] == 2
    for s, want in (("a", 0.1), ("b", 0.5)):
        assert abs(out[s]["taken"] - want * total) <= 200
    assert out["c"]["taken"] == sum(r[2] for r in rows if r[1] == "c") and out["d"]["taken"] == 200 and out["d"]["most_repeats"] == 4
    assert mixed.groupBy("source").agg(F.max("repeats").alias("m")).where("source = 'b'").first()["m"] <= 3
    assert abs(sum(r["share"] for r in out.values()) - 1) < 1e-9


def test_chances_are_proportional_to_size(spark):
    rng = random.Random(2)
    rows = [(i, "a", rng.randint(1, 100)) for i in range(6000)] + [(-1, "a", 10_000), (-2, "a", 0)]
    sizes = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    report = mix.plan(sizes, spark.createDataFrame([("a", 0.3, 1)], "source string, target_share double, max_repeats int"))
    factor, rest = mix.inclusion(sizes, report, "n_tokens").first()["factor"], report.first()["rest"]
    assert sum(min(1.0, factor * n) * n for _, _, n in rows) == pytest.approx(rest, rel=1e-6) and factor * 10_000 > 1
    drawn = {r["doc_id"] for r in mix.mix(sizes, "doc_id", report, seed=1).collect()}
    share = lambda lo, hi: sum(i in drawn for i, _, n in rows if lo <= n <= hi) / sum(lo <= n <= hi for *_, n in rows)
    assert -1 in drawn and -2 not in drawn
    for lo, hi in ((1, 20), (41, 60), (81, 100)):
        assert share(lo, hi) == pytest.approx(factor * (lo + hi) / 2, abs=0.05)


def test_empty_mixture(spark):
    sizes = spark.createDataFrame([], "doc_id long, source string, n_tokens long")
    report = mix.plan(sizes, spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int"))
    assert mix.reached(mix.mix(sizes, "doc_id", report), report).first()["taken"] == 0


# ---- personal information


def _corpus(n, seed):
    """(text, items) of made-up texts: names stand behind cues in some sentences and without any in others."""
    rng = random.Random(seed)
    part = lambda: rng.choice(["bran", "dol", "fer", "gim", "hul", "kes", "lom", "nar", "pol", "rus"]) + rng.choice(["ave", "ing", "ott", "ume", "iven"]) + rng.choice(["ley", "ford", "man", "ski", "dahl"])
    given_ = lambda: rng.choice("Anna Ben Carla Dev Eva Finn Gita Hugo Ines Jon".split())
    name = lambda: ("name", f"{given_()} {part().title()}")
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    phone = lambda: ("phone", rng.choice([f"+44 20 7946 0{digits(3)}", f"312-555-0{digits(3)}", f"07700 900{digits(3)}"]))
    mail = lambda: ("email", rng.choice(["{0}@mail.example", "{0} at mail dot example", "{0}(at)mail(dot)example(dot)org"]).format(part()))
    plain = ["The task took nine minutes.", "Scores rose with age.", "We report means by group.", "Study codes ran from P12-3 to P45-6.", "Each block held 12 trials.", "Ethical clearance was granted under protocol IRB 2016-0501."]
    made = [
        lambda: ["Consent signed by ", name(), ", SSN ", ("id_number", f"9{digits(2)}-{digits(2)}-{digits(4)}"), "."], lambda: ["Please call ", phone(), " and ask for ", name(), " before the visit."],
        lambda: ["Questions may be sent to ", name(), " (", mail(), ")."], lambda: ["The kit was posted to ", ("address", f"{rng.randint(10, 99)} {part().title()} Road, {part().title()}"), "."],
        lambda: [f"{part().title()} et al. (2011) found the reverse."], lambda: [f"The {part().title()} Sleep Diary was given twice."], lambda: ["Students from ", part().title(), " came late."],
        lambda: ["Patient number ", ("id_number", f"{digits(3)} {digits(3)} {digits(4)}"), " was left on the sheet of ", name(), "."], lambda: ["Both ", name(), " and ", name(), " missed the second session."],
    ]
    out = []
    for _ in range(n):
        text, found = "", []
        for _ in range(rng.randint(2, 6)):
            text += " " if text else ""
            for x in rng.choice(made)() if rng.random() < 0.5 else [rng.choice(plain)]:
                if isinstance(x, tuple):
                    found.append((len(text), len(text) + len(x[1]), x[0]))
                text += x if isinstance(x, str) else x[1]
        out.append((text, found))
    return out


@pytest.fixture(scope="module")
def field():
    return pii.train([t for t, _ in _corpus(900, 1)])


def _score(texts, model):
    score = defaultdict(Counter)
    for (text, items), found in zip(texts, pii.find(model, [t for t, _ in texts])):
        for kind in pii_rules.KINDS:
            w, g = {x for x in items if x[2] == kind}, {x for x in found if x[2] == kind}
            score[kind].update(hit=len(w & g), wrong=len(g - w), missed=len(w - g))
    return score


def test_held_out_accuracy(field):
    for kind, c in _score(_corpus(300, 2), field).items():
        assert c["hit"] >= 0.95 * (c["hit"] + c["missed"]) and c["hit"] >= 0.95 * (c["hit"] + c["wrong"]), (kind, c)


def test_no_cue_holds_words_of_the_test_tables():
    """What stands beside a name in the made-up texts above and in no cue is learned from the texts."""
    text = "Both Anna Branaveley and Ben Dolinford missed the second session."
    assert pii_rules.name_cue(text, 5, 20, 2) is None


#: Written and labelled by hand for this test: [n name], [e e-mail], [p phone], [i id number], [a address].
NEW_SENTENCES = r"""
Please thank [n Lena Fischer] for sending the transcripts so quickly.
[n Samuel Okafor] reviewed the codebook and flagged two items.
Our coordinator [n Priya Raman] will be away until Monday.
The samples were logged by [n Tomasz Kowalczyk] on the second day.
Dear Dr [n Whitfield], I attach the revised consent form.
Best wishes,\n[n Hannah Lindqvist]\n[p +46 8 123 456 78]
You can reach [n Marco Bellini] at [e marco.bellini@unimail.example] or on [p 020 7946 0321].
Contact: [n Aisha Bangura], phone [p (312) 555-0182].
I spoke with [n Kim Seo-yeon] and [n Li Wei] about the translation.
Participant 14 said that her daughter [n Ann Kim] had filled in the diary.
Her passport number is [i 533380006]; please remove it from the file.
Passport no. [i C01X00T47] was shown at the door.
Social security number [i 078-05-1120] appears on page two.
Patient number [i 943 476 5919] should not be in this table.
National Insurance [i QQ 12 34 56 C] was typed into the comments field.
Send the forms to [a 1600 Pennsylvania Boulevard NW, Washington].
She moved to [a 14 Elm Grove, Oxford OX4 1AB] last spring.
The parcel went to [a 221B Baker Street, London] by mistake.
Write to [e j.doe+lab@example.org] if the link is broken.
My address is [e jane dot doe at example dot org].
Frau [n Ingrid Bauer] erreichen Sie unter [p 030 23125 555].
Die Unterlagen gingen an [a Lindenstraße 12, 10969 Berlin].
La señora [n Carmen Ortega] vive en [a Calle Mayor, 7, 28013 Madrid].
Monsieur [n Luc Moreau] habite [a 12, rue Victor, 75004 Paris].
联系人：[n 王小明]，电话 [p +86 10 5555 0199]。
Smith and Jones (2015) reported the same pattern.
According to Baddeley et al. (2003), the span is shorter.
We used the Beck Depression Inventory and the Stroop Test.
Participants came from Leeds, Sheffield and York.
The University of Manchester approved protocol 2019-1187.
The device serial no. 4478123 was replaced in week 3.
Mean age was 34.2 years (SD = 7.1), range 18 to 65.
Trial NCT01234567 was registered before recruitment.
Each session lasted 45 minutes; 1200 trials were run in total.
""".strip().split("\n")


def _marked(line):
    text, items = "", []
    kinds = dict(zip("nepia", ("name", "email", "phone", "id_number", "address")))
    for plain, kind, inner in re.findall(r"([^\[]*)(?:\[([nepia]) ([^\]]*)\])?", line.replace("\\n", "\n")):
        text += plain
        if kind:
            items.append((len(text), len(text) + len(inner), kinds[kind]))
            text += inner
    return text, items


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data")
def test_new_sentences(spark):
    """The field fitted to the test tables, on sentences that are none of theirs."""
    model = pii.train(pii.sample(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "text"))
    score = _score([_marked(x) for x in NEW_SENTENCES], model)
    print({k: dict(c) for k, c in score.items()})
    total = sum(score.values(), Counter())
    assert total["hit"] >= 0.8 * (total["hit"] + total["missed"]) and total["hit"] >= 0.8 * (total["hit"] + total["wrong"]), score


def test_skip_edges_link_repeats_short_names_and_misspellings():
    coder = pii.Coder.learn(["We met in the lab and then we went home and he rang us"] * 9, Counter())
    pairs = lambda text: {(c.tokens[i], c.tokens[j]) for c in [coder.encode([text])] for i, j in pii.skip_edges(c)}
    assert pairs("Kim Brandover and Li met. Then Kim went. Li rang Brandovr and Brandover's home.") == {("Kim", "Kim"), ("Li", "Li"), ("Brandover", "Brandovr"), ("Brandovr", "Brandover")}
    assert ("王", "王") in pairs("王小明 met us. 王小明 went home. 王大山 rang.") and ("小", "小") in pairs("王小明 and 王小明")
    assert pairs("Bran Dolling met Gimmer Tallow") == set() == pairs("")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab", min_size=4, max_size=7), max_size=8))
def test_similar_words_are_one_letter_apart(words):
    number = pii.similar(words)
    for i, a in enumerate(words):
        for j, b in enumerate(words[:i]):
            if a == b or number[i] == j and min(len(a), len(b)) >= 5 and number[j] == j:
                assert number[i] == number[j]
                assert a == b or _osa(a, b) <= 2


def test_a_saved_field_finds_the_same(field, tmp_path):
    pii.save_field(field, f"{tmp_path}/field")
    back = pii.load_field(f"file://{tmp_path}/field")
    texts = [t for t, _ in _corpus(60, 4)] + ["", "\n", "王小明" * 3]
    assert pii.find(back, texts) == pii.find(field, texts) and os.path.getsize(f"{tmp_path}/field") < 5e6


def test_beliefs_and_labels_are_exact():
    rng, t, k = pii.np.random.default_rng(0), 4, pii.N_LABELS
    scores, moves = rng.normal(size=(1, t, k)), rng.normal(size=(k, k)) + pii.allowed_moves()
    weight, marginal, best = 0.0, pii.np.zeros((t, k)), (-math.inf, None)
    import itertools

    for y in itertools.product(range(k), repeat=t):
        s = moves[0, y[0]] + moves[y[-1], 0] * 0 + sum(scores[0, i, a] for i, a in enumerate(y)) + sum(moves[a, b] for a, b in zip(y, y[1:]))
        if s > best[0]:
            best = (s, y)
        e = math.exp(s + moves[y[-1], 0])
        weight += e
        for i, a in enumerate(y):
            marginal[i, a] += e
    post, _, log = pii.beliefs(scores, moves)
    assert pii.np.allclose(post[0], marginal / weight, atol=1e-9)
    assert tuple(pii.best_labels(scores, moves)[0]) == best[1]


def test_texts_are_redacted(spark, field):
    rows = [(1, "Please call 312-555-0147 and ask for Anna Branaveley before the visit."), (2, None), (3, ""), (4, "   "), (5, "Scores rose with age. " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kind", F.lit("x"))
    got = {r["doc_id"]: r["text"] for r in pii.redact(df, "doc_id", "text", field).collect()}
    assert got[1] == "Please call [PHONE] and ask for [NAME] before the visit." and got[2] is None and got[3] == "" and got[5] == rows[4][1]
    found = [tuple(r) for r in pii.items(df, "doc_id", "text", field).collect()]
    assert sorted(found) == [(1, "name", 37, 52), (1, "phone", 12, 24)]


def test_no_sample_no_items(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pii.items(df, "doc_id", "text").count() == 0 and pii.redact(df, "doc_id", "text").count() == 0
