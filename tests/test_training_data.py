"""The general training-data operators on small fixtures, against plain Python."""

import json
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions.paths import canonical_path
from lectern.operators import consolidate, incremental, packed, shred
from lectern.plans import core_queries

# ---- nested records


def _record(**meta):
    return json.dumps({"article": {"front": {"article-meta": meta}}})


RECORDS = [
    (1, _record(**{"article-categories": {"subj-group": [{"subject": " Psychology ", "subj-group": {"subject": {"#text": "Perception", "@x": "1"}, "subj-group": []}}, {"subject": None, "subj-group": [{"subject": "Psychology"}]}]}})),
    (2, _record(**{"aff": [{"@id": "a", "institution": None, "#text": " Own "}, {"@id": "b", "institution": {"#text": "Inst", "@t": "u"}}], "contrib-group": [{"contrib": {"@contrib-type": "editor", "name": {"surname": "E"}, "xref": {"@ref-type": "aff", "@rid": "a"}}}, {"contrib": [{"@contrib-type": "author", "name": {"surname": "A"}, "xref": [{"@ref-type": "fn", "@rid": "n"}, {"@ref-type": "aff", "@rid": "zz"}]}, {"@contrib-type": "author", "@corresp": "yes", "name": {"surname": "B"}, "xref": [{"@ref-type": "aff", "@rid": "b"}]}]}]})),
    (3, '{"article": {"front"'),
    (4, None),
    (5, "[]"),
    (6, "NaN"),
    (7, ""),
    (8, "{}"),
]


@pytest.fixture
def nodes(spark, tmp_path):
    spark.createDataFrame(RECORDS, "rec_id long, record string").write.parquet(f"{tmp_path}/article_raw.parquet")
    return {tuple(r) for r in core_queries.p1_found(spark, str(tmp_path)).collect()}


def test_nodes_of_nested_groups(nodes):
    assert {n[1:] for n in nodes if n[0] == 1} == {
        ("subject", "1", "", "Psychology"), ("subject", "1.1", "1", "Perception"), ("subject", "2", "", ""), ("subject", "2.1", "2", "Psychology"),
        ("subfield", "1.1", "1", "Perception"), ("subfield", "2.1", "2.1", "Psychology"),
    }


def test_links_and_lead(nodes):
    assert {n[1:] for n in nodes if n[0] == 2} == {
        ("aff", "1", "", "Own"), ("aff", "2", "", "Inst"), ("contrib", "1", "", "E"), ("contrib", "2", "", "A"), ("contrib", "3", "", "B"),
        ("link", "1", "1", "a"), ("link", "3", "2", "b"), ("lead", "2", "3", "Inst"),
    }
    assert {n[0] for n in nodes} == {1, 2}


def test_empty_table_of_records(spark, tmp_path):
    spark.createDataFrame([], "rec_id long, record string, nodes string").write.parquet(f"{tmp_path}/article_raw.parquet")
    assert core_queries.p1_found(spark, str(tmp_path)).count() == 0


def test_repeated_single_elements_are_kept(spark, tmp_path):
    groups = {"subj-group": {"subject": ["A", "B", {"#text": " C "}]}}
    people = {"contrib": {"@contrib-type": "author", "name": [{"surname": "First", "given-names": ["X", "Y"]}, {"surname": "Second"}]}}
    record = _record(**{"article-categories": groups, "contrib-group": people, "aff": {"@id": "a", "institution": ["I", "J"]}})
    raw = spark.createDataFrame([(1, record), (2, "[]")], "rec_id long, record string")
    raw.write.parquet(f"{tmp_path}/article_raw.parquet")
    got = {tuple(r)[1:] for r in core_queries.p1_found(spark, str(tmp_path)).collect()}
    assert got == {("subject", "1", "", "A"), ("aff", "1", "", "I"), ("contrib", "1", "", "First")}
    done = core_queries.shredded_records(spark, str(tmp_path))
    rows = lambda name: [(r["n"]["path"], r["n"]["parent_path"], r["n"]["cols"]) for r in shred.relation_rows(done, "rec_id", name).collect()]
    assert rows("subject") == [("1", "1", {"#text": "A"}), ("2", "1", {"#text": "B"}), ("3", "1", {"#text": " C "})]
    assert [c["surname"] for *_, c in rows("name")] == ["First", "Second"] and [c["#text"] for *_, c in rows("institution")] == ["I", "J"]
    assert [(p, c["#text"]) for _, p, c in rows("given-names")] == [("1", "X"), ("1", "Y")]


def test_any_depth_of_nesting():
    deep = 10_000
    text = '{"g": {"s": "x", "n": [' * deep + "1.50" + "]}}" * deep
    with pytest.raises(RecursionError):
        json.loads(text)
    value, ok = shred.read_json(text)
    nodes = shred.shred_value(value, {"g"})
    assert ok and len(nodes) == deep + 1 and nodes[-1].path.count(".") == deep - 1
    assert nodes[-1].parent_path == nodes[-2].path and nodes[-1].cols == {"s": "x", "n": "1.50"}
    assert not shred.read_json(text[:-1])[1] and not shred.read_json(text + "}")[1]
    assert shred.read_json("[" * 50_000 + "]" * 50_000)[1]


@settings(max_examples=300, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=3), x, max_size=4), max_leaves=20), st.sampled_from([None, 1]))
def test_both_readers_agree(value, indent):
    text = json.dumps(value, indent=indent)
    assert shred.read_deep(text) == shred.read_json(text)[0]


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from('{}[]",:0-1.e tru'), max_size=12))
def test_both_readers_refuse_the_same(text):
    try:
        deep = (shred.read_deep(text), True)
    except ValueError:
        deep = (None, False)
    assert deep == shred.read_json(text)


def test_odd_texts_in_records(spark):
    rows = [(1, '{"a": ["\\ud800x", [["y"], 7]]}'), (2, '{"a": ' + "9" * 6000 + "}"), (3, '"text"'), (4, "[1, [2]]")]
    got = shred.shred(spark.createDataFrame(rows, "k long, nodes string"), "k", "nodes", {"a"})
    assert {r["k"]: [n["cols"].get("#text") for n in r["nodes"] if n["cols"]] for r in got.collect()} == {1: ["?x", "y", "7"], 2: ["9" * 6000], 3: ["text"], 4: ["1", "2"]}


def test_relations_are_repeated_shared_or_recursive():
    g = shred.Graph({("", "a"): 1, ("a", "b"): 2, ("a", "c"): 1, ("b", "c"): 1, ("a", "d"): 1, ("d", "d"): 1, ("a", "e"): 1})
    assert g.relations() == {"b", "c", "d"}


# ---- small files


@pytest.mark.parametrize(
    ("path", "name"),
    [
        ("/a/b.xml", "/a/b.xml"), ("/a//./b.xml", "/a/b.xml"), ("/a/c/../b.xml", "/a/b.xml"), ("file:/a/b.xml", "/a/b.xml"), ("file:///a/b.xml", "/a/b.xml"),
        ("FILE://localhost/a/%62.xml", "/a/b.xml"), ("/a/%62.xml", "/a/%62.xml"), ("/A/b.xml", "/A/b.xml"), ("file:/a/+%zz", "/a/+%zz"), ("/../a", "/a"), ("", ""), (None, None),
    ],
)
def test_canonical_path(spark, path, name):
    assert spark.createDataFrame([(path,)], "p string").select(canonical_path(F.col("p"))).first()[0] == name


FILES = [(5, "/a/x", "one"), (2, "/a//x", "one"), (7, "/a/x", "two"), (8, "/a/x", ""), (9, "/a/x", None), (10, None, "one"), (11, None, "one"), (12, "/a/X", "one")]


def test_store_holds_each_record_once(spark, tmp_path):
    files = spark.createDataFrame(FILES, "file_id long, xml_path string, xml_text string").withColumn("length", F.lit(3))
    manifest = consolidate.consolidate(files, str(tmp_path), target_bytes=1 << 20)
    assert sorted(r["file_id"] for r in manifest.collect()) == [2, 7, 10, 12]
    import zstandard

    stored = b"".join(zstandard.ZstdDecompressor().stream_reader(open(f, "rb"), read_across_frames=True).read() for f in sorted((tmp_path / "data").glob("*.zst")))
    assert Counter(stored.decode()) == Counter("oneoneonetwo")


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_repeated_ids_and_either_way(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(consolidate, "MAX_COPIES", most)
    rows = FILES + [(2, "/a//x", "one"), (7, "/b", "one"), (12, "/a/x", "one"), (10, None, "one"), (20, "/c", "l\x00\u2028")]
    files = spark.createDataFrame(rows, "file_id long, xml_path string, xml_text string").repartition(3)
    manifest = consolidate.consolidate(files, str(tmp_path), target_bytes=1 << 20)
    assert sorted(r["file_id"] for r in manifest.collect()) == [2, 7, 7, 10, 12, 20]
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")) == ["data"]


def test_what_failed_attempts_wrote_is_not_in_the_store(spark, tmp_path):
    (tmp_path / ".stage").mkdir()
    (tmp_path / ".stage" / "part-00000-7-lost-0001.zst").write_bytes(b"left over")
    files = spark.createDataFrame(FILES, "file_id long, xml_path string, xml_text string")
    manifest = consolidate.consolidate(files, str(tmp_path)).persist()
    named = {r["store_file"] for r in manifest.collect()}
    assert {p.name for p in (tmp_path / "data").iterdir()} == named and not (tmp_path / ".stage").exists()
    consolidate.commit(manifest, str(tmp_path))  # a repeated commit changes nothing
    assert {p.name for p in (tmp_path / "data").iterdir()} == named


def test_store_is_validated(spark, tmp_path):
    files = spark.createDataFrame(FILES, "file_id long, xml_path string, xml_text string")
    manifest = consolidate.consolidate(files, str(tmp_path), target_bytes=1).persist()
    assert len({r["store_file"] for r in manifest.collect()}) == 4
    broken = next((tmp_path / "data").glob("*.zst"))
    broken.write_bytes(broken.read_bytes()[:-1])
    with pytest.raises(Exception, match="isn't what was stored|frame|not|decompress"):
        consolidate.validated(manifest, f"{tmp_path}/data").collect()


def test_empty_store(spark, tmp_path):
    files = spark.createDataFrame([], "file_id long, xml_path string, xml_text string")
    assert consolidate.consolidate(files, str(tmp_path)).count() == 0


def test_lines_are_joined_at_line_ends(spark, tmp_path):
    parts = [("a", b"h\n1\n2"), ("b", b"\xef\xbb\xbfh\n3\n"), ("c", b""), ("d", b"h\n")]
    done = consolidate.join_small_files(spark.createDataFrame(parts, "path string, content binary"), str(tmp_path), "lines", header=b"h\n")
    assert {r["path"] for r in done.collect()} == {"a", "b"}
    texts = [p.read_bytes() for p in (tmp_path / "data").glob("*.txt")]
    assert all(t.startswith(b"h\n") and t.count(b"h") == 1 for t in texts)
    assert sorted(b"".join(t[2:] for t in texts).split()) == [b"1", b"2", b"3"]


def test_zstd_files_are_joined_by_frame(spark, tmp_path):
    import zstandard

    z = zstandard.ZstdCompressor()
    parts = [("a", z.compress(b"x")), ("b", z.compress(b"y") + z.compress(b"z"))]
    done = consolidate.join_small_files(spark.createDataFrame(parts, "path string, content binary"), str(tmp_path), "zstd")
    assert sum(r["length"] for r in done.collect()) == sum(len(c) for _, c in parts)
    with pytest.raises(Exception, match="ends within a frame"):
        consolidate.join_small_files(spark.createDataFrame([("a", parts[0][1][:-1])], "path string, content binary"), str(tmp_path), "zstd").collect()


# ---- packed cells

TERMS = {t: packed.LISTED for t in ["A b", "C, d and e", "F; g", "H/i", "P", 'The "q" r', "L s"]}


@pytest.mark.parametrize(
    ("cell", "values"),
    [
        ("A b;P", ["A b", "P"]), (" A b ; ;P; ", ["A b", "P"]), ("C, d and e, A b", ["C, d and e", "A b"]), ("C, d and e;F; g;P", ["C, d and e", "F; g", "P"]),
        ('["A b", "F; g"]', ["A b", "F; g"]), ("[]", []), (";", []), ("", []), ("   ", []), ('"A b";\'F; g\'', ["A b", "F; g"]), ("A b / H/i / P", ["A b", "H/i", "P"]),
        ("/L s/P/C, d and e, /L s/P", ["/L s/P/C, d and e", "/L s/P"]), ("A b\tP\nF; g", ["A b", "P", "F; g"]), ("F\\; g;P", ["F; g", "P"]), ("A b||P|A b", ["A b", "P", "A b"]),
        ('The "q" r;P', ['The "q" r', "P"]), ('"The ""q"" r";P', ['The "q" r', "P"]), ("New one；P", ["New one", "P"]), ("A b • P", ["A b", "P"]), ('"A b;P', ['"A b', "P"]),
        ("/F; g/P;/F\\; g/P", ["/F; g/P", "/F; g/P"]), (" / P", ["P"]), ("P;P", ["P", "P"]),
    ],
)
def test_values_of_a_cell(cell, values):
    assert list(packed.Segmenter(TERMS).values(cell)) == values


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(sorted(TERMS)), max_size=8), st.sampled_from([";", "; ", " | ", "||", "\t", "\n", "；", " • "]), st.booleans())
def test_any_list_comes_back(values, separator, quoted):
    cell = separator.join('"' + v.replace('"', '""') + '"' if quoted or separator[0] in v else v for v in values)
    assert list(packed.Segmenter(TERMS).values(cell)) == values


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_no_cell_breaks(cell):
    assert all(v.strip() for v in packed.Segmenter(TERMS).values(cell))


@pytest.mark.parametrize("most", [200_000, 0])
def test_unpack_by_dictionary_and_by_join(spark, monkeypatch, most):
    monkeypatch.setattr(packed, "MAX_TERMS", most)
    rows = [(1, "A b;New", None), (2, "C, d and e, New", "x"), (3, None, ""), (4, "A b;New", " ")]
    table = spark.createDataFrame(rows, "row_id long, u string, v string").withColumn("cell", F.lit(0)).withColumn("term", F.lit(0))
    terms = spark.createDataFrame([(t,) for t in TERMS] + [(None,)], "term string")
    got = sorted(tuple(r) for r in packed.unpack(table, "row_id", ["u", "v"], terms).collect())
    assert got == [(1, "u", 1, "A b"), (1, "u", 2, "New"), (2, "u", 1, "C, d and e"), (2, "u", 2, "New"), (2, "v", 1, "x"), (4, "u", 1, "A b"), (4, "u", 2, "New")]


def test_frequent_parts_split_the_same_by_dictionary_and_by_join(spark, monkeypatch):
    cells = [f"Arts; k{i}" for i in range(30)] + [f"Crafts; m{i}" for i in range(30)] + [f"Filler; o{i}" for i in range(250)]
    cells += ["Arts; Crafts", "Arts; Crafts; Filler", "a/b/c/d/e;x", "x; a/b/c/d/e", "/Arts; Crafts/Filler", "/Filler/a/b/c/d/e; /Arts"]
    table = spark.createDataFrame(list(enumerate(cells)), "row_id long, u string")
    terms = spark.createDataFrame([("Arts; Crafts",), ("a/b/c/d/e",)], "term string")
    got = []
    for most in (200_000, 0):
        monkeypatch.setattr(packed, "MAX_TERMS", most)
        got.append(sorted(tuple(r) for r in packed.unpack(table, "row_id", ["u"], terms).collect()))
    assert got[0] == got[1]
    assert [r[3] for r in got[1] if r[0] == 310] == ["Arts; Crafts"]


@pytest.mark.parametrize("most", [200_000, 0])
def test_a_listed_term_is_never_split(spark, monkeypatch, most):
    monkeypatch.setattr(packed, "MAX_TERMS", most)
    cells = [f"Beta, k{i}" for i in range(300)] + [f"Gamma, m{i}" for i in range(300)] + ["Beta/Gamma", "q/r"] * 50
    odd = ["Beta, Gamma", "Gamma, Beta, Gamma, Beta", "/Gamma/Beta, Gamma", "/Gamma/Beta, Gamma/Beta, Gamma", "Beta , Gamma", "q/r, Beta, Gamma", "Beta, \"Gamma\""]
    table = spark.createDataFrame(list(enumerate(cells + odd)), "row_id long, u string")
    terms = spark.createDataFrame([("Beta",), ("Gamma",), ("Beta, Gamma",), ("q",), ("r",), ("q/r",)], "term string")
    got = {}
    for r in sorted(packed.unpack(table, "row_id", ["u"], terms).where("row_id >= 700").collect()):
        got.setdefault(r["row_id"] - 700, []).append(r["term"])
    assert [got[i] for i in range(7)] == [
        ["Beta, Gamma"], ["Gamma", "Beta, Gamma", "Beta"], ["/Gamma/Beta, Gamma"], ["/Gamma/Beta, Gamma/Beta, Gamma"], ["Beta", "Gamma"], ["q/r", "Beta, Gamma"], ["Beta", "Gamma"],
    ]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", " ", "/", " / ", ";", ",", "\t", "/a", ";/ ", "|", "\u3000"]), max_size=12).map("".join))
def test_pieces_are_cut_the_same_either_way(cell):
    assert packed.plain_pieces(cell) == packed.quoted_pieces(cell)


@settings(max_examples=500, deadline=None)
@given(
    st.dictionaries(st.text("ab;/ ", min_size=1, max_size=7).map(str.strip).filter(bool), st.sampled_from([2.0, 5.0, 90.0, 4000.0]), max_size=12),
    st.lists(st.sampled_from(["a", "b", "ab", ";", "; ", "/", " / ", "/a", "\\;", "\\/", '"a;b"', "\t", " "]), max_size=14).map("".join),
)
def test_looked_up_terms_are_all_that_a_cell_needs(counts, cell):
    total = sum(counts.values())
    size = packed.Extent(len(counts), total, 1 + max((sum(c in packed.SEPARATORS + "/" for c in t) for t in counts), default=0), 1 + max((t.count("/") for t in counts), default=0))
    own = {t: counts[t] for t in packed.lookups(cell, size) if t in counts}
    listed = {t for t in counts if counts[t] == 5.0}
    near, whole = packed.Segmenter(own, total, listed & own.keys()), packed.Segmenter(counts, total, listed)
    assert near.values(cell) == whole.values(cell) and near.expected(cell) == pytest.approx(whole.expected(cell))
    found = near.values(cell), near.expected(cell)
    near.values.cache_clear()
    near.chain = lambda _: None  # the lattice in full gives the same
    assert (near.values(cell), pytest.approx(near.expected(cell))) == found


@pytest.mark.parametrize(
    ("cell", "values"),
    [
        ("x;P, Q, R, S, T and U;P", ["x", "P, Q, R, S, T and U", "P"]), ("/A, B/C, D/E, F/P;P", ["/A, B/C, D/E, F/P", "P"]), ("/a/b/c/d, e/P;x", ["/a/b/c/d, e/P", "x"]),
        ("new/words/in/one/long/value;P", ["new/words/in/one/long/value", "P"]), ("/P;/P;/P;/P;/P;/P", ["/P"] * 6), ("/A, B/P/C, D", ["/A, B/P/C, D"]), ("/C, D/P/E, F; /P/A, B", ["/C, D/P/E, F", "/P/A, B"]),
    ],
)
def test_long_terms_and_paths_are_whole(cell, values):
    counts = {t: packed.LISTED for t in ["P, Q, R, S, T and U", "A, B", "C, D", "E, F", "a/b/c/d, e", "P"]}
    assert list(packed.Segmenter(counts).values(cell)) == values


def test_unpack_nothing(spark):
    table = spark.createDataFrame([], "row_id long, u string")
    assert packed.unpack(table, "row_id", ["u"], spark.createDataFrame([], "term string")).count() == 0


# ---- new and changed rows


@pytest.fixture
def root(tmp_path):
    return f"file://{tmp_path}/versions"


def _pending(spark, facts, runs, processed, root):
    f = spark.createDataFrame(facts, "row_id long, doi string, sample_id int, value string, loaded_at int")
    r = spark.createDataFrame(runs, "run_id int, attempt int, started_at int, status string")
    p = spark.createDataFrame(processed, "run_id int, attempt int, row_id long")
    return sorted((tuple(x) for x in incremental.pending(f, r, p, ["doi", "sample_id"], root).collect()), key=str)


def test_pending(spark, root):
    facts = [
        (1, "same", 1, "a", 1), (2, "same", 1, "a", 5), (3, "changed", 1, "a", 1), (4, "changed", 1, None, 2), (5, "new", 1, "a", 1), (6, "failed", 1, "a", 1),
        (7, "back", 1, "a", 1), (8, "back", 1, "b", 2), (9, "back", 1, "a", 3), (10, None, None, None, 1), (11, None, None, None, 2), (12, "nulls", 1, "null", 1), (13, "nulls", 1, None, 2),
    ]
    runs = [(1, 1, 1, "ok"), (2, 1, 2, "failed"), (2, 2, 3, "ok"), (3, 1, 4, None)]
    processed = [(1, 1, 1), (1, 1, 3), (2, 1, 6), (3, 1, 5), (1, 1, 7), (2, 2, 8), (1, 1, 10), (1, 1, 12)]
    assert _pending(spark, facts, runs, processed, root) == [("back", 1), ("changed", 1), ("failed", 1), ("new", 1), ("nulls", 1)]


def test_pending_of_empty_tables(spark, root):
    assert _pending(spark, [], [], [], root) == []
    assert _pending(spark, [(1, "a", 1, "x", 1)], [], [], root + "2") == [("a", 1)]


def _digests(spark, n, changed=()):
    value = F.concat(F.col("id").cast("string"), F.when(F.col("id").isin(list(changed)), "!").otherwise(""))
    return spark.range(n).select("id", incremental.key_place(["id"]).alias("place"), F.unhex(F.sha2(value, 256)).alias("digest"))


def test_a_second_run_reads_the_changed_leaves_only(spark, root, monkeypatch):
    monkeypatch.setattr(incremental, "ROWS_PER_LEAF", 4)
    monkeypatch.setattr(incremental, "LEAVES_PER_PART", 4)
    first = _digests(spark, 5000)
    bits = incremental.leaf_bits_for(5000)
    version = incremental.publish(first.limit(0), first, root, bits)
    read = []
    plain = incremental.saved_rows
    monkeypatch.setattr(incremental, "saved_rows", lambda *a: read.append(plain(*a)) or read[-1])
    done = incremental.changed_rows(_digests(spark, 5003, [17, 4321]), version)[0]
    assert sorted(r["id"] for r in done.collect()) == [17, 4321, 5000, 5001, 5002]
    assert 2 <= read[0].count() <= 5 * 40  # rows of five leaves, of 5,000
    plan = read[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.split("PartitionFilters: ")[1].startswith("[") and "part" in plan.split("PartitionFilters: ")[1].split("]")[0]
    same = incremental.changed_rows(_digests(spark, 5000), version)[0]
    assert same.count() == 0 and read[1].count() == 0


def test_changed_rows_at_any_height(spark, root, monkeypatch):
    for i, per_leaf in enumerate((1, 40, 10_000)):
        monkeypatch.setattr(incremental, "ROWS_PER_LEAF", per_leaf)
        version = incremental.publish(None, _digests(spark, 3000), f"{root}{i}", incremental.leaf_bits_for(3000))
        assert sorted(r["id"] for r in incremental.changed_rows(_digests(spark, 3000, range(0, 3000, 501)), version)[0].collect()) == list(range(0, 3000, 501))


def test_runs_skip_and_repeat_nothing(spark, root):
    facts = lambda rows: spark.createDataFrame(rows, "row_id long, doi string, place string, digest string, loaded_at int").withColumn("saved_digest", F.lit(1))
    keep = lambda x: x.select("doi")
    got = lambda v: sorted((r["doi"] for r in spark.read.parquet(f"{v}/output").collect()), key=str)
    one, two = [(1, "a", "x", None, 1), (2, "b", "x", "y", 1), (3, None, None, None, 1)], [(4, "a", "z", None, 2), (5, "c", "x", None, 1)]
    assert got(incremental.take_up(facts(one), root, ["doi"], keep)) == [None, "a", "b"]
    assert incremental.take_up(facts(one), root, ["doi"], keep) is None

    def dies(x):
        return x.select(F.raise_error(F.lit("died")).alias("doi"))

    with pytest.raises(Exception, match="died"):
        incremental.take_up(facts(one + two), root, ["doi"], dies)
    assert len(incremental.published(spark, root)) == 1
    assert got(incremental.take_up(facts(one + two), root, ["doi"], keep)) == ["a", "c"]
    assert incremental.take_up(facts(one + two), root, ["doi"], keep) is None


def test_a_deleted_version_does_not_block_the_next(spark, root):
    import shutil

    rows = _digests(spark, 3)
    for _ in range(2):
        incremental.publish(rows, rows, root, 4)
    shutil.rmtree(f"{root.removeprefix('file://')}/v00000000")
    incremental.publish(rows, rows, root, 4)
    assert [p[-9:] for p in incremental.published(spark, root)] == ["v00000001", "v00000002"]


def test_settled_tables_are_kept_until_cleaned(spark):
    from lectern.session import clean, settle

    rows = settle(spark.range(5))
    assert rows.count() == 5
    clean(spark)
    with pytest.raises(Exception):
        spark.read.parquet(rows.inputFiles()[0]).count()


def test_packed_subjects_are_those_of_the_articles(spark):
    """Cells without paths hold the same list as some metadata row of the article."""
    import os

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test data")
    lists = {}
    for r in spark.read.parquet(f"{d}/article_metadata.parquet").select("doi", "subject").collect():
        lists.setdefault(r["doi"], []).append(list(r["subject"] or []))
    dois = {r["row_id"]: r["doi"] for r in spark.read.parquet(f"{d}/demographics_table.parquet").select("row_id", "doi").collect()}
    cells = {}
    for r in sorted(core_queries.p5_found(spark, d).where("field_name = 'subject'").collect()):
        cells.setdefault(r["row_id"], []).append(r["term"])
    plain = {i: v for i, v in cells.items() if not any(t.startswith("/") for t in v)}
    assert plain and all(v in lists[dois[i]] for i, v in plain.items())
