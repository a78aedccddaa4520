"""Queries of the general training-data operators (problems 1, 2, 5 and 7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import canonical_path
from ..operators import consolidate, incremental, packed, shred
from ..session import scratch, table

#: Elements that the article format lets repeat, whatever the
#: records at hand do, and those of which a row above shows the first.
REPEATED = {"subj-group", "contrib-group", "contrib", "aff", "xref"}
FIRST = {"subject", "institution", "name", "surname", "given-names"}
PACKED = ["matched_subfields", "subject", "subject_level_1"]
GROUP = {"subj-group": ["subject", "@subj-group-type"]}
AFF = {"aff": ["@id", "institution", "#text", "addr-line"]}
CONTRIB = {"contrib": ["name/surname", "name/given-names", "@contrib-type", "@corresp"]}
XREF = {"xref": ["@ref-type", "@rid"]}


def shredded_records(spark: SparkSession, d: str, wanted: dict[str, list[str]] | None = None) -> DataFrame:
    raw = table(spark, d, "article_raw")
    relations = shred.schema_graph(raw, "record").relations(REPEATED)
    return shred.shred(raw, "rec_id", "record", relations, wanted, FIRST)


def _row(entity: str, node: Column, parent: Column, label: Column) -> Column:
    return F.struct(F.lit(entity).alias("entity"), node.alias("node_path"), parent.alias("parent_path"), label.alias("label"))


def group_label(x: Column) -> Column:
    return shred.text(x, "subject")


def aff_label(x: Column) -> Column:
    return F.when(shred.text(x, "institution") != "", shred.text(x, "institution")).otherwise(shred.text(x, "#text"))


def record_parts(spark: SparkSession, d: str) -> DataFrame:
    """Each record's rows by relation, its Psychology groups and its lead author:
    all of a record's rows are in one array, so no shuffle."""
    of = lambda name: F.filter("nodes", lambda x: x["relation"] == name)
    one = shredded_records(spark, d, GROUP | AFF | CONTRIB | XREF).select(
        "rec_id", of("subj-group").alias("g"), of("aff").alias("a"), of("contrib").alias("c"),
        F.filter("nodes", lambda x: (x["relation"] == "xref") & (x["parent_relation"] == "contrib") & (shred.text(x, "@ref-type") == "aff")).alias("x"),
    )
    one = one.withColumns(
        {
            "psych": F.transform(F.filter("g", lambda x: group_label(x) == "Psychology"), lambda x: x["path"]),
            "outer": F.transform("g", lambda x: shred.outer_path(x["path"])),
            "authors": F.filter("c", lambda x: shred.text(x, "@contrib-type") == "author"),
        }
    )
    one = one.withColumn(
        "lead",
        F.coalesce(
            F.try_element_at(F.filter("authors", lambda x: shred.text(x, "@corresp") == "yes"), F.lit(1)),
            F.try_element_at("authors", F.lit(1)),
        ),
    )
    lead_ref = F.try_element_at(F.filter("x", lambda x: x["parent_path"] == F.col("lead.path")), F.lit(1))
    return one.withColumn("lead_aff", shred.target_path(lead_ref, "aff"))


def _subfields() -> Column:
    inner = F.filter("g", lambda x: F.array_contains("psych", shred.outer_path(x["path"])))
    leaves = F.filter("g", lambda x: F.array_contains("psych", x["path"]) & ~F.array_contains("outer", x["path"]))
    return F.concat(
        F.transform(inner, lambda x: _row("subfield", x["path"], shred.outer_path(x["path"]), group_label(x))),
        F.transform(leaves, lambda x: _row("subfield", x["path"], x["path"], group_label(x))),
    )


def _leads() -> Column:
    return F.transform(F.filter("a", lambda x: x["path"] == F.col("lead_aff")), lambda x: _row("lead", x["path"], F.col("lead.path"), aff_label(x)))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of every record."""
    rows = F.concat(
        F.transform("g", lambda x: _row("subject", x["path"], shred.outer_path(x["path"]), group_label(x))),
        _subfields(),
        F.transform("a", lambda x: _row("aff", x["path"], F.lit(""), aff_label(x))),
        F.transform("c", lambda x: _row("contrib", x["path"], F.lit(""), shred.text(x, "name/surname"))),
        F.transform(F.filter("x", lambda x: shred.target_path(x, "aff").isNotNull()), lambda x: _row("link", x["parent_path"], shred.target_path(x, "aff"), shred.text(x, "@rid"))),
        _leads(),
    )
    return record_parts(spark, d).select("rec_id", F.inline(rows))


def _relation(spark: SparkSession, d: str, wanted: dict[str, list[str]], parent: Column, names: list[str]) -> DataFrame:
    """A flat table: rec_id, node_path, parent_path and the relation's columns."""
    ((relation, places),) = wanted.items()
    n = F.col("n")
    return shred.relation_rows(shredded_records(spark, d, wanted), "rec_id", relation).select(
        "rec_id", n["path"].alias("node_path"), parent.alias("parent_path"), *[shred.text(n, p).alias(name) for p, name in zip(places, names)], *([shred.target_path(n, "aff").alias("aff_path")] if relation == "xref" else [])
    )


def p1_subjects(spark: SparkSession, d: str) -> DataFrame:
    """Flat table of subject groups, pointing to the enclosing group."""
    return _relation(spark, d, GROUP, shred.outer_path(F.col("n.path")), ["subject", "group_type"])


def p1_subfields(spark: SparkSession, d: str) -> DataFrame:
    """Flat table of psychology subfields, pointing to their Psychology group."""
    return record_parts(spark, d).select("rec_id", F.inline(_subfields())).select("rec_id", "node_path", "parent_path", F.col("label").alias("subfield"))


def p1_leads(spark: SparkSession, d: str) -> DataFrame:
    """Flat table of lead institutions, pointing to the lead author."""
    return record_parts(spark, d).select("rec_id", F.inline(_leads())).select("rec_id", "node_path", "parent_path", F.col("label").alias("lead_institution"))


def p1_contributors(spark: SparkSession, d: str) -> DataFrame:
    """Flat table of contributors, pointing to their group."""
    return _relation(spark, d, CONTRIB, F.col("n.parent_path"), ["surname", "given_names", "contrib_type", "corresp"])


def p1_affiliations(spark: SparkSession, d: str) -> DataFrame:
    """Flat table of affiliations."""
    return _relation(spark, d, AFF, F.lit(""), ["aff_id", "institution", "own_text", "addr_line"])


def p1_references(spark: SparkSession, d: str) -> DataFrame:
    """Flat table of references, pointing to their contributor, with the affiliation that they lead to."""
    return _relation(spark, d, XREF, F.col("n.parent_path"), ["ref_type", "rid"])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return consolidate.consolidate(table(spark, d, "xml_files"), target_bytes=16 << 20).select("file_id")


def p2_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Lengths and checksums of the stored records, after reading them back."""
    return consolidate.consolidate(table(spark, d, "xml_files"), target_bytes=16 << 20).select("file_id", "raw_length", "checksum")


def p2_joined(spark: SparkSession, d: str) -> DataFrame:
    """The listed files joined as newline-delimited ones, read back by their manifest."""
    files = table(spark, d, "xml_files").select(F.col("file_id").cast("string").alias("path"), F.col("xml_text").cast("binary").alias("content"))
    done = consolidate.join_small_files(files, scratch(spark, "joined"), "lines", target_bytes=16 << 20)
    return done.select(F.col("path").cast("long").alias("file_id"), "raw_length", (F.col("length") - F.col("raw_length")).cast("int").alias("line_ends"))


def p2_names(spark: SparkSession, d: str) -> DataFrame:
    """The one way to write each stored path."""
    return table(spark, d, "xml_files").select("file_id", canonical_path(F.col("xml_path")).alias("name"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return packed.unpack(table(spark, d, "demographics_table"), "row_id", PACKED, table(spark, d, "subject_terms"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return incremental.pending(
        table(spark, d, "demographics_table"), table(spark, d, "run_log"), table(spark, d, "processed_rows"), ["doi", "sample_id"], scratch(spark, "taken")
    )


def p7_second_run(spark: SparkSession, d: str) -> DataFrame:
    """What a second run takes up after a first one took up all samples as they
    were in the middle of the loading times: new and changed samples, by the
    tree that the first run published."""
    rows, root = table(spark, d, "demographics_table"), scratch(spark, "runs")
    middle = rows.agg(F.expr("timestamp_micros(bigint((unix_micros(to_timestamp(min(loaded_at))) + unix_micros(to_timestamp(max(loaded_at)))) div 2))").alias("m")).first()["m"]
    keys = ["doi", "sample_id"]
    incremental.take_up(rows.where(F.col("loaded_at") <= F.lit(middle)), root, keys, lambda x: x)
    version = incremental.take_up(rows, root, keys, lambda x: x)
    return spark.read.schema("doi string, sample_id int").parquet(f"{version}/output")


NAME_SQL = r"""
SELECT file_id, xml_path, xml_text,
  (CASE WHEN starts_with(plain, '/') THEN '/' ELSE '' END) || array_to_string(list_reduce(
     list_concat([''], list_filter(string_split(plain, '/'), lambda x: x <> '' AND x <> '.')),
     lambda acc, x: CASE WHEN x = '..' THEN regexp_replace(acc, '/?[^/]*$', '') WHEN acc = '' THEN x ELSE acc || '/' || x END
  ), '') AS name
FROM (SELECT *, CASE WHEN regexp_matches(xml_path, '^(?i:file):')
    THEN url_decode(regexp_replace(regexp_replace(xml_path, '^(?i:file):', ''), '^//(localhost)?/', '/'))
    ELSE xml_path END AS plain FROM xml_files)
"""
NAME_SQL = NAME_SQL.replace("array_to_string(list_reduce(", "(list_reduce(").replace("), '') AS name", ")) AS name")


def _list(x: str) -> str:
    """The elements behind a JSON value: those of a list, or the one."""
    return f"list_filter(CASE json_type({x}) WHEN 'ARRAY' THEN json_extract({x}, '$[*]') WHEN 'OBJECT' THEN [{x}] ELSE [] END, lambda e: json_type(e) <> 'NULL' AND e::varchar NOT IN ('{{}}', '[]'))"


def _own(x: str) -> str:
    """The text of an element, without outer white space."""
    return f"regexp_replace(coalesce(CASE json_type({x}) WHEN 'OBJECT' THEN json_extract_string({x}, '$.\"#text\"') WHEN 'VARCHAR' THEN json_extract_string({x}, '$') END, ''), '^\\s+|\\s+$', '', 'g')"


_NODES = f"""
WITH RECURSIVE m AS (
  SELECT rec_id, json_extract(record, '$.article.front."article-meta"') AS m FROM article_raw WHERE json_valid(record)
), top AS (SELECT rec_id, {_list("json_extract(m, '$.\"article-categories\".\"subj-group\"')")} AS gs FROM m),
g AS (
  SELECT rec_id, i::varchar AS path, '' AS up, gs[i] AS g, NULL::varchar AS above FROM top, LATERAL (SELECT unnest(range(1, len(gs) + 1)) AS i)
  UNION ALL
  SELECT rec_id, path || '.' || i, path, k[i], label FROM (SELECT rec_id, path, {_own("json_extract(g, '$.subject')")} AS label, {_list("json_extract(g, '$.\"subj-group\"')")} AS k FROM g) s, LATERAL (SELECT unnest(range(1, len(k) + 1)) AS i)
), groups AS (SELECT rec_id, path, up, above, g, {_own("json_extract(g, '$.subject')")} AS label, len({_list("json_extract(g, '$.\"subj-group\"')")}) AS n FROM g),
affs AS (
  SELECT rec_id, i AS place, a[i] AS a, trim(json_extract_string(a[i], '$."@id"')) AS id, coalesce(nullif({_own("json_extract(a[i], '$.institution')")}, ''), {_own("a[i]")}) AS label
  FROM (SELECT rec_id, {_list("json_extract(m, '$.aff')")} AS a FROM m) s, LATERAL (SELECT unnest(range(1, len(a) + 1)) AS i)
), people AS (
  SELECT rec_id, i AS place, c[i] AS c FROM (
    SELECT rec_id, flatten(list_transform({_list("json_extract(m, '$.\"contrib-group\"')")}, lambda q: {_list("json_extract(q, '$.contrib')")})) AS c FROM m) s, LATERAL (SELECT unnest(range(1, len(c) + 1)) AS i)
), refs AS (
  SELECT rec_id, place, i AS n, trim(json_extract_string(x[i], '$."@rid"')) AS rid FROM (
    SELECT rec_id, place, list_filter({_list("json_extract(c, '$.xref')")}, lambda e: json_extract_string(e, '$."@ref-type"') = 'aff') AS x FROM people) s, LATERAL (SELECT unnest(range(1, len(x) + 1)) AS i)
), ids AS (SELECT rec_id, id, min(place) AS aff FROM affs GROUP BY rec_id, id),
authors AS (
  SELECT rec_id, place FROM people WHERE json_extract_string(c, '$."@contrib-type"') = 'author'
  QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY coalesce(json_extract_string(c, '$."@corresp"') = 'yes', false) DESC, place) = 1
)
"""
NODE_SQL = _NODES + f"""SELECT rec_id, 'subject' AS entity, path AS node_path, up AS parent_path, label FROM groups
UNION ALL SELECT rec_id, 'subfield', path, up, label FROM groups WHERE above = 'Psychology'
UNION ALL SELECT rec_id, 'subfield', path, path, label FROM groups WHERE label = 'Psychology' AND n = 0
UNION ALL SELECT rec_id, 'aff', place::varchar, '', label FROM affs
UNION ALL SELECT rec_id, 'contrib', place::varchar, '', {_own("json_extract(c, '$.name.surname')")} FROM people
UNION ALL SELECT rec_id, 'link', r.place::varchar, i.aff::varchar, r.rid FROM refs r JOIN ids i USING (rec_id) WHERE r.rid = i.id
UNION ALL SELECT rec_id, 'lead', i.aff::varchar, a.place::varchar, f.label FROM authors a JOIN refs r USING (rec_id, place) JOIN ids i USING (rec_id) JOIN affs f USING (rec_id) WHERE r.n = 1 AND r.rid = i.id AND f.place = i.aff
"""


def _attr(x: str, name: str) -> str:
    return f"regexp_replace(coalesce(json_extract_string({x}, '$.\"{name}\"'), ''), '^\\s+|\\s+$', '', 'g')"


P1_SQL = {
    "p1_found": NODE_SQL,
    "p1_subjects": f"{_NODES} SELECT rec_id, path AS node_path, up AS parent_path, label AS subject, {_attr('g', '@subj-group-type')} AS group_type FROM groups",
    "p1_subfields": f"""{_NODES} SELECT rec_id, path AS node_path, up AS parent_path, label AS subfield FROM groups WHERE above = 'Psychology'
UNION ALL SELECT rec_id, path, path, label FROM groups WHERE label = 'Psychology' AND n = 0""",
    "p1_leads": f"{_NODES} SELECT rec_id, node_path, parent_path, label AS lead_institution FROM (" + NODE_SQL.removeprefix(_NODES) + ") WHERE entity = 'lead'",
    "p1_contributors": f"""{_NODES}, cg AS (
  SELECT rec_id, i AS gi, q[i] AS q FROM (SELECT rec_id, {_list("json_extract(m, '$.\"contrib-group\"')")} AS q FROM m) s, LATERAL (SELECT unnest(range(1, len(q) + 1)) AS i)
), cs AS (SELECT rec_id, gi, i, k[i] AS c FROM (SELECT rec_id, gi, {_list("json_extract(q, '$.contrib')")} AS k FROM cg) s, LATERAL (SELECT unnest(range(1, len(k) + 1)) AS i))
SELECT rec_id, (row_number() OVER (PARTITION BY rec_id ORDER BY gi, i))::varchar AS node_path, gi::varchar AS parent_path, {_own("json_extract(c, '$.name.surname')")} AS surname,
  {_own("json_extract(c, '$.name.\"given-names\"')")} AS given_names, {_attr('c', '@contrib-type')} AS contrib_type, {_attr('c', '@corresp')} AS corresp FROM cs""",
    "p1_affiliations": f"""{_NODES} SELECT rec_id, place::varchar AS node_path, '' AS parent_path, {_attr('a', '@id')} AS aff_id, {_own("json_extract(a, '$.institution')")} AS institution,
  {_own('a')} AS own_text, {_own("json_extract(a, '$.\"addr-line\"')")} AS addr_line FROM affs""",
    "p1_references": f"""{_NODES}, xs AS (SELECT rec_id, place, i, x[i] AS x FROM (SELECT rec_id, place, {_list("json_extract(c, '$.xref')")} AS x FROM people) s, LATERAL (SELECT unnest(range(1, len(x) + 1)) AS i))
SELECT y.rec_id, (row_number() OVER (PARTITION BY y.rec_id ORDER BY place, i))::varchar AS node_path, place::varchar AS parent_path, {_attr('x', '@ref-type')} AS ref_type, {_attr('x', '@rid')} AS rid, ids.aff::varchar AS aff_path
FROM (SELECT *, trim(json_extract_string(x, '$."@rid"')) AS rid_ FROM xs) y LEFT JOIN ids ON ids.rec_id = y.rec_id AND ids.id = y.rid_
""",
}

QUERIES = {f.__name__: f for f in (p1_found, p1_subjects, p1_subfields, p1_leads, p1_contributors, p1_affiliations, p1_references, p2_found, p2_manifest, p2_joined, p2_names, p5_found, p7_found, p7_second_run)}

SQL = P1_SQL | {
    "p2_joined": "SELECT file_id, octet_length(encode(xml_text)) AS raw_length, CASE WHEN ends_with(xml_text, chr(10)) THEN 0 ELSE 1 END AS line_ends FROM xml_files WHERE xml_text <> ''",
    "p2_names": f"SELECT file_id, name FROM ({NAME_SQL})",
    "p2_found": f"SELECT min(file_id) AS file_id FROM ({NAME_SQL}) WHERE xml_text <> '' GROUP BY name, xml_text",
    "p7_found": """
WITH taken AS (
  SELECT d.*, p.run_id, p.attempt, r.started_at FROM processed_rows p
  JOIN run_log r ON p.run_id = r.run_id AND p.attempt = r.attempt AND r.status = 'ok'
  JOIN demographics_table d ON d.row_id = p.row_id
), saved AS (
  SELECT * FROM taken QUALIFY row_number() OVER (PARTITION BY doi, sample_id ORDER BY started_at DESC, run_id DESC, attempt DESC) = 1
), cur AS (
  SELECT * FROM demographics_table QUALIFY row_number() OVER (PARTITION BY doi, sample_id ORDER BY loaded_at DESC, row_id DESC) = 1
)
SELECT c.doi, c.sample_id FROM cur c LEFT JOIN saved s ON c.doi IS NOT DISTINCT FROM s.doi AND c.sample_id IS NOT DISTINCT FROM s.sample_id
WHERE s.row_id IS NULL OR
  (c.subfield, c.matched_subfields, c.subject_level_1, c.subject, c.publication_date, c.year, c.stage, c.lead_institution,
   c.gender_reported, c.gender_pct, c.race_reported, c.race_pct, c.education_reported, c.education_pct, c.ses_reported, c.ses_value)
  IS DISTINCT FROM
  (s.subfield, s.matched_subfields, s.subject_level_1, s.subject, s.publication_date, s.year, s.stage, s.lead_institution,
   s.gender_reported, s.gender_pct, s.race_reported, s.race_pct, s.education_reported, s.education_pct, s.ses_reported, s.ses_value)
""",
    "p7_second_run": """
WITH m AS (SELECT (epoch_us(min(loaded_at)) + epoch_us(max(loaded_at))) // 2 AS m FROM demographics_table),
cur AS (SELECT * FROM demographics_table QUALIFY row_number() OVER (PARTITION BY doi, sample_id ORDER BY loaded_at DESC, row_id DESC) = 1),
old AS (SELECT * FROM demographics_table WHERE epoch_us(loaded_at) <= (SELECT m FROM m) QUALIFY row_number() OVER (PARTITION BY doi, sample_id ORDER BY loaded_at DESC, row_id DESC) = 1)
SELECT c.doi, c.sample_id FROM cur c LEFT JOIN old s ON c.doi IS NOT DISTINCT FROM s.doi AND c.sample_id IS NOT DISTINCT FROM s.sample_id
WHERE s.row_id IS NULL OR (c.subfield, c.matched_subfields, c.subject_level_1, c.subject, c.publication_date, c.year, c.stage, c.lead_institution, c.gender_reported, c.gender_pct, c.race_reported, c.race_pct, c.education_reported, c.education_pct, c.ses_reported, c.ses_value)
  IS DISTINCT FROM (s.subfield, s.matched_subfields, s.subject_level_1, s.subject, s.publication_date, s.year, s.stage, s.lead_institution, s.gender_reported, s.gender_pct, s.race_reported, s.race_pct, s.education_reported, s.education_pct, s.ses_reported, s.ses_value)
""",
}
