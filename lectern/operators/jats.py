"""Article XML into typed rows: each text is parsed once, errors become a column.

Everything is read with the standard library's parser, which fetches nothing.
Named HTML entities are known to it. A null or malformed text gives a row with
only its key and the error.
"""

from __future__ import annotations

import datetime
import html.entities
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import PRIORITY_WORDS
from ..schemas import METADATA
from ..session import ship

_ENTITY = re.compile(r"&([A-Za-z][A-Za-z0-9]*);")
_XML_NAMES = {"amp", "lt", "gt", "quot", "apos"}


def parse(text: str) -> ET.Element:
    """The root; HTML's named entities count as their characters."""
    known = html.entities.name2codepoint
    return ET.fromstring(_ENTITY.sub(lambda m: f"&#{known[m[1]]};" if m[1] in known and m[1] not in _XML_NAMES else m[0], text))


def whole_text(node: ET.Element | None) -> str:
    return "".join(node.itertext()).strip() if node is not None else ""


def own_text(node: ET.Element | None) -> str:
    return (node.text or "").strip() if node is not None else ""


def distinct(items: Iterator[str]) -> list[str]:
    return list(dict.fromkeys(items))


def publication_date(root: ET.Element) -> datetime.date | None:
    """Of the first electronic, collection, print and any date the first that is a valid one."""
    dates = root.findall(".//pub-date")
    for wanted in ("epub", "collection", "ppub", None):
        node = next((d for d in dates if wanted is None or d.get("pub-type") == wanted), None)
        if node is None or not own_text(node.find("year")):
            continue
        try:
            return datetime.date(int(own_text(node.find("year"))), *(int(own_text(node.find(p)) or 1) for p in ("month", "day")))
        except ValueError:
            continue
    return None


def discipline_groups(root: ET.Element) -> list[ET.Element]:
    categories = root.find(".//article-categories")
    return [] if categories is None else [g for g in categories.findall("subj-group") if (g.get("subj-group-type") or "").startswith("Discipline")]


def subfields(root: ET.Element, node: str = "Psychology") -> list[str]:
    """First subjects of the groups right below each group that has the node as
    a subject, or the node where there are none; in document order."""
    categories = root.find(".//article-categories")
    out: list[str] = []
    for group in [] if categories is None else categories.iter():
        for subject in group.findall("subject"):
            if own_text(subject) == node:
                below = group.findall("subj-group")
                out += [own_text(g.find("subject")) for g in below if own_text(g.find("subject"))] if below else [node]
    return distinct(iter(out))


def lead_institution(root: ET.Element) -> str | None:
    """Institution, else the whole text, of the affiliation that the first such
    reference of the corresponding, else first, author leads to. Only what
    stands directly in author and affiliation counts."""
    authors = [c for c in root.findall(".//article-meta/contrib-group/contrib") if c.get("contrib-type") == "author"]
    lead = next((a for a in authors if a.get("corresp") == "yes"), authors[0] if authors else None)
    ref = None if lead is None else next((x for x in lead.findall("xref") if x.get("ref-type") == "aff"), None)
    aff = None if ref is None or not ref.get("rid") else next((a for a in root.iter("aff") if a.get("id") == ref.get("rid")), None)
    return None if aff is None else own_text(aff.find("institution")) or whole_text(aff) or None


def extraction_text(root: ET.Element) -> str:
    """The body's top sections, those on methods and samples first, parted by blank lines."""
    body = root.find(".//body")
    if body is None:
        return ""
    sections = body.findall("sec")
    if not sections:
        return whole_text(body)
    first = [any(w in (t.text or "").lower() for t in s.iter("title") for w in PRIORITY_WORDS) for s in sections]
    ordered = [s for s, p in zip(sections, first) if p] + [s for s, p in zip(sections, first) if not p]
    return "\n\n".join(t for t in map(whole_text, ordered) if t)


def metadata(root: ET.Element) -> tuple:
    """The columns of METADATA but the error."""
    groups = discipline_groups(root)
    ids = (i for i in root.iter("article-id") if i.get("pub-id-type") == "doi")
    return (
        own_text(next(ids, None)),
        whole_text(root.find(".//article-title")),
        own_text(root.find(".//journal-meta//journal-title")),
        root.get("article-type") or "",
        publication_date(root),
        distinct(own_text(g.find("subject")) for g in groups if own_text(g.find("subject"))),
        distinct(own_text(s) for g in groups for s in g.iter("subject") if own_text(s)),
        subfields(root),
        lead_institution(root),
        extraction_text(root),
    )


def parse_articles(files: DataFrame, column: str = "xml_text") -> DataFrame:
    """The files' other columns with those of METADATA in a struct named article."""
    ship(files.sparkSession)
    keep = [c for c in files.columns if c != column]
    names = METADATA.fieldNames()
    prefix = "_a_"
    shape = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in files.select(*keep).schema] + [f"{prefix}{f.name} {f.dataType.simpleString()}" for f in METADATA])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text in b[column]:
                try:
                    rows.append((*metadata(parse(text)), None))
                except Exception as e:  # noqa: BLE001 - whatever is wrong with a file is the row's error
                    rows.append((None,) * (len(names) - 1) + (f"{type(e).__name__}: {e}"[:500],))
            out = b[keep].reset_index(drop=True)
            for i, n in enumerate(names):
                out[prefix + n] = pd.Series([r[i] for r in rows], dtype=object)
            yield out

    parsed = files.select(*keep, column).mapInPandas(run, shape)
    return parsed.select(*keep, F.struct(*[F.col(prefix + n).alias(n) for n in names]).alias("article"))
