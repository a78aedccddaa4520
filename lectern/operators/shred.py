"""Nested records into flat tables, by shared inlining.

The schema graph has an edge for each element found within another, with the
most times it occurs there. An element becomes a relation if it is repeated,
shared by several parents, or recursive; every other element is inlined as
columns of the relation above it. Each row of a relation has its place, the
place of its parent row, and the rows that its references by id lead to.

Records that are not valid JSON, and null ones, have no rows. Absent, null and
empty parts ([], {}) are no elements below a repeated one; a list of one, in
whatever way it is stored, is one element, and lists within lists are one list.
Records may be nested to any depth. Numbers keep the text they are stored as;
halves of surrogate pairs come out as "?".
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from json.decoder import scanstring
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship, uncollected

#: Bound of the schema graph that the driver may hold.
MAX_EDGES = 20_000
NODE_SQL = "struct<relation:string,path:string,parent_relation:string,parent_path:string,refs:array<string>,cols:map<string,string>>"
_SPACE = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
_WORDS = {"true": True, "false": False, "null": None}
_WORD = re.compile("|".join(_WORDS))


def _refuse(name: str):
    raise ValueError(f"{name} is not JSON")


_DECODER = json.JSONDecoder(parse_constant=_refuse, parse_int=str, parse_float=str)


def read_json(text: str | None):
    """The value and whether the text is valid JSON (NaN and Infinity are not)."""
    if text is None:
        return None, False
    try:
        return _DECODER.decode(text), True
    except RecursionError:
        try:
            return read_deep(text), True
        except ValueError:
            return None, False
    except ValueError:
        return None, False


def _key(text: str, at: int) -> tuple[str, int]:
    if text[at : at + 1] != '"':
        raise ValueError(f"no key at {at}")
    key, at = scanstring(text, at + 1, True)
    at = _SPACE.match(text, at).end()
    if text[at : at + 1] != ":":
        raise ValueError(f"no colon at {at}")
    return key, _SPACE.match(text, at + 1).end()


def read_deep(text: str):
    """The value of a JSON text of any depth: open objects and lists are kept on
    a stack of their own. The slow way, for texts that the library's reader can't follow."""
    at = _SPACE.match(text).end()
    stack: list[list] = []
    while True:
        c = text[at : at + 1]
        if c and c in "{[":
            box = {} if c == "{" else []
            at = _SPACE.match(text, at + 1).end()
            if text[at : at + 1] != ("}" if c == "{" else "]"):
                stack.append([box, None])
                if c == "{":
                    stack[-1][1], at = _key(text, at)
                continue
            value, at = box, at + 1
        elif c == '"':
            value, at = scanstring(text, at + 1, True)
        elif m := _WORD.match(text, at):
            value, at = _WORDS[m.group()], m.end()
        elif m := _NUMBER.match(text, at):
            value, at = m.group(), m.end()
        else:
            raise ValueError(f"no value at {at}")
        while True:
            at = _SPACE.match(text, at).end()
            if not stack:
                if at != len(text):
                    raise ValueError(f"text behind the value at {at}")
                return value
            box, key = stack[-1]
            if isinstance(box, dict):
                box[key] = value
            else:
                box.append(value)
            c, at = text[at : at + 1], at + 1
            if c == ",":
                at = _SPACE.match(text, at).end()
                if isinstance(box, dict):
                    stack[-1][1], at = _key(text, at)
                break
            if c != ("}" if isinstance(box, dict) else "]"):
                raise ValueError(f"neither comma nor end at {at - 1}")
            value = box
            stack.pop()


def _items(value) -> list:
    """The elements behind a key, in order; null and empty ones are none."""
    if not isinstance(value, list):
        return [] if value is None or value == {} else [value]
    if any(isinstance(x, list) for x in value):
        flat, todo = [], [value]
        while todo:
            x = todo.pop()
            if isinstance(x, list):
                todo.extend(reversed(x))
            else:
                flat.append(x)
        value = flat
    return [x for x in value if x is not None and x != {}]


def _leaf(value) -> str:
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


@dataclass
class Graph:
    """Edges parent -> child with the most occurrences of the child in one parent."""

    edges: dict[tuple[str, str], int] = field(default_factory=dict)

    def relations(self, force: set[str] = frozenset()) -> set[str]:
        """Repeated, shared and recursive elements, and those declared as such."""
        parents, children = defaultdict(set), defaultdict(set)
        for a, b in self.edges:
            parents[b].add(a)
            children[a].add(b)
        found = {b for (_, b), n in self.edges.items() if n > 1} | {b for b, up in parents.items() if len(up) > 1}
        for start in list(children):
            todo, seen = list(children[start]), set()
            while todo:
                x = todo.pop()
                if x == start:
                    found.add(start)
                    break
                if x not in seen:
                    seen.add(x)
                    todo.extend(children[x])
        return found | set(force)


def edges_of(value, most: dict[tuple[str, str], int]) -> None:
    """Take the edges of one record into most."""
    todo = [("", x) for x in _items(value)]
    while todo:
        name, x = todo.pop()
        if not isinstance(x, dict):
            continue
        for key, below in x.items():
            if key[:1] in ("@", "#"):
                continue
            if isinstance(below, str):
                most.setdefault((name, key), 1)
                continue
            parts = _items(below)
            if parts:
                edge = (name, key)
                if most.get(edge, 0) < len(parts):
                    most[edge] = len(parts)
                for p in parts:
                    if isinstance(p, dict):
                        todo.append((key, p))


def schema_graph(records: DataFrame, column: str) -> Graph:
    """One pass over all records; the driver gets one row per distinct edge."""

    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        most: dict[tuple[str, str], int] = {}
        with uncollected():
            for b in batches:
                for text in b[column]:
                    value, ok = read_json(text)
                    if ok:
                        edges_of(value, most)
        yield pd.DataFrame([(a, b, n) for (a, b), n in most.items()], columns=["parent", "child", "most"])

    ship(records.sparkSession)
    rows = (
        records.select(column)
        .mapInPandas(edges, "parent string, child string, most bigint")
        .groupBy("parent", "child")
        .agg(F.max("most").alias("most"))
        .limit(MAX_EDGES + 1)
        .collect()
    )
    if len(rows) > MAX_EDGES:
        raise ValueError(f"more than {MAX_EDGES} distinct element edges: keys hold data, not names")
    return Graph({(r["parent"], r["child"]): r["most"] for r in rows})


class Node(NamedTuple):
    relation: str
    path: str
    parent_relation: str
    parent_path: str
    refs: list[str]
    cols: dict[str, str]


def _columns(x, relations: set[str], first: set[str], keep: set[str] | None) -> tuple[dict[str, str], list]:
    """Inlined columns of an element, those to keep, and the (relation, element) rows right below it."""
    cols: dict[str, str] = {}
    later: list = []
    todo = [(x, "", False)]
    while todo:
        x, prefix, copied = todo.pop()
        if not isinstance(x, dict):
            name = prefix or "#text"
            if keep is None or name in keep:
                cols[name] = _leaf(x)
            continue
        for key, below in x.items():
            if below is None:
                continue
            if key in relations:
                parts = _items(below)
                if not copied:
                    later.extend((key, p) for p in parts)
                if parts and key in first and key not in prefix.split("/"):
                    todo.append((parts[0], f"{prefix}/{key}" if prefix else key, True))
                continue
            name = (prefix if key == "#text" else f"{prefix}/{key}") if prefix else key
            if isinstance(below, str) or key[:1] in ("@", "#"):
                if keep is None or name in keep:
                    cols[name] = _leaf(below)
            else:
                todo.extend((p, name, copied) for p in _items(below)[::-1])
    return cols, later


def shred_value(value, relations: set[str], first: set[str] = frozenset(), wanted: dict[str, set[str]] | None = None, id_key: str = "@id", ref_key: str = "@rid") -> list[Node]:
    """All rows of one record, in document order. path: places among the rows
    of a relation under the same enclosing row of that relation (over the whole
    record if there is none), joined by '.'. Relations named in first lend
    their first row's columns to the row above, beside having rows of their own.
    wanted: the relations and columns to give, id and reference among them."""
    nodes: list[Node] = []
    counts: dict[tuple[str, str], int] = defaultdict(int)
    ids: dict[str, list[str]] = defaultdict(list)
    asking: list[Node] = []
    keys = {id_key, ref_key}
    stack = [("", x, "", "", {}) for x in reversed(_items(value))]
    while stack:
        relation, x, parent_relation, parent_path, above = stack.pop()
        outer = above.get(relation, "")
        counts[relation, outer] += 1
        path = f"{outer}.{counts[relation, outer]}" if outer else str(counts[relation, outer])
        cols, later = _columns(x, relations, first, None if wanted is None else wanted.get(relation, keys))
        node = Node(relation, path, parent_relation, parent_path, [], cols)
        if wanted is None or relation in wanted:
            nodes.append(node)
        if cols:
            if id_key in cols and (own := cols[id_key].strip()):
                ids[own].append(f"{relation}:{path}")
            if ref_key in cols:
                asking.append(node)
        if later:
            inside = above | {relation: path}
            stack.extend((key, p, relation, path, inside) for key, p in reversed(later))
    for n in asking:
        n.refs.extend(ids.get(n.cols[ref_key].strip(), ()))
    return nodes


def _strings(texts: list[str]) -> pa.Array:
    try:
        return pa.array(texts, pa.string())
    except UnicodeEncodeError:
        return pa.array([t.encode("utf-8", "replace").decode() for t in texts], pa.string())


def _offsets(sizes: list[int]) -> pa.Array:
    out, at = [0], 0
    for n in sizes:
        at += n
        out.append(at)
    return pa.array(out, pa.int32())


def node_lists(records: list[list[Node]]) -> pa.Array:
    """The records' rows as an Arrow column, built column by column."""
    nodes = [n for r in records for n in r]
    refs = pa.ListArray.from_arrays(_offsets([len(n.refs) for n in nodes]), _strings([x for n in nodes for x in n.refs]))
    cols = pa.MapArray.from_arrays(_offsets([len(n.cols) for n in nodes]), _strings([k for n in nodes for k in n.cols]), _strings([v for n in nodes for v in n.cols.values()]))
    plain = [_strings([n[i] for n in nodes]) for i in range(4)]
    rows = pa.StructArray.from_arrays([*plain, refs, cols], names=["relation", "path", "parent_relation", "parent_path", "refs", "cols"])
    return pa.ListArray.from_arrays(_offsets([len(r) for r in records]), rows)


def shred(records: DataFrame, key: str, column: str, relations: set[str], wanted: dict[str, list[str]] | None = None, first: set[str] = frozenset()) -> DataFrame:
    """(key, nodes): one row per valid record, all its relations' rows in an
    array, so that what stays within a record needs no shuffle. wanted: the
    relations and columns to give out, all unless named."""
    chosen = None if wanted is None else {r: {"@id", "@rid", *c} for r, c in wanted.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, out = [], []
            with uncollected():
                for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    value, ok = read_json(text)
                    if ok:
                        keys.append(k)
                        out.append(shred_value(value, relations, first, chosen))
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.column(0).type), node_lists(out)], names=[key, "nodes"])

    kind = dict(records.dtypes)[key]
    return records.select(key, column).mapInArrow(run, f"{key} {kind}, nodes array<{NODE_SQL}>")


def outer_path(path: Column) -> Column:
    """The place of the enclosing row of the same relation, '' if there is none."""
    return F.substr(path, F.lit(1), F.length(path) - F.length(F.substring_index(path, ".", -1)) - 1)


def target_path(node: Column, relation: str) -> Column:
    """The place of the first row of a relation that the node's reference leads to, null if there is none."""
    return F.substring_index(F.try_element_at(F.filter(node["refs"], lambda r: r.startswith(f"{relation}:")), F.lit(1)), ":", -1)


def relation_rows(shredded: DataFrame, key: str, relation: str) -> DataFrame:
    """(key, n): one row per row of a relation."""
    return shredded.select(key, F.explode(F.filter("nodes", lambda x: x["relation"] == relation)).alias("n"))


def text(node: Column, place: str) -> Column:
    """An inlined column without outer white space, '' if absent."""
    raw = F.coalesce(F.try_element_at(node["cols"], F.lit(place)), F.lit(""))
    return F.regexp_replace(raw, r"(?U)^\s+|\s+$", "")
