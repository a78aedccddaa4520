"""Cells that hold several values, split into one row per value.

Quoted spans and JSON lists are atomic. The rest of a cell is a lattice: a
value ends at a separator, unless the text across the separator is a value of
its own. A listed term is always one, whatever its parts; a term that stood
quoted elsewhere is one where the frequencies say so. Value frequencies
are learned from the whole column by expectation-maximisation over its distinct
cells, and each cell takes the likeliest path through its lattice (Viterbi).
A value is a term, or a path of terms that begins with '/' and is kept whole.

Null, empty and blank cells, and cells of separators only, have no rows; empty
places aren't counted; repeated values stay. A quote that doesn't close is
ordinary text. A backslash before a separator, quote or backslash takes its
meaning away.
"""

from __future__ import annotations

import json
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle, uncollected

#: Characters that part values wherever they stand; a slash does
#: so between blanks, and without blanks only if both sides are values.
SEPARATORS = ";；|•,，、\t\n\r"
QUOTES = "\"'“”"
#: Learned values that a worker may hold; beyond it, cells are joined with them.
MAX_TERMS = 200_000
ROUNDS = 2
#: Expected uses that a listed term has from the start, and log scores of an
#: unlisted value, of one of its characters and of a slash without blanks.
LISTED, NEW_VALUE, NEW_CHAR, BARE_SLASH = 5.0, -12.0, -0.2, -3.0
#: Log score of each separator within a listed term: more than frequencies can weigh.
WHOLE = 1e4
_SEP = re.compile(rf"[{re.escape(SEPARATORS)}]+|(?<=\s)/(?=\s|$)|^/(?=\s)")
_PLACE = re.compile(rf"[{re.escape(SEPARATORS)}/]")
_CLOSES = re.compile(rf"\s*(?:$|[{re.escape(SEPARATORS)}]|/(?=\s|$))")
_QUOTED = re.compile(rf"[{re.escape(QUOTES)}\\\\]")
_ESCAPE = re.compile(rf"\\([{re.escape(SEPARATORS + QUOTES)}/\\])")


def unescape(text: str) -> str:
    return _ESCAPE.sub(r"\1", text)


def json_list(cell: str) -> list[str] | None:
    """The values of a cell that is a JSON list, else None."""
    if not cell.startswith("["):
        return None
    try:
        found = json.loads(cell)
    except (ValueError, RecursionError):
        return None
    if not isinstance(found, list):
        return None
    texts = [x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) for x in found if x is not None]
    return [t.strip() for t in texts if t.strip()]


def pieces(cell: str) -> list[tuple[int, int, str | None]]:
    """(start, end, quoted value or None) of the texts between separators, in order."""
    return quoted_pieces(cell) if _QUOTED.search(cell) else plain_pieces(cell)


def plain_pieces(cell: str) -> list[tuple[int, int, str | None]]:
    """The pieces of a cell without quotes and backslashes, cut at its separators."""
    out, n, a = [], len(cell), 0
    for b, after in [*(m.span() for m in _SEP.finditer(cell)), (n, n)]:
        while a < b and (cell[a].isspace() or cell[a] == "/" and (a + 1 >= n or cell[a + 1].isspace())):
            a += 1
        while b > a and cell[b - 1].isspace():
            b -= 1
        if b > a:
            out.append((a, b, None))
        a = after
    return out


def quoted_pieces(cell: str) -> list[tuple[int, int, str | None]]:
    """The pieces of any cell, read sign by sign."""
    out, i, n = [], 0, len(cell)
    while i < n:
        while i < n and (cell[i].isspace() or cell[i] in SEPARATORS):
            i += 1
        if i >= n:
            break
        if cell[i] == "/" and (i + 1 >= n or cell[i + 1].isspace()):
            i += 1
            continue
        if cell[i] in QUOTES:
            close = "”" if cell[i] == "“" else cell[i]
            j = i + 1
            while (j := cell.find(close, j)) >= 0:
                if cell[j - 1] == "\\" and j - 1 > i:
                    j += 1
                elif cell[j : j + 2] == close * 2 and not _CLOSES.match(cell, j + 1):
                    j += 2
                elif _CLOSES.match(cell, j + 1):
                    break
                else:
                    j += 1
            if j > i:
                inner = unescape(cell[i + 1 : j]).replace(close * 2, close).strip()
                if inner:
                    out.append((i, j + 1, inner))
                i = j + 1
                continue
        j = i
        while True:
            m = _SEP.search(cell, j)
            if m is None:
                j = n
                break
            back = m.start()
            while back > i and cell[back - 1] == "\\":
                back -= 1
            if (m.start() - back) % 2 == 0:
                j = m.start()
                break
            j = m.start() + 1
            if len(m.group()) > 1 and not cell[j].isspace():
                break
        end = j
        while end > i and cell[end - 1].isspace():
            end -= 1
        if end > i:
            out.append((i, end, None))
        i = max(j, i + 1)
    return out


def is_path(text: str) -> bool:
    return len(text) > 1 and text[0] == "/" and not text[1].isspace()


def places(text: str) -> int:
    """The most spans that the text can be made of."""
    return 1 + sum(c == "/" or c in SEPARATORS for c in text)


class Extent(NamedTuple):
    """Of all known terms: how many, their summed uses, and the most places
    (separators and slashes, plus one) and slash-parts that one of them has."""

    count: int
    total: float
    places: int
    parts: int


def extent(known: DataFrame) -> Extent:
    within = lambda chars: F.length(F.regexp_replace("term", f"[^{re.escape(chars)}]", ""))
    n, total, places, parts = known.agg(F.count(F.lit(1)), F.sum("uses"), F.max(within(SEPARATORS + "/")), F.max(within("/"))).first()
    # rounded, so that the order of the sum doesn't show
    return Extent(n, round(total or 0.0, 6), 1 + (places or 0), 1 + (parts or 0))


class Segmenter:
    """Values of a cell by the likeliest path, given expected counts of terms.
    total: the uses of the whole column, if counts are only a cell's own terms.
    listed: terms that are never split."""

    def __init__(self, counts: dict[str, float], total: float | None = None, listed: set[str] = frozenset()):
        total = total or sum(counts.values()) or 1.0
        self.score = {t: math.log(c / total) for t, c in counts.items() if c > 0}
        self.listed = listed
        self.places = max(map(places, self.score), default=1)
        self.parts = 1 + max((t.count("/") for t in self.score), default=0)
        #: What a term begins with before one of its separators or slashes.
        self.heads = {t[: m.start()].rstrip() for t in self.score for m in _PLACE.finditer(t)}
        self.values = lru_cache(maxsize=50_000)(self._values)

    def word(self, text: str) -> float:
        known = self.score.get(text)
        return known if known is not None else NEW_VALUE + NEW_CHAR * len(text)

    def path(self, text: str) -> tuple[float, bool, bool]:
        """Score of a path, whether separators within it belong to its terms,
        and whether they still could if the text went on."""
        parts = text.split("/")[1:]
        if not _SEP.search(text, 1) and not any(p in self.heads for p in parts):
            return sum(map(self.word, parts)), True, True
        best = [(0.0, True)] + [(-math.inf, False)] * len(parts)
        whole = 0  # the last place before the open part that terms alone can reach
        reached = [True] + [False] * len(parts)
        for j in range(1, len(parts) + 1):
            for i in range(max(0, j - self.parts), j):
                term = "/".join(parts[i:j])
                known = term in self.score
                if j - i > 1 and not known:
                    continue
                marks = _SEP.findall(term)
                clean = known or not marks
                reached[j] |= reached[i] and clean
                s = best[i][0] + self.word(term) + (WHOLE * len(marks) if term in self.listed else 0.0)
                if s > best[j][0]:
                    best[j] = (s, best[i][1] and clean)
            if reached[j] and j < len(parts):
                whole = j
        return *best[-1], places("/".join(parts[whole:])) <= self.places

    def chain(self, cell: str) -> list[str] | None:
        """The values of a cell whose lattice is one chain: no known term begins
        with one of its pieces and goes on behind a separator or slash. Else None."""
        out, heads = [], self.heads
        for a, b, quoted in pieces(cell):
            text = quoted
            if quoted is None:
                text = cell[a:b]
                if text in heads or "\\" in text:
                    return None
                if "/" in text and not (is_path(text) and heads.isdisjoint(text.split("/")) or text in self.score):
                    return None
            out.append(text)
        return out

    def edges(self, cell: str) -> tuple[int, list[tuple[int, int, str, float]]]:
        """Number of places and the lattice's edges (from, to, value, score)."""
        found = pieces(cell)
        spans = []
        for start, end, quoted in found:
            raw = cell[start:end]
            if quoted is None and "/" in raw and not is_path(raw) and unescape(raw) not in self.score:
                marks = [m.start() for m in re.finditer(r"(?<!\\)/", raw)]
                cuts = [0, *marks, len(raw)]
                spans += [(start + a + (k > 0), start + b, None, k > 0) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
            else:
                spans.append((start, end, quoted, False))
        out = []
        for i, (start, _, quoted, _) in enumerate(spans):
            if quoted is not None:
                out.append((i, i + 1, quoted, self.path(quoted)[0] if is_path(quoted) else self.word(quoted)))
                continue
            bare = True
            for j in range(i + 1, len(spans) + 1):
                if spans[j - 1][2] is not None:
                    break
                bare = bare and (j == i + 1 or spans[j - 1][3])
                value = unescape(cell[start : spans[j - 1][1]]).strip()
                if is_path(value):
                    s, clean, open_ended = self.path(value)
                    if j == i + 1 or clean:
                        out.append((i, j, value, s))
                    if not open_ended:
                        break
                elif j == i + 1:
                    out.append((i, j, value, self.word(value) + BARE_SLASH * spans[i][3]))
                    if value not in self.heads and not (j < len(spans) and spans[j][3]):
                        break  # no term goes on from here
                elif bare or value in self.score:
                    whole = WHOLE * (j - i - 1) if value in self.listed else 0.0
                    out.append((i, j, value, self.word(value) + BARE_SLASH * spans[i][3] + whole))
                elif j - i >= self.places:
                    break
        return len(spans), out

    def _values(self, cell: str) -> tuple[str, ...]:
        cell = cell.strip()
        listed = json_list(cell)
        if listed is not None:
            return tuple(listed)
        plain = self.chain(cell)
        if plain is not None:
            return tuple(plain)
        n, edges = self.edges(cell)
        best: list = [(0.0, None, None)] + [(-math.inf, None, None)] * n
        for i, j, value, s in edges:
            if best[i][0] + s > best[j][0]:
                best[j] = (best[i][0] + s, i, value)
        out = []
        while n:
            out.append(best[n][2])
            n = best[n][1]
        return tuple(v for v in reversed(out) if v)

    def expected(self, cell: str) -> dict[str, float]:
        """Expected uses of each term in the cell, by forward-backward sums."""
        cell = cell.strip()
        listed = json_list(cell)
        if listed is not None:
            posts = [(v, 1.0) for v in listed]
        else:
            plain = self.chain(cell)
            if plain is not None:
                return self._terms([(v, 1.0) for v in plain])
            n, edges = self.edges(cell)
            ahead, back = [-math.inf] * (n + 1), [-math.inf] * (n + 1)
            ahead[0] = back[n] = 0.0
            for i, j, _, s in edges:
                ahead[j] = _log_add(ahead[j], ahead[i] + s)
            for i, j, _, s in reversed(edges):
                back[i] = _log_add(back[i], back[j] + s)
            posts = [(v, math.exp(min(0.0, ahead[i] + s + back[j] - ahead[n]))) for i, j, v, s in edges]
        return self._terms(posts)

    @staticmethod
    def _terms(posts: list[tuple[str, float]]) -> dict[str, float]:
        uses: dict[str, float] = defaultdict(float)
        for value, p in posts:
            for term in value.split("/")[1:] if is_path(value) else [value]:
                if term.strip():
                    uses[term.strip()] += p
        return uses


def _log_add(a: float, b: float) -> float:
    if a == -math.inf or b == -math.inf:
        return max(a, b)
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def _quoted(cell: str) -> list[str]:
    cell = cell.strip()
    listed = json_list(cell)
    return listed if listed is not None else [q for _, _, q in pieces(cell) if q is not None]


def long_cells(table: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field_name, cell) of the packed columns."""
    return table.select(key, F.explode(F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f).cast("string"))])).alias("field_name", "cell")).where(
        F.length(F.trim("cell")) > 0
    )


def learn(cells: DataFrame, terms: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(term, uses) over all distinct cells of the column cell; terms: the
    listed terms in a column term. What fewer than two cells use is left out:
    an unlisted value keeps its score by length."""
    distinct = settle(cells.select("cell").distinct(), "cells")
    listed = terms.select("term").where("term is not null").distinct().select("term", F.lit(LISTED).alias("uses"), F.lit(True).alias("listed"))

    def spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [q for c in b["cell"] for q in set(_quoted(c)) if not is_path(q)]
            if rows:
                yield pd.DataFrame({"term": rows, "uses": 1.0})

    def with_listed(uses: DataFrame) -> DataFrame:
        found = uses.groupBy("term").agg(F.sum("uses").alias("uses")).where("uses >= 2").withColumn("listed", F.lit(False))
        return found.unionByName(listed).groupBy("term").agg(F.sum("uses").alias("uses"), F.bool_or("listed").alias("listed"))

    known = with_listed(distinct.where(F.col("cell").rlike(f"[{QUOTES}]") | F.ltrim("cell").startswith("[")).mapInPandas(spans, "term string, uses double"))
    for _ in range(rounds):
        known = settle(known, "terms")
        size = extent(known)
        counts = bounded(known, size)

        def expect(batches: Iterator[pd.DataFrame], counts=counts, total=size.total) -> Iterator[pd.DataFrame]:
            fixed = segmenter(counts, total) if counts is not None else None
            uses: dict[str, float] = defaultdict(float)
            for b in batches:
                own = [None] * len(b) if fixed else b["known"]
                with uncollected():
                    for cell, near in zip(b["cell"].tolist(), own):
                        for t, p in (fixed or segmenter(near, total)).expected(cell).items():
                            uses[t] += p
                if len(uses) > MAX_TERMS:
                    yield pd.DataFrame({"term": list(uses), "uses": list(uses.values())})
                    uses.clear()
            if uses:
                yield pd.DataFrame({"term": list(uses), "uses": list(uses.values())})

        source = distinct if counts is not None else with_known(distinct, known, size)
        known = with_listed(source.mapInPandas(expect, "term string, uses double"))
    return settle(known, "terms")


def segmenter(known, total: float) -> Segmenter:
    """A Segmenter of known terms with their uses and whether they are listed."""
    known = [] if known is None else known
    return Segmenter({x["term"]: x["uses"] for x in known}, total, {x["term"] for x in known if x["listed"]})


def bounded(known: DataFrame, size: Extent) -> list[dict] | None:
    """The terms as a list for all workers, if there are at most MAX_TERMS of them."""
    return [r.asDict() for r in known.collect()] if size.count <= MAX_TERMS else None


def lookups(cell: str, size: Extent) -> set[str]:
    """All texts that a Segmenter could find among terms of this extent while
    it reads the cell. A term over n of the smallest spans has n - 1 separators
    or slashes, so longer runs of spans can't be terms."""
    cell = cell.strip()
    if json_list(cell) is not None:
        return set()
    texts: set[str] = set()
    spans: list[tuple[int, int, str | None]] = []
    for start, end, quoted in pieces(cell):
        raw = cell[start:end]
        if quoted is None and "/" in raw and not is_path(raw):
            cuts = [-1, *[m.start() for m in re.finditer(r"(?<!\\)/", raw)], len(raw)]
            spans += [(start + a + 1, start + b, None) for a, b in zip(cuts, cuts[1:])]
        else:
            spans.append((start, end, quoted))

    def add_terms(path: str) -> None:
        parts = path.split("/")[1:]
        texts.update("/".join(parts[i:j]) for i in range(len(parts)) for j in range(i + 1, min(i + size.parts, len(parts)) + 1))

    run_end, seen = 0, False
    for i, (start, _, quoted) in enumerate(spans):
        if quoted is not None:
            texts.add(quoted)
            if is_path(quoted):
                add_terms(quoted)
            continue
        if i >= run_end:
            run_end, seen = next((j for j in range(i, len(spans)) if spans[j][2] is not None), len(spans)), False
        for j in range(i, min(i + size.places, run_end)):
            texts.add(unescape(cell[start : spans[j][1]]).strip())
        longest = unescape(cell[start : spans[run_end - 1][1]]).strip()
        if not seen and (is_path(longest) or is_path(unescape(cell[start : spans[i][1]]).strip())):
            # later paths of the run have no other terms than its first
            seen = True
            add_terms(longest)
            for j in range(i, run_end):
                last = unescape(cell[start : spans[j][1]]).strip().rsplit("/", size.parts)[1:]
                texts.update("/".join(last[k:]) for k in range(len(last)))
    return texts


def with_known(cells: DataFrame, known: DataFrame, size: Extent) -> DataFrame:
    """Each distinct cell with the terms that occur among its candidates: the
    way without a dictionary in every worker."""

    def candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(cell, t) for cell in b["cell"] for t in lookups(cell, size)], columns=["cell", "term"])

    near = (
        cells.mapInPandas(candidates, "cell string, term string")
        .join(known, "term")
        .groupBy("cell")
        .agg(F.collect_list(F.struct("term", "uses", "listed")).alias("known"))
    )
    return cells.join(near, "cell", "left")


def rows_of_values(batch: pa.RecordBatch, cut: Segmenter) -> pa.RecordBatch:
    """A row per value of a batch (key, field_name, cell); each distinct cell is split once."""
    keys, fields, cells = batch.columns
    coded = cells.dictionary_encode()
    with uncollected():
        found = [cut.values(c) for c in coded.dictionary.to_pylist()]
    sizes = np.array([len(v) for v in found], dtype=np.int32)
    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, sizes.cumsum()].astype(np.int32)), pa.array([t for v in found for t in v], pa.string()))
    at = coded.indices.to_numpy()
    own = sizes[at]
    rows = np.repeat(np.arange(len(at)), own)
    pos = np.arange(len(rows)) - np.repeat(own.cumsum() - own, own) + 1
    return pa.RecordBatch.from_arrays(
        [keys.take(pa.array(rows)), fields.take(pa.array(rows)), pa.array(pos.astype(np.int32)), lists.take(coded.indices).flatten()], names=[batch.schema.names[0], "field_name", "pos", "term"]
    )


def unpack(table: DataFrame, key: str, fields: list[str], terms: DataFrame) -> DataFrame:
    """(key, field_name, pos, term): one row per value of the packed columns."""
    cells = long_cells(table, key, fields)
    known = learn(cells, terms)
    size = extent(known)
    counts = bounded(known, size)
    if counts is not None:

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cut = segmenter(counts, size.total)
            for b in batches:
                yield rows_of_values(b, cut)

        return cells.mapInArrow(split, f"{key} {dict(table.dtypes)[key]}, field_name string, pos int, term string")

    def split_near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"cell": b["cell"], "values": [list(segmenter(k, size.total).values(c)) for c, k in zip(b["cell"], b["known"])]})

    parts = with_known(cells.select("cell").distinct(), known, size).mapInPandas(split_near, "cell string, values array<string>")
    return cells.join(parts, "cell").select(key, "field_name", F.posexplode("values").alias("at", "term")).select(
        key, "field_name", (F.col("at") + 1).cast("int").alias("pos"), "term"
    )
