"""Texts over a size limit, cut into overlapping pieces at natural boundaries.

Atoms are words with the white space after them; a boundary between atoms is
as strong as what stands there: a word, clause, sentence, line or paragraph
end. Adjacent pieces wait in a heap; the weakest boundary is merged first as
long as the combined size plus overlap fits. Each piece then begins overlap
characters before its own part, so neighbours share exactly that many and the
own parts put together are the text. Sizes are in code points.

A null text has no piece, a text within its limit (an empty one too) is one
piece, and a text whose class has no limit stays whole. A run without white
space that is longer than a piece is cut by size, not between a letter and its
combining marks or within a line end.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import uncollected

WORD, CLAUSE, SENTENCE, LINE, PARAGRAPH = range(1, 6)
NAMES = {0: "cut", WORD: "word", CLAUSE: "clause", SENTENCE: "sentence", LINE: "line", PARAGRAPH: "paragraph"}
_ATOM = re.compile(r"\S+\s*|\s+")
_WIDE = re.compile(r"[。！？；，、][”’」』）]*")
_BREAK = re.compile(r"\r\n|[\n\r\x0b\x0c\x85  ]")
PIECES = "n_pieces int, piece_no int, start_pos int, own_start int, end_pos int, boundary string, longest_run int, piece string"


def strength(atom: str) -> int:
    """Strength of the boundary after an atom."""
    word = atom.rstrip()
    if len(atom) - len(word) == 1 and atom[-1] == " ":
        return _after(word)
    breaks = len(_BREAK.findall(atom[len(word) :])) + (" " in atom[len(word) :])
    if breaks:
        return PARAGRAPH if breaks > 1 else LINE
    return _after(word)


def _after(word: str) -> int:
    last = word.rstrip("\"'”’»)]}」』）")[-1:]
    if last and last in ".!?…。！？":
        return SENTENCE
    return CLAUSE if last and last in ",;:，；：、–—" else WORD


def atoms(text: str, most: int) -> list[tuple[int, int, int]]:
    """(start, end, strength of the boundary after it); an atom has at most `most` characters."""
    out = []
    wide = _WIDE.search(text) is not None
    for m in _ATOM.finditer(text):
        a, b, after = m.start(), m.end(), strength(m.group())
        marks = [x.end() for x in _WIDE.finditer(m.group().rstrip())] if wide else ()
        for cut in marks:
            if cut < b - m.start() and a < m.start() + cut:
                kind = SENTENCE if text[m.start() + cut - 1] in "。！？”’」』）" else CLAUSE
                out.append((a, m.start() + cut, kind))
                a = m.start() + cut
        out.append((a, b, after))
    cut_up = []
    for a, b, after in out:
        while b - a > most:
            end = a + most
            while end > a + 1 and (unicodedata.combining(text[end]) or text[end - 1 : end + 1] == "\r\n" or text[end] in "‍️" or text[end - 1] == "‍"):
                end -= 1
            if end == a + 1:
                end = a + most
            cut_up.append((a, end, 0))
            a = end
        cut_up.append((a, b, after))
    return cut_up


def merge(parts: list[tuple[int, int, int]], room: int) -> list[tuple[int, int, int]]:
    """Merge neighbours, weakest boundary first and smallest first among equals, up to room characters."""
    start, end = [p[0] for p in parts], [p[1] for p in parts]
    after = [p[2] for p in parts]
    left, right = list(range(-1, len(parts) - 1)), [*range(1, len(parts)), -1]
    alive = [True] * len(parts)
    heap = [(after[i], end[i + 1] - start[i], i, i + 1) for i in range(len(parts) - 1) if end[i + 1] - start[i] <= room]
    heapq.heapify(heap)
    while heap:
        _, size, i, j = heapq.heappop(heap)
        if not (alive[i] and alive[j]) or right[i] != j or end[j] - start[i] != size:
            continue
        end[i], after[i], right[i], alive[j] = end[j], after[j], right[j], False
        if right[j] >= 0:
            left[right[j]] = i
            if end[right[j]] - start[i] <= room:
                heapq.heappush(heap, (after[i], end[right[j]] - start[i], i, right[j]))
        if left[i] >= 0 and end[i] - start[left[i]] <= room:
            heapq.heappush(heap, (after[left[i]], end[i] - start[left[i]], left[i], i))
    return [(start[i], end[i], after[i]) for i in range(len(parts)) if alive[i]]


def split(text: str, limit: int, overlap: int) -> list[tuple[int, int, int, str]]:
    """(start with overlap, own start, end, kind of the boundary at the end)."""
    if len(text) <= limit:
        return [(0, 0, len(text), "end")]
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    room = limit - overlap
    done = merge(atoms(text, room), room)
    return [(max(0, a - overlap), a, b, "end" if b == len(text) else NAMES[k]) for a, b, k in done]


def longest_run(text: str) -> int:
    return max(map(len, text.split()), default=0)


def split_texts(texts: DataFrame, key: str, column: str, limits: DataFrame, by: str = "size_class") -> DataFrame:
    """(key, n_pieces, piece_no, start_pos, own_start, end_pos, boundary,
    longest_run, piece) of every text; limits: by, max_chars, overlap_chars.

    Only texts over the limit go through Python; nothing is shuffled but the
    few limits.
    """
    rows = texts.select(F.col(key), F.col(column).alias("_text"), F.col(by)).where("_text is not null")
    rows = rows.join(limits.select(by, "max_chars", "overlap_chars").dropDuplicates([by]), by, "left").drop(by)
    n = F.char_length("_text")
    over = F.coalesce(n > F.col("max_chars"), F.lit(False))
    kind = dict(texts.dtypes)[key]
    short = rows.where(~over).select(
        key, F.lit(1).alias("n_pieces"), F.lit(1).alias("piece_no"), F.lit(0).alias("start_pos"), F.lit(0).alias("own_start"), n.alias("end_pos"),
        F.lit("end").alias("boundary"), F.lit(None).cast("int").alias("longest_run"), F.col("_text").alias("piece"),
    )

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [key, *[c.split()[0] for c in PIECES.split(", ")]]
        for b in batches:
            rows: list[tuple] = []
            for k, text, limit, overlap in zip(b[key], b["_text"], b["max_chars"], b["overlap_chars"]):
                with uncollected():
                    found, run = split(text, int(limit), int(overlap)), longest_run(text)
                rows += [(k, len(found), i, s, own, e, kind, run, text[s:e]) for i, (s, own, e, kind) in enumerate(found, 1)]
                if len(rows) > 1000:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=columns)

    return short.unionByName(rows.where(over).mapInPandas(cut, f"{key} {kind}, {PIECES}"))
