"""Spellings of one institution, linked.

A name is read as a kind (what the words University, Hospital and so on say, in
whatever order, abbreviation or misspelling), its distinguishing words (all
others but departments and countries), a given name, and a place that follows.
The distinguishing words of all names are linked by a pigeonhole segment join:
each is cut into k+1 segments, shifted substrings are looked up in the inverted
index of segments, and candidates are verified by banded edit distance with
swapped neighbours as one edit. A word joins the nearest word that more
spellings have, so two words aren't chained through a misspelling between
them; words whose institutions of one kind show different abbreviations in
brackets stay apart. Names mean one institution if their kinds and all their
distinguishing words do. Where one name stands with several places (campuses)
or given names, these tell institutions apart, else they don't count.

An abbreviation that stands alone is the institution beside whose name it
stands in brackets, else the only one whose initials it has, in any order,
before further letters of one of its words.

Null, empty and blank names link to nothing. Names in which no kind or no
distinguishing word is found link only to names that read the same without
case, accents and punctuation.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..operators.sampling import first_n
from ..session import settle

#: Edits (a swap is one) between spellings of a word of at least LONG_WORD
#: letters, and of a shorter one of at least SHORT_WORD; shorter ones are exact.
EDITS, SHORT_EDITS, LONG_WORD, SHORT_WORD = 2, 1, 8, 5
#: Edits that the segments stand for: a swap may fall on a boundary.
SEGMENT_EDITS = 3
#: Rows of the index with one segment, beyond which the segment is split.
HOT_SEGMENT = 2000
#: Abbreviations of one word's institutions, beyond which they tell nothing.
MAX_MARKS = 32
#: Pairs of one entity are made in blocks of this many spellings.
BLOCK = 2000

#: Words of institutions, their full form first; '' words say nothing of the kind.
WORDS = {
    "university": ["university", "universitat", "universite", "universidad", "universita", "universiteit", "univ", "uni", "u"],
    "state": ["state", "st"],
    "general": ["general", "genl", "gen"],
    "hospital": ["hospital", "hospit", "hosp", "clinic"],
    "medical": ["medical", "medicine", "med"],
    "college": ["college", "coll", "col"],
    "school": ["school", "sch"],
    "institute": ["institute", "institut", "instituto", "instit", "inst"],
    "technology": ["technology", "technological", "technol", "tech"],
    "mental": ["mental", "ment"],
    "health": ["health", "hlth"],
    "research": ["research", "rsch", "res"],
    "centre": ["centre", "center", "ctr", "cent"],
    "mind": ["mind"],
    "behaviour": ["behavioural", "behavioral", "behaviour", "behavior", "behav"],
    "science": ["science", "sciences", "sci"],
    "department": ["department", "dept", "division", "div", "faculty", "fac", "lab", "laboratory", "unit", "section"],
    "field": ["psychology", "psychological", "psychol", "psych", "psychiatry", "education", "cognition", "cognitive", "clinical", "brain", "neuroscience"],
    "": ["of", "the", "for", "and", "de", "der", "des", "di", "da", "la", "at", "in", "fur", "fuer", "o", "oe", "off", "fo", "amp", "pour"],
}
#: Countries as they follow a name, codes first.
CODES = ["usa", "us", "uk", "gb"]
COUNTRIES = [
    *CODES, "england", "scotland", "wales", "ireland", "northern ireland", "germany", "deutschland", "france", "spain", "italy", "norway", "sweden", "denmark", "finland", "netherlands",
    "belgium", "austria", "switzerland", "poland", "portugal", "greece", "turkey", "russia", "india", "china", "japan", "korea", "south korea", "kenya", "nigeria", "ghana", "egypt", "canada",
    "mexico", "brazil", "chile", "argentina", "peru", "australia", "new zealand", "south africa", "united states", "united states america", "united kingdom", "america",
]
#: Words that differ by few letters and never mean the same.
COMPASS = {a + b for a in ("north", "south", "east", "west", "northeast", "northwest", "southeast", "southwest") for b in ("", "ern")}
GIVEN = {
    "alexander": "alex sandy", "andrew": "andy drew", "anthony": "tony", "barbara": "barb", "benjamin": "ben", "catherine": "katherine cathy kate kathy katie kat kitty kay", "charles": "charlie chuck",
    "christopher": "chris", "daniel": "dan danny", "david": "dave", "deborah": "deb debbie", "dorothy": "dot dolly", "edward": "ed eddie ted ned teddy",
    "elizabeth": "liz lizzie beth betty eliza bess", "frances": "fran", "francis": "frank", "frederick": "fred", "george": "", "gregory": "greg", "helen": "nell",
    "henry": "harry hal", "isabella": "bella", "james": "jim jimmy", "jennifer": "jen jenny", "john": "jack johnny", "jonathan": "jon", "joseph": "joe",
    "lawrence": "larry", "leonard": "len", "margaret": "maggie meg peggy marge madge", "martha": "", "mary": "molly polly",
    "matthew": "matt", "michael": "mike mick", "nicholas": "nick", "patricia": "pat patty tricia", "patrick": "paddy", "peter": "pete", "philip": "phil",
    "rebecca": "becky", "richard": "rick dick rich ricky", "robert": "rob bob bobby robbie bert", "ronald": "ron", "samuel": "sam", "stephen": "steve",
    "susan": "sue", "theodora": "thea dora", "theodore": "", "thomas": "tom tommy", "timothy": "tim", "victoria": "vicky", "walter": "walt",
    "william": "will bill billy willy liam",
}

_SPELLED = {w: k for k, ws in WORDS.items() for w in ws}
_GIVEN = {n: full for full, short in GIVEN.items() for n in [full, *short.split()]} | {"theo": "t"}  # Theo may be either, as an initial
_LONG = [(w, k) for w, k in _SPELLED.items() if len(w) >= 4] + [(w, "given") for w in GIVEN if len(w) >= 5]
_LAND = set(COUNTRIES)


def edit_distance(a: str, b: str, most: int) -> int:
    """Edits from a to b, a swap of neighbours being one, within a band; most + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    far = most + 1
    before, row = None, [j if j <= most else far for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        new = [far] * (len(b) + 1)
        if i <= most:
            new[0] = i
        for j in range(max(1, i - most), min(len(b), i + most) + 1):
            y = b[j - 1]
            d = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new[j] = min(d, far)
        if min(new) >= far:
            return far
        before, row = row, new
    return row[-1]


def _bound(length: int) -> int:
    """Edits allowed in a word that the reader knows, of this length."""
    return 1 if length < 6 else 2 if length < 9 else 3


@lru_cache(maxsize=100_000)
def word_kind(word: str) -> tuple[str | None, str, bool]:
    """What a word says (a key of WORDS, 'given', or None for a distinguishing
    word), the known word it stands for, and whether it is spelled like that."""
    if word in _SPELLED:
        return _SPELLED[word], word, True
    if word in _GIVEN:
        return "given", _GIVEN[word], True
    if word in COMPASS:
        return None, word, True
    if len(word) < 4:
        near = [(k, w) for w, k in _SPELLED.items() if k and len(word) > 1 and 3 <= len(w) <= 4 and w[0] == word[0] and edit_distance(word, w, 1) <= 1]
        if near:
            return (*near[0], False)
    if len(word) < 5:
        stop = [w for w in WORDS[""] if len(word) > 1 and len(w) > 1 and abs(len(w) - len(word)) <= 1 and edit_distance(word, w, 1) <= 1]
        if stop:
            return "", stop[0], False
    if len(word) < 4:
        return None, word, True
    best = (99, None, word)
    for w, k in _LONG:
        most = _bound(len(w))
        if len(word) >= len(w) - most and abs(len(w) - len(word)) <= most:
            d = edit_distance(word, w, most)
            if d <= most and d < best[0]:
                best = (d, k, w)
    return best[1], best[2], False


def plain(text: str) -> str:
    """Without accents, case and entities."""
    flat = unicodedata.normalize("NFKD", html.unescape(html.unescape(text)))
    return "".join(c for c in flat if not unicodedata.combining(c)).replace("ß", "ss").replace("ø", "o").replace("ł", "l").lower()


def is_country(words: list[str]) -> bool:
    said = " ".join(w for w in words if _SPELLED.get(w) != "")
    return said in _LAND or len(said) >= 5 and any(len(c) >= 5 and edit_distance(said, c, 1) <= 1 for c in COUNTRIES)


def kind_of(said: set[str]) -> str:
    """The kind of institution that the words of a name say."""
    if {"university", "college"} <= said and not said & {"medical", "state", "hospital", "general"}:
        return "university college"
    for kind, any_of in (
        ("mental health institute", {"mental", "health"}),
        ("research centre", {"mind", "behaviour", "research", "centre"}),
        ("institute of technology", {"technology"}),
        ("hospital", {"hospital", "general"}),
        ("medical college", {"medical"}),
        ("state university", {"state"}),
        ("college", {"college"}),
        ("university", {"university"}),
        ("institute", {"institute"}),
        ("school", {"school"}),
    ):
        if said & any_of:
            return kind
    return ""


class Name(NamedTuple):
    """What a spelling says. places: words of each part that may be a place, with the part's number."""

    kind: str
    words: list[str]
    given: str
    places: list[str]
    initials: str
    mark: str


class Part(NamedTuple):
    said: set[str]
    words: list[str]
    given: list[str]
    initials: str


def read_name(text: str) -> Name:
    bare = text.strip()
    if re.fullmatch(r"[A-Z]{3,12}", bare) and bare.lower() not in CODES:
        return Name("abbreviation", [bare.lower()], "", [], "", "")
    flat = plain(text)
    shown = [b.strip().lower() for b in re.findall(r"\(([A-Z]{3,12})\)", text) if b.lower() not in CODES]
    split = [re.findall(r"[^\W_]+", re.sub(r"['’]s\b", "s", part)) for part in re.split(r"[,;()/]", flat)]
    split = [w for w in split if w and not is_country(w) and not (len(w) == 1 and w[0] in shown)]
    known = [[(w, *word_kind(w)) for w in words] for words in split]
    # a misspelled known word counts as known only beside a word that can be nothing else
    sure = any(k is None and len(w) > 1 for words in known for w, k, _, _ in words)
    given_count = any(k == "given" for words in known for _, k, _, exact in words if exact)
    parts: list[Part] = []
    for words in known:
        while len(words) > 1 and words[-1][0] in CODES:
            words = words[:-1]
        said, names, given, initials = set(), [], [], ""
        for w, k, full, exact in words:
            if len(w) == 1 and k is None and w.isalpha():
                given.append(w)
            elif k is None or not exact and not sure and not (k == "given" and given_count):
                names.append(w)
            elif k == "given":
                given.append(full)
            elif k:
                said.add(k)
            if k != "":
                initials += w[0]
        if said & {"field", "department"}:
            if not names or not kind_of(said - {"school", "centre", "mind", "science", "field", "department", "behaviour", "research"}):
                continue
        parts.append(Part(said - {"field", "department"}, names, given, initials))
    if not any(p.words for p in parts):  # a given name may be all that tells
        parts = [p._replace(words=[g for g in p.given if len(g) > 1], given=[]) for p in parts]
    main = next((p for p in parts if kind_of(p.said) and p.words), None) or next((p for p in parts if p.words), None)
    said = set() if main is None else main.said if kind_of(main.said) else set().union(*[p.said for p in parts])
    kind = kind_of(said)
    if main is None or not kind:
        return Name("", [" ".join(re.findall(r"[^\W_]+", flat))], "", [], "", "")
    given = next((g for p in parts for g in p.given), "")
    places = [f"{i} {w}" for i, p in enumerate(parts) if p is not main and not p.said for w in p.words]
    initials = "".join(sorted(main.initials if kind_of(main.said) else "".join(p.initials for p in parts if p is main or p.said or p.given)))
    mark = next((s for s in shown if fits(s, initials, main.words)), "")
    return Name(kind, sorted(set(main.words)), given, places, initials, mark)


def fits(mark: str, initials: str, words: list[str]) -> bool:
    """Whether an abbreviation is the initials, in any order, and then further letters of one word."""
    if "".join(sorted(mark[: len(initials)])) != initials:
        return False
    rest = mark[len(initials) :]

    def within(word: str) -> bool:
        letters = iter(word[1:])
        return all(c in letters for c in rest)

    return any(map(within, words))


NAME = "kind string, words array<string>, given string, places array<string>, initials string, mark string"


def read_names(values: DataFrame, column: str) -> DataFrame:
    """(value, kind, words, given, places, initials, mark): each distinct non-blank value once."""
    distinct = values.select(F.col(column).alias("value")).where(F.length(F.trim("value")) > 0).distinct()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(v, *read_name(v)) for v in b["value"]], columns=["value", *Name._fields])

    return distinct.mapInPandas(read, f"value string, {NAME}")


def _cuts(length: int) -> list[tuple[int, int]]:
    """Start and size of the segments of a word of this length; none is empty from SHORT_WORD letters on."""
    base, more = divmod(length, SEGMENT_EDITS + 1)
    out, at = [], 0
    for i in range(SEGMENT_EDITS + 1):
        size = base + (i >= SEGMENT_EDITS + 1 - more)
        out.append((at, size))
        at += size
    return out


def letter_mask(name: str) -> int:
    """A bit per letter that occurs: an edit changes at most two of them, a swap none."""
    mask = 0
    for c in name:
        mask |= 1 << (ord(c) % 61)
    return mask


def segments(words: DataFrame, probe: bool) -> DataFrame:
    """(key, word, forms, mask): the word's own segments, or the shifted
    substrings that a word within SEGMENT_EDITS edits could have as a segment."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for first in range(0, len(b), 500):
                rows = set()
                for s, forms in zip(b["word"][first : first + 500], b["forms"][first : first + 500]):
                    mask = letter_mask(s)
                    for length in range(max(SHORT_WORD, len(s) - EDITS), len(s) + EDITS + 1) if probe else [len(s)]:
                        for i, (at, size) in enumerate(_cuts(length)):
                            reach = SEGMENT_EDITS if probe else 0
                            for p in range(max(0, at - reach), min(len(s) - size, at + reach) + 1):
                                rows.add((f"{length}.{i}.{s[p : p + size]}", s, forms, mask))
                if rows:
                    yield pd.DataFrame(sorted(rows), columns=["key", "word", "forms", "mask"])

    return words.select("word", "forms").mapInPandas(cut, "key string, word string, forms bigint, mask bigint")


def near_words(words: DataFrame) -> DataFrame:
    """(word, other, forms, other_forms, edits): each word with those of more
    spellings within its edits. words: word, forms (spellings that have it).
    Words under SHORT_WORD letters and compass words look for none, though what
    is misspelled may find a compass word. A segment
    of many words is split on the index's side and looked up in each split; what
    the letters rule out is dropped as the index is read. Spark judges the cut
    substrings by the size of the words alone, a hundredth of theirs, so they
    must be kept from being broadcast."""
    joined = words.where(F.length("word") >= SHORT_WORD)
    index = settle(segments(joined, False), "index")
    hot = index.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / HOT_SEGMENT).cast("int").alias("splits")).where("splits > 1")
    split = lambda rows: rows.join(hot, "key", "left").withColumn("splits", F.coalesce("splits", F.lit(1)))
    left = split(segments(joined.where(~F.col("word").isin(sorted(COMPASS))), True)).withColumn("split", F.explode(F.sequence(F.lit(0), F.col("splits") - 1))).drop("splits")
    right = split(index).select("key", F.pmod(F.xxhash64("word"), F.col("splits")).cast("int").alias("split"), F.col("word").alias("other"), F.col("forms").alias("other_forms"), F.col("mask").alias("other_mask"))
    ranked = (
        left.hint("merge").join(right, ["key", "split"])
        .where("other_forms > forms or (other_forms = forms and other < word)")
        .where(F.bit_count(F.col("mask").bitwiseXOR(F.col("other_mask"))) <= 2 * EDITS)
        .select("word", "other", "forms", "other_forms").distinct()
        .where(F.levenshtein("word", "other", 2 * EDITS) >= 0)
    )

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            most = [EDITS if min(len(x), len(y)) >= LONG_WORD else SHORT_EDITS for x, y in zip(b["word"], b["other"])]
            d = [edit_distance(x, y, m) for x, y, m in zip(b["word"], b["other"], most)]
            yield b.assign(edits=d)[[x <= m for x, m in zip(d, most)]]

    return ranked.mapInPandas(verify, "word string, other string, forms bigint, other_forms bigint, edits int")


def settle_roots(parents: DataFrame) -> DataFrame:
    """(word, root) of (word, parent): pointers are doubled until none moves,
    which the job that doubles them counts."""
    now = settle(parents.select("word", F.col("parent").alias("root")), "roots")
    while True:
        up = now.select(F.col("word").alias("root"), F.col("root").alias("upper"))
        count = Observation()
        moved = now.join(up, "root", "left").select("word", F.coalesce("upper", "root").alias("to"), "root")
        now = settle(moved.observe(count, F.count_if(F.col("to") != F.col("root")).alias("moved")).select("word", F.col("to").alias("root")), "roots")
        if not count.get["moved"]:
            return now


def word_roots(named: DataFrame) -> DataFrame:
    """(word, root) of all words of names and places: misspellings have the root of what they stand for."""
    said = named.select("kind", "mark", F.explode(F.array_distinct(F.concat("words", F.transform("places", lambda p: F.substring_index(p, " ", -1))))).alias("word"), "words")
    forms = settle(said.groupBy("word").agg(F.count(F.lit(1)).alias("forms")), "forms")
    letters = F.array_join(F.array_sort(F.split("mark", "")), "")  # BUXY and UBXY are one abbreviation
    shown = said.where((F.col("mark") != "") & F.array_contains("words", F.col("word"))).select("word", F.concat_ws(":", "kind", letters).alias("mark")).distinct()
    marks = settle(first_n(shown, ["word"], ["mark"], MAX_MARKS + 1).groupBy("word").agg(F.collect_set("mark").alias("marks")).where(F.size("marks") <= MAX_MARKS), "marks")
    near = near_words(forms).join(marks, "word", "left").join(marks.select(F.col("word").alias("other"), F.col("marks").alias("other_marks")), "other", "left")
    kinds = lambda c: F.transform(c, lambda x: F.substring_index(x, ":", 1))
    apart = F.arrays_overlap(kinds("marks"), kinds("other_marks")) & ~F.arrays_overlap("marks", "other_marks")
    parent = near.where(~F.coalesce(apart, F.lit(False))).groupBy("word").agg(F.min_by("other", F.struct("edits", -F.col("other_forms"), "other")).alias("parent"))
    return settle_roots(forms.select("word").join(parent, "word", "left").select("word", F.coalesce("parent", "word").alias("parent")))


def _joined(words: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(words)), " ")


def named_entities(named: DataFrame) -> DataFrame:
    """(value, entity, words, initials, mark) of the names that have a kind and words."""
    roots = word_roots(named)
    said = F.concat(F.transform("words", lambda w: F.struct(F.lit(-1).alias("part"), w.alias("word"))), F.transform("places", lambda p: F.struct(F.substring_index(p, " ", 1).cast("int").alias("part"), F.substring_index(p, " ", -1).alias("word"))))
    rooted = (
        named.select("value", F.explode(said).alias("s")).select("value", "s.part", "s.word").join(roots, "word")
        .groupBy("value").agg(F.array_sort(F.collect_set(F.struct("part", "root"))).alias("r"))
    )
    own = F.transform(F.filter("r", lambda x: x["part"] == -1), lambda x: x["root"])
    rooted = rooted.withColumn("own", own)
    others = F.filter("r", lambda x: (x["part"] >= 0) & ~F.array_contains("own", x["root"]))
    first = F.transform(F.filter("others", lambda x: x["part"] == F.col("others")[0]["part"]), lambda x: x["root"])
    names = named.select("value", "kind", "given", "initials", "mark").join(rooted.withColumn("others", others).select("value", "own", F.coalesce(_joined(first), F.lit("")).alias("place")), "value")
    names = settle(names.withColumn("base", F.concat_ws(":", "kind", _joined(F.col("own")))), "names")
    # what tells apart: one row per base, place and given name is all that is looked at
    seen = names.groupBy("base", "place", "given").agg(F.count(F.lit(1)).alias("n"))
    campuses = seen.where("place <> ''").groupBy("base").agg((F.count_distinct("place") > 1).alias("campuses"))
    seen = settle(seen.join(campuses, "base", "left").withColumn("campus", F.when(F.col("campuses"), F.col("place")).otherwise("")), "seen")
    full = seen.where(F.length("given") > 1).select("base", "campus", "given").distinct()
    several = full.groupBy("base", "campus").agg((F.count(F.lit(1)) > 1).alias("several"))
    letters = full.groupBy("base", "campus", F.left("given", F.lit(1)).alias("letter")).agg(F.when(F.count(F.lit(1)) == 1, F.first("given")).alias("meant"))
    told = seen.withColumn("letter", F.left("given", F.lit(1))).join(several, ["base", "campus"], "left").join(letters, ["base", "campus", "letter"], "left")
    person = F.when(F.col("several"), F.when(F.length("given") == 1, F.coalesce("meant", "given")).otherwise(F.col("given"))).otherwise("")
    told = told.select("base", "place", "given", F.concat_ws(":", "base", "campus", person).alias("entity"))
    return names.join(told, ["base", "place", "given"]).select("value", "entity", F.col("own").alias("words"), "initials", "mark")


def abbreviated(alone: DataFrame, known: DataFrame) -> DataFrame:
    """(value, entity) of abbreviations (value, mark): that of the names beside
    which it stands in brackets, else of the only entity that it fits."""
    beside = known.where("mark <> ''").groupBy("mark", "entity").agg(F.count(F.lit(1)).alias("n")).groupBy("mark").agg(F.max_by("entity", F.struct("n", "entity")).alias("beside"))
    shown = alone.join(beside, "mark", "left")

    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(v, "".join(sorted(m[:n])) + "|" + m[n:]) for v, m in zip(b["value"], b["mark"]) for n in range(max(2, len(m) - 2), len(m) + 1)]
            yield pd.DataFrame(rows, columns=["value", "key"])

    def offered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = {(e, f"{i}|{''.join(c)}") for e, i, words in zip(b["entity"], b["initials"], b["words"]) for w in words for n in range(3) for c in combinations(w[1:], n)}
            if rows:
                yield pd.DataFrame(sorted(rows), columns=["entity", "key"])

    keys = shown.where("beside is null").select("value", "mark").mapInPandas(asked, "value string, key string")
    # not broadcast: it has many more rows than Spark's estimate, which is that of known
    index = known.select("entity", "initials", "words").distinct().mapInPandas(offered, "entity string, key string")
    only = keys.join(index.hint("merge"), "key").groupBy("value").agg(F.min("entity").alias("a"), F.max("entity").alias("b")).where("a = b").select("value", "a")
    return shown.join(only, "value", "left").select("value", F.coalesce("beside", "a", F.concat(F.lit("=:"), "mark")).alias("entity"))


def entities(values: DataFrame, column: str) -> DataFrame:
    """(value, entity): each distinct non-blank value with the entity that it names."""
    read = settle(read_names(values, column), "read")
    known = settle(named_entities(read.where("kind not in ('', 'abbreviation')")), "known")
    first = F.col("words")[0]
    alone = read.where("kind = ''").select("value", F.concat(F.lit("=:"), first).alias("entity"))
    short = abbreviated(read.where("kind = 'abbreviation'").select("value", first.alias("mark")), known)
    return known.select("value", "entity").unionByName(short).unionByName(alone)


def pairs(members: DataFrame) -> DataFrame:
    """(name_a, name_b): all pairs of values of one entity, the smaller first.
    A large entity is joined block by block, so no task gets all of it."""
    sizes = members.groupBy("entity").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).where("blocks > 0")
    sized = members.join(sizes, "entity")
    left = sized.select("entity", F.pmod(F.xxhash64("value"), F.col("blocks")).cast("int").alias("block"), F.col("value").alias("name_a"))
    right = sized.select("entity", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("value").alias("name_b"))
    return left.join(right, ["entity", "block"]).where("name_a < name_b").select("name_a", "name_b")
