"""Byte-level BPE of whole corpora by higher-order functions.

Texts are cut into words by the vocabulary's pattern; each distinct word of the
corpus is encoded once: its bytes are the first pieces, and a fold over them
merges the pair of lowest rank, leftmost first, until no pair has a rank. Ranks
come from a literal map in the plan, cut into small maps by CRC so that a
lookup doesn't scan the vocabulary. The words that occur in most texts (at most
FREQUENT of them) become a literal map too and are replaced in place; only texts
that hold others are shuffled, and those words joined, none of them frequent. Decoding looks up each
id's bytes in a literal array and concatenates them.

A null text has the ids null_ids, an empty one empty_ids (both [] unless given).
The fold is quadratic in a word's length, so words over LONG_WORD bytes merge
in an Arrow function by a heap, in the same order.
"""

from __future__ import annotations

import base64
import heapq
import json
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle

DEFAULT_FOLDER = "/opt/tokenizers"
BYTE_BPE = "byte_bpe_50k.tiktoken"
#: Fixed value: the vocabulary's pattern of words; white space and classes by Unicode.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BUCKETS, FREQUENT, LONG_WORD = 4096, 16_384, 2_000
#: Bytes of the literal of frequent words in all, and of one word in it.
LITERAL_BYTES, LITERAL_WORD = 4 << 20, 64 << 10
NO_RANK = 2**31 - 1


def load_ranks(folder: str = DEFAULT_FOLDER, name: str = BYTE_BPE) -> dict[bytes, int]:
    """Rank, which is the id, of each piece of bytes."""
    with open(f"{folder}/{name}", "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _buckets(entries: dict[str, object]) -> str:
    maps: list[dict] = [{} for _ in range(BUCKETS)]
    for key, value in entries.items():
        maps[zlib.crc32(key.encode()) % BUCKETS][key] = value
    return json.dumps(maps, ensure_ascii=False)


def _in(buckets: Column, key: Column) -> Column:
    return F.try_element_at(F.get(buckets, F.pmod(F.crc32(key.cast("binary")), F.lit(BUCKETS)).cast("int")), key)


def rank_map(ranks: dict[bytes, int]) -> Column:
    """The vocabulary as a literal, pieces in hexadecimal."""
    return F.from_json(F.lit(_buckets({p.hex(): r for p, r in ranks.items()})), "array<map<string,int>>")


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold_merges(word: Column, ranks: Column) -> Column:
    """Ids of one word. The literal stands in the plan once."""
    return _let(ranks, lambda r: _fold(word, r))


def _fold(word: Column, ranks: Column) -> Column:
    rank = lambda a, b: F.coalesce(_in(ranks, F.concat(a, b)), F.lit(NO_RANK))
    code = F.lower(F.hex(F.encode(word, "UTF-8")))
    count = (F.length(code) / 2).cast("int")
    first = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substr(code, i * 2 + 1, F.lit(2)))
    start = _let(
        first,
        lambda p: F.struct(
            p.alias("p"),
            F.when(F.size(p) > 1, F.transform(F.sequence(F.lit(0), F.size(p) - 2), lambda i: rank(F.get(p, i), F.get(p, i + 1))))
            .otherwise(F.array().cast("array<int>"))
            .alias("r"),
        ),
    )

    def merged(s: Column, at: Column) -> Column:
        p, r, n = s["p"], s["r"], F.size(s["p"])
        whole = F.concat(F.get(p, at - 1), F.get(p, at))
        none = F.array().cast("array<int>")
        before = F.when(at > 1, F.concat(F.slice(r, F.lit(1), at - 2), F.array(rank(F.get(p, at - 2), whole)))).otherwise(none)
        behind = F.when(at + 1 < n, F.concat(F.array(rank(whole, F.get(p, at + 1))), F.slice(r, at + 2, n))).otherwise(none)
        return F.struct(
            F.concat(F.slice(p, F.lit(1), at - 1), F.array(whole), F.slice(p, at + 2, n)).alias("p"), F.concat(before, behind).alias("r")
        )

    def step(s: Column, _: Column) -> Column:
        return _let(
            F.coalesce(F.array_min(s["r"]), F.lit(NO_RANK)),
            lambda low: F.when(low == NO_RANK, s).otherwise(_let(F.array_position(s["r"], low).cast("int"), lambda at: merged(s, at))),
        )

    steps = F.when(count > 1, F.sequence(F.lit(1), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, start, step, lambda s: F.transform(s["p"], lambda x: _in(ranks, x)))


def heap_merges(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word by a heap: lowest rank first, leftmost among equals."""
    n = len(word)
    end, prev, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = []

    def push(i: int) -> None:
        j = end[i]
        if j < n and (r := ranks.get(word[i : end[j]])) is not None:
            heapq.heappush(heap, (r, i, end[j]))

    for i in range(n - 1):
        push(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != stop or not alive[end[i]]:
            continue
        alive[end[i]] = False
        end[i] = stop
        if stop < n:
            prev[stop] = i
        push(i)
        if prev[i] >= 0:
            push(prev[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?U)({PATTERN})"), F.lit(1))


def encode_words(words: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """words (word, ...) with a column ids."""
    short = F.octet_length("word") <= LONG_WORD
    folded = words.where(short).withColumn("ids", fold_merges(F.col("word"), rank_map(ranks)))

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(ids=[heap_merges(w.encode(), ranks) for w in b["word"]])

    schema = words.schema.simpleString()[len("struct<") : -1]
    return folded.unionByName(words.where(~short).mapInPandas(merge, f"{schema},ids:array<int>".replace(":", " ").replace(",", ", ")))


def frequent_words(words: DataFrame) -> dict[str, list[int]]:
    """The words that occur in most texts, as many as the literal may hold. A
    long one (a rule, an address in every text) counts like any other, so that
    none that is frequent becomes a hot key of the join."""
    size = F.octet_length("word") + 4 * F.size("ids")
    top = words.where(size <= LITERAL_WORD).orderBy(F.desc("n"), "word").limit(FREQUENT)
    upto = Window.orderBy(F.desc("n"), "word").rowsBetween(Window.unboundedPreceding, 0)  # of FREQUENT rows at most
    return {r["word"]: r["ids"] for r in top.withColumn("_upto", F.sum(size).over(upto)).where(F.col("_upto") <= LITERAL_BYTES).select("word", "ids").collect()}


def encode(texts: DataFrame, key: str, column: str, ranks: dict[bytes, int], empty_ids: tuple[int, ...] = (), null_ids: tuple[int, ...] = (), keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, keep, ids array<int>) of every row; keep: other columns that come along."""
    along = [F.col(c).alias(f"_k_{c}") for c in keep]
    kept = [f"_k_{c}" for c in keep]
    worded = texts.select(F.col(key), *along, F.col(column).alias("_text"), words_of(F.col(column)).alias("_words"))
    counts = worded.select(F.explode(F.array_distinct("_words")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    partitions = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = settle(encode_words(settle(counts, "words").repartition(partitions), ranks), "encoded")
    frequent = F.from_json(F.lit(_buckets(frequent_words(words))), "array<map<string,array<int>>>")
    near = worded.withColumn("_ids", _let(frequent, lambda known: F.transform("_words", lambda w: _in(known, w))))
    fixed = lambda x: F.array(*[F.lit(i) for i in x]).cast("array<int>")
    near = settle(
        near.select(
            key,
            *kept,
            F.when(F.col("_text").isNull(), F.array(fixed(null_ids))).when(F.col("_text") == "", F.array(fixed(empty_ids))).otherwise(F.col("_ids")).alias("_ids"),
            F.zip_with("_words", "_ids", lambda w, i: F.when(i.isNull(), w)).alias("_words"),
        ),
        "near",
    )
    whole = F.forall("_ids", lambda i: i.isNotNull())
    part = near.where(~whole)
    rare = (
        part.select(key, F.explode(F.array_distinct(F.array_compact("_words"))).alias("word"))
        .join(words.select("word", "ids"), "word")
        .groupBy(key)
        .agg(F.map_from_entries(F.collect_set(F.struct("word", "ids"))).alias("_rare"))
    )
    filled = part.join(rare.withColumnRenamed(key, "_key"), F.col(key).eqNullSafe(F.col("_key")), "left")
    ids = F.flatten(F.zip_with("_words", "_ids", lambda w, i: F.coalesce(i, F.try_element_at("_rare", w))))
    named = [F.col(k).alias(c) for k, c in zip(kept, keep)]
    return near.where(whole).select(key, *named, F.flatten("_ids").alias("ids")).unionByName(filled.select(key, *named, ids.alias("ids")))


def decode(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The text of ids; ids without bytes, such as those of empty texts, give nothing."""
    pieces = [""] * (max(ranks.values()) + 1)
    for p, r in ranks.items():
        pieces[r] = p.hex()
    table = F.from_json(F.lit(json.dumps(pieces)), "array<string>")
    return F.decode(F.unhex(F.array_join(_let(table, lambda t: F.transform(ids, lambda i: F.get(t, i))), "")), "UTF-8")
