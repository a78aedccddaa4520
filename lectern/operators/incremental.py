"""Take up only what is new or changed, by Merkle trees over key ranges.

A sample's key is hashed to a 64-bit place; the places are cut into equal
ranges, the leaves. A leaf's digest folds the digests of its rows, a node's
digest folds those of its children. A publication is a folder with the output
of a run, the tree that it leaves behind and the row digests below the tree's
leaves, stored by key range; all become visible by one rename.

The next run builds the tree of what there is now, descends from both roots
only where digests differ, reads the saved row digests of the changed leaves'
folders only, and compares rows within those leaves. Rows of other leaves are
compared with nothing.

Nulls are values like any other, in keys and in compared columns. An empty
table has an empty tree. Repeated deliveries of one version change nothing:
of equal loading times the larger row id counts as current. Keys that vanish
are no rows to process and leave the saved tree with the next publication.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settle

FAN_BITS = 4
ROWS_PER_LEAF = 256
MAX_LEAF_BITS = 28
#: Leaves of one folder of saved row digests, in bits; at most MAX_PART_BITS bits of folders.
LEAVES_PER_PART, MAX_PART_BITS = 6, 12


def row_digest(columns: list[str]) -> Column:
    """SHA-256 over the named columns as stored, null apart from every text."""
    return F.unhex(F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256))


def key_place(keys: list[str]) -> Column:
    return F.xxhash64(F.lit(17), F.to_json(F.struct(*[F.col(f"`{c}`") for c in keys]), {"ignoreNullFields": "false"}))


def leaf_bits_for(rows: int) -> int:
    """Bits of the leaf number, a multiple of the fan-out's bits."""
    bits = math.log2(max(rows, 1) / ROWS_PER_LEAF) if rows > ROWS_PER_LEAF else 0
    return min(MAX_LEAF_BITS, FAN_BITS * max(1, math.ceil(bits / FAN_BITS)))


def part_bits_for(bits: int) -> int:
    return min(max(0, bits - LEAVES_PER_PART), MAX_PART_BITS)


def leaf_of(place: Column, bits: int) -> Column:
    return F.shiftrightunsigned(place, 64 - bits)


def leaves_of(rows: DataFrame, bits: int) -> DataFrame:
    """(node, d1, d2, n) of each leaf of rows (place bigint, digest binary). XOR
    and count merge in any order, so map-side combining leaves one row per leaf
    and task to shuffle."""
    return rows.groupBy(leaf_of(F.col("place"), bits).alias("node")).agg(
        F.bit_xor(F.xxhash64(F.lit(1), "place", "digest")).alias("d1"),
        F.bit_xor(F.xxhash64(F.lit(2), "place", "digest")).alias("d2"),
        F.count(F.lit(1)).alias("n"),
    )


def build_tree(leaves: DataFrame, bits: int) -> DataFrame:
    """(level, node, d1, d2, n) above settled leaves; level 0 is the root."""
    height = bits // FAN_BITS
    out = leaves.select(F.lit(height).alias("level"), "node", "d1", "d2", "n")
    below = leaves
    for at in range(height - 1, -1, -1):
        below = below.groupBy(F.shiftrightunsigned("node", FAN_BITS).alias("node")).agg(
            F.bit_xor(F.xxhash64(F.lit(3), "node", "d1", "n")).alias("d1"),
            F.bit_xor(F.xxhash64(F.lit(4), "node", "d2", "n")).alias("d2"),
            F.sum("n").alias("n"),
        )
        out = out.unionByName(below.select(F.lit(at).alias("level"), "node", "d1", "d2", "n"))
    return out


def changed_leaves(now: DataFrame, saved: DataFrame, bits: int) -> DataFrame:
    """(leaf) numbers whose digests differ, found by descending from the roots.
    A level is settled before the next, so that only children of nodes that
    differ are looked at; where the roots are equal nothing below is read."""
    open_nodes = None
    for at in range(bits // FAN_BITS + 1):
        a = now.where(F.col("level") == at).select("node", F.struct("d1", "d2", "n").alias("a"))
        b = saved.where(F.col("level") == at).select("node", F.struct("d1", "d2", "n").alias("b"))
        if open_nodes is not None:
            a, b = (
                x.withColumn("up", F.shiftrightunsigned("node", FAN_BITS)).join(open_nodes, "up", "left_semi").drop("up")
                for x in (a, b)
            )
        differ = a.join(b, "node", "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("node")
        open_nodes = settle(differ, "open").select(F.col("node").alias("up"))
    return open_nodes.select(F.col("up").alias("leaf"))


def _fs(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    return hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop.Path


def published(spark: SparkSession, root: str) -> list[str]:
    """Published versions, oldest first; staging folders of failed runs don't count."""
    fs, path = _fs(spark, root)
    if not fs.exists(path(root)):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path(root))]
    return [f"{root}/v{n:08d}" for n in sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())]


def _next_version(spark: SparkSession, root: str) -> str:
    """The name after the last one: it holds whether or not earlier versions were deleted."""
    versions = published(spark, root)
    return f"{root}/v{int(versions[-1].rsplit('/v', 1)[1]) + 1 if versions else 0:08d}"


def publish(output: DataFrame | None, rows: DataFrame, root: str, bits: int, leaves: DataFrame | None = None) -> str:
    """Publish a run: its output, and the tree and row digests of rows (place,
    digest), by one rename of their folder.

    A run that dies before the rename leaves a hidden folder and the old
    version in force, so the next run takes up the same rows again. Of two runs
    that publish the same version one fails.
    """
    spark = rows.sparkSession
    fs, path = _fs(spark, root)
    stage, target = f"{root}/.stage-{uuid.uuid4().hex}", _next_version(spark, root)
    if output is not None:
        output.write.parquet(f"{stage}/output")
    leaves = settle(leaves_of(rows, bits), "leaves") if leaves is None else leaves
    build_tree(leaves, bits).withColumn("bits", F.lit(bits)).write.partitionBy("level").parquet(f"{stage}/tree")
    part = F.shiftrightunsigned(leaf_of(F.col("place"), bits), bits - part_bits_for(bits))
    stored = rows.select("place", "digest", part.alias("part"))
    stored.repartition("part").sortWithinPartitions("part", "place").write.partitionBy("part").parquet(f"{stage}/rows")
    if fs.exists(path(target)) or not fs.rename(path(stage), path(target)):
        raise RuntimeError(f"another run has published {target}")
    return target


TREE = "level int, node bigint, d1 bigint, d2 bigint, n bigint, bits int"


def saved_tree(spark: SparkSession, version: str) -> DataFrame:
    return spark.read.schema(TREE).parquet(f"{version}/tree")


def saved_rows(spark: SparkSession, version: str, leaves: DataFrame, bits: int) -> DataFrame:
    """(place, digest) of the saved rows below the given leaves. Only the
    folders of their ranges are listed and read: there are at most
    2 ** MAX_PART_BITS of them, whatever the rows."""
    shift = bits - part_bits_for(bits)
    parts = [r["part"] for r in leaves.select(F.shiftrightunsigned("leaf", shift).alias("part")).distinct().collect()]
    stored = spark.read.schema("place bigint, digest binary, part bigint").parquet(f"{version}/rows").where(F.col("part").isin(parts))
    return stored.withColumn("leaf", leaf_of(F.col("place"), bits)).join(leaves, "leaf", "left_semi").select("place", "digest")


def changed_rows(rows: DataFrame, version: str | None, bits: int | None = None) -> tuple[DataFrame, int, DataFrame]:
    """(new and changed rows, leaf bits, leaves of now) of settled rows (place,
    digest, ...) against a published version; without one all rows are new."""
    spark = rows.sparkSession
    tree = saved_tree(spark, version) if version else None
    root = tree.where("level = 0").select("bits").first() if version else None
    if root is not None:
        bits = root["bits"]  # the saved ranges hold until a version is published with others
    bits = bits or leaf_bits_for(rows.count())
    leaves = settle(leaves_of(rows, bits), "leaves")
    if root is None:
        return rows, bits, leaves
    differ = changed_leaves(build_tree(leaves, bits), tree, bits)
    here = rows.withColumn("leaf", leaf_of(F.col("place"), bits)).join(differ, "leaf", "left_semi").drop("leaf")
    # the digest covers the key, so two keys of one place are told apart
    return here.join(saved_rows(spark, version, differ, bits), ["place", "digest"], "left_anti"), bits, leaves


def current(facts: DataFrame, keys: list[str], row_key: str = "row_id", loaded: str = "loaded_at") -> DataFrame:
    """Per key: place, and digest of the current version."""
    compared = [c for c in facts.columns if c not in (row_key, loaded)]
    rows = facts.select(*keys, F.struct(loaded, row_key).alias("age"), row_digest(compared).alias("digest"))
    return rows.groupBy(*keys).agg(F.max_by("digest", "age").alias("digest")).withColumn("place", key_place(keys))


def take_up(facts: DataFrame, root: str, keys: list[str], process: Callable[[DataFrame], DataFrame], row_key: str = "row_id", loaded: str = "loaded_at") -> str | None:
    """One run: what is new or changed since the last published version of root
    goes through process (keys to output), and output and tree are published
    together. Returns the published version, or None if there was nothing to do."""
    versions = published(facts.sparkSession, root)
    now = settle(current(facts, keys, row_key, loaded), "now")
    changed, bits, leaves = changed_rows(now, versions[-1] if versions else None)
    changed = settle(changed.select(*keys), "changed")
    if not changed.take(1):
        return None
    # more rows than leaves were made for: the next tree has as many as it needs
    wanted = leaf_bits_for(now.count())
    return publish(process(changed), now, root, max(bits, wanted), leaves if wanted <= bits else None)


def sample_versions(
    facts: DataFrame,
    runs: DataFrame,
    processed: DataFrame,
    keys: list[str],
    row_key: str = "row_id",
    loaded: str = "loaded_at",
) -> DataFrame:
    """Per key: place, digest of the current version, digest of the version
    that the latest successful attempt took up (null if none did)."""
    compared = [c for c in facts.columns if c not in (row_key, loaded)]
    ok = runs.where(F.col("status") == "ok").select(
        "run_id", "attempt", F.struct("started_at", "run_id", "attempt").alias("taken")
    )
    taken = processed.join(ok, ["run_id", "attempt"]).groupBy(row_key).agg(F.max("taken").alias("taken"))
    rows = facts.select(*keys, row_key, F.struct(loaded, row_key).alias("age"), row_digest(compared).alias("digest"))
    return (
        rows.join(taken, row_key, "left")
        .groupBy(*keys)
        .agg(F.max_by("digest", "age").alias("digest"), F.expr("max_by(digest, taken) FILTER (WHERE taken IS NOT NULL)").alias("saved_digest"))
        .withColumn("place", key_place(keys))
    )


def pending(facts: DataFrame, runs: DataFrame, processed: DataFrame, keys: list[str], root: str) -> DataFrame:
    """Keys that the next run must take up, given a log of runs instead of a
    published tree: what the log says was taken up is published under root as
    the version in force, and the facts are compared with that."""
    versions = settle(sample_versions(facts, runs, processed, keys), "versions")
    saved = versions.where("saved_digest is not null").select("place", F.col("saved_digest").alias("digest"))
    bits = leaf_bits_for(versions.count())
    version = publish(None, saved, root, bits)
    return changed_rows(versions.select(*keys, "place", "digest"), version, bits)[0].select(*keys)
