"""Many small files into few, by joining bytes.

Every record becomes one complete zstandard frame (with its content size and
checksum in the frame); frames are appended one after the other, so a store
file is itself a valid zstandard stream, and no record is parsed. Newline-
delimited files are joined as they are, with a line end put where one is
missing and a repeated header line or byte order mark left out. A manifest
names file, offset, length and checksum of each record; validation reads the
bytes back by the manifest.

Tasks append where they read, in a staging folder; the files that the finished
manifest names are then renamed into the folder data, so what a lost, repeated
or speculative attempt wrote is never seen there and goes with the staging
folder. Copies are left out before anything is packed: their ids are sent to
all tasks if there are at most MAX_COPIES of them, else packed records are
shuffled to the ids that stay.

Records without bytes (null or empty) are not stored. A null path is a name of
its own. Repeated deliveries of a record are stored once, under the smallest
id, and so are rows repeated with their id. An empty table gives an empty store.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import canonical_path
from ..session import scratch, settle

TARGET_BYTES = 128 << 20
#: Most ids of copies that are sent to every task (16 bytes each).
MAX_COPIES = 1_000_000
#: Packed size that files are planned with; other ratios give other sizes below the target.
RATIO = 3
_PLACES = "store_file string, offset bigint, length bigint, raw_length bigint, checksum bigint"
MANIFEST = f"file_id bigint, {_PLACES}"


def open_fs(uri: str):
    """File system and path of a URI, for Python code on any machine."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if ":" in uri.split("/")[0] else f"file://{uri}")


def signed64(digest: int) -> int:
    return digest - (1 << 64) if digest >= 1 << 63 else digest


def _records(files: DataFrame) -> DataFrame:
    """Rows with bytes, with the one way to write their path and the digest of their bytes."""
    return files.where(F.octet_length("xml_text") > 0).select(
        "file_id", canonical_path(F.col("xml_path")).alias("name"), F.sha2("xml_text", 256).alias("sha"), F.col("xml_text").cast("binary").alias("content")
    )


def distinct_records(files: DataFrame) -> DataFrame:
    """(name, sha, file_id) of the rows to store: of equal path and bytes the smallest id.

    Only ids and digests are shuffled, combined on the map side first, so a
    record that fills a third of the table costs one row per task.
    """
    return _records(files).groupBy("name", "sha").agg(F.min("file_id").alias("file_id"))


def fates(files: DataFrame, kept: DataFrame) -> DataFrame:
    """(file_id, again) of the ids that are not simply stored: copies, and (again)
    ids of several rows of which at least one stays."""
    ids = files.where(F.octet_length("xml_text") > 0).groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))
    stay = kept.groupBy("file_id").agg(F.count(F.lit(1)).alias("k"))
    return ids.join(stay, "file_id", "left").where("k is null or n > 1").select("file_id", F.col("k").isNotNull().alias("again"))


def pack(batches: Iterator[pd.DataFrame], level: int = 3) -> Iterator[pd.DataFrame]:
    """(file_id, piece, raw_length, checksum) of (file_id, content): one frame per record."""
    import xxhash
    import zstandard

    packer = zstandard.ZstdCompressor(level=level, write_content_size=True, write_checksum=True)
    for b in batches:
        raw = b["content"]
        yield pd.DataFrame(
            {
                "file_id": b["file_id"],
                "piece": [packer.compress(r) for r in raw],
                "raw_length": [len(r) for r in raw],
                "checksum": [signed64(xxhash.xxh3_64_intdigest(r)) for r in raw],
            }
        )


PIECES = "file_id bigint, piece binary, raw_length bigint, checksum bigint"


def append(batches: Iterator[pd.DataFrame], folder: str, target_bytes: int, ending: str, header: bytes = b"") -> Iterator[pd.DataFrame]:
    """Append a partition's pieces (key, piece, raw_length, checksum) to files of
    at most target_bytes, unless one piece is larger; gives the manifest's rows.
    A file's name holds the attempt, so no attempt writes into the file of another."""
    task = TaskContext.get()
    stem = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
    fs, base = open_fs(folder)
    fs.create_dir(base, recursive=True)
    out, number, offset = None, 0, 0
    try:
        for b in batches:
            key = b.columns[0]
            rows = []
            for k, piece, raw_length, checksum in zip(b[key], b["piece"], b["raw_length"], b["checksum"]):
                if out is None or offset > len(header) and offset + len(piece) > target_bytes:
                    if out is not None:
                        out.close()
                    number += 1
                    out = fs.open_output_stream(f"{base}/{stem}-{number:04d}.{ending}", compression=None)
                    out.write(header)
                    offset = len(header)
                out.write(piece)
                rows.append((k, f"{stem}-{number:04d}.{ending}", offset, len(piece), raw_length, checksum))
                offset += len(piece)
            yield pd.DataFrame(rows, columns=[key, "store_file", "offset", "length", "raw_length", "checksum"])
    finally:
        if out is not None:
            out.close()


def commit(manifest: DataFrame, folder: str) -> None:
    """Rename the files that the manifest names from the staging folder to data,
    in tasks that may be repeated, and delete the rest."""

    def move(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow.fs import FileType

        fs, base = open_fs(folder)
        fs.create_dir(f"{base}/data", recursive=True)
        for b in batches:
            for name in b["store_file"]:
                if fs.get_file_info(f"{base}/.stage/{name}").type != FileType.NotFound:
                    fs.move(f"{base}/.stage/{name}", f"{base}/data/{name}")
                elif fs.get_file_info(f"{base}/data/{name}").type == FileType.NotFound:
                    raise FileNotFoundError(f"{name} is in the manifest but was not written")
            yield b

    manifest.select("store_file").distinct().mapInPandas(move, "store_file string").count()
    fs, base = open_fs(folder)
    fs.create_dir(f"{base}/.stage", recursive=True)
    fs.delete_dir(f"{base}/.stage")


def validated(manifest: DataFrame, folder: str, packed: bool = True, start: int = 0) -> DataFrame:
    """The manifest's rows, each read back by its byte range; a wrong length or
    checksum, or a byte of a store file that no row covers, ends the job.
    packed: pieces are frames of raw_length bytes whose checksum is the raw
    bytes'; else the checksum is the piece's. start: bytes of a header."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash
        import zstandard

        fs, base = open_fs(folder)
        unpack, name, source, place = zstandard.ZstdDecompressor(), None, None, 0
        for b in batches:
            for x in b.itertuples(index=False):
                if x.store_file != name:
                    if source is not None and source.read(1):
                        raise ValueError(f"{name} is longer than its manifest")
                    name, place = x.store_file, start
                    source = fs.open_input_stream(f"{base}/{name}", compression=None)
                    source.read(start)
                if x.offset != place:
                    raise ValueError(f"{name}: a record begins at {x.offset}, not at {place}")
                piece = source.read(x.length)
                raw = unpack.decompress(piece) if packed else piece
                if len(piece) != x.length or packed and len(raw) != x.raw_length or signed64(xxhash.xxh3_64_intdigest(raw)) != x.checksum:
                    raise ValueError(f"{name}: the record at {x.offset} isn't what was stored")
                place += x.length
            yield b
        if source is not None and source.read(1):
            raise ValueError(f"{name} is longer than its manifest")

    return (
        manifest.repartition("store_file").sortWithinPartitions("store_file", "offset").mapInPandas(read, manifest.schema)
    )


def consolidate(files: DataFrame, folder: str | None = None, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """Store each record of files (file_id, xml_path, xml_text) once; returns the
    validated manifest. Records are packed and appended by the tasks that read
    them; only ids and digests are shuffled."""
    spark = files.sparkSession
    folder = folder or scratch(spark, "store")
    total = files.agg(F.sum(F.octet_length("xml_text")).alias("n")).first()["n"] or 0
    bins = max(1, math.ceil(total / RATIO / target_bytes))
    kept = settle(distinct_records(files), "kept")
    fate = settle(fates(files, kept), "fates")
    n, again = fate.agg(F.count(F.lit(1)), F.count_if("again")).first()
    records = _records(files)
    stage = f"{folder}/.stage"
    if n <= MAX_COPIES:
        rows = records.join(F.broadcast(fate), "file_id", "left_anti").select("file_id", "content")
        if again:
            rows = rows.unionByName(_told_apart(records, fate, kept).select("file_id", "content"))
        manifest = rows.coalesce(bins).mapInPandas(lambda b: append(pack(b), stage, target_bytes, "zst"), MANIFEST)
    else:
        rows = records.select("file_id", "content").mapInPandas(pack, PIECES)
        single = fate.select("file_id").repartition(bins, "file_id").hint("shuffle_hash")
        pieces = rows.repartition(bins, "file_id").join(single, "file_id", "left_anti")
        if again:
            pieces = pieces.unionByName(_told_apart(records, fate, kept).select("file_id", "content").mapInPandas(pack, PIECES))
        manifest = pieces.mapInPandas(lambda b: append(b, stage, target_bytes, "zst"), MANIFEST)
    manifest = settle(manifest, "manifest")
    commit(manifest, folder)
    return validated(manifest, f"{folder}/data")


def _told_apart(records: DataFrame, fate: DataFrame, kept: DataFrame) -> DataFrame:
    """Of the rows whose id has several, each record that stays once."""
    rows = records.join(fate.where("again"), "file_id", "left_semi").join(kept.withColumnsRenamed({"name": "_n", "sha": "_s", "file_id": "_i"}), F.expr("file_id = _i and sha = _s and name <=> _n"), "left_semi")
    return rows.dropDuplicates(["file_id", "name", "sha"])


def join_small_files(files: DataFrame, folder: str, kind: str, target_bytes: int = TARGET_BYTES, header: bytes = b"") -> DataFrame:
    """Join whole files (path string, content binary), as of the binaryFile source.

    kind 'lines': newline-delimited; 'zstd': complete frames. header: a first
    line that each file repeats and that is kept once per store file. Returns
    (path, store_file, offset, length, raw_length, checksum), validated. Empty
    files vanish; a zstd file whose frames aren't complete ends the job.
    """

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash
        import zstandard

        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"]):
                content = bytes(content or b"")
                raw = len(content)
                if kind == "lines":
                    content = content.removeprefix(b"\xef\xbb\xbf")
                    content = content.removeprefix(header)
                    if content and not content.endswith(b"\n"):
                        content += b"\n"
                elif content:
                    rest = content
                    while rest:
                        step = zstandard.ZstdDecompressor().decompressobj()
                        step.decompress(rest)
                        if not step.eof:
                            raise ValueError(f"{path} ends within a frame")
                        rest = step.unused_data
                if content:
                    rows.append((path, content, raw, signed64(xxhash.xxh3_64_intdigest(content))))
            yield pd.DataFrame(rows, columns=["path", "piece", "raw_length", "checksum"])

    ending = "zst" if kind == "zstd" else "txt"
    total = files.agg(F.sum(F.length("content")).alias("n")).first()["n"] or 0
    bins = max(1, math.ceil(total / target_bytes))
    manifest = settle(
        files.select("path", "content").coalesce(bins).mapInPandas(lambda b: append(pieces(b), f"{folder}/.stage", target_bytes, ending, header), f"path string, {_PLACES}"), "manifest"
    )
    commit(manifest, folder)
    return validated(manifest, f"{folder}/data", packed=False, start=len(header))
