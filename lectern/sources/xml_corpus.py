"""A folder of article files."""

from __future__ import annotations

import pandas as pd
from pyarrow.fs import FileSelector, FileType
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import canonical_path
from ..operators.consolidate import open_fs
from ..session import ship


class CorpusNotFoundError(FileNotFoundError):
    """The folder is none, or holds no XML file."""


def ensure_corpus(spark: SparkSession, folder: str) -> None:
    """Look at the folder until a first XML file is found."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(path) and fs.getFileStatus(path).isDirectory():
        listing = fs.listStatusIterator(path)
        while listing.hasNext():
            if listing.next().getPath().getName().endswith(".xml"):
                return
    raise CorpusNotFoundError(f"{folder} is no folder with XML files")


def local_name(path: Column) -> Column:
    """A plain path for a local file, else the URI as it is."""
    return F.when(path.startswith("file:"), canonical_path(path)).otherwise(path)


def list_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """(xml_path, n_bytes) of the folder's XML files, subfolders left out,
    without reading the files; in no order. One task lists the folder (a flat
    folder's listing is one request after another) and hands its entries on;
    files without bytes are files too."""
    ensure_corpus(spark, folder)

    def look(batches):
        for b in batches:
            for uri in b["folder"]:
                fs, base = open_fs(uri)
                prefix = "" if uri.startswith("file:") else uri[: len(uri) - len(base)] if uri.endswith(base) else ""
                found = [(prefix + f.path, f.size) for f in fs.get_file_info(FileSelector(base)) if f.base_name.endswith(".xml") and f.type == FileType.File]
                for i in range(0, len(found), 10_000):
                    yield pd.DataFrame(found[i : i + 10_000], columns=["xml_path", "n_bytes"])

    ship(spark)
    return spark.createDataFrame([(folder.rstrip("/"),)], "folder string").coalesce(1).mapInPandas(look, "xml_path string, n_bytes bigint")


def read_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """(xml_path, xml_text) of the folder's XML files; the paths are spread over
    the cluster, and tasks read the files."""
    spread = list_corpus(spark, folder).select("xml_path").repartition(8 * spark.sparkContext.defaultParallelism)
    return read_files(spread)


def corpus_size(spark: SparkSession, folder: str) -> int:
    return list_corpus(spark, folder).count()


def read_files(rows: DataFrame, column: str = "xml_path") -> DataFrame:
    """rows with the text of the file that each names, in a column xml_text:
    tasks read the files, however many there are. A null path, a missing file
    and one that isn't UTF-8 give null."""

    def read(batches):
        for b in batches:
            texts = []
            for p in b[column]:
                try:
                    fs, base = open_fs(p)
                    with fs.open_input_stream(base, compression=None) as f:
                        texts.append(f.read().decode())
                except (OSError, ValueError, AttributeError):
                    texts.append(None)
            yield b.assign(xml_text=pd.Series(texts, index=b.index, dtype=object))

    ship(rows.sparkSession)
    rows = rows.drop("xml_text")
    return rows.mapInPandas(read, T.StructType([*rows.schema, T.StructField("xml_text", T.StringType())]))


def present(rows: DataFrame, column: str = "xml_path") -> DataFrame:
    """The rows whose file exists, looked up by the tasks."""

    def look(batches):
        for b in batches:
            kept = []
            for p in b[column]:
                try:
                    fs, base = open_fs(p)
                    kept.append(fs.get_file_info(base).type.name == "File")
                except (OSError, ValueError, AttributeError):
                    kept.append(False)
            yield b[pd.Series(kept, index=b.index, dtype=bool)]

    ship(rows.sparkSession)
    return rows.mapInPandas(look, rows.schema)
