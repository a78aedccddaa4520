"""CSV and JSON tables: explicit schemas in, ';'-joined lists and JSON maps out."""

from __future__ import annotations

import csv
import io
import json

import pandas as pd
from pyarrow.fs import FileSelector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.jsonmaps import map_text
from ..functions.taxonomy import folder_of_model, join_list
from ..schemas import RESULT
from ..session import ship


def read_csv(spark: SparkSession, path: str | list[str], columns: list[str]) -> DataFrame:
    """Text columns with doubled quotes and line ends inside quotes; '' comes back as null."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.csv(path, schema=schema, header=True, quote='"', escape='"', multiLine=True, enforceSchema=False)


def read_shards(spark: SparkSession, pattern: str, columns: list[str]) -> DataFrame:
    """All CSV shards of a pattern, by column name; none is an error, a missing
    column is null, an unknown one an error. Tasks read the headers; the shards
    of one header are one scan."""
    from ..operators.consolidate import open_fs

    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(fs_path)
    paths = sorted(s.getPath().toString() for s in (found or []))
    if not paths:
        raise FileNotFoundError(f"no shard matches {pattern}")

    def headers(batches):
        for b in batches:
            names = []
            for p in b["path"]:
                fs, base = open_fs(p)
                if fs.get_file_info(base).type.name == "Directory":
                    base = min((f.path for f in fs.get_file_info(FileSelector(base)) if f.base_name[:1] not in "._" and f.size), default=None)
                line = next(csv.reader(io.TextIOWrapper(fs.open_input_stream(base), "utf-8-sig", newline="")), []) if base else []
                names.append(line)
            yield b.assign(header=names)

    ship(spark)
    listed = spark.createDataFrame([(p,) for p in paths], "path string").mapInPandas(headers, "path string, header array<string>")
    groups: dict[tuple, list[str]] = {}
    for r in listed.collect():
        groups.setdefault(tuple(r["header"]), []).append(r["path"])
    out = None
    for header, same in sorted(groups.items()):
        if not header:
            continue
        if unknown := set(header) - set(columns):
            raise ValueError(f"{same[0]} has unknown columns: {', '.join(sorted(unknown))}")
        one = read_csv(spark, sorted(same), list(header))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        return spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    return out.select(*[F.col(c) if c in out.columns else F.lit(None).cast("string").alias(c) for c in columns])


def flat(rows: DataFrame) -> DataFrame:
    """Lists joined by ';', maps as JSON, dates as ISO text, null as ''."""
    out = []
    for f in rows.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ArrayType):
            c = join_list(c)
        elif isinstance(f.dataType, T.MapType):
            c = map_text(c)
        out.append(F.coalesce(c.cast("string"), F.lit("")).alias(f.name))
    return rows.select(*out)


def write_csv(rows: DataFrame, path: str, columns: list[str] | None = None, one_file: bool = False, mode: str = "overwrite") -> None:
    """CSV with a header; columns the rows lack are ''."""
    if columns is not None:
        rows = rows.select(*[F.col(c) if c in rows.columns else F.lit("").alias(c) for c in columns])
    out = flat(rows)
    (out.coalesce(1) if one_file else out).write.mode(mode).csv(path, header=True, quote='"', escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_results(results: DataFrame, folder: str, mode: str = "append") -> None:
    """Results as JSON, a folder per model."""
    results.withColumn("model_dir", F.replace("model", F.lit("/"), F.lit("__"))).write.mode(mode).partitionBy("model_dir").json(folder)


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def read_results(spark: SparkSession, folder: str, model: str) -> DataFrame:
    """One result per doi of the model, that of the last file; no folder gives no rows."""
    path = f"{folder}/model_dir={folder_of_model(model)}"
    if not exists(spark, path):
        return spark.createDataFrame([], RESULT)
    rows = spark.read.schema(RESULT).json(path).withColumn("_file", F.struct(F.col("_metadata.file_modification_time"), F.col("_metadata.file_path")))
    last = F.row_number().over(Window.partitionBy("doi").orderBy(F.desc("_file")))
    return rows.withColumn("_n", last).where("_n = 1").select(*RESULT.fieldNames())


def write_article_results(results: DataFrame, folder: str) -> DataFrame:
    """One indented JSON file per result on the shared file system, in a folder
    per model; (doi, file) of those written. A later result of a doi replaces the file."""
    from ..operators.consolidate import open_fs

    def dump(batches):
        fs, base = open_fs(folder)
        for b in batches:
            files = []
            for text, doi, model in zip(b["text"], b["doi"], b["model"]):
                at = f"{base}/{model.replace('/', '__')}"
                fs.create_dir(at, recursive=True)
                files.append(f"{doi.replace('/', '_')}.json")
                with fs.open_output_stream(f"{at}/{files[-1]}") as out:
                    out.write(json.dumps(json.loads(text), indent=2, ensure_ascii=False).encode())
            yield pd.DataFrame({"doi": b["doi"], "file": files})

    fields = F.struct("doi", "model", "status", "rows", "error")
    return results.select("doi", "model", F.to_json(fields).alias("text")).mapInPandas(dump, "doi string, file string")


def write_texts(articles: DataFrame, folder: str, ending: str = "txt") -> DataFrame:
    """One text file per article (doi, text) on the shared file system; (doi, file) of those written. Null texts are skipped."""
    from ..operators.consolidate import open_fs

    def dump(batches):
        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)
        for b in batches:
            b = b[b["text"].notna()]
            names = [f"{d.replace('/', '_')}.{ending}" for d in b["doi"]]
            for name, text in zip(names, b["text"]):
                with fs.open_output_stream(f"{base}/{name}") as out:
                    out.write(text.encode())
            yield b[["doi"]].assign(file=names)

    return articles.select("doi", "text").mapInPandas(dump, "doi string, file string")
