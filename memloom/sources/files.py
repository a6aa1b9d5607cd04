"""Folders of text as DataFrames, tables as Parquet, and configuration."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.functions.lexicon import CHAT_FILES, OTHER_READABLE_FILES, PROSE_FILES, SKIPPED_FOLDERS


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def outside_skipped(path: Column) -> Column:
    parts = F.split(path, "/")
    return ~F.arrays_overlap(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(*map(F.lit, SKIPPED_FOLDERS)))


def text_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of every file below a folder, the whole text in a row; folders of no interest are left out."""
    found = spark.read.option("recursiveFileLookup", True).text(folder, wholetext=True)
    path = F.regexp_replace(F.url_decode(F.col("_metadata.file_path")), "^file:/+", "/")
    return found.select(path.alias("path"), F.col("value").alias("content")).where(outside_skipped(F.col("path")))


def chat_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files that may be chat exports."""
    path = F.col("path")
    return text_files(spark, folder).where(extension(path).isin(CHAT_FILES) & ~F.lower(path).endswith(".meta.json"))


def list_chat_files(spark: SparkSession, folder: str, most: int = 50) -> tuple[int, list[str], bool]:
    """How many there are, the first paths, and whether there are more. Only paths are read."""
    paths = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(F.regexp_replace("path", "^file:/+", "/").alias("path"))
    path = F.col("path")
    found = paths.where(outside_skipped(path) & extension(path).isin(CHAT_FILES) & ~F.lower(path).endswith(".meta.json"))
    n = found.count()
    return n, [r["path"] for r in found.orderBy("path").limit(most).collect()], n > most


def detection_files(spark: SparkSession, folder: str, most: int = 10, most_chars: int = 5000) -> DataFrame:
    """(path, text) of files to find entities in: prose alone if there are three such files, else all readable ones."""
    found = text_files(spark, folder).withColumn("e", extension(F.col("path")))
    prose, other = found.where(F.col("e").isin(PROSE_FILES)), found.where(F.col("e").isin(OTHER_READABLE_FILES))
    some = prose if prose.limit(3).count() >= 3 else prose.unionByName(other)
    rank = F.when(F.col("e").isin(PROSE_FILES), 0).otherwise(1)
    return some.orderBy(rank, "path").limit(most).select("path", F.substring("content", 1, most_chars).alias("text"))


def save_table(df: DataFrame, path: str) -> None:
    """Append, as all stores here only grow; readers take the latest version of a key."""
    df.write.mode("append").parquet(path)


def load_table(spark: SparkSession, path: str, empty: str) -> DataFrame:
    """A table, or an empty one of the given schema where nothing was saved yet."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.read.parquet(path)
    return spark.createDataFrame([], empty)


EMPTY_REGISTRY = {"version": 1, "mode": "personal", "people": {}, "projects": [], "ambiguous_flags": [], "wiki_cache": {}}


def load_registry(path: str | Path) -> dict:
    """A registry file; one that is missing or malformed is an empty registry."""
    try:
        found = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return dict(EMPTY_REGISTRY)
    return EMPTY_REGISTRY | found if isinstance(found, dict) else dict(EMPTY_REGISTRY)


def save_registry(path: str | Path, registry: dict) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(registry, indent=2, ensure_ascii=False), encoding="utf-8")


DEFAULTS = {"collection": "mem_drawers", "metric": "cosine"}
CONFIG_FOLDER = ".memloom"


def load_config(start: str | Path = ".", env: dict[str, str] | None = None, home: str | Path | None = None) -> dict:
    """Defaults, then the home folder's config.json, then that of the nearest folder upwards, then MEMLOOM_ variables."""
    env = dict(os.environ) if env is None else env
    folders = [Path(home) if home else Path.home()]
    folders += [p for p in [*reversed(Path(start).resolve().parents), Path(start).resolve()] if (p / CONFIG_FOLDER).is_dir()][-1:]
    out = dict(DEFAULTS)
    for folder in folders:
        try:
            found = json.loads((folder / CONFIG_FOLDER / "config.json").read_text(encoding="utf-8"))
        except (OSError, ValueError):
            continue
        if isinstance(found, dict):
            out |= found
    return out | {k.removeprefix("MEMLOOM_").lower(): v for k, v in env.items() if k.startswith("MEMLOOM_")}
