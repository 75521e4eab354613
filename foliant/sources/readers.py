"""Reading the archive's files [A1-A15]. Schemas are given, never inferred; a bad line raises."""

from __future__ import annotations

import glob
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.sources.schema import RECORD


def _exists(path: str) -> None:
    local = path.removeprefix("file://")
    if "://" not in local and not glob.glob(local):
        raise FileNotFoundError(path)


def read_corpus(spark: SparkSession, path: str, schema=RECORD) -> DataFrame:
    """A corpus as JSON lines (``.jsonl``) or one JSON list (``.json``) [A1-A3]; another suffix is an error."""
    _exists(path)
    if path.endswith(".jsonl"):
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if path.endswith(".json"):
        whole = spark.read.text(path, wholetext=True)
        if whole.where(~F.ltrim("value").startswith("[")).limit(1).count():
            raise ValueError(f"{path} holds no list")
        return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", True).json(path)
    raise ValueError(f"neither .json nor .jsonl: {path}")


def read_record_folder(spark: SparkSession, path: str, schema=RECORD) -> DataFrame:
    """One JSON file a record under ``{document}/`` [A4], with ``file_name``; files ``*.page.json`` hold pages."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", True).json(os.path.join(path, "*", "*.json"))
    return df.withColumn("file_name", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))


def read_nodes(spark: SparkSession, path: str, *predicates) -> DataFrame:
    """Nodes without their vectors, filters pushed to the scan [A5]."""
    df = spark.read.parquet(path)
    df = df.drop("embedding")
    for p in predicates:
        df = df.where(p)
    return df


def read_coco(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """images, annotations and categories of one annotation file [A9]."""
    schema = ("images array<struct<id:long,file_name:string,width:int,height:int>>, categories array<struct<id:long,name:string,supercategory:string>>,"
              "annotations array<struct<id:long,image_id:long,category_id:long,bbox:array<double>,segmentation:array<array<double>>,area:double,iscrowd:int>>")
    doc = spark.read.schema(schema).option("multiLine", True).json(path)
    return tuple(doc.select(F.inline(c)) for c in ("images", "annotations", "categories"))


def read_form_words(spark: SparkSession, path: str) -> DataFrame:
    """Lines of handwriting forms in XML [A8]: line id, text (bars are blanks) and the bounds of all their parts."""
    line = "_id string, _text string, word array<struct<cmp:array<struct<_x:int,_y:int,_width:int,_height:int>>>>"
    df = spark.read.format("xml").option("rowTag", "line").schema(line).load(path)
    parts = F.flatten(F.transform(F.coalesce("word", F.array().cast("array<struct<cmp:array<struct<_x:int,_y:int,_width:int,_height:int>>>>")), lambda w: F.coalesce(w["cmp"], F.array().cast("array<struct<_x:int,_y:int,_width:int,_height:int>>"))))
    low = lambda side: F.array_min(F.transform("parts", lambda p: p[side]))
    high = lambda side, size: F.array_max(F.transform("parts", lambda p: p[side] + p[size]))
    return df.withColumn("parts", parts).where(F.size("parts") > 0).select(
        F.col("_id").alias("line_id"), F.replace("_text", F.lit("|"), F.lit(" ")).alias("text"), low("_x").alias("x0"), low("_y").alias("y0"), high("_x", "_width").alias("x1"), high("_y", "_height").alias("y1"))


def read_catalog(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Catalog files of a folder, each under its stem [A10]."""
    df = spark.read.schema(schema).option("multiLine", True).json(os.path.join(path, "*.json"))
    return df.withColumn("catalog", F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.json$", ""))


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """(epoch, path) of layout templates, in order [A11]."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").option("recursiveFileLookup", True).load(path).select("path")
    return df.withColumn("epoch", F.element_at(F.split("path", "/"), -2)).select("epoch", "path").orderBy("epoch", "path")


def list_inputs(spark: SparkSession, path: str, kinds: tuple[str, ...] = ("png", "jpg", "pdf")) -> DataFrame:
    """Distinct input files, sorted [A13]; with the year of a folder whose name is one [A12]."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(kinds) + "}").option("recursiveFileLookup", True).load(path)
    year = F.regexp_extract("path", r"/(\d{4})/[^/]*$", 1)
    return df.select("path", "length", F.nullif(year, F.lit("")).try_cast("int").alias("year")).distinct().orderBy("path")


def read_list(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON file that must be a list: questions, subsets, manifests [A14]."""
    if not path.endswith(".json"):
        raise ValueError(path)
    return read_corpus(spark, path, schema)


def find_data_roots(path: str, depth: int = 2) -> list[str]:
    """Folders up to ``depth`` levels down that have both images and labels [A15]."""
    found, level = [], [path]
    for _ in range(depth + 1):
        found += [p for p in level if all(os.path.isdir(os.path.join(p, x)) for x in ("images", "labels"))]
        level = [os.path.join(p, c) for p in level if os.path.isdir(p) for c in sorted(os.listdir(p)) if os.path.isdir(os.path.join(p, c))]
    return sorted(found)


def read_settings(path: str, env=os.environ) -> dict[str, str]:
    """KEY=value lines without quotes and comments; the environment wins [A16]."""
    out = {}
    if os.path.exists(path):
        with open(path) as f:
            for line in f:
                m = re.match(r"\s*(?:export\s+)?([A-Za-z_]\w*)\s*=\s*(.*?)\s*$", line)
                if m and not line.lstrip().startswith("#"):
                    out[m[1]] = m[2].strip("'\"")
    return {k: env.get(k, v) for k, v in out.items()}
