"""Writing records, indexes and reports [B1-B12]. Every writer replaces its target as a whole, so a repeated run leaves the same."""

from __future__ import annotations

import json
import os
import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from foliant.operators.archive import upsert_latest


def write_records(df: DataFrame, path: str, fmt: str = "parquet") -> int:
    """Records by document [B1]; returns how many. One document's rows go to one file, whatever its size is split by Spark."""
    df.write.mode("overwrite").partitionBy("document_id").format(fmt).save(path)
    return df.sparkSession.read.format(fmt).schema(df.schema).load(path).count()


def record_file_names(df: DataFrame) -> DataFrame:
    """``file_name`` of the one-file-a-record layout [B1]."""
    return df.withColumn("file_name", F.concat("page_id", F.lit("."), F.when(F.col("unit_type") == "page", "page").otherwise(F.coalesce("region_id", F.lit("region"))), F.lit(".json")))


def upsert(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``existing`` with rows of ``new`` in place of those of the same key [B2]; a later duplicate in ``new`` wins by its ``seq`` column."""
    old = existing.join(new.select(key).distinct(), key, "left_anti")
    return old.unionByName(upsert_latest(new, key, "seq").drop("seq"), allowMissingColumns=True)


def write_corpus(df: DataFrame, path: str) -> DataFrame:
    """JSON lines of a corpus [B3]; returns counts by unit."""
    df.write.mode("overwrite").json(path)
    return df.groupBy("unit_type").agg(F.count("*").alias("n"))


def write_nodes(df: DataFrame, path: str, vector: str = "embedding") -> None:
    """The index: nodes with their vectors [B4], hashed into 64 buckets of ids so a lookup by id reads one."""
    df.where(F.col(vector).isNotNull()).withColumn("bucket", F.pmod(F.xxhash64("node_id"), F.lit(64))).write.mode("overwrite").partitionBy("bucket").parquet(path)


def _whole(df: DataFrame, max_rows: int) -> list:
    """All rows; a table of more than ``max_rows`` is refused rather than cut."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"a report has at most {max_rows} rows; write a larger table with write_csv or write_records")
    return rows


def write_report(df: DataFrame, path: str) -> None:
    """An aggregate of known small size as one JSON object a row [B5]; ValueError beyond 100,000 rows."""
    rows = [json.loads(r[0]) for r in _whole(df.select(F.to_json(F.struct("*"))), 100_000)]
    tmp = path + ".tmp"
    with open(tmp, "w", encoding="utf-8") as f:
        json.dump(rows, f, ensure_ascii=False, indent=2)
    os.replace(tmp, path)  # readers see the old report or the new one, never a half [B9]


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """CSV with its columns in the given order [B6]."""
    df.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def text_report(df: DataFrame, title: str) -> str:
    """A plain text table of a small aggregate [B7]; ValueError beyond 10,000 rows."""
    rows = _whole(df, 10_000)
    lines = [title, "-" * len(title), *["  ".join(f"{k}={r[k]}" for k in df.columns) for r in rows]]
    return "\n".join(lines) + "\n"


def class_coverage(regions: DataFrame, template: str = "template", kind: str = "type") -> DataFrame:
    """How many templates have a region of each type [B8, E23]."""
    return regions.groupBy(kind).agg(F.countDistinct(template).alias("n_templates"))


def zip_sources(df: DataFrame, path_column: str, name_column: str, out: str) -> int:
    """Files of distinct sources in one archive [B10]; the file list, not the files, comes to the driver."""
    n = 0
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for r in df.select(path_column, name_column).dropDuplicates([name_column]).orderBy(name_column).toLocalIterator():
            z.write(r[0], r[1])
            n += 1
    return n


def fingerprint(df: DataFrame, column: str) -> str:
    """A name for an exact set of sources, whatever their order [B11]; null for none. Sums of hashes, so nothing is gathered."""
    r = df.select(column).distinct().agg(F.count("*"), F.sum(F.xxhash64(column).cast("decimal(38,0)")), F.sum(F.hash(column).cast("long"))).first()
    return f"{r[0]}-{r[1]}-{r[2]}"


def cached(df_of, sources: DataFrame, column: str, path: str, spark) -> DataFrame:
    """The table computed for this exact set of sources, from ``path`` if it was already written there [B11]."""
    at = f"{path}/{fingerprint(sources, column)}"
    try:
        return spark.read.parquet(at)
    except Exception:  # not there or not readable: computed again
        df_of().write.mode("overwrite").parquet(at)
        return spark.read.parquet(at)


def assemble_coco(annotations: DataFrame, categories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """images and annotations with dense ids from 0 in file order [B12].

    annotations: file_name, width, height, n, name, bbox, polygon (or null). A name without category and boxes of no area are
    dropped; without a polygon the box's corners stand for it. Ids come from one sort of distinct files and one of annotations
    by Spark's range partitions (zipWithIndex), not from a window over all rows."""
    from foliant.functions.geometry import polygon_of_box

    spark = annotations.sparkSession

    def numbered(df: DataFrame, *order: str) -> DataFrame:
        rdd = df.orderBy(*order).rdd.zipWithIndex().map(lambda x: (*x[0], x[1]))
        return spark.createDataFrame(rdd, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", id long")

    images = numbered(annotations.select("file_name", "width", "height").distinct(), "file_name")
    b = F.col("bbox")
    kept = annotations.join(categories.select(F.col("id").alias("category_id"), "name"), "name").where(b[2] * b[3] > 0)
    kept = kept.join(images.select("file_name", F.col("id").alias("image_id")), "file_name").select(
        "image_id", "n", "category_id", "bbox", (b[2] * b[3]).cast("double").alias("area"), F.array(F.coalesce("polygon", polygon_of_box(b).cast("array<double>"))).alias("segmentation"))
    return images, numbered(kept, "image_id", "n").drop("n")


def running_ids(df: DataFrame, by: str, *order: str) -> DataFrame:
    """Numbers from 0 within a group."""
    return df.withColumn("id", F.row_number().over(W.partitionBy(by).orderBy(*order)) - 1)
