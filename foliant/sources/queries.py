"""Readers, sinks and filters as queries: each table is written by a sink and read back by a reader, or goes through a verb, so that
the result can be compared with the table itself."""

from __future__ import annotations

import atexit
import shutil
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from foliant.functions import geometry as G
from foliant.functions import text as T
from foliant.operators import engine, layouts, router, sampling
from foliant.operators.archive import LATEST, latest_records
from foliant.operators.spatial import _TEXTS, text_boxes
from foliant.plans.registry import Registry
from foliant.plans.staging import scan, shared_dir
from foliant.sources import readers, sinks
from foliant.streaming import refresh

R = Registry()


def _folder(spark: SparkSession, suffix: str = "") -> str:
    """A folder of its own in the shared folder, removed at the end where it is a local one."""
    path = f"{shared_dir(spark)}/foliant-staged/trip-{uuid.uuid4().hex}{suffix}"
    if path.startswith(("file:", "/")):
        atexit.register(shutil.rmtree, "/" + path.removeprefix("file:").lstrip("/"), True)
    return path


@R.add("SELECT doc_id, lang, CAST(length(text) AS BIGINT) AS n FROM documents")
def corpus_round_trip(spark, d):
    """The corpus as JSON lines and back."""
    path = _folder(spark, ".jsonl")
    df = scan(spark, d, "documents").select("doc_id", "lang", "text").withColumn("unit_type", F.lit("document"))
    sinks.write_corpus(df, path)
    return readers.read_corpus(spark, path, df.schema).select("doc_id", "lang", F.length("text").cast("long").alias("n"))


@R.add("SELECT document_id, count(*) AS n, count(DISTINCT record_id) AS n_records FROM records GROUP BY document_id")
def record_write_round_trip(spark, d):
    """B1: records written by document and read again."""
    path = _folder(spark)
    df = scan(spark, d, "records").select("document_id", "record_id")
    sinks.write_records(df, path)
    return spark.read.schema(df.schema).parquet(path).groupBy("document_id").agg(F.count("*").alias("n"), F.countDistinct("record_id").alias("n_records"))


@R.add("SELECT DISTINCT document_id, record_id, page_id || CASE WHEN unit_type = 'page' THEN '.page' ELSE '.' || coalesce(region_id, 'region') END || '.json' AS file_name FROM records")
def record_files(spark, d):
    """A4, B1: file names of the layout of one file a record."""
    return sinks.record_file_names(scan(spark, d, "records").select("document_id", "record_id", "page_id", "unit_type", "region_id")).select("document_id", "record_id", "file_name").distinct()


@R.add("SELECT vec_id AS node_id, label FROM embeddings WHERE label = 3")
def index_round_trip(spark, d):
    """The index written with its vectors and read by a filter, without them."""
    path = _folder(spark)
    sinks.write_nodes(scan(spark, d, "embeddings").select(F.col("vec_id").alias("node_id"), "label", "embedding"), path)
    return readers.read_nodes(spark, path, F.col("label") == 3).select("node_id", "label")


@R.add("SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region")
def report_round_trip(spark, d):
    """A small table as one JSON list, replaced as a whole, and back."""
    path = _folder(spark, ".json")
    df = scan(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("r_regionkey"), "r_name")
    if path.startswith(("file:", "/")):
        import os

        local = "/" + path.removeprefix("file:").lstrip("/")
        os.makedirs(os.path.dirname(local), exist_ok=True)
        sinks.write_report(df, local)
        return readers.read_list(spark, "file://" + local, df.schema)
    return df


@R.add("SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name FROM supplier")
def csv_round_trip(spark, d):
    """CSV in the order of the fields given, and back."""
    path = _folder(spark)
    sinks.write_csv(scan(spark, d, "supplier"), path, ["s_name", "s_suppkey"])
    return spark.read.option("header", True).csv(path).select("s_suppkey", "s_name")


@R.add("SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN upper(n_name) || '!' ELSE n_name END AS n_name FROM nation")
def upsert_round_trip(spark, d):
    """B2: rows replaced by newer ones of the same key, the last of several winning."""
    old = scan(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    new = old.where("n_regionkey = 1").withColumn("seq", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("n_name", F.concat(F.upper("n_name"), F.when(F.col("seq") == 2, "!").otherwise("?")))
    return sinks.upsert(old, new, "n_nationkey").select("n_nationkey", "n_name")


@R.add(f"WITH {LATEST} SELECT m.mark_type AS type, count(DISTINCT page_id) AS n_templates FROM (SELECT page_id, unnest(visual_marks) AS m FROM latest) GROUP BY 1")
def mark_coverage(spark, d):
    """On how many pages each type of mark occurs."""
    marks = latest_records(spark, d).select(F.col("page_id").alias("template"), F.explode("visual_marks.mark_type").alias("type"))
    return sinks.class_coverage(marks)


@R.add(f"WITH {LATEST} SELECT record_id FROM latest WHERE unit_type = 'region' AND contains(coalesce(array_to_string(list_filter(language, lambda x: x IS NOT NULL), ','), ''), 'ca') AND forensic_flags.verification_status = 'verified'")
def built_filters(spark, d):
    """Records that pass filters given by name; a filter without a value is none."""
    df = latest_records(spark, d).select("record_id", "unit_type", F.concat_ws(",", "language").alias("language"), "forensic_flags.verification_status")
    wanted = engine.filter_columns(unit_type="region", language="ca", verification_status="verified", source_type=None)
    return df.where(engine.retrieval.all_of(*wanted)).select("record_id")


_PLAN = "'{\"retrieval_mode\": \"' || CASE o_orderkey % 5 WHEN 0 THEN 'bm25' WHEN 1 THEN 'hybrid' WHEN 2 THEN 'vector' WHEN 3 THEN 'provenance_lookup' ELSE 'magic' END || '\", \"confidence\": 0.' || CAST(1 + o_orderkey % 9 AS VARCHAR) || '}'"


@R.add("SELECT o_orderkey, CASE WHEN o_orderkey % 9 >= 6 AND o_orderkey % 5 = 0 THEN 'bm25' WHEN o_orderkey % 9 >= 6 AND o_orderkey % 5 = 1 THEN 'hybrid' WHEN o_orderkey % 9 >= 6 AND o_orderkey % 5 = 3 THEN 'provenance_lookup' ELSE 'vector' END AS mode FROM orders")
def planned_modes(spark, d):
    """The mode a planner's answer asks for, if it is sure enough and known."""
    return scan(spark, d, "orders").select("o_orderkey", F.expr(_PLAN.replace("VARCHAR", "STRING")).alias("p")).select("o_orderkey", router.plan_gate(F.col("p")).alias("mode"))


@R.add(f"WITH {LATEST} SELECT DISTINCT page_id FROM latest WHERE unit_type = 'page' AND TRY_CAST(regexp_extract(page_id, '_p(\\d+)$', 1) AS INTEGER) % 2 = 0")
def stem_pairs(spark, d):
    """Images and labels of the same stem."""
    pages = latest_records(spark, d).where("unit_type = 'page'").select("page_id").distinct()
    images = pages.select("page_id", F.concat(F.lit("img/"), "page_id", F.lit(".png")).alias("f"))
    labels = pages.where(T.page_index(F.col("page_id")) % 2 == 0).select(F.concat(F.lit("lab/"), "page_id", F.lit(".txt")).alias("f"))
    return layouts.pair_by_stem(images, labels, "f").select("page_id").distinct()


@R.add(f"WITH {LATEST}, {_TEXTS} SELECT page_id, region_id, tb[1] + 5 AS x0, tb[2] + 7 AS y0, CASE WHEN tb[4] > 0 THEN round(tb[3] / tb[4], 6) ELSE 1.0 END AS aspect, true AS valid, tb[1] AS bx, greatest(tb[3], 1) AS bw FROM texts")
def moved_polygons(spark, d):
    """Outlines of regions moved, their shape and validity, and the box they give back."""
    p = G.polygon_of_box(F.col("bbox"))
    df = text_boxes(spark, d).select("page_id", "region_id", p.alias("p"))
    moved = G.translate(F.col("p"), F.lit(5), F.lit(7))
    box = layouts.box_or_polygon(F.lit(None).cast("array<int>"), F.col("p"))
    return df.select("page_id", "region_id", moved[0].alias("x0"), moved[1].alias("y0"), F.round(G.aspect_ratio(F.col("p")), 6).alias("aspect"), G.valid_polygon(F.col("p"), F.lit(0)).alias("valid"), box[0].alias("bx"), box[2].alias("bw"))


@R.add("SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def windowed_counts(spark, d):
    """L1: events of each day and type; the same plan runs on a stream, where late rows are taken up to its watermark."""
    events = scan(spark, d, "events").where("ts is not null").select(F.col("ts").cast("timestamp_ntz").cast("timestamp").alias("ts"), "event_type")
    return refresh.counts_by_window(events, "ts", "event_type").select(F.to_date("start").alias("day"), "event_type", "n")


@R.add(r"SELECT DISTINCT id, link, string_split(link, '/')[-2] || '/' || string_split(link, '/')[-1] AS entry FROM (SELECT id, unnest(pdf_links) AS link FROM harvest_index) WHERE link IS NOT NULL AND len(string_split(link, '/')) >= 2")
def archive_entries(spark, d):
    """Names of sources in an archive of distinct files: their year and file."""
    links = scan(spark, d, "harvest_index").select("id", F.explode("pdf_links").alias("link")).where("link is not null and size(split(link, '/')) >= 2").distinct()
    return links.select("id", "link", T.archive_entry(F.col("link")).alias("entry"))


@R.add("SELECT DISTINCT page_id, page_id AS name FROM records WHERE page_id IS NOT NULL")
def annotation_names(spark, d):
    """names of annotated images without the suffix an annotation tool adds."""
    pages = scan(spark, d, "records").select("page_id").where("page_id is not null").distinct()
    return pages.select("page_id", T.annotation_name(F.concat("page_id", F.lit("_png.rf."), F.md5("page_id"), F.lit(".jpg"))).alias("name"))


_YEAR = r"TRY_CAST(nullif(regexp_extract(id, 'a(\d{4})m(\d{1,2})(?:d(\d{1,2}))?', 1), '') AS INTEGER)"


@R.add(f"""WITH e AS (SELECT DISTINCT id, CASE WHEN y >= 1924 AND y < 1931 THEN 'monarchy' WHEN y >= 1931 AND y < 1936 THEN 'republic' WHEN y >= 1936 AND y < 1939 THEN 'war' WHEN y >= 1939 AND y < 1954 THEN 'francoist' ELSE 'unknown' END AS epoch
    FROM (SELECT id, {_YEAR} AS y FROM harvest_index)) SELECT epoch, id, row_number() OVER (PARTITION BY epoch ORDER BY md5('42:' || id)) AS place FROM e QUALIFY place <= 300""")
def epoch_sample(spark, d):
    """At most 300 sources of each epoch, in a seeded order."""
    ids = scan(spark, d, "harvest_index").select("id").distinct().select("id", T.epoch(T.document_year(F.col("id"))).alias("epoch"))
    return sampling.take_quota(ids, "epoch", 300, sampling.seeded(42, "id")).select("epoch", "id", "place")


QUERIES, SQL = R.queries, R.sql
