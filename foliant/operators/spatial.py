"""Boxes on pages: overlaps of text and marks, alerts, reading order, records from regions and marks, polygons, tiles.

All overlap joins have the page as an equal key, so they are hash or merge joins with the overlap as a condition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from foliant.functions import geometry as G
from foliant.operators.archive import LATEST, latest_records
from foliant.plans.registry import Registry
from foliant.plans.staging import scan

R = Registry()
OVERLAP, STRIKE, LINKED, MIN_AREA, VERIFIED = 0.05, 0.30, 0.10, 0.01, 0.85


def text_boxes(spark: SparkSession, d: str) -> DataFrame:
    """(page_id, region_id, layer, o, bbox, conf, area) of the archive's regions."""
    df = latest_records(spark, d).where("unit_type = 'region' and size(bbox) = 4")
    return df.select("page_id", "region_id", F.substring("region_id", 1, 2).alias("layer"), F.col("reading_order").alias("o"), "bbox", F.col("ocr.confidence_score").alias("conf"))


def mark_boxes(spark: SparkSession, d: str) -> DataFrame:
    """(page_id, mark_id, mark_type, bbox, conf) of the archive's marks."""
    df = latest_records(spark, d).where("unit_type = 'page'").select("page_id", F.explode("visual_marks").alias("m"))
    return df.select("page_id", "m.mark_id", "m.mark_type", "m.bbox", F.col("m.confidence_score").alias("conf")).where("size(bbox) = 4")


def overlaps(marks: DataFrame, texts: DataFrame, least: float = OVERLAP) -> DataFrame:
    """Pairs of marks and texts of one page with an IoU over ``least`` [D1]."""
    pairs = marks.join(texts.withColumnsRenamed({"bbox": "tb", "conf": "text_conf"}), "page_id")
    return pairs.withColumn("iou", G.pixel_iou(F.col("bbox"), F.col("tb"))).where(F.col("iou") > least)


_TEXTS = "texts AS (SELECT page_id, region_id, region_id[1:2] AS layer, reading_order AS o, bbox AS tb, ocr.confidence_score AS text_conf FROM latest WHERE unit_type = 'region' AND len(bbox) = 4)"
_MARKS = """marks AS (SELECT page_id, m.mark_id AS mark_id, m.mark_type AS mark_type, m.bbox AS b, m.confidence_score AS conf FROM (SELECT page_id, unnest(visual_marks) AS m FROM latest WHERE unit_type = 'page')
    WHERE len(m.bbox) = 4)"""


def _inter(a: str, b: str) -> str:
    return (f"(greatest(0, least({a}[1] + {a}[3], {b}[1] + {b}[3]) - greatest({a}[1], {b}[1])) * greatest(0, least({a}[2] + {a}[4], {b}[2] + {b}[4]) - greatest({a}[2], {b}[2])))::DOUBLE")


def _iou(a: str, b: str) -> str:
    return f"({_inter(a, b)} / greatest(1, {a}[3] * {a}[4] + {b}[3] * {b}[4] - {_inter(a, b)}))"


_PAIRS = f"{LATEST}, {_TEXTS}, {_MARKS}, pairs AS (SELECT m.*, t.region_id, t.layer, t.o, t.tb, {_iou('m.b', 't.tb')} AS iou FROM marks m JOIN texts t ON m.page_id = t.page_id)"


@R.add(f"WITH {_PAIRS} SELECT page_id, mark_id, region_id, round(iou, 4) AS iou FROM pairs WHERE iou > 0.05")
def iou_join(spark, d):
    """Marks over text."""
    return overlaps(mark_boxes(spark, d), text_boxes(spark, d)).select("page_id", "mark_id", "region_id", F.round("iou", 4).alias("iou"))


@R.add(f"WITH {LATEST}, {_TEXTS} SELECT a.page_id, a.region_id AS a, b.region_id AS b, round({_inter('a.tb', 'b.tb')} / (a.tb[3] * a.tb[4] + b.tb[3] * b.tb[4] - {_inter('a.tb', 'b.tb')} + 1e-9), 6) AS iou FROM texts a JOIN texts b ON a.page_id = b.page_id AND a.region_id < b.region_id WHERE {_inter('a.tb', 'b.tb')} > 0")
def region_overlaps(spark, d):
    """G1: texts of a page that overlap each other."""
    t = text_boxes(spark, d)
    iou = G.box_iou(F.col("x.bbox"), F.col("y.bbox"))
    both = t.alias("x").join(t.alias("y"), F.expr("x.page_id = y.page_id and x.region_id < y.region_id")).withColumn("iou", iou).where("iou > 0")
    return both.select("x.page_id", F.col("x.region_id").alias("a"), F.col("y.region_id").alias("b"), F.round("iou", 6).alias("iou"))


def alerts(pairs: DataFrame) -> DataFrame:
    """(page_id, alert): a stamp over text, text struck through [D1]."""
    alert = F.when((F.col("iou") > OVERLAP) & (F.col("mark_type") == "stamps"), "stamp_over_text") \
        .when((F.col("iou") > STRIKE) & F.col("mark_type").isin("lines", "crosses"), "strikethrough_text")
    return pairs.select("page_id", alert.alias("alert")).where("alert is not null").distinct()


_HAND = f"hand AS (SELECT DISTINCT a.page_id FROM texts a JOIN texts b ON a.page_id = b.page_id WHERE a.layer = 'pr' AND b.layer = 'hw' AND {_iou('a.tb', 'b.tb')} > 0.10)"
_ALERTS = f"""{_PAIRS}, {_HAND}, alerts AS (SELECT DISTINCT page_id, 'stamp_over_text' AS alert FROM pairs WHERE iou > 0.05 AND mark_type = 'stamps'
    UNION SELECT page_id, 'strikethrough_text' FROM pairs WHERE iou > 0.30 AND mark_type IN ('lines', 'crosses') UNION SELECT page_id, 'handwritten_annotation_on_printed' FROM hand)"""


def _handwritten_over_printed(texts: DataFrame) -> DataFrame:
    printed, written = texts.where("layer = 'pr'").alias("a"), texts.where("layer = 'hw'").alias("b")
    return printed.join(written, (F.col("a.page_id") == F.col("b.page_id")) & (G.pixel_iou(F.col("a.bbox"), F.col("b.bbox")) > LINKED), "left_semi") \
        .select("page_id", F.lit("handwritten_annotation_on_printed").alias("alert")).distinct()


@R.add(f"WITH {_ALERTS} SELECT page_id, alert FROM alerts")
def overlap_alerts(spark, d):
    """Alerts of pages."""
    texts = text_boxes(spark, d)
    return alerts(overlaps(mark_boxes(spark, d), texts)).unionByName(_handwritten_over_printed(texts))


@R.add(f"WITH {_PAIRS}, n AS (SELECT page_id, region_id, count(*) AS n FROM pairs WHERE iou > 0.10 GROUP BY ALL), k AS (SELECT page_id, mark_id, count(*) AS n FROM pairs WHERE iou > 0.10 GROUP BY ALL) "
       "SELECT 'region' AS side, t.page_id, t.region_id AS id, coalesce(n.n, 0) AS n_overlaps FROM texts t LEFT JOIN n ON t.page_id = n.page_id AND t.region_id = n.region_id "
       "UNION ALL SELECT 'mark', m.page_id, m.mark_id, coalesce(k.n, 0) FROM marks m LEFT JOIN k ON m.page_id = k.page_id AND m.mark_id = k.mark_id")
def overlap_counts_outer(spark, d):
    """How many boxes of the other kind each box overlaps, zeros included."""
    texts, marks = text_boxes(spark, d), mark_boxes(spark, d)
    pairs = overlaps(marks, texts, LINKED)

    def counted(side: str, boxes: DataFrame, key: str) -> DataFrame:
        n = pairs.groupBy("page_id", key).agg(F.count("*").alias("n"))
        return boxes.join(n, ["page_id", key], "left").select(F.lit(side).alias("side"), "page_id", F.col(key).alias("id"), F.coalesce("n", F.lit(0)).alias("n_overlaps"))

    return counted("region", texts, "region_id").unionByName(counted("mark", marks, "mark_id"))


def reading_order(boxes: DataFrame, page: str, box: str, key: str) -> DataFrame:
    """``boxes`` with ``position`` (from 1): columns by gaps between centres, then lines, then from left [G16, H9].

    The least gap is the median width (or three lines), a line the median height, both cut to integers."""
    b = F.col(box)
    tol = boxes.groupBy(page).agg(F.greatest(F.lit(1), F.floor(F.median(b[3]))).alias("line"), F.floor(F.median(b[2])).alias("w"))
    df = boxes.join(tol.select(page, "line", F.greatest("w", F.col("line") * 3).alias("gap")), page).withColumn("c", b[0] + b[2] / 2.0)
    before = F.lag("c").over(W.partitionBy(page).orderBy("c", key))
    df = df.withColumn("step", F.when(F.col("c") - before > F.col("gap"), 1).otherwise(0)).withColumn("column", F.sum("step").over(W.partitionBy(page).orderBy("c", key)))
    # boxes with equal centres share a column: the boundary lies before all of them
    df = df.withColumn("column", F.max("column").over(W.partitionBy(page, "c")))
    order = W.partitionBy(page).orderBy("column", F.floor(b[1] / F.col("line")), b[0], key)
    return df.withColumn("position", F.row_number().over(order)).drop("line", "gap", "c", "step")


@R.add(f"""WITH {LATEST}, {_TEXTS}, m AS (SELECT page_id, greatest(1, floor(median(tb[4]))) AS line, floor(median(tb[3])) AS w FROM texts GROUP BY page_id),
    g AS (SELECT t.page_id, region_id, tb, line, greatest(w, line * 3) AS gap, tb[1] + tb[3] / 2.0::DOUBLE AS c FROM texts t JOIN m ON t.page_id = m.page_id),
    s AS (SELECT *, CASE WHEN c - lag(c) OVER (PARTITION BY page_id ORDER BY c, region_id) > gap THEN 1 ELSE 0 END AS step FROM g),
    k AS (SELECT *, sum(step) OVER (PARTITION BY page_id ORDER BY c, region_id) AS col0 FROM s), k2 AS (SELECT *, max(col0) OVER (PARTITION BY page_id, c) AS col FROM k)
    SELECT page_id, region_id, row_number() OVER (PARTITION BY page_id ORDER BY col, floor(tb[2] / line), tb[1], region_id) AS position FROM k2""")
def column_reading_order(spark, d):
    """Regions in reading order."""
    return reading_order(text_boxes(spark, d), "page_id", "bbox", "region_id").select("page_id", "region_id", "position")


@R.add(f"WITH {LATEST}, {_TEXTS}, {_MARKS} SELECT page_id, round(median(c), 6) AS page_confidence FROM (SELECT page_id, text_conf AS c FROM texts UNION ALL SELECT page_id, conf FROM marks) GROUP BY page_id")
def page_confidence(spark, d):
    """The median of all confidences of a page."""
    both = text_boxes(spark, d).select("page_id", "conf").unionByName(mark_boxes(spark, d).select("page_id", "conf"))
    return both.groupBy("page_id").agg(F.round(F.median("conf"), 6).alias("page_confidence"))


def build_records(regions: DataFrame, marks: DataFrame, page_area: float) -> DataFrame:
    """Page and region records from regions (document_id, page_id, layer, n, bbox, text, conf) and marks (page_id, mark_id,
    mark_type, bbox, conf): ids, texts, linked spans, alerts, confidence, status and review flag [C4-C6, C14, C15, D1-D3, E21].

    ``n`` is a region's number in its layer before any is left out; regions under a hundredth of the page have no record of
    their own but take part in the page's."""
    texts = regions.withColumn("region_id", F.format_string("%s_%04d", "layer", "n"))
    pairs = overlaps(marks, texts.select("page_id", "region_id", "layer", "bbox", "conf"))
    spans = pairs.where(F.col("iou") > LINKED)
    page_alerts = alerts(pairs).unionByName(_handwritten_over_printed(texts.select("page_id", "layer", "bbox"))) \
        .groupBy("page_id").agg(F.array_sort(F.collect_set("alert")).alias("alerts"))
    conf = texts.select("page_id", "conf").unionByName(marks.select("page_id", "conf")).groupBy("page_id").agg(F.median("conf").alias("conf"))
    part = F.struct(F.when(F.col("layer") == "pr", 0).otherwise(1).alias("l"), "n", "text")
    joined = F.array_join(F.transform(F.filter(F.array_sort(F.collect_list(part)), lambda x: x["text"] != ""), lambda x: x["text"]), " ")
    bodies = texts.groupBy("document_id", "page_id").agg(joined.alias("text"))
    kinds = marks.groupBy("page_id").agg(F.array_sort(F.collect_list("mark_type")).alias("kinds"))
    n_spans = spans.groupBy("page_id").agg(F.count("*").alias("n_spans"))
    no_alert = F.array().cast("array<string>")
    pages = bodies.join(conf, "page_id", "left").join(page_alerts, "page_id", "left").join(kinds, "page_id", "left").join(n_spans, "page_id", "left").select(
        F.concat_ws("__", "document_id", "page_id", F.lit("page")).alias("record_id"), F.lit("page").alias("unit_type"), "text", F.coalesce("conf", F.lit(0.0)).alias("conf"),
        F.coalesce("alerts", no_alert).alias("alerts"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        F.concat_ws(" | ", F.nullif("text", F.lit("")), F.nullif(F.array_join(F.coalesce("kinds", no_alert), ", "), F.lit("")), F.nullif(F.array_join(F.coalesce("alerts", no_alert), ", "), F.lit(""))).alias("retrieval_text"))
    own = alerts(spans.withColumn("page_id", F.concat_ws("/", "page_id", "region_id"))).groupBy("page_id").agg(F.array_sort(F.collect_set("alert")).alias("alerts"))
    per_region = spans.groupBy("page_id", "region_id").agg(F.count("*").alias("n_spans"))
    b = F.col("bbox")
    kept = texts.where(b[2] * b[3] >= MIN_AREA * page_area).join(per_region, ["page_id", "region_id"], "left").withColumn("k", F.concat_ws("/", "page_id", "region_id"))
    region_rows = kept.join(own.withColumnRenamed("page_id", "k"), "k", "left").select(
        F.concat_ws("__", "document_id", "page_id", "region_id").alias("record_id"), F.lit("region").alias("unit_type"), F.coalesce("text", F.lit("")).alias("text"), "conf",
        F.coalesce("alerts", no_alert).alias("alerts"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("text", F.lit("")).alias("retrieval_text"))
    both = pages.unionByName(region_rows)
    review = F.when(F.col("unit_type") == "page", F.arrays_overlap("alerts", F.array(F.lit("strikethrough_text"), F.lit("handwritten_annotation_on_printed")))).otherwise(F.size("alerts") > 0)
    return both.withColumn("verification_status", F.when(F.col("conf") >= VERIFIED, "verified").otherwise("uncertain")).withColumn("human_review_required", review)


@R.add(f"""WITH {_ALERTS}, regions AS (SELECT document_id, page_id, region_id, region_id[1:2] AS layer, ocr.full_text AS text, bbox AS tb, ocr.confidence_score AS conf FROM latest WHERE unit_type = 'region' AND len(bbox) = 4),
    body AS (SELECT document_id, page_id, coalesce(string_agg(text, ' ' ORDER BY layer DESC, region_id) FILTER (text <> ''), '') AS text FROM regions GROUP BY ALL),
    cf AS (SELECT page_id, median(c) AS conf FROM (SELECT page_id, conf AS c FROM regions UNION ALL SELECT page_id, conf FROM marks) GROUP BY page_id),
    al AS (SELECT page_id, string_agg(alert, ', ' ORDER BY alert) AS alerts, bool_or(alert <> 'stamp_over_text') AS review FROM alerts GROUP BY page_id),
    mk AS (SELECT page_id, string_agg(mark_type, ', ' ORDER BY mark_type) AS kinds FROM marks GROUP BY page_id),
    sp AS (SELECT page_id, count(*) AS n FROM pairs WHERE iou > 0.10 GROUP BY page_id),
    rs AS (SELECT page_id, region_id, count(*) AS n, max(CASE WHEN mark_type = 'stamps' THEN 'stamp_over_text' END) AS a1, max(CASE WHEN iou > 0.30 AND mark_type IN ('lines', 'crosses') THEN 'strikethrough_text' END) AS a2
        FROM pairs WHERE iou > 0.10 GROUP BY ALL)
    SELECT b.document_id || '__' || b.page_id || '__page' AS record_id, 'page' AS unit_type, text, round(coalesce(conf, 0), 6) AS conf, coalesce(alerts, '') AS alerts, coalesce(sp.n, 0) AS n_spans,
        concat_ws(' | ', nullif(text, ''), nullif(kinds, ''), nullif(alerts, '')) AS retrieval_text, CASE WHEN conf >= 0.85 THEN 'verified' ELSE 'uncertain' END AS verification_status, coalesce(review, false) AS human_review_required
    FROM body b LEFT JOIN cf ON cf.page_id = b.page_id LEFT JOIN al ON al.page_id = b.page_id LEFT JOIN mk ON mk.page_id = b.page_id LEFT JOIN sp ON sp.page_id = b.page_id
    UNION ALL SELECT r.document_id || '__' || r.page_id || '__' || r.region_id, 'region', coalesce(text, ''), round(conf, 6), concat_ws(', ', a1, a2), coalesce(rs.n, 0), coalesce(text, ''),
        CASE WHEN conf >= 0.85 THEN 'verified' ELSE 'uncertain' END, a1 IS NOT NULL OR a2 IS NOT NULL
    FROM regions r LEFT JOIN rs ON rs.page_id = r.page_id AND rs.region_id = r.region_id WHERE r.tb[3] * r.tb[4] >= 0.01 * 2480 * 3508""")
def page_records(spark, d):
    """Records built again from the archive's regions and marks."""
    r = latest_records(spark, d).where("unit_type = 'region' and size(bbox) = 4").select(
        "document_id", "page_id", F.substring("region_id", 1, 2).alias("layer"), F.substring_index("region_id", "_", -1).cast("int").alias("n"), "bbox", F.col("ocr.full_text").alias("text"), F.col("ocr.confidence_score").alias("conf"))
    out = build_records(r, mark_boxes(spark, d), 2480 * 3508)
    return out.withColumn("conf", F.round("conf", 6)).withColumn("alerts", F.array_join("alerts", ", "))


# polygons of the regions: the box with its upper edge cut at a third
_POLY_SQL = "[tb[1] + tb[3] / 3.0, tb[2], tb[1] + tb[3], tb[2], tb[1] + tb[3], tb[2] + tb[4], tb[1], tb[2] + tb[4]]"


def _polygons(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("bbox")
    poly = F.array(b[0] + b[2] / 3.0, b[1].cast("double"), (b[0] + b[2]).cast("double"), b[1].cast("double"), (b[0] + b[2]).cast("double"), (b[1] + b[3]).cast("double"), b[0].cast("double"), (b[1] + b[3]).cast("double"))
    return text_boxes(spark, d).select("page_id", "region_id", "bbox", poly.alias("p"))


@R.add(f"""WITH {LATEST}, {_TEXTS}, p AS (SELECT page_id, region_id, tb, tb[1] + tb[3] / 3.0::DOUBLE AS x1, tb[2] AS y, tb[1] + tb[3] AS x2, tb[2] + tb[4] AS y2, tb[1] AS x0 FROM texts)
    SELECT page_id, region_id, floor(abs((x1 * y - x2 * y) + (x2 * y2 - x2 * y) + (x2 * y2 - x0 * y2) + (x0 * y - x1 * y2)) / 2) AS area, round((x1 + x2 + x2 + x0) / 4, 4) AS cx, round((y + y + y2 + y2) / 4.0::DOUBLE, 4) AS cy,
        CAST(trunc(least(x1, x0)) AS INTEGER) AS bx0, y AS by0, x2 AS bx1, y2 AS by1 FROM p""")
def shoelace_area(spark, d):
    """Area, centre and bounds of polygons."""
    p = F.col("p")
    bounds = G.polygon_bounds(p)
    c = G.polygon_centroid(p)
    return _polygons(spark, d).select("page_id", "region_id", G.shoelace_area(p).cast("double").alias("area"), F.round(c[0], 4).alias("cx"), F.round(c[1], 4).alias("cy"),
                                      *[bounds[i].alias(n) for i, n in enumerate(("bx0", "by0", "bx1", "by1"))])


def tile_grid(df: DataFrame, width: Column, height: Column, tile: int, step: int) -> DataFrame:
    """Every tile (tx, ty) of a page that starts inside it [G14]."""
    xs, ys = F.sequence(F.lit(0), F.greatest(width.cast("int") - 1, F.lit(0)), F.lit(step)), F.sequence(F.lit(0), F.greatest(height.cast("int") - 1, F.lit(0)), F.lit(step))
    return df.withColumn("tx", F.explode(xs)).withColumn("ty", F.explode(ys))


def clip_to_tiles(boxes: DataFrame, box: str, tile: int) -> DataFrame:
    """Each box once for every tile it touches, clipped and moved to the tile's corner [D15]: the tiles are computed from the
    box, not joined with it."""
    b = F.col(box)
    spread_ = lambda a, n: F.explode(F.sequence(F.floor(a / tile).cast("int"), F.floor((a + n - 1) / tile).cast("int")))
    df = boxes.withColumn("tx", spread_(b[0], F.greatest(b[2], F.lit(1)))).withColumn("ty", spread_(b[1], F.greatest(b[3], F.lit(1))))
    x0, y0 = F.greatest(b[0], F.col("tx") * tile), F.greatest(b[1], F.col("ty") * tile)
    x1, y1 = F.least(b[0] + b[2], (F.col("tx") + 1) * tile), F.least(b[1] + b[3], (F.col("ty") + 1) * tile)
    return df.select("*", (x0 - F.col("tx") * tile).alias("x"), (y0 - F.col("ty") * tile).alias("y"), (x1 - x0).alias("w"), (y1 - y0).alias("h")).where("w > 0 and h > 0")


_TILES = f"""{LATEST}, {_TEXTS}, tx AS (SELECT *, unnest(range(CAST(floor(tb[1] / 768) AS BIGINT), CAST(floor((tb[1] + greatest(tb[3], 1) - 1) / 768) AS BIGINT) + 1)) AS tx FROM texts),
    txy AS (SELECT *, unnest(range(CAST(floor(tb[2] / 768) AS BIGINT), CAST(floor((tb[2] + greatest(tb[4], 1) - 1) / 768) AS BIGINT) + 1)) AS ty FROM tx),
    clip AS (SELECT page_id, region_id, tx, ty, greatest(tb[1], tx * 768) - tx * 768 AS x, greatest(tb[2], ty * 768) - ty * 768 AS y, least(tb[1] + tb[3], (tx + 1) * 768) - greatest(tb[1], tx * 768) AS w,
        least(tb[2] + tb[4], (ty + 1) * 768) - greatest(tb[2], ty * 768) AS h FROM txy)"""


@R.add(f"WITH {_TILES} SELECT page_id, region_id, tx, ty, x, y, w, h FROM clip WHERE w > 0 AND h > 0")
def tile_clip(spark, d):
    """Regions clipped to tiles of 768 pixels."""
    return clip_to_tiles(text_boxes(spark, d), "bbox", 768).select("page_id", "region_id", F.col("tx").cast("long").alias("tx"), F.col("ty").cast("long").alias("ty"), "x", "y", "w", "h")


@R.add(f"WITH {_TILES} SELECT page_id, tx, ty, round(least(sum(w * h), 768 * 768) / (768 * 768.0::DOUBLE), 6) AS coverage FROM clip WHERE w > 0 AND h > 0 GROUP BY page_id, tx, ty")
def tile_coverage(spark, d):
    """The share of a tile that regions cover; overlaps count twice, one at most."""
    c = clip_to_tiles(text_boxes(spark, d), "bbox", 768).groupBy("page_id", "tx", "ty").agg(F.sum(F.col("w") * F.col("h")).alias("a"))
    return c.select("page_id", F.col("tx").cast("long").alias("tx"), F.col("ty").cast("long").alias("ty"), F.round(F.least("a", F.lit(768 * 768)) / F.lit(768 * 768.0), 6).alias("coverage"))


@R.add(f"WITH {LATEST}, {_TEXTS} SELECT page_id, min(tb[1]) AS x0, min(tb[2]) AS y0, max(tb[1] + tb[3]) AS x1, max(tb[2] + tb[4]) AS y1, count(*) AS n, round(avg(tb[3] * tb[4]), 4) AS mean_area, round(median(tb[3] * tb[4]), 4) AS median_area, "
       "round(coalesce(stddev_pop(tb[3] * tb[4]) / nullif(avg(tb[3] * tb[4]), 0), 0), 6) AS cv, round(sum(tb[3] * tb[4]) * 100.0::DOUBLE / (2480 * 3508), 6) AS coverage FROM texts GROUP BY page_id")
def region_sizes(spark, d):
    """Bounds of all regions of a page and statistics of their sizes."""
    b, a = F.col("bbox"), F.col("bbox")[2] * F.col("bbox")[3]
    return text_boxes(spark, d).groupBy("page_id").agg(
        F.min(b[0]).alias("x0"), F.min(b[1]).alias("y0"), F.max(b[0] + b[2]).alias("x1"), F.max(b[1] + b[3]).alias("y1"), F.count("*").alias("n"), F.round(F.avg(a), 4).alias("mean_area"),
        F.round(F.median(a), 4).alias("median_area"), F.round(F.coalesce(F.stddev_pop(a) / F.nullif(F.avg(a), F.lit(0.0)), F.lit(0.0)), 6).alias("cv"), F.round(F.sum(a) * 100.0 / (2480 * 3508), 6).alias("coverage"))


QUERIES, SQL = R.queries, R.sql
