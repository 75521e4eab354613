"""Annotations and layouts as tables: joins of annotations with images and categories, polygons, token groups, lenient JSON,
plans of variants, filling of layouts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from foliant.functions import geometry as G
from foliant.functions import text as T
from foliant.operators.archive import LATEST, latest_records
from foliant.operators.spatial import _TEXTS, text_boxes
from foliant.plans.registry import Registry
from foliant.plans.staging import scan

R = Registry()


def annotated(annotations: DataFrame, images: DataFrame, categories: DataFrame) -> DataFrame:
    """Annotations with their image and category; those without either are dropped [D6]."""
    return annotations.join(images.select(F.col("id").alias("image_id"), "file_name"), "image_id").join(categories.select(F.col("id").alias("category_id"), F.col("name").alias("category")), "category_id")


def pair_by_stem(left: DataFrame, right: DataFrame, path: str, how: str = "inner") -> DataFrame:
    """Files of two lists with the same stem [D11]."""
    stem = lambda c: T.page_stem(F.element_at(F.split(c, "/"), -1))
    return left.withColumn("stem", stem(path)).join(right.select(stem(path).alias("stem"), F.col(path).alias("other")), "stem", how)


def scanline(parts: Column, y: Column) -> Column:
    """[x from, x to] inside the parts of a polygon at height ``y`` by the even-odd rule over all parts, corners cut to integers,
    edges half open; parts of under three corners and empty intervals are left out [G5]."""
    def crossings(p: Column) -> Column:
        n = F.floor(F.size(p) / 2).cast("int")
        corner = lambda i, side: F.get(p, (i % n) * 2 + side).cast("int")

        def cross(i: Column) -> Column:
            x1, y1, x2, y2 = corner(i, 0), corner(i, 1), corner(i + 1, 0), corner(i + 1, 1)
            meets = ((y1 <= y) & (y < y2)) | ((y2 <= y) & (y < y1))
            return F.when(meets, x1 + (y - y1) / F.nullif((y2 - y1).cast("double"), F.lit(0.0)) * (x2 - x1))

        return F.when(n >= 3, F.array_compact(F.transform(F.sequence(F.lit(0), n - 1), cross))).otherwise(F.array().cast("array<double>"))

    xs = F.array_sort(F.flatten(F.transform(F.coalesce(parts, F.array().cast("array<array<double>>")), lambda p: crossings(F.coalesce(p, F.array().cast("array<double>"))))))
    pairs = F.when(F.size(xs) >= 2, F.transform(F.sequence(F.lit(0), F.floor(F.size(xs) / 2).cast("int") - 1), lambda i: F.array(F.get(xs, i * 2).cast("int"), F.get(xs, i * 2 + 1).cast("int"))))
    return F.filter(F.coalesce(pairs, F.array().cast("array<array<int>>")), lambda v: v[1] > v[0])


def word_groups(tokens: DataFrame, by: str, pos: str, token: str, logprob: str, marker: str = "▁") -> DataFrame:
    """Words from sub-word tokens: a token that begins with the marker begins a word [F19, H10]; confidence is exp of the mean
    log-probability [E25]."""
    first = F.startswith(token, F.lit(marker)) | (F.col(pos) == F.min(pos).over(W.partitionBy(by)))
    n = F.sum(first.cast("int")).over(W.partitionBy(by).orderBy(pos))
    parts = F.transform(F.array_sort(F.collect_list(F.struct(pos, token))), lambda x: x[token])
    return tokens.withColumn("word_no", n).groupBy(by, "word_no").agg(F.replace(F.array_join(parts, ""), F.lit(marker), F.lit("")).alias("word"), F.round(F.exp(F.avg(logprob)), 6).alias("confidence"))


def variant_plan(templates: DataFrame, modes: list[str], total: int) -> DataFrame:
    """Every template in every mode with its share of ``total`` variants, rounded up, numbered [D14, I13]."""
    n = templates.count() * len(modes)
    share = -(-total // n) if n else 0
    mode = templates.sparkSession.createDataFrame([(m,) for m in modes], "mode string")
    return templates.crossJoin(F.broadcast(mode)).withColumn("variant", F.explode(F.sequence(F.lit(1), F.lit(share)))) if share else templates.crossJoin(mode).withColumn("variant", F.lit(1)).limit(0)


def free_places(boxes: DataFrame, by: str, key: str, box: str, limit: int, density: float, width: int, height: int, schema: str) -> DataFrame:
    """Boxes taken one after the other unless they overlap one already taken, until a page is dense enough or has ``limit`` of
    them [D16, I15]. Order matters, so a page is one task's work."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        taken, area, rows = [], 0.0, []
        for r in pdf.sort_values(key).itertuples():
            x, y, w, h = getattr(r, box)
            if len(taken) >= limit or area / (width * height) >= density:
                break
            if all(x >= a + c or a >= x + w or y >= b + d or b >= y + h for a, b, c, d in taken):
                taken.append((x, y, w, h))
                area += w * h
                rows.append((getattr(r, by), getattr(r, key)))
        return pd.DataFrame(rows, columns=[by, key])

    return boxes.select(by, key, box).groupBy(by).applyInPandas(run, schema)


def expanded(box: Column, share: float, width: int, height: int) -> Column:
    """A box grown by a share of its size on all sides, cut at the page [G25]."""
    dx, dy = box[2] * share, box[3] * share
    x0, y0 = F.greatest(box[0] - dx, F.lit(0.0)), F.greatest(box[1] - dy, F.lit(0.0))
    x1, y1 = F.least(box[0] + box[2] + dx, F.lit(float(width))), F.least(box[1] + box[3] + dy, F.lit(float(height)))
    return F.array(x0, y0, x1 - x0, y1 - y0)


def box_or_polygon(box: Column, polygon: Column) -> Column:
    """The box of a region, else its polygon's, else [0, 0, 1, 1]; one pixel at least [G9]."""
    bounds = G.polygon_bounds(polygon)
    found = F.coalesce(F.when(F.size(box) == 4, box.cast("array<int>")), F.when(F.size(polygon) >= 6, F.array(bounds[0], bounds[1], bounds[2] - bounds[0], bounds[3] - bounds[1])), F.array(*map(F.lit, (0, 0, 1, 1))))
    return F.transform(found, lambda v, i: F.when(i >= 2, F.greatest(v, F.lit(1))).otherwise(v))


def mean_in_box(pixels: DataFrame, boxes: DataFrame, by: str) -> DataFrame:
    """The mean probability of the pixels in each box, 0 for a box without any [E29]. pixels: ``by``, x, y, p; boxes: ``by``, box_id, bbox."""
    b = F.col("bbox")
    inside = boxes.join(pixels, by).where((F.col("x") >= b[0]) & (F.col("x") < b[0] + b[2]) & (F.col("y") >= b[1]) & (F.col("y") < b[1] + b[3]))
    mean = inside.groupBy(by, "box_id").agg(F.avg("p").alias("mean_p"))
    return boxes.select(by, "box_id").join(mean, [by, "box_id"], "left").select(by, "box_id", F.round(F.coalesce("mean_p", F.lit(0.0)), 6).alias("mean_p"))


def stitched(patches: DataFrame, by: list[str]) -> DataFrame:
    """Overlapping patches averaged by weight, pixel by pixel [G15]. patches: ``by``, v, w."""
    return patches.groupBy(*by).agg((F.sum(F.col("v") * F.col("w")) / F.greatest(F.sum("w"), F.lit(1e-8))).alias("v"))


def two_of_three(a: Column, b: Column, c: Column) -> Column:
    """Whether two of three masks hold [G26]."""
    return (a & b) | (a & c) | (b & c)


def year_ranges(text: str) -> list[int]:
    """Years of ``1934``, ``1934,1936`` (a range), ``(1934,1936)`` or ``[(1934,1935),(1940,1941)]``, ends included [F13]."""
    import re

    if not re.fullmatch(r"[\s\d,()\[\]]+", text):
        raise ValueError(text)
    years = set()
    for part in re.findall(r"\(([^()]*)\)", text) or [text.strip(" []")]:
        n = [int(x) for x in re.findall(r"\d+", part)]
        if not 1 <= len(n) <= 2:
            raise ValueError(text)
        years |= set(range(n[0], n[-1] + 1))
    return sorted(years)


@R.add(f"WITH {LATEST}, imgs AS (SELECT DISTINCT page_id, CAST(regexp_extract(page_id, '_p(\\d+)$', 1) AS BIGINT) AS page_no FROM latest WHERE unit_type = 'page'), ann AS (SELECT page_id, m.mark_type AS t, m.bbox AS b FROM (SELECT page_id, unnest(visual_marks) AS m FROM latest WHERE unit_type = 'page')) "
       "SELECT t AS category, count(*) AS n, count(DISTINCT ann.page_id) AS n_images, CAST(sum(b[3] * b[4]) AS BIGINT) AS area FROM ann JOIN imgs ON imgs.page_id = ann.page_id WHERE t IN ('stamps', 'lines', 'crosses', 'circles') GROUP BY t")
def coco_flatten(spark, d):
    """Marks as annotations of images with categories; marks of other categories are dropped."""
    pages = latest_records(spark, d).where("unit_type = 'page'")
    images = pages.select(F.col("page_id").alias("id"), F.col("page_id").alias("file_name")).distinct()
    cats = spark.createDataFrame([(i, c) for i, c in enumerate(["stamps", "lines", "crosses", "circles"])], "id long, name string")
    ann = pages.select(F.col("page_id").alias("image_id"), F.explode("visual_marks").alias("m")).select("image_id", "m.bbox", F.col("m.mark_type").alias("name"))
    ann = ann.join(F.broadcast(cats.select(F.col("id").alias("category_id"), "name")), "name").drop("name")
    b = F.col("bbox")
    return annotated(ann, images, cats).groupBy("category").agg(F.count("*").alias("n"), F.countDistinct("file_name").alias("n_images"), F.sum(b[2] * b[3]).alias("area"))


@R.add(f"WITH {LATEST}, {_TEXTS} SELECT page_id, region_id, round(greatest(tb[1] - tb[3] * 0.1, 0)::DOUBLE, 4) AS x, round(greatest(tb[2] - tb[4] * 0.1, 0)::DOUBLE, 4) AS y, round((least(tb[1] + tb[3] * 1.1, 2480) - greatest(tb[1] - tb[3] * 0.1, 0))::DOUBLE, 4) AS w, round((least(tb[2] + tb[4] * 1.1, 3508) - greatest(tb[2] - tb[4] * 0.1, 0))::DOUBLE, 4) AS h FROM texts")
def expanded_boxes(spark, d):
    """Regions grown by a tenth."""
    e = expanded(F.col("bbox"), 0.1, 2480, 3508)
    return text_boxes(spark, d).select("page_id", "region_id", *[F.round(e[i], 4).alias(n) for i, n in enumerate("xywh")])


@R.add()
def placed_regions(spark, d):
    """Regions placed one after the other on free ground."""
    return free_places(text_boxes(spark, d), "page_id", "region_id", "bbox", 250, 0.4, 2480, 3508, "page_id string, region_id string")


@R.add(f"WITH {LATEST}, {_TEXTS} SELECT page_id, region_id, CASE WHEN tb[3] >= 4 THEN tb[1] ELSE NULL END AS x0, CASE WHEN tb[3] >= 4 THEN tb[1] + tb[3] // 4 ELSE NULL END AS x1, CASE WHEN tb[3] >= 4 THEN tb[1] + tb[3] - tb[3] // 4 ELSE NULL END AS x2, CASE WHEN tb[3] >= 4 THEN tb[1] + tb[3] ELSE NULL END AS x3 FROM texts")
def polygon_scanlines(spark, d):
    """Where the middle line of a region crosses its outline."""
    b = F.col("bbox")
    df = text_boxes(spark, d).select("page_id", "region_id", G.polygon_of_box(b).cast("array<double>").alias("p"), (b[1] + F.floor(b[3] / 2)).alias("y"))
    # the box with a hole of half its width: two intervals, by the even-odd rule over both parts
    p, q = F.col("p"), F.floor((F.col("p")[2] - F.col("p")[0]) / 4).cast("double")
    hole = F.array(p[0] + q, p[1], p[2] - q, p[1], p[2] - q, p[5], p[0] + q, p[5])
    i = F.col("i")
    found = df.select("page_id", "region_id", scanline(F.array(p, hole, F.array(p[0], p[1])), F.col("y")).alias("i"))
    return found.select("page_id", "region_id", F.get(F.get(i, F.lit(0)), F.lit(0)).alias("x0"), F.get(F.get(i, F.lit(0)), F.lit(1)).alias("x1"), F.get(F.get(i, F.lit(1)), F.lit(0)).alias("x2"), F.get(F.get(i, F.lit(1)), F.lit(1)).alias("x3"))


@R.add("WITH e AS (SELECT event_id, TRY_CAST(regexp_extract(props, '\\{[\\s\\S]*\\}', 0) AS JSON) AS j FROM events) SELECT event_id, json_extract_string(j, '$.' || (json_keys(j))[1]) AS value FROM e WHERE j IS NOT NULL AND len(json_keys(j)) > 0")
def lenient_json(spark, d):
    """the first value of JSON that stands between fences and has a comma too many."""
    noisy = F.concat(F.lit("Answer:\n```json\n"), F.regexp_replace("props", r"\}$", ",}"), F.lit("\n```"))
    j = T.json_object(noisy)
    key = F.element_at(F.json_object_keys(j), 1)
    m = F.from_json(j, "map<string,string>")
    return scan(spark, d, "events").select("event_id", j.alias("j")).where("j is not null and size(json_object_keys(j)) > 0").select("event_id", F.element_at(F.from_json("j", "map<string,string>"), F.element_at(F.json_object_keys("j"), 1)).alias("value"))


@R.add("SELECT sample_id, trim(array_to_string(list_filter(string_split(ground_truth || chr(10) || 'Transcribe the text exactly as it stands', chr(10)), lambda x: NOT contains(lower(x), 'transcribe the text exactly') AND NOT contains(lower(x), 'the text exactly as') AND NOT contains(lower(x), 'text exactly as it') AND NOT contains(lower(x), 'exactly as it stands')), chr(10))) AS text FROM transcription_samples WHERE ground_truth IS NOT NULL")
def prompt_leaks(spark, d):
    """transcriptions without lines that repeat the instruction."""
    order = "Transcribe the text exactly as it stands"
    s = scan(spark, d, "transcription_samples").where("ground_truth is not null")
    return s.select("sample_id", T.strip_prompt_leak(F.concat("ground_truth", F.lit("\n" + order)), order).alias("text"))


@R.add("WITH w AS (SELECT sample_id, confidence, string_split(ground_truth, ' ') AS w FROM transcription_samples WHERE ground_truth IS NOT NULL), x AS (SELECT sample_id, confidence, unnest(w) AS word, generate_subscripts(w, 1) AS word_no FROM w) SELECT sample_id, CAST(word_no AS BIGINT) AS word_no, word, round(confidence, 6) AS confidence FROM x WHERE word <> ''")
def token_words(spark, d):
    """words put together again from pieces of three characters, with their confidence."""
    s = scan(spark, d, "transcription_samples").where("ground_truth is not null").select("sample_id", F.ln("confidence").alias("lp"), F.posexplode(F.split("ground_truth", " ")).alias("n", "w"))
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.length("w") - 1) / 3), F.lit(0)).cast("int")), lambda i: F.concat(F.when(i == 0, F.lit("▁")).otherwise(F.lit("")), F.substring("w", i * 3 + 1, F.lit(3))))
    t = s.select("sample_id", "lp", "n", F.posexplode(pieces).alias("k", "token")).withColumn("pos", F.col("n") * 1000 + F.col("k"))
    return word_groups(t, "sample_id", "pos", "token", "lp").where("word <> ''").select("sample_id", "word_no", "word", "confidence")


@R.add("SELECT template, mode, CAST(variant AS BIGINT) AS variant FROM (SELECT DISTINCT source_type AS template FROM records WHERE source_type IS NOT NULL), (VALUES ('clean'), ('worn'), ('stained')) m(mode), range(1, 1 + CAST(ceil(100.0 / (3 * (SELECT count(DISTINCT source_type) FROM records WHERE source_type IS NOT NULL))) AS BIGINT)) v(variant)")
def variant_tasks(spark, d):
    """Tasks of templates, modes and variants."""
    t = scan(spark, d, "records").select(F.col("source_type").alias("template")).where("template is not null").distinct()
    return variant_plan(t, ["clean", "worn", "stained"], 100).withColumn("variant", F.col("variant").cast("long"))


@R.add(f"WITH {LATEST}, {_TEXTS}, c AS (SELECT page_id, region_id, layer, text_conf > 0.8 AS a, o < 2 AS b, tb[3] > 1000 AS c FROM texts) SELECT layer, count(*) FILTER ((a AND b) OR (a AND c) OR (b AND c)) AS n_both, count(*) AS n FROM c GROUP BY layer")
def mask_votes(spark, d):
    """Where two of three conditions hold."""
    a, b, c = F.col("conf") > 0.8, F.col("o") < 2, F.col("bbox")[2] > 1000
    return text_boxes(spark, d).groupBy("layer").agg(F.count_if(two_of_three(a, b, c)).alias("n_both"), F.count("*").alias("n"))


@R.add(f"WITH {LATEST}, {_TEXTS}, px AS (SELECT page_id, tb[1] + tb[3] // 2 AS x, tb[2] + tb[4] // 2 AS y, text_conf AS p FROM texts), m AS (SELECT t.page_id, t.region_id, avg(p) AS mp FROM texts t JOIN px ON px.page_id = t.page_id AND x >= tb[1] AND x < tb[1] + tb[3] AND y >= tb[2] AND y < tb[2] + tb[4] GROUP BY ALL) "
       "SELECT t.page_id, t.region_id AS box_id, round(coalesce(mp, 0), 6) AS mean_p FROM texts t LEFT JOIN m ON m.page_id = t.page_id AND m.region_id = t.region_id")
def region_probability(spark, d):
    """Mean probability in a box; the middles of all regions of a page stand for its pixels."""
    t = text_boxes(spark, d)
    px = t.select("page_id", F.expr("bbox[0] + bbox[2] div 2").alias("x"), F.expr("bbox[1] + bbox[3] div 2").alias("y"), F.col("conf").alias("p"))
    return mean_in_box(px, t.select("page_id", F.col("region_id").alias("box_id"), "bbox"), "page_id")


@R.add(f"WITH {LATEST}, {_TEXTS}, v AS (SELECT page_id, tb[1] // 100 AS cx, tb[2] // 100 AS cy, text_conf AS v, tb[3] * 1.0::DOUBLE AS w FROM texts) SELECT page_id, CAST(cx AS BIGINT) AS cx, CAST(cy AS BIGINT) AS cy, round(sum(v * w) / greatest(sum(w), 1e-8), 6) AS v FROM v GROUP BY ALL")
def stitched_patches(spark, d):
    """Values that overlap averaged by weight."""
    p = text_boxes(spark, d).select("page_id", F.expr("bbox[0] div 100").alias("cx"), F.expr("bbox[1] div 100").alias("cy"), F.col("conf").alias("v"), F.col("bbox")[2].cast("double").alias("w"))
    return stitched(p, ["page_id", "cx", "cy"]).withColumn("v", F.round("v", 6))


QUERIES, SQL = R.queries, R.sql
