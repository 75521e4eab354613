"""Reports on the archive: index summary by epoch and document, histograms, harvest report, inverted groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators.archive import _EPOCH_SQL, LATEST, latest_records
from foliant.plans.registry import Registry
from foliant.plans.staging import scan

R = Registry()


def mean_score(c: Column) -> Column:
    """Mean of scores of four digits, to six: the sum is of integers, so it is the same in every order."""
    return F.floor(F.sum(F.round(c * 10000).cast("long")) / F.count(c) * 100 + 0.5) / 1000000


def bin_number(value: Column, bins: int, lo: float = 0.0, hi: float = 1.0) -> Column:
    """Fixed-width bin from 0, the last closed, null outside [E4]: edges are compared, not divided, so they fall as stated."""
    width = (hi - lo) / bins
    edges = F.array(*[F.lit(lo + i * width) for i in range(1, bins)])
    return F.when((value >= lo) & (value <= hi), F.aggregate(edges, F.lit(0), lambda s, e: s + F.when(value >= e, 1).otherwise(0)))


def histogram(df: DataFrame, value: str, bins: int = 10, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """(bin, center, n) with all bins, empty ones too [E4]."""
    n = df.select(bin_number(F.col(value), bins, lo, hi).alias("bin")).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"))
    width = (hi - lo) / bins
    return df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(n, "bin", "left").select(
        "bin", F.round(lo + (F.col("bin") + 0.5) * width, 6).alias("center"), F.coalesce("n", F.lit(0)).alias("n"))


def _bins_sql(value: str, bins: int) -> str:
    return "(" + " + ".join(f"CASE WHEN {value} >= {i * (1.0 / bins)!r}::DOUBLE THEN 1 ELSE 0 END" for i in range(1, bins)) + ")"


def _pages(spark, d):
    year = T.document_year(F.col("document_id"))
    ff = F.col("forensic_flags")
    return latest_records(spark, d).where("unit_type = 'page'").select(
        "document_id", "page_id", T.epoch(year).alias("epoch"), ff["confidence_score"].alias("conf"), ff["verification_status"].alias("status"), ff["human_review_required"].alias("review"),
        ff["alerts"].alias("alerts"), F.col("visual_marks.mark_type").alias("marks"))


_YEAR = r"TRY_CAST(nullif(regexp_extract(document_id, 'a(\d{4})m(\d{1,2})(?:d(\d{1,2}))?', 1), '') AS INTEGER)"
_PAGES = f"""{LATEST}, pages AS (SELECT document_id, page_id, {_EPOCH_SQL.format(_YEAR)} AS epoch, forensic_flags.confidence_score AS conf, forensic_flags.verification_status AS status,
    forensic_flags.human_review_required AS review, forensic_flags.alerts AS alerts, list_transform(visual_marks, lambda m: m.mark_type) AS marks FROM latest WHERE unit_type = 'page')"""


@R.add(f"WITH {_PAGES} SELECT coalesce(epoch, '__all__') AS epoch, count(*) AS n_pages, count(*) FILTER (status = 'verified') AS n_verified, count(*) FILTER (review) AS n_review, floor(sum(CAST(round(conf * 10000) AS BIGINT)) / count(conf) * 100 + 0.5) / 1000000 AS mean_conf, round(median(conf), 6) AS median_conf FROM pages GROUP BY ROLLUP (epoch)")
def index_summary(spark, d):
    """Pages, status, review and confidence of each epoch and of all."""
    return _pages(spark, d).rollup("epoch").agg(
        F.count("*").alias("n_pages"), F.count_if(F.col("status") == "verified").alias("n_verified"), F.count_if("review").alias("n_review"),
        mean_score(F.col("conf")).alias("mean_conf"), F.round(F.median("conf"), 6).alias("median_conf")).withColumn("epoch", F.coalesce("epoch", F.lit("__all__")))


@R.add(f"WITH {_PAGES} SELECT epoch, 'mark' AS what, m AS name, count(*) AS n FROM (SELECT epoch, unnest(marks) AS m FROM pages) WHERE m IS NOT NULL GROUP BY ALL UNION ALL SELECT epoch, 'alert', a, count(*) FROM (SELECT epoch, unnest(alerts) AS a FROM pages) WHERE a IS NOT NULL GROUP BY ALL")
def epoch_breakdown(spark, d):
    """Marks and alerts of each epoch."""
    p = _pages(spark, d)
    part = lambda what, c: p.select("epoch", F.lit(what).alias("what"), F.explode(c).alias("name"))
    return part("mark", "marks").unionByName(part("alert", "alerts")).where("name is not null").groupBy("epoch", "what", "name").agg(F.count("*").alias("n"))


@R.add(f"""WITH {_PAGES}, p AS (SELECT document_id, count(*) AS n_pages, sum(coalesce(len(marks), 0)) AS n_marks, floor(sum(CAST(round(conf * 10000) AS BIGINT)) / count(conf) * 100 + 0.5) / 1000000 AS c FROM pages GROUP BY document_id), r AS (SELECT document_id, count(*) AS n FROM latest WHERE unit_type = 'region' GROUP BY document_id)
    SELECT document_id, coalesce(n_pages, 0) AS n_pages, coalesce(n, 0) AS n_regions, CAST(coalesce(n_marks, 0) AS BIGINT) AS n_marks, coalesce(c, 0) AS mean_conf FROM p FULL JOIN r USING (document_id)""")
def document_breakdown(spark, d):
    """Pages, regions and marks of each document; one with regions only appears too. One aggregate, no join."""
    page = F.col("unit_type") == "page"
    df = latest_records(spark, d).groupBy("document_id").agg(
        F.count_if(page).alias("n_pages"), F.count_if(F.col("unit_type") == "region").alias("n_regions"), F.coalesce(F.sum(F.when(page, F.coalesce(F.size("visual_marks"), F.lit(0)))), F.lit(0)).cast("long").alias("n_marks"),
        F.coalesce(mean_score(F.when(page, F.col("forensic_flags.confidence_score"))), F.lit(0.0)).alias("mean_conf"))
    return df.where("n_pages + n_regions > 0")


@R.add(f"WITH {_PAGES}, h AS (SELECT {_bins_sql('conf', 10)} AS bin, count(*) AS n FROM pages WHERE conf BETWEEN 0 AND 1 GROUP BY 1) SELECT CAST(b AS INTEGER) AS bin, round((b + 0.5) * 0.1, 6)::DOUBLE AS center, coalesce(n, 0) AS n FROM range(10) t(b) LEFT JOIN h ON h.bin = b")
def confidence_histogram(spark, d):
    """Pages by confidence."""
    return histogram(_pages(spark, d), "conf")


@R.add(f"WITH {_PAGES}, c AS (SELECT p.page_id, count(r.record_id) AS n FROM pages p LEFT JOIN latest r ON r.unit_type = 'region' AND r.page_id = p.page_id GROUP BY p.page_id) SELECT CAST(least(n, 6) AS BIGINT) AS n_regions, count(*) AS n_pages FROM c GROUP BY 1")
def regions_per_page(spark, d):
    """Pages by their number of regions, six and more together; pages without any count as 0."""
    counts = latest_records(spark, d).where("unit_type = 'region'").groupBy("page_id").agg(F.count("*").alias("n"))
    return _pages(spark, d).join(counts, "page_id", "left").select(F.least(F.coalesce("n", F.lit(0)), F.lit(6)).alias("n_regions")).groupBy("n_regions").agg(F.count("*").alias("n_pages"))


_H = r"""h AS (SELECT DISTINCT id, year, languages, pdf_links FROM harvest_index), hy AS (SELECT *, TRY_CAST(CASE WHEN regexp_full_match(year, '[0-9]+') THEN year END AS INTEGER) AS y FROM h)"""


@R.add(f"""WITH {_H}, e AS (SELECT id, {_EPOCH_SQL.format('y')} AS epoch, languages, pdf_links FROM hy), l AS (SELECT epoch, string_agg(DISTINCT l, ',' ORDER BY l) AS languages FROM (SELECT epoch, unnest(languages) AS l FROM e) WHERE l IS NOT NULL GROUP BY epoch)
    SELECT e.epoch, count(DISTINCT id) AS n_documents, CAST(sum(coalesce(len(pdf_links), 0)) AS BIGINT) AS n_links, coalesce(max(l.languages), '') AS languages FROM e LEFT JOIN l ON l.epoch = e.epoch GROUP BY e.epoch""")
def harvest_report(spark, d):
    """Documents, links and languages of each epoch; a year that is no number has none."""
    h = scan(spark, d, "harvest_index").select("id", "year", "languages", "pdf_links").distinct()
    year = F.when(F.col("year").rlike("^[0-9]+$"), F.col("year")).try_cast("int")
    return h.withColumn("epoch", T.epoch(year)).groupBy("epoch").agg(
        F.countDistinct("id").alias("n_documents"), F.coalesce(F.sum(F.coalesce(F.size("pdf_links"), F.lit(0))), F.lit(0)).cast("long").alias("n_links"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.filter(F.coalesce("languages", F.array().cast("array<string>")), lambda v: v.isNotNull()))))), ",").alias("languages"))


@R.add(f"WITH {LATEST} SELECT kind, name, count(*) AS n, min(record_id) AS first_id, max(record_id) AS last_id FROM (SELECT 'status' AS kind, forensic_flags.verification_status AS name, record_id FROM latest UNION ALL SELECT 'title', title, record_id FROM latest UNION ALL "
       "SELECT DISTINCT 'mark', m, record_id FROM (SELECT record_id, unnest(list_transform(visual_marks, lambda m: m.mark_type)) AS m FROM latest)) WHERE name IS NOT NULL GROUP BY kind, name")
def inverted_groups(spark, d):
    """Records by status, title and mark. Only counts and the ends of each list are kept, so a value that a third of all
    records share moves one row a task."""
    df = latest_records(spark, d)
    pairs = df.select("record_id", F.explode(F.concat(F.array(F.struct(F.lit("status").alias("kind"), F.col("forensic_flags.verification_status").alias("name")), F.struct(F.lit("title").alias("kind"), F.col("title").alias("name"))),
                                                      F.transform(F.array_distinct(F.coalesce("visual_marks.mark_type", F.array().cast("array<string>"))), lambda m: F.struct(F.lit("mark").alias("kind"), m.alias("name"))))).alias("x"))
    return pairs.select("record_id", "x.kind", "x.name").where("name is not null").groupBy("kind", "name").agg(F.count("*").alias("n"), F.min("record_id").alias("first_id"), F.max("record_id").alias("last_id"))


@R.add("SELECT n_targets, count(*) AS n_questions FROM (SELECT question_id, max(coalesce(len(expected_record_ids), 0)) AS n_targets FROM eval_questions GROUP BY question_id) GROUP BY n_targets")
def target_sizes(spark, d):
    """Questions by the number of their targets."""
    q = scan(spark, d, "eval_questions").groupBy("question_id").agg(F.max(F.greatest(F.coalesce(F.size("expected_record_ids"), F.lit(0)), F.lit(0))).cast("long").alias("n_targets"))
    return q.groupBy("n_targets").agg(F.count("*").alias("n_questions"))


@R.add(f"WITH {LATEST} SELECT CASE WHEN ocr.confidence_score >= 0.8 THEN 'high' WHEN ocr.confidence_score >= 0.55 THEN 'medium' ELSE 'low' END AS band, count(*) AS n, round(avg(length(ocr.full_text)), 4) AS mean_chars, "
       "round(avg(CASE WHEN length(ocr.full_text) < 10 THEN 1.0::DOUBLE ELSE 0 END), 6) AS share_short, round(0.4 * avg(ocr.confidence_score) + 0.3 * least(avg(length(ocr.full_text)) / 300, 1) + 0.2 * (1 - avg(CASE WHEN length(ocr.full_text) < 10 THEN 1.0::DOUBLE ELSE 0 END)), 6) AS quality FROM latest WHERE unit_type = 'region' GROUP BY 1")
def confidence_bands(spark, d):
    """Texts by confidence band, with the parts of the quality score that the archive has (no timing)."""
    c, n = F.col("ocr.confidence_score"), F.length("ocr.full_text")
    band = F.when(c >= 0.8, "high").when(c >= 0.55, "medium").otherwise("low")
    short = F.avg(F.when(n < 10, 1.0).otherwise(0.0))
    return latest_records(spark, d).where("unit_type = 'region'").groupBy(band.alias("band")).agg(
        F.count("*").alias("n"), F.round(F.avg(n), 4).alias("mean_chars"), F.round(short, 6).alias("share_short"), F.round(0.4 * F.avg(c) + 0.3 * F.least(F.avg(n) / 300, F.lit(1.0)) + 0.2 * (1 - short), 6).alias("quality"))


QUERIES, SQL = R.queries, R.sql
