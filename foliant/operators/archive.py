"""The archive's tables as the other operators take them: the latest version of every record, its retrieval text and
metadata, and what its identifiers say."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from foliant.functions import text as T
from foliant.operators.orphans import iso_micros
from foliant.plans.registry import Registry
from foliant.plans.staging import scan

R = Registry()


def upsert_latest(df: DataFrame, key: str, *order: str) -> DataFrame:
    """One row a key: the one with the greatest order columns [B2, I7]. Spark keeps one row a key and task before the exchange
    (WindowGroupLimit), so a hot key is no burden, and columns that nobody reads later are never scanned."""
    w = W.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("__place", F.row_number().over(w)).where("__place = 1").drop("__place")


def latest_records(spark: SparkSession, d: str) -> DataFrame:
    """Records without superseded versions."""
    df = scan(spark, d, "records").withColumn("made_text", F.col("provenance.created_at")).withColumn("made", iso_micros("made_text"))
    return upsert_latest(df, "record_id", "made", "made_text")


LATEST = """latest AS (SELECT * FROM records QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY
    epoch_us(CAST(provenance.created_at AS TIMESTAMPTZ)) DESC, provenance.created_at DESC) = 1)"""


def retrieval_text() -> F.Column:
    """Five labelled lines, then the lists that aren't empty [C1]."""
    def listed(label: str, items, sep: str = ", "):
        kept = F.filter(F.coalesce(items, F.array().cast("array<string>")), lambda v: v.isNotNull() & (v != ""))
        return F.when(F.size(kept) > 0, F.concat(F.lit(label), F.array_join(kept, sep)))

    def line(label: str, c):
        return F.concat(F.lit(label), F.coalesce(c, F.lit("")))

    return F.concat_ws(
        "\n", line("Title: ", F.col("title")), line("Retrieval text: ", F.col("retrieval_text")), line("Summary: ", F.col("summary.short_description")),
        line("OCR text: ", F.col("ocr.full_text")), line("Source image path: ", F.col("provenance.source_image_path")),
        listed("Summary keywords: ", F.col("summary.keywords")), listed("Entities: ", F.col("entities.text")),
        listed("Visual marks: ", F.col("visual_marks.mark_type")), listed("Linked text spans: ", F.col("linked_text_spans.text"), " | "),
        listed("Forensic alerts: ", F.col("forensic_flags.alerts")))


def csv(c) -> F.Column:
    """A list as text with commas; null stays null."""
    return F.when(c.isNotNull(), F.concat_ws(",", c))


def metadata_columns(df: DataFrame) -> list:
    """The flat metadata of a record [C2]; a boolean becomes the text true or false, a field that ``df`` doesn't have is null, a
    list of texts that it doesn't have is empty."""
    def text(path: str):
        at = df.schema
        for part in path.split("."):
            if not hasattr(at, "names") or part not in at.names:
                return F.lit(None).cast("string")
            at = at[part].dataType
        return csv(F.col(path)) if at.typeName() == "array" else F.col(path)

    def named(path: str, name: str | None = None):
        return text(path).alias(name or path.split(".")[-1])

    review = F.col("forensic_flags.human_review_required")
    return [named(c) for c in ("record_id", "document_id", "page_id", "region_id", "unit_type", "source_type", "collection_id", "collection_name", "title", "date_created", "language", "creator", "contributors")] + [
        named(f"archival_metadata.{c}") for c in ("repository", "institution", "fonds", "series", "call_number")] + [
        named("physical_metadata.file_name"), named("provenance.source_image_path"), named("ocr.confidence_score", "ocr_confidence_score"), named("forensic_flags.confidence_score", "forensic_confidence_score"),
        named("forensic_flags.verification_status"), named("forensic_flags.uncertainty_state"), F.when(review, "true").when(~review, "false").alias("human_review_required"),
        F.concat_ws(",", "forensic_flags.alerts").alias("alerts"), F.concat_ws(",", F.filter("entities.text", lambda v: v != "")).alias("entity_texts"),
        F.concat_ws(",", F.filter("visual_marks.mark_type", lambda v: v != "")).alias("mark_types"), F.coalesce(text("ai_metadata.detected_topics"), F.lit("")).alias("topic_texts")]


def archival_block(doc_id, collection_id: str, collection_name: str, fonds: str, series: str, institution: str, repository: str) -> list:
    """The archival metadata of a document: what holds for the collection, its epoch and its call number [F8]."""
    year = T.document_year(doc_id)
    given = dict(collection_id=collection_id, collection_name=collection_name, fonds=fonds, series=series, institution=institution, repository=repository)
    return [F.lit(v).alias(k) for k, v in given.items()] + [T.epoch(year).alias("epoch"), doc_id.alias("call_number")]


def synthetic_text() -> F.Column:
    """The retrieval text of generated records [C3]."""
    listed = lambda c: F.coalesce(F.nullif(F.concat_ws(", ", c), F.lit("")), F.lit("none"))
    none = lambda c: F.coalesce(F.col(c), F.lit(""))
    return F.concat(none("title"), F.lit(". "), none("summary.short_description"), F.lit(". OCR text: "), none("ocr.full_text"), F.lit(" Entities: "), listed("entities.text"),
                    F.lit(". Detected marks: "), listed("visual_marks.mark_type"), F.lit("."))


@R.add(f"WITH {LATEST} SELECT record_id, made, unit_type FROM (SELECT record_id, epoch_us(CAST(provenance.created_at AS TIMESTAMPTZ)) AS made, unit_type FROM latest)")
def latest_upsert(spark, d):
    """B2: the latest version of every record."""
    return latest_records(spark, d).select("record_id", "made", "unit_type")


_LIST = "array_to_string(list_filter({0}, lambda x: x IS NOT NULL AND x <> ''), '{1}')"
_LINE = "CASE WHEN len(list_filter(coalesce({0}, []), lambda x: x IS NOT NULL AND x <> '')) > 0 THEN '{2}' || " + _LIST + " END"


@R.add(f"""WITH {LATEST} SELECT record_id, concat_ws(chr(10), 'Title: ' || coalesce(title, ''), 'Retrieval text: ' || coalesce(retrieval_text, ''),
    'Summary: ' || coalesce(summary.short_description, ''), 'OCR text: ' || coalesce(ocr.full_text, ''),
    'Source image path: ' || coalesce(provenance.source_image_path, ''), {_LINE.format('summary.keywords', ', ', 'Summary keywords: ')},
    {_LINE.format('list_transform(entities, lambda e: e.text)', ', ', 'Entities: ')}, {_LINE.format('list_transform(visual_marks, lambda e: e.mark_type)', ', ', 'Visual marks: ')},
    {_LINE.format('list_transform(linked_text_spans, lambda e: e.text)', ' | ', 'Linked text spans: ')},
    {_LINE.format('forensic_flags.alerts', ', ', 'Forensic alerts: ')}) AS retrieval_text FROM latest""")
def retrieval_texts(spark, d):
    """The text of a record that is searched."""
    return latest_records(spark, d).select("record_id", retrieval_text().alias("retrieval_text"))


_ABSENT = ", ".join(f"CAST(NULL AS VARCHAR) AS {c}" for c in ("collection_id", "collection_name", "creator", "contributors", "repository", "institution", "fonds", "series", "call_number", "file_name", "uncertainty_state"))


@R.add(f"""WITH {LATEST} SELECT record_id, document_id, page_id, region_id, unit_type, source_type, title, date_created,
    CASE WHEN language IS NOT NULL THEN coalesce(array_to_string(list_filter(language, lambda x: x IS NOT NULL), ','), '') END AS language,
    {_ABSENT}, '' AS topic_texts, provenance.source_image_path AS source_image_path, ocr.confidence_score AS ocr_confidence_score,
    forensic_flags.confidence_score AS forensic_confidence_score, forensic_flags.verification_status AS verification_status,
    CASE forensic_flags.human_review_required WHEN true THEN 'true' WHEN false THEN 'false' END AS human_review_required,
    coalesce(array_to_string(list_filter(forensic_flags.alerts, lambda x: x IS NOT NULL), ','), '') AS alerts,
    coalesce(array_to_string(list_filter(list_transform(entities, lambda e: e.text), lambda x: x <> ''), ','), '') AS entity_texts,
    coalesce(array_to_string(list_filter(list_transform(visual_marks, lambda e: e.mark_type), lambda x: x <> ''), ','), '') AS mark_types FROM latest""")
def record_metadata(spark, d):
    """The flat metadata of a record, all 29 fields; those the table doesn't have are null."""
    df = latest_records(spark, d)
    return df.select(*metadata_columns(df))


@R.add(f"""WITH {LATEST} SELECT record_id, coalesce(title, '') || '. ' || coalesce(summary.short_description, '') || '. OCR text: ' || coalesce(ocr.full_text, '') || ' Entities: ' ||
    coalesce(nullif(array_to_string(list_filter(list_transform(entities, lambda e: e.text), lambda x: x IS NOT NULL), ', '), ''), 'none') || '. Detected marks: ' ||
    coalesce(nullif(array_to_string(list_filter(list_transform(visual_marks, lambda e: e.mark_type), lambda x: x IS NOT NULL), ', '), ''), 'none') || '.' AS text FROM latest""")
def synthetic_texts(spark, d):
    """The text of generated records."""
    return latest_records(spark, d).select("record_id", synthetic_text().alias("text"))


_EPOCH_SQL = "CASE WHEN {0} >= 1924 AND {0} < 1931 THEN 'monarchy' WHEN {0} >= 1931 AND {0} < 1936 THEN 'republic' WHEN {0} >= 1936 AND {0} < 1939 THEN 'war' WHEN {0} >= 1939 AND {0} < 1954 THEN 'francoist' ELSE 'unknown' END"
_PARSED = r"""parsed AS (SELECT DISTINCT id, TRY_CAST(nullif(regexp_extract(id, 'a(\d{4})m(\d{1,2})(?:d(\d{1,2}))?', 1), '') AS INTEGER) AS year,
    TRY_CAST(nullif(regexp_extract(id, 'a(\d{4})m(\d{1,2})(?:d(\d{1,2}))?', 2), '') AS INTEGER) AS month,
    TRY_CAST(nullif(regexp_extract(id, 'a(\d{4})m(\d{1,2})(?:d(\d{1,2}))?', 3), '') AS INTEGER) AS day FROM harvest_index)"""


@R.add(f"""WITH {_PARSED} SELECT id, year, month, day, {_EPOCH_SQL.format('year')} AS epoch,
    'Radio Costaclara - ' || CASE WHEN month BETWEEN 1 AND 12 THEN (['enero', 'febrero', 'marzo', 'abril', 'mayo', 'junio', 'julio', 'agosto', 'septiembre', 'octubre',
        'noviembre', 'diciembre'])[month] ELSE CAST(month AS VARCHAR) END || ' ' || CAST(year AS VARCHAR) AS title,
    CASE WHEN year IS NOT NULL THEN printf('%04d-%02d-%02d', year, month, coalesce(day, 1)) END AS date FROM parsed""")
def document_identifiers(spark, d):
    """Date, title and epoch of document identifiers; null without a date in them."""
    c = F.col("id")
    return scan(spark, d, "harvest_index").select("id").distinct().select(
        "id", T.document_year(c).alias("year"), T.document_month(c).alias("month"), T.document_day(c).alias("day"), T.epoch(T.document_year(c)).alias("epoch"),
        T.document_title(c).alias("title"), F.when(T.document_year(c).isNotNull(), T.document_date(c)).alias("date"))


@R.add(f"""WITH {_PARSED} SELECT id, 'cc' AS collection_id, 'Costaclara' AS collection_name, 'Guiones' AS fonds, 'Emisiones' AS series, 'Archivo' AS institution, 'Depósito' AS repository,
    {_EPOCH_SQL.format('year')} AS epoch, id AS call_number FROM parsed""")
def archival_blocks(spark, d):
    """F8: archival metadata of every document."""
    ids = scan(spark, d, "harvest_index").select("id").distinct()
    return ids.select("id", *archival_block(F.col("id"), "cc", "Costaclara", "Guiones", "Emisiones", "Archivo", "Depósito"))


@R.add(f"""WITH {_PARSED}, e AS (SELECT {_EPOCH_SQL.format('year')} AS epoch FROM parsed)
    SELECT coalesce(epoch, '__all__') AS epoch, count(*) AS n_documents FROM e GROUP BY ROLLUP (epoch)""")
def epoch_rollup(spark, d):
    """Documents of each epoch and of all (``__all__``)."""
    df = scan(spark, d, "harvest_index").select("id").distinct().select(T.epoch(T.document_year(F.col("id"))).alias("epoch"))
    return df.rollup("epoch").agg(F.count("*").alias("n_documents")).withColumn("epoch", F.coalesce("epoch", F.lit("__all__")))


@R.add(r"""SELECT DISTINCT ocr.language AS label, array_to_string(list_sort(list_distinct(CASE
    WHEN len(regexp_extract_all(lower(trim(ocr.language)), '[a-z]{3}')) > 0 THEN regexp_extract_all(lower(trim(ocr.language)), '[a-z]{3}')
    WHEN trim(ocr.language) <> '' THEN [lower(trim(ocr.language))] ELSE [] END)), '|') AS codes FROM records WHERE ocr.language IS NOT NULL""")
def label_codes(spark, d):
    """codes in a language label."""
    labels = scan(spark, d, "records").select(F.col("ocr.language").alias("label")).where("label is not null").distinct()
    return labels.select("label", F.array_join(T.language_codes(F.col("label")), "|").alias("codes"))


@R.add(r"""SELECT DISTINCT id, link, regexp_replace(string_split(link, '/')[-1], '[<>:"/\\|?*]', '_', 'g') AS file_name,
    CASE WHEN link LIKE '%://%' THEN link ELSE 'https://repo.example.invalid/' || ltrim(link, '/') END AS url
    FROM (SELECT id, unnest(pdf_links) AS link FROM harvest_index) WHERE link IS NOT NULL""")
def link_files(spark, d):
    """file names and absolute URLs of links."""
    links = scan(spark, d, "harvest_index").select("id", F.explode("pdf_links").alias("link")).where("link is not null").distinct()
    return links.select("id", "link", T.url_file(F.col("link")).alias("file_name"), T.resolve_url("https://repo.example.invalid", F.col("link")).alias("url"))


@R.add(r"""SELECT DISTINCT page_id, regexp_replace(regexp_replace(regexp_replace(f, '\.[A-Za-z0-9]+$', ''), '(?i)_t\d+.*$', ''), '(?i)_(input|label|mask)$', '') AS stem,
    TRY_CAST(nullif(regexp_extract(page_id, '_p(\d+)$', 1), '') AS INTEGER) AS page_index
    FROM (SELECT page_id, string_split(provenance.source_image_path, '/')[-1] AS f FROM records WHERE provenance.source_image_path IS NOT NULL)""")
def page_stems(spark, d):
    """Stem and number of pages."""
    df = scan(spark, d, "records").select("page_id", F.element_at(F.split("provenance.source_image_path", "/"), -1).alias("f")).where("f is not null").distinct()
    return df.select("page_id", T.page_stem(F.col("f")).alias("stem"), T.page_index(F.col("page_id")).alias("page_index")).distinct()


_MARC = ["<record><controlfield tag=\"001\">", "</controlfield><datafield tag=\"245\"><subfield code=\"a\">", "</subfield></datafield><datafield tag=\"260\"><subfield code=\"c\">",
         "</subfield></datafield>", "</record>"]


def marc_record(xml: str) -> list:
    """id, title, year and PDF links of a MARC record [F1, A7]; a missing value is ``unknown``."""
    def field(tag: str, code: str) -> str:
        return f"/record/datafield[@tag=\"{tag}\"]/subfield[@code=\"{code}\"]/text()"

    x = F.col(xml)
    text = lambda path: F.nullif(F.xpath_string(x, F.lit(path)), F.lit(""))
    year = F.coalesce(*[F.nullif(F.regexp_extract(F.coalesce(text(field(*f)), F.lit("")), r"(19\d{2})", 1), F.lit("")) for f in (("260", "c"), ("245", "a"))], F.lit("unknown"))
    links = F.filter(F.xpath(x, F.lit(field("856", "u"))), lambda u: F.endswith(F.lower(u), F.lit(".pdf")))
    return [text("/record/controlfield[@tag=\"001\"]/text()").alias("id"), F.coalesce(text(field("245", "a")), F.lit("unknown")).alias("title"),
            year.alias("year"), F.array_join(links, "|").alias("links")]


@R.add(r"""SELECT DISTINCT id, coalesce(nullif(title, ''), 'unknown') AS title,
    coalesce(nullif(regexp_extract(coalesce(year, ''), '(19\d{2})', 1), ''), nullif(regexp_extract(coalesce(title, ''), '(19\d{2})', 1), ''), 'unknown') AS year,
    coalesce(array_to_string(list_filter(coalesce(pdf_links, []), lambda u: lower(u) LIKE '%.pdf'), '|'), '') AS links FROM harvest_index""")
def marc_extract(spark, d):
    """Fields of MARC records, here written from the harvest index and parsed again."""
    h = scan(spark, d, "harvest_index")
    esc = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    urls = F.array_join(F.transform(F.coalesce("pdf_links", F.array().cast("array<string>")), lambda u: F.concat(F.lit("<datafield tag=\"856\"><subfield code=\"u\">"), esc(u), F.lit("</subfield></datafield>"))), "")
    xml = F.concat(F.lit(_MARC[0]), esc(F.col("id")), F.lit(_MARC[1]), esc(F.col("title")), F.lit(_MARC[2]), esc(F.col("year")), F.lit(_MARC[3]), urls, F.lit(_MARC[4]))
    return h.select(xml.alias("xml")).select(*marc_record("xml")).distinct()


# The fields a record must have, on three levels.
REQUIRED = ["schema_version", "record_id", "document_id", "unit_type", "source_type", "retrieval_text", "forensic_flags", "provenance"]
REQUIRED_FORENSIC = ["confidence_score", "verification_status", "uncertainty_state"]
REQUIRED_PROVENANCE = ["source_image_path"]


def record_errors(df: DataFrame, version: str = "1.0") -> F.Column:
    """What is wrong with a record, as a list of messages in the order of the rules [C18]. A field that ``df`` doesn't have, or that
    is null, is missing."""
    def value(path: str):
        at = df.schema
        for part in path.split("."):
            if not hasattr(at, "names") or part not in at.names:
                return F.lit(None)
            at = at[part].dataType
        return F.col(path)

    has = lambda path: value(path).isNotNull()
    one_of = lambda c, *values: F.coalesce(c.isin(*values), F.lit(False))
    score = lambda c: F.coalesce(c.between(0, 1), F.lit(False))
    missing = [F.when(~has(c), f"Missing top-level field: {c}") for c in REQUIRED]
    missing += [F.when(~has(f"forensic_flags.{c}"), f"Missing forensic_flags field: {c}") for c in REQUIRED_FORENSIC]
    missing += [F.when(~has(f"provenance.{c}"), f"Missing provenance field: {c}") for c in REQUIRED_PROVENANCE]
    return F.array_compact(F.array(
        *missing, F.when(~one_of(value("schema_version"), version), f"schema_version must be {version}"), F.when(~one_of(value("unit_type"), "page", "region"), "unit_type must be page or region"),
        F.when(~one_of(value("forensic_flags.verification_status"), "verified", "uncertain"), "verification_status invalid"),
        F.when(~score(value("forensic_flags.confidence_score")), "forensic confidence_score must be between 0 and 1"), F.when(~score(value("ocr.confidence_score")), "ocr confidence_score must be between 0 and 1")))


_MISSING = ", ".join(f"CASE WHEN {c} IS NULL THEN 'Missing top-level field: {c}' END" for c in REQUIRED[1:])


@R.add(f"""WITH {LATEST}, e AS (SELECT record_id, list_filter([{_MISSING},
    CASE WHEN forensic_flags.confidence_score IS NULL THEN 'Missing forensic_flags field: confidence_score' END, CASE WHEN forensic_flags.verification_status IS NULL THEN 'Missing forensic_flags field: verification_status' END,
    'Missing forensic_flags field: uncertainty_state', CASE WHEN provenance.source_image_path IS NULL THEN 'Missing provenance field: source_image_path' END,
    CASE WHEN NOT coalesce(unit_type IN ('page', 'region'), false) THEN 'unit_type must be page or region' END,
    CASE WHEN NOT coalesce(forensic_flags.verification_status IN ('verified', 'uncertain'), false) THEN 'verification_status invalid' END,
    CASE WHEN NOT coalesce(forensic_flags.confidence_score BETWEEN 0 AND 1, false) THEN 'forensic confidence_score must be between 0 and 1' END,
    CASE WHEN NOT coalesce(ocr.confidence_score BETWEEN 0 AND 1, false) THEN 'ocr confidence_score must be between 0 and 1' END], lambda x: x IS NOT NULL) AS errors FROM latest)
    SELECT record_id, array_to_string(errors, '; ') AS errors FROM e WHERE len(errors) > 0""")
def record_validation(spark, d):
    """Records that break a rule; the table has no uncertainty_state, which every record is told."""
    df = latest_records(spark, d).withColumn("schema_version", F.lit("1.0"))
    return df.select("record_id", record_errors(df).alias("errors")).where(F.size("errors") > 0).select("record_id", F.array_join("errors", "; ").alias("errors"))


def forensic_flags(text_confidence, marks, year, degraded) -> F.Column:
    """The flags of a record from the confidence of its text and its marks (structs with confidence_score, mark_type, description),
    its year and whether the page is degraded [C14, C19]; alerts in order, scores to two digits."""
    scores = F.transform(marks, lambda m: m["confidence_score"])
    mean = F.when(F.size(scores) > 0, F.aggregate(scores, F.lit(0.0), lambda s, v: s + v) / F.size(scores)).otherwise(0.9)
    average = F.round((text_confidence + mean) / 2 + 1e-9, 2)
    average = F.when(degraded, F.round(F.greatest(F.lit(0.35), average - 0.12) + 1e-9, 2)).otherwise(average)
    sure = F.coalesce(average >= 0.8, F.lit(False))
    alerts = F.array_compact(F.array(
        F.when(F.exists(marks, lambda m: F.contains(F.lower(F.coalesce(m["description"], F.lit(""))), F.lit("intervención"))), "FRANCOIST_ADMINISTRATIVE_MARK"),
        F.when(~sure, "HUMAN_REVIEW_NEEDED"), F.when(text_confidence < 0.7, "LOW_OCR_CONFIDENCE"), F.when(F.exists(marks, lambda m: m["confidence_score"] < 0.6), "LOW_VISUAL_CONFIDENCE"),
        F.when(year.between(1936, 1939) & F.exists(marks, lambda m: m["mark_type"].isin("censorship_stamp", "crossed_out_text")), "POLITICALLY_SENSITIVE_CONTENT")))
    return F.struct(average.alias("confidence_score"), F.when(sure, "verified").otherwise("uncertain").alias("verification_status"),
                    F.when(sure, "none").otherwise("pending_reconstruction").alias("uncertainty_state"), alerts.alias("alerts"), (~sure).alias("human_review_required"))


_SCORED = r"""s0 AS (SELECT record_id, ocr.confidence_score AS o, coalesce(visual_marks, []) AS m, coalesce(contains(page_id, '_p0007'), false) AS degraded,
        TRY_CAST(nullif(regexp_extract(document_id, 'a(\d{4})m(\d{1,2})(?:d(\d{1,2}))?', 1), '') AS INTEGER) AS year FROM latest),
    s1 AS (SELECT *, round((o + coalesce(list_avg(list_transform(m, lambda x: x.confidence_score)), 0.9)) / 2 + 1e-9, 2) AS avg0 FROM s0),
    s2 AS (SELECT *, CASE WHEN degraded THEN round(greatest(0.35, avg0 - 0.12) + 1e-9, 2) ELSE avg0 END AS score FROM s1)"""


@R.add(f"""WITH {LATEST}, {_SCORED} SELECT record_id, score, CASE WHEN score >= 0.8 THEN 'verified' ELSE 'uncertain' END AS verification_status,
    CASE WHEN score >= 0.8 THEN 'none' ELSE 'pending_reconstruction' END AS uncertainty_state, NOT coalesce(score >= 0.8, false) AS human_review_required,
    concat_ws(',', CASE WHEN len(list_filter(m, lambda x: contains(lower(coalesce(x.description, '')), 'intervención'))) > 0 THEN 'FRANCOIST_ADMINISTRATIVE_MARK' END,
        CASE WHEN score < 0.8 OR score IS NULL THEN 'HUMAN_REVIEW_NEEDED' END, CASE WHEN o < 0.7 THEN 'LOW_OCR_CONFIDENCE' END,
        CASE WHEN len(list_filter(m, lambda x: x.confidence_score < 0.6)) > 0 THEN 'LOW_VISUAL_CONFIDENCE' END,
        CASE WHEN year BETWEEN 1936 AND 1939 AND len(list_filter(m, lambda x: x.mark_type IN ('censorship_stamp', 'crossed_out_text'))) > 0 THEN 'POLITICALLY_SENSITIVE_CONTENT' END) AS alerts FROM s2""")
def forensic_scores(spark, d):
    """A record's flags from its text and marks; here the seventh pages are taken as degraded."""
    df = latest_records(spark, d).withColumn("m", F.coalesce("visual_marks", F.array().cast(latest_records(spark, d).schema["visual_marks"].dataType)))
    flags = forensic_flags(F.col("ocr.confidence_score"), F.col("m"), T.document_year(F.col("document_id")), F.coalesce(F.contains("page_id", F.lit("_p0007")), F.lit(False)))
    df = df.select("record_id", flags.alias("f"))
    return df.select("record_id", F.col("f.confidence_score").alias("score"), "f.verification_status", "f.uncertainty_state", "f.human_review_required", F.concat_ws(",", "f.alerts").alias("alerts"))


@R.add(f"""WITH {LATEST} SELECT document_id, count(DISTINCT page_id) AS n_pages, array_to_string(list_sort(list(DISTINCT page_id)), ',') AS pages
    FROM latest WHERE unit_type = 'page' GROUP BY document_id""")
def document_catalog(spark, d):
    """Documents with their pages in order."""
    pages = latest_records(spark, d).where("unit_type = 'page'").groupBy("document_id").agg(F.sort_array(F.collect_set("page_id")).alias("p"))
    return pages.select("document_id", F.size("p").cast("long").alias("n_pages"), F.array_join("p", ",").alias("pages"))


def layer(region_id) -> F.Column:
    """Layer by the beginning of a region id [C17]."""
    return F.when(F.startswith(region_id, F.lit("pr")), "printed").when(F.startswith(region_id, F.lit("hw")), "handwritten").otherwise("other")


@R.add(f"""WITH {LATEST}, r AS (SELECT document_id, page_id, region_id LIKE 'pr%' AS pr, reading_order AS o, region_id, ocr.full_text AS t FROM latest WHERE unit_type = 'region'),
    j AS (SELECT document_id, page_id, coalesce(string_agg(t, ' ' ORDER BY o, region_id) FILTER (pr AND t <> ''), '') AS printed_text,
        coalesce(string_agg(t, ' ' ORDER BY o, region_id) FILTER (NOT pr AND t <> ''), '') AS handwritten_text, count(*) FILTER (pr) AS n_printed, count(*) FILTER (NOT pr) AS n_handwritten
        FROM r GROUP BY ALL)
    SELECT p.document_id, p.page_id, p.title, coalesce(printed_text, '') AS printed_text, coalesce(handwritten_text, '') AS handwritten_text,
        coalesce(n_printed, 0) AS n_printed, coalesce(n_handwritten, 0) AS n_handwritten, coalesce(len(p.visual_marks), 0) AS n_marks, p.forensic_flags.confidence_score AS confidence
    FROM latest p LEFT JOIN j ON p.document_id = j.document_id AND p.page_id = j.page_id WHERE p.unit_type = 'page'""")
def page_details(spark, d):
    """Pages as the viewer reads them; other layers count as handwritten."""
    df = latest_records(spark, d)
    part = F.struct(F.col("reading_order").alias("o"), "region_id", F.col("ocr.full_text").alias("t"))
    printed = layer(F.col("region_id")) == "printed"
    joined = lambda c: F.array_join(F.transform(F.filter(F.array_sort(c), lambda x: x["t"] != ""), lambda x: x["t"]), " ")
    regions = df.where("unit_type = 'region'").groupBy("document_id", "page_id").agg(
        F.collect_list(F.when(printed, part)).alias("p"), F.collect_list(F.when(~printed, part)).alias("h"))
    regions = regions.select("document_id", "page_id", joined("p").alias("pt"), joined("h").alias("ht"), F.size("p").alias("np"), F.size("h").alias("nh"))
    pages = df.where("unit_type = 'page'").select("document_id", "page_id", "title", F.coalesce(F.size("visual_marks"), F.lit(0)).cast("long").alias("n_marks"),
                                                  F.col("forensic_flags.confidence_score").alias("confidence"))
    return pages.join(regions, ["document_id", "page_id"], "left").select(
        "document_id", "page_id", "title", F.coalesce("pt", F.lit("")).alias("printed_text"), F.coalesce("ht", F.lit("")).alias("handwritten_text"),
        F.coalesce("np", F.lit(0)).cast("long").alias("n_printed"), F.coalesce("nh", F.lit(0)).cast("long").alias("n_handwritten"), "n_marks", "confidence")


QUERIES, SQL = R.queries, R.sql
