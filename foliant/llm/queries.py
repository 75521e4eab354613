"""The pN_ queries of the problems that belong to this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import langid, leaks, lookalike, names, near_dup, ocr, split, tokens
from foliant.plans.staging import scan, stage


def _region_texts(spark: SparkSession, d: str) -> DataFrame:
    return scan(spark, d, "records").where("unit_type = 'region'").select(
        F.lit("full_text").alias("field_name"), F.col("record_id").alias("item_key"), F.col("ocr.full_text").alias("text"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of near-duplicate region texts and printed page texts."""
    pages = scan(spark, d, "page_detail").select(
        F.lit("printed_text").alias("field_name"), F.col("page_id").alias("item_key"), F.col("printed_text").alias("text"))
    return near_dup.near_duplicate_pairs(_region_texts(spark, d).unionByName(pages), "item_key", "text", shingle=3,
                                         threshold=0.6, min_words=40, group="field_name")


def _long_texts(spark: SparkSession, d: str) -> DataFrame:
    pages = scan(spark, d, "page_detail")
    parts = [scan(spark, d, "records").select(F.lit("records").alias("table_name"), F.lit("full_text").alias("field_name"),
                                              F.col("record_id").alias("item_key"), F.col("ocr.full_text").alias("text"))]
    parts += [pages.select(F.lit("page_detail").alias("table_name"), F.lit(c).alias("field_name"), F.col("page_id").alias("item_key"),
                           F.col(c).alias("text")) for c in ("printed_text", "handwritten_text")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Every long text as numbered pieces."""
    return split.split_texts(_long_texts(spark, d), ["table_name", "field_name", "item_key"], "text", only_long=True)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The texts that had to be cut."""
    return p2_pieces(spark, d).where("pieces > 1").select("table_name", "field_name", "item_key").distinct()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Spellings of mentions and the register entries they stand for."""
    mentions = scan(spark, d, "records").select(F.explode("entities.text").alias("text"))
    return names.link_spellings(mentions, "text", scan(spark, d, "authority_names"), "authority_id", "entity_type", "full_name")


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    """field_name, item_key, labels (codes), text of what problem 4 is about; repeated rows once."""
    regions = scan(spark, d, "records").where("unit_type = 'region'").select(
        F.lit("ocr.language").alias("field_name"), F.col("record_id").alias("item_key"),
        F.array_compact(F.array(langid.language_code(F.col("ocr.language")))).alias("labels"), F.col("ocr.full_text").alias("text"))
    pages = scan(spark, d, "page_detail").select(
        F.lit("page_detail.language").alias("field_name"), F.col("page_id").alias("item_key"),
        F.array_compact(F.transform(F.coalesce("language", F.array()), langid.language_code)).alias("labels"),
        F.concat_ws("\n\n", "printed_text", "handwritten_text").alias("text"))
    return regions.unionByName(pages)


def _language_model(spark: SparkSession, d: str) -> langid.Model | None:
    return langid.fit(scan(spark, d, "records").where("unit_type = 'region'").select(F.col("ocr.full_text").alias("text"), F.col("ocr.language").alias("label")),
                      "text", "label")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Languages a text has a sentence in and its label doesn't stand for."""
    model = _language_model(spark, d)
    if model is None:
        return spark.createDataFrame([], "field_name string, item_key string, lang string")
    found = langid.languages(_labelled(spark, d), ["field_name", "item_key", "labels"], "text", model)
    return found.where(~F.array_contains("labels", F.col("lang"))).select("field_name", "item_key", "lang").distinct()


def p4_stretches(spark: SparkSession, d: str) -> DataFrame:
    """Every stretch in one language of every text, with its confidence."""
    model = _language_model(spark, d)
    if model is None:
        return spark.createDataFrame([], "field_name string, item_key string, stretch_no int, start_pos int, end_pos int, lang string, confidence double, n_words int")
    return langid.stretches(_labelled(spark, d).drop("labels"), ["field_name", "item_key"], "text", model).distinct()


def _scanned(spark: SparkSession, d: str) -> DataFrame:
    """table_name, document_id, page_id, region_id, text of all regions, raw and recorded."""
    recorded = scan(spark, d, "records").where("unit_type = 'region'").select(
        F.lit("records").alias("table_name"), "document_id", "page_id", "region_id", F.col("ocr.full_text").alias("text"))
    raw = scan(spark, d, "transcribed_regions").select(
        F.lit("transcribed_regions").alias("table_name"), "document_id", "page_id", "region_id", F.col("full_text").alias("text"))
    return recorded.unionByName(raw)


_REGION = ["table_name", "page_id", "region_id"]


def _defects(spark: SparkSession, d: str):
    regions = _scanned(spark, d)
    texts = ocr.distinct_texts(regions, "text")
    words = stage(ocr.count_words(texts, "text"), "words")
    mentions = scan(spark, d, "records").select(F.explode("entities.text").alias("t")) \
        .unionByName(scan(spark, d, "authority_names").select(F.col("full_name").alias("t"))).distinct()
    names = mentions.select(F.explode(F.expr(r"regexp_extract_all(lower(t), '[\\p{L}\\p{N}]+([·-][\\p{L}\\p{N}]+)*', 0)")).alias("word"))
    fixes = stage(ocr.corrections(words, names, texts=texts), "corrections")
    headers = ocr.header_blocks(stage(ocr.header_stems(regions, "document_id", "page_id", "text"), "headers"))
    return regions, ocr.find_defects(regions, _REGION, "text", words, fixes, headers, "page_id"), headers


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Defects of scanned text."""
    return _defects(spark, d)[1].select(*_REGION, "defect", "word").distinct()


def p6_repaired(spark: SparkSession, d: str) -> DataFrame:
    """The regions' texts as continuous readable paragraphs."""
    regions, defects, headers = _defects(spark, d)
    return ocr.repair(regions, _REGION, "text", stage(defects, "defects-found"), headers, "page_id")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of every document."""
    return tokens.encode(scan(spark, d, "documents"), "doc_id", "text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold passages of evaluation lines."""
    return leaks.find_leaks(scan(spark, d, "documents"), "doc_id", "text", scan(spark, d, "transcription_samples"), "sample_id", "ground_truth")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that look the same and are stored differently."""
    return lookalike.same_look_pairs(scan(spark, d, "documents"), "doc_id", "text")


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_pieces": p2_pieces, "p3_found": p3_found, "p4_found": p4_found, "p4_stretches": p4_stretches, "p6_found": p6_found, "p6_repaired": p6_repaired, "p7_ids": p7_ids, "p8_found": p8_found, "p9_found": p9_found}

SQL = {
    "p2_found": """
        SELECT 'records' AS table_name, 'full_text' AS field_name, record_id AS item_key FROM records WHERE length(ocr.full_text) > 4000
        UNION SELECT 'page_detail', 'printed_text', page_id FROM page_detail WHERE length(printed_text) > 4000
        UNION SELECT 'page_detail', 'handwritten_text', page_id FROM page_detail WHERE length(handwritten_text) > 4000""",
}
