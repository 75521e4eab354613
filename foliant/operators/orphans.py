"""References to records that were not there at the time of the reference.

A Bloom filter of all parent keys (records and deletions), broadcast or, beyond a size, partitioned by hash, proves most
orphans without touching the parents; only references it lets through are checked exactly, by an as-of lookup of the last creation and the last deletion up
to the reference. The lookup works in two levels, inside a day and over the days of a key, so that no task holds
all events of a hot key: within a day they are spread by (key, day), over days a key has one row a day.

Defined cases: null and empty keys are no references; repeated rows count once; a reference with a null time can't
be placed and is no case; creations that can't be read as a time are none; without any parent all references are
``missing``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from foliant.operators import bloom
from foliant.plans.staging import scan, stage

_DAY = 86_400_000_000


def micros(column: str) -> Column:
    """Microseconds of a timestamp without zone, taken as UTC whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {column})")


def iso_micros(column: str) -> Column:
    """Microseconds of ISO text with an offset; text without one is taken as UTC; unreadable text is null."""
    zoned = F.expr(f"regexp_like({column}, '(Z|z|[+-][0-9]{{2}}:?([0-9]{{2}})?)$')")
    text = F.when(zoned, F.col(column)).otherwise(F.concat(F.col(column), F.lit("Z")))
    return F.unix_micros(text.try_cast("timestamp"))


def find_orphans(refs: DataFrame, created: DataFrame, deleted: DataFrame, max_keys: int = bloom.MAX_KEYS) -> DataFrame:
    """``refs`` (key, t, any columns more) with ``orphan_kind``, only where the record was not there at t.

    created, deleted: (key, t) in microseconds. Kinds: ``deleted`` if the last deletion up to t has no creation
    after it up to t; else ``missing`` if the key has no creation at all; else ``late`` if all creations are after t."""
    refs = stage(refs.where("key is not null and key <> '' and t is not null").distinct(), "orphan-refs")
    events = created.select("key", F.col("t").alias("c"), F.lit(None).cast("long").alias("d")) \
        .unionByName(deleted.select("key", F.lit(None).cast("long").alias("c"), F.col("t").alias("d"))) \
        .where("key is not null")
    marked = bloom.mark(refs, bloom.build(events, "key", max_keys), "key", "__maybe")
    sure = marked.where("not __maybe").drop("__maybe").withColumn("orphan_kind", F.lit("missing"))
    refs = marked.where("__maybe").drop("__maybe")
    day = lambda c: F.floor(c / F.lit(_DAY))
    events = events.where("c is not null or d is not null").withColumn("t", F.coalesce("c", "d")).withColumn("day", day(F.col("t"))) \
        .groupBy("key", "day", "t").agg(F.max("c").alias("c"), F.max("d").alias("d"))
    probes = refs.select("key", "t").distinct().withColumn("day", day(F.col("t")))

    none = F.lit(None).cast("long")
    both = events.withColumn("probe", F.lit(False)).unionByName(
        probes.select("key", "day", "t", none.alias("c"), none.alias("d"), F.lit(True).alias("probe")))
    upto = W.partitionBy("key", "day").orderBy("t").rangeBetween(W.unboundedPreceding, W.currentRow)
    within = both.select("key", "day", "t", "probe", F.max("c").over(upto).alias("c"), F.max("d").over(upto).alias("d")).where("probe")
    before = W.partitionBy("key").orderBy("day").rowsBetween(W.unboundedPreceding, -1)
    days = both.groupBy("key", "day").agg(F.max("c").alias("c"), F.max("d").alias("d"), F.max("probe").alias("probe")) \
        .select("key", "day", "probe", F.max("c").over(before).alias("c0"), F.max("d").over(before).alias("d0"),
                F.max("c").over(W.partitionBy("key")).isNotNull().alias("known")).where("probe").drop("probe")
    state = within.join(days, ["key", "day"]).select(
        "key", "t", F.greatest("c", "c0").alias("c"), F.greatest("d", "d0").alias("d"), "known")
    kind = F.when(F.col("d").isNotNull() & (F.col("c").isNull() | (F.col("c") <= F.col("d"))), "deleted") \
        .when(~F.col("known"), "missing").when(F.col("c").isNull(), "late")
    checked = refs.join(state.withColumn("orphan_kind", kind).where("orphan_kind is not null").drop("c", "d", "known"), ["key", "t"])
    return checked.unionByName(sure)


def _month(column: str) -> Column:
    return F.date_format(F.col(column), "yyyy-MM")


def archive_references(spark: SparkSession, d: str) -> DataFrame:
    """All references of the archive: table_name, ref_month, source_key, ref_key, key (of the record), t."""
    asked = scan(spark, d, "eval_questions").select(
        F.lit("eval_questions").alias("table_name"), _month("asked_at").alias("ref_month"), F.col("question_id").cast("string").alias("source_key"),
        F.explode("expected_record_ids").alias("ref_key"), micros("asked_at").alias("t")).withColumn("key", F.col("ref_key"))
    views = scan(spark, d, "page_detail").select(
        F.lit("page_detail").alias("table_name"), _month("snapshot_at").alias("ref_month"), F.col("page_id").alias("source_key"), "document_id",
        F.explode(F.concat(F.coalesce("printed_regions.region_id", F.array()), F.coalesce("handwritten_regions.region_id", F.array()))).alias("ref_key"),
        micros("snapshot_at").alias("t"))
    views = views.where("ref_key <> ''").withColumn("key", F.concat_ws("__", "document_id", "source_key", "ref_key")).drop("document_id")
    return asked.where("ref_key <> ''").unionByName(views)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references of questions and pages."""
    created = scan(spark, d, "records").select(F.col("record_id").alias("key"), F.col("provenance.created_at").alias("at")) \
        .select("key", iso_micros("at").alias("t"))
    deleted = scan(spark, d, "record_deletions").select(F.col("record_id").alias("key"), micros("deleted_at").alias("t"))
    return find_orphans(archive_references(spark, d), created, deleted) \
        .select("table_name", "ref_month", "source_key", "ref_key", "orphan_kind").distinct()


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references counted per table, month and kind."""
    return p5_found(spark, d).groupBy("table_name", "ref_month", "orphan_kind").agg(F.count("*").alias("n_references"))


_FOUND = """
    WITH refs AS (
        SELECT 'eval_questions' AS table_name, strftime(asked_at, '%Y-%m') AS ref_month, CAST(question_id AS VARCHAR) AS source_key,
               r AS ref_key, r AS k, epoch_us(asked_at) AS t
        FROM (SELECT DISTINCT question_id, asked_at, unnest(expected_record_ids) AS r FROM eval_questions) WHERE r <> ''
        UNION
        SELECT 'page_detail', strftime(snapshot_at, '%Y-%m'), page_id, r, document_id || '__' || page_id || '__' || r, epoch_us(snapshot_at)
        FROM (SELECT DISTINCT document_id, page_id, snapshot_at,
                     unnest(list_concat(list_transform(coalesce(printed_regions, []), lambda x: x.region_id),
                                        list_transform(coalesce(handwritten_regions, []), lambda x: x.region_id))) AS r FROM page_detail) WHERE r <> ''),
    probes AS (SELECT DISTINCT k, t FROM refs),
    made AS (SELECT DISTINCT record_id AS k, epoch_us(CAST(provenance.created_at AS TIMESTAMPTZ)) AS c FROM records),
    gone AS (SELECT DISTINCT record_id AS k, epoch_us(deleted_at) AS d FROM record_deletions),
    cs AS (SELECT p.k, p.t, count(c) AS n, max(c) FILTER (c <= p.t) AS c FROM probes p LEFT JOIN made m ON m.k = p.k GROUP BY ALL),
    ds AS (SELECT p.k, p.t, max(d) FILTER (d <= p.t) AS d FROM probes p LEFT JOIN gone g ON g.k = p.k GROUP BY ALL),
    kinds AS (SELECT cs.k, cs.t, CASE WHEN d IS NOT NULL AND (c IS NULL OR c <= d) THEN 'deleted' WHEN n = 0 THEN 'missing'
                                      WHEN c IS NULL THEN 'late' END AS orphan_kind
              FROM cs JOIN ds ON cs.k = ds.k AND cs.t = ds.t)
    SELECT DISTINCT table_name, ref_month, source_key, ref_key, orphan_kind
    FROM refs JOIN kinds ON refs.k = kinds.k AND refs.t = kinds.t WHERE orphan_kind IS NOT NULL"""

QUERIES = {"p5_found": p5_found, "p5_report": p5_report}
SQL = {"p5_found": _FOUND,
       "p5_report": f"SELECT table_name, ref_month, orphan_kind, count(*) AS n_references FROM ({_FOUND}) GROUP BY ALL"}
