"""Splits, quotas, samples, ranking of assets, set operations. All choices come from hashes of keys, so they don't depend on the
order or the partitioning of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from foliant.functions import text as T
from foliant.functions import vectors as V
from foliant.operators.archive import upsert_latest
from foliant.plans.ranks import place_in
from foliant.plans.registry import Registry
from foliant.plans.staging import bounded, scan

R = Registry()


def take_quota(df: DataFrame, by: str, quota: int, *order) -> DataFrame:
    """The first ``quota`` rows of each group [I9, I10, I12, I20]; Spark drops the rest before the exchange."""
    return df.withColumn("place", F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col("place") <= quota)


def seeded(seed: int, c) -> F.Column:
    """A shuffled order that anyone can repeat: MD5 of ``seed:key``."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(c).cast("string")))


def proportional_slots(df: DataFrame, by: str, total: int, noise=None, noise_share: float = 0.1) -> DataFrame:
    """(by, n, slots) of a sample of ``total`` rows over groups [I11, H12, I13].

    The group ``noise`` (of rows in no cluster) has a place for each tenth of the total, no more than its rows; what remains is
    shared by size, half to even, one at least, and put right by one in the order of slots, largest first; groups of one slot
    give none away. The groups' counts, not their rows, are ordered in one task."""
    n = df.groupBy(by).agg(F.count("*").alias("n"))
    is_noise = F.col(by).eqNullSafe(F.lit(noise)) if noise is not None else F.lit(False)
    w = W.partitionBy()
    n = n.withColumn("__noise", is_noise)
    n = n.withColumn("left", F.lit(total) - F.coalesce(F.sum(F.when(F.col("__noise"), F.least("n", F.bround(F.lit(float(total)) * noise_share).cast("long")))).over(w), F.lit(0)))
    share = F.bround(F.col("left") * (F.col("n") / F.sum(F.when(~F.col("__noise"), F.col("n"))).over(w))).cast("long")
    s = n.withColumn("slots", F.when(F.col("__noise"), F.lit(total) - F.col("left")).otherwise(F.greatest(F.lit(1), share)))
    s = s.withColumn("diff", F.col("left") - F.sum(F.when(~F.col("__noise"), F.col("slots")).otherwise(0)).over(w))
    gives = ~F.col("__noise") & ((F.col("diff") > 0) | (F.col("slots") > 1))
    place = F.when(gives, F.row_number().over(W.partitionBy(gives).orderBy(F.desc("slots"), by)))
    return s.withColumn("place", place).select(by, "n", (F.col("slots") + F.when(F.col("place") <= F.abs("diff"), F.signum("diff").cast("long")).otherwise(0)).alias("slots"))


def round_robin(df: DataFrame, by: str, order: list) -> DataFrame:
    """``turn`` and ``pick``: groups take turns until all are used up [H11]. A turn holds one row a group, so turns are the parts
    of the total order."""
    turned = df.withColumn("turn", F.row_number().over(W.partitionBy(by).orderBy(*order)))
    return place_in(turned, [], F.col("turn"), [by], "pick")


def prune(df: DataFrame, by: str, share: float, key: Column) -> DataFrame:
    """Groups without the first ``share`` of their rows (half to even), one row at least kept [I14]. ``key`` is a text of hexadecimal
    digits that orders the rows; its first two cut a hot group into parts."""
    placed = place_in(df.withColumn("__key", key), [by], F.substring("__key", 1, 2), ["__key"]).drop("__key")
    size = placed.groupBy(by).agg(F.count("*").alias("__size"))
    gone = F.least(F.col("__size") - 1, F.bround(F.col("__size") * share).cast("long"))
    return placed.join(size.withColumnRenamed(by, "__by"), F.col(by).eqNullSafe(F.col("__by"))).where(F.col("place") > gone).drop("__size", "__by")


def rank_assets(assets: DataFrame, w: int, h: int, *, epoch: str | None = None, subtype: str | None = None, noise: bool = False, top: int = 15) -> DataFrame:
    """Assets that fit a box, best first [I5]: coverage of its width, closeness in shape, matching epoch and subtype.

    assets: asset_id, w, h, epoch, subtype, solidity. Up to 1.15 times as wide and twice as high fit; ties by id. Of noise with a
    subtype only that subtype is asked; a solid asset is better on round ground. If none fits, all narrower ones, else all, are
    given with score 0."""
    aspect = w / h if h > 0 else 1.0
    pool = assets.where(F.col("subtype") == F.lit(subtype)) if noise and subtype is not None else assets
    score = F.lit(100.0) + (40 * F.least(F.lit(1.0), F.col("w") / w) if w > 0 else 0)
    if noise:
        score = score - F.least(F.lit(30.0), F.abs(F.lit(aspect) - F.when(F.col("h") > 0, F.col("w") / F.col("h")).otherwise(1.0)) * 15)
        if 0.8 < aspect < 1.2:
            score = score + F.when(F.coalesce("solidity", F.lit(1.0)) > 0.8, 10).otherwise(0)
    score = score + F.when(F.col("epoch") == F.lit(epoch), 40).otherwise(0) + F.when(F.col("subtype") == F.lit(subtype), 30).otherwise(0)
    fits = F.coalesce((F.col("w") <= w * 1.15) & (F.col("h") <= h * 2.0), F.lit(False))
    level = F.when(fits, 0).when(F.coalesce("w", F.lit(0)) < w, 1).otherwise(2)
    best = pool.withColumn("level", level).withColumn("score", F.when(F.col("level") == 0, F.round(score, 6)).otherwise(0.0)).orderBy("level", F.desc("score"), "asset_id").limit(top)
    return best.withColumn("least", F.min("level").over(W.partitionBy())).where("level = least").select("asset_id", "score")


def weighted_choice(df: DataFrame, keys: list[str], weights: list[float], seed: int, key: str) -> DataFrame:
    """``choice``: one of ``keys`` for every row, by weight, from a hash of the row's key [A17, I21]."""
    total, acc, out = sum(weights), 0.0, F.lit(keys[-1])
    edges = []
    for k, x in zip(keys, weights):
        acc += x / total
        edges.append((k, acc))
    share = T.hash_share(seed, F.col(key))
    for k, e in reversed(edges[:-1]):
        out = F.when(share < round(e, 10), F.lit(k)).otherwise(out)
    return df.withColumn("choice", out)


_LIMB = "CAST(('0x' || substr(md5({0}), {1}, 8)) AS BIGINT)"


def _share(key: str, seed: int) -> str:
    k = f"'{seed}:' || CAST({key} AS VARCHAR)"
    acc = "0"
    for i in range(4):
        acc = f"(({acc}) * 7296 + {_LIMB.format(k, 8 * i + 1)}) % 10000"
    return f"(({acc}) / 10000.0::DOUBLE)"


@R.add(f"SELECT doc_id, {_share('doc_id', 42)} AS share, CASE WHEN {_share('doc_id', 42)} < 0.15 THEN 'test' WHEN {_share('doc_id', 42)} < 0.3 THEN 'val' ELSE 'train' END AS split FROM documents")
def hash_split(spark, d):
    """F24, I22."""
    share = T.hash_share(42, F.col("doc_id"))
    return scan(spark, d, "documents").select("doc_id", share.alias("share"), T.split_of(share).alias("split"))


@R.add(f"SELECT split, lang, count(*) AS n FROM (SELECT lang, CASE WHEN {_share('doc_id', 42)} < 0.15 THEN 'test' WHEN {_share('doc_id', 42)} < 0.3 THEN 'val' ELSE 'train' END AS split FROM documents) GROUP BY ALL")
def split_counts(spark, d):
    """Documents of each side and label."""
    return hash_split(spark, d).join(scan(spark, d, "documents").select("doc_id", "lang"), "doc_id").groupBy("split", "lang").agg(F.count("*").alias("n"))


@R.add("SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents QUALIFY place <= 5")
def quota_trim(spark, d):
    """The first five documents of each source."""
    return take_quota(scan(spark, d, "documents").select("doc_id", "source"), "source", 5, "doc_id")


@R.add("SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('7:' || CAST(doc_id AS VARCHAR))) AS place FROM documents QUALIFY place <= 20")
def seeded_sample(spark, d):
    """Twenty documents of each label in a seeded order."""
    return take_quota(scan(spark, d, "documents").select("doc_id", "lang"), "lang", 20, seeded(7, "doc_id"))


_SLOTS = """n AS (SELECT coalesce(lang, '-') AS lang, count(*) AS n FROM documents GROUP BY 1), l0 AS (SELECT *, lang = '-' AS noise FROM n),
    l1 AS (SELECT *, 200 - coalesce(sum(CASE WHEN noise THEN least(n, 20) END) OVER (), 0) AS remaining, sum(CASE WHEN NOT noise THEN n END) OVER () AS clustered FROM l0),
    l2 AS (SELECT *, CASE WHEN noise THEN 200 - remaining ELSE greatest(1, CAST(round_even(remaining * (n / clustered), 0) AS BIGINT)) END AS s0 FROM l1),
    l3 AS (SELECT *, remaining - sum(CASE WHEN noise THEN 0 ELSE s0 END) OVER () AS diff FROM l2), l4 AS (SELECT *, NOT noise AND (diff > 0 OR s0 > 1) AS gives FROM l3),
    l5 AS (SELECT *, row_number() OVER (PARTITION BY gives ORDER BY s0 DESC, lang) AS place FROM l4),
    slots AS (SELECT lang, n, CAST(s0 + CASE WHEN gives AND place <= abs(diff) THEN sign(diff) ELSE 0 END AS BIGINT) AS slots FROM l5)"""


@R.add(f"WITH {_SLOTS} SELECT * FROM slots")
def proportional_sample_slots(spark, d):
    """200 places by the sizes of labels; documents without a label are those in no cluster."""
    df = scan(spark, d, "documents").select(F.coalesce("lang", F.lit("-")).alias("lang"))
    return proportional_slots(df, "lang", 200, noise="-")


_CENTER = """c AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) r(i) GROUP BY ALL), cv AS (SELECT label, list(m ORDER BY i) AS m FROM c GROUP BY label)"""


def centroids(df: DataFrame, by: str, vector: str) -> DataFrame:
    """(by, center): mean vectors [E30]; one row a position and group goes through the exchange."""
    p = df.select(by, F.posexplode(vector).alias("i", "v")).groupBy(by, "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    return p.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("center"))


@R.add(f"WITH {_CENTER} SELECT vec_id, e.label, round(sqrt(list_sum(list_transform(range(1, 65), lambda i: pow(e.embedding[i]::DOUBLE - cv.m[i], 2)))), 5) AS distance, row_number() OVER (PARTITION BY e.label ORDER BY round(sqrt(list_sum(list_transform(range(1, 65), lambda i: pow(e.embedding[i]::DOUBLE - cv.m[i], 2)))), 5), vec_id) AS place FROM embeddings e JOIN cv ON cv.label = e.label QUALIFY place <= 3")
def nearest_to_centroid(spark, d):
    """The three vectors nearest to the mean of their label."""
    e = scan(spark, d, "embeddings")
    c = centroids(e, "label", "embedding")
    dist = e.join(bounded(c, 10_000), "label").select("vec_id", "label", F.round(V.euclidean(F.col("embedding"), F.col("center")), 5).alias("distance"))
    return take_quota(dist, "label", 3, "distance", "vec_id")


@R.add("SELECT doc_id, lang, turn, row_number() OVER (ORDER BY turn, lang) AS pick FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS turn FROM documents WHERE lang IS NOT NULL) WHERE turn <= 3")
def round_robin_pick(spark, d):
    """Labels take turns; three turns here, so the total order is of a few rows."""
    q = take_quota(scan(spark, d, "documents").where("lang is not null").select("doc_id", "lang"), "lang", 3, "doc_id").drop("place")
    return round_robin(q, "lang", ["doc_id"])


@R.add("SELECT doc_id, source, place FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('3:' || CAST(doc_id AS VARCHAR))) AS place, count(*) OVER (PARTITION BY source) AS n FROM documents WHERE source IS NOT NULL) WHERE place > least(n - 1, round_even(n * 0.4, 0))")
def class_preserving_prune(spark, d):
    """I14."""
    return prune(scan(spark, d, "documents").where("source is not null").select("doc_id", "source"), "source", 0.4, seeded(3, "doc_id"))


@R.add("SELECT p_partkey AS asset_id, round(100 + 40 * least(1.0::DOUBLE, p_size * 10 / 300.0::DOUBLE) - least(30, abs(300.0::DOUBLE / 120 - (p_size * 10.0::DOUBLE) / (p_size * 4)) * 15) + CASE WHEN p_brand = 'Brand#11' THEN 40 ELSE 0 END + CASE WHEN p_type LIKE 'ECONOMY%' THEN 30 ELSE 0 END, 6) AS score FROM part WHERE p_type LIKE 'ECONOMY%' AND p_size * 10 <= 345 AND p_size * 4 <= 240 ORDER BY score DESC, asset_id LIMIT 15")
def asset_ranking(spark, d):
    """I5, I6."""
    a = scan(spark, d, "part").select(F.col("p_partkey").alias("asset_id"), (F.col("p_size") * 10).alias("w"), (F.col("p_size") * 4).alias("h"), F.col("p_brand").alias("epoch"), F.when(F.startswith("p_type", F.lit("ECONOMY")), "economy").alias("subtype"), F.lit(0.9).alias("solidity"))
    return rank_assets(a, 300, 120, epoch="Brand#11", subtype="economy", noise=True)


@R.add("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_event(spark, d):
    """The last event of every user."""
    return upsert_latest(scan(spark, d, "events").where("user_id is not null"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


@R.add("SELECT DISTINCT h.id FROM harvest_index h WHERE NOT EXISTS (SELECT 1 FROM record_deletions x WHERE string_split(x.record_id, '__')[1] = h.id)")
def new_only(spark, d):
    """Harvested documents of which no record was ever deleted."""
    gone = scan(spark, d, "record_deletions").select(F.element_at(F.split("record_id", "__"), 1).alias("id"))
    return scan(spark, d, "harvest_index").select("id").distinct().join(gone, "id", "left_anti")


@R.add("SELECT 'union' AS op, count(*) AS n FROM (SELECT id FROM harvest_index UNION SELECT document_id FROM documents) UNION ALL SELECT 'intersect', count(*) FROM (SELECT id FROM harvest_index INTERSECT SELECT document_id FROM documents) UNION ALL SELECT 'except', count(*) FROM (SELECT id FROM harvest_index EXCEPT SELECT document_id FROM documents) UNION ALL SELECT 'append', count(*) FROM (SELECT id FROM harvest_index UNION ALL SELECT document_id FROM documents)")
def set_operations(spark, d):
    """Union, intersection, difference and appending of key sets."""
    a, b = scan(spark, d, "harvest_index").select("id"), scan(spark, d, "documents").select(F.col("document_id").alias("id"))
    parts = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "except": a.subtract(b), "append": a.union(b)}
    out = None
    for op, df in parts.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(op).alias("op"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@R.add(f"SELECT doc_id, CASE WHEN {_share('doc_id', 42)} < 0.5 THEN 'news' WHEN {_share('doc_id', 42)} < 0.8 THEN 'music' ELSE 'theatre' END AS choice FROM documents")
def weighted_choices(spark, d):
    """A kind of programme for every document, by weight."""
    return weighted_choice(scan(spark, d, "documents").select("doc_id"), ["news", "music", "theatre"], [5, 3, 2], 42, "doc_id")


@R.add("SELECT source, count(*) AS n, 1.0::DOUBLE / greatest(1, count(*)) AS weight FROM documents GROUP BY source")
def class_weights(spark, d):
    """E24."""
    return scan(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), (F.lit(1.0) / F.greatest(F.lit(1), F.count("*"))).alias("weight"))


@R.add("SELECT label, round(quantile_cont(x, 0.15), 6) AS p15, round(quantile_cont(x, 0.9), 6) AS p90, round(greatest(quantile_cont(x, 0.15), 0.1), 6) AS eps FROM (SELECT label, embedding[1]::DOUBLE AS x FROM embeddings) GROUP BY label")
def percentiles(spark, d):
    """Interpolated percentiles, and a radius no smaller than 0.1."""
    e = scan(spark, d, "embeddings").select("label", F.element_at("embedding", 1).cast("double").alias("x"))
    return e.groupBy("label").agg(F.round(F.percentile("x", 0.15), 6).alias("p15"), F.round(F.percentile("x", 0.9), 6).alias("p90"), F.round(F.greatest(F.percentile("x", 0.15), F.lit(0.1)), 6).alias("eps"))


QUERIES, SQL = R.queries, R.sql
