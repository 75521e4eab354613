"""Neighbours and clusters of vectors: k-NN, PCA, DBSCAN, and series with early stopping."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from foliant.functions import vectors as V
from foliant.plans.registry import Registry
from foliant.plans.staging import bounded, scan

R = Registry()


def knn(df: DataFrame, queries: DataFrame, key: str, vector: str, by: str, k: int = 5) -> DataFrame:
    """(key, neighbour, distance, rank): the k nearest rows of the same group for each row of a stated query set, itself
    included [K2]."""
    q = queries.select(F.col(key).alias("__q"), F.col(by), F.col(vector).alias("__v"))
    pairs = df.join(bounded(q), by).select(F.col("__q").alias(key), F.col(key).alias("neighbour"), F.round(V.euclidean(F.col(vector), F.col("__v")), 5).alias("distance"))
    return pairs.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy("distance", "neighbour"))).where(F.col("rank") <= k)


def principal_components(df: DataFrame, vector: str, n: int) -> DataFrame:
    """``pc``: centred vectors on the first n components [K1].

    Only sums and the matrix of products, of a size given by the dimension, reach the driver: each task adds up its rows.
    The sign of a component is that of its largest loading."""
    dim = df.select(F.size(vector)).where(f"{vector} is not null").first()
    if dim is None:
        return df.withColumn("pc", F.array().cast("array<double>"))
    m = dim[0]

    def moments(batches):
        s, p, c = np.zeros(m), np.zeros((m, m)), 0
        for b in batches:
            x = np.stack(b["v"].to_numpy()).astype(float) if len(b) else np.zeros((0, m))
            s, p, c = s + x.sum(axis=0), p + x.T @ x, c + len(x)
        yield pd.DataFrame({"n": [c], "s": [s], "p": [p.ravel()]})

    rows = df.select(F.col(vector).alias("v")).where(F.size("v") == m).mapInPandas(moments, "n long, s array<double>, p array<double>")
    parts = rows.groupBy().agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(m)]).first()
    prod = rows.select(F.posexplode("p").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
    count, mean = parts["n"], np.array([parts[f"s{i}"] for i in range(m)]) / parts["n"]
    cov = (np.array([r.v for r in prod]).reshape(m, m) - count * np.outer(mean, mean)) / max(1, count - 1)
    w, v = np.linalg.eigh(cov)
    axes = v[:, np.argsort(-w)[:n]]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), range(axes.shape[1])])
    shift = -mean @ axes
    project = [V.dot(F.col(vector), F.array(*[F.lit(float(x)) for x in axes[:, j]])) + F.lit(float(shift[j])) for j in range(axes.shape[1])]
    return df.withColumn("pc", F.array(*project))


def density_clusters(df: DataFrame, key: str, vector: str, by: str, eps: float, least: int, schema: str) -> DataFrame:
    """``cluster`` per group, -1 for noise, numbered by least key [K4].

    A group is what one epoch's sample holds (a few thousand rows), so it fits a task; neighbours are found in blocks."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        x = np.stack(pdf[vector].to_numpy()).astype(float)
        near = []
        for i in range(0, len(x), 512):
            d2 = (x[i : i + 512] ** 2).sum(axis=1)[:, None] + (x**2).sum(axis=1)[None, :] - 2 * x[i : i + 512] @ x.T
            near += [np.flatnonzero(r <= eps * eps + 1e-12) for r in d2]
        label, current = np.full(len(x), -1), -1
        for i in range(len(x)):
            if label[i] >= 0 or len(near[i]) < least:
                continue
            current += 1
            label[i], todo = current, list(near[i])
            while todo:
                j = todo.pop()
                if label[j] < 0:
                    label[j] = current
                    if len(near[j]) >= least:
                        todo += list(near[j])
        return pd.DataFrame({key: pdf[key], by: pdf[by], "cluster": label})

    return df.select(key, by, vector).groupBy(by).applyInPandas(run, schema)


def early_stop(df: DataFrame, order: str, metric: str, patience: int = 3, min_delta: float = 0.0) -> DataFrame:
    """``best`` so far and ``stop``: whether the metric (lower is better) has not improved for ``patience`` steps [K6]. A series of
    epochs is small; the window is over all of it."""
    w = W.orderBy(order)
    before = F.min(metric).over(w.rowsBetween(W.unboundedPreceding, -1))
    s = df.withColumn("best", F.min(metric).over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("better", before.isNull() | (F.col(metric) < before - min_delta))
    s = s.withColumn("n", F.row_number().over(w))
    s = s.withColumn("last", F.max(F.when(F.col("better"), F.col("n"))).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return s.withColumn("stop", F.col("n") - F.col("last") >= patience).select(order, metric, "best", "stop")


@R.add("SELECT q.vec_id, n.vec_id AS neighbour, round(sqrt(list_sum(list_transform(range(1, 65), lambda i: pow(n.embedding[i]::DOUBLE - q.embedding[i]::DOUBLE, 2)))), 5) AS distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(sqrt(list_sum(list_transform(range(1, 65), lambda i: pow(n.embedding[i]::DOUBLE - q.embedding[i]::DOUBLE, 2)))), 5), n.vec_id) AS rank "
       "FROM embeddings q JOIN embeddings n ON n.label = q.label WHERE q.vec_id % 100 = 0 QUALIFY rank <= 5")
def nearest_neighbours(spark, d):
    """K2: five nearest vectors of the same label."""
    e = scan(spark, d, "embeddings")
    return knn(e, e.where("vec_id % 100 = 0"), "vec_id", "embedding", "label")


@R.add()
def pca_projection(spark, d):
    """K1: vectors in two dimensions."""
    p = principal_components(scan(spark, d, "embeddings"), "embedding", 2)
    return p.select("vec_id", F.round(F.col("pc")[0], 4).alias("x"), F.round(F.col("pc")[1], 4).alias("y"))


@R.add()
def dbscan_clusters(spark, d):
    """K4: clusters of the vectors of each label."""
    return density_clusters(scan(spark, d, "embeddings"), "vec_id", "embedding", "label", 0.9, 3, "vec_id long, label int, cluster int")


@R.add("WITH s AS (SELECT o_custkey % 40 AS step, avg(o_totalprice) AS loss FROM orders GROUP BY 1), b AS (SELECT step, round(loss, 4) AS loss, min(round(loss, 4)) OVER (ORDER BY step) AS best, min(round(loss, 4)) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev, row_number() OVER (ORDER BY step) AS n FROM s), "
       "l AS (SELECT *, max(CASE WHEN prev IS NULL OR loss < prev THEN n END) OVER (ORDER BY step) AS last FROM b) SELECT step, loss, best, n - last >= 3 AS stop FROM l")
def early_stopping(spark, d):
    """K6: where a series stops getting better."""
    s = scan(spark, d, "orders").groupBy((F.col("o_custkey") % 40).alias("step")).agg(F.round(F.avg("o_totalprice"), 4).alias("loss"))
    return early_stop(s, "step", "loss")


QUERIES, SQL = R.queries, R.sql
