"""Evaluation: confusion and P/R/F1, calibration, PR curves, risk and coverage, average precision, transcription errors."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from foliant.functions import geometry as G
from foliant.functions import text as T
from foliant.functions import vectors as V
from foliant.operators.archive import LATEST, latest_records
from foliant.operators.spatial import _MARKS, _TEXTS, mark_boxes, text_boxes
from foliant.operators.summary import _bins_sql, bin_number
from foliant.plans.registry import Registry
from foliant.plans.staging import scan, stage

R = Registry()
EPS = 1e-9
COCO_AT = [round(0.5 + 0.05 * i, 2) for i in range(10)]


def binary_counts(df: DataFrame, truth: str, guess: str, *by: str) -> DataFrame:
    """tp, fp, fn, tn by group [E7]."""
    t, g = F.col(truth), F.col(guess)
    return df.groupBy(*by).agg(F.count_if(t & g).alias("tp"), F.count_if(~t & g).alias("fp"), F.count_if(t & ~g).alias("fn"), F.count_if(~t & ~g).alias("tn"))


def prf(df: DataFrame, digits: int = 9) -> DataFrame:
    """precision, recall, f1, iou and dice from counts; EPS in every denominator [E9]."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p, r = tp / (tp + fp + EPS), tp / (tp + fn + EPS)
    cols = {"precision": p, "recall": r, "f1": 2 * p * r / (p + r + EPS), "iou": tp / (tp + fp + fn + EPS), "dice": 2 * tp / (2 * tp + fp + fn + EPS)}
    return df.select("*", *[F.round(c, digits).alias(k) for k, c in cols.items()])


def confusion_matrix(df: DataFrame, truth: str, guess: str, labels: list[str]) -> DataFrame:
    """(truth, guess, n) for all pairs of labels; other labels don't count [E10]."""
    spark = df.sparkSession
    names = spark.createDataFrame([(x,) for x in labels], "label string")
    grid = names.select(F.col("label").alias("truth")).crossJoin(names.select(F.col("label").alias("guess")))
    n = df.groupBy(F.col(truth).alias("truth"), F.col(guess).alias("guess")).agg(F.count("*").alias("n"))
    return grid.join(n, ["truth", "guess"], "left").select("truth", "guess", F.coalesce("n", F.lit(0)).alias("n"))


def class_scores(matrix: DataFrame, digits: int = 6) -> DataFrame:
    """P/R/F1 of each class of a confusion matrix, empty ones too [E11]."""
    rows = matrix.groupBy(F.col("truth").alias("label")).agg(F.sum("n").alias("actual"), F.sum(F.when(F.col("truth") == F.col("guess"), F.col("n")).otherwise(0)).alias("tp"))
    cols = matrix.groupBy(F.col("guess").alias("label")).agg(F.sum("n").alias("said"))
    both = rows.join(cols, "label").select("label", "tp", (F.col("said") - F.col("tp")).alias("fp"), (F.col("actual") - F.col("tp")).alias("fn"))
    return prf(both, digits).select("label", "tp", "fp", "fn", "precision", "recall", "f1")


def reliability(df: DataFrame, conf: str, correct: str, bins: int = 10) -> DataFrame:
    """(bin, mean_conf, accuracy, n) with empty bins as zeros [E12]."""
    b = df.select(bin_number(F.col(conf), bins).alias("bin"), F.col(conf).alias("c"), F.col(correct).cast("double").alias("ok")).where("bin is not null")
    got = b.groupBy("bin").agg(F.avg("c").alias("mc"), F.avg("ok").alias("acc"), F.count("*").alias("n"))
    return df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(got, "bin", "left").select(
        "bin", F.round(F.coalesce("mc", F.lit(0.0)), 6).alias("mean_conf"), F.round(F.coalesce("acc", F.lit(0.0)), 6).alias("accuracy"), F.coalesce("n", F.lit(0)).alias("n"))


def calibration_error(df: DataFrame, conf: str, correct: str, bins: int = 15) -> DataFrame:
    """Expected calibration error: the mean gap of the bins by their size [E13]."""
    b = df.select(bin_number(F.col(conf), bins).alias("bin"), F.col(conf).alias("c"), F.col(correct).cast("double").alias("ok")).where("bin is not null")
    gaps = b.groupBy("bin").agg((F.abs(F.sum("ok") - F.sum("c"))).alias("gap"), F.count("*").alias("n"))
    return gaps.agg(F.round(F.sum("gap") / F.sum("n"), 6).alias("ece"), F.sum("n").alias("n"))


def pr_curve(df: DataFrame, score: str, truth: str) -> DataFrame:
    """Counts, precision and recall at 19 thresholds [E15, E33]: rows are counted by the highest threshold they reach, then
    summed over thresholds, so no row is multiplied."""
    grid = [round(0.05 * i, 2) for i in range(1, 20)]
    reached = F.aggregate(F.array(*map(F.lit, grid)), F.lit(0), lambda s, t: s + F.when(F.col(score) >= t, 1).otherwise(0))
    level = df.groupBy(reached.alias("level")).agg(F.count_if(F.col(truth)).alias("p"), F.count("*").alias("n"))
    spark = df.sparkSession
    levels = spark.createDataFrame([(i + 1, t) for i, t in enumerate(grid)], "i int, threshold double")
    total = level.agg(F.sum("p").alias("all_p"))
    c = levels.join(level, F.col("level") >= F.col("i"), "left").groupBy("i", "threshold").agg(F.coalesce(F.sum("p"), F.lit(0)).alias("tp"), F.coalesce(F.sum("n"), F.lit(0)).alias("said"))
    return c.crossJoin(total).select("threshold", "tp", (F.col("said") - F.col("tp")).alias("fp"), (F.col("all_p") - F.col("tp")).alias("fn")).withColumn(
        "precision", F.round(F.col("tp") / (F.col("tp") + F.col("fp") + EPS), 6)).withColumn("recall", F.round(F.col("tp") / (F.col("tp") + F.col("fn") + EPS), 6))


def curve_area(curve: DataFrame) -> DataFrame:
    """Trapezoid area of a PR curve in the order of recall [E16]."""
    w = W.orderBy("recall", "precision")
    steps = curve.select("recall", "precision", F.lag("recall").over(w).alias("r0"), F.lag("precision").over(w).alias("p0"))
    return steps.agg(F.round(F.coalesce(F.sum((F.col("recall") - F.col("r0")) * (F.col("precision") + F.col("p0")) / 2), F.lit(0.0)), 6).alias("auc"))


def greedy_match(preds: DataFrame, truths: DataFrame, by: list[str], threshold: float = 0.5) -> DataFrame:
    """One-to-one matching by score: each prediction takes the free truth of its group with the largest IoU [D5].

    preds: ``by``, pred_id, score, bbox; truths: ``by``, truth_id, bbox. Returns ``by``, pred_id, score, truth_id (null without a
    match), iou. A group is what one page holds of one class, so it fits a task; ties go by id."""
    fields = ", ".join(f"`{c}` {preds.schema[c].dataType.simpleString()}" for c in by)
    schema = f"{fields}, pred_id {preds.schema['pred_id'].dataType.simpleString()}, score double, truth_id {truths.schema['truth_id'].dataType.simpleString()}, iou double"

    def match(key: tuple, p: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        free = {i: np.asarray(b, float) for i, b in sorted(zip(t["truth_id"], t["bbox"]), key=lambda x: x[0])}
        rows = []
        for r in p.sort_values(["score", "pred_id"], ascending=[False, True]).itertuples():
            b, best, won = np.asarray(r.bbox, float), threshold, None
            for i, g in free.items():
                w = max(0.0, min(b[0] + b[2], g[0] + g[2]) - max(b[0], g[0]))
                h = max(0.0, min(b[1] + b[3], g[1] + g[3]) - max(b[1], g[1]))
                iou = w * h / (b[2] * b[3] + g[2] * g[3] - w * h + EPS)
                if iou > best or iou == best and won is None:
                    best, won = iou, i
            if won is not None:
                del free[won]
            rows.append((*key, r.pred_id, r.score, won, best if won is not None else 0.0))
        return pd.DataFrame(rows, columns=[*by, "pred_id", "score", "truth_id", "iou"])

    return preds.select(*by, "pred_id", "score", "bbox").groupBy(*by).cogroup(truths.select(*by, "truth_id", "bbox").groupBy(*by)).applyInPandas(match, schema)


def greedy_levels(preds: DataFrame, truths: DataFrame, by: list[str], levels: list[float]) -> DataFrame:
    """The matching of ``greedy_match`` at several ascending IoU thresholds: ``by``, pred_id, score and found, whose bit i is set if
    the prediction has a truth at the i-th of ``levels``.

    Pairs below the lowest level don't leave the join; the others come to Python group by group in the order of matching. At each
    level a truth is free or taken and a prediction has one or none, which is a bit, so one pass over the pairs is all levels' work."""
    p = preds.select(*by, "pred_id", F.col("score").cast("double").alias("score"), F.col("bbox").cast("array<double>").alias("__p"), F.monotonically_increasing_id().alias("__row"))
    t = truths.select(*[F.col(c).alias(f"__{c}") for c in by], "truth_id", F.col("bbox").cast("array<double>").alias("__t"))
    iou = F.nanvl(G.box_iou(F.col("__p"), F.col("__t")), F.lit(0.0))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    pairs = p.join(t, reduce(Column.__and__, [*same, iou >= levels[0]]), "left").select(*by, "pred_id", "score", "__row", "truth_id", iou.alias("__iou"))
    w = W.partitionBy(*by).orderBy(F.desc("score"), "pred_id", "__row", F.desc("__iou"), "truth_id")  # the rows leave the window in its order
    pairs = pairs.select("*", (F.row_number().over(w) == 1).alias("__first"), (~F.lead("__row").over(w).eqNullSafe(F.col("__row"))).alias("__last"))
    keep = [*by, "pred_id", "score"]

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken, mine = {}, 0
        for b in batches:
            reached = np.searchsorted(levels, b.column("__iou").fill_null(-1.0).to_numpy(), side="right").tolist()
            found = []
            for first, last, truth, n in zip(b.column("__first").to_pylist(), b.column("__last").to_pylist(), b.column("truth_id").to_pylist(), reached):
                if first:
                    taken = {}
                won = (1 << n) - 1 & ~mine & ~taken.get(truth, 0)
                if won:
                    mine |= won
                    taken[truth] = taken.get(truth, 0) | won
                if last:
                    found.append(mine)
                    mine = 0
            kept = b.filter(b.column("__last"))
            yield pa.RecordBatch.from_arrays([*[kept.column(c) for c in keep], pa.array(found, pa.int32())], names=[*keep, "found"])

    return pairs.mapInArrow(match, pairs.select(*keep, F.lit(0).alias("found")).schema)


def hit_areas(scored: DataFrame, by: str, score: str, order: list, hits: list[str]) -> DataFrame:
    """``by`` and, for each of the boolean columns ``hits``, the sum over its hits of the best precision from their rank on. Best
    ``score`` first, ties by ``order``; all ``hits`` are summed in the same ranking.

    A group is cut into parts by thousandths of the score; ranks, hits and the envelope of precision are counted inside parts
    and carried over them, so one class of any size is many tasks' work. Windows only look back: Spark runs through the rest of
    the part anew for each row of a window that looks ahead."""
    inside = W.partitionBy(by, "__part").orderBy(F.desc(score), *order)
    earlier = W.partitionBy(by).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    later = W.partitionBy(by).orderBy(F.desc("__part")).rowsBetween(W.unboundedPreceding, -1)
    onward = W.partitionBy(by, "__part").orderBy(F.desc("__k")).rowsBetween(W.unboundedPreceding, 0)
    cut = scored.withColumn("__part", -F.floor(F.col(score) * 1000)).withColumns({h: F.col(h).cast("long") for h in hits})
    parts = cut.groupBy(by, "__part").agg(F.count("*").alias("__k0"), *[F.sum(h).alias(f"{h}_before") for h in hits])
    carried = parts.select(by, "__part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("__k0", *[f"{h}_before" for h in hits])])
    r = cut.withColumns({"__k": F.row_number().over(inside)} | {f"{h}_tp": F.sum(h).over(inside.rowsBetween(W.unboundedPreceding, 0)) for h in hits}).join(carried, [by, "__part"])
    # precision falls between hits, so the envelope is made by hits alone, and only they add to the area
    r = r.select(by, "__part", "__k", *[F.when(F.col(h) == 1, (F.col(f"{h}_tp") + F.col(f"{h}_before")) / (F.col("__k") + F.col("__k0"))).alias(h) for h in hits])
    tops = r.groupBy(by, "__part").agg(*[F.max(h).alias(h) for h in hits])
    beyond = tops.select(by, "__part", *[F.max(h).over(later).alias(f"{h}_beyond") for h in hits])
    r = r.withColumns({f"{h}_rest": F.max(h).over(onward) for h in hits}).join(beyond, [by, "__part"])
    return r.groupBy(by).agg(*[F.sum(F.when(F.col(h).isNotNull(), F.greatest(f"{h}_rest", f"{h}_beyond"))).alias(h) for h in hits])


def average_precision(scored: DataFrame, n_truths: DataFrame, by: str, score: str, order: list) -> DataFrame:
    """All-point AP of ranked hits, best ``score`` first, ties by ``order`` [H5, H6]. scored: ``by``, hit, score, order columns;
    n_truths: ``by``, n. Groups without a prediction have 0."""
    area = hit_areas(scored, by, score, order, ["hit"])
    return n_truths.join(area, by, "left").select(by, F.round(F.coalesce(F.col("hit") / F.col("n"), F.lit(0.0)), 6).alias("ap"))


def coco_map(preds: DataFrame, truths: DataFrame, group: str, kind: str) -> DataFrame:
    """ap50, ap75 and map: average precision over the union of classes at IoU .50 to .95 by .05, averaged over classes and
    thresholds [H7]. preds: ``group``, ``kind``, pred_id, score, bbox; truths: ``group``, ``kind``, truth_id, bbox. A class without
    truths, or without predictions, counts as 0. The matching is staged, since ranks, counts and classes all read it."""
    found = stage(greedy_levels(preds, truths, [group, kind], COCO_AT), "matched-boxes")
    n = found.select(kind, F.lit(0).alias("n")).union(truths.select(kind, F.lit(1).alias("n"))).groupBy(kind).agg(F.sum("n").alias("n"))
    hits = [f"hit{i}" for i in range(len(COCO_AT))]
    scored = found.select(kind, group, "pred_id", "score", *[(F.col("found").bitwiseAND(F.lit(1 << i)) > 0).alias(h) for i, h in enumerate(hits)])
    areas = hit_areas(scored, kind, "score", [F.col(group), F.col("pred_id")], hits)
    ap = n.join(areas, kind, "left").select(*[F.coalesce(F.when(F.col("n") > 0, F.round(F.col(h) / F.col("n"), 6)), F.lit(0.0)).alias(h) for h in hits])
    mean = ap.agg(*[F.avg(h).alias(h) for h in hits])
    total = reduce(Column.__add__, [F.col(h) for h in hits])
    return mean.select(F.round(hits[COCO_AT.index(0.5)], 5).alias("ap50"), F.round(hits[COCO_AT.index(0.75)], 5).alias("ap75"), F.round(total / len(hits), 5).alias("map"))


def fit_temperature(df: DataFrame, logits: str, label: str) -> DataFrame:
    """The temperature of least mean negative log-likelihood: 19 values in [0.5, 5], then 21 within a quarter of the best [G20].

    All temperatures of a grid are one aggregate of one pass over the rows."""
    z, y = F.col(logits), F.col(label)

    def nll(t: float) -> Column:
        top = F.array_max(z).cast("double")
        total = F.aggregate(F.transform(z, lambda v: F.exp((v.cast("double") - top) / t)), F.lit(0.0), lambda s, v: s + v)
        return F.avg(F.ln(total) - (F.element_at(z, y.cast("int") + 1).cast("double") - top) / t)

    def best(grid: list[float]) -> float:
        row = df.agg(*[nll(t).alias(f"t{i}") for i, t in enumerate(grid)]).first()
        return min((round(row[i], 12), t) for i, t in enumerate(grid) if row[i] is not None)[1] if row[0] is not None else 1.0

    first = best([0.5 + 0.25 * i for i in range(19)])
    second = best([max(1e-3, first - 0.25 + 0.025 * i) for i in range(21)])
    return df.agg(F.lit(round(second, 6)).alias("temperature"), F.round(nll(1.0), 6).alias("nll_before"), F.round(nll(second), 6).alias("nll_after"))


# --- stand-ins on the tables --------------------------------------------------------------------------------------------------

def _judged(spark: SparkSession, d: str) -> DataFrame:
    """Events as judged answers: a confidence of one digit, and whether it was right."""
    return scan(spark, d, "events").where("value is not null").select(
        "event_id", (F.floor(F.abs("value")) % 11 / 10.0).alias("conf"), (F.col("user_id") % 3 == 0).alias("ok"), "event_type")


_JUDGED = "judged AS (SELECT event_id, (floor(abs(value)) % 11) / 10.0::DOUBLE AS conf, user_id % 3 = 0 AS ok, event_type FROM events WHERE value IS NOT NULL)"
_PRF = ("tp, fp, fn, round(tp / (tp + fp + 1e-9), 6) AS precision, round(tp / (tp + fn + 1e-9), 6) AS recall, "
        "round(2 * (tp / (tp + fp + 1e-9)) * (tp / (tp + fn + 1e-9)) / (tp / (tp + fp + 1e-9) + tp / (tp + fn + 1e-9) + 1e-9), 6) AS f1")


@R.add(f"WITH {_JUDGED}, c AS (SELECT coalesce(event_type, '__all__') AS grp, count(*) FILTER (ok AND conf >= 0.5) AS tp, count(*) FILTER (NOT ok AND conf >= 0.5) AS fp, count(*) FILTER (ok AND conf < 0.5) AS fn, count(*) FILTER (NOT ok AND conf < 0.5) AS tn FROM judged GROUP BY ROLLUP (event_type)) "
       f"SELECT grp, tn, {_PRF}, round(tp / (tp + fp + fn + 1e-9), 6) AS iou, round(2 * tp / (2 * tp + fp + fn + 1e-9), 6) AS dice FROM c")
def confusion_prf(spark, d):
    """Counts and scores of each group and of all."""
    df = _judged(spark, d).withColumn("said", F.col("conf") >= 0.5)
    t, g = F.col("ok"), F.col("said")
    c = df.rollup("event_type").agg(F.count_if(t & g).alias("tp"), F.count_if(~t & g).alias("fp"), F.count_if(t & ~g).alias("fn"), F.count_if(~t & ~g).alias("tn"))
    return prf(c.withColumn("grp", F.coalesce("event_type", F.lit("__all__"))).drop("event_type"), 6)


_LANGS = ["es", "ca", "fr", "en", "it", "de"]
_LABELLED = f"lab AS (SELECT record_id, language[1] AS truth, ocr.language AS guess FROM latest WHERE unit_type = 'region')"
_GRID = ", ".join(f"('{x}')" for x in _LANGS)
_MATRIX = f"{LATEST}, {_LABELLED}, cells AS (SELECT a.l AS truth, b.l AS guess, (SELECT count(*) FROM lab WHERE truth = a.l AND guess = b.l) AS n FROM (VALUES {_GRID}) a(l), (VALUES {_GRID}) b(l))"


def _language_matrix(spark: SparkSession, d: str) -> DataFrame:
    df = latest_records(spark, d).where("unit_type = 'region'").select(F.try_element_at("language", F.lit(1)).alias("t"), F.col("ocr.language").alias("g"))
    return confusion_matrix(df, "t", "g", _LANGS)


@R.add(f"WITH {_MATRIX} SELECT truth, guess, n FROM cells")
def label_confusion(spark, d):
    """A record's language against its text's, for the six languages."""
    return _language_matrix(spark, d)


@R.add(f"WITH {_MATRIX}, c AS (SELECT truth AS label, CAST(sum(n) FILTER (truth = guess) AS BIGINT) AS tp, CAST((SELECT sum(n) FROM cells x WHERE x.guess = cells.truth AND x.truth <> x.guess) AS BIGINT) AS fp, CAST(coalesce(sum(n) FILTER (truth <> guess), 0) AS BIGINT) AS fn FROM cells GROUP BY truth) SELECT label, {_PRF} FROM c")
def label_scores(spark, d):
    """Precision, recall and F1 of each language."""
    return class_scores(_language_matrix(spark, d))


@R.add(f"WITH {_JUDGED}, b AS (SELECT {_bins_sql('conf', 10)} AS bin, avg(conf) AS mc, avg(CAST(ok AS INTEGER)) AS acc, count(*) AS n FROM judged WHERE conf BETWEEN 0 AND 1 GROUP BY 1) SELECT CAST(i AS INTEGER) AS bin, round(coalesce(mc, 0), 6) AS mean_conf, round(coalesce(acc, 0), 6) AS accuracy, coalesce(n, 0) AS n FROM range(10) t(i) LEFT JOIN b ON b.bin = i")
def reliability_bins(spark, d):
    """Accuracy by confidence; 0.3 lies in the third bin, whose upper edge is a little above it."""
    return reliability(_judged(spark, d), "conf", "ok")


@R.add(f"WITH {_JUDGED}, b AS (SELECT {_bins_sql('conf', 15)} AS bin, abs(sum(CAST(ok AS DOUBLE)) - sum(conf)) AS gap, count(*) AS n FROM judged WHERE conf BETWEEN 0 AND 1 GROUP BY 1) SELECT round(sum(gap) / sum(n), 6) AS ece, CAST(sum(n) AS BIGINT) AS n FROM b")
def expected_calibration_error(spark, d):
    """E13."""
    return calibration_error(_judged(spark, d), "conf", "ok")


_CURVE = f"""{_JUDGED}, th AS (SELECT round(0.05 * i, 2)::DOUBLE AS threshold FROM range(1, 20) t(i)), c AS (SELECT threshold, count(*) FILTER (ok AND conf >= threshold) AS tp, count(*) FILTER (NOT ok AND conf >= threshold) AS fp,
    count(*) FILTER (ok AND conf < threshold) AS fn FROM judged, th GROUP BY threshold), curve AS (SELECT threshold, tp, fp, fn, round(tp / (tp + fp + 1e-9), 6) AS precision, round(tp / (tp + fn + 1e-9), 6) AS recall FROM c)"""


@R.add(f"WITH {_CURVE} SELECT * FROM curve")
def precision_recall_curve(spark, d):
    """E15."""
    return pr_curve(_judged(spark, d), "conf", "ok")


@R.add(f"WITH {_CURVE}, s AS (SELECT recall, precision, lag(recall) OVER (ORDER BY recall, precision) AS r0, lag(precision) OVER (ORDER BY recall, precision) AS p0 FROM curve) SELECT round(coalesce(sum((recall - r0) * (precision + p0) / 2), 0), 6) AS auc FROM s")
def pr_curve_area(spark, d):
    """E16."""
    return curve_area(pr_curve(_judged(spark, d), "conf", "ok"))


@R.add(f"WITH {_JUDGED}, g AS (SELECT conf, count(*) AS n, count(*) FILTER (ok) AS k FROM judged GROUP BY conf), r AS (SELECT conf, sum(n) OVER (ORDER BY conf DESC) AS cn, sum(k) OVER (ORDER BY conf DESC) AS ck, sum(n) OVER () AS total FROM g) SELECT conf, round(cn / total, 6) AS coverage, round(1 - ck / cn, 6) AS risk FROM r")
def risk_coverage(spark, d):
    """H8: error among the most confident answers. Equal confidences are one step, so the running sums are over levels, not rows."""
    g = _judged(spark, d).groupBy("conf").agg(F.count("*").alias("n"), F.count_if("ok").alias("k"))
    w = W.orderBy(F.desc("conf"))
    r = g.select("conf", F.sum("n").over(w).alias("cn"), F.sum("k").over(w).alias("ck"), F.sum("n").over(W.partitionBy()).alias("total"))
    return r.select("conf", F.round(F.col("cn") / F.col("total"), 6).alias("coverage"), F.round(1 - F.col("ck") / F.col("cn"), 6).alias("risk"))


@R.add(f"WITH {_JUDGED}, n AS (SELECT event_type, count(*) FILTER (ok) AS n FROM judged GROUP BY event_type HAVING n > 0), s AS (SELECT event_type, event_id, row_number() OVER w AS k, sum(CAST(ok AS INTEGER)) OVER w AS tp FROM judged WINDOW w AS (PARTITION BY event_type ORDER BY conf DESC, event_id ROWS UNBOUNDED PRECEDING)), "
       "e AS (SELECT s.event_type, k, tp / n AS recall, max(tp / k) OVER (PARTITION BY s.event_type ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env FROM s JOIN n ON n.event_type = s.event_type), "
       "p AS (SELECT *, recall - coalesce(lag(recall) OVER (PARTITION BY event_type ORDER BY k), 0) AS step FROM e) SELECT event_type, round(sum(step * env), 6) AS ap FROM p GROUP BY event_type")
def average_precision_by_type(spark, d):
    """H5, H6: all-point average precision of each type."""
    df = _judged(spark, d)
    n = df.groupBy("event_type").agg(F.count_if("ok").alias("n")).where("n > 0")
    return average_precision(df.withColumn("hit", F.col("ok")), n, "event_type", "conf", [F.col("event_id")])


@R.add()
def greedy_box_match(spark, d):
    """Marks matched with regions of their page, one to one."""
    preds = mark_boxes(spark, d).select("page_id", F.col("mark_id").alias("pred_id"), F.col("conf").alias("score"), "bbox").dropDuplicates(["page_id", "pred_id"])
    truths = text_boxes(spark, d).select("page_id", F.col("region_id").alias("truth_id"), "bbox")
    return greedy_match(preds, truths, ["page_id"], 0.10)


@R.add()
def detection_map(spark, d):
    """H7: ap50, ap75 and map over .50 to .95 by layer: the viewer's regions, grown by a tenth, against the records' regions."""
    from foliant.operators.layouts import expanded

    layer = lambda c: F.substring(c, 1, 2)
    views = scan(spark, d, "page_detail").select("page_id", F.explode(F.concat(F.coalesce("printed_regions", F.array().cast(scan(spark, d, "page_detail").schema["printed_regions"].dataType)),
                                                                               F.coalesce("handwritten_regions", F.array().cast(scan(spark, d, "page_detail").schema["handwritten_regions"].dataType)))).alias("v"))
    preds = views.where("v.region_id <> '' and size(v.bbox) = 4").select("page_id", layer("v.region_id").alias("kind"), F.col("v.region_id").alias("pred_id"), F.coalesce("v.confidence", F.lit(0.0)).alias("score"),
                                                                        expanded(F.col("v.bbox"), 0.1, 2480, 3508).alias("bbox")).dropDuplicates(["page_id", "pred_id"])
    truths = text_boxes(spark, d).select("page_id", layer("region_id").alias("kind"), F.col("region_id").alias("truth_id"), "bbox")
    return coco_map(preds, truths, "page_id", "kind")


_Z = "z AS (SELECT vec_id, label % 5 AS y, list_transform(embedding[1:5], lambda v: v::DOUBLE) AS z FROM embeddings), zz AS (SELECT *, list_max(z) AS m FROM z)"


def _logits(spark: SparkSession, d: str) -> DataFrame:
    return scan(spark, d, "embeddings").select("vec_id", (F.col("label") % 5).alias("y"), F.transform(F.slice("embedding", 1, 5), lambda v: v.cast("double")).alias("z"))


@R.add(f"WITH {_Z}, e AS (SELECT vec_id, y, list_transform(z, lambda v: exp(v - m)) AS e FROM zz), p AS (SELECT vec_id, y, list_transform(e, lambda v: v / list_sum(e)) AS p FROM e) SELECT vec_id, CAST(list_position(p, list_max(p)) - 1 AS INTEGER) AS class, round(list_max(p), 6) AS conf, round(1 - list_max(p), 6) AS margin, "
       "round(-list_sum(list_transform(p, lambda v: least(greatest(v, 1e-6), 1) * ln(least(greatest(v, 1e-6), 1)))) / ln(5), 6) AS entropy, CASE WHEN list_max(p) < 0.55 THEN 'unknown' ELSE CAST(list_position(p, list_max(p)) - 1 AS VARCHAR) END AS decision FROM p")
def selective_classification(spark, d):
    """Class, confidence and uncertainty of logits, and ``unknown`` below 0.55."""
    p = F.col("p")
    df = _logits(spark, d).select("vec_id", V.softmax(F.col("z")).alias("p"))
    return df.select("vec_id", V.argmax(p).alias("class"), F.round(F.array_max(p), 6).alias("conf"), F.round(V.margin_uncertainty(p), 6).alias("margin"), F.round(V.entropy_uncertainty(p), 6).alias("entropy"),
                     F.when(F.array_max(p) < 0.55, "unknown").otherwise(V.argmax(p).cast("string")).alias("decision"))


_NLL = "avg(ln(list_sum(list_transform(z, lambda v: exp((v - m) / t)))) - (z[CAST(y AS INTEGER) + 1] - m) / t)"


@R.add(f"WITH {_Z}, g1 AS (SELECT (0.5 + 0.25 * i)::DOUBLE AS t FROM range(19) r(i)), s1 AS (SELECT t, round({_NLL}, 12) AS l FROM zz, g1 GROUP BY t), b1 AS (SELECT t AS t1 FROM s1 ORDER BY l, t LIMIT 1), "
       f"g2 AS (SELECT greatest(0.001, t1 - 0.25 + 0.025 * i)::DOUBLE AS t FROM range(21) r(i), b1), s2 AS (SELECT t, round({_NLL}, 12) AS l FROM zz, g2 GROUP BY t), b2 AS (SELECT round(t, 6) AS t, round(l, 6) AS l FROM s2 ORDER BY s2.l, s2.t LIMIT 1), "
       f"b0 AS (SELECT round({_NLL}, 6) AS l FROM zz, (SELECT 1.0::DOUBLE AS t)) SELECT b2.t AS temperature, b0.l AS nll_before, b2.l AS nll_after FROM b2, b0")
def temperature_fit(spark, d):
    """G20, K5."""
    return fit_temperature(_logits(spark, d), "z", "y")


_FIT = (f"{_Z}, g1 AS (SELECT (0.5 + 0.25 * i)::DOUBLE AS t FROM range(19) r(i)), s1 AS (SELECT t, round({_NLL}, 12) AS l FROM zz, g1 GROUP BY t), b1 AS (SELECT t AS t1 FROM s1 ORDER BY l, t LIMIT 1), "
        f"g2 AS (SELECT greatest(0.001, t1 - 0.25 + 0.025 * i)::DOUBLE AS t FROM range(21) r(i), b1), s2 AS (SELECT t, round({_NLL}, 12) AS l FROM zz, g2 GROUP BY t), b2 AS (SELECT round(t, 6) AS t FROM s2 ORDER BY s2.l, s2.t LIMIT 1)")


@R.add(f"WITH {_FIT}, ways AS (SELECT 'before' AS state, 1.0::DOUBLE AS t UNION ALL SELECT 'after', t FROM b2), e AS (SELECT state, y, list_transform(z, lambda v: exp((v - m) / t)) AS e FROM zz, ways), "
       "c AS (SELECT state, list_max(e) / list_sum(e) AS conf, CAST(list_position(e, list_max(e)) - 1 = y AS INTEGER) AS ok FROM e), "
       "g AS (SELECT state, least(14, CAST(floor(conf * 15) AS INTEGER)) AS bin, count(*) AS n, avg(conf) AS conf, avg(ok) AS acc FROM c GROUP BY ALL) SELECT state, CAST(sum(n) AS BIGINT) AS n, round(sum(n * abs(acc - conf)) / sum(n), 5) AS ece, round(sum(n * acc) / sum(n), 5) AS accuracy FROM g GROUP BY state")
def temperature_calibration(spark, d):
    """Expected calibration error over 15 bins before and after the fitted temperature."""
    df = _logits(spark, d)
    t = fit_temperature(df, "z", "y").first()["temperature"]
    out = []
    for state, x in (("before", 1.0), ("after", t)):
        p = df.select("y", V.softmax(F.col("z"), x).alias("p")).select(F.array_max("p").alias("conf"), (V.argmax(F.col("p")) == F.col("y")).cast("int").alias("ok"))
        out.append(p.select(F.lit(state).alias("state"), F.least(F.lit(14), F.floor(F.col("conf") * 15).cast("int")).alias("bin"), "conf", "ok"))
    g = out[0].unionByName(out[1]).groupBy("state", "bin").agg(F.count("*").alias("n"), F.avg("conf").alias("conf"), F.avg("ok").alias("acc"))
    return g.groupBy("state").agg(F.sum("n").alias("n"), F.round(F.sum(F.col("n") * F.abs(F.col("acc") - F.col("conf"))) / F.sum("n"), 5).alias("ece"), F.round(F.sum(F.col("n") * F.col("acc")) / F.sum("n"), 5).alias("accuracy"))


@R.add()
def transcription_errors(spark, d):
    """Character and word error rates of the transcription samples, as they are and normalised, by layer."""
    s = scan(spark, d, "transcription_samples").where("ground_truth is not null")
    s = s.select("layer", F.col("ground_truth").alias("t"), F.coalesce("hypothesis", F.lit("")).alias("h"), "confidence")
    s = s.withColumn("nt", T.normalize_text("t")).withColumn("nh", T.normalize_text("h"))
    return s.groupBy("layer").agg(
        F.count("*").alias("n"), F.round(F.avg(T.char_error_rate(F.col("t"), F.col("h"))), 6).alias("cer"), F.round(F.avg(T.word_error_rate("t", "h")), 6).alias("wer"),
        F.round(F.avg(T.char_error_rate(F.col("nt"), F.col("nh"))), 6).alias("cer_normalised"), F.round(F.avg(T.word_error_rate("nt", "nh")), 6).alias("wer_normalised"), F.round(F.avg((F.col("t") == F.col("h")).cast("int")), 6).alias("exact"))


@R.add("SELECT o.o_orderpriority AS a, count(*) AS n, round(avg(levenshtein(p_name, p_type) / length(p_name)), 6) AS cer FROM part JOIN orders o ON o.o_orderkey = p_partkey GROUP BY 1")
def ascii_error_rate(spark, d):
    """F16 on plain ASCII text, where SQL's distance counts the same characters."""
    p = scan(spark, d, "part").join(scan(spark, d, "orders"), F.col("o_orderkey") == F.col("p_partkey"))
    return p.groupBy(F.col("o_orderpriority").alias("a")).agg(F.count("*").alias("n"), F.round(F.avg(T.char_error_rate(F.col("p_name"), F.col("p_type"))), 6).alias("cer"))


@R.add(f"WITH {LATEST}, w AS (SELECT record_id, list_transform(ocr.word_confidences, lambda x: ln(greatest(x.confidence, 1e-9))) AS l FROM latest WHERE unit_type = 'region') SELECT record_id, round(CASE WHEN len(l) > 0 THEN exp(list_sum(l) / len(l)) ELSE 0 END, 6) AS mean_conf, round(CASE WHEN len(l) > 0 THEN exp(list_min(l)) ELSE 0 END, 6) AS least_conf FROM w")
def logprob_confidences(spark, d):
    """Confidence of a text from the log-probabilities of its words."""
    lp = F.transform(F.coalesce("ocr.word_confidences.confidence", F.array().cast("array<double>")), lambda v: F.ln(F.greatest(v, F.lit(1e-9))))
    df = latest_records(spark, d).where("unit_type = 'region'").select("record_id", lp.alias("l"))
    return df.select("record_id", F.round(V.logprob_confidence(F.col("l")), 6).alias("mean_conf"), F.round(V.logprob_confidence(F.col("l"), "min"), 6).alias("least_conf"))


@R.add(f"WITH {LATEST}, {_TEXTS}, {_MARKS}, px AS (SELECT t.page_id, t.region_id, t.tb, m.b FROM texts t JOIN marks m ON m.page_id = t.page_id), i AS (SELECT page_id, region_id, tb, greatest(tb[1], b[1]) AS x0, greatest(tb[2], b[2]) AS y0, least(tb[1] + tb[3], b[1] + b[3]) AS x1, least(tb[2] + tb[4], b[2] + b[4]) AS y1 FROM px), "
       "c AS (SELECT * FROM i WHERE x1 > x0 AND y1 > y0), cells AS (SELECT DISTINCT page_id, region_id, cx, cy FROM (SELECT page_id, region_id, cx, unnest(range(CAST(y0 // 16 AS BIGINT), CAST((y1 - 1) // 16 AS BIGINT) + 1)) AS cy FROM (SELECT *, unnest(range(CAST(x0 // 16 AS BIGINT), CAST((x1 - 1) // 16 AS BIGINT) + 1)) AS cx FROM c))) "
       "SELECT page_id, region_id, count(*) AS covered_cells FROM cells GROUP BY ALL")
def region_coverage(spark, d):
    """How much of a region marks cover, in cells of 16 pixels so that marks over marks count once."""
    p = text_boxes(spark, d).select("page_id", "region_id", F.col("bbox").alias("t")).join(mark_boxes(spark, d).select("page_id", F.col("bbox").alias("m")), "page_id")
    t, m = F.col("t"), F.col("m")
    c = p.select("page_id", "region_id", F.greatest(t[0], m[0]).alias("x0"), F.greatest(t[1], m[1]).alias("y0"), F.least(t[0] + t[2], m[0] + m[2]).alias("x1"), F.least(t[1] + t[3], m[1] + m[3]).alias("y1")).where("x1 > x0 and y1 > y0")
    c = c.withColumn("cx", F.explode(F.expr("sequence(x0 div 16, (x1 - 1) div 16)"))).withColumn("cy", F.explode(F.expr("sequence(y0 div 16, (y1 - 1) div 16)")))
    return c.select("page_id", "region_id", "cx", "cy").distinct().groupBy("page_id", "region_id").agg(F.count("*").alias("covered_cells"))


QUERIES, SQL = R.queries, R.sql
