"""The verbs of the engine: build an index, retrieve, query through the router, evaluate; and what the viewer shows."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from foliant.functions import text as T
from foliant.operators import archive, retrieval, router, spatial
from foliant.plans.ranks import place_in
from foliant.plans.registry import Registry
from foliant.plans.staging import scan, stage
from foliant.sources.sinks import write_nodes

R = Registry()


@dataclass(frozen=True)
class Config:
    """Settings of retrieval [L6]."""

    top_k: int = retrieval.TOP_K
    cutoff: float = retrieval.CUTOFF
    pool: int = retrieval.POOL
    rrf_constant: int = retrieval.RRF_K
    k1: float = retrieval.K1
    b: float = retrieval.B
    evaluation_ks: tuple[int, ...] = (1, 3, 5, 10)
    router_confidence: float = 0.70
    evidence: int = 5
    collection: str = "records"
    index_path: str = ""


def filter_columns(**wanted: str | None) -> list[Column]:
    """Predicates of the named fields [C10]: language by containment, all others by equality."""
    return [retrieval.contains(k, v) if k == "language" else retrieval.equals(k, v) for k, v in wanted.items() if v is not None]


def build(records: DataFrame, vectors: DataFrame | None, path: str) -> None:
    """The index of records: text and metadata of each, with its vector where there is one [B4, L4]."""
    nodes = records.select(F.col("record_id").alias("node_id"), archive.retrieval_text().alias("text"), *archive.metadata_columns(records)[1:])
    nodes = nodes.join(vectors, "node_id", "left") if vectors is not None else nodes.withColumn("embedding", F.lit(None).cast("array<float>"))
    write_nodes(nodes.withColumn("embedding", F.coalesce("embedding", F.array().cast("array<float>"))), path)


def retrieve(nodes: DataFrame, questions: DataFrame, mode: str, filters: list[Column] = (), vectors: DataFrame | None = None, config: Config = Config()) -> DataFrame:
    """(question_id, node_id, score, rank) in a mode [J7, J8]. Filters come first, so lexical statistics are of the filtered nodes;
    the cut-off applies to ``vector`` only, after the top k. The older modes ``metadata_lookup`` and ``provenance_lookup`` are
    served by vectors, others by fusion.

    nodes: node_id, text, embedding, metadata; vectors: question_id, embedding."""
    kept = nodes.where(retrieval.all_of(*filters))
    if mode == "bm25":
        return retrieval.bm25(kept, questions, config.top_k, config.k1, config.b)
    ranked = retrieval.vector_search(kept, vectors, config.top_k, exclude_self=False)
    if mode in ("vector", "metadata_lookup", "provenance_lookup"):
        return ranked.where(F.col("score") >= config.cutoff) if mode == "vector" else ranked
    lexical = retrieval.bm25(kept, questions, max(config.top_k, config.pool), config.k1, config.b)
    return retrieval.fuse(ranked, lexical, k=config.top_k, constant=config.rrf_constant)


def plan(question: str, explicit: list[tuple[str, str, str]] = ()) -> router.QueryPlan:
    """The plan of one question [J10, C9], explicit filters before those its words imply. Runs on the driver."""
    from pyspark.sql import SparkSession

    row = SparkSession.active().createDataFrame([(question,)], "q string").select(router.route(F.col("q")).alias("m"), router.inferred_filters(F.col("q")).alias("f")).first()
    inferred = [(*f.split("=", 1), "eq") for f in row.f]
    return router.QueryPlan(row.m, [*explicit, *[(k, "eq", v) for k, v, _ in inferred]], confidence=1.0 if row.m != "vector" or inferred else None)


def node_set(nodes: DataFrame, filters: list[tuple[str, str, str]], path: str) -> DataFrame:
    """The nodes that pass filters, from ``path`` if they were written there for these filters, in whatever order [J13, F21]."""
    import hashlib

    at = f"{path}/{hashlib.md5(router.filters_key(filters).encode()).hexdigest()}"
    try:
        return nodes.sparkSession.read.parquet(at)
    except Exception:  # not there or not readable: written again
        wanted = [retrieval.contains(k, v) if op == "contains" else retrieval.equals(k, v) for k, op, v in filters]
        nodes.where(retrieval.all_of(*wanted)).write.mode("overwrite").parquet(at)
        return nodes.sparkSession.read.parquet(at)


def query(nodes: DataFrame, question: str, vector: list[float] | None = None, config: Config = Config()) -> DataFrame:
    """What answers one question [J12, L4]: routed, filtered, retrieved, with metadata and rank."""
    p = plan(question)
    spark = nodes.sparkSession
    asked = spark.createDataFrame([(0, question)], "question_id long, question string")
    columns = [retrieval.contains(k, v) if op == "contains" else retrieval.equals(k, v) for k, op, v in p.filters]
    if vector is None:
        found = retrieve(nodes, asked, "bm25", columns, config=config)
    else:
        mode = "hybrid" if p.mode == "provenance_lookup" else p.mode
        found = retrieve(nodes, asked, mode, columns, spark.createDataFrame([(0, [float(x) for x in vector])], "question_id long, embedding array<float>"), config)
    return found.join(nodes.drop("embedding"), "node_id").orderBy("rank")


def answer(nodes: DataFrame, question: str, vector: list[float] | None = None, config: Config = Config(), mode: str | None = None) -> DataFrame:
    """One question's answer envelope [J12, J15]: the answer text with its confidence, filters, evidence and doubts. A mode
    ``metadata_lookup`` gives the first nodes that pass the filters, whatever they say [J9]."""
    p = plan(question)
    mode = mode or p.mode
    if mode == "metadata_lookup":
        columns = [retrieval.contains(k, v) if op == "contains" else retrieval.equals(k, v) for k, op, v in p.filters]
        found = nodes.where(retrieval.all_of(*columns)).orderBy("node_id").limit(config.top_k).drop("embedding") \
            .select(F.lit(0).cast("long").alias("question_id"), F.lit(1.0).alias("score"), F.row_number().over(W.orderBy("node_id")).alias("rank"), "*")
    else:
        found = query(nodes, question, vector, config)
    found = found.select("question_id", "rank", "score", F.col("node_id").alias("record_id"), "document_id", "page_id", "verification_status", (F.col("human_review_required") == "true").alias("review"),
                         F.col("forensic_confidence_score").alias("flags_score"), "alerts", F.col("source_image_path").alias("path"))
    asked = nodes.sparkSession.createDataFrame([(0, question, ",".join(f"{k}={v}" for k, _, v in p.filters))], "question_id long, question string, applied_filters string")
    return retrieval.envelopes(found, asked, "metadata_lookup" if mode == "metadata_lookup" else "provenance_lookup")


def evaluate(rankings: dict[str, DataFrame], relevant: DataFrame, config: Config = Config()) -> DataFrame:
    """Mean quality of each ranking [E17, J14]."""
    each = [retrieval.ranking_quality(r, relevant, config.evaluation_ks).withColumn("mode", F.lit(m)) for m, r in rankings.items()]
    names = [f"{m}_{k}" for k in config.evaluation_ks for m in ("hit", "recall", "precision", "ndcg")]
    return reduce(DataFrame.unionByName, each).groupBy("mode").agg(F.avg("rr").alias("mrr"), *[F.avg(n).alias(n) for n in names])


_REL = """rel AS (SELECT DISTINCT e.question_id, doc_id AS node_id FROM (SELECT question_id, string_split(r, '__')[1] AS doc FROM (SELECT question_id, unnest(expected_record_ids) AS r FROM eval_questions WHERE question IS NOT NULL) WHERE r <> '') e
    JOIN documents ON documents.document_id = e.doc)"""
_MODES = f"""{retrieval._HYBRID}, {router._ROUTED.replace("q AS (", "rq AS (").replace("FROM q)", "FROM rq)").replace("r AS (SELECT question_id, CASE", "rt AS (SELECT question_id, CASE")}, {_REL},
    ways AS (SELECT 'vector' AS mode, question_id, node_id, rank FROM vec UNION ALL SELECT 'bm25', question_id, node_id, rank FROM lex WHERE rank <= 8 UNION ALL SELECT 'hybrid', question_id, node_id, rank FROM hyb
        UNION ALL SELECT 'router', v.question_id, node_id, rank FROM vec v JOIN rt ON rt.question_id = v.question_id WHERE rt.mode = 'vector' AND score >= 0.45
        UNION ALL SELECT 'router', h.question_id, node_id, rank FROM hyb h JOIN rt ON rt.question_id = h.question_id WHERE rt.mode <> 'vector'),
    m AS (SELECT w.mode, rel.*, ways.rank FROM rel CROSS JOIN (VALUES ('vector'), ('bm25'), ('hybrid'), ('router')) w(mode) LEFT JOIN ways ON ways.mode = w.mode AND ways.question_id = rel.question_id AND ways.node_id = rel.node_id),
    quality AS (SELECT mode, {retrieval._QUALITY} FROM m GROUP BY mode, question_id)"""


def _rankings(spark, d: str) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """Rankings of the questions by mode, their relevant documents, and (question_id, route)."""
    vec, lex, _ = retrieval.hybrid(spark, d)
    vec, lex = (stage(r.select("question_id", "node_id", "score", "rank"), "rankings") for r in (vec, lex))  # each is used by several modes
    both = stage(retrieval.fuse(vec, lex), "rankings")
    routes = retrieval.questions(spark, d).groupBy("question_id").agg(F.min("question").alias("q")).select("question_id", router.route(F.col("q")).alias("route"))
    routed = vec.where(F.col("score") >= retrieval.CUTOFF).join(routes.where("route = 'vector'"), "question_id", "left_semi").unionByName(both.join(routes.where("route <> 'vector'"), "question_id", "left_semi"))
    expected = scan(spark, d, "eval_questions").where("question is not null").select("question_id", F.explode("expected_record_ids").alias("r")).where("r <> ''").select("question_id", F.element_at(F.split("r", "__"), 1).alias("document_id"))
    relevant = expected.distinct().join(scan(spark, d, "documents").select("document_id", F.col("doc_id").alias("node_id")), "document_id").select("question_id", "node_id").distinct()
    return {"vector": vec, "bm25": lex.where(F.col("rank") <= retrieval.TOP_K), "hybrid": both, "router": routed}, relevant, routes


@R.add(f"""WITH {_MODES} SELECT mode, count(*) AS n_questions, round(avg(rr), 5) AS mrr, {", ".join(f"round(avg(hit_{k}), 5) AS hit_{k}, round(avg(recall_{k}), 5) AS recall_{k}, round(avg(ndcg_{k}), 5) AS ndcg_{k}" for k in (1, 3, 5))} FROM quality GROUP BY mode""")
def retrieval_ablation(spark, d):
    """Mean quality of vector, bm25 and hybrid retrieval and of what the router chooses; documents of the expected records'
    archive documents are relevant."""
    rankings, relevant, _ = _rankings(spark, d)
    each = [retrieval.ranking_quality(r, relevant, (1, 3, 5)).withColumn("mode", F.lit(m)) for m, r in rankings.items()]
    return reduce(DataFrame.unionByName, each).groupBy("mode").agg(F.count("*").alias("n_questions"), F.round(F.avg("rr"), 5).alias("mrr"), *[F.round(F.avg(f"{m}_{k}"), 5).alias(f"{m}_{k}") for k in (1, 3, 5) for m in ("hit", "recall", "ndcg")])


@R.add(f"WITH {_MODES} SELECT rt.mode AS route, count(*) AS n_questions, round(avg(hit_5), 5) AS hit_rate FROM quality JOIN rt ON rt.question_id = quality.question_id WHERE quality.mode = 'router' GROUP BY rt.mode")
def route_hit_rates(spark, d):
    """How often the router's choice finds a relevant document among the first five, by route."""
    rankings, relevant, routes = _rankings(spark, d)
    q = retrieval.ranking_quality(rankings["router"], relevant, (5,)).join(routes, "question_id")
    return q.groupBy("route").agg(F.count("*").alias("n_questions"), F.round(F.avg("hit_5"), 5).alias("hit_rate"))


@R.add(f"WITH {archive.LATEST} SELECT 'find the ' || lower(title) AS question, record_id, row_number() OVER (PARTITION BY lower(title) ORDER BY record_id) AS place FROM latest WHERE title <> ''")
def title_questions(spark, d):
    """A question for each title with the records expected, one a row and numbered, so that a common title is no long list."""
    df = archive.latest_records(spark, d).where("title <> ''").select(F.concat(F.lit("find the "), F.lower("title")).alias("question"), "record_id")
    return place_in(df, ["question"], F.substring("record_id", 1, 14), ["record_id"])


@R.add("SELECT doc_id, source, CAST(instr(lower(text), 'crónica del domingo') AS INTEGER) AS place FROM documents WHERE contains(lower(text), 'crónica del domingo')")
def phrase_lookup(spark, d):
    """Documents with an exact phrase, in any case, and where it begins."""
    t = F.lower("text")
    return scan(spark, d, "documents").where(F.contains(t, F.lit("crónica del domingo"))).select("doc_id", "source", F.instr(t, F.lit("crónica del domingo")).alias("place"))


@R.add(f"WITH {archive.LATEST}, {spatial._TEXTS} SELECT page_id, region_id, round(least(greatest(1 - text_conf, 0), 1), 6) AS heat FROM texts WHERE len(tb) = 4")
def heatmap(spark, d):
    """How doubtful each region with a box is."""
    heat = F.least(F.greatest(1 - F.col("conf"), F.lit(0.0)), F.lit(1.0))
    return spatial.text_boxes(spark, d).select("page_id", "region_id", F.round(heat, 6).alias("heat"))


@R.add(f"WITH {archive.LATEST}, {spatial._MARKS} SELECT page_id, mark_id, row_number() OVER (PARTITION BY page_id ORDER BY b[2], b[1], mark_id) AS place FROM marks")
def mark_order(spark, d):
    """Marks from above, then from left."""
    b = F.col("bbox")
    return spatial.mark_boxes(spark, d).select("page_id", "mark_id", F.row_number().over(W.partitionBy("page_id").orderBy(b[1], b[0], "mark_id")).alias("place"))


@R.add(f"WITH {archive.LATEST}, p AS (SELECT DISTINCT page_id FROM latest WHERE unit_type = 'page') SELECT page_id, CAST(x AS INTEGER) AS tx, CAST(y AS INTEGER) AS ty FROM p, range(0, 2480, 384) a(x), range(0, 3508, 384) b(y)")
def sliding_patches(spark, d):
    """Patches of 768 pixels at every 384."""
    pages = archive.latest_records(spark, d).where("unit_type = 'page'").select("page_id").distinct()
    return spatial.tile_grid(pages, F.lit(2480), F.lit(3508), 768, 384)


@R.add("WITH c AS (SELECT l_orderkey % 100 AS batch, l_linenumber AS cls, count(*) FILTER (l_discount > 0.05 AND l_tax > 0.04) AS i, count(*) FILTER (l_discount > 0.05 OR l_tax > 0.04) AS u FROM lineitem GROUP BY ALL), m AS (SELECT cls, avg((i + 1e-6) / (u + 1e-6)) AS iou FROM c GROUP BY cls) SELECT cls, round(iou, 6) AS iou FROM m")
def batch_iou(spark, d):
    """IoU of masks averaged over batches, not pooled."""
    a, b = F.col("l_discount") > 0.05, F.col("l_tax") > 0.04
    c = scan(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 100).alias("batch"), F.col("l_linenumber").alias("cls")).agg(F.count_if(a & b).alias("i"), F.count_if(a | b).alias("u"))
    return c.groupBy("cls").agg(F.round(F.avg((F.col("i") + 1e-6) / (F.col("u") + 1e-6)), 6).alias("iou"))


@R.add(f"WITH {archive.LATEST}, {spatial._TEXTS} SELECT layer, t, count(*) FILTER (text_conf > t) AS n_above, count(*) AS n FROM texts, (VALUES (0.3::DOUBLE), (0.5::DOUBLE), (0.7::DOUBLE), (0.8::DOUBLE), (0.9::DOUBLE)) v(t) GROUP BY layer, t")
def threshold_sweep(spark, d):
    """Regions above each threshold by layer; one pass, a column a threshold, then unpivoted."""
    grid = [0.3, 0.5, 0.7, 0.8, 0.9]
    wide = spatial.text_boxes(spark, d).groupBy("layer").agg(F.count("*").alias("n"), *[F.count_if(F.col("conf") > t).alias(f"t{i}") for i, t in enumerate(grid)])
    rows = F.array(*[F.struct(F.lit(t).alias("t"), F.col(f"t{i}").alias("n_above")) for i, t in enumerate(grid)])
    return wide.select("layer", "n", F.inline(rows)).select("layer", "t", "n_above", "n")


@R.add()
def normalised_titles(spark, d):
    """titles of harvested documents in their normal form."""
    return scan(spark, d, "harvest_index").select("id", "title").distinct().select("id", T.normalize_text("title").alias("title"))


QUERIES, SQL = R.queries, R.sql
