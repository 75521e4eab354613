"""Retrieval: BM25, dense vectors, reciprocal rank fusion, metadata filters, and how good the rankings are.

Corpora are DataFrames of (node_id, text, ...), questions DataFrames of (question_id, question); all questions are
answered together. Questions are the stated query set: they are sent to all tasks in blocks of a fixed size, nodes are never
shuffled, and each task passes on its k best a question."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from foliant.functions import text as T
from foliant.operators.archive import LATEST, latest_records
from foliant.plans.registry import Registry
from foliant.plans.staging import bounded, scan, spread

R = Registry()
K1, B, TOP_K, POOL, RRF_K, CUTOFF = 1.5, 0.75, 8, 50, 60, 0.45
#: Queries that are broadcast at once.
QUERY_BLOCK = 20_000


def equals(column: str, value: str) -> Column:
    """Strict equality; null never matches [C7]."""
    return F.col(column) == F.lit(value)


def contains(column: str, value: str) -> Column:
    """Case-sensitive substring; null counts as the empty text [C8]."""
    return F.contains(F.coalesce(F.col(column).cast("string"), F.lit("")), F.lit(value))


def all_of(*predicates: Column) -> Column:
    """Conjunction of explicit and inferred predicates [C9]."""
    return reduce(lambda a, b: a & b, predicates, F.lit(True))


def rank(df: DataFrame, by: str, k: int, *order) -> DataFrame:
    """The first k rows of each group with their rank [H1, I1]."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


def _trim(q: np.ndarray, ids: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each question, best first, ties by id."""
    order = np.lexsort((np.unique(ids, return_inverse=True)[1], -s, q))
    q, ids, s = q[order], ids[order], s[order]
    at = np.arange(len(q))
    start = np.maximum.accumulate(np.where(np.r_[True, q[1:] != q[:-1]], at, 0)) if len(q) else at
    keep = at - start < k
    return q[keep], ids[keep], s[keep]


class _Best:
    """The k best nodes of every question that a task has seen so far; never more than a few times questions x k are held."""

    def __init__(self, k: int, digits: int):
        self.k, self.scale, self.parts, self.n = k, 10.0**digits, [], 0

    def add(self, scores: np.ndarray, first: int, ids: np.ndarray) -> None:
        """scores: questions (from number ``first``) x nodes; what is NaN or -inf is no answer."""
        scores = np.floor(np.where(np.isnan(scores), -np.inf, scores) * self.scale + 0.5) / self.scale
        if scores.shape[1] > self.k:
            mask = scores >= -np.partition(-scores, self.k - 1, axis=1)[:, self.k - 1 : self.k]
        else:
            mask = np.ones(scores.shape, bool)
        q, d = np.nonzero(mask & (scores > -np.inf))
        self.parts.append(_trim(q + first, ids[d], scores[q, d], self.k))
        self.n += len(self.parts[-1][0])
        if len(self.parts) > 64:
            self.parts = [_trim(*map(np.concatenate, zip(*self.parts)), self.k)]

    def rows(self, names: np.ndarray) -> pd.DataFrame | None:
        if not self.n:
            return None
        q, ids, s = _trim(*map(np.concatenate, zip(*self.parts)), self.k)
        return pd.DataFrame({"question_id": names[q], "node_id": ids, "score": s})


def _blocks(questions: DataFrame) -> list[DataFrame]:
    """The stated query set in parts of about QUERY_BLOCK, each of which may be sent to all tasks."""
    blocks = max(1, -(-questions.count() // QUERY_BLOCK))
    return [questions] if blocks == 1 else [questions.where(F.pmod(F.xxhash64("question_id"), F.lit(blocks)) == i) for i in range(blocks)]


def _types(nodes: DataFrame, questions: DataFrame) -> str:
    return f"question_id {questions.schema['question_id'].dataType.simpleString()}, node_id {nodes.schema['node_id'].dataType.simpleString()}, score double"


def bm25(corpus: DataFrame, questions: DataFrame, k: int = TOP_K, k1: float = K1, b: float = B, digits: int = 6) -> DataFrame:
    """(question_id, node_id, score, rank): scores above 0, best first, ties by node id [J1-J4].

    Words of a question count as often as they occur. Statistics are those of ``corpus``: filter it first. The words of a block of
    questions are counted in one aggregate; the documents are then scored against the block, a matrix product a batch, and each
    task keeps its k best a question, so no posting is shuffled and a common word costs no more than a rare one."""
    docs = spread(corpus.where(F.length("text") > 0).select("node_id", "text")).select("node_id", T.tokens(F.col("text")).alias("w")).where(F.size("w") > 0)
    return reduce(DataFrame.unionByName, [_bm25_block(docs, q, k, k1, b, digits) for q in _blocks(questions)])


def _bm25_block(docs: DataFrame, questions: DataFrame, k: int, k1: float, b: float, digits: int) -> DataFrame:
    spark = docs.sparkSession
    asked = questions.select("question_id", F.explode(T.tokens(F.col("question"))).alias("term")).groupBy("question_id", "term").agg(F.count("*").alias("times"))
    q = asked.toPandas().sort_values(["question_id", "term"], ignore_index=True)
    n_docs, mean = docs.agg(F.count("*"), F.avg(F.size("w"))).first()
    df = docs.select(F.explode(F.array_distinct("w")).alias("term")).join(F.broadcast(asked.select("term").distinct()), "term").groupBy("term").agg(F.count("*").alias("df")).toPandas()
    known = df.sort_values("term", ignore_index=True)
    idf = np.log(1 + (n_docs - known["df"].to_numpy(float) + 0.5) / (known["df"].to_numpy(float) + 0.5))
    at = {t: i for i, t in enumerate(known["term"])}
    q = q[q["term"].isin(at.keys())]
    names, number = np.unique(q["question_id"].to_numpy(), return_inverse=True)
    # (number of the question, term, times), in order of the questions
    sent = spark.sparkContext.broadcast((names, number, np.array([at[t] for t in q["term"]], np.int64), q["times"].to_numpy(float), known["term"].tolist(), idf))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, number, term, times, terms, idf = sent.value
        value_set, nt = pa.array(terms, pa.string()), len(terms)
        best = _Best(k, digits)
        parts = []
        for first in range(0, len(names), 1000):  # questions whose words make one dense matrix
            mine = (number >= first) & (number < first + 1000)
            used, column = np.unique(term[mine], return_inverse=True)
            dense = np.zeros((min(1000, len(names) - first), len(used)))
            dense[number[mine] - first, column] = times[mine]
            parts.append((first, used, dense))
        for batch in batches if nt else ():
            ids, words = batch.column(0).to_pandas().to_numpy(), batch.column(1)
            length = pc.list_value_length(words).to_numpy()
            found = pc.fill_null(pc.index_in(words.flatten(), value_set=value_set), -1).to_numpy()
            doc = np.repeat(np.arange(len(ids)), length)
            step = max(1, 4_000_000 // nt)
            ends = np.append(0, np.cumsum(length))
            for lo in range(0, len(ids), step):
                hi = min(lo + step, len(ids))
                f, d = found[ends[lo] : ends[hi]], doc[ends[lo] : ends[hi]] - lo
                tf = np.bincount(d[f >= 0] * nt + f[f >= 0], minlength=(hi - lo) * nt).reshape(hi - lo, nt).astype(float)
                weight = idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[lo:hi, None] / mean))
                for at, used, dense in parts:
                    got = dense @ weight[:, used].T
                    got[got <= 0.5 / best.scale] = -np.inf
                    best.add(got, at, ids[lo:hi])
        rows = best.rows(names)
        if rows is not None:
            yield pa.RecordBatch.from_pandas(rows, preserve_index=False)

    found = docs.mapInArrow(score, _types(docs, questions))
    return rank(found, "question_id", k, F.desc("score"), "node_id")


def vector_search(nodes: DataFrame, queries: DataFrame, k: int = TOP_K, digits: int = 6, exclude_self: bool = True) -> DataFrame:
    """(question_id, node_id, score, rank) by cosine [J5]. nodes: (node_id, embedding); queries: (question_id, embedding), the
    stated query set; it is compared with all nodes in blocks of ``QUERY_BLOCK``, each broadcast: a matrix product a batch of
    nodes, of which each task keeps its k best a question. Vectors without a length have no score."""
    return reduce(DataFrame.unionByName, [_search_block(nodes, q, k, digits, exclude_self) for q in _blocks(queries)])


def _search_block(nodes: DataFrame, queries: DataFrame, k: int, digits: int, exclude_self: bool) -> DataFrame:
    q = queries.select("question_id", "embedding").where("embedding is not null").toPandas()
    unit = lambda v: v / np.where((n := np.sqrt((v * v).sum(axis=1, keepdims=True))) > 0, n, np.nan)
    sent = nodes.sparkSession.sparkContext.broadcast((q["question_id"].to_numpy(), unit(np.stack(q["embedding"]).astype(float)) if len(q) else np.zeros((0, 0))))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, wanted = sent.value
        best = _Best(k, digits)
        for b in batches if len(names) else ():
            b = b[np.array([v is not None and len(v) == wanted.shape[1] for v in b["embedding"]], bool)]
            for lo in range(0, len(b), 2000):
                ids, v = b["node_id"].to_numpy()[lo : lo + 2000], unit(np.stack(b["embedding"].to_numpy()[lo : lo + 2000]).astype(float))
                for first in range(0, len(names), 1000):
                    got = wanted[first : first + 1000] @ v.T
                    if exclude_self:
                        got[names[first : first + 1000, None] == ids[None, :]] = np.nan
                    best.add(got, first, ids)
        rows = best.rows(names)
        if rows is not None:
            yield rows

    found = spread(nodes.select("node_id", "embedding")).mapInPandas(score, _types(nodes, queries))
    return rank(found, "question_id", k, F.desc("score"), "node_id")


def fuse(*rankings: DataFrame, k: int = TOP_K, constant: int = RRF_K, digits: int = 9) -> DataFrame:
    """Reciprocal rank fusion of rankings [D12, I2, J6]; ties by the first list's rank, the second's, then node id."""
    parts = [r.select("question_id", "node_id", (1 / (F.lit(float(constant)) + F.col("rank"))).alias("s"), F.lit(i).alias("i"), F.col("rank").alias("r")) for i, r in enumerate(rankings)]
    both = reduce(DataFrame.unionByName, parts)
    scores = both.groupBy("question_id", "node_id").agg(
        F.round(F.sum("s"), digits).alias("score"), *[F.coalesce(F.min(F.when(F.col("i") == i, F.col("r"))), F.lit(1 << 30)).alias(f"r{i}") for i in range(len(rankings))])
    return rank(scores, "question_id", k, F.desc("score"), *[f"r{i}" for i in range(len(rankings))], "node_id").select("question_id", "node_id", "score", "rank")


def ranking_quality(ranking: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """One row a question: rr, and hit, recall, precision and ndcg at each k [H2-H4]. relevant: (question_id, node_id), distinct;
    questions without any relevant node have zeros."""
    marked = relevant.withColumn("rel", F.lit(1)).join(ranking.select("question_id", "node_id", "rank"), ["question_id", "node_id"], "left")
    gain = F.lit(1.0) / (F.log2(F.col("rank") + 1.0))
    ideal = lambda k: F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    agg = marked.groupBy("question_id").agg(
        F.count("*").alias("n"), F.coalesce(1 / F.min("rank"), F.lit(0.0)).alias("rr"), *[F.count(F.when(F.col("rank") <= k, 1)).alias(f"c{k}") for k in ks],
        *[F.coalesce(F.sum(F.when(F.col("rank") <= k, gain)), F.lit(0.0)).alias(f"g{k}") for k in ks])
    cols = [F.col("question_id"), F.round("rr", 6).alias("rr")]
    for k in ks:
        cols += [(F.col(f"c{k}") > 0).cast("int").alias(f"hit_{k}"), F.round(F.col(f"c{k}") / F.col("n"), 6).alias(f"recall_{k}"),
                 F.round(F.col(f"c{k}") / F.lit(float(k)), 6).alias(f"precision_{k}"), F.round(F.col(f"g{k}") / ideal(k), 6).alias(f"ndcg_{k}")]
    return agg.select(*cols)


# --- stand-ins on the tables --------------------------------------------------------------------------------------------------

def corpus(spark: SparkSession, d: str) -> DataFrame:
    return scan(spark, d, "documents").select(F.col("doc_id").alias("node_id"), "text", "lang", "source")


def questions(spark: SparkSession, d: str) -> DataFrame:
    return scan(spark, d, "eval_questions").select("question_id", "question").where("question is not null").distinct()


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return scan(spark, d, "embeddings").select(F.col("vec_id").alias("node_id"), "embedding", "label")


_TOKENS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"


def _bm25_sql(where: str, k: int, name: str = "lex", source: str = "SELECT doc_id AS node_id, text FROM documents") -> str:
    return f"""{name}_docs AS (SELECT node_id, {_TOKENS.format('text')} AS w FROM ({source}) WHERE length(text) > 0 {where}),
    {name}_d AS (SELECT * FROM {name}_docs WHERE len(w) > 0), {name}_st AS (SELECT count(*) AS n_docs, avg(len(w)) AS avg_len FROM {name}_d),
    {name}_q AS (SELECT question_id, term, count(*) AS times FROM (SELECT question_id, unnest({_TOKENS.format('question')}) AS term FROM (SELECT DISTINCT question_id, question FROM eval_questions WHERE question IS NOT NULL)) GROUP BY ALL),
    {name}_p AS (SELECT node_id, term, len, count(*) AS tf FROM (SELECT node_id, len(w) AS len, unnest(w) AS term FROM {name}_d) WHERE term IN (SELECT term FROM {name}_q) GROUP BY ALL),
    {name}_df AS (SELECT term, count(*) AS df FROM {name}_p GROUP BY term),
    {name}_s AS (SELECT question_id, node_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len)) * times), 6) AS score
        FROM {name}_p JOIN {name}_df USING (term) JOIN {name}_q USING (term), {name}_st GROUP BY question_id, node_id),
    {name} AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, node_id) AS rank FROM {name}_s WHERE score > 0 QUALIFY rank <= {k})"""


@R.add(f"SELECT lang, count(*) AS n, sum(n_chars) AS chars FROM documents GROUP BY lang")
def documents_by_lang(spark, d):
    """The first query of the engine: documents and characters by label."""
    return scan(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@R.add(f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest({_TOKENS.format('text')}) AS term FROM documents) GROUP BY term")
def term_document_frequency(spark, d):
    """Document and collection frequency of every word."""
    w = corpus(spark, d).select("node_id", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("node_id", "term").agg(F.count("*").alias("tf"))
    return w.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@R.add(f"WITH {_bm25_sql('', TOP_K)} SELECT question_id, node_id, score, rank FROM lex")
def bm25_topk(spark, d):
    """The documents that answer each question best, by words."""
    return bm25(corpus(spark, d), questions(spark, d))


_FILTER = "AND lang = 'es' AND contains(coalesce(source, ''), '1')"


@R.add(f"WITH {_bm25_sql(_FILTER, TOP_K, source='SELECT doc_id AS node_id, text, lang, source FROM documents')} SELECT question_id, node_id, score, rank FROM lex")
def bm25_filtered_topk(spark, d):
    """Statistics and scores over the filtered corpus only."""
    return bm25(corpus(spark, d).where(all_of(equals("lang", "es"), contains("source", "1"))), questions(spark, d))


def _vector_sql(k: int, name: str = "vec") -> str:
    return f"""{name}_s AS (SELECT q.vec_id AS question_id, n.vec_id AS node_id, n.label, q.label AS q_label,
        round(list_dot_product(n.embedding::DOUBLE[], q.embedding::DOUBLE[]) / nullif(sqrt(list_dot_product(n.embedding::DOUBLE[], n.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])), 0), 6) AS score
        FROM embeddings n, embeddings q WHERE q.vec_id % 100 = 0 AND n.vec_id <> q.vec_id),
    {name} AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, node_id) AS rank FROM {name}_s WHERE score IS NOT NULL QUALIFY rank <= {k})"""


def _vector_queries(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).where("node_id % 100 = 0").select(F.col("node_id").alias("question_id"), "embedding")


@R.add(f"WITH {_vector_sql(TOP_K)} SELECT question_id, node_id, score, rank FROM vec")
def vector_topk(spark, d):
    """Nearest vectors of the query set (every id divisible by 100) among all others."""
    return vector_search(_vectors(spark, d), _vector_queries(spark, d))


@R.add(f"WITH {_vector_sql(TOP_K)} SELECT question_id, node_id, score, rank FROM vec WHERE score >= 0.45")
def vector_topk_cutoff(spark, d):
    """The similarity cut-off comes after the top k."""
    return vector_topk(spark, d).where(F.col("score") >= CUTOFF)


_HYBRID = f"""{_bm25_sql('', POOL)}, qv AS (SELECT DISTINCT question_id, question_id % (SELECT count(*) FROM embeddings) AS vec_id FROM eval_questions WHERE question IS NOT NULL),
    vs AS (SELECT question_id, 1001 + 3 * n.vec_id AS node_id, round(list_dot_product(n.embedding::DOUBLE[], q.embedding::DOUBLE[]) / nullif(sqrt(list_dot_product(n.embedding::DOUBLE[], n.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])), 0), 6) AS score
        FROM embeddings n, qv JOIN embeddings q ON q.vec_id = qv.vec_id),
    vec AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, node_id) AS rank FROM vs WHERE score IS NOT NULL QUALIFY rank <= {TOP_K}),
    f AS (SELECT question_id, node_id, round(sum(1.0::DOUBLE / (60.0::DOUBLE + rank)), 9) AS score, coalesce(min(rank) FILTER (i = 0), 1073741824) AS r0, coalesce(min(rank) FILTER (i = 1), 1073741824) AS r1
        FROM (SELECT question_id, node_id, rank, 0 AS i FROM vec UNION ALL SELECT question_id, node_id, rank, 1 FROM lex) GROUP BY ALL),
    hyb AS (SELECT question_id, node_id, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, r0, r1, node_id) AS rank FROM f QUALIFY rank <= {TOP_K})"""


def _question_vectors(spark: SparkSession, d: str) -> DataFrame:
    """A stand-in for embedded questions: question q has the vector number q modulo their count."""
    vectors = _vectors(spark, d)
    n = vectors.count()
    return questions(spark, d).select("question_id").distinct().withColumn("node_id", F.col("question_id") % n).join(vectors, "node_id").select("question_id", "embedding")


def hybrid(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vector, lexical, fused) rankings of all questions."""
    nodes = _vectors(spark, d).withColumn("node_id", 1001 + 3 * F.col("node_id"))
    vec = vector_search(nodes, _question_vectors(spark, d), exclude_self=False)
    lex = bm25(corpus(spark, d), questions(spark, d), k=POOL)
    return vec, lex, fuse(vec, lex)


@R.add(f"WITH {_HYBRID} SELECT question_id, node_id, score, rank FROM hyb")
def rrf_hybrid_topk(spark, d):
    """Vector and lexical rankings fused."""
    return hybrid(spark, d)[2]


_PER_MODE = "bm25 vector hybrid".split()
_QUALITY = ", ".join(["question_id", "coalesce(round(1.0 / min(rank), 6), 0) AS rr"] + [
    f"CAST(count(*) FILTER (rank <= {k}) > 0 AS INTEGER) AS hit_{k}, round(count(*) FILTER (rank <= {k}) / count(*), 6) AS recall_{k}, "
    f"round(count(*) FILTER (rank <= {k}) / {k}.0::DOUBLE, 6) AS precision_{k}, "
    f"round(coalesce(sum(1 / log2(rank + 1)) FILTER (rank <= {k}), 0) / list_sum(list_transform(range(1, CAST(least(count(*), {k}) AS BIGINT) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg_{k}" for k in (1, 3, 5, 10)])


@R.add(f"""WITH {_vector_sql(10)}, rel AS (SELECT q.vec_id AS question_id, n.vec_id AS node_id FROM embeddings q, embeddings n WHERE q.vec_id % 100 = 0 AND n.vec_id <> q.vec_id AND n.label = q.label),
    m AS (SELECT rel.question_id, rel.node_id, vec.rank FROM rel LEFT JOIN vec ON rel.question_id = vec.question_id AND rel.node_id = vec.node_id)
    SELECT {_QUALITY} FROM m GROUP BY question_id""")
def vector_ranking_quality(spark, d):
    """H2-H4: reciprocal rank, hit, recall, precision and nDCG, where a vector of the same label is relevant."""
    v = _vectors(spark, d)
    q = v.where("node_id % 100 = 0").select(F.col("node_id").alias("question_id"), F.col("label").alias("q_label"))
    relevant = v.join(bounded(q), (F.col("label") == F.col("q_label")) & (F.col("node_id") != F.col("question_id"))).select("question_id", "node_id")
    return ranking_quality(vector_search(v, _vector_queries(spark, d), k=10), relevant)


_EXPECTED = "SELECT DISTINCT question_id, r AS node_id FROM (SELECT question_id, unnest(expected_record_ids) AS r FROM eval_questions) WHERE r <> ''"


def _record_ablation(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    records = latest_records(spark, d).select(F.col("record_id").alias("node_id"), F.col("retrieval_text").alias("text"), "unit_type")
    asked = questions(spark, d)
    return {"all": bm25(records, asked, k=10), "pages": bm25(records.where("unit_type = 'page'"), asked, k=10), "regions": bm25(records.where("unit_type = 'region'"), asked, k=10)}


@R.add(f"""WITH {LATEST}, {_bm25_sql('', 10, 'a', 'SELECT record_id AS node_id, retrieval_text AS text FROM latest')},
    {_bm25_sql('', 10, 'p', "SELECT record_id AS node_id, retrieval_text AS text FROM latest WHERE unit_type = 'page'")},
    {_bm25_sql('', 10, 'r', "SELECT record_id AS node_id, retrieval_text AS text FROM latest WHERE unit_type = 'region'")}, rel AS ({_EXPECTED}),
    m AS (SELECT 'all' AS mode, rel.*, rank FROM rel LEFT JOIN a USING (question_id, node_id) UNION ALL SELECT 'pages', rel.*, rank FROM rel LEFT JOIN p USING (question_id, node_id)
          UNION ALL SELECT 'regions', rel.*, rank FROM rel LEFT JOIN r USING (question_id, node_id)),
    q AS (SELECT mode, {_QUALITY} FROM m GROUP BY mode, question_id)
    SELECT mode, count(*) AS n_questions, round(avg(rr), 5) AS mrr, {", ".join(f"round(avg(hit_{k}), 5) AS hit_{k}, round(avg(recall_{k}), 5) AS recall_{k}, round(avg(ndcg_{k}), 5) AS ndcg_{k}" for k in (1, 3, 5, 10))} FROM q GROUP BY mode""")
def unit_type_ablation(spark, d):
    """Mean quality of retrieval over all records, pages and regions, against the questions' expected records."""
    relevant = scan(spark, d, "eval_questions").select("question_id", F.explode("expected_record_ids").alias("node_id")).where("node_id <> ''").distinct()
    parts = [ranking_quality(r, relevant).withColumn("mode", F.lit(m)) for m, r in _record_ablation(spark, d).items()]
    return reduce(DataFrame.unionByName, parts).groupBy("mode").agg(
        F.count("*").alias("n_questions"), F.round(F.avg("rr"), 5).alias("mrr"),
        *[F.round(F.avg(f"{m}_{k}"), 5).alias(f"{m}_{k}") for k in (1, 3, 5, 10) for m in ("hit", "recall", "ndcg")])


@R.add(f"""WITH {LATEST}, f AS (SELECT record_id, document_id, page_id, title, row_number() OVER (ORDER BY record_id) AS rank FROM latest
    WHERE unit_type = 'region' AND forensic_flags.verification_status = 'verified' AND contains(coalesce(array_to_string(language, ','), ''), 'ca'))
    SELECT record_id, document_id, page_id, title, rank, 1.0::DOUBLE AS score FROM f WHERE rank <= 20""")
def metadata_lookup(spark, d):
    """The first records that pass metadata filters, score 1."""
    df = latest_records(spark, d).withColumn("languages", F.concat_ws(",", "language")).withColumn("status", F.col("forensic_flags.verification_status"))
    kept = df.where(all_of(equals("unit_type", "region"), equals("status", "verified"), contains("languages", "ca"))).orderBy("record_id").limit(20)
    return kept.select("record_id", "document_id", "page_id", "title", F.row_number().over(W.orderBy("record_id")).cast("long").alias("rank"), F.lit(1.0).alias("score"))


def provenance_line() -> Column:
    """One line of evidence [C24]; missing values read None."""
    none = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    return F.format_string("[%d] score=%.4f record_id=%s document_id=%s page_id=%s verification_status=%s", F.col("rank"), F.col("score"), none("record_id"), none("document_id"),
                           none("page_id"), none("verification_status"))


_HITS = f"""hits AS (SELECT q.question_id, q.rank, q.score, l.record_id, l.document_id, l.page_id, l.forensic_flags.verification_status AS verification_status,
    l.forensic_flags.human_review_required AS review, l.forensic_flags.confidence_score AS flags_score, coalesce(array_to_string(list_filter(l.forensic_flags.alerts, lambda x: x IS NOT NULL), ','), '') AS alerts,
    l.provenance.source_image_path AS path FROM r q JOIN latest l ON l.record_id = q.node_id WHERE q.rank <= 5)"""
_LINES = """'[' || rank || '] score=' || printf('%.4f', score) || ' record_id=' || coalesce(record_id, 'None') || ' document_id=' || coalesce(document_id, 'None') || ' page_id=' || coalesce(page_id, 'None') ||
    ' verification_status=' || coalesce(verification_status, 'None')"""


def _hits(spark: SparkSession, d: str) -> DataFrame:
    records = latest_records(spark, d)
    found = bm25(records.where("unit_type = 'region'").select(F.col("record_id").alias("node_id"), F.col("retrieval_text").alias("text")), questions(spark, d), k=5, digits=3)
    meta = records.select("record_id", "document_id", "page_id", F.col("forensic_flags.verification_status").alias("verification_status"), F.col("forensic_flags.human_review_required").alias("review"),
                          F.col("forensic_flags.confidence_score").alias("flags_score"), F.concat_ws(",", "forensic_flags.alerts").alias("alerts"), F.col("provenance.source_image_path").alias("path"))
    return found.join(meta, found["node_id"] == meta["record_id"])


_REGION_BM25 = _bm25_sql('', 5, 'r', "SELECT record_id AS node_id, retrieval_text AS text FROM latest WHERE unit_type = 'region'").replace("times), 6) AS score", "times), 3) AS score")


@R.add(f"WITH {LATEST}, {_REGION_BM25}, {_HITS} SELECT question_id, rank, {_LINES} AS line FROM hits")
def provenance_lines(spark, d):
    """The evidence of each question's first five records."""
    return _hits(spark, d).select("question_id", "rank", provenance_line().alias("line"))


def metadata_line() -> Column:
    """One record of a metadata lookup [C25]; missing values read None."""
    none = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    return F.format_string("- record_id=%s, document_id=%s, page_id=%s, verification_status=%s, human_review_required=%s", none("record_id"), none("document_id"), none("page_id"), none("verification_status"), none("review"))


def envelopes(found: DataFrame, asked: DataFrame, mode: str) -> DataFrame:
    """The answer to each question with all that stands behind it [J12, J15, C23, C25]: answer, confidence, needs_human_review,
    applied_filters, evidence_summary (nine fields of the first five sources), uncertainties, insufficient_evidence.

    found: question_id, rank, score, record_id, document_id, page_id, verification_status, review, flags_score, alerts, path; asked:
    question_id, question, applied_filters; mode: provenance_lookup or metadata_lookup."""
    by_metadata = mode == "metadata_lookup"
    none = lambda c: F.col(c).cast("string")
    source = F.struct("score", "record_id", "document_id", "page_id", "verification_status", none("review").alias("human_review_required"), F.col("flags_score").alias("forensic_confidence_score"), "alerts", F.col("path").alias("source_image_path"))
    in_order = F.array_sort(F.collect_list(F.struct("rank", (metadata_line() if by_metadata else provenance_line()).alias("line"), source.alias("source"))))
    per = found.groupBy("question_id").agg(in_order.alias("l"), F.bool_or(F.coalesce("review", F.lit(False))).alias("review"))
    rows = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    if by_metadata:
        answer = F.concat(F.lit("Found "), F.size("l").cast("string"), F.lit(" matching records for: "), "question", F.lit("\n"), rows)
        nothing, why = F.concat(F.lit("No records matched the requested metadata constraints for: "), "question"), "No records matched the metadata filters."
    else:
        answer, nothing, why = F.concat(F.lit("Provenance summary:\n"), rows), F.lit("No provenance-bearing results were retrieved"), "No provenance-bearing results were retrieved."
    some = F.col("l").isNotNull()
    return asked.join(per, "question_id", "left").select(
        "question_id", F.when(some, answer).otherwise(nothing).alias("answer"), F.when(some, "high").otherwise("low").alias("confidence"), F.coalesce("review", F.lit(False)).alias("needs_human_review"), "applied_filters",
        F.when(some, F.transform(F.slice("l", 1, 5), lambda x: x["source"])).alias("evidence_summary"), F.when(some, F.array().cast("array<string>")).otherwise(F.array(F.lit(why))).alias("uncertainties"), (~some).alias("insufficient_evidence"))


def envelope_json(df: DataFrame) -> DataFrame:
    """(question_id, envelope): envelopes as JSON, nulls kept."""
    return df.select("question_id", F.to_json(F.struct(*[c for c in df.columns if c != "question_id"]), {"ignoreNullFields": "false"}).alias("envelope"))


_SOURCES = """string_agg(concat_ws('|', printf('%.4f', score), record_id, document_id, page_id, coalesce(verification_status, '-'), coalesce(CAST(review AS VARCHAR), '-'), coalesce(printf('%.4f', flags_score), '-'), alerts, coalesce(path, '-')), '; ' ORDER BY rank)"""


@R.add(f"""WITH {LATEST}, {_REGION_BM25}, {_HITS}, a AS (SELECT question_id, 'Provenance summary:' || chr(10) || string_agg({_LINES}, chr(10) ORDER BY rank) AS answer, bool_or(coalesce(review, false)) AS needs_human_review, {_SOURCES} AS evidence FROM hits GROUP BY question_id)
    SELECT q.question_id, coalesce(answer, 'No provenance-bearing results were retrieved') AS answer, CASE WHEN evidence IS NOT NULL THEN 'high' ELSE 'low' END AS confidence,
    coalesce(needs_human_review, false) AS needs_human_review, 'unit_type=region' AS applied_filters, coalesce(evidence, '') AS evidence, CASE WHEN evidence IS NULL THEN 'No provenance-bearing results were retrieved.' ELSE '' END AS uncertainties,
    evidence IS NULL AS insufficient_evidence FROM (SELECT DISTINCT question_id FROM eval_questions WHERE question IS NOT NULL) q LEFT JOIN a USING (question_id)""")
def answers(spark, d):
    """Answer envelopes of a provenance lookup over regions."""
    asked = questions(spark, d).groupBy("question_id").agg(F.min("question").alias("question")).withColumn("applied_filters", F.lit("unit_type=region"))
    e = envelopes(_hits(spark, d), asked, "provenance_lookup")
    dash = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    line = lambda x: F.concat_ws("|", F.format_string("%.4f", x["score"]), x["record_id"], x["document_id"], x["page_id"], dash(x["verification_status"]), dash(x["human_review_required"]),
                                 F.when(x["forensic_confidence_score"].isNotNull(), F.format_string("%.4f", x["forensic_confidence_score"])).otherwise("-"), x["alerts"], dash(x["source_image_path"]))
    return e.withColumn("evidence", F.coalesce(F.array_join(F.transform("evidence_summary", line), "; "), F.lit(""))).withColumn("uncertainties", F.array_join("uncertainties", "; ")).drop("evidence_summary")


_LOOKED_UP = """f AS (SELECT record_id, document_id, page_id, forensic_flags.verification_status AS verification_status, forensic_flags.human_review_required AS review, row_number() OVER (ORDER BY record_id) AS rank FROM latest
    WHERE unit_type = 'region' AND forensic_flags.verification_status = 'uncertain')"""


@R.add(f"""WITH {LATEST}, {_LOOKED_UP}, t AS (SELECT * FROM f WHERE rank <= 8), a AS (SELECT 'Found ' || count(*) || ' matching records for: uncertain regions' || chr(10) || string_agg('- record_id=' || record_id || ', document_id=' || document_id || ', page_id=' || page_id ||
    ', verification_status=' || verification_status || ', human_review_required=' || coalesce(CAST(review AS VARCHAR), 'None'), chr(10) ORDER BY rank) AS answer, count(*) AS n FROM t)
    SELECT 1 AS question_id, answer, 'high' AS confidence, least(n, 5) AS n_sources FROM a UNION ALL SELECT 2, 'No records matched the requested metadata constraints for: nothing', 'low', 0""")
def lookup_answers(spark, d):
    """Answer envelopes of metadata lookups, one with records and one without."""
    f = latest_records(spark, d).where((F.col("unit_type") == "region") & (F.col("forensic_flags.verification_status") == "uncertain")).orderBy("record_id").limit(TOP_K)
    f = f.select(F.lit(1).alias("question_id"), F.row_number().over(W.orderBy("record_id")).alias("rank"), F.lit(1.0).alias("score"), "record_id", "document_id", "page_id", F.col("forensic_flags.verification_status").alias("verification_status"),
                 F.col("forensic_flags.human_review_required").alias("review"), F.col("forensic_flags.confidence_score").alias("flags_score"), F.concat_ws(",", "forensic_flags.alerts").alias("alerts"), F.col("provenance.source_image_path").alias("path"))
    asked = spark.createDataFrame([(1, "uncertain regions", "verification_status=uncertain"), (2, "nothing", "")], "question_id int, question string, applied_filters string")
    return envelopes(f, asked, "metadata_lookup").select("question_id", "answer", "confidence", F.coalesce(F.size("evidence_summary"), F.lit(0)).cast("long").alias("n_sources"))


QUERIES, SQL = R.queries, R.sql
