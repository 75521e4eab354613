"""Which way a question is answered, by rules on its words, for a whole table of questions at once."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.operators.retrieval import questions
from foliant.plans.registry import Registry

R = Registry()
# Words that decide the route.
EXACT = ["exact", "literal", "verbatim", "wording", "phrase", "contains", "mention", "keyword", "transcription", "ocr", "spelling"]
PROVENANCE = ["provenance", "evidence trail", "sources", "record_id", "document_id", "page_id", "which records support"]
METADATA = ["filter", "verified", "uncertain", "human review", "review required", "page", "region", "document_id", "page_id"]
LISTING = ["show", "list", "find", "give", "which", "records", "pages"]
UNCERTAIN = ["uncertain", "doubtful", "unverified"]
REVIEW = ["human review", "review required"]
CONTENT_WORDS = ["about", "mention(s|ed|ing)?", "contains?", "containing", "with", "related to", "topic", "topics", "keyword", "keywords", "ocr", "transcription", "guerra", "frente", "bolet[ií]n",
                 "censorship", "intervenci[oó]n", "rep[úu]blica", "barrio", "f[úu]tbol", "m[úu]sica"]
CONTENT = r"\b(" + "|".join(CONTENT_WORDS) + r")\b"
ALLOWED = {"verification_status": {"verified", "uncertain"}, "human_review_required": {"true", "false"}, "unit_type": {"page", "region"}, "source_type": None, "language": None,
           "document_id": None, "page_id": None}


def _any(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def route(question: Column) -> Column:
    """hybrid, provenance_lookup or vector [J10]; substrings decide, so ``unverified`` is also ``verified``."""
    t = F.lower(question)
    content, metadata, listing = t.rlike("(?U)" + CONTENT), _any(t, METADATA), _any(t, LISTING)
    return F.when(_any(t, EXACT), "hybrid").when(_any(t, PROVENANCE), "provenance_lookup").when(metadata & listing & ~content, "vector") \
        .when(metadata & content, "hybrid").otherwise("vector")


def inferred_filters(question: Column) -> Column:
    """``field=value`` of each filter the rules add [J10]; a region beats a page."""
    t = F.lower(question)
    return F.array_compact(F.array(
        F.when(F.contains(t, F.lit("verified")), "verification_status=verified"), F.when(_any(t, UNCERTAIN), "verification_status=uncertain"),
        F.when(_any(t, REVIEW), "human_review_required=true"), F.when(F.contains(t, F.lit("region")), "unit_type=region").when(F.contains(t, F.lit("page")), "unit_type=page")))


def confidence(mode: Column, filters: Column) -> Column:
    return F.when((mode != "vector") | (F.size(filters) > 0), 1.0)


@dataclass
class QueryPlan:
    """How one question is answered [J7, J12]; built on the driver."""

    mode: str
    filters: list[tuple[str, str, str]] = field(default_factory=list)
    rationale: str = ""
    confidence: float | None = None


def validate_filters(entries: list[dict]) -> list[tuple[str, str, str]]:
    """(field, operator, value) of what a planner may ask for; the rest is dropped silently [C12]. Booleans become text."""
    kept = []
    for e in entries:
        name, value = e.get("field"), e.get("value")
        if isinstance(value, bool):
            value = str(value).lower()
        operator = "contains" if name == "language" else "eq"
        if name in ALLOWED and isinstance(value, str) and e.get("operator", operator) == operator and (ALLOWED[name] is None or value in ALLOWED[name]):
            kept.append((name, operator, value))
    return kept


def filters_key(filters: list[tuple[str, str, str]]) -> str:
    """A canonical text of a set of filters, whatever their order [F21]."""
    return json.dumps(sorted(filters), ensure_ascii=False)


def plan_gate(plan_json: Column, threshold: float = 0.7) -> Column:
    """The mode a planner's JSON asks for if it is sure enough, else vector [J11]."""
    mode, sure = F.get_json_object(plan_json, "$.retrieval_mode"), F.get_json_object(plan_json, "$.confidence").try_cast("double")
    return F.when((sure >= threshold) & mode.isin("vector", "bm25", "hybrid", "provenance_lookup"), mode).otherwise("vector")


# Questions in the router's own words, beside those of the table.
_PROBES = ["Show unverified pages", "Which records support the claim?", "exact wording of the bulletin", "list verified regions about música", "human review pages", "page_id of the song",
           "find uncertain records", "regions and pages with guerra", "¿Dónde está el boletín?", "VERIFIED pages mention fútbol", "give evidence trail", "nothing special"]


def _has(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(t, '{w}')" for w in words) + ")"


_SQL_CONTENT = "regexp_matches(t, '(^|[^\\p{L}\\p{N}_])" + CONTENT.replace(r"\b", "") + "([^\\p{L}\\p{N}_]|$)')"
_PROBE_ROWS = ", ".join(f"({-i - 1}, '{q}')" for i, q in enumerate(_PROBES))
_ROUTED = f"""q AS (SELECT question_id, question, lower(question) AS t FROM (SELECT DISTINCT question_id, question FROM eval_questions WHERE question IS NOT NULL UNION ALL SELECT * FROM (VALUES {_PROBE_ROWS}))),
    r AS (SELECT question_id, CASE WHEN {_has(EXACT)} THEN 'hybrid' WHEN {_has(PROVENANCE)} THEN 'provenance_lookup' WHEN {_has(METADATA)} AND {_has(LISTING)} AND NOT {_SQL_CONTENT} THEN 'vector'
            WHEN {_has(METADATA)} AND {_SQL_CONTENT} THEN 'hybrid' ELSE 'vector' END AS mode,
        concat_ws(',', CASE WHEN contains(t, 'verified') THEN 'verification_status=verified' END, CASE WHEN {_has(UNCERTAIN)} THEN 'verification_status=uncertain' END,
            CASE WHEN {_has(REVIEW)} THEN 'human_review_required=true' END, CASE WHEN contains(t, 'region') THEN 'unit_type=region' WHEN contains(t, 'page') THEN 'unit_type=page' END) AS filters FROM q)"""


@R.add(f"WITH {_ROUTED} SELECT question_id, mode, filters, CASE WHEN mode <> 'vector' OR filters <> '' THEN 1.0::DOUBLE END AS confidence FROM r")
def router_modes(spark, d):
    """Route, filters and confidence of every question."""
    probes = spark.createDataFrame([(-i - 1, q) for i, q in enumerate(_PROBES)], "question_id long, question string")
    df = questions(spark, d).unionByName(probes).select("question_id", route(F.col("question")).alias("mode"), inferred_filters(F.col("question")).alias("f"))
    return df.select("question_id", "mode", F.concat_ws(",", "f").alias("filters"), confidence(F.col("mode"), F.col("f")).alias("confidence"))


@R.add(f"WITH {_ROUTED} SELECT mode, count(*) AS n_questions FROM r GROUP BY mode")
def route_distribution(spark, d):
    """Questions of each route."""
    return router_modes(spark, d).groupBy("mode").agg(F.count("*").alias("n_questions"))


QUERIES, SQL = R.queries, R.sql
