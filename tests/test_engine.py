import pytest
from pyspark.sql import functions as F

from conftest import SF
from foliant.operators import archive, engine, retrieval


@pytest.fixture(scope="module")
def nodes(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "nodes")
    records = archive.latest_records(spark, SF)
    vectors = records.select(F.col("record_id").alias("node_id"), F.array(*[F.pmod(F.xxhash64("record_id", F.lit(i)), F.lit(7)).cast("float") for i in range(4)]).alias("embedding"))
    engine.build(records, vectors, path)
    return spark.read.parquet(path)


def asked(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "question_id long, question string")


def test_index_holds_every_record_once(spark, nodes):
    assert nodes.count() == nodes.select("node_id").distinct().count() == archive.latest_records(spark, SF).count()
    assert {"text", "language", "verification_status", "unit_type", "human_review_required"} <= set(nodes.columns)


@pytest.mark.parametrize("mode", ["bm25", "vector", "hybrid", "provenance_lookup"])
def test_modes(spark, nodes, mode):
    q = asked(spark, "romance antiguo", "boletín de la noche")
    v = spark.createDataFrame([(0, [1.0, 2.0, 3.0, 4.0]), (1, [4.0, 0.0, 1.0, 1.0])], "question_id long, embedding array<float>")
    got = engine.retrieve(nodes, q, mode, engine.filter_columns(unit_type="region", language="es"), v).collect()
    assert got and all(1 <= r.rank <= 8 for r in got)
    kinds = {r.node_id: (r.unit_type, r.language) for r in nodes.select("node_id", "unit_type", "language").collect()}
    assert all(kinds[r.node_id][0] == "region" and "es" in kinds[r.node_id][1] for r in got)


def test_contradictory_filters_are_empty(spark, nodes):
    assert engine.plan("show unverified records").filters == [("verification_status", "eq", "verified"), ("verification_status", "eq", "uncertain")]
    assert engine.query(nodes, "show unverified records about romance").count() == 0


def test_query_and_evaluation(spark, nodes):
    got = engine.query(nodes, "regions that mention romance antiguo").collect()
    assert [r.rank for r in got] == list(range(1, len(got) + 1)) and all("romance" in r.text.lower() or "antiguo" in r.text.lower() for r in got)
    ranking = retrieval.bm25(nodes, asked(spark, "romance antiguo"))
    first = ranking.where("rank = 1").select("question_id", "node_id")
    row = engine.evaluate({"bm25": ranking}, first).first()
    assert row.mode == "bm25" and row.mrr == 1 and row.recall_1 == 1


def test_answers_are_envelopes(spark, nodes, tmp_path):
    e = engine.answer(nodes, "which records support the boletín, uncertain regions").first()
    assert e.answer.startswith("Provenance summary:\n[1] score=") and e.confidence == "high" and e.uncertainties == [] and not e.insufficient_evidence
    assert e.applied_filters == "verification_status=uncertain,unit_type=region" and 1 <= len(e.evidence_summary) <= 5 and len(e.evidence_summary[0]) == 9
    assert {x.verification_status for x in e.evidence_summary} == {"uncertain"}
    m = engine.answer(nodes, "show uncertain regions", mode="metadata_lookup").first()
    assert m.answer.startswith("Found 8 matching records for: show uncertain regions\n- record_id=") and m.evidence_summary[0].score == 1.0
    none = engine.answer(nodes.limit(0), "nothing").first()
    assert none.confidence == "low" and none.evidence_summary is None and none.uncertainties == ["No provenance-bearing results were retrieved."] and none.insufficient_evidence
    assert '"evidence_summary":null' in retrieval.envelope_json(engine.answer(nodes.limit(0), "nothing")).first().envelope
    filters = [("unit_type", "eq", "region"), ("language", "contains", "es")]
    kept = engine.node_set(nodes, filters, str(tmp_path / "sets"))
    assert kept.count() == engine.node_set(nodes.limit(0), filters[::-1], str(tmp_path / "sets")).count() > 0
