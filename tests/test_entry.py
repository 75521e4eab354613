import os
import subprocess
import sys

import duckdb
import pytest

from conftest import ROOT, SF


def test_imports_without_a_session_and_names_match():
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 60 and not set(s) - set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_core_stands_without_the_text_operators(tmp_path):
    code = "import sys; sys.modules['foliant.llm'] = None; import __spark_entry__ as e; assert 'bm25_topk' in e.queries() and 'p5_found' in e.queries() and 'p1_found' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_nothing_in_the_core_imports_the_text_operators():
    for folder, _, files in os.walk(os.path.join(ROOT, "foliant")):
        if os.path.basename(folder) != "llm":
            assert not [f for f in files if f.endswith(".py") and "foliant.llm" in open(os.path.join(folder, f)).read()]


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["question_id", "node_id", "score", "rank"] and df.count() > 0


def norm(v):
    if isinstance(v, float):
        return repr(round(v, 5) + 0.0)
    if isinstance(v, (list, tuple)):
        return [norm(x) for x in v]
    return str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


CHECKED = ["bm25_topk", "bm25_filtered_topk", "vector_topk", "rrf_hybrid_topk", "router_modes", "answers", "record_metadata", "retrieval_texts", "document_identifiers", "marc_extract", "record_validation",
           "page_details", "page_records", "overlap_alerts", "overlap_counts_outer", "column_reading_order", "tile_clip", "index_summary", "document_breakdown", "confidence_histogram", "harvest_report",
           "confusion_prf", "label_scores", "reliability_bins", "precision_recall_curve", "average_precision_by_type", "temperature_fit", "hash_split", "proportional_sample_slots", "class_preserving_prune",
           "nearest_neighbours", "token_words", "p5_found", "p5_report", "retrieval_ablation", "route_hit_rates", "lookup_answers", "forensic_scores", "synthetic_texts", "asset_ranking", "polygon_scanlines",
           "temperature_calibration", "title_questions", "round_robin_pick", "corpus_round_trip", "index_round_trip", "record_files", "upsert_round_trip", "planned_modes", "built_filters", "moved_polygons", "epoch_sample"]


@pytest.mark.parametrize("name", CHECKED)
def test_against_sql(spark, duck, name):
    import __spark_entry__

    df = __spark_entry__.queries()[name](spark, SF)
    cols = sorted(df.columns)
    ours = sorted([norm(r[c]) for c in cols] for r in df.collect())
    cur = duck.execute(__spark_entry__.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    theirs = sorted([norm(r[names.index(c)]) for c in cols] for r in cur.fetchall())
    assert sorted(names) == cols and ours == theirs
