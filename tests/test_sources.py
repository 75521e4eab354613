import json

import pytest
from pyspark.sql import functions as F

from foliant.sources import readers, sinks
from foliant.sources.schema import RECORD
from foliant.streaming import refresh

ROWS = [{"record_id": "d__p__page", "document_id": "d", "page_id": "p", "unit_type": "page", "language": ["es"], "bbox": []},
        {"record_id": "d__p__pr_0000", "document_id": "d", "page_id": "p", "region_id": "pr_0000", "unit_type": "region", "bbox": [1, 2, 3, 4], "ocr": {"full_text": "hola", "confidence_score": 0.5}}]


def test_corpus(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, ROWS)) + "\n\n")
    (tmp_path / "a.json").write_text(json.dumps(ROWS, indent=1))
    (tmp_path / "b.json").write_text('{"record_id": "x"}')
    (tmp_path / "bad.jsonl").write_text(json.dumps(ROWS[0]) + "\nnot json\n")
    for name in ("a.jsonl", "a.json"):
        got = readers.read_corpus(spark, str(tmp_path / name)).orderBy("record_id").collect()
        assert [r.record_id for r in got] == ["d__p__page", "d__p__pr_0000"] and got[1].ocr.full_text == "hola" and got[1].bbox == [1, 2, 3, 4]
    with pytest.raises(ValueError):
        readers.read_corpus(spark, str(tmp_path / "b.json"))
    with pytest.raises(FileNotFoundError):
        readers.read_corpus(spark, str(tmp_path / "none.json"))
    (tmp_path / "c.txt").write_text("x")
    with pytest.raises(ValueError):
        readers.read_corpus(spark, str(tmp_path / "c.txt"))
    with pytest.raises(Exception):
        readers.read_corpus(spark, str(tmp_path / "bad.jsonl")).collect()


def test_record_folder_and_writers(spark, tmp_path):
    (tmp_path / "in" / "d").mkdir(parents=True)
    for r, n in zip(ROWS, ("p.page.json", "p.pr_0000.json")):
        (tmp_path / "in" / "d" / n).write_text(json.dumps(r))
    df = readers.read_record_folder(spark, str(tmp_path / "in"))
    named = sinks.record_file_names(df.drop("file_name"))
    assert {r.file_name for r in df.collect()} == {r.file_name for r in named.collect()} == {"p.page.json", "p.pr_0000.json"}
    assert sinks.write_records(df.drop("file_name"), str(tmp_path / "out")) == 2
    assert {(r.unit_type, r.n) for r in sinks.write_corpus(df.drop("file_name"), str(tmp_path / "corpus")).collect()} == {("page", 1), ("region", 1)}
    sinks.write_csv(df, str(tmp_path / "csv"), ["page_id", "record_id"])
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["page_id", "record_id"]
    sinks.write_report(df.groupBy("unit_type").count(), str(tmp_path / "r.json"))
    assert len(json.loads((tmp_path / "r.json").read_text())) == 2
    assert "unit_type=page" in sinks.text_report(df.groupBy("unit_type").count(), "Units")
    assert spark.read.schema(RECORD).json(str(tmp_path / "corpus")).count() == 2


def test_reports_are_whole_or_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        sinks.write_report(spark.range(100_001), str(tmp_path / "r.json"))
    assert not (tmp_path / "r.json").exists()
    sinks.write_report(spark.range(100_000), str(tmp_path / "r.json"))
    assert len(json.loads((tmp_path / "r.json").read_text())) == 100_000
    with pytest.raises(ValueError):
        sinks.text_report(spark.range(10_001), "Ids")
    assert sinks.text_report(spark.range(10_000), "Ids").count("id=") == 10_000


def test_upsert_and_fingerprint(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    new = spark.createDataFrame([("b", 2, 1), ("b", 3, 2), ("c", 4, 1)], "k string, v int, seq int")
    assert {tuple(r) for r in sinks.upsert(old, new, "k").collect()} == {("a", 1), ("b", 3), ("c", 4)}
    a, b = (spark.createDataFrame([(x,) for x in xs], "f string") for xs in (["x", "y", "x"], ["y", "x"]))
    assert sinks.fingerprint(a, "f") == sinks.fingerprint(b, "f") != sinks.fingerprint(a.limit(1), "f")


def test_coco(spark, tmp_path):
    doc = {"images": [{"id": 1, "file_name": "a.png", "width": 10, "height": 10}], "categories": [{"id": 7, "name": "stamp"}],
           "annotations": [{"id": 1, "image_id": 1, "category_id": 7, "bbox": [0, 0, 2, 3], "iscrowd": 0}]}
    (tmp_path / "c.json").write_text(json.dumps(doc))
    images, annotations, categories = readers.read_coco(spark, str(tmp_path / "c.json"))
    assert (images.count(), annotations.count(), categories.first().name) == (1, 1, "stamp")
    ann = spark.createDataFrame([("b.png", 5, 5, 1, "stamp", [0, 0, 2, 3], None), ("a.png", 5, 5, 1, "stamp", [0, 0, 1, 1], [0.0, 0.0, 1.0, 0.0, 1.0, 1.0]), ("a.png", 5, 5, 2, "other", [0, 0, 1, 1], None), ("a.png", 5, 5, 3, "stamp", [0, 0, 0, 1], None)],
                                "file_name string, width int, height int, n int, name string, bbox array<int>, polygon array<double>")
    images, out = sinks.assemble_coco(ann, categories)
    assert [(r.file_name, r.id) for r in images.orderBy("id").collect()] == [("a.png", 0), ("b.png", 1)]
    rows = out.orderBy("id").collect()
    assert [(r.image_id, r.id, r.area) for r in rows] == [(0, 0, 1.0), (1, 1, 6.0)] and len(rows[1].segmentation[0]) == 8


def test_form_words(spark, tmp_path):
    (tmp_path / "f.xml").write_text('<form><handwritten-part><line id="l1" text="a|b"><word><cmp x="1" y="2" width="3" height="4"/><cmp x="5" y="1" width="1" height="1"/></word></line><line id="l2" text="no parts"/></handwritten-part></form>')
    assert [tuple(r) for r in readers.read_form_words(spark, str(tmp_path / "f.xml")).collect()] == [("l1", "a b", 1, 1, 6, 6)]


def test_files_and_settings(spark, tmp_path):
    for p in ("1934/x.pdf", "other/y.png", "other/z.txt"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text("x")
    got = [(r.path.split("/")[-1], r.year) for r in readers.list_inputs(spark, str(tmp_path)).collect()]
    assert got == [("x.pdf", 1934), ("y.png", None)]
    (tmp_path / "env").write_text("# c\nA='1'\nB=\"x y\"\nexport C=3\n")
    assert readers.read_settings(str(tmp_path / "env"), {"B": "z"}) == {"A": "1", "B": "z", "C": "3"}
    for p in ("r/images", "r/labels", "r/s/images"):
        (tmp_path / p).mkdir(parents=True)
    assert readers.find_data_roots(str(tmp_path)) == [str(tmp_path / "r")]


def test_stream_keeps_latest(spark, tmp_path):
    schema = "record_id string, v int, at timestamp"
    for n, rows in enumerate(([("a", 1, "2024-01-01"), ("b", 1, "2024-01-01")], [("a", 2, "2024-01-02"), ("c", 1, "2024-01-02")])):
        spark.createDataFrame(rows, "record_id string, v int, at string").withColumn("at", F.col("at").cast("timestamp")).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        refresh.keep_latest(stream, str(tmp_path / "table"), "record_id", "at", str(tmp_path / "check")).awaitTermination()
    got = {(r.record_id, r.v) for r in refresh.current(spark, str(tmp_path / "table")).collect()}
    assert got == {("a", 2), ("b", 1), ("c", 1)}
    assert refresh.current(spark, str(tmp_path / "nothing")) is None
