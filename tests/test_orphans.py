import random

from foliant.operators import bloom
from foliant.operators.orphans import find_orphans, iso_micros

DAY = 86_400_000_000


def brute(refs, made, gone):
    out = set()
    for key, t in refs:
        if not key or t is None:
            continue
        c = [x for k, x in made if k == key and x is not None]
        d = max((x for k, x in gone if k == key and x is not None and x <= t), default=None)
        before = max((x for x in c if x <= t), default=None)
        if d is not None and (before is None or before <= d):
            out.add((key, t, "deleted"))
        elif not c:
            out.add((key, t, "missing"))
        elif before is None:
            out.add((key, t, "late"))
    return out


def frames(spark, refs, made, gone):
    return (spark.createDataFrame(refs, "key string, t long"), spark.createDataFrame(made, "key string, t long"), spark.createDataFrame(gone, "key string, t long"))


def test_equal_brute_force_with_and_without_filter(spark):
    r = random.Random(7)
    when = lambda: r.randrange(6) * DAY + r.choice([0, 1, DAY // 2])
    keys = [f"k{i}" for i in range(40)] + ["hot"]
    made = [(r.choice(keys[:30] + ["hot"] * 20), when()) for _ in range(200)]
    gone = [(r.choice(keys[10:] + ["hot"] * 20), when()) for _ in range(150)]
    refs = [(r.choice(keys + ["hot"] * 20), when()) for _ in range(500)] + [(None, 1), ("", 1), ("k1", None)]
    want = brute(refs, made, gone)
    assert {k for *_, k in want} == {"deleted", "missing", "late"}
    for limit in (bloom.MAX_KEYS, 1):
        got = find_orphans(*frames(spark, refs, made + [(None, 5)], gone), max_keys=limit)
        assert {(x.key, x.t, x.orphan_kind) for x in got.collect()} == want


def test_boundaries(spark):
    refs, made, gone = [("a", 10), ("b", 10), ("c", 10), ("d", 10)], [("a", 10), ("b", 5), ("c", 10), ("d", 11)], [("b", 10), ("c", 10)]
    got = {(x.key, x.orphan_kind) for x in find_orphans(*frames(spark, refs, made, gone)).collect()}
    assert got == {("b", "deleted"), ("c", "deleted"), ("d", "late")}


def test_empty_tables(spark):
    refs, made, gone = frames(spark, [("a", 1), ("a", 1)], [("a", 1)], [("a", 1)])
    assert [x.orphan_kind for x in find_orphans(refs, made.limit(0), gone.limit(0)).collect()] == ["missing"]
    assert find_orphans(refs.limit(0), made, gone).count() == 0


def test_times_with_offsets(spark):
    texts = ["2023-03-01T10:00:00.5Z", "2023-03-01T12:00:00.5+02:00", "2023-03-01T10:00:00.500000+00:00", "2023-03-01T10:00:00.5", "nonsense", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[1] for r in df.select("i", iso_micros("t")).orderBy("i").collect()]
    assert len(set(got[:4])) == 1 and got[4:] == [None, None]


def test_filter_has_no_false_negative(spark):
    df = spark.range(5000).selectExpr("concat('k', id) as key")
    others = spark.range(5000).selectExpr("if(id = 7, null, concat('x', id)) as key", "id as maybe_not")
    for limit in (bloom.MAX_KEYS, 10):  # broadcast, and partitioned by hash
        found = bloom.build(df, "key", limit)
        assert found.broadcast == (limit > 10)
        assert bloom.mark(df, found, "key").where("not maybe").count() == 0
        marked = bloom.mark(others, found, "key").cache()
        assert marked.count() == 5000 and marked.where("maybe").count() < 500 and not marked.where("key is null").first().maybe
    assert bloom.mark(others, bloom.build(df.limit(0), "key"), "key").where("maybe").count() == 0


def test_the_filter_is_used_beyond_the_broadcast(spark):
    refs, made, gone = frames(spark, [(f"x{i}", 5) for i in range(300)] + [("a", 5)], [("a", 9)] + [(f"k{i}", 1) for i in range(100)], [])
    got = find_orphans(refs, made, gone, max_keys=10)
    assert {(x.key, x.orphan_kind) for x in got.collect()} == {("a", "late")} | {(f"x{i}", "missing") for i in range(300)}
    plan = got._jdf.queryExecution().toString()
    assert "__maybe" in plan and "BroadcastHashJoin [__word" not in plan
