"""Every registered query against its SQL, at the smallest scale."""

import pytest
from compare import SMALL, difference

from sitebraid.plans import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    assert difference(spark, duck, registry.queries()[name], SQL[name], SMALL) == ""


def test_cache_answers(spark):
    from sitebraid.streaming.selection import cache_answers

    rows = [("a", 1, 0.0, False), ("a", 2, 5.0, True), ("a", 3, 11.0, True), ("a", 4, 31.0, True), ("a", 5, 32.0, False), ("b", 6, 0.0, True)]
    got = {r["event_id"]: r["answer"] for r in cache_answers(spark.createDataFrame(rows, "key string, event_id long, at double, failed boolean"), 10, 30).collect()}
    assert got == {1: "store", 2: "hit", 3: "stale", 4: "error", 5: "store", 6: "error"}


def test_cache_answers_stream_a_hot_key(spark):
    import random

    from sitebraid.streaming.selection import _answers, cache_answers

    rng, n = random.Random(3), 900
    rows = [("hot" if rng.random() < 0.6 else rng.choice("abc"), i, float(rng.randint(0, 2000)), rng.random() < 0.5) for i in range(n)]
    want, stored = {}, {}
    for key, i, at, failed in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        want[i], stored[key] = _answers(stored.get(key), at, failed, 4, 12)
    most = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        answers = cache_answers(spark.createDataFrame(rows, "key string, event_id long, at double, failed boolean"), 4, 12)
        assert {r["event_id"]: r["answer"] for r in answers.collect()} == want and set(want.values()) == {"hit", "store", "stale", "error"}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
    assert "FlatMapGroupsInPandas" not in answers._jdf.queryExecution().executedPlan().toString()  # holds a whole key


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_categories_compile(spark):
    spark.conf.set("spark.sql.codegen.fallback", "false")  # generated code that is too long fails
    try:
        for name in ("osm_category_counts", "diag_osm_status"):
            assert registry.queries()[name](spark, SMALL).count() > 0
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")


def test_forms_tell_apart_what_keys_tell_apart(spark):
    import random

    from pyspark.sql import functions as F

    from sitebraid.functions import geometry as g

    rng = random.Random(5)
    ring = lambda: [tuple(rng.choice((0.0, 0.0004, 1.0)) for _ in range(3)) for _ in range(rng.randint(1, 4))]
    rows = [(ring(), [ring() for _ in range(rng.randint(0, 2))]) for _ in range(400)]
    kind = "array<struct<x:double,y:double,z:double>>"
    df = spark.createDataFrame(rows, f"outer {kind}, inners array<{kind}>")
    both = df.select(g.surface_key(F.col("outer"), F.col("inners")).alias("key"), g.surface_form(F.col("outer"), F.col("inners")).alias("form")).distinct()
    got = [(r["key"], str(r["form"])) for r in both.collect()]
    assert len(got) == len({k for k, _ in got}) == len({f for _, f in got}) > 50
