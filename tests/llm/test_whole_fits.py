"""Models that are fitted on all rows, not on a sample."""

import numpy as np
from pyspark.sql import functions as F


def test_candidates_of_all_texts_count(spark):
    from sitebraid.llm import pii

    n = 12_000
    text = F.concat(F.lit("write to m"), F.col("id"), F.when(F.col("id") % 3 == 0, F.lit("@mail.example.org now")).otherwise(F.lit(" at 300.1.2.1234 now")))
    docs = spark.range(n).select(F.col("id").alias("doc_id"), text.alias("text"))
    found = {(r["y"], r["held"]): r["n"] for r in pii.examples(docs.unionAll(docs)).groupBy("y", "held").agg(F.sum("n").alias("n")).collect()}
    assert found[1, True] + found[1, False] == n / 3 and found[0, True] + found[0, False] == n * 2 / 3


def test_trees_over_a_table_are_those_of_arrays(spark):
    from sitebraid.llm import pii

    rng = np.random.default_rng(3)
    x = rng.integers(0, 12, (3000, len(pii.FEATURES)))
    x[:, 0] = rng.integers(0, 4, 3000)
    y = ((x[:, 2] > 4) & (x[:, 7] < 9) | (rng.random(3000) < 0.05)).astype(int)
    held = rng.random(3000) < 0.25
    times = rng.integers(1, 4, 3000)
    rows = [(a.tolist(), int(b), bool(c), int(n)) for a, b, c, n in zip(x, y, held, times, strict=True)]
    got = pii.boosted(spark.createDataFrame(rows, "x array<int>, y int, held boolean, n long").repartition(3))
    want = pii.boost(np.repeat(x, times, axis=0), np.repeat(y, times).astype(float), np.repeat(held, times))
    value = lambda t, r: t if isinstance(t, float) else value(t[2] if r[t[0]] <= t[1] else t[3], r)
    odds = [np.array([m.prior + sum(value(t, r) for t in m.trees) for r in x[:500]]) for m in (got, want)]
    assert np.allclose(*odds, atol=1e-3)
    score = np.floor(np.array([got.prior + sum(value(t, r) for t in got.trees) for r in x]) * pii.GRID) / pii.GRID
    for k in range(4):  # the lowest score at which all candidates from there on are precise enough
        own = held & (x[:, 0] == k)
        good = [s for s in set(score[own]) if np.average(y[own & (score >= s)], weights=times[own & (score >= s)]) >= pii.PRECISION]
        assert abs(got.thresholds[k] - (max(min(good), np.log(pii.FLOOR / (1 - pii.FLOOR))) if good else 1e9)) <= 0.002
    assert pii.boosted(spark.createDataFrame(rows[:0], "x array<int>, y int, held boolean, n long")) == pii.Trees([], 0.0, (1e9,) * 4)
