"""Texts that meet under crowded keys: every pair of near copies among them is linked, whatever chains and stars miss."""

import random

import numpy as np
import pytest
from test_families import family


def brute(texts):
    """The smallest position of each text's component; texts with 0.8 of their five-word shingles in common are linked."""
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in map(str.split, texts)]
    places: dict = {}
    has = np.zeros((len(sets), len({x for s in sets for x in s})), "f4")
    for i, s in enumerate(sets):
        has[i, [places.setdefault(x, len(places)) for x in s]] = 1
    common, sizes = has @ has.T, has.sum(axis=1)
    near = 18 * common >= 8 * (sizes[:, None] + sizes[None, :])
    root = np.arange(len(sets))
    while True:
        least = np.where(near, root[None, :], len(sets)).min(axis=1)
        if (least == root).all():
            return root.tolist()
        root = least


@pytest.mark.parametrize(("n", "own"), [(700, 0.013), (300, 0.0122)])
def test_no_link_of_a_crowded_key_is_lost(spark, n, own):
    from sitebraid.llm.simhash import near_copies

    rows, _, _ = family(n, 40, words=200, own=own, seed=3)
    want = brute([t for _, t in rows])
    df = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "doc_id long, text string").repartition(8)
    got = {r["doc_id"]: r["component_id"] for r in near_copies(df).collect()}
    assert 5 < len(set(want)) < n and [got[i] for i in range(len(rows))] == want


def test_blocks_find_all_links(spark, monkeypatch):
    from pyspark.sql import functions as F

    from sitebraid.llm import simhash

    monkeypatch.setattr(simhash, "BLOCK", 4)
    rows, _, _ = family(150, 20, words=120, own=0.02, seed=5)
    want = brute([t for _, t in rows])
    names = [i.to_bytes(16, "big") for i in range(len(rows))]
    sets = [(x, x, sorted(np.unique(simhash._hashes(t, 5)).view("i8").tolist())) for x, (_, t) in zip(names, rows, strict=True)]
    df = spark.createDataFrame(sets, "same binary, component binary, shingles array<long>")
    parent = list(range(len(rows)))
    for r in simhash.rest(df).collect():
        u, v = (int.from_bytes(r[x], "big") for x in "uv")
        old, new = sorted((parent[u], parent[v]))
        parent = [old if p == new else p for p in parent]
    assert parent == want and len(set(want)) > 5
    assert simhash.rest(df.withColumn("component", F.lit(b"one"))).isEmpty() and simhash.rest(df.limit(0)).isEmpty()
