"""Near copies inside large families of texts that share a template: recall must not fall as the family grows."""

import random

import pytest


def family(n, copies, words=300, own=0.02, seed=7):
    """n texts from one template with edits of their own, and near copies of some: rows and planted pairs."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9)))
    template = [word() for _ in range(words)]
    texts = [[w if rng.random() > own else word() for w in template] for _ in range(n)]
    pairs = []
    for _ in range(copies):
        at = rng.randrange(n)
        copy = list(texts[at])
        for i in rng.sample(range(words), rng.randint(1, 5)):
            copy[i] = word()
        pairs.append((at, len(texts)))
        texts.append(copy)
    shingles = lambda t: {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
    alike = lambda a, b: len(a & b) / len(a | b)
    planted = [(a, b) for a, b in pairs if alike(shingles(texts[a]), shingles(texts[b])) >= 0.8]
    mean = sum(alike(shingles(texts[i]), shingles(texts[i + 1])) for i in range(50)) / 50
    return [(i, " ".join(t)) for i, t in enumerate(texts)], planted, mean


@pytest.mark.parametrize(("n", "own"), [(400, 0.02), (3000, 0.02), (3000, 0.016), (3000, 0.03)])
def test_recall_in_families(spark, n, own):
    from sitebraid.llm.simhash import near_copies

    rows, planted, mean = family(n, 100, own=own)
    assert 0.55 < mean < 0.8 and len(planted) > 80
    df = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "doc_id long, text string").repartition(8)
    got = {r["doc_id"]: r["component_id"] for r in near_copies(df).collect()}
    assert sum(got[a] == got[b] for a, b in planted) >= 0.97 * len(planted)
