"""Quality ledger, lexical search and divergence audit: against SQL, brute force, and on odd tables."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from compare import SMALL, difference

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, failed long, term string, `row` string, item long"
ODD = ["", " ", "a", "the the the", "x" * 30_000, "don't  stop\n\nat 12 ²³ 'S café ΣΑΣ İ 日本語 🙂", "\x00 \x1c nul", "word " * 4000, "a b\x0bc\x0cd\re\tf g h\na b c d e f g h\na b c d e f g h", "### $$$ | <b>"]


def odd_rows():
    rows = [(i, t) for i, t in enumerate(ODD)] + [(50, None), (None, "no id the"), (7, ODD[7]), (7, ODD[7])]
    return [(i, t, None if k % 3 else "en", "s" if k % 2 else None, None, 9, "clash", "r", 1) for k, (i, t) in enumerate(rows)]


def random_rows(n=150, seed=5):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4))) for _ in range(60)]
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(words[: rng.choice((3, 10, 60))]) for _ in range(rng.randint(0, 90)))
        if i % 5 == 0:
            text = f"{text}\n{text}, {text}"
        rows.append((i, text, rng.choice(("en", "de", None)), "hot" if i % 3 else f"s{i % 7}", None, 0, "", "", 0))
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    rows = {"odd": odd_rows(), "random": random_rows(), "none": []}
    return {k: (v, spark.createDataFrame(v, SCHEMA).repartition(3)) for k, v in rows.items()}


@pytest.mark.parametrize("name", ["op11_rule_ledger", "op12_accumulators", "op13_segment_trees"])
def test_same_as_sql(spark, duck, name):
    from sitebraid.llm import queries

    assert difference(spark, duck, queries.queries()[name], queries.oracle_sql()[name], SMALL) == ""


# 11 --------------------------------------------------------------- quality ledger


def brute_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


@pytest.mark.parametrize("which", ["odd", "random", "none"])
def test_ledger_by_brute_force(tables, which):
    from sitebraid.llm import quality

    rows, df = tables[which]
    got = quality.report(df).collect()
    want = Counter((r[0], *(m := brute_measures(r[1])), m[0] < 20 or 100 * m[4] > 30 * m[0]) for r in rows)
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got) == want
    assert not any(r["kept"] for r in got if r["base_failed"])
    assert all(r["kept"] == (r["failed"] == 0) and r["base_failed"] == bool(r["failed"] & 3) for r in got)


def test_ledger_needs_no_python(tables):
    from sitebraid.llm import quality

    plan = quality.measured(tables["odd"][1])._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange hash|Exchange range", plan)


def test_policies_and_ablations(spark):
    from sitebraid.llm import quality as q

    rng = random.Random(2)
    rows = [(i, rng.getrandbits(len(q.RULES)) & rng.getrandbits(len(q.RULES)) & rng.getrandbits(len(q.RULES)), "ab"[i % 2]) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, failed long, source string")
    lenient = q.Policy(9, ("symbols", "few_words", "long_words"), allowed=1)
    policies = (*q.POLICIES, lenient)
    kept = {r["doc_id"]: r for r in q.apply(df, policies).collect()}
    passes = lambda bits, mask, p: (bits & mask).bit_count() <= p.allowed
    assert all(kept[i][f"keeps_v{p.version}"] == passes(b, p.mask, p) for i, b, _ in rows for p in policies)
    for by in ((), ("source",)):
        got = {(*(r[c] for c in by), r["version"], r["rule"]): (r["failing"], r["kept"], r["kept_without"]) for r in q.ablations(df, policies, by).collect()}
        for key in {tuple(r[2] for _ in by) for r in rows}:
            own = [b for _, b, s in rows if not by or s == key[0]]
            for p in policies:
                for rule in p.rules:
                    bit = q.bits(rule)
                    assert got[(*key, p.version, rule)] == (sum(b & bit > 0 for b in own), sum(passes(b, p.mask, p) for b in own), sum(passes(b, p.mask & ~bit, p) for b in own))
    assert q.ablations(df.limit(0), policies).count() == 0


def test_repeats_in_a_very_long_text(spark):
    from sitebraid.llm import quality

    rng = random.Random(3)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(60_000)]
    text = " ".join([*words, *words[:30_000]])
    row = quality.measured(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["n_repeat_words"] == brute_measures(text)[4] > 60_000 - 100


# 12 --------------------------------------------------------------- lexical search


def brute_search(docs, items, k=10):
    pattern = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    found = [(i, Counter(re.findall(pattern, low(t)))) for i, t in docs]
    found = [(i, c, sum(c.values())) for i, c in found if c]
    n_docs, length = len(found), sum(n for _, _, n in found)
    df = Counter(t for _, c, _ in found for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in found:
            m = 10 + 90 * n * n_docs // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(re.findall(pattern, low(text))) if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return Counter(out)


@pytest.mark.parametrize("which", ["odd", "random", "none"])
def test_search_by_brute_force(spark, tables, which, monkeypatch):
    from sitebraid.llm import lexical

    rows, df = tables[which]
    texts = [(1, "the Word a"), (2, None), (2, "CAFÉ 日本語 x don t"), (3, "nowhere"), (None, "a b c d e"), *[(10 + r[0], r[1]) for r in random_rows(12, 8)]]
    items = spark.createDataFrame([(i, t, 5) for i, t in texts], "item_id long, text string, rank int")
    want = brute_search([(r[0], r[1]) for r in rows], texts)
    for postings, at_once in ((2_000_000, 500_000), (40, 500_000), (40, 30)):
        monkeypatch.setattr(lexical, "POSTINGS", postings)
        monkeypatch.setattr(lexical, "TERMS_AT_ONCE", at_once)
        got = lexical.search(df, items)
        assert Counter(tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()) == want
    assert lexical.search(df, items.limit(0)).count() == 0


def test_accumulators_are_limited_without_a_difference():
    from sitebraid.llm.lexical import Block, _first

    rng = np.random.default_rng(4)
    n, v = 3000, 50
    share = 1 / np.arange(2, v + 2)
    has = rng.random((n, v)) < share[::-1]
    doc, term = np.nonzero(has)
    tf = rng.integers(1, 5, len(doc))
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * h + 1))) for h in has.sum(0)])
    block = Block(np.arange(n), np.zeros(n, bool), rng.integers(20, 200, n), has.sum(1), term, tf, weights)
    order = np.argsort(has.sum(0), kind="stable")
    counted = []
    for k in (1, 10, 200):
        a, s = block.best(order, k)
        b, t = block.best(order, k, limited=False)
        one, two = _first(k, s, a, a * 0), _first(k, t, b, b * 0)
        assert a[one].tolist() == b[two].tolist() and s[one].tolist() == t[two].tolist()
        known = int(t[two][-1])
        c, u = block.best(order, k, known)
        assert c[_first(k, u, c, c * 0)].tolist() == b[two].tolist()
        counted.append((len(c), len(b)))
    assert counted[0][0] <= counted[0][1]


def test_accumulators_stop_early():
    from sitebraid.llm.lexical import Block

    # one rare, heavy term in 3 documents, one light term in all: the light one may make none
    n = 100
    sizes = np.array([2] * 3 + [1] * (n - 3))
    found = np.array([0, 1] * 3 + [1] * (n - 3))
    block = Block(np.arange(n), np.zeros(n, bool), np.full(n, 50), sizes, found, np.ones(len(found), "i8"), np.array([5000, 10]))
    places, scores = block.best(np.array([0, 1]), 3)
    assert places.tolist() == [0, 1, 2] and len(set(scores.tolist())) == 1  # survivors got the light term too
    assert scores[0] == block.parts[:3][0] + block.parts[3]


# 13 --------------------------------------------------------------- divergence


def brute_audit(rows, least, listed):
    term = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
    docs = [(r[2] or "", r[3] or "", Counter(re.findall(term, re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or "")))) for r in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in d[2])
        kept = sorted(t for t in df if df[t] >= least)
        groups = {s: Counter() for s in {d[1] for d in own}}
        for _, s, c in own:
            groups[s].update({t: c[t] for t in c if df[t] >= least})
        whole = sum(groups.values(), Counter())
        p_of = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        q, ps = p_of(whole), {s: p_of(c) for s, c in groups.items()}
        for s in groups:
            pairs = sorted((-sum(abs(ps[s][t] - ps[o][t]) for t in kept), o.encode(), o) for o in groups if o != s)
            terms = sorted((q[t] - ps[s][t], t.encode(), t) for t in kept if groups[s][t] and ps[s][t] > q[t])[:listed]
            out += [(lang, s, part, o, -v, r) for part, found in (("pair", pairs), ("term", terms)) for r, (v, _, o) in enumerate(found, 1)]
    return Counter(out)


@pytest.mark.parametrize("which", ["odd", "random", "none"])
def test_audit_by_brute_force(tables, which, monkeypatch):
    from sitebraid.llm import divergence as d

    rows, df = tables[which]
    for least, width, sources, pairs, counted in ((30, 4096, 48, 64, 200_000), (2, 4, 2, 3, 10), (1, 7, 1, 64, 1)):
        for name, value in (("LEAST_DOCUMENTS", least), ("WIDTH", width), ("SOURCES", sources), ("PAIRS", pairs), ("COUNTED", counted)):
            monkeypatch.setattr(d, name, value)
        got = d.audit(df).select("lang", "source", "part", "item", "value", "rank").collect()
        assert Counter(tuple(r) for r in got) == brute_audit(rows, least, 50)


def test_equal_node_pairs_are_priced_once():
    from sitebraid.llm.divergence import Trees, shares

    rng = np.random.default_rng(1)
    matrix = np.where(rng.random((6, 1000)) < 0.02, rng.integers(1, 9, (6, 1000)), 0)
    matrix[3] = matrix[2]
    totals = matrix.sum(1) + 5 * 1000
    trees = Trees(matrix)
    a, b = np.nonzero(np.triu(np.ones((6, 6), bool), 1))
    got, priced = trees.differences(a, b, totals)
    p = np.array([shares(row, np.full(1000, t)) for row, t in zip(matrix, totals, strict=True)])
    assert got.tolist() == [int(np.abs(p[i] - p[j]).sum()) for i, j in zip(a, b, strict=True)]
    assert priced < 15 * 40 and trees.roots[2] == trees.roots[3]
    assert sum(len(left) for left, _ in trees.children) < 6 * 1000  # nodes are shared


def test_shares_are_exact():
    from sitebraid.llm.divergence import shares

    rng = random.Random(6)
    for _ in range(300):
        total = rng.randint(10, 9 * 10**15)
        n = rng.randint(0, total - 5)
        assert shares(np.array([n]), np.array([total]))[0] == 1 + 10**9 * (n + 5) // total
