"""The corpus operators against brute force, the tokenizers library and exact round trips, and on odd tables."""

import hashlib
import html
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"
WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, range int, score double, `row` string"
ODD_TEXTS = ["", " ", "a", "the the the", "x" * 30_000, "don't  stop\n\nat 12 ²³ 'S <|endoftext|> café ΣΑΣ İ 日本語 🙂", "\x00 \x1c nul", "word " * 4000, "me@mail.example.org +1 (578) 555-6437 4111 1111 1111 1111 10.0.0.1"]


def odd_rows():
    rows = [(i, t) for i, t in enumerate(ODD_TEXTS)] + [(50, None), (None, "no id"), (7, ODD_TEXTS[7]), (7, ODD_TEXTS[7])]
    return [(i, t, None, "s", None, 1, 0.5, "clash") for i, t in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


def library(path):
    t = Tokenizer.from_file(path)
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


# 1 ---------------------------------------------------------------- fingerprints


def test_syncmers_are_context_free():
    from sitebraid.llm import syncmers as s

    rng = random.Random(1)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(400))
    a = {int(h) for h in s._anchors(s.code_points(passage))[0]}
    b = {int(h) for h in s._anchors(s.code_points("zzz" + passage + "qq"))[0]}
    assert a <= b and len(a) > 30
    points = s.code_points(passage)

    def small(i):
        h = points[i].astype("u8")
        with np.errstate(over="ignore"):
            for j in range(1, s.S):
                h = h * s._M1 + points[i + j]
            return int(s._mix(np.array([h], "u8"))[0])

    want = [i for i in range(len(points) - s.K + 1) if min(w := [small(i + j) for j in range(s.K - s.S + 1)]) in (w[0], w[-1])]
    assert s._anchors(points)[1].tolist() == want


def brute_edit(rows):
    """(id, text) in order -> edited texts by the rule, descending ids."""
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)
    out = []
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        out.append((i, len(t), t[: len(t) - half] + after[:half]))
    return out


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_edited_fingerprints(request, which, texts):
    from sitebraid.llm.syncmers import as_text, code_points, edited_fingerprints, sketch

    rows = list(texts.items()) if which == "docs" else [(r[0], r[1]) for r in odd_rows()]
    got = edited_fingerprints(request.getfixturevalue(which)).collect()
    want = Counter((i, n, hashlib.sha256(e.encode()).hexdigest(), as_text(sketch(code_points(e)))) for i, n, e in brute_edit(rows))
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], r["edited_fingerprint"]) for r in got) == want
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    if which == "docs":
        assert np.mean([r["near_edited"] for r in got]) > np.mean([r["near_next"] for r in got]) + 0.2


def test_ids_past_doubles_and_frequent_ids(spark, monkeypatch):
    from sitebraid.llm import common
    from sitebraid.llm.syncmers import edited_fingerprints
    from sitebraid.llm.token_files import encode_write_read

    monkeypatch.setattr(common, "ROWS_A_RANGE", 4)
    rng = random.Random(3)
    texts = ["".join(rng.choice("abc def") for _ in range(rng.randint(0, 60))) for _ in range(160)]
    big = [((1 << 60) + i, t) for i, t in enumerate(texts[:40])]
    for rows in (big, [*big, (None, "no id")], [*big, *[(None, t) for t in texts[40:80]]], [*big, *[((1 << 60) + 7, t) for t in texts[40:]]]):
        df = spark.createDataFrame(rng.sample(rows, len(rows)), "doc_id long, text string").repartition(3)
        got = edited_fingerprints(df).collect()
        assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
        single = {i: n for i, n in Counter(i for i, _ in rows).items() if n == 1}
        want = {(i, e) for i, _, e in brute_edit(rows) if i in single and i is not None and i - 1 in single}
        assert want <= {(r["doc_id"], None) for r in got} | {(i, e) for i, _, e in brute_edit(rows) for r in got if r["doc_id"] == i and r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()}
        read = encode_write_read(df, WORD).orderBy("start").collect()
        ids = [r["doc_id"] for r in read]
        assert ids == sorted(ids, key=lambda i: (i is not None, i or 0)) and len(ids) == len(rows)
        assert [r["start"] for r in read] == np.concatenate([[0], np.cumsum([r["n_tokens"] for r in read])[:-1]]).tolist()


def test_edited_fingerprints_of_nothing(none):
    from sitebraid.llm.syncmers import edited_fingerprints

    assert edited_fingerprints(none).count() == 0


def test_likeness_is_a_share_of_common_anchors():
    from sitebraid.llm.syncmers import code_points, likeness, sketch

    rng = random.Random(4)
    text = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    a, b, c = (sketch(code_points(t)) for t in (text, text[:1500] + "".join(rng.choice("abcdefgh ") for _ in range(1500)), "".join(rng.choice("abcdefgh ") for _ in range(3000))))
    assert likeness(a, a) == 1 and 0.15 < likeness(a, b) < 0.6 and likeness(a, c) == 0 and likeness(a, b) == likeness(b, a)
    both = sorted(set(a[0].tolist()) | set(b[0].tolist()))[: len(a[0])]
    assert likeness(a, b) <= len(set(both) & set(a[0].tolist()) & set(b[0].tolist())) / len(both)


# 2 ---------------------------------------------------------------- toxicity


def test_toxicity_finds_held_out(spark):
    from sitebraid.llm.toxicity import held_out, toxicity

    d, lab = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    labels = {r["doc_id"]: r["toxic"] for r in lab.collect()}
    got = {r["doc_id"]: r for r in toxicity(d, lab).collect()}
    assert all(r["held_out"] == held_out(i) for i, r in got.items())
    own = [(got[i]["predicted"], y) for i, y in labels.items() if i in got and held_out(i)]
    assert sum(p for p, y in own if y == 0) <= 0.02 * len(own)
    assert sum(p for p, y in own if y == 1) >= 0.8 * sum(y for _, y in own)


def test_toxicity_odd(odd, none, spark):
    from sitebraid.llm.toxicity import Model, keep_clean, score, toxicity

    labels = spark.createDataFrame([(1, 1, None), (None, 1, 1), (2, 0, 7)], "doc_id long, quality int, toxic int")
    assert toxicity(odd, labels).count() == len(odd_rows())
    assert toxicity(none, labels).count() == 0
    assert score(none, Model()).count() == 0
    assert keep_clean(odd, Model()).columns == odd.columns


def test_label_model_recovers_accuracies():
    from sitebraid.llm.toxicity import VOTERS, LabelModel

    rng = np.random.default_rng(3)
    y = rng.random(4000) < 0.2
    votes = np.zeros((4000, len(VOTERS)), int)
    for j in range(6):
        votes[:, j] = (rng.random(4000) < np.where(y, 0.6, 0.02)).astype(int)
    votes[:, 6] = votes[:, 5]  # a copy must not count twice
    votes[:, -1] = np.where(rng.random(4000) < np.where(y, 0.05, 0.7), -1, 0)
    m = LabelModel(votes, 0.2)
    assert abs(m.accuracies()[VOTERS[0]][1] - 0.6) < 0.15
    assert ((m.toxic > 0.5) == y).mean() > 0.95


def test_label_model_by_brute_force():
    from sitebraid.llm.toxicity import VOTERS, LabelModel

    rng = np.random.default_rng(5)
    truth = rng.random(600) < 0.3
    votes = np.where(rng.random((600, len(VOTERS))) < np.where(truth[:, None], 0.5, 0.05), 1, 0)
    votes[:, -1] = np.where(votes[:, :-1].any(axis=1), 0, -1)
    m = LabelModel(votes, 0.3)
    for row in votes[:40]:
        joint = []
        for c, prior in ((0, 1 - m.prior), (1, m.prior)):
            p = prior
            for j, v in enumerate(row):
                above = row[m.parent[j]] + 1 if m.parent[j] >= 0 else 0
                p *= math.exp(m.tables[j][c][above][v + 1])
            joint.append(p)
        assert m.posterior(row[None, :])[0] == pytest.approx(joint[1] / sum(joint), rel=1e-6)
    for j, table in enumerate(m.tables):  # tables are counts by the posterior of the round before; each row adds up
        assert np.allclose(np.exp(table).sum(axis=2), 1)


def test_mined_terms_by_brute_force(spark):
    from sitebraid.llm import toxicity

    rng = random.Random(6)
    rows = [(" ".join(rng.choice("alpha beta gamma delta".split()) for _ in range(9)) + (" badword" if k % 5 == 0 else "") + (" worse" if k % 10 == 0 else ""), int(k % 5 == 0)) for k in range(400)]
    words, _ = toxicity.mine(spark.createDataFrame(rows, "text string, toxic int"))
    share, want = np.mean([y for _, y in rows]), {}
    for w in {w for t, _ in rows for w in t.split()}:
        toxic, n = sum(y for t, y in rows if w in t.split()), sum(w in t.split() for t, _ in rows)
        q = min(toxic / n, 1 - 1e-12)
        surprise = n * (q * math.log(q / share) + (1 - q) * math.log((1 - q) / (1 - share))) / math.log(10) if q > share else 0
        if toxic >= 3 and q >= toxicity.PURE and surprise >= toxicity.SURPRISE:
            want[w] = surprise
    assert list(words) == sorted(want, key=lambda w: (-round(want[w], 6), w)) == ["badword", "worse"]


def test_labels_of_repeated_ids_stay_bounded(spark):
    from sitebraid.llm.toxicity import labelled_sample

    docs = spark.createDataFrame([(1, f"text {k}") for k in range(50)] + [(2, "other"), (2, "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    from pyspark.sql import functions as F

    assert labelled_sample(docs, labels, F.lit(True)).count() == 2


# 3 ---------------------------------------------------------------- token files


def test_token_codes_round_trip():
    from sitebraid.llm.token_files import Segment, pack

    rng = np.random.default_rng(1)
    ids = rng.choice([0, 1, 255, 256, 49407, 65535, 65536, 2**24, 2**32 - 1], 5000).astype("u4")
    s = Segment(pack(ids))
    assert len(s) == 5000 and [s.token(i) for i in range(0, 5000, 97)] == ids[::97].tolist()
    for a, b in ((0, 5000), (511, 513), (1024, 1024), (4999, 5000), (7, 3001)):
        assert s.tokens(a, b).tolist() == ids[a:b].tolist()
    assert Segment(pack(np.zeros(0, "u4"))).tokens(0, 0).tolist() == []


def test_crc_join():
    from sitebraid.llm.token_files import crc_join

    a, b = b"hello" * 1000, bytes(range(256)) * 33
    assert crc_join(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    assert crc_join(zlib.crc32(a), zlib.crc32(b""), 0) == zlib.crc32(a)


@pytest.mark.parametrize("which", ["docs", "odd", "none"])
def test_token_files(request, which, texts, monkeypatch):
    from sitebraid.llm import token_files

    rows = {"docs": list(texts.items()), "odd": [(r[0], r[1]) for r in odd_rows()], "none": []}[which]
    encode, want, start = library(WORD), [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*encode(t), 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = token_files.encode_write_read(request.getfixturevalue(which), WORD).collect()
    assert sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got), key=lambda r: r[1]) == want


# 4 ---------------------------------------------------------------- packing


def test_plan_is_close_to_the_bound():
    from sitebraid.llm.packing import best_fit, lower_bound, plan

    rng = random.Random(5)
    for low, high, n in ((2, 1024, 800), (200, 700, 120), (250, 500, 40), (3, 3, 5), (1024, 1024, 4)):
        histogram = Counter(rng.randint(low, high) for _ in range(n))
        patterns = plan(dict(histogram))
        used = Counter()
        for p in patterns:
            assert sum(p.lengths) <= 1024
            for s in p.lengths:
                used[s] += p.times
        assert used == histogram
        counts = np.array([histogram.get(i, 0) for i in range(1025)])
        assert lower_bound(counts, 1024) <= sum(p.times for p in patterns) <= sum(p.times for p in best_fit(counts, 1024))


@pytest.mark.parametrize("which", ["docs", "odd", "none"])
def test_packing(request, which, texts):
    from sitebraid.llm.packing import cut, pack

    rows = {"docs": list(texts.items()), "odd": [(r[0], r[1]) for r in odd_rows()], "none": []}[which]
    encode, want = library(BYTE), Counter()
    for i, t in rows:
        ids = np.array([*encode(t), 2], "<u4")
        edges = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            want[i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    got = pack(cut(request.getfixturevalue(which), BYTE)).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    if rows:
        assert len(bins) <= 1.02 * sum(k[3] * n for k, n in want.items()) / 1024 + 2


# 5 ---------------------------------------------------------------- language model


def brute_base(rows):
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    words = [(i, (t or "").encode().translate(low).split() + [b""]) for i, t in rows]
    train = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 != 2
    c = Counter(w for i, ws in words if train(i) for w in ws)
    n, v = sum(c.values()), len(c)
    return n, [(i, len(ws), sum(c[w] > 0 for w in ws), sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in words]


@pytest.mark.parametrize("which", ["docs", "odd", "none"])
def test_language_model(request, which, texts, monkeypatch):
    from sitebraid.llm import attention_lm
    from sitebraid.llm.toxicity import crc_remainder

    monkeypatch.setattr(attention_lm, "HEAD", 2000)
    monkeypatch.setattr(attention_lm, "EPOCHS", 1)
    rows = {"docs": list(texts.items()), "odd": [(r[0], r[1]) for r in odd_rows()], "none": []}[which]
    n, want = brute_base(rows)
    got = attention_lm.lm_scores(request.getfixturevalue(which), BYTE, crc_remainder(7) != 2).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    got_rows = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["base_score"]) for r in got), key=key)
    for a, b in zip(got_rows, sorted(want, key=key), strict=True):
        assert a[:3] == b[:3] and math.isclose(a[3], b[3], rel_tol=1e-9, abs_tol=1e-9)
    assert all(r["train_tokens"] == n and r["score"] < 0 for r in got)


def test_head_only_saves_time(docs, monkeypatch):
    from sitebraid.llm import attention_lm
    from sitebraid.llm.toxicity import crc_remainder

    monkeypatch.setattr(attention_lm, "EPOCHS", 1)
    got = []
    for head in (20, 200_000):
        monkeypatch.setattr(attention_lm, "HEAD", head)
        got.append({r["doc_id"]: (r["n_known"], r["base_score"], r["score"]) for r in attention_lm.lm_scores(docs, BYTE, crc_remainder(7) != 2).collect()})
    assert got[0].keys() == got[1].keys()
    for i, a in got[0].items():
        assert a == pytest.approx(got[1][i], rel=1e-5)


def test_words_are_spelt_one_to_one():
    from sitebraid.llm.attention_lm import speller, words_of

    t = Tokenizer.from_file(BYTE)
    words = [b"don't", b"don", b"'t", "é".encode(), "É".encode(), "e\u0301".encode(), "\u00a0".encode(), "\u3000\u3000".encode(), b"<|endoftext|>", b"a<|endoftext|>", "🙂日".encode(), b"foo.", b"foo", b"\x1c"]
    assert words_of("Foo\u00a0BAR  x\ty") == ["foo\u00a0bar".encode(), b"x", b"y"]
    for w, packed in zip(words, speller(BYTE).spell(words), strict=True):
        assert t.decode(np.frombuffer(packed, "<u4").tolist(), skip_special_tokens=False).encode() in (b" " + w, w) and packed
    spelt = speller(BYTE).spell(words)
    assert len(set(spelt)) == len(words)
    assert spelt[0] != b"".join(speller(BYTE).spell([b"don", b"'t"]))


def test_held_out_text_is_likelier_than_by_the_base(spark):
    from sitebraid.llm import attention_lm
    from sitebraid.llm.toxicity import crc_remainder

    # words made of a few syllables, of one of two languages a text: what the base can't know and a model of the context can
    rng = random.Random(12)
    languages = [["tha", "ing", "her", "ou", "str", "ent"], ["che", "ein", "ver", "und", "lich", "auf"]]
    word = lambda syllables: "".join(rng.choice(syllables) for _ in range(rng.choice((1, 2, 3, 4))))
    rows = [(i, " ".join(word(languages[i % 2]) for _ in range(150))) for i in range(700)]
    scored = attention_lm.lm_scores(spark.createDataFrame(rows, "doc_id long, text string"), BYTE, crc_remainder(7) != 2).collect()
    held = [r for r in scored if zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2]
    base, score = (sum(r[c] for r in held) / sum(r["n_tokens"] for r in held) for c in ("base_score", "score"))
    assert score > base + 0.1


def test_attention_probabilities_add_up():
    from sitebraid.llm.attention_lm import BLOCK, SYMBOLS, Attention

    rng = np.random.default_rng(2)
    vocab = 402  # the last two: the end of a text, its beginning
    ids = np.minimum(rng.zipf(1.3, 40_000), vocab - 1) - 1
    windows = ids[: 50 * (4 * BLOCK + 1)].reshape(50, -1)
    keys, pairs = np.unique(ids[:-1] * vocab + ids[1:], return_counts=True)
    often = pairs > 1  # the table holds common bigrams only
    m = Attention(np.bincount(ids, minlength=vocab).astype(float), keys[often], pairs[often].astype(float))
    m.set_base(np.bincount(m.row[keys // vocab].astype("i8") * SYMBOLS + m.symbol[keys % vocab], weights=pairs, minlength=len(m.k) * SYMBOLS).reshape(-1, SYMBOLS))
    m.train(windows)
    m.ready()
    context = [rng.permutation(ids)[:37].astype("i8")]
    total = np.zeros(38)
    for candidate in range(vocab - 1):  # what every place gives to every id
        inputs, targets, _ = m.layout(context)
        at = targets >= 0
        targets[at] = candidate
        total += np.exp(m.log_probabilities(inputs, targets)[at].astype("f8"))
    unused = [x for x in range(SYMBOLS) if x not in m.symbol[: vocab - 1]]
    assert (total <= 1 + 1e-3).all() and (total > (0.99 if not unused else 0.5)).all()


# 6 ---------------------------------------------------------------- nearest neighbours


def test_posting_lists(spark):
    from sitebraid.llm.posting_lists import search

    rng = np.random.default_rng(4)
    v = rng.normal(size=(1500, 8)).astype("f4")
    v[100:600] = v[100]  # a third are the same
    rows = [(i, x.tolist(), 1.0) for i, x in enumerate(v)] + [(1500, None, 1.0), (1550, [0.0] * 8, 1.0), (1600, [float("nan")] * 8, 1.0), (1650, [None] * 8, 1.0), (None, v[0].tolist(), 1.0), (1700, [1.0], 1.0), (50, v[50].tolist(), 1.0)]
    got = search(spark.createDataFrame(rows, "vec_id long, embedding array<float>, score double"), lists=40).collect()
    x = v.astype("f8")
    norms = np.sqrt(np.einsum("ij,ij->i", x, x))
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(by) == set(range(0, 1500, 50))
    hits = 0
    for q, found in by.items():
        found.sort()
        assert [f[0] for f in found] == [1, 2, 3, 4, 5] and q not in [f[1] for f in found]
        s = x @ x[q] / (norms * norms[q])
        s[q] = -9
        best = np.lexsort((np.arange(1500), -np.round(s, 12)))[:5]
        hits += len({f[1] for f in found} & set(best.tolist()))
        assert all(math.isclose(f[2], s[f[1]], abs_tol=1e-12) for f in found)
    assert hits >= 0.9 * 5 * len(by)
    assert by[100][0][1] == 101 and by[150][0][1] == 100  # ties to the smaller id


def test_posting_lists_recall_with_many_lists(spark):
    from sitebraid.llm.posting_lists import NEAREST, search

    rng = np.random.default_rng(21)
    middles = rng.normal(size=(60, 24))
    v = middles[rng.integers(0, 60, 12_000)] + 0.6 * rng.normal(size=(12_000, 24))
    got = search(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>"), lists=400).collect()
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    found, all_ = 0, 0
    by_query: dict = {}
    for r in got:
        by_query.setdefault(r["query_id"], set()).add(r["vec_id"])
    for q in range(0, 12_000, 50):
        like = unit @ unit[q]
        like[q] = -2
        best = set(np.argsort(-like, kind="stable")[:NEAREST].tolist())
        found, all_ = found + len(best & by_query[q]), all_ + NEAREST
    assert found >= 0.9 * all_  # a query reads 12 to 48 of 400 lists or more


def test_posting_lists_huge_components(spark):
    from sitebraid.llm.posting_lists import search

    rows = [(0, [1e200, 0.0]), (1, [1e-200, 1e-200]), (50, [0.0, 3e250]), (2, [2.0, 2.0])]
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got[0, 1] == (1, pytest.approx(0.5**0.5)) and got[0, 2] == (2, pytest.approx(0.5**0.5)) and got[0, 3] == (50, 0.0)


def test_posting_lists_repeated_rows(spark):
    from sitebraid.llm.posting_lists import search

    rows = [(0, [1.0, 2.0])] * 9 + [(i, [1.0, 2.0]) for i in range(1, 8)] + [(100 + i, [1.0, -1.0 - i]) for i in range(9)]
    got = search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("query_id = 0").orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [1, 2, 3, 4, 5] and all(abs(r["score"] - 1) < 1e-12 for r in got)


def test_posting_lists_few(spark):
    from sitebraid.llm.posting_lists import search

    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (50, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert Counter(r["query_id"] for r in search(few).collect()) == {0: 2, 50: 2}
    assert search(few.where("vec_id < 0")).count() == 0


# 7 ---------------------------------------------------------------- near duplicates


def brute_fingerprint(t):
    low = (t or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123))))
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", low) if w]
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(values, radius=2, near=None):
    parent = list(range(len(values)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]) if near else bin(values[i] ^ values[j]).count("1") <= radius:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(values))]


def test_golay_keys_miss_nothing():
    from sitebraid.llm.simhash import file_keys, look_keys

    rng = np.random.default_rng(9)
    for _ in range(300):
        a = rng.integers(0, 2**63, 1, dtype="i8")
        b = a.copy()
        for bit in rng.choice(64, rng.integers(0, 3), replace=False):
            b ^= np.uint64(1 << int(bit)).view("i8")
        files, looks = ([set(f(x)[0].tolist()) for x in (a, b)] for f in (file_keys, look_keys))
        assert files[0] & looks[1] or files[1] & looks[0]


@pytest.mark.parametrize("which", ["docs", "odd", "none"])
def test_near_duplicates(request, which, texts):
    from sitebraid.llm.simhash import near_duplicates

    rows = {"docs": list(texts.items()), "odd": [(r[0], r[1]) for r in odd_rows()], "none": []}[which]
    values = [brute_fingerprint(t) for _, t in rows]
    roots = brute_components(values)
    least = {}
    for r, (i, _) in zip(roots, rows, strict=True):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    want = Counter((i, v, least.get(r)) for (i, _), v, r in zip(rows, values, roots, strict=True))
    got = near_duplicates(request.getfixturevalue(which)).collect()
    assert Counter((r["doc_id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in got) == want


def test_near_copies_find_edited_texts(spark):
    from sitebraid.llm.simhash import keep_one

    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    rows, n = [], 0
    for _ in range(30):
        words = [rng.choice(vocabulary) for _ in range(400)]
        for copy in range(3):
            edited = [w if rng.random() > 0.005 * copy else "edited" for w in words]
            rows.append((n, " ".join(edited), "x"))
            n += 1
    kept = [r["doc_id"] for r in keep_one(spark.createDataFrame(rows, "doc_id long, text string, fps string")).collect()]
    assert set(range(0, 90, 3)) <= set(kept) and len(kept) <= 33


def test_near_copies_are_verified(spark):
    from sitebraid.llm.simhash import keep_one

    rng = random.Random(18)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(4, 9)))
    rows = []
    for n in range(40):  # every 25th of the first 420 words differs: under 0.8 of the five-word shingles in common
        words = [word() for _ in range(600)]
        rows += [(2 * n, " ".join(words)), (2 * n + 1, " ".join(word() if i % 25 == 7 and i < 420 else w for i, w in enumerate(words)))]
    rows += [(100 + n, "so so " * 700 + " ".join(word() for _ in range(300))) for n in range(5)]  # one pair of words is most of each
    rows += [(200, rows[0][1] + " end"), (201, rows[0][1].upper())]
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in rows)}
    assert all(len(sets[2 * n] & sets[2 * n + 1]) < 0.8 * len(sets[2 * n] | sets[2 * n + 1]) for n in range(40))
    kept = {r["doc_id"] for r in keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {*range(80), *range(100, 105)}


def test_crowded_keys_are_exact(spark, monkeypatch):
    from sitebraid.llm import simhash
    from sitebraid.llm.components import connected

    monkeypatch.setattr(simhash, "CROWD", 3)
    rng = random.Random(2)
    values = {rng.getrandbits(63)}
    while len(values) < 150:
        v = rng.choice(sorted(values))
        for b in rng.sample(range(20), rng.randint(1, 4)):
            v ^= 1 << b
        values.add(v)
    values = sorted(values)
    roots = connected(simhash.links(spark.createDataFrame([(v,) for v in values], "fp long")))
    got = {r["node"]: r["root"] for r in roots.collect()}
    want = brute_components(values)
    assert [got.get(v, v) for v in values] == [values[r] for r in want]


# 8 ---------------------------------------------------------------- personal data

KINDS = ("email", "ip", "card", "phone")
PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(t):
    out = []
    for k, kind in enumerate(KINDS):
        for m in re.finditer(PLAIN[kind], t or ""):
            digits = re.sub("[^0-9]", "", m.group())
            total = sum(v if i % 2 == 0 else v * 2 - 9 * (v > 4) for i, v in enumerate(map(int, reversed(digits))))
            if {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.group().split(".")), "card": 12 <= len(digits) <= 19 and total % 10 == 0, "phone": 9 <= len(digits) <= 15}[kind]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


@pytest.mark.parametrize("which", ["docs", "odd", "none", "random"])
def test_personal_data(request, spark, which, texts):
    from sitebraid.llm.pii import report

    rng = random.Random(4)
    pieces = ["a", "b@", "@", "1", "2 ", "3-", "4", ".", "+", "(", ")", " ", "4111 1111 1111 1111", "é", "🙂", "x.y", "_", "-", "..", "0", "255"]
    made = [(i, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 40)))) for i in range(1500)] + [(2000, "1" * 30_000), (2001, "a@" + "b." * 10_000 + "c"), (2002, "a" * 50_000), (2003, "1 " * 20_000)]
    rows = {"docs": list(texts.items()), "odd": [(r[0], r[1]) for r in odd_rows()], "none": [], "random": made}[which]
    df = spark.createDataFrame(made, "doc_id long, text string") if which == "random" else request.getfixturevalue(which)
    want = Counter()
    for i, t in rows:
        spans = brute_spans(t)
        written = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
        want[(i, *(sum(s[1] == k for s in spans) for k in range(4)), hashlib.sha256(written.encode()).hexdigest())] += 1
    got = report(df).collect()
    assert Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in got) == want
    plan = report(df)._jdf.queryExecution().toString() if which == "docs" else ""
    assert not re.search("Python|Pandas|Arrow", plan)


def test_redaction_keeps_the_rest(spark):
    from sitebraid.llm.pii import Trees, redact

    t = "write me@mail.example.org or +1 (578) 555-6437, 10.0.0.1!"
    df = spark.createDataFrame([(1, t, 5, 9), (2, None, 6, 9), (3, "clean", 7, 9)], "doc_id long, text string, n_chars long, odds long")
    got = {r["doc_id"]: r for r in redact(df, Trees([], 0.0, (9.0,) * 4)).collect()}
    assert got[1]["text"] == "write <email> or <phone>, <ip>!" and got[1]["n_chars"] == len(got[1]["text"]) and got[1]["odds"] == 9
    assert got[2]["text"] == "" and got[3]["text"] == "clean"


def test_boosted_trees_tell_apart():
    from sitebraid.llm.pii import FEATURES, boost

    rng = np.random.default_rng(1)
    x = rng.integers(0, 10, (2000, len(FEATURES)))
    x[:, 0] = rng.integers(0, 4, 2000)
    y = ((x[:, 2] > 4) & (x[:, 7] < 6)).astype(float)
    trees = boost(x, y)
    value = lambda t, r: t if isinstance(t, float) else value(t[2] if r[t[0]] <= t[1] else t[3], r)
    odds = np.array([trees.prior + sum(value(t, r) for t in trees.trees) for r in x])
    assert ((odds > 0) == (y > 0)).mean() > 0.97


# 9 ---------------------------------------------------------------- html


def test_main_text_of_articles(spark):
    from sitebraid.llm.html_text import main_text

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r for r in main_text(pages).collect()}
    for r in pages.collect():
        inside = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1|li|ul|table|tr|td)>", inside)]
        assert got[r["page_id"]]["text"] == "\n".join(b for b in blocks if b)
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])


def test_main_text_behind_raw_elements():
    from sitebraid.llm.html_text import Page

    def texts(inner):
        return [b[1] for b in Page(f"<html><body><article><p>İstanbul İİ</p>{inner}<p>the rest of the article</p></article></body></html>").blocks]

    for inner in ("<script>var a = '<p>';</SCRIPT>", "<style>p {}</style>", '<svg width="1"/>', "<svg/>", "<math />", "<svg><path d='M0'/></svg>"):
        assert texts(inner) == ["İstanbul İİ", "the rest of the article"], inner


def test_main_text_hidden_elements():
    from sitebraid.llm.html_text import Page

    for attributes, kept in (("data-hidden='no'", True), ("class='x' hidden", False), ("hidden", False), ("hidden=''", False), ("data-x=hidden", True), ("aria-hidden=TRUE", False), ("style='display : none'", False), ("title='hidden'", True)):
        blocks = [b[1] for b in Page(f"<html><body><article><p>one</p><div {attributes}><p>two</p></div></article></body></html>").blocks]
        assert blocks == (["one", "two"] if kept else ["one"]), attributes


def test_main_text_nested_deeply():
    import time
    import tracemalloc

    from sitebraid.llm.html_text import Page

    began = time.time()
    tracemalloc.start()
    n = 30_000
    page = Page("<html><body>" + "<div class='c'>" * n + "<ul><li>" * n + "<p>deep text, with some words</p>" + "</section></b>" * n + "</div>" * n)
    text = page.extract(["/html/body"])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert text == "deep text, with some words" and peak < 120e6 and time.time() - began < 30
    best = page.ranked()[0][1]
    assert page.at_path(page.path(best)) == {best}


def test_hosts_vote(spark):
    from sitebraid.llm.html_text import host_paths, main_text

    page = lambda k, extra: f"<html><body><div class='shell'><div class='story-{k}'>{''.join(f'<p>Text {k} part {i}, long enough to count as one.</p>' for i in range(4))}</div><div class='box'>{extra}</div></div></body></html>"
    long = "".join(f"<p>{'boilerplate of the host, ' * 12}{i}</p>" for i in range(9))
    rows = [(k, f"http://a.example/{k}", page(k, "<p>x</p>")) for k in range(12)] + [(99, "http://a.example/99", page(99, long)), (100, "http://b.example/", page(100, "<p>y</p>"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    votes = {r["host"]: r["paths"] for r in host_paths(pages).collect()}
    assert votes["a.example"][0] == "/html/body/div.shell/div.story" and votes["a.example"] == sorted(set(votes["a.example"]), key=votes["a.example"].index)
    got = {r["page_id"]: r["text"] for r in main_text(pages).collect()}
    for k in (*range(12), 99, 100):  # page 99 alone would have taken the longer box
        assert got[k] == "\n".join(f"Text {k} part {i}, long enough to count as one." for i in range(4))


def test_main_text_odd(spark):
    from sitebraid.llm.html_text import Page, main_text

    rows = [(1, "http://a.example/x", None), (2, None, ""), (3, "nonsense", "<p>only text here, and some more of it"), (4, "http://a.example", "<div clas"), (4, "http://a.example", "<div clas"), (5, "//b", "<" * 5000 + "a='" * 2000), (None, "http://c", "<nav><p>menu</p></nav>")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, host string")
    got = main_text(df).collect()
    assert len(got) == len(rows) and all(r["text"] is not None and r["n_chars"] == len(r["text"]) for r in got)
    assert [r["text"] for r in got if r["page_id"] == 3] == ["only text here, and some more of it"]
    assert main_text(df.where("page_id < 0")).count() == 0
    page = Page("<body><header>site</header><div class=main-content><h1>T&amp;t</h1><p>One, two<br>three <b>four</b> five.<div class='ad-slot'>BUY</div><ul><li>item<li>next</ul><form>x</form><script>if(a<b){}</script></div><section id=comments><p>No, I disagree, at some length, really.</p></section><footer>c</footer>")
    assert page.extract([]) == "T&t\nOne, two three four five.\nitem\nnext"


# 10 --------------------------------------------------------------- automaton


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_automaton_is_the_library(path, texts):
    from sitebraid.llm.bpe_automaton import Codec
    from sitebraid.llm.subwords import PieceEncoder

    rng = random.Random(6)
    more = ODD_TEXTS + ["aaaaaaaaa hahahaha ======", "<<|endoftext|>>"] + ["".join(rng.choice("aehint sor'!.é\n字") for _ in range(60)) for _ in range(400)]
    codec, pieces, lib = Codec(path), PieceEncoder(path), Tokenizer.from_file(path)
    for t in more + list(texts.values()):
        ids = lib.encode(t, add_special_tokens=False).ids
        assert codec.encode([t])[0].tolist() == ids
        assert np.frombuffer(pieces.encode([t])[0], "<u4").tolist() == ids
        assert codec.decode(np.array(ids, "u4")) == lib.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("which", ["odd", "none"])
def test_automaton_odd(request, which):
    from sitebraid.llm.bpe_automaton import decode, encode, round_trip

    df = request.getfixturevalue(which)
    n = len(odd_rows()) if which == "odd" else 0
    assert round_trip(df, WORD).count() == n
    assert decode(encode(df, BYTE), BYTE).count() == n
    if n:
        back = {r["doc_id"]: r["text"] for r in decode(encode(df, BYTE), BYTE).collect()}
        assert back[5] == ODD_TEXTS[5] and back[50] == ""


# pipeline ---------------------------------------------------------


def brute_near(texts: dict) -> dict:
    """Roots of texts (by key) whose five-word shingle sets have 0.8 in common."""
    words = {i: " ".join(t.encode().lower().split(None) and [w.decode() for w in t.encode().lower().split()]) for i, t in texts.items()}
    sets = {i: ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 5 else {tuple(w)} if w else set()) for i, w in ((i, t.split(" ") if t else []) for i, t in words.items())}
    keys = sorted(texts)
    parent = {i: i for i in keys}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, a in enumerate(keys):
        for b in keys[x + 1 :]:
            common = len(sets[a] & sets[b])
            if words[a] == words[b] or 18 * common >= 8 * (len(sets[a]) + len(sets[b])) and common:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in keys}


def test_pipeline_stages(spark):
    import corpus_pipeline as p
    from sitebraid.llm import toxicity

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    clean = p.drop_toxic(spark, docs, SF)
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"), toxicity.crc_remainder(5) != 0)).collect()}
    kept = sorted(r["doc_id"] for r in clean.collect())
    assert kept == sorted(i for i, s in scores.items() if s < 0.5) and clean.columns == docs.columns
    single = p.drop_near_copies(spark, clean, SF)
    roots = brute_near({i: text[i] for i in kept})
    left = {r["doc_id"] for r in single.collect()}
    want = set(roots.values())
    assert want <= left and len(left) <= len(want) + 0.1 * (len(kept) - len(want)) and single.columns == docs.columns
    redacted = p.redact_personal_data(spark, single, SF)
    assert redacted.columns == docs.columns and not any("@mail" in r["text"] for r in redacted.collect())
    packed = p.pack_sequences(spark, redacted, SF).collect()
    assert {r["doc_id"] for r in packed} == left
    for name, stage in p.STAGES:
        stage(spark, docs.limit(0), SF).collect()


def test_near_copies_by_brute_force(spark):
    from sitebraid.llm.simhash import keep_one, near_copies

    rng = random.Random(31)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(4000)]
    rows = []
    for f in range(60):  # families of texts with edits, cuts and additions, down to about 0.7
        base = [rng.choice(words) for _ in range(rng.randint(60, 500))]
        for k in range(5):
            t = [w if rng.random() > rng.choice((0.004, 0.01, 0.02, 0.03)) else rng.choice(words) for w in base]
            t = t[: int(len(t) * rng.choice((1, 1, 0.95, 0.85)))]
            rows.append((len(rows), " ".join(t)))
    roots = brute_near(dict(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_copies(df).collect()}
    linked = [(a, b) for a in roots for b in range(a + 1, len(rows)) if roots[a] == roots[b]]
    assert len(linked) > 60 and sum(got[a] == got[b] for a, b in linked) >= 0.9 * len(linked)
    assert all(roots[a] == roots[got[a]] for a in got)  # nothing else is linked
    assert {r["doc_id"] for r in keep_one(df).collect()} == set(got.values())


def test_near_copies_of_repeated_ids_and_clashing_columns(spark):
    from sitebraid.llm.simhash import keep_one

    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(1, a, "u", 1), (5, b, "v", 2), (5, a, "w", 3), (5, b, "other", 2), (None, b, "v", 2), (None, None, None, None), (7, "", "v", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, text_hash string, mark long")
    got = keep_one(df).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == [(1, a), (5, b), (7, "")] and keep_one(df).columns == df.columns
    same = spark.createDataFrame([(3, a, "x", 1)] * 5 + [(4, a, "x", 1)], df.schema)
    assert [tuple(r) for r in keep_one(same).collect()] == [(3, a, "x", 1)]


def test_a_hot_key_is_chained_over_tasks(spark):
    from sitebraid.llm.simhash import proposed
    from pyspark.sql import functions as F

    nodes = spark.range(500).select(F.col("id").alias("node"), F.array(F.lit(77).cast("long")).alias("fps"), F.array(F.lit(5).cast("long"), F.lit(6).cast("long")).alias("sketch"))
    pairs = {(r["u"], r["v"]) for r in proposed(nodes).collect()}
    parent = list(range(500))
    for u, v in sorted(pairs):
        while parent[u] != u:
            u = parent[u]
        while parent[v] != v:
            v = parent[v]
        parent[max(u, v)] = min(u, v)
    assert sum(parent[i] == i for i in range(500)) == 1 and len(pairs) < 500 * 40


def test_shared_folder_is_not_local_on_a_cluster():
    from types import SimpleNamespace as N

    from sitebraid.llm.common import shared_folder

    context = N(getConf=lambda: N(get=lambda key: None), getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(RuntimeError):
        shared_folder(N(sparkContext=context))


def test_pipeline_odd(spark, odd):
    import corpus_pipeline as p

    docs = odd
    for name, stage in p.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() > 0
