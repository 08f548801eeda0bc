"""op5 spells texts whole and once, and reads only their ids afterwards."""

import random

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

BYTE = public_tokenizers.path("byte_bpe_50k.json")


def test_only_ids_are_read_after_spelling(spark, monkeypatch):
    from sitebraid.llm import attention_lm as lm

    written, write = {}, lm.write_table
    monkeypatch.setattr(lm, "write_table", lambda df, name: written.setdefault(name, write(df, name)))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["", None, "one", "a's b c <|endoftext|> x", *["so it goes on"] * 9])], "doc_id long, text string")
    lm.lm_scores(docs, BYTE, F.col("doc_id") % 4 != 3).collect()
    assert written["spelt"].columns == ["doc_id", "learn", "ids"]


def test_whole_texts_are_spelt_as_their_words():
    from sitebraid.llm import attention_lm as lm

    rng, first = random.Random(3), lm._first_ids(BYTE)
    chars = [chr(i) for i in [*range(33, 127), *range(128, 0x250), 0x1680, 0x2003, 0x2028, 0x3000, 0x4E00, 0x300, 0x660, 0x1F600, 0xFEFF, 0x200B, 0x1C, 0x1F, 0, 0x180E]] + [" "] * 60
    texts = ["", "a's b 's don't x<|endoftext|> y", "　a \u0085 b  c", *("".join(rng.choice(chars) for _ in range(60)) for _ in range(500))]
    split = [lm.words_of(t) for t in texts]
    alone = lm.Speller(BYTE)
    for words, packed in zip(split, lm.Speller(BYTE).spell_texts(split), strict=True):
        pieces = alone.spell(words)
        ids = np.frombuffer(packed, "<u4")
        assert packed == b"".join(pieces) and list(lm._pieces_of(ids, *lm._cut_words(ids, first))) == pieces


def _model(lm, rng):
    vocab = 402
    ids = np.minimum(rng.zipf(1.3, 20_000), vocab - 1) - 1
    keys, pairs = np.unique(ids[:-1] * vocab + ids[1:], return_counts=True)
    m = lm.Attention(np.bincount(ids, minlength=vocab).astype(float), keys, pairs.astype(float))
    m.set_base(np.bincount(m.row[keys // vocab].astype("i8") * lm.SYMBOLS + m.symbol[keys % vocab], weights=pairs, minlength=len(m.k) * lm.SYMBOLS).reshape(-1, lm.SYMBOLS))
    m.lead, m.out = rng.normal(0, 0.3, m.lead.shape).astype("f4"), rng.normal(0, 0.3, m.out.shape).astype("f4")
    return m, ids


def test_a_texts_score_does_not_depend_on_what_is_scored_beside_it():
    from sitebraid.llm import attention_lm as lm

    m, ids = _model(lm, np.random.default_rng(4))
    m.ready()
    texts = [ids[a : a + n].astype("u2") for a, n in zip(range(0, 9000, 300), [0, 1, 15, 16, 17, 40, 299] * 5, strict=False)]
    assert m.scores(texts).tolist() == [m.scores([t])[0] for t in texts] == m.scores(texts[::-1])[::-1].tolist()


def test_steps_go_down_the_gradient(monkeypatch):
    from sitebraid.llm import attention_lm as lm

    monkeypatch.setattr(lm, "_power", lambda x, more: np.exp((x + more - lm.ZERO) / lm.BITS).astype("f4"))
    m, ids = _model(lm, np.random.default_rng(5))
    windows = lm._as_windows([w for t in (ids[:150], ids[200:205]) for w in lm._windows_of(t, m.vocab, lm._starts(len(t)))])
    trainer = lm.Trainer(m, 0.0)
    trainer.step(windows)

    def loss():
        xs, total = np.where(windows >= 0, m.row[np.maximum(windows, 0)], m.pad), []
        for x, y in zip(xs, windows, strict=True):
            if y[0] == -1:
                x[np.flatnonzero(y >= 0)[0] - 1] = m.start
            for i in range(lm.BLOCK, len(y) - 1):
                if y[i + 1] >= 0:
                    seen = np.array([j for j in range(i // lm.BLOCK * lm.BLOCK - lm.BLOCK, i + 1) if x[j] != m.pad])
                    a = np.exp(m.k[x[seen]].astype("f8") @ m.q[x[i]] / lm.WIDTH**0.5 + m.near[i - seen])
                    h = a @ m.v[x[seen]] / a.sum()
                    group, member = divmod(int(m.symbol[y[i + 1]]), lm.MEMBERS)
                    for logits, at in ((m.base_lead[x[i]] + h @ m.lead, group), (m.base[x[i] * lm.GROUPS + group] + h @ m.out[group], member)):
                        total.append(logits[at] - np.log(np.exp(logits).sum()))
        return -2 * np.mean(total)

    for name in m.LEARNED:
        gradient, old = trainer.moment[name][0].astype("f8") * 10, getattr(m, name)
        by, around = 0.05 / np.linalg.norm(gradient), []
        for sign in (1, -1):
            setattr(m, name, old + sign * by * gradient)
            around.append(loss())
        setattr(m, name, old)
        assert np.isclose((around[0] - around[1]) / (2 * by), (gradient**2).sum(), rtol=0.02)
