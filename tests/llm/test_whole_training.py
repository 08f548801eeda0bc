"""op5's weights are learned from all ids of all training rows."""

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

BYTE = public_tokenizers.path("byte_bpe_50k.json")


def test_every_window_of_every_row_is_learned(spark, monkeypatch):
    from sitebraid.llm import attention_lm as lm

    written, write = {}, lm.write_table
    monkeypatch.setattr(lm, "write_table", lambda df, name: written.setdefault(name, write(df, name)))
    texts = ["", None, "one", " ".join(f"w{i % 70}" for i in range(3000)), "x" * 5000 + " tail", *(" ".join(["so it goes on"] * n) for n in range(40))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lm.lm_scores(docs, BYTE, F.col("doc_id") % 4 != 3).collect()
    spell = lm.Speller(BYTE).spell
    sizes = [len(b"".join(spell(lm.words_of(t or "")))) // 4 for i, t in enumerate(texts) if i % 4 != 3]
    learned = written["weights"].where("part = 0").agg(F.sum("n")).first()[0]
    assert learned == sum(-(-(n + 1) // 48) for n in sizes) > 2 * len(sizes)


def test_windows_hold_each_id_and_the_end_once():
    from sitebraid.llm.attention_lm import BLOCK, _starts, _windows_of

    for n in (0, 1, 31, 47, 48, 49, 95, 96, 200):
        ids, starts = np.arange(n), _starts(n)
        windows = [np.frombuffer(w, "<i4") for w in _windows_of(ids, 1000, starts)]
        targets = np.concatenate([w[BLOCK:-1] for w in windows])
        assert targets[targets >= 0].tolist() == [*range(n), 998] and (windows[0][:BLOCK] == -1).all()
        assert [w.tobytes() for w in windows] == [_windows_of(ids, 1000, starts[i : i + 1])[0] for i in range(len(starts))]
