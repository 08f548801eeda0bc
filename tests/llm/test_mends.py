"""Cases that earlier versions got wrong: page elements that never end, forms, many tiny pieces, ends of cut texts."""

import random

import numpy as np
import pytest

BODY = "<p>First paragraph with enough words to be read, and a comma.</p>"
MORE = "<p>Second paragraph that follows, and is part of the article too.</p>"


def extract(html):
    from sitebraid.llm.html_text import Page

    return Page(html).extract([])


@pytest.mark.parametrize("tag", ["select", "object", "svg", "math", "noscript", "template", "iframe"])
def test_hidden_elements_that_never_end(tag):
    page = f"<body><article>{BODY}<{tag} class=x>{MORE}</article></body>"
    assert extract(page) == "First paragraph with enough words to be read, and a comma.\nSecond paragraph that follows, and is part of the article too."
    hidden = f"<body><article>{BODY}<{tag}><b>inner</b></{tag}>{MORE}</article></body>"
    assert "inner" not in extract(hidden) and "Second" in extract(hidden)


@pytest.mark.parametrize("tag", ["svg", "math", "object", "template"])
def test_hidden_elements_nest(tag):
    page = f"<body><article>{BODY}<{tag}><{tag}>deep</{tag}>inner<{tag}>x</{tag}>last</{tag}>{MORE}</article></body>"
    assert not any(w in extract(page) for w in ("deep", "inner", "last")) and "Second" in extract(page)
    open_ = f"<body><article>{BODY}<{tag}>{MORE}<{tag}>gone</{tag}></article></body>"
    assert "Second" in extract(open_) and "gone" not in extract(open_)


def test_scripts_take_the_rest():
    assert "Second" not in extract(f"<body><article>{BODY}<script>{MORE}</article></body>")


def test_many_hidden_elements_without_ends():
    page = f"<body><article>{BODY}" + "<select><svg>" * 20_000 + MORE
    assert "Second" in extract(page)


def test_a_page_inside_a_form():
    article = f"<h1>Title of it</h1>{BODY}{MORE}" + "<p>More of the same text, which goes on and on for a while here.</p>" * 3
    page = f'<body><form id="aspnetForm" action="x"><input name=q><div class="content">{article}</div><button>Go</button></form></body>'
    assert extract(page).startswith("Title of it\nFirst") and "Go" not in extract(page)
    contact = f"<body><article>{BODY}{MORE}</article><form><p>Your name and mail</p><label>Name</label><textarea>t</textarea></form></body>"
    assert "Your name" not in extract(contact) and "Second" in extract(contact)
    alone = "<body><form><p>Search</p><label>Words</label></form></body>"
    assert extract(alone) == ""
    by_class = f'<body><article>{BODY}</article><form role="search">{MORE * 9}</form></body>'
    assert "Second" not in extract(by_class)


def test_fillings_of_very_many_pieces():
    from sitebraid.llm.packing import fillings, lower_bound, plan

    counts = np.zeros(1025, "i8")
    counts[1] = 3000
    assert fillings(counts, 1020)[0] == (1,) * 1020
    found = plan({1: 3000, 1020: 3, 700: 2, 350: 1})
    used = {}
    for p in found:
        assert sum(p.lengths) <= 1024
        for s in p.lengths:
            used[s] = used.get(s, 0) + p.times
    assert used == {1: 3000, 1020: 3, 700: 2, 350: 1} and sum(p.times for p in found) <= 10
    rng = random.Random(4)
    for _ in range(30):
        histogram = {rng.randint(1, 60): rng.randint(1, 9) for _ in range(8)}
        counts = np.zeros(101, "i8")
        for s, n in histogram.items():
            counts[s] = n
        room = rng.randint(1, 100)
        for chosen in fillings(counts, room):
            slack = room - sum(chosen)
            assert slack >= 0 and all(chosen.count(s) <= counts[s] for s in chosen)
            assert not any(0 < s <= slack and counts[s] > chosen.count(s) for s in range(1, 101))  # nothing left fits
        assert sum(p.times for p in plan(histogram, 100)) >= lower_bound(counts, 100)


def test_windows_end_only_where_texts_do():
    from sitebraid.llm.attention_lm import BLOCK, WINDOW_BLOCKS, _one_window

    names: dict[bytes, int] = {}
    spell = lambda words: [np.array([names.setdefault(w, len(names))], "<u4").tobytes() for w in words]
    size, end = WINDOW_BLOCKS * BLOCK + 1, 998
    read = lambda text, at: np.frombuffer(_one_window(text, at, spell, 1000), "<i4").tolist()
    long = " ".join(f"w{i}" for i in range(500))
    assert end not in read(long, 0) and read(long, 0)[:BLOCK] == [-1] * BLOCK
    short = " ".join(f"w{i}" for i in range(20))
    assert read(short, 0)[BLOCK + 20] == end and read(short, 0).count(end) == 1
    assert read("", 0) == [-1] * BLOCK + [end] + [-2] * (size - BLOCK - 1)
    at = long.index("w480") + 1  # inside a word: it isn't learned
    assert read(long, at)[0] == names[b"w481"] and end in read(long, at)
    wide = "x" * 5000 + " tail"
    assert read(wide, 0) == [-1] * BLOCK + [-2] * (size - BLOCK)
    cut = ("y" * 300 + " ") * 9
    assert sum(i >= 0 for i in read(cut, 0)) == 16 * size // 301 and end not in read(cut, 0)


def test_weights_do_not_depend_on_partitions(spark):
    import public_tokenizers
    from pyspark.sql import functions as F

    from sitebraid.llm.attention_lm import lm_scores

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 60")
    one, many = ({r["doc_id"]: r["score"] for r in lm_scores(docs.repartition(n), public_tokenizers.path("byte_bpe_50k.json"), F.col("doc_id") % 5 != 0).collect()} for n in (1, 7))
    assert one == many
