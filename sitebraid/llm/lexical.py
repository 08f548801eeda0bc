"""Ranked lexical search over whole texts: term at a time, with limited accumulators.

Texts are read once into a forward index (a row a document: its length and the counts of the terms asked for),
which gives the statistics of the collection and of each term. Each task then inverts its documents block by
block and answers every item over a block:

* the item's terms are taken rarest first, and each adds its exact part to the accumulators of its documents;
* before a term, if what all terms left could add at most (their largest parts in the block) is below the k-th
  partial score known, no new accumulator is made, as its document could not come in;
* documents that have one go on being updated exactly.

The k-th score known is that of the block or of the task's blocks before it, whichever is higher. A task hands on
k documents an item; ranks are made from those. Scores are whole numbers, so sums don't depend on their order.
"""

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import as_batch, column, id_and_text, slices, write_table
from pyspark.sql import types as T

#: Documents an item gets.
BEST = 10
#: Distinct terms of items answered at once: what the driver holds and broadcasts. More items are answered in turns.
TERMS_AT_ONCE = 500_000
#: Counts of terms that a task inverts at once.
POSTINGS = 2_000_000
#: Octets of a term: digits, letters (A-Z as a-z) and all of other alphabets; every other octet parts terms.
_OCTETS = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    return text.translate(_OCTETS).split()


def _octets(part: pa.RecordBatch) -> list[bytes]:
    return column(part, "text").cast(pa.binary()).to_pylist()


def items_of(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item (a number a row), item_id and the distinct terms of each row, written to the shared folder."""
    rows = items.select(F.monotonically_increasing_id().alias("item"), F.col(id_col).cast("long").alias("item_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([column(b, "item"), column(b, "item_id"), pa.array([sorted(set(terms(t))) for t in _octets(b)], pa.list_(pa.binary()))], ["item", "item_id", "terms"])

    return write_table(rows.mapInArrow(run, "item long, item_id long, terms array<binary>"), "items")


def forward(docs: DataFrame, vocabulary: list[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (terms with repeats), terms (places in vocabulary), tf of every row. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})
    schema = T._parse_datatype_string("doc_id long, n long, terms array<int>, tf array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for part in slices(batches, 1024):
            out = {"doc_id": column(part, "doc_id"), "n": [], "terms": [], "tf": []}
            for text in _octets(part):
                found = terms(text)
                times = Counter(found)
                own = [t for t in times if t in known]
                out["n"].append(len(found))
                out["terms"].append([known[t] for t in own])
                out["tf"].append([times[t] for t in own])
            yield as_batch(out, schema)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, schema)


def weight(documents: int, holding: int) -> int:
    """How much a term counts that so many of all documents hold."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


class Block:
    """Documents of a task, inverted: for each term its documents and the parts it adds to their scores."""

    def __init__(self, ids: np.ndarray, no_id: np.ndarray, m: np.ndarray, sizes: np.ndarray, found: np.ndarray, tf: np.ndarray, weights: np.ndarray):
        self.ids, self.no_id = ids, no_id
        order = np.argsort(found, kind="stable")
        self.docs = np.repeat(np.arange(len(ids)), sizes)[order]
        tf = tf[order]
        self.terms, self.starts = np.unique(found[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(order))
        self.parts = weights[found[order]] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[self.docs]))
        self.most = np.maximum.reduceat(self.parts, self.starts) if len(order) else self.parts

    def best(self, rarest_first: np.ndarray, k: int, known: int = 0, limited: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of all accumulators that may be among the k best; known: a k-th score that is reached elsewhere."""
        at = np.searchsorted(self.terms, rarest_first)
        here = at[(at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] == rarest_first)] if len(self.terms) else at[:0]
        left = np.cumsum(self.most[here][::-1])[::-1]
        scores, making = np.zeros(len(self.ids), "i8"), True
        for i, t in enumerate(here):
            if making and limited and left[i] < max(known, _kth(scores, k)):
                making = False
            docs, parts = self.docs[self.starts[t] : self.ends[t]], self.parts[self.starts[t] : self.ends[t]]
            if not making:
                old = scores[docs] > 0
                docs, parts = docs[old], parts[old]
            scores[docs] += parts
        found = np.flatnonzero(scores >= max(1, known, _kth(scores, k)))
        return found, scores[found]


def _kth(scores: np.ndarray, k: int) -> int:
    """The k-th largest score, 0 if fewer are above 0."""
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0


def _first(k: int, scores: np.ndarray, ids: np.ndarray, no_id: np.ndarray) -> np.ndarray:
    return np.lexsort((ids, no_id, -scores))[:k]


def _searched(rows: DataFrame, asked: dict[int, np.ndarray], weights: np.ndarray, documents: int, length: int, k: int) -> DataFrame:
    """item, doc_id, score: each task's k best of every item."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((asked, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weights = shared.value
        kept: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

        def answer(parts: list[pa.RecordBatch]) -> None:
            one = pa.Table.from_batches(parts).combine_chunks()
            ids, n = one["doc_id"], one["n"].to_numpy().astype("i8")
            flat = lambda c: one[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("i8")
            sizes = one["terms"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
            block = Block(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(), 10 + (90 * n * documents) // length, sizes, flat("terms"), flat("tf"), weights)
            for item, wanted in asked.items():
                old = kept.get(item)
                places, scores = block.best(wanted, k, int(old[0][-1]) if old is not None and len(old[0]) == k else 0)
                if len(places):
                    new = (scores, block.ids[places], block.no_id[places])
                    both = tuple(np.concatenate([a, b]) for a, b in zip(old, new, strict=True)) if old is not None else new
                    first = _first(k, *both)
                    kept[item] = tuple(x[first] for x in both)

        held, size = [], 0
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                held.append(part)
                size += len(column(part, "terms").flatten())
                if size >= POSTINGS:
                    answer(held)
                    held, size = [], 0
        if size:
            answer(held)
        for item, (scores, ids, no_id) in kept.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), item)), pa.array(ids, pa.int64(), mask=no_id), pa.array(scores)], ["item", "doc_id", "score"])

    return rows.where(F.size("terms") > 0).select("doc_id", "n", "terms", "tf").mapInArrow(run, "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = BEST) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents above 0 of every row of items.

    Null texts have no terms; items without known terms get no rows. Each row of documents is ranked by itself, so a
    repeated row comes repeatedly; equal scores go by ascending doc_id, null ids last. Rows of items with one
    item_id are answered one by one. Empty tables give an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    asked = items_of(items)
    total = asked.agg(F.sum(F.size("terms")).alias("n")).first()["n"] or 0
    turns = max(1, -(-2 * total // TERMS_AT_ONCE)) if total > TERMS_AT_ONCE else 1
    found = []
    for turn in range(turns):
        own = asked.where(F.pmod(F.xxhash64("item"), F.lit(turns)) == turn).select("item", "terms").collect()  # TERMS_AT_ONCE terms or so
        vocabulary = sorted({bytes(t) for r in own for t in r["terms"]})
        rows = write_table(forward(docs, vocabulary), "forward")
        whole = rows.agg(F.count(F.when(F.col("n") > 0, 1)).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
        holding = np.zeros(len(vocabulary), "i8")
        for r in rows.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).toLocalIterator():  # a row a term of the vocabulary at most
            holding[r["t"]] = r["n"]
        weights = np.array([weight(whole["documents"], int(h)) for h in holding], "i8")
        number = {t: i for i, t in enumerate(vocabulary)}
        rarest_first = {r["item"]: np.array(sorted((number[bytes(t)] for t in r["terms"]), key=lambda i: (holding[i], i)), "i8") for r in own}
        found.append(_searched(rows, rarest_first, weights, whole["documents"], max(1, whole["length"]), k))
    best = found[0]
    for more in found[1:]:
        best = best.unionByName(more)
    order = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = rf"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
    n AS (SELECT r, doc_id, CAST(len(ws) AS BIGINT) AS n FROM d WHERE len(ws) > 0),
    g AS (SELECT CAST(count(*) AS BIGINT) AS nd, CAST(sum(n) AS BIGINT) AS l FROM n),
    tf AS (SELECT r, t, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(ws) AS t FROM d) GROUP BY ALL),
    df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
    w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * nd + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM df, g),
    q AS (SELECT DISTINCT i, item_id, t FROM (SELECT row_number() OVER () AS i, item_id, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark)),
    s AS (SELECT i, item_id, doc_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nd) // l)))) AS BIGINT) AS score
        FROM q JOIN w USING (t) JOIN tf USING (t) JOIN n USING (r), g GROUP BY ALL),
    k AS (SELECT *, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM s WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM k WHERE rank <= {BEST}"""
