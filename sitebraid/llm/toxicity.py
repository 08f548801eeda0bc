"""Toxicity by weak supervision.

Voters look at a text and say toxic (1), clean (-1) or nothing (0): lexicons of words and word beginnings
mined from labelled training rows, short fixed lexicons, and patterns. A generative label model, fitted by
expectation maximisation without labels, estimates each voter's accuracy in each class and, in a tree over
the voters, how each depends on the one it goes with most beyond the class. A linear classifier is then
trained on the model's posterior labels, over the voters and the single terms, and scores every text.

Mining, the label model and the classifier use a bounded sample of labelled rows (SAMPLE_TOXIC and
SAMPLE_CLEAN, taken by a hash of the id); scoring covers all rows. Labels, language, source and id are
never inputs of a score.
"""

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, id_and_text, map_slices, slices, write_table

#: Most labelled rows of each class in the sample.
SAMPLE_TOXIC, SAMPLE_CLEAN = 8_000, 24_000
#: Most mined terms of a kind, and how unlikely (-log10) a term's share of toxic rows must be by chance.
MOST_TERMS, SURPRISE = 400, 3.4
#: Lengths of word beginnings; groups that mined words and beginnings are dealt into, one voter each.
BEGINNINGS, WORD_GROUPS, BEGINNING_GROUPS = (4, 5), 8, 4
#: A beginning counts apart for one, two and so many different words; least share of toxic rows of a mined term.
MOST_STARS, PURE = 4, 0.85
#: Rounds of expectation maximisation and of training.
ROUNDS, STEPS, RIDGE = 30, 300, 1e-3
#: Different terms that a task counts before it hands them on.
COUNTED = 150_000

# Common insults of four languages and words that address somebody.
INSULTS = (
    ("asshole", "bastard", "clown", "disgusting", "dumb", "fool", "garbage", "hateful", "idiot", "idiots", "imbecile", "jerk", "loser", "losers", "moron", "morons", "pathetic", "scum", "shut", "stupid", "trash", "ugly", "vermin", "worthless"),
    ("abruti", "arschloch", "basura", "blödmann", "cabrón", "connard", "crétin", "dumm", "dummkopf", "escoria", "estúpido", "gilipollas", "idiota", "imbécile", "imbécil", "ordure", "salaud", "schwein", "trottel", "wertlos"),
)
ADDRESS = ("du", "eres", "ihr", "you", "your", "tu", "vous", "usted")

WORD = re.compile(r"[^\W\d_]+")
_AIMED = re.compile(r"\b(?:%s)\b\W+(?:\w+\W+){0,2}(?:%s)\b" % ("|".join(ADDRESS), "|".join(INSULTS[0] + INSULTS[1])))
_MASKED = re.compile(r"\b\w[*#@$%]{2,}\w?|[@#$%&]{4,}")
_RUNS = re.compile(r"!{2,}")
VOTERS = [f"words {i}" for i in range(WORD_GROUPS)] + [f"beginnings {i}" for i in range(BEGINNING_GROUPS)] + ["insults", "insults elsewhere", "aimed", "shouting", "exclaiming", "masked", "several", "silent"]


@dataclass
class Model:
    """Mined terms with their group, and the classifier's weights; small enough for a task's closure."""

    words: dict[str, int] = field(default_factory=dict)
    beginnings: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(len(VOTERS)))
    offset: float = -4.0
    accuracies: dict[str, tuple[float, float]] = field(default_factory=dict)


def terms_of(text: str) -> tuple[set[str], set[str]]:
    """Different words, and beginnings with a star for each further different word (up to MOST_STARS) that has it."""
    words = set(WORD.findall(text.lower()))
    beginnings: set[str] = set()
    for n in BEGINNINGS:
        for b in (w[:n] for w in words if len(w) > n):
            for _ in range(MOST_STARS):
                if b not in beginnings:
                    beginnings.add(b)
                    break
                b += "*"
    return words, beginnings


def votes_and_terms(text: str, model: Model) -> tuple[list[int], list[int]]:
    """What the voters say, and the numbers of the terms found (words, then beginnings)."""
    words, beginnings = terms_of(text)
    hit_words, hit_beginnings = words & model.words.keys(), beginnings & model.beginnings.keys()
    votes = [0] * len(VOTERS)
    found = []
    for w in hit_words:
        n = model.words[w]
        votes[n % WORD_GROUPS] = 1
        found.append(n)
    for b in hit_beginnings:
        n = model.beginnings[b]
        votes[WORD_GROUPS + n % BEGINNING_GROUPS] = 1
        found.append(len(model.words) + n)
    at = WORD_GROUPS + BEGINNING_GROUPS
    fixed = [bool(words & s) for s in _INSULT_SETS]
    votes[at], votes[at + 1] = int(fixed[0]), int(fixed[1])
    if any(fixed):
        votes[at + 2] = int(bool(_AIMED.search(text.lower())))
    votes[at + 3] = int(len(text) > 20 and sum(map(str.isupper, text)) > 0.4 * len(text))
    votes[at + 4] = int(bool(_RUNS.search(text)))
    votes[at + 5] = int(bool(_MASKED.search(text)))
    votes[at + 6] = int(len(hit_words) > 1)
    votes[at + 7] = 0 if hit_words or hit_beginnings or any(fixed) else -1
    return votes, found


_INSULT_SETS = tuple(frozenset(s) for s in INSULTS)


def _surprise(toxic: Column, clean: Column, share: float) -> Column:
    """-log10 of Chernoff's bound on so many toxic rows among a term's rows, if it were as toxic as all."""
    n = toxic + clean
    q = F.least(F.greatest(toxic / n, F.lit(1e-12)), F.lit(1 - 1e-12))
    distance = q * F.log(q / F.lit(share)) + (1 - q) * F.log((1 - q) / F.lit(1 - share))
    return F.when(q > share, n * distance / math.log(10)).otherwise(0.0)


def mine(sample: DataFrame) -> tuple[dict[str, int], dict[str, int]]:
    """Words and beginnings that mark toxic rows of sample (text, toxic), most telling first, numbered."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, str], list[int]] = {}

        def out():
            keys = list(counts)
            batch = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.string()), pa.array([counts[k][0] for k in keys], pa.int64()), pa.array([counts[k][1] for k in keys], pa.int64())], ["kind", "term", "clean", "toxic"])
            counts.clear()
            return batch

        for batch in slices(batches):
            for text, toxic in zip(column(batch, "text").to_pylist(), column(batch, "toxic").to_pylist(), strict=True):
                for kind, terms in enumerate(terms_of(text)):
                    for t in terms:
                        counts.setdefault((kind, t), [0, 0])[toxic] += 1
            if len(counts) > COUNTED:
                yield out()
        if counts:
            yield out()

    rates = sample.agg(F.avg("toxic").alias("share")).first()["share"]
    if not rates or rates >= 1:
        return {}, {}
    sums = sample.mapInArrow(count, "kind int, term string, clean long, toxic long").groupBy("kind", "term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    pure = F.col("toxic") / (F.col("clean") + F.col("toxic")) >= PURE
    strong = sums.where((F.col("toxic") >= 3) & pure).withColumn("surprise", F.round(_surprise(F.col("toxic"), F.col("clean"), float(rates)), 6)).where(F.col("surprise") >= SURPRISE)
    # every term is ranked; the most telling MOST_TERMS of each kind come to the driver
    found = [strong.where(F.col("kind") == k).orderBy(F.desc("surprise"), "term").limit(MOST_TERMS).collect() for k in (0, 1)]
    return tuple({r["term"]: i for i, r in enumerate(rows)} for rows in found)


class LabelModel:
    """p(class) and p(vote | class, the vote it goes with), over a tree of voters."""

    def __init__(self, votes: np.ndarray, balance: float):
        """votes: rows of -1, 0, 1. Fitted without labels; balance starts the share of toxic rows."""
        self.votes, (n, m) = votes + 1, votes.shape
        self.parent = [-1] * m
        total = votes.sum(axis=1)
        toxic = np.where(total > 0, 0.9, np.where(total < 0, 0.05, balance))
        for step in range(ROUNDS):
            if step in (5, 15):
                self.parent = self._tree(toxic)
            self.prior = float(np.clip(toxic.mean(), 1e-4, 1 - 1e-4))
            self.tables = [self._table(j, toxic) for j in range(m)]
            toxic = self.posterior(votes)
        self.toxic = toxic

    def _table(self, j: int, toxic: np.ndarray) -> np.ndarray:
        """log p(vote of j | class, parent's vote), smoothed."""
        table = np.full((2, 3, 3), 0.5)
        above = self.votes[:, self.parent[j]] if self.parent[j] >= 0 else np.zeros(len(self.votes), int)
        for c, weight in ((0, 1 - toxic), (1, toxic)):
            np.add.at(table[c], (above, self.votes[:, j]), weight)
        return np.log(table / table.sum(axis=2, keepdims=True))

    def _tree(self, toxic: np.ndarray) -> list[int]:
        """The spanning tree of greatest mutual information given the class."""
        n, m = self.votes.shape
        hot = (self.votes[:, :, None] == np.arange(3)).astype("f4").reshape(n, 3 * m)
        gain = np.zeros((m, m))
        for weight in (1 - toxic, toxic):
            joint = (hot * weight[:, None].astype("f4")).T @ hot + 1e-6
            share = joint / max(weight.sum(), 1e-6)
            single = np.clip(np.diag(share), 1e-9, None)
            gain += (weight.mean() * share * np.log(np.clip(share, 1e-9, None) / np.outer(single, single))).reshape(m, 3, m, 3).sum(axis=(1, 3))
        parent, best, inside = [-1] * m, gain[0].copy(), {0}
        source = [0] * m
        for _ in range(m - 1):
            j = max((k for k in range(m) if k not in inside), key=lambda k: best[k])
            inside.add(j)
            parent[j] = source[j]
            for k in range(m):
                if k not in inside and gain[j, k] > best[k]:
                    best[k], source[k] = gain[j, k], j
        return parent

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        votes = votes + 1
        odds = np.full(len(votes), math.log(self.prior / (1 - self.prior)))
        for j, table in enumerate(self.tables):
            above = votes[:, self.parent[j]] if self.parent[j] >= 0 else np.zeros(len(votes), int)
            odds += table[1][above, votes[:, j]] - table[0][above, votes[:, j]]
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))

    def accuracies(self) -> dict[str, tuple[float, float]]:
        """How often each voter speaks in favour of toxic in either class."""
        return {name: tuple(float((w * (self.votes[:, j] == 2)).sum() / max(w.sum(), 1e-9)) for w in (1 - self.toxic, self.toxic)) for j, name in enumerate(VOTERS)}


def train_linear(features: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, float]:
    """Ridge logistic regression on soft labels, by accelerated gradient steps."""
    n, m = features.shape
    x = features.astype("f4")
    step = 4.0 / max(1.0, float(np.square(x).sum(axis=1).mean()) + 1)
    w, b = np.zeros(m, "f4"), math.log(max(target.mean(), 1e-4) / max(1 - target.mean(), 1e-4))
    vw, vb = w.copy(), b
    for k in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ vw + vb, -30, 30)))
        miss = (p - target).astype("f4")
        w1, b1 = vw - step * (x.T @ miss / n + RIDGE * vw), vb - step * float(miss.mean())
        vw, vb = w1 + k / (k + 3) * (w1 - w), b1 + k / (k + 3) * (b1 - b)
        w, b = w1, b1
    return w.astype("f8"), float(b)


def labelled_sample(docs: DataFrame, labels: DataFrame, training: Column) -> DataFrame:
    """text, toxic of at most SAMPLE_TOXIC + SAMPLE_CLEAN labelled training ids: one row an id (the text of smallest hash, where it has several) and a text."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & training)
    parts = [usable.where(F.col("toxic") == c).groupBy("doc_id", "toxic").count().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for c, most in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN))]
    picked = F.broadcast(parts[0].unionByName(parts[1]).select("doc_id", "toxic"))  # bounded by the two sizes
    met = id_and_text(docs).join(picked, "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return met.select("text", "toxic").dropDuplicates(["text", "toxic"])


def fit(docs: DataFrame, labels: DataFrame, training: Column) -> Model:
    """Mines the lexicons, fits the label model and trains the classifier. training: which doc_ids may be learned from.

    Rows with a null id or a label other than 0 and 1 are not learned from. Without usable labels the
    fixed lexicons and patterns remain, with a weight of one vote each.
    """

    sample = write_table(labelled_sample(docs, labels, training), "labelled")
    words, beginnings = mine(sample)
    model = Model(words, beginnings)
    rows = sample.select("text").mapInArrow(_vote_rows(model), "votes array<int>, terms array<int>").collect()  # at most the sample
    width = len(VOTERS) + len(words) + len(beginnings)
    if len(rows) < 20 or not words and not beginnings:
        model.weights = np.concatenate([np.full(len(VOTERS), 0.5), np.zeros(width - len(VOTERS))])
        model.weights[[VOTERS.index("insults"), VOTERS.index("insults elsewhere")]] = 5.0
        return model
    votes = np.array([r["votes"] for r in rows], "i8")
    balance = sample.agg(F.avg("toxic")).first()[0]
    labeller = LabelModel(votes, balance)
    features = np.zeros((len(rows), width), "f4")
    features[:, : len(VOTERS)] = votes
    for i, r in enumerate(rows):
        features[i, np.asarray(r["terms"], "i8") + len(VOTERS)] = 1
    model.weights, model.offset = train_linear(features, labeller.toxic)
    model.accuracies = labeller.accuracies()
    return model


def _vote_rows(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            both = [votes_and_terms(t, model) for t in column(batch, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([b[0] for b in both], pa.list_(pa.int32())), pa.array([b[1] for b in both], pa.list_(pa.int32()))], ["votes", "terms"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every row's whole text (null: empty); no shuffle."""

    def run(part: pa.RecordBatch) -> dict:
        return {"doc_id": column(part, "doc_id"), "score": [_score_text(t, model) for t in column(part, "text").to_pylist()]}

    return map_slices(id_and_text(docs), run, "doc_id long, score double")


def _score_text(text: str, model: Model) -> float:
    votes, terms = votes_and_terms(text, model)
    odds = model.offset + float(np.dot(model.weights[: len(VOTERS)], votes)) + float(sum(model.weights[len(VOTERS) + t] for t in sorted(terms)))
    return 1 / (1 + math.exp(-min(30, max(-30, odds))))


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose text scores below threshold; null texts count as empty. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text=text_col):
            yield part.filter(pa.array([_score_text(t or "", model) < threshold for t in column(part, text_col).to_pylist()]))

    return docs.mapInArrow(run, docs.schema)


def crc_remainder(divisor: int, id_col: str = "doc_id") -> Column:
    """crc32 of the id as text modulo divisor; null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(divisor))


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; rows without an id are held out."""
    remainder = crc_remainder(5)
    scored = score(docs, fit(docs, labels, remainder != 0))
    return scored.select("doc_id", F.coalesce(crc_remainder(5) == 0, F.lit(True)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
