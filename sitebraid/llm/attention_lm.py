"""Language-model scores from a small causal self-attention model, beside an exact unigram score.

The model reads subword ids of a byte-level file. A word is spelt as the ids of a space and its bytes, so ids
give back the bytes and each sequence of words has ids of its own; every id begins a word, goes on with one or
ends the text, and the probabilities of all texts add up to one at most.

One attention head looks back over a window; keys, queries and values are tables by id, positions enter as a
bias by distance. Its output shifts the logits of a bigram table over symbols (frequent ids, and classes of the
others): those of groups of symbols, then those within the target's group. Within a class an id has its bigram
share after the id before it. Texts are scored in windows of two blocks
that overlap by one: each token is scored once, in the second block of its window, with at least a block of
context, by batched masked products.

What is counted covers all training rows: words (for the unigram score), ids and their bigrams, within words
and across them. The attention weights start from windows of a bounded sample (about TRAIN_DOCS texts) on the
driver; then all ids of every training row are learned: rows are dealt to parts by a hash, each part goes on from there over
all windows of its rows, and the weights that come out are averaged by their windows.

Texts are spelt once and whole: their ids are written, and counting, training and scoring read only those. A
word is known by its ids.

Words that are counted most (HEAD of them at most) have their counts and ids in a broadcast table; the counts
of the others meet the texts in a shuffle join of the distinct rare words of each row.
"""

import copy
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, id_and_text, slices, write_table
from .subwords import encoder

#: Words in the broadcast table and bigrams in the model's tables at most; distinct words and bigrams a task counts before it hands them on.
HEAD, PAIRS, COUNTED, PENDING = 200_000, 500_000, 300_000, 2_000_000
#: Words whose ids a worker keeps in each of two tables (those few that aren't spelt with their text), and pieces that its encoder keeps.
WORDS, PIECES = 20_000, 400_000
#: Tokens of a block, width of the head, output symbols, how many of them are single ids, most rows of the tables.
BLOCK, WIDTH, SYMBOLS, SINGLE, ROWS = 16, 24, 160, 120, 4096
#: What is taken off a bigram's count for those never seen.
DISCOUNT = 0.6
#: The first training sample and training itself; RATE_LATER is that of the pass over all training rows.
TRAIN_DOCS, WINDOWS_A_DOC, WINDOW_BLOCKS, EPOCHS, BATCH, RATE, BATCH_LATER, RATE_LATER = 2000, 16, 4, 3, 128, 0.01, 256, 0.006
#: Symbols stand in so many groups of equal size: softmax chooses the group, then the symbol in it.
GROUPS = 10
MEMBERS = SYMBOLS // GROUPS
#: Blocks scored and windows learned from at once.
STEP, CHUNK = 96, 64
#: Softmax takes 2**x by writing x into a float's exponent bits (linear between powers): what a power of e takes of them, what
#: power 0 is, and the most.
BITS, ZERO, MOST = np.float32((1 << 23) / math.log(2)), np.float32(127 << 23), np.float32(200 << 23)
#: Parts in which weights are summed over tasks.
PARTS = 64
#: Rows whose windows are learned one after the other, however many partitions the rows come in.
ROWS_A_PART = 20_000
SPACES = " \t\n\x0b\x0c\r"
#: White space beside ASCII's, which a tokenizer's pattern may take with the space before the next word.
_ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")
_CAPITALS = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words_of(text: str) -> list[bytes]:
    """Words of a text with A-Z in lower case, in UTF-8; only ASCII white space parts them."""
    return text.encode("utf-8", "surrogatepass").translate(_CAPITALS).split()


class Speller:
    """Packed ids of words, each with the space before it; two bounded tables, of which a full one becomes the older."""

    def __init__(self, tokenizer: str):
        self.encoder = encoder(tokenizer, PIECES)
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def spell(self, words: list[bytes]) -> list[bytes]:
        if len(self.known) > WORDS:
            self.known, self.older = {}, self.known
        found = list(map(self.known.get, words))
        if None in found:
            holes = [i for i, x in enumerate(found) if x is None]
            fresh = {w: self.older.get(w) for w in {words[i] for i in holes}}
            new = [w for w, x in fresh.items() if x is None]
            fresh.update(zip(new, self.encoder.encode([" " + w.decode("utf-8", "replace") for w in new]), strict=True))
            self.known.update((w, x) for w, x in fresh.items() if len(w) <= 64)
            for i in holes:
                found[i] = fresh[words[i]]
        return found

    def spell_texts(self, texts: list[list[bytes]]) -> list[bytes]:
        """Packed ids of each text's words, the same as of its words one by one: pieces begin at the space before a word, so whole
        texts are cut into pieces at once, unless they hold odd white space or an added token."""
        joined = [(b" " + b" ".join(x)).decode("utf-8", "replace") if x else "" for x in texts]
        whole = [not _ODD.search(t) and not any(a in t for a in self.encoder.added) for t in joined]
        ids = iter(self.encoder.encode([t for t, ok in zip(joined, whole, strict=True) if ok]))
        return [next(ids) if ok else b"".join(self.spell(x)) for x, ok in zip(texts, whole, strict=True)]


@lru_cache(maxsize=1)
def speller(tokenizer: str) -> Speller:
    """One speller a worker process."""
    return Speller(tokenizer)


def n_ids(tokenizer: str) -> int:
    """Ids of the file, the end of a text and its beginning: the last two."""
    return encoder(tokenizer, PIECES).library.get_vocab_size() + 2


def _id_type(tokenizer: str) -> str:
    return "<u2" if n_ids(tokenizer) <= 1 << 16 else "<u4"


@lru_cache(maxsize=1)
def _first_ids(tokenizer: str) -> np.ndarray:
    """Whether an id begins a word (its bytes begin with the space before it); the end and the beginning of a text count as such."""
    vocab = n_ids(tokenizer)
    first = np.zeros(vocab, bool)
    first[[i for token, i in encoder(tokenizer, PIECES).library.get_vocab().items() if token.startswith("\u0120")]] = True
    first[-2:] = True
    return first


def _cut_words(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start in ids and how many ids each has."""
    starts = np.flatnonzero(first[ids])
    return starts, np.diff(starts, append=len(ids))


def _pieces_of(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> Iterator[bytes]:
    """Packed ids of words."""
    packed, wide = ids.tobytes(), ids.itemsize
    return map(packed.__getitem__, map(slice, (starts * wide).tolist(), ((starts + lengths) * wide).tolist()))


def spelt(texts: DataFrame, tokenizer: str) -> DataFrame:
    """The rows of texts with ids, all ids of the text packed, in place of the text. No shuffle."""
    kind = _id_type(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spell = speller(tokenizer).spell_texts
        for batch in slices(batches):
            packed = [np.frombuffer(x, "<u4").astype(kind).tobytes() for x in spell([words_of(t) for t in column(batch, "text").to_pylist()])]
            rest = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(column(batch, n) for n in rest), pa.array(packed, pa.binary())], [*rest, "ids"])

    return texts.mapInArrow(run, T.StructType([*(f for f in texts.schema.fields if f.name != "text"), T.StructField("ids", T.BinaryType())]))


def gather(docs: DataFrame, tokenizer: str) -> DataFrame:
    """word, key, c over the rows of docs (ids): counts of words (packed ids; the end of a text is the empty word; key is
    null), and of bigrams as first id * ids + second id (word is null). Counted in each task, summed in one shuffle."""
    vocab, kind = n_ids(tokenizer), _id_type(tokenizer)
    begin, end = np.array([vocab - 1], kind).tobytes(), np.array([vocab - 2], kind).tobytes()
    wide = "u4" if vocab <= 1 << 16 else "i8"

    def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        key = np.concatenate(keys)
        order = np.argsort(key)
        key = key[order]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        return key[starts], np.add.reduceat(np.concatenate(counts)[order], starts)

    def of_pairs(unique: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.nulls(len(unique), pa.binary()), pa.array(unique.astype("i8")), pa.array(n)], ["word", "key", "c"])

    def of_words(words: dict[bytes, int]) -> pa.RecordBatch:
        n = len(words)
        return pa.RecordBatch.from_arrays([pa.array(list(words), pa.binary()), pa.nulls(n, pa.int64()), pa.array(list(words.values()), pa.int64())], ["word", "key", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        first, alone = _first_ids(tokenizer), np.zeros(vocab, "i8")  # words of one id are counted by it
        keys, counts, pending = [], [], 0
        for batch in slices(batches, text="ids"):
            ids = np.frombuffer(b"".join(x for own in column(batch, "ids").to_pylist() for x in (begin, own, end)), kind)
            starts, lengths = _cut_words(ids, first)
            alone += np.bincount(ids[starts[lengths == 1]], minlength=vocab)
            words.update(_pieces_of(ids, starts[lengths > 1], lengths[lengths > 1]))
            pairs = ids[:-1].astype(wide) * vocab + ids[1:]
            unique, n = np.unique(pairs[ids[1:] != vocab - 1], return_counts=True)
            keys.append(unique)
            counts.append(n)
            pending += len(unique)
            if pending > PENDING:
                unique, n = summed(keys, counts)
                keys, counts, pending = [unique], [n], len(unique)
                if pending > PENDING // 2:
                    yield of_pairs(unique, n)
                    keys, counts, pending = [], [], 0
            if len(words) > COUNTED:
                yield of_words(words)
                words.clear()
        if keys:
            yield of_pairs(*summed(keys, counts))
            words.update({np.array([i], kind).tobytes(): int(alone[i]) for i in np.flatnonzero(alone[: vocab - 2]).tolist()})
            words[b""] += int(alone[vocab - 2])
            yield of_words(words)

    return docs.select("ids").mapInArrow(run, "word binary, key long, c long").groupBy("word", "key").agg(F.sum("c").alias("c"))


def commonest(counted: DataFrame, most: int) -> DataFrame:
    """The rows with the largest c, by a threshold that a histogram of c gives: most rows at most, all of them if they fit."""
    level = F.floor(F.log2("c") * 16)
    histogram = sorted(((r["level"], r["n"]) for r in counted.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()), reverse=True)  # a row a sixteenth of a doubling
    least, rows = 1 << 30, 0
    for at, n in histogram:
        if rows + n > most:
            break
        least, rows = at, rows + n
    return counted.where(level >= least)


class Attention:
    """Tables and weights; numpy only, some megabytes whatever the corpus."""

    #: What training changes.
    LEARNED = ("k", "q", "v", "near", "lead", "out")

    def __init__(self, counts: np.ndarray, keys: np.ndarray, pairs: np.ndarray):
        """counts: of each id, the end and the start among them as the last two. keys, pairs: the commonest bigrams as first id * ids + second id, ascending, and their counts."""
        self.vocab = len(counts)
        self.end, self.begin = self.vocab - 2, self.vocab - 1
        known = counts.copy()
        known[self.begin] = 0
        order = np.lexsort((np.arange(self.vocab), -known))
        kept = order[: min(ROWS, int((known >= 3).sum()))]
        self.row = np.zeros(self.vocab, "i4")  # row 0: rare ids; the last two: text start, nothing
        self.row[kept] = np.arange(1, len(kept) + 1)
        self.start, self.pad = len(kept) + 1, len(kept) + 2
        self.row[self.begin] = self.start
        rows = len(kept) + 3
        single = order[:SINGLE][known[order[:SINGLE]] > 0]
        self.symbol = np.full(self.vocab, SYMBOLS - 1, "i4")
        self.symbol[single] = np.arange(len(single))
        rest = order[len(single) :][known[order[len(single) :]] > 0]
        before, after = keys // self.vocab, keys % self.vocab
        left = np.zeros((self.vocab, len(single) + 1), "f4")
        np.add.at(left, (after, np.minimum(self.symbol[before], len(single))), pairs)
        if len(rest):
            self.symbol[rest] = len(single) + self._cluster(np.sqrt(left[rest]), SYMBOLS - len(single) - 1)
        place = self._places(left, known)
        self.alone = np.zeros(SYMBOLS, bool)
        self.alone[place[: len(single)]] = True
        self.symbol = place[self.symbol]
        self._set_shares(known, before, after, pairs, rows)
        rng = np.random.default_rng(11)
        self.k = rng.normal(0, 0.3, (rows, WIDTH)).astype("f4")
        self.q = rng.normal(0, 0.3, (rows, WIDTH)).astype("f4")
        self.v = rng.normal(0, 0.3, (rows, WIDTH)).astype("f4")
        self.near = (-0.1 * np.arange(2 * BLOCK)).astype("f4")  # bias by distance
        self.lead = np.zeros((WIDTH, GROUPS), "f4")  # to groups, and to the symbols in each
        self.out = np.zeros((GROUPS, WIDTH, MEMBERS), "f4")
        self.base_lead, self.base = np.zeros((rows, GROUPS), "f4"), np.zeros((rows * GROUPS, MEMBERS), "f4")

    def _places(self, left: np.ndarray, known: np.ndarray) -> np.ndarray:
        """A place (group * MEMBERS + number in it) for each symbol: the commonest first, each in the group with room whose first symbol is most like it by what comes before."""
        points, often = np.zeros((SYMBOLS, left.shape[1])), np.bincount(self.symbol, weights=known, minlength=SYMBOLS)
        np.add.at(points, self.symbol, left)
        points = np.sqrt(points) / np.maximum(np.sqrt(points.sum(axis=1, keepdims=True)), 1e-9)
        order = np.lexsort((np.arange(SYMBOLS), -often))
        like, held, place = points @ points[order[:GROUPS]].T, np.zeros(GROUPS, "i4"), np.zeros(SYMBOLS, "i4")
        for i, x in enumerate(order.tolist()):
            group = i if i < GROUPS else int(np.argmax(np.where(held < MEMBERS, like[x], -1)))
            place[x] = group * MEMBERS + held[group]
            held[group] += 1
        return place

    @staticmethod
    def _cluster(points: np.ndarray, k: int) -> np.ndarray:
        points = points / np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-9)
        k = max(1, min(k, len(points)))
        centre = points[:k].copy()  # the commonest of them
        for _ in range(12):
            owner = np.argmax(points @ centre.T, axis=1)
            for j in range(k):
                if (owner == j).any():
                    centre[j] = points[owner == j].sum(axis=0)
            centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-9)
        return owner.astype("i4")

    def _set_shares(self, known: np.ndarray, before: np.ndarray, after: np.ndarray, pairs: np.ndarray, rows: int) -> None:
        """log p(id | its symbol, row before it): discounted counts of common bigrams over the id's share of its symbol; they sum to one."""
        smooth = known + 0.05
        smooth[self.begin] = 0
        assert rows * self.vocab < 1 << 32
        share = smooth / np.bincount(self.symbol, weights=smooth, minlength=SYMBOLS)[self.symbol]
        inside = ~self.alone[self.symbol[after]] & (after != self.begin)
        where = self.row[before[inside]].astype("i8") * self.vocab + after[inside]
        places, back = np.unique(where, return_inverse=True)
        held = np.bincount(back, weights=pairs[inside], minlength=len(places))
        cell = places // self.vocab * SYMBOLS + self.symbol[places % self.vocab]
        total = np.bincount(cell, weights=held, minlength=rows * SYMBOLS)
        spare = DISCOUNT * np.bincount(cell, minlength=rows * SYMBOLS) + 1.0
        self.spare = np.log(spare / (total + 1.0)).astype("f4").reshape(rows, SYMBOLS)
        self.spare[:, self.alone] = 0
        with np.errstate(divide="ignore"):
            self.share = np.log(share).astype("f4")
        self.share[self.alone[self.symbol]] = 0
        self.places = places.astype("u4")
        self.inside = np.log((held - DISCOUNT + spare[cell] * share[places % self.vocab]) / (total[cell] + 1.0)).astype("f4")

    def within(self, rows: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """log p(id | its symbol, the row before it)."""
        out = np.zeros(len(ids), "f4")
        at = np.flatnonzero(~self.alone[self.symbol[ids]])
        r, i = rows[at].astype("i8"), ids[at]
        value = self.share[i] + self.spare[r, self.symbol[i]]
        if len(self.places):
            key = (r * self.vocab + i).astype("u4")
            found = np.minimum(np.searchsorted(self.places, key), len(self.places) - 1)
            value = np.where(self.places[found] == key, self.inside[found], value)
        out[at] = value
        return out

    def set_base(self, pairs: np.ndarray) -> None:
        """pairs: counts of (row, symbol after it) over all training texts."""
        whole = pairs.sum(axis=0) + 0.5
        prior = whole / whole.sum()
        total = pairs.sum(axis=1, keepdims=True)
        weight = 5.0
        p = ((pairs + weight * prior) / (total + weight)).reshape(-1, GROUPS, MEMBERS)
        groups = p.sum(axis=2)
        self.base_lead, self.base = np.log(groups).astype("f4"), np.log(p / groups[:, :, None]).astype("f4").reshape(-1, MEMBERS)

    def layout(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Input rows and target ids in blocks, each text after a block of nothing; -1 where there is no target."""
        inputs, targets = [], []
        for ids in texts:
            n = len(ids) + 1
            size = BLOCK * (1 + -(-n // BLOCK))
            x, y = np.full(size, self.pad, "i4"), np.full(size, -1, "i8")
            x[BLOCK] = self.start
            x[BLOCK + 1 : BLOCK + n] = self.row[ids]
            y[BLOCK : BLOCK + n - 1] = ids
            y[BLOCK + n - 1] = self.end
            inputs.append(x)
            targets.append(y)
        return np.concatenate(inputs), np.concatenate(targets), np.array([len(x) for x in inputs])

    def _mask(self) -> np.ndarray:
        gap = (BLOCK + np.arange(BLOCK))[:, None] - np.arange(2 * BLOCK)[None, :]
        return np.where(gap >= 0, self.near[np.maximum(gap, 0)], np.float32(-1e9)).astype("f4")

    def bases(self) -> None:
        """The tables' logits in exponent bits, which training doesn't change."""
        self.fast_base_lead, self.fast_base = self.base_lead * BITS + ZERO, self.base * BITS + ZERO

    def attention(self) -> None:
        """Tables for attention in exponent bits; the last column of v is one, so that the sum of the weights comes along."""
        if getattr(self, "fast_kv", None) is None or len(self.fast_kv) != len(self.k):
            self.fast_kv, self.fast_q = np.zeros((len(self.k), 2 * WIDTH + 2), "f4"), np.ones((len(self.k), WIDTH + 1), "f4")
            self.fast_kv[self.pad, WIDTH], self.fast_kv[:, -1] = -1e30, 1
        self.fast_kv[:, :WIDTH], self.fast_kv[:, WIDTH + 1 : -1] = self.k, self.v
        np.multiply(self.q, np.float32(WIDTH**-0.5) * BITS, out=self.fast_q[:, :WIDTH])
        mask = self._mask()
        self.fast_mask = np.where(mask < -1e8, np.float32(-1e30), mask * BITS + ZERO)

    def ready(self) -> None:
        """Tables for scoring. Softmax takes its powers alike for the chosen symbol and for the sum, so probabilities still add up to
        one. What is seen and the weights from there are whole multiples of small powers of two, of which float32 takes exact sums
        in any order: a text's score doesn't depend on what is scored beside it."""
        self.bases()
        self.attention()
        weights = np.concatenate([self.lead, *self.out], axis=1)
        most = float((np.abs(self.v).max(axis=0) * np.abs(weights).max(axis=1)).sum()) + 1e-6
        bits = min(24, int(22 - math.log2(most)))
        self.fine, coarse = np.float32(2.0 ** (bits // 2)), np.float32(2.0 ** (bits - bits // 2))
        self.fast_lead, self.fast_out = np.rint(self.lead * coarse), np.rint(self.out * coarse)
        self.unit = BITS / (self.fine * coarse)

    def log_probabilities(self, inputs: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """log p of each target, 0 where there is none. Works on a few hundred tokens at a time."""
        out = np.zeros(len(inputs), "f4")
        blocks = len(inputs) // BLOCK
        pick = np.maximum(targets, 0)
        symbol = self.symbol[pick]
        group, member = symbol // MEMBERS, symbol % MEMBERS
        count = np.arange(STEP * BLOCK)
        for b in range(0, blocks - 1, STEP):
            n = min(STEP, blocks - 1 - b)
            at, to = (b + 1) * BLOCK, (b + 1 + n) * BLOCK
            x = inputs[at - BLOCK : to]
            own, rows = x[BLOCK:], count[: to - at]
            kv = _in_pairs(self.fast_kv.take(x, 0, mode="clip")[None])[0]
            weight = _power(np.matmul(self.fast_q.take(own, 0, mode="clip").reshape(n, BLOCK, -1), kv[:, :, : WIDTH + 1].transpose(0, 2, 1)), self.fast_mask)
            seen = np.matmul(weight, kv[:, :, WIDTH + 1 :])
            seen = np.rint((seen[:, :, :WIDTH] / (seen[:, :, WIDTH:] + np.float32(1e-30)) * self.fine).reshape(-1, WIDTH))
            lead = _power((seen @ self.fast_lead) * self.unit, self.fast_base_lead.take(own, 0, mode="clip"))
            g, m = group[at:to], member[at:to]
            order, ends = _by_group(g)
            seen, mass = seen.take(order, 0), np.empty((len(order), MEMBERS), "f4")
            for j, (start, end) in enumerate(zip(ends, ends[1:], strict=False)):
                np.matmul(seen[start:end], self.fast_out[j], out=mass[start:end])
            mass *= self.unit
            mass = _power(mass, self.fast_base.take(own[order] * GROUPS + g[order], 0, mode="clip"))
            part = np.empty(len(order), "f4")
            part[order] = mass[rows, m[order]] / mass.sum(axis=1)
            out[at:to] = np.log(lead[rows, g] / lead.sum(axis=1)) + np.log(part) + self.within(own, pick[at:to])
        out[targets < 0] = 0
        return out

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        """log10 p of each text, its end included."""
        inputs, targets, lengths = self.layout(texts)
        each = self.log_probabilities(inputs, targets).astype("f8")
        return np.add.reduceat(each, np.cumsum(lengths) - lengths) / math.log(10)

    def train(self, windows: np.ndarray) -> None:
        """EPOCHS passes of Adam over windows, at a falling rate."""
        trainer, rng = Trainer(self, RATE), np.random.default_rng(5)
        batches = -(-len(windows) // BATCH)
        for epoch in range(EPOCHS):
            order = rng.permutation(len(windows))
            for b in range(batches):
                trainer.step(windows[order[b * BATCH : (b + 1) * BATCH]], 1 - 0.9 * (epoch * batches + b) / (EPOCHS * batches))


class Trainer:
    """Adam over batches of windows (WINDOW_BLOCKS blocks and one id; the first block is context only)."""

    def __init__(self, model: Attention, rate: float):
        self.model, self.rate, self.t = model, rate, 0
        self.moment = {n: (np.zeros_like(getattr(model, n)), np.zeros_like(getattr(model, n))) for n in Attention.LEARNED}
        self.gap = (BLOCK + np.arange(BLOCK))[:, None] - np.arange(2 * BLOCK)[None, :]
        model.bases()
        _warm_heap()

    def step(self, windows: np.ndarray, fall: float = 1.0) -> None:
        """A step down the mean gradient over windows, CHUNK of them at a time."""
        m = self.model
        m.attention()
        self.fast_lead, self.fast_out = m.lead * BITS, m.out * BITS
        xs = np.where(windows >= 0, m.row[np.maximum(windows, 0)], m.pad)
        first = (windows >= 0).argmax(axis=1)
        lead = np.flatnonzero((first > 0) & (windows[:, 0] == -1))
        xs[lead, first[lead] - 1] = m.start
        ys = np.where(windows[:, 1:] >= 0, m.symbol[np.maximum(windows[:, 1:], 0)], -1)
        share = np.float32(1 / max(1, int((ys[:, BLOCK:] >= 0).sum())))
        xs, parts, tables = xs[:, :-1], [], np.empty((len(xs), WINDOW_BLOCKS, BLOCK, 3 * WIDTH), "f4")
        for at in range(0, len(xs), CHUNK):
            parts.append(self._gradients(np.ascontiguousarray(xs[at : at + CHUNK]), ys[at : at + CHUNK], share, tables[at : at + CHUNK]))
        grads = {n: sum(p[n] for p in parts) for n in ("lead", "out", "near")}
        rows = _sum_rows(xs.ravel(), tables.reshape(-1, 3 * WIDTH), len(m.k))
        grads["k"], grads["v"], grads["q"] = rows[:, :WIDTH] / BITS, rows[:, WIDTH : 2 * WIDTH], rows[:, 2 * WIDTH :] * np.float32(WIDTH**-0.5)
        self.t += 1
        rate = self.rate * min(1, self.t / 20) * fall
        for n, g in grads.items():
            first_moment, second = self.moment[n]
            first_moment += 0.1 * (g - first_moment)
            second += 0.01 * (g * g - second)
            getattr(m, n)[...] -= (rate * (first_moment / (1 - 0.9**self.t)) / (np.sqrt(second / (1 - 0.99**self.t)) + 1e-8)).astype("f4")

    def _gradients(self, xs: np.ndarray, ys: np.ndarray, share: np.float32, tables: np.ndarray) -> dict[str, np.ndarray]:
        """Of lead, out and near; those of k, v and q by place go into tables. Each target counts share."""
        m = self.model
        b, nb = len(xs), WINDOW_BLOCKS
        own = xs.reshape(b, nb, BLOCK)[:, 1:].ravel()
        q = m.fast_q.take(own, 0, mode="clip").reshape(b, nb - 1, BLOCK, WIDTH + 1)
        kv = _in_pairs(m.fast_kv.take(xs, 0, mode="clip"))
        kw, vw = kv[..., : WIDTH + 1], kv[..., WIDTH + 1 :]
        a = _power(np.matmul(q, kw.swapaxes(2, 3)), m.fast_mask)
        h = np.matmul(a, vw)
        inverse = 1 / (h[..., WIDTH:] + np.float32(1e-30))
        h = h[..., :WIDTH] * inverse
        flat = h.reshape(-1, WIDTH)
        # groups
        target = ys.reshape(b, nb, BLOCK)[:, 1:].ravel()
        good = np.where(target >= 0, share, np.float32(0))
        group = np.where(target >= 0, target // MEMBERS, GROUPS)
        p = _power(flat @ self.fast_lead, m.fast_base_lead.take(own, 0, mode="clip"))
        p *= (good / p.sum(axis=1))[:, None]
        p[np.arange(len(target)), np.minimum(group, GROUPS - 1)] -= good
        found = {"lead": flat.T @ p, "out": np.zeros_like(m.out)}
        g_h = p @ m.lead.T
        # symbols in the target's group; places without a target come last and are left out
        order, ends = _by_group(group)
        order = order[: ends[GROUPS]]
        sorted_, p, g_sorted = flat.take(order, 0), np.empty((len(order), MEMBERS), "f4"), np.empty((len(order), WIDTH), "f4")
        spans = [(j, slice(ends[j], ends[j + 1])) for j in range(GROUPS) if ends[j + 1] > ends[j]]
        for j, at in spans:
            np.matmul(sorted_[at], self.fast_out[j], out=p[at])
        p = _power(p, m.fast_base.take(own[order] * GROUPS + group[order], 0, mode="clip"))
        p *= (share / p.sum(axis=1))[:, None]
        p[np.arange(len(order)), target[order] % MEMBERS] -= share
        for j, at in spans:
            np.matmul(sorted_[at].T, p[at], out=found["out"][j])
            np.matmul(p[at], m.out[j].T, out=g_sorted[at])
        g_h[order] += g_sorted
        # attention; weights aren't divided by their sum, so what comes back is
        back = np.empty((b, nb - 1, BLOCK, WIDTH + 1), "f4")
        np.multiply(g_h.reshape(h.shape), inverse, out=back[..., :WIDTH])
        np.negative(np.einsum("bnik,bnik->bni", back[..., :WIDTH], h), out=back[..., WIDTH])
        g_s = np.matmul(back, vw.swapaxes(2, 3))
        g_s *= a
        found["near"] = np.bincount(np.maximum(self.gap, 0).ravel(), weights=np.where(self.gap >= 0, g_s.sum(axis=(0, 1)), 0).ravel(), minlength=2 * BLOCK).astype("f4")
        for g, at in ((np.matmul(g_s.swapaxes(2, 3), q[..., :WIDTH]), slice(WIDTH)), (np.matmul(a.swapaxes(2, 3), back[..., :WIDTH]), slice(WIDTH, 2 * WIDTH))):
            tables[:, :-1, :, at] = g[:, :, :BLOCK]
            tables[:, -1, :, at] = 0
            tables[:, 1:, :, at] += g[:, :, BLOCK:]
        tables[:, 0, :, 2 * WIDTH :] = 0
        np.matmul(g_s, kw[..., :WIDTH], out=tables[:, 1:, :, 2 * WIDTH :])
        return found


def _warm_heap() -> None:
    """An array that is freed at once: from then on malloc keeps arrays up to its size instead of asking the system for each."""
    np.empty(7 << 20, "f4")


def _power(x: np.ndarray, more: np.ndarray) -> np.ndarray:
    """2**(x + more), both in exponent bits; x is written over."""
    x += more
    np.clip(x, 0, MOST, out=x)
    return x.astype("i4").view("f4")


def _in_pairs(rows: np.ndarray) -> np.ndarray:
    """Windows of two blocks that overlap by one, over rows of each text (texts, places, width): no copy."""
    texts, places, width = rows.shape
    a, b, c = rows.strides
    return np.lib.stride_tricks.as_strided(rows, (texts, places // BLOCK - 1, 2 * BLOCK, width), (a, BLOCK * b, b, c))


def _by_group(group: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """The order of places by group, and where each group begins in it (and the last ends)."""
    order = np.argsort(group.astype("u1"), kind="stable")  # sorted by radix
    return order, [0, *np.cumsum(np.bincount(group, minlength=GROUPS)).tolist()]


def _sum_rows(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    order = np.argsort(rows.astype("u2" if n <= 1 << 16 else "i4"), kind="stable")  # short ones are sorted by radix
    sorted_ = rows.take(order)
    starts = np.flatnonzero(np.diff(sorted_, prepend=-1))
    out = np.zeros((n, values.shape[1]), "f4")
    out[sorted_[starts]] = np.add.reduceat(values.take(order, 0), starts, axis=0)
    return out


def _windows_of(ids: np.ndarray, vocab: int, starts: np.ndarray) -> list[bytes]:
    """Windows of a text's ids with its end, WINDOW_BLOCKS blocks and one id each; -1 before its start, -2 past its end."""
    size = WINDOW_BLOCKS * BLOCK + 1
    low, high = int(starts[0]), int(starts[-1]) + size
    own = ids[max(0, low - BLOCK) : max(0, high - BLOCK)]
    padded = np.full(high - low, -2, "<i4")
    at = max(0, BLOCK - low)
    padded[:at] = -1
    padded[at : at + len(own)] = own
    if at + len(own) < len(padded):
        padded[at + len(own)] = vocab - 2
    return [padded[s - low : s - low + size].tobytes() for s in starts.tolist()]


def _starts(n: int) -> np.ndarray:
    """Where windows of a text of n ids start, so that each id is learned in one of them."""
    return np.arange(0, max(1, n + 1), (WINDOW_BLOCKS - 1) * BLOCK)


def _window_rows(docs: DataFrame, tokenizer: str, most: int) -> DataFrame:
    """ids: up to most windows of each row's whole text, chosen by a hash of it."""
    vocab, kind = n_ids(tokenizer), _id_type(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for packed, seed in zip(column(batch, "ids").to_pylist(), column(batch, "seed").to_pylist(), strict=True):
                ids = np.frombuffer(packed, kind)
                rng = np.random.default_rng(seed & (1 << 63) - 1)
                out += _windows_of(ids, vocab, np.sort(rng.permutation(_starts(len(ids)))[:most]))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["ids"])

    return docs.select("ids", F.xxhash64("ids").alias("seed")).mapInArrow(run, "ids binary")


def _one_window(text: str, at: int, spell, vocab: int) -> bytes:
    """The window of ids that begins at a character of a text: whole words only, and the end only where the text ends in it."""
    size = WINDOW_BLOCKS * BLOCK + 1
    part = text[at : at + 16 * size]
    whole = at + len(part) == len(text)
    words = words_of(part)[at > 0 and text[at - 1] not in SPACES :]  # a word may have begun before
    if words and not whole and part[-1] not in SPACES:
        words.pop()  # or go on behind
    few = words[:size]
    ids = np.frombuffer(b"".join(spell(few)), "<u4").astype("i8")
    ids = np.concatenate([np.full(0 if at else BLOCK, -1), ids, [vocab - 2] if whole and len(few) == len(words) else []])[:size]
    return np.concatenate([ids, np.full(size - len(ids), -2)]).astype("<i4").tobytes()


def _as_windows(packed: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(packed), "<i4").reshape(-1, WINDOW_BLOCKS * BLOCK + 1).astype("i8")


def _over_all_rows(learned: DataFrame, rows: int, tokenizer: str, model: Attention) -> None:
    """Goes on training over all windows of every one of the rows of learned, in every part of them from the model as it is; takes on the average.

    Rows are dealt to parts by a hash and come in order there, so the weights don't depend on partitions.
    """
    spark, vocab, kind = learned.sparkSession, model.vocab, _id_type(tokenizer)
    first = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deal, trainer, held, n = None, None, [], 0

        def learn() -> None:
            nonlocal n, held
            trainer.step(_as_windows(held[:BATCH_LATER]))
            n, held = n + len(held[:BATCH_LATER]), held[BATCH_LATER:]

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                learn()
            if n:
                flat = np.concatenate([getattr(trainer.model, name).ravel() for name in Attention.LEARNED]) * np.float32(n)
                yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([n] * PARTS, pa.int64()), pa.array([x.astype("<f4").tobytes() for x in np.array_split(flat, PARTS)], pa.binary())], ["part", "n", "sums"])

        for batch in batches:
            for own_deal, packed in zip(column(batch, "deal"), column(batch, "ids"), strict=True):
                own_deal, ids = own_deal.as_py(), np.frombuffer(packed.as_py(), kind)
                if own_deal != deal:
                    yield from done()
                    own = copy.copy(first.value)
                    for name in Attention.LEARNED:
                        setattr(own, name, getattr(first.value, name).copy())
                    deal, trainer, held, n = own_deal, Trainer(own, RATE_LATER), [], 0
                starts = _starts(len(ids))
                for at in range(0, len(starts), BATCH_LATER):
                    held += _windows_of(ids, vocab, starts[at : at + BATCH_LATER])
                    while len(held) >= BATCH_LATER:
                        learn()
        yield from done()

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for part, n, packed in zip(*(column(batch, c).to_pylist() for c in ("part", "n", "sums")), strict=True):
                old = sums.setdefault(part, [0, 0.0])
                old[0], old[1] = old[0] + n, old[1] + np.frombuffer(packed, "<f4").astype("f8")
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x[0] for x in sums.values()], pa.int64()), pa.array([x[1].astype("<f8").tobytes() for x in sums.values()], pa.binary())], ["part", "n", "sums"])

    seed = F.xxhash64("ids", "doc_id")
    dealt = learned.select("ids", seed.alias("seed"), F.pmod(F.xxhash64(seed), F.lit(max(PARTS, rows // ROWS_A_PART))).alias("deal"))
    weights = write_table(dealt.repartition("deal").sortWithinPartitions("deal", "seed", "ids").select("deal", "ids").mapInArrow(run, "part int, n long, sums binary"), "weights")
    found = sorted(weights.repartition("part").sortWithinPartitions("part", "n", "sums").mapInArrow(added, "part int, n long, sums binary").collect(), key=lambda r: r["part"])  # PARTS rows, the weights once
    if found:
        flat, at = np.concatenate([np.frombuffer(r["sums"], "<f8") / r["n"] for r in found]), 0
        for name in Attention.LEARNED:
            old = getattr(model, name)
            setattr(model, name, flat[at : at + old.size].reshape(old.shape).astype("f4"))
            at += old.size


def _row_pairs(pairs: DataFrame, model: Attention) -> np.ndarray:
    """Counts of (row, symbol after it) over all bigrams; at most the tables' size comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(model.k) * SYMBOLS)
        for batch in batches:
            key, c = column(batch, "key").to_numpy(), column(batch, "c").to_numpy()
            total += np.bincount(model.row[key // model.vocab].astype("i8") * SYMBOLS + model.symbol[key % model.vocab], weights=c, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at].astype("i8"))], ["at", "c"])

    sums = pairs.mapInArrow(run, "at long, c long").groupBy("at").agg(F.sum("c").alias("c")).toArrow()
    out = np.zeros(len(model.k) * SYMBOLS)
    out[sums["at"].to_numpy()] = sums["c"].to_numpy()
    return out.reshape(-1, SYMBOLS)


def fit(learned: DataFrame, counted: DataFrame, tokenizer: str) -> Attention:
    """The model of the rows of learned (doc_id, ids), whose bigrams are counted (key, c)."""
    vocab = n_ids(tokenizer)
    ids = counted.groupBy((F.col("key") % vocab).alias("id")).agg(F.sum("c").alias("c")).toArrow()  # a row an id
    counts = np.zeros(vocab)
    counts[ids["id"].to_numpy()] = ids["c"].to_numpy()
    top = commonest(counted, PAIRS).toArrow().sort_by("key")
    model = Attention(counts, top["key"].to_numpy(), top["c"].to_numpy().astype("f8"))
    model.set_base(_row_pairs(counted, model))
    texts = int(counts[model.end])
    if texts:
        share = int(2**31 * min(1.0, TRAIN_DOCS / texts))
        picked = learned.where(F.pmod(F.xxhash64(F.lit("first sample"), "ids"), F.lit(2**31)) < share)
        windows = _as_windows(sorted(r["ids"] for r in _window_rows(picked, tokenizer, WINDOWS_A_DOC).distinct().collect()))  # copies count once: about TRAIN_DOCS texts
        if len(windows):
            model.train(windows)
        _over_all_rows(learned, texts, tokenizer, model)
    return model


@lru_cache(maxsize=1)
def _head(key: int, held: Broadcast, kind: str, vocab: int) -> tuple[dict[bytes, float], np.ndarray]:
    """Logs of words of more ids by their packed ids, and of words of one id by it (-1: not held)."""
    words, counts = held.value
    logs, alone, wide = np.log10(np.asarray(counts, "f8") + 1).tolist(), np.full(vocab, -1.0), np.dtype(kind).itemsize
    for w, x in zip(words, logs, strict=True):
        if len(w) == wide:
            alone[np.frombuffer(w, kind)[0]] = x
    return {w: x for w, x in zip(words, logs, strict=True) if len(w) > wide}, alone


def lm_scores(docs: DataFrame, tokenizer: str, training: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row.

    tokenizer: a byte-level file, as its ids must give back a word's bytes. training: which doc_ids may be
    learned from (null: not). Null and empty texts have the end token only. Without training rows the base has
    N = V = 0 and the model is uniform over its ids. Repeated rows stay repeated and are scored alike.
    """
    spark = docs.sparkSession
    texts = id_and_text(docs, id_col, text_col)
    texts = write_table(spelt(texts.withColumn("learn", training), tokenizer), "spelt")
    learned = texts.where("learn")
    gathered = write_table(gather(learned, tokenizer), "gathered")
    counts = gathered.where(F.col("word").isNotNull()).select("word", "c")
    n, v, ends = counts.agg(F.sum("c"), F.count("*"), F.sum(F.when(F.length("word") == 0, F.col("c")))).first()
    n = n or 0
    total = math.log10(n + v + 1)
    model = fit(learned, gathered.where(F.col("key").isNotNull()).select("key", "c"), tokenizer)
    model.ready()
    head = commonest(counts, HEAD).toArrow()
    head_words = head["word"].to_pylist()
    held = spark.sparkContext.broadcast((head_words, head["c"].to_numpy()))  # HEAD words at most
    weights = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, first = _id_type(tokenizer), _first_ids(tokenizer)
        index, alone = _head(id(held), held, kind, len(first))
        end_log = math.log10((ends or 0) + 1)
        seen, part = 0, TaskContext.get().partitionId()
        _warm_heap()
        for batch in slices(batches, text="ids"):
            texts = [np.frombuffer(x, kind) for x in column(batch, "ids").to_pylist()]
            n, ids = len(texts), np.concatenate(texts)
            starts, lengths = _cut_words(ids, first)
            owner = np.searchsorted(np.cumsum([len(x) for x in texts]), starts, "right")
            log, more = alone[ids[starts]], np.flatnonzero(lengths > 1)
            log[more] = list(map(index.get, _pieces_of(ids, starts[more], lengths[more]), [-1.0] * len(more)))
            met, holes = log >= 0, np.flatnonzero(log < 0)
            rare: list[Counter] = [Counter() for _ in texts]
            for i, w in zip(owner[holes].tolist(), _pieces_of(ids, starts[holes], lengths[holes]), strict=True):
                rare[i][w] += 1
            tokens, known = np.bincount(owner, minlength=n) + 1, np.bincount(owner[met], minlength=n) + bool(ends)
            logs = np.bincount(owner[met], weights=log[met], minlength=n) + end_log
            rows = (part << 40) + seen + np.arange(n)
            seen += n
            names, times = pa.array([list(x) for x in rare], pa.list_(pa.binary())), pa.array([list(x.values()) for x in rare], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), *map(pa.array, (rows, tokens, known, logs)), names, times, pa.array(weights.value.scores(texts))], ["doc_id", "row", "n_tokens", "known", "logs", "rare", "times", "score"])

    scored = write_table(texts.select("doc_id", "ids").mapInArrow(run, "doc_id long, row long, n_tokens long, known long, logs double, rare array<binary>, times array<long>, score double"), "scored")
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    met = rare.join(counts, "word").select("row", "times", F.log10(F.col("c") + 1.0).alias("log"))
    found = met.groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.col("log")).alias("more_logs"))
    return scored.join(found, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(total)).alias("base_score"),
        "score",
    )
